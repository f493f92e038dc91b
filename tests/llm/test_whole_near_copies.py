"""Near copies among documents whose ids are null or shared."""

from larkspan.llm import jaccard_join


def test_null_and_shared_ids_keep_a_row_of_each_class(spark):
    text = lambda k, n=40: " ".join(f"{k}word{i}" for i in range(n))
    near = lambda k: text(k) + " end"
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, near("c"))]  # three classes without an id
    rows += [(7, text("d")), (7, text("e"))]  # an id that the first of two classes share
    rows += [(1, text("f")), (2, near("f")), (2, text("g"))]  # 2 is a near copy of 1, and the first of g
    rows += [(3, text("h")), (3, near("h")), (4, text("i")), (4, text("i"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((r.doc_id or 0, r.text.split("word")[0], r.text.endswith("end")) for r in jaccard_join.one_of_each(docs).collect())
    assert [x[:2] for x in kept] == [(0, "a"), (0, "b"), (0, "c"), (1, "f"), (2, "g"), (3, "h"), (4, "i"), (7, "d"), (7, "e")]
    assert (1, "f", False) in kept
    again = sorted((r.doc_id or 0, r.text.split("word")[0], r.text.endswith("end")) for r in jaccard_join.one_of_each(docs.repartition(5)).collect())
    assert again == kept
