"""The corpus operators against brute force on small tables with the awkward cases in them."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from larkspan.llm import exact_dedup, graphs, jaccard_join, language_id, mixing, packing, secret_scan, sharding, substring_dedup, suffix_dedup, topk_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, kept string, `key` string, size string"


def documents(spark, rows):
    """rows of (doc_id, text, lang, source); the other columns clash with names that operators use or hold nulls."""
    return spark.createDataFrame([(*r, None, 7, "x", "y", "z") for r in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages within and across texts, nulls, empty, blank, very long and repeated rows."""
    rng = random.Random(3)
    passage = words(rng, 60)
    out = [(i, " ".join(words(rng, rng.randrange(1, 120))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])) for i in range(60)]
    out += [(100 + i, out[i % 3][1], "en", "a") for i in range(12)]
    out += [(200 + i, " ".join(words(rng, 20) + passage[: 36 + i] + words(rng, 15)), "en", "b") for i in range(8)]
    out += [(300, " ".join(passage + ["x"] + passage), "en", "b"), (301, " ".join(words(rng, 6000)), "fr", "c")]
    base = words(rng, 100, 10**6)
    for i in range(10):
        near = list(base)
        near[rng.randrange(100)] = f"changed{i}"
        out.append((400 + i, " ".join(near), "en", "c"))
    out += [(500, None, "en", None), (501, "", None, "a"), (502, " \t\n ", "fr", "a"), (None, "only words here", "en", "b"), (None, None, None, None), (503, "1234 !!", "en", "a")]
    out += [(600, "said twice in one row", "en", "a")] * 3 + [(601, "a\tb  c", "en", "a"), (602, "a b c", "en", "a"), (603, "a b c ", "en", "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def split(text):
    return (text or "").encode().split()


def brute_windows(rows, width, unit):
    sequences = [unit(t) for _, t, *_ in rows]
    seen = collections.Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - width + 1):
            if seen[tuple(s[i : i + width])] > 1:
                gone[i : i + width] = True
        out.append((s, gone))
    return out


def test_substring_dedup(docs, rows, empty):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, 35).collect())
    want = collections.Counter()
    for (i, *_), (s, gone) in zip(rows, brute_windows(rows, 35, split), strict=True):
        want[(i, len(s), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(s, gone, strict=True) if not g)).hexdigest())] += 1
    assert got == want and sum(r[2] for r in want) > 500
    assert substring_dedup.remove_repeats(empty, 35).count() == 0


def test_cover_meets_every_pair_of_offsets():
    for i in range(substring_dedup.PERIOD):
        for j in range(substring_dedup.PERIOD):
            assert any((i + d) % 21 in substring_dedup.COVER and (j + d) % 21 in substring_dedup.COVER for d in range(21))


def test_suffix_dedup(docs, rows, empty):
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, 100).collect())
    want = collections.Counter()
    for (i, *_), (s, gone) in zip(rows, brute_windows(rows, 100, lambda t: (t or "").encode()), strict=True):
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[(i, len(s), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(s, np.uint8)[~gone])).hexdigest())] += 1
    assert got == want and sum(r[3] for r in want) > 10
    assert suffix_dedup.remove_repeats(empty, 400).count() == 0


def test_suffix_dedup_of_odd_windows_and_texts_of_several_slices(spark):
    """A text of more than a slice shares a passage across its slices' border; strings that differ in their middle byte stay."""
    rng = np.random.default_rng(5)
    far = rng.integers(97, 123, suffix_dedup.SLICE + 5000).astype(np.uint8).tobytes().decode()
    shared = far[suffix_dedup.SLICE - 60 : suffix_dedup.SLICE + 60]
    head, tail = far[:25], far[26:51]
    rows = [(1, far), (2, "A" * 30 + shared + "B" * 30), (3, "C" + head + "#" + tail + "D"), (4, far[100:150]), (5, far[100:151])]
    rows += [(None, "said again " * 20)] * 50 + [(None, None)] * 30
    got = collections.Counter((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 51).collect())
    said = len("said again " * 20)
    assert got == {(1, 120 + 51, 2): 1, (2, 120, 1): 1, (3, 0, 0): 1, (4, 0, 0): 1, (5, 51, 1): 1, (None, said, 1): 50, (None, 0, 0): 30}


def test_suffix_runs_span_texts_in_slices(monkeypatch):
    """Runs of a long text in slices hold each window start once."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    data = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 3000, 3050, 5000])
    starts = []
    for piece, text, place, edges in suffix_dedup._slices(data, offsets, 100):
        first, last, _ = suffix_dedup.Buckets(piece, edges, 100).runs()
        for a, b in zip(first, last, strict=True):
            s = np.searchsorted(edges, a, "right") - 1
            starts += [(text[s], place[s] + x - edges[s]) for x in range(a, b + 1)]
    assert sorted(starts) == [(0, i) for i in range(2901)] + [(2, i) for i in range(1851)]


def shingle_set(text):
    w = split(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_join(docs, rows, empty):
    got = {r.doc_id: (r.class_id, r.n_links, r.n_texts) for r in jaccard_join.join(docs).collect() if r.doc_id is not None}
    sets = [shingle_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, texts = collections.Counter(), collections.defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            same = rows[i][1] == rows[j][1] or (not rows[i][1] and not rows[j][1])
            if i != j and (same or (a and b and 5 * len(a & b) >= 4 * len(a | b))):
                links[i] += 1
                if not same:
                    texts[i].add(rows[j][1])
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    members = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            members[find(i)].append(r[0])
    for i, r in enumerate(rows):
        if r[0] is not None:
            assert got[r[0]] == (min(members[find(i)]), links[i], len(texts[i])), r[0]
    assert jaccard_join.join(empty).count() == 0


def test_jaccard_blocks_agree(docs, monkeypatch):
    whole = sorted(tuple(r) for r in jaccard_join.join(docs.filter("doc_id is not null")).collect())
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    assert sorted(tuple(r) for r in jaccard_join.join(docs.filter("doc_id is not null")).collect()) == whole


def test_near_copies_leave_one(docs, rows):
    kept = jaccard_join.one_of_each(docs.filter("doc_id is not null"))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i < 400) == [*range(60), *range(200, 208), 300, 301]
    assert [i for i in ids if 400 <= i < 500] == [400] and ids.count(600) == 1


def test_posterior_table():
    least = jaccard_join.least_matches(0.8, 1e-6)
    assert list(least) == [16, 32, 64, 128] and 0 < least[16] < 9 and 70 < least[128] < 90


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(60, 90)] + [(200, 201)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 60 for i in [*range(60, 90), 100]} | {200: 200, 201: 200}


def test_exact_dedup(docs, rows, empty):
    import re

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    got = exact_dedup.refine(docs).collect()
    assert len(got) == len(rows)
    by_sha = collections.defaultdict(list)
    for r in got:
        by_sha[r.text_sha256].append(r)
    for text, ids in groups.items():
        found = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert len(found) == len(ids) and {r.group_size for r in found} == {len(ids)}
        assert {r.keep_id for r in found} == {min(known) if known else None} and sum(r.kept for r in found) == 1
    assert exact_dedup.refine(empty).count() == 0
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups) and {r._row for r in kept.collect()} == {7}


def test_mixing(docs, rows, empty):
    taken = mixing.mix(docs).collect()
    assert len(taken) == len(rows) and all(t.copies <= 2 and t.size == len(split(t.row.text)) for t in taken)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(split(t))
    total, weights = 1.5 * sum(sizes.values()), dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    full = set()
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / sum(w for s, w in weights.items() if s not in full)
        over = {s for s, w in weights.items() if 2 * sizes[s] < level * w}
        if over == full:
            break
        full = over
    for s, w in weights.items():
        mine = [t for t in taken if t.row.source == s]
        target = 2 * sizes[s] if s in full else level * w
        assert mine[0].target == pytest.approx(target) and mine[0].source_size == sizes[s]
        assert abs(sum(t.copies * t.size for t in mine) - target) <= max(t.size for t in mine)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(t.copies for t in taken)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs, shards=4).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    where = collections.defaultdict(set)
    texts = collections.defaultdict(set)
    for i, t, *_ in rows:
        texts[t or ""].add(i)
    for r in got:
        where[(r.size, r.text_crc32)].add(r.shard)
    assert max(map(len, where.values())) == 1
    assert sharding.shard(empty, shards=8).count() == 0
    leaves = {r.shard for r in sharding.shard(docs, target_bytes=20_000).collect()}
    assert leaves == set(range(len(leaves))) and len(leaves) > 2


def test_sharding_is_even(spark):
    rng = random.Random(1)
    many = documents(spark, [(i, "x" * rng.randrange(50, 800) if i % 3 else "the same " * 40, "en", f"s{i % 9}") for i in range(3000)])
    sizes = collections.Counter()
    for r in sharding.shard(many, shards=8).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.03 * sum(sizes.values()) / 8


def test_sharding_keeps_groups_of_up_to_half_a_shard(spark):
    """The law `bytes` forces larger groups apart, as one of them outweighs what a cut may err; up to there they stay whole."""
    filler = [(i, f"{i:04d}" + "x" * 95, "en", f"s{i % 9}") for i in range(4000)]
    goal = (sum(len(t) + 1 for _, t, *_ in filler) + 400 * 100) / 8
    for copies, apart in ((int(goal / 2 / 100) - 30, False), (int(goal / 2 / 100) + 60, True)):
        rows = filler[: 4000 - copies] + [(10_000 + i, "y" * 99, "en", f"s{i % 9}") for i in range(copies)]
        placed = sharding.shard(documents(spark, rows), shards=8).collect()
        where = {r.shard for r in placed if r.doc_id >= 10_000}
        sizes = collections.Counter()
        for r in placed:
            sizes[r.shard] += r.size
        assert (len(where) > 1) == apart and max(sizes.values()) < 1.03 * sum(sizes.values()) / 8


def test_packing(docs, rows, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = packing.pack(docs, capacity=256, docs_per_group=40, with_ids=True).collect()
    ids = collections.defaultdict(set)
    for i, t, *_ in rows:
        ids[i].add(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,))
    sequences = collections.defaultdict(list)
    for p in got:
        assert len(p.ids) == p.length <= 256 and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        assert any(len(x) == p.doc_tokens and list(x[p.start : p.start + p.length]) == p.ids for x in ids[p.doc_id])
        sequences[p.sequence_id].append(p)
    assert sum(p.length for p in got) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    assert packing.pack(empty).count() == 0


def test_word_ids_equal_whole_text_ids():
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    from larkspan.llm import wordpiece

    path = public.path("word_bpe_49k.json")
    texts = ["It's WE'LL don't ÉCOLE ñandú 12½ x²", "naïve café İstanbul ΣΑΣ 日本語", "a b\x1cc\x02d\x85e <|endoftext|> x<|startoftext|>y", None, "", "w" * 500, "--- ### $$% ___ a_b", "🙂🙂 ok", "line\r\nbreak\ttab"]
    ids, bounds = wordpiece.load(path).texts(pa.array(texts, pa.string()))
    whole = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        assert list(ids[bounds[i] : bounds[i + 1]]) == whole.encode(t or "", add_special_tokens=False).ids, t


def test_word_ids_of_mixed_texts_equal_the_tokenizers():
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    from larkspan.llm import wordpiece

    rng = random.Random(12)
    pools = ["abcdefghijklmnop", "ABCÀÉÎßñÿŁőİı", "0123456789½²", " \t\n\u00a0\u2003", "'’.,;:!?()[]{}<|>_-#@$%", "日本語ΣςщЖ", "🙂🏳️\u200d\u0301"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    path = public.path("word_bpe_49k.json")
    ids, bounds = wordpiece.load(path).texts(pa.array(texts, pa.string()))
    for i, found in enumerate(Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == found.ids, texts[i]


def test_first_fit_decreasing_matches_a_plain_scan():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    free: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(100)
        assert (bins[i], offsets[i]) == (b, 100 - free[b])
        free[b] -= lengths[i]


def test_topk_search(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 24))
    vectors[10] = vectors[20] = vectors[30]
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    rows += [(50, None, "x"), (None, rows[5][1], "x"), (101, [float("nan")] * 24, "x"), (102, [None] * 24, "x"), (150, [1.0, 2.0], "x"), (103, [], "x"), (20, rows[20][1], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    usable = [(i, np.floor(256 * np.array(v))) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    for block in (1 << 24, 3000):
        got = topk_search.search(frame, "vec_id % 50 = 0", 5, block_bytes=block).collect()
        by_query = collections.defaultdict(list)
        for r in got:
            by_query[r.query_id].append((r.rank, r.vec_id, r.score))
        for n, (q, v) in enumerate(usable):
            if q is not None and q % 50 == 0 and len(v) == 24:
                scores = sorted((-int(v @ w), j is None, j or 0, j) for m, (j, w) in enumerate(usable) if m != n and len(w) == 24)[:5]
                assert sorted(by_query[q]) == [(k + 1, s[3], -s[0]) for k, s in enumerate(scores)]
    assert topk_search.search(frame.limit(0), "vec_id % 50 = 0").count() == 0


def test_segment_bound_holds():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(40, 30)), rng.normal(size=(50, 30))
    exact, last = a @ b.T, None
    for s in (1, 4, 16, 30):
        bound = topk_search.segment_statistics(a, s) @ topk_search.segment_statistics(b, s).T
        assert (bound >= exact - 1e-9).all()
        last = bound
    assert np.allclose(last, exact)


def test_bounds_decide_pairs_before_their_score():
    """Vectors of few smooth shapes: most pairs are dropped by their bounds, and the result is that of all scores."""
    rng = np.random.default_rng(7)
    shapes = np.repeat(rng.normal(size=(12, 8)), 8, axis=1)
    vectors = np.floor(256 * (shapes[rng.integers(0, 12, 6000)] + 0.05 * rng.normal(size=(6000, 64))))
    queries, rows = vectors[::50], np.arange(6000)
    q, v, s, scored = topk_search.block_top_k(queries, rows[::50], vectors, rows, rows, 5)
    full = (queries @ vectors.T).astype(np.int64)
    full[np.arange(120), rows[::50]] = -(2**60)
    for i in range(120):
        best = np.lexsort((rows, -full[i]))[:5]
        assert v[q == i].tolist() == best.tolist() and s[q == i].tolist() == full[i, best].tolist()
    assert scored < 0.3 * full.size


def test_scores_beyond_a_float_are_compared_whole():
    vectors = np.array([[2.0**30, 1.0], [2.0**30, 2.0], [2.0**30, 3.0], [2.0**30, 0.0]])
    q, v, s, _ = topk_search.block_top_k(np.array([[2.0**30, 1.0]]), np.array([-1]), vectors, np.arange(4), np.arange(4), 2)
    assert v.tolist() == [2, 1] and s.tolist() == [2**60 + 3, 2**60 + 2]


LANGUAGES = {"en": "the quick brown fox and all of their friends went over the hills with the sheep", "fr": "le renard brun et toutes les amies sont allés sur les collines avec les moutons", "de": "der schnelle braune fuchs und alle seine freunde gingen mit den schafen über die hügel"}


def test_language_id(spark, empty):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        lang = rng.choice(list(LANGUAGES))
        rows.append((i, " ".join(rng.choices(LANGUAGES[lang].split(), k=12)), lang if i % 17 else None, "s"))
    truth = {r[0]: next(k for k, v in LANGUAGES.items() if r[1].split()[0] in v.split() and r[1].split()[1] in v.split() and r[1].split()[2] in v.split()) for r in rows}
    rows += [(1000, None, "en", "s"), (1001, "123 ... !", "en", "s"), (1002, "", "fr", "s"), (None, LANGUAGES["fr"], "fr", "s"), (1003, "The Fox! " * 200_000, "en", "s")]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in truth if got[i].held_out] == held
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[1003].lang_pred == "en" and got[None].lang_pred == "fr" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and not {1000, 1001, 1002} & {r.doc_id for r in kept.select("doc_id").collect()} and kept.count() > 590
    assert language_id.identify(empty).count() == 0 and language_id.accepted(empty).count() == 0


def test_slices_keep_every_gram(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abc dé", k=5000)), "ab" + "1 " * 900 + "ÇΣ x" * 200 + "  ", "İstanbul" * 100 + "9" * 700, "🙂a" * 400, "." * 2000]
    whole = [language_id.text_counts(t) for t in texts]
    for size in (257, 100, 64):
        monkeypatch.setattr(language_id, "CHUNK_CHARS", size)
        for text, (buckets, counts) in zip(texts, whole, strict=True):
            sliced = language_id.text_counts(text)
            assert sliced[0].tolist() == buckets.tolist() and sliced[1].tolist() == counts.tolist()


def test_secret_scan(spark, empty):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [(1, f'some words token = "{key}" more words', "en", "src1"), (2, f"in commit {key} we fixed the build", "en", "src1"), (3, "call 4539578763621486 now", "en", None), (4, None, None, None), (5, "", None, "a"), (None, f"api_key: '{key.upper()}'", "en", "b"), (6, f"see https://a.example/path/{'verylongword' * 3}/x", "en", "b"), (7, "password = hunter2hunter", "en", "config.env")]
    rows += [rows[0]] * 2 + [(8, "word " * 100_000 + f'secret="{key}"', "en", "b")]
    docs = documents(spark, rows)
    model = secret_scan.train(secret_scan.labelled_findings(spark, 3000))
    got = collections.Counter(r.doc_id for r in secret_scan.scan(docs, model).collect())
    assert got[1] == 3 and got[None] == 1 and got[8] == 1 and not {2, 3, 4, 5, 6} & set(got)
    everything = secret_scan.scan(docs, model, keep_rejected=True).collect()
    for r in everything:
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert hashlib.sha256(text[r.start : r.start + r.length].encode()).hexdigest() == r.secret_sha256
    assert secret_scan.scan(empty, model).count() == 0
    unseen = model.transform(secret_scan.with_features(secret_scan.labelled_findings(spark, 2000, seed=99)))
    assert unseen.selectExpr("avg(cast(prediction = label as int))").first()[0] > 0.97


def test_secret_scan_runs_no_python(spark, docs):
    model = secret_scan.train(secret_scan.labelled_findings(spark, 500), trees=3)
    plans = [secret_scan.scan(docs, model), exact_dedup.refine(docs)]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
