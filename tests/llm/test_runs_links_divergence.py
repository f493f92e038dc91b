"""Periodic runs, URL filters and the divergence audit against brute force, with the awkward cases."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspan.llm import divergence, periodic_runs, registry, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, runs string, term string, n string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, None, "x", "y", "z", None) for r in rows], DOCS)


def brute_runs(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, exponent * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(3000):
        letters = rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            base = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
            w = w[:10] + base * rng.randrange(2, 8) + base[: rng.randrange(len(base) + 1)] + w[10:20]
        assert periodic_runs.runs_in(w) == brute_runs(w)
        assert periodic_runs.runs_in(w, 9, 5) == brute_runs(w, 9, 5)
    with pytest.raises(ValueError):
        periodic_runs.runs_in([1, 1], 2, 3)


def test_least_overlap_is_met_by_every_run():
    assert periodic_runs.least_overlap(6, 4) == 5
    for least in range(2, 30):
        assert periodic_runs.least_overlap(least, 4) == min(max(least, 4 * q) - q for q in range(1, 100))


@pytest.fixture(scope="module")
def run_rows():
    rng = random.Random(5)
    word = lambda n: [f"w{rng.randrange(n)}é" for _ in range(rng.randrange(80))]
    out = [(i, " ".join(word(300) + (word(300)[: rng.randrange(1, 9)] * rng.randrange(1, 9)) + word(300)), "en", "a") for i in range(150)]
    out += [(200, None, None, None), (201, "", "en", "a"), (202, " \t\n", "en", "a"), (203, "one", "en", "a"), (None, "a b " * 9, "en", "a"), (None, None, None, None)]
    out += [(204, "a b\tc \x0b" * 700 + "d\u00a0e " * 6, "en", "a"), (205, "x " * 5, "en", "a"), (206, "x " * 6, "en", "a"), (207, "a\u2003b c\x1cd " * 5, "en", "a")]
    out += [(208, " ".join(["p q r s"] * 4 + ["p q r s"[: 2 * i] for i in (1, 2)] * 3 + ["z"] * 40), "en", "a")] * 3
    return out


def test_find_runs(spark, run_rows):
    docs = documents(spark, run_rows).repartition(3)
    got = collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs.find_runs(docs).collect())
    want = collections.Counter()
    for i, text, *_ in run_rows:
        w = (text or "").encode().split()
        runs, gone = brute_runs(w), set()
        for s, n, q in runs:
            gone |= set(range(s + q, s + n))
        want[(i, len(w), tuple(runs), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())] += 1
    assert got == want and sum(map(len, (k[2] for k in want))) > 40
    assert periodic_runs.find_runs(documents(spark, [])).count() == 0
    assert "collapsed" not in periodic_runs.find_runs(docs, with_text=False).columns


def test_long_texts_come_in_slices(spark, monkeypatch):
    text = "aé " * 400 + "b c d " * 300 + "long" * 50 + " tail"
    whole = periodic_runs.find_runs(documents(spark, [(1, text, "en", "a")])).collect()
    monkeypatch.setattr(periodic_runs, "SLICE_BYTES", 37)
    cut = [w for s in periodic_runs._slices(memoryview(text.encode())) for w in s.split()]
    assert cut == text.encode().split() and whole[0].n_words == len(cut)
    assert [tuple(r) for r in whole[0].runs] == [(0, 400, 1), (400, 900, 3)]


def test_planted_tails(spark, run_rows):
    docs = documents(spark, run_rows)
    got = {r.doc_id: r.planted for r in docs.select("doc_id", periodic_runs.with_planted_tail(F.col("doc_id"), F.col("text"), r"[^\x20\x09-\x0D]+").alias("planted")).collect() if r.doc_id is not None}
    planted = 0
    for i, text, *_ in run_rows:
        if i is None:
            continue
        w, h = (text or "").encode().split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
            planted += 1
        assert (got[i] or "").encode().split() == w
    assert planted > 5


PAGES = "page_id long, url string, html string, host string, verdict string, blocked boolean, n string"
RULES = registry.RULES


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "v", None, "n") for r in rows], PAGES)


@pytest.fixture(scope="module")
def page_rows():
    """A hub that many link to, a farm that links to blocked hosts, hosts that no rule and no link reaches, and odd urls."""
    link = lambda *hosts: "".join(f'<a class="x" HREF="https://{h}/p">{h}</a>' for h in hosts) + "<a href='/own'>o</a>"
    rows = [(1, "https://Good.ORG/a?x=1", link("friend.net", "hub.net")), (2, "http://bad.com/de/1", link("hub.net")), (3, "http://farm.net/1#t", link("bad.com", "bad.com", "worse.com"))]
    rows += [(4, "http://worse.com/de/", None), (5, "http://friend.net", "<a href=//FRIEND2.net:80/x>"), (6, "http://friend2.net:80/x", ""), (7, "http://lone.net/q", link())]
    rows += [(8, None, link("bad.com")), (9, "no scheme", None), (10, "://", None), (11, "x://a.example.org/es/1", None), (12, "http://b.example.org/en/12", None), (13, "http://b.example.org/en/2", None)]
    rows += [(14, "https://org", None), (15, "https://xorg/", None), (16, "https://com/fr/é?y#z", None), (17, "http://mixed.com/fr/1", None), (18, "http://mixed.com/de/1", None), (19, "http://mixed.com/de/2", None), (20, "http://mixed.com/en/", None)]
    rows += [(100 + i, f"http://fan{i}.net/", link("hub.net", "bad.com" if i % 2 else "good.org")) for i in range(40)]
    rows += [(500, "http://hub.net/x\ny", None)] * 3 + [(None, "http://ring1.net/", link("ring2.net")), (501, "http://ring2.net/", link("ring1.net", "bad.com"))]
    return rows


def brute_verdicts(rows):
    def parts(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")

    def ruled(host, path):
        fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: len(r.name)) if fit else None

    trust, edges = collections.defaultdict(lambda: [0, 0]), set()
    for _, url, html in rows:
        host, path = parts(url)
        if host and (rule := ruled(host, path)):
            trust[host][rule.verdict == "block"] += url_filter.UNIT
        if host:
            edges |= {(host, h.lower()) for h in re.findall(r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)""", html or "") if h.lower() != host}
    out, back = collections.Counter(s for s, _ in edges), collections.Counter(d for _, d in edges)
    wave, total = trust, collections.defaultdict(lambda: [0, 0])
    for step in range(31):
        for h, (t, d) in wave.items():
            total[h][0] += t
            total[h][1] += d
        after = collections.defaultdict(lambda: [0, 0])
        for s, d in edges:
            after[d][0] += wave[s][0] * 85 // (100 * out[s]) if s in wave else 0
            after[s][1] += wave[d][1] * 85 // (100 * back[d]) if d in wave else 0
        wave = after
    answers = []
    for i, url, _ in rows:
        host, path = parts(url)
        rule = ruled(host, path)
        answers.append((i, host, path, rule.name if rule else None, rule.verdict if rule else "block" if total[host][1] > total[host][0] else "allow"))
    return answers


def test_url_filter(spark, page_rows):
    got = collections.Counter(tuple(r) for r in url_filter.judge(pages(spark, page_rows).repartition(3), RULES).collect())
    assert got == collections.Counter(brute_verdicts(page_rows))
    by_id = {k[0]: k[4] for k in got}
    assert by_id[3] == "block" and by_id[20] == "block" and by_id[5] == by_id[7] == by_id[8] == "allow" and by_id[101] == "block" and by_id[100] == "allow"
    assert url_filter.judge(pages(spark, []), RULES).count() == 0


def test_url_filter_with_salted_joins(spark, page_rows, monkeypatch):
    from larkspan.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    got = collections.Counter(tuple(r) for r in url_filter.judge(pages(spark, page_rows), RULES).collect())
    assert got == collections.Counter(brute_verdicts(page_rows))


def test_url_filter_sql_over_links(spark, page_rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", page_rows)
    got = con.execute(registry.oracle_sql()["op12_url_filter"]).fetchall()
    assert collections.Counter(got) == collections.Counter(brute_verdicts(page_rows))


def test_url_filter_stays_in_the_engine(spark, page_rows):
    plan = url_filter.judge(pages(spark, page_rows), RULES)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "InPandas", "InArrow"))


def brute_audit(rows, k=10, least=10):
    seen, docs, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for t in terms:
            seen[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    kept = collections.defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least:
            kept[lang].append(t)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)

    def ps(lang, counts):
        v, total = len(kept[lang]), sum(counts)
        return [1 + 10**9 * (c + 2) // (total + 2 * v) for c in counts]

    for lang, source in groups:
        sources = [s for x, s in groups if x == lang]
        counts = {s: [seen[lang, s, t] for t in kept[lang]] for s in sources}
        p = {s: ps(lang, counts[s]) for s in sources}
        whole = ps(lang, [sum(counts[s][i] for s in sources) for i in range(len(kept[lang]))])
        pairs = [(-sum(map(f, p[source], p[s])), s.encode()) for s in sources if s != source]
        terms = [(-f(a, b), t.encode()) for t, n, a, b in zip(kept[lang], counts[source], p[source], whole, strict=True) if n and a > b]
        for part, found, most in (("pair", pairs, None), ("term", terms, k)):
            out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(8)
    out = []
    for i in range(400):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d", None, "a" if i % 3 else "é"])
        words = [rng.choice(["The", "the", "of", "ÉTÉ", "été", "x1y", "日本", f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(4))}"]) for _ in range(rng.randrange(40))]
        out.append((i, rng.choice([" ", ", ", "-"]).join(words), lang, source))
    out += [(900, None, "en", "silent"), (901, "", "de", "x"), (902, "rare words only", "de", "y"), (903, None, "it", "alone"), (904, "the " * 3000, "en", "b")]
    return out + [(905, "said twice", "en", "a")] * 12


def audited(rows):
    return sorted(tuple(r) for r in rows.select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit(spark, audit_rows):
    docs = documents(spark, audit_rows).repartition(3)
    want = brute_audit(audit_rows)
    assert audited(divergence.audit(docs)) == want and {"pair", "term"} == {r[2] for r in want}
    assert audited(divergence.audit(docs, k=2, least_docs=3)) == brute_audit(audit_rows, 2, 3)
    assert divergence.audit(documents(spark, [])).count() == 0


def test_audit_in_small_blocks_slices_and_flushes(spark, audit_rows, monkeypatch):
    from larkspan.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    assert [t for part in divergence._slices(b"ab cd  e", 2) for t in part] == [b"ab", b"cd", b"e"]
    assert audited(divergence.audit(documents(spark, audit_rows), sizes=divergence.Sizes(50, 2, 20, 3))) == brute_audit(audit_rows)


def test_audit_opens_few_buckets(spark, audit_rows):
    docs = documents(spark, [(i, " ".join(f"{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300) if i % (1 + j % 40) == 0 or i < 12), "en", "abc"[i % 3]) for i in range(120)])
    kept = divergence.postings(docs, 10, "lang", "source", "text")
    groups = divergence.groups_of(docs, kept, "lang", "source")
    got = divergence.most_divergent_terms(kept, groups, 10)
    assert got.count() == 30


def test_new_queries_against_sql_with_hot_rows(spark, tmp_path, run_rows, audit_rows):
    """A third of all rows are copies of one row; sources, texts and ids hold nulls."""
    rows = run_rows + audit_rows
    rows += [(5000 + i, "one two three " * 5, "en", "hot") for i in range(len(rows) // 2)]
    spark.createDataFrame([(*r, None) for r in rows if r[0] is not None], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op11_periodic_runs", "op13_source_divergence"):
        got = registry.queries()[name](spark, str(tmp_path)).toPandas()
        want = con.execute(registry.oracle_sql()[name]).df()[list(got.columns)]
        plain = lambda frame: sorted(map(str, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))
        assert [re.sub(r"\.0\b", "", x) for x in plain(got)] == [re.sub(r"\.0\b", "", x) for x in plain(want)]


def test_contract_of_sha_columns(spark, run_rows):
    one = periodic_runs.find_runs(documents(spark, [(1, None, None, None), (2, "a b " * 4, None, None)])).select("doc_id", periodic_runs.digest(F.col("runs")).alias("d"), periodic_runs.strongest(F.col("runs")).alias("b")).collect()
    got = {r.doc_id: (r.d, r.b and tuple(r.b)) for r in one}
    assert got == {1: (hashlib.sha256(b"").hexdigest(), None), 2: (hashlib.sha256(b"0,8,2\n").hexdigest(), (0, 8, 2))}
