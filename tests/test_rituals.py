"""Ritual series against a plain scan over all earlier series."""

import datetime
import re

from larkspan.operators import rituals


def test_series_equal_a_plain_scan(spark):
    start = datetime.datetime(2026, 1, 1)
    titles = ["Weekly Jazz #1", "Weekly Jazz #2", "weekly  jazz night", "Jazz", "Ja", "Ja", "Chess - 3", "Chess", "", None]
    rows = [(i, titles[i * 7 % 10], ["Hall", "Cafe", "", None][i * 3 % 4 if i % 5 else 0], start + datetime.timedelta(days=i * 5 % 60, hours=i % 3), [None, "TBD", "20:00", "9:30", "22:15", "23:00"][i % 6]) for i in range(300)]
    got = {r.event_id: r.series for r in rituals.series(spark.createDataFrame(rows, "event_id long, title string, venue_name string, event_date timestamp, event_time string")).collect()}

    norm = lambda t: re.sub(r"\s+", " ", (t or "").lower().strip())
    bare = lambda t: re.sub(r"\s*[#\-–]\s*\d+\s*$", "", norm(t))
    alike = lambda a, b: a == b or (len(a) > 3 and len(b) > 3 and (a in b or b in a))
    series: dict = {}
    want = {}
    for i, title, venue, date, time in sorted(rows, key=lambda r: (r[3], r[0])):
        hour = int(m[1]) if (m := re.match(r"(\d{1,2}):?", time or "")) else None
        want[i] = i
        if norm(venue) and hour is not None:
            held = series.setdefault((norm(venue), date.weekday()), [])
            want[i] = next((first for t, h, first in held if abs(h - hour) <= 2 and alike(t, bare(title))), i)
            if want[i] == i:
                held.append((bare(title), hour, i))
    assert got == want and len(set(want.values())) < len(rows)


def test_machines_pass_histories_in_batches(spark):
    """A history of several batches gives what one batch gives."""
    from pyspark.sql import functions as F

    from larkspan.streaming import machines

    q = spark.range(3000).select(F.col("id").alias("item_id"), (F.col("id") % 3 * (F.col("id") % 2)).alias("source_id"), (F.col("id") * 37 % 2999).alias("ats"), (F.col("id") % 5 < 3).alias("failed"), F.lit("indexed").alias("stage"), (F.col("id") % 100).cast("double").alias("value"))
    whole = sorted(map(tuple, machines.replay(q, "breaker").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        assert sorted(map(tuple, machines.replay(q, "breaker").collect())) == whole and len(whole) == 3000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_venue_folds_titles_and_not_events(spark):
    """Many events of few titles at one venue, and many titles that hold each other, against the plain rule."""
    import random

    rng = random.Random(12)
    start = datetime.datetime(2026, 1, 5)
    parts = ["open", "mic", "jazz", "late", "night", "club", "abc", "ab"]
    titles = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    rows = [(i, rng.choice(titles), "Hall", start + datetime.timedelta(days=7 * rng.randrange(30)), f"{rng.randrange(8, 24)}:00") for i in range(3000)]
    got = {r.event_id: r.series for r in rituals.series(spark.createDataFrame(rows, "event_id long, title string, venue_name string, event_date timestamp, event_time string").repartition(3)).collect()}
    firsts, want = [], {}
    for i, title, _, _, time in sorted(rows, key=lambda r: (r[3], r[0])):
        hour = int(time.split(":")[0])
        fit = next((j for t, h, j in firsts if abs(h - hour) <= 2 and (t == title or (len(t) > 3 and len(title) > 3 and (t in title or title in t)))), None)
        if fit is None:
            firsts.append((title, hour, i))
        want[i] = i if fit is None else fit
    assert got == want and 10 < len(set(want.values())) < 300
