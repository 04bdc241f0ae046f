"""Chunked (skew-safe) scans equal plain per-key windows."""

import random

from pagefold.operators import scan


def test_chunked_scans_match_windows(spark):
    rnd = random.Random(7)
    rows = []
    for seq in range(400):
        key = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", "c"])
        v = rnd.choice([None, 1, -1, 2])
        rows.append((key, seq * 3 + rnd.randint(0, 2), v))
    df = spark.createDataFrame(rows, "k string, seq long, v int")
    w = "(PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ref = {(r.k, r.seq): r for r in df.selectExpr(
        "k", "seq", f"coalesce(sum(v) OVER {w}, 0) AS s", f"last(v, true) OVER {w} AS l",
        "lag(v) OVER (PARTITION BY k ORDER BY seq) AS p", "lead(v) OVER (PARTITION BY k ORDER BY seq) AS n",
        f"min(sum(coalesce(v, 0)) OVER {w}) OVER {w} AS m").collect()}
    rows = 17
    got_s = {(r.k, r.seq): r.s for r in scan.running_sum(df, ["k"], "seq", "coalesce(v, 0)", "s", rows).collect()}
    got_l = {(r.k, r.seq): r.l for r in scan.last_non_null(df, ["k"], "seq", "v", "l", rows).collect()}
    got_p = {(r.k, r.seq): r.p for r in scan.neighbor(df, ["k"], "seq", "v", "p", "prev", rows).collect()}
    got_n = {(r.k, r.seq): r.n for r in scan.neighbor(df, ["k"], "seq", "v", "n", "next", rows).collect()}
    got_m = {(r.k, r.seq): r.m for r in scan.running_sum_min(df, ["k"], "seq", "coalesce(v, 0)", "s", "m", rows).collect()}
    w1 = w.replace("CURRENT ROW", "1 PRECEDING")
    before = {(r.k, r.seq): (r.l, r.m) for r in df.selectExpr("*", f"sum(coalesce(v, 0)) OVER {w} AS s").selectExpr(
        "k", "seq", f"last(v, true) OVER {w1} AS l", f"min(s) OVER {w1} AS m").collect()}
    got_b = {(r.k, r.seq): r.b for r in scan.multi(df, ["k"], "seq", [("last_before", "v", "b")], rows).collect()}
    got_mb = {(r.k, r.seq): r._min_before for r in scan.running_sum_min(df, ["k"], "seq", "coalesce(v, 0)", "s", "m", rows).collect()}
    assert {k: (got_b[k], got_mb[k]) for k in before} == before
    for key, r in ref.items():
        assert got_s[key] == r.s and got_l[key] == r.l and got_p[key] == r.p and got_n[key] == r.n and got_m[key] == r.m, key


def test_a_hot_key_within_one_minute_is_split_by_rows(spark):
    df = spark.range(200_000).selectExpr("'hot' AS k", "id DIV 100000 AS ts_ms", "id AS seq", "id % 3 - 1 AS v")      # two values of the order
    c = scan.chunks(df, ["k"], "ts_ms", "seq", 5000)
    sizes = [r["count"] for r in c.df.groupBy("_chunk").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 50_000 and sum(sizes) == 200_000
    got = c.scan([("sum", "v", "s"), ("first", "v", "f"), ("min", "seq", "m")]).rows()
    w = "(PARTITION BY k ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ref = df.selectExpr("*", f"sum(v) OVER {w} AS s", f"first(v, true) OVER {w} AS f", f"min(seq) OVER {w} AS m")
    assert got.exceptAll(ref).isEmpty() and ref.exceptAll(got).isEmpty()


def test_null_keys_are_scanned_too(spark):
    df = spark.range(2000).selectExpr("CAST(NULL AS STRING) AS k", "id AS seq", "1 AS v")
    c = scan.chunks(df, ["k"], "seq", None, 100)
    assert c.split and c.scan([("sum", "v", "s")]).rows().where("s <> seq + 1").isEmpty()
