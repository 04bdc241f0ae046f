"""K-d tree sharding: near-equal bytes per shard, in DataFrame operations only.

Documents with equal texts form a group that stays together.  A group lies at
a point of the metadata space (log of its bytes, source, language; the latter
two by crc32, the smallest of the group's) and weighs its bytes.  A node of the
tree is split along the dimension in which it is widest, relative to the whole
corpus, at the weighted median, or at the share that its number of leaves asks
for, until a node is one leaf.

A split point is found by distributed histograms: bytes per bin of the
coordinate (a partial aggregate over all groups, one job for all nodes of a
level), then finer bins inside the one that holds the median.  Equal
coordinates are told apart by the text's hash, so a source with a third of all
rows can be cut anywhere.  Only node bounds (at most one row per shard) pass
through the driver; they are broadcast, as there are never more than shards.

Null texts count as empty (1 byte).  Null source, language or doc_id are
values like others.  A group larger than a shard's share makes its shard larger.
An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagefold.llm.graph import staged

BINS = 4096
FINE = 1e-4                # a bin of at most this share of a leaf ends the search
ROUNDS = 6
SLOT_ROWS = 2000           # rows numbered together, on average
DIMENSIONS = ("d_bytes", "d_source", "d_lang")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h", "text_crc32", "size").agg(
        (F.col("size") * F.count("*")).alias("w"), *(F.min(d).alias(d) for d in DIMENSIONS))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    code = lambda c: F.shiftright(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), 12).cast("long")
    size = F.octet_length(text).cast("long") + 1
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
                       F.floor(F.log2(size) * (1 << 15)).cast("long").alias("d_bytes"), code("source").alias("d_source"), code("lang").alias("d_lang"))


def _at(dim: str = "dim"):
    """The coordinate: the chosen dimension, then 32 bits of the text's hash."""
    d = F.element_at(F.array(*DIMENSIONS), F.col(dim))
    return d * F.lit(1 << 32) + F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))


def _split_points(spark: SparkSession, groups: DataFrame, nodes: list[dict]) -> list[dict]:
    """For each node (node, dim, lo, hi, need) the coordinate ``cut``: groups up
    to it weigh about ``need`` bytes."""
    open_, done = [n | {"base": 0} for n in nodes], []
    for step in range(ROUNDS):
        if not open_:
            break
        bounds = spark.createDataFrame([(n["node"], n["dim"], n["lo"], n["hi"], n["base"], float(n["need"])) for n in open_],
                                       "node int, dim int, lo long, hi long, base long, need double")
        v = (groups.join(F.broadcast(bounds), "node").withColumn("v", _at()).filter("v >= lo AND v <= hi")
             .withColumn("bin", F.floor((F.col("v") - F.col("lo")) / F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / BINS)))))
        bins = v.groupBy("node", "bin").agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                                            F.first("base").alias("base"), F.first("need").alias("need"))
        order = Window.partitionBy("node").orderBy("bin")
        upto = (bins.withColumn("sum", F.col("base") + F.sum("w").over(order)).withColumn("before", F.lag("hi").over(order))
                .filter("sum >= need").withColumn("n", F.row_number().over(order)).filter("n = 1"))
        found = {r["node"]: r for r in upto.collect()}           # one row per open node
        left = []
        for n in open_:
            r = found.get(n["node"])
            if r is None:                                        # rounding: everything is below
                done.append(n | {"cut": n["hi"]})
                continue
            below = r["sum"] - r["w"]
            before = n.get("before") if r["before"] is None else r["before"]
            if r["lo"] == r["hi"] or r["w"] <= n["fine"] or step == ROUNDS - 1:
                # cut on the nearer side of the bin, but leave groups on both sides
                nearer = n["need"] - below < r["sum"] - n["need"] and before is not None
                done.append(n | {"cut": before if nearer or (r["hi"] == n["top"] and before is not None) else r["hi"]})
            else:
                left.append(n | {"lo": r["lo"], "hi": r["hi"], "base": below, "before": before})
        open_ = left
    return done


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Give the number of ``shards``, or ``target_bytes`` of a leaf.  ``slot``
    numbers a shard's rows from 0, by buckets of their hashes.
    """
    spark = docs.sparkSession
    rows = staged(_rows(docs), "rows")
    groups = staged(_groups(rows).withColumn("node", F.lit(0)), "groups")
    leaves, spread = None, None
    while True:
        stats = groups.groupBy("node").agg(F.sum("w").alias("w"), *(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max)))).collect()
        if leaves is None:
            total = sum(r["w"] for r in stats)
            n = shards or max(1, math.ceil(total / (target_bytes or total or 1)))
            leaves = {0: n}
            spread = [max([1, *(r[f"max_{d}"] - r[f"min_{d}"] for r in stats)]) for d in DIMENSIONS]
        nodes = []
        for r in stats:
            k = leaves[r["node"]]
            if k < 2:
                continue
            wide = [(r[f"max_{d}"] - r[f"min_{d}"]) / s for d, s in zip(DIMENSIONS, spread)]
            at = max(range(len(DIMENSIONS)), key=lambda i: (wide[i], -i))
            d = DIMENSIONS[at]
            top = (r[f"max_{d}"] << 32) + 0xFFFFFFFF
            nodes.append({"node": r["node"], "dim": at + 1, "lo": r[f"min_{d}"] << 32, "hi": top, "top": top, "k": k,
                          "need": r["w"] * (k // 2) / k, "fine": FINE * r["w"] / k})
        if not nodes:
            break
        cuts = _split_points(spark, groups, nodes)
        for c in cuts:
            leaves[c["node"]], leaves[c["node"] + c["k"] // 2] = c["k"] // 2, c["k"] - c["k"] // 2
        table = spark.createDataFrame([(c["node"], c["dim"], c["cut"], c["k"] // 2) for c in cuts], "node int, dim int, cut long, step int")
        groups = staged(groups.join(F.broadcast(table), "node", "left")
                        .withColumn("node", F.when(F.col("cut").isNotNull() & (_at() > F.col("cut")), F.col("node") + F.col("step")).otherwise(F.col("node")))
                        .drop("dim", "cut", "step"), "groups")

    placed = rows.join(groups.select("h", "text_crc32", "size", F.col("node").alias("shard")), ["h", "text_crc32", "size"])
    n_rows = rows.count()
    parts = max(1, math.ceil(n_rows / len(leaves) / SLOT_ROWS))
    placed = placed.select("doc_id", "size", "text_crc32", "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)))
    placed = staged(placed, "placed")
    before = (placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("shard", "part", "before"))
    numbered = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")))
    return (numbered.join(before, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
