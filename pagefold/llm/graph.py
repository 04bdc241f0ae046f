"""Tables staged in the shared folder, and connected components of link tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.session import checkpoint_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the cluster's shared checkpoint folder
    and read it back: later steps neither recompute it nor depend on the
    executors that made it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(spark: SparkSession, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links``
    (columns ``a``, ``b``).

    Each round gives every node the smallest label among its neighbours
    (a partial aggregate, so a hub with millions of links is combined map-side)
    and then jumps to its label's label, which makes chains shrink
    geometrically.  Labels are staged between rounds; the loop ends when no
    label changes.
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m")))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        top = labels.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        new = staged(step.join(top, "c", "left").select("node", "was", F.least("c", "cc").alias("component")), "labels")
        if new.filter("was <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def across(member: DataFrame, comp: DataFrame, payload: DataFrame, compare: Callable[[pa.Table], pa.Table], block: int) -> DataFrame:
    """(a, b) that link different components inside the buckets of ``member``
    (columns ``key``, ``id``), after a first round has linked each bucket's
    members to one of them.

    For a bucket of several components, ``main`` is its largest.  Buckets of the
    same main component are finished together: their outsiders meet all their
    members, in pairs of blocks of about ``block`` ids, dealt by hash, so that no
    task holds a whole bucket and no pair becomes a row.  ``compare`` gets a
    table (main, id, component, i, j, outside, and the columns of ``payload``)
    and returns the links it finds between rows outside and the others.
    """
    member = staged(member.join(comp, F.col("id") == F.col("node"), "left")
                    .select("key", "id", F.coalesce("component", "id").alias("component")), "members")
    sizes = member.groupBy("key", "component").agg(F.count("*").alias("n"))
    split = (sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("m"))
             .filter("parts > 1 AND all > 2")                   # a bucket of two had its only pair confirmed or refused
             .select("key", F.col("m.component").alias("main")))
    mixed = staged(member.join(split, "key").select("main", "id", "component").distinct(), "mixed")
    count = (mixed.groupBy("main").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"),
                                       F.ceil(F.count_if(F.col("component") != F.col("main")) / block).cast("int").alias("outer"))
             .filter("outer > 0"))
    each = staged(mixed.join(count, "main").join(payload, "id"), "mixed")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["main", "id", "component", *(c for c in payload.columns if c != "id")]
    outer = each.filter("component <> main").select(*cols, own("outer").alias("i"), every("blocks").alias("j"), F.lit(True).alias("outside"))
    inner = each.select(*cols, every("outer").alias("i"), own("blocks").alias("j"), F.lit(False).alias("outside"))
    return (outer.unionByName(inner).groupBy("main", "i", "j").applyInArrow(compare, "a long, b long")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
