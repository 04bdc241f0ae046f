"""Mixing sources to target weights by pivotal dependent rounding, in SQL only.

Sources in code point order (null last) weigh 5, 2, 1, repeating.  They share
``volume`` times the words of all documents; a target stops at ``cap`` times its
source's words and the excess is shared anew by weight (water filling).  Every
document of a source then deserves target / source_size copies: the whole part
is certain, the rest is a probability.

The probabilities are rounded by the weighted pivotal method: of two documents
with probable words m_i of s_i and m_j of s_j, words move from one to the other
until one document is all in or all out; which way is drawn so that nobody's
expectation changes.  As words only move, a source's total stays where it was
until the last document.  The method runs as a reduction tree: a few dozen
documents of a source (a bucket of their hashes) are folded into decisions and
one residual; the residuals are folded again, until each source has one, which
is drawn.  So each source ends within one document of its target.  Draws are
hashes of the two ids and the seed: reruns agree, whatever the partitioning.

Sizes count runs of characters other than ASCII white space; null and empty
texts have size 0 and take no words (they get the whole part of the ratio as
copies).  Repeated rows (same doc_id, source and size) are rounded as one
mass; the first of them get the extra copies.  Without words in a source its
target is 0.  Other columns are not read by `mix`; `resample` keeps all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.llm.graph import staged

WEIGHTS = (5, 2, 1)
VOLUME, CAP = 1.5, 2.0
FAN_IN = 64                # documents folded in one node of the tree, on average
SALTS = 32                 # a source's rows are joined to its totals in so many parts
SEED = 20240611
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, volume: float = VOLUME, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    With sources by growing cap / weight, those before the first one that stays
    below its cap are at their caps, and the rest share what remains by weight.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = total.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("double")
    w = Window.orderBy(F.col("most") / F.col("weight"), "at")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    level = (volume * F.sum("source_size").over(all_) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / (
        F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    return (ordered.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
            .withColumn("level", level)
            .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "at", "level"))).over(all_)["level"])
            .select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target")))


#: Folds the bucket's items (key, id, s = words, m = probable words) pairwise:
#: ``cur`` is the one document still undecided, ``done`` the decided ones.
_FOLD = """
aggregate(
  array_sort(collect_list(struct(key, s, m))),
  named_struct('done', cast(array() AS array<struct<key:struct<doc_id:bigint,size:bigint>,hit:boolean>>),
               'cur', cast(null AS struct<key:struct<doc_id:bigint,size:bigint>,s:double,m:double>)),
  (acc, y) -> CASE
    WHEN acc.cur IS NULL THEN named_struct('done', acc.done, 'cur', y)
    ELSE element_at(transform(array(named_struct(
        'i', acc.cur, 'j', y, 'up', least(acc.cur.s - acc.cur.m, y.m), 'dn', least(acc.cur.m, y.s - y.m),
        'u', shiftrightunsigned(xxhash64({seed}, acc.cur.key, y.key), 11) * 1.1102230246251565E-16D)),
      t -> CASE
        WHEN t.u * (t.up + t.dn) < t.dn THEN
          IF(t.i.s - t.i.m <= t.j.m,
             named_struct('done', concat(acc.done, array(named_struct('key', t.i.key, 'hit', true))),
                          'cur', named_struct('key', t.j.key, 's', t.j.s, 'm', t.j.m - t.up)),
             named_struct('done', concat(acc.done, array(named_struct('key', t.j.key, 'hit', false))),
                          'cur', named_struct('key', t.i.key, 's', t.i.s, 'm', t.i.m + t.up)))
        ELSE
          IF(t.i.m <= t.j.s - t.j.m,
             named_struct('done', concat(acc.done, array(named_struct('key', t.i.key, 'hit', false))),
                          'cur', named_struct('key', t.j.key, 's', t.j.s, 'm', t.j.m + t.dn)),
             named_struct('done', concat(acc.done, array(named_struct('key', t.j.key, 'hit', true))),
                          'cur', named_struct('key', t.i.key, 's', t.i.s, 'm', t.i.m - t.dn)))
      END), 1)
  END)"""


def _rounded(items: DataFrame, most: int) -> DataFrame:
    """(source, key, hit) for items (source, n, key, s, m); ``most``: the largest n."""
    decided, level, reach = [], items, 1
    while True:
        last = reach * FAN_IN >= most
        reach *= FAN_IN
        bucket = F.pmod(F.xxhash64(F.lit(SEED + reach), "key"), F.greatest(F.lit(1), F.ceil(F.col("n") / reach)).cast("long"))
        folded = staged(level.withColumn("bucket", bucket).groupBy("source", "bucket")
                        .agg(F.first("n").alias("n"), F.expr(_FOLD.format(seed=SEED + reach)).alias("f")), "mixing")
        decided.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.key", "d.hit"))
        level = folded.select("source", "n", "f.cur.*")
        if last:
            break
    draw = F.expr(f"shiftrightunsigned(xxhash64({SEED}, key), 11) * 1.1102230246251565E-16D * s < m")
    return reduce(DataFrame.unionByName, [*decided, level.select("source", "key", draw.alias("hit"))])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, volume: float = VOLUME, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies of every row."""
    base = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                              word_count(F.col("text").cast("string")).alias("size"))
                  .groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")), "sizes")
    per = targets(base.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, volume, cap)
    per = per.join(base.filter("size > 0").groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n")),
                   F.col("of").eqNullSafe(F.col("source")), "left").drop("of")
    per = staged(per.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    salted = per.withColumnRenamed("source", "of").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    row = (base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
           .join(salted, F.col("of").eqNullSafe(F.col("source")) & (F.col("salt") == F.col("part"))).drop("of", "salt", "part"))
    row = (row.withColumn("whole", F.floor("ratio")).withColumn("share", F.col("rows") * (F.col("ratio") - F.col("whole")))
           .withColumn("sure", F.floor(F.col("share") + 1e-9))
           .withColumn("p", F.greatest(F.lit(0.0), F.col("share") - F.col("sure")))
           .withColumn("key", F.struct("doc_id", "size")))
    row = staged(row.select("source", "key", "rows", "source_size", "target", "n", "whole", "sure", "p"), "shares")
    open_ = row.filter("key.size > 0 AND p > 1e-9")
    most = open_.agg(F.max("n")).first()[0] or 0
    hits = _rounded(open_.select("source", "n", "key", F.col("key.size").cast("double").alias("s"), (F.col("key.size") * F.col("p")).alias("m")), most) \
        if most else open_.select("source", "key", F.lit(False).alias("hit"))
    hits = hits.select(F.col("source").alias("of"), F.col("key").alias("k"), "hit")
    out = row.join(hits, (F.col("k") == F.col("key")) & F.col("of").eqNullSafe(F.col("source")), "left")
    extra = F.col("sure") + F.coalesce(F.col("hit"), F.lit(False)).cast("int")
    each = out.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return (each.withColumn("copies", (F.col("whole") + (F.col("i") <= extra).cast("int")).cast("int"))
            .select(F.col("key.doc_id").alias("doc_id"), "source", F.col("key.size").alias("size"), "source_size", "target",
                    (F.col("key.size") * F.col("copies")).cast("long").alias("taken"), "copies"))


def resample(docs: DataFrame) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as `mix` takes it, all
    columns unchanged.  Rows that repeat a doc_id, source and size are each taken
    as often as they are on average, rounded."""
    plan = mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"),
                       F.col("copies").alias("__copies"), F.col("rows").alias("__rows"))
    same = (F.col("__id").eqNullSafe(F.col("doc_id").cast("long")) & F.col("__source").eqNullSafe(F.col("source").cast("string"))
            & (F.col("__size") == word_count(F.col("text").cast("string"))))
    take = F.round(F.col("__copies") / F.col("__rows")).cast("int")
    return (docs.join(plan, same).withColumn("__take", take).filter("__take > 0")
            .withColumn("__take", F.explode(F.sequence(F.lit(1), F.col("__take")))).select(*docs.columns))
