"""Skew-safe ordered scans over keyed event streams.

A window ``PARTITION BY key ORDER BY seq`` puts every row of a key into one
task; a hot key (a third of all events) would then run in a single task.
These helpers scan in two levels instead.  Keys of many rows are cut into chunks
of about ``rows`` rows: a row is a chunk's first one if a hash of its key and
place in the order says so (one in ``rows``), so that chunks hold rows by number
whatever the order's values are, ties included.  Each (key, chunk) is scanned by a
window after one exchange; a chunk's last row carries what the window has of the
whole chunk, and a small table of those, scanned by key, is joined back.  Where no
key is long there are no chunks and the scan is the plain window.

The table is read twice: for the cuts (only key and order columns, one row in
``rows`` kept) and for the scan; the carry table comes from the same exchange.
Results equal the plain window; the largest task holds one chunk, not one key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from pagefold.session import cut_lineage

CHUNK_ROWS = 1 << 18       # rows of a chunk, on average
MOST_CHUNKS = 256          # chunks of one key; beyond that they grow
BROADCAST_CUTS = 1 << 18   # cuts (a key and an order value each) that are broadcast; beyond, Spark joins as it likes


def _names(then: str | None) -> list[str]:
    return [x.strip() for x in then.split(",")] if then else []


def _ob(order: str, then: str | None) -> str:
    return order if not then else f"{order}, {then}"


def _ok(order: str, then: str | None) -> str:
    """A single comparable value of (order, then)."""
    return f"named_struct('o', {order}" + "".join(f", 't{i}', {p}" for i, p in enumerate(_names(then))) + ")"


def sample(df: DataFrame, columns: list[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """One row in ``rows`` of ``columns``, chosen by their hash and written to the
    shared folder: the cuts of any scan whose keys and order are among them."""
    return cut_lineage(df.select(*columns).where(f"pmod(xxhash64({', '.join(columns)}), {int(rows)}) = 0"))


def _same(left: DataFrame, right: DataFrame, names: list[str]):
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[f"_k_{n}"])
    return cond


@dataclass(frozen=True)
class Chunks:
    """Rows placed by (key, chunk); `scan` adds columns and keeps the placement."""

    df: DataFrame
    keys: list[str]
    order: str
    then: str | None
    columns: list[str]
    split: bool            # whether any key has several chunks
    small: bool            # whether the carry table is small enough to be broadcast

    def rows(self) -> DataFrame:
        return self.df.select(*self.columns)

    def scan(self, specs: list[tuple[str, str, str]]) -> Chunks:
        """``specs``: ``(op, expr, out)`` with ``op`` one of ``sum`` (inclusive
        running sum), ``min`` (inclusive running minimum), ``min_before``,
        ``first`` (first non-null at or before the row), ``last`` (last non-null at or
        before it), ``last_before`` (last non-null before it), ``prev`` / ``next``
        (value of the previous / next row)."""
        chunk = ["_chunk"] if self.split else []
        part = ", ".join([*self.keys, *chunk])
        wk = f"(PARTITION BY {part} ORDER BY {_ob(self.order, self.then)}"
        run = f"{wk} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        upto = f"{wk} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        wc = f"(PARTITION BY {', '.join(f'_k_{k}' for k in self.keys)} ORDER BY _k__chunk"
        before = f"{wc} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        within, whole, carries, outs = [], [], [], []
        for i, (op, expr, out) in enumerate(specs):
            w, a, c = f"_w{i}", f"_a{i}", f"_c{i}"
            if op == "sum":
                this, all_, carry, final = f"coalesce(sum({expr}) OVER {run}, 0)", None, f"coalesce(sum({a}) OVER {before}, 0)", f"{w} + coalesce({c}, 0)"
            elif op in ("min", "min_before"):
                this, all_ = f"min({expr}) OVER {run if op == 'min' else upto}", f"min({expr}) OVER {run}"
                carry, final = f"min({a}) OVER {before}", f"least({w}, {c})"
            elif op == "first":
                this, all_, carry, final = f"first({expr}, true) OVER {run}", None, f"first({a}, true) OVER {before}", f"coalesce({c}, {w})"
            elif op in ("last", "last_before"):
                this, all_ = f"last({expr}, true) OVER {run if op == 'last' else upto}", f"last({expr}, true) OVER {run}"
                carry, final = f"last({a}, true) OVER {before}", f"coalesce({w}, {c})"
            elif op == "prev":
                this, all_ = f"lag(named_struct('v', {expr})) OVER {wk})", f"named_struct('v', {expr})"
                carry, final = f"lag({a}) OVER {wc})", f"coalesce({w}, {c}).v"
            elif op == "next":
                this, all_ = f"lead(named_struct('v', {expr})) OVER {wk})", f"first(named_struct('v', {expr})) OVER {run}"
                carry, final = f"lead({a}) OVER {wc})", f"coalesce({w}, {c}).v"
            else:
                raise ValueError(op)
            within.append(f"{this} AS {w}")
            whole.append(f"{all_ or this} AS {a}")
            carries.append(f"{carry} AS {c}")
            outs.append(f"{final} AS {out}")
        helpers = [c for c in self.df.columns if c not in self.columns]
        columns = [*self.columns, *(out for _, _, out in specs)]
        if not self.split:
            alone = self.df.selectExpr("*", *within, *(f"NULL AS _c{i}" for i in range(len(specs))))
            return replace(self, df=alone.selectExpr(*self.df.columns, *outs), columns=columns)
        # Spark reuses an exchange only where both sides want the same columns of it: the carry side asks for all.
        alike = ", ".join(f"size(`{f.name}`)" if isinstance(f.dataType, MapType) else f"`{f.name}`" for f in self.df.schema.fields)
        ends = (self.df.selectExpr("*", *whole, f"lead(true) OVER {wk}) AS _more")
                .where(f"_split AND _more IS NULL AND (xxhash64({alike}) & 0) = 0")
                .selectExpr(*(f"{k} AS _k_{k}" for k in (*self.keys, "_chunk")), *(f"_a{i}" for i in range(len(specs))))
                .selectExpr(*(f"_k_{k}" for k in (*self.keys, "_chunk")), *carries))
        done = self.df.selectExpr("*", *within)
        joined = done.join(F.broadcast(ends) if self.small else ends, _same(done, ends, [*self.keys, "_chunk"]), "left")
        return replace(self, df=joined.selectExpr(*self.columns, *helpers, *outs), columns=columns)


def chunks(df: DataFrame, keys: list[str], order: str, then: str | None = None, rows: int = CHUNK_ROWS, sampled: DataFrame | None = None) -> Chunks:
    """``df`` placed for scans by ``keys`` in the order (``order``, ``then``).
    ``sampled`` may give the cuts (see `sample`); of nested keys, the same table
    serves all."""
    if sampled is None:
        sampled = sample(df, [*keys, order, *_names(then)], rows)
    at = _ok(order, then)
    every = f"CAST(ceil(size(_all) / {MOST_CHUNKS}) AS INT)"
    cuts = cut_lineage(sampled.selectExpr(*(f"{k} AS _k_{k}" for k in keys), f"{at} AS _at").groupBy(*(f"_k_{k}" for k in keys))
                       .agg(F.expr("sort_array(collect_list(_at)) AS _all")).where("size(_all) > 1")
                       .selectExpr(*(f"_k_{k}" for k in keys), f"filter(_all, (x, i) -> i % {every} = 0) AS _cuts"))
    n = cuts.agg(F.sum(F.size("_cuts"))).first()[0]
    if not n:
        return Chunks(df, keys, order, then, df.columns, False, True)
    small = n <= BROADCAST_CUTS
    placed = (df.join(F.broadcast(cuts) if small else cuts, _same(df, cuts, keys), "left")
              .selectExpr(*df.columns, f"CASE WHEN _cuts IS NULL THEN 0 ELSE size(filter(_cuts, x -> x <= {at})) END AS _chunk", "_cuts IS NOT NULL AS _split")
              .repartition(*keys, "_chunk"))
    return Chunks(placed, keys, order, then, df.columns, True, small)


def multi(df: DataFrame, keys: list[str], order: str, specs: list[tuple[str, str, str]],
          rows: int = CHUNK_ROWS, then: str | None = None, sampled: DataFrame | None = None) -> DataFrame:
    """Several ordered scans over the same key and order in one pass (`Chunks.scan`)."""
    return chunks(df, keys, order, then, rows, sampled).scan(specs).rows()


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                rows: int = CHUNK_ROWS, then: str | None = None) -> DataFrame:
    """``out`` = sum of ``value`` over rows of the key up to this one (by ``order``)."""
    return multi(df, keys, order, [("sum", value, out)], rows, then)


def last_non_null(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                  rows: int = CHUNK_ROWS, then: str | None = None) -> DataFrame:
    """``out`` = last non-null ``value`` of the key at or before this row."""
    return multi(df, keys, order, [("last", value, out)], rows, then)


def neighbor(df: DataFrame, keys: list[str], order: str, value: str, out: str, direction: str = "prev",
             rows: int = CHUNK_ROWS, then: str | None = None) -> DataFrame:
    """``out`` = ``value`` of the previous (``prev``) or next (``next``) row of the key."""
    return multi(df, keys, order, [(direction, value, out)], rows, then)


def running_sum_min(df: DataFrame, keys: list[str], order: str, value: str, out_sum: str, out_min: str,
                    rows: int = CHUNK_ROWS, out_min_before: str = "_min_before") -> DataFrame:
    """``out_sum`` = running sum S of ``value``, ``out_min`` = running minimum
    of S (both inclusive) and ``out_min_before`` = the minimum of S before the
    row (NULL for the first), per key, in one placement."""
    c = chunks(df, keys, order, None, rows).scan([("sum", value, out_sum)])
    return c.scan([("min", out_sum, out_min), ("min_before", out_sum, out_min_before)]).rows()
