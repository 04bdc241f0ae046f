"""Frames in frames (T23): captured pages inside the pages that show them.

An *instance* is a page as it appears in a root page: the root itself, or the page
of a same-origin iframe of another instance.  Instances are found level by level,
by joining the last level with the iframes of its pages, until no level is left; a
page is not entered again inside itself.  An instance's path (the positions of the
iframes that lead to it) followed by a position orders everything a root shows,
so a frame's entries take their places where the iframe stands.

Links resolve against the root's URL, as its document does; the page of a nested
iframe is looked for relative to the page that holds it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.functions.url import resolve_url_sql
from pagefold.operators.content import inline_frames, page_entries
from pagefold.operators.html import page_partitions
from pagefold.session import cut_lineage

_LABEL = f"{resolve_url_sql('url', 'src_raw')}"


def frame_table(pages: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """The iframes of all pages (`inline_frames`), written once; those that
    ``entries`` hold, if given."""
    iframes = None if entries is None else entries.where("ekind = 'frame'").selectExpr("page_id", "CAST(ekey AS INT) AS pos", "inline(iframes)").selectExpr(
        "page_id", "pos", "url", "attrs", "'open' AS kind", "'iframe' AS tag", "true AS walked")
    return cut_lineage(inline_frames(pages, iframes))


@dataclass(frozen=True)
class Shown:
    """What the roots show: the entries of all pages and their iframes, each found
    once, and the levels of frame instances."""
    entries: DataFrame
    table: DataFrame
    levels: list[DataFrame]


def shown(pages: DataFrame, kinds: tuple[str, ...], extents: bool = False, title: str | None = None) -> Shown:
    entries = cut_lineage(page_entries(pages, (*kinds, *(k for k in ("frame",) if k not in kinds)), extents, title))
    table = frame_table(pages, entries)
    return Shown(entries.drop("iframes"), table, instances(pages, table))


def roots(pages: DataFrame) -> DataFrame:
    return pages.selectExpr("page_id", "url", "page_id AS source", "CAST(array() AS ARRAY<BIGINT>) AS path", "array(page_id) AS chain")


def held(level: DataFrame, frames: DataFrame) -> DataFrame:
    """The iframes of each instance of ``level``, with whether one is entered."""
    f = frames.selectExpr("page_id AS source", "CAST(iframe_pos AS BIGINT) AS iframe_pos", "src_raw", "same_origin", "inlined", "frame_page_id")
    return level.select("page_id", "url", "source", "path", "chain").join(f, "source").selectExpr(
        "page_id", "url", "concat(path, array(iframe_pos)) AS path", "chain", "src_raw", "same_origin", "frame_page_id AS source",
        "inlined AND NOT array_contains(chain, frame_page_id) AS entered")


def instances(pages: DataFrame, frames: DataFrame) -> list[DataFrame]:
    """The levels of frame instances: page_id and url of the root, source (the
    page shown), path, chain (the pages from the root on), src_raw."""
    levels, level = [], roots(pages)
    while True:
        level = cut_lineage(held(level, frames).where("entered")
                            .selectExpr("page_id", "url", "source", "path", "concat(chain, array(source)) AS chain", "src_raw"))
        if level.isEmpty():
            return levels
        levels.append(level)


def _all(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def spliced(pages: DataFrame, shown: Shown) -> DataFrame:
    """The entries of every root with those of its frames in place, each under a
    heading ``Frame: <src>`` of level 3. ``epos`` counts the root's entries in
    order; ``instance`` tells the frame ('' for the root). What all roots show
    is dealt out by root, to so many more partitions as it is larger than the pages."""
    entries, levels = shown.entries, shown.levels
    rest = [c for c in entries.columns if c not in ("page_id", "url")]
    own = entries.selectExpr("page_id", "url", *rest, "array(CAST(epos AS BIGINT)) AS _path", "'' AS instance")
    if levels:
        kids = _all(levels)
        inside = (entries.where("ekind <> 'page'").drop("url").withColumnRenamed("page_id", "source")
                  .join(kids.selectExpr("source", "page_id", "url", "path"), "source")
                  .selectExpr("page_id", "url", *rest, "concat(path, array(CAST(epos AS BIGINT))) AS _path", "array_join(path, '/') AS instance"))
        given = {"ekind": "'heading'", "ekey": "element_at(path, -1)", "epos": "element_at(path, -1)", "tag": "'h3'", "walked": "true", "listed": "true",
                 "in_nav": "0", "in_footer": "0", "text": f"concat('Frame: ', coalesce({_LABEL}, 'same-origin iframe'))"}
        types = {f.name: f.dataType.simpleString() for f in entries.schema.fields}
        heads = kids.selectExpr("page_id", "url", *(f"CAST({given.get(c, 'NULL')} AS {types[c]}) AS {c}" for c in rest), "path AS _path", "array_join(path, '/') AS instance")
        more = kids.count() / max(1, pages.count())
        own = own.unionByName(inside).unionByName(heads).repartition(math.ceil((1 + more) * page_partitions(pages)), "page_id")
    number = "CAST(row_number() OVER (PARTITION BY page_id ORDER BY _path, ekind) AS BIGINT) AS epos"
    return own.selectExpr("page_id", "url", *(number if c == "epos" else c for c in rest), "instance")


def frame_warnings(pages: DataFrame, frames: bool | Shown = False) -> DataFrame:
    """page_id, path, code, detail: iframes that are not shown, in page order:
    ``iframe_cross_origin``, or ``iframe_unavailable`` for a same-origin one whose
    page is not in the table (or, inside frames, is being shown already)."""
    if frames:
        table, levels = (frames.table, frames.levels) if isinstance(frames, Shown) else ((t := frame_table(pages)), instances(pages, t))
        f = held(_all([roots(pages), *(x.drop("src_raw") for x in levels)]), table).where("NOT entered")
        f = f.selectExpr("page_id", "path", "same_origin", f"{_LABEL} AS src")
    else:
        f = inline_frames(pages).where("NOT inlined").selectExpr("page_id", "array(CAST(iframe_pos AS BIGINT)) AS path", "same_origin", "src")
    return f.selectExpr(
        "page_id", "path", "CASE WHEN same_origin THEN 'iframe_unavailable' ELSE 'iframe_cross_origin' END AS code",
        "CASE WHEN same_origin THEN concat('iframe content unavailable: ', coalesce(src, '(no src)')) "
        "ELSE concat('cross-origin iframe not traversed: ', coalesce(src, '')) END AS detail")
