"""An ordered scan whose state is a stack: the open stages of a fetch.

Events (fetch_id, stage, seq, ts_ms, event, error_code) come in order; ``begin``
opens its stage, ``end`` closes the latest open begin of its stage wherever that
lies in the stack.  A begin is *nested* if the top of the stack, the latest begin
still open, has the same name; nested begins have no span, but their ends are
theirs.

A fetch of many events is cut into chunks (`scan.chunks`).  A chunk reduces to the
ends that found no begin in it, counted by stage, and the begins still open at its
end: a summary of that form again for any run of chunks, so summaries compose.
A begin's top lies in its own chunk unless none is open there, which holds for at
most one begin that stays open; it is settled when the chunk's entry is known.
Summaries are composed in order for each fetch, which tells every chunk the open
begins it can touch (of each stage as many as it closes, and one more); then every
chunk is replayed in its own task.  Fetches of one chunk are replayed at once.

Rows without fetch_id or stage and rows of other events are left out; equal ``seq``
values come in the order begin, end, then by stage and time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.operators import scan

#: (seq, ts_ms, stage, nested); nested is None until the chunk's entry is known
Begin = tuple[int, int, str, bool | None]
_SPANS = "fetch_id long, stage string, start_ms long, end_ms long, error_code string"
_OUT = 4096
_BEGIN_TYPE = "array<struct<seq:bigint,ts:bigint,stage:string,nested:boolean>>"
_BEGINS_ARROW = pa.list_(pa.struct([("seq", pa.int64()), ("ts", pa.int64()), ("stage", pa.string()), ("nested", pa.bool_())]))


class Stack:
    """Open begins in order, with the latest of each stage."""

    def __init__(self, begins: list[Begin] = ()):
        self.order: dict[int, Begin] = {}                    # by number, the latest last
        self.by_stage: dict[str, list[int]] = {}
        self.number = 0
        for b in begins:
            self.push(b)

    def push(self, begin: Begin) -> None:
        self.number += 1
        self.order[self.number] = begin
        self.by_stage.setdefault(begin[2], []).append(self.number)

    def pop(self, stage: str) -> Begin | None:
        numbers = self.by_stage.get(stage)
        return self.order.pop(numbers.pop()) if numbers else None

    def top(self) -> str | None:
        return self.order[next(reversed(self.order))][2] if self.order else None

    def begins(self) -> list[Begin]:
        return list(self.order.values())


class Summary:
    """A chunk: ``ends`` it needs from before, ``open`` begins it leaves, and, for
    the one begin whose top lies before the chunk, the ends that came ahead of it."""

    def __init__(self):
        self.ends: Counter[str] = Counter()
        self.open = Stack()
        self.ahead: dict[str, int] | None = None

    def add(self, stage: str, event: str, seq: int, ts: int) -> None:
        if event == "begin":
            top = self.open.top()
            if top is None:
                self.ahead = dict(self.ends)
            self.open.push((seq, ts, stage, None if top is None else top == stage))
        elif self.open.pop(stage) is None:
            self.ends[stage] += 1


def compose(stack: Stack, ends: dict[str, int], begins: list[Begin], ahead: dict[str, int]) -> None:
    """The stack after a chunk, from the stack before it and the chunk's summary."""
    def close(counts: dict[str, int]) -> None:
        for stage, n in counts.items():
            for _ in range(n):
                stack.pop(stage)

    # All these ends reach below the chunk's begins, so they are closed before any of those is pushed.
    if begins and begins[0][3] is None:
        close(ahead)
        begins = [(*begins[0][:3], stack.top() == begins[0][2]), *begins[1:]]
        ends = Counter(ends) - Counter(ahead)
    close(ends)
    for begin in begins:
        stack.push(begin)


def touched(stack: Stack, ends: dict[str, int]) -> list[Begin]:
    """The begins a chunk can close, and the one beneath them in each stage."""
    numbers = [x for stage, have in stack.by_stage.items() for x in have[-(ends.get(stage, 0) + 1):]]
    return [stack.order[x] for x in sorted(numbers)]


def _flat(counts: dict[str, int]) -> list[tuple[str, int]]:
    return sorted((k, v) for k, v in counts.items() if v)


_COUNTS = pa.list_(pa.struct([("stage", pa.string()), ("n", pa.int64())]))
_SUMMARY_ARROW = pa.schema([("fetch_id", pa.int64()), ("chunk", pa.int32()), ("ends", _COUNTS), ("begins", _BEGINS_ARROW), ("ahead", _COUNTS)])
_COUNTS_TYPE = "array<struct<stage:string,n:bigint>>"
_SUMMARY = f"fetch_id long, chunk int, ends {_COUNTS_TYPE}, begins {_BEGIN_TYPE}, ahead {_COUNTS_TYPE}"
_ENTRY_ARROW = pa.schema([("fetch_id", pa.int64()), ("chunk", pa.int32()), ("begins", _BEGINS_ARROW)])
_ENTRY = f"fetch_id long, chunk int, begins {_BEGIN_TYPE}"
_SPANS_ARROW = pa.schema([("fetch_id", pa.int64()), ("stage", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("error_code", pa.string())])


def _batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    dicts = {f.name: [f.type.value_type.field(k).name for k in range(f.type.value_type.num_fields)] for f in schema if pa.types.is_list(f.type)}
    cols = [[[dict(zip(dicts[f.name], x)) for x in v] for v in c] if f.name in dicts else c for f, c in zip(schema, zip(*out) if out else [()] * len(schema))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events by fetch, chunk and order -> one summary a chunk of the fetches that are split."""
    now, summary, out = None, None, []
    close = lambda: out.append((*now, _flat(summary.ends), summary.open.begins(), _flat(summary.ahead or {})))
    for batch in batches:
        for fetch, chunk, split, stage, seq, ts, event, _, _ in _rows(batch):
            if not split:
                continue
            if now != (fetch, chunk):
                if now is not None:
                    close()
                now, summary = (fetch, chunk), Summary()
            summary.add(stage, event, seq, ts)
        if len(out) >= _OUT:
            yield _batch(out, _SUMMARY_ARROW)
            out = []
    if now is not None:
        close()
    yield _batch(out, _SUMMARY_ARROW)


def _tuples(begins: list[dict]) -> list[Begin]:
    return [(b["seq"], b["ts"], b["stage"], b["nested"]) for b in begins]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries by fetch and chunk -> the begins each chunk is entered with; a
    last row without chunk holds those that stay open."""
    now, stack, out = None, Stack(), []
    for batch in batches:
        for fetch, chunk, ends, begins, ahead in _rows(batch):
            if now != fetch:
                if now is not None:
                    out.append((now, None, stack.begins()))
                now, stack = fetch, Stack()
            ends = {e["stage"]: e["n"] for e in ends}
            out.append((fetch, chunk, touched(stack, ends)))
            compose(stack, ends, _tuples(begins), {e["stage"]: e["n"] for e in ahead})
            if len(out) >= _OUT:
                yield _batch(out, _ENTRY_ARROW)
                out = []
    if now is not None:
        out.append((now, None, stack.begins()))
    yield _batch(out, _ENTRY_ARROW)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events by fetch, chunk and order, a chunk's entry first -> spans."""
    now, stack, split, out = None, Stack(), False, []

    def close() -> None:
        if not split:                                        # of split fetches, the composition knows what stays open
            out.extend((now[0], b[2], b[1], None, None) for b in stack.begins() if not b[3])

    for batch in batches:
        for fetch, chunk, in_parts, stage, seq, ts, event, code, entry in _rows(batch):
            if now != (fetch, chunk):
                close()
                now, stack, split = (fetch, chunk), Stack(), in_parts
            if event is None:
                stack = Stack(_tuples(entry))
            elif event == "begin":
                stack.push((seq, ts, stage, stack.top() == stage))
            else:
                begin = stack.pop(stage)
                if begin is not None and not begin[3]:
                    out.append((fetch, stage, begin[1], ts, code))
            if len(out) >= _OUT:
                yield _batch(out, _SPANS_ARROW)
                out = []
    close()
    yield _batch(out, _SPANS_ARROW)


def replayed(stage_events: DataFrame, rows: int = scan.CHUNK_ROWS) -> DataFrame:
    """fetch_id, stage, start_ms, end_ms, error_code of every span; end_ms is null
    for those still open."""
    e = (stage_events.where("fetch_id IS NOT NULL AND stage IS NOT NULL AND event IN ('begin', 'end')")
         .selectExpr("CAST(fetch_id AS BIGINT) AS fetch_id", "CAST(stage AS STRING) AS stage", "CAST(seq AS BIGINT) AS seq", "CAST(ts_ms AS BIGINT) AS ts_ms",
                     "event", "CAST(error_code AS STRING) AS error_code"))
    c = scan.chunks(e, ["fetch_id"], "seq", "event, stage, ts_ms", rows)
    chunk = ["_chunk", "_split"] if c.split else ["0 AS _chunk", "false AS _split"]
    cols = ["fetch_id", "_chunk", "_split", "stage", "seq", "ts_ms", "event", "error_code", "entry"]
    placed = c.df.selectExpr("*", f"CAST(NULL AS {_BEGIN_TYPE}) AS entry").selectExpr("fetch_id", *chunk, *cols[3:])
    order = ["fetch_id", "_chunk", F.asc_nulls_first("seq"), "event", "stage", "ts_ms"]
    if not c.split:
        return placed.repartition("fetch_id").sortWithinPartitions(*order).mapInArrow(_replay, _SPANS)
    entries = (placed.sortWithinPartitions(*order).mapInArrow(_summaries, _SUMMARY)
               .repartition("fetch_id").sortWithinPartitions("fetch_id", "chunk").mapInArrow(_entries, _ENTRY))
    nothing = [f"CAST(NULL AS {t}) AS {n}" for n, t in (("stage", "STRING"), ("seq", "BIGINT"), ("ts_ms", "BIGINT"), ("event", "STRING"), ("error_code", "STRING"))]
    first = entries.where("chunk IS NOT NULL").selectExpr("fetch_id", "chunk AS _chunk", "true AS _split", *nothing, "begins AS entry")
    spans = placed.unionByName(first).repartition("fetch_id", "_chunk").sortWithinPartitions(*order).mapInArrow(_replay, _SPANS)
    still = (entries.where("chunk IS NULL").selectExpr("fetch_id", "explode(begins) AS b").where("NOT b.nested")
             .selectExpr("fetch_id", "b.stage AS stage", "b.ts AS start_ms", "CAST(NULL AS BIGINT) AS end_ms", "CAST(NULL AS STRING) AS error_code"))
    return spans.unionByName(still)
