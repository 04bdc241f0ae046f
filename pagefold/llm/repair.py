"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

A lattice node is (rows read, state of the role pattern); an edge deletes, keeps
or reroles the next row, or inserts an empty turn.  A forward heap starts at the
beginning, a reverse heap at the accepting ends; when they have met, both go on
until no path as cheap can be unknown, so that every equal-cost crossing is
among the edges between the two settled sets.  Each settled node has the least
audit (letters of its edits) of its cheapest paths, and the least concatenation
over the crossings is the audit of the repair.

Repaired role initials follow ``(s?(ua)+)?``.  Costs: Keep 0, Rerole to user or
assistant 2, Delete 3 (required for blank and duplicate rows), Insert 2; a
truncated row that stays costs 1 more.  Equal costs: the ASCII-least audit.

Conversations are solved in pieces of ``PIECE`` rows: the cheapest way between any
two states at a piece's ends is found as above, and pieces are joined in order.

Rows are taken by turn (null first), then role and text; null roles and texts are
one space, an empty role has no initial and fits nowhere; a null conv_id is a
conversation of its own; repeated rows are duplicates; an empty table gives no
rows, a conversation without rows zeros, an empty audit and the empty text's hash.
Only conv_id, turn, role and text are read.  The audit holds a letter a row, so a
conversation's row codes and the digests of its rows lie in one task; its texts
only up to ``held_bytes``, beyond which they are read again in a second pass.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.graph import staged

PIECE = 512                # rows of a piece of a conversation
HELD_BYTES = 32 << 20      # bytes of a conversation's texts that a task keeps for the digest
OUT_ROWS = 2048

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state that a user or assistant turn leads to: only one of the two is possible anywhere.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAME = {USER: "user", ASSISTANT: "assistant"}
ACCEPTING = (START, ASSISTANT)
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)

_INK = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")

Row = tuple[str, int]      # (role initial, fault)
Label = tuple[int, str]    # (cost, audit)


def fault(role: str, text: str, seen: set[bytes]) -> int:
    """The row's first fault; ``seen`` has the digests of the earlier rows."""
    if not _INK.search(text):
        return BLANK
    key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
    if key in seen:
        return DUPLICATE
    seen.add(key)
    return FINE if _LAST.search(text).group(1) in ".!?" else TRUNCATED


class Lattice:
    """Nodes (i, state), 0 <= i <= rows, and their edges (node, cost, letter)."""

    def __init__(self, rows: list[Row]):
        self.rows = rows

    def after(self, i: int, state: int) -> Iterator[tuple[tuple[int, int], int, str]]:
        if i < len(self.rows):
            initial, kind = self.rows[i]
            yield (i + 1, state), DELETE_COST, "D"
            if kind < DUPLICATE:
                more = TRUNCATED_COST if kind == TRUNCATED else 0
                kept = KEEP.get((state, initial))
                if kept is not None:
                    yield (i + 1, kept), more, "K"
                yield (i + 1, NEXT[state]), REROLE_COST + more, "R"
        yield (i, NEXT[state]), INSERT_COST, "I"

    def back(self, i: int, state: int) -> Iterator[tuple[tuple[int, int], int, str]]:
        for j in (i - 1, i):
            if j >= 0:
                for s in range(4):
                    for node, cost, letter in self.after(j, s):
                        if node == (i, state):
                            yield (j, s), cost, letter

    def cheapest(self, source: int, targets: tuple[int, ...]) -> Label | None:
        """The cheapest way from (0, source) to the last row's end in one of
        ``targets``, with the least audit; None if there is none."""
        n = len(self.rows)
        if n == 0 and source in targets:
            return 0, ""
        ahead: dict[tuple[int, int], Label] = {(0, source): (0, "")}
        behind: dict[tuple[int, int], Label] = {(n, t): (0, "") for t in targets}
        # Free edges lead to the next row, so that nodes leave a heap after all that reach them at equal cost.
        go, come = [(0, 0, source)], []
        left: set[tuple[int, int]] = set()
        right: set[tuple[int, int]] = set()
        best = None

        def meet(cost: int, other: Label | None) -> None:
            nonlocal best
            if other is not None and (best is None or cost + other[0] < best):
                best = cost + other[0]

        def settle_right(here: tuple[int, int]) -> None:
            right.add(here)
            cost, audit = behind[here]
            for node, w, letter in self.back(*here):
                label, old = (cost + w, letter + audit), behind.get(node)
                if old is None or label < old:
                    behind[node] = label
                    if old is None or label[0] < old[0]:
                        heapq.heappush(come, (label[0], n - node[0], node[1]))
                meet(label[0], ahead.get(node))

        for t in targets:                                # a path settled from the left to its end crosses here
            settle_right((n, t))
        while go and come and (best is None or go[0][0] + come[0][0] <= best):
            if go[0][0] <= come[0][0]:
                cost, i, s = heapq.heappop(go)
                if (i, s) in left:
                    continue
                left.add((i, s))
                audit = ahead[i, s][1]
                for node, w, letter in self.after(i, s):
                    label, old = (cost + w, audit + letter), ahead.get(node)
                    if old is None or label < old:
                        ahead[node] = label
                        if old is None or label[0] < old[0]:
                            heapq.heappush(go, (label[0], *node))
                    meet(label[0], behind.get(node))
            else:
                _, j, s = heapq.heappop(come)
                if (n - j, s) not in right:
                    settle_right((n - j, s))
        if best is None:
            return None
        crossings = (ahead[u][1] + letter + behind[v][1] for u in left for v, w, letter in self.after(*u)
                     if v in right and ahead[u][0] + w + behind[v][0] == best)
        return best, min(crossings)


def solve(rows: list[Row], piece: int = PIECE) -> Label:
    """(cost, audit) of a conversation's repair."""
    ways: dict[int, Label] = {START: (0, "")}
    for lo in range(0, len(rows), piece):
        lattice = Lattice(rows[lo:lo + piece])
        last = lo + piece >= len(rows)
        new: dict[int, Label] = {}
        for source, (cost, audit) in ways.items():
            for targets in [ACCEPTING] if last else [(t,) for t in range(4)]:
                found = lattice.cheapest(source, targets)
                if found is not None:
                    label = (cost + found[0], audit + found[1])
                    if targets[0] not in new or label < new[targets[0]]:
                        new[targets[0]] = label
        ways = new
    return ways[ACCEPTING[0]]


class Repaired:
    """The repaired turns of a conversation, told by its audit, as (role, text)."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield NAME[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEEP[self.state, role[0]]
            yield role, text
        elif letter == "R":
            self.state = NEXT[self.state]
            yield NAME[self.state], text


class _Digest:
    """SHA-256 of the turns ``role:text``, joined by newlines."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, turns: Iterator[tuple[str, str]]) -> None:
        for role, text in turns:
            self.sha.update((("\n" if self.some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.some = True


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage told by crc32 of ``conv_id:turn``;
    a dropped row stays as one of null role and text."""
    base = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    kind = "crc32(CAST(concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' ')) AS BINARY)) % 20"
    return (base.withColumn("kind", F.expr(kind))
            .selectExpr("conv_id", "turn",
                        "CASE WHEN kind = 0 THEN NULL WHEN kind = 4 THEN 'user' ELSE role END AS role",
                        "CASE kind WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '') ELSE text END AS text",
                        "explode(CASE WHEN kind = 3 THEN array(1, 2) ELSE array(1) END) AS copy").drop("copy"))


_RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    def __init__(self, conv_id: int | None, held_bytes: int):
        self.conv_id, self.room = conv_id, held_bytes
        self.rows: list[Row] = []
        self.seen: set[bytes] = set()
        self.kept: list[tuple[str, str]] = []
        self.low = self.high = self.last = None
        self.turns, self.illegal = 0, 0

    def add(self, turn: int | None, role: str | None, text: str | None) -> None:
        if role is None:
            return
        if turn is not None:
            self.turns += turn != self.last              # rows come by turn
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
        initial = role[:1]
        if self.rows:
            self.illegal += self.rows[-1][0] + initial not in _LEGAL
        self.rows.append((initial, fault(role, text, self.seen)))
        self.room -= len(role) + len(text) + 100
        if self.room >= 0:
            self.kept.append((role, text))
        else:
            self.kept.clear()

    def result(self) -> tuple:
        cost, audit = solve(self.rows)
        sha = None
        if self.room >= 0:
            digest, repaired = _Digest(), Repaired(audit)
            for row in self.kept:
                digest.add(repaired.row(*row))
            digest.add(repaired.inserted())
            sha = digest.sha.hexdigest()
        faults = [kind for _, kind in self.rows]
        return (self.conv_id, self.high - self.low + 1 - self.turns if self.turns else 0, faults.count(BLANK), faults.count(DUPLICATE),
                faults.count(TRUNCATED), self.illegal, cost, audit, sha)


def _rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)


_RESULT_ARROW = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                           ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _solve(held_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv_id, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.result())
                    now = _Conversation(conv_id, held_bytes)
                    if len(out) >= OUT_ROWS:
                        yield _rows(out, _RESULT_ARROW)
                        out = []
                now.add(turn, role, text)
        if now is not None:
            out.append(now.result())
        yield _rows(out, _RESULT_ARROW)
    return run


_TURN_ARROW = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation after its audit (column ``audit`` of its first row) -> repaired turns."""
    now, repaired, position, out = None, None, 0, []
    for batch in batches:
        for conv_id, role, text, audit in zip(*(c.to_pylist() for c in batch.columns)):
            if audit is not None:
                if repaired is not None:
                    out += [(now, position + k, *t) for k, t in enumerate(repaired.inserted())]
                now, repaired, position = conv_id, Repaired(audit), 0
            elif role is not None:
                for t in repaired.row(role, text):
                    out.append((now, position, *t))
                    position += 1
        yield _rows(out, _TURN_ARROW)
        out = []
    if repaired is not None:
        yield _rows([(now, position + k, *t) for k, t in enumerate(repaired.inserted())], _TURN_ARROW)


def _turn_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of repaired turns as they come from `_replay` in one partition."""
    schema = pa.schema([("conv_id", pa.int64()), ("sha", pa.string())])
    now, digest, out = None, None, []
    for batch in _replay(batches):
        for conv_id, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if digest is None or now != conv_id:
                if digest is not None:
                    out.append((now, digest.sha.hexdigest()))
                now, digest = conv_id, _Digest()
            digest.add(iter([(role, text)]))
    if digest is not None:
        out.append((now, digest.sha.hexdigest()))
    yield _rows(out, schema)


def _beside_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, role, text, audit: each conversation's audit first, then its rows in order."""
    audits = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                           F.lit(None).cast("string").alias("text"), "audit")
    return (rows.withColumn("audit", F.lit(None).cast("string")).unionByName(audits).repartition("conv_id")
            .sortWithinPartitions("conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "text").select("conv_id", "role", "text", "audit"))


def solved(rows: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text; a row of
    null role and text only names its conversation): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256 (null where the
    texts are longer than ``held_bytes``)."""
    return (rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
            .mapInArrow(_solve(held_bytes), _RESULT))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, position, role, text: the turns of every repaired conversation."""
    return _beside_audits(rows.select("conv_id", "turn", "role", "text"), solved(rows)).mapInArrow(
        _replay, "conv_id long, position long, role string, text string")


def repair(rows: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """`solved`, with the digest of every conversation."""
    first = staged(solved(rows, held_bytes), "repaired")
    late = first.filter("repaired_sha256 IS NULL")
    if late.isEmpty():
        return first
    again = late.select(F.col("conv_id").alias("late"))
    long = rows.select("conv_id", "turn", "role", "text").join(again, F.col("conv_id").eqNullSafe(F.col("late")), "left_semi")
    digests = (_beside_audits(long, late).mapInArrow(_turn_digests, "conv_id long, sha string")
               .select(F.col("conv_id").alias("late"), "sha"))
    empty = F.lit(hashlib.sha256().hexdigest())          # all rows deleted
    return (first.join(digests, F.col("conv_id").eqNullSafe(F.col("late")), "left")
            .withColumn("repaired_sha256", F.coalesce("repaired_sha256", "sha", empty)).drop("late", "sha"))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """The repair of every conversation after `damaged`."""
    return repair(damaged(conversations))
