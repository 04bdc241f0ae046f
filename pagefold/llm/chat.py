"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  Turns
are located without looking into it: successive prefixes of a conversation are
rendered and consecutive outputs compared; what the longer one adds is the new
turn's span.  Where the longer output does not begin with the shorter one, the
template has rewritten history: the turn's span begins where the two part, and the
turn is flagged.  A turn's text lies in its span between what two renderings with
probe texts have in common at its front and at its back.  The loss mask is the
text ranges of the roles to be learned.

A prefix is the whole conversation up to a turn, whatever the template, so spans are
right for every template and no rewriting is missed; one task reads a conversation in
order and holds its turns and a few renderings, and its work grows with the square of
its turns.  `formatted` reads the last rendering back as a whole, and texts that a later
turn moved are located anew in it.  Only `turn_spans`, `rewriting_turns` and `Renderer`
can be asked (``window``; `Renderer` by itself also by a template's ``context``) to rely
on spans that depend on so many turns before their own, and on whether there are any:
prefixes then have at most twice as many turns, beyond which the oldest go.

Rows are taken by turn (null first), then role and text.  Null roles and texts are
empty; a null conv_id is a conversation of its own; repeated rows are turns; an
empty table gives no rows (and `formatted` only its added conversation).  Only
conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

OUT_ROWS, OUT_CHARS = 2048, 1 << 22
PROBES = ("0", "1")        # texts without a common front or back
LEARNED = ("assistant",)
WHOLE = math.inf           # a window without end: prefixes are whole conversations


class BracketTemplate:
    """``<s>`` before the first turn, then ``[INST]role newline text[/INST]`` for a
    turn of any role but assistant and ``[OUT]text</s>`` for an assistant's.

    A control string in a text gets a backslash after its first character (one
    more, if it has some already), which `unescape` takes away: no escaped text
    holds a control string, also not across its ends, as these begin with ``[`` or
    ``<`` and have neither elsewhere.  In roles, line feeds and backslashes are
    escaped as well.  Written turns are kept for the next prefix, about as many as a
    conversation has.
    """

    context = 1                # a turn is written without regard to others, ``<s>`` if there are none before

    MARKS = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]|\[OUT\]")
    _CONTROL = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\]|OUT\])")
    _ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\]|OUT\])")

    def __init__(self):
        self._written: dict[Turn, str] = {}

    @classmethod
    def escape(cls, text: str) -> str:
        return cls._CONTROL.sub(r"\1\\\2", text)

    @classmethod
    def unescape(cls, text: str) -> str:
        return cls._ESCAPED.sub(r"\1\2", text)

    def _turn(self, role: str, text: str) -> str:
        if role == "assistant":
            return f"[OUT]{self.escape(text)}</s>"
        role = role.replace("\\", "\\\\").replace("\n", "\\n")
        return f"[INST]{self.escape(role)}\n{self.escape(text)}[/INST]"

    def __call__(self, turns: list[Turn]) -> str:
        if len(self._written) > 2 * len(turns) + 16:
            self._written.clear()
        written = ["<s>" * bool(turns), *map(self._written.get, turns)]
        if None in written:
            self._written.update((t, self._turn(*t)) for t in set(turns).difference(self._written))
            written[1:] = map(self._written.get, turns)
        return "".join(written)

    def parse(self, formatted: str) -> list[Turn]:
        """The turns of any stretch of whole turns of a formatted conversation."""
        out, marks = [], list(self.MARKS.finditer(formatted))
        for here, following in zip(marks, marks[1:]):
            body = formatted[here.end():following.start()]
            if here.group() == "[OUT]":
                out.append(("assistant", self.unescape(body)))
            elif here.group() == "[INST]":
                role, _, text = body.partition("\n")
                role = re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), self.unescape(role))
                out.append((role, self.unescape(text)))
        return out


def _common(a: str, b: str, cut: Callable[[str, int, int], str], known: int = 0) -> int:
    """How many characters a and b have in common from the end that ``cut`` counts from,
    ``known`` of them known to be; in steps that double, so that few others are read."""
    lo, step, most = known, 64, min(len(a), len(b))
    while lo + step <= most and cut(a, lo, lo + step) == cut(b, lo, lo + step):
        lo, step = lo + step, 2 * step
    hi = min(lo + step, most)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if cut(a, lo, mid) == cut(b, lo, mid) else (lo, mid - 1)
    return lo


def common_front(a: str, b: str, known: int = 0) -> int:
    """Length of the longest common prefix."""
    return len(a) if b.startswith(a) else _common(a, b, lambda s, i, j: s[i:j], known)


def common_back(a: str, b: str) -> int:
    return _common(a, b, lambda s, i, j: s[len(s) - j:len(s) - i])


@dataclass
class Span:
    """A turn as it was rendered: ``text`` is the range of its text in ``rendered``;
    ``back`` is how many characters of earlier output it replaced."""
    role: str
    rendered: str
    text: tuple[int, int]
    back: int


@dataclass
class Renderer:
    """Renders a conversation turn by turn through a black-box template; ``window`` is
    the number of turns that a span may depend on (None: as the template declares, or all;
    WHOLE: all, whatever it declares)."""

    template: Template
    window: float | None = None
    turns: list[Turn] = field(default_factory=list)
    output: str | None = None

    def __post_init__(self):
        if self.window is None:
            self.window = getattr(self.template, "context", None)

    def add(self, role: str, text: str) -> Span:
        if self.output is None:
            self.output = self.template([])
            front = self.output
        else:
            front = ""
        if self.window is not None and len(self.turns) >= 2 * self.window:
            self.turns = self.turns[-self.window:]
            self.output = self.template(self.turns)
        longer = self.template([*self.turns, (role, text)])
        start = common_front(self.output, longer)
        back = len(self.output) - start
        before, self.output = self.output, longer
        self.turns.append((role, text))
        head, tail = self._around(len(self.turns) - 1, before)
        lo, hi = min(max(head, start), len(longer)), max(len(longer) - tail, start)
        rendered = front + longer[start:]
        return Span(role, rendered, (len(front) + lo - start, len(front) + max(lo, hi) - start), back)

    def _around(self, i: int, before: str = "") -> tuple[int, int]:
        """What renderings with probe texts as turn ``i`` have in common at their front (``before`` perhaps) and back."""
        x, y = (self.template([*self.turns[:i], (self.turns[i][0], p), *self.turns[i + 1:]]) for p in PROBES)
        return common_front(x, y, len(before) if x.startswith(before) and y.startswith(before) else 0), common_back(x, y)

    def locate(self, i: int) -> tuple[int, int]:
        """The range of turn ``i``'s text in what the turns so far are rendered to."""
        head, tail = self._around(i)
        lo = min(head, len(self.output))
        return lo, max(lo, len(self.output) - tail)


def _conversations(batches: Iterator[pa.RecordBatch], template: Template, window: float) -> Iterator[tuple[int | None, bool, Renderer, Span]]:
    """(conv_id, begins, renderer, span) of rows that come by conversation and turn."""
    now, renderer = None, None
    for batch in batches:
        for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            begins = renderer is None or conv_id != now
            if begins:
                now, renderer = conv_id, Renderer(template, window)
            yield conv_id, begins, renderer, renderer.add(role, text)


_SPANS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("rendered", pa.string()),
                    ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_()), ("replaced", pa.int32())])


def _batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(schema), schema)], schema=schema)


def _spans(template: Template, window: float, learned: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, position, chars = [], 0, 0
        for conv_id, begins, _, s in _conversations(batches, template, window):
            position = 0 if begins else position + 1
            out.append((conv_id, position, s.role, s.rendered, *s.text, s.role in learned, s.back))
            chars += len(s.rendered)
            if len(out) >= OUT_ROWS or chars >= OUT_CHARS:
                yield _batch(out, _SPANS)
                out, chars = [], 0
        yield _batch(out, _SPANS)
    return run


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten", pa.int64())])


class _Digest:
    """What a formatted conversation says when it is read back, and its text under the loss mask."""

    def __init__(self, conv_id: int | None, renderer: Renderer):
        self.conv_id, self.renderer = conv_id, renderer
        self.learned: dict[int, tuple[int, int]] = {}     # the ranges of learned texts by position
        self.moved: set[int] = set()                      # positions of those that a later turn rewrote or moved
        self.rewritten = 0

    def add(self, span: Span, learned: tuple[str, ...]) -> None:
        start = len(self.renderer.output) - len(span.rendered)
        if span.back:
            self.rewritten += 1
            self.moved.update(i for i, (_, hi) in self.learned.items() if hi >= start)
        if span.role in learned:
            self.learned[len(self.renderer.turns) - 1] = start + span.text[0], start + span.text[1]

    def row(self, template: BracketTemplate) -> tuple:
        output, n, turns, loss, loss_chars = self.renderer.output, 0, hashlib.sha256(), hashlib.sha256(), 0
        for n, (role, text) in enumerate(template.parse(output), 1):
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for i, at in self.learned.items():
            lo, hi = self.renderer.locate(i) if i in self.moved else at
            text = template.unescape(output[lo:hi])
            loss.update(text.encode("utf-8", "surrogatepass"))
            loss_chars += len(text)
        return self.conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), len(output), self.rewritten


def _digests(template: BracketTemplate, learned: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now = [], None
        for conv_id, begins, renderer, span in _conversations(batches, template, WHOLE):
            if begins:
                if now is not None:
                    out.append(now.row(template))
                now = _Digest(conv_id, renderer)
                if len(out) >= OUT_ROWS:
                    yield _batch(out, _DIGESTS)
                    out = []
            now.add(span, learned)
        if now is not None:
            out.append(now.row(template))
        yield _batch(out, _DIGESTS)
    return run


def _ordered(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
            .repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "role", "text"))


def turn_spans(conversations: DataFrame, template: Template | None = None, window: float = WHOLE, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """Of every turn: conv_id, position, role, rendered (its span of the formatted
    conversation), text_start and text_end (its text inside the span), loss
    (whether that range is under the loss mask), replaced (characters of earlier
    output that the template rewrote; 0 for templates that only append)."""
    return _ordered(conversations).mapInArrow(
        _spans(template or BracketTemplate(), window, learned),
        "conv_id long, position long, role string, rendered string, text_start int, text_end int, loss boolean, replaced int")


def rewriting_turns(conversations: DataFrame, template: Template, window: float = WHOLE) -> DataFrame:
    """conv_id, position, role, replaced of the turns at which ``template`` rewrites history."""
    return turn_spans(conversations, template, window).filter("replaced > 0").select("conv_id", "position", "role", "replaced")


#: A conversation whose texts are made of control strings.
PROBE_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def formatted(conversations: DataFrame, template: BracketTemplate | None = None, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """What every formatted conversation, and the probe conversation, says when it
    is read back: conv_id, n_turns, turns_sha256 (of the parsed and unescaped
    turns), loss_chars and loss_sha256 (of the unescaped text under the loss
    mask), formatted_chars, rewritten (turns that rewrote earlier output)."""
    spark = conversations.sparkSession
    probe = spark.range(1).selectExpr("explode(array({})) AS t".format(", ".join(
        f"struct({c}L AS conv_id, {t}L AS turn, '{r}' AS role, '{x}' AS text)" for c, t, r, x in PROBE_CONVERSATION))).select("t.*")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return _ordered(rows.unionByName(probe)).mapInArrow(
        _digests(template or BracketTemplate(), learned),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten long")
