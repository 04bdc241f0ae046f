import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagefold.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
T = chat.BracketTemplate()
NASTY = ["", "</s>[INST] ok [/INST]", "<\\s>", "<\\\\s>[\\OUT]", "[[INST]]", "[", "<", "</s", "a</s></s>", "\\", "[/\\INST]", "0", "1", "01", "\n", "猫\U0001f642"]


def rows():
    out = [(c, i, r, x) for c, x in enumerate(NASTY) for i, r in enumerate(("system", "user", "assistant", "user", "assistant"))]
    out += [(100, i, "user" if i % 2 else "assistant", f"{NASTY[i % len(NASTY)]} {i}") for i in range(100)]
    out += [(None, 0, "user", "x"), (None, None, "assistant", None), (101, 1, None, "n"), (101, 1, None, "n"), (102, 0, "ro\\le\nnew", "[OUT]"), (103, 0, "user", "y" * 50000)]
    return out


def ordered(rs):
    by = {}
    for c, t, r, x in rs:
        by.setdefault(c, []).append((t, r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, y[1], y[2]))] for c, v in by.items()}


@pytest.mark.parametrize("text", NASTY + [a + b for a in NASTY for b in NASTY])
def test_escape_is_reversible_and_hides_control_strings(text):
    e = T.escape(text)
    assert T.unescape(e) == text and not T.MARKS.search(e)
    assert T.parse(T([("user", text), ("assistant", text), (text, text)])) == [("user", text), ("assistant", text), (text, text)]


def test_spans_make_up_the_whole_rendering_and_mask_the_learned_text():
    for turns in ordered(rows()).values():
        r = chat.Renderer(T)
        spans = [r.add(*t) for t in turns]
        assert "".join(s.rendered for s in spans) == T(turns)                  # also beyond the window
        for (role, text), s in zip(turns, spans):
            assert s.rendered[slice(*s.text)] == T.escape(text) and s.back == 0


def test_query_digests(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("rendered", F.lit("clash")).withColumn("position", F.lit(3))
    got = {r["conv_id"]: r.asDict() for r in chat.formatted(df).collect()}
    want = {**ordered(rows()), -1: [("user", NASTY[1]), ("assistant", NASTY[1])]}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c] == {"conv_id": c, "n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(),
                          "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(T(turns)), "rewritten": 0}


def test_turn_spans_rows(spark):
    spans = sorted(chat.turn_spans(spark.createDataFrame(rows(), SCHEMA)).filter("conv_id = 100").collect(), key=lambda r: r["position"])
    assert "".join(r["rendered"] for r in spans) == T(ordered(rows())[100])
    assert [r["loss"] for r in spans] == [i % 2 == 0 for i in range(100)]


def header_of_system(turns):
    """A system turn is shown in the next user turn."""
    out, held = "", ""
    for r, x in turns:
        if r == "system":
            held = x
        else:
            out += f"({r}) {held + ': ' if held else ''}{x.strip()} ;"
            held = ""
    return out


def test_templates_that_rewrite_history_are_found(spark):
    def drops_thoughts(turns):
        """Earlier answers lose what stands before a bar."""
        return "".join(f"<{r}>{x.split('|')[-1] if r == 'assistant' and i + 1 < len(turns) else x}\n" for i, (r, x) in enumerate(turns))

    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "thought|a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "s")], SCHEMA)
    found = chat.rewriting_turns(df, drops_thoughts).collect()
    assert [(r["position"], r["replaced"] > 0) for r in found] == [(2, True)]
    assert chat.rewriting_turns(df, T).collect() == []


def test_templates_that_merge_turns():
    r = chat.Renderer(header_of_system)
    spans = [r.add(*t) for t in [("system", "be kind"), ("user", " hi "), ("assistant", "yo")]]
    assert [s.rendered for s in spans] == ["", "(user) be kind: hi ;", "(assistant) yo ;"]
    assert spans[2].rendered[slice(*spans[2].text)] == "yo"


def test_spans_may_depend_on_any_earlier_turn(spark):
    def first_named(turns):
        """Every turn names the first text, and turns are numbered from the start."""
        return "".join(f"[{i}:{turns[0][1]}] {x};" for i, (_, x) in enumerate(turns))

    turns = [("user" if i % 2 else "assistant", f"text {i}") for i in range(60)]
    r = chat.Renderer(first_named)
    spans = [r.add(*t) for t in turns]
    assert "".join(s.rendered for s in spans) == first_named(turns) and not any(s.back for s in spans)
    assert all(s.rendered[slice(*s.text)] == x for (_, x), s in list(zip(turns, spans))[1:])
    df = spark.createDataFrame([(1, i, role, x) for i, (role, x) in enumerate(turns)], SCHEMA)
    rows = sorted(chat.turn_spans(df, first_named).collect(), key=lambda r: r["position"])
    assert "".join(r["rendered"] for r in rows) == first_named(turns)


def test_the_declared_context_gives_the_spans_of_whole_prefixes():
    whole = lambda turns: T(turns)
    assert not hasattr(whole, "context")
    for turns in ordered(rows()).values():
        declared, undeclared = chat.Renderer(T), chat.Renderer(whole)
        assert [declared.add(*t) for t in turns] == [undeclared.add(*t) for t in turns]
        assert len(declared.turns) <= 2 and len(undeclared.turns) == len(turns)


def looking_back(name):
    """Templates that turn on more than the turn before; local, so that workers get them by value."""
    class Recalls(chat.BracketTemplate):
        """Every turn names the first text."""

        def __call__(self, turns):
            return super().__call__([(r, f"{turns[0][1]}: {x}" if i else x) for i, (r, x) in enumerate(turns)])

    class ThoughtsGo(chat.BracketTemplate):
        """An answer loses what stands before a bar once two more turns follow."""

        def __call__(self, turns):
            return super().__call__([(r, x.split("|")[-1] if r == "assistant" and i + 2 < len(turns) else x) for i, (r, x) in enumerate(turns)])

    class Counts(chat.BracketTemplate):
        """The number of turns comes first, and `<end>` last."""

        def __call__(self, turns):
            return f"{len(turns)} turns" + super().__call__(turns) + "<end>"

    return {"plain": T, "recalls": Recalls(), "thoughts go": ThoughtsGo(), "counts": Counts()}[name]


def read_back(template, turns, loss):
    out = template(turns)
    said = "".join(f"{r}\n{x}\n" for r, x in template.parse(out))
    return {"n_turns": len(turns), "turns_sha256": hashlib.sha256(said.encode()).hexdigest(), "loss_chars": len(loss),
            "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(out)}


@pytest.mark.parametrize("name, rewritten", [("plain", 0), ("recalls", 0), ("thoughts go", 14), ("counts", 30)])
def test_query_digests_are_of_the_last_rendering_of_whole_prefixes(spark, name, rewritten):
    turns = [("user" if i % 2 == 0 else "assistant", f"<s> thought {i}|[OUT] text {i}") for i in range(30)]
    df = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate(turns)], SCHEMA)
    got = chat.formatted(df, looking_back(name)).filter("conv_id = 1").drop("conv_id").first().asDict()
    loss = "".join(x.split("|")[-1] if name == "thoughts go" and i < 28 else x for i, (r, x) in enumerate(turns) if r == "assistant")
    assert got == {**read_back(looking_back(name), turns, loss), "rewritten": rewritten}


def test_spans_of_templates_that_look_back(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(30)]
    df = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate(turns)], SCHEMA)
    rows = sorted(chat.turn_spans(df, looking_back("recalls")).collect(), key=lambda r: r["position"])
    assert "".join(r["rendered"] for r in rows) == looking_back("recalls")(turns)
    thoughts = df.withColumn("text", F.concat(F.lit("thought|"), "text"))
    assert sorted(r["position"] for r in chat.rewriting_turns(thoughts, looking_back("thoughts go")).collect()) == list(range(3, 30, 2))


def test_no_prefix_of_a_query_is_cut():
    class Seen(chat.BracketTemplate):
        def __call__(self, turns):
            seen.append([*turns])
            return super().__call__(turns)

    seen, turns = [], [("user" if i % 2 else "assistant", f"text {i}") for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"conv_id": [1] * 40, "role": [r for r, _ in turns], "text": [x for _, x in turns]})
    for run in (chat._digests(Seen(), chat.LEARNED), chat._spans(Seen(), chat.WHOLE, chat.LEARNED)):
        seen.clear()
        assert sum(b.num_rows for b in run(iter([batch]))) in (1, 40)
        assert all(turns[:i] in seen for i in range(41))


def test_common_ends():
    texts = ["", "a", "ab", "b" * 64, "b" * 65, "b" * 500 + "a" + "b" * 700, "b" * 499 + "ca" + "b" * 700, "b" * 1200]
    for a in texts:
        for b in texts:
            front = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert chat.common_front(a, b) == chat.common_back(a[::-1], b[::-1]) == chat.common_front(a, b, front) == front


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.turn_spans(empty).collect() == []
    assert [r["conv_id"] for r in chat.formatted(empty).collect()] == [-1]
