import hashlib
import itertools
import re
import zlib

import pytest
from llm_cases import SF
from pyspark.sql import functions as F

from pagefold.llm import repair
from pagefold.llm.queries import QUERIES

PATTERN = re.compile(r"(s?(ua)+)?\Z")
INK = re.compile(r"[^\x20\x09-\x0D]")


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        ink = INK.findall(text)
        if not ink:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """All edit sequences, cheapest and least first, by one growing table of (cost, audit, roles)."""
    order = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}
    best = {"": (0, "", [])}                              # last role initial -> (cost, audit, repaired)

    def inserted(best):
        for _ in range(3):
            for last, (cost, audit, turns) in list(best.items()):
                for r in order[last] - {"s"}:
                    new = (cost + 2, audit + "I", turns + [({"u": "user", "a": "assistant"}[r], "")])
                    if r not in best or new[:2] < best[r][:2]:
                        best[r] = new
        return best

    best = inserted(best)
    for (role, text), f in zip(rows, faults):
        new = {}
        for last, (cost, audit, turns) in best.items():
            options = [(last, 3, "D", [])]
            if f not in ("blank", "duplicate"):
                more = int(f == "truncated")
                if role[:1] in order[last]:
                    options.append((role[:1], more, "K", [(role, text)]))
                options += [(r[0], 2 + more, "R", [(r, text)]) for r in ("user", "assistant") if r[0] in order[last]]
            for to, c, letter, t in options:
                x = (cost + c, audit + letter, turns + t)
                if to not in new or x[:2] < new[to][:2]:
                    new[to] = x
        best = inserted(new)
    return min((best[e] for e in ("", "a") if e in best), key=lambda x: x[:2])


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def plain(conv, rows):
    rows = damage(rows)
    turns = [t for t, _, _ in rows if t is not None]
    said = [(r, x) for _, r, x in rows]
    faults = plain_faults(said)
    cost, audit, repaired = plain_repair(said, faults)
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest())


COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return sorted((plain(c, rs) for c, rs in by.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=repr)


@pytest.mark.parametrize("piece", [1, 2, 3, 512])
def test_cheapest_and_least_against_all_rows_of_small_conversations(piece):
    kinds = [("s", 0), ("u", 0), ("a", 0), ("u", 1), ("a", 2), ("t", 0), ("", 3)]
    names = {0: "", 1: "truncated", 2: "duplicate", 3: "blank"}
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            want = plain_repair([(i, "x") for i, _ in rows], [names[f] for _, f in rows])[:2]
            assert repair.solve(list(rows), piece) == want, rows


def test_audits_reach_the_pattern():
    kinds = [("s", 0), ("u", 1), ("a", 0), ("t", 0), ("u", 3)]
    for rows in itertools.product(kinds, repeat=5):
        cost, audit = repair.solve(list(rows))
        r = repair.Repaired(audit)
        turns = [t for i, _ in rows for t in r.row(i, "x")] + list(r.inserted())
        assert PATTERN.match("".join(t[0][0] for t in turns))
        assert sum(audit.count(k) * c for k, c in (("D", 3), ("R", 2), ("I", 2))) <= cost


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_bidirectional_repair"](spark, SF)) == expected(rows)


def awkward():
    rows = [(c, t, r, x) for c in range(40, 90) for t, (r, x) in enumerate([("user", "Hi."), ("assistant", "Yes!"), ("user", "Hi."), ("assistant", "no end"), ("user", "?")])]
    rows += [(1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "assistant", None), (1, 9, None, "b!"), (None, 0, "user", "x."), (None, 1, "assistant", "y. \n\x0b"),
             (2, None, None, None), (3, 0, "", "z."), (3, 1, "tool", "{}"), (3, 2, "assistant", " "), (3, 3, "system", "s."), (-7, -3, "user", "Ä." * 9000),
             (-7, 4, "assistant", "猫\U0001f642.")]
    rows += [(4, t, "user" if t % 3 else "assistant", f"line {t // 2}{'.' if t % 5 else ''}") for t in range(1300)]
    return rows


@pytest.mark.parametrize("held", [repair.HELD_BYTES, 400])
def test_awkward_rows_and_long_conversations(spark, held):
    df = spark.createDataFrame(awkward(), "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("clash")).withColumn("late", F.lit(1))
    rows = repair.damaged(df)
    assert got(repair.repair(rows, held)) == expected(awkward())


def test_repaired_turns_have_the_digest(spark):
    df = spark.createDataFrame(awkward(), "conv_id long, turn long, role string, text string")
    turns = {}
    for r in sorted(repair.repaired_turns(repair.damaged(df)).collect(), key=lambda r: r["position"]):
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in repair.repaired_conversations(df).collect():
        assert hashlib.sha256("\n".join(turns.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_empty_table(spark):
    assert repair.repaired_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
