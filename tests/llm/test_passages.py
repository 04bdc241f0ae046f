import random

import numpy as np
from llm_cases import edge_docs, empty_docs, prose

from pagefold.llm import passages


def test_planted_passages(spark):
    rng, docs = random.Random(2), []
    planted = {}
    for p in range(4):
        passage = prose(55 + 30 * p, 900 + p).split()
        for c in range(6):
            words = list(passage)
            for _ in range(c % 3 if p else c % 2):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(99)}"
            if c == 4:
                del words[20]
            i = len(docs)
            before, after = prose(rng.randrange(0, 90), 2000 + i), prose(rng.randrange(0, 90), 3000 + i)
            docs.append((i, f"{before} {' '.join(words)} {after}"))
            planted[i] = (p, len(before.split()), len(words))
    docs += [(1000 + i, prose(120, 7000 + i)) for i in range(20)]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.doc_id < 1000 and planted[r.doc_id][0] == planted[r.first_doc_id][0] and r.first_doc_id < r.doc_id for r in got)
    for i, (p, start, n) in planted.items():
        if i % 6:
            covered = set().union(*(range(r.start_word, r.end_word) for r in got if r.doc_id == i))
            assert covered >= set(range(start + 8, start + n - 8)), (i, p)


def test_evenly_edited_passages(spark):
    """A passage of 55 words with a word replaced every 8, 10, 12, 15 or 20 words is found each time."""
    docs, wanted = [], {}
    for step in (8, 10, 12, 15, 20):
        for n in range(12):
            words = prose(55, 5000 + n).split()
            edited = [f"edit{i}" if i % step == n % step else w for i, w in enumerate(words)]
            for ws in (words, edited):
                i = 100 * step + 2 * n + (ws is edited)
                docs.append((10000 * step + i, f"{prose(60, 100000 * step + i)} {' '.join(x + str(step) for x in ws)} {prose(60, 200000 * step + i)}"))
            wanted[docs[-1][0]] = docs[-2][0], [w == e for w, e in zip(words, edited)]
    got = {(r.doc_id, r.first_doc_id): r for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(b == wanted[a][0] for a, b in got)
    for b, (a, same) in wanted.items():
        assert (b, a) in got, b
        assert got[b, a].edits <= same.count(False)


def test_recall_at_many_edits(spark):
    """Of 40 passages of 60 words with a word replaced every 7, 9, 12 or 20 words at least nine in ten are found."""
    docs, wanted = [], {}
    for step in (7, 9, 12, 20):
        for n in range(40):
            words = [f"{x}{step}q{n}" for x in prose(60, 5000 + n).split()]
            edited = [f"edit{i}" if i % step == n % step else w for i, w in enumerate(words)]
            for k, ws in enumerate((words, edited)):
                i = 1000 * step + 2 * n + k
                docs.append((i, f"{prose(60, 100000 * step + i)} {' '.join(ws)} {prose(60, 200000 * step + i)}"))
            wanted[i] = step
    got = {(r.doc_id, r.first_doc_id) for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got <= {(b, b - 1) for b in wanted}
    for step in (7, 9, 12, 20):
        assert sum((b, b - 1) in got for b, s in wanted.items() if s == step) >= 36, step


def test_passages_whose_parts_occur_earlier_apart(spark):
    """Every passage of 50 words that an earlier document has is found, against brute force, whatever smaller doc_ids hold parts of it."""
    docs, pairs = [], []
    for n, cuts in enumerate([[(0, 30), (30, 60)], [(0, 49), (49, 98)], [(0, 45), (8, 52)], [(0, 49), (1, 50)], [(0, 25), (20, 45), (40, 65), (10, 35), (30, 55)]]):
        words = [w + f"p{n}" for w in prose(max(e for _, e in cuts), 40 + n).split()]
        for i, (x, y) in enumerate([*cuts, (0, len(words)), (0, len(words))]):
            docs.append((1000 * n + 10 * i, f"{prose(40, 9000 + 100 * n + i)} {' '.join(words[x:y])} {prose(40, 9500 + 100 * n + i)}"))
        pairs.append((docs[-1][0], docs[-2][0]))
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert set(pairs) <= {(r.doc_id, r.first_doc_id) for r in got}
    seen = set()
    for i, text in docs:
        ws = text.split()
        runs = [tuple(ws[k:k + 50]) for k in range(len(ws) - 49)]
        covered = set().union(set(), *(range(r.start_word, r.end_word) for r in got if r.doc_id == i))
        assert all(set(range(k, k + 50)) <= covered for k, run in enumerate(runs) if run in seen), i
        seen.update(runs)


def test_later_copy_of_a_seed(spark):
    """The passage is the second copy of its words in one document and the only one in the other."""
    p = prose(60, 1).split()
    stray = [" ".join(p[i:i + 6]) + f" x{i}" for i in range(0, 60, 6)]
    once, twice = " ".join(p), " ".join([*p, "between", *p])
    docs = [(1, once), (2, twice), (3, " ".join(stray) + " " + prose(30, 5) + " " + once)]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for doc, start in ((2, 0), (2, 61), (3, 100)):
        assert any(r.doc_id == doc and r.start_word <= start + 4 and r.end_word >= start + 56 for r in got), (doc, start)


def test_edge_rows(spark):
    got = passages.repeated_passages(edge_docs(spark)).collect()
    pairs = {(r.first_doc_id, r.doc_id) for r in got}
    assert {(1, 2), (1, 3), (1, 14), (10, 11)} <= pairs
    assert all(a in (1, 2, 10) and b in (2, 3, 11, 14) for a, b in pairs)
    assert passages.repeated_passages(empty_docs(spark)).collect() == []


def test_chain_is_the_best_one():
    """The Fenwick recurrence against a quadratic one."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(2, 40))
        b, a = np.sort(rng.integers(0, 300, n)), rng.integers(0, 300, n)
        best = np.zeros(n)
        order = np.lexsort((a, b))
        for x, i in enumerate(order):
            before = [best[j] - passages.GAP * (b[i] - b[j] + a[i] - a[j]) for j in order[:x] if b[j] < b[i] and a[j] < a[i]]
            best[i] = 1 + max([0.0, *before])
        found = list(passages.chains(b, a))
        if best.max() >= passages.MIN_CHAIN:
            worth, path = found[0]
            assert abs(worth - best.max()) < 1e-9
            assert (np.diff(b[path]) > 0).all() and (np.diff(a[path]) > 0).all()
        else:
            assert not found


def test_word_edits():
    rng = random.Random(8)
    for _ in range(200):
        x, y = ([rng.randrange(4) for _ in range(rng.randrange(90))] for _ in range(2))
        p = list(range(len(y) + 1))
        for i, u in enumerate(x):
            c = [i + 1]
            for j, v in enumerate(y):
                c.append(min(p[j] + (u != v), p[j + 1] + 1, c[j] + 1))
            p = c
        assert passages.word_edits(x, y) == p[-1]
