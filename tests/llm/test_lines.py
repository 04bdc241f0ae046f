import random

import numpy as np

from llm_cases import SF, edge_docs, edge_rows, empty_docs, prose

from pagefold.llm import lines


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        c = [i + 1]
        for j, y in enumerate(b):
            c.append(min(p[j] + (x != y), p[j + 1] + 1, c[j] + 1))
        p = c
    return p[-1]


def brute(docs):
    """{(doc_id, line_no): (class doc, class line)} by comparing all pairs."""
    first = {}
    places = [(d, i, x.encode()) for d, t in docs for i, x in enumerate((t or "").split("\n")) if x]
    for d, i, x in sorted(places, key=lambda p: (p[0], p[1])):
        first.setdefault(x, (d, i))
    all_ = sorted(first, key=len)
    up = {x: x for x in all_}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    size = np.array([len(x) for x in all_])
    for i, x in enumerate(all_):
        if len(x) >= lines.MIN_BYTES:
            near = all_[i + 1:int(np.searchsorted(size, len(x) + lines.EDITS, "right"))]
            for y in (near[k] for k in np.flatnonzero(lines.within_edits([x] * len(near), near))):
                up[top(x)] = top(y)
    head = {}
    for x in all_:
        head[top(x)] = min(head.get(top(x), first[x]), first[x])
    return {(d, i): head[top(x)] for d, i, x in places}


def test_banded_distance_is_exact():
    rng, a, b = random.Random(3), [], []
    for _ in range(1500):
        x = bytes(rng.choice(b"ab") for _ in range(rng.randrange(30)))
        y = bytearray(x)
        for _ in range(rng.randrange(5)):
            k, i = rng.randrange(3), rng.randrange(len(y) + 1)
            if k == 0:
                y.insert(i, rng.choice(b"abc"))
            elif y and k == 1:
                del y[i % len(y)]
            elif y:
                y[i % len(y)] = rng.choice(b"abc")
        a.append(x)
        b.append(bytes(y))
    for e in (1, 2, 3):
        assert lines.within_edits(a, b, e).tolist() == [distance(x, y) <= e for x, y in zip(a, b)]


def test_every_near_pair_shares_a_key():
    rng = random.Random(9)
    for _ in range(300):
        x = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(26, 60))).encode()
        y = bytearray(x)
        for _ in range(lines.EDITS):
            k, i = rng.randrange(3), rng.randrange(len(y))
            if k == 0:
                y.insert(i, 122)
            elif k == 1:
                del y[i]
            else:
                y[i] = 121
        found = []
        for t in (x, bytes(y)):
            roll = lines.Rolling(np.frombuffer(t, np.uint8))
            keys = {True: set(), False: set()}
            for _, key, files in lines.join_keys(roll, np.array([0]), np.array([len(t)]), lines.EDITS):
                keys[files] |= set(key.tolist())
            found.append(keys)
        p, q = found
        assert p[True] & (q[True] | q[False]) or q[True] & (p[True] | p[False])


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng, n = random.Random(1), max(r[0] for r in rows)
    for i in range(60):                                    # lines two edits away from others, in chains
        x = list(prose(8, i % 5))
        for _ in range(rng.randrange(4)):
            x[rng.randrange(len(x))] = rng.choice("qzj")
        rows.append((n + 1 + i, "".join(x) + "\n\n" + prose(3, i)))
    exp = brute(rows)
    got = lines.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in got} == exp
    assert all(r.kept == (exp[r.doc_id, r.line_no] == (r.doc_id, r.line_no)) for r in got)


def test_dedup_edge_rows(spark):
    docs = edge_docs(spark)
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    texts = {i: t for i, t in got}
    assert (4, None) in got and texts[5] == "" and texts[6] == "   \n\t "
    assert 2 not in texts                                   # a copy loses all its lines
    assert texts[11] == edge_rows()[11][1].split("\n")[-1]
    assert sum(i == 9 for i, _ in got) == 2                 # repeated rows share their fate
    assert all(r.n_chars == len(r.text) for r in out.filter("text IS NOT NULL").collect())
    assert lines.dedup_lines(empty_docs(spark)).collect() == []
