import random
import re

import numpy as np
from llm_cases import edge_docs, edge_rows, empty_docs, prose

from pagefold.llm import neardup
from pagefold.llm.textvec import MinHasher


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    """{doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    comp = {i: i for i in sets}
    changed = True
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(comp[i], comp[j])
            if comp[i] != low or comp[j] != low:
                comp[i] = comp[j] = low
                changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_edge_rows(spark):
    got = neardup.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    exp = brute({i: t for i, t, _, _ in edge_rows() if i is not None}.items())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == exp[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert neardup.near_duplicates(empty_docs(spark)).collect() == []


def test_chains_of_edits_equal_brute_force(spark):
    """Groups whose members are near only some of the others."""
    rng, docs = random.Random(3), []
    for g in range(12):
        base = prose(60 + 10 * g, 50 + g).split()
        words = list(base)
        for _ in range(14):
            if rng.random() < 0.3:
                words = list(base)
            words = list(words)
            for _ in range(rng.randrange(1, 3)):
                words[rng.randrange(len(words))] = rng.choice("edit other new".split()) + str(rng.randrange(9))
            docs.append((len(docs), " ".join(words)))
    exp = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == exp
    kept = {r.doc_id for r in neardup.keep_one(df).collect()}
    assert kept == {i for i, (_, c) in exp.items() if c == i}


def test_sketch_estimates_differences():
    h = MinHasher(neardup.PERMS)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for keep in (400, 390, 370):
        other = np.concatenate([base[:keep], rng.integers(0, 1 << 63, 400 - keep, dtype=np.uint64)])
        x, y = (neardup.odd_sketch(h.signature(np.unique(s))).view(np.uint64) for s in (base, other))
        ones = int(np.bitwise_count(x ^ y).sum())
        jaccard = keep / (800 - keep)
        assert neardup.max_ones(min(1.0, jaccard + 0.15)) - 1 <= ones <= neardup.max_ones(jaccard - 0.15)
