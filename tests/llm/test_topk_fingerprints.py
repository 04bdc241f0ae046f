import hashlib
import math

import numpy as np

from llm_cases import SF, edge_docs, edge_rows, empty_docs, prose

from pagefold.llm import fingerprints, topk


def test_topk_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(700)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)]                    # a very common vector: ties
    rows += [(2000, None), (2001, [None] * 16), (2002, [float("nan")] + [0.0] * 15), (2003, [math.inf] + [0.0] * 15), (2004, [0.5] * 3), (None, [0.1] * 16)]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS label", "2 AS v", "3 AS score")
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows if i is not None and v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v)}
    monkeypatch.setattr(topk, "BLOCK", 256)
    got = {}
    for r in topk.top_k(topk.integer_vectors(df), "vec_id % 50 = 0", 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in (i for i in good if i % 50 == 0):
        exp = sorted(((int(good[q] @ v), -i) for i, v in good.items() if i != q), reverse=True)[:5]
        assert got.pop(q) == {n + 1: (-i, s) for n, (s, i) in enumerate(exp)}
    assert set(got) <= {2000, 2004}
    assert topk.top_k(topk.integer_vectors(df.limit(0)), "vec_id % 50 = 0").collect() == []


def test_every_row_of_a_repeated_id_counts(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 250, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(500)] + [(50, [2.0] * 8)] * 30
    got = topk.top_k(topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id % 50 = 0", 5).collect()
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    for q in range(0, 250, 50):
        exp = sorted((-int(x @ v), j) for i, x in whole if i == q for j, v in whole if j != q)[:5]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) == [(n + 1, j, -s) for n, (s, j) in enumerate(exp)]


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.3, -0.1])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in topk.top_k(topk.integer_vectors(df), "vec_id = 0").collect()] == [(0, 1, 1)]


def check_edits(docs, got):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    rest = list(got)
    for n, (i, text) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        row = next(r for r in rest if (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(text), sha))
        rest.remove(row)
        a, b = (np.frombuffer(bytes.fromhex(x), "<u2") for x in (row.fingerprint, row.edited_fingerprint))
        assert row.near_edited == (a == b).mean()
        if edited == text:
            assert row.near_edited == 1
    assert not rest


def test_edited_fingerprints(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.edited_fingerprints(df, chunks=7).collect()
    check_edits(rows, got)
    by = {}
    for r in got:
        assert by.setdefault(dict(rows)[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in got if r.n_chars > 2000]
    assert abs(np.mean([r.near_edited for r in long]) - 1 / 3) < 0.1 and np.mean([r.near_next for r in long]) < 0.1


def test_edit_edge_rows(spark):
    rows = [(i, t or "") for i, t, _, _ in edge_rows()]
    check_edits(rows, fingerprints.edited_fingerprints(edge_docs(spark)).collect())
    one = fingerprints.edited_fingerprints(spark.createDataFrame([(3, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fingerprints.edited_fingerprints(empty_docs(spark)).collect() == []


def test_near_links(spark):
    base = prose(90, 1).split()
    docs = [(i, " ".join(base[:40] + [f"new{i}"] + base[41:])) for i in range(6)] + [(10 + i, prose(90, 40 + i)) for i in range(6)] + [(20, None), (21, "")]
    links = {(r.a, r.b) for r in fingerprints.near_links(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {b for _, b in links} == {1, 2, 3, 4, 5} and all(a < b for a, b in links)


def test_near_links_in_buckets_whose_head_is_near_none(spark):
    """60 smaller doc_ids share buckets with the near pair (100, 101), but are near neither."""
    words = prose(100, 3).split()
    docs = []
    for i in range(60):
        changed = {(i * 7 + 25 * n + (i * n) % 11) % 96 + 2 for n in range(4)}
        docs.append((i, " ".join(f"x{i}y{k}" if k in changed else w for k, w in enumerate(words))))
    docs += [(100, " ".join(words)), (101, " ".join([*words[:50], "changed", *words[51:]]))]
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(96)} for i, t in docs}
    near = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {b for _, b in near if b >= 100} == {101} and not any(a < 100 <= b for a, b in near)
    links = {(r.a, r.b) for r in fingerprints.near_links(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (100, 101) in links and links <= near


def _words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


def test_likeness_of_unrelated_texts_is_small_at_any_length():
    import pyarrow as pa
    from pagefold.llm import fingerprints as fp
    from pagefold.llm.textvec import MinHasher
    rng = np.random.default_rng(5)
    hasher = MinHasher(fp.PERMS)
    for n in (100, 1000, 10_000, 100_000, 1_000_000):
        a, b = fp.fingerprints(pa.array([" ".join(_words(rng, n)) for _ in range(2)], pa.large_string()), hasher)
        assert fp.likeness(a, b) < 0.02 and fp.likeness(a, a) == 1, n


def test_likeness_estimates_the_true_jaccard():
    import pyarrow as pa
    from pagefold.llm import fingerprints as fp
    from pagefold.llm.textvec import MinHasher
    rng = np.random.default_rng(6)
    hasher, errors = MinHasher(fp.PERMS), []
    for share in np.linspace(0, 1, 21):
        for n in (200, 5000, 40_000):
            x = _words(rng, n)
            y = x[:int(n * share)] + _words(rng, n - int(n * share))
            sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (x, y)]
            true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            a, b = fp.fingerprints(pa.array([" ".join(x), " ".join(y)], pa.large_string()), hasher)
            errors.append(abs(fp.likeness(a, b) - true))
    assert max(errors) < 0.16 and sum(e < 0.1 for e in errors) >= 0.95 * len(errors)
