import hashlib

import __spark_entry__ as E
import corpus_pipeline as P

from llm_cases import SF, edge_docs, empty_docs

from pagefold.llm import lines, mixing, neardup, quality


def test_registered():
    names = E.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and {q for q in E.oracle_sql() if q.startswith("op")} == {
        "op2_no_random_access_topk", "op10_minhash_odd_sketch", "op12_incremental_chat", "op13_threshold_clusters"}
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "bpe"]


def test_stages_take_effect(spark):
    """Every stage against a plain reading of its decisions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = P.STAGES[0][1](spark, docs, SF)
    accepted = {r.doc_id for r in quality.score_documents(docs, labels).filter("predicted = 1").collect()}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == accepted

    second = P.STAGES[1][1](spark, first, SF)
    kept = {}
    for r in lines.line_classes(first).collect():
        kept.setdefault(r.doc_id, {})[r.line_no] = r.kept
    exp = {}
    for r in first.collect():
        keep = [x for i, x in enumerate(r.text.split("\n")) if kept.get(r.doc_id, {}).get(i, True)]
        if any(keep) or not any(not k for k in kept.get(r.doc_id, {}).values()):
            exp[r.doc_id] = "\n".join(keep)
    assert {r.doc_id: r.text for r in second.collect()} == exp and second.columns == docs.columns

    third = P.STAGES[2][1](spark, second, SF)
    stay = {r.doc_id for r in neardup.near_duplicates(second).filter("kept").collect()}
    assert {r.doc_id for r in third.collect()} == stay and third.columns == docs.columns

    fourth = P.STAGES[3][1](spark, third, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix(third).collect()}
    assert sorted(r.doc_id for r in fourth.collect()) == sorted(i for i, n in copies.items() for _ in range(n)) and fourth.columns == docs.columns

    last = P.STAGES[4][1](spark, fourth, SF).collect()
    text = {r.doc_id: r.text for r in fourth.collect()}
    assert len(last) == fourth.count() and all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and len(r.tokens) == r.n_tokens for r in last)


def test_run(spark):
    assert P.run(spark, SF).count() > 0


def test_edge_rows_pass_every_stage(spark):
    for name, stage in P.STAGES:
        for docs in (edge_docs(spark), empty_docs(spark)):
            out = stage(spark, docs, SF)
            assert name == "bpe" or out.columns == docs.columns
            out.collect()
