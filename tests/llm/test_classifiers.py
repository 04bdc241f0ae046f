import zlib

import numpy as np
import pytest
from llm_cases import edge_docs, edge_rows, empty_docs, prose

from pagefold.llm import quality, toxicity
from pagefold.llm.linear import dual_coordinate_descent, labelled_sample, platt

BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize("module, label, folds, held, least", [(quality, "quality", 5, 0, 0.97), (toxicity, "toxic", 3, 1, 0.9)])
def test_held_out_accuracy(spark, module, label, folds, held, least):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    got = module.score_documents(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= module.THRESHOLD)
    test = [r for r in got if r.held_out and r[label] is not None]
    assert np.mean([r.predicted == r[label] for r in test]) >= least


def test_held_out_rows_are_never_learned(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    ids = [r.doc_id for r in labelled_sample(docs, labels, "quality", 5, 0, 40).collect()]
    assert len(ids) == 80 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_edge_rows(spark, module, label):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (7, 1, 0), (9, 1, 1), (10, 0, 0), (12, 0, 1), (13, None, None), (None, 1, 1), (3, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    for table in (labels, labels.filter("doc_id < 0"), labels.filter(f"{label} = 1")):
        got = module.score_documents(docs, table).collect()
        assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
        by = {}
        for r, t in zip(got, [t for _, t, _, _ in edge_rows()]):
            assert by.setdefault(t or "", r.score) == r.score           # the text alone decides
    assert module.score_documents(empty_docs(spark), labels).collect() == []


def test_quality_filter_keeps_columns(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.keep_good(docs, none)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_gaps_and_inserted_characters():
    rng = np.random.default_rng(0)
    texts = [prose(30, i) for i in range(60)]
    bad = []
    for i in range(60):
        words = prose(30, 100 + i).split()
        words.insert(int(rng.integers(30)), "idiot")
        bad.append(" ".join(words))
    y = np.array([-1] * len(texts) + [1] * len(bad))
    v, bias = toxicity._fit_words(toxicity._Sample(texts + bad, y), np.ones(len(y), bool))
    import pyarrow as pa
    m = toxicity.row_margins(pa.array(["i d i o t", "id-iot", "idxiot", "IDIOT!", "1diot", "mernik toriba", "", None]), v, bias)
    assert m[:5].min() > m[5:].max()


def test_quoted_and_mislabelled_insults():
    rng = np.random.default_rng(4)
    texts = [prose(30, i) for i in range(60)]
    texts += ["the word idiot is one that he would not use", "what a moron"]          # a quotation, a wrong label
    bad = []
    for i in range(60):
        words = prose(30, 100 + i).split()
        words.insert(int(rng.integers(30)), ("idiot", "moron")[i % 2])
        bad.append(" ".join(words))
    y = np.array([-1] * len(texts) + [1] * len(bad))
    v, bias = toxicity._fit_words(toxicity._Sample(texts + bad, y), np.ones(len(y), bool))
    import pyarrow as pa
    m = toxicity.row_margins(pa.array(["IDIOT!", "m o r o n", "idxiot", "the word is one that he would not use", "mernik toriba", ""]), v, bias)
    assert m[:3].min() > m[3:].max()


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) > 0, 1, -1)
    w = dual_coordinate_descent([(slice(None), r) for r in x], y, 5, c=10.0, epochs=60)
    margins = x @ w[:-1] + w[-1]
    assert np.mean(np.sign(margins) == y) > 0.98
    a, b = platt(margins, y)
    p = 1 / (1 + np.exp(-(a * margins + b)))
    assert np.mean((p > 0.5) == (y > 0)) > 0.98
