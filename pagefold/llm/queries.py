"""The registered queries of the subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagefold.llm import bpe, chat, clusters, fingerprints, lines, mixing, neardup, passages, quality, repair, sharding, topk, toxicity
from pagefold.session import ensure_session_defaults, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: ASCII white space, as the word pattern of the contracts has it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, oracle: str | None = None):
    def add(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_session_defaults(spark)
            return fn(spark, lambda t: table(spark, sf_dir, t))
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


NEAR_ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
      WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op1_string_kernel_toxicity")
def op1(spark, t):
    """Toxicity score of every document."""
    return toxicity.score_documents(t("documents"), t("labels"))


TOP_ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op2_no_random_access_topk", TOP_ORACLE)
def op2(spark, t):
    """Five best inner products of every vector whose vec_id is divisible by 50."""
    return topk.top_k(topk.integer_vectors(t("embeddings")), "vec_id % 50 = 0", 5)


@query("op3_segment_edit_lines")
def op3(spark, t):
    """Class of near-equal lines for every line of every document."""
    return lines.line_classes(t("documents")).drop("row")


@query("op4_minhash_fingerprints")
def op4(spark, t):
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_fingerprints(t("documents"))


@query("op5_nbsvm_quality")
def op5(spark, t):
    """Quality score of every document."""
    return quality.score_documents(t("documents"), t("labels"))


@query("op6_pivotal_mixing")
def op6(spark, t):
    """Words that the mixture takes of every document."""
    return mixing.mix(t("documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op7_kd_sharding")
def op7(spark, t):
    """Shard and slot of every document, 16 shards of near-equal bytes."""
    return sharding.kd_shards(t("documents"), shards=16)


@query("op8_collinear_passages")
def op8(spark, t):
    """Passages of every document that an earlier document has too."""
    return passages.repeated_passages(t("documents"))


@query("op9_byte_bpe")
def op9(spark, t):
    """Token counts and digests of every document's encoding and decoding."""
    return bpe.encoding_digests(t("documents"))


@query("op10_minhash_odd_sketch", NEAR_ORACLE)
def op10(spark, t):
    """Near-duplicate components of all documents."""
    return neardup.near_duplicates(t("documents"))


@query("op11_bidirectional_repair")
def op11(spark, t):
    """Faults and cheapest repair of every damaged conversation."""
    return repair.repaired_conversations(t("conversations"))


CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|OUT\])"

CHAT_ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, regexp_replace(text, '{CONTROL}', '\1\\\2\3', 'g') AS e,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{CONTROL}', '\1\\\2\3', 'g') AS r FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(CASE WHEN role = 'assistant' THEN length('[OUT]</s>') + length(e) ELSE length('[INST][/INST]') + length(r) + 1 + length(e) END))::BIGINT
    AS formatted_chars,
  0::BIGINT AS rewritten
FROM f GROUP BY conv_id
"""


@query("op12_incremental_chat", CHAT_ORACLE)
def op12(spark, t):
    """Digests of every formatted conversation, read back."""
    return chat.formatted(t("conversations"))


def _cluster_oracle(k: int = clusters.CENTROIDS, rounds: int = clusters.ROUNDS, d: int = clusters.DIMENSIONS, scale: int = clusters.SCALE) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (
  SELECT n, (least_of).c AS c, (least_of).dist AS dist FROM (
    SELECT v.n, min({{'dist': list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.v) + list_inner_product(c.v, c.v), 'c': c.c}}) AS least_of
    FROM v, c{r} c GROUP BY v.n))""")
        if r < rounds:
            steps.append(f"""
m{r} AS (
  SELECT c, list(floor((s - ((s % n) + n) % n) / n)::DOUBLE ORDER BY dim) AS v FROM (
    SELECT a.c, u.dim, sum(u.x)::BIGINT AS s, count(*) AS n FROM a{r} a JOIN u ON u.n = a.n GROUP BY a.c, u.dim) GROUP BY c),
c{r + 1} AS (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)""")
    body = ",".join(steps)
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {d} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT n, unnest(v)::BIGINT AS x, generate_subscripts(v, 1) AS dim FROM v),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {k}),{body},
i AS (SELECT c, sum(dist)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT v.vec_id, a.c::INTEGER AS cluster, a.dist::BIGINT AS distance, i.cluster_inertia, (SELECT sum(dist) FROM a{rounds})::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.n = a.n JOIN i ON i.c = a.c JOIN c{rounds} c ON c.c = a.c
"""


@query("op13_threshold_clusters", _cluster_oracle())
def op13(spark, t):
    """Cluster of every embedding of 64 components, after three rounds."""
    return clusters.clusters(clusters.integer_vectors(t("embeddings")))
