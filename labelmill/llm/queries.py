"""The queries op1..op13, each over its whole table, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm.binout import digests, write_packed
from labelmill.llm.clusters import clustered
from labelmill.llm.common import scratch
from labelmill.llm.compaction import compacted
from labelmill.llm.importance import importance_sample
from labelmill.llm.licenses import scan_licenses
from labelmill.llm.mixing import shares
from labelmill.llm.packing import best_fit_pack
from labelmill.llm.quality import score_quality
from labelmill.llm.secrets import scan_secrets
from labelmill.llm.simhash import near_duplicates
from labelmill.llm.topk import top_inner_products
from labelmill.llm.toxicity import score_toxicity
from labelmill.llm.vectors import near_duplicate_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), capacity=4096, end_id=1)


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), most=3).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score", F.size("spans").cast("long").alias("n_spans"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), half=1)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)
    return found.select("doc_id", "held_out", "score", "predicted", F.transform("neighbours", lambda n: n["doc_id"]).alias("evidence"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = compacted(table(spark, sf_dir, "documents"), scratch(spark, "op9"))
    return kept.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = write_packed(table(spark, sf_dir, "documents"), f"{scratch(spark, 'op10')}", capacity=2048)
    return digests(packed)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed="2:")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", told.alias("spans"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=1, bins=10_000, least_words=20, percent=10, seed="2024:")
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_exact_topk, op3_mixing, op4_license_scan, op5_simhash, op6_quality, op7_toxicity, op8_embedding_dedup, op9_sharding, op10_token_output, op11_centroid_clustering, op12_secret_scan, op13_importance_resampling)}

_FIT = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

def _clusters_sql(rounds: int = 5, k: int = 40, dims: int = 64) -> str:
    """The rounds of op11, one after the other."""
    to = lambda i: f"SELECT n, vec_id, v.v, c, c.m, list_sum(list_transform(list_zip(v.v, c.m), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c) = 1"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND {_FIT})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds):
        parts += [
            f"a{i} AS MATERIALIZED ({to(i)})",
            f"s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j)",
            f"m{i} AS (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{i} GROUP BY c)",
            f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} USING (c))",
        ]
    return f"WITH {', '.join(parts)}, a AS MATERIALIZED ({to(rounds)}) SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CRC-32 in SQL: the table of bytes (t), and a word's bytes (x) taken one after the other.
_IMPORTANCE = f"""WITH t AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN (c & 1) = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM range(256) r(i)),
d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
f AS MATERIALIZED (SELECT n, unnest(w) AS w FROM d), b AS MATERIALIZED (SELECT unnest({_WORDS}) AS w FROM benchmark),
u AS (SELECT w, list_transform(range(strlen(w)), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)) AS x FROM (SELECT w FROM f UNION SELECT w FROM b)),
k AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, x), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k FROM u, t),
s AS (SELECT k, count(*) AS s FROM f JOIN k USING (w) GROUP BY k), r AS (SELECT k, count(*) AS t FROM b JOIN k USING (w) GROUP BY k),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + 10000) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN r USING (k)),
e AS (SELECT n, sum(g) AS weight FROM f JOIN k USING (w) JOIN g USING (k) GROUP BY n),
o AS (SELECT n, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN e USING (n)),
p AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS many FROM o WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= many * 10 // 100 THEN CAST(place AS BIGINT) END AS rank FROM o LEFT JOIN p USING (n)"""

ORACLES: dict[str, str] = {
    "op2_exact_topk": f"""WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {_FIT}),
p AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda t: t[1] * t[2])) AS score FROM v q JOIN v c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM p)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE place <= 5""",
    "op8_embedding_dedup": f"""WITH RECURSIVE u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {_FIT} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS s, b.vec_id AS t FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r(s, t) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
c AS (SELECT s AS vec_id, min(t) AS component_id FROM r GROUP BY s), n AS (SELECT s AS vec_id, count(*) AS n FROM e GROUP BY s)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op11_centroid_clustering": _clusters_sql(),
    "op13_importance_resampling": _IMPORTANCE,
    "op9_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
}
