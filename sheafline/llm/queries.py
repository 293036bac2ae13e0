"""The registered queries of the operators on training text, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import (
    bpe, centroids, decontaminate, importance, language, pieces, pii, secrets, simhash, spans, substrings, tokens, topk, toxicity,
)
from sheafline.llm.common import fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows."""

    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(column: str) -> Column:
    return F.sha2(spans.written(F.col(column)).cast("binary"), 256)


def _number(column: str, kind: str, name: str) -> Column:
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long").alias(name)


@query("op1_secrets")
def op1_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.fit(docs))
    counts = [_number("base", kind, f"n_{kind}") for kind in secrets.KINDS]
    return found.select("doc_id", *counts, _digest("base").alias("base_sha256"), spans.written(F.col("spans")).alias("spans"))


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out)
    return toxicity.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op3_substrings", r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM words),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts JOIN words USING (doc_id)),
later AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM later),
removed AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, k: ps IS NULL OR NOT list_contains(ps, k)), ' ')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id)""")
def op3_substrings(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query("op4_pieces")
def op4_pieces(spark, sf_dir):
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_personal_data")
def op5_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.fit(docs))
    counts = [_number("base", kind, f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, _digest("base").alias("base_sha256"), spans.written(F.col("spans")).alias("spans"))


@query("op6_simhash")
def op6_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fingerprint").alias("fingerprint"), "component_id")


@query("op7_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5""")
def op7_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query("op8_language")
def op8_language(spark, sf_dir):
    docs, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2
    return language.identify(docs, language.fit(docs, held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "window", "start")


@query("op10_tokens")
def op10_tokens(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_bpe")
def op11_bpe(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    made = bpe.decode_texts(bpe.encode_texts(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    written = F.array_join(F.col("ids").cast("array<string>"), ",")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op12_importance", r"""
WITH steps AS (SELECT n, list_reduce(list_prepend(n, range(8)),
                 lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(n)),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY n) AS c FROM steps),
docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
source AS MATERIALIZED (SELECT doc_id, unnest(w) AS f FROM docs),
target AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
coded AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM source UNION SELECT f FROM target)),
buckets AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295,
           list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT))),
           lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM coded, crc_table),
s AS (SELECT bucket, count(*) AS s FROM source JOIN buckets USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target JOIN buckets USING (f) GROUP BY bucket),
gains AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM source) + 10000)::DOUBLE
           / ((s + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT doc_id, sum(gain) AS g, count(*) AS n FROM source JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
weights AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce((g - ((g % n) + n) % n) // n, 0) AS BIGINT) AS weight
            FROM docs LEFT JOIN sums USING (doc_id)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))
             AS BIGINT) AS score FROM weights),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)""")
def op12_importance(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and floored means, written out."""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS w
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), w) - 1 AS cluster, w AS m FROM v
  ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), w LIMIT {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(w) AS w, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT r, vec_id, w, cluster, CAST(list_sum(list_transform(list_zip(w, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM v, c{i}) GROUP BY r)""")
        if i < rounds:
            parts.append(f"""p{i} AS (SELECT cluster, k, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(w) AS x, unnest(range(1, 65)) AS k FROM a{i})
  GROUP BY cluster, k),
m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS m FROM p{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


@query("op13_centroids", _centroid_sql())
def op13_centroids(spark, sf_dir):
    found, final = centroids.cluster(table(spark, sf_dir, "embeddings"))
    names = spark.createDataFrame(list(enumerate(centroids.digests(final))), "cluster int, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select(*found.columns, "centroid_sha256")
