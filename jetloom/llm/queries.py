"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetloom.llm import block_labeller, centroids, compression_toxicity, factorization, packing, semimarkov, spelling, warc
from jetloom.llm.compression_toxicity import held_out
from jetloom.llm.cuckoo import exact_groups
from jetloom.llm.decontaminate import leaks
from jetloom.llm.mixing import mix
from jetloom.llm.odd_sketch import QUERY_PLAN, near_components
from jetloom.llm.repeats import repeats
from jetloom.llm.text import SPACE_REGEX


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in the mix."""
    return mix(table(spark, sf_dir, "documents"))


def op2_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the passages."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicate groups."""
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components."""
    return near_components(table(spark, sf_dir, "documents"), QUERY_PLAN)


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = compression_toxicity.score(docs, compression_toxicity.fit_on(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derive(warc.responses(table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def op7_lyndon_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the byte strings that occur twice."""
    return repeats(table(spark, sf_dir, "documents"))


def op8_factorization_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = factorization.score(docs, factorization.fit_on(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op9_block_lstm_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return block_labeller.extract(pages, block_labeller.fit_on(pages))


def op10_semimarkov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return semimarkov.find(docs, semimarkov.fit_on(docs))


def op11_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op12_trie_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their near words and the forms they vary."""
    return spelling.variants(table(spark, sf_dir, "documents"), spelling.QUERY_PLAN)


def op13_bisector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (
        op1_cube_mix, op2_spaced_seed_leaks, op3_cuckoo_dedup, op4_odd_sketch_dedup, op5_compression_toxicity,
        op6_warc_derivatives, op7_lyndon_repeats, op8_factorization_quality, op9_block_lstm_extract, op10_semimarkov_pii, op11_residual_packing,
        op12_trie_variants, op13_bisector_clusters,
    )
}


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _warc_sql() -> str:
    def name(*parts: str) -> str:
        h = f"sha256(concat_ws('|', {', '.join(parts)}))"
        return f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-8' || {h}[13:15] || '-8' || {h}[16:18] || '-' || {h}[19:30] || '>'"

    text = f"regexp_replace(regexp_replace(regexp_replace(payload, {_sql_text(warc._SILENT)}, ' ', 'g'), '{SPACE_REGEX}', ' ', 'g'), {_sql_text(warc._BREAKS)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {_sql_text(warc._TAGS)}, '', 'g')"
    for reference, char in warc._REFERENCES:
        text = f"replace({text}, {_sql_text(reference)}, {_sql_text(char)})"
    text = rf"regexp_replace(regexp_replace({text}, ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    crlf = "chr(13) || chr(10)"
    return f"""
        WITH r AS (
            SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages
        ), s AS (
            SELECT *, 'sha256:' || sha256(payload) AS payload_digest, strlen(payload) AS size,
                   {name("'response'", "coalesce(page_id::VARCHAR, '')", "target_uri", "'sha256:' || sha256(payload)")} AS refers_to
            FROM r
        ), d AS (
            SELECT page_id, target_uri, payload_digest, refers_to, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
                   'source-payload-digest: ' || payload_digest || {crlf} || 'source-payload-length: ' || size || {crlf}
                   || 'http-header: HTTP/1.1 200 OK' || {crlf} || 'http-header: Content-Type: text/html; charset=utf-8' || {crlf}
                   || 'http-header: Content-Length: ' || size || {crlf} AS block
            FROM s
            UNION ALL
            SELECT page_id, target_uri, payload_digest, refers_to, 'conversion', 'text/plain; charset=utf-8', {text} FROM s
        )
        SELECT page_id, record_type, {name("record_type", "refers_to")} AS record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' AS date,
               content_type, block, 'sha256:' || sha256(block) AS block_digest, payload_digest, strlen(block)::BIGINT AS content_length
        FROM d
    """


def _clusters_sql(plan: centroids.CentroidPlan = centroids.CentroidPlan()) -> str:
    """Plain nearest centroids, one pair of common table expressions a round."""
    gap = f"list_sum(list_transform(range(1, {plan.dims} + 1), lambda i: (x[i] - m[i]) * (x[i] - m[i])))::BIGINT"
    parts = [
        f"""v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {plan.scale})::BIGINT) AS x
            FROM embeddings
            WHERE len(embedding) = {plan.dims}
              AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {plan.dims}
        )""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{plan.seed}:' || vec_id), x) - 1 AS c, x AS m
            FROM v ORDER BY sha256('{plan.seed}:' || vec_id), x LIMIT {plan.clusters}
        )""",
    ]
    for k in range(plan.rounds + 1):
        parts.append(
            f"""a{k} AS MATERIALIZED (
            SELECT r, best.c AS c, best.d AS d
            FROM (SELECT r, min({{'d': {gap}, 'c': c}}) AS best FROM v, c{k} GROUP BY r)
        )"""
        )
        if k < plan.rounds:
            parts.append(
                f"""c{k + 1} AS MATERIALIZED (
            SELECT c{k}.c, coalesce(moved.m, c{k}.m) AS m
            FROM c{k} LEFT JOIN (
                SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS m
                FROM (
                    SELECT c, i, sum(x[i]) AS s, count(*) AS n
                    FROM a{k} JOIN v USING (r), range(1, {plan.dims} + 1) AS p(i) GROUP BY c, i
                ) GROUP BY c
            ) AS moved ON moved.c = c{k}.c
        )"""
            )
    last = plan.rounds
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, a{last}.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{last}.c))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{last} JOIN v USING (r) JOIN c{last} ON a{last}.c = c{last}.c
    """


ORACLE_SQL: dict[str, str] = {
    "op3_cuckoo_dedup": f"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE_REGEX}', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op6_warc_derivatives": _warc_sql(),
    "op13_bisector_clusters": _clusters_sql(),
}
