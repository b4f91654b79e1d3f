"""The registered queries of this package, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nbgauge.llm import codes, decontaminate, divergence, fixity, hilbert, language, packing, quality, simhash, subspaces, substrings, topk, toxicity
from nbgauge.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in two replicas, the second damaged by rules of the id; the damage found."""
    pages = table(spark, sf_dir, "pages")
    record = fixity.warc_record(F.col("url"), F.col("page_id"), F.col("html"))
    half = F.floor(F.length("record") / 2).cast("int")
    flipped = F.concat(F.expr("substring(record, 1, int(floor(length(record) / 2)))"), F.lit("#"), F.expr("substring(record, int(floor(length(record) / 2)) + 2)"))
    damaged = (
        F.when(F.col("page_id") % 97 == 13, flipped).when(F.col("page_id") % 103 == 29, F.substring("record", F.lit(1), half)).otherwise(F.col("record"))
    )
    # Digests are taken where the pages are read; payloads are not moved.
    digests = pages.select("page_id", record.alias("record")).select(
        "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), F.sha2(damaged, 256).alias("copy_digest")
    )
    placed = fixity.place_records(digests, "page_id", "length").withColumnRenamed("page_id", "record_id")
    from nbgauge.session import cut_lineage

    placed = cut_lineage(placed)
    left = placed.where("coalesce(record_id, 0) % 107 <> 31").select("archive", "offset", "digest", "record_id")
    right = placed.where("coalesce(record_id, 0) % 101 <> 17").select("archive", "offset", F.col("copy_digest").alias("digest"), "record_id")
    return fixity.audit(left, right)


_WARC = (
    "concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), "
    "'WARC-Record-ID: <urn:page:', coalesce(CAST(page_id AS VARCHAR), ''), '>', chr(13), chr(10), 'Content-Length: ', "
    "CAST(strlen(coalesce(html, '')) AS VARCHAR), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10))"
)
ORACLES["op1_merkle_fixity"] = f"""
WITH records AS (SELECT page_id, {_WARC} AS record FROM pages),
both_ AS (
  SELECT page_id, strlen(record) AS bytes, sha256(record) AS digest,
         sha256(CASE WHEN page_id % 97 = 13
                     THEN concat(substr(record, 1, length(record) // 2), '#', substr(record, length(record) // 2 + 2))
                     WHEN page_id % 103 = 29 THEN substr(record, 1, length(record) // 2) ELSE record END) AS copy_digest
  FROM records),
placed AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY page_id, bytes, digest, copy_digest) - bytes AS BIGINT) AS at_ FROM both_),
sides AS (
  SELECT at_ // 67108864 AS archive, at_ % 67108864 AS "offset", page_id,
         CASE WHEN page_id % 107 <> 31 THEN digest END AS left_digest, CASE WHEN page_id % 101 <> 17 THEN copy_digest END AS right_digest
  FROM placed)
SELECT archive, "offset", CASE WHEN right_digest IS NULL THEN 'missing' WHEN left_digest IS NULL THEN 'extra' ELSE 'changed' END AS status,
       page_id AS record_id, left_digest, right_digest,
       CAST(CASE WHEN left_digest IS NOT NULL THEN 1 END AS BIGINT) AS left_records,
       CAST(CASE WHEN right_digest IS NOT NULL THEN 1 END AS BIGINT) AS right_records
FROM sides WHERE left_digest IS DISTINCT FROM right_digest"""


@query
def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.hilbert_shards(table(spark, sf_dir, "documents"))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


@query
def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op5_histogram_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vector, c.vector) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query
def op6_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op7_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.predict_languages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


@query
def op11_adaptive_bound_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


def _codes_sql(rounds: int = codes.ROUNDS, entries: int = codes.ENTRIES) -> str:
    """Every part against every entry, round by round."""
    steps = [
        "v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS i, vec_id, label, "
        f"list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * x::DOUBLE) AS BIGINT)) AS c FROM embeddings "
        "WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "u AS (SELECT i, c, len(c) // 4 AS w, unnest(range(len(c))) AS at_ FROM v)",
        "x AS (SELECT i, at_ // w AS p, at_ % w AS d, c[at_ + 1] AS value FROM u)",
        f"b0 AS (SELECT p, i AS e, d, value FROM x WHERE i < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"s{r} AS (SELECT x.i, x.p, b.e, sum((x.value - b.value) * (x.value - b.value)) AS far FROM x JOIN b{r} b ON x.p = b.p AND x.d = b.d GROUP BY ALL)"
        )
        steps.append(f"a{r} AS MATERIALIZED (SELECT i, p, min(far * {entries} + e) % {entries} AS e, min(far * {entries} + e) // {entries} AS far FROM s{r} GROUP BY ALL)")
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT x.p, a.e, x.d, floor(sum(x.value) / count(*)::DOUBLE) AS value FROM x JOIN a{r} a ON x.i = a.i AND x.p = a.p GROUP BY ALL)"
            )
            steps.append(
                f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, b.d, CAST(coalesce(m.value, b.value) AS BIGINT) AS value "
                f"FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e AND b.d = m.d)"
            )
    steps.append(f"books AS (SELECT sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY p, e, d)) AS digest FROM b{rounds})")
    steps.append(
        f"coded AS (SELECT i, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY i)"
    )
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
        "digest AS codebooks_sha256 FROM coded JOIN v USING (i) CROSS JOIN books"
    )


ORACLES["op11_adaptive_bound_codes"] = _codes_sql()


@query
def op12_divergence_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op12_divergence_cube"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (
  SELECT d.lang, d.source, coalesce(any_value(t.total), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) d
  LEFT JOIN (SELECT c.lang, c.source, sum(c.n) AS total FROM c JOIN kept k ON c.lang = k.lang AND c.term = k.term GROUP BY ALL) t
    ON d.lang = t.lang AND d.source = t.source GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM g JOIN langs l ON g.lang = l.lang JOIN kept k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(any_value(s.value), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY ALL),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


@query
def op13_subspace_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspaces.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op13_subspace_near_duplicates"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS i, vec_id,
         CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0
              THEN embedding::DOUBLE[] END AS e FROM embeddings),
links AS (
  SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON a.i <> b.i AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach AS (SELECT i AS a, i AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
small AS (SELECT r.a, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.i = r.b GROUP BY r.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, vec_id IS NULL AND component_id IS NULL) AS kept
FROM v JOIN small ON small.a = v.i LEFT JOIN n ON n.a = v.i"""
