"""Named queries over whole tables, next to their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forelake.llm import fingerprints, langid, licenses, linededup, mixing, neighbours, packing, pages, pivots, resampling, runs, simhash, substrings
from forelake.llm.common import WORD, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LINE_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (SELECT *, {_LOWER.format("trim(line, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13)))")} AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT keyed.*, coalesce(doc_id > first_doc, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pieces = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken(rows, pieces).select("doc_id", "size", "source_size", "target", "taken")


_MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, 2 * source_size AS most FROM per),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM placed),
turns AS (SELECT *, row_number() OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST) AS turn FROM weighed),
leveled AS (
    SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE
               - coalesce(sum(most) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
              / (sum(weight) OVER (ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM turns),
opened AS (SELECT arg_min(level, turn) AS level FROM leveled WHERE level * weight < most),
targets AS (SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT level FROM opened) * weight, most::DOUBLE)) AS target FROM leveled),
passes AS (
    SELECT d.doc_id, d.source, d.size, t.source_size, t.target, p.pass
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (SELECT unnest([0, 1]) AS pass) p),
laid AS (
    SELECT *, pass * source_size + coalesce(sum(size) OVER (
        PARTITION BY source, pass ORDER BY md5(concat(coalesce(doc_id::VARCHAR, ''), '|', pass::VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low
    FROM passes)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(low + size, floor(target)::BIGINT) - low))::BIGINT AS taken
FROM laid GROUP BY doc_id, size, source_size, target
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_NOTICES = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in licenses.TEMPLATES.items())
_LICENSE_SQL = f"""
WITH words AS (
    SELECT 0 AS kind, doc_id, NULL AS license, [lower(x) for x in regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')] AS w FROM documents
    UNION ALL SELECT 1, NULL, name, [lower(x) for x in regexp_extract_all(text, '[A-Za-z0-9]+')] FROM (VALUES {_NOTICES}) AS t(name, text)),
runs AS (
    SELECT kind, doc_id, license, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) AS s,
           unnest(range(0, len(w) - 4)) AS pos
    FROM words WHERE len(w) >= 5),
notices AS (SELECT DISTINCT license, s FROM runs WHERE kind = 1),
sized AS (SELECT license, count(*) AS n, pow(2, ceil(log2(count(*))))::BIGINT AS half FROM notices GROUP BY license),
hits AS (
    SELECT r.doc_id, n.license, z.n, z.half, r.s, r.pos // z.half - b.back AS win
    FROM runs r JOIN notices n USING (s) JOIN sized z ON z.license = n.license CROSS JOIN (VALUES (0), (1)) AS b(back)
    WHERE r.kind = 0),
counted AS (
    SELECT doc_id, license, n, win * half AS start, count(DISTINCT s) AS matched FROM hits WHERE win >= 0
    GROUP BY doc_id, license, n, win, half HAVING count(DISTINCT s) >= n * 0.8),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY matched DESC, start) AS place FROM counted)
SELECT doc_id, license, matched, n AS template_shingles, matched::DOUBLE / n AS containment, start AS first_shingle FROM best WHERE place = 1
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


_TOP_SQL = """
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM kept q JOIN kept c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 20
"""


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the checksum of the id is a multiple of 10, words from a place on repeat the words that start there."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", text.alias("text"), h.alias("h")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    unit = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    edited = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), again), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(looped(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    # Runs ascend by start and period, so the first of equal exponents stays.
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.withColumn("best", best)
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")], exponent.cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_packing, op2_line_dedup, op3_neighbours, op4_simhash, op5_mixing, op6_language, op7_html, op8_license_scan, op9_suffix_dedup, op10_fingerprints, op11_exact_top_k, op12_periodic_runs, op13_resampling)}
SQL = {"op8_license_scan": _LICENSE_SQL, "op2_line_dedup": _LINE_SQL, "op5_mixing": _MIX_SQL, "op11_exact_top_k": _TOP_SQL}
