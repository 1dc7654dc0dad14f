"""The registered queries of the text operators and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, language_id, minhash_dedup, multi_index, ngram_lm, quality_rules, secret_scan, site_quality, source_mix, suffix_dedup, toxicity, vector_codes
from .common import crc_mod, documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document. See secret_scan for the results of odd rows."""
    found = secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secrets")

    def listed(rows):
        return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda x: x["kind"] != "novel")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"), count("novel").alias("n_novel"),
    )


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of three-word shingle sets at a similarity of 0.85 over all documents."""
    found = minhash_dedup.near_duplicates(documents(spark, sf_dir), k=3, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items they contain."""
    return decontaminate.contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return source_mix.mix(documents(spark, sf_dir)).drop("source")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the decision list's verdict on every document."""
    judged = quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in [*base, "base_failed", "kept", "rule"]])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without its repeated 100-byte strings."""
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and offending offsets of every document; labels of the held-out third are not read."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_mod("doc_id", 3) != 1)
    found = toxicity.tag(docs, toxicity.learn(docs, labels))
    spans = F.array_join(F.transform("toxicity.spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= 0.7).cast("int").alias("predicted"), F.size("toxicity.spans").cast("long").alias("n_spans"), spans.alias("spans"))


def op8_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document with its source as host and its language's section as path."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    return site_quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of every document under the counts of all others; order 2, as in OP9_SQL."""
    found = ngram_lm.score(documents(spark, sf_dir), order=2)
    return found.select("doc_id", "n_words", "n_found", F.round("score", 5).alias("score"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every document; the held-out quarter's are not read."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.learn(docs.where((crc_mod("doc_id", 4) != 2) & F.col("lang").isNotNull()))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"), F.array_join(F.map_keys("language.langs"), ",").alias("langs"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-byte codes of every vector under codebooks of 256 entries learned in four rounds."""
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of five filters over every source."""
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all vectors at a cosine of 0.9."""
    return multi_index.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_secret_scan, op2_minhash_dedup, op3_decontaminate, op4_source_mix, op5_quality_rules, op6_suffix_dedup, op7_toxicity, op8_site_quality, op9_ngram_lm, op10_language_id,
        op11_vector_codes, op12_filter_audit, op13_vector_dedup,
    )
    return {f.__name__: f for f in every}


WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP2_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT two.b, reach.r FROM reach JOIN two ON two.a = reach.d WHERE reach.r < two.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(r) AS c FROM reach GROUP BY d) m ON m.d = d.doc_id
"""


def op4_sql(block: int = source_mix.BLOCK, shard: int = source_mix.SHARD, rows: int = source_mix.ROWS, seed: str = source_mix.SEED) -> str:
    def quotas(name: str, of: str, claim: str, seats: str, group: str, ties: str) -> str:
        """Seats by the highest quotients: the floor less a margin is sure, the rest goes quotient by quotient."""
        return f"""
{name}_sure AS (SELECT *, sum({claim}) OVER g AS all_claims, count(*) OVER g AS rivals, CAST(greatest(floor({claim} / nullif(sum({claim}) OVER g, 0) * {seats}) - 2 - count(*) OVER g, 0) AS BIGINT) AS sure FROM {of} WINDOW g AS (PARTITION BY {group})),
{name}_open AS (SELECT *, {seats} - sum(sure) OVER (PARTITION BY {group}) AS left_ FROM {name}_sure),
{name}_seat AS (SELECT *, sure + unnest(range(0, 2 * rivals + 10)) AS k FROM {name}_open),
{name}_rank AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {claim} / (2 * k + 1) DESC, {ties}) AS rk FROM {name}_seat WHERE {claim} > 0),
{name}_won AS (SELECT {ties}, count(*) AS won FROM {name}_rank WHERE rk <= left_ GROUP BY ALL),
{name} AS (SELECT {name}_sure.*, CAST(coalesce(sure, 0) + coalesce(won, 0) AS BIGINT) AS quota FROM {name}_sure LEFT JOIN {name}_won USING ({ties}))"""

    return f"""
WITH RECURSIVE r0 AS (
  SELECT doc_id, source, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, md5(coalesce(text, '')) AS tie FROM documents),
r AS (SELECT *, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || tie || ':' || row_number() OVER (PARTITION BY doc_id, source, size, tie)) AS key FROM r0),
s0 AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, count(*) FILTER (WHERE size > 0) AS n_rows FROM r GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, 2 * n AS cap, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, 1.5 * sum(n) OVER () AS total FROM s0),
fill AS (  -- resharing round by round: a round fills one source at least
  SELECT 0 AS k, sid, cap, CAST(w AS DOUBLE) AS w, total, CAST(0 AS DOUBLE) AS t, false AS full_, count(*) OVER () AS rounds FROM s1
  UNION ALL
  SELECT k + 1, sid, cap, w, total, CASE WHEN full_ THEN cap ELSE least(cap, share) END, full_ OR share >= cap, rounds
  FROM (SELECT *, w * (total - coalesce(sum(cap) FILTER (WHERE full_) OVER (), 0)) / nullif(sum(w) FILTER (WHERE NOT full_) OVER (), 0) AS share FROM fill WHERE k <= rounds)),
tg AS (SELECT s1.sid, source, n, n_rows, round(t, 6) AS t, 1 AS one, CAST(round(sum(round(t, 6)) OVER () / {block}) AS BIGINT) AS seats FROM fill JOIN s1 USING (sid) WHERE k = rounds + 1),
{quotas("sq", "tg", "t", "seats", "one", "sid")},
src AS (SELECT sid, source, CAST(n AS BIGINT) AS source_size, t AS target, quota AS source_quota, CAST(round(t) AS BIGINT) - quota * {block} AS beyond,
  CAST(greatest(ceil(n / {shard}), ceil(n_rows / {rows}.0), 1) AS BIGINT) AS shards FROM sq),
d AS (SELECT r.*, sid, source_size, target, source_quota, beyond, CAST('0x' || substr(key, 25, 8) AS BIGINT) % shards AS shard FROM r JOIN src ON r.source IS NOT DISTINCT FROM src.source),
sh AS (SELECT sid, shard, CAST(sum(size) AS BIGINT) AS shard_size, CAST(sum(size) AS DOUBLE) AS claim, any_value(source_quota) AS source_quota, any_value(beyond) AS beyond FROM d WHERE size > 0 GROUP BY sid, shard),
{quotas("hq", "sh", "claim", "source_quota", "sid", "sid, shard")},
hw AS (SELECT *, least(greatest(quota * {block} + CASE WHEN shard = min(shard) OVER (PARTITION BY sid) THEN beyond ELSE 0 END, 0), 2 * shard_size) AS words FROM hq),
hr AS (SELECT sid, shard, shard_size, words // shard_size AS whole, words % shard_size AS rest FROM hw),
b0 AS (SELECT *, unnest(range(0, CAST(ceil(shard_size / {block}.0) AS BIGINT))) AS b FROM hr),
b1 AS (SELECT *, least({block}, shard_size - b * {block}) AS len, md5('{seed}:' || sid || ':' || shard || ':' || b) AS bkey FROM b0),
b2 AS (SELECT sid, shard, b, least(greatest(rest - coalesce(sum(len) OVER (PARTITION BY sid, shard ORDER BY bkey, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), len) AS cut FROM b1),
laid AS (SELECT d.*, whole, coalesce(sum(size) OVER (PARTITION BY sid, shard ORDER BY key, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, row_number() OVER () AS row_ FROM d JOIN hr USING (sid, shard) WHERE size > 0),
took AS (SELECT row_, sum(greatest(least(start + size, b * {block} + cut) - greatest(start, b * {block}), 0)) AS more FROM laid JOIN b2 USING (sid, shard) WHERE b * {block} < start + size AND (b + 1) * {block} > start GROUP BY row_)
SELECT doc_id, size, source_size, target, CAST(whole * size + more AS BIGINT) AS taken FROM laid JOIN took USING (row_)
UNION ALL SELECT doc_id, size, source_size, target, CAST(0 AS BIGINT) FROM d WHERE size = 0
"""


OP4_SQL = op4_sql()


OP9_SQL = f"""
WITH w AS (
  SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
t AS (SELECT doc_id, unnest(list_prepend('', ws)[:len(ws)]) AS v, unnest(ws) AS w FROM w WHERE len(ws) > 0),
own AS (SELECT doc_id, v, w, count(*) AS n FROM t GROUP BY ALL),
pair AS (SELECT v, w, sum(n) AS c FROM own GROUP BY ALL),
head AS (SELECT v, count(*) AS c FROM t GROUP BY v),
word AS (SELECT w, count(*) AS c FROM t GROUP BY w),
s AS (
  SELECT own.doc_id, own.n, pair.c > own.n AS seen,
    CASE WHEN pair.c > own.n THEN log10(pair.c - own.n) - log10(head.c) ELSE log10(0.4) + log10(word.c) - log10((SELECT count(*) FROM t)) END AS x
  FROM own JOIN pair USING (v, w) JOIN head USING (v) JOIN word USING (w)),
d AS (SELECT doc_id, sum(n) AS n, sum(n) FILTER (WHERE seen) AS f, sum(n * x) AS x FROM s GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_words, CAST(coalesce(d.f, 0) AS BIGINT) AS n_found, round(x / d.n, 5) AS score FROM documents LEFT JOIN d USING (doc_id)
"""


def op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Plain Lloyd rounds; doubles hold squared distances of such integers exactly."""
    gap = "list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x)"
    ctes = [
        "v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))",
        f"p AS (SELECT r, vec_id, q, e[q * len(e) // {parts} + 1:(q + 1) * len(e) // {parts}] AS x FROM v, range({parts}) t(q))",
        f"c0 AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS k, x FROM p JOIN (SELECT r FROM v ORDER BY vec_id LIMIT {entries}) USING (r))",
    ]
    for t in range(rounds + 1):
        ctes.append(f"a{t} AS (SELECT r, q, min(({gap}) * {entries} + k) AS d FROM p JOIN c{t} c USING (q) GROUP BY r, q)")
        if t < rounds:
            ctes += [
                f"m{t} AS (SELECT q, CAST(d AS BIGINT) % {entries} AS k, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS s FROM a{t} JOIN p USING (r, q))",
                f"n{t} AS (SELECT q, k, list(s ORDER BY i) AS x FROM (SELECT q, k, i, floor(sum(s) / count(*)) AS s FROM m{t} GROUP BY q, k, i) GROUP BY q, k)",
                f"c{t + 1} AS (SELECT q, k, coalesce(n{t}.x, c{t}.x) AS x FROM c{t} LEFT JOIN n{t} USING (q, k))",
            ]
    return f"""
WITH {", ".join(ctes)},
f AS (SELECT r, string_agg(printf('%02x', CAST(d AS BIGINT) % {entries}), '' ORDER BY q) AS code, CAST(sum(CAST(d AS BIGINT) // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY q, k)) FROM c{rounds}) AS codebooks_sha256
FROM v JOIN f USING (r)
"""


OP12_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
f AS (SELECT *, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id),
g AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
  count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT x1.k || x2.k || x3.k || x4.k || x5.k AS o FROM x x1, x x2, x x3, x x4, x x5 WHERE len(list_distinct([x1.k, x2.k, x3.k, x4.k, x5.k])) = 5),
s AS (SELECT o, CAST(step AS INT) AS step, o[step] AS k, o[1:step - 1] AS before, o[1:step] AS upto FROM o, range(1, 6) t(step)),
r AS (SELECT part, o, step, k, n, good, bad, fails, contains(fails, k) AS failing, len(translate(fails, before, '')) < len(fails) AS gone, len(translate(fails, upto, '')) < len(fails) AS gone_then FROM g, s),
y AS (SELECT part, o AS filter_order, step, k, sum(CASE WHEN NOT gone_then THEN n ELSE 0 END) AS kept, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN failing AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = k THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN failing AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failing AND NOT gone THEN bad ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM y
"""


#: Every pair; the index meets all of them on small tables, where a vector visits most of its few cells.
OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
two AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a AS vec_id, count(*) AS n FROM two GROUP BY a),
reach AS (SELECT vec_id AS d, vec_id AS r FROM embeddings UNION SELECT two.b, reach.r FROM reach JOIN two ON two.a = reach.d WHERE reach.r < two.b)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT d AS vec_id, min(r) AS component_id FROM reach GROUP BY d) LEFT JOIN n USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_vector_codes": op11_sql(), "op12_filter_audit": OP12_SQL, "op13_vector_dedup": OP13_SQL, "op2_minhash_dedup": OP2_SQL, "op4_source_mix": OP4_SQL, "op9_ngram_lm": OP9_SQL}
