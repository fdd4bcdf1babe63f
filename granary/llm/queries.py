"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, filter_audit, fuzzy_lines, hard_negatives, jaccard, mixing, nra, ogg, suffix_tree, suffixes, token_counts, token_files, toxicity
from granary.llm.common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op3_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.drop_similar_lines(table(spark, sf_dir, "documents"))


def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", F.round("rate", 9).alias("rate"), F.col("copy").cast("int").alias("copy"))


def op11_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [v for k, v in globals().items() if k.startswith("op") and callable(v)]
    return {f.__name__: f for f in own}


OP3_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') w FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') w FROM documents),
item AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) s FROM i),
doc AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) s FROM d),
n AS (SELECT item_id, count(*) n_shingles FROM item GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM item JOIN doc USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles
HAVING count(*) >= 0.8 * n_shingles - 1e-9
"""

OP10_SQL = """
WITH RECURSIVE sizes AS (SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source),
rates AS (SELECT source, 1.0 * (SELECT sum(size) FROM sizes) * (pow(size, 0.5) / (SELECT sum(pow(size, 0.5)) FROM sizes)) / size AS rate FROM sizes),
steps AS (
  SELECT source, rate, 0 AS k, -rate AS lg, exp(-rate) AS total FROM rates
  UNION ALL
  SELECT source, rate, k + 1, lg + ln(rate) - ln((k + 1)::DOUBLE), total + exp(lg + ln(rate) - ln((k + 1)::DOUBLE)) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
),
u AS (SELECT doc_id, source, text, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / pow(2, 52) AS u FROM documents),
counts AS (SELECT u.doc_id, u.source, u.text, s.rate, count(*) FILTER (s.total <= u.u) AS n FROM u JOIN steps s ON u.source IS NOT DISTINCT FROM s.source GROUP BY ALL)
SELECT doc_id, source, text, round(rate, 9) AS rate, unnest(range(0, n))::INTEGER AS copy FROM counts WHERE n > 0
"""


VECTORS_SQL = """
v AS (
  SELECT DISTINCT ON (vec_id) vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  ORDER BY vec_id, v
),
pairs AS (
  SELECT q.vec_id AS a, q.label AS la, c.vec_id AS b, c.label AS lb, list_sum(list_transform(range(1, len(q.v) + 1), lambda k: q.v[k] * c.v[k]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)"""

OP11_SQL = f"""
WITH {VECTORS_SQL},
ranked AS (SELECT a AS query_id, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INTEGER AS rank, b AS vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP13_SQL = f"""
WITH {VECTORS_SQL},
marked AS (
  SELECT a, b, score, CASE WHEN a % 7 = 0 THEN (la + 1) % 10 ELSE la END AS x, CASE WHEN b % 7 = 0 THEN (lb + 1) % 10 ELSE lb END AS y
  FROM pairs WHERE la IS NOT NULL AND lb IS NOT NULL
),
positive AS (SELECT a, b AS p, score AS ps FROM marked WHERE x = y QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
ranked AS (
  SELECT a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY a, p ORDER BY score DESC, b)::INTEGER AS rank, b AS negative_id, ps AS positive_score, score AS negative_score
  FROM positive JOIN marked USING (a) WHERE x <> y AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps
)
SELECT * FROM ranked WHERE rank <= 3
"""

OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM words LEFT JOIN marks USING (doc_id)
),
counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
tested AS (SELECT c.*, s.*, contains(fails, f) AS here, length(translate(fails, before, '')) < length(fails) AS earlier FROM counted c, steps s),
summed AS (
  SELECT part, filter_order, step::INTEGER AS step, f, coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (here AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (here AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (here AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM tested GROUP BY ALL
)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM summed
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_containment": OP3_SQL, "op10_mixture": OP10_SQL, "op11_nra_topk": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_hard_negatives": OP13_SQL}
