"""The operators' registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm import fingerprints, hard_negatives, language, lexical_search, maxent_lm, mixing, near_duplicates, ordinal_quality, packing, pages, quality_rules, repeats, toxicity
from veriframe.llm.common import cut, held_out, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and likenesses, and for every id divisible by 50 the number of other fingerprints in the corpus
    within the radius (null for the rest, which are searched but not queries)."""
    made = cut(fingerprints.fingerprint_with_edits(table(spark, sf_dir, "documents")))
    is_query = F.col("doc_id") % 50 == 0
    found = fingerprints.within_radius(made.filter(is_query), made)
    near = found.groupBy(F.col("query").alias("fingerprint")).agg(F.count("*").alias("_near"))
    joined = made.join(near, "fingerprint", "left").withColumn("n_within_radius", F.when(is_query, F.coalesce("_near", F.lit(0))))
    return joined.select(*made.columns, "n_within_radius")


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", ordinal_quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    scored = ordinal_quality.score(docs, ordinal_quality.train(docs, ratings))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", "kept")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.valid_rows(table(spark, sf_dir, "embeddings"), moved)
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(*maxent_lm.train(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_page_text, op3_mix, op4_pack, op5_quality_rules, op6_repeats, op7_toxicity,
        op8_near_duplicates, op9_ordinal_quality, op10_language, op11_lexical_search, op12_hard_negatives, op13_language_model,
    )
}

#: DuckDB SQL for the queries that SQL expresses; the others are held against brute force in tests/llm. The near-duplicate
#: classes are the components of exact multiset similarities, whatever way candidates were found.
ORACLES: dict[str, str] = {
    "op8_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT text, min(doc_id) AS rep, any_value(ws) AS ws FROM w WHERE len(ws) > 0 GROUP BY text),
c AS (SELECT rep, unnest(CASE WHEN len(ws) <= 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM t),
m AS (SELECT rep, g, count(*) AS n FROM c GROUP BY rep, g),
z AS (SELECT rep, CAST(sum(n) AS DOUBLE) AS n FROM m GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, CAST(sum(least(a.n, b.n)) AS DOUBLE) AS shared FROM m a JOIN m b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN z x ON x.rep = a JOIN z y ON y.rep = b WHERE shared / (x.n + y.n - shared) >= CAST(0.8 AS DOUBLE)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT rep, rep FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
k AS (SELECT node, min(root) AS root FROM r GROUP BY node),
d AS (SELECT w.doc_id, k.root FROM w JOIN t ON t.text = w.text JOIN k ON k.node = t.rep)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, count(*) OVER (PARTITION BY root) AS class_size, doc_id = min(doc_id) OVER (PARTITION BY root) AS kept FROM d
UNION ALL SELECT doc_id, doc_id, 1, true FROM w WHERE len(ws) = 0""",
    "op11_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
g AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, g GROUP BY term, n_docs),
i AS (SELECT p.row, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ts) * n_docs) // n_terms)) AS impact FROM p JOIN d USING (row), g),
s AS (SELECT item_id, row, CAST(sum(w * impact) AS BIGINT) AS score FROM q JOIN i USING (term) JOIN w USING (term) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s JOIN d USING (row) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 50""",
    "op12_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
