"""Retrieval evaluation: each component of a search is a condition, what was served is the judgement."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.tokens import STOPWORDS, word_runs
from quernstone.operators import evaluation as e
from quernstone.operators import lexical
from quernstone.operators.components import connected_components
from quernstone.operators.ranks import order_statistics
from quernstone.operators.usage import caller_class, nearest_rank
from quernstone.queries import common as c
from quernstone.queries.catalogue import _CALLER
from quernstone.sources import read_table

K = 10


def _rankings(spark: SparkSession, d: str) -> DataFrame:
    h = c.hits(spark, d).select(F.col("component").alias("condition"), F.col("search_id").alias("query_id"), "chunk_id", "score")
    h = h.withColumn("_g", F.struct("condition", "query_id"))
    return lexical.ranked(h, group="_g").select("condition", "query_id", "chunk_id", "rank")


def _served(spark: SparkSession, d: str) -> DataFrame:
    return c.appearances(spark, d).groupBy(F.col("search_id").alias("query_id"), "chunk_id").agg(F.min("rank").alias("served"))


def _known_item(spark: SparkSession, d: str) -> DataFrame:
    return e.known_item(_rankings(spark, d), _served(spark, d).where("served <= 2").select("query_id", "chunk_id"), K)


def q_mrr_success_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return _known_item(spark, d)


def q_metrics_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Means per component, and per component and caller, by grouping sets."""
    callers = c.searches(spark, d).select(F.col("search_id").alias("query_id"), caller_class(F.col("caller")).alias("caller"))
    return e.by_grain(_known_item(spark, d).join(callers, "query_id"), "caller").withColumn("over_all", F.col("over_all").cast("int"))


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return e.graded(_rankings(spark, d), _served(spark, d).select("query_id", "chunk_id", (5 - F.col("served")).alias("grade")), K)


def q_pooled_graded_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d)


def _paired(spark: SparkSession, d: str, a: str, b: str) -> DataFrame:
    callers = c.searches(spark, d).select(F.col("search_id").alias("query_id"), caller_class(F.col("caller")).alias("caller"))
    return e.paired_differences(_graded(spark, d).join(callers, "query_id"), "graded_ndcg", a, b, "caller")


def q_paired_family_difference(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d, "dense", "bm25")


def q_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for a, b in (("dense", "bm25"), ("rerank", "bm25")):
        part = _paired(spark, d, a, b).withColumn("comparison", F.lit(f"{a} - {b}"))
        rows = part if rows is None else rows.unionByName(part)
    return e.cluster_bootstrap(rows.select("comparison", "family", "difference"))


def q_paired_ratio_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """How long other callers' searches took against the agent's of the same generation: the fastest agent search is the baseline."""
    log = c.searches(spark, d).where("generation_id IS NOT NULL").select("search_id", "generation_id", caller_class(F.col("caller")).alias("caller"), "elapsed_ms")
    return nearest_rank(e.paired_ratios(log, ["generation_id"], "caller", "elapsed_ms", "agent"), ["caller"], "ratio", {"p50": 0.5, "p95": 0.95})


def q_determinism_check(spark: SparkSession, d: str) -> DataFrame:
    """Searches repeated with the same query, filters and generation: how many, and how many different answers."""
    answers = c.appearances(spark, d).groupBy("search_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]), " ").alias("answer"))  # at most five
    log = c.searches(spark, d).where("query_text IS NOT NULL AND generation_id IS NOT NULL").join(answers, "search_id", "left")
    grouped = log.groupBy("query_text", "generation_id", F.coalesce("filters", F.lit("")).alias("filters")).agg(F.count(F.lit(1)).alias("runs"), F.count_distinct(F.coalesce("answer", F.lit(""))).alias("answers"))
    return grouped.where("runs > 1")


def q_content_overlap(spark: SparkSession, d: str) -> DataFrame:
    served = c.appearances(spark, d).where("rank = 1").select(F.col("search_id").alias("query_id"), "chunk_id")
    rows = served.join(c.text_queries(spark, d), "query_id").join(c.chunks(spark, d, "contents"), "chunk_id")
    return rows.select("query_id", "chunk_id", F.round(e.lexical_overlap(F.col("query"), F.col("contents"), STOPWORDS), 6).alias("overlap"))


def _slots(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of each search with their texts: what is served is picked from them, freed of most repetitions."""
    return c.hits(spark, d).select("search_id", "chunk_id").distinct().join(c.chunks(spark, d, "contents", "source_id"), "chunk_id")


def q_shingle_containment(spark: SparkSession, d: str) -> DataFrame:
    """Candidates contained in another candidate of the same search."""
    return e.contained_repetitions(_slots(spark, d), "search_id")


def q_protected_signature(spark: SparkSession, d: str) -> DataFrame:
    return c.chunks(spark, d, "contents").select("chunk_id", e.protected_signature(F.col("contents")).alias("signature"))


def q_exact_duplicate_slots(spark: SparkSession, d: str) -> DataFrame:
    """Texts, white space aside, that are candidates of the recorded searches under several chunk ids."""
    text = F.trim(F.regexp_replace("contents", r"\s+", " "))
    return _slots(spark, d).groupBy(F.sha2(text, 256).alias("text_sha256")).agg(F.count_distinct("chunk_id").alias("copies"), F.count_distinct("source_id").alias("sources"), F.count_distinct("search_id").alias("searches")).where("copies > 1")


def q_repetition_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of served (search, passage) slots whose passage answered more than one search, and more than one generation."""
    slots = c.appearances(spark, d).select("search_id", "chunk_id").distinct().join(c.searches(spark, d).select("search_id", "generation_id"), "search_id")
    per = slots.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("generation_id").alias("g"))
    return per.agg(F.sum("n").alias("slots"), F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("over_searches"), F.round(F.sum(F.when(F.col("g") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("over_generations"))


def q_score_distribution(spark: SparkSession, d: str) -> DataFrame:
    h = c.hits(spark, d)
    middle = order_statistics(h, ["component"], "score", {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.ceil((n + 1) / 2)})
    rest = h.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most"), F.round(F.avg(((F.col("score") >= 0.7) & (F.col("score") <= 0.9)).cast("double")), 6).alias("in_band"))
    return rest.join(middle.select("component", F.round((F.col("low") + F.col("high")) / 2, 6).alias("median")), "component")


def q_stage_presence(spark: SparkSession, d: str) -> DataFrame:
    """For the chunk served first: in which component's candidates it stands; null where the component did not run."""
    target = c.appearances(spark, d).where("rank = 1").groupBy(F.col("search_id").alias("query_id")).agg(F.min("chunk_id").alias("chunk_id"))
    r = _rankings(spark, d)
    ran = r.groupBy("query_id").agg(*[F.max((F.col("condition") == m).cast("int")).alias(f"ran_{m}") for m in ("bm25", "dense", "rerank")])
    seen = r.join(target, ["query_id", "chunk_id"]).groupBy("query_id").agg(*[F.max((F.col("condition") == m).cast("int")).alias(f"in_{m}") for m in ("bm25", "dense", "rerank")])
    out = target.join(ran, "query_id").join(seen, "query_id", "left")
    return out.select("query_id", *[F.when(F.col(f"ran_{m}") == 1, F.coalesce(f"in_{m}", F.lit(0)) == 1).alias(m) for m in ("bm25", "dense", "rerank")])


def q_question_families(spark: SparkSession, d: str) -> DataFrame:
    """Items joined by a shared target or a shared locator text, each family named by its least item."""
    items = read_table(spark, d, "eval_items").select("item_id", "target_id", "locator_text").distinct()
    links = None
    for label in ("target_id", "locator_text"):
        labelled = items.where(F.col(label).isNotNull()).select("item_id", F.col(label).alias("l"))
        part = labelled.join(labelled.groupBy("l").agg(F.min("item_id").alias("first")), "l").select("item_id", "first")
        links = part if links is None else links.union(part)
    return connected_components(links, "item_id", "first").select(F.col("node").alias("item_id"), F.col("component").alias("family"))


def resolved(items: DataFrame, documents: DataFrame, size: int = 8) -> DataFrame:
    """``(item_id, resolution, documents)``: in how many documents the whole text of an item stands, by its words in lower case.

    An item's first words, eight or all of a shorter one, find candidates by equality, so no item is
    compared with every document; a candidate counts if it holds the item's whole run of words.  An
    item without words is in no document.
    """
    words = lambda x: F.coalesce(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    wanted = items.where("item_id IS NOT NULL").select("item_id", words(F.col("item_text")).alias("w"))
    wanted = wanted.select("item_id", spaced(F.col("w")).alias("whole"), F.least(F.size("w"), F.lit(size)).alias("n"), F.array_join(F.slice("w", 1, size), " ").alias("run")).distinct()
    sizes = sorted(r[0] for r in wanted.where("n > 0").select("n").distinct().collect())  # at most eight
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", words(F.col("text")).alias("w"))
    every = F.concat(*[word_runs(F.col("w"), n) for n in sizes or [size]])
    runs = texts.select("doc_id", F.explode(F.array_distinct(every)).alias("run"))
    opened = runs.join(wanted.where("n > 0").select("run").distinct(), "run", "left_semi")
    candidates = wanted.where("n > 0").join(opened, "run").select("item_id", "whole", "doc_id")
    held = candidates.join(texts.select("doc_id", spaced(F.col("w")).alias("t")), "doc_id").where(F.col("t").contains(F.col("whole"))).select("item_id", "doc_id")
    n = F.count_distinct("doc_id")
    return wanted.select("item_id").distinct().join(held, "item_id", "left").groupBy("item_id").agg(F.when(n == 0, "none").when(n == 1, "unique").otherwise("several").alias("resolution"), n.alias("documents"))


def q_target_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Items whose whole text, as its words stand, is in exactly one document, in several, or in none."""
    return resolved(read_table(spark, d, "eval_items"), read_table(spark, d, "documents"))


_R = f"""
WITH h AS {c.HITS_SQL},
r AS (SELECT component AS condition, search_id AS query_id, chunk_id, row_number() OVER (PARTITION BY component, search_id ORDER BY score DESC, chunk_id) AS rank FROM h),
served AS (SELECT search_id AS query_id, chunk_id, min(rank) AS served FROM appearances GROUP BY 1, 2),
callers AS (SELECT search_id AS query_id, {_CALLER} AS caller FROM {c.SEARCHES_SQL}),
wanted AS (SELECT query_id, count(*) AS n FROM served WHERE served <= 2 GROUP BY 1),
per AS (SELECT condition, query_id, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM r JOIN served s USING (query_id, chunk_id) WHERE s.served <= 2 GROUP BY 1, 2),
known AS (SELECT a.condition, a.query_id, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, coalesce((first <= 1)::INT, 0) AS success_at_1, coalesce((first <= 10)::INT, 0) AS success_at_k,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg
  FROM (SELECT DISTINCT condition, query_id FROM r) a JOIN wanted USING (query_id) LEFT JOIN per p ON p.condition = a.condition AND p.query_id = a.query_id),
grades AS (SELECT query_id, chunk_id, 5 - served AS grade FROM served),
ideal AS (SELECT query_id, sum(CASE WHEN i <= 10 THEN (2 ** grade - 1) / log2(i + 1) ELSE 0 END) AS ideal, sum((grade >= 3)::INT) AS directs FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS i FROM grades) GROUP BY 1),
top AS (SELECT condition, query_id, sum((2 ** coalesce(grade, 0) - 1) / log2(rank + 1)) AS dcg, sum((coalesce(grade, 0) >= 3)::INT) AS hits, count(*) AS returned FROM r LEFT JOIN grades USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY 1, 2),
graded AS (SELECT condition, query_id, round(CASE WHEN ideal > 0 THEN dcg / ideal END, 6) AS graded_ndcg, round(hits / 10, 6) AS direct_at_k, round(hits / returned, 6) AS direct_of_returned, round(CASE WHEN directs > 0 THEN hits / directs END, 6) AS direct_coverage FROM top JOIN ideal USING (query_id))
"""
_A = "(SELECT DISTINCT * FROM appearances)"
_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
_NEG = "(" + ", ".join(f"'{w}'" for w in e.NEGATIONS) + ")"
_TOK = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN " + _STOP + "))"
_SIG = "array_to_string(regexp_extract_all(contents, '[0-9]+(?:[.,][0-9]+)*%?'), ' ') || '|' || array_to_string(list_filter(regexp_extract_all(contents, '[+*/=<>≤≥±×÷-]+'), lambda r: NOT regexp_full_match(r, '-+')), ' ') || '|' || array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(contents), '[\\p{L}\\p{N}_]+'), lambda w: w IN " + _NEG + " OR starts_with(w, 'un') OR starts_with(w, 'non')))), ' ')"
_SLOTS = f"(SELECT DISTINCT a.search_id, a.chunk_id, k.contents, k.source_id FROM {c.HITS_SQL} a JOIN {c.CHUNKS_SQL} k USING (chunk_id))"

QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLES = {
    "mrr_success_ndcg": _R + "SELECT * FROM known",
    "metrics_by_class": _R + "SELECT condition, caller AS grain, count(*) AS queries, grouping(caller) AS over_all, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(success_at_1), 6) AS success_at_1, round(avg(success_at_k), 6) AS success_at_k, round(avg(ndcg), 6) AS ndcg FROM known JOIN callers USING (query_id) GROUP BY GROUPING SETS ((condition), (condition, caller))",
    "pooled_graded_ndcg": _R + "SELECT * FROM graded",
    "paired_family_difference": _R + "SELECT caller AS family, round(avg(x.graded_ndcg - y.graded_ndcg), 9) AS difference, count(*) AS queries FROM graded x JOIN graded y USING (query_id) JOIN callers USING (query_id) WHERE x.condition = 'dense' AND y.condition = 'bm25' AND x.graded_ndcg IS NOT NULL AND y.graded_ndcg IS NOT NULL GROUP BY 1",
    "paired_ratio_percentiles": f"""WITH l AS (SELECT generation_id, {_CALLER} AS caller, elapsed_ms FROM {c.SEARCHES_SQL} WHERE generation_id IS NOT NULL),
b AS (SELECT generation_id, min(elapsed_ms) AS base FROM l WHERE caller = 'agent' AND elapsed_ms > 0 GROUP BY 1),
x AS (SELECT caller, ratio, row_number() OVER (PARTITION BY caller ORDER BY ratio) AS r, count(*) OVER (PARTITION BY caller) AS n FROM (SELECT caller, round(elapsed_ms / base, 9) AS ratio FROM l JOIN b USING (generation_id) WHERE caller <> 'agent' AND elapsed_ms IS NOT NULL))
SELECT caller, any_value(n) AS n, max(ratio) FILTER (WHERE r = greatest(ceil(0.5 * n), 1)) AS p50, max(ratio) FILTER (WHERE r = greatest(ceil(0.95 * n), 1)) AS p95 FROM x GROUP BY 1""",
    "determinism_check": f"SELECT query_text, generation_id, coalesce(filters, '') AS filters, count(*) AS runs, count(DISTINCT coalesce(answer, '')) AS answers FROM {c.SEARCHES_SQL} s LEFT JOIN (SELECT search_id, string_agg(chunk_id, ' ' ORDER BY rank, chunk_id) AS answer FROM {_A} GROUP BY 1) a USING (search_id) WHERE query_text IS NOT NULL AND generation_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "content_overlap": f"SELECT q.query_id, a.chunk_id, round(CASE WHEN len({_TOK.format('query')}) > 0 THEN len(list_intersect({_TOK.format('query')}, {_TOK.format('contents')})) / len({_TOK.format('query')}) ELSE 0 END, 6) AS overlap FROM {_A} a JOIN {c.QUERIES_SQL} q ON q.query_id = a.search_id JOIN {c.CHUNKS_SQL} k USING (chunk_id) WHERE a.rank = 1",
    "protected_signature": f"SELECT chunk_id, {_SIG} AS signature FROM {c.CHUNKS_SQL}",
    "shingle_containment": f"""WITH b AS (SELECT search_id, chunk_id, {_SIG} AS sig, regexp_extract_all(contents, '[\\p{{L}}\\p{{N}}_]+') AS w FROM {_SLOTS}),
s AS (SELECT search_id, chunk_id, sig, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM b)
SELECT a.search_id, a.chunk_id, min(o.chunk_id) AS contained_in FROM s a JOIN s o ON a.search_id = o.search_id AND a.sig = o.sig AND a.chunk_id <> o.chunk_id WHERE len(a.s) > 0 AND len(list_intersect(a.s, o.s)) >= 0.9 * len(a.s) GROUP BY 1, 2""",
    "exact_duplicate_slots": f"SELECT sha256(trim(regexp_replace(contents, '\\s+', ' ', 'g'))) AS text_sha256, count(DISTINCT chunk_id) AS copies, count(DISTINCT source_id) AS sources, count(DISTINCT search_id) AS searches FROM {_SLOTS} GROUP BY 1 HAVING count(DISTINCT chunk_id) > 1",
    "repetition_rates": f"WITH p AS (SELECT chunk_id, count(*) AS n, count(DISTINCT generation_id) AS g FROM (SELECT DISTINCT search_id, chunk_id FROM appearances) JOIN {c.SEARCHES_SQL} USING (search_id) GROUP BY 1) SELECT sum(n) AS slots, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS over_searches, round(sum(CASE WHEN g > 1 THEN n ELSE 0 END) / sum(n), 6) AS over_generations FROM p",
    "score_distribution": f"SELECT component, count(*) AS n, round(min(score), 6) AS least, round(median(score), 6) AS median, round(max(score), 6) AS most, round(avg((score >= 0.7 AND score <= 0.9)::INT), 6) AS in_band FROM {c.HITS_SQL} GROUP BY 1",
    "stage_presence": _R + """, target AS (SELECT search_id AS query_id, min(chunk_id) AS chunk_id FROM appearances WHERE rank = 1 GROUP BY 1)
SELECT query_id, CASE WHEN bool_or(condition = 'bm25') THEN bool_or(condition = 'bm25' AND r.chunk_id = t.chunk_id) END AS bm25, CASE WHEN bool_or(condition = 'dense') THEN bool_or(condition = 'dense' AND r.chunk_id = t.chunk_id) END AS dense, CASE WHEN bool_or(condition = 'rerank') THEN bool_or(condition = 'rerank' AND r.chunk_id = t.chunk_id) END AS rerank FROM target t JOIN r USING (query_id) GROUP BY 1""",
    "question_families": """WITH RECURSIVE i AS (SELECT DISTINCT item_id, target_id, locator_text FROM eval_items), e AS (SELECT a.item_id AS x, b.item_id AS y FROM i a JOIN i b ON a.target_id = b.target_id OR a.locator_text = b.locator_text),
w AS (SELECT item_id AS x, item_id AS y FROM i UNION SELECT w.x, e.y FROM w JOIN e ON w.y = e.x) SELECT x AS item_id, min(y) AS family FROM w GROUP BY 1""",
    "target_resolution": """WITH i AS (SELECT DISTINCT item_id, array_to_string(regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+'), ' ') AS run FROM eval_items WHERE item_id IS NOT NULL),
t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
SELECT item_id, CASE count(DISTINCT doc_id) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'several' END AS resolution, count(DISTINCT doc_id) AS documents FROM i LEFT JOIN t ON i.run <> '' AND contains(t.t, ' ' || i.run || ' ') GROUP BY 1""",
}
