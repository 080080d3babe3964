"""Snapshots, reuse, HTML extraction and rendered derivations over the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.derivations import render_derivation
from quernstone.functions.html import extracted
from quernstone.plans.generations import reusable_vectors, violations
from quernstone.queries import common as c
from quernstone.sources import read_table


def q_build_validation(spark: SparkSession, d: str) -> DataFrame:
    vectors = read_table(spark, d, "reuse_vectors").dropDuplicates(["vec_id"])
    return violations(c.documents(spark, d, "source_id"), c.units(spark, d, "document_id"), c.chunks(spark, d, "document_id", "unit_id"), vectors)


def q_vector_reuse(spark: SparkSession, d: str) -> DataFrame:
    rows = reusable_vectors(c.chunks(spark, d, "contents"), read_table(spark, d, "reuse_vectors"), "marrow-multi")
    return rows.select("chunk_id", "reused")


def q_html_units(spark: SparkSession, d: str) -> DataFrame:
    """Units wrapped as sections of HTML and read back: headings carried, furniture dropped."""
    text = F.regexp_replace(F.regexp_replace("contents", "&", "&amp;"), "<", "&lt;")
    body = F.concat(F.lit("<nav>menu</nav><h2>"), F.coalesce(F.regexp_replace("title", "&", "&amp;"), F.lit("")), F.lit("</h2><p>"), F.regexp_replace(text, "\n\n", "</p><p>"), F.lit("</p>"))
    sections = c.units(spark, d, "title", "contents").where("contents IS NOT NULL").select(F.col("unit_id").alias("section_id"), body.alias("html"))
    return extracted(sections)


# every sign that Unicode counts as white space
_SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def q_render_derivation(spark: SparkSession, d: str) -> DataFrame:
    """A derivation for every chunk served first: its first sentence without its first word, as a stated fragment, and a gap.

    A text without a sentence, or a sentence of one word, is refused.
    """
    served = c.appearances(spark, d).where("rank = 1").select("chunk_id").distinct()
    rows = c.chunks(spark, d, "contents").join(served, "chunk_id").withColumn("text", F.trim(F.regexp_replace("contents", _SPACE, " ")))
    rows = rows.withColumn("first", F.regexp_extract("text", r"^(.*?[.?!])(?:\s|$)", 1)).withColumn("word", F.regexp_extract("first", r"[\p{L}\p{N}_]+", 0))
    step = lambda **k: F.struct(*[F.lit(v).alias(n) for n, v in k.items()])
    source = F.struct(F.lit("unknown").alias("author"), F.col("chunk_id").alias("title"), F.col("text").alias("text"))
    steps = F.array(step(id="A", claim="as written", supports="Z", status="part", why="it answers", missing=""), step(id="B", claim="as meant", supports="A", status="gap", why="it is read so", missing="A → B"))
    op = lambda **k: F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(n) for n, v in k.items()])
    piece = F.struct(F.lit("S1").alias("source"), F.col("first").alias("text"), F.array(op(op="DELETE", text=F.col("word"), rule="", to=""), op(op="NORMALISE", text="", rule="case", to="lower")).alias("ops"))
    sentence = F.struct(F.array(F.lit("A"), F.lit("B")).alias("step"), F.array(piece).alias("pieces"), F.lit("a fragment").alias("deviation"))
    doc = F.struct(F.struct(source.alias("S1")).alias("sources"), F.lit("as written").alias("conclusion"), steps.alias("steps"), F.array(sentence).alias("sentences"), F.array(step(source="S1", result="agrees")).alias("checks"))
    return rows.select("chunk_id", render_derivation(F.to_json(doc)).alias("r")).select("chunk_id", "r.synthesis", F.col("r.refused").isNotNull().alias("refused"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
_V = "(SELECT DISTINCT * FROM reuse_vectors)"
ORACLES = {
    "build_validation": f"""SELECT 'repeated ids in documents' AS rule, count(*) AS n FROM (SELECT document_id FROM {c.DOCUMENTS_SQL} GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'repeated ids in units', count(*) FROM (SELECT unit_id FROM (SELECT DISTINCT unit_id, document_id FROM units) GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'repeated ids in chunks', count(*) FROM (SELECT chunk_id FROM {c.CHUNKS_SQL} GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'units of no document', count(*) FROM (SELECT DISTINCT unit_id, document_id FROM units) WHERE document_id NOT IN (SELECT document_id FROM source_documents)
UNION ALL SELECT 'chunks of no unit', count(*) FROM {c.CHUNKS_SQL} WHERE unit_id NOT IN (SELECT unit_id FROM units)
UNION ALL SELECT 'chunks of no document', count(*) FROM {c.CHUNKS_SQL} WHERE document_id NOT IN (SELECT document_id FROM source_documents)
UNION ALL SELECT 'vectors of no chunk', count(*) FROM {_V} WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks)
UNION ALL SELECT 'vectors not finite', count(*) FROM (SELECT vec_id, any_value(vector) AS vector FROM reuse_vectors GROUP BY 1) WHERE vector IS NULL OR len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0""",
    "vector_reuse": f"SELECT chunk_id, sha256(contents) IN (SELECT content_sha256 FROM reuse_vectors WHERE embedding_model = 'marrow-multi' AND content_sha256 IS NOT NULL AND vector IS NOT NULL) AS reused FROM {c.CHUNKS_SQL}",
    "render_derivation": f"""WITH t AS (SELECT chunk_id, trim(regexp_replace(contents, '{_SPACE}', ' ', 'g')) AS t FROM {c.CHUNKS_SQL} WHERE chunk_id IN (SELECT chunk_id FROM appearances WHERE rank = 1)),
f AS (SELECT chunk_id, regexp_extract(t, '^(.*?[.?!])(?:\\s|$)', 1) AS f FROM t), w AS (SELECT *, regexp_extract(f, '[\\p{{L}}\\p{{N}}_]+') AS w FROM f),
r AS (SELECT chunk_id, f, w, trim(regexp_replace(left(f, strpos(f, w) - 1) || CASE WHEN substr(f, strpos(f, w) - 1, 1) = ' ' AND strpos(f, w) > 1 OR substr(f, strpos(f, w) + length(w), 1) = ' ' THEN ' ' ELSE '' END || substr(f, strpos(f, w) + length(w)), ' +', ' ', 'g')) AS r FROM w),
p AS (SELECT *, regexp_extract(r, '^[^\\p{{L}}]*') AS p FROM r), l AS (SELECT *, p || lower(substr(r, length(p) + 1, 1)) || substr(r, length(p) + 2) AS l FROM p)
SELECT chunk_id, CASE WHEN regexp_matches(l, '\\p{{L}}') THEN left(l, length(l) - 1) || ' [S1]' || right(l, 1) || ' ⟦GAP: A → B⟧' END AS synthesis, NOT regexp_matches(l, '\\p{{L}}') AS refused FROM l""",
}
