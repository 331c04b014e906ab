"""The pN_ queries of this subpackage, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyweft.llm import entities, furniture, leakage, lines, neardup, residue, stuffing, terms, tokenize
from storyweft.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "item"), "id", "title_norm", threshold=0.6)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.found_lines(table(spark, sf_dir, "article"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, sf_dir, "article"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.distinctive(table(spark, sf_dir, "item")).select("id", "term")


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return terms.distinctiveness(table(spark, sf_dir, "item")).withColumn("score", F.round("score", 6))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "article")).select("id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.furniture(table(spark, sf_dir, "article"))


def p6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.main_text(table(spark, sf_dir, "article"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    typed = table(spark, sf_dir, "item").select(F.col("publisher").alias("name"))
    return entities.spelling_pairs(typed.unionAll(table(spark, sf_dir, "story").select(F.explode("publishers"))))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p3_found, p3_clean, p4_found, p4_scores, p5_found, p6_found, p6_main_text, p7_found, p8_ids, p9_found, p10_found)}


_TERMS = """
    WITH d AS (SELECT id, list_filter(string_split(title_norm, ' '), lambda w: w <> '') AS ws FROM item WHERE id IS NOT NULL),
    lens AS (SELECT id, max(coalesce(len(ws), 0)) AS l FROM d GROUP BY id),
    totals AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(l) AS al FROM lens),
    tok AS (SELECT id, len(ws) AS l, unnest(list_distinct(ws)) AS term, ws FROM d),
    post AS (SELECT id, term, max(len(list_filter(ws, lambda w: w = term))) AS tf, max(l) AS l FROM tok GROUP BY id, term),
    stats AS (SELECT term, count(*) AS df, sum(tf) AS f FROM post GROUP BY term)
"""

SQL = {
    "p1_found": """
    WITH d AS (SELECT DISTINCT id, list_distinct(string_split(title_norm, ' ')) AS ws FROM item WHERE id IS NOT NULL AND title_norm IS NOT NULL)
    SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM d a JOIN d b ON a.id < b.id
    WHERE len(list_intersect(a.ws, b.ws)) >= 0.6 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) - 1e-9
    """,
    "p3_found": r"""
    WITH a AS (SELECT DISTINCT id, site_name, content FROM article WHERE id IS NOT NULL AND site_name IS NOT NULL AND content IS NOT NULL),
    l AS (SELECT DISTINCT id, site_name, regexp_replace(lower(trim(regexp_replace(regexp_replace(line, '<[^>]*>', ' ', 'g'), '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g'))), '[0-9]+', '#', 'g') AS line
          FROM (SELECT id, site_name, unnest(string_split(content, chr(10))) AS line FROM a)),
    n AS (SELECT site_name, count(DISTINCT id) AS n FROM a GROUP BY site_name)
    SELECT site_name, line FROM l JOIN n USING (site_name) WHERE line <> '' GROUP BY site_name, line, n
    HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.1 * n
    """,
    "p3_clean": r"""
    WITH a AS (SELECT id, any_value(site_name) AS site_name, any_value(content) AS content FROM article WHERE id IS NOT NULL GROUP BY id),
    l AS (SELECT id, site_name, pos, line, regexp_replace(lower(trim(regexp_replace(regexp_replace(line, '<[^>]*>', ' ', 'g'), '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g'))), '[0-9]+', '#', 'g') AS form
          FROM (SELECT id, site_name, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM a WHERE content IS NOT NULL)),
    n AS (SELECT site_name, count(DISTINCT id) AS n FROM a WHERE site_name IS NOT NULL AND content IS NOT NULL GROUP BY site_name),
    hit AS (SELECT site_name, form FROM l JOIN n USING (site_name) WHERE form <> '' GROUP BY site_name, form, n HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= 0.1 * n),
    kept AS (SELECT id, string_agg(line, chr(10) ORDER BY pos) AS body FROM l WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.site_name = l.site_name AND hit.form = l.form) GROUP BY id)
    SELECT id, coalesce(body, '') AS content FROM a LEFT JOIN kept USING (id)
    """,
    "p4_found": _TERMS + "SELECT id, term FROM post JOIN stats USING (term) WHERE df BETWEEN 2 AND 40",
    "p4_scores": _TERMS
    + """, s AS (SELECT id, term, CAST(tf AS BIGINT) AS tf, df, f / n AS lam, tf * log2(1 + al / l) AS tfn FROM post JOIN stats USING (term), totals)
    SELECT id, term, tf, df, round((log2(1 + lam) + tfn * log2((1 + lam) / lam)) / (tfn + 1), 6) AS score FROM s
    """,
    "p9_found": r"""
    WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_item WHERE text IS NOT NULL),
    e AS (SELECT item_id, array_to_string(ws[k : k + least(13, len(ws)) - 1], ' ') AS g, least(13, len(ws)) AS n
          FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS k FROM w WHERE len(ws) > 0)),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
    sizes AS (SELECT DISTINCT n FROM e),
    g AS (SELECT doc_id, n, array_to_string(ws[k : k + n - 1], ' ') AS g
          FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, sizes WHERE len(ws) >= n))
    SELECT DISTINCT doc_id, item_id FROM g JOIN e USING (g, n)
    """,
}
