"""Queries of interval and box joins: words of documents against planted spans, cells of a grid against boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import spans
from candela.plans.catalog import query, rounded
from candela.plans.tables import table

_PLANTED = """p AS (SELECT doc_id, k, CAST((doc_id * 37 + k * 101) % greatest(n_chars, 1) AS BIGINT) AS start, CASE WHEN k = 0 AND doc_id % 50 = 0 THEN n_chars ELSE CAST((doc_id * 37 + k * 101) % greatest(n_chars, 1) + (doc_id * 13 + k * k * 29) % 60 AS BIGINT) END AS "end"
FROM (SELECT doc_id, n_chars, unnest([0, 1, 2, 3, 4]) AS k FROM documents))"""


def _planted(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.array(*map(F.lit, range(5)))).alias("k"))
    start = F.expr("(doc_id * 37 + k * 101) % greatest(n_chars, 1)")
    return d.select("doc_id", "k", start.alias("start"), F.when((F.col("k") == 0) & (F.col("doc_id") % 50 == 0), F.col("n_chars")).otherwise(start + F.expr("(doc_id * 13 + k * k * 29) % 60")).alias("end"))


@query(f"""WITH {_PLANTED}, s AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS place FROM s),
w AS (SELECT doc_id, place, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, length(w) AS n FROM u)
SELECT doc_id, k, count(*) AS words, CAST(min(place) AS INT) AS first, CAST(max(place) AS INT) AS last, CAST(sum(least(w.start + n, p."end") - greatest(w.start, p.start)) AS BIGINT) AS chars
FROM w JOIN p USING (doc_id) WHERE n > 0 AND p.start < p."end" AND w.start < p."end" AND p.start < w.start + n GROUP BY doc_id, k""")
def span_overlaps(spark, sf_dir):
    words = spans.word_spans(table(spark, sf_dir, "documents"), "doc_id", "text")
    met = spans.overlaps(words, _planted(spark, sf_dir), ["doc_id"])
    return met.groupBy("doc_id", F.col("right.k").alias("k")).agg(F.count("*").alias("words"), F.min("left.place").alias("first"), F.max("left.place").alias("last"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query("""WITH b AS (SELECT l_orderkey % 40 AS image, l_orderkey, l_linenumber, l_quantity AS x1, l_linenumber * 7.0 AS y1, l_quantity + 1 + l_extendedprice / 20000 AS x2, l_linenumber * 7.0 + 1 + 100 * l_discount AS y2 FROM lineitem),
g AS (SELECT i AS image, x, y, 8.0 * x AS x1, 10.0 * y AS y1, 8.0 * (x + 1) AS x2, 10.0 * (y + 1) AS y2 FROM (SELECT unnest(range(40)) AS i) CROSS JOIN (SELECT unnest(range(8)) AS x) CROSS JOIN (SELECT unnest(range(7)) AS y))
SELECT g.image, g.x, g.y, count(*) AS boxes, round(sum((least(b.x2, g.x2) - greatest(b.x1, g.x1)) * (least(b.y2, g.y2) - greatest(b.y1, g.y1))), 3)::DOUBLE AS area FROM b JOIN g USING (image) WHERE b.x1 < g.x2 AND g.x1 < b.x2 AND b.y1 < g.y2 AND g.y1 < b.y2 GROUP BY ALL""")
def box_cells(spark, sf_dir):
    boxes = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 40 AS image", "l_orderkey", "l_linenumber", "l_quantity AS x1", "l_linenumber * 7.0D AS y1", "l_quantity + 1 + l_extendedprice / 20000 AS x2", "l_linenumber * 7.0D + 1 + 100 * l_discount AS y2")
    images = boxes.select("image").distinct()
    cells = images.selectExpr("image", "explode(sequence(0L, 7L)) AS x").selectExpr("image", "x", "explode(sequence(0L, 6L)) AS y").selectExpr("image", "x", "y", "8.0D * x AS x1", "10.0D * y AS y1", "8.0D * (x + 1) AS x2", "10.0D * (y + 1) AS y2")
    met = spans.box_overlaps(boxes, cells, ["image"])
    return rounded(met.groupBy("image", F.col("right.x").alias("x"), F.col("right.y").alias("y")).agg(F.count("*").alias("boxes"), F.sum("area").alias("area")), 3)
