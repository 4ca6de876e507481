"""Queries of boxes, grids and regions over boxes made of the table part, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions import geometry
from candela.operators import checks, contract
from candela.plans.catalog import query, rounded
from candela.plans.tables import table


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of parts: some beyond the image, some empty."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    x, y, w, h = ((k * 7) % 120 - 10).cast("double"), ((k * 11) % 100 - 10).cast("double"), (F.col("p_size") % 31).cast("double"), (k % 29).cast("double")
    return p.select("p_partkey", "p_size", F.array(x, y, w, h).alias("b"), (F.col("p_size") + 100).cast("double").alias("iw"), (k % 40 + 80).cast("double").alias("ih"))


BOX = """box AS (SELECT p_partkey, p_size, CAST((p_partkey * 7) % 120 - 10 AS DOUBLE) AS x, CAST((p_partkey * 11) % 100 - 10 AS DOUBLE) AS y, CAST(p_size % 31 AS DOUBLE) AS w, CAST(p_partkey % 29 AS DOUBLE) AS h,
  CAST(p_size + 100 AS DOUBLE) AS iw, CAST(p_partkey % 40 + 80 AS DOUBLE) AS ih FROM part),
cut AS (SELECT *, greatest(0, least(x, iw)) AS cx, greatest(0, least(y, ih)) AS cy FROM box), clip AS (SELECT *, greatest(0, least(w, iw - cx)) AS cw, greatest(0, least(h, ih - cy)) AS ch, w > 0 AND h > 0 AS solid FROM cut)"""


def parts(c, *names):
    return [F.round(c[i], 4).alias(n) for i, n in enumerate(names)]


@query(f"""WITH {BOX} SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN NULL ELSE x END AS read_x, solid, CASE WHEN cw > 0 AND ch > 0 THEN cx END AS clip_x, CASE WHEN cw > 0 AND ch > 0 THEN ch END AS clip_h,
  round(iw * 0.5 - greatest(1, iw * 0.35) * 0.5, 4) AS centre_x, round(greatest(1, ih * 0.35), 4) AS centre_h FROM clip""")
def box_forms(spark, sf_dir):
    d = boxes(spark, sf_dir)
    raw = F.when(F.col("p_size") % 6 == 0, F.transform("b", lambda v, i: F.when(i == 2, "wide").otherwise(v.cast("string")))).otherwise(F.transform("b", lambda v: v.cast("string")))
    c, m = geometry.clipped(F.col("b"), F.col("iw"), F.col("ih")), geometry.centre_box(F.col("iw"), F.col("ih"))
    return d.select("p_partkey", geometry.box(raw)[0].alias("read_x"), geometry.solid_box(F.col("b")).isNotNull().alias("solid"), c[0].alias("clip_x"), c[3].alias("clip_h"), F.round(m[0], 4).alias("centre_x"), F.round(m[3], 4).alias("centre_h"))


@query(f"""WITH {BOX}, o AS (SELECT *, 20.0 AS ox, 15.0 AS oy, 40.0 AS ow, 25.0 AS oh FROM box), i AS (SELECT *, greatest(0, least(x + w, ox + ow) - greatest(x, ox)) * greatest(0, least(y + h, oy + oh) - greatest(y, oy)) AS s FROM o)
SELECT p_partkey, round(CASE WHEN s > 0 THEN s / (w * h + ow * oh - s) ELSE 0 END, 6) AS iou FROM i""")
def box_iou(spark, sf_dir):
    other = F.array(*map(F.lit, (20.0, 15.0, 40.0, 25.0)))
    return rounded(boxes(spark, sf_dir).select("p_partkey", geometry.iou(F.col("b"), other).alias("iou")))


@query(f"""WITH {BOX}, s AS (SELECT *, solid AND cw > 0 AND ch > 0 AND p_partkey % 3 <> 0 AS one, p_partkey % 5 <> 0 AS two FROM clip)
SELECT p_partkey, CASE WHEN one THEN 'target_bbox' WHEN two THEN 'gt_bbox' ELSE 'fallback.center_bbox' END AS source, NOT one AND NOT two AS fallback,
  round(CASE WHEN one THEN cx WHEN two THEN 5 ELSE iw * 0.5 - iw * 0.175 END, 4) AS x, round(CASE WHEN one THEN cw WHEN two THEN 10 ELSE iw * 0.35 END, 4) AS w FROM s""")
def primary_boxes(spark, sf_dir):
    d, k = boxes(spark, sf_dir), F.col("p_partkey")
    second = F.when(k % 5 != 0, F.array(*map(F.lit, (5.0, 5.0, 10.0, 10.0))))
    p = geometry.primary_box(F.col("iw"), F.col("ih"), ("target_bbox", F.when(k % 3 != 0, F.col("b"))), ("gt_bbox", second))
    return d.select("p_partkey", p.alias("p")).select("p_partkey", "p.source", "p.fallback", F.round(F.col("p.bbox")[0], 4).alias("x"), F.round(F.col("p.bbox")[2], 4).alias("w"))


_GRID = """g AS (SELECT p_partkey, x, y, w, h, gy, gx FROM box, range(6) a(gy), range(8) b(gx)), inside AS (SELECT p_partkey, gy, gx FROM g WHERE w > 0 AND h > 0 AND (gx + 0.5) * 12.5 BETWEEN x AND x + w AND (gy + 0.5) * 15 BETWEEN y AND y + h),
one AS (SELECT p_partkey, greatest(0, least(5, CAST(trunc((y + h / 2) / 15) AS INT))) AS gy, greatest(0, least(7, CAST(trunc((x + w / 2) / 12.5) AS INT))) AS gx FROM box WHERE w > 0 AND h > 0 AND p_partkey NOT IN (SELECT p_partkey FROM inside)),
tok AS (SELECT DISTINCT p_partkey, CAST((gy // 2) * 4 + gx // 2 AS INT) AS t FROM (SELECT * FROM inside UNION ALL SELECT * FROM one))"""


def _tokens(spark, sf_dir) -> DataFrame:
    four = F.lit(4)
    return boxes(spark, sf_dir).select("p_partkey", "p_size", geometry.box_tokens(F.col("b"), F.lit(100.0), F.lit(90.0), F.lit(6), F.lit(8), four).alias("tokens"))


@query(f"WITH {BOX}, {_GRID} SELECT p_partkey, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM tok WHERE tok.p_partkey = box.p_partkey), '') AS tokens FROM box")
def box_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("p_partkey", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


@query(f"""WITH {BOX}, {_GRID}, every AS (SELECT p_partkey, t, p_size % 2 + 1 AS ring FROM box, range(CASE WHEN p_size % 5 = 0 THEN 4 ELSE 12 END) r(t)), known AS (SELECT tok.* FROM tok JOIN box USING (p_partkey) WHERE t < CASE WHEN p_size % 5 = 0 THEN 4 ELSE 12 END),
near AS (SELECT DISTINCT e.p_partkey, e.t FROM every e JOIN known k ON k.p_partkey = e.p_partkey AND greatest(abs(e.t // 4 - k.t // 4), abs(e.t % 4 - k.t % 4)) <= 1 WHERE NOT EXISTS (SELECT 1 FROM known x WHERE x.p_partkey = e.p_partkey AND x.t = e.t)),
rest AS (SELECT p_partkey, t FROM every e WHERE NOT EXISTS (SELECT 1 FROM known x WHERE x.p_partkey = e.p_partkey AND x.t = e.t)),
c AS (SELECT p_partkey, (SELECT count(*) FROM known k WHERE k.p_partkey = b.p_partkey) AS n_known, (SELECT count(*) FROM near k WHERE k.p_partkey = b.p_partkey) AS n_near, (SELECT count(*) FROM rest k WHERE k.p_partkey = b.p_partkey) AS n_rest FROM box b),
m AS (SELECT p_partkey, CASE WHEN n_known = 0 THEN 'global_fallback' WHEN n_near > 0 THEN 'ring' WHEN n_rest > 0 THEN 'global_fallback' ELSE 'all_tokens_fallback' END AS method, n_known, n_near, n_rest FROM c),
r AS (SELECT m.p_partkey, method, string_agg(e.t, ',' ORDER BY e.t) AS tokens FROM m JOIN every e USING (p_partkey) WHERE CASE WHEN method = 'ring' THEN EXISTS (SELECT 1 FROM near x WHERE x.p_partkey = e.p_partkey AND x.t = e.t) WHEN n_known > 0 AND n_rest > 0 THEN EXISTS (SELECT 1 FROM rest x WHERE x.p_partkey = e.p_partkey AND x.t = e.t) ELSE true END GROUP BY 1, 2)
SELECT * FROM r""")
def ring_tokens(spark, sf_dir):
    n = F.when(F.col("p_size") % 5 == 0, 4).otherwise(12)
    r = geometry.ring_tokens(F.col("tokens"), n, F.lit(6), F.lit(8), F.lit(4), 1)
    return _tokens(spark, sf_dir).select("p_partkey", r.alias("r")).select("p_partkey", "r.method", F.array_join(F.col("r.tokens").cast("array<string>"), ",").alias("tokens"))


@query("""WITH r AS (SELECT p_partkey, p_size, 1 + p_partkey % 7 AS tokens, greatest(1, CAST(round_even(p_size * 4 / (1 + p_partkey % 7)::DOUBLE, 0) AS INT)) AS r FROM part),
k AS (SELECT p_partkey, CASE WHEN (p_size * 4) % tokens = 0 OR abs(tokens * r - p_size * 4) / greatest(p_size * 4, 1) <= 0.05 THEN CAST(r AS INT) END AS ratio FROM r)
SELECT p_partkey, ratio, CAST((SELECT max(i) FROM range(1, 100) t(i) WHERE i * i <= ratio AND ratio % i = 0) AS INT) AS h, CAST(ratio // (SELECT max(i) FROM range(1, 100) t(i) WHERE i * i <= ratio AND ratio % i = 0) AS INT) AS w FROM k""")
def merge_sizes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", geometry.merge_ratio(F.col("p_size") * 4, F.col("p_partkey") % 7 + 1).alias("ratio"))
    s = geometry.merge_size(F.col("ratio"))
    known = F.col("ratio").isNotNull()
    return p.select("p_partkey", "ratio", F.when(known, s["h"]).alias("h"), F.when(known, s["w"]).alias("w"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN CAST(p_partkey % 5 AS INT) END AS first, CASE WHEN p_size % 4 > 0 THEN CAST(p_partkey % 5 + p_size % 4 AS INT) END AS "end",
  CASE WHEN p_size % 4 > 0 THEN array_to_string(list_transform(list_filter([0, 2, 7, -1], lambda i: i >= 0 AND i < p_size % 4), lambda i: i + p_partkey % 5), ',') END AS absolute FROM part""")
def visual_ranges(spark, sf_dir):
    p, k, n = table(spark, sf_dir, "part"), (F.col("p_partkey") % 5).cast("int"), (F.col("p_size") % 4).cast("int")
    ids = F.concat(F.array_repeat(F.lit(1), k), F.array_repeat(F.lit(9), n), F.array(F.lit(3)))
    r = contract.visual_range(ids, F.lit(9))
    places = geometry.absolute(ids, F.array(*map(F.lit, (0, 2, 7, -1))), F.lit(9))
    return p.select("p_partkey", r["first"].alias("first"), r["end"].alias("end"), F.when(places.isNotNull(), F.array_join(places.cast("array<string>"), ",")).alias("absolute"))


@query("""WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)
SELECT p_partkey, CAST(i - 1 AS INT) AS place, CAST(sum(length(w)) OVER (PARTITION BY p_partkey ORDER BY i) - length(w) AS INT) AS start, CAST(sum(length(w)) OVER (PARTITION BY p_partkey ORDER BY i) AS INT) AS "end" FROM t""")
def token_spans(spark, sf_dir):
    spans = geometry.token_spans(F.split("p_name", " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(spans).alias("place", "s")).select("p_partkey", "place", "s.start", "s.end")


def _u(*parts: str) -> str:
    return "(('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8))::BIGINT / 4294967295.0)"


@query(f"""WITH {BOX}, p AS (SELECT p_partkey, iw, ih, solid AND cw > 0 AND ch > 0 AS own, CASE WHEN solid AND cw > 0 AND ch > 0 THEN cx ELSE iw * 0.325 END AS x, CASE WHEN solid AND cw > 0 AND ch > 0 THEN cy ELSE ih * 0.325 END AS y,
  CASE WHEN solid AND cw > 0 AND ch > 0 THEN cw ELSE iw * 0.35 END AS w, CASE WHEN solid AND cw > 0 AND ch > 0 THEN ch ELSE ih * 0.35 END AS h FROM clip),
d AS (SELECT p.*, idx, i, {_u("p_partkey || '#' || idx", "i", "'x'")} * (iw - w) AS dx, {_u("p_partkey || '#' || idx", "i", "'y'")} * (ih - h) AS dy FROM p, range(2) a(idx), range(24) b(i) WHERE w <= iw AND h <= ih),
f AS (SELECT *, greatest(0, least(x, dx) + w - greatest(x, dx)) * greatest(0, least(y, dy) + h - greatest(y, dy)) AS s FROM d), n AS (SELECT p_partkey, idx, arg_min(dx, i) AS dx, arg_min(dy, i) AS dy, any_value(w) AS w, any_value(h) AS h FROM f WHERE s <= 0 OR s / (2 * w * h - s) <= 0.05 GROUP BY 1, 2)
SELECT p_partkey, 'pos' AS kind, CAST(0 AS INT) AS idx, round(x, 3) AS x, round(y, 3) AS y, round(w, 3) AS w, round(h, 3) AS h, NOT own AS fallback, round(w * h / greatest(1, iw * ih), 6) AS area_fraction FROM p
UNION ALL SELECT p_partkey, 'neg', CAST(idx AS INT), round(dx, 3), round(dy, 3), round(n.w, 3), round(n.h, 3), NOT own, round(n.w * n.h / greatest(1, iw * ih), 6) FROM n JOIN p USING (p_partkey)""")
def intervention_proposals(spark, sf_dir):
    r = checks.proposals(boxes(spark, sf_dir), "p_partkey", "b", "iw", "ih", 2)
    return r.select("p_partkey", "kind", "idx", *[F.round(F.col("box")[i], 3).alias(n) for i, n in enumerate("xywh")], "fallback", F.round("area_fraction", 6).alias("area_fraction"))


@query(f"""WITH {BOX}, b AS (SELECT p_partkey, iw, ih, x, y, greatest(w, 1) AS w, greatest(h, 1) AS h FROM box),
s AS (SELECT *, greatest(1, w * h) AS area, sqrt((0.05 + 0.1 * {_u('p_partkey', "'share'")}) * iw * ih) AS side FROM b),
m AS (SELECT *, greatest(1, least(sqrt(area * (0.8 + 0.4 * {_u('p_partkey', "'area'")}) * w / h), iw * 0.9)) AS mw, area * (0.8 + 0.4 * {_u('p_partkey', "'area'")}) AS target FROM s),
k AS (SELECT *, greatest(1, least(target / mw, ih * 0.9)) AS mh FROM m), d AS (SELECT *, {_u('p_partkey', "'x' || i")} * greatest(1, iw - mw) AS dx, {_u('p_partkey', "'y' || i")} * greatest(1, ih - mh) AS dy FROM k, range(1, 21) r(i)),
f AS (SELECT *, greatest(0, least(dx + mw, x + w) - greatest(dx, x)) * greatest(0, least(dy + mh, y + h) - greatest(dy, y)) AS o FROM d),
g AS (SELECT p_partkey, min(i) FILTER (o / greatest(1, mw * mh + area - o) < 0.3) AS pick FROM f GROUP BY 1)
SELECT k.p_partkey, round({_u('k.p_partkey', "'x'")} * greatest(1, iw - least(side, iw * 0.5)), 3) AS random_x, round(least(side, ih * 0.5), 3) AS random_h, round(mw, 3) AS w, round(mh, 3) AS h,
  round(CASE WHEN pick IS NULL THEN CASE WHEN x + w / 2 < iw / 2 THEN greatest(0, iw - mw) ELSE 0 END ELSE {_u('k.p_partkey', "'x' || pick")} * greatest(1, iw - mw) END, 3) AS x FROM k JOIN g USING (p_partkey)""")
def compared_boxes(spark, sf_dir):
    d = boxes(spark, sf_dir).withColumn("b", F.array(F.col("b")[0], F.col("b")[1], F.greatest(F.col("b")[2], F.lit(1.0)), F.greatest(F.col("b")[3], F.lit(1.0))))
    r, a = contract.random_box(F.col("iw"), F.col("ih"), F.col("p_partkey")), contract.area_matched_box(F.col("b"), F.col("iw"), F.col("ih"), F.col("p_partkey"))
    d = d.select("p_partkey", r.alias("r"), a.alias("a"))
    return d.select("p_partkey", F.round(F.col("r")[0], 3).alias("random_x"), F.round(F.col("r")[3], 3).alias("random_h"), F.round(F.col("a")[2], 3).alias("w"), F.round(F.col("a")[3], 3).alias("h"), F.round(F.col("a")[0], 3).alias("x"))
