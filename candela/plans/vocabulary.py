"""Queries over vectors as long as a vocabulary, and over vectors replaced by noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions import arrays, stats, vectors
from candela.plans.catalog import query, rounded
from candela.plans.tables import CAND, candidates, table
from candela.sources import files

SPREAD = 512  # an embedding of 64 components makes 32,768 logits


def _tops_sql() -> str:
    out = []
    for k in vectors.TOPS:
        mass, other = (f"list_sum(list_transform(top[1:{k}], lambda t: {x}[t.i + 1]))" for x in "pq")
        own = f"list_transform(top[1:{k}], lambda t: struct_pack(p := greatest(p[t.i + 1] / {mass}, 1e-12), q := greatest(q[t.i + 1] / {other}, 1e-12)))"
        out.append(f"round(0.5 * list_sum(list_transform({own}, lambda z: z.p * ln(2 * z.p / (z.p + z.q)) + z.q * ln(2 * z.q / (z.p + z.q)))), 7) AS js_{k}")
        dot = lambda a, b: f"list_sum(list_transform(top[1:{k}], lambda t: {a}[t.i + 1] * {b}[t.i + 1]))"  # noqa: B023, E731
        out.append(f"round(1 - {dot('a', 'b')} / greatest(sqrt({dot('a', 'a')}) * sqrt({dot('b', 'b')}), 1e-8), 7) AS cos_{k}, round({mass}, 7) AS mass_{k}")
    return ", ".join(out)


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
a AS MATERIALIZED (SELECT vec_id, flatten(list_transform(range({SPREAD}), lambda j: list_transform(v, lambda x: x * ((j * 37) % {SPREAD} + 1) / 128.0))) AS a FROM v),
b AS MATERIALIZED (SELECT vec_id, a, list_reverse(a) AS b, list_max(a) AS m FROM a),
n AS MATERIALIZED (SELECT *, list_sum(list_transform(a, lambda x: exp(x - m))) AS s FROM b),
p AS MATERIALIZED (SELECT vec_id, a, b, list_transform(a, lambda x: exp(x - m) / s) AS p, list_transform(b, lambda x: exp(x - m) / s) AS q, list_sort(list_transform(a, lambda x, i: struct_pack(v := -x, i := i - 1)))[1:{max(vectors.TOPS)}] AS top FROM n)
SELECT vec_id, {_tops_sql()} FROM p""")
def vocabulary_tops(spark, sf_dir):
    v = arrays.doubles(F.col("embedding"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    a = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda j: F.transform("v", lambda x: x * ((j * 37) % SPREAD + 1) / 128.0)))
    return rounded(vectors.top_divergences(d.select("vec_id", a.alias("a")).withColumn("b", F.reverse("a")), "vec_id", "a", "b"), 7)


def _normal_sql(key: str) -> str:
    u = lambda s: f"(('0x' || substr(md5({key} || ':{s}'), 1, 8))::BIGINT / 4294967295.0)"
    return f"sqrt(-2 * ln(greatest({u('u')}, 1e-12))) * cos(2 * pi() * {u('v')})"


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT vec_id, [v[1:8], v[9:16], v[17:24], v[25:32]] AS s FROM e),
t AS (SELECT *, list_stddev_samp(list_concat(s[2], s[4])) AS sd, list_transform(range(1, 9), lambda j: (s[1][j] + s[3][j]) / 2) AS near, list_transform(range(1, 9), lambda j: (s[1][j] + s[2][j] + s[3][j] + s[4][j]) / 4) AS mean FROM s)
SELECT t.vec_id, p.place, c.j AS component, round(CASE WHEN p.place IN (1, 3) THEN greatest(sd, 1e-6) * {_normal_sql("'7:' || t.vec_id || ':' || p.place || ':' || c.j")} ELSE s[p.place + 1][c.j + 1] END, 6) AS noise,
round(CASE WHEN p.place IN (1, 3) THEN near[c.j + 1] ELSE s[p.place + 1][c.j + 1] END, 6) AS near, round(CASE WHEN p.place IN (1, 3) THEN mean[c.j + 1] ELSE s[p.place + 1][c.j + 1] END, 6) AS mean, round(CASE WHEN p.place IN (1, 3) THEN 0.0 ELSE s[p.place + 1][c.j + 1] END, 6)::DOUBLE AS zero
FROM t, (SELECT unnest([0, 1, 2, 3]) AS place) p, (SELECT unnest(range(8)) AS j) c""")
def replaced_sequences(spark, sf_dir):
    v = arrays.doubles(F.col("embedding"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(v, i * 8 + 1, F.lit(8))).alias("s"))
    idx = lambda *i: F.array(*map(F.lit, i))
    at = idx(1, 3)
    modes = {"noise": vectors.noised(F.col("s"), at, F.col("vec_id"), 7), "near": arrays.replaced(F.col("s"), at, "mean", idx(0, 2, 9)), "mean": arrays.replaced(F.col("s"), at, "mean", idx(9)), "zero": arrays.replaced(F.col("s"), at, "zero")}
    wide = d.select("vec_id", F.posexplode(F.arrays_zip(*[m.alias(n) for n, m in modes.items()])).alias("place", "z")).select("vec_id", "place", F.posexplode(F.arrays_zip(*[F.col(f"z.{n}").alias(n) for n in modes])).alias("component", "x"))
    return rounded(wide.select("vec_id", "place", F.col("component").cast("long").alias("component"), *[(F.col(f"x.{n}") + 0.0).alias(n) for n in modes]), 6)


_PARTS = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT vec_id, [v[1:8], v[9:16], v[17:24], v[25:32]] AS a, [v[33:40], v[41:48], v[49:56], v[57:64]] AS b FROM v)"


def _parts(spark, sf_dir):
    v = arrays.doubles(F.col("embedding"))
    cut = lambda at: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(v, i * 8 + at, F.lit(8)))
    return table(spark, sf_dir, "embeddings").select("vec_id", cut(1).alias("a"), cut(33).alias("b"))


@query(f"""WITH {_PARTS}, m AS (SELECT vec_id, a, b, list_transform(range(1, 9), lambda j: (a[2][j] + a[3][j]) / 2) AS ta, list_transform(range(1, 9), lambda j: (b[2][j] + b[3][j]) / 2) AS tb FROM s)
SELECT vec_id, round(1 - list_cosine_similarity(ta, tb), 6) AS tgt_cosine, round(list_distance(ta, tb), 6) AS tgt_l2, round(1 - list_cosine_similarity(a[3], b[3]), 6) AS prompt_last_cosine, round(list_distance(a[3], b[3]), 6) AS prompt_last_l2, round(1 - list_cosine_similarity(a[4], b[4]), 6) AS seq_last_cosine, round(list_distance(a[4], b[4]), 6) AS seq_last_l2 FROM m""")
def state_distances(spark, sf_dir):
    d = arrays.state_distances(F.col("a"), F.col("b"), F.array(F.lit(1), F.lit(2), F.lit(7)), F.lit(3))
    return rounded(_parts(spark, sf_dir).select("vec_id", d.alias("d")).select("vec_id", "d.*"))


@query(f"""WITH {_PARTS}, x AS (SELECT vec_id, a[1][1:(vec_id % 4)] AS x FROM s) SELECT vec_id, round(CASE WHEN len(x) = 0 THEN 0 ELSE list_avg(x) END, 6)::DOUBLE AS mean, round(CASE WHEN len(x) = 0 THEN 0 ELSE list_max(x) END, 6)::DOUBLE AS most, round(CASE WHEN len(x) = 0 THEN 0 ELSE list_sum(x) END, 6)::DOUBLE AS single FROM x""")
def span_reductions(spark, sf_dir):
    x = _parts(spark, sf_dir).select("vec_id", F.slice(F.get("a", F.lit(0)), F.lit(1), (F.col("vec_id") % 4).cast("int")).alias("x"))
    return rounded(x.select("vec_id", *[arrays.span_reduced(F.col("x"), m).alias(n) for n, m in (("mean", "mean"), ("most", "max"), ("single", "single"))]))


@query(f"""WITH {CAND}, s AS (SELECT task, candidate_id, count(*) AS n, stddev_pop(score_ties) AS a, stddev_pop(score_tax) AS b, corr(score_ties, score_tax) AS c FROM cand GROUP BY 1, 2)
SELECT task, candidate_id, CASE WHEN n < 3 OR a < 1e-12 OR b < 1e-12 THEN NULL ELSE round(c, 6) END AS correlation, true AS odd FROM s""")
def plain_correlations(spark, sf_dir):
    g = candidates(spark, sf_dir).groupBy("task", "candidate_id").agg(stats.pearson_of_all(F.col("score_ties"), F.col("score_tax")).alias("c"), stats.pearson_of_all(F.when(F.col("score_tax") >= 0, float("nan")), F.col("score_tax")).alias("o"))
    return rounded(g.select("task", "candidate_id", F.nanvl("c", F.lit(None)).alias("correlation"), F.isnan("o").alias("odd")))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '/data/a' || p_size WHEN 1 THEN '/root/dir/b' || p_size WHEN 2 THEN 'c' || p_size END AS path FROM part""")
def adapter_paths(spark, sf_dir):
    size = F.col("p_size").cast("string")
    ref = F.expr("CASE p_partkey % 5 WHEN 0 THEN '/data/a' || p_size WHEN 1 THEN './b' || p_size WHEN 2 THEN 'c' || p_size WHEN 3 THEN '/gone/' || p_size ELSE '' END")
    p = table(spark, sf_dir, "part").select("p_partkey", ref.alias("ref"), size.alias("size"))
    there = p.select(F.explode(F.array(F.concat(F.lit("/data/a"), "size"), F.concat(F.lit("/root/dir/b"), "size"), F.concat(F.lit("c"), "size"))).alias("path"))
    return files.adapter_paths(p, "p_partkey", "ref", there, "/root/dir/")
