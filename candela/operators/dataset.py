"""Canonical samples, splits, filters, shards, sampling and summaries of data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.geometry import box, data_split
from candela.functions.text import strip, task_family, text
from candela.operators.ranges import ROWS, mixed, numbered, ordinals, permuted_in_batches


def to_bool(x: Column) -> Column:
    """true/yes/y/1 and false/no/n/0, numbers by truth; else null."""
    t = strip(F.lower(text(x)))
    number = t.try_cast("double")
    return F.when(t.isin("true", "yes", "y", "1"), True).when(t.isin("false", "no", "n", "0"), False).when(number.isNotNull(), number != 0)


def canonical_samples(raw: DataFrame, dataset: str = "vqa", default_task: str = "unknown") -> DataFrame:
    """The 14 canonical columns; rows without a box of four numbers, a question or an answer go.  ``ord`` is the row's place in the file."""
    def have(c: str) -> Column:
        return F.col(c) if c in raw.columns else F.lit(None)
    boxes = box(F.coalesce(have("target_bbox"), have("bbox")).cast("array<string>"))
    pair = F.coalesce(F.nullif(text(have("pair_id")), F.lit("")), F.concat(F.lit("vg_pair_"), F.col("ord")))
    image = F.coalesce(have("image_id").cast("string"), F.lit("-1"))
    path = F.coalesce(F.nullif(text(have("image_file")), F.lit("")), F.nullif(text(have("image_path")), F.lit("")), F.lit(""))
    out = raw.select(
        pair.alias("pair_id"), F.coalesce(F.nullif(text(have("sample_uid")), F.lit("")), F.concat_ws(":", pair, F.col("ord").cast("string"))).alias("sample_uid"), image.alias("image_id"), path.alias("image_file"),
        have("image_width").cast("int").alias("image_width"), have("image_height").cast("int").alias("image_height"), F.coalesce(F.nullif(strip(F.lower(text(have("task_type")))), F.lit("")), F.lit(default_task)).alias("task_type"),
        strip(have("question")).alias("question"), strip(have("answer")).alias("answer"), boxes.alias("target_bbox"), to_bool(have("gt_present")).alias("gt_present"), F.lit(dataset).alias("dataset_name"),
        data_split(image).alias("data_split"), path.alias("source_image_path"))
    return out.where("target_bbox is not null and question <> '' and answer <> ''")


def of_task(df: DataFrame, wanted: str | None, column: str = "task_type") -> DataFrame:
    """Rows of one task; '', all, any and * stand for every task."""
    w = (wanted or "").strip().lower()
    return df if w in ("", "all", "any", "*") else df.where(F.col(column) == w)


def of_split(df: DataFrame, wanted: str | None, column: str = "data_split") -> DataFrame:
    w = {"test": "probe"}.get((wanted or "").strip().lower(), (wanted or "").strip().lower())
    return df.where(F.col(column) == w) if w in ("train", "val", "probe") else df


def allowed(df: DataFrame, names: list[str], column: str = "task_type") -> DataFrame:
    """Rows whose task or family is named."""
    return df.where(F.col(column).isin(*names) | task_family(F.col(column)).isin(*names)) if names else df


def positive_only(df: DataFrame, column: str = "gt_present") -> DataFrame:
    return df.where(F.col(column))


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same seed on any cluster: a top-n by hash, without a full sort."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def text_first(df: DataFrame, key: str, n: int, name: str = "place") -> DataFrame:
    """The first n rows by the key as text, with their place from 1; a top-n without a sort of the whole."""
    first = df.orderBy(F.col(key).cast("string")).limit(n)
    listed = first.agg(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("_k"), F.struct(*df.columns).alias("_r")))).alias("a"))  # n rows
    return listed.select(F.posexplode("a").alias("_p", "x")).select("x._r.*", (F.col("_p") + 1).cast("long").alias(name))


def _in_range(shards: int, shard: int) -> None:
    if not 0 <= shard < shards:
        raise ValueError("shard must be in 0 .. shards - 1")


def modulo_shard(df: DataFrame, shards: int, shard: int, order: str) -> DataFrame:
    """Rows whose place by ``order`` is ``shard`` modulo ``shards``."""
    _in_range(shards, shard)
    return ordinals(df, order, "_place").where(F.pmod(F.col("_place"), F.lit(shards)) == shard).drop("_place")


def range_shard(df: DataFrame, shards: int, shard: int, order: str) -> DataFrame:
    """Rows of places [k * ceil(N / n), ...) by ``order``."""
    _in_range(shards, shard)
    size = -(-df.count() // shards)
    return ordinals(df, order, "_place").where(F.col("_place").between(shard * size, (shard + 1) * size - 1)).drop("_place")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))


def pair_summary(df: DataFrame, pair: str) -> DataFrame:
    """(size, pairs): histogram of the sizes of pairs."""
    return df.groupBy(pair).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("pairs"))


def integrity(df: DataFrame, resolved: Column, order: str, most: int) -> DataFrame:
    """One row over the first ``most`` rows: checked, ok, missing, rate."""
    first = df.withColumn("_ok", F.coalesce(resolved, F.lit(False))).orderBy(order).limit(most)
    return first.agg(F.count("*").alias("checked"), F.count_if("_ok").alias("ok"), F.count_if(~F.col("_ok")).alias("missing"), F.coalesce(F.avg(F.col("_ok").cast("int")), F.lit(0.0)).alias("rate"))


def train_budget(df: DataFrame, family: str, epochs: float) -> DataFrame:
    """One row: families, smallest family, size of a balanced epoch, steps, share of rows drawn."""
    sizes = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.count("*").alias("n"))
    out = sizes.agg(F.count("*").alias("families"), F.min("n").alias("min_family_size"), F.sum("n").alias("rows"))
    size = F.col("families") * F.col("min_family_size")
    return out.select("families", "min_family_size", size.alias("balanced_epoch_size"), F.ceil(F.lit(float(epochs)) * size).alias("effective_steps"), (F.ceil(F.lit(float(epochs)) * size) / F.col("rows")).alias("coverage"))


def balanced_draws(df: DataFrame, family: str, key: str, epochs: int, seed: int = 42, rows_of_block: int = ROWS) -> DataFrame:
    """(step, family, key): families take turns, each without replacement; a family that is used up is shuffled anew.

    Draw n of a family comes at step n * families + turn and is the row at place n mod size of the permutation of cycle n div size, which is
    worked out by arithmetic: the draws are a range of numbers, joined to the rows by their number in the family, and no family is sorted.
    """
    spark = df.sparkSession
    rows = numbered(df.where(F.col(family).isNotNull()).select(F.col(family).alias("family"), F.col(key).alias("key")), "family", "key", "row", rows_of_block)
    sizes = rows.groupBy("family").agg(F.count("*").alias("size"))  # a row per family
    turns = sizes.withColumn("turn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("family")) - 1)
    whole = sizes.agg(F.min("size").alias("least"), F.count("*").alias("families")).first()
    draws = spark.range((whole.least or 0) * epochs * whole.families).select(F.col("id").alias("step"), (F.col("id") % F.lit(max(1, whole.families))).cast("int").alias("turn"), F.expr(f"id div {max(1, whole.families)}").alias("n"))
    drawn = draws.join(F.broadcast(turns), "turn").withColumns({"cycle": F.expr("n div size"), "place": F.col("n") % F.col("size")}).withColumn("own", mixed(seed, F.col("turn"), F.col("cycle")))
    drawn = drawn.select("step", "family", permuted_in_batches(F.col("place"), F.col("size"), F.col("own")).alias("row"))
    return drawn.join(rows, ["family", "row"]).select("step", "family", "key")


def stratified_choice(df: DataFrame, family: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, as even over the families as their sizes allow: shares first, then a top-up in hash order; ``key`` is unique.

    No family is sorted as a whole: its share is a limit per group, and the top-up comes from the first rows by hash.
    """
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    turns = df.select(family).distinct().withColumn("_turn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(family)))  # a row per family
    families = turns.count() or 1
    base, extra = divmod(n, families)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(family).orderBy(h, key))).where(F.col("_rank") <= base + 1)
    shares = ranked.join(F.broadcast(turns), family).where(F.col("_rank") <= base + (F.col("_turn") <= extra).cast("int")).select(*df.columns, F.lit(0).alias("_over"))
    first = df.orderBy(h, key).limit(2 * n + families).select(*df.columns, F.lit(1).alias("_over"))
    more = first.join(shares.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")
    return shares.unionByName(more).orderBy("_over", h, key).limit(n).drop("_over")
