"""Summaries of a data set and of a file of scored records, each a row or a small table, with maps and bounded examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.geometry import data_split
from candela.operators import dataset, rewards
from candela.operators.audit import field_coverage, record_status
from candela.operators.reports import examples

# How many examples of failures go into a report.
MOST_EXAMPLES = 20


def checked_ratios(train: float, val: float) -> None:
    if not (0 < train < 1 and 0 <= val < 1 and train + val < 1):
        raise ValueError("train and val must be shares that leave one for probe")


def counts_by(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row: a map of value to count for each of the columns, blank values as unknown; one shuffle of (column, value)."""
    blank = {n: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("unknown")) for n, c in columns.items()}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), c.alias("v")) for n, c in blank.items()])).alias("e")).groupBy("e.n", "e.v").agg(F.count("*").alias("k"))
    maps = [F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(F.when(F.col("n") == n, F.struct("v", "k")))))).alias(n) for n in columns]
    return long.agg(*maps)  # a row for each value


def dataset_summary(raw: DataFrame, samples: DataFrame, resolved: Column, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """One row over canonical samples: counts, pairs and their sizes, tasks, splits and kinds of labels as maps, images found and images with a size."""
    checked_ratios(train, val)
    has_size = (F.coalesce(F.col("image_width"), F.lit(0)) > 0) & (F.coalesce(F.col("image_height"), F.lit(0)) > 0)
    pairs = dataset.pair_summary(samples, "pair_id").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pair_id_unique"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("size", "pairs")))).alias("pair_id_size_distribution"),
                                                         F.coalesce(F.sum(F.when(F.col("size") == 2, F.col("pairs"))), F.lit(0)).alias("_two"))
    figures = samples.agg(F.count("*").alias("valid_count"), F.count_if(F.coalesce(resolved, F.lit(False))).alias("image_path_resolve_ok_count"), F.count_if(has_size).alias("has_image_size_count"))
    kinds = F.when(F.col("gt_present").isNull(), "NoneType").otherwise("bool")
    out = figures.join(F.broadcast(pairs)).join(F.broadcast(counts_by(samples, {"task_type_distribution": F.col("task_type"), "split_distribution": F.col("data_split"), "gt_present_type_distribution": kinds})))
    out = out.join(F.broadcast(raw.agg(F.count("*").alias("raw_count"))))  # each side is one row
    n = F.greatest(F.col("valid_count"), F.lit(1))
    return out.select("raw_count", "valid_count", (F.col("raw_count") - F.col("valid_count")).alias("dropped_count"), F.lit(train).alias("train_ratio"), F.lit(val).alias("val_ratio"), F.lit(1.0 - train - val).alias("probe_ratio"), "pair_id_unique", "pair_id_size_distribution",
                      (F.col("_two") / F.greatest("pair_id_unique", F.lit(1))).alias("pair_id_exactly_two_ratio"), "task_type_distribution", "split_distribution", "gt_present_type_distribution", "image_path_resolve_ok_count",
                      (F.col("image_path_resolve_ok_count") / n).alias("image_path_resolve_ok_rate"), "has_image_size_count")


def loaded(raw: DataFrame, resolved: Column, task: str | None = None, split: str | None = None, most: int = 0, seed: int = 42, train: float = 0.8, val: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Canonical samples of a task and split by the given ratios, at most ``most`` of them by hash, and the summary of what was loaded. Ratios that leave no share raise."""
    checked_ratios(train, val)
    samples = dataset.canonical_samples(raw).withColumn("data_split", data_split(F.col("image_id"), train, val))
    samples = dataset.of_split(dataset.of_task(samples, task), split)
    samples = dataset.hash_sample(samples, most, "sample_uid", seed) if most > 0 else samples
    return samples, dataset_summary(raw, samples, resolved, train, val)


def integrity_report(samples: DataFrame, resolved: Column, order: str, most: int, columns: list[str]) -> DataFrame:
    """``dataset.integrity`` with the first MOST_EXAMPLES rows that fail as ``bad_path_examples``, in order."""
    first = samples.orderBy(order).limit(most) if most > 0 else samples
    bad = examples(first.where(~F.coalesce(resolved, F.lit(False))).withColumn("_all", F.lit(0)), ["_all"], [F.col(order)], columns, MOST_EXAMPLES).select("examples")
    none = F.array().cast(bad.schema["examples"].dataType)
    checked = dataset.integrity(samples, resolved, order, most) if most > 0 else first.agg(F.count("*").alias("checked"), F.count_if(resolved).alias("ok"), F.count_if(~F.coalesce(resolved, F.lit(False))).alias("missing"), F.coalesce(F.avg(F.coalesce(resolved, F.lit(False)).cast("int")), F.lit(0.0)).alias("rate"))
    return checked.join(F.broadcast(bad), F.lit(True), "left").withColumn("bad_path_examples", F.coalesce("examples", none)).drop("examples")


# -- scored records ------------------------------------------------------------------------------

def rederived(records: DataFrame, js: str, cos: str, l24: str, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """Raw metric records with the rewards worked out anew from them: the three metrics as rewards, and both mixes; null or NaN metrics give null."""
    def fine(c: str) -> Column:
        d = F.col(c).try_cast("double")
        return F.when(~F.isnan(d), d)
    mixed = rewards.ced_rewards(fine(js), fine(cos), fine(l24), alpha, beta)
    return records.withColumns({"reward_logits_js": fine(js), "reward_logits_cosine_dist": fine(cos), "reward_layer24_prompt_last_cosine": fine(l24), "reward_mix_js_promptlast": mixed["mix_js"], "reward_mix_cosine_promptlast": mixed["mix_cos"]})


def statuses(records: DataFrame, fields: list[str], backend_known: Column, error: Column) -> DataFrame:
    """(status, n): the histogram of all six statuses of scored records."""
    status = F.when(F.coalesce(error, F.lit(False)), "error").otherwise(record_status(fields, backend_known))
    return records.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def active_rewards(records: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry's rewards that the records hold, with present, finite and finite_rate, and whether any is finite; joined by name to the small registry."""
    known = [r.name for r in registry.select("name").collect() if r.name in records.columns]  # the registry is a list in code
    if not known:
        return registry.limit(0).withColumns({"present": F.lit(0), "finite": F.lit(0), "finite_rate": F.lit(0.0), "active": F.lit(False)})
    return field_coverage(records, known).join(F.broadcast(registry), F.col("field") == F.col("name")).drop("field")


def schema_summary(records: DataFrame, registry: DataFrame) -> DataFrame:
    """(flag, names): lists of eligibility and reasons over the rewards that are active in the records."""
    return rewards.registry_summary(active_rewards(records, registry).where("active"))
