"""Groups of candidates brought to a fixed number, and what a run's files hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.operators.evaluate import candidates_per_group
from candela.sources import files


def completed(samples: DataFrame, unique: DataFrame, group: str, k: int, least: int = 0, rounds: int = 1, fill: bool = True) -> DataFrame:
    """Each group of ``samples`` with candidates 0..k-1: those of ``unique`` (numbered from 0 without gaps), then these again from the first on; with ``fill`` off, no more than there are.

    Candidate i past the U that there are repeats number (i - U) mod U; a group without any gets rows whose columns are null and that repeat nothing.
    Nothing is gathered by group: slots are made from the count alone and joined to the candidates by number.
    """
    counts = unique.groupBy(group).agg(F.count("*").alias("_u"))
    sized = samples.select(group).distinct().join(counts, group, "left").withColumn("_u", F.coalesce("_u", F.lit(0)).cast("int"))
    last = F.greatest("_u", F.lit(k)) if fill else F.col("_u")
    slots = sized.where(last > 0).withColumn("_last", last.cast("int")).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_last") - 1)))
    source = F.when(F.col("_slot") < F.col("_u"), F.col("_slot")).when(F.col("_u") > 0, F.pmod(F.col("_slot") - F.col("_u"), F.col("_u")))
    slots = slots.withColumn("_source", source).withColumnRenamed(group, "_group")
    kept = unique.withColumnRenamed("candidate_id", "_id")
    rows = slots.join(kept, (F.col("_group") == F.col(group)) & (F.col("_source") == F.col("_id")), "left")
    extra = F.col("_slot") >= F.col("_u")
    return rows.select(F.col("_group").alias(group), F.col("_slot").alias("candidate_id"), *[c for c in unique.columns if c not in (group, "candidate_id")], extra.alias("is_duplicate_candidate"), F.when(extra, F.col("_source")).alias("duplicate_of_candidate_id"),
                       F.lit(rounds).alias("n_sampling_rounds"), F.col("_u").alias("n_unique_candidates_before_fill"), F.lit(least).alias("min_unique_candidates"), (F.col("_u") >= least).alias("min_unique_satisfied"), F.lit(k).alias("requested_num_candidates"),
                       F.lit(fill).alias("allow_duplicate_fill"), (F.lit(fill) & (F.col("_u") < k)).alias("duplicate_fill_applied"), F.col("_last").alias("n_candidates_post_fill"))


def run_manifest(spark: SparkSession, named: dict[str, str], candidates: DataFrame, group: str) -> DataFrame:
    """(name, path, files, bytes, md5, rows, least, most, mean, upper_median) of each named file or folder; the last four, of candidates per group, are the same in each row.

    ``md5`` is that of a file, or of a folder's files' in the order of their names; n/a where a file is missing or too large to be hashed whole. ``rows`` are lines that are not blank, -1 where nothing can be read.
    """
    per = candidates_per_group(candidates, group)
    out = None
    for name, path in named.items():
        listed = files.manifest(spark, path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.array_sort(F.collect_list(F.struct("path", "md5"))).alias("l"))  # a row for each file
        md5 = F.when(F.col("files") == 1, F.col("l")[0]["md5"]).when((F.col("files") > 1) & ~F.exists("l", lambda x: x["md5"].isNull()), F.md5(F.array_join(F.transform("l", lambda x: x["md5"]), "")))
        row = listed.select(F.lit(name).alias("name"), F.lit(path).alias("path"), "files", "bytes", F.coalesce(md5, F.lit("n/a")).alias("md5"), F.lit(files.line_count(spark, path)).cast("long").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out.join(F.broadcast(per))  # one row
