"""Rendezvous hashing of stable record keys over weighted shards (DataFrame functions only).

Every shard s of weight w draws u in (0, 1) from a hash of (key, s); a key goes
to the shard with the largest -w / ln(u).  A key and the set of shards decide
alone, so a further shard takes keys only into itself and a share w / sum(w) of them.

Defined results: a null key is hashed as a key of its own, one distinct from
every string; a null or empty text has size 1 and checksum 0; rows with the same
key go to the same shard and take different slots, in arbitrary order among rows
that are equal in key, checksum and size; an empty table gives an empty table;
other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Numbering splits each shard into so many buckets, so that no task numbers a whole shard.
BUCKETS = 1024


def _draw(key: Column, shard: int) -> Column:
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of ``key`` over shards 0.. with these weights (0: takes nothing)."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one at least must be positive")
    key = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    scores = [F.struct((F.lit(float(-w)) / F.log(_draw(key, s))).alias("score"), F.lit(-s).alias("s"))
              for s, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*scores))["s"]).cast("int")


def shard_table(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 8,
                next_weight: float = 1.0) -> DataFrame:
    """Shard, slot within the shard and the shard after one more of ``next_weight`` joins.

    Slots count from 0 without gaps.  They are numbered within (shard, bucket) and
    moved by the rows of the buckets before; the table of those counts has at most
    len(weights) x BUCKETS rows whatever the input, so it is broadcast.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"), rendezvous(F.col(key), [*weights, next_weight]).alias("grown_shard"),
    ).withColumn("_bucket", F.pmod(F.xxhash64(F.col("_key").cast("string"), "text_crc32", "size"), F.lit(BUCKETS)).cast("int"))
    per = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    ahead = per.select("shard", "_bucket", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_ahead"))
    within = Window.partitionBy("shard", "_bucket").orderBy("_key", "text_crc32", "size")
    return (rows.withColumn("_at", F.row_number().over(within))
            .join(F.broadcast(ahead), ["shard", "_bucket"])
            .select(F.col("_key").alias(key), "size", "text_crc32", "law", "shard",
                    (F.col("_ahead") + F.col("_at") - 1).cast("long").alias("slot"), "grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
