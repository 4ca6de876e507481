"""Queries over files of records: shards of JSON lines with blank, bad and missing parts, merged with their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.plans.catalog import query
from candela.plans.tables import table
from candela.sources import files
from candela.sources.shared import fresh_folder

SHARDS, MISSING = 4, 2
FIELDS = "conv_id long, turn long, role string, text string"


def shards(spark: SparkSession, sf_dir: str, bad: bool) -> list[str]:
    """Folders of JSON lines made of conversations, dealt by conversation; a blank line after some records, a bad one after others, one folder missing."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = F.array(F.when(F.col("turn") % 3 == 0, F.lit("  ")), F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), F.lit("{bad")) if bad else F.lit(None).cast("string"))
    lines = c.select("conv_id", "turn", F.posexplode(F.array_compact(F.concat(F.array(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})), extra))).alias("k", "value"))
    folder = fresh_folder(spark, "shards")
    for i in range(SHARDS):
        if i != MISSING:
            part = lines.where(F.col("conv_id") % SHARDS == i).repartitionByRange("conv_id", "turn", "k").sortWithinPartitions("conv_id", "turn", "k")
            part.select("value").write.text(f"{folder}/{i}")
    return [f"{folder}/{i}" for i in range(SHARDS)]


def _lines(bad: bool) -> str:
    more = "CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 'bad' END" if bad else "NULL"
    return f"""l AS (SELECT conv_id % {SHARDS} AS shard, conv_id, turn, role, text, unnest(list_filter(['good', CASE WHEN turn % 3 = 0 THEN 'blank' END, {more}], lambda x: x IS NOT NULL)) AS kind FROM conversations WHERE conv_id % {SHARDS} <> {MISSING}),
o AS (SELECT *, CASE kind WHEN 'good' THEN 0 WHEN 'blank' THEN 1 ELSE 2 END AS k FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY conv_id, turn, k) AS line FROM o),
m AS (SELECT *, row_number() OVER (ORDER BY shard, line) - 1 AS ordinal FROM n WHERE kind <> 'blank'),
r AS (SELECT CAST(shard AS INT) AS shard, line, ordinal, conv_id, CAST(turn AS BIGINT) AS turn, role, md5(text) AS digest FROM m WHERE kind = 'good')"""


def _digest(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", F.md5("text")).drop("text")


@query(f"WITH {_lines(False)} SELECT * FROM r")
def merged_records(spark, sf_dir):
    return _digest(files.merge_jsonl(spark, shards(spark, sf_dir, False), FIELDS))


@query(f"WITH {_lines(True)} SELECT * FROM r")
def merged_records_lenient(spark, sf_dir):
    return _digest(files.merge_jsonl(spark, shards(spark, sf_dir, True), FIELDS, strict=False))


@query(f"WITH {_lines(True)} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY turn, role ORDER BY ordinal) = 1")
def first_records(spark, sf_dir):
    return _digest(files.first_wins(files.merge_jsonl(spark, shards(spark, sf_dir, True), FIELDS, strict=False), ["turn", "role"]))


@query(f"WITH {_lines(True)} SELECT ordinal, CAST(CASE WHEN kind = 'bad' THEN NULL ELSE conv_id END AS BIGINT) AS conv_id, CAST(CASE WHEN kind = 'bad' THEN NULL ELSE turn END AS BIGINT) AS turn FROM m")
def merged_file(spark, sf_dir):
    """The merged file, written and read again with the numbers of its lines."""
    path = fresh_folder(spark, "merged")
    files.write_merged(files.ordered_lines(spark, shards(spark, sf_dir, True)), path)
    return files.ordered_lines(spark, [path]).select("ordinal", *[F.get_json_object("value", f"$.{c}").cast("long").alias(c) for c in ("conv_id", "turn")])
