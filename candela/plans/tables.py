"""Candidate, step and audit tables made of the star schema, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TASKS = {"1-URGENT": "counting", "2-HIGH": "attribute", "3-MEDIUM": "spatial", "4-NOT SPECIFIED": "existence", "5-LOW": "other"}


#: Order lines of a partition of the candidates, about: a task holds as much whatever the size of the tables.
ROWS = 200_000
#: Partitions into which a shuffle writes rows as they come (spark.shuffle.sort.bypassMergeThreshold); on the way into more, a task holds its rows in memory.
FEW = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parted(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows of a scan in partitions by key; into more than FEW they go by way of FEW, so that no task holds all rows of a file's split."""
    if parts > FEW:
        df = df.repartition(FEW, key).where(F.spark_partition_id() >= 0)  # true of every row: without a step between them, Spark makes one of two shuffles
    return df.repartition(parts, key)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order line: the order is the sample, its lines are the candidates.

    Partitions by order, as many as the rows call for, so that no task's sort or hash grows with the tables; what groups by sample needs no further shuffle.
    Parts beyond ROWS are met in as many partitions by their key, FEW at most, where the lines pass by and only the parts are held.  Lines of an order alike in number and price stand in the order of what else a candidate has,
    so that their places are the same in every run and query.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    parts = max(1, -(-max(line.count(), orders.count()) // ROWS))
    if part.count() <= ROWS:
        part = F.broadcast(part)
        line = line.repartition(FEW, "l_orderkey") if parts > FEW else line
    else:
        few = min(parts, FEW)
        line, part = line.repartition(few, "l_partkey"), part.repartition(few, "p_partkey").hint("shuffle_hash")
    named = line.join(part, line.l_partkey == part.p_partkey).repartition(parts, "l_orderkey")
    joined = named.join(parted(orders, "o_orderkey", parts).hint("shuffle_hash"), named.l_orderkey == orders.o_orderkey)
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "p_name", "l_returnflag", "l_discount", "l_tax", "l_quantity", "o_orderpriority")) - 1
    task = F.lit("other")
    for label, name in TASKS.items():
        task = F.when(F.col("o_orderpriority") == label, name).otherwise(task)
    nan = F.when(F.col("l_discount") == 0.05, float("nan")).when(F.col("l_tax") == 0.08, F.lit(None)).otherwise(F.col("l_discount"))
    return joined.select(F.col("l_orderkey").alias("sample_id"), place.alias("candidate_id"), F.col("l_extendedprice").alias("score_unique"), F.col("l_discount").alias("score_ties"), nan.alias("score_nan"),
                         F.col("l_tax").alias("score_tax"), (F.col("l_returnflag") == "R").alias("correct"), F.col("p_name").alias("raw_text"), task.alias("task"), F.col("l_quantity").cast("bigint").alias("answer_length"))


CAND = """cand AS (SELECT l_orderkey AS sample_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS INT) AS candidate_id,
  l_extendedprice AS score_unique, l_discount AS score_ties,
  CASE WHEN l_discount = 0.05 OR l_tax = 0.08 THEN NULL ELSE l_discount END AS score_nan, l_tax AS score_tax, l_returnflag = 'R' AS correct, p_name AS raw_text,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'counting' WHEN '2-HIGH' THEN 'attribute' WHEN '3-MEDIUM' THEN 'spatial' WHEN '4-NOT SPECIFIED' THEN 'existence' ELSE 'other' END AS task,
  CAST(l_quantity AS BIGINT) AS answer_length
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("reward"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("flag"), "lang", "source")


AUDIT = "audit AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS reward, quality = 1 AS correct, toxic = 1 AS flag, lang, source FROM documents JOIN labels USING (doc_id))"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per event: the user is the run, the event the step."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("reward"), F.col("event_type").alias("family"), "ts", "props")


STEPS = "steps AS (SELECT user_id AS run, event_id AS step, value AS reward, event_type AS family, ts, props FROM events)"
