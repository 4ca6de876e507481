"""Record files: lines of JSON, documents, tables and name lists, read and written by Spark alone."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from candela.functions.text import strip
from candela.sources.shared import written


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str, strict: bool = True, missing_ok: bool = True) -> DataFrame:
    """Rows of lines of JSON. Strict: a bad line raises when it is read; else it is left out. A path that is missing gives no rows."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    try:
        return reader.json(path)
    except AnalysisException as e:
        if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_jsonl_audited(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines)."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    both = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r"), "value")
    return both.where("r._corrupt_record is null").select("r.*").drop("_corrupt_record"), both.where("r._corrupt_record is not null").select("value")


def read_document(spark: SparkSession, path: str, schema: str, missing: dict | None = None) -> dict | None:
    """One JSON document as a dict; ``missing`` where there is none or it can't be parsed."""
    try:
        row = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return missing
    if row is None or row["_corrupt_record"] is not None:
        return missing
    return {k: v for k, v in row.asDict(recursive=True).items() if k != "_corrupt_record"}


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("name")).where("name <> ''")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


#: Blocks of input up to which their table is broadcast (a block is some 128 MB of input); more are joined by shuffle.
BLOCK_ROWS = 1_000_000


def _shard_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(file, shard, its place in the shard) of all shards that are there; files of a folder go by name."""
    out = []
    for shard, path in enumerate(paths):
        try:
            found = spark.read.text(path).inputFiles()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        out += [(f, shard, i) for i, f in enumerate(sorted(found))]
    return out


def ordered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(shard, line, ordinal, value) of the lines that are not blank: the path's place in the list, the line's number in it from 1
    (blank ones count), and its number from 0 among all lines that are not blank, in the order of the list.

    Nothing is sorted: rows are numbered where they are read, a first pass counts the lines of each block of a file, and the sums
    over the blocks before give where each block's numbers begin. Missing paths are left out; a path named twice is read twice.
    """
    if not paths:
        raise ValueError("no paths")
    listed = _shard_files(spark, paths)
    if not listed:
        return spark.createDataFrame([], "shard int, line long, ordinal long, value string")
    # local files are named with one or with three strokes
    files = spark.createDataFrame([(re.sub("^file:/+", "file:/", f), shard, i) for f, shard, i in listed], "_file string, shard int, _place int")  # a row for each file that the driver has listed
    blank = strip(F.col("value")) == ""
    read = spark.read.text(sorted({f for f, _, _ in listed})).select("value", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    read = read.withColumn("_row", F.monotonically_increasing_id())
    w = Window.partitionBy("_task").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    blocks = read.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_lines"), F.count_if(~blank).alias("_kept"))
    # a task numbers the lines it keeps over all its blocks
    blocks = blocks.withColumn("_task", F.shiftright("_first", 33)).withColumn("_first_kept", F.shiftleft("_task", 33) + F.coalesce(F.sum("_kept").over(w), F.lit(0)))
    before = Window.partitionBy("shard").orderBy("_place", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(blocks.join(F.broadcast(files), "_file").select("_file", "_block", "_first", "_first_kept", "_kept", "shard", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_line"), F.coalesce(F.sum("_kept").over(before), F.lit(0)).alias("_ordinal")), "blocks")
    total, begins, at = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("_kept").alias("n")).collect()}, [], 0  # a row for each path
    for shard in range(len(paths)):
        begins.append((shard, at))
        at += total.get(shard, 0)
    blocks = blocks.join(F.broadcast(spark.createDataFrame(begins, "shard int, _begin long")), "shard")
    kept = read.where(~blank).withColumn("_nth", F.monotonically_increasing_id())
    few = blocks.count() <= BLOCK_ROWS
    return (kept.join(F.broadcast(blocks) if few else blocks, ["_file", "_block"])
            .select("shard", (F.col("_row") - F.col("_first") + F.col("_line") + 1).alias("line"), (F.col("_nth") - F.col("_first_kept") + F.col("_ordinal") + F.col("_begin")).alias("ordinal"), "value"))


def merge_jsonl(spark: SparkSession, paths: list[str], schema: str, strict: bool = True) -> DataFrame:
    """Records of all shards that are there with shard, line and ordinal of ``ordered_lines``. Strict: a bad line raises when it is read; else it is left out, and its numbers with it."""
    fields = StructType.fromDDL(schema).fieldNames()
    if {f.lower() for f in fields} & {"shard", "line", "ordinal"}:
        raise ValueError("records may have no field of the name shard, line or ordinal")
    if strict:
        parsed = ordered_lines(spark, paths).withColumn("_r", F.from_json("value", schema, {"mode": "FAILFAST"}))
    else:
        parsed = ordered_lines(spark, paths).withColumn("_r", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})).where("_r._corrupt_record is null")
    return parsed.select("shard", "line", "ordinal", *[F.col(f"_r.`{f}`").alias(f) for f in fields])


def write_merged(lines: DataFrame, path: str) -> None:
    """``ordered_lines`` as files of text whose names follow the order of their lines."""
    lines.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("value").write.mode("overwrite").text(path)


def first_wins(records: DataFrame, key: list[str]) -> DataFrame:
    """Of records with equal keys the one that comes first; one aggregate, combined before it shuffles."""
    rest = [c for c in records.columns if c not in key]
    return records.groupBy(*key).agg(F.min_by(F.struct(*rest), "ordinal").alias("_r")).select(*key, "_r.*")


#: Largest file whose content Spark reads into one row.
WHOLE = (1 << 31) - 1


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, md5) of each file; md5 is null for one too large to be read whole. A path that is missing gives no rows."""
    try:
        found = spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "path string, length long, md5 string")
        raise
    whole = found.where(F.col("length") <= WHOLE).select("path", "length", F.md5("content").alias("md5"))
    return whole.unionByName(found.where(F.col("length") > WHOLE).select("path", "length", F.lit(None).cast("string").alias("md5")))


def line_count(spark: SparkSession, path: str) -> int:
    """Lines that are not blank; -1 where nothing can be read."""
    try:
        return spark.read.text(path).where(strip(F.col("value")) != "").count()
    except AnalysisException:
        return -1


def image_candidates(ref: Column, root: str) -> Column:
    """Places where an image may be, in the order in which they are tried."""
    base = root.rstrip("/")
    last = base.rsplit("/", 1)[-1]
    inside = F.when(ref.startswith(last + "/"), F.concat(F.lit(base + "/"), F.substr(ref, F.lit(len(last) + 2), F.length(ref))))
    tries = F.array(F.when(ref.startswith("/"), ref), F.concat(F.lit(base + "/"), ref), inside, ref)
    return F.when(F.coalesce(ref, F.lit("")) != "", F.array_distinct(F.array_compact(tries))).otherwise(F.array().cast("array<string>"))


def plain_path(path: Column) -> Column:
    """Without doubled strokes, ``.`` parts and a stroke at the end."""
    out = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(out, r"^(\./)+(?=.)", ""), "(?<=.)/+$", "")


def adapter_candidates(ref: Column, root: str) -> Column:
    """Places of a data set's own reference, in order: an absolute one as it is; another under the root, then as it is."""
    tries = F.when(ref.startswith("/"), F.array(ref)).otherwise(F.transform(F.array(*([F.concat(F.lit(root.rstrip("/") + "/"), ref)] if root else []), ref), plain_path))
    return F.when(F.coalesce(ref, F.lit("")) != "", F.array_distinct(tries)).otherwise(F.array().cast("array<string>"))


def adapter_paths(samples: DataFrame, key: str, ref: str, files: DataFrame, root: str) -> DataFrame:
    """(key, path): the first of ``adapter_candidates`` that is among ``files(path)``; null if none is."""
    long = samples.select(key, F.posexplode_outer(adapter_candidates(F.col(ref), root)).alias("pos", "path"))
    found = long.join(files.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "pos").alias("path"))
    return samples.select(key).join(found, key, "left")


def resolved_paths(samples: DataFrame, key: str, refs: list[str], files: DataFrame, root: str) -> DataFrame:
    """(key, path): the first candidate of the references in order that is among ``files(path)``; null if none is."""
    tries = F.flatten(F.array(*[image_candidates(F.col(r), root) for r in refs]))
    long = samples.select(key, F.posexplode_outer(tries).alias("pos", "path"))
    found = long.join(files.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "pos").alias("path"))
    return samples.select(key).join(found, key, "left")


def split_pools(rows: DataFrame, verifier: list[str], diagnostic: list[str]) -> DataFrame:
    """Rows of both pools of strategies, named in ``pool``; what is in both counts as verifier."""
    v = rows.where(F.col("strategy").isin(*verifier)).withColumn("pool", F.lit("verifier"))
    d = rows.where(F.col("strategy").isin(*diagnostic) & ~F.col("strategy").isin(*verifier)).withColumn("pool", F.lit("diagnostic"))
    return v.unionByName(d)


def diversity_path(output: str) -> str:
    """Name of the diversity file beside an output, without its shard's number."""
    stem = re.sub(r"\.jsonl$", "", output)
    return re.sub(r"([._-]shard\d+([._-]of[._-]?\d+)?)$", "", stem) + "_diversity.json"


def nested_groups(df: DataFrame, group: str, order: str, columns: list[str], n: int) -> DataFrame:
    """The first n groups as a header and ``samples``, an array in order."""
    first = df.select(group).distinct().orderBy(group).limit(n)
    rows = df.join(F.broadcast(first), group)
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("samples"))


def without_columns(df: DataFrame, heavy: list[str]) -> DataFrame:
    return df.drop(*heavy)
