"""JSON lines tables: typed reads, ordered reads, counts and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.schemas import GLOSSARY_FILE
from lectern.session import exists


def read_jsonl(spark: SparkSession, path: str, schema: str, quarantine: bool = False) -> DataFrame:
    """Typed rows; a bad line is an error, or is kept in ``_corrupt_record``."""
    if quarantine:
        return (
            spark.read.schema(f"{schema}, _corrupt_record string")
            .option("mode", "PERMISSIVE")
            .json(path)
        )
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the files under a path with their place: (file, line_no, value), line numbers from 1.

    A file may be read in many splits. Rows are numbered as they are read; the first number of
    each split and its count of lines, a few numbers per split, give the line a split begins at.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(starts, ["file", "block"]).select(
        "file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "value")


def parsed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line_no, row, error) of all non-blank lines; ``error`` names file and line where one is no JSON row."""
    found = numbered_lines(spark, path).filter(strip(F.col("value")) != "")
    row = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    error = F.when(
        F.col("row._corrupt_record").isNotNull(),
        F.format_string("failed to parse %s line %d", "file", "line_no"))
    return found.withColumn("row", row).select("file", "line_no", F.col("row").dropFields("_corrupt_record").alias("row"), error.alias("error"))


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows; a bad line ends the job with its file and line number."""
    rows = parsed_lines(spark, path, schema)
    return rows.select(F.when(F.col("error").isNull(), F.col("row")).otherwise(F.raise_error(F.col("error"))).alias("row")).select("row.*")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A single JSON document, or no row when the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_if_any(df: DataFrame, path: str) -> bool:
    """Write JSON lines unless there are no rows; tells whether it wrote."""
    if df.isEmpty():
        return False
    write_jsonl(df, path)
    return True


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row with the number of non-blank lines; a missing file counts zero."""
    if not exists(spark, path):
        return spark.range(1).select(F.lit(0).cast("long").alias("lines"))
    return spark.read.text(path).filter(strip(F.col("value")) != "").agg(F.count("*").alias("lines"))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a folder with their file and place: (file, place, value).

    The id grows with the position inside a split and splits are told apart by their
    offset, so the pair orders the lines of one file.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.struct(
                F.col("_metadata.file_block_start").alias("offset"),
                F.monotonically_increasing_id().alias("id"),
            ).alias("place"),
            "value",
        )
        .filter(strip(F.col("value")) != "")
    )


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """Glossary file as (pos, src, dst), trimmed, in file order."""
    return (
        spark.read.schema(GLOSSARY_FILE)
        .option("multiLine", True)
        .json(path)
        .select(F.posexplode("entries").alias("place", "entry"))
        .select(
            (F.col("place") + 1).alias("pos"),
            strip(F.col("entry.src")).alias("src"),
            strip(F.col("entry.dst")).alias("dst"),
        )
    )


def write_text(df: DataFrame, path: str) -> None:
    """Write a one-column table as text."""
    df.write.mode("overwrite").text(path)


def concatenated(lines: DataFrame, part_index: Column) -> DataFrame:
    """Lines of numbered part files with their place in the part; a part has a bounded size."""
    order = Window.partitionBy("part_index").orderBy("file", "place")
    return (
        lines.withColumn("part_index", part_index)
        .withColumn("place", F.row_number().over(order).cast("long"))
        .select("part_index", "place", "value")
    )
