"""Text and CSV inputs of the offline side."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.training import FLOW_COLUMNS
from ..schemas import TRAINING

# The tokens of a prediction log line.
ACTUAL_TOKEN, PRED_TOKEN = "ACTUAL=", "PRED="


def read_flow_csv(spark: SparkSession, path) -> DataFrame:
    """Labelled flow files (one path, a folder or a list) with plain column names.

    Only the six needed of the many columns are parsed. Files are grouped by their header line, and
    each group is read by its own; empty files have no rows.
    """
    layouts = groupby(_headers(spark, path), key=itemgetter(0))
    parts = [_flow_rows(spark, [file for _, file in found]) for _, found in layouts]
    if not parts:
        raise ValueError(f"no flow rows in {path}")
    return reduce(DataFrame.unionByName, parts)


def _headers(spark: SparkSession, path, threads: int = 16) -> list[tuple[str, str]]:
    """(header, file) of each file with any line. One small job reads a file's first block and stops; several run at a time."""
    files = [r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # names only

    def first(file: str) -> list:
        return spark.read.text(file).head(1)

    with ThreadPoolExecutor(threads) as pool:
        return sorted((found[0][0], file) for file, found in zip(files, pool.map(first, files), strict=True) if found)


def _flow_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(files)
    by_name = {c.strip(): c for c in raw.columns}
    return raw.select(*[
        (F.col(f"`{by_name[header.strip()]}`") if name == "label"
         else F.col(f"`{by_name[header.strip()]}`").try_cast("double")).alias(name)
        for name, header in FLOW_COLUMNS.items()
    ])


def parse_prediction_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """`ACTUAL=x PRED=y` lines -> (actual, pred); lines missing either token are skipped."""
    def token(name):
        return F.regexp_extract(column, rf"(?:^|\s){name}(\S+)", 1)

    return lines.select(token(ACTUAL_TOKEN).alias("actual"), token(PRED_TOKEN).alias("pred")).filter(
        (F.col("actual") != "") & (F.col("pred") != "")
    )


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_prediction_lines(spark.read.text(path))


def read_training(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Prepared training rows, with the fixed schema rather than an inferred one."""
    reader = spark.read.schema(TRAINING)
    return reader.option("header", True).csv(path) if format == "csv" else reader.parquet(path)
