"""Peak coordinates, study metadata, and where data lives. Nothing is downloaded: paths only."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA_DIR_VARIABLE = "TEXTMAP_DATA_DIR"


def data_dir(path: str | None = None) -> str:
    """The path given, else that of the environment, else one below home. Made if missing."""
    chosen = path or os.environ.get(DATA_DIR_VARIABLE) or os.path.join(os.environ.get("HOME", "."), "textmap_data")
    os.makedirs(chosen, exist_ok=True)
    return str(chosen)


def read_coordinates(spark: SparkSession, path: str, study_col: str = "id") -> DataFrame:
    """study_id, x, y, z of a TSV (or CSV) with a header, gzipped or not."""
    sep = "," if path.split(".gz")[0].endswith(".csv") else "\t"
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    name = study_col if study_col in raw.columns else next(c for c in ("pmid", "study_id", "id") if c in raw.columns)
    return raw.select(F.col(name).cast("long").alias("study_id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])


def read_metadata(spark: SparkSession, path: str, study_col: str = "pmid") -> DataFrame:
    """A CSV with header; its study column becomes study_id."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path).withColumn("study_id", F.col(study_col).cast("long"))


def write_maps(maps: DataFrame, path: str) -> None:
    """Maps as Parquet, in ranges of studies: a study's rows are together, and files are read by their bounds."""
    maps.repartitionByRange("study_id").sortWithinPartitions("study_id", "voxel_id").write.mode("error").parquet(path)
