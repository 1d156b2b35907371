"""Series files, tables as series, candidate and score files, spectra kept as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.config import Config


def samples_of(values: Column, cfg: Config) -> Column:
    """An array of doubles, each cut toward zero within int range (NaN: 0), padded or cut to the length."""
    fit = F.slice(values, 1, cfg.length)
    if cfg.truncate:
        fit = F.transform(fit, lambda x: F.least(F.greatest(F.nanvl(x, F.lit(0.0)), F.lit(-2147483648.0)), F.lit(2147483647.0)).cast("int").cast("double"))
    return F.slice(F.concat(fit, F.array_repeat(F.lit(0.0), cfg.length)), 1, cfg.length)


def series_from_table(df: DataFrame, id_col: str, order: Sequence[str], value: str, cfg: Config) -> DataFrame:
    """Rows as series: ``event_id, d, error``. Samples go in the given order; null samples count as 0, null ids drop out."""
    row = F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    grouped = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("event_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return grouped.select("event_id", samples_of(F.transform("rows", lambda r: r["v"]), cfg).alias("d"), F.lit(None).cast("string").alias("error"))


def series_from_arrays(df: DataFrame, id_col: str, values: str, cfg: Config, scale: float = 1.0) -> DataFrame:
    values_ = F.transform(F.col(values), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)) * F.lit(scale))
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("event_id"), samples_of(values_, cfg).alias("d"), F.lit(None).cast("string").alias("error"))


def read_series(spark: SparkSession, path: str, cfg: Config) -> DataFrame:
    """Every file of a directory as one series, named by the file; one number a line.

    Lines after the expected count are not parsed. A blank or malformed line gives an error row instead of a stop.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("event_id"), F.col("value"))
    lines = F.slice(F.split(F.regexp_replace("value", r"\r?\n\z", ""), "\r?\n"), 1, cfg.length)
    bad = r"^[+-]?(NaN|Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]?)$"
    text = text.withColumn("lines", F.when(F.col("value") == "", F.array().cast("array<string>")).otherwise(F.transform(lines, lambda x: F.trim(x))))
    wrong = F.exists("lines", lambda x: ~x.rlike(bad))
    number = F.transform("lines", lambda x: F.regexp_replace(x, "[dDfF]$", "").try_cast("double"))
    return text.select("event_id", F.when(~wrong, samples_of(number, cfg)).alias("d"), F.when(wrong, F.lit("malformed number")).alias("error"))


def resolve(path: str, cfg: Config) -> str:
    """Relative names are files of the full dataset."""
    return path if os.path.isabs(path) or "://" in path else os.path.join(cfg.dataset, path)


def load(series: DataFrame, cfg: Config) -> DataFrame:
    """The sound rows; raises if some failed, unless errors are to be passed over."""
    if not cfg.continue_on_error and (first := series.where("error IS NOT NULL").select("event_id", "error").first()):
        raise ValueError(f"{first['event_id']}: {first['error']}")
    return sound(series)


def sound(series: DataFrame) -> DataFrame:
    """without the rows that failed."""
    return series.where("error IS NULL")


def failures(series: DataFrame) -> Iterator[str]:
    """A line for each series that failed; they stream to the driver, which holds one partition's at a time."""
    for r in series.where("error IS NOT NULL").select("event_id", "error").toLocalIterator():
        yield f"{r['event_id']}: {r['error']}"


PAIRS = "e1 string, e2 string, score double"


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Rows of exactly three tab-separated fields as distinct pairs; others are dropped, scores ignored."""
    fields = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(F.size(fields) == 3).select(fields[0].alias("e1"), fields[1].alias("e2"))
    return rows.where("e1 <> e2").select(F.least("e1", "e2").alias("e1"), F.greatest("e1", "e2").alias("e2")).dropDuplicates()


def read_scores(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Saved scores; a malformed row is fatal. With ``wanted`` only its pairs."""
    rows = spark.read.csv(path, sep="\t", schema=PAIRS, mode="FAILFAST")
    return rows if wanted is None else rows.join(wanted, ["e1", "e2"], "left_semi")


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """The spectra kept by K6; series without one are absent."""
    return spark.read.parquet(path)


def present(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder that a mode may have left is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
