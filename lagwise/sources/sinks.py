"""K1-K7: pair files, dominant-frequency files, saved scores, kept spectra, text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_pairs(pairs: DataFrame, path: str) -> None:
    """K1-K3: ``e1 e2 score`` by tabs, overwriting."""
    pairs.select("e1", "e2", "score").write.mode("overwrite").csv(path, sep="\t")


def save_scores(pairs: DataFrame, path: str) -> None:
    """K5: append exact scores at full precision."""
    pairs.select("e1", "e2", "score").write.mode("append").csv(path, sep="\t")


def dominant_lines(dominant: DataFrame) -> DataFrame:
    """K4: one ragged line per series, numbers to three decimals."""
    number = lambda x: F.call_function("format_number", x, F.lit("#.###"))
    parts = F.concat(F.array(F.col("event_id").cast("string")), F.transform("freqs", number), F.array(number(F.col("peak_amp")), number(F.col("sd"))), F.transform("band_means", number))
    return dominant.select(F.array_join(parts, "\t").alias("value"))


def write_dominant(dominant: DataFrame, path: str) -> None:
    dominant_lines(dominant).write.mode("overwrite").text(path)


def write_spectra(spectra: DataFrame, path: str) -> None:
    """K6: the forward and reversed transforms of each series, overwriting."""
    spectra.write.mode("overwrite").parquet(path)
