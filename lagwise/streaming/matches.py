"""Extension (not a feature of the batch engine): match newly arriving series against a history, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lagwise.config import Config
from lagwise.operators import pairs
from lagwise.operators.prepare import prepare
from lagwise.sources.series import sound


def match_stream(arriving: DataFrame, history: DataFrame, cfg: Config, out: str, checkpoint: str) -> StreamingQuery:
    """Write pairs of a new and an old series above the final threshold to ``out``, micro-batch by micro-batch.

    ``arriving`` is a stream of (event_id, d, error); ``history`` a kept table of prepared series. A batch
    that is run again writes to the folder of its own number, so pairs do not appear twice.
    """

    def match(batch: DataFrame, number: int) -> None:
        new = sound(prepare(batch, cfg)).select("event_id")
        both = sound(prepare(batch, cfg)).unionByName(history.join(new, "event_id", "left_anti"))
        found = pairs.score_pairs(both, cfg, candidate=cfg.candidate, final=cfg.final)
        first = found.join(new, found.e1 == new.event_id, "left_semi")
        second = found.join(new, found.e1 == new.event_id, "left_anti").join(new, F.col("e2") == new.event_id, "left_semi")
        fresh = first.unionByName(second)
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
