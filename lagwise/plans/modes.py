"""M1-M9: the batch modes, each a composition of operators, and A5-A7."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.config import Config
from lagwise.functions import render
from lagwise.operators import cluster, pairs, prepare, spectral
from lagwise.plans.scratch import materialize
from lagwise.sources.series import load, sound


def prepared(series: DataFrame, cfg: Config, strict: bool = True) -> DataFrame:
    """Prepare and keep: the pair modes use the result several times. ``strict`` raises on errors unless they may be passed over."""
    kept = materialize(prepare.prepare(series, cfg), "prepared")
    return load(kept, cfg) if strict else sound(kept)


def peakmatch(events: DataFrame, cfg: Config) -> DataFrame:
    """M2: candidates ``e1, e2, score`` by the approximate score."""
    return pairs.score_pairs(events, cfg, exact=False, candidate=cfg.candidate).withColumnRenamed("approx", "score")


def split_pairs(events: DataFrame, cfg: Config) -> DataFrame:
    """All pairs with ``accepted``."""
    scored = pairs.score_pairs(events, cfg, exact=False).withColumnRenamed("approx", "score")
    return scored.withColumn("accepted", (F.col("score") > cfg.candidate) & ~F.isnan("score"))


def postprocess(candidates: DataFrame | None, events: DataFrame, cfg: Config, digits: int | None = None) -> DataFrame:
    """M4: exact scores above the final threshold of listed candidates; None: of those that ``peakmatch`` gives, which need no list but go on within their tile."""
    if candidates is None:
        return verified(events, cfg, digits).drop("approx")
    return pairs.score_candidates(candidates, events, cfg, cfg.final, digits)


def verified(events: DataFrame, cfg: Config, digits: int | None = None) -> DataFrame:
    """M2 and M4 in one pass over tiles: filter by the approximate score, refine by the exact one, without a table of candidates."""
    return pairs.score_pairs(events, cfg, candidate=cfg.candidate, final=cfg.final, digits=digits)


def bruteforce(events: DataFrame, cfg: Config) -> DataFrame:
    """M5."""
    return pairs.score_pairs(events, cfg, approx=False, final=cfg.final)


def precache(events: DataFrame, cfg: Config) -> DataFrame:
    """M3."""
    return pairs.fft_records(events, cfg)


def sample_scores(approx: DataFrame, events: DataFrame, cfg: Config, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``e1, e2, approx, score`` of all pairs, those of them that had to be computed: J8).

    ``approx`` has all pairs with their approximate scores; ``saved`` exact scores of earlier runs, of
    which pairs not in ``approx`` are ignored (F9) and of a pair saved twice the largest counts.
    """
    kept = approx.join(saved.groupBy("e1", "e2").agg(F.max("score").alias("score")), ["e1", "e2"], "left")
    missing = kept.where("score IS NULL").select("e1", "e2")
    fresh = materialize(pairs.score_candidates(missing, events, cfg), "fresh")
    had = kept.where("score IS NOT NULL").select("e1", "e2", "approx", "score")
    return had.unionByName(approx.join(fresh, ["e1", "e2"]).select("e1", "e2", "approx", "score")), fresh


def analyse(events: DataFrame, cfg: Config, saved: DataFrame | None = None, digits: int | None = None) -> dict[str, DataFrame]:
    """M1: false positives and negatives of the approximate filter, the report (J7, J9, A5, A6, F4) and the scores computed anew.

    Without ``saved`` both scores are computed in one pass over tiles for each frame that is read: false ones are told
    apart in the tiles and the report's pairs are counted there, so no table of all pairs is written or joined. Scores
    of false ones are rounded to ``digits``, if given.
    """
    candidate, final = cfg.candidate, cfg.final
    rules = {
        "matches": lambda approx, score: score >= final,
        "candidates": lambda approx, score: approx > candidate,
        "false_positives": lambda approx, score: (approx > candidate) & ~(score >= final),
        "false_negatives": lambda approx, score: (score >= final) & ~(approx > candidate),
    }
    if saved is None:
        false = {k: pairs.score_pairs(events, cfg, candidate=candidate, reject=k == "false_negatives", keep=rules[k], digits=digits) for k in ("false_positives", "false_negatives")}
        fresh, count = pairs.score_pairs(events, cfg, approx=False), pairs.count_pairs(events, cfg, **rules)
    else:
        approx = materialize(pairs.score_pairs(events, cfg, exact=False), "approx")
        scored, fresh = sample_scores(approx, events, cfg, saved)
        both = materialize(scored, "both")
        true, found = F.col("score") >= final, F.col("approx") > candidate
        held = {"matches": true, "candidates": found, "false_positives": found & ~true, "false_negatives": true & ~found}
        shown = {} if digits is None else {c: F.round(c, digits) for c in ("approx", "score")}
        false = {k: both.where(held[k]).withColumns(shown) for k in ("false_positives", "false_negatives")}
        count = both.agg(*[F.count_if(c).alias(k) for k, c in held.items()])
    n = events.agg(F.count("*").alias("events"))
    rate = lambda c: F.when(F.col("matches") > 0, F.expr(f"100 * {c} DIV matches"))
    report = n.crossJoin(count).withColumn("pairs", F.expr("events * events DIV 2")).withColumn("fp_percent", rate("false_positives")).withColumn("fn_percent", rate("false_negatives"))
    return false | {"report": report, "fresh": fresh}


def throughput(events: DataFrame, cfg: Config, total: int, candidates: int) -> dict[str, float | None]:
    """Seconds a pair of both passes over a sample, carried on to ``total`` series; None where nothing was scored.

    ``candidates`` of the sample's pairs pass the filter; at that share of all pairs, filter and refinement
    together take ``filtered``, and the exact score of every pair ``brute force``.
    """
    n, each = events.count(), {}
    count, all_pairs = n * (n - 1) // 2, total * (total - 1) // 2
    for name, run in (("approximate", lambda: pairs.score_pairs(events, cfg, exact=False)), ("exact", lambda: pairs.score_pairs(events, cfg, approx=False))):
        begun = time.time()
        run().write.format("noop").mode("overwrite").save()
        each[name] = (time.time() - begun) / count if count else None
    if not count:
        return dict.fromkeys(("approximate a pair", "exact a pair", "approximate", "candidates", "refinement", "filtered", "brute force", "gain"))
    expected = all_pairs * candidates / count
    first, second, brute = each["approximate"] * all_pairs, each["exact"] * expected, each["exact"] * all_pairs
    gain = brute / (first + second) if first + second else None
    return {"approximate a pair": each["approximate"], "exact a pair": each["exact"], "approximate": first, "candidates": expected, "refinement": second, "filtered": first + second, "brute force": brute, "gain": gain}


def dominant_freqs(events: DataFrame, cfg: Config) -> DataFrame:
    """M6."""
    return spectral.dominant(events, cfg)


def plots_1d(events: DataFrame, cfg: Config, digits: int | None = None) -> DataFrame:
    """M8: ``event_id, plot``; of means rounded to ``digits``, if given, so that heights do not hang on a last bit."""
    means = spectral.band_means(spectral.spectrum(events, cfg), cfg)
    if digits is not None:
        means = means.withColumn("mean", F.round("mean", digits))
    rows = means.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("band", "mean"))).alias("b"))
    if cfg.tiny:
        return render.tiny_plots(rows.select("event_id", F.transform("b", lambda x: x["mean"]).alias("means")))
    draw = F.udf(lambda name, b: render.plot_1d(str(name), [(x["band"], x["mean"]) for x in b], cfg), "string")
    return rows.select("event_id", draw("event_id", "b").alias("plot"))


def plots_2d(events: DataFrame, cfg: Config) -> DataFrame:
    """M7: ``event_id, plot``."""
    rows = spectral.sliced_bands(events, cfg).groupBy("event_id", "slice").agg(F.array_sort(F.collect_list(F.struct("band", "mean"))).alias("b"))
    rows = rows.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("slice", "b"))).alias("s"))
    draw = F.udf(lambda name, s: render.plot_2d(str(name), [[(x["band"], x["mean"]) for x in one["b"]] for one in s], cfg), "string")
    return rows.select("event_id", draw("event_id", "s").alias("plot"))


def clustering(events: DataFrame, cfg: Config) -> DataFrame:
    """M9: around the configured centres if any of them is found, else by the nearest-neighbour graph: ``head, event_id, distance``."""
    vectors = materialize(cluster.features(events, cfg), "vectors")
    names = [c for c in cfg.centres.split(",") if c]
    centres = [r["event_id"] for r in vectors.where(F.col("event_id").cast("string").isin(names)).select("event_id").collect()] if names else []
    if centres:
        return cluster.centre_distances(vectors, centres, cfg.centre_threshold).withColumnRenamed("centre", "head").orderBy("head", "distance", "event_id")
    return cluster.cluster_report(vectors, cluster.clusters(vectors, cfg)).orderBy("head", "event_id")
