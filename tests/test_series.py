"""Series engine: hand-computed cases, an independent direct model, properties, files and command line."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagwise.cli import run_files, run_mode
from lagwise.config import Config, ConfigError, next_power_of_two, properties, read_config
from lagwise.functions import render
from lagwise.operators import cluster, pairs, spectral
from lagwise.operators.graph import connected_components
from lagwise.operators.prepare import crossing_peaks
from lagwise.plans import modes, progress
from lagwise.sources import series as src

SERIES = "event_id long, d array<double>, error string"
CFG = Config(length=16, top_k=1, stride=1, candidate=-2.0, final=0.5, truncate=False, centre=True, rate=10, below_hz=1, above_hz=4, band_hz=1, mean_bands="[1-2] (2-4)")


@pytest.mark.parametrize("x,want", [([5, 1, -3, 2, 4, -1], [1, 2, 4]), ([5, -3, 2, -1], [0, 1, 2]), ([-1, 4, 0, 0, 3, -2], [0, 1, 1, 4]), ([7, 7, 7], []), ([5, -3], [0])])
def test_peaks(x, want):
    assert crossing_peaks(np.array(x, float)).tolist() == want


def direct_exact(a, b):
    m = len(a)
    return max(5e-324, max(sum(a[i + lag] * b[i] for i in range(m) if 0 <= i + lag < m) for lag in range(1 - m, m)))


def direct_approx(a, b, pa, pb, support, stride):
    best, m = -1.0, len(a)
    for x, y in zip(pa, pb, strict=True):
        for p in x:
            for q in y:
                o = p - q
                best = max(best, stride * sum(a[i + o] * b[i] for i in support[::stride] if max(0, -o) <= i < (m if o < 0 else m - o)))
    return best


def random_series(spark, n=12, seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.normal(size=16).tolist(), None) for i in range(n)], SERIES)


@pytest.mark.parametrize("stride,k,block", [(1, 2, 256), (2, 1, 256), (1, 2, 3)])
def test_scores_against_direct_sums(spark, stride, k, block):
    cfg = replace(CFG, stride=stride, top_k=k)
    p = modes.prepared(random_series(spark), cfg)
    rows = {r["event_id"]: r for r in p.collect()}
    got = pairs.score_pairs(p, cfg, block=block).collect()
    assert len(got) == 66 and len({(r["e1"], r["e2"]) for r in got}) == 66
    for r in got:
        a, b = rows[r["e1"]], rows[r["e2"]]
        assert r["e1"] < r["e2"]
        assert r["score"] == pytest.approx(direct_exact(a["d"], b["d"]), abs=1e-12)
        assert r["approx"] == pytest.approx(direct_approx(a["d"], b["d"], (a["max_peaks"], a["min_peaks"]), (b["max_peaks"], b["min_peaks"]), b["support"], stride), abs=1e-12)
    both = modes.verified(p, replace(cfg, candidate=-2.0))
    assert sorted((r["e1"], r["e2"]) for r in both.collect()) == sorted((r["e1"], r["e2"]) for r in modes.bruteforce(p, cfg).collect())
    listed = modes.peakmatch(p, cfg)
    assert modes.postprocess(listed, p, cfg).count() == modes.bruteforce(p, cfg).count()


def test_errors_and_unresolved(spark):
    rows = [(1, [1.0, -1.0] * 8, None), (2, [3.0] * 16, None), (3, None, "bad")]
    s = spark.createDataFrame(rows, SERIES)
    p = modes.prepared(s, CFG, strict=False)
    assert [r["event_id"] for r in p.collect()] == [1]
    with pytest.raises(ValueError):
        modes.prepared(s, CFG)
    cand = spark.createDataFrame([(1, 2, 0.5), (1, 9, 0.5)], "e1 long, e2 long, score double")
    assert pairs.score_candidates(cand, p, CFG).count() == 0 and pairs.unresolved(cand, p).count() == 2
    assert pairs.score_pairs(p.where("event_id < 0"), CFG).count() == 0


def test_spectra(spark):
    p = modes.prepared(random_series(spark, 3), CFG)
    d = {r["event_id"]: np.array(r["d"]) for r in p.collect()}
    low, end = spectral.passband(32, CFG)
    for r in spectral.spectrum(p, CFG).collect():
        assert low <= r["k"] < end and r["mag"] == pytest.approx(abs(np.fft.fft(d[r["event_id"]], 32)[r["k"]]))
    for r in modes.dominant_freqs(p, CFG).collect():
        mags = np.abs(np.fft.fft(d[r["event_id"]], 32))[low:end]
        assert r["sd"] == pytest.approx(mags.std(ddof=1)) and r["freqs"][0] == pytest.approx((low + mags.argmax()) * 10 / 32)
    assert spectral.passband(8192, Config()) == (163, 1630) and spectral.passband(128, Config()) == (2, 20)
    assert modes.plots_2d(p, CFG).count() == 3 and modes.plots_1d(p, CFG).count() == 3
    with pytest.raises(ValueError):
        spectral.parse_bands("[1-x]")


def test_knn_and_components(spark):
    v = spark.createDataFrame([(i, [0.0], [x]) for i, x in enumerate((0.0, 1.0, 2.1, 3.3))], "event_id long, bands array<double>, vec array<double>")
    d = cluster.pair_distances(v)
    assert sorted((r["e1"], r["e2"]) for r in cluster.knn_edges(d, 1, 2.0).collect()) == [(0, 1), (1, 2), (2, 3)]
    assert sorted((r["e1"], r["e2"]) for r in cluster.knn_edges(d, 1, 1.15).collect()) == [(0, 1), (1, 2)]
    members = cluster.clusters(v, replace(CFG, cluster_k=1, cluster_eta=1.15))
    assert sorted(map(tuple, members.collect())) == [(0, 0), (1, 0), (2, 0), (3, 3)]
    assert sorted((r["head"], r["event_id"]) for r in cluster.cluster_report(v, members).collect()) == [(0, 1), (0, 2)]
    assert cluster.centre_distances(v, [1], 1.1).count() == 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200), (None, 3)], "src long, dst long")
    got = dict(map(tuple, connected_components(chain).collect()))
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[200] == 200 and len(got) == 64
    assert connected_components(chain.where("src < 0")).count() == 0


def conf(tmp_path, data, **over):
    base = {"mode": "PEAKMATCH", "dataset.full": data, "dataset.sample": data, "expected-file-line-count": 16, "crop.min-peak-range": 0, "crop.max-peak-range": 8, "crop.window-before-peak": 2, "crop.window-after-peak": 4, "top-k-peaks": 1, "sampling-stride": 1, "top-amplitude-threshold": 0.3, "candidate-threshold": 0.1, "final-threshold": 0.2, "threads": 2, "dominantfreq.band-width": 0.25, "dominantfreq.filter-below-hz": 1, "dominantfreq.filter-above-hz": 4, "dominantfreq.sample-rate": 10, "dominantfreq.top-freq-count": 2, "normalise-events": "true", "frequency.band-hz": 1, "plot.2d.bucket-duration-sec": 0.8, "plot.2d.gradient": "SHADED", "cluster.k": 2, "cluster.eta": 2}
    path = tmp_path / "x.conf"
    path.write_text("# settings\n" + "\n".join(f"{k.replace('_', '-')} = {v}" for k, v in (base | over).items()))
    return str(path)


def test_files_modes_and_command_line(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    rng = np.random.default_rng(1)
    for name in "abc":
        (data / name).write_text("\n".join(f"{x:.3f}" for x in rng.normal(size=16) * 50) + "\njunk\n")
    cfg = read_config(conf(tmp_path, data))
    assert cfg.samples == 16 and not cfg.continue_on_error and src.read_series(spark, str(data), cfg).where("error IS NULL").count() == 3
    out = str(tmp_path)
    for mode in ("PEAKMATCH", "POSTPROCESS", "BRUTEFORCE", "FFTPRECACHE", "FFTDOMINANTFREQ", "ANALYSE", "CLUSTER", "PLOT1D", "PLOT2D"):
        lines = run_mode(spark, replace(cfg, mode=mode), out)
        assert isinstance(lines, list)
    assert src.read_spectra(spark, f"{out}/xcorr.fftcache").count() == 3
    assert src.read_scores(spark, f"{out}/xcorr.saved").count() == 3
    assert src.read_candidates(spark, f"{out}/xcorr.candidates").count() <= 3
    assert len(run_files(spark, cfg, ["-xcorr", "-events", "a", "b"])) == 1
    assert len(run_files(spark, cfg, ["-plot", "-events", "a", "b"])) == 2
    assert run_files(spark, cfg, ["-fftdom", "-events", "a"])[0].startswith("a\t")
    assert run_files(spark, cfg, [])[0].startswith("usage")
    (data / "d").write_text("1\n\n2\n")
    assert src.read_series(spark, str(data), cfg).where("error IS NOT NULL").count() == 1
    with pytest.raises(ConfigError):
        read_config(conf(tmp_path, data, mode="NONE"))


def test_formats():
    assert [render.number(x) for x in (1.0, 0.0005, 0.0015, -0.0001, 1234.5678, float("nan"))] == ["1", "0", "0.002", "-0", "1234.568", "NaN"]
    assert render.duration(90_061_000) == "1 days, 1 hr, 1 min, 1 sec"
    assert [next_power_of_two(x) for x in (1, 2, 3, 128, 129)] == [1, 2, 4, 128, 256]
    assert properties("a=1\nb : 2\n! no\n c=\\\n  3")["c"] == "3"


def test_crop_and_truncation(spark):
    cfg = Config(length=6, crop=True, crop_min=1, crop_max=5, crop_before=1, crop_after=2, top_k=1)
    s = spark.createDataFrame([(1, 0, -0.5), (1, 1, 2.9), (1, 2, -9.9), (1, 3, 9.2), (2, 0, 5.0)], "k long, pos int, v double")
    built = src.series_from_table(s, "k", ["pos"], "v", cfg)
    rows = {r["event_id"]: r["d"] for r in built.collect()}
    assert rows[1] == [0.0, 2.0, -9.0, 9.0, 0.0, 0.0] and rows[2] == [5.0, 0, 0, 0, 0, 0]
    from lagwise.operators.prepare import crop

    cut = {r["event_id"]: r for r in crop(built, cfg).collect()}
    assert cut[1]["d"] == [2.0, -9.0, 9.0] and cut[2]["d"] == [5.0, 0.0, 0.0]


def test_every_unresolved_pair_is_reported(spark, tmp_path):
    data, listed = tmp_path / "data", tmp_path / "xcorr.candidates"
    data.mkdir()
    listed.mkdir()
    for k, name in enumerate("ab"):
        (data / name).write_text("\n".join(f"{x:.3f}" for x in np.random.default_rng(k).normal(size=16) * 50) + "\njunk\n")
    (listed / "part").write_text("".join(f"a\tgone{k}\t0.5\n" for k in range(150)))
    lines = run_mode(spark, replace(read_config(conf(tmp_path, data)), mode="POSTPROCESS"), str(tmp_path))
    assert sorted(lines) == sorted(f"unresolved: a gone{k}" for k in range(150))


def test_scores_and_spectra_of_earlier_runs_are_used(spark, tmp_path, capsys):
    data, out = tmp_path / "data", str(tmp_path)
    data.mkdir()
    rng = np.random.default_rng(4)
    write = lambda name: (data / name).write_text("\n".join(f"{x:.3f}" for x in rng.normal(size=16) * 50) + "\n")
    for name in "abcd":
        write(name)
    cfg = replace(read_config(conf(tmp_path, data)), mode="ANALYSE", verbose=True)
    first = run_mode(spark, cfg, out)
    assert src.read_scores(spark, f"{out}/xcorr.saved").count() == 6 and "norm" in capsys.readouterr().err
    again = run_mode(spark, cfg, out)
    assert src.read_scores(spark, f"{out}/xcorr.saved").count() == 6 and first[:7] == again[:7] and "full dataset: 4 series" in again
    write("e")
    run_mode(spark, cfg, out)
    assert src.read_scores(spark, f"{out}/xcorr.saved").dropDuplicates(["e1", "e2"]).count() == 10 == src.read_scores(spark, f"{out}/xcorr.saved").count()

    read = lambda mode: sorted(map(tuple, spark.read.csv(f"{out}/xcorr.{mode}", sep="\t", schema="a string, b string, s double").collect()))
    for mode in ("PEAKMATCH", "POSTPROCESS", "BRUTEFORCE"):
        run_mode(spark, replace(cfg, mode=mode, verbose=False), out)
    plain = read("postprocess"), read("bruteforce")
    run_mode(spark, replace(cfg, mode="FFTPRECACHE", verbose=False), out)
    for mode in ("POSTPROCESS", "BRUTEFORCE"):
        run_mode(spark, replace(cfg, mode=mode, verbose=False), out)
    for a, b in zip(plain, (read("postprocess"), read("bruteforce")), strict=True):
        assert [x[:2] for x in a] == [x[:2] for x in b] and [x[2] for x in a] == pytest.approx([x[2] for x in b])
    # kept transforms are read, not computed again: doubled ones double the scores
    p = modes.prepared(src.read_series(spark, str(data), cfg), cfg)
    kept = src.read_spectra(spark, f"{out}/xcorr.fftcache").where("event_id <> 'e'").withColumns({c: F.transform(c, lambda x: 2 * x) for c in ("fwd_re", "fwd_im")})
    true = {r[:2]: r[2] for r in pairs.score_pairs(p, cfg, approx=False).collect()}
    for got in (pairs.score_pairs(pairs.with_spectra(p, kept, cfg), cfg, approx=False), pairs.score_candidates(spark.createDataFrame(list(true), "e1 string, e2 string"), pairs.with_spectra(p, kept, cfg), cfg)):
        assert {r[:2]: r[2] for r in got.collect()} == {k: pytest.approx((1 if k[0] == "e" else 2) * v) for k, v in true.items()}


def test_failed_series_are_told(spark, tmp_path, capsys):
    data = tmp_path / "data"
    data.mkdir()
    (data / "good").write_text("\n".join(f"{x:.3f}" for x in np.random.default_rng(2).normal(size=16) * 50))
    (data / "bad").write_text("1\nx\n")
    assert len(run_mode(spark, replace(read_config(conf(tmp_path, data)), mode="PLOT1D"), str(tmp_path))) == 1
    assert "bad: malformed number" in capsys.readouterr().err


def test_progress(spark):
    said = []
    with progress.Progress(spark, 0.05, said.append):
        spark.range(0, 400_000_000, 1, 40).selectExpr("bit_xor(xxhash64(id, id + 1))").collect()
    assert any("tasks" in x for x in said)
    assert progress.line(10, 40, 5.0) == "10/40 tasks, 5 sec, 500 ms a task, 15 sec left" and progress.line(0, 4, 0.0) == "0/4 tasks, 0 ms"


def test_approximate_scores_by_gather_and_by_dots():
    rng = np.random.default_rng(9)
    for m, share, stride in ((64, 0.5, 1), (64, 0.0, 1), (3000, 0.4, 1), (3000, 0.4, 5), (700, 0.9, 1)):
        d = rng.normal(size=(5, m))
        peaks = tuple(rng.integers(0, m, (5, 2)) for _ in range(2))
        support = np.flatnonzero(rng.random(m) < share)
        got = pairs.approximate_scores(pairs.padded(d), np.arange(4), peaks, 4, support, stride)
        for r in range(4):
            sums = []
            for own in peaks:
                for a in own[r]:
                    for b in own[4]:
                        sums.append(stride * sum(d[r, k + a - b] * d[4, k] for k in support[::stride] if 0 <= k + a - b < m))
            assert got[r] == pytest.approx(max(-1.0, *sums), abs=1e-9)


def test_blocks_keep_to_memory_and_cores():
    for rows, m, cores in ((10, 64, 8), (1500, 64, 8), (10**6, 4000, 4000), (10**6, 64, 64)):
        p = next_power_of_two(2 * m)
        blocks = pairs.block_count(rows, m, p, cores)
        assert -(-rows // blocks) * 2 * (32 * m + 16 * p) <= pairs.TILE_BYTES + 2 * (32 * m + 16 * p) and blocks >= 1
    assert pairs.block_count(1500, 64, 128, 8) == 8 and pairs.block_count(100, 64, 128, 8, block=10) == 10


def test_plots_as_text():
    cfg = replace(CFG, ramp="SHADED", band_hz=1.0, below_hz=1.0, slice_sec=0.5)
    bar = chr(0x258A)
    lines = render.plot_1d("x", [(1.0, 0.1), (2.0, 1.0), (3.0, 0.5)], cfg).split("\n")
    heights, h = [], 0.0
    while h < 1.0:
        heights.append(h)
        h += 1.0 / 20
    assert lines[0] == "x" and lines[-1] == "" and lines[-2] == "       hz |1        " and len(lines) == len(heights) + 3 == 23
    assert lines[1] == f"{'0.95 ':>10} {bar} " and lines[-3] == f"{'0 ':>10}{bar * 3}" and lines[-5] == f"{'0.1 ':>10}{bar * 3 if 0.05 + 0.05 <= 0.1 else ' ' + bar * 2}"
    few = render.plot_1d("y", [(1.0, 0.7)], cfg).split("\n")
    assert len(few) - 3 in (20, 21) and {len(render.plot_1d("z", [(1.0, v / 997)], cfg).split("\n")) - 3 for v in range(1, 200)} == {20, 21}
    grid = render.plot_2d("q", [[(1.0, 0.0), (2.0, 0.3)], [(1.0, 0.07), (2.0, float("nan"))], [(1.0, 0.13), (2.0, 0.25)]], cfg)
    assert grid == "q\n     2 hz █ █\n     1 hz  ░▒\n      sec |0        \n\n"
    assert render.plot_2d("e", [], cfg) == "e\n      sec \n\n"


def test_report_of_a_cluster_beyond_the_limit(spark):
    n = 2 * (cluster.LISTED + 1) + 5
    v = spark.createDataFrame([(i, [0.0], [float(i)]) for i in range(n)], "event_id long, bands array<double>, vec array<double>")
    members = spark.createDataFrame([(i, 0) for i in range(n)], "event_id long, cluster_id long")
    got = [tuple(r) for r in cluster.cluster_report(v, members).collect()]
    heads = {h for h, _, _ in got}
    assert heads == {0, cluster.LISTED + 1, 2 * (cluster.LISTED + 1)} and len(got) == n - 3 and all(d == e - h for h, e, d in got)


def copies(n, distinct, m=16, seed=5):
    """A tile of one block: ``n`` series that are copies of ``distinct``."""
    base = np.random.default_rng(seed).normal(size=(distinct, m))
    return base, pa.table({"event_id": pa.array(range(n), pa.int64()), "d": list(base[np.arange(n) % distinct]), "_block": pa.array([0] * n, pa.int32()), "_low": pa.array([0] * n, pa.int32()), "_high": pa.array([0] * n, pa.int32())})


def test_equal_series_are_scored_once():
    base, table = copies(210, 7)
    first, own = pairs.classes(np.array(table["d"].to_pylist()))
    assert first.tolist() == list(range(7)) and own.tolist() == [k % 7 for k in range(210)]
    asked = []

    def score(i, j):
        asked.extend((int(x), j) for x in i)
        return i, [(10 * i + j).astype(float)]

    got = [(int(i), int(j), float(v)) for rows, js, (values,) in pairs.walk(table, own, score) for j in js for i, v in zip(rows, values, strict=True) if i < j]
    assert len(asked) == len(set(asked)) == 49
    assert sorted(got) == [(i, j, 10.0 * (i % 7) + j % 7) for i in range(210) for j in range(i + 1, 210)]


def test_scores_of_copies_against_direct_sums(spark):
    rng = np.random.default_rng(8)
    base = [rng.normal(size=16).tolist() for _ in range(3)]
    rows = [(i, base[0] if i < 30 else base[i % 3], None) for i in range(45)]  # one content is more than a block
    p = modes.prepared(spark.createDataFrame(rows, SERIES), replace(CFG, top_k=2))
    of = {r["event_id"]: r for r in p.collect()}
    for block in (None, 7):
        got = {(r["e1"], r["e2"]): (r["approx"], r["score"]) for r in pairs.score_pairs(p, replace(CFG, top_k=2), block=block).collect()}
        assert sorted(got) == [(i, j) for i in range(45) for j in range(i + 1, 45)]
        for (i, j), (approx, score) in got.items():
            a, b = of[i], of[j]
            assert score == pytest.approx(direct_exact(a["d"], b["d"]), abs=1e-12)
            assert approx == pytest.approx(direct_approx(a["d"], b["d"], (a["max_peaks"], a["min_peaks"]), (b["max_peaks"], b["min_peaks"]), b["support"], 1), abs=1e-12)


def test_blocks_are_of_like_sizes_whatever_the_copies():
    for counts, blocks in (({k: 1 for k in range(1024)}, 8), ({5: 9000, 6: 10, 900: 10}, 9), ({}, 1), ({1: 3}, 4)):
        first, pieces = pairs.deal(counts, blocks)
        held = {}
        for k, n in counts.items():
            for part in range(pieces[k]):
                held[first[k] + part] = held.get(first[k] + part, 0) + n / pieces[k]
        most = max(1, -(-sum(counts.values()) // blocks))
        assert len(first) == len(pieces) == 1024 and max(held.values(), default=0) <= most + most // 8 and len(held) <= 2 * blocks + 1


def test_a_tile_gives_its_pairs_in_batches():
    _, table = copies(700, 5)
    own = np.arange(700) % 5
    for names, values in ((["e1", "e2", "score"], 1), (["e1", "e2"], 0)):
        got = list(pairs.listed(table, names, pairs.walk(table, own, lambda i, j, n=values: (i, [i * 1.0] * n))))
        assert len(got) > 1 and all(0 < b.num_rows < 2 * pairs._BATCH for b in got) and got[0].schema.names == names
        assert sorted(zip(*(pa.Table.from_batches(got)[c].to_pylist() for c in ("e1", "e2")), strict=True)) == [(i, j) for i in range(700) for j in range(i + 1, 700)]


def test_rounding_is_that_of_sql():
    x = np.array([0.1234565, -0.1234565, 0.12345649, -1e-9, 0.0, 5e-324, 1.0, -0.9999996])
    assert pairs.rounded(x, 6).tolist() == [0.123457, -0.123457, 0.123456, 0.0, 0.0, 0.0, 1.0, -1.0] and not np.signbit(pairs.rounded(x, 6)[3])
    assert pairs.rounded(x, None) is x


def test_report_without_a_table_of_pairs(spark, monkeypatch):
    cfg = replace(CFG, top_k=2, candidate=0.3, final=0.4)
    own = random_series(spark, 20)
    p = modes.prepared(own.unionByName(own.withColumn("event_id", F.col("event_id") + 100)), cfg)
    scores = [(r["e1"], r["e2"], r["approx"], r["score"]) for r in pairs.score_pairs(p, cfg).collect()]
    saved = spark.createDataFrame([(a, b, s) for a, b, _, s in scores[::2]], "e1 long, e2 long, score double")
    other = modes.analyse(p, cfg, saved)
    monkeypatch.setattr(modes, "materialize", lambda *_: pytest.fail("a table of pairs"))
    found = modes.analyse(p, cfg)
    positive, negative = ({(a, b) for a, b, x, s in scores if (x > 0.3) == which and (s >= 0.4) != which} for which in (True, False))
    assert positive and negative
    for out in (found, other):
        r = out["report"].first().asDict()
        assert (r["events"], r["pairs"], r["matches"], r["candidates"]) == (40, 800, sum(s >= 0.4 for *_, s in scores), sum(x > 0.3 for *_, x, _ in scores))
        assert (r["false_positives"], r["false_negatives"]) == (len(positive), len(negative)) and r["fp_percent"] == 100 * len(positive) // r["matches"]
        assert {(x["e1"], x["e2"]) for x in out["false_positives"].collect()} == positive and {(x["e1"], x["e2"]) for x in out["false_negatives"].collect()} == negative
    assert modes.analyse(p.where("event_id < 0"), cfg)["report"].first().asDict() == dict.fromkeys(("events", "matches", "candidates", "false_positives", "false_negatives", "pairs"), 0) | {"fp_percent": None, "fn_percent": None}


@pytest.mark.parametrize("metric", ["euclid", "cosine"])
def test_distances_in_tiles_against_direct_sums(spark, metric):
    rng = np.random.default_rng(6)
    base = [rng.random(3).tolist() for _ in range(4)] + [[0.5, None, 0.5], None]
    vec = {k: base[k % 6] for k in range(30)}
    v = spark.createDataFrame([(k, x) for k, x in vec.items()], "event_id long, vec array<double>")

    def direct(a, b):
        if a is None or b is None or None in a or None in b:
            return None
        return float(np.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))) if metric == "euclid" else 1 - sum(x * y for x, y in zip(a, b, strict=True))

    want = {(i, j): direct(vec[i], vec[j]) for i in range(30) for j in range(i + 1, 30)}
    got = cluster.pair_distances(v, metric)
    assert {(r["e1"], r["e2"]): r["distance"] for r in got.collect()} == {k: None if x is None else pytest.approx(x, abs=1e-12) for k, x in want.items()}
    near = {(r["e1"], r["e2"]): r["distance"] for r in cluster.pair_distances(v, metric, 0.4, 2).collect()}
    assert near == {k: pytest.approx(round(x, 2), abs=1e-12) for k, x in want.items() if x is not None and x < 0.4}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    assert cluster.pair_distances(v.where("event_id < 0"), metric).count() == 0


def test_edges_and_clusters_of_copies(spark):
    """Copies are at distance 0 whatever their rows' order was, so ties go by id; each content is a cluster."""
    cfg = replace(CFG, below_hz=1.0, above_hz=5.0, band_hz=0.5, cluster_k=2, cluster_eta=1e-9)
    base = [r["d"] for r in random_series(spark, 4, 12).collect()]
    s = spark.createDataFrame([(i, base[i % 4], None) for i in range(60)], SERIES).repartition(7)
    v = cluster.features(modes.prepared(s, cfg), cfg)
    vectors = {r["event_id"]: tuple(r["vec"]) for r in v.collect()}
    assert len(vectors) == 60 and len(set(vectors.values())) == 4
    edges = {(r["e1"], r["e2"], r["distance"]) for r in cluster.knn_edges(cluster.pair_distances(v, limit=cfg.cluster_eta), 2, cfg.cluster_eta).collect()}
    want = set()
    for x in range(60):
        own = sorted((min(x, y), max(x, y)) for y in range(x % 4, 60, 4) if y != x)
        want |= {(a, b, 0.0) for a, b in own[:2]}
    assert edges == want
    assert {tuple(r) for r in cluster.clusters(v, cfg).collect()} == {(x, x % 4) for x in range(60)}


def test_listed_pairs_go_to_tiles(spark, monkeypatch):
    monkeypatch.setattr(pairs, "_LISTED", 64)
    own = random_series(spark, 10)
    p = modes.prepared(own.unionByName(own.withColumn("event_id", F.col("event_id") + 100)), CFG)
    true = {(r["e1"], r["e2"]): r["score"] for r in pairs.score_pairs(p, CFG, approx=False).collect()}
    chosen = sorted(true)[::2]
    rows = [*chosen, *chosen[:9], (chosen[1][1], chosen[1][0]), (3, 3), (0, 999), (None, 4)]
    listed = spark.createDataFrame(rows, "e1 long, e2 long")
    scored = pairs.score_candidates(listed, p, CFG)
    got = {(r["e1"], r["e2"]): r["score"] for r in scored.collect()}
    assert scored.count() == len(got) == len(chosen) + 2  # repeats once, absent and null ids not at all
    assert {k: got[k] for k in chosen} == {k: pytest.approx(true[k], abs=1e-12) for k in chosen}
    assert got[3, 3] == pytest.approx(1.0) and got[chosen[1][::-1]] == pytest.approx(true[chosen[1]], abs=1e-12)
    assert {(r["e1"], r["e2"]): r["score"] for r in pairs.score_candidates(listed, p, CFG, 0.5, 3).collect()} == {k: pytest.approx(round(x, 3), abs=1e-12) for k, x in got.items() if x > 0.5}
    assert "FlatMapCoGroupsInArrow" in scored._jdf.queryExecution().optimizedPlan().toString()  # series meet pairs by tile
    monkeypatch.setattr(pairs, "FEW", 0)
    assert {(r["e1"], r["e2"]): r["score"] for r in pairs.score_candidates(listed, p, CFG).collect()} == got
    assert [x.tolist() for x in pairs.distinct(np.array([5, 2, 5]), 6)] == [[2, 5], [1, 0, 1]] == [x.tolist() for x in pairs.distinct(np.array([5, 2, 5]), 1 << 60)]
    assert pairs.score_candidates(listed, p.where("event_id < 0"), CFG).count() == 0 == pairs.score_candidates(listed.where("e1 < 0"), p, CFG).count()


def test_whole_report_of_a_cluster_beyond_the_limit(spark):
    n = cluster.LISTED + 5
    v = spark.createDataFrame([(i, [0.0], [float(i)]) for i in range(n + 1)], "event_id long, bands array<double>, vec array<double>")
    members = spark.createDataFrame([(i, 0) for i in range(n)] + [(n, n)], "event_id long, cluster_id long")
    assert sorted(map(tuple, cluster.cluster_report(v, members, listed=None).collect())) == [(0, i, float(i)) for i in range(1, n)]


def tile_of(n, cfg, seed=4):
    """Both blocks of a tile of random series, prepared."""
    rng, rows = np.random.default_rng(seed), []
    for x in rng.exponential(size=(n, cfg.samples)) + 0.2 * rng.normal(size=cfg.samples):
        u = x - x.mean()
        u /= np.sqrt((u * u).sum())
        pos = crossing_peaks(u)
        order = pos[np.argsort(-u[pos], kind="stable")].astype(np.int32)
        top, low = order[: cfg.top_k], order[::-1][: cfg.top_k]
        rows.append((u, top, low, np.flatnonzero((u > u[top[0]] * 0.3) | (u < u[low[0]] * 0.3)).astype(np.int32)))
    floats, ints = pa.list_(pa.float64()), pa.list_(pa.int32())
    cols = {k: pa.array(x, t) for k, x, t in zip(("d", "max_peaks", "min_peaks", "support"), zip(*rows, strict=True), (floats, ints, ints, ints), strict=True)}
    return pa.table({"event_id": pa.array(range(n)), **cols, "_block": pa.array(np.arange(n) % 2), "_low": pa.array(np.zeros(n, int)), "_high": pa.array(np.ones(n, int))})


def pairs_of(found):
    return {(int(i), int(j)): tuple(float(x[k]) for x in values) for rows, js, values in found for j in js for k, i in enumerate(rows) if i < j}


@pytest.mark.parametrize("stride,k", [(1, 2), (2, 3)])
def test_short_series_are_scored_by_products_of_matrices(monkeypatch, stride, k):
    cfg = replace(CFG, length=24, stride=stride, top_k=k, candidate=0.3, final=0.4)
    table = tile_of(150, cfg)
    monkeypatch.setattr(pairs, "NARROW", 0)
    true = pairs_of(pairs._tile(table, cfg, True, True, [], None, None))
    monkeypatch.setattr(pairs, "NARROW", 96)
    for name in ("exact_scores", "approximate_scores"):
        monkeypatch.setattr(pairs, name, lambda *_: pytest.fail("pair by pair"))
    monkeypatch.setattr(pairs, "_AHEAD", 16)
    monkeypatch.setattr(pairs, "_WIDE", 40)
    near = lambda want: {x: pytest.approx(v, abs=1e-12) for x, v in want.items()}
    assert len(true) == 75 * 75 and pairs_of(pairs._tile(table, cfg, True, True, [], None, None)) == near(true)
    assert pairs_of(pairs._tile(table, cfg, False, True, [], None, None)) == near({x: (s,) for x, (_, s) in true.items()})
    found = {x: (a, s) for x, (a, s) in true.items() if a > 0.3 and s > 0.4}
    assert found and pairs_of(pairs._tile(table, cfg, True, True, [], 0.3, 0.4)) == near(found)
    lost = {x: (a, s) for x, (a, s) in true.items() if not a > 0.3 and s >= 0.4}
    assert lost and pairs_of(pairs._tile(table, cfg, True, True, [], 0.3, None, lambda a, s: s >= 0.4, reject=True)) == near(lost)


def test_scores_at_a_threshold_are_told_apart_when_counted():
    table = tile_of(60, cfg := replace(CFG, length=24, top_k=2))
    true = pairs_of(pairs._tile(table, cfg, True, True, [], None, None))
    for a, s in [true[k] for k in sorted(true)[::97]]:  # closer to a score than single precision tells
        at = replace(cfg, candidate=a - 1e-13, final=s + 1e-13)
        counted = pairs_of(pairs._tile(table, at, True, True, [], None, None, counted=True))
        assert {k for k, v in counted.items() if v[0] > at.candidate} == {k for k, v in true.items() if v[0] > at.candidate}
        assert {k for k, v in counted.items() if v[1] >= at.final} == {k for k, v in true.items() if v[1] >= at.final}
        assert max(abs(x - y) for k in true for x, y in zip(true[k], counted[k], strict=True)) < 1e-5


@pytest.mark.parametrize("name", ["false_negatives", "false_positives"])
def test_false_ones_pass_the_filter_before_their_exact_score(spark, monkeypatch, name):
    asked = []
    monkeypatch.setattr(modes.pairs, "score_pairs", lambda *_, **k: asked.append(k))
    modes.analyse(modes.prepared(random_series(spark), CFG), CFG)[name]
    own = [k for k in asked if k.get("candidate") == CFG.candidate and k.get("reject", False) == (name == "false_negatives")]
    assert len(own) == 1 and own[0]["keep"](np.array([1.0]), np.array([0.1])).tolist() == [name == "false_positives"]


def test_candidates_of_the_same_run_need_no_list(spark, monkeypatch):
    from lagwise.plans import queries

    own = random_series(spark, 20)
    p = modes.prepared(own.unionByName(own.withColumn("event_id", F.col("event_id") + 100)), replace(queries.CFG, length=16))
    monkeypatch.setattr(queries, "CFG", cfg := replace(queries.CFG, length=16))
    true = {(r["e1"], r["e2"]): r["score"] for r in modes.postprocess(modes.peakmatch(p, cfg).select("e1", "e2"), p, cfg, 6).collect()}
    monkeypatch.setattr(queries, "_prepared", lambda *_: p)
    monkeypatch.setattr(queries, "materialize", lambda *_: pytest.fail("a table of candidates"))
    found = queries.postprocess_matches(spark, "")
    assert true and found.columns == ["e1", "e2", "score"]
    assert {(r["e1"], r["e2"]): r["score"] for r in found.collect()} == {k: pytest.approx(v, abs=1.1e-6) for k, v in true.items()}
