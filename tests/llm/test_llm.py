"""Operators of the llm subpackage against brute force, round trips and held-out cases, with awkward rows."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lagwise.llm import bpe, chat, exact_dedup, langid, ngram_join, ogg, packing, span_dedup, toxicity, warc

LONG = "long words go on " * 3000
AWKWARD = [(1, None), (2, ""), (3, "Some text here for all."), (4, "some TEXT here for all."), (4, "some TEXT here for all."), (None, "no id"), (None, "no id"), (5, LONG), (6, "ÄÖ ß x"), (7, " \n\t ")]


def table(spark, rows):
    """With extra columns, some of clashing names."""
    return spark.createDataFrame([(i, t, None, "x", 1, True) for i, t in rows], "doc_id long, text string, lang string, id string, n int, again boolean")


@pytest.fixture(scope="module")
def corpus():
    rnd, vocab = random.Random(5), [f"w{k}" for k in range(300)]
    rows = []
    for i in range(120):
        if i % 3 and rows:
            words = rnd.choice(rows)[1].split()
            for _ in range(rnd.choice((0, 1, 2, 4))):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
        else:
            words = [rnd.choice(vocab) for _ in range(rnd.choice((1, 2, 5, 30, 80)))]
        rows.append((i, " ".join(words)))
    return rows


def components(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) * den >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width,threshold,num,den", [(3, "0.9", 9, 10), (5, "0.8", 8, 10), (1, "0.5", 5, 10)])
def test_jaccard_join(spark, corpus, width, threshold, num, den):
    want = components(corpus, width, num, den)
    got = ngram_join.ngram_jaccard(table(spark, corpus), width=width, threshold=threshold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    kept = ngram_join.drop_near_copies(table(spark, corpus), width=width, threshold=threshold)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_jaccard_in_small_windows_and_blocks(spark, corpus, monkeypatch):
    want = components(corpus, 1, 5, 10)
    for name, value in (("WINDOW", 50), ("BLOCK_SHINGLES", 60)):
        monkeypatch.setattr(ngram_join, name, value)
    got = ngram_join.ngram_jaccard(table(spark, corpus), width=1, threshold="0.5").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_family_of_near_but_unlinked_texts(spark):
    """Copies of one template that share too little for a link, beside copies that do link; the template itself is absent."""
    rnd, template, rows = random.Random(8), [f"w{k}" for k in range(150)], []
    for i in range(260):
        words = list(template)
        for _ in range(rnd.choice((1, 2, 6, 7, 8, 9))):
            words[rnd.randrange(150)] = rnd.choice(("and", f"x{rnd.randrange(40)}", f"y{rnd.randrange(10**6)}"))
        rows.append((i, " ".join(words)))
    want = components(rows, 5, 8, 10)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard(table(spark, rows)).collect()}
    assert got == want and len({c for _, c in want.values()}) > 20


def test_part_signatures_of_linked_sets():
    """Linked sets share at least as many signatures of a common scheme as each of them counts on."""
    rnd = np.random.default_rng(3)
    for t in (Fraction("0.8"), Fraction("0.9"), Fraction("0.5")):
        bands, tried = ngram_join.Bands(t), 0
        for _ in range(400):
            n = int(rnd.choice((3, 8, 20, 60, 300, 2000)))
            a = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
            out, new = rnd.integers(0, 1 + n // 6), rnd.integers(0, 1 + n // 6)
            b = np.unique(np.concatenate([rnd.permutation(a)[out:], rnd.integers(0, 2**63, new, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not len(b) or both < t * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            tried += 1
            sa, sb = ngram_join.part_signatures(a, bands), ngram_join.part_signatures(b, bands)
            common = np.intersect1d(sa, sb)
            ta, tb = ngram_join.least_shared(a, bands), ngram_join.least_shared(b, bands)
            low = min(bands.of(len(a)), bands.of(len(b))) % 2
            assert np.count_nonzero(common % 2 == low) >= max(ta[low], tb[low])
        assert tried > 30


def test_jaccard_awkward(spark):
    got = ngram_join.ngram_jaccard(table(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 3, None: None, 5: 5, 6: 6, 7: 7}
    assert ngram_join.ngram_jaccard(table(spark, [])).count() == 0


def test_wide_sketches(spark):
    rnd = random.Random(3)
    texts = {0: " ".join(f"w{k}" for k in range(1000)), 1: "", 2: "one"}
    for k in range(3, 60):
        words = texts[0].split()[: rnd.choice((200, 700, 850, 1000))]
        for _ in range(rnd.choice((0, 5, 20, 60, 300))):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        texts[k] = " ".join(words)
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in texts.items() if (w := t.split()) or not k}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    wide = {r["id"]: (r["n"], bytes(r["wide"])) for r in ngram_join.wide_sketches(rows, 5).collect()}
    assert wide[1][0] == 0 and all(wide[k][0] == len(s) for k, s in sets.items())
    assert all(ngram_join.sketch_difference(wide[a][1], wide[b][1]) <= len(sets[a] ^ sets[b]) for a in sets for b in sets)
    pairs = spark.createDataFrame([(0, k) for k in sets if k], "hub long, id long")
    near = {r["id"] for r in ngram_join.told_apart(pairs, rows, 5, Fraction("0.8")).collect()}
    like = {k: len(s & sets[0]) / len(s | sets[0]) for k, s in sets.items() if k}
    assert {k for k, x in like.items() if x >= 0.8} <= near and not any(like[k] < 0.6 for k in near)


def test_t_occurrence():
    rnd = random.Random(2)
    sets = [set(rnd.sample(range(40), 25)) for _ in range(60)]
    query = np.array(sorted(rnd.sample(range(40), 25)))
    lists = {}
    for k, s in enumerate(sets):
        for t in s:
            lists.setdefault(t, []).append(k)
    need = dict.fromkeys(range(60), 17)
    want = {k: len(s & set(query.tolist())) for k, s in enumerate(sets) if len(s & set(query.tolist())) >= 17}
    assert ngram_join.t_occurrence(query, lists, need) == want


def test_exact_dedup(spark):
    rows = exact_dedup.exact_verdicts(table(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert by[3]["keep_id"] == 4 and by[3]["group_size"] == 3 and not by[3]["kept"] and by[4]["kept"] and by[1]["keep_id"] == 2
    assert by[6]["text_sha256"] == hashlib.sha256("ÄÖ ß x".encode()).hexdigest()
    kept = exact_dedup.drop_exact_copies(table(spark, AWKWARD))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 4, 5, 6, 7] and kept.columns == table(spark, []).columns
    assert exact_dedup.exact_verdicts(table(spark, [])).count() == 0


@pytest.mark.parametrize("hashes,bits", [(1, 1 << 30), (2, 1 << 30), (1, 1 << 15), (2, 1 << 15)])
def test_exact_dedup_in_slices(spark, monkeypatch, hashes, bits):
    monkeypatch.setattr(exact_dedup, "HASHES", hashes)
    monkeypatch.setattr(exact_dedup, "MAX_BITS", bits)
    rnd = random.Random(7)
    rows = [(i, rnd.choice(("Same", f"t{rnd.randrange(3000)}", f"only {i}"))) for i in range(6000)]
    assert exact_dedup.filter_size(6000)[0] == (1 if bits == 1 << 30 else 3)
    groups = {}
    for i, t in rows:
        groups.setdefault(t.lower(), []).append(i)
    got = exact_dedup.exact_verdicts(table(spark, rows)).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(i, max(g), len(g), i == max(g)) for g in groups.values() for i in g} and len(got) == 6000
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_copies(table(spark, rows)).collect()) == sorted(map(max, groups.values()))


def test_plan_and_pack(spark):
    counts = {5: 7, 3: 10, 2: 4, 10: 2}
    runs, made = packing.plan(counts, 10)
    room = {}
    for length, own in runs.items():
        for (rank, seq, step, offset), end in zip(own, [r[0] for r in own[1:]] + [counts[length]], strict=True):
            for k in range(end - rank):
                room.setdefault(seq + k // step, []).append((offset + k % step * length, length))
    assert sum(map(len, room.values())) == 23 and len(room) == made == 10
    for slots in room.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(slots)) and sum(slots[-1]) <= 10
    got = packing.pack(table(spark, AWKWARD)).collect()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {i: t or "" for i, t in AWKWARD}
    for r in got:
        ids = np.array([*tokens.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for a, b in pairwise(places):
        assert (a[0] == b[0] and a[1] + a[2] == b[1]) or (a[0] < b[0] and b[1] == 0)
    assert sum(r["length"] for r in got if r["doc_id"] == 5) == len(tokens.encode(LONG).ids) + 1
    assert packing.pack(table(spark, [])).count() == 0


def test_pack_ids_are_the_tokenizers(spark):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    own, other, rnd = packing.encoder(*paths), Tokenizer.from_file(paths[0]), random.Random(9)
    assert own.ids("a <|endoftext|> b") == [64, 220, 50256, 275]
    parts = ("<|endoftext|>", "<|endoftext", "|>", " ", "word", "é🎉日", "\n\n ", "\u00a0\u2028", "'ll", "x" * 40, "12½")
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(12)))
        assert own.ids(text) == other.encode(text, add_special_tokens=False).ids
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 5000), (3, "ab" * 30_000)]
    for r in packing.pack(table(spark, rows)).collect():
        ids = np.array([*other.encode(dict(rows)[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_pack_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_BUCKET", 7)
    rnd = random.Random(4)
    rows = [(i % 290, "a " * rnd.choice((0, 1, 3, 7, 30, 31))) for i in range(300)]
    got = packing.pack(table(spark, rows), capacity=16).collect()
    slots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert slots[0][1] == 0 and all((a[0] == b[0] and a[1] + a[2] == b[1]) or (a[0] < b[0] and b[1] == 0) for a, b in pairwise(slots))
    total = sum(n for _, _, n in slots)
    assert all(o + n <= 16 for _, o, n in slots) and len({s for s, _, _ in slots}) <= -(-total // 16) + 1


def test_bpe_equals_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own, other, rnd = bpe.codec(path), packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), path).plain, random.Random(3)
    for _ in range(3000):
        text = "".join(rnd.choice(rnd.choice(("aab", " the ing", "é🎉日ǅ", "12 '\n", "\x85 \x1c'll"))) for _ in range(rnd.randrange(40)))
        ids = own.ids_text(text)
        assert ids == " ".join(map(str, other.encode_ordinary(text))) and own.decode_text(ids) == text.encode()
    got = bpe.round_trip(table(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and next(r for r in got if r["doc_id"] == 1)["n_tokens"] == 0
    back = bpe.decode(bpe.encode(table(spark, AWKWARD)).withColumnRenamed("id", "doc_id")).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((t or "").encode() for _, t in AWKWARD)


def test_warc(spark):
    body = "<p>" + "x" * 200
    rows = [(3, "http://a/ö\r\nX: y", body), (1, None, body), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", body), (1, None, body)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 7
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got) == sorted([(3, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None), (4, "response", None), (5, "response", None), (0, "response", None)], key=str)
    assert all(r["payload_bytes"] == 203 and r["payload_digest"] == hashlib.sha256(body.encode()).hexdigest() for r in got if r["page_id"] in (1, 3))
    import io

    whole = warc.record_bytes("1", "u", b"abc" * 50000) + warc.record_bytes("2", "u", b"", "1")
    assert [r.payload for r in warc.read_records(io.BytesIO(whole), 100)] == [b"abc" * 50000, b""]
    import gzip

    plain = gzip.decompress(whole)
    forged = [plain.replace(b"abcabc", b"abcabd", 1), plain.replace(b"sha256:", b"sha256:0", 1)]
    for bad in (whole[:-3], whole[:50], *map(gzip.compress, forged)):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_records(io.BytesIO(bad)))


def test_warc_many_archives_a_task_and_empty_table(spark, tmp_path):
    rows = [(i, None, random.Random(i).randbytes(300).hex(), 5) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id int").coalesce(1)
    manifest = warc.write_archives(warc.with_targets(pages), f"file://{tmp_path}/w", archive_bytes=2000)
    assert manifest.count() > 5 and manifest.agg({"records": "sum"}).first()[0] == 50
    back = {r["id"]: bytes(r["payload"]).decode() for r in warc.read_archives(manifest).collect()}
    assert back == {r[0]: r[2] for r in rows}
    assert warc.archive_round_trip(pages.where("page_id < 0")).count() == 0


def test_ogg(spark):
    assert ogg.checksum(b"123456789") == 0x89A1897F
    for n in (64, 255 * 64, 4096 * 15, 4096 * 16 + 64, 300_032):
        raw = random.Random(n).randbytes(n)
        media = ogg.write_media(raw, b"note" * 200)
        payload, note, times, streams = ogg.read_media(media)
        assert payload == raw and note == b"note" * 200 and times[-1][1] == n / ogg.RATE and times[0][0] == 0 and len(streams) == 2
        damaged = bytearray(media)
        damaged[len(media) // 2] ^= 1
        with pytest.raises(ValueError):
            ogg.read_media(bytes(damaged))
    for r in ogg.media_round_trip(table(spark, AWKWARD)).collect():
        if r["doc_id"]:
            raw = ogg.padded((dict(AWKWARD)[r["doc_id"]] or "").encode())
            assert r["payload_sha256"] == hashlib.sha256(raw).hexdigest() and r["tail_crc32"] == zlib.crc32(raw[-64:]) and r["payload_bytes"] == len(raw)


def test_media_empty_and_repeated(spark):
    assert ogg.media_round_trip(table(spark, [])).count() == 0
    got = ogg.media_round_trip(table(spark, [*AWKWARD, (9, LONG), (10, "Some text here for all.")])).drop("doc_id").collect()
    assert len(got) == len(AWKWARD) + 2 and len(set(got)) == len({t or "" for _, t in AWKWARD})


def test_spans(spark):
    def words(seed, n):
        return " ".join(f"{chr(97 + (seed * 7 + k) % 26)}{seed * 31 + k}" for k in range(n))

    passage = ". ".join(words(s, 14) for s in (900, 901, 902, 903)) + ". "
    rows = [(k, f"{words(k, 12)}. {passage}{words(k + 50, 12)}.") for k in (5, 2, 9)] + [(11, "Clean text here. And more of it."), (12, None), (None, passage), (13, passage + passage), (14, "")]
    got = {r["doc_id"]: r for r in span_dedup.drop_repeated_spans(table(spark, rows)).collect()}
    text = dict(rows)
    assert len(got) == len(rows) and got[2]["text"] == text[2] and got[11]["text"] == text[11] and got[12]["text"] is None and got[None]["text"] == passage
    for k in (5, 9):
        assert got[k]["text"] == f"{words(k, 12)}. {words(k + 50, 12)}." and "".join(text[k][r["start"] : r["end"]] for r in got[k]["removed"]) == passage
    assert got[13]["text"] == "" and "".join(text[5][a:b] for a, b in span_dedup.sentences(text[5])) == text[5]
    assert span_dedup.drop_repeated_spans(table(spark, [])).count() == 0


def test_spans_against_all_runs(spark, monkeypatch):
    """With short sentences every border is a sentence's end, and the cover is that of all runs of sentences."""
    rnd = random.Random(12)
    pool = [" ".join(f"p{k}x{j}" for j in range(rnd.randint(1, 7))) + rnd.choice(".!?") for k in range(60)]
    blocks = [[rnd.choice(pool) for _ in range(rnd.randint(3, 12))] for _ in range(15)]
    rows = []
    for i in range(70):
        own = [s for _ in range(rnd.randint(1, 4)) for s in (rnd.choice(blocks) if rnd.random() < 0.6 else [f"u{i}n{rnd.randrange(10**6)} v{rnd.randrange(10**6)}." for _ in range(3)])]
        rows.append((rnd.randrange(10**6) if i % 9 else i, " ".join(x.upper() if rnd.random() < 0.05 else x for x in own)))
    rows += [rows[3], rows[40], (None, rows[5][1]), (77, None)]
    found = {}
    for i, t in set(rows) - {(None, rows[5][1]), (77, None)}:
        words = t.lower().split()
        borders = [0] + [k + 1 for k, w in enumerate(words) if w[-1] in ".!?"]
        for a in range(len(borders)):
            for b in range(a + span_dedup.LEAST_PIECES, len(borders)):
                if borders[b] - borders[a] >= span_dedup.LEAST_WORDS:
                    found.setdefault(tuple(words[borders[a] : borders[b]]), []).append((i, borders[a], borders[b]))
    gone = {}
    for places in found.values():
        for i, a, b in sorted(places)[1:]:
            gone.setdefault(i, set()).update(range(a, b))
    monkeypatch.setattr(span_dedup, "WINDOW", 200)
    got = span_dedup.drop_repeated_spans(table(spark, rows).withColumnsRenamed({"id": "gone", "n": "_key", "again": "removed"})).collect()
    assert len(got) == len(rows) and sum(map(len, gone.values())) > 500
    for r in got:
        if r["doc_id"] is not None and r["text"] is not None:
            old = dict(rows)[r["doc_id"]].split()
            assert r["text"].split() == [w for k, w in enumerate(old) if k not in gone.get(r["doc_id"], ())]


def test_spans_set_in_mid_sentence(spark):
    rnd, edge = random.Random(11), 2 * span_dedup.CUT - 1

    def words(n, stop):
        return [f"v{rnd.randrange(10**9)}" + "." * (rnd.random() < stop) for _ in range(n)]

    rows, where, gap = [], {}, lambda: rnd.choice((" ", " ", " ", "\n"))  # copies differ in their line ends
    for k in range(150):
        stop = rnd.choice((0, 0.03, 0.1))
        passage = words(rnd.randint(51, 75), stop)
        for i in (k, 1000 + k):
            before, after = words(rnd.randint(0, 20), 0.05) + words(rnd.randint(1, 40), 0), words(rnd.randint(1, 40), 0) + words(rnd.randint(0, 20), 0.05)
            rows.append((i, "".join(w + gap() for w in before + passage + after)))
            where[i] = (len(before), len(before) + len(passage))
    grams = Counter(g for _, t in rows for g in {tuple(w[k : k + 20]) for w in [t.split()] for k in range(len(w) - 19)})
    text = dict(rows)
    for r in span_dedup.drop_repeated_spans(table(spark, rows)).collect():
        old, (a, b) = text[r["doc_id"]], where[r["doc_id"]]
        gone = sorted(k for c in r["removed"] for k in range(len(old[: c["start"]].split()), len(old[: c["end"]].split())))
        assert r["text"].split() == [w for k, w in enumerate(old.split()) if k not in gone]
        if r["doc_id"] < 1000:
            assert not gone
        else:  # in one piece, short of the passage by a few words at most, and all of it in 20 words that repeat
            assert gone == list(range(gone[0], gone[-1] + 1)) and a <= gone[0] <= a + edge and b - edge <= gone[-1] + 1 <= b
            assert all(grams[tuple(old.split()[k : k + 20])] == 2 for k in range(gone[0], gone[-1] - 18))


def test_language(spark):
    rnd = random.Random(1)
    words = {"aa": ["the", "and", "house", "water"], "bb": ["der", "und", "haus", "wasser"]}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(20)), lang) for i in range(80) for lang in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa"), (901, "12 ... 3", "bb"), (902, "", None), (903, "x" * 500 + " 日本語", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:80]) and got[900]["lang_pred"] == got[901]["lang_pred"] == got[902]["lang_pred"] == "und"
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1 for i in got)
    assert langid.keep_identified(df).where("doc_id < 900").count() == 80 and langid.identify(df.where("doc_id < 0")).count() == 0


def test_forward_sums_all_segmentations():
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab, rng = langid.vocabulary(path), np.random.default_rng(4)
    model = langid.Model(["a", "b"], rng.dirichlet(np.ones(vocab.size), 2).T, path)
    piece = {vocab.model.id_to_piece(i): i for i in np.flatnonzero(vocab.normal)}

    def total(s):
        if not s:
            return np.ones(2)
        out = sum((model.probabilities[piece[s[:k]]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in piece), np.zeros(2))
        return out if s[0] in vocab.characters else out + model.probabilities[0] * total(s[1:])

    for word in ("house", "übermut", "q龘x"):
        assert np.exp(langid.Scorer(model).forward([word])[0]) == pytest.approx(total("▁" + word), rel=1e-9)


def test_forward_carries_on_over_long_words():
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab, rng = langid.vocabulary(path), np.random.default_rng(6)
    model = langid.Model(["a", "b"], rng.dirichlet(np.ones(vocab.size), 2).T, path)
    piece = {vocab.model.id_to_piece(i): i for i in np.flatnonzero(vocab.normal)}

    def total(s):  # logs, by the end of the last piece
        logs = [np.zeros(2)]
        for e in range(1, len(s) + 1):
            ways = [logs[k] + np.log(model.probabilities[piece[s[k:e]]]) for k in range(max(0, e - 64), e) if s[k:e] in piece]
            ways += [] if s[e - 1] in vocab.characters else [logs[e - 1] + np.log(model.probabilities[0])]
            logs.append(np.logaddexp.reduce(ways, axis=0))
        return logs[-1]

    words = ["house", "a" * 31, "b" * 32, "international" * 3, "wasserhaus" * 40, "日本語のテキスト" * 9, "q龘x" * 30, "the"]
    got = langid.Scorer(model).forward(words)
    for word, logs in zip(words, got, strict=True):
        assert logs == pytest.approx(total("▁" + word), rel=1e-9)


def test_language_letters_and_large_counts(spark):
    rows = [(1, "² ½ Ⅷ ٣ 12", "aa"), (2, "haus und hof", "aa"), (3, "the house", "bb"), (2, "haus und hof", "aa"), (None, "the house", "bb"), (5, "x²y", None)]
    df = spark.createDataFrame([(*r, "old", 1.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(df).collect()
    assert len(got) == 6 and next(r for r in got if r["doc_id"] == 1)["lang_pred"] == "und" and next(r for r in got if r["doc_id"] == 5)["lang_pred"] != "und"
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 2}) == 1 and all(not r["held_out"] for r in got if r["doc_id"] is None)
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and all(r["lang_pred"] == "old" and r["score"] == 1.5 for r in kept.collect())
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocab = langid.vocabulary(path)
    for many in (1e12, 1e15):
        counts = np.full((vocab.size, 2), langid.SMOOTHING)
        counts[100] += many, 2 * many
        logs = langid.Scorer(langid.Model(["a", "b"], counts / counts.sum(axis=0), path)).texts([["q" * 100], ["日本語" * 40, "zzzz"]])
        assert np.isfinite(logs).all() and np.allclose(langid.posterior(logs).sum(axis=1), 1)


def test_toxicity(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        parts = [" ".join(rnd.choice(["red", "blue", "green", "tree", "road"]) for _ in range(6)) for _ in range(5)]
        if toxic:
            parts[2] += " vileword"
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "!!!")]
    got = {r["doc_id"]: r for r in toxicity.toxicity(table(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 403 and all(got[i]["predicted"] == t for i, _, t in labels) and got[1000]["predicted"] == 0
    text, where = dict(rows)[8], got[8]["offending"]
    assert len(where) == 1 and "vileword" in text[where[0]["start"] :].split(".")[0]


def test_toxicity_gradient_and_score():
    rnd = np.random.default_rng(5)
    doc, labels, x, leak = np.array([0, 0, 0, 1, 2, 2]), np.array([1, 0, 1, 1]), rnd.normal(-1, 1, 6), -2.5
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def likelihood(x, leak):
        total = 0
        for d, label in enumerate(labels):
            none = (1 - sigmoid(leak)) * np.prod([1 - sigmoid(v) for v, e in zip(x, doc, strict=True) if e == d])
            total += np.log(1 - none) if label else np.log(none)
        return total

    g, g_leak = toxicity.gradient(x, doc, labels, leak)
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        assert g[k] == pytest.approx((likelihood(x + step, leak) - likelihood(x - step, leak)) / 2e-6, rel=1e-5)
    assert g_leak == pytest.approx((likelihood(x, leak + 1e-6) - likelihood(x, leak - 1e-6)) / 2e-6, rel=1e-5)

    model = toxicity.Model(rnd.normal(0, 0.3, 1 << toxicity.BITS).astype(np.float32), -2.0, -3.0)
    text = "Some words here. And others there!\nA third ünd last"
    got, p, _ = toxicity.document_score(text.encode(), model)
    cells, numbers, _ = toxicity.sentence_words(text.encode())
    want = [sigmoid(-2.0 + sum(float(model.weights[c]) for w, n in zip(cells, numbers, strict=True) if n == k for c in w)) for k in range(3)]
    assert p == pytest.approx(want, rel=1e-5) and got == pytest.approx(1 - (1 - sigmoid(-3.0)) * np.prod([1 - v for v in want]), rel=1e-5)


def test_toxicity_evidence():
    k, j = np.array([10.0, 0, 3, 50]), np.array([0.0, 10, 30, 400])
    got = toxicity.evidence(k, j, 50, 400)
    for g, a, b in zip(got, k, j, strict=True):
        cells = [(a, 50, a + b), (b, 400, a + b), (50 - a, 50, 450 - a - b), (400 - b, 400, 450 - a - b)]
        want = 2 * sum(x * np.log(x / (n * m / 450)) for x, n, m in cells if x)
        assert g == pytest.approx(want if a / 50 > b / 400 else 0)


def test_toxicity_awkward(spark):
    rows = [*AWKWARD, *[(i, ("vile " if i % 2 else "kind ") + "words. " * 3) for i in range(100, 160)], (101, "vile words. words. words. "), (500, "vile " + "calm words. " * 40_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 160)] + [(500, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(table(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 101}) == 1
    small = toxicity.train(table(spark, rows), labels, sample=20, sample_bytes=200)
    assert toxicity.score(table(spark, rows), small).count() == len(rows)
    nothing = toxicity.toxicity(table(spark, rows), labels.where("toxic > 5")).collect()
    assert len({r["score"] for r in nothing if r["doc_id"] in (1, 2, 7)}) == 1
    assert toxicity.toxicity(table(spark, []), labels).count() == 0 and toxicity.toxicity(table(spark, []), labels).columns == ["doc_id", "held_out", "score", "predicted", "offending"]


def test_chat(spark):
    rows = [(1, 0, "system", None), (1, 1, "user", r"a\l<s>[INST]\\"), (1, 2, "assistant", "x</s>"), (2, 1, "assistant", "b"), (2, 0, "user", "a < b [c]"), (3, 0, None, ""), (None, 0, "user", "q"), (2, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_round_trip(df).collect()}
    for c, turns in {1: [("system", ""), ("user", r"a\l<s>[INST]\\"), ("assistant", "x</s>")], 2: [("user", "a < b [c]"), ("assistant", "b"), ("assistant", "b")], 3: [("", "")]}.items():
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    shown = {r["conv"]: r["formatted"] for r in chat.format_chats(df).collect()}
    assert shown[2].startswith("#0") and shown[1].startswith("#1") and shown[1].count("</s>") == 3
    assert chat.chat_round_trip(df.where("conv_id > 9")).count() == 0


def test_chat_awkward(spark):
    rows = [(1, 0, "user", "</s>" * 20_000 + "é"), (1, 1, "assistant", "[INST]" * 20_000), (2, None, "assistant", "x"), (2, 0, None, None)]
    df = spark.createDataFrame([(*r, "a", "b", 3) for r in rows], "conv_id long, turn long, role string, text string, conv string, turns string, level int")
    got = {r["conv_id"]: r for r in chat.chat_round_trip(df).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:2]).encode()).hexdigest()
    assert got[1]["loss_chars"] == 120_000 and got[2]["turns_sha256"] == hashlib.sha256(b"assistant\nx\n\n\n").hexdigest() and got[2]["loss_chars"] == 1


def test_bpe_empty_table(spark):
    assert bpe.round_trip(table(spark, [])).count() == 0


def brute_stages(rows):
    """Texts by id after each stage, by plain loops. Every row has a letter and one language, so none goes at first."""
    kept, steps = {}, [dict(rows)]
    for i, t in rows:
        kept.setdefault(t.lower(), []).append(i)
    texts = {max(ids): dict(rows)[max(ids)] for ids in kept.values()}
    steps.append(texts)
    root = components(list(texts.items()), 5, 8, 10)
    texts = {i: t for i, t in texts.items() if root[i][1] == i}
    steps.append(texts)
    found = {}
    for i, t in texts.items():
        words = t.lower().split()
        ends = [0] + [k + 1 for k, w in enumerate(words) if w[-1] in ".!?"]
        for a in ends:
            for b in ends:
                if b - a >= span_dedup.LEAST_WORDS and sum(a < e <= b for e in ends) >= span_dedup.LEAST_PIECES:
                    found.setdefault(tuple(words[a:b]), []).append((i, a, b))
    gone = {}
    for places in found.values():
        for i, a, b in sorted(places)[1:]:
            gone.setdefault(i, set()).update(range(a, b))
    texts = {i: " ".join(w for k, w in enumerate(t.split()) if k not in gone.get(i, ())) for i, t in texts.items()}
    steps.append({i: t for i, t in texts.items() if t or i not in gone})
    return steps


def test_pipeline_against_brute_force(spark, tmp_path):
    rnd = random.Random(21)
    sentence = lambda: " ".join(f"{rnd.choice('abcdefgh')}{rnd.choice('klmnop')}{rnd.choice('aeiou')}{rnd.choice('rstvwz')}{rnd.choice('aeiou')}" for _ in range(rnd.randint(3, 7))) + "."
    shared, rows = [[sentence() for _ in range(8)] for _ in range(3)], []
    for i in range(120):
        if rows and i % 4 == 1:  # a copy, in other letters
            text = rnd.choice(rows)[1].upper()
        elif rows and i % 4 == 2:  # a near copy
            own = rnd.choice(rows)[1].split()
            own[rnd.randrange(len(own) - 1)] = "other"
            text = " ".join(own)
        else:
            text = " ".join([sentence() for _ in range(10)] + rnd.choice((shared[i % 3], [])) + [sentence() for _ in range(10)])
        rows.append((1000 + i, text))
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps = brute_stages(rows)
    assert len(steps[0]) > len(steps[1]) > len(steps[2]) and steps[3] != steps[2]
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert {r["doc_id"]: " ".join(r["text"].split()) for r in docs.collect()} == want
    lengths, encode = {}, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {r["doc_id"]: len(encode(r["text"]).ids) + 1 for r in docs.collect()}


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    docs = table(spark, AWKWARD).withColumnsRenamed({"id": "_row", "again": "removed", "n": "n_chars"})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id < 0"), "").count() == 0
        kept = sorted((r["doc_id"] or 0) for r in stage(spark, docs, "").select("doc_id").distinct().collect())
        assert kept == {"language_id": [], "exact_copies": [0, 2, 4, 5, 6, 7], "near_copies": [0, 1, 2, 3, 5, 6, 7], "repeated_spans": [0, 1, 2, 3, 4, 5, 6, 7], "best_fit_packing": [0, 1, 2, 3, 4, 5, 6, 7]}[name], (name, kept)


def test_pipeline(spark, corpus, tmp_path):
    docs = spark.createDataFrame([(i, t + ". Und mehr davon.", "en", "s", len(t)) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_copies", "near_copies", "repeated_spans", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_a_worker_keeps_the_tables_of_one_stage(spark):
    words = [f"wort{k} nummer{k % 7} haus und hof im langen satz davor und danach etwas mehr als zwanzig worte damit ein lauf entsteht hier am ende." for k in range(64)]
    df = spark.createDataFrame([(i, t, "de") for i, t in enumerate(words)], "doc_id long, text string, lang string").repartition(8)

    def probe(batches):
        for batch in batches:
            held = [len(langid._vocabularies) > 0, len(span_dedup._hashes) > 0, len(packing._encoders) > 0]
            yield pa.RecordBatch.from_pydict({"held": pa.array([sum(held)] * len(batch), pa.int32())})

    for stage in (langid.keep_identified, span_dedup.drop_repeated_spans, packing.pack):
        stage(df).write.format("noop").mode("overwrite").save()
        assert spark.range(0, 64, 1, 8).mapInArrow(probe, "held int").where("held > 1").count() == 0
