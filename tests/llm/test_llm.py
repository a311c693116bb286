"""Corpus operators against brute force, round trips and held-out labels, on edge cases and real rows."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import ctw, exact, fmindex, media, mixing, neardup, packing, quality, rangecoder, shared, substring, tokenfiles, tokens, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score double"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, LONG), (7, LONG + " end"), (8, PASSAGE), (9, "x " + PASSAGE + " y"), (10, "x " + PASSAGE), (11, "Ünï cödé <|endoftext|> \x01 it's"), (None, "lost"), (12, LONG), (12, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 0.5) for i, t in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if r.doc_id is not None]


def removed(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [substring.HOT_SEGMENTS, 1])
def test_substring(docs, real, empty, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_SEGMENTS", hot)
    for df in (docs, real, empty):
        assert sorted(map(tuple, substring.without_repeats(df).collect())) == removed(plain(df))


def test_fm_index():
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(1, 5, 400), 0)
    text[200:300] = text[20:120]
    index = fmindex.FMIndex(text, 40)
    low, high = fmindex.streamed_matches(index, text, np.array([0, 200]), np.array([150, 100]), 40)
    at = np.concatenate((np.arange(150), np.arange(200, 300)))
    for i, a, b in zip(at, low, high, strict=True):
        want = [j for j in range(362) if (text[j : j + 40] == text[i : i + 40]).all()]
        assert sorted(index.order[a:b].tolist()) == want


def near(rows, percent):
    sets = []
    for i, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}))
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


@pytest.mark.parametrize("group", [neardup.GROUP_DOCS, 3])
def test_near_duplicates(docs, real, empty, monkeypatch, group):
    monkeypatch.setattr(neardup, "GROUP_DOCS", group)
    for df in (docs, real, empty):
        assert sorted(map(tuple, neardup.near_groups(df).collect())) == near(plain(df), 85)


def test_hub_and_spokes(spark, monkeypatch):
    """Spokes are linked through one document only, also when the family is dealt into parts."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(100, " ".join(base))]
    for i in range(12):
        w = list(base)
        at = rng.randrange(5, 115)
        w[at] = w[at + 1] = f"z{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (2, 2000):
        monkeypatch.setattr(neardup, "GROUP_DOCS", group)
        assert sorted(map(tuple, neardup.near_groups(df).collect())) == near(rows, 85)


@pytest.mark.parametrize("pairs, group, block", [(24, 3, 3), (1100, neardup.GROUP_DOCS, neardup.BLOCK_DOCS)])
def test_pairs_beyond_the_hub(spark, monkeypatch, pairs, group, block):
    """Pairs linked to nothing else in one family are found, whatever parts and blocks their two ends are dealt into."""
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(pairs):
        w = list(base)
        for at in random.Random(i).sample(range(5, 115, 10), 3):
            w[at] = f"z{i}-{at}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, "end"]))]
    want = near(rows, 85)
    assert sum(i != k for i, _, k, _ in want) == pairs
    monkeypatch.setattr(neardup, "GROUP_DOCS", group)
    monkeypatch.setattr(neardup, "BLOCK_DOCS", block)
    assert sorted(map(tuple, neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want


def copies(rows):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    out = []
    for i, t in rows:
        group = [(-len(u or ""), j) for j, u in rows if key(u) == key(t)]
        out.append((i, min(group)[1], len(group), i == min(group)[1], hashlib.sha256(key(t).encode()).hexdigest()))
    return sorted(out)


def test_exact(docs, real, empty):
    for df in (docs, real, empty):
        assert sorted(map(tuple, exact.exact_groups(df).collect())) == copies(plain(df))
    weak = exact.exact_groups(docs, lambda c: F.substring(exact.sha256(c), 1, 1))
    assert sorted(map(tuple, weak.collect())) == copies(plain(docs))
    assert sorted(r.doc_id for r in exact.deduplicated(docs).collect()) == sorted({k for _, k, *_ in copies(plain(docs))})


def test_media(docs, empty, spark):
    got = {r.doc_id: r for r in media.media_features(docs).collect() if r.doc_id is not None}
    for i, t in plain(docs):
        data = (t or "").encode()
        whole = data + b"\xff" * ((-len(data) % 576) if data else 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
    assert media.media_features(empty).count() == 0
    import gzip
    import struct

    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in ((b"IHDR", b"\0" * 13), (b"IEND", b"")))
    sound, packed = media.wav(b"abc"), gzip.compress(b"hello")
    first = b"%PDF-1.4\n1 0 obj\nendobj\nxref\n0 1\ntrailer\nstartxref\n23\n%%EOF\n"
    saved = first + b"2 0 obj\nendobj\nxref\n0 1\ntrailer\nstartxref\n" + str(len(first) + 15).encode() + b"\n%%EOF"
    import io
    import zipfile

    def zipped(name, data):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, data)
        return out.getvalue()

    nested = zipped("outer", zipped("inner", b"x"))
    assert media.Sniffer()(b".." + saved + b"--" + nested + b"%PDF-1.4 startxref 5 %%EOF") == [(2, len(saved), "application/pdf"), (4 + len(saved), len(nested), "application/zip")]
    assert media.Sniffer()(b"%PDF-1.7 PK\x03\x04" * 200_000) == []  # linear in the text
    df = spark.createDataFrame([(1, b"junk" + png + b"RIFFxx" + sound + packed + b"tail", "image/bmp"), (2, png, "text/plain"), (3, None, "a/b"), (4, png[:-1], None), (5, b"", None)], "id int, media binary, declared string")
    rows = {r.id: r for r in media.sniff(df, "media", "declared").collect()}
    assert rows[1].media_type == "image/bmp" and [(e.type, bytes(e.bytes)) for e in rows[1].embedded] == [("image/png", png), ("audio/wav", sound), ("application/gzip", packed)]
    assert (rows[2].media_type, rows[2].embedded) == ("image/png", []) and rows[3].media_type is None and rows[4].media_type == "application/octet-stream" == rows[5].media_type


def test_warc(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in [(1, "a"), (2, "a"), (3, None), (4, ""), (5, LONG), (6, "ü" * 9), (7, "a")]] + [(i, None, f"<p>{i % 40} {PASSAGE}</p>") for i in range(100, 200)], "page_id long, url string, html string")
    rows = pages.collect()
    got = {r.page_id: r for r in warc.archived(pages).collect()}
    assert len(got) == len(rows)
    for r in rows:
        data = (r.html or "").encode()
        chief = max(x.page_id for x in rows if (x.html or "") == (r.html or ""))
        g = got[r.page_id]
        assert (g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) == (len(data), warc.digest_of(data), "response" if chief == r.page_id else "revisit", None if chief == r.page_id else chief)
        assert g.payload is None if g.refers_to else bytes(g.payload) == data
    assert warc.archived(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.read_archives(warc.write_archives(pages, shared.new_dir(spark, "warc"), 5)).where("page_id in (1, 2)").collect()} == {"response"}


def test_warc_repeated_and_null_pages(spark):
    """A page_id with two payloads keeps both; of rows that repeat the responding page one responds; null ids are left out."""
    rows = [(5, "u1", "a"), (5, "u2", "zzz"), (7, "v", "a"), (8, None, "b"), (5, "u3", "b"), (9, "x", "c"), (9, "x", "c"), (9, "y", "c"), (3, "w", "c"), (None, "n", "d"), (4, None, None), (4, "z", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash")).withColumn("k", F.lit(0))
    got = warc.archived(pages).collect()
    kept = [r for r in rows if r[0] is not None]
    assert sorted((r.page_id, r.payload_digest) for r in got) == sorted((i, warc.digest_of((h or "").encode())) for i, _, h in kept)
    for html in {h or "" for _, _, h in kept}:
        same = [r for r in got if r.payload_digest == warc.digest_of(html.encode())]
        chief = max(i for i, _, h in kept if (h or "") == html)
        assert [(r.page_id, bytes(r.payload)) for r in same if r.record_type == "response"] == [(chief, html.encode())]
        assert all(r.refers_to == chief for r in same if r.record_type == "revisit")
    raw = warc.record(5, "u1", b"a", 7, "v", "2026-01-01T00:00:00Z", "0-0-0")
    assert b"WARC-Refers-To-Target-URI: v\r\n" in raw and warc.record_id(7, warc.digest_of(b"a")).encode() in raw


def test_quality(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(d, quality.training_labels(labels))
    held = quality.score(d, model).join(labels.where(shared.crc_mod("doc_id", 3) == 1), "doc_id").toPandas()
    assert ((held.score >= 0.5) == held.quality).mean() > 0.95
    assert quality.score(docs, model).where("score is null or score < 0 or score > 1").count() == 0
    none = quality.fit(empty, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).columns == docs.columns


def test_quality_scores_equal_a_plain_computation(spark):
    """Score by score: two dictionaries, the normalised size difference, a logistic curve; very long and clashing rows included."""
    import zstandard

    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d = d.unionByName(spark.createDataFrame([(10**6, "many words " * 200_000), (10**6 + 1, None), (10**6 + 2, "")], d.schema)).withColumn("score", F.lit(7.0)).withColumn("text_", F.lit("x"))
    model = quality.fit(d, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    press = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_checksum=False, write_dict_id=False).compress for x in (model.good, model.bad)]
    for r in d.collect():
        data = (r.text or "").encode()
        good, bad = (sum(len(f(data[a : a + 4096])) for a in range(0, len(data), 4096)) for f in press)
        x = (bad - good) / (bad + good) if good + bad else 0.0
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(model.slope * x + model.bias, -30, 30))), abs=1e-9)
    clash = quality.keep_good(d.withColumn("quality_score", F.lit("a")), model)
    assert clash.columns == [*d.columns, "quality_score"] and {r.quality_score for r in clash.collect()} == {"a"} and {r.score for r in clash.collect()} == {7.0}


def test_token_ids_equal_the_library(real):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    texts = [x for _, x in EDGES] + ["a<|startoftext|>b", "é ́x", "'s's don't x\x1cy", "İ Σ"]
    texts += ["A.B. c'S. don't! é. é! ñ% 1.5%. ... a̸. ẞ. 'ſ! ². ab². 5́. ḰK!", "<|endoftext|>. <|ENDOFTEXT|>! a<|startoftext|>: WORD?!% ?A"] + [r.text for r in real.limit(50).collect()]
    texts += [r"J\u030c H\u0331 T\u0308 W\u030a Y\u030a aJ\u030c. J\u030c! J\u030cA A\u0300B THE %".encode().decode("unicode_escape"), "THE CAFÉS. Café!", "Very long, WORDS and more. " * 80_000 + "x" * 5000]
    encode = tokens.WordEncoder(tokens.tokenizer_path(), keep=50)
    for run in (1, 300, encode.RUN):  # also where a run ends with the last text, and units leave and come back
        encode.RUN = run
        for got in (encode(texts), encode(iter(texts))):
            assert [bytes(x) for x in got] == [np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    got = tokens.encoder(tokens.tokenizer_path())(texts)
    assert list(tokens.encoder(tokens.tokenizer_path())([])) == []
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_token_files(docs, empty, real):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    for df in (docs, real):
        start, want = 0, []
        for i, text in sorted(plain(df), key=lambda r: (r[0], r[1] or "")):
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert sorted(map(tuple, tokenfiles.stored_tokens(df).collect())) == want
    assert tokenfiles.stored_tokens(empty).count() == 0


def test_range_coder(monkeypatch):
    assert sum(len(c) for *_, c in rangecoder.encode_blocks(np.full(5000, 7), 50_000)) < 300
    monkeypatch.setattr(rangecoder, "STEPS", 16)
    monkeypatch.setattr(rangecoder, "BLOCK", 512)
    rng = np.random.default_rng(5)
    for n in (0, 1, 15, 16, 17, 511, 512, 513, 3000):
        for top in (2, 60, 50_000):
            ids = rng.integers(0, top, n).astype("<u4")
            blocks = rangecoder.encode_blocks(ids, 50_000)
            assert (rangecoder.decode_blocks(blocks, 50_000) == ids).all()
    assert (rangecoder.decode_blocks(blocks[2:3], 50_000) == ids[1024:1536]).all()
    n, crc, coded = blocks[0]
    for at in (5, 40, len(coded) // 2):
        with pytest.raises(ValueError):
            rangecoder.decode_blocks([(n, crc, coded[:at] + bytes([coded[at] ^ 1]) + coded[at + 1 :])], 50_000)


def test_range_coder_mixes_orders(spark):
    """On real ids the mixture takes fewer bits than order 0 alone and than Zstandard over 16-bit ids."""
    import zstandard

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids = np.frombuffer(b"".join(tokens.encoder(tokens.tokenizer_path())(texts)), "<u4")
    bits = 8 * sum(12 + len(c) for *_, c in rangecoder.encode_blocks(ids, 49_408)) / len(ids)
    shares = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    assert bits < -(shares * np.log2(shares)).sum()
    assert bits < 8 * len(zstandard.ZstdCompressor(3).compress(ids.astype("<u2").tobytes())) / len(ids)


def test_packing(docs, real, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    for df in (docs, real):
        rows = packing.pack_documents(df, with_ids=True).collect()
        room, cut = {}, []
        for i, text in ((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()):
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            cut += [(i or 0, n, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for n, a in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(cut)
        for r in rows:
            assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
            room.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in room.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(room) <= 1.02 * sum(r.length for r in rows) / 4096 + 1
        assert len({r.doc_id for r in rows}) == df.select("doc_id").distinct().count()
    assert packing.pack_documents(empty).count() == 0
    lengths = np.random.default_rng(1).integers(1, 60, 300)
    bins, offsets = packing.best_fit_decreasing(lengths, 60)
    open_bins: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [b for b, r in enumerate(open_bins) if r >= lengths[i]]
        best = min(fits, key=lambda b: open_bins[b], default=None)
        if best is None:
            open_bins.append(60)
            best = len(open_bins) - 1
        assert offsets[i] == 60 - open_bins[best]
        open_bins[best] -= lengths[i]
    assert bins.max() + 1 == len(open_bins)


def test_context_tree(spark, docs, empty):
    small = spark.createDataFrame([(20, "abra cadabra"), (21, "Abra"), (22, "bar abba")], "doc_id long, text string")
    got = {r.doc_id: r for r in ctw.scores(docs.unionByName(small.select("doc_id", "text", F.lit("x").alias("lang"), F.lit(0.0).alias("score"))), small, depth=2).collect() if r.doc_id}
    counts = {}
    texts = [ctw.coded(t)[1] for t in ("abra cadabra", "Abra", "bar abba")]
    for b in texts:
        whole = b"\n\n" + b
        for i in range(2, len(whole)):
            for d in range(3):
                for j in range(8):
                    n = counts.setdefault((whole[i - d : i], (1 << j) + (whole[i] >> 8 - j)), [0, 0])
                    n[whole[i] >> 7 - j & 1] += 1
    from math import exp, lgamma, log, log10, pi

    kt = lambda a, b: lgamma(a + 0.5) + lgamma(b + 0.5) - log(pi) - lgamma(a + b + 1)

    def weighted(context, prefix):
        own = kt(*counts[context, prefix])
        if len(context) == 2:
            return own
        below = sum(weighted(c, p) for c, p in counts if p == prefix and len(c) == len(context) + 1 and c.endswith(context))
        return log(0.5 * exp(own) + 0.5 * exp(below))

    def one(context, d, prefix):
        """Probability of a one after the last d bytes of a context of two."""
        node = (context[2 - d :], prefix)
        if node not in counts:
            return None
        z, o = counts[node]
        own = (o + 0.5) / (z + o + 1)
        deeper = one(context, d + 1, prefix) if d < 2 else None
        if deeper is None:
            return own
        share = exp(kt(z, o) - log(2) - weighted(*node))
        return share * own + (1 - share) * deeper

    for i, text in ((4, "One two"), (21, "Abra")):
        whole, total = b"\n\n" + ctw.coded(text)[1], 0.0
        for k in range(2, len(whole)):
            for j in range(8):
                p = one(whole[k - 2 : k], 0, (1 << j) + (whole[k] >> 8 - j))
                p = 0.5 if p is None else p
                total += log10(p if whole[k] >> 7 - j & 1 else 1 - p)
        assert got[i].score == pytest.approx(total, abs=1e-4)
    assert got[4].n_tokens == 3 and got[4].n_known == 1 and got[4].train_tokens == 8
    # one and two are unknown; the end was seen three times among eight tokens of five kinds
    assert got[4].base_score == pytest.approx(sum(log10((c + 1) / (8 + 5 + 1)) for c in (0, 0, 3)))
    assert ctw.scores(empty, empty).count() == 0
    assert all(abs(r.score / (r.n_bytes * 8) + log10(2)) < 1e-6 for r in ctw.scores(docs, empty).collect())


@pytest.mark.parametrize("depth", [3, ctw.DEPTH])
def test_context_tree_scores_rare_grams(spark, docs, real, depth):
    """What a task holds does not change the scores: grams and words that it does not hold are joined."""
    training = docs.where("doc_id in (4, 6, 8, 11)").select("doc_id", "text").unionByName(real.select("doc_id", "text").limit(20))
    whole, few = (sorted((r.doc_id or -1, r.n_bytes, r.n_known, round(r.base_score, 4), r.score) for r in ctw.scores(docs, training, depth, *held).collect()) for held in ((), (100, 20)))
    assert [r[:4] for r in whole] == [r[:4] for r in few] and [r[4] for r in few] == pytest.approx([r[4] for r in whole], rel=1e-5)


def test_mixing(spark, docs, empty):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = mixing.mixed(d, labels)
    assert out.count() == d.count() and out.where("rate < 0 or copies < 0").count() == 0
    sums = out.agg(F.sum(F.col("n_tokens") * F.col("rate") * F.col("p_toxic")), F.sum(F.col("n_tokens") * F.col("p_toxic")), F.sum(F.col("n_tokens") * F.col("rate") * F.col("p_clean")), F.sum(F.col("n_tokens") * F.col("p_clean"))).first()
    assert sums[0] < 0.8 * sums[1] and 0.8 < sums[2] / sums[3] < 1.15
    known = out.join(labels, "doc_id").groupBy("toxic").agg(F.avg("copies").alias("c")).collect()
    c = {r.toxic: r.c for r in known}
    assert c[1] < 0.5 * c[0]
    edge = mixing.mixed(docs, labels)
    assert edge.count() == len([1 for i, _ in EDGES if i is not None]) and edge.where("p_clean is null").count() == 0
    assert mixing.mixed(empty, labels.limit(0)).count() == 0
    assert mixing.resample(docs, labels.limit(0)).columns == docs.columns


def told_apart(spark, marked, n, size, label):
    """``n`` documents of 40 words, of which ``marked`` have ``size`` words of their own and the label (quality, toxic)."""
    own, common = " ".join(f"own{j % 5}" for j in range(size)), " ".join(f"word{j}" for j in range(40))
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    d = ids.select("doc_id", F.when(F.col("doc_id") < marked, own).otherwise(common).alias("text"))
    return d, ids.select("doc_id", *[F.when(F.col("doc_id") < marked, x).otherwise(y).alias(c) for c, x, y in zip(("quality", "toxic"), label, (1, 0), strict=True)])


@pytest.mark.parametrize("marked, n, size", [(20, 5000, 5), (50, 2000, 8), (100, 2000, 40)])
def test_mixing_removes_rare_domains(spark, marked, n, size):
    """Toxic documents with 0.05 %, 0.5 % and 5 % of the tokens are all left out, clean ones stay in number."""
    d, labels = told_apart(spark, marked, n, size, (1, 1))
    kept = {r.toxic: r for r in mixing.mixed(d, labels).withColumn("toxic", F.col("doc_id") < marked).groupBy("toxic").agg(F.max("rate").alias("rate"), F.sum("copies").alias("n")).collect()}
    assert kept[True].n == 0 and kept[True].rate < 1e-6
    assert kept[False].n == pytest.approx(n - marked, rel=0.02)


def test_rates_equal_least_squares(spark):
    """Projected gradient reaches what a plain descent on the same weighted nonnegative least squares reaches; the fit tells what is left."""
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet((0.4, 0.4, 0.4), 60), rng.integers(1, 200, 60)
    members = spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (q, t) in enumerate(zip(p, n, strict=True))], "doc_id long, n_tokens long, p array<double>")
    held = (p * n[:, None]).sum(0)
    for shares in ((1.0, 1.0, 1.0), (0.5, 1.2, 1.3), (1.4, 0.9, 0.8), (0.0, 0.0, 1.0)):
        targets = held * shares
        rated, fit = mixing.fit_rates(members, list(targets), steps=200)
        rates = np.array([r.rate for r in rated.orderBy("doc_id").collect()])
        plain = np.ones(60)
        for _ in range(20_000):
            plain = np.maximum(0, plain - 0.5 * p @ ((plain * n) @ p / held - targets / held))
        loss = lambda r: ((((r * n) @ p - targets) ** 2) / held).sum()
        # where the targets cannot be met, 200 steps come within 0.2 % of the tokens of what 20,000 reach
        assert (rates >= 0).all() and loss(plain) - 1e-6 <= loss(rates) <= loss(plain) + 2e-3 * held.sum()
        assert fit.settled == (shares != (0.0, 0.0, 1.0)) and fit.expected == pytest.approx(list((rates * n) @ p))
        if fit.settled:
            assert fit.expected == pytest.approx(list(targets), rel=1e-2)


def test_resampled_totals_meet_two_targets(spark):
    d, labels = told_apart(spark, 900, 3000, 40, (0, 0))
    out = mixing.resample(d, labels, {"clean": 0.64, "low": 0.36})
    assert out.where(F.col("doc_id") < 900).count() / out.count() == pytest.approx(0.36, rel=0.04)
    assert out.count() == pytest.approx(3000, rel=0.03)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.good_quality(spark, d, sf)
    assert good.columns == d.columns and 0 < good.count() <= d.count()
    ids = {r.doc_id for r in corpus_pipeline.exact_copies(spark, good, sf).collect()}
    assert ids == {k for _, k, *_ in copies(plain(good))}
    once = good.where(F.col("doc_id").isin(*ids))
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, once, sf).collect()} == {i for i, _, k, _ in near(plain(once), 80) if i == k}
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert os.path.exists(corpus_pipeline.__file__)
