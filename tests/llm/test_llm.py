"""The ten operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns with clashing names."""

import bisect
import gzip
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plotline.llm import lm_scoring, media, mixing, ngram_join, packing, quality, sharding, topk, toxicity, warc
from plotline.llm.components import components

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lang " * 30_000
TEXTS = [None, "", " \t\n", "one", "One two", "a b c d e", "A b c d E", "a b c d e f", "x" * 5000, LONG, "é ü ß 漢字   🙂", "<|endoftext|> tail", "a b c d e"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, size string, shard string, cls string, id string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, repeated rows and columns whose names the operators use themselves."""
    rows = [(i, t, "en", [None, "a", "b"][i % 3], None, 0.5, "r", "s", "h", "c", "i") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "a null id here", *rows[0][2:])], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# --- packing


def check_packing(pieces, texts):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = []
    for doc, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        n, at, piece = len(ids), 0, 0
        while at < n:
            size = n % 2048 if at == 0 and n % 2048 else 2048
            want.append((doc, piece, at, size, zlib.crc32(ids[at : at + size].tobytes())))
            at, piece = at + size, piece + 1
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces), key=key) == sorted(want, key=key)
    seqs = {}
    for r in pieces:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    return len(seqs), sum(w[3] for w in want)


def test_packing_odd_rows(spark, odd, none):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    check_packing(packing.pack_documents(odd).collect(), texts)
    assert packing.pack_documents(none).count() == 0


def test_packing_is_near_the_bound(spark, real):
    n, total = check_packing(packing.pack_documents(real).collect(), [(r.doc_id, r.text) for r in real.collect()])
    assert n <= math.ceil(total / 2048) * 1.02 + 1


@pytest.mark.parametrize("partitions", [1, 4, 31])
def test_best_fit_places_everything(spark, partitions):
    rng = np.random.default_rng(3)
    sizes = np.concatenate([rng.integers(1, 100, 300), np.full(150, 700), [1, 1, 1]]).tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, size long").repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = packing.best_fit(items, 1000).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.id for r in got) == list(range(len(sizes)))
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.size))
    for s in seqs.values():
        assert [o for o, _ in sorted(s)] == [0, *np.cumsum([n for _, n in sorted(s)])[:-1].tolist()] and sum(n for _, n in s) <= 1000
    gaps, bins = [], 0
    for x in sorted(sizes, reverse=True):  # sequential best fit
        i = bisect.bisect_left(gaps, x)
        room = gaps.pop(i) if i < len(gaps) else 1000
        bins += i >= len(gaps) + (room != 1000)
        bisect.insort(gaps, room - x)
    assert len(seqs) <= max(bins, math.ceil(sum(sizes) / 1000)) * 1.05 + 2


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_rank_file_gives_the_same_ids(text):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert packing.tokenizer(packing.default_ranks()).encode(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


# --- WARC


def test_warc_round_trip(spark, tmp_path):
    big, other = "x" * 1200, "WARC/1.1\r\n\r\n" * 200
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", other), (9, "u", big), (9, "u", big), (None, "u", other)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()), key=lambda x: (x[0] is None, x[0] or 0))
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for i, _, h in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        to = {1: 9, 2: 9, None: 7}.get(i)
        want.append((i, len((h or "").encode()), sha(h), "revisit" if to else "response", to))
    assert got == want
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def record(body: bytes, i: int) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: %d\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (i, hashlib.sha1(body).hexdigest().encode(), len(block)) + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    parts = [gzip.compress(record(b"body %d" % i * 50, i)) if packed else record(b"body %d" % i * 50, i) for i in range(5)]
    at = len(parts[0]) + len(parts[1]) // 2
    damaged = bytearray(b"junk" + b"".join(parts) + b"tail")
    damaged[4 + at] ^= 0xFF
    found = list(warc.salvage(bytes(damaged)))
    assert [int(f["warc-page-id"]) for k, _, _, f, _ in found if k == "record"] == [0, 2, 3, 4]
    gaps = [(a, b) for k, a, b, _, _ in found if k == "gap"]
    assert gaps == [(0, 4), (4 + len(parts[0]), 4 + len(parts[0]) + len(parts[1])), (len(damaged) - 4, len(damaged))]
    assert sum(b - a for _, a, b, _, _ in found) == len(damaged)


# --- mixing


def check_mix(rows, docs):
    size = lambda t: len(WORD.findall(t or ""))
    key = lambda s: (s is None, (s or "").encode())
    sources = {}
    for s, t in docs:
        sources[s] = sources.get(s, 0) + size(t)
    names = sorted(sources, key=key)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, cap, target = 1.5 * sum(sources.values()), set(), {}
    while True:
        free = [s for s in names if s not in cap]
        level = (total - sum(2 * sources[s] for s in cap)) / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > 2 * sources[s]}
        if not over:
            break
        cap |= over
    target = {s: 2 * sources[s] if s in cap else w[s] * level for s in names}
    got = {s: 0 for s in names}
    assert len(rows) == len(docs)
    for r in rows:
        got[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sources[r.source] and abs(r.target - target[r.source]) < 1e-6
    assert all(abs(got[s] - target[s]) <= 1 for s in names)


def test_mixing(spark, odd, none, real):
    for docs in (odd, real):
        sized = docs.select("doc_id", "source", "text", mixing.word_count("text").alias("words"))
        mixed = mixing.mix(sized, F.col("source"), F.col("words"))
        taken = F.aggregate("placements", F.lit(0).cast("long"), lambda s, x: s + x.to_word - x.from_word)
        rows = mixed.select(F.col("row.source").alias("source"), "size", "source_size", "target", taken.alias("taken")).collect()
        check_mix(rows, [(r.source, r.text) for r in docs.collect()])
    a, b = (sorted(map(str, mixing.mix_documents(real).collect())) for _ in range(2))
    assert a == b
    assert mixing.mix_documents(none).count() == 0


def test_blocks_are_dealt_once(spark, real):
    sized = real.select("doc_id", "source", mixing.word_count("text").alias("words"))
    rows = mixing.mix(sized, F.col("source"), F.col("words"), shards=4, block_words=64).select("row.source", F.explode("placements").alias("p")).select("source", "p.*").collect()
    shard, per = {}, {}
    for r in rows:
        assert shard.setdefault((r.source, r["pass"], r.block), r.shard) == r.shard
    for k in shard.values():
        per[k] = per.get(k, 0) + 1
    assert set(per) == {0, 1, 2, 3} and max(per.values()) - min(per.values()) <= 1


def test_split_tree_is_exact():
    counts, seats = [10, 0, 7, 1], [5, 5, 4, 4]
    out = np.array(mixing.split_tree(counts, seats, np.random.default_rng(0)))
    assert (out.sum(0) == counts).all() and (out.sum(1) == seats).all() and (out >= 0).all()
    large = [3 * 10**11, 5, 10**12]
    out = np.array(mixing.split_tree(large, [sum(large) // 2, sum(large) - sum(large) // 2], np.random.default_rng(0)))
    assert (out.sum(0) == large).all() and abs(out[0, 0] / (out[0, 0] + out[0, 2]) - 3 / 13) < 1e-5


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    for good, bad, n in ((7, 5, 6), (1, 30, 4), (40, 2, 41), (3, 0, 2), (0, 4, 3)):
        want = np.array([math.comb(good, k) * math.comb(bad, n - k) for k in range(min(good, n) + 1) if n - k <= bad], float)
        lo = max(0, n - bad)
        got = np.bincount([mixing.hypergeometric(good, bad, n, rng) - lo for _ in range(8000)], minlength=len(want)) / 8000
        assert len(got) == len(want) and abs(got - want / want.sum()).max() < 0.02


def test_rows_come_through_the_tree(spark, real, monkeypatch):
    monkeypatch.setattr(mixing, "shard_quotas", lambda strata, shards, seed: strata.select("sid", "pass", F.array(*[F.lit(0).cast("long")] * shards).alias("ends")))
    assert mixing.mix_documents(real).where("taken > 0").isEmpty()


def test_shards_are_dealt_and_shuffled(spark, real):
    sized = real.select("doc_id", "source", mixing.word_count("text").alias("words"), F.lit(1).alias("shard"))
    mixed = mixing.mix(sized, F.col("source"), F.col("words"), shards=4, block_words=256)
    want = sorted((r["row"].doc_id, p["pass"], p.shard, p.from_word, p.to_word) for r in mixed.collect() for p in r.placements)
    rows = mixing.dealt(mixed).collect()
    assert sorted((r["row"].doc_id, r["pass"], r.shard, r.from_word, r.to_word) for r in rows) == want
    for k in range(4):
        own = sorted((r.place, r["row"].source or "") for r in rows if r.shard == k)
        assert [x for x, _ in own] == list(range(len(own)))
        assert sum(x != y for (_, x), (_, y) in zip(own, own[1:])) > len(own) / 4  # sources are mixed, not in stretches


def test_take_words(spark):
    df = spark.createDataFrame([("a  bb c ", 0, 2), ("a", 0, 5), (None, 0, 1), ("x y", 0, 0), (" a b c ", 1, 2), (" a b c ", 1, 3), ("a b", 5, 7), (" a b ", 0, 2)], "t string, i long, n long")
    assert [r[0] for r in df.select(mixing.take_words(F.col("t"), F.col("i"), F.col("n"))).collect()] == ["a  bb", "a", None, "", "b", "b c ", "", " a b "]


# --- sharding


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    for n in range(1, 12):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert set(b[a != b]) <= {n} and abs((a != b).mean() - 1 / (n + 1)) < 0.02 and abs(np.bincount(a, minlength=n) / len(a) - 1 / n).max() < 0.02


def published_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one():
    keys = [0, 1, 7, 2**63 + 5, 2**64 - 1, 123456789]
    assert sharding.jump_hash(np.array(keys, np.uint64), 9).tolist() == [published_jump(k, 9) for k in keys]


def test_sharding(spark, odd, none, real):
    for docs in (odd, real):
        rows, texts = sharding.shard_documents(docs).collect(), {(r.doc_id, r.text) for r in docs.collect()}
        assert len(rows) == docs.count()
        assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts}
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in rows)
        for r in rows:  # the published function, key by key
            key = sharding.splitmix(np.array([(r.doc_id or 0) ^ (0x5851F42D4C957F2D if r.doc_id is None else 0)], np.uint64))[0]
            assert (r.shard, r.grown_shard) == (published_jump(int(key), 8), published_jump(int(key), 9))
    assert sharding.shard_documents(none).count() == 0


# --- classifiers


@pytest.mark.parametrize("name,classify", [("quality", quality.classify_quality), ("toxic", toxicity.classify_toxicity)])
def test_classifier_edges(spark, odd, none, real, labels, name, classify):
    rows = classify(odd.unionByName(real, allowMissingColumns=True), labels).collect()
    assert len(rows) == odd.count() + real.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert classify(none, labels).count() == 0
    assert all(0 <= r.score <= 1 for r in classify(odd, no_labels(spark)).collect())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    for name, classify, least in (("quality", quality.classify_quality, 0.97), ("toxic", toxicity.classify_toxicity, 0.95)):
        x = classify(docs, labels).where("held_out").join(labels.select("doc_id", F.col(name).alias("y")), "doc_id").toPandas()
        assert (x.predicted == x.y).mean() >= least
        r = x.score.rank()
        p = x.y == 1
        assert (r[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum()) > 0.95


def test_scores_do_not_depend_on_the_batch(real):
    texts = [r.text for r in real.limit(50).collect()]
    import pyarrow as pa

    from plotline.llm._text import flat

    whole = quality.statistics(*flat(pa.array(texts)))
    assert (whole == np.concatenate([quality.statistics(*flat(pa.array([t]))) for t in texts])).all()


# --- n-gram join


def groups_by_hand(docs):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(table))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 0.8 <= len(sets[i]) / len(sets[j]) <= 1.25 and 100 * (n := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - n):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def test_ngram_join(spark, odd, none, real):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    near = []
    for k in range(40):  # copies with one to four words changed: some pairs link only through others
        w = list(base)
        for i in rng.integers(0, 120, 1 + k % 4):
            w[i] = f"v{k}_{i}"
        near.append((1000 + k, " ".join(w)))
    edge = [(2000, " ".join(f"e{i}" for i in range(13))), (2001, " ".join(f"e{i}" for i in range(12))), (2002, " ".join(f"e{i}" for i in range(11)))]
    for docs in ([(r.doc_id, r.text) for r in odd.collect()] + near + edge, [(r.doc_id, r.text) for r in real.collect()]):
        got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == groups_by_hand(docs)
    assert ngram_join.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (1, 2)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(61)}


# --- media


def test_payloads_survive(spark, odd, none):
    rows = media.media_digests(odd).collect()
    by = {}
    for r in odd.collect():
        b = (r.text or "").encode()
        p = b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))
        by.setdefault(r.doc_id, set()).add((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in by[r.doc_id]
    assert media.media_digests(none).count() == 0


def test_general_scans_decode_like_the_fast_ones():
    rng = np.random.default_rng(0)
    files = media.payload_jpeg([rng.integers(0, 256, 64 * k).astype(np.uint8) for k in (1, 5, 30)])
    pics, fast = media.coefficients(files)
    for pic, have in zip(pics, fast, strict=True):
        slow = {c: np.zeros_like(x) for c, x in have.items()}
        for scan in pic.scans:
            media._scan_serial(pic, scan, slow)
        assert all((slow[c] == have[c]).all() for c in have)
        assert media.rgb(pic, have).shape == (pic.height, pic.width, 3)


def test_inverse_transform():
    rng = np.random.default_rng(1)
    coef = rng.integers(-60, 60, (20, 64))
    at = np.zeros((20, 64))
    at[:, media.ZIGZAG] = coef
    c = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
    want = np.clip(np.floor(c.T @ at.reshape(-1, 8, 8) @ c + 128.5), 0, 255)
    assert np.abs(media.planes(coef, np.ones(64, np.int64)).astype(int) - want).max() <= 1


def test_damaged_media_raises():
    with pytest.raises(ValueError):
        media.decode(b"\xff\xd8nothing")


# --- top-k


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1 + i % 7, 8).tolist()) for i in range(300)] + [(400, [0.0] * 8), (500, None), (520, [None] * 8), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, [1.0] * 8), (420, [1.0] * 3), (440, []), (20, [9.0] * 8)]
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id long, embedding array<double>, label int, score string")
    for k, bucket in ((20, 64), (1000, 4096)):
        got = {}
        for r in topk.top_k(table, k=k, bucket_rows=bucket).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        ok = [(i, np.floor(64 * np.array(v + [0.0] * (8 - len(v))))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
        asked = dict(sorted(((i, v) for i, v in ok if i % 20 == 0), key=lambda x: -float(x[1] @ x[1])))  # a shared id asks with its shortest vector
        for q, v in asked.items():
            want = sorted(((-int(v @ c), i) for i, c in ok if i != q))[:k]
            assert [(i, -s) for s, i in want] == [(i, s) for _, i, s in sorted(got[q])], q
    assert topk.top_k(table.limit(0)).count() == 0


# --- LM scoring


def scores_by_hand(texts):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [WORD.findall((t or "").translate(table)) for t in texts]
    uni, bi = {}, {}
    for w in docs:
        for a in w:
            uni[a] = uni.get(a, 0) + 1
        for a in zip(w, w[1:], strict=False):
            bi[a] = bi.get(a, 0) + 1
    n = sum(uni.values())
    out = []
    for w in docs:
        s = [math.log(uni[b] / n if i == 0 else bi[w[i - 1], b] / uni[w[i - 1]] if bi[w[i - 1], b] >= 2 else 0.4 * uni[b] / n) for i, b in enumerate(w)]
        out.append((len(w), round(sum(s) / len(s), 6) if s else None))
    return out


def test_lm_scoring(spark, odd, none, real):
    for docs in (odd, real):
        rows = docs.collect()
        got = lm_scoring.stupid_backoff(docs).collect()
        want = {}
        for r, s in zip(rows, scores_by_hand([r.text for r in rows]), strict=True):
            want.setdefault(r.doc_id, []).append(s)
        assert len(got) == len(rows)
        for r in got:
            assert any(n == r.n_words and (s is None) == (r.score is None) and (s is None or abs(s - r.score) < 2e-6) for n, s in want[r.doc_id])
    assert lm_scoring.stupid_backoff(none).count() == 0


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        nxt = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert nxt.columns == corpus_pipeline.COLUMNS
        if name in ("quality", "toxicity", "near_copies"):
            assert nxt.exceptAll(docs).isEmpty() and 0 < nxt.count() <= docs.count()
        if name == "near_copies":
            again = ngram_join.near_duplicates(nxt)
            assert again.where("doc_id <> component_id").isEmpty()
        sizes[name], docs = nxt.count(), nxt
    assert sizes["packing"] > 0
