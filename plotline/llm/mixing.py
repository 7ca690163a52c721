"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents stand in a fixed pseudorandom order, which makes its words one stream; a *block* is ``block_words`` words of
it. Targets decide how many words, so how many blocks, each source gives in each of two passes over it. These exact block quotas are
divided among the output shards: a node of the tree halves its shards and draws the left half's share of every source from the
multivariate hypergeometric law, down to single shards. Each shard then draws a disjoint stretch of the source's permuted blocks, as
long as the tree says; a block that no shard's stretch holds is not taken in that pass. The last block is cut to the word, so that
sources meet their targets. Inside a shard all placements are shuffled by a hash (``dealt`` writes them out in that order).

Cases: a null text has no words; a null source is a source, the last in order. Documents without words are returned with no
placements. A very long document lies in several blocks, a document on the border of two in both: its parts may go to different
shards. Repeated rows are separate documents. Sources, tables or corpora without words take nothing; an empty table gives no rows. All
other input columns ride along in ``row``, whatever their names. Seeds and orders are fixed, so reruns agree."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotline.llm._rank import bucket_of, buckets_for, global_rank, offsets
from plotline.session import cut, stored

WORD = r"[^\x20\x09-\x0D]+"
GROUPS = 1024


def word_count(text: Column | str) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def take_words(text: Column, lo: Column, hi: Column) -> Column:
    """The text from its word number ``lo`` (from 0) to the end of the word before number ``hi``; from its very beginning if ``lo`` is
    0, and to its very end if it has no more than ``hi`` words."""

    @F.pandas_udf("string")
    def f(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        word = re.compile(WORD)
        for texts, los, his in batches:
            out = []
            for t, a, b in zip(texts, los, his, strict=True):
                if t is None or a is None or b is None:
                    out.append(t)
                    continue
                found = word.finditer(t)
                first = next(islice(found, int(a), None), None) if b > a else None
                if first is None:
                    out.append("")
                    continue
                last = first if b - a == 1 else next(islice(found, int(b - a) - 2, None), None)
                more = last is not None and next(found, None) is not None
                out.append(t[first.start() if a > 0 else 0 : last.end() if more else len(t)])
            yield pd.Series(out, dtype="object")

    return f(text, lo, hi)


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` draws without replacement from ``good + bad`` blocks are good, for numbers of any size: the inverse of the
    distribution function, summed from ratios of neighbouring probabilities over all outcomes within 40 deviations of the mean."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    total = good + bad
    mean = n * good / total
    spread = 40 * math.sqrt(mean * (bad / total) * ((total - n) / max(total - 1, 1))) + 40
    lo, hi = max(lo, math.floor(mean - spread)), min(hi, math.ceil(mean + spread))
    k = np.arange(lo, hi, dtype=np.float64)
    log_p = np.concatenate([[0.0], np.cumsum(np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1)))])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return lo + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def split_tree(counts: list[int], seats: list[int], rng: np.random.Generator) -> list[list[int]]:
    """(shards, sources): an exact division of ``counts`` blocks among shards that take ``seats`` blocks each. A node draws its left
    half's blocks of every source in turn, from what that source and the later ones have and what the left half still takes."""
    if len(seats) == 1:
        return [counts]
    mid = len(seats) // 2
    wanted, rest, left = sum(seats[:mid]), sum(counts), []
    for n in counts:
        rest -= n
        left.append(hypergeometric(n, rest, wanted, rng))
        wanted -= left[-1]
    return split_tree(left, seats[:mid], rng) + split_tree([n - x for n, x in zip(counts, left, strict=True)], seats[mid:], rng)


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size, docs) with sid (its rank by code point, null last), weight and target.

    Targets are weight * level, but at most ``most`` times the source's size; the level rises until they add up to ``share`` of
    all words. Each step is one aggregation over the sources; only its three sums come to the driver."""
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "sid")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    total = (ranked.agg(F.sum("source_size").alias("n")).first().n or 0) * share
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        got = ranked.agg(F.count_if(over).alias("k"), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("cap"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("w")).first()
        if got.k == capped or not got.w:
            break
        capped, level = got.k, (total - got.cap) / got.w
    return ranked.withColumn("target", F.least("cap", F.col("weight") * F.lit(level)) if capped >= 0 else F.lit(0.0))


def shard_quotas(strata: DataFrame, shards: int, seed: int) -> DataFrame:
    """sid, pass, ends ARRAY<BIGINT>: where each shard's stretch of a source's permuted blocks ends. ``strata`` has sid, pass, blocks.

    The driver splits the totals of at most GROUPS groups of sources; each group then splits its own, in one task."""
    strata = strata.withColumn("g", F.col("sid") % GROUPS)
    totals = {r.g: r.n for r in strata.groupBy("g").agg(F.sum("blocks").alias("n")).collect()}
    keys = sorted(totals)
    n = sum(totals.values())
    seats = [n // shards + (i < n % shards) for i in range(shards)]
    table = split_tree([totals[k] for k in keys], seats, np.random.default_rng(seed)) if keys else []
    of = {k: [row[i] for row in table] for i, k in enumerate(keys)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sid", "pass"])
        g = int(pdf.g.iloc[0])
        cut_up = np.array(split_tree(pdf.blocks.tolist(), of[g], np.random.default_rng([seed, g])), np.int64)
        return pd.DataFrame({"sid": pdf.sid.to_numpy(), "pass": pdf["pass"].to_numpy(), "ends": np.cumsum(cut_up, axis=0).T.tolist()})

    return strata.groupBy("g").applyInPandas(run, "sid long, pass int, ends array<long>")


def _multiplier(n: Column) -> Column:
    """A multiplier for the permutation k -> (k * m + c) mod n: near the golden section of n, and coprime to it."""

    @F.pandas_udf("long")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for x in s.fillna(1):
                m = max(1, int(x * 0.6180339887))
                while math.gcd(m, max(int(x), 1)) != 1:
                    m += 1
                out.append(m)
            yield pd.Series(out, dtype="int64")

    return f(n)


def _permuted(block: Column, i: int, seed: int) -> Column:
    """Place of a source's block in the order of pass ``i``."""
    wide = lambda c: c.cast("decimal(19,0)")
    return ((wide(block) * wide(F.col("multiplier")) + F.lit(seed + i)) % wide(F.col("blocks"))).cast("long")


def _sources(sums: DataFrame, shards: int, weights: tuple[float, ...], share: float, most: float, block_words: int, seed: int) -> DataFrame:
    """source, sid, source_size, target, blocks, multiplier, and for each pass i its blocks n_i, the words excess_i that the last of
    them is too long by, and the ends_i of the shards' stretches."""
    sources = source_targets(sums, weights, share, most).withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)).cast("long"))
    sources = sources.withColumn("multiplier", _multiplier(F.col("blocks")))
    whole, size = F.round("target").cast("long"), F.col("source_size")
    for i, words in enumerate((F.least(whole, size), F.greatest(whole - size, F.lit(0)))):
        short = F.when(_permuted(F.col("blocks") - 1, i, seed) < F.col("n"), F.col("blocks") * block_words - size).otherwise(0)
        held = F.when(F.col("n") > 0, F.col("n") * block_words - short).otherwise(0)  # words of the first n blocks in the order of the pass
        sources = sources.withColumn("words", words).withColumn("n", F.ceil(F.col("words") / F.lit(block_words)).cast("long"))
        sources = sources.withColumn("n", F.when(held < F.col("words"), F.col("n") + 1).otherwise(F.col("n")))  # a short block is among them
        sources = sources.withColumn(f"excess_{i}", held - F.col("words")).withColumnRenamed("n", f"n_{i}").drop("words")
    sources, _ = stored(sources.drop("docs", "cap", "weight"), "sources")
    strata = sources.select("sid", F.explode(F.array(*(F.struct(F.lit(i).alias("pass"), F.col(f"n_{i}").alias("blocks")) for i in (0, 1)))).alias("x")).select("sid", "x.pass", "x.blocks").where("blocks > 0")
    quotas = shard_quotas(strata, shards, seed).groupBy("sid").agg(*(F.first(F.when(F.col("pass") == i, F.col("ends")), ignorenulls=True).alias(f"ends_{i}") for i in (0, 1)))
    out, _ = stored(sources.join(quotas, "sid", "left"), "sources")
    return out


def mix(docs: DataFrame, source: Column, size: Column, shards: int = 8, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 8192, seed: int = 20240101) -> DataFrame:
    """row STRUCT (the input row), size, source_size, target, placements ARRAY<STRUCT<pass, block, shard, from_word, to_word, ord>>.

    A placement takes the words [from_word, to_word) of the document into a shard; ``ord`` orders the placements of a shard."""
    plain = [F.to_json(c) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in docs.dtypes]
    base = docs.select(F.struct("*").alias("row"), source.cast("string").alias("source"), size.cast("long").alias("size"), F.xxhash64(F.lit(seed), *plain).alias("h"))
    base, _ = stored(base, "sized")  # the texts are parsed and hashed once
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = _sources(sums, shards, weights, share, most, block_words, seed)
    buckets = buckets_for(base.count())
    base = base.withColumn("bucket", bucket_of(F.col("h"), buckets))
    named = lambda d: d.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    before = offsets(named(base.groupBy("source", "bucket").agg(F.sum("size").alias("n"))).select("sid", "bucket", "n"), ["sid"], "bucket", F.col("n"))
    rows = named(base).select("row", "size", "h", "bucket", "sid", "source_size", "target", "blocks", "multiplier", "excess_0", "excess_1", "n_0", "n_1", "ends_0", "ends_1")
    w = W.partitionBy("sid", "bucket").orderBy("h", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(before, ["sid", "bucket"]).withColumn("lo", F.col("before") + F.sum("size").over(w) - F.col("size"))
    lo, hi = F.col("lo"), F.col("lo") + F.col("size")
    none = F.array().cast("array<struct<pass:int,block:bigint,shard:int,from_word:bigint,to_word:bigint,ord:bigint>>")

    def taken(i: int) -> Column:
        """The parts of the document that lie in blocks which some shard draws in pass ``i``."""

        def one(k: Column) -> Column:
            at = _permuted(k, i, seed)
            stop = F.least((k + 1) * block_words, F.col("source_size")) - F.when(at == F.col(f"n_{i}") - 1, F.col(f"excess_{i}")).otherwise(0)
            return F.struct(
                F.lit(i).alias("pass"), k.alias("block"), F.size(F.filter(F.col(f"ends_{i}"), lambda e: e <= at)).alias("shard"),
                (F.greatest(lo, k * block_words) - lo).alias("from_word"), (F.least(hi, stop) - lo).alias("to_word"), F.xxhash64(F.lit(seed + 1 + i), "h", k).alias("ord"),
            )

        first, last = F.floor(lo / F.lit(block_words)).cast("long"), F.floor((hi - 1) / F.lit(block_words)).cast("long")
        parts = F.filter(F.transform(F.sequence(first, last), one), lambda x: (x["shard"] < shards) & (x["to_word"] > x["from_word"]))
        return F.when((hi > lo) & F.col(f"ends_{i}").isNotNull(), parts).otherwise(none)

    return rows.select("row", "size", "source_size", "target", F.concat(taken(0), taken(1)).alias("placements"))


def in_shard_order(mixed: DataFrame) -> DataFrame:
    """A row for each placement, with the columns of ``mixed`` but its placements, and x, the placement. Shards are range partitions of
    (shard, ord), sorted: that is their local shuffle."""
    one = mixed.withColumn("x", F.explode("placements")).drop("placements")
    order = [F.col("x.shard"), F.col("x.ord"), F.col("x.pass"), F.col("x.block"), F.col("x.from_word")]
    return one.repartitionByRange(*order).sortWithinPartitions(*order)


def dealt(mixed: DataFrame) -> DataFrame:
    """``in_shard_order``, stored, with shard, place (from 0, gapless in the shard), pass, block, from_word, to_word."""
    placed, _ = stored(in_shard_order(mixed).withColumn("_place", F.monotonically_increasing_id()), "shards")
    part = F.shiftright("_place", 33)
    parts = placed.groupBy(F.col("x.shard").alias("_shard"), part.alias("_part")).agg(F.min("_place").alias("first"), F.count("*").alias("n"))
    w = W.partitionBy("_shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = parts.select("_shard", "_part", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).alias("_shift"))  # a row for each partition and each shard
    out = placed.join(F.broadcast(before), (F.col("x.shard") == F.col("_shard")) & (part == F.col("_part")))
    return out.select(*(c for c in mixed.columns if c != "placements"), "x.shard", (F.col("_place") + F.col("_shift")).alias("place"), *(F.col(f"x.{c}") for c in ("pass", "block", "from_word", "to_word")))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row, and its placements (shard, from_word, to_word)."""
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("told_apart"))
    mixed = mix(sized, F.col("source"), F.col("size"))
    taken = F.aggregate("placements", F.lit(0).cast("long"), lambda s, x: s + x.to_word - x.from_word)
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), F.transform("placements", lambda x: F.struct(x["shard"].alias("shard"), x["from_word"].alias("from_word"), x["to_word"].alias("to_word"))).alias("placements"))
