"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are runs of letters and digits, A-Z lower-cased, so signs and white space don't matter. Seeds of a
test item are its word n-grams that chance makes rare: the product of the corpus shares of their words, counted over all
documents, is at most ``RARE`` per million words. The shares are of single words, so a passage copied into
thousands of documents stays rare. Every item keeps at least its ``LEAST_SEEDS`` rarest n-grams. Documents' n-grams are
looked up among the seeds; the words around the hits (as many as the longest item has, on either side)
make passages, which are joined by seed to the items and aligned word by word. The score is
the best local alignment over that of the item with itself, so edits, gaps and left-out words lower it gradually.

Seeds go to the tasks in blocks of items of bounded size. Items of fewer than ``SEED_WORDS`` words or with a null text have no seeds and
match nothing; null and empty documents match nothing. Repeated rows and rows with one id give one result
per id and item, the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from forecastlab.llm.common import free_name, map_arrow, small_side, table
from forecastlab.llm.registry import query
from forecastlab.llm.wordhash import SIGNS, gram_hash, slices, words_of
from forecastlab.session import settle

SEED_WORDS = 3
RARE = 1.0  # expected chance occurrences in a million words
LEAST_SEEDS = 4
BLOCK_SEEDS = 2_000_000  # seeds in a broadcast at one time, 16 MB
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5


def _grams(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram hashes and the positions where they start, only those inside one text."""
    grams = gram_hash(words, SEED_WORDS)
    inside = np.ones(len(grams), bool)
    for back in range(1, SEED_WORDS):
        edge = bounds[1:-1] - back
        inside[edge[(edge >= 0) & (edge < len(grams))]] = False
    at = np.flatnonzero(inside)
    return grams[at], at


def item_words(benchmark: DataFrame) -> DataFrame:
    """``(item, item_id, n, words)``: the word hashes of every item as bytes; ``item`` tells items apart, whatever their ids."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, rows in slices(batch.column("text")):
            words, bounds = words_of(rows, SIGNS)
            parts = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.record_batch(
                [batch.column("item").slice(start, len(rows)), batch.column("item_id").slice(start, len(rows)), pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["item", "item_id", "n", "words"],
            )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("text is not null").dropDuplicates().withColumn("item", F.xxhash64("item_id", "text"))
    return map_arrow(rows, work, "item long, item_id long, n long, words binary").where(f"n >= {SEED_WORDS}")


def item_grams(items: DataFrame) -> DataFrame:
    """``(item, seed, parts)``: distinct n-grams of every item with their word hashes."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for item, raw in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
            words = np.frombuffer(raw, np.uint64)
            seeds, at = np.unique(gram_hash(words, SEED_WORDS), return_index=True)
            parts = np.lib.stride_tricks.sliding_window_view(words, SEED_WORDS)[at].view(np.int64)
            yield pa.record_batch(
                [pa.array([item] * len(seeds), pa.int64()), pa.array(seeds.view(np.int64)), pa.array(parts.tolist(), pa.list_(pa.int64()))],
                names=["item", "seed", "parts"],
            )

    return map_arrow(items.select("item", "words"), work, "item long, seed long, parts array<bigint>")


def word_counts(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """``(word, n)``: occurrences of the given (bounded, sorted) words over all documents, and of all words under a null word."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total, counts = 0, np.zeros(len(known), np.int64)
        for _, rows in slices(batch.column("text")):
            found = words_of(rows, SIGNS)[0]
            total += len(found)
            at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
            if len(known):
                counts += np.bincount(at[known[at] == found], minlength=len(known))
        seen = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array([None, *known[seen].view(np.int64).tolist()], pa.int64()), pa.array([total, *counts[seen].tolist()], pa.int64())],
            names=["word", "n"],
        )

    return map_arrow(docs.select(F.col("text").cast("string").alias("text")), work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rare_seeds(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """``(item, seed)``: the n-grams that are rare by chance, and at least the rarest few of each item."""
    total = F.lit(max(1, counts.where("word is null").agg(F.sum("n")).first()[0] or 0))
    share = F.log((F.coalesce("n", F.lit(0)) + 1) / (total + 1))
    long = grams.select("item", "seed", F.explode("parts").alias("word")).join(counts.where("word is not null"), "word", "left")
    chance = long.groupBy("item", "seed").agg(F.sum(share).alias("chance"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("chance", "seed"))  # one item's n-grams
    return chance.withColumn("rank", rank).where((F.col("chance") <= F.log(F.lit(RARE / 1e6))) | (F.col("rank") <= LEAST_SEEDS)).select("item", "seed")


def passages(docs: DataFrame, key: str, seeds: np.ndarray, reach: int) -> DataFrame:
    """``(key, start, words, seeds)``: the words around seed hits of every whole document, overlapping ones as one."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)  # bounded by BLOCK_SEEDS

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = shared.value
        keys = batch.column("key")
        for first, rows in slices(batch.column("text")):
            words, bounds = words_of(rows, SIGNS)
            grams, at = _grams(words, bounds)
            place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            hit = known[place] == grams
            at, grams = at[hit], grams[hit]
            if not len(at):
                continue
            text = np.searchsorted(bounds, at, side="right") - 1
            new = np.r_[True, (text[1:] != text[:-1]) | (at[1:] - at[:-1] > 2 * reach)]
            edges = np.flatnonzero(np.r_[new, True])
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                low, high = bounds[text[a]], bounds[text[a] + 1]
                start, stop = max(low, at[a] - reach), min(high, at[b - 1] + SEED_WORDS + reach)
                out.append((keys[first + int(text[a])].as_py(), int(start - low), words[start:stop].tobytes(), np.unique(grams[a:b]).view(np.int64).tolist()))
            columns = list(zip(*out))
            yield pa.record_batch(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.list_(pa.int64()))],
                names=["key", "start", "words", "seeds"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, work, "key long, start long, words binary, seeds array<bigint>")


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: its value, and the first and one past the last word of the passage in it."""
    n = len(passage)
    steps = -GAP * np.arange(n + 1)
    above, from_above = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        value, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        slant = above[:-1] + np.where(passage == word, MATCH, MISMATCH)
        drop = above[1:] + GAP
        use = slant >= drop
        value[1:] = np.maximum(0, np.where(use, slant, drop))
        start[1:] = np.where(value[1:] > 0, np.where(use, from_above[:-1], from_above[1:]), start[1:])
        lifted = value + steps  # gaps along the passage: a running maximum
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, np.arange(n + 1), 0))
        along = run - steps
        better = along > value
        value = np.where(better, along, value)
        start = np.where(better, start[source], start)
        top = int(value.argmax())
        if value[top] > best[0]:
            best = (int(value[top]), int(start[top]), top)
        above, from_above = value, start
    return best


def _aligned(pairs: DataFrame) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for raw, item in zip(batch.column("words").to_pylist(), batch.column("item_words").to_pylist()):
            item = np.frombuffer(item, np.uint64)
            value, start, end = align(item, np.frombuffer(raw, np.uint64))
            out.append((value / (MATCH * len(item)), start, end))
        columns = list(zip(*out))
        yield pa.record_batch(
            [
                batch.column("key"), batch.column("item_id"), pa.array(columns[0], pa.float64()),
                pa.array([a + s for a, s in zip(batch.column("start").to_pylist(), columns[1])], pa.int64()),
                pa.array([a + s for a, s in zip(batch.column("start").to_pylist(), columns[2])], pa.int64()),
            ],
            names=["key", "item_id", "score", "first_word", "end_word"],
        )

    return map_arrow(
        pairs.select("key", "item_id", "start", "words", "item_words"), work,
        "key long, item_id long, score double, first_word long, end_word long",
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", min_score: float = MIN_SCORE) -> DataFrame:
    """``(key, item_id, score, first_word, end_word)`` of every item that a document holds, word positions in the document."""
    items = settle(item_words(benchmark), "leak_items")
    grams = settle(item_grams(items), "leak_grams")
    blocks = max(1, -(-grams.count() * 2 // BLOCK_SEEDS))  # half filled, as the hash spreads unevenly
    found = None
    for block in range(blocks):
        part = grams.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        words = np.sort(np.array([r[0] for r in part.select(F.explode("parts")).distinct().collect()], np.int64).view(np.uint64))
        counts = settle(word_counts(docs, words), "leak_words")
        seeds = settle(rare_seeds(part, counts), "leak_seeds")
        known = np.sort(np.array([r[0] for r in seeds.select("seed").distinct().collect()], np.int64).view(np.uint64))
        if not len(known):
            continue
        longest = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).agg(F.max("n")).first()[0]
        near = passages(docs, key, known, int(longest)).withColumn("place", F.xxhash64("key", "start", "words"))
        near = settle(near, "leak_passages")
        hits = near.select("place", F.explode("seeds").alias("seed")).join(seeds, "seed").select("place", "item").distinct()
        chosen = near.select("place", "key", "start", "words").dropDuplicates(["place"]).join(hits, "place")
        pairs = chosen.join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
        scored = _aligned(pairs).where(F.col("score") >= min_score)
        found = scored if found is None else found.unionByName(scored)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"{key} long, item_id long, score double, first_word long, end_word long")
    best = found.groupBy("key", "item_id").agg(F.max(F.struct("score", (-F.col("first_word")).alias("f"), "end_word")).alias("b"))
    return best.select(
        F.col("key").alias(key), "item_id", F.col("b.score").alias("score"), (-F.col("b.f")).alias("first_word"), F.col("b.end_word").alias("end_word")
    )


def remove_leaking(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents that hold no item; rows are told apart by id and text."""
    content, name = F.xxhash64(F.col("doc_id"), F.col("text")), free_name(docs, "_content")
    bad = settle(find_leaks(docs.select(content.alias(name), "text"), benchmark, name, min_score).select(name).distinct(), "leaking")
    kept = docs.withColumn(name, content).join(small_side(bad, bad.count(), 24), name, "left_anti")
    return kept.select(docs.columns)


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark"))
