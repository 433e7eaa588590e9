"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding maps look-alike letters of other scripts and digits that stand for letters to one form. Lexicon
entries are whole words and word beginnings with a weight: the lower confidence bound of the log odds of
the entry between toxic and other labelled texts. A token counts with its heaviest entry; a hit inside an
exception phrase doesn't count. The weights of a text are read as the largest one, their sum, and their
sum per hundred words, and a logistic curve makes these a probability.

Labels are read from training rows only: three folds give the lexicon, another one the curve. The rows
are a bounded sample, chosen by a hash of the id (``MAX_LABELLED``), and the lexicon has at most
``MAX_ENTRIES`` entries, the heaviest first. Null and empty texts get the score of a text without hits. Of contradicting labels of one
document the more frequent one counts, 1 where both are as frequent.
Without usable labels every score is 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecastlab.llm.common import bounded_sample, fold, held_out, hold, id_text, map_arrow, one_label, table
from forecastlab.llm.registry import query
from forecastlab.llm.wordhash import slices
from forecastlab.session import settle

MAX_LABELLED = 20_000
MAX_ENTRIES = 3_000
MIN_TOXIC = 3
MIN_WEIGHT = 1.0
PREFIX_LENGTHS = (4, 5, 6, 8)
CALIBRATION_FOLD = 4
# Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "recycle or trash", "clown fish", "clown college", "pond scum")

# Letters that look like Latin ones, and digits and signs used for letters. l and i share a form because 1 stands for either.
_LOOKS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "һ": "h", "ӏ": "i", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "i", "ø": "o", "l": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
_HIDDEN = "­​‌‍⁠﻿"
_TABLE = str.maketrans({**_LOOKS, **dict.fromkeys(_HIDDEN)})
_TOKEN = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """One form for spellings that look alike."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(_TABLE)


class Model(NamedTuple):
    """``entries``: (text, is a whole word, weight); ``curve``: intercept and three slopes."""

    entries: tuple[tuple[str, bool, float], ...]
    curve: tuple[float, float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    """Automaton over entries and exception phrases."""

    def __init__(self, model: Model):
        import ahocorasick

        found: dict[str, list] = {}
        for text, whole, weight in model.entries:
            found.setdefault(text, [0.0, 0.0, False])[0 if whole else 1] = weight
        for phrase in model.exceptions:
            found.setdefault(folded(phrase), [0.0, 0.0, False])[2] = True
        self.machine = ahocorasick.Automaton()
        for text, (whole, prefix, phrase) in found.items():
            self.machine.add_word(text, (len(text), whole, prefix, phrase))
        self.machine.make_automaton()
        self.empty = not found
        self.curve = model.curve

    def weights(self, text: str) -> list[float]:
        """The weight of every matched token."""
        if self.empty:
            return []
        tokens: dict[int, tuple[float, int]] = {}
        spared: list[tuple[int, int]] = []
        for last, (size, whole, prefix, phrase) in self.machine.iter(text):
            start = last - size + 1
            if start and text[start - 1].isalnum():
                continue
            ends = last + 1 == len(text) or not text[last + 1].isalnum()
            if phrase and ends:
                spared.append((start, last))
            weight = max(prefix, whole if ends else 0.0)
            if weight > tokens.get(start, (0.0, 0))[0]:
                tokens[start] = (weight, last)
        return [
            weight for start, (weight, last) in tokens.items()
            if not any(a <= start and last <= b for a, b in spared)
        ]

    def features(self, text: str) -> tuple[float, float, float]:
        text = folded(text)
        weights = self.weights(text)
        if not weights:
            return 0.0, 0.0, 0.0
        total = sum(weights)
        return max(weights), math.log1p(total), 100.0 * total / (50.0 + text.count(" "))

    def score(self, text: str) -> float:
        z = self.curve[0] + sum(c * x for c, x in zip(self.curve[1:], self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _patterns(text: str) -> set[str]:
    """Words (ending in a blank) and word beginnings of a folded text."""
    out = set()
    for word in set(_TOKEN.findall(text)):
        if len(word) >= 3:
            out.add(word + " ")
            out.update(word[:n] for n in PREFIX_LENGTHS if n <= len(word))
    return out


def count_patterns(sample: DataFrame) -> DataFrame:
    """``(pattern, n_toxic, n_clean)`` over texts, added up inside a batch before the shuffle."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        labels = batch.column("toxic").to_pylist()
        for start, rows in slices(batch.column("text"), 8 << 20):
            counts = (Counter(), Counter())
            for label, text in zip(labels[start:], rows.to_pylist()):
                counts[label].update(_patterns(folded(text)))
            names = list(counts[0] | counts[1])
            yield pa.record_batch(
                [pa.array(names, pa.string())] + [pa.array([c[name] for name in names], pa.int64()) for c in (counts[1], counts[0])],
                names=["pattern", "n_toxic", "n_clean"],
            )

    counted = map_arrow(sample.select("toxic", "text"), work, "pattern string, n_toxic long, n_clean long")
    return counted.groupBy("pattern").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def fit_lexicon(sample: DataFrame) -> tuple[tuple[str, bool, float], ...]:
    """The heaviest entries; ``sample`` has ``text`` and ``toxic``."""
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return ()
    a, b = F.col("n_toxic") + 0.5, F.col("n_clean") + 0.5
    odds = F.log(a / (toxic + 1.0)) - F.log(b / (clean + 1.0))
    weight = odds - 1.64 * F.sqrt(1 / a + 1 / b)
    rows = (
        count_patterns(sample).where(F.col("n_toxic") >= MIN_TOXIC).select("pattern", weight.alias("weight"))
        .where(F.col("weight") >= MIN_WEIGHT).orderBy(F.desc("weight"), "pattern").limit(MAX_ENTRIES).collect()
    )
    return tuple((r["pattern"].rstrip(" "), r["pattern"].endswith(" "), float(r["weight"])) for r in rows)


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 40) -> tuple[float, ...]:
    """Logistic regression by Newton steps on a bounded sample, with a small ridge on the slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [penalty] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn lexicon and curve from the training rows of ``labels``."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # Bounded by max_labelled, hence the broadcast: the texts stay where they are.
    chosen = F.broadcast(bounded_sample(one_label(known, "toxic"), max_labelled))
    sample = settle(id_text(docs).join(chosen, "doc_id"), "toxic_sample")
    part = fold(F.col("doc_id"))
    entries = fit_lexicon(sample.where(part != CALIBRATION_FOLD))
    draft = Model(entries, (0.0, 0.0, 0.0, 0.0))
    rows = _features(sample.where(part == CALIBRATION_FOLD), draft).collect()
    if len({r["toxic"] for r in rows}) < 2:
        return Model(entries, (-4.0, 0.8, 0.5, 0.0) if entries else (-30.0, 0.0, 0.0, 0.0))
    x = np.array([r["x"] for r in rows])
    return Model(entries, fit_curve(x, np.array([r["toxic"] for r in rows], dtype=float)))


def _matcher(model: Model) -> Matcher:
    return hold("toxicity", zlib.crc32(repr(model).encode()), lambda: Matcher(model))


def _features(sample: DataFrame, model: Model) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(model)
        x = [list(matcher.features(text or "")) for text in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    return map_arrow(sample.select(F.col("toxic").cast("int").alias("toxic"), "text"), work, "toxic int, x array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_ENTRIES

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared.value)
        for start, rows in slices(batch.column("text")):
            scores = [matcher.score(text) for text in rows.to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id").slice(start, len(rows)), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    return map_arrow(id_text(docs), work, "doc_id long, score double")


def keep_harmless(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared.value)
        for start, rows in slices(batch.column("text")):
            good = pa.array([matcher.score(text) < threshold for text in rows.to_pylist()], pa.bool_())
            yield batch.slice(start, len(rows)).filter(good)

    return map_arrow(docs, work, docs.schema)


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
