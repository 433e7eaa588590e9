"""Secret spans: fixed patterns, and credential values that are costly to guess.

Patterns give the kinds ``assign``, ``access`` and ``hex``. The guess-cost search looks at every value in
credential context (a wider list of names and of characters than ``assign``), splits it at least cost into
dictionary words, dates, repeats, keyboard walks and brute-force spans, and adds a ``guess`` span for a
value whose cheapest split still needs ``10 ** MIN_LOG_GUESSES`` guesses; an unexplained character counts by its class, so eight mixed
ones are enough. The search is linear in the
value's length, so values are never cut. Spans count code points, ends are exclusive.

A null or empty text has no spans, and the digest is that of the empty text. Every row gives one row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecastlab.llm.common import hold, id_text, map_arrow, table
from forecastlab.llm.registry import query
from forecastlab.llm.vocabulary import MODEL_PATH, SPACE, load_pieces
from forecastlab.llm.wordhash import slices

KINDS = ("assign", "access", "hex", "guess")
BASE_KINDS = KINDS[:3]
# The patterns of the base kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|bearer)"""
    r"""["']?\x20*[:=]\x20*["']?([^\s"'<>,;]{8,})""",
    re.IGNORECASE | re.ASCII,
)
MIN_LOG_GUESSES = 10.0

ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
LEET = dict(zip("013457@$", "oieastas"))
DATE = re.compile(
    r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)"
)
LOG_DAYS, LOG_YEARS = math.log10(365), math.log10(120)
#: Signs an unexplained character may be, by its class: digits, small letters, letters of either case, anything that is typed.
DIGIT, SMALL, LETTER, ANY = 10, 26, 52, 94
SEGMENT = math.log10(2)  # of one more segment
WALK_START, WALK_TURN = math.log10(47), math.log10(4.6)


def brute_cost(char: str) -> float:
    """log10 guesses of one unexplained character."""
    return math.log10(DIGIT if "0" <= char <= "9" else SMALL if "a" <= char <= "z" else LETTER if "A" <= char <= "Z" else ANY)


def _key_places() -> dict[str, tuple[int, int]]:
    return {char: (row, column) for row, keys in enumerate(ROWS) for column, char in enumerate(keys)}


_PLACES = _key_places()


def _step(a: str, b: str) -> tuple[int, int] | None:
    """Direction from one key to a neighbouring one; each row is shifted by half a key."""
    one, two = _PLACES.get(SHIFTED.get(a, a)), _PLACES.get(SHIFTED.get(b, b))
    if one is None or two is None:
        return None
    step = (two[0] - one[0], two[1] - one[1])
    return step if step in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)) else None


class GuessCost:
    """Minimum-cost segmentation of one value; costs are log10 of guesses and add up along the value."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)

    def word(self, chunk: str, plain: str, low: str) -> float | None:
        """Rank of a dictionary word, with the variants that capitals and digit substitutions add."""
        rank = self.ranks.get(plain)
        if rank is None:
            return None
        cost = math.log10(rank + 1)
        capitals = sum(c.isupper() for c in chunk)
        if capitals:
            cost += math.log10(2) if chunk[0].isupper() and capitals == 1 or capitals == len(chunk) else 0.3 * capitals
        return cost + math.log10(2) * sum(a != b for a, b in zip(low, plain))

    def segments(self, value: str) -> Iterator[tuple[int, int, float]]:
        """``(start, end, cost)`` of all explained spans."""
        low = value.lower()
        if len(low) != len(value):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = "".join(LEET.get(c, c) for c in low)
        n = len(value)
        for start in range(n):
            for end in range(start + 3, min(n, start + self.longest) + 1):
                costs = [
                    cost for form in {plain[start:end], low[start:end]}
                    if (cost := self.word(value[start:end], form, low[start:end])) is not None
                ]
                if costs:
                    yield start, end, min(costs)
            found = DATE.match(value, start)
            if found:
                yield start, found.end(), (LOG_YEARS if found.end() - start == 4 else LOG_DAYS + LOG_YEARS)
        for size in range(1, 9):  # repeats of units of up to eight characters, as maximal runs
            start = 0
            while start + 2 * size <= n:
                end = start + size
                while end < n and value[end] == value[end - size]:
                    end += 1
                times = (end - start) // size
                if times >= 2 and times * size >= 3:
                    yield start, start + times * size, sum(map(brute_cost, value[start : start + size])) + math.log10(times)
                start = max(start + 1, end - size + 1)
        start = 0
        while start < n - 2:  # keyboard walks, as maximal runs
            end, turns, direction = start + 1, 0, None
            while end < n and (step := _step(low[end - 1], low[end])) is not None:
                turns += step != direction
                direction = step
                end += 1
            if end - start >= 3:
                yield start, end, WALK_START + turns * WALK_TURN + math.log10(end - start)
            start = end

    def log_guesses(self, value: str) -> float:
        """log10 of the guesses that the cheapest segmentation needs."""
        n = len(value)
        closing: dict[int, list[tuple[int, float]]] = {}
        for start, end, cost in self.segments(value):
            closing.setdefault(end, []).append((start, cost))
        best = [0.0] + [math.inf] * n  # cost up to here
        brute = [math.inf] * (n + 1)  # the same with an open brute-force span at the end
        for end in range(1, n + 1):
            brute[end] = min(brute[end - 1], best[end - 1] + SEGMENT) + brute_cost(value[end - 1])
            best[end] = min([brute[end]] + [best[start] + cost + SEGMENT for start, cost in closing.get(end, ())])
        return max(0.0, best[n] - SEGMENT) if n else 0.0


def dictionary(pieces: tuple[str, ...]) -> dict[str, int]:
    """Word ranks: whole-word entries of a public vocabulary file in its order, three letters or more."""
    words = [p[1:].lower() for p in pieces if p.startswith(SPACE) and len(p) > 3 and p[1:].isalpha()]
    return {word: rank for rank, word in enumerate(dict.fromkeys(["password", "admin", "letmein", "welcome", *words]))}


def find_spans(text: str, costs: GuessCost) -> tuple[list[tuple[int, int, int]], float]:
    """All spans as sorted ``(start, kind, end)`` and the largest guess cost of a credential value."""
    spans, most = [], 0.0
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
        for m in CONTEXT.finditer(text):
            cost = costs.log_guesses(m[1])
            most = max(most, cost)
            if cost >= MIN_LOG_GUESSES:
                spans.append((m.start(1), 3, m.end(1)))
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans), most


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _searcher(path: str, pieces: tuple[str, ...]) -> GuessCost:
    return hold("secrets", path, lambda: GuessCost(dictionary(pieces)))


def find_secrets(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans, largest guess cost."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path)[0])  # bounded: one vocabulary file

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        costs = _searcher(path, shared.value)
        for start, rows in slices(batch.column("text")):
            out = []
            for text in rows.to_pylist():
                spans, most = find_spans(text, costs)
                base = [s for s in spans if s[1] < len(BASE_KINDS)]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((*(sum(s[1] == k for s in spans) for k in range(len(KINDS))), digest, joined(spans), most))
            columns = list(zip(*out))
            yield pa.record_batch(
                [batch.column("doc_id").slice(start, len(rows))]
                + [pa.array(columns[k], pa.int64()) for k in range(4)]
                + [pa.array(columns[4], pa.string()), pa.array(columns[5], pa.string()), pa.array(columns[6], pa.float64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "max_log10_guesses"],
            )

    return map_arrow(
        id_text(docs), work,
        "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, max_log10_guesses double",
    )


def redact(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """The documents with every secret span replaced; rows and columns stay, ``n_chars`` follows the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path)[0])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        costs = _searcher(path, shared.value)
        at = batch.schema.get_field_index("text")
        for start, rows in slices(batch.column(at)):
            part = batch.slice(start, len(rows))
            texts = [None if t is None else redacted(t, find_spans(t, costs)[0]) for t in part.column(at).to_pylist()]
            yield part.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = map_arrow(docs, work, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn(
            "n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        )
    return out


@query("op3_secrets")
def op3_secrets(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))
