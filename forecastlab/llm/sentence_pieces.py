"""Encoding into SentencePiece ids by a streaming Viterbi search, and decoding.

The search goes through the characters once. It keeps scores for a window of the longest piece's length
and backpointers up to the last committed boundary: whenever the paths of all positions in the window
lead back to one boundary, the ids before it are final and leave. No piece holds a line break or a space
after another character, so every word start is such a boundary; words are therefore searched apart and
the ids of recent distinct words are kept (a bounded cache per task).

A text is its characters with one word mark in front and every space as a word mark; characters outside the vocabulary become byte ids. Decoding gives back the exact text. Null and empty texts have no
ids (both decode to the empty text); every row of the table gives one row.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from forecastlab.llm.common import held, hold, id_text, map_arrow, table
from forecastlab.llm.registry import query
from forecastlab.llm.vocabulary import MODEL_PATH, SPACE, UNKNOWN_SCORE, load_pieces, piece_scores
from forecastlab.llm.wordhash import slices

CACHE_WORDS = 250_000
_WORD = re.compile(" *[^ \n]+| +|\n")
_LETTERS = re.compile(" *[A-Za-zÀ-ÖØ-öø-ɏ]+| *[^A-Za-zÀ-ÖØ-öø-ɏ \n]+| +|\n")
_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")
_LOW = float("-inf")
_NOWHERE = (-1, ())


class StreamingViterbi:
    """Best segmentation of a stream of characters; ids leave as soon as they are certain."""

    def __init__(self, scores: dict[str, tuple[float, int]], first_byte: int):
        self.pieces: dict[str, tuple | None] = {}  # None: only the beginning of pieces
        for piece, (score, number) in scores.items():
            for end in range(1, len(piece)):
                self.pieces.setdefault(piece[:end], None)
            self.pieces[piece] = (score, number, (number,))
        self.longest = max(map(len, scores), default=1)
        self.first_byte = first_byte
        self.restart()

    def restart(self) -> None:
        self.text = ""  # characters from the committed boundary on
        self.done = 0  # of them, those whose edges have been followed
        self.best: list[float] = [0.0]  # by position; only the window is read
        self.back: list[tuple[int, tuple[int, ...]]] = [(-1, ())]

    def follow(self, upto: int) -> None:
        """Follow the edges out of positions before ``upto``. A later, equal path loses: the longer last piece wins."""
        text, best, back, find = self.text, self.best, self.back, self.pieces.get
        n = len(text)
        more = n + 1 - len(best)
        if more > 0:
            best.extend([_LOW] * more)
            back.extend([_NOWHERE] * more)
        for start in range(self.done, upto):
            here = best[start]
            single = False
            for end in range(start + 1, n + 1):
                value = find(text[start:end], 0)
                if value:
                    if end == start + 1:
                        single = True
                    if here + value[0] > best[end]:
                        best[end] = here + value[0]
                        back[end] = (start, value[2])
                elif value == 0:  # no piece goes on like this
                    break
            if not single and here + UNKNOWN_SCORE > best[start + 1]:
                best[start + 1] = here + UNKNOWN_SCORE
                back[start + 1] = (start, tuple(self.first_byte + b for b in text[start].encode("utf-8", "surrogatepass")))
        if upto > self.done:
            self.done = upto

    def path(self, end: int) -> list[int]:
        """The ids from the committed boundary to ``end``."""
        parts = []
        while end > 0:
            end, ids = self.back[end]
            parts.append(ids)
        return [i for ids in reversed(parts) for i in ids]

    def converged(self) -> int:
        """The last boundary that the paths of all reached, not yet followed positions share."""
        ends = {e for e in range(self.done, len(self.best)) if self.best[e] > _LOW}
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(self.back[top][0])
        return ends.pop() if ends else 0

    def feed(self, chars: str) -> list[int]:
        """Take more characters and return the ids that no later character can change."""
        out: list[int] = []
        for at in range(0, len(chars), self.longest):
            self.text += chars[at : at + self.longest]
            self.follow(max(self.done, len(self.text) - self.longest))
            cut = self.converged()
            if cut > 0:
                out += self.path(cut)
                self.text, self.done = self.text[cut:], self.done - cut
                self.best = self.best[cut:]
                self.back = [(start - cut, ids) for start, ids in self.back[cut:]]
                self.back[0] = (-1, ())
        return out

    def finish(self) -> list[int]:
        self.follow(len(self.text))
        out = self.path(len(self.text))
        self.restart()
        return out

    def encode(self, chars: str) -> list[int]:
        if len(chars) > self.longest:
            return self.feed(chars) + self.finish()
        self.text = chars  # it fits the window
        return self.finish()


def joined_pairs(pieces: tuple[str, ...]) -> set[str]:
    """Pairs of characters that stand together in some piece."""
    return {p[k : k + 2] for p in (piece.replace(SPACE, " ") for piece in pieces) for k in range(len(p) - 1)}


def word_pattern(joined: set[str]) -> re.Pattern:
    """Units that no piece reaches across; runs of letters stand alone if no piece joins them to other characters."""
    mixed = any(a != " " and bool(_LETTER.match(a)) != bool(_LETTER.match(b)) for a, b in joined)
    return _WORD if mixed else _LETTERS


class Encoder(dict):
    """Ids of words as int32 bytes, found by the search on first sight. When full, the cache becomes the older half of the next."""

    def __init__(self, pieces: tuple[str, ...], first_byte: int):
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.search = StreamingViterbi(piece_scores(pieces), first_byte)
        self.joined = joined_pairs(pieces)
        self.words = word_pattern(self.joined).findall

    def __missing__(self, word: str) -> bytes:
        """Ids of a word not seen lately; a place whose two characters stand together in no piece parts it."""
        ids = self.older.get(word)
        if ids is not None:
            self[word] = ids
            return ids
        joined = self.joined
        cuts = [k for k, pair in enumerate(map(add, word, word[1:]), 1) if pair not in joined]
        if cuts:
            ids = b"".join([self[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)])])
        else:
            ids = array("i", self.search.encode(word.replace(" ", SPACE))).tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.words(" " + text))) if text else b""


class Decoder:
    """Bytes of every id in one array, so that a text is one gather."""

    def __init__(self, pieces: tuple[str, ...], first_byte: int):
        raw = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in pieces]
        for b in range(256 if first_byte >= 0 else 0):
            raw[first_byte + b] = bytes([b])
        self.size = np.array([len(r) for r in raw], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, without the word mark in front."""
        size = self.size[ids]
        shift = np.repeat(self.start[ids] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        out = self.data[shift + np.arange(len(shift))].tobytes().decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def _coders(path: str, model) -> tuple[Encoder, Decoder]:
    return hold("sentence_pieces", path, lambda: (Encoder(*model), Decoder(*model)))


def encode(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """``(doc_id, n_ids, ids, round_trip)`` of every whole text; ``round_trip`` tells that decoding gives it back."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))  # bounded: one vocabulary file

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _coders(path, shared.value)
        for start, rows in slices(batch.column("text")):
            texts = rows.to_pylist()
            found = [encoder.encode(text) for text in texts]
            ids = np.frombuffer(b"".join(found), dtype=np.int32)
            ends = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])])
            same = [decoder.decode(ids[a:b]) == text for text, a, b in zip(texts, ends[:-1], ends[1:])]
            yield pa.record_batch(
                [
                    batch.column("doc_id").slice(start, len(rows)),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(same, pa.bool_()),
                ],
                names=["doc_id", "n_ids", "ids", "round_trip"],
            )

    def done() -> None:
        """Forget the words seen; the tables of the model stay."""
        for encoder, _ in filter(None, [held("sentence_pieces", path)]):
            encoder.older = {}
            encoder.clear()

    return map_arrow(id_text(docs), work, "doc_id long, n_ids long, ids array<int>, round_trip boolean", done)


def decode(encoded: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """``(doc_id, text)`` from the ids; null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_pieces(path))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        decoder = _coders(path, shared.value)[1]
        texts = [decoder.decode(np.array(ids or [], dtype=np.int64)) for ids in batch.column("ids").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), work, "doc_id long, text string")


@query("op10_sentence_pieces")
def op10_sentence_pieces(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))
