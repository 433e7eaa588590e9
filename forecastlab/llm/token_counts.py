"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

Pre-tokens are the units that no vocabulary piece reaches across: a run of letters or of other signs with
the spaces before it as word marks, or a line break; a text starts with one word mark. Distinct pre-tokens go into a trie;
the best score and token count of a prefix is computed when its node is made, so pre-tokens that share a
prefix share that work, and the node where a pre-token ends holds its count. Each Python worker keeps one
trie; when it reaches its node limit it is started anew, which costs time and changes no result.

A character outside the vocabulary costs one token per UTF-8 byte. Of equal scores the longer last piece
wins. Null and empty texts have 0 tokens; every row of the table gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from forecastlab.llm.common import hold, id_text, map_arrow, table
from forecastlab.llm.registry import query
from forecastlab.llm.sentence_pieces import joined_pairs, word_pattern
from forecastlab.llm.vocabulary import MODEL_PATH, SPACE, UNKNOWN_SCORE, load_pieces, piece_scores
from forecastlab.llm.wordhash import slices

MAX_NODES = 600_000


class PrefixTrie:
    """Forward scores of all prefixes of the inserted pre-tokens."""

    def __init__(self, scores: dict[str, tuple[float, int]], max_nodes: int = MAX_NODES):
        self.scores: dict[str, float | None] = {}  # None: only the end of pieces
        for piece in scores:
            for start in range(1, len(piece)):
                self.scores.setdefault(piece[start:], None)
        for piece, (value, _) in scores.items():
            self.scores[piece] = value
        self.max_nodes = max_nodes
        self.terminal = {}
        self.reset()

    def reset(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best: list[tuple[float, int]] = [(0.0, 0)]
        self.older = self.terminal  # results of the trie before this one
        self.terminal: dict[str, tuple[float, int]] = {}

    def extend(self, word: str, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        """Best ``(score, tokens)`` of ``word[:end]`` from those of its shorter prefixes."""
        find = self.scores.get
        high = float("-inf")
        tokens = 0
        for start in range(end - 1, -1, -1):
            known = find(word[start:end], 0)
            if known:
                before = path[start]
                if before[0] + known >= high:
                    high = before[0] + known
                    tokens = before[1] + 1
            elif known == 0:  # no piece ends like this
                break
        char, before = word[end - 1], path[end - 1]
        if before[0] + UNKNOWN_SCORE > high and not find(char):
            return before[0] + UNKNOWN_SCORE, before[1] + len(char.encode("utf-8", "surrogatepass"))
        return high, tokens

    def insert(self, word: str) -> tuple[float, int]:
        """``(score, tokens)`` of a whole pre-token, computing only the prefixes not seen yet."""
        if len(self.best) + len(word) > self.max_nodes and len(self.best) > 1:
            self.reset()
        node, depth, child, best = 0, 0, self.child, self.best
        path = [best[0]]
        for char in word:
            depth += 1
            below = child.get((node, char))
            if below is None:
                below = len(best)
                best.append(self.extend(word, depth, path))
                child[node, char] = below
            path.append(best[below])
            node = below
        return path[-1]

    def count(self, words: list[str]) -> tuple[int, float]:
        tokens, total = 0, 0.0
        for word in words:
            found = self.terminal.get(word)
            if found is None:
                found = self.older.get(word)
                if found is None:
                    found = self.insert(word.replace(" ", SPACE))
                self.terminal[word] = found
            total += found[0]
            tokens += found[1]
        return tokens, total


def token_counts(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens, score)`` of every whole text; ``score`` is the log probability of its best segmentation."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path)[0])  # bounded: one vocabulary file

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        trie = hold("token_counts", path, lambda: PrefixTrie(piece_scores(shared.value)))
        words = word_pattern(joined_pairs(shared.value)).findall
        for start, rows in slices(batch.column("text")):
            counted = []
            for text in rows.to_pylist():
                units = words(" " + text) if text else []
                counted.append((len(units), *trie.count(units)))
            columns = list(zip(*counted))
            yield pa.record_batch(
                [
                    batch.column("doc_id").slice(start, len(rows)),
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()),
                ],
                names=["doc_id", "n_pretokens", "n_tokens", "score"],
            )

    return map_arrow(id_text(docs), work, "doc_id long, n_pretokens long, n_tokens long, score double")


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
