"""Alignment of two tokenizers over the same bytes, and how often aligned ids meet across the corpus.

A text is encoded by both tokenizers; their tokens cover the same bytes. ``pandas.merge_asof``, keyed by document, finds for the start of each token
the other side's token that covers it; both directions together give every pair of tokens that overlap. Places where tokens of both sides
end cut a text into groups.

Texts go through in blocks. A block keeps its distinct id pairs once, with the number of its documents that hold them, and each document's pairs as places in that list.
Blocks ask hash partitions of the pairs for corpus totals: a pair that is in every document is one number per block there. The
highest count by id is bounded by the vocabulary; it alone goes through the driver.

A null or empty text, and one whose tokens don't give back its bytes on both sides (signs that a tokenizer rewrites), has no tokens: all its
figures are 0 and its groups empty. Special tokens' strings inside texts are plain text. Each row of the table gives one row, repeated rows and null ids too, and
counts as a document of its own; of equally frequent partners all are best ones. An empty table gives no rows. Very long texts are blocks of their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecastlab.llm.common import id_text, map_arrow, pack, table, unpack
from forecastlab.llm.registry import query
from forecastlab.llm.vocabulary import MODEL_PATH, SPACE
from forecastlab.llm.wordhash import mix, slices
from forecastlab.session import scratch_path, settle

BYTE_BPE_PATH = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK_BYTES = 1 << 20
PAIRS_PER_PART = 2_000_000
#: How byte-level vocabularies part texts before merging; fixed by the file format.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[str, int]:
    """The byte behind each sign of a byte-level vocabulary: printable bytes are themselves, others come from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """A byte-level BPE vocabulary file; ids are the order of the merges, so the ids themselves are the ranks."""

    def __init__(self, raw: bytes):
        import tiktoken

        told = json.loads(raw)
        parting = told["pre_tokenizer"] or {}
        if told["normalizer"] or parting.get("type") != "ByteLevel" or parting["add_prefix_space"] or not parting["use_regex"]:
            raise ValueError("not a plain byte-level vocabulary")
        special = {t["content"] for t in told["added_tokens"]}
        signs = byte_signs()
        ranks = {bytes(signs[c] for c in word): i for word, i in told["model"]["vocab"].items() if word not in special}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            self.bytes[i] = word
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class PieceBpe:
    """A SentencePiece model; it puts the space before the text itself."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _sides(byte_raw: bytes, piece_raw: bytes) -> tuple:
    """Both encoders with the length of each token and its id as text behind each separator; once per worker."""
    made = []
    for side in (ByteBpe(byte_raw), PieceBpe(piece_raw)):
        lengths = np.array([len(b) for b in side.bytes], np.int64)
        names = np.array([[f"{s}{i}" for i in range(len(side.bytes))] for s in ",|;"], dtype=object)
        made.append((side, lengths, names))
    return tuple(made)


def encode_both(sides: tuple, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
    """The ids of both sides; no ids for a text that either side doesn't give back."""
    named = [k for k, t in enumerate(texts) if t]
    ids: list[list[list[int]]] = []
    for side, _, _ in sides:
        found = side.encode([texts[k] for k in named])
        own: list[list[int]] = [[] for _ in texts]
        for k, i in zip(named, found):
            own[k] = i
        ids.append(own)
    for k in named:
        whole = (" " + texts[k]).encode()
        if any(b"".join([side.bytes[i] for i in own[k]]) != whole for (side, _, _), own in zip(sides, ids)):
            ids[0][k], ids[1][k] = [], []
    return ids[0], ids[1]


class Tokens:
    """One side's tokens of a block of documents, one after the other."""

    def __init__(self, ids: list[list[int]], lengths: np.ndarray):
        self.sizes = np.array([len(i) for i in ids], np.int64)
        self.ids = np.fromiter(chain.from_iterable(ids), np.int64, int(self.sizes.sum()))
        self.doc = np.repeat(np.arange(len(ids)), self.sizes)
        self.ends = np.cumsum(lengths[self.ids]) if len(self.ids) else np.zeros(0, np.int64)
        self.starts = self.ends - lengths[self.ids] if len(self.ids) else np.zeros(0, np.int64)


def covering(tokens: Tokens, others: Tokens) -> np.ndarray:
    """For the start of each token the place of the other side's token that covers it."""
    starts = pd.DataFrame({"at": tokens.starts, "doc": tokens.doc})
    cover = pd.DataFrame({"at": others.starts, "doc": others.doc, "place": np.arange(len(others.starts))})
    return pd.merge_asof(starts, cover, on="at", by="doc", direction="backward")["place"].to_numpy(np.int64)


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of tokens whose bytes overlap: one of both starts inside the other."""
    over_a, over_b = covering(a, b), covering(b, a)
    later = a.starts[over_b] < b.starts  # equal starts are in the first direction already
    return np.concatenate([np.arange(len(a.ids)), over_b[later]]), np.concatenate([over_a, np.flatnonzero(later)])


def groups(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends that both sides share, and the group of each token."""
    shared = np.intersect1d(a.ends, b.ends, assume_unique=True)
    return shared, np.searchsorted(shared, a.ends), np.searchsorted(shared, b.ends)


def group_texts(a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray, names_a, names_b) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` per document: ids of the first side, then of the second, group by group."""
    key = np.concatenate([group_a * 2, group_b * 2 + 1])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.diff(key, prepend=-1) != 0
    mark = np.where(first, np.where(key & 1, 1, 2), 0)  # the first id of a group, of its second side, or neither
    side = order >= len(a.ids)
    ids = np.concatenate([a.ids, b.ids])[order]
    told = np.empty(len(ids), dtype=object)
    told[~side] = names_a[mark[~side], ids[~side]]
    told[side] = names_b[mark[side], ids[side]]
    words = told.tolist()
    bounds = np.concatenate([[0], np.cumsum(a.sizes + b.sizes)]).tolist()
    return ["".join(words[x:y])[1:] for x, y in zip(bounds[:-1], bounds[1:])]


BLOCK = "ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>, pairs binary, holders binary, held binary, places binary, times binary, n_pairs long"
ID_BITS = 32


def block_of(sides: tuple, keys: list, texts: list[str]) -> tuple:
    """A block's row: figures per document, its distinct pairs, and which of them each document links how often."""
    ids_a, ids_b = encode_both(sides, texts)
    a, b = Tokens(ids_a, sides[0][1]), Tokens(ids_b, sides[1][1])
    n = len(keys)
    if len(a.ids):
        left, right = overlaps(a, b)
    else:
        left = right = np.zeros(0, np.int64)
    shared, group_a, group_b = groups(a, b)
    told = group_texts(a, b, group_a, group_b, sides[0][2], sides[1][2])
    last = np.searchsorted(a.ends, shared)  # the token of the first side that ends a group
    doc = a.doc[left]
    pairs, place = np.unique(a.ids[left] << ID_BITS | b.ids[right], return_inverse=True)
    own, times = np.unique(doc * max(1, len(pairs)) + place, return_counts=True)
    place, doc_of = own % max(1, len(pairs)), own // max(1, len(pairs))
    return (
        keys, a.sizes.tolist(), b.sizes.tolist(), np.bincount(a.doc[last], minlength=n).tolist(), np.bincount(doc, minlength=n).tolist(),
        [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in told],
        pack(np.diff(pairs, prepend=np.int64(0))),
        pack(np.bincount(place, minlength=len(pairs)).astype(np.uint32)),
        pack(np.bincount(doc_of, minlength=n).astype(np.uint32)),
        pack(np.diff(place, prepend=np.int64(0)).astype(np.int32)),
        pack(times.astype(np.uint32)),
        len(pairs),
    )


def _batch(rows: list[tuple], columns: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    told = [c.split(" ") for c in columns.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(told)], names=[name for name, _ in told])


def _files(spark, byte_path: str, piece_path: str):
    """Both vocabulary files, a few megabytes, for the executors."""
    raw = []
    for path in (byte_path, piece_path):
        with open(path, "rb") as file:
            raw.append(file.read())
    return spark.sparkContext.broadcast(tuple(raw))


def token_blocks(docs: DataFrame, byte_path: str = BYTE_BPE_PATH, piece_path: str = MODEL_PATH) -> DataFrame:
    """The written blocks of :func:`block_of`, numbered by ``block``."""
    files = _files(docs.sparkSession, byte_path, piece_path)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = batch.column("doc_id").to_pylist()
        for first, rows in slices(batch.column("text"), BLOCK_BYTES):
            yield _batch([block_of(_sides(*files.value), keys[first : first + len(rows)], rows.to_pylist())], BLOCK)

    path = scratch_path(docs.sparkSession, "token_blocks")
    blocks = map_arrow(id_text(docs), work, BLOCK).withColumn("block", F.monotonically_increasing_id())
    blocks.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _by_part(pairs: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a block's pairs by hash partition, by pair inside, and the bounds of the partitions."""
    part = (mix(pairs.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def requests(blocks: DataFrame, parts: int) -> DataFrame:
    """``(part, block, pairs, holders)``: each block's distinct pairs and their documents in it, by hash partition."""
    columns = "part int, block long, pairs binary, holders binary"

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            pairs, holders = np.cumsum(unpack(row["pairs"], np.int64)), unpack(row["holders"], np.uint32)
            order, bounds = _by_part(pairs, parts)
            pairs, holders = pairs[order], holders[order]
            asked = [
                (k, row["block"], pack(np.diff(pairs[x:y], prepend=np.int64(0))), pack(holders[x:y]))
                for k, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if y > x
            ]
            if asked:
                yield _batch(asked, columns)

    return map_arrow(blocks.select("block", "pairs", "holders"), work, columns)


TOTALS = "part int, block long, totals binary, ids array<bigint>, highest array<bigint>"


def _total(group: pa.Table) -> pa.Table:
    """A partition's corpus counts, given back to the blocks in their order, and its highest count by id in a row without a block."""
    asked = [np.cumsum(unpack(p.as_py(), np.int64)) for p in group.column("pairs")]
    holders = np.concatenate([unpack(h.as_py(), np.uint32) for h in group.column("holders")])
    pairs, place = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.bincount(place, weights=holders).astype(np.int64)
    totals, ends = counts[place], np.cumsum([0] + [len(x) for x in asked]).tolist()
    ids, first = np.unique(pairs >> ID_BITS, return_index=True)
    part = group.column("part")[0].as_py()
    rows = [(part, block, pack(totals[x:y]), None, None) for block, x, y in zip(group.column("block").to_pylist(), ends[:-1], ends[1:])]
    return pa.Table.from_batches([_batch([*rows, (part, None, None, ids.tolist(), np.maximum.reduceat(counts, first).tolist())], TOTALS)])


def highest_counts(replies: DataFrame) -> np.ndarray:
    """The highest count by id of the first side, at most one number per entry of its vocabulary."""
    each = replies.where(F.col("block").isNull()).select(F.explode(F.arrays_zip("ids", "highest")).alias("x"))
    rows = each.groupBy(F.col("x.ids").alias("id")).agg(F.max("x.highest").alias("most")).toPandas()
    found = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    found[rows["id"].to_numpy(np.int64)] = rows["most"].to_numpy(np.int64)
    return found


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def align(docs: DataFrame, byte_path: str = BYTE_BPE_PATH, piece_path: str = MODEL_PATH) -> DataFrame:
    """Per document the tokens, groups and links of its alignment and the corpus counts of its links."""
    spark = docs.sparkSession
    blocks = token_blocks(docs, byte_path, piece_path)
    parts = max(1, -(-(blocks.agg(F.sum("n_pairs")).first()[0] or 0) // PAIRS_PER_PART))
    replies = settle(requests(blocks, parts).groupBy("part").applyInArrow(_total, TOTALS), "pair_totals")
    most = spark.sparkContext.broadcast(highest_counts(replies))

    def work(key: tuple, block: pa.Table, reply: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        pairs = np.cumsum(unpack(row["pairs"], np.int64))
        order, _ = _by_part(pairs, parts)
        totals = np.zeros(len(pairs), np.int64)
        told = sorted((r["part"], r["totals"]) for r in reply.to_pylist())
        if told:
            totals[order] = np.concatenate([unpack(t, np.int64) for _, t in told])
        held, times = unpack(row["held"], np.uint32), unpack(row["times"], np.uint32).astype(np.int64)
        place = np.cumsum(unpack(row["places"], np.int32), dtype=np.int64)
        doc = np.repeat(np.arange(len(held)), held)
        best = totals == most.value[pairs >> ID_BITS] if len(pairs) else np.zeros(0, bool)
        sums, bests = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        np.add.at(sums, doc, times * totals[place])
        np.add.at(bests, doc, times * best[place])
        names = [c.split(" ")[0] for c in ALIGNED.split(", ")]
        columns = [row["ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], bests, sums, row["digests"]]
        return pa.table([pa.array(c, pa.string() if name == "groups_sha256" else pa.int64()) for c, name in zip(columns, names)], names=names)

    own = blocks.drop("holders", "n_pairs")
    return own.groupBy("block").cogroup(replies.where(F.col("block").isNotNull()).select("block", "part", "totals").groupBy("block")).applyInArrow(work, ALIGNED)


GROUP = "doc_id bigint, start bigint, end bigint, a_ids array<bigint>, b_ids array<bigint>"


def token_groups(docs: DataFrame, byte_path: str = BYTE_BPE_PATH, piece_path: str = MODEL_PATH) -> DataFrame:
    """``(doc_id, start, end, a_ids, b_ids)``: one row per group, with its bytes in the text after a space."""
    files = _files(docs.sparkSession, byte_path, piece_path)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = batch.column("doc_id").to_pylist()
        for first, rows in slices(batch.column("text"), BLOCK_BYTES):
            sides = _sides(*files.value)
            ids_a, ids_b = encode_both(sides, rows.to_pylist())
            a, b = Tokens(ids_a, sides[0][1]), Tokens(ids_b, sides[1][1])
            shared, _, _ = groups(a, b)
            cut_a, cut_b = np.searchsorted(a.ends, shared), np.searchsorted(b.ends, shared)
            doc = a.doc[cut_a]
            starts = np.concatenate([[0], shared[:-1]]) if len(shared) else shared
            opening = np.flatnonzero(np.diff(doc, prepend=-1))
            base = np.repeat(starts[opening], np.diff(np.append(opening, len(doc))))
            lists = [pa.ListArray.from_arrays(np.append(0, cut + 1).astype(np.int32), pa.array(t.ids)) for cut, t in ((cut_a, a), (cut_b, b))]
            own = [keys[first + d] for d in doc.tolist()]
            yield pa.record_batch([pa.array(own, pa.int64()), starts - base, shared - base, *lists], names=["doc_id", "start", "end", "a_ids", "b_ids"])

    return map_arrow(id_text(docs), work, GROUP)


@query("op12_alignment")
def op12_alignment(spark, sf_dir):
    return align(table(spark, sf_dir, "documents"))
