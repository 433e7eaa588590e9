"""Stupid-backoff language-model scores from n-gram count tables partitioned by hash.

The corpus is its own model, and a document is scored with its own counts taken out, so what it gets
stems from the others (copies of it included). With ``c`` the counts of all other documents, the score
of a word is ``c(context word) / c(context)`` for the longest context whose n-gram others have, times
``BACKOFF`` for every word the context was shortened by; alone it is its share of all words, and
half an occurrence if no other document has it. A document gets the sum and the mean of the logarithms.

Documents are cut into blocks of a bounded number of words, kept as word numbers with a word table. Each block
sends its distinct n-grams with counts to the hash partitions, one row per block and partition, where the
count tables come about, and gets the totals back in the order asked; so a frequent n-gram is one entry per
block, wherever it stands. The join back and the sums per document happen block by block. The number of
partitions follows the words; no table or vocabulary passes through the driver.

A null text counts as empty; a document without words has 0 words, sum 0 and a null mean. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecastlab.llm.common import id_text, pack, table, unpack
from forecastlab.llm.registry import query
from forecastlab.llm.wordhash import gram_hash, slices, words_of
from forecastlab.session import scratch_path, settle

ORDER = 2
BACKOFF = 0.4
BLOCK_WORDS = 1_500_000
GRAMS_PER_PART = 2_000_000


def word_blocks(docs: DataFrame) -> DataFrame:
    """``(block, ids, sizes, vocabulary, numbers)``: documents of about ``BLOCK_WORDS`` words, as word numbers.

    The block's name is the row's place in the table that is written, so it is fixed with it.
    """

    def block(ids, sizes, parts) -> pa.RecordBatch:
        vocabulary, numbers, many = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        order = np.argsort(-many, kind="stable")  # frequent words get small numbers, which pack better
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        return pa.record_batch(
            [
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([vocabulary[order].tobytes()], pa.binary()),
                pa.array([pack(place[numbers].astype(np.uint32))], pa.binary()),
            ],
            names=["ids", "sizes", "vocabulary", "numbers"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, parts, total = [], [], [], 0
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for first, rows in slices(batch.column("text")):
                words, bounds = words_of(rows)
                ids += keys[first : first + len(rows)]
                sizes += np.diff(bounds).tolist()
                parts.append(words)
                total += len(words)
                if total >= BLOCK_WORDS:
                    yield block(ids, sizes, parts)
                    ids, sizes, parts, total = [], [], [], 0
        if ids:
            yield block(ids, sizes, parts)

    packed = id_text(docs).mapInArrow(work, "ids array<bigint>, sizes array<bigint>, vocabulary binary, numbers binary")
    path = scratch_path(docs.sparkSession, "word_blocks")
    packed.withColumn("block", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def ngrams(words: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of one order inside documents, and the positions where they end."""
    if order == 1:
        return words, np.arange(len(words))
    at = np.arange(len(words)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    ends = np.flatnonzero(at >= order - 1)
    return gram_hash(words, order)[ends - order + 1], ends


def _block(batch: pa.RecordBatch | pa.Table, row: int) -> tuple[list, np.ndarray, np.ndarray]:
    vocabulary = np.frombuffer(batch.column("vocabulary")[row].as_py(), np.uint64)
    numbers = unpack(batch.column("numbers")[row].as_py(), np.uint32)
    return batch.column("ids")[row].as_py(), np.array(batch.column("sizes")[row].as_py(), np.int64), vocabulary[numbers]


def _ranges(grams: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the hash partitions in sorted n-grams."""
    edges = np.array([-(-(k << 64) // parts) for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])


def requests(blocks: DataFrame, order: int, parts: int) -> DataFrame:
    """``(part, block, size, grams, counts)``: a block's distinct n-grams by hash partition, sorted, with their counts in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, sizes, words = _block(batch, row)
                for size in range(1, order + 1):
                    grams, counts = np.unique(ngrams(words, sizes, size)[0], return_counts=True)
                    bounds = _ranges(grams, parts)
                    kept = [k for k in range(parts) if bounds[k + 1] > bounds[k]]
                    yield pa.record_batch(
                        [
                            pa.array(kept, pa.int32()),
                            pa.array([batch.column("block")[row].as_py()] * len(kept), pa.int64()),
                            pa.array([size] * len(kept), pa.int32()),
                            # Steps between sorted hashes are smaller numbers than the hashes.
                            pa.array([pack(np.diff(grams[bounds[k] : bounds[k + 1]], prepend=np.uint64(0))) for k in kept], pa.binary()),
                            pa.array([pack(counts[bounds[k] : bounds[k + 1]].astype(np.uint32)) for k in kept], pa.binary()),
                        ],
                        names=["part", "block", "size", "grams", "counts"],
                    )

    return blocks.mapInArrow(work, "part int, block long, size int, grams binary, counts binary")


def _total(group: pa.Table) -> pa.Table:
    """One partition's count table of one order, given back to the blocks in the order in which they asked."""
    asked = [np.cumsum(unpack(g.as_py(), np.uint64), dtype=np.uint64) for g in group.column("grams")]
    counts = np.concatenate([unpack(c.as_py(), np.uint32) for c in group.column("counts")])
    _, place = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(place, weights=counts).astype(np.int64)[place]
    wide = np.uint32 if totals.max(initial=0) < 2**32 else np.uint64
    ends = np.cumsum([0] + [len(a) for a in asked])
    return pa.table(
        {
            "block": group.column("block"),
            "part": group.column("part"),
            "size": group.column("size"),
            "totals": pa.array([pack(totals[a:b].astype(wide)) for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
            "wide": pa.array([wide == np.uint64] * len(asked), pa.bool_()),
        }
    )


def count_tables(asked: DataFrame) -> DataFrame:
    """``(block, part, size, totals, wide)``: the corpus totals of every block's n-grams."""
    return asked.groupBy("part", "size").applyInArrow(_total, "block long, part int, size int, totals binary, wide boolean")


def score_block(ids: list, sizes: np.ndarray, words: np.ndarray, totals: dict[int, np.ndarray], all_words: int, order: int) -> pa.Table:
    """Sums per document; ``totals`` has the corpus counts of the sorted distinct n-grams of each order."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    others = np.maximum(1, all_words - sizes)[doc].astype(np.float64)
    value, length = np.zeros(len(words)), np.ones(len(words), np.int64)
    before = None  # by position: other documents' count of the n-gram of the last order that ends there
    for size in range(1, order + 1):
        grams, ends = ngrams(words, sizes, size)
        kinds, place = np.unique(grams, return_inverse=True)
        # A document's own count: n-grams are numbered by (document, kind).
        own = doc[ends] * len(kinds) + place
        rest = totals[size][place].astype(np.int64) if len(place) else np.zeros(0, np.int64)
        del grams, kinds, place
        _, where, many = np.unique(own, return_inverse=True, return_counts=True)
        rest -= many[where]
        del own, where, many
        left = np.zeros(len(words), np.int64)
        left[ends] = rest
        if size == 1:
            value = np.log(np.maximum(left, 0.5) / others) if len(words) else value
        else:
            seen = ends[rest > 0]
            value[seen] = np.log(left[seen] / before[seen - 1])
            length[seen] = size
        before = left
    position = np.arange(len(words)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(words) else np.zeros(0, np.int64)
    value = value + np.log(BACKOFF) * (np.minimum(order, position + 1) - length)
    sums = np.bincount(doc, weights=value, minlength=len(sizes)) if len(words) else np.zeros(len(sizes))
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_words": pa.array(sizes, pa.int64()),
            "log_score": pa.array(sums, pa.float64()),
            "mean_log_score": pa.array([s / n if n else None for s, n in zip(sums.tolist(), sizes.tolist())], pa.float64()),
        }
    )


def backoff_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(doc_id, n_words, log_score, mean_log_score)`` of every whole text."""
    blocks = word_blocks(docs)
    all_words = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = max(1, -(-all_words // GRAMS_PER_PART))
    replies = settle(count_tables(requests(blocks, order, parts)), "gram_totals")

    def work(key: tuple, block: pa.Table, reply: pa.Table) -> pa.Table:
        ids, sizes, words = _block(block, 0)
        rows = sorted(zip(reply.column("size").to_pylist(), reply.column("part").to_pylist(), range(reply.num_rows)))
        totals = {}
        for size in range(1, order + 1):
            own = [
                unpack(reply.column("totals")[r].as_py(), np.uint64 if reply.column("wide")[r].as_py() else np.uint32)
                for s, _, r in rows if s == size
            ]
            totals[size] = np.concatenate(own) if own else np.zeros(0, np.int64)
        return score_block(ids, sizes, words, totals, all_words, order)

    return (
        blocks.groupBy("block").cogroup(replies.groupBy("block"))
        .applyInArrow(work, "doc_id long, n_words long, log_score double, mean_log_score double")
    )


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
q AS (SELECT r, i, word, lag(word) OVER (PARTITION BY r ORDER BY i) AS prev FROM p),
u AS (SELECT word, count(*) AS n FROM p GROUP BY 1),
ud AS (SELECT r, word, count(*) AS n FROM p GROUP BY 1, 2),
b AS (SELECT prev, word, count(*) AS n FROM q WHERE prev IS NOT NULL GROUP BY 1, 2),
bd AS (SELECT r, prev, word, count(*) AS n FROM q WHERE prev IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT count(*) AS n FROM p),
s AS (
  SELECT q.r,
         CASE WHEN b.n - bd.n > 0 THEN ln((b.n - bd.n)::DOUBLE / (uc.n - udc.n))
              ELSE ln(greatest(u.n - ud.n, 0.5)::DOUBLE / greatest(1, a.n - len(d.w))) + CASE WHEN q.prev IS NULL THEN 0 ELSE ln({BACKOFF}::DOUBLE) END END AS v
  FROM q JOIN d USING (r) CROSS JOIN a
  JOIN u ON u.word = q.word JOIN ud ON ud.r = q.r AND ud.word = q.word
  LEFT JOIN b ON b.prev = q.prev AND b.word = q.word LEFT JOIN bd ON bd.r = q.r AND bd.prev = q.prev AND bd.word = q.word
  LEFT JOIN u uc ON uc.word = q.prev LEFT JOIN ud udc ON udc.r = q.r AND udc.word = q.prev
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(coalesce(sum(s.v), 0), 4) AS log_score,
       round(sum(s.v) / nullif(len(d.w), 0), 6) AS mean_log_score
FROM d LEFT JOIN s USING (r) GROUP BY d.r, d.doc_id, d.w
"""


@query("op8_backoff", SQL)
def op8_backoff(spark, sf_dir):
    scored = backoff_scores(table(spark, sf_dir, "documents"))
    return scored.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


TRIGRAM_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
q AS (
  SELECT r, i, word, lag(word) OVER (PARTITION BY r ORDER BY i) AS prev, lag(word, 2) OVER (PARTITION BY r ORDER BY i) AS first FROM p
),
u AS (SELECT word, count(*) AS n FROM p GROUP BY 1),
ud AS (SELECT r, word, count(*) AS n FROM p GROUP BY 1, 2),
b AS (SELECT prev, word, count(*) AS n FROM q WHERE prev IS NOT NULL GROUP BY 1, 2),
bd AS (SELECT r, prev, word, count(*) AS n FROM q WHERE prev IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT first, prev, word, count(*) AS n FROM q WHERE first IS NOT NULL GROUP BY 1, 2, 3),
td AS (SELECT r, first, prev, word, count(*) AS n FROM q WHERE first IS NOT NULL GROUP BY 1, 2, 3, 4),
a AS (SELECT count(*) AS n FROM p),
s AS (
  SELECT q.r,
         CASE WHEN t.n - td.n > 0 THEN ln((t.n - td.n)::DOUBLE / (bc.n - bdc.n))
              ELSE CASE WHEN q.first IS NULL THEN 0 ELSE ln({BACKOFF}::DOUBLE) END
                 + CASE WHEN b.n - bd.n > 0 THEN ln((b.n - bd.n)::DOUBLE / (uc.n - udc.n))
                        ELSE ln(greatest(u.n - ud.n, 0.5)::DOUBLE / greatest(1, a.n - len(d.w))) + CASE WHEN q.prev IS NULL THEN 0 ELSE ln({BACKOFF}::DOUBLE) END END END AS v
  FROM q JOIN d USING (r) CROSS JOIN a
  JOIN u ON u.word = q.word JOIN ud ON ud.r = q.r AND ud.word = q.word
  LEFT JOIN b ON b.prev = q.prev AND b.word = q.word LEFT JOIN bd ON bd.r = q.r AND bd.prev = q.prev AND bd.word = q.word
  LEFT JOIN u uc ON uc.word = q.prev LEFT JOIN ud udc ON udc.r = q.r AND udc.word = q.prev
  LEFT JOIN t ON t.first = q.first AND t.prev = q.prev AND t.word = q.word
  LEFT JOIN td ON td.r = q.r AND td.first = q.first AND td.prev = q.prev AND td.word = q.word
  LEFT JOIN b bc ON bc.prev = q.first AND bc.word = q.prev LEFT JOIN bd bdc ON bdc.r = q.r AND bdc.prev = q.first AND bdc.word = q.prev
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(coalesce(sum(s.v), 0), 4) AS log_score,
       round(sum(s.v) / nullif(len(d.w), 0), 6) AS mean_log_score
FROM d LEFT JOIN s USING (r) GROUP BY d.r, d.doc_id, d.w
"""


@query("op8_backoff_trigrams", TRIGRAM_SQL)
def op8_backoff_trigrams(spark, sf_dir):
    scored = backoff_scores(table(spark, sf_dir, "documents"), 3)
    return scored.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})
