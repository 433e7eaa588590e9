"""Extendible hashing of documents into shards under a byte limit.

A directory is indexed by the leading bits of the hash of the key. A bucket over the limit splits on one
more bit, others stay. The splits are found from one histogram: bytes are summed per fine cell (a few
cells per expected shard), rolled up to every shorter prefix, and the shard of a cell is its shortest prefix within the
limit. Cells that are over the limit themselves get a second histogram of their rows alone, by all bits of the hash; so where
a row goes does not depend on how fine the cells are. Rows that no bit can part (one huge document, one key repeated) go to
overflow pages of their bucket: a document over half the limit has a page of its own, others fill pages in running order.

Null keys hash as the empty text, a null or empty text has 0 bytes, repeated rows count each, an empty
table gives no rows. Only a single document larger than the limit makes a shard larger than it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from forecastlab.llm.common import free_name, table
from forecastlab.llm.registry import query
from forecastlab.session import settle

HASH_BITS = 32
CELLS_PER_SHARD_BITS = 5
LIMIT_BYTES = 1 << 20


def hash_code(key) -> F.Column:
    """The leading ``HASH_BITS`` bits of the key's MD5 as a non-negative number."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def directory(cells: DataFrame, bits: int, limit: int, above: int = 0) -> DataFrame:
    """``(cell, depth, cell_bytes)``: the number of bits (``above`` or more) that the cell's shard uses, null where even all ``bits`` don't suffice."""
    levels = cells.select("cell", F.col("cell_bytes"), F.explode(F.sequence(F.lit(above), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    full = levels.groupBy("depth", "prefix").agg(F.sum("cell_bytes").alias("bytes"))
    fits = levels.join(full.where(F.col("bytes") <= limit), ["depth", "prefix"], "left")
    return fits.groupBy("cell").agg(
        F.min(F.when(F.col("bytes").isNotNull(), F.col("depth"))).alias("depth"), F.max("cell_bytes").alias("cell_bytes")
    )


def overflow_pages(rows: DataFrame, limit: int) -> DataFrame:
    """Number the pages of buckets that no bit can split; each running sum is over about one limit of bytes."""
    half = limit // 2
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # rows are read from a settled table
    lanes = F.greatest(F.lit(1), F.ceil(F.col("cell_bytes") / limit))
    rows = rows.withColumn("_lane", F.pmod(F.xxhash64("_row"), lanes)).withColumn("_large", F.col("n_bytes") > half)
    order = Window.partitionBy("cell", "_lane", "_large").orderBy("_row")
    return rows.withColumn(
        "page",
        F.concat_ws(
            "-",
            F.when(F.col("_large"), F.lit("L")).otherwise(F.lit("P")),
            F.col("_lane").cast("string"),
            F.when(F.col("_large"), F.row_number().over(order)).otherwise(F.floor(F.sum("n_bytes").over(order) / half)).cast("string"),
        ),
    ).drop("_row", "_lane", "_large")


def assign_shards(docs: DataFrame, limit: int = LIMIT_BYTES, key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_bytes, depth, shard)``: the shard is the bits of its prefix, with a page after ``/`` on overflow."""
    rows = settle(
        docs.select(
            F.col("doc_id"),
            F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long").alias("n_bytes"),
            hash_code(F.col(key)).alias("code"),
        ),
        "shard_rows",
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, CELLS_PER_SHARD_BITS + math.ceil(math.log2(max(1, total / limit))))
    rows = rows.withColumn("cell", F.shiftright("code", HASH_BITS - bits))
    plain, over = by_directory(rows, bits, limit)
    if over is not None and bits < HASH_BITS:
        parted, over = by_directory(over.withColumn("cell", F.col("code")), HASH_BITS, limit, bits + 1)
        plain = plain.unionByName(parted)
    placed = plain.withColumn("page", F.lit(None).cast("string"))
    if over is not None:
        placed = placed.unionByName(overflow_pages(over, limit).withColumn("depth", F.lit(HASH_BITS)))
    prefix = F.expr(f"lpad(bin(shiftright(code, {HASH_BITS} - depth)), depth, '0')")
    return placed.select(
        "doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), F.concat_ws("/", prefix, F.col("page")).alias("shard")
    )


def by_directory(rows: DataFrame, bits: int, limit: int, above: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """Rows with the depth of their cell's shard, and the rows of cells that ``bits`` don't suffice for, None where there are none."""
    cells = settle(rows.groupBy("cell").agg(F.sum("n_bytes").alias("cell_bytes")), "shard_cells")
    shards = settle(directory(cells, bits, limit, above), "shard_directory")
    rows = rows.drop("depth", "cell_bytes").join(shards, "cell")
    over = shards.where(F.col("depth").isNull())
    return rows.where(F.col("depth").isNotNull()), None if over.isEmpty() else rows.where(F.col("depth").isNull())


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write the documents as one folder per shard, named by the column ``shard`` or, where the documents have that, ``shard_``.

    Documents must have distinct, non-null ids here. The one shard of a table within the limit, which has no bits, is named ``all``.
    """
    name = free_name(docs, "shard")
    shards = assign_shards(docs, limit).select("doc_id", F.when(F.col("shard") == "", "all").otherwise(F.col("shard")).alias(name))
    docs.join(shards, "doc_id").repartition(name).write.partitionBy(name).parquet(path)


# The histogram's depth follows the total, as in assign_shards; a shorter prefix of a cell is a division.
SQL = f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS code
  FROM documents
),
levels AS (SELECT unnest(range(0, {HASH_BITS} + 1)) AS depth),
b AS (
  SELECT depth, code >> ({HASH_BITS} - depth) AS prefix, sum(n_bytes) AS bytes
  FROM d, levels GROUP BY 1, 2
),
leaf AS (
  SELECT d.code, min(b.depth) AS depth
  FROM (SELECT DISTINCT code FROM d) d, b
  WHERE b.prefix = d.code >> ({HASH_BITS} - b.depth) AND b.bytes <= {LIMIT_BYTES}
  GROUP BY 1
)
SELECT doc_id, n_bytes, leaf.depth::INTEGER AS depth,
       CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(bin(d.code >> ({HASH_BITS} - leaf.depth)), leaf.depth::INTEGER, '0') END AS shard
FROM d JOIN leaf USING (code)
"""


@query("op9_sharding", SQL)
def op9_sharding(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"))
