"""Exact Jaccard self-join of word-shingle sets with a token-group matrix, and its connected classes.

Sets are sorted 64-bit shingle hashes; equal sets are one entity from the start, so copies never pair up. A
link needs an overlap of at least 80 % of either set. Everything that prunes rests on that, for all
sets and with no caps:

1. *Shared tokens.* In hash order, the first tokens of two linked sets (a fifth plus a margin) share at
   least the margin. Tokens are dealt by hash range, packed per batch, and the tokens of each set that
   some other set has too are counted. Sets with too few of them link with nothing. What is left goes through the same count
   with all its tokens.
2. *Groups.* Remaining sets are partitioned by min-hash into bounded groups; large ones are dealt by hash, with
   another min-hash in each round. Members of a group are compared all with all as a small matrix
   product, and join into components early.
3. *Token-group matrix.* Only sets whose tokens suffice in *other* components go on. They are partitioned into bounded
   groups of one min-hash, which store their token union; a set's rarest tokens find groups, the overlap with the whole union
   bounds what any member can have, and only groups that reach the least overlap are opened. Of two components the smaller one asks.

A document with fewer than five words has the whole sequence as its only shingle; without words, or with a null text, it
has none, links with nothing and is its own class. Every row gives one row; rows with equal ids count as
links of one class only through their texts. Null ids take part; a class without any id has a null one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forecastlab.llm.common import free_name, id_text, small_side, start_empty, table
from forecastlab.llm.components import connected
from forecastlab.llm.registry import query
from forecastlab.llm.wordhash import mix, shingle_sets
from forecastlab.session import settle

WORDS = 5
PERCENT = 80
MARGIN_PERCENT = 15
TOKENS_PER_PART = 500_000  # counted as dealt, copies of a set in other batches included
TOKENS_PER_ROW = 20_000
SETS_PER_LOT = 100_000  # whose counts are added up at a time
LANES = 8  # of a part's tokens, one sorted at a time; a power of two
GROUP = 192  # members compared all with all
ROUNDS = 3
MATRIX_GROUP = 64  # members under one token union
ASKING = 512  # sets that ask a group at one time
TILE = 4096


def least_overlap(n):
    """Tokens that a set of ``n`` shares with any set it links with: ``ceil(0.8 n)``; numbers, arrays or columns."""
    return -(-n * PERCENT // 100)


def margin(n):
    return n * MARGIN_PERCENT // 100 + 1


def prefix_length(n):
    return np.minimum(n, n - least_overlap(n) + margin(n))


def _sql_least(n: str) -> str:
    return f"(({n}) * {PERCENT} + 99) div 100"


def _sql_margin(n: str) -> str:
    return f"(({n}) * {MARGIN_PERCENT} div 100 + 1)"


def signature(tokens: np.ndarray) -> int:
    """64 bits for a whole set."""
    if not len(tokens):
        return 0
    both = np.array([np.bitwise_xor.reduce(tokens), tokens.sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)
    return int(mix(mix(both) * np.array([3, 1], np.uint64)).sum(dtype=np.uint64).view(np.int64))


def content_key() -> F.Column:
    """Rows of one id and text are the same document."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def set_rows(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, n, sig)`` of every row; ``sig`` is null for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_empty()
        for batch in batches:
            n, sig = [], []
            for tokens in shingle_sets(batch.column("text"), WORDS):
                n.append(len(tokens))
                sig.append(signature(tokens) if len(tokens) else None)
            yield pa.record_batch(
                [batch.column("key"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.int64())], names=["key", "doc_id", "n", "sig"]
            )

    return id_text(docs).withColumn("key", content_key()).mapInArrow(work, "key long, doc_id long, n long, sig long")


def full_sets(docs: DataFrame) -> DataFrame:
    """``(sig, n, tokens)`` with the sorted tokens as bytes; empty sets are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_empty()
        for batch in batches:
            found = [t for t in shingle_sets(batch.column("text"), WORDS) if len(t)]
            for at in range(0, len(found), 512):
                part = found[at : at + 512]
                yield pa.record_batch(
                    [
                        pa.array([signature(t) for t in part], pa.int64()),
                        pa.array([len(t) for t in part], pa.int64()),
                        pa.array([t.tobytes() for t in part], pa.binary()),
                    ],
                    names=["sig", "n", "tokens"],
                )

    return docs.select("text").mapInArrow(work, "sig long, n long, tokens binary")


_DEALT = "part int, tokens binary, sigs binary, owners binary, counts binary"


def _deal(sets: list[tuple[int, int, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Tokens of ``(sig, owner, sorted tokens)`` by hash range: in a part, a set's id stands once before its tokens.

    A row has about ``TOKENS_PER_ROW`` tokens, as the JVM takes much more memory for rows of megabytes.
    """
    filled = np.cumsum([0] + [len(t) for _, _, t in sets])
    bound = parts * TOKENS_PER_ROW
    start = 0
    while start < len(sets):
        stop = max(start + 1, int(np.searchsorted(filled, filled[start] + bound, side="right")) - 1)
        yield from _deal_some(sets[start:stop], parts)
        start = stop


def _deal_some(sets: list[tuple[int, int, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    tokens = np.concatenate([t for _, _, t in sets])
    which = np.repeat(np.arange(len(sets)), [len(t) for _, _, t in sets])
    part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    tokens, which, part = tokens[order], which[order], part[order]
    sigs = np.array([s for s, _, _ in sets], np.int64)
    owners = np.array([o for _, o, _ in sets], np.int64)
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    rows: list[list] = [[], [], [], [], []]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        runs = np.flatnonzero(np.r_[True, which[a + 1 : b] != which[a : b - 1], True])
        first = which[a:b][runs[:-1]]
        made = int(part[a]), tokens[a:b].tobytes(), sigs[first].tobytes(), owners[first].tobytes(), np.diff(runs).astype(np.uint32).tobytes()
        for column, cell in zip(rows, made):
            column.append(cell)
    kinds = pa.int32(), *[pa.binary()] * 4
    yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, kinds)], names=["part", "tokens", "sigs", "owners", "counts"])


def _count_shared(group: pa.Table, lots: int) -> pa.Table:
    """``(lot, sigs, shared)``: how many tokens of this hash range each set has that a set of another owner has too, packed by lots of sets.

    A set may have such tokens in many ranges, so these counts are not a row each. The range is gone through in lanes of tokens, so that only a part of it is sorted at a time.
    """
    columns = [
        [np.frombuffer(v.as_buffer(), kind) for v in group.column(name)]
        for name, kind in (("tokens", np.uint64), ("sigs", np.int64), ("owners", np.int64), ("counts", np.uint32))
    ]
    found = []
    for lane in range(LANES):
        parts = []
        for tokens, sigs, owners, counts in zip(*columns):
            at = np.flatnonzero((tokens & np.uint64(LANES - 1)) == np.uint64(lane))
            row = np.searchsorted(np.cumsum(counts), at, side="right")
            parts.append((tokens[at], sigs[row], owners[row]))
        tokens, sigs, owners = (np.concatenate(p) for p in zip(*parts))
        del parts
        if not len(tokens):
            continue
        order = np.lexsort((sigs, tokens))
        tokens, sigs, owners = tokens[order], sigs[order], owners[order]
        once = np.r_[True, (tokens[1:] != tokens[:-1]) | (sigs[1:] != sigs[:-1])]  # a set may come from several batches
        tokens, sigs, owners = tokens[once], sigs[once], owners[once]
        starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        several = np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts)
        found.append(np.unique(sigs[np.repeat(several, np.diff(np.r_[starts, len(tokens)]))], return_counts=True))
    sigs = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    names, place = np.unique(sigs, return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([f[1] for f in found])) if len(sigs) else np.zeros(0)
    pa.default_memory_pool().release_unused()  # the worker goes on to other parts
    return pa.table(_by_lot(names, total.astype(np.uint32), lots))


def _by_lot(sigs: np.ndarray, shared: np.ndarray, lots: int) -> dict[str, pa.Array]:
    """Sorted sets and their counts as one row per lot."""
    lot = ((mix(sigs.view(np.uint64)) >> np.uint64(32)) * np.uint64(lots) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(lot, kind="stable")
    sigs, shared, lot = sigs[order], shared[order], lot[order]
    edges = np.flatnonzero(np.r_[True, lot[1:] != lot[:-1], True]) if len(lot) else np.zeros(1, np.int64)
    runs = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return {
        "lot": pa.array([int(lot[a]) for a, _ in runs], pa.int32()),
        "sigs": pa.array([sigs[a:b].tobytes() for a, b in runs], pa.binary()),
        "shared": pa.array([shared[a:b].tobytes() for a, b in runs], pa.binary()),
    }


def _add_shared(group: pa.Table) -> pa.Table:
    """``(sig, shared)`` of one lot of sets, over all hash ranges."""
    sigs, shared = (np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in group.column(name)]) for name, kind in (("sigs", np.int64), ("shared", np.uint32)))
    names, place = np.unique(sigs, return_inverse=True)
    total = np.bincount(place, weights=shared).astype(np.int64)
    return pa.table({"sig": pa.array(names, pa.int64()), "shared": pa.array(total, pa.int64())})


def _with_enough(dealt: DataFrame, sizes: DataFrame, least: str) -> DataFrame:
    """The ``(sig, n)`` of ``sizes`` whose count of shared tokens reaches ``least`` of ``n``."""
    lots = max(1, -(-sizes.count() // SETS_PER_LOT))
    packed = dealt.groupBy("part").applyInArrow(lambda group: _count_shared(group, lots), "lot int, sigs binary, shared binary")
    shared = packed.groupBy("lot").applyInArrow(_add_shared, "sig long, shared long")
    return shared.join(sizes, "sig").where(f"shared >= {least}").select("sig", "n")


def _parts(tokens: int) -> int:
    return max(1, -(-int(tokens or 0) // TOKENS_PER_PART))


def sharing_documents(docs: DataFrame, sizes: DataFrame, rows: DataFrame) -> DataFrame:
    """Step 1 over the documents: ``(sig, n)`` of sets whose first tokens are shared often enough; ``rows`` has every document's ``n``."""
    parts = _parts(rows.agg(F.sum(F.expr(f"least(n, n - {_sql_least('n')} + {_sql_margin('n')})"))).first()[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_empty()
        for batch in batches:
            sets, seen = [], set()
            for tokens in shingle_sets(batch.column("text"), WORDS):
                sig = signature(tokens)
                if len(tokens) and sig not in seen:
                    seen.add(sig)
                    sets.append((sig, sig, tokens[: int(prefix_length(len(tokens)))]))
            yield from _deal(sets, parts)

    dealt = docs.select("text").mapInArrow(work, _DEALT)
    return _with_enough(dealt, sizes, _sql_margin(_sql_least("n")))


def sharing_sets(sets: DataFrame) -> DataFrame:
    """``(sig, n)`` of sets that have enough tokens in common with sets of other owners; all tokens count."""
    parts = _parts(sets.agg(F.sum("n")).first()[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_empty()
        for batch in batches:
            rows = zip(batch.column("sig").to_pylist(), batch.column("owner").to_pylist(), batch.column("tokens").to_pylist())
            yield from _deal([(sig, owner, np.frombuffer(tokens, np.uint64)) for sig, owner, tokens in rows], parts)

    dealt = sets.select("sig", "owner", "tokens").mapInArrow(work, _DEALT)
    return _with_enough(dealt, sets.select("sig", "n"), _sql_least("n"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as a matrix product over tiles of the tokens that two sets share."""
    tokens = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = n[at] > 1
    at, who = at[keep], who[keep]
    at = np.unique(at, return_inverse=True)[1] if len(at) else at
    total = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, TILE):
        a, b = np.searchsorted(at, (low, low + TILE))
        tile = np.zeros((len(sets), TILE), np.float32)
        tile[who[a:b], at[a:b] - low] = 1
        total += tile @ tile.T
    return total.astype(np.int64)


def _link_group(group: pa.Table) -> pa.Table:
    """Links of a bounded group: each member of a component with its smallest member."""
    sigs = np.array(group.column("sig").to_pylist(), np.int64)
    sets = [np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()]
    n = np.array([len(s) for s in sets])
    both = overlaps(sets)
    linked = 100 * both >= PERCENT * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(linked, True)
    root = np.arange(len(sigs))
    while True:  # each round takes the smallest label among linked members
        best = np.where(linked, root[None, :], len(sigs)).min(axis=1)
        best = best[best]
        if (best == root).all():
            break
        root = best
    move = root != np.arange(len(sigs))
    return pa.table({"a": pa.array(sigs[move]), "b": pa.array(sigs[root[move]])})


def group_links(sets: DataFrame) -> DataFrame:
    """Step 2: links inside bounded groups of sets with an equal min-hash, over several min-hashes."""
    seeds = [np.uint64(0xA0761D6478BD642F * (2 * r + 1) & (2**64 - 1)) for r in range(ROUNDS)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_empty()
        for batch in batches:
            tokens = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
            keys = [pa.array([int(mix(t ^ seed).min().view(np.int64)) for t in tokens], pa.int64()) for seed in seeds]
            yield pa.record_batch([batch.column("sig"), batch.column("tokens"), *keys], names=["sig", "tokens", *[f"k{r}" for r in range(ROUNDS)]])

    keyed = settle(
        sets.select("sig", "tokens").mapInArrow(work, "sig long, tokens binary, " + ", ".join(f"k{r} long" for r in range(ROUNDS))), "near_keys"
    )
    links = None
    for r in range(ROUNDS):
        sizes = keyed.groupBy(F.col(f"k{r}").alias("key")).agg(F.count(F.lit(1)).alias("many")).where("many > 1")
        rows = keyed.select("sig", "tokens", F.col(f"k{r}").alias("key")).join(sizes, "key")
        rows = rows.withColumn("lot", F.expr(f"pmod(xxhash64(sig, {r}), cast(ceil(many / {GROUP}) as bigint))"))
        rows = rows.select("key", "lot", "sig", "tokens").repartition("key", "lot")  # else a frequent key stays in one task
        found = rows.groupBy("key", "lot").applyInArrow(_link_group, "a long, b long")
        links = found if links is None else links.unionByName(found)
    return settle(links, "near_links")


def _ask_group(asked: pa.Table, members: pa.Table) -> pa.Table:
    """Links of the sets that ask a group: those whose overlap with its token union allows one are compared with its members.

    A set gets one link to each other component among the members.
    """
    inside, sets = ([np.frombuffer(x, np.uint64) for x in c.to_pylist()] for c in (members.column("in_tokens"), asked.column("tokens")))
    union = np.unique(np.concatenate(inside)) if inside else np.zeros(0, np.uint64)
    at = np.concatenate([np.searchsorted(union, t) for t in inside]) if inside else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(inside)), [len(t) for t in inside])
    n = np.array([len(t) for t in inside])
    theirs, components = members.column("in_sig").to_numpy(), members.column("in_owner").to_numpy()
    a, b = [], []
    for sig, owner, tokens in zip(asked.column("sig").to_pylist(), asked.column("owner").to_pylist(), sets):
        if not len(union):
            break
        place = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
        place = place[union[place] == tokens]
        if len(place) < least_overlap(len(tokens)):
            continue  # the group stays shut
        shared = np.zeros(len(union), bool)
        shared[place] = True
        both = np.bincount(row, weights=shared[at], minlength=len(inside))
        near = np.flatnonzero((100 * both >= PERCENT * (len(tokens) + n - both)) & (components != owner))
        near = near[np.unique(components[near], return_index=True)[1]]
        a += [sig] * len(near)
        b += theirs[near].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def matrix_links(sets: DataFrame) -> DataFrame:
    """Step 3: links between sets ``(sig, n, tokens, owner)`` of different owners, one for a set, a group and an owner."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(t, np.int64) for t in batch.column("tokens").to_pylist()]
            yield pa.record_batch(
                [batch.column("sig"), batch.column("owner"), pa.array(lists, pa.list_(pa.int64()))], names=["sig", "owner", "list"]
            )

    token = sets.select("sig", "owner", "tokens").mapInArrow(numbers, "sig long, owner long, list array<bigint>")
    token = settle(token.select("sig", "owner", F.explode("list").alias("token")), "matrix_tokens")
    # A token is the rarer the fewer components hold it; what only one holds can't link, and counts as the rarest.
    rarity = token.groupBy("token", "owner").agg(F.lit(1).alias("one")).groupBy("token").agg(F.sum("one").alias("df")).where("df > 1")
    shared = token.select("sig", "token").join(rarity, "token").groupBy("sig").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ordered"),  # one set's tokens
        F.min(F.xxhash64("token")).alias("key"),
    )
    shared = settle(shared, "matrix_shared")
    # Similar sets have an equal min-hash of what they share; each group has a bounded number of them, whatever their components.
    alike = shared.groupBy("key").agg(F.count(F.lit(1)).alias("alike"))
    lot = F.expr(f"pmod(xxhash64(sig), cast(ceil(alike / {MATRIX_GROUP}) as bigint))")
    group = shared.join(alike, "key").select("sig", "ordered", F.concat_ws(":", "key", lot).alias("grp"))
    many = sets.groupBy("owner").agg(F.count(F.lit(1)).alias("many"))
    sets = settle(sets.join(many, "owner").join(group, "sig").withColumn("place", F.struct("many", "owner")), "matrix_sets")
    # What is left of a set from a token on, in the common order. The first token that two sets share bounds their overlap by
    # the lesser of what is left of both; rows that fall short are not that first token of any linked pair.
    first = sets.select(
        "sig", "n", "place", "grp", F.size("ordered").alias("many"),
        F.posexplode(F.expr(f"slice(ordered, 1, greatest(0, cast(size(ordered) - {_sql_least('n')} + 1 as int)))")).alias("at", "t"),
    )
    first = first.select("sig", "n", "place", "grp", (F.col("many") - F.col("at")).alias("left"), F.col("t.token").alias("token"))
    first = settle(first, "matrix_first")
    matrix = first.groupBy("token", "grp").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("left").alias("most"), F.max("place").alias("top")
    )
    # Of two components the smaller one asks; its sets are fewer, and those of the larger one stand under fewer unions.
    pairs = first.select("token", "sig", "n", "place", "left").join(matrix, "token").where(
        f"place < top and 100 * high >= {PERCENT} * n and {PERCENT} * low <= 100 * n"
        f" and {100 + PERCENT} * least(left, most) >= {PERCENT} * (n + greatest(low, {_sql_least('n')}))"
    ).select("sig", "grp").distinct()
    pairs = settle(pairs, "matrix_pairs")
    lots = pairs.groupBy("grp").agg(F.expr(f"cast(ceil(count(1) / {ASKING}) as bigint)").alias("lots"))
    asked = pairs.join(lots, "grp").join(sets.select("sig", "owner", "tokens"), "sig").select(
        "grp", F.expr("pmod(xxhash64(sig), lots)").alias("lot"), "sig", "owner", "tokens"
    )
    inside = sets.select(F.col("grp").alias("in_grp"), F.col("sig").alias("in_sig"), F.col("owner").alias("in_owner"), F.col("tokens").alias("in_tokens"))
    size = lots.select(F.col("grp").alias("in_grp"), F.col("lots").alias("in_lots"))
    members = inside.join(size, "in_grp").select(
        "in_grp", F.explode(F.expr("sequence(0L, in_lots - 1)")).alias("in_lot"), "in_sig", "in_owner", "in_tokens"
    )
    asked, members = asked.repartition("grp", "lot"), members.repartition("in_grp", "in_lot")
    return asked.groupBy("grp", "lot").cogroup(members.groupBy("in_grp", "in_lot")).applyInArrow(_ask_group, "a long, b long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows ``(key, doc_id, n, sig)``, and ``(node, root)`` of all sets that link with another one."""
    rows = settle(set_rows(docs), "near_rows")
    entity = settle(rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "near_entities")
    sharing = settle(sharing_documents(docs, entity.select("sig", "n"), rows.select("n")), "near_sharing")
    many = sharing.count()
    if not many:
        return rows, docs.sparkSession.createDataFrame([], "node long, root long")
    chosen = entity.join(sharing.select("sig"), "sig", "left_semi").select("doc_id")
    texts = id_text(docs)
    texts = texts.join(small_side(chosen.where("doc_id is not null"), many, 24), "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))
    sets = full_sets(texts).join(small_side(sharing.select("sig"), many, 24), "sig", "left_semi").dropDuplicates(["sig"])
    sets = settle(sets, "near_sets")
    close = settle(sharing_sets(sets.withColumn("owner", F.col("sig"))), "near_close").select("sig")
    sets = settle(sets.join(close, "sig", "left_semi"), "near_close_sets")
    links = group_links(sets)
    early = connected(links)
    owned = sets.join(early, sets["sig"] == early["node"], "left").select("sig", "n", "tokens", F.coalesce("root", "sig").alias("owner"))
    owned = settle(owned, "near_owned")
    open_ = settle(sharing_sets(owned), "near_open").select("sig")
    if open_.isEmpty():  # no set has enough in common with another component
        return rows, early
    across = settle(matrix_links(settle(owned.join(open_, "sig", "left_semi"), "near_open_sets")), "near_across")
    return rows, connected(links.unionByName(across))


def near_classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row; the class id is the smallest id of the class."""
    rows, roots = classes(docs)
    joined = rows.join(roots, rows["sig"] == roots["node"], "left").select("doc_id", "n", F.coalesce("root", "sig").alias("root"))
    first = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    first = first.join(roots, first["sig"] == roots["node"], "left").groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("doc_id").alias("least"))
    return joined.join(first, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: the smallest id, ids before nulls, then the smallest hash of the content. Rows without words all stay."""
    rows, roots = classes(docs)
    rows = rows.where("sig is not null")
    rows = rows.join(roots, rows["sig"] == roots["node"], "left").select("key", "doc_id", F.coalesce("root", "sig").alias("root"))
    rows = settle(rows, "near_members")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("many"))
    first = first.where("many > 1").select("root", F.col("first.key").alias("first"))
    lost = settle(rows.join(first, "root").where("key <> first").select("key").distinct(), "near_lost")
    twice = settle(rows.groupBy("key").count().where("count > 1").select("key"), "near_twice")
    name = free_name(docs, "_key")
    kept = docs.withColumn(name, content_key())
    kept = kept.join(small_side(lost.withColumnRenamed("key", name), lost.count(), 24), name, "left_anti")
    many = twice.count()
    if many:  # rows that are the same in id and text
        same = small_side(twice.withColumnRenamed("key", name), many, 24)
        kept = kept.join(same, name, "left_anti").unionByName(kept.join(same, name, "left_semi").dropDuplicates([name]))
    return kept.select(docs.columns)


# The brute-force form for small tables: all shingle sets, all pairs that share a shingle.
SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 80 * (nx.n + ny.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


@query("op7_jaccard_groups", SQL)
def op7_jaccard_groups(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents"))
