"""SentencePiece encoding, token counts and sharding."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecastlab.llm import sentence_pieces, sharding, token_counts
from forecastlab.llm.vocabulary import SPACE, UNKNOWN_SCORE, load_pieces, piece_scores
from llm.conftest import as_docs, odd_pairs, prose


def plain_search(scores, word):
    """Best (score, tokens) over all segmentations, the longer last piece first among equals."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [
            (best[s][0] + scores[word[s:end]][0], -s, best[s][1] + 1) for s in range(end) if word[s:end] in scores
        ]
        if word[end - 1] not in scores:
            options.append((best[end - 1][0] + UNKNOWN_SCORE, 1 - end, best[end - 1][1] + len(word[end - 1].encode())))
        top = max(options)
        best.append((top[0], top[2]))
    return best[-1]


@pytest.fixture(scope="module")
def model():
    return load_pieces()


def test_stream_equals_plain_search(model):
    scores = piece_scores(model[0])
    rng = random.Random(5)
    for size in (1, 5, 40, 400):
        for _ in range(5):
            text = SPACE + "".join(rng.choice("thequickbrownfoxñé日 .,") for _ in range(size)).replace(" ", SPACE)
            search = sentence_pieces.StreamingViterbi(scores, model[1])
            out, at = [], 0
            while at < len(text):  # pieces of any size, as a stream brings them
                step = rng.randint(1, 30)
                out += search.feed(text[at : at + step])
                at += step
            out += search.finish()
            assert len(out) == plain_search(scores, text)[1]
            whole = sentence_pieces.StreamingViterbi(scores, model[1]).encode(text)
            assert out == whole


def test_stream_keeps_a_bounded_window(model):
    search = sentence_pieces.StreamingViterbi(piece_scores(model[0]), model[1])
    longest = 0
    for k in range(300):
        search.feed(prose(k, 10).replace(" ", SPACE))
        longest = max(longest, len(search.text))
    assert longest < 20 * search.longest


def test_tiny_vocabulary_by_enumeration():
    scores = {"a": (-2.0, 0), "b": (-2.0, 1), "ab": (-3.0, 2), "aba": (-4.5, 3), "ba": (-3.0, 4)}
    trie = token_counts.PrefixTrie(scores, max_nodes=10)
    for size in range(1, 8):
        for code in range(2**size):
            word = "".join("ab"[code >> k & 1] for k in range(size))
            expected = plain_search(scores, word)
            assert trie.insert(word) == expected
            assert len(sentence_pieces.StreamingViterbi(scores, 100).encode(word)) == expected[1]


def test_encode_round_trip_and_counts(spark, odd):
    rows = sentence_pieces.encode(odd).collect()
    assert len(rows) == len(odd_pairs())
    assert all(r["round_trip"] and len(r["ids"]) == r["n_ids"] for r in rows)
    counts = token_counts.token_counts(odd).collect()
    key = lambda rs, name: Counter((r["doc_id"], r[name]) for r in rs)
    assert key(rows, "n_ids") == key(counts, "n_tokens")
    empty = [r for r in rows if r["doc_id"] in (3, 4)]
    assert [r["n_ids"] for r in empty] == [0, 0]
    texts = sentence_pieces.decode(sentence_pieces.encode(odd)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in texts) == Counter((i, t or "") for i, t in odd_pairs())


def test_empty_tables(none):
    assert sentence_pieces.encode(none).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert sharding.assign_shards(none).count() == 0


def test_trie_restart_changes_nothing(model):
    scores = piece_scores(model[0])
    small, large = token_counts.PrefixTrie(scores, 50), token_counts.PrefixTrie(scores)
    words = (SPACE + prose(3, 200).replace(" ", " " + SPACE)).split(" ")
    assert [small.count([w]) for w in words] == [large.count([w]) for w in words]
    scored = [large.count([w]) for w in words]
    assert all(np.isclose(s, plain_search(scores, w)[0]) and n == plain_search(scores, w)[1] for w, (n, s) in zip(words, scored))


def shard_by_hand(pairs, limit):
    import hashlib

    sized = [(int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), i, len((t or "").encode())) for i, t in pairs]

    def split(rows, depth, bits):
        if sum(n for _, _, n in rows) <= limit:
            return {i: bits for _, i, _ in rows}
        out = {}
        for bit in (0, 1):
            out |= split([r for r in rows if r[0] >> (31 - depth) & 1 == bit], depth + 1, bits + str(bit))
        return out

    return split(sized, 0, "")


def test_shards_equal_recursive_splits(spark):
    pairs = [(i, prose(i, 5 + i % 40)) for i in range(400)]
    for limit in (3_000, 20_000, 10**6):
        got = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(as_docs(spark, pairs), limit).collect()}
        assert got == shard_by_hand(pairs, limit)


def test_overflow_keeps_the_limit(spark, odd):
    hot = as_docs(spark, [(5, prose(k, 20)) for k in range(300)] + odd_pairs())
    rows = sharding.assign_shards(hot, 4_000)
    assert rows.count() == 300 + len(odd_pairs())
    sizes = rows.groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= 4_000 or r["n"] == 1 for r in sizes)


def shortest_prefix(pairs, limit):
    """The shard of every document by all prefixes of the hash; None where no prefix is within the limit."""
    codes = {i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), "032b") for i, _ in pairs}
    size = Counter()
    for i, t in pairs:
        size.update({codes[i][:n]: len(t) for n in range(33)})
    return {i: next((codes[i][:n] for n in range(33) if size[codes[i][:n]] <= limit), None) for i, _ in pairs}


def test_neighbours_of_a_huge_document_keep_their_shard(spark):
    # Few bytes in all, so cells are coarse: the huge document shares its cell with small ones.
    pairs = [(0, "y" * 9_000), *((i, "x" * 10) for i in range(1, 1_000))]
    got = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(as_docs(spark, pairs), 4_000).collect()}
    want = shortest_prefix(pairs, 4_000)
    assert want.pop(0) is None and got.pop(0).endswith("/L-0-1")
    assert got == want


def test_two_documents_part_whatever_else_there_is(spark):
    # The two of 3,000 whose hashes agree in most leading bits, more than the cells of so few bytes have.
    code = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16)
    near = sorted(range(3_000), key=code)
    pair = min(zip(near, near[1:]), key=lambda p: code(p[0]) ^ code(p[1]))
    pairs = [(i, "x" * 2_500) for i in pair]
    got = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(as_docs(spark, pairs), 4_000).collect()}
    assert got == shortest_prefix(pairs, 4_000) and "/" not in "".join(got.values())


def test_written_shards(spark, tmp_path):
    docs = as_docs(spark, [(i, prose(i, 30)) for i in range(50)])
    sharding.write_shards(docs, str(tmp_path / "shards"), 5_000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 50 and back.select("shard").distinct().count() > 1
