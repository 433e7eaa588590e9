"""Shingle sets, the Jaccard join and components against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from forecastlab.llm import jaccard_groups, wordhash
from forecastlab.llm.components import connected
from llm.conftest import as_docs, odd_pairs, prose


def shingles(text):
    words = [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(pairs):
    """(doc_id, n_shingles, component_id) of every row, all pairs compared."""
    sets = [shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for k, (doc_id, _) in enumerate(pairs):
        ids = [pairs[j][0] for j in range(len(pairs)) if find(j) == find(k) and pairs[j][0] is not None]
        out.append((doc_id, len(sets[k]), doc_id if not sets[k] else min(ids, default=None)))
    return Counter(out)


def edited(text, rng, share):
    words = text.split()
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = "w" + str(rng.randrange(10**6))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    pairs = []
    for k in range(60):
        base = prose(100 + k, rng.randint(3, 120))
        pairs.append((len(pairs), base))
        for _ in range(rng.randint(0, 4)):
            pairs.append((len(pairs), edited(base, rng, rng.choice([0.0, 0.01, 0.02, 0.04]))))
    chain = prose(7, 200).split()
    for k in range(25):  # neighbours link, the ends don't
        pairs.append((len(pairs), " ".join(chain[k * 4 : k * 4 + 90])))
    shared = prose(9, 60)
    for k in range(30):  # a common passage, too short to link
        pairs.append((len(pairs), prose(500 + k, 100) + " " + shared))
    return pairs


def found(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_classes_equal_brute_force(spark, corpus):
    assert found(jaccard_groups.near_classes(as_docs(spark, corpus))) == brute(corpus)


def test_small_groups_force_the_matrix(spark, corpus, monkeypatch):
    """Without the early rounds and with tiny groups every link comes from the token-group matrix."""
    monkeypatch.setattr(jaccard_groups, "group_links", lambda sets: sets.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(jaccard_groups, "MATRIX_GROUP", 2)
    monkeypatch.setattr(jaccard_groups, "TOKENS_PER_PART", 2000)
    assert found(jaccard_groups.near_classes(as_docs(spark, corpus))) == brute(corpus)


def test_large_group_of_copies(spark):
    rng = random.Random(8)
    base = prose(11, 150)
    pairs = [(k, base) for k in range(300)] + [(300 + k, edited(base, rng, 0.012)) for k in range(400)]
    assert found(jaccard_groups.near_classes(as_docs(spark, pairs))) == brute(pairs)


def test_odd_rows(spark, odd):
    assert found(jaccard_groups.near_classes(odd)) == brute(odd_pairs())


def test_one_row_of_each_class_stays(spark, odd):
    kept = jaccard_groups.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [r["text"] for r in rows]
    assert texts.count(prose(2)) == 1 and texts.count(prose(7)) == 1 and prose(2) + " tail" not in texts
    assert [r["doc_id"] for r in rows if r["text"] == prose(2)] == [1]
    assert sum(not (t or "").split() for t in texts) == 4


def test_null_ids_only(spark):
    docs = as_docs(spark, [(None, prose(1)), (None, prose(1)), (None, prose(2))])
    assert sorted(r["text"] for r in jaccard_groups.keep_one(docs).collect()) == sorted([prose(1), prose(2)])


def test_empty(none):
    assert jaccard_groups.near_classes(none).count() == 0
    assert jaccard_groups.keep_one(none).count() == 0


def test_hashes_follow_words():
    texts = ["A b\tC  d e f", "a B c d E\nf ", "a b c d e g", "", "a b", "A  B", None, "x" * 5000 + " y"]
    sets = list(wordhash.shingle_sets(pa.array(texts)))
    assert (sets[0] == sets[1]).all() and len(np.intersect1d(sets[0], sets[2])) == 1
    assert [len(s) for s in sets] == [2, 2, 2, 0, 1, 1, 0, 1] and sets[4] == sets[5]
    small = [list(map(int, s)) for s in (list(wordhash.shingle_sets(pa.array(texts).slice(2)))[2:4])]
    assert small == [list(map(int, sets[4])), list(map(int, sets[5]))]


def test_words_across_slices():
    texts = pa.array([prose(k, 50) for k in range(40)])
    whole = [w.tolist() for w in wordhash.shingle_sets(texts)]
    parts = [wordhash.words_of(rows) for _, rows in wordhash.slices(texts, 300)]
    assert len(parts) > 10 and sum(len(w) for w, _ in parts) == 40 * 50
    assert [len(w) for w in whole] == [len(shingles(t)) for t in texts.to_pylist()]


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(500, 500 + k) for k in range(1, 50)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
