"""Alignment of two tokenizers against plain comparison of byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from forecastlab.llm import alignment as al
from llm.conftest import as_docs, odd_pairs, prose

SIGNS = " \n\t  abcdefgéñß日本語😀,.!?'s0123456789 ​\u0000<>|"


@pytest.fixture(scope="module")
def sides():
    return al._sides(*(open(p, "rb").read() for p in (al.BYTE_BPE_PATH, al.MODEL_PATH)))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    byte_bpe = Tokenizer.from_file(al.BYTE_BPE_PATH)
    byte_bpe.encode_special_tokens = True
    return lambda text: byte_bpe.encode(" " + text, add_special_tokens=False).ids


def tricky():
    rng = random.Random(2)
    fixed = ["<|endoftext|>", "</s><s>[INST] x", "<0x41>", "a▁b", "▁", " ", "  a", "a  ", "ﬁ Å", "x" * 3000, "\n\n", "don't we'll", "é", "́"]
    return fixed + ["".join(rng.choice(SIGNS) for _ in range(rng.randint(1, 80))) for _ in range(150)]


def plain(sides, library, texts):
    """The contract by comparing the byte ranges of all tokens of a document."""
    (a_side, _, _), (b_side, _, _) = sides
    done, links = [], []
    for text in texts:
        row, own = [0, 0, 0, "", 0], []
        if text:
            ids = (library(text), b_side.model.encode(text))
            words = [[s.bytes[i] for i in x] for s, x in zip((a_side, b_side), ids)]
            if all(b"".join(w) == (" " + text).encode() for w in words):
                spans = []
                for w in words:
                    ends = np.cumsum([len(x) for x in w]).tolist()
                    spans.append(list(zip([0, *ends[:-1]], ends)))
                low = 0
                for i, (s, e) in enumerate(spans[0]):
                    while spans[1][low][1] <= s:
                        low += 1
                    j = low
                    while j < len(spans[1]) and spans[1][j][0] < e:
                        own.append((ids[0][i], ids[1][j]))
                        j += 1
                ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
                told, at = [], [0, 0]
                for end in ends:
                    part = []
                    for k in range(2):
                        start = at[k]
                        while at[k] < len(spans[k]) and spans[k][at[k]][1] <= end:
                            at[k] += 1
                        part.append(",".join(map(str, ids[k][start : at[k]])))
                    told.append("|".join(part))
                row = [len(ids[0]), len(ids[1]), len(ends), hashlib.sha256(";".join(told).encode()).hexdigest(), len(own)]
        done.append(row)
        links.append(Counter(own))
    counts = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (*row, sum(n for p, n in own.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in own.items()))
        for row, own in zip(done, links)
    ]


def figures(rows):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.groups_sha256, r.n_links, r.n_best, r.count_sum) for r in rows)


def test_byte_ids_are_those_of_the_file(sides, library):
    for text in tricky() + [t for _, t in odd_pairs() if t]:
        assert sides[0][0].encode([text])[0] == library(text)


@pytest.mark.parametrize("block_bytes, per_part", [(1 << 20, 2_000_000), (500, 300)])
def test_figures_against_plain_ranges(spark, sides, library, monkeypatch, block_bytes, per_part):
    monkeypatch.setattr(al, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(al, "PAIRS_PER_PART", per_part)
    rows = [*odd_pairs(), *((100 + k, t) for k, t in enumerate(tricky())), *((500 + k, prose(k % 7, 40)) for k in range(20))]
    got = figures(al.align(as_docs(spark, rows).repartition(5)).collect())
    want = Counter((d, *f) for (d, _), f in zip(rows, plain(sides, library, [t for _, t in rows])))
    assert got == want
    assert sum(f[2] == 0 for f in want) >= 5  # null, empty, and texts that a side rewrites


def test_no_tokens_and_no_rows(spark):
    rows = al.align(as_docs(spark, [(1, None), (2, ""), (None, ""), (3, "▁")])).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3]
    assert {tuple(r)[1:] for r in rows} == {(0, 0, 0, 0, 0, 0, "")}
    assert al.align(as_docs(spark, [])).collect() == []
    assert al.token_groups(as_docs(spark, [])).collect() == []


def test_groups_give_the_text_back(spark, sides):
    rows = [(k, t) for k, t in enumerate(tricky()) if "▁" not in t] + [(900, prose(4, 5000)), (901, None)]
    found = defaultdict(list)
    for g in al.token_groups(as_docs(spark, rows)).collect():
        found[g.doc_id].append(g)
    for key, text in rows:
        whole = (" " + text).encode() if text else b""
        own = sorted(found[key], key=lambda g: g.start)
        if not own:
            continue
        assert own[0].start == 0 and own[-1].end == len(whole)
        assert all(x.end == y.start for x, y in zip(own, own[1:]))
        for g in own:
            for (side, _, _), ids in zip(sides, (g.a_ids, g.b_ids)):
                assert b"".join(side.bytes[i] for i in ids) == whole[g.start : g.end]
    assert len(found) > len(rows) * 0.8


def test_query_over_its_table(spark, sides, library, tmp_path):
    rows = [(k, prose(k, 30)) for k in range(12)] + [(12, "x")] * 3
    as_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = figures(al.op12_alignment(spark, str(tmp_path)).collect())
    assert got == Counter((d, *f) for (d, _), f in zip(rows, plain(sides, library, [t for _, t in rows])))
