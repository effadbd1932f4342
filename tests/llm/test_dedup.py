"""Exact, substring, line and near de-duplication against brute force."""

from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skytally.llm import line_dedup, minhash_dedup
from skytally.llm import substring_dedup as substring_dedup_module
from skytally.llm.exact_dedup import exact_dedup
from skytally.llm.line_dedup import dedup_lines
from skytally.llm.minhash_dedup import near_duplicates
from skytally.llm.substring_dedup import substring_dedup


@pytest.mark.parametrize("digest", [lambda t: F.sha2(t, 256), lambda t: (F.length(t) % 3).cast("string")], ids=["sha256", "colliding"])
def test_exact(table, corpus, digest):
    groups: dict[str, list[int]] = {}
    for doc, text in corpus:
        groups.setdefault(text, []).append(doc)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(table(corpus), digest).collect()}
    assert got == {doc: (max(groups[t]), len(groups[t]), doc == max(groups[t])) for doc, t in corpus}


def test_exact_odd(table, odd):
    rows = exact_dedup(table(odd)).collect()
    assert len(rows) == len(odd)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in rows)
    assert ("1", "None", 3, False) in got and ("2", "None", 3, False) in got and ("None", "None", 3, True) in got
    assert got.count(("4", "4", 2, True)) == 2
    assert exact_dedup(table([])).count() == 0


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000, "shard_bits": 8, "spread": 0.05}], ids=["plain", "many blocks, crowded sketch"])
def test_substring(table, corpus, options):
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup(table(corpus), 13, **options).collect()}
    assert got == brute.substrings(corpus, 13)
    assert sum(x[1] for x in got.values()) > 500


def test_substring_odd(table, odd):
    rows = substring_dedup(table(odd), 13).collect()
    assert len(rows) == len(odd)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in rows if r.doc_id is not None}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (2, 0), 5: (60_000, 60_000 - 60_000), 6: (60_001, 60_000), 7: (5 - 1, 0)} | {7: (len(brute.words("é ü — ☃ 語")), 0)}
    assert substring_dedup(table([]), 13).count() == 0


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2000, "nearest": 1}, {"hot": 30, "nearest": 1}], ids=["plain", "many blocks", "tokens in cells"])
def test_lines(table, corpus, options):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(table(corpus), **options).collect()}
    assert got == brute.lines(corpus)
    assert sum(x[1] for x in got.values()) > 20


def test_lines_of_near_copies(table):
    """A long chain of edited lines, most of them like several earlier ones, some like none of the nearest."""
    words, rows = [f"w{k}" for k in range(40)], []
    for k in range(300):
        words = [*words]
        words[(7 * k) % 40] = f"v{k % 11}x{(7 * k) % 40}"
        rows.append((k, " ".join(words) + ("\nown line of document number " + str(k) if k % 3 else "")))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in dedup_lines(table(rows), nearest=1).collect()}
    assert got == brute.lines(rows)


def test_lines_of_one_id(table):
    """Rows of one id are judged by their own texts; what an earlier document has goes from each."""
    one, two = "a line that is long enough to be kept here", "another one that nobody else has in this place"
    rows = [(1, one), (2, f"{one}\n{two}"), (2, f"{two}\n{two}"), (None, f"{two}\nx"), (None, f"y\n{two} too")]
    got = sorted((str(r.doc_id), r.n_removed, r.text) for r in dedup_lines(table(rows)).collect())
    assert got == sorted([("1", 0, one), ("2", 2, ""), ("2", 1, two), ("None", 1, "x"), ("None", 1, "y")])


def test_lines_odd(table, odd):
    rows = dedup_lines(table(odd)).collect()
    assert len(rows) == len(odd)
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in rows if r.doc_id is not None}
    assert got == {1: (1, 0), 2: (1, 0), 3: (2, 0), 4: (1, 0), 5: (1, 0), 6: (1, 1), 7: (1, 0)}
    assert dedup_lines(table([])).count() == 0


def test_near(table, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(corpus)).collect()}
    assert got == brute.near_groups(corpus)
    assert 10 < len({c for _, c in got.values()}) < len(corpus) - 10


def test_near_in_tiles(table, monkeypatch):
    """Large buckets with several groups, cut into tiles of a few members."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for k in range(120):
        copy = list(base)
        for _ in range(k % 9):
            copy[rng.randrange(80)] = f"x{rng.randrange(500)}"
        rows.append((k, " ".join(copy)))
    monkeypatch.setattr(minhash_dedup, "TILE", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table(rows)).collect()}
    assert got == brute.near_groups(rows)


def test_windows_of_equal_halves(monkeypatch):
    """Windows whose first halves collide are told apart by the second."""
    texts = pa.table({"doc_id": [1, 2, 3], "text": ["a b c d e f", "b c d x y z", "a b c d e f"]})
    plain = substring_dedup_module._Block(texts, 3)
    turn, own = [0], substring_dedup_module.windows

    def crowded(h, size):
        turn[0] += 1
        return own(h, size) % np.uint64(2) if turn[0] % 2 else own(h, size)

    monkeypatch.setattr(substring_dedup_module, "windows", crowded)
    block = substring_dedup_module._Block(texts, 3)
    pairs = lambda b: {(i, j) for i in range(len(b.inverse)) for j in range(i) if b.inverse[i] == b.inverse[j]}
    assert pairs(block) == pairs(plain) and sorted(block.least) == sorted(plain.least)


def test_near_odd(table, odd):
    rows = near_duplicates(table(odd)).collect()
    assert len(rows) == len(odd)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None}
    assert {k: v[1:] for k, v in got.items()} == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (5, False), 7: (7, True)}
    assert [got[k][0] for k in (1, 2, 3, 4, 7)] == [0, 0, 0, 1, 1]
    assert near_duplicates(table([])).count() == 0


def test_second_round_takes_packed_lines():
    """What the second round takes from packed lines is what tokenising all texts again would give."""
    class Shared:
        def __init__(self, value):
            self.value = value

    texts = ["one two three four five six seven\none two three four five six eight", "nine ten eleven twelve one two\n\nfive six", "nine ten eleven twelve one two"]
    counts = Shared(np.full(1 << line_dedup.BUCKET_BITS, 5, np.uint32))
    batch = pa.RecordBatch.from_arrays([pa.array([3, 1, 2]), pa.array(texts)], ["doc_id", "text"])
    packed = list(line_dedup._Join(0.5, counts, 4, 1, 100).lines(iter([batch])))
    heads = np.concatenate([line_dedup._joined(b.column("lines"), line_dedup._LINE) for b in packed])
    tokens = np.concatenate([line_dedup._wide(b"".join(b.column("tokens").to_pylist())) for b in packed])
    owner = np.repeat(np.arange(len(heads)), heads["tokens"])
    for token in np.unique(tokens):
        table = np.zeros(line_dedup.SLOTS >> 6, np.int64)
        slot = int(line_dedup._slot(int(token), 0, 0))
        table[slot >> 6] = np.array([1 << (slot & 63)], np.uint64).view(np.int64)[0]
        again = list(line_dedup._Join(0.5, counts, 4, 1, 100, Shared(None), Shared(table)).reopened(iter(packed)))
        found = np.concatenate([line_dedup._joined(b.column("lines"), line_dedup._LINE) for b in again])
        expected = heads[np.unique(owner[tokens == token])]
        assert sorted(map(tuple, found.tolist())) == sorted(map(tuple, expected.tolist()))
