"""Spelling variants, token files and centroid clustering against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skytally.llm import spelling, token_files
from skytally.llm.centroids import cluster_vectors, nearest, whole
from skytally.llm.spelling import deletion_keys, spelling_variants
from skytally.llm.token_files import count_tokens, encode, find_tokens, read_tokens, token_at, token_folder, write_tokens
from skytally.llm.wavelet import WaveletMatrix

# --- spelling variants ---


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def variants(rows, least=7, every=31, least_n=2, times=10):
    counts: dict[str, int] = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= least_n}
    out = {}
    for w, n in counts.items():
        around = [v for v in counts if near(w, v)]
        form = min(around, key=lambda v: (-counts[v], v), default=None)
        out[w] = [form if form and counts[form] >= times * n else None, n, len(around)]
    for w, (form, *_) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (form, root, out[w][1], out[w][2], counts[form] if form else None)
    return out


def misspelt(rng, stems, texts):
    alphabet, rows = "abcé", []
    for doc in range(texts):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = list(stems[min(int(rng.expovariate(0.5)), len(stems) - 1)])
            while rng.random() < 0.3:
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice(["", rng.choice(alphabet), w[k].upper()])
            words.append("".join(w))
        rows.append((doc, rng.choice([" ", ", ", "\n", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("options", [{}, {"every": 3, "least": 4, "times": 2}], ids=["plain", "much left out"])
def test_spelling(table, monkeypatch, options):
    rng = random.Random(3)
    stems = ["".join(rng.choices("abc", k=rng.randint(7, 9))) for _ in range(6)] + ["aaaaaaaa", "abababab", "éaaaaaaé"]
    rows = misspelt(rng, stems, 120) + [(None, None), (None, " ".join(stems)), (500, ""), (501, " ".join(stems[:3] * 40)), (501, " ".join(stems[:3] * 40))]
    monkeypatch.setattr(spelling, "BUCKET", 1000)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(table(rows), **options).collect()}
    assert got == variants(rows, **options)
    assert sum(x[0] is not None for x in got.values()) > 20 and max(x[3] for x in got.values()) > 8


def test_spelling_follows_forms(table):
    rows = [(None, " ".join(["abcdefg"] * 2000 + ["abcdefgh"] * 180 + ["abcdefghi"] * 15 + ["abcdefgxx"] * 2 + ["abcdefghix"] * 1))]
    got = {r.word: (r.form, r.root) for r in spelling_variants(table(rows), every=10**9, least_n=1).collect()}
    assert got == {"abcdefg": (None, "abcdefg"), "abcdefgh": ("abcdefg", "abcdefg"), "abcdefghi": ("abcdefgh", "abcdefg"), "abcdefgxx": (None, "abcdefgxx"), "abcdefghix": ("abcdefghi", "abcdefg")}


def test_spelling_collisions_are_told_apart(table, monkeypatch):
    """Keys that say next to nothing leave the result as it is."""
    rows = misspelt(random.Random(4), ["abcabca", "cbacbac", "bbbbbbb"], 40)
    monkeypatch.setattr(spelling, "mix", lambda h: h & np.uint64(3))
    found = spelling_variants(table(rows)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == variants(rows)


def test_spelling_odd(table, odd):
    long_ = "abcdefghij" * 20_000
    rows = odd + [(8, f"{long_} {long_}x {long_}"), (9, long_ + "x"), (10, "Élan Vitale× élan Vitale×")]
    got = {r.word: (r.n, r.n_near) for r in spelling_variants(table(rows), every=10**9).collect()}
    assert got == {long_: (2, 1), long_ + "x": (2, 1), "vitale×": (2, 0)}
    assert spelling_variants(table([])).count() == 0


def test_deletion_keys_equal_hashes_of_the_strings():
    rng = random.Random(1)
    words = [bytes(rng.choices(range(97, 100), k=rng.randint(1, 9))) for _ in range(300)]
    keys, word, place = deletion_keys(words)
    rests = [words[w] if p < 0 else words[w][:p] + words[w][p + 1 :] for w, p in zip(word.tolist(), place.tolist(), strict=True)]
    of: dict[bytes, set[int]] = {}
    for k, r in zip(keys.tolist(), rests, strict=True):
        of.setdefault(r, set()).add(k)
    assert all(len(v) == 1 for v in of.values()) and len({k for v in of.values() for k in v}) == len(of)


# --- token files ---


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 4000])
def test_wavelet_matrix(n):
    values = np.random.default_rng(n).integers(0, 50, n).astype(np.uint32)
    matrix = WaveletMatrix.build(values, 6)
    again = WaveletMatrix(n, [p.tobytes() for p in matrix.planes], matrix.zeros, [r.tobytes() for r in matrix.ranks])
    assert (again.all() == values).all() and (again.access(np.arange(n)) == values).all()
    for v in (0, 3, 49, 63, 64):
        assert (again.select(v) == np.flatnonzero(values == v)).all()
        assert (again.rank(v, np.arange(n + 1)) == np.concatenate([[0], np.cumsum(values == v)])).all()


def plain_ids(texts):
    return [e.ids + [2] for e in token_files._encoder(token_files.TOKENIZER).codec.encode_batch(texts, add_special_tokens=False)]


def test_encoding_in_parts_equals_that_of_whole_texts(monkeypatch):
    rng = random.Random(2)
    pieces = ["a", "don", "ß", "Ā", "中", "_", "-", "ª", "×", "b1", " ", "  ", "\n", "'s", "'", "\t", "é", " ", ".", "\x85", "\x1c", "<|endoftext|>", "​", " The", " the,"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(8000)]
    monkeypatch.setattr(token_files, "KEPT", 500)
    for part in (texts[:3000], texts[3000:], [], [""]):
        ids, ends = encode(pa.array(part, pa.string()))
        want = plain_ids(part)
        assert ids.tolist() == [i for w in want for i in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


@pytest.mark.parametrize("sizes", [(32 << 20, 4 << 20), (4000, 1500)], ids=["one shard", "many shards and segments"])
def test_token_files(spark, table, corpus, sizes):
    folder = token_folder(spark)
    write_tokens(table(corpus), folder, shard_bytes=sizes[0], segment_bytes=sizes[1])
    rows = sorted(corpus)
    want, flat, owner = {}, [], []
    for (doc, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        want[doc] = (len(flat), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        flat += ids
        owner += [doc] * len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, r.ids) for r in read_tokens(spark, folder).collect()} == want
    assert {r.doc_id: r.start for r in read_tokens(spark, folder, ids=False).collect()} == {d: w[0] for d, w in want.items()}
    asked = sorted(set(random.Random(1).choices(range(len(flat)), k=200)))
    assert sorted(token_at(spark, folder, [*asked, -1, len(flat)]).collect()) == [(p, flat[p], owner[p]) for p in asked]
    some = [2, flat[0], flat[100], 50_000]
    assert {r.id: (r.n, r.n_docs) for r in count_tokens(spark, folder, some).collect()} == {t: (flat.count(t), len({o for o, f in zip(owner, flat, strict=True) if f == t})) for t in set(some)}
    assert sorted(find_tokens(spark, folder, some[1:]).collect()) == sorted((t, p, owner[p]) for t in set(some[1:]) for p in range(len(flat)) if flat[p] == t)


def test_token_files_odd(spark, table, odd):
    folder = token_folder(spark)
    write_tokens(table(odd), folder, shard_bytes=50_000, segment_bytes=10_000)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.start, r.n_tokens) for r in read_tokens(spark, folder).collect())
    assert [g[0][1] for g in got] == [1, 2, 3, 4, 4, 5, 6, 7, 0, 0] and [g[2] for g in got][:2] == [1, 1]
    assert [g[1] for g in got] == np.cumsum([0, *[g[2] for g in got][:-1]]).tolist()
    empty = token_folder(spark)
    write_tokens(table([]), empty)
    assert read_tokens(spark, empty).count() == count_tokens(spark, empty, [2]).count() == token_at(spark, empty, []).count() == 0


# --- centroid clustering ---


def clusters(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign()
    within = [sum(d for d, c in at if c == j) for j in range(len(centroids))]
    long = lambda v: v if v < 2**63 else None
    digest = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return sorted((str(i), c, str(long(d)), str(long(within[c])), str(long(sum(within))), digest(c)) for (i, _), (d, c) in zip(kept, at, strict=True))


def got_clusters(spark, rows, k, rounds, dims, scale):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, vector int").repartition(5)
    return sorted((str(r.vec_id), r.cluster, str(r.distance), str(r.cluster_inertia), str(r.inertia), r.centroid_sha256) for r in cluster_vectors(frame, k, rounds, dims, scale).collect())


def test_centroids(spark):
    rng = random.Random(6)
    rows = [(k, [rng.gauss(k % 5, 1) for _ in range(8)]) for k in range(400)]
    rows += [(7, rows[7][1]), (500, None), (501, [1.0] * 7), (502, [1.0] * 7 + [None]), (503, [float("nan")] + [0.0] * 7), (504, [float("inf")] + [0.0] * 7), (None, [0.5] * 8), (None, [-0.5] * 8), (505, []), (506, [0.0] * 8), (507, [-0.0] * 8)]
    assert got_clusters(spark, rows, 6, 3, 8, 64) == clusters(rows, 6, 3, 8, 64)
    assert got_clusters(spark, rows[:3], 6, 3, 8, 64) == clusters(rows[:3], 6, 3, 8, 64)
    assert got_clusters(spark, [], 6, 3, 8, 64) == []


@pytest.mark.parametrize("size", [1e5, 1e8, 1e15, 1e200, 1.7e308])
def test_centroids_of_any_magnitude(spark, size):
    """Beyond what float64 holds exactly, and beyond 64 bits; ties among them too."""
    rng = random.Random(8)
    rows = [(k, [rng.choice([-1.0, 1.0, 0.5, 1e-3]) * rng.choice([1.0, size]) for _ in range(4)]) for k in range(60)]
    assert got_clusters(spark, rows, 5, 2, 4, 64) == clusters([(i, [int(x) if abs(x) > 2**53 else x for x in v]) for i, v in rows], 5, 2, 4, 64)


def test_products_equal_differences():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-2000, 2000, (500, 16)).astype(float), rng.integers(-2000, 2000, (7, 16)).tolist()
    at, distance = nearest(x, c)
    d = ((x[:, None].astype(int) - np.array(c)[None]) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and distance == d.min(axis=1).tolist()
    assert whole(np.array([[1e308, -0.01]]), 64).tolist() == [[int(1e308) * 64, -1]]
