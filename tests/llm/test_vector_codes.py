"""Vector codes against plain integer arithmetic."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest

from marketspark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, error int"


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows):
    kept = [(i, [math.floor(4096 * int(single(x)) if abs(x) > 1e15 else 4096 * single(x)) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // 8) * 8
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    w = width // 8
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[v[p * w : (p + 1) * w] for _, v, _ in order] for p in range(8)]

    def assign(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * w : (p + 1) * w], c)) for c in books[p]]
        return min(range(len(d)), key=lambda e: (d[e], e)), min(d)

    for _ in range(6):
        for p in range(8):
            at = {}
            for _, v, _ in kept:
                at.setdefault(assign(v, p)[0], []).append(v[p * w : (p + 1) * w])
            for e, mine in at.items():
                books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, [assign(v, p) for p in range(8)], label) for i, v, label in kept]
    of_label = {}
    for _, f, label in found:
        of_label[label] = of_label.get(label, 0) + sum(d for _, d in f)
    sha = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    long = lambda n: n if n < 1 << 63 else None
    out = [(i, "".join(f"{e:02x}" for e, _ in f), long(sum(d for _, d in f)), long(of_label[label]), sha) for i, f, label in found]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=str)


def vectors(seed, n, dims, scale=1.0):
    rng = random.Random(seed)
    grid = [single(rng.uniform(-scale, scale)) for _ in range(9)]
    pick = lambda: rng.choice(grid) if rng.random() < 0.5 else single(rng.gauss(0, scale))
    rows = [(i, [pick() for _ in range(dims)], rng.choice([1, 2, None]), "clash", 0) for i in range(n)]
    return rows + [(n + 1, rows[0][1], 1, "copy", 0)] * 40


@pytest.mark.parametrize("seed,n,dims", [(1, 120, 64), (2, 60, 24), (3, 9, 8), (4, 70, 21)])
def test_codes(spark, seed, n, dims):
    rows = vectors(seed, n, dims)
    assert got(vector_codes.query(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_odd_rows(spark):
    """Null, non-finite, short, huge, repeated and unnamed vectors; an empty table."""
    rows = vectors(5, 30, 16) + [(None, [0.5] * 16, None, "", 0), (50, None, 1, "", 0), (51, [1.0, None] * 8, 1, "", 0), (0, [0.25] * 16, 1, "", 0)]
    rows += [(52, [float("nan")] * 16, 1, "", 0), (53, [float("-inf")] * 16, 1, "", 0), (54, [1.0] * 3, 2, "", 0), (55, [], 2, "", 0)]
    assert got(vector_codes.query(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    rows += [(60, [single(3e38)] * 16, 1, "", 0), (61, [single(-3e38)] + [0.1] * 15, 3, "", 0), (62, [single(1e6)] * 16, 4, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(vector_codes.query(df)) == brute(rows)
    assert vector_codes.query(df.where("vec_id < 0")).collect() == []
    assert len(got(vector_codes.query(df.where("vec_id = 55")))) == 1


def test_transform_keeps_distances():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 8, 13):
        a, c = rng.integers(-50, 50, (300, width)), rng.integers(-50, 50, (16, width))
        n = len(vector_codes.transform(a)[0])
        assert n >= width and n & (n - 1) == 0
        plain = ((a[:, None] - c[None]) ** 2).sum(2)
        index, distance = vector_codes.nearest(a, c)
        assert (index == plain.argmin(1)).all() and (distance == plain.min(1)).all()
    changes = vector_codes.transform(np.eye(8, dtype=np.int64)).T
    assert [(row[1:] != row[:-1]).sum() for row in changes] == list(range(8))
