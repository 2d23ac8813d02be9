"""Vector code compression: product codes found by an integer Walsh-Hadamard transform, without floating point.

Parts and codebook entries are padded with zeros to a power of two and transformed by sums and
differences alone. The transform multiplies every squared distance by the padded length, so nearest
entries stay nearest, and it gathers most of a smooth part's difference in the low sequencies. The
squared differences are summed in that order; an entry is dropped as soon as its sum exceeds the whole
distance of the entry that led after the first term (at equality, if its index is not lower).

Codebooks are learnt in rounds: each task adds up the parts it assigns, and the sums of 8 x 16
entries, a size fixed by parameters, meet on the driver. No vector leaves its task before the codes.

Vectors that are null or hold null or non-finite components are left out. Shorter vectors than the
longest count as padded with zeros, as does a length that the parts do not divide. Repeated rows and
ids are rows of their own; a null id sorts last. Components are read as single precision. Sums are
exact at any size: past 64 bits they are Python integers, and an ``error`` or ``label_error`` that
exceeds a long is null. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marketspark.llm.common import materialize

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LIMB = 32  # bits of a piece of an exact sum
SPREAD = 16  # pieces a label's rows are split into when they meet its sum


def sequency_order(n: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix of size ``n`` by their number of sign changes."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < n:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1), kind="stable")


def transform(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, padded to a power of two, in order of sequency."""
    n = 1
    while n < values.shape[-1]:
        n *= 2
    out = np.zeros((*values.shape[:-1], n), values.dtype)
    out[..., : values.shape[-1]] = values
    step = 1
    while step < n:
        pairs = out.reshape(*out.shape[:-1], n // (2 * step), 2, step)
        out = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], -2).reshape(out.shape)
        step *= 2
    return out[..., sequency_order(n)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``parts`` the index of its nearest entry, the least at ties, and its squared distance."""
    x, c = transform(parts), transform(entries)
    n, width = x.shape
    start = (x[:, None, 0] - c[None, :, 0]) ** 2
    seed = np.array(np.argmin(start, 1), np.int64)
    bound = ((x - c[seed]) ** 2).sum(1)  # whole scaled distance of the seed
    rows, at = np.nonzero((start < bound[:, None]) | ((start == bound[:, None]) & (np.arange(len(c)) < seed[:, None])))
    total = start[rows, at]
    for s in range(1, width):
        total = total + (x[rows, s] - c[at, s]) ** 2
        keep = (total < bound[rows]) | ((total == bound[rows]) & (at < seed[rows]))
        rows, at, total = rows[keep], at[keep], total[keep]
    # Of those that beat the seed, the least distance, then the least index (pairs are in that order).
    order = np.lexsort((at, total, rows)) if total.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], total[i], at[i])), np.int64)
    rows, at, total = rows[order], at[order], total[order]
    head = np.ones(len(rows), bool)
    head[1:] = rows[1:] != rows[:-1]
    seed[rows[head]], bound[rows[head]] = at[head], total[head]
    return seed, bound // width


def integers(vectors: pd.Series, width: int) -> np.ndarray:
    """``floor(SCALE * x)`` of every component, padded to ``width``; 64 bits if no distance can exceed them."""
    flat = np.zeros((len(vectors), width), np.float64)
    for i, v in enumerate(vectors):
        flat[i, : len(v)] = v
    scaled = np.floor(flat * SCALE)  # exact: a single's product with a power of two
    if np.abs(scaled).max(initial=0) * width < 2**29:
        return scaled.astype(np.int64)
    return np.array([[int(v) for v in row] for row in scaled], object).reshape(flat.shape)


def _match(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance per row and part; ``books`` is part x entry x position."""
    if values.dtype != books.dtype:
        values, books = values.astype(object), books.astype(object)
    cut = values.reshape(len(values), len(books), books.shape[2])
    found = [nearest(cut[:, p], books[p]) for p in range(len(books))]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """Pieces of 32 bits whose sums over all tasks stay within a long; the last one has the sign."""
    place = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield place, value & ((1 << LIMB) - 1)
        value >>= LIMB
        place += 1
    yield place, value


def _sums(kept: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """``(part, entry, position, limb, total)`` of the parts assigned to each entry; position -1 counts them."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((*books.shape[:2], books.shape[2] + 1), object)
        for batch in batches:
            values = integers(batch["vector"], width)
            index, _ = _match(values, books)
            cut = values.reshape(len(values), len(books), books.shape[2])
            for p in range(len(books)):
                for e in np.unique(index[:, p]):
                    mine = cut[index[:, p] == e, p]
                    totals[p, e, 0] += len(mine)
                    totals[p, e, 1:] += mine.sum(0).astype(object)
        rows = [(p, e, at - 1, limb, piece) for (p, e, at), v in np.ndenumerate(totals) if v for limb, piece in _limbs(int(v))]
        yield pd.DataFrame(rows, columns=["part", "entry", "position", "limb", "total"])

    found = kept.select("vector").mapInPandas(add, "part int, entry int, position int, limb int, total long")
    return found.groupBy("part", "entry", "position", "limb").agg(F.sum("total").alias("total"))


def _fitting(books: list) -> np.ndarray:
    wide = np.array(books, object)
    return wide.astype(np.int64) if max((abs(v) for v in wide.flat), default=0) * max(wide.size, 1) < 2**29 else wide


def learn(kept: DataFrame, width: int) -> np.ndarray:
    """Codebooks as part x entry x position, integers; ``kept(vec_id, vector)`` holds finite vectors."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).toPandas()
    start = integers(first["vector"], width).reshape(len(first), PARTS, width // PARTS)
    books = _fitting(start.transpose(1, 0, 2).tolist())
    for _ in range(ROUNDS if width else 0):
        totals: dict[tuple[int, int, int], int] = {}
        for r in _sums(kept, books, width).collect():  # of 8 x 16 entries
            at = (r["part"], r["entry"], r["position"])
            totals[at] = totals.get(at, 0) + (r["total"] << (LIMB * r["limb"]))
        new = books.astype(object)
        for (p, e, position), count in totals.items():
            if position < 0:
                new[p, e] = [totals.get((p, e, i), 0) // count for i in range(books.shape[2])]
        books = _fitting(new.tolist())
    return books


def coded(kept: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """``(vec_id, label, code, error)`` per row of ``kept``."""
    kind = kept.schema["vec_id"].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if width:
                index, distance = _match(integers(batch["vector"], width), books)
            else:
                index = distance = np.zeros((len(batch), PARTS), np.int64)
            errors = [int(sum(row)) for row in distance.tolist()]
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].astype("string"),
                "label": batch["label"].astype("string"),
                "code": ["".join(f"{i:02x}" for i in row) for row in index.tolist()],
                "error": pd.array([e if e < 1 << 63 else None for e in errors], "Int64"),
            })

    found = kept.select(F.col("vec_id").cast("string"), F.col("label").cast("string"), "vector").mapInPandas(encode, "vec_id string, label string, code string, error long")
    return found.withColumn("vec_id", F.col("vec_id").cast(kind))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.flat).encode()).hexdigest()


def query(embeddings: DataFrame) -> DataFrame:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = embeddings.select("vec_id", "label", F.col("embedding").cast("array<float>").alias("vector")).where(F.col("vector").isNotNull() & finite)
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    books = learn(kept, width)
    codes = materialize(coded(kept, books, width), "vector-codes")
    # A label may hold most rows: its sum stands once for each piece, and each row picks a piece.
    sums = codes.groupBy("label").agg(F.expr("try_sum(CAST(error AS DECIMAL(38, 0)))").alias("total"), F.count_if(F.col("error").isNull()).alias("lost"))
    sums = materialize(sums.select("label", F.when(F.col("lost") == 0, F.expr("try_cast(total AS BIGINT)")).alias("label_error")), "vector-labels")
    pieces = sums.select(F.col("label").alias("of_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("piece"))
    own = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SPREAD)).cast("int")
    return codes.join(pieces, F.col("label").eqNullSafe(F.col("of_label")) & (own == F.col("piece"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def _sql() -> str:
    """Every round as two steps over (vector, part); lists are compared and summed position by position."""
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT row, p.part, v[p.part * len(v) // {PARTS} + 1 : (p.part + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) AS p(part)),
book0 AS (SELECT part, row - 1 AS entry, x AS c FROM parts WHERE row <= {ENTRIES})"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""found{r} AS MATERIALIZED (
  SELECT row, part, x, min(struct_pack(d := d, e := entry)) AS best
  FROM (SELECT a.row, a.part, a.x, b.entry, list_sum(list_transform(list_zip(a.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts a JOIN book{r} b USING (part)) GROUP BY row, part, x)""")
        if r < ROUNDS:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY i) AS c FROM (
      SELECT part, best.e AS entry, u.i, floor(sum(x[u.i])::DOUBLE / count(*))::BIGINT AS mean
      FROM found{r}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY part, best.e, u.i) GROUP BY part, entry) m USING (part, entry))""")
    steps.append(f"""codes AS (
  SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM found{ROUNDS} GROUP BY row),
hash AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM book{ROUNDS})
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept k JOIN codes c USING (row), hash""")
    return ",\n".join(steps[:-1]) + ",\n" + steps[-1]


SQL = _sql()
