"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Every entry c becomes the whole number x = floor(64 c) + 1000000, so counts, sums and deviations are
exact. Vectors are packed once into blocks of the smallest integer type that holds them; each
step then reads one or two bytes an entry.

One step is one pass over the blocks. With X the centred rows, it makes ``u = X q`` inside the tasks,
where ``q = v_j - beta p_(j-1)`` and ``u_i = X p_i`` stands for every earlier left vector (rows never
leave their task: a left vector is kept as its d coefficients), and adds up ``X' u`` and ``u' u``. Inner products
with all earlier left vectors follow from ``X' u``, and both sides are orthogonalised fully, twice on
the right. A vanishing ``beta`` (a repeated eigenvalue or an invariant space) is answered by a fresh vector
orthogonal to all others, a vanishing ``alpha`` by a zero left vector. All d steps are taken, so the
small bidiagonal matrix is a complete image of X and its SVD gives all right vectors; the small
matrices (d x d) are the only things on the driver. Each pass sums d + 1 numbers a partition by Spark.

Rows whose vector is null or holds a null, NaN or infinite entry are dropped. Shorter vectors are extended by
zeros to the longest one's length. Numbers beyond the range of a long are held at its ends. Repeated rows and
rows without an id count like any others. A deviation beyond the range of a long is null.
Components with no variance to speak of (below 1e-12 of the first) can't be whitened and aren't
returned; equal rows alone, empty vectors and an empty table give no rows. Columns other than the id and
the vector are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from touchline.llm.common import stored

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
# Vectors packed into one row, whatever their length up to this many entries a block.
BLOCK_ROWS, BLOCK_ENTRIES = 8_192, 1 << 16
FLAT = 1e-12
_LONG = 2**63 - 1


def packed(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """Blocks (ids, n, kind, data) of the usable vectors as floor(64 c), and the longest length."""
    entries = F.col(vector_column).cast("array<double>")
    usable = vectors.select(F.col(id_column).alias("id"), entries.alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    size = usable.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0
    id_type = usable.schema["id"].dataType
    schema = f"ids array<{id_type.simpleString()}>, n int, kind string, data binary"

    def pack(batches):
        rows_at_once = max(1, min(BLOCK_ROWS, BLOCK_ENTRIES // max(1, size)))
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(start, rows_at_once)
                lists = part.column(1)
                flat, lengths = lists.flatten().to_numpy(False), lists.value_lengths().to_numpy(False)
                whole = np.zeros((part.num_rows, size))
                whole[np.arange(size) < lengths[:, None]] = flat
                with np.errstate(over="ignore"):
                    scaled = np.floor(SCALE * whole)
                y = np.where(np.abs(scaled) < 2.0**62, scaled, 0).astype(np.int64)
                y = np.where(scaled >= 2.0**62, 2**62, np.where(scaled <= -(2.0**62), -(2**62), y))
                kind = next(t for t in ("int8", "int16", "int32", "int64") if np.iinfo(t).min <= y.min() and y.max() <= np.iinfo(t).max)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
                        pa.array([part.num_rows], pa.int32()),
                        pa.array([kind]),
                        pa.array([y.astype(kind).tobytes()], pa.binary()),
                    ],
                    ["ids", "n", "kind", "data"],
                )

    if not size:
        return vectors.sparkSession.createDataFrame([], schema), 0
    return stored(usable.mapInArrow(pack, schema), "vector-blocks"), size


def blocks_of(batches, size: int):
    """The integer matrices of packed rows, with the position of ``kind`` and ``data`` by name."""
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data")):
            yield np.frombuffer(data.as_buffer(), kind).reshape(-1, size)


def summed(blocks: DataFrame, size: int, slots: int, partial) -> np.ndarray:
    """The sum over all blocks of ``partial(matrix)``, a vector of ``slots`` numbers."""

    def add(batches):
        total = np.zeros(slots)
        for y in blocks_of(batches, size):
            total += partial(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots, dtype=np.int32)), pa.array(total)], ["slot", "v"])

    sums = blocks.select("kind", "data").mapInArrow(add, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v"))
    found = np.zeros(slots)
    for row in sums.collect():  # as many rows as slots
        found[row["slot"]] = row["v"]
    return found


def exact_sums(blocks: DataFrame, size: int) -> tuple[int, list[int], int]:
    """Number of vectors, sum by dimension, and the largest absolute entry; exact at any size."""

    def add(batches):
        total, count, most = [0] * size, 0, 0
        for y in blocks_of(batches, size):
            most = max(most, abs(int(y.min())), abs(int(y.max())))
            count += len(y)
            safe = int(np.abs(y).max()) * len(y) < 2**62 if len(y) else True
            column = y.sum(0, dtype=np.int64) if safe else y.astype(object).sum(0)
            total = [a + int(b) for a, b in zip(total, column)]
        values = [Decimal(x) for x in (*total, count)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(size + 1), pa.int32()),
                pa.array(values, pa.decimal128(38, 0)),
                pa.array([Decimal(most)] * (size + 1), pa.decimal128(38, 0)),
            ],
            ["slot", "v", "most"],
        )

    sums = blocks.select("kind", "data").mapInArrow(add, "slot int, v decimal(38,0), most decimal(38,0)")
    rows = sums.groupBy("slot").agg(F.sum("v").cast("decimal(38,0)").alias("v"), F.max("most").alias("most")).collect()
    by_slot = {row["slot"]: int(row["v"]) for row in rows}
    return by_slot.get(size, 0), [by_slot.get(i, 0) for i in range(size)], max((int(row["most"]) for row in rows), default=0)


def against(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``vector`` made orthogonal to ``basis``, twice."""
    for _ in range(2 if basis else 0):
        rows = np.array(basis)
        vector = vector - rows.T @ (rows @ vector)
    return vector


def bidiagonalise(product, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Right singular vectors (rows), squared singular values, both by falling value, and the steps' scale.

    ``product(q)`` is one pass: X'Xq and the squared length of Xq.
    """
    draws = np.random.default_rng(11)
    right: list[np.ndarray] = []
    lefts: list[np.ndarray] = []  # p_i with u_i = X p_i
    images: list[np.ndarray] = []  # X' u_i
    upper = np.zeros((size, size))
    start = draws.normal(size=size)
    v, beta, scale = start / np.linalg.norm(start), 0.0, 0.0
    for j in range(size):
        right.append(v)
        q = v - beta * lefts[-1] if lefts and beta else v
        image, length = product(q)
        # u'u_i for all earlier i; rounding leaves what little there is.
        h = np.array([p @ image for p in lefts]) if lefts else np.zeros(0)
        for i, c in enumerate(h):
            q, image = q - c * lefts[i], image - c * images[i]
        alpha = float(np.sqrt(max(0.0, length - h @ h)))
        scale = max(scale, alpha)
        if alpha <= 1e-13 * scale or alpha == 0.0:
            alpha, q, image = 0.0, np.zeros(size), np.zeros(size)
        else:
            q, image = q / alpha, image / alpha
        lefts.append(q)
        images.append(image)
        upper[j, j] = alpha
        if j + 1 == size:
            break
        rest = against(image - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        if beta <= 1e-13 * scale or beta == 0.0:
            beta, rest = 0.0, against(draws.normal(size=size), right)
        upper[j, j + 1] = beta
        v = against(rest / np.linalg.norm(rest), right)
        v /= np.linalg.norm(v)
    _, singular, turned = np.linalg.svd(upper)
    return turned @ np.array(right), singular**2, scale


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component."""
    blocks, size = packed(vectors, id_column, vector_column)
    id_type = blocks.schema["ids"].dataType.elementType
    schema = (
        f"{id_column} {id_type.simpleString()}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double"
    )
    none = vectors.sparkSession.createDataFrame([], schema)
    n, sums, most = exact_sums(blocks, size) if size else (0, [], 0)
    if not n:
        return none
    mean = np.array([float(Decimal(s) / Decimal(n)) for s in sums])

    def one_step(q):
        def partial(y):
            centred = y.astype(np.float64)
            centred -= mean
            u = centred @ q
            return np.append(centred.T @ u, u @ u)

        both = summed(blocks, size, size + 1, partial)
        return both[:-1], both[-1]

    def spread(y):
        centred = y.astype(np.float64)
        centred -= mean
        return np.append(centred.sum(0), (centred * centred).sum())

    moments = summed(blocks, size, size + 1, spread)
    residue, trace = moments[:-1] / n, moments[-1] / n
    if trace <= 0:
        return none
    turned, squares, _ = bidiagonalise(one_step, size)
    values = squares / n
    kept = int(min(components, (values > FLAT * values[0]).sum()))
    loadings = turned[:kept].T
    explained = values[:kept] / trace
    whitening = loadings / np.sqrt(values[:kept])
    middle = residue @ whitening

    def covariance(y):
        w = (y.astype(np.float64) - mean) @ whitening - middle
        return (w.T @ w).ravel()

    measured = summed(blocks, size, kept * kept, covariance).reshape(kept, kept) / n
    error = float(np.abs(measured - np.eye(kept)).max())
    furthest = n * most + max(map(abs, sums))  # no |n x - S| is larger
    narrow = size * furthest * furthest < 2**63

    def rows(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            for place, y in enumerate(blocks_of([batch], size)):
                ids = batch.column("ids")[place].values
                apart = y.astype(np.int64 if furthest < 2**63 else object) * n - np.array(sums, np.int64 if furthest < 2**63 else object)
                if narrow:
                    deviation = pa.array((apart * apart).sum(1))
                else:
                    exact = [sum(int(a) ** 2 for a in row) for row in apart]
                    deviation = pa.array([e if e <= _LONG else None for e in exact], pa.int64())
                projected = (apart / n).astype(np.float64) @ whitening
                again = pa.array(np.repeat(np.arange(len(y)), kept))
                count = len(y) * kept
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(again).cast(to_arrow_type(id_type)),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(y))),
                        pa.array(np.full(count, n)),
                        deviation.take(again),
                        pa.array(projected.ravel()),
                        pa.array(np.tile(explained, len(y))),
                        pa.array(np.full(count, error)),
                    ],
                    [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return blocks.mapInArrow(rows, schema)
