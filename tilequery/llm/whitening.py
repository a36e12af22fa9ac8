"""Whitening of embeddings: eigenvalues isolated by LDLᵀ inertia counts, eigenvectors by Rayleigh quotient iteration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequery.llm.folds import send
from tilequery.session import materialize

#: steps per unit and offset of the whole numbers that vectors are rounded down to
STEPS, OFFSET = 64, 1_000_000
#: longest vector; its covariance has this many rows on the driver
MOST_DIMS = 4096
#: rows handled at once
ROWS = 4096
_ALPHA = (1 + 17**0.5) / 8  # Bunch and Parlett's bound between one-row and two-row pivots
_EPS = np.finfo(float).eps


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """How many eigenvalues of the symmetric ``a`` are negative, zero and positive, from the pivots of its LDLᵀ factors (Sylvester)."""
    a = np.array(a, dtype=float)
    n, k = len(a), 0
    signs = [0, 0, 0]
    while k < n:
        rest = a[k:, k:]
        diagonal = np.abs(np.diagonal(rest))
        p = int(diagonal.argmax())
        off = np.abs(np.tril(rest, -1))
        i, j = divmod(int(off.argmax()), n - k)
        if diagonal[p] == 0 and off[i, j] == 0:
            signs[1] += n - k
            break
        if diagonal[p] >= _ALPHA * off[i, j]:
            _swap(a, k, k + p)
            d = a[k, k]
            signs[0 if d < 0 else 2] += 1
            column = a[k + 1 :, k] / d
            a[k + 1 :, k + 1 :] -= np.outer(column, a[k, k + 1 :])
            k += 1
        else:  # the largest entry stands beside the diagonal: a pivot of two rows, one eigenvalue of each sign
            _swap(a, k, k + j)
            _swap(a, k + 1, k + i if i != 0 else k + j)
            signs[0] += 1
            signs[2] += 1
            pair = a[k : k + 2, k : k + 2].copy()
            below = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(pair, below.T)
            k += 2
        a[k:, k:] = (a[k:, k:] + a[k:, k:].T) / 2
    return tuple(signs)


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` exceed ``shift``."""
    return inertia(v - shift * np.eye(len(v)))[2]


class Slice:
    """An interval (low, high] and the numbers of the eigenvalues in it, from 1 by falling value."""

    def __init__(self, low: float, high: float, first: int, last: int):
        self.low, self.high, self.first, self.last = low, high, first, last


def slices(v: np.ndarray, most: int) -> list[Slice]:
    """Intervals that together hold the ``most`` largest eigenvalues: one each, or several that double precision cannot tell apart.

    The whole spectrum (Gershgorin) is cut at midpoints; a count of eigenvalues above each cut numbers those on both sides.
    """
    reach = np.abs(v).sum(1).max()
    if reach == 0:
        return [Slice(-1.0, 1.0, 1, len(v))]
    tight = 8 * len(v) * _EPS * reach
    out = []
    open_ = [Slice(-1.01 * reach, 1.01 * reach, 1, len(v))]
    while open_:
        s = open_.pop()
        if s.first > most:
            continue
        # a single eigenvalue's interval is narrowed to a part of the distance to its neighbours, for a safe start
        if s.high - s.low <= tight or (s.first == s.last and s.high - s.low <= 1e-4 * reach):
            out.append(s)
            continue
        middle = (s.low + s.high) / 2
        n = above(v, middle)
        if n >= s.first:
            open_.append(Slice(middle, s.high, s.first, min(n, s.last)))
        if n < s.last:
            open_.append(Slice(s.low, middle, max(n + 1, s.first), s.last))
    return sorted(out, key=lambda s: s.first)


def _solve(v: np.ndarray, shift: float, rhs: np.ndarray, reach: float) -> np.ndarray:
    """(v - shift) y = rhs; a shift that is an eigenvalue to the last bit is moved by one rounding step."""
    for step in (0.0, _EPS, 4 * _EPS):
        try:
            y = np.linalg.solve(v - (shift + step * reach) * np.eye(len(v)), rhs)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all():
            return y
    raise ArithmeticError("no solution near an eigenvalue")


def eigenpair(v: np.ndarray, s: Slice, found: np.ndarray, reach: float) -> tuple[float, np.ndarray]:
    """The one eigenvalue in ``s`` with its unit vector, by Rayleigh quotient iteration kept inside the interval."""
    rng = np.random.default_rng(s.first)
    x = rng.standard_normal(len(v))
    value = (s.low + s.high) / 2
    best, best_x = np.inf, x
    slack = 16 * len(v) * _EPS * reach
    for _ in range(60):
        x = _solve(v, value, x, reach)
        x -= found @ (found.T @ x)
        x /= np.linalg.norm(x)
        quotient = float(x @ v @ x)
        rest = float(np.linalg.norm(v @ x - quotient * x))
        if s.low - slack < quotient <= s.high + slack:
            better = rest < best / 2
            if rest < best:
                best, best_x = rest, x
            if not better and best <= 4 * slack:
                break
            value = quotient
        else:  # it ran off to another eigenvalue: narrow the interval by a count and begin from its middle
            if s.high - s.low > slack:
                middle = (s.low + s.high) / 2
                s = Slice(middle, s.high, s.first, s.last) if above(v, middle) >= s.first else Slice(s.low, middle, s.first, s.last)
            value = (s.low + s.high) / 2
    if best > 1e-9 * reach:
        raise ArithmeticError(f"eigenvalue {s.first} did not converge: residual {best}")
    return float(best_x @ v @ best_x), best_x


def eigenspace(v: np.ndarray, s: Slice, found: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that cannot be told apart, with an orthonormal basis of their space, by inverse iteration on a block."""
    x = np.random.default_rng(s.first).standard_normal((len(v), s.last - s.first + 1))
    for _ in range(6):
        x = _solve(v, (s.low + s.high) / 2, x, reach)
        for _ in range(2):
            x -= found @ (found.T @ x)
            x, _ = np.linalg.qr(x)
    values = np.einsum("ij,ij->j", x, v @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of the symmetric ``v``, falling, and their unit vectors as columns.

    Each value is certified: counts just below and just above it must give its own number. Raises ArithmeticError if one does not.
    """
    n = len(v)
    reach = float(np.abs(v).sum(1).max()) if n else 0.0
    values, x = np.zeros(0), np.zeros((n, 0))
    if reach == 0:
        return np.zeros(min(most, n)), np.eye(n)[:, :most]
    margin = 64 * n * _EPS * reach
    for s in slices(v, most):
        for _ in range(40):
            if s.first == s.last:
                value, vector = eigenpair(v, s, x, reach)
                for _ in range(2):  # to the last bits at right angles to those before
                    vector = vector - x @ (x.T @ vector)
                    vector /= np.linalg.norm(vector)
                new, vectors = np.array([value]), vector[:, None]
            else:
                new, vectors = eigenspace(v, s, x, reach)
            low, high = above(v, new.min() - margin), above(v, new.max() + margin)
            if low >= s.last and high < s.first:
                break
            # a neighbour's value was found: the counts say on which side the wanted one is
            s = Slice(new.max() + margin, s.high, s.first, s.last) if high >= s.first else Slice(s.low, new.min() - margin, s.first, s.last)
        else:
            raise ArithmeticError(f"eigenvalues {s.first} to {s.last} are not where they were counted")
        values, x = np.concatenate([values, new]), np.concatenate([x, vectors], 1)
    return values[:most], x[:, :most]


def usable(vector: str) -> Column:
    """Neither null nor with a null or non-finite entry."""
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _moments(points: DataFrame, column: str, dims: int, mean: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
    """Sums of products of the centred rows (times ``by``, if given), a matrix of fixed size; summed in tasks first, then by Spark."""
    held = send(points.sparkSession, (mean, by))
    width = dims if by is None else by.shape[1]

    def run(batches):
        mean, by = held()
        total = np.zeros((width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(0), part.num_rows) - mean
                x = x if by is None else x @ by
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = points.select(column).mapInArrow(run, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in cells.collect():  # width * width rows
        out[r.i, r.j] = r.v
    return (out + out.T) / 2


def _whiten_one(rows: DataFrame, dims: int, most: int, floor: float) -> DataFrame:
    """Rows (vec_id, x) of one vector length."""
    spark = rows.sparkSession
    points = materialize(rows.select("x").distinct())
    n = points.count()

    def add(batches):
        total = [0] * dims
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(0), part.num_rows)
                total = [a + int(b) for a, b in zip(total, x.sum(0, dtype=object) if np.abs(x).max() > 2**50 else x.sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total])], ["i", "s"])

    sums = points.mapInArrow(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    s = [0] * dims
    for r in sums.collect():
        s[r.i] = int(r.s)
    # whole numbers first, so that the mean's rounding is of the size of the spread only
    base = np.array([t // n for t in s], np.int64)
    mean = base + np.array([(t % n) / n for t in s])
    v = _moments(points, "x", dims, mean) / n
    values, vectors = leading(v, min(most, dims))
    trace = float(np.trace(v))
    keep = values > floor * trace
    values, vectors = values[keep], vectors[:, keep]
    if not len(values):
        return rows.select("vec_id").limit(0).selectExpr("vec_id", *[f"cast(null as {t}) {c}" for c, t in (f.split() for f in _OUT.split(", ")[1:])])
    by = vectors / np.sqrt(values)
    error = float(np.abs(_moments(points, "x", dims, mean, by) / n - np.eye(len(values))).max())
    held = send(spark, (n, s, mean, by, values / trace, error))

    def project(batches):
        n, s, mean, by, explained, error = held()
        k = by.shape[1]
        exact = np.array(s, object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                m = part.num_rows
                x = _matrix(part.column("x"), m)
                w = (x - mean) @ by
                far = float(np.abs((x - mean) * n).max()) + n
                if 4 * far * far * x.shape[1] < 2**62 and max(map(abs, s)) < 2**62 and float(np.abs(x).max()) * n < 2**62:
                    deviation = pa.array(((n * x - np.array(s, np.int64)) ** 2).sum(1))
                else:  # whole numbers beyond 64 bits on the way
                    sums = [int(t) for t in ((n * x.astype(object) - exact) ** 2).sum(1)]
                    deviation = pa.array([t if t < 2**63 else None for t in sums], pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                ids = part.column("vec_id").take(each)
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), deviation.take(each)]
                columns += [pa.array(w.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _OUT.split(", ")])

    return rows.mapInArrow(project, _OUT)


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_: str, vector: str, most: int = 16, floor: float = 1e-12) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per usable row of ``vectors`` and component.

    Rows whose vector is null or holds null or non-finite entries are left out (a null id is not). An entry c is taken as
    floor(64 c) + 1000000, a whole number x. The fit list is each distinct vector x once: ``n`` of them, with sums S and covariance V (divisor
    n). Component k is the unit eigenvector of V's k-th largest eigenvalue e; ``whitened`` is x - S/n on it over sqrt(e), ``explained`` e over V's trace,
    ``deviation`` the exact sum of (n x - S)² over the dimensions (null beyond 64 bits), ``identity_error`` the largest
    entry of the whitened fit list's covariance minus the identity. At most ``most`` components; those with an
    eigenvalue up to ``floor`` of the trace cannot be whitened and are left out, so a single distinct vector gives no rows. Equal
    eigenvalues share their space and get some orthonormal basis of it, the same for all rows. Repeated rows are returned as often as they
    stand. Vectors of different lengths are fitted apart; empty vectors and empty tables give no rows.

    Only n, S, V and the whitened covariance reach the driver, matrices of the vector's length at most.
    """
    entries = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * STEPS).cast("long") + OFFSET)
    rows = materialize(vectors.filter(usable(vector)).select(F.col(id_).cast("long").alias("vec_id"), entries.alias("x")).filter(F.size("x") > 0))
    lengths = [r[0] for r in rows.select(F.size("x")).distinct().orderBy(F.size("x")).limit(MOST_DIMS + 1).collect()]
    if lengths and lengths[-1] > MOST_DIMS:
        raise ValueError(f"vectors of more than {MOST_DIMS} entries")
    out = None
    for dims in lengths:
        part = _whiten_one(rows.filter(F.size("x") == dims), dims, most, floor)
        out = part if out is None else out.unionByName(part)
    return vectors.sparkSession.createDataFrame([], _OUT) if out is None else out
