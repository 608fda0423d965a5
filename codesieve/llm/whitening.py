"""Embedding whitening by block Jacobi-Davidson.

Entries become whole numbers, ``x = floor(scale * c) + offset``.  The model is fitted on the
fit list, each distinct x vector once, kept in blocks of rows.  The covariance V of the fit list is
never formed: a distributed pass computes V Q for a few columns Q, each task centring its rows and
adding up ``Y' (Y Q)``; sums of tasks are added in a second, salted step, so that the driver sees at
most ``MERGED`` matrices as large as Q.

Around that product:

* Rayleigh-Ritz in the search space gives Ritz pairs and residuals;
* leading pairs whose residuals have reached double precision (``SLACK`` units in the last place
  of the largest eigenvalue, or where rounding stops them falling) are locked;
* for the others the projected correction equation
  ``(I - UU')(V - theta I)(I - UU') t = -r`` is solved by some steps of MINRES, all columns in one
  product a step, U being the locked vectors and the pairs at hand;
* the corrections widen the search space, which is restarted with its best Ritz vectors when full.

Whole numbers are centred about the whole number next to the mean, and what is left of the mean is
subtracted after: no digits are lost to the offset.

``Whitening.apply`` gives for each row and component n, the row's exact squared deviation
``sum((n x - S)^2)`` (null where it needs more than 63 bits), the whitened coordinate and the explained
share; ``identity_error`` is the largest entry of the whitened fit list's covariance less the identity.

Edge cases: a null vector, or one with null, non-finite or larger entries than ``LARGEST``, takes no part.
Vectors of each length are whitened among their own kind.  A null id stays.  Repeated rows each give their rows, and
count once in the fit.  Directions without variance (all but rounding) are no components, so few or equal vectors give few
or none; an empty table or empty vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm import common as C

LARGEST = float(1 << 40)
SLACK = 64
BLOCK_BYTES = 2 << 20
TASK_BYTES = 8 << 20
MERGED = 64
EPS = float(np.finfo(np.float64).eps)
Product = Callable[[np.ndarray], np.ndarray]


def minres(product: Product, held: np.ndarray, theta: np.ndarray, rhs: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Each column t of ``P (V - theta I) P t = rhs`` with ``P = I - held held'``, by at most
    ``steps`` steps of MINRES; all columns share a step's product."""
    def projected(y):
        return y - held @ (held.T @ y)

    out = np.zeros_like(rhs)
    b = np.linalg.norm(rhs, axis=0)
    safe = lambda x: np.where(x > 0, x, 1.0)
    v, v_old, w, w_old = rhs / safe(b), out.copy(), out.copy(), out.copy()
    c = c_old = np.ones(len(b))
    s = s_old = np.zeros(len(b))
    eta, beta = b.copy(), np.zeros(len(b))
    for _ in range(steps):
        p = projected(product(v) - theta * v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        after = np.linalg.norm(p, axis=0)
        r0, r2, r3 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta, s_old * beta
        r1 = np.hypot(r0, after)
        alive = r1 > EPS * np.abs(theta).max(initial=EPS)
        w, w_old = np.where(alive, (v - r3 * w_old - r2 * w) / safe(r1), 0), w
        c_old, s_old = c, s
        c, s = np.where(alive, r0 / safe(r1), 1), np.where(alive, after / safe(r1), 0)
        out = out + c * eta * w
        eta = -s * eta
        v, v_old, beta = p / safe(after), v, after
        if (np.abs(eta) <= enough * b).all():
            break
    return projected(out)


def _orthonormal(columns: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of ``columns`` less what lies in ``against``; near
    dependent columns are left out."""
    kept = np.empty((len(columns), 0))
    for t in columns.T:
        size = np.linalg.norm(t)
        t = t / size if size else t
        for _ in range(3):
            t = t - against @ (against.T @ t)
            t = t - kept @ (kept.T @ t)
        left = np.linalg.norm(t)
        if left > 1e-10:
            t = t / left
            t = t - against @ (against.T @ t)
            t = t - kept @ (kept.T @ t)
            kept = np.column_stack([kept, t / np.linalg.norm(t)])
    return kept


def leading_pairs(product: Product, dim: int, k: int, guard: int = 8, steps: int = 8, rounds: int = 200, seed: int = 11):
    """The ``k`` largest eigenvalues, falling, their unit vectors and the norms of
    their residuals, for the symmetric, non-negative matrix behind ``product``."""
    k = min(k, dim)
    width = min(dim, k + guard)
    widest = min(dim, 4 * (k + guard))
    locked, values, residuals = np.empty((dim, 0)), [], []
    basis = _orthonormal(np.random.default_rng(seed).normal(size=(dim, width)), locked)
    images = product(basis)
    top, last = 0.0, None
    for turn in range(rounds):
        theta, rotation = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
        rotation = rotation[:, ::-1][:, :width]
        theta, ritz, image = theta[::-1][:width], basis @ rotation, images @ rotation
        top = max(top, abs(theta[0]) if len(theta) else 0, *values[:1])
        rest = image - ritz * theta
        rest -= locked @ (locked.T @ rest)
        norms = np.linalg.norm(rest, axis=0)
        full = basis.shape[1] + locked.shape[1] >= dim  # nothing is left to add: as exact as the products
        stuck = last is not None and len(last) == len(norms) and bool((norms >= last / 2)[:k - len(values)].all())
        good = norms <= SLACK * EPS * top
        if full or stuck and (norms[:k - len(values)] <= 1e5 * SLACK * EPS * top).all():
            good[:] = True
        n = min(int(np.argmin(good)) if not good.all() else len(good), k - len(values))  # only leading ones, so that none is passed over
        if n:
            locked = np.column_stack([locked, ritz[:, :n]])
            values += theta[:n].tolist()
            residuals += norms[:n].tolist()
            if len(values) == k:
                break
            own = ritz[:, n:]  # the rest of the search space
            others = basis @ np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)[1][:, ::-1][:, width:] if basis.shape[1] > width else own[:, :0]
            space = np.column_stack([own, others])
            weights = basis.T @ space
            basis, images = space, images @ weights
            theta, ritz, image, rest, norms, last = theta[n:], own, image[:, n:], rest[:, n:], norms[n:], None
        else:
            last = norms
        wanted = np.flatnonzero(norms > SLACK * EPS * top)[:k + guard - len(values)]
        held = _orthonormal(ritz, locked)
        held = np.column_stack([locked, held])
        grown = minres(product, held, theta[wanted], -rest[:, wanted], steps, 1e-3)
        if basis.shape[1] + len(wanted) > widest:
            weights = basis.T @ ritz
            basis, images = ritz, images @ weights
        more = _orthonormal(np.column_stack([grown, rest[:, wanted]]), np.column_stack([locked, basis]))[:, :len(wanted)]
        if not more.shape[1]:  # the residuals are rounding: begin anew beside the locked vectors
            more = _orthonormal(np.random.default_rng(seed + turn + 1).normal(size=(dim, guard)), np.column_stack([locked, basis]))
        basis, images = np.column_stack([basis, more]), np.column_stack([images, product(more)])
    else:
        raise RuntimeError(f"{len(values)} of {k} pairs converged in {rounds} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order], np.array(residuals)[order]


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """(vec_id, x array<long>, dim) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("size(v) > 0")
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST)))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset)).alias("x"), F.size("v").alias("dim"))


def _summed(passes: DataFrame, tasks: int, shape: tuple[int, ...], kind: str) -> np.ndarray:
    """The sum of the ``tasks`` arrays ``(task int, data binary)``, in order of tasks."""
    def merge(batches):
        held = sorted((t, d) for b in C.frames(batches) for t, d in zip(b["task"], b["data"], strict=True))
        if held:
            yield pd.DataFrame({"task": [held[0][0]], "data": [sum(np.frombuffer(d, kind) for _, d in held).tobytes()]})

    if tasks > MERGED:  # neighbouring tasks together
        passes = passes.repartition(MERGED, F.floor(F.col("task") * MERGED / tasks)).mapInPandas(merge, "task int, data binary")
    rows = sorted((r.task, bytes(r.data)) for r in passes.collect())
    return sum((np.frombuffer(d, kind) for _, d in rows), np.zeros(int(np.prod(shape)), kind)).reshape(shape)


def _digits(sums: np.ndarray) -> np.ndarray:
    """Sums as high and low parts, so that sums of sums stay exact."""
    return np.concatenate([sums >> 31, sums & ((1 << 31) - 1)])


class FitList:
    """The distinct x vectors of one length in blocks, and passes over them."""

    def __init__(self, rows: DataFrame, dim: int, offset: int):
        self.spark, self.dim, self.offset = rows.sparkSession, dim, offset
        per_block = max(1, BLOCK_BYTES // (8 * dim))

        def pack(batches):
            held, size = [], 0
            for b in C.frames(batches):
                for at in range(0, len(b), per_block):
                    held.append(np.stack(b["x"].iloc[at:at + per_block].to_numpy()).astype("<i8") - offset)
                    size += len(held[-1])
                    if size >= per_block:
                        yield pd.DataFrame({"block": [np.concatenate(held).tobytes()]})
                        held, size = [], 0
            if held:
                yield pd.DataFrame({"block": [np.concatenate(held).tobytes()]})

        # Written once, then kept by the executors: what a lost one kept is read again.  As few tasks a pass as the bytes ask for.
        packed = C.cut(rows.select("x").distinct().mapInPandas(pack, "block binary"))
        size = packed.agg(F.sum(F.octet_length("block"))).first()[0] or 0
        self.blocks = packed.coalesce(-(-size // TASK_BYTES) or 1).persist(StorageLevel.MEMORY_AND_DISK)
        self.tasks = self.blocks.rdd.getNumPartitions()
        counted = self._sum(lambda y: np.array([*_digits(y.sum(axis=0)), len(y)], "<i8"), (2 * dim + 1,), "<i8")
        self.n = int(counted[-1])
        self.sums = [(int(h) << 31) + int(low) for h, low in zip(counted[:dim], counted[dim:2 * dim], strict=True)]  # less the offset
        self.whole = [round(s / self.n) if self.n else 0 for s in self.sums]
        self.part = np.array([(s - self.n * w) / self.n if self.n else 0.0 for s, w in zip(self.sums, self.whole, strict=True)])

    def _sum(self, of_block, shape: tuple[int, ...], kind: str = "<f8") -> np.ndarray:
        """The sum of ``of_block`` over all blocks, by one pass."""
        dim = self.dim

        def run(batches):
            out = None
            for b in C.frames(batches):
                for raw in b["block"]:
                    own = of_block(np.frombuffer(raw, "<i8").reshape(-1, dim)).reshape(-1)
                    out = own if out is None else out + own
            if out is not None:
                yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "data": [out.astype(kind).tobytes()]})

        return _summed(self.blocks.mapInPandas(run, "task int, data binary"), self.tasks, shape, kind)

    def product(self, q: np.ndarray) -> np.ndarray:
        """V q by one pass."""
        whole, part = np.array(self.whole, "<i8"), self.part

        def of_block(y):
            centred = (y - whole).astype(np.float64) - part
            return centred.T @ (centred @ q)

        return self._sum(of_block, q.shape) / self.n

    def trace(self) -> float:
        whole, part = np.array(self.whole, "<i8"), self.part
        total = self._sum(lambda y: (((y - whole).astype(np.float64) - part) ** 2).sum(axis=0), (self.dim,))
        return float(total.sum()) / self.n

    def covariance_of(self, q: np.ndarray) -> np.ndarray:
        """The covariance of the centred rows times ``q``, by one pass."""
        whole, part = np.array(self.whole, "<i8"), self.part

        def of_block(y):
            z = ((y - whole).astype(np.float64) - part) @ q
            return np.concatenate([(z.T @ z).reshape(-1), z.sum(axis=0)])

        k = q.shape[1]
        both = self._sum(of_block, (k * k + k,)) / self.n
        mean = both[k * k:]
        return both[:k * k].reshape(k, k) - np.outer(mean, mean)


OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, eigenvalue double, residual double, "
       "identity_error double")


class Whitening:
    """A fitted model: eigenvalues (falling), unit vectors (dim x components), residual norms."""

    def __init__(self, fit: FitList, components: int):
        self.fit, self.trace = fit, fit.trace() if fit.n else 0.0
        values, vectors, residuals = (leading_pairs(fit.product, fit.dim, components) if self.trace > 0 else
                                      (np.empty(0), np.empty((fit.dim, 0)), np.empty(0)))
        own = values > fit.dim * SLACK * EPS * self.trace  # directions with variance
        self.values, self.vectors, self.residuals = values[own], vectors[:, own], residuals[own]
        self.to_white = self.vectors / np.sqrt(self.values)
        k = len(self.values)
        self.identity_error = float(np.abs(fit.covariance_of(self.to_white) - np.eye(k)).max()) if k else 0.0

    def apply(self, rows: DataFrame) -> DataFrame:
        """A row for each of ``rows`` (vec_id, x) and component."""
        fit, to_white, offset = self.fit, self.to_white, self.fit.offset
        n, whole, part = fit.n, np.array(fit.whole, "<i8"), fit.part
        left = [s - n * w for s, w in zip(fit.sums, fit.whole, strict=True)]  # S - n * whole, exact
        k = len(self.values)
        constants = {"explained": self.values / self.trace if k else self.values, "eigenvalue": self.values, "residual": self.residuals}
        error = self.identity_error

        def run(batches):
            for b in C.frames(batches):
                y = np.stack(b["x"].to_numpy()).astype("<i8") - offset - whole
                largest = int(np.abs(y).max()) * n + max(map(abs, left))
                if len(left) * largest * largest < 1 << 63:
                    deviation = ((n * y - np.array(left, "<i8")) ** 2).sum(axis=1).tolist()
                else:  # more than 63 bits on the way
                    exact = (sum((n * int(c) - s) ** 2 for c, s in zip(row, left, strict=True)) for row in y)
                    deviation = [d if d < 1 << 63 else None for d in exact]
                white = (y.astype(np.float64) - part) @ to_white
                out = {"vec_id": np.repeat(b["vec_id"].astype("Int64").array, k), "component": np.tile(np.arange(1, k + 1, dtype="int32"), len(b)),
                       "n": n, "deviation": pd.array(np.repeat(np.array(deviation, object), k), "Int64"), "whitened": white.reshape(-1)}
                yield pd.DataFrame(out | {name: np.tile(v, len(b)) for name, v in constants.items()} | {"identity_error": error})

        return rows.select("vec_id", "x").mapInPandas(run, OUT)


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, eigenvalue, residual, identity_error)
    of each row and each of the first ``components`` components of its vectors' length."""
    rows, out = whole_numbers(vectors, id_col, vector_col, scale, offset), None
    for r in rows.groupBy("dim").count().orderBy("dim").collect():  # a row per length
        own = rows.where(F.col("dim") == r.dim)
        model = Whitening(FitList(own, r.dim, offset), components)
        model.fit.blocks.unpersist()
        if len(model.values):
            out = model.apply(own) if out is None else out.union(model.apply(own))
    return out if out is not None else vectors.sparkSession.createDataFrame([], OUT)
