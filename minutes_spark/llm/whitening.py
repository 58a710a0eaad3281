"""Whitening from the covariance of distinct vectors, each weighted by its multiplicity or by one.

Components become integers x = floor(``scale`` * component) + ``offset``. Equal vectors are
grouped once, with their counts; sums per dimension are exact integers. The covariance is a
weighted product of centred vectors, formed per task and added up by dimension pair; only that
matrix, as large as the number of dimensions squared, reaches the driver. Each distinct vector is
projected on the unit eigenvectors once and joined back to its rows.

Cases: rows whose vector is null or holds null or non-finite entries are dropped; a shorter
vector counts as padded with zeros; repeated rows and null ids stay; directions without
variance (up to rounding) have no component, so equal vectors alone give no rows; an empty table
gives an empty result; the matrix bounds how long vectors may be; other columns are not used,
whatever their names.
"""

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import durable
from .topk import usable

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
_EXACT = 2**62


def distinct_vectors(rows, width, kind):
    """``rows`` with ``x`` (without the offset, padded), and the table of distinct x with their counts."""
    cells = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast(kind))
    padded = F.concat(cells, F.array_repeat(F.lit(0).cast(kind), F.lit(width) - F.size("v")))
    rows = rows.select("id", padded.alias("x"))
    return rows, durable(rows.groupBy("x").agg(F.count("*").alias("copies")), "distinct-vectors")


def _integers(column, width, offset):
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
    return x + offset


def _summed(table, width, emit, kind, name):
    """Sums over all tasks of what ``emit`` gives for a batch, by position; a bounded table, on the driver."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = emit(batch)
                total = part if total is None else total + part
        if total is not None:
            values = total.reshape(-1).tolist()
            if kind != "double":
                values = [Decimal(v) for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values)), pa.int64()), pa.array(values, pa.float64() if kind == "double" else pa.decimal128(38, 0))],
                ["at", "part"],
            )

    parts = table.mapInArrow(run, f"at long, part {kind}").groupBy("at").agg(F.sum("part").cast(kind).alias("total"))
    found = parts.toPandas().sort_values("at")["total"].tolist()
    if not found:
        raise ValueError(f"no rows to take {name} from")
    return found


class Fit:
    """Exact sums, and the components of the covariance of the weighted distinct vectors."""

    def __init__(self, table, width, largest, components=COMPONENTS, offset=OFFSET, weights="one"):
        self.width, self.offset, self.weights = width, offset, weights
        self.n = int(table.agg(F.count("*") if weights == "one" else F.sum("copies")).first()[0] or 0)
        self.sums, self.values, self.axes, self.trace, self.error = [0] * width, np.zeros(0), np.zeros((width, 0)), 0.0, 0.0
        if self.n:
            self.sums = [int(s) for s in _summed(table, width, self._sums(), "decimal(38,0)", "sums")]
        # what n * x - S can reach decides whether 64-bit integers hold it and its squares
        self.reach = 2 * self.n * (int(largest) + 1)
        if self.n:
            self._components(np.array(_summed(table, width, self._products(None), "double", "products")).reshape(width, width), components)
        if len(self.values):
            self._check(np.array(_summed(table, width, self._products(self.axes / np.sqrt(self.values)), "double", "products")))

    def _weight(self, batch):
        return np.ones(batch.num_rows, np.int64) if self.weights == "one" else batch.column(1).to_numpy().astype(np.int64)

    def _sums(self):
        def emit(batch):
            x, weight = _integers(batch.column(0), self.width, self.offset), self._weight(batch)
            if int(np.abs(x).max(initial=0)) * int(weight.sum()) >= _EXACT:
                x, weight = x.astype(object), weight.astype(object)
            return (x * weight[:, None]).sum(0).astype(object)

        return emit

    def _moved(self, x):
        """n * x - S, exact."""
        if self.reach >= _EXACT or self.n * (int(np.abs(x).max(initial=0)) + 1) >= _EXACT or max(map(abs, self.sums)) >= _EXACT:
            return x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return x * self.n - np.array(self.sums, dtype=np.int64)

    def centred(self, x):
        return self._moved(x).astype(np.float64) / self.n

    def deviation(self, x):
        """Sum over the dimensions of (n * x - S)^2, exact, as Python integers."""
        moved = self._moved(x)
        if moved.dtype != object and int(np.abs(moved).max(initial=0)) ** 2 * self.width < _EXACT:
            return (moved**2).sum(1).tolist()
        return [sum(v * v for v in row) for row in moved.astype(object).tolist()]

    def _products(self, axes):
        def emit(batch):
            z = self.centred(_integers(batch.column(0), self.width, self.offset))
            z = z if axes is None else z @ axes
            weighted = z * self._weight(batch)[:, None]
            square = weighted.T @ z
            return square if axes is None else np.concatenate([weighted.sum(0), square.reshape(-1)])

        return emit

    def _components(self, products, components):
        covariance = products / self.n
        values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
        self.trace = float(np.trace(covariance))
        kept = [i for i in np.argsort(-values, kind="stable") if values[i] > self.width * 1e-14 * max(self.trace, 0)]
        self.values, self.axes = values[kept[:components]], axes[:, kept[:components]]

    def _check(self, found):
        count = len(self.values)
        mean, square = found[:count] / self.n, found[count:].reshape(count, count) / self.n
        self.error = float(np.abs(square - np.outer(mean, mean) - np.eye(count)).max())

    def whitened(self, x):
        return self.centred(x) @ self.axes / np.sqrt(self.values)


def whitened_vectors(table, fit):
    """(x, whitened: array of doubles, deviation) of every distinct vector."""

    def run(batches):
        for batch in batches:
            x = _integers(batch.column(0), fit.width, fit.offset)
            z, count = fit.whitened(x), len(fit.values)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(ends, pa.array(z.reshape(-1))),
                    pa.array([Decimal(d) if d < 10**38 else None for d in fit.deviation(x)], pa.decimal128(38, 0)),
                ],
                ["x", "whitened", "deviation"],
            )

    kind = table.schema["x"].dataType.simpleString()
    return table.mapInArrow(run, f"x {kind}, whitened array<double>, deviation decimal(38,0)")


def whiten(rows, key="vec_id", vector="embedding", components=COMPONENTS, weights="one"):
    """One row per row of ``rows`` and component: key, component, n, deviation, whitened, explained, identity_error.

    ``weights`` is "one" (each distinct vector counts once) or "count" (as often as it stands).
    The deviation is a decimal, as it outgrows a long at some 10^8 vectors; null beyond 38 digits.
    """
    rows = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(usable(F.col("v")))
    largest = F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))
    width, largest = rows.agg(F.max(F.size("v")), largest).first()
    width, largest = width or 1, (largest or 0.0) * SCALE + 1
    rows, table = distinct_vectors(rows, width, "int" if largest < 2**31 else "long")
    fit = Fit(table, width, largest + OFFSET, components, weights=weights)
    shares = F.array(*(F.lit(float(e / fit.trace)) for e in fit.values)) if len(fit.values) else F.array().cast("array<double>")
    joined = rows.join(whitened_vectors(table, fit), "x")
    return joined.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("id").alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(fit.error).alias("identity_error"),
    )
