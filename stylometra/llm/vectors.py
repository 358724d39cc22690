"""Integer vectors: what the operators on exact scores and distances share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import prepare

#: squares of a vector must sum to less than this, so that every score and distance is exact in 64 bits
LARGEST = float(1 << 58)
#: up to this, sums of products are exact in doubles too
EXACT = float(1 << 51)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """id, label (as string), dims and v (little-endian 64-bit integers floor(scale * x), x as double) of each usable row.

    Left out are vectors that are null or hold null or non-finite components. Integers whose squares sum to 2^58 or
    more have no exact 64-bit scores and stop the job with an error that says so.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lists = b.column(2)
            begins = lists.offsets.to_numpy()
            flat = np.floor(scale * lists.values.to_numpy(zero_copy_only=False))
            dims = np.diff(begins)
            sums = np.concatenate([[0.0], np.cumsum(flat * flat)])
            if flat.size and ((sums[begins[1:]] - sums[begins[:-1]] >= LARGEST).any() or np.abs(flat).max() >= 2.0**29):
                raise ValueError("a vector is too large for exact 64-bit scores")
            whole = flat.astype("<i8")
            data = [whole[a:z].tobytes() for a, z in zip(begins.tolist(), begins[1:].tolist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["id", "label", "dims", "v"])

    return rows.where(F.col("v").isNotNull() & finite).mapInArrow(run, "id long, label string, dims int, v binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in doubles where their size allows it, else in 64-bit integers."""
    size = lambda x: float((x.astype(float) ** 2).sum(axis=1).max(initial=0))
    if max(size(a), size(b)) < EXACT:
        return a.astype(float) @ b.astype(float).T
    return a @ b.T
