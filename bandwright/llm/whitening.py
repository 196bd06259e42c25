"""Whitening of embeddings through MLlib's block matrices.

Entries c become whole numbers floor(64 c) + 1000000, so sums are exact whatever the
order. Rows get consecutive numbers and, centred, become the rows of a distributed
block matrix. Its transpose times itself is the scatter matrix; the product is split
along the rows, so that no task meets all blocks. The scatter matrix, of one row per
dimension, is decomposed on the driver, and the block matrix times the whitening
matrix (eigenvectors over the roots of their eigenvalues) projects all rows.

Defined results: a vector that is null, or holds a null or non-finite entry, or one
that is beyond RANGE after scaling, has no rows. Of vectors of different lengths the
commonest length stays (of equally common ones the longest). A dimension more or less
does no harm: there are as many components as dimensions, COMPONENTS at most. A
component without variance has a null ``whitened`` and takes no part in the identity
error, which is null if there is no other; ``explained`` is null if nothing varies.
A ``deviation`` that no long holds is null. Null and repeated ids are rows like others.
An empty table gives no rows. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwright.llm.tables import Workspace

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
# Scaled entries beyond it are not whole numbers that a double tells apart.
RANGE = 2.0**52
# Sums are made of the entries' high and low parts, so that none leaves 64 bits.
LOW_BITS = 26
# Bytes of a block, about, for tables of up to BLOCKS of them; of larger tables the
# blocks grow, to MOST_BYTES, as the driver keeps the place of each.
BLOCK_BYTES, MOST_BYTES = 1 << 20, 1 << 25
BLOCKS = 100_000
# Blocks that one task of a product meets, about.
TASK_BLOCKS = 4


def numbered(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x, size, part, number`` of the vectors that remain.

    ``number`` counts a partition's vectors of one length, from 0.
    """

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            column = batch.column("embedding")
            ids = batch.column("vec_id").filter(column.is_valid())
            parts = batch.column("part").filter(column.is_valid())
            column = column.drop_null()
            sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(SCALE * values)
                bad = np.append(0, np.cumsum(~(np.abs(scaled) < RANGE)))
            ends = np.cumsum(sizes)
            keep = bad[ends] == bad[ends - sizes]
            entries = scaled[np.repeat(keep, sizes)].astype(np.int64) + SHIFT
            sizes = sizes[keep]
            number = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes):
                same = np.flatnonzero(sizes == size)
                before = counts.get(int(size), 0)
                number[same] = before + np.arange(len(same))
                counts[int(size)] = before + len(same)
            bounds = np.append(0, np.cumsum(sizes)).astype(np.int32)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": ids.filter(mask),
                    "x": pa.ListArray.from_arrays(pa.array(bounds), pa.array(entries)),
                    "size": pa.array(sizes.astype(np.int32)),
                    "part": parts.filter(mask),
                    "number": pa.array(number),
                }
            )

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = embeddings.select("vec_id", "embedding", F.spark_partition_id().alias("part"))
    return rows.mapInArrow(
        scale, f"vec_id {kind}, x array<bigint>, size int, part int, number bigint"
    )


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def sums(vectors: DataFrame, size: int) -> list[int]:
    """Exact sum of every dimension: partial ones per batch, then one row per dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), size)
                high = x >> LOW_BITS
                columns = np.arange(size, dtype=np.int32), high.sum(0), (x - (high << LOW_BITS)).sum(0)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["place", "high", "low"])

    totals = vectors.select("x").mapInArrow(partial, "place int, high bigint, low bigint")
    # As many rows as there are dimensions.
    rows = totals.groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return [(row["high"] << LOW_BITS) + row["low"] for row in rows.orderBy("place").collect()]


def indexed(vectors: DataFrame) -> DataFrame:
    """``vec_id, x, index``: consecutive numbers, by partition and by number there."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = vectors.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return vectors.join(bases, "part").select(
        "vec_id", "x", (F.col("base") + F.col("number")).alias("index")
    )


def centred(rows: DataFrame, n: int, total: list[int], block_rows: int) -> IndexedRowMatrix:
    """The rows less their mean, as a matrix by index, ready to be cut into blocks."""
    size, mean = len(total), np.array([s / n for s in total])

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (matrix(batch.column("x"), size) - mean).ravel()
            bounds = np.arange(batch.num_rows + 1, dtype=np.int32) * size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("index"),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values)),
                ],
                ["index", "centred"],
            )

    tasks = -(-n // (block_rows * TASK_BLOCKS))
    # Whole numbers travel; the centred rows are twice as many bytes.
    found = (
        rows.select("index", "x")
        .repartition(tasks, F.floor(F.col("index") / block_rows))
        .mapInArrow(less, "index bigint, centred array<double>")
        .select("index", array_to_vector("centred").alias("vector"))
    )
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(found, "vector"), n, size)


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right``, the sums over their common side made in ``splits`` parts."""
    made = left._java_matrix_wrapper.call(
        "multiply", right._java_matrix_wrapper._java_model, splits
    )
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def components(scatter: np.ndarray, n: int, count: int) -> tuple[np.ndarray, ...]:
    """Variances and unit directions by falling variance, with the share each explains.

    A direction's largest entry is positive. Variances that rounding may have made
    count as zero.
    """
    covariance = (scatter + scatter.T) / (2 * n)
    found, vectors = np.linalg.eigh(covariance)
    variances, vectors = found[::-1][:count], vectors[:, ::-1][:, :count]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(vectors.shape[1])])
    noise = max(found[-1], 0.0) * len(found) * np.finfo(float).eps
    variances = np.where(variances > noise, variances, 0.0)
    trace = float(np.trace(covariance))
    explained = variances / trace if trace > 0 else np.full(len(variances), np.nan)
    return variances, vectors, explained


def deviations(rows: DataFrame, n: int, total: list[int]) -> DataFrame:
    """``index, vec_id, deviation``; the deviation is exact, null if no long holds it."""
    size, mean = len(total), np.array([s / n for s in total])

    def deviate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), size)
            rough = ((n * (x - mean)) ** 2).sum(axis=1)
            # Of what stays in 64 bits sums are exact, whatever a term between wraps to;
            # near the limit whole numbers of any size decide.
            apart = n * x - np.array([(s + 2**63) % 2**64 - 2**63 for s in total], np.int64)
            exact = (apart * apart).sum(axis=1)
            over = np.zeros(len(x), bool)
            for k in np.flatnonzero(rough > 2.0**62):
                value = sum((n * v - s) ** 2 for v, s in zip(x[k].tolist(), total))
                over[k] = value >= 1 << 63
                exact[k] = 0 if over[k] else value
            yield pa.RecordBatch.from_arrays(
                [batch.column("index"), batch.column("vec_id"), pa.array(exact, mask=over)],
                ["index", "vec_id", "deviation"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(deviate, f"index bigint, vec_id {kind}, deviation bigint")


def whitened(embeddings: DataFrame, workspace: Workspace, count: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    spark = embeddings.sparkSession
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    empty = spark.createDataFrame(
        [],
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double",
    )
    vectors = workspace.save(numbered(embeddings), "vectors")
    commonest = (
        vectors.filter("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.desc("size")).first()
    )
    if commonest is None:
        return empty
    size, n = commonest["size"], commonest["n"]
    vectors = vectors.filter(F.col("size") == size)
    total = sums(vectors, size)
    rows = workspace.save(indexed(vectors), "indexed")

    row_bytes = 8 * size
    block_rows = max(min(max(BLOCK_BYTES, n * row_bytes // BLOCKS), MOST_BYTES) // row_bytes, 1)
    splits = -(-n // (block_rows * TASK_BLOCKS))
    blocks = centred(rows, n, total, block_rows).toBlockMatrix(block_rows, size)
    scatter = product(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()
    variances, vectors, explained = components(scatter, n, min(count, size))

    with np.errstate(divide="ignore"):
        scales = np.where(variances > 0, 1 / np.sqrt(variances), 0.0)
    weights = vectors * scales
    local = Matrices.dense(*weights.shape, weights.ravel(order="F").tolist())
    whitener = BlockMatrix(
        spark.sparkContext.parallelize([((0, 0), local)], 1), size, weights.shape[1]
    )
    projected = blocks.multiply(whitener)
    # Rows are centred before they are multiplied, so the projected ones have mean zero.
    square = product(projected.transpose(), projected, splits).toLocalMatrix().toArray() / n
    some = variances > 0
    off = np.abs(square - np.eye(len(square)))[np.ix_(some, some)]

    by_row = callMLlibFunc(
        "getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model
    ).select("index", vector_to_array("vector").alias("values"))
    facts = spark.createDataFrame(
        [
            (k + 1, bool(some[k]), None if np.isnan(explained[k]) else float(explained[k]))
            for k in range(len(some))
        ],
        "component int, varies boolean, explained double",
    )
    return (
        deviations(rows, n, total)
        .join(by_row, "index")
        .select("vec_id", "deviation", F.posexplode("values").alias("place", "value"))
        .withColumn("component", F.col("place") + 1)
        # One row per component.
        .join(F.broadcast(facts), "component")
        .select(
            "vec_id",
            "component",
            F.lit(n).cast("long").alias("n"),
            "deviation",
            F.when(F.col("varies"), F.col("value")).alias("whitened"),
            "explained",
            F.lit(float(off.max()) if off.size else None).cast("double").alias("identity_error"),
        )
    )
