"""Embedding near-duplicates by randomised-rotation binary codes.

Each unit vector is turned by fixed random rotations and kept as sign bits, with its
correction factor and few-bit coordinates: its sketch, computed once and stored. Slices
of the bits are bucket keys; vectors that share a bucket are pairs to look at. For a
pair, one vector's code and factor and the other's coordinates give an unbiased estimate
of their inner product by bit counts, with a bound on its error.

Buckets hold sketches only. Vectors are fetched for those members of a bucket that are
in a pair which the bound cannot rule out, and such pairs are recomputed in double
precision.

Bucket keys are as long as the number of vectors asks for, and there are as many
tables as it takes to find a pair at the threshold with probability RECALL, and
more similar pairs more surely. A sketch goes to its bucket with the bits of earlier
tables, by which a pair counts only once. Equal vectors are one item with a weight.
Pairs are counted in the task that finds them and never emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.components import components
from bandwright.llm.groups import group_bounds, joined_up, pairs_within, whole_groups
from bandwright.llm.tables import Workspace

THRESHOLD = 0.9
# Least chance that a pair at the threshold shares a bucket.
RECALL = 0.99
# Vectors per bucket that key lengths aim at, and rows of a bucket beyond which
# it is dealt to several tasks.
BUCKET_ROWS, BLOCK_ROWS = 32, 2048
# Standard errors within which an estimate is trusted.
ERRORS = 4.0
# Bits per coordinate of the vector that meets a code.
QUERY_BITS = 4
PAIRS = 100_000


def shape(n_items: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a bucket key, and number of tables."""
    bits = min(max(math.ceil(math.log2(max(n_items, 2) / BUCKET_ROWS)), 6), 31)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


@cache
def rotation(size: int, number: int) -> np.ndarray:
    normal = np.random.Generator(np.random.PCG64([20240607, size, number])).normal(size=(size, size))
    turned, upper = np.linalg.qr(normal)
    return turned * np.sign(np.diag(upper))


def bucket_bits(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Sign bits of every vector, a disjoint slice for each table."""
    size = unit.shape[1]
    turns = -(-bits * tables // size)
    signs = np.concatenate([unit @ rotation(size, t).T > 0 for t in range(turns)], axis=1)
    return signs[:, : bits * tables]


def bucket_keys(flags: np.ndarray, bits: int) -> np.ndarray:
    """One key per row and table of sign bits."""
    return flags.reshape(len(flags), -1, bits) @ (1 << np.arange(bits, dtype=np.int64))


class Codes:
    """Codes, factors and quantised coordinates of unit vectors under rotation 0."""

    def __init__(self, unit: np.ndarray):
        n, size = unit.shape
        turned = unit @ rotation(size, 0).T
        # Inner product of a vector with its code.
        factor = np.abs(turned).sum(axis=1) / math.sqrt(size)
        low = turned.min(axis=1)
        levels = (1 << QUERY_BITS) - 1
        step = np.maximum((turned.max(axis=1) - low) / levels, 1e-30)
        # Rounded up or down at random, so that the estimate stays unbiased.
        noise = np.random.Generator(np.random.PCG64(7)).random((1, size))
        steps = (turned - low[:, None]) / step[:, None] + noise
        steps = np.clip(steps.astype(np.int64), 0, levels)
        planes = [packed_bits((steps >> b) & 1 == 1) for b in range(QUERY_BITS)]
        words = np.stack([packed_bits(turned > 0), *planes], axis=1)
        self.hold(size, words, np.stack([factor, low, step], axis=1).astype(np.float32))

    def hold(self, size: int, words: np.ndarray, numbers: np.ndarray) -> None:
        self.size, self.words, self.numbers = size, words, numbers
        self.bits, self.planes = words[:, 0], words[:, 1:]
        self.factor, self.low, self.step = numbers.astype(np.float64).T
        self.ones = np.bitwise_count(self.bits).sum(axis=1)
        self.spread = np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor
        counts = np.bitwise_count(self.planes).sum(axis=2).astype(np.int64)
        self.total = self.low * size + self.step * (counts @ (1 << np.arange(QUERY_BITS)))

    def stored(self) -> np.ndarray:
        """The bytes that ``read`` takes, a row for each vector."""
        n = len(self.words)
        return np.concatenate(
            [self.words.reshape(n, -1).view(np.uint8), np.ascontiguousarray(self.numbers).view(np.uint8)],
            axis=1,
        )

    @classmethod
    def read(cls, raw: np.ndarray, size: int) -> Codes:
        words, numbers = raw[:, : -3 * 4], raw[:, -3 * 4 :]
        codes = cls.__new__(cls)
        codes.hold(
            size,
            np.ascontiguousarray(words).view(np.uint64).reshape(len(raw), 1 + QUERY_BITS, -1),
            np.ascontiguousarray(numbers).view(np.float32),
        )
        return codes

    def at_most(self, code: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Upper confidence bound of the inner products of code rows and query rows."""
        bits = self.bits[code]
        counted = sum(
            np.bitwise_count(bits & self.planes[query, b]).sum(axis=1).astype(np.int64) << b
            for b in range(QUERY_BITS)
        )
        under = self.low[query] * self.ones[code] + self.step[query] * counted
        met = (2 * under - self.total[query]) / math.sqrt(self.size)
        estimate = met / self.factor[code]
        error = self.spread[code] / math.sqrt(max(self.size - 1, 1))
        rounding = self.step[query] / (2 * self.factor[code])
        return estimate + ERRORS * np.hypot(error, rounding)


def code_bytes(size):
    """Bytes of a stored code, for a size or a column of sizes."""
    words = F.ceil(size / 64) if isinstance(size, Column) else -(-size // 64)
    return words * (8 * (1 + QUERY_BITS)) + 3 * 4


def packed_bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    n, size = flags.shape
    words = -(-size // 64)
    padded = np.zeros((n, words * 64), bool)
    padded[:, :size] = flags
    return np.packbits(padded, axis=1).view(np.uint64)


def unit_rows(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Vectors of one size in double precision, scaled to length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id, embedding, size`` of the vectors that can link: one row per id."""
    vector = F.col("embedding")
    sound = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ) & F.exists(vector, lambda x: x != 0)
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
        .withColumn("size", F.size("embedding").cast("long"))
    )


def coded(items: DataFrame, bits: int, tables: int) -> DataFrame:
    """``item, size, sketch, keys``: code and sign bits of each item, and its bucket in each table."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                unit = unit_rows(part.column("embedding"), int(size))
                flags = bucket_bits(unit, bits, tables)
                raw = np.concatenate([Codes(unit).stored(), np.packbits(flags, axis=1)], axis=1)
                keys = pa.array(bucket_keys(flags, bits).astype(np.int32).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("item"),
                        part.column("size"),
                        pa.FixedSizeBinaryArray.from_buffers(
                            pa.binary(raw.shape[1]), len(raw), [None, pa.py_buffer(raw.tobytes())]
                        ).cast(pa.binary()),
                        pa.FixedSizeListArray.from_arrays(keys, tables).cast(pa.list_(pa.int32())),
                    ],
                    ["item", "size", "sketch", "keys"],
                )

    return items.select("item", "size", "embedding").mapInArrow(
        code, "item bigint, size bigint, sketch binary, keys array<int>"
    )


def dealt(codes: DataFrame, bits: int, workspace: Workspace) -> DataFrame:
    """Each item's sketch once per table and pair of blocks its bucket is dealt to.

    A bucket of more than BLOCK_ROWS items is cut into blocks by hashed id; a task
    gets two blocks, or one twice.
    """
    places = codes.select("size", F.posexplode("keys").alias("table", "key"))
    crowded = workspace.save(
        places.groupBy("size", "table", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > BLOCK_ROWS)
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
        .drop("n"),
        "crowded",
    )
    own = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    # The bits of this table and later ones tell nothing.
    known = code_bytes(F.col("size")) + F.ceil(F.col("table") * bits / 8)
    return (
        codes.select("item", "size", "sketch", F.posexplode("keys").alias("table", "key"))
        .join(crowded, ["size", "table", "key"], "left")
        .withColumn("sketch", F.substring("sketch", F.lit(1), known.cast("int")))
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .select(*GROUP, "block", "item", "sketch")
    )


GROUP = ("size", "table", "key", "low", "high")


def in_groups(rows: DataFrame) -> DataFrame:
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(n, *GROUP).sortWithinPartitions(*GROUP)


def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted rows with their bounds, of one size and table at a time."""
    for rows, bounds in whole_groups(batches, GROUP):
        cuts = group_bounds(rows, ("size", "table"))
        for first, after in zip(cuts, cuts[1:]):
            inside = bounds[(bounds >= first) & (bounds <= after)] - first
            yield rows.slice(first, after - first), inside


def likely_pairs(
    rows: pa.Table, bounds: np.ndarray, bits: int, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a section that the bound can't rule out, in the first table they share."""
    size, turn = rows.column("size")[0].as_py(), rows.column("table")[0].as_py()
    block, low, high = (rows.column(c).to_numpy() for c in ("block", "low", "high"))
    sketches = rows.column("sketch").combine_chunks()
    raw = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(len(sketches), -1)
    codes = Codes.read(raw[:, : code_bytes(size)], size)
    earlier = np.unpackbits(raw[:, code_bytes(size) :], axis=1)[:, : turn * bits]
    keys = bucket_keys(earlier, bits).astype(np.int32) if turn else np.zeros((len(raw), 0), np.int32)
    for i, j in pairs_within(bounds, PAIRS):
        # Pairs within a block are looked at where the block meets itself.
        right = (block[i] != block[j]) | (low[i] == high[i])
        i, j = i[right], j[right]
        maybe = codes.at_most(i, j) >= threshold
        i, j = i[maybe], j[maybe]
        new = ~(keys[i] == keys[j]).any(axis=1)
        yield i[new], j[new]


def likely_rows(rows: DataFrame, bits: int, threshold: float) -> DataFrame:
    """The rows of groups that are in a pair which the bound can't rule out."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in sections(batches):
            some = np.zeros(part.num_rows, bool)
            for i, j in likely_pairs(part, bounds, bits, threshold):
                some[i] = some[j] = True
            if some.any():
                yield from part.filter(pa.array(some)).to_batches()

    return rows.mapInArrow(find, rows.schema)


def linked_in_groups(rows: DataFrame, bits: int, threshold: float) -> DataFrame:
    """``item, n_links, component``: links found in a task, and the least item they reach there."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, bounds in sections(batches):
            items = part.column("item").to_numpy()
            weights = part.column("weight").to_numpy()
            unit = unit_rows(part.column("embedding"), part.column("size")[0].as_py())
            links = np.zeros(len(items), np.int64)
            least = np.arange(len(items))
            for i, j in likely_pairs(part, bounds, bits, threshold):
                exact = np.einsum("nd,nd->n", unit[i], unit[j]) >= threshold
                i, j = i[exact], j[exact]
                if len(i):
                    np.add.at(links, i, weights[j])
                    np.add.at(links, j, weights[i])
                    joined_up(least, i, j, items)
            some = links > 0
            if some.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items[some]), pa.array(links[some]), pa.array(items[least[some]])],
                    ["item", "n_links", "component"],
                )

    return rows.mapInArrow(link, "item bigint, n_links bigint, component bigint")


def near_duplicates(
    embeddings: DataFrame, workspace: Workspace, threshold: float = THRESHOLD
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Cosines are taken between vectors of the same length. Vectors that are null,
    empty, zero or hold null or non-finite numbers have no links. Rows that repeat
    an id are one vector (the least of them, if they differ) and get the same
    result. A row without an id has no links and no component, and is not kept.
    """
    valid = workspace.save(usable(embeddings), "vectors")
    items = workspace.save(
        valid.groupBy("embedding", "size").agg(
            F.min("vec_id").alias("item"), F.count(F.lit(1)).alias("weight")
        ),
        "items",
    )
    bits, tables = shape(items.count(), threshold)
    codes = workspace.save(coded(items, bits, tables), "codes")
    likely = workspace.save(
        likely_rows(in_groups(dealt(codes, bits, workspace)), bits, threshold), "likely"
    )
    vectors = items.select("item", "weight", "embedding")
    found = workspace.save(
        linked_in_groups(in_groups(likely.join(vectors, "item")), bits, threshold), "found"
    )
    links = found.groupBy("item").agg(F.sum("n_links").alias("links"))
    edges = found.select(F.col("item").alias("a"), F.col("component").alias("b"))
    ends = components(edges, workspace, "near")
    of_item = (
        items.join(links, "item", "left")
        .join(ends, "item", "left")
        .select(
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "item").alias("component_id"),
        )
    )
    of_vector = valid.select("vec_id", "embedding").join(of_item, "embedding").drop("embedding")
    component = F.coalesce("component_id", "vec_id")
    return (
        embeddings.select("vec_id")
        .join(of_vector, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
        )
    )
