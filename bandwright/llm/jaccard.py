"""N-gram Jaccard join with skipping by set relations.

Exact. Texts with equal sets are one item. Two items that are similar enough
share a shingle in their prefixes, the first shingles of either in one order of
all shingles. The order begins with a fixed sample of the shingles, those first
that no two texts share: bit maps, of one size for any corpus, say how often the
shared ones of the sample occur, by hash class. A sampled shingle whose class is
blank is in one text only and needs no list. Lists of items by prefix shingle are
skipped as a whole when they hold one component, and in blocks otherwise: an item's
place in a list bounds the sizes that it can be similar to, so it meets blocks of those
sizes only, or none; of pairs that meet, both places tell which can be.

In lists with many pairs to answer, answers are derived from a leader's. Each item
there is compared with one leader of its lists, and keeps only what it has more and
less than the leader. All pairs of a leader's family then have their overlap from
these small differences alone, in blocks, and no pair leaves a task. Items similar to their
leader are one component by that; of a family only the others meet each other and them.
Pairs that no
family holds, of different components, are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm import texts as T
from bandwright.llm.components import components, unsettled
from bandwright.llm.groups import joined_up, whole_groups
from bandwright.llm.tables import Workspace, semi_join

SHINGLE_WORDS = 3
# Similarity: TOP * intersection >= BOTTOM * union.
TOP, BOTTOM = 100, 90
# One shingle in so many is counted; a prefix takes one in ten, and may not have
# to take one that texts share where a third of the text is its own.
SAMPLE = 3
# Hash classes of the bit maps, and the numbers of texts that set a class's bits.
CLASS_BITS = 25
OFTEN = (2, 8, 64)
UNCOUNTED = 255
# Pairs per entry that a list holds to ask a leader.
PAIRS_PER_ENTRY = 4
# Members of a family that meet as many others in a task, and shingles at a time.
FAMILY_ROWS, FAMILY_SHINGLES = 256, 4096
# Blocks of size in a list between a set and the largest one similar to it.
BLOCKS = 4
# Members of a list beyond which it is dealt to several tasks.
LIST_ROWS = 1000


def document_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order, and where each text's begin."""
    texts = T.column_bytes(batch.column("text"))
    data = T.LOWER[texts.data]
    words = T.words(texts)
    hashes = T.run_hashes(data, words)
    windows, starts = T.shingles(hashes, words.offsets, SHINGLE_WORDS)
    text = words.text[starts] if len(starts) else np.zeros(0, np.int64)
    n_words = np.diff(words.offsets)
    for size in range(1, SHINGLE_WORDS):
        short = np.flatnonzero(n_words == size)
        if len(short):
            first = words.offsets[short]
            whole = sum(
                hashes[first + k] * T.U64(2 * k + 3) for k in range(size)
            ) + T.U64(size)
            windows, text = np.append(windows, T.mixed(whole)), np.append(text, short)
    order = np.lexsort((windows, text))
    windows, text = windows[order], text[order]
    new = np.ones(len(windows), bool)
    new[1:] = (windows[1:] != windows[:-1]) | (text[1:] != text[:-1])
    windows, text = windows[new], text[new]
    return windows, np.searchsorted(text, np.arange(len(texts) + 1))


def items_of(windows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """An id for each set from its members; sets of any size, the empty one 0."""
    sums = np.concatenate([np.zeros(1, T.U64), np.cumsum(T.mixed(windows + T.U64(7)))])
    sizes = np.diff(bounds).astype(T.U64)
    return T.mixed((sums[bounds[1:]] - sums[bounds[:-1]]) ^ sizes * T.BASE)


def classes(windows: np.ndarray) -> np.ndarray:
    return (windows >> T.U64(64 - CLASS_BITS)).view(np.int64)


def sampled(windows: np.ndarray) -> np.ndarray:
    return windows % T.U64(SAMPLE) == 0


def shared_levels(documents: DataFrame) -> np.ndarray:
    """For each hash class, how many of OFTEN a sampled shingle in it reaches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            windows, _ = document_sets(batch)
            token, n = np.unique(windows[sampled(windows)], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(T.signed(token)), pa.array(n.astype(np.int64))], ["token", "n"]
            )

    held = (
        documents.select("text")
        .mapInArrow(count, "token bigint, n bigint")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= OFTEN[0])
    )
    levels = F.array(*(F.when(F.col("n") >= least, level) for level, least in enumerate(OFTEN)))
    marked = held.select(
        # Bit places and bucket numbers count from 1.
        (F.shiftrightunsigned("token", 64 - CLASS_BITS) + 1).alias("class"),
        F.explode(F.array_compact(levels)).alias("level"),
    )
    # A few maps of 4 KB for each 32768 classes.
    maps = (
        marked.groupBy("level", F.bitmap_bucket_number("class").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("class")).alias("bits"))
        .collect()
    )
    total = np.zeros(1 << CLASS_BITS, np.uint8)
    for row in maps:
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        first = (row["bucket"] - 1) * len(bits)
        total[first : first + len(bits)] += bits[: len(total) - first]
    return total


def least_overlap(size):
    """Overlap that a set of this size, or each of an array, needs with any other."""
    return -(-size * BOTTOM // TOP)


def prefixes(documents: DataFrame, levels: np.ndarray) -> DataFrame:
    """``doc_id, n_shingles, item, prefix, places``: each text's set and prefix.

    Of the prefix only the shingles are kept that another text may hold, with their
    places in it. Sets so small that only equal ones are similar have no prefix.
    """
    shared = documents.sparkSession.sparkContext.broadcast(levels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in T.slices(batches, "text"):
            windows, bounds = document_sets(batch)
            often = np.where(sampled(windows), table[classes(windows)], np.uint8(UNCOUNTED))
            size = np.diff(bounds)
            text = np.repeat(np.arange(batch.num_rows), size)
            order = np.lexsort((windows, often, text))
            place = np.arange(len(windows)) - bounds[text]
            # A set of n needs another of n - 1 or more that it overlaps in all but one.
            indexed = TOP * size >= BOTTOM * (size + 1)
            length = np.where(indexed, size - least_overlap(size) + 1, 0)
            kept = (place < length[text]) & (often[order] > 0)
            cuts = pa.array(np.searchsorted(text[kept], np.arange(batch.num_rows + 1)), pa.int32())
            columns = (T.signed(windows[order][kept]), place[kept])
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in columns]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(size),
                    pa.array(T.signed(items_of(windows, bounds))),
                    *lists,
                ],
                ["doc_id", "n_shingles", "item", "prefix", "places"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles bigint, item bigint, prefix array<bigint>, places array<bigint>"
    return documents.select("doc_id", "text").mapInArrow(cut, schema)


def members(documents: DataFrame) -> DataFrame:
    """``item, hashes``: all shingles of the given texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches, "text"):
            windows, bounds = document_sets(batch)
            lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(T.signed(windows)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(T.signed(items_of(windows, bounds))), lists.cast(pa.list_(pa.int64()))],
                ["item", "hashes"],
            )

    return documents.select("text").mapInArrow(cut, "item bigint, hashes array<bigint>")


def similar(overlap: Column, size_a: Column, size_b: Column) -> Column:
    return TOP * overlap >= BOTTOM * (size_a + size_b - overlap)


def reachable(a: str, b: str) -> Column:
    """Whether two list entries can be similar, if this is their first common shingle."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    rest = F.least(size_a - F.col(f"{a}.pos"), size_b - F.col(f"{b}.pos"))
    return (
        (TOP * F.least(size_a, size_b) >= BOTTOM * F.greatest(size_a, size_b))
        & similar(rest, size_a, size_b)
    )


def compared(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with both sizes and their overlap."""
    first = contents.select(F.col("item").alias("a"), F.col("hashes").alias("of_a"))
    second = contents.select(F.col("item").alias("b"), F.col("hashes").alias("of_b"))
    return (
        pairs.join(first, "a")
        .join(second, "b")
        .select(
            "a",
            "b",
            F.size("of_a").cast("long").alias("size_a"),
            F.size("of_b").cast("long").alias("size_b"),
            F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("overlap"),
        )
    )


def linked(answers: DataFrame) -> DataFrame:
    near = similar(F.col("overlap"), F.col("size_a"), F.col("size_b"))
    return answers.filter(near).select("a", "b")


def leader_pairs(entries: DataFrame) -> DataFrame:
    """Each item ``a`` with the leader ``b`` of its lists, if it may be similar.

    A list's leader is its item that is in most lists, as the middle of a group of
    copies is; of several leaders the one in most lists leads.
    """
    # Sizes that may be similar are in the same band or in neighbouring ones.
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(TOP / BOTTOM)))
    held = entries.groupBy("item").agg(F.count(F.lit(1)).alias("held"))
    entries = entries.join(held, "item").withColumn("band", band)
    leaders = entries.groupBy("key", "band").agg(
        F.max(F.struct("held", "item", "size", "pos")).alias("leader")
    )
    return (
        entries.withColumn("own", F.struct("item", "size", "pos"))
        .join(leaders, ["key", "band"])
        .filter((F.col("item") != F.col("leader.item")) & reachable("own", "leader"))
        .groupBy(F.col("item").alias("a"))
        .agg(F.max(F.struct("leader.held", "leader.item")).alias("best"))
        .select("a", F.col("best.item").alias("b"))
    )


def families(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """``leader, item`` with sizes, how many of the leader's shingles the item lacks, and all differences.

    Items that share less than half with their leader are in no family. A leader is
    in its own, without differences.
    """
    first = contents.select(F.col("item").alias("a"), F.col("hashes").alias("of_a"))
    second = contents.select(F.col("item").alias("b"), F.col("hashes").alias("of_b"))
    size_a, size_b = F.size("of_a").cast("long"), F.size("of_b").cast("long")
    led = (
        pairs.join(first, "a")
        .join(second, "b")
        .withColumn("less", F.array_except("of_b", "of_a"))
        .filter(2 * (size_b - F.size("less")) >= F.greatest(size_a, size_b))
        .select(
            F.col("b").alias("leader"),
            F.col("a").alias("item"),
            size_b.alias("leader_size"),
            size_a.alias("size"),
            F.size("less").cast("long").alias("less"),
            F.concat("less", F.array_except("of_a", "of_b")).alias("apart"),
        )
    )
    own = pairs.select("b").distinct().join(second, "b")
    leaders = own.select(
        F.col("b").alias("leader"),
        F.col("b").alias("item"),
        size_b.alias("leader_size"),
        size_b.alias("size"),
        F.lit(0).cast("long").alias("less"),
        F.array().cast("array<bigint>").alias("apart"),
    )
    return led.unionByName(leaders)


def led_directly() -> Column:
    """Whether a row of a family is similar to its leader."""
    lost = F.col("leader_size") - F.col("less")
    return TOP * lost >= BOTTOM * (F.col("size") + F.col("less"))


def dealt_families(rows: DataFrame) -> DataFrame:
    """Members of families in the pairs of blocks that must meet.

    Members that are not similar to their leader stand in blocks from 0 on, which meet
    each other; the others in blocks below 0, which meet those.
    """
    near = led_directly()
    sizes = (
        rows.groupBy("leader")
        .agg(F.count_if(near).alias("near"), F.count_if(~near).alias("far"))
        .filter("far > 0")
    )
    near_blocks, far_blocks = (F.ceil(F.col(n) / FAMILY_ROWS).cast("int") for n in ("near", "far"))
    hashed = F.xxhash64("item")
    return (
        rows.withColumn("led", near)
        .join(sizes, "leader")
        .withColumn(
            "block",
            F.when(F.col("led"), -1 - F.pmod(hashed, near_blocks)).otherwise(F.pmod(hashed, far_blocks)).cast("int"),
        )
        .withColumn(
            "other",
            F.explode(F.sequence(F.when(F.col("led"), F.lit(0)).otherwise(-near_blocks), far_blocks - 1)),
        )
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("near", "far", "led", "other")
    )


def family_links(rows: DataFrame) -> DataFrame:
    """Edges ``a, b`` that join the linked members of each family."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, FAMILY, rows=4 * FAMILY_ROWS):
            for first, after in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                a, b = linked_members(table.slice(first, after - first))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    led = rows.filter(led_directly() & (F.col("item") != F.col("leader")))
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = (
        dealt_families(rows)
        .repartition(n, *FAMILY)
        .sortWithinPartitions(*FAMILY)
        .mapInArrow(link, "a bigint, b bigint")
    )
    return met.unionByName(led.select(F.col("item").alias("a"), F.col("leader").alias("b")))


FAMILY = ("leader", "low", "high")


def linked_members(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Items of two blocks of a family (or one), and the least item each is linked to."""
    column = lambda name: table.column(name).to_numpy()
    items, size, less, block = map(column, ("item", "size", "less", "block"))
    apart = table.column("apart").combine_chunks()
    member = np.repeat(np.arange(len(items)), apart.value_lengths().to_numpy())
    token, which, often = np.unique(
        apart.flatten().to_numpy(), return_inverse=True, return_counts=True
    )
    # Differences that only one member has don't add to any overlap.
    shared = often[which] > 1
    member, which = member[shared], (np.cumsum(often > 1) - 1)[which[shared]]
    order = np.argsort(which, kind="stable")
    member, which = member[order], which[order]
    both = np.zeros((len(items), len(items)), np.float32)
    for start in range(0, int((often > 1).sum()), FAMILY_SHINGLES):
        a, b = np.searchsorted(which, [start, start + FAMILY_SHINGLES])
        held = np.zeros((len(items), FAMILY_SHINGLES), np.float32)
        held[member[a:b], which[a:b] - start] = 1
        both += held @ held.T
    overlap = column("leader_size")[0] - less[:, None] - less[None, :] + both.astype(np.int64)
    union = size[:, None] + size[None, :] - overlap
    # Pairs within a block are looked at where the block meets itself.
    apart_blocks = block[:, None] != block[None, :]
    fit = (TOP * overlap >= BOTTOM * union) & (apart_blocks | (column("low")[0] == column("high")[0]))
    i, j = np.nonzero(np.triu(fit, 1))
    least = np.arange(len(items))
    joined_up(least, i, j, items)
    moved = least != np.arange(len(items))
    return items[moved], items[least[moved]]


def largest_partner() -> Column:
    """The largest size that an entry can be similar to, if nothing before its place is shared."""
    rest = F.col("size") - F.col("pos")
    return F.floor(((TOP + BOTTOM) * rest - BOTTOM * F.col("size")) / BOTTOM)


def size_block(size: Column) -> Column:
    """Number of a size's block; it never falls with the size. Below 1 there is none."""
    step = float(np.log(TOP / BOTTOM)) / BLOCKS
    return F.when(size >= 1, F.floor(F.log(size.cast("double")) / step)).otherwise(-1)


def crossing_pairs(entries: DataFrame) -> DataFrame:
    """All pairs of different components and families in a list that may be similar.

    Entries of a list stand in blocks of size. The smaller one of a pair seeks the larger
    one, in the blocks from its own to the largest size that its place leaves open. A
    long list is dealt to several tasks, its one side in parts and its other side copied
    to each.
    """
    parts = F.ceil(F.col("n") / LIST_ROWS).cast("int")
    entry = F.struct("item", "size", "pos", "component", "family")
    left = entries.select(
        "key", size_block(F.col("size")).alias("block"), F.pmod(F.xxhash64("item"), parts).cast("int").alias("part"), entry.alias("x")
    )
    right = (
        entries.select(
            "key",
            F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
            size_block(F.col("size")).alias("home"),
            size_block(largest_partner()).alias("last"),
            entry.alias("y"),
        )
        .filter(F.col("last") >= F.col("home"))
        .withColumn("block", F.explode(F.sequence("home", "last")))
    )
    ordered = (F.col("home") != F.col("block")) | (F.col("x.item") < F.col("y.item"))
    return (
        left.join(right, ["key", "block", "part"])
        .filter(
            ordered
            & (F.col("x.component") != F.col("y.component"))
            & (F.col("x.family") != F.col("y.family"))
            & reachable("x", "y")
        )
        .select(F.least("x.item", "y.item").alias("a"), F.greatest("x.item", "y.item").alias("b"))
        .distinct()
    )


def links(documents: DataFrame, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
    """Sets of all documents, and ``item, component`` of the items with links."""
    sets = workspace.save(prefixes(documents, shared_levels(documents)), "sets")
    postings = sets.select(
        "item", F.col("n_shingles").alias("size"), F.explode(F.arrays_zip("prefix", "places")).alias("p")
    ).select(F.col("p.prefix").alias("key"), "item", "size", F.col("p.places").alias("pos"))
    shared = postings.groupBy("key").agg(F.min("item").alias("low"), F.max("item").alias("high"))
    keys = workspace.save(shared.filter(F.col("low") != F.col("high")).select("key"), "keys")
    lists = workspace.save(semi_join(postings, keys, "key").distinct(), "lists")

    wanted = sets.join(lists.select("item").distinct(), "item", "left_semi")
    firsts = workspace.save(
        wanted.groupBy("item").agg(F.min("doc_id").alias("doc_id")), "firsts"
    )
    contents = workspace.save(
        members(semi_join(documents.select("doc_id", "text"), firsts, "doc_id")).dropDuplicates(["item"]),
        "contents",
    )

    crowded = unsettled(lists, None).filter(F.col("crossing") > PAIRS_PER_ENTRY * F.col("n"))
    pairs = workspace.save(leader_pairs(crowded), "leaders")
    led = workspace.save(families(pairs, contents), "families")
    near = workspace.save(family_links(led), "family-links")
    labels = components(near, workspace, "families")
    # An item without a family is one by itself.
    family = led.groupBy("item").agg(
        F.max(F.when(F.col("leader") != F.col("item"), F.col("leader"))).alias("family")
    )
    entries = (
        unsettled(lists, labels)
        .join(family, "item", "left")
        .withColumn("family", F.coalesce("family", "item"))
    )
    crossing = workspace.save(crossing_pairs(entries), "crossing")
    last = workspace.save(compared(crossing, contents), "answers")
    return sets, components(near.unionByName(linked(last)), workspace, "all")


def joined(documents: DataFrame, workspace: Workspace) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of documents.

    A text without words, null or empty, has an empty set and is linked with
    nothing: it is its own component. Equal sets are linked. A set that only rows
    without an id have is linked with nothing else, and its component is null.
    Repeated rows give repeated results; other columns are not read.
    """
    sets, labels = links(documents, workspace)
    filled = sets.filter(F.col("n_shingles") > 0)
    named = (
        filled.groupBy("item")
        .agg(F.min("doc_id").alias("first_id"))
        .join(labels, "item", "left")
        .withColumn("component", F.coalesce("component", "item"))
    )
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_item = named.join(least, "component").select(F.col("item").alias("of"), "component_id")
    return (
        sets.drop("prefix", "places")
        .join(of_item, (F.col("item") == F.col("of")) & (F.col("n_shingles") > 0), "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
