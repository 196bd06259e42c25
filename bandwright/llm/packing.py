"""Best-fit packing of documents into training sequences, after dominance reduction.

Documents are tokenized once and cut into pieces no longer than a sequence. How
to pack them depends only on how many pieces there are of each length, so the
plan is made from that histogram (CAPACITY rows at most): sets that provably
dominate every other set for their largest piece are fixed for good (Martello and
Toth's reduction), and what is left is packed best fit, longest first. The plan
says, for runs of pieces of one length, which sequence and offset each gets;
pieces find their place by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwright.llm import texts as T
from bandwright.llm.tables import Workspace
from bandwright.llm.toxicity import folded, lookup

CAPACITY = 4096
END = 1
# Pieces of one length that are ranked together, about.
RANKED_ROWS = 2000
# Words whose ids a worker keeps; when there are more it starts afresh.
KEPT_WORDS = 1_000_000

DIGIT = (T.BYTES >= 48) & (T.BYTES <= 57)
SPACES, LETTERS, DIGITS, OTHERS = range(4)
CLASS = np.select([T.SPACE, T.LETTER, DIGIT], [SPACES, LETTERS, DIGITS], OTHERS).astype(np.int8)


class WordTokenizer:
    """Ids of texts by a word-wise BPE tokenizer, each distinct word encoded once.

    For texts of ASCII and Latin-1 letters the tokenizer's words are cut from the
    bytes of a whole batch and looked up by hash. Every other text (other scripts,
    other symbols, special tokens) goes through the tokenizer as it is. Both give the ids of
    ``encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in chain(range(1, 128), range(0xC0, 0x100))]
        self.spelling = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        self.spelling[0] = level.pre_tokenize_str("a\0")[0][0][1:]
        self.forget()

    def plain(self, texts: T.Texts) -> np.ndarray:
        """Texts that can be cut by bytes."""
        data = texts.data
        after_c3 = np.zeros(len(data), bool)
        after_c3[1:] = data[:-1] == 0xC3
        odd = (data >= 0x80) & ~(
            (data == 0xC3) | (after_c3 & T.CONTINUATION[data] & (data != 0x97) & (data != 0xB7))
        )
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        return texts.count(odd) == 0

    def words(self, texts: T.Texts, data: np.ndarray) -> T.Runs:
        """Runs of letters, single digits, runs of other symbols, and contractions."""
        kind = CLASS[data]
        before = np.full(len(data), SPACES, np.int8)
        before[1:] = kind[:-1]
        before[texts.offsets[:-1][texts.offsets[:-1] < len(data)]] = SPACES
        start = (kind != SPACES) & ((kind != before) | (kind == DIGITS))
        quotes = np.flatnonzero((data == ord("'")) & (before != OTHERS))
        if len(quotes):
            self.contract(texts, data, quotes, start)
        starts = np.flatnonzero(start)
        solid = kind != SPACES
        ends = np.append(starts[1:], len(data))[: len(starts)]
        # A word ends at the next space, at the end of its text, or where the next starts.
        gaps = np.append(np.flatnonzero(~solid), len(data))
        ends = np.minimum(ends, gaps[np.searchsorted(gaps, starts)])
        offsets = np.searchsorted(starts, texts.offsets)
        text_end = np.repeat(texts.offsets[1:], np.diff(offsets))
        return T.Runs(starts, np.minimum(ends, text_end), offsets)

    def contract(self, texts, data, quotes, start) -> None:
        """Move word starts for 's 't 'm 'd 're 've 'll, which are words of their own."""
        text = np.searchsorted(texts.offsets, quotes, "right")
        room = texts.offsets[text] - quotes
        padded = np.append(data, np.zeros(3, np.uint8))
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = (room >= 2) & np.isin(one, list(b"stmd"))
        pairs = np.zeros(len(quotes), bool)
        for a, b in (b"re", b"ve", b"ll"):
            pairs |= (one == a) & (two == b)
        long = (room >= 3) & pairs & ~short
        for found, size in ((quotes[short], 2), (quotes[long], 3)):
            start[found + 1] = False
            after = found + size
            ends = texts.offsets[np.searchsorted(texts.offsets, found, "right")]
            after = after[after < ends]
            start[after] |= CLASS[data[after]] != SPACES

    def forget(self) -> None:
        """Start with no known words: hashes in order, and where their ids are."""
        self.keys = np.zeros(0, T.U64)
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Encode new words, whose hashes are in order."""
        tokenize, spelling = self.whole.model.tokenize, self.spelling
        found = [[t.id for t in tokenize(word.translate(spelling))] for word in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = self.used + np.cumsum(sizes)
        if ends[-1] > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(2 * ends[-1] - len(self.ids), np.uint32))
        self.ids[self.used : ends[-1]] = list(chain.from_iterable(found))
        self.used = int(ends[-1])
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.starts = np.insert(self.starts, place, ends - sizes)
        self.sizes = np.insert(self.sizes, place, sizes)

    def lookup(self, data: np.ndarray, words: T.Runs) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids end to end."""
        hashes = T.run_hashes(data, words)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_WORDS:
            self.forget()
        new = first[~lookup(self.keys, distinct)[1]]
        if len(new):
            raw = data.tobytes()
            spans = zip(words.starts[new].tolist(), words.ends[new].tolist())
            self.learn(hashes[new], [raw[start:end].decode() for start, end in spans])
        place = np.searchsorted(self.keys, distinct)
        counts = self.sizes[place][which]
        shift = self.starts[place][which] - (np.cumsum(counts) - counts)
        return counts, self.ids[np.arange(counts.sum()) + np.repeat(shift, counts)]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, without special tokens; null counts as empty."""
        texts = T.column_bytes(column)
        data = folded(texts.data)
        words = self.words(texts, data)
        plain = self.plain(texts)
        keep = plain[words.text]
        counts = np.zeros(len(words.starts), np.int64)
        some = T.Runs(words.starts[keep], words.ends[keep], np.zeros(1, np.int64))
        counts[keep], ids = self.lookup(data, some)
        ends = np.concatenate([[0], np.cumsum(counts)])[words.offsets]
        for text, by_bytes in enumerate(plain):
            if by_bytes:
                yield ids[ends[text] : ends[text + 1]]
            else:
                whole = self.whole.encode(column[text].as_py(), add_special_tokens=False)
                yield np.array(whole.ids, np.uint32)


def public_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is on this machine, as on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``.

    A document is its ids and the end id; a null or empty text is the end id
    alone. Repeated rows give repeated pieces; other columns are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, WordTokenizer(path))
        for batch in T.slices(batches, "text"):
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for row, ids in enumerate(tokenizer.encode(batch.column("text"))):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for number, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append(row)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (starts, lengths, sums)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return documents.select("doc_id", "text").mapInArrow(cut, schema)


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences that hold, in order, (length, how many) of pieces."""

    held: tuple[tuple[int, int], ...]
    times: int


class Lengths:
    """A multiset of lengths with its distinct values in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = Counter({w: n for w, n in counts.items() if n > 0})
        self.order = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.order.pop(bisect_left(self.order, length))

    def at_most(self, length: int) -> int | None:
        place = bisect_left(self.order, length + 1)
        return self.order[place - 1] if place else None

    def least_sum(self, above: int, n: int) -> float:
        """Least sum of ``n`` pieces longer than ``above``."""
        total = 0
        for length in self.order[bisect_left(self.order, above + 1) :]:
            used = min(n, self.counts[length])
            total, n = total + used * length, n - used
            if not n:
                return total
        return float("inf")


def dominating(left: Lengths, length: int, capacity: int) -> tuple[int, ...] | None:
    """Pieces that, put with one of ``length``, dominate all other choices; None: unknown.

    A set dominates another if the other's pieces can be parted into groups that
    each fit in place of a piece of the first. ``left`` is without the piece.
    """
    room = capacity - length
    best = left.at_most(room)
    if best is None:
        return ()
    if best == room or left.least_sum(0, 2) > room:
        return (best,)
    if left.least_sum(0, 3) > room:
        second_room = room - best
        left.take(best, 1)
        second = left.at_most(second_room)
        left.counts[best] += 1
        if left.counts[best] == 1:
            insort(left.order, best)
        # Pairs of which both are longer than the second piece don't fit.
        if left.least_sum(second or 0, 2) > room:
            return (best,) if second is None else (best, second)
    return None


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], Lengths]:
    """Sets that are fixed, and the pieces that are left."""
    left, fixed = Lengths(counts), []
    for length in sorted(left.counts, reverse=True):
        while left.counts[length]:
            left.take(length, 1)
            partners = dominating(left, length, capacity)
            left.counts[length] += 1
            if left.counts[length] == 1:
                insort(left.order, length)
            if partners is None:
                break
            used = Counter((length, *partners))
            times = min(left.counts[w] // k for w, k in used.items())
            # What dominates now still does with fewer pieces, as long as these last.
            for w, k in used.items():
                left.take(w, k * times)
            fixed.append(Pattern(tuple(sorted(used.items(), reverse=True)), times))
    return fixed, left


def best_fit(left: Lengths, capacity: int) -> list[Pattern]:
    """Longest first, each piece into the open sequence with the least room for it.

    Sequences that hold the same are moved together.
    """
    rooms: dict[int, list[Pattern]] = defaultdict(list)
    order: list[int] = []

    def put(room: int, pattern: Pattern) -> None:
        if not rooms[room]:
            insort(order, room)
        rooms[room].append(pattern)

    for length in sorted(left.counts, reverse=True):
        n = left.counts[length]
        while n:
            place = bisect_left(order, length)
            if place < len(order):
                room = order[place]
                pattern = rooms[room].pop()
                if not rooms[room]:
                    order.pop(place)
            else:
                room, pattern = capacity, Pattern((), n)
            each = min(room // length, n)
            times = min(pattern.times, n // each)
            if pattern.held and times < pattern.times:
                put(room, Pattern(pattern.held, pattern.times - times))
            put(room - each * length, Pattern((*pattern.held, (length, each)), times))
            n -= each * times
    return [pattern for patterns in rooms.values() for pattern in patterns]


# A run: pieces of ``length`` with ranks from ``rank``; ``each`` of them go to one
# sequence after the other from ``sequence``, the first of each at ``offset``.
RUN = np.dtype([(name, np.int64) for name in ("length", "rank", "each", "sequence", "offset")])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs in order of length and rank that place every piece of the histogram."""
    fixed, left = reduced(counts, capacity)
    runs, ranks, sequence = [], Counter(), 0
    for pattern in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for length, each in pattern.held:
            runs.append((length, ranks[length], each, sequence, offset))
            ranks[length] += each * pattern.times
            offset += length * each
        sequence += pattern.times
    return np.sort(np.array(runs, RUN), order=["length", "rank"])


def ranked(cut: DataFrame, counts: dict[int, int]) -> DataFrame:
    """The pieces with their rank, from 0, among those of their length.

    Pieces of a common length are ranked in cells of bounded size; a cell starts
    after all pieces of the cells before it.
    """
    spark = cut.sparkSession
    cells = spark.createDataFrame(
        [(w, -(-n // RANKED_ROWS)) for w, n in counts.items()], "length bigint, cells bigint"
    )
    dealt = cut.join(F.broadcast(cells), "length").withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "piece"), "cells")
    )
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("length", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    within = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("number", F.row_number().over(within))
        .join(starts, ["length", "cell"])
        .withColumn("rank", F.col("first") + F.col("number") - 1)
        .drop("cells", "cell", "number", "first")
    )


def placed(numbered: DataFrame, runs: np.ndarray) -> DataFrame:
    """Ranked pieces with ``sequence_id`` and ``offset``; runs number a few per length."""
    shared = numbered.sparkSession.sparkContext.broadcast(runs)
    columns = [c for c in numbered.columns if c != "rank"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        # No rank reaches 2**44, no length 2**19.
        keys = (table["length"] << 44) + table["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            run = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            turn, slot = np.divmod(rank - run["rank"], run["each"])
            arrays = [batch.column(c) for c in columns]
            arrays += [pa.array(run["sequence"] + turn), pa.array(run["offset"] + slot * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    fields = ", ".join(f"{c} {numbered.schema[c].dataType.simpleString()}" for c in columns)
    return numbered.mapInArrow(find, f"{fields}, sequence_id bigint, offset bigint")


def packed(
    documents: DataFrame, path: str, workspace: Workspace, capacity: int = CAPACITY
) -> DataFrame:
    """Every piece with its sequence and its offset there; empty for no documents."""
    cut = workspace.save(pieces(documents, path, capacity), "pieces")
    # One row per length, at most ``capacity`` of them.
    histogram = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {row["length"]: row["n"] for row in histogram.collect()}
    return placed(ranked(cut, counts), plan(counts, capacity)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
