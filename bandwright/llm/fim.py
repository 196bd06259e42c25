"""Fill-in-middle transformation, assembled and restored by secondary sorts.

A text is cut into units (a run of ASCII letters, or any other code point). The
prefix, the suffix and the middle leave the scan as pieces of whole units, keyed by
their document and by their position in the output. The pieces are dealt out by
document and sorted by position within their partition (in DataFrame terms what
``repartitionAndSortWithinPartitions`` does for pairs), so that a document's output
streams past, piece by piece, into an incremental digest. The restorer sees the
output and the form only: it finds the sentinels in the stream, names the part each
run of bytes is in, and one more sort within the same partitions puts the parts back
in the order of the text, which streams into a second digest. Texts are shuffled once.

Nothing holds an output: a task keeps one piece of one document at a time, whatever
the document's length. A document's row is known by its id, a digest of its text and
the partition it was read from, all of which a re-run task finds again; equal rows of
a partition are counted, so each of them gives a row.

Defined results: a null text is empty, and an empty text is plain. A null id hashes
as ``1:`` with nothing behind it. Repeated rows give repeated results, an empty table
none. Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm import texts as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Parts of a transformed output, in order; and the place of each in the text.
OUTPUT_ORDER = {PSM: (PREFIX, SUFFIX, MIDDLE), SPM: (SUFFIX, PREFIX, MIDDLE)}
TEXT_ORDER = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
# Rank of the row that closes a document, after its parts.
CLOSING = 3
# Shares, in percent, of texts that are transformed, and of these of the form spm.
TRANSFORMED, SUFFIX_FIRST = 90, 20
# Units of a piece at most.
UNITS = 4096
# Bytes of pieces put out at a time.
BATCH_BYTES = 4_000_000

LETTER = ((T.BYTES | 32) >= 97) & ((T.BYTES | 32) <= 122)
KEY = ("doc_id", "text_key", "part")


def draws(doc_id: Column) -> list[Column]:
    """Four numbers below 2**32 from the hashed id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def units(texts: T.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte place of every unit, and per text the range of its units."""
    letter = LETTER[texts.data]
    before = np.zeros(len(letter), bool)
    before[1:] = letter[:-1]
    firsts = texts.offsets[:-1]
    before[firsts[firsts < len(letter)]] = False
    places = np.flatnonzero((letter & ~before) | ~(letter | T.CONTINUATION[texts.data]))
    return places, np.searchsorted(places, texts.offsets)


class Rows:
    """Rows for one schema, as record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, row: tuple, size: int = 0) -> bool:
        """Whether the rows should be put out now."""
        self.rows.append(row)
        self.held += size + 64
        return self.held >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.held = [], 0
        arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def ddl(schema: pa.Schema, doc_id: str) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {doc_id if f.name == 'doc_id' else kinds[f.type]}" for f in schema)


def fields(doc_id: pa.DataType, *named: tuple[str, pa.DataType]) -> pa.Schema:
    key = [("doc_id", doc_id), ("text_key", pa.binary()), ("part", pa.int32())]
    return pa.schema([*key, *named])


FACTS = (
    ("form", pa.string()),
    ("n", pa.int64()),
    ("prefix_chars", pa.int64()),
    ("middle_chars", pa.int64()),
)


def arrow_type(documents: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(documents.schema["doc_id"].dataType)


def pieces(documents: DataFrame) -> DataFrame:
    """Pieces of every output: key, ``position`` there, ``chunk`` of UTF-8, sentinel first.

    ``form, n, prefix_chars, middle_chars`` stand on a document's first piece.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = fields(
        arrow_type(documents), ("position", pa.int32()), ("chunk", pa.binary()), *FACTS
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in T.slices(batches, "text"):
            texts = T.column_bytes(batch.column("text"))
            raw = texts.data.tobytes()
            places, bounds = units(texts)
            chars = np.append(0, np.cumsum(~T.CONTINUATION[texts.data]))
            n = np.diff(bounds)
            h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in range(1, 5))
            a, b = h1 % (n + 1), h2 % (n + 1)
            ends = [np.zeros(len(n), np.int64), np.minimum(a, b), np.maximum(a, b), n]
            marked = batch.column("marked").to_numpy(zero_copy_only=False)
            plain = (n == 0) | marked | (h3 % 100 >= TRANSFORMED)
            spm = h4 % 100 < SUFFIX_FIRST
            ids = batch.column("doc_id").to_pylist()
            parts = batch.column("part").to_pylist()
            for row, doc in enumerate(ids):
                start, end = int(texts.offsets[row]), int(texts.offsets[row + 1])
                first = int(bounds[row])

                def byte(unit: int) -> int:
                    return int(places[first + unit]) if unit < n[row] else end

                key = (doc, hashlib.blake2b(raw[start:end], digest_size=16).digest(), parts[row])
                cuts = [int(e[row]) for e in ends]
                if plain[row]:
                    wanted = [("", 0, cuts[3])]
                    facts = (PLAIN, cuts[3], None, None)
                else:
                    form = SPM if spm[row] else PSM
                    at = {PREFIX: cuts[:2], MIDDLE: cuts[1:3], SUFFIX: cuts[2:]}
                    wanted = [(mark, *at[mark]) for mark in OUTPUT_ORDER[form]]
                    to = [chars[byte(u)] for u in cuts[:3]]
                    facts = (form, cuts[3], int(to[1] - to[0]), int(to[2] - to[1]))
                position = 0
                for mark, low, high in wanted:
                    for unit in range(low, max(high, low + 1), UNITS):
                        chunk = raw[byte(unit) : byte(min(unit + UNITS, high))]
                        if unit == low:
                            chunk = mark.encode() + chunk
                        said = facts if position == 0 else (None,) * len(facts)
                        if out.add((*key, position, chunk, *said), len(chunk)):
                            yield out.batch()
                        position += 1
        yield out.batch()

    h = [c.alias(f"h{k}") for k, c in enumerate(draws(F.col("doc_id")), 1)]
    text = F.coalesce("text", F.lit(""))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    rows = documents.select(
        "doc_id", text.alias("text"), F.spark_partition_id().alias("part"), *h, marked.alias("marked")
    )
    return rows.mapInArrow(cut, ddl(schema, kind))


class Parts:
    """Which part of the text each run of an output is in, as the output streams past.

    A text that is transformed holds no sentinel, and the end of one part with the
    start of the next sentinel cannot look like one, so the first match is the sentinel.
    """

    def __init__(self, form: str):
        self.ahead = list(OUTPUT_ORDER.get(form, ()))
        self.rank = 0
        self.held = b""

    def feed(self, chunk: bytes) -> Iterator[tuple[int, bytes]]:
        data = self.held + chunk
        while self.ahead:
            mark = self.ahead[0].encode()
            found = data.find(mark)
            if found < 0:
                # A sentinel may go on in the next chunk.
                keep = max(len(data) - len(mark) + 1, 0)
                self.held = data[keep:]
                if keep:
                    yield self.rank, data[:keep]
                return
            if found:
                yield self.rank, data[:found]
            data = data[found + len(mark) :]
            self.rank = TEXT_ORDER[self.ahead.pop(0)]
        self.held = b""
        if data:
            yield self.rank, data

    def rest(self) -> Iterator[tuple[int, bytes]]:
        if self.held:
            yield self.rank, self.held


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, tuple]]:
    """Rows with their key and whether it is a new one."""
    last = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            key = row[: len(KEY)]
            yield key, key != last, row[len(KEY) :]
            last = key


def dealt(found: DataFrame) -> DataFrame:
    """Pieces by document, in order of position within their partition."""
    return found.repartition(*KEY).sortWithinPartitions(*KEY, "position")


def parted(sorted_pieces: DataFrame) -> DataFrame:
    """The outputs' runs by part: key, ``rank``, ``place``, ``chunk``, and a closing row.

    The closing row of a document holds its facts, how many rows are equal to it, and
    the digest of its output.
    """
    kind = sorted_pieces.schema["doc_id"].dataType.simpleString()
    schema = fields(
        arrow_type(sorted_pieces),
        ("rank", pa.int32()),
        ("place", pa.int32()),
        ("chunk", pa.binary()),
        *FACTS,
        ("copies", pa.int32()),
        ("output_sha256", pa.string()),
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        nothing = (None,) * (len(FACTS) + 2)
        current = None

        def closed() -> Iterator[tuple[tuple, int]]:
            if current:
                yield from runs(splitter.rest())
                yield (*current, CLOSING, place, None, *facts, copies, digest.hexdigest()), 0

        def runs(found) -> Iterator[tuple[tuple, int]]:
            nonlocal place
            for rank, chunk in found:
                yield (*current, rank, place, chunk, *nothing), len(chunk)
                place += 1

        for key, new, (position, chunk, *said) in keyed(batches):
            if new:
                for row in closed():
                    if out.add(*row):
                        yield out.batch()
                current, facts, copies, place, last = key, said, 0, 0, -1
                digest, splitter = hashlib.sha256(), Parts(said[0])
            copies += position == 0
            if position == last:
                continue
            last = position
            digest.update(chunk)
            for row in runs(splitter.feed(chunk)):
                if out.add(*row):
                    yield out.batch()
        for row in closed():
            out.add(*row)
        yield out.batch()

    return sorted_pieces.mapInArrow(stream, ddl(schema, kind))


def restored(parts: DataFrame) -> DataFrame:
    """One row per document, with the digest of the text put together from its output."""
    kind = parts.schema["doc_id"].dataType.simpleString()
    named = ("output_sha256", pa.string()), ("restored_sha256", pa.string())
    schema = pa.schema([("doc_id", arrow_type(parts)), *FACTS, *named])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for key, new, (rank, _, chunk, *facts, copies, output) in keyed(batches):
            if new:
                digest = hashlib.sha256()
            if rank < CLOSING:
                digest.update(chunk)
                continue
            for _ in range(copies):
                if out.add((key[0], *facts, output, digest.hexdigest())):
                    yield out.batch()
        yield out.batch()

    return parts.sortWithinPartitions(*KEY, "rank", "place").mapInArrow(stream, ddl(schema, kind))


def transformed(documents: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``."""
    return restored(parted(dealt(pieces(documents)))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


def outputs(documents: DataFrame) -> DataFrame:
    """``doc_id, form, output``: the texts to train on, one row per row of the documents.

    A row holds its whole output, as it held its whole text.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = pa.schema(
        [("doc_id", arrow_type(documents)), ("form", pa.string()), ("output", pa.string())]
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        current = None

        def whole() -> tuple:
            return current[0], form, b"".join(chunks).decode()

        for key, new, (position, chunk, *said) in keyed(batches):
            if new:
                for _ in range(copies if current else 0):
                    if out.add(whole(), sum(map(len, chunks))):
                        yield out.batch()
                current, form, chunks, copies, last = key, said[0], [], 0, -1
            copies += position == 0
            if position != last:
                chunks.append(chunk)
            last = position
        for _ in range(copies if current else 0):
            if out.add(whole(), sum(map(len, chunks))):
                yield out.batch()
        yield out.batch()

    return dealt(pieces(documents)).mapInArrow(stream, ddl(schema, kind))
