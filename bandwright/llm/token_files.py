"""Token ids in files of independent zstandard frames with a trailing seek table.

Documents are dealt out by ranges of ids and sorted within them, so that files in
order of their number hold the documents in ascending order of id, nulls last. A
task encodes its range as it streams past and writes one file:

    frames        ids of one document, FRAME_IDS at most to a frame, little-endian, of
                  2 or 4 bytes each by the size of the vocabulary; each frame stands
                  alone and ends with zstandard's own checksum
    seek table    a skippable frame: for every frame its place, sizes, the checksum of
                  its content and its document; then FOOTER: entries, bytes per id,
                  checksum of the entries, magic number
    separator     an empty skippable frame; one also follows every run of frames

Spark's text writer writes the files: a row is a run of frames and the separator is
the line separator, so every zstandard decoder reads a whole file, and commits,
retries and speculative copies are Spark's, on any file system it knows. A reader
takes the seek table from the end and decompresses the frames of the wanted documents
only.

Defined results: a null text counts as empty, an empty one is the end id alone. Rows
with one id stand together, by the hash of their text. Rows without an id come last.
Every row of the table is a document, repeated or not; an empty table gives no
documents. Only ``doc_id`` (a whole number) and ``text`` are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandwright.llm import texts as T
from bandwright.llm.packing import public_path
from bandwright.llm.tables import BROADCAST_IDS

__all__ = ["entries", "placed", "public_path", "read", "write"]

END = 0
LEVEL = 3
# Ids of a frame at most; a longer document has several frames.
FRAME_IDS = 1 << 18
# Bytes of text a file holds, about.
FILE_BYTES = 32_000_000
# Bytes of frames written, or of ids read, at a time.
RUN_BYTES = 4_000_000

SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
TABLE_MAGIC = 0x184D2A5E
# Entries, bytes per id, checksum of the entries, magic number.
FOOTER = "<QIII"
FOOTER_BYTES = struct.calcsize(FOOTER)
FOOTER_MAGIC = 0x8F92EAB1
ENTRY = np.dtype(
    [
        ("place", "<u8"),
        ("bytes", "<u4"),
        ("ids", "<u4"),
        ("checksum", "<u4"),
        ("has_id", "u1"),
        ("last", "u1"),
        ("doc", "<i8"),
    ]
)
PACKED_ENTRY = "<QIIIBBq"


def checksum(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


# Chunks a worker remembers, and the longest of them; when there are more it starts afresh.
KEPT_CHUNKS, KEPT_CHARS = 600_000, 40
# A byte-level tokenizer that splits words as GPT-2's does takes a run of letters, or of
# signs, with one space before it, as a word if something else follows; it never joins
# what stands on both sides of the start of white space, and looks no further than to the
# first character behind it. So texts can be cut into such words, and, where others
# come, from white space to white space.
LETTERS, SIGNS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r".,;:!?)\"-"
WORD = rf" ?(?:[{LETTERS}]+(?=[ \t-\r{SIGNS}]|\Z)|[{SIGNS}]+(?=[ \t-\r]|\Z))"
CHUNK = re.compile(rf"{WORD}|[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
ONE_WORD = re.compile(rf" ?(?:[{LETTERS}]+|[{SIGNS}]+)")
# White space that not every engine counts as such. Texts with it are not cut.
ODD_SPACE = (
    *"\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008",
    *"\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff",
)


class ChunkIds(dict):
    """Ids by chunk of text, as bytes, asked of the tokenizer once for each that is remembered."""

    def __init__(self, known):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.known = known
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # The characters that stand for the bytes of words.
        self.spelling = str.maketrans({chr(k): level.pre_tokenize_str(chr(k))[0][0] for k in range(32, 127)})
        for lead in (0xC2, 0xC3):
            for k in range(0x80, 0xC0):
                spelled = level.pre_tokenize_str(bytes([lead, k]).decode())[0][0]
                self.spelling[lead], self.spelling[k] = spelled

    def __missing__(self, chunk: str) -> bytes:
        if ONE_WORD.fullmatch(chunk):
            spelled = chunk.replace(" ", self.spelling[32])
            if not chunk.isascii():
                spelled = chunk.encode().decode("latin-1").translate(self.spelling)
            ids = [token.id for token in self.known.model.tokenize(spelled)]
        else:
            ids = self.known.encode(chunk, add_special_tokens=False).ids
        ids = array("I", ids).tobytes()
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= KEPT_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """The ids of ``encode(text, add_special_tokens=False)``, each frequent chunk encoded once.

    Texts are cut only for tokenizers that are known to allow it, and only if they hold
    no added token and no odd white space; all others go through the tokenizer whole.
    """

    def __init__(self, path: str):
        # A task keeps to its own core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known = Tokenizer.from_file(path)
        self.by_chunk = ChunkIds(self.known)
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        split = said["pre_tokenizer"] or {}
        self.cuts = (
            said["normalizer"] is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space", True)
            and said["model"]["type"] == "BPE"
            and not said["model"].get("dropout")
        )
        self.uncut = (*ODD_SPACE, *(token["content"] for token in said["added_tokens"]))

    def encode(self, text: str) -> np.ndarray:
        if not self.cuts or any(odd in text for odd in self.uncut):
            return np.array(self.known.encode(text, add_special_tokens=False).ids, np.uint32)
        found = map(self.by_chunk.__getitem__, CHUNK.findall(text))
        return np.frombuffer(b"".join(found), np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer's file, loaded once per worker."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int):
    """``doc_id, ids`` of every row, the end id included."""
    known = encoder(path)
    for batch in T.slices(batches, "text"):
        texts = pc.fill_null(batch.column("text"), "").to_pylist()
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
            yield doc, np.append(known.encode(text), np.uint32(end))


def write(
    documents: DataFrame,
    folder: str,
    path: str,
    end: int = END,
    file_bytes: int = FILE_BYTES,
    frame_ids: int = FRAME_IDS,
) -> None:
    """Encode all documents and write them to files below ``folder``."""
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(-(-size // file_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def one_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        width = 2 if max(encoder(path).known.get_vocab_size(), end + 1) <= 1 << 16 else 4
        table, run, written = bytearray(), bytearray(), 0
        for doc, ids in encoded(batches, path, end):
            for start in range(0, len(ids), frame_ids):
                part = ids[start : start + frame_ids]
                content = part.astype(f"<u{width}").tobytes()
                frame = packer.compress(content)
                table += struct.pack(
                    PACKED_ENTRY,
                    written + len(run),
                    len(frame),
                    len(part),
                    checksum(content),
                    doc is not None,
                    start + frame_ids >= len(ids),
                    doc or 0,
                )
                run += frame
                if len(run) >= RUN_BYTES:
                    yield pa.RecordBatch.from_pydict({"value": [bytes(run)]})
                    written += len(run) + len(SEPARATOR)
                    run.clear()
        if table:
            if run:
                yield pa.RecordBatch.from_pydict({"value": [bytes(run)]})
            footer = struct.pack(
                FOOTER, len(table) // ENTRY.itemsize, width, zlib.crc32(table), FOOTER_MAGIC
            )
            head = struct.pack("<II", TABLE_MAGIC, len(table) + len(footer))
            yield pa.RecordBatch.from_pydict({"value": [head + bytes(table) + footer]})

    order = [F.col("doc_id").asc_nulls_last(), "tie", "part"]
    (
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "text",
            F.xxhash64("text").alias("tie"),
            F.spark_partition_id().alias("part"),
        )
        # Rows of one id may be many: their texts and partitions range as well.
        .repartitionByRange(files, *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
        .mapInArrow(one_file, "value binary")
        .select(F.col("value").cast("string"))
        .write.option("lineSep", SEPARATOR.decode())
        .option("compression", "none")
        .text(folder)
    )


def seek_table(content: memoryview) -> tuple[np.ndarray, int]:
    """Entries of a file's frames and bytes per id; a damaged table is an error."""
    if not len(content):
        return np.zeros(0, ENTRY), 4
    end = len(content) - len(SEPARATOR)
    n, width, stated, magic = struct.unpack(FOOTER, content[end - FOOTER_BYTES : end])
    start = end - FOOTER_BYTES - n * ENTRY.itemsize
    if magic != FOOTER_MAGIC or start < 8 or zlib.crc32(content[start : end - FOOTER_BYTES]) != stated:
        raise ValueError("no seek table at the end of the file")
    return np.frombuffer(content[start : end - FOOTER_BYTES], ENTRY), width


def document_bounds(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entry of every document, and the entry after its last."""
    after = np.flatnonzero(table["last"]) + 1
    return np.append(0, after[:-1])[: len(after)], after


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """``file, content`` of the written files; files are numbered as their ranges are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(
        F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "content"
    )


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """``file, place, doc_id, before, n_tokens`` from the seek tables; nothing is decompressed.

    ``place`` numbers a file's documents, ``before`` counts the ids that precede one there.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                table, _ = seek_table(memoryview(content.as_buffer()))
                first, after = document_bounds(table)
                total = np.append(0, np.cumsum(table["ids"], dtype=np.int64))
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": pa.array(np.full(len(first), file, np.int32)),
                        "place": pa.array(np.arange(len(first), dtype=np.int32)),
                        "doc_id": doc_ids(table[first]),
                        "before": pa.array(total[first]),
                        "n_tokens": pa.array(total[after] - total[first]),
                    }
                )

    return contents(spark, folder).mapInArrow(
        look, "file int, place int, doc_id bigint, before bigint, n_tokens bigint"
    )


def doc_ids(table: np.ndarray) -> pa.Array:
    return pa.array(table["doc"].astype(np.int64), mask=table["has_id"] == 0)


def decoded(content: memoryview, table: np.ndarray, width: int, unpacker) -> bytes:
    """A document's ids as little-endian unsigned 32-bit numbers, every frame checked."""
    found = []
    for entry in table:
        start = int(entry["place"])
        raw = unpacker.decompress(content[start : start + int(entry["bytes"])])
        if len(raw) != width * int(entry["ids"]) or checksum(raw) != entry["checksum"]:
            raise ValueError("a frame differs from its seek table")
        found.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
    return b"".join(found)


def read(
    spark: SparkSession, folder: str, wanted: DataFrame | None = None, limit: int = BROADCAST_IDS
) -> DataFrame:
    """``file, place, doc_id, before, n_tokens, ids`` of all documents, or of the wanted ones.

    ``ids`` are bytes: unsigned 32-bit numbers, little-endian. ``wanted`` has a column
    ``doc_id``; frames of other documents are not decompressed. A list of more than
    ``limit`` ids is not sent to the readers but joined to what they read.
    """
    chosen = None
    if wanted is not None:
        ids = wanted.select(F.col("doc_id").cast("long")).filter("doc_id is not null").distinct()
        some = ids.limit(limit + 1).toPandas()["doc_id"].to_numpy(np.int64)
        if len(some) > limit:
            return read(spark, folder).join(ids, "doc_id", "left_semi").select(*COLUMNS)
        chosen = spark.sparkContext.broadcast(np.sort(some))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                view = memoryview(content.as_buffer())
                table, width = seek_table(view)
                first, after = document_bounds(table)
                total = np.append(0, np.cumsum(table["ids"], dtype=np.int64))
                sizes = total[after] - total[first]
                places = np.arange(len(first))
                if chosen is not None:
                    known = table["has_id"][first] == 1
                    places = places[known & np.isin(table["doc"][first], chosen.value)]
                cuts = np.flatnonzero(np.diff(np.cumsum(sizes[places] * 4) // RUN_BYTES)) + 1
                for part in np.split(places, cuts):
                    ids = [decoded(view, table[first[k] : after[k]], width, unpacker) for k in part]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file": pa.array(np.full(len(part), file, np.int32)),
                            "place": pa.array(part.astype(np.int32)),
                            "doc_id": doc_ids(table[first[part]]),
                            "before": pa.array(total[first[part]]),
                            "n_tokens": pa.array(sizes[part]),
                            "ids": pa.array(ids, pa.binary()),
                        }
                    )

    return contents(spark, folder).mapInArrow(
        decode, "file int, place int, doc_id bigint, before bigint, n_tokens bigint, ids binary"
    )


COLUMNS = ("file", "place", "doc_id", "before", "n_tokens", "ids")


def placed(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """``found`` with ``start``, the ids of all documents before, in place of ``before``.

    ``sizes`` are all documents' ``file, n_tokens``. One row per file meets in the
    running sum, never one per document.
    """
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    starts = totals.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return (
        found.join(starts, "file")
        .withColumn("start", F.col("base") + F.col("before"))
        .drop("base", "before")
    )
