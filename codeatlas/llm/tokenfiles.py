"""Token files: independent zstandard frames, a trailing seek table and a
checksum for each frame (operator 3).

A file holds a run of documents in ascending id order as little-endian unsigned
32-bit ids: data frames; a skippable frame with the documents (id, null mark,
number of ids); a skippable frame with the seek table (compressed size,
decompressed size, low 32 bits of XXH64 for each frame; then frame count,
descriptor, magic number). A reader takes the tail first and decompresses only
the frames that hold requested documents.

Tasks write to names of their own, and a table of the files that belong to the
result is written after all of them: a repeated or lost attempt leaves a file
that no reader opens.

Defined cases: a null text is empty and keeps its end id; rows sort by (id,
text hash), null ids first, and equal ids and repeated rows are documents of
their own; an empty table gives an empty file list; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeatlas.llm.common import batches, bounded_batches
from codeatlas.llm.vocab import encoder, tokenizer_path
from codeatlas.sources.files import filesystem

# FIXED VALUES: magic numbers of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
# END FIXED VALUES

END_ID = 2
FRAME_IDS = 1 << 14  # a frame ends with the document that reaches this
LONG_FRAME = 4       # frames of this many times FRAME_IDS cut a long document
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n_ids", "<i8")])


class Writer:
    """Writes one file; ``add`` takes documents in order."""

    def __init__(self, stream, level: int = 3):
        import zstandard
        self.stream, self.zstd = stream, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.held = bytearray()

    def _frame(self, n: int) -> None:
        import xxhash
        plain = bytes(self.held[:n])
        del self.held[:n]
        packed = self.zstd.compress(plain)
        self.stream.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.held += ids
        while len(self.held) >= 4 * FRAME_IDS * LONG_FRAME:
            self._frame(4 * FRAME_IDS * LONG_FRAME)
        if len(self.held) >= 4 * FRAME_IDS:
            self._frame(len(self.held))

    def close(self) -> None:
        if self.held:
            self._frame(len(self.held))
        u4 = lambda x: int(x).to_bytes(4, "little")
        index = np.array(self.docs, _DOC).tobytes()
        self.stream.write(u4(SKIPPABLE_INDEX) + u4(len(index)) + index)
        table = np.array(self.frames, _ENTRY).tobytes() + u4(len(self.frames)) + bytes([CHECKSUM_FLAG]) + u4(SEEKABLE_MAGIC)
        self.stream.write(u4(SKIPPABLE_TABLE) + u4(len(table)) + table)
        self.stream.close()


class Reader:
    """Reads one file. ``documents()`` gives (position, doc_id, ids) of all or
    of the wanted documents; frames without any of these stay unread."""

    def __init__(self, source):
        import zstandard
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flag, magic = np.frombuffer(self._at(size - 9, 9), np.dtype([("n", "<u4"), ("flag", "u1"), ("magic", "<u4")]))[0]
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a token file")
        self.frames = np.frombuffer(self._at(size - 9 - int(n) * _ENTRY.itemsize, int(n) * _ENTRY.itemsize), _ENTRY)
        self.packed_at = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        self.plain_at = np.concatenate([[0], np.cumsum(self.frames["plain"], dtype=np.int64)])
        head = int(self.packed_at[-1])
        length = int.from_bytes(self._at(head + 4, 4), "little")
        self.docs = np.frombuffer(self._at(head + 8, length), _DOC)
        self.starts = np.concatenate([[0], np.cumsum(self.docs["n_ids"])])
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash
        if self.last[0] != k:
            packed, plain, check = (int(x) for x in self.frames[k])
            data = self.zstd.decompress(self._at(int(self.packed_at[k]), packed), max_output_size=plain)
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"checksum of frame {k} differs")
            self.last = (k, data)
        return self.last[1]

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int | None, bytes]]:
        for d, (doc_id, null, _) in enumerate(self.docs):
            if wanted is not None and (null or int(doc_id) not in wanted):
                continue
            lo, hi = 4 * int(self.starts[d]), 4 * int(self.starts[d + 1])
            parts = []
            k = int(np.searchsorted(self.plain_at, lo, "right")) - 1
            while lo < hi:
                data, base = self.frame(k), int(self.plain_at[k])
                parts.append(data[lo - base:hi - base])
                lo, k = int(self.plain_at[k + 1]), k + 1
            yield d, None if null else int(doc_id), b"".join(parts)


def write_documents(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into ``folder`` and return the table of
    files: part (ascending with the ids), path, n_docs, n_ids."""
    bounded_batches(docs)
    end = end_id.to_bytes(4, "little")
    spark = docs.sparkSession
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pieces = encoder(tokenizer_path(tokenizer), spaced=False)
        store, top = filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"{top}/tokens-{part:06d}-{uuid.uuid4().hex}.zst"
        out, n_ids = None, 0
        for batch in it:
            for doc_id, got in zip(batch.column(0).to_pylist(), pieces.all(batch.column(1).to_pylist())):
                out = out or Writer(store.open_output_stream(name, compression=None))
                ids = b"".join(got) + end
                out.add(doc_id, ids)
                n_ids += len(ids) // 4
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name.rsplit("/", 1)[1], "n_docs": len(out.docs), "n_ids": n_ids}])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keys = ["doc_id", F.xxhash64("text")]
    files = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(write, "part long, file string, n_docs long, n_ids long")
    files.write.mode("overwrite").parquet(f"{folder}/files.parquet")
    return spark.read.parquet(f"{folder}/files.parquet")


def read_documents(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of all or
    of the ``wanted`` documents of a written folder."""
    files = spark.read.parquet(f"{folder}/files.parquet")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))  # one row a file
    want = None if wanted is None else set(wanted)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(folder)

        def rows() -> Iterator[tuple]:
            for batch in it:
                for x in batch.to_pylist():
                    with store.open_input_file(f"{top}/{x['file']}") as source:
                        reader = Reader(source)
                        for d, doc_id, ids in reader.documents(want):
                            yield doc_id, x["start"] + int(reader.starts[d]), len(ids) // 4, ids

        yield from batches({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}, rows(), 1024)

    spread = placed.repartition(max(1, placed.sparkSession.sparkContext.defaultParallelism, files.count()), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
