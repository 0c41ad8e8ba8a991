"""Token-id files with Elias-Fano document boundaries (operator 3).

A file set is a Parquet table of blocks, so any store that Spark writes to can hold it.  A block is one
row: the concatenated ids of consecutive documents, and two Elias-Fano codes with select directories: the
documents' boundaries in that array, about 2 + log2(mean length) bits for each document in place of 64, and
their ascending doc_ids, counted from the block's first.  Blocks stand in document order: ``shard`` (a range of documents), then ``block`` in it.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offermatch.llm.common import per_process, shared_folder
from offermatch.llm.token_ids import TokenEncoder

BLOCK_IDS = 1_000_000  # ids after which a block is closed; a longer document makes a longer block
SAMPLE = 256  # set bits between entries of the select directory
BLOCK_SCHEMA = ("shard int, block int, shard_start long, n_docs int, n_ids long, width int, "
                "n_null int, first_id long, doc_ids binary, bounds binary, ids binary")


class EliasFano:
    """A sorted list of n numbers up to u in about n * (2 + log2(u / n)) bits."""

    def __init__(self, size: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.size, self.low_bits = size, low_bits
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u8")

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        numbers = np.asarray(numbers, np.uint64)
        size = len(numbers)
        top = int(numbers[-1]) if size else 0
        low_bits = max(0, (top // size).bit_length() - 1) if size else 0
        ones = (numbers >> np.uint64(low_bits)).astype(np.int64) + np.arange(size)
        bits = np.zeros(int(ones[-1]) + 1 if size else 0, np.uint8)
        bits[ones] = 1
        lows = (numbers[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return cls(size, low_bits, np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes(),
                   np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u8").tobytes())

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQ", self.size, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        size, low_bits, low, high = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        return cls(size, low_bits, data[at:at + low], data[at + low:at + low + high], data[at + low + high:])

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        part = self.low[first // 8:(first + self.low_bits + 7) // 8].tobytes()
        return (int.from_bytes(part, "little") >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number (from 0): a directory entry, then the bytes up to the i-th set bit."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # set bits after the sampled one
        byte = at // 8
        window = np.unpackbits(self.high[byte:byte + 64], bitorder="little")
        window[:at % 8 + 1] = 0
        while left:
            ones = np.flatnonzero(window)
            if len(ones) >= left:
                at = byte * 8 + int(ones[left - 1])
                break
            left -= len(ones)
            byte += 64
            window = np.unpackbits(self.high[byte:byte + 64], bitorder="little")
        return (at - i) << self.low_bits | self._low(i)

    def __iter__(self) -> Iterator[int]:
        return map(self.select, range(self.size))


def places(numbers: EliasFano, sought: list[int]) -> Iterator[int]:
    """Where the sought numbers stand, every place of a repeated one."""
    for value in sought:
        at = bisect.bisect_left(range(numbers.size), value, key=numbers.select)
        while at < numbers.size and numbers.select(at) == value:
            yield at
            at += 1


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id",
                      text: str = "text") -> None:
    """Encodes every text, appends ``end_id`` and writes blocks in ascending ``doc_id`` order.

    A null text counts as empty; null ids come first; rows of one id stand in the order of a hash of
    their texts, so a repeated or null id does not fill one range.  Other columns are not looked at, whatever
    their names.  An empty table writes an empty table.  Texts move once, to their range; ids are made after that, and a task holds one block.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    names = ["shard", "block", "shard_start", "n_docs", "n_ids", "width", "n_null", "first_id",
             "doc_ids", "bounds", "ids"]
    schema = pa.schema(list(zip(names, [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(),
                                        pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("token encoder", tokenizer), lambda: TokenEncoder(tokenizer))
        end = encoder.pack([end_id])
        shard = TaskContext.get().partitionId()
        block = start = room = 0
        keys: list[int | None] = []
        parts: list[bytes] = []

        def close() -> pa.RecordBatch:
            bounds = np.cumsum([0, *(len(p) // encoder.width for p in parts)])
            known = [key for key in keys if key is not None]  # nulls come first
            first = known[0] if known else 0
            apart = np.array([key - first for key in known], np.uint64)
            row = [shard, block, start, len(parts), int(bounds[-1]), encoder.width, len(keys) - len(known), first,
                   EliasFano.of(apart).to_bytes(), EliasFano.of(bounds).to_bytes(), b"".join(parts)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for key, part in zip(ids, encoder.encode(batch.column(1).to_pylist(), end)):
                keys.append(key)
                parts.append(part)
                room += len(part) // encoder.width
                if room >= BLOCK_IDS:
                    yield close()
                    block, start, room, keys, parts = block + 1, start + room, 0, [], []
        if parts:
            yield close()

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"),
                       F.xxhash64(F.col(f"`{text}`")).alias("h"))
    order = [F.col("k").asc_nulls_first(), F.col("h").asc()]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("k", "t")
    ranged.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """One row for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Places come from the select structures, document by document.  With ``wanted``, a list that the caller
    holds anyway, only those doc_ids are read: each is sought in its blocks by bisection over select.
    """
    import pyarrow as pa

    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    sought = None if wanted is None else sorted(set(wanted))

    def numbers(row: dict, doc_ids: EliasFano) -> Iterator[int]:
        if sought is None:
            return iter(range(row["n_docs"]))
        return (row["n_null"] + i for i in places(doc_ids, [key - row["first_id"] for key in sought]))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds, doc_ids = EliasFano.from_bytes(row["bounds"]), EliasFano.from_bytes(row["doc_ids"])
                ids = np.frombuffer(row["ids"], "<u2" if row["width"] == 2 else "<u4")
                found = []
                for i in numbers(row, doc_ids):
                    a, b = bounds.select(i), bounds.select(i + 1)
                    key = row["first_id"] + doc_ids.select(i - row["n_null"]) if i >= row["n_null"] else None
                    found.append((row["shard"], key, row["shard_start"] + a, b - a, zlib.crc32(ids[a:b].astype("<u4"))))
                columns = zip(*found) if found else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # One row for each shard, of which there are as many as write tasks.
    shards = blocks.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_ids")).alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    found = blocks.drop("block", "n_ids").mapInArrow(
        documents, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
