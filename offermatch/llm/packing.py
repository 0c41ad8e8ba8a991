"""Packing token pieces into fixed-length sequences (operator 4).

Documents are cut into pieces of at most one sequence; full pieces are sequences by themselves.  The
rest is packed by first-fit decreasing, independently in randomised groups of documents: a tournament
tree over the bins' free room finds the first bin that fits in logarithmic time.  Groups are small
enough for one task and large enough that little is padded, at any number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermatch.llm.common import per_process
from offermatch.llm.token_ids import TokenEncoder

SEQUENCE = 1024
GROUP_DOCS = 2048  # mean number of documents in a group
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, unit long"


class Bins:
    """Bins in order of opening; a tournament tree holds the most free room below each node."""

    def __init__(self, capacity: int, most: int):
        self.capacity = capacity
        self.leaves = 1
        while self.leaves < max(most, 1):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and the offset in it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        offset = self.capacity - room[node]
        room[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return found, offset


def first_fit_decreasing(sizes: list[int], capacity: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, largest items placed first, ties in the given order."""
    bins = Bins(capacity, len(sizes))
    found, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found[i], offsets[i] = bins.place(sizes[i])
    return found, offsets


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = SEQUENCE,
                 doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids of every document, its ids followed by ``end_id``.

    A null text counts as empty (one piece, the end id alone).  ``unit`` numbers the rows of ``docs``,
    so repeated and null ids stay apart.  ``keep_ids`` adds the ids (little-endian, unsigned 32 bits).
    """
    import pyarrow as pa

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("unit", pa.int64())] + [("ids", pa.binary())] * keep_ids
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("token encoder", tokenizer), lambda: TokenEncoder(tokenizer))
        end = encoder.pack([end_id])
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            keys, units = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for key, unit, part in zip(keys, units, encoder.encode(batch.column(1).to_pylist(), end)):
                ids = np.frombuffer(part, "<u2" if encoder.width == 2 else "<u4").astype("<u4")
                for start in range(0, len(ids), length):
                    piece = ids[start:start + length]
                    row = (key, start, len(piece), zlib.crc32(piece), len(ids), unit)
                    for column, value in zip(columns, row + ((piece.tobytes(),) if keep_ids else ())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("k"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"),
                       F.monotonically_increasing_id().alias("u"))
    return slim.mapInArrow(cut, PIECE_SCHEMA + (", ids binary" if keep_ids else ""))


def pack(pieces: DataFrame, groups: int, length: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    Every piece of a document goes to the document's group, but full pieces, which need no partner, are
    dealt out one by one, so a very long document fills no group.  Sequence ids are unique over all
    groups.  An empty table gives no rows.
    """
    import pyarrow as pa

    fields = [f for f in pieces.schema if f.name != "unit"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("unit", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), length)
        base = key[0].as_py() << 32
        kept = table.select([f.name for f in fields])
        kept = kept.append_column("sequence_id", pa.array(np.asarray(bins, np.int64) + base))
        return kept.append_column("offset", pa.array(offsets, pa.int64()))

    full = F.when(F.col("length") == length, F.col("start"))
    group = F.pmod(F.xxhash64("unit", full), F.lit(groups))
    return pieces.withColumn("group", group).groupBy("group").applyInArrow(fill, schema)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = SEQUENCE,
                     keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; see ``token_pieces`` and ``pack``.

    The number of groups follows the number of documents (a count of the input, no text is read).
    """
    groups = -(-docs.count() // GROUP_DOCS) or 1
    return pack(token_pieces(docs, tokenizer, end_id, length, keep_ids=keep_ids), groups, length)


def sequences(packed: DataFrame, length: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The padded sequences of pieces packed with ``keep_ids``: sequence_id, n_tokens, ids array.

    A sequence whose size is a power of two stays as it is, any other is padded to ``length``.
    """
    import pyarrow as pa

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<u4")
        size = len(ids)
        padded = ids if size & (size - 1) == 0 else np.concatenate([ids, np.full(length - size, pad_id, "<u4")])
        return pa.table({"sequence_id": table.column("sequence_id")[:1], "n_tokens": pa.array([size], pa.int64()),
                         "ids": pa.array([padded.tolist()], pa.list_(pa.int64()))})

    return packed.groupBy("sequence_id").applyInArrow(join, "sequence_id long, n_tokens long, ids array<long>")
