"""Best-fit packing of whole documents by bin completion (operator 13).

Sequences are filled one after another: the largest remaining piece opens one, and the search branches
over the undominated ways to complete it, those with least waste first.  A branch ends when the waste so
far exceeds what a packing with one sequence less than the best known one may waste.  Best-fit decreasing
gives the first incumbent, and new ones for what is left on the way down.

Pieces are dealt at random into groups that a task searches by itself.  The emptiest sequence of every
group is opened again and goes to the next round, whose groups are fewer, so that hardly any sequence
is part empty because of the grouping.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermatch.llm.common import per_process, stored
from offermatch.llm.token_ids import TokenEncoder

SEQUENCE = 2048
GROUP_PIECES = 4096  # mean number of pieces in a group
EFFORT = 40_000  # steps of a group's search; after them its best packing so far stands
WINDOW_STEPS = 300  # of a first look at the fillings of one sequence within a band of waste
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, unit long"


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sizes of each bin; every size, largest first, goes where it leaves least room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: there is a bin with r left
    for size in sorted(sizes, reverse=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(size)
        by_room.setdefault(room - size, []).append(at)
        rooms |= 1 << (room - size)
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """A lower bound: the sum, and for each threshold the large ones apart from what fits beside them."""
    ordered = np.sort(np.asarray(sizes, np.int64))
    if not len(ordered):
        return 0
    sums = np.concatenate([[0], np.cumsum(ordered)])
    best = -(-int(sums[-1]) // capacity)
    for small in [0, *np.unique(ordered[2 * ordered <= capacity]).tolist()]:
        big = int(np.searchsorted(ordered, capacity - small, side="right"))
        half = int(np.searchsorted(ordered, capacity // 2, side="right"))
        low = int(np.searchsorted(ordered, small))
        beside = (big - half) * capacity - int(sums[big] - sums[half])
        rest = int(sums[half] - sums[low]) - beside
        best = max(best, len(ordered) - half + max(0, -(-rest // capacity)))
    return best


def _reach(sizes: int, most: int) -> int:
    """Bit s: some set bit of ``sizes`` lies from s to s + ``most``."""
    done = 0
    while done < most:
        step = min(done + 1, most - done)
        sizes |= sizes >> step
        done += step
    return sizes


def dominated(filling: list[int], left: int, room: int) -> bool:
    """Some piece that is left over (bit sizes) can take the place of a part of ``filling``, which it covers
    and which does not cover it, or fits beside it."""
    singles, several = 1, 0
    for size in filling:
        several |= (several << size) | ((singles & ~1) << size)
        singles |= 1 << size
    above = _reach(left, room - 1) >> 1 if room else 0  # larger than what it replaces
    return bool(above & singles) or bool((left | above) & several)


class Frame:
    """One bin on the way down: its largest piece, the fillings still to be tried, the one being tried."""

    def __init__(self, largest: int, fillings: Iterator[list[int]]):
        self.largest, self.fillings = largest, fillings
        self.filling: list[int] = []
        self.waste = 0


class Search:
    """Bin completion over a multiset of sizes; ``bins`` is the best packing found, ``exact`` if proven best."""

    def __init__(self, sizes: list[int], capacity: int, effort: int = EFFORT):
        self.capacity, self.effort = capacity, effort
        self.bins = best_fit_decreasing(sizes, capacity)
        self.bound = least_bins(sizes, capacity)
        self.total = sum(sizes)
        self.counts = [0] * (capacity + 1)
        self.present = 0  # bit s: a piece of size s is left
        self._give(sizes)
        self.exact = len(self.bins) <= self.bound or self._descend()

    def _take(self, sizes: list[int]) -> None:
        for size in sizes:
            self.counts[size] -= 1
            if not self.counts[size]:
                self.present &= ~(1 << size)

    def _give(self, sizes: list[int]) -> None:
        for size in sizes:
            self.counts[size] += 1
            self.present |= 1 << size

    def _slack(self) -> int:
        """What a packing better than the best known one may waste."""
        return (len(self.bins) - 1) * self.capacity - self.total

    def _offer(self, bins: list[list[int]]) -> None:
        if len(bins) < len(self.bins):
            self.bins = bins

    def _sets(self, room: int, least: int, most: int, steps: int) -> Iterator[list[int]]:
        """Undominated sets of remaining sizes that leave ``least`` to ``most`` of the room, larger sizes first."""
        chosen: list[int] = []
        left = largest = room
        while steps > 0 and self.effort > 0:
            steps -= 1
            self.effort -= 1
            size = (self.present & ((1 << (min(left, largest) + 1)) - 1)).bit_length() - 1
            if size > 0:
                self._take([size])
                chosen.append(size)
                left, largest = left - size, size
                continue
            if least <= left <= most and not dominated(chosen, self.present, left):
                found = list(chosen)
                self._give(found)  # whoever takes the set sees the state before it
                yield found
                self._take(found)
            if not chosen:
                return
            largest = chosen.pop()
            self._give([largest])
            left, largest = left + largest, largest - 1
        self._give(chosen)

    def _fillings(self, room: int, slack: int) -> Iterator[list[int]]:
        """Completions of a bin with ``room``: a first look by bands of waste, then all that it missed."""
        seen = set()
        most = min(room, slack)
        bands = [((1 << b) - 1, min((2 << b) - 2, most), WINDOW_STEPS) for b in range(max(most + 1, 0).bit_length())]
        for low, high, steps in [*bands, (0, most, self.effort)]:
            for found in self._sets(room, low, high, steps):
                if tuple(found) not in seen:
                    seen.add(tuple(found))
                    yield found

    def _descend(self) -> bool:
        """Depth-first search over bins; whether it came to its end."""
        frames: list[Frame] = []
        wasted = 0
        while True:
            largest = self.present.bit_length() - 1
            self._take([largest])
            frames.append(Frame(largest, self._fillings(self.capacity - largest, self._slack() - wasted)))
            while frames:  # the deepest bin that can be filled in another way
                if self.effort <= 0 or len(self.bins) <= self.bound:
                    return len(self.bins) <= self.bound
                frame = frames[-1]
                self._give(frame.filling)
                wasted -= frame.waste
                frame.filling, frame.waste = [], 0
                found = next(frame.fillings, None)
                if found is None:
                    self._give([frame.largest])
                    frames.pop()
                    continue
                waste = self.capacity - frame.largest - sum(found)
                if wasted + waste > self._slack():
                    continue
                self._take(found)
                wasted += waste
                frame.filling, frame.waste = found, waste
                filled = [[f.largest, *f.filling] for f in frames] if not self.present or len(frames) % 32 == 0 else []
                if not self.present:
                    self._offer(filled)
                    continue
                if filled:
                    rest = [s for s, n in enumerate(self.counts) for _ in range(n)]
                    self.effort -= len(rest)
                    self._offer(filled + best_fit_decreasing(rest, self.capacity))
                break
            if not frames:
                return True


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = SEQUENCE, doc_id: str = "doc_id",
              text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every document's ids and ``end_id``, whole if they fit in ``length``, else cut so that all pieces but
    the first one are full.

    A null text counts as empty.  ``unit`` numbers the rows of ``docs``, so repeated and null ids stay
    apart.  ``keep_ids`` adds the ids (little-endian, unsigned 32 bits).
    """
    import pyarrow as pa

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64()), ("unit", pa.int64())] + [("ids", pa.binary())] * keep_ids
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("token encoder", tokenizer), lambda: TokenEncoder(tokenizer))
        end = encoder.pack([end_id])
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            keys, units = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for key, unit, part in zip(keys, units, encoder.encode(batch.column(1).to_pylist(), end)):
                ids = np.frombuffer(part, "<u2" if encoder.width == 2 else "<u4").astype("<u4")
                first = (len(ids) - 1) % length + 1
                edges = [0, *range(first, len(ids) + 1, length)]
                for number, (start, stop) in enumerate(zip(edges, edges[1:])):
                    piece = ids[start:stop]
                    row = (key, number, start, stop - start, zlib.crc32(piece), unit)
                    for column, value in zip(columns, row + ((piece.tobytes(),) if keep_ids else ())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"),
                       F.monotonically_increasing_id().alias("u"))
    return slim.mapInArrow(cut, PIECE_SCHEMA + (", ids binary" if keep_ids else ""))


def complete(pieces: DataFrame, length: int = SEQUENCE, effort: int = EFFORT) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``length``, as few sequences as the search finds.

    Full pieces are sequences by themselves (negative ids).  The others go to random groups; in later
    rounds the pieces of each group's emptiest sequence are packed again, until one group is left or
    groups would no longer become fewer.  No piece is dropped.  An empty table gives no rows.
    """
    import pyarrow as pa

    names = [f.name for f in pieces.schema if f.name != "unit"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    held = stored(pieces, "pieces")
    full = held.where(F.col("length") == length).select(
        *names, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = held.where(F.col("length") < length)
    done = [full]
    groups, number = -(-loose.count() // GROUP_PIECES), 0
    while groups:
        def fill(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by([("unit", "ascending"), ("start", "ascending")])
            sizes = table.column("length").to_pylist()
            by_size: dict[int, list[int]] = {}
            for at, size in enumerate(sizes):
                by_size.setdefault(size, []).append(at)
            bins = Search(sizes, length, effort).bins
            emptiest = min(range(len(bins)), key=lambda b: sum(bins[b]))
            sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            base = (number << 58) + (key[0].as_py() << 24)
            for b, filling in enumerate(bins):
                room = 0
                for size in filling:
                    at = by_size[size].pop()
                    sequence[at], offset[at] = base + b, room
                    room += size
            return table.drop_columns("group").append_column("sequence_id", pa.array(sequence)).append_column(
                "offset", pa.array(offset)).append_column("open", pa.array(sequence == base + emptiest))

        group = F.pmod(F.xxhash64("unit", F.lit(number)), F.lit(groups))
        packed = stored(loose.withColumn("group", group).groupBy("group").applyInArrow(
            fill, fields + ", sequence_id long, offset long, open boolean"), "packed")
        again = packed.where("open")
        fewer = -(-again.count() // GROUP_PIECES)
        if groups == 1 or fewer > groups // 2:
            done.append(packed.select(*names, "sequence_id", "offset"))
            break
        done.append(packed.where("NOT open").select(*names, "sequence_id", "offset"))
        loose, groups, number = again.drop("sequence_id", "offset", "open"), fewer, number + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def packed_whole(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = SEQUENCE, effort: int = EFFORT,
                 keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; see ``pieces_of`` and ``complete``."""
    return complete(pieces_of(docs, tokenizer, end_id, length, keep_ids=keep_ids), length, effort)
