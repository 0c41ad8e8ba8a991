"""SimHash near-duplicates by pigeonring filtering (operator 8).

A fingerprint's 64 bits form a ring of 16 segments of 4 bits.  If two fingerprints differ in at most 3
bits, then from some segment on, every chain of l consecutive segments differs in at most 3 * l / 16
bits (the pigeonring principle).  Down to whole bits: none in the first 5 segments, at most 1 in the
first 10, 2 in the first 15, 3 in all 16.  So 20 equal bits at one of 16 places are the key of the
candidate search, and the longer chains prune candidates before the full distance is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermatch.llm.common import KEY, one_row_each, row_key, stored

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 16
STEP = 64 // SEGMENTS
LINKS = 200_000  # links held by a task before they are reduced to spanning ones


def budget(segments: int) -> int:
    """Differing bits allowed in a chain of so many segments."""
    return DISTANCE * segments // SEGMENTS


def exact_segments() -> int:
    return max(n for n in range(1, SEGMENTS + 1) if budget(n) == 0)


def fingerprint(text: str) -> int:
    """Majority of the bits of all 3-word shingles' hashes; 0 without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six white spaces
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        after = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)).tolist()
        begins = [0, *after[:-SHINGLE]]
        hashes = [xxhash.xxh64_intdigest(line[a:b - 1], SEED) for a, b in zip(begins, after[SHINGLE - 1:])]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at:at + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed 64 bits) and the row key of every row; a null text has no words."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())],
                                             names=["doc_id", *KEY, "fp"])

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), *row_key(docs),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return slim.mapInArrow(work, f"doc_id long, {KEY[0]} long, {KEY[1]} long, fp long")


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes: each node but the least of its component, and that least one."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[:len(a)], places[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        then = label.copy()
        np.minimum.at(then, label[left], low)
        np.minimum.at(then, label[right], low)
        while not np.array_equal(then, then[then]):
            then = then[then]
        if np.array_equal(then, label):
            break
        label = then
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def close_pairs(keys: np.ndarray, rings: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of equal key within the distance; keys are sorted, rings turned to the key's segment."""
    masks = [(np.uint64((1 << (n * STEP)) - 1), budget(n)) for n in range(1, SEGMENTS)
             if budget(n + 1) > budget(n) > 0] + [(np.uint64(2**64 - 1), DISTANCE)]
    active = np.arange(len(keys))
    step = 1
    while len(active):
        active = active[active + step < len(keys)]
        active = active[keys[active] == keys[active + step]]
        differ = rings[active] ^ rings[active + step]
        found = active
        for mask, most in masks:  # shorter chains first
            fits = np.bitwise_count(differ & mask) <= most
            differ, found = differ[fits], found[fits]
        if len(found):
            yield found, found + step
        step += 1


def links(groups: DataFrame) -> DataFrame:
    """Spanning links (fp_a, fp_b) between the distinct fingerprints ``fp`` of ``groups``.

    Every fingerprint goes to 16 buckets.  A task holds one bucket at a time besides its batch, compares
    it in place and gives links that connect, never all pairs of a dense bucket.
    """
    import pyarrow as pa

    bits = exact_segments() * STEP

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_keys, kept_rings = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        room = 0

        def given() -> pa.RecordBatch:
            a, b = spanning(*(np.concatenate(side) for side in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["fp_a", "fp_b"])

        def turned_back(keys: np.ndarray, rings: np.ndarray) -> np.ndarray:
            turn = (keys >> bits).astype(np.uint64) * np.uint64(STEP)
            back = np.where(turn > 0, rings >> ((np.uint64(64) - turn) % np.uint64(64)), np.uint64(0))
            return ((rings << turn) | back).view(np.int64)

        def found(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal kept_keys, kept_rings, held, room
            end = len(kept_keys)
            if not last and end:
                end = int(np.searchsorted(kept_keys, kept_keys[-1]))  # the last bucket may go on
            keys, rings = kept_keys[:end], kept_rings[:end]
            kept_keys, kept_rings = kept_keys[end:], kept_rings[end:]
            if not len(keys):
                return
            prints = turned_back(keys, rings)
            for a, b in close_pairs(keys, rings):
                held.append((prints[a], prints[b]))
                room += len(a)
                if room > LINKS:
                    held = [spanning(*(np.concatenate(side) for side in zip(*held)))]
                    room = len(held[0][0])
                    if room > LINKS // 2:
                        yield given()
                        held, room = [], 0

        for batch in batches:
            kept_keys = np.concatenate([kept_keys, batch.column(0).to_numpy()])
            kept_rings = np.concatenate([kept_rings, batch.column(1).to_numpy().view(np.uint64)])
            yield from found(False)
        yield from found(True)
        if held:
            yield given()

    turns = [F.when(F.lit(i) == 0, F.col("fp")).otherwise(
        F.shiftrightunsigned("fp", i * STEP).bitwiseOR(F.shiftleft("fp", (64 - i * STEP) % 64)))
        for i in range(SEGMENTS)]
    rings = groups.select(F.posexplode(F.array(*turns)).alias("turn", "ring"))
    keyed = rings.select((F.shiftleft(F.col("turn").cast("long"), bits) + F.col("ring").bitwiseAND((1 << bits) - 1))
                         .alias("key"), "ring")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(work, "fp_a long, fp_b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) for every node of the links but the roots themselves.

    Alternating large-star and small-star steps; each round is two aggregations and joins on the links
    left, written to the shared folder.  Nothing but two figures comes to the driver.
    """
    a, b = edges.columns
    now = stored(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    figures = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(low.withColumnRenamed("m", "v").union(small).distinct(), "links")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == figures:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        figures = tuple(row)
    raise RuntimeError("components did not settle")


def _classes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows; and for each distinct one its component's root and least doc_id."""
    prints = stored(fingerprints(docs, doc_id, text), "fingerprints")
    groups = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "groups")
    stars = components(links(groups))
    rooted = groups.join(stars, groups.fp == stars.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints, stored(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable) of every row.

    Null texts and texts without words have fingerprint zero and link like any other.  Rows with a null
    doc_id are linked too; a component of such rows only has a null component_id.  Repeated rows stay
    repeated.  An empty table gives no rows; other columns are not looked at.
    """
    prints, classes = _classes(docs, doc_id, text)
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the least doc_id (null last), of equal rows one."""
    prints, classes = _classes(docs, doc_id, text)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *KEY)).alias("first")
    kept = prints.join(classes, "fp").groupBy("root").agg(first).select(*[f"first.{k}" for k in KEY]).distinct()
    return one_row_each(docs, stored(kept, "kept")).select("row.*")
