"""Nearest neighbours by multi-index hashing of learned rotated binary codes (operator 2).

Vectors are rotated by matrices learned on a sample (iterative quantisation) and reduced to signs.  Codes
split into substrings, each with its own index of buckets.  If two codes differ in at most r bits, r = a s + b
over s substrings, then one of the first b + 1 differs in at most a bits or one of the others in at most a - 1:
probing those buckets of every index retrieves each code within the radius.  Codes inside it are ranked by the
inner product of the original vectors in double precision.

A query's radius grows.  A radius belongs to a least score: the sample tells how many bits codes differ by at
an angle, so that hardly a row with that score lies outside.  Queries start with a small radius and a high
score; those that found k rows at or above it are done, the others look again with a wider radius, at last at
all rows.  The work of a round follows its radii, and only rows at or above the score leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermatch.llm.blocks import finite, first_of_each, matrix, visit
from offermatch.llm.common import stored

BITS = 256
SUBSTRING = 64  # bits of a substring
SAMPLE_ROWS = 8_000  # vectors that rotations and radii are learned from, in expectation; all, if fewer
SAMPLE_QUERIES = 300  # of the sample's different vectors, at random
SURE = 0.97  # of the rows with a score lie within its radius
BLOCK_ROWS = 16_384
STRIPE = 128  # queries that a task compares at a time
LONG = 0.995  # rows longer than this quantile of the lengths are compared with every query
CLOSE = (0.95, 0.8)  # cosines of the first rounds
WIDER = (1.0, 0.8, 0.5)  # of the expected distance of the k-th row from the mean, in later rounds


class Codes(NamedTuple):
    rotations: np.ndarray  # dimensions + 1 by bits
    norm: float  # of the longest rows that are coded
    bits_at: tuple[float, float]  # differing bits at an angle: constant and slope
    spread: float  # their standard deviation

    def of(self, vectors: np.ndarray, norms: np.ndarray, query: bool) -> np.ndarray:
        """Codes as 64-bit words.  Rows get one more dimension that makes their norms equal, so that the angle
        between a query and a row falls as their inner product rises."""
        if query:
            scaled, more = vectors / norms[:, None], np.zeros(len(vectors))
        else:
            scale = np.maximum(norms, self.norm)[:, None]
            scaled = vectors / scale
            more = np.sqrt(np.maximum(1 - (norms / scale[:, 0])**2, 0))
        return np.packbits(np.column_stack([scaled, more]) @ self.rotations > 0, axis=1).view(np.uint64)

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        """Bits that nearly all codes of rows at or above the cosine differ by at most."""
        bits = self.rotations.shape[1]
        angle = np.arccos(np.clip(cosine, -1, 1))
        wide = np.ceil(self.bits_at[0] + self.bits_at[1] * angle + NormalDist().inv_cdf(SURE) * self.spread)
        return np.where(np.isneginf(cosine), bits, np.clip(wide, 0, bits)).astype(np.int64)


def norms_of(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norms; no square overflows or vanishes.  The largest double stands for what exceeds it."""
    most = np.abs(vectors).max(axis=1)
    safe = np.where(most > 0, most, 1)
    with np.errstate(over="ignore"):
        return np.minimum(safe * np.sqrt(((vectors / safe[:, None])**2).sum(axis=1)), np.finfo(float).max)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row; one that overflows is infinite, one that is no number the least."""
    with np.errstate(over="ignore", invalid="ignore"):
        found = np.einsum("ij,ij->i", a, b)
    return np.where(np.isnan(found), -np.inf, found)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of codes, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def rotation(vectors: np.ndarray, bits: int, random: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Principal axes turned so that signs lose least (iterative quantisation)."""
    _, axes = np.linalg.eigh(vectors.T @ vectors)
    axes = axes[:, ::-1][:, :bits]
    flat = vectors @ axes
    turn, _ = np.linalg.qr(random.standard_normal((flat.shape[1], flat.shape[1])))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (left @ right).T
    return axes @ turn


def learn(sample: np.ndarray, norm: float, k: int, bits: int = BITS, seed: int = 7) -> Codes:
    """Rotations, and how differing bits follow the angle, from a sample of vectors no longer than ``norm``."""
    random = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    norms = norms_of(sample)
    scaled = sample / norm
    widened = np.column_stack([scaled, np.sqrt(np.maximum(1 - (norms / norm)**2, 0))])
    parts: list[np.ndarray] = []
    while sum(p.shape[1] for p in parts) < bits:
        parts.append(rotation(widened, min(SUBSTRING, bits), random))
    codes = Codes(np.column_stack(parts)[:, :bits], norm, (0.0, 0.0), 0.0)
    chosen = random.permutation(len(sample))[:SAMPLE_QUERIES]
    cosines = (scaled[chosen] / np.maximum(norms[chosen] / norm, 1e-300)[:, None]) @ scaled.T
    near = np.argsort(-cosines, axis=1)[:, :2 * k]
    far = random.integers(0, len(sample), near.shape)
    both = np.column_stack([near, far])
    apart = distances(codes.of(sample[chosen], norms[chosen], True)[:, None, :], codes.of(sample, norms, False)[both])
    angle = np.arccos(np.clip(np.take_along_axis(cosines, both, axis=1), -1, 1))
    slope, base = np.polyfit(angle.ravel(), apart.ravel(), 1) if np.ptp(angle) > 1e-6 else (bits / np.pi, 0.0)
    rest = apart - base - slope * angle
    return codes._replace(bits_at=(float(base), float(slope)), spread=float(max(rest[:, :near.shape[1]].std(), rest.std(), 1.0)))


class MultiIndex:
    """One block of rows: for each substring of the codes, buckets of rows with one value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.probed = 0  # (query, row) pairs retrieved by some bucket
        self.tables = []
        for part in codes.T:
            values, bucket = np.unique(part, return_inverse=True)
            self.tables.append((values, bucket))

    def within(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs that differ in at most the query's radius."""
        share, extra = np.divmod(radius, len(self.tables))
        seen = np.zeros((len(queries), len(self.codes)), bool)
        for at, ((values, bucket), asked) in enumerate(zip(self.tables, queries.T)):
            spare = share - (at > extra)
            hit = np.bitwise_count(asked[:, None] ^ values) <= spare[:, None]
            seen |= hit[:, bucket]
        who, rows = np.nonzero(seen)
        self.probed += len(who)
        close = distances(queries[who], self.codes[rows]) <= radius[who]
        return who[close], rows[close]


FOUND = "query_id long, vec_id long, score double"


def search(rows: DataFrame, queries: DataFrame, codes: Codes, k: int, blocks: int) -> DataFrame:
    """query_id, vec_id, score of each block's first k rows at or above the query's ``least`` score.

    ``rows`` has id, v, code and long; ``queries`` has those and cosine and least.
    """
    import pyarrow as pa

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def words(column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)

    def hold(table: pa.Table) -> tuple:
        long = np.flatnonzero(table.column("long").to_numpy(zero_copy_only=False))
        return (table.column("id").to_numpy(), matrix(table.column("v")), long, MultiIndex(words(table.column("code"))))

    def probe(held: tuple, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, vectors, long, index = held
        query_ids, wanted = asked.column("id").to_numpy(), matrix(asked.column("v"))
        signs, least = words(asked.column("code")), asked.column("least").to_numpy()
        radius = codes.radius(asked.column("cosine").to_numpy())
        for at in range(0, len(asked), STRIPE):
            end = min(at + STRIPE, len(asked))
            who, found = index.within(signs[at:end], radius[at:end])
            if len(long):
                short = ~np.isin(found, long)
                who = np.concatenate([who[short], np.repeat(np.arange(end - at), len(long))])
                found = np.concatenate([found[short], np.tile(long, end - at)])
            who = who + at
            other = query_ids[who] != ids[found]
            who, found = who[other], found[other]
            scores = products(wanted[who], vectors[found])
            kept = np.flatnonzero(scores >= least[who])
            top = kept[first_of_each(who[kept], ids[found[kept]], scores[kept], k)]
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[who[top]]), pa.array(ids[found[top]]), pa.array(scores[top])],
                                             schema=schema)

    return visit(rows, queries, blocks, hold, probe, FOUND)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    return finite(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def norm(vector: Column) -> Column:
    """Euclidean norm without overflow, the largest double at most."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    parts = F.aggregate(vector, F.lit(0.0), lambda total, x: total + (x / most) * (x / most))
    return F.least(most * F.sqrt(parts), F.lit(float(np.finfo(float).max)))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row whose id ``every`` divides.

    Largest inner product first, ties to the smaller id; a query's own id is no candidate.  Rows without
    id, with a vector that is null, zero, or holds null or non-finite components, or whose length is not
    the most frequent one, take no part.  Rows repeated with the same id and vector count once; an id with
    several vectors asks with each of them and is found by any, its best score counting.  Products beyond a double
    are infinite.  An empty table gives no rows.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"),
                          F.col(f"`{vector}`").cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & usable(F.col("v")))
    asks = F.pmod("id", F.lit(every)) == 0
    shape = rows.groupBy(F.size("v").alias("size")).agg(
        F.count("*").alias("n"), F.percentile_approx(norm(F.col("v")), LONG, 10_000).alias("norm"),
        F.count_if(asks).alias("asked")).orderBy(F.desc("n"), "size").first()
    if shape is None or not shape["asked"]:
        return nothing
    cut = min(shape["norm"] * (1 + 1e-6), float(np.finfo(float).max))
    rows = rows.where(F.size("v") == shape["size"])
    coded = norm(F.col("v")) <= cut
    sampled = rows.where(coded & (F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(shape["n"])) < SAMPLE_ROWS))
    sample = matrix(sampled.orderBy("id").select("v").toArrow().column("v"))
    if not len(sample):
        sample = matrix(rows.where(coded).limit(1).select("v").toArrow().column("v"))
    codes = learn(sample, cut, k)
    random = sample[np.random.default_rng(1).permutation(len(sample))[:SAMPLE_QUERIES * 4]] / cut
    mean, covariance = random.mean(axis=0), np.cov(random.T).reshape(random.shape[1], -1) if len(random) > 1 else 0.0

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            whole = matrix(table.column("v"))
            lengths = norms_of(whole)
            asking = table.column("asks").to_numpy(zero_copy_only=False)
            row_codes, query_codes = codes.of(whole, lengths, False), codes.of(whole, lengths, True)
            unit = whole / lengths[:, None]
            # Where the k-th best of all rows is expected, as a cosine to rows of full length.
            middle = unit @ mean
            wide = np.sqrt(np.maximum(((unit @ covariance) * unit).sum(axis=1), 0)) if len(random) > 1 else middle * 0
            yield pa.RecordBatch.from_arrays([
                table.column("id").combine_chunks(), table.column("v").combine_chunks(), pa.array([c.tobytes() for c in row_codes], pa.binary()),
                pa.array(lengths > cut), pa.array([c.tobytes() if a else None for c, a in zip(query_codes, asking)], pa.binary()),
                pa.array(lengths), pa.array(middle), pa.array(wide)],
                names=["id", "v", "code", "long", "asking", "length", "middle", "wide"])

    table = stored(rows.distinct().withColumn("asks", asks).mapInArrow(
        encode, "id long, v array<double>, code binary, long boolean, asking binary, length double, middle double, wide double"),
        "codes")
    held = table.select("id", "v", "code", "long")
    blocks = -(-shape["n"] // BLOCK_ROWS)
    far = NormalDist().inv_cdf(max(0.5, 1 - 1.2 * k / shape["n"]))
    levels = [F.lit(c) for c in CLOSE] + [F.col("middle") + F.col("wide") * far * w for w in WIDER] + [F.lit(float("-inf"))]
    asked = table.where("asking IS NOT NULL").drop("code").withColumnRenamed("asking", "code")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    results = []
    for number, cosine in enumerate(levels):
        last = number == len(levels) - 1
        round_ = asked.withColumn("cosine", cosine).withColumn(
            "least", F.lit(float("-inf")) if last else F.col("cosine") * F.col("length") * cut)
        found = search(held, round_.select("id", "v", "code", "long", "cosine", "least"), codes, k, blocks)
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = stored(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
        if last:
            results.append(ranked)
            break
        full = ranked.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
        results.append(ranked.join(full, "query_id", "left_semi"))
        asked = stored(asked.join(full, asked["id"] == full["query_id"], "left_anti"), "asked")
        if not asked.take(1):
            break
    whole = results[0]
    for part in results[1:]:
        whole = whole.unionByName(part)
    return whole.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
