"""Hard-negative mining by threshold joins (operator 11).

Anchors are joined with all rows under a least score each, the way L2AP prunes: a row's dimensions are
indexed in a common order only until the norm of the rest can no longer reach the threshold, so that a
row is met through its leading dimensions or not at all; partial scores are accumulated dimension by
dimension, and a pair goes as soon as its score so far and the product of both remaining norms stay below
the anchor's threshold.  What survives is scored exactly, in integers.

An anchor asks for windows: the first k rows of its own label, then for each positive the first k rows of
other labels within a share of the positive's score.  Thresholds start where as many rows as a window
needs are expected, and fall for the anchors whose windows are not full, until the window's lower end.

Rows are dealt into blocks by a hash of their id, and the anchors, a stated share of the rows, visit the
blocks.  A task holds one block and a batch of anchors; it gives back k rows for each window at most, so
neither a frequent label nor thousands of equal vectors can fill a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermatch.llm.blocks import first_of_each, matrix, visit
from offermatch.llm.common import stored

BLOCK_ROWS = 16_384  # mean rows of a block
STRIPE = 128  # anchors that a task joins at a time
DIMENSIONS = 8  # accumulated at a time
SPARSE = 0.05  # share of pairs still alive below which they are followed one by one
ROUNDS = 4  # falls of a threshold; after them a window is searched down to its lower end
EXPECTED = 20  # rows of a label expected above the first threshold
FIRST, LAST = -(1 << 63), (1 << 63) - 1
WINDOW = "struct<no:int,low:long,high:long,least:double>"


class Plan(NamedTuple):
    """What tasks of a round need to know: the order of dimensions and the least threshold for norm 1."""

    order: np.ndarray
    floor: float
    same: bool
    k: int


def norms_after(matrix: np.ndarray) -> np.ndarray:
    """For each row and each multiple of DIMENSIONS, the norm of what follows; a little too large."""
    squares = np.cumsum((matrix * matrix)[:, ::-1], axis=1)[:, ::-1]
    closed = np.concatenate([squares, np.zeros((len(matrix), 1))], axis=1)
    steps = [*range(0, matrix.shape[1], DIMENSIONS), matrix.shape[1]]
    return np.sqrt(closed[:, steps]) * (1 + 1e-9)


class Index:
    """Rows of one block and label side, those with the most indexed dimensions first, as columns."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, plan: Plan):
        ordered = exact[:, plan.order].astype(np.float64)
        rest = norms_after(ordered)
        indexed = (rest >= plan.floor).sum(axis=1) if plan.floor > 0 else np.full(len(ids), rest.shape[1] - 1)
        indexed = np.minimum(indexed, rest.shape[1] - 1)  # steps of a row that have postings
        by = np.argsort(-indexed, kind="stable")
        self.ids, self.exact, self.rest, self.indexed = ids[by], exact[by], rest[by], indexed[by]
        self.columns = np.ascontiguousarray(ordered[by].T)
        self.postings = np.searchsorted(-self.indexed, -np.arange(rest.shape[1] - 1), side="left")

    def pairs(self, asked: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) pairs that may reach the anchor's threshold; none that does is missing."""
        rest = norms_after(asked)
        partial = np.zeros((len(asked), len(self.ids)))
        least = least - np.abs(least) * 1e-9 - 1e-6
        who = rows = None
        for step, count in enumerate(self.postings.tolist()):
            if not count:
                break
            part = slice(step * DIMENSIONS, (step + 1) * DIMENSIONS)
            if who is None:
                partial[:, :count] += asked[:, part] @ self.columns[part, :count]
                bound = partial + rest[:, step + 1, None] * self.rest[None, :, step + 1]
                bound[:, count:] = partial[:, count:] + self._ends(rest, count)
                alive = bound >= least[:, None]
                if alive.mean() < SPARSE:
                    who, rows = np.nonzero(alive)
                    scores = partial[who, rows]
            else:
                open_ = rows < count
                scores[open_] += np.einsum("ij,ji->i", asked[who[open_], part], self.columns[part, rows[open_]])
                after = np.minimum(step + 1, self.indexed[rows])
                alive = scores + rest[who, after] * self.rest[rows, after] >= least[who]
                who, rows, scores = who[alive], rows[alive], scores[alive]
        if who is None:
            bound = partial + self._ends(rest, 0)
            who, rows = np.nonzero(bound >= least[:, None])
        return who, rows

    def _ends(self, rest: np.ndarray, start: int) -> np.ndarray:
        """Products of the norms behind the indexed dimensions, rows from ``start`` on."""
        ends = self.indexed[start:]
        return rest[:, ends] * self.rest[np.arange(start, len(self.ids)), ends][None, :]


FOUND = "anchor long, no int, id long, score long"


def join(rows: DataFrame, anchors: DataFrame, plan: Plan, blocks: int) -> DataFrame:
    """anchor, no, id, score: in each block the first k rows of every window at or above its threshold.

    ``rows`` has id, label, v; ``anchors`` has those and ``windows``.  A row's own id is no partner.
    """
    import pyarrow as pa

    schema = pa.schema([("anchor", pa.int64()), ("no", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def probe(held: Callable[[int], Index | None], asked: pa.Table) -> Iterator[pa.RecordBatch]:
        labels = asked.column("label").to_numpy()
        exact = matrix(asked.column("v"))
        ids, windows = asked.column("id").to_numpy(), asked.column("windows").to_pylist()
        least = np.array([min(w["least"] for w in ws) for ws in windows])
        most = max(map(len, windows))
        for label in np.unique(labels).tolist():
            mine = np.flatnonzero(labels == label)
            index = held(label)
            if index is None:
                continue
            for at in range(0, len(mine), STRIPE):
                some = mine[at:at + STRIPE]
                who, found = index.pairs(exact[some][:, plan.order].astype(np.float64), least[some])
                who = some[who]
                other = ids[who] != index.ids[found]
                who, found = who[other], found[other]
                scores = np.einsum("ij,ij->i", exact[who], index.exact[found])
                for turn in range(most):
                    asked_here = [ws[turn] if turn < len(ws) else None for ws in windows]
                    low = np.array([max(w["low"], int(max(w["least"], -9e18))) if w else LAST for w in asked_here])
                    high = np.array([w["high"] if w else FIRST for w in asked_here])
                    inside = np.flatnonzero((scores >= low[who]) & (scores <= high[who]))
                    kept = inside[first_of_each(who[inside], index.ids[found[inside]], scores[inside], plan.k)]
                    if len(kept):
                        numbers = np.array([w["no"] if w else -1 for w in asked_here], np.int32)[who[kept]]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(ids[who[kept]]), pa.array(numbers), pa.array(index.ids[found[kept]]),
                            pa.array(scores[kept])], schema=schema)

    def hold(table: pa.Table) -> Callable[[int], Index | None]:
        labels, ids, exact = table.column("label").to_numpy(), table.column("id").to_numpy(), matrix(table.column("v"))
        made: dict[int, Index | None] = {}

        def index(label: int) -> Index | None:
            if label not in made:
                made.clear()
                side = np.flatnonzero((labels == label) == plan.same)
                made[label] = Index(ids[side], exact[side], plan) if len(side) else None
            return made[label]

        return index

    return visit(rows.select("id", "label", "v"), anchors.select("id", "label", "v", "windows"), blocks, hold, probe, FOUND)


def fill(rows: DataFrame, anchors: DataFrame, order: np.ndarray, same: bool, k: int, blocks: int) -> DataFrame:
    """anchor, no, id, score, rank of every window's first ``k`` rows.

    ``anchors`` has id, label, v, norm, fall (what a threshold falls by) and windows.  Windows that are not
    full, and whose lower end is not reached, are searched again with a lower threshold.
    """
    first = Window.partitionBy("anchor", "no").orderBy(F.desc("score"), "id")
    results, number = [], 0
    while True:
        anchors = stored(anchors, "mining-anchors")
        floor = anchors.select(F.min(F.array_min(F.transform("windows", lambda w: w["least"])) / F.col("norm"))).first()[0]
        if floor is None:
            break
        plan = Plan(order, float(floor), same, k)
        found = stored(join(rows, anchors, plan, blocks).withColumn("rank", F.row_number().over(first)).where(
            F.col("rank") <= k), "mining-found")
        full = found.groupBy("anchor", "no").agg(F.count("*").alias("n"))
        open_ = anchors.select("*", F.explode("windows").alias("w")).join(
            full, (F.col("id") == F.col("anchor")) & (F.col("w.no") == F.col("no")), "left").withColumn(
            "closed", (F.coalesce("n", F.lit(0)) >= k) | (F.col("w.least") <= F.col("w.low").cast("double")))
        closed = open_.where("closed").select(F.col("id").alias("asked"), F.col("w.no").alias("window"))
        results.append(found.join(closed, (F.col("anchor") == F.col("asked")) & (F.col("no") == F.col("window"))).select(
            "anchor", "no", "id", "score", "rank"))
        number += 1
        lower = F.lit(float("-inf")) if number >= ROUNDS else F.col("w.least") - F.col("fall")
        again = F.struct(F.col("w.no").alias("no"), F.col("w.low").alias("low"), F.col("w.high").alias("high"),
                         F.greatest(F.col("w.low").cast("double"), lower).alias("least"))
        anchors = open_.where("NOT closed").groupBy("id").agg(
            *[F.first(c).alias(c) for c in ("label", "v", "norm", "fall")], F.collect_list(again).alias("windows"))
    result = results[0]
    for part in results[1:]:
        result = result.unionByName(part)
    return result


def whole_components(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, x as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(factor))))


def hard_negatives(rows: DataFrame, every: int, positives: int = 5, negatives: int = 3, low: int = 50,
                   high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has id, label and v (components as whole doubles).  Anchors are the rows whose id ``every``
    divides; their positives are the first rows of their label, and for each positive come the first
    rows of other labels whose score lies from ``low`` to ``high`` hundredths of the positive's.  Scores are
    integer inner products, higher first, ties to the smaller id.

    Rows with a null id, label or vector, or whose number of components is not the most frequent one
    (ties: the smaller), take no part; neither do those whose own product exceeds 2^62, because no long
    holds their scores.  Rows that repeat an id count once: the one of the least label and vector.  An empty
    table, and one without anchors, gives no rows.
    """
    import pyarrow as pa

    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    known = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (squares <= float(1 << 62)))
    length = known.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if length is None or not length["size"]:
        return rows.sparkSession.createDataFrame([], result)
    once = known.where(F.size("v") == length["size"]).groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"))
    held = stored(once.select("id", F.col("row.label").cast("long").alias("label"),
                              F.col("row.v").cast("array<long>").alias("v")), "mining-rows")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, squared = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                part = matrix(pa.Table.from_batches([batch]).column("v")).astype(np.float64)
                count, total, squared = count + len(part), total + part.sum(axis=0), squared + (part * part).sum(axis=0)
        if count:
            size = length["size"]
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([count] * size, pa.int64()),
                                              pa.array(total), pa.array(squared)], names=["at", "n", "total", "squared"])

    sums = held.select("v").mapInArrow(moments, "at int, n long, total double, squared double").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squared").alias("squared")).orderBy("at").collect()
    n = sums[0]["n"]
    mean = np.array([s["total"] for s in sums]) / n
    spread = np.maximum(np.array([s["squared"] for s in sums]) / n - mean**2, 0)
    order = np.argsort(-(spread + mean**2), kind="stable")
    blocks = -(-n // BLOCK_ROWS)
    labels = held.select(F.approx_count_distinct("label")).first()[0]
    share = min(0.5, EXPECTED / max(1.0, n / max(1, labels)))
    high_z = NormalDist().inv_cdf(1 - share)

    def weighed(weights: np.ndarray, f) -> Column:
        products = F.zip_with("v", F.array(*map(F.lit, weights.tolist())), f)
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x))
    asked = held.where(F.pmod("id", F.lit(every)) == 0).select(
        "id", "label", "v", F.greatest(norm, F.lit(1.0)).alias("norm"),
        weighed(mean, lambda x, w: x * w).alias("middle"),
        F.greatest(F.sqrt(weighed(spread, lambda x, w: x.cast("double") * x * w)), F.lit(1.0)).alias("fall"))
    window = F.struct(F.lit(0).alias("no"), F.lit(FIRST).alias("low"), F.lit(LAST).alias("high"),
                      (F.col("middle") + F.col("fall") * high_z).alias("least"))
    anchors = asked.withColumn("windows", F.array(window))
    nearest = stored(fill(held, anchors, order, True, positives, blocks), "mining-positives") if asked.take(1) else None
    if nearest is None:
        return rows.sparkSession.createDataFrame([], result)
    # Whole numbers between low and high hundredths; decimals, so that no product overflows.
    score = F.col("score").cast("decimal(20,0)")
    ranges = nearest.where("score >= 0").select(
        F.col("anchor").alias("id"), F.col("rank").alias("no"), F.col("id").alias("positive_id"), "score",
        F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    least = F.greatest(F.col("low").cast("double"), F.col("high") - F.col("fall") / 2)
    windows = ranges.join(asked, "id").groupBy("id").agg(
        *[F.first(c).alias(c) for c in ("label", "v", "norm", "fall")],
        F.collect_list(F.struct("no", "low", "high", least.alias("least"))).alias("windows"))
    if not windows.take(1):
        return rows.sparkSession.createDataFrame([], result)
    mined = fill(held, windows, order, False, negatives, blocks)
    pairs = nearest.select(F.col("anchor").alias("anchor_id"), F.col("rank").alias("at"), F.col("id").alias("positive_id"),
                           F.col("score").alias("positive_score"))
    return mined.join(pairs, (F.col("anchor") == F.col("anchor_id")) & (F.col("no") == F.col("at"))).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
