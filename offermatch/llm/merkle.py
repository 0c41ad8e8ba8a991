"""Merkle manifest of a table, its trees stored in van Emde Boas order (operator 12).

Every row is a leaf, leaves of one tree stand in order, and runs of eight nodes become one until a
single node is left.  The work is done in blocks: aligned subtrees of four levels above 8^4 nodes.  One
task builds one block, and the roots of a tree's blocks are the nodes of the next pass, so that a pass
is 4,096 times smaller than the one below it and no tree, however large, is held by one task.  Inside a
block a node's place follows from arithmetic alone: the subtree is split at half its height into a top and the
bottoms below it, each laid out the same way, and building and sibling retrieval go through these
addresses.

Proofs come down again: a block's root has its siblings in the block above, and what stands above a
block is worked out once for all leaves below it.
"""

from __future__ import annotations

import string
from binascii import hexlify
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offermatch.llm.common import per_process, stored

ARITY = 8
HEIGHT = 4  # levels of a block above its lowest
RUN = ARITY**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def size_of(levels: int) -> int:
    """Nodes of a complete tree with so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def addresses(levels: int) -> list[np.ndarray]:
    """For each depth from the root, the place of every node: the top half, then each bottom half."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    top, low = levels // 2, levels - levels // 2
    first = size_of(top) + size_of(low) * np.arange(ARITY**top, dtype=np.int64)
    return addresses(top) + [(first[:, None] + inside).ravel() for inside in addresses(low)]


class Block:
    """An aligned subtree, nodes in van Emde Boas order; places of nodes that do not exist stay empty."""

    def __init__(self, nodes: np.ndarray, height: int, leaves: int):
        self.nodes, self.height = nodes, height  # hexadecimal digests
        self.places = per_process(("van Emde Boas", height), lambda: addresses(height + 1))
        self.counts = [leaves]
        for _ in range(height):
            self.counts.insert(0, -(-self.counts[0] // ARITY))

    @classmethod
    def of(cls, digests: list[bytes], height: int) -> Block:
        block = cls(np.zeros(size_of(height + 1), "S64"), height, len(digests))
        block.nodes[block.places[height][:len(digests)]] = list(map(hexlify, digests))
        for depth in range(height - 1, -1, -1):
            block.nodes[block.places[depth][:block.counts[depth]]] = [
                sha256(block.run(depth + 1, i)).hexdigest().encode() for i in range(block.counts[depth])]
        return block

    @classmethod
    def from_bytes(cls, data: bytes, height: int, leaves: int) -> Block:
        return cls(np.frombuffer(hexlify(data), "S64"), height, leaves)

    def to_bytes(self) -> bytes:
        """32 bytes a node."""
        return bytes.fromhex(b"".join(x.ljust(64, b"0") for x in self.nodes.tolist()).decode())

    def run(self, depth: int, number: int) -> bytes:
        """The joined digests of a run of up to eight nodes."""
        at = self.places[depth][number * ARITY:min((number + 1) * ARITY, self.counts[depth])]
        return self.nodes[at].tobytes()

    @property
    def root(self) -> bytes:
        return bytes.fromhex(self.nodes[0].decode())

    def siblings(self, depth: int) -> list[tuple[str, str]]:
        """For each node of a depth, its run's digests before it and after it."""
        found = []
        for number in range(-(-self.counts[depth] // ARITY)):
            run = self.run(depth, number).decode()
            found += [(run[:at], run[at + 64:]) for at in range(0, len(run), 64)]
        return found

    def paths(self) -> list[list[tuple[str, str]]]:
        """For each lowest node, its siblings level by level up to the block's root."""
        below: list[list[tuple[str, str]]] = [[]]
        for depth in range(1, self.height + 1):
            beside = self.siblings(depth)
            below = [[pair, *below[i // ARITY]] for i, pair in enumerate(beside)]
        return below


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def height_of(nodes: int) -> int:
    """Levels of the next pass over a tree with so many nodes."""
    height = 0
    while height < HEIGHT and nodes > 1:
        nodes, height = -(-nodes // ARITY), height + 1
    return height


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``idx``, a row's number in its ``tree`` from 0, and ``n``, the tree's rows.

    Rows are dealt into ranges of (tree, order); a range's first number is the sum of the tree's counts
    in the ranges before it, so no tree is sorted by one task.
    """
    keys = ["tree", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(ranged.withColumn("place", F.monotonically_increasing_id()), "merkle-leaves").withColumn(
        "part", F.shiftright("place", 33))
    runs = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count("*").alias("here"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "part", "first", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"),
                       F.sum("here").over(tree).alias("n"))
    return placed.join(runs, ["tree", "part"]).withColumn(
        "idx", F.col("base") + F.col("place") - F.col("first")).drop("place", "part", "first", "base")


BLOCK_SCHEMA = "tree string, n long, block long, size long, nodes binary, digest binary"


def build(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """One pass: a row for each block of a tree's nodes, with ``carried`` columns as lists in node order."""
    import pyarrow as pa

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}

    def make(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree, n, number = (k.as_py() for k in key)
        block = Block.of(table.column("digest").to_pylist(), height_of(n))
        lists = {c: pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in carried}
        return pa.table({
            "tree": pa.array([tree], pa.string()), "n": pa.array([n], pa.int64()),
            "block": pa.array([number], pa.int64()), "size": pa.array([table.num_rows], pa.int64()),
            "nodes": pa.array([block.to_bytes()], pa.binary()), "digest": pa.array([block.root], pa.binary()), **lists})

    schema = BLOCK_SCHEMA + "".join(f", {c} array<{kinds[c]}>" for c in carried)
    slim = nodes.select("tree", "n", F.floor(F.col("idx") / RUN).alias("block"), "idx", "digest", *carried)
    return stored(slim.groupBy("tree", "n", "block").applyInArrow(make, schema), "merkle-blocks")


def passes(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Blocks of every pass, until each tree is one block.  ``nodes`` has tree, n, idx and digest."""
    made = [build(nodes, carried)]
    while made[-1].where("block > 0").take(1):
        step = F.least(F.lit(HEIGHT), F.ceil(F.log(F.col("n").cast("double")) / np.log(ARITY) - 1e-9))
        width = F.pow(F.lit(ARITY), step).cast("long")
        roots = made[-1].select("tree", F.ceil(F.col("n") / width).alias("n"), F.col("block").alias("idx"), "digest")
        made.append(build(roots, []))
    return made


def descend(made: list[DataFrame], above: DataFrame) -> DataFrame:
    """What stands above each block of the lowest pass.

    ``above`` has tree, subroot, root and ``path`` (siblings level by level) of each tree's root.
    """
    import pyarrow as pa

    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    known = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(made[1:]):
        def open_block(table: pa.Table) -> pa.Table:
            row = table.to_pylist()[0]
            block = Block.from_bytes(row["nodes"], height_of(row["n"]), row["size"])
            rest = [(p["left"], p["right"]) for p in row["path"]]
            paths = [path + rest for path in block.paths()]
            first = row["block"] * RUN
            return pa.table({
                "tree": pa.array([row["tree"]] * len(paths), pa.string()),
                "block": pa.array(range(first, first + len(paths)), pa.int64()),
                "subroot": pa.array([row["subroot"]] * len(paths), pa.string()),
                "root": pa.array([row["root"]] * len(paths), pa.string()),
                "path": pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], kind)})

        known = stored(blocks.join(known, ["tree", "block"]).groupBy("tree", "block").applyInArrow(
            open_block, f"tree string, block long, subroot string, root string, path {PATH}"), "merkle-paths")
    return known


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", doc_id: str = "doc_id",
             altered: tuple[Column, str] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    A leaf is the digest of ``fields``; trees are the values of ``tree`` (null first, then by UTF-8
    bytes), leaves ascend by ``doc_id`` (null first), rows of one id by their leaf; equal rows are leaves
    of their own.  ``altered``, a condition and a field, lower-cases A-Z of that field where it holds
    before the proof is checked.  Other columns are not looked at.  An empty table gives no rows.
    """
    import pyarrow as pa

    columns = [F.col(f"`{c}`") for c in fields]
    leaf = leaf_digest(columns)
    changed = F.lit(None).cast("binary")
    if altered:
        condition, name = altered
        lowered = [F.translate(c, string.ascii_uppercase, string.ascii_lowercase) if f == name else c
                   for c, f in zip(columns, fields)]
        changed = F.when(condition, leaf_digest(lowered))
    named = F.col(f"`{tree}`").cast("string")
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), named), F.lit("")).alias("tree"),
                         F.col(f"`{doc_id}`").cast("long").alias("doc_id"), leaf.alias("digest"), changed.alias("changed"))
    made = passes(numbered(leaves, ["doc_id", "digest"]), ["doc_id", "changed"])
    subroots = made[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    forest = passes(numbered(subroots, ["name"]), ["name"])
    top = forest[-1].select("tree", F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"),
                            F.expr(f"cast(array() as {PATH})").alias("path"))

    def name_paths(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        block = Block.from_bytes(row["nodes"], height_of(row["n"]), row["size"])
        rest = [(p["left"], p["right"]) for p in row["path"]]
        paths = [[{"left": a, "right": b} for a, b in path + rest] for path in block.paths()]
        own = block.nodes[block.places[block.height][:row["size"]]].tolist()
        return pa.table({"tree": pa.array(row["name"], pa.string()),
                         "subroot": pa.array([x.decode() for x in own], pa.string()),
                         "root": pa.array([row["root"]] * len(own), pa.string()),
                         "path": pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))})

    named_blocks = forest[0].join(descend(forest, top), ["tree", "block"])
    above = stored(named_blocks.groupBy("tree", "block").applyInArrow(
        name_paths, f"tree string, subroot string, root string, path {PATH}"), "merkle-paths")

    def prove(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        block = Block.from_bytes(row["nodes"], height_of(row["n"]), row["size"])
        rest = [(p["left"], p["right"]) for p in row["path"]]
        rest_text = "".join(a + b for a, b in rest)
        own = [x.decode() for x in block.nodes[block.places[block.height][:row["size"]]].tolist()]
        proofs, ends = [], []
        for leaf, changed, path in zip(own, row["changed"], block.paths()):
            proofs.append(sha256(("".join(a + b for a, b in path) + rest_text).encode()).hexdigest())
            ends.append(folded(leaf if changed is None else changed.hex(), path + rest))
        return pa.table({
            "doc_id": pa.array(row["doc_id"], pa.int64()), "leaf": pa.array(own, pa.string()),
            "subroot": pa.array([row["subroot"]] * len(own), pa.string()),
            "root": pa.array([row["root"]] * len(own), pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(ends, pa.string()), "verified": pa.array([e == row["root"] for e in ends], pa.bool_())})

    proved = made[0].join(descend(made, above), ["tree", "block"]).groupBy("tree", "block").applyInArrow(
        prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
               "verified boolean")
    return proved
