"""Merkle manifest of a table, kept as a persistent tree.

Each row is a leaf; the rows of one part (say a language) form a tree, the trees' roots form
the tree of the manifest. Leaves are ranked, dealt to aligned blocks of ``2 ** levels``, and a
block is one row of a written table; the blocks' roots are dealt to blocks again until one node a
tree is left. A changed leaf makes a version: it copies the leaf's ancestors and shares every
other node with the version before. Inside a block that is done on linked nodes; above it the
version goes on along the path of its block, which is joined from the upper tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logquarry.llm.common import Scratch

LEVELS = 7  # of an aligned block
_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def leaf_digest(fields: Sequence[str | Column]) -> Column:
    """SHA-256 (bytes) of a row: each field as ``-`` if null, else its UTF-8 length, a colon and its text."""
    cols = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    said = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cols]
    return F.unhex(F.sha2(F.concat(*said), 256))


class Node(NamedTuple):
    """A node of a block: hexadecimal digest and children; never changed once made."""

    digest: bytes
    left: Node | None = None
    right: Node | None = None


def _h(text: bytes) -> bytes:
    return sha256(text).hexdigest().encode()


def _parent(left: Node, right: Node | None = None) -> Node:
    return Node(_h(left.digest + right.digest if right else left.digest), left, right)


def grow(leaves: Sequence[bytes], levels: int) -> Node:
    """The root ``levels`` above hexadecimal ``leaves``; a last node alone in its run is hashed alone."""
    row = [Node(d) for d in leaves]
    for _ in range(levels):
        row = [_parent(*row[i : i + 2]) for i in range(0, len(row), 2)]
    return row[0]


def replace(root: Node, levels: int, pos: int, leaf: bytes) -> Node:
    """The version with another leaf: ancestors are copied, all other nodes are shared."""
    if levels == 0:
        return Node(leaf)
    if pos >> (levels - 1) & 1:
        return _parent(root.left, replace(root.right, levels - 1, pos, leaf))
    return _parent(replace(root.left, levels - 1, pos, leaf), root.right)


def siblings(root: Node, levels: int, pos: int) -> list[bytes]:
    """Steps from a leaf to the root: ``l`` or ``r`` with the sibling on that side, empty without one."""
    steps = []
    for k in reversed(range(levels)):
        if pos >> k & 1:
            steps.append(b"l" + root.left.digest)
            root = root.right
        else:
            steps.append(b"r" + root.right.digest if root.right else b"")
            root = root.left
    return steps[::-1]


def climb(digest: bytes, steps: Sequence[bytes]) -> list[bytes]:
    """Digests of the ancestors that a digest and the steps above it give."""
    out = []
    for s in steps:
        digest = _h(s[1:] + digest if s[:1] == b"l" else digest + s[1:])
        out.append(digest)
    return out


def _height(nodes: int, levels: int) -> int:
    """Levels of a block in a tree whose row here has so many nodes."""
    return min(levels, (nodes - 1).bit_length())


def _ranked(scratch: Scratch, nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``pos``, the rank in its tree from 0, and ``n``, the nodes of the tree.

    Rows are sorted over ranges, so a large tree lies in many tasks; what is gathered is one row
    for each range and tree in it.
    """
    placed = scratch.save(
        nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", _ROW_BITS).alias("part")
    runs = placed.groupBy("tree", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    tree = W.partitionBy("tree")
    runs = runs.select(
        "tree", "part", "first", (F.sum("c").over(tree.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(tree).alias("n")
    )
    return (
        placed.withColumn("part", part)
        .join(runs, ["tree", "part"])
        .withColumn("pos", F.col("before") + F.col("at") - F.col("first"))
        .drop("part", "first", "before", "at")
    )


def _pack(nodes: DataFrame, levels: int) -> DataFrame:
    """One row a block: tree, block, n, and its members (pos, digest, ...) in order."""
    rest = [c for c in nodes.columns if c not in ("tree", "n", "pos")]
    return (
        nodes.groupBy("tree", F.shiftright("pos", levels).alias("block"), "n")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("m"))
        .select("tree", "block", "n", *[F.col(f"m.{c}").alias(c) for c in rest])
    )


def _roots(blocks: DataFrame, levels: int) -> DataFrame:
    """The blocks' roots as the nodes of the row above."""
    schema = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("digest", pa.binary())])

    def run(batches):
        for b in batches:
            of = zip(b.column("n").to_pylist(), b.column("digest").to_pylist(), strict=True)
            roots = [bytes.fromhex(grow([d.hex().encode() for d in ds], _height(n, levels)).digest.decode()) for n, ds in of]
            above = [-(-n >> levels) for n in b.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("tree"), pa.array(above, pa.int64()), b.column("block"), pa.array(roots, pa.binary())], schema=schema)

    return blocks.select("tree", "block", "n", "digest").mapInArrow(run, "tree string, n long, pos long, digest binary")


def _build(scratch: Scratch, nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Block tables from the leaves up, and the trees' roots. One table for each ``levels`` levels."""
    tables, done = [], []
    while True:
        tables.append(scratch.save(_pack(nodes, levels)))
        above = scratch.save(_roots(tables[-1], levels))
        done.append(above.where("n = 1").select("tree", "digest"))
        nodes = above.where("n > 1")
        if nodes.isEmpty():
            break
    roots = done[0]
    for d in done[1:]:
        roots = roots.union(d)
    return tables, roots


_PATHS = "tree string, block long, steps array<binary>, subroot binary, root binary"


def _children(blocks: DataFrame, levels: int) -> DataFrame:
    """Paths of a block table's members from those of its blocks."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("steps", pa.list_(pa.binary())), ("subroot", pa.binary()), ("root", pa.binary())])

    def run(batches):
        for b in batches:
            out: dict = {f.name: [] for f in schema}
            for r in b.to_pylist():
                height = _height(r["n"], levels)
                top = grow([d.hex().encode() for d in r["digest"]], height)
                for i in range(len(r["digest"])):
                    out["tree"].append(r["tree"])
                    out["block"].append((r["block"] << levels) + i)
                    out["steps"].append(siblings(top, height, i) + r["steps"])
                    out["subroot"].append(r["subroot"])
                    out["root"].append(r["root"])
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return blocks.select("tree", "block", "n", "digest", "steps", "subroot", "root").mapInArrow(run, _PATHS)


def _descend(tables: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The lowest block table with the path of each block; ``tops`` has the paths of the trees' roots."""
    from_above = None
    for blocks in reversed(tables):
        paths = blocks.where(F.col("n") <= 1 << levels).select("tree", "block").join(tops, "tree").select("tree", "block", "steps", "subroot", "root")
        if from_above is not None:
            paths = paths.union(from_above)
        here = blocks.join(paths, ["tree", "block"])
        from_above = _children(here, levels)
    return here


@dataclass(frozen=True)
class Manifest:
    """``blocks``: a row for each aligned block of leaves, with its path to the root."""

    blocks: DataFrame
    id_type: str
    levels: int

    def proofs(self) -> DataFrame:
        """Per leaf: id, leaf, subroot, root, proof_sha256, folded_root (all hexadecimal), verified.

        ``proof_sha256`` is the digest of all siblings up to the root. ``folded_root`` comes from the
        leaf, or from the version that its change made. Rows with equal ids each have their proof.
        """
        most = self.levels
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

        def run(batches):
            for b in batches:
                ids, out = [], {c: [] for c in names}
                for block, base, levels in _grown(b, most):
                    ids.extend(block["id"])
                    root = block["root"].hex()
                    for i, (leaf, changed) in enumerate(zip(block["digest"], block["changed"], strict=True)):
                        inside = siblings(base, levels, i)
                        if changed is None:
                            top = climb(leaf.hex().encode(), inside)[-1] if levels else leaf.hex().encode()
                        else:
                            top = replace(base, levels, i, changed.hex().encode()).digest
                        steps = inside + block["steps"]
                        folded = climb(top, block["steps"])[-1] if block["steps"] else top
                        out["leaf"].append(leaf.hex())
                        out["subroot"].append(block["subroot"].hex())
                        out["root"].append(root)
                        out["proof_sha256"].append(sha256(b"".join(s[1:] for s in steps)).hexdigest())
                        out["folded_root"].append(folded.decode())
                columns = [pa.array(ids, b.column("id").type.value_type), *[pa.array(out[c], pa.string()) for c in names]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *names])

        found = self.blocks.mapInArrow(run, f"id {self.id_type}, " + ", ".join(f"{c} string" for c in names))
        return found.withColumn("verified", F.col("folded_root") == F.col("root"))

    def versions(self) -> DataFrame:
        """The nodes that each version copies: id of the changed leaf, level (0: the leaf), digest.

        All other nodes of a version are those of the base tree.
        """
        most = self.levels

        def run(batches):
            for b in batches:
                ids, level, digest = [], [], []
                for block, base, levels in _grown(b, most):
                    for i, (key, changed) in enumerate(zip(block["id"], block["changed"], strict=True)):
                        if changed is None:
                            continue
                        copied, node = [], replace(base, levels, i, changed.hex().encode())
                        for k in reversed(range(levels + 1)):
                            copied.append(node.digest)
                            if k:
                                node = node.right if i >> (k - 1) & 1 else node.left
                        copied = copied[::-1]
                        copied += climb(copied[-1], block["steps"])
                        ids += [key] * len(copied)
                        level += range(len(copied))
                        digest += [d.decode() for d in copied]
                columns = [pa.array(ids, b.column("id").type.value_type), pa.array(level, pa.int32()), pa.array(digest, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "level", "digest"])

        return self.blocks.mapInArrow(run, f"id {self.id_type}, level int, digest string")


def _grown(batch: pa.RecordBatch, most: int) -> Iterator[tuple[dict, Node, int]]:
    """Each block of a batch with the root over its leaves and its levels."""
    for block in batch.to_pylist():
        levels = _height(block["n"], most)
        yield block, grow([d.hex().encode() for d in block["digest"]], levels), levels


def build(
    table: DataFrame,
    fields: Sequence[str],
    part: str,
    order: str,
    changed: dict[str, Column] | None = None,
    where: Column | None = None,
    levels: int = LEVELS,
) -> Manifest:
    """Manifest of ``table``: leaves of ``fields``, a tree for each ``part`` in the order of ``order``.

    ``levels`` are those of a block; the digests do not depend on it.

    Rows for which ``where`` holds are changed leaves; ``changed`` gives their new fields. Nulls come
    first, in parts and in ``order``; rows with equal ``order`` follow their leaf digest, so the tree
    is the same however the table is dealt. An empty table gives no rows.
    """
    scratch = Scratch(table.sparkSession)
    leaf = leaf_digest(fields)
    new = leaf_digest([(changed or {}).get(f, F.col(f)) for f in fields])
    nothing = F.lit(None).cast("binary")
    # texts are read once; from here on a row is its digests
    leaves = scratch.save(
        table.select(
            F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit("")).alias("tree"),
            F.col(order).alias("id"),
            leaf.alias("digest"),
            (F.when(where, new) if where is not None else nothing).alias("changed"),
        )
    )
    tables, subroots = _build(scratch, _ranked(scratch, leaves, ["id", "digest"]), levels)
    parts = scratch.save(_ranked(scratch, subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]))
    uppers, root = _build(scratch, parts.drop("name"), levels)
    no_steps = F.array().cast("array<binary>")
    top = root.select("tree", no_steps.alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    # the members of the lowest table over the subroots are the trees
    over = _children(_descend(uppers, top, levels), levels).select(F.col("block").alias("pos"), "steps", "root")
    tops = parts.select("pos", F.col("name").alias("tree"), F.col("digest").alias("subroot")).join(over, "pos").drop("pos")
    tops = scratch.save(tops.select("tree", "steps", "subroot", "root"))
    return Manifest(_descend(tables, tops, levels), leaves.schema["id"].dataType.simpleString(), levels)
