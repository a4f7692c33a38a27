"""A Merkle manifest of a table: every row is a leaf, every group of rows a tree, and one root binds all.

Leaves are put in order once and written as aligned subtrees: a row holds the ``SPAN`` leaves
below one node ``STRIDE`` levels up. Only these levels are persisted (leaves, and the nodes
every ``STRIDE`` levels above them), so a level and its parent never both exist in storage.
A task that reads an aligned subtree folds it to the node above it. Proof extraction goes the
other way: it meets each subtree with the path of its top node, regenerates the missing
interior nodes from the stored ones below, hands every node its siblings and drops them again.
Between two persisted levels there are ``SPAN`` times fewer rows, so all but the first pass
are small, and no task holds more than the subtrees it is looking at.

The subroots of the trees are the leaves of one more tree of the same kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlake.llm.common import gathered, map_batches, own_columns, stored

FAN_IN = 8
# Levels from one persisted level to the next, and the nodes of an aligned subtree.
STRIDE = 3
SPAN = FAN_IN ** STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Subtrees a task folds at once, as bytes of their rows.
BLOCK_BYTES = 4 << 20

Path = list[tuple[bytes, bytes]]  # siblings to the left and to the right, from the lowest level up


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value; integers are decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def tree_key(column: Column) -> Column:
    """A string that is never null and sorts like the column, nulls first."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


# --- one tree --------------------------------------------------------------------------

def levels_in_band(n: int) -> int:
    """Levels to fold inside a band, in a tree of ``n`` nodes at the band's lower level."""
    levels = 0
    while n > 1 and levels < STRIDE:
        n = -(-n // FAN_IN)
        levels += 1
    return levels


def interior(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of a subtree by level, its lowest level first."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(b"".join(below[i:i + FAN_IN])) for i in range(0, len(below), FAN_IN)])
    return out


def path_inside(levels: list[list[bytes]], at: int) -> Path:
    """Siblings of node ``at`` from the lowest level up to the top of the subtree."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % FAN_IN
        out.append((b"".join(nodes[first:at]), b"".join(nodes[at + 1:first + FAN_IN])))
        at //= FAN_IN
    return out


def fold(node: bytes, path: Path) -> bytes:
    """The root that a node and its siblings lead to."""
    for left, right in path:
        node = digest(left + node + right)
    return node


# --- order and persisted levels ----------------------------------------------------------

def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``idx``, gapless from 0 in each ``tree``, and ``n``, the nodes of the tree.

    Rows are dealt out by ranges of (tree, order), so a large tree is spread over many tasks;
    numbers follow from the place in a range and the counts of the ranges before, a row for
    each range and tree. Rows that tie in all of ``order`` are interchangeable; a number of
    their own lets a run of them be split.
    """
    tied = stored(nodes, "merkle-nodes").withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = stored(
        tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
        .withColumn("_range", F.spark_partition_id()).withColumn("_place", place), "merkle-ordered",
    )
    counts = ranges.groupBy("tree", "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    so_far = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select(
        "tree", "_range", (F.coalesce(F.sum("_rows").over(so_far), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy("tree")).alias("n"),
    ), "merkle-ranges")
    return ranges.join(counts, ["tree", "_range"]).select(
        *[F.col(f"`{c}`") for c in nodes.columns], (F.col("_place") + F.col("_shift")).alias("idx"), "n"
    )


def subtrees(nodes: DataFrame, label: str) -> DataFrame:
    """Written rows (tree, n, sub, nodes): the aligned subtrees above nodes (tree, idx, n, hash, ...)."""
    carried = [F.col(f"`{c}`") for c in nodes.columns if c not in ("tree", "n", "idx")]
    grouped = nodes.groupBy("tree", "n", F.expr(f"idx div {SPAN}").alias("sub")).agg(
        F.sort_array(F.collect_list(F.struct("idx", *carried))).alias("nodes")
    )
    return stored(grouped, label)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """(first element, end, nodes by level) of each subtree of a batch of ``subtrees`` rows."""
    lists = batch.column("nodes")
    hashes = [h.encode() for h in lists.flatten().field("hash").to_pylist()]
    ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
    for start, end, n in zip([0, *ends], ends, batch.column("n").to_pylist()):
        yield start, end, interior(hashes[start:end], levels_in_band(n))


def tops(bands: DataFrame) -> DataFrame:
    """The node above each stored subtree: (tree, n, idx, hash) of the next persisted level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BLOCK_BYTES):
            above = [-(-n // SPAN) for n in batch.column("n").to_pylist()]
            found = [levels[-1][0].decode() for _, _, levels in _rows(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), pa.array(above, pa.int64()), batch.column("sub"), pa.array(found, pa.string())],
                names=["tree", "n", "idx", "hash"],
            )

    return map_batches(bands, run, "tree string, n bigint, idx bigint, hash string")


@dataclass(frozen=True)
class Forest:
    """The persisted levels of the trees, lowest first, and (tree, hash) of their subroots."""

    bands: list[DataFrame]
    subroots: DataFrame


def plant(nodes: DataFrame, order: Sequence[str]) -> Forest:
    """Persist trees over nodes (tree, hash, ...), whose leaves ascend by ``order``."""
    bands = [subtrees(numbered(nodes, order), "merkle-band")]
    most = bands[0].agg(F.max("n")).first()[0] or 0
    while most > SPAN:
        bands.append(subtrees(tops(bands[-1]), "merkle-band"))
        most = -(-most // SPAN)
    return Forest(bands, stored(tops(bands[-1]).select("tree", "hash"), "merkle-subroots"))


# --- proofs --------------------------------------------------------------------------------

PATH = "array<struct<left:string,right:string>>"
SIDES = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _paths(batch: pa.RecordBatch) -> list[Path]:
    return [[(s["left"].encode(), s["right"].encode()) for s in path] for path in batch.column("path").to_pylist()]


def hand_down(band: DataFrame, above: DataFrame) -> DataFrame:
    """Paths (tree, idx, path, subroot, root) of the stored nodes of a band, from those of their top nodes."""
    met = band.join(above.withColumnRenamed("idx", "sub"), ["tree", "sub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BLOCK_BYTES // 8):
            rows, paths = [], []
            for i, ((start, end, levels), upper) in enumerate(zip(_rows(batch), _paths(batch))):
                rows += [i] * (end - start)
                paths += [
                    [{"left": a.decode(), "right": b.decode()} for a, b in path_inside(levels, at) + upper]
                    for at in range(end - start)
                ]
            whole = batch.select(["tree", "subroot", "root"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [whole.column("tree"), batch.column("nodes").flatten().field("idx"), pa.array(paths, SIDES),
                 whole.column("subroot"), whole.column("root")],
                names=["tree", "idx", "path", "subroot", "root"],
            )

    return map_batches(met.select("tree", "sub", "n", "nodes", "path", "subroot", "root"), run,
                       f"tree string, idx bigint, path {PATH}, subroot string, root string")


def top_paths(leaves: Forest, crown: Forest) -> DataFrame:
    """Path, subroot and root for the top node of every tree: its way through the tree of subroots."""
    # One row: the root of all, which is the only subroot of the crown.
    paths = crown.subroots.select("tree", F.lit(0).cast("bigint").alias("idx"), F.array().cast(PATH).alias("path"),
                                  F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    for band in reversed(crown.bands):
        paths = hand_down(band, paths)
    names = crown.bands[0].select(F.explode("nodes").alias("node")).select(
        "node.idx", F.col("node.member").alias("tree"), F.col("node.hash").alias("subroot"))
    found = paths.select("idx", "path", "root").join(names, "idx")
    return stored(found.select("tree", F.lit(0).cast("bigint").alias("idx"), "path", "subroot", "root"), "merkle-tops")


def leaf_proofs(band: DataFrame, above: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, digest of the proof, and the root that the claimed leaf folds to."""
    element = band.schema["nodes"].dataType.elementType
    id_type = element["doc_id"].dataType.simpleString()
    met = band.join(above.withColumnRenamed("idx", "sub"), ["tree", "sub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, BLOCK_BYTES):
            nodes = batch.column("nodes").flatten()
            claims = nodes.field("claimed").to_pylist()
            rows, proofs, folded = [], [], []
            for i, ((start, end, levels), upper) in enumerate(zip(_rows(batch), _paths(batch))):
                rows += [i] * (end - start)
                for at, claim in enumerate(claims[start:end]):
                    path = path_inside(levels, at) + upper
                    proofs.append(digest(b"".join([side for pair in path for side in pair])).decode())
                    folded.append(fold(claim.encode() if claim else levels[0][at], path).decode())
            whole = batch.select(["subroot", "root"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [nodes.field("doc_id"), nodes.field("hash"), whole.column("subroot"), whole.column("root"),
                 pa.array(proofs, pa.string()), pa.array(folded, pa.string())],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"],
            )

    return map_batches(
        met.select("tree", "sub", "n", "nodes", "path", "subroot", "root"), run,
        f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string",
    )


# --- the manifest of a table -----------------------------------------------------------------

@dataclass(frozen=True)
class Manifest:
    """Persisted levels of the trees of rows and of the tree of their subroots."""

    leaves: Forest
    crown: Forest

    def root(self) -> str | None:
        """The digest that stands for the whole table; None for an empty one."""
        row = self.crown.subroots.first()
        return row["hash"] if row else None


def build(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", claimed_text: Column | None = None) -> Manifest:
    """The manifest of a table with doc_id: one tree per value of ``group``, rows by doc_id.

    ``claimed_text`` is what somebody claims the text to be, null where nothing else is
    claimed; such rows carry the leaf of the claim, which ``proofs`` folds. Null fields have
    a mark of their own, so they differ from empty ones. Null ids come first, rows of one id
    follow by leaf, and repeated rows are leaves of their own. Columns other than ``fields``
    are not part of a leaf, whatever their names. An empty table has no trees and no root.
    """
    columns = [F.col(f"`{f}`") for f in fields]
    claimed = F.lit(None).cast("string")
    if claimed_text is not None:
        changed = [claimed_text if f == "text" else c for f, c in zip(fields, columns)]
        claimed = F.when(claimed_text.isNotNull(), leaf(changed))
    rows = own_columns(docs, *dict.fromkeys(["doc_id", group, *fields]))
    leaves = rows.select(
        tree_key(F.col(f"`{group}`")).alias("tree"), "doc_id", leaf(columns).alias("hash"), claimed.alias("claimed")
    )
    trees = plant(leaves, ["doc_id", "hash"])
    crown = trees.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "hash")
    return Manifest(trees, plant(crown, ["member"]))


def proofs(manifest: Manifest) -> DataFrame:
    """Every row's leaf, subroot, root, the digest of its proof, the root its claim (or else its
    leaf) folds to with the original siblings, and whether that is the root."""
    paths = top_paths(manifest.leaves, manifest.crown)
    bands = manifest.leaves.bands
    for band in reversed(bands[1:]):
        paths = stored(hand_down(band, paths), "merkle-paths")
    found = leaf_proofs(bands[0], paths)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
