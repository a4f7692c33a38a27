"""Line deduplication by pairwise alignment.

Lines are hashed once, and so are the windows of a document: the least runs of lines that hold
enough words, from each line on and up to each line. Whatever block of enough words a document
shares with an earlier one, each of its lines lies in a window inside the block, so it is
enough to meet the earliest holder of every window. Windows that few documents hold propose the
first pairs: each later holder and the earliest one. Windows that many hold propose the pair
of a document and their first holder where the first alignments have not covered them. Each
pair's line sequences are aligned by patience diff, and the common blocks of enough words, no
other lines, are deleted from the later document. So the number of alignments grows with the
lines, never with the square of a group, and no line is left out. Documents are ordered by id
(a null id comes first), then by a hash of the text.

Lines are compared by 64-bit hashes of their content without surrounding white space.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.llm.common import BATCH_ROWS, map_batches, own_columns, stored, utf8

# Times a window may occur to propose the first pairs, and words a deleted block has at least.
RARE = 8
MIN_BLOCK_WORDS = 5


def line_hashes(text: bytes | None) -> tuple[list[int], list[int], list[int]]:
    """Per line: hash of its content (0 if blank), its words, and an id of its own.

    The id is the hash for the first of equal lines and differs for each further one.
    """
    hashes, words, ids = [], [], []
    seen: dict[int, int] = {}
    for line in (text or b"").split(b"\n"):
        content = line.strip()
        n = len(content.split())
        h = _signed(xxhash.xxh64_intdigest(content)) if n else 0
        again = seen.get(h, 0) if n else 0
        seen[h] = again + 1
        hashes.append(h)
        words.append(n)
        ids.append(_signed(xxhash.xxh64_intdigest(content, again)) if again else h)
    return hashes, words, ids


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def windows(lines: Sequence[int], words: Sequence[int], min_words: int) -> list[tuple[int, int, int]]:
    """(id, first place, last place) of the least runs of ``min_words`` words that begin or end at each line.

    Equal ids mean equal lines, blank ones included. A line of a block that has enough words
    up to that line lies in the run that ends there, any other line of the block in the run
    that begins with the block; both are inside the block. At most two windows for each line.
    """
    full = [place for place, n in enumerate(words) if n]
    begins: set[tuple[int, int]] = set()
    ends: set[tuple[int, int]] = set()
    i = total = 0
    for j, place in enumerate(full):
        total += words[place]
        while total >= max(min_words, 1):  # from the i-th line on, the j-th is the first to make it enough
            begins.add((i, j))
            total -= words[full[i]]
            i += 1
        if i:
            ends.add((i - 1, j))
    out = []
    for i, j in begins | ends:
        a, b = full[i], full[j]
        id_ = lines[a]
        for before, place in zip(full[i:j], full[i + 1:j + 1]):
            id_ = _chained(id_, place - before, lines[place])
        out.append((id_, a, b))
        if (i, j) in begins:
            out += [(_chained(id_, -1, a - p), p, b) for p in range(full[i - 1] + 1 if i else 0, a)]
        if (i, j) in ends:
            out += [(_chained(id_, -2, p - b), a, p) for p in range(b + 1, full[j + 1] if j + 1 < len(full) else len(lines))]
    return out


def _chained(*values: int) -> int:
    return _signed(xxhash.xxh64_intdigest(struct.pack("<3q", *values)))


def _increasing(places: Sequence[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    heads: list[int] = []
    before: list[int] = []
    for i, place in enumerate(places):
        pile = bisect.bisect_left(tops, place)
        before.append(heads[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(place)
            heads.append(i)
        else:
            tops[pile], heads[pile] = place, i
    chain = []
    at = heads[-1] if heads else -1
    while at >= 0:
        chain.append(at)
        at = before[at]
    return chain[::-1]


def align(later: Sequence[int], earlier: Sequence[int], anchors: Sequence[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Common blocks (start in later, start in earlier, lines) of a patience diff.

    Anchors are places of equal lines, at most one for a place in ``later``, in its order; if
    none are given, the lines that occur once on both sides. Their longest increasing chain is
    kept, and every anchor grows over equal neighbours as long as the order is kept. Blank
    lines (hash 0) are no anchors but may lie inside a block.
    """
    def unique(lines: Sequence[int]) -> dict[int, int]:
        places: dict[int, int] = {}
        for place, line in enumerate(lines):
            places[line] = -1 if line in places else place
        return {line: place for line, place in places.items() if place >= 0 and line}

    if anchors is None:
        there = unique(earlier)
        anchors = sorted((place, there[line]) for line, place in unique(later).items() if line in there)
    anchors = [anchors[i] for i in _increasing([b for _, b in anchors])]
    blocks: list[tuple[int, int, int]] = []
    free_a = free_b = 0
    for a, b in anchors:
        if a < free_a or b < free_b:
            continue
        start_a, start_b = a, b
        while start_a > free_a and start_b > free_b and later[start_a - 1] == earlier[start_b - 1]:
            start_a, start_b = start_a - 1, start_b - 1
        free_a, free_b = a + 1, b + 1
        while free_a < len(later) and free_b < len(earlier) and later[free_a] == earlier[free_b]:
            free_a, free_b = free_a + 1, free_b + 1
        blocks.append((start_a, start_b, free_a - start_a))
    return blocks


def deleted_lines(later: Sequence[int], words: Sequence[int], ids: Sequence[int], earlier: Sequence[int],
                  earlier_ids: Sequence[int], min_words: int) -> list[int]:
    """Positions in the later document that aligned blocks of at least ``min_words`` words cover.

    The first alignment is anchored on lines that occur once on both sides. Common windows that
    it has not covered are the anchors of further ones: the n-th of equal windows meets the
    n-th, or else the last; anchors in another order, as those of moved passages, fall into
    several increasing chains, and each chain is aligned. Windows that blocks cover in part
    are anchors again, until no common window is left.
    """
    covered = bytearray(len(later))

    def take(blocks: Sequence[tuple[int, int, int]]) -> None:
        for start, _, n in blocks:
            if sum(words[start:start + n]) >= min_words:
                covered[start:start + n] = b"\x01" * n

    take(align(later, earlier))
    known = dict(zip(later, words))  # a line the later document lacks ends any window
    there: dict[int, list[int]] = {}
    for id_, first, _ in sorted(windows(earlier, [known.get(line, min_words) if line else 0 for line in earlier], min_words), key=lambda w: w[1]):
        there.setdefault(id_, []).append(first)
    seen: dict[int, int] = {}
    left = []
    for first, last, id_ in sorted((first, last, id_) for id_, first, last in windows(later, words, min_words) if id_ in there):
        places, n = there[id_], seen.get(id_, 0)
        seen[id_] = n + 1
        left.append((first, last, places[min(n, len(places) - 1)]))
    before = -1
    while before != sum(covered):
        before = sum(covered)
        left = [window for window in left if 0 in covered[window[0]:window[1] + 1]]
        anchors: dict[int, int] = {}
        for first, _, partner in left:
            anchors.setdefault(first, partner)
        for chain in increasing_chains(list(anchors.items())):
            take(align(later, earlier, chain))
    return [place for place, gone in enumerate(covered) if gone]


def increasing_chains(anchors: Sequence[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The fewest chains of increasing second places that hold all anchors, by patience sorting."""
    tails: list[int] = []  # ascending, the last place of the chain at the same position
    chains: list[list[tuple[int, int]]] = []
    for a, b in anchors:
        at = bisect.bisect_left(tails, b) - 1
        if at < 0:
            tails.insert(0, b)
            chains.insert(0, [(a, b)])
        else:
            tails[at] = b
            chains[at].append((a, b))
    return chains


def document_lines(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(doc_id, key, hashes, words, ids, windows, first, last) per distinct document; ``key`` is a hash of id and text."""
    rows = own_columns(docs, "doc_id", "text").select("doc_id", "text", row_key().alias("key"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    kinds = {"hashes": pa.int64(), "words": pa.int32(), "ids": pa.int64(), "windows": pa.int64(), "first": pa.int32(), "last": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in utf8(batch.column("text")):
                hashes, words, ids = line_hashes(text)
                runs = windows(hashes, words, min_words)
                found.append((hashes, words, ids, *([run[i] for run in runs] for i in range(3))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"),
                 *[pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate(kinds.values())]],
                names=["doc_id", "key", *kinds],
            )

    return map_batches(
        rows, run, f"doc_id {id_type}, key bigint, hashes array<bigint>, words array<int>, ids array<bigint>, "
        "windows array<bigint>, first array<int>, last array<int>",
    )


def row_key():
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))


def _aligned(pairs: DataFrame, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(name).to_pylist() for name in ("hashes", "words", "ids", "earlier", "earlier_ids")]
            found = [deleted_lines(*side, min_words) for side in zip(*sides)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.int32()))], names=["key", "deleted"])

    return map_batches(pairs, run, "key bigint, deleted array<int>")


def _uncovered(held: DataFrame) -> DataFrame:
    """(key, owner) of rows whose spans the deleted lines do not cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for spans, deleted in zip(batch.column("spans").to_pylist(), batch.column("deleted").to_pylist()):
                covered = bytearray(max(s["last"] for s in spans) + 1)
                for place in deleted or ():
                    if place < len(covered):
                        covered[place] = 1
                keep.append(any(0 in covered[s["first"]:s["last"] + 1] for s in spans))
            yield batch.select(["key", "owner"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(held.select("key", "owner", "spans", "deleted"), run, "key bigint, owner bigint")


def lines_to_delete(docs: DataFrame, rare: int = RARE, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(key, deleted): sorted positions of the lines to delete, for documents that have any."""
    stored_lines = stored(document_lines(docs, min_words), "lines")
    # Written too, so that the joins with lines may split an owner or a document of very many pairs.
    lines = stored(stored_lines.select("key", "hashes", "words", "ids").dropDuplicates(["key"]), "distinct-lines")
    places = stored_lines.select("doc_id", "key", F.explode(F.arrays_zip(F.col("windows").alias("id"), "first", "last")).alias("at"))
    places = places.select("doc_id", "key", "at.*")
    # Repeated rows of a document are one holder: their windows are equal.
    holder = F.struct("doc_id", "key")
    holders = places.groupBy("id").agg(F.min(holder).alias("least"), F.max(holder).alias("most"), F.count(F.lit(1)).alias("n"))
    holders = holders.where("least.key != most.key").select("id", F.col("least.key").alias("owner"), "n")
    # Written first, so that the join may split a window that very many documents hold.
    holders = stored(holders, "holders")
    held = places.select("key", "id", "first", "last").join(holders, "id").where("key != owner")

    def aligned(pairs: DataFrame) -> DataFrame:
        met = pairs.join(lines.select("key", "hashes", "words", "ids"), "key").join(
            lines.select(F.col("key").alias("owner"), F.col("hashes").alias("earlier"), F.col("ids").alias("earlier_ids")), "owner"
        ).select("key", "hashes", "words", "ids", "earlier", "earlier_ids")
        found = _aligned(met, min_words).where(F.size("deleted") > 0)
        return found.groupBy("key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("deleted")))).alias("deleted"))

    first = stored(aligned(held.where(F.col("n") <= rare).select("key", "owner").distinct()), "aligned")
    common = held.where(F.col("n") > rare).groupBy("key", "owner").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    # Written first, so that the join may split the documents that meet one owner.
    left = stored(_uncovered(common.join(first, "key", "left")), "uncovered")
    both = first.unionByName(aligned(left))
    return both.groupBy("key").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("deleted")))).alias("deleted"))


def _without(texts: pd.Series, deleted: pd.Series) -> pd.Series:
    out = []
    for text, places in zip(texts, deleted):
        gone = set() if places is None else set(np.asarray(places).tolist())
        out.append(None if text is None else "\n".join(l for i, l in enumerate(text.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def dedup_lines(docs: DataFrame, rare: int = RARE, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """All columns of the documents with deleted blocks taken out of ``text``, then n_lines and
    n_deleted (which replace columns of those names).

    Null and empty texts stay as they are (a null text has one blank line). A later copy of a
    whole document loses all its lines and stays as an empty text. Repeated rows are one
    document and have the same result. An empty table stays empty.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    found = lines_to_delete(docs, rare, min_words).withColumnRenamed("key", "_key")
    # Marked so that a filter on the new text isn't moved below it, which would run it twice.
    without = F.pandas_udf(_without, "string").asNondeterministic()
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), row_key().alias("_key")
    ).join(found, "_key", "left")
    changed = F.col("deleted").isNotNull()
    # Only texts that change go to Python.
    cleaned = F.when(changed, without(F.when(changed, F.col("_doc.text")), F.col("deleted"))).otherwise(F.col("_doc.text"))
    carried = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return whole.select(
        *[(cleaned if c == "text" else F.col(f"_doc.`{c}`")).alias(c) for c in carried],
        F.size(F.split(F.coalesce(F.col("_doc.text"), F.lit("")), "\n")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("deleted"), F.lit(0)).cast("bigint").alias("n_deleted"),
    )
