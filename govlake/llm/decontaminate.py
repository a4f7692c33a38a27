"""Benchmark decontamination with a Wu-Manber search over words.

The test strings are all windows of ten words of the benchmark items. For each window
length there is a shift table over blocks of three words: a block no window holds lets the
search jump ahead by almost a window, a block that ends a window selects the bucket of the
windows with that suffix, and a direct comparison with the document's words confirms.

Documents are read once and never shuffled. The tables are built on the driver from at
most ``words_per_pass`` words of the benchmark; a larger benchmark is cut into several such
parts, each searched in a pass of its own, and the results of a document are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.llm.common import map_batches, own_columns, utf8

WINDOW = 10
BLOCK = 3
WORDS_PER_PASS = 300_000

# Bytes of lower-cased UTF-8 that are no part of a word.
_APART = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TO_SPACES = bytes.maketrans(_APART, b" " * len(_APART))

HITS = "doc_id {id}, text_key bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; runs of ASCII letters, digits and non-ASCII characters. Null has none."""
    return text.lower().translate(_TO_SPACES).split() if text else []


class Matcher:
    """Shift and bucket tables for windows of one length."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(BLOCK, length)
        self.jump = length - self.block + 1
        self.shifts: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set[str]]] = {}

    def add(self, window: tuple, item: str | None) -> None:
        size, shifts = self.block, self.shifts
        for end in range(size, self.length + 1):
            block, left = window[end - size:end], self.length - end
            if shifts.get(block, self.jump) > left:
                shifts[block] = left
        bucket = self.buckets.setdefault(window[-size:], {})
        bucket.setdefault(window, set()).add(item)

    def find(self, words: Sequence[bytes]) -> Iterator[tuple[int, set[str]]]:
        """End position and items of every occurrence of a window."""
        size, jump, length = self.block, self.jump, self.length
        shifts, buckets = self.shifts, self.buckets
        end, last = length, len(words)
        while end <= last:
            block = tuple(words[end - size:end])
            shift = shifts.get(block, jump)
            if shift:
                end += shift
                continue
            items = buckets.get(block, {}).get(tuple(words[end - length:end]))
            if items is not None:
                yield end, items
            end += 1


def build(items: Iterable[tuple[str | None, bytes | None]], window: int = WINDOW) -> list[Matcher]:
    """One matcher per window length: ``window``, and shorter ones for items of fewer words."""
    matchers: dict[int, Matcher] = {}
    for item, text in items:
        words = tuple(words_of(text))
        length = min(window, len(words))
        if length:
            matcher = matchers.setdefault(length, Matcher(length))
            for start in range(len(words) - length + 1):
                matcher.add(words[start:start + length], item)
    return list(matchers.values())


def search(words: Sequence[bytes], matchers: Sequence[Matcher]) -> tuple[list[tuple[int, int]], list[str]]:
    """Disjoint word spans (end exclusive) hit by any window, and the sorted ids of the items."""
    found: list[tuple[int, int]] = []
    items: set[str] = set()
    for matcher in matchers:
        for end, ids in matcher.find(words):
            found.append((end - matcher.length, end))
            items |= ids
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged, sorted(i for i in items if i is not None)


def _parts(benchmark: DataFrame, words_per_pass: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The benchmark in parts of about ``words_per_pass`` words (an item is never cut)."""
    items = own_columns(benchmark, "item_id", "text").where("text is not null")
    # A word and its gap take two characters at least.
    weight = F.length("text") / 2 + 1
    total = items.agg(F.sum(weight).alias("words")).first()["words"] or 0
    n_parts = max(1, -(-int(total) // words_per_pass))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts))
    wanted = items.select(F.col("item_id").cast("string").alias("item_id"), F.encode("text", "UTF-8").alias("text"), part.alias("part"))
    for number in range(n_parts):
        yield [(r["item_id"], bytes(r["text"])) for r in wanted.where(F.col("part") == number).collect()]


def _searcher(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = tables.value
        for batch in batches:
            counts, spans, items = [], [], []
            for text in utf8(batch.column("text")):
                words = words_of(text)
                hit, ids = search(words, matchers)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in hit])
                items.append(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["doc_id", "text_key", "n_words", "spans", "items"],
            )

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, words_per_pass: int = WORDS_PER_PASS) -> DataFrame:
    """Per document: its words, the spans of words that benchmark windows hit, and the items.

    Null and empty texts have no words and are clean. Items without words match nothing; an
    item without an id marks words but is not listed. Repeated documents are searched each
    by itself. An empty benchmark leaves every document clean. Columns: doc_id, n_words,
    n_hit, spans (word positions, end exclusive), items (sorted), contaminated.
    """
    spark = docs.sparkSession
    rows = own_columns(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    schema = HITS.format(id=rows.schema["doc_id"].dataType.simpleString())
    passes = []
    for items in _parts(benchmark, words_per_pass):
        tables = spark.sparkContext.broadcast(build(items))
        passes.append(map_batches(rows, _searcher(tables), schema))
    hits = passes[0] if len(passes) == 1 else _merged(passes)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


def _merged(passes: list[DataFrame]) -> DataFrame:
    """One row per document from the rows of several passes."""
    rows = None
    for number, hits in enumerate(passes):
        hits = hits.withColumn("first_pass", F.lit(int(number == 0)))
        rows = hits if rows is None else rows.unionByName(hits)
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(-1).alias("end"))

    def add(done, span):
        joins = span["start"] <= done["end"]
        n = F.size(done["spans"])
        last = F.struct(done["spans"][n - 1]["start"].alias("start"), F.greatest(done["end"], span["end"]).alias("end"))
        grown = F.concat(F.slice(done["spans"], 1, F.greatest(n - 1, F.lit(0))), F.array(last))
        return F.struct(
            F.when(joins, grown).otherwise(F.concat(done["spans"], F.array(span))).alias("spans"),
            F.when(joins, last["end"]).otherwise(span["end"]).alias("end"),
        )

    return (
        rows.groupBy("doc_id", "text_key")
        .agg(
            F.first("n_words").alias("n_words"), F.sum("first_pass").cast("int").alias("copies"),
            F.sort_array(F.flatten(F.collect_list("spans"))).alias("all_spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .withColumn("spans", F.aggregate("all_spans", start, add)["spans"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .select("doc_id", "text_key", "n_words", "spans", "items")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, words_per_pass: int = WORDS_PER_PASS) -> DataFrame:
    """The documents without a benchmark window, with all their columns, in one pass per part.

    Null and empty texts hold no window and stay; repeated rows are judged alike; an empty table
    stays empty, and an empty benchmark drops nothing.
    """
    kept = docs
    for items in _parts(benchmark, words_per_pass):
        tables = docs.sparkSession.sparkContext.broadcast(build(items))

        def run(batches, tables=tables):
            for batch in batches:
                clean = [not search(words_of(text), tables.value)[0] for text in utf8(batch.column("text"))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = map_batches(kept, run, docs.schema)
    return kept
