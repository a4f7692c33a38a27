"""Quality classification by importance resampling.

Two bag models over hashed one- and two-word grams are counted in one pass: one of the raw
text (every document) and one of the target text (documents labelled good, from a bounded
sample of labels). A document's importance is the sum of the log ratios of its grams; its
key is that plus Gumbel noise drawn from a hash of the document, and the k largest keys are
a sample without replacement in proportion to importance.

The models are tables of ``buckets`` counts however large the corpus is; each task counts
its documents first and sends one table. The k-th key is found by counting keys in bins and
narrowing the bin that holds it, so no task sorts the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.llm.common import BLOCK_BYTES, map_batches, own_columns, utf8, worker_memory
from govlake.session import scratch_path

BUCKETS = 1 << 16
# Labelled good documents that make up the target model.
TARGET_ROWS = 20_000
# Added to every bucket, as a share of the mean count per bucket.
SMOOTHING = 0.1
BINS = 4096
# Keys of the last bin that may be sorted in one task.
SORTED_ROWS = 50_000

_BASE = 0x100000001B3


def _powers(n: int, base: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for a block, and which bytes are white space."""
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    return (*_power_pair(2 * BLOCK_BYTES), gap)


def _power_pair(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))


def grams(block: np.ndarray, starts: np.ndarray, carried: np.ndarray | None = None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the one- and two-word grams of texts joined in a block, and their text numbers.

    Texts begin at ``starts`` and are set apart by white space. The first word of a ``carried``
    text was counted with the piece before; it is there for the two-word gram alone. A word's
    hash is a polynomial in its bytes, taken from the difference of two running sums.
    """
    forward, backward, is_gap = worker_memory("gram tables", _tables)
    if len(block) > len(forward):  # a word longer than a block
        forward, backward = _power_pair(len(block))
    gap = is_gap[block]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum((block.astype(np.uint64) + np.uint64(1)) * forward[:len(block)], out=sums[1:])
    word = (sums[last] - sums[first]) * backward[first]
    owner = np.searchsorted(starts, first, side="right") - 1
    pair = word[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (word[1:] + np.uint64(0x7F4A7C15))
    same = owner[1:] == owner[:-1]
    own = np.ones(len(word), bool)
    if carried is not None:
        own = ~(np.concatenate([[True], ~same]) & carried[owner])
    hashed = np.concatenate([word[own], pair[same]]) * np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    return (hashed >> shift).astype(np.int64), np.concatenate([owner[own], owner[1:][same]])


_GAPS = b"\t\n\x0b\x0c\r "
_GAP = re.compile(rb"[\t-\r ]")


def pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text in pieces of about ``BLOCK_BYTES``, cut at white space; every piece but the first
    begins with the last word before it, which is marked."""
    start = end = 0
    while end < len(text):
        gap = _GAP.search(text, end + BLOCK_BYTES)
        cut = gap.start() if gap else len(text)
        yield text[start:cut], start < end
        words = text[start:cut].rstrip(_GAPS)
        # White space alone leaves no word to carry.
        start = start + 1 + max(words.rfind(bytes([c])) for c in _GAPS) if words else cut
        end = cut


def blocks(texts: Sequence[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to blocks of bounded size: bytes, starts, text numbers, whether the first word is carried.

    A text longer than a block comes in pieces that share a word, so grams are those of the
    whole text; only a word longer than a block makes a longer one.
    """
    held: list[bytes] = []
    numbers, carried, size = [], [], 0
    for number, text in enumerate(texts):
        for piece, again in pieces(text or b""):
            if held and size + len(piece) > BLOCK_BYTES:
                yield _joined(held, numbers, carried)
                held, numbers, carried, size = [], [], [], 0
            held.append(piece)
            numbers.append(number)
            carried.append(again)
            size += len(piece) + 1
    if held:
        yield _joined(held, numbers, carried)


def _joined(held: list[bytes], numbers: list[int], carried: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *[len(t) + 1 for t in held]])[:-1]
    return np.frombuffer(b" ".join(held), np.uint8), starts, np.array(numbers), np.array(carried, bool)


def model_counts(docs: DataFrame, target_ids: Sequence, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Gram counts of all documents and of the target documents, by bucket."""
    rows = own_columns(docs, "doc_id", "text")
    wanted = rows.sparkSession.sparkContext.broadcast(frozenset(target_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = np.array([i in wanted.value for i in batch.column("doc_id").to_pylist()], bool)
            for block, starts, numbers, carried in blocks(utf8(batch.column("text"))):
                found, owner = grams(block, starts, carried, buckets)
                raw += np.bincount(found, minlength=buckets)
                target += np.bincount(found[good[numbers[owner]]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"]
        )

    counted = map_batches(rows, run, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")
    )
    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for row in counted.collect():  # at most one row per bucket
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per bucket, both smoothed; zeros if either model is empty."""
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw))

    def logs(counts: np.ndarray) -> np.ndarray:
        smoothed = counts + SMOOTHING * counts.sum() / len(counts)
        return np.log(smoothed / smoothed.sum())

    return logs(target) - logs(raw)


def importance(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, text_key, n_grams and log_importance of every document."""
    rows = own_columns(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    shipped = rows.sparkSession.sparkContext.broadcast(ratios)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for batch in batches:
            counts, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for block, starts, numbers, carried in blocks(utf8(batch.column("text"))):
                found, owner = grams(block, starts, carried, len(table))
                text = numbers[owner]
                counts += np.bincount(text, minlength=batch.num_rows)
                sums += np.bincount(text, weights=table[found], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(counts), pa.array(sums)],
                names=["doc_id", "text_key", "n_grams", "log_importance"],
            )

    return map_batches(rows, run, f"doc_id {id_type}, text_key bigint, n_grams bigint, log_importance double")


def gumbel(seed: int):
    """Standard Gumbel noise as an expression, from a hash of the document and the seed."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.col("text_key"), F.lit(seed)), 12)
    uniform = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def threshold(keyed: DataFrame, k: int) -> float | None:
    """The k-th largest ``key`` of a stored table (null keys are none), by narrowing bins.

    Each round counts the rows of ``BINS`` bins between two keys; the bin that holds the k-th
    key is the next round's range, until few rows or a single key are left.
    """
    low, high = keyed.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return None
    above = 0
    while low < high:
        part = keyed.where((F.col("key") >= low) & (F.col("key") <= high))
        number = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit((high - low) / BINS)), F.lit(BINS - 1))
        bins = part.groupBy(number.cast("int").alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
        ).collect()
        for row in sorted(bins, key=lambda r: -r["bin"]):
            low, high = row["low"], row["high"]
            if above + row["n"] >= k:
                break
            above += row["n"]
        else:
            return low  # fewer than k rows
        if row["n"] <= SORTED_ROWS:
            rest = part.where((F.col("key") >= low) & (F.col("key") <= high)).select("key")
            return rest.orderBy(F.desc("key")).limit(k - above).agg(F.min("key")).first()[0]
    return low


def target_sample(labels: DataFrame, target_rows: int = TARGET_ROWS) -> tuple[list, float]:
    """Ids of about ``target_rows`` documents labelled good (quality 1, not toxic), chosen by a
    hash, and the share of good ones among all labelled documents."""
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    rows = own_columns(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality is not null")
    n, n_good, n_fine = rows.agg(
        F.count(F.lit(1)), F.count(F.when(good, 1)), F.count(F.when(F.col("quality") == 1, 1))
    ).first()
    if not n_good:
        return [], 1.0
    spread = 1 << 20
    upto = min(spread, int(spread * target_rows / n_good))
    chosen = rows.where(good & (F.pmod(F.xxhash64("doc_id", F.lit("target")), F.lit(spread)) < upto))
    return [r["doc_id"] for r in chosen.select("doc_id").collect()], n_fine / n


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, target_rows: int = TARGET_ROWS,
             seed: int = 1) -> DataFrame:
    """n_grams, log_importance, the noisy key and ``kept`` of every document.

    ``share`` of the rows (as labels of quality 1 are among all labels, unless given) are
    kept, those with the largest keys; rows that tie with the last one are kept too, which
    takes equal ids and texts. Null and empty texts have no grams and importance 0. Without
    labels all importances are 0 and the sample is uniform. Repeated rows have equal keys.
    An empty table gives an empty result. Columns other than doc_id and text are not carried.
    """
    spark = docs.sparkSession
    ids, labelled_share = target_sample(labels, target_rows)
    ratios = log_ratios(*model_counts(docs, ids))
    path = scratch_path(spark, "importance")
    importance(docs, ratios).withColumn("key", F.col("log_importance") + gumbel(seed)).write.parquet(path)
    keyed = spark.read.parquet(path)
    k = round(keyed.count() * (labelled_share if share is None else share))
    limit = threshold(keyed, k)
    kept = F.lit(False) if limit is None else F.col("key") >= F.lit(limit)
    return keyed.select("doc_id", "n_grams", "log_importance", "key", kept.alias("kept"))
