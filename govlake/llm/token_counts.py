"""Token counts from a cache of digests.

A text is known by the digest of its normalised content, a tokenizer by the digest of its file.
Digests of all texts are joined to the counts stored for this version of the tokenizer; of the
texts that miss, one holder of each distinct digest is encoded, and its count is appended to the
cache. Then every document finds its digest there. With a full cache no text leaves the scan;
with an empty one each distinct text moves once.

Inside a task, texts are cut in front of white space that follows a letter or sign. No piece of
the tokenizer's expression crosses such a place, so the count of a text is the sum over its
units, and units that occur again and again are encoded once while a worker remembers them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govlake.llm.common import gathered, map_batches, own_columns, stored, utf8, worker_memory
from govlake.sources import files

# Tokens of a document beyond which it is over the limit.
LIMIT = 512
# Text worked on at once; memory for the units a worker remembers, and what one takes besides its bytes.
TEXT_BYTES = 4 << 20
KEPT_BYTES = 96 << 20
ENTRY_BYTES = 130
LONG_UNIT = 256

CACHE = "digest binary, n_tokens bigint, version string"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def version_of(path: str) -> str:
    """Digest of a tokenizer's file: another vocabulary, expression or special token is another version."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


class UnitCounter:
    """Tokens per text, as the tokenizer gives them without added special tokens."""

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept_bytes, self.size = kept_bytes, 0
        self.known: dict[bytes, int] = {}

    def look_up(self, units: list[bytes]) -> list[int]:
        if self.size > self.kept_bytes:
            self.known, self.size = {}, 0
        found = list(map(self.known.get, units))
        missed = [i for i, n in enumerate(found) if n is None]
        encodings = self.tokenizer.encode_batch_fast([units[i].decode(errors="replace") for i in missed], add_special_tokens=False)
        for i, encoding in zip(missed, encodings):
            found[i] = len(encoding)
            if len(units[i]) <= LONG_UNIT:
                self.known[units[i]] = found[i]
                self.size += len(units[i]) + ENTRY_BYTES
        return found

    def count(self, texts: list[bytes | None]) -> np.ndarray:
        plain = [text or b"" for text in texts]
        joined = b"".join(plain)
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        starts = np.cumsum(lengths) - lengths
        if not joined:
            return np.zeros(len(plain), np.int64)
        places = np.union1d(cuts(np.frombuffer(joined, np.uint8)), starts[lengths > 0])
        bounds = np.append(places, len(joined))
        units = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(bounds), pa.py_buffer(joined)])
        coded = units.dictionary_encode()
        counts = np.array(self.look_up(coded.dictionary.to_pylist()), np.int64)[coded.indices.to_numpy()]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return upto[np.searchsorted(places, starts + lengths)] - upto[np.searchsorted(places, starts)]


def cuts(data: np.ndarray) -> np.ndarray:
    """Where ASCII white space follows a printable ASCII character or a letter from À to ÿ."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    solid = (data > 32) & (data < 127)
    solid[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    return np.flatnonzero(space[1:] & solid[:-1]) + 1


# --- digests and the cache -----------------------------------------------------------------

def content(text: Column) -> Column:
    """Normalised content: a null text is an empty one. Nothing else leaves a byte-level count as it is."""
    return F.coalesce(text, F.lit(""))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(content(text), 256))


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) stored for a version, one row per digest whoever has appended it."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], CACHE).drop("version")
    rows = spark.read.schema(CACHE).parquet(path).where(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_memory(f"unit counter {path}", lambda: UnitCounter(path))
        for batch in gathered(batches, TEXT_BYTES):
            counts = counter.count(utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts)], names=["digest", "n_tokens"])

    return map_batches(texts.select("digest", "text"), run, "digest binary, n_tokens bigint")


def fill_cache(docs: DataFrame, keyed: DataFrame, cache: str, path: str, version: str) -> None:
    """Append the counts of the distinct contents that the cache lacks.

    The holder of a content with the least id is the one to be encoded. Rows that are equal in
    id and content hold it together; their count is still appended once.
    """
    known = read_cache(docs.sparkSession, cache, version)
    missed = keyed.groupBy("digest").agg(F.min("doc_id").alias("owner")).join(known, "digest", "left_anti")
    # Written first: few misses are broadcast to the scan, so that only their texts go on.
    missed = stored(missed, "missed").withColumnRenamed("digest", "wanted")
    texts = own_columns(docs, "doc_id", "text").withColumn("digest", digest(F.col("text")))
    held = (F.col("digest") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("owner"))
    counted = encode_misses(texts.join(missed, held, "left_semi"), path).dropDuplicates(["digest"])
    counted.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row, from the cache table at ``cache``.

    A null text is an empty one, with 0 bytes and tokens. Strings of special tokens inside a
    text count as the tokenizer's library takes them by default. Null ids are carried, repeated
    rows are rows of their own, other columns are neither read nor carried. An empty table
    has an empty result and adds nothing to the cache. ``path`` is the file of a byte-level
    tokenizer without a normaliser; the same file has to be on every executor.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path()
    version = version_of(path)
    rows = own_columns(docs, "doc_id", "text")
    keyed = stored(rows.select("doc_id", digest(F.col("text")).alias("digest"),
                               F.octet_length(content(F.col("text"))).cast("bigint").alias("n_bytes")), "digests")
    fill_cache(docs, keyed, cache, path, version)
    # Written first, so that the join may split a content that very many documents hold.
    counts = stored(read_cache(spark, cache, version), "counts")
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
