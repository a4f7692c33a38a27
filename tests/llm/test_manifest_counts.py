"""The Merkle manifest and the token counts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from govlake.llm import merkle, token_counts
from govlake.llm.queries import QUERIES
from govlake.session import scratch_path

from .conftest import AWKWARD, frame


# --- Merkle manifest ---------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Root of a list of nodes, and for each the sibling lists from the lowest level up."""
    paths, at, owners = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(at) > 1:
        above, held = [], []
        for i in range(0, len(at), 8):
            run = at[i:i + 8]
            for k in range(len(run)):
                for leaf in owners[i + k]:
                    paths[leaf].append((run[:k], run[k + 1:]))
            above.append(sha("".join(run)))
            held.append([leaf for own in owners[i:i + 8] for leaf in own])
        at, owners = above, held
    return at[0], paths


def plain_manifest(rows):
    """The contract read literally: (doc_id, leaf, subroot, root, proof, folded, verified), sorted."""
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append((row, plain_leaf(row, row["text"])))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    subroots, inner = [], {}
    for lang in order:
        trees[lang].sort(key=lambda p: (p[0]["doc_id"] is not None, p[0]["doc_id"] or 0, p[1]))
        top, paths = plain_tree([leaf for _, leaf in trees[lang]])
        subroots.append(top)
        inner[lang] = paths
    root, upper = plain_tree(subroots)
    out = []
    for number, lang in enumerate(order):
        for (row, leaf), path in zip(trees[lang], inner[lang]):
            path = path + upper[number]
            proof = sha("".join(h for left, right in path for h in left + right))
            node = leaf
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None:
                node = plain_leaf(row, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row["text"]))
            for left, right in path:
                node = sha("".join(left) + node + "".join(right))
            out.append((row["doc_id"], leaf, subroots[number], root, proof, node, node == root))
    return sorted(out, key=repr)


def manifest_of(spark, docs, tmp_path):
    docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op11_merkle_manifest"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in found.collect()], key=repr)


def test_manifest_equals_the_definition(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["Plain Text", "plain", "ÄÖ Ü", ""]) + str(i % 7), "en", "s", i) for i in range(1300)]
    rows += [(2000 + i, f"Text {i}", f"l{i % 70}", None, None) for i in range(90)]
    rows += [(3000, "alone", None, "x", 1), (3001, None, "én", "x", 1), (5, "Plain", "en", "s", 5), (5, "Plain", "en", "s", 5)]
    docs = frame(spark, rows).repartition(5)
    found = manifest_of(spark, docs, tmp_path)
    assert found == plain_manifest(docs.collect())
    assert 0 < sum(not r[-1] for r in found) < len(found)


def test_manifest_of_awkward_and_empty_tables(spark, awkward, no_docs, tmp_path):
    assert manifest_of(spark, awkward, tmp_path) == plain_manifest(awkward.collect())
    assert manifest_of(spark, no_docs, tmp_path) == []
    assert merkle.build(no_docs).root() is None
    lone = frame(spark, [(7, "one document")])
    (row,) = manifest_of(spark, lone, tmp_path)
    assert row[1] == row[2] == row[3] and row[4] == sha("")


def test_only_every_few_levels_are_persisted(spark, tmp_path):
    docs = frame(spark, [(i, f"text {i}") for i in range(1500)])
    manifest = merkle.build(docs)
    assert [band.select(F.sum(F.size("nodes"))).first()[0] for band in manifest.leaves.bands] == [1500, 3]
    assert merkle.build(docs.orderBy(F.desc("doc_id"))).root() == manifest.root()
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 700, "other").otherwise(F.col("text")))
    assert merkle.build(changed).root() != manifest.root()


@pytest.mark.parametrize("nodes", [1, 2, 8, 9, 64, 65, 512])
def test_paths_lead_to_the_top(nodes):
    leaves = [merkle.digest(str(i).encode()) for i in range(nodes)]
    levels = merkle.interior(leaves, merkle.levels_in_band(nodes))
    assert len(levels[-1]) == 1
    assert {merkle.fold(leaf, merkle.path_inside(levels, i)) for i, leaf in enumerate(leaves)} == {levels[-1][0]}


# --- token counts -------------------------------------------------------------------

def counter():
    return token_counts.worker_memory("test counter", lambda: token_counts.UnitCounter(token_counts.vocabulary_path()))


def plain_count(text):
    return len(counter().tokenizer.encode(text or "", add_special_tokens=False).ids)


SPACED = st.lists(st.sampled_from([" ", "  ", "\n", "\t ", "\x0b", "\x85", " ", "　", "\x1c", "\x00", "a", "don't", "É", "é", "99", "²",
                                   "<|endoftext|>", "<|", "!?", "한국", "̈", "\U0001f600", "\x7f", "×"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(SPACED, max_size=5))
def test_units_add_up_to_the_tokenizer(texts):
    assert counter().count([t.encode() for t in texts]).tolist() == [plain_count(t) for t in texts]


def test_counts_of_forgetful_workers(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + ["x" * 2000, None, ""]
    forgetful = token_counts.UnitCounter(token_counts.vocabulary_path(), kept_bytes=500)
    expected = [plain_count(t) for t in texts]
    for _ in range(2):
        assert forgetful.count([None if t is None else t.encode() for t in texts]).tolist() == expected
    assert not any(len(unit) > token_counts.LONG_UNIT for unit in forgetful.known)


def counted(frame_):
    return sorted([tuple(r) for r in frame_.collect()], key=repr)


def plain_rows(docs):
    out = [(r["doc_id"], len((r["text"] or "").encode()), plain_count(r["text"])) for r in docs.collect()]
    return sorted([(*row, row[2] > 512) for row in out], key=repr)


def test_token_query_equals_plain_counts(spark, awkward, no_docs, tmp_path):
    for name, docs in (("awkward", awkward), ("empty", no_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        found = QUERIES["op13_token_counts"](spark, str(tmp_path / name))
        assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert counted(found) == plain_rows(docs)


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache, path = scratch_path(spark, "cache"), token_counts.vocabulary_path()
    docs = frame(spark, [(i, f"text number {i % 10}") for i in range(100)] + [(200, "only here"), (200, "only here"), (None, "no id"), (None, "no id"), (300, None), (301, "")])
    version = token_counts.version_of(path)
    assert counted(token_counts.count_tokens(docs, cache)) == plain_rows(docs)

    def stored_rows():
        return spark.read.parquet(cache).groupBy("version").count().collect()

    assert [(r["version"], r["count"]) for r in stored_rows()] == [(version, 13)]
    # A stored count is taken as it is: nothing that is known is encoded again.
    known = spark.createDataFrame([("new text", 77)], "text string, n_tokens bigint").select(
        token_counts.digest(F.col("text")).alias("digest"), "n_tokens", F.lit(version).alias("version"))
    known.write.mode("append").partitionBy("version").parquet(cache)
    more = frame(spark, [(1, "new text"), (2, "newer text"), (3, "text number 3")])
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(more, cache).collect()}
    assert found == {1: 77, 2: plain_count("newer text"), 3: plain_count("text number 3")}
    assert sum(r["count"] for r in stored_rows()) == 15


def test_another_tokenizer_is_another_version(spark, tmp_path):
    cache = scratch_path(spark, "cache")
    with open(token_counts.vocabulary_path(), encoding="utf-8") as file:
        text = file.read()
    other = tmp_path / "other.json"
    other.write_text(text.replace('"version": "1.0"', '"version":  "1.0"').replace('"version":"1.0"', '"version": "1.0"'), encoding="utf-8")
    docs = frame(spark, [(1, "some text"), (2, "another")])
    for path in (None, str(other), None):
        assert counted(token_counts.count_tokens(docs, cache, path)) == plain_rows(docs)
    assert spark.read.parquet(cache).select("version").distinct().count() == 2


def test_long_texts_without_white_space(spark):
    docs = frame(spark, [(1, "ab" * 40_000), (2, "한국어" * 5000), (3, " " * 30_000), (4, "a b " * 50_000)])
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, scratch_path(spark, "cache")).collect()}
    assert found == {r["doc_id"]: plain_count(r["text"]) for r in docs.collect()}


def test_cuts_lie_between_solid_and_space():
    text = "a b  é\tx　 y ×\n".encode()
    assert token_counts.cuts(np.frombuffer(text, np.uint8)).tolist() == [
        i for i in range(1, len(text)) if text[i:i + 1].isspace() and (32 < text[i - 1] < 127 or text[i - 2:i - 1] == b"\xc3")]
