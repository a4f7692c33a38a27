"""SimHash, line deduplication, sharding, packing, tool calls and the pipeline."""

import json
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from govlake.llm import components, line_dedup, packing, sharding, simhash, tool_calls
from govlake.llm.common import map_batches, table
from govlake.llm.queries import QUERIES
from govlake.llm.sql import ORACLE_SQL
from govlake.session import apply_runtime_conf

from .conftest import AWKWARD, LONG, frame, prose


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def tie(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_batches_are_bounded_in_bytes_when_they_run(spark):
    """Built here, run after another query has set its own number of rows."""
    docs = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 200_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    built = map_batches(docs, sizes, "n bigint")
    apply_runtime_conf(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    found = [r["n"] for r in built.collect()]
    assert sum(found) > 600 * 200_000 and max(found) < 20 << 20


# --- queries against SQL -----------------------------------------------------------

@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(cursor.fetchall())


# --- components --------------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    edges += [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(1, 60)] + [(5, 5), (None, 3)]
    sets = Sets()
    for a, b in edges:
        if a is not None and a != b:
            sets.tie(a, b)
    found = components.connected_components(spark.createDataFrame(edges, "p long, q long"), "p", "q").collect()
    assert {r["node"]: r["component"] for r in found} == {x: sets.root(x) for x in list(sets.up)}
    assert components.connected_components(spark.createDataFrame([], "p long, q long"), "p", "q").count() == 0


# --- SimHash -----------------------------------------------------------------------

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(fingerprints):
    nodes, sets = sorted(set(fingerprints)), Sets()
    for i, a in enumerate(nodes):
        sets.root(a)
        for b in nodes[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                sets.tie(a, b)
    return sets


def test_simhash_over_awkward_documents(spark, awkward, no_docs):
    rows = simhash.near_duplicates(awkward).collect()
    prints = Counter((str(i), brute_fingerprint(t)) for i, t in AWKWARD)
    assert Counter((str(r["doc_id"]), r["fp"] % (1 << 64)) for r in rows) == prints
    sets = brute_components([p for _, p in prints])
    least = {}
    for i, t in AWKWARD:
        root = sets.root(brute_fingerprint(t))
        least[root] = min(i if i is not None else 1 << 60, least.get(root, 1 << 60))
    assert all(r["component_id"] == (None if (m := least[sets.root(r["fp"] % (1 << 64))]) == 1 << 60 else m) for r in rows)
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert Counter(str(r["doc_id"]) for r in kept.collect()) == Counter(["1", "4", "5", "6", "9", "10", "11", "12", "None"])
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=600))
def test_majority_counts_bits(hashes):
    expected = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    assert simhash.majority(np.array(hashes, np.uint64)) == expected


@pytest.mark.parametrize("limits", [(64, 20_000), (3, 20_000), (2, 8), (1, 1)])
def test_links_join_what_all_pairs_join(spark, limits):
    """Few, many and very many fingerprints under a key take different ways to one result."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(60)}
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)}
    prints |= {p ^ sum(1 << b for b in rng.sample(range(64), 3)) for p in rng.sample(sorted(prints), 30)}
    prints |= {0, 1 << 63, (1 << 64) - 1}
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(nodes, *limits).collect()]
    assert all((a ^ b).bit_count() <= 3 and a != b for a, b in links)
    sets = Sets()
    for p in prints:
        sets.root(p)
    for a, b in links:
        sets.tie(a, b)
    expected = brute_components(prints)
    assert {p: sets.root(p) for p in prints} == {p: expected.root(p) for p in prints}


# --- line deduplication ------------------------------------------------------------

def cleaned(spark, rows, **options):
    return {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows), **options).collect()}


def block(seed, lines=3):
    return "\n".join(" ".join(prose(seed * 100 + i, 11).split()) for i in range(lines))


def test_later_documents_lose_aligned_blocks(spark):
    a, b, c, d = (block(i) for i in range(1, 5))
    rows = [(1, f"{a}\n{b}"), (2, f"{c}\n{b}\n{d}"), (3, f"{b}\n{a}"), (4, f"{d}\n{c}\nshort one\n{d}"), (5, "short one\nown text of this one"), (6, f"  {a.upper()}")]
    assert cleaned(spark, rows) == {1: f"{a}\n{b}", 2: f"{c}\n{d}", 3: "", 4: "short one", 5: "short one\nown text of this one", 6: f"  {a.upper()}"}


@pytest.mark.parametrize("rare", [8, 1, 3])
def test_common_lines_are_deleted_but_in_their_first_holder(spark, rare):
    """More holders than ``rare`` take another way to the same result."""
    shared, notice = block(50, 4), block(60, 1)
    rows = [(i, f"{block(i)}\n{shared}\n{notice}\n\nend") for i in range(10, 18)] + [(5, notice), (30, shared)]
    got = cleaned(spark, rows, rare=rare)
    assert got.pop(5) == notice and got.pop(10) == f"{block(10)}\n{shared}\n\nend" and got.pop(30) == ""
    assert all(text.startswith(block(i)) and shared not in text and notice not in text for i, text in got.items())


def brute_cleaned(rows, min_words=5):
    """Without the lines of every block of enough words that any earlier document holds."""
    out = {}
    for place, (doc, text) in enumerate(rows):
        lines, gone = text.split("\n"), set()
        for _, other in rows[:place]:
            there = other.split("\n")
            for i in range(len(lines)):
                for j in range(len(there)):
                    n = 0
                    while i + n < len(lines) and j + n < len(there) and lines[i + n].strip() == there[j + n].strip():
                        n += 1
                    if sum(len(line.split()) for line in lines[i:i + n]) >= min_words:
                        gone |= set(range(i, i + n))
        out[doc] = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("rare", [8, 2, 1, 0, 1000])
def test_blocks_go_whatever_the_number_of_holders(spark, rare):
    """Short lines between blank ones, in many documents; passages with a line another document held first."""
    verse = "\n\n".join(" ".join(prose(700 + i, 1 + i % 4).split()) for i in range(9))
    passage = ["aa bb", "cc", "dd ee", "ff"]
    rows = [(i, verse) for i in range(1, 13)] + [(20, "cc")]
    rows += [(30 + i, f"own {i}\n" + "\n".join(passage)) for i in range(10)]
    got = cleaned(spark, rows, rare=rare)
    assert got == brute_cleaned(rows)
    assert [got[i] for i in (1, 2, 12, 20, 30, 31, 39)] == [verse, "", "", "cc", rows[13][1], "own 1", "own 9"]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    pool = ["", "", " ", "a", "b", "c d", "e f", "g h i", "j k l m", "n o p q r", "s t u v w x"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 14)))) for i in range(60)]
    rows += [(100 + i, rows[rng.randrange(60)][1]) for i in range(20)]
    expected = brute_cleaned(rows)
    assert all(cleaned(spark, rows, rare=rare) == expected for rare in (0, 2, 8, 1000))


def test_a_block_goes_if_its_lines_were_first_held_by_different_documents(spark):
    lines = ["aa bb", "cc dd", "ee ff gg", "hh"]
    rows = [(i, f"{line}\nown line of {i}") for i, line in enumerate(lines)]
    rows += [(10, "\n".join(lines)), (11, "before\n" + "\n".join(lines) + "\nbehind")]
    assert cleaned(spark, rows) == {**dict(rows), 11: "before\nbehind"}


def test_line_dedup_edge_cases(spark, awkward, no_docs):
    result = line_dedup.dedup_lines(awkward)
    rows = result.collect()
    assert set(result.columns) == set(awkward.columns) | {"n_lines", "n_deleted"} and len(rows) == len(AWKWARD)
    changed = {r["doc_id"] for r in rows if r["n_deleted"]}
    assert changed == {7, 8}
    assert {r["text"] for r in rows if r["doc_id"] == 7} <= {"", "\n"}
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    assert line_dedup.dedup_lines(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=25), st.lists(st.integers(0, 9), max_size=25))
def test_blocks_are_common_and_in_order(later, earlier):
    blocks = line_dedup.align(later, earlier)
    for start, there, n in blocks:
        assert n > 0 and later[start:start + n] == earlier[there:there + n]
    for (a, b, n), (c, d, _) in zip(blocks, blocks[1:]):
        assert a + n <= c and b + n <= d


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=25), st.lists(st.integers(1, 9), max_size=25))
def test_with_no_least_size_every_common_line_goes(later, earlier):
    def ids(lines):
        seen = Counter()
        out = []
        for line in lines:
            out.append(line + 100 * seen[line])
            seen[line] += 1
        return out

    gone = line_dedup.deleted_lines(later, [1] * len(later), ids(later), earlier, ids(earlier), 1)
    assert gone == [i for i, line in enumerate(later) if line in set(earlier)]


def test_every_deletion_comes_from_an_alignment(monkeypatch):
    lines, words = [11, 12, 13, 14], [5, 5, 5, 5]
    assert line_dedup.deleted_lines(lines, words, lines, [1, *lines], [1, *lines], 5) == [0, 1, 2, 3]
    monkeypatch.setattr(line_dedup, "align", lambda *_: [])
    assert line_dedup.deleted_lines(lines, words, lines, [1, *lines], [1, *lines], 5) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 5)), max_size=14), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 5)), max_size=14))
def test_alignments_cover_all_common_blocks(later, earlier):
    """Lines (content, words) with many repeats, blank ones included, against a search of all runs."""
    size = {line: 1 + line % 4 for line in range(1, 7)} | {0: 0}
    a, b = [line for line, _ in later], [line for line, _ in earlier]
    gone = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(size[line] for line in a[i:i + n]) >= 5:
                gone |= set(range(i, i + n))
    assert line_dedup.deleted_lines(a, [size[line] for line in a], a, b, b, 5) == sorted(gone)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=30))
def test_chains_increase_and_hold_all(places):
    anchors = list(enumerate(places))
    chains = line_dedup.increasing_chains(anchors)
    assert sorted(x for chain in chains for x in chain) == anchors
    assert all(x[1] < y[1] and x[0] < y[0] for chain in chains for x, y in zip(chain, chain[1:]))
    # As few chains as the longest run that never increases is long.
    longest = [1] * len(places)
    for i, place in enumerate(places):
        longest[i] = 1 + max((longest[j] for j in range(i) if places[j] >= place), default=0)
    assert len(chains) == max(longest, default=0)


# --- sharding ----------------------------------------------------------------------

def assert_law(rows, docs, n_shards):
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == len(docs) and max(counts.values(), default=0) - min(counts.get(s, 0) for s in range(n_shards)) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))
    size = Counter((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == size


def test_shards_are_even_and_keep_groups(spark, awkward, no_docs):
    docs = [(1000 * g + i, prose(g, 30)) for g in range(40) for i in range(5)] + [(90_000 + i, "hot " + prose(99, 20)) for i in range(100)]
    rows = sharding.shard_documents(frame(spark, docs), 6).collect()
    assert_law(rows, docs, 6)
    shards = {}
    for r in rows:
        shards.setdefault(r["doc_id"] // 1000, set()).add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 12
    assert_law(sharding.shard_documents(awkward).collect(), AWKWARD, 24)
    assert sharding.shard_documents(no_docs).count() == 0


def test_large_groups_are_dealt_in_units(spark):
    docs = [(i, "one text for all of them") for i in range(300)] + [(1000 + i, prose(i, 5)) for i in range(100)]
    assert_law(sharding.shard_documents(frame(spark, docs), 7, unit_rows=16).collect(), docs, 7)


def test_linked_documents_move_together(spark):
    """Documents that share a long line end in one shard more often than chance would have it."""
    docs = [(g * 100 + i, f"{prose(1000 + g, 11)}\n{prose(g * 100 + i, 11)}") for g in range(60) for i in range(6)]
    rows = sharding.shard_documents(frame(spark, docs), 5).collect()
    assert_law(rows, docs, 5)
    most = [max(Counter(r["shard"] for r in rows if r["doc_id"] // 100 == g).values()) for g in range(60)]
    assert sum(most) / len(docs) > 0.75


def test_rounds_go_on_while_units_move(spark):
    long_line = lambda seed: " ".join(prose(seed, 11).split()) + " and forty characters of it"
    docs = frame(spark, [(g * 100 + i, f"{long_line(1000 + g)}\n{long_line(g * 100 + i + 50_000)}") for g in range(60) for i in range(6)])

    def together(**options):
        rows = sharding.shard_documents(docs, 5, **options).collect()
        return sum(max(Counter(r["shard"] for r in rows if r["doc_id"] // 100 == g).values()) for g in range(60))

    assert together() > together(rounds=4)


def shared_hubs(docs):
    """Texts and longer lines that several documents hold, with these."""
    hubs = {}
    for doc, text in docs:
        for hub in {("text", text), *(("line", line) for line in text.split("\n") if len(line) >= 40)}:
            hubs.setdefault(hub, set()).add(doc)
    return [held for held in hubs.values() if len(held) > 1]


def plain_shards(docs, n_shards):
    """Label propagation one document after the other: to the shard that holds most of its hubs'
    documents, as long as there is room."""
    hubs, room = shared_hubs(docs), -(-len(docs) // n_shards)
    of = {doc: [hub for hub in hubs if doc in hub] for doc, _ in docs}
    place = {doc: number % n_shards for number, (doc, _) in enumerate(docs)}
    for _ in range(16):
        for doc, _ in docs:
            votes = Counter(place[other] for hub in of[doc] for other in hub)
            held = Counter(place.values())
            for shard, n in votes.most_common():
                if n <= votes[place[doc]]:
                    break
                if held[shard] < room:
                    place[doc] = shard
                    break
    return place


def test_few_links_are_cut(spark):
    """Against a plain version in turns, with lines shared by groups, copies, and documents without links."""
    long_line = lambda seed: " ".join(prose(seed, 11).split()) + " and forty characters of it"
    docs = [(g * 100 + i, f"{long_line(1000 + g)}\n{long_line(g * 100 + i + 50_000)}") for g in range(50) for i in range(5)]
    docs += [(20_000 + i, docs[i * 7][1]) for i in range(30)] + [(30_000 + i, prose(80_000 + i, 6)) for i in range(120)]
    random.Random(2).shuffle(docs)
    place = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(frame(spark, docs), 8).collect()}
    hubs = shared_hubs(docs)

    def cut(place):
        return sum(len({place[doc] for doc in hub}) > 1 for hub in hubs)

    assert cut(place) <= cut(plain_shards(docs, 8)) + len(hubs) // 20
    assert cut(place) < len(hubs) // 5


# --- packing -----------------------------------------------------------------------

def assert_packed(rows, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in docs}
    pieces, sequences = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert (r["ids_crc32"], r["doc_tokens"]) == (zlib.crc32(part.tobytes()), len(ids[r["doc_id"]]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["context"], r["step_id"]))
    copies = Counter(i for i, _ in docs)
    for doc, found in pieces.items():
        covered = Counter(p for start, n in found for p in range(start, start + n))
        assert covered == {p: copies[doc] for p in range(len(ids[doc]))}
    assert pieces.keys() == ids.keys()
    steps = Counter()
    for found in sequences.values():
        at = 0
        for offset, n, _, _ in sorted(found):
            assert offset == at
            at += n
        assert at == found[0][2] <= 2048 and at & (at - 1) == 0  # full: nothing is padded
        steps[found[0][3]] += at
    assert all(n <= packing.STEP_TOKENS for n in steps.values())


def test_packing_round_trip(spark, sf_dir, awkward, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert_packed(QUERIES["op9_packing"](spark, sf_dir).collect(), docs)
    packed = [r for r in packing.pack_documents(awkward).collect() if r["doc_id"] is not None]
    whole = Counter((r["sequence_id"], r["context"]) for r in packing.pack_documents(awkward).collect())
    assert len(whole) == len({s for s, _ in whole})
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    known = [(i, t) for i, t in AWKWARD if i is not None]
    assert sum(n * k for (_, _, n, _), k in pieces.items()) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    assert {r["doc_id"] for r in packed} == {i for i, _ in known}
    assert packing.pack_documents(no_docs).count() == 0


TRICKY = st.lists(st.sampled_from([" ", " ", "\x85", "\x1c", "A", "don't", "we'LL", "É", "é", "9½", "<|endoftext|>", "<|x", "\U0001f600", "\n", "ﬁ", "İ", "!?", " ", "　", "한국"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(TRICKY)
def test_word_by_word_equals_the_tokenizer(text):
    tokenizer = packing.worker_memory("test tokenizer", lambda: packing.WordTokenizer(packing.vocabulary_path()))
    expected = tokenizer.tokenizer.encode(text, add_special_tokens=False).ids + [1]
    assert np.frombuffer(tokenizer.encode(pa.array([text]))[0], "<u4").tolist() == expected


def test_forgotten_words_are_encoded_again(spark, sf_dir):
    """Whatever a worker remembers, and however long a word is, ids are those of the tokenizer."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    texts = [*texts, "a" * 3000, None, "", "a" * 3000 + " É" * 400]
    forgetful = packing.WordTokenizer(packing.vocabulary_path(), kept_bytes=1000)
    for block in (pa.array(texts), pa.array(texts[::-1]), pa.array(texts, pa.large_string())[3:9]):
        expected = [forgetful.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in block.to_pylist()]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in forgetful.encode(block)] == expected
    assert not any(len(word) > packing.LONG_WORD for word in forgetful.recent)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=40), st.integers(1, 10))
def test_packer_fills_every_window(lengths, calls):
    packer, windows = packing.Packer(), []
    for number, length in enumerate(lengths):
        packer.add(number, length)
        if number % calls == 0:
            windows += packer.pack()
    windows += packer.pack() + packer.rest()
    assert all(sum(p[2] for p in pieces) == size for size, pieces in windows)
    covered = Counter((doc, p) for _, pieces in windows for doc, start, n in pieces for p in range(start, start + n))
    assert covered == {(doc, p): 1 for doc, length in enumerate(lengths) for p in range(length)}
    assert sum(size not in packing.TIERS for size, _ in windows) <= 11


# --- tool calls --------------------------------------------------------------------

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
SCHEMAS = [("f", "a", "integer", True), ("f", "b", "number", False), ("f", "c", "string", None), ("g", "x", "boolean", False), (None, "y", "string", True)]


def linked(spark, calls, results):
    calls = spark.createDataFrame(calls, CALLS).withColumns({"status": F.lit(1), "position": F.lit("x"), "_first": F.lit(2)})
    results = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string").withColumn("depth", F.lit(9))
    schemas = spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")
    return tool_calls.link_tool_calls(calls, results, schemas)


def test_links_order_and_validation(spark):
    calls = [
        (1, "p", 1, "f", '{"b": 1.50, "a": 2}', ["q", "gone", None]),
        (1, "q", 3, "f", '{"a": "2", "zz": null, "c": "t"}', ["r"]),
        (1, "r", 5, "g", "[1]", []),
        (1, "s", 2, "nope", "{}", None),
        (1, "t", 4, "f", "{oops", ["t"]),
        (1, "u", 6, "f", '{"b": 3, "a": 9}', ["t"]),
        (2, "p", 1, "g", '{"x": true}', ["q"]),
        (1, "p", 9, "f", "{}", []), (1, None, 1, "f", "{}", []), (3, "n", 0, "g", None, []),
    ]
    results = [(1, "p", 2, "ok"), (1, "q", 1, "too soon"), (1, "zz", 4, None), (1, "p", 7, "again"), (2, None, 3, "lost")]
    rows = {(r["conv_id"], r["call_id"]): r for r in linked(spark, calls, results).collect()}
    assert len(rows) == 9
    status = {k: r["status"] for k, r in rows.items()}
    assert status == {(1, "p"): "linked", (1, "q"): "early", (1, "r"): "unanswered", (1, "s"): "unanswered", (1, "t"): "unanswered",
                      (1, "u"): "unanswered", (1, "zz"): "orphan", (2, "p"): "unanswered", (3, "n"): "unanswered"}
    order = {k[1]: (r["hops"], r["position"]) for k, r in rows.items() if k[0] == 1}
    assert order == {"s": (0, 0), "r": (0, 1), "q": (1, 2), "p": (2, 3), "t": (None, None), "u": (0, 4), "zz": (None, None)}
    errors = {k[1]: r["errors"] for k, r in rows.items() if k[0] == 1}
    assert errors == {"p": [], "q": ["type:a", "unknown:zz"], "r": ["not_object"], "s": ["unknown_tool"], "t": ["not_json"], "u": [], "zz": None}
    assert rows[2, "p"]["valid"] and rows[3, "n"]["errors"] == ["not_json"]
    assert (rows[1, "p"]["n_calls"], rows[1, "p"]["n_results"]) == (2, 2)
    assert rows[1, "p"]["line"] == '{"arguments":{"a":2,"b":1.5},"depends_on":["gone","q",null],"id":"p","name":"f","result":"ok"}'
    assert json.loads(rows[1, "u"]["line"])["arguments"] == {"a": 9, "b": 3}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_call_comes_after_what_it_needs(spark, seed):
    rng = random.Random(seed)
    rank = list(range(30))
    rng.shuffle(rank)
    calls = [(1, f"c{i}", rng.randrange(6), "g", "{}", [f"c{j}" for j in rng.sample(range(30), 3) if rank[j] < rank[i]]) for i in range(30)]
    calls += [(2, "a", 1, "g", "{}", ["b"]), (2, "b", 2, "g", "{}", ["c"]), (2, "c", 1, "g", "{}", ["a"]), (2, "d", 3, "g", "{}", ["a"]), (2, "e", 0, "g", "{}", [])]
    rows = {(r["conv_id"], r["call_id"]): r["position"] for r in linked(spark, calls, []).collect()}
    assert sorted(p for (c, _), p in rows.items() if c == 1) == list(range(30))
    assert all(rows[1, need] < rows[c, call] for c, call, _, _, _, needs in calls if c == 1 for need in needs)
    assert {k[1]: p for k, p in rows.items() if k[0] == 2} == {"a": None, "b": None, "c": None, "d": 1, "e": 0}


def test_only_calls_of_a_circle_are_given_up(spark):
    needs = {"a": ["b"], "b": ["a"], "c": [], "v": ["c"], "w": ["v"], "x": ["a", "w"], "y": ["x"], "f": []}
    turns = {"a": 5, "b": 1, "c": 5, "v": 1, "w": 2, "x": 1, "y": 9, "f": 3}
    calls = [(k, c, turns[c], "g", "{}", needs[c]) for k in (1, 2) for c in needs if (k, c) not in {(2, "b")}]
    rows = {(r["conv_id"], r["call_id"]): (r["hops"], r["position"]) for r in linked(spark, calls, []).collect()}
    assert {c: rows[1, c] for c in needs} == {
        "a": (None, None), "b": (None, None), "f": (0, 0), "c": (0, 1), "v": (1, 2), "w": (2, 3), "x": (3, 4), "y": (0, 5)}
    assert {c: p for (k, c), (_, p) in rows.items() if k == 2} == {"f": 0, "a": 1, "c": 2, "v": 3, "w": 4, "x": 5, "y": 6}


@pytest.mark.parametrize("seed", [1, 2])
def test_calls_outside_circles_have_a_place(spark, seed):
    rng = random.Random(seed)
    calls = [(1, f"c{i}", rng.randrange(4), "g", "{}", [f"c{rng.randrange(40)}"]) for i in range(40)]
    needs = {c: n[0] for _, c, _, _, _, n in calls}  # one each, so that no call is between two circles
    in_circle = set()
    for c in needs:
        at = needs[c]
        for _ in needs:
            if at == c:
                in_circle.add(c)
            at = needs[at]
    place = {r["call_id"]: r["position"] for r in linked(spark, calls, []).collect()}
    assert {c for c, p in place.items() if p is None} == in_circle
    assert sorted(p for p in place.values() if p is not None) == list(range(40 - len(in_circle)))
    assert all(place[n] < place[c] for c, n in needs.items() if c not in in_circle and n not in in_circle)


def test_long_chains_and_empty_tables(spark):
    chain = [(1, str(i), 100 - i, "g", "{}", [str(i - 1)]) for i in range(12)]
    rows = {r["call_id"]: r["position"] for r in linked(spark, chain, []).collect()}
    assert rows == {str(i): i for i in range(12)}
    deep = [(c, str(i), i, "g", "{}", [str(i - 1)]) for c in (1, 2) for i in range(400)]
    found = {(r["conv_id"], r["call_id"]): (r["hops"], r["position"]) for r in linked(spark, deep, []).collect()}
    assert found == {(c, str(i)): (0, i) for c in (1, 2) for i in range(400)}
    assert linked(spark, [], []).count() == 0


@pytest.mark.parametrize("operator", ["tools", "shards"])
def test_native_plans_have_no_python(spark, sf_dir, operator):
    query = {"tools": "op10_tool_calls", "shards": "op2_label_propagation"}[operator]
    plan = QUERIES[query](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow|Cartesian|NestedLoop", plan)


# --- pipeline ----------------------------------------------------------------------

def test_pipeline_stages_take_effect(spark, tmp_path):
    passage = " ".join(prose(70, 40).split())
    own = [block(200 + i, 8) for i in range(12)]
    near = own[0].split("\n")
    near[3] = near[3] + " extra"
    docs = [(i, text, "en", "s", len(text)) for i, text in enumerate(own)]
    docs += [(50, own[1], "en", "s", 1), (51, "\n".join(reversed(near)) + "\n" + block(900, 1), "en", "s", 1), (52, f"{block(901)} {passage} {block(902)}", "en", "s", 1),
             (53, None, None, None, None), (54, "123 456", "en", "s", 7)]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = table(spark, str(tmp_path), "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r["doc_id"]: r["text"] for r in kept.collect()})
    assert set(seen[0]) == {*range(12), 50, 51, 52}
    assert set(seen[1]) == {*range(12), 51, 52} and len(seen[1][51].split("\n")) == 2
    assert set(seen[3]) == {*range(12), 51} and all(seen[3][i] == own[i] for i in range(12))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert_packed(packed, [(i, t) for i, t in seen[3].items()])


def test_pipeline_takes_awkward_and_empty_tables(spark, awkward, no_docs, tmp_path):
    benchmark = spark.createDataFrame([(1, prose(70, 40))], "item_id long, text string")
    for name, docs in (("awkward", awkward), ("none", no_docs)):
        folder = f"{tmp_path}/{name}"
        os.makedirs(folder)
        docs.write.parquet(f"{folder}/documents.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, folder).collect()
        assert bool(rows) == (name == "awkward")
        assert LONG and len({r["doc_id"] for r in rows}) <= len(AWKWARD)
