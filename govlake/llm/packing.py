"""Hierarchical multi-length packing of token sequences.

Each task tokenises and packs its own share of the documents, so nothing is shuffled and a
text is tokenised once. A document is cut at the longest context size; its remainder is
routed to the tier of the smallest context size that holds it. Tiers are packed from the
longest down: a window opened by a piece of its own tier is filled with the longest pieces
of shorter tiers that fit and, at the end, with the head of one that doesn't. What is left
of a task, less than one long window, is cut at falling powers of two. So every window is
full and no token is padding. Windows of a tier form step groups of equal token counts.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from govlake.llm.common import gathered, map_batches, own_columns, worker_memory

TIERS = (256, 512, 1024, 2048)
END = (1).to_bytes(4, "little")
# Tokens held back and packed together.
BLOCK_TOKENS = 1 << 20
# Text tokenised at once.
TEXT_BYTES = 4 << 20
# Memory for the words a worker remembers, twice this with the older generation; what an entry
# takes besides its bytes; bytes of a word beyond which it is not remembered.
KEPT_BYTES = 32 << 20
ENTRY_BYTES = 160
LONG_WORD = 256
STEP_TOKENS = 8 * 2048

Piece = tuple[int, int, int]  # document, start, length

# Words of these characters are lower-cased one by one and have nothing to compose; what the
# tokenizer's expression finds in them then.
_PLAIN = re.compile(r"[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of a text, from a tokenizer that never joins across white space.

    The distinct words of a block of texts are looked up among those seen lately. A new word
    of ASCII and Latin-1 letters is lower-cased and cut into the pieces that the tokenizer's
    own expression finds, and the pieces of all new words are encoded in one call by the bare
    merge model, whose last id of a piece carries the mark of a word's end. Any other word
    goes through the whole tokenizer. What is remembered is two generations of words, each
    bounded in bytes.
    """

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept_bytes, self.size = kept_bytes, 0
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encoded(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each word with its ids."""
        cut, pieces, whole = [], [], []
        for word in words:
            text = word.decode(errors="replace")
            if _PLAIN(text) and "<|" not in text:  # the strings of special tokens begin so
                cut.append(word)
                pieces.append(_PIECES(text.lower()))
            else:
                whole.append((word, text))
        if cut:
            joined = " ".join([piece for found in pieces for piece in found])
            ids = np.array(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            last = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) - 1
            cuts = (4 * (np.flatnonzero(self.ends[ids])[last] + 1)).tolist()
            packed = ids.tobytes()
            yield from zip(cut, [packed[a:b] for a, b in zip([0, *cuts], cuts)])
        encodings = self.tokenizer.encode_batch_fast([text for _, text in whole], add_special_tokens=False)
        for (word, _), encoding in zip(whole, encodings):
            yield word, np.array(encoding.ids, "<u4").tobytes()

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        if self.size > self.kept_bytes:
            self.recent, self.older, self.size = {}, self.recent, 0
        found = list(map(self.recent.get, words))
        new = []
        for word in [word for word, ids in zip(words, found) if ids is None and word]:
            ids = self.older.get(word)
            if ids is None:
                new.append(word)
            else:
                self._keep(word, ids)
        once = {}
        for word, ids in self._encoded(new):
            if len(word) > LONG_WORD:
                once[word] = ids
            else:
                self._keep(word, ids)
        return [self.recent.get(w) or once.get(w, b"") if ids is None else ids for w, ids in zip(words, found)]

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.recent[word] = ids
        self.size += len(word) + len(ids) + ENTRY_BYTES

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text with the end id; a null text is an empty one."""
        large = pa.types.is_large_string(texts.type)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, pa.scalar("", texts.type)))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.large_binary() if large else pa.binary()).to_pylist()
        found = self.look_up(distinct)
        places = words.indices.to_numpy()
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = lengths[places]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        packed = flat[np.repeat(starts[places] - upto[:-1], sizes) + np.arange(upto[-1])].tobytes()
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        cuts = (4 * upto[offsets]).tolist()
        return [packed[a:b] + END for a, b in zip(cuts, cuts[1:])]


class Packer:
    """Packs pieces into full windows; pieces that fill none yet wait for the next call."""

    def __init__(self, tiers: Sequence[int] = TIERS) -> None:
        self.tiers = sorted(tiers)
        self.pools: dict[int, list[tuple[int, Piece]]] = {tier: [] for tier in self.tiers}
        self.full: list[tuple[int, list[Piece]]] = []  # (context size, pieces)

    def add(self, doc: int, length: int) -> None:
        longest = self.tiers[-1]
        start = 0
        while length - start >= longest:
            self.full.append((longest, [(doc, start, longest)]))
            start += longest
        if length > start:
            self._route((doc, start, length - start))

    def _route(self, piece: Piece) -> None:
        tier = self.tiers[bisect.bisect_left(self.tiers, piece[2])]
        if piece[2] == tier:
            self.full.append((tier, [piece]))
        else:
            bisect.insort(self.pools[tier], (piece[2], piece))

    def _longest_within(self, gap: int) -> Piece | None:
        """Take the longest waiting piece of at most ``gap`` tokens."""
        for tier in reversed(self.tiers):
            pool = self.pools[tier]
            at = bisect.bisect_right(pool, (gap, (1 << 62, 0, 0)))
            if at:
                return pool.pop(at - 1)[1]
        return None

    def _head(self, gap: int) -> Piece | None:
        """Cut ``gap`` tokens off the shortest piece that is longer."""
        for tier in self.tiers:
            pool = self.pools[tier]
            at = bisect.bisect_right(pool, (gap, (1 << 62, 0, 0)))
            if at < len(pool):
                doc, start, length = pool.pop(at)[1]
                self._route((doc, start + gap, length - gap))
                return doc, start, gap
        return None

    def pack(self) -> list[tuple[int, list[Piece]]]:
        """Full windows of what has been added; an incomplete one stays."""
        for tier in reversed(self.tiers):
            while self.pools[tier]:
                window = [self.pools[tier].pop()[1]]
                gap = tier - window[0][2]
                while gap:
                    piece = self._longest_within(gap) or self._head(gap)
                    if piece is None:
                        break
                    window.append(piece)
                    gap -= piece[2]
                if gap:
                    for piece in window:
                        bisect.insort(self.pools[self.tiers[bisect.bisect_left(self.tiers, piece[2])]], (piece[2], piece))
                    break
                self.full.append((tier, window))
        done, self.full = self.full, []
        return done

    def rest(self) -> list[tuple[int, list[Piece]]]:
        """Windows at falling powers of two for everything that still waits."""
        waiting = [piece for tier in reversed(self.tiers) for _, piece in reversed(self.pools[tier])]
        self.pools = {tier: [] for tier in self.tiers}
        left = sum(piece[2] for piece in waiting)
        windows = []
        while left:
            size = min(1 << (left.bit_length() - 1), self.tiers[-1])
            window, gap = [], size
            while gap:
                doc, start, length = waiting.pop(0)
                window.append((doc, start, min(length, gap)))
                if length > gap:
                    waiting.insert(0, (doc, start + gap, length - gap))
                gap -= window[-1][2]
            windows.append((size, window))
            left -= size
        return windows


def pack_documents(docs: DataFrame, path: str | None = None, tiers: Sequence[int] = TIERS, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it comes from, where it goes, the checksum of its ids, its step.

    A null text is an empty one, which is the end id alone. Repeated rows are packed each by
    itself. Other columns than doc_id and text are not carried. ``sequence_id`` and
    ``step_id`` hold the task's number in their upper bits. An empty table has no pieces.
    """
    vocabulary = path or vocabulary_path()
    rows = own_columns(docs, "doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    arrow_id = rows.limit(0).toArrow().schema.field("doc_id").type
    schema = (
        f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, context int, step_id bigint" + ", ids array<int>" * with_ids
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        tokenizer = worker_memory(f"word tokenizer {vocabulary}", lambda: WordTokenizer(vocabulary))
        packer, ids, doc_ids, made = Packer(tiers), {}, {}, 0
        in_step: dict[int, tuple[int, int]] = {}  # by context size: windows in the open step, its number
        steps = pending = number = 0

        def rows_of(windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            nonlocal made, steps
            out: list[tuple] = []
            for context, window in windows:
                count, step = in_step.get(context, (0, -1))
                if step < 0 or (count + 1) * context > max(STEP_TOKENS, context):
                    count, step, steps = 0, steps, steps + 1
                in_step[context] = count + 1, step
                offset = 0
                for doc, start, length in window:
                    piece = ids[doc][4 * start:4 * (start + length)]
                    out.append((doc_ids[doc], start, length, zlib.crc32(piece), len(ids[doc]) // 4,
                                task << 32 | made, offset, context, task << 32 | step,
                                *[np.frombuffer(piece, "<i4")] * with_ids))
                    offset += length
                made += 1
            waiting = {piece[0] for pool in packer.pools.values() for _, piece in pool}
            for doc in [d for d in ids if d not in waiting]:
                del ids[doc], doc_ids[doc]
            kinds = [arrow_id, *[pa.int64()] * 6, pa.int32(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
            columns = list(zip(*out)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_id",
                       *["ids"] * with_ids],
            )

        for batch in gathered(batches, TEXT_BYTES):
            for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(batch.column("text"))):
                doc_ids[number], ids[number] = doc_id, encoded
                packer.add(number, len(encoded) // 4)
                pending += len(encoded) // 4
                number += 1
            if pending >= BLOCK_TOKENS:
                yield rows_of(packer.pack())
                pending = 0
        yield rows_of(packer.pack() + packer.rest())

    return map_batches(rows, run, schema)
