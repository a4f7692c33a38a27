"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are runs of three to five bytes of the lower-cased letters of a word. The model is
trained by stochastic gradient descent in numpy on a bounded sample of labelled documents.
Since the softmax is linear in the average, prediction needs one table of scores per bucket and
language, which is what is broadcast.

A softmax is as sure of a text in none of its languages as of one in any, so the score also
looks at how typical the text's subwords are of the predicted language. A logistic function of
typicality and margin is fitted on labelled documents outside the training set: right predictions
against their letters shuffled, and against the same documents with their language left out.
The score is its value; a document below the calibrated threshold is rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlake.llm.common import BLOCK_BYTES, map_batches, own_columns

UNKNOWN = "und"
# Labelled documents per language that training and calibration may see.
ROWS_PER_LANGUAGE = 800
# Remainder of the id's checksum by 4 that is kept out of training and calibrates.
CALIBRATION = 3
BUCKETS = 1 << 15
DIMENSIONS = 16
SIZES = (3, 4, 5)
EPOCHS = 12
RATE = 2.0
# Share of rightly predicted calibration documents that the threshold may reject.
REJECTED_SHARE = 0.001
# Subwords of a document that count towards what is typical; mass of a bucket never seen.
TYPICAL_SUBWORDS = 2000
UNSEEN = 0.1
# Penalty on the weights of the calibration, for samples that it separates without an error.
RIDGE = 0.01

_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str | None) -> bytes:
    """Lower-cased words, one space around each; empty when the text has no letter."""
    if not text or not _LETTER.search(text):
        return b""
    return b" " + _NO_LETTERS.sub(" ", text.lower()).strip().encode() + b" "


def subwords(words: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of a byte array, and where each begins.

    A subword may begin or end with the space around a word but not hold one inside.
    """
    space = words == 32
    code = words.astype(np.uint32)
    hashed, inside = code, np.zeros(len(words), bool)
    out, places = [], []
    for size in range(2, max(SIZES) + 1):
        n = len(words) - size + 1
        if n <= 0:
            break
        hashed = hashed[:n] * np.uint32(0x01000193) + code[size - 1:size - 1 + n] + np.uint32(1)
        inside = inside[:n] | space[size - 2:size - 2 + n] if size > 2 else inside[:n]
        if size in SIZES:
            at = np.flatnonzero(~inside)
            mixed = hashed[at] * np.uint32(0x9E3779B1)
            out.append((mixed >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int32))
            places.append(at)
    if not out:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(places)


def segments(texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined into blocks of about ``BLOCK_BYTES``: bytes, text numbers, where they begin.

    A longer text is cut between words into several segments, never inside a word.
    """
    held, numbers, size = [], [], 0
    for number, text in enumerate(texts):
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > BLOCK_BYTES:
                end = (text.rfind(b" ", start + 1, start + BLOCK_BYTES) + 1) or (text.find(b" ", start + BLOCK_BYTES) + 1)
            piece = text[start:end]
            if held and size + len(piece) > BLOCK_BYTES:
                yield _block(held, numbers)
                held, numbers, size = [], [], 0
            held.append(piece)
            numbers.append(number)
            size += len(piece)
            start = end - 1 if end < len(text) else end  # the space is around both words
    if held:
        yield _block(held, numbers)


def _block(held: list[bytes], numbers: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *map(len, held)])[:-1]
    return np.frombuffer(b"".join(held), np.uint8), np.array(numbers), starts


def shuffled(text: bytes) -> bytes:
    """Words of the same lengths from the same letters in another order, the same for equal texts."""
    places = list(text.decode())
    at = [i for i, letter in enumerate(places) if letter != " "]
    order = np.random.default_rng(zlib.crc32(text)).permutation(len(at))
    moved = [places[at[i]] for i in order]
    for i, letter in zip(at, moved):
        places[i] = letter
    return "".join(places).encode()


@dataclass(frozen=True)
class Model:
    """``table`` holds the score of each bucket and language, bias included in the average;
    ``typical`` how much likelier a bucket is in a language than by chance, as a logarithm;
    ``weights`` are those of constant, typicality and margin."""

    languages: tuple[str, ...]
    table: np.ndarray
    typical: np.ndarray
    weights: np.ndarray
    threshold: float

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        plain = [letters(text) for text in texts]
        n_languages = len(self.languages)
        if not n_languages:
            return [UNKNOWN] * len(plain), [0.0] * len(plain)
        both = np.concatenate([self.table, self.typical], axis=1)
        sums, counts = np.zeros((len(plain), 2 * n_languages)), np.zeros(len(plain))
        for block, numbers, starts in segments(plain):
            bucket, at = subwords(block, len(self.table))
            owner = numbers[np.searchsorted(starts, at, side="right") - 1]
            counts += np.bincount(owner, minlength=len(plain))
            for k in range(2 * n_languages):
                sums[:, k] += np.bincount(owner, weights=both[:, k][bucket], minlength=len(plain))
        means = sums / np.maximum(counts, 1)[:, None]
        best, features = evidence(means[:, :n_languages], means[:, n_languages:])
        scores = _sigmoid(features @ self.weights)
        known = [bool(p) for p in plain]
        return (
            [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)],
            [float(score) if ok else 0.0 for score, ok in zip(scores, known)],
        )

    def rejects(self, language: str, score: float) -> bool:
        return language == UNKNOWN or score < self.threshold


def evidence(logits: np.ndarray, typicality: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language of each row, and the features of its score: constant, typicality and margin."""
    best = logits.argmax(1)
    rows = np.arange(len(logits))
    others = logits.copy()
    others[rows, best] = -np.inf
    second = others.max(1) if logits.shape[1] > 1 else logits[rows, best]
    margin = logits[rows, best] - np.where(np.isfinite(second), second, logits[rows, best])
    return best, np.stack([np.ones(len(logits)), typicality[rows, best], margin], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def typicality(rows: Sequence[tuple], n_languages: int, buckets: int) -> np.ndarray:
    """log of each bucket's share in each language over an even share, from (buckets, shares, language, n) rows."""
    seen = np.full((buckets, n_languages), UNSEEN)
    for bucket, share, language, n in rows:
        np.add.at(seen[:, language], bucket, share * min(n, TYPICAL_SUBWORDS))
    return np.log(seen / seen.sum(0) * buckets)


def calibrate(right: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """Weights of a logistic function that tells the features of right from wrong rows, both kinds
    with half of the weight, by Newton's method."""
    if not len(right) or not len(wrong):
        return np.array([0.0, 1.0, 0.0])
    rows = np.concatenate([right, wrong])
    target = np.repeat([1.0, 0.0], [len(right), len(wrong)])
    share = np.repeat([0.5 / len(right), 0.5 / len(wrong)], [len(right), len(wrong)])
    middle, spread = rows.mean(0), np.maximum(rows.std(0), 1e-9)
    middle[0], spread[0] = 0.0, 1.0
    rows = (rows - middle) / spread
    penalty = RIDGE * np.diag([1e-6, 1.0, 1.0])
    weights = np.zeros(3)
    for _ in range(50):
        guess = _sigmoid(rows @ weights)
        slope = rows.T @ (share * (guess - target)) + penalty @ weights
        curve = (rows * (share * guess * (1 - guess))[:, None]).T @ rows + penalty
        weights -= np.linalg.solve(curve, slope)
    plain = weights / spread
    plain[0] -= (plain[1:] * middle[1:]).sum()
    return plain


def fit(samples: Sequence[tuple[np.ndarray, np.ndarray, str, bool]], nonsense: Sequence[tuple[np.ndarray, np.ndarray]] = (),
        buckets: int = BUCKETS, seed: int = 7) -> Model:
    """Train on (buckets, counts, language, for_calibration) rows; ``nonsense`` are (buckets, counts)
    of texts in no language."""
    languages = tuple(sorted({language for _, _, language, _ in samples}))
    if not languages:
        return Model((), np.zeros((buckets, 0)), np.zeros((buckets, 0)), np.array([0.0, 1.0, 0.0]), 0.0)
    index = {language: k for k, language in enumerate(languages)}
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (buckets, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    rows = [(b, (c / c.sum()).astype(np.float32), index[lang], c.sum(), held) for b, c, lang, held in samples if len(b)]
    train = [row[:4] for row in rows if not row[4]] or [row[:4] for row in rows]
    held = [row[:4] for row in rows if row[4]] or train
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for i in rng.permutation(len(train)):
            bucket, share, target, _ = train[i]
            mean = share @ vectors[bucket]
            error = _softmax(mean @ weights + bias)
            error[target] -= 1
            push = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * error
            vectors[bucket] -= (rate * share)[:, None] * push
    table = (vectors @ weights + bias).astype(np.float64)
    typical = typicality(train, len(languages), buckets)

    def means(part: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([share @ of[bucket] for bucket, share, *_ in part]).reshape(len(part), -1) for of in (table, typical))

    if not held:
        return Model(languages, table, typical, calibrate(np.empty((0, 3)), np.empty((0, 3))), 0.0)
    logits, typed = means(held)
    targets = np.array([target for _, _, target, _ in held])
    best, features = evidence(logits, typed)
    right = features[best == targets]
    wrong = [features[best != targets]]
    if len(languages) > 1:  # the same documents where their language is not known
        logits[np.arange(len(targets)), targets] = -np.inf
        wrong.append(evidence(logits, typed)[1])
    strange = [(b, c / c.sum()) for b, c in nonsense if len(b)]
    if strange:
        wrong.append(evidence(*means(strange))[1])
    calibration = calibrate(right, np.concatenate(wrong))
    return Model(languages, table, typical, calibration, rejection_threshold(right @ calibration))


def rejection_threshold(evidence_of_right: np.ndarray) -> float:
    """The score below which at most ``REJECTED_SHARE`` of right predictions should lie, a half at most.

    A sample too small to show so rare cases is taken for normally distributed, with a spread
    that is widened by what so few rows can hide; one row shows no spread and rejects nothing.
    """
    n = len(evidence_of_right)
    if n < 2:
        return 0.0
    spread = NormalDist().inv_cdf(REJECTED_SHARE) * evidence_of_right.std(ddof=1) * (1 + 2 / n)
    low = min(np.quantile(evidence_of_right, REJECTED_SHARE), evidence_of_right.mean() + spread, 0.0)
    return float(_sigmoid(np.float64(low)))


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """A model from the documents' own labels.

    Only documents whose crc32(doc_id) mod 4 is not 2 and whose language is known are looked
    at: remainder 3 calibrates, the others train. About ``rows_per_language`` of each
    language are taken, chosen by a hash of the id; the sample comes to the driver as
    counts of at most ``BUCKETS`` subwords a document (256 kB, twice that where it calibrates),
    so what is collected is bounded by the number of languages, not by the table or its texts.
    """
    rows = own_columns(docs, "doc_id", "lang", "text").withColumn("part", F.crc32(F.col("doc_id").cast("string")) % 4)
    rows = rows.where("lang is not null and doc_id is not null and part != 2")
    spread = 1 << 20
    share = F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.count(F.lit(1)))
    limits = {r["lang"]: r["upto"] for r in rows.groupBy("lang").agg((share * spread).cast("bigint").alias("upto")).collect()}
    if not limits:
        return fit([])
    upto = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("lang")]
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(spread)) < upto)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lang, part in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "part"))):
                plain = letters(text)
                for words, of in [(plain, lang)] + [(shuffled(plain), None)] * (part == CALIBRATION):
                    found = [subwords(block)[0] for block, _, _ in segments([words])]
                    rows.append((of, part, *(np.unique(np.concatenate(found), return_counts=True) if found else ([], []))))
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["lang", "part", "bucket", "n"])

    counted = map_batches(sample.select("text", "lang", "part"), count, "lang string, part bigint, bucket array<int>, n array<int>")
    found = [
        (np.array(r["bucket"], np.int32), np.array(r["n"], np.int32), r["lang"], r["part"] == CALIBRATION)
        for r in counted.toLocalIterator()
    ]
    found.sort(key=lambda s: (s[2] or "", len(s[0]), s[0].tobytes()))
    return fit([s for s in found if s[2] is not None], [s[:2] for s in found if s[2] is None])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """lang_pred, score and the rejection of every document, from its whole text.

    ``und`` with score 0, rejected, if the text is null or has no letter, and for every text
    if the model has seen no language. Repeated rows are predicted each by itself; other
    columns than doc_id and text are neither read nor carried.
    """
    rows = own_columns(docs, "doc_id", "text")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            languages, scores = model.predict(batch.column("text").to_pylist())
            rejected = [model.rejects(*pair) for pair in zip(languages, scores)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return map_batches(rows, run, f"doc_id {id_type}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents the model does not reject, with all their columns.

    Null texts, texts without a letter and texts that are typical of no learned language go;
    repeated rows are judged alike. An empty table stays empty, and a model that has seen no
    language keeps nothing.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            found = zip(*model.predict(batch.column("text").to_pylist()))
            yield batch.filter(pa.array([not model.rejects(*pair) for pair in found], pa.bool_()))

    return map_batches(docs, run, docs.schema)
