"""Quality rules, language ID, decontamination, PII and importance resampling."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from govlake.llm import decontaminate, importance, language_id, pii, quality_rules
from govlake.llm.common import table
from govlake.llm.queries import QUERIES

from .conftest import AWKWARD, LONG, frame, prose


# --- quality rules -----------------------------------------------------------------

def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    places = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 3000 else None
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), places and len(places) or 0


def test_rules_count_like_plain_python(awkward):
    texts = {i: t for i, t in AWKWARD if i is not None and t is not LONG and i != 8}
    rows = quality_rules.apply_rules(awkward).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        if r["doc_id"] in texts:
            got = r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]
            assert got == counted(texts[r["doc_id"]]), r
            assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
    long = next(r for r in rows if r["doc_id"] == 6)
    assert long["n_words"] == len(LONG.split())


def test_rules_name_what_fails(spark, no_docs):
    clean = "the cat and the dog went to the old house by the sea in winter and " + prose(5, 60)
    texts = [clean, re.sub(r"(\S+)", r"\1###", clean), "\n".join(["the line is the same and it is here again"] * 9)]
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(frame(spark, list(enumerate(texts)))).collect()}
    assert rows[0]["kept"] and rows[0]["failed_rules"] == []
    assert not rows[1]["kept"] and "symbols_per_word" in rows[1]["failed_rules"]
    assert rows[2]["base_failed"] and not rows[2]["kept"] and rows[2]["n_dup_lines"] == 8
    assert quality_rules.apply_rules(no_docs).count() == 0


def test_rules_plan_has_no_python(spark, sf_dir):
    plan = quality_rules.apply_rules(table(spark, sf_dir, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


# --- language ID -------------------------------------------------------------------

def test_language_held_out_accuracy(spark, sf_dir):
    found = QUERIES["op4_language_id"](spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert not any(r["rejected"] for r in rows if r["lang"] == r["lang_pred"])
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark, awkward, no_docs, sf_dir):
    model = language_id.train(table(spark, sf_dir, "documents"))
    rows = language_id.identify(awkward, model).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        if r["doc_id"] in (1, 2, 3, 11):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in model.languages
    kept = language_id.keep_identified(awkward, model)
    assert kept.columns == awkward.columns
    assert language_id.identify(no_docs, model).count() == 0
    nothing = language_id.train(no_docs)
    assert nothing.languages == () and {r["lang_pred"] for r in language_id.identify(awkward, nothing).collect()} == {"und"}


def test_language_learns_only_from_allowed_rows(spark):
    """Labels of held-out documents must not matter."""
    rows = [(i, prose(i, 30) if i % 2 else prose(i, 30).upper().replace("A", "ß"), "xx" if i % 2 else "yy", "s", 1) for i in range(80)]
    lied = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in rows]
    one, two = (language_id.train(frame(spark, r)) for r in (rows, lied))
    assert one.languages == two.languages == ("xx", "yy") and np.array_equal(one.table, two.table)


def verdicts(model, texts):
    languages, scores = model.predict(texts)
    return np.array([model.rejects(*pair) for pair in zip(languages, scores)]), languages


def test_rejection_rejects_what_is_in_no_language(spark):
    """Held-out documents pass; shuffled letters, other scripts and languages left out do not."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    held = [r for r in docs.where("crc32(cast(doc_id as string)) % 4 = 2").collect() if language_id.letters(r["text"])]
    rejected, languages = verdicts(model, [r["text"] for r in held])
    right = np.array([r["lang"] == found for r, found in zip(held, languages)])
    assert right.mean() > 0.97 and rejected[right].mean() <= 0.02
    shuffled, _ = verdicts(model, [language_id.shuffled(language_id.letters(r["text"])).decode() for r in held])
    assert shuffled.mean() >= 0.9
    foreign = ["Съешь ещё этих мягких французских булок, да выпей чаю", "いろはにほへと ちりぬるを わかよたれそ", "hyvää huomenta kaikille ystäville täällä tänään",
               "bugün hava çok güzel ve biz dışarıda yürüyoruz", "dzień dobry wszystkim przyjaciołom których tutaj widzę"]
    assert verdicts(model, foreign)[0].all()
    for lang in ("de", "en"):
        without = language_id.train(docs.where(F.col("lang") != lang))
        left_out, _ = verdicts(without, [r["text"] for r in held if r["lang"] == lang])
        kept, _ = verdicts(without, [r["text"] for r in held if r["lang"] != lang])
        assert left_out.mean() >= 0.9 and kept.mean() <= 0.05


def plain_subwords(text):
    """Buckets of the runs of 3 to 5 bytes of each word with its spaces, one by one."""
    out = []
    for word in language_id.letters(text).split():
        data = b" " + word + b" "
        for size in (3, 4, 5):
            for i in range(len(data) - size + 1):
                code = data[i]
                for byte in data[i + 1:i + size]:
                    code = (code * 0x01000193 + byte + 1) % (1 << 32)
                out.append((code * 0x9E3779B1 % (1 << 32)) >> 17)
    return out


def test_prediction_equals_a_plain_version(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    texts = [r["text"] for r in docs.limit(40).collect()] + ["a", "x" * 400 + " yes", "été à la plage", None, "12 !"]
    monkeypatch.setattr(language_id, "BLOCK_BYTES", 300)
    for text, language, score in zip(texts, *model.predict(texts)):
        found = plain_subwords(text)
        if not found:
            assert (language, score) == ("und", 0.0)
            continue
        logits, typical = (np.array([sum(of[b, k] for b in found) / len(found) for k in range(len(model.languages))]) for of in (model.table, model.typical))
        best = int(logits.argmax())
        margin = logits[best] - max(logits[k] for k in range(len(logits)) if k != best)
        z = model.weights[0] + model.weights[1] * typical[best] + model.weights[2] * margin
        assert language == model.languages[best] and score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_calibration_finds_the_better_weights():
    rng = np.random.default_rng(4)
    right, wrong = (np.c_[np.ones(400), rng.normal(m, 1, 400), rng.normal(0, 1, 400)] for m in (1, -1))
    weights = language_id.calibrate(right, wrong)
    assert weights[1] == pytest.approx(2, abs=0.5) and abs(weights[2]) < 0.4 and abs(weights[0]) < 0.4
    assert np.isfinite(language_id.calibrate(right + [0, 50, 0], wrong)).all()


def test_subwords_of_cut_texts_are_those_of_the_whole(monkeypatch):
    text = language_id.letters(prose(7, 3000))
    whole = np.sort(language_id.subwords(np.frombuffer(text, np.uint8))[0])
    monkeypatch.setattr(language_id, "BLOCK_BYTES", 500)
    cut = np.sort(np.concatenate([language_id.subwords(b)[0] for b, _, _ in language_id.segments([text])]))
    assert np.array_equal(whole, cut)
    for words in ("x" * 1700, "ab " + "y" * 900 + " cd " + "z" * 501 + " e", "z" * 499, "z" * 498 + " " + "q" * 498):
        text = language_id.letters(words)
        whole = np.sort(language_id.subwords(np.frombuffer(text, np.uint8))[0])
        cut = np.sort(np.concatenate([language_id.subwords(b)[0] for b, _, _ in language_id.segments([text])]))
        assert np.array_equal(whole, cut)


# --- decontamination ---------------------------------------------------------------

def brute_hits(text, items):
    def words_of(t):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    words, hit, ids = words_of(text), set(), set()
    for item, item_text in items:
        pattern = words_of(item_text)
        m = min(10, len(pattern))
        windows = {tuple(pattern[i:i + m]) for i in range(len(pattern) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if m and tuple(words[i:i + m]) in windows:
                hit |= set(range(i, i + m))
                if item is not None:
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("words_per_pass", [decontaminate.WORDS_PER_PASS, 60])
def test_contamination_equals_brute_force(spark, awkward, words_per_pass):
    passage = prose(9, 30)
    items = [(7, passage), (10, "Two, words!"), (2, "word"), (None, prose(3, 12)), (3, None), (4, ""), (5, "?!"), (7, passage)]
    extra = [(20, "x " + passage.upper() + " y " + passage), (21, " ".join(passage.split()[3:14])), (22, " ".join(passage.split()[3:12]))]
    docs = awkward.unionByName(frame(spark, extra), allowMissingColumns=True)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' AS spans", "'x' AS part")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in
                 decontaminate.find_contamination(docs, benchmark, words_per_pass).collect())
    assert got == sorted((str(i), *brute_hits(t, items)) for i, t in AWKWARD + extra)
    clean = decontaminate.drop_contaminated(docs, benchmark, words_per_pass)
    assert clean.columns == docs.columns
    assert clean.count() == sum(1 for row in got if row[2] == 0)


def test_contamination_without_rows(spark, awkward, no_docs):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_contamination(no_docs, empty).count() == 0
    assert decontaminate.find_contamination(awkward, empty).where("contaminated").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("a b c d".split()), max_size=60), st.lists(st.lists(st.sampled_from("a b c d".split()), max_size=16), max_size=4))
def test_wu_manber_finds_what_brute_force_finds(words, patterns):
    items = [(str(i), " ".join(p).encode()) for i, p in enumerate(patterns)]
    spans, ids = decontaminate.search(decontaminate.words_of(" ".join(words).encode()), decontaminate.build(items))
    n, hit, expected = brute_hits(" ".join(words), [(i, t.decode()) for i, t in items])
    assert (sum(b - a for a, b in spans), ids) == (hit, expected)


# --- PII ---------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    text = text or ""
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())

    def luhn(number):
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(number))]
        return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0

    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


PARTS = st.sampled_from(["@", "a.b", "x-y", ".", "..", "1.2.3.4", "256.1.1.1", "007.0.0.1.9", "4111 1111 1111 1111", "4111-1111-1111-1112",
                         "+1 (555) 123-4567", "+", "49", "-", " ", "é", "token = \"ab12cd34ef\"", "https://a.b/c?d=1).", "\n", "12", "+4", "(", "%"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans_equal_the_expressions(text):
    found = pii.find_spans(text, pii._automaton())
    assert {k: found[k] for k in pii.BASE_KINDS} == brute_spans(text)


def test_pii_query_over_a_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op8_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute_spans(texts[r["doc_id"]])
        base = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in spans[k])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(len(spans[k]) for k in pii.BASE_KINDS)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)


def test_pii_edge_cases(awkward, no_docs):
    rows = pii.detect(awkward, with_text=True).collect()
    assert len(rows) == len(AWKWARD) and all(r["spans"] == "" for r in rows)
    assert {r["redacted"] for r in rows if r["doc_id"] == 1} == {None}
    assert pii.detect(no_docs).count() == 0


def test_pii_redaction_and_cues():
    text = "mail a@b.co or see https://x.org/p, account: 12345678 from 10.0.0.1 (token too)"
    spans = pii.find_spans(text, pii._automaton())
    assert pii.redacted(text, spans) == "mail [email] or see [url], account: [account] from [ip] (token too)"


# --- importance resampling ---------------------------------------------------------

def test_importance_equals_plain_counts(spark, no_docs, awkward):
    docs = [(i, prose(i, 40 + i)) for i in range(30)] + [(100 + i, prose(i, 40).replace(" ", " # ")) for i in range(10)] + [(200, None), (201, "")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15)] + [(100 + i, 0, 0) for i in range(5)], "doc_id bigint, quality int, toxic int")
    ids, share = importance.target_sample(labels)
    assert sorted(ids) == list(range(15)) and share == 0.75
    raw, target = importance.model_counts(frame(spark, docs), ids)

    def plain(text):
        words = (text or "").encode().split()
        return [(w,) for w in words] + list(zip(words, words[1:]))

    assert raw.sum() == sum(len(plain(t)) for _, t in docs) and target.sum() == sum(len(plain(t)) for i, t in docs if i < 15)
    ratios = importance.log_ratios(raw, target)
    rows = {r["doc_id"]: r for r in importance.resample(frame(spark, docs), labels, share=0.6).collect()}
    for i, text in docs:
        found, _ = importance.grams(*next(importance.blocks([text.encode()]))[:2]) if text else (np.empty(0, int), None)
        assert len(found) == rows[i]["n_grams"] == len(plain(text))
        assert rows[i]["log_importance"] == pytest.approx(ratios[found].sum(), abs=1e-6)
    kept = sorted((r["key"] for r in rows.values() if r["kept"]), reverse=True)
    assert len(kept) == round(0.6 * len(docs)) and min(kept) > max(r["key"] for r in rows.values() if not r["kept"])
    assert not any(rows[100 + i]["kept"] for i in range(10))
    assert importance.resample(no_docs, labels).count() == 0
    assert importance.resample(awkward, labels.limit(0)).where("log_importance != 0").count() == 0


GAPS = st.sampled_from([" ", "\t", "\n", "  ", " \t\r ", "\x0b\x0c", " " * 30])
PIECES = st.lists(st.one_of(GAPS, st.text(alphabet="abé\x00\x1c", min_size=1, max_size=40)), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=4), st.sampled_from([1, 7, 16, 64]))
def test_grams_do_not_depend_on_the_block_size(texts, size):
    """Texts and words longer than a block, cut at any white space, against the whole text."""
    def all_grams(block_bytes):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(importance, "BLOCK_BYTES", block_bytes)
            out = [[] for _ in texts]
            for block, starts, numbers, carried in importance.blocks([t.encode() for t in texts]):
                found, owner = importance.grams(block, starts, carried)
                for bucket, text in zip(found.tolist(), numbers[owner].tolist()):
                    out[text].append(bucket)
        return [sorted(found) for found in out]

    whole = all_grams(1 << 18)
    assert all_grams(size) == whole
    assert [len(found) for found in whole] == [max(0, 2 * len(t.encode().split()) - 1) for t in texts]


def test_threshold_narrows_to_the_kth_key(spark, monkeypatch):
    monkeypatch.setattr(importance, "SORTED_ROWS", 3)
    monkeypatch.setattr(importance, "BINS", 4)
    keys = [float(x) for x in np.random.default_rng(3).normal(0, 5, 200)] + [1.5] * 50
    keyed = spark.createDataFrame([(k,) for k in keys], "key double").cache()
    for k in (1, 7, 60, 100, 250):
        assert importance.threshold(keyed, k) == sorted(keys, reverse=True)[k - 1]
    assert importance.threshold(keyed, 0) is None


def test_gumbel_noise_has_its_moments(spark):
    noise = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").alias("text_key")).select(importance.gumbel(1).alias("g"))
    mean, deviation = noise.agg(F.mean("g"), F.stddev("g")).first()
    assert abs(mean - 0.5772) < 0.05 and abs(deviation - 1.2825) < 0.05
