import random

from pyspark.sql import functions as F

from govlake.functions import outputs
from govlake.operators import moderate, redact, sizing
from govlake.plans import jobs
from govlake.sources.tables import local_rows, sample_table


def fold(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute_force(docs, phrases):
    found = {}
    for doc, text in docs:
        hit = [pos for pos, phrase in phrases if phrase and fold(phrase) in fold(text)]
        if hit:
            found[doc] = (min(hit), len(hit))
    return found


def corpus(seed=2, n=300):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gam", "d", "éa", "x\ty", "end\n", "a", "", "Ünder"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(n)]
    phrases = ["", "a", "PHA", "ha be", "beta gam d", "éa x", "alpha alpha alpha alpha alpha", "d  a", "y a", "zz", "m d éa x\ty e",
               "nd\n alpha", "éÉ", "d", "BETA GAM", " "]
    phrases += [" ".join(rng.choice(words) for _ in range(6)) for _ in range(40)]
    return docs, list(enumerate(phrases))


def matches(spark, docs, phrases):
    frame = local_rows(spark, docs, "doc_id BIGINT, text STRING")
    listed = local_rows(spark, phrases, "pos INT, phrase STRING")
    rows = moderate.phrase_matches(frame, "doc_id", "text", listed).collect()
    return {r["doc_id"]: (r["first_pos"], r["phrases_hit"]) for r in rows}


def test_phrase_matches_equal_brute_force(spark):
    docs, phrases = corpus()
    wanted = brute_force(docs, phrases)
    assert matches(spark, docs, phrases) == wanted and len(wanted) > 100


def test_phrase_matches_without_broadcast(spark, monkeypatch):
    docs, phrases = corpus(3)
    monkeypatch.setattr(moderate, "MAX_BROADCAST_BYTES", 0)
    assert matches(spark, docs, phrases) == brute_force(docs, phrases)


def test_no_phrases(spark):
    assert matches(spark, [(1, "x")], [(0, "")]) == {}
    named = local_rows(spark, [("a", "x")], "doc_id STRING, text STRING")
    scrubbed = jobs.corpus_scrub(named, "doc_id", "text", local_rows(spark, [], "pos INT, phrase STRING"))
    assert [tuple(r) for r in scrubbed.collect()] == [("a", "x", None, None)]


def test_size_check(spark, sf_dir):
    """Only tables of driver values get a hint; nothing runs to find out."""
    def hinted(frame):
        return "ResolvedHint" in sizing.small_side(frame)._jdf.queryExecution().analyzed().toString()

    small = local_rows(spark, [(i, "x y") for i in range(50)], "a INT, b STRING")
    texts = sample_table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sizing", "size check")
    assert hinted(small) and hinted(small.where("a > 3"))
    assert not hinted(texts) and not hinted(texts.select("doc_id", F.explode("words")))
    assert not hinted(spark.range(10).groupBy("id").count())
    assert not hinted(local_rows(spark, [(1, "x")], "a INT, b STRING").join(texts, F.lit(True)))
    assert list(tracker.getJobIdsForGroup("sizing")) == []
    spark.sparkContext.setJobGroup("other", "")


def test_moderation_response(spark):
    answers = local_rows(spark, [(1, '{"result":"Bad Word here"}'), (2, '{"result":"","output":"bad word"}'), (3, "null")], "i INT, body STRING")
    rows = {r["i"]: r for r in moderate.moderate(answers, outputs.output_text(F.col("body")), ["BAD WORD"], code="blocked").collect()}
    assert rows[1]["response"].asDict(True) == {
        "status": 451, "code": "blocked", "message": "AI output blocked: banned phrase detected", "data": {"status": 451}}
    assert rows[2]["violation"] is None and rows[2]["response"] is None and rows[3]["response"] is None


def test_redaction_switch_and_custom_patterns(spark):
    docs = local_rows(spark, [(1, "id 7 mail a@b.co")], "doc_id BIGINT, text STRING")
    assert redact.redact_column(docs, "text", enabled=False).first()["text"] == "id 7 mail a@b.co"
    assert redact.redact_column(docs, "text", {"id$": r"\b\d\b"}).first()["text"] == "id [REDACTED:id$] mail a@b.co"


def test_scrub_looks_for_phrases_in_the_original(spark):
    docs = local_rows(spark, [(1, "write to a@b.co now"), (2, "fine")], "doc_id BIGINT, text STRING")
    phrases = local_rows(spark, [(0, "to a@b.co now")], "pos INT, phrase STRING")
    rows = {r["doc_id"]: (r["text"], r["first_pos"]) for r in jobs.corpus_scrub(docs, "doc_id", "text", phrases).collect()}
    assert rows == {1: ("write to [REDACTED:email] now", 0), 2: ("fine", None)}
