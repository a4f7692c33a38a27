import random
import re

import pytest
from pyspark.sql import functions as F

from govlake.functions import blocks, dates, money, outputs, pii, requests, templates, text
from govlake.policy import PII_PATTERNS


def one(spark, column, **values):
    """Evaluate a Column over one row of text values."""
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("out")).first()["out"]


def each(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i INT, v STRING")
    return [r["out"] for r in rows.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def python_redact(value):
    flags = {"email": re.IGNORECASE | re.ASCII}
    for label, pattern in PII_PATTERNS.items():
        value = re.sub(pattern, f"[REDACTED:{label}]", value, flags=flags.get(label, re.ASCII))
    return value


def test_redaction_cases(spark):
    cases = {
        "call (555) 123-4567": "call ([REDACTED:phone]",
        "+1-555-123-4567": "+[REDACTED:phone]",
        "é123-45-6789é": "é[REDACTED:ssn]é",
        "12345678901": "[REDACTED:phone]",
        "22345678901": "22345678901",
        "15551234567": "[REDACTED:phone]",
        "JOHN.DOE@EXAMPLE.COM": "[REDACTED:email]",
        "123-45-6789 and 555.123.4567": "[REDACTED:ssn] and [REDACTED:phone]",
        "a@b.co1x@d.com": "[REDACTED:email][REDACTED:email]",
        "": "",
    }
    assert each(spark, cases, pii.redact) == list(cases.values())


def test_redaction_equals_sequential_replacement_on_random_text(spark):
    rng = random.Random(5)
    alphabet = "ab1 2.3-4@(5)6+_é\n7809xC%"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert each(spark, texts, pii.redact) == [python_redact(t) for t in texts]


def test_redaction_of_a_long_run_stays_fast(spark):
    blob = "a" * 200_000
    assert each(spark, [blob + "@"], pii.redact) == [blob + "@"]


def test_bad_pattern_is_rejected_up_front(spark):
    with pytest.raises(Exception):
        pii.check_patterns(spark, {"bad": "("})


def test_provider_hosts(spark):
    uris = ["https://api.openai.com/v1", "https://acme.openai.azure.com/x", "https://API.OPENAI.COM/",
            "https://x.googleapis.com/", "not a uri", "", "https://llm.local:8080/v1"]
    assert each(spark, uris, requests.provider) == [
        "openai", "azure", "API.OPENAI.COM", "google", "", "", "llm.local"]


def test_tokens(spark):
    bodies = [
        '{"usage":{"prompt_tokens":5,"completion_tokens":7}}',
        '{"usage":{"input_tokens":"12","output_tokens":12.7}}',
        '{"usage":{"prompt_tokens":null,"input_tokens":4,"output_tokens":"x"}}',
        '{"usage":{"prompt_tokens":0,"input_tokens":9}}',
        'data: {"usage":1}', '{"usage":[1,2]}', '[]', '{"usageMetadata":{"promptTokenCount":8}}', None,
    ]
    got = [tuple(r) for r in each(spark, bodies, requests.tokens)]
    assert got == [(5, 7), (12, 12), (4, 0), (0, 0), (0, 0), (0, 0), (0, 0), (0, 0), (0, 0)]
    assert tuple(each(spark, bodies[7:8], lambda c: requests.tokens(c, True))[0]) == (8, 0)


def test_model(spark):
    assert each(spark, ['{"model":"m"}', "{}", "not json", '{"model":5}', None], requests.model) == ["m", "", "", "5", ""]


def test_routes_and_capabilities(spark):
    routes = ["/wp-abilities/v1/ai/title-generation/run", "/wp-abilities/v1/ai/running-notes/run",
              "/other/wp-abilities/v1/x", "/wp-abilities/v1/ai/x/describe"]
    assert each(spark, routes, requests.ability_of_route) == ["ai/title-generation", "ai", "/other/wp-abilities/v1/x", "ai/x"]
    caps = ["wp_ability_ai_title_generation", "wp_ability_ai_ai_x", "wp_ability_core_x"]
    assert each(spark, caps, requests.ability_of_capability) == ["ai/title-generation", "ai/ai-x", "core-x"]


def test_price_rounds_per_request(spark):
    price = money.price_micros(F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), F.lit("0.0025").cast("decimal(12,9)"))
    assert one(spark, price) == 3  # 2.5 micro-USD
    default = money.price_micros(F.lit(1000).cast("bigint"), F.lit(1000).cast("bigint"))
    assert one(spark, default) == 18_000
    huge = money.price_micros(F.lit(2**50).cast("bigint"), F.lit(2**50).cast("bigint"))
    assert one(spark, huge) == 2**50 * 18
    assert one(spark, money.price_micros(F.lit(-5).cast("bigint"), F.lit(0).cast("bigint"))) == -15
    half = money.price_micros(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"), F.lit("0.0025").cast("decimal(12,9)"))
    assert one(spark, half) == -3
    assert one(spark, money.price_micros(F.lit(None).cast("bigint"), F.lit(1000).cast("bigint"))) == 15_000
    with pytest.raises(Exception, match="OVERFLOW|OUT_OF_RANGE|overflow"):
        one(spark, money.price_micros(F.lit(2**62).cast("bigint"), F.lit(2**62).cast("bigint")))
    assert str(one(spark, money.usd(F.lit(1_234_567).cast("bigint")))) == "1.234567"


def test_output_text(spark):
    bodies = ['"bare"', '{"result":"","output":"full"}', '{"result":5,"text":"t"}', '{"result":{"text":"nested"}}',
              'not json', '{"content":"c","text":null}', '["a"]', None]
    assert each(spark, bodies, outputs.output_text) == ["bare", "", "t", "", "", "c", "", ""]


def test_banned_phrases(spark):
    texts = ["class act", "ÉCLAIR", "clean", "", None]
    got = each(spark, texts, lambda c: outputs.violation(c, ["", "ASS", "éclair"]))
    # the accented capital is not folded
    assert got == [outputs.VIOLATION, None, None, None, None]
    assert each(spark, ["x"], lambda c: outputs.violation(c, [""])) == [None]


def filled(spark, template, payload, **maps):
    entries = templates.folded_entries(F.create_map(*[F.lit(x) for kv in payload.items() for x in kv]))

    def lookup(key):
        return templates.entry_value(entries, key)

    return one(spark, templates.fill(templates.parse(F.lit(template)), lookup))


def test_interpolation(spark):
    payload = {"Tone": "{x} $1 \\", "x": "never", "a.b": "dot"}
    cases = {
        "{tone} {TONE}": "{x} $1 \\ {x} $1 \\",
        "{unknown} {a-b} {} {A.B}": "{unknown} {a-b} {} dot",
        "plain": "plain", "": "", "{x}": "never", "{{x}}": "{never}", "{x}{x}": "nevernever",
    }
    for template, wanted in cases.items():
        assert filled(spark, template, payload) == wanted
    assert filled(spark, "{k}", {"K": "first", "k": "last"}) == "last"


def test_combination_trims(spark):
    def combined(mode):
        return one(spark, templates.combine(F.lit(mode), F.lit(" \x0b\tbody\0\n"), F.lit(" T ")))

    assert combined("replace") == " T "
    assert combined("append") == " \x0b\tbody\n\n T "
    assert combined("prepend") == " T \n\nbody\0\n"
    assert one(spark, templates.with_preamble(F.lit(""), F.lit("x"))) == "x"
    assert one(spark, templates.with_preamble(F.lit("P"), F.lit("x"))) == "P\n\nx"


def test_block_names(spark):
    contents = [
        "plain text", "<!-- wp:paragraph -->\n<p>x</p>\n<!-- /wp:paragraph -->",
        '<!-- wp:group {"a":{"b":1}} --><!-- wp:acme/card /--><!-- wp:image {"id":7} /--><!-- /wp:group -->',
        "<!-- wp: -->", "",
    ]
    assert each(spark, contents, blocks.block_names) == [
        None, ["core/paragraph"], ["core/group", "acme/card", "core/image"], None, None]
    long = '<!-- wp:html {"t":"' + "x" * 100_000 + '"} /-->'
    assert each(spark, [long], blocks.block_names) == [["core/html"]]


def test_block_meta_keys(spark):
    keys = ["_guideline_block_core_paragraph", "_guideline_block_acme_card_wide", "_guideline_block_solo"]
    assert each(spark, keys, lambda c: blocks.block_of_meta_key(c, "_guideline_block_")) == [
        "core/paragraph", "acme/card_wide", "solo"]


def test_cutoff_overflows_into_the_next_month(spark):
    def cutoff(day, months):
        return one(spark, dates.cutoff_period(F.lit(day).cast("date"), months))

    assert cutoff("2025-03-31", 1) == "2025-03"
    assert cutoff("2025-03-28", 1) == "2025-02"
    assert cutoff("2025-01-31", 24) == "2023-01"


def test_lenient_numbers(spark):
    values = ["12", " 7x", "12.9", "-3", "1e3", "x", "", "true", None, "9007199254740993"]
    assert each(spark, values, text.lenient_bigint) == [12, 7, 12, -3, 1000, 0, 0, 1, None, 9007199254740993]


def test_ascii_fold_and_feature_key(spark):
    assert each(spark, ["ABCé", "ÀB", "İX"], text.ascii_fold) == ["abcé", "Àb", "İx"]
    assert each(spark, ["AI/Image-Gen!"], text.feature_key) == ["aiimage-gen"]
