"""SQL counterparts of the corpus queries, for those that SQL can express."""

from __future__ import annotations

from govlake.llm import decontaminate, merkle, quality_rules, variants

_WORD = r"[^\x20\x09-\x0D]+"


def _rule_sql(rule: quality_rules.Rule) -> str:
    whole = f"greatest({rule.whole}, 1)"
    bounds = [f"100 * {rule.part} >= {rule.low} * {whole}"] if rule.low is not None else []
    bounds += [f"100 * {rule.part} <= {rule.high} * {whole}"] if rule.high is not None else []
    return f"CASE WHEN NOT ({' AND '.join(bounds)}) THEN '{rule.name}' END"


_STOPS = ", ".join(f"'{word}'" for word in quality_rules.STOP_WORDS)
_RULES = ", ".join(_rule_sql(rule) for rule in quality_rules.RULES)

QUALITY_RULES = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
    SELECT *, regexp_extract_all(text, '{_WORD}') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
    FROM texts
), positions AS (
    SELECT row_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM split WHERE len(words) > 2
), windows AS (
    SELECT row_id, i, count(*) OVER (PARTITION BY row_id, words[i], words[i + 1], words[i + 2]) AS n FROM positions
), covered AS (
    SELECT row_id, count(DISTINCT i + step) AS n
    FROM windows, (VALUES (0), (1), (2)) AS steps(step) WHERE n > 1 GROUP BY row_id
), counts AS (
    SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           len(regexp_extract_all(text, '!'))::BIGINT AS n_marks,
           len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           len(list_filter(words, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words,
           coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM split LEFT JOIN covered USING (row_id)
), judged AS (
    SELECT *, n_words < {quality_rules.MIN_WORDS}
              OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED_PERCENT} * n_words AS base_failed,
           array_to_string(list_filter([{_RULES}], lambda x: x IS NOT NULL), ',') AS failed_rules
    FROM counts
)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM judged
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce({_PLAIN}, []) AS words FROM documents
), items AS (
    SELECT item_id, {_PLAIN} AS words, least({decontaminate.WINDOW}, len({_PLAIN})) AS m FROM benchmark WHERE len({_PLAIN}) > 0
), item_starts AS (
    SELECT item_id, words, m, unnest(generate_series(1, len(words) - m + 1)) AS i FROM items
), windows AS (
    SELECT DISTINCT item_id, m, array_to_string(words[i:i + m - 1], ' ') AS w FROM item_starts
), lengths AS (
    SELECT DISTINCT m FROM windows
), doc_starts AS (
    SELECT row_id, words, m, unnest(generate_series(1, len(words) - m + 1)) AS i FROM docs, lengths WHERE len(words) >= m
), found AS (
    SELECT d.row_id, d.i, d.m, w.item_id
    FROM (SELECT row_id, i, m, array_to_string(words[i:i + m - 1], ' ') AS w FROM doc_starts) d
    JOIN windows w ON w.m = d.m AND w.w = d.w
), hit AS (
    SELECT row_id, count(*) AS n FROM (
        SELECT DISTINCT row_id, unnest(generate_series(i, i + m - 1)) AS place FROM found
    ) GROUP BY row_id
), listed AS (
    SELECT row_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY row_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit,
       coalesce(listed.n, 0)::BIGINT AS n_items, sha256(coalesce(listed.ids, '')) AS items_sha256,
       hit.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (row_id) LEFT JOIN listed USING (row_id)
"""

TOOL_CALLS = """
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), assistant AS (
    SELECT conv_id, concat(conv_id, '-', turn) AS call_id, turn, (conv_id + turn) % 5 AS kind, text,
           length(text) % 17 = 0 AS broken, concat(conv_id, '-', turn - 2) AS needs
    FROM turns WHERE role = 'assistant'
), forms AS (
    SELECT conv_id, call_id, turn, broken,
           CASE kind WHEN 0 THEN 'search' WHEN 1 THEN 'summarise' WHEN 2 THEN 'translate' WHEN 3 THEN 'search'
                     ELSE 'summarise' END AS name,
           CASE kind WHEN 0 THEN concat('{"limit":', turn, ',"query":', to_json(text), '}')
                     WHEN 1 THEN concat('{"max_words":', length(text), ',"text":', to_json(text), '}')
                     WHEN 2 THEN concat('{"text":', to_json(text), ',"to":"fr"}')
                     WHEN 3 THEN concat('{"limit":"', turn, '","query":', to_json(text), '}')
                     ELSE concat('{"max_words":5,"note":', to_json(text), '}') END AS arguments,
           CASE WHEN broken THEN 'not_json' WHEN kind = 3 THEN 'type:limit' WHEN kind = 4 THEN 'missing:text,unknown:note'
                ELSE '' END AS errors,
           CASE kind WHEN 2 THEN concat('["', needs, '","', call_id, '-first"]') ELSE concat('["', needs, '"]') END AS needs,
           CASE kind WHEN 2 THEN 1 ELSE 0 END AS hops
    FROM assistant
    UNION ALL
    SELECT conv_id, concat(call_id, '-first'), turn, false, 'look', '{}', 'unknown_tool', '[]', 0 FROM assistant WHERE kind = 2
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, hops, call_id) - 1 AS position FROM forms
), results AS (
    SELECT conv_id, concat(conv_id, '-', turn - 1) AS call_id, turn AS result_turn, text AS content
    FROM turns WHERE role = 'user' AND turn > 0
)
SELECT conv_id, call_id, o.turn, r.result_turn, o.name, o.hops, o.position,
       CASE WHEN o.turn IS NULL THEN 'orphan' WHEN r.result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       (o.turn IS NOT NULL)::BIGINT AS n_calls, (r.result_turn IS NOT NULL)::BIGINT AS n_results,
       o.errors = '' AS valid, o.errors,
       concat('{', array_to_string(list_filter([
           CASE WHEN NOT o.broken THEN concat('"arguments":', o.arguments) END,
           CASE WHEN o.turn IS NOT NULL THEN concat('"depends_on":', o.needs) END,
           concat('"id":', to_json(call_id)),
           CASE WHEN o.turn IS NOT NULL THEN concat('"name":', to_json(o.name)) END,
           CASE WHEN r.result_turn IS NOT NULL THEN concat('"result":', to_json(r.content)) END
       ], lambda x: x IS NOT NULL), ','), '}') AS line
FROM ordered o FULL JOIN results r USING (conv_id, call_id)
"""

# CRC-32, which DuckDB lacks, over a list of bytes; the reflected polynomial in decimal.
def _crc32(of_bytes: str) -> str:
    shifted = "list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, step: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], {of_bytes}), lambda crc, byte: {shifted}), 4294967295)"


def _merkle_field(name: str) -> str:
    return f"coalesce(concat(strlen({name}::VARCHAR), ':', {name}::VARCHAR), '-')"


_MERKLE_FIELDS = [_merkle_field(name) for name in merkle.FIELDS]
_CLAIMED_FIELDS = [_merkle_field(f) for f in merkle.FIELDS[:-1]] + [_merkle_field(_LOWER)]

MERKLE = f"""
WITH RECURSIVE leaves AS (
    SELECT *, sha256(concat({", ".join(_MERKLE_FIELDS)})) AS leaf,
           CASE WHEN {_crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} % 3 = 0
                THEN sha256(concat({", ".join(_CLAIMED_FIELDS)})) END AS claimed
    FROM documents
), placed AS (
    SELECT row_number() OVER () AS row_id, *, coalesce('=' || lang, '') AS tree,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
           count(*) OVER (PARTITION BY lang) AS n
    FROM leaves
), nodes AS (
    SELECT tree, 0 AS level, idx, n, leaf AS hash FROM placed
    UNION ALL
    SELECT tree, level + 1, idx // 8, any_value((n + 7) // 8), sha256(string_agg(hash, '' ORDER BY idx))
    FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8
), crown AS (
    SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, hash, tree
    FROM nodes WHERE n = 1
    UNION ALL
    SELECT level + 1, idx // 8, any_value((n + 7) // 8), sha256(string_agg(hash, '' ORDER BY idx)), ''
    FROM crown WHERE n > 1 GROUP BY level, idx // 8
), steps AS (
    SELECT p.row_id, n.level, n.idx, n.hash, n.idx = p.idx // (8 ** n.level)::BIGINT AS own
    FROM placed p JOIN nodes n ON n.tree = p.tree AND n.n > 1 AND n.idx // 8 = p.idx // (8 ** (n.level + 1))::BIGINT
    UNION ALL
    SELECT p.row_id, 1000 + c.level, c.idx, c.hash, c.idx = t.idx // (8 ** c.level)::BIGINT
    FROM placed p JOIN crown t ON t.level = 0 AND t.tree = p.tree
    JOIN crown c ON c.n > 1 AND c.idx // 8 = t.idx // (8 ** (c.level + 1))::BIGINT
), sides AS (
    SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY level) AS step,
           coalesce(string_agg(hash, '' ORDER BY idx) FILTER (own_idx > idx), '') AS l,
           coalesce(string_agg(hash, '' ORDER BY idx) FILTER (own_idx < idx), '') AS r
    FROM (SELECT *, max(idx) FILTER (own) OVER (PARTITION BY row_id, level) AS own_idx FROM steps) GROUP BY row_id, level
), folded AS (
    SELECT row_id, 0::BIGINT AS step, coalesce(claimed, leaf) AS hash FROM placed
    UNION ALL
    SELECT f.row_id, s.step, sha256(concat(s.l, f.hash, s.r)) FROM folded f JOIN sides s ON s.row_id = f.row_id AND s.step = f.step + 1
), proof AS (
    SELECT row_id, string_agg(l || r, '' ORDER BY step) AS all_siblings FROM sides GROUP BY row_id
), ends AS (
    SELECT row_id, arg_max(hash, step) AS folded_root FROM folded GROUP BY row_id
)
SELECT doc_id, leaf, s.hash AS subroot, c.hash AS root, sha256(coalesce(all_siblings, '')) AS proof_sha256, folded_root,
       folded_root = c.hash AS verified
FROM placed p JOIN ends USING (row_id) LEFT JOIN proof USING (row_id)
JOIN nodes s ON s.tree = p.tree AND s.n = 1 JOIN crown c ON c.n = 1
"""

_BYTES = "flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END))"
_LOWER_RUN = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# One of two near words lacks a letter of the other, or both are equal without one letter at the same place.
SPELLING_VARIANTS = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, {_LOWER_RUN} AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{variants.LETTERS}]+')) AS run FROM documents)
    WHERE length(run) >= {variants.MIN_LETTERS} GROUP BY ALL
), checked AS (
    SELECT *, {_crc32(_BYTES)} AS h FROM runs
), counted AS (
    SELECT CASE WHEN h % {variants.DROP_EVERY} = 0
                THEN concat(run[1:(h % length(run))], run[(h % length(run)) + 2:]) ELSE run END AS word, sum(n)::BIGINT AS n
    FROM checked GROUP BY word
), words AS (
    SELECT * FROM counted WHERE length(word) >= {variants.MIN_LETTERS} AND n >= {variants.MIN_COUNT}
), cut AS (
    SELECT word, n, 0 AS i, word AS spelling FROM words
    UNION ALL
    SELECT word, n, i, concat(word[1:i - 1], word[i + 1:]) FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)
), near AS (
    SELECT DISTINCT a.word, b.word AS near, b.n AS near_n
    FROM cut a JOIN cut b ON a.spelling = b.spelling AND a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)
), best AS (
    SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near,
           CASE WHEN near_n >= {variants.RATIO} * w.n THEN near END AS form,
           CASE WHEN near_n >= {variants.RATIO} * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN best USING (word)
), led AS (
    SELECT word, word AS root, 0 AS hops FROM formed
    UNION ALL
    SELECT led.word, f.form, hops + 1 FROM led JOIN formed f ON f.word = led.root WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, hops) AS root FROM led GROUP BY word) USING (word)
"""

ORACLE_SQL = {
    "op3_quality_rules": QUALITY_RULES,
    "op7_decontamination": DECONTAMINATION,
    "op10_tool_calls": TOOL_CALLS,
    "op11_merkle_manifest": MERKLE,
    "op12_spelling_variants": SPELLING_VARIANTS,
}
