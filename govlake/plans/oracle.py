"""SQL counterpart of every catalogue query, for checking on another engine.

The statements are written on their own against the sample tables; they share no
expression with the Spark code.
"""

from __future__ import annotations

# Fixed values, here and below: ability ids and labels, patterns, limits and the wording of messages and
# guidelines, which have to equal those of the rules.
_ABILITY = """(['ai/title-generation','ai/excerpt-generation','ai/meta-description','ai/summarization',
 'ai/content-classification','ai/content-resizing','ai/comment-moderation','ai/alt-text-generation',
 'ai/image-generation','ai/image-prompt-generation','ai/editorial-notes','ai/editorial-updates'])"""
_LABEL = """(['Title generation','Excerpt generation','Meta description','Summarization','Content classification',
 'Content resizing','Comment moderation','Image alt text','Image generation','Image prompt generation',
 'Editorial notes','Editorial updates'])"""
_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Common table expressions, in dependency order.
_CTES = {
    "ev": """SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        CASE WHEN event_id % 2 = 0 THEN 0 ELSE CAST(floor(event_id / 2.0) AS BIGINT) % 12 END AS aix FROM events""",
    "abilities": f"""SELECT CAST(i AS INTEGER) AS pos, {_ABILITY}[i + 1] AS ability_id, {_LABEL}[i + 1] AS label
        FROM range(12) t(i)""",
    "ex": f"""SELECT event_id AS request_id, ts, user_id, k, {_ABILITY}[aix + 1] AS ability_id,
        CASE k % 5 WHEN 0 THEN 'https://api.openai.com/v1/responses' WHEN 1 THEN 'https://api.anthropic.com/v1/messages'
          WHEN 2 THEN 'https://generativelanguage.googleapis.com/v1/models'
          WHEN 3 THEN 'https://acme.openai.azure.com/openai/v1' ELSE 'https://llm.internal.example/v1' END AS uri,
        CASE WHEN k % 25 = 24 THEN 'not json' WHEN k % 5 = 3 THEN '{{}}'
          ELSE '{{"model":"m-' || CAST(k % 3 AS VARCHAR) || '"}}' END AS request_body,
        CAST(floor(value * 10) AS BIGINT) AS sent, CAST(floor(value * 2) AS BIGINT) AS got, event_type FROM ev""",
    "rq": """SELECT request_id, ts, user_id, ability_id,
        CASE WHEN contains(uri, 'openai.com') THEN 'openai' WHEN contains(uri, 'anthropic.com') THEN 'anthropic'
          WHEN contains(uri, 'googleapis.com') THEN 'google' WHEN contains(uri, 'azure.com') THEN 'azure'
          ELSE regexp_extract(uri, '^https://([^/]+)/', 1) END AS provider,
        CASE WHEN json_valid(request_body) THEN coalesce(json_extract_string(request_body, '$.model'), '') ELSE '' END AS model,
        CAST(k * 7 AS BIGINT) AS duration_ms,
        CASE WHEN event_type = 'error' OR k % 5 = 2 THEN 0 ELSE sent END AS tokens_input,
        CASE WHEN event_type = 'error' OR k % 5 = 2 THEN 0 ELSE got END AS tokens_output,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
        CASE WHEN event_type = 'error' THEN 'timeout' END AS error_message, uri FROM ex""",
    "prices": """SELECT * FROM (VALUES ('openai', 'm-1', CAST(0.0025 AS DECIMAL(12,9)), CAST(0.010 AS DECIMAL(12,9))),
        ('anthropic', 'm-0', CAST(0.00075 AS DECIMAL(12,9)), CAST(0.0055 AS DECIMAL(12,9)))) p(provider, model, ri, ro)""",
    "cost": """SELECT rq.*, strftime(ts, '%Y-%m') AS period, CASE WHEN status = 'success' THEN
        CAST(round((tokens_input * coalesce(ri, CAST(0.003 AS DECIMAL(12,9))) + tokens_output * coalesce(ro, CAST(0.015 AS DECIMAL(12,9))))
          * 1000, 0) AS BIGINT) ELSE 0 END AS micros
        FROM rq LEFT JOIN prices USING (provider, model)""",
    "usage": """SELECT user_id, period, provider, model, count(*) AS requests, CAST(sum(tokens_input) AS BIGINT) AS tokens_in,
        CAST(sum(tokens_output) AS BIGINT) AS tokens_out, CAST(sum(micros) AS BIGINT) AS micros, max(ts) AS updated_at
        FROM cost WHERE status = 'success' GROUP BY ALL""",
    "by_user": """SELECT user_id, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
        CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(micros) AS DOUBLE) / 1e6 AS usd_spent
        FROM usage WHERE period = '2024-01' GROUP BY user_id""",
    "aged": """SELECT user_id, strftime(CAST(period || '-01' AS DATE) - to_months(CAST(user_id % 25 AS INTEGER)), '%Y-%m') AS period,
        provider, model, requests, micros FROM usage""",
    "users": """SELECT DISTINCT user_id, 'user' || user_id AS user_login, user_id % 5 = 0 AS manage_options,
        list_concat([(['administrator','editor','author','contributor','subscriber'])[user_id % 5 + 1]],
          CASE WHEN user_id % 10 = 3 THEN ['editor'] ELSE [] END) AS roles FROM events""",
    "calls": f"""SELECT event_id AS request_id, ts, user_id, user_id % 40 AS site_id, {_ABILITY}[aix + 1] AS ability_id,
        CAST(floor(event_id / 8.0) AS BIGINT) AS post_id, '{{ability}} $1 ' || event_type AS tone FROM ev""",
    "running": """SELECT *, sum(micros) OVER (PARTITION BY user_id, period ORDER BY ts, request_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent_before
        FROM (SELECT cost.*, manage_options FROM cost JOIN users USING (user_id))""",
    "edits": f"""SELECT event_id AS edit_id, {_ABILITY}[user_id % 12 + 1] AS ability_id,
        CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS action,
        CASE k % 4 WHEN 1 THEN 'append' WHEN 2 THEN 'replace' ELSE 'prepend' END AS mode,
        'T' || event_id || ' ' || CASE event_id % 3 WHEN 0 THEN '{{post_title}} {{unknown}} {{current_date}}'
          WHEN 1 THEN '{{TONE}} as {{user_role}}: {{guidelines_copy}}'
          ELSE '{{ability}} by {{User_Login}} for {{site_name}} {{a-b}}' END AS template,
        user_id AS updated_by, ts AS updated_at FROM ev""",
    "live": """SELECT ability_id, mode, template, updated_by, updated_at FROM
        (SELECT *, row_number() OVER (PARTITION BY ability_id ORDER BY edit_id DESC) AS n FROM edits)
        WHERE n = 1 AND action = 'put'""",
    "audit": """SELECT edit_id, ability_id, action, CASE WHEN action = 'delete' THEN old_mode ELSE mode END AS mode,
        CASE WHEN action = 'delete' THEN old_template ELSE template END AS template, updated_by, updated_at FROM
        (SELECT *, lag(action) OVER w AS old_action, lag(mode) OVER w AS old_mode, lag(template) OVER w AS old_template
         FROM edits WINDOW w AS (PARTITION BY ability_id ORDER BY edit_id))
        WHERE action = 'put' OR old_action = 'put'""",
    "outputs": """SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN '' ELSE text END AS answer
        FROM conversations WHERE role = 'assistant'""",
    "moderated": f"""SELECT *, CASE WHEN contains(low, 'erblest') OR contains(low, 'ouche') OR contains(low, 'tion de')
          OR contains(low, 'never said') THEN 'banned phrase detected' END AS violation
        FROM (SELECT *, {_LOWER.format('answer')} AS low FROM outputs)""",
    "hits": """SELECT doc_id, item_id FROM documents, benchmark
        WHERE benchmark.text <> '' AND contains({0}, {1})""".format(
            _LOWER.format("documents.text"), _LOWER.format("benchmark.text")),
    "redacted": r"""SELECT *, regexp_replace(s, '\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b', '[REDACTED:phone]', 'g') AS p
        FROM (SELECT *, regexp_replace(e, '\b\d{3}-\d{2}-\d{4}\b', '[REDACTED:ssn]', 'g') AS s
        FROM (SELECT *, regexp_replace(text, '[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}', '[REDACTED:email]', 'gi') AS e
        FROM documents))""",
    "posts": """SELECT doc_id AS post_id, doc_id % 40 AS site_id, 'On ' || md5(text) AS post_title,
        CASE doc_id % 2 WHEN 0 THEN 'post' ELSE 'page' END AS post_type,
        CASE doc_id % 3 WHEN 0 THEN 'draft' ELSE 'publish' END AS post_status,
        CASE doc_id % 4 WHEN 1 THEN ['core/paragraph'] WHEN 2 THEN ['core/group', 'core/paragraph', 'core/image']
          WHEN 3 THEN ['acme/card'] END AS blocks FROM documents""",
    "gposts": """SELECT doc_id AS post_id, doc_id % 40 AS site_id,
        CASE doc_id % 7 WHEN 6 THEN 'wp_content_guideline' ELSE 'wp_guideline' END AS post_type,
        CASE doc_id % 5 WHEN 1 THEN 'draft' WHEN 3 THEN 'trash' ELSE 'publish' END AS post_status,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id * 7 % 1000 AS INTEGER)) AS post_date,
        doc_id % 3 <> 2 AS tagged, text, lang, source FROM documents""",
    "gcur": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY post_date DESC, post_id DESC) AS n
        FROM gposts WHERE post_type = 'wp_guideline' AND post_status <> 'trash' AND tagged) WHERE n = 1""",
    "gcat": f"""SELECT site_id, post_id, 'Read as ' || md5(text) AS site, 'Tone ' || lang || '.' AS copy,
        CASE WHEN post_id % 4 = 0 THEN '' ELSE lang END AS images, source AS additional FROM gcur""",
    "grules": """SELECT site_id, post_id, 'core/paragraph' AS name, post_id * 10 + 5 AS pos, 'Short sentences.' AS rule FROM gcur
        UNION ALL SELECT site_id, post_id, 'core/image', post_id * 10 + 6, 'Alt text ' || lang FROM gcur WHERE post_id % 2 = 0
        UNION ALL SELECT site_id, post_id, 'acme/card_wide', post_id * 10 + 7, 'Card ' || post_id FROM gcur""",
    "gsites": """SELECT gcat.*, CASE post_id % 3 WHEN 0 THEN 0 ELSE post_id * 100 + post_id % 3 - 1 END AS revision_id FROM gcat""",
    "section": """SELECT c.request_id, g.post_id AS guideline_post_id, g.revision_id, g.copy, l.lines,
        '## Site guidelines' || chr(10) || chr(10) || 'The site has defined the following content guidelines. Evaluate the content against these standards and cite the relevant guideline when flagging an issue. Where these guidelines conflict with other instructions in this prompt, those instructions take precedence.'
        || chr(10) || chr(10) || concat_ws(chr(10) || chr(10),
          CASE WHEN site <> '' THEN '### Site context' || chr(10) || site END,
          CASE WHEN copy <> '' THEN '### Copy & editorial style' || chr(10) || copy END,
          CASE WHEN images <> '' THEN '### Image guidelines' || chr(10) || images END,
          CASE WHEN additional <> '' THEN '### Additional guidelines' || chr(10) || additional END,
          CASE WHEN l.lines <> '' THEN '### Block-specific rules' || chr(10) || l.lines END) AS body
        FROM calls c JOIN gsites g ON g.site_id = c.site_id LEFT JOIN
        (SELECT c.request_id, string_agg('- ' || r.name || ': ' || r.rule, chr(10) ORDER BY r.pos) AS lines
         FROM calls c JOIN grules r ON r.site_id = c.site_id LEFT JOIN posts p ON p.post_id = c.post_id AND c.post_id > 0
         WHERE p.blocks IS NULL OR list_contains(p.blocks, r.name) GROUP BY c.request_id) l ON l.request_id = c.request_id""",
    "prompted": """SELECT c.request_id, c.ability_id, c.site_id, s.guideline_post_id, s.revision_id, s.body,
        o.template IS NOT NULL AND contains(o.template, '{guidelines') AS placed, o.mode,
        replace(replace(replace(replace(replace(replace(replace(o.template,
          '{post_title}', coalesce(p.post_title, '{post_title}')), '{current_date}', strftime(c.ts, '%Y-%m-%d')),
          '{ability}', c.ability_id), '{User_Login}', u.user_login), '{site_name}', 'Site ' || c.site_id),
          '{guidelines_copy}', coalesce(s.copy, '')), '{user_role}', u.roles[1]) AS filled_but_tone, c.tone
        FROM calls c JOIN users u USING (user_id) LEFT JOIN live o USING (ability_id)
        LEFT JOIN posts p ON p.post_id = c.post_id AND c.post_id > 0 LEFT JOIN section s ON s.request_id = c.request_id""",
    "filled": """SELECT *, replace(filled_but_tone, '{TONE}', tone) AS filled FROM prompted""",
    "overridden": """SELECT *, CASE WHEN ability_id <> 'ai/meta-description' THEN 'Be brief.' || chr(10) || chr(10) ELSE '' END
        || CASE WHEN filled IS NULL THEN ' ' || chr(9) || 'Default for ' || ability_id || '.' || chr(10) || ' '
          WHEN mode = 'replace' THEN filled
          WHEN mode = 'append' THEN ' ' || chr(9) || 'Default for ' || ability_id || '.' || chr(10) || chr(10) || filled
          ELSE filled || chr(10) || chr(10) || 'Default for ' || ability_id || '.' || chr(10) || ' ' END AS base,
        body IS NOT NULL AND (placed OR ability_id IN ('ai/editorial-notes', 'ai/editorial-updates')) AS applied FROM filled""",
    "numbered": """SELECT request_id, user_id, ability_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS t,
        row_number() OVER (PARTITION BY user_id, ability_id ORDER BY ts, request_id) AS n FROM rq""",
    "walk": """SELECT request_id, user_id, ability_id, n, t, 'allowed' AS rate_decision,
          1 AS c1, t + 3600 AS e1, 1 AS c2, t + 86400 AS e2 FROM numbered WHERE n = 1
        UNION ALL SELECT request_id, user_id, ability_id, n, t,
          CASE WHEN l1 >= 1 THEN 'hour' WHEN l2 >= 2 THEN 'day' ELSE 'allowed' END,
          CASE WHEN l1 >= 1 THEN l1 ELSE l1 + 1 END, CASE WHEN l1 >= 1 THEN e1 ELSE t + 3600 END,
          CASE WHEN l1 >= 1 OR l2 >= 2 THEN l2 ELSE l2 + 1 END, CASE WHEN l1 >= 1 OR l2 >= 2 THEN e2 ELSE t + 86400 END
        FROM (SELECT b.request_id, b.user_id, b.ability_id, b.n, b.t, CASE WHEN b.t >= e1 THEN 0 ELSE c1 END AS l1, e1,
                CASE WHEN b.t >= e2 THEN 0 ELSE c2 END AS l2, e2
              FROM walk a JOIN numbered b ON b.user_id = a.user_id AND b.ability_id = a.ability_id AND b.n = a.n + 1)""",
    "shared": """SELECT request_id, ability_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS t,
        row_number() OVER (PARTITION BY ability_id ORDER BY ts, request_id) AS n FROM rq""",
    "shared_walk": """SELECT request_id, ability_id, n, t, 'allowed' AS rate_decision,
          1 AS c1, t + 3600 AS e1, 1 AS c2, t + 86400 AS e2 FROM shared WHERE n = 1
        UNION ALL SELECT request_id, ability_id, n, t,
          CASE WHEN l1 >= 3 THEN 'hour' WHEN l2 >= 20 THEN 'day' ELSE 'allowed' END,
          CASE WHEN l1 >= 3 THEN l1 ELSE l1 + 1 END, CASE WHEN l1 >= 3 THEN e1 ELSE t + 3600 END,
          CASE WHEN l1 >= 3 OR l2 >= 20 THEN l2 ELSE l2 + 1 END, CASE WHEN l1 >= 3 OR l2 >= 20 THEN e2 ELSE t + 86400 END
        FROM (SELECT b.request_id, b.ability_id, b.n, b.t, CASE WHEN b.t >= e1 THEN 0 ELSE c1 END AS l1, e1,
                CASE WHEN b.t >= e2 THEN 0 ELSE c2 END AS l2, e2
              FROM shared_walk a JOIN shared b ON b.ability_id = a.ability_id AND b.n = a.n + 1)""",
    "gates": """SELECT w.request_id, w.user_id, w.ability_id, w.rate_decision, c.ts, c.period, c.status, c.micros, u.manage_options,
        CASE w.ability_id WHEN 'ai/comment-moderation' THEN list_has_any(u.roles, ['administrator', 'editor'])
          WHEN 'ai/image-generation' THEN list_has_any(u.roles, ['administrator', 'editor'])
          WHEN 'ai/title-generation' THEN list_has_any(u.roles, ['administrator', 'editor', 'author'])
          WHEN 'ai/editorial-notes' THEN false ELSE true END AS granted
        FROM walk w JOIN cost c USING (request_id) JOIN users u ON u.user_id = w.user_id""",
    "budgeted": """SELECT *, NOT manage_options AND coalesce(sum(CASE WHEN rate_decision = 'allowed' AND granted THEN micros ELSE 0 END)
          OVER (PARTITION BY user_id, period ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          >= 50000 AS over_budget FROM gates""",
    "options": """SELECT user_id AS site_id, (['preamble','rate_limits','monthly_user_cap','log_retention_days','model_allowlist',
        'disabled_features','banned_phrases','redact_pii','use_guidelines','vault_enabled'])[event_id % 10 + 1] AS key,
        CAST(k AS VARCHAR) AS value, event_id AS version FROM ev""",
    "registered": """SELECT site_id, ability_id, min(event_id) AS pos, arg_max({'label': label, 'd': description, 'i': instruction}, event_id) AS x
        FROM (SELECT user_id AS site_id, 'ai/' || event_type AS ability_id, event_id,
          CASE WHEN event_id % 4 <> 0 THEN upper(event_type[1]) || event_type[2:] || ' ' || event_id END AS label,
          CASE WHEN event_id % 5 <> 0 THEN 'Version ' || event_id END AS description,
          CASE WHEN event_id % 3 <> 0 THEN 'Do ' || event_id END AS instruction FROM events WHERE user_id % 3 <> 0) GROUP BY ALL""",
    "sites": """SELECT DISTINCT user_id AS site_id FROM events UNION SELECT DISTINCT doc_id % 40 FROM documents""",
    "kinds": """SELECT *, CASE ability_id WHEN 'ai/image-generation' THEN 'image' WHEN 'ai/alt-text-generation' THEN 'vision'
        ELSE 'text' END AS capability FROM rq""",
    "allowlist": """SELECT * FROM (VALUES ('text', 'openai', 'm-0'), ('text', 'anthropic', 'm-1'), ('text', 'google', 'm-2'),
        ('vision', 'openai', 'm-1')) a(capability, provider, model)""",
    "slots": """SELECT user_id, period, CAST(floor(epoch_us(ts) / 60000000.0) AS BIGINT) * 60000000 AS slot, sum(micros_list) AS s
        FROM (SELECT rq.*, strftime(ts, '%Y-%m') AS period, tokens_input * 3 + tokens_output * 15 AS micros_list
              FROM rq WHERE status = 'success') WHERE micros_list > 0 GROUP BY ALL""",
}


def _sql(*names: str, body: str) -> str:
    """A statement with just the common table expressions it needs."""
    text = body
    needed: list[str] = []
    for name in reversed(list(_CTES)):
        uses = f" {name} " in f" {text} " or any(
            f"{lead} {name}" in " ".join(text.split()) for lead in ("FROM", "JOIN"))
        if name in names or uses:
            needed.insert(0, name)
            text += " " + _CTES[name]
    recursive = "RECURSIVE " if {"walk", "shared_walk"} & {*needed} else ""
    return f"WITH {recursive}" + ", ".join(f"{n} AS ({_CTES[n]})" for n in needed) + " " + body if needed else body


ORACLE_SQL = {
    "shape_requests": _sql(body="SELECT * REPLACE (epoch_us(ts) AS ts) FROM rq"),
    "route_ability": _sql(body="""SELECT a AS ability_id, count(*) AS requests FROM (SELECT CASE request_id % 6
          WHEN 0 THEN 'ai' WHEN 2 THEN '/other/wp-abilities/v1/' || ability_id WHEN 3 THEN NULL ELSE ability_id END AS a
          FROM rq) WHERE a IS NOT NULL GROUP BY 1"""),
    "request_cost": _sql(body="SELECT request_id, user_id, period, provider, model, status, micros / 1e6 AS usd_spent FROM cost"),
    "usage_rollup": _sql(body="""SELECT user_id, period, provider, model, requests, tokens_in, tokens_out,
        micros / 1e6 AS usd_spent, epoch_us(updated_at) AS updated_us FROM usage"""),
    "usage_by_user": _sql(body="SELECT * FROM by_user ORDER BY usd_spent DESC, user_id"),
    "top_spenders": _sql(body="SELECT * FROM by_user ORDER BY usd_spent DESC, user_id LIMIT 20"),
    "usage_subtotals": _sql(body="""SELECT period, provider, model, CAST(grouping(period, provider, model) AS BIGINT) AS level,
        CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(tokens_in) AS BIGINT) AS tokens_in,
        CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(micros) AS DOUBLE) / 1e6 AS usd_spent
        FROM usage GROUP BY ROLLUP (period, provider, model)"""),
    "usage_retained": _sql(body="""SELECT user_id, period, provider, model, requests, micros / 1e6 AS usd_spent
        FROM aged WHERE period >= '2023-07'"""),
    "usage_swept": _sql(body="SELECT '2023-07' AS cutoff, count(*) AS removed FROM aged WHERE period < '2023-07'"),
    "requests_deduped": _sql(body="SELECT request_id, user_id, ability_id, status, epoch_us(ts) AS ts_us FROM rq"),
    "unknown_abilities": _sql(body="""SELECT ability_id || 's' AS ability_id, count(*) AS calls FROM calls
        WHERE request_id % 9 = 0 GROUP BY 1"""),
    "log_retained": _sql(body="""SELECT request_id, epoch_us(ts) AS ts_us FROM rq
        WHERE ts >= TIMESTAMP '2024-01-18 00:00:00'"""),
    "over_budget_users": _sql(body="""SELECT user_id, period, CAST(sum(micros) AS DOUBLE) / 1e6 AS usd_spent FROM usage
        GROUP BY ALL HAVING sum(micros) >= 100000"""),
    "budget_gate": _sql(body="""SELECT c.request_id, c.user_id,
        CASE WHEN c.request_id % 10 = 0 THEN 'edit_posts' ELSE 'wp_ability_' || replace(replace(c.ability_id, '/', '_'), '-', '_') END AS capability,
        c.request_id % 10 = 0 OR u.manage_options OR coalesce(s.spent, 0) < 100000 AS granted
        FROM calls c JOIN users u USING (user_id) LEFT JOIN
        (SELECT user_id, sum(micros) AS spent FROM usage WHERE period = '2024-01' GROUP BY 1) s USING (user_id)"""),
    "budget_crossings": _sql(body="""SELECT user_id, period, epoch_us(ts) AS crossed_us, request_id AS crossing_id,
        CAST(coalesce(spent_before, 0) + micros AS DOUBLE) / 1e6 AS usd_spent FROM running WHERE NOT manage_options
        AND coalesce(spent_before, 0) < 100000 AND coalesce(spent_before, 0) + micros >= 100000"""),
    "budget_replay": _sql(body="""SELECT request_id, user_id, micros / 1e6 AS usd_spent,
        NOT manage_options AND coalesce(spent_before, 0) >= 100000 AS over_budget FROM running"""),
    "rate_limit_replay": _sql("numbered", body="""SELECT request_id, user_id, ability_id, rate_decision, CASE rate_decision
        WHEN 'hour' THEN 'AI rate limit exceeded (1 per hour).' WHEN 'day' THEN 'AI rate limit exceeded (2 per day).' END AS message
        FROM walk"""),
    "rate_limit_shared": _sql("shared", body="SELECT request_id, ability_id, rate_decision FROM shared_walk"),
    "window_counts": _sql(body="""SELECT user_id, ability_id, epoch_us(date_trunc('hour', ts)) AS window_us, count(*) AS requests,
        count(*) > 1 AS exceeded FROM rq GROUP BY 1, 2, 3"""),
    "role_gate": _sql(body="""SELECT request_id, user_id, capability, CASE WHEN request_id % 10 <> 0 THEN ability_id END AS ability_id,
        CASE WHEN request_id % 10 = 0 THEN request_id % 4 <> 0
          WHEN ability_id IN ('ai/comment-moderation', 'ai/image-generation') THEN list_has_any(roles, ['administrator', 'editor'])
          WHEN ability_id = 'ai/title-generation' THEN list_has_any(roles, ['administrator', 'editor', 'author'])
          WHEN ability_id = 'ai/editorial-notes' THEN false ELSE request_id % 4 <> 0 END AS granted
        FROM (SELECT c.*, u.roles, CASE WHEN c.request_id % 10 = 0 THEN 'edit_posts'
          ELSE 'wp_ability_' || replace(replace(c.ability_id, '/', '_'), '-', '_') END AS capability
          FROM calls c JOIN users u USING (user_id))"""),
    "enabled_features": _sql(body="""SELECT ability_id AS feature_id, count(*) AS calls FROM calls
        WHERE regexp_replace(lower(ability_id), '[^a-z0-9_-]', '', 'g') NOT IN ('aiimage-generation', 'aisummarization') GROUP BY 1"""),
    "allowed_models": _sql(body="""SELECT user_id, k.capability, k.provider, k.model, min(request_id) AS pos FROM kinds k
        WHERE k.capability = 'image' OR EXISTS (SELECT 1 FROM allowlist a WHERE a.capability = k.capability
          AND a.provider = k.provider AND a.model = k.model) GROUP BY ALL"""),
    "allowlist_violations": _sql(body="""SELECT request_id, user_id, k.capability, k.provider, k.model FROM kinds k
        WHERE k.capability <> 'image' AND NOT EXISTS (SELECT 1 FROM allowlist a WHERE a.capability = k.capability
          AND a.provider = k.provider AND a.model = k.model)"""),
    "pii_redact": _sql(body="SELECT doc_id, p AS text FROM redacted"),
    "pii_report": _sql(body=r"""SELECT source, lang, count(*) AS documents,
        count(*) FILTER (WHERE e <> text OR s <> e OR p <> s) AS documents_hit,
        CAST(sum(len(regexp_extract_all(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}'))) AS BIGINT) AS email_hits,
        CAST(sum(len(regexp_extract_all(e, '\b\d{3}-\d{2}-\d{4}\b'))) AS BIGINT) AS ssn_hits,
        CAST(sum(len(regexp_extract_all(s, '\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b'))) AS BIGINT) AS phone_hits
        FROM redacted GROUP BY 1, 2"""),
    "output_text": _sql(body="SELECT * FROM outputs"),
    "moderate_outputs": _sql(body="""SELECT conv_id, turn, violation, CASE WHEN violation IS NOT NULL THEN 451 END AS status,
        CASE WHEN violation IS NOT NULL THEN 'ai_output_blocked' END AS code, 'AI output blocked: ' || violation AS message FROM moderated"""),
    "moderation_violations": _sql(body="SELECT conv_id, turn, violation, answer FROM moderated WHERE violation IS NOT NULL"),
    "phrase_matches": _sql(body="SELECT doc_id, min(item_id) AS first_pos, count(*) AS phrases_hit FROM hits GROUP BY 1"),
    "corpus_scrub": _sql(body="""SELECT doc_id, p AS text, first_pos, phrases_hit FROM redacted LEFT JOIN
        (SELECT doc_id, min(item_id) AS first_pos, count(*) AS phrases_hit FROM hits GROUP BY 1) USING (doc_id)"""),
    "prompt_current": _sql(body="SELECT * REPLACE (epoch_us(updated_at) AS updated_at) FROM live"),
    "prompt_audit": _sql(body="SELECT * REPLACE (epoch_us(updated_at) AS updated_at) FROM audit"),
    "prompt_history": _sql(body="""SELECT ability_id, CAST(rank AS INTEGER) AS rank, edit_id, action, mode, template, updated_by FROM
        (SELECT *, row_number() OVER (PARTITION BY ability_id ORDER BY edit_id DESC) AS rank FROM audit) WHERE rank <= 50"""),
    "prompt_catalog": _sql(body="""SELECT pos, a.ability_id, label, mode, template, updated_by FROM abilities a
        LEFT JOIN live l ON l.ability_id = a.ability_id"""),
    "prompt_lookup": _sql(body="""SELECT request_id, CASE WHEN request_id % 9 = 0 THEN c.ability_id || 's' ELSE c.ability_id END AS ability_id,
        request_id % 9 = 0 AS unknown_ability, CASE WHEN request_id % 9 <> 0 THEN label END AS label,
        CASE WHEN request_id % 9 <> 0 THEN mode END AS mode, CASE WHEN request_id % 9 <> 0 THEN template END AS template
        FROM calls c JOIN abilities a USING (ability_id) LEFT JOIN live l USING (ability_id)"""),
    "prompt_asof": _sql(body="""SELECT request_id, c.ability_id, CASE WHEN e.action = 'put' THEN e.edit_id END AS edit_id,
        CASE WHEN e.action = 'put' THEN e.mode END AS mode, CASE WHEN e.action = 'put' THEN e.template END AS template
        FROM calls c ASOF LEFT JOIN edits e ON e.ability_id = c.ability_id AND c.ts >= e.updated_at"""),
    "ability_catalog": _sql(body="""SELECT site_id, pos, ability_id, coalesce(x.label, ability_id) AS label,
        coalesce(x.d, '') AS description, coalesce(x.i, '') AS default_instruction, x.i IS NOT NULL AS default_available FROM registered
        UNION ALL SELECT s.site_id, a.pos, a.ability_id, a.label, '', '', false
        FROM (SELECT site_id FROM sites WHERE site_id NOT IN (SELECT site_id FROM registered)) s, abilities a"""),
    "policy_snapshot": _sql(body="""SELECT s.site_id, """ + ", ".join(
        f"coalesce(max(CASE WHEN key = '{key}' THEN value END), '{default}') AS {key}" for key, default in {
            "preamble": '""', "rate_limits": '{"minute":20,"day":500}', "monthly_user_cap": "0", "log_retention_days": "90",
            "model_allowlist": "[]", "disabled_features": "[]", "banned_phrases": "[]", "redact_pii": "true",
            "use_guidelines": "true"}.items()) + """, s.site_id < 40 AS guidelines_detected FROM sites s LEFT JOIN
        (SELECT *, row_number() OVER (PARTITION BY site_id, key ORDER BY version DESC) AS n FROM options) o
        ON o.site_id = s.site_id AND o.n = 1 GROUP BY s.site_id"""),
    "policy_merge": _sql(body="""SELECT site_id, key, coalesce(u.value, c.value) AS value FROM
        (SELECT site_id, key, arg_max(value, version) AS value FROM options WHERE version % 3 <> 1 GROUP BY 1, 2) c FULL JOIN
        (SELECT site_id, key, arg_max(value, version) AS value FROM options WHERE version % 3 = 1 AND key <> 'vault_enabled'
         AND site_id % 4 <> 0 GROUP BY 1, 2) u USING (site_id, key)"""),
    "guideline_current": _sql(body="SELECT site_id, post_id, post_type, post_status, epoch_us(post_date) AS post_date FROM gcur"),
    "guideline_categories": _sql(body="SELECT * FROM gcat"),
    "guideline_block_rules": _sql(body="SELECT * FROM grules"),
    "guideline_sections": _sql(body="""SELECT g.site_id, g.post_id AS guideline_post_id, '## Site guidelines' || chr(10) || chr(10) || 'The site has defined the following content guidelines. Evaluate the content against these standards and cite the relevant guideline when flagging an issue. Where these guidelines conflict with other instructions in this prompt, those instructions take precedence.'
        || chr(10) || chr(10) || concat_ws(chr(10) || chr(10), CASE WHEN site <> '' THEN '### Site context' || chr(10) || site END,
          CASE WHEN copy <> '' THEN '### Copy & editorial style' || chr(10) || copy END,
          CASE WHEN images <> '' THEN '### Image guidelines' || chr(10) || images END,
          CASE WHEN additional <> '' THEN '### Additional guidelines' || chr(10) || additional END,
          '### Block-specific rules' || chr(10) || r.lines) AS section
        FROM gcat g LEFT JOIN (SELECT site_id, string_agg('- ' || name || ': ' || rule, chr(10) ORDER BY pos) AS lines
        FROM grules GROUP BY 1) r USING (site_id)"""),
    "post_blocks": _sql(body="SELECT post_id, array_to_string(blocks, ',') AS blocks FROM posts"),
    "relevant_block_rules": _sql(body="""SELECT p.site_id, p.post_id, r.name, r.pos, r.rule FROM posts p JOIN grules r
        ON r.site_id = p.site_id AND (p.blocks IS NULL OR list_contains(p.blocks, r.name))"""),
    "render_prompts": _sql(body="""SELECT request_id, ability_id, site_id, CASE WHEN applied AND NOT placed
        THEN rtrim(base, """ + _TRIM + """) || chr(10) || chr(10) || body ELSE base END AS prompt FROM overridden"""),
    "guideline_audit": _sql(body="""SELECT request_id, ability_id, guideline_post_id, revision_id AS guideline_revision_id
        FROM overridden WHERE applied"""),
    "governance_replay": _sql("numbered", "walk", body="""SELECT b.request_id, b.user_id, b.ability_id, stop AS stopped_by,
        CASE WHEN stop IS NULL THEN micros ELSE 0 END / 1e6 AS usd_spent,
        stop IS NULL AND status = 'success' AND coalesce(d.hit, false) AS output_blocked FROM
        (SELECT *, CASE WHEN rate_decision <> 'allowed' THEN 'rate:' || rate_decision WHEN NOT granted THEN 'role'
          WHEN over_budget THEN 'budget' END AS stop FROM budgeted) b LEFT JOIN
        (SELECT doc_id, contains(low, 'erblest') OR contains(low, 'ouche') OR contains(low, 'tion de')
          OR contains(low, 'never said') AS hit FROM (SELECT doc_id, """ + _LOWER.format("text") + """ AS low FROM documents)) d
        ON d.doc_id = b.request_id"""),
    "stream_usage": _sql(body="""SELECT user_id, strftime(ts, '%Y-%m') AS period, provider, model, count(*) AS requests,
        CAST(sum(tokens_input) AS BIGINT) AS tokens_in, CAST(sum(tokens_output) AS BIGINT) AS tokens_out,
        CAST(sum(tokens_input * 3 + tokens_output * 15) AS DOUBLE) / 1e6 AS usd_spent
        FROM rq WHERE status = 'success' GROUP BY ALL"""),
    "stream_spend_alerts": _sql(body="""SELECT user_id, period, slot, CAST(t AS DOUBLE) / 1e6 AS usd_spent FROM
        (SELECT *, sum(s) OVER (PARTITION BY user_id, period ORDER BY slot) AS t FROM slots)
        WHERE t >= 100000 AND t - s < 100000 AND user_id % 5 <> 0"""),
    "stream_rate_limits": _sql("numbered", body="""SELECT user_id, ability_id, t * 1000000 AS tick, count(*) AS requests,
        count(*) FILTER (WHERE rate_decision = 'allowed') AS allowed, count(*) FILTER (WHERE rate_decision = 'hour') AS over_hour,
        count(*) FILTER (WHERE rate_decision = 'day') AS over_day FROM walk GROUP BY 1, 2, 3"""),
    "stream_moderate": _sql(body="""SELECT conv_id, turn, violation, CASE WHEN violation IS NOT NULL THEN 451 END AS status
        FROM moderated"""),
    "stream_redact": _sql(body="SELECT doc_id, p AS text FROM redacted"),
}
ORACLE_SQL["usage_upsert"] = ORACLE_SQL["usage_colocated"] = ORACLE_SQL["usage_store_upsert"] = ORACLE_SQL["usage_rollup"]
ORACLE_SQL["prompt_asof_stored"] = ORACLE_SQL["stream_prompt_asof"] = ORACLE_SQL["prompt_asof"]
ORACLE_SQL["shape_raw_json"] = ORACLE_SQL["shape_requests"]
ORACLE_SQL["sql_request_cost"] = ORACLE_SQL["request_cost"]
ORACLE_SQL["sql_pii_redact"] = ORACLE_SQL["pii_redact"]
ORACLE_SQL["prompt_intervals"] = _sql(body="""SELECT ability_id, edit_id, epoch_us(updated_at) AS from_us,
        coalesce(epoch_us(lead(updated_at) OVER (PARTITION BY ability_id ORDER BY updated_at, edit_id)), 9223372036854775807) AS to_us,
        action = 'put' AS live, CASE WHEN action = 'put' THEN mode END AS mode, CASE WHEN action = 'put' THEN template END AS template
        FROM edits""")
ORACLE_SQL["governance_events"] = f"""WITH r AS ({ORACLE_SQL["governance_replay"]}), counts AS (
        SELECT count(*) AS requests, count(stopped_by) AS stopped, count(*) FILTER (WHERE output_blocked) AS output_blocked,
          count(*) FILTER (WHERE stopped_by = 'feature') AS stopped_by_feature,
          count(*) FILTER (WHERE stopped_by LIKE 'rate:%') AS stopped_by_rate,
          count(*) FILTER (WHERE stopped_by = 'role') AS stopped_by_role, count(*) FILTER (WHERE stopped_by = 'model') AS stopped_by_model,
          count(*) FILTER (WHERE stopped_by = 'budget') AS stopped_by_budget,
          CAST(sum(CAST(round(usd_spent * 1000000) AS BIGINT)) AS BIGINT) AS usd_micros FROM r)
        UNPIVOT counts ON COLUMNS(*) INTO NAME event VALUE n"""
ORACLE_SQL["usage_store_swept"] = ORACLE_SQL["usage_retained"]
ORACLE_SQL["stream_usage_late"] = ORACLE_SQL["stream_usage"]
