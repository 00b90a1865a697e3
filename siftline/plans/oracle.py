"""The registered queries as SQL over the same tables, for comparison."""

from __future__ import annotations

from siftline.operators.classify import DEFAULT_SMOOTHING, DEFAULT_TEXTS
from siftline.operators.library import LIBRARY
from siftline.operators.patterns import Pattern, select_patterns
from siftline.plans.inputs import DIGITS, ENTITIES, FLAGGED, HEAD_SEED, SEEDS, TITLES, WORDS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def regex(pattern: Pattern) -> str:
    return text(pattern.effective())


def named(names: str) -> list[Pattern]:
    return select_patterns(LIBRARY, names)


def hits(source: str, columns: str, content: str, patterns: list[Pattern]) -> str:
    """Every match of every pattern: the columns, pattern, ordinal and content."""
    parts = [
        f"SELECT {columns}, {text(item.name)} AS pattern, unnest(range(len(m))) AS ordinal, unnest(m) AS content "
        f"FROM (SELECT *, regexp_extract_all({content}, {regex(item)}) AS m FROM {source})"
        for item in patterns
    ]
    return "(SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE content <> '')"


def entropy(content: str) -> str:
    share = f"((len({content}) - len(replace({content}, c, ''))) / strlen({content})::DOUBLE)"
    chars = f"list_distinct(string_split({content}, ''))"
    return f"round(list_sum(list_transform({chars}, lambda c: -({share} * log2({share})))), 9)"


def lines(source: str, columns: str, content: str) -> str:
    """Numbered lines; a final line break opens no line."""
    body = f"CASE WHEN ends_with({content}, chr(10)) THEN left({content}, len({content}) - 1) ELSE {content} END"
    return (
        f"(SELECT {columns}, i AS line, regexp_replace(l[i], '\\r$', '') AS content FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i "
        f"FROM (SELECT *, string_split({body}, chr(10)) AS l FROM {source} WHERE {content} <> '')))"
    )


def trimmed(value: str) -> str:
    return f"regexp_replace({value}, '^\\s+|\\s+$', '', 'g')"


DOCUMENT_LINES = lines("documents", "doc_id", "text")
DOCUMENT_HITS = hits("documents", "doc_id", "text", named("ip,http-auth,strings"))
PAGES_BOTH = "(SELECT page_id, 'url' AS target, url AS v FROM pages UNION ALL SELECT page_id, 'html', html FROM pages)"
TURNS_BOTH = (
    "(SELECT conv_id, turn, 'role' AS target, role AS v FROM conversations "
    "UNION ALL SELECT conv_id, turn, 'text', text FROM conversations)"
)
EVENT_LINES = (
    """(SELECT * EXCLUDE (value), '{"event_id":' || event_id || ',"event_type":' || to_json(event_type) || ',"meta":{"user_id":' || user_id """
    """|| ',"props":' || to_json(props) || '},"marks":[' || to_json(event_type) || ',"' || user_id || '"]}' AS value FROM events)"""
)
HOST = "split_part(content, '/', 3)"
QUALITY = "(SELECT text, quality::VARCHAR AS label FROM documents JOIN labels USING (doc_id))"


def words(source: str, columns: str, content: str) -> str:
    return (
        f"(SELECT * FROM (SELECT {columns}, unnest(regexp_split_to_array({content}, '\\s+')) AS token FROM {source}) "
        f"WHERE token <> '')"
    )


ALPHA = str(DEFAULT_SMOOTHING)
MODEL = f"""
counts AS (SELECT token, sum((label = '0')::INT) AS n0, sum((label = '1')::INT) AS n1
           FROM {words(QUALITY, "label", "text")} GROUP BY token),
size AS (SELECT count(*) AS v, sum(n0) AS t0, sum(n1) AS t1 FROM counts),
prior AS (SELECT ln(sum((label = '0')::INT) / count(*)::DOUBLE) AS p0, ln(sum((label = '1')::INT) / count(*)::DOUBLE) AS p1
          FROM {QUALITY})"""


def smart() -> str:
    rows = ", ".join(f"({text(item)}, {text(label)})" for label, items in DEFAULT_TEXTS.items() for item in items)
    score = "ln(0.5) + coalesce(sum(ln((coalesce({n}, 0) + %s) / (t{i} + %s * v))), 0)" % (ALPHA, ALPHA)
    return f"""
WITH training(text, label) AS (VALUES {rows}),
counts AS (SELECT token, sum((label = 'high-interest')::INT) AS n0, sum((label = 'low-interest')::INT) AS n1
           FROM {words("training", "label", "text")} GROUP BY token),
size AS (SELECT count(*) AS v, sum(n0) AS t0, sum(n1) AS t1 FROM counts),
found AS (SELECT * FROM {hits("documents", "doc_id", "text", [WORDS])}),
scored AS (SELECT content, {score.format(n="n0", i=0)} AS high, {score.format(n="n1", i=1)} AS low
           FROM (SELECT DISTINCT content, token FROM {words("found", "content", "content")}) w
           LEFT JOIN counts USING (token), size GROUP BY content)
SELECT doc_id, ordinal, content FROM found JOIN scored USING (content) WHERE high > low"""


def escaped_turn() -> str:
    return ("replace(replace(replace(text, chr(10), '\\n'), '\"', '\\\"'), 'é', '\\u00e9')")


def unescaped(value: str) -> str:
    plain = f"replace(replace(replace(replace({value}, '\\n', chr(10)), '\\r', chr(13)), '\\t', chr(9)), '\\\"', '\"')"
    valid = f"NOT regexp_matches(replace({plain}, '\\u00e9', ''), '[\\x00-\\x1f\"\\\\]')"
    return f"CASE WHEN {valid} THEN replace({plain}, '\\u00e9', 'é') ELSE {plain} END"


def chain_text(*parts: str) -> str:
    return " || '|' || ".join(parts)


def library_counts() -> str:
    parts = [
        f"SELECT {text(item.name)} AS pattern, sum(n)::BIGINT AS hits, sum((n > 0)::INT)::BIGINT AS records FROM "
        f"(SELECT len(list_filter(regexp_extract_all(html, {regex(item)}), lambda m: m <> '')) AS n FROM pages)"
        for item in LIBRARY
    ]
    return " UNION ALL ".join(parts)


def diagnose_events() -> str:
    clicks = f"(SELECT * FROM {EVENT_LINES} WHERE event_type = 'click')"
    decoded = "replace(props, '\\\"', '\"')"
    return f"""
SELECT event_id, 'parse' AS stage, '' AS subject, 'ok' AS outcome, '' AS detail FROM events
UNION ALL SELECT event_id, 'filter', 'event_type', CASE WHEN event_type = 'click' THEN 'pass' ELSE 'fail' END, event_type FROM events
UNION ALL SELECT event_id, 'target', 'event_type', 'found', '' FROM {clicks}
UNION ALL SELECT event_id, 'target', 'meta.props', 'found', '' FROM {clicks}
UNION ALL SELECT event_id, 'target', 'meta.none', 'missing', '' FROM {clicks}
UNION ALL SELECT event_id, 'decode', 'event_type', 'done', strlen(event_type) || ' -> ' || strlen(event_type) FROM {clicks}
UNION ALL SELECT event_id, 'decode', 'meta.props', 'done', strlen(props) || ' -> ' || strlen({decoded}) FROM {clicks}
UNION ALL SELECT event_id, 'pattern', 'digits', 'hit', len(regexp_extract_all(props, {regex(DIGITS)}))::VARCHAR FROM {clicks}
  WHERE regexp_matches(props, {regex(DIGITS)})"""


def mixed() -> str:
    json = """'{"page_id":' || page_id || ',"url":' || to_json(url) || '}'"""
    every = (
        f"(SELECT '$' AS target, {json} AS v FROM pages UNION ALL SELECT '1', c_name FROM customer "
        f"UNION ALL SELECT '$', content FROM {DOCUMENT_LINES})"
    )
    found = hits(every, "target", "v", named("urls,ip,http-auth,all_lines"))
    return f"SELECT pattern, target, content, count(*) AS found FROM {found} GROUP BY ALL"


def networks(asked: str, columns: str) -> str:
    """Owners of the addresses in ``asked``, from networks made of all addresses in documents."""
    found = hits("documents", "doc_id", "text", named("ip"))
    octets = "split_part(content, '.', 1) AS a, split_part(content, '.', 1) || '.' || split_part(content, '.', 2) AS ab"
    return f"""
WITH near AS (SELECT ab FROM (SELECT {octets} FROM {found}) GROUP BY ab HAVING count(*) > 1)
SELECT {columns}, 'ip_info=org-' || coalesce(near.ab, a) AS outputs FROM (SELECT *, {octets} FROM {asked}) LEFT JOIN near USING (ab)"""


def fitted(found: str, columns: str) -> str:
    """Findings that the model fitted to documents puts in class 1."""
    return f"""
WITH {MODEL},
found AS (SELECT * FROM {found}),
scored AS (SELECT content, any_value(p0) + coalesce(sum(CASE WHEN token IS NOT NULL THEN ln((coalesce(n0, 0) + {ALPHA}) / (t0 + {ALPHA} * v)) END), 0) AS s0,
           any_value(p1) + coalesce(sum(CASE WHEN token IS NOT NULL THEN ln((coalesce(n1, 0) + {ALPHA}) / (t1 + {ALPHA} * v)) END), 0) AS s1
           FROM (SELECT DISTINCT content FROM found) d
           LEFT JOIN {words("(SELECT DISTINCT content FROM found)", "content", "content")} w USING (content)
           LEFT JOIN counts USING (token), size, prior GROUP BY content)
SELECT {columns} FROM found JOIN scored USING (content) WHERE s1 >= s0"""


def json_leaves() -> str:
    return """
SELECT event_id, '$.event_id' AS path, event_id::VARCHAR AS value FROM events
UNION ALL SELECT event_id, '$.event_type', event_type FROM events
UNION ALL SELECT event_id, '$.meta.user_id', user_id::VARCHAR FROM events
UNION ALL SELECT event_id, '$.meta.props', props FROM events
UNION ALL SELECT event_id, '$.marks[0]', event_type FROM events
UNION ALL SELECT event_id, '$.marks[1]', user_id::VARCHAR FROM events"""


def report() -> str:
    found = hits("documents", "doc_id", "text", named("ip,http-auth"))
    return f"""
WITH entries AS (
    SELECT '### [' || pattern || '] documents:' || doc_id || chr(10) || '- Content: `' || content || '`' AS entry,
           row_number() OVER (ORDER BY pattern, 'documents:' || doc_id, content) AS n FROM {found}
)
SELECT 1::BIGINT AS number, '# Found' AS value
UNION ALL SELECT 2 * n + k - 1, string_split(entry, chr(10))[k] FROM entries, (SELECT unnest([1, 2]) AS k)"""


def other_lookups() -> str:
    names = ("host_dns", "reverse_dns", "shodan_lookup", "nmap_fast", "curl_head", "check_s3", "ping_host")
    parts = "".join(
        f" || CASE WHEN n > {number} THEN '|{name}=' || n ELSE '{'|ping_host=Dead' if name == 'ping_host' else ''}' END"
        for number, name in enumerate(names)
    )
    return (
        f"WITH hosts AS (SELECT split_part(url, '/', 3) AS host, count(*) AS n FROM pages GROUP BY 1) "
        f"SELECT page_id, content, 'extract_domain=' || host{parts} AS outputs "
        f"FROM {hits('pages', 'page_id', 'url', named('urls'))} JOIN hosts ON host = {HOST}"
    )


def unique_of(found: str, extra: str = "") -> str:
    return (
        f"SELECT pattern, content, doc_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY pattern, content "
        f"ORDER BY doc_id, ordinal) AS n FROM {found}) f WHERE n = 1 {extra}"
    )


def oracle_sql() -> dict[str, str]:
    page_strings = hits("pages", "page_id", "html", named("strings"))
    url_hits = hits("pages", "page_id", "url", named("urls"))
    with_lines = named("ip,http-auth,all_lines")
    passages = hits("benchmark", "item_id", "text", with_lines)
    ip = regex(named("ip")[0])
    sinks = named("php-sinks")[0]
    file = "'documents:' || doc_id"
    by_tag = select_patterns(LIBRARY, tags=["cloud", "recon", "storage"])
    return {
        "scan_documents": f"SELECT doc_id, pattern, ordinal, content, {entropy('content')} AS entropy FROM "
                          + hits("documents", "doc_id", "text", named("ip,http-auth,strings,urls")),
        "scan_groups": f"""
SELECT doc_id, 'ip' AS pattern, i AS ordinal, g0[i+1] || '|' || g1[i+1] || '|' || g2[i+1] || '|' || g3[i+1] AS groups FROM (
  SELECT *, unnest(range(len(g0))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {ip}) AS g0, regexp_extract_all(text, {ip}, 1) AS g1,
  regexp_extract_all(text, {ip}, 2) AS g2, regexp_extract_all(text, {ip}, 3) AS g3 FROM documents))
UNION ALL SELECT doc_id, 'php-sinks', i, g0[i+1] || '|' || g1[i+1] FROM (
  SELECT *, unnest(range(len(g0))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {regex(sinks)}) AS g0,
  regexp_extract_all(text, {regex(sinks)}, 1) AS g1 FROM documents))""",
        "scan_all_lines": "SELECT doc_id, ordinal, content FROM "
                          + hits("documents", "doc_id", "text", named("all_lines")),
        "scan_library": "SELECT page_id, target, pattern, ordinal, content FROM "
                        + hits(PAGES_BOTH, "page_id, target", "v", LIBRARY),
        "scan_deep_pattern": f"SELECT doc_id, i AS ordinal, g0[i+1] AS content, g1[i+1] AS last_word FROM (SELECT *, "
                             f"unnest(range(len(g0))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {regex(TITLES)}) AS g0, "
                             f"regexp_extract_all(text, {regex(TITLES)}, 1) AS g1 FROM documents))",
        "scan_targets": "SELECT conv_id, turn, target, pattern, ordinal, content FROM "
                        + hits(TURNS_BOTH, "conv_id, turn, target", "v", [*named("all_lines"), WORDS]),
        "select_by_tag": "SELECT pattern, count(*) AS hits, count(DISTINCT content) AS distinct_contents FROM "
                         + hits(PAGES_BOTH, "page_id", "v", by_tag) + " GROUP BY pattern",
        "grep_document_lines": " UNION ALL ".join(
            f"SELECT doc_id, line, {text(item.name)} AS pattern, content FROM {DOCUMENT_LINES} "
            f"WHERE regexp_matches(content, {regex(item)})" for item in named("ip,http-auth,strings")
        ),
        "pattern_hits": library_counts(),
        "diagnose_events": diagnose_events(),
        "diagnose_csv": f"""
SELECT c_custkey, 'parse' AS stage, '' AS subject, 'ok' AS outcome, '3' AS detail FROM customer
UNION ALL SELECT c_custkey, 'target', '1', 'found', '' FROM customer
UNION ALL SELECT c_custkey, 'target', '2', 'found', '' FROM customer
UNION ALL SELECT c_custkey, 'target', '3', 'missing', '' FROM customer
UNION ALL SELECT c_custkey, 'pattern', 'digits', 'hit', len(regexp_extract_all(v, {regex(DIGITS)}))::VARCHAR
  FROM (SELECT c_custkey, unnest([c_name, c_mktsegment]) AS v FROM customer) WHERE regexp_matches(v, {regex(DIGITS)})""",
        "diagnose_csv_ragged": f"""
SELECT -1::BIGINT AS c_custkey, 'parse' AS stage, '' AS subject, 'header' AS outcome, '2' AS detail
UNION ALL SELECT c_custkey, 'parse', '', CASE WHEN c_custkey % 3 = 0 THEN 'ragged' ELSE 'ok' END,
  CASE WHEN c_custkey % 3 = 0 THEN '3' ELSE '2' END FROM customer
UNION ALL SELECT c_custkey, 'target', '1', 'found', '' FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 'pattern', 'digits', 'hit', len(regexp_extract_all(c_name, {regex(DIGITS)}))::VARCHAR FROM customer
  WHERE c_custkey % 3 <> 0 AND regexp_matches(c_name, {regex(DIGITS)})""",
        "scan_flags": "SELECT doc_id, pattern, ordinal, content FROM " + hits("documents", "doc_id", "text", FLAGGED),
        "scan_seeded": "SELECT doc_id, pattern, ordinal, content FROM "
                       + hits(f"(SELECT doc_id, {text(HEAD_SEED)} || text || {text(SEEDS)} AS t FROM documents)", "doc_id", "t", LIBRARY),
        "entropy": f"SELECT page_id, ordinal, content, {entropy('content')} AS entropy FROM {page_strings}",
        "high_entropy": f"SELECT * FROM (SELECT page_id, ordinal, content, {entropy('content')} AS entropy FROM {page_strings}) "
                        "WHERE entropy >= 3.5",
        "unique_matches": unique_of(DOCUMENT_HITS),
        "unseen_matches": unique_of(
            hits("documents", "doc_id", "text", with_lines), f"AND NOT EXISTS (SELECT 1 FROM {passages} h WHERE h.pattern = f.pattern AND h.content = f.content)"
        ),
        "classifier_fit": f"WITH {MODEL} SELECT token, round(ln((n0 + {ALPHA}) / {ALPHA}), 9) AS gain_0, "
                          f"round(ln((n1 + {ALPHA}) / {ALPHA}), 9) AS gain_1 FROM counts",
        "classifier_apply": f"""
WITH {MODEL},
scored AS (SELECT doc_id, any_value(p0) + coalesce(sum(CASE WHEN token IS NOT NULL THEN ln((coalesce(n0, 0) + {ALPHA}) / (t0 + {ALPHA} * v)) END), 0) AS s0,
           any_value(p1) + coalesce(sum(CASE WHEN token IS NOT NULL THEN ln((coalesce(n1, 0) + {ALPHA}) / (t1 + {ALPHA} * v)) END), 0) AS s1
           FROM documents LEFT JOIN {words("documents", "doc_id", "text")} w USING (doc_id) LEFT JOIN counts USING (token), size, prior
           GROUP BY doc_id)
SELECT doc_id, CASE WHEN s1 >= s0 THEN '1' ELSE '0' END AS label, round(s0, 3) AS score_0, round(s1, 3) AS score_1 FROM scored""",
        "classifier_ngrams": f"""
SELECT token, round(ln((sum((role = 'assistant')::INT) + {ALPHA}) / {ALPHA}), 9) AS gain_assistant,
       round(ln((sum((role = 'system')::INT) + {ALPHA}) / {ALPHA}), 9) AS gain_system,
       round(ln((sum((role = 'user')::INT) + {ALPHA}) / {ALPHA}), 9) AS gain_user
FROM (SELECT role, CASE WHEN len(text) < 2 THEN text ELSE substr(text, i, 2) END AS token
      FROM (SELECT role, text, unnest(range(1, greatest(len(text), 2))) AS i FROM conversations)) GROUP BY token""",
        "scan_many": """
WITH chosen AS (SELECT regexp_extract(text, '^[A-Za-z]{6,}') AS word, count(*) AS n FROM documents WHERE regexp_extract(text, '^[A-Za-z]{6,}') <> ''
                GROUP BY word ORDER BY n DESC, word LIMIT 500),
found AS (SELECT word, unnest(regexp_extract_all(text, word || ' ([a-z]+)')) AS content FROM chosen JOIN documents ON contains(text, word))
SELECT 'word-' || word AS pattern, count(*) AS found, count(DISTINCT content) AS contents FROM found GROUP BY word""",
        "smart_filter": smart(),
        "smart_filter_fitted": fitted(hits("conversations", "conv_id, turn", "text", named("all_lines")), "conv_id, turn, ordinal, content"),
        "stream_classified": fitted(hits(DOCUMENT_LINES, "doc_id", "content", named("all_lines")), "content"),
        "jsonl_fields": " UNION ALL ".join(
            f"SELECT event_id::VARCHAR AS record_id, '{target}' AS target, {value} AS content, 'events:' || event_id AS file "
            "FROM events WHERE event_type = 'click'" for target, value in (
                ("meta.user_id", "user_id::VARCHAR"), ("meta.props", "props"),
                ("marks", "'[' || to_json(event_type) || ',\"' || user_id || '\"]'"),
            )
        ),
        "jsonl_long": "SELECT event_id, 'pad' AS target, CASE WHEN event_id = 7 THEN 21000000 ELSE event_id % 50 END::INT AS chars FROM events "
                      "WHERE event_id % 50 > 0 UNION ALL SELECT event_id, 'one', 1 FROM events",
        "json_documents": """
SELECT '$.of.n_name' AS target, n_name AS content, count(*) AS found FROM nation GROUP BY ALL
UNION ALL SELECT '$.n_nationkey', n_nationkey::VARCHAR, count(*) FROM nation GROUP BY ALL
UNION ALL SELECT '$.of.in[0]', n_regionkey::VARCHAR, count(*) FROM nation GROUP BY ALL
UNION ALL SELECT '$.c_name', c_name, count(*) FROM customer GROUP BY ALL""",
        "jsonl_malformed": f"""
SELECT 'documents:' || doc_id AS source_file, line, '$' AS target, content FROM {DOCUMENT_LINES} WHERE content <> ''
UNION ALL SELECT 'events', event_id, '$', value FROM {EVENT_LINES} WHERE event_type = 'view'
UNION ALL SELECT 'events', event_id, 'meta.user_id', user_id::VARCHAR FROM events WHERE event_type = 'view'""",
        "json_table_fields": "SELECT event_id, json_extract_string(props, '$.k') AS content FROM events",
        "csv_cells": "SELECT doc_id::VARCHAR AS record_id, '1' AS target, text AS content FROM documents WHERE text <> '' "
                     "UNION ALL SELECT doc_id::VARCHAR, '2', source FROM documents WHERE source <> ''",
        "csv_plain": " UNION ALL ".join(
            f"SELECT c_custkey::VARCHAR AS record_id, '{index}' AS target, {name}::VARCHAR AS content FROM customer"
            for index, name in enumerate(("c_custkey", "c_name", "c_mktsegment"))
        ),
        "csv_ragged": "SELECT doc_id::VARCHAR AS record_id, row_number() OVER (ORDER BY doc_id) AS line, text AS content "
                      "FROM documents WHERE doc_id % 4 <> 1",
        "ignored_files": f"SELECT pattern, content, count(*) AS found FROM "
                         + hits(lines("documents", "lang", "text"), "lang", "content", named("ip,http-auth"))
                         + " WHERE lang <> 'de' GROUP BY ALL",
        "text_lines": f"SELECT doc_id, line, content FROM {DOCUMENT_LINES}",
        "mixed_formats": mixed(),
        "preset_records": "SELECT 'crawl:' || url AS file, page_id AS line, pattern, ordinal, content FROM "
                          + hits("pages", "url, page_id", "html", named("strings,http-auth")),
        "expand_json": json_leaves(),
        "json_large": json_leaves(),
        "grep_output": f"SELECT 'doc-' || doc_id || '.txt' AS file, '.txt' AS ext, line, content FROM {DOCUMENT_LINES}",
        "resume_scan": "SELECT CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS run, pattern, content FROM " + hits(
            lines("documents", "lang", "text"), "lang", "content", named("ip,http-auth")
        ),
        "target_list": f"SELECT pattern, content, count(*) AS found FROM "
                       + hits(f"(SELECT doc_id || chr(9) || content AS t FROM {DOCUMENT_LINES})", "1", "t", named("ip,http-auth"))
                       + " GROUP BY ALL",
        "unescape": f"""
SELECT conv_id, turn, {unescaped("s")} AS content FROM (SELECT *, {escaped_turn()} AS s FROM conversations)
UNION ALL SELECT doc_id, line, {unescaped("s")} FROM (SELECT doc_id, line, replace(content, 'é', '\\u00e9') AS s FROM {DOCUMENT_LINES}
  WHERE content <> '')
UNION ALL SELECT doc_id, line, content FROM {DOCUMENT_LINES} WHERE content = ''""",
        "transform_targets": "SELECT conv_id, turn, 'role' AS target, upper(role) AS content FROM conversations WHERE role <> '' "
                             "UNION ALL SELECT conv_id, turn, 'text', replace(text, 'e', '3') FROM conversations WHERE text <> ''",
        "rewrite": """SELECT event_id, '{"k":"v' || json_extract_string(props, '$.k') || '"}' AS value FROM events""",
        "enrich_chain": "SELECT page_id, content, " + chain_text(
            f"'extract_domain=' || {HOST}", "'extract_path=/' || split_part(content, '/', 4)", "'rev_str=' || reverse(content)",
            "'t1=STEP1:''' || content || ''''", "'t2=STEP2:STEP1:''' || content || ''''", "'echo_val=EXTRACTED: ' || content",
        ) + f" AS outputs FROM {url_hits}",
        "enrich_some": f"SELECT doc_id, pattern, ordinal, content, CASE pattern WHEN 'ip' THEN 'rev_str=' || reverse(content) ELSE '' END "
                       f"AS outputs FROM {DOCUMENT_HITS}",
        "enrich_hosts": other_lookups(),
        "enrich_base64": f"SELECT conv_id, turn, 'b64_decode=' || {trimmed('text')} AS outputs FROM conversations WHERE text <> ''",
        "enrich_decoders": "SELECT conv_id, turn, 'extract_ip=8.8.8.8' || chr(10) || '10.1.2.3|url_decode=' || md5(text) || ' ' || "
                           "replace(text, ' ', '+') || ' 8.8.8.8 and 10.1.2.3|hash_id=MD5' AS outputs FROM conversations WHERE text <> ''",
        "enrich_json": """SELECT event_id, 'jq_pretty={"k":' || json_extract_string(props, '$.k') || '}|extract_tech=None' AS outputs """
                       "FROM events",
        "enrich_tokens": """
SELECT event_id, 'token' AS target, 'jwt_decode={"alg":"' || event_type || '"}' || props AS outputs FROM events
UNION ALL SELECT event_id, 'string', 'unquote_json=' || props FROM events""",
        "enrich_html": f"""
SELECT page_id, ordinal, content, 'html_unescape=' || CASE content WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>'
  WHEN '&quot;' THEN '"' WHEN '&copy;' THEN '©' WHEN '&middot;' THEN '·' ELSE content END AS outputs
FROM {hits('pages', 'page_id', 'html', [ENTITIES])}""",
        "enrich_lookup": f"WITH hosts AS (SELECT split_part(url, '/', 3) AS host, count(*) AS n FROM pages GROUP BY 1) "
                         f"SELECT page_id, content, 'extract_domain=' || host || '|whois=pages:' || n AS outputs "
                         f"FROM {url_hits} JOIN hosts ON host = {HOST}",
        "enrich_networks": networks(hits("documents", "doc_id", "text", named("ip")), "doc_id, ordinal, content"),
        "enrich_networks_stream": networks(
            hits(f"(SELECT doc_id || chr(9) || content AS t FROM {DOCUMENT_LINES})", "1", "t", named("ip")), "content"),
        "enrich_listing": "SELECT page_id, 'dir_listing=' || CASE WHEN min(CASE WHEN contains(lower(c.html), 'index of /') THEN "
                          "'Enabled' ELSE 'Disabled' END) = 'Enabled' THEN 'Enabled' ELSE 'Disabled' END AS outputs "
                          "FROM pages p JOIN (SELECT url, html FROM pages) c USING (url) GROUP BY page_id",
        "enrich_saved_findings": f"SELECT pattern, {file} AS file, content, {entropy('content')} AS entropy, "
                                 f"'rev_str=' || {trimmed('reverse(content)')} AS outputs FROM {DOCUMENT_HITS}",
        "text_output": f"SELECT '[' || pattern || '] ' || {file} || ':0: ' || content || chr(10) || '   ↳ reversed: ' || "
                       f"{trimmed('reverse(content)')} AS value FROM {DOCUMENT_HITS}",
        "content_output": f"SELECT content AS value FROM {DOCUMENT_HITS}",
        "table_output": f"SELECT pattern, {file} AS file, 0::BIGINT AS line, content FROM {DOCUMENT_HITS}",
        "template_output": f"""
SELECT 'ip|' || g1[i+1] || '|documents:' || doc_id || '|' || printf('%.3f', {entropy('g0[i+1]')}) || '|{{{{match[9]}}}}' AS value FROM (
  SELECT *, unnest(range(len(g0))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {ip}) AS g0,
  regexp_extract_all(text, {ip}, 1) AS g1 FROM documents))""",
        "report_output": f"SELECT '### [' || pattern || '] ' || {file} || chr(10) || '- Content: `' || content || '`' AS value "
                         f"FROM {DOCUMENT_HITS}",
        "report_texts": report(),
        "saved_runs": f"SELECT CASE pattern WHEN 'ip' THEN 'addresses' ELSE 'strings' END AS run_id, pattern, {file} AS file, content "
                      "FROM " + hits("documents", "doc_id", "text", named("ip,http-auth")),
        "finding_ids": f"SELECT row_number() OVER (ORDER BY doc_id, pattern, ordinal) AS id, doc_id, pattern, ordinal, content "
                       f"FROM {DOCUMENT_HITS}",
        "hit_total": f"SELECT count(*) AS total_hits FROM {DOCUMENT_HITS}",
        "progress": """
SELECT 'conversations' AS source_file, count(*) AS records, sum(strlen(v))::BIGINT AS bytes FROM
  (SELECT role AS v FROM conversations WHERE role <> '' UNION ALL SELECT text FROM conversations WHERE text <> '')
UNION ALL SELECT 'pages', count(*), sum(strlen(html))::BIGINT FROM pages WHERE html <> ''""",
        "summary": f"SELECT pattern, count(*) AS hits, count(DISTINCT content) AS distinct_contents FROM {DOCUMENT_HITS} GROUP BY pattern",
        "stream_numbered": f"SELECT doc_id, line, content FROM {DOCUMENT_LINES}",
        "stream_scan": f"SELECT pattern, ordinal, content, {entropy('content')} AS entropy FROM "
                       + hits(f"(SELECT doc_id || chr(9) || content AS t FROM {DOCUMENT_LINES})", "1", "t", named("ip,http-auth")),
        "stream_csv": "SELECT c_custkey::VARCHAR AS record_id, target, pattern, content FROM " + hits(
            "(SELECT c_custkey, '1' AS target, c_name AS v FROM customer UNION ALL SELECT c_custkey, '2', c_mktsegment FROM customer)",
            "c_custkey, target", "v", [DIGITS, *named("all_lines")],
        ),
        "resume_lines": f"SELECT doc_id, line, content FROM {DOCUMENT_LINES}",
        "stream_unique_runs": "SELECT DISTINCT pattern, content FROM "
                              + hits(f"(SELECT doc_id || chr(9) || content AS t FROM {DOCUMENT_LINES})", "1", "t", named("ip,http-auth")),
        "stream_unique": "SELECT DISTINCT pattern, content FROM "
                         + hits(f"(SELECT doc_id || chr(9) || content AS t FROM {DOCUMENT_LINES})", "1", "t", named("ip,http-auth")),
    }
