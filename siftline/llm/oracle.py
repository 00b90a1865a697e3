"""The corpus queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words of documents and items, windows of items, and documents' windows of the same lengths, joined by their words.
OP2_DECONTAMINATE = f"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), item_windows AS (
    SELECT DISTINCT item, n, array_to_string(w[s + 1 : s + n], ' ') AS words
    FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS s FROM items WHERE len(w) > 0)
), doc_windows AS (
    SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS words
    FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM docs, (SELECT DISTINCT n FROM item_windows))
), found AS (
    SELECT d.doc_id, d.s, d.n, i.item FROM doc_windows d JOIN item_windows i USING (n, words)
), hits AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM found) GROUP BY doc_id
), names AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)
"""

#: SHA-1 as base32: each five hexadecimal digits are four characters.
OP3_WARC_BUNDLES = """
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
    FROM pages
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  (((('0x' || substr(sha, 5 * (k // 4) + 1, 5))::INT >> (15 - 5 * (k % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM payloads
"""

#: Every string of 200 bytes, as hexadecimal digits; bytes that one covers go.
OP5_SUFFIX_DEDUP = """
WITH texts AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
    SELECT doc_id, s, hash(substr(h, 2 * s + 1, 400)) AS one, hash('x' || substr(h, 2 * s + 1, 400)) AS two
    FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS s FROM texts)
), repeated AS (
    SELECT one, two FROM strings GROUP BY one, two HAVING count(*) > 1
), starts AS (
    SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM strings JOIN repeated USING (one, two)
), numbered AS (
    SELECT doc_id, s, sum((before IS NULL OR s > before + 200)::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM starts
), spans AS (
    SELECT doc_id, run, min(s) AS low, max(s) + 200 AS high FROM numbered GROUP BY doc_id, run
), gaps AS (
    SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS low, low AS high FROM spans
    UNION ALL
    SELECT doc_id, max(high), NULL FROM spans GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(substr(h, 2 * low + 1, 2 * (coalesce(high, len(h) // 2) - low)), '' ORDER BY low) AS h
    FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
), counted AS (
    SELECT doc_id, sum(high - low)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM spans GROUP BY doc_id
)
SELECT t.doc_id, (len(t.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN counted USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

#: Sets of shingles, links by common shingles, and all that links reach.
OP8_JACCARD_JOIN = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) > 2 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))
                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS shingles
    FROM docs
), tokens AS (
    SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b USING (shingle)
    WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS other FROM docs
    UNION
    SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id
FROM sets s
"""

#: crc32 of a list of bytes, bit by bit.
_CRC32 = """xor(4294967295, list_reduce([4294967295] || {bytes}, lambda c, b:
        list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)))"""

#: Words by a table-driven crc32; near words by what is left when a code point is taken out at each place.
OP11_SPELLING_VARIANTS = """
WITH RECURSIVE steps AS (
    SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
    FROM (SELECT unnest(range(256)) AS n)
), runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents WHERE text IS NOT NULL
), counted AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        [4294967295] || list_transform(range(1, octet_length(encode(id || ':' || run)) + 1),
            lambda k: ('0x' || substr(hex(encode(id || ':' || run)), 2 * k - 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h
    FROM counted, steps
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
    ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
    SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION
    SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION
    SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place FROM near
), forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form,
           CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1
), follow AS (
    SELECT word, word AS root, form AS following FROM forms
    UNION ALL
    SELECT f.word, g.word, g.form FROM follow f JOIN forms g ON g.word = f.following
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root FROM forms f JOIN follow r ON r.word = f.word AND r.following IS NULL
"""

#: Nodes as the joined digests of their turns; sums over the ways of the smallest members.
OP12_PREFIX_TRIE = f"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tid) AS pos, tid, size FROM (
        SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS tid,
               length(coalesce(text, '')) AS size
        FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base,
           {_CRC32.format(bytes="list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT c.conv_id, 1 AS part, t.pos, t.tid, t.size FROM convs c JOIN turns t ON t.conv_id = c.base WHERE t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, 2 AS part, t.pos, t.tid, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.pos > c.h
), placed AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, tid, size FROM rebuilt
), ways AS (
    SELECT conv_id, depth, string_agg(tid, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node, size,
           depth = max(depth) OVER (PARTITION BY conv_id) AS ends
    FROM placed
    UNION ALL
    SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM placed) FROM convs
), nodes AS (
    SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(size) AS size,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM ways GROUP BY node
), children AS (
    SELECT substr(node, 1, length(node) - 32) AS node, count(*) AS n_children FROM nodes WHERE node <> '' GROUP BY 1
), counted AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.node = c.node
), sums AS (
    SELECT w.node, sum((n.n_convs - 1) * n.size) AS saved_tokens, sum((n.n_children = 0)::INT) AS n_leaves
    FROM counted n JOIN ways w ON w.conv_id = n.conv_id AND w.depth <= n.depth GROUP BY w.node
)
SELECT c.conv_id::BIGINT AS conv_id, c.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, c.n_convs::BIGINT AS n_convs,
       c.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s ON s.node = c.node LEFT JOIN nodes p ON c.node <> '' AND p.node = substr(c.node, 1, length(c.node) - 32)
"""

ORACLE_SQL = {
    "op2_decontaminate": OP2_DECONTAMINATE,
    "op3_warc_bundles": OP3_WARC_BUNDLES,
    "op5_suffix_dedup": OP5_SUFFIX_DEDUP,
    "op8_jaccard_join": OP8_JACCARD_JOIN,
    "op11_spelling_variants": OP11_SPELLING_VARIANTS,
    "op12_prefix_trie": OP12_PREFIX_TRIE,
}
