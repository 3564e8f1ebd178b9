"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from careerline.llm.line_dedup import CONFIDENCE, MAX_RATIO, MIN_PAGES

OP1_SQL = f"""
WITH pages AS (
    SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
), numbered AS (
    SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM pages
), per_host AS (
    SELECT source, count(*) AS pages FROM documents GROUP BY source
), flagged AS (
    SELECT l.source, trim(l.line) AS line
    FROM numbered l JOIN per_host p ON l.source IS NOT DISTINCT FROM p.source
    WHERE trim(l.line) <> ''
    GROUP BY l.source, trim(l.line), p.pages
    HAVING count(DISTINCT l.doc_id) >= {MIN_PAGES}
        AND count(DISTINCT l.doc_id) > p.pages * {MAX_RATIO}::DOUBLE + {CONFIDENCE}::DOUBLE * sqrt(p.pages * {MAX_RATIO}::DOUBLE * {1 - MAX_RATIO}::DOUBLE)
), cleaned AS (
    SELECT l.doc_id,
        string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE f.line IS NULL) AS kept,
        count(f.line) AS dropped
    FROM numbered l LEFT JOIN flagged f ON l.source IS NOT DISTINCT FROM f.source AND trim(l.line) = f.line
    GROUP BY l.doc_id
)
SELECT p.doc_id, p.source,
    CASE WHEN p.text IS NOT NULL THEN coalesce(c.kept, '') END AS text,
    coalesce(c.dropped, 0)::INTEGER AS dropped_lines
FROM pages p LEFT JOIN cleaned c USING (doc_id)
"""


# A row's mark is its role's initial (o: any other), in lower case if it is cut off; b is blank, d repeated. Edits are moves between the
# states of s?(ua)+; the cheapest audits are carried from row to row.
OP11_SQL = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k
    FROM conversations
), coded AS (
    SELECT * EXCLUDE k, xor(4294967295::BIGINT, list_reduce(
        list_transform(range(octet_length(k)), lambda i: ('0x' || substr(hex(k), 2 * i + 1, 2))::BIGINT),
        lambda crc, byte: list_reduce(range(8), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, xor(crc, byte)),
        4294967295::BIGINT)) % 20 AS fault
    FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM coded
), placed AS (
    SELECT *, coalesce(conv_id::VARCHAR, 'none') AS conv, sha256(text) AS digest,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS r
    FROM damaged
), flagged AS (
    SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial,
        NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
        row_number() OVER (PARTITION BY conv, role, text ORDER BY r) > 1 AS is_repeated,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS is_cut,
        lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY r) AS before
    FROM placed
), marked AS (
    SELECT *, CASE WHEN is_blank THEN 'b' WHEN is_repeated THEN 'd' WHEN is_cut THEN initial ELSE upper(initial) END AS mark FROM flagged
), following(state, role, next) AS (
    VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), inserts(state, next, cost, letters, roles) AS (
    VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
        (0, 2, 3, 'I', 'u'), (0, 3, 6, 'II', 'ua'), (1, 2, 3, 'I', 'u'), (1, 3, 6, 'II', 'ua'), (2, 3, 3, 'I', 'a'), (3, 2, 3, 'I', 'u')
), marks(mark) AS (
    SELECT unnest(['S', 'U', 'A', 'O', 's', 'u', 'a', 'o', 'b', 'd'])
), edits AS (
    SELECT mark, state, state AS next, 4 AS cost, 'D' AS letters FROM marks, range(4) AS states(state)
    UNION ALL
    SELECT mark, state, next, CASE WHEN mark = lower(mark) THEN 3 ELSE 0 END, 'K' FROM marks JOIN following ON lower(mark) = role
    UNION ALL
    SELECT mark, state, next, 3 + CASE WHEN mark = lower(mark) THEN 3 ELSE 0 END, 'R' FROM marks, following WHERE mark NOT IN ('b', 'd') AND role <> 's'
), moves AS (
    SELECT e.mark, i.state, e.next, i.cost + e.cost AS cost, i.letters || e.letters AS letters FROM inserts i JOIN edits e ON i.next = e.state
), ways(conv, r, state, best) AS (
    SELECT DISTINCT conv, 0::BIGINT, 0, {'cost': 0, 'audit': ''} FROM marked
    UNION ALL
    SELECT w.conv, w.r + 1, m.next, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.letters})
    FROM ways w JOIN marked x ON w.conv = x.conv AND x.r = w.r + 1 JOIN moves m ON m.mark = x.mark AND m.state = w.state
    GROUP BY w.conv, w.r + 1, m.next
), chosen AS (
    SELECT w.conv, min({'cost': w.best.cost + i.cost, 'audit': w.best.audit || i.letters}) AS best
    FROM ways w JOIN (SELECT conv, max(r) AS n FROM marked GROUP BY conv) l ON w.conv = l.conv AND w.r = l.n
    JOIN inserts i ON w.state = i.state AND i.next IN (0, 3)
    GROUP BY w.conv
), letters AS (
    SELECT conv, k, audit[k] AS letter, audit,
        length(replace(audit[1:k], 'I', '')) AS r, length(replace(audit[1:k], 'D', '')) AS shown
    FROM (SELECT conv, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS k FROM chosen)
), shown AS (
    SELECT l.*, max(CASE WHEN l.letter = 'K' AND l.shown = 1 THEN (x.initial = 's')::INTEGER ELSE 0 END) OVER (PARTITION BY l.conv) AS leads,
        x.role, x.text
    FROM letters l LEFT JOIN marked x ON l.conv = x.conv AND l.r = x.r AND l.letter <> 'I'
    WHERE l.letter <> 'D'
), lines AS (
    SELECT conv, string_agg(
        CASE WHEN letter = 'K' THEN role WHEN (shown - leads) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END,
        chr(10) ORDER BY k) AS repaired
    FROM shown GROUP BY conv
), faults AS (
    SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (mark = 'b') AS blank,
        count(*) FILTER (mark = 'd') AS duplicate, count(*) FILTER (mark IN ('s', 'u', 'a', 'o')) AS truncated,
        count(*) FILTER (r > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM marked GROUP BY conv
)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate,
    coalesce(f.truncated, 0)::BIGINT AS truncated, coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(h.best.cost, 0)::BIGINT AS cost,
    coalesce(h.best.audit, '') AS audit, sha256(coalesce(l.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS conv FROM conversations) c
LEFT JOIN faults f ON c.conv = f.conv LEFT JOIN chosen h ON c.conv = h.conv LEFT JOIN lines l ON c.conv = l.conv
"""

# A control string becomes two letters; the template around role and text is 4 + 2 + 8 code points long.
OP12_SQL = r"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)
), sized AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r,
        14 + length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '###', '\h'), ':', '\c'))
           + length(replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '###', '\h')) AS chars
    FROM given
), summed AS (
    SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY r) AS so_far, count(*) OVER (PARTITION BY conv_id) AS n FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY r)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY r) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(so_far) FILTER (role = 'assistant' OR r = n)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""

OP13_SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
        sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), drawn AS (
    SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
        ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d
    FROM units
), formed AS (
    SELECT doc_id, text, n, coalesce(array_to_string(units[1:least(a, b)], ''), '') AS prefix,
        coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
        coalesce(array_to_string(units[greatest(a, b) + 1:], ''), '') AS suffix,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 50 THEN 'plain'
            WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM formed
"""

LLM_SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op11_repair": OP11_SQL,
    "op12_chat_format": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
