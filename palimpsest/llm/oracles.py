"""DuckDB SQL for the queries of this folder that SQL can express, made from the operators' own constants."""

from __future__ import annotations

from palimpsest.llm import chat, license_scan


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped_length(column: str) -> str:
    slashes = f"length({column}) - length(replace({column}, chr(92), ''))"
    doubled = f"replace({column}, chr(92), chr(92) || chr(92))"
    controls = " + ".join(f"(length({doubled}) - length(replace({doubled}, {_quoted(c)}, ''))) // {len(c)}" for c in chat.CONTROL)
    return f"length({column}) + {slashes} + {controls}"


_frame = len(chat.START) + len(chat.MIDDLE) + len(chat.END)
CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum({_frame} + {_escaped_length('role')} + {_escaped_length('text')}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

NGRAM_JOIN = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
k AS (SELECT doc_id, list_sort(s) AS s, min(doc_id) OVER (PARTITION BY list_sort(s)) AS copy_of, count(*) OVER (PARTITION BY list_sort(s)) AS n_copies FROM s),
t AS (SELECT doc_id, n_copies, len(s) AS n, unnest(s) AS g FROM k WHERE doc_id = copy_of),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, max(b.n_copies) AS copies FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 0.8 * (max(a.n) + max(b.n) - count(*))),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
c AS (SELECT a, least(a, min(b)) AS class_id FROM reach GROUP BY a), l AS (SELECT a, count(*) AS n_texts, CAST(sum(copies) AS BIGINT) AS n_docs FROM p GROUP BY a)
SELECT doc_id, coalesce(class_id, copy_of) AS class_id, copy_of, n_copies, n_copies - 1 + coalesce(n_docs, 0) AS n_links, coalesce(n_texts, 0) AS n_text_links FROM k LEFT JOIN c ON copy_of = c.a LEFT JOIN l ON copy_of = l.a"""


def _license() -> str:
    rows = []
    for number, (phrase, label) in enumerate([*license_scan.BASE.items(), *license_scan.SENTENCES.items()]):
        own, base = phrase.split(), number < len(license_scan.BASE)
        k = license_scan.PAIR if base else license_scan.QUAD
        rows += [f"({number}, '{label}', {str(base).lower()}, {len(own) - k + 1}, {p}, '{' '.join(own[p : p + k])}')" for p in range(len(own) - k + 1)]
    return rf"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, spot, w[spot + 1:spot + 2] AS pair, w[spot + 1:spot + 4] AS quad FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS spot FROM d)),
h AS (SELECT doc_id, spot, array_to_string(pair, ' ') AS gram FROM g WHERE len(pair) = 2 UNION ALL SELECT doc_id, spot, array_to_string(quad, ' ') FROM g WHERE len(quad) = 4),
t(template, label, is_base, grams, place, gram) AS (VALUES {', '.join(rows)}),
v AS (SELECT doc_id, template, label, is_base, grams, spot - place AS diagonal, count(*) AS n, list(place) AS places FROM h JOIN t USING (gram) GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list_sort(list_distinct(list(label))) AS found FROM v WHERE is_base AND n = grams GROUP BY doc_id),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER x <= {license_scan.SLACK} THEN 0 ELSE 1 END AS opens FROM v WHERE NOT is_base WINDOW x AS (PARTITION BY doc_id, template ORDER BY diagonal)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM o),
c AS (SELECT doc_id, template, label, len(list_distinct(flatten(list(places)))) / max(grams) AS covered FROM r GROUP BY doc_id, template, label, run),
m AS (SELECT doc_id, list(label) AS found, max(covered) AS covered FROM c WHERE covered >= {license_scan.COVERED} GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b.found, ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(m.found, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(covered, 0.0) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)"""


ORACLES = {"op4_chat": CHAT, "op5_ngram_join": NGRAM_JOIN, "op6_license_scan": _license()}
