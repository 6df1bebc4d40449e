"""DuckDB counterparts of those queries that plain SQL can express over whole tables.

The plain form is worked out here character by character, with a table of characters and runs of one alphabet; it shares
the fixed values of the operator, but no expression with it.
"""

from __future__ import annotations

import unicodedata

from occura.llm import plainform as P


def _values(rows: list[tuple[int, str]]) -> str:
    return ", ".join(f"({cp}, '{text}')" for cp, text in rows)


def _ordinary() -> list[tuple[int, str]]:
    """(code point, plain text) of all characters of the blocks that have a plain letter or digit."""
    rows = [(cp, unicodedata.normalize("NFKC", chr(cp))) for lo, hi in (*P.BLOCKS, P.LIGATURES) for cp in range(lo, hi + 1)]
    return [(cp, t) for cp, t in rows if t != chr(cp) and t.isalnum()]


_SCRIPT = "[A-Za-z\\x{C0}-\\x{24F}]"


def plain_cte(name: str, source: str, column: str) -> str:
    """CTEs ending in ``name`` (v, p): the plain form p of every distinct value v of ``column`` in ``source``."""
    return f"""
{name}_v AS (SELECT DISTINCT {column} AS v FROM {source} WHERE {column} IS NOT NULL),
{name}_c AS (SELECT v, i, substr(v, i, 1) AS c FROM (SELECT v, unnest(range(1, length(v) + 1)) AS i FROM {name}_v)),
{name}_s AS (SELECT v, i, c, lag(c) OVER (PARTITION BY v ORDER BY i) AS ahead FROM {name}_c WHERE NOT regexp_matches(c, '[{P.INVISIBLE}]')),
{name}_m AS (SELECT v, i, CASE
    WHEN regexp_matches(c, '[{P.SPACES}]') THEN ' '
    WHEN c IN (chr(65438), chr(65439)) THEN chr(CASE WHEN unicode(ahead) BETWEEN 65382 AND 65437 THEN 12441 ELSE 12443 END + unicode(c) - 65438)
    ELSE coalesce(o.plain, c) END AS c
  FROM {name}_s LEFT JOIN (VALUES {_values(_ordinary())}) o (cp, plain) ON unicode(c) = o.cp),
{name}_k AS (SELECT v, i, c, l.twin, regexp_matches(c, '[\\p{{Latin}}\\p{{Cyrillic}}\\p{{Greek}}\\p{{Armenian}}\\p{{M}}0-9]') AS inside,
    regexp_matches(c, '[\\p{{Cyrillic}}\\p{{Armenian}}]') AS eastern, regexp_matches(c, '\\p{{Greek}}') AS greek, regexp_matches(c, '{_SCRIPT}') AS latin
  FROM {name}_m LEFT JOIN (VALUES {_values([(ord(a), b) for a, b in zip(P.CYRILLIC + P.GREEK + P.ARMENIAN + P.PHONETIC, P.CYRILLIC_LATIN + P.GREEK_LATIN + P.ARMENIAN_LATIN + P.PHONETIC_LATIN, strict=True)])}) l (cp, twin) ON unicode(c) = l.cp),
{name}_w AS (SELECT *, count(*) FILTER (NOT inside) OVER (PARTITION BY v ORDER BY i) AS word FROM {name}_k),
{name}_d AS (SELECT v, i, CASE WHEN twin IS NOT NULL AND NOT bool_or(eastern AND twin IS NULL) OVER w AND (bool_or(latin) OVER w
    OR bool_or(eastern) OVER w AND bool_or(greek) OVER w AND NOT bool_or(greek AND twin IS NULL) OVER w) THEN twin ELSE c END AS c
  FROM {name}_w WINDOW w AS (PARTITION BY v, word, inside)),
{name} AS (SELECT v, nfc_normalize(coalesce(string_agg(c, '' ORDER BY i), '')) AS p FROM {name}_v LEFT JOIN {name}_d USING (v) GROUP BY v)"""


def key_of(plain: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({plain}), '[\\p{{L}}\\p{{N}}]'), '')"


_P4 = """
WITH asked AS (
  SELECT DISTINCT i.company_normalized, o.canonical_question_id
  FROM occurrence o JOIN interview i ON o.interview_id = i.id
  WHERE i.company_normalized IS NOT NULL AND o.canonical_question_id IS NOT NULL),
scored AS (SELECT id, max(occurrence_count) AS n FROM canonical GROUP BY id)
SELECT company_normalized, CAST(row_number() OVER (PARTITION BY company_normalized ORDER BY n DESC NULLS LAST, canonical_question_id) AS INTEGER) AS rank_no, canonical_question_id
FROM asked JOIN scored ON canonical_question_id = scored.id
QUALIFY rank_no <= 5
"""

# All pairs of questions that share a piece, counted piece by piece.
_PAIRS = f"""
{plain_cte("plain", "canonical", "canonical_text")},
c AS (SELECT id, min(batch_no) AS batch_no, min({key_of("p")}) AS k FROM (SELECT DISTINCT id, batch_no, canonical_text FROM canonical) t LEFT JOIN plain ON t.canonical_text = plain.v GROUP BY id),
g AS (SELECT DISTINCT id, substr(k, i, 2) AS piece FROM c, LATERAL (SELECT unnest(range(1, length(k))) AS i)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
o AS (SELECT a.id AS ia, b.id AS ib, count(*) AS s FROM g a JOIN g b ON a.piece = b.piece AND a.id < b.id GROUP BY ALL),
alike AS (SELECT ia, ib FROM o JOIN n x ON x.id = ia JOIN n y ON y.id = ib WHERE 10 * s >= 7 * (x.n + y.n - s))
"""
_CLASSES = f"""
WITH {_PAIRS}, m AS (SELECT id, k, min(id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS class_size FROM c WHERE k IS NOT NULL),
pair AS (SELECT ia AS a, ib AS b FROM alike UNION ALL SELECT ib, ia FROM alike),
l AS (SELECT a AS id, count(DISTINCT y.k) AS links FROM pair JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.k <> y.k GROUP BY 1)
SELECT m.id, class_id, class_size, coalesce(links, 0) AS links FROM m LEFT JOIN l ON l.id = m.id
"""
_HASH = "regexp_replace(regexp_replace(regexp_replace(lower(raw_file_hash), '^\\s*(sha-?256|0x)[:=\\s-]*', ''), '[\\s:_-]+', '', 'g'), '^0x', '')"
_P2 = f"""
WITH {_PAIRS},
pair AS (SELECT ia AS a, ib AS b FROM alike UNION ALL SELECT ib, ia FROM alike),
f AS (SELECT DISTINCT id, batch_no, {_HASH} AS h FROM source_revision WHERE regexp_full_match({_HASH}, '[0-9a-f]{{64}}')),
met AS (
  SELECT 'canonical' AS table_name, x.id, y.batch_no, y.id AS other FROM pair JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE y.batch_no < x.batch_no
  UNION ALL SELECT 'source_revision', x.id, y.batch_no, y.id FROM f x JOIN (SELECT h, min(batch_no) AS batch_no, arg_min(id, (batch_no, id)) AS id FROM f GROUP BY h) y ON x.h = y.h AND y.batch_no < x.batch_no),
best AS (SELECT table_name, id, arg_min(other, (batch_no, other)) AS other FROM met GROUP BY ALL)
SELECT table_name, least(id, other) AS id_a, greatest(id, other) AS id_b FROM best
"""


def _changed(table: str, column: str) -> str:
    return f"SELECT DISTINCT '{table}' AS table_name, t.id AS row_id, v AS original, p AS plain_form FROM {table} t JOIN {column}_p ON t.{column} = v WHERE p <> v"


_P3 = f"WITH {plain_cte('company_raw_p', 'interview', 'company_raw')}, {plain_cte('canonical_text_p', 'canonical', 'canonical_text')}, x AS ({_changed('interview', 'company_raw')} UNION ALL {_changed('canonical', 'canonical_text')})"


def oracle_sql() -> dict:
    return {
        "p2_found": _P2,
        "p3_found": f"{_P3} SELECT table_name, row_id FROM x",
        "p3_plain_values": f"{_P3} SELECT row_id, original, plain_form FROM x",
        "p4_found": _P4,
        "p5_found": f"WITH {_PAIRS} SELECT ia AS id_a, ib AS id_b FROM alike",
        "p5_question_classes": _CLASSES,
    }
