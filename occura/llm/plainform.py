"""Bringing text whose characters differ but look alike to one plain form.

DuckDB runs inside every Arrow partition: the whole transformation is embedded SQL made of ``translate``,
``regexp_replace`` and ``nfc_normalize``, so no row passes through a Python function.

Plain form of a text:
  * letters and digits of full (or half) width have their ordinary width, and a half-width kana takes its voicing
    mark in; Chinese punctuation keeps its own;
  * bold, script and other mathematical letters and digits, and ligatures, become ordinary letters;
  * radicals and compatibility ideographs become the ordinary Chinese character;
  * invisible characters (zero width, joiners, direction marks, soft hyphen, variation selectors) are gone;
  * every kind of space is U+0020; tabs and line ends stay; nothing is trimmed or collapsed;
  * a Cyrillic, Greek or Armenian letter with a Latin twin becomes that twin if its word also has Latin letters, or
    mixes these alphabets; words wholly in another alphabet and Greek symbols stay, and so do circled numbers and
    Roman numerals, which readers do type;
  * letters and combining accents are composed (NFC).
Null gives null, the empty text gives the empty text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin twins of Cyrillic, Greek and Armenian letters and of phonetic signs, in natural order.
CYRILLIC = "АВЕЅІЈКМНОРСТУХЬаеѕіјорсухґԁԌԍԛԜԝһӏ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXbaesijopcyxrdGGqWwhl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧινοϲϳϹ"
GREEK_LATIN = "ABEZHIKMNOPTYXivocjC"
ARMENIAN = "ՍՕհոսցօ"
ARMENIAN_LATIN = "UOhnugo"
PHONETIC = "ɑɡ"
PHONETIC_LATIN = "ag"
# Characters without a shape, and spaces other than U+0020, as regular-expression classes.
INVISIBLE = r"\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0100}-\x{E01EF}"
SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Characters that no rule touches: a text made of these alone is plain as it stands.
ORDINARY = r"\t\n\r -~\x{A1}-\x{AC}\x{AE}-\x{24F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{309B}-\x{30FF}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}"
#: Blocks whose letters and digits have an ordinary form: radicals, compatibility ideographs, widths, styled letters.
BLOCKS = ((0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F), (0xFF01, 0xFFDC), (0x1D400, 0x1D7FF))
#: Ligatures, which become several letters.
LIGATURES = (0xFB00, 0xFB06)
# Half-width voicing marks, what they become behind a half-width kana, and alone.
VOICING = (("\uff9e", "\u3099", "\u309b"), ("\uff9f", "\u309a", "\u309c"))


def _pairs(lo: int, hi: int) -> tuple[str, str]:
    """Single letters and digits of a block and what ``translate`` maps them to, by rule from the Unicode tables."""
    frm, to = [], []
    for cp in range(lo, hi + 1):
        plain = unicodedata.normalize("NFKC", chr(cp))
        if len(plain) == 1 and plain != chr(cp) and (plain.isalnum() or lo not in (0xFF01, 0x1D400) and unicodedata.category(plain)[0] != "M"):
            frm.append(chr(cp))
            to.append(plain)
    return "".join(frm), "".join(to)


_MAPS = [(lo, hi, *_pairs(lo, hi)) for lo, hi in BLOCKS]
_TWINS, _LATIN = CYRILLIC + GREEK + ARMENIAN + PHONETIC, CYRILLIC_LATIN + GREEK_LATIN + ARMENIAN_LATIN + PHONETIC_LATIN
_ALPHABETS = r"\p{Latin}\p{Cyrillic}\p{Greek}\p{Armenian}"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain_steps(column: str) -> list[str]:
    """DuckDB expressions of the steps; each reads the one before as ``t``, the first reads ``column``.

    Every step tests for its characters first, since most texts have none of them.
    """
    steps = [f"regexp_replace(regexp_replace({column}, '[{INVISIBLE}]', '', 'g'), '[{SPACES}]', ' ', 'g')"]
    voiced = "t"
    for mark, behind, alone in VOICING:
        voiced = rf"replace(regexp_replace({voiced}, '([\x{{FF66}}-\x{{FF9D}}]){mark}', '\1{behind}', 'g'), '{mark}', '{alone}')"
    steps.append(f"CASE WHEN regexp_matches(t, '[{VOICING[0][0]}{VOICING[1][0]}]') THEN {voiced} ELSE t END")
    steps += [rf"CASE WHEN regexp_matches(t, '[\x{{{lo:X}}}-\x{{{hi:X}}}]') THEN translate(t, {_quote(frm)}, {_quote(to)}) ELSE t END" for lo, hi, frm, to in _MAPS]
    joined = "t"
    for cp in range(LIGATURES[0], LIGATURES[1] + 1):
        joined = f"replace({joined}, '{chr(cp)}', '{unicodedata.normalize('NFKC', chr(cp))}')"
    steps.append(rf"CASE WHEN regexp_matches(t, '[\x{{{LIGATURES[0]:X}}}-\x{{{LIGATURES[1]:X}}}]') THEN {joined} ELSE t END")
    twins, latin = _quote(_TWINS), _quote(_LATIN)
    rest = f"translate(w, {twins}, '')"
    mixed = (
        rf"regexp_matches(w, '[{_TWINS}]') AND ((regexp_matches(w, '[A-Za-z\x{{C0}}-\x{{24F}}]') AND NOT regexp_matches({rest}, '[\p{{Cyrillic}}\p{{Armenian}}]'))"
        rf" OR (regexp_matches(w, '[\p{{Cyrillic}}\p{{Armenian}}]') AND regexp_matches(w, '\p{{Greek}}') AND NOT regexp_matches({rest}, '[\p{{Cyrillic}}\p{{Greek}}\p{{Armenian}}]')))"
    )
    words = rf"regexp_extract_all(t, '[{_ALPHABETS}\p{{M}}0-9]+|[^{_ALPHABETS}\p{{M}}0-9]+')"
    steps.append(f"CASE WHEN regexp_matches(t, '[{_TWINS}]') THEN array_to_string(list_transform({words}, lambda w: CASE WHEN {mixed} THEN translate(w, {twins}, {latin}) ELSE w END), '') ELSE t END")
    steps.append("nfc_normalize(t)")
    return steps


def _plain_query(source: str) -> str:
    """SELECT giving (i, v, p) of the rows (i, v) of ``source``; p is the plain form of v."""
    first, *others = plain_steps("v")
    sql = f"SELECT i, v, {first} AS t FROM {source} WHERE regexp_matches(v, '[^{ORDINARY}]')"
    for step in others:
        sql = f"SELECT i, v, {step} AS t FROM ({sql})"
    return f"SELECT i, v, t AS p FROM ({sql}) UNION ALL SELECT i, v, v FROM {source} WHERE v IS NULL OR NOT regexp_matches(v, '[^{ORDINARY}]')"


def key_sql(plain: str) -> str:
    """DuckDB expression for the comparison key: lower case, letters and digits only."""
    return rf"regexp_replace(lower({plain}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def with_plain_form(df: DataFrame, column: str, plain: str | None = None, key: str | None = None) -> DataFrame:
    """``df`` with the plain form of ``column`` in ``plain`` and/or its comparison key in ``key``.

    Columns of these names that exist already are replaced; all others pass through untouched.
    """
    out = [c for c in (plain, key) if c]
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in out or c == column])
    if column in out:
        raise ValueError("the plain form needs a column of its own")
    # Names of its own on the way through Arrow, so that no name of the table can be in the way.
    names = [f"c{i}" for i in range(len(kept.columns))]
    at = kept.columns.index(column)
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, kept.schema.fields, strict=True)] + [T.StructField(f"out{i}", T.StringType(), True) for i in range(len(out))])
    sql = f"SELECT p{', ' + key_sql('p') + ' AS k' if key else ''} FROM ({_plain_query('arrived')}) ORDER BY i"

    def run(batches: Iterator) -> Iterator:
        import duckdb
        import pyarrow as pa

        con = duckdb.connect(":memory:", config={"threads": 1})
        for batch in batches:
            # Equal values are transformed once per batch.
            coded = batch.column(at).cast(pa.string()).dictionary_encode()
            con.register("arrived", pa.table({"i": pa.array(range(len(coded.dictionary)), pa.int32()), "v": coded.dictionary}))
            got = con.sql(sql).to_arrow_table().combine_chunks()
            con.unregister("arrived")
            parts = {plain: "p", key: "k"}
            made = [_whole(got.column(parts[c])).take(coded.indices) for c in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)
        con.close()

    return kept.toDF(*names).mapInArrow(run, schema).toDF(*kept.columns, *out)


def _whole(column):
    import pyarrow as pa

    return pa.concat_arrays(column.chunks).cast(pa.string()) if column.num_chunks else pa.array([], pa.string())


def changed_rows(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """Rows whose text is not in plain form: (row_id, original, plain_form); repeated rows count once."""
    base = df.select(F.col(f"`{id_column}`").alias("row_id"), F.col(f"`{column}`").alias("original")).where("original IS NOT NULL")
    return with_plain_form(base, "original", plain="plain_form").where("plain_form <> original").dropDuplicates(["row_id"])
