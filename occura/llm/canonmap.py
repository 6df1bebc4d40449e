"""Mapping freely typed values to the entry of a reference list that is meant.

Distinct values only are looked at, however many rows carry them:
  1. plain form and normalisation give each value its keys: the whole value and, if separators divide it, its parts;
  2. the reference list (names, foreign names, aliases) is an inverted index of character n-grams (single Chinese
     characters, pairs, pairs with a gap, both ends); a key's n-grams retrieve candidates by an equi-join;
  3. candidates are scored by weighted cosine. An n-gram of the list weighs by how few spellings have it; one that the
     list lacks weighs by how few distinct values have it, and nothing once more than ``DECORATION`` of them do: legal
     forms, places, levels and remarks around a name are learned from the values, not listed;
  4. the best entry is accepted if its score reaches the threshold and leads the next entry by the margin. Everything
     else is reported as unmatched (``UNMATCHED``).
That a value only describes its relation to an entry ("supplier of ...") cannot be counted from values, since such
phrases go with many names as legal forms do; a field's rules may list these phrases.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occura.llm.common import broadcast_small, materialize, scratch_path, write_table
from occura.llm.plainform import with_plain_form

UNMATCHED = -1
#: Share of the distinct values above which an n-gram that the list lacks is decoration.
DECORATION = 0.002
#: Weight of an n-gram that a single value has and the list lacks, as a share of the largest weight of the list.
UNKNOWN = 0.6
#: Score of a part of a value, as a share of what the whole value would get; of any spelling that is not equal.
PART, UNEQUAL = 0.97, 0.999


@dataclass(frozen=True)
class Rules:
    """How a field's values are accepted; ``relations`` is a pattern over lower-case plain text."""

    threshold: float = 0.5
    margin: float = 0.01
    relations: str = ""


# Phrases that name an entry only to describe another employer.
COMPANY = Rules(
    relations="供应商|代理商|经销商|外包|前员工|前同事|离职员工|不是|并非|而非|合作方|合作伙伴|竞争对手|竞品|友商|的客户|的乙方|对标|挂靠|加盟商|收购方|\\b(?:supplier|vendor|reseller|contractor|outsourc\\w*|distributor|agent|competitor|subcontract\\w*) (?:of|to|for)\\b|\\bnot\\b|\\bex-|\\bformer(?:ly)?\\b",
)
POSITION = Rules()

_SEPARATORS = re.compile(r"[\W_]+")
_ACCENTED = re.compile("[\u00c0-\u024f\u1e00-\u1eff]")


def fold(text: str) -> str:
    """Lower case, and Latin letters without their accents (they are often left out when typing)."""
    return _ACCENTED.sub(lambda m: unicodedata.normalize("NFD", m[0])[0], text.lower())


def keys_of(plain: str | None) -> list[tuple[str, bool]]:
    """(key, whether it is the whole value): letters and digits of a plain value, and of its parts of two or more."""
    parts = [p for p in _SEPARATORS.split(fold(plain or "")) if p]
    whole = "".join(parts)
    return [(whole, True)] * bool(whole) + [(p, False) for p in sorted(set(parts)) if p != whole and len(p) > 1]


def _grams(col: str) -> F.Column:
    """Single Chinese characters, pairs, pairs with a gap and both ends of a key, each once."""
    k, n = F.col(col), F.length(col)
    at = lambda shift: F.sequence(F.lit(1), F.greatest(n - shift, F.lit(1)))
    one = F.filter(F.split(k, ""), lambda c: c > F.lit("\u2e7f"))
    two = F.when(n > 1, F.transform(at(1), lambda i: F.substring(k, i, F.lit(2))))
    gap = F.when(n > 2, F.transform(at(2), lambda i: F.concat(F.substring(k, i, F.lit(1)), F.lit("_"), F.substring(k, i + 2, F.lit(1)))))
    ends = F.when(n > 1, F.array(F.concat(F.lit("^"), F.left(k, F.lit(1))), F.concat(F.right(k, F.lit(1)), F.lit("$"))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(one, *[F.coalesce(x, none) for x in (two, gap, ends)]))


def reference_names(ref: DataFrame, ref_id: str, names: list[str], alias_lists: list[str]) -> DataFrame:
    """(ref_id, name): every spelling of every entry, in plain lower-case letters and digits."""
    listed = F.array(*[F.col(f"`{c}`") for c in names])
    for c in alias_lists:
        listed = F.concat(listed, F.coalesce(F.col(f"`{c}`"), F.array().cast("array<string>")))
    spelled = ref.select(F.col(f"`{ref_id}`").cast("int").alias("ref_id"), F.explode(F.array_distinct(listed)).alias("spelled")).where("ref_id IS NOT NULL AND spelled IS NOT NULL")

    def folded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_SEPARATORS.sub("", fold(x)) for x in b.column(1).to_pylist()], pa.string())], names=["ref_id", "name"])

    plain = with_plain_form(spelled, "spelled", plain="plain").select("ref_id", "plain")
    return materialize(plain.mapInArrow(folded, "ref_id int, name string").where("name <> ''").distinct())


def map_values(values: DataFrame, value: str, reference: DataFrame, rules: Rules) -> DataFrame:
    """(value, ref_id, score) for every distinct non-null value; ref_id is UNMATCHED and score null where none is meant.

    ``reference`` is the result of :func:`reference_names`. Ties between entries are unmatched; an empty list
    leaves everything unmatched. The result is a table in the shared folder, worked out once.
    """
    spark = values.sparkSession
    distinct = values.select(F.col(f"`{value}`").cast("string").alias("value")).where("value IS NOT NULL").distinct()
    relations = re.compile(rules.relations) if rules.relations else None

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            v, k, w, r = [], [], [], []
            for text, plain in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                related = bool(relations and plain and relations.search(plain.lower()))
                for key, whole in keys_of(plain) or [(None, True)]:
                    v.append(text), k.append(key), w.append(whole), r.append(related)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()), pa.array(k, pa.string()), pa.array(w, pa.bool_()), pa.array(r, pa.bool_())], names=["value", "key", "whole", "related"])

    # A number of its own: the distinct values are few bytes, which adaptive execution would put into one task.
    spread = distinct.repartition(spark.sparkContext.defaultParallelism, "value")
    keys = write_table(with_plain_form(spread, "value", plain="plain").mapInArrow(make, "value string, key string, whole boolean, related boolean"), scratch_path(spark, "keys"))

    # Inverted index over the list: n-gram -> spellings, weighted by rarity among the spellings. w2 is a weight squared.
    posted = reference.select("ref_id", "name", F.explode(_grams("name")).alias("gram"))
    spellings = reference.count()
    weight = posted.groupBy("gram").agg((0.5 - F.log(F.count("*") / F.lit(spellings + 1.0))).alias("w"))
    index = posted.join(weight, "gram").withColumn("w2", F.col("w") * F.col("w"))
    norms = index.groupBy("ref_id", "name").agg(F.sqrt(F.sum("w2")).alias("name_norm"))
    index = materialize(index.join(norms, ["ref_id", "name"]).select("gram", "ref_id", "name", "name_norm", "w2"))
    listed = broadcast_small(index.groupBy("gram").agg(F.max("w2").alias("w2")), 1_000_000)

    # What the list lacks is counted over the distinct whole values.
    grams = keys.where("key IS NOT NULL").groupBy("key").agg(F.max("whole").alias("whole")).select("key", "whole", F.explode(_grams("key")).alias("gram")).join(listed, "gram", "left")
    grams = write_table(grams, scratch_path(spark, "grams"))
    wholes = keys.where("whole AND key IS NOT NULL").select("key").distinct().count()
    often = max(DECORATION * wholes, 2.0)
    lacking = grams.where("w2 IS NULL AND whole").groupBy("gram").agg(F.count("*").alias("n"))
    # Those that a single value has need no row: that is what a missing one says.
    most = UNKNOWN * math.log(spellings + 1.0)
    lacking = broadcast_small(lacking.where("n > 1").select("gram", F.greatest(F.lit(0.0), most * (1 - F.log("n") / math.log(often))).alias("other")), 1_000_000)
    alone = F.pow(F.coalesce("other", F.lit(most)), 2)
    key_norms = grams.join(lacking, "gram", "left").groupBy("key").agg(F.sqrt(F.sum(F.coalesce("w2", alone))).alias("key_norm"))
    dots = grams.where("w2 IS NOT NULL").select("key", "gram").join(broadcast_small(index, 1_000_000), "gram").groupBy("key", "ref_id", "name", "name_norm").agg(F.sum("w2").alias("dot"))
    score = F.when(F.col("key") == F.col("name"), 1.0).otherwise(F.least(F.lit(UNEQUAL), F.col("dot") / (F.col("key_norm") * F.col("name_norm"))))
    # Below the threshold by more than the margin a candidate can neither be accepted nor hinder another.
    scored = dots.join(key_norms, "key").withColumn("score", score).where(F.col("score") >= rules.threshold - rules.margin).groupBy("key", "ref_id").agg(F.max("score").alias("score"))
    met = keys.join(scored, "key").withColumn("score", F.when(F.col("whole"), F.col("score")).otherwise(F.col("score") * PART)).where("NOT related OR (whole AND score = 1.0)")
    best = met.groupBy("value", "ref_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("value").orderBy(F.desc("score"), "ref_id")
    ranked = best.withColumn("place", F.row_number().over(by_score)).withColumn("next", F.coalesce(F.lead("score").over(by_score), F.lit(-1.0)))
    decided = ranked.where((F.col("place") == 1) & (F.col("score") >= rules.threshold) & (F.col("score") - F.col("next") >= rules.margin) & (F.col("score") > F.col("next")))
    found = keys.select("value").distinct().join(decided.select("value", "ref_id", "score"), "value", "left")
    return write_table(found.select("value", F.coalesce("ref_id", F.lit(UNMATCHED)).alias("ref_id"), "score"), scratch_path(spark, "mapped"))
