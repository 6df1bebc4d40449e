from __future__ import annotations

from datetime import date

import pytest

from occura import corpus
from occura.operators import analytics as A
from occura.operators.filters import FilterSpec, apply
from tests import corpora

AS_OF = date(2026, 9, 30)


@pytest.fixture(scope="module")
def seed(spark, tmp_path_factory):
    d = corpora.write(spark, str(tmp_path_factory.mktemp("seed")), corpora.seed_tables())
    return corpus.active_occurrences(spark, d).persist()


@pytest.fixture(scope="module")
def ranked(spark, tmp_path_factory):
    extra = [(f"x{i:02}-{k:02}", f"q{i:02}", "CODING", "algo.x") for i in range(50) for k in range(50 - i)]
    d = corpora.write(spark, str(tmp_path_factory.mktemp("ranked")), corpora.seed_tables(extra))
    return corpus.active_occurrences(spark, d).where("canonical_question_id LIKE 'q%'").persist()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_conditions_hold_for_one_occurrence(seed):
    got = A.grouped(apply(seed, FilterSpec(company="字节", round="SECOND")), "question", AS_OF)
    assert rows(got, "key", "occurrence_count") == [("persistence", 1)]


def test_repeated_rows_count_once_and_windows_drop_unknown_dates(seed):
    assert seed.count() == 3
    window = FilterSpec(start=date(2026, 6, 30), end=date(2026, 10, 1))
    assert apply(seed, window).count() == 2
    assert A.date_coverage(seed, window, apply).first().unknown_date_count == 1


def test_group_measures(seed):
    assert rows(A.grouped(seed, "question", AS_OF), "key", "occurrence_count", "interview_count", "company_count", "recent_count") == [("fast", 2, 2, 2, 2), ("persistence", 1, 1, 1, 0)]
    assert rows(A.grouped(seed, "topic_l1", AS_OF), "key", "occurrence_count") == [("redis", 3)]
    assert rows(A.time_buckets(seed, "question", "month"), "key", "bucket", "occurrences") == [("fast", "2026-08", 2)]


def test_importance_and_gap(spark, seed):
    scored = A.scored(A.grouped(seed, "question", AS_OF), A.totals(seed))
    assert [(k, round(s, 9), b) for k, s, b in rows(scored, "key", "importance_score", "importance_band")] == [("fast", 1.0, "CORE"), ("persistence", 0.465464877, "COMMON")]
    unseen = spark.createDataFrame([], "canonical_question_id string, user_status string")
    gaps = dict(rows(A.with_gap(scored, unseen), "key", "gap_score"))
    assert gaps == {"fast": 0.8, "persistence": pytest.approx(0.3723719014, abs=1e-8)}  # scores are rounded to nine digits
    odd = spark.createDataFrame([("fast", "SOMETHING")], "canonical_question_id string, user_status string")
    assert dict(rows(A.with_gap(scored, odd), "key", "gap_score"))["fast"] == 0.0


@pytest.mark.parametrize(
    ("statuses", "expected"),
    [(["UNSEEN"], (1, 1, 1, 1, 1)), (["MASTERED"], (1, 2, 2, 2, 2)), (["WEAK"], (0, 0, 0, 0, 0)), (["UNSEEN", "WEAK", "UNSEEN"], (1, 1, 1, 1, 1)), (["UNSEEN", "MASTERED"], (2, 3, 3, 3, 2))],
)
def test_count_by_review_status(spark, seed, statuses, expected):
    states = spark.createDataFrame([("fast", "MASTERED")], "canonical_question_id string, user_status string")
    assert tuple(A.count_scope(A.review_scope(seed, states, statuses)).first()) == expected


def test_top_n_and_review_filter_before_or_after(spark, ranked):
    groups = A.grouped(ranked, "question", AS_OF)
    states = spark.createDataFrame([("q00", "MASTERED"), ("q01", "MASTERED")], "canonical_question_id string, user_status string")
    with_status = A.with_gap(A.scored(groups, A.totals(ranked)), states)
    top = A.top_ranked(with_status, "occurrence_count", 40)
    assert [r.key for r in top.orderBy("rank").collect()] == [f"q{i:02}" for i in range(40)]
    assert [r.occurrence_count for r in top.orderBy("rank").collect()] == list(range(50, 10, -1))
    before = A.top_ranked(with_status.where("user_status = 'UNSEEN'"), "occurrence_count", 40)
    assert {r.key for r in before.collect()} == {f"q{i:02}" for i in range(2, 42)}
    assert {r.key for r in top.where("user_status = 'UNSEEN'").collect()} == {f"q{i:02}" for i in range(2, 40)}


def test_keyset_pages_add_up_to_one_sort(ranked):
    groups = A.scored(A.grouped(ranked, "question", AS_OF), A.totals(ranked)).select("key", "importance_score").persist()
    whole = [(r.importance_score, r.key) for r in groups.orderBy("importance_score", ascending=False).collect()]
    got, last = [], (2.0, "")
    while True:
        page = A.page_after(groups, "importance_score", last[0], last[1], 7).collect()
        if not page:
            break
        got += [(r.importance_score, r.key) for r in page]
        last = got[-1]
    assert got == sorted(whole, key=lambda x: (-x[0], x[1]))


def test_task_filters(spark, ranked):
    ids = [r.occurrence_id for r in ranked.select("occurrence_id").limit(6).collect()]
    labels = spark.createDataFrame(
        [(ids[0], "CODE", "MIXED", "VERIFIED"), (ids[1], "CODE", "ENGINEERING", "AUTO"), (ids[2], "UNKNOWN", "NONE", "AUTO"), (ids[3], "VERBAL", "ALGORITHM", "VERIFIED")],
        "occurrence_id string, response_form string, coding_focus string, status string",
    )
    hit = lambda **k: {r.occurrence_id for r in apply(ranked, FilterSpec(**k), labels).collect()}
    assert hit(coding_focus="ALGORITHM") == {ids[0], ids[3]}
    assert hit(coding_focus="ENGINEERING") == {ids[0], ids[1]}
    assert hit(annotation_status="KNOWN") == {ids[0], ids[1], ids[3]}
    assert hit(annotation_status="UNKNOWN") == {r.occurrence_id for r in ranked.collect()} - {ids[0], ids[1], ids[3]}
    cover = A.task_coverage(ranked, labels).first()
    assert (cover.classified, cover.uncertain, cover.verified, cover.needs_review) == (3, 1, 2, 2)
    assert cover.pending == cover.occurrences - 4
    with pytest.raises(ValueError, match="labels"):
        apply(ranked, FilterSpec(coding_focus="ALGORITHM"))


def test_specification_is_checked():
    with pytest.raises(ValueError, match="window"):
        FilterSpec(start=date(2026, 1, 2), end=date(2026, 1, 2))
    with pytest.raises(ValueError, match="basis"):
        FilterSpec(date_basis="SOMEDAY")


def test_language_is_membership_not_substring(spark, tmp_path):
    t = corpora.seed_tables()
    t["interview"] = [(*r[:5], ["JavaScript"], *r[6:]) if r[0] == "i1" else r for r in t["interview"]]
    active = corpus.active_occurrences(spark, corpora.write(spark, str(tmp_path / "d"), t))
    assert {r.occurrence_id for r in apply(active, FilterSpec(language="java")).collect()} == {"o2", "o3"}


def test_empty_tables(spark, tmp_path):
    active = corpus.active_occurrences(spark, corpora.write(spark, str(tmp_path / "e"), {}))
    assert A.scored(A.grouped(active, "question", AS_OF), A.totals(active)).count() == 0
    assert tuple(A.totals(active).first()) == (0, 0, 0, 0)
    assert A.top_ranked(A.scored(A.grouped(active, "company", AS_OF), A.totals(active)), "importance_score", 5).count() == 0
