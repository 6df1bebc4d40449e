from __future__ import annotations

from dataclasses import fields
from datetime import date

import pytest

from occura.operators.filters import FilterSpec
from occura.plans import execute
from occura.plans import surface as S
from occura.plans.plan import Plan
from tests import corpora

EVERY = {f.name: None for f in fields(FilterSpec)}
TODAY, TOMORROW = date(2026, 5, 31), date(2026, 6, 1)


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        ({"action": "LIST", "filters": EVERY, "sort": "frequency", "top_n": None, "page_size": 20}, []),
        ({"action": "STATS", "filters": EVERY, "sort": "frequency", "top_n": None, "page_size": 20}, ["group_by"]),
        ({"action": "SEARCH", "filters": {k: v for k, v in EVERY.items() if k != "round"}}, ["filters.round", "page_size", "pipeline", "search_query", "sort", "top_n"]),
        ({}, ["action", "filters", "page_size", "sort", "top_n"]),
    ],
)
def test_missing(payload, want):
    assert S.missing(payload) == want


def test_explicit_filters():
    given = {"company": None, "question_type": None, "round": "HR"}
    assert S.explicit_filters(given) == {"question_type": None, "round": "HR"}
    assert S.explicit_filters(given, again=True) == given


def test_policy():
    allowed, refused = S.policy({}, True)
    assert "NEXT" not in allowed["list_questions"] and refused == {"get_question_details": "displayed_page_required", "get_review_state": "question_scope_required", "record_review": "displayed_page_required"}
    allowed, refused = S.policy({"page": ["a"], "cursor": "c", "group_by": None}, True)
    assert allowed["list_questions"] == ("LIST", "CLARIFY", "NEXT") and allowed["record_review"] == ("RECORD_REVIEW",) and refused == {}
    assert S.policy({"page": ["a"]}, False)[1] == {"record_review": "explicit_write_request_required"}
    assert S.policy({"page": ["a"]}, True, read_only=True)[1] == {"record_review": "historical_requery_is_read_only"}
    assert "get_review_state" in S.policy({"group_by": "company"}, False)[1] and "get_review_state" in S.policy({"group_by": "question"}, False)[0]
    assert S.policy({"page": ["a"]}, True, remaining=0)[0] == {}


def test_focus():
    turns = [
        {"ordinal": 3, "action": "NEXT", "status": "SUCCEEDED", "page": ["c"]}, {"ordinal": 1, "action": "LIST", "status": "SUCCEEDED", "filters": {"round": "HR"}, "page": ["a"]},
        {"ordinal": 2, "action": "STATS", "status": "FAILED", "filters": {"round": "FIRST"}},
    ]
    assert S.focus(turns) == {"goal": "LIST", "filters": {"round": "HR"}, "page": ["c"]}
    assert S.focus([]) == {"goal": None, "filters": {}, "page": []}


def test_ask_again():
    run = {"user": "u", "status": "SUCCEEDED", "plan": Plan("NEXT", top_n=40), "actions": ["LIST"], "group_by": "company"}
    assert S.ask_again(run, "u") == Plan("STATS", top_n=40, group_by="company")
    assert S.ask_again(run | {"group_by": None}, "u").action == "LIST"
    for change, error in (({"status": "RUNNING"}, "NOT_READY"), ({"actions": ["RECORD_REVIEW"]}, "NOT_ALLOWED"), ({"plan": Plan("DETAILS")}, "NOT_ALLOWED")):
        with pytest.raises(ValueError, match=error):
            S.ask_again(run | change, "u")
    with pytest.raises(LookupError):
        S.ask_again(run, "v")


def test_decoded():
    previous = Plan("LIST", FilterSpec(company="甲", round="HR", start=date(2026, 1, 1), end=date(2026, 2, 1)), sort="importance", top_n=30)
    choose = lambda **c: S.decoded({"action": "LIST", **c}, previous, {"n1": 40, "n2": 5000}, TODAY, TOMORROW)
    assert choose(company="INHERIT", round="NONE", sort="INHERIT", top_n="n1", time="INHERIT") == Plan("LIST", FilterSpec(company="甲", start=date(2026, 1, 1), end=date(2026, 2, 1)), sort="importance", top_n=40)
    assert choose(company="乙", time="RECENT_3_MONTHS", top_n="INHERIT") == Plan("LIST", FilterSpec(company="乙", start=date(2026, 2, 28), end=TOMORROW), top_n=30)
    assert choose(time="FALLBACK") is None and choose(top_n="n2") is None and choose(top_n="n9") is None
    assert choose(action="STATS", group_by="company", sort="frequency") == Plan("STATS", group_by="company")
    assert S.decoded({"action": "LIST", "round": "INHERIT"}, None, {}, TODAY, TOMORROW) is None


def test_admissible_and_ladder():
    want = {"model": "m", "provider": "p", "contract_hash": "h"}
    good = want | {"accepted": 20, "errors": 0}
    assert S.admissible(good, want)
    assert not any(S.admissible(good | bad, want) for bad in ({"accepted": 19}, {"errors": 1}, {"model": "x"}, {"contract_hash": None}))
    assert not S.admissible({}, want)
    assert [S.stage_after(x) for x in ("HYBRID_RERANK", "HYBRID", "DENSE", "BM25")] == ["HYBRID", "BM25", "BM25", None]


def test_plans_of_the_surface_run(spark, tmp_path):
    d = corpora.write(spark, str(tmp_path / "d"), corpora.seed_tables())
    go = lambda p, **k: execute.run(spark, d, p, date(2026, 9, 30), **k)
    first = go(Plan("LIST", sort="importance", page=1)).collect()
    rest = go(Plan("NEXT", sort="importance", page=1), after=(first[0].importance_score, first[0].key)).collect()
    assert [r.key for r in first + rest] == ["fast", "persistence"]
    with pytest.raises(ValueError, match="next page"):
        go(Plan("NEXT"))
    assert {r.canonical_question_id for r in go(Plan("REVIEW_STATE", ids=("fast", "nowhere"))).collect()} == {"fast"}
    found = go(Plan("SEARCH", FilterSpec(topic_l1="redis", coding_focus="ALGORITHM"), query="Redis")).collect()
    assert {"fast", "persistence"} >= {r.doc_id for r in found} and found
