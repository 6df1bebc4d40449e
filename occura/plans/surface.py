"""What surrounds a plan: whether it is complete, which filters a caller named, what a conversation may ask for next,
how a past run is asked again, and how finite choices become a plan. Pure functions, run before any DataFrame is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import fields, replace
from datetime import date

from occura.operators.filters import FilterSpec
from occura.plans.plan import MAX_TOP, Plan, problems

# Keys that every plan and each action must state, filters that null clears, and actions that only read.
ALWAYS = ("action", "filters", "sort", "top_n", "page_size")
NEEDED = {"STATS": ("group_by",), "SEARCH": ("search_query", "pipeline"), "DETAILS": ("question_ids",), "ANSWER": ("answer_text",), "REVIEW_STATE": ("question_ids",), "RECORD_REVIEW": ("review_items",)}
CLEARED_BY_NULL = ("question_type", "topic_l1", "topic_l2", "coding_focus")
READ_ONLY = ("LIST", "STATS", "SEARCH", "NEXT", "CLARIFY", "COUNT")
TOOLS = {
    "list_questions": ("LIST", "CLARIFY"), "search_questions": ("SEARCH",), "get_question_stats": ("STATS",), "get_question_count": ("COUNT",), "answer_question": ("ANSWER",),
}
RECENT_MONTHS = 3


def missing(payload: Mapping) -> list[str]:
    """The keys that a proposed plan leaves out, filter fields among them, sorted; a plan must state even its nulls."""
    left = {*ALWAYS, *NEEDED.get(payload.get("action"), ())} - set(payload)
    if isinstance(payload.get("filters"), Mapping):
        left |= {f"filters.{f.name}" for f in fields(FilterSpec)} - {f"filters.{k}" for k in payload["filters"]}
    return sorted(left)


def explicit_filters(given: Mapping, again: bool = False) -> dict:
    """The filters a request names. A null names nothing, but for the fields that it clears, and when a run is asked
    again (``again``), where every null was meant."""
    return {k: v for k, v in given.items() if v is not None or again or k in CLEARED_BY_NULL}


def policy(state: Mapping, write_requested: bool, remaining: int = 8, read_only: bool = False) -> tuple[dict[str, tuple[str, ...]], dict[str, str]]:
    """(allowed actions by tool, reasons by refused tool) of a conversation in ``state``.

    ``state``: page (displayed ids), cursor, group_by of the current list (missing if there is none). Nothing is allowed
    once the budget of calls is spent; details and records need a displayed page; records also an explicit request
    outside a run that is asked again.
    """
    if remaining <= 0:
        return {}, dict.fromkeys((*TOOLS, "get_question_details", "get_review_state", "record_review"), "run_terminal_or_budget")
    page, listed = bool(state.get("page")), "group_by" in state
    allowed, refused = dict(TOOLS), {}
    if state.get("cursor"):
        allowed["list_questions"] = (*allowed["list_questions"], "NEXT")
    writes = write_requested and not read_only
    reason = "historical_requery_is_read_only" if read_only else "displayed_page_required" if writes else "explicit_write_request_required"
    for tool, action, holds, why in (
        ("get_question_details", "DETAILS", page, "displayed_page_required"),
        ("get_review_state", "REVIEW_STATE", page or (listed and state["group_by"] in (None, "question")), "question_scope_required"),
        ("record_review", "RECORD_REVIEW", page and writes, reason),
    ):
        if holds:
            allowed[tool] = (action,)
        else:
            refused[tool] = why
    return allowed, refused


def focus(turns: Iterable[Mapping]) -> dict:
    """The state after ``turns`` (ordinal, action, status, filters, page), in any order: the goal is that of the last
    turn that succeeded and was no paging; the page is that of the last turn that displayed one."""
    out: dict = {"goal": None, "filters": {}, "page": []}
    for t in sorted(turns, key=lambda t: t["ordinal"]):
        if t.get("status") == "SUCCEEDED":
            if t["action"] not in ("NEXT", "CLARIFY"):
                out |= {"goal": t["action"], "filters": dict(t.get("filters") or {})}
            if t.get("page"):
                out["page"] = list(t["page"])
    return out


def ask_again(run: Mapping, user: str) -> Plan:
    """The plan of a past run to be run anew: from page one, on the newest corpus, and never to write.

    ``run``: user, status, plan (a Plan), actions (all that the run did), group_by of the list that a NEXT continued.
    """
    if run["user"] != user:
        raise LookupError("RUN_NOT_FOUND")
    if run["status"] != "SUCCEEDED":
        raise ValueError("REQUERY_SOURCE_NOT_READY")
    if any(a not in READ_ONLY for a in (run["plan"].action, *run.get("actions", ()))):
        raise ValueError("REQUERY_ACTION_NOT_ALLOWED")
    plan = run["plan"]
    if plan.action == "NEXT":
        plan = replace(plan, action="STATS" if run.get("group_by") else "LIST", group_by=run.get("group_by"))
    return plan


def months_before(day: date, months: int) -> date:
    """The same day ``months`` earlier, or the last one of that month."""
    year, month = divmod(day.year * 12 + day.month - 1 - months, 12)
    for last in range(day.day, 0, -1):
        try:
            return date(year, month + 1, last)
        except ValueError:
            continue
    raise ValueError("no such month")


def decoded(choices: Mapping, previous: Plan | None, spans: Mapping[str, int], today: date, tomorrow: date) -> Plan | None:
    """The plan that finite choices name; None if any choice falls back, inherits without a previous plan, or does not
    give a valid plan.

    A filter is NONE, INHERIT (of ``previous``) or a value; ``top_n`` names one of the numbers written in the request
    (``spans``: id -> value); ``time`` is NONE, INHERIT or RECENT_3_MONTHS, a window that ends with today.
    """
    if "FALLBACK" in choices.values() or ("INHERIT" in choices.values() and previous is None):
        return None
    old = previous.filters if previous else FilterSpec()
    take = lambda field: {"NONE": None, "INHERIT": getattr(old, field)}.get(choices.get(field, "NONE"), choices.get(field))
    chosen = {f: take(f) for f in ("company", "topic_l1", "round", "response_form", "coding_focus")}
    when = choices.get("time", "NONE")
    chosen |= {"NONE": {}, "INHERIT": {"start": old.start, "end": old.end}, "RECENT_3_MONTHS": {"start": months_before(today, RECENT_MONTHS), "end": tomorrow}}[when]
    top = choices.get("top_n", "NONE")
    n = None if top == "NONE" else previous.top_n if top == "INHERIT" else spans.get(top)
    if top not in ("NONE", "INHERIT") and (n is None or not 1 <= n <= MAX_TOP):
        return None
    sort = choices.get("sort", "frequency")
    group = choices.get("group_by", "question")
    plan = Plan(choices["action"], FilterSpec(**chosen), group_by=None if group == "question" and choices["action"] == "LIST" else group, sort=previous.sort if sort == "INHERIT" else sort, top_n=n)
    return None if problems(plan) else plan


def admissible(artifact: Mapping, expected: Mapping, least: int = 20) -> bool:
    """Whether a calibration may be used: made for the same model, provider and contract, on enough accepted samples,
    none of them wrong."""
    same = all(artifact.get(k) == expected[k] for k in ("model", "provider", "contract_hash"))
    return same and artifact.get("accepted", 0) >= least and artifact.get("errors", 1) == 0


def stage_after(failed: str) -> str | None:
    """The weaker search that takes over when a stage fails; None if there is none."""
    return {"HYBRID_RERANK": "HYBRID", "HYBRID": "BM25", "DENSE": "BM25"}.get(failed)
