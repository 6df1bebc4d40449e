"""The typed plan of a request and its rewrites: pure functions that run before any DataFrame is built."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from dataclasses import asdict, dataclass, field, replace

from occura.operators.filters import FilterSpec

# The actions and the filters that a search treats as preferences.
ACTIONS = ("LIST", "NEXT", "COUNT", "STATS", "SEARCH", "DETAILS", "REVIEW_STATE")
SOFT_FIELDS = ("topic_l1", "topic_l2", "coding_focus")
MAX_TOP, MAX_PAGE, MAX_SEARCH, MAX_DETAILS = 1000, 100, 50, 10
CURSOR_SECONDS = 3600


@dataclass(frozen=True)
class Plan:
    action: str
    filters: FilterSpec = field(default_factory=FilterSpec)
    query: str | None = None
    group_by: str | None = None
    sort: str = "frequency"
    top_n: int | None = None
    page: int = 20
    ids: tuple[str, ...] = ()
    review_statuses: tuple[str, ...] = ()


def problems(plan: Plan) -> list[str]:
    """Why a plan cannot run; empty if it can."""
    out = []
    if plan.action not in ACTIONS:
        out.append(f"unknown action {plan.action}")
    if plan.action == "SEARCH" and not (plan.query or "").strip():
        out.append("a search needs a query")
    if plan.action == "SEARCH" and plan.top_n is not None:
        out.append("a search has no top_n")
    if plan.action == "SEARCH" and not 1 <= plan.page <= MAX_SEARCH:
        out.append(f"a search returns 1 to {MAX_SEARCH} rows")
    if plan.action == "COUNT" and plan.top_n is not None:
        out.append("a count has no top_n")
    if plan.action == "STATS" and not plan.group_by:
        out.append("statistics need a grouping")
    if plan.action in ("DETAILS", "REVIEW_STATE") and not 1 <= len(plan.ids) <= MAX_DETAILS:
        out.append(f"details need 1 to {MAX_DETAILS} ids")
    if plan.action == "LIST" and plan.group_by not in (None, "question") and (plan.sort != "frequency" or plan.review_statuses):
        out.append("groups are listed by frequency only, without a review filter")
    if plan.top_n is not None and not 1 <= plan.top_n <= MAX_TOP:
        out.append(f"top_n is 1 to {MAX_TOP}")
    if not 1 <= plan.page <= MAX_PAGE:
        out.append(f"a page has 1 to {MAX_PAGE} rows")
    return out


def with_label_policy(plan: Plan) -> Plan:
    """A task filter without a status means known labels."""
    f = plan.filters
    if (f.response_form or f.coding_focus) and f.annotation_status is None:
        return replace(plan, filters=replace(f, annotation_status="KNOWN"))
    return plan


def softened(plan: Plan, explicit: frozenset[str] = frozenset()) -> tuple[Plan, dict]:
    """For a search: filters that nobody named explicitly stop being conditions and come back as preferences."""
    if plan.action != "SEARCH":
        return plan, {}
    soft = {k: getattr(plan.filters, k) for k in (*SOFT_FIELDS, "question_type") if getattr(plan.filters, k) is not None and k not in explicit}
    return replace(plan, filters=replace(plan.filters, **dict.fromkeys(soft))), soft


def conflicts(plan: Plan, explicit: FilterSpec) -> list[str]:
    """Fields that the plan sets otherwise than the explicit filters do."""
    return sorted(k for k, v in explicit.applied().items() if k != "date_basis" and plan.filters.applied().get(k, v) != v)


def scope_key(plan: Plan) -> str:
    """What a cursor is bound to: everything but the page size."""
    return hashlib.sha256(json.dumps(asdict(replace(plan, page=1)), sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()


def sign_cursor(plan: Plan, last: tuple[float, str], revision: int, key: bytes, now: float | None = None) -> str:
    """A signed position in a list, bound to the plan and the corpus revision."""
    body = json.dumps({"scope": scope_key(plan), "last": last, "revision": revision, "at": int(time.time() if now is None else now)}, sort_keys=True).encode()
    return b".".join(base64.urlsafe_b64encode(x) for x in (body, hmac.new(key, body, hashlib.sha256).digest())).decode()


def open_cursor(token: str, plan: Plan, revision: int, key: bytes, now: float | None = None) -> tuple[float, str]:
    """The position, or ValueError if the token was changed, is too old, or belongs to another plan or revision."""
    try:
        body, mac = (base64.urlsafe_b64decode(x) for x in token.encode().split(b"."))
    except ValueError as e:
        raise ValueError("INVALID_CURSOR") from e
    if not hmac.compare_digest(mac, hmac.new(key, body, hashlib.sha256).digest()):
        raise ValueError("INVALID_CURSOR")
    held = json.loads(body)
    if held["scope"] != scope_key(plan) or (time.time() if now is None else now) - held["at"] > CURSOR_SECONDS:
        raise ValueError("INVALID_CURSOR")
    if held["revision"] != revision:
        raise ValueError("SNAPSHOT_CHANGED")
    return held["last"][0], held["last"][1]
