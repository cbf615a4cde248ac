"""The question loop on the driver: plan, search, judge, stop, answer. Tables are searched by functions; all state is plain rows that can be stored."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from kbspark.operators.models import Models

#: Rounds of each complexity, tool calls, new evidence that is judged, web searches and the idle rounds before the first.
ROUNDS = {"SIMPLE": 2, "MEDIUM": 3, "COMPLEX": 5}
MAX_CALLS, NEW_EVIDENCE, WEB_CALLS, WEB_AFTER = 12, 8, 2, 2
#: What an action may be; all but the answer count as tool calls.
ACTIONS = ("SEARCH", "REFINE_QUERY", "READ", "WEB_SEARCH", "ANSWER")
_RANK = {"MISSING": 0, "PARTIAL": 1, "SUPPORTED": 2}


def normalized(question: str) -> str:
    return re.sub(r"\s+", "", question or "").lower()


class Cache:
    """States of a conversation's questions: equal ones first, else the most similar from 0.9 on; the newest 32 stay."""

    def __init__(self, score: Callable[[str, str], float], most: int = 32):
        self.score, self.most, self.rows = score, most, {}

    def get(self, question: str):
        key = normalized(question)
        if key in self.rows:
            return self.rows[key][1]
        near = max(self.rows.values(), key=lambda r: self.score(question, r[0]), default=None)
        return near[1] if near and self.score(question, near[0]) >= 0.9 else None

    def put(self, question: str, state) -> None:
        self.rows.pop(normalized(question), None)
        self.rows[normalized(question)] = (question, state)
        while len(self.rows) > self.most:
            self.rows.pop(next(iter(self.rows)))


@dataclass
class State:
    question: str
    requirements: list[dict]
    status: dict[str, str] = field(default_factory=dict)
    evidence: dict[str, dict] = field(default_factory=dict)
    queries: set[tuple[bool, str]] = field(default_factory=set)
    rounds: list[dict] = field(default_factory=list)
    calls: int = 0
    web_calls: int = 0
    idle: int = 0
    rounds_allowed: int = 2

    def gaps(self) -> list[dict]:
        return sorted((r for r in self.requirements if not r["synthetic"] and self.status.get(r["id"]) != "SUPPORTED"), key=lambda r: -r["importance"])

    def coverage(self) -> float:
        return sum(self.status.get(r["id"]) == "SUPPORTED" for r in self.requirements) / len(self.requirements) if self.requirements else 0.0


def resolve_synthetic(state: State) -> None:
    for r in state.requirements:
        if r["synthetic"] and r["deps"] and all(state.status.get(d) == "SUPPORTED" for d in r["deps"]):
            state.status[r["id"]] = "SUPPORTED"


def stop_reason(state: State, rounds: int, patience: int = 3) -> str | None:
    if len(state.rounds) >= rounds:
        return "hard: iterations"
    if state.calls >= MAX_CALLS:
        return "hard: tool calls"
    if state.requirements and not any(r["importance"] >= 0.8 and state.status.get(r["id"]) != "SUPPORTED" for r in state.requirements):
        return "sufficiency"
    return "no_progress" if state.idle >= patience else None


def can_search_web(state: State) -> bool:
    return state.web_calls < WEB_CALLS and state.idle >= WEB_AFTER


def choose_action(state: State, models: Models) -> dict:
    """{type, gap, query}: an answer where nothing is open or the budget is spent, a search while there is no evidence, else what the model says.

    A model's choice is held to the rules: unknown kinds become refined queries, reading needs evidence, and the web waits for idle rounds
    and has its own budget. Without a model it refines the query of the first gap, and goes to the web once it may.
    """
    gaps = state.gaps()
    if not gaps or state.calls >= MAX_CALLS or len(state.rounds) >= state.rounds_allowed:
        return {"type": "ANSWER", "gap": None, "query": ""}
    gap = gaps[0]
    if not state.evidence:
        kind = "WEB_SEARCH" if state.rounds and can_search_web(state) else "SEARCH"
        return {"type": kind, "gap": gap["id"], "query": gap["description"]}
    said = models.safe("choose_action", state) if "choose_action" in models.functions else None
    said = said if isinstance(said, dict) else {"type": said}
    kind = str(said.get("type") or ("WEB_SEARCH" if can_search_web(state) else "REFINE_QUERY")).strip().upper()
    if kind not in ACTIONS or kind == "WEB_SEARCH" and not can_search_web(state):
        kind = "REFINE_QUERY"
    target = said.get("gap") if said.get("gap") in {g["id"] for g in gaps} else gap["id"]
    return {"type": kind, "gap": target, "query": said.get("query") or next(g["description"] for g in gaps if g["id"] == target)}


def execute(state: State, action: dict, search, models: Models, read=None) -> int:
    """Carry an action out; the number of new pieces of evidence. Queries that were asked before aren't asked again."""
    state.calls += 1
    found: list[dict] = []
    if action["type"] == "READ":
        best = max(state.evidence.values(), key=lambda e: (e["score"], e["id"]), default=None)
        found = read(best) if read and best else []
    else:
        if action["type"] == "WEB_SEARCH":
            state.web_calls += 1
        web = action["type"] == "WEB_SEARCH"
        source = (lambda q: models.safe("web_search", q)) if web else search
        first = models.safe("refine_query", action["query"], action["gap"]) if action["type"] == "REFINE_QUERY" else action["query"]
        for q in models.safe("multi_query", first):
            if q.strip() and (web, q.strip()) not in state.queries:
                state.queries.add((web, q.strip()))
                found += source(q)
    new = {e["id"]: e for e in reversed(found) if e["id"] and e["id"] not in state.evidence}
    kept = sorted(new.values(), key=lambda e: (-e["score"], e["id"]))[:NEW_EVIDENCE]
    state.evidence |= {e["id"]: e | {"round": len(state.rounds) + 1} for e in kept}
    return len(kept)


def matched_id(raw: str, ids: list[str]) -> str | None:
    """The requirement that a model's answer names, whatever its case and the marks around it."""
    plain = lambda x: re.sub(r"[^0-9a-z]", "", str(x).lower())
    return next((i for i in ids if plain(i) == plain(raw)), None)


def evaluate(state: State, models: Models) -> bool:
    """Judge what is open; whether a state has risen. States never fall."""
    open_ = [r["id"] for r in state.requirements if not r["synthetic"] and state.status.get(r["id"]) != "SUPPORTED"]
    judged = {matched_id(k, open_): v for k, v in models.safe("judge", state.question, open_, list(state.evidence.values())).items()}
    risen = False
    for key in open_:
        before, now = state.status.get(key, "MISSING"), judged.get(key, "MISSING")
        rose = _RANK.get(now, 0) > _RANK[before]
        state.status[key], risen = (now if rose else before), risen or rose
    resolve_synthetic(state)
    return risen


def expand_deferred(state: State, models: Models) -> list[dict]:
    """A deferred requirement whose list is supported is replaced by what the model finds in it, if that is two or more."""
    out, added = [], []
    for r in state.requirements:
        ready = r.get("deferred") and r["deps"] and all(state.status.get(d) == "SUPPORTED" for d in r["deps"])
        parts = models.safe("sub_requirements", r, list(state.evidence.values())) if ready else []
        if len(parts) < 2:
            out.append(r)
            continue
        new = [{"id": f"{r['id']}.{i}", "description": p, "importance": r["importance"], "synthetic": False, "deps": []} for i, p in enumerate(parts, 1)]
        out += new
        added += new
    state.requirements = out
    return added


def run(question: str, search: Callable[[str], list[dict]], models: Models | None = None, complexity: str = "SIMPLE", read: Callable[[dict], list[dict]] | None = None) -> dict:
    """{answer, citations, rounds, coverage, stop}: rounds of an action and, after new evidence only, a judgement, until a rule ends them. Evidence has id, text and score."""
    models = models or Models()
    planned = models.safe("plan", question) if complexity == "COMPLEX" else [{"id": "R1", "description": question, "importance": 1.0, "synthetic": False, "deps": []}]
    state = State(question, planned, rounds_allowed=ROUNDS[complexity])
    reason = None
    while not reason:
        action = choose_action(state, models)
        if action["type"] == "ANSWER":
            reason = stop_reason(state, state.rounds_allowed) or "answer"
            break
        new = execute(state, action, search, models, read)
        risen = evaluate(state, models) if new else False
        expand_deferred(state, models)
        state.idle = 0 if risen else state.idle + 1
        state.rounds.append({"round": len(state.rounds) + 1, "action": action["type"], "gap": action["gap"], "new": new, "coverage": state.coverage(), "risen": risen})
        reason = stop_reason(state, state.rounds_allowed)
    cited = sorted(state.evidence.values(), key=lambda e: (-e["score"], e["id"]))
    answer = models.safe("answer", question, [e["text"] for e in cited]) if cited else models.safe("no_answer", question)
    return {"answer": answer, "citations": [{"num": i, **e} for i, e in enumerate(cited, 1)], "rounds": state.rounds, "coverage": state.coverage(), "stop": reason}
