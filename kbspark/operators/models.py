"""Everything that a model may do, behind one registry. Each entry has a deterministic default, so that no query needs a model."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from kbspark.operators.navigate import token_share

Function = Callable[..., Any]


def first_sentences(text: str, most: int = 200) -> str:
    """Extractive summary: the text's beginning up to a sentence's end."""
    t = " ".join((text or "").split())
    if len(t) <= most:
        return t
    cut = max(t.rfind(c, 0, most) for c in ".。!?！？")
    return t[: cut + 1] if cut > most // 3 else t[:most]


#: What each kind of model does without one.
DEFAULTS: dict[str, Function] = {
    "score": token_share,
    "summarize": lambda title, text: first_sentences(text) if len(text or "") >= 10 else "",
    "abstract": lambda title, sections: f"{title}: " + ", ".join(sections)[:3000],
    "classify_question": lambda question: "normal",
    "classify_complexity": lambda question: "",
    "translate": lambda text: text,
    "refine_query": lambda query, gap="": query,
    "multi_query": lambda query: [query] if query.strip() else [],
    "extract_sections": lambda blocks: [],
    "choose_entries": lambda query, sections: [],
    "choose_next": lambda query, nodes: nodes[0] if nodes else None,
    "judge": lambda question, requirements, evidence: {r: "MISSING" if not evidence else "PARTIAL" for r in requirements},
    "choose_action": lambda state: "ANSWER",
    "plan": lambda question: [{"id": "R1", "description": question, "importance": 1.0, "synthetic": False, "deps": []}],
    "sub_requirements": lambda requirement, evidence: [],
    "answer": lambda question, citations: "\n\n".join(f"[{i}] {t}" for i, t in enumerate(citations, 1)),
    "no_answer": lambda question: "No evidence was found for this question.",
    "web_search": lambda query: [],
}


class Models:
    """Functions by kind; the first of several kinds that is set wins, else the default."""

    def __init__(self, **functions: Function):
        unknown = set(functions) - set(DEFAULTS)
        if unknown:
            raise KeyError(f"no such kind of model: {sorted(unknown)}")
        self.functions = functions

    def get(self, *kinds: str) -> Function:
        for kind in kinds:
            if kind in self.functions:
                return self.functions[kind]
        return DEFAULTS[kinds[0]]

    def safe(self, kind: str, *args):
        """A model's answer, or the default's where the model fails."""
        try:
            return self.get(kind)(*args)
        except Exception:  # noqa: BLE001  a model may fail in any way
            return DEFAULTS[kind](*args)


def messages(system: str, history: list[dict]) -> list[dict]:
    """Role and content pairs with the system text first."""
    return [{"role": "system", "content": system}, *({"role": "user" if m.get("role") == "user" else "assistant", "content": str(m.get("content", ""))} for m in history)]


def without_system(rows: list[dict]) -> list[dict]:
    """The system text put before the first user message, for models without that role."""
    system = "\n".join(r["content"] for r in rows if r["role"] == "system")
    out, pending = [], system
    for r in rows:
        if r["role"] == "system":
            continue
        if pending and r["role"] == "user":
            r, pending = r | {"content": f"{pending}\n\n{r['content']}"}, ""
        out.append(r)
    return out or ([{"role": "user", "content": system}] if system else [])


def split_reasoning(text: str) -> tuple[str, str]:
    """(answer, reasoning): what stands between think marks, and the rest; an open mark holds everything after it."""
    reasoning = re.findall(r"<think>(.*?)(?:</think>|\Z)", text or "", re.S)
    return re.sub(r"<think>.*?(?:</think>|\Z)", "", text or "", flags=re.S).strip(), "\n".join(r.strip() for r in reasoning)
