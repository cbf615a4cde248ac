"""Navigation of a document's tree towards a question, and the choice of documents. Trees are searched in parallel, one group for each document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Bands of scores and budgets (fixed values)."""

    node_low: float = 0.2
    node_high: float = 0.5
    leaf_low: float = 0.2
    leaf_high: float = 0.5
    expansions: int = 8
    depth: int = 4
    model_calls: int = 6
    leaf_reads: int = 20
    enough: int = 2
    rescue: int = 3
    neighbours: int = 1


def token_share(query: str, text: str) -> float:
    """The built-in scorer: the share of the query's words that the text has."""
    q = set(query.lower().split())
    return len(q & set((text or "").lower().split())) / len(q) if q else 0.0


def _band(score: float, low: float, high: float) -> str:
    return "keep" if score >= high else "ambiguous" if score >= low else "prune"


CONTAINERS = ("section", "document")


class Tree:
    """The nodes of one document: node_id, parent_id, type, title, summary, text and ord."""

    def __init__(self, nodes: list[dict]):
        self.node = {n["node_id"]: n for n in nodes}
        self.below: dict[str | None, list[dict]] = {}
        for n in sorted(nodes, key=lambda x: (x["ord"], x["node_id"])):
            self.below.setdefault(n["parent_id"] if n["parent_id"] in self.node else None, []).append(n)

    def leaves(self, node: str) -> list[dict]:
        return [c for c in self.below.get(node, []) if c["type"] not in CONTAINERS]

    def sections(self, node: str) -> list[dict]:
        return [c for c in self.below.get(node, []) if c["type"] in CONTAINERS]

    def entries(self) -> list[str]:
        """The top sections; in a document without any, its roots."""
        top = [c["node_id"] for r in self.below.get(None, []) for c in (self.sections(r["node_id"]) if r["type"] == "document" else [r] if r["type"] in CONTAINERS else [])]
        return top or [r["node_id"] for r in self.below.get(None, []) if r["type"] in CONTAINERS]

    def sample(self, node: str, most: int = 200) -> str:
        """The first text below a section: its own leaves', else that of its first section that has any."""
        own = next((x["text"] for x in self.leaves(node) if (x["text"] or "").strip()), "")
        return own[:most] or next((t for c in self.sections(node) if (t := self.sample(c["node_id"], most))), "")


class Walk:
    """A depth-first search of one tree as a stack machine; see ``walk``."""

    def __init__(self, tree: Tree, query: str, score, choose, limits: Limits):
        self.tree, self.query, self.score, self.choose, self.limits = tree, query, score, choose, limits
        self.state: dict[str, str] = {}
        self.value: dict[str, float] = {}
        self.read: dict[str, dict] = {}
        self.pruned: list[dict] = []
        self.steps: list[dict] = []
        self.expansions = self.calls = self.reads = 0

    def note(self, node: str, action: str, value: float = 0.0, reason: str = "") -> None:
        self.steps.append({"step": len(self.steps), "node_id": node, "action": action, "score": value, "reason": reason})

    def rated(self, text: str) -> float:
        try:
            return float(self.score(self.query, text))
        except Exception:  # noqa: BLE001  a scorer may fail in any way; its text is then in doubt
            return 0.5

    def take(self, leaf: dict, value: float, doubt: bool, beside: bool = False) -> None:
        if leaf["node_id"] not in self.read and (leaf["text"] or "").strip():
            self.read[leaf["node_id"]] = {"node_id": leaf["node_id"], "text": leaf["text"], "score": value, "ambiguous": doubt, "is_neighbor": beside}

    def dispose(self, node: str) -> None:
        """Rate a section's leaves: read them, with the leaves beside them, or prune them."""
        leaves = self.tree.leaves(node)
        rated = [(i, x, self.rated(x["text"] or "") if self.score and (x["text"] or "").strip() else 0.0) for i, x in enumerate(leaves)]
        for i, leaf, value in rated:
            if leaf["node_id"] in self.value:
                continue
            self.value[leaf["node_id"]] = value
            band = _band(value, self.limits.leaf_low, self.limits.leaf_high) if self.score else "keep"
            if band == "prune":
                self.note(leaf["node_id"], "prune", value)
                self.pruned.append(leaf | {"score": value})
                continue
            self.note(leaf["node_id"], "read", value, band)
            self.reads += 1
            old = self.read.pop(leaf["node_id"], None)  # read before as a neighbour only
            self.take(old or leaf, value, band == "ambiguous")
            self.read.get(leaf["node_id"], {}).update(score=value, ambiguous=band == "ambiguous", is_neighbor=False)
            for j in range(max(0, i - self.limits.neighbours), min(len(leaves), i + self.limits.neighbours + 1)):
                if j != i:
                    self.take(leaves[j], 0.0, False, True)

    def gate(self, node: str) -> list[str]:
        """Rate a section's sections; those that are neither pruned nor done."""
        for child in self.tree.sections(node) if self.score else []:
            key = child["node_id"]
            if key not in self.value:
                text = " ".join(x for x in (child["title"], child["summary"], self.tree.sample(key)) if x)
                self.value[key] = self.rated(text)
                if self.value[key] < self.limits.node_low:
                    self.state[key] = "pruned"
                    self.note(key, "prune", self.value[key])
                elif self.value[key] < self.limits.node_high:
                    self.note(key, "keep", self.value[key], "ambiguous")
        return [c["node_id"] for c in self.tree.sections(node) if c["node_id"] not in self.state]

    def enough(self) -> bool:
        sure = [r for r in self.read.values() if not r["is_neighbor"] and (not self.score or not r["ambiguous"] and r["score"] >= self.limits.leaf_high)]
        return len(sure) >= self.limits.enough

    def target(self, open_: list[str]) -> str | None:
        """Without a model, or with one candidate, the first; a single clear one; else what the model says (None: back)."""
        if self.choose is None or len(open_) == 1:
            return open_[0]
        clear = [k for k in open_ if self.value.get(k, 0.0) >= self.limits.node_high]
        if len(clear) == 1:
            return clear[0]
        self.calls += 1
        chosen = self.choose(self.query, [self.tree.node[k] for k in open_])
        key = chosen["node_id"] if isinstance(chosen, dict) else chosen
        return key if key in open_ else None

    def spent(self) -> str | None:
        limits = self.limits
        used = (("expansions", self.expansions, limits.expansions), ("model calls", self.calls, limits.model_calls), ("leaf reads", self.reads, limits.leaf_reads))
        return next((name for name, n, most in used if n >= most), None)

    def run(self, entries: list[str]) -> None:
        stack = [(e, 0) for e in reversed(entries)]
        while stack:
            node, depth = stack[-1]
            if node not in self.state:
                self.state[node] = "expanded"
                self.expansions += 1
                self.note(node, "expand")
            self.dispose(node)
            open_ = self.gate(node)
            if not open_:
                self.state[node] = "exhausted"
                self.note(node, "backtrack", 0.0, "nothing left")
                stack.pop()
                continue
            if self.enough() or (reason := self.spent()):
                self.note(node, "stop", 0.0, "enough" if self.enough() else reason)
                break
            target = self.target(open_)
            if target is None or depth + 1 >= self.limits.depth:
                self.state[node] = "exhausted"
                self.note(node, "backtrack", 0.0, "by choice" if target is None else "depth")
                stack.pop()
                continue
            self.note(node, "descend", 0.0, target)
            stack.append((target, depth + 1))
        if not self.read and self.score:
            for leaf in sorted(self.pruned, key=lambda x: (-x["score"], x["node_id"]))[: self.limits.rescue]:
                self.take(leaf, leaf["score"], True)
            if self.read:
                self.note("", "rescue")


def walk(nodes: list[dict], query: str, score: Callable[[str, str], float] | None = token_share, limits: Limits = Limits(), choose=None, entries: list[str] | None = None) -> tuple[list[dict], list[dict]]:
    """(evidence, trajectory) of one tree.

    The section on top of the stack is opened: its leaves are read or pruned by their scores, with the leaves beside a read one; its
    sections are pruned or stay. Then it goes down into one of them, or back where none is left, the depth is reached or ``choose`` says so.
    While sections are left it ends with enough sure reads or a spent budget. If nothing was read, the best pruned leaves come as doubtful.
    Without a scorer nothing is pruned. Clear evidence comes first, by falling score, and neighbours last.
    """
    tree = Tree(nodes)
    search = Walk(tree, query, score, choose, limits)
    search.run(tree.entries() if entries is None else [e for e in entries if e in tree.node])
    return sorted(search.read.values(), key=lambda r: (r["is_neighbor"], -r["score"], r["node_id"])), search.steps


def navigate(nodes: DataFrame, query: str, score: Callable[[str, str], float] = token_share, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, node_id, text, score, ambiguous, is_neighbor) of every document's tree. Columns: doc_id and those of ``walk``."""

    def one(key, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.astype(object).where(group.notna(), None).to_dict("records")
        found, _ = walk(rows, query, score, limits)
        return pd.DataFrame([{"doc_id": key[0], **f} for f in found], columns=["doc_id", "node_id", "text", "score", "ambiguous", "is_neighbor"])

    needed = nodes.select("doc_id", "node_id", "parent_id", "type", "title", "summary", "text", "ord")
    return needed.groupBy("doc_id").applyInPandas(one, "doc_id string, node_id string, text string, score double, ambiguous boolean, is_neighbor boolean")


def route(cards: DataFrame, query: str, k: int = 1, text: str = "card") -> DataFrame:
    """Documents by the share of the query's tokens that their cards have; with a single document, that one."""
    from kbspark.operators.search import overlap_score

    return cards.withColumn("score", F.round(overlap_score(F.lit(query), F.col(text)), 6)).orderBy(F.desc("score"), "doc_id").limit(k)


def routed_search(documents: list[str], search: Callable[[str], list[dict]], covered: Callable[[str, list[dict]], bool], least: int = 3, patience: int = 2, judge: bool = True) -> list[dict]:
    """Evidence from documents in order: the first always; a later one only if it isn't covered by what is there, until ``patience`` in a row were. Without a judge it ends with ``least`` pieces."""
    found: list[dict] = []
    streak = 0
    for i, doc in enumerate(documents):
        if i and judge:
            streak = streak + 1 if covered(doc, found) else 0
            if streak >= patience:
                break
            if streak:
                continue
        seen = {f["node_id"] for f in found}
        found += [f for f in search(doc) if f["node_id"] not in seen]
        if not judge and len(found) >= least:
            break
    return found


def anchor_query(hits: DataFrame, query: str, most: int = 600) -> str:
    """The query and the beginning of what the hits (a bounded list with rank) say."""
    row = hits.agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " "), 1, most).alias("t")).first()
    return f"{query} {row['t'] or ''}".strip()
