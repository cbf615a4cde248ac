"""Settings: a nested dictionary read and set by dotted paths, with defaults."""

from __future__ import annotations

import copy
import json
from typing import Any

DEFAULTS: dict[str, Any] = {
    "retrieval": {"mode": "tree", "top_k": 5, "neighbor_window": 1, "max_context_chars": 4000},
    "chunking": {"max_chars": 800, "min_chars": 150, "parent_tokens": 1024, "child_tokens": 256},
    "agent": {"no_progress_rounds": 3, "max_tool_calls": 30, "web_calls": 2},
    "grade": {"threshold": 0.25},
    "tools": {},
}


class Config:
    def __init__(self, values: dict | None = None):
        self.values = copy.deepcopy(DEFAULTS)
        self._merge(self.values, values or {})

    def _merge(self, into: dict, new: dict) -> None:
        for k, v in new.items():
            if isinstance(v, dict) and isinstance(into.get(k), dict):
                self._merge(into[k], v)
            else:
                into[k] = v

    def get(self, path: str, default: Any = None) -> Any:
        """The value at a path; ``default`` where there is none or null, while other empty values stand."""
        at: Any = self.values
        for part in path.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return default if at is None else at

    def set(self, path: str, value: Any) -> None:
        *parents, last = path.split(".")
        at = self.values
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = value

    def enabled(self, tool: str) -> bool:
        return bool(self.get(f"tools.{tool}.enabled", True))

    @staticmethod
    def load(path: str) -> Config:
        with open(path) as f:
            return Config(json.load(f))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(self.values, f, ensure_ascii=False, indent=2)
