"""Parsers that need more than patterns: JSON inside prose, tool calls, digits of pi. Python functions, and Arrow UDFs of them."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import functions as F

_OPEN = {"{": "}", "[": "]"}
_PIECE = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)


def extract_json(text: str | None) -> str | None:
    """The text from the first bracket to the one that closes it, quotes and escapes minded; null if nothing closes it."""
    start = re.search(r"[{\[]", text or "")
    if not start:
        return None
    waiting: list[str] = []
    for m in _PIECE.finditer(text, start.start()):
        c = m[0]
        if c in _OPEN:
            waiting.append(_OPEN[c])
        elif c in ("}", "]"):
            if not waiting or waiting.pop() != c:
                return None
            if not waiting:
                return text[start.start() : m.end()]
    return None


def parse_json(text: str | None) -> dict | None:
    """The first JSON object in a text."""
    found = extract_json(text)
    try:
        value = json.loads(found) if found else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


_BAR = r"[｜|]?"
_CALL = re.compile(rf"(?s)<{_BAR}DSML{_BAR}\s*invoke\s+name=(?P<q>[\"']?)(?P<name>[^\"'\s>]*)(?P=q)[^>]*>(?P<body>.*?)</{_BAR}DSML{_BAR}\s*invoke\s*>")
_ARG = re.compile(rf"(?s)<{_BAR}DSML{_BAR}\s*parameter\b(?P<attrs>[^>]*)>(?P<value>.*?)</{_BAR}DSML{_BAR}\s*parameter\s*>")
_ANY = re.compile(rf"</?{_BAR}DSML[^>]*>")


def _attributes(text: str) -> dict[str, str]:
    return {k: a or b or c for k, a, b, c in re.findall(r"\b(\w+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", text)}


def tool_calls(text: str | None) -> tuple[str, list[dict]]:
    """(text without the calls' marks, calls with id, name and arguments as JSON). An argument is text if it says so, else JSON where it parses."""
    calls = []
    for m in _CALL.finditer(text or ""):
        given: dict = {}
        for a in _ARG.finditer(m["body"]):
            attrs, value = _attributes(a["attrs"]), a["value"].strip()
            if attrs.get("string", "").lower() != "true":
                try:
                    value = json.loads(value)
                except ValueError:
                    pass
            if attrs.get("name") == "arguments" and isinstance(value, dict):
                given |= value
            else:
                given[attrs.get("name", "")] = value
        calls.append({"id": f"call_{len(calls)}", "name": m["name"], "arguments": json.dumps(given, ensure_ascii=False)})
    return _ANY.sub("", _CALL.sub("", text or "")).strip(), calls


def pi_digits(count: int) -> str:
    """Pi with ``count`` (1 to 100,000) decimals, cut off. Whole-number arithmetic of Machin's formula."""
    count = min(max(int(count), 1), 100_000)
    one = 10 ** (count + 10)

    def arctan_inverse(x: int) -> int:
        term = total = one // x
        n, sign = 3, -1
        while term:
            term //= x * x
            total += sign * (term // n)
            n, sign = n + 2, -sign
        return total

    digits = str(4 * (4 * arctan_inverse(5) - arctan_inverse(239)) // 10**10)
    return f"{digits[0]}.{digits[1:]}"


def calculate(expression: str) -> str:
    """Arithmetic of numbers, + - * / ^ and parentheses, as JSON with the result or the error. Symbolic input needs a library that isn't here."""
    tokens = re.findall(r"\d+\.?\d*|\.\d+|[-+*/^()]", expression or "")
    if "".join(tokens) != re.sub(r"\s", "", expression or "") or not tokens:
        return json.dumps({"error": "only arithmetic can be calculated here"})
    from fractions import Fraction

    at = 0

    def atom() -> Fraction:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("it ends too early")
        t = tokens[at]
        at += 1
        if t == "(":
            v = total()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError("a parenthesis isn't closed")
            at += 1
            return v
        if t in "+-":
            return atom() if t == "+" else -power()
        return Fraction(t)

    def power() -> Fraction:
        nonlocal at
        v = atom()
        if at < len(tokens) and tokens[at] == "^":
            at += 1
            e = power()
            if e.denominator != 1 or abs(e) > 1000:
                raise ValueError("only small whole powers")
            return v ** int(e)
        return v

    def product() -> Fraction:
        nonlocal at
        v = power()
        while at < len(tokens) and tokens[at] in "*/":
            op, at = tokens[at], at + 1
            w = power()
            v = v * w if op == "*" else v / w
        return v

    def total() -> Fraction:
        nonlocal at
        v = product()
        while at < len(tokens) and tokens[at] in "+-":
            op, at = tokens[at], at + 1
            w = product()
            v = v + w if op == "+" else v - w
        return v

    try:
        v = total()
        if at != len(tokens):
            raise ValueError("it doesn't end")
    except (ValueError, ZeroDivisionError) as e:
        return json.dumps({"error": str(e)})
    return json.dumps({"result": str(v.numerator) if v.denominator == 1 else f"{float(v):.15g}"})


def extract_json_column(text):
    return F.arrow_udf("string")(_arrow_extract)(text)


def _arrow_extract(column: pa.Array) -> pa.Array:
    return pa.array([extract_json(x) for x in column.to_pylist()], pa.string())


def tool_calls_column(text):
    """struct<text, calls array<struct<id, name, arguments>>>."""
    return F.arrow_udf("struct<text string, calls array<struct<id string, name string, arguments string>>>")(_arrow_calls)(text)


_CALL_TYPE = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string())])


def _arrow_calls(column: pa.Array) -> pa.Array:
    found = [tool_calls(x) for x in column.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.list_(_CALL_TYPE))], ["text", "calls"])
