"""Markdown and JSON texts: blocks with headings, delimiter parts outside protected ranges, and JSON in structure-preserving pieces."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_HEADING = re.compile(r"\s*(#{1,6})\s+(.+)")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_RULE = re.compile(r"\s*\|?[\s:|-]+\|")
_LIST = re.compile(r"\s*(?:[-*+]|\d+\.)\s+\S")


#: The separators that are spaces, which is what SQL's ``trim`` takes off; other white space isn't among them.
SPACES = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def blocks(text: str | None, blank: str | None = None) -> Iterator[tuple[str, int | None, str]]:
    """(kind, level, text) in order: headings, fenced code with its fences, tables without their rule, and runs of other lines.

    A title loses the characters ``blank`` at its ends, and the one after its marks; where that isn't given, all white space.
    """
    lines = (text or "").split("\n")
    held: list[str] = []
    i = 0

    def paragraph() -> Iterator[tuple[str, None, str]]:
        if held:
            yield "paragraph", None, "\n".join(held)
            held.clear()

    while i < len(lines):
        line = lines[i]
        if not held and (m := _FENCE.match(line)):
            mark = m[1][:3]
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(mark)), len(lines) - 1)
            yield "code", None, "\n".join(lines[i : end + 1])
            i = end + 1
        elif m := _HEADING.fullmatch(line):
            yield from paragraph()
            yield "heading", len(m[1]) - 1, m[2].strip() if blank is None else line[m.end(1) + 1 :].strip(blank)
            i += 1
        elif not held and "|" in line and i + 1 < len(lines) and _RULE.match(lines[i + 1]):
            end = i + 2
            while end < len(lines) and "|" in lines[end]:
                end += 1
            yield "table", None, "\n".join([line, *lines[i + 2 : end]])
            i = end
        else:
            if line.strip():
                held.append(line)
            else:
                yield from paragraph()
            i += 1
    yield from paragraph()


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch, as one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_PROTECTED = re.compile(r"(?ms)^[ \t]*(?P<f>`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t]*(?P=f)[`~]*[ \t]*$|\Z)|(?i:<table[^>]*>.*?</table>)|^[^\n|]*\|[^\n]*\n[ \t]*\|?[ :|-]*-[ :|-]*\|?[ :|-]*(?:\n[^\n|]*\|[^\n]*)*")


def protected_ranges(text: str) -> list[tuple[int, int]]:
    """Where fenced code and tables stand."""
    return merged([m.span() for m in _PROTECTED.finditer(text)])


def delimiters(field: str) -> list[str]:
    """Single characters, the escapes for newline, tab and return, and longer ones between back quotes."""
    escapes = {"\\n": "\n", "\\t": "\t", "\\r": "\r"}
    return [m[1] if m[1] is not None else escapes.get(m[0], m[0]) for m in re.finditer(r"`([^`]*)`|\\[ntr]|(?s:.)", field or "")]


def delimited(text: str, field: str) -> list[str]:
    """Parts between delimiters that stand outside protected ranges; lone headings go with the prose after them."""
    marks = [d for d in delimiters(field) if d]
    if not marks:
        return [text] if text.strip() else []
    safe, parts, last = protected_ranges(text), [], 0
    for m in re.finditer("|".join(map(re.escape, marks)), text):
        if not any(a <= m.start() < b for a, b in safe):
            parts.append(text[last : m.start()])
            last = m.end()
    parts.append(text[last:])
    out: list[str] = []
    heads: list[str] = []
    for p in (x.strip() for x in parts if x.strip()):
        if "\n" not in p and _HEADING.fullmatch(p):
            heads.append(p)
        elif heads and not (_FENCE.match(p) or _LIST.match(p) or re.match(r"[|<>]|\S+\s*\|", p)):
            out.append("\n".join([*heads, p]))
            heads = []
        else:
            out += [*heads, p]
            heads = []
    return out + heads


def elements(text: str) -> list[tuple[str, str]]:
    """(kind, text) of header, code, list, quote and text runs."""
    def kind(line: str) -> str:
        return "header" if _HEADING.fullmatch(line) else "list" if _LIST.match(line) else "quote" if line.lstrip().startswith(">") else "text" if line.strip() else ""

    out: list[list] = []
    fence = None
    for line in text.split("\n"):
        if fence:
            out[-1][1].append(line)
            if line.strip().startswith(fence):
                fence = None
            continue
        if m := _FENCE.match(line):
            fence = m[1][:3]
            out.append(["code", [line]])
            continue
        k = kind(line)
        if k and k != "header" and out and out[-1][0] == k and out[-1][1][-1] is not None:
            out[-1][1].append(line)
        elif k:
            out.append([k, [line]])
        elif out and out[-1][0] not in ("code",):
            out.append(["", [None]])
    return [(k, "\n".join(x)) for k, x in out if k]


# --- JSON --------------------------------------------------------------------------------------------------------------------------


def _size(value) -> int:
    return len(json.dumps(value, ensure_ascii=False))


def listless(value):
    """Lists as maps from their positions."""
    if isinstance(value, dict):
        return {k: listless(v) for k, v in value.items()}
    return {str(i): listless(v) for i, v in enumerate(value)} if isinstance(value, list) else value


def json_pieces(value, most: int = 4000, least: int = 1800, lists: bool = False) -> list:
    """Objects that keep their place in the whole: members are added in order while a piece stays below ``most``; a member too large for its piece is entered.

    A new piece begins before it once the current one has ``least`` characters.
    """
    value = listless(value) if lists else value
    if not isinstance(value, dict):
        return [value]
    pieces: list[dict] = [{}]
    work: list[tuple[tuple[str, ...], object]] = [((k,), v) for k, v in reversed(value.items())]

    def put(path: tuple[str, ...], v) -> None:
        at = pieces[-1]
        for k in path[:-1]:
            at = at.setdefault(k, {})
        at[path[-1]] = v

    while work:
        path, v = work.pop()
        now = _size(pieces[-1])
        if _size({path[-1]: v}) < most - now:
            put(path, v)
            continue
        if now >= least:
            pieces.append({})
        if isinstance(v, dict):
            work += [((*path, k), x) for k, x in reversed(v.items())]
        else:
            put(path, v)
    return [p for p in pieces if p]


def is_json_lines(text: str, sample: int = 10, share: float = 0.8) -> bool:
    """Not one JSON value, and at least ``share`` of the first lines that aren't blank are."""
    def valid(t: str) -> bool:
        try:
            json.loads(t)
        except ValueError:
            return False
        return True

    first = [x for x in text.split("\n") if x.strip()][:sample]
    return not valid(text) and bool(first) and sum(map(valid, first)) >= share * len(first)


def json_text(text: str | None, **limits) -> list[str]:
    """A JSON or JSON-lines text in pieces; lines that aren't JSON are skipped, empty values dropped."""
    text = text or ""
    sources = [x for x in text.split("\n") if x.strip()] if is_json_lines(text) else [text]
    out = []
    for s in sources:
        try:
            value = json.loads(s)
        except ValueError:
            continue
        out += [json.dumps(p, ensure_ascii=False) for p in json_pieces(value, **limits) if p is not None and p not in ({}, [], "")]
    return out


def _rows(docs: DataFrame, key: str, text: str, schema: str, parse) -> DataFrame:
    """A row for each thing that ``parse`` makes of a text; Arrow batches."""
    kind = dict(docs.dtypes)[key]

    def emit(batches):
        for batch in batches:
            out = [(k, i, *x) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, x in enumerate(parse(t))]
            if out:
                cols = list(zip(*out))
                types = [batch.schema.field(0).type, pa.int32(), *(pa.int32() if "int" in x.split()[1] else pa.string() for x in schema.split(", "))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "seq", *(x.split()[0] for x in schema.split(", "))])

    return docs.select(key, text).mapInArrow(emit, f"key {kind}, seq int, {schema}").withColumnRenamed("key", key)


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", blank: str | None = None) -> DataFrame:
    return _rows(docs, key, text, "kind string, level int, text string", lambda t: blocks(t, blank))


def json_rows(docs: DataFrame, key: str, text: str, most: int = 4000, least: int = 1800) -> DataFrame:
    return _rows(docs, key, text, "piece string", lambda t: [(p,) for p in json_text(t, most=most, least=least)])


# --- search result pages -----------------------------------------------------------------------------------------------------------


def _plain(fragment: str) -> str:
    import html

    return html.unescape(re.sub(r"<[^>]+>", "", fragment or "")).strip()


def news_items(xml: str, most: int = 5) -> list[dict]:
    """Items of a news feed; the source's name is taken off the title's end."""
    out = []
    for item in re.findall(r"(?s)<item>(.*?)</item>", xml or "")[:most]:
        field = {k: _plain(m[1]) if (m := re.search(rf"(?s)<{k}[^>]*>(.*?)</{k}>", item)) else "" for k in ("title", "link", "source", "pubDate")}
        title = field["title"].removesuffix(f" - {field['source']}") if field["source"] else field["title"]
        out.append({"title": title, "url": field["link"], "snippet": " · ".join(x for x in (field["source"], field["pubDate"]) if x)})
    return out


def result_items(html: str, most: int = 5) -> list[dict]:
    """Results of a page whose entries have the class ``b_algo``."""
    out = []
    for part in re.split(r'class="b_algo"', html or "")[1:]:
        if m := re.search(r'(?s)<h2[^>]*>\s*<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', part):
            p = re.search(r"(?s)<p[^>]*>(.*?)</p>", part)
            out.append({"title": _plain(m[2]), "url": m[1], "snippet": _plain(p[1]) if p else ""})
    return out[:most]


def tables(text: str) -> tuple[str, list[str]]:
    """(text without its tables, the tables): pipe tables with a rule, and HTML tables, outside fenced code."""
    found, keep, last = [], [], 0
    for m in _PROTECTED.finditer(text):
        if m["f"] is None:
            keep.append(text[last : m.start()])
            found.append(m[0])
            last = m.end()
    return "".join([*keep, text[last:]]), found


def engines(query: str, first, *others) -> list[dict]:
    """The results of the first engine that has any; an engine that fails has none."""
    for engine in (first, *others):
        try:
            found = engine(query)
        except Exception:  # noqa: BLE001  an engine may fail in any way
            found = []
        if found:
            return found
    return []


#: Block kinds of outside parsers and the kinds they count as here; headers, footers and page numbers are dropped.
BLOCK_KINDS = {"title": "heading", "text": "paragraph", "paragraph": "paragraph", "list": "paragraph", "list_item": "paragraph", "code": "paragraph", "table": "table", "image": "figure", "figure": "figure", "chart": "figure", "equation": "paragraph", "formula": "paragraph"}


def normalized_blocks(blocks: DataFrame, kind: str = "type", text: str = "text") -> DataFrame:
    """Blocks of an outside parser under this library's kinds, cleaned of tags; unknown kinds and empty texts are dropped."""
    from pyspark.sql import functions as F

    from kbspark.functions.text import lookup

    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|tr|li)\s*>", "\n"), "<[^>]+>", ""), r"\n\s*\n+", "\n"))
    mapped = blocks.withColumns({kind: lookup(BLOCK_KINDS, F.lower(kind), F.lit(None).cast("string")), text: clean})
    return mapped.where(F.col(kind).isNotNull() & (F.col(text) != ""))
