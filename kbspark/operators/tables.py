"""Tables: grids from cell boxes, headers and spans, and their renderings as lines, Markdown and HTML."""

from __future__ import annotations

import html as _html
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bands(starts: list[float], ends: list[float]) -> list[float]:
    """Beginnings of the rows or columns that ranges make: the shortest first, each a band unless it overlaps one by over half of that."""
    out: list[tuple[float, float]] = []
    for a, b in sorted(zip(starts, ends), key=lambda r: (r[1] - r[0], r[0])):
        if not any(min(y, b) - max(x, a) > 0.5 * min(y - x, b - a) for x, y in out):
            out.append((a, b))
    return sorted(a for a, _ in out)


def grid(cells: list[dict]) -> list[list[str]]:
    """Cell boxes (x0, x1, top, bottom, text) as rows of texts; boxes of one place are joined by a space."""
    if not cells:
        return []
    rows, cols = _bands([c["top"] for c in cells], [c["bottom"] for c in cells]), _bands([c["x0"] for c in cells], [c["x1"] for c in cells])
    out = [["" for _ in cols] for _ in rows]
    for c in sorted(cells, key=lambda c: (c["top"], c["x0"])):
        r = max((i for i, a in enumerate(rows) if a <= c["top"] + 1e-6), default=0)
        k = max((i for i, a in enumerate(cols) if a <= c["x0"] + 1e-6), default=0)
        out[r][k] = f"{out[r][k]} {c['text']}".strip()
    return out


def spans(cells: list[dict]) -> dict[int, tuple[int, int]]:
    """(rows, columns) that a cell covers, where its box holds the middles of more than its own: by the cell's position in the list."""
    rows, cols = _bands([c["top"] for c in cells], [c["bottom"] for c in cells]), _bands([c["x0"] for c in cells], [c["x1"] for c in cells])
    out = {}
    for i, c in enumerate(cells):
        r, k = (sum(lo - 1e-6 <= a < hi for a in starts) for starts, lo, hi in ((rows, c["top"], c["bottom"]), (cols, c["x0"], c["x1"])))
        if max(r, k) > 1:
            out[i] = (max(r, 1), max(k, 1))
    return out


def _numeric(text: str) -> bool:
    t = text.strip().replace(",", "").rstrip("%")
    return bool(t) and t.lstrip("+-").replace(".", "", 1).isdigit()


def header_rows(rows: list[list[str]]) -> int:
    """Leading rows that differ in kind from most of the rest: at least the first of a table whose other rows are mostly numbers in some column."""
    if len(rows) < 2:
        return 0
    kinds = [Counter(_numeric(r[k]) for r in rows[1:] if k < len(r) and r[k].strip()) for k in range(len(rows[0]))]
    mostly = [c.most_common(1)[0][0] if c else False for c in kinds]
    n = 0
    for r in rows[:-1]:
        if any(mostly) and any(m and not _numeric(x) and x.strip() for m, x in zip(mostly, r)):
            n += 1
        else:
            break
    return n or 1


def lines(rows: list[list[str]], caption: str = "") -> list[str]:
    """``head：value; …`` for each data row, heads of several header rows joined by commas, and the caption after it."""
    if not rows:
        return []
    n = header_rows(rows)
    heads = [",".join(dict.fromkeys(r[k] for r in rows[:n] if k < len(r) and r[k])) for k in range(max(map(len, rows)))]
    tail = f" ——{caption}" if caption else ""
    return [t + tail for r in rows[n:] if (t := "; ".join(f"{h}：{v}" if h else v for h, v in zip(heads, r) if v.strip()))]


def markdown(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    fmt = lambda r: "| " + " | ".join((x or "").replace("|", "\\|") for x in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([fmt(rows[0]), "|" + " --- |" * width, *map(fmt, rows[1:])])


def html(rows: list[list[str]], caption: str = "", heads: int | None = None) -> str:
    n = header_rows(rows) if heads is None else heads
    cap = f"<caption>{_html.escape(caption)}</caption>" if caption else ""
    body = "".join("<tr>" + "".join(f"<{'th' if i < n else 'td'}>{_html.escape(x)}</{'th' if i < n else 'td'}>" for x in r) + "</tr>" for i, r in enumerate(rows))
    return f"<table>{cap}{body}</table>"


def html_chunks(rows: list[list[str]], most: int = 256) -> list[str]:
    """A table of the header and at most ``most`` data rows for each part."""
    return [html([rows[0], *rows[i : i + most]], heads=1) for i in range(1, len(rows), most)] if rows else []


def split_html(table: str, most: int, size=lambda t: len(t.split())) -> list[str]:
    """A table's rows in tables of at most ``most`` tokens; a larger row has one by itself, and none is empty."""
    import re

    out, held, used = [], [], 0
    for row in re.findall(r"(?is)<tr.*?</tr>", table):
        n = size(row)
        if held and used + n > most:
            out.append(held)
            held, used = [], 0
        held.append(row)
        used += n
    return ["<table>" + "".join(x) + "</table>" for x in [*out, held] if x]


def from_cells(cells: DataFrame) -> DataFrame:
    """(table_id, seq, line) of tables given as cell boxes; a table is one group."""

    def one(key, g: pd.DataFrame) -> pd.DataFrame:
        found = lines(grid(g.to_dict("records")))
        return pd.DataFrame({"table_id": [key[0]] * len(found), "seq": range(len(found)), "line": found})

    return cells.select("table_id", "x0", "x1", "top", "bottom", F.coalesce("text", F.lit("")).alias("text")).groupBy("table_id").applyInPandas(one, "table_id string, seq int, line string")
