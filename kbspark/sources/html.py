"""HTML: title, body text and links as Column expressions, and blocks in document order by the standard library's parser."""

from __future__ import annotations

import html as _html
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions.text import text_or_empty

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    """The common entities."""
    for a, b in _ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def without_code(html: Column) -> Column:
    """Without scripts, styles, noscripts and comments."""
    out = text_or_empty(html)
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}\s*>", " ")
    return F.regexp_replace(out, r"(?s)<!--.*?-->", " ")


def title(html: Column) -> Column:
    return F.trim(unescape(F.regexp_extract(text_or_empty(html), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def plain_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, r"<[^>]+>", " ")), r"\s+", " "))


def body_text(html: Column) -> Column:
    """The first article, else main, else everything; of it the paragraphs if there are any; as plain text."""
    clean = without_code(html)
    article, main = F.regexp_extract(clean, r"(?is)<article[^>]*>(.*?)</article>", 1), F.regexp_extract(clean, r"(?is)<main[^>]*>(.*?)</main>", 1)
    inner = F.when(article != "", article).when(main != "", main).otherwise(clean)
    paragraphs = F.regexp_extract_all(inner, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1))
    return plain_text(F.when(F.size(paragraphs) > 0, F.array_join(paragraphs, " ")).otherwise(inner))


def links(html: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(html), F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items and tables in order. What stands in a table belongs to it alone."""

    TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int | None, str]] = []
        self.kind: str | None = None
        self.text: list[str] = []
        self.skip = self.table = 0
        self.rows: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.flush()
            self.table += 1
            if self.table == 1:
                self.rows = []
        elif self.table and tag == "tr":
            self.rows.append([])
        elif self.table and tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
        elif not self.table and tag in self.TAGS:
            self.flush()
            self.kind = tag

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.table:
            self.table -= 1
            if not self.table:
                body = "\n".join(" | ".join(" ".join(c.split()) for c in r) for r in self.rows if r)
                if body:
                    self.out.append(("table", None, body))
        elif tag == self.kind:
            self.flush()

    def handle_data(self, data):
        if self.skip:
            return
        if self.table:
            if self.rows and self.rows[-1]:
                self.rows[-1][-1] += data
        elif self.kind:
            self.text.append(data)

    def flush(self):
        t = " ".join("".join(self.text).split())
        if self.kind and t:
            self.out.append(("heading", int(self.kind[1]) - 1, t) if self.kind[0] == "h" else ("item" if self.kind == "li" else "paragraph", None, t))
        self.kind, self.text = None, []


def parse_blocks(html: str | None) -> list[tuple[str, int | None, str]]:
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.out


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, seq, kind, level, text): one row for each block; Arrow batches, a page at a time."""
    kind = dict(pages.dtypes)[key]

    def emit(batches):
        for batch in batches:
            rows = [(k, i, *b) for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, b in enumerate(parse_blocks(h))]
            if rows:
                k, i, t, lv, x = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, batch.schema.field(0).type), pa.array(i, pa.int32()), pa.array(t), pa.array(lv, pa.int32()), pa.array(x)], names=["key", "seq", "kind", "level", "text"])

    return pages.select(key, html).mapInArrow(emit, f"key {kind}, seq int, kind string, level int, text string").withColumnRenamed("key", key)


def sanitize(section: str) -> str:
    """A fragment as text: breaks and closed blocks end lines, other tags go, blank lines close up."""
    import re

    t = _html.unescape(section or "")
    t = re.sub(r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6])\s*>", "\n", t)
    t = re.sub(r"<[^>]+>", "", t)
    return re.sub(r"\n\s*\n+", "\n", "\n".join(x.strip() for x in t.split("\n"))).strip()
