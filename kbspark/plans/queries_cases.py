"""Queries over small literal tables: what the driver's tables don't hold (Han text, office files, layouts, rounds of evidence), with the expected rows as SQL values.

Expected values are those of the rules that the operators state, worked out by hand.
"""

from __future__ import annotations

import datetime
import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.functions import parse
from kbspark.functions import text as T
from kbspark.operators import agent, chunking, ingest, layout, loop, models, navigate, resume, search, store, tables, tree
from kbspark.plans.book import Book
from kbspark.sources import files, html, markup, pdf
from kbspark.streaming import flows

_DUCK = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


class Cases(Book):
    """Books with expected rows."""

    def rows(self, name: str, schema: str, build, expected: list[tuple]) -> None:
        """A query whose columns are cast to ``schema`` (name and type pairs), and its rows."""
        fields = [f.split() for f in schema.split(", ")]
        casts = ", ".join(f'CAST(v."{n}" AS {_DUCK[t]}) AS "{n}"' for n, t in fields)
        names = ", ".join(f'"{n}"' for n, _ in fields)
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in expected) or "(" + ", ".join("NULL" for _ in fields) + ")"
        sql = f"SELECT {casts} FROM (VALUES {values}) AS v({names})" + ("" if expected else " WHERE false")
        self.add(name, lambda t: build(t).select(*[F.col(n).cast(k).alias(n) for n, k in fields]), sql)

    def function(self, name: str, cases: dict[str, tuple]) -> None:
        """A Python function of the library on each case, in a worker: {case: (function, arguments, expected)}; results are compared as JSON."""
        def build(t) -> DataFrame:
            calls = {k: (f, args) for k, (f, args, _) in cases.items()}

            @F.arrow_udf("string")
            def result(column: pa.Array) -> pa.Array:
                return pa.array([_json(calls[k][0](*calls[k][1])) for k in column.to_pylist()], pa.string())

            return t.spark.createDataFrame([(k,) for k in calls], "case string").select("case", result(F.col("case")).alias("result"))

        self.rows(name, "case string, result string", build, [(k, _json(expected)) for k, (_, _, expected) in cases.items()])

    def column(self, name: str, kind: str, rule, cases: list[tuple]) -> None:
        """A Column rule on each case: (input, expected)."""
        self.rows(name, f"input string, result {kind}", lambda t: t.spark.createDataFrame([(c,) for c, _ in cases], "input string").select("input", rule(F.col("input")).alias("result")), cases)


Q = Cases()


def _joined(c):
    return F.array_join(c, "|")


# --- text rules ----------------------------------------------------------------------------------------------------------------------

Q.column("case_han", "boolean", T.contains_han, [("系统架构", True), ("abc", False), ("かな", False), ("mixed 中 text", True), ("", False), (None, False)])
Q.column("case_han_or_kana", "boolean", T.contains_han_or_kana, [("系统", True), ("カタカナ", True), ("ひらがな", True), ("abc", False), (None, False)])
Q.column("case_search_tokens", "string", lambda c: _joined(F.array_sort(T.search_tokens(c))), [("系统架构设计", "构设|架构|系统|统架|设计"), ("GPT-4 Scenarios", "4|application|gpt"), ("我", "我"), ("", "")])
Q.column("case_normal_tokens", "string", T.normalize_token, [("personas", "persona"), ("class", "class"), ("personalities", "personality"), ("Scenarios", "application"), ("applications", "application"), ("series", "sery")])
Q.column("case_heading_levels", "long", T.heading_level, [("第一章 x", 0), ("第二节 y", 1), ("1.2.3 x", 2), ("1.2 x", 1), ("1. x", 0), ("A.1 x", 1), ("A. x", 0), ("2024 report", None), ("", None)])
Q.column("case_complexity_rule", "string", T.complexity_rule, [("A和B的区别", "COMPLEX"), ("苹果和香蕉以及梨", "MEDIUM"), ("what is X", ""), ("为什么？怎么做？", "COMPLEX")])
Q.column("case_complexity", "string", T.complexity, [("A和B的区别", "COMPLEX"), ("苹果和香蕉以及梨", "MEDIUM"), ("what is X", "SIMPLE"), (None, "SIMPLE")])
Q.column("case_comparisons", "string", lambda c: _joined(T.split_comparison(c)), [("A、B、C 的 X 的区别", "A 的 X|B 的 X|C 的 X"), ("甲和乙的区别", "甲|乙"), ("what is X", "what is X")])
Q.column("case_question_types", "string", T.question_type, [("第三章讲了什么", "section"), ("这本书的目录", "toc"), ("who wrote it", "normal")])
Q.column("case_routes", "string", lambda c: T.retrieval_route(c, F.lit("")), [("第三章", "tree")])
Q.column("case_tools", "string", T.mode_to_tool, [(" Vector ", "vector"), ("TREE", "tree"), ("hybrid", "hybrid")])
Q.column("case_web_queries", "string", T.clean_web_query, [("纸上的魔法使 紙の上の魔法使い 是什么", "纸上的魔法使"), ("君の名は", "君の名は")])
Q.column("case_fallback_queries", "string", T.fallback_query, [("《三体》是什么", "三体")])
Q.column("case_garbled", "boolean", T.is_garbled, [("(cid:12)(cid:3)", True), ("plain words", False), ("", False)])
Q.column("case_block_types", "string", T.block_type, [("2024年3月", "Dt"), ("12.5%", "Nu"), (None, "Ot")])
Q.column("case_bullet_classes", "long", T.bullet_class, [("第一章 总则", 1), ("1.2.3", -1)])
Q.column("case_captions", "boolean", lambda c: T.is_caption(c, F.lit("")), [("Figure 3 shows", True), ("plain words", False)])
Q.column("case_id_lists", "string", lambda c: _joined(T.id_list(c)), [("1, 2 ,,3", "1|2|3")])
Q.column("case_tags_stripped", "string", lambda c: F.trim(T.strip_tags(c)), [("<b>x</b>", "x"), ("plain", "plain")])
Q.column("case_code_fences", "string", T.strip_code_fence, [('```json\n{"a":1}\n```', '{"a":1}'), ("none", "none")])
Q.column("case_call_marks", "string", T.strip_call_marks, [("a<｜DSML｜x>b</｜DSML｜x>c<|DSML|y>", "ac"), ("plain", "plain")])
Q.column("case_citations", "string", lambda c: T.keep_citations(c, F.lit(2)), [("x[1][7] y[3]", "x[1] y"), ("a[2]", "a[2]")])
Q.column("case_cards", "string", T.document_card, [('{"abstract":"X","keywords":["a","b"]}', "X；关键词：a、b"), ("plain", "plain")])
Q.column("case_result_seqs", "long", T.seq_of_result, [("doc:c12", 12), ("parent:x", -1)])
Q.column("case_degrees", "string", T.degree_name, [("2", "硕士")])
Q.column("case_degree_ids", "string", T.degree_id, [("mba", "6")])
Q.column("case_importance", "double", T.importance, [("0.4", 0.4), ("7", 1.0), ("-1", 0.0)])
Q.rows("case_titles", "a string, b string, same boolean", lambda t: t.spark.createDataFrame([("1.1 Background", "background"), ("Background", "Background and scope"), ("", ""), ("Scope", "Method")], "a string, b string").withColumn("same", T.titles_match(F.col("a"), F.col("b"))),
       [("1.1 Background", "background", True), ("Background", "Background and scope", False), ("", "", False), ("Scope", "Method", False)])
Q.rows("case_box_ids", "id string, px double, py double", lambda t: t.spark.range(1).select(T.box_id(F.lit(1), F.lit(1.5), F.lit(2), F.lit(3), F.lit(4)).alias("id"), T.rotated_point(F.lit(1.0), F.lit(2.0), F.lit(90), F.lit(10.0), F.lit(20.0)).alias("p")).select("id", F.col("p")["x"].alias("px"), F.col("p")["y"].alias("py")), [("1:1.50:2.00:3.00:4.00", 2.0, 19.0)])
Q.rows("case_box_distances", "id long, dx double, dy double", lambda t: t.spark.createDataFrame([(1, 0.0, 10.0, 0.0, 10.0, 14.0, 20.0, 30.0, 40.0), (2, 0.0, 10.0, 0.0, 10.0, 5.0, 15.0, 2.0, 8.0)], "id long, a_x0 double, a_x1 double, a_top double, a_bottom double, b_x0 double, b_x1 double, b_top double, b_bottom double").select("id", T.x_distance("a_", "b_").alias("dx"), T.y_distance("a_", "b_").alias("dy")), [(1, 4.0, 30.0), (2, 5.0, 0.0)])

# --- parsers -------------------------------------------------------------------------------------------------------------------------

_CALL = 'hi <DSML invoke name="f"><DSML parameter name="n" string="false">3</DSML parameter></DSML invoke>'
Q.function("case_parsers", {
    "json in prose": (parse.extract_json, ('note {"a":"}"} tail',), '{"a":"}"}'), "no json": (parse.extract_json, ("none",), None), "null": (parse.extract_json, (None,), None), "list first": (parse.parse_json, ('x [1] {"a": 1}',), None),
    "call": (parse.tool_calls, (_CALL,), ["hi", [{"id": "call_0", "name": "f", "arguments": '{"n": 3}'}]]), "no call": (parse.tool_calls, ("plain",), ["plain", []]),
    "pi": (parse.pi_digits, (20,), "3.14159265358979323846"), "sum": (parse.calculate, ("2*(3+4)^2/7",), '{"result": "14"}'),
})
Q.function("case_models", {
    "default answer": (models.DEFAULTS["answer"], ("q", ["a", "b"]), "[1] a\n\n[2] b"), "one query": (models.DEFAULTS["multi_query"], ("q",), ["q"]), "blank query": (models.DEFAULTS["multi_query"], (" ",), []), "plan": (models.DEFAULTS["plan"], ("q",), [{"id": "R1", "description": "q", "importance": 1.0, "synthetic": False, "deps": []}]),
    "judge without evidence": (models.DEFAULTS["judge"], ("q", ["R1"], []), {"R1": "MISSING"}), "judge": (models.DEFAULTS["judge"], ("q", ["R1"], ["e"]), {"R1": "PARTIAL"}), "short summary": (models.DEFAULTS["summarize"], ("t", "too short"), ""), "summary": (models.DEFAULTS["summarize"], ("t", "Long enough text."), "Long enough text."),
    "abstract": (models.DEFAULTS["abstract"], ("T", ["a", "b"]), "T: a, b"), "translate": (models.DEFAULTS["translate"], ("x",), "x"), "refine": (models.DEFAULTS["refine_query"], ("x", "R1"), "x"), "next": (models.DEFAULTS["choose_next"], ("q", ["n1", "n2"]), "n1"), "web": (models.DEFAULTS["web_search"], ("q",), []),
    "messages": (models.messages, ("sys", [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]), [{"role": "system", "content": "sys"}, {"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]),
    "without system": (models.without_system, ([{"role": "system", "content": "s"}, {"role": "user", "content": "a"}],), [{"role": "user", "content": "s\n\na"}]),
    "reasoning": (models.split_reasoning, ("<think>why</think>yes",), ["yes", "why"]), "open reasoning": (models.split_reasoning, ("so <think>why",), ["so", "why"]), "no reasoning": (models.split_reasoning, ("yes",), ["yes", ""]),
    "scorer": (navigate.token_share, ("red apples", "red pears"), 0.5),
})
Q.function("case_streams", {
    "held": (flows.shown, ("ab<", False), ["ab", "<", False]), "mark": (flows.shown, ("a<|DSML x", False), ["a", "", True]), "end": (flows.shown, ("ab<", False, True), ["ab<", "", False]), "after a mark": (flows.shown, ("x", True), ["", "", True]),
    "open citation": (flows.cited, ("x[1", 2), ["x", "[1"]), "wrong citation": (flows.cited, ("x[1][9] [a", 2), ["x[1] [a", ""]), "last citation": (flows.cited, ("x[1", 2, True), ["x[1", ""]),
    "events": (flows.events, ('data: {"a": 1}\n\n: note\ndata: [DONE]\ndata: {"b": "x:y"}\ndata: broken\n',), [{"a": 1}, {"b": "x:y"}]),
})
Q.rows("case_frames", "frame string", lambda t: flows.frames(t.spark.createDataFrame([("t", "c"), ("done", '"')], "type string, content string")), [('data: {"type":"t","content":"c"}\n\n',), ('data: {"type":"done","content":"\\""}\n\n',)])

# --- files and markup ----------------------------------------------------------------------------------------------------------------


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


_W, _A = 'xmlns:w="urn:w"', 'xmlns:a="urn:a"'
_DOCX = _zipped({"word/document.xml": f'<w:document {_W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading 1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>'})
_XLSX = _zipped({"xl/workbook.xml": "<workbook><sheets><sheet name='People'/></sheets></workbook>", "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>Ann</t></si></sst>", "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>7</v></c></row><row/><row><c r='A3' t='s'><v>1</v></c><c r='C3'><v>8</v></c></row></sheetData></worksheet>"})


def _shape(y: int, text: str) -> str:
    return f'<sp {_A}><a:off x="1" y="{y}"/><a:p><a:t>{text}</a:t></a:p></sp>'


_PPTX = _zipped({"ppt/slides/slide2.xml": f"<s>{_shape(1, 'two')}</s>", "ppt/slides/slide1.xml": f"<s>{_shape(500, 'low')}{_shape(10, 'high')}</s>"})
_EPUB = _zipped({"b.opf": "<p><item id='x' href='z.xhtml'/><item id='y' href='a.xhtml'/><itemref idref='x'/><itemref idref='y'/></p>", "a.xhtml": "<p>last</p>", "z.xhtml": "<h1>first</h1>"})
_ODT = _zipped({"content.xml": "<o><h>T</h><p>x<b>y</b></p></o>"})


def _pdf(objects: dict[int, str]) -> bytes:
    return ("%PDF-1.7\n" + "".join(f"{n} 0 obj\n{x}\nendobj\n" for n, x in objects.items()) + "trailer\n<</Root 1 0 R>>\n").encode()


def _stream(data: str) -> str:
    return f"<</Length {len(data)}>>\nstream\n{data}\nendstream"


_PDF = _pdf({
    1: "<</Type/Catalog/Pages 2 0 R/Outlines 8 0 R>>", 2: "<</Kids[4 0 R 6 0 R]/MediaBox[0 0 600 800]/Resources<</Font<</F 3 0 R>>>>>>", 3: "<</Type/Font/Subtype/Type1/Encoding/WinAnsiEncoding>>",
    4: "<</Type/Page/Contents 5 0 R>>", 5: _stream("BT /F 20 Tf 50 700 Td (1. Part) Tj /F 10 Tf 0 -30 Td [(bo)10(dy)-600(text)] TJ 0 -30 Td /F 16 Tf (Loose title) Tj ET"),
    6: "<</Type/Page/Contents 7 0 R>>", 7: _stream("BT /F 10 Tf 50 700 Td (caf\\351 one) Tj 0 -12 Td (two) Tj 0 -12 Td (three) Tj ET"),
    8: "<</First 9 0 R>>", 9: "<</Title(Part)/Dest[4 0 R/Fit]/First 10 0 R>>", 10: "<</Title(Absent)/Dest[6 0 R/Fit]>>",
})
_FILES = [
    ("a.txt", "txt", "héllo".encode(), "héllo"), ("mark.txt", "txt", "\ufeffmarked".encode(), "marked"), ("b.md", "md", "中文".encode("gb18030"), "中文"), ("c.json", "json", b'{"a": 1}', '{"a": 1}'), ("d.docx", "docx", _DOCX, "# Top\n\nbody\n\na | b"), ("e.xlsx", "xlsx", _XLSX, "[Sheet: People]\nname\t\t7\nAnn\t\t8"),
    ("f.pptx", "pptx", _PPTX, "high\nlow\n\ntwo"), ("g.epub", "epub", _EPUB, "first\n\nlast"), ("h.odt", "odt", _ODT, "T\n\nxy"), ("i.rtf", "rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}Hi\par there \u8364?\'e9}", "Hi\nthere €é"), ("broken.docx", "docx", b"broken", None), ("cut.docx", "docx", _DOCX[:200], None), ("k.pdf", "pdf", b"%PDF", None), ("l.pdf", "pdf", _PDF, "1. Part\nbody text\nLoose title\n\ncafé one\ntwo\nthree"), ("null.txt", "txt", None, None),
]


def _pdfs(t) -> DataFrame:
    return t.spark.createDataFrame([(p, b) for p, x, b, _ in _FILES if x == "pdf"], "path string, content binary")


Q.rows("case_file_texts", "path string, extension string, text string", lambda t: files.texts(t.spark.createDataFrame([(p, x, datetime.datetime(2024, 1, 1), b) for p, x, b, _ in _FILES], "path string, extension string, modified timestamp, content binary")), [(p, x, text) for p, x, _, text in _FILES])
Q.rows("case_pdf_sections", "path string, kind string, level long, page long, top double, text string, source string", lambda t: ingest.pdf_sections(pdf.boxes(_pdfs(t)), pdf.outlines(_pdfs(t))), [
    ("l.pdf", "heading", 0, 1, 100, "Part", "outline"), ("l.pdf", "paragraph", None, 1, 130, "body text", "box"), ("l.pdf", "heading", 0, 1, 160, "Loose title", "box"), ("l.pdf", "heading", 1, 2, -1, "Absent", "outline"),
    ("l.pdf", "paragraph", None, 2, 100, "café one", "box"), ("l.pdf", "paragraph", None, 2, 112, "two", "box"), ("l.pdf", "paragraph", None, 2, 124, "three", "box"),
])
Q.rows("case_pdf_outline", "path string, ord long, title string, level long, page long", lambda t: pdf.outlines(_pdfs(t)), [("l.pdf", 0, "Part", 0, 1), ("l.pdf", 1, "Absent", 1, 2)])
Q.rows("case_path_scan", "name string", lambda t: files.scan(t.spark, t.folder, ("parquet",)).select(F.regexp_extract("path", r"([^/]+\.parquet)", 1).alias("name")).distinct(), [(f"{x}.parquet",) for x in ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")])
Q.rows("case_input_resolver", "source string, text string", lambda t: files.resolve(t.spark, ["just text", "two\nlines"], lambda a: False), [("__text__", "just text"), ("__text__", "two\nlines")])
Q.column("case_structured_kinds", "boolean", files.is_structured, [("PDF", True), ("md", True), ("xlsx", False)])
Q.function("case_office", {
    "docx parts": (lambda b: list(files.docx_parts(b)), (_DOCX,), [["heading", 0, "Top"], ["table", None, "a | b"], ["paragraph", None, "body"]]), "sheet lines": (files.sheet_lines, (_XLSX,), ["name：Ann; 7：8 ——People"]), "sheet rows": (lambda b: len(list(files.xlsx_rows(b))), (_XLSX,), 2),
    "mail": (lambda b: files.eml_text(b).split(), (b"Subject: s\n\nbody\n",), ["s", "body"]),
})
_PAGE = "<h1>A</h1><script>x</script><table><tr><td><p>1</p></td><td>2</td></tr></table><ul><li>i<li>j</ul><p>open"
_MARKDOWN = "# A\n\nintro\nmore\n\n```\n# not\n```\n## B\n| x | y |\n|---|---|\n| 1 | 2 |\ntail"
Q.rows("case_html_blocks", "page_id long, seq long, kind string, level long, text string", lambda t: html.blocks(t.spark.createDataFrame([(1, _PAGE), (2, None)], "page_id long, html string")), [(1, 0, "heading", 0, "A"), (1, 1, "table", None, "1 | 2"), (1, 2, "item", None, "i"), (1, 3, "item", None, "j"), (1, 4, "paragraph", None, "open")])
Q.rows("case_markdown_blocks", "doc_id long, seq long, kind string, level long, text string", lambda t: markup.markdown_blocks(t.spark.createDataFrame([(1, _MARKDOWN), (2, "")], "doc_id long, text string")),
       [(1, 0, "heading", 0, "A"), (1, 1, "paragraph", None, "intro\nmore"), (1, 2, "code", None, "```\n# not\n```"), (1, 3, "heading", 1, "B"), (1, 4, "table", None, "| x | y |\n| 1 | 2 |"), (1, 5, "paragraph", None, "tail")])
_TABLES = "x\n| a | b |\n|---|---|\n| 1 | 2 |\ny\n<table><tr></tr></table>"
Q.function("case_markup", {
    "clean": (html.sanitize, ("a<br>b<p>c</p>&lt;",), "a\nbc\n<"), "ranges": (markup.merged, ([(0, 5), (5, 8), (10, 12)],), [[0, 8], [10, 12]]), "delimiters": (markup.delimiters, ("a\\n`END`!",), ["a", "\n", "END", "!"]), "delimited": (markup.delimited, ("# H\nbody one\n```\na\nb\n```\nend", "\\n"), ["# H\nbody one", "```\na\nb\n```", "end"]),
    "elements": (lambda x: [k for k, _ in markup.elements(x)], ("# h\ntext\n- a\n- b\n> q\n```\nc\n```",), ["header", "text", "list", "quote", "code"]), "tables": (lambda x: len(markup.tables(x)[1]), (_TABLES,), 2),
    "table split": (tables.split_html, ("<table><tr>a b c</tr><tr>d</tr></table>", 2), ["<table><tr>a b c</tr></table>", "<table><tr>d</tr></table>"]),
    "json lines": (markup.is_json_lines, ('{"a":1}\n{"b":2}',), True), "one object": (markup.is_json_lines, ('{"a":1}',), False), "lists as objects": (lambda x: markup.json_pieces(x, lists=True), ([1, {"a": [2]}],), [{"0": 1, "1": {"a": {"0": 2}}}]), "no text": (markup.json_text, (None,), []), "small object": (markup.json_pieces, ({"a": 1},), [{"a": 1}]),
    "news": (markup.news_items, ("<item><title>T - S</title><link>u</link><source>S</source><pubDate>d</pubDate></item>",), [{"title": "T", "url": "u", "snippet": "S · d"}]), "results": (markup.result_items, ('<li class="b_algo"><h2><a href="u">T&amp;</a></h2><p>s</p>',), [{"title": "T&", "url": "u", "snippet": "s"}]),
})
Q.rows("case_normal_blocks", "type string, text string", lambda t: markup.normalized_blocks(t.spark.createDataFrame([("title", "<b>T</b>"), ("page_number", "1"), ("table", "")], "type string, text string")), [("heading", "T")])
Q.rows("case_merged_parts", "at long, part string", lambda t: t.spark.createDataFrame([(["a b", "c", "", "d e f g"],)], "p array<string>").select(F.posexplode(chunking.merged_parts(F.col("p"), 3)).alias("at", "part")), [(0, "a b\nc"), (1, "d e f g")])

# --- layout --------------------------------------------------------------------------------------------------------------------------

_BOXES = "doc_id string, page int, id long, x0 double, x1 double, top double, bottom double, score double, layout_type string, col_id int, text string"


def _boxes(t, *rows, score: float = 0.5):
    """(doc_id, x0, x1, top, bottom, layout_type, text) on the first page; ids follow the order."""
    return t.spark.createDataFrame([(d, 1, i, x0, x1, top, bottom, score - i / 100, kind, 0, text) for i, (d, x0, x1, top, bottom, kind, text) in enumerate(rows)], _BOXES)


def _two(t):
    return _boxes(t, ("a", 0.0, 10.0, 0.0, 10.0, None, "p"), ("b", 50.0, 60.0, 50.0, 60.0, None, "q"), ("b", 0.0, 10.0, 0.0, 10.0, None, "r"))


def _regions(t):
    return _boxes(t, ("a", 0.0, 12.0, 0.0, 12.0, "text", ""), ("a", 0.0, 11.0, 0.0, 11.0, "title", ""), ("b", 45.0, 62.0, 40.0, 70.0, "table", ""))


Q.rows("case_layout_tags", "doc_id string, id long, layout_type string", lambda t: layout.tag(_two(t), _regions(t)), [("a", 0, "title"), ("b", 1, "table"), ("b", 2, None)])
Q.rows("case_box_overlaps", "doc_id string, a_id long, b_id long, share double", lambda t: layout.best_overlap(_two(t), _regions(t)), [("a", 0, 0, 1.0), ("b", 1, 2, 1.0)])
Q.rows("case_box_columns", "doc_id string, a_id long, b_id long", lambda t: layout.tightest_column(_two(t), _regions(t)), [("a", 0, 1), ("b", 1, 2)])
Q.rows("case_caption_regions", "doc_id string, a_id long, b_id long", lambda t: layout.captions_to_regions(_two(t), _regions(t)), [("a", 0, 1), ("b", 1, 2), ("b", 2, 2)])
Q.rows("case_repeated_headers", "doc_id string, text string", lambda t: layout.repeated_texts(t.spark.createDataFrame([("a", "head", "header"), ("a", "head", "header"), ("a", "body", "text"), ("b", "head", "header"), ("b", "body", "text"), ("b", "body", "text")], "doc_id string, text string, layout_type string")), [("a", "body"), ("b", "head"), ("b", "body"), ("b", "body")])
Q.rows("case_suppression", "id long", lambda t: layout.suppress(_boxes(t, ("d", 0.0, 10.0, 0.0, 10.0, "text", "a"), ("d", 1.0, 10.0, 0.0, 10.0, "text", "b"), ("d", 50.0, 60.0, 1.0, 11.0, "text", "c"), ("e", 1.0, 10.0, 0.0, 10.0, "text", "d"))), [(0,), (2,), (3,)])
Q.rows("case_line_merge", "doc_id string, text string", lambda t: layout.merge_horizontal(_boxes(t, ("d", 0.0, 10.0, 0.0, 10.0, "text", "a"), ("d", 11.0, 20.0, 0.0, 10.0, "text", "b"), ("d", 50.0, 60.0, 1.0, 11.0, "text", "c"), ("e", 0.0, 10.0, 0.0, 10.0, "text", "z"))), [("d", "abc"), ("e", "z")])
Q.rows("case_paragraph_merge", "text string", lambda t: layout.merge_vertical(_boxes(t, ("d", 0.0, 90.0, 0.0, 10.0, "text", "the first"), ("d", 0.0, 80.0, 12.0, 22.0, "text", "goes on."), ("d", 0.0, 80.0, 60.0, 70.0, "text", "Another"))), [("the first goes on.",), ("Another",)])
Q.rows("case_bullet_merge", "text string", lambda t: layout.merge_bullets(_boxes(t, ("d", 0.0, 9.0, 0.0, 9.0, "text", "• a"), ("d", 0.0, 9.0, 10.0, 19.0, "text", "• b"), ("d", 0.0, 9.0, 20.0, 29.0, "text", "c"))), [("• a\n• b",), ("c",)])
Q.rows("case_sorted_boxes", "axis string, id long, place long", lambda t: (lambda b: layout.sort_rows(b, 5.0).withColumn("axis", F.lit("y")).unionByName(layout.sort_rows(b, 5.0, "x").withColumn("axis", F.lit("x"))))(_boxes(t, ("d", 50.0, 60.0, 0.0, 10.0, "text", "b"), ("d", 0.0, 10.0, 2.0, 12.0, "text", "a"), ("d", 1.0, 11.0, 40.0, 50.0, "text", "c"))), [("y", 1, 0), ("y", 0, 1), ("y", 2, 2), ("x", 1, 0), ("x", 2, 1), ("x", 0, 2)])
Q.rows("case_reading_order", "doc_id string, id long, reading long", lambda t: layout.reading_order(_boxes(t, ("d", 0.0, 9.0, 20.0, 29.0, "text", "b"), ("d", 0.0, 9.0, 0.0, 9.0, "text", "a"), ("e", 0.0, 9.0, 5.0, 9.0, "text", "z"))), [("d", 0, 2), ("d", 1, 1), ("e", 2, 1)])


def _titles(t):
    return _boxes(t, ("d", 0.0, 9.0, 0.0, 30.0, "title", "Great Work"), ("d", 0.0, 9.0, 40.0, 50.0, "title", "1. Part"), ("d", 0.0, 9.0, 60.0, 70.0, "title", "2. Part"))


Q.rows("case_document_titles", "doc_id string, title string", lambda t: layout.document_title(_titles(t)), [("d", "Great Work")])
Q.rows("case_height_levels", "id long, level long", lambda t: layout.level_by_height(_titles(t)), [(0, 0), (1, 1), (2, 1)])
Q.rows("case_distinct_headings", "ord long, title string", lambda t: layout.distinct_headings(_titles(t).select("doc_id", F.col("id").alias("ord"), F.col("text").alias("title"))), [(0, "Great Work"), (1, "1. Part")])
Q.rows("case_page_columns", "id long, col_id long", lambda t: layout.columns_of_page(_boxes(t, *[("d", x + k * 0.1, x + 90.0, 10.0 * k, 10.0 * k + 8, "text", "t") for x in (0.0, 300.0) for k in range(6)])), [(i, i // 6) for i in range(12)])
Q.rows("case_front_matter", "n long", lambda t: layout.front_matter(_boxes(t, *[("d", 0.0, 100.0, 10.0 * k, 10.0 * k + 8, "text", f"Part {k} ........ {k}") for k in range(5)])).agg(F.count("*").alias("n")), [(0,)])
Q.rows("case_scraps", "text string", lambda t: layout.without_scraps(_boxes(t, ("d", 0.0, 100.0, 0.0, 8.0, "text", "wide"), ("d", 0.0, 5.0, 10.0, 18.0, "text", "xyz"), ("d", 0.0, 5.0, 20.0, 28.0, "text", "1.2 a"))), [("wide",), ("1.2 a",)])
Q.rows("case_word_gaps", "id long, spaced string", lambda t: layout.word_gaps(t.spark.createDataFrame([("d", 1, 1, i, float(10 * i + (20 if i > 1 else 0)), float(10 * i + 9 + (20 if i > 1 else 0)), c) for i, c in enumerate("abc")], "doc_id string, page int, line int, id long, x0 double, x1 double, text string")), [(0, "a"), (1, "b "), (2, "c")])
Q.rows("case_garbled_fonts", "doc_id string, garbled boolean", lambda t: layout.garbled_fonts(t.spark.createDataFrame([("d", 1, "ABCDEF+X", "%")] * 25, "doc_id string, page int, font string, text string")), [("d", True)])
_CELLS = [{"x0": 10.0 * k, "x1": 10.0 * k + 8, "top": 10.0 * r, "bottom": 10.0 * r + 8, "text": x} for r, row in enumerate((("name", "age"), ("Ann", "7"), ("Bob", "8"))) for k, x in enumerate(row)]
_GRID = [["name", "age"], ["Ann", "7"], ["Bob", "8"]]
Q.function("case_tables", {
    "grid": (tables.grid, (_CELLS,), _GRID), "empty grid": (tables.grid, ([],), []), "heads": (tables.header_rows, (_GRID,), 1), "lines": (tables.lines, (_GRID, "People"), ["name：Ann; age：7 ——People", "name：Bob; age：8 ——People"]), "markdown": (tables.markdown, (_GRID,), "| name | age |\n| --- | --- |\n| Ann | 7 |\n| Bob | 8 |"),
    "html chunks": (lambda r: len(tables.html_chunks(r, 1)), (_GRID,), 2), "spans": (lambda c: {str(k): list(v) for k, v in tables.spans(c).items()}, ([*_CELLS, {"x0": 0.0, "x1": 18.0, "top": 30.0, "bottom": 38.0, "text": "all"}],), {"6": [1, 2]}), "labels": (layout.greedy_labels, ([1, 1, 0, 1, 2],), [1, 1, 2]),
})
Q.rows("case_table_lines", "table_id string, line string", lambda t: tables.from_cells(t.spark.createDataFrame([{"table_id": "t", **c} for c in _CELLS])), [("t", "name：Ann; age：7"), ("t", "name：Bob; age：8")])

# --- trees, ingest and the stored index ------------------------------------------------------------------------------------------------

_TEXT = "lead\n\n# A\n\nintro\n\nmore\n\n## B\n\ntext\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n# C\n\n" + "z" * 900


def _docs(t):
    return t.spark.createDataFrame([(1, _TEXT), (2, None), (3, "plain line")], "doc_id long, text string")


_NODES = [
    ("1", "1:root", None, "document", "1", "", None, -1, ""), ("1", "1:node:0", "1:root", "paragraph", "", "lead", None, 0, ""), ("1", "1:node:1", "1:root", "section", "A", "", 0, 1, "0"), ("1", "1:node:2", "1:node:1", "paragraph", "", "intro", None, 2, "0"), ("1", "1:node:3", "1:node:1", "paragraph", "", "more", None, 3, "0"),
    ("1", "1:node:4", "1:node:1", "section", "B", "", 1, 4, "0/0"), ("1", "1:node:5", "1:node:4", "paragraph", "", "text", None, 5, "0/0"), ("1", "1:node:6", "1:node:4", "table", "", "| x | y |\n| 1 | 2 |", None, 6, "0/0"), ("1", "1:node:7", "1:root", "section", "C", "", 0, 7, "1"), ("1", "1:node:8", "1:node:7", "paragraph", "", "z" * 900, None, 8, "1"),
    ("2", "2:root", None, "document", "2", "", None, -1, ""), ("3", "3:root", None, "document", "3", "", None, -1, ""), ("3", "3:node:0", "3:root", "paragraph", "", "plain line", None, 0, ""),
]
Q.rows("ingest_nodes", "doc_id string, node_id string, parent_id string, type string, title string, text string, level long, ord long, path string", lambda t: ingest.nodes(_docs(t)).withColumn("path", store.stored_path(F.col("section_path"))), _NODES)
_CHUNKS = [
    ("1:chunk:0", 0, "lead", "1:root", "1:node:0", ""), ("1:chunk:1", 1, "intro\n\nmore", "1:node:1", "1:node:2,1:node:3", "0"), ("1:chunk:2", 2, "text\n\n| x | y |\n| 1 | 2 |", "1:node:4", "1:node:5,1:node:6", "0/0"),
    ("1:chunk:3", 3, "z" * 800, "1:node:8", "1:node:8", "1"), ("1:chunk:4", 4, "z" * 100, "1:node:8", "1:node:8", "1"), ("3:chunk:0", 0, "plain line", "3:root", "3:node:0", ""),
]
Q.rows("ingest_chunks", "chunk_id string, chunk_seq long, text string, parent_node_id string, sources string, path string", lambda t: ingest.chunks(ingest.nodes(_docs(t))).withColumns({"sources": F.array_join("source_node_ids", ","), "path": store.stored_path(F.col("section_path"))}), _CHUNKS)
Q.rows("ingest_chunk_counts", "doc_id string, n long", lambda t: store.count_by(ingest.chunks(ingest.nodes(_docs(t))), "doc_id"), [("1", 5), ("3", 1)])
Q.rows("case_mixed_leaves", "seq long, n long", lambda t: chunking.leaf_chunks(t.spark.createDataFrame([("s", i, "y" * n) for i, n in enumerate((100, 100, 200, 850))], "section_id string, ord int, text string")).select("seq", F.length("chunk_text").alias("n")), [(0, 202), (1, 200), (2, 800), (3, 50)])


def _tree(t):
    return ingest.nodes(_docs(t))


Q.rows("case_point_lookup", "node_id string, title string", lambda t: store.lookup(_tree(t), "node_id", "1:node:4"), [("1:node:4", "B")])
Q.rows("case_document_lookup", "node_id string", lambda t: store.lookup(_tree(t), "doc_id", "3"), [("3:root",), ("3:node:0",)])
Q.rows("case_roots", "doc_id string, root string", lambda t: store.root_of(_tree(t)).unionByName(store.root_of(_tree(t).where("type <> 'document'").withColumn("parent_id", F.when(~F.col("parent_id").endswith("root"), F.col("parent_id"))).withColumn("doc_id", F.concat(F.lit("x"), "doc_id")))), [("1", "1:root"), ("2", "2:root"), ("3", "3:root"), ("x1", "1:node:0"), ("x3", "3:node:0")])
Q.rows("case_distinct_titles", "doc_id string, titles string", lambda t: (lambda n: store.distinct_titles(n, tree.closure(n), ["1:node:6", "1:node:8", "3:node:0"]))(_tree(t)), [("1", "1 > A > B"), ("3", "3")])
Q.rows("case_containers", "node_id string, kind string", lambda t: _tree(t).where("doc_id = '1' and ord between 4 and 6").select("node_id", F.when(F.col("type").isin(*navigate.CONTAINERS), "container").otherwise("leaf").alias("kind")), [("1:node:4", "container"), ("1:node:5", "leaf"), ("1:node:6", "leaf")])
Q.rows("case_toc", "doc_id string, toc string", lambda t: tree.toc(_tree(t).where("type = 'section'")), [("1", "# A\n## B\n# C")])
Q.rows("case_rebuild", "doc_id string, rebuild boolean", lambda t: tree.lacks_structure(t.spark.createDataFrame([("bare", "paragraph", None), ("good", "section", None), ("good", "paragraph", "s"), ("good", "paragraph", "s"), ("flat", "section", None), ("flat", "paragraph", None), ("flat", "paragraph", None), ("flat", "paragraph", "s")], "doc_id string, type string, parent_id string")), [("bare", True), ("good", False), ("flat", True)])
Q.rows("case_deep_ancestors", "ancestor string, dist long", lambda t: tree.closure(t.spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(20)], "node_id string, parent_id string")).where("node = '19'"), [(str(19 - i), i) for i in range(20)])

# --- stores and conversations ------------------------------------------------------------------------------------------------------------


def _store(t):
    parents = t.spark.createDataFrame([("p1", "s", "one"), ("p2", "s", "two")], "parent_id string, source string, text string")
    children = t.spark.createDataFrame([(1, "p1", "d", "c" * 150, 2), (2, "p1", "d", "b", 1), (3, "p2", "e", "a", 0)], "id long, parent_id string, doc_id string, text string, chunk_seq long")
    return parents, children


Q.rows("case_counts", "kind string, count long, parent_count long", lambda t: store.counts(*_store(t)).withColumn("kind", F.lit("nested")).unionByName(store.counts(*_store(t), flat=True).withColumn("kind", F.lit("flat"))), [("nested", 3, 2), ("flat", 3, 0)])
Q.rows("case_children", "id long, preview string", lambda t: store.children_of(_store(t)[1], "p1"), [(1, "c" * 120), (2, "b")])
Q.rows("case_tree_children", "id long, preview string", lambda t: store.children_of(_store(t)[1], "tree:e"), [(3, "a")])
Q.rows("case_delete_parent", "kind string, id long", lambda t: store.delete_parent({"c": _store(t)[1]}, "p1")["c"].withColumn("kind", F.lit("parent")).unionByName(store.delete_parent({"c": _store(t)[1]}, "tree:d")["c"].withColumn("kind", F.lit("tree"))), [("parent", 3), ("tree", 3)])
Q.rows("case_delete_child", "id long", lambda t: store.delete_by(_store(t)[1], t.spark.createDataFrame([(2,)], "id long"), "id"), [(1,), (3,)])
Q.rows("case_truncate", "id long", lambda t: store.truncate(_store(t)[1]), [])
Q.rows("case_sorted_neighbours", "chunk_seq long", lambda t: search.neighbours(_store(t)[1].where("id = 2"), _store(t)[1], 2).orderBy("chunk_seq"), [(2,)])
Q.rows("case_neighbour_budget", "doc_id long, chunk_seq long, n long", lambda t: (lambda c: search.within_budget(c.where("(doc_id = 1 and chunk_seq = 1) or doc_id = 2").withColumn("rank", F.when(F.col("doc_id") == 1, 1).otherwise(2)), search.neighbours(c.where("(doc_id = 1 and chunk_seq = 1) or doc_id = 2"), c), 100))(t.spark.createDataFrame([(1, i, "c" * n) for i, n in enumerate((25, 40, 10))] + [(2, 0, "h" * 30)], "doc_id long, chunk_seq long, text string")), [(1, 0, 25)])
Q.rows("case_page", "id long", lambda t: store.page(_store(t)[1], ["id"], 2, 1), [(2,), (3,)])
Q.rows("case_conversation_titles", "conv_id long, title string", lambda t: store.titled(store.title_of(t.spark.createDataFrame([(1, "新对话", " what is it "), (2, "kept", "x"), (3, None, "y")], "conv_id long, title string, q string")).join(t.spark.createDataFrame([(1, " what is it "), (2, "x"), (3, "y")], "conv_id long, q string"), "conv_id"), F.col("q")), [(1, "what is it"), (2, "kept"), (3, "")])
Q.rows("case_exchange", "conv_id long, turn long, role string, text string", lambda t: store.exchange(t.spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b")], "conv_id long, turn long, role string, text string"), 1, "q", "r"), [(1, 0, "user", "a"), (2, 0, "user", "b"), (1, 1, "user", "q"), (1, 2, "assistant", "r")])
_HITS = "id string, text string, score double, source string"
Q.rows("case_result_rows", "id string, text string, score double, source string", lambda t: store.result_rows(t.spark.createDataFrame([("a", " x ", 0.123456, "s"), ("tree:n", "y", 1.0, None)], _HITS)), [("a", "x", 0.1235, "s"), ("tree:n", "y", 1.0, "")])
Q.rows("case_evidence_rows", "id string, text string, score double, origin string, round long", lambda t: store.evidence_rows(t.spark.createDataFrame([("a", " x ", 0.5, "s"), ("", "y", 1.0, "s"), (None, "z", 1.0, "s")], _HITS), 2, "vector"), [("a", "x", 0.5, "vector", 2)])
Q.rows("case_docs_brief", "brief string", lambda t: store.docs_brief(t.spark.createDataFrame([(1, "a  b", 0.5), (2, "x" * 200, 0.25), (4, "late", 0.1)], "rank int, text string, score double")), [("- [0.50] a b\n- [0.25] " + "x" * 160,)])
Q.rows("case_readable_sources", "id string, source string", lambda t: store.readable_sources(t.spark.createDataFrame([("tree:1:node:4", None), ("c1", "3:root"), ("c2", "gone")], "id string, node_id string"), t.spark.createDataFrame([("1", "First"), ("3", "Third")], "doc_id string, title string"), _tree(t)), [("tree:1:node:4", "First / B"), ("c1", "Third / 3"), ("c2", "")])
Q.rows("case_calibrated", "ord long, title string, top double", lambda t: store.calibrated(t.spark.createDataFrame([("d", 1, "1. Part"), ("d", 2, "Part"), ("d", 3, "Other")], "doc_id string, ord long, title string"), t.spark.createDataFrame([("d", 7, 1, 5.0, "Part"), ("d", 8, 2, 6.0, "part")], "doc_id string, id long, page int, top double, text string")), [(1, "1. Part", 5.0), (2, "Part", None), (3, "Other", None)])
Q.rows("case_empty_base", "empty boolean", lambda t: t.spark.range(1).select(F.lit(store.truncate(_store(t)[0]).isEmpty()).alias("empty")), [(True,)])

# --- evidence, walks and the loop ------------------------------------------------------------------------------------------------------------

Q.column("case_status_aliases", "string", agent.normalize_status, [("supported", "SUPPORTED"), (" Partial ", "PARTIAL"), ("PARTIALLY", "PARTIAL"), ("none", "MISSING"), ("EMPTY", "MISSING"), ("missing", "MISSING"), ("COMPLETE", "PARTIAL"), ("SUPPORT", "PARTIAL"), ("", "PARTIAL"), (None, "PARTIAL")])
Q.column("case_retryable", "boolean", store.retryable, [("HTTP 429", True), ("HTTP 500", True), ("HTTP 501", False), ("HTTP 502", True), ("HTTP 503", True), ("HTTP 504", True), ("HTTP 505", False), ("HTTP 400", False), ("HTTP 402", False), ("connection refused", True), ("refused", True), ("read timed out", True), ("ConnectionError: x", True), ("invalid parameter: timeout", False), ("insufficient balance", False), ("ValueError: timeout", False), ("FileNotFoundError: x", False), ("odd", False), (None, False)])
_ROUNDS = [("a", 1, "PARTIAL"), ("a", 2, "PARTIAL"), ("a", 3, "PARTIAL"), ("a", 4, "SUPPORTED"), ("a", 5, "SUPPORTED"), ("b", 1, "MISSING"), ("b", 2, "MISSING"), ("b", 3, "MISSING"), ("b", 4, "MISSING"), ("b", 5, "MISSING")]
Q.rows("case_no_progress", "round long, streak long", lambda t: agent.no_progress(t.spark.createDataFrame(_ROUNDS, "id string, round int, status string")), [(1, 0), (2, 1), (3, 2), (4, 0), (5, 1)])
Q.rows("case_upgrades", "round long, id string", lambda t: agent.upgraded(t.spark.createDataFrame(_ROUNDS, "id string, round int, status string")), [(1, "a"), (4, "a")])
Q.rows("case_evidence_order", "place long, id string", lambda t: agent.evidence_order(t.spark.createDataFrame([("x", 0.1, True), ("y", 0.2, False), ("z", 0.9, False)], "id string, score double, is_neighbor boolean")).coalesce(1).withColumn("place", F.monotonically_increasing_id()), [(0, "z"), (1, "y"), (2, "x")])
Q.rows("case_rrf", "id string, score double", lambda t: search.rrf([t.spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 1.0)], "id string, score double"), t.spark.createDataFrame([("x", 9.0), ("w", 8.0), ("y", 7.0)], "id string, score double")]), [("x", 0.983607), ("y", 0.960061), ("w", 0.483871), ("z", 0.47619)])


def _node(key, parent, kind, order, title="", text=""):
    return {"node_id": key, "parent_id": parent, "type": kind, "title": title, "summary": "", "text": text, "ord": order}


_WALKED = [
    _node("r", None, "document", 0), _node("a", "r", "section", 1, "red apples"), _node("b", "r", "section", 2, "blue"), _node("x", "a", "paragraph", 1, text="red apples here"), _node("y", "a", "paragraph", 2, text="beside"), _node("z", "b", "paragraph", 1, text="sky"),
    _node("c", "a", "section", 3, "apples"), _node("d", "a", "section", 4, "grey"), _node("v", "c", "paragraph", 1, text="red apples again"), _node("w", "d", "paragraph", 1, text="stone"),
]


def _walk(query: str, **limits):
    found, steps = navigate.walk(_WALKED, query, limits=navigate.Limits(**limits))
    return {"found": [[f["node_id"], f["score"], f["ambiguous"], f["is_neighbor"]] for f in found], "steps": [f"{s['action']} {s['node_id']}".strip() for s in steps]}


Q.function("case_walk", {
    "down and back": (_walk, ("red apples",), {"found": [["v", 1.0, False, False], ["x", 1.0, False, False], ["y", 0.0, False, True]], "steps": ["expand a", "read x", "prune y", "prune d", "descend a", "expand c", "read v", "backtrack c", "backtrack a", "expand b", "prune z", "backtrack b"]}),
    "enough": (lambda: _walk("red apples", enough=1), (), {"found": [["x", 1.0, False, False], ["y", 0.0, False, True]], "steps": ["expand a", "read x", "prune y", "prune d", "stop a"]}),
    "budget": (lambda: _walk("red apples", expansions=1), (), {"found": [["x", 1.0, False, False], ["y", 0.0, False, True]], "steps": ["expand a", "read x", "prune y", "prune d", "stop a"]}),
    "depth": (lambda: _walk("red apples", depth=1), (), {"found": [["x", 1.0, False, False], ["y", 0.0, False, True]], "steps": ["expand a", "read x", "prune y", "prune d", "backtrack a", "expand b", "prune z", "backtrack b"]}),
    "rescue": (_walk, ("green",), {"found": [["x", 0.0, True, False], ["y", 0.0, True, False], ["z", 0.0, True, False]], "steps": ["expand a", "prune x", "prune y", "prune c", "prune d", "backtrack a", "expand b", "prune z", "backtrack b", "rescue"]}),
    "doubt": (lambda: [f["ambiguous"] for f in navigate.walk(_WALKED, "red plums green")[0]], (), [True, True, False]),
    "no tree": (lambda: list(navigate.walk([], "q")), (), [[], []]),
    "no scorer": (lambda: [f["node_id"] for f in navigate.walk(_WALKED, "q", None)[0]], (), ["x", "y"]),
    "a model goes back": (lambda: [s["action"] for s in navigate.walk(_WALKED, "q", None, choose=lambda q, nodes: None, limits=navigate.Limits(enough=9))[1]], (), ["expand", "read", "read", "backtrack", "expand", "read", "backtrack"]),
    "routing": (lambda: [d["node_id"] for d in navigate.routed_search(["a", "b", "c"], lambda d: [{"node_id": d}], lambda d, f: d != "a")], (), ["a"]),
    "routing without a judge": (lambda: [d["node_id"] for d in navigate.routed_search(["a", "b", "c", "d"], lambda d: [{"node_id": d}], lambda d, f: True, judge=False)], (), ["a", "b", "c"]),
})


def _hit(key: str, score: float = 1.0) -> dict:
    return {"id": key, "text": f"t{key}", "score": score}


def _loop(judge=None, search_=None, complexity: str = "SIMPLE", read=None, **functions):
    kinds = functions | ({"judge": judge} if judge else {})
    result = loop.run("q", search_ or (lambda q: [_hit("1")]), models.Models(**kinds), complexity, read)
    return {"stop": result["stop"], "actions": [r["action"] for r in result["rounds"]], "new": [r["new"] for r in result["rounds"]], "cited": [c["id"] for c in result["citations"]], "coverage": result["coverage"]}


Q.function("case_loop", {
    "two rounds": (_loop, (), {"stop": "hard: iterations", "actions": ["SEARCH", "REFINE_QUERY"], "new": [1, 0], "cited": ["1"], "coverage": 0.0}),
    "supported": (lambda: _loop(lambda q, r, e: dict.fromkeys(r, "SUPPORTED")), (), {"stop": "sufficiency", "actions": ["SEARCH"], "new": [1], "cited": ["1"], "coverage": 1.0}),
    "web after idle rounds": (lambda: _loop(complexity="COMPLEX", web_search=lambda q: [_hit("w", 0.5)], judge=lambda q, r, e: dict.fromkeys(r, "PARTIAL" if len(e) == 1 else "SUPPORTED")), (), {"stop": "sufficiency", "actions": ["SEARCH", "REFINE_QUERY", "REFINE_QUERY", "WEB_SEARCH"], "new": [1, 0, 0, 1], "cited": ["1", "w"], "coverage": 1.0}),
    "no progress": (lambda: _loop(complexity="COMPLEX", search_=lambda q: []), (), {"stop": "no_progress", "actions": ["SEARCH", "SEARCH", "WEB_SEARCH"], "new": [0, 0, 0], "cited": [], "coverage": 0.0}),
    "reading": (lambda: _loop(complexity="MEDIUM", read=lambda e: [_hit(e["id"] + "n", 0.1)], choose_action=lambda s: {"type": "read"}, judge=lambda q, r, e: dict.fromkeys(r, "SUPPORTED" if len(e) > 1 else "PARTIAL")), (), {"stop": "sufficiency", "actions": ["SEARCH", "READ"], "new": [1, 1], "cited": ["1", "1n"], "coverage": 1.0}),
    "the model answers": (lambda: _loop(choose_action=lambda s: "ANSWER"), (), {"stop": "answer", "actions": ["SEARCH"], "new": [1], "cited": ["1"], "coverage": 0.0}),
    "unknown action": (lambda: _loop(choose_action=lambda s: "DANCE"), (), {"stop": "hard: iterations", "actions": ["SEARCH", "REFINE_QUERY"], "new": [1, 0], "cited": ["1"], "coverage": 0.0}),
    "best eight": (lambda: len(_loop(search_=lambda q: [_hit(str(i), i / 100) for i in range(20)])["cited"]), (), 8),
    "web budget": (lambda: [loop.can_search_web(loop.State("q", [], web_calls=w, idle=i)) for w, i in ((0, 1), (0, 2), (1, 3), (2, 3))], (), [False, True, True, False]),
    "names": (lambda: [loop.matched_id(x, ["R1", "R2.1"]) for x in ("r1", "[R1]", " R2-1 ", "R9")], (), ["R1", "R1", "R2.1", None]),
    "limits": (lambda: [loop.ROUNDS, loop.MAX_CALLS, loop.WEB_CALLS], (), [{"SIMPLE": 2, "MEDIUM": 3, "COMPLEX": 5}, 12, 2]),
    "cache": (lambda: (lambda c: (c.put("What is", 1), c.put("b", 2), c.get("what  IS"), c.get("c"))[2:])(loop.Cache(lambda a, b: 0.0)), (), [1, None]),
})

# --- records -----------------------------------------------------------------------------------------------------------------------------

Q.rows("case_resume", "degree string, age long, company string", lambda t: t.spark.createDataFrame([(["本科", "硕士"], "2000-01-01")], "d array<string>, b string").select(resume.highest_degree(F.col("d")).alias("degree"), resume.age(F.to_date("b"), F.lit("2024-05-05").cast("date")).alias("age"), resume.company_norm(F.lit("Acme (China) Ltd")).alias("company")), [("硕士", 24, "acme")])
Q.rows("case_regions", "name string, is_region boolean", lambda t: resume.is_region(t.spark.createDataFrame([("北京",), ("上海市",), ("x",)], "name string"), t.spark.createDataFrame([("北京市",), ("上海市",)], "region string")), [("北京", True), ("上海市", True), ("x", False)])
Q.rows("case_region_paths", "id long, names string", lambda t: (lambda r: resume.ancestors(r, r.select("id")))(t.spark.createDataFrame([(1, None, "a"), (2, 1, "b")], "id int, parent_id int, name string")).select("id", F.array_join("names", "/").alias("names")), [(1, "a"), (2, "b/a")])
Q.rows("case_flat_records", "id long, name string, married string", lambda t: resume.flatten(t.spark.createDataFrame([(1, '{"name": "A", "married": "Y"}')], "id int, cv string"), "name string, married string"), [(1, "A", "是")])
