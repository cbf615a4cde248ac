"""Files, markup and JSON."""

import io
import zipfile

from kbspark.sources import files, html, markup


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


W = 'xmlns:w="urn:w"'
DOCX = zipped(**{"word__document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading 1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>'})
XLSX = zipped(**{"xl__workbook.xml": "<workbook><sheets><sheet name='People'/></sheets></workbook>", "xl__sharedStrings.xml": "<sst><si><t>name</t></si><si><t>Ann</t></si></sst>", "xl__worksheets__sheet1.xml": "<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>7</v></c></row><row/><row><c r='A3' t='s'><v>1</v></c><c r='C3'><v>8</v></c></row></sheetData></worksheet>"})


def test_office_files():
    assert files.docx_text(DOCX) == "# Top\n\nbody\n\na | b"
    assert [k for k, _, _ in files.docx_parts(DOCX)] == ["heading", "table", "paragraph"]
    assert files.xlsx_text(XLSX) == "[Sheet: People]\nname\t\t7\nAnn\t\t8"
    assert files.sheet_lines(XLSX) == ["name：Ann; 7：8 ——People"]
    assert files.rtf_text(rb"{\rtf1{\fonttbl{\f0 Arial;}}Hi\par there \u8364?\'e9}") == "Hi\nthere €é"


def test_scan_reads_what_it_can(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "sub" / "b.md").write_bytes("中文".encode("gb18030"))
    (tmp_path / "c.docx").write_bytes(DOCX)
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.bin").write_bytes(b"x")
    got = {r.path.rpartition("/")[2]: r.text for r in files.texts(files.scan(spark, str(tmp_path), ("txt", "md", "docx"))).collect()}
    assert got == {"a.txt": "héllo", "b.md": "中文", "c.docx": "# Top\n\nbody\n\na | b", "d.docx": None}
    both = files.resolve(spark, [str(tmp_path / "a.txt"), "just text"])
    assert {r.text for r in both.collect()} == {"héllo", "just text"}


def test_html_blocks():
    blocks = html.parse_blocks("<h1>A</h1><script>x</script><table><tr><td><p>1</p></td><td>2</td></tr></table><ul><li>i<li>j</ul><p>open")
    assert blocks == [("heading", 0, "A"), ("table", None, "1 | 2"), ("item", None, "i"), ("item", None, "j"), ("paragraph", None, "open")]
    assert html.parse_blocks(None) == []
    assert html.sanitize("a<br>b<p>c</p>&lt;") == "a\nbc\n<"


def test_markdown():
    text = "# A\n\nintro\nmore\n\n```\n# not\n```\n## B\n| x | y |\n|---|---|\n| 1 | 2 |\ntail"
    assert list(markup.blocks(text)) == [("heading", 0, "A"), ("paragraph", None, "intro\nmore"), ("code", None, "```\n# not\n```"), ("heading", 1, "B"), ("table", None, "| x | y |\n| 1 | 2 |"), ("paragraph", None, "tail")]
    assert markup.merged([(0, 5), (5, 8), (10, 12)]) == [(0, 8), (10, 12)]
    assert markup.delimiters("a\\n`END`!") == ["a", "\n", "END", "!"]
    assert markup.delimited("# H\nbody one\n```\na\nb\n```\nend", "\\n") == ["# H\nbody one", "```\na\nb\n```", "end"]
    assert [k for k, _ in markup.elements("# h\ntext\n- a\n- b\n> q\n```\nc\n```")] == ["header", "text", "list", "quote", "code"]


def test_markdown_query_on_odd_texts(spark, tmp_path):
    """Blank lines, white space of several kinds, and ids that repeat or are null (their texts agree, since SQL leaves the order of their lines open)."""
    import duckdb

    from kbspark.plans.registry import ORACLE_SQL, QUERIES

    ends = [x + "a b" + x for x in (" ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\u00a0", "\u2003", "\u2028", "\u3000")]
    texts = ["", "\n", " \n \n", "a\n\nb", "\n\na", "a\n", " \na\n \nb\n ", "a\r\nb\r\n\r\nc", "\t", "\t\n\u3000\n \t ", None, "## a\n#\n####### b\n```\nc\n```\n| x |\n|---|", "\n".join(ends), *ends]
    rows = [*enumerate(texts), *[(100, "x\n\ny\n z")] * 3, *[(None, "n\nm")] * 2, (101, "p\nq"), (101, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = c.execute(ORACLE_SQL["markdown_blocks"]).fetchall()
    found = QUERIES["markdown_blocks"](spark, str(tmp_path))
    assert [x[0] for x in c.description] == found.columns
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    assert list(markup.blocks("# a\r\n## \tb ")) == [("heading", 0, "a"), ("heading", 1, "b")]


def test_json():
    assert markup.is_json_lines('{"a":1}\n{"b":2}') and not markup.is_json_lines('{"a":1}')
    value = {"a": {"x": "y" * 30, "z": 1}, "b": [1, 2], "c": None}
    pieces = markup.json_pieces(value, most=40, least=10)
    joined: dict = {}
    for p in pieces:
        for k, v in p.items():
            joined[k] = {**joined[k], **v} if isinstance(v, dict) and k in joined else v
    assert joined == value and len(pieces) > 1
    assert markup.json_pieces([1, {"a": [2]}], lists=True) == [{"0": 1, "1": {"a": {"0": 2}}}]
    assert markup.json_text(None) == []


def test_search_pages():
    feed = "<item><title>T - S</title><link>u</link><source>S</source><pubDate>d</pubDate></item>"
    assert markup.news_items(feed) == [{"title": "T", "url": "u", "snippet": "S · d"}]
    assert markup.result_items('<li class="b_algo"><h2><a href="u">T&amp;</a></h2><p>s</p>') == [{"title": "T&", "url": "u", "snippet": "s"}]
