"""Boxes and tables on small cases."""

from pyspark.sql import functions as F

from kbspark.operators import chunking, layout, tables
from kbspark.sources import markup

COLS = "doc_id string, page int, id long, x0 double, x1 double, top double, bottom double, layout_type string, col_id int, text string"


def boxes(spark, *rows):
    return spark.createDataFrame([("d", 1, i, *r) for i, r in enumerate(rows)], COLS)


def test_merges(spark):
    b = boxes(spark, (0.0, 90.0, 0.0, 10.0, "text", 0, "the first"), (0.0, 80.0, 12.0, 22.0, "text", 0, "goes on."), (0.0, 80.0, 60.0, 70.0, "text", 0, "Another"))
    assert [r.text for r in layout.merge_vertical(b).orderBy("top").collect()] == ["the first goes on.", "Another"]
    c = boxes(spark, (0.0, 9.0, 0.0, 9.0, "text", 0, "• a"), (0.0, 9.0, 10.0, 19.0, "text", 0, "• b"), (0.0, 9.0, 20.0, 29.0, "text", 0, "c"))
    assert [r.text for r in layout.merge_bullets(c).orderBy("top").collect()] == ["• a\n• b", "c"]


def test_merges_by_their_marks(spark):
    line = lambda i, text, kind="text", col=0, gap=2.0: (0.0, 80.0, i * (10.0 + gap), i * (10.0 + gap) + 10.0, kind, col, text)
    texts = lambda *lines, **more: [r.text for r in layout.merge_vertical(boxes(spark, *lines), **more).orderBy("top").collect()]
    assert texts(line(0, "see the list："), line(1, "Items")) == ["see the list： Items"]
    assert texts(line(0, "Done。"), line(1, "Next")) == ["Done。", "Next"]
    assert texts(line(0, "Done。"), line(1, "）more")) == ["Done。 ）more"]
    assert texts(line(0, "a;。"), line(1, "b")) == ["a;。 b"]
    assert texts(line(0, "The end."), line(1, "Next")) == ["The end. Next"] and texts(line(0, "The end."), line(1, "Next"), english=True) == ["The end.", "Next"]
    assert texts(line(0, "one", col=0), line(1, "two", col=1)) == ["one two"]
    assert texts(line(0, "one"), line(1, "two", "title")) == ["one", "two"]
    assert texts(line(0, "one"), line(1, " "), line(2, "two")) == ["one two"]
    numbered = boxes(spark, line(0, "one"), line(1, "two")).withColumn("layout_no", F.col("id"))
    assert layout.merge_vertical(numbered).count() == 2
    cells = boxes(spark, (0.0, 9.0, 0.0, 10.0, "table", 0, "left"), (10.0, 19.0, 0.0, 10.0, "table", 0, "right"))
    assert sorted(r.text for r in layout.merge_horizontal(cells).collect()) == ["left", "right"]
    high = boxes(spark, (0.0, 9.0, 0.0, 10.0, "text", 0, "in"), (10.0, 19.0, 2.0, 12.0, "text", 0, "line"), (20.0, 29.0, 6.0, 16.0, "text", 0, "not"))
    got = layout.merge_horizontal(high).orderBy("x0").collect()
    assert [(r.text, r.x0, r.x1, r.top, r.bottom) for r in got] == [("inline", 0.0, 19.0, 1.0, 11.0), ("not", 20.0, 29.0, 6.0, 16.0)]
    marks = boxes(spark, line(0, "1 a"), line(1, "1 b"), line(2, "a c"), line(3, "a d"), line(4, "第一"), line(5, "第二"))
    assert [r.text for r in layout.merge_bullets(marks).orderBy("top").collect()] == ["1 a\n1 b", "a c", "a d", "第一", "第二"]


def test_regions(spark):
    b = boxes(spark, (0.0, 10.0, 0.0, 10.0, None, 0, "a"), (50.0, 60.0, 50.0, 60.0, None, 0, "b"))
    r = boxes(spark, (0.0, 12.0, 0.0, 12.0, "text", 0, ""), (0.0, 11.0, 0.0, 11.0, "title", 0, ""), (45.0, 56.0, 40.0, 70.0, "table", 0, ""))
    assert {x.id: x.layout_type for x in layout.tag(b, r).collect()} == {0: "title", 1: "table"}
    assert {x.a_id: x.b_id for x in layout.captions_to_regions(b, r).collect()} == {0: 1, 1: 2}
    assert {x.a_id: x.b_id for x in layout.tightest_column(b, r).collect()}[1] == 2


def test_columns_and_titles(spark):
    b = boxes(spark, *[(x + k * 0.1, x + 90.0, 10.0 * k, 10.0 * k + 8, "text", 0, "t") for x in (0.0, 300.0) for k in range(6)])
    assert {(r.x0 > 200, r.col_id) for r in layout.columns_of_page(b).collect()} == {(False, 0), (True, 1)}
    t = boxes(spark, (0.0, 9.0, 0.0, 30.0, "title", 0, "Great Work"), (0.0, 9.0, 40.0, 50.0, "title", 0, "1. Part"), (0.0, 9.0, 60.0, 70.0, "title", 0, "2. Part"))
    assert layout.document_title(t).first().title == "Great Work"
    assert {r.id: r.level for r in layout.level_by_height(t).collect()} == {0: 0, 1: 1, 2: 1}
    h = t.select("doc_id", F.col("id").alias("ord"), F.col("text").alias("title"))
    assert [r.title for r in layout.distinct_headings(h).orderBy("ord").collect()] == ["Great Work", "1. Part"]


def test_filters(spark):
    b = boxes(spark, *[(0.0, 100.0, 10.0 * k, 10.0 * k + 8, "text", 0, f"Part {k} ........ {k}") for k in range(5)])
    assert layout.front_matter(b).count() == 0
    s = boxes(spark, (0.0, 100.0, 0.0, 8.0, "text", 0, "wide"), (0.0, 5.0, 10.0, 18.0, "text", 0, "xyz"), (0.0, 5.0, 20.0, 28.0, "text", 0, "1.2 a"))
    assert sorted(r.text for r in layout.without_scraps(s).collect()) == ["1.2 a", "wide"]
    chars = spark.createDataFrame([("d", 1, 1, i, float(10 * i + (20 if i > 1 else 0)), float(10 * i + 9 + (20 if i > 1 else 0)), c) for i, c in enumerate("abc")], "doc_id string, page int, line int, id long, x0 double, x1 double, text string")
    assert "".join(r.spaced for r in layout.word_gaps(chars).orderBy("id").collect()) == "ab c"
    fonts = spark.createDataFrame([("d", 1, "ABCDEF+X", "%")] * 25, "doc_id string, page int, font string, text string")
    assert layout.garbled_fonts(fonts).first().garbled


def test_tables(spark):
    cells = [{"x0": 10.0 * k, "x1": 10.0 * k + 8, "top": 10.0 * r, "bottom": 10.0 * r + 8, "text": t} for r, row in enumerate((("name", "age"), ("Ann", "7"), ("Bob", "8"))) for k, t in enumerate(row)]
    rows = tables.grid(cells)
    assert rows == [["name", "age"], ["Ann", "7"], ["Bob", "8"]] and tables.header_rows(rows) == 1
    assert tables.lines(rows, "People") == ["name：Ann; age：7 ——People", "name：Bob; age：8 ——People"]
    assert tables.markdown(rows).split("\n")[1] == "| --- | --- |"
    assert tables.html(rows).startswith("<table><tr><th>name</th>") and len(tables.html_chunks(rows, 1)) == 2
    wide = {"x0": 0.0, "x1": 18.0, "top": 30.0, "bottom": 38.0, "text": "all"}
    assert tables.spans([*cells, wide]) == {6: (1, 2)}
    assert tables.split_html("<table><tr>a b c</tr><tr>d</tr></table>", 2) == ["<table><tr>a b c</tr></table>", "<table><tr>d</tr></table>"]
    df = spark.createDataFrame([{"table_id": "t", **c} for c in cells])
    assert [r.line for r in tables.from_cells(df).orderBy("seq").collect()] == ["name：Ann; age：7", "name：Bob; age：8"]
    assert tables.grid([]) == [] and tables.lines([]) == []


def test_parts_and_markup(spark):
    df = spark.createDataFrame([(["a b", "c", "", "d e f g"],)], "p array<string>")
    assert df.select(chunking.merged_parts(F.col("p"), 3).alias("m")).first().m == ["a b\nc", "d e f g"]
    rest, found = markup.tables("x\n| a | b |\n|---|---|\n| 1 | 2 |\ny\n```\n| not | one |\n|---|---|\n```\n<table><tr></tr></table>")
    assert len(found) == 2 and "| not |" in rest
    assert markup.engines("q", lambda q: 1 / 0, lambda q: [], lambda q: ["r"]) == ["r"]
    blocks = spark.createDataFrame([("title", "<b>T</b>"), ("page_number", "1"), ("table", "")], "type string, text string")
    assert [tuple(r) for r in markup.normalized_blocks(blocks).collect()] == [("heading", "T")]


def copies(spark, n, first=0):
    """``n`` boxes in one place."""
    return spark.range(first, first + n).select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), "id", *[F.lit(v).alias(c) for c, v in (("x0", 10.0), ("x1", 40.0), ("top", 5.0), ("bottom", 25.0))])


def test_best_of_many_copies(spark):
    a, b = copies(spark, 60_000), copies(spark, 60_000, 60_000)
    assert layout._place_overlaps(a, b).count() == 1
    best = layout.best_overlap(a, b)
    assert best.count() == 60_000 and [tuple(r) for r in best.select("b_id", "share").distinct().collect()] == [(60_000, 1.0)]


def test_pairs_of_copies(spark):
    a = copies(spark, 40).withColumn("text", F.lit("t"))
    b = copies(spark, 30, 100).union(copies(spark, 1, 200).withColumn("x0", F.lit(25.0)))
    assert layout._place_overlaps(a, b).count() == 2
    pairs = layout.overlaps(a, b)
    assert set(pairs.columns) == {*[f"a_{c}" for c in a.columns], *[f"b_{c}" for c in b.columns], "share"}
    assert {(r.share, r["count"]) for r in pairs.groupBy("share").count().collect()} == {(1.0, 1200), (0.5, 40)}
    assert pairs.select("a_id", "b_id").distinct().count() == 1240
