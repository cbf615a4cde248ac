"""Rules whose cases the tables don't hold: Han text, headings, questions, packing and clean-up."""

import pytest
from pyspark.sql import functions as F

from kbspark.functions import parse
from kbspark.functions import text as T
from kbspark.operators import chunking


def one(spark, expression, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return df.select(expression(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "token"), [("personas", "persona"), ("class", "class"), ("personalities", "personality"), ("Scenarios", "application"), ("applications", "application"), ("series", "sery"), ("tailoring", "personalized")])
def test_tokens_are_normalised(spark, word, token):
    assert one(spark, T.normalize_token, word) == token


@pytest.mark.parametrize(("text", "tokens"), [("系统架构设计", {"系统", "统架", "架构", "构设", "设计"}), ("GPT-4 Scenarios", {"gpt", "4", "application"}), ("我", {"我"}), ("", set())])
def test_token_sets(spark, text, tokens):
    assert set(one(spark, T.search_tokens, text)) == tokens


@pytest.mark.parametrize(("title", "level"), [("第一章 x", 0), ("第二节 y", 1), ("1.2.3 x", 2), ("1.2 x", 1), ("1. x", 0), ("A.1 x", 1), ("A. x", 0), ("2024 report", None), ("", None)])
def test_heading_levels(spark, title, level):
    assert one(spark, T.heading_level, title) == level


def test_titles_match(spark):
    assert one(spark, T.titles_match, "1.1 Background", "background")
    assert not one(spark, T.titles_match, "Background", "Background and scope")
    assert not one(spark, T.titles_match, "", "")


@pytest.mark.parametrize(("q", "rule"), [("A和B的区别", "COMPLEX"), ("苹果和香蕉以及梨", "MEDIUM"), ("what is X", ""), ("为什么？怎么做？", "COMPLEX")])
def test_complexity(spark, q, rule):
    assert one(spark, T.complexity_rule, q) == rule


@pytest.mark.parametrize(("q", "parts"), [("A、B、C 的 X 的区别", ["A 的 X", "B 的 X", "C 的 X"]), ("甲和乙的区别", ["甲", "乙"]), ("what is X", ["what is X"]), ("苹果与梨的价格有什么不同", ["苹果 的 价格", "梨 的 价格"]), ("A、B的价格和区别", ["A 的 价格", "B 的 价格"]), ("A和B的X分别是什么", ["A 的 X是什么", "B 的 X是什么"]), ("甲的区别", ["甲的区别"]), ("", [""])])
def test_comparisons_split(spark, q, parts):
    assert one(spark, T.split_comparison, q) == parts


def test_questions(spark):
    assert one(spark, T.clean_web_query, "纸上的魔法使 紙の上の魔法使い 是什么") == "纸上的魔法使"
    assert one(spark, T.clean_web_query, "君の名は") == "君の名は"
    assert one(spark, T.fallback_query, "《三体》是什么") == "三体"
    assert one(spark, T.question_type, "第三章讲了什么") == "section"
    assert one(spark, T.question_type, "这本书的目录") == "toc"
    assert one(spark, lambda q: T.retrieval_route(q, F.lit("")), "第三章") == "tree"
    assert one(spark, T.mode_to_tool, " Vector ") == "vector"


def test_clean_up(spark):
    assert one(spark, lambda a: T.keep_citations(a, F.lit(2)), "x[1][7] y[3]") == "x[1] y"
    assert one(spark, T.strip_code_fence, '```json\n{"a":1}\n```') == '{"a":1}'
    assert one(spark, T.document_card, '{"abstract":"X","keywords":["a","b"]}') == "X；关键词：a、b"
    assert one(spark, T.document_card, "plain") == "plain"
    assert one(spark, T.strip_call_marks, "a<｜DSML｜x>b</｜DSML｜x>c<|DSML|y>") == "ac"
    assert one(spark, T.is_garbled, "(cid:12)(cid:3)")
    assert one(spark, T.seq_of_result, "doc:c12") == 12 and one(spark, T.seq_of_result, "parent:x") == -1
    assert one(spark, T.block_type, "2024年3月") == "Dt" and one(spark, T.block_type, "12.5%") == "Nu"
    assert one(spark, T.degree_name, "2") == "硕士" and one(spark, T.degree_id, "mba") == "6"
    assert one(spark, T.bullet_class, "第一章 总则") == 1 and one(spark, T.bullet_class, "1.2.3") == -1


def test_null_texts(spark):
    df = spark.createDataFrame([(None,)], "c string")
    row = df.select(F.size(T.search_tokens(F.col("c"))).alias("a"), T.heading_level(F.col("c")).alias("b"), T.normalize_title(F.col("c")).alias("c"), T.complexity(F.col("c")).alias("d"), T.block_type(F.col("c")).alias("e"), T.bullet_class(F.col("c")).alias("f")).first()
    assert tuple(row) == (0, None, "", "SIMPLE", "Ot", None)


def test_chunking_folds(spark):
    assert [len(x) for x in one(spark, chunking.split_long, "a" * 500 + ";" + "a" * 399)] == [501, 399]
    assert one(spark, chunking.split_long, "   ") == []
    windows = one(spark, lambda t: chunking.windows(t, 256, 30), "x" * 1000)
    assert [len(w) for w in windows] == [384, 384, 292]
    leaves = spark.createDataFrame([("s", i, "y" * 100) for i in range(8)], "section_id string, ord int, text string")
    assert sorted(len(r.chunk_text) for r in chunking.leaf_chunks(leaves).collect()) == [100, 712]
    mixed = spark.createDataFrame([("s", i, "y" * n) for i, n in enumerate((100, 100, 200, 850))], "section_id string, ord int, text string")
    assert [len(r.chunk_text) for r in chunking.leaf_chunks(mixed).orderBy("seq").collect()] == [202, 200, 800, 50]


def test_parsers():
    assert parse.extract_json('note {"a":"}"} tail') == '{"a":"}"}'
    assert parse.extract_json("none") is None and parse.extract_json(None) is None
    assert parse.parse_json('x [1] {"a": 1}') is None
    text, calls = parse.tool_calls('hi <DSML invoke name="f"><DSML parameter name="n" string="false">3</DSML parameter></DSML invoke>')
    assert text == "hi" and calls == [{"id": "call_0", "name": "f", "arguments": '{"n": 3}'}]
    assert parse.pi_digits(20) == "3.14159265358979323846"
    assert parse.calculate("2*(3+4)^2/7") == '{"result": "14"}'
    assert "error" in parse.calculate("x+1") and "error" in parse.calculate("1/0")
