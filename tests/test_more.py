"""Smaller pieces: more formats, boxes, identifiers, dictionaries and listings."""

from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import agent, models, navigate, resume, store
from kbspark.sources import files
from tests.test_sources import zipped

A = 'xmlns:a="urn:a"'


def test_slides_and_books():
    shape = lambda y, t: f'<sp {A}><a:off x="1" y="{y}"/><a:p><a:t>{t}</a:t></a:p></sp>'
    deck = zipped(**{"ppt__slides__slide2.xml": f"<s>{shape(1, 'two')}</s>", "ppt__slides__slide1.xml": f"<s>{shape(500, 'low')}{shape(10, 'high')}</s>"})
    assert files.pptx_text(deck) == "high\nlow\n\ntwo"
    book = zipped(**{"b.opf": "<p><item id='x' href='z.xhtml'/><item id='y' href='a.xhtml'/><itemref idref='x'/><itemref idref='y'/></p>", "a.xhtml": "<p>last</p>", "z.xhtml": "<h1>first</h1>"})
    assert files.epub_text(book) == "first\n\nlast"
    assert files.odt_text(zipped(**{"content.xml": "<o><h>T</h><p>x<b>y</b></p></o>"})) == "T\n\nxy"
    assert files.eml_text(b"Subject: s\n\nbody\n").split() == ["s", "body"]
    try:
        files.reader_of("png")
        raise AssertionError
    except files.MissingReader:
        pass


def test_columns(spark):
    df = spark.createDataFrame([("Figure 3 shows", "1, 2 ,,3", "<b>x</b>", "NaN?")], "t string, ids string, h string, i string")
    row = df.select(T.is_caption(F.col("t"), F.lit("")).alias("a"), T.id_list(F.col("ids")).alias("b"), F.trim(T.strip_tags(F.col("h"))).alias("c"), T.importance(F.col("i")).alias("d"), T.box_id(F.lit(1), F.lit(1.5), F.lit(2), F.lit(3), F.lit(4)).alias("e"), files.is_structured(F.lit("PDF")).alias("f")).first()
    assert tuple(row) == (True, ["1", "2", "3"], "x", 1.0, "1:1.50:2.00:3.00:4.00", True)
    turned = df.select(T.rotated_point(F.lit(1.0), F.lit(2.0), F.lit(90), F.lit(10.0), F.lit(20.0)).alias("p"), T.rotated_point(F.lit(1.0), F.lit(2.0), F.lit(180), F.lit(10.0), F.lit(20.0)).alias("q")).first()
    assert tuple(turned.p) == (2.0, 19.0) and tuple(turned.q) == (9.0, 18.0)


def test_regions_and_listings(spark):
    names = spark.createDataFrame([("北京",), ("上海市",), ("x",)], "name string")
    regions = spark.createDataFrame([("北京市",), ("上海市",)], "region string")
    assert {r.name: r.is_region for r in resume.is_region(names, regions).collect()} == {"北京": True, "上海市": True, "x": False}
    tree = spark.createDataFrame([(1, None, "a"), (2, 1, "b")], "id int, parent_id int, name string")
    assert {r.id: r.names for r in resume.ancestors(tree, tree.select("id")).collect()} == {1: ["a"], 2: ["b", "a"]}
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, source string")
    assert store.truncate(t).count() == 0 and store.delete_source({"t": t, "u": t.drop("source")}, t.where("id = 1"))["t"].count() == 1
    ev = spark.createDataFrame([("x", 0.1, True), ("y", 0.2, False), ("z", 0.9, False)], "id string, score double, is_neighbor boolean")
    assert [r.id for r in agent.evidence_order(ev).collect()] == ["z", "y", "x"]
    hits = spark.createDataFrame([(1, "t" * 700)], "rank int, text string")
    assert len(navigate.anchor_query(hits, "q")) == 602


def test_models_and_messages():
    m = models.Models(summarize=lambda title, text: 1 / 0)
    assert m.safe("summarize", "t", "short text here") == "short text here"
    rows = models.messages("sys", [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}])
    assert models.without_system(rows) == [{"role": "user", "content": "sys\n\na"}, {"role": "assistant", "content": "b"}]
    assert models.first_sentences("A b. " * 100).endswith(".") and models.first_sentences("") == ""


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    import shutil

    from kbspark.operators import ingest

    docs = spark.createDataFrame([(1, "# A\n\nred apples\n\n# B\n\nblue sky"), (2, "red plums"), (3, None)], "doc_id long, text string")
    out = str(tmp_path / "kb")
    assert ingest.resume_point(spark, out) == "parse"
    made = ingest.run(spark, docs, out)
    assert ingest.resume_point(spark, out) is None
    best = ingest.bm25_indexed(made["index"], made["totals"], "red apples").collect()
    assert [r.chunk_id for r in best] == ["1:chunk:0", "2:chunk:0"] and made["embed"].count() == 3
    shutil.rmtree(f"{out}/embed")
    assert ingest.resume_point(spark, out) == "embed"
    ingest.run(spark, docs.where("false"), out)  # whole steps are read, the lost one is made from them
    assert spark.read.parquet(f"{out}/embed").count() == 3 and spark.read.parquet(f"{out}/parse").count() == made["parse"].count()


def test_postings_cut_a_text_once_and_let_filters_on_terms_pass(spark):
    from kbspark.operators import ingest

    docs = spark.createDataFrame([(1, "red red apples"), (2, None), (3, "Red sky")], "doc_id long, text string")
    asked = ingest.postings(docs, "doc_id").where("term = 'red'")
    assert sorted(map(tuple, asked.collect())) == [("red", 1, 2, 3), ("red", 3, 1, 2)]
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    grouping, exploding = plan.index("Aggregate"), plan.index("Generate")
    assert grouping < plan.index("Filter") < exploding < plan.index("regexp_extract_all") and plan.count("regexp_extract_all") == 1


def test_ingest_takes_new_and_changed_documents(spark, tmp_path):
    from kbspark.operators import ingest

    out = f"file://{tmp_path}/kb"
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    texts = lambda made: sorted((r.doc_id, r.text) for r in made["chunk"].collect())
    one, two, other = (1, "red apples"), (2, "blue sky"), (2, "grey sky")
    assert texts(ingest.run(spark, docs(one), out)) == [("1", "red apples")]
    assert texts(ingest.run(spark, docs(one, two), out)) == [("1", "red apples"), ("2", "blue sky")]
    made = ingest.run(spark, docs(one, other), out)
    assert texts(made) == [("1", "red apples"), ("2", "grey sky")]
    assert [r.chunk_id for r in ingest.bm25_indexed(made["index"], made["totals"], "blue grey").collect()] == ["2:chunk:0"]
    batches = spark.read.parquet(f"{out}/ledger").select("batch").distinct().count()
    ingest.run(spark, docs(one, other), out)
    assert spark.read.parquet(f"{out}/ledger").select("batch").distinct().count() == batches == 3
    assert texts(ingest.run(spark, docs(one), out, withdrawn=docs(other))) == [("1", "red apples")]
    fresh = ingest.run(spark, docs(one), f"{out}-fresh")
    assert sorted(map(repr, fresh["parse"].collect())) == sorted(map(repr, ingest.run(spark, docs(one), out)["parse"].collect()))


def test_message_state_ends(spark, tmp_path):
    import pandas as pd

    from kbspark.streaming import flows

    pd.DataFrame({"message_id": ["m", "m", "m"], "token": ["a <", None, "b"]}).to_parquet(tmp_path / "a.parquet")
    s = spark.readStream.schema("message_id string, token string").parquet(str(tmp_path))
    q = flows.filter_tokens(s).writeStream.format("memory").queryName("ended").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select array_join(collect_list(shown), '') s from ended").first().s == "a <b"
