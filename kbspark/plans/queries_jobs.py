"""The jobs as queries, each of which runs its function twice into one new folder and returns what stands there then, and a stream with state over two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.plans.book import Book
from kbspark.plans.queries_index import bm25_many
from kbspark.sources.shared import new_folder

Q = Book()


def _knowledge_base(t) -> DataFrame:
    from jobs import knowledge_base

    at = new_folder(t.spark, "knowledge-base")
    for _ in range(2):
        tables = knowledge_base.run(t.spark, f"{t.folder}/documents.parquet", f"{at}/tables", f"{at}/checkpoint")
    return knowledge_base.contents(tables)


def _evidence(t) -> DataFrame:
    from jobs import evidence

    at = new_folder(t.spark, "evidence")
    for _ in range(2):
        out = evidence.run(t.spark, f"{t.folder}/benchmark.parquet", f"{t.folder}/documents.parquet", at)
    return out


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_WINDOWS = "list_transform(range(0, 1 + CAST(greatest(ceil((length({t}) - {size}) / {step}::DOUBLE), 0) AS BIGINT)), lambda i: substr({t}, i * {step} + 1, {size}))"
Q.add("job1_knowledge_base", _knowledge_base, f"""WITH p AS (SELECT doc_id, lang, generate_subscripts(l, 1) - 1 AS parent_index, unnest(l) AS x FROM (SELECT doc_id, lang, {_WINDOWS.format(t='text', size=1536, step=1436)} AS l FROM documents WHERE text <> '')),
c AS (SELECT doc_id, lang, parent_index, generate_subscripts(l, 1) - 1 AS child_index, unnest(l) AS text FROM (SELECT doc_id, lang, parent_index, {_WINDOWS.format(t='x', size=384, step=354)} AS l FROM p))
SELECT doc_id, parent_index, child_index, lang, md5(text) AS digest, len({_TOK}) AS n_terms, len(list_distinct({_TOK})) AS n_distinct, CASE WHEN len({_TOK}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM c""")

_BEST = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)"
Q.add("job2_evidence", _evidence, rf"""WITH q AS (SELECT item_id AS query_id, text, {_TOK} AS t FROM benchmark), d AS (SELECT doc_id AS key, text, {_TOK} AS t, regexp_extract_all(lower(coalesce(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], '')), '[\p{{L}}\p{{N}}]+') AS title FROM documents),
qr AS (SELECT DISTINCT query_id, unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' '))) AS run FROM q), dr AS (SELECT DISTINCT key, unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' '))) AS run FROM d),
t0 AS (SELECT query_id, key, score FROM (SELECT query_id, key, CAST(count(*) AS DOUBLE) AS score FROM qr JOIN dr USING (run) GROUP BY ALL) QUALIFY {_BEST} <= 5),
n0 AS (SELECT query_id, 5 - count(key) AS room FROM q LEFT JOIN t0 USING (query_id) GROUP BY query_id),
o1 AS (SELECT query_id, key, CAST(len(list_intersect(list_distinct(q.t), list_distinct(title))) AS DOUBLE) AS score FROM q, d WHERE len(list_intersect(list_distinct(q.t), list_distinct(title))) >= 6),
t1 AS (SELECT query_id, key, score FROM (SELECT *, {_BEST} AS rn FROM o1 ANTI JOIN t0 USING (query_id, key)) JOIN n0 USING (query_id) WHERE rn <= room),
a AS (SELECT *, 'quoting' AS tier, 0 AS i FROM t0 UNION ALL SELECT *, 'titled', 1 FROM t1), n1 AS (SELECT query_id, 5 - count(key) AS room FROM q LEFT JOIN a USING (query_id) GROUP BY query_id),
f AS (SELECT query_id, key FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i, score DESC, key) = 1),
x AS (SELECT q.query_id, concat_ws(' ', q.text, substr(d.text, 1, 600)) AS text FROM q JOIN n1 ON q.query_id = n1.query_id AND room > 0 LEFT JOIN f ON q.query_id = f.query_id LEFT JOIN d ON f.key = d.key),
b AS ({bm25_many('SELECT * FROM x', 'SELECT key, text FROM d', 10, 'query_id, key, score')}),
t2 AS (SELECT query_id, key, score FROM (SELECT *, {_BEST} AS rn FROM b ANTI JOIN a USING (query_id, key)) JOIN n1 USING (query_id) WHERE rn <= room),
u AS (SELECT * FROM a UNION ALL SELECT *, 'anchored', 2 FROM t2) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i, score DESC, key) AS INTEGER) AS rank, key AS doc_id, score, tier FROM u""")


def _messages(t) -> DataFrame:
    """Every turn with a citation in its middle, and a call at the end of the assistant's, cut into pieces of 40 characters that come in two files; the stream ends and starts anew between them."""
    from kbspark.streaming import messages

    at = new_folder(t.spark, "messages")
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.expr("substr(text, 1, cast(length(text) div 2 as int))"), F.lit("["), F.col("turn").cast("string"), F.lit("]"), F.substring("text", half + 1, F.length("text")), F.when(F.col("role") == "assistant", F.lit("<DSML call>hidden")).otherwise(""))
    whole = t.conversations.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), text.alias("text"))
    pieces = whole.select("message_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / 40).cast("int")), lambda i: F.substring("text", i * 40 + 1, F.lit(40)))).alias("seq", "piece"))
    last = whole.select("message_id", (F.ceil(F.length("text") / 40) + 1).cast("int").alias("seq"), F.lit(None).cast("string").alias("piece"))
    rows = pieces.union(last).select("message_id", F.col("seq").cast("long").alias("seq"), F.when(F.col("piece").isNull(), "end").otherwise("token").alias("kind"), "piece")
    for part in (rows.where("seq < 5"), rows.where("seq >= 5")):
        part.write.mode("append").parquet(f"{at}/pieces")
        messages.collect_files(t.spark, f"{at}/pieces", f"{at}/shown", f"{at}/checkpoint", 3).awaitTermination()
    shown = t.spark.read.schema(messages.SHOWN).parquet(f"{at}/shown")
    return shown.groupBy("message_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "shown"))), lambda x: x["shown"]), "")).alias("digest"))


Q.add("message_stream", _messages, r"""WITH m AS (SELECT conv_id || ':' || turn AS message_id, substr(text, 1, length(text) // 2) || '[' || turn || ']' || substr(text, length(text) // 2 + 1) AS text FROM conversations)
SELECT message_id, md5(regexp_replace(text, '\[(0|[4-9]|[0-9]{2,})\]', '', 'g')) AS digest FROM m WHERE regexp_replace(text, '\[(0|[4-9]|[0-9]{2,})\]', '', 'g') <> ''""")
