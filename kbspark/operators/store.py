"""Tables as values: inserts, renames and deletes give new DataFrames; listings, counts and pages read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREVIEW, CHILD_PREVIEW = 100, 120
#: Kinds and texts of failures.
NEVER_AGAIN = "ValueError|FileNotFoundError|402|balance|insufficient|400|invalid parameter"
AGAIN = "ConnectionError|TimeoutError|429|500|502|503|504|timeout|timed out|connection|refused"
RUNNING = ("PENDING", "PARSING", "CHUNKING", "EMBEDDING", "INDEXING")
TERMINAL = ("DONE", "FAILED")


def insert_children(children: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows that can be stored: those with a vector."""
    return children.where(F.col(vector).isNotNull() & (F.size(vector) > 0))


def insert_parents(parents: DataFrame, children: DataFrame, key: str = "parent_id") -> DataFrame:
    """Parents with their number of stored children; none at all if no child is stored."""
    counts = children.groupBy(key).agg(F.count("*").alias("child_count"))
    some = children.select(F.lit(1).alias("some")).limit(1)
    return parents.join(F.broadcast(some)).drop("some").join(counts, key, "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))


def stored_path(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: x.cast("string")), "/")


def overwrite_partition(table: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table with all rows of the new rows' keys replaced."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_by(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def delete_source(tables: dict[str, DataFrame], sources: DataFrame, key: str = "source") -> dict[str, DataFrame]:
    """Every table that has the key without those sources' rows."""
    return {name: delete_by(t, sources, key) if key in t.columns else t for name, t in tables.items()}


def rename_source(table: DataFrame, old: str, new: str, column: str = "source") -> DataFrame:
    """No change when either name is empty or both are equal."""
    if not old or not new or old == new:
        return table
    return table.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def update_where(table: DataFrame, condition: Column, **values) -> DataFrame:
    return table.withColumns({k: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def migrate(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The table with the missing columns added, as nulls of the given types."""
    return table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in table.columns})


def truncate(table: DataFrame) -> DataFrame:
    return table.where("false")


def parents_listing(parents: DataFrame, children: DataFrame, key: str = "parent_id", text: str = "text") -> DataFrame:
    counts = children.groupBy(key).agg(F.count("*").alias("children"))
    return parents.join(counts, key, "left").select(key, F.substring(text, 1, PREVIEW).alias("preview"), F.coalesce("children", F.lit(0)).alias("children"))


def page(table: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return table.orderBy(*order).offset(offset).limit(limit)


def count_by(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n"))


def documents_with_counts(documents: DataFrame, nodes: DataFrame, key: str = "doc_id", node: str = "node_id") -> DataFrame:
    return documents.join(nodes.groupBy(key).agg(F.count(node).alias("node_count")), key, "left").withColumn("node_count", F.coalesce("node_count", F.lit(0)))


def latest(log: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The newest row of each key in an event log, by one aggregation."""
    return log.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("x")).select(key, "x.*")


def is_running(tasks: DataFrame, source: str) -> bool:
    return bool(tasks.where((F.col("source") == source) & F.col("status").isin(*RUNNING)).limit(1).count())


def interrupt(tasks: DataFrame, reason: str) -> DataFrame:
    return update_where(tasks, F.col("status").isin(*RUNNING), status="FAILED", error=reason)


def retryable(error: Column) -> Column:
    """Whether a failure may be tried again, by its kind and text: wrong input and payment not, connection and load problems yes."""
    e = F.coalesce(error, F.lit(""))
    return F.when(e.rlike(NEVER_AGAIN), False).otherwise(e.rlike(AGAIN))


def backoff(attempt: Column) -> Column:
    """5, 10 and 20 seconds before tries one to three; null afterwards."""
    return F.when(attempt < 3, F.lit(5) * F.pow(F.lit(2), attempt)).cast("long")


def conversations_listing(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    return messages.groupBy(key).agg(F.count("*").alias("message_count"), F.max(order).alias("last_turn"))


def history(messages: DataFrame, key: str = "conv_id", order: str = "turn", last: int = 6) -> DataFrame:
    """(conversation, brief): the last messages, one line each with its role and 200 characters at most; blank ones are left out."""
    from kbspark.functions.text import brief

    w = Window.partitionBy(key).orderBy(F.desc(order))
    recent = messages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    line = F.concat(F.when(F.col("role") == "user", "用户").otherwise("助手"), F.lit(": "), brief(F.col("text")))
    kept = recent.where(F.trim("text") != "").select(key, order, line.alias("line"))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("brief"))


def newest(table: DataFrame, key: str, order: str, most: int = 32) -> DataFrame:
    """Of rows with the same key the newest, and of these the newest ``most``."""
    return table.groupBy(key).agg(F.max(order).alias(order)).orderBy(F.desc(order), key).limit(most)


# --- lookups -------------------------------------------------------------------------------------------------------------------------

TREE_PREFIX = "tree:"
#: Fixed value: the title of a conversation that has none of its own.
DEFAULT_TITLE = "新对话"


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key: a filter that reaches the scan."""
    return table.where(F.col(key) == F.lit(value))


def root_of(nodes: DataFrame, group: str = "doc_id", key: str = "node_id", parent: str = "parent_id", kind: str = "type", order: str = "ord") -> DataFrame:
    """(doc_id, root): the first node of type document, else the first without a parent."""
    marked = F.min_by(F.when(F.col(kind) == "document", F.col(key)), F.when(F.col(kind) == "document", F.col(order)))
    loose = F.coalesce(F.col(parent), F.lit("")) == ""
    return nodes.groupBy(group).agg(F.coalesce(marked, F.min_by(F.when(loose, F.col(key)), F.when(loose, F.col(order)))).alias("root"))


def counts(parents: DataFrame, children: DataFrame, flat: bool = False) -> DataFrame:
    """One row: the children and the parents; a flat store has no parents."""
    return children.agg(F.count("*").alias("count")).join(parents.agg((F.lit(0).cast("long") if flat else F.count("*")).alias("parent_count")))


def children_of(children: DataFrame, parent: str, key: str = "parent_id", document: str = "doc_id", text: str = "text", order: str = "id") -> DataFrame:
    """(id, preview) of a parent's children, or of a document's chunks where the name begins with ``tree:``."""
    wanted = lookup(children, document, parent.removeprefix(TREE_PREFIX)) if parent.startswith(TREE_PREFIX) else lookup(children, key, parent)
    return wanted.select(order, F.substring(text, 1, CHILD_PREVIEW).alias("preview")).orderBy(order)


def delete_parent(tables: dict[str, DataFrame], parent: str, key: str = "parent_id", document: str = "doc_id") -> dict[str, DataFrame]:
    """The tables without a parent and its children, or without a whole document where the name begins with ``tree:``."""
    column, value = (document, parent.removeprefix(TREE_PREFIX)) if parent.startswith(TREE_PREFIX) else (key, parent)
    return {name: t.where(F.coalesce(F.col(column) != F.lit(value), F.lit(True))) if column in t.columns else t for name, t in tables.items()}


def title_of(conversations: DataFrame, key: str = "conv_id", title: str = "title") -> DataFrame:
    return conversations.select(key, F.coalesce(title, F.lit("")).alias("title"))


def titled(conversations: DataFrame, question: Column, most: int = 20, title: str = "title") -> DataFrame:
    """A conversation still under the default title takes the beginning of its question."""
    return conversations.withColumn(title, F.when(F.col(title) == DEFAULT_TITLE, F.substring(F.trim(question), 1, most)).otherwise(F.col(title)))


def exchange(messages: DataFrame, conversation: int, question: str, answer: str, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The messages with a question and its answer appended to a conversation."""
    last = messages.where(F.col(key) == conversation).agg(F.coalesce(F.max(order) + 1, F.lit(0)).alias("next"))  # one row
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("role"), F.lit(t).alias("text")) for i, (r, t) in enumerate((("user", question), ("assistant", answer)))])
    new = last.select("next", F.explode(rows).alias("m")).select(F.lit(conversation).cast("long").alias(key), (F.col("next") + F.col("m.i")).alias(order), "m.role", "m.text")
    return messages.select(key, order, "role", "text").unionByName(new)


def result_rows(hits: DataFrame, source: Column | None = None) -> DataFrame:
    """(id, text, score, source) of hits for callers outside: texts trimmed, scores to four decimals."""
    return hits.select("id", F.trim("text").alias("text"), F.round("score", 4).alias("score"), F.coalesce(source if source is not None else F.col("source"), F.lit("")).alias("source"))


def evidence_rows(hits: DataFrame, round_: int, origin: str) -> DataFrame:
    """Hits as evidence of a round: id, text, score, origin and round; hits without an id are left out."""
    return hits.where(F.coalesce("id", F.lit("")) != "").select("id", F.trim("text").alias("text"), F.col("score").cast("double").alias("score"), F.lit(origin).alias("origin"), F.lit(round_).cast("long").alias("round"))


def docs_brief(hits: DataFrame, limit: int = 3, chars: int = 160) -> DataFrame:
    """One row: the first hits (by rank), a line each with the score and the beginning of the text."""
    line = F.concat(F.lit("- ["), F.format_string("%.2f", "score"), F.lit("] "), F.substring(F.regexp_replace("text", r"\s+", " "), 1, chars))
    return hits.where(F.col("rank") <= limit).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("brief"))


def distinct_titles(nodes: DataFrame, ancestors: DataFrame, wanted: list[str], key: str = "node_id", title: str = "title", group: str = "doc_id") -> DataFrame:
    """(doc_id, titles): of the wanted nodes the first of each document, with the titles above it from the root down, each once. ``wanted`` is a short list in order."""
    place = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col(key))
    first = nodes.where(F.col(key).isin(*wanted)).groupBy(group).agg(F.min_by(key, place).alias("node"))
    above = first.join(ancestors, "node").join(nodes.select(F.col(key).alias("ancestor"), F.col(title).alias("t")), "ancestor").where("t <> ''")
    return above.groupBy(group).agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("o"), "t"))), lambda x: x["t"])), " > ").alias("titles"))


def readable_sources(evidence: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, source): an evidence's document and section title; ``tree:`` ids name their node, the others have a node_id of their own."""
    node = F.when(F.col("id").startswith(TREE_PREFIX), F.substring_index("id", TREE_PREFIX, -1)).otherwise(F.col("node_id"))
    found = evidence.withColumn("__node", node).join(nodes.select(F.col("node_id").alias("__node"), F.col("title").alias("section"), F.col("doc_id").alias("__doc")), "__node", "left")
    found = found.join(documents.select(F.col("doc_id").alias("__doc"), F.col("title").alias("document")), "__doc", "left")
    return found.select("id", F.concat_ws(" / ", "document", "section").alias("source"))


def calibrated(outline: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, ord, title, page, top): outline headings with the place of the first title box that matches; a box serves its first heading only."""
    from kbspark.functions.text import titles_match

    o, b = outline.alias("o"), boxes.alias("b")
    pairs = o.join(b, (F.col("o.doc_id") == F.col("b.doc_id")) & titles_match(F.col("o.title"), F.col("b.text"))).select(F.col("o.doc_id").alias("doc_id"), F.col("o.ord").alias("ord"), F.col("b.id").alias("id"), F.col("b.page").alias("page"), F.col("b.top").alias("top"))
    served = pairs.groupBy("doc_id", "id").agg(F.min(F.struct("ord", "page", "top")).alias("x")).select("doc_id", "id", "x.*")
    place = served.groupBy("doc_id", "ord").agg(F.min(F.struct("id", "page", "top")).alias("x")).select("doc_id", "ord", "x.page", "x.top")
    return outline.join(place, ["doc_id", "ord"], "left").select("doc_id", "ord", "title", "page", "top")
