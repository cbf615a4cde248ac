"""Cutting texts: line blocks, delimiter packing, sentence-bounded pieces, overlapping windows, parents and children. Folds are array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CHARS, SHORT_CHARS = 800, 150
#: Fixed value: the characters after which a long text may be cut.
SENTENCE_ENDS = "[。！？!?；;\n]"
PARENT_TOKENS, PARENT_OVERLAP, CHILD_TOKENS, CHILD_OVERLAP = 1024, 100, 256, 30


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, line) of the lines that aren't blank, trimmed, numbered from 0 before blank ones go."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("seq", "line")).select(key, "seq", F.trim("line").alias("line")).where("line <> ''")


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, seq, block): parts between blank lines, trimmed, empty ones dropped."""
    kept = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return docs.select(key, F.posexplode(kept).alias("seq", "block"))


def greedy_groups(sizes: Column, most: int, gap: int = 0) -> Column:
    """The group number of each size in order: a group closes when the next size and the gap before it would take it over ``most``."""
    start = F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["g"] >= 0) & (acc["used"] + n + gap <= most)
        g = F.when(fits, acc["g"]).otherwise(acc["g"] + 1)
        return F.struct(g.alias("g"), F.when(fits, acc["used"] + n + gap).otherwise(n).cast("long").alias("used"), F.array_append(acc["out"], g).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def packed_lines(docs: DataFrame, most: int = MOST_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, chunk_text): lines packed in order into chunks of at most ``most`` characters, newlines included; a longer line stays whole."""
    kept = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda v: F.trim(v)), lambda x: x != "")
    numbered = docs.select(key, kept.alias("l")).select(key, "l", greedy_groups(F.transform("l", lambda x: F.length(x).cast("long")), most, 1).alias("g"))
    parts = numbered.select(key, F.posexplode(F.arrays_zip("l", "g")).alias("pos", "x")).select(key, "pos", F.col("x.g").alias("chunk"), F.col("x.l").alias("line"))
    return parts.groupBy(key, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("chunk_text"))


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_long(text: Column, most: int = MOST_CHARS) -> Column:
    """Pieces of at most ``most`` characters, cut after the last sentence end of the second half of each window where there is one; trimmed, empty ones dropped."""

    def pieces(t: Column) -> Column:
        # as many steps as a text can need when each cut comes right after the half
        steps = F.sequence(F.lit(0), F.floor(F.length(t) * 2 / most).cast("int"))

        def step(acc: Column, _: Column) -> Column:
            def grown(window: Column) -> Column:
                upto = F.length(F.regexp_extract(window, f"(?s)^.*{SENTENCE_ENDS}", 0))
                cut = F.when((acc["at"] + most < F.length(t)) & (upto * 2 > most), upto).otherwise(F.length(window))
                return F.struct((acc["at"] + cut).cast("int").alias("at"), F.array_append(acc["out"], F.substring(window, F.lit(1), cut)).alias("out"))

            return F.when(acc["at"] >= F.length(t), acc).otherwise(_named(F.substring(t, acc["at"] + 1, F.lit(most)), grown))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(steps, start, step, lambda acc: acc["out"])

    whole = _named(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), pieces)
    return F.filter(F.transform(whole, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def windows(text: Column, tokens: int, overlap: int = 0) -> Column:
    """Windows of one and a half times ``tokens`` characters, each beginning ``overlap`` characters before the last one's end; none after the first that reaches the end."""
    size = int(tokens * 1.5)
    step = max(1, size - overlap)
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    count = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), count), lambda i: F.substring(t, i * step + 1, F.lit(size))))


def parents_and_children(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Parent windows (key, parent_id, parent_index, text) and child windows in each (key, parent_id, parent_index, child_index, text), both with the columns ``keep``. A parent's id is a hash of its document and number."""
    parents = docs.select(key, *keep, F.posexplode(windows(F.col(text), PARENT_TOKENS, PARENT_OVERLAP)).alias("parent_index", "text"))
    parents = parents.withColumn("parent_id", F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("parent_index").cast("string"))), 1, 12))
    children = parents.select(key, "parent_id", "parent_index", *keep, F.posexplode(windows(F.col("text"), CHILD_TOKENS, CHILD_OVERLAP)).alias("child_index", "text"))
    return parents.select(key, "parent_id", "parent_index", "text", *keep), children


def delimited(text: Column, delimiters: str = "[\n!?;。；！？]") -> Column:
    """Parts between delimiters, which are dropped with empty parts; CR LF counts as a newline."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), delimiters), lambda x: F.trim(x) != "")


def leaf_chunks(leaves: DataFrame, section: str = "section_id", order: str = "ord", text: str = "text", most: int = MOST_CHARS, short: int = SHORT_CHARS) -> DataFrame:
    """(section, seq, chunk_text): runs of short leaves of a section joined by blank lines up to ``most`` characters, and longer leaves split by themselves."""
    listed = leaves.groupBy(section).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"]).alias("l"))
    start = F.struct(F.lit("").alias("buffer"), F.lit(0).alias("used"), F.lit(False).alias("open"), F.array().cast("array<string>").alias("out"))

    def flushed(acc: Column) -> Column:
        done = F.regexp_replace(acc["buffer"], r"^\s+|\s+$", "")
        return F.when(acc["open"] & (done != ""), F.array_append(acc["out"], done)).otherwise(acc["out"])

    def step(acc: Column, t: Column) -> Column:
        n = F.length(t) + 2
        joins = acc["open"] & (acc["used"] + n <= most)
        short_leaf = F.struct(
            F.when(joins, F.concat(acc["buffer"], F.lit("\n\n"), t)).otherwise(t).alias("buffer"), F.when(joins, acc["used"] + n).otherwise(n).alias("used"), F.lit(True).alias("open"),
            F.when(joins, acc["out"]).otherwise(flushed(acc)).alias("out"),
        )
        long_leaf = F.struct(F.lit("").alias("buffer"), F.lit(0).alias("used"), F.lit(False).alias("open"), F.concat(flushed(acc), split_long(t, most)).alias("out"))
        return F.when(F.length(t) <= short, short_leaf).otherwise(long_leaf)

    return listed.select(section, F.posexplode(F.aggregate("l", start, step, flushed)).alias("seq", "chunk_text"))


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """The built-in embedder: counts of terms hashed to ``dims`` places, scaled to length one; a text without terms gives zeros."""
    from kbspark.functions.text import bm25_terms

    places = F.transform(bm25_terms(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    zero = F.array_repeat(F.lit(0.0), dims)

    def counts(p: Column) -> Column:
        # each place is there once more than it was hashed to, so that every one ends somewhere in the sorted list
        listed = F.sort_array(F.concat(p, F.sequence(F.lit(0), F.lit(dims - 1))))
        ends = _named(listed, lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i - 1) != F.get(s, i))))
        return _named(ends, lambda e: F.transform(e, lambda end, k: (end - F.when(k > 0, F.get(e, k - 1)).otherwise(0) - 1).cast("double")))

    def scaled(c: Column) -> Column:
        return _named(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)), lambda length: F.transform(c, lambda v: v / length))

    return _named(places, lambda p: F.when(F.size(p) > 0, _named(counts(p), scaled)).otherwise(zero))


def token_count(text: Column) -> Column:
    from kbspark.functions.text import layout_tokens

    t = layout_tokens(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def merged_parts(parts: Column, most: int = 128, between: str = "\n") -> Column:
    """Parts in order, joined while a group has at most ``most`` tokens; parts without tokens are dropped, and a larger one stands alone."""
    kept = F.filter(parts, lambda p: token_count(p) > 0)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        n = token_count(p)
        fits = (F.size(acc["out"]) > 0) & (acc["used"] + n <= most)
        grown = F.concat(F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat_ws(between, F.try_element_at(acc["out"], F.lit(-1)), p)))
        return F.struct(F.when(fits, acc["used"] + n).otherwise(n).alias("used"), F.when(fits, grown).otherwise(F.array_append(acc["out"], p)).alias("out"))

    return F.aggregate(kept, start, step, lambda acc: acc["out"])


#: Characters that are tokens by themselves.
_WIDE = "一-鿿぀-ヿ가-힯"


def token_chunks(text: Column, most: int = 512) -> Column:
    """The text cut into chunks of at most ``most`` tokens, which in a row are the text again.

    Tokens are runs of other characters than white space, and wide characters one by one. Pieces end after the marks at which a long text may be cut; one
    of more tokens than a chunk holds is cut by them. Each piece is counted once, and from the running sums of the counts each chunk takes as many pieces as it holds.
    """
    token = rf"\s*(?:[{_WIDE}]|[^\s{_WIDE}]+)"
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s)[^。！？!?；;\n]*[。！？!?；;\n]+|[^。！？!?；;\n]+"), F.lit(0))

    def fine(piece: Column) -> Column:
        """A piece as structs of its text and its tokens, in parts if it's too long."""

        def cut(t: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(t) / most) - 1, F.lit(0)).cast("int")), lambda i: F.struct(F.array_join(F.slice(t, i * most + 1, F.lit(most)), "").alias("t"), F.least(F.size(t) - i * most, F.lit(most)).alias("n")))
            return F.when(F.size(t) > most, parts).otherwise(F.array(F.struct(piece.alias("t"), F.size(t).alias("n"))))

        return _named(F.regexp_extract_all(piece, F.lit(token + r"(?:\s+$)?"), F.lit(0)), cut)

    def chunks(p: Column) -> Column:
        upto = F.aggregate(p, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x["n"]))

        def greedy(s: Column) -> Column:
            """Numbers of pieces after which chunks end: each time as many as have at most ``most`` tokens more."""
            total = F.element_at(s, -1)
            steps = F.sequence(F.lit(0), (F.floor(total * 2 / most) + 1).cast("int"))
            ends = F.aggregate(steps, F.array(F.lit(0)), lambda acc, _: F.when(F.element_at(acc, -1) >= F.size(p), acc).otherwise(F.array_append(acc, F.size(F.filter(s, lambda x: x <= F.element_at(s, F.element_at(acc, -1) + 1) + most)) - 1)))
            return _named(ends, lambda e: F.transform(F.sequence(F.lit(2), F.size(e)), lambda i: F.array_join(F.transform(F.slice(p, F.element_at(e, i - 1) + 1, F.element_at(e, i) - F.element_at(e, i - 1)), lambda x: x["t"]), "")))

        return F.when(F.size(p) == 0, F.array().cast("array<string>")).otherwise(_named(upto, greedy))

    return _named(F.flatten(F.transform(pieces, fine)), chunks)
