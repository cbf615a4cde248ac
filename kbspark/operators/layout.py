"""Box algebra of laid-out pages: overlap joins, duplicate suppression, merges and reading order. Boxes have page, x0, x1, top, bottom."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T

_SIDES = ("x0", "x1", "top", "bottom")


def _prefixed(boxes: DataFrame, p: str) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{p}{c}") for c in boxes.columns])


_PLACE = ["doc_id", "page", "x0", "x1", "top", "bottom"]


def _place_overlaps(a: DataFrame, b: DataFrame, cell: float = 100.0) -> DataFrame:
    """Pairs of different places of boxes, as ``a_`` and ``b_`` columns, that share an area, with ``share`` (of a's area).

    Places are dealt to the grid cells that they touch, so that only places with a common cell are compared; a pair counts in the first cell of both.
    """
    def dealt(x: DataFrame, p: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(f"{p}{lo}") / cell), F.floor(F.col(f"{p}{hi}") / cell))
        return _prefixed(x.select(_PLACE).distinct(), p).withColumn(f"{p}cx", F.explode(span("x0", "x1"))).withColumn(f"{p}cy", F.explode(span("top", "bottom")))

    j = dealt(a, "a_").join(dealt(b, "b_"), (F.col("a_doc_id") == F.col("b_doc_id")) & (F.col("a_page") == F.col("b_page")) & (F.col("a_cx") == F.col("b_cx")) & (F.col("a_cy") == F.col("b_cy")))
    first = (F.floor(F.greatest("a_x0", "b_x0") / cell) == F.col("a_cx")) & (F.floor(F.greatest("a_top", "b_top") / cell) == F.col("a_cy"))
    shared = T.overlap_area("a_", "b_")
    return j.where(first & (shared > 0)).withColumn("share", F.round(shared / T.box_area("a_"), 6)).drop("a_cx", "a_cy", "b_cx", "b_cy")


def overlaps(a: DataFrame, b: DataFrame, cell: float = 100.0) -> DataFrame:
    """Pairs of boxes of one page of a document that share an area, with ``share`` (of a's area).

    Boxes that lie in the same place are compared once, and only what overlaps is spread to their pairs.
    """
    of_a = _place_overlaps(a, b, cell).join(_prefixed(a, "a_"), [f"a_{c}" for c in _PLACE])
    # few bytes that grow to many pairs: the adaptive plan would put them into one task
    of_a = of_a.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[f"b_{c}" for c in _PLACE])
    pairs = of_a.join(_prefixed(b, "b_"), [f"b_{c}" for c in _PLACE])
    return pairs.select(*[f"a_{c}" for c in a.columns], *[f"b_{c}" for c in b.columns], "share")


def best_overlap(a: DataFrame, b: DataFrame, least: float = 0.0) -> DataFrame:
    """(doc_id, a_id, b_id, share): for each box of ``a`` the box of ``b`` that covers most of it, from ``least`` on; of equal ones that with the smallest id.

    Of the boxes of ``b`` in one place only the smallest id can be the best, and boxes of ``a`` in one place have the same.
    """
    of_b = _prefixed(b.groupBy(_PLACE).agg(F.min("id").alias("id")), "b_")
    pairs = _place_overlaps(a, b).where(F.col("share") >= least).join(of_b, [f"b_{c}" for c in _PLACE])
    best = pairs.groupBy([f"a_{c}" for c in _PLACE]).agg(F.max(F.struct("share", (-F.col("b_id")).alias("o"))).alias("x"))
    return _prefixed(a, "a_").join(best, [f"a_{c}" for c in _PLACE]).select(F.col("a_doc_id").alias("doc_id"), "a_id", (-F.col("x.o")).alias("b_id"), "x.share")


def repeated_texts(boxes: DataFrame, kinds: tuple[str, ...] = ("header", "footer", "reference")) -> DataFrame:
    """Boxes without the texts of these layout kinds that occur more than once in their document."""
    often = boxes.where(F.col("layout_type").isin(*kinds)).groupBy("doc_id", "text").count().where("count > 1").select("doc_id", "text")
    return boxes.join(often, ["doc_id", "text"], "left_anti")


def global_tops(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes with the heights of all earlier pages added to top and bottom. Pages of one document are few."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    shifted = pages.withColumn("shift", F.coalesce(F.sum("height").over(w), F.lit(0.0)))
    return boxes.join(shifted.select("doc_id", "page", "shift"), ["doc_id", "page"]).withColumns({"top": F.col("top") + F.col("shift"), "bottom": F.col("bottom") + F.col("shift")}).drop("shift")


def reading_order(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("reading", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "col_id", "top", "x0", "id")))


def merged_intervals(ranges: DataFrame, group: str = "group", start: str = "start", end: str = "end") -> DataFrame:
    """(group, start, end): overlapping or touching ranges as one."""
    w = Window.partitionBy(group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    islands = marked.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(group, "__i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__i")


def _area(a, b) -> float:
    return max(0.0, min(a.x1, b.x1) - max(a.x0, b.x0)) * max(0.0, min(a.bottom, b.bottom) - max(a.top, b.top))


def suppress(boxes: DataFrame, least: float = 0.2) -> DataFrame:
    """Non-maximum suppression by page and kind: boxes by falling score, without those whose intersection over union with a kept one reaches ``least``. A page is one group."""

    def page(g: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for b in g.sort_values(["score", "id"], ascending=[False, True]).itertuples():
            size = (b.x1 - b.x0) * (b.bottom - b.top)
            if all((s := _area(b, k)) / max(size + (k.x1 - k.x0) * (k.bottom - k.top) - s, 1e-9) < least for k in kept):
                kept.append(b)
        return g.loc[[k.Index for k in kept]]

    return boxes.groupBy("doc_id", "page", "layout_type").applyInPandas(page, boxes.schema)


def sort_rows(boxes: DataFrame, threshold: float, axis: str = "y") -> DataFrame:
    """Boxes of a page by top, or by x0 where tops differ by less than the threshold (``axis`` x: the other way round). Adds ``place``."""
    main, other = ("top", "x0") if axis == "y" else ("x0", "top")

    def page(g: pd.DataFrame) -> pd.DataFrame:
        def order(a, b) -> float:
            d = getattr(a, main) - getattr(b, main)
            return getattr(a, other) - getattr(b, other) if abs(d) < threshold else d

        rows = sorted(g.sort_values("id").itertuples(), key=functools.cmp_to_key(order))
        out = g.loc[[r.Index for r in rows]].copy()
        out["place"] = range(len(out))
        return out

    from pyspark.sql.types import LongType

    return boxes.groupBy("doc_id", "page").applyInPandas(page, type(boxes.schema)(list(boxes.schema)).add("place", LongType()))


#: Boxes that are left as they are in a line; marks at a box's end (the last character, the one before it) and at the next one's
#: beginning that join the two; marks that end a paragraph, in any language and in English.
LEFT_ALONE = ("table", "figure", "equation")
JOINING_LAST, JOINING_BEFORE_LAST, JOINING_FIRST = ",;:'\"，、‘“；：-", ",;:'\"，‘“、；：", "。；？！?”）),，、："
ENDING, ENDING_ENGLISH = "。？！?", ".!?"


def _layout(boxes: DataFrame) -> str:
    """The column that tells one layout region from another: its number where there is one, else its kind."""
    return "layout_no" if "layout_no" in boxes.columns else "layout_type"


def merge_horizontal(boxes: DataFrame) -> DataFrame:
    """Neighbouring boxes of a line as one: those of one column and region whose middles differ by less than a third of the page's mean height.

    A merged box has the means of both tops and bottoms, ends where the second ends, and meets the next as itself; texts join as they are. Boxes
    of tables, figures and equations take none in.
    """
    region = _layout(boxes)

    def page(g: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        near = (g.bottom - g.top).mean() / 3
        middle = lambda b: (b["top"] + b["bottom"]) / 2
        for b in g.sort_values(["top", "x0", "id"]).to_dict("records"):
            last = rows[-1] if rows else None
            if last and last["layout_type"] not in LEFT_ALONE and (last["col_id"], last[region]) == (b["col_id"], b[region]) and abs(middle(b) - middle(last)) < near:
                last.update(x1=b["x1"], top=(last["top"] + b["top"]) / 2, bottom=(last["bottom"] + b["bottom"]) / 2, text=last["text"] + b["text"])
            else:
                rows.append(b)
        return pd.DataFrame(rows, columns=g.columns)

    return boxes.groupBy("doc_id", "page").applyInPandas(page, boxes.schema)


def greedy_labels(indices: list[int], blank: int = 0) -> list[int]:
    """Labels of a best path: repeats once, blanks dropped."""
    return [x for i, x in enumerate(indices) if x != blank and (i == 0 or indices[i - 1] != x)]


def tightest_column(boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc_id, a_id, b_id): for each box the column of the same page that overlaps it vertically and lies nearest by an edge or the middle."""
    a, b = _prefixed(boxes, "a_"), _prefixed(columns, "b_")
    meets = (F.col("a_doc_id") == F.col("b_doc_id")) & (F.col("a_page") == F.col("b_page")) & (F.least("a_bottom", "b_bottom") > F.greatest("a_top", "b_top"))
    near = a.join(b, meets).withColumn("d", T.x_distance("a_", "b_"))
    return near.groupBy(F.col("a_doc_id").alias("doc_id"), "a_id").agg(F.min(F.struct("d", "b_id")).alias("x")).select("doc_id", "a_id", "x.b_id")


def captions_to_regions(captions: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, a_id, b_id): each caption's nearest table or figure of its page, by the squared distance of the middles. A document's pages are the join key."""
    a, b = _prefixed(captions, "a_"), _prefixed(regions, "b_")
    middle = lambda p, lo, hi: (F.col(f"{p}{lo}") + F.col(f"{p}{hi}")) / 2
    d = F.pow(middle("a_", "x0", "x1") - middle("b_", "x0", "x1"), F.lit(2)) + F.pow(middle("a_", "top", "bottom") - middle("b_", "top", "bottom"), F.lit(2))
    near = a.join(b, (F.col("a_doc_id") == F.col("b_doc_id")) & (F.col("a_page") == F.col("b_page"))).withColumn("d", d)
    return near.groupBy(F.col("a_doc_id").alias("doc_id"), "a_id").agg(F.min(F.struct("d", "b_id")).alias("x")).select("doc_id", "a_id", "x.b_id")


#: Fixed value: layout kinds in the order in which they claim a box.
CLAIM_ORDER = ("footer", "header", "reference", "figure caption", "table caption", "title", "table", "text", "figure", "equation")


def tag(boxes: DataFrame, regions: DataFrame, least: float = 0.4) -> DataFrame:
    """Boxes with the kind of the region that covers at least ``least`` of them; of several kinds the first in ``CLAIM_ORDER``, of one the largest cover."""
    order = F.coalesce(*[F.when(F.col("b_layout_type") == k, F.lit(i)) for i, k in enumerate(CLAIM_ORDER)], F.lit(len(CLAIM_ORDER)))
    hits = overlaps(boxes.drop("layout_type"), regions).where(F.col("share") >= least)
    best = hits.groupBy(F.col("a_doc_id").alias("doc_id"), F.col("a_id").alias("id")).agg(F.min(F.struct(order.alias("o"), (-F.col("share")).alias("s"), F.col("b_layout_type").alias("kind"))).alias("x")).select("doc_id", "id", F.col("x.kind").alias("layout_type"))
    return boxes.drop("layout_type").join(best, ["doc_id", "id"], "left")


def word_gaps(chars: DataFrame, ratio: float = 0.25) -> DataFrame:
    """Characters of a line with a space after those whose distance to the next exceeds ``ratio`` of the line's mean width; none beside Han characters."""
    line = Window.partitionBy("doc_id", "page", "line")
    order = line.orderBy("x0", "id")
    gap = F.lead("x0").over(order) - F.col("x1")
    wide = gap > ratio * F.avg(F.col("x1") - F.col("x0")).over(line)
    han = T.contains_han(F.col("text")) | T.contains_han(F.lead("text").over(order))
    return chars.withColumn("spaced", F.when(F.coalesce(wide & ~han, F.lit(False)), F.concat("text", F.lit(" "))).otherwise(F.col("text")))


def _merge_runs(boxes: DataFrame, order: list[str], joins, merged) -> DataFrame:
    """Boxes of a page in order; each that ``joins`` the last result becomes one with it. A blank box is dropped when another comes after it."""

    def page(g: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        height = (g.bottom - g.top).mean()
        for b in g.sort_values([*order, "top", "x0", "id"]).to_dict("records"):
            if rows and not rows[-1]["text"].strip():
                rows.pop()
            if rows and joins(rows[-1], b, height):
                rows[-1].update(merged(rows[-1], b))
            else:
                rows.append(b)
        return pd.DataFrame(rows, columns=g.columns)

    return boxes.groupBy("doc_id", "page").applyInPandas(page, boxes.schema)


def _han(c: str) -> bool:
    return "一" <= c <= "鿿"


def merge_vertical(boxes: DataFrame, english: bool = False) -> DataFrame:
    """Lines of a paragraph as one box, in order of their tops over the whole page.

    The box below goes on with the one above if both are of one region, at most one and a half mean heights apart, and one over the other for three tenths of
    the narrower one. A mark that ends a paragraph parts them, unless a mark next to it or at the beginning of the lower one joins them.
    """
    region = _layout(boxes)

    def joins(a: dict, b: dict, height: float) -> bool:
        over = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])
        if a[region] != b[region] or b["top"] - a["bottom"] > 1.5 * height or over < 0.3 * max(1, min(a["x1"] - a["x0"], b["x1"] - b["x0"])):
            return False
        above, below = a["text"].strip(), b["text"].strip()
        ended = above[-1] in ENDING or english and above[-1] in ENDING_ENGLISH
        return not ended or above[-1] in JOINING_LAST or above[-2:-1] != "" and above[-2] in JOINING_BEFORE_LAST or below != "" and below[0] in JOINING_FIRST

    return _merge_runs(boxes, [], joins, lambda a, b: {"x0": min(a["x0"], b["x0"]), "x1": max(a["x1"], b["x1"]), "bottom": b["bottom"], "text": f"{a['text'].rstrip()} {b['text'].lstrip()}".strip()})


def merge_bullets(boxes: DataFrame) -> DataFrame:
    """Neighbouring boxes that begin with the same mark, a line each, as one box. Latin letters and Han characters are no marks; digits are."""

    def joins(a: dict, b: dict, height: float) -> bool:
        mark = a["text"].strip()[0]
        return b["text"].strip()[:1] == mark and not (mark.isascii() and mark.isalpha()) and not _han(mark) and a["top"] <= b["bottom"]

    return _merge_runs(boxes.where(F.trim("text") != ""), ["col_id"], joins, lambda a, b: {"x0": min(a["x0"], b["x0"]), "x1": max(a["x1"], b["x1"]), "bottom": b["bottom"], "text": f"{a['text']}\n{b['text']}"})


def columns_of_page(boxes: DataFrame, most: int = 4) -> DataFrame:
    """Boxes with ``col_id``: left edges in the number of groups, up to ``most``, that a page's silhouette favours (one-dimensional k-means)."""
    import numpy as np

    def grouped(x, k: int):
        centres = np.quantile(x, (np.arange(k) + 0.5) / k)
        for _ in range(20):
            label = np.abs(x[:, None] - centres[None]).argmin(1)
            new = np.array([x[label == j].mean() if (label == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        order = np.argsort(centres)
        return np.argsort(order)[label]

    def silhouette(x, label) -> float:
        d = np.abs(x[:, None] - x[None])
        kinds = np.unique(label)
        if len(kinds) < 2:
            return 0.0
        mean = np.stack([d[:, label == j].sum(1) / np.maximum((label == j).sum() - (label[:, None] == j)[:, 0], 1) for j in kinds], 1)
        own = mean[np.arange(len(x)), np.searchsorted(kinds, label)]
        mean[np.arange(len(x)), np.searchsorted(kinds, label)] = np.inf
        other = mean.min(1)
        return float(((other - own) / np.maximum(np.maximum(own, other), 1e-9)).mean())

    def page(g: pd.DataFrame) -> pd.DataFrame:
        x = g.x0.to_numpy(float)
        tries = [(0.5, np.zeros(len(x), int))] + [(silhouette(x, lab := grouped(x, k)), lab) for k in range(2, min(most, len(set(x.tolist()))) + 1)]
        return g.assign(col_id=max(tries, key=lambda t: t[0])[1].astype("int32"))

    return boxes.groupBy("doc_id", "page").applyInPandas(page, boxes.schema)


def distinct_headings(headings: DataFrame, group: str = "doc_id", order: str = "ord") -> DataFrame:
    """Headings in order without those whose title matches an earlier kept one's, over the whole document."""
    import re

    bare = [re.compile(p) for p, _ in T.HEADING_PATTERNS]

    def norm(title: str) -> str:
        t = (title or "").strip()
        for p in bare:
            if m := p.match(t):
                t = t[m.end() :]
                break
        return re.sub(r"\s+", "", t).lower()

    def document(g: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[str, int]] = []
        for i, title in g.sort_values(order)["title"].items():
            n = norm(title)
            if not any(n and k and (n == k or (min(n, k, key=len) in max(n, k, key=len) and min(len(n), len(k)) >= 0.6 * max(len(n), len(k)))) for k, _ in kept):
                kept.append((n, i))
        return g.loc[[i for _, i in kept]]

    return headings.groupBy(group).applyInPandas(document, headings.schema)


def level_by_height(boxes: DataFrame, group: str = "doc_id", ratio: float = 1.4) -> DataFrame:
    """Title boxes with ``level`` 0 from ``ratio`` times the document's upper median height on, else 1."""
    h = F.col("bottom") - F.col("top")
    middle = boxes.groupBy(group).agg(F.array_sort(F.collect_list(h)).alias("hs")).select(group, F.get("hs", F.floor(F.size("hs") / 2).cast("int")).alias("median"))
    return boxes.join(middle, group).withColumn("level", F.when(h >= ratio * F.col("median"), 0).otherwise(1)).drop("median")


def document_title(boxes: DataFrame, group: str = "doc_id") -> DataFrame:
    """(doc, title): the first title if it has no number, is the tallest, and at least 1.3 times the second tallest."""
    h = F.col("bottom") - F.col("top")
    listed = boxes.groupBy(group).agg(F.min_by(F.struct("text", h.alias("h")), F.struct("page", "top", "id")).alias("first"), F.sort_array(F.collect_list(h), asc=False).alias("hs"))
    unnumbered = T.heading_level(F.col("first.text")).isNull()
    tall = (F.col("first.h") >= F.get("hs", F.lit(0))) & ((F.size("hs") < 2) | (F.get("hs", F.lit(0)) >= 1.3 * F.get("hs", F.lit(1))))
    return listed.where(unnumbered & tall).select(group, F.col("first.text").alias("title"))


def front_matter(boxes: DataFrame, dots: int = 3) -> DataFrame:
    """Boxes without the pages of which more than ``dots`` boxes have dot leaders."""
    leading = boxes.where(F.col("text").rlike(r"(\.{4,}|…{2,}|·{4,})")).groupBy("doc_id", "page").count().where(F.col("count") > dots)
    return boxes.join(leading.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def without_scraps(boxes: DataFrame, width: float = 0.25) -> DataFrame:
    """Boxes that lead with a heading or bullet, or are at least ``width`` of their page's widest."""
    widest = F.max(F.col("x1") - F.col("x0")).over(Window.partitionBy("doc_id", "page"))
    kept = T.bullet_class(F.col("text")).isNotNull() | T.heading_level(F.col("text")).isNotNull() | (F.col("x1") - F.col("x0") >= width * widest)
    return boxes.withColumn("__k", kept).where("__k").drop("__k")


def garbled_fonts(chars: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, page, garbled): at least ``least`` characters, 30 % of subset fonts, under 5 % Han and over 40 % punctuation."""
    share = lambda c: F.avg(c.cast("double"))
    return chars.groupBy("doc_id", "page").agg(((F.count("*") >= least) & (share(F.col("font").rlike(r"^[A-Z]{6}\+")) >= 0.3) & (share(T.contains_han(F.col("text"))) < 0.05) & (share(F.col("text").rlike(r"^\p{Punct}$")) > 0.4)).alias("garbled"))
