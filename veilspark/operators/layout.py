"""Positioned words: offsets, runs, masks, rotation and tables.

words: doc_id, page, word_no, text, line, x0, y0, x1, y1, and for recognised
words is_ocr, confidence and orientation. Everything is keyed by (doc_id, page),
so all windows and joins are hash-partitioned by document and page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped

DOC = "doc_id"


def with_offsets(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Words with their start and end in the document's text.

    Words of a line are joined by a space, others by a line break; a page ends
    with a line break. Pages without words count if `pages` (doc_id, page) lists them.
    """
    order = Window.partitionBy(DOC).orderBy("page", "word_no")
    earlier = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if pages is None:
        # Every page has words: in place where words are dealt by document, without a join.
        out = words.where(F.col(DOC).isNotNull() & F.col("page").isNotNull()).withColumn("_before", earlier + F.row_number().over(order) - 1)
        start = F.col("_before") + F.dense_rank().over(Window.partitionBy(DOC).orderBy("page")) - 1
    else:
        listed = pages.select(DOC, "page").distinct()
        listed = listed.withColumn("_before", F.row_number().over(Window.partitionBy(DOC).orderBy("page")) - 1)
        out = words.join(listed, [DOC, "page"])
        first = F.first("_before").over(order)
        start = earlier + F.row_number().over(order) - 1 + F.when(first > 0, 1).otherwise(0) + F.col("_before")
    out = out.withColumn("start", start.cast("int"))
    return out.withColumn("end", (F.col("start") + F.length("text")).cast("int")).drop("_before")


def rebuilt(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) of words with offsets."""
    page = Window.partitionBy(DOC, "page").orderBy("word_no")
    new_line = F.lag("line").over(page).isNull() | ~F.lag("line").over(page).eqNullSafe(F.col("line"))
    each = words.withColumn("_sep", F.when(new_line, "\n").otherwise(" "))
    each = each.groupBy(DOC, "page").agg(F.array_sort(F.collect_list(F.struct("word_no", "start", "_sep", "text"))).alias("w"))
    if pages is not None:
        each = pages.select(DOC, "page").distinct().join(each, [DOC, "page"], "left")
    body = F.concat(F.array_join(F.transform(F.coalesce("w", F.array()), lambda x: F.concat(F.when(x["start"] > 0, x["_sep"]).otherwise(""), x["text"])), ""), F.lit("\n"))
    each = each.select(DOC, F.struct("page", body.alias("body")).alias("p"))
    return each.groupBy(DOC).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["body"]), "").alias("text"))


def valid_words(words: DataFrame, pages: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Words with `valid`: boxes are finite and on their page, and offsets reproduce the text."""
    out, ok = words, F.lit(True)
    # Joins by document alone, so that words dealt by document stay in place.
    if texts is not None:
        # In UTF-32 the place of a code point is arithmetic, so a long text costs no more a word than a short one.
        out = out.join(texts.select(DOC, F.encode("text", "UTF-32").alias("_t")), DOC, "left")
        same = F.substr("_t", F.col("start") * 4 + 1, (F.col("end") - F.col("start")) * 4) == F.encode("text", "UTF-32")
        out = out.withColumn("_same", (F.col("start") >= 0) & (F.col("start") < F.col("end")) & same).drop("_t")
        ok = F.col("_same")
    sizes = pages.where(F.col("page").isNotNull()).groupBy(DOC, "page").agg(F.collect_list(F.struct("width", "height")).alias("s"))
    sizes = sizes.groupBy(DOC).agg(F.map_from_entries(F.collect_list(F.struct("page", "s"))).alias("_p"))
    out = out.join(sizes, DOC, "left").withColumn("_p", F.explode_outer(F.try_element_at("_p", F.col("page"))))
    out = out.select("*", F.col("_p.width").alias("_w"), F.col("_p.height").alias("_h")).drop("_p")
    finite = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    inside = (F.col("x0") >= 0) & (F.col("x0") < F.col("x1")) & (F.col("x1") <= F.ceil("_w") + 1) & (F.col("y0") >= 0) & (F.col("y0") < F.col("y1")) & (F.col("y1") <= F.ceil("_h") + 1)
    return out.withColumn("valid", F.coalesce(finite & inside & ok, F.lit(False))).drop("_w", "_h", "_same")


def runs(words: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Recognised words with `run`: neighbours on a line and column. Native words separate runs and are left out.

    A run breaks where boxes overlap by less than half the smaller height, x goes
    back, the gap is wide, the text between is not blank (given texts), or the
    orientation changes. Boxes of a rotated frame (m_x0 .. m_y1) go first if there.
    """
    order = Window.partitionBy(DOC, "page").orderBy("start")
    box = {c: F.coalesce(F.col(f"m_{c}"), F.col(c)) if f"m_{c}" in words.columns else F.col(c) for c in ("x0", "y0", "x1", "y1")}
    was = {c: F.lag(b).over(order) for c, b in box.items()}
    turn = F.coalesce(F.col("orientation"), F.lit(0)) if "orientation" in words.columns else F.lit(0)
    if texts is not None:
        # Places first, so that texts pass through the join alone and not through sorts of words.
        words = words.withColumn("_at", F.lag("end").over(order)).join(texts.select(DOC, F.col("text").alias("_t")), DOC)
        blank = stripped(F.substr("_t", F.col("_at") + 1, F.col("start") - F.col("_at"))) == ""
        words = words.withColumn("_gap", F.coalesce(~blank, F.lit(False))).drop("_t", "_at")
        gap_text = F.col("_gap")
    else:
        gap_text = F.lit(False)
    overlap = F.least(was["y1"], box["y1"]) - F.greatest(was["y0"], box["y0"])
    height = F.greatest(F.lit(1.0), F.least(was["y1"] - was["y0"], box["y1"] - box["y0"]))
    breaks = (
        F.lag("start").over(order).isNull()
        | ~F.lag("is_ocr").over(order)
        | ~F.col("is_ocr")
        | (overlap < height * 0.5)
        | (box["x0"] < was["x0"])
        | (box["x0"] - was["x1"] > F.greatest(F.lit(20.0), height * 2))
        | gap_text
        | (turn != F.lag(turn).over(order))
    )
    out = words.withColumn("_break", F.coalesce(breaks, F.lit(True)).cast("int"))
    out = out.withColumn("run", F.sum("_break").over(order).cast("int"))
    return out.where("is_ocr").drop("_break", "_gap")


def regions(words: DataFrame, matches: DataFrame, scale: float, width: int, height: int) -> DataFrame:
    """(doc_id, page, word_no, rx0, ry0, rx1, ry1): pixel masks of the words that overlap a match (doc_id, start, end), clamped, empty ones left out."""
    spans = matches.select(F.col(DOC).alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = words.join(spans, (F.col(DOC) == F.col("_d")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_semi")
    low = lambda c: F.greatest(F.lit(0), F.floor(F.col(c) * scale).cast("int") - 2)
    high = lambda c, most: F.least(F.lit(most), F.ceil(F.col(c) * scale).cast("int") + 2)
    out = hit.select(DOC, "page", "word_no", low("x0").alias("rx0"), low("y0").alias("ry0"), high("x1", width).alias("rx1"), high("y1", height).alias("ry1"))
    return out.where("rx0 < rx1 and ry0 < ry1")


def merged_regions(automatic: DataFrame, manual: DataFrame) -> DataFrame:
    """(doc_id, page, rects, n): automatic and manual masks of each page, in order."""
    both = automatic.select(DOC, "page", F.lit(0).alias("o"), "rx0", "ry0", "rx1", "ry1").unionByName(manual.select(DOC, "page", F.lit(1).alias("o"), "rx0", "ry0", "rx1", "ry1"))
    rects = F.transform(F.array_sort(F.collect_list(F.struct("o", "ry0", "rx0", "ry1", "rx1"))), lambda r: F.array(r["rx0"], r["ry0"], r["rx1"], r["ry1"]))
    return both.groupBy(DOC, "page").agg(rects.alias("rects"), F.count("*").alias("n"))


def undo_rotation(x0: Column, y0: Column, x1: Column, y1: Column, angle: Column, width: Column, height: Column) -> Column:
    """array of a box of a page that was turned by a quarter, half or three quarters, in the page's own frame."""
    return (
        F.when(angle == 90, F.array(width - y1, x0, width - y0, x1))
        .when(angle == 180, F.array(width - x1, height - y1, width - x0, height - y0))
        .when(angle == 270, F.array(y0, height - x1, y1, height - x0))
        .otherwise(F.array(x0, y0, x1, y1))
    )


def without_native(words: DataFrame) -> DataFrame:
    """Native words, and the recognised words whose centre lies in no native word's box (two points taller)."""
    native = words.where(~F.col("is_ocr"))
    box = native.select(F.col(DOC).alias("_d"), F.col("page").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (F.col(DOC) == F.col("_d")) & (F.col("page") == F.col("_p")) & cx.between(F.col("_x0"), F.col("_x1")) & cy.between(F.col("_y0") - 2, F.col("_y1") + 2)
    return native.unionByName(words.where("is_ocr").join(box, inside, "left_anti"))


def reading_order(words: DataFrame) -> DataFrame:
    """Words with line and word_no by position: lines are quarters of y, words go by x."""
    line = F.bround(F.col("y0") / 4, 0).cast("int")
    order = Window.partitionBy(DOC, "page").orderBy("line", "x0", "word_no")
    out = words.withColumn("line", line)
    return out.withColumn("_n", F.row_number().over(order)).drop("word_no").withColumnRenamed("_n", "word_no")


def edges_ok(edges: Column, width: Column) -> Column:
    """Whether column edges are at most 99, inside the page and strictly increasing."""
    finite = F.forall(edges, lambda e: e.isNotNull() & ~F.isnan(e) & (e > 0) & (e < width))
    return (F.size(edges) <= 99) & finite & (F.array_sort(F.array_distinct(edges)) == edges)


def table_by_edges(words: DataFrame, edges: list[float]) -> DataFrame:
    """(doc_id, page, line, cells): words of a line, put into the column whose left edge they have passed."""
    col = F.lit(0)
    for e in edges:
        col = col + F.when(F.col("x0") >= e, 1).otherwise(0)
    rows = words.groupBy(DOC, "page", "line", col.alias("col")).agg(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))).alias("w"))
    rows = rows.select(DOC, "page", "line", "col", F.array_join(F.col("w.text"), " ").alias("cell"))
    rows = rows.groupBy(DOC, "page", "line").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("m"))
    return rows.select(DOC, "page", "line", F.array(*[F.coalesce(F.col("m")[i], F.lit("")) for i in range(len(edges) + 1)]).alias("cells"))


def table_by_gaps(words: DataFrame, width: float) -> DataFrame:
    """(doc_id, page, line, cells): words of a line, parted where the gap is wider than 14 or a thirtieth of the page."""
    order = Window.partitionBy(DOC, "page", "line").orderBy("x0", "word_no")
    gap = F.col("x0") - F.lag("x1").over(order)
    new = F.when(gap.isNull() | (gap > F.greatest(F.lit(14.0), F.lit(width / 30))), 1).otherwise(0)
    out = words.withColumn("_new", new).withColumn("cell", F.sum("_new").over(order))
    out = out.groupBy(DOC, "page", "line", "cell").agg(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))).alias("w"))
    out = out.select(DOC, "page", "line", F.struct("cell", F.array_join(F.col("w.text"), " ").alias("text")).alias("c"))
    return out.groupBy(DOC, "page", "line").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["text"]).alias("cells"))


def table_size(rows: DataFrame) -> DataFrame:
    """(doc_id, page, n_rows, n_columns, n_cells)"""
    n = F.size("cells")
    return rows.groupBy(DOC, "page").agg(F.count("*").alias("n_rows"), F.max(n).alias("n_columns"), F.sum(n).alias("n_cells"))


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(child) that are seeds (column child) or inherit from one over edges (child, parent): what hidden styles hide.

    The steps covered double: `up` holds the pairs that are 2^n steps apart, and
    `hidden` what inherits within fewer than 2^n steps, so a chain takes rounds in
    the logarithm of its length and one row a node. No path has more steps than
    there are edges, which ends cycles. Null names inherit nothing. Rounds are
    checkpoints, which every executor can read again.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or "file:///tmp/veilspark-checkpoints")
    hidden = seeds.select("child").where("child is not null").distinct().checkpoint()
    if hidden.isEmpty():  # nothing to inherit
        return hidden
    up = edges.select("child", "parent").where("child is not null and parent is not null and child <> parent").distinct().checkpoint()
    steps, most = 1, up.count()
    while steps <= most and not up.isEmpty():
        below = up.join(hidden.withColumnRenamed("child", "parent"), "parent", "left_semi").select("child")
        # What inherits already needs no way up; what leads to it is in `below`.
        open_ = up.join(hidden, "child", "left_anti")
        hidden = hidden.unionByName(below).distinct().checkpoint()
        up = open_.join(open_.select(F.col("child").alias("parent"), F.col("parent").alias("top")), "parent").select("child", F.col("top").alias("parent")).distinct().checkpoint()
        steps *= 2
    return hidden
