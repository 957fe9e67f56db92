"""Sections and chunks of documents, as folds over arrays: no shuffle, one row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdoc.functions.text import clean, importance, line_type

SIZE, OVERLAP, GREEDY, SHORTEST = 512, 50, 200, 100


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def greedy(c: Column, limit: int = GREEDY) -> Column:
    """Sentences packed in order; a chunk closes when the next would take it over ``limit``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, s):
        full = (acc["open"] != "") & (F.char_length(acc["open"]) + F.char_length(s) > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["open"] == ""), s).otherwise(F.concat(acc["open"], F.lit(" "), s)).alias("open"),
        )

    return F.aggregate(sentences(c), start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def with_overlap(c: Column, limit: int = SIZE) -> Column:
    """Sentences packed to ``limit`` characters; each chunk starts with the last sentence of the one before."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def step(acc, s):
        n = F.char_length(s)
        full = (F.size(acc["open"]) > 0) & (acc["size"] + n > limit)
        last = F.try_element_at(acc["open"], F.lit(-1))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(last, s)).otherwise(F.concat(acc["open"], F.array(s))).alias("open"),
            F.when(full, F.char_length(last) + n).otherwise(acc["size"] + n).alias("size"),
        )

    end = lambda acc: F.transform(F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]), lambda x: F.array_join(x, " "))
    return F.aggregate(sentences(c), start, step, end)


def sliding(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of as many words as fit ``size`` characters on average, overlapping likewise."""

    def windows(words: Column) -> Column:
        n = F.size(words)
        mean = F.when(n > 0, F.char_length(F.array_join(words, "")) / n).otherwise(1.0)
        width, back = F.floor(size / mean).cast("int"), F.floor(overlap / mean).cast("int")
        step = F.greatest(width - back, F.lit(1))
        starts = F.when(n > 0, F.sequence(F.lit(1), n, step)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.greatest(width, F.lit(1))), " "))

    # The words are the variable of a lambda, so the text is split once and not for every window.
    return F.element_at(F.transform(F.array(F.filter(F.split(clean(c), " "), lambda w: w != "")), windows), 1)


def explode_chunks(df: DataFrame, chunks: Column, key: str = "doc_id") -> DataFrame:
    """(key, chunk_id, content), chunk_id from 0."""
    return df.select(key, F.posexplode(chunks).alias("chunk_id", "content"))


def finalised(chunks: DataFrame, shortest: int = SHORTEST, doc_type: str = "general") -> DataFrame:
    """Adds total (before the filter) and importance; drops short unimportant chunks."""
    out = chunks.withColumns({"total": F.count("*").over(Window.partitionBy("doc_id")), "importance": F.round(importance(F.col("content"), doc_type), 2)})
    return out.where((F.char_length("content") >= shortest) | (F.col("importance") >= 0.8))


def paragraphs(df: DataFrame) -> DataFrame:
    """(doc_id, idx, text) of blank-line blocks; idx counts blank ones too."""
    return df.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("idx", "text")).withColumn("text", F.trim("text")).where(F.col("text") != "")


def sections(df: DataFrame, doc_type: str = "general") -> DataFrame:
    """(doc_id, section, kind, n_lines, text): runs of lines of one kind; a blank line ends one."""
    lines = df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumns({"blank": F.trim("line") == "", "kind": line_type(F.col("line"), doc_type)})
    by = Window.partitionBy("doc_id").orderBy("i")
    turn = F.coalesce((F.lag("kind").over(by) != F.col("kind")) | F.lag("blank").over(by) | F.col("blank"), F.lit(True))
    numbered = lines.withColumn("turn", turn.cast("int")).withColumn("run", F.sum("turn").over(by)).where(~F.col("blank"))
    out = numbered.groupBy("doc_id", "run", "kind").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("ls"))
    return out.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("run")).cast("long").alias("section"), "kind", "n_lines", F.array_join(F.transform("ls", lambda x: x["line"]), " ").alias("text"))


def reading_order(elements: DataFrame) -> DataFrame:
    """Adds ``position``: top to bottom, left to right, page by page."""
    order = Window.partitionBy("doc_id").orderBy("page", "y1", "x1", "element_id")
    kept = elements.where((F.col("kind") == "image") | (F.trim("text") != ""))
    return kept.withColumn("position", F.row_number().over(order).cast("long"))


def layout_kind(text: Column, font: Column) -> Column:
    """Kind of a text block by its font and looks."""
    t = F.trim(text)
    return (
        F.when((font > 14) | (t.rlike("^[A-Z\\s]+$") & (F.char_length(t) < 100)), "header")
        .when(t.rlike(r"^\s*[•\-*\d+.]\s+"), "list")
        .when(t.contains("\t") | t.rlike(r"\d+\s+\d+"), "table")
        .when(font < 10, "footer")
        .otherwise("paragraph")
    )


def table_regions(horizontal: DataFrame, vertical: DataFrame) -> DataFrame:
    """Rectangles between neighbouring horizontal ``(page, y)`` and vertical ``(page, x)`` lines of a page."""
    h = horizontal.withColumn("y2", F.lead("y").over(Window.partitionBy("page").orderBy("y"))).where(F.col("y2") > F.col("y"))
    v = vertical.withColumn("x2", F.lead("x").over(Window.partitionBy("page").orderBy("x"))).where(F.col("x2") > F.col("x"))
    return h.join(v, "page").select("page", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def merge_boxes(boxes: DataFrame, near: float = 20.0) -> DataFrame:
    """Boxes ``(page, x1, y1, x2, y2)`` whose centres lie close to a seed's become one, in reading order.

    Greedy and relative to the seed, so it depends on order: one page is a group.
    """
    import pandas as pd

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["y1", "x1", "y2", "x2"]).to_dict("records")
        out = []
        while left:
            seed, *rest = left
            cx, cy = (seed["x1"] + seed["x2"]) / 2, (seed["y1"] + seed["y2"]) / 2
            close = [b for b in rest if ((b["x1"] + b["x2"]) / 2 - cx) ** 2 + ((b["y1"] + b["y2"]) / 2 - cy) ** 2 < near * near]
            left = [b for b in rest if b not in close]
            group = [seed, *close]
            out.append((seed["page"], min(b["x1"] for b in group), min(b["y1"] for b in group), max(b["x2"] for b in group), max(b["y2"] for b in group), len(group)))
        return pd.DataFrame(out, columns=["page", "x1", "y1", "x2", "y2", "n"])

    return boxes.groupBy("page").applyInPandas(page, "page long, x1 double, y1 double, x2 double, y2 double, n long")
