"""Pages to chunks: headings by font size, tables whole, prose flushed at a size with a carried tail.

Everything is built of windows, aggregates and array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citebase.functions.text import token_count
from citebase.session import checkpointed

#: Heading sizes against the page's median, longest heading, chunk size and carried share.
LEVEL_1, LEVEL_2, HEADING_LENGTH, MAX_TOKENS, CARRIED = 1.4, 1.15, 100, 800, 0.15
#: Units and classes that make a table one of specifications, each as a word of its own.
SPEC_WORDS = ["mm", "dB", "kg", "kg/m2", "kg/m3", "W/mK", "m2K/W", "W/m2K", "°C", "%", r"EI\d+", r"S\d+", "kPa", "EUR"]

def markdown(rows: Column) -> Column:
    """A table as markdown: cells trimmed, pipes replaced, rows cut or filled to the header's width; empty for no rows."""
    cells = lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("/")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    head = cells(rows[0])
    width = F.size(head)
    fit = lambda r: F.slice(F.concat(cells(r), F.array_repeat(F.lit(""), width)), F.lit(1), F.greatest(width, F.lit(0)))
    body = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(fit(r)))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(head), rule), body), "\n")).otherwise("")


def table_type(rows: Column) -> Column:
    flat = F.array_join(F.flatten(F.transform(rows, lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))))), " ")
    return F.when(F.regexp_like(flat, F.lit(rf"(?iU)\b(?:{'|'.join(SPEC_WORDS)})\b")), "spec_table").otherwise("table")


def lines_outside_tables(pages: DataFrame) -> DataFrame:
    """(page_id, position, text, top, avg_font_size) of the lines that lie in no table (a margin of 1 around it)."""
    inside = lambda line: F.exists(F.coalesce("page_tables", F.array()), lambda t: (line["top"] >= t["top"] - 1) & (line["top"] <= t["bottom"] + 1))
    kept = F.filter(F.transform("page_lines", lambda x, i: F.struct(i.alias("position"), x["text"].alias("text"), x["top"].alias("top"), x["avg_font_size"].alias("avg_font_size"))), lambda s: ~F.coalesce(inside(s), F.lit(False)))
    return pages.select("page_id", F.explode(kept).alias("s")).select("page_id", F.col("s.position").cast("bigint").alias("position"), "s.text", "s.top", "s.avg_font_size")


def group_lines(words: DataFrame, key: list[str], tolerance: float = 2.0) -> DataFrame:
    """Words (key, text, top, left, size) to lines: a gap of more than the tolerance to the word before opens a line.

    Columns: key, line, text, top (of its first word), median_size (the upper median).
    """
    w = Window.partitionBy(*key).orderBy("top", "left")
    gap = (F.col("top") - F.lag("top").over(w)) > tolerance
    numbered = words.withColumn("line", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w))
    out = numbered.groupBy(*key, "line").agg(F.array_sort(F.collect_list(F.struct("left", "top", "text"))).alias("ws"), F.min("top").alias("top"), F.array_sort(F.collect_list("size")).alias("sizes"))
    return out.select(*key, F.col("line").cast("bigint").alias("line"), F.array_join(F.transform("ws", lambda s: s["text"]), " ").alias("text"), "top", F.element_at("sizes", (F.floor(F.size("sizes") / 2) + 1).cast("int")).alias("median_size"))


def page_events(pages: DataFrame) -> DataFrame:
    """(document_version_id, page_number, seq, kind, text): tables and lines outside them in reading order, typed by font size."""
    tables = pages.select("page_id", "document_version_id", "page_number", F.posexplode("page_tables").alias("i", "t")).select(
        "page_id", "document_version_id", "page_number", F.col("t.top").alias("top"), F.lit(0).alias("side"), F.col("i").cast("bigint").alias("i"), table_type(F.col("t.rows")).alias("kind"), markdown(F.col("t.rows")).alias("text")
    )
    median = pages.select("page_id", "document_version_id", "page_number", "median_font_size")
    lines = lines_outside_tables(pages).join(median, "page_id").withColumn("text", F.trim("text")).where("text <> ''")
    big = lambda ratio: F.coalesce((F.col("median_font_size") > 0) & (F.length("text") <= HEADING_LENGTH) & (F.col("avg_font_size") >= F.col("median_font_size") * ratio), F.lit(False))
    kind = F.when(big(LEVEL_1), "h1").when(big(LEVEL_2), "h2").otherwise("text")
    lines = lines.select("page_id", "document_version_id", "page_number", "top", F.lit(1).alias("side"), F.col("position").alias("i"), kind.alias("kind"), "text")
    return tables.unionByName(lines)


def chunk_documents(pages: DataFrame) -> DataFrame:
    """Chunks of every document version; pages without a version are documents of their own, under ``page_id``.

    All words of a document's texts are one sequence. A chunk of prose ends before each heading and table that follows any
    text, and after the text with which the words since the last such end, and the repeated ones, reach ``MAX_TOKENS``; it
    begins ``CARRIED`` of them before the end of the one before, also across headings and tables. Tables are chunks of their
    own. Heading paths are running last values; nothing but the choice of ends within one run of texts is sequential, and
    that folds over the run's word counts. Pages without lines and tables give no chunk.
    """
    carried = int(MAX_TOKENS * CARRIED)
    key = F.when(F.col("document_version_id").isNull(), F.col("page_id"))
    events = page_events(pages).select(F.col("document_version_id").alias("v"), key.alias("p"), "page_number", "page_id", "top", "side", "i", "kind", "text")
    order = Window.partitionBy("v", "p").orderBy("page_number", "page_id", "top", "side", "i")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    is_text = F.col("kind") == "text"
    words = F.when(is_text, F.filter(F.split("text", r"\s+"), lambda w: w != "")).otherwise(F.array().cast("array<string>"))
    events = events.withColumn("words", words).withColumns({"at": F.row_number().over(order), "total": F.sum(F.size("words")).over(so_far), "barrier": (~is_text).cast("int")})
    events = events.withColumn("run", F.coalesce(F.sum("barrier").over(before), F.lit(0)))
    heading = F.struct(F.col("at").alias("at"), F.col("text").alias("text"))
    last = lambda c, w: F.last(F.when(c, heading), ignorenulls=True).over(w)
    # the path's head is the last heading of level 1, or before any the first one of level 2
    for name, w in (("path", so_far), ("path_before", before)):
        head = F.coalesce(last(F.col("kind") == "h1", w), F.first(F.when(F.col("kind") == "h2", heading), ignorenulls=True).over(w))
        leaf = last(F.col("kind") == "h2", w)
        events = events.withColumn(name, F.transform(F.filter(F.array(head, F.when(leaf["at"] > head["at"], leaf)), lambda h: h.isNotNull()), lambda h: h["text"]))
    events = events.withColumn("page", F.last(F.when(is_text, F.col("page_number")), ignorenulls=True).over(so_far)).withColumn("first_page", F.first(F.when(is_text, F.col("page_number")), ignorenulls=True).over(so_far))
    events = checkpointed(events.drop("i", "top", "side"))  # read four times

    # a run is the texts up to a heading or table, which ends it; its ends of prose in order
    stop = F.struct("at", "total", "page", "barrier", F.when(is_text, F.col("path")).otherwise(F.col("path_before")).alias("path"))
    runs = events.groupBy("v", "p", "run").agg(F.array_sort(F.collect_list(stop)).alias("stops"), F.min(F.col("total") - F.size("words")).alias("begun"), F.first("first_page", ignorenulls=True).alias("first_page"))
    kind = "struct<at:int,total:bigint,page:int,barrier:int,path:array<string>>"
    start = F.struct(F.col("begun").cast("bigint").alias("end"), F.array().cast(f"array<{kind}>").alias("ends"))

    def fold(done, s):
        full = s["total"] - F.greatest(done["end"] - carried, F.lit(0)) >= MAX_TOKENS
        ends = ((s["barrier"] == 1) | full) & (s["total"] > 0)
        return F.when(ends, F.struct(s["total"].alias("end"), F.concat(done["ends"], F.array(s.cast(kind))).alias("ends"))).otherwise(done)

    prose = runs.select("v", "p", "first_page", F.explode(F.aggregate("stops", start, fold)["ends"]).alias("s"))
    # what is left at the end of a document
    ended = events.groupBy("v", "p").agg(F.max("at").alias("at"), F.max("total").alias("total"), F.max_by("page", "at").alias("page"), F.max_by("path", "at").alias("path"), F.max_by("first_page", "at").alias("first_page")).where("total > 0")
    left = ended.select("v", "p", "first_page", F.struct(F.col("at") + 1, "total", "page", F.lit(1), "path").cast(kind).alias("s"))
    w = Window.partitionBy("v", "p").orderBy("s.at", "s.barrier")
    prose = prose.unionByName(left).withColumns({"ended": F.lag("s.total").over(w), "ended_page": F.lag("s.page").over(w)})
    prose = prose.select("v", "p", F.col("s.at").alias("at"), F.lit(0).alias("side"), F.coalesce("ended_page", "first_page", F.lit(1)).alias("page_start"), F.coalesce("s.page", "first_page", F.lit(1)).alias("page_end"), F.lit("prose").alias("chunk_type"), F.col("s.path").alias("heading_path"), F.greatest(F.lit(0), F.coalesce(F.col("ended") - carried, F.lit(0))).alias("from"), F.col("s.total").alias("to"))
    # one row of words and one of chunks for each document
    texts = events.where(is_text).groupBy(F.col("v").alias("tv"), F.col("p").alias("tp")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda s: s["words"])).alias("all"))
    columns = ["at", "side", "page_start", "page_end", "chunk_type", "heading_path"]
    spans = prose.groupBy("v", "p").agg(F.collect_list(F.struct(*columns, "from", "to")).alias("c")).join(texts, F.col("v").eqNullSafe(F.col("tv")) & F.col("p").eqNullSafe(F.col("tp")))
    body = F.transform("c", lambda c: c.withField("body", F.array_join(F.slice("all", c["from"].cast("int") + 1, (c["to"] - c["from"]).cast("int")), " ")))
    prose = spans.select("v", "p", F.explode(body).alias("c")).select("v", "p", *(f"c.{x}" for x in columns), "c.body")
    tables = events.where(F.col("kind").isin("table", "spec_table")).select("v", "p", "at", F.lit(1).alias("side"), F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.col("kind").alias("chunk_type"), F.col("path").alias("heading_path"), F.col("text").alias("body"))
    content = F.when(F.size("heading_path") > 0, F.concat(F.array_join("heading_path", " > "), F.lit("\n\n"), "body")).otherwise(F.col("body"))
    index = F.row_number().over(Window.partitionBy("v", "p").orderBy("at", "side")) - 1
    out = prose.unionByName(tables).withColumn("content", content)
    return out.select(F.col("v").alias("document_version_id"), F.col("p").alias("page_id"), index.alias("chunk_index"), "page_start", "page_end", "chunk_type", "heading_path", "content", token_count(F.col("content")).cast("int").alias("token_count"))


def page_chunk(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(page_id, chunk_id): the first chunk of the version whose page span holds the page.

    Chunks are exploded to the pages they span and joined on equality, instead of a range condition.
    """
    spans = chunks.where("page_start <= page_end").select("document_version_id", "chunk_id", "chunk_index", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    first = spans.groupBy("document_version_id", "page_number").agg(F.min_by("chunk_id", F.struct("chunk_index", "chunk_id")).alias("chunk_id"))
    return pages.select("page_id", "document_version_id", "page_number").join(first, ["document_version_id", "page_number"], "left").select("page_id", "chunk_id")
