"""Sinks: partitioned snapshots, bucketed tables and report sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citebase.functions.parsing import xml_escape


def write_current(log: DataFrame, path: str, current: str = "is_current") -> None:
    """A log split by whether a row is current, so that readers of the current state prune the rest."""
    log.write.mode("overwrite").partitionBy(current).parquet(path)


def write_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by its join key: joins on it need no shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def report_sections(report_id: str, sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """(report_id, position, title, body): each section's rows as JSON lines in one ordered frame."""
    out = None
    for at, (title, rows) in enumerate(sections):
        part = rows.select(F.lit(report_id).alias("report_id"), F.lit(at).cast("bigint").alias("position"), F.lit(title).alias("title"), F.to_json(F.struct("*")).alias("body"))
        out = part if out is None else out.unionByName(part)
    return out


def render_html(sections: DataFrame) -> DataFrame:
    """(report_id, html): the sections of each report as one page, in order, every text escaped.

    A report is what people read, so its sections are gathered in one row.
    """
    escape = lambda c: xml_escape(F.col(c))
    per = sections.groupBy("report_id", "position", "title").agg(F.array_sort(F.collect_list(escape("body"))).alias("rows"))
    part = F.concat(F.lit("<h2>"), escape("title"), F.lit("</h2><ul>"), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("<li>"), r, F.lit("</li>"))), ""), F.lit("</ul>"))
    pages = per.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("position", part.alias("part")))).alias("parts"))
    return pages.select("report_id", F.concat(F.lit("<html><body>"), F.array_join(F.transform("parts", lambda p: p["part"]), ""), F.lit("</body></html>")).alias("html"))


def merge_json(a, b):
    """Shallow merge of two JSON objects as maps of strings; the right one wins. Null counts as empty."""
    kind = "map<string,string>"
    left, right = (F.coalesce(F.from_json(c, kind), F.from_json(F.lit("{}"), kind)) for c in (a, b))
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)
