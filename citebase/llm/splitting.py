"""Splitting of oversized items at natural boundaries.

Lexical-cohesion segmentation: at every sentence, line or row end the words of the blocks before and after are compared;
valleys of their similarity mark topic boundaries. Each piece ends at the deepest valley of its size window, and the next
one repeats the last tokens of the piece before it. A token is a run of characters other than white space (no-break and narrow spaces are white space too), which is what ``str.split`` parts at.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a piece at most, tokens repeated from the piece before, tokens of a comparison block.
LIMIT, OVERLAP, BLOCK = 800, 120, 60

_SENTENCE_END = re.compile(r"[.!?:;。…][\"'”’»)\]*_]*$")
_PUNCTUATION = ".,;:!?()[]{}\"'“”„’‘«»*_#|-–—/"


def cohesion_depths(words: list[str], gaps: list[int], block: int = BLOCK) -> list[float]:
    """Depth of the similarity valley at each gap (a position between words): how far similarity rises on both sides.

    Two sliding blocks: moving a gap by a word changes three counts; the rises come from one pass each way. So the cost
    grows with the words only, whatever the text.
    """
    numbers: dict[str, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    n, wanted, similar = len(ids), set(gaps), []
    left, right = [0] * len(numbers), [0] * len(numbers)
    dot = left2 = right2 = 0
    for w in ids[:block]:
        right2 += 2 * right[w] + 1
        right[w] += 1
    for g in range(1, n):
        w = ids[g - 1]  # crosses from the right block to the left one
        dot += right[w] - left[w] - 1
        right2 -= 2 * right[w] - 1
        left2 += 2 * left[w] + 1
        right[w] -= 1
        left[w] += 1
        if g > block:
            w = ids[g - block - 1]
            dot -= right[w]
            left2 -= 2 * left[w] - 1
            left[w] -= 1
        if g + block <= n:
            w = ids[g + block - 1]
            dot += left[w]
            right2 += 2 * right[w] + 1
            right[w] += 1
        if g in wanted:
            similar.append(dot / math.sqrt(left2 * right2))
    return [b + a - 2 * s for b, s, a in zip(_peaks(similar), similar, reversed(_peaks(similar[::-1])))]


def _peaks(values: list[float]) -> list[float]:
    """For each value the one reached by walking back from it as long as the values do not fall.

    Where the value before is not lower, the walk goes on to where that one's own walk ended.
    """
    peaks: list[float] = []
    for k, v in enumerate(values):
        peaks.append(peaks[-1] if k and values[k - 1] >= v else v)
    return peaks


def split_tokens(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(first token, end token, first character, end character) of each piece of a text; one piece if it fits.

    A piece holds at most ``limit`` tokens and, but for the first, begins with the last ``overlap`` tokens of the one
    before. It ends at the deepest valley of the whole window but its first eighth beyond the overlap, so that pieces advance;
    valleys there count only where there is no other. Where a window has no natural boundary the piece is filled to the limit.
    """
    tokens = text.split()
    n = len(tokens)
    if n <= limit:
        return [(0, n, 0, len(text))] if n else []
    overlap = min(overlap, limit - 1)
    starts, ends, at = [], [], 0
    for t in tokens:
        at = text.index(t, at)
        starts.append(at)
        at += len(t)
        ends.append(at)
    gaps, strength = [], []
    for k in range(1, n):
        if starts[k] - ends[k - 1] > 1 or text[ends[k - 1]] != " ":
            between = text[ends[k - 1] : starts[k]]
            lines = between.count("\n") + between.count("\u2028") or between.count("\r")
            if lines:
                gaps.append(k), strength.append(0.2 if lines > 1 else 0.1)
                continue
        if not tokens[k - 1][-1].isalnum() and _SENTENCE_END.search(tokens[k - 1]):
            gaps.append(k), strength.append(0.0)
    words = [t.strip(_PUNCTUATION).lower() for t in tokens]
    score = dict(zip(gaps, (d + s for d, s in zip(cohesion_depths(words, gaps), strength))))
    pieces, start, done = [], 0, 0
    while n - start > limit:
        top = start + limit
        least = start + overlap + (limit - overlap) // 8
        window = [g for g in range(max(done + 1, least), top + 1) if g in score] or [g for g in range(done + 1, top + 1) if g in score and g > start + overlap]
        end = max(window, key=lambda g: (score[g], g)) if window else top
        pieces.append((start, end))
        start, done = max(end - overlap, start + 1), end
    pieces.append((start, n))
    return [(a, b, starts[a] if a else 0, ends[b - 1] if b < n else len(text)) for a, b in pieces]


def table_text(rows: Column) -> Column:
    """A table as text: cells parted by tabs, rows by line ends; null cells and rows are empty."""
    cells = lambda r: F.array_join(F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))), "\t")
    return F.array_join(F.transform(rows, cells), "\n")


def long_items(chunks: DataFrame, pages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(item_kind, item_id, item_index, heading_path, text) of the chunks and page tables that may exceed the limit.

    A text of more tokens has at least twice as many characters less one, so shorter ones are dropped before they reach
    Python; tokens themselves are counted there, as stored counts may be null or wrong. A heading path is kept only if the
    text begins with it.
    """
    path = F.col("heading_path")
    letters = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    joined = letters(F.array_join(path, ""))
    # the start of the text settles most rows; else the whole one counts, as any number of other characters may stand between
    begins = F.when(F.startswith(letters(F.substring("content", 1, 2000)), joined), True).otherwise(F.startswith(letters(F.col("content")), joined))
    known = F.when((F.size(path) > 0) & begins, path)
    a = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.lit(0).alias("item_index"), known.alias("heading_path"), F.col("content").alias("text"))
    tables = pages.select("page_id", F.posexplode("page_tables").alias("item_index", "t"))
    b = tables.select(F.lit("table").alias("item_kind"), F.col("page_id").alias("item_id"), "item_index", F.lit(None).cast("array<string>").alias("heading_path"), table_text(F.col("t.rows")).alias("text"))
    return a.unionByName(b).where(F.length("text") > 2 * limit)


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row for each piece of the items over the limit: item_kind, item_id, item_index, piece_index, first_token,
    token_count, heading_path, content.

    Joined without their repeated tokens, the pieces give the text back character for character. Null and blank texts give
    no piece. One narrow map; an item is one text, so no task holds more than its rows.
    """
    schema = "item_kind string, item_id bigint, item_index int, piece_index int, first_token int, token_count int, heading_path array<string>, content string"

    def run(batches):
        for b in batches:
            out = [[] for _ in range(8)]
            for kind, i, index, path, text in zip(*(b.column(k).to_pylist() for k in range(5))):
                pieces = split_tokens(text, limit, overlap) if text else ()
                for p, (first, end, a, z) in enumerate(pieces if len(pieces) > 1 else ()):
                    for column, value in zip(out, (kind, i, index, p, first, end - first, path, text[a:z])):
                        column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["item_kind", "item_id", "item_index", "piece_index", "first_token", "token_count", "heading_path", "content"])

    return items.select("item_kind", "item_id", "item_index", "heading_path", "text").mapInArrow(run, schema)
