"""Text expressions built from JVM functions only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their base letters, in the order of each other.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
BASE = "aaaaaaceeeeiiiinoooooouuuuyy"
SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉", "01234567890123456789"


def fold(c: Column) -> Column:
    """Lower case without accents; ß as ss. Null stays null."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED + SUPERSCRIPTS, BASE + DIGITS), "ß", "ss")


def compact(c: Column) -> Column:
    """Only the letters and digits of the folded text: equal for spellings that differ in case, accents or separators."""
    return F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", "")


def words(c: Column) -> Column:
    """Array of the lower-cased runs of letters and digits; empty for an empty text."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def normalize(c: Column) -> Column:
    """Dashes unified, white space collapsed, trimmed, lower case: the form in which quotes are compared."""
    return F.trim(F.lower(F.regexp_replace(F.translate(c, "‑–— ", "--- "), r"\s+", " ")))


def normalize_full(c: Column) -> Column:
    """``normalize`` with compatibility forms (NFKC) and full case folding, in Arrow batches, where ß must equal ss."""
    @F.pandas_udf("string")
    def full(s: pd.Series) -> pd.Series:
        dashes = str.maketrans("‑–—", "---")
        return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).translate(dashes).split()).casefold())

    return full(c)


def quoted(page: Column, snippet: Column) -> Column:
    """Whether a snippet stands in a page after normalising both; null if either is null.

    A snippet that stands there as it is also does normalised, so most rows never normalise a page.
    """
    return F.when(F.contains(page, snippet), F.lit(True)).otherwise(F.contains(normalize(page), normalize(snippet)))


def deletions(c: Column) -> Column:
    """The text itself and every text with one character left out: two texts one edit apart share an entry."""
    n = F.length(c)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(c, 1, i - 1), F.substring(c, i + 1, n)))
    return F.array_distinct(F.concat(F.array(c), cut))


def one_edit(a: Column, b: Column) -> Column:
    """One insertion, deletion or substitution, or two neighbours swapped (given a shared deletion form)."""
    chars = lambda c: F.array_sort(F.split(c, ""))
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (chars(a) == chars(b)))


def slug(*parts: Column) -> Column:
    """Lower-case ascii words joined by hyphens; ``product`` when nothing is left. Letters without an ascii base are dropped."""
    plain = F.translate(F.lower(F.concat_ws(" ", *parts)), ACCENTED + SUPERSCRIPTS, BASE + DIGITS)
    ascii_ = F.regexp_replace(F.replace(plain, F.lit("™"), F.lit("tm")), r"[^\x00-\x7F]", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(ascii_, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("product"))


def mention_offset(text: Column, needles: list[str]) -> Column:
    """Earliest 0-based offset of any needle in the text, case aside; null where none occurs or none is given."""
    found = [F.nullif(F.instr(F.lower(text), n), F.lit(0)) for n in dict.fromkeys(x.strip().lower() for x in needles if x and x.strip())]
    if not found:
        return F.lit(None).cast("bigint")
    return ((F.least(*found) if len(found) > 1 else found[0]) - 1).cast("bigint")


def own_brand(claimed: Column, audited: str) -> Column:
    """Equality or containment either way of the normalised names, both non-empty."""
    a, b = normalize(claimed), F.lit(" ".join(audited.lower().split()))
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def preview(c: Column, width: int = 80) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def token_count(c: Column) -> Column:
    """Words parted by white space, at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))).cast("bigint")
