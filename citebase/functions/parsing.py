"""Values in texts that sources get wrong: arrays encoded twice, times, and texts put into markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_array(c: Column, element: str, wrapper: str) -> Column:
    """An array given as JSON, as a JSON text that holds JSON, or inside an object under ``wrapper``; null for anything else."""
    kind, wrapped = f"array<{element}>", f"struct<`{wrapper}`:array<{element}>>"
    inner = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "struct<v:string>")["v"]
    text = F.when(F.trim(c).startswith('"'), inner).otherwise(c)
    of = lambda t: F.when(F.trim(t).startswith("["), F.from_json(t, kind)).when(F.trim(t).startswith("{"), F.from_json(t, wrapped)[wrapper])
    return of(text)


def iso_time(c: Column) -> Column:
    """A date or a time of ISO 8601, with or without an offset (UTC where there is none); null for anything else."""
    t = F.trim(c)
    known = t.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
    whole = F.regexp_replace(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-].*)?$", "$1:00$2")
    return F.when(known, whole.try_cast("timestamp"))


def xml_escape(c: Column) -> Column:
    """A text as it has to stand in markup; null and empty as a dash."""
    safe = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("-"))


def positions(tokens: Column, term: str) -> Column:
    """1-based positions of a term in a token array, in order."""
    at = F.transform(tokens, lambda w, i: F.when(w == term, i + 1))
    return F.filter(at, lambda i: i.isNotNull())


def tail_tokens(c: Column, n: int) -> Column:
    """The last n words of a text parted by white space, joined by blanks; empty for n below 1 or no word."""
    ws = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(ws, F.greatest(F.size(ws) - n + 1, F.lit(1)), F.lit(n)), " ") if n > 0 else F.lit("")
