"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL that gives the same rows where there is one."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


#: SQL pieces used in several statements.
TRIGRAMS = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+') if w <> '']))"
NORMAL = "trim(lower(regexp_replace(translate({0}, '‑–— ', '--- '), '\\s+', ' ', 'g')))"
SIX = "case when {0} = 0 then '0' else regexp_replace(regexp_replace(cast(cast(round({0} * pow(10, 5 - floor(log10(abs({0}))))) / pow(10, 5 - floor(log10(abs({0})))) as decimal(38,12)) as varchar), '0+$', ''), '[.]$', '') end"
WORDS = "[w for w in regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+') if w <> '']"
SLUG = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(lower({0})), '™', 'tm'), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'product')"
VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
HTML = "'<html><head><title>' || coalesce(title, '') || '</title><style>p {{ color: red }}</style></head><body>' || text || '<script>var x = 1</script></body></html>'"
