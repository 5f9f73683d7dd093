"""Queries of the data-preparation operators that belong to the core."""

from __future__ import annotations

import re

from citebase.functions.text import ACCENTED, BASE, DIGITS, SUPERSCRIPTS
from citebase.operators import units
from citebase.operators.vocabulary import SPEC_ALIASES, TYPO_LENGTH
from citebase.session import table


def p3_found(spark, sf_dir):
    """Every numeric value of the answer claims that still has to be converted, in the common unit of its spec."""
    return units.values_to_convert(table(spark, sf_dir, "answer_claims"), table(spark, sf_dir, "spec_attributes"))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _p3_sql() -> str:
    """The query in SQL: the same fixed lists, each step in its own table; patterns without look-around, words counted in lists."""
    space = r"[\s\x{A0}\x{202F}\x{2009}]"
    number = r"(?:\d{1,3}(?:[.,\x{20}\x{A0}\x{202F}\x{2009}]\d{3})+(?:[.,]\d+)?|\d+[\x{20}\x{A0}\x{202F}]\d+/\d+|\d+/\d+|\d+(?:[.,]\d+)?)"
    between = rf"(?:{space}*(?:-|–|—|\.\.\.?){space}*|{space}+(?:tot en met|tot|to|bis|jusqu['’]à|à|until|and|en|und|et){space}+)"
    names = sorted({a for *_, alias in units.UNITS for a in alias if a not in ("-", "1")}, key=len, reverse=True)
    unit = "|".join(re.escape(a).replace(r"\ ", space) for a in names)
    measure = _text(rf"(?i)(?:^|[^\pL\d.,/-])[-−]?({number})(?:{between}({number}))?{space}*({unit})?(?:[^\pL\d²³]|$)")
    part = lambda c, i: f"nullif(regexp_extract({c}, {measure}, {i}), '')"
    compact = lambda x: f"regexp_replace(replace(translate(lower({x}), {_text(ACCENTED + SUPERSCRIPTS)}, {_text(BASE + DIGITS)}), 'ß', 'ss'), '[^\\pL\\pN]+', '', 'g')"
    bare = lambda x: f"regexp_replace({x}, '\\s*\\([^()]*\\)\\s*:?\\s*$', '')"
    key = lambda x: f"trim(regexp_replace(lower({x}), '[\\s\\x{{A0}}\\x{{202F}}]+', ' ', 'g'))"
    cue = lambda lang: f"len(list_filter(regexp_split_to_array(lower(q), '[^\\pL\\pN_]+'), lambda w: list_contains([{', '.join(map(_text, units.LANGUAGE_CUES[lang].split('|')))}], w)))"
    lone = r"'^[1-9]\d{0,2}([.,])\d{3}$'"

    def value(x: str) -> str:
        t = f"translate({x}, chr(160) || chr(8239) || chr(8201), '   ')"
        plain = f"regexp_replace({t}, '[ .,]', '', 'g')"
        decimal = f"regexp_replace(regexp_replace({t}, '[.,]\\d+$', ''), '[ .,]', '', 'g') || '.' || regexp_extract({t}, '[.,](\\d+)$', 1)"
        groups = f"case lang when 'en' then regexp_extract({t}, {lone}, 1) = ',' when 'fr' then false else regexp_extract({t}, {lone}, 1) = '.' end"
        return f"""case when regexp_matches({t}, '^(?:\\d+ )?\\d+/\\d+$') then coalesce(try_cast(regexp_extract({t}, '^(\\d+) ', 1) as double), 0) + try_cast(regexp_extract({t}, '(\\d+)/\\d+$', 1) as double) / try_cast(regexp_extract({t}, '/(\\d+)$', 1) as double)
when not regexp_matches({t}, '[.,]\\d+$') then try_cast({plain} as double) when regexp_matches({t}, {lone}) then try_cast(case when {groups} then {plain} else {decimal} end as double)
when regexp_matches({t}, '^\\d+(?:[.]\\d{{3}}){{2,}}$') or regexp_matches({t}, '^\\d+(?:,\\d{{3}}){{2,}}$') then try_cast({plain} as double) else try_cast({decimal} as double) end"""

    forms = lambda x: f"list_append([{x}[1:i - 1] || {x}[i + 1:] for i in range(1, length({x}) + 1)], {x})"
    return f"""with un(alias, unit_id, quantity, factor, shift) as (values {", ".join(f"({_text(a)}, {_text(u)}, {_text(q)}, {f!r}::double, {o!r}::double)" for u, q, f, o, alias in units.UNITS for a in alias)}),
al(spec_key, alias) as (values {", ".join(f"({_text(k)}, {_text(a)})" for k, alias in SPEC_ALIASES.items() for a in alias)}),
nm as (select spec_key, unnest([spec_key, name_nl, name_en]) as alias from spec_attributes union all select spec_key, alias from al where spec_key in (select spec_key from spec_attributes)),
nf as (select name, min(spec_key) as k from (select spec_key, unnest([{compact("alias")}, {compact(bare("alias"))}]) as name from nm) where name <> '' group by 1 having min(spec_key) = max(spec_key)),
en as (select spec_key as entered, {compact("spec_key")} as whole, {compact(bare("spec_key"))} as bare from (select distinct spec_key from answer_claims where spec_key is not null)),
kn as (select entered, bare, coalesce(s.spec_key, a.k, b.k) as k from en left join spec_attributes s on s.spec_key = entered left join nf a on a.name = whole left join nf b on b.name = bare),
ty as (select bare, min(k) as k from (select distinct p.bare, nf.k from kn p join nf on p.k is null and length(p.bare) >= {TYPO_LENGTH} and length(nf.name) >= {TYPO_LENGTH} and abs(length(p.bare) - length(nf.name)) <= 1 and len(list_intersect({forms("p.bare")}, {forms("nf.name")})) > 0
and (length(p.bare) <> length(nf.name) or len(list_filter(range(1, length(p.bare) + 1), lambda i: p.bare[i] <> nf.name[i])) <= 1 or list_sort(string_split(p.bare, '')) = list_sort(string_split(nf.name, '')))) group by 1 having min(k) = max(k)),
ks as (select entered, coalesce(kn.k, ty.k) as k from kn left join ty on ty.bare = kn.bare),
tg as (select spec_key as k, unit_id as to_id, quantity as to_quantity, factor as to_factor, shift as to_shift from spec_attributes join un on alias = {key("coalesce(unit, '1')")} where data_type in ('numeric', 'numeric_range')),
q0 as (select c.*, tg.*, coalesce(case when length(trim(product_name)) > 2 then replace(source_quote, trim(product_name), ' ¤ ') end, source_quote, '') as raw, value_numeric is null and value_text is not null as in_text from answer_claims c join ks on ks.entered = c.spec_key join tg using (k) where value_numeric is not null or value_numeric_max is not null or value_text is not null),
q1 as (select *, regexp_replace(regexp_replace(raw, '\\s*\\([^()]*\\d[^()]*\\)[\\s.]*$', ''), '(?i)A1\\s?[-–]\\s?A3', '', 'g') as q from q0),
q2 as (select *, case when regexp_matches(q, '[1-9]\\d{{0,2}}[.,]\\d{{3}}(?:\\D|$)') then case when {cue("en")} > {cue("fr")} and {cue("en")} > {cue("nl")} then 'en' when {cue("fr")} > {cue("nl")} and {cue("fr")} >= {cue("en")} then 'fr' else 'nl' end end as lang,
{part("q", 1)} as s1, {part("q", 2)} as s2, {part("q", 3)} as u, case when in_text then {part("value_text", 1)} end as t1, case when in_text then {part("value_text", 3)} end as tu from q1),
q3 as (select *, coalesce({value("s1")}, {value("t1")}) as v1, {value("s2")} as v2, {key("coalesce(u, tu, case when to_quantity = 'share' then '1' else unit end)")} as ukey from q2),
q4 as (select answer_claim_id, in_text, value_numeric, value_numeric_max, v1, v2, ukey is null or coalesce(un.quantity = to_quantity, false) as fits, case when ukey is null then to_id else un.unit_id end = to_id as same, (v1 * coalesce(un.factor, to_factor) + coalesce(un.shift, to_shift) - to_shift) / to_factor as c1, (v2 * coalesce(un.factor, to_factor) + coalesce(un.shift, to_shift) - to_shift) / to_factor as c2 from q3 left join un on un.alias = ukey)
select answer_claim_id, 'value_numeric' as field_name, round(round(c1 * 1000, 5))::bigint as value_milli from q4 where v1 is not null and fits and not same and (in_text or abs(value_numeric - v1) <= greatest(1e-6, abs(v1) * 1e-6))
union all select answer_claim_id, 'value_numeric_max', round(round(c2 * 1000, 5))::bigint from q4 where v2 is not null and fits and not same and abs(value_numeric_max - v2) <= greatest(1e-6, abs(v2) * 1e-6)"""


QUERIES = {"p3_found": p3_found}
ORACLE = {"p3_found": _p3_sql()}
