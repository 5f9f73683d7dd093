"""Queries of web diagnostics, chunking and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citebase.functions.web import crawl_prefix, html_title, visible_text
from citebase.operators import chunking, web
from citebase.plans.facts import LATEST
from citebase.plans.registry import HTML, SIX, VISIBLE, query
from citebase.session import table
from citebase.streaming import latest


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as crawled pages: page_id, url, html."""
    docs = table(spark, d, "documents")
    html = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title><style>p { color: red }</style></head><body>"), "text", F.lit("<script>var x = 1</script></body></html>"))
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://"), "source", F.lit("/docs/page?id="), F.col("doc_id").cast("string")).alias("url"), html.alias("html"))


PAGE = HTML.replace("{{", "{").replace("}}", "}")


@query(f"select doc_id as page_id, nullif(trim(regexp_extract({PAGE}, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as title from documents")
def html_titles(spark, d):
    return pages(spark, d).select("page_id", html_title(F.col("html")).alias("title"))


@query(f"select doc_id as page_id, length({VISIBLE.format('(' + PAGE + ')')})::bigint as n from documents")
def visible_text_length(spark, d):
    return pages(spark, d).select("page_id", F.length(visible_text(F.col("html"))).cast("bigint").alias("n"))


@query("""with h as (select doc_id as page_id, source, unnest(regexp_extract_all(text, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) as href from documents), c as (select *, regexp_replace(trim(href), '[?#].*$', '') as clean from h),
r as (select page_id, href, case when clean = '' then null when regexp_matches(lower(clean), '^https?://') then clean when starts_with(clean, '//') then 'https:' || clean when regexp_matches(clean, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then null when starts_with(clean, '/') then 'https://' || source || clean else 'https://' || source || '/docs/' || clean end as url from c)
select page_id, href, case when not regexp_matches(url, '(?i)\\.(?:pdf|jpg|jpeg|png|gif|svg|zip|doc|docx|xls|xlsx)$') then url end as url from r""")
def link_normalise(spark, d):
    """Every anchor of every page, resolved; duplicates kept."""
    return web.links(pages(spark, d)).select("page_id", "href", "url")


@query("select doc_id as page_id, 'https://' || source || '/docs/page/' as prefix from documents")
def crawl_prefixes(spark, d):
    return pages(spark, d).select("page_id", crawl_prefix(F.col("url")).alias("prefix"))


@query(f"""with c as (select answer_claim_id, value_numeric, value_text, value_bool, {VISIBLE.format("response_text")} as t, {SIX.format("value_numeric")} as g from answer_claims left join visibility_answers using (answer_id))
select answer_claim_id, case when value_numeric is not null then regexp_matches(t, '(?:^|[^\\p{{L}}\\p{{N}}_])(?:' || replace(replace(g, '-', '[-]'), '.', '[.]') || '|' || replace(replace(g, '-', '[-]'), '.', ',') || ')(?:$|[^\\p{{L}}\\p{{N}}_])') when value_text is not null then contains(lower(t), lower(value_text)) end as found from c""")
def page_value_visible(spark, d):
    """Whether each claimed value stands in the visible text of its answer; null for flags."""
    c = table(spark, d, "answer_claims").select("answer_claim_id", "answer_id", "value_numeric", "value_text", "value_bool")
    a = table(spark, d, "visibility_answers").select("answer_id", visible_text(F.col("response_text")).alias("visible"))
    return web.value_visible(c.join(a, "answer_id", "left")).select("answer_claim_id", "found")


#: Robots files and what they say: file, text, agent, path, allowed, rule.
ROBOTS = [
    (1, "User-agent: *\nDisallow:\n\nUser-agent: GPTBot\nDisallow: /", "GPTBot", "/", False, "Disallow: /"),
    (1, "User-agent: *\nDisallow:\n\nUser-agent: GPTBot\nDisallow: /", "CCBot", "/", True, None),
    (2, "User-agent: *\nDisallow: /private", "PerplexityBot", "/privateer", False, "Disallow: /private"),
    (3, "User-agent: SomeOtherBot\nDisallow: /", "GPTBot", "/", True, None),
    (4, "User-agent: GPTBot\nAllow: /public/\nDisallow: /public/secret/", "GPTBot", "/public/secret/file", False, "Disallow: /public/secret/"),
    (5, "User-agent: GPTBot\nAllow: /x\nDisallow: /x", "GPTBot", "/x", True, "Allow: /x"),
    (6, "User-agent: GPTBot\nDisallow: /*/print", "GPTBot", "/products/print", False, "Disallow: /*/print"),
    (6, "User-agent: GPTBot\nDisallow: /*/print", "GPTBot", "/products/page", True, None),
    (7, "User-agent: GPTBot\nDisallow: /file.pdf$", "GPTBot", "/file.pdf", False, "Disallow: /file.pdf$"),
    (7, "User-agent: GPTBot\nDisallow: /file.pdf$", "GPTBot", "/file.pdf.bak", True, None),
    (8, "User-agent: gptbot\nDisallow: /first-only\n\nUser-agent: GPTBot\nDisallow: /second-only", "GPTBot", "/first-only", False, "Disallow: /first-only"),
    (8, "User-agent: gptbot\nDisallow: /first-only\n\nUser-agent: GPTBot\nDisallow: /second-only", "GPTBot", "/second-only", False, "Disallow: /second-only"),
    (9, "Disallow: /orphan\nUser-agent: GPTBot # comment\nUser-agent: CCBot\nDisallow: /real", "CCBot", "/real", False, "Disallow: /real"),
    (9, "Disallow: /orphan\nUser-agent: GPTBot # comment\nUser-agent: CCBot\nDisallow: /real", "GPTBot", "/orphan", True, None),
]
_VALUES = ", ".join(f"({f}, '{a}', '{p}', {str(ok).lower()}, {'null' if r is None else repr(r)})" for f, _, a, p, ok, r in ROBOTS)


@query(f"select * from (values {_VALUES}) t(file_id, user_agent, path, allowed, matched_rule)")
def robots_eval(spark, d):
    files = spark.createDataFrame(sorted({(r[0], r[1]) for r in ROBOTS}), "file_id int, robots_txt string")
    asked = spark.createDataFrame([(r[0], r[2], r[3]) for r in ROBOTS], "file_id int, user_agent string, path string")
    return web.evaluate_robots(files, asked).drop("matched_group")


@query("""with f(file_id, allowed) as (values (1, false), (2, true), (3, null), (4, null)), a(user_agent) as (values ('GPTBot'), ('OAI-SearchBot'), ('ChatGPT-User'), ('ClaudeBot'), ('Claude-User'), ('Claude-SearchBot'), ('PerplexityBot'), ('Perplexity-User'), ('Google-Extended'), ('Applebot-Extended'), ('CCBot'), ('meta-externalagent'), ('Bingbot'))
select file_id, user_agent, allowed from f, a""")
def crawlability(spark, d):
    """Fetched files by status: 200, 404, 500 and no answer."""
    f = spark.createDataFrame([(1, 200, "User-agent: *\nDisallow: /", "/p"), (2, 404, None, "/p"), (3, 500, "User-agent: *\nDisallow: /", "/p"), (4, None, None, "/p")], "file_id int, status_code int, robots_txt string, path string")
    return web.crawlability(f)


MARKDOWN = """with t as (select page_id, generate_subscripts(page_tables, 1) - 1 as i, unnest(page_tables) as t from document_pages), c as (select page_id, i, list_transform(t.rows, lambda r: list_transform(coalesce(r, []), lambda c: replace(trim(coalesce(c, '')), '|', '/'))) as rows from t),
m as (select page_id, i, rows, len(rows[1]) as w from c)
select page_id, i::bigint as table_index, case when len(rows) > 0 then array_to_string(list_concat(['| ' || array_to_string(rows[1], ' | ') || ' |', '| ' || array_to_string([('---') for _ in range(w)], ' | ') || ' |'], list_transform(rows[2:], lambda r: '| ' || array_to_string(list_transform(range(1, w + 1), lambda k: coalesce(r[k], '')), ' | ') || ' |')), chr(10)) else '' end as markdown from m"""


@query(MARKDOWN)
def table_markdown(spark, d):
    t = table(spark, d, "document_pages").select("page_id", F.posexplode("page_tables").alias("table_index", "t"))
    return t.select("page_id", F.col("table_index").cast("bigint").alias("table_index"), chunking.markdown(F.col("t.rows")).alias("markdown"))


@query("""with l as (select page_id, page_tables, generate_subscripts(page_lines, 1) - 1 as position, unnest(page_lines) as line from document_pages)
select page_id, position::bigint as position, line.text as text from l where len(list_filter(coalesce(page_tables, []), lambda t: line.top >= t.top - 1 and line.top <= t.bottom + 1)) = 0""")
def lines_outside_tables(spark, d):
    return chunking.lines_outside_tables(table(spark, d, "document_pages")).select("page_id", "position", "text")


@query("""with c as (select p.page_id, c.chunk_id, row_number() over (partition by p.page_id order by c.chunk_index, c.chunk_id) as rn from document_pages p join document_chunks c on c.document_version_id = p.document_version_id and p.page_number between c.page_start and c.page_end)
select p.page_id, c.chunk_id from document_pages p left join c on c.page_id = p.page_id and rn = 1""")
def page_chunk(spark, d):
    """Page to its first chunk: a range join as an equi-join on the spanned pages."""
    return chunking.page_chunk(table(spark, d, "document_pages"), table(spark, d, "document_chunks"))


TYPES = """select page_id, i, case when regexp_matches(x, '(?i)[^\\pL\\pN_](?:mm|db|kg|kg/m2|kg/m3|w/mk|m2k/w|w/m2k|ei[0-9]+|s[0-9]+|kpa|eur)[^\\pL\\pN_]') or regexp_matches(x, '(?i)[\\pL\\pN_](?:°C[^\\pL\\pN_]|%[\\pL\\pN_])') then 'spec_table' else 'table' end as kind
from (select page_id, i, ' ' || array_to_string(list_transform(flatten(list_transform(t.rows, lambda r: coalesce(r, []))), lambda c: coalesce(c, '')), ' ') || ' ' as x from (select page_id, generate_subscripts(page_tables, 1) - 1 as i, unnest(page_tables) as t from document_pages))"""
CHUNKS = f"""with recursive md as ({MARKDOWN}), ty as ({TYPES}),
pg as (select *, coalesce('v' || document_version_id, 'p' || page_id) as k from document_pages),
li as (select k, page_id, page_number as pn, median_font_size as m, page_tables, generate_subscripts(page_lines, 1) - 1 as i, unnest(page_lines) as l from pg),
ke as (select *, trim(l.text) as text from li where len(list_filter(coalesce(page_tables, []), lambda t: l.top >= t.top - 1 and l.top <= t.bottom + 1)) = 0 and trim(l.text) <> ''),
ta as (select k, page_id, page_number as pn, generate_subscripts(page_tables, 1) - 1 as i, unnest(page_tables) as t from pg),
ev as (select k, pn, page_id, l.top as top, 1 as side, i, case when m > 0 and length(text) <= 100 and l.avg_font_size >= m * 1.4 then 'h1' when m > 0 and length(text) <= 100 and l.avg_font_size >= m * 1.15 then 'h2' else 'text' end as kind, text from ke
union all select ta.k, ta.pn, ta.page_id, ta.t.top, 0, ta.i, ty.kind, md.markdown from ta join ty on ty.page_id = ta.page_id and ty.i = ta.i join md on md.page_id = ta.page_id and md.table_index = ta.i),
o as (select *, case when kind = 'text' then [x for x in regexp_split_to_array(text, '\\s+') if x <> ''] else []::varchar[] end as words, row_number() over (partition by k order by pn nulls first, page_id, top nulls first, side, i) as pos from ev),
h as (select *, sum(len(words)) over u as total, last_value(case when kind = 'text' then pn end ignore nulls) over u as page, first_value(case when kind = 'text' then pn end ignore nulls) over (partition by k order by pos rows between unbounded preceding and unbounded following) as first_page,
last_value(case when kind = 'h1' then pos end ignore nulls) over u as a1, first_value(case when kind = 'h2' then pos end ignore nulls) over u as f2, last_value(case when kind = 'h2' then pos end ignore nulls) over u as a2 from o window u as (partition by k order by pos rows unbounded preceding)),
pa as (select h.*, list_filter([x.text, y.text], lambda z: z is not null) as path from h left join o x on x.k = h.k and x.pos = coalesce(a1, f2) left join o y on y.k = h.k and y.pos = a2 and a2 > coalesce(a1, f2)),
s as (select k, pos, kind, total, page, first_page, text, pn, case when kind = 'text' then path else coalesce(lag(path) over (partition by k order by pos), []) end as before, path from pa
union all select k, max(pos) + 1, 'end', max(total), arg_max(page, pos), any_value(first_page), null, null, arg_max(path, pos), null from pa group by k),
cut as (select distinct k, 0::bigint as pos, 0::bigint as e from s union all select x.k, x.pos, s.total::bigint from (select c.k, (select min(s.pos) from s where s.k = c.k and s.pos > c.pos and s.total > 0 and (s.kind <> 'text' or s.total - greatest(c.e - 120, 0) >= 800)) as pos from cut c) x join s on s.k = x.k and s.pos = x.pos),
al as (select k, flatten(list(words order by pos)) as words from o where kind = 'text' group by k),
pr as (select cut.k, cut.pos, 0 as side, coalesce(lag(s.page) over z, s.first_page, 1) as page_start, coalesce(s.page, s.first_page, 1) as page_end, 'prose' as chunk_type, s.before as path, greatest(coalesce(lag(cut.e) over z, 0) - 120, 0) as b, cut.e from cut join s on s.k = cut.k and s.pos = cut.pos where cut.pos > 0 window z as (partition by cut.k order by cut.pos)),
c as (select pr.k, pos, side, page_start, page_end, chunk_type, path, array_to_string(al.words[b + 1:e], ' ') as body from pr join al on al.k = pr.k union all select k, pos, 1, pn, pn, kind, path, text from s where kind in ('table', 'spec_table')),
f as (select *, case when len(path) > 0 then array_to_string(path, ' > ') || chr(10) || chr(10) else '' end || body as content from c)
select k as document, (row_number() over (partition by k order by pos, side) - 1)::bigint as chunk_index, page_start::bigint as page_start, page_end::bigint as page_end, chunk_type, array_to_string(path, ' > ') as heading, content, greatest(1, len([x for x in regexp_split_to_array(content, '\\s+') if x <> '']))::bigint as token_count from f"""


@query(CHUNKS)
def chunk_documents(spark, d):
    """Chunks rebuilt from all parsed pages."""
    c = chunking.chunk_documents(table(spark, d, "document_pages"))
    document = F.coalesce(F.concat(F.lit("v"), F.col("document_version_id").cast("string")), F.concat(F.lit("p"), F.col("page_id").cast("string")))
    n = lambda x: F.col(x).cast("bigint").alias(x)
    return c.select(document.alias("document"), n("chunk_index"), n("page_start"), n("page_end"), "chunk_type", F.array_join("heading_path", " > ").alias("heading"), "content", n("token_count"))


@query("""with w as (select page_id, line.top as top, line.avg_font_size as size, line.text as text, position from (select page_id, generate_subscripts(page_lines, 1) as position, unnest(page_lines) as line from document_pages)),
g as (select *, case when top - lag(top) over (partition by page_id order by top, position) > 2.0 then 1 else 0 end as gap from w), n as (select *, sum(gap) over (partition by page_id order by top, position rows unbounded preceding) as line from g)
select page_id, line::bigint as line, string_agg(text, ' ' order by position) as text, min(top) as top, (list(size order by size))[count(size) // 2 + 1] as median_size from n group by 1, 2""")
def line_groups(spark, d):
    """Positioned texts grouped to lines by their vertical gaps, with the upper median of their sizes."""
    w = table(spark, d, "document_pages").select("page_id", F.posexplode("page_lines").alias("left", "x")).select("page_id", F.col("left").cast("double").alias("left"), "x.text", "x.top", F.col("x.avg_font_size").alias("size"))
    return chunking.group_lines(w, ["page_id"]).select("page_id", "line", "text", "top", "median_size")


@query(LATEST)
def stream_latest(spark, d):
    """The latest value of each key by a stream over all files there, run to its end."""
    s = latest.file_stream(spark, d, "events.parquet").select("user_id", "event_type", "event_id", "ts", "value")
    return latest.run_available(latest.latest_values(s, ["user_id", "event_type"], ["ts", "event_id"]), "stream_latest").drop("ts")


@query("""with d as (select doc_id, source, text, sha256(text) as sha, 'https://plafond.example/' || coalesce(doc_kind, 'none') || '/' || doc_id as url from documents), k as (select sha, min(doc_id) as first from d group by 1)
select doc_id as page_id, case when split_part(substr(url, 25), '/', 1) not in ('datasheet', 'brochure', 'webpage') then 'no product page' when length(coalesce(text, '')) < 200 then 'too little text' when doc_id <> k.first then 'unchanged' end as skip_reason from d left join k using (sha)""")
def page_skip_reasons(spark, d):
    """Why a page is not extracted; a text seen under an earlier id is unchanged."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text", F.sha2("text", 256).alias("sha256"), F.concat(F.lit("https://plafond.example/"), F.coalesce("doc_kind", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string")).alias("url"))
    first = docs.groupBy("sha256").agg(F.min("page_id").alias("first"))
    again = docs.join(first, "sha256").withColumn("sha256", F.when(F.col("page_id") == F.col("first"), F.concat("sha256", F.lit("-first"))).otherwise(F.col("sha256")))
    return web.skip_reasons(again, "https://plafond.example/", ["datasheet", "brochure", "webpage"], first.select("sha256"))


BLANK = "\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


@query(f"""with l as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') as lines, title from documents)
select doc_id as page_id, nullif(array_to_string([w for w in regexp_split_to_array({strip_sql("coalesce(title, '')")}, '[{BLANK}]+') if w <> ''], ' '), '') as title, len(lines)::bigint as lines, 1::bigint as tables, length(array_to_string(lines, chr(10)))::bigint as characters, doc_id || '|' || len(lines) as cells from l""")
def parsed_pages(spark, d):
    """Lines and tables of all documents, set as pages of paragraphs with a table, by the HTML parser."""
    from citebase.sources.files import parse_pages

    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    docs = table(spark, d, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), safe(x), F.lit("</p>"))), "")
    cells = lambda a, b: F.concat(F.lit("<tr><td>"), a, F.lit("</td><td> "), b, F.lit("</td></tr>"))
    n = F.size(F.filter(lines, lambda x: ~x.rlike(f"^[{BLANK}]*$")))
    html = F.concat(F.lit("<html><head><title>"), safe(F.coalesce("title", F.lit(""))), F.lit("</title></head><body><nav><p>menu</p></nav>"), body, F.lit("<table><tr></tr>"), cells(F.col("doc_id").cast("string"), n.cast("string")), F.lit("</table><footer>foot</footer></body></html>"))
    p = parse_pages(docs.select(F.col("doc_id").alias("page_id"), html.alias("html")))
    rows = F.flatten(F.col("page.page_tables")[0]["rows"])
    return p.select("page_id", "page.title", F.size("page.page_lines").cast("bigint").alias("lines"), F.size("page.page_tables").cast("bigint").alias("tables"), F.length("page.text").cast("bigint").alias("characters"), F.array_join(rows, "|").alias("cells"))
