"""Queries of queues, runs, review, structured pages, repaired values, indexes and the built-in join and window forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from citebase.functions import parsing
from citebase.functions.text import normalize_full, slug, words
from citebase.functions.web import visible_text
from citebase.operators import ann, audit, chunking, facts, jobs, relational, retrieval, security, web
from citebase.plans.audits import JUDGED, judged
from citebase.plans.registry import NORMAL, SLUG, WORDS, query
from citebase.session import table

NOW = "2024-01-20 12:00:00"


def now():
    return F.to_timestamp(F.lit(NOW))


JOBS = "j as (select event_id as id, event_type as kind, case when value < 40 then 'pending' else 'running' end as status, (user_id % 5)::int as priority, (event_id % 7)::int as attempts, 3 as max_attempts, ts as run_after from events)"


def queue(spark, d):
    """Events as jobs: pending below a value, else running."""
    e = table(spark, d, "events")
    none = lambda t: F.lit(None).cast(t)
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.when(F.col("value") < 40, "pending").otherwise("running").alias("status"), (F.col("user_id") % 5).cast("int").alias("priority"), (F.col("event_id") % 7).cast("int").alias("attempts"),
        F.lit(3).alias("max_attempts"), F.col("ts").cast("timestamp").alias("run_after"), none("timestamp").alias("locked_at"), none("string").alias("locked_by"), none("string").alias("last_error"),
    )


@query(f"with {JOBS}, c as (select id from j where status = 'pending' and run_after <= timestamp '{NOW}' and kind in ('error', 'purchase') order by priority, run_after, id limit 25) select id, case when id in (select id from c) then 'running' else status end as status, attempts + (id in (select id from c))::int as attempts, case when id in (select id from c) then 'w1' end as locked_by from j")
def job_claim(spark, d):
    """All jobs after a worker has claimed the first 25 due ones of two kinds."""
    return jobs.claim(queue(spark, d), now(), "w1", ["error", "purchase"], 25).select("id", "status", "attempts", "locked_by")


FINISHED = f"""with {JOBS} select id, case when status = 'pending' then status when id % 3 = 0 then 'succeeded' when attempts >= 3 then 'dead' else 'pending' end as status, case when status <> 'pending' and id % 3 <> 0 then 'broken' end as last_error,
strftime(case when status <> 'pending' and id % 3 <> 0 then timestamp '{NOW}' + to_seconds(least(attempts, 5) * 30) else run_after end, '%Y-%m-%d %H:%M:%S') as run_after from j"""


def finished(spark, d):
    """Results of the running jobs: every third went well."""
    all_ = queue(spark, d)
    results = all_.where("status = 'running'").select("id", F.when(F.col("id") % 3 != 0, "broken").alias("error"))
    return jobs.finish(all_, results, now())


@query(FINISHED)
def job_retry(spark, d):
    """Running jobs after their results: done, waiting for another try, or dead."""
    return finished(spark, d).select("id", "status", "last_error", F.date_format("run_after", "yyyy-MM-dd HH:mm:ss").alias("run_after"))


@query(f"with r as ({FINISHED}), k as (select event_id as id, event_type as kind, (event_id % 7)::int as attempts from events) select id, kind, attempts, last_error from r join k using (id) where status = 'dead'")
def dead_letters(spark, d):
    return jobs.dead_letters(finished(spark, d))


@query("""with r as (select event_id as request_id, case when event_id % 10 = 0 then 'none' else 'xr-00-' || lpad((event_id % 20 + 1)::varchar, 6, '0') end as run_id, 'bouwshop-' || lpad((user_id % 20 + 1)::varchar, 2, '0') as brand_id from events)
select request_id, case when x.run_id is null then 'no such run' when x.seller <> r.brand_id then 'another brand''s run' end as problem from r left join extraction_runs x on x.run_id = r.run_id""")
def run_guard(spark, d):
    """Whether requested runs exist and are of the brand they are asked for."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    e = table(spark, d, "events")
    asked = e.select(F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 10 == 0, "none").otherwise(F.concat(F.lit("xr-00-"), pad(F.col("event_id") % 20 + 1, 6))).alias("run_id"), F.concat(F.lit("bouwshop-"), pad(F.col("user_id") % 20 + 1, 2)).alias("brand_id"))
    return jobs.run_guard(asked, table(spark, d, "extraction_runs").select("run_id", F.col("seller").alias("brand_id")))


@query("""with r as (select distinct run_id, 40::bigint as expected from visibility_answers), g as (select run_id, count(*) as answered from visibility_answers where response_text is not null group by 1)
select run_id, expected, coalesce(answered, 0)::bigint as answered, least(greatest(expected - coalesce(answered, 0), 0), 25)::bigint as next, case when coalesce(answered, 0) >= expected then 'succeeded' else 'running' end as status from r left join g using (run_id)""")
def run_progress(spark, d):
    """What each run still has to ask, up to a ceiling, and whether it is done."""
    a = table(spark, d, "visibility_answers").select("run_id", "response_text")
    return jobs.run_plan(a.select("run_id").distinct().withColumn("expected", F.lit(40).cast("bigint")), a.where("response_text is not null").select("run_id"), 25)


@query("select answer_id, so_far from (select answer_id, sum(coalesce(cost_usd, 0)) over (partition by run_id order by answer_id)::double as so_far from visibility_answers) where so_far <= 0.25")
def cost_ceiling(spark, d):
    """The answers of each run up to which its costs stay within a ceiling."""
    a = table(spark, d, "visibility_answers").select("answer_id", "run_id", "cost_usd")
    return relational.within_ceiling(a, ["run_id"], ["answer_id"], F.col("cost_usd"), 0.25, slices=F.floor(F.col("answer_id") / 10_000)).select("answer_id", F.col("so_far").cast("double").alias("so_far"))


@query(f"""with f as (select c.answer_claim_id, c.spec_key, c.source_quote, a.response_text from answer_claims c left join visibility_answers a using (answer_id) where c.spec_key not in (select spec_key from spec_attributes))
select answer_claim_id as finding_id, case when not (source_quote <> '' and coalesce(contains({NORMAL.format("response_text")}, {NORMAL.format("source_quote")}), false)) then 'rejected'
when answer_claim_id % 3 = 0 then 'new' when answer_claim_id % 3 = 1 then 'dismissed' when answer_claim_id % 2 = 0 then 'promoted' else 'unknown key' end as state from f""")
def review_queue(spark, d):
    """Claims with an unknown key as findings: what is quoted, promoted to a key, or dismissed."""
    keys = table(spark, d, "spec_attributes").select("spec_key")
    f = table(spark, d, "answer_claims").where("spec_key is not null").join(keys, "spec_key", "left_anti").select(F.col("answer_claim_id").alias("finding_id"), F.col("answer_id").alias("page_id"), F.col("source_quote").alias("source_snippet"))
    pages = table(spark, d, "visibility_answers").select(F.col("answer_id").alias("page_id"), F.col("response_text").alias("page_text"))
    i = F.col("finding_id")
    decisions = f.where(i % 3 != 0).select("finding_id", F.when(i % 3 == 2, F.when(i % 2 == 0, "density").otherwise("no key")).alias("spec_key"))
    return jobs.review(f, pages, decisions, keys)


@query("""with r as (select page_id, case when coalesce(text, '') = '' then 'no text' when len(coalesce(page_tables, [])) > 2 then 'too many tables' end as error from document_pages) select error, count(*)::bigint as items, min(page_id) as first from r group by 1""")
def reextract_summary(spark, d):
    """A batch over all pages whose failures do not end it, summed up."""

    def work(page: dict) -> list[dict]:
        if not page["text"]:
            raise ValueError("no text")
        if page["tables"] > 2:
            raise RuntimeError("too many tables")
        return [{"length": len(page["text"])}]

    pages = table(spark, d, "document_pages").select("page_id", "text", F.greatest(F.size(F.coalesce("page_tables", F.array())), F.lit(0)).alias("tables"))
    return jobs.failure_summary(jobs.apply_each(pages, work, "page_id", "length int"), "page_id")


def marked_pages(spark, d):
    """Documents as pages with structured data of several forms, by their id."""
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    k = F.col("doc_id") % 7
    mark = (
        F.when(k == 0, script(F.lit('{"@type": "Product", "name": "x"}')))
        .when(k == 1, script(F.lit('{"@context": "c", "@graph": [{"@type": "WebPage"}, {"@type": ["Thing", "Product"]}]}')))
        .when(k == 2, script(F.lit('{"@type": "Product", broken')))
        .when(k == 3, F.lit('<div itemscope itemtype="https://schema.org/Product"></div>'))
        .when(k == 4, script(F.lit('{"@type": "Organization", "name": "Product"}')))
        .otherwise("")
    )
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.concat(F.lit("<html><body>"), mark, F.coalesce("text", F.lit("")), F.lit("</body></html>")).alias("html"))


@query("select doc_id, doc_id % 7 in (0, 1, 3) or regexp_matches(coalesce(text, ''), '(?i)<[^>]*\\sitemtype\\s*=[^>]*schema\\.org/Product\\b') as structured from documents")
def structured_data(spark, d):
    return marked_pages(spark, d).select("doc_id", web.structured_product(F.col("html")).alias("structured"))


@query("""with v as (select answer_id, trim(regexp_replace(regexp_replace(regexp_replace(response_text, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as t from visibility_answers),
c as (select c.answer_id, case when value_text is not null then contains(lower(t), lower(value_text)) end as found from answer_claims c left join v using (answer_id) where value_numeric is null)
select answer_id as page_id, count(*) filter (found)::bigint as found, count(*) filter (not found)::bigint as missing, count(*) filter (found is null)::bigint as unchecked, answer_id % 7 in (0, 1, 3) as structured from c group by 1""")
def page_visibility_stats(spark, d):
    """Claims in words or flags of each answer: how many stand in its text, and whether the page is marked up."""
    a = table(spark, d, "visibility_answers").select("answer_id", visible_text(F.col("response_text")).alias("visible"))
    c = table(spark, d, "answer_claims").where("value_numeric is null").select("answer_id", "value_numeric", "value_text", "value_bool", F.lit("stated").alias("presence")).join(a, "answer_id", "left")
    c = c.withColumnRenamed("answer_id", "page_id").withColumn("structured", (F.col("page_id") % 7).isin(0, 1, 3))
    return web.page_visibility(c)


#: What NFKC makes of the characters that the answers hold, and case folding of ß.
FULL = "trim(replace(lower(regexp_replace(replace(replace(replace(replace(replace(translate({0}, '‑–—²³₂µ' || chr(160) || chr(8239), '---232μ  '), '″', '′′'), '™', 'TM'), '…', '...'), '℃', '°C'), '℉', '°F'), '\\s+', ' ', 'g')), 'ß', 'ss'))"


@query(f"""select answer_claim_id, coalesce(contains({FULL.format("a.response_text")}, {FULL.format("c.source_quote")}), false) as verbatim from answer_claims c left join visibility_answers a using (answer_id)""")
def snippet_verify_full(spark, d):
    """Whether each quote stands in its answer, both in compatibility form and case-folded; each answer is brought there once."""
    a = table(spark, d, "visibility_answers").select("answer_id", normalize_full(F.col("response_text")).alias("page"))
    c = table(spark, d, "answer_claims").select("answer_claim_id", "answer_id", normalize_full(F.col("source_quote")).alias("quote"))
    return c.join(a, "answer_id", "left").select("answer_claim_id", F.coalesce(F.contains("page", F.col("quote")), F.lit(False)).alias("verbatim"))


@query("select event_id, case when event_id % 4 = 3 then null else cast(props::json->>'k' as bigint) end as k, case when event_id % 4 = 3 then null else 2 end::bigint as n from events")
def json_repair(spark, d):
    """Arrays that came bare, encoded twice or in their wrapper."""
    e = table(spark, d, "events")
    bare = F.concat(F.lit("["), "props", F.lit(',{"k":0}]'))
    twice = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    k = F.col("event_id") % 4
    given = F.when(k == 0, bare).when(k == 1, twice(bare)).when(k == 2, twice(F.concat(F.lit('{"items":'), bare, F.lit("}")))).otherwise("nothing")
    got = parsing.json_array(given, "struct<k:bigint>", "items")
    return e.select("event_id", got[0]["k"].alias("k"), F.when(got.isNotNull(), F.size(got)).cast("bigint").alias("n"))


@query("select doc_id, case doc_id % 4 when 3 then null when 0 then strftime(date_trunc('day', retrieved_at::timestamp), '%Y-%m-%d %H:%M:%S') when 2 then strftime(date_trunc('second', retrieved_at::timestamp) - interval 2 hours, '%Y-%m-%d %H:%M:%S') else strftime(date_trunc('second', retrieved_at::timestamp), '%Y-%m-%d %H:%M:%S') end as at from documents")
def iso_timestamps(spark, d):
    """Times written as dates, in UTC, with an offset and wrongly."""
    k, at = F.col("doc_id") % 4, F.col("retrieved_at")
    text = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0200"))).otherwise(F.date_format(at, "dd/MM/yyyy"))
    return table(spark, d, "documents").select("doc_id", F.date_format(parsing.iso_time(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("select listing_id, coalesce(nullif(replace(replace(replace(product_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ''), '-') as name, coalesce(nullif(replace(replace(replace(spec_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ''), '-') as spec from product_listings")
def report_cells(spark, d):
    """Texts as they stand in a report's markup."""
    return table(spark, d, "product_listings").select("listing_id", parsing.xml_escape(F.col("product_name")).alias("name"), parsing.xml_escape(F.col("spec_text")).alias("spec"))


@query(f"with w as (select doc_id, {WORDS.format('text')} as w from documents) select doc_id, array_to_string([i for i in range(1, len(w) + 1) if w[i] = 'plafond'], ',') as positions, array_to_string(w[greatest(len(w) - 4, 1):], ' ') as tail from w where list_contains(w, 'plafond')")
def term_positions(spark, d):
    """Where a word stands in each text that holds it, and the text's last five words."""
    t = table(spark, d, "documents").select("doc_id", words(F.col("text")).alias("w")).where(F.array_contains("w", "plafond"))
    return t.select("doc_id", F.array_join(F.transform(parsing.positions(F.col("w"), "plafond"), lambda i: i.cast("string")), ",").alias("positions"), parsing.tail_tokens(F.array_join("w", " "), 5).alias("tail"))


@query("""with t as (select page_id, generate_subscripts(page_tables, 1) - 1 as i, unnest(page_tables) as t from document_pages), f as (select page_id, i, ' ' || array_to_string(list_transform(flatten(list_transform(t.rows, lambda r: coalesce(r, []))), lambda c: coalesce(c, '')), ' ') || ' ' as x from t)
select page_id, i::bigint as table_index, case when regexp_matches(x, '(?i)[^\\pL\\pN_](?:mm|db|kg|kg/m2|kg/m3|w/mk|m2k/w|w/m2k|ei[0-9]+|s[0-9]+|kpa|eur)[^\\pL\\pN_]') or regexp_matches(x, '(?i)[\\pL\\pN_](?:°C[^\\pL\\pN_]|%[\\pL\\pN_])') then 'spec_table' else 'table' end as kind from f""")
def table_types(spark, d):
    """Tables of specifications, told by their units and classes."""
    t = table(spark, d, "document_pages").select("page_id", F.posexplode("page_tables").alias("table_index", "t"))
    return t.select("page_id", F.col("table_index").cast("bigint").alias("table_index"), chunking.table_type(F.col("t.rows")).alias("kind"))


@query("select l_returnflag, count(distinct l_partkey)::bigint as parts, true as near, count(distinct l_orderkey)::bigint as orders from lineitem group by 1")
def approximate_counts(spark, d):
    """Distinct counts by sketches, held against the exact ones: within a tenth."""
    line = table(spark, d, "lineitem")
    exact = lambda c, name: line.select("l_returnflag", c).distinct().groupBy("l_returnflag").agg(F.count(c).alias(name))
    sketched = line.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("p"), F.approx_count_distinct("l_orderkey", 0.02).alias("o"))
    g = sketched.join(exact("l_partkey", "parts"), "l_returnflag").join(exact("l_orderkey", "orders"), "l_returnflag")
    within = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.1 * F.col(b)
    return g.select("l_returnflag", "parts", (within("p", "parts") & within("o", "orders")).alias("near"), "orders")


@query("""select c_custkey, rank() over w::bigint as rank, dense_rank() over w::bigint as dense, ntile(4) over (partition by c_nationkey order by c_acctbal, c_custkey)::bigint as quarter, count(*) over (partition by c_nationkey order by c_acctbal range between 500 preceding and 500 following)::bigint as near,
first_value(c_custkey) over (partition by c_nationkey order by c_acctbal desc, c_custkey) as richest from customer window w as (partition by c_nationkey order by c_mktsegment)""")
def window_ranks(spark, d):
    """Ranks with and without gaps, quarters, a range frame and a first value."""
    from pyspark.sql import Window

    by = Window.partitionBy("c_nationkey")
    w, value = by.orderBy("c_mktsegment"), by.orderBy("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", F.rank().over(w).cast("bigint").alias("rank"), F.dense_rank().over(w).cast("bigint").alias("dense"), F.ntile(4).over(by.orderBy("c_acctbal", "c_custkey")).cast("bigint").alias("quarter"),
        F.count("*").over(value.rangeBetween(-500, 500)).alias("near"), F.first("c_custkey").over(by.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("richest"),
    )


@query("select n_name, c.c_custkey, c.c_acctbal from nation n, lateral (select c_custkey, c_acctbal from customer where c_nationkey = n.n_nationkey order by c_acctbal desc, c_custkey limit 3) c")
def lateral_top(spark, d):
    """The three richest customers of each nation, by a lateral join."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    top = c.where(F.col("c_nationkey") == F.col("n_nationkey").outer()).orderBy(F.desc("c_acctbal"), "c_custkey").limit(3).select("c_custkey", "c_acctbal")
    return n.lateralJoin(top).select("n_name", "c_custkey", "c_acctbal")


@query("""with u as (select distinct unnest(citations) as url from visibility_answers), r as (select url, 'https://www.resolved.example/' || length(url) as target from u where length(url) % 2 = 0), e as (select answer_id, unnest(citations) as url from visibility_answers),
h as (select answer_id, coalesce(target, e.url) as url from e left join r on r.url = e.url) select regexp_replace(coalesce(nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), ''), 'unknown'), '^www\\.', '') as domain, count(*)::bigint as citations, count(distinct answer_id)::bigint as answers from h group by 1""")
def citation_domains_resolved(spark, d):
    """Cited domains after redirects are looked up."""
    a = table(spark, d, "visibility_answers")
    resolved = a.select(F.explode("citations").alias("url")).distinct().where(F.length("url") % 2 == 0).select("url", F.concat(F.lit("https://www.resolved.example/"), F.length("url").cast("string")).alias("target"))
    return audit.citation_domains(a, resolved)


@query(f"select product_id, product_name from products where {SLUG.format('brand_name || chr(32) || product_name')} = (select {SLUG.format('brand_name || chr(32) || product_name')} from products order by product_id limit 1)")
def product_by_slug(spark, d):
    """Look-up of one product by its slug."""
    p = table(spark, d, "products")
    name = slug(F.col("brand_name"), F.col("product_name"))
    wanted = p.orderBy("product_id").limit(1).select(name.alias("wanted"))
    return p.withColumn("wanted", name).join(wanted, "wanted", "left_semi").select("product_id", "product_name")


@query("with recursive r(id, hop) as (select 1::bigint, 0::bigint union all select d.doc_id, hop + 1 from r join documents d on d.doc_id in (2 * r.id, 2 * r.id + 1)) select 'https://site.example/docs' || case when id = 1 then '' else '/p/' || id end as url, hop from r")
def crawl_site(spark, d):
    """A crawl to its end over documents that link to two others each by relative links, and out of the site."""
    i = F.col("doc_id")
    url = F.when(i == 1, "https://site.example/docs").otherwise(F.concat(F.lit("https://site.example/docs/p/"), i.cast("string")))
    here = F.when(i == 1, "docs/p/./").otherwise("x/y/../../")
    link = lambda k: F.concat(F.lit("<a class=k href='"), here, (2 * i + k).cast("string"), F.lit("?from=x#top'>next</a>"))
    html = F.concat(link(0), F.coalesce("title", F.lit("")), link(1), F.lit('<a href="/other/2">out</a><a href="../../docs/p/brochure.PDF">file</a><a href="mailto:x@y.example">mail</a>'))
    return web.crawl(table(spark, d, "documents").select(i.alias("page_id"), url.alias("url"), html.alias("html")), "https://site.example/docs")


TREE = "t(code, parent) as (values ('plafond', null), ('mineraal', 'plafond'), ('minerale_wol', 'mineraal'), ('glaswol', 'mineraal'), ('metaal', 'plafond'), ('hout', 'plafond'), ('gips', 'mineraal'), ('pes_vilt', 'plafond'))"
TREE_ROWS = [("plafond", None), ("mineraal", "plafond"), ("minerale_wol", "mineraal"), ("glaswol", "mineraal"), ("metaal", "plafond"), ("hout", "plafond"), ("gips", "mineraal"), ("pes_vilt", "plafond")]


@query(f"""with recursive {TREE}, up(code, above) as (select code, code from t union all select up.code, t.parent from up join t on t.code = up.above where t.parent is not null),
a(spec_key, codes) as (values ('density', ['mineraal']), ('thickness_mm', []::varchar[]), ('perforation_percentage', ['metaal', 'hout']), ('weight_per_m2', ['plafond'])),
x as (select distinct p.product_id, a.spec_key from products p join a on len(a.codes) = 0 or exists (select 1 from up where up.code = p.category_code and list_contains(a.codes, up.above))),
f as (select distinct product_id, spec_key from answer_claims join products using (product_name))
select p.product_id, coalesce(string_agg(x.spec_key, ',' order by x.spec_key) filter (f.spec_key is not null), '') as stated, coalesce(string_agg(x.spec_key, ',' order by x.spec_key) filter (x.spec_key is not null and f.spec_key is null), '') as missing
from products p left join x using (product_id) left join f on f.product_id = x.product_id and f.spec_key = x.spec_key group by 1""")
def coverage_by_tree(spark, d):
    """Attributes that apply to a product's category or to one above it, and whether a fact states them."""
    tree = spark.createDataFrame(TREE_ROWS, "id string, parent_id string").withColumn("code", F.col("id"))
    rules = spark.createDataFrame([("density", ["mineraal"]), ("thickness_mm", []), ("perforation_percentage", ["metaal", "hout"]), ("weight_per_m2", ["plafond"])], "spec_key string, category_codes array<string>")
    p = table(spark, d, "products").select("product_id", "product_name", "category_code")
    stated = table(spark, d, "answer_claims").select("product_name", "spec_key").join(p, "product_name").select("product_id", "spec_key", F.lit("stated").alias("presence"))
    got = audit.coverage(p.drop("product_name"), rules, stated, tree=tree)
    return got.select("product_id", F.array_join("stated", ",").alias("stated"), F.array_join("missing", ",").alias("missing"))


@query("""with w as (select c.answer_claim_id, c.product_name, c.spec_key, c.answer_id, c.created_at, a.engine, p.intent from answer_claims c join visibility_answers a using (answer_id) left join prompts p using (prompt_id) where not coalesce(c.is_competitor, false) and c.value_numeric > 100 order by c.created_at, c.answer_claim_id limit 10),
g as (select product_name, spec_key, arg_min(chunk_id, chunk_id) as chunk_id from answer_claims join document_chunks on chunk_id = answer_claim_id group by 1, 2)
select w.answer_claim_id, w.engine, w.intent, g.chunk_id, k.page_start from w left join g using (product_name, spec_key) left join document_chunks k on k.chunk_id = g.chunk_id""")
def worst_findings_cited(spark, d):
    """The worst findings with the place in the documents that proves them wrong, where one is known."""
    c = table(spark, d, "answer_claims").select("answer_claim_id", "product_name", "spec_key", "answer_id", "created_at", "is_competitor", "value_numeric")
    judged = c.withColumn("verdict", F.when(F.col("value_numeric") > 100, "incorrect").otherwise("correct")).withColumnRenamed("answer_claim_id", "claim_id")
    chunks = table(spark, d, "document_chunks").select("chunk_id", "page_start")
    truth = c.select("product_name", "spec_key", F.col("answer_claim_id").alias("chunk_id")).join(chunks, "chunk_id").groupBy("product_name", "spec_key").agg(F.min("chunk_id").alias("chunk_id"))
    cited = truth.join(chunks, "chunk_id")
    answers = table(spark, d, "visibility_answers").select("answer_id", "prompt_id", "engine").join(table(spark, d, "prompts").select("prompt_id", "intent"), "prompt_id", "left")
    top = audit.worst_findings(judged.where(~F.coalesce("is_competitor", F.lit(False))).join(answers, "answer_id"), truth=cited, on=["product_name", "spec_key"])
    return top.select(F.col("claim_id").alias("answer_claim_id"), "engine", "intent", "chunk_id", "page_start")


@query("""with pub as (select distinct l_partkey from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'F'), mine as (select distinct l_partkey from lineitem join supplier on s_suppkey = l_suppkey where s_nationkey = 3) select p_partkey from part where p_partkey in (select l_partkey from pub) or p_partkey in (select l_partkey from mine)""")
def secured_documents(spark, d):
    """Parts as documents: readable if they back a finished order or a supplier of the reader's nation delivers them."""
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("document_id"), "l_orderkey", "l_suppkey")
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    backed = line.join(done, "l_orderkey", "left_semi").select("document_id")
    owners = line.select("document_id", F.col("l_suppkey").alias("owner"))
    members = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("principal"), F.col("s_suppkey").alias("owner"))
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("document_id"))
    return security.readable_documents(docs, backed, owners, members, "3").select(F.col("document_id").alias("p_partkey"))


@query("select l.listing_id, sha256('[' || case when brand_name is null then '\"?\"' else '\"=' || brand_name || '\"' end || ',\"=' || seller || '\"]') as id from product_listings l where not regexp_matches(coalesce(brand_name, ''), '[\"\\\\]')")
def inserted_ids(spark, d):
    """The ids that an insert gives back, made of the key."""
    p = table(spark, d, "product_listings").select("listing_id", "brand_name", "seller").where(~F.coalesce("brand_name", F.lit("")).rlike(r'["\\]'))
    return relational.with_id(p, ["brand_name", "seller"]).select("listing_id", "id")


@query("""with u as (select run_id, case when claims_inserted > 0 then 'parsed' else 'failed' end as status, nullif(claims_rejected, 0) as n from extraction_runs where seller < 'bouwshop-15') select r.run_id, coalesce(u.status, r.status) as status, coalesce(u.n, r.claims_inserted)::bigint as claims_inserted,
case when u.status = 'parsed' then '2024-01-20 12:00:00' else strftime(r.finished_at::timestamp, '%Y-%m-%d %H:%M:%S') end as finished_at from extraction_runs r left join u using (run_id)""")
def status_stamps(spark, d):
    """Status updates that keep old values where there is no new one and stamp the time of one status."""
    r = table(spark, d, "extraction_runs").select("run_id", "seller", "status", "claims_inserted", "claims_rejected", "finished_at")
    u = r.where("seller < 'bouwshop-15'").select("run_id", F.when(F.col("claims_inserted") > 0, "parsed").otherwise("failed").alias("status"), F.nullif("claims_rejected", F.lit(0)).alias("claims_inserted"))
    out = relational.status_update(r, u, "run_id", now(), {"finished_at": "parsed"}, ["claims_inserted"])
    return out.select("run_id", "status", F.col("claims_inserted").cast("bigint").alias("claims_inserted"), F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"))


@query("""with e as (select event_id, user_id, event_type, value from events where event_id % 2 = 0), n as (select event_id, user_id, event_type, value from events where event_id % 2 = 1), k as (select distinct user_id, event_type from n)
select event_id, value from e where not exists (select 1 from k where k.user_id = e.user_id and k.event_type = e.event_type) union all select event_id, value from n""")
def upsert_rows(spark, d):
    """Existing rows with the new ones in their place by key."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return relational.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"]).select("event_id", "value")


@query("select query_id, 10::bigint as wanted, true as reached from (select count(*) as query_id from embeddings where vec_id % 50 = 0)")
def vector_index_recall(spark, d):
    """Whether the index finds nine tenths of the ten nearest rows of every fiftieth vector, by brute force."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 50 = 0")
    exact = retrieval.nearest_to_each(v, asked, 10).select("query_id", "id", F.lit(1).alias("hit"))
    found = vector_index_search(spark, d).select("query_id", "id", F.lit(1).alias("got"))
    both = exact.join(found, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("query_id"), F.sum("hit").alias("n"), F.sum("got").alias("got"))
    return both.select("query_id", (F.col("n") / F.col("query_id")).cast("bigint").alias("wanted"), (F.col("got") >= 0.9 * F.col("n")).alias("reached"))


@query()
def vector_index_search(spark, d):
    """About the ten nearest rows of every fiftieth vector, by the index over all rows."""
    v = table(spark, d, "embeddings")
    cells = ann.fit_cells(v)
    return ann.search(ann.build_index(v, cells), cells, v.where("vec_id % 50 = 0"), 10)


PERSIST = f"""with c as (select c.answer_claim_id, c.product_name, c.spec_key, c.created_at, c.value_numeric, c.value_text, c.value_bool, c.value_enum from answer_claims c join spec_attributes s using (spec_key) join visibility_answers a using (answer_id)
where c.source_quote <> '' and contains({NORMAL.format("a.response_text")}, {NORMAL.format("c.source_quote")})),
n as (select *, row_number() over w as rn, lag((value_numeric, value_text, value_bool, value_enum)) over w is distinct from (value_numeric, value_text, value_bool, value_enum) as changed from c window w as (partition by product_name, spec_key order by created_at, answer_claim_id))
select case when rn = 1 then 'insert' when changed then 'supersede' else 'no-op' end as action, count(*)::bigint as n from n group by 1"""


@query(PERSIST)
def persist_facts(spark, d):
    """Claims with a known key and a quote that stands in its answer, written to the store in order: what becomes of them."""
    c = table(spark, d, "answer_claims").select("answer_claim_id", "answer_id", "product_name", "spec_key", "created_at", "source_quote", "value_numeric", "value_text", "value_bool", "value_enum")
    a = table(spark, d, "visibility_answers").select("answer_id", F.col("response_text").alias("page_text"))
    stored = facts.store_claims(c.join(a, "answer_id"), table(spark, d, "spec_attributes").select("spec_key"), ["product_name", "spec_key"], ["created_at", "answer_claim_id"], "answer_claim_id", ["value_numeric", "value_text", "value_bool", "value_enum"], slices=F.date_trunc("month", F.col("created_at")))
    return stored.groupBy("action").agg(F.count("*").alias("n"))


@query("""with s as (select status, run_id from extraction_runs), r as (select coalesce(status, '-') as title, string_agg('<li>{"run_id":"' || run_id || '"}</li>', '' order by run_id) as rows from s where status is not null group by 1)
select 'runs' as report_id, '<html><body>' || string_agg('<h2>' || title || '</h2><ul>' || rows || '</ul>', '' order by title) || '</body></html>' as html from r""")
def report_html(spark, d):
    """Runs by their status as one page."""
    from citebase.sources.sinks import render_html, report_sections

    r = table(spark, d, "extraction_runs").select("run_id", "status")
    states = sorted(x.status for x in r.select("status").where("status is not null").distinct().collect())  # a fixed set of states
    return render_html(report_sections("runs", [(s, r.where(F.col("status") == s).select("run_id")) for s in states]))


@query("""select page_id, array_to_string(list_filter(flatten(list_transform(coalesce(page_tables, []), lambda t: list_transform(t.rows, lambda r: array_to_string(list_filter(coalesce(r, []), lambda c: trim(c) <> ''), ' | ')))), lambda x: x <> ''), chr(10)) as text from document_pages""")
def table_row_text(spark, d):
    """The tables of each page as text, row by row."""
    from citebase.sources.files import row_text

    return table(spark, d, "document_pages").select("page_id", row_text(F.col("page_tables")).alias("text"))


@query(f"""with {JUDGED}, g as (select p_type as task from j where not is_competitor and verdict = 'unverifiable_spec'), w as (select p_type as task from j where not is_competitor and verdict in ('incorrect', 'likely_confusion')),
p as (select product_name as task from answer_claims left join visibility_answers using (answer_id) where value_text is not null and value_numeric is null and not contains(lower(trim(regexp_replace(regexp_replace(regexp_replace(response_text, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))), lower(value_text))),
b as (select 1 as branch, task, count(*) as n, 1 as effort from g group by task union all select 2, task, count(*), 2 from p where task is not null group by task union all select 3, task, count(*), 3 from w group by task)
select 0::bigint as branch, 'CCBot, GPTBot' as task, 2::bigint as n, 3::bigint as impact, 1::bigint as effort, 3.0::double as priority union all select branch, task, n, least(3, ceil(n / 2))::bigint, effort, round(least(3, ceil(n / 2)) / effort, 6) from b""")
def remediation_list(spark, d):
    """What to mend first: crawlers shut out, gaps in the documents, values missing on pages, wrong answers."""
    robots = "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nDisallow:"
    crawlers = web.crawlability(spark.createDataFrame([(1, 200, robots, "/")], "file_id int, status_code int, robots_txt string, path string"))
    own = judged(spark, d).where("not is_competitor").withColumnRenamed("p_type", "task")
    a = table(spark, d, "visibility_answers").select("answer_id", visible_text(F.col("response_text")).alias("visible"))
    claims = table(spark, d, "answer_claims").where("value_numeric is null and value_text is not null").select("answer_id", F.col("product_name").alias("task"), "value_numeric", "value_text", "value_bool").join(a, "answer_id", "left")
    return audit.remediation(crawlers, own.where("verdict = 'unverifiable_spec'"), web.value_visible(claims), own.where(F.col("verdict").isin("incorrect", "likely_confusion")))


@query("select strftime(time_bucket(interval 6 hours, ts), '%Y-%m-%d %H:%M') as hour, event_type, count(*)::bigint as n from events group by 1, 2")
def stream_windows(spark, d):
    """Events in windows of six hours, counted by a stream with a watermark."""
    from citebase.streaming import latest

    s = latest.file_stream(spark, d, "events.parquet").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    out = latest.run_available(latest.windowed_counts(s, "at", ["event_type"], "6 hours", "40 days"), "stream_windows")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


@query("select count(*)::bigint as stored, count(distinct (user_id, event_type))::bigint as keys from (select user_id, event_type from events group by 1, 2)")
def stream_once(spark, d):
    """One row for each key by a sink that a stream reaches twice, as after a failure."""
    from citebase.streaming import latest

    folder = latest.shared_folder(spark, "stream_once")
    sink = latest.idempotent_sink(f"{folder}/table", ["user_id", "event_type"])
    for run in range(2):
        s = latest.file_stream(spark, d, "events.parquet").select("user_id", "event_type", "event_id")
        s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/{run}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/table").agg(F.count("*").alias("stored"), F.count_distinct("user_id", "event_type").alias("keys"))


@query("select doc_id, length(text)::double as letters, (length(text) - length(replace(text, ' ', '')))::double as blanks from documents")
def embedded_texts(spark, d):
    """Texts with the vectors of a host's embedder, here one that counts letters and blanks."""
    from citebase.sources.files import embed

    e = embed(table(spark, d, "documents").select("doc_id", "text"), "text", lambda ts: [[float(len(t)), float(t.count(" "))] for t in ts], 2)
    return e.select("doc_id", F.col("embedding")[0].cast("double").alias("letters"), F.col("embedding")[1].cast("double").alias("blanks"))


@query(f"""with t as (select doc_id, {WORDS.format('text')} as w from documents), h as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from t where list_contains(w, 'plafond') and list_contains(w, 'raster')), k as (select doc_id, i, w[i] as x from h where w[i] in ('plafond', 'raster')),
p as (select doc_id, i, x, lag(i) over z as j, lag(x) over z as y from k window z as (partition by doc_id order by i)) select doc_id, round(coalesce(sum(0.1 / (i - j)) filter (x <> y), 0), 9)::double as density from p group by 1""")
def cover_ranks(spark, d):
    """Texts that hold two words, ranked by how closely they stand together."""
    t = table(spark, d, "documents").select("doc_id", words(F.col("text")).alias("w"))
    found = t.where(F.array_contains("w", "plafond") & F.array_contains("w", "raster"))
    return found.select("doc_id", F.round(retrieval.cover_density(F.col("w"), "plafond raster"), 9).alias("density"))
