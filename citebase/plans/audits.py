"""Queries of answer audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citebase.functions.text import preview
from citebase.functions.web import first_segment, host, robots_url
from citebase.operators import audit, relational, security
from citebase.plans.registry import query
from citebase.session import table

NEEDLES = ["Noravell", " Noramardo "]


@query("select doc_id, least(nullif(instr(lower(text), 'noravell'), 0), nullif(instr(lower(text), 'noramardo'), 0)) - 1 as mention_offset from documents")
def mention_detect(spark, d):
    return audit.mentions(table(spark, d, "documents"), NEEDLES, "text").select("doc_id", "mention_offset")


def answers_with_intent(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "visibility_answers").select("answer_id", "prompt_id", *columns).join(table(spark, d, "prompts").select("prompt_id", "intent"), "prompt_id", "left")


RATE = "select case when grouping({g}) = 0 then {g} else 'overall' end as {g}, {hits}::bigint as hits, {total}::bigint as total, round({hits} / nullif({total}, 0), 6) as rate from {src} group by grouping sets (({g}), ())"
PRESENCE = RATE.format(g="intent", hits="count(*) filter (hit)", total="count(*)", src="(select coalesce(intent, 'unknown') as intent, coalesce(contains(lower(response_text), 'noravell') or contains(lower(response_text), 'noramardo'), false) as hit from visibility_answers left join prompts using (prompt_id))")


@query(PRESENCE)
def presence_rate(spark, d):
    return audit.presence_rate(answers_with_intent(spark, d, "response_text"), "intent", NEEDLES)


def claims_with_intent(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "answer_claims").select(F.col("answer_claim_id").alias("claim_id"), "answer_id", "brand_name", "is_competitor")
    return c.join(answers_with_intent(spark, d), "answer_id", "left")


VOICE = RATE.format(
    g="intent",
    hits="count(*) filter (not coalesce(is_competitor, false))",
    total="count(*)",
    src="(select answer_id, coalesce(intent, 'unknown') as intent, lower(trim(brand_name)) as brand, arg_min_null(is_competitor, answer_claim_id) as is_competitor from answer_claims left join (select answer_id, intent from visibility_answers left join prompts using (prompt_id)) using (answer_id) where lower(trim(brand_name)) <> '' group by 1, 2, 3)",
)


@query(VOICE)
def share_of_voice(spark, d):
    return audit.share_of_voice(claims_with_intent(spark, d), "intent")


VERDICT = "case l_returnflag when 'A' then 'correct' when 'R' then case when l_linenumber % 3 = 0 then 'likely_confusion' else 'incorrect' end else 'unverifiable_spec' end"


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Line items as judged claims: the part's brand as the brand, the order as the answer."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    verdict = F.when(F.col("l_returnflag") == "A", "correct").when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") % 3 == 0, "likely_confusion").otherwise("incorrect")).otherwise("unverifiable_spec")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", F.col("p_brand").alias("brand_name"), "p_type")
    claim = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    return line.withColumn("verdict", verdict).join(parts, "l_partkey").select(claim.alias("claim_id"), F.col("l_orderkey").alias("answer_id"), "l_suppkey", "p_name", "brand_name", "p_type", "verdict", (F.col("l_linestatus") == "O").alias("is_competitor"), F.col("l_shipdate").alias("created_at"))


JUDGED = f"j as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int) as claim_id, l_orderkey as answer_id, l_suppkey, p_name, p_brand as brand_name, p_type, {VERDICT} as verdict, l_linestatus = 'O' as is_competitor, l_shipdate as created_at from lineitem join part on p_partkey = l_partkey)"
ACCURACY = RATE.format(g="p_type", hits="count(*) filter (verdict = 'correct')", total="count(*) filter (verdict in ('correct', 'incorrect', 'likely_confusion'))", src="j where not is_competitor")


@query(f"with {JUDGED} {ACCURACY}")
def spec_accuracy(spark, d):
    return audit.spec_accuracy(judged(spark, d), "p_type")


ATTRIBUTE_CODES = {"density": ["minerale_wol", "glaswol"], "perforation_percentage": ["metaal", "hout", "gips"], "formaldehyde_emission": ["hout"], "max_relative_humidity": ["gips", "pes_vilt"]}
COVER = """a as (select spec_key, case spec_key when 'density' then ['minerale_wol', 'glaswol'] when 'perforation_percentage' then ['metaal', 'hout', 'gips'] when 'formaldehyde_emission' then ['hout'] when 'max_relative_humidity' then ['gips', 'pes_vilt'] else []::varchar[] end as codes from spec_attributes where is_filterable),
f as (select distinct product_id, spec_key from answer_claims join products using (product_name)), x as (select p.product_id, p.brand_name, a.spec_key, f.spec_key is not null as said from products p join a on len(codes) = 0 or list_contains(codes, p.category_code) left join f on f.product_id = p.product_id and f.spec_key = a.spec_key),
cov as (select product_id, any_value(brand_name) as brand_name, coalesce(string_agg(spec_key, ',' order by spec_key) filter (said), '') as stated, coalesce(string_agg(spec_key, ',' order by spec_key) filter (not said), '') as missing, count(*) filter (said) as s, count(*) as n from x group by 1)"""


def covered(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "spec_attributes").where("is_filterable").select("spec_key")
    codes = F.lit(None).cast("array<string>")
    for k, v in ATTRIBUTE_CODES.items():
        codes = F.when(F.col("spec_key") == k, F.array(*(F.lit(x) for x in v))).otherwise(codes)
    p = table(spark, d, "products").select("product_id", "product_name", "category_code")
    facts = table(spark, d, "answer_claims").select("product_name", "spec_key").join(p, "product_name").select("product_id", "spec_key", F.lit("stated").alias("presence"))
    return audit.coverage(p.drop("product_name"), s.withColumn("category_codes", F.coalesce(codes, F.array().cast("array<string>"))), facts)


@query(f"with {COVER} select product_id, stated, missing, round(s / n, 6) as completeness from cov")
def coverage_by_product(spark, d):
    return covered(spark, d).select("product_id", F.array_join("stated", ",").alias("stated"), F.array_join("missing", ",").alias("missing"), F.round("completeness", 6).alias("completeness"))


@query(f"with {COVER} select brand_name, sum(s)::bigint as stated, sum(n - s)::bigint as missing, round(sum(s) / sum(n), 6) as completeness from cov group by 1")
def coverage_by_brand(spark, d):
    brands = table(spark, d, "products").select("product_id", "brand_name")
    return audit.overall_completeness(covered(spark, d).join(brands, "product_id"), "brand_name")


@query(f"with {COVER}, m as (select distinct brand_name, spec_key from x where not said) select brand_name, string_agg(spec_key, ', ' order by spec_key) as missing from m group by 1")
def coverage_text(spark, d):
    """Missing attributes of each brand as one line of text: a sorted set, joined."""
    brands = table(spark, d, "products").select("product_id", "brand_name")
    each = covered(spark, d).join(brands, "product_id").select("brand_name", F.explode("missing").alias("spec_key"))
    return each.groupBy("brand_name").agg(F.array_join(F.array_sort(F.collect_set("spec_key")), ", ").alias("missing"))


@query(f"""with {COVER}, {JUDGED}, p as ({PRESENCE}), v as ({VOICE}), acc as ({ACCURACY})
select p.rate as presence, v.rate as share_of_voice, acc.rate as accuracy, (select round(sum(s) / sum(n), 6) from cov) as completeness from p, v, acc where p.intent = 'overall' and v.intent = 'overall' and acc.p_type = 'overall'""")
def scorecard(spark, d):
    """The four overall figures in one row."""
    one = lambda rows, key, name: rows.where(F.col(key) == "overall").select(F.lit(1).alias("_one"), F.col("rate").alias(name))
    c = covered(spark, d).agg(F.sum(F.size("stated")).alias("s"), F.sum(F.size("missing")).alias("m")).select(F.round(F.coalesce(relational.rate(F.col("s"), F.col("s") + F.col("m")), F.lit(0.0)), 6).alias("completeness"), F.lit(1).alias("_one"))
    out = one(presence_rate(spark, d), "intent", "presence").join(one(share_of_voice(spark, d), "intent", "share_of_voice"), "_one")
    return out.join(one(spec_accuracy(spark, d), "p_type", "accuracy"), "_one").join(c, "_one").drop("_one")


@query(f"""with {JUDGED} select claim_id, verdict, p_name, s_name from j left join supplier on s_suppkey = l_suppkey where not is_competitor and verdict in ('incorrect', 'likely_confusion') order by verdict = 'incorrect' desc, created_at, claim_id limit 10""")
def worst_findings(spark, d):
    own = judged(spark, d).where("not is_competitor")
    top = audit.worst_findings(own)
    return top.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left").select("claim_id", "verdict", "p_name", "s_name")


@query(f"""with {JUDGED} select p_type, lower(trim(case when contains(lower(brand_name), 'brand#2') then 'Brand#2' else brand_name end)) as brand_key, count(distinct answer_id)::bigint as mentions, count(*) filter (verdict = 'correct')::bigint as correct,
count(*) filter (verdict = 'incorrect')::bigint as incorrect, count(*) filter (verdict = 'likely_confusion')::bigint as likely_confusion, count(*) filter (verdict like 'unverifiable%')::bigint as unverifiable from j group by 1, 2""")
def competitive_picture(spark, d):
    """Mentions and verdicts by type and brand; spellings that contain the audited brand's name are the audited brand."""
    return audit.competitive_picture(judged(spark, d), "p_type", "Brand#2")


@query(f"with {JUDGED} select p_type, brand_name, count(*)::bigint as gaps from j where not is_competitor and verdict = 'unverifiable_spec' group by all")
def documentation_gaps(spark, d):
    return audit.documentation_gaps(judged(spark, d), "p_type", "brand_name")


@query("with l as (select distinct on (user_id, event_type) * from events order by user_id, event_type, ts desc, event_id desc) select event_id from l where not (value > 30)")
def latest_check_gap(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return audit.latest_gaps(e, ["user_id", "event_type"], ["ts", "event_id"], F.col("value") > 30).select("event_id")


@query("""with b as (select 0 as branch, source as task, count(*) as n, 1 as effort from documents where title is null group by source
union all select 1, lang, count(*), 1 from (select coalesce(lower(lang), 'none') as lang from documents where doc_kind is null) group by lang
union all select 2, spec_key, count(*), 2 from answer_claims where unit is null and value_numeric is not null group by spec_key
union all select 3, engine, count(*), 3 from visibility_answers where response_text is null group by engine)
select branch::bigint as branch, task, n::bigint as n, least(3, ceil(n / 2))::bigint as impact, effort::bigint as effort, round(least(3, ceil(n / 2)) / effort, 6) as priority from b""")
def remediation_rank(spark, d):
    """Four branches of findings in one ranked list."""
    docs, answers, claims = table(spark, d, "documents"), table(spark, d, "visibility_answers"), table(spark, d, "answer_claims")
    count = lambda rows, c: rows.groupBy(c.alias("task")).agg(F.count("*").alias("n"))
    return audit.ranked_tasks([
        (count(docs.where("title is null"), F.col("source")), 1),
        (count(docs.where("doc_kind is null"), F.coalesce(F.lower("lang"), F.lit("none"))), 1),
        (count(claims.where("unit is null and value_numeric is not null"), F.col("spec_key")), 2),
        (count(answers.where("response_text is null"), F.col("engine")), 3),
    ])


@query("""with m as (select lower(trim(brand_name)) as brand, count(distinct answer_id) as m from answer_claims where brand_name is not null group by 1), o as (select coalesce(sum(m) filter (brand = 'noramardo'), 0)::bigint as own, max(m) filter (brand <> 'noramardo') as top from m)
select own, (select brand from m where brand <> 'noramardo' and m.m = o.top order by brand limit 1) as top_brand, top, case when top > own then (select brand from m where brand <> 'noramardo' and m.m = o.top order by brand limit 1) || ' is named more often than noramardo' else 'noramardo is named most' end as statement from o""")
def problem_statement(spark, d):
    c = table(spark, d, "answer_claims").where("brand_name is not null").groupBy(F.lower(F.trim("brand_name")).alias("brand")).agg(F.count_distinct("answer_id").alias("mentions"))
    return audit.problem_statement(c, "noramardo")


@query("""with u as (select answer_id, unnest(citations) as url from visibility_answers), h as (select *, regexp_replace(coalesce(nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), ''), 'unknown'), '^www\\.', '') as domain from u)
select domain, count(*)::bigint as citations, count(distinct answer_id)::bigint as answers from h group by 1""")
def citation_domains(spark, d):
    return audit.citation_domains(table(spark, d, "visibility_answers"))


@query("""select answer_id, case when len(coalesce(citations, [])) = 0 then 'no_citation' when len([u for u in citations if contains(lower(regexp_extract(u, '://([^/?#:]+)', 1)), 'noramardo.example')]) > 0 then 'own_site' else 'third_party' end as bucket from visibility_answers""")
def citation_buckets(spark, d):
    return audit.citation_buckets(table(spark, d, "visibility_answers"), "noramardo.example")


@query("""with u as (select distinct unnest(citations) as url from visibility_answers) select url, nullif(regexp_extract(url, '^https://noravell\\.example/([^/?#]+)', 1), '') as section,
regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) || '/robots.txt' as robots from u where starts_with(url, 'https://noravell.example/')""")
def url_prefix_filter(spark, d):
    """Cited pages below a prefix with their section and robots file."""
    u = table(spark, d, "visibility_answers").select(F.explode("citations").alias("url")).distinct()
    return u.select("url", first_segment(F.col("url"), "https://noravell.example/").alias("section"), robots_url(F.col("url")).alias("robots")).where(F.col("url").startswith("https://noravell.example/"))


@query("""select answer_id, intent, case when length(text) > 80 then substr(text, 1, 77) || '...' else text end as prompt, case when length(response_text) > 80 then substr(response_text, 1, 77) || '...' else response_text end as response from visibility_answers join prompts using (prompt_id)""")
def qa_appendix(spark, d):
    a = table(spark, d, "visibility_answers").select("answer_id", "prompt_id", "response_text").join(table(spark, d, "prompts").select("prompt_id", "intent", "text"), "prompt_id")
    return a.select("answer_id", "intent", preview(F.col("text")).alias("prompt"), preview(F.col("response_text")).alias("response")).orderBy("intent", "answer_id")


@query("""with e as (select distinct engine from visibility_answers), p as (select prompt_id, engine, r from prompts, e, range(3) t(r) where is_active)
select p.engine, count(*)::bigint as planned, count(*) filter (not exists (select 1 from visibility_answers a where a.engine = p.engine and a.prompt_id = p.prompt_id and a.replicate_index = p.r))::bigint as missing from p group by 1""")
def run_plan(spark, d):
    """Planned prompts and replicates of each engine, less those answered: an anti-join."""
    a = table(spark, d, "visibility_answers").select("engine", "prompt_id", F.col("replicate_index").cast("int").alias("replicate_index")).distinct()
    plan = relational.with_each(table(spark, d, "prompts").where("is_active").select("prompt_id"), a.select("engine").distinct())
    plan = plan.withColumn("replicate_index", F.explode(F.sequence(F.lit(0), F.lit(2))))
    done = plan.join(a.withColumn("done", F.lit(True)), ["engine", "prompt_id", "replicate_index"], "left")
    return done.groupBy("engine").agg(F.count("*").alias("planned"), F.count_if(F.col("done").isNull()).alias("missing"))


@query("""select answer_id, sum(coalesce(input_tokens, 3000) + coalesce(output_tokens, 800)) over (partition by run_id order by answer_id)::bigint as tokens_so_far from visibility_answers""")
def running_usage(spark, d):
    """Tokens used in a run so far, with the estimates where a count is missing."""
    used = F.coalesce("input_tokens", F.lit(3000)) + F.coalesce("output_tokens", F.lit(800))
    a = table(spark, d, "visibility_answers").select("answer_id", "run_id", "input_tokens", "output_tokens")
    out = relational.running_sum(a, ["run_id"], ["answer_id"], used, "tokens_so_far", slices=F.floor(F.col("answer_id") / 10_000))
    return out.select("answer_id", F.col("tokens_so_far").cast("bigint").alias("tokens_so_far"))


@query("""with r as (select intent, prompt_id, count(*) filter (coalesce(contains(lower(response_text), 'noravell'), false)) as m, count(*) as n from visibility_answers join prompts using (prompt_id) group by 1, 2)
select intent, count(*)::bigint as prompts, sum(n)::bigint as answers, sum(m)::bigint as mentions, string_agg(prompt_id || ':' || m || '/' || n, ' ' order by prompt_id) as detail from r group by 1""")
def presence_artifact(spark, d):
    """Intents with their prompts and replicates nested, for a report file."""
    a = audit.mentions(answers_with_intent(spark, d, "response_text"), ["Noravell"]).where("intent is not null")
    per = a.groupBy("intent", "prompt_id").agg(F.count_if("mentioned").alias("m"), F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("prompt_id", "m", "n"))), lambda s: F.concat(s["prompt_id"].cast("string"), F.lit(":"), s["m"].cast("string"), F.lit("/"), s["n"].cast("string")))
    return per.groupBy("intent").agg(F.count("*").alias("prompts"), F.sum("n").alias("answers"), F.sum("m").alias("mentions"), F.array_join(parts, " ").alias("detail"))


@query("select event_id, user_id from events where event_type in ('error', 'purchase') order by event_type, ts, event_id limit 100")
def queue_head(spark, d):
    """Head of a priority queue: a top-k, not a sort of all rows."""
    return table(spark, d, "events").where(F.col("event_type").isin("error", "purchase")).orderBy("event_type", "ts", "event_id").limit(100).select("event_id", "user_id")


@query("select o_orderkey from orders left join customer on c_custkey = o_custkey where c_nationkey = 3 or o_orderstatus = 'F'")
def secured_view(spark, d):
    """Orders that a member of nation 3 may see: its own customers' and the finished ones."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("open"))
    members = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("principal"), F.col("c_custkey").alias("owner"))
    return security.secured(o, "o_custkey", members, "3", published="open").select("o_orderkey")


@query("""with b as (select user_id, ts, value from events where event_type = 'purchase') select a.event_id, b.value as last_value from events a asof left join (select user_id, ts, max_by(value, event_id) as value from events where event_type = 'purchase' group by 1, 2) b on a.user_id = b.user_id and a.ts >= b.ts""")
def as_of_purchase(spark, d):
    """Every event with the user's latest purchase at or before it."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return relational.as_of(e.select("event_id", "user_id", "ts"), buys, "user_id", "ts", ["value"], slices=F.date_trunc("day", F.col("ts"))).select("event_id", F.col("right_value").alias("last_value"))


@query("select coalesce(l_returnflag, 'all') as l_returnflag, coalesce(l_linestatus, 'all') as l_linestatus, count(*)::bigint as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity, min(l_extendedprice) as lowest, max(l_extendedprice) as highest from lineitem group by cube (l_returnflag, l_linestatus)")
def verdict_cube(spark, d):
    """Cube with counts, exact sums and extremes: aggregates of constant size, combined before the shuffle."""
    c = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus")
    out = c.agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("l_returnflag"), F.coalesce("l_linestatus", F.lit("all")).alias("l_linestatus"), "n", "quantity", "lowest", "highest")


@query("select coalesce(l_returnflag, 'all') as l_returnflag, coalesce(l_linestatus, 'all') as l_linestatus, count(*)::bigint as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity, round(quantile_cont(l_extendedprice, 0.5), 4) as median_price from lineitem group by cube (l_returnflag, l_linestatus)")
def verdict_cube_median(spark, d):
    """Cube with counts, exact sums and an exact percentile, which is read off running sums of the counts of values."""
    keys = ["l_returnflag", "l_linestatus"]
    counted = table(spark, d, "lineitem").groupBy(*keys, F.col("l_extendedprice").alias("price")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"))
    sets = F.array(*(F.struct(F.lit(i).alias("set"), *((F.col(k) if i >> j & 1 else F.lit(None).cast("string")).alias(k) for j, k in enumerate(keys))) for i in range(4)))
    values = counted.withColumn("group", F.explode(sets)).groupBy("group", "price").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))
    stated = F.when(F.col("price").isNotNull(), F.col("n"))
    totals = values.groupBy("group").agg(F.sum("n").alias("n"), F.sum("quantity").cast("double").alias("quantity"), F.sum(stated).alias("stated"))
    summed = relational.running_sum(values.where("price is not null").select("group", "price", F.col("n").alias("times")), ["group"], ["price"], F.col("times"), "so_far", slices=F.floor(F.col("price") / 1000))
    # the middle lies at (stated - 1) / 2, counted from 0: on a value or between two
    middle = summed.join(totals, "group").groupBy("group").agg(
        F.first("n").alias("n"), F.first("quantity").alias("quantity"), *(F.min(F.when(F.col("so_far") > at, F.col("price"))).alias(side) for side, at in (("low", F.floor((F.col("stated") - 1) / 2)), ("high", F.ceil((F.col("stated") - 1) / 2))))
    )
    empty = totals.where("stated is null").select("group", "n", "quantity", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    out = middle.unionByName(empty)
    return out.select(*(F.coalesce(f"group.{k}", F.lit("all")).alias(k) for k in keys), "n", "quantity", F.round((F.col("low") + F.col("high")) / 2, 4).alias("median_price"))


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minutes then 0 else 1 end as opens from events), s as (select *, sum(opens) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from g)
select user_id, count(distinct s)::bigint as sessions, max(n)::bigint as longest from (select user_id, s, count(*) as n from s group by 1, 2) group by 1""")
def sessions(spark, d):
    """Sessions parted by half an hour of silence; a busy user is spread over days."""
    e = relational.sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", "30 minutes", F.date_trunc("day", "ts"))
    return e.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("select host, count(*)::bigint as n from (select nullif(lower(regexp_extract(unnest(citations), '://([^/?#:]+)', 1)), '') as host from visibility_answers) group by 1 order by n desc, host limit 20")
def top_hosts(spark, d):
    u = table(spark, d, "visibility_answers").select(F.explode("citations").alias("url")).select(host(F.col("url")).alias("host"))
    return u.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(20)


@query("""with r as (select engine, run_id, max((created_at, answer_id)) as latest from visibility_answers group by 1, 2), l as (select engine, arg_max(run_id, latest) as run_id from r group by 1),
p as (select engine, run_id, prompt_id, bool_or(coalesce(contains(lower(response_text), 'noravell') or contains(lower(response_text), 'noramardo'), false)) as named from visibility_answers join l using (engine, run_id) group by 1, 2, 3)
select engine, run_id, count(*)::bigint as prompts, count(*) filter (named)::bigint as mentions, coalesce(string_agg(prompt_id, ',' order by prompt_id) filter (not named), '') as missed, round(count(*) filter (named) / count(*), 6) as rate from p group by 1, 2""")
def model_visibility(spark, d):
    """Latest run of each engine with its mention rate and the prompts that miss the brand."""
    a = table(spark, d, "visibility_answers").select("engine", "run_id", "prompt_id", "answer_id", "created_at", "response_text")
    return audit.model_visibility(a, NEEDLES).withColumn("missed", F.array_join(F.transform("missed", lambda x: x.cast("string")), ","))


@query("select engine, count(*)::bigint as answers, count(*) filter (coalesce(contains(lower(response_text), 'noravell'), false))::bigint as mentions, round(count(*) filter (coalesce(contains(lower(response_text), 'noravell'), false)) / count(*), 6) as mention_rate from visibility_answers group by 1")
def benchmark_mentions(spark, d):
    return audit.mention_rate(table(spark, d, "visibility_answers"), "engine", ["Noravell"])


@query(f"""with {JUDGED}, {COVER}, g as (select count(*) filter (verdict in ('incorrect', 'likely_confusion')) as wrong, count(*) filter (verdict in ('correct', 'incorrect', 'likely_confusion')) as checked, count(*) filter (verdict like 'unverifiable%') as open from j where not is_competitor), c as (select sum(s) / sum(n) as share from cov)
select 0::bigint as position, 'wrong claims' as note, wrong::double as figure from g where wrong > 0 union all select 1, 'no claim proven wrong among those checked', checked from g where wrong = 0
union all select 2, 'documentation covers few attributes', round(share, 6) from c where share < 0.25 union all select 3, 'claims that the documentation cannot check', open from g where open > 0""")
def critical_notes(spark, d):
    c = covered(spark, d).agg(F.round(relational.rate(F.sum(F.size("stated")), F.sum(F.size("stated") + F.size("missing"))), 6).alias("completeness"))
    return audit.critical_notes(judged(spark, d), c)


@query("select prompt_id, intent from prompts where is_active")
def active_prompts(spark, d):
    return table(spark, d, "prompts").where("is_active").select("prompt_id", "intent").orderBy("intent", "prompt_id")


@query("""select run_id, coalesce(finished_at is not null, false) as done, case when status = 'running' and finished_at is null then 'stalled' else coalesce(status, 'unknown') end as state, coalesce(claims_inserted, 0)::bigint as inserted from extraction_runs""")
def run_states(spark, d):
    """Status by cases, old values kept where there is no new one."""
    r = table(spark, d, "extraction_runs")
    state = F.when((F.col("status") == "running") & F.col("finished_at").isNull(), "stalled").otherwise(F.coalesce("status", F.lit("unknown")))
    return r.select("run_id", F.col("finished_at").isNotNull().alias("done"), state.alias("state"), F.coalesce("claims_inserted", F.lit(0)).cast("bigint").alias("inserted"))
