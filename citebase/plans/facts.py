"""Queries of the fact store: scans, upserts, chains, fuzzy matching, admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from citebase.functions.numbers import digits_within
from citebase.functions.text import own_brand, quoted, slug
from citebase.operators import facts, relational
from citebase.plans.registry import NORMAL, SIX, SLUG, TRIGRAMS, query
from citebase.session import table


def day():
    """Time slices by which the log of a busy key is spread."""
    return F.date_trunc("day", F.col("ts"))


@query(f"select product_id, {SLUG.format("brand_name || ' ' || product_name")} as slug from products")
def product_slugs(spark, d):
    """Slug of every product."""
    return table(spark, d, "products").select("product_id", slug(F.col("brand_name"), F.col("product_name")).alias("slug"))


@query("select product_id, product_name, category_code from products where brand_name = 'Noravell'")
def brand_products(spark, d):
    """Filtered child scan: the filter reaches the Parquet reader."""
    return table(spark, d, "products").where(F.col("brand_name") == "Noravell").select("product_id", "product_name", "category_code").orderBy("product_name")


@query("select spec_key, data_type, unit from spec_attributes where is_filterable")
def vocabulary_scan(spark, d):
    return table(spark, d, "spec_attributes").where("is_filterable").select("spec_key", "data_type", "unit").orderBy("spec_key")


@query("select doc_id, source from documents where title is null")
def missing_values(spark, d):
    return table(spark, d, "documents").where("title is null").select("doc_id", "source")


@query("""with r(op, bound) as (values ('>=', 50), ('<', 20), ('=', 7))
select r.op, cast(r.bound as bigint) as bound, count(*)::bigint as n from events, r
where case r.op when '>=' then cast(props::json->>'k' as bigint) >= bound when '<' then cast(props::json->>'k' as bigint) < bound else cast(props::json->>'k' as bigint) = bound end group by all""")
def json_array_explode(spark, d):
    """Requirements given as a JSON array, exploded and held against a JSON field."""
    asked = '[{"op":">=","bound":50},{"op":"<","bound":20},{"op":"=","bound":7}]'
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.explode(F.from_json(F.lit(asked), "array<struct<op:string,bound:bigint>>")).alias("r")).select("k", "r.*")
    hit = F.when(F.col("op") == ">=", F.col("k") >= F.col("bound")).when(F.col("op") == "<", F.col("k") < F.col("bound")).otherwise(F.col("k") == F.col("bound"))
    return e.where(hit).groupBy("op", "bound").agg(F.count("*").alias("n"))


LATEST = "select distinct on (user_id, event_type) user_id, event_type, event_id, value from events order by user_id, event_type, ts desc, event_id desc"


@query(LATEST)
def upsert_latest_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return relational.latest_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("select a.answer_id from visibility_answers a where not exists (select 1 from answer_claims c where c.answer_id = a.answer_id) group by 1")
def insert_if_absent(spark, d):
    """Answers that no claim was extracted from yet."""
    return relational.insert_if_absent(table(spark, d, "answer_claims").select("answer_id"), table(spark, d, "visibility_answers").select("answer_id"), ["answer_id"])


@query("select run_id, prompt_id, replicate_index, min(answer_id) as answer_id from visibility_answers group by all")
def unique_replicates(spark, d):
    """One answer for each run, prompt and replicate: the first."""
    a = table(spark, d, "visibility_answers").select("run_id", "prompt_id", "replicate_index", "answer_id")
    return relational.insert_if_absent(a.limit(0), a, ["run_id", "prompt_id", "replicate_index"])


@query("""select event_id, lead(event_id) over w as superseded_by, lead(event_id) over w is null as is_current, coalesce(value is distinct from lag(value) over w, true) or lag(event_id) over w is null as is_change
from events window w as (partition by user_id, event_type order by ts, event_id)""")
def supersede_chain(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return relational.supersede_chain(e, ["user_id", "event_type"], ["ts", "event_id"], "event_id", ["value"], slices=day()).select("event_id", "superseded_by", "is_current", "is_change")


@query("""select user_id, event_type, arg_max(event_id, (ts, event_id)) as promoted from events group by all having not bool_or(value > 60)""")
def orphan_repair(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return relational.orphan_keys(e, ["user_id", "event_type"], F.col("value") > 60, ["ts", "event_id"], "event_id")


@query("""with c as (select *, row_number() over w as rn, lag(value) over w as before from events window w as (partition by user_id, event_type order by ts, event_id)),
k as (select * from c where rn = 1 or value is distinct from before)
select event_id, case when row_number() over w = 1 then 'insert' else 'supersede' end as action, lead(event_id) over w as superseded_by from k window w as (partition by user_id, event_type order by ts, event_id)
union all select event_id, 'no-op', null from c where not (rn = 1 or value is distinct from before)""")
def persist_claims(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return facts.persist_claims(e, ["user_id", "event_type"], ["ts", "event_id"], "event_id", ["value"], slices=day()).select("event_id", "action", "superseded_by")


@query("""with l(code, name) as (values ('nl', 'Dutch'), ('de', 'German'), ('en', 'English'), ('fr', 'French'), (null, 'not given'))
select l.name, count(*)::bigint as n from documents x join l on lower(x.lang) is not distinct from l.code group by all""")
def null_safe_join(spark, d):
    names = spark.createDataFrame([("nl", "Dutch"), ("de", "German"), ("en", "English"), ("fr", "French"), (None, "not given")], "code string, name string")
    docs = table(spark, d, "documents").groupBy(F.lower("lang").alias("lang")).agg(F.count("*").alias("n"))
    return docs.join(names, docs.lang.eqNullSafe(names.code)).groupBy("name").agg(F.sum("n").cast("bigint").alias("n"))


RULES = [("thickness_mm", []), ("density", ["minerale_wol", "glaswol"]), ("perforation", ["metaal", "hout", "gips"]), ("felt_weight", ["pes_vilt"])]


@query("""with r(spec_key, codes) as (values ('thickness_mm', []::varchar[]), ('density', ['minerale_wol', 'glaswol']), ('perforation', ['metaal', 'hout', 'gips']), ('felt_weight', ['pes_vilt']))
select p.product_id, r.spec_key from products p, r where len(codes) = 0 or list_contains(codes, p.category_code)""")
def category_scope(spark, d):
    rules = spark.createDataFrame(RULES, "spec_key string, codes array<string>")
    return relational.applicable(table(spark, d, "products").select("product_id", "category_code"), rules, "category_code", "codes").select("product_id", "spec_key")


@query("""with recursive t(id, parent, code) as (
select 'c' || c_custkey, 'n' || c_nationkey, c_mktsegment from customer union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation union all select 'r' || r_regionkey, null, r_name from region),
w(id, next, path) as (select id, parent, code from t union all select w.id, t.parent, w.path || ' > ' || t.code from w join t on t.id = w.next)
select id, path from w where next is null""")
def category_ancestors(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_mktsegment").alias("code"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit(None).cast("string"), "r_name")
    return relational.ancestors(c.union(n).union(r)).select("id", F.array_join("path", " > ").alias("path"))


@query(f"""with e as (select distinct brand_name as entered from answer_claims where brand_name is not null), n as (select distinct brand_name as name from products),
s as (select entered, name, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as score from (select entered, {TRIGRAMS.format("entered")} as a from e), (select name, {TRIGRAMS.format("name")} as b from n)),
m as (select distinct on (entered) entered, name, score from s where score > 0 order by entered, score desc, name)
select e.entered, m.name, round(m.score, 6) as score from e left join m using (entered)""")
def trigram_resolve(spark, d):
    """Best canonical brand for every spelling of a brand."""
    entered = table(spark, d, "answer_claims").select(F.col("brand_name").alias("entered"))
    names = table(spark, d, "products").select(F.col("brand_name").alias("name"))
    return facts.best_match(entered, names).withColumn("score", F.round("score", 6))


@query(f"""with n as (select brand_name, category_code, product_name, min(product_id) as id, any_value({TRIGRAMS.format("product_name")}) as g from products group by 1, 2, 3)
select a.id as id_a, b.id as id_b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) as similarity
from n a join n b on a.brand_name = b.brand_name and a.category_code is not distinct from b.category_code and a.id < b.id
where len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) >= 0.35 - 1e-12""")
def near_duplicates(spark, d):
    """Names of one brand and category that may be the same product."""
    p = table(spark, d, "products").select(F.col("product_id").alias("id"), "brand_name", "category_code", F.col("product_name").alias("name"))
    return facts.similar_pairs(p, ["brand_name", "category_code"]).withColumn("similarity", F.round("similarity", 6))


def _claims_with_text(spark, d, *columns):
    c = table(spark, d, "answer_claims").select("answer_claim_id", "answer_id", "source_quote", *columns)
    a = table(spark, d, "visibility_answers").select("answer_id", F.col("response_text").alias("answer_text"))
    return c.join(a, "answer_id", "left")


@query(f"""select c.answer_claim_id, coalesce(contains({NORMAL.format("a.response_text")}, {NORMAL.format("c.source_quote")}), false) as verbatim from answer_claims c left join visibility_answers a using (answer_id)""")
def snippet_verify(spark, d):
    c = _claims_with_text(spark, d)
    return c.select("answer_claim_id", F.coalesce(quoted(F.col("answer_text"), F.col("source_quote")), F.lit(False)).alias("verbatim"))


@query(f"""select answer_claim_id, contains(regexp_replace(coalesce(source_quote, ''), '[^0-9]', '', 'g'), regexp_replace({SIX.format("value_numeric")}, '[^0-9]', '', 'g')) as digits from answer_claims where value_numeric is not null""")
def digits_in_snippet(spark, d):
    c = table(spark, d, "answer_claims").where("value_numeric is not null")
    return c.select("answer_claim_id", digits_within(F.col("value_numeric"), F.col("source_quote")).alias("digits"))


@query(f"""with c as (select c.*, a.response_text, s.data_type, {NORMAL.format("coalesce(c.source_quote, '')")} as q from answer_claims c left join visibility_answers a using (answer_id) left join spec_attributes s using (spec_key))
select case when not (q <> '' and contains({NORMAL.format("coalesce(response_text, '')")}, q)) then 'not verbatim'
when value_numeric is not null and not contains(regexp_replace(source_quote, '[^0-9]', '', 'g'), regexp_replace({SIX.format("value_numeric")}, '[^0-9]', '', 'g')) then 'digits not in quote'
when data_type is null then 'unknown key'
when not case when data_type in ('numeric', 'numeric_range') then value_numeric is not null when data_type = 'boolean' then value_bool is not null when data_type = 'enum' then coalesce(value_enum, '') <> '' else coalesce(value_text, '') <> '' end then 'no value of the type'
else 'admitted' end as reason, count(*)::bigint as n from c group by 1""")
def claim_admission(spark, d):
    c = _claims_with_text(spark, d, "spec_key", "value_numeric", "value_bool", "value_enum", "value_text")
    return facts.admit_claims(c, table(spark, d, "spec_attributes")).groupBy("reason").agg(F.count("*").alias("n"))


_RANGES = ", ".join(f"('{k}', {a}::double, {b}::double)" for k, a, b in facts.PLAUSIBLE)
_FACTORS = ", ".join(f"('{a}', '{b}', {f}::double)" for a, b, f in facts.CONVERSIONS)


@query(f"""with r(spec_key, low, high) as (values {_RANGES}),
k(f, t, factor) as (values {_FACTORS}),
c as (select c.*, a.response_text, s.unit as target, k.factor as known, coalesce(k.factor, 1.0) as factor, r.low, r.high,
(value_numeric is not null)::int + (value_text is not null)::int + (value_bool is not null)::int + (value_enum is not null)::int as n
from answer_claims c left join visibility_answers a using (answer_id) left join spec_attributes s using (spec_key) left join r using (spec_key) left join k on k.f = lower(trim(c.unit)) and k.t = lower(trim(s.unit))),
v as (select *, case when n = 0 then null when coalesce(source_quote, '') = '' then 'no citation' when response_text is null then 'no page text'
when not contains({NORMAL.format("response_text")}, {NORMAL.format("source_quote")}) then 'not verbatim' when n <> 1 then 'not one value'
when value_numeric is not null and not contains(regexp_replace(source_quote, '[^0-9]', '', 'g'), regexp_replace({SIX.format("value_numeric")}, '[^0-9]', '', 'g')) then 'digits not in quote'
when value_numeric is not null and value_numeric_max is not null and not contains(regexp_replace(source_quote, '[^0-9]', '', 'g'), regexp_replace({SIX.format("value_numeric_max")}, '[^0-9]', '', 'g')) then 'upper digits not in quote'
when value_numeric * factor < low or value_numeric * factor > high or value_numeric_max * factor < low or value_numeric_max * factor > high then 'implausible' end as reason from c)
select answer_claim_id, reason is null as ok, reason, case when n > 0 then round(value_numeric * factor, 6) end as value_numeric, case when n > 0 then case when known is not null then target else unit end end as unit from v""")
def verify_claims(spark, d):
    """The chain of admission checks over all extracted claims, the answer as the cited page."""
    c = _claims_with_text(spark, d, "spec_key", "value_numeric", "value_numeric_max", "value_text", "value_bool", "value_enum", "unit")
    c = c.join(table(spark, d, "spec_attributes").select("spec_key", F.col("unit").alias("target_unit")), "spec_key", "left")
    c = c.withColumnsRenamed({"source_quote": "source_snippet", "answer_text": "page_text"}).withColumns({"page_number": F.lit(1), "derivation_note": F.lit(None).cast("string"), "presence": F.when(facts.value_count() == 0, "not_stated").otherwise("stated")})
    out = facts.verify_claims(c, spark.createDataFrame(facts.PLAUSIBLE, "spec_key string, low double, high double"))
    return out.select("answer_claim_id", "ok", "reason", F.round("value_numeric", 6).alias("value_numeric"), "unit")


@query("""with c as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int) as claim_id, case when l_partkey % 50 <> 0 then l_partkey end as product_id, case when l_linenumber % 2 = 1 then 'size' else 'lot' end as spec_key, l_quantity as v, p.p_size as size, p.p_size % 25 + 1 as lot
from lineitem l left join part p on p.p_partkey = l.l_partkey and l.l_partkey % 50 <> 0)
select claim_id, case when product_id is null then 'unverifiable_product' when (spec_key = 'size' and size > 45) or size is null then 'unverifiable_spec'
when spec_key = 'size' and abs(v - size) <= 2 then 'correct' when spec_key = 'lot' and v = lot then 'correct'
when spec_key = 'size' and v = lot then 'likely_confusion' when spec_key = 'lot' and size <= 45 and abs(v - size) <= 2 then 'likely_confusion' else 'incorrect' end as verdict,
case when product_id is null or (spec_key = 'size' and size > 45) then null when spec_key = 'size' and abs(v - size) > 2 and v = lot then 'lot' when spec_key = 'lot' and v <> lot and size <= 45 and abs(v - size) <= 2 then 'size' end as confusable_key from c""")
def claim_verdicts(spark, d):
    """Claims against the truth with tolerance and confusable attributes."""
    n = lambda c, t: F.lit(None).cast(t).alias(c)
    rest = [n("value_numeric_max", "double"), n("value_text", "string"), n("value_bool", "boolean"), n("value_enum", "string")]
    claims = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("claim_id"), F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey")).alias("product_id"), F.when(F.col("l_linenumber") % 2 == 1, "size").otherwise("lot").alias("spec_key"), F.col("l_quantity").alias("value_numeric"), *rest
    )
    attributes = spark.createDataFrame([("size", "numeric", 2.0, ["ghost", "lot"]), ("lot", "numeric", 0.0, ["size"])], "spec_key string, data_type string, comparison_tolerance double, confusable_with array<string>")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_size").cast("double").alias("s"))
    one = lambda key, value, presence: p.select("product_id", F.lit(key).alias("spec_key"), presence.alias("presence"), value.alias("value_numeric"), *rest)
    truth = one("size", F.col("s"), F.when(F.col("s") > 45, "not_stated").otherwise("stated")).unionByName(one("lot", F.col("s") % 25 + 1, F.lit("stated")))
    return facts.diff_claims(claims, attributes, truth)


@query("""select answer_claim_id, 'one value' as "constraint" from answer_claims where (value_numeric is not null)::int + (value_text is not null)::int + (value_bool is not null)::int + (value_enum is not null)::int <> 1
union all select answer_claim_id, 'range order' from answer_claims where value_numeric_max is not null and (value_numeric is null or value_numeric_max < value_numeric)
union all select answer_claim_id, 'quote given' from answer_claims where source_quote is null or trim(source_quote) = ''
union all select answer_claim_id, 'unit of a number' from answer_claims where unit is not null and value_numeric is null
union all select answer_claim_id, 'product given' from answer_claims where product_name is null or trim(product_name) = ''""")
def constraint_violations(spark, d):
    return facts.violations(table(spark, d, "answer_claims"), "answer_claim_id")


@query(f"""select answer_claim_id, coalesce({SIX.format("value_numeric")} || coalesce('-' || {SIX.format("value_numeric_max")}, '') || coalesce(' ' || unit, ''), value_text, case when value_bool then 'yes' when not value_bool then 'no' end, value_enum, '-') as shown from answer_claims""")
def value_display(spark, d):
    return table(spark, d, "answer_claims").select("answer_claim_id", facts.display_value().alias("shown"))


@query(f"""select answer_claim_id, coalesce({NORMAL.format("brand_name")} <> '' and (contains({NORMAL.format("brand_name")}, 'noravell') or contains('noravell', {NORMAL.format("brand_name")})), false) as own from answer_claims""")
def own_brand_flags(spark, d):
    return table(spark, d, "answer_claims").select("answer_claim_id", own_brand(F.col("brand_name"), "Noravell").alias("own"))


@query(f"""select {SLUG.format("coalesce(product_name, '')")} as slug, arg_min(product_name, listing_id) as product_name, count(*)::bigint as "rows", arg_min(brand_name, listing_id) filter (brand_name is not null) as brand_name, arg_min(manufacturer_ref, listing_id) filter (manufacturer_ref is not null) as manufacturer_ref from product_listings group by 1""")
def product_identity(spark, d):
    """Products by slug, brand and reference filled from the earliest listing that has them."""
    return facts.product_identity(table(spark, d, "product_listings"), "product_name", "listing_id", ["brand_name", "manufacturer_ref"])


@query("""select chunk_id, row_number() over (partition by document_version_id, chunk_index order by chunk_id)::bigint as version from document_chunks""")
def version_sequence(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("document_version_id", "chunk_index").orderBy("chunk_id")
    return table(spark, d, "document_chunks").select("chunk_id", F.row_number().over(w).cast("bigint").alias("version"))


@query("select sha256(text) as sha256, min(doc_id) as first_id, count(*)::bigint as copies from documents group by 1 having count(*) > 1")
def content_hash_dedup(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


@query("""select spec_key, array_to_string(case when list_contains(confusable_with, 'density') then confusable_with else list_append(coalesce(confusable_with, []), 'density') end, ',') as confusable, case when unit in ('mm', 'm') then 'length' when unit = 'dB' then 'sound' when unit is null then 'none' else 'other' end as axis from spec_attributes""")
def vocabulary_update(spark, d):
    """Array append if missing, and re-tagging by cases."""
    s = table(spark, d, "spec_attributes")
    axis = F.when(F.col("unit").isin("mm", "m"), "length").when(F.col("unit") == "dB", "sound").when(F.col("unit").isNull(), "none").otherwise("other")
    return s.select("spec_key", F.array_join(F.array_union(F.coalesce("confusable_with", F.array().cast("array<string>")), F.array(F.lit("density"))), ",").alias("confusable"), axis.alias("axis"))


@query("""select event_id, 'first' as src, cast(props::json->>'k' as varchar) as k from events""")
def json_merge(spark, d):
    """Shallow merge of JSON objects, the right one wins."""
    from citebase.sources.sinks import merge_json

    m = merge_json(F.lit('{"k":"0","src":"first"}'), F.col("props"))
    return table(spark, d, "events").select("event_id", m["src"].alias("src"), m["k"].alias("k"))


@query("""select 'union' as op, x as brand from (select lower(trim(brand_name)) as x from answer_claims where brand_name is not null union select lower(brand_name) from products)
union all select 'claimed only', x from (select lower(trim(brand_name)) as x from answer_claims where brand_name is not null except select lower(brand_name) from products)
union all select 'both', x from (select lower(trim(brand_name)) as x from answer_claims where brand_name is not null intersect select lower(brand_name) from products)""")
def brand_set_operations(spark, d):
    a = table(spark, d, "answer_claims").where("brand_name is not null").select(F.lower(F.trim("brand_name")).alias("brand"))
    b = table(spark, d, "products").select(F.lower("brand_name").alias("brand"))
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "brand")
    return tag(a.union(b).distinct(), "union").union(tag(a.subtract(b), "claimed only")).union(tag(a.intersect(b), "both"))
