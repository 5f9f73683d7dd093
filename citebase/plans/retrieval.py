"""Queries of hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citebase.operators import audit, relational, retrieval
from citebase.plans.registry import WORDS, query
from citebase.session import table

#: The requirements of the bound search: key, operator, value.
REQUIREMENTS = [
    ("size", ">=", "10"), ("price", "<=", "1500"), ("type", "class>=", "STANDARD"), ("type", "class>=", "GOLD"), ("brand", "=", "Brand#2"),
    ("small", "=", "ja"), ("ghost", ">=", "3"), ("size", "~", "3"), ("size", ">=", "much"), ("size", None, "20"), ("size", "=", "11"),
]
TYPES = ["ECONOMY", "SMALL", "MEDIUM", "STANDARD", "LARGE", "PROMO"]

STATUS = """with r(key, op, value) as (values ('size', '>=', '10'), ('price', '<=', '1500'), ('type', 'class>=', 'STANDARD'), ('type', 'class>=', 'GOLD'), ('brand', '=', 'Brand#2'),
('small', '=', 'ja'), ('ghost', '>=', '3'), ('size', '~', '3'), ('size', '>=', 'much'), ('size', null, '20'), ('size', '=', '11')),
o(p_type, n) as (values ('ECONOMY', 1), ('SMALL', 2), ('MEDIUM', 3), ('STANDARD', 4), ('LARGE', 5), ('PROMO', 6)),
e as (select p.*, r.*, coalesce(r.op, '>=') as o, try_cast(r.value as double) as v, ho.n as have, wo.n as want from part p cross join r left join o ho using (p_type) left join o wo on wo.p_type = r.value),
s as (select p_partkey as product_id, key, case when key = 'ghost' then 'unknown' when key = 'price' and p_size > 45 then 'unknown'
when o not in ('>=', '<=', '=', 'class>=') then 'unknown'
when o = '=' then case when (key = 'size' and p_size = v) or (key = 'brand' and p_brand = value) or (key = 'small' and (p_size < 10) = (lower(value) in ('true', 't', 'yes', 'ja'))) then 'met' else 'unmet' end
when o = 'class>=' then case when key <> 'type' or have is null or want is null then 'unknown' when have >= want then 'met' else 'unmet' end
when v is null or key not in ('size', 'price') then 'unknown'
when o = '>=' then case when case key when 'size' then p_size else p_retailprice end >= v then 'met' else 'unmet' end
else case when case key when 'size' then p_size else p_retailprice + 100 end <= v then 'met' else 'unmet' end end as status from e)
"""


def part_facts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as facts: a number, a range, a class, a text and a flag each."""
    p = table(spark, d, "part").withColumn("product_id", F.col("p_partkey"))
    none = {"n": F.lit(None).cast("double"), "s": F.lit(None).cast("string"), "b": F.lit(None).cast("boolean")}

    def fact(key, number=none["n"], upper=none["n"], text=none["s"], enum=none["s"], flag=none["b"], presence=F.lit("stated")):
        return F.struct(F.lit(key).alias("key"), number.cast("double").alias("value_numeric"), upper.cast("double").alias("value_numeric_max"), text.alias("value_text"), enum.alias("value_enum"), flag.alias("value_bool"), presence.alias("presence"))

    facts = F.array(
        fact("size", number=F.col("p_size")),
        fact("price", number=F.col("p_retailprice"), upper=F.col("p_retailprice") + 100, presence=F.when(F.col("p_size") > 45, "not_stated").otherwise("stated")),
        fact("type", enum=F.col("p_type")),
        fact("brand", text=F.col("p_brand")),
        fact("small", flag=F.col("p_size") < 10),
    )
    return p.select("product_id", F.explode(facts).alias("f")).select("product_id", "f.*")


def part_status(spark: SparkSession, d: str) -> DataFrame:
    requirements = spark.createDataFrame(REQUIREMENTS, "key string, op string, value string")
    ordinals = F.map_from_arrays(F.array(*(F.lit(t) for t in TYPES)), F.array(*(F.lit(i + 1) for i in range(len(TYPES)))))
    definitions = spark.createDataFrame([(k,) for k in ("size", "price", "type", "brand", "small")], "key string").withColumn("ordinals", ordinals)
    return retrieval.evaluate_requirements(table(spark, d, "part").select(F.col("p_partkey").alias("product_id")), requirements, definitions, part_facts(spark, d))


@query(STATUS + "select product_id, key, status from s")
def requirement_status(spark, d):
    return part_status(spark, d)


@query(STATUS + """select product_id, coalesce(string_agg(key, ',' order by key) filter (status = 'met'), '') as met, coalesce(string_agg(key, ',' order by key) filter (status = 'unknown'), '') as unknown
from s group by 1 having count(*) filter (status = 'unmet') <= 4""")
def requirement_grading(spark, d):
    """Key lists of each status; products with more than four unmet requirements are dropped."""
    g = retrieval.grade(part_status(spark, d), strict=False).where(F.size("unmet") <= 4)
    return g.select("product_id", F.array_join("met", ",").alias("met"), F.array_join("unknown", ",").alias("unknown"))


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of the first row stands for the embedded question."""
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


DISTANCE = "1 - list_cosine_similarity(e.embedding::double[], q.embedding::double[])"


@query(f"select e.vec_id, round({DISTANCE}, 6) as distance from embeddings e, (select embedding from embeddings where vec_id = 0) q order by {DISTANCE}, e.vec_id limit 300")
def vector_topk(spark, d):
    return retrieval.nearest(table(spark, d, "embeddings"), query_vector(spark, d), 300, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"select e.vec_id as chunk_id, round({DISTANCE}, 6) as distance from embeddings e, (select embedding from embeddings where vec_id = 0) q where e.label in (1, 3, 5) order by {DISTANCE}, e.vec_id limit 12")
def match_chunks(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("product_id"), "embedding")
    products = spark.createDataFrame([(1,), (3,), (5,)], "product_id int")
    return retrieval.match_chunks(chunks, query_vector(spark, d), products).select("chunk_id", F.round("distance", 6).alias("distance"))


@query(f"""with r as (select q.vec_id as query_id, e.vec_id as id, {DISTANCE} as d, row_number() over (partition by q.vec_id order by round({DISTANCE}, 12), e.vec_id) as rank from embeddings e, (select * from embeddings where vec_id % 50 = 0) q)
select query_id, id, round(abs(d), 6) as distance, rank from r where rank <= 10""")
def vector_search(spark, d):
    """The ten nearest rows of every fiftieth vector, against all rows."""
    v = table(spark, d, "embeddings")
    return retrieval.nearest_to_each(v, v.where("vec_id % 50 = 0"), 10).withColumn("distance", F.round(F.abs("distance"), 6))


QUESTION = 'aluminium "in een raster" -zwembad or wool grid'
KEYWORDS = f"""t as (select *, {WORDS.format("text")} as w from documents), k as (select *, ' ' || array_to_string(w, ' ') || ' ' as j, len([x for x in w if x in ('aluminium', 'in', 'een', 'raster', 'wool', 'grid')]) as hits from t),
m as (select *, round(hits / len(w), 9) as text_score from k where (list_contains(w, 'aluminium') and contains(j, ' in een raster ') and not list_contains(w, 'zwembad')) or (list_contains(w, 'wool') and list_contains(w, 'grid')))"""


@query(f"with {KEYWORDS} select doc_id, hits::bigint as hits, text_score from m order by text_score desc, doc_id limit 300")
def keyword_recall(spark, d):
    """Phrase, exclusion and alternative over the words of all documents."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return retrieval.keyword_rank(docs, QUESTION, retrieval.POOL, "doc_id", "text").select("doc_id", "hits", "text_score")


def searchable(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a vector as chunks, their source as the product."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("product_id"), F.col("text").alias("content"))
    return docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")


@query(f"""with {KEYWORDS}, s as (select source, count(title) / count(*) as completeness, count(*) as n from documents group by 1), keep as (select source from s where n >= 3),
c as (select doc_id, source, embedding from documents join embeddings on vec_id = doc_id where source in (select source from keep)),
v as (select e.doc_id, e.source, {DISTANCE} as distance from c e, (select embedding from embeddings where vec_id = 0) q order by distance, doc_id limit 300),
vr as (select *, row_number() over (order by distance, doc_id) as rank from v), vb as (select source, min(rank) as vector_rank, arg_min(doc_id, rank) as vector_chunk from vr group by 1),
p as (select doc_id, source, text_score from m where doc_id in (select doc_id from c) order by text_score desc, doc_id limit 300),
pr as (select *, row_number() over (order by text_score desc, doc_id) as rank from p), pb as (select source, min(rank) as keyword_rank, arg_min(doc_id, rank) as keyword_chunk from pr group by 1),
f as (select coalesce(vb.source, pb.source) as product_id, vector_rank, keyword_rank, coalesce(vector_chunk, keyword_chunk) as best_chunk_id from vb full join pb on vb.source = pb.source)
select product_id, round(coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + keyword_rank), 0) + 0.004 * coalesce(s.completeness, 0), 9) as score, vector_rank, keyword_rank, best_chunk_id
from f left join s on s.source = f.product_id order by score desc, product_id limit 20""")
def hybrid_search(spark, d):
    """Hard requirement (at least three documents), vector pool, keyword pool, fusion with a bonus for complete data."""
    s = table(spark, d, "documents").groupBy(F.col("source").alias("product_id")).agg((F.count("title") / F.count("*")).alias("completeness"), F.count("*").cast("double").alias("n"))
    none = F.lit(None)
    facts = s.select("product_id", F.lit("documents").alias("key"), F.col("n").alias("value_numeric"), none.cast("double").alias("value_numeric_max"), none.cast("string").alias("value_text"), none.cast("string").alias("value_enum"), none.cast("boolean").alias("value_bool"), F.lit("stated").alias("presence"))
    requirements = spark.createDataFrame([("documents", ">=", "3")], "key string, op string, value string")
    definitions = spark.createDataFrame([("documents", {"-": 0})], "key string, ordinals map<string,int>")
    kept = retrieval.grade(retrieval.evaluate_requirements(s, requirements, definitions, facts))
    return retrieval.search_products(searchable(spark, d), kept, s, query_vector(spark, d), QUESTION)


@query("""with p as (select distinct l_suppkey, l_partkey from lineitem) select s_suppkey, cast(coalesce(sum((p_size > 10)::int) / nullif(count(p_size), 0), 0) as decimal(20,10))::decimal(4,3)::varchar as completeness
from supplier left join p on l_suppkey = s_suppkey left join part on p_partkey = l_partkey group by 1""")
def data_completeness(spark, d):
    """Stated share of each supplier's applicable pairs in three decimals."""
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    stated = pairs.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 10).alias("stated")), "l_partkey")
    all_ = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey")).join(stated, "l_suppkey", "left")
    return audit.data_completeness(all_, "l_suppkey").select(F.col("l_suppkey").alias("s_suppkey"), F.col("completeness").cast("string").alias("completeness"))


@query("""with h0 as (select 's0' as node, 0 as hop), e as (select distinct 's' || l_suppkey as a, 'p' || l_partkey as b from lineitem), g as (select a, b from e union all select b, a from e),
h1 as (select distinct b as node, 1 as hop from g join h0 on node = a where b not in (select node from h0)),
h2 as (select distinct b as node, 2 as hop from g join h1 on node = a where b not in (select node from h0 union all select node from h1)),
h3 as (select distinct b as node, 3 as hop from g join h2 on node = a where b not in (select node from h0 union all select node from h1 union all select node from h2))
select node, hop::bigint as hop from (from h0 union all from h1 union all from h2 union all from h3)""")
def frontier_bfs(spark, d):
    """Breadth-first search over the supplier and part graph."""
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return relational.reachable(e.union(e.select("b", "a")), spark.createDataFrame([("s0",)], "node string"), 3)
