"""Hybrid retrieval: hard requirements first, then vector and keyword ranks, then reciprocal-rank fusion."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citebase.functions.numbers import to_number, truthy
from citebase.functions.text import words
from citebase.functions.vectors import distance_to
from citebase.operators.relational import with_each
from citebase.session import checkpointed

#: Query vectors of one broadcast block.
QUERY_BLOCK = 2000
#: Fixed values of the fusion: rank offset, weight of the trust bonus, sizes of pool, result and grounding.
RANK_OFFSET, TRUST, POOL, LIMIT, GROUNDING = 60, 0.004, 300, 20, 12
#: Columns of a fact by the names that ``requirement_status`` has for them.
FACT = {"number": "value_numeric", "upper": "value_numeric_max", "text": "value_text", "enum": "value_enum", "flag": "value_bool"}


def requirement_status(op: Column, wanted: Column, fact: dict[str, Column], ordinals: Column, stated: Column) -> Column:
    """met, unmet or unknown for one requirement against one current fact.

    ``fact`` has number, upper, text, enum and flag columns. A null operator is ``>=``. ``<=`` takes the upper end of a
    range, ``class>=`` compares ordinals, ``=`` that matches nothing is unmet; everything that cannot be evaluated is
    unknown.
    """
    number, op = to_number(wanted), F.coalesce(op, F.lit(">="))
    have = fact["number"].cast("decimal(38,10)")
    upper = F.coalesce(fact["upper"].cast("decimal(38,10)"), have)
    said = lambda c: F.when(c, "met").otherwise("unmet")
    known = lambda c: F.coalesce(c, F.lit(False))
    rank_have, rank_want = F.try_element_at(ordinals, fact["enum"]), F.try_element_at(ordinals, wanted)
    equal = known(have == number) | known(fact["text"] == wanted) | known(fact["enum"] == wanted) | known(fact["flag"] == truthy(wanted))
    return (
        F.when(~F.coalesce(stated, F.lit(False)), "unknown")
        .when(op == ">=", F.when(have.isNull() | number.isNull(), "unknown").otherwise(said(have >= number)))
        .when(op == "<=", F.when(have.isNull() | number.isNull(), "unknown").otherwise(said(upper <= number)))
        .when(op == "=", said(equal))
        .when(op == "class>=", F.when(rank_have.isNull() | rank_want.isNull(), "unknown").otherwise(said(rank_have >= rank_want)))
        .otherwise("unknown")
    )


def evaluate_requirements(products: DataFrame, requirements: DataFrame, definitions: DataFrame, facts: DataFrame) -> DataFrame:
    """(product_id, key, status) of every product and requirement: the nested look-ups as joins and one CASE.

    requirements: key, op, value; definitions: key, ordinals (map); facts: the current rows product_id, key, value_numeric,
    value_numeric_max, value_text, value_enum, value_bool, presence. Each product meets each requirement once (requirements
    are those of one search and are exploded from a literal array, not cross-joined); unknown keys are unknown.

    The facts asked for are gathered by product and joined before the requirements are put to the products, so what is
    shuffled follows products and facts, not their pairs with requirements, and a later grouping by product needs no shuffle.
    The join is a merge by hint: the planner's estimate of exploded facts is many times too low, and the driver would have
    to build the broadcast of them all.
    """
    asked = requirements.join(definitions, "key", "left").select("key", "op", F.col("value").alias("wanted"), "ordinals", F.col("ordinals").isNotNull().alias("known"))
    keys = sorted({r.key for r in requirements.select("key").collect()} - {None})
    useful = facts.where(F.col("product_id").isNotNull() & F.col("key").isin(keys))
    held = useful.groupBy("product_id").agg(F.collect_list(F.struct("key", *FACT.values(), "presence")).alias("_held"))
    each = with_each(products.select("product_id").join(held.hint("merge"), "product_id", "left"), asked)
    both = each.withColumn("_fact", F.explode_outer(F.filter("_held", lambda f: f["key"] == F.col("key"))))
    fact = {name: F.col(f"_fact.{c}") for name, c in FACT.items()}
    presence = F.col("_fact.presence")
    stated = F.col("known") & presence.isNotNull() & (presence != "not_stated")
    return both.select("product_id", "key", requirement_status(F.col("op"), F.col("wanted"), fact, F.col("ordinals"), stated).alias("status"))


def grade(statuses: DataFrame, strict: bool = True) -> DataFrame:
    """(product_id, met, unmet, unknown): sorted key lists of each status; ``strict`` drops products with an unmet one."""
    listed = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("key")))).alias(s)
    out = statuses.groupBy("product_id").agg(listed("met"), listed("unmet"), listed("unknown"))
    return out.where(F.size("unmet") == 0) if strict else out


def nearest(vectors: DataFrame, query: list[float], k: int, id_column: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to a query vector with their distance; ties by id. Exact: one scan and a top-k, no sort of all rows."""
    return vectors.withColumn("distance", distance_to(F.col(vector), query)).where("distance is not null").orderBy("distance", id_column).limit(k)


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, distance, rank): the k rows nearest to each of a set of query vectors; exact, ties by id.

    Blocks of at most ``block`` queries are broadcast, one scan for each; a task multiplies its Arrow batches with the block
    and keeps k rows of each query, so k rows a query and task are shuffled. Null and zero vectors and those of another
    length are left out. Blocks are worked off one by one, what each finds is stored before its broadcast goes, so the number
    of scans follows the queries and the memory does not; ``operators.ann`` searches an index instead.
    """
    spark = vectors.sparkSession
    n = queries.count()
    blocks = -(-n // block) or 1
    part = queries.select(F.col(id_column).cast("bigint").alias("q"), F.col(vector).alias("v"), F.pmod(F.xxhash64(id_column), F.lit(blocks)).alias("b"))
    out = None
    for i in range(blocks):
        rows = [(r.q, r.v) for r in part.where(F.col("b") == i).select("q", "v").collect() if r.v is not None and None not in r.v and any(r.v)]
        handle = spark.sparkContext.broadcast(rows)

        def run(batches, handle=handle):
            by_length: dict[int, list] = {}
            for q, v in handle.value:
                by_length.setdefault(len(v), []).append((q, v))
            sides = {}
            for length, qs in by_length.items():
                m = np.array([v for _, v in qs], dtype=np.float64)
                sides[length] = (np.array([q for q, _ in qs]), m / np.linalg.norm(m, axis=1, keepdims=True))
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
                lengths = np.array([len(x) if x.is_valid else -1 for x in lists])
                for length, (qs, m) in sides.items():
                    at = np.flatnonzero(lengths == length)
                    if not at.size:
                        continue
                    x = np.array([[np.nan if c is None else c for c in v] for v in lists.take(pa.array(at)).to_pylist()], dtype=np.float64)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        d = 1 - m @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                    for row, q in enumerate(qs.tolist()):
                        ok = ~np.isnan(d[row])
                        dist, who = d[row][ok], ids[at][ok]
                        if q in best:
                            dist, who = np.concatenate((best[q][0], dist)), np.concatenate((best[q][1], who))
                        keep = np.lexsort((who, np.round(dist, 12)))[:k]
                        best[q] = dist[keep], who[keep]
            cols = [(q, int(w), float(x)) for q, (dist, who) in best.items() for x, w in zip(dist, who)]
            yield pa.RecordBatch.from_arrays([pa.array([c[j] for c in cols], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "distance"])

        found = vectors.select(F.col(id_column).cast("bigint"), vector).where(F.col(id_column).isNotNull()).mapInArrow(run, "query_id bigint, id bigint, distance double")
        if blocks > 1:
            ranked = Window.partitionBy("query_id").orderBy(F.round("distance", 12), "id")
            found = checkpointed(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("rank"))
            handle.destroy()
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 12), "id")
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


@dataclass
class TextQuery:
    """A web-style query: all terms, quoted phrases, alternatives with ``or``, exclusions with a minus."""

    any_of: list[tuple[list[str], bool]]

    @staticmethod
    def of(text: str) -> TextQuery:
        groups: list[list[tuple[list[str], bool]]] = [[]]
        for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text.lower()):
            if word == "or" and not minus:
                groups.append([])
                continue
            terms = re.findall(r"[^\W_]+", phrase or word)
            if terms:
                groups[-1].append((terms, minus == "-"))
        return TextQuery([g for g in groups if g])  # type: ignore[arg-type]

    def matches(self, tokens: Column) -> Column:
        """Whether a token array fulfils the query; an empty query matches nothing."""
        out = F.lit(False)
        joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
        for group in self.any_of:
            every = F.lit(True)
            for terms, negated in group:
                hit = F.array_contains(tokens, terms[0]) if len(terms) == 1 else F.contains(joined, F.lit(f" {' '.join(terms)} "))
                every = every & (~hit if negated else hit)
            out = out | every
        return out

    def hits(self, tokens: Column) -> Column:
        """Occurrences of the wanted terms."""
        terms = sorted({t for g in self.any_of for ts, negated in g if not negated for t in ts})
        return F.size(F.filter(tokens, lambda w: w.isin(*terms))).cast("bigint") if terms else F.lit(0).cast("bigint")


#: Fixed value: weight of a word without a label in a cover.
COVER_WEIGHT = 0.1


def covers(tokens: list[str], groups: list[list[list[str]]]) -> list[tuple[int, int, int]]:
    """(first, last, hits) of the shortest spans that hold every phrase of one group; spans do not hold each other.

    One pass: a span ends where the latest occurrences of a group's phrases first begin later than those of the span before.
    """
    phrases = {tuple(p) for g in groups for p in g}
    wanted = {w for p in phrases for w in p}
    hits, latest, out = [], {}, []
    for at, word in enumerate(tokens):
        if word not in wanted:
            continue
        hits.append(at)
        for p in phrases:
            if p[-1] == word and at + 1 >= len(p) and tuple(tokens[at + 1 - len(p) : at + 1]) == p:
                latest[p] = at + 1 - len(p)
        begin = max((min(latest[tuple(p)] for p in g) for g in groups if g and all(tuple(p) in latest for p in g)), default=-1)
        if begin > (out[-1][0] if out else -1):
            out.append((begin, at, len(hits) - bisect_left(hits, begin)))
    return out


def cover_density(tokens: Column, query: str) -> Column:
    """Rank of a token array by cover density: each shortest span counts ``COVER_WEIGHT``, divided by one more than the
    words in it that were not asked for. Exclusions play no part; 0 without a span. Arrow batches, for rows that match."""
    groups = [[terms for terms, negated in g if not negated] for g in TextQuery.of(query).any_of]

    @F.pandas_udf("double")
    def rank(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ts: 0.0 if ts is None else float(sum(COVER_WEIGHT / (1 + (b - a) - (n - 1)) for a, b, n in covers(list(ts), groups))))

    return rank(tokens)


def keyword_rank(chunks: DataFrame, query: str, k: int, id_column: str = "chunk_id", text: str = "content") -> DataFrame:
    """The k matching rows by term hits per word (a stand-in for cover density: only its order is used), ties by id."""
    q = TextQuery.of(query)
    found = chunks.withColumn("_tokens", words(F.col(text))).where(q.matches(F.col("_tokens")))
    scored = found.withColumn("hits", q.hits(F.col("_tokens"))).withColumn("text_score", F.round(F.col("hits") / F.size("_tokens"), 9)).drop("_tokens")
    return scored.orderBy(F.desc("text_score"), id_column).limit(k)


def search_products(chunks: DataFrame, kept: DataFrame, completeness: DataFrame, query_vector: list[float] | None, query_text: str | None, pool: int = POOL, limit: int = LIMIT) -> DataFrame:
    """(product_id, score, vector_rank, keyword_rank, best_chunk_id), best first.

    chunks: chunk_id, product_id, embedding, content; kept: product_id of those that pass the requirements; completeness:
    product_id, completeness. Both pools are cut on rows before the best row of each product is taken. A product in neither
    pool is dropped. The single-partition windows run over at most ``pool`` rows.
    """
    eligible = chunks.join(kept.select("product_id"), "product_id", "left_semi")
    order = lambda *c: Window.partitionBy(F.lit(1)).orderBy(*c)

    def best(rows: DataFrame, name: str, *by: Column) -> DataFrame:
        ranked = rows.withColumn("rank", F.row_number().over(order(*by)).cast("bigint"))
        return ranked.groupBy("product_id").agg(F.min("rank").alias(f"{name}_rank"), F.min_by("chunk_id", "rank").alias(f"{name}_chunk"))

    empty = eligible.limit(0).select("product_id", F.lit(0).cast("bigint").alias("rank"), "chunk_id")
    none = lambda name: empty.groupBy("product_id").agg(F.min("rank").alias(f"{name}_rank"), F.min("chunk_id").alias(f"{name}_chunk"))
    v = best(nearest(eligible, query_vector, pool), "vector", F.col("distance"), F.col("chunk_id")) if query_vector else none("vector")
    t = best(keyword_rank(eligible, query_text, pool), "keyword", F.desc("text_score"), F.col("chunk_id")) if query_text else none("keyword")
    both = v.join(t, "product_id", "full").join(completeness, "product_id", "left")
    share = lambda c: F.coalesce(1.0 / (RANK_OFFSET + F.col(c)), F.lit(0.0))
    score = share("vector_rank") + share("keyword_rank") + F.lit(TRUST) * F.coalesce(F.col("completeness").cast("double"), F.lit(0.0))
    out = both.select("product_id", F.round(score, 9).alias("score"), "vector_rank", "keyword_rank", F.coalesce("vector_chunk", "keyword_chunk").alias("best_chunk_id"))
    return out.orderBy(F.desc("score"), "product_id").limit(limit)


def match_chunks(chunks: DataFrame, query_vector: list[float], products: DataFrame, k: int = GROUNDING) -> DataFrame:
    """The k chunks of given products nearest to a query, for grounding an answer."""
    return nearest(chunks.join(products.select("product_id").distinct(), "product_id", "left_semi"), query_vector, k)
