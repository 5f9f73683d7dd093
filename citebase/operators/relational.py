"""Relational building blocks of the fact store: latest rows, supersede chains, rates, trees and graphs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citebase.session import checkpointed


#: Rows of a list of rules, requirements or engines that are written into a plan at once.
LIST_BOUND = 10_000


def _literal(value, kind: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array(*(_literal(v, kind.elementType) for v in value)).cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map(*(x for k, v in value.items() for x in (_literal(k, kind.keyType), _literal(v, kind.valueType)))).cast(kind)
    return F.lit(value).cast(kind)


def with_each(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Every row with each row of a list, as an exploded literal: a map over the rows, no join.

    The list is a vocabulary or what one search asks for; one of more than ``LIST_BOUND`` rows is put to the rows in parts.
    """
    kind, listed, parts = T.ArrayType(few.schema), few.collect(), []
    for k in range(0, len(listed) or 1, LIST_BOUND):
        some = listed[k : k + LIST_BOUND]
        values = F.array(*(F.struct(*(_literal(r[f.name], f.dataType).alias(f.name) for f in few.schema)) for r in some)).cast(kind) if some else F.array().cast(kind)
        parts.append(rows.withColumn("_each", F.explode(values)).select(*rows.columns, *(F.col(f"_each.{c}").alias(c) for c in few.columns)))
    return reduce(DataFrame.unionByName, parts)


def latest_per_key(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` columns for each key; null keys form a group of their own.

    An aggregate with ``max_by`` instead of a window: combined before the shuffle, so a hot key sends one row a task.
    """
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest)).select(*log.columns)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key is not there yet; among new rows of one key the first by all columns."""
    fresh = new.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    rest = [c for c in new.columns if c not in keys]
    if not rest:
        return fresh.distinct()
    one = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r"))
    return one.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*new.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows with the new rows put in their place by key."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def supersede_chain(log: DataFrame, keys: Sequence[str], order: Sequence[str], id_column: str, values: Sequence[str] = (), slices: Column | None = None) -> DataFrame:
    """Each row with ``superseded_by`` (the next row of its key), ``is_current``, ``is_first`` and, given values, ``is_change``.

    A row whose values equal those before it (nulls alike) is no change. ``slices`` is a column that never falls along the
    order (a day of its time): windows then run within key and slice, and the ends of the slices are joined by their
    summaries, so a key that holds any share of the rows is spread over its slices.
    """
    now = F.struct(*values) if values else F.struct(F.lit(1))
    sliced = log.withColumn("_slice", F.lit(0) if slices is None else slices)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    out = sliced.withColumn("_next", F.lead(id_column).over(w)).withColumn("_before", F.lag(F.struct(now.alias("v"))).over(w))
    if slices is None:
        out = out.withColumn("_first", F.lit(None).cast(log.schema[id_column].dataType)).withColumn("_last", F.col("_before"))
    else:
        ends = sliced.groupBy(*keys, "_slice").agg(F.min_by(id_column, F.struct(*order)).alias("_a"), F.max_by(F.struct(now.alias("v")), F.struct(*order)).alias("_z"))
        v = Window.partitionBy(*keys).orderBy("_slice")
        ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_s"), F.lead("_a").over(v).alias("_first"), F.lag("_z").over(v).alias("_last"))
        same = F.col("_slice").eqNullSafe(F.col("_s"))
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = out.join(ends, same)
    before = F.coalesce("_before", "_last")
    following = F.coalesce("_next", "_first")
    out = out.withColumn("superseded_by", following).withColumn("is_current", following.isNull())
    if values:
        out = out.withColumn("is_change", before.isNull() | ~before["v"].eqNullSafe(now))
    return out.select(*log.columns, "superseded_by", "is_current", *(["is_change"] if values else []), before.isNull().alias("is_first"))


def orphan_keys(log: DataFrame, keys: Sequence[str], current: Column, order: Sequence[str], id_column: str) -> DataFrame:
    """(keys, promoted): for keys without any current row, the newest row to be made current."""
    return log.groupBy(*keys).agg(F.bool_or(F.coalesce(current, F.lit(False))).alias("any"), F.max_by(id_column, F.struct(*order)).alias("promoted")).where("not any").drop("any")


def rate(n: Column, d: Column) -> Column:
    """n / d, null for an empty denominator: no data is not 0 %."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def rates_by(rows: DataFrame, group: str, hit: Column, counted: Column | None = None, label: str = "overall") -> DataFrame:
    """(group, hits, total, rate) for each group and over all, in one pass of grouping sets.

    Rows with a null group are labelled ``unknown`` and count in the overall row. No rows give an overall row with rate null.
    """
    counted = F.lit(True) if counted is None else counted
    flags = rows.select(F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias(group), F.coalesce(hit & counted, F.lit(False)).alias("_hit"), F.coalesce(counted, F.lit(False)).alias("_counted"))
    # a row that counts for nothing keeps the overall row where there is no other
    none = rows.sparkSession.range(1).select(F.lit("").alias(group), F.lit(False).alias("_hit"), F.lit(False).alias("_counted"), F.lit(False).alias("_real"))
    flags = flags.withColumn("_real", F.lit(True)).unionByName(none)
    sets = flags.groupingSets([[F.col(group)], []], F.col(group)).agg(F.count_if("_hit").alias("hits"), F.count_if("_counted").alias("total"), F.grouping_id().alias("_g"), F.bool_or("_real").alias("_real"))
    return sets.where("_g <> 0 or _real").select(F.when(F.col("_g") == 0, F.col(group)).otherwise(F.lit(label)).alias(group), "hits", "total", F.round(rate(F.col("hits"), F.col("total")), 6).alias("rate"))


def ancestors(tree: DataFrame) -> DataFrame:
    """(id, path, is_cycle): each node's codes from itself to the root, closest first.

    ``tree`` has id, parent_id, code. Walks all nodes up one level a round, so rounds are the tree's depth. A node whose
    parent is missing ends there; one whose walk comes back to a node of its own path ends there too, with ``is_cycle``.
    """
    up = tree.select(F.col("id").alias("at"), F.col("parent_id").alias("above"), F.col("code").alias("code_at"))
    walk = tree.select("id", F.col("parent_id").alias("next"), F.array("code").alias("path"), F.array("id").alias("seen"))
    ended = lambda df, cycle: df.select("id", "path", F.lit(cycle).alias("is_cycle"))
    done, open_ = [ended(walk.where("next is null"), False)], walk.where("next is not null")
    while not open_.isEmpty():
        step = open_.join(up, F.col("next") == F.col("at"), "left").withColumn("back", F.array_contains("seen", F.col("next")))
        step = checkpointed(step.select("id", "at", "back", "path", "code_at", "above", "seen"))
        done += [ended(step.where("back"), True), ended(step.where("not back and at is null"), False)]
        walk = step.where("not back and at is not null").select("id", F.col("above").alias("next"), F.concat("path", F.array("code_at")).alias("path"), F.concat("seen", F.array("at")).alias("seen"))
        done.append(ended(walk.where("next is null"), False))
        open_ = walk.where("next is not null")
    return reduce(DataFrame.unionByName, done)


def reachable(edges: DataFrame, start: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(node, hop): nodes reachable from the start nodes and their distance, breadth first, up to the fixed point.

    ``edges`` has a, b (directed, repeated ones count once), ``start`` has node. Edges are parted by their start once and
    kept so; each round shuffles only the frontier, which holds each node once, and lineage is cut every round.
    """
    seen = checkpointed(start.select("node").distinct().withColumn("hop", F.lit(0).cast("bigint")))
    frontier, hop = seen.select("node"), 0
    steps = checkpointed(edges.select("a", "b").distinct()).repartition("a").persist(StorageLevel.MEMORY_AND_DISK)
    while max_hops is None or hop < max_hops:
        hop += 1
        new = frontier.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        new = checkpointed(new.withColumn("hop", F.lit(hop).cast("bigint")))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new.select("node")
        if hop % 10 == 0:
            seen = checkpointed(seen)
    steps.unpersist()
    return seen


def applicable(items: DataFrame, rules: DataFrame, code: str, codes: str) -> DataFrame:
    """Item-rule pairs whose code is among the rule's codes; a rule without codes holds for every item.

    An equi-join on the exploded codes instead of an overlap condition; the universal rules, a part of the vocabulary, are
    put to every item as an exploded literal.
    """
    listed = rules.where(F.size(F.coalesce(F.col(codes), F.array())) > 0).withColumn("_code", F.explode(F.array_distinct(codes)))
    universal = rules.where(F.size(F.coalesce(F.col(codes), F.array())) <= 0)
    a = items.join(listed, items[code] == listed["_code"]).drop("_code")
    return a.select(*items.columns, *rules.columns).unionByName(with_each(items, universal))


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, slices: Column | None = None) -> DataFrame:
    """Rows with the sum of a value over their key's rows so far; with ``slices`` a busy key is spread, as in the chain."""
    sliced = rows.withColumn("_v", value).withColumn("_slice", F.lit(0) if slices is None else slices)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = sliced.withColumn("_sum", F.sum("_v").over(w))
    if slices is None:
        return out.withColumn(name, F.col("_sum")).select(*rows.columns, name)
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_t"))
    v = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_s"), F.sum("_t").over(v).alias("_before"))
    same = F.col("_slice").eqNullSafe(F.col("_s"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    total = F.when(F.col("_sum").isNotNull() | F.col("_before").isNotNull(), F.coalesce("_sum", F.lit(0)) + F.coalesce("_before", F.lit(0)))
    return out.join(totals, same).withColumn(name, total).select(*rows.columns, name)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: Sequence[str], slices: Column | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time.

    One union, one sort by key and time, and a running ``last``: no range join. At equal times the right row comes first.
    With ``slices`` (a column that never falls along the time) a busy key is spread: what a slice does not hold comes from
    the last right row of the slices before it.
    """
    a = left.select(*left.columns, *(F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values), F.lit(1).alias("_side"))
    b = right.select(*(F.col(c) if c in (key, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), *(F.col(v).alias(f"_{v}") for v in values), F.lit(0).alias("_side"))
    both = a.unionByName(b).withColumn("_slice", F.lit(0) if slices is None else slices)
    w = Window.partitionBy(key, "_slice").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.col("_side") == 0, F.struct(*(F.col(f"_{v}").alias(v) for v in values)))
    seen = both.withColumn("_r", F.last(said, ignorenulls=True).over(w))
    if slices is not None:
        ends = both.groupBy(key, "_slice").agg(F.max_by(said, F.when(F.col("_side") == 0, F.col(at))).alias("_z"))
        v = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(F.col(key).alias("_k"), F.col("_slice").alias("_s"), F.last("_z", ignorenulls=True).over(v).alias("_e"))
        seen = seen.join(ends, F.col(key).eqNullSafe(F.col("_k")) & F.col("_slice").eqNullSafe(F.col("_s"))).withColumn("_r", F.coalesce("_r", "_e"))
    return seen.where("_side = 1").select(*left.columns, *(F.col(f"_r.{v}").alias(f"right_{v}") for v in values))


def within_ceiling(rows: DataFrame, keys: Sequence[str], order: Sequence[str], cost: Column, ceiling: float, name: str = "so_far", slices: Column | None = None) -> DataFrame:
    """Rows of each key in order as long as their costs together stay within a ceiling, with the sum so far.

    Costs are not negative, so the rows kept are the first ones; a null cost counts as nothing.
    """
    return running_sum(rows, keys, order, F.coalesce(cost, F.lit(0)), name, slices).where(F.col(name) <= ceiling)


def with_id(rows: DataFrame, keys: Sequence[str], name: str = "id") -> DataFrame:
    """Rows with an id made of their key columns: what an insert gives back. Equal keys have equal ids, nulls included."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("?")) for k in keys]
    return rows.withColumn(name, F.sha2(F.to_json(F.array(*parts)), 256))


def status_update(rows: DataFrame, updates: DataFrame, key: str, at: Column, stamps: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows with the status of their update; columns named in ``keep`` take the update's value where it has one.

    ``stamps`` maps a timestamp column to the status that sets it: the time of the update where it has that status, else
    what it was. Rows without an update stay as they are; of several updates of a key the greatest counts.
    """
    new = ["status", *keep]
    one = updates.groupBy(key).agg(F.max(F.struct(*new)).alias("_u"))
    out = rows.join(one, key, "left")
    given = F.col("_u").isNotNull()
    values = {"status": F.when(given, F.col("_u.status")).otherwise(F.col("status"))}
    values |= {c: F.coalesce(f"_u.{c}", F.col(c)) for c in keep}
    values |= {c: F.when(F.col("_u.status") == status, at).otherwise(F.col(c)) for c, status in stamps.items()}
    return out.select(*(values.get(c, F.col(c)).alias(c) for c in rows.columns))


def sessions(events: DataFrame, key: str, at: str, gap: str, slices: Column) -> DataFrame:
    """(key, start, end, n) of runs of events with at most ``gap`` between neighbours.

    Sessions are first made within key and slice of time (``slices`` never falls along the time), so a busy key is spread;
    then those that touch across the slices' borders are joined, over the far fewer sessions. Rows with a null time are
    in no session.
    """
    wait = F.expr(f"interval {gap}")
    near = events.where(F.col(at).isNotNull()).groupBy(key, slices.alias("_slice"), F.session_window(at, gap)).agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("start")
    opens = F.coalesce(F.col("start") > F.lag("end").over(w) + wait, F.lit(True))
    numbered = near.withColumn("_s", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_s").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_s")


def where_given(rows: DataFrame, **values) -> DataFrame:
    """Rows that have the given values; a value that is None asks for nothing, so the filter is left out of the plan."""
    for column, value in values.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows
