"""Work queues and runs: claiming, retries with a growing wait, dead letters, review, run checks and batches with failures."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Seconds added for each attempt, and attempts that count at most.
BACKOFF, BACKOFF_ATTEMPTS = 30, 5


def due(jobs: DataFrame, now: Column, kinds: list[str] | None = None) -> DataFrame:
    """Pending jobs whose time has come, of the given kinds or of any."""
    ready = jobs.where((F.col("status") == "pending") & (F.col("run_after") <= now))
    return ready if kinds is None else ready.where(F.col("kind").isin(*kinds))


def claim(jobs: DataFrame, now: Column, worker: str, kinds: list[str] | None = None, n: int = 1) -> DataFrame:
    """Jobs with the first n due ones (by priority, time and id) running under a worker, their attempts one up.

    A top-k and a join with its n rows. One owner applies it at a time (a micro-batch), so no job is claimed twice.
    """
    taken = due(jobs, now, kinds).orderBy("priority", "run_after", "id").limit(n).select(F.col("id").alias("_taken"))
    mine = F.col("_taken").isNotNull()
    out = jobs.join(taken, F.col("id") == F.col("_taken"), "left")
    new = {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "locked_at": now, "locked_by": F.lit(worker)}
    return out.select(*((F.when(mine, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in jobs.columns))


def finish(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Jobs after their results (id, error): succeeded without an error, else pending again after a wait, or dead.

    The wait is ``BACKOFF`` seconds for each attempt up to ``BACKOFF_ATTEMPTS``; a job is dead once it had ``max_attempts``.
    Of several results of a job the greatest error counts. Jobs without a result stay as they are.
    """
    one = results.groupBy(F.col("id").alias("_id")).agg(F.max("error").alias("_error"))
    out = jobs.join(one, F.col("id") == F.col("_id"), "left")
    done, failed = F.col("_id").isNotNull(), F.col("_error").isNotNull()
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.least("attempts", F.lit(BACKOFF_ATTEMPTS)) * BACKOFF).cast("decimal(18,6)"))
    new = {
        "status": F.when(failed, F.when(F.col("attempts") >= F.col("max_attempts"), "dead").otherwise("pending")).when(done, "succeeded").otherwise(F.col("status")),
        "last_error": F.when(failed, F.col("_error")).otherwise(F.col("last_error")),
        "run_after": F.when(failed, now + wait).otherwise(F.col("run_after")),
    }
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in jobs.columns))


def dead_letters(jobs: DataFrame) -> DataFrame:
    """The jobs that will not be tried again, with their last error: the queue's side output."""
    return jobs.where("status = 'dead'").select("id", "kind", "attempts", "last_error")


def review(findings: DataFrame, pages: DataFrame, decisions: DataFrame, keys: DataFrame) -> DataFrame:
    """(finding_id, state): rejected (not quoted on its page), new, promoted or dismissed; ``unknown key`` for a bad promotion.

    findings: finding_id, page_id, source_snippet; pages: page_id, page_text; decisions: finding_id, spec_key (null: dismissed);
    keys: spec_key. Only what stands on its page is queued; a promotion needs a key that exists. Of several decisions on a
    finding the greatest key counts.
    """
    from citebase.functions.text import quoted

    known = keys.select("spec_key", F.lit(True).alias("_known")).distinct()
    decided = decisions.groupBy("finding_id").agg(F.max("spec_key").alias("spec_key"), F.lit(True).alias("_decided")).join(known, "spec_key", "left")
    rows = findings.select("finding_id", "page_id", "source_snippet").join(pages.select("page_id", "page_text"), "page_id", "left").join(decided, "finding_id", "left")
    cited = F.coalesce((F.col("source_snippet") != "") & quoted(F.col("page_text"), F.col("source_snippet")), F.lit(False))
    state = F.when(~cited, "rejected").when(F.col("_decided").isNull(), "new").when(F.col("spec_key").isNull(), "dismissed").when(F.col("_known"), "promoted").otherwise("unknown key")
    return rows.select("finding_id", state.alias("state"))


def require_run(runs: DataFrame, run_id: str, brand: str | None = None) -> None:
    """Fails if a run does not exist, or belongs to another brand than the report is asked for."""
    row = runs.where(F.col("run_id") == run_id).select("run_id", *(["brand_id"] if brand is not None else [])).first()
    if row is None:
        raise LookupError(f"no run {run_id}")
    if brand is not None and row.brand_id != brand:
        raise ValueError(f"run {run_id} is of brand {row.brand_id}, not of {brand}")


def run_guard(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """(request_id, problem): what ``require_run`` says of many requests (request_id, run_id, brand_id) at once; null if nothing."""
    known = runs.select("run_id", F.col("brand_id").alias("_owner"), F.lit(True).alias("_there"))
    rows = requests.join(known, "run_id", "left")
    return rows.select("request_id", F.when(F.col("_there").isNull(), "no such run").when(~F.col("brand_id").eqNullSafe(F.col("_owner")), "another brand's run").alias("problem"))


def run_plan(expected: DataFrame, answers: DataFrame, max_answers: int) -> DataFrame:
    """(run_id, expected, answered, next, status): what a run still has to ask, and whether it is done.

    expected: run_id, expected; answers: run_id. A run is ``succeeded`` once it has as many answers as expected; the next
    pass asks what is missing, up to ``max_answers``.
    """
    got = answers.groupBy("run_id").agg(F.count("*").alias("answered"))
    rows = expected.join(got, "run_id", "left").withColumn("answered", F.coalesce("answered", F.lit(0)))
    missing = F.greatest(F.col("expected") - F.col("answered"), F.lit(0))
    return rows.select("run_id", "expected", "answered", F.least(missing, F.lit(max_answers)).cast("bigint").alias("next"), F.when(missing == 0, "succeeded").otherwise("running").alias("status"))


def apply_each(items: DataFrame, work: Callable[[dict], Iterable[dict]], key: str, schema: str) -> DataFrame:
    """The rows that the host's work makes of each item, with the item's key; a failing item gives one row with ``error``.

    Nothing of a failed item is kept, and it does not end the others: its rows are made whole before any is given on.
    """
    kind = items.schema[key].dataType.simpleString()
    full = items.sparkSession.createDataFrame([], f"{key} {kind}, error string, {schema}").schema
    kinds, columns = to_arrow_schema(full), items.columns

    def run(batches):
        for b in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in b.columns)):
                item = dict(zip(columns, values))
                try:
                    out += [{**r, key: item[key], "error": None} for r in list(work(item))]
                except Exception as e:  # the item's own failure
                    out.append({key: item[key], "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return items.mapInArrow(run, full)


def failure_summary(results: DataFrame, key: str) -> DataFrame:
    """(error, items, first): how many items failed with each error, and the least of them; null error: the ones that went well."""
    return results.groupBy("error").agg(F.count_distinct(key).alias("items"), F.min(key).alias("first"))
