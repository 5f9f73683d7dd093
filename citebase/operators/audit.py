"""Answer audits: presence, share of voice, accuracy, coverage, competitive picture, gaps and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citebase.functions.text import mention_offset, own_brand
from citebase.functions.web import host
from citebase.operators.relational import ancestors, applicable, latest_per_key, rate, rates_by

#: Fixed value: share of stated attributes below which documentation counts as thin.
LOW_COMPLETENESS = 0.25
COMPARED = ("correct", "incorrect", "likely_confusion")


def mentions(answers: DataFrame, needles: list[str], text: str = "response_text") -> DataFrame:
    """Answers with ``mention_offset`` (earliest, 0-based) and ``mentioned``; a null text mentions nothing."""
    out = answers.withColumn("mention_offset", mention_offset(F.col(text), needles))
    return out.withColumn("mentioned", F.col("mention_offset").isNotNull())


def presence_rate(answers: DataFrame, group: str, needles: list[str], text: str = "response_text") -> DataFrame:
    """Share of answers that name the brand or an alias, by group and overall."""
    return rates_by(mentions(answers, needles, text), group, F.col("mentioned"))


def brand_mentions(claims: DataFrame, group: str) -> DataFrame:
    """One row for each answer and brand spelling (lower case, trimmed): answer_id, group, brand, is_competitor of the first."""
    keyed = claims.withColumn("brand", F.lower(F.trim("brand_name"))).where("brand <> ''")
    return keyed.groupBy("answer_id", group, "brand").agg(F.min_by("is_competitor", "claim_id").alias("is_competitor"), F.min_by("brand_name", "claim_id").alias("brand_name"))


def share_of_voice(claims: DataFrame, group: str) -> DataFrame:
    """Share of the own brand among distinct brand mentions, by group and overall."""
    return rates_by(brand_mentions(claims, group), group, ~F.coalesce("is_competitor", F.lit(False)))


def spec_accuracy(claims: DataFrame, group: str) -> DataFrame:
    """Correct share of the own brand's comparable claims; claims that cannot be verified are in no denominator."""
    return rates_by(claims.where(~F.coalesce("is_competitor", F.lit(False))), group, F.col("verdict") == "correct", F.col("verdict").isin(*COMPARED))


def coverage(products: DataFrame, attributes: DataFrame, facts: DataFrame, code: str = "category_code", codes: str = "category_codes", tree: DataFrame | None = None) -> DataFrame:
    """(product_id, stated, missing, completeness): attributes that apply to a product and whether a current fact states them.

    facts: product_id, spec_key, presence. With a tree of categories (id, parent_id, code) an attribute also applies to the
    categories below its own. A product to which nothing applies has completeness 0.0.
    """
    coded = products
    if tree is not None:  # each product under its category and all above it
        above = ancestors(tree).select(F.col("path")[0].alias("_own"), F.explode("path").alias("_above"))
        coded = products.join(above.distinct(), products[code] == F.col("_own"), "left").withColumn(code, F.coalesce("_above", code)).drop("_own", "_above")
    pairs = applicable(coded, attributes, code, codes).select("product_id", "spec_key").distinct()
    said = facts.where(F.col("presence").isin("stated", "derived", "manual")).select("product_id", "spec_key").distinct().withColumn("_said", F.lit(True))
    both = pairs.join(said, ["product_id", "spec_key"], "left")
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("spec_key"))))
    got = both.groupBy("product_id").agg(listed(F.col("_said").isNotNull()).alias("stated"), listed(F.col("_said").isNull()).alias("missing"))
    out = products.select("product_id").join(got, "product_id", "left")
    none = F.array().cast("array<string>")
    stated, missing = F.coalesce("stated", none), F.coalesce("missing", none)
    return out.select("product_id", stated.alias("stated"), missing.alias("missing"), F.coalesce(rate(F.size(stated), F.size(stated) + F.size(missing)), F.lit(0.0)).alias("completeness"))


def overall_completeness(covered: DataFrame, group: str) -> DataFrame:
    """Ratio of sums over the products of a group; 0.0 when nothing applies."""
    s, m = F.sum(F.size("stated")), F.sum(F.size("missing"))
    return covered.groupBy(group).agg(s.alias("stated"), m.alias("missing"), F.round(F.coalesce(rate(s, s + m), F.lit(0.0)), 6).alias("completeness"))


def data_completeness(pairs: DataFrame, owner: str) -> DataFrame:
    """Stated share of the applicable pairs of an owner in three decimals; 0 when there are none. pairs: owner, stated."""
    share = F.coalesce(rate(F.count_if("stated"), F.count("stated")), F.lit(0.0))
    return pairs.groupBy(owner).agg(share.cast("decimal(20,10)").cast("decimal(4,3)").alias("completeness"))


def competitive_picture(claims: DataFrame, group: str, audited: str) -> DataFrame:
    """Mentions and verdict counts for each group and brand; spellings of the audited brand are one brand."""
    own = own_brand(F.col("brand_name"), audited)
    named = claims.withColumn("brand", F.when(own, audited).otherwise(F.col("brand_name"))).where(F.col("brand").isNotNull()).withColumn("brand_key", F.lower(F.trim("brand")))
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    per = named.groupBy(group, "brand_key").agg(
        F.count_distinct("answer_id").alias("mentions"), count("correct"), count("incorrect"), count("likely_confusion"), F.count_if(F.col("verdict").startswith("unverifiable")).alias("unverifiable")
    )
    return per.orderBy(group, F.desc("mentions"), "brand_key")


def worst_findings(claims: DataFrame, k: int = 10, truth: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
    """The k wrong claims of the own brand: plainly incorrect before confusions, oldest first.

    ``truth``, one row for a key ``on``, adds where the right value is cited, where that is known; joined after the cut.
    """
    wrong = claims.where(F.col("verdict").isin("incorrect", "likely_confusion"))
    top = wrong.orderBy((F.col("verdict") == "incorrect").desc(), "created_at", "claim_id").limit(k)
    return top if truth is None else top.join(truth, on, "left")


def documentation_gaps(claims: DataFrame, *by: str) -> DataFrame:
    """Own claims whose spec the documentation does not state, counted by the given columns."""
    own = claims.where(~F.coalesce("is_competitor", F.lit(False)) & (F.col("verdict") == "unverifiable_spec"))
    return own.groupBy(*by).agg(F.count("*").alias("gaps"))


def latest_gaps(checks: DataFrame, keys: list[str], order: list[str], found: Column) -> DataFrame:
    """Keys whose latest check found nothing: the latest first, then the filter. An undetermined check is no gap."""
    return latest_per_key(checks, keys, order).where(F.coalesce(~found, F.lit(False)))


def ranked_tasks(branches: list[tuple[DataFrame, int]]) -> DataFrame:
    """(branch, task, n, impact, effort, priority) of several branches of counts, in order of impact by effort.

    Each branch has task and n and its effort; impact is half of n rounded up, 3 at most. Ties keep the branch order.
    """
    out = None
    for at, (rows, effort) in enumerate(branches):
        part = rows.select(F.lit(at).cast("bigint").alias("branch"), "task", F.col("n").cast("bigint").alias("n"), F.least(F.lit(3), F.ceil(F.col("n") / 2)).cast("bigint").alias("impact"), F.lit(effort).cast("bigint").alias("effort"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("priority", F.round(F.col("impact") / F.col("effort"), 6)).orderBy(F.desc("priority"), "branch", F.desc("n"), "task")


def remediation(crawlers: DataFrame, gaps: DataFrame, checks: DataFrame, findings: DataFrame) -> DataFrame:
    """The ranked list of what to mend: (branch, task, n, impact, effort, priority), see ``ranked_tasks``.

    crawlers: user_agent, allowed; those shut out are one task of full impact. gaps: task (a spec that documents do not
    state); checks: task (a product), found (its value stands on its page); findings: task (a spec that answers get wrong).
    """
    count = lambda rows: rows.where(F.col("task").isNotNull()).groupBy("task").agg(F.count("*").alias("n"))
    listed = ranked_tasks([(crawlers.limit(0).select(F.col("user_agent").alias("task"), F.lit(0).alias("n")), 1), (count(gaps), 1), (count(checks.where("not found")), 2), (count(findings), 3)])
    shut = crawlers.where("allowed = false").agg(F.array_join(F.array_sort(F.collect_set("user_agent")), ", ").alias("task"), F.count_distinct("user_agent").alias("n")).where("n > 0")
    first = shut.select(F.lit(0).cast("bigint").alias("branch"), "task", "n", F.lit(3).cast("bigint").alias("impact"), F.lit(1).cast("bigint").alias("effort"), F.lit(3.0).alias("priority"))
    return first.unionByName(listed).orderBy(F.desc("priority"), "branch", F.desc("n"), "task")


def problem_statement(counts: DataFrame, audited: str) -> DataFrame:
    """One row that states how the audited brand compares with the strongest other. counts: brand, mentions."""
    total = counts.groupBy("brand").agg(F.sum("mentions").cast("bigint").alias("m"))
    own = F.coalesce(F.sum(F.when(F.col("brand") == audited, F.col("m"))), F.lit(0))
    rival = F.col("brand") != audited
    one = total.agg(own.cast("bigint").alias("own"), F.max_by(F.when(rival, F.col("brand")), F.when(rival, F.struct(F.col("m"), -F.crc32(F.col("brand")), F.col("brand")))).alias("top_brand"), F.max(F.when(rival, F.col("m"))).alias("top"))
    text = (
        F.when((F.col("own") == 0) & F.col("top").isNull(), "no brand is named")
        .when(F.col("own") == 0, F.concat(F.lit(audited), F.lit(" is never named, "), F.col("top_brand"), F.lit(" is")))
        .when(F.col("top").isNull(), F.concat(F.lit(audited), F.lit(" is the only brand named")))
        .when(F.col("top") > F.col("own"), F.concat(F.col("top_brand"), F.lit(" is named more often than "), F.lit(audited)))
        .otherwise(F.concat(F.lit(audited), F.lit(" is named most")))
    )
    return one.select("own", "top_brand", "top", text.alias("statement"))


def citation_domains(answers: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """(domain, citations, answers) of the cited URLs, each counted as often as it is cited; resolved: url, target."""
    each = answers.select("answer_id", F.explode("citations").alias("url"))
    if resolved is not None:
        each = each.join(resolved, "url", "left").withColumn("url", F.coalesce("target", "url"))
    return each.withColumn("domain", F.regexp_replace(F.coalesce(host(F.col("url")), F.lit("unknown")), r"^www\.", "")).groupBy("domain").agg(F.count("*").alias("citations"), F.count_distinct("answer_id").alias("answers"))


def citation_buckets(answers: DataFrame, own_domain: str) -> DataFrame:
    """(answer_id, bucket): own_site if any citation is on the own domain, third_party for others, no_citation for none."""
    urls = F.coalesce("citations", F.array().cast("array<string>"))
    own = F.exists(urls, lambda u: F.coalesce(F.contains(host(u), F.lit(own_domain)), F.lit(False)))
    return answers.select("answer_id", F.when(F.size(urls) == 0, "no_citation").when(own, "own_site").otherwise("third_party").alias("bucket"))


def model_visibility(answers: DataFrame, needles: list[str]) -> DataFrame:
    """(engine, run_id, prompts, mentions, rate, missed) of the latest run of each engine; missed: prompts that never name the brand.

    answers: engine, run_id, prompt_id, answer_id, created_at, response_text. A run is as late as its latest answer.
    """
    runs = answers.groupBy("engine", "run_id").agg(F.max(F.struct("created_at", "answer_id")).alias("at"))
    last = runs.groupBy("engine").agg(F.max_by("run_id", "at").alias("run_id"))
    own = mentions(answers.join(last, ["engine", "run_id"], "left_semi"), needles)
    per = own.groupBy("engine", "run_id", "prompt_id").agg(F.bool_or("mentioned").alias("named"))
    out = per.groupBy("engine", "run_id").agg(F.count("*").alias("prompts"), F.count_if("named").alias("mentions"), F.array_sort(F.collect_list(F.when(~F.col("named"), F.col("prompt_id")))).alias("missed"))
    return out.withColumn("rate", F.round(rate(F.col("mentions"), F.col("prompts")), 6))


def mention_rate(answers: DataFrame, group: str, needles: list[str]) -> DataFrame:
    """(group, answers, mentions, mention_rate): 0.0 where a group has no answers, as in the older reports."""
    m = mentions(answers, needles)
    n = F.count_if(F.col("answer_id").isNotNull())
    return m.groupBy(group).agg(n.alias("answers"), F.count_if("mentioned").alias("mentions"), F.round(F.coalesce(rate(F.count_if("mentioned"), n), F.lit(0.0)), 6).alias("mention_rate"))


def critical_notes(claims: DataFrame, completeness: DataFrame) -> DataFrame:
    """(position, note, figure): how far the figures of an audit can be trusted.

    claims: is_competitor, verdict; completeness: one row with completeness. Wrong claims, or that none was proven wrong among
    those that could be checked; thin documentation; claims that the documentation does not cover. At least one note.
    """
    own = claims.where(~F.coalesce("is_competitor", F.lit(False)))
    wrong, checked = F.col("verdict").isin("incorrect", "likely_confusion"), F.col("verdict").isin(*COMPARED)
    figures = own.agg(F.count_if(wrong).alias("wrong"), F.count_if(checked).alias("checked"), F.count_if(F.col("verdict").startswith("unverifiable")).alias("open")).withColumn("_one", F.lit(0))
    both = completeness.select(F.col("completeness").cast("double").alias("share"), F.lit(0).alias("_one")).join(figures, "_one", "right")
    note = lambda at, c, text, figure: F.when(c, F.struct(F.lit(at).cast("bigint").alias("position"), F.lit(text).alias("note"), figure.cast("double").alias("figure")))
    notes = F.array(
        note(0, F.col("wrong") > 0, "wrong claims", F.col("wrong")),
        note(1, F.col("wrong") == 0, "no claim proven wrong among those checked", F.col("checked")),
        note(2, F.col("share") < LOW_COMPLETENESS, "documentation covers few attributes", F.col("share")),
        note(3, F.col("open") > 0, "claims that the documentation cannot check", F.col("open")),
    )
    return both.select(F.explode(F.filter(notes, lambda x: x.isNotNull())).alias("n")).select("n.*")
