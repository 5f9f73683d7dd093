"""Web diagnostics: robots rules, crawlability, links and whether a value stands on its page."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citebase.functions.numbers import text_forms
from citebase.functions.web import NO_PAGES, crawl_prefix, first_segment, hrefs, resolve, visible_text
from citebase.operators.relational import reachable

#: The crawlers of answer engines that are checked.
CRAWLERS = [
    "GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "Claude-User", "Claude-SearchBot", "PerplexityBot", "Perplexity-User", "Google-Extended", "Applebot-Extended", "CCBot", "meta-externalagent", "Bingbot"
]


def robots_rules(files: DataFrame) -> DataFrame:
    """(file_id, group, agents, directive, pattern, position) of robots files (file_id, robots_txt).

    Consecutive user-agent lines head one group; a rule closes it to further agents; rules before any agent are ignored.
    Groups are numbered by a running count of the lines that open one.
    """
    lines = files.select("file_id", F.posexplode(F.split("robots_txt", r"\r\n|\r|\n")).alias("at", "raw"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", ""))).where(F.contains("line", F.lit(":")))
    lines = lines.select("file_id", "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("directive"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))
    lines = lines.where(F.col("directive").isin("user-agent", "allow", "disallow"))
    w = Window.partitionBy("file_id").orderBy("at")
    opens = (F.col("directive") == "user-agent") & F.coalesce(F.lag("directive").over(w) != "user-agent", F.lit(True))
    lines = lines.withColumn("group", F.sum(opens.cast("int")).over(w)).where("group > 0")
    heads = lines.where("directive = 'user-agent'").groupBy("file_id", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("agents"))
    rules = lines.where("directive <> 'user-agent'").select("file_id", "group", "directive", F.col("value").alias("pattern"), F.col("at").alias("position"))
    return heads.join(rules, ["file_id", "group"], "left")


def rule_regex(pattern: Column) -> Column:
    """A rule's path pattern as a regular expression: ``*`` matches anything, a last ``$`` anchors, an empty one nothing."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.array_join(F.transform(F.split(body, r"\*", -1), lambda p: F.when(p == "", "").otherwise(F.concat(F.lit(r"\Q"), p, F.lit(r"\E")))), ".*")
    return F.when(pattern == "", "(?!)").otherwise(F.concat(F.lit("^"), quoted, F.when(anchored, "$").otherwise("")))


def evaluate_robots(files: DataFrame, requests: DataFrame) -> DataFrame:
    """(file_id, user_agent, path, allowed, matched_rule, matched_group) of each request (file_id, user_agent, path).

    Groups that name the agent beat those for ``*``; all that apply are merged; the longest matching pattern wins, on a tie
    allow, else the first; without a match a path is allowed.
    """
    rules = robots_rules(files)
    both = requests.join(rules, "file_id", "left")
    exact = F.exists("agents", lambda a: (F.lower(a) == F.lower(F.col("user_agent"))) & (a != "*"))
    both = both.withColumn("exact", F.coalesce(exact, F.lit(False))).withColumn("star", F.coalesce(F.array_contains("agents", "*"), F.lit(False)))
    key = ["file_id", "user_agent", "path"]
    both = both.withColumn("named", F.bool_or("exact").over(Window.partitionBy(*key))).withColumn("applies", F.when(F.col("named"), F.col("exact")).otherwise(F.col("star")))
    hit = F.col("applies") & F.col("pattern").isNotNull() & F.coalesce(F.regexp_like("path", rule_regex(F.col("pattern"))), F.lit(False))
    order = F.struct(F.length("pattern"), (F.col("directive") == "allow").cast("int"), -F.col("position"))
    rule = F.struct("directive", "pattern", "agents")
    best = both.groupBy(*key).agg(F.max_by(F.when(hit, rule), F.when(hit, order)).alias("best"), F.min_by(F.when(F.col("applies"), F.col("agents")), F.when(F.col("applies"), F.col("group"))).alias("first"))
    return best.select(
        *key,
        F.coalesce(F.col("best.directive") == "allow", F.lit(True)).alias("allowed"),
        F.when(F.col("best.directive").isNotNull(), F.concat(F.initcap("best.directive"), F.lit(": "), F.col("best.pattern"))).alias("matched_rule"),
        F.array_join(F.coalesce("best.agents", "first"), ", ").alias("matched_group"),
    )


def crawlability(fetches: DataFrame, agents: list[str] | None = None) -> DataFrame:
    """(file_id, user_agent, allowed) for every crawler: 200 is evaluated, 404 counts as an empty file, else unknown (null).

    fetches: file_id, status_code, robots_txt, path.
    """
    each = fetches.select("file_id", "status_code", "robots_txt", "path", F.explode(F.array(*(F.lit(a) for a in agents or CRAWLERS))).alias("user_agent"))
    files = fetches.select("file_id", F.when(F.col("status_code") == 200, F.coalesce("robots_txt", F.lit(""))).otherwise("").alias("robots_txt"))
    known = F.col("status_code").isin(200, 404)
    verdict = evaluate_robots(files, each.select("file_id", "user_agent", "path"))
    return each.select("file_id", "user_agent", "status_code").join(verdict, ["file_id", "user_agent"], "left").select("file_id", "user_agent", F.when(F.coalesce(known, F.lit(False)), F.col("allowed")).alias("allowed"))


def links(pages: DataFrame, html: str = "html", prefix: Column | None = None) -> DataFrame:
    """(page_id, position, href, url): every anchor resolved against its page; duplicates kept.

    The url is null for files, other schemes and, given a prefix, for what lies outside it.
    """
    each = pages.select("page_id", "url", F.posexplode(hrefs(F.col(html))).alias("position", "href"))
    target = resolve(F.col("url"), F.col("href"))
    return each.select("page_id", F.col("position").cast("bigint").alias("position"), "href", F.when(~target.rlike(NO_PAGES) & (F.lit(True) if prefix is None else target.startswith(prefix)), target).alias("url"))


def value_visible(claims: DataFrame) -> DataFrame:
    """Claims (value_numeric, value_text, value_bool and visible or html) with ``found``: whether the value stands in the text.

    Numbers must stand as words of their own, with point or comma; texts anywhere; flags cannot be told (null). Give the
    page's visible text as ``visible`` where many claims share a page, so that it is made once.
    """
    text = F.col("visible") if "visible" in claims.columns else visible_text(F.col("html"))
    quoted = F.array_join(F.transform(text_forms(F.col("value_numeric")), lambda v: F.concat(F.lit(r"\Q"), v, F.lit(r"\E"))), "|")
    edge = r"[^\p{L}\p{N}_]"
    number = F.regexp_like(text, F.concat(F.lit(rf"(?:^|{edge})(?:"), quoted, F.lit(rf")(?:$|{edge})")))
    found = F.when(F.col("value_numeric").isNotNull(), number).when(F.col("value_text").isNotNull(), F.contains(F.lower(text), F.lower("value_text")))
    return claims.withColumn("found", found)


def crawl(pages: DataFrame, start: str, max_pages: int | None = None) -> DataFrame:
    """(url, hop) of the pages reached from a start page by links below its path; each page once, breadth first.

    pages: page_id, url, html of what can be fetched. A link to a page that is not there leads nowhere. The crawl goes on
    until nothing new is found; ``max_pages``, where given, keeps the nearest ones, ties by URL.
    """
    prefix = crawl_prefix(F.lit(start))
    bare = pages.withColumn("url", F.regexp_replace("url", r"[?#].*$", ""))
    edges = links(bare, prefix=prefix).where("url is not null").join(bare.select("page_id", F.col("url").alias("a")), "page_id").select("a", F.col("url").alias("b"))
    there = bare.select(F.col("url").alias("node")).distinct()
    edges = edges.join(there.withColumnRenamed("node", "b"), "b", "left_semi")
    found = reachable(edges, there.where(F.col("node") == start)).select(F.col("node").alias("url"), "hop")
    return found if max_pages is None else found.orderBy("hop", "url").limit(max_pages)


def skip_reasons(pages: DataFrame, prefix: str, sections: list[str], known: DataFrame, least: int = 200) -> DataFrame:
    """(page_id, skip_reason): why a crawled page is not extracted; null for those that are.

    pages: page_id, url, text, sha256. Outside the product sections, too little text, unchanged (a known sha256), in that order.
    """
    there = known.select("sha256").distinct().withColumn("_known", F.lit(True))
    section = F.coalesce(first_segment(F.col("url"), prefix).isin(*sections), F.lit(False))
    reason = F.when(~section, "no product page").when(F.length(F.coalesce("text", F.lit(""))) < least, "too little text").when(F.col("_known"), "unchanged")
    return pages.join(there, "sha256", "left").select("page_id", reason.alias("skip_reason"))


def has_product(node) -> bool:
    """Whether a JSON-LD value holds an object of type Product, at any depth."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            kind = x.get("@type")
            if kind == "Product" or isinstance(kind, list) and "Product" in kind:
                return True
            todo.extend(x.values())
        elif isinstance(x, list):
            todo.extend(x)
    return False


_LINKED_DATA = re.compile(r"""<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script""", re.S | re.I)


def structured_product(html: Column) -> Column:
    """Whether a page marks up a product as structured data: JSON-LD of that type, or an itemtype of schema.org.

    Only pages with a linked-data script reach Python, in Arrow batches; scripts that are no JSON are passed over. Null is
    false.
    """

    @F.pandas_udf("boolean")
    def linked(pages: pd.Series) -> pd.Series:
        def one(text: str | None) -> bool:
            for body in _LINKED_DATA.findall(text or ""):
                try:
                    if has_product(json.loads(body)):
                        return True
                except ValueError:
                    continue
            return False

        return pages.map(one).astype(bool)

    item = F.coalesce(F.regexp_like(html, F.lit(r"""(?i)<[^>]*\sitemtype\s*=\s*["']?[^"'>\s]*schema\.org/Product\b""")), F.lit(False))
    # all others go to Python as null
    marked = F.when(F.contains(html, F.lit("ld+json")), html)
    return item | F.coalesce(linked(marked), F.lit(False))


def page_visibility(claims: DataFrame) -> DataFrame:
    """(page_id, found, missing, unchecked, structured) of each page's claims: how many stand in its visible text.

    claims: page_id, presence, values and visible or html, and structured. Claims that the page does not state play no part.
    """
    seen = value_visible(claims.where(F.coalesce(F.col("presence") != "not_stated", F.lit(True))))
    return seen.groupBy("page_id").agg(F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("missing"), F.count_if(F.col("found").isNull()).alias("unchecked"), F.bool_or("structured").alias("structured"))
