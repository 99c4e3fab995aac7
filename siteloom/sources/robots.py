"""robots.txt bodies: directive rows, rules for an agent, can-fetch decisions, sitemap lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siteloom.functions import urls
from siteloom.functions import constants as K
from siteloom.functions.prefixes import longest_prefix, prefix_lists

# Directives that make a text a robots file.
_KNOWN = ("user-agent", "allow", "disallow", "sitemap", "crawl-delay", "host", "clean-param", "request-rate", "visit-time")

_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def robots_lines(robots: DataFrame) -> DataFrame:
    """robots(crawl_id, robots_url, body) to one row per line.

    ``text`` is the line without its comment; ``directive`` and ``content``
    are null on lines without a colon.
    """
    keys = [c for c in robots.columns if c != "body"]
    lines = robots.select(*keys, F.posexplode(F.split("body", _LINE_BREAK)).alias("i", "line"))
    text = F.trim(F.regexp_replace(F.substring_index("line", "#", 1), r"\s", " "))
    has = F.col("text").contains(":")
    return lines.select(*keys, (F.col("i") + 1).alias("line_no"), "line", text.alias("text")).withColumns({
        "directive": F.when(has, F.lower(F.trim(F.substring_index("text", ":", 1)))),
        "content": F.when(has, F.trim(F.regexp_replace("text", r"^[^:]*:", ""))),
    })


def rejected_files(robots: DataFrame) -> DataFrame:
    """Robots files that give no rule, one row each: the columns of ``robots`` but for its body, ``raw``, ``reason``.

    A file without a body was not fetched; markup is a page that was served in place of the file. A
    blank body is sound: it allows everything. ``raw`` is the whole body.
    """
    keys = [c for c in robots.columns if c != "body"]
    named = F.rlike("body", F.lit(rf"(?i)(?:^|{_LINE_BREAK})[ \t]*(?:{'|'.join(_KNOWN)})[ \t]*:"))
    reason = (
        F.when(F.col("body").isNull(), "no body")
        .when(F.rlike("body", F.lit(r"(?is)^[\s\ufeff]*<(?:!doctype|html|head|body|\?xml|!--)")), "markup")
        .when(F.contains("body", F.lit("\0")), "binary content")
        .when(F.rlike("body", F.lit(r"(?m)^[ \t]*[^#\s]")) & ~named, "no known directive"))
    return robots.withColumn("_reason", reason).where("_reason IS NOT NULL").select(*keys, F.col("body").alias("raw"), F.col("_reason").alias("reason"))


def directive_table(robots: DataFrame) -> DataFrame:
    """Non-blank directive rows, as parsed."""
    return robots_lines(robots).where("directive IS NOT NULL")


def directive_counts(robots: DataFrame) -> DataFrame:
    return directive_table(robots).groupBy("directive").agg(F.count("*").alias("n"))


def agent_rules(robots: DataFrame) -> DataFrame:
    """Allow and Disallow rows with the agent line they follow.

    The ordering is per robots file, whose size one cell bounds.
    """
    keys = [c for c in robots.columns if c != "body"]
    lines = Window.partitionBy(*keys).orderBy("line_no")
    agent = F.last(F.when(F.col("directive") == "user-agent", F.col("content")), ignorenulls=True).over(lines)
    return (
        directive_table(robots).withColumn("agent", agent)
        .where("directive IN ('allow', 'disallow')")
        .select(*keys, "line_no", "agent", "directive", F.col("content").alias("rule"))
    )


def disallowed(robots: DataFrame) -> DataFrame:
    """Disallow rules that govern every agent."""
    return agent_rules(robots).where("agent = '*' AND directive = 'disallow' AND rule <> ''")


def _pattern(rule: Column, end: Column) -> Column:
    """A rule with '*': what stands before the first '*', and the regular expression."""
    escaped = F.regexp_replace(rule, r"([^A-Za-z0-9_*])", r"\\$1")
    return F.struct(F.substring_index(rule, "*", 1).alias("head"),
                    F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), end).alias("pattern"))


def _matches(target: Column, rule: Column) -> Column:
    """Most addresses fail at the head; the expression is not run for them."""
    return F.startswith(target, rule["head"]) & F.rlike(target, rule["pattern"])


def rule_arrays(robots: DataFrame) -> DataFrame:
    """(crawl_id, rules): the disallow rules of a crawl, the plain ones as a sorted list, those with '*' as patterns."""
    wild = F.col("rule").contains("*")
    rules = disallowed(robots).select(
        "crawl_id", F.when(~wild, F.col("rule")).alias("plain"), F.lit(False).alias("allow"),
        F.when(wild, _pattern(F.col("rule"), F.lit(""))).alias("patterns"))
    return prefix_lists(rules, ["crawl_id"], "plain", "allow", ["patterns"]).select("crawl_id", F.struct("prefixes", "patterns").alias("rules"))


def blocked_by(rules, path) -> Column:
    """Any rule that matches the start of ``path``; only rules with '*' need a pattern."""
    p = F.col(path) if isinstance(path, str) else path
    return longest_prefix(rules["prefixes"], p).isNotNull() | F.exists(rules["patterns"], lambda r: _matches(p, r))


def sitemap_lines(robots: DataFrame) -> DataFrame:
    """(crawl_id, pos, loc): addresses of the Sitemap lines."""
    found = F.regexp_extract_all("body", F.lit(K.SITEMAP_LINE), F.lit(1))
    return robots.select("crawl_id", F.posexplode(found).alias("pos", "loc"))


# ---- can-fetch by RFC 9309 ------------------------------------------------
def agent_groups(robots: DataFrame) -> DataFrame:
    """(keys, agent, rules): every agent with the rules of all its groups merged.

    Consecutive agent lines share the rules that follow; an agent keeps an
    empty rule list if none do.
    """
    keys = [c for c in robots.columns if c != "body"]
    order = Window.partitionBy(*keys).orderBy("line_no")
    relevant = directive_table(robots).where("directive IN ('user-agent', 'allow', 'disallow')")
    is_agent = F.col("directive") == "user-agent"
    starts = is_agent & ~F.coalesce(F.lag("directive").over(order) == "user-agent", F.lit(False))
    grouped = relevant.withColumn("starts", starts.cast("int")).withColumn("g", F.sum("starts").over(order))
    rule = F.struct(F.col("content").alias("rule"), (F.col("directive") == "allow").alias("allow"))
    blocks = grouped.groupBy(*keys, "g").agg(
        F.collect_set(F.when(is_agent, F.lower("content"))).alias("agents"),
        F.collect_list(F.when(~is_agent & (F.col("content") != ""), rule)).alias("rules"))
    return (
        blocks.select(*keys, F.explode("agents").alias("agent"), "rules")
        .groupBy(*keys, "agent").agg(F.flatten(F.collect_list("rules")).alias("rules"))
    )


def group_lists(robots: DataFrame) -> DataFrame:
    """(keys, agent, prefixes, patterns): the rules of every agent, plain ones sorted for search, the others as patterns with length and verdict."""
    keys = [c for c in robots.columns if c != "body"]
    rules = agent_groups(robots).select(*keys, "agent", F.explode_outer("rules").alias("r")).select(*keys, "agent", "r.*")
    rule = F.col("rule")
    odd = rule.contains("*") | rule.endswith("$")
    bare = F.regexp_replace(rule, r"\$$", "")
    pattern = F.struct(F.length("rule").alias("len"), F.col("allow").alias("value"),
                       _pattern(bare, F.when(rule.endswith("$"), "$").otherwise("")).alias("p"))
    kinds = rules.select(*keys, "agent", "allow", F.when(~odd, rule).alias("plain"), F.when(odd, pattern).alias("patterns"))
    return prefix_lists(kinds, [*keys, "agent"], "plain", "allow", ["patterns"])


def can_fetch(pages: DataFrame, robots: DataFrame, agents: list[str], on: list[str]) -> DataFrame:
    """Every page for every agent: may it be fetched?

    ``pages`` carry ``url`` and the columns ``on`` that name their robots file.
    The group with the longest product token that stands in the agent string wins, in any case
    of letters, else '*'; in it the longest matching rule, Allow on equal length. No file and no match mean yes.
    Plain rules are searched for, so their number hardly matters; rules with '*' or a last '$' are tried in turn.
    """
    per_file = group_lists(robots).groupBy(*on).agg(
        F.map_from_entries(F.collect_list(F.struct("agent", F.struct("prefixes", "patterns")))).alias("groups"))
    target = F.concat(
        F.when(urls.full_path("url") == "", "/").otherwise(urls.full_path("url")),
        F.when(urls.query("url") != "", F.concat(F.lit("?"), urls.query("url"))).otherwise(""))
    asked = pages.withColumn("target", target).join(per_file, on, "left").select(
        *pages.columns, "target", "groups", F.explode(urls.literals(agents)).alias("agent"))
    tokens = F.filter(F.map_keys("groups"), lambda t: (t != "*") & (t != "") & F.contains(F.lower("agent"), t))
    best_token = F.array_max(F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    rules = F.coalesce(F.try_element_at("groups", best_token), F.try_element_at(F.col("groups"), F.lit("*")))
    tried = F.filter(F.col("_rules")["patterns"], lambda r: _matches(F.col("target"), r["p"]))
    odd = F.array_max(F.transform(tried, lambda r: F.struct(r["len"].alias("len"), r["value"].alias("value"))))
    plain = longest_prefix(F.col("_rules")["prefixes"], F.col("target"))
    best = F.array_max(F.array(odd, plain))
    return asked.withColumn("_rules", rules).withColumn("can_fetch", F.coalesce(best["value"], F.lit(True))).drop("groups", "target", "_rules")
