"""URL filter: host and path rules first, then the ratio of two character language models.

URLs that a rule decides are the training set: allowed ones fit one model, blocked ones the
other. A model counts the character runs of length 1 to ``ORDER`` and smooths a character's
probability from the longest context down (Witten-Bell), so the order in use varies with what
was seen. The score of a URL is the mean over its characters of the log ratio of both models,
so it does not depend on length. The cut is the score that best parts the two
classes on held-back training URLs. DataFrame operations only: runs are counted where they
are read, and scores are looked up once per distinct run, not once per character.

Defined cases: a null URL, or one without "://", has empty host and path and no rule; with only
one class in training, or none, the method allows; ties of rules cannot occur, as equally long
rules that fit a URL are the same. An empty URL scores 0. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

ORDER = 5
#: Character alternatives of the uniform base distribution.
ALPHABET = 256
#: One part in so many of the training URLs is held back to set the cut.
FOLDS = 5
#: Width of a score bin while the cut is searched; scores are clipped to +-RANGE.
BIN, RANGE = 0.01, 10.0


def host_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased text after the first "://" up to / ? # and the path up to ? #."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verb, text in sorted(rules, key=lambda r: len(r[1])):
        site, slash, tail = text.partition("/")
        fits = ((host == site) | F.endswith(host, F.lit("." + site))) & F.startswith(path, F.lit(slash + tail))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(verb)).otherwise(verdict)
    return rule, verdict


def windows(url: Column) -> Column:
    """For every character, the run of up to ORDER characters that ends with it; ^ marks the begin."""
    padded = F.concat(F.lit("^"), F.coalesce(url, F.lit("")))
    size = F.length(padded)
    return F.when(size > 1, F.transform(
        F.sequence(F.lit(2), size),
        lambda e: F.substr(padded, F.greatest(e - ORDER + 1, F.lit(1)), F.least(e, F.lit(ORDER))))).otherwise(F.array().cast("array<string>"))


def counts(grams: DataFrame) -> DataFrame:
    """Counts of all suffixes of ``grams(gram, good, bad)``: run, good, bad."""
    cut = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda k: F.substr(F.col("gram"), F.length("gram") - k + 1, k))
    return (grams.select("good", "bad", F.explode(cut).alias("run"))
            .groupBy("run").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))


def log_ratio(grams: DataFrame, wanted: DataFrame) -> DataFrame:
    """Log of the ratio of both smoothed probabilities for each distinct ``wanted(gram)``: gram, llr."""
    runs = counts(grams)
    context = (runs.where(F.length("run") > 1)
               .groupBy(F.expr("substring(run, 1, length(run) - 1)").alias("context"))
               .agg(*[a for c in ("good", "bad") for a in (
                   F.sum(c).alias(f"{c}_all"), F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(f"{c}_kinds"))]))
    total = runs.where(F.length("run") == 1).agg(*[a for c in ("good", "bad") for a in (
        F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_all"), F.coalesce(F.sum(F.when(F.col(c) > 0, 1).otherwise(0)), F.lit(0)).alias(f"{c}_kinds"))])
    # One row for each run: its own counts and those of its context.
    known = (runs.withColumn("context", F.expr("substring(run, 1, length(run) - 1)"))
             .join(context, "context", "left"))
    base = total.first()  # four numbers
    known = known.select("run", *[F.struct(
        F.col(c).cast("double").alias("n"),
        F.when(F.length("run") == 1, F.lit(base[f"{c}_all"])).otherwise(F.coalesce(f"{c}_all", F.lit(0))).cast("double").alias("all"),
        F.when(F.length("run") == 1, F.lit(base[f"{c}_kinds"])).otherwise(F.coalesce(f"{c}_kinds", F.lit(0))).cast("double").alias("kinds")).alias(c)
        for c in ("good", "bad")])
    # A run that was not counted may still have a context that was.
    ends = wanted.select("gram", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.length("gram")), lambda k: F.substr(F.col("gram"), F.length("gram") - k + 1, k))).alias("k", "run"))
    # A single character has the empty context, which is never looked up: longer than any context, its key scatters these rows.
    ends = ends.withColumn("context", F.when(F.col("k") == 0, F.rpad("gram", ORDER, "^")).otherwise(F.expr("substring(run, 1, length(run) - 1)")))
    lone = context.select("context", *[F.struct(
        F.lit(0.0).alias("n"), F.col(f"{c}_all").cast("double").alias("all"), F.col(f"{c}_kinds").cast("double").alias("kinds")).alias(f"{c}_lone")
        for c in ("good", "bad")])
    steps = ends.join(known, "run", "left").join(lone, "context", "left")
    zero = {c: F.struct(F.lit(0.0).alias("n"), F.when(F.col("k") == 0, F.lit(float(base[f"{c}_all"]))).otherwise(0.0).alias("all"),
                        F.when(F.col("k") == 0, F.lit(float(base[f"{c}_kinds"]))).otherwise(0.0).alias("kinds")) for c in ("good", "bad")}
    steps = steps.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct(
        "k", *[F.coalesce(c, f"{c}_lone", zero[c]).alias(c) for c in ("good", "bad")]))).alias("steps"))  # at most ORDER entries

    def smoothed(c):
        def add(p, s):
            kinds, seen, n = s[c]["kinds"], s[c]["all"], s[c]["n"]
            return F.when(seen + kinds > 0, (n + kinds * p) / (seen + kinds)).otherwise(p)

        return F.aggregate("steps", F.lit(1.0 / ALPHABET), add)

    return steps.select("gram", F.log(smoothed("good") / smoothed("bad")).alias("llr"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict, llr (null where no model could be built)."""
    host, path = host_path(F.col(url))
    rule, given = longest_rule(F.col("host"), F.col("path"), rules)
    rows = materialise(
        pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
        .withColumn("rule", rule).withColumn("given", given)
        .withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS))), "url_rows")
    train = rows.where("given IS NOT NULL AND fold > 0")
    grams = (train.select((F.col("given") == "allow").cast("long").alias("good"), F.explode(windows(F.col("url"))).alias("gram"))
             .groupBy("gram").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")))
    # Scored: what no rule decides, and the held-back part of the rest.
    # Few bytes become many runs: the number of partitions is set before, or short URLs would meet in one task.
    # Were it the session's own, the planner would take the step for a repetition of the one below distinct() and drop it.
    spread = 2 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.where("given IS NULL OR fold = 0").select("url").distinct().repartition(spread, "url")
    parts = materialise(
        asked.select("url", F.explode(windows(F.col("url"))).alias("gram")).groupBy("url", "gram").count(), "url_runs")
    grams = materialise(grams, "url_grams")
    ratio = log_ratio(grams, parts.select("gram").distinct())
    scores = materialise(
        parts.join(ratio, "gram").groupBy("url")
        .agg((F.sum(F.col("llr") * F.col("count")) / F.sum("count")).alias("llr")), "url_scores")
    cut = threshold(rows.where("given IS NOT NULL AND fold = 0").join(scores, "url"))
    both = grams.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    usable = bool(both["good"]) and bool(both["bad"])
    scored = rows.join(scores, "url", "left").withColumn("llr", F.coalesce("llr", F.lit(0.0)) if usable else F.lit(None).cast("double"))
    own = F.when(F.col("llr") < cut, "block").otherwise("allow") if usable else F.lit("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "llr")


def threshold(held: DataFrame) -> float:
    """The cut with the best mean of both classes' hit rates: below it is blocked. 0 without both classes."""
    bins = held.groupBy(F.floor(F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.col("llr"))) / BIN).alias("bin")).agg(
        F.sum((F.col("given") == "allow").cast("long")).alias("good"), F.sum((F.col("given") != "allow").cast("long")).alias("bad"))
    found = sorted(bins.collect())  # at most 2 * RANGE / BIN + 1 rows
    good, bad = sum(r["good"] for r in found), sum(r["bad"] for r in found)
    if not good or not bad:
        return 0.0
    best, cut, below_good, below_bad = -1.0, 0.0, 0, 0
    for at, r in enumerate(found):
        hit = (good - below_good) / good + below_bad / bad
        # Between two bins, the middle of the gap.
        edge = r["bin"] if at == 0 else (found[at - 1]["bin"] + 1 + r["bin"]) / 2
        if hit > best:
            best, cut = hit, edge * BIN
        below_good, below_bad = below_good + r["good"], below_bad + r["bad"]
    if 1 + 0.0 > best:
        cut = (found[-1]["bin"] + 1) * BIN
    return float(cut)
