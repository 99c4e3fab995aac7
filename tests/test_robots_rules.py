"""Rules of robots files: search in sorted lists against one test per rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siteloom.functions.prefixes import longest_prefix, prefix_lists
from siteloom.sources import robots as R


def test_longest_prefix_against_all_prefixes(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab/é") for _ in range(n))
    rows = [(k, word(rng.randint(1, 6)), rng.random() < 0.5) for k in "xyz" for _ in range(40)] + [("x", None, None), (None, "a", True), ("e", None, None)]
    tried = [(k, word(rng.randint(0, 9))) for k in ("x", "y", "z", "e") for _ in range(80)]
    lists = prefix_lists(spark.createDataFrame(rows, "k string, p string, v boolean"), ["k"], "p", "v")
    assert lists.where("k IS NULL").count() == 1 and lists.count() == 5
    got = spark.createDataFrame(tried, "k string, t string").join(lists, "k").select("k", "t", longest_prefix(F.col("prefixes"), F.col("t")).alias("hit")).collect()
    assert len(got) == len(tried)
    for r in got:
        fits = [p for k, p, _ in rows if k == r.k and p is not None and r.t.startswith(p)]
        best = max(fits, key=len, default=None)
        want = None if best is None else (len(best), max(v for k, p, v in rows if k == r.k and p == best))
        assert (None if r.hit is None else tuple(r.hit)) == want, r


def _verdict(rules, target):
    fits = []
    for allow, rule in rules:
        body, end = (rule[:-1], "$") if rule.endswith("$") else (rule, "")
        if re.match(".*".join(map(re.escape, body.split("*"))) + end, target):
            fits.append((len(rule), allow))
    return max(fits, default=(0, True))[1]


def test_can_fetch_against_one_test_per_rule(spark):
    rng = random.Random(9)
    part = lambda: rng.choice(["/", "/a", "/b", "a", "b", "/en/", "1", "$", "*", ".pdf", "?q="])
    rules = {a: [(rng.random() < 0.5, "/" + "".join(part() for _ in range(rng.randint(0, 4)))) for _ in range(60)] for a in ("one", "*")}
    body = "".join(f"User-agent: {a}\n" + "".join(f"{'Allow' if ok else 'Disallow'}: {r}\n" for ok, r in rs) for a, rs in rules.items())
    files = spark.createDataFrame([("h", body), ("none", "User-agent: one\n")], "host string, body string")
    targets = sorted({"/" + "".join(rng.choice(["/", "a", "b", "/en/", "1", ".pdf", "$"]) for _ in range(rng.randint(0, 6))) for _ in range(150)})
    pages = spark.createDataFrame([("h", f"https://h{t}") for t in targets] + [("none", "https://none/a")], "host string, url string")
    for r in R.can_fetch(pages, files, ["ONE/2", "two"], ["host"]).collect():
        want = True if r.host == "none" else _verdict(rules["one" if r.agent == "ONE/2" else "*"], r.url[len("https://h"):])
        assert r.can_fetch == want, r


@pytest.mark.parametrize("rules", [20_000])
def test_many_plain_rules(spark, rules):
    body = "User-agent: *\n" + "".join(f"Disallow: /shop/{i}/\n" for i in range(rules)) + "Allow: /shop/7/ok\n"
    files = spark.createDataFrame([("c", "r", body)], "crawl_id string, robots_url string, body string")
    paths = spark.range(20_000).selectExpr("'c' AS crawl_id", "concat('/shop/', id * 2, '/', IF(id % 2 = 0, 'ok', 'x')) AS path")
    joined = paths.join(R.rule_arrays(files), "crawl_id").select(R.blocked_by(F.col("rules"), "path").alias("b"))
    assert joined.where("b").count() == rules // 2
