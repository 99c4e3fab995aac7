"""The audit over many crawls: findings, checklist and summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siteloom.functions import constants as K
from siteloom.functions.urls import literals
from siteloom.operators import hosts as H
from siteloom.operators.groups import top_n
from siteloom.plans import asset_checks as A, graph_checks as G, lab_checks as L, page_checks as P, site_checks as S
from siteloom.plans.catalogue import CHECKS, Check, LIVE_TIERS, as_array, of_kind
from siteloom.schema import conform, with_lists
from siteloom.session import materialise
from siteloom.sources.robots import rule_arrays

FINDING_COLUMNS = ["crawl_id", "num", "basis", "rank", "seq", "pos", "url"]

# Supplied tables and the columns the audit reads; an absent table reads as empty.
_INPUTS = {
    "robots": "crawl_id string, robots_url string, body string",
    "sitemap": "crawl_id string, seq bigint, loc string, errors string",
    "asset_status": "crawl_id string, url string, status bigint",
    "asset_body": "crawl_id string, url string, body string",
    "psi": "crawl_id string, url string, audit_id string, score double, numeric_value double",
    "render": "crawl_id string, url string, ok boolean, page_errors array<string>, title_at_load string, "
              "title_after_wait string, rendered_text_len bigint, nav_link_count bigint, "
              "hidden_text_len bigint, pseudo_content_count bigint, overlay boolean",
    "html": "crawl_id string, seq bigint, url string, html string",
}


@dataclass
class Audit:
    """One audit run over every crawl in ``crawl``.

    ``crawls`` has one row per crawl: crawl_id, is_discovery (null = unknown),
    available_signals (null = all), robots_url (null = not attempted),
    has_lighthouse, has_render, source. The other tables hold fetched data.

    ``lists`` (crawl_id, url, some of links, script_src, stylesheet_href, images) stands for these columns of all rows of
    an address, as imports supply it: checks of lists are then made once per address, however many rows it has.
    """

    crawl: DataFrame
    crawls: DataFrame
    robots: DataFrame | None = None
    sitemap: DataFrame | None = None
    asset_status: DataFrame | None = None
    asset_body: DataFrame | None = None
    psi: DataFrame | None = None
    render: DataFrame | None = None
    html: DataFrame | None = None
    lists: DataFrame | None = None
    checks: dict[int, Check] = field(default_factory=lambda: CHECKS)

    def __post_init__(self) -> None:
        for name, ddl in _INPUTS.items():
            if getattr(self, name) is None:
                setattr(self, name, self.spark.createDataFrame([], ddl))
        for name, kind in (
            ("is_discovery", "boolean"), ("available_signals", "array<string>"), ("robots_url", "string"),
            ("has_lighthouse", "boolean"), ("has_render", "boolean"), ("source", "string"),
        ):
            if name not in self.crawls.columns:
                self.crawls = self.crawls.withColumn(name, F.lit(None).cast(kind))
        self._tables: dict[str, DataFrame] = {}
        self._failed: dict[int, str] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.crawl.sparkSession

    def _shared(self, name: str, build) -> DataFrame:
        """Written once per run: several checks read it, and its size then steers the joins."""
        if name not in self._tables:
            self._tables[name] = materialise(build(), name)
        return self._tables[name]

    # ---- shared tables ---------------------------------------------------
    @property
    def pages(self) -> DataFrame:
        """The narrow page table, written once: hosts, index map and all checks that compare pages read it."""
        return self._shared("pages", lambda: G.narrow(self.crawl))

    @property
    def whole(self) -> DataFrame:
        """The crawl with the lists of its addresses in every row."""
        return self.crawl if self.lists is None else with_lists(self.crawl, self.lists)

    @property
    def addresses(self) -> DataFrame:
        """The crawl; if its rows share lists, one row per address with its lists and the place of its first row."""
        if self.lists is None:
            return self.crawl
        first = self.crawl.groupBy("crawl_id", "url").agg(F.min("seq").alias("seq"))
        return self._shared("addresses", lambda: with_lists(conform(first), self.lists))

    @property
    def linked(self) -> DataFrame:
        """The narrow page table with links: of pages, or of addresses that share them."""
        return self.pages if self.lists is None else self._shared("linked", lambda: G.narrow(self.addresses))

    def _of_rows(self, found: DataFrame) -> DataFrame:
        """Findings on :attr:`addresses` as findings on their rows."""
        if self.lists is None:
            return found
        return found.drop("seq").join(self.crawl.select("crawl_id", "seq", "url"), ["crawl_id", "url"]).select(*FINDING_COLUMNS)

    @property
    def hosts(self) -> DataFrame:
        return self._shared("hosts", lambda: H.crawl_hosts(self.pages))

    @property
    def primaries(self) -> DataFrame:
        return H.primary_hosts(self.hosts)

    @property
    def index(self) -> DataFrame:
        return self._shared("index", lambda: H.index_map(self.pages))

    @property
    def asset_uses(self) -> DataFrame:
        return self._shared("asset_uses", lambda: A.check_assets(A.page_assets(self.addresses)))

    @property
    def known_assets(self) -> DataFrame:
        return self._shared("known_assets", lambda: A.looked_up(self.asset_uses, self.asset_status, self.asset_body))

    @property
    def lab_entries(self) -> DataFrame:
        return self._shared("lab", lambda: L.lab_entries(self.psi))

    @property
    def first_seen(self) -> DataFrame:
        """(crawl_id, url, seq): the first fetch of each address that lab data or renders name."""
        def build():
            named = self.psi.select("crawl_id", "url").unionByName(self.render.select("crawl_id", "url")).distinct()
            return self.crawl.select("crawl_id", "url", "seq").join(named, ["crawl_id", "url"], "left_semi").groupBy(
                "crawl_id", "url").agg(F.min("seq").alias("seq"))
        return self._shared("first_seen", build)

    @property
    def robots_sitemaps(self) -> DataFrame:
        return A.robots_sitemaps(self.robots, self.asset_status)

    @property
    def host_variants(self) -> DataFrame:
        return A.host_variants(self.primaries, self.asset_status)

    @property
    def onclick(self) -> DataFrame:
        return self._shared("onclick", lambda: A.onclick_pages(self.html))

    # ---- findings by class -----------------------------------------------
    def page_findings(self, *kinds: str) -> DataFrame:
        nums = [n for n in of_kind(*kinds, checks=self.checks) if n not in self.failed]
        keys = self._shared("markup_keys", lambda: P.markup_keys(self.crawl))
        if self.lists is None:
            return P.page_findings(self.crawl, nums, self.checks, keys)
        own = [n for n in nums if self.checks[n].predicate]
        listed = [n for n in nums if n in P.OF_LISTS and n not in own]
        rest = [n for n in nums if n not in own and n not in listed]
        parts = [P.page_findings(table, chosen, self.checks, keys) for table, chosen in ((self.whole, own), (self.crawl, rest)) if chosen]
        if listed:
            parts.append(self._of_rows(P.page_findings(self.addresses, listed, self.checks, keys)))
        return G.union_all(parts)

    @property
    def failed(self) -> dict[int, str]:
        """A caller's own checks whose predicate ends in an error, and the error; each is tried once on its own."""
        if self._failed is None:
            self._failed = {}
            for num, check in self.checks.items():
                if check.predicate:
                    try:
                        P.page_columns(self.whole).agg(F.count_if(check.predicate())).collect()
                    except Exception as e:  # noqa: BLE001  whatever a caller's expression raises
                        self._failed[num] = f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
        return self._failed

    def join_findings(self) -> DataFrame:
        return G.union_all([
            G.canonical_to_non_indexable(self.pages, self.index),
            G.canonical_to_other_site(self.pages, self.hosts, self.primaries),
            self._of_rows(G.nofollow_to_indexable(self.linked, self.hosts, self.index)),
            G.indexable_url_patterns(self.pages, self.index),
            G.thin_sitemap_pages(self.pages, self.sitemap),
            G.sitemap_orphans(self.linked, self.sitemap, self.crawls),
        ])

    def window_findings(self) -> DataFrame:
        return G.union_all([
            G.parameter_order_changes(self.pages), G.parameter_variants(self.pages),
            G.pagination_explosion(self.pages),
        ])

    def site_findings(self) -> DataFrame:
        return G.union_all([
            S.robots_syntax(self.robots), S.robots_presence(self.crawls, self.robots),
            S.markup_types(self.crawl, self.primaries), S.sitemap_size(self.crawls, self.sitemap),
            S.sitemap_errors(self.sitemap),
        ])

    def asset_findings(self) -> DataFrame:
        return G.union_all([
            A.robots_blocked(self.asset_uses, self.robots), A.asset_findings(self.known_assets),
            A.status_findings(self.robots_sitemaps), A.status_findings(self.host_variants),
        ])

    def html_findings(self) -> DataFrame:
        return A.onclick_findings(self.onclick)

    def lab_findings(self) -> DataFrame:
        return L.lab_findings(self.lab_entries, self.first_seen)

    def render_findings(self) -> DataFrame:
        return L.render_findings(self.render, self.crawl, self.first_seen)

    # ---- the whole run -----------------------------------------------------
    def grid(self) -> DataFrame:
        """Every crawl with every check: 91 rows per crawl, gate applied."""
        rows = self.crawls.select(
            "crawl_id", "is_discovery", "available_signals", "robots_url", "source",
            *[F.coalesce(c, F.lit(False)).alias(c) for c in LIVE_TIERS.values()],
            F.inline(as_array(self.checks)))
        live = F.lit(False)
        for tier, flag in LIVE_TIERS.items():
            live = live | ((F.col("tier") == tier) & F.col(flag))
        missing = F.when(F.col("available_signals").isNull() | live, F.array().cast("array<string>")).otherwise(
            F.array_except("signals", "available_signals"))
        return rows.withColumn("missing", missing)

    @property
    def excluded(self) -> DataFrame:
        """(crawl_id, num, basis) not to be reported: gated checks, and static results lab data replaces.

        A few rows per crawl, written so that findings need no shuffle while it is small.
        """
        return self._shared("excluded", self._excluded)

    def _excluded(self) -> DataFrame:
        gated = self.grid().where(F.size("missing") > 0).select(
            "crawl_id", "num", F.explode(literals(("crawl", "static", "lab"))).alias("basis"))
        answered = L.lab_scope(self.lab_entries).select("crawl_id", "num", F.lit("static").alias("basis"))
        return gated.unionByName(answered)

    def findings(self) -> DataFrame:
        """One row per offending URL and check, gate and lab precedence applied."""
        return self._shared("findings", self._findings)

    def _findings(self) -> DataFrame:
        every = G.union_all([
            self.page_findings("row", "list", "fallback"), self.join_findings(), self.window_findings(),
            self.site_findings(), self.asset_findings(), self.html_findings(), self.lab_findings(),
            self.render_findings(),
        ])
        kept = every.where(F.col("num").isin(*self.checks))
        return kept.join(self.excluded, ["crawl_id", "num", "basis"], "left_anti").select(*FINDING_COLUMNS)

    def detail(self) -> DataFrame:
        """Findings with check title and tier, as listed in the report."""
        names = self.spark.range(1).select(F.inline(as_array(self.checks))).select("num", "check", "tier")
        # One row per check of the catalogue.
        return self.findings().join(F.broadcast(names), "num").select(
            "crawl_id", "num", "check", "tier", "rank", "seq", "pos", "url")

    def conditions(self) -> DataFrame:
        """One row per crawl: which inputs were there at all."""
        robots = self.robots.groupBy("crawl_id").agg(
            F.bool_or(F.col("body").isNotNull()).alias("has_robots"),
            F.bool_or(F.size(F.regexp_extract_all("body", F.lit(K.SITEMAP_LINE), F.lit(1))) > 0).alias("has_line"))
        rules = rule_arrays(self.robots).select("crawl_id", F.lit(True).alias("has_rules"))
        return (
            self.crawls.select("crawl_id")
            .join(robots, "crawl_id", "left").join(rules, "crawl_id", "left")
            .join(self.sitemap.groupBy("crawl_id").agg(F.count("*").alias("n_sitemap")).withColumn("has_sitemap", F.lit(True)), "crawl_id", "left")
            .join(self.render.groupBy("crawl_id").agg(F.count("*").alias("n_renders")).withColumn("has_renders", F.lit(True)), "crawl_id", "left")
            .join(self.crawl.groupBy("crawl_id").agg(
                F.count_if(F.size("preload_href") > 0).alias("n_preload"), F.bool_or(F.size("jsonld") > 0).alias("has_markup")), "crawl_id", "left")
            .join(self.html.select("crawl_id").distinct().withColumn("has_html", F.lit(True)), "crawl_id", "left")
            .join(self.primaries.select("crawl_id", "primary_host"), "crawl_id", "left")
        )

    def checklist(self) -> DataFrame:
        """One row per crawl and check: state, count, first five URLs, source, note."""
        found = self.findings()
        keys = ["crawl_id", "num"]
        counts = found.groupBy(*keys).agg(
            F.count("*").alias("affected"), F.bool_or(F.col("basis") == "lab").alias("by_lab"))
        order = [F.col("rank"), F.col("seq"), F.col("pos"), F.col("url")]
        shown = top_n(found, keys, order, K.EXAMPLE_URLS, rank="place").groupBy(*keys).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))),
                                     lambda e: e["url"]), "\n").alias("example_urls"))
        judged = A.scope(self.known_assets, self.robots_sitemaps, self.host_variants, self.onclick)
        rows = (
            self.grid()
            .join(counts, keys, "left").join(shown, keys, "left").join(judged, keys, "left")
            .join(L.lab_scope(self.lab_entries), keys, "left")
            .join(self.conditions(), "crawl_id", "left")
        )
        broke = F.lit(None).cast("string")
        for num, error in self.failed.items():
            broke = F.when(F.col("num") == num, F.lit(f"The check failed: {error}")).otherwise(broke)
        reason = F.coalesce(broke, _not_assessed())
        affected = F.coalesce("affected", F.lit(0))
        state = (
            F.when(reason.isNotNull(), K.NOT_ASSESSED)
            .when(affected == 0, K.NOT_PRESENT)
            .when(F.col("heuristic") & ~F.coalesce("by_lab", F.lit(False)), K.HEURISTIC)
            .otherwise(K.PRESENT)
        )
        source = F.when((F.col("kind") == "fallback") & F.col("assessed").isNotNull(), "PageSpeed Insights").when(
            F.size("missing") > 0, "dataset (field absent)").otherwise(F.col("detection_source"))
        return rows.select(
            "crawl_id", "num", "check", "tier", state.alias("status"), "explanation",
            affected.alias("affected_count"), F.coalesce("example_urls", F.lit("")).alias("example_urls"),
            source.alias("detection_source"), F.coalesce(reason, _note(), F.lit("")).alias("note"))

    def embedded_detail(self, build, n: int = K.DETAIL_ROWS_EMBEDDED) -> DataFrame:
        """``build(crawl)`` on the first ``n`` pages of each crawl, what a workbook can hold.

        The cut is made on (crawl_id, seq) before the report is computed; ``rows_in_all`` tells how many
        pages the crawl has.
        """
        places = self.crawl.select("crawl_id", "seq")
        kept = top_n(places, ["crawl_id"], [F.col("seq")], n)
        totals = places.groupBy("crawl_id").agg(F.count("*").alias("rows_in_all"))
        return build(self.whole).join(kept, ["crawl_id", "seq"], "left_semi").join(totals, "crawl_id")

    def configuration(self, detail_rows: int = K.DETAIL_ROWS_EMBEDDED) -> DataFrame:
        """(crawl_id, setting, value): what was active for each crawl; settings that do not apply have no row."""
        yes = lambda c, a, b: F.when(F.coalesce(c, F.lit(False)), a).otherwise(b)
        counted = lambda df, name: df.groupBy("crawl_id").agg(F.countDistinct("url").alias(name))
        c = (
            self.crawls.join(self.sitemap.select("crawl_id").distinct().withColumn("has_sitemap", F.lit(True)), "crawl_id", "left")
            .join(self.crawl.groupBy("crawl_id").agg(F.count("*").alias("n_rows")), "crawl_id", "left")
            .join(counted(self.lab_entries, "n_lab"), "crawl_id", "left").join(counted(self.render, "n_render"), "crawl_id", "left"))
        rows = F.coalesce("n_rows", F.lit(0))
        imported = F.col("available_signals").isNotNull()
        number = lambda n: F.coalesce(n, F.lit(0)).cast("string")
        settings = F.array(*[
            F.struct(F.lit(k).alias("setting"), v.alias("value")) for k, v in (
                ("audit_url_sample", F.lit("all")),
                ("Lighthouse (CWV tier)", yes("has_lighthouse", "enabled", "disabled")),
                ("Headless render (RENDER tier)", yes("has_render", "enabled", "disabled")),
                ("GSC / EXTERNAL tier", F.lit("disabled")),
                ("Backlink source", F.lit("disabled")),
                ("robots.txt fetched", yes(F.col("robots_url").isNotNull(), "yes", "no")),
                ("sitemap fetched", yes("has_sitemap", "yes", "no")),
                (K.SETTING_LAB, F.when(F.col("has_lighthouse"), number("n_lab"))),
                (K.SETTING_RENDER, F.when(F.col("has_render"), number("n_render"))),
                (K.SETTING_SOURCE, F.when(imported, F.coalesce("source", F.lit("")))),
                (K.SETTING_URLS, F.when(imported, rows.cast("string"))),
                (K.SETTING_SIGNALS, F.when(imported, F.array_join(F.array_sort("available_signals"), ", "))),
                (K.SETTING_DETAIL, F.when(rows > detail_rows, F.concat(
                    F.lit(f"first {detail_rows} of "), rows, F.lit(" URLs")))),
            )])
        return c.select("crawl_id", F.inline(settings)).where("value IS NOT NULL")


def _not_assessed() -> Column:
    """Why a check has no verdict in a crawl; null when it has one."""
    num, kind = F.col("num"), F.col("kind")
    absent = lambda c: ~F.coalesce(c, F.lit(False))
    attempted = F.col("robots_url").isNotNull()
    unresolved = (F.coalesce("chosen", F.lit(0)) > 0) & (F.coalesce("resolved", F.lit(0)) == 0)
    return (
        F.when(F.size("missing") > 0, F.concat(
            F.lit("Requires "), F.array_join("missing", ", "), F.lit(" data, which the "),
            F.coalesce("source", F.lit("imported")), F.lit(" dataset does not provide.")))
        .when(kind == "fixed", F.concat(F.lit("Needs a source that is not supplied: "), F.col("detection_source")))
        .when((num == 4) & absent("has_robots"), "robots.txt was not fetched.")
        .when(num.isin(5, 38) & ~attempted, "robots.txt fetch was not attempted.")
        .when(num.isin(14, 80) & absent("has_rules") & ~attempted, "robots.txt was not fetched.")
        .when((num == 77) & absent("has_sitemap") & ~attempted, "Sitemap discovery was not attempted.")
        .when(num.isin(37, 58, 78, 91) & absent("has_sitemap"), "No sitemap data available.")
        .when((num == 91) & F.col("is_discovery").isNull(),
              "Crawl mode unknown; orphans can only be told in a discovery crawl.")
        .when((num == 91) & ~F.col("is_discovery"),
              "List-mode crawl: a URL not fetched may still be linked; use a discovery crawl.")
        .when((num == 39) & absent("has_line"), "No Sitemap line to validate.")
        .when((num == 81) & absent("has_html"), "Needs the raw HTML.")
        .when((num == 82) & (F.coalesce("primary_host", F.lit("")) == ""), "No primary host to test.")
        .when((num == 82) & (F.coalesce("resolved", F.lit(0)) == 0), "No host variant could be fetched.")
        .when(kind.isin("asset", "html") & unresolved, "None of the assets could be fetched.")
        .when((kind == "lab") & F.col("assessed").isNull(), F.when(
            F.col("has_lighthouse"), "No lab result for this check.").otherwise("Requires lab data."))
        .when((kind == "render") & absent("has_renders"), F.when(
            F.col("has_render"), "Rendering enabled but no render available.").otherwise(
            "Requires a headless render (rendering disabled)."))
    )


# What a reader should know about a verdict, by check: remarks on findings, and on their absence.
_IF_FOUND = {
    1: "Counts HTML answers that set a cookie and have next to no text.",
    16: "The menu appears only after scripts ran, so a crawler without scripts does not see it.",
    17: "Paginated addresses exist; see that rel=next and rel=prev can be followed.",
    22: "The rendered page has far more text than its source.",
    35: "Text that a stylesheet generates is not indexed.",
    47: "Looks at font files that the page's linked resources name.",
    51: "A hint: preconnecting speeds up the origins that matter.",
    71: "When the page is loaded, something lies over half of it or more.",
    75: "Scripts change the title after the page was loaded.",
    77: "Neither robots.txt nor the usual address led to a sitemap.",
    84: "One path has many addresses that differ in their page number only.",
    90: "The rendered page hides a good deal of text.",
}
_IF_NONE = {
    13: "The crawl names no script or stylesheet.", 41: "The crawl names no image.", 42: "The crawl names no script file.",
    43: "The crawl names no stylesheet file.", 45: "The crawl names no static file.", 46: "The crawl names no script.", 54: "The crawl names no stylesheet.",
}


def _note() -> Column:
    affected, num = F.coalesce("affected", F.lit(0)) > 0, F.col("num")
    said = lambda texts: F.try_element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), num)
    no_markup = ~F.coalesce("has_markup", F.lit(False))
    return (
        F.when(F.col("assessed").isNotNull(), F.concat(F.col("assessed"), F.lit(" URL(s) assessed by lab data.")))
        .when(num == 86, F.concat(F.coalesce("n_preload", F.lit(0)), F.lit(" page(s) preload something; a full answer needs lab data.")))
        .when(F.col("kind") == "fallback", "Static heuristic only; full assessment needs lab data.")
        .when(num.isin(15, 21), F.concat(F.coalesce("n_renders", F.lit(0)), F.lit(" URL(s) were rendered.")))
        .when(num == 58, F.concat(F.lit("The sitemap lists "), F.coalesce("n_sitemap", F.lit(0)), F.lit(" URL(s).")))
        .when(num.isin(30, 31, 32) & no_markup, "No page carries JSON-LD.")
        .when(num.isin(*_IF_NONE) & (F.coalesce("chosen", F.lit(0)) == 0), said(_IF_NONE))
        .when((num == 45), "The files answer; their caching headers need a header sweep.")
        .when(num.isin(31, 32) & affected, "The crawl has typed markup, but none of this type.")
        .when(affected, said(_IF_FOUND))
    )


def state_counts(checklist: DataFrame) -> DataFrame:
    """Counts by state and by tier and state in one pass; tier is null in the totals."""
    return (
        checklist.rollup("status", "tier").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
        .where("level < 3").select("tier", "status", "n")
    )


def state_counts_by_crawl(checklist: DataFrame) -> DataFrame:
    return checklist.groupBy("crawl_id", "tier", "status").agg(F.count("*").alias("n"))
