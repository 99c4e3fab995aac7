"""The audit checks: number, title, tier, required signals and how each is built."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Check:
    """One check. ``kind`` names the plan that finds its offending rows.

    ``row`` and ``list`` checks are a single predicate over the page columns;
    ``fallback`` is a list check that lab data replaces where it exists.
    """

    num: int
    title: str
    tier: str
    kind: str
    source: str
    why: str
    signals: tuple[str, ...] = ()
    heuristic: bool = False
    predicate: Callable[[], Column] | None = None


# ---- fixed values: numbers, titles, tiers, signals, source labels --------
_ROWS = [
    (1, "Cookies Preventing Crawling", "CRAWL+", "row", "crawl headers + body", "body_text", True,
     "A 200 page that sets a cookie and carries almost no text may hide its content behind a consent wall."),
    (2, "Security Tool Blocking Crawl", "CRAWL", "row", "crawl status codes", "", False,
     "Statuses 401, 403, 429 and 503 often mean a firewall turned the crawler away."),
    (3, "Website Cloaking", "CRAWL+", "fixed", "2nd-UA crawl", "", True,
     "Compares what two user agents are served; needs a second crawl."),
    (4, "Incorrect Robots.txt Formatting", "CRAWL", "site", "robots.txt parse", "", False,
     "Lines robots parsers cannot read may silently change what is crawlable."),
    (5, "Missing Robots.txt File", "CRAWL", "site", "robots.txt", "", False,
     "Without a robots file there is no way to steer crawlers or announce sitemaps."),
    (6, "Non-Indexable URLs in Canonical Tags", "CRAWL", "join", "canonical join to crawl", "canonical", False,
     "A canonical that names a non-indexable page contradicts itself."),
    (7, "Canonical Outside <head>", "CRAWL+", "row", "raw HTML structure (selectors)", "head_structure", False,
     "Canonical links outside the head are ignored."),
    (8, "Canonicals Point to Staging Domain", "CRAWL", "row", "canonical host pattern", "canonical", False,
     "A canonical on a staging host hands the index the wrong environment."),
    (9, "Canonicals Point to Third-Party Site", "CRAWL", "join", "canonical host vs site host", "canonical", False,
     "A canonical on someone else's host gives ranking signals away."),
    (10, "Non-Canonicalized Filter URLs", "CRAWL+", "row", "param URL vs canonical", "canonical", True,
     "Filter URLs that do not point back to the clean page multiply duplicates."),
    (11, "Non-Canonicalized Sorting/Order URLs", "CRAWL+", "row", "param URL vs canonical", "canonical", True,
     "Sorted listings that do not point back to the clean page multiply duplicates."),
    (12, "Incorrect Code in Canonical Tag", "CRAWL", "row", "canonical value validation", "canonical", False,
     "Canonicals with spaces, without a scheme or given twice are not honoured."),
    (13, "Broken JavaScript/CSS Files", "CRAWL+", "asset", "asset HEAD-crawl", "scripts", False,
     "Scripts and styles that fail to load break layout and function."),
    (14, "Robots.txt Blocking CSS & JS", "CRAWL", "asset", "robots.txt rule match", "scripts", False,
     "Blocked scripts and styles keep search engines from rendering the page."),
    (15, "Rendering Errors", "RENDER", "render", "headless render (uncaught JS errors)", "", False,
     "Uncaught script errors can leave content out of the rendered page."),
    (16, "JavaScript-Powered Menu Navigation", "RENDER", "render", "static vs rendered nav links", "", True,
     "Menus that exist only after scripts run may not be followed."),
    (17, "Infinite Pagination w/o Crawlable Nav", "CRAWL+", "row", "pagination param + nav heuristic", "", True,
     "Paged listings need links a crawler can follow."),
    (18, "UTM Querystrings in Internal Links", "CRAWL", "list", "internal link params", "links", False,
     "Campaign parameters on own links create duplicates and distort analytics."),
    (19, "Filter URLs Not Consistent Order", "CRAWL+", "window", "param order analysis", "", True,
     "The same filters in another order make a second URL for one page."),
    (20, "Links Pointing to Site Search Pages", "CRAWL+", "list", "internal link path pattern", "links", True,
     "Links to search results spend crawl budget on thin pages."),
    (21, "Other Error Preventing Rendering", "RENDER", "render", "headless render (load failure / blank page)", "", False,
     "Pages that fail to load or stay blank cannot be indexed."),
    (22, "Hidden Uncrawlable Content Behind JS", "RENDER", "render", "static vs rendered text length", "", True,
     "Text that appears only after scripts run may be missed."),
    (23, "Multiple <head> Tags", "CRAWL+", "row", "raw HTML structure (selectors)", "head_structure", False,
     "A second head makes browsers drop metadata."),
    (24, "Canonicals Point Away from Main Site", "CRAWL", "join", "canonical host vs primary domain", "canonical", False,
     "Canonicals away from the main host move signals to another site."),
    (25, "Largest Contentful Paint", "CWV", "lab", "PageSpeed Insights", "", False,
     "Time until the largest element shows; slow pages rank and convert worse."),
    (26, "Cumulative Layout Shift", "CWV", "lab", "PageSpeed Insights", "", False,
     "Content that jumps while loading frustrates visitors."),
    (27, "Properly Sized Images", "CWV", "lab", "PageSpeed Insights", "", False,
     "Images larger than shown waste bandwidth."),
    (28, "Eliminate Render-Blocking Resources", "CWV", "fallback", "head sync script/stylesheet (heuristic)", "head_structure", True,
     "Scripts and styles in the head delay the first paint."),
    (29, "Efficiently Encode Images", "CWV", "fallback", "image format heuristic", "images", True,
     "Poorly compressed image formats slow a page down."),
    (30, "Incorrectly Formatted Structured Data", "CRAWL", "row", "jsonld schema validation", "structured_data", False,
     "Structured data without type or context earns no rich results."),
    (31, "Missing/Incorrect Organization Schema", "CRAWL", "site", "jsonld @type", "structured_data", False,
     "Organization markup tells search engines who stands behind the site."),
    (32, "Missing/Incorrect LocalBusiness Schema", "CRAWL", "site", "jsonld @type", "structured_data", False,
     "LocalBusiness markup supports local search; advisory for other sites."),
    (33, "Title - Outside Head", "CRAWL+", "row", "raw HTML structure (selectors)", "head_structure", False,
     "Titles outside the head may be ignored."),
    (34, "Missing H1s", "CRAWL", "row", "crawl h1 column", "h1", False,
     "A page without a main heading does not state its topic."),
    (35, "Content in ::before / ::after", "RENDER", "render", "computed ::before/::after content", "", True,
     "Text generated by style sheets is not indexed."),
    (36, "Google Search Console Activated", "EXTERNAL", "fixed", "GSC API", "", False,
     "Needs access to the search console."),
    (37, "Soft 404s in XML Sitemap", "CRAWL+", "join", "sitemap URL thin body", "body_text", True,
     "Sitemap URLs that answer 200 with hardly any text look like error pages."),
    (38, "Missing XML Sitemap Links in Robots.txt", "CRAWL", "site", "robots.txt", "", False,
     "A Sitemap line in robots.txt helps crawlers find every URL."),
    (39, "Incorrect XML Sitemap Links in Robots.txt", "CRAWL", "asset", "sitemap URL fetch", "", False,
     "Sitemap lines must name documents that load."),
    (40, "Relative URLs in Canonical Tags", "CRAWL", "row", "canonical absolute-URL check", "canonical", False,
     "Relative canonicals can resolve to the wrong page."),
    (41, "Broken Images", "CRAWL+", "asset", "image HEAD-crawl", "images", False,
     "Images that fail to load harm visitors and image search."),
    (42, "Minify JavaScript", "CRAWL+", "asset", "whitespace ratio heuristic", "scripts", True,
     "Scripts full of line breaks are larger than they need to be."),
    (43, "Minify CSS", "CRAWL+", "asset", "whitespace ratio heuristic", "scripts", True,
     "Style sheets full of line breaks are larger than they need to be."),
    (44, "Enable Text Compression", "CRAWL", "row", "content-encoding header", "content_encoding", False,
     "Uncompressed responses take longer to download."),
    (45, "Efficient Cache Policy for Static Assets", "CRAWL+", "asset", "asset HEAD-crawl", "scripts", False,
     "Assets without caching are downloaded again on every visit."),
    (46, "Avoid document.write()", "CRAWL+", "asset", "JS body scan", "scripts", False,
     "document.write blocks the parser."),
    (47, "Woff2 Fonts", "CRAWL+", "list", "font reference heuristic", "scripts", True,
     "Older font formats are larger than woff2."),
    (48, "Server Errors (5xx)", "CRAWL", "row", "crawl status codes", "", False,
     "Pages that answer with a server error drop out of the index."),
    (49, "Mixed Content", "CRAWL", "list", "https page referencing http assets", "links", False,
     "Secure pages should not refer to insecure resources."),
    (50, "Malformed URLs", "CRAWL", "row", "url parse validation", "", False,
     "URLs without scheme or host, or with blanks, cannot be crawled reliably."),
    (51, "Utilize Preconnect", "CRAWL+", "row", "link rel=preconnect (advisory)", "resource_hints", False,
     "Advisory: lists the pages that open connections early."),
    (52, "Viewport Tag Missing width/initial-scale", "CRAWL", "row", "viewport meta content", "viewport", False,
     "Without a full viewport tag a page is not mobile friendly."),
    (53, "Use Video Formats for Animated Content", "CWV", "fallback", ".gif usage heuristic", "images", True,
     "Animated GIFs are far larger than video."),
    (54, "Font Loading: @import", "CRAWL+", "asset", "CSS @import scan", "scripts", False,
     "Imports inside style sheets chain requests."),
    (55, "HTML Code in Meta Descriptions", "CRAWL", "row", "meta description content", "meta_desc", False,
     "Markup in a description spoils the snippet."),
    (56, "Multiple Meta Descriptions", "CRAWL+", "row", "raw HTML structure (selectors)", "multiples", False,
     "With two descriptions the snippet is left to chance."),
    (57, "Missing XML Sitemap in GSC", "EXTERNAL", "fixed", "GSC API", "", False,
     "Needs access to the search console."),
    (58, "XML Sitemap Over 50,000 URLs or 50 MB", "CRAWL", "site", "sitemap row count", "", False,
     "Sitemaps over the protocol limit may be ignored."),
    (59, "Broken Redirects", "CRAWL", "row", "redirect chain terminal status", "redirect", False,
     "A redirect that ends in an error loses visitors and links."),
    (60, "Redirect Loops", "CRAWL", "list", "redirect chain repetition", "redirect", False,
     "A chain that returns to itself never loads."),
    (61, "Meta NoSnippet URLs", "CRAWL", "row", "meta robots nosnippet", "meta_robots", False,
     "Lists pages that forbid a snippet."),
    (62, "Meta NoArchive URLs", "CRAWL", "row", "meta robots noarchive", "meta_robots", False,
     "Lists pages that forbid a cached copy."),
    (63, "Noindex Canonicalized URLs", "CRAWL", "row", "noindex + canonical conflict", "meta_robots canonical", False,
     "Noindex and a canonical on one page conflict."),
    (64, "Crawlable Filter URLs", "CRAWL+", "list", "crawlable param links (no nofollow)", "links", True,
     "Followed links to filtered listings waste crawl budget."),
    (65, "Crawlable Sorting/Order URLs", "CRAWL+", "list", "crawlable param links (no nofollow)", "links", True,
     "Followed links to sorted listings waste crawl budget."),
    (66, "Rel=Nofollow on Internal Links to Indexable Pages", "CRAWL", "join", "nofollow internal link to indexable target", "links", False,
     "Nofollow on own indexable pages withholds link equity."),
    (67, "Search URLs in Index", "CRAWL+", "join", "indexable search-path URLs", "meta_robots", True,
     "Search result pages should stay out of the index."),
    (68, "Session IDs in Index", "CRAWL+", "join", "session-id params on indexable URLs", "meta_robots", True,
     "Session identifiers create endless duplicates."),
    (69, "Inconsistency Between Mobile & Desktop Content", "CRAWL+", "fixed", "2nd-UA crawl", "", True,
     "Compares mobile and desktop content; needs a second crawl."),
    (70, "Product URL Variations", "CRAWL+", "window", "param variant duplication", "", True,
     "Several parameter variants of one page split its signals."),
    (71, "Intrusive Interstitial Usage", "RENDER", "render", "rendered viewport overlay detection", "", True,
     "Overlays that cover the page on load can lower its ranking."),
    (72, "Broken Backlinks", "EXTERNAL", "fixed", "backlink source", "", False,
     "Needs a table of backlinks."),
    (73, "Improper Handling of Discontinued Products", "CRAWL+", "fixed", "product list", "", False,
     "Needs a list of product URLs."),
    (74, "Meta Description - Outside Head", "CRAWL+", "row", "raw HTML structure (selectors)", "head_structure", False,
     "Descriptions outside the head are ignored."),
    (75, "JS Rotating Titles", "RENDER", "render", "rendered title observed over time", "", False,
     "Titles that change after load are unstable in results."),
    (76, "Multiple Titles", "CRAWL+", "row", "raw HTML structure (selectors)", "multiples", False,
     "With two titles the wrong one may be shown."),
    (77, "Missing XML Sitemap", "CRAWL", "site", "sitemap discovery", "", False,
     "A sitemap helps search engines find every URL."),
    (78, "Incorrect XML Sitemap Formatting", "CRAWL", "site", "sitemap parse", "", False,
     "Parse errors hide part of the URL list."),
    (79, "Missing Canonicals", "CRAWL", "row", "crawl canonical column", "canonical", False,
     "Pages without a canonical leave duplicates unresolved."),
    (80, "Robots.txt Disallows Images", "CRAWL", "asset", "robots.txt rule match", "images", False,
     "Blocked images cannot rank in image search."),
    (81, "JavaScript Onclick Links", "CRAWL+", "html", "raw HTML onclick scan", "", False,
     "Anchors that navigate by script only cannot be followed."),
    (82, "Lack of Redirects to Canonical Version", "CRAWL+", "asset", "host variant redirect test", "", True,
     "Host variants that answer on their own duplicate the site."),
    (83, "Excessive JSON File Crawling", "CRAWL", "row", "crawled .json URLs", "", False,
     "Data files use crawl budget without being worth indexing."),
    (84, "Auto-Generated Pagination Parameters", "CRAWL+", "window", "pagination param explosion", "", True,
     "Many paged variants of one path waste crawl budget."),
    (85, "Next-Gen Images", "CWV", "fallback", "next-gen format adoption heuristic", "images", True,
     "Modern image formats are smaller."),
    (86, "Preload Key Requests", "CWV", "fallback", "link rel=preload presence", "resource_hints", True,
     "Preloading key requests speeds up the first paint."),
    (87, "Preload LCP", "CWV", "lab", "PageSpeed Insights", "", False,
     "Preloading the largest element shortens its paint time."),
    (88, "Lazy Load Third-Party with Facades", "CWV", "lab", "PageSpeed Insights", "", False,
     "Heavy embeds should load only when needed."),
    (89, "Duplicate Scripts Loaded", "CRAWL+", "list", "duplicate script src in HTML", "scripts", False,
     "Loading a script twice wastes bandwidth and time."),
    (90, "Display:None Content", "RENDER", "render", "computed display:none text volume", "", True,
     "Much hidden text carries little value and may look like abuse."),
    (91, "Orphaned URLs in XML Sitemap", "CRAWL", "join", "sitemap vs crawl link graph", "links", False,
     "Sitemap URLs nobody links to get no internal equity."),
]

CHECKS: dict[int, Check] = {
    num: Check(num, title, tier, kind, source, why, tuple(signals.split()), heuristic)
    for num, title, tier, kind, source, signals, heuristic, why in _ROWS
}

# Tiers whose signal gate is lifted while live data of that tier is supplied.
LIVE_TIERS = {"CWV": "has_lighthouse", "RENDER": "has_render"}


def of_kind(*kinds: str, checks: dict[int, Check] | None = None) -> list[int]:
    return [n for n, c in (checks or CHECKS).items() if c.kind in kinds]


def with_row_check(
    checks: dict[int, Check], num: int, title: str, predicate: Callable[[], Column],
    tier: str = "CRAWL", signals: tuple[str, ...] = (), heuristic: bool = False, why: str = "",
) -> dict[int, Check]:
    """A copy of ``checks`` with a user's own predicate over the page columns added."""
    if num in checks:
        raise ValueError(f"check {num} exists")
    return {**checks, num: Check(num, title, tier, "row", "crawl columns", why, signals, heuristic, predicate)}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def as_array(checks: dict[int, Check] | None = None) -> Column:
    """The catalogue as an array literal; ``inline`` it to pair each row with every check."""
    rows = ", ".join(
        f"named_struct('num', {c.num}, 'check', {_text(c.title)}, 'tier', {_text(c.tier)}, 'kind', {_text(c.kind)}, "
        f"'signals', CAST(array({', '.join(map(_text, c.signals))}) AS ARRAY<STRING>), 'heuristic', {c.heuristic}, "
        f"'detection_source', {_text(c.source)}, 'explanation', {_text(c.why)})"
        for c in (checks or CHECKS).values())
    return F.expr(f"array({rows})")


def table(spark: SparkSession, checks: dict[int, Check] | None = None) -> DataFrame:
    """One row per check."""
    return spark.range(1).select(F.inline(as_array(checks)))
