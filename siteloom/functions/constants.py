"""The audit's results depend on exactly these."""

# ---- fixed values: list cells -------------------------------------------
LIST_DELIMITER = "@@"
RESP_HEADER_PREFIX = "resp_headers_"
JSONLD_PREFIX = "jsonld_"

# ---- fixed values: URL parameter families -------------------------------
FILTER_PARAMS = ("color", "colour", "size", "brand", "price", "filter", "fq", "refine", "category")
SORT_PARAMS = ("sort", "orderby", "order", "sort_by", "sortby", "dir")
SESSION_PARAMS = ("sid", "sessionid", "phpsessid", "jsessionid", "sess", "aspsessionid")
PAGINATION_PARAMS = ("page", "p", "pg", "start", "offset", "paged")

# ---- fixed values: patterns (Java regex) --------------------------------
SEARCH_PATH = r"(?i)/(search|s|find|results?|suche|recherche)(/|\?|$)"
STAGING_HOST = r"(?i)(^|\.)(staging|stg|dev|test|preprod|uat|qa|sandbox)\b|\.local$"
MARKUP_IN_TEXT = r"<[^>]+>"
ONCLICK_ANCHOR = r"(?i)<a(?![^>]*href=)[^>]*onclick="
SITEMAP_LINE = r"(?im)^\s*sitemap\s*:\s*(\S+)"
COMPRESSED = r"gzip|br|deflate|zstd"

# ---- fixed values: robots.txt -------------------------------------------
ROBOTS_DIRECTIVES = (
    "user-agent", "disallow", "allow", "sitemap", "crawl-delay", "host",
    "clean-param", "noindex", "request-rate", "visit-time",
)

# ---- fixed values: asset and image suffixes -----------------------------
LEGACY_IMAGES = (".bmp", ".tiff", ".png")
MODERN_IMAGES = (".webp", ".avif")
LEGACY_FONTS = (".woff", ".ttf", ".otf", ".eot")

# ---- fixed values: check thresholds -------------------------------------
BLOCKED_STATUSES = (401, 403, 429, 503)
EMPTY_BODY_CHARS = 50
THIN_BODY_CHARS = 200
LCP_LIMIT_MS = 2500
CLS_LIMIT = 0.1
SCORE_LIMIT = 0.9
NEWLINE_RATIO_LIMIT = 0.02
BLANK_RENDER_CHARS = 20
HIDDEN_RATIO = 1.5
HIDDEN_EXTRA_CHARS = 500
HIDDEN_TEXT_CHARS = 200
SITEMAP_URL_LIMIT = 50000
PAGINATION_VARIANT_LIMIT = 5
EXAMPLE_URLS = 5
ROBOTS_LINE_SHOWN = 80
UNKNOWN_DEPTH = 99

# ---- fixed values: sampling defaults ------------------------------------
LAB_SAMPLE = 20
RENDER_SAMPLE = 10
DETAIL_ROWS_EMBEDDED = 5000
TOP_TARGETS = 20
TOP_CONTENT_TYPES = 15
TOP_EXTENSIONS = 15

# ---- fixed values: lab audit ids ----------------------------------------
LAB_AUDIT_IDS = (
    "largest-contentful-paint",
    "cumulative-layout-shift",
    "uses-responsive-images",
    "render-blocking-resources",
    "uses-optimized-images",
    "efficient-animated-content",
    "modern-image-formats",
    "uses-rel-preload",
    "prioritize-lcp-image",
    "preload-lcp-image",
    "third-party-facades",
)

# ---- fixed values: the four states --------------------------------------
PRESENT = "Present"
NOT_PRESENT = "Not present"
HEURISTIC = "Heuristic"
NOT_ASSESSED = "Not assessed"

# ---- fixed values: settings named in the configuration of a run ----------
SETTING_LAB = "PSI URLs assessed"
SETTING_RENDER = "Render URLs assessed"
SETTING_SOURCE = "Data source"
SETTING_URLS = "URLs in dataset"
SETTING_SIGNALS = "Signals available"
SETTING_DETAIL = "Crawl Detail sheet"

# ---- fixed values: detail report columns, in order ----------------------
DETAIL_COLUMNS = (
    "Address", "Status Code", "Status", "Indexability", "Indexability Reason",
    "Content-Type", "Content-Encoding", "Response Time", "Size (bytes)",
    "Crawl Depth", "Crawl Timestamp", "Language",
    "Title 1", "Title 1 Length",
    "Meta Description 1", "Meta Description 1 Length", "Meta Keywords 1",
    "H1-1", "H1-1 Length", "H1-2", "H1 Count",
    "H2-1", "H2-2", "H2 Count",
    "Meta Robots 1", "X-Robots-Tag 1", "Meta Refresh 1",
    "Canonical Link Element 1", "Canonical Is Self",
    "rel=next", "rel=prev", "amphtml Link Element",
    "Word Count", "Text Ratio",
    "Inlinks", "Unique Inlinks", "Outlinks", "Unique Outlinks",
    "External Outlinks", "Unique External Outlinks",
    "Images", "Images Missing Alt Text",
    "Hreflang 1", "Hreflang Count",
    "Redirect URL", "Redirect Type",
    "Last-Modified", "Server", "IP Address", "Cookies",
    "Structured Data Types", "Structured Data Count",
    "URL Length", "URL Encoded Address",
)

# ---- fixed values: extraction columns, as css-like selectors ------------
EXTRACTION_SELECTORS = {
    "meta_robots": "meta[name=robots]::attr(content)",
    "meta_desc_all": "meta[name=description]::attr(content)",
    "title_all": "title::text",
    "canonical_all": "link[rel=canonical]::attr(href)",
    "hreflang_hreflang": "link[rel=alternate]::attr(hreflang)",
    "hreflang_href": "link[rel=alternate]::attr(href)",
    "script_src": "script[src]::attr(src)",
    "stylesheet_href": "link[rel=stylesheet]::attr(href)",
    "preconnect_href": "link[rel=preconnect]::attr(href)",
    "preload_href": "link[rel=preload]::attr(href)",
    "head_script_src": "head script[src]::attr(src)",
    "head_stylesheet_href": "head link[rel=stylesheet]::attr(href)",
    "html_lang": "html::attr(lang)",
    "meta_keywords": "meta[name=keywords]::attr(content)",
    "meta_refresh": "meta[http-equiv=refresh]::attr(content)",
    "rel_next": "link[rel=next]::attr(href)",
    "rel_prev": "link[rel=prev]::attr(href)",
    "amphtml": "link[rel=amphtml]::attr(href)",
}
