"""URL expressions. All are built-in Column expressions: none raises, none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SCHEME = r"[a-zA-Z][a-zA-Z0-9+.-]*:"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _plain(url) -> Column:
    """Tabs and line breaks removed, leading blanks and controls dropped."""
    return F.regexp_replace(_col(url), r"^[\x00-\x20]+|[\t\r\n]+", "")


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_plain(url), f"^({_SCHEME[:-1]}):", 1))


def has_scheme(url) -> Column:
    return _plain(url).rlike(f"^{_SCHEME}")


def netloc(url) -> Column:
    """Authority with user info and port, letter case kept; '' when absent."""
    return F.regexp_extract(_plain(url), f"^(?:{_SCHEME})?//([^/?#]*)", 1)


def host(url) -> Column:
    return F.lower(netloc(url))


def full_path(url) -> Column:
    """Path with any ``;params``."""
    return F.regexp_extract(_plain(url), f"^(?:{_SCHEME})?(?://[^/?#]*)?([^?#]*)", 1)


def path(url) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_replace(full_path(url), r";[^/]*$", "")


def query(url) -> Column:
    return F.regexp_extract(_plain(url), r"^[^?#]*\?([^#]*)", 1)


def fragment(url) -> Column:
    return F.regexp_extract(_plain(url), r"(?s)^[^#]*#(.*)$", 1)


def url_parts(url) -> Column:
    """Struct of scheme, netloc, path, query and fragment."""
    return F.struct(
        scheme(url).alias("scheme"), netloc(url).alias("netloc"), path(url).alias("path"),
        query(url).alias("query"), fragment(url).alias("fragment"),
    )


# Parts with their delimiters: '' when the part is missing or blank.
def _scheme_part(u) -> Column:
    return F.lower(F.regexp_extract(_plain(u), f"^({_SCHEME})", 1))


def _netloc_part(u) -> Column:
    return F.regexp_extract(_plain(u), f"^(?:{_SCHEME})?(//[^/?#]+)", 1)


def _query_part(u) -> Column:
    return F.regexp_extract(_plain(u), r"^[^?#]*(\?[^#]+)", 1)


def _fragment_part(u) -> Column:
    return F.regexp_extract(_plain(u), r"(?s)^[^#]*(#.+)$", 1)


def _trim_slashes(value: Column) -> Column:
    return F.regexp_replace(value, r"/+$", "")


def loose_form(url) -> Column:
    """All trailing slashes removed."""
    return _trim_slashes(_col(url))


# A URL that is its own strict form: lower-case scheme and host, a path that is '/' or ends in no slash, a query that is
# not empty, no fragment, printable ASCII only. One look spares nearly all URLs the search for their parts.
_STRICT = r"^[a-z][a-z0-9+.-]*://[!-~&&[^/?#A-Z]]++/(?:[!-~&&[^?#]]*[!-~&&[^/?#]])?(?:\?[!-~&&[^#]]+)?\z"


def strict_form(url) -> Column:
    """Scheme and host lower-cased, root path '/', no trailing slash, no fragment; '' for null."""
    return F.when(_col(url).rlike(_STRICT), _col(url)).otherwise(_strict_parts(url))


def _strict_parts(url) -> Column:
    """:func:`strict_form` of any URL, put together from its parts."""
    u = F.trim(_col(url))
    rooted = F.regexp_replace(full_path(u), "^$", "/")
    trimmed = F.regexp_replace(rooted, r"(?<=.)/+$|^//+$", "")
    whole = F.concat(_scheme_part(u), F.lower(_netloc_part(u)), trimmed, _query_part(u))
    return F.coalesce(F.when(_col(url) == "", "").otherwise(whole), F.lit(""))


def without_query(url) -> Column:
    """The URL with its query removed and its fragment kept."""
    return F.concat(_scheme_part(url), _netloc_part(url), full_path(url), _fragment_part(url))


def param_names_raw(url) -> Column:
    """Decoded names of the parameters with a value, first-seen order, distinct."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p.rlike(r"(?s)^[^=]*=."))
    plain = F.transform(pairs, lambda p: F.replace(F.substring_index(p, "=", 1), F.lit("+"), F.lit(" ")))
    decoded = F.transform(plain, lambda k: F.when(
        k.contains("%"), F.coalesce(F.try_url_decode(k), k)).otherwise(k))
    empty = F.array().cast("array<string>")
    return F.when(_col(url).contains("="), F.array_distinct(decoded)).otherwise(empty)


def param_names(url) -> Column:
    return F.array_distinct(F.transform(param_names_raw(url), lambda k: F.lower(k)))


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def has_param(url, family) -> Column:
    """True if any parameter name of the URL belongs to ``family``."""
    return F.coalesce(F.arrays_overlap(param_names(url), literals(family)), F.lit(False))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _merge_paths(base_path: Column, ref_path: Column) -> Column:
    """Path of a relative reference: folder of the base, dot segments walked."""
    def folder(segments):
        return F.when(F.element_at(segments, -1) != "", F.slice(segments, F.lit(1), F.size(segments) - 1)).otherwise(
            segments)

    def without_blanks(parts):
        n = F.size(parts)
        return F.when(n <= 2, parts).otherwise(F.concat(
            F.slice(parts, 1, 1), F.filter(F.slice(parts, F.lit(2), n - 2), lambda s: s != ""),
            F.slice(parts, n, F.lit(1))))

    def walk(parts):
        return F.aggregate(
            parts, F.array().cast("array<string>"),
            lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(s == ".", done).otherwise(F.array_append(done, s)))

    def closed(parts):
        # A final dot segment names a folder, so the path ends with a slash.
        return F.array_join(F.concat(walk(parts), F.when(
            F.element_at(parts, -1).isin("..", "."), literals([""])).otherwise(F.array().cast("array<string>"))), "/")

    relative = F.concat(_let(F.split(base_path, "/"), folder), F.split(ref_path, "/"))
    parts = F.when(ref_path.startswith("/"), F.split(ref_path, "/")).otherwise(_let(relative, without_blanks))
    return F.regexp_replace(_let(parts, closed), "^$", "/")


def resolve(base, reference) -> Column:
    """``reference`` made absolute against ``base``, dot segments included."""
    base, ref = _col(base), _col(reference)
    site = F.concat(_scheme_part(base), _netloc_part(base))
    query_part = F.when(_query_part(ref) != "", _query_part(ref)).otherwise(_query_part(base))
    merged = _let(_merge_paths(full_path(base), full_path(ref)), lambda p: F.when(
        p.startswith("/") | (_netloc_part(base) == ""), p).otherwise(F.concat(F.lit("/"), p)))
    return (
        F.when(ref == "", base)
        .when(has_scheme(ref), ref)
        .when(netloc(ref) != "", F.concat(_scheme_part(base), ref))
        .when(full_path(ref) == "", F.concat(site, full_path(base), query_part, _fragment_part(ref)))
        .otherwise(F.concat(site, merged, _query_part(ref), _fragment_part(ref)))
    )


# ---- fixed values: characters left as they are by percent_encode --------
_SAFE = {
    "%3A": ":", "%2F": "/", "%3F": "?", "%23": "#", "%5B": "[", "%5D": "]", "%40": "@",
    "%21": "!", "%24": "$", "%26": "&", "%27": "'", "%28": "(", "%29": ")", "%2B": "+",
    "%2C": ",", "%3B": ";", "%3D": "=", "%7E": "~",
}


def percent_encode(url) -> Column:
    """Percent-encode all but unreserved and reserved characters ('%' itself included)."""
    encoded = F.replace(F.url_encode(_col(url)), F.lit("+"), F.lit("%20"))
    for code, char in _SAFE.items():
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    plain = _col(url).rlike(r"^[A-Za-z0-9_.~:/?#\[\]@!$&'()*+,;=-]*$")
    return F.when(plain, _col(url)).otherwise(encoded)


def path_suffix(url) -> Column:
    """Lower-cased file suffix of the path, '(none)' without one."""
    tail = _trim_slashes(path(url))
    found = F.lower(F.regexp_extract(tail, r"[^/.][^/]*(\.[^./]+)$", 1))
    return F.when(found == "", "(none)").otherwise(found)


def before_query(url) -> Column:
    return F.substring_index(_col(url), "?", 1)


def has_suffix(url, suffixes) -> Column:
    """Suffix test on the lower-cased URL up to its first '?'."""
    stem = F.lower(before_query(url))
    test = F.lit(False)
    for suffix in suffixes:
        test = test | stem.endswith(suffix)
    return test
