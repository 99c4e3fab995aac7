"""DuckDB spellings used by the oracle queries."""

from __future__ import annotations

SCHEME = "[a-zA-Z][a-zA-Z0-9+.-]*:"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^(?:{SCHEME})?//([^/?#]*)', 1)"


def host(u: str) -> str:
    return f"lower({netloc(u)})"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:{SCHEME})?(?://[^/?#]*)?([^?#]*)', 1)"


def query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"


def fragment(u: str) -> str:
    return f"regexp_extract({u}, '^[^#]*#(.*)$', 1)"


def loose(u: str) -> str:
    return f"rtrim({u}, '/')"


def _opt(prefix: str, value: str, suffix: str = "") -> str:
    return f"CASE WHEN {value} <> '' THEN '{prefix}' || {value} || '{suffix}' ELSE '' END"


def without_query(u: str) -> str:
    return f"({_opt('', scheme(u), ':')} || {_opt('//', netloc(u))} || {path(u)} || {_opt('#', fragment(u))})"


def strict(u: str) -> str:
    p = path(u)
    return (f"({_opt('', scheme(u), ':')} || {_opt('//', host(u))} || "
            f"CASE WHEN {p} = '' THEN '/' WHEN length({p}) > 1 THEN rtrim({p}, '/') ELSE {p} END || {_opt('?', query(u))})")


def params(u: str, lower: bool = True) -> str:
    name = "url_decode(replace(split_part(x, '=', 1), '+', ' '))"
    name = f"lower({name})" if lower else name
    return (f"list_transform(list_filter(string_split({query(u)}, '&'), lambda x: regexp_matches(x, '^[^=]*=.')), "
            f"lambda x: {name})")


def in_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def has_param(u: str, family) -> str:
    return f"list_has_any({params(u)}, {in_list(family)})"


SEARCH = "/(search|s|find|results?|suche|recherche)(/|[?]|$)"
STAGING = "(^|[.])(staging|stg|dev|test|preprod|uat|qa|sandbox)\\b|[.]local$"
