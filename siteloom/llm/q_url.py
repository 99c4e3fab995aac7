"""op7: verdicts on page addresses."""

from . import urls
from .registry import query, table

#: Verdict and rule (host, then path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query("op7_url_filter")
def op7(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
