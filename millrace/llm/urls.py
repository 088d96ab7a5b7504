"""URL filters: longest matching rule, and block decisions that spread over redirects and canonical links.

A page's url and the targets of its canonical links and of its refresh redirects are one resource under several names.
Names are the nodes of a graph (without fragment, scheme and host in lower case) and these links its edges; a
connected component is a set of aliases. A name that a rule fits keeps the rule's verdict. The others take the
component's: allow if any name in it is explicitly allowed, else block if any is blocked, else allow.

DataFrame functions only. A page's links are read natively from its html; components are computed by star steps.

Defined results: a null url, or one without "://", has empty host and path, no rule and no aliases, and is allowed;
null html has no links; repeated rows are judged alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import components
from millrace.session import written

#: Fixed rules: host, path and verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: canonical may be any token of rel.
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|["']?canonical\b)[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first "://"; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_col == rule_host) | host_col.endswith("." + rule_host)) & path_col.startswith(rule_path)
        text, verdict = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


def node(url: Column) -> Column:
    """The name of a url in the graph: no fragment, scheme and host in lower case; null if it has no "://"."""
    bare = F.regexp_replace(url, r"#[\s\S]*$", "")
    head = F.regexp_extract(bare, r"^([^/?#]*://[^/?#]*)", 1)
    named = F.concat(F.translate(head, _UPPER, _LOWER), F.substring(bare, F.length(head) + 1, F.length(bare)))
    return F.when(head != "", named)


def resolved(link: Column, base: Column) -> Column:
    """The absolute form of a link on the page base."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"^([^/?#]*)://", 1)
    site = F.regexp_extract(base, r"^([^/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^/?#]*://[^/?#]*(?:/[^/?#]*)*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(folder != "", F.concat(folder, link))
        .otherwise(F.concat(site, F.lit("/"), link))
    )


def links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between the names of one resource."""
    said = pages.where(F.col("html").rlike("(?i)canonical|refresh") & node(F.col("url")).isNotNull())
    found = lambda tag, link: F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, link, 1))
    rows = said.select("url", F.explode(F.concat(found(CANONICAL, HREF), found(REFRESH, TARGET))).alias("link")).where("link != ''")
    edges = rows.select(node(F.col("url")).alias("a"), node(resolved(F.col("link"), F.col("url"))).alias("b"))
    return edges.where("b is not null and a != b").distinct()


def aliases(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """name and alias_verdict of every name in a component, by explicit allow, then block, then allow."""
    found = written(components(links(pages)))
    _, verdict = decide(host(F.col("node")), path(F.col("node")), rules)
    says = found.withColumn("own", verdict).groupBy("component").agg(
        F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked")
    )
    # only components that block anyone matter, which keeps the join narrow
    says = says.where("blocked and not coalesce(allowed, false)").select("component")
    return found.join(says, "component").select(F.col("node").alias("name"), F.lit("block").alias("alias_verdict"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each page."""
    blocked = written(aliases(pages.select("url", "html"), rules))
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("own"), node(F.col("url")).alias("name"))
    if blocked.isEmpty():
        rows = rows.withColumn("alias_verdict", F.lit(None).cast("string"))
    else:
        rows = rows.join(blocked, "name", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("own", "alias_verdict", F.lit("allow")).alias("verdict"))
