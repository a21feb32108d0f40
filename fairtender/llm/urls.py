"""Block decisions on pages, carried over redirects and canonical links.

Rules of host and path decide first. Pages without a rule take the decision of their
equivalence class: the connected component of addresses over redirect and canonical-link
edges. An explicit allow in a class goes before any block in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtender.llm.components import components
from fairtender.llm.staging import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_ADDRESS = r"(?s)^.*?://[^/?#]*([^#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def address(url: Column) -> Column:
    """What two links to one page share: host, path and query, without scheme and fragment."""
    rest = F.regexp_extract(url, _ADDRESS, 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host(url), F.when(rest == "", "/").otherwise(rest)))


def rule_of(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (verdict, ``host/path``) that fits, as a struct, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host_col == name) | F.endswith(host_col, F.lit("." + name))) & F.startswith(path_col, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in a tag, quoted or not."""
    value = F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return F.regexp_replace(value, "^[\"']|[\"']$", "")


def _without_dots(target: Column) -> Column:
    """A path and query, from its first ``/``, without the segments ``.`` and ``..``."""
    name = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.substr(target, F.length(name) + 1)
    parts = F.split(name, "/")
    last = F.element_at(parts, -1)
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    empty = F.array().cast("array<string>")
    step = lambda a, p: F.when(p == "..", up(a)).when((p == ".") | (p == ""), F.when(p == "", F.concat(a, F.array(p))).otherwise(a)).otherwise(F.concat(a, F.array(p)))
    inner = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), empty, step)
    closed = F.when(last.isin(".", ".."), F.concat(inner, F.array(F.lit("")))).otherwise(inner)
    resolved = F.concat(F.lit("/"), F.array_join(closed, "/"), rest)
    return F.when(F.contains(name, F.lit("/.")), resolved).otherwise(target)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``a``, ``b`` between addresses: canonical links and refresh redirects in pages.

    Targets that are not absolute are taken on the page's host: from its root when they begin with
    ``/``, with the page's path when they begin with ``?``, and else from the page's folder, with
    ``.`` and ``..`` resolved. A fragment alone is the page itself. Targets of another scheme
    (``mailto:``) give no edge.
    """
    url, html = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    lowered = F.lower(html)
    tagged = lambda word: F.contains(lowered, F.lit(word))
    tags = pages.filter(F.contains(url, F.lit("://"))).filter(tagged("canonical") | tagged("refresh")).select(
        url.alias("url"), F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))).alias("tag")
    )
    rel, kind = F.lower(_attribute(F.col("tag"), "rel")), F.lower(_attribute(F.col("tag"), "http-equiv"))
    moved = F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1)
    # each step gives no or one value and is exploded, so that the next one does not repeat it
    one = lambda value: F.explode(F.filter(F.array(value), lambda v: v.isNotNull()))
    target = F.when(rel == "canonical", _attribute(F.col("tag"), "href")).when(kind == "refresh", moved)
    named = tags.select("url", one(F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))).alias("to"))
    to, scheme = F.col("to"), F.regexp_extract("url", r"(?s)^(.*?)://", 1)
    page = F.when(path(F.col("url")) == "", "/").otherwise(path(F.col("url")))
    root = F.concat(scheme, F.lit("://"), host(F.col("url")))
    full = (
        F.when(to.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(root, _without_dots(to)))
        .when((to == "") | F.startswith(to, F.lit("#")) | to.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(to, F.lit("?")), F.concat(root, page, to))
        .otherwise(F.concat(root, _without_dots(F.concat(F.regexp_extract(page, "(?s)^(.*/)", 1), to))))
    )
    return named.select("url", one(full).alias("to")).select(address(F.col("url")).alias("a"), address(F.col("to")).alias("b"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: its id, host, path, rule (or null), verdict, and ``via`` (rule, alias or default).

    ``edges`` (``a``, ``b``: addresses) holds redirects known from elsewhere; those found in
    the pages are added. An address whose class has no rule of its own is allowed. A missing
    url, or one without ``://``, has an empty host and path, no rule and no class. Repeated
    rows are judged alike. Other columns are left out.
    """
    links = link_edges(pages, url_col, html_col)
    links = keep(links.unionByName(edges.select("a", "b")) if edges is not None else links, "links")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.explode(F.array(F.struct(host(url).alias("host"), path(url).alias("path"), address(url).alias("address")))).alias("at"))
    ruled = rows.select("page_id", "at.*").withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    labels = keep(components(links), "labels")
    # a node is an address; the rule of an address needs no page of that name
    full = F.concat(F.lit("x://"), F.col("node"))
    own = labels.select("node", "label", rule_of(host(full), path(full), rules).alias("own"))
    classes = own.groupBy("label").agg(F.max(F.col("own.verdict") == "allow").alias("allows"), F.max(F.col("own.verdict") == "block").alias("blocks"))
    verdicts = F.when(F.col("allows"), "allow").when(F.col("blocks"), "block")
    known = own.join(classes.select("label", verdicts.alias("shared")), "label").select("node", "shared").filter("shared is not null")
    joined = ruled.join(known, F.col("address") == F.col("node"), "left")
    via = F.when(F.col("hit").isNotNull(), "rule").when(F.col("shared").isNotNull(), "alias").otherwise("default")
    return joined.select("page_id", "host", "path", "hit.rule", F.coalesce("hit.verdict", "shared", F.lit("allow")).alias("verdict"), via.alias("via"))
