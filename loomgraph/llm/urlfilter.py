"""URL rules with redirect equivalence: a block reaches every alias, an explicit allow comes first. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_free, materialise
from .components import connected_components

#: More rules than this don't belong in an expression; they are joined.
MAX_RULES = 1000
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Where a page names another address for itself; the attributes can stand in either order.
_TARGETS = (
    r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)",
    r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)",
)


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def best_rule(at: Column, below: Column, rules: Sequence[Rule]) -> Column:
    """struct(verdict, rule) of the longest fitting rule, the last of those that tie, null if none fits. A rule fits its host and all subdomains."""
    chain = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((at == name) | at.endswith(f".{name}")) & below.startswith(start)
        chain = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(chain)
    return chain


def with_rule(rows: DataFrame, url: str, rules: Sequence[Rule], name: str) -> DataFrame:
    """``rows`` with ``name``, what :func:`best_rule` says of the address in ``url``: by an expression, or for very many rules by a join.

    The join looks up each suffix of a host, once for each different address; both ways give the same.
    """
    at = F.col(f"`{url}`")
    if len(rules) <= MAX_RULES:
        return rows.withColumn(name, best_rule(host(at), path(at), rules))
    spark = rows.sparkSession
    listed = spark.createDataFrame([(v, h, p, len(h + p), k) for k, (v, h, p) in enumerate(rules)], "verdict string, suffix string, start string, size int, turn int")
    parts = F.split("at", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = rows.select(at.alias("address")).distinct().withColumns({"at": host(F.col("address")), "below": path(F.col("address"))}).withColumn("suffix", F.explode(suffixes))
    fits = each.join(listed, "suffix").where(F.col("below").startswith(F.col("start")))
    said = F.struct("verdict", F.concat("suffix", "start").alias("rule"))
    best = fits.groupBy("address").agg(F.max_by(said, F.struct("size", "turn")).alias("said"))
    (address, found) = columns_free(rows, "address", "said")
    best = best.select(F.col("address").alias(address), F.col("said").alias(found))
    return rows.join(best, at == F.col(address), "left").withColumn(name, F.col(found)).drop(address, found)


def alias_key(url: Column) -> Column:
    """An address as a node: without its fragment, scheme and host in lower case; null if it has no ``://``."""
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    front = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    return F.when(front != "", F.concat(F.translate(front, UPPER, LOWER), F.substring(bare, F.length(front) + 1, F.length(bare))))


def _without_dots(path_: Column) -> Column:
    """A path from ``/`` without the segments ``.`` and ``..``."""
    parts = F.split(path_, "/")
    add = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), add)
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path_.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(ends, "/"))).otherwise(path_)


def absolute(to: Column, src: Column) -> Column:
    """The address ``to`` as seen from the page ``src``: as it is with a scheme, otherwise from the page's scheme, site, folder or path."""
    site = F.regexp_extract(src, r"(?s)^(.*?://[^/?]*)", 1)
    scheme = F.regexp_extract(src, r"(?s)^(.*?:)//", 1)
    here = F.regexp_extract(src, r"(?s)^.*?://[^/?]*([^?]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(here, "(?s)^/(.*/)", 1))
    front = F.regexp_extract(to, "(?s)^([^?#]*)", 1)
    rest = F.substring(to, F.length(front) + 1, F.length(to))
    below = F.when(front.startswith("/"), front).otherwise(F.concat(folder, front))
    own = F.when(rest.startswith("?"), F.concat(site, here, rest)).otherwise(src)
    relative = F.when(front == "", own).otherwise(F.concat(site, _without_dots(below), rest))
    return F.when(to.startswith("//"), F.concat(scheme, to)).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), to).otherwise(relative)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) addresses that the redirect and canonical-link elements of a page, all of them, connect; relative ones are completed."""
    page, text = F.col(f"`{url}`"), F.col(f"`{html}`")
    may = pages.where(F.lower(text).rlike("canonical|refresh")).select(alias_key(page).alias("src"), text.alias("text"))
    found = may.where("src is not null").select("src", F.explode(F.concat(*(F.regexp_extract_all("text", F.lit(p), 1) for p in _TARGETS))).alias("to")).where("to != ''")
    return found.select("src", alias_key(absolute(F.col("to"), F.col("src"))).alias("dst")).where("dst is not null and src != dst").distinct()


def filter_urls(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, url: str = "url", html: str | None = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    The longest fitting rule decides. Where none fits, the page's aliases do: all addresses that ``redirects``
    (columns src, dst) or the pages' own refresh and canonical elements connect, by distributed connected components.
    An alias under an allow rule comes first, then one under a block rule; otherwise the page is allowed. An alias need
    not be a page itself. Every row of ``pages`` stays, repeated ones too; a null or malformed url has empty host and
    path, no rule and no alias. Result columns replace input columns of the same name.
    """
    links = page_links(pages, url, html) if html else None
    if redirects is not None:
        given = redirects.select(alias_key(F.col("src")).alias("src"), alias_key(F.col("dst")).alias("dst"))
        links = given if links is None else links.unionByName(given)
    key, node, found = columns_free(pages, "alias_key", "alias_node", "alias_says")
    at = F.col(f"`{url}`")
    ruled = with_rule(pages, url, rules, "rule")
    out = ruled.withColumn("host", host(at)).withColumn("path", path(at)).withColumn(key, alias_key(at))
    label = materialise(connected_components(links), "url-components") if links is not None else None
    if label is not None:
        says = with_rule(label, "node", rules, "best").withColumn("says", F.col("best.verdict"))
        whole = says.groupBy("component").agg(F.max(F.col("says") == "allow").alias("some_allow"), F.max(F.col("says") == "block").alias("some_block"))
        verdict = F.when(F.col("some_allow"), "allow").when(F.col("some_block"), "block")
        known = label.join(whole, "component").select(F.col("node").alias(node), verdict.alias(found)).where(f"`{found}` is not null")
        out = out.join(known, F.col(key) == F.col(node), "left").drop(node)
    else:
        out = out.withColumn(found, F.lit(None).cast("string"))
    verdict = F.coalesce(F.col("rule.verdict"), F.col(found), F.lit("allow"))
    return out.withColumn("verdict", verdict).withColumn("rule", F.col("rule.rule")).drop(key, found)
