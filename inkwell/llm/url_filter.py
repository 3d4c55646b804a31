"""URL filters with redirect equivalence.

Allow and block rules name a host, with its subdomains, and the beginning of a path; the longest that fits decides.
Pages that no rule fits take part through their aliases: redirects, canonical links and refreshes join
addresses into components, and a block anywhere in a component reaches its addresses without a rule,
unless a rule explicitly allows one of them.

Rules are found by equality joins on the stretches of host and path that rules have, so their number does not matter. Rows
meet once, as addresses; addresses without a link form components of their own and never enter the iteration.
Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm._components import components
from inkwell.operators.joins import join_counted
from inkwell.session import materialize, working_tables

# Verdict, host and path of each rule.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

# Parts of a query that only say where a reader came from.
TRACKING = r"^(utm_[a-z_]*|gclid|fbclid|ref)(=|\z)"

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"
COMMENT = r"(?s)<!--.*?-->"
CANONICAL_TAG = r"""(?is)(<link\b[^>]*\brel\s*=\s*["']?\s*canonical\b[^>]*>)"""
REFRESH_TAG = r"""(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>)"""
HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""


def lower_latin(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_latin(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def address(url: Column) -> Column:
    """What spellings of one address have in common: host and path without scheme, default port, ``www.``, closing
    slashes and fragment, and the query in sorted order without its tracking parts. Empty without a host."""
    bare = F.regexp_replace(F.regexp_replace(host(url), r":(80|443)\z", ""), r"^www\.", "")
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), QUERY, 1), "&")
    asked = F.array_join(F.array_sort(F.filter(query, lambda part: (part != "") & ~part.rlike(TRACKING))), "&")
    whole = F.concat(bare, F.regexp_replace(path(url), r"/+\z", ""), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))
    return F.when(host(url) == "", "").otherwise(whole)


def resolved(target: Column, url: Column) -> Column:
    """A link's target as a whole url, as seen from the page at ``url``. NULL for other schemes and within the page.
    A relative path goes on from the page's folder; ``..`` is left as it is."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    base = F.concat(F.lit("http://"), host(url))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | target.startswith("#") | (target == "") | (host(url) == ""), None)
        .when(target.startswith("/"), F.concat(base, target))
        .when(target.startswith("?"), F.concat(base, path(url), target))
        .otherwise(F.concat(base, F.coalesce(F.nullif(F.regexp_replace(path(url), r"[^/]*\z", ""), F.lit("")), F.lit("/")), F.regexp_replace(target, r"^\./", "")))
    )


def declared(html: Column) -> Column:
    """The targets a page names itself: its first canonical link and its first refresh, as they are written."""
    plain = F.regexp_replace(html, COMMENT, "")
    canonical = F.regexp_extract(F.regexp_extract(plain, CANONICAL_TAG, 1), HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract(plain, REFRESH_TAG, 1), REFRESH_URL, 1)
    lower = F.lower(html)
    named = F.when(lower.contains("canonical") | lower.contains("http-equiv"), F.array(canonical, refresh))
    return F.filter(F.coalesce(named, F.array().cast("array<string>")), lambda x: x != "")


def rules_table(spark: SparkSession, rules: list = RULES) -> DataFrame:
    """(verdict, rule_host, rule_path) of a list of rules."""
    listed = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for v, h, p in rules))
    return spark.range(1).select(F.explode(listed).alias("_r")).select("_r.*")


def ruled(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct hosts and paths that a rule fits, by the longest rule.

    Of rules of one length the longer host decides, then allow. Every address asks for the stretches that rules of
    its host and its parents have, one equality each."""
    places = addresses.select("host", "path").distinct()
    shapes = rules.select("rule_host", F.length("rule_path").alias("size")).distinct()
    deepest = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    per_host = places.groupBy("host").agg(F.count("*").alias("rows")).where("host <> ''")
    suffixes = F.expr(f"array_distinct(transform(sequence(1, {max(deepest, 1)}), i -> substring_index(host, '.', -i)))")
    fitting = per_host.select("host", "rows", F.explode(suffixes).alias("rule_host")).join(shapes, "rule_host")
    fitting = fitting.groupBy("host", "rows").agg(F.collect_set(F.struct("rule_host", "size")).alias("shapes"))
    asked = join_counted(places, fitting, "host", "path", F.col("rows")).select("host", "path", F.explode("shapes").alias("_s"))
    asked = asked.select("host", "path", F.col("_s.rule_host").alias("rule_host"), F.expr("substring(path, 1, _s.size)").alias("rule_path"))
    met = asked.join(rules.where("length(rule_path) > 0"), ["rule_host", "rule_path"])
    every = asked.select("host", "path", "rule_host").distinct().join(rules.where("length(rule_path) = 0"), "rule_host").select(*met.columns)
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule), F.length("rule_host"), F.col("verdict") == "allow", rule.alias("rule"), "verdict")).alias("_b")
    return met.unionByName(every).groupBy("host", "path").agg(best).select("host", "path", "_b.rule", "_b.verdict")


def judge(
    pages: DataFrame,
    rules: DataFrame | None = None,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, via.

    ``rules`` (verdict, rule_host, rule_path) default to ``RULES``; ``redirects`` (from_url, to_url) is any log of redirects,
    and pages add their canonical links and refreshes. ``verdict`` is the rule's (``via`` "rule"); without one "block"
    if an alias is blocked and none is explicitly allowed ("alias"), else "allow" ("none"). A link's target is judged by the rules too,
    whether or not it is among the pages. NULL urls and urls without ``://`` have an empty host and path, no rule and no
    alias. Rows that repeat an id or a url are judged one by one; no pages give no rows. Other columns are not read."""
    spark = pages.sparkSession
    with working_tables(spark) as work:
        rules = rules_table(spark) if rules is None else rules.select("verdict", lower_latin(F.col("rule_host")).alias("rule_host"), "rule_path")
        url = F.col(url_col)
        links = declared(F.col(html_col)) if html_col else F.array().cast("array<string>")
        rows = pages.select(
            F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"), address(url).alias("address"), F.transform(links, lambda x: resolved(x, url)).alias("targets")
        )
        rows = materialize(rows, "pages")
        ends = rows.where("size(targets) > 0").select("address", F.explode("targets").alias("to_url")).select("address", F.lit(None).cast("string").alias("from_url"), "to_url")
        if redirects is not None:
            ends = ends.unionByName(redirects.select(address(F.col("from_url")).alias("address"), "from_url", "to_url"))
        ends = materialize(ends.where("to_url IS NOT NULL").withColumn("to_address", address(F.col("to_url"))).where("address <> '' AND to_address <> '' AND address <> to_address"), "links")

        linked = ends.select(F.explode(F.array("from_url", "to_url")).alias("url")).where("url IS NOT NULL")
        linked = linked.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), address(F.col("url")).alias("address"))
        places = rows.select("host", "path", "address", F.lit(1).alias("n")).unionByName(linked.withColumn("n", F.lit(0)))
        places = materialize(places.groupBy("host", "path", "address").agg(F.sum("n").alias("rows")), "addresses")
        decided = places.join(materialize(ruled(places, rules), "ruled"), ["host", "path"], "left")
        decided = materialize(decided, "decided")

        spoken = decided.where("address <> '' AND rule IS NOT NULL").groupBy("address").agg(F.max(F.col("verdict") == "block").alias("block"), F.max(F.col("verdict") == "allow").alias("allow"))
        spoken = materialize(spoken.withColumn("node", F.sha2("address", 256)), "spoken")
        member = components(ends.select(F.sha2("address", 256).alias("a"), F.sha2("to_address", 256).alias("b")))
        voiced = spoken.join(member, "node", "left").select(F.coalesce("root", "node").alias("root"), "block", "allow")
        blocked = materialize(voiced.groupBy("root").agg(F.max("block").alias("block"), F.max("allow").alias("allow")).where("block AND NOT allow").select("root"), "blocked")
        silent = decided.where("address <> '' AND rule IS NULL").select("host", "path", "address", F.sha2("address", 256).alias("node"))
        silent = silent.join(member, "node", "left").select("host", "path", "address", F.coalesce("root", "node").alias("root"))
        reached = materialize(silent.join(blocked, "root", "left_semi").select("host", "path", "address", F.lit(True).alias("reached")), "reached")

        told = decided.where("rows > 0").join(reached, ["host", "path", "address"], "left").select(
            F.struct("host", "path", "address").alias("place"), "rows", "rule",
            F.coalesce("verdict", F.when(F.col("reached"), "block"), F.lit("allow")).alias("verdict"),
            F.when(F.col("rule").isNotNull(), "rule").when(F.col("reached"), "alias").otherwise("none").alias("via"),
        )
        asked = rows.select("page_id", F.struct("host", "path", "address").alias("place"))
        judged = join_counted(asked, told, "place", "page_id", F.col("rows"))
        return work.keep(judged.select("page_id", "place.host", "place.path", "rule", "verdict", "via"), "judged")
