"""URL filters that follow redirects.

Pages that redirect to, or name as canonical, another address are the same
place under another name. Components of those links share their block
decisions; an explicit allow rule on an address always wins over a block that
reached it through an alias.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import connected_components

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Patterns of links between addresses, named entities and ports that go without saying (fixed values).
LINK_TAG = r"(?i)<link\b[^>]*>"
CANONICAL = r"(?i)[\s\"']rel\s*=\s*(?:\"[^\"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"
META_TAG = r"(?i)<meta\b[^>]*>"
IS_REFRESH = r"(?i)[\s\"']http-equiv\s*=\s*[\"']?\s*refresh\b"
BASE_TAG = r"(?i)<base\b[^>]*>"
HREF = r"(?i)[\s\"']href\s*=\s*(\"[^\"]*|'[^']*|[^\"'\s>]+)"
REFRESH = r"(?i)\burl\s*=\s*(\"[^\"]*|'[^']*|[^\"'\s>;]+)"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&#47;": "/", "&#x2f;": "/", "&#x2F;": "/", "&#58;": ":", "&#x3a;": ":", "&#x3A;": ":", "&#38;": "&", "&#x26;": "&", "&amp;": "&"}
PORTS = {"http": "80", "https": "443"}


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _matched(rows: DataFrame, rules: Sequence[tuple[str, str, str]], host: str = "host", path: str = "path") -> DataFrame:
    """``rows`` with ``rule`` (text) and ``own`` (allow or block) of the longest fitting rule, or nulls; of equal rules allow wins.

    Rules are rows of a table, gathered by host. Hosts are met with it by their
    last labels, once for each number of labels that rules have. The table is
    as large as the list of rules, which the driver holds, so it is broadcast.
    """
    columns = rows.columns
    best = None
    listed = sorted(set(rules))
    for n in sorted({r[1].count(".") + 1 for r in listed}):
        name = f"__rules{n}"
        at = rows.sparkSession.createDataFrame([r for r in listed if r[1].count(".") + 1 == n], "own string, rule_host string, prefix string")
        one = F.struct(F.length(F.concat("rule_host", "prefix")).alias("size"), (F.col("own") == "allow").alias("allow"), F.concat("rule_host", "prefix").alias("rule"), "own", "prefix")
        at = at.groupBy(F.col("rule_host").alias(f"__host{n}")).agg(F.collect_list(one).alias(name))
        labels = F.substring_index(F.col(host), ".", -n)
        rows = rows.join(F.broadcast(at), labels == F.col(f"__host{n}"), "left")
        fits = F.array_max(F.filter(name, lambda r: F.startswith(F.col(path), r["prefix"])))
        best = fits if best is None else F.greatest(best, fits)
    if best is None:
        return rows.select(*columns, F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("own"))
    rows = rows.withColumn("__best", best)
    return rows.select(*columns, F.col("__best.rule").alias("rule"), F.col("__best.own").alias("own"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _parts(url: Column) -> Column:
    """Scheme (lower-cased; empty if there is none), host with port, path and query with its mark of an address, its fragment left out."""
    absolute = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    return _let(
        F.regexp_extract(F.trim(url), r"^([^#]*)", 1),
        lambda u: F.struct(
            F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).alias("scheme"),
            F.regexp_extract(u, absolute + r"([^/?]*)", 1).alias("host"),
            F.regexp_extract(u, absolute + r"[^/?]*([^?]*)", 1).alias("path"),
            F.regexp_extract(u, r"^[^?]*(.*)$", 1).alias("query"),
        ),
    )


def _straight(path: Column) -> Column:
    """A path that begins with a slash, without its dot segments."""

    def step(done: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    def joined(p: Column) -> Column:
        walked = F.aggregate(F.split(F.substring(p, 2, F.length(p)), "/"), F.array().cast("array<string>"), step)
        return _let(walked, lambda w: F.concat(F.lit("/"), F.array_join(w, "/"), F.when(F.rlike(p, F.lit(r"/\.\.?$")) & (F.size(w) > 0), "/").otherwise("")))

    return F.when(F.contains(path, F.lit("/.")), _let(path, joined)).otherwise(path)


def address(url: Column) -> Column:
    """An absolute address in the form in which nodes are compared; null if it is none.

    Scheme and host are lower-cased, the scheme's own port, the fragment (which
    is never sent) and dot segments go, and an empty path is ``/``.
    """

    def normal(p: Column) -> Column:
        host = F.translate(p["host"], UPPER, UPPER.lower())
        for scheme, port in PORTS.items():
            host = F.when(p["scheme"] == scheme, F.regexp_replace(host, f":(?:{port})?$", "")).otherwise(host)
        path = F.when(p["path"] == "", "/").otherwise(p["path"])
        return F.when((p["scheme"] != "") & (p["host"] != ""), F.concat(p["scheme"], F.lit("://"), host, _straight(path), p["query"]))

    return _let(_parts(url), normal)


def resolved(base: Column, target: Column) -> Column:
    """What a reference means on a page, as RFC 3986 resolves it; null if there is no absolute base to resolve it by."""

    def whole(x: Column) -> Column:
        b, t = x["base"], x["target"]
        root = F.concat(b["scheme"], F.lit("://"), b["host"])
        folder = F.regexp_extract(F.when(b["path"] == "", "/").otherwise(b["path"]), r"^(.*/)", 1)
        return (
            F.when(F.rlike(t, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), t)
            .when(b["scheme"] == "", None)
            .when(F.startswith(t, F.lit("//")), F.concat(b["scheme"], F.lit(":"), t))
            .when(F.startswith(t, F.lit("/")), F.concat(root, t))
            .when(F.startswith(t, F.lit("?")), F.concat(root, b["path"], t))
            .when(t == "", F.concat(root, b["path"], b["query"]))
            .otherwise(F.concat(root, folder, t))
        )

    return address(_let(F.struct(_parts(base).alias("base"), F.regexp_extract(F.trim(target), r"^([^#]*)", 1).alias("target")), whole))


def _told(tag: Column, pattern: str) -> Column:
    """An attribute's value without its opening quote, entities decoded."""
    value = F.regexp_replace(F.regexp_extract(tag, pattern, 1), "^[\"']", "")
    for entity, mark in ENTITIES.items():
        value = F.replace(value, F.lit(entity), F.lit(mark))
    return value


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b) pairs of addresses that canonical links and refresh redirects tie together, all of a page's.

    References are resolved by the page's first ``base`` tag, or else by its
    address. Null pages, pages without an absolute address, and references
    that lead nowhere else give no pair; repeated pages repeat theirs.
    """
    u, h = F.col(f"`{url}`"), F.col(f"`{html}`")
    # Most pages have neither word; a plain search spares them the patterns.
    low = F.lower(h)
    some = pages.where(F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("refresh"))).select(u.alias("u"), h.alias("h"))
    whole = lambda tag: F.regexp_extract_all(F.col("h"), F.lit(tag.replace("(?i)", "(?i)(", 1) + ")"), F.lit(1))
    canonical = F.transform(F.filter(whole(LINK_TAG), lambda t: F.rlike(t, F.lit(CANONICAL))), lambda t: _told(t, HREF))
    refresh = F.transform(F.filter(whole(META_TAG), lambda t: F.rlike(t, F.lit(IS_REFRESH))), lambda t: _told(t, REFRESH))
    based = _told(F.regexp_extract(F.col("h"), BASE_TAG, 0), HREF)
    found = some.select("u", F.when(based != "", based).alias("based"), F.explode(F.array_distinct(F.concat(canonical, refresh))).alias("t")).where("t != ''")
    pairs = found.select(address(F.col("u")).alias("a"), F.coalesce(resolved(F.col("u"), F.col("based")), F.col("u")).alias("by"), "t")
    return pairs.select("a", resolved(F.col("by"), F.col("t")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a != b")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of ``pages``.

    rules: (``allow`` or ``block``, host, path prefix). A page's own rule
    decides it; without one it is blocked if any address of its component is
    blocked by a rule, and else allowed. A null URL, or one without ``://``,
    has an empty host and path and no rule; null html has no links. Repeated
    rows give repeated rows.
    """
    u = F.col(f"`{url}`")
    edges = links(pages, url, html)
    parts = connected_components(edges)
    nodes = _matched(parts.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules)
    reached = nodes.where("own = 'block'").select("component").distinct()
    tainted = parts.join(reached, "component", "left_semi").select(F.col("node").alias("__address"))
    judged = _matched(pages.select(F.col(f"`{page_id}`").alias("page_id"), address(u).alias("__address"), host_of(u).alias("host"), path_of(u).alias("path")), rules)
    # Pages with a rule of their own, and those without an address, need no look at aliases.
    asks = judged.where("own IS NULL AND __address IS NOT NULL")
    settled = judged.where("own IS NOT NULL OR __address IS NULL").select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    asked = asks.join(tainted.withColumn("hit", F.lit(True)), "__address", "left").select(
        "page_id", "host", "path", "rule", F.when(F.col("hit"), "block").otherwise("allow").alias("verdict")
    )
    return settled.unionByName(asked)
