"""URL filter with redirect equivalence.

Rules name a host and a path prefix and say block or allow. A page's own longest rule decides. Pages without a rule take
part in equivalence classes: the connected components of redirect and canonical-link edges. A class that holds a blocked
url (in the table or only named by a link) blocks its members; an explicit allow rule always has precedence for the url
it fits. Everything else is allowed. Urls are the same page if they differ only in their fragment or in the case of scheme
and host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row
from .components import components

#: (verdict, host, path): the rules that the query judges pages by.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; null or no ://: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct(rule, verdict) of the longest rule that fits, else null. Ties: allow first, then the order given."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    found = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ranked
    ]
    return F.coalesce(*found, F.lit(None).cast("struct<rule:string,verdict:string>"))


#: A tag up to the > that no quotes hold, whatever its length; an attribute's value, quoted or not.
S = r"[ \t\n\f\r]"
TAG = rf"""(?is)(<(?:link|meta)(?:{S}|/)(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)"""
VALUE = rf"""{S}*=({S}*"[^"]*"|{S}*'[^']*'|{S}*[^ \t\n\f\r"'>]+)"""
BLANKS = " \t\n\f\r"
#: Character references that urls hold, and what they stand for; the ampersand last.
REFERENCES = (("&#38;", "&amp;"), ("&#x26;", "&amp;"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#47;", "/"), ("&#x2F;", "/"), ("&#x2f;", "/"), ("&#58;", ":"), ("&#x3A;", ":"), ("&#x3a;", ":"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def page_of(url: Column) -> Column:
    """A url without its fragment, scheme and host in lower case."""
    whole = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    start = F.regexp_extract(whole, r"(?s)^(.*?://[^/?]*)", 1)
    return F.concat(F.translate(start, UPPER, LOWER), F.substring(whole, F.length(start) + 1, F.length(whole)))


def _bare(x: Column) -> Column:
    """An attribute's value without blanks and quotes around it, references decoded."""
    trim = lambda y: F.trim(y, F.lit(BLANKS))
    x = trim(F.regexp_replace(trim(x), r"""^["']|["']$""", ""))
    for name, stands in REFERENCES:
        x = F.replace(x, F.lit(name), F.lit(stands))
    return x


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """df with just these columns, each worked out once: the optimiser doesn't copy expressions over a generator."""
    return df.select(F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("s")).select("s.*")


def edges_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): each page's url and the canonical or redirect target that its html names. Null urls and html name none.

    Targets are read from tags of any length outside comments, resolved against the page's url (dot segments taken out),
    and given without fragments, as is the page's own url. Targets that aren't web addresses, or are the page itself,
    make no edge.
    """
    u, h = F.col(f"`{url}`"), F.col(f"`{html}`")
    some = pages.where(u.isNotNull() & h.isNotNull() & h.rlike("(?i)canonical|refresh")).select(u.alias("u"), h.alias("h"))
    tags = some.select("u", F.explode(F.regexp_extract_all(F.regexp_replace("h", r"(?s)<!--.*?-->", ""), F.lit(TAG), 1)).alias("t"))
    attribute = lambda name: _bare(F.regexp_extract("t", rf"""(?is)[ \t\n\f\r"'/]{name}{VALUE}""", 1))
    values = _step(tags, u=F.col("u"), tag=F.lower(F.substring("t", 2, 4)), **{k.replace("-", "_"): attribute(k) for k in ("rel", "href", "http-equiv", "content")})
    after = F.regexp_extract("content", rf"(?is)^(?:{S}|[\d.])*[;,]?{S}*url{S}*=(.*)$", 1)
    canonical = (F.col("tag") == "link") & F.lower("rel").rlike(rf"(^|{S})canonical({S}|$)")
    refresh = (F.col("tag") == "meta") & (F.lower("http_equiv") == "refresh")
    named = _step(values, u=F.col("u"), x=F.when(canonical, F.col("href")).when(refresh, _bare(after))).where("x is not null and x <> '' and not startswith(x, '#')")
    part = lambda c, pattern: F.regexp_extract(c, "(?s)" + pattern, 1)
    own = _step(named, u=F.col("u"), x=F.col("x"), scheme=part("u", "^([^:/?#]*:)//"), origin=part("u", "^(.*?://[^/?#]*)"), page=part("u", "^([^?#]*)"))
    x, origin, page = F.col("x"), F.col("origin"), F.col("page")
    folder = F.when(page == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_extract(page, r"(?s)^(.*/)", 1))
    full = (
        F.when(x.rlike(SCHEME), F.when(x.contains("://"), x))
        .when(origin == "", F.lit(None))
        .when(x.startswith("//"), F.concat("scheme", x))
        .when(x.startswith("/"), F.concat(origin, x))
        .when(x.startswith("?"), F.concat(page, x))
        .otherwise(F.concat(folder, x))
    )
    meant = _step(_step(own, u=F.col("u"), f=full).where("f is not null"), u=F.col("u"), f=page_of(F.col("f")))
    parts = _step(meant, u=F.col("u"), start=part("f", "^(.*?://[^/?]*)"), path=part("f", "^.*?://[^/?]*([^?]*)"), query=part("f", "^.*?://[^?]*(.*)$"))
    step = lambda done, y: F.when(y == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(y == ".", done).otherwise(F.concat(done, F.array(y)))
    pieces = F.split("path", "/")
    kept = F.array_join(F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), F.array(F.lit("")), step), "/")
    kept = F.concat(kept, F.when(F.element_at(pieces, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    path = F.when(F.col("path").rlike(r"/\.\.?(/|$)"), kept).otherwise(F.col("path"))
    return _step(parts, a=page_of(F.col("u")), b=F.concat("start", path, "query")).where("a <> b")


def url_filter(pages: DataFrame, edges: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to pages; edges: (a, b) urls that are equivalent.

    Null urls have an empty host and path, fit no rule and are allowed; repeated urls are judged alike; an empty table
    gives an empty result. Columns of pages named like the four added ones are replaced.
    """
    rows = as_row(pages, "row").withColumn("_url", F.col(f"row.`{url}`"))
    rows = rows.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url"))).withColumn("_page", page_of(F.col("_url")))
    rows = rows.withColumn("_own", rule_of(F.col("_host"), F.col("_path"), rules))
    if edges is not None:
        of = components(edges.select(*[page_of(F.col(f"`{c}`")).alias(k) for k, c in zip("ab", edges.columns, strict=True)]))
        if not of.isEmpty():
            own = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
            blocked = of.withColumn("_v", own["verdict"]).groupBy("component").agg(F.max(F.coalesce(F.col("_v") == "block", F.lit(False))).alias("_bad"))
            bad = of.join(blocked.where("_bad"), "component").select(F.col("node").alias("_page"), F.lit("block").alias("_class"))
            ruled, free = rows.where("_own is not null"), rows.where("_own is null")
            rows = free.join(bad, "_page", "left").unionByName(ruled, allowMissingColumns=True)
    if "_class" not in rows.columns:
        rows = rows.withColumn("_class", F.lit(None).cast("string"))
    added = {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_own.rule"), "verdict": F.coalesce("_own.verdict", "_class", F.lit("allow"))}
    return rows.select(*[F.col(f"row.`{c}`") for c in pages.columns if c not in added], *[v.alias(k) for k, v in added.items()])
