"""URL rules and empirical-Bayes host reputation.

Labelled page outcomes (1: bad) are counted by host. The rate of a suffix is
shrunk to the rate of all pages, that of a registered domain to its suffix, that
of a host to its domain, each through a beta prior whose strength is fitted by
moments at its level. A page is blocked if the lower bound of its host's
posterior, mean less Z standard deviations, is above a limit. A host's suffix is
the longest of SUFFIXES, a parameter, that it ends in, else its last label; its
registered domain has one label more. An address of numbers is its own domain
and suffix, and so is a host that has no label before its suffix.

Defined cases: a null url, or one without "://", has an empty host and path and
so is judged like any host. A null outcome is not counted. Hosts without
outcomes take their domain's estimate. An empty table gives no rows. Repeated
rows are all returned. Extra columns are kept out of the way: only the named
columns are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import BROADCAST_BYTES, Written, by_frequent_key, scratch

#: (host, path prefix, verdict); a rule fits its host and all subdomains, the longest wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: The bad rate above which a host is blocked, and the standard deviations below the mean that must be above it.
LIMIT, Z = 0.1, 1.0
#: The prior's least and greatest strength, in pages.
STRENGTH = (2.0, 200.0)
#: A page is bad if at least this share of its words end in doubled marks, as junk does.
JUNK = 0.2
#: Suffixes of more than one label under which sites are registered: a list of common ones; pass a fuller one where it matters.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "com.cn",
    "com.br", "com.mx", "com.ar", "com.tr", "co.in", "co.za", "com.sg", "com.hk", "com.tw", "github.io", "blogspot.com",
)


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    host = F.regexp_extract(url.substr(at + 3, F.length(url)), r"^[^/?#]*", 0)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, ascii_lower).otherwise("")


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    path = F.regexp_extract(url.substr(at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


_ADDRESS = r"^[0-9]+(\.[0-9]+){3}(:[0-9]+)?$|^\[.*\](:[0-9]+)?$"


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    name = F.regexp_replace(host, ":[0-9]+$", "")
    out = F.substring_index(name, ".", -1)
    for s in sorted(suffixes, key=len):
        out = F.when((name == s) | name.endswith("." + s), s).otherwise(out)
    return F.when(host.rlike(_ADDRESS), host).otherwise(out)


def domain_of(host: Column, suffixes=SUFFIXES) -> Column:
    name, suffix = F.regexp_replace(host, ":[0-9]+$", ""), suffix_of(host, suffixes)
    before = name.substr(F.lit(1), F.length(name) - F.length(suffix) - 1)
    own = F.concat(F.substring_index(before, ".", -1), F.lit("."), suffix)
    return F.when(host.rlike(_ADDRESS), host).when(name == suffix, name).otherwise(own)


def junk_outcome(html: Column) -> Column:
    """1 if a share JUNK or more of the words of the page end in doubled marks."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]*>", " ")
    marks = F.regexp_count(text, F.lit(r"[!%$#*&]{2}(?:\s|$)"))
    words = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(marks >= JUNK * F.greatest(words, F.lit(1)), 1).otherwise(0)


def _shrunk(level: DataFrame, parent_rate: str, z_columns: list[str]) -> DataFrame:
    """level(…, n, bad, parent_rate) with the posterior mean `rate` and `sd` under a prior fitted over the level."""
    # Moments of a beta-binomial: between-group variance of the rates beyond what counting alone gives.
    fit = level.where("n > 0").agg(
        F.sum("n").alias("N"),
        F.sum(F.col("bad")).alias("B"),
        F.count(F.lit(1)).alias("G"),
        F.sum(F.expr(f"n * pow(bad / n - {parent_rate}, 2)")).alias("S"),
        F.sum(F.expr(f"{parent_rate} * (1 - {parent_rate})")).alias("E"),
        F.sum(F.expr(f"n * {parent_rate} * (1 - {parent_rate})")).alias("V"),
    )
    rho = F.expr("CASE WHEN V > E THEN greatest((S - E) / (V - E), 0) ELSE 0 END")
    strength = F.least(F.greatest(1 / F.greatest(rho, F.lit(1e-9)) - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))
    fit = fit.select(F.coalesce(F.round(strength, 6), F.lit(STRENGTH[1])).alias("strength"))
    out = level.withColumn("strength", fit.scalar())
    a = F.expr(f"bad + strength * {parent_rate}")
    t = F.expr("n + strength")
    rate = a / t
    return out.select(*z_columns, F.round(rate, 9).alias("rate"), F.sqrt(rate * (1 - rate) / (t + 1)).alias("sd"))


def reputation(outcomes: DataFrame, z: float = Z, limit: float = LIMIT, suffixes=SUFFIXES) -> DataFrame:
    """(host, n, bad, rate, lower, blocked) from outcomes(host, bad)."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    total = hosts.agg(F.expr("coalesce(round(sum(bad) / nullif(sum(n), 0), 9), 0.0)").alias("parent"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _shrunk(suffixes.withColumn("parent", total.scalar()), "parent", ["suffix"]).select("suffix", F.col("rate").alias("parent"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = _shrunk(domains.join(suffixes, "suffix"), "parent", ["domain"]).select("domain", F.col("rate").alias("parent"))
    found = _shrunk(hosts.join(domains, "domain"), "parent", ["host", "n", "bad"])
    lower = F.round(F.col("rate") - z * F.col("sd"), 6)
    return found.select("host", "n", "bad", "rate", lower.alias("lower"), (lower > limit).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages."""
    df = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("__url"))
    df = df.select("id", F.coalesce(host_of(F.col("__url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("__url")), F.lit("")).alias("path"))
    df = df.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    sizes = df.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    known = reputation(outcomes).select("host", "blocked").join(sizes, "host")
    with scratch() as keep:
        known = Written(known, "hosts")
        keep(known)
    if known.bytes() <= BROADCAST_BYTES:
        out = df.join(F.broadcast(known.df.drop("pages")), "host", "left")
    else:
        out = by_frequent_key(df, known.df, "host", "pages", df.count(), "left")
    own = F.when(F.coalesce(F.col("blocked"), F.lit(False)), "block").otherwise("allow")
    return out.select("id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), own).alias("verdict"))


def query(pages: DataFrame) -> DataFrame:
    outcomes = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), junk_outcome(F.col("html")).alias("bad"))
    return judge(pages, outcomes).withColumnRenamed("id", "page_id")


def oracle_sql() -> str:
    def shrunk(name: str, source: str, keys: str) -> str:
        return f"""
        {name}_fit AS (SELECT coalesce(round(least(greatest(1 / greatest(CASE WHEN V > E THEN greatest((S - E) / (V - E), 0) ELSE 0 END, 1e-9) - 1, {STRENGTH[0]}), {STRENGTH[1]}), 6), {STRENGTH[1]}) AS strength
          FROM (SELECT sum(n * pow(bad / n - parent, 2)) AS S, sum(parent * (1 - parent)) AS E, sum(n * parent * (1 - parent)) AS V FROM {source} WHERE n > 0)),
        {name} AS (SELECT {keys}, round(r, 9) AS rate, sqrt(r * (1 - r) / (n + strength + 1)) AS sd
          FROM (SELECT *, (bad + strength * parent) / (n + strength) AS r FROM {source}, {name}_fit))"""

    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what else v}'" for h, p, v in rules) + " END"
    return rf"""
    WITH cut AS (SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    seen AS (SELECT host, CASE WHEN len(regexp_extract_all(t, '[!%$#*&]{{2}}(\s|$)')) >= {JUNK} * greatest(len(regexp_extract_all(t, '\S+')), 1) THEN 1 ELSE 0 END AS bad
             FROM (SELECT host, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS t FROM p)),
    hosts AS (SELECT host, count(*) AS n, sum(bad) AS bad, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
                     string_split(host, '.')[-1] AS suffix FROM seen GROUP BY host),
    total AS (SELECT coalesce(round(sum(bad) / nullif(sum(n), 0), 9), 0) AS parent FROM hosts),
    s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(parent) AS parent FROM hosts, total GROUP BY suffix),
    {shrunk("s1", "s0", "suffix")},
    d0 AS (SELECT domain, h.suffix, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS parent FROM hosts h JOIN s1 ON s1.suffix = h.suffix GROUP BY ALL),
    {shrunk("d1", "d0", "domain")},
    h0 AS (SELECT host, n, bad, rate AS parent FROM hosts h JOIN d1 ON d1.domain = h.domain),
    {shrunk("h1", "h0", "host")}
    SELECT page_id, p.host, path, {case(True)} AS rule,
           coalesce({case(False)}, CASE WHEN round(rate - {Z} * sd, 6) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
    FROM p JOIN h1 ON h1.host = p.host""".replace("host = '", "p.host = '").replace("ends_with(host", "ends_with(p.host")
