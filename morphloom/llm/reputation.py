"""URL filter: rules first, then empirical-Bayes reputation of the host.

Labelled page outcomes (good: ``quality`` 1 and not ``toxic``) are counted by host. A
beta-binomial prior flows down from all pages to the suffix, the registered domain and the host:
each level's prior mean is its parent's posterior mean, and its strength is the moment estimate
of the spread of the level's groups around their parents' means. A host's posterior rate of good
pages is a beta distribution; a page is blocked if the upper bound of its host's rate is under
``threshold``, that is, if the posterior has more than ``level`` of its mass below it. The mass is
the beta integral over the log-odds, by Simpson's rule on either side of the threshold.

The suffix is the last label, or the last two where a country's label follows one of the general
ones of ``SECOND_LEVEL``; the registered domain has one label more; a host that is an address of
numbers is its own domain. Counting combines before each shuffle, repeated pages and labels are
counted before they meet, and joins to a level's parents, or of pages to hosts, tell hot keys apart.

Edge cases: a null url, or one without ``://``, has empty host and path, and is judged as the
host ''; labels with a null column are no outcome; repeated labels are several outcomes,
repeated pages are all returned; a table without labels leaves the prior mean one half; other
columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphloom.llm.keys import join_counted
from morphloom.storage import materialize

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: General labels under a country's.
SECOND_LEVEL = "ac co com edu gob gov go ne net nom or org".split()
LEVEL, THRESHOLD, WEAKEST, STRONGEST = 0.95, 0.5, 1.0, 1000.0
STEPS = 256


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path of every page."""
    part = lambda i: F.coalesce(F.regexp_extract("url", URL, i), F.lit(""))
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))


def with_domains(hosts: DataFrame) -> DataFrame:
    """``hosts`` with domain and suffix."""
    bare = F.regexp_replace("host", ":[0-9]*$", "")
    numbers = bare.rlike(r"^[0-9.]*[0-9][0-9.]*$") | bare.startswith("[")
    two = bare.rlike(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")
    last = lambda labels: F.regexp_extract(bare, rf"([^.]+\.){{0,{labels - 1}}}[^.]*$", 0)
    domain = F.when(numbers, bare).when(two, last(3)).otherwise(last(2))
    return hosts.withColumn("domain", domain).withColumn("suffix", F.when(numbers, F.lit("")).when(two, last(2)).otherwise(last(1)))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, pages, n outcomes and k good ones, for each host of any page."""
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    told = labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy(F.col("doc_id").cast("bigint").alias("page_id")).agg(F.count(F.lit(1)).alias("seen"), F.sum(good).alias("good"))
    each = parsed(pages).groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("pages")).join(told, "page_id", "left")
    total = lambda c: F.coalesce(F.sum(F.col("pages") * F.col(c)), F.lit(0)).cast("bigint").alias({"seen": "n", "good": "k"}[c])
    return with_domains(each.groupBy("host").agg(F.sum("pages").alias("pages"), total("seen"), total("good")))


def strength(groups: DataFrame) -> float:
    """Prior strength of a level by moments around the parents' means ``prior``: 1 / rho - 1, rho the correlation within groups."""
    n, m = F.col("n").cast("double"), F.col("prior")
    spread = m * (1 - m)
    found = groups.agg(F.sum((F.col("k") - n * m) ** 2 - n * spread).alias("over"), F.sum(n * (n - 1) * spread).alias("most")).first()
    if not found.most or not found.over or found.over <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, found.most / found.over - 1))


def _softplus(t: Column) -> Column:
    return F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))


def mass_below(a: Column, b: Column, at: float, steps: int = STEPS) -> Column:
    """The mass of a beta distribution below ``at``."""
    peak, wide = F.log(a / b), 12 * F.sqrt(1 / a + 1 / b)
    top = a * _softplus(-peak) + b * _softplus(peak)
    low, high = peak - wide - 40 / a, peak + wide + 40 / b
    cut = F.least(F.greatest(F.lit(math.log(at / (1 - at))), low), high)

    def simpson(start: Column, end: Column) -> Column:
        step = (end - start) / steps
        height = lambda t: F.exp(top - a * _softplus(-t) - b * _softplus(t))
        weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return step * F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda acc, i: acc + weight(i) * height(start + i * step))

    below, above = simpson(low, cut), simpson(cut, high)
    return below / (below + above)


def posterior(hosts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """host, pages, a and b of its posterior beta distribution, and its mass below ``threshold``."""
    overall = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mu = ((overall.k or 0) + 1) / ((overall.n or 0) + 2)
    domains = materialize(hosts.groupBy("domain").agg(F.min("suffix").alias("suffix"), F.count(F.lit(1)).alias("below"), F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.count(F.lit(1)).alias("below"), F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("prior", F.lit(mu)), "suffixes")
    said = lambda groups, s: (F.lit(s) * F.col("prior") + F.col("k")) / (F.lit(s) + F.col("n"))
    for on, groups in (("suffix", domains), ("domain", hosts)):
        means = suffixes.select(on, F.col("below").alias("n"), said(suffixes, strength(suffixes)).alias("prior"))
        suffixes = materialize(join_counted(groups, means, on, groups.count()), "priors")
    s = strength(suffixes)
    a, b = F.lit(s) * F.col("prior") + F.col("k"), F.lit(s) * (1 - F.col("prior")) + F.col("n") - F.col("k")
    shaped = suffixes.select("host", "pages", a.alias("a"), b.alias("b"))
    return shaped.withColumn("below", mass_below(F.col("a"), F.col("b"), threshold))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _when(rules: list[tuple[str, str]], pick: int) -> str:
    out = []
    for rule in sorted(rules, key=lambda r: -len(r[0])):
        host, _, path = rule[0].partition("/")
        path = "/" + path
        fits = f"(host = {_quote(host)} OR right(host, {len(host) + 1}) = {_quote('.' + host)}) AND left(path, {len(path)}) = {_quote(path)}"
        out.append(f"WHEN {fits} THEN {_quote(rule[pick])}")
    return " ".join(out)


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, level: float = LEVEL, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    hosts = materialize(outcomes(pages, labels), "hosts")
    judged = F.when(F.col("below") > level, "block").otherwise("allow").alias("judged")
    verdicts = materialize(posterior(hosts, threshold).select("host", F.col("pages").alias("n"), judged), "verdicts")
    out = join_counted(parsed(pages), verdicts, "host", verdicts.agg(F.sum("n")).first()[0] or 0)
    return out.select("page_id", "host", "path", F.expr(f"CASE {_when(rules, 0)} END").alias("rule"), F.expr(f"CASE {_when(rules, 1)} ELSE judged END").alias("verdict"))


def oracle() -> str:
    """The same by other means: urls cut at places, labels as lists, the mass by a fine midpoint sum over the rate's log-odds."""

    def level(name: str, source: str, key: str, parent: str) -> str:
        return f"""
        {name}_in AS (SELECT {source}.*, {parent} AS prior FROM {source}),
        {name}_s AS (SELECT CASE WHEN over > 0 AND most > 0 THEN greatest({WEAKEST}, least({STRONGEST}, most / over - 1)) ELSE {STRONGEST} END AS s
            FROM (SELECT sum(power(k - n * prior, 2) - n * prior * (1 - prior)) AS over, sum(CAST(n AS DOUBLE) * (n - 1) * prior * (1 - prior)) AS most FROM {name}_in) m),
        {name} AS (SELECT {name}_in.*, s * prior + k AS a, s * (1 - prior) + n - k AS b FROM {name}_in CROSS JOIN {name}_s)"""

    second = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
    from_lower = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    return f"""
    WITH cut AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce({from_lower}, '') AS rest FROM pages),
    upto AS (SELECT page_id, rest, list_min([x for x in [strpos(rest, '/'), strpos(rest, '?'), strpos(rest, '#'), length(rest) + 1] if x > 0]) AS h,
        list_min([x for x in [strpos(rest, '?'), strpos(rest, '#'), length(rest) + 1] if x > 0]) AS e FROM cut),
    urls AS (SELECT page_id, translate(left(rest, h - 1), '{UPPER}', '{LOWER}') AS host, CASE WHEN e > h THEN substr(rest, h, e - h) ELSE '' END AS path FROM upto),
    told AS (SELECT u.host, 1 AS n, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 ELSE 0 END AS k FROM urls u JOIN labels l ON u.page_id = l.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL),
    bare AS (SELECT host, CASE WHEN strpos(host, ':') > 0 AND regexp_full_match(list_last(string_split(host, ':')), '[0-9]*') THEN left(host, length(host) - length(list_last(string_split(host, ':'))) - 1) ELSE host END AS name
        FROM (SELECT DISTINCT host FROM urls) x),
    named AS (SELECT host, name, string_split(name, '.') AS ls, regexp_full_match(name, '[0-9.]*[0-9][0-9.]*') OR left(name, 1) = '[' AS address FROM bare),
    sized AS (SELECT *, CASE WHEN len(ls) > 1 AND ls[-2] IN ({second}) AND regexp_full_match(ls[-1], '[a-z][a-z]') THEN 2 ELSE 1 END AS deep FROM named),
    hosts AS (SELECT s.host, CASE WHEN address THEN name ELSE array_to_string(list_slice(ls, greatest(1, len(ls) - deep), len(ls)), '.') END AS domain,
        CASE WHEN address THEN '' ELSE array_to_string(list_slice(ls, greatest(1, len(ls) - deep + 1), len(ls)), '.') END AS suffix, coalesce(sum(t.n), 0) AS n, coalesce(sum(t.k), 0) AS k
        FROM sized s LEFT JOIN told t ON s.host = t.host GROUP BY ALL),
    domains AS (SELECT domain, min(suffix) AS suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
    {level("l1", "suffixes", "suffix", "(SELECT (sum(k) + 1.0) / (sum(n) + 2.0) FROM hosts)")},
    {level("l2", "domains", "domain", "(SELECT a / (a + b) FROM l1 WHERE l1.suffix = domains.suffix)")},
    {level("l3", "hosts", "host", "(SELECT a / (a + b) FROM l2 WHERE l2.domain = hosts.domain)")},
    spans AS (SELECT host, a, b, ln(a / b) - 12 * sqrt(1 / a + 1 / b) - 40 / a AS low, ln(a / b) + 12 * sqrt(1 / a + 1 / b) + 40 / b AS high FROM l3),
    fine AS (SELECT host, a, b, least(greatest({math.log(THRESHOLD / (1 - THRESHOLD))}, low), high) AS cut, low, high, unnest(range(0, 2000)) AS i FROM spans),
    mass AS (SELECT host, sum((cut - low) * exp(a * (p - ln(1 + exp(p))) - b * ln(1 + exp(p)) + top)) AS below, sum((high - cut) * exp(a * (q - ln(1 + exp(q))) - b * ln(1 + exp(q)) + top)) AS above
        FROM (SELECT *, low + (i + 0.5) * (cut - low) / 2000 AS p, cut + (i + 0.5) * (high - cut) / 2000 AS q, - a * ln(a / (a + b)) - b * ln(b / (a + b)) AS top FROM fine) g GROUP BY host),
    ruled AS (SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM urls)
    SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN m.below / (m.below + m.above) > {LEVEL} THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled r JOIN mass m ON r.host = m.host"""
