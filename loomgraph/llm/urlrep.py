"""Judge urls: listed rules first, else an empirical-Bayes reputation of the host.

DataFrame functions only. Labelled page outcomes (good or not) are counted per host, registered
domain and suffix. Each level's beta prior is centred on its parent's posterior mean; its strength
comes from the level's own over-dispersion by the method of moments of the beta-binomial. A host
is allowed if the lower bound (mean less z standard deviations) of its posterior good rate reaches
a threshold, so a host without labels stands as its domain does.

Counts are combined map-side, so a host with a third of all pages is one partial row per task. What is known of
suffixes, domains and hosts comes back to domains, hosts and pages by joins that broadcast hot keys and shuffle the others.

For reputation, a host's port and a full stop at its end don't count. The suffix is the longest listed one, else the last label;
the domain has one label more. `suffixes` is a parameter, for a list as long as is wanted; the default is a short one.
An address in numbers is its own domain and suffix.

Defined cases: a null url, or one without "://", has empty host and path and is judged as the empty
host; labels of one page add up; repeated page rows each count and each get the verdict; pages with
null ids count as unlabelled; no labels at all give every host the prior mean 1/2; very long urls are read whole; hosts of
equal standing are judged alike, for nothing is ranked; further columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_on_hot_key, stage

#: Rules as (verdict, host/path-start).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Suffixes of several labels under which anyone registers names.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk",
    "com.au", "edu.au", "gov.au", "net.au", "org.au", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "com.br", "gov.br", "net.br", "org.br",
    "com.cn", "gov.cn", "net.cn", "org.cn", "co.in", "gov.in", "net.in", "org.in", "co.kr", "go.kr", "or.kr",
    "co.id", "co.il", "co.za", "com.ar", "com.hk", "com.mx", "com.my", "com.pl", "com.sg", "com.tr", "com.tw", "com.ua",
    "appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app",
    "s3.amazonaws.com",
)
Z, MIN_GOOD = 1.645, 0.5
#: The prior of the root, and the bounds of the over-dispersion of a level.
ROOT_GOOD, ROOT_ALL, LEAST_RHO, MOST_RHO = 1.0, 2.0, 0.001, 0.5
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    empty = F.lit("")
    return (
        F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), empty),
        F.coalesce(F.regexp_extract(url, PARTS, 2), empty),
    )


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The rule that fits and its verdict, both null if none fits. Rules are configuration: a short list."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later, longer ones win
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


ADDRESS = r"^(\[.*|[0-9]+(\.[0-9]+){3})$"


def suffix_and_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    name = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"\.$", "")
    labels = F.split(name, r"\.")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")
    suffix, domain = last(1), last(2)
    for k, listed in _by_length(suffixes):  # later, longer ones win
        suffix, domain = F.when(last(k).isin(*listed), last(k)).otherwise(suffix), F.when(last(k).isin(*listed), last(k + 1)).otherwise(domain)
    address = name.rlike(ADDRESS)
    return F.when(address, name).otherwise(suffix), F.when(address, name).otherwise(domain)


def _by_length(suffixes: tuple[str, ...]) -> list[tuple[int, list[str]]]:
    lengths = sorted({s.count(".") + 1 for s in suffixes})
    return [(k, [s for s in suffixes if s.count(".") + 1 == k]) for k in lengths]


def _posterior(level: DataFrame, parent_mean: Column) -> DataFrame:
    """alpha and beta of each node, from n, good and its parent's mean; kappa is the level's prior strength."""
    n, good, m = F.col("n"), F.col("good"), F.col("m")
    spread = F.when(n > 0, n * (good / n - m) * (good / n - m)).otherwise(0.0)
    seen = F.when(n > 0, m * (1 - m)).otherwise(0.0)
    over = F.when(n > 0, m * (1 - m) * (n - 1)).otherwise(0.0)
    with_mean = level.withColumn("m", parent_mean)
    rho = with_mean.agg(F.sum(spread).alias("s"), F.sum(seen).alias("e"), F.sum(over).alias("o")).select(
        F.round(F.least(F.greatest(F.when(F.col("o") > 0, (F.col("s") - F.col("e")) / F.col("o")).otherwise(F.lit(LEAST_RHO)), F.lit(LEAST_RHO)), F.lit(MOST_RHO)), 9)
    ).first()[0]  # one number
    kappa = (1 - rho) / rho
    return with_mean.withColumns({"alpha": kappa * m + good, "beta": kappa * (1 - m) + (n - good)}).drop("m")


def reputations(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Per host of (host, n labelled, good): n, good, the posterior's mean and lower bound, and `rows`, how many it has."""
    rows = outcomes.count()
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    sums = [F.sum("n").cast("double").alias("n"), F.sum("good").cast("double").alias("good")]
    hosts = stage(outcomes.groupBy("host").agg(*sums, F.count(F.lit(1)).alias("rows")).withColumns({"suffix": suffix, "domain": domain}), rows=rows)
    rows, members = hosts.count(), F.count(F.lit(1)).alias("members")
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    root = hosts.agg((F.coalesce(F.sum("good"), F.lit(0.0)) + ROOT_GOOD) / (F.coalesce(F.sum("n"), F.lit(0.0)) + ROOT_ALL)).first()[0]
    domains = stage(hosts.groupBy("suffix", "domain").agg(*sums, members), rows=rows)
    of_suffix = _posterior(domains.groupBy("suffix").agg(*sums, members.alias("domains")), F.lit(root)).select("suffix", "domains", F.round(mean, 9).alias("suffix_mean"))
    domains = stage(join_on_hot_key(domains, stage(of_suffix, rows=rows), "suffix", "domains"), rows=rows)
    of_domain = stage(_posterior(domains, F.col("suffix_mean")).select("domain", "members", F.round(mean, 9).alias("domain_mean")), rows=rows)
    both = F.col("alpha") + F.col("beta")
    deviation = F.sqrt(F.col("alpha") * F.col("beta") / (both * both * (both + 1)))
    known = _posterior(stage(join_on_hot_key(hosts, of_domain, "domain", "members"), rows=rows), F.col("domain_mean")).select(
        "host",
        F.col("n").cast("long").alias("n_labelled"),
        F.col("good").cast("long").alias("n_good"),
        F.round(mean, 6).alias("good_rate"),
        F.round(mean - Z * deviation, 6).alias("good_bound"),
        "rows",
    )
    return stage(known, rows=rows)


def judge(pages: DataFrame, labels: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, min_good: float = MIN_GOOD, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and the host's reputation. `labels` has doc_id
    (a page's id) and quality, 1 for a good outcome.
    """
    host, path = host_and_path(F.col("url"))
    urls = stage(pages.select("page_id", host.alias("host"), path.alias("path")))
    seen = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good")
    )
    counts = urls.select("page_id", "host").join(seen, "page_id", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("good_bound") >= min_good, "allow").otherwise("block")
    return join_on_hot_key(urls, reputations(counts, suffixes), "host", "rows", short=False).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "n_labelled", "n_good", "good_rate", "good_bound"
    )


_HOST = r"regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '\.$', '')"


def _registered(more: int, address: str) -> str:
    """SQL of suffix_and_domain: the last labels of a host, `more` than its suffix has."""
    cases = [f"WHEN array_to_string(parts[-{k}:], '.') IN ({', '.join(repr(s) for s in listed)}) THEN array_to_string(parts[-{k + more}:], '.')" for k, listed in reversed(_by_length(SUFFIXES))]
    return f"CASE WHEN {address} THEN name {' '.join(cases)} ELSE array_to_string(parts[-{1 + more}:], '.') END"


_ADDRESS = f"regexp_matches(name, '{ADDRESS}')"


def _level(name: str, base: str, mean: str) -> str:
    """SQL of _posterior: `name` is `base` with alpha and beta."""
    return f"""{name}_rho AS (
  SELECT round(least(greatest(CASE WHEN o > 0 THEN (s - e) / o ELSE {LEAST_RHO} END, {LEAST_RHO}), {MOST_RHO})::DOUBLE, 9) AS rho FROM (
    SELECT sum(CASE WHEN n > 0 THEN n * (good / n - {mean}) * (good / n - {mean}) ELSE 0 END) AS s,
           sum(CASE WHEN n > 0 THEN {mean} * (1 - {mean}) ELSE 0 END) AS e,
           sum(CASE WHEN n > 0 THEN {mean} * (1 - {mean}) * (n - 1) ELSE 0 END) AS o FROM {base})
), {name} AS (
  SELECT *, (1 - rho) / rho * {mean} + good AS alpha, (1 - rho) / rho * (1 - {mean}) + (n - good) AS beta FROM {base}, {name}_rho
)"""


ORACLE = rf"""
WITH urls AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '{PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages
), seen AS (
  SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), counts AS (
  SELECT host, sum(coalesce(n, 0))::DOUBLE AS n, sum(coalesce(good, 0))::DOUBLE AS good FROM urls LEFT JOIN seen ON page_id = doc_id GROUP BY host
), hosts AS (
  SELECT *, {_registered(0, _ADDRESS)} AS suffix, {_registered(1, _ADDRESS)} AS domain
  FROM (SELECT *, {_HOST} AS name, string_split({_HOST}, '.') AS parts FROM counts)
), root AS (
  SELECT (sum(good) + {ROOT_GOOD}::DOUBLE) / (sum(n) + {ROOT_ALL}::DOUBLE) AS root FROM hosts
), suffix_base AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(root) AS root FROM hosts, root GROUP BY suffix
), {_level("suffixes", "suffix_base", "root")}, domain_base AS (
  SELECT d.*, round(alpha / (alpha + beta), 9) AS suffix_mean
  FROM (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY suffix, domain) d
  JOIN (SELECT suffix, alpha, beta FROM suffixes) s USING (suffix)
), {_level("domains", "domain_base", "suffix_mean")}, host_base AS (
  SELECT host, h.n, h.good, round(alpha / (alpha + beta), 9) AS domain_mean
  FROM hosts h JOIN (SELECT domain, alpha, beta FROM domains) d USING (domain)
), {_level("known", "host_base", "domain_mean")}, judged AS (
  SELECT host, n::BIGINT AS n_labelled, good::BIGINT AS n_good, round(alpha / (alpha + beta), 6) AS good_rate,
         round(alpha / (alpha + beta) - {Z}::DOUBLE * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))), 6) AS good_bound FROM known
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM urls
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN good_bound >= {MIN_GOOD} THEN 'allow' ELSE 'block' END AS verdict,
       n_labelled, n_good, good_rate, good_bound
FROM ruled JOIN judged USING (host)
"""
