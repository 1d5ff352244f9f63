"""URL filters: rules by host and path, else the host's reputation, shrunk through beta-binomial priors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Labels that, under a country's label of two letters, make a suffix under which domains are registered (fixed values).
SECOND_LABELS = ("ac", "asn", "blog", "co", "com", "ed", "edu", "ernet", "firm", "gen", "go", "gob", "gouv", "gov", "govt", "gub", "gv", "id", "ind", "info", "k12", "lg", "ltd", "me", "mil", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "police", "pro", "res", "sch", "tm", "web")
LONG_SUFFIX = f"^({'|'.join(SECOND_LABELS)})[.][a-z][a-z]$"
#: Blocked: a bad rate above MAX_BAD with a posterior probability of 1 - DOUBT.
MAX_BAD, DOUBT = 0.5, 0.025
#: A prior never weighs more than so many labelled pages: two dozen bad ones of its own tell on any host.
MOST_WEIGHT = 20.0
_ADDRESS = "://([^/?#]*)([^?#]*)"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _ADDRESS, 1), _UP, _LOW)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _ADDRESS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (a struct of size, rule, verdict) whose host is this one or a parent of it and whose path the path starts with; else null."""
    known = []
    for rule, verdict in rules:
        at = (rule + "/").index("/")
        known.append(F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit("." + rule[:at]).alias("host"), F.lit(rule[at:]).alias("path")))
    fits = F.filter(F.array(*known), lambda r: F.concat(F.lit("."), host).endswith(r["host"]) & path.startswith(r["path"]))
    return F.array_max(fits)


def domain_of(host: Column, long_suffix: str = LONG_SUFFIX) -> Column:
    """The registered domain: the suffix and one label more; a host without a dot is its own. A port doesn't count.

    A suffix is the last label, or the last two where these match the pattern long_suffix: a country's and one of the
    labels that countries set aside for kinds of registrants. A host that is just such a pair is its own domain.
    """
    plain = F.substring_index(host, ":", 1)
    return F.when(F.substring_index(plain, ".", -2).rlike(long_suffix), F.substring_index(plain, ".", -3)).otherwise(F.substring_index(plain, ".", -2))


def strength(groups: DataFrame) -> DataFrame:
    """One row: the prior's weight k, in pages, from the spread of bad rates between groups (table n, bad), by moments.

    1 / (k + 1) is the correlation of two pages' outcomes within a group; k lies in 1 to MOST_WEIGHT, which it is where
    there are too few groups or pages to tell. Sums are of exact decimals, so reruns agree.
    """
    exact = lambda c: F.sum(c.cast("decimal(28,10)")).cast("double")
    s = groups.where("n > 0").agg(
        F.count("*").alias("g"), F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("x"),
        exact(F.col("bad") * F.col("bad") / F.col("n")).alias("xx"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"),
    )
    s = s.where("g > 1 and n > g").withColumns({"between": F.expr("(xx - x * x / n) / (g - 1)"), "within": F.expr("(x - xx) / (n - g)"), "n0": F.expr("(n - nn / n) / (g - 1)")})
    rho = F.expr("try_divide(between - within, between + (n0 - 1) * within)")
    k = s.select(F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(1.0), F.when(rho > 0.001, 1 / rho - 1).otherwise(MOST_WEIGHT))).alias("k"))
    return k.agg(F.coalesce(F.max("k"), F.lit(MOST_WEIGHT)).alias("k"))


def beta_below(bad: np.ndarray, good: np.ndarray, rate: float) -> np.ndarray:
    """P(x <= rate) of beta distributions with these parameters, by the series of the incomplete beta function.

    Its terms fall from the first where the mean is above the rate; where it isn't, 1 less that of the mirror image is taken.
    """
    flip = bad * (1 - rate) <= good * rate
    a, b, x = np.where(flip, good, bad), np.where(flip, bad, good), np.where(flip, 1 - rate, rate)
    first = np.array([math.lgamma(p + q) - math.lgamma(p + 1) - math.lgamma(q) for p, q in zip(a.tolist(), b.tolist(), strict=True)]).reshape(len(a))
    term = np.exp(first + a * np.log(x) + b * np.log1p(-x))
    total, k = term.copy(), 0
    while len(term) and (term > 1e-15 * total).any():
        term = term * (a + b + k) / (a + 1 + k) * x
        total, k = total + term, k + 1
    return np.where(flip, 1 - total, total)


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, bad_rate, bad_weight, good_weight): posterior mean and beta parameters of each host of `outcomes` (host, bad: boolean or null for unlabelled).

    A suffix's prior is the rate of all pages, a domain's its suffix's posterior, a host's its domain's; so a host
    without labels has its domain's rate. Counts are combined before each shuffle.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("bad"))
    domain = domain_of(F.col("host"))
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", F.when(F.instr("domain", ".") > 0, F.expr("substring(domain, instr(domain, '.') + 1)")).otherwise(F.col("domain")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg(F.coalesce(F.expr("try_divide(sum(bad), sum(n))"), F.lit(0.0)).alias("prior"))

    def shrunk(groups, prior, keys, out):
        """The prior is one row, or a table by the parent's key."""
        k = F.broadcast(strength(groups))  # one row
        joined = groups.crossJoin(F.broadcast(prior)) if not keys else groups.join(prior, keys)
        rate = (F.col("bad") + F.col("k") * F.col("prior")) / (F.col("n") + F.col("k"))
        return joined.crossJoin(k).withColumn(out, rate).withColumn("weight", F.col("n") + F.col("k"))

    by_suffix = shrunk(suffixes, overall, [], "rate").select("suffix", F.col("rate").alias("prior"))
    by_domain = shrunk(domains, by_suffix, ["suffix"], "rate").select("domain", F.col("rate").alias("prior"))
    by_host = shrunk(hosts, by_domain, ["domain"], "rate")
    return by_host.select("host", F.col("rate").alias("bad_rate"), (F.col("rate") * F.col("weight")).alias("bad_weight"), ((1 - F.col("rate")) * F.col("weight")).alias("good_weight"))


def surely_above(rates: DataFrame, max_bad: float, doubt: float) -> DataFrame:
    """The hosts of reputations() whose bad rate is at most max_bad with a probability below `doubt`; only those whose mean is above it are tried."""

    def run(batches):
        for b in batches:
            below = beta_below(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("bad_weight", "good_weight")), max_bad)
            yield pa.record_batch([b.column("host").filter(pa.array(below < doubt))], ["host"])

    likely = rates.where((F.col("bad_rate") > max_bad) & (F.col("good_weight") > 0)).select("host", "bad_weight", "good_weight")
    return likely.mapInArrow(run, "host string").union(rates.where((F.col("bad_rate") > max_bad) & (F.col("good_weight") <= 0)).select("host"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD, doubt: float = DOUBT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page: the longest rule's, else block if the `doubt` quantile of its host's bad rate is above max_bad.

    A label (doc_id, quality, toxic) is the outcome of the page whose id it carries: bad if its quality is 0 or it is
    toxic, unlabelled if both are null. A null url or one without :// has an empty host and path, which is a host like
    any other. Repeated rows and labels each count; null ids match no label; urls of any length are read whole; a rate of
    just max_bad is no ground to block; other columns aren't read; no labels block nothing; no pages give no rows.
    """
    url = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where("quality is not null or toxic is not null").select(F.col("doc_id").alias("of"), bad.alias("bad"))
    rates = reputations(url.join(known, F.col("page_id") == F.col("of"), "left").select("host", "bad"))
    blocked = surely_above(rates, max_bad, doubt).select(F.col("host").alias("bad_host"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = url.withColumn("best", rule).join(blocked, F.col("host") == F.col("bad_host"), "left")
    verdict = F.coalesce("best.verdict", F.when(F.col("bad_host").isNull(), "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def _prior(name: str, groups: str) -> str:
    return f"""{name} AS (
  SELECT coalesce(max(least({MOST_WEIGHT}, greatest(1.0, CASE WHEN rho > 0.001 THEN 1 / rho - 1 ELSE {MOST_WEIGHT} END))), {MOST_WEIGHT}) AS k FROM (
    SELECT (b - w) / nullif(b + (n0 - 1) * w, 0) AS rho FROM (
      SELECT (xx - x * x / n) / (g - 1) AS b, (x - xx) / (n - g) AS w, (n - nn / n) / (g - 1) AS n0 FROM (
        SELECT count(*) AS g, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS x, CAST(sum(CAST(bad * bad / n AS DECIMAL(28, 10))) AS DOUBLE) AS xx, CAST(sum(n * n) AS DOUBLE) AS nn
        FROM {groups} WHERE n > 0) WHERE g > 1 AND n > g)))"""


_RULE_ROWS = ", ".join(f"('{r}', '{v}', '{r[: r.index('/')]}', '{r[r.index('/') :]}')" for r, v in RULES)
#: The same rows in SQL.
HOSTS_SQL = f"""
WITH rules(rule, verdict, rule_host, rule_path) AS (VALUES {_RULE_ROWS}),
url AS (
  SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '{_ADDRESS}', 1), '{_UP}', '{_LOW}') AS host,
         regexp_extract(coalesce(url, ''), '{_ADDRESS}', 2) AS path FROM pages),
outcomes AS (
  SELECT u.host, l.of, l.bad FROM url u LEFT JOIN (
    SELECT doc_id AS of, coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL) l
  ON l.of = u.page_id),
parts AS (SELECT host, count(bad) AS n, count(*) FILTER (WHERE bad) AS bad, string_split(string_split(host, ':')[1], '.') AS p FROM outcomes GROUP BY host),
named AS (SELECT host, n, bad, array_to_string(p[(CASE WHEN regexp_matches(array_to_string(p[-2:], '.'), '{LONG_SUFFIX}') THEN -3 ELSE -2 END):], '.') AS domain FROM parts),
hosts AS (SELECT *, CASE WHEN instr(domain, '.') > 0 THEN substring(domain, instr(domain, '.') + 1) ELSE domain END AS suffix FROM named),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
{_prior("ks", "suffixes")}, {_prior("kd", "domains")}, {_prior("kh", "hosts")},
by_suffix AS (SELECT suffix, (bad + k * coalesce((SELECT sum(bad) / nullif(sum(n), 0) FROM suffixes), 0.0)) / (n + k) AS prior FROM suffixes, ks),
by_domain AS (SELECT d.domain, (d.bad + k * s.prior) / (d.n + k) AS prior FROM domains d JOIN by_suffix s USING (suffix), kd),
by_host AS (SELECT h.host, (h.bad + k * d.prior) / (h.n + k) AS rate, h.n + k AS weight FROM hosts h JOIN by_domain d USING (domain), kh),
shape AS (SELECT host, rate * weight AS a, (1 - rate) * weight AS b FROM by_host WHERE rate > {MAX_BAD}),
bad_hosts AS (
  SELECT host FROM shape WHERE b <= 0 OR list_sum(list_transform(range(0, 2000), lambda n: exp(lgamma(a + b + n) - lgamma(a + 1 + n) - lgamma(b) + (a + n) * ln({MAX_BAD}) + b * ln(1 - {MAX_BAD})))) < {DOUBT}),
best AS (
  SELECT u.r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM url u JOIN rules
  ON ends_with('.' || u.host, '.' || rule_host) AND starts_with(u.path, rule_path) GROUP BY u.r)
SELECT u.page_id, u.host, u.path, b.rule,
       coalesce(b.verdict, CASE WHEN h.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM url u LEFT JOIN best b USING (r) LEFT JOIN bad_hosts h ON h.host = u.host
"""
