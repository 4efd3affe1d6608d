"""URL filter: fixed rules first, then an empirical-Bayes reputation of hosts.

The labelled pages of a host give a count and a number of bad outcomes. The rate of bad outcomes is shrunk
through beta-binomial priors, from the host to its registered domain, from that to its public
suffix, and from that to the whole. The strength of the prior of each level is estimated from
the data by moments: with a parent's mean m, n outcomes and rate p, the expectation of n (p - m)^2 is m (1 - m) (1 + (n - 1) rho), and
the prior is worth 1 / rho - 1 outcomes. A host is blocked if the lower bound of its posterior
(the mean less Z standard deviations) is above a limit that follows from the labelled outcomes: the odds of the whole rate times EXCESS.
Hosts without outcomes get the posterior of their domain as prior and so are allowed unless that is bad beyond doubt.

Hosts are grouped by name, without a port or user. An IP address is a domain of its own, and all
of them have one suffix. Public suffixes come from a table; without one, a rule stands for it: the last label, or the last two if
these are a usual second level under a country's two letters.

Built-in expressions only; outcomes are counted per host before anything else is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.llm.common import ascii_lower, materialise, small, table

#: (verdict, host, path start)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
# Usual second levels of country domains.
SECOND_LEVELS = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "mil", "ne", "net", "nom", "or", "org", "sch")
ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"
#: The suffix of all addresses.
NO_SUFFIX = "address"
#: Deviations below the mean of the bound; the limit's odds over those of the whole rate.
Z, EXCESS = 1.645, 1.5
LEAST_RHO, MOST_RHO = 0.001, 0.9


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """A host without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")


def suffix_of(name: Column) -> Column:
    """By rule: an address has NO_SUFFIX, a usual second level of a country two labels, any other name one."""
    two = F.substring_index(name, ".", -2)
    second = two.rlike(rf"^({'|'.join(SECOND_LEVELS)})\.[a-z][a-z]$")
    return F.when(name.rlike(ADDRESS), NO_SUFFIX).when(second, two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column, suffix: Column) -> Column:
    """The suffix and the label before it; an address or a bare suffix is its own domain."""
    labels, size = F.split(name, r"\."), F.size(F.split(suffix, r"\."))
    count = F.least(size + 1, F.size(labels))
    return F.when(suffix == NO_SUFFIX, name).otherwise(F.array_join(F.slice(labels, F.size(labels) - count + 1, count), "."))


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """(suffix) from a public suffix list in its usual text form: a rule a line, `//` before comments, `*.` for any label and `!`
    for exceptions, which are kept as they stand."""
    lines = spark.read.text(path).select(ascii_lower(F.regexp_extract("value", r"^\s*(\S*)", 1)).alias("suffix"))
    return lines.where((F.col("suffix") != "") & ~F.col("suffix").startswith("//")).distinct()


def with_suffix(hosts: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """Add name, suffix and domain to rows with a host, each host being one row. With a table, the longest of its
    suffixes that ends the name counts, an exception less its first label before all others, and the last label where none does."""
    named = hosts.withColumn("name", name_of(F.col("host")))
    if suffixes is None:
        return named.withColumn("suffix", suffix_of(F.col("name"))).withColumn("domain", domain_of(F.col("name"), F.col("suffix")))
    rules = materialise(suffixes.where(F.col("suffix").isNotNull()).select(F.col("suffix").alias("rule")).distinct())
    labels = F.split("name", r"\.")
    tails = named.where(~F.col("name").rlike(ADDRESS)).select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.slice(labels, i, F.size(labels)))).alias("tail"))
    tail, any_ = F.array_join("tail", "."), F.array_join(F.concat(F.array(F.lit("*")), F.slice("tail", 2, F.size("tail"))), ".")
    keys = F.array(F.struct(tail.alias("rule"), F.lit(0).alias("rank"), tail.alias("found")), F.struct(any_.alias("rule"), F.lit(0).alias("rank"), tail.alias("found")),
                   F.struct(F.concat(F.lit("!"), tail).alias("rule"), F.lit(1).alias("rank"), F.array_join(F.slice("tail", 2, F.size("tail")), ".").alias("found")))
    hits = tails.select("host", F.explode(keys).alias("k")).select("host", "k.*").join(small(rules), "rule")
    best = hits.groupBy("host").agg(F.max_by("found", F.struct("rank", F.length("found"))).alias("found"))
    suffix = F.when(F.col("name").rlike(ADDRESS), NO_SUFFIX).otherwise(F.coalesce("found", F.substring_index("name", ".", -1)))
    return named.join(best, "host", "left").withColumn("suffix", suffix).drop("found").withColumn("domain", domain_of(F.col("name"), F.col("suffix")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, f"{name}{start}").otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _shrunk(children: DataFrame, parent: str) -> DataFrame:
    """Add rho, a and b (posterior) to rows with n, bad and the parent's mean."""
    m, n, p = F.col(parent), F.col("n"), F.col("bad") / F.col("n")
    spread = children.where(n > 0).agg((F.sum(n * (p - m) * (p - m)) - F.sum(m * (1 - m))).alias("x"), F.sum((n - 1) * m * (1 - m)).alias("y"))
    rho = F.least(F.greatest(F.coalesce(F.when(F.col("y") > 0, F.col("x") / F.col("y")), F.lit(0.0)), F.lit(LEAST_RHO)), F.lit(MOST_RHO))
    strength = spread.select((1 / rho - 1).alias("strength"))
    return children.join(F.broadcast(strength)).withColumn("a", F.col("strength") * m + F.col("bad")).withColumn("b", F.col("strength") * (1 - m) + n - F.col("bad"))


def whole_rate(outcomes: DataFrame) -> Column:
    """The rate of all outcomes, with one of each kind added."""
    return (F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)


def reputations(outcomes: DataFrame, suffixes: DataFrame | None = None, excess: float = EXCESS) -> DataFrame:
    """(host, n, bad, mean, bound, limit) of hosts, from one row (host, n, bad) for each of them; `suffixes` has a column `suffix`, see `read_suffixes`."""
    hosts = materialise(with_suffix(outcomes, suffixes))
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    total = outcomes.agg(whole_rate(outcomes).alias("whole"))
    tops = materialise(hosts.groupBy("suffix").agg(*counts).join(F.broadcast(total)))
    tops = _shrunk(tops, "whole").select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("suffix_mean"))
    domains = materialise(hosts.groupBy("suffix", "domain").agg(*counts).join(small(materialise(tops)), "suffix"))
    domains = _shrunk(domains, "suffix_mean").select("domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("domain_mean"))
    found = _shrunk(materialise(hosts.join(small(materialise(domains)), "domain")), "domain_mean")
    a, b = F.col("a"), F.col("b")
    mean, odds = a / (a + b), excess * F.col("whole") / (1 - F.col("whole"))
    return found.join(F.broadcast(total)).select("host", "n", "bad", mean.alias("mean"), (mean - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bound"), (odds / (1 + odds)).alias("limit"))


def judge(pages: DataFrame, outcomes: DataFrame, key: str, url: str, rules=RULES, excess: float = EXCESS, suffixes: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, bound, limit) of every page.

    `outcomes` has (page, bad) with the page's key and 0 or 1; pages without a row there, or with a null, have
    no outcome, and of several rows for a page the worst counts. A null URL or one without :// has an
    empty host and path and is judged as a host of that name. Repeated pages count each time, pages with a null key have no
    outcome. Rules see a host with its port and user, reputations don't. `bound` is the lower bound of the host's rate of bad outcomes, and hosts above `limit` are
    blocked if no rule fits. Other columns aren't read.
    """
    rows = pages.select(F.col(key).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    worst = outcomes.where(F.col("bad").isNotNull()).groupBy("page").agg(F.max("bad").alias("bad"))
    labelled = rows.select("page", "host").join(worst, "page", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = materialise(reputations(materialise(labelled), suffixes, excess).select("host", "bound", "limit"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > F.col("limit"), "block").otherwise("allow")
    return rows.join(small(known), "host", "left").select(F.col("page").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound", "limit")


def query(spark, sf_dir: str) -> DataFrame:
    """Every page; the number in its path is the document that it was made from, whose labels are its outcome:
    bad if of low quality or toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    document = F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS bigint)")
    outcome = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).cast("long")
    made = pages.select("page_id", document.alias("doc_id")).where(F.col("doc_id").isNotNull())
    outcomes = made.join(labels.select("doc_id", outcome.alias("bad")), "doc_id").select(F.col("page_id").alias("page"), "bad")
    return judge(pages, outcomes, "page_id", "url")


_SHRUNK = """
{name}_rho AS (
  SELECT least(greatest(coalesce(CASE WHEN sum((n - 1) * m * (1 - m)) FILTER (n > 0) > 0 THEN
    (sum(n * (bad / n - m) * (bad / n - m)) FILTER (n > 0) - sum(m * (1 - m)) FILTER (n > 0)) / sum((n - 1) * m * (1 - m)) FILTER (n > 0) END, 0.0), {least}), {most}) AS rho
  FROM {name}
), {name}_post AS (
  SELECT *, (1 / rho - 1) * m + bad AS a, (1 / rho - 1) * (1 - m) + n - bad AS b FROM {name}, {name}_rho
)"""


def _step(name: str) -> str:
    return _SHRUNK.format(name=name, least=LEAST_RHO, most=MOST_RHO).strip()


SQL = rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT) AS doc_id
  FROM pages
), o AS (
  SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad
  FROM p JOIN labels USING (doc_id) GROUP BY page_id
), h AS (
  SELECT host, CAST(count(o.bad) AS DOUBLE) AS n, CAST(coalesce(sum(o.bad), 0) AS DOUBLE) AS bad,
    regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '') AS name
  FROM p LEFT JOIN o USING (page_id) GROUP BY host
), k AS (
  SELECT host, n, bad, CASE WHEN address THEN '{NO_SUFFIX}' ELSE array_to_string(l[-(1 + two):], '.') END AS suffix,
    CASE WHEN address THEN name ELSE array_to_string(l[-(2 + two):], '.') END AS domain
  FROM (SELECT *, string_split(name, '.') AS l, regexp_matches(name, '{ADDRESS}') AS address,
    CASE WHEN regexp_matches(array_to_string(string_split(name, '.')[-2:], '.'), '^({"|".join(SECOND_LEVELS)})\.[a-z][a-z]$') THEN 1 ELSE 0 END AS two FROM h)
), c AS (
  SELECT {EXCESS}::DOUBLE * whole / (1 - whole) AS odds FROM (SELECT (sum(bad) + 1) / (sum(n) + 2) AS whole FROM k)
), s AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM k) AS m FROM k GROUP BY suffix
), {_step("s")}, d AS (
  SELECT k.domain, sum(k.n) AS n, sum(k.bad) AS bad, any_value(a / (a + b)) AS m FROM k JOIN s_post USING (suffix) GROUP BY k.suffix, k.domain
), {_step("d")}, e AS (
  SELECT host, k.n AS n, k.bad AS bad, a / (a + b) AS m FROM k JOIN d_post USING (domain)
), {_step("e")}, v AS (
  SELECT host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM e_post
), r AS (
  SELECT * FROM (VALUES {", ".join(f"('{kind}', '{host}', '{path}')" for kind, host, path in RULES)}) AS t(kind, rule_host, rule_path)
), f AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(kind, length(rule_host || rule_path)) AS kind
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.kind, CASE WHEN bound > odds / (1 + odds) THEN 'block' ELSE 'allow' END) AS verdict,
  bound, odds / (1 + odds) AS "limit"
FROM p LEFT JOIN v USING (host) LEFT JOIN f USING (page_id) CROSS JOIN c
"""
