"""URL filter: rules for hosts and paths, and an empirical-Bayes reputation for the rest.

Host and path of a url: the host stands between the first ``://`` and the next ``/``, ``?``
or ``#``, with A-Z in lower case; the path goes on from there to ``?`` or ``#``. A url that
is null or has no ``://`` has an empty host and an empty path.

A page may have a labelled outcome (``bad``). The rate of bad pages of a host is a beta
variable whose prior comes from the registered domain, that of the domain from the public
suffix, that of the suffix from all pages:

* the mean of a prior is the posterior mean one level up, without the outcomes of the child
  itself, so that nothing counts twice;
* the strength of a prior (its number of imagined pages) follows from the spread of the
  children of that level around their means, by the moments of the beta-binomial.

A host is blocked if its rate lies above ``LIMIT`` with a probability of ``CERTAIN`` or more,
that is, if the lower bound of its posterior does. The probability is summed over a grid on
the logit scale that is centred and scaled to each posterior.

Only DataFrame functions are used. Outcomes are counted by host before anything else, three
rows of sums pass through the driver, and pages meet the table of hosts once; a host with a
third of all pages is one row of that table, and Spark splits its side of the join.

Every row of the input gives a row, also for null and repeated ids. Hosts without labelled
pages get the prior of their domain. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pokerlake.llm.common import stored

LIMIT = 0.5
CERTAIN = 0.95
#: Bounds of the correlation of two pages of a host: a prior counts for 2 to 1,000 pages.
SPREAD = (1 / 1001, 1 / 3)
#: The grid reaches ``REACH`` standard deviations to both sides, in steps of 1 / ``FINE``.
REACH, FINE = 20, 20
#: Suffixes of several labels below which names are registered; any other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "com.cn")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    rest = _rest(url)
    after = F.substr(rest, F.length(F.regexp_extract(rest, "^[^/?#]*", 0)) + 1)
    return F.regexp_extract(after, "^[^?#]*", 0)


def with_domain(hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Add ``domain`` (registered domain) and ``suffix``; user names and ports do not count, an IPv4 address is its own domain."""
    name = F.regexp_replace("host", "^.*@|:[0-9]*$", "")
    df = hosts.withColumn("_name", name)
    longest_first = sorted(suffixes, key=lambda s: (-s.count("."), s))
    known = [F.when((F.col("_name") == s) | F.col("_name").endswith(f".{s}"), s) for s in longest_first]
    suffix = F.when(F.col("_name").rlike("^[0-9.]+$"), "").otherwise(F.coalesce(*known, F.substring_index("_name", ".", -1)))
    above = F.substring_index(F.substr("_name", F.lit(1), F.length("_name") - F.length("suffix") - 1), ".", -1)
    domain = F.when((F.col("suffix") == "") | (F.col("suffix") == F.col("_name")), F.col("_name")).otherwise(F.concat(above, F.lit("."), "suffix"))
    return df.withColumn("suffix", suffix).withColumn("domain", domain).drop("_name")


def _strength(children: DataFrame, n: str, k: str, mean: str) -> float:
    """Imagined pages of the prior of these children, from their spread around ``mean``."""
    binomial = F.col(n) * F.col(mean) * (1 - F.col(mean))
    sums = children.agg(F.sum(F.pow(F.col(k) - F.col(n) * F.col(mean), F.lit(2.0))), F.sum(binomial), F.sum((F.col(n) - 1) * binomial))
    squares, expected, more = sums.first()
    spread = (squares - expected) / more if more else SPREAD[1]
    return 1 / min(max(spread, SPREAD[0]), SPREAD[1]) - 1


def above_limit(a: Column, b: Column, limit: float = LIMIT) -> Column:
    """Probability that a beta variable with parameters ``a`` and ``b`` exceeds ``limit``."""
    centre = F.ln(a / b)
    # About the standard deviation of the logit, for small parameters too.
    scale = F.sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b))

    def log_density(u: Column) -> Column:
        return a * u - (a + b) * (F.greatest(u, F.lit(0.0)) + F.ln(1 + F.exp(-F.abs(u))))

    def cell(i: Column) -> Column:
        u = centre + scale * i / FINE
        density = F.exp(log_density(u) - log_density(centre))
        # The share of the cell that lies above the limit.
        share = (u - F.ln(F.lit(limit / (1 - limit)))) / (scale / FINE) + 0.5
        return F.struct((density * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).alias("above"), density.alias("all"))

    cells = F.transform(F.sequence(F.lit(-REACH * FINE), F.lit(REACH * FINE)), cell)
    zero = F.struct(F.lit(0.0).alias("above"), F.lit(0.0).alias("all"))
    add = lambda total, x: F.struct((total["above"] + x["above"]).alias("above"), (total["all"] + x["all"]).alias("all"))
    return F.aggregate(cells, zero, add, lambda t: t["above"] / t["all"])


def reputations(labelled: DataFrame, limit: float = LIMIT, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """A row per host of ``labelled`` (host, bad; ``bad`` null without a label).

    host, domain, suffix, n (labelled pages), k (bad ones), prior_mean, a, b (posterior) and
    p_bad, the probability that the rate of bad pages exceeds ``limit``.
    """
    bad = F.col("bad").cast("boolean").cast("int")
    counted = labelled.groupBy("host").agg(F.count(bad).alias("n"), F.coalesce(F.sum(bad), F.lit(0)).alias("k"))
    hosts = stored(with_domain(counted, suffixes), "hosts")
    total_n, total_k = hosts.agg(F.sum("n"), F.sum("k")).first()
    overall = ((total_k or 0) + 0.5) / ((total_n or 0) + 1)
    by_suffix = hosts.groupBy("suffix").agg(F.sum("n").alias("n_s"), F.sum("k").alias("k_s"))
    strong = _strength(by_suffix.withColumn("mean", F.lit(overall)), "n_s", "k_s", "mean")

    def below(n: str, k: str, n_child: str, k_child: str, strength: float, mean: Column) -> Column:
        return (F.col(k) - F.col(k_child) + strength * mean) / (F.col(n) - F.col(n_child) + strength)

    by_domain = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n_d"), F.sum("k").alias("k_d")).join(by_suffix, "suffix")
    by_domain = stored(by_domain.withColumn("mean_d", below("n_s", "k_s", "n_d", "k_d", strong, F.lit(overall))).drop("n_s", "k_s"), "domains")
    strong = _strength(by_domain, "n_d", "k_d", "mean_d")
    priors = hosts.join(by_domain, ["suffix", "domain"]).withColumn("prior_mean", below("n_d", "k_d", "n", "k", strong, F.col("mean_d")))
    priors = stored(priors.select("host", "domain", "suffix", "n", "k", "prior_mean"), "priors")
    strong = _strength(priors, "n", "k", "prior_mean")
    a, b = F.col("prior_mean") * strong + F.col("k"), (1 - F.col("prior_mean")) * strong + F.col("n") - F.col("k")
    return priors.withColumns({"a": a, "b": b}).withColumn("p_bad", above_limit(F.col("a"), F.col("b"), limit))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (``allow`` or ``block``, host and path in one) as rows: host, path, rule, action."""
    rows = []
    for action, rule in rules:
        if action not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks: {action!r}")
        host, slash, path = rule.partition("/")
        rows.append((host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), slash + path, rule, action))
    return spark.createDataFrame(rows, "host string, path string, rule string, action string")


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and ``rules``, those of the host and of the names it stands below, the one to try first in front.

    Longer rules come first, of equally long ones that with the longer host, then a block.
    """
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0  # labels of the longest rule
    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, max(most, 1))
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.reverse(F.slice(labels, F.lit(1), i)), "."))
    name = hosts.select("host", F.explode(names).alias("_name"))
    own = rules.select(F.col("host").alias("_name"), "path", "rule", "action")
    rank = F.struct(-F.length("rule"), -F.length("_name"), F.col("action") == "allow", "path", "rule", "action")
    fits = name.join(own, "_name").groupBy("host").agg(F.sort_array(F.collect_set(rank)).alias("rules"))
    return fits.select("host", F.transform("rules", lambda r: F.struct(r["path"].alias("path"), r["rule"].alias("rule"), r["action"].alias("action"))).alias("rules"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], limit: float = LIMIT, certain: float = CERTAIN) -> DataFrame:
    """``pages`` (page_id, url, bad) with host, path, rule, verdict, n_labelled and p_bad."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "bad")
    known = reputations(rows.select("host", "bad"), limit)
    hosts = known.select("host", "n", "p_bad")
    judged = stored(hosts.join(rules_of_hosts(hosts, rule_table(pages.sparkSession, rules)), "host", "left"), "reputations")
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    found = rows.drop("bad").join(judged, "host").withColumn("_rule", first)
    verdict = F.coalesce(F.col("_rule.action"), F.when(F.col("p_bad") >= certain, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.col("n").alias("n_labelled"), F.round("p_bad", 6).alias("p_bad"))


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``pages`` (page_id, url) with ``bad``: the document whose number ends the path is toxic or of low quality."""
    number = F.regexp_extract(path_of(F.col("url")), "^/[^/]+/([0-9]{1,18})", 1).try_cast("bigint")
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_number")).agg(F.max(bad).alias("bad"))
    return pages.select("page_id", "url", number.alias("_number")).join(known, "_number", "left").drop("_number")
