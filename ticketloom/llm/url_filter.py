"""URL filter by empirical-Bayes host reputation (native: DataFrame functions only).

Labelled page outcomes (bad = 1, fine = 0) are counted by host. Beta-binomial priors shrink each level towards
the one above: suffix towards the whole table, registered domain towards its suffix, host towards its domain. The suffix is the
last label of a host, or the last two where they are one of `SUFFIXES`; the registered domain has one label more. An
IP address is its own domain and has no suffix.
The strength of each level's prior is fitted by moments from the spread of the groups. A host is blocked when the
lower posterior bound of its bad rate, mean - z * sd, exceeds `max_bad_rate`. Explicit rules overrule that.

Defined results:
- null url or no "://": host and path are empty; no rule fits and the verdict is the one of the global prior.
- unlabelled hosts, domains and suffixes take the mean of the level above.
- repeated page rows are judged alike, one output row for each input row; outcomes that are null are not counted.
- an empty table gives an empty result; without any labelled outcome nothing is blocked by reputation.
- very long urls are judged whole. Of several labels of a page the worst counts; a page that comes twice counts twice.
- extra columns are ignored unless named in `keep`; their names can't clash, as only named columns are read.

Hot hosts: the counts are partially aggregated before the shuffle; the host table joins the pages by host, where
adaptive execution broadcasts a small table by its measured size or splits skewed partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.llm._store import materialise

#: Fixed values: (host, path prefix, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Suffixes of two labels under which names are registered.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my",
    "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "go.jp", "gob.mx", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk",
    "gv.at", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "nhs.uk", "or.at", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za",
)


@dataclass(frozen=True)
class ReputationConfig:
    max_bad_rate: float = 0.5
    z: float = 1.6449
    #: Bounds of the fitted prior strengths, in pseudo-outcomes.
    min_strength: float = 2.0
    max_strength: float = 10000.0
    rules: tuple = RULES


def url_host(url: Column) -> Column:
    """After the first "://" up to /, ?, # or end, A-Z lower-cased; empty if there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """Without user and port, for the reputation levels; rules look at the host as it stands."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":\d*$", "")


def site_of(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a bare host."""
    ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | host.contains(":")
    two = F.substring_index(host, ".", -2).isin(*SUFFIXES)
    domain = F.when(ip, host).when(two, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    suffix = F.when(ip, F.lit("")).when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    return domain, suffix


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for name, prefix, what in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, name + prefix) if rule is None else rule.when(fits, name + prefix)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _strength(groups: DataFrame, mean: str, cfg: ReputationConfig) -> DataFrame:
    """One row: prior strength by moments. Spread of group rates around `mean`, less what sampling alone gives.

    With rate p = bad / n around m, E[n (p - m)^2] = m (1 - m) (1 + (n - 1) rho), rho = 1 / (strength + 1).
    """
    d = F.col("bad") / F.col("n") - F.col(mean)
    v = F.col(mean) * (1 - F.col(mean))
    rho = F.try_divide(F.sum(F.col("n") * d * d) - F.sum(v), F.sum((F.col("n") - 1) * v))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1 / (cfg.max_strength + 1))), F.lit(1 / (cfg.min_strength + 1)))
    return groups.where("n > 0").agg((1 / rho - 1).alias("s"))


def host_reputation(outcomes: DataFrame, cfg: ReputationConfig = ReputationConfig()) -> dict[str, DataFrame]:
    """outcomes (host, bad 0/1) to posterior tables by level: {"host", "domain", "suffix", "all"}.

    The tables hold alpha and beta of the posterior for each labelled host, domain and suffix; "all" has one row.
    """
    # A level's counts hold those of the levels below: a host's outcomes speak for it and, through the means, for its domain.
    base = outcomes.where("bad is not null").select(F.coalesce(bare_host(F.col("host")), F.lit("")).alias("host"), F.col("bad").cast("double").alias("bad"))
    hosts = base.groupBy("host").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).cast("double").alias("n"))
    domain, suffix = site_of(F.col("host"))
    hosts = materialise(hosts, "hosts").select("*", domain.alias("domain"), suffix.alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    top = suffixes.agg(F.sum("bad").alias("b"), F.sum("n").alias("m")).first()  # one row
    b, m = (top["b"] or 0.0), (top["m"] or 0.0)
    mean = (b + 0.5) / (m + 1.0)  # Jeffreys prior for the whole table

    def level(groups: DataFrame, above: Column) -> DataFrame:
        with_mean = groups.withColumn("above", above)
        s = _strength(with_mean, "above", cfg).first()["s"]  # one row
        s = cfg.max_strength if s is None else s
        a = F.col("above") * s + F.col("bad")
        z = (1 - F.col("above")) * s + F.col("n") - F.col("bad")
        return with_mean.withColumns({"alpha": a, "beta": z, "mean": a / (a + z)})

    suffix = level(suffixes, F.lit(mean))
    domain = level(domains.join(suffix.select("suffix", F.col("mean").alias("up")), "suffix"), F.col("up")).drop("up")
    host = level(hosts.join(domain.select("domain", F.col("mean").alias("up")), "domain"), F.col("up")).drop("up")
    spark = outcomes.sparkSession
    whole = spark.createDataFrame([(b + 0.5, m - b + 0.5, mean)], "alpha double, beta double, mean double")
    return {"host": host, "domain": domain, "suffix": suffix, "all": whole}


def judge_urls(pages: DataFrame, outcomes: DataFrame, cfg: ReputationConfig = ReputationConfig(), url_col: str = "url", keep: tuple = ()) -> DataFrame:
    """Each row of pages with host, path, rule, verdict, bad_rate (posterior mean), bound and level."""
    levels = host_reputation(outcomes, cfg)
    b = levels["all"].first()
    host = url_host(F.col(url_col))
    x = pages.select(*keep, host.alias("host"), url_path(F.col(url_col)).alias("path"))
    x = x.withColumn("_h", bare_host(F.col("host")))
    domain, suffix = site_of(F.col("_h"))
    x = x.withColumns({"_d": domain, "_s": suffix})
    for key, name in (("_h", "host"), ("_d", "domain"), ("_s", "suffix")):
        side = levels[name].select(F.col(name).alias(key), F.struct("alpha", "beta").alias(f"_{name}"))
        x = x.join(side, key, "left")
    got = F.coalesce("_host", "_domain", "_suffix", F.struct(F.lit(b["alpha"]).alias("alpha"), F.lit(b["beta"]).alias("beta")))
    x = x.withColumn("_p", got)
    a, z = F.col("_p.alpha"), F.col("_p.beta")
    rate = a / (a + z)
    bound = rate - cfg.z * F.sqrt(rate * (1 - rate) / (a + z + 1))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), cfg.rules)
    level = F.when(F.col("_host").isNotNull(), "host").when(F.col("_domain").isNotNull(), "domain").when(F.col("_suffix").isNotNull(), "suffix").otherwise("all")
    return x.select(
        *keep, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(bound > cfg.max_bad_rate, "block").otherwise("allow")).alias("verdict"),
        rate.alias("bad_rate"), bound.alias("bound"), level.alias("level"),
    )


def filter_urls(pages: DataFrame, outcomes: DataFrame, cfg: ReputationConfig = ReputationConfig(), url_col: str = "url") -> DataFrame:
    """The allowed rows of pages, with pages' own columns."""
    kept = judge_urls(pages.select(F.struct("*").alias("_row"), F.col(url_col).alias("_url")), outcomes, cfg, "_url", ("_row",))
    return kept.where("verdict = 'allow'").select("_row.*")
