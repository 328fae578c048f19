"""URL filters: explicit rules first, empirical-Bayes host reputation for the rest. DataFrame functions only.

Labelled page outcomes (bad or not) are counted per host. A host's bad rate has a beta prior whose
mean is its registered domain's shrunken rate, which in turn is shrunk towards its public suffix and
that towards the overall rate; the strength of each level is estimated from the spread between its
children (method of moments for the beta-binomial). A host is blocked when the lower bound of its
posterior bad rate, ``z`` standard deviations below the mean, is above ``block_above``. Hosts without
outcomes get their domain's prior. Public suffixes are rules with wildcards and exceptions; the default
knows a part of the public list only, so under a suffix that it lacks unrelated hosts share a domain:
give the whole list (``read_suffixes``) for real crawls.

Defined results: a null url or one without ``://`` has an empty host and path and is judged like any
host; port and user name count as part of the host for rules but not for reputation; among rules of
equal length the first by code point wins; pages with a null id have no outcome; repeated labels of
a page count once, bad if any is; an empty table gives an empty result; without any outcome the
prior is one half and nothing is blocked; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

# ---- fixed values: public suffixes of several labels that this filter knows by default, a part of the public list;
# give the whole list with ``read_suffixes`` ----
PUBLIC_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp",
    "co.kr", "or.kr", "co.nz", "org.nz", "com.br", "gov.br", "org.br", "net.br", "com.cn", "gov.cn", "org.cn", "com.mx", "com.tr", "com.tw",
    "co.in", "gov.in", "co.za", "org.za", "com.sg", "edu.sg", "gov.sg", "co.il", "org.il", "ac.il", "com.ar", "com.co", "com.hk", "com.my",
    "com.ph", "com.pl", "com.ua", "com.vn", "com.eg", "com.sa", "co.id", "co.th", "in.th", "com.pk", "com.ng", "co.ke", "com.pe", "com.ve",
    "github.io", "gitlab.io", "blogspot.com", "appspot.com", "herokuapp.com", "netlify.app", "vercel.app", "pages.dev", "web.app",
    "azurewebsites.net", "cloudfront.net", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp")
# ---- end of fixed values ----

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class ReputationSettings:
    z: float = 1.645
    block_above: float = 0.5
    max_strength: float = 10_000.0
    suffixes: tuple[str, ...] = PUBLIC_SUFFIXES


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) between the first ``://`` and ``/``, ``?``, ``#`` or end; path up to ``?``, ``#`` or end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """(rule name, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):  # the last one set is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def read_suffixes(spark, path: str) -> tuple[str, ...]:
    """Rules of several labels from a file in the public suffix list's format (a rule to a line, ``//`` comments,
    ``*.`` wildcards, ``!`` exceptions). The list has about ten thousand rules; one label needs no rule."""
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1))
    rows = spark.read.text(path).select(rule.alias("rule")).filter("rule LIKE '%.%' AND rule NOT LIKE '//%'").distinct().collect()
    return tuple(sorted(r["rule"] for r in rows))


def suffix_labels(name: Column, suffixes: tuple[str, ...]) -> Column:
    """How many labels of ``name`` are its public suffix: the longest rule that fits, an exception taking its first
    label off a wildcard; one label if no rule fits."""
    labels = F.lit(1)
    for n in range(2, max((s.count(".") + 1 for s in suffixes), default=1) + 1):
        last, rest = F.substring_index(name, ".", -n), F.substring_index(name, ".", -(n - 1))
        plain = [s for s in suffixes if s[0] not in "*!" and s.count(".") == n - 1]
        wild = [s[2:] for s in suffixes if s.startswith("*.") and s.count(".") == n - 1]
        if plain or wild:  # a wildcard stands for a label that is there
            labels = F.when(last.isin(*plain) | (rest.isin(*wild) & (last != rest)), n).otherwise(labels)
    for s in suffixes:
        if s[0] == "!":
            labels = F.when(F.concat(F.lit("."), name).endswith("." + s[1:]), s.count(".")).otherwise(labels)
    return labels


def domain_and_suffix(host: Column, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host without user name and port; an address is its own domain,
    and so is a host that is a public suffix."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    address = name.rlike(r"^[0-9.]+$") | name.startswith("[")
    n = suffix_labels(name, suffixes)
    suffix = F.when(address, "address").otherwise(F.call_function("substring_index", name, F.lit("."), -n))
    domain = F.when(address, name).otherwise(F.call_function("substring_index", name, F.lit("."), -(n + 1)))
    return domain, suffix


def _strength(children: DataFrame, parent: str, s: ReputationSettings) -> float:
    """Prior strength of one level: how many outcomes a parent's mean counts for, from the spread of its
    children's rates beyond what binomial noise explains (pooled over parents)."""
    seen = children.filter("n > 0")
    parents = seen.groupBy(parent).agg(
        F.sum("n").alias("total"), (F.sum("k") / F.sum("n")).alias("mean"), F.count("*").alias("parts"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    noise = F.col("mean") * (1 - F.col("mean"))
    r = parents.agg(
        F.sum(F.col("kk") - F.col("total") * F.col("mean") * F.col("mean") - (F.col("parts") - 1) * noise).alias("between"),
        F.sum(F.col("total") - F.col("nn") / F.col("total")).alias("weight"),
        F.sum(F.col("total") * noise).alias("noise"), F.sum("total").alias("total")).first()
    if not r["total"] or not r["weight"] or r["between"] <= 0:
        return s.max_strength
    variance = r["between"] / r["weight"]
    return min(s.max_strength, max(1.0, r["noise"] / r["total"] / variance - 1))


def host_reputations(outcomes: DataFrame, s: ReputationSettings = ReputationSettings()) -> DataFrame:
    """(host, bad_rate, bad_bound) for each host of ``outcomes`` (host, bad: boolean, null if unlabelled)."""
    domain, suffix = domain_and_suffix(F.col("host"), s.suffixes)
    counted = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"),
                                           F.sum(F.col("bad").cast("double")).alias("k"))
    hosts = stored(counted.select("host", domain.alias("domain"), suffix.alias("suffix"), "n",
                                  F.coalesce("k", F.lit(0.0)).alias("k")), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = ((total["k"] or 0.0) + 0.5) / ((total["n"] or 0.0) + 1.0)
    a = _strength(suffixes.withColumn("all", F.lit(1)), "all", s)
    b, c = _strength(domains, "suffix", s), _strength(hosts, "domain", s)
    suffix_rate = suffixes.select("suffix", ((F.col("k") + a * overall) / (F.col("n") + a)).alias("suffix_rate"))
    domain_rate = domains.join(suffix_rate, "suffix").select(
        "domain", ((F.col("k") + b * F.col("suffix_rate")) / (F.col("n") + b)).alias("domain_rate"))
    good_bad = hosts.join(domain_rate, "domain").select(
        "host", (F.col("k") + c * F.col("domain_rate")).alias("x"),
        (F.col("n") - F.col("k") + c * (1 - F.col("domain_rate"))).alias("y"))
    size = F.col("x") + F.col("y")
    mean = F.col("x") / size
    return good_bad.select("host", mean.alias("bad_rate"),
                           (mean - s.z * F.sqrt(mean * (1 - mean) / (size + 1))).alias("bad_bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[UrlRule],
               settings: ReputationSettings = ReputationSettings(), page_id: str = "page_id", url: str = "url",
               label_id: str = "doc_id", bad: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and the host's posterior (bad_rate, bad_bound).

    ``bad`` tells from a row of ``labels`` whether the page with that id turned out bad (default:
    quality 0 or toxic 1). The reputations are written once, so the final join meets two plain
    shuffles and a host with a third of all pages can be split at run time.
    """
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1) if bad is None else bad
    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    outcomes = labels.select(F.col(label_id).alias("page_id"), bad.alias("bad")).groupBy("page_id").agg(
        F.max("bad").alias("bad"))
    reputations = stored(host_reputations(
        rows.select("page_id", "host").join(outcomes, "page_id", "left"), settings), "reputations")
    name, verdict = match_rules(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bad_bound") > settings.block_above, "block").otherwise("allow")
    return rows.join(reputations, "host", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "bad_rate", "bad_bound")
