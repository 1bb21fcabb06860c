"""URL filters: stated rules first, then empirical-Bayes reputation of hosts.

Labelled outcomes are summed per host, registered domain and suffix (grouped aggregation, one row per host at the end). Each
level's rate has a beta prior centred on its parent's posterior mean: suffix on all pages, domain on suffix, host on
domain, each with the strength of `prior` pages. A host is blocked where the lower bound of its posterior, mean less
`z` standard deviations, lies above `most_bad`; a host with few or no outcomes is judged as its
parents are.

Defined results: a null url, or one without ://, has empty host and path, fits no rule, and is judged by the empty host's
reputation; null ids are kept and have no outcome; of several labels of an id the worst counts; rows that repeat are each
judged; an empty table gives no rows; without labels every page that no rule blocks is allowed. Other columns are unread.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import stage, unstage


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Reputation(NamedTuple):
    prior: float = 20.0
    z: float = 1.645
    most_bad: float = 0.5
    #: Labels under which whole organisations register, so that a registered domain has one part more.
    second_level: tuple[str, ...] = ("co", "com", "org", "net", "gov", "edu", "ac")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for a null url or one without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of name and verdict, or null."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _domain(host: Column, second_level: tuple[str, ...]) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without its port; an address is its own domain and suffix."""
    bare = F.regexp_replace(host, r":[0-9]*\z", "")
    parts = F.split(bare, r"\.")
    n = F.size(parts)
    of_two = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.element_at(parts, F.when(n >= 2, -2).otherwise(-1)).isin(*second_level)
    length = F.when(of_two, 2).otherwise(1)
    suffix = F.array_join(F.slice(parts, F.greatest(n - length + 1, F.lit(1)), length), ".")
    domain = F.array_join(F.slice(parts, F.greatest(n - length, F.lit(1)), F.least(length + 1, n)), ".")
    address = bare.rlike(r"\A[0-9.]+\z|\A\[")
    return F.when(address, bare).otherwise(domain), F.when(address, bare).otherwise(suffix)


def host_reputation(pages: DataFrame, labels: DataFrame, p: Reputation = Reputation(), label_id: str = "doc_id", bad: str = "quality = 0 OR toxic = 1") -> DataFrame:
    """(host, n, mean, low, bad) from pages (id, host) and outcomes: low is the posterior's lower bound."""
    outcomes = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("id")).agg(F.max(F.expr(f"CAST(coalesce({bad}, false) AS int)")).alias("y"))
    of_host = pages.join(outcomes, "id", "left").groupBy("host").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("b"))
    domain, suffix = _domain(F.col("host"), p.second_level)
    hosts = stage(of_host.select("host", "n", "b", domain.alias("domain"), suffix.alias("suffix")), "url-hosts")
    total = hosts.agg(F.sum("n"), F.sum("b")).first()
    mean = ((total[1] or 0) + 1.0) / ((total[0] or 0) + 2.0)
    k = p.prior

    def posterior(b: str, n: str, centre: Column) -> Column:
        return (F.col(b) + k * centre) / (F.col(n) + k)

    suffixes = hosts.groupBy("suffix").agg(F.sum("b").alias("bs"), F.sum("n").alias("ns")).select("suffix", posterior("bs", "ns", F.lit(mean)).alias("ms"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("b").alias("bd"), F.sum("n").alias("nd")).join(suffixes, "suffix").select("domain", "suffix", posterior("bd", "nd", F.col("ms")).alias("md"))
    m = posterior("b", "n", F.col("md"))
    out = hosts.join(domains, ["domain", "suffix"]).select("host", "n", m.alias("mean"), (m - p.z * F.sqrt(m * (1 - m) / (F.col("n") + k + 1))).alias("low"))
    done = stage(out.withColumn("bad", F.col("low") > p.most_bad), "url-reputation")
    unstage(hosts)
    return done


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], p: Reputation = Reputation(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row per page: id, host, path, rule, verdict, host_low (the posterior's lower bound of its host)."""
    url = F.col(url_col)
    seen = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rep = host_reputation(seen.select("id", "host"), labels, p)
    ruled = seen.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("found.verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return ruled.join(rep.select("host", "bad", "low"), "host", "left").select("id", "host", "path", F.col("found.name").alias("rule"), verdict.alias("verdict"), F.col("low").alias("host_low"))
