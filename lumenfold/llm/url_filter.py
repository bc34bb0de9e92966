"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host. DataFrame functions only.

Every page has an outcome, bad (1) or good (0), or none (null). The bad rate of a host is a beta-binomial posterior:
its own outcomes, shrunk towards the rate of its registered domain, which is shrunk towards its suffix's rate, and that
towards the rate of all pages. How strongly each level shrinks (its prior's weight, in pages) is estimated from the
data by the method of moments. A host is blocked if the lower bound of its posterior bad rate, a quantile of the beta
distribution, reaches `bad_rate`, so that a few bad pages on a small host don't suffice.

Nulls and odd rows: a null url, or one without "://", has an empty host and path, fits no rule, and counts as the host
"" whose domain and suffix are "" too. A page without an outcome (null html) is judged, but teaches nothing. With no
outcome at all, nothing is blocked by the method. Page ids may repeat or be null; each input row gives one output row,
and repeated rows count as pages of their own. Of rules that fit equally long, the last by host and path wins. A very
long page is read once by patterns that go over no sign twice: an unclosed script or comment hides the rest of the page.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, written

#: A table of hosts, domains or suffixes is broadcast up to so many rows (under 100 bytes each), else merge-joined.
BROADCAST_ROWS = 200_000
#: What is assumed before any page is seen: so many bad among so many. It matters while outcomes are few.
BASE = (2, 20)
#: Second-level labels under which names are registered in two-letter country domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain (the last two labels, or three below a country's second level) and what follows its first
    label. A host of one label, or of digits, is its own domain and suffix."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    country = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.when(n >= 2, -2).otherwise(-1)).isin(*SECOND_LEVEL)
    take = F.when(country, 3).otherwise(2)
    single = (n < 2) | host.rlike(r"^[0-9.]*(:[0-9]+)?$")
    domain = F.when(single, host).otherwise(F.array_join(F.slice(labels, n - take + 1, take), "."))
    suffix = F.when(single, host).otherwise(F.array_join(F.slice(labels, n - take + 2, take - 1), "."))
    return domain, suffix


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. rules: (verdict, host, path); some hundreds at most,
    since they become one expression."""
    text = verdict = F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


#: What a page doesn't show: scripts, styles, comments, tags, entities. None of these goes back over what it has read.
HIDDEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)|<[^>]*(?:>|\z)|&(?:[a-z]+|#[0-9]+);"
# Words of an address under which such trades advertise.
TRADES = ("casino", "poker", "bets", "betting", "lottery", "pills", "viagra", "pharma", "xxx", "porn", "escort", "payday", "replica")


def page_outcome(html: Column, url: Column, symbols: float = 0.03, capitals: float = 0.5) -> Column:
    """1 if the page is bad: its host bears a word of TRADES, or its visible text is junk (many of the signs %*#$&!|,
    mostly capitals, or nothing at all); else 0. Null for a null page."""
    count = lambda text, pattern: F.length(F.regexp_replace(text, pattern, ""))
    size = lambda text: count(text, r"\s+")
    junk = let(F.regexp_replace(html, HIDDEN, " "), lambda t: let(size(t), lambda n: (n == 0) | (count(t, r"[^%*#$&!|]+") > symbols * n) | (count(t, "[^A-Z]+") > capitals * n)))
    trade = F.coalesce(host_and_path(url)[0].rlike(rf"(^|[^a-z])({'|'.join(TRADES)})([^a-z]|$)"), F.lit(False))
    return F.when(html.isNull(), None).when(trade, 1).otherwise(junk.cast("int"))


def attached(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's columns. right has one row for each key; it is broadcast if counted small, and else a merge
    join follows, whose hot keys Spark splits."""
    right = written(right, key)
    if right.count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return left.join(right, key, "left")


def prior_weight(groups: DataFrame, mean: float) -> float:
    """The weight, in pages, of a beta prior around `mean` for groups with columns n and bad (method of moments)."""
    rate = F.col("bad") / F.col("n")
    row = groups.where("n > 0").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (rate - mean) ** 2).alias("between"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count(F.lit(1)).alias("k")).first()
    spread = mean * (1 - mean)
    if not row.n or row.k < 2 or spread <= 0:
        return 10.0
    within = (row.k - 1) * spread
    left = row.n - row.n2 / row.n
    variance = (row.between - within) / left if left > 0 else 0.0
    variance = min(max(variance, spread / 1e4), spread / 1.5)
    return spread / variance - 1


#: Steps of the posterior's log odds, and how many standard deviations they reach to either side.
STEPS, REACH = 400, 10


def beta_quantile(a: Column, b: Column, p: float) -> Column:
    """The p-quantile of Beta(a, b), by the trapezoidal rule over the log odds u = ln(x / (1 - x)).

    There the density is exp(a ln x + b ln(1 - x)) up to a factor: smooth for any a, b > 0, highest at ln(a / b), with a
    variance of at most 1/a + 1/a^2 + 1/b + 1/b^2. The quantile is interpolated in the cumulated density."""
    spread = F.sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b))
    step = spread * (2.0 * REACH / STEPS)
    first = F.log(a / b) - spread * REACH
    # ln(1 - x) = -ln(1 + e^u) and ln x = u + ln(1 - x); 1 + e^u must not overflow, so e^-|u| is used.
    rest = lambda u: -(F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u))))
    log_density = lambda u: a * (u + rest(u)) + b * rest(u)
    top = log_density(F.log(a / b))
    weights = let(top, lambda t: F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: F.exp(log_density(first + i * step) - t)))
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    # at: how many steps the cumulated density lies below the goal, with the part of the step that reaches it.
    reached = lambda w, goal: F.aggregate(w, F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("at")), lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["at"] + F.when(s["sum"] + x <= goal, 1.0).when(s["sum"] < goal, (goal - s["sum"]) / x).otherwise(0.0)).alias("at")))["at"]
    # A weight stands for the step around its place.
    u = let(weights, lambda w: let(total(w) * p, lambda goal: reached(w, goal))) - 0.5
    return let(first + u * step, lambda v: 1 / (1 + F.exp(-v)))


def host_reputation(outcomes: DataFrame, tail: float = 0.05) -> DataFrame:
    """host -> host_pages, bad_rate, lower, upper, from a table with columns host and outcome (1, 0 or null): the mean of
    the posterior and the quantiles that leave `tail` below and above.

    Outcomes are summed by host before anything is shuffled; the levels above are sums of sums.
    """
    hosts = outcomes.groupBy("host").agg(F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = written(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    level = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = written(level(hosts, "domain", "suffix"), "domains")
    suffixes = written(level(domains, "suffix"), "suffixes")
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    mean = (total.bad + BASE[0]) / (total.n + BASE[1])
    shrunk = lambda weight, prior: (F.col("bad") + weight * prior) / (F.col("n") + weight)
    suffixes = suffixes.select("suffix", shrunk(prior_weight(suffixes, mean), F.lit(mean)).alias("suffix_rate"))
    weight = prior_weight(domains, mean)
    domains = attached(domains, suffixes, "suffix").select("domain", shrunk(weight, F.col("suffix_rate")).alias("domain_rate"))
    weight = prior_weight(hosts, mean)
    hosts = attached(hosts, domains, "domain")
    a = F.col("bad") + weight * F.col("domain_rate")
    b = F.col("n") - F.col("bad") + weight * (1 - F.col("domain_rate"))
    hosts = hosts.select("host", F.col("n").alias("host_pages"), a.alias("a"), b.alias("b"))
    of = F.col("a"), F.col("b")
    return hosts.select("host", "host_pages", (of[0] / (of[0] + of[1])).alias("bad_rate"), beta_quantile(*of, tail).alias("lower"), beta_quantile(*of, 1 - tail).alias("upper"))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]], outcome: Column, bad_rate: float = 0.5, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, and the host's host_pages, bad_rate, lower, upper."""
    check_columns(pages, page_id, url)
    address = F.col(url).cast("string")
    host, path = host_and_path(address)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    # The outcome reads the whole page; the verdicts read the page's id and address alone.
    hosts = host_reputation(pages.select(host.alias("host"), outcome.alias("outcome")))
    hosts = hosts.withColumns({c: F.round(c, 6) for c in ("bad_rate", "lower", "upper")})
    judged = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    judged = attached(judged.withColumns({"rule": rule, "by_rule": verdict}), hosts, "host")
    by_host = F.when(F.col("lower") >= bad_rate, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "host_pages", "bad_rate", "lower", "upper")
