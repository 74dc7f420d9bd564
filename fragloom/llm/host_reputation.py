r"""URL filters: explicit rules first, empirical-Bayes host reputation for the rest, of DataFrame functions alone.

Labelled page outcomes (bad or not) are counted per host. Beta-binomial priors shrink them level by level: the suffix
towards the whole table, the registered domain towards its suffix, the host towards its domain. The strength of each
prior is a moment estimate from the counts of that level. A host is blocked if its posterior puts CONFIDENCE or more on
a bad rate above MAX_BAD; hosts without labels have their domain's prior as posterior. The posterior tail is a sum over GRID
points within ten standard deviations of the mean.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the
end; null urls and urls without ``://`` have both empty. A rule ``host/prefix`` fits its host and all subdomains if the
path starts with ``/prefix``; the longest rule wins, of equally long ones the first by code point.

Scale: pages meet hosts that are blocked only, in a join that AQE can split at a hot host; counts are taken map-side.
Up to MAX_RULES rules are one expression; more, which the driver holds, are joined on the ends of the host.

Defined cases: pages without a host count for no reputation, and only rules could block them. An outcome without a page, or null, counts nothing; a page with repeated outcomes is bad if any is.
Repeated pages count and are judged one by one. Without labels nothing but rules blocks. Other columns of the inputs,
whatever their names, are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragloom.llm._shared import LOWER, UPPER, merge_join, stored, table, with_row_id

MAX_BAD, CONFIDENCE = 0.5, 0.95
#: Bounds of a prior's strength, in pages.
STRENGTH = (1.0, 1000.0)
#: Rules up to which they are one expression; more are joined.
MAX_RULES = 1000
#: Suffixes of two labels; all others have one.
LONG_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "org.uk")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The rule that decides (`host/prefix`), null if none fits."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        of, _, prefix = rule.partition("/")
        found = F.when(((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{prefix}"), F.lit(rule)).otherwise(found)
    return found


def with_rule(urls: DataFrame, rules: dict[str, str]) -> DataFrame:
    """urls (page_id, host, path) plus rule and said, the rule's verdict."""
    if len(rules) <= MAX_RULES:
        said = F.lit(None).cast("string")
        for rule, verdict in sorted(rules.items()):
            said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
        return urls.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("said", said)
    listed = [(rule, rule.partition("/")[0], f"/{rule.partition('/')[2]}", len(rule), verdict) for rule, verdict in rules.items()]
    listed = urls.sparkSession.createDataFrame(listed, "rule string, of string, prefix string, length int, said string")
    urls = with_row_id(stored(urls))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    found = urls.select("_rid", "path", F.explode(ends).alias("of")).join(F.broadcast(listed), "of").where(F.startswith("path", "prefix"))  # a list that the driver holds
    best = found.groupBy("_rid").agg(F.min(F.struct((-F.col("length")).alias("l"), "rule", "said")).alias("best"))
    return merge_join(urls, best, "_rid", "left").select("page_id", "host", "path", "best.rule", "best.said")


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; a host of one label, or an address, is its own domain."""
    labels = F.split(host, r"\.")
    n = F.when(F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES), 2).otherwise(1)
    suffix = F.when(n == 2, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(F.size(labels) <= n, host).when(n == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    address = host.rlike(r"^[0-9.:\[\]]+$")
    return F.when(address, host).otherwise(domain), F.when(address, F.lit("")).otherwise(suffix)


def strength(groups: DataFrame) -> float:
    """Prior strength from (n, bad, mean): moments of the beta-binomial, within STRENGTH."""
    n, m = F.col("n").cast("double"), F.col("mean")
    row = groups.agg(F.sum((F.col("bad") - n * m) ** 2 - n * m * (1 - m)).alias("over"), F.sum(n * (n - 1) * m * (1 - m)).alias("base")).first()
    rho = row["over"] / row["base"] if row["base"] else 0.0
    return min(max(1 / rho - 1 if rho > 0 else STRENGTH[1], STRENGTH[0]), STRENGTH[1])


def ln_gamma(z: Column) -> Column:
    """For z > 0: Stirling's series eight places up, and the recurrence back."""
    w = z + 8
    steps = z
    for i in range(1, 8):
        steps = steps * (z + i)
    return (w - 0.5) * F.ln(w) - w + math.log(2 * math.pi) / 2 + 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - F.ln(steps)


def tail(a: Column, b: Column, at: float) -> Column:
    """P(x > at) for x ~ Beta(a, b), a and b above 0: the regularised incomplete beta function by its continued fraction, on the
    side of the mean where that converges, within some multiples of the root of the larger parameter."""
    swap = (1 - at) >= (b + 1) / (a + b + 2)
    p, q = F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a)
    x = F.when(swap, F.lit(float(at))).otherwise(F.lit(1.0 - at))
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + p * F.ln(x) + q * F.ln(1 - x)) / p
    some = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def step(s: Column, part: Column) -> Column:
        d, c = 1 / some(1 + part * s["d"]), some(1 + part / s["c"])
        return state(c, d, s["h"] * c * d)

    def both(s: Column, i: Column) -> Column:
        m = i.cast("double")
        s = step(s, m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)))
        return step(s, -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1)))

    first = 1 / some(1 - (p + q) * x / (p + 1))
    turns = (F.ceil(5 * F.sqrt(F.greatest(a, b))) + 50).cast("int")
    inside = front * F.aggregate(F.sequence(F.lit(1), turns), state(F.lit(1.0), first, first), both, lambda s: s["h"])
    return F.when(swap, 1 - inside).otherwise(inside)


def reputations(hosts: DataFrame) -> DataFrame:
    """hosts (host, n, bad) with domain, suffix, the posterior a, b and p_bad = P(bad rate > MAX_BAD)."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = table(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = table(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    mean = (whole["bad"] + 0.5) / (whole["n"] + 1)
    shrunk = lambda k: (F.col("bad") + k * F.col("mean")) / (F.col("n") + k)
    suffixes = table(suffixes.withColumn("mean", F.lit(mean)), "suffixes")
    suffixes = suffixes.select("suffix", shrunk(strength(suffixes)).alias("mean"))
    domains = table(domains.join(suffixes, "suffix"), "domains")
    domains = domains.select("domain", "suffix", shrunk(strength(domains)).alias("mean"))
    hosts = table(hosts.join(domains, ["domain", "suffix"]), "hosts")
    k = strength(hosts)
    hosts = hosts.withColumns({"a": F.col("bad") + k * F.col("mean"), "b": F.col("n") - F.col("bad") + k * (1 - F.col("mean"))})
    return hosts.withColumn("p_bad", tail(F.col("a"), F.col("b"), MAX_BAD))


def judge(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict. outcomes: (page_id, bad 0/1). rules: {'host/prefix': 'allow' or 'block'}."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    labels = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    hosts = urls.where("host <> ''").join(labels, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    blocked = table(reputations(hosts).where(F.col("p_bad") >= CONFIDENCE).select("host", F.lit(True).alias("bad_host")), "blocked")
    ruled = with_rule(urls, rules).join(blocked, "host", "left")
    return ruled.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("bad_host"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
