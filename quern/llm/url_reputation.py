"""URL filters: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain and
suffix. Each level's rate is shrunk to its parent's through a beta prior whose
strength is estimated from the spread between that level's groups. A host is
blocked when even the lower posterior bound of its bad rate is above the limit.

Hosts are counted without user names, ports and a last dot. The suffix is the
last label, or the last two where a country's registry sells below labels such
as ``co`` (SECOND_LEVEL); the registered domain is the suffix and one label more,
as far as the host has them; an IPv4 address is its own domain and suffix.

The limit is learned unless it is given: the rate of bad pages among all labelled
ones. A host is then blocked when it is worse than the corpus at the level of ``z``.

Defined cases: a null url, or one without ``://``, has an empty host and path
and is judged as the empty host; a page that repeats counts as often as it comes;
a page with several labels is bad if one says so; null page_id has no label;
without labels every rate is the prior's, and all hosts are allowed; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import pick, settle

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    host = F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together) and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


#: Labels below which country registries sell names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "go", "mil", "ne", "net", "nom", "or", "org")


def levels(host: Column) -> tuple[Column, Column, Column]:
    """(site, registered domain, suffix) of a host."""
    site = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")
    two = F.rlike(site, F.lit(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$"))
    ip = F.rlike(site, F.lit(r"^[0-9]+(\.[0-9]+){3}$"))
    domain = F.when(ip, site).when(two, F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))
    suffix = F.when(ip, site).when(two, F.substring_index(site, ".", -2)).otherwise(F.substring_index(site, ".", -1))
    return site, domain, suffix


def strength(groups: int, n: float, k: float, n2: float, k2: float) -> float:
    """Prior strength by the method of moments, from sums over groups of (n, k): of n, k, n * n and k * k / n."""
    rho = 0.01
    if groups > 1 and 0 < k < n and n > groups:
        p = k / n
        rho = ((k2 - n * p * p) / (p * (1 - p)) - (groups - 1)) / (n - n2 / n - (groups - 1))
    return 1.0 / min(max(rho, 0.001), 0.5) - 1.0


def _strength(groups: DataFrame) -> float:
    g = groups.where("n > 0").agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("k2"),
    ).first()  # fmt: skip  # one row
    return strength(g["g"], *(g[c] or 0.0 for c in ("n", "k", "n2", "k2")))


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, float]:
    """Posterior bad rate of every site, (site, n, k, a, b) with a and b of its beta, and the rate of all.

    pages: (page_id, site, domain, suffix); outcomes: (page_id, bad 0 or 1). Counts
    are pre-aggregated by site, so a host with most of the pages is no hot key;
    all else reads that table, which is written once. The driver gets five single
    rows of sums.
    """
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    sites = pages.join(known, "page_id", "left").groupBy("site", "domain", "suffix").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k")
    )
    sites = settle(sites, "sites")
    count = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = count(sites, "domain", "suffix")
    suffixes = count(domains, "suffix")
    all_of = sites.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    p0 = ((all_of["k"] or 0.0) + 0.5) / ((all_of["n"] or 0.0) + 5.0)
    ms, md, mh = (F.lit(_strength(g)) for g in (suffixes, domains, sites))
    s = suffixes.select("suffix", ((F.col("k") + ms * F.lit(p0)) / (F.col("n") + ms)).alias("ps"))
    d = domains.join(s, "suffix").select("domain", "suffix", ((F.col("k") + md * F.col("ps")) / (F.col("n") + md)).alias("pd"))
    h = sites.join(d, ["domain", "suffix"])
    a, b = F.col("k") + mh * F.col("pd"), F.col("n") - F.col("k") + mh * (F.lit(1.0) - F.col("pd"))
    return h.select("site", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), a.alias("a"), b.alias("b")), p0


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float | None = None, z: float = 1.645) -> DataFrame:
    """Every page with host, path, rule and verdict, and what is known of its site; the method speaks where no rule does.

    bad_low is the lower posterior bound of the site's bad rate, to 6 places.
    """
    p = pick(pages, page_id="long", url="string")
    host, path = parts(F.col("url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"))
    site, domain, suffix = levels(F.col("host"))
    p = p.withColumns({"site": site, "domain": domain, "suffix": suffix})
    rep, p0 = host_reputation(p.select("page_id", "site", "domain", "suffix"), pick(outcomes, page_id="long", bad="int"))
    a, b = F.col("a"), F.col("b")
    low = a / (a + b) - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + F.lit(1.0))))
    by_host = F.when(low > F.lit(p0 if limit is None else limit), "block").otherwise("allow")
    rep = rep.select("site", "n", F.col("k").alias("n_bad"), F.round(low, 6).alias("bad_low"), by_host.alias("by_host"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return p.join(rep, "site", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("by_host"), F.lit("allow")).alias("verdict"), "site", "n", "n_bad", "bad_low",
    )


def outcomes_from_labels(labels: DataFrame) -> DataFrame:
    """A page's outcome is the quality label under its id: 0 is bad."""
    rows = pick(labels, doc_id="long", quality="int")
    return rows.select(F.col("doc_id").alias("page_id"), (F.lit(1) - F.col("quality")).alias("bad"))


def sql() -> str:
    """The same with the defaults over pages and labels, for DuckDB."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    order = sorted(RULES, key=lambda r: -(len(r[0]) + len(r[1])))
    case = lambda at: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{at(h, p, v)}'" for h, p, v in order) + " END"
    m = lambda t: (
        f"(SELECT 1.0::DOUBLE / least(greatest(coalesce(CASE WHEN g > 1 AND k > 0 AND k < n AND n > g THEN ((k2 - n * (k / n) * (k / n)) / ((k / n) * (1.0::DOUBLE - k / n)) - (g - 1)) "
        f"/ (n - n2 / n - (g - 1)) END, 0.01::DOUBLE), 0.001::DOUBLE), 0.5::DOUBLE) - 1.0::DOUBLE FROM (SELECT count(*) AS g, sum(n) AS n, sum(k) AS k, sum(n * n) AS n2, sum(k * k / n) AS k2 FROM {t} WHERE n > 0))"
    )
    return f"""
        WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        v AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') AS site FROM u),
        w AS (SELECT *, string_split(site, '.') AS l, CASE WHEN regexp_matches(site, '^[0-9]+(\\.[0-9]+){{3}}$') THEN 9
                     WHEN regexp_matches(site, '(^|\\.)({'|'.join(SECOND_LEVEL)})\\.[a-z][a-z]$') THEN 2 ELSE 1 END AS depth FROM v),
        x AS (SELECT *, array_to_string(l[greatest(len(l) - depth, 1):], '.') AS domain, array_to_string(l[greatest(len(l) - depth + 1, 1):], '.') AS suffix FROM w),
        known AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
        sites AS (SELECT site, domain, suffix, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM x LEFT JOIN known USING (page_id) GROUP BY ALL),
        domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM sites GROUP BY ALL),
        suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
        c AS (SELECT (SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 5.0::DOUBLE) FROM sites) AS p0, {m('suffixes')} AS ms, {m('domains')} AS md, {m('sites')} AS mh),
        s AS (SELECT suffix, (k + ms * p0) / (n + ms) AS ps FROM suffixes, c),
        d AS (SELECT domain, suffix, (k + md * ps) / (n + md) AS pd FROM domains JOIN s USING (suffix), c),
        h AS (SELECT site, n, k, k + mh * pd AS a, n - k + mh * (1.0::DOUBLE - pd) AS b FROM sites JOIN d USING (domain, suffix), c),
        r AS (SELECT site, n, k, a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0::DOUBLE))) AS low FROM h)
        SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, coalesce({case(lambda h, p, v: v)}, CASE WHEN low > p0 THEN 'block' ELSE 'allow' END) AS verdict,
               site, n::BIGINT AS n, k::BIGINT AS n_bad, round(low, 6) AS bad_low
        FROM x LEFT JOIN r USING (site), c"""
