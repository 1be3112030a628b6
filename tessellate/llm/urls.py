"""URL filters by rules and link-graph propagation, in DataFrame functions only.

A page whose url a rule fits takes the longest such rule's verdict.  For the others the
host decides: personalised PageRank carries trust from the hosts of allowed pages along
host edges, and distrust from the hosts of blocked pages along the reversed edges; a
host is blocked if distrust makes up over `threshold` of the two.  The seeds of each kind are a
distribution over its hosts by pages, so neither kind weighs more for having more pages.

Edges: the hosts that a host's pages link to (absolute and protocol-relative href values),
weighted by links, and with `parents` an edge of weight 1 each way between a host and its
parent domain where the table has both.  Edges are summed by host pair before any join, so
a hot host costs one row for each partner.  Mass at hosts without out-edges is dropped.
Steps are made until no host's mass, however small, has grown by over TOLERANCE of itself in
EVERY steps, so all hosts that mass can reach are reached; masses pass through tables in the
shared folder.  Verdicts compare unrounded masses; a tie, to MARGIN, is allowed.  The SQL makes
STEPS steps by a recursive query, beyond which masses differ by less than is shown.

Defined cases: a null url or one without `://` has empty host and path; an empty host has
neither edges nor scores and is allowed; a host that no mass reaches is allowed; a null html
has no links; repeated rows are judged each; null page_ids pass through; other columns are
ignored.  A rule's path must begin the url's path, so a bare host without a path fits no
rule, as every rule's path begins with a slash.  The rules are written into the plan, so
their number is bounded by what a plan can hold (hundreds).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

DAMPING, STEPS, THRESHOLD = 0.85, 200, 0.5
TOLERANCE, EVERY, MARGIN = 1e-9, 8, 1e-9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def parsed(pages: DataFrame, *more: str) -> DataFrame:
    """page_id, host, path and the named columns."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), *more)
    after = F.expr("CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return slim.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), *more)


def ruled(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule that fits host and path, else null."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_edges(pages: DataFrame, parents: bool = True) -> DataFrame:
    """(src, dst, n): edges between hosts, summed."""
    rows = parsed(pages, "html").where("host <> ''")
    links = rows.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    edges = links.select("src", F.translate("to", _UPPER, _LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    if parents:
        hosts = parsed(pages).where("host <> ''").select("host").distinct()
        up = hosts.select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst")).where("src <> dst AND dst <> ''")
        known = up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")
        both = known.select("src", "dst").union(known.select("dst", "src")).withColumn("n", F.lit(1).cast("long"))
        edges = edges.union(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    return edges


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, mass), converged.  seeds: (kind, host, mass), kind trust or distrust; trust
    goes along the edges, distrust against them.  Masses only grow from step to step, and a
    host that is reached anew has grown by all it has."""
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = ways.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    ways = stored(ways.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "ways")
    rest = stored(seeds.withColumn("mass", F.col("mass") * (1 - damping)), "seeds")
    now = rest
    while True:
        old = now
        for _ in range(EVERY):
            sent = now.withColumnRenamed("host", "src").join(ways, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
            now = rest.union(sent).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        now = stored(now, "ranks")
        both = now.withColumn("was", F.lit(0.0)).union(old.select("kind", "host", F.lit(0.0), "mass"))
        both = both.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("was").alias("was"))
        grown = both.where("mass > 0").agg(F.max((F.col("mass") - F.col("was")) / F.col("mass"))).first()[0]
        if old is not rest:
            dropped(old)
        if grown is None or grown < tolerance:
            return now


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE, parents: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of the host (6 decimals)."""
    name, verdict = ruled(rules)
    rows = parsed(pages).withColumn("rule", name).withColumn("by_rule", verdict)
    seeds = rows.where("by_rule IS NOT NULL AND host <> ''").groupBy(F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").cast("double").alias("mass"))
    totals = F.broadcast(seeds.groupBy("kind").agg(F.sum("mass").alias("all")))  # two rows at most
    seeds = seeds.join(totals, "kind").select("kind", "host", (F.col("mass") / F.col("all")).alias("mass"))
    mass = propagated(host_edges(pages, parents), seeds, damping, tolerance)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
    scores = mass.groupBy("host").agg(of("trust"), of("distrust"))
    out = rows.join(scores, "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    share = threshold * (1 + MARGIN) * (F.col("trust") + F.col("distrust"))
    by_host = F.when(F.col("distrust") > share, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))


def oracle(rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING, steps: int = STEPS) -> str:
    """judged() in DuckDB's SQL."""
    cases = {"name": "", "verdict": ""}
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        cases["name"] += f"{fits} THEN '{r.name}' "
        cases["verdict"] += f"{fits} THEN '{r.verdict}' "
    host = f"translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}')"
    link = LINK.replace("'", "''")
    return f"""WITH RECURSIVE cut AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, html, coalesce({host}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
marked AS (SELECT page_id, host, path, CASE {cases["name"]} END AS rule, CASE {cases["verdict"]} END AS by_rule FROM parts),
pages_of AS (SELECT CASE WHEN by_rule = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM marked WHERE by_rule IS NOT NULL AND host <> '' GROUP BY ALL),
seeds AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS mass FROM pages_of),
hosts AS (SELECT DISTINCT host FROM parts WHERE host <> ''),
up AS (SELECT host AS src, substr(host, instr(host, '.') + 1) AS dst FROM hosts WHERE instr(host, '.') > 0),
known AS (SELECT src, dst FROM up WHERE dst IN (SELECT host FROM hosts)),
raw AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM parts WHERE host <> ''),
edges AS (SELECT src, dst, count(*) AS n FROM (SELECT * FROM raw WHERE src <> dst UNION ALL SELECT src, dst FROM known UNION ALL SELECT dst, src FROM known) GROUP BY ALL),
both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
ways AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
sent AS (SELECT 0 AS step, kind, host, mass * {1 - damping} AS mass FROM seeds
UNION ALL SELECT any_value(s.step) + 1, s.kind, w.dst, sum(s.mass * w.share * {damping}) FROM sent s JOIN ways w ON w.kind = s.kind AND w.src = s.host WHERE s.step < {steps} GROUP BY s.kind, w.dst),
scores AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust FROM sent GROUP BY host)
SELECT page_id, m.host AS host, path, rule, coalesce(by_rule, CASE WHEN coalesce(distrust, 0) > {threshold * (1 + MARGIN)} * (coalesce(trust, 0) + coalesce(distrust, 0)) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust
FROM marked m LEFT JOIN scores s ON s.host = m.host"""
