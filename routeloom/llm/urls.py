"""URL filters: rules by host and path, and trust that spreads over the host graph; DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import checkpointed, forget, table, with_columns

#: Fixed values: (host, start of path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
DAMPING, TOLERANCE, BLOCK_SHARE = 0.85, 1e-9, 0.5
#: Rounds of a walk that one job computes.
JOB_ROUNDS = 8
#: What a host may still lack when rounds end, at most; equality with the bound is meant up to it.
SLACK = TOLERANCE * DAMPING / (1 - DAMPING)
#: Rules are compiled into the plan, up to so many.
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty without `://`."""
    found = F.instr(url, "://")
    return F.when(
        found > 0, F.translate(F.regexp_extract(url.substr(found + 3, F.length(url)), "^[^/?#]*", 0), UPPER, LOWER)
    ).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to `?`, `#` or the end; empty without `://`."""
    found = F.instr(url, "://")
    return F.when(
        found > 0, F.regexp_extract(url.substr(found + 3, F.length(url)), "^[^/?#]*([^?#]*)", 1)
    ).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; a rule fits its host and the subdomains."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how many pages of host src link to the other host dst; pages need host and html."""
    to = F.transform(
        F.regexp_extract_all("html", F.lit(LINK), 1),
        lambda h: host_of(F.when(h.startswith("//"), F.concat(F.lit("x:"), h)).otherwise(h)),
    )
    links = pages.where("host <> ''").select(
        F.col("host").alias("src"), F.explode(F.array_distinct(F.filter(to, lambda h: h != ""))).alias("dst")
    )
    return links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def rounds_needed(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """After so many rounds no host moves by more than the tolerance: a round moves at most `damping` times what the last one did."""
    return JOB_ROUNDS * math.ceil(max(1, math.log(tolerance) / math.log(damping)) / JOB_ROUNDS + 1)


def spread(
    seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE
) -> DataFrame:
    """(host, trust, distrust, neutral): two walks that restart at the seeds, over links and over reversed links.

    trust = (1 - damping) * seed + damping * what the hosts that link here pass on, each in equal parts a linking page;
    distrust likewise from the hosts that are linked to. seeds has host, trust, distrust and neutral, whose sum is 1;
    a host that is only linked to is neutral. Rounds end when no host moves by more than the tolerance, which
    rounds_needed bounds; JOB_ROUNDS at a time are written to the shared checkpoint folder. Without links no round is needed.
    """
    links = checkpointed(links)
    if links.isEmpty():
        return seeds.select("host", *[((1 - damping) * F.col(c)).alias(c) for c in ("trust", "distrust", "neutral")])
    totals = lambda side: links.groupBy(side).agg(F.sum("n").alias(f"{side}_n"))
    edges = checkpointed(
        links.join(totals("src"), "src").join(totals("dst"), "dst").select(
            "src", "dst", (F.col("n") / F.col("src_n")).alias("along"), (F.col("n") / F.col("dst_n")).alias("back")
        )
    )
    # trust goes along an edge, distrust back; so one table says what each host gets of each other one
    moves = checkpointed(
        edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("along").alias("t"), F.lit(0.0).alias("d"))
        .unionByName(edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("t"), F.col("back").alias("d")))
    )
    ends = moves.select(F.col("from").alias("host")).distinct()
    base = checkpointed(
        ends.join(seeds, "host", "full").select(
            "host",
            *[
                ((1 - damping) * F.coalesce(c, F.lit(v))).alias(c)
                for c, v in (("trust", 0.0), ("distrust", 0.0), ("neutral", 1.0))
            ],
        )
    )
    restart = base.select("host", "trust", "distrust")

    def step(now: DataFrame) -> DataFrame:
        passed = moves.join(now, F.col("from") == F.col("host")).select(
            F.col("to").alias("host"),
            (damping * F.col("trust") * F.col("t")).alias("trust"),
            (damping * F.col("distrust") * F.col("d")).alias("distrust"),
        )
        return passed.unionByName(restart).groupBy("host").agg(
            F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")
        )

    now = checkpointed(restart)
    for _ in range(0, rounds_needed(damping, tolerance), JOB_ROUNDS):
        after = now
        for _ in range(JOB_ROUNDS):
            after = step(after)
        after = checkpointed(after)
        old = now.select(F.col("host").alias("h"), F.col("trust").alias("t"), F.col("distrust").alias("d"))
        moved = after.join(old, F.col("host") == F.col("h")).agg(
            F.max(F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d")))
        ).first()[0]
        forget(now)
        now = after
        if moved <= tolerance:
            break
    return now.join(base.select("host", "neutral"), "host")


def judge_urls(
    pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, block_share: float = BLOCK_SHARE
) -> DataFrame:
    """`pages` with host, path, rule, verdict, trust and distrust.

    A page that a rule fits gets the rule's verdict. Any other gets its host's: seeds are the shares of a host's pages
    that rules allow (trust) and block (distrust), the rest is neutral; trust spreads along links and distrust against
    them, and a host is blocked if distrust is at least `block_share` of trust, distrust and neutral together. So a
    host without links is blocked if rules block that share of its pages. Pages without a host (null url, no `://`)
    fit no rule, seed nothing and are allowed. A null html has no links; repeated rows count each; columns of the
    added names are replaced; an empty table gives an empty result.
    """
    drop = [c for c in pages.columns if c.lower() in {"host", "path", "rule", "verdict", "trust", "distrust", "__rule"}]
    named = with_columns(pages.drop(*drop), {"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = with_columns(named, {"__rule": rule_of(F.col("host"), F.col("path"), rules)})
    share = lambda v: F.avg((F.col("__rule.verdict").eqNullSafe(F.lit(v))).cast("double"))
    seeds = ruled.where("host <> ''").groupBy("host").agg(
        share("allow").alias("trust"), share("block").alias("distrust")
    ).withColumn("neutral", 1 - F.col("trust") - F.col("distrust"))
    hosts = spread(checkpointed(seeds), host_links(named))
    total = reduce(lambda a, b: a + b, (F.col(c) for c in ("trust", "distrust", "neutral")))
    judged = checkpointed(
        hosts.select(
            F.col("host").alias("__host"),
            "trust",
            "distrust",
            (F.col("distrust") >= block_share * total - SLACK).alias("__block"),
        )
    )
    joined = ruled.join(judged, F.col("host") == F.col("__host"), "left")
    out = with_columns(
        joined,
        {
            "rule": F.col("__rule.rule"),
            "verdict": F.coalesce(
                F.col("__rule.verdict"),
                F.when(F.coalesce("__block", F.lit(False)), F.lit("block")).otherwise(F.lit("allow")),
            ),
            "trust": F.coalesce("trust", F.lit(0.0)),
            "distrust": F.coalesce("distrust", F.lit(0.0)),
        },
    )
    return out.drop("__host", "__block", "__rule")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"))
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        "verdict",
        F.round("trust", 4).alias("trust"),
        F.round("distrust", 4).alias("distrust"),
    )


def _fits_sql(name: str, start: str) -> str:
    return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}')"


def _rules_sql(k: int) -> str:
    by_length = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN {_fits_sql(*r[:2])} THEN '{(r[0] + r[1], r[2])[k]}'" for r in by_length) + " END"


def _host_sql(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN translate(regexp_extract(substr({url}, instr({url}, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END"


OP1_SQL = f"""
WITH RECURSIVE named AS (
  SELECT page_id, html, {_host_sql("url")} AS host,
         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
ruled AS (SELECT *, {_rules_sql(0)} AS rule, {_rules_sql(1)} AS said FROM named),
seeds AS (
  SELECT host, AVG(CASE WHEN said = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, AVG(CASE WHEN said = 'block' THEN 1.0 ELSE 0.0 END) AS distrust
  FROM ruled WHERE host <> '' GROUP BY host),
found AS (
  SELECT DISTINCT page_id, src, {_host_sql("h")} AS dst
  FROM (SELECT page_id, host AS src, UNNEST(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS h FROM named WHERE host <> '') t
  WHERE contains(h, '://')),
links AS (SELECT src, dst, COUNT(*) AS n FROM found WHERE dst <> '' AND src <> dst GROUP BY src, dst),
edges AS (
  SELECT src, dst, n / SUM(n) OVER (PARTITION BY src) AS along, n / SUM(n) OVER (PARTITION BY dst) AS back FROM links),
base AS (
  SELECT host, COALESCE(trust, 0) AS trust, COALESCE(distrust, 0) AS distrust
  FROM (SELECT host FROM seeds UNION SELECT src FROM edges UNION SELECT dst FROM edges) h LEFT JOIN seeds USING (host)),
moves AS (
  SELECT src AS a, dst AS b, along AS t, 0.0 AS d FROM edges UNION ALL SELECT dst, src, 0.0, back FROM edges
  UNION ALL SELECT host, host, 0.0, 0.0 FROM base),
walk AS (
  SELECT 0 AS round, host, {1 - DAMPING} * trust AS trust, {1 - DAMPING} * distrust AS distrust FROM base
  UNION ALL
  SELECT MAX(w.round) + 1, m.b, ANY_VALUE({1 - DAMPING} * s.trust) + {DAMPING} * SUM(w.trust * m.t), ANY_VALUE({1 - DAMPING} * s.distrust) + {DAMPING} * SUM(w.distrust * m.d)
  FROM walk w JOIN moves m ON m.a = w.host JOIN base s ON s.host = m.b
  WHERE w.round < {rounds_needed()} AND EXISTS (SELECT 1 FROM edges)
  GROUP BY m.b),
judged AS (
  SELECT w.host, w.trust, w.distrust,
         w.distrust >= {BLOCK_SHARE} * (w.trust + w.distrust + {1 - DAMPING} * (1 - b.trust - b.distrust)) - {SLACK} AS blocked
  FROM walk w JOIN base b USING (host) WHERE w.round = (SELECT MAX(round) FROM walk))
SELECT page_id, host, path, rule, COALESCE(said, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict,
       ROUND(COALESCE(trust, 0), 4) AS trust, ROUND(COALESCE(distrust, 0), 4) AS distrust
FROM ruled LEFT JOIN judged USING (host)
"""
