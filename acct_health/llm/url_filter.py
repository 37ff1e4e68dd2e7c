"""URL filter: allow and block rules, and for urls that no rule fits, trust spread along links of hosts.

A rule (``host/path``) fits its host and all subdomains where the url's path starts with the rule's;
the longest wins (of two equally long the one with the longer host). Host edges are the links of pages
to other hosts, weighted by the number of links. Personalised PageRank starts from each host's share
of pages that an allow rule decides and follows the links; distrust starts from the share that a block
rule decides and follows them backwards, to those who link there. A host is blocked if its distrust is
above its trust and at least ``BLOCK_SHARE`` of what a wholly blocked host has by itself.

Ranks, edges and verdicts are tables; each step joins ranks with edges that were added up per pair of
hosts, and is stored, so lineage stays short. Mass at hosts without links is not handed on.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and the verdict
of a host without links (allow); null html has no links; rows with equal ids are judged each by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acct_health.llm.common import read_table, stored

#: Rules are part of the expression that judges a url; longer lists belong into a table join.
MOST_RULES = 2000
DAMPING = 0.85
#: Largest change of any rank at which the steps end. A step hands on at most 0.85 of what the one before it did, so
#: ranks of hosts with seeds of at most 1 are that still after ``ITERATIONS`` steps, whatever the links.
TOLERANCE = 1e-6
ITERATIONS = 100
BLOCK_SHARE = 0.5
#: Up to this many hosts the verdicts are broadcast; beyond, they are joined.
BROADCAST_HOSTS = 100_000

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def url_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with __host and __path."""
    url = F.coalesce("url", F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("__host", lower).withColumn("__path", path)


def matching_rule(host, path, rules: list[tuple[str, str]]):
    """struct(n, h, rule, action) of the longest fitting rule, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<n:int,h:int,rule:string,action:string,host:string,path:string>")
    listed = []
    for action, rule in rules:
        at = rule.index("/")
        listed.append(F.struct(F.lit(len(rule)).alias("n"), F.lit(at).alias("h"), F.lit(rule).alias("rule"), F.lit(action).alias("action"),
                               F.lit(rule[:at]).alias("host"), F.lit(rule[at:]).alias("path")))
    fits = F.filter(F.array(*listed), lambda r: ((host == r.host) | F.endswith(host, F.concat(F.lit("."), r.host))) & F.startswith(path, r.path))
    return F.array_max(fits)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links of each host's pages to other hosts. ``pages`` has __host and html."""
    link = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
    links = pages.where("html is not null and __host <> ''").select(
        F.col("__host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(link), F.lit(1))).alias("dst"))
    return links.withColumn("dst", F.lower("dst")).where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust) and edges (src, dst, n)."""
    edges = stored(edges, "edges")
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    forward = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("all")).alias("w"))
    back = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("all")).alias("w"))
    steps = stored(forward.unionByName(back), "steps")
    hosts = seeds.select("host").unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    start = hosts.join(seeds, "host", "left").fillna(0.0, ["trust", "distrust"]).select(
        "host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "seed"))
    start = stored(start, "seeds")
    ranks = start.withColumn("rank", F.col("seed") * (1 - DAMPING))
    any_links = not steps.isEmpty()
    for _ in range(iterations if any_links else 0):
        given = ranks.select("kind", F.col("host").alias("a"), "rank").where("rank > 0").join(steps, ["kind", "a"]).groupBy(
            "kind", F.col("b").alias("host")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        after = ranks.join(given, ["kind", "host"], "left").select(
            "host", "kind", "seed", (F.col("seed") * (1 - DAMPING) + DAMPING * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("before"))
        after = stored(after, "ranks")
        change = after.agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0]
        ranks = after.drop("before")
        if change is None or change < TOLERANCE:
            break
    return ranks.groupBy("host").agg(F.max(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"),
                                     F.max(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages``."""
    pages = url_parts(pages.select("page_id", "url", "html"))
    ruled = pages.withColumn("__rule", matching_rule(F.col("__host"), F.col("__path"), rules))
    share = lambda action: F.avg(F.when(F.col("__rule.action") == action, 1.0).otherwise(0.0))
    seeds = ruled.where("__host <> ''").groupBy(F.col("__host").alias("host")).agg(share("allow").alias("trust"), share("block").alias("distrust"))
    hosts = stored(propagate(seeds, host_edges(pages)), "hosts")
    small = hosts.count() <= broadcast_hosts
    joined = ruled.drop("html").withColumnRenamed("__host", "host").join(F.broadcast(hosts) if small else hosts, "host", "left")
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= (1 - DAMPING) * BLOCK_SHARE)
    verdict = F.coalesce(F.col("__rule.action"), F.when(blocked, F.lit("block")), F.lit("allow"))
    return joined.select("page_id", "host", F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), verdict.alias("verdict"),
                         "trust", "distrust")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), RULES).drop("trust", "distrust")


def _case(value) -> str:
    """SQL branches over the rules, the winning one first."""
    longest = sorted(RULES, key=lambda x: (-len(x[1]), -x[1].index("/")))
    return " ".join(f"WHEN (host = '{r[:r.index('/')]}' OR ends_with(host, '.{r[:r.index('/')]}')) AND starts_with(path, '{r[r.index('/'):]}') "
                    f"THEN '{value(a, r)}'" for a, r in longest)


ORACLE_SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {_case(lambda a, r: a)} END AS action, CASE {_case(lambda a, r: r)} END AS rule FROM u),
s AS (SELECT host, avg((coalesce(action, '') = 'allow')::INT) AS trust, avg((coalesce(action, '') = 'block')::INT) AS distrust FROM r WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, lower(unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\\s>]+)', 1))) AS dst FROM u WHERE html IS NOT NULL AND host <> ''),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE dst <> '' AND dst <> src GROUP BY ALL),
w AS (SELECT 'trust' AS kind, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS w FROM e
      UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e),
h AS (SELECT host FROM s UNION SELECT dst FROM e),
seed AS (SELECT h.host, k.kind, coalesce(CASE k.kind WHEN 'trust' THEN trust ELSE distrust END, 0.0) AS seed
         FROM h LEFT JOIN s USING (host), (VALUES ('trust'), ('distrust')) k(kind)),
p AS (SELECT 0 AS i, host, kind, seed * {1 - DAMPING} AS rank FROM seed
      UNION ALL SELECT p0.i + 1, p0.host, p0.kind, any_value(seed.seed) * {1 - DAMPING} + {DAMPING} * coalesce(sum(p1.rank * w.w), 0.0)
      FROM p p0 JOIN seed ON seed.host = p0.host AND seed.kind = p0.kind LEFT JOIN w ON w.kind = p0.kind AND w.b = p0.host
      LEFT JOIN p p1 ON p1.kind = w.kind AND p1.host = w.a WHERE p0.i < {ITERATIONS} GROUP BY p0.i, p0.host, p0.kind),
t AS (SELECT host, max(CASE kind WHEN 'trust' THEN rank END) AS trust, max(CASE kind WHEN 'distrust' THEN rank END) AS distrust
      FROM p WHERE i = {ITERATIONS} GROUP BY host)
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce(action, CASE WHEN distrust > trust AND distrust >= {(1 - DAMPING) * BLOCK_SHARE} THEN 'block' END, 'allow') AS verdict
FROM r LEFT JOIN t ON t.host = r.host
"""
