"""URL filters: host and path rules, and trust and distrust propagated over the graph of hosts.

A rule fits a host and its subdomains where the url's path starts with the rule's; the longest wins. Urls without a rule get
their host's verdict. Trust starts at hosts with urls that a rule allows and moves along links, distrust starts at hosts with
urls that a rule blocks and moves against them (who links to a bad host is bad): two personalised PageRanks in one pass a
round, with a restart of 15 %. A host is blocked if its share of distrust, distrust / (trust + distrust) of masses that each sum to
one over all hosts, is over `threshold`. After ROUNDS rounds under 1 % of the mass (0.85 ** 30) is still on its way.

Edges: absolute links in a page's HTML, counted by pages, and a link each way between a host and the nearest parent domain
that is itself a host here. A host without links keeps its mass. Scores are whole numbers, UNIT for each url that seeds them, so that neither
the order of summing nor the engine matters, and one blocked url counts the same beside billions (9 billion fit). Everything is
DataFrame operations.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is allowed; so is a host that
neither mass reaches. A null html links to nothing. Repeated rows each come out. Extra columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import staged

#: (verdict, host, path) as the contract names them.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UNIT, RESTART, ROUNDS = 1_000_000_000, 15, 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"^.*?://([^/?#]*)([^?#]*)"
LINK = r"""[hH][rR][eE][fF]\s*=\s*["']?((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: F.Column) -> F.Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)" + URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, "(?s)" + URL, 2), F.lit(""))


def longest_rule(host: F.Column, path: F.Column, rules=RULES) -> F.Column:
    """The longest fitting rule as (length, rule, verdict), or null; the list of rules is a short parameter."""

    def one(verdict: str, h: str, p: str) -> F.Column:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        return F.when(fits, F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))

    return F.array_max(F.filter(F.array(*(one(*r) for r in rules)), lambda x: x.isNotNull()))


def host_edges(pages: DataFrame, hosts: DataFrame, host_column: str = "host", html_column: str = "html") -> DataFrame:
    """(src, dst, num): links between two hosts by the number of pages, and host to parent domain and back."""
    links = pages.select(F.col(host_column).alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_column), F.lit(LINK), F.lit(1)), lambda x: host_of(F.concat(F.lit("x:"), F.regexp_replace(x, "^[^/]*", "")))))).alias("dst"))
    linked = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("num"))
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(labels))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("step", "parent")).where("parent <> ''")
    parents = above.join(hosts.select(F.col("host").alias("parent")), "parent").groupBy("host").agg(F.min_by("parent", "step").alias("parent"))
    family = parents.select(F.col("host").alias("src"), F.col("parent").alias("dst")).unionByName(parents.select(F.col("parent").alias("src"), F.col("host").alias("dst")))
    return linked.unionByName(family.withColumn("num", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("num").alias("num"))


def propagated(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust_seed, distrust_seed) and edges (src, dst, num)."""
    steps = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit(0).alias("kind"), "num").unionByName(edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(1).alias("kind"), "num"))
    den = steps.groupBy("host", "kind").agg(F.sum("num").alias("den"))
    kinds = seeds.select("host", F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"))
    idle = kinds.join(den, ["host", "kind"], "left_anti").select("host", F.col("host").alias("to"), "kind", F.lit(1).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))
    steps = staged(steps.join(den, ["host", "kind"]).select("host", "to", "kind", "num", "den").unionByName(idle), "steps")
    seeds = staged(seeds, "seeds")
    now = seeds.select("host", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    part = F.expr(f"cast(cast(cast(m as decimal(20,0)) * num * {100 - RESTART} as decimal(38,0)) div (den * 100) as bigint)")
    for k in range(rounds):
        moved = steps.join(now, "host").withColumn("m", F.when(F.col("kind") == 0, F.col("trust")).otherwise(F.col("distrust"))).where("m > 0")
        got = moved.select("to", "kind", part.alias("m")).groupBy("to").agg(F.sum(F.when(F.col("kind") == 0, F.col("m")).otherwise(0)).alias("t"), F.sum(F.when(F.col("kind") == 1, F.col("m")).otherwise(0)).alias("d"))
        add = lambda seed, m: (F.expr(f"{seed} div 100 * {RESTART}") + F.coalesce(m, F.lit(0))).cast("long")
        now = seeds.join(got, F.col("host") == F.col("to"), "left").select("host", add("trust_seed", F.col("t")).alias("trust"), add("distrust_seed", F.col("d")).alias("distrust"))
        if k % 5 == 4:
            now = staged(now, "scores")
    return now


def judged(pages: DataFrame, rules=RULES, threshold: int = 50, rounds: int = ROUNDS, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust; threshold in per cent of distrust."""
    url = F.col(url_column).cast("string")
    parts = pages.select(F.col(id_column).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_column).cast("string").alias("html"))
    fit = longest_rule(F.col("host"), F.col("path"), rules)
    rows = parts.select("page_id", "host", "path", fit["rule"].alias("rule"), fit["verdict"].alias("by_rule"))
    count = lambda v: F.sum(F.when(F.col("by_rule") == v, 1).otherwise(0)).cast("long")
    hosts = rows.where("host <> ''").groupBy("host").agg(count("allow").alias("good"), count("block").alias("bad"))
    hosts = staged(hosts, "hosts")
    total = hosts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    edges = staged(host_edges(parts, hosts.select("host")), "edges")
    known = hosts.unionByName(edges.select(F.col("dst").alias("host"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad"))).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    seeds = known.select("host", (F.col("good") * UNIT).alias("trust_seed"), (F.col("bad") * UNIT).alias("distrust_seed"))
    scores = propagated(seeds, edges, rounds)
    good, bad = max(1, total["good"] or 0), max(1, total["bad"] or 0)
    over = F.expr(f"cast(distrust as decimal(20,0)) * {good} * {100 - threshold} > cast(trust as decimal(20,0)) * {bad} * {threshold}")
    verdict = F.coalesce("by_rule", F.when(over, "block").otherwise("allow"))
    return rows.join(scores, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))


def oracle(rules=RULES, threshold: int = 50, rounds: int = ROUNDS) -> str:
    """The same as DuckDB SQL, every round a step of its own."""
    link = LINK.replace("'", "''")
    url = URL.replace("^", "(?s)^", 1)
    fits = "\n".join(f"  select page_id, host, path, {len(h + p)} as n, '{h + p}' as rule, '{v}' as verdict from parts where (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') union all" for v, h, p in rules).rstrip().removesuffix("union all")
    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    steps = "".join(
        f"""
s{k + 1} as materialized (
  select seeds.host, (trust_seed // 100 * {RESTART} + coalesce(t, 0))::bigint as trust, (distrust_seed // 100 * {RESTART} + coalesce(d, 0))::bigint as distrust from seeds left join (
    select "to", sum(case when kind = 0 then m else 0 end) as t, sum(case when kind = 1 then m else 0 end) as d
    from (select "to", kind, (case when kind = 0 then trust else distrust end)::hugeint * num * {100 - RESTART} // (den * 100) as m from steps join s{k} using (host)) group by 1) on "to" = seeds.host),"""
        for k in range(rounds)
    )
    return f"""
with parts as materialized (
  select row_number() over () as r, page_id, {low.format(f"coalesce(regexp_extract(url, '{url}', 1), '')")} as host, coalesce(regexp_extract(url, '{url}', 2), '') as path, html from pages),
fits as (select r, arg_max(rule, n) as rule, arg_max(verdict, n) as verdict from (
{fits.replace("select page_id", "select r, page_id")}) group by r),
ruled as materialized (select parts.*, rule, verdict as by_rule from parts left join fits using (r)),
hosts as materialized (select host, count(*) filter (by_rule = 'allow') as good, count(*) filter (by_rule = 'block') as bad from ruled where host <> '' group by 1),
links as (select distinct r, host as src, {low.format(f"regexp_extract('x:' || regexp_replace(l, '^[^/]*', ''), '{url}', 1)")} as dst from (select r, host, unnest(regexp_extract_all(html, '{link}', 1)) as l from parts)),
linked as (select src, dst, count(*) as num from links where src <> '' and dst <> '' and src <> dst group by 1, 2),
above as (select host, i, array_to_string(string_split(host, '.')[i:], '.') as parent from (select host, unnest(range(2, len(string_split(host, '.')) + 1)) as i from hosts)),
parents as (select above.host, arg_min(parent, i) as parent from above join hosts h on h.host = parent where parent <> '' group by 1),
edges as materialized (select src, dst, sum(num) as num from (select * from linked union all select host, parent, 1 from parents union all select parent, host, 1 from parents) group by 1, 2),
known as (select host, sum(good) as good, sum(bad) as bad from (select host, good, bad from hosts union all select dst, 0, 0 from edges) group by 1),
seeds as materialized (select host, (good * {UNIT})::bigint as trust_seed, (bad * {UNIT})::bigint as distrust_seed from known),
moves as (select src as host, dst as "to", 0 as kind, num from edges union all select dst, src, 1, num from edges),
dens as (select host, kind, sum(num) as den from moves group by 1, 2),
steps as materialized (select host, "to", kind, num, den from moves join dens using (host, kind) union all select host, host, kind, 1, 1 from (select host, unnest([0, 1]) as kind from seeds) k where not exists (select 1 from dens where dens.host = k.host and dens.kind = k.kind)),
s0 as materialized (select host, trust_seed as trust, distrust_seed as distrust from seeds),{steps}
done as (select * from s{rounds})
select page_id, ruled.host, path, rule, coalesce(by_rule, case when distrust::hugeint * greatest(1, (select sum(good) from hosts)) * {100 - threshold} > trust::hugeint * greatest(1, (select sum(bad) from hosts)) * {threshold} then 'block' else 'allow' end) as verdict, coalesce(trust, 0)::bigint as trust, coalesce(distrust, 0)::bigint as distrust
from ruled left join done on done.host = ruled.host
"""
