"""URL filter: rules by host and path, and link-graph propagation for what no rule names.

A rule (host and path, like ``example.com/en/7``) fits its host and all subdomains if the url's path starts with its path; the longest rule wins
(equally long ones: the longer host, then the text order).

Where no rule fits, the host decides. Host edges are the absolute links of all pages (href and src, other hosts only), summed to
one weighted edge per pair of hosts. A host's trust seed is the share of its pages that an allow rule names, its distrust seed the share
that a block rule names. Trust is personalised PageRank from the trust seeds along the edges, distrust the same from the
distrust seeds along the reversed edges, so that a host that links to blocked ones inherits distrust; mass of hosts without
a further edge stays where it is. Both conserve mass, so a score's scale depends on how many hosts share it; they are reported, and verdicts go by
two figures from 0 to 1 that don't: a host's bad figure is its distrust seed, or if larger the damped mean of the bad figures of the hosts its links lead to
(a mean by number of links); its good figure is its trust seed, or if larger the damped mean of the good figures of the hosts that link to it. A host is
blocked if its bad figure exceeds its good one by more than `threshold`, or its distrust seed its trust seed: links to a host don't clear it of
what rules say of its own pages. The rounds are joins on hosts with sums combined on the map side, cut by tables in the shared folder; all run until
no host's value moves by `least`, which damping makes certain.

Defined cases: null urls and urls without ``://`` have an empty host and path, take part in no edge, and are allowed unless a rule without host
and path is given; null html has no links, very long html is searched whole; repeated rows are judged alike and count as pages; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, finished, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    text: str
    allow: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])


#: The rules of the registered query.
RULES = (Rule("com/en/", False), Rule("example.com/en/7", True), Rule("net/de/", True), Rule("example.net/de/8", False), Rule("org/es/", False))


def host_and_path(url: str = "url"):
    """Two columns: the host (A-Z lower-cased) and the path of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def apply_rules(spark: SparkSession, located: DataFrame, rules, in_plan: int = 64) -> DataFrame:
    """Adds `rule` and `rule_allow` (both null where none fits). Up to in_plan rules are one expression; more are a join on host suffixes."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    if len(ordered) <= in_plan:
        rule, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
        for r in reversed(ordered):
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            rule, allow = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.allow)).otherwise(allow)
        return located.withColumn("rule", rule).withColumn("rule_allow", allow)
    rows = spark.createDataFrame(
        [(r.host, r.path, r.text, r.allow, i) for i, r in enumerate(ordered)],
        "rule_host string, rule_path string, rule string, rule_allow boolean, place int",
    )
    # judged per distinct (host, path): a row for every suffix of the host, joined to the rules of that suffix
    urls = located.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hits = urls.withColumn("rule_host", F.explode(suffix)).join(rows, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = hits.groupBy("host", "path").agg(F.min(F.struct("place", "rule", "rule_allow")).alias("b")).select("host", "path", "b.rule", "b.rule_allow")
    return located.join(best, ["host", "path"], "left")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): how many links lead from one host to another."""
    host, _ = host_and_path()
    found = pages.where("html IS NOT NULL AND url IS NOT NULL").select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    found = found.withColumn("dst", F.translate("dst", UPPER, LOWER))
    return found.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def propagate(spark: SparkSession, hosts: DataFrame, edges: DataFrame, damping: float = 0.85, least: float = 1e-5, a_table: int = 3) -> DataFrame:
    """(host, trust, distrust) from hosts (host, trust_seed, distrust_seed) and edges (src, dst, w); `a_table` rounds are one plan. A round shrinks what moves by `damping` at least."""
    if not 0 <= damping < 1:
        raise ValueError("damping isn't in [0, 1)")
    total = edges.groupBy("src").agg(F.sum("w").alias("t"))
    out = materialise(spark, edges.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "edges-out")
    total = edges.groupBy("dst").agg(F.sum("w").alias("t"))
    back = materialise(spark, edges.join(total, "dst").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "edges-in")
    ends = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    has_out, has_in = out.select(F.col("src").alias("host"), F.lit(True).alias("has_out")).distinct(), back.select(F.col("dst").alias("host"), F.lit(True).alias("has_in")).distinct()
    base = hosts.join(ends, "host", "full").join(has_out, "host", "left").join(has_in, "host", "left").select(
        "host", F.coalesce("trust_seed", F.lit(0.0)).alias("s"), F.coalesce("distrust_seed", F.lit(0.0)).alias("b"),
        F.coalesce("has_out", F.lit(False)).alias("o"), F.coalesce("has_in", F.lit(False)).alias("i"),
    )
    state = materialise(spark, base.select("*", F.col("s").alias("trust"), F.col("b").alias("distrust")), "ranks")

    def step(state: DataFrame) -> DataFrame:
        t_in = out.join(
            state.where("trust > 0").select(F.col("host").alias("src"), "trust"), "src",
        ).groupBy(F.col("dst").alias("host")).agg(F.sum(F.expr("p * trust")).alias("t_in"))
        d_in = back.join(
            state.where("distrust > 0").select(F.col("host").alias("dst"), "distrust"), "dst",
        ).groupBy(F.col("src").alias("host")).agg(F.sum(F.expr("p * distrust")).alias("d_in"))
        stay_t, stay_d = F.when(F.col("o"), 0.0).otherwise(F.col("trust")), F.when(F.col("i"), 0.0).otherwise(F.col("distrust"))
        # sums in any order: rounded, so that results don't depend on it
        trust = F.round((1 - damping) * F.col("s") + damping * (F.coalesce("t_in", F.lit(0.0)) + stay_t), 10)
        distrust = F.round((1 - damping) * F.col("b") + damping * (F.coalesce("d_in", F.lit(0.0)) + stay_d), 10)
        moved = F.abs(trust - F.col("trust")) + F.abs(distrust - F.col("distrust"))
        return state.join(t_in, "host", "left").join(d_in, "host", "left").select(
            "host", "s", "b", "o", "i", trust.alias("trust"), distrust.alias("distrust"), moved.alias("moved"),
        )

    moved = 0.0 if edges.isEmpty() else 1.0  # without edges, every value is its seed
    while moved >= least:
        new = state
        for _ in range(a_table):
            new = step(new)
        new = materialise(spark, new, "ranks")
        moved = new.agg(F.max("moved")).first()[0] or 0.0
        drop_table(spark, state)
        state = new.drop("moved")
    finished(spark, out, back)
    return state.select("host", "trust", "distrust")


def figures(spark: SparkSession, hosts: DataFrame, edges: DataFrame, damping: float = 0.85, least: float = 1e-6) -> DataFrame:
    """(host, good, bad, s, b) from hosts (host, trust_seed, distrust_seed) and edges (src, dst, w); s and b are the seeds. A round shrinks what moves by `damping` at least."""
    if not 0 <= damping < 1:
        raise ValueError("damping isn't in [0, 1)")
    total = edges.groupBy("src").agg(F.sum("w").alias("t"))
    ahead = materialise(spark, edges.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "edges-ahead")
    total = edges.groupBy("dst").agg(F.sum("w").alias("t"))
    behind = materialise(spark, edges.join(total, "dst").select("src", "dst", (F.col("w") / F.col("t")).alias("p")), "edges-behind")
    ends = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    base = hosts.join(ends, "host", "full").select("host", F.coalesce("trust_seed", F.lit(0.0)).alias("s"), F.coalesce("distrust_seed", F.lit(0.0)).alias("b"))
    state = materialise(spark, base.select("*", F.col("s").alias("good"), F.col("b").alias("bad")), "figures")
    moved = 0.0 if edges.isEmpty() else 1.0
    while moved >= least:
        g_in = behind.join(
            state.where("good > 0").select(F.col("host").alias("src"), "good"), "src",
        ).groupBy(F.col("dst").alias("host")).agg(F.sum(F.expr("p * good")).alias("g_in"))
        b_in = ahead.join(
            state.where("bad > 0").select(F.col("host").alias("dst"), "bad"), "dst",
        ).groupBy(F.col("src").alias("host")).agg(F.sum(F.expr("p * bad")).alias("b_in"))
        # greatest passes nulls over; rounded as in propagate
        good, bad = F.round(F.greatest("s", damping * F.col("g_in")), 10), F.round(F.greatest("b", damping * F.col("b_in")), 10)
        step = state.join(g_in, "host", "left").join(b_in, "host", "left")
        new = materialise(
            spark,
            step.select(
                "host", "s", "b", good.alias("good"), bad.alias("bad"),
                F.greatest(F.abs(good - F.col("good")), F.abs(bad - F.col("bad"))).alias("moved"),
            ),
            "figures",
        )
        moved = new.agg(F.max("moved")).first()[0] or 0.0
        drop_table(spark, state)
        state = new.drop("moved")
    finished(spark, ahead, behind)
    return state


def judge(spark: SparkSession, pages: DataFrame, rules=RULES, threshold: float = 0.6, damping: float = 0.85) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, trust, distrust."""
    host, path = host_and_path()
    located = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).fillna("", ["host", "path"])
    ruled = apply_rules(spark, located, rules)
    seeds = ruled.where("host <> ''").groupBy("host").agg(
        (F.count_if(F.col("rule_allow")) / F.count("*")).alias("trust_seed"),
        (F.count_if(~F.col("rule_allow")) / F.count("*")).alias("distrust_seed"),
    )
    edges = materialise(spark, host_edges(pages), "host-edges")
    bad = F.greatest(F.col("b") - F.col("s"), F.col("bad") - F.col("good")) > threshold
    by_host = propagate(spark, seeds, edges, damping).join(figures(spark, seeds, edges, damping).select("host", bad.alias("__bad")), "host")
    word = lambda ok: F.when(ok, "allow").otherwise("block")
    joined = ruled.join(by_host, "host", "left")
    verdict = F.when(F.col("rule").isNotNull(), word(F.col("rule_allow"))).otherwise(word(~F.coalesce("__bad", F.lit(False))))
    return joined.select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
