"""URL rules and link-graph propagation over hosts.

Pages that a rule fits follow the longest one. For the others their host decides: trust flows from
hosts with allowed pages along links (personalised PageRank, each host with the weight of its own seed, so
that scores don't depend on the rest of the table), distrust from hosts with blocked pages
against links, as a page that links to blocked ones is suspect itself. Besides the links found in the
pages, a host and its parent domain are linked both ways, since a site speaks for its subdomains; a public suffix
is no such parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacegrid.llm.common import ascii_lower, cut

#: Share of a score that goes on to the next host. With this one, walks of 18 links hold a ten-thousandth of what set out.
DAMPING = 0.6
#: Rounds between two looks at the scores, and the largest growth of a score over them, by its size, that ends the rounds.
ROUNDS, LEAST_GROWTH = 8, 1e-4
#: Lead of distrust over trust, as a share of their sum, that blocks a host: ten times what the last rounds may still add.
LEAD = 1e-3
#: Labels that a parent domain has at least.
PARENT_LABELS = 2
#: Suffixes of two labels under which strangers register names: no site of their own. Fixed values.
SUFFIXES = tuple(
    (
        "co.uk org.uk ac.uk gov.uk me.uk net.uk com.au net.au org.au edu.au gov.au co.nz org.nz net.nz co.jp ne.jp or.jp ac.jp go.jp com.br net.br org.br gov.br co.in net.in org.in ac.in gov.in co.za org.za com.cn net.cn org.cn gov.cn "
        "com.tw org.tw com.hk org.hk com.sg com.my com.mx com.ar com.tr co.kr or.kr co.il org.il co.id com.ua com.pl com.ph com.vn com.eg com.sa com.ng com.pk "
        "github.io gitlab.io netlify.app vercel.app herokuapp.com pages.dev web.app firebaseapp.com blogspot.com wordpress.com tumblr.com appspot.com azurewebsites.net cloudfront.net neocities.org substack.com"
    ).split()
)
HREF = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``pages`` (url, any others) with host, path, rule and ruled (verdict of the longest fitting rule).

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with its own. Host:
    after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
    ``?``, ``#`` or the end; both are empty for a null url or one without ``://``.
    """
    rest = F.regexp_extract(_after_scheme(F.col("url")), r"(?s)^([^/?#]*)([^?#]*)", 0)
    pages = pages.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumns({"host": ascii_lower(F.regexp_extract("_rest", r"(?s)^([^/]*)", 1)), "path": F.regexp_extract("_rest", r"(?s)^[^/]*(.*)$", 1)})
    fitting = [
        F.when(((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path), F.struct(F.lit(len(host + path)).alias("length"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("ruled")))
        for verdict, host, path in rules
    ]
    none = F.lit(None).cast("struct<length:int,rule:string,ruled:string>")
    best = F.greatest(*fitting, none, none)
    return pages.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "ruled": F.col("_best.ruled")}).drop("_rest", "_best")


def _spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, host, score) of personalised PageRank from ``seeds`` (kind, host, seed) along ``edges`` (kind, src, dst, n), run until no score still grows."""
    degree = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    steps = cut(edges.join(degree, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all") * DAMPING).alias("share")))
    start = cut(seeds.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("score")))
    scores = start
    while True:
        before = scores.withColumnRenamed("score", "was")
        for _ in range(ROUNDS):
            moved = scores.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score"))
            scores = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        grown = cut(scores.join(before, ["kind", "host"], "left"))
        scores = grown.select("kind", "host", "score")
        if not grown.where(F.col("score") - F.coalesce("was", F.lit(0.0)) > LEAST_GROWTH * F.col("score")).limit(1).count():
            return scores


def host_scores(pages: DataFrame) -> DataFrame:
    """(host, trust, distrust) of all hosts that seeds reach; ``pages`` as of with_rules, with html."""
    known = pages.select("host", "ruled").where("host <> ''")
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), 1)).alias("dst")).select("src", ascii_lower(F.col("dst")).alias("dst"))
    links = cut(links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n")))
    hosts = known.groupBy("host").agg(F.sum((F.col("ruled") == "allow").cast("long")).alias("good"), F.sum((F.col("ruled") == "block").cast("long")).alias("bad"), F.count("*").alias("n"))
    hosts = cut(hosts.select("host", (F.coalesce("good", F.lit(0)) / F.col("n")).alias("good"), (F.coalesce("bad", F.lit(0)) / F.col("n")).alias("bad")))
    every = hosts.select("host").union(links.select("dst")).distinct()
    parents = every.select("host", F.regexp_extract("host", r"^[^.]*\.(.*)$", 1).alias("parent")).where((F.size(F.split("parent", r"\.")) >= PARENT_LABELS) & ~F.col("parent").isin(*SUFFIXES))
    kin = parents.select(F.col("host").alias("src"), F.col("parent").alias("dst")).union(parents.select("parent", "host")).withColumn("n", F.lit(1.0))
    edges = cut(links.unionByName(kin).groupBy("src", "dst").agg(F.sum("n").alias("n")))

    good, bad = F.lit("good").alias("kind"), F.lit("bad").alias("kind")
    seeds = hosts.select(good, "host", F.col("good").alias("seed")).union(hosts.select(bad, "host", "bad")).where("seed > 0")
    ways = edges.select(good, "src", "dst", "n").union(edges.select(bad, "dst", "src", "n"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    return _spread(ways, seeds).groupBy("host").agg(of("good").alias("trust"), of("bad").alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], tolerance: float = LEAD) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    verdict is the longest fitting rule's, else block where the host's distrust exceeds its trust by
    more than ``tolerance`` of their sum (ties allow), else allow; hosts that no seed reaches, and urls without a host, are
    allowed. Null html has no links. Repeated rows and ids are judged each; other columns are ignored.
    """
    judged = with_rules(pages.select("page_id", "url", "html"), rules)
    scores = host_scores(judged)
    named = judged.select("page_id", "host", "path", "rule", "ruled").join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(distrust - trust > tolerance * (trust + distrust), "block").otherwise("allow"))
    return named.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
