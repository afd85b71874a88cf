"""URL filters by a path-template tree, after fixed rules.

Rules label urls: the longest rule that fits a url decides. What no rule decides, the tree does, learning from the labels that
rules gave other urls of the host.

Per host, segments of paths that vary are made wildcards: by their form (numbers, long hexadecimal strings, dates), and
where a node has at least ``CHILDREN`` different children with fewer than ``MEAN`` urls each on average, level by level from
the root, to any depth. Each node of the resulting tree has the labels of the urls below it. Siblings whose share of blocked
labels does not differ from that of all siblings together (a two-proportion test) are merged: they take the pooled labels. A
node without labels joins them if at least two labelled siblings were merged and its shape, the shares of its urls whose path
goes on by one and by two segments or more, does not differ from theirs (the same test). A template is rejected if its purity, the smoothed share of
blocked labels, is at least ``REJECT``; the deepest node with labels, own or pooled, speaks for a url. The prior says that few
urls are bad, and the host as a whole has no say, so that a template without evidence of its own is allowed.

Urls are counted by host and template before anything is compared, so a host with a third of all urls is a few rows. The tree
grows by one pass a level, for as many levels as some node has ``CHILDREN`` templates below it; all purities come from one.

Cases: null urls and urls without ``://`` have empty host and path, fit no rule and are allowed; urls of any length and depth are
read whole; equal urls are counted each, get the same verdict and keep a row each; rules of equal length cannot both fit
unless they are equal, and then the later one decides; empty tables give no rows; the columns of the input stay, whatever their
names, but for those named like the outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoked.llm.common import checkpoint, hinted, lower_ascii, packed, table, unpacked

#: (verdict, host, path) of the fixed rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A node with so many different children, each with less than MEAN urls on average, has one wildcard child.
CHILDREN, MEAN = 20, 5.0
#: The prior of a template: blocked labels out of all; and the purity from which it is rejected.
PRIOR_BAD, PRIOR_ALL, REJECT = 0.2, 2.0, 0.8
#: A difference in shares up to so many standard errors is none.
Z = 1.96
BROADCAST_ROWS = 200_000
OUTPUTS = ("host", "path", "rule", "template", "purity", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _typed(segment: Column) -> Column:
    """A segment whose form varies as a wildcard; endings such as .html stay."""
    for pattern, name in ((r"^\d{4}-\d{2}-\d{2}", "{date}"), (r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "{uuid}"), (r"^(?=[a-f]*\d)[0-9a-f]{12,}", "{hex}"), (r"^\d+", "{n}")):
        segment = F.regexp_replace(segment, pattern, name)
    return segment


def _segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _typed)


def templates(urls: DataFrame) -> DataFrame:
    """(host, segments, n, bad, labelled): urls with host, path and verdict counted by typed path."""
    rows = urls.select("host", "verdict", _segments(F.col("path")).alias("segments"))
    return rows.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("bad"), F.count("verdict").alias("labelled"))


def generalise(t: DataFrame) -> DataFrame:
    """The same with column ``template``: segments of nodes with many rare children are ``*``, from the root down."""
    t, d = checkpoint(t.withColumn("template", F.col("segments"))), 0
    while True:
        parent = F.slice("template", 1, d)
        kids = t.where(F.size("template") > d).groupBy("host", parent.alias("p"), F.get("template", F.lit(d)).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        nodes = checkpoint(kids.groupBy("host", "p").agg(F.count("*").alias("k"), F.avg("n").alias("mean"), F.sum("rows").alias("below")).where(F.col("below") >= CHILDREN))
        if nodes.isEmpty():  # nor can any node further down have as many children
            return t
        wide = nodes.where((F.col("k") >= CHILDREN) & (F.col("mean") < MEAN)).select(F.col("host").alias("w_host"), F.col("p").alias("w_p"), F.lit(True).alias("wide"))
        t = t.join(hinted(wide, BROADCAST_ROWS), (F.col("host") == F.col("w_host")) & (parent == F.col("w_p")), "left")
        t = checkpoint(t.withColumn("template", F.expr(f"transform(template, (s, i) -> if(i = {d} AND wide, '*', s))")).drop("w_host", "w_p", "wide"))
        d += 1


def _share(bad: Column, n: Column) -> Column:
    return bad / F.greatest(n, F.lit(1))


def _alike(share: Column, n: Column, other: Column) -> Column:
    """Whether a share of ``n`` does not differ from another, by its standard error."""
    return F.abs(share - other) <= Z * F.sqrt(F.greatest(other * (1 - other), F.lit(0.0)) / F.greatest(n, F.lit(1))) + 1e-9


def purities(t: DataFrame) -> DataFrame:
    """(host, template, purity): for each template the smoothed purity of the deepest node with labels."""
    own = t.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "labelled")))
    own = checkpoint(own.select("*", F.size("template").alias("size")))
    at = lambda d: F.xxhash64(F.col("host"), F.slice(F.col("template"), F.lit(1), d))
    path = F.transform(F.sequence(F.lit(1), F.col("size")), lambda d: F.struct(d.alias("d"), at(d).alias("node"), at(d - 1).alias("parent")))
    below = own.where("size > 0").select("host", "template", "size", "n", "bad", "labelled", F.inline(path))
    on = [F.sum(F.when(F.col("size") >= F.col("d") + k, F.col("n")).otherwise(0)).alias(f"on{k}") for k in (1, 2)]
    nodes = checkpoint(below.groupBy("node", "parent").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "labelled")), *on))

    total = nodes.groupBy("parent").agg(_share(F.sum("bad"), F.sum("labelled")).alias("p"))
    nodes = nodes.join(hinted(checkpoint(total), BROADCAST_ROWS), "parent")
    nodes = nodes.withColumn("alike", (F.col("labelled") > 0) & _alike(_share(F.col("bad"), F.col("labelled")), F.col("labelled"), F.col("p")))
    merged = nodes.where("alike").groupBy("parent").agg(F.count("*").alias("m"), F.sum("bad").alias("m_bad"), F.sum("labelled").alias("m_n"), *(_share(F.sum(f"on{k}"), F.sum("n")).alias(f"m_on{k}") for k in (1, 2)))
    nodes = nodes.join(hinted(checkpoint(merged), BROADCAST_ROWS), "parent", "left")
    shape = [_alike(_share(F.col(f"on{k}"), F.col("n")), F.col("n"), F.col(f"m_on{k}")) for k in (1, 2)]
    joins = (F.col("labelled") == 0) & (F.col("m") >= 2) & shape[0] & shape[1]
    pooled = F.col("alike") | F.coalesce(joins, F.lit(False))
    bad, n = F.when(pooled, F.col("m_bad")).otherwise(F.col("bad")), F.when(pooled, F.col("m_n")).otherwise(F.col("labelled"))
    speaks = checkpoint(nodes.select("node", bad.alias("bad"), n.alias("n")).where("n > 0").select("node", ((F.col("bad") + PRIOR_BAD * PRIOR_ALL) / (F.col("n") + PRIOR_ALL)).alias("purity")))
    found = below.select("host", "template", "d", "node").join(hinted(speaks, BROADCAST_ROWS), "node").groupBy("host", "template").agg(F.max_by("purity", "d").alias("purity"))
    found = found.select(F.col("host").alias("f_host"), F.col("template").alias("f_template"), "purity")
    out = own.select("host", "template").join(found, F.expr("host = f_host AND template = f_template"), "left")
    return out.select("host", "template", F.coalesce("purity", F.lit(PRIOR_BAD)).alias("purity"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (url) with host, path, rule, template, purity and verdict."""
    host, path = host_and_path(F.col("url"))
    urls = packed(pages, host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), verdict.alias("verdict"))
    t = generalise(templates(urls))
    pure = purities(t).select(F.col("host").alias("p_host"), F.col("template").alias("p_template"), "purity")
    known = t.join(pure, F.expr("host = p_host AND template = p_template")).select(F.col("host").alias("t_host"), F.col("segments").alias("t_segments"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")
    out = urls.withColumn("segments", _segments(F.col("path"))).join(hinted(checkpoint(known), BROADCAST_ROWS), F.expr("host = t_host AND segments = t_segments"), "left")
    out = out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")))
    return unpacked(out, pages.columns, *(F.col(c) for c in OUTPUTS), names=OUTPUTS)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
