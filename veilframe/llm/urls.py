"""URL filters by a path-template tree, in DataFrame functions alone.

Fixed rules come first. For other urls a tree of path templates is learnt per host: segments that
vary become wildcards, sibling branches whose labels do not differ significantly merge, and a
template is rejected if its share of blocked labels, smoothed towards the labels of its merged
branch, of the nodes above it and of the parent hosts, is high. The urls that a fixed rule fits are
the labelled ones; a label counts by its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stash

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A segment stays literal if at least this share of its parent's urls go through it ...
LITERAL_SHARE = 0.05
#: ... or its parent has at most this many different segments.
FEW_SEGMENTS = 8
#: Pseudo-labels that pull a purity to that of the next wider node.
SMOOTHING = 10.0
#: Smoothed share of blocked labels from which a template is rejected.
REJECT_FROM = 0.95
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame) -> DataFrame:
    """``page_id``, host and path; both are empty where the url is null or has no ``://``."""
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        "page_id",
        F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(url, pattern, 2).alias("path"),
    )


def rule_column(rules=RULES) -> Column:
    """The longest rule that fits host and path, as ``host + path``; else null."""
    out = F.lit(None).cast("string")
    for _, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(host + path)).otherwise(out)
    return out


def verdict_of_rule(rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for verdict, host, path in rules:
        out = F.when(F.col("rule") == host + path, F.lit(verdict)).otherwise(out)
    return out


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (distinct host and path, with n) plus ``template``: the path with wildcards.

    A segment's shape replaces digit runs by ``#``. Children of a node are counted under the
    host and the shapes above; a segment that varies becomes ``*`` (its shape, if that has a
    ``#``). A host, a node or a child with most urls is no hot key: its row is broadcast, see
    :func:`spread_join`.
    """
    shaped = urls.withColumn("segments", F.split(F.regexp_replace("path", r"[0-9]+", "#"), "/"))
    nodes = shaped.select("host", "path", "n", "segments", F.posexplode("segments").alias("depth", "segment")).select(
        "host", "path", "n", "depth", "segment", F.expr("array_join(slice(segments, 1, depth), '/')").alias("above")
    )
    nodes = stash(nodes)
    children = stash(nodes.groupBy("host", "above", "depth", "segment").agg(F.sum("n").alias("n_child"), F.count("*").alias("urls")))
    parents = stash(children.groupBy("host", "above", "depth").agg(F.sum("n_child").alias("n_parent"), F.count("*").alias("kinds"))).withColumn("weight", F.col("kinds"))
    keep = (F.col("kinds") <= FEW_SEGMENTS) | (F.col("n_child") >= LITERAL_SHARE * F.col("n_parent")) | F.col("segment").contains("#")
    children = spread_join(children, parents, ["host", "above", "depth"], "weight").select(
        "host", "above", "depth", "segment", "urls", F.when(keep, F.col("segment")).otherwise(F.lit("*")).alias("label")
    )
    labelled = spread_join(nodes, stash(children), ["host", "above", "depth", "segment"], "urls")
    return labelled.groupBy("host", "path", "n").agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(depth, label))), x -> x.label), '/')").alias("template")
    )


def branches(counts: DataFrame) -> DataFrame:
    """``counts`` once for every segment after the first ``/``: depth, and the template with ``*`` there as branch."""
    segments = F.split("template", "/")
    many = counts.select("*", segments.alias("_s"), F.explode(F.expr("filter(sequence(0, size(split(template, '/')) - 1), d -> d > 0)")).alias("depth"))
    return many.withColumn("branch", F.expr("array_join(transform(_s, (x, i) -> if(i = depth, '*', x)), '/')")).drop("_s")


def alike(known: DataFrame) -> DataFrame:
    """Branches whose labelled members merge: host, depth, branch, and the labels b and l of all.

    Siblings differ in one segment alone, at any depth. They merge if a chi-square test over their
    shares of blocked labels stays within three standard deviations of its mean.
    """
    pooled = known.groupBy("host", "depth", "branch").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"), F.count("*").alias("k"))
    p = F.col("b") / F.col("l")
    each = F.when((F.col("b") > 0) & (F.col("b") < F.col("l")), (F.col("blocked") - F.col("labelled") * p) ** 2 / (F.col("labelled") * p * (1 - p))).otherwise(0.0)
    chi = known.join(pooled, ["host", "depth", "branch"]).groupBy("host", "depth", "branch", "b", "l", "k").agg(F.sum(each).alias("chi"))
    return chi.where((F.col("k") > 1) & (F.col("chi") <= F.col("k") - 1 + 3 * F.sqrt(2.0 * (F.col("k") - 1)))).select("host", "depth", "branch", "b", "l")


def merged(counts: DataFrame) -> DataFrame:
    """Labelled templates that merge with their siblings: host, template, depth, branch.

    ``counts`` has host, template, blocked and labelled.
    """
    known = branches(counts.where("labelled > 0"))
    return known.join(alike(known), ["host", "depth", "branch"]).select("host", "template", "depth", "branch")


def _lookup(keyed: DataFrame, by: list[str], name: str) -> DataFrame:
    """The labels (b, l) of each of a row's nested nodes, from the widest on, as array ``name``.

    ``keyed`` has the columns ``by``, blocked, labelled and ``nodes``, one array of node keys a
    row; nodes hold the labels of all rows that have their key. Rows with no labels look up too.
    """
    each = keyed.select(*by, "blocked", "labelled", F.posexplode("nodes").alias("at", "node"))
    scope = ["host", "node"] if len(by) > 1 else ["node"]
    sums = each.where("labelled > 0").groupBy(*scope).agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    found = each.join(sums, scope, "left").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("l", F.lit(0)).alias("l")))).alias(name))
    return found.withColumn(name, F.transform(name, lambda x: F.struct(x["b"].alias("b"), x["l"].alias("l"))))


def purities(counts: DataFrame) -> DataFrame:
    """host, template, purity: the smoothed share of blocked labels of every template.

    Evidence is taken from the widest to the nearest: all labels, the parent hosts, the host, the
    nodes above the template, then its deepest merged branch or else its own labels. Each step
    pulls by ``SMOOTHING`` to the one before and counts only the labels that no nearer node on
    the template's way holds, so a label is not counted again at every depth.
    """
    hosts = counts.groupBy("host").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), -i, i), '.'))")
    of_host = _lookup(hosts.withColumn("nodes", suffixes), ["host"], "wide")
    prefixes = F.expr("transform(sequence(1, size(split(template, '/'))), i -> array_join(slice(split(template, '/'), 1, i), '/'))")
    of_path = _lookup(counts.withColumn("nodes", prefixes), ["host", "template"], "deep")
    many = branches(counts)
    merges = many.join(alike(many.where("labelled > 0")), ["host", "depth", "branch"]).groupBy("host", "template").agg(F.max_by(F.struct("b", "l"), "depth").alias("pool"))
    overall = counts.agg((F.sum("blocked") / F.greatest(F.sum("labelled"), F.lit(1))).alias("share"))
    own = F.struct(F.col("blocked").alias("b"), F.col("labelled").alias("l"))
    found = counts.join(of_path, ["host", "template"]).join(of_host, "host").join(merges, ["host", "template"], "left").join(F.broadcast(overall))  # one row
    found = found.withColumn("nested", F.concat("wide", "deep", F.array(own)))
    rings = F.expr("transform(slice(nested, 1, size(nested) - 1), (x, i) -> struct(x.b - nested[i + 1].b as b, x.l - nested[i + 1].l as l))")
    steps = F.concat(rings, F.array(F.coalesce("pool", own)))
    start = F.coalesce("share", F.lit(0.0)).cast("double")
    purity = F.aggregate(steps, start, lambda p, x: (x["b"] + SMOOTHING * p) / (x["l"] + SMOOTHING))
    return found.select("host", "template", purity.alias("purity"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template for every row of ``pages``.

    Repeated rows stay; an empty host or path has a template like any other. A template with no
    labels of its own is judged by those around it, see :func:`purities`.
    """
    split = parts(pages).withColumn("rule", rule_column(rules))
    split = split.withColumn("by_rule", verdict_of_rule(rules))
    urls = stash(split.groupBy("host", "path", "by_rule").agg(F.count("*").alias("n")))
    tree = templates(urls.groupBy("host", "path").agg(F.sum("n").alias("n")))
    urls = stash(urls.join(tree.drop("n"), ["host", "path"]))
    blocked = F.sum(F.when(F.col("by_rule") == "block", F.col("n")).otherwise(0))
    labelled = F.sum(F.when(F.col("by_rule").isNotNull(), F.col("n")).otherwise(0))
    counts = stash(urls.groupBy("host", "template").agg(blocked.alias("blocked"), labelled.alias("labelled")))
    by_tree = F.when(F.col("purity") >= REJECT_FROM, F.lit("block")).otherwise(F.lit("allow"))
    weights = urls.groupBy("host", "template").agg(F.count("*").alias("urls"))
    judged = stash(purities(counts).select("host", "template", by_tree.alias("by_tree")).join(weights, ["host", "template"]))
    of_path = stash(spread_join(urls.select("host", "path", "n", "template"), judged, ["host", "template"], "urls"))
    return spread_join(split, of_path, ["host", "path"], "n").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", "by_tree").alias("verdict"), "template"
    )


def oracle(rules=RULES) -> str:
    """SQL for the rows of query op7_urls over ``pages``."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h + p}'" for _, h, p in longest)
    verdicts = " ".join(f"when '{h + p}' then '{v}'" for v, h, p in rules)
    step = f"{{'b': (x.b + {SMOOTHING}::double * p.b) / (x.l + {SMOOTHING}::double), 'l': x.l}}"
    return f"""
        with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) as path from pages),
        ruled as (select *, case {fits} end as rule, case rule {verdicts} end as by_rule from p),
        u as (select host, path, by_rule, count(*) as n from ruled group by all),
        seg as (select host, path, sum(n) as n, string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/') as s from u group by host, path),
        deep as (select *, unnest(range(0, len(s))) as depth from seg),
        nodes as (select host, path, n, depth, s[depth + 1] as segment, coalesce(array_to_string(s[1:depth], '/'), '') as above from deep),
        children as (select host, above, depth, segment, sum(n) as n_child from nodes group by all),
        labels as (select *, case when count(*) over w <= {FEW_SEGMENTS} or n_child >= {LITERAL_SHARE}::double * sum(n_child) over w or contains(segment, '#') then segment else '*' end as label from children window w as (partition by host, above, depth)),
        tree as (select host, path, string_agg(label, '/' order by depth) as template from nodes join labels using (host, above, depth, segment) group by host, path),
        counts as (select host, template, cast(coalesce(sum(n) filter (by_rule = 'block'), 0) as double) as b, cast(coalesce(sum(n) filter (by_rule is not null), 0) as double) as l from u join tree using (host, path) group by host, template),
        many as (select *, unnest(range(1, len(string_split(template, '/')))) as depth from counts),
        branches as (select host, template, b, l, depth, array_to_string(list_transform(string_split(template, '/'), lambda x, i: case when i = depth + 1 then '*' else x end), '/') as branch from many),
        pooled as (select host, depth, branch, sum(b) as pb, sum(l) as pl, count(*) as k from branches where l > 0 group by all),
        chi as (select host, depth, branch, pb, pl, k, sum(case when b > 0 and b < l then pow(b - l * (pb / pl), 2) / (l * (pb / pl) * (1 - pb / pl)) else 0 end) as chi from branches join pooled using (host, depth, branch) where l > 0 group by all),
        alike as (select host, depth, branch, pb, pl from chi where k > 1 and chi <= k - 1 + 3 * sqrt(2.0 * (k - 1))),
        pool as (select host, template, max_by({{'b': pb, 'l': pl}}, depth) as pool from branches join alike using (host, depth, branch) group by host, template),
        hosts as (select host, sum(b) as b, sum(l) as l, string_split(host, '.') as s from counts group by host),
        parents as (select host, b, l, i, array_to_string(s[len(s) - i + 1:], '.') as node from (select *, unnest(range(1, len(s) + 1)) as i from hosts)),
        of_parent as (select node, sum(b) as b, sum(l) as l from parents where l > 0 group by node),
        wide as (select host, list({{'b': coalesce(o.b, 0), 'l': coalesce(o.l, 0)}} order by i) as wide from parents left join of_parent o using (node) group by host),
        above as (select host, template, b, l, i, array_to_string(string_split(template, '/')[1:i], '/') as node from (select *, unnest(range(1, len(string_split(template, '/')) + 1)) as i from counts)),
        of_node as (select host, node, sum(b) as b, sum(l) as l from above where l > 0 group by host, node),
        near as (select host, template, list({{'b': coalesce(o.b, 0), 'l': coalesce(o.l, 0)}} order by i) as near from above left join of_node o using (host, node) group by host, template),
        nested as (select host, template, {{'b': b, 'l': l}} as own, pool, list_concat(wide, near, [{{'b': b, 'l': l}}]) as x from counts join wide using (host) join near using (host, template) left join pool using (host, template)),
        share as (select sum(b) / greatest(sum(l), 1) as share from counts),
        steps as (select host, template, list_concat([{{'b': share, 'l': 0::double}}], list_transform(range(1, len(x)), lambda i: {{'b': x[i].b - x[i + 1].b, 'l': x[i].l - x[i + 1].l}}), [coalesce(pool, own)]) as steps from nested, share),
        judged as (select host, template, list_reduce(steps, lambda p, x: {step}).b as purity from steps)
        select page_id, host, path, rule, coalesce(by_rule, case when purity >= {REJECT_FROM} then 'block' else 'allow' end) as verdict, template from ruled join tree using (host, path) join judged using (host, template)"""
