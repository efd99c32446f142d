"""URL filters by a tree of path templates for each host.

All distinct (host, path) pairs, with how often they occur and how their pages
are labelled, are walked segment by segment, one level of every host's tree at
a time; what all paths of a node have in common is passed over in one step, so
there are as many steps as levels with branches, however long a path is.  A segment is generalised into a wildcard if its parent has many
children and it is a small part of them.  Sibling branches whose labels can't
be told from their siblings' by a two-proportion test are merged.  The paths
that end in one template share a smoothed share of bad labels, and a template
whose share reaches the threshold is rejected.

Counts are aggregated before every shuffle, so a host that has a third of all
pages costs its distinct segments, and joins are by whole tree nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm._frames import table, written

#: A wildcard's parent has at least so many children, and it holds at most so much of the parent.
KIDS, PART = 8, 0.1
#: Branches whose z score is smaller are alike.
ALIKE = 1.96
#: Labels that the overall share weighs in a template's share, and the share that rejects it.
PRIOR, REJECT = 4.0, 0.5

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _past_common(rows: DataFrame) -> DataFrame:
    """The open rows moved past the segments that all open rows of their node start with.  An only
    child is never a wildcard and has no siblings to be like, so these segments stand in the template."""
    rest = F.slice("parts", F.col("at") + 1, F.size("parts"))
    # the common start of a node's paths is that of the least and the greatest
    nodes = rows.groupBy("host", "template").agg(F.min(rest).alias("lo"), F.max(rest).alias("hi"))
    same = F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y))
    common = F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size("lo")).cast("int")
    moved = rows.join(nodes.select("host", "template", common.alias("common")), ["host", "template"])
    passed = F.when(F.col("common") > 0, F.concat("template", F.lit("/"), F.array_join(F.slice("parts", F.col("at") + 1, F.col("common")), "/"))).otherwise(F.col("template"))
    return moved.withColumns({"template": passed, "at": F.col("at") + F.col("common")}).drop("common")


def templates(pages: DataFrame) -> DataFrame:
    """(host, path, template, n, labelled, bad, share) of each distinct pair.

    `pages` has host, path and bad (true, false, or null without a label).
    Template segments: `*` a wildcard, `#` one of digits (an extension may
    follow), `~` merged branches, else the segment itself.
    """
    rows = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    parts = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    # `at` is the number of segments that are in the template, the same for all rows of a node
    rows = written(rows.withColumns({"parts": parts, "template": F.lit(""), "at": F.lit(0)}))
    total = rows.agg(F.sum("bad"), F.sum("labelled")).first()
    overall = (total[0] or 0) / total[1] if total[1] else 0.0
    done, is_open = [], F.col("at") < F.size("parts")
    while not rows.where(is_open).isEmpty():
        done.append(rows.where(~is_open))
        rows = _past_common(rows.where(is_open))
        here = F.get("parts", F.col("at")).alias("segment")
        children = rows.where(is_open).groupBy("host", "template", here).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        parents = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kids"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")])
        judged = children.join(parents, ["host", "template"])
        wild = (F.col("kids") >= KIDS) & (F.col("n") <= F.col("all_n") * PART)
        rest, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        pooled = F.try_divide(F.col("all_bad").cast("double"), F.col("all_labelled").cast("double"))
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("labelled").cast("double")) + F.try_divide(F.lit(1.0), rest.cast("double"))))
        z = F.try_divide(F.try_divide(F.col("bad").cast("double"), F.col("labelled").cast("double")) - F.try_divide(rest_bad.cast("double"), rest.cast("double")), spread)
        alike = (F.col("kids") > 1) & (F.coalesce(F.abs(z), F.lit(0.0)) < ALIKE)
        number = F.col("segment").rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$")
        token = F.when(wild, F.when(number, "#").otherwise("*")).when(alike, "~").otherwise(F.col("segment"))
        judged = judged.select("host", "template", "segment", token.alias("token"))
        deep = rows.withColumn("segment", here)
        deep = deep.join(judged, ["host", "template", "segment"], "left")
        further = {"template": F.when(F.col("token").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "token")), "at": F.col("at") + F.col("token").isNotNull().cast("int")}
        rows = written(deep.withColumns(further).select(rows.columns))
    for part in done:
        rows = rows.unionByName(part)
    ends = rows.groupBy("host", "template").agg(F.sum("labelled").alias("end_labelled"), F.sum("bad").alias("end_bad"))
    share = (F.col("end_bad") + F.lit(PRIOR * overall)) / (F.col("end_labelled") + F.lit(PRIOR))
    return rows.join(ends, ["host", "template"]).select("host", "path", "template", "n", "labelled", "bad", share.alias("share"))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, share of each page.

    A page's label is `quality` of the label row with its id: 0 is bad; of
    conflicting labels the least counts.  Urls that are null or lack `://` have
    an empty host and path, and form the tree of the empty host.  Repeated rows
    are judged alike and count as often as they occur.  Without any labels all
    shares are 0 and the method allows everything.  Other columns are ignored.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("bad"))
    plain = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    tree = written(templates(plain.join(known, "page_id", "left").select("host", "path", "bad")).select("host", "path", "template", "share"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("share") >= REJECT, "block").otherwise("allow")
    return plain.join(tree, ["host", "path"]).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "template", "share")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def brute(pages, labels):
    """[(page_id, host, path, rule, verdict, template)] in plain Python, for tests."""
    import math
    import re
    from collections import defaultdict

    bad = {}
    for d, q in labels:
        if d is not None and q is not None:
            bad[d] = bad.get(d, False) or q == min(x for e, x in labels if e == d and x is not None) == 0
    flat = []
    for i, u in pages:
        m = re.match(_URL, u or "")
        flat.append((i, "".join(c.lower() if c in _UPPER else c for c in m[1]) if m else "", m[2] if m else ""))
    stats = defaultdict(lambda: [0, 0, 0])
    for i, h, p in flat:
        s = stats[h, p]
        s[0] += 1
        s[1] += i in bad
        s[2] += bad.get(i, False)
    tmpl, parts = {}, {}
    for h, p in stats:
        parts[h, p] = re.sub("^/", "", p).split("/")
        tmpl[h, p] = ""
    lab, tot = sum(s[1] for s in stats.values()), sum(s[2] for s in stats.values())
    overall = tot / lab if lab else 0.0
    for level in range(max(map(len, parts.values()), default=0)):
        kids = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for k, x in parts.items():
            if len(x) > level:
                for j in range(3):
                    kids[k[0], tmpl[k]][x[level]][j] += stats[k][j]
        token = {}
        for node, own in kids.items():
            a = [sum(v[j] for v in own.values()) for j in range(3)]
            for seg, (n, m, b) in own.items():
                z = 0.0
                if m and a[1] - m and 0 < a[2] < a[1]:
                    q = a[2] / a[1]
                    z = abs(b / m - (a[2] - b) / (a[1] - m)) / math.sqrt(q * (1 - q) * (1 / m + 1 / (a[1] - m)))
                if len(own) >= KIDS and n <= a[0] * PART:
                    t = "#" if re.match(r"^[0-9]+(\.[A-Za-z0-9]+)?$", seg) else "*"
                else:
                    t = "~" if len(own) > 1 and z < ALIKE else seg
                token[node, seg] = t
        for k, x in parts.items():
            if len(x) > level:
                tmpl[k] += "/" + token[(k[0], tmpl[k]), x[level]]
    ends = defaultdict(lambda: [0, 0])
    for k, s in stats.items():
        ends[k[0], tmpl[k]][0] += s[1]
        ends[k[0], tmpl[k]][1] += s[2]
    out = []
    for i, h, p in flat:
        best = max((r for r in RULES if (h == r[0].split("/")[0] or h.endswith("." + r[0].split("/")[0])) and p.startswith("/" + r[0].split("/", 1)[1])), key=lambda r: len(r[0]), default=None)
        e = ends[h, tmpl[h, p]]
        own = "block" if (e[1] + PRIOR * overall) / (e[0] + PRIOR) >= REJECT else "allow"
        out.append((i, h, p, best[0] if best else None, best[1] if best else own, tmpl[h, p]))
    return out
