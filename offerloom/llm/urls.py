"""URL filtering by explicit rules and, where none fits, by a tree of path templates, with DataFrame operations only.

The paths of a host form a tree of segments, however deep. A level is variable where the pages under one parent have nearly as many different
segments as there are pages, on the host itself or on all hosts that have such a parent: its segments become wildcards, and the tree is
looked at again, since branches that fall together have more pages. What the rules decide labels the pages they fit. Sibling branches of a host whose
share of blocked pages can't be told from their parent's by a test are one branch, those above it another, and those below it a third.

A template's purity is the share of blocked pages in its branch, smoothed towards that of the same template on all sites of the top-level
domain, which is smoothed towards that on all sites, and that towards the share of all labelled pages. Each counts at the deepest place of the path that has labels.
So a page without rule is judged by branches of its own host where there are labels, and by like templates elsewhere where there are none. What a template is
elsewhere counts by sites (the last two labels of a host), each by the share of its labelled pages, and only where several sites have labels: one site's rule says nothing about another site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The last two labels of a host, without its port
SITE = r"([^.:]*[.]?[^.:]*)(:[0-9]*)?$"
#: (verdict, host and path prefix)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: then up to ``? #``. Both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the last by text) and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, under = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{under}"))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _levels(paths: DataFrame) -> DataFrame:
    """``(host, raw, k, parent, child, n)``: each segment of each template ``t``, with what stands before it; ``k`` counts from 0."""
    rows = paths.select("host", "raw", "n", "t", F.posexplode("t").alias("k", "child"))
    return rows.select("host", "raw", "k", F.array_join(F.slice("t", F.lit(1), F.col("k")), "/").alias("parent"), "child", "n")


def _variable(levels: DataFrame, keys: list[str], kids: int) -> DataFrame:
    """The parents ``keys`` under which at least ``kids`` different segments stand, and half as many as there are pages."""
    children = levels.groupBy(*keys, "child").agg(F.sum("n").alias("n"))
    return children.groupBy(*keys).agg(F.count("*").alias("c"), F.sum("n").alias("n")).filter((F.col("c") >= kids) & (F.col("c") * 2 >= F.col("n"))).select(*keys)


def templates(paths: DataFrame, kids: int, held: Scratch) -> DataFrame:
    """``paths(host, raw, n, b, m, t)`` with the variable segments of ``t`` as ``*``. Looked at again until no segment changes: each time one does for good, so paths bound the rounds."""
    while True:
        levels = held(_levels(paths), "levels")
        own = _variable(levels, ["host", "parent"], kids).withColumn("own", F.lit(True))
        shared = _variable(levels, ["parent"], kids).withColumn("shared", F.lit(True))
        marked = levels.join(own, ["host", "parent"], "left").join(shared, "parent", "left")
        changed = held(marked.filter("(own OR shared) AND child <> '*'").select("host", "raw", "k"), "changed")
        if changed.isEmpty():
            return paths
        new = changed.groupBy("host", "raw").agg(F.collect_set("k").alias("stars"))  # some of a path's segments
        joined = paths.join(new, ["host", "raw"], "left")
        t = F.when(F.col("stars").isNull(), F.col("t")).otherwise(F.transform("t", lambda x, k: F.when(F.array_contains("stars", k), "*").otherwise(x)))
        paths = held(joined.select("host", "raw", "n", "b", "m", t.alias("t")), "templates")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, kids: int = 8, sites: int = 3, z: float = 1.64, smooth: float = 2.0, reject: float = 0.8) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, template, purity, scope``.

    ``verdict`` is the rule's where one fits, else ``block`` if ``purity`` reaches ``reject``, else ``allow``. ``scope`` says whose labels the purity
    rests on: ``host``, ``domain`` (its top-level domain) or ``all``; null where only the share of all labelled pages is left. Without any labelled page purity is null too. Labels of
    fewer than ``sites`` sites don't count elsewhere. Only ``page_id`` and ``url`` are read. A null url has an empty host and path. An empty table gives none.
    Statistics cover all pages; rows that repeat each count. Of rules of one length that fit the last by text wins.
    """
    held = Scratch()
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = rows.withColumns({"rule": rule, "says": says, "raw": F.array_join(parts, "/")})

    paths = rows.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count_if(F.col("says") == "block").alias("b"), F.count("says").alias("m"))
    paths = held(paths.withColumn("t", F.filter(F.split("raw", "/"), lambda x: x != "")), "paths")
    total = paths.agg(F.sum("b"), F.sum("m")).first()
    prior = F.lit(total[0] / total[1] if total[1] else None).cast("double")
    paths = templates(paths, kids, held)

    domain = F.regexp_extract("host", r"([^.:]*)(:[0-9]*)?$", 1)
    site = F.regexp_extract("host", SITE, 1)
    deep = paths.select("host", "raw", "b", "m", domain.alias("domain"), site.alias("site"), "t", F.explode(F.sequence(F.lit(0), F.size("t"))).alias("k"))
    node = lambda k: F.array_join(F.slice("t", F.lit(1), k), "/")
    deep = held(deep.select("host", "raw", "b", "m", "domain", "site", "k", node(F.col("k")).alias("node"), node(F.greatest(F.col("k") - 1, F.lit(0))).alias("up")), "nodes")
    sums = lambda df, *keys: df.filter("m > 0").groupBy(*keys).agg(F.sum("b").alias("nb"), F.sum("m").alias("nm"))

    # branches of a host: those that can't be told from their parent, those above and those below it
    own = sums(deep.filter("k > 0"), "host", "up", "node")
    parent = own.groupBy("host", "up").agg((F.sum("nb") / F.sum("nm")).alias("rate"))
    gap, width = F.col("nb") / F.col("nm") - F.col("rate"), z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("nm"))
    own = own.join(parent, ["host", "up"]).withColumn("lean", F.when(gap > width, 1).when(-gap > width, -1).otherwise(0))
    pooled = own.groupBy("host", "up", "lean").agg(F.sum("nb").alias("hb"), F.sum("nm").alias("hm"))
    by_host = own.join(pooled, ["host", "up", "lean"]).select("host", "node", "hb", "hm")
    # whole millionths, so that sums don't depend on their order
    each = held(sums(deep.filter("k > 0"), "domain", "site", "node").select("domain", "node", F.round(F.col("nb") / F.col("nm") * 1e6).cast("long").alias("share")), "sites")
    elsewhere = lambda *keys: each.groupBy(*keys).agg((F.sum("share") / 1e6).alias("b"), F.count("*").alias("m")).filter(F.col("m") >= sites)
    by_domain = elsewhere("domain", "node").toDF("domain", "node", "db", "dm")
    by_all = elsewhere("node").toDF("node", "ab", "am")

    found = deep.join(by_host, ["host", "node"], "left").join(by_domain, ["domain", "node"], "left").join(by_all, "node", "left")
    deepest = lambda b, m: F.max_by(F.when(F.col(m) > 0, F.struct(b, m)), F.when(F.col(m) > 0, F.col("k")))
    last = F.max_by("node", "k").alias("template")
    found = found.groupBy("host", "raw").agg(deepest("hb", "hm").alias("h"), deepest("db", "dm").alias("d"), deepest("ab", "am").alias("a"), last)
    toward = lambda b, m, wide: F.when(F.col(m) > 0, (F.col(b) + smooth * wide) / (F.col(m) + smooth)).otherwise(wide)
    purity = toward("h.hb", "h.hm", toward("d.db", "d.dm", toward("a.ab", "a.am", prior)))
    scope = F.when(F.col("h").isNotNull(), "host").when(F.col("d").isNotNull(), "domain").when(F.col("a").isNotNull(), "all")
    verdicts = durable(found.select("host", "raw", F.concat(F.lit("/"), "template").alias("template"), purity.alias("purity"), scope.alias("scope")), "verdicts")
    held.drop()
    says = F.coalesce("says", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return rows.join(verdicts, ["host", "raw"]).select("page_id", "host", "path", "rule", says.alias("verdict"), "template", "purity", "scope")


def judge_sql(rules: tuple[tuple[str, str], ...] = RULES, kids: int = 8, sites: int = 3, z: float = 1.64, smooth: float = 2.0, reject: float = 0.8, rounds: int = 6) -> str:
    """The same in DuckDB SQL, which can't go on until nothing changes: its ``rounds`` are more than the driver's tables need."""
    listed = ", ".join(f"('{v}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}', '{t}')" for v, t in rules)
    steps = ""
    for r in range(1, rounds + 1):
        many = f"HAVING count(*) >= {kids} AND count(*) * 2 >= sum(n)"
        steps += f"""
e{r} AS (SELECT host, raw, k, array_to_string(t[1:k - 1], '/') AS parent, t[k] AS child, n FROM (SELECT *, unnest(range(1, len(t) + 1)) AS k FROM p{r - 1})),
o{r} AS (SELECT host, parent FROM (SELECT host, parent, child, sum(n) AS n FROM e{r} GROUP BY ALL) GROUP BY host, parent {many}),
s{r} AS (SELECT parent FROM (SELECT parent, child, sum(n) AS n FROM e{r} GROUP BY ALL) GROUP BY parent {many}),
w{r} AS (SELECT e.host, e.raw, list(CASE WHEN o.parent IS NOT NULL OR s.parent IS NOT NULL THEN '*' ELSE child END ORDER BY k) AS t
  FROM e{r} e LEFT JOIN o{r} o ON o.host = e.host AND o.parent = e.parent LEFT JOIN s{r} s ON s.parent = e.parent GROUP BY e.host, e.raw),
p{r} AS (SELECT p.host, p.raw, p.n, p.b, p.m, coalesce(w.t, p.t) AS t FROM p{r - 1} p LEFT JOIN w{r} w USING (host, raw)),"""
    toward = lambda b, m, wide: f"CASE WHEN {m} > 0 THEN ({b} + {smooth}::DOUBLE * {wide}) / ({m} + {smooth}::DOUBLE) ELSE {wide} END"
    purity = toward("h.b", "h.m", "(" + toward("d.b", "d.m", "(" + toward("a.b", "a.m", "prior") + ")") + ")")
    deepest = lambda b, m: f"max_by({{'b': {b}, 'm': {m}}}, k) FILTER ({m} > 0)"
    return rf"""
WITH rules(says, rhost, rpath, rule) AS (VALUES {listed}),
split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
ruled AS (
  SELECT p.*, (SELECT struct_pack(rule := r.rule, says := r.says) FROM rules r
               WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
               ORDER BY length(r.rule) DESC, r.rule DESC LIMIT 1) AS r,
         list_filter(string_split(p.path, '/'), lambda x: x <> '') AS s
  FROM parts p),
marked AS (SELECT page_id, host, path, r.rule AS rule, r.says AS says, s, array_to_string(s, '/') AS raw FROM ruled),
p0 AS (SELECT host, raw, s AS t, count(*) AS n, count(*) FILTER (says = 'block') AS b, count(says) AS m FROM marked GROUP BY ALL),{steps}
nodes AS (
  SELECT host, raw, b, m, regexp_extract(host, '([^.:]*)(:[0-9]*)?$', 1) AS domain, regexp_extract(host, '{SITE}', 1) AS site, k, array_to_string(t[1:k], '/') AS node, array_to_string(t[1:greatest(k - 1, 0)], '/') AS up
  FROM (SELECT *, unnest(range(0, len(t) + 1)) AS k FROM p{rounds})),
own AS (SELECT host, up, node, sum(b) AS nb, sum(m) AS nm FROM nodes WHERE k > 0 AND m > 0 GROUP BY ALL),
leant AS (
  SELECT *, CASE WHEN nb / nm - rate > width THEN 1 WHEN rate - nb / nm > width THEN -1 ELSE 0 END AS lean
  FROM (SELECT *, {z}::DOUBLE * sqrt(rate * (1 - rate) / nm) AS width FROM (SELECT *, sum(nb) OVER (PARTITION BY host, up) / sum(nm) OVER (PARTITION BY host, up) AS rate FROM own))),
by_host AS (SELECT host, node, sum(nb) OVER same AS hb, sum(nm) OVER same AS hm FROM leant WINDOW same AS (PARTITION BY host, up, lean)),
each AS (SELECT domain, node, round(sum(b) / sum(m) * 1e6)::BIGINT AS share FROM nodes WHERE k > 0 AND m > 0 GROUP BY domain, site, node),
by_domain AS (SELECT domain, node, sum(share)::BIGINT / 1e6 AS db, count(*) AS dm FROM each GROUP BY domain, node HAVING count(*) >= {sites}),
by_all AS (SELECT node, sum(share)::BIGINT / 1e6 AS ab, count(*) AS am FROM each GROUP BY node HAVING count(*) >= {sites}),
found AS (
  SELECT host, raw, {deepest("hb", "hm")} AS h, {deepest("db", "dm")} AS d, {deepest("ab", "am")} AS a, max_by(node, k) AS template
  FROM nodes LEFT JOIN by_host USING (host, node) LEFT JOIN by_domain USING (domain, node) LEFT JOIN by_all USING (node) GROUP BY host, raw),
verdicts AS (
  SELECT host, raw, '/' || template AS template, {purity} AS purity, CASE WHEN h IS NOT NULL THEN 'host' WHEN d IS NOT NULL THEN 'domain' WHEN a IS NOT NULL THEN 'all' END AS scope
  FROM found, (SELECT sum(b)::DOUBLE / nullif(sum(m), 0) AS prior FROM p0))
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN purity >= {reject} THEN 'block' ELSE 'allow' END) AS verdict, template, purity, scope
FROM marked JOIN verdicts USING (host, raw)"""
