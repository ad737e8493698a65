"""URL filter on a path-template tree, in DataFrame operations only.

Every host has a tree of path segments. Going down level by level, a node whose children are mostly different from
page to page is a variable: its segments become one wildcard. Pages that a rule decides are labels. A branch whose
share of blocked labels does not differ significantly from what stands above it is merged into that, so its estimate
comes from more labels. A template is rejected when the smoothed purity of its estimate, (blocked + 1) / (labels + 2),
reaches a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.rows import landed, lowered, table

# The rules of the contract
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
# Levels of the tree; the last holds the rest of the path
LEVELS = 4
# A node is a variable from this many different children, if they are at least half as many as its pages
CHILDREN = 8
# Squared deviations (1.96 standard errors) up to which a branch is merged
SIMILAR = 3.8416
PURITY = 0.8
# Parts that pages of one host or template are dealt to
SPREAD = 16


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host in lower case, both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return lowered(host), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and starts the path; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _parted(rows: DataFrame) -> DataFrame:
    """One row for each part that rows of the same key are dealt to."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))


def templates(pages: DataFrame) -> DataFrame:
    """Adds t0 .. tN to (host, path, part, ...): the template down to each level, t0 being the root."""
    names = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = pages.withColumn("segments", names).withColumn("t0", F.lit(""))
    for level in range(1, LEVELS + 1):
        segment = F.get("segments", F.lit(level - 1))
        if level == LEVELS:
            tail = F.array_join(F.slice("segments", level, F.greatest(F.size("segments"), F.lit(1))), "/")
            segment = F.when(segment.isNotNull(), tail)
        above, here = f"t{level - 1}", f"t{level}"
        rows = rows.withColumn("segment", segment)
        children = rows.where("segment IS NOT NULL").groupBy("host", above, "segment").agg(F.count(F.lit(1)).alias("n"))
        nodes = children.groupBy("host", above).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
        variable = _parted(nodes.where((F.col("kinds") >= CHILDREN) & (2 * F.col("kinds") >= F.col("n"))).select("host", above, F.lit(True).alias("variable")))
        rows = rows.join(variable, ["host", above, "part"], "left")
        step = F.when(F.col("variable"), "/*").otherwise(F.concat(F.lit("/"), "segment"))
        rows = rows.withColumn(here, F.when(F.col("segment").isNull(), F.col(above)).otherwise(F.concat(above, step))).drop("variable", "segment")
    return rows.drop("segments")


def rejected_templates(rows: DataFrame) -> DataFrame:
    """(host, template) of the templates to reject, from rows with host, t0 .. tN and label (1 blocked, 0 allowed)."""
    steps = [f"t{i}" for i in range(LEVELS + 1)]
    leaf = rows.groupBy("host", *steps).agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("b"))
    leaf = landed(leaf, "url-templates")
    total = leaf.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    found = leaf.drop("n", "b").withColumns({"n": F.lit(total[0]).cast("double"), "b": F.lit(total[1]).cast("double")})
    for step in steps:
        own = leaf.groupBy("host", step).agg(F.sum("n").cast("double").alias("own_n"), F.sum("b").cast("double").alias("own_b"))
        found = found.join(own, ["host", step])
        gap = F.col("own_b") * F.col("n") - F.col("b") * F.col("own_n")
        differs = gap * gap > SIMILAR * F.col("b") * (F.col("n") - F.col("b")) * F.col("own_n")
        found = found.withColumn("differs", differs)
        for c in ("n", "b"):
            found = found.withColumn(f"new_{c}", F.when(F.col("differs"), F.col(f"own_{c}")).otherwise(F.col(c)))
        found = found.drop("n", "b", "own_n", "own_b", "differs").withColumnsRenamed({"new_n": "n", "new_b": "b"})
    return found.where((F.col("b") + 1) / (F.col("n") + 2) >= PURITY).select("host", F.col(steps[-1]).alias("template"))


def judge(pages: DataFrame, rules=RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every row of ``pages``.

    A rule decides alone; elsewhere the page is blocked if its template is rejected. A null url or one without
    ``://`` has empty host and path and is judged like any other. Repeated rows get equal results; an empty table
    gives no rows; further columns, whatever their names, are not read. Rules of equal length cannot both fit one
    page unless they are the same.
    """
    host, path = split_url(F.col(f"`{url}`"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule, "says": says})
    rows = rows.withColumn("label", F.when(F.col("says") == "block", 1).when(F.col("says") == "allow", 0))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "path"), F.lit(SPREAD)).cast("int"))
    rows = landed(templates(rows), "url-pages")
    rejected = _parted(rejected_templates(rows).withColumn("reject", F.lit(True)))
    rows = rows.withColumn("template", F.col(f"t{LEVELS}")).join(rejected, ["host", "template", "part"], "left")
    method = F.when(F.col("reject"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"), "template")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    by_length = sorted(RULES, key=lambda r: -len(r[0]))

    def fits(text: str) -> str:
        name, slash, start = text.partition("/")
        return f"(host = '{name}' OR suffix(host, '.{name}')) AND starts_with(path, '{slash + start}')"

    rule = " ".join(f"WHEN {fits(t)} THEN '{t}'" for t, _ in by_length)
    label = " ".join(f"WHEN {fits(t)} THEN {int(v == 'block')}" for t, v in by_length)
    ctes = [
        "u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u)",
        "p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, "
        "regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)",
        f"r0 AS (SELECT *, CASE {rule} END AS rule, CASE {label} END AS label, "
        "list_filter(string_split(path, '/'), lambda x: x <> '') AS s, '' AS t0 FROM p)",
    ]
    for level in range(1, LEVELS + 1):
        segment = f"s[{level}]" if level < LEVELS else f"CASE WHEN len(s) >= {level} THEN array_to_string(s[{level}:], '/') END"
        above = f"t{level - 1}"
        ctes += [
            f"g{level} AS (SELECT *, {segment} AS seg FROM r{level - 1})",
            f"v{level} AS (SELECT host, {above}, count(DISTINCT seg) >= {CHILDREN} AND 2 * count(DISTINCT seg) >= count(seg) AS variable "
            f"FROM g{level} WHERE seg IS NOT NULL GROUP BY ALL)",
            f"r{level} AS (SELECT g.* EXCLUDE (seg), CASE WHEN seg IS NULL THEN {above} WHEN variable THEN {above} || '/*' "
            f"ELSE {above} || '/' || seg END AS t{level} FROM g{level} g LEFT JOIN v{level} USING (host, {above}))",
        ]
    last = f"r{LEVELS}"
    ctes.append(f"e AS (SELECT *, (count(label) OVER ())::DOUBLE AS n, (coalesce(sum(label) OVER (), 0))::DOUBLE AS b FROM {last})")
    source = "e"
    for level in range(LEVELS + 1):
        ctes += [
            f"o{level} AS (SELECT *, (count(label) OVER w)::DOUBLE AS on_, (coalesce(sum(label) OVER w, 0))::DOUBLE AS ob FROM {source} "
            f"WINDOW w AS (PARTITION BY host, t{level}))",
            f"e{level} AS (SELECT * EXCLUDE (n, b, on_, ob), CASE WHEN d THEN on_ ELSE n END AS n, CASE WHEN d THEN ob ELSE b END AS b FROM "
            f"(SELECT *, (ob * n - b * on_) * (ob * n - b * on_) > {SIMILAR}::DOUBLE * b * (n - b) * on_ AS d FROM o{level}) x)",
        ]
        ctes[-1] = ctes[-1].replace("(n, b, on_, ob)", "(n, b, on_, ob, d)")
        source = f"e{level}"
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT page_id, host, path, rule, CASE WHEN label = 1 THEN 'block' WHEN label = 0 THEN 'allow' "
        f"WHEN (b + 1) / (n + 2) >= {PURITY}::DOUBLE THEN 'block' ELSE 'allow' END AS verdict FROM {source}"
    )


QUERIES = {"op9_url_filter": op9_url_filter}
SQL = {"op9_url_filter": _sql()}
