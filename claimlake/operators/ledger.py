"""Findings after they are made: coverage, baseline, order, summaries, fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.functions import text as T
from claimlake.session import materialise


def coverage(facts: DataFrame, mentioned: DataFrame, group: str = "grp", most: int | None = None) -> DataFrame:
    """(grp, total, documented, missing): facts of each group that no document mentions.

    ``facts``: grp, name, and optional ``alias`` (a second spelling that counts). ``mentioned``: name.
    """
    said = mentioned.select("name").where("name is not null").distinct()
    known = facts.select(group, "name", *(["alias"] if "alias" in facts.columns else [])).distinct()
    hit = known.join(said.withColumn("hit_name", F.lit(1)), "name", "left")
    documented = F.col("hit_name").isNotNull()
    if "alias" in facts.columns:
        hit = hit.join(said.select(F.col("name").alias("alias"), F.lit(1).alias("hit_alias")), "alias", "left")
        documented = documented | F.col("hit_alias").isNotNull()
    per_name = hit.groupBy(group, "name").agg(F.max(documented).alias("documented"))
    missing = F.array_sort(F.collect_list(F.when(~F.col("documented"), F.col("name"))))
    out = per_name.groupBy(group).agg(F.count("*").alias("total"), F.count_if("documented").alias("documented"), missing.alias("missing"))
    return out if most is None else out.withColumn("missing", F.slice("missing", 1, most))


def leaf_keys(keys: DataFrame, key: str = "key") -> DataFrame:
    """Configuration keys that no other key extends; neighbours in sorted order decide, without a self-join."""
    order = Window.partitionBy(F.split_part(F.col(key), F.lit("."), F.lit(1))).orderBy(F.concat(F.replace(F.col(key), F.lit("."), F.lit("\u0001")), F.lit("\u0001")))
    nxt = F.lead(key).over(order)
    return keys.select(key).distinct().withColumn("nxt", nxt).where(F.col("nxt").isNull() | ~F.startswith(F.col("nxt"), F.concat(F.col(key), F.lit(".")))).drop("nxt")


def route_coverage(routes: DataFrame, claims: DataFrame) -> DataFrame:
    """(method, path, documented): registered routes that some claimed route matches or ends with.

    Both sides carry ``segs``; claims may have a null method. They meet over the equal keys of :func:`claimlake.operators.resolve.match_routes`.
    """
    from claimlake.operators.resolve import match_routes

    r = routes.select("method", "path", "segs").distinct()
    c = claims.select(F.col("method").alias("c_method"), F.col("segs").alias("c_segs")).distinct()
    met = match_routes(c.select(F.col("c_segs").alias("segs")), r.select(F.col("segs").alias("reg"), "method"), names=True).join(c.withColumnRenamed("c_segs", "segs"), "segs")
    same_method = F.col("c_method").isNull() | F.col("method").isNull() | (F.col("c_method") == F.col("method"))
    said = met.where(same_method).select(F.col("reg").alias("segs"), F.coalesce("method", F.lit("")).alias("m"), F.lit(True).alias("hit")).distinct()
    hit = r.withColumn("m", F.coalesce("method", F.lit(""))).join(said, ["segs", "m"], "left")
    return hit.groupBy("method", "path").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("documented"))


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings with ``baselined``; identity is the fingerprint alone."""
    frozen = baseline.select("fingerprint").where("fingerprint is not null").distinct().withColumn("_frozen", F.lit(True))
    return findings.drop("baselined").join(frozen, "fingerprint", "left").withColumn("baselined", F.coalesce("_frozen", F.lit(False))).drop("_frozen")


def fixed_entries(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline entries that no finding has any more."""
    return baseline.join(findings.select("fingerprint").distinct(), "fingerprint", "left_anti")


def freeze(findings: DataFrame) -> DataFrame:
    """(fingerprint, rule, file, message): one entry per fingerprint, the first in report order."""
    first = Window.partitionBy("fingerprint").orderBy("file", "line", "col", "rule", "message")
    return findings.withColumn("n", F.row_number().over(first)).where("n = 1").select("fingerprint", "rule", "file", "message")


def report_order(severity: str = "severity") -> list[Column]:
    """Sort columns of every report: file, line, column, worst first, rule, message."""
    return [F.col("file"), F.col("line"), F.col("col"), F.desc(T.severity_rank(severity)), F.col("rule"), F.col("message")]


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``: the position in its group, from 1, in the order given.

    Rows are sorted by range; a place is the position within the range plus the sizes of the group's earlier ranges.
    So no group, however large, is ranked by one task.
    """
    spread = materialise(rows.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = spread.groupBy(group, "_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    ranked = spread.withColumn("_within", within).join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return ranked.withColumn("place", (F.col("_within") + F.col("_before")).cast("bigint")).drop("_range", "_within", "_g", "_r", "_before")


def summary(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(errors, warnings, infos, worst) over findings that are not baselined."""
    open_ = findings.where(~F.coalesce("baselined", F.lit(False)))
    counts = [F.count_if(F.lower("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")]
    return open_.groupBy(*(by or [])).agg(*counts, F.coalesce(F.max(T.severity_rank("severity")), F.lit(0)).alias("worst"))


def fails(findings: DataFrame, fail_on: str = "error") -> Column | DataFrame:
    """One row: whether an open finding reaches the threshold; ``none`` never fails."""
    least = {"error": 3, "warning": 2, "info": 1}.get((fail_on or "none").lower(), 99)
    return summary(findings).select((F.col("worst") >= least).alias("fails"))


def junit_cases(findings: DataFrame) -> DataFrame:
    """(file, rule, n, worst, skipped, lines): one test case per file and rule; skipped if all are baselined or mere notes."""
    return findings.groupBy("file", "rule").agg(
        F.count("*").alias("n"),
        F.max(T.severity_rank("severity")).alias("worst"),
        (F.bool_and(F.coalesce("baselined", F.lit(False))) | (F.max(T.severity_rank("severity")) <= 1)).alias("skipped"),
        F.array_sort(F.collect_list("line")).alias("lines"),
    )


def fix_plan(findings: DataFrame) -> DataFrame:
    """(file, line, col, old, new, rule): mechanical replacements of open findings, each place once, in order."""
    usable = findings.where(~F.coalesce("baselined", F.lit(False))).where("fix is not null and fix <> text and line > 0")
    first = Window.partitionBy("file", "line", "col", "text").orderBy("rule", "fix")
    one = usable.withColumn("n", F.row_number().over(first)).where("n = 1")
    return one.select("file", "line", "col", F.col("text").alias("old"), F.col("fix").alias("new"), "rule").orderBy("file", "line", "col", "old")


def mention_set(resolved: DataFrame) -> DataFrame:
    """(kind, norm): what documents claim and facts confirm; feeds coverage."""
    return resolved.where("status = 'ok'").select("kind", "norm").distinct()


def undocumented(covered: DataFrame, facts: DataFrame, severity: str = "info", group: str = "grp") -> DataFrame:
    """(rule, severity, grp, name, file, line): one finding per missing fact, with its location when known."""
    items = covered.select(group, F.explode("missing").alias("name"))
    where = facts.groupBy(group, "name").agg(F.min(F.struct("file", "line")).alias("w")).select(group, "name", "w.file", "w.line")
    return items.join(where, [group, "name"], "left").select(F.lit("undocumented").alias("rule"), F.lit(severity).alias("severity"), group, "name", "file", "line")
