"""Staleness: text that was last touched before the things it describes.

Inputs are small tables of version control: ``blame`` (file, line, hash, ts; ts null for an
uncommitted line) and ``commits`` (file, hash, ts, subject). All steps are equi-joins on the file
with range conditions on lines and times, then aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlake.session import materialise


def section_times(ranges: DataFrame, blame: DataFrame) -> DataFrame:
    """(path, title, start_line, end_line, edited): the newest line of a section; none if a line is missing or uncommitted."""
    b = blame.select(F.col("file").alias("path"), "line", "ts")
    joined = ranges.join(b, "path").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    grouped = joined.groupBy("path", "title", "start_line", "end_line").agg(F.max("ts").alias("edited"), F.count("ts").alias("n"))
    return grouped.where("n = end_line - start_line + 1").drop("n")


def section_files(ranges: DataFrame, refs: DataFrame) -> DataFrame:
    """(path, title, start_line, file): distinct files that a section's claims resolved to. ``refs``: path, line, file."""
    r = refs.select("path", "line", "file").where("file is not null")
    return ranges.join(r, "path").where(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("path", "title", "start_line", "file").distinct()


def stale(churn: DataFrame, min_churn: int = 3, min_days: int = 90) -> DataFrame:
    """Rows whose files changed often enough, or once but long after the edit. ``churn``: edited, n_commits, latest."""
    late = F.unix_timestamp("latest") - F.unix_timestamp("edited") >= min_days * 86_400
    return churn.where((F.col("n_commits") >= min_churn) | ((F.col("n_commits") >= 1) & late))


def section_churn(times: DataFrame, files: DataFrame, commits: DataFrame) -> DataFrame:
    """(path, title, start_line, file, edited, n_commits, latest): commits of a section's files after its last edit."""
    newer = files.join(times.select("path", "title", "start_line", "edited"), ["path", "title", "start_line"]).join(commits.select("file", "hash", "ts"), "file").where("ts > edited")
    return newer.groupBy("path", "title", "start_line", "file", "edited").agg(F.count_distinct("hash").alias("n_commits"), F.max("ts").alias("latest"))


def body_churn(times: DataFrame, symbols: DataFrame, blame: DataFrame) -> DataFrame:
    """(path, title, start_line, full_name, edited, n_commits, latest): newer commits among the lines of referenced bodies.

    ``symbols``: path, title, start_line, full_name, file, body_start, body_end.
    """
    b = blame.select("file", F.col("line").alias("b_line"), "hash", "ts")
    inside = symbols.join(times.select("path", "title", "start_line", "edited"), ["path", "title", "start_line"]).join(b, "file")
    newer = inside.where(F.col("b_line").between(F.col("body_start"), F.col("body_end")) & (F.col("ts") > F.col("edited")))
    return newer.groupBy("path", "title", "start_line", "full_name", "edited").agg(F.count_distinct("hash").alias("n_commits"), F.max("ts").alias("latest"))


def stale_findings(times: DataFrame, files: DataFrame, commits: DataFrame, symbols: DataFrame | None = None, blame: DataFrame | None = None, **limits: int) -> DataFrame:
    """(rule, path, title, start_line, what, n_commits, latest): stale symbols, and stale sections without one."""
    where = ["path", "title", "start_line"]
    by_file = stale(section_churn(times, files, commits), **limits)
    worst = F.struct(F.col("n_commits"), F.col("latest"), F.col("file"))
    sections = by_file.groupBy(*where).agg(F.max(worst).alias("w")).select(F.lit("stale-section").alias("rule"), *where, F.col("w.file").alias("what"), F.col("w.n_commits").alias("n_commits"), F.col("w.latest").alias("latest"))
    if symbols is None or blame is None:
        return sections
    by_symbol = stale(body_churn(times, symbols, blame), **limits).select(F.lit("stale-symbol").alias("rule"), *where, F.col("full_name").alias("what"), "n_commits", "latest")
    return by_symbol.unionByName(sections.join(by_symbol.select(*where).distinct(), where, "left_anti"))


def stale_comments(spans: DataFrame, blame: DataFrame, min_commits: int = 2, min_share: float = 0.5) -> DataFrame:
    """(file, full_name, decl_line, newer_lines, body_lines, n_commits): bodies changed after their comments.

    ``spans``: file, full_name, decl_line, doc_start, doc_end, body_start, body_end. A span with an uncommitted
    or missing line is skipped; spans of one declaration or one comment count once.
    """
    first = Window.partitionBy("file", "decl_line").orderBy("full_name", "doc_start")
    once = spans.where("doc_start > 0 and doc_end >= doc_start and body_end >= body_start").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    again = Window.partitionBy("file", "doc_start", "doc_end").orderBy("decl_line", "full_name")
    once = once.withColumn("n", F.row_number().over(again)).where("n = 1").drop("n")
    b = blame.select("file", "line", "hash", "ts")
    keys = ["file", "full_name", "decl_line", "doc_start", "doc_end", "body_start", "body_end"]
    lines = once.select(*keys).join(b, "file").where((F.col("line").between(F.col("doc_start"), F.col("doc_end"))) | (F.col("line").between(F.col("body_start"), F.col("body_end"))))
    in_doc = F.col("line").between(F.col("doc_start"), F.col("doc_end"))
    doc = lines.where(in_doc).groupBy(*keys).agg(F.max("ts").alias("written"), F.count("ts").alias("n_doc")).where("n_doc = doc_end - doc_start + 1")
    body = lines.where(~in_doc).join(doc.select(*keys, "written"), keys)
    grouped = body.groupBy(*keys).agg(
        F.count("ts").alias("n_known"), F.count("*").alias("body_lines"), F.count_if(F.col("ts") > F.col("written")).alias("newer_lines"), F.count_distinct(F.when(F.col("ts") > F.col("written"), F.col("hash"))).alias("n_commits")
    )
    due = (F.col("n_commits") >= min_commits) | (F.col("newer_lines") / F.col("body_lines") >= min_share)
    return grouped.where("n_known = body_lines").where(due & (F.col("newer_lines") > 0)).select("file", "full_name", "decl_line", "newer_lines", "body_lines", "n_commits")


def collapse_renames(renames: DataFrame) -> DataFrame:
    """(old, new): chains of renames followed to their end, however long; the newest rename of a name wins.

    ``renames``: old, new, ts. Pointer jumping: the longest chain halves with every join, so as many joins as the
    number of renames has binary digits reach every end; cycles stop.
    """
    first = Window.partitionBy("old").orderBy(F.desc("ts"), "new")
    step = renames.withColumn("n", F.row_number().over(first)).where("n = 1 and old <> new").select("old", "new")
    step = materialise(step, "renames")
    for _ in range(step.count().bit_length()):
        nxt = step.select(F.col("old").alias("mid"), F.col("new").alias("far"))
        step = step.join(nxt, F.col("new") == F.col("mid"), "left").select("old", F.when(F.col("far").isNull() | (F.col("far") == F.col("old")), F.col("new")).otherwise(F.col("far")).alias("new"))
    return step


def changed_only(rows: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """Rows of changed documents, by a semi-join placed before the expensive steps."""
    return rows.join(changed.select(F.col("path").alias(key)).distinct(), key, "left_semi")


def run_lengths(blame: DataFrame, key: str = "file", order: str = "line", value: str = "hash") -> DataFrame:
    """(key, value, first, last, n): neighbouring rows of one value folded (gaps and islands)."""
    a, b = Window.partitionBy(key).orderBy(order), Window.partitionBy(key, value).orderBy(order)
    island = blame.withColumn("island", F.row_number().over(a) - F.row_number().over(b))
    return island.groupBy(key, value, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("island")


def drop_mates(refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """References that do not point to the document's own translation or source. ``refs``: path, file."""
    mates = pairs.select(F.col("source").alias("path"), F.col("translation").alias("file")).unionByName(pairs.select(F.col("translation").alias("path"), F.col("source").alias("file")))
    return refs.join(mates.distinct(), ["path", "file"], "left_anti")
