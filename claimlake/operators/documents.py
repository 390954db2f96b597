"""Structure of documents as windows and joins over line and token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.functions import text as T


def explode_lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, text): one row per line, lines from 1."""
    return documents.where(F.col(text).isNotNull()).select(key, F.posexplode(T.lines_of(text)).alias("pos", "text")).select(key, (F.col("pos") + 1).alias("line"), "text")


_FENCE = "^ {0,3}(`{3,}|~{3,})(.*)$"


def fence_blocks(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, block, start_line, end_line, lang): fenced blocks; ``end_line`` is null where a fence is never closed.

    A fence closes with at least as many of its own marks and nothing else; marks inside a block are text, so
    is a line of backquotes with another one behind them. Only the marked lines of a page meet in one row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mark, info = F.regexp_extract(text, _FENCE, 1), F.regexp_replace(F.regexp_extract(text, _FENCE, 2), "^\\s+|\\s+$", "")
    seen = lines.where(text.rlike(_FENCE)).select(key, F.struct(
        F.col("line").cast("int").alias("line"), F.substring(mark, 1, 1).alias("ch"), F.length(mark).alias("n"), info.alias("info"),
    ).alias("m"))
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("line"), F.lit("").alias("ch"), F.lit(0).alias("n"), F.array().cast("array<struct<block:int,start_line:int,end_line:int,lang:string>>").alias("done"), F.lit("").alias("lang"))
    block = lambda acc, end: F.struct((F.size(acc["done"]) + 1).alias("block"), acc["line"].alias("start_line"), end.cast("int").alias("end_line"), acc["lang"].alias("lang"))

    def step(acc: Column, m: Column) -> Column:
        is_open = acc["line"] > 0
        closes = is_open & (m["ch"] == acc["ch"]) & (m["n"] >= acc["n"]) & (m["info"] == "")
        opens = ~is_open & ~((m["ch"] == "`") & F.contains(m["info"], F.lit("`")))
        state = lambda line, ch, n, done, lang: F.struct(line.alias("line"), ch.alias("ch"), n.alias("n"), done.alias("done"), lang.alias("lang"))
        return (
            F.when(closes, state(F.lit(0), F.lit(""), F.lit(0), F.concat(acc["done"], F.array(block(acc, m["line"]))), F.lit("")))
            .when(opens, state(m["line"], m["ch"], m["n"], acc["done"], F.regexp_extract(m["info"], "^([A-Za-z0-9_+-]*)", 1)))
            .otherwise(acc)
        )

    last = lambda acc: F.when(acc["line"] > 0, F.concat(acc["done"], F.array(block(acc, none)))).otherwise(acc["done"])
    found = seen.groupBy(key).agg(F.aggregate(F.sort_array(F.collect_list("m")), start, step, last).alias("b"))
    return found.select(key, F.inline("b"))


def fence_marks(lines: DataFrame, key: str = "path") -> DataFrame:
    """Lines with ``fenced`` (inside or on a fence), ``opens`` and ``block`` (number of the fence, from 1)."""
    blocks = fence_blocks(lines, key)
    events = blocks.select(key, F.col("start_line").alias("line"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        blocks.where("end_line is not null").select(key, F.col("end_line").alias("line"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    order = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.join(events, [key, "line"], "left").na.fill(0, ["up", "down"])
    ups, downs = F.sum("up").over(order), F.sum("down").over(order)
    counted = marked.withColumns({"_ups": ups, "_downs": downs})
    return counted.select(*lines.columns, ((F.col("_ups") > F.col("_downs")) | (F.col("down") > 0)).alias("fenced"), (F.col("up") > 0).alias("opens"), F.col("_ups").cast("int").alias("block"))


def fences(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, block, start_line, end_line, lang, digest): fenced blocks; the digest ignores blanks at line ends."""
    marked = fence_marks(lines, key).where("fenced").join(fence_blocks(lines, key).select(key, "block", "start_line", F.col("end_line").alias("closed"), "lang"), [key, "block"])
    body = F.when((F.col("line") > F.col("start_line")) & (F.col("line") < F.coalesce("closed", F.col("line") + 1)), F.struct("line", F.regexp_replace("text", "[ \\t]+$", "").alias("text")))
    grouped = marked.groupBy(key, "block", "start_line", "lang").agg(F.max("line").alias("end_line"), F.sort_array(F.collect_list(body)).alias("body"))
    joined = F.array_join(F.transform("body", lambda x: x["text"]), "\n")
    return grouped.select(key, "block", "start_line", "end_line", "lang", F.sha2(joined, 256).alias("digest"))


def headings(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, line, level, title, slug): ATX headings outside fences; repeated slugs numbered from 1."""
    found = fence_marks(lines, key).where("not fenced").where(F.col("text").rlike("^#{1,6}[ \\t]+[^ \\t]"))
    title = F.regexp_replace(F.regexp_replace("text", "^#{1,6}[ \\t]+", ""), "[ \\t]+#*[ \\t]*$", "")
    named = found.select(key, "line", F.length(F.regexp_extract("text", "^(#{1,6})", 1)).alias("level"), title.alias("title")).withColumn("base", T.slug("title"))
    again = F.row_number().over(Window.partitionBy(key, "base").orderBy("line")) - 1
    return named.select(key, "line", "level", "title", F.when(again == 0, F.col("base")).otherwise(F.concat_ws("-", "base", again)).alias("slug"))


def assign_sections(tokens: DataFrame, marks: DataFrame, key: str = "path", title: str = "title") -> DataFrame:
    """Tokens with ``section``: the nearest heading at or above their line (an as-of join by one window)."""
    both = tokens.withColumn("_mark", F.lit(None).cast("string")).unionByName(
        marks.select(key, "line", F.col(title).alias("_mark")), allowMissingColumns=True
    )
    # A heading's own line belongs to its section, so marks sort before tokens of the same line.
    order = Window.partitionBy(key).orderBy("line", F.col("_mark").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumns({"_is_mark": F.col("_mark").isNotNull(), "section": F.last("_mark", ignorenulls=True).over(order)})
    return carried.where("not _is_mark").select(*tokens.columns, F.coalesce("section", F.lit("")).alias("section"))


def section_ranges(marks: DataFrame, lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, title, start_line, end_line): each heading to the line before the next one, and what precedes the first."""
    sizes = lines.groupBy(key).agg(F.max("line").alias("n_lines"))
    nxt = F.lead("line").over(Window.partitionBy(key).orderBy("line"))
    named = marks.withColumn("nxt", nxt).join(sizes, key).select(key, "title", F.col("line").alias("start_line"), F.coalesce(F.col("nxt") - 1, F.col("n_lines")).alias("end_line"))
    first = marks.groupBy(key).agg(F.min("line").alias("line"))
    lead = sizes.join(first, key, "left").select(key, F.lit("").alias("title"), F.lit(1).alias("start_line"), F.coalesce(F.col("line") - 1, F.col("n_lines")).alias("end_line"))
    return named.unionByName(lead.where("end_line >= start_line"))


def ignore_ranges(lines: DataFrame, key: str = "path", word: str = "claim-ignore") -> DataFrame:
    """(key, from_line, to_line, rule): what ignore comments cover; rule null means every rule.

    ``<!-- word-start [rule] -->`` to ``<!-- word-end -->``, ``<!-- word-file -->``, and ``<!-- word [rule] -->``
    for the next line that is not blank (its own line when text stands beside it).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    pattern = f"<!--\\s*{word}(-start|-end|-file)?(?:\\s+([a-z0-9-]+))?\\s*-->"
    marks = lines.where(F.contains(text, F.lit(word))).select(
        key, "line", F.regexp_extract(text, pattern, 1).alias("kind"), F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).alias("rule"),
        text.rlike(f"^\\s*<!--\\s*{word}[^>]*-->\\s*$").alias("alone"), text.rlike(pattern).alias("ok"),
    ).where("ok")
    sizes = lines.groupBy(key).agg(F.max("line").alias("n_lines"))
    nxt = F.min(F.when(F.col("kind") == "-end", F.col("line"))).over(Window.partitionBy(key).orderBy("line").rowsBetween(1, Window.unboundedFollowing))
    spans = marks.withColumn("nxt", nxt).join(sizes, key)
    started = spans.where("kind = '-start'").select(key, F.col("line").alias("from_line"), F.coalesce("nxt", "n_lines").alias("to_line"), "rule")
    whole = spans.where("kind = '-file'").select(key, F.lit(0).alias("from_line"), F.col("n_lines").alias("to_line"), "rule")
    filled = lines.where("trim(text) <> ''").select(F.col(key).alias("_k"), F.col("line").alias("_line"))
    single = spans.where("kind = ''")
    beside = single.where("not alone").select(key, F.col("line").alias("from_line"), F.col("line").alias("to_line"), "rule")
    above = (
        single.where("alone").join(filled, (F.col(key) == F.col("_k")) & (F.col("_line") > F.col("line")))
        .groupBy(key, "line", "rule").agg(F.min("_line").alias("to_line")).select(key, F.col("line").alias("from_line"), "to_line", "rule")
    )
    return started.unionByName(whole).unionByName(beside).unionByName(above)


def drop_ignored(findings: DataFrame, ranges: DataFrame, key: str = "path") -> DataFrame:
    """Findings outside every ignore range of their document (a range anti-join); line 0 is never ignored."""
    r = ranges.select(F.col(key).alias("_k"), "from_line", "to_line", F.col("rule").alias("_rule"))
    covered = (F.col(key) == F.col("_k")) & F.col("line").between(F.col("from_line"), F.col("to_line")) & (F.col("line") > 0) & (F.col("_rule").isNull() | (F.col("_rule") == F.col("rule")))
    return findings.join(r, covered, "left_anti")


def table_shapes(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, start_line, n_rows, n_cols): pipe tables with a delimiter row of as many cells as the header; body rows only."""
    outside = fence_marks(lines, key).where("not fenced")
    cells: Column = F.size(F.split(F.regexp_replace(F.trim("text"), "^\\||\\|$", ""), "\\|", -1))
    order = Window.partitionBy(key).orderBy("line")
    piped = F.contains(F.coalesce(F.col("text"), F.lit("")), F.lit("|"))
    delimiter = F.coalesce(F.col("text"), F.lit("")).rlike("^\\s*\\|?\\s*:?-+:?\\s*(?:\\|\\s*:?-+:?\\s*)*\\|?\\s*$") & piped
    rows = outside.withColumns({"piped": piped, "cells": cells, "delimiter": delimiter})
    rows = rows.withColumns({"begins": piped & F.lead("delimiter").over(order) & (cells == F.lead("cells").over(order)) & ~delimiter})
    # A run of neighbouring piped lines is one table; its first line is the header.
    run = F.sum(F.when(~F.col("piped") | F.coalesce(F.col("line") != F.lag("line").over(order) + 1, F.lit(True)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    grouped = rows.withColumn("run", run).where("piped").groupBy(key, "run").agg(
        F.min(F.when(F.col("begins"), F.col("line"))).alias("start_line"), F.max("line").alias("last"), F.max(F.when(F.col("begins"), F.col("cells"))).alias("n_cols")
    )
    return grouped.where("start_line is not null").select(key, "start_line", (F.col("last") - F.col("start_line") - 1).alias("n_rows"), "n_cols")


def structure_digest(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, levels, codes, links, tables, numbers): what a translation must share with its source."""
    outside = fence_marks(lines, key).where("not fenced")
    h = headings(lines, key).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "level"))), lambda x: x["level"]).alias("levels"))
    c = fences(lines, key).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"]).alias("codes"))
    links = outside.select(key, F.explode(T.link_targets("text")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_set("x")).alias("links"))
    t = table_shapes(lines, key).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "n_rows", "n_cols"))), lambda x: F.concat_ws("x", x["n_rows"], x["n_cols"])).alias("tables"))
    n = outside.select(key, F.explode(T.numbers_in("text")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_set("x")).alias("numbers"))
    out = lines.select(key).distinct()
    for part in (h, c, links, t, n):
        out = out.join(part, key, "left")
    empty = F.array().cast("array<string>")
    return out.select(key, F.coalesce("levels", F.array().cast("array<int>")).alias("levels"), *[F.coalesce(x, empty).alias(x) for x in ("codes", "links", "tables", "numbers")])
