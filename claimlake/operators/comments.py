"""Comments that name what does not exist, and examples that do not parse."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.functions import text as T


def mentions(spans: DataFrame, sources: DataFrame, symbol_keys: DataFrame, literals: DataFrame, siblings: DataFrame | None = None) -> DataFrame:
    """(file, full_name, line, token): code-like words of a comment that its file, the index and sibling trees do not know.

    Each source of words is one anti-join; the words of a file are distinct before they meet the comments.
    """
    words = "([A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z_][A-Za-z0-9_]*)*)"
    rows = spans.select("file", "full_name", "doc_start", F.posexplode("doc").alias("pos", "row"))
    quoted = F.regexp_extract_all("row", F.lit("`([^`]+)`"), 1)
    cased = F.regexp_extract_all("row", F.lit("\\b([a-z]+[a-z0-9]*(?:[A-Z][a-z0-9]*)+|[a-z][a-z0-9]*(?:_[a-z0-9]+)+)\\b"), 1)
    said = rows.select("file", "full_name", (F.col("doc_start") + F.col("pos")).alias("line"), F.explode(F.array_distinct(F.concat(F.transform(quoted, lambda q: F.regexp_replace(q, "\\(\\)$", "")), cased))).alias("token"))
    said = said.where(F.col("token").rlike("^" + words[1:-1] + "$") & (F.length("token") > 3) & T.name_shape("token").isin("dotted", "camel", "pascal", "snake"))
    last = F.regexp_extract("token", "([A-Za-z_][A-Za-z0-9_]*)$", 1)
    code = F.regexp_replace("text", "(?m)//[^\\n]*|#[^\\n]*|(?s)/\\*.*?\\*/|\"\"\".*?\"\"\"", " ")
    in_file = sources.select("file", F.explode(T.identifiers_in(code)).alias("word")).distinct()
    known = symbol_keys.select(F.col("key").alias("word")).unionByName(literals.select(F.col("name").alias("word")))
    if siblings is not None:
        known = known.unionByName(siblings.select("word"))
    open_ = said.withColumn("word", last).join(in_file, ["file", "word"], "left_anti").join(known.distinct(), "word", "left_anti")
    return open_.join(known.select(F.col("word").alias("token")).distinct(), "token", "left_anti").select("file", "full_name", "line", "token").distinct()


def words_of(sources: DataFrame, max_chars: int = 2 << 20) -> DataFrame:
    """(word): all identifiers of sibling trees' sources within the size cap."""
    return sources.where(F.length("text") <= max_chars).select(F.explode(T.identifiers_in("text")).alias("word")).distinct()


_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[\"'`]|[()\[\]{}]|\n|[^\s()\[\]{}\"'`/]+|/", re.S)
_GROUPS = ("import", "const", "var", "type")


def example_fault(code: str) -> str | None:
    """What keeps a block of Go code from parsing, as far as brackets, strings and the ends of lines in lists tell; elisions are allowed.

    A line inside round brackets that ends with an operand ends the list, unless the brackets group declarations.
    """
    if re.search(r"^\s*(?:\.\.\.|…)\s*$", code, re.M):
        code = re.sub(r"(?m)^\s*(?:\.\.\.|…)\s*$", "", code)
    stack: list[str] = []
    last = ""
    for m in _TOKEN.finditer(code):
        t = m[0]
        if t.startswith(("//", "/*")):
            continue
        if t in ("\"", "'", "`"):
            return "a string is not closed"
        if t == "\n":
            if stack and stack[-1] == "(" and last and (last[-1].isalnum() or last[-1] in "_)]}\"'`") and last not in ("func", "return"):
                return "missing ',' before newline in argument list"
            last = ""
            continue
        if t in ("(", "[", "{"):
            stack.append("group" if t == "(" and last in _GROUPS else t)
        elif t in (")", "]", "}"):
            opened = stack.pop() if stack else ""
            if {"(": ")", "group": ")", "[": "]", "{": "}"}.get(opened) != t:
                return f"{t} closes nothing"
        last = t
    return ("( is not closed" if stack[-1] == "group" else f"{stack[-1]} is not closed") if stack else None


def _fault_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(p, n, fault) for p, n, t in zip(batch["path"], batch["line"], batch["text"], strict=True) if (fault := example_fault(t or ""))]
        yield pd.DataFrame(rows, columns=["path", "line", "fault"])


def example_faults(tokens: DataFrame) -> DataFrame:
    """(path, line, fault) of Go examples that cannot parse."""
    fences = tokens.where("kind = 'fence' and lang in ('go', 'golang')").select("path", "line", "text")
    return fences.mapInPandas(_fault_batches, "path string, line int, fault string")
