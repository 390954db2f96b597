"""Vectors of the column functions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlake.functions import text as T
from claimlake.operators.similar import osa


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given_path", "want"), [("a//b/./c", "a/b/c"), ("a\\b\\..\\c", "a/c"), ("../x", "../x"), ("./", ""), ("/a/b", "a/b")])
def test_clean_path(spark, given_path, want):
    assert one(spark, T.clean_path("p"), p=given_path) == want


def test_path_parts(spark):
    got = [one(spark, f("p"), p="docs/api/x.min.js") for f in (T.base_name, T.dir_name, T.stem, T.extension)]
    assert got == ["x.min.js", "docs/api", "x.min", "js"]
    assert one(spark, T.dir_name("p"), p="x") == "."
    assert one(spark, T.ancestors("p"), p="a/b/c.md") == ["a/b", "a", "."]
    assert one(spark, T.join_relative("d", "t"), d="docs/api", t="../img/x.png") == "docs/img/x.png"


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("docs/**/*.md", ["docs/a.md", "docs/x/y.md"], ["a.md"]), ("*.{go,py}", ["a.go"], ["a.rs", "x/a.go"]), ("a[!b]c", ["axc"], ["abc"]), ("x?.c", ["xy.c"], ["x/.c"]), ("**", ["a/b"], [])],
)
def test_globs(pattern, yes, no):
    rx = re.compile(T.glob_regex(pattern))
    assert all(rx.match(p) for p in yes)
    assert not any(rx.match(p) for p in no)
    assert re.match(T.glob_regex("*.go", basename=True), "a/b.go")


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("true", "yes", True), ("`10s`", "10000ms", True), ("1h30m", "90m", True), ("5_000", "5000", True), ("none", "nil", True), ("'info'", "info", True), ("1", "2", False), ("on", "false", False), ("0.5", ".50", True)],
)
def test_same_default(spark, a, b, same):
    assert one(spark, T.same_default("a", "b"), a=a, b=b) is same


@pytest.mark.parametrize(("spec", "want"), [(">=3.11", (3, 11)), ("^18", (18, 0)), ("~=1.4.2", (1, 4)), ("1.75", (1, 75)), ("latest", None)])
def test_version_floor(spec, want, spark):
    assert one(spark, T.version_floor("s"), s=spec) == want


@pytest.mark.parametrize(
    ("wanted", "registered", "ok"),
    [("/v1/items/42", "/v1/items/{id}", True), ("/v1/items", "/v1/items/{id}", False), ("/files/a/b", "/files/**", True), ("/x/:id/y", "/x/{n}/y", True), ("/v2/items/1", "/v1/items/{id}", False)],
)
def test_routes(spark, wanted, registered, ok):
    assert one(spark, T.route_matches(T.route_segments("a"), T.route_segments("b")), a=wanted, b=registered) is ok


def test_slug_numbers_braces(spark):
    assert one(spark, T.slug("h"), h="  Using [the API](x.md) & `run()`!") == "using-the-api--run"
    assert one(spark, T.numbers_in("h"), h="v1 1.2.3, 10 and 10; x9 1.2.") == ["1.2", "1.2.3", "10"]
    assert one(spark, T.expand_braces("h"), h="run.{sh, ps1}") == ["run.sh", "run.ps1"]
    assert one(spark, T.expand_braces("h"), h="run.sh") == ["run.sh"]


def test_output_functions(spark):
    assert one(spark, T.escape_workflow("h"), h="50%\nx") == "50%25%0Ax"
    assert one(spark, T.escape_workflow("h", True), h="a:b,c") == "a%3Ab%2Cc"
    assert one(spark, T.human_int(F.lit(1204))) == "1,204"
    assert one(spark, T.position_text(F.lit("f"), F.lit(3), F.lit(0))) == "f:3"
    assert [one(spark, T.percent(F.lit(1), F.lit(8), r)) for r in ("round", "floor", "half_up")] == [13, 12, 13]
    assert one(spark, T.percent(F.lit(0), F.lit(0))) == 100
    assert one(spark, T.fingerprint("h"), h="x") == "2d711642b726b044"
    assert one(spark, T.negated("h", F.lit("")), h="there is no ") is True


@pytest.mark.parametrize(("a", "b", "d"), [("ca", "abc", 3), ("abcd", "acbd", 1), ("", "abc", 3), ("é", "e", 1), ("same", "same", 0)])
def test_osa_vectors(a, b, d):
    assert osa(a, b) == d


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_osa_bounds(a, b):
    assert osa(a, b) <= levenshtein(a, b) <= 2 * osa(a, b)
    assert osa(a, b) == osa(b, a)


@pytest.mark.parametrize(
    ("heading", "slug"),
    [("Hello World", "hello-world"), ("A -- B", "a----b"), ("What's new?", "whats-new"), ("安裝說明", "安裝說明"), ("Install {#install-here}", "install"), ("Go 1.26 support", "go-126-support"), ("[Setup][s] of `x`", "setup-of-x")],
)
def test_slug_vectors(spark, heading, slug):
    assert one(spark, T.slug("a"), a=heading) == slug


@pytest.mark.parametrize(
    ("before", "after", "hit"),
    [
        ("There is no ", " here", True), ("Not that ", "", False), ("Without ", "", True), ("This was removed: see ", "", True), ("Removed last year. Use ", " now", False), ("不提供 `X`：", " 本來就是", False), ("曾經存在的 `Codec` 介面（", "", True),
        ("Use ", " was removed", True), ("Use ", " no longer exists", True), ("It does not exist in other trees and so on and on and on until far away ", "", False), ("Use ", " and more", False), ("**刪除**：", "、`core/log`", True),
    ],
)
def test_negation_vectors(spark, before, after, hit):
    assert one(spark, T.negated("a", "b"), a=before, b=after) is hit


@pytest.mark.parametrize(("a", "b", "same"), [("-", "", True), ("(empty)", "none", True), ("/docs", "/docs/", False), ("30s", "30000ms", True), ("1.0", "1", True), ("Info", "info", False), ("1d", "1", False)])
def test_same_default_vectors(spark, a, b, same):
    assert one(spark, T.same_default("a", "b"), a=a, b=b) is same


@pytest.mark.parametrize(("spec", "floor"), [(">=3.10", (3, 10)), ("^3.9", (3, 9)), ("<4,>=3.9", (3, 9)), ("!=3.1, ~=3.8", (3, 8)), ("net8.0", (8, 0)), (">=18 <21", (18, 0)), ("<4", None), ("any", None)])
def test_version_floor_vectors(spark, spec, floor):
    got = one(spark, T.version_floor("a"), a=spec)
    assert (tuple(got) if got else None) == floor


@pytest.mark.parametrize(("path", "segs"), [("/items/{id}", ["items", "{}"]), ("/files/*", ["files", "**"]), ("/items/{$}", ["items", "{$}"]), ("/v{version}/x", ["{}", "x"]), ("//double//slashes", ["double", "slashes"]), ("/a/{rest...}", ["a", "**"])])
def test_route_vectors(spark, path, segs):
    assert one(spark, T.route_segments("a"), a=path) == segs


@pytest.mark.parametrize(("pattern", "path", "hit"), [("docs/**/*.md", "docs/c.md", True), ("docs/*.md", "docs/a/c.md", False), ("a/{b,c}/*.go", "a/c/x.go", True), ("a?b", "a/b", False), ("pkg/**", "pkg/x/y", True)])
def test_glob_columns(spark, pattern, path, hit):
    assert one(spark, F.regexp(F.col("b"), T.glob_pattern("a")), a=pattern, b=path) is hit
