"""Structure and clean text of pages."""

import pytest

from claimlake.llm import markup as M

MD = """---
title: "x **y**"
---
# Using *the* API
- one
  - two `x`
1) three

Setext title
------------
Text with $a^2$ and [a](b) [^1].
Costs $5 or $50; 5 * 3 * 2; snake_case_name; [sic].
```py
# not a heading
$x$
```
<!--
# hidden
-->
$$
x * y * z
$$
| a | b |
|---|---|
| `c` | 1 |
<h3 align="center">Centered</h3>
a &amp; b<br/>
~~~
open to the end
# still code""".split("\n")
MD_WANT = {4: {"heading", "inline"}, 5: {"item"}, 6: {"item", "inline"}, 7: {"item"}, 9: {"heading"}, 11: {"formula", "inline"}, 13: {"code"}, 20: {"formula"}, 26: {"heading"}, 27: {"inline"}, 28: {"code"}}
HTML = ["<!DOCTYPE html>", "<html><body>", "<H1>Head <b>x</b></H1>", "<p>One &lt;two&gt;</p>", "<ul>", "<LI>item</LI>", "</ul>", "<pre><code>", "<h1>raw</h1>", "</code></pre>", '<math display="block">', "x", "</math>", "<p>a <math>b</math> c", "<div><p>plain</p></div>", "</body></html>"]
HTML_WANT = {3: {"heading", "inline"}, 4: {"inline"}, 6: {"item"}, 8: {"code"}, 11: {"formula"}, 14: {"formula"}}
WIKI = ["== Head ==", "* item [[Link]]", "#numbered", "'''bold''' text", '<source lang="c">', "== no ==", "</source>", "<math>", "x", "</math>", "a <math>b</math>", "{| class", "| '''cell'''", "|}", "== neither = nor"]
WIKI_WANT = {1: {"heading"}, 2: {"item", "inline"}, 3: {"item"}, 4: {"inline"}, 5: {"code"}, 8: {"formula"}, 11: {"formula"}}
TEX = ["\\documentclass{article}", "\\begin{document}", "\\section*{Head}", "Some \\emph{text} and $x$.", "\\begin{itemize}", "  \\item one~\\cite{k}", "\\end{itemize}", "\\begin{verbatim}", "\\section{no}", "\\end{verbatim}", "\\begin{align*}", "x", "\\end{align*}", "\\[", "y", "\\]", "% \\emph{no}", "50\\% plain", "\\end{document}"]
TEX_WANT = {3: {"heading"}, 4: {"formula", "inline"}, 6: {"inline", "item"}, 8: {"code"}, 11: {"formula"}, 14: {"formula"}}
PLAIN = ["Heading words", "", "5 * 3 * 2 and snake_case and $5 or $6.", "See section 4.2, items 1) to 3).", "C:\\temp\\new"]


@pytest.mark.parametrize(
    ("lines", "notation", "want"),
    [(MD, "markdown", MD_WANT), (HTML, "html", HTML_WANT), (WIKI, "wiki", WIKI_WANT), (TEX, "latex", TEX_WANT), (PLAIN, None, {}), ([], None, {}), ([""], None, {})],
)
def test_notations(lines, notation, want):
    got, parsed = M.parse_page(lines, "x.txt")
    assert got == notation
    assert {n: line.kinds for n, line in enumerate(parsed, 1) if line.kinds} == want


def test_html_headings_alone_are_markdown():
    page = ['<h1 align="center">One</h1>', "", "Text __x__ here.", "", '<h2 align="center">Two</h2>', "Plain."]
    assert M.notation_of(page, "x.txt") == "markdown" and M.parse_page(page)[1][2].kinds == {"inline"}


def test_clean_text():
    text = M.clean_text(M.parse_page(MD)[1])
    assert text.startswith("# Using the API\n- one\n  - two x\n1) three\n\n## Setext title\nText with $a^2$ and a .")
    assert "hidden" not in text and "title:" not in text and "# not a heading" in text and "### Centered" in text and "a & b" in text
    tex = M.clean_text(M.parse_page(TEX)[1])
    assert tex.startswith("# Head\nSome text and $x$.\n- one\n```\n\\section{no}\n```\n$$\nx\n$$")


def test_line_blocks():
    assert M.line_blocks([0, 0, 5, 0, 0, 80, 90, 0, 70, 0, 0, 0, 0, 3]) == [False] * 5 + [True] * 4 + [False] * 5
    assert M.line_blocks([]) == []


def rows(spark, *r):
    return spark.createDataFrame(r, "repo string, path string, line int, text string, scanned_at timestamp, kind string")


def test_repeated_unordered_null_rows(spark):
    import datetime as dt

    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    f = rows(
        spark, ("r", "p.md", 3, "- item\r", b, "clash"), ("r", "p.md", 1, "# old", a, None), ("r", "p.md", 1, "# new *x*", b, None), ("r", "p.md", 2, None, a, None), ("r", "p.md", 3, "- item\r", a, None),
        ("r", None, 1, "# x", a, None), ("r", "p.md", None, "# x", a, None), (None, "q.txt", 1, "plain", None, None),
    )
    got = {(r.path, r.line, r.kind) for r in M.page_structure(f).collect()}
    assert got == {("p.md", 1, "heading"), ("p.md", 1, "inline"), ("p.md", 3, "item")}
    assert {(r.path, r.notation, r.text) for r in M.clean_pages(f).collect()} == {("p.md", "markdown", "# new x\n\n- item"), ("q.txt", "none", "plain")}
    assert M.page_structure(f.limit(0)).isEmpty() and M.clean_pages(f.limit(0)).isEmpty() and M.block_text(f.limit(0)).isEmpty()


def test_long_page(spark):
    import pyspark.sql.functions as F

    f = spark.range(60_000).select(F.lit("r").alias("repo"), F.lit("big.md").alias("path"), (F.col("id") + 1).cast("int").alias("line"), F.when(F.col("id") % 3 == 0, "# h").otherwise("text").alias("text"), F.lit(None).cast("timestamp").alias("scanned_at"))
    assert M.page_structure(f).count() == 20_000


def test_method_keeps_dense_text(spark):
    f = rows(spark, *[("r", "p", n, "x" * 60 if 5 <= n <= 9 else "", None, None) for n in range(1, 15)])
    assert sorted(r.line for r in M.block_text(f).collect())[0] <= 5


def test_stripping_knows_no_notation():
    want = "Plain words and code here"
    for line in ("## **Plain** words and `code` here", "<p>Plain <b>words</b> and <code>code</code> here</p>", "== Plain ''words'' and code here ==", "\\section{Plain \\emph{words} and \\texttt{code} here}", "- [Plain words](x.md) and code here", "* [[Page|Plain words]] and code here <!-- no -->"):
        assert M.strip_markup(line) == want if "Page" not in line else want in M.strip_markup(line)


def test_menus_and_footers_dive():
    page = ["Home", "Docs", "", "", *["A line of running text that says what the tool does in full sentences."] * 6, "", "", "Top", "", "Imprint"]
    kept = M.line_blocks([len(M.strip_markup(x)) for x in page])
    assert [n for n, k in enumerate(kept) if k and page[n]] == list(range(4, 10))
