"""Extraction passes and resolvers on small cases."""

import pytest

from claimlake.operators import extract as X
from claimlake.operators import history as H
from claimlake.operators import pairs as P
from claimlake.operators import resolve as R
from claimlake.operators import similar as S
from claimlake.sources import facts, tokens


def tokens_of(spark, text, path="docs/a.md"):
    return tokens.token_table(spark.createDataFrame([(path, text)], "path string, text string"))


def lines_of(spark, text, path="docs/a.md"):
    return spark.createDataFrame([(path, n, t) for n, t in enumerate(text.split("\n"), 1)], "path string, line int, text string")


def claims_of(spark, *rows):
    return spark.createDataFrame([("docs/a.md", n, 1, kind, norm, norm, 3, 1) for n, (kind, norm) in enumerate(rows, 1)], "path string, line int, col int, kind string, text string, norm string, confidence int, pass int")


def test_words_inside_spans(spark):
    rows = X.token_claims(tokens_of(spark, "`run srv.Start(cfg) --fast -v PATH_TO pkg/a/b.go` and `git log --oneline` and `go run ./cmd/x --mine`\n`pkg/My File v1.md`")).collect()
    assert {(r.kind, r.norm) for r in rows} == {("symbol", "srv.Start"), ("flag", "fast"), ("flag", "v"), ("env", "PATH_TO"), ("path", "pkg/a/b.go"), ("path", "cmd/x"), ("flag", "mine")}


def test_file_names_with_blanks(spark):
    rows = X.span_claims(tokens_of(spark, "`docs/Local Plan v0.1.md` but `go run x.md` and `a/b.go c.md`")).collect()
    assert [(r.kind, r.norm) for r in rows] == [("path", "docs/Local Plan v0.1.md")]


def test_defaults_in_tables(spark):
    text = "| Flag | Meaning | Default |\n|---|---|---|\n| `--port` | where | `8080` |\n| `LOG_LEVEL` | how | info |\n| `server.addr` | x | |\n| plain | y | 1 |"
    assert sorted(r.norm for r in X.table_defaults(tokens_of(spark, text), lines_of(spark, text)).collect()) == ["env:LOG_LEVEL=info", "flag:port=8080"]


def test_denied_claims(spark):
    text = "There is no `pkg/old.go`. But `pkg/new.go` is here, where everybody looks for it first, and `--gone` was removed.\n不提供 `a.B`：`c.D` 是"
    got = {(r.kind, r.norm) for r in X.claims(tokens_of(spark, text), lines_of(spark, text)).collect()}
    assert got == {("path", "pkg/new.go"), ("flag", "gone"), ("symbol", "c.D")}


def test_config_examples_count_by_fence(spark):
    text = '```json\n{\n "a": 1,\n "b": 2\n}\n```\n\n```json\n{\n "x": 1,\n "y": 2,\n "a": 3\n}\n```\n\n```json\n{\n "z": 1\n}\n```'
    known = spark.createDataFrame([("a",)], "key string")
    got = {(r.line, r.norm): r.confidence for r in X.config_claims(tokens_of(spark, text), known).collect()}
    assert got == {(3, "a"): 3, (4, "b"): 3, (10, "x"): 2, (11, "y"): 2, (12, "a"): 2}


def test_names_imported_from_elsewhere(spark):
    text = "```rust\nuse tower::{ServiceBuilder, Layer as L};\nuse crate::own::Thing;\n```\n```python\nfrom flask import Flask, g as ctx\nimport mine.x\n```\n```js\nimport { A, B as C } from 'react';\n```\n```go\nimport \"github.com/x/zap\"\n```"
    own = spark.createDataFrame([("mine",)], "head string")
    names = X.external_names(tokens_of(spark, text), own)
    assert {r.name for r in names.collect()} == {"ServiceBuilder", "L", "Flask", "ctx", "A", "C", "zap"}
    keys = spark.createDataFrame([("L.own", "L.own", True), ("Dyn.a", "Dyn.a", True)], "key string, full string, exported boolean")
    none = spark.createDataFrame([], "name string, key string")
    opaque = spark.createDataFrame([("Dyn",)], "name string")
    verdicts = R.symbols(claims_of(spark, ("symbol", "L.other"), ("symbol", "L.own"), ("symbol", "Dyn.b"), ("symbol", "Far.x")), keys, none, none, names, opaque)
    assert {r.norm: r.status for r in verdicts.collect()} == {"L.other": "skipped", "L.own": "ok", "Dyn.b": "skipped", "Far.x": "skipped"}


def test_paths_globs_and_renames(spark):
    files = spark.createDataFrame([(p, False) for p in ("pkg/a/x.go", "pkg/b/y_test.go", "docs/img/p.png", "new/name.go")] + [("pkg", True)], "rel string, is_dir boolean")
    renames = spark.createDataFrame([("old/name.go", "new/name.go"), ("lost.go", "gone.go")], "old string, new string")
    asked = ("pkg/*/*.go", "pkg/**", "img/*.png", "pkg/*.rs", "pkg", "old/name.go", "lost.go", "*_test.go")
    got = {r.norm: (r.status, r.suggestion) for r in R.paths(claims_of(spark, *(("path", p) for p in asked)), files, renames).collect()}
    assert {k for k, v in got.items() if v[0] == "ok"} == {"pkg/*/*.go", "pkg/**", "img/*.png", "pkg"}
    assert got["old/name.go"] == ("missing", "new/name.go") and got["lost.go"][1] is None


@pytest.mark.parametrize(
    ("claim", "status", "fix"),
    [
        ("GET /v1/items/42", "ok", None), ("GET /api/v1/items", "ok", None), ("GET /v1/item", "missing", "/v1/items"), ("DELETE /v1/items", "missing", "GET, POST /v1/items"), ("/v1/items", "ok", None), ("GET /files/a/b/c", "ok", None),
        ("GET /x/files/a", "missing", None), ("GET /exact", "ok", None), ("GET /exact/{id}", "missing", None), ("PUT /v1/{kind}/{id}", "missing", "GET /v1/{kind}/{id}"), ("GET /", "missing", None),
    ],
)
def test_route_verdicts(spark, claim, status, fix):
    known = spark.createDataFrame([("route", n) for n in ("GET /v1/items", "POST /v1/items", "GET /v1/items/{id}", "GET /files/*", "/exact/{$}")], "kind string, name string")
    got = R.routes(claims_of(spark, ("route", claim)), known).collect()
    assert [(r.status, r.suggestion if fix else None) for r in got] == [(status, fix)]


def test_toolchain_direction(spark):
    project = {"names": {}, "versions": {"go": "1.26", "node": ">=18"}, "targets": {"make": ["a"]}}
    none = spark.createDataFrame([], "kind string, name string, value string, file string, line int")
    rows = R.findings(R.project_claims(claims_of(spark, ("toolchain", "go:1.20"), ("toolchain", "go:1.30"), ("toolchain", "go:1.26"), ("toolchain", "node:16"), ("toolchain", "ruby:3")), project, none)).collect()
    assert {(r.norm, r.severity) for r in rows} == {("go:1.20", "warning"), ("go:1.30", "info"), ("node:16", "warning")}


def test_probed_links(spark):
    probed = spark.createDataFrame([("https://a/x", 200), ("https://a/y", 404), ("https://a/z", 0)], "url string, status int")
    got = {r.norm: (r.status, r.level) for r in R.urls(claims_of(spark, *(("url", f"https://a/{c}") for c in "xyzw")), probed).collect()}
    assert {k[-1]: v[0] for k, v in got.items()} == {"x": "ok", "y": "missing", "z": "missing", "w": "skipped"} and got["https://a/y"][1] == "warning"


def test_go_members():
    text = 'package p\n\nconst (\n\tA, B = 1, 2\n\tc = 3\n)\n\ntype (\n\tKind int\n\tBox struct {\n\t\tName, Alias string `json:"name"`\n\t\tIn *Inner `yaml:"in"`\n\t\tio.Reader\n\t}\n)\n\ntype Walker interface {\n\tWalk(n int) error\n}\n\nfunc (b *Box) Open() {\n\tvar inside = 1\n}\n'
    got = {(r[2], r[4], r[3]) for r in facts.scan("p/a.go", text) if r[2] not in ("literal", "module", "key")}
    assert got >= {("const", "", "A"), ("const", "", "B"), ("const", "", "c"), ("type", "", "Kind"), ("type", "", "Box"), ("field", "Box", "Alias"), ("tag", "Box", "name"), ("tag", "Box", "in"), ("method", "Walker", "Walk"), ("method", "Box", "Open")}
    assert not any(r[3] == "inside" for r in facts.scan("p/a.go", text))


def test_passed_on_names(spark):
    files = [
        ("lib/__init__.py", "from .core import run as go, stop\n"), ("lib/core.py", "def run(): pass\ndef stop(): pass\n"), ("web/index.ts", "export * from './mid';\n"), ("web/mid.ts", "export { one as uno } from './deep';\nexport * from './deep';\n"),
        ("web/deep.ts", "export function one() {\n}\n"), ("src/lib.rs", "pub use crate::io::write_all;\n"), ("src/io.rs", "pub fn write_all() {\n}\n"),
    ]
    table = facts.fact_table(spark.createDataFrame(files, "file string, text string"))
    keys = {r.key for r in facts.symbol_keys(table).collect()}
    assert {"lib.go", "lib.stop", "web.one", "web.uno", "web.mid.uno", "src::write_all"} <= keys


def test_opaque_types():
    named = lambda file, text: {r[3] for r in facts.scan(file, text) if r[2] == "opaque"}
    assert named("a.py", "class A:\n    def __getattr__(self, n):\n        pass\n\nclass B:\n    x = 1\n") == {"A"}
    assert named("a.ts", "interface Bag {\n  [key: string]: number;\n}\n") == {"Bag"}


def test_a_body_of_more_than_five_thousand_lines():
    body = "\n".join("\tx()" for _ in range(7000))
    found = [r for r in facts.scan("a.go", f"package p\n\nfunc Long() {{\n{body}\n}}\n") if r[3] == "Long"]
    assert found[0][7] == 7004


def test_long_chains_of_renames_and_exports(spark):
    renames = spark.createDataFrame([(f"f{n}", f"f{n + 1}", n) for n in range(90)] + [("a", "b", 1), ("b", "a", 2)], "old string, new string, ts int")
    got = {r.old: r.new for r in H.collapse_renames(renames).collect()}
    assert all(got[f"f{n}"] == "f90" for n in range(90))
    edges = spark.createDataFrame([(f"m{n}", f"m{n + 1}") for n in range(7)], "module string, target string")
    assert ("m0", "m7") in {tuple(r) for r in facts.reexport_closure(edges).collect()}
    fields = spark.createDataFrame([(f"T{n}", f"k{n}", f"T{n + 1}") for n in range(10)], "type string, tag string, child string")
    assert ".".join(f"k{n}" for n in range(10)) in {r.key for r in facts.key_paths(fields, spark.createDataFrame([("T0",)], "type string")).collect()}


def test_all_differences_are_listed(spark):
    names = [f"n{k:03d}" for k in range(40)]
    digests = spark.createDataFrame([("a", [1], [], names, [], []), ("b", [1], [], [], [], [])], "path string, levels array<int>, codes array<string>, links array<string>, tables array<string>, numbers array<string>")
    pairs = spark.createDataFrame([("a", "b")], "source string, translation string")
    detail = [r.detail for r in P.compare(pairs, digests).where("rule = 'pair-link'").collect()]
    assert detail == ["source " + ",".join(names)]


def test_nearest_files_of_a_hot_name(spark):
    known = [f"d{k}/e/README.md" for k in range(300)] + ["docs/deep/README.md", "docs/deep/x/y/README.md", "docs/README.rst", "docs/deep/readme.MD"]
    files = spark.createDataFrame([(k,) for k in known], "rel string")
    got = [(r.candidate, r.score) for r in S.similar_paths(spark.createDataFrame([("docs/deep/z/README.md",)], "path string"), files).orderBy("rank").collect()]

    def score(c):
        p, q = "docs/deep/z/README.md".split("/"), c.split("/")
        shared = 0
        while shared < min(len(p), len(q)) - 1 and p[shared] == q[shared]:
            shared += 1
        apart = len(p) + len(q) - 2 - 2 * shared
        return 100 + apart if q[-1] == "README.md" else 101 + apart if q[-1].lower() == "readme.md" else 2000

    assert got == sorted(((c, score(c)) for c in known), key=lambda x: (x[1], len(x[0]), x[0]))[:3]


def test_anchor_suggestions(spark):
    known = spark.createDataFrame([("docs/g.md", "install"), ("docs/h.md", "instal-all"), ("docs/g.md", None), ("docs/h.md", None)], "path string, slug string")
    got = {r.norm: (r.status, r.suggestion) for r in R.anchors(claims_of(spark, ("anchor", "docs/g.md#instal"), ("anchor", "docs/g.md#far-away"), ("anchor", "docs/g.md#install"), ("anchor", "no.md#x")), known).collect()}
    assert got == {"docs/g.md#instal": ("missing", "#install"), "docs/g.md#far-away": ("missing", None), "docs/g.md#install": ("ok", None), "no.md#x": ("skipped", None)}


def test_routes_of_frameworks(spark):
    rows = lambda file, text: {(r[3], r[5]) for r in facts.scan(file, text) if r[2] == "route"}
    assert rows("a.py", 'router = APIRouter(prefix="/py")\n@router.get("/items")\ndef f(): pass\n@app.route("/x")\ndef g(): pass\n') == {("/items", "GET"), ("/py/items", "GET"), ("/x", None)}
    assert rows("shop/urls.py", 'urlpatterns = [path("items/<int:id>/", v), re_path(r"^old/$", w)]\n') == {("/items/<int:id>/", None), ("/old/", None)}
    assert rows("a.js", "app.post('/y', h)\n") == {("/y", "POST")} and rows("a.cs", 'app.MapDelete("/z", h);\n') == {("/z", "DELETE")}
    table = facts.fact_table(spark.createDataFrame([("a.js", "app.get('/y', h)\n")], "file string, text string"))
    assert {r.norm: r.status for r in R.routes(claims_of(spark, ("route", "GET /y"), ("route", "PUT /y")), table).collect()} == {"GET /y": "ok", "PUT /y": "missing"}


def test_lists_that_end_too_early():
    from claimlake.operators.comments import example_fault

    assert example_fault("f(\n\ta,\n\tb\n)") == "missing ',' before newline in argument list"
    assert example_fault("f(\n\ta,\n\tb,\n)") is None and example_fault('import (\n\t"fmt"\n\t"os"\n)\n\nconst (\n\tA = 1\n)') is None
    assert example_fault("x := f(a) // note (\ny := g(b +\n\tc)") is None and example_fault("func f() {\n\tg(func() {\n\t\th()\n\t})\n") == "{ is not closed"
