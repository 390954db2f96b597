"""The whole check on a small repository with seeded lies, reports, command line, streams."""

import json
import os
import subprocess
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from claimlake.__main__ import main, root_of
from claimlake.operators.comments import example_fault
from claimlake.plans import report
from claimlake.plans.engine import Config, Engine
from claimlake.sources import facts, remote, repo, tokens
from claimlake.streaming import incremental

FILES = {
    "README.md": """# Widget

See `pkg/srv/server.go`, `pkg/srv/router.go` and [the guide](docs/guide.md#setup), [bad](docs/guid.md), [gone](docs/guide.md#nope).
Call `srv.Start()` or `srv.Strat()`. Pass `--addr` or `--adrr`, set `WIDGET_TOKEN` and `WIDGET_TOKN`.
`GET /v1/items/{id}` works, `GET /v2/none` does not. There is no `pkg/old.go` any more.
Requires Go 1.20 or later.
The flag `--addr` defaults to `5000`.

<!-- claim-ignore -->
Hidden `pkg/hidden.go`.

```sh
make build && make deploy
pip install widgt
```

```go
func broken( {
```

```json
{
  "addr": ":80",
  "adr": 1
}
```
""",
    "config.json": '{"addr": ":1", "log": {"level": "x"}}',
    "README-zh.md": "# Widget\n\n## More\n\n[x](docs/guide.md)\n",
    "docs/guide.md": "# Guide\n\n## Setup\n\nText.\n",
    "pkg/srv/server.go": """package srv

// Start starts what loadWidget prepared for get.
func Start() error {
	addr := flag.String("addr", "8080", "where")
	os.Getenv("WIDGET_TOKEN")
	mux.HandleFunc("GET /v1/items/{id}", get)
	return nil
}

func Hidden() {}
""",
    "go.mod": "module example.org/widget\n\ngo 1.26\n",
    "Makefile": "build:\n\tgo build\n",
    "pyproject.toml": '[project]\nname = "widget"\n',
}
GOLDEN = {
    ("missing-path", "pkg/srv/router.go", "error", None), ("missing-path", "docs/guid.md", "error", "docs/guide.md"), ("broken-anchor", "docs/guide.md#nope", "error", None), ("missing-symbol", "srv.Strat()", "error", "srv.Start"),
    ("unknown-flag", "--adrr", "warning", "addr"), ("unknown-env", "WIDGET_TOKN", "warning", "WIDGET_TOKEN"), ("missing-route", "GET /v2/none", "error", None), ("toolchain-mismatch", "go:1.20", "warning", "go:1.26"),
    ("undocumented", None, "info", None), ("missing-target", "make deploy", "error", None), ("install-mismatch", "pip:widgt", "warning", "widget"), ("example-syntax", None, "warning", None), ("comment-mentions-missing", None, "warning", None), ("unknown-config-key", "adr", "warning", "addr"), ("default-mismatch", "The flag `--addr` defaults to `5000`.", "warning", "8080"),
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("widget")
    for name, text in FILES.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    return str(top)


@pytest.fixture(scope="module")
def engine(spark, root):
    return Engine(spark, root, Config(git=False))


@pytest.fixture(scope="module")
def rows(engine):
    return report.rows_of(engine.findings)


def test_golden_findings(rows):
    assert {(r["rule"], r["text"], r["severity"], r["suggestion"]) for r in rows if not r["rule"].startswith("pair-")} == GOLDEN
    drift = {r["rule"] for r in rows if r["rule"].startswith("pair-")}
    assert {"pair-heading", "pair-link"} <= drift


def test_coverage_and_explain(engine):
    got = {r.grp: (r.total, r.documented, r.missing) for r in engine.coverage.collect()}
    assert got["srv"] == (2, 1, ["srv.Hidden"]) and got["flags"] == (1, 1, [])
    more = {r.grp: (r.total, r.documented) for r in engine.more_coverage.collect()}
    assert more == {"routes": (1, 1), "config": (2, 1)}
    status = {(r.kind, r.text): r.status for r in engine.explain("README.md").collect()}
    assert status["symbol", "srv.Start()"] == "ok" and status["path", "pkg/srv/router.go"] == "missing" and ("path", "pkg/old.go") not in status


def test_formats(rows):
    assert "did you mean docs/guide.md?" in report.render(rows)
    assert json.loads(report.render(rows, "json"))["summary"]["errors"] == sum(r["severity"] == "error" for r in rows)
    run = json.loads(report.render(rows, "sarif"))["runs"][0]
    assert len(run["results"]) == len(rows) and run["results"][0]["baselineState"] == "new"
    suite = xml.dom.minidom.parseString(report.render(rows, "junit")).documentElement
    assert int(suite.getAttribute("tests")) == len({(r["file"], r["rule"]) for r in rows})
    assert report.render(rows, "github").startswith("::") and "<table>" in report.render(rows, "html") and "## README.md" in report.render(rows, "md")


def test_baseline_round_trip(spark, root, engine):
    path = engine.freeze()
    try:
        again = Engine(spark, root, Config(git=False))
        again.__dict__.update({k: engine.__dict__[k] for k in ("tokens", "facts", "claims", "verdicts") if k in engine.__dict__})
        assert all(r["baselined"] for r in report.rows_of(again.findings))
        path.write_text('{"version": 2}')
        with pytest.raises(ValueError, match="version"):
            _ = Engine(spark, root, Config(git=False)).baseline
    finally:
        path.unlink()


def test_fix_keeps_line_ends(root, engine):
    edits = engine.apply_fixes()
    assert {(e["old"], e["new"], e["done"]) for e in edits} == {("docs/guid.md", "docs/guide.md", True)}


def test_config_is_strict(tmp_path):
    (tmp_path / ".claimlake.json").write_text('{"docz": []}')
    with pytest.raises(ValueError, match="docz"):
        Config.load(str(tmp_path))
    assert main(["check", str(tmp_path)]) == 2
    assert main(["nonsense"]) == 2 and main(["version"]) == 0
    assert root_of(str(tmp_path / "deep")) == str(tmp_path)


def test_tokenizers():
    kinds = lambda rows: [(r[1], r[2], r[5], r[6]) for r in rows]
    rst = tokens.tokenize("a.rst", "Title\n=====\n\n.. _lab:\n\nSub\n---\n\nSee :func:`m.f` and ``x.y`` and :ref:`lab`.\n\n.. code-block:: python\n\n   import m\n\nCode::\n\n   raw\n")
    assert [(k, n, t) for k, n, t, _ in kinds(rst)] == [("heading", 1, "Title"), ("label", 4, "lab"), ("heading", 6, "Sub"), ("span", 9, "x.y"), ("span", 9, "m.f"), ("link", 9, "lab"), ("fence", 11, "import m"), ("fence", 15, "raw")]
    adoc = tokens.tokenize("a.adoc", "= Doc\n\n[[here]]\n== Part\n\n[source,go]\n----\nx := 1\n----\nSee <<here,text>> and link:b.adoc[B] and `c.d`.\n// note\n")
    assert [(k, t) for k, _, t, _ in kinds(adoc)] == [("heading", "Doc"), ("label", "here"), ("heading", "Part"), ("fence", "x := 1"), ("link", "text"), ("link", "B"), ("span", "c.d"), ("comment", "note")]
    assert tokens.format_of("x.txt", "A\n=\n\n.. note::\n\n   x") == "rst" and tokens.format_of("x.txt", "# A\n") == "markdown"
    md = kinds(tokens.tokenize("a.md", "[a][r] ![i](p.png)\n\n[r]: t.md\n\n````\n```\n````\n<!-- a\nb -->\nT\n==\n"))
    assert [(k, t, g) for k, _, t, g in md] == [("image", "i", "p.png"), ("link", "a", "t.md"), ("fence", "```", None), ("comment", "a\nb", None), ("heading", "T", None)]


def test_facts_of_languages():
    named = lambda file, text: {(r[2], r[4], r[3]) for r in facts.scan(file, text) if r[2] not in ("module", "literal")}
    assert named("a.py", "class A:\n    def b(self):\n        def c(): pass\nX = os.environ.get('E_V')\np.add_argument('--out', default=3)\n@app.get('/x')\ndef f(): pass\n") == {("type", "", "A"), ("method", "A", "b"), ("const", "", "X"), ("env", "", "E_V"), ("flag", "", "out"), ("route", "", "/x"), ("func", "", "f")}
    assert named("a.rs", 'pub struct S;\nimpl S {\n    pub fn go(&self) {\n        let x = 1;\n    }\n}\nfn top() {}\n') == {("type", "", "S"), ("method" if False else "func", "S", "go"), ("func", "", "top")}
    assert named("a.cs", "namespace N;\npublic class C {\n    public int Run(int a) {\n        return Call(a);\n    }\n}\n") - {("module", "", "N")} == {("type", "", "C"), ("method", "C", "Run")}
    assert named("a.h", "#define LIMIT 3\nint open_it(const char *p);\n") == {("macro", "", "LIMIT"), ("func", "", "open_it")}
    assert named("a.odin", "package g\nrun :: proc() {\n}\nT :: struct {\n}\n") == {("func", "", "run"), ("type", "", "T")}
    assert facts.scan("a.xyz", "x") == [] and facts.scan("a.go", "") == []


def test_recursive_facts(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "x")], "module string, target string")
    assert {(r.module, r.origin) for r in facts.reexport_closure(edges).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "a"), ("c", "a"), ("c", "b")}
    fields = spark.createDataFrame([("A", "x", None), ("A", "b", "B"), ("B", "y", None), ("B", "a", "A")], "type string, tag string, child string")
    assert sorted(r.key for r in facts.key_paths(fields, spark.createDataFrame([("A",)], "type string")).collect()) == ["b", "b.a", "b.y", "x"]


def test_examples_and_probes(spark):
    assert example_fault("func a() {\n\t...\n}") is None and example_fault("a(b]") == "] closes nothing" and example_fault('x := "a') == "a string is not closed" and example_fault("f({") == "{ is not closed"
    urls = spark.createDataFrame([("https://a.org/x",), ("https://a.org/x",), ("http://localhost:1/",), ("https://b.org/gone",), (None,)], "url string")
    probed = remote.probe(urls, lambda u: 404 if "gone" in u else 200)
    assert {(r.url, r.status) for r in probed.collect()} == {("https://a.org/x", 200), ("https://b.org/gone", 404)}
    assert [r.url for r in remote.broken(probed).collect()] == ["https://b.org/gone"]
    kept = spark.createDataFrame([("b1", 1), ("b3", 1)], "blob string, line int")
    wanted = spark.createDataFrame([("f", "b1"), ("g", "b2"), ("h", None)], "file string, blob string")
    assert [r.file for r in remote.missing_blobs(wanted, kept).collect()] == ["g"] and [r.blob for r in remote.keep_used(kept, wanted).collect()] == ["b1"]


def test_json_keys():
    assert repo.json_keys('{\n // c\n "a": {"b": [1, {"c": 2,}],\n "d": "x: {"}\n}') == {"a": 3, "a.b": 3, "a.b.c": 3, "a.d": 4}


def test_history_of_a_real_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.md").write_text("one\ntwo\n")
    run("add", "."), run("commit", "-qm", "first")
    run("mv", "a.md", "b.md"), run("commit", "-qm", "second")
    (tmp_path / "b.md").write_text("one\ntwo\nthree\n")
    assert {(r.file, r.subject) for r in repo.commits(spark, str(tmp_path)).collect()} == {("a.md", "first"), ("b.md", "second")}
    lines = {r.line: r.ts for r in repo.blame(spark, str(tmp_path), ["b.md"]).collect()}
    assert lines[1] is not None and lines[3] is None
    assert [(r.old, r.new) for r in repo.renames(spark, str(tmp_path)).collect()] == [("a.md", "b.md")]
    assert [r.path for r in repo.changed(spark, str(tmp_path)).collect()] == ["b.md"]
    assert repo.head(str(tmp_path)) and repo.head("/nowhere") is None and repo.commits(spark, "/nowhere").isEmpty()


def test_every_ignored_miss_is_dropped(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / ".gitignore").write_text("dist/\n")
    run("add", "."), run("commit", "-qm", "first")
    rows = [(f"dist/{n}.bin", "missing-path") for n in range(10_500)] + [("../x", "missing-path"), ("/etc/x", "missing-command"), ("src/a", "missing-path"), ("dist/7.bin", "missing-symbol"), (None, "missing-path")]
    found = spark.createDataFrame(rows, "norm string, rule string")
    kept = Engine(spark, str(tmp_path), Config())._unignored(found).collect()
    assert {(r.norm, r.rule) for r in kept} == set(rows[10_500:])


def test_streams(spark, tmp_path):
    schema = "finding_id bigint, repo string, rule string, file string, message string, severity string, run_at timestamp"
    old = spark.createDataFrame([(1, "r", "x", "a", "m", "error", None)], schema)
    old.unionByName(spark.createDataFrame([(2, "r", "x", "a", "n", "error", None)], schema)).write.parquet(str(tmp_path / "in"))
    from claimlake.functions import text as T

    frozen = old.withColumn("fingerprint", T.fingerprint("rule", "repo", "file", "message"))
    stream = incremental.stream_of(spark, str(tmp_path / "in"), schema)
    query = incremental.check_stream(stream, frozen, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert {(r.finding_id, r.baselined) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, True), (2, False)}
    assert incremental.severity_windows(old.withColumn("run_at", F.current_timestamp())).first().errors == 1


def test_every_rule_is_found(spark, tmp_path, monkeypatch):
    """One repository with a history in which each rule has its case."""
    day = lambda n: {"GIT_AUTHOR_DATE": f"2024-01-{n:02d}T00:00:00Z", "GIT_COMMITTER_DATE": f"2024-01-{n:02d}T00:00:00Z", "PATH": os.environ["PATH"], "HOME": str(tmp_path)}
    run = lambda n, *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, env=day(n))
    more = {
        "README.md": FILES["README.md"] + '\n## Extra 1\n\n`import` it:\n\n```go\nimport "example.org/widget/none"\n```\n\n```sh\n./scripts/none.sh\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nSee [out](https://dead.invalid.org/x) for 7.\n',
        "README-zh.md": "# Widget\n\n### More\n\n[x](docs/guide.md)\n\n```go\nother\n```\n\n| a |\n|---|\n| 1 |\n| 2 |\n",
        "docs/guide.md": "# Guide\n\n## Setup\n\nSee `pkg/srv/server.go`.\n", "docs/en/intro.md": "# A\n", "docs/zh/intro.md": "# A\n", "docs/en/extra.md": "# B\n", "docs/zh/old.md": "# C\n",
        "docs/en/code.md": "# D\n\n```sh\na\n```\n", "docs/zh/code.md": "# D\n\n```sh\nb\n```\n", "docs/en/table.md": "# E 5\n\n| a | b |\n|---|---|\n| 1 | 2 |\n", "docs/zh/table.md": "# E 6\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n",
    }
    for name, text in (FILES | more).items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    run(1, "init", "-q"), run(1, "add", "."), run(1, "commit", "-qm", "first")
    server, page = tmp_path / "pkg/srv/server.go", tmp_path / "docs/en/intro.md"
    for n in range(2, 6):
        server.write_text(server.read_text().replace("\treturn nil", f"\tstep{n}()\n\treturn nil"))
        page.write_text(page.read_text() + f"\nMore {n}.\n")
        run(n, "commit", "-qam", f"step {n}")
    monkeypatch.setattr("claimlake.plans.engine.remote.probe", lambda urls: urls.distinct().withColumn("status", F.lit(404)))
    engine = Engine(spark, str(tmp_path), Config(urls=True))
    found = report.rows_of(engine.findings)
    engine.close()
    assert {r["rule"] for r in found} == set(report.RULES)
    stale = {(r["rule"], r["file"]) for r in found if r["rule"].startswith("stale")}
    assert stale == {("stale-symbol", "README.md"), ("stale-section", "docs/guide.md"), ("stale-comment", "pkg/srv/server.go")}
