"""Scans of a repository: what is left out, manifests, version control, kept line times; report parts."""

import json
import subprocess

import pytest

from claimlake.operators import pairs as P
from claimlake.operators import resolve as R
from claimlake.plans import report
from claimlake.plans.engine import Config, Engine
from claimlake.sources import repo


@pytest.fixture
def tree(tmp_path):
    def make(**files):
        for name, text in files.items():
            path = tmp_path / name.replace("__", "/")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(tmp_path)

    return make


def test_documents_left_out_are_named(spark, tree):
    root = tree(**{"a.md": "ok", "big.md": "x" * 3000, "odd.md": b"\xff\xfe\xfa", "build__c.md": "no"})
    got = {r.path: r.reason for r in repo.skipped(spark, root, max_mb=0.002).collect()}
    assert set(got) == {"big.md", "odd.md"} and "larger" in got["big.md"]


def test_excluded_paths_are_not_missing(spark, tree):
    root = tree(**{"README.md": "`build/out/x.txt` `build/none.txt` `huge.go`", "build__out__x.txt": "1", "huge.go": "package p\n" + "//" * 2000})
    beyond = repo.excluded(spark, root, max_mb=0.002)
    assert {r.rel for r in beyond.collect()} == {"build/out/x.txt", "build/out", "build", "huge.go"}
    claims = spark.createDataFrame([("README.md", 1, 1, "path", n, n, 3, 1) for n in ("build/out/x.txt", "build/none.txt", "huge.go")], "path string, line int, col int, kind string, text string, norm string, confidence int, pass int")
    files = repo.files(spark, root).where("rel <> 'huge.go'")
    assert {r.norm: r.status for r in R.paths(claims, files, excluded=beyond).collect()} == {"build/out/x.txt": "skipped", "build/none.txt": "missing", "huge.go": "skipped"}


def test_more_manifests(tree):
    root = tree(**{"setup.cfg": "[metadata]\nname = tool\npython_requires = >=3.9\n", "src__a.csproj": "<Project><TargetFramework>net8.0</TargetFramework><PackageId>My.Api</PackageId></Project>", "package.json": json.dumps({"name": "web", "exports": {".": "./a.js", "./server": "./s.js", "./lib/*": "./l/*.js"}}), "Makefile": "build-%: x\n\ty\ntest:\n\tz\n"})
    got = repo.project(root)
    assert got["names"] == {"pip": "tool", "dotnet": "My.Api", "npm": "web"} and got["versions"] == {"python": ">=3.9", "dotnet": "net8.0"}
    assert got["exports"] == [".", "./lib/*", "./server"] and "build-%" in got["targets"]["make"]


def test_exports_and_pattern_rules(spark):
    claims = lambda kind, *norms: spark.createDataFrame([("a.md", 1, 1, kind, n, n, 3, 1) for n in norms], "path string, line int, col int, kind string, text string, norm string, confidence int, pass int")
    project = {"names": {"npm": "web"}, "versions": {}, "targets": {"make": ["build-%", "test"]}, "exports": [".", "./lib/*", "./server"]}
    files = spark.createDataFrame([("x/y.ts", False)], "rel string, is_dir boolean")
    got = {r.norm: r.status for r in R.imports(claims("import", "js:web", "js:web/server", "js:web/lib/a", "js:web/nope", "js:react"), files, project).collect()}
    assert got == {"js:web": "ok", "js:web/server": "ok", "js:web/lib/a": "ok", "js:web/nope": "missing", "js:react": "skipped"}
    loose = {r.norm: r.status for r in R.imports(claims("import", "js:web/x/y", "js:web/z"), files, project | {"exports": []}).collect()}
    assert loose == {"js:web/x/y": "ok", "js:web/z": "missing"}
    none = spark.createDataFrame([], "kind string, name string, value string, file string, line int")
    targets = {r.norm: r.status for r in R.project_claims(claims("target", "make:build-all", "make:test", "make:deploy"), project, none).collect()}
    assert targets == {"make:build-all": "ok", "make:test": "ok", "make:deploy": "missing"}


def test_configuration_errors_name_their_line(tree):
    with pytest.raises(ValueError, match=r"\.claimlake\.json:3: unknown keys docz"):
        Config.load(tree(**{".claimlake.json": '{\n "git": false,\n "docz": []\n}'}))
    with pytest.raises(ValueError, match=r"\.claimlake\.json:2:"):
        Config.load(tree(**{".claimlake.json": '{\n "git": fals\n}'}))


def test_pairs_that_are_given(spark):
    paths = spark.createDataFrame([("a.md",), ("a-zh.md",), ("x/b.md",), ("y/c.md",)], "path string")
    given = spark.createDataFrame([("x/b.md", "y/c.md", "de"), ("x/b.md", "a-zh.md", "zh"), ("a.md", "none.md", "zh")], "source string, translation string, lang string")
    assert {tuple(r) for r in P.detect(paths, explicit=given).collect()} == {("x/b.md", "y/c.md", "de"), ("x/b.md", "a-zh.md", "zh")}


def test_links_that_differ_by_language_only(spark):
    rows = [("docs/a.md", ["a-zh.md", "../docs/en/guide.md#x", "img/p.png", "only.md"]), ("docs/a-zh.md", ["a.md", "../docs/zh/guide.md#x", "img/p.png"])]
    digests = spark.createDataFrame([(p, [], [], x, [], []) for p, x in rows], "path string, levels array<int>, codes array<string>, links array<string>, tables array<string>, numbers array<string>")
    pairs = spark.createDataFrame([("docs/a.md", "docs/a-zh.md")], "source string, translation string")
    assert [r.detail for r in P.compare(pairs, digests).collect()] == ["source only.md"]


def test_report_parts(spark):
    rows = [{"rule": "missing-path", "severity": "error", "message": "m", "file": "a.md", "line": 3, "col": 0, "text": "x.md", "suggestion": "y.md", "fingerprint": "f", "baselined": False}]
    assert "- [ ] a.md:3: `x.md` to `y.md`" in report.render(rows, "md")
    covered = spark.createDataFrame([("flags", 2, 1, ["b"])], "grp string, total bigint, documented bigint, missing array<string>")
    assert json.loads(report.render(rows, "json", coverage=covered))["coverage"] == [{"grp": "flags", "total": 2, "documented": 1, "missing": ["b"]}]


def test_history_below_a_prefix_and_kept_times(spark, tree, monkeypatch):
    root = tree(**{"top.md": "x\n", "sub__doc.md": "# A\n\none\n", "sub__code.go": "package p\n"})
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q"), run("add", "."), run("commit", "-qm", "first")
    assert {r.file for r in repo.commits(spark, root + "/sub").collect()} == {"doc.md", "code.go"}
    assert repo.commits(spark, root, since="2100-01-01").isEmpty() and repo.tracked(root, "top.md") and not repo.tracked(root, "none.md")
    engine = Engine(spark, root, Config(cache=".kept"))
    names = spark.createDataFrame([("top.md",), ("sub/doc.md",)], "path string")
    first = {(r.file, r.line) for r in engine._blame(names).collect()}
    assert first == {("top.md", 1), ("sub/doc.md", 1), ("sub/doc.md", 2), ("sub/doc.md", 3)}
    asked = []
    real = repo.blame
    monkeypatch.setattr(repo, "blame", lambda s, r, paths: asked.extend(x.path for x in paths.collect()) or real(s, r, paths))
    (tree(**{"top.md": "x\ny\n"}))
    assert {(r.file, r.line) for r in engine._blame(names).collect()} == first | {("top.md", 2)} and asked == ["top.md"]
    engine.close()
