"""Relational operators on small tables, against plain Python."""

import datetime as dt
import itertools
import random

import pytest

from claimlake.operators import documents as D
from claimlake.operators import history as H
from claimlake.operators import ledger as L
from claimlake.operators import pairs as P
from claimlake.operators import similar as S

PAGE = ["# One", "see `a`", "", "```go", "# not", "x", "```", "## Two", "| a | b |", "|---|---|", "| 1 | 2 |", "| 3 | 4 |", "## Two", "<!-- claim-ignore -->", "", "hidden [x](y.md)", "end 1.2"]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("p", n, t) for n, t in enumerate(PAGE, 1)] + [("q", 1, "plain"), ("q", 2, None)], "path string, line int, text string")


def test_documents(spark, lines):
    heads = D.headings(lines)
    assert [(r.line, r.level, r.slug) for r in heads.orderBy("line").collect()] == [(1, 1, "one"), (8, 2, "two"), (13, 2, "two-1")]
    assert [(r.start_line, r.end_line, r.lang) for r in D.fences(lines).collect()] == [(4, 7, "go")]
    assert [(r.start_line, r.n_rows, r.n_cols) for r in D.table_shapes(lines).collect()] == [(9, 2, 2)]
    sections = {r.line: r.section for r in D.assign_sections(lines.where("path = 'p'"), heads).collect()}
    assert sections[2] == "One" and sections[8] == "Two" and sections[17] == "Two"
    ranges = {(r.path, r.start_line): r.end_line for r in D.section_ranges(heads, lines).collect()}
    assert ranges == {("p", 1): 7, ("p", 8): 12, ("p", 13): 17, ("q", 1): 2}
    covered = D.ignore_ranges(lines)
    assert [(r.from_line, r.to_line) for r in covered.collect()] == [(14, 16)]
    kept = D.drop_ignored(spark.createDataFrame([("p", 16, "r"), ("p", 17, "r"), ("p", 0, "r"), ("q", 16, "r")], "path string, line int, rule string"), covered)
    assert sorted((r.path, r.line) for r in kept.collect()) == [("p", 0), ("p", 17), ("q", 16)]
    digest = D.structure_digest(lines).where("path = 'p'").first()
    assert digest.levels == [1, 2, 2] and digest.links == ["y.md"] and digest.tables == ["2x2"]


def test_near_candidates_lose_nothing(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab_cde") for _ in range(rng.randint(0, 9))) for _ in range(120)})
    for most in (1, 2, 3):
        asked = spark.createDataFrame([(w, most) for w in words], "q string, most int")
        got = {tuple(r) for r in S.near_candidates(asked, spark.createDataFrame([(w,) for w in words], "c string")).collect()}
        want = {(a, b) for a, b in itertools.product(words, words) if S.osa(a, b) <= most}
        assert want <= got


def test_ranked_against_brute_force(spark):
    rng = random.Random(7)
    pool = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(3, 8))) for _ in range(80)})
    asked = [p[:-1] + "x" for p in pool[:25]] + ["", None]
    got = {(r.query, r.candidate): r["rank"] for r in S.ranked(spark.createDataFrame([(a,) for a in asked], "q string"), spark.createDataFrame([(p,) for p in [*pool, *pool, None]], "c string"), "q", "c").collect()}
    want = {}
    for a in {a for a in asked if a is not None}:
        hits = sorted((S.osa(a, p), not p.startswith(a[:3]), p) for p in pool if 0 < S.osa(a, p) <= max(2, len(a) // 4))
        want |= {(a, p): n for n, (_, _, p) in enumerate(hits[:3], 1)}
    assert got == want


def test_similar_paths_scores(spark):
    misses = spark.createDataFrame([("docs/Guide.md",), ("src/a/util.go",), ("src/utils.go",)], "path string")
    known = spark.createDataFrame([("docs/guide.md",), ("src/b/util.go",), ("src/util.java",)], "rel string")
    got = {(r.path, r.candidate): r.score for r in S.similar_paths(misses, known).collect()}
    assert got[("docs/Guide.md", "docs/guide.md")] == 0
    assert got[("src/a/util.go", "src/b/util.go")] == 102
    assert got[("src/a/util.go", "src/util.java")] == 2000
    assert got[("src/utils.go", "src/b/util.go")] == 1100


def ts(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def test_history(spark):
    blame = spark.createDataFrame([("d", 1, "h1", ts(0)), ("d", 2, "h2", ts(5)), ("d", 3, "h3", None), ("d", 4, "h1", ts(1))], "file string, line int, hash string, ts timestamp")
    ranges = spark.createDataFrame([("d", "a", 1, 2), ("d", "b", 3, 4), ("d", "c", 4, 4)], "path string, title string, start_line int, end_line int")
    times = H.section_times(ranges, blame)
    assert sorted((r.title, r.edited) for r in times.collect()) == [("a", ts(5)), ("c", ts(1))]
    refs = spark.createDataFrame([("d", 1, "f"), ("d", 2, "f"), ("d", 4, "g"), ("d", 1, None)], "path string, line int, file string")
    commits = spark.createDataFrame([("f", "c1", ts(5), "s"), ("f", "c2", ts(6), "s"), ("f", "c2", ts(6), "s"), ("g", "c3", ts(100), "s")], "file string, hash string, ts timestamp, subject string")
    files = H.section_files(ranges, refs)
    churn = {r.file: r.n_commits for r in H.section_churn(times, files, commits).collect()}
    assert churn == {"f": 1, "g": 1}
    assert [(r.rule, r.title, r.what) for r in H.stale_findings(times, files, commits).collect()] == [("stale-section", "c", "g")]
    renames = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("a", "x", 0), ("m", "n", 1), ("n", "m", 2)], "old string, new string, ts int")
    got = {r.old: r.new for r in H.collapse_renames(renames).collect()}
    assert (got["a"], got["b"], got["c"]) == ("d", "d", "d") and set(got) == {"a", "b", "c", "m", "n"}
    runs = H.run_lengths(blame)
    assert sorted((r.first, r.last) for r in runs.collect()) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_pairs(spark):
    paths = spark.createDataFrame([(p,) for p in ("README.md", "README-zh.md", "docs/en/a.md", "docs/zh/a.md", "docs/en/b.md", "docs/zh/old.md", "x.zh.md")], "path string")
    pairs = P.detect(paths)
    assert {(r.source, r.translation) for r in pairs.collect()} == {("README.md", "README-zh.md"), ("docs/en/a.md", "docs/zh/a.md")}
    assert {(r.rule, r.path) for r in P.gaps(paths, pairs).collect()} == {("pair-missing", "docs/en/b.md"), ("pair-orphan", "docs/zh/old.md")}
    digests = spark.createDataFrame(
        [("README.md", [1, 2], ["x"], ["l"], ["2x2"], ["1", "2"]), ("README-zh.md", [1, 3], ["y"], ["m"], ["2x3"], ["2", "3"])],
        "path string, levels array<int>, codes array<string>, links array<string>, tables array<string>, numbers array<string>",
    )
    got = {(r.rule, r.detail) for r in P.compare(pairs, digests).collect()}
    assert got == {("pair-heading", "#2 2 3"), ("pair-code", "#1 x y"), ("pair-link", "source l"), ("pair-link", "translation m"), ("pair-table", "#1 2x2 2x3"), ("pair-number", "source 1"), ("pair-number", "translation 3")}


def test_ledger(spark):
    rows = [("f1", "r", "a", 1, 1, "error", "m", None), ("f1", "r", "a", 9, 1, "error", "m", False), ("f2", "s", "b", 2, None, "INFO", "n", None), (None, "s", "b", 3, 1, None, "n", None)]
    findings = spark.createDataFrame(rows, "fingerprint string, rule string, file string, line int, col int, severity string, message string, baselined boolean")
    frozen = L.freeze(findings.where("fingerprint = 'f1'"))
    assert frozen.count() == 1
    applied = L.apply_baseline(findings, frozen)
    assert sorted(r.baselined for r in applied.collect()) == [False, False, True, True]
    assert L.summary(applied).first().asDict() == {"errors": 0, "warnings": 0, "infos": 1, "worst": 1}
    assert L.fails(findings).first().fails is True and L.fails(applied).first().fails is False and L.fails(findings, "none").first().fails is False
    assert [r.fingerprint for r in L.fixed_entries(findings.where("fingerprint = 'f2'"), frozen).collect()] == ["f1"]
    facts = spark.createDataFrame([("g", "p.A", "A"), ("g", "p.B", "B"), ("h", "p.A", "A")], "grp string, name string, alias string")
    said = spark.createDataFrame([("A",), ("p.Z",), (None,)], "name string")
    assert {(r.grp, r.total, r.documented, tuple(r.missing)) for r in L.coverage(facts, said).collect()} == {("g", 2, 1, ("p.B",)), ("h", 1, 1, ())}
    keys = spark.createDataFrame([("a",), ("a.b",), ("a.b.c",), ("a-b",), ("a.b.d",)], "key string")
    assert sorted(r.key for r in L.leaf_keys(keys).collect()) == ["a-b", "a.b.c", "a.b.d"]


def test_osa_of_many_pairs():
    rng = random.Random(3)
    words = ["".join(rng.choice("abé中") for _ in range(n)) for n in (0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 9, 12, 20, 63, 64, 64, 65, 90)]
    pairs = list(itertools.product(words, words))
    assert list(S.osa_many([a for a, _ in pairs], [b for _, b in pairs])) == [S.osa(a, b) for a, b in pairs]


def test_similar_symbols_against_brute_force(spark):
    rng = random.Random(11)
    bare = ["".join(rng.choice("abcdef_") for _ in range(rng.choice((4, 9, 13, 18, 26, 110)))) for _ in range(40)]

    def spoil(w, n):
        for _ in range(n):
            k = rng.randrange(len(w) - 1)
            w = rng.choice((w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "x" + w[k:], w[:k] + w[k + 1 :], w[:k] + "y" + w[k + 1 :]))
        return w

    pool = sorted({f"m{n % 3}.{w}" for n, w in enumerate(bare)})
    asked = sorted({f"m{n % 2}.{spoil(w, rng.randint(1, max(2, len(w) // 4)))}" for n, w in enumerate(bare)} | {"m0.encode_response_haeder", "m0.abdc"})
    pool += ["m1.encode_response_header", "m1.encode_request_header", "m1.bacd"]
    got = {(r["name"], r.candidate): (r.score, r["rank"]) for r in S.similar_symbols(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame([(p, True) for p in pool], "full_name string, exported boolean")).collect()}
    want = {}
    for a in asked:
        own, name = a.split(".")
        hits = [(S.osa(name, p.split(".")[1]) + 0.5 * (p.split(".")[0] != own), p) for p in pool if p != a and S.osa(name, p.split(".")[1]) <= max(2, len(name) // 4)]
        want |= {(a, p): (score, n) for n, (score, p) in enumerate(sorted(hits)[:3], 1)}
    assert got == want and got["m0.abdc", "m1.bacd"] == (2.5, 1)


def test_suggestions_of_long_names_in_query_and_check(spark, tmp_path):
    from claimlake.operators import resolve as R
    from claimlake.plans import driver_queries as Q

    known = spark.createDataFrame([("cfg.load_remote_configuration", True)], "full_name string, exported boolean")
    known.write.parquet(f"{tmp_path}/symbol_spans.parquet")
    spark.createDataFrame([(1, "Call `cfg.load_rmt_configuratoin` first.")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r["name"], r.candidate) for r in Q.similar_symbols(spark, str(tmp_path)).collect()] == [("cfg.load_rmt_configuratoin", "cfg.load_remote_configuration")]
    claim = lambda kind, norm: spark.createDataFrame([("a.md", 1, 1, kind, norm, norm, 3)], "path string, line int, col int, kind string, text string, norm string, confidence int")
    none = spark.createDataFrame([], "name string")
    keys = known.selectExpr("full_name AS key", "full_name AS full", "exported")
    assert R.symbols(claim("symbol", "cfg.load_rmt_configuratoin"), keys, none, none.withColumnRenamed("name", "key")).first().suggestion == "cfg.load_remote_configuration"
    assert R.config_keys(claim("config", "server.http.tmo_secs"), spark.createDataFrame([("server.http.timeout_secs",)], "key string"), none).first().suggestion == "server.http.timeout_secs"


def test_fences_close_with_their_own_marks(spark):
    page = ["~~~~", "```", "x", "~~~~", "# Head", "````sh", "```", "# no", "``````", "``` a`b", "text", "```go", "open"]
    lines = spark.createDataFrame([("p", n, t) for n, t in enumerate(page, 1)], "path string, line int, text string")
    assert [(r.start_line, r.end_line, r.lang) for r in D.fence_blocks(lines).orderBy("block").collect()] == [(1, 4, ""), (6, 9, "sh"), (12, None, "go")]
    assert [r.line for r in D.fence_marks(lines).where("not fenced").orderBy("line").collect()] == [5, 10, 11]
    assert [(r.line, r.slug) for r in D.headings(lines).collect()] == [(5, "head")]
    assert [(r.block, r.start_line, r.end_line) for r in D.fences(lines).orderBy("block").collect()] == [(1, 1, 4), (2, 6, 9), (3, 12, 13)]


def test_settled_operators_leave_one_table(spark):
    import glob

    from claimlake import session

    @session.settled("inner")
    def inner(rows):
        return session.materialise(session.materialise(rows, "one"), "two").where("id > 0")

    @session.settled("outer")
    def outer(rows):
        return inner(rows).unionByName(session.materialise(rows, "three"))

    @session.settled("broken")
    def broken(rows):
        session.materialise(rows, "four")
        raise ValueError("no")

    folder = session.shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(folder + "/claimlake-*"))
    rows = spark.range(3)
    assert outer(rows).count() == 5
    with pytest.raises(ValueError, match="no"):
        broken(rows)
    left = set(glob.glob(folder + "/claimlake-*")) - before
    assert len(left) == 1 and "claimlake-outer-" in left.pop()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_candidates_keep_every_pair_and_broadcast_no_rests(spark):
    rng = random.Random(5)
    known = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 20))) for _ in range(80)})

    def edited(text):
        letters = list(text)
        for _ in range(rng.randint(0, 2)):
            at, kind = rng.randint(0, max(0, len(letters) - 1)), rng.randint(0, 3)
            if kind == 0:
                letters.insert(at, "c")
            elif kind == 1 and letters:
                letters.pop(at)
            elif kind == 2 and letters:
                letters[at] = "c"
            elif at + 1 < len(letters):
                letters[at], letters[at + 1] = letters[at + 1], letters[at]
        return "".join(letters)

    asked = sorted({edited(k) for k in known for _ in range(5)})
    q, c = spark.createDataFrame([(a, 2) for a in asked], "q string, most int"), spark.createDataFrame([(k,) for k in known], "c string")
    met = S.near_candidates(q, c)
    got = {tuple(r) for r in met.collect()}
    assert got >= {(a, k) for a in asked for k in known if abs(len(a) - len(k)) <= 2 and S.osa(a, k) <= 2}
    assert got <= {(a, k) for a in asked for k in known if abs(len(a) - len(k)) <= 2}
    assert "Broadcast" not in plan_of(met)
