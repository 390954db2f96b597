"""A repository as tables: files, documents, sources, manifests, version control."""

from __future__ import annotations

import json
import posixpath
import re
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions import text as T

DOC_GLOBS = ["**/*.md", "**/*.markdown", "**/*.rst", "**/*.adoc", "llms.txt"]
EXCLUDES = [".git/**", "node_modules/**", "vendor/**", "target/**", "dist/**", "build/**", ".venv/**", "__pycache__/**"]
_SOURCE_RX = r"[.](?:go|py|rs|jsx?|mjs|tsx?|cs|c|h|cc|cpp|hpp|odin)$"


def _relative(root: str) -> Column:
    prefix = "file:" + str(Path(root).resolve()).rstrip("/") + "/"
    return F.substring(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(len(prefix) + 1), F.lit(100_000))


def _scan(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(Path(root).resolve())).withColumn("rel", _relative(root))


def _excluded(rel: Column, excludes: list[str]) -> Column:
    return T.glob_matches(rel, [*excludes, *("**/" + e for e in excludes)])


def files(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """(rel, is_dir): every file and directory that is not excluded; contents are not read."""
    listed = _scan(spark, root).select("rel").where(~_excluded(F.col("rel"), excludes if excludes is not None else EXCLUDES))
    dirs = listed.select(F.explode(T.ancestors("rel")).alias("rel")).where("rel <> '.'").distinct()
    return listed.withColumn("is_dir", F.lit(False)).unionByName(dirs.withColumn("is_dir", F.lit(True)))


def documents(spark: SparkSession, root: str, include: list[str] | None = None, excludes: list[str] | None = None, max_mb: float = 4) -> DataFrame:
    """(path, text) of documents within the size cap; the length filter reaches the scan."""
    chosen = _scan(spark, root).where(F.col("length") <= int(max_mb * 1_048_576))
    chosen = chosen.where(T.glob_matches(F.lower("rel"), include or DOC_GLOBS) & ~_excluded(F.col("rel"), excludes if excludes is not None else EXCLUDES))
    return chosen.select(F.col("rel").alias("path"), F.decode("content", "UTF-8").alias("text"))


def skipped(spark: SparkSession, root: str, include: list[str] | None = None, excludes: list[str] | None = None, max_mb: float = 4) -> DataFrame:
    """(path, reason): documents that are not read: over the size cap, or not UTF-8 text."""
    most = int(max_mb * 1_048_576)
    chosen = _scan(spark, root).where(T.glob_matches(F.lower("rel"), include or DOC_GLOBS) & ~_excluded(F.col("rel"), excludes if excludes is not None else EXCLUDES))
    large = chosen.where(F.col("length") > most).select(F.col("rel").alias("path"), F.format_string("larger than %s MB", F.lit(str(max_mb))).alias("reason"))
    odd = chosen.where(F.col("length") <= most).where(~F.is_valid_utf8(F.col("content").cast("string"))).select(F.col("rel").alias("path"), F.lit("not UTF-8 text").alias("reason"))
    return large.unionByName(odd)


def excluded(spark: SparkSession, root: str, excludes: list[str] | None = None, max_mb: float = 4) -> DataFrame:
    """(rel): what exists but is not looked into: excluded files with their directories, and source files over the size cap."""
    every = _scan(spark, root)
    out = every.where(_excluded(F.col("rel"), excludes if excludes is not None else EXCLUDES)).select("rel")
    large = every.where((F.col("length") > int(max_mb * 1_048_576)) & F.col("rel").rlike(_SOURCE_RX)).select("rel")
    dirs = out.select(F.explode(T.ancestors("rel")).alias("rel")).where("rel <> '.'")
    return out.unionByName(dirs).unionByName(large).distinct()


def sources(spark: SparkSession, root: str, excludes: list[str] | None = None, max_mb: float = 4) -> DataFrame:
    """(file, text) of source files in a known language."""
    chosen = _scan(spark, root).where(F.col("length") <= int(max_mb * 1_048_576)).where(F.col("rel").rlike(_SOURCE_RX))
    return chosen.where(~_excluded(F.col("rel"), excludes if excludes is not None else EXCLUDES)).select(F.col("rel").alias("file"), F.decode("content", "UTF-8").alias("text"))


# --- manifests: a handful of small files of one repository, read on the driver ----------------


def project(root: str) -> dict:
    """Names, versions and targets that the manifests of a repository declare."""
    base = Path(root)
    out: dict = {"names": {}, "versions": {}, "targets": {}}
    read = lambda name: (base / name).read_text(errors="replace") if (base / name).is_file() else ""
    find = lambda rx, text: (m[1] if (m := re.search(rx, text, re.M)) else None)
    go, py, cargo, npm, cmake = read("go.mod"), read("pyproject.toml"), read("Cargo.toml"), read("package.json"), read("CMakeLists.txt")
    setup = read("setup.cfg")
    dotnet = next((p.read_text(errors="replace") for p in sorted(base.glob("**/*.csproj"))), "")
    out["module"] = find(r"^module\s+(\S+)", go)
    for tool, text, name_rx, version_rx in (
        ("go", go, r"^module\s+(\S+)", r"^go\s+(\S+)"), ("pip", py, r"^name\s*=\s*[\"']([^\"']+)", r"^requires-python\s*=\s*[\"']([^\"']+)"), ("cargo", cargo, r"^name\s*=\s*\"([^\"]+)", r"^rust-version\s*=\s*\"([^\"]+)"),
        ("cmake", cmake, r"project\(\s*(\w+)", r"cmake_minimum_required\(VERSION\s+([\d.]+)"), ("pip", setup, r"^name\s*=\s*(\S+)", r"^python_requires\s*=\s*(\S.*)"),
        ("dotnet", dotnet, r"<(?:PackageId|AssemblyName)>([^<]+)", r"<TargetFrameworks?>([^<;]+)"),
    ):
        if text:
            version = {"pip": "python", "cargo": "rust"}.get(tool, tool)
            out["names"][tool] = out["names"].get(tool) or find(name_rx, text)
            out["versions"][version] = out["versions"].get(version) or find(version_rx, text)
    if npm:
        try:
            data = json.loads(npm)
        except ValueError:
            data = {}
        out["names"]["npm"] = data.get("name")
        out["versions"]["node"] = (data.get("engines") or {}).get("node")
        out["targets"]["npm"] = sorted(data.get("scripts") or {})
        given = data.get("exports")
        out["exports"] = sorted(given) if isinstance(given, dict) and any(k.startswith(".") for k in given) else ["."] if given else []
    for tool, names in (("make", ("Makefile", "makefile", "GNUmakefile")), ("just", ("justfile", "Justfile")), ("task", ("Taskfile.yml", "Taskfile.yaml"))):
        text = next((t for n in names if (t := read(n))), "")
        if text:
            rx = r"^([A-Za-z0-9_.%/-]+)\s*:(?!=)" if tool == "make" else r"^([A-Za-z_][\w-]*)(?:\s+[^:=\n]*)?:(?!=)" if tool == "just" else r"^  ([\w:-]+):\s*$"
            out["targets"][tool] = sorted(set(re.findall(rx, text, re.M)) - {".PHONY"})
    if cmake:
        out["targets"]["cmake"] = sorted(set(re.findall(r"add_(?:executable|library|custom_target)\(\s*(\w+)", cmake)))
    out["names"] = {k: v for k, v in out["names"].items() if v}
    out["versions"] = {k: v for k, v in out["versions"].items() if v}
    return out


def json_keys(text: str) -> dict[str, int]:
    """Dotted keys of a JSON text with the line each begins on; comments, trailing commas and ``...`` are tolerated."""
    keys: dict[str, int] = {}
    stack: list[str | None] = []
    token = re.compile(r'"((?:\\.|[^"\\])*)"\s*(:)?|//[^\n]*|/\*.*?\*/|[{}\[\]]|\n', re.S)
    line, pending = 1, None
    for m in token.finditer(text):
        if m[0] == "\n":
            line += 1
        elif m[2]:
            pending = m[1]
            keys.setdefault(".".join([s for s in stack if s] + [m[1]]), line)
            line += m[0].count("\n")
        elif m[0] in "{[":
            stack.append(pending)
            pending = None
        elif m[0] in "}]":
            if stack:
                stack.pop()
            pending = None
        else:
            line += m[0].count("\n")
            pending = None if m[1] is not None else pending
    return keys


def sample_keys(spark: SparkSession, root: str, samples: list[str], excludes: list[str] | None = None) -> DataFrame:
    """(key): dotted keys of all sample files, whatever their size, read in tasks."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"key": sorted({k for text in batch["text"] for k in json_keys(text)})}, dtype=object)

    chosen = _scan(spark, root).where(F.array_contains(F.array(*[T.glob_matches("rel", [g], basename=False) for g in samples]), True) if samples else F.lit(False))
    chosen = chosen.where(~_excluded(F.col("rel"), excludes if excludes is not None else EXCLUDES))
    return chosen.select(F.decode("content", "UTF-8").alias("text")).mapInPandas(run, "key string").distinct()


# --- version control: one repository's history through its command line -------------------------


def _git(root: str, *args: str, timeout: float = 10) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def tracked(root: str, path: str) -> bool:
    """Whether version control knows a path."""
    return bool(_git(root, "ls-files", "--", path))


def blobs(spark: SparkSession, root: str) -> DataFrame:
    """(file, blob): the committed content of every tracked file that has not been changed since; others have none."""
    listed = _git(root, "ls-files", "-s", "-z", timeout=60) or ""
    dirty = set((_git(root, "diff", "--name-only", "--relative", "-z", "HEAD", timeout=60) or "").split("\0"))
    rows = [(name, None if name in dirty else info.split()[1]) for info, _, name in (x.partition("\t") for x in listed.split("\0") if x)]
    return spark.createDataFrame(rows, "file string, blob string")


def head(root: str) -> str | None:
    out = _git(root, "rev-parse", "HEAD")
    return out.strip() if out else None


def commits(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """(file, hash, ts, subject): one row per file a commit touches, later than ``since``, seen from ``root``; empty without version control."""
    out = _git(root, "log", "--relative", "--name-only", "--format=%x01%h%x02%ct%x02%s", *([f"--since={since}"] if since else []), timeout=120) or ""
    rows = []
    for block in out.split("\x01")[1:]:
        top, *names = block.strip("\n").split("\n")
        digest, seconds, subject = top.split("\x02", 2)
        rows += [(name, digest, int(seconds), subject) for name in names if name]
    frame = spark.createDataFrame(rows, "file string, hash string, s bigint, subject string")
    frame = frame.select("file", "hash", F.timestamp_seconds("s").alias("ts"), "subject")
    return frame.where(F.col("ts") > F.lit(since).cast("timestamp")) if since else frame  # the log's own bound includes its moment


def blame(spark: SparkSession, root: str, paths: list[str] | DataFrame) -> DataFrame:
    """(file, line, hash, ts): one subprocess per file, in tasks; ts is null for lines that are not committed. ``paths``: names, or a table with ``path``."""
    schema = "file string, line int, hash string, s bigint"

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch["file"]:
                digest, number, seconds = "", 0, None
                for line in (_git(root, "blame", "-w", "--line-porcelain", "--", path) or "").split("\n"):
                    m = re.match(r"^([0-9a-f]{40}) \d+ (\d+)", line)
                    if m:
                        digest, number, seconds = m[1], int(m[2]), None
                    elif line.startswith("committer-time "):
                        seconds = int(line.split()[1])
                    elif line.startswith("\t"):
                        rows.append((path, number, digest[:12], None if set(digest) == {"0"} else seconds))
            frame = pd.DataFrame(rows, columns=["file", "line", "hash", "s"])
            frame["s"] = frame["s"].astype("Int64")
            yield frame

    listed = paths.select(F.col("path").alias("file")) if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "file string")
    return listed.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, schema).select("file", "line", "hash", F.timestamp_seconds("s").alias("ts"))


def renames(spark: SparkSession, root: str) -> DataFrame:
    """(old, new, ts): renames in the history, for :func:`claimlake.operators.history.collapse_renames`."""
    out = _git(root, "log", "--relative", "--diff-filter=R", "--name-status", "-M", "--format=%x01%ct", timeout=120) or ""
    rows = []
    for block in out.split("\x01")[1:]:
        top, *lines = block.strip("\n").split("\n")
        rows += [(*line.split("\t")[1:3], int(top)) for line in lines if line.startswith("R") and line.count("\t") == 2]
    return spark.createDataFrame(rows, "old string, new string, ts bigint")


def changed(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """(path): changed against HEAD, untracked, and against ``base``; deleted files are not in it."""
    lists = [_git(root, "diff", "--relative", "--name-only", "--diff-filter=d", "HEAD"), _git(root, "ls-files", "--others", "--exclude-standard")]
    if base:
        lists.append(_git(root, "diff", "--relative", "--name-only", "--diff-filter=d", f"{base}...HEAD") or _git(root, "diff", "--relative", "--name-only", "--diff-filter=d", f"{base}..HEAD"))
    names = sorted({line for out in lists if out for line in out.split("\n") if line})
    return spark.createDataFrame([(n,) for n in names], "path string")


def ignored(root: str, rels: list[str]) -> set[str]:
    """Which of the paths version control ignores; one batched call, more if it stops at a path outside the repository."""
    rels = [p for p in rels if p and not posixpath.normpath(p).startswith("..")]
    try:
        done = subprocess.run(["git", "-C", root, "check-ignore", "-z", "--stdin"], input="\0".join(rels).encode(), capture_output=True, timeout=10, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return set()
    if done.returncode not in (0, 1) and len(rels) > 1:
        return ignored(root, rels[: len(rels) // 2]) | ignored(root, rels[len(rels) // 2 :])
    return {p for p in done.stdout.decode().split("\0") if p}


def ignored_names(names: DataFrame, root: str) -> DataFrame:
    """(norm): those of all names that version control ignores, asked batch by batch in tasks."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"norm": sorted(ignored(root, batch["norm"].tolist()))}, dtype=object)

    return names.where("norm is not null").select("norm").distinct().mapInPandas(run, "norm string")
