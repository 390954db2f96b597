"""The check of one repository, from its tree to ordered findings.

Dimensions first, extraction second, resolution as joins; then history, pairs, coverage, rule-scoped ignores,
baseline and order, in that sequence. What several steps read (documents, tokens, facts, claims, verdicts) is
written once to the shared folder and read back, so every later plan starts from a small table; :meth:`Engine.close`
deletes what was written.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions import text as T
from claimlake.operators import comments as C
from claimlake.operators import documents as D
from claimlake.operators import extract as X
from claimlake.operators import history as H
from claimlake.operators import ledger as L
from claimlake.operators import pairs as P
from claimlake.operators import resolve as R
from claimlake.session import materialise, remove_shared
from claimlake.sources import facts as S
from claimlake.sources import remote, repo, tokens

CONFIG_NAME = ".claimlake.json"
BASELINE_SCHEMA = "fingerprint string, rule string, file string, message string"


@dataclass
class Config:
    """Settings of a check; unknown keys in a file are errors."""

    docs: list[str] = field(default_factory=lambda: list(repo.DOC_GLOBS))
    exclude: list[str] = field(default_factory=lambda: list(repo.EXCLUDES))
    ignore: list[str] = field(default_factory=list)
    severity: dict[str, str] = field(default_factory=dict)
    config_samples: list[str] = field(default_factory=lambda: ["*.json", "**/appsettings.json"])
    max_file_mb: float = 4
    min_confidence: int = 1
    min_churn: int = 3
    min_days: int = 90
    git: bool = True
    coverage: bool = True
    urls: bool = False
    pairs: list[dict] = field(default_factory=list)
    cache: str = ""
    siblings: list[str] = field(default_factory=list)
    fail_on: str = "error"
    baseline: str = ".claimlake-baseline.json"

    @classmethod
    def load(cls, root: str) -> Config:
        path = Path(root, CONFIG_NAME)
        if not path.is_file():
            return cls()
        text = path.read_text()
        try:
            given = json.loads(text)
        except json.JSONDecodeError as wrong:
            raise ValueError(f"{path}:{wrong.lineno}: {wrong.msg}") from None
        if not isinstance(given, dict):
            raise ValueError(f"{path}:1: not an object")
        lines = repo.json_keys(text)
        unknown = sorted(set(given) - set(cls.__dataclass_fields__), key=lambda k: lines.get(k, 0))
        if unknown:
            raise ValueError(f"{path}:{lines.get(unknown[0], 1)}: unknown keys {', '.join(unknown)}")
        return cls(**given)

    def save(self, root: str) -> Path:
        path = Path(root, CONFIG_NAME)
        path.write_text(json.dumps(self.__dict__, indent=2) + "\n")
        return path


class Engine:
    """All tables of a check, built lazily; each is a DataFrame attribute."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, changed_only: bool = False, base: str | None = None):
        self.spark, self.root = spark, str(Path(root).resolve())
        self.config = config or Config.load(self.root)
        self.changed_only, self.base = changed_only, base
        self._written: list[str] = []

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        table = materialise(rows, f"check-{name}")
        self._written += table.inputFiles()[:1]
        return table

    def close(self) -> None:
        """Delete the tables this check has written."""
        for file in self._written:
            remove_shared(self.spark, file.rpartition("/")[0])
        self._written.clear()

    @cached_property
    def documents(self) -> DataFrame:
        return self._kept(repo.documents(self.spark, self.root, self.config.docs, self.config.exclude, self.config.max_file_mb), "documents")

    @cached_property
    def sources(self) -> DataFrame:
        return self._kept(repo.sources(self.spark, self.root, self.config.exclude, self.config.max_file_mb), "sources")

    @cached_property
    def lines(self) -> DataFrame:
        return D.explode_lines(self.documents, "path", "text")

    @cached_property
    def tokens(self) -> DataFrame:
        """One pass over the documents; kept, because every claim kind reads it."""
        return self._kept(tokens.token_table(self.documents), "tokens")

    @cached_property
    def facts(self) -> DataFrame:
        return self._kept(S.fact_table(self.sources), "facts")

    @cached_property
    def symbol_keys(self) -> DataFrame:
        return self._kept(S.symbol_keys(self.facts), "symbols")

    @cached_property
    def digests(self) -> DataFrame:
        return self._kept(D.structure_digest(self.lines), "digests")

    @cached_property
    def versioned(self) -> bool:
        return self.config.git and repo.head(self.root) is not None

    @cached_property
    def files(self) -> DataFrame:
        return self._kept(repo.files(self.spark, self.root, self.config.exclude), "files")

    @cached_property
    def project(self) -> dict:
        return repo.project(self.root)

    @cached_property
    def headings(self) -> DataFrame:
        """(path, line, level, title, slug) of all formats, from tokens."""
        from pyspark.sql import Window

        named = self.tokens.where("kind = 'heading'").select("path", "line", "level", F.col("text").alias("title"), F.coalesce("target", T.slug("text")).alias("base"))
        again = F.row_number().over(Window.partitionBy("path", "base").orderBy("line")) - 1
        return self._kept(named.select("path", "line", "level", "title", F.when(again == 0, F.col("base")).otherwise(F.concat_ws("-", "base", again)).alias("slug")), "headings")

    @cached_property
    def anchors(self) -> DataFrame:
        pages = self.documents.select("path", F.lit(None).cast("string").alias("slug"))
        labels = self.tokens.where("kind = 'label'").select("path", F.col("text").alias("slug"))
        return self.headings.select("path", "slug").unionByName(labels).unionByName(pages)

    @cached_property
    def config_keys(self) -> DataFrame:
        """Dotted keys of sample files and struct tags; every prefix is a key."""
        samples = repo.sample_keys(self.spark, self.root, self.config.config_samples, self.config.exclude)
        tags = self.facts.where("kind = 'tag'").select(F.col("owner").alias("type"), F.col("name").alias("tag"), F.col("value").alias("child"))
        roots = tags.select("type").distinct().join(tags.select(F.col("child").alias("type")).distinct(), "type", "left_anti")
        single = self.facts.where("kind in ('key', 'tag')").select(F.col("name").alias("key"))
        return self._kept(samples.unionByName(single).unionByName(S.key_paths(tags, roots)).distinct(), "keys")

    @cached_property
    def claims(self) -> DataFrame:
        toks, lines = self.tokens, self.lines
        if self.changed_only:
            changed = repo.changed(self.spark, self.root, self.base)
            toks, lines = H.changed_only(toks, changed), H.changed_only(lines, changed)
        return self._kept(X.claims(toks, lines, self.config.ignore, self.config_keys), "claims")

    @cached_property
    def verdicts(self) -> DataFrame:
        keys, facts = self.symbol_keys, self.facts
        for root in self.config.siblings:
            # What a package beside this repository exports is known, too.
            other = S.fact_table(repo.sources(self.spark, str(Path(self.root, root).resolve()), self.config.exclude, self.config.max_file_mb))
            keys = keys.unionByName(S.symbol_keys(other.where("exported")))
        heads = keys.select(F.regexp_extract("full", "^([A-Za-z_]\\w*)", 1).alias("head")).distinct()
        dims = {"files": self.files, "facts": facts, "symbol_keys": keys, "anchors": self.anchors, "config_keys": self.config_keys, "external": X.external_names(self.tokens, heads)}
        if self.versioned:
            dims["renames"] = H.collapse_renames(repo.renames(self.spark, self.root))
        dims["excluded"] = repo.excluded(self.spark, self.root, self.config.exclude, self.config.max_file_mb)
        if self.config.urls:
            dims["probed"] = remote.probe(self.claims.where("kind = 'url'").select(F.col("norm").alias("url")))
        return self._kept(R.resolve(self.claims, dims, self.project, self.config.min_confidence), "verdicts")

    @cached_property
    def pairs(self) -> DataFrame:
        given = self.spark.createDataFrame([(p["source"], p["translation"], p.get("lang", "")) for p in self.config.pairs], "source string, translation string, lang string") if self.config.pairs else None
        return self._kept(P.detect(self.documents.select("path"), explicit=given), "pairs")

    @cached_property
    def warnings(self) -> DataFrame:
        """(path, reason): documents that were not read."""
        return repo.skipped(self.spark, self.root, self.config.docs, self.config.exclude, self.config.max_file_mb)

    def _blame(self, names: DataFrame) -> DataFrame:
        """Line times of files; with a kept table only those of contents that it does not have yet are asked for."""
        if not self.config.cache:
            return self._kept(repo.blame(self.spark, self.root, names), "blame")
        folder = str(Path(self.root, self.config.cache).resolve())
        schema = "blob string, line int, hash string, ts timestamp"
        kept = self.spark.read.schema(schema).parquet(folder) if Path(folder).is_dir() else self.spark.createDataFrame([], schema)
        wanted = self._kept(repo.blobs(self.spark, self.root).join(names.select(F.col("path").alias("file")), "file", "left_semi"), "blobs")
        asked = remote.missing_blobs(wanted, kept).select("file").unionByName(wanted.where("blob is null").select("file"))
        fresh = self._kept(repo.blame(self.spark, self.root, asked.select(F.col("file").alias("path"))), "blame")
        known = fresh.join(wanted.where("blob is not null"), "file").select("blob", "line", "hash", "ts").unionByName(remote.keep_used(kept, wanted).select("blob", "line", "hash", "ts")).distinct()
        table = self._kept(known, "kept")
        table.write.mode("overwrite").parquet(folder)
        return table.join(wanted, "blob").select("file", "line", "hash", "ts").unionByName(fresh.join(wanted.where("blob is null"), "file", "left_semi"))

    def _with_ledger_columns(self, rows: DataFrame) -> DataFrame:
        """Findings without a claim: rule, severity, message, file, line and the parts of their identity in ``norm``."""
        return rows.select(
            "rule", "severity", "message", "file", F.col("line").cast("int").alias("line"), F.lit(0).alias("col"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("text"), "norm",
            F.lit(None).cast("string").alias("suggestion"), T.fingerprint("rule", "file", "norm").alias("fingerprint"), F.lit(False).alias("baselined"),
        )

    @cached_property
    def pair_findings(self) -> DataFrame:
        drift = P.compare(self.pairs, self.digests)
        level = F.when(F.col("rule") == "pair-number", "info").otherwise("warning")
        drift = drift.select("rule", level.alias("severity"), F.concat_ws(": ", F.lit("differs from its source"), "detail").alias("message"), F.col("path").alias("file"), F.lit(0).alias("line"), F.col("detail").alias("norm"))
        gap = P.gaps(self.documents.select("path"), self.pairs)
        gap = gap.select("rule", F.when(F.col("rule") == "pair-missing", "info").otherwise("warning").alias("severity"), F.concat(F.lit("no counterpart "), "counterpart").alias("message"), F.col("path").alias("file"), F.lit(0).alias("line"), F.col("counterpart").alias("norm"))
        return self._with_ledger_columns(drift.unionByName(gap))

    @cached_property
    def coverage(self) -> DataFrame:
        mentioned = L.mention_set(self.verdicts.where("kind in ('symbol', 'flag', 'env')")).select(F.col("norm").alias("name"))
        return L.coverage(self.surface, mentioned)

    @cached_property
    def stale_findings(self) -> DataFrame | None:
        """Sections older than the files they cite; None without version control."""
        if not self.versioned:
            return None
        ranges = D.section_ranges(self.headings, self.lines)
        refs = self.verdicts.where("status = 'ok' and kind = 'path'").select("path", "line", F.col("norm").alias("file"))
        refs = H.drop_mates(refs, self.pairs)
        bodies = self.doc_bodies.select(F.col("key").alias("norm"), "full_name", "file", "body_start", "body_end").distinct()
        cited = self.verdicts.where("status = 'ok' and kind = 'symbol'").select("path", "line", "norm").join(bodies, "norm").drop("norm")
        symbols = ranges.join(cited, "path").where(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("path", "title", "start_line", "full_name", "file", "body_start", "body_end").distinct()
        names = self.documents.select("path").unionByName(cited.select(F.col("file").alias("path"))).distinct()
        blame = self._blame(names)
        times = H.section_times(ranges, blame)
        rows = H.stale_findings(times, H.section_files(ranges, refs), repo.commits(self.spark, self.root), symbols, blame, min_churn=self.config.min_churn, min_days=self.config.min_days)
        message = F.format_string("section %s: %s changed in %d newer commits, last %s", F.col("title"), F.col("what"), F.col("n_commits"), F.date_format("latest", "yyyy-MM-dd"))
        return self._with_ledger_columns(rows.select("rule", F.lit("warning").alias("severity"), message.alias("message"), F.col("path").alias("file"), F.col("start_line").alias("line"), T.slug("title").alias("norm")))

    @cached_property
    def doc_bodies(self) -> DataFrame:
        """(key, full_name, file, body_start, body_end): where the body of each spelling of a function lies."""
        bodies = self.facts.where("kind in ('func', 'method', 'type')").select("file", "line", F.col("line").alias("body_start"), F.col("end_line").alias("body_end"))
        return self.symbol_keys.join(bodies, ["file", "line"]).select("key", F.col("full").alias("full_name"), "file", "body_start", "body_end")

    @cached_property
    def comment_findings(self) -> DataFrame:
        """Comments naming what does not exist, and with version control comments older than their code."""
        spans = self._kept(S.doc_spans(self.sources), "spans")
        beside = None
        for root in self.config.siblings:
            words = C.words_of(repo.sources(self.spark, str(Path(self.root, root).resolve()), self.config.exclude, self.config.max_file_mb))
            beside = words if beside is None else beside.unionByName(words)
        named = C.mentions(spans, self.sources, self.symbol_keys, self.facts.where("kind = 'literal'"), beside)
        rows = named.select(F.lit("comment-mentions-missing").alias("rule"), F.lit("warning").alias("severity"), F.format_string("comment of %s names %s", "full_name", "token").alias("message"), "file", "line", F.concat_ws("|", "full_name", "token").alias("norm"))
        if self.versioned:
            old = H.stale_comments(spans.where("exported"), repo.blame(self.spark, self.root, spans.select(F.col("file").alias("path")).distinct()))
            rows = rows.unionByName(old.select(F.lit("stale-comment").alias("rule"), F.lit("info").alias("severity"), F.format_string("comment of %s is older than %d of %d lines", "full_name", "newer_lines", "body_lines").alias("message"), "file", F.col("decl_line").alias("line"), F.col("full_name").alias("norm")))
        return self._with_ledger_columns(rows)

    @cached_property
    def example_findings(self) -> DataFrame:
        rows = C.example_faults(self.tokens)
        return self._with_ledger_columns(rows.select(F.lit("example-syntax").alias("rule"), F.lit("warning").alias("severity"), F.concat(F.lit("example does not parse: "), "fault").alias("message"), F.col("path").alias("file"), "line", F.col("fault").alias("norm")))

    @cached_property
    def lag_findings(self) -> DataFrame | None:
        if not self.versioned:
            return None
        rows = P.lag(self.pairs, repo.commits(self.spark, self.root))
        message = F.format_string("source has %d newer commits: %s", F.col("n_newer"), F.array_join("subjects", "; "))
        return self._with_ledger_columns(rows.select(F.lit("pair-lag").alias("rule"), F.lit("warning").alias("severity"), message.alias("message"), F.col("translation").alias("file"), F.lit(0).alias("line"), F.lit("lag").alias("norm")))

    @cached_property
    def undocumented_findings(self) -> DataFrame:
        """What others may use and no document mentions, one note each."""
        said = L.mention_set(self.verdicts.where("kind in ('symbol', 'flag', 'env')")).select(F.col("norm").alias("name"))
        surface = self.surface
        rows = L.undocumented(L.coverage(surface, said), surface)
        return self._with_ledger_columns(rows.select("rule", "severity", F.format_string("%s is not mentioned in any document", F.col("name")).alias("message"), "file", "line", F.concat_ws("|", "grp", "name").alias("norm")))

    @cached_property
    def surface(self) -> DataFrame:
        out = S.exported_surface(self.facts)
        return out.withColumns({"name": F.when(F.col("kind") == "flag", T.flag_key("name")).otherwise(F.col("name")), "alias": F.when(F.col("kind") == "flag", T.flag_key("alias")).otherwise(F.col("alias"))})

    @cached_property
    def more_coverage(self) -> DataFrame:
        """(grp, total, documented, missing) of routes and leaf configuration keys, all languages."""
        said = self.verdicts.where("status = 'ok'")
        split = lambda c: F.regexp_replace(c, "^[A-Z]+ ", "")
        method = lambda c: F.nullif(F.regexp_extract(c, "^([A-Z]+) ", 1), F.lit(""))
        routes = self.facts.where("kind = 'route'").select(F.coalesce(method(F.col("name")), "value").alias("method"), F.col("name").alias("path"), T.route_segments(split(F.col("name"))).alias("segs"))
        asked = said.where("kind = 'route'").select(method(F.col("norm")).alias("method"), T.route_segments(split(F.col("norm"))).alias("segs"))
        r = L.route_coverage(routes, asked).select(F.lit("routes").alias("grp"), F.col("path").alias("name"), "documented")
        keys = L.leaf_keys(self.config_keys)
        k = keys.join(said.select(F.col("norm").alias("key")).distinct().withColumn("hit", F.lit(True)), "key", "left").select(F.lit("config").alias("grp"), F.col("key").alias("name"), F.col("hit").isNotNull().alias("documented"))
        both = r.unionByName(k)
        return both.groupBy("grp").agg(F.count("*").alias("total"), F.count_if("documented").alias("documented"), F.array_sort(F.collect_list(F.when(~F.col("documented"), F.col("name")))).alias("missing"))

    @cached_property
    def baseline(self) -> DataFrame:
        path = Path(self.root, self.config.baseline)
        if not path.is_file():
            return self.spark.createDataFrame([], BASELINE_SCHEMA)
        data = json.loads(path.read_text())
        if data.get("version") != 1:
            raise ValueError(f"{path}: unknown version {data.get('version')!r}")
        return self.spark.createDataFrame([(e.get("fingerprint"), e.get("rule"), e.get("file"), e.get("message")) for e in data.get("entries", [])], BASELINE_SCHEMA)

    @cached_property
    def findings(self) -> DataFrame:
        """Ordered findings after ignores, severity overrides and the baseline."""
        parts = [self._unignored(R.findings(self.verdicts)), self.comment_findings, self.example_findings, self.pair_findings]
        parts += [p for p in (self.stale_findings, self.lag_findings) if p is not None]
        if self.config.coverage:
            parts.append(self.undocumented_findings)
        parts = [self._kept(p, "findings") for p in parts]
        every = reduce(DataFrame.unionByName, parts)
        ranges = D.ignore_ranges(self.lines)
        every = D.drop_ignored(every.withColumnRenamed("file", "path"), ranges).withColumnRenamed("path", "file")
        for rule, level in self.config.severity.items():
            every = every.where(F.col("rule") != rule) if level == "off" else every.withColumn("severity", F.when(F.col("rule") == rule, level).otherwise(F.col("severity")))
        return L.apply_baseline(every, self.baseline).orderBy(*L.report_order())

    def _unignored(self, found: DataFrame) -> DataFrame:
        """Missing paths that version control ignores are no findings."""
        if not self.versioned:
            return found
        hidden = repo.ignored_names(found.where("rule in ('missing-path', 'missing-command')"), self.root)
        return found.join(hidden, found["norm"].eqNullSafe(hidden["norm"]) & found["rule"].isin("missing-path", "missing-command"), "left_anti")

    def explain(self, document: str) -> DataFrame:
        """Every claim of one document with its verdict."""
        return self.verdicts.where(F.col("path") == document).select("line", "kind", "confidence", "status", "text", "message").orderBy("line", "kind", "text")

    def freeze(self) -> Path:
        """Write the baseline: one entry per fingerprint, sorted."""
        rows = L.freeze(self.findings).orderBy("file", "rule", "fingerprint").collect()
        path = Path(self.root, self.config.baseline)
        path.write_text(json.dumps({"version": 1, "entries": [r.asDict() for r in rows]}, indent=1) + "\n")
        return path

    def fixes(self) -> DataFrame:
        """Mechanical replacements of paths by their suggestions."""
        return L.fix_plan(self.findings.where("rule in ('missing-path', 'broken-anchor')").withColumn("fix", F.col("suggestion")))

    def apply_fixes(self, write: bool = False) -> list[dict]:
        """Apply the plan, right to left on each line; line ends and the last newline stay as they are."""
        edits = [r.asDict() for r in self.fixes().collect()]
        for file in sorted({e["file"] for e in edits}):
            path = Path(self.root, file)
            parts = path.read_bytes().decode("utf-8", "surrogateescape").split("\n")
            for e in sorted((e for e in edits if e["file"] == file), key=lambda e: (-e["line"], -e["col"])):
                row = parts[e["line"] - 1]
                at = row.find(e["old"], max(0, len(row.encode()[: e["col"] - 1].decode("utf-8", "ignore")) - 1))
                e["done"] = at >= 0
                if at >= 0:
                    parts[e["line"] - 1] = row[:at] + e["new"] + row[at + len(e["old"]) :]
            if write:
                path.write_bytes("\n".join(parts).encode("utf-8", "surrogateescape"))
        return edits

    def index(self, kind: str) -> DataFrame:
        """One of the tables a check is built from, in order."""
        tables = {
            "files": lambda: self.files.orderBy("rel"), "symbols": lambda: self.facts.where(F.col("kind").isin(*S.SYMBOL_KINDS)).orderBy("file", "line"), "anchors": lambda: self.anchors.where("slug is not null").orderBy("path", "slug"),
            "config": lambda: self.config_keys.orderBy("key"), "pairs": lambda: self.pairs.orderBy("source", "translation"), "claims": lambda: self.claims.orderBy("path", "line", "col"),
        } | {k + "s": (lambda k=k: self.facts.where(F.col("kind") == k).select("name", "value", "file", "line").distinct().orderBy("name", "file", "line")) for k in ("flag", "env", "route", "literal")}
        if kind not in tables:
            raise ValueError(f"unknown kind {kind}; one of {', '.join(sorted(tables))}")
        return tables[kind]()
