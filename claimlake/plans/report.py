"""Findings as text, Markdown, JSON, SARIF, HTML, workflow annotations and JUnit.

The findings of one check are what a person reads; they are collected here, at the very end.
"""

from __future__ import annotations

import html
import json
import tempfile
from collections.abc import Callable
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.functions import text as T

TOOL = "claimlake"
RULES = {
    "missing-path": "a path that does not exist", "missing-command": "a script that does not exist", "missing-symbol": "a symbol that is not declared", "unknown-flag": "a flag that is not defined", "unknown-env": "a variable that is not read",
    "unknown-config-key": "a configuration key that is not known", "broken-anchor": "an anchor that does not exist", "broken-url": "a page that does not answer", "missing-import": "an import that does not resolve", "missing-route": "a route that is not registered",
    "missing-target": "a target that is not defined", "install-mismatch": "an install line with another name", "toolchain-mismatch": "a version the manifest does not state", "default-mismatch": "another default than the code's",
    "stale-section": "text older than the files it cites", "stale-symbol": "text older than the code it cites", "stale-comment": "a comment older than its code", "comment-mentions-missing": "a comment naming what does not exist",
    "pair-heading": "headings differ from the source page", "pair-code": "code differs from the source page", "pair-link": "links differ from the source page", "pair-table": "tables differ from the source page", "pair-number": "numbers differ from the source page",
    "pair-lag": "the source page is newer", "pair-missing": "a page without its translation", "pair-orphan": "a translation without its source", "undocumented": "an exported item no document names", "example-syntax": "an example that does not parse",
}
_COLUMNS = ("rule", "severity", "message", "file", "line", "col", "text", "suggestion", "fingerprint", "baselined")


def rows_of(findings: DataFrame) -> list[dict]:
    return [r.asDict() for r in findings.select(*_COLUMNS).collect()]


def _place(r: dict) -> str:
    return r["file"] + (f":{r['line']}" + (f":{r['col']}" if r["col"] else "") if r["line"] else "")


def _shown(rows: list[dict], info: bool) -> list[dict]:
    return [r for r in rows if not r["baselined"] and (info or r["severity"] != "info")]


def _counts(rows: list[dict]) -> dict[str, int]:
    return {s + "s": sum(r["severity"] == s and not r["baselined"] for r in rows) for s in ("error", "warning", "info")}


def text(rows: list[dict], info: bool = False) -> str:
    out = [f"{_place(r)}: {r['severity']} {r['rule']} {r['message']}" + (f" (did you mean {r['suggestion']}?)" if r["suggestion"] else "") for r in _shown(rows, info)]
    c = _counts(rows)
    return "\n".join([*out, f"{c['errors']:,} errors, {c['warnings']:,} warnings, {c['infos']:,} notes"]) + "\n"


def markdown(rows: list[dict], info: bool = True) -> str:
    cell = lambda s: str(s or "").replace("|", "\\|").replace("\n", " ")
    out = ["# Findings", ""]
    shown = _shown(rows, info)
    for file in dict.fromkeys(r["file"] for r in shown):
        out += [f"## {file}", "", "| Line | Severity | Rule | Finding | Suggestion |", "|-|-|-|-|-|"]
        out += [f"| {r['line']} | {r['severity']} | {r['rule']} | {cell(r['message'])} | {cell(r['suggestion'])} |" for r in shown if r["file"] == file] + [""]
    used = dict.fromkeys(r["rule"] for r in shown)
    fixes = [r for r in shown if r["suggestion"]]
    if fixes:
        out += ["## To fix", "", *(f"- [ ] {_place(r)}: `{r['text'] or r['rule']}` to `{r['suggestion']}`" for r in fixes), ""]
    return "\n".join([*out, "## Rules", "", *(f"* `{x}`: {RULES.get(x, x)}" for x in used), ""])


def as_json(rows: list[dict], info: bool = True, coverage: list[dict] | None = None) -> str:
    whole = {"version": 1, "summary": _counts(rows) | {"baselined": sum(bool(r["baselined"]) for r in rows)}, "findings": rows}
    if coverage is not None:
        whole["coverage"] = [{k: c[k] for k in ("grp", "total", "documented", "missing")} for c in coverage]
    return json.dumps(whole, indent=2, ensure_ascii=False) + "\n"


def sarif(rows: list[dict], info: bool = True) -> str:
    used = list(dict.fromkeys(r["rule"] for r in rows))
    level = {"error": "error", "warning": "warning", "info": "note"}
    results = [
        {
            "ruleId": r["rule"], "ruleIndex": used.index(r["rule"]), "level": level.get(r["severity"], "none"), "message": {"text": r["message"]}, "baselineState": "unchanged" if r["baselined"] else "new",
            "partialFingerprints": {"claim/v1": r["fingerprint"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}} | ({"region": {"startLine": r["line"]} | ({"startColumn": r["col"]} if r["col"] else {})} if r["line"] else {})}],
        }
        for r in rows
    ]
    rules = [{"id": x, "shortDescription": {"text": RULES.get(x, x)}} for x in used]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": TOOL, "rules": rules}}, "results": results}]}, indent=2) + "\n"


def as_html(rows: list[dict], info: bool = True) -> str:
    body = "".join(f"<tr class={quoteattr(r['severity'])}><td>{html.escape(_place(r))}</td><td>{r['severity']}</td><td>{r['rule']}</td><td>{html.escape(r['message'])}</td><td>{html.escape(r['suggestion'] or '')}</td></tr>" for r in _shown(rows, info))
    script = "for(const b of document.querySelectorAll('input'))b.onchange=()=>document.querySelectorAll('tr.'+b.value).forEach(t=>t.hidden=!b.checked)"
    boxes = "".join(f"<label><input type=checkbox checked value={s}>{s}</label> " for s in ("error", "warning", "info"))
    return f"<!doctype html><meta charset=utf-8><title>Findings</title><style>td{{padding:2px 8px}}.error{{color:#a00}}.warning{{color:#850}}</style><h1>Findings</h1><p>{boxes}</p><table>{body}</table><script>{script}</script>\n"


def github(rows: list[dict], info: bool = False) -> str:
    data = lambda s: str(s).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    prop = lambda s: data(s).replace(":", "%3A").replace(",", "%2C")
    level = {"error": "error", "warning": "warning"}
    return "".join(f"::{level.get(r['severity'], 'notice')} file={prop(r['file'])},line={r['line'] or 1},title={prop(r['rule'])}::{data(r['message'])}\n" for r in _shown(rows, info))


def junit(rows: list[dict], info: bool = True) -> str:
    cases: dict[tuple[str, str], list[dict]] = {}
    for r in rows:
        cases.setdefault((r["file"], r["rule"]), []).append(r)
    out, failures, skipped = [], 0, 0
    for (file, rule), own in cases.items():
        body = escape("\n".join(f"{r['line']}: {r['message']}" for r in own))
        if all(r["baselined"] or r["severity"] == "info" for r in own):
            skipped += 1
            inner = f"<skipped message={quoteattr(body.split(chr(10))[0])}/>"
        else:
            failures += 1
            inner = f"<failure message={quoteattr(own[0]['message'])}>{body}</failure>"
        out.append(f"<testcase classname={quoteattr(file)} name={quoteattr(rule)}>{inner}</testcase>")
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="{TOOL}" tests="{len(cases)}" failures="{failures}" skipped="{skipped}">' + "".join(out) + "</testsuite>\n"


FORMATS: dict[str, Callable[..., str]] = {"text": text, "md": markdown, "json": as_json, "sarif": sarif, "html": as_html, "github": github, "junit": junit}


def render(findings: DataFrame | list[dict], fmt: str = "text", info: bool = False, coverage: DataFrame | None = None) -> str:
    """A report of all findings; ``coverage`` (grp, total, documented, missing) goes into the JSON one."""
    rows = findings if isinstance(findings, list) else rows_of(findings)
    if fmt == "json" and coverage is not None:
        return as_json(rows, True, [r.asDict() for r in coverage.orderBy("grp").collect()])
    return FORMATS[fmt](rows, info or fmt not in ("text", "github"))


def write_directory(findings: DataFrame, folder: str) -> list[Path]:
    """Four reports, each replaced as a whole, in a folder that ignores itself."""
    rows, out = rows_of(findings), Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    ignore = out / ".gitignore"
    if not ignore.exists():
        ignore.write_text("*\n")
    written = []
    for name, fmt in (("report.md", "md"), ("report.json", "json"), ("report.sarif", "sarif"), ("report.html", "html")):
        with tempfile.NamedTemporaryFile("w", dir=out, delete=False, suffix=".part", encoding="utf-8") as part:
            part.write(FORMATS[fmt](rows, True))
        written.append(Path(part.name).replace(out / name))
    return written


def write_lines(findings: DataFrame, path: str) -> None:
    """The text report of any number of findings, written by the executors in report order."""
    line = F.concat_ws(" ", F.concat(T.position_text("file", "line", "col"), F.lit(":")), "severity", "rule", "message")
    findings.where("not baselined").select(line.alias("value")).write.mode("overwrite").text(path)
