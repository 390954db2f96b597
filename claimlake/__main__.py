"""Command line: ``python -m claimlake COMMAND [ROOT]``. Exit 0 clean, 1 findings at or above the threshold, 2 misuse."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from claimlake import __version__


def root_of(start: str) -> str:
    """Climb to the folder with a configuration, a module file or version control."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if any((folder / mark).exists() for mark in (".claimlake.json", "go.mod", ".git")):
            return str(folder)
    return str(here)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="claimlake", description="Checks what documents claim against what a code base contains.")
    p.add_argument("command", choices=("check", "baseline", "coverage", "pairs", "comments", "fix", "explain", "index", "init", "version"))
    p.add_argument("target", nargs="*", help="ROOT; for explain: DOCUMENT [ROOT]; for index: KIND [ROOT]")
    p.add_argument("--format", default="text", choices=("text", "md", "json", "sarif", "html", "github", "junit"))
    p.add_argument("--output")
    p.add_argument("--out-dir")
    p.add_argument("--fail-on", choices=("error", "warning", "info", "none"))
    p.add_argument("--info", action="store_true")
    p.add_argument("--changed", action="store_true")
    p.add_argument("--since")
    p.add_argument("--write", action="store_true")
    p.add_argument("--no-git", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_intermixed_args(argv)
    except SystemExit as stop:
        return 2 if stop.code else 0
    if args.command == "version":
        print(__version__)
        return 0
    from claimlake.plans import engine as E
    from claimlake.plans import report

    first = args.target[:1] if args.command in ("explain", "index") else []
    rest = args.target[len(first) :]
    root = root_of(rest[0] if rest else ".")
    if args.command in ("explain", "index") and not first:
        print(f"{args.command} needs a name", file=sys.stderr)
        return 2
    run = None
    try:
        config = E.Config.load(root)
        if args.command == "init":
            print(config.save(root))
            return 0
        config.git = config.git and not args.no_git and args.command != "coverage"
        from claimlake.session import local_session

        # One repository is small: plans cost more than their rows, so they are neither compiled nor split much.
        spark = local_session(shuffle_partitions=2, spark__sql__codegen__wholeStage="false", spark__sql__codegen__factoryMode="NO_CODEGEN", spark__sql__adaptive__enabled="false")
        run = E.Engine(spark, root, config, changed_only=args.changed or bool(args.since), base=args.since)
        if args.command == "explain":
            for r in run.explain(first[0]).collect():
                print(f"{r.line}\t{r.kind}\t{r.confidence}\t{r.status}\t{r.text}\t{r.message if r.status == 'missing' else ''}")
            return 0
        if args.command == "index":
            table = run.index(first[0])
            print("\t".join(table.columns))
            for r in table.toLocalIterator():
                print("\t".join("" if v is None else str(v) for v in r))
            return 0
        if args.command == "coverage":
            rows = [r.asDict() for r in run.coverage.orderBy("grp").collect()]
            print(json.dumps(rows, indent=1) if args.format == "json" else "\n".join(f"{r['grp']}\t{r['documented']}/{r['total']}\t{', '.join(r['missing'][:10])}" for r in rows))
            return 0
        if args.command == "baseline":
            print(run.freeze())
            return 0
        if args.command == "fix":
            for e in run.apply_fixes(args.write):
                print(f"{e['file']}:{e['line']}: {e['old']} -> {e['new']}")
            return 0
        found = run.findings
        if args.command == "pairs":
            found = found.where("rule like 'pair-%'")
        if args.command == "comments":
            found = found.where("rule in ('stale-comment', 'comment-mentions-missing')")
        rows = report.rows_of(found)
        covered = run.coverage.unionByName(run.more_coverage) if args.format == "json" and config.coverage and args.command == "check" else None
        shown = report.render(rows, args.format, args.info, covered)
        for r in run.warnings.collect():  # documents of one repository that were left out
            print(f"warning: {r.path}: {r.reason}", file=sys.stderr)
        if args.output:
            Path(args.output).write_text(shown)
        else:
            print(shown, end="")
        if args.out_dir:
            report.write_directory(found, args.out_dir)
        least = {"error": 3, "warning": 2, "info": 1}.get(args.fail_on or config.fail_on, 99)
        rank = {"error": 3, "warning": 2, "info": 1}
        return int(any(not r["baselined"] and rank.get(r["severity"], 0) >= least for r in rows))
    except ValueError as wrong:
        print(wrong, file=sys.stderr)
        return 2
    finally:
        if run is not None:
            run.close()


if __name__ == "__main__":
    sys.exit(main())
