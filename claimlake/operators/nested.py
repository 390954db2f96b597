"""Deeply nested report payloads as related flat tables.

A report arrives as one JSON text: a SARIF log (``runs`` > ``results`` >
``locations``), a JSON report (``coverage`` > ``packages`` > ``missing``), or an
object holding both, inside wrappers that vary. The payload is parsed once into
a VARIANT; nested ``transform`` calls attach the positions of every ancestor,
``flatten`` joins the inner arrays, and one ``inline`` per target table emits
the rows. No shuffle, no Python: each report is handled where its row lies.

Defined results for odd input
-----------------------------
* null, empty, damaged (not one complete JSON value) payloads: no rows.
* a single value where a list is expected: a list of one.
* null list entries: keep their position, give no row, have no children.
* absent lists: no rows. Repeated deliveries: rows under each ``report_id``.
* a top-level list of several values: its first non-null value is the report.
* extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of an object that is a report (fixed values of the report format).
REPORT_KEYS = ("runs", "coverage", "sarif", "report", "summary")
#: Keys under which a delivery may carry its report, in order of preference.
WRAPPER_KEYS = ("body", "envelope", "content", "data", "payload", "message", "document", "result")
#: Wrappers that every payload is tried for; payloads with more of them are unwrapped to the end.
USUAL_WRAPPERS = 4


def _get(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _present(value: Column) -> Column:
    return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))


def _parse(text: Column) -> Column:
    """VARIANT of one complete JSON text, else null.

    ``try_parse_json`` stops after the first value, so the text goes into an array
    before a sentinel: only one whole value gives an array of exactly two.
    """
    clean = F.regexp_replace(text, "^[\\uFEFF\\s]+|\\s+$", "")
    boxed = F.try_parse_json(F.concat(F.lit("["), clean, F.lit(",0]")))
    items = _get(boxed, "$", "array<variant>")
    return F.when(F.size(items) == 2, F.get(items, F.lit(0)))


def _is_list(value: Column) -> Column:
    return _get(value, "$", "array<variant>").isNotNull()


def _is_report(value: Column) -> Column:
    known = F.lit(False)
    for key in REPORT_KEYS:
        known = known | _get(value, f"$.{key}").isNotNull()
    return known


def _is_wrapped(value: Column) -> Column:
    """Whether :func:`_unwrap_once` would take something off."""
    held = F.lit(False)
    for key in WRAPPER_KEYS:
        held = held | _present(_get(value, f"$.{key}"))
    return F.coalesce((F.schema_of_variant(value) == "STRING") | _is_list(value) | (~_is_report(value) & held), F.lit(False))


def _unwrap_once(value: Column) -> Column:
    """One wrapper less: a JSON text in a string, a list of one, or an object with a wrapper key."""
    items = _get(value, "$", "array<variant>")
    kind = F.schema_of_variant(value)
    known = _is_report(value)
    inner = F.coalesce(*[F.when(_present(_get(value, f"$.{k}")), _get(value, f"$.{k}")) for k in WRAPPER_KEYS])
    return (
        F.when(kind == "STRING", _parse(_get(value, "$", "string")))
        .when(items.isNotNull(), F.get(F.filter(items, _present), F.lit(0)))
        .when(known, value)
        .otherwise(F.coalesce(inner, value))
    )


def unwrap(payload: Column) -> Column:
    """The report object inside ``payload`` as VARIANT, or null.

    A wrapper takes two characters at least, so half the payload's length bounds how many there
    are. Only payloads still wrapped after the usual number are taken further, few steps first.
    """
    value = F.aggregate(F.sequence(F.lit(1), F.lit(USUAL_WRAPPERS)), _parse(payload), lambda v, _: _unwrap_once(v))
    step = lambda v, _: F.when(_is_wrapped(v), _unwrap_once(v)).otherwise(v)
    further = lambda n: lambda v: F.when(_is_wrapped(v), F.aggregate(F.array_repeat(F.lit(0), n), v, step)).otherwise(v)
    for steps in (F.lit(12), F.lit(200), F.floor(F.length(payload) / 2).cast("int")):
        value = F.get(F.transform(F.array(value), further(steps)), F.lit(0))
    return value


def as_list(value: Column) -> Column:
    """ARRAY<VARIANT>: the entries of a list, or a list of one for any other value that is not null."""
    return (
        F.when(_is_list(value), _get(value, "$", "array<variant>"))
        .when(_present(value), F.array(value))
        .otherwise(F.array().cast("array<variant>"))
    )


def _section(value: Column, key: str, own: str) -> Column:
    """The part named ``key`` of a combined report, or the report itself if it has ``own``."""
    part = _get(value, f"$.{key}")
    text = _get(part, "$", "string")
    part = F.when((F.schema_of_variant(part) == "STRING"), _parse(text)).otherwise(part)
    return F.when(_present(part), part).when(_get(value, f"$.{own}").isNotNull(), value)


def parse_reports(reports: DataFrame, id_col: str = "report_id", payload_col: str = "payload") -> DataFrame:
    """(report_id, runs ARRAY<VARIANT>, packages ARRAY<VARIANT>) of every report that is complete JSON."""
    opened = reports.select(F.col(id_col).alias("report_id"), unwrap(F.col(payload_col)).alias("v")).where("v is not null")
    parts = opened.select("report_id", _section(F.col("v"), "sarif", "runs").alias("sarif"), _section(F.col("v"), "report", "coverage").alias("rep"))
    return parts.select(
        "report_id",
        as_list(_get(F.col("sarif"), "$.runs")).alias("runs"),
        as_list(_get(F.col("rep"), "$.coverage.packages")).alias("packages"),
    )


def _records(items: Column) -> Column:
    return F.filter(items, lambda s: _present(s["v"]))


def _indexed(items: Column, *ancestors: tuple[str, Column], index: str) -> Column:
    """Structs (ancestor positions, own position, value) of a list's entries."""
    return F.transform(items, lambda v, n: F.struct(*[c.alias(k) for k, c in ancestors], n.cast("int").alias(index), v.alias("v")))


def _runs(runs: Column) -> Column:
    return _indexed(runs, index="i")


def _results(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r, i: _indexed(as_list(_get(r, "$.results")), ("i", i.cast("int")), index="j")))


def _locations(runs: Column) -> Column:
    def of_run(run: Column, i: Column) -> Column:
        return F.flatten(
            F.transform(
                as_list(_get(run, "$.results")),
                lambda res, j: _indexed(as_list(_get(res, "$.locations")), ("i", i.cast("int")), ("j", j.cast("int")), index="k"),
            )
        )

    return F.flatten(F.transform(runs, of_run))


def _missing(packages: Column) -> Column:
    return F.flatten(F.transform(packages, lambda p, i: _indexed(as_list(_get(p, "$.missing")), ("i", i.cast("int")), index="j")))


def _inline(parsed: DataFrame, array: Column) -> DataFrame:
    return parsed.select("report_id", F.inline(_records(array)))


def flatten_reports(reports: DataFrame, id_col: str = "report_id", payload_col: str = "payload") -> dict[str, DataFrame]:
    """The five related tables of all reports.

    ``runs``(report_id, i, tool, tool_version), ``results``(report_id, i, j, rule_id,
    level, message, baseline_state, fingerprint), ``locations``(report_id, i, j, k, uri,
    start_line, start_column), ``packages``(report_id, i, package, total, documented)
    and ``missing``(report_id, i, j, name). (report_id, i[, j[, k]]) is the key of a row
    and, without its last part, the key of its parent.
    """
    parsed = parse_reports(reports, id_col, payload_col)
    get = lambda path, kind: _get(F.col("v"), path, kind)
    runs = _inline(parsed, _runs(F.col("runs"))).select(
        "report_id", "i", get("$.tool.driver.name", "string").alias("tool"), get("$.tool.driver.version", "string").alias("tool_version")
    )
    results = _inline(parsed, _results(F.col("runs"))).select(
        "report_id", "i", "j",
        get("$.ruleId", "string").alias("rule_id"),
        get("$.level", "string").alias("level"),
        get("$.message.text", "string").alias("message"),
        get("$.baselineState", "string").alias("baseline_state"),
        F.to_json(get("$.partialFingerprints", "variant")).alias("fingerprints"),
    )
    locations = _inline(parsed, _locations(F.col("runs"))).select(
        "report_id", "i", "j", "k",
        get("$.physicalLocation.artifactLocation.uri", "string").alias("uri"),
        get("$.physicalLocation.region.startLine", "int").alias("start_line"),
        get("$.physicalLocation.region.startColumn", "int").alias("start_column"),
    )
    packages = _inline(parsed, _indexed(F.col("packages"), index="i")).select(
        "report_id", "i", get("$.package", "string").alias("package"), get("$.total", "bigint").alias("total"), get("$.documented", "bigint").alias("documented")
    )
    missing = _inline(parsed, _missing(F.col("packages"))).select("report_id", "i", "j", get("$", "string").alias("name"))
    return {"runs": runs, "results": results, "locations": locations, "packages": packages, "missing": missing}


def child_positions(reports: DataFrame, id_col: str = "report_id", payload_col: str = "payload") -> DataFrame:
    """(report_id, child, i, j, k): one row per location, package and missing name.

    The three arrays of positions are built beside each other and emitted by one
    ``inline``, so every payload is parsed once.
    """
    parsed = parse_reports(reports, id_col, payload_col)
    none = F.lit(-1)

    def positions(items: Column, child: str, j: bool, k: bool) -> Column:
        return F.transform(
            _records(items),
            lambda s: F.struct(F.lit(child).alias("child"), s["i"].alias("i"), (s["j"] if j else none).alias("j"), (s["k"] if k else none).alias("k")),
        )

    rows = F.concat(
        positions(_locations(F.col("runs")), "location", True, True),
        positions(_indexed(F.col("packages"), index="i"), "package", False, False),
        positions(_missing(F.col("packages")), "missing", True, False),
    )
    return parsed.select(F.col("report_id"), F.inline(rows)).distinct()
