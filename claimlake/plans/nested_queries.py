"""Queries of problem 5: report payloads as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimlake.operators import nested


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/reports.parquet").select("report_id", "payload")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.child_positions(_reports(spark, sf_dir))


def _table(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.flatten_reports(_reports(spark, sf_dir))[name]

    return query


def p5_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent positions as -1, so that both engines' frames keep integers."""
    return nested.flatten_reports(_reports(spark, sf_dir))["locations"].na.fill(-1, ["start_line", "start_column"])


QUERIES = {"p5_found": p5_found, "p5_locations": p5_locations} | {f"p5_{name}": _table(name) for name in ("runs", "results", "packages", "missing")}

#: The report inside each payload, wrappers removed step by step.
_UNWRAPPED = """
WITH RECURSIVE opened(report_id, v, n) AS (
  SELECT report_id, CASE WHEN json_valid(p) THEN p::JSON END, 0
  FROM (SELECT report_id, trim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS p FROM reports) WHERE p <> ''
  UNION ALL
  SELECT report_id, CASE json_type(v)
      WHEN 'VARCHAR' THEN CASE WHEN json_valid(v->>'$') THEN (v->>'$')::JSON END
      WHEN 'ARRAY' THEN list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) <> 'NULL')[1]
      ELSE coalesce(
        {wrapped}) END, n + 1
  FROM opened WHERE v IS NOT NULL AND (json_type(v) IN ('VARCHAR', 'ARRAY') OR json_type(v) = 'OBJECT' AND {known} IS NULL AND coalesce({wrapped}) IS NOT NULL)
),
report AS (SELECT DISTINCT report_id, arg_max(v, n) OVER (PARTITION BY report_id) AS v FROM opened QUALIFY json_type(arg_max(v, n) OVER (PARTITION BY report_id)) = 'OBJECT'),
parts AS (
  SELECT report_id, CASE WHEN json_type(v->'$.sarif') = 'OBJECT' THEN v->'$.sarif' WHEN json_type(v->'$.runs') IS NOT NULL THEN v END AS s,
         CASE WHEN json_type(v->'$.report') = 'OBJECT' THEN v->'$.report' WHEN json_type(v->'$.coverage') IS NOT NULL THEN v END AS r
  FROM report
),
run AS (SELECT report_id, i, x FROM (SELECT report_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT report_id, {runs} AS l FROM parts))),
result AS (SELECT report_id, i, j, x FROM (SELECT report_id, i, unnest(l) AS x, unnest(range(len(l))) AS j FROM (SELECT report_id, i, {results} AS l FROM run))),
location AS (SELECT report_id, i, j, k, x FROM (SELECT report_id, i, j, unnest(l) AS x, unnest(range(len(l))) AS k FROM (SELECT report_id, i, j, {locations} AS l FROM result))),
package AS (SELECT report_id, i, x FROM (SELECT report_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT report_id, {packages} AS l FROM parts))),
missing AS (SELECT report_id, i, j, x FROM (SELECT report_id, i, unnest(l) AS x, unnest(range(len(l))) AS j FROM (SELECT report_id, i, {missing} AS l FROM package)))
"""


def _listed(value: str) -> str:
    return f"CASE json_type({value}) WHEN 'ARRAY' THEN json_extract({value}, '$[*]') WHEN 'NULL' THEN [] ELSE CASE WHEN {value} IS NULL THEN [] ELSE [{value}] END END"


_WITH = _UNWRAPPED.format(
    known="coalesce(" + ", ".join(f"v->'$.{k}'" for k in nested.REPORT_KEYS) + ")",
    wrapped=", ".join(f"CASE WHEN json_type(v->'$.{k}') <> 'NULL' THEN v->'$.{k}' END" for k in nested.WRAPPER_KEYS),
    runs=_listed("(s->'$.runs')"),
    results=_listed("(x->'$.results')"),
    locations=_listed("(x->'$.locations')"),
    packages=_listed("(r->'$.coverage.packages')"),
    missing=_listed("(x->'$.missing')"),
)
_REAL = "json_type(x) <> 'NULL'"

ORACLE = {
    "p5_found": f"""{_WITH}
SELECT DISTINCT report_id, 'location' AS child, i::INT AS i, j::INT AS j, k::INT AS k FROM location WHERE {_REAL}
UNION ALL SELECT DISTINCT report_id, 'package', i::INT, -1, -1 FROM package WHERE {_REAL}
UNION ALL SELECT DISTINCT report_id, 'missing', i::INT, j::INT, -1 FROM missing WHERE {_REAL}""",
    "p5_runs": f"{_WITH} SELECT report_id, i::INT AS i, x->>'$.tool.driver.name' AS tool, x->>'$.tool.driver.version' AS tool_version FROM run WHERE {_REAL}",
    "p5_results": f"""{_WITH} SELECT report_id, i::INT AS i, j::INT AS j, x->>'$.ruleId' AS rule_id, x->>'$.level' AS level, x->>'$.message.text' AS message,
  x->>'$.baselineState' AS baseline_state, (x->'$.partialFingerprints')::VARCHAR AS fingerprints FROM result WHERE {_REAL}""",
    "p5_locations": f"""{_WITH} SELECT report_id, i::INT AS i, j::INT AS j, k::INT AS k, x->>'$.physicalLocation.artifactLocation.uri' AS uri,
  coalesce((x->>'$.physicalLocation.region.startLine')::INT, -1) AS start_line, coalesce((x->>'$.physicalLocation.region.startColumn')::INT, -1) AS start_column FROM location WHERE {_REAL}""",
    "p5_packages": f"{_WITH} SELECT report_id, i::INT AS i, x->>'$.package' AS package, (x->>'$.total')::BIGINT AS total, (x->>'$.documented')::BIGINT AS documented FROM package WHERE {_REAL}",
    "p5_missing": f"{_WITH} SELECT report_id, i::INT AS i, j::INT AS j, x->>'$' AS name FROM missing WHERE {_REAL}",
}
