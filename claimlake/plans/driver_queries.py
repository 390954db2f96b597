"""Queries that run the core operators over the driver's tables, with their SQL.

Every query names the operators it exercises in its docstring or its registration;
arrays are joined to texts, so that both engines' frames compare plainly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions import text as T
from claimlake.operators import documents as D
from claimlake.operators import history as H
from claimlake.operators import ledger as L
from claimlake.operators import pairs as P
from claimlake.operators import similar as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Page lines, rescans folded, carriage returns gone."""
    raw = _t(spark, d, "doc_lines").where("path is not null and line is not null")
    return raw.groupBy("path", "line").agg(F.regexp_replace(F.max(F.coalesce("text", F.lit(""))), "\\r$", "").alias("text"))


_LINES = "lines AS (SELECT path, line, regexp_replace(max(coalesce(text, '')), '\\r$', '') AS text FROM doc_lines WHERE path IS NOT NULL AND line IS NOT NULL GROUP BY path, line)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, line, name): code spans of documents, one row per line and name."""
    lines = D.explode_lines(_t(spark, d, "documents").where("doc_id is not null"), "doc_id", "text")
    return lines.select("doc_id", "line", F.explode(T.code_spans("text")).alias("name")).distinct()


_SPANS = """raw_lines AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n')) AS t,
    unnest(range(1, len(string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n')) + 1)) AS line FROM documents WHERE text IS NOT NULL),
  spans AS (SELECT DISTINCT doc_id, line::INT AS line, unnest(regexp_extract_all(t, '`([^`\\n]+)`', 1)) AS name FROM raw_lines)"""


# --- documents -------------------------------------------------------------------------


@_query("SELECT doc_id, count(*) AS n_lines, sum(length(t))::BIGINT AS n_chars, max(length(t)) AS longest FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n')) AS t FROM documents WHERE text IS NOT NULL) GROUP BY doc_id")
def doc_lines_split(spark: SparkSession, d: str) -> DataFrame:
    lines = D.explode_lines(_t(spark, d, "documents"), "doc_id", "text")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"), F.max(F.length("text")).alias("longest"))


def fence_sql(indent: str = " {0,3}") -> str:
    """SQL for ``lines`` (path, line, text) as ``marked``: the state of the fences, mark by mark, by recursion."""
    rx = f"^{indent}(`{{3,}}|~{{3,}})(.*)$"
    return f"""marks AS (SELECT path, line, substring(m, 1, 1) AS ch, length(m) AS n, regexp_replace(info, '^\\s+|\\s+$', '', 'g') AS info, row_number() OVER (PARTITION BY path ORDER BY line) AS k
    FROM (SELECT path, line, regexp_extract(text, '{rx}', 1) AS m, regexp_extract(text, '{rx}', 2) AS info FROM lines) WHERE m <> ''),
  walk(path, k, line, ch, n, act, lang) AS (
    SELECT path, k, line, CASE WHEN ch = '`' AND contains(info, '`') THEN '' ELSE ch END, n, CASE WHEN ch = '`' AND contains(info, '`') THEN 0 ELSE 1 END, regexp_extract(info, '^([A-Za-z0-9_+-]*)', 1) FROM marks WHERE k = 1
    UNION ALL
    SELECT m.path, m.k, m.line, CASE WHEN w.ch = '' THEN CASE WHEN m.ch = '`' AND contains(m.info, '`') THEN '' ELSE m.ch END WHEN m.ch = w.ch AND m.n >= w.n AND m.info = '' THEN '' ELSE w.ch END,
      CASE WHEN w.ch = '' THEN m.n ELSE w.n END,
      CASE WHEN w.ch = '' THEN CASE WHEN m.ch = '`' AND contains(m.info, '`') THEN 0 ELSE 1 END WHEN m.ch = w.ch AND m.n >= w.n AND m.info = '' THEN -1 ELSE 0 END,
      CASE WHEN w.ch = '' THEN regexp_extract(m.info, '^([A-Za-z0-9_+-]*)', 1) ELSE w.lang END
    FROM walk w JOIN marks m ON m.path = w.path AND m.k = w.k + 1),
  marked AS (SELECT l.path, l.line, l.text, coalesce(act, 0) = 1 AS opens, coalesce(act, 0) = -1 AS closes, lang,
      sum(coalesce(act, 0)) OVER w > 0 OR coalesce(act, 0) = -1 AS fenced, (sum(CASE WHEN act = 1 THEN 1 ELSE 0 END) OVER w)::INT AS block
    FROM lines l LEFT JOIN (SELECT * FROM walk WHERE act <> 0) k ON k.path = l.path AND k.line = l.line WINDOW w AS (PARTITION BY l.path ORDER BY l.line))"""


_MARKED = f"WITH RECURSIVE {_LINES}, {fence_sql()}"

_SLUG = (
    "regexp_replace(trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\s*\\{{\\s*#[^{{}}]*\\}}\\s*$', ''),"
    " '!?\\[([^\\[\\]]*)\\](?:\\([^()]*\\)|\\[[^\\[\\]]*\\])', '\\1', 'g'), '\\\\[<>]', '', 'g'), '</?[A-Za-z][^<>]*>', '', 'g')), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g')), '\\s', '-', 'g')"
)

_HEADINGS = f""", named AS (SELECT path, line, length(regexp_extract(text, '^(#{{1,6}})', 1)) AS level,
    regexp_replace(regexp_replace(text, '^#{{1,6}}[ \\t]+', ''), '[ \\t]+#*[ \\t]*$', '') AS title FROM marked WHERE NOT fenced AND regexp_matches(text, '^#{{1,6}}[ \\t]+[^ \\t]')),
  based AS (SELECT *, {_SLUG.format('title')} AS base FROM named),
  heads AS (SELECT path, line, level, title, CASE WHEN k = 0 THEN base ELSE base || '-' || k END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY path, base ORDER BY line) - 1 AS k FROM based))"""


@_query(f"{_MARKED}{_HEADINGS} SELECT path, line, level, title, slug FROM heads")
def md_headings(spark: SparkSession, d: str) -> DataFrame:
    return D.headings(_lines(spark, d))


@_query(f"""{_MARKED} SELECT path, block, min(line) AS start_line, max(line) AS end_line, max(CASE WHEN opens THEN lang END) AS lang,
  sha256(coalesce(string_agg(CASE WHEN NOT opens AND NOT closes THEN regexp_replace(text, '[ \\t]+$', '') END, chr(10) ORDER BY line), '')) AS digest
FROM marked WHERE fenced GROUP BY path, block""")
def md_fences(spark: SparkSession, d: str) -> DataFrame:
    return D.fences(_lines(spark, d))


@_query(f"""{_MARKED}{_HEADINGS}, both_ AS (SELECT path, line, NULL::VARCHAR AS mark FROM lines UNION ALL SELECT path, line, title FROM heads),
  carried AS (SELECT path, mark, last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY line, mark IS NULL ROWS UNBOUNDED PRECEDING) AS section FROM both_)
SELECT path, coalesce(section, '') AS section, count(*) AS n_lines FROM carried WHERE mark IS NULL GROUP BY ALL""")
def section_of_line(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return D.assign_sections(lines, D.headings(lines)).groupBy("path", "section").agg(F.count("*").alias("n_lines"))


_RANGES = f"""{_MARKED}{_HEADINGS}, sizes AS (SELECT path, max(line) AS n_lines FROM lines GROUP BY path),
  ranges AS (SELECT h.path, title, line AS start_line, coalesce(lead(line) OVER (PARTITION BY h.path ORDER BY line) - 1, n_lines) AS end_line FROM heads h JOIN sizes USING (path)
    UNION ALL SELECT s.path, '', 1, coalesce(f.line - 1, n_lines) FROM sizes s LEFT JOIN (SELECT path, min(line) AS line FROM heads GROUP BY path) f USING (path) WHERE coalesce(f.line - 1, n_lines) >= 1)"""


@_query(f"{_RANGES} SELECT path, title, start_line, end_line FROM ranges")
def section_ranges(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return D.section_ranges(D.headings(lines), lines)


@_query(f"""{_MARKED}, cells AS (SELECT path, line, contains(text, '|') AS piped, len(string_split(regexp_replace(trim(text), '^\\||\\|$', '', 'g'), '|')) AS cells,
    regexp_matches(text, '^\\s*\\|?\\s*:?-+:?\\s*(?:\\|\\s*:?-+:?\\s*)*\\|?\\s*$') AND contains(text, '|') AS delimiter FROM marked WHERE NOT fenced),
  prev AS (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY line) AS before FROM cells),
  marks2 AS (SELECT *, piped AND lead(delimiter) OVER w AND cells = lead(cells) OVER w AND NOT delimiter AS begins,
    sum(CASE WHEN NOT piped OR coalesce(line <> before + 1, true) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS brk FROM prev WINDOW w AS (PARTITION BY path ORDER BY line))
SELECT path, min(CASE WHEN begins THEN line END) AS start_line, max(line) - min(CASE WHEN begins THEN line END) - 1 AS n_rows, max(CASE WHEN begins THEN cells END) AS n_cols
FROM marks2 WHERE piped GROUP BY path, brk HAVING min(CASE WHEN begins THEN line END) IS NOT NULL""")
def table_shapes(spark: SparkSession, d: str) -> DataFrame:
    return D.table_shapes(_lines(spark, d))


@_query(f"""{_MARKED}, links AS (SELECT path, line, unnest(regexp_extract_all(text, '\\]\\(([^()\\s]+)\\)', 1)) AS target FROM marked WHERE NOT fenced)
SELECT path, line, target, CASE WHEN regexp_matches(target, '^[a-z][a-z0-9+.-]*://') THEN 'url' WHEN regexp_matches(target, '^(?:mailto|tel|data|javascript):') THEN 'other'
  WHEN starts_with(target, '#') THEN 'anchor' WHEN contains(target, '#') THEN 'path_anchor' ELSE 'path' END AS kind FROM links""")
def link_claims(spark: SparkSession, d: str) -> DataFrame:
    """Link scanner and link pass: targets outside fences with their kind."""
    outside = D.fence_marks(_lines(spark, d)).where("not fenced")
    return outside.select("path", "line", F.explode(T.link_targets("text")).alias("target")).withColumn("kind", T.link_kind("target"))


_IGNORES = f"""WITH {_LINES}, marks AS (SELECT path, line, regexp_extract(text, '<!--\\s*ledger(-start|-end|-file)?(?:\\s+([a-z0-9-]+))?\\s*-->', 1) AS kind,
    regexp_matches(text, '^\\s*<!--\\s*ledger[^>]*-->\\s*$') AS alone FROM lines WHERE regexp_matches(text, '<!--\\s*ledger(-start|-end|-file)?(?:\\s+([a-z0-9-]+))?\\s*-->')),
  covered AS (SELECT path, line AS a, line AS b FROM marks WHERE kind = '' AND NOT alone
    UNION ALL SELECT m.path, m.line, min(l.line) FROM marks m JOIN lines l ON l.path = m.path AND l.line > m.line AND trim(l.text) <> '' WHERE m.kind = '' AND m.alone GROUP BY m.path, m.line)"""


@_query(f"""{_IGNORES} SELECT path, count(*) AS n_kept FROM lines l WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.path = l.path AND l.line BETWEEN c.a AND c.b) GROUP BY path""")
def ignore_interval_filter(spark: SparkSession, d: str) -> DataFrame:
    """Ignore directives as intervals and the range anti-join of the rule filter."""
    lines = _lines(spark, d)
    ranges = D.ignore_ranges(lines, word="ledger")
    return D.drop_ignored(lines.withColumn("rule", F.lit("any")), ranges).groupBy("path").agg(F.count("*").alias("n_kept"))


@_query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(text, '[^A-Za-z0-9_.]+'),
  lambda w: regexp_replace(w, '^[.]+|[.]+$', '', 'g')), lambda w: regexp_matches(w, '^[0-9]+(?:[.][0-9]+)*$')))), ',') AS numbers FROM documents WHERE text IS NOT NULL""")
def prose_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(T.numbers_in("text"), ",").alias("numbers"))


@_query("SELECT file_id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)', 1))), ',') AS words FROM source_files WHERE content IS NOT NULL")
def source_words(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "source_files").where("content is not null").select("file_id", F.array_join(T.identifiers_in("content"), ",").alias("words"))


@_query(f"""{_MARKED}{_HEADINGS}, outside AS (SELECT * FROM marked WHERE NOT fenced),
  h AS (SELECT path, string_agg(level::VARCHAR, ',' ORDER BY line) AS levels FROM heads GROUP BY path),
  k AS (SELECT path, count(DISTINCT t) AS n_links FROM (SELECT path, unnest(regexp_extract_all(text, '\\]\\(([^()\\s]+)\\)', 1)) AS t FROM outside) GROUP BY path)
SELECT path, coalesce(levels, '') AS levels, coalesce(n_links, 0) AS n_links FROM (SELECT DISTINCT path FROM lines) LEFT JOIN h USING (path) LEFT JOIN k USING (path)""")
def structure_digests(spark: SparkSession, d: str) -> DataFrame:
    digests = D.structure_digest(_lines(spark, d))
    return digests.select("path", F.array_join("levels", ",").alias("levels"), F.size("links").cast("bigint").alias("n_links"))


# --- names and values ------------------------------------------------------------------------

_SHAPE = """CASE WHEN regexp_matches(name, '^--?[A-Za-z][A-Za-z0-9-]*$') THEN 'flag' WHEN regexp_matches(name, '^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$') THEN 'env'
  WHEN regexp_matches(name, '^[^\\s]*/[^\\s]*$') THEN 'path' WHEN regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)+$') THEN 'scoped'
  WHEN regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z_][A-Za-z0-9_]*)+$') THEN 'dotted' WHEN regexp_matches(name, '^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$') THEN 'snake'
  WHEN regexp_matches(name, '^[a-z]+[a-z0-9]*(?:[A-Z][a-z0-9]*)+$') THEN 'camel' WHEN regexp_matches(name, '^(?:[A-Z][a-z0-9]+){2,}$') THEN 'pascal'
  WHEN regexp_matches(name, '^[A-Za-z0-9]+$') THEN 'plain' ELSE 'other' END"""


@_query(f"WITH {_SPANS} SELECT doc_id, line, name, {_SHAPE} AS kind FROM spans")
def span_claims(spark: SparkSession, d: str) -> DataFrame:
    """Code-span pass and whole-span classifier."""
    return _spans(spark, d).withColumn("kind", T.name_shape("name"))


@_query(f"""WITH {_SPANS} SELECT name, lower(replace(regexp_replace(name, '^-+', ''), '_', '-')) AS flag_key,
  regexp_matches(name, '^[A-Za-z0-9_./:{{}}*$@+<>~%-]{{2,80}}$') AND regexp_matches(name, '[A-Za-z]') AS literal FROM (SELECT DISTINCT name FROM spans)""")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    names = _spans(spark, d).select("name").distinct()
    return names.select("name", T.flag_key("name").alias("flag_key"), T.literal_like("name").alias("literal"))


@_query("""WITH f AS (SELECT DISTINCT file AS raw, list_reduce(list_prepend('', list_filter(string_split(replace(file, '\\', '/'), '/'), lambda s: s NOT IN ('', '.'))), lambda a, s: CASE WHEN a = '' THEN s ELSE a || '/' || s END) AS path FROM findings WHERE file IS NOT NULL)
SELECT raw, path, regexp_extract(path, '([^/]*)$', 1) AS base, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir,
  regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)[.][^.]*$', '\\1') AS stem, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.][.]([^.]+)$', 1)) AS ext FROM f""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    files = _t(spark, d, "findings").where("file is not null").select(F.col("file").alias("raw")).distinct().withColumn("path", T.clean_path("raw"))
    return files.select("raw", "path", T.base_name("path").alias("base"), T.dir_name("path").alias("dir"), T.stem("path").alias("stem"), T.extension("path").alias("ext"))


@_query("""SELECT path, count(*) AS n_lines FROM doc_lines WHERE path IS NOT NULL AND (regexp_matches(path, '^docs/(?:[^/]+/)*[^/]*\\.md$') OR regexp_matches(path, '^(?:.*/)?[^/]*\\.(?:tex|wiki)$')) GROUP BY path""")
def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    """Include globs as pushed-down regular expressions."""
    return _t(spark, d, "doc_lines").where(T.glob_matches("path", ["docs/**/*.md", "*.{tex,wiki}"])).groupBy("path").agg(F.count("*").alias("n_lines"))


@_query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN 'true' WHEN 1 THEN l_quantity::INT::VARCHAR WHEN 2 THEN '"' || l_suppkey || '"' WHEN 3 THEN 'none' WHEN 4 THEN (l_quantity::INT * 60)::VARCHAR || 's' ELSE 'off' END AS a,
  CASE l_suppkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN l_quantity::INT || '.0' WHEN 2 THEN l_suppkey::VARCHAR WHEN 3 THEN 'nil' ELSE l_quantity::INT || 'm' END AS b FROM lineitem),
p AS (SELECT *, lower(regexp_replace(a, '^"|"$', '', 'g')) AS x, lower(b) AS y FROM v)
SELECT l_orderkey, l_linenumber, coalesce(x = y OR (x IN ('', 'none', 'null', 'nil') AND y IN ('', 'none', 'null', 'nil'))
  OR coalesce(CASE WHEN x IN ('true', 'yes', 'on') THEN true WHEN x IN ('false', 'no', 'off') THEN false END = CASE WHEN y IN ('true', 'yes', 'on') THEN true WHEN y IN ('false', 'no', 'off') THEN false END, false)
  OR coalesce(try_cast(x AS DOUBLE) = try_cast(y AS DOUBLE), false)
  OR coalesce(CASE WHEN regexp_matches(x, '^[0-9]+s$') THEN regexp_extract(x, '^[0-9]+')::DOUBLE END = CASE WHEN regexp_matches(y, '^[0-9]+m$') THEN regexp_extract(y, '^[0-9]+')::DOUBLE * 60 END, false), false) AS same FROM p""")
def default_equality(spark: SparkSession, d: str) -> DataFrame:
    """Default resolver's comparison: text, truth, number, duration, no value."""
    q = F.col("l_quantity").cast("int").cast("string")
    a = F.expr("l_linenumber % 6")
    documented = F.when(a == 0, "true").when(a == 1, q).when(a == 2, F.concat(F.lit('"'), "l_suppkey", F.lit('"'))).when(a == 3, "none").when(a == 4, F.concat((F.col("l_quantity").cast("int") * 60).cast("string"), F.lit("s"))).otherwise("off")
    b = F.expr("l_suppkey % 5")
    declared = F.when(b == 0, "yes").when(b == 1, F.concat(q, F.lit(".0"))).when(b == 2, F.col("l_suppkey").cast("string")).when(b == 3, "nil").otherwise(F.concat(q, F.lit("m")))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.same_default(documented, declared).alias("same"))


@_query("""WITH v AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'Since ([0-9]+[.][0-9]+)', 1)) AS v FROM documents WHERE text IS NOT NULL)
SELECT doc_id, max(split_part(v, '.', 1)::INT * 1000 + split_part(v, '.', 2)::INT) AS newest FROM v GROUP BY doc_id""")
def version_floors(spark: SparkSession, d: str) -> DataFrame:
    """Toolchain resolver's version bound."""
    found = _t(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("Since ([0-9]+[.][0-9]+)"), 1)).alias("v"))
    floor = found.select("doc_id", T.version_floor("v").alias("f"))
    return floor.groupBy("doc_id").agg(F.max(F.col("f.major") * 1000 + F.col("f.minor")).alias("newest"))


_ROUTE = """list_transform(list_filter(string_split(regexp_replace(regexp_replace({0}, '[?#].*$', ''), '^https?://[^/]*', ''), '/'), lambda s: s <> ''),
  lambda s: CASE WHEN s = '{{$}}' THEN s WHEN regexp_matches(s, '^[*]|(?:[.]{{3}}|:[.]?[*])\\}}$|[.]{{2}}>$') THEN '**' WHEN regexp_matches(s, '^:.|^<.*>$|\\{{.*\\}}') THEN '{{}}' ELSE s END)"""
_ROUTES = f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS) (/[^\\s`"]+)', 1)) AS route FROM documents WHERE text IS NOT NULL),
  claimed AS (SELECT DISTINCT route, {_ROUTE.format('route')} AS segs FROM r)"""


@_query(f"{_ROUTES} SELECT route, array_to_string(segs, '/') AS canonical FROM claimed")
def route_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _claimed_routes(spark, d).select("route", F.array_join("segs", "/").alias("canonical"))


def _claimed_routes(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").where("text is not null")
    routes = docs.select(F.explode(F.regexp_extract_all("text", F.lit("(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS) (/[^\\s`\"]+)"), 1)).alias("route")).distinct()
    return routes.withColumn("segs", T.route_segments("route"))


@_query(f"""{_ROUTES}, words AS (SELECT DISTINCT lower(split_part(full_name, '.', 1)) AS w FROM symbol_spans WHERE full_name IS NOT NULL),
  known AS (SELECT DISTINCT segs[1] AS a, segs[3] AS c FROM claimed WHERE len(segs) = 3 AND ascii(segs[1]) % 2 = 0)
SELECT route, EXISTS (SELECT 1 FROM known k WHERE len(segs) = 3 AND k.a = segs[1] AND k.c = segs[3]) AS documented FROM claimed""")
def route_match(spark: SparkSession, d: str) -> DataFrame:
    """Route resolver: claimed routes against registered ones, parameters on either side."""
    claimed = _claimed_routes(spark, d)
    registered = claimed.where((F.size("segs") == 3) & (F.ascii(F.get("segs", F.lit(0))) % 2 == 0)).select(F.array(F.get("segs", F.lit(0)), F.lit("{}"), F.get("segs", F.lit(2))).alias("reg")).distinct()
    registered = registered.withColumn("head", F.get("reg", F.lit(0)))
    # The first fixed segment is an equi-join key; only the rest is compared segment by segment.
    hit = claimed.withColumn("head", F.get("segs", F.lit(0))).join(registered, "head", "left").select("route", F.coalesce(T.route_matches("segs", "reg"), F.lit(False)).alias("ok"))
    return hit.groupBy("route").agg(F.max("ok").alias("documented"))


@_query("""WITH k AS (SELECT DISTINCT unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL), d AS (SELECT event_type || '.' || key AS key FROM (SELECT DISTINCT event_type FROM events), k UNION SELECT DISTINCT event_type FROM events)
SELECT key FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE starts_with(e.key, d.key || '.'))""")
def config_leaf_keys(spark: SparkSession, d: str) -> DataFrame:
    """JSON key paths and leaf keys."""
    events = _t(spark, d, "events")
    keys = events.where("props is not null").select(F.explode(F.json_object_keys("props")).alias("k")).distinct()
    types = events.select("event_type").distinct()
    dotted = types.join(F.broadcast(keys)).select(F.concat_ws(".", "event_type", "k").alias("key")).unionByName(types.select(F.col("event_type").alias("key")))
    return L.leaf_keys(dotted)


@_query("""SELECT s_suppkey, x FROM (SELECT s_suppkey, unnest(['conf/' || s_name || '.yaml', 'conf/' || s_name || '.json']) AS x FROM supplier)""")
def brace_expansion(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.concat(F.lit("conf/"), "s_name", F.lit(".{yaml, json}"))
    return _t(spark, d, "supplier").select("s_suppkey", F.explode(T.expand_braces(spelled)).alias("x"))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_STRONG, _WEAK, _AFTER = (_quoted(p) for p in (T.NEGATION_STRONG, T.NEGATION_WEAK, T.NEGATION_AFTER))


@_query(f"""WITH {_SPANS}, parts AS (SELECT doc_id, string_split(t, '`') AS p FROM raw_lines), each AS (SELECT doc_id, p, unnest(range(1, len(p) - 1, 2)) AS i FROM parts),
  around AS (SELECT doc_id, array_to_string(p[1:i], '`') AS b, array_to_string(p[i + 2:], '`') AS a FROM each WHERE p[i + 1] <> ''),
  reach AS (SELECT *, regexp_matches(b, '{_STRONG}') AS strong, regexp_replace(regexp_replace(b, '{_STRONG}', ''), '`[^`]*`', '``', 'g') AS r FROM around)
SELECT doc_id, sum(CASE WHEN strong AND length(r) <= {T.NEGATION_REACH} AND NOT regexp_matches(r, '[;.。；]') AND NOT regexp_matches(r, '``[^`]*[:：][^`]*$') OR regexp_matches(b, '{_WEAK}') OR regexp_matches(a, '{_AFTER}') THEN 1 ELSE 0 END)::BIGINT AS n_negated,
  count(*) AS n FROM reach GROUP BY doc_id""")
def negation_filter(spark: SparkSession, d: str) -> DataFrame:
    """Negation filter: words on either side of a code span that deny it."""
    lines = D.explode_lines(_t(spark, d, "documents"), "doc_id", "text").withColumn("p", F.split("text", "`", -1)).where("size(p) > 2")
    each = lines.select("doc_id", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2))).alias("i")).where(F.get("p", F.col("i")) != "")
    before, after = F.array_join(F.slice("p", F.lit(1), F.col("i")), "`"), F.array_join(F.slice("p", F.col("i") + 2, F.size("p")), "`")
    return each.groupBy("doc_id").agg(F.sum(T.negated(before, after).cast("int")).alias("n_negated"), F.count("*").alias("n"))


# --- resolvers ---------------------------------------------------------------------------------

_MISSING = f"""WITH {_SPANS}, claims AS (SELECT DISTINCT name AS path FROM spans WHERE regexp_matches(name, '^[^\\s]*/[^\\s]*$')), known AS (SELECT DISTINCT file AS rel FROM source_files WHERE file IS NOT NULL),
  misses AS (SELECT path FROM claims WHERE path NOT IN (SELECT rel FROM known))"""


def _path_claims(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).where(T.name_shape("name") == "path").select(F.col("name").alias("path")).distinct()


def _known_files(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "source_files").where("file is not null").select(F.col("file").alias("rel")).distinct()


@_query(f"{_MISSING} SELECT path, substring(sha256('missing-path|' || path), 1, 16) AS fingerprint FROM misses")
def missing_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path resolver: claimed paths that no file has (left anti), with position-free identity."""
    misses = _path_claims(spark, d).join(_known_files(spark, d), F.col("path") == F.col("rel"), "left_anti")
    return misses.withColumn("fingerprint", T.fingerprint(F.lit("missing-path"), "path"))


@_query(f"""WITH known AS (SELECT DISTINCT file AS rel FROM source_files WHERE file IS NOT NULL), misses AS (SELECT DISTINCT regexp_replace(rel, '.([.][a-z]+)$', '\\1') AS path FROM known WHERE regexp_replace(rel, '.([.][a-z]+)$', '\\1') NOT IN (SELECT rel FROM known)),
  a AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS base FROM misses), f AS (SELECT rel AS candidate, regexp_extract(rel, '([^/]*)$', 1) AS c_base FROM known),
  x AS (SELECT path, candidate, CASE WHEN lower(path) = lower(candidate) THEN 0 WHEN base <> c_base AND levenshtein(base, c_base) <= 2 THEN 1000 + 100 * levenshtein(base, c_base)
      WHEN base <> c_base AND regexp_replace(base, '(.)[.][^.]*$', '\\1') = regexp_replace(c_base, '(.)[.][^.]*$', '\\1') THEN 2000 END AS score FROM a, f WHERE path <> candidate AND abs(length(base) - length(c_base)) <= 4 AND base <> c_base)
SELECT path, candidate, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score, length(candidate), candidate)::INT AS rank FROM x WHERE score IS NOT NULL) WHERE rank <= 3""")
def similar_paths(spark: SparkSession, d: str) -> DataFrame:
    """Did you mean: same name elsewhere, near names within a length band, other extensions."""
    known = _known_files(spark, d)
    spelled = known.select(F.regexp_replace("rel", ".([.][a-z]+)$", "$1").alias("path")).distinct()  # a letter lost from every name
    misses = spelled.join(known, F.col("path") == F.col("rel"), "left_anti")
    named = known.select(T.base_name("rel").alias("b")).distinct()
    fresh = misses.join(named, T.base_name("path") == F.col("b"), "left_anti")
    return S.similar_paths(fresh, known)


@_query()
def similar_paths_all(spark: SparkSession, d: str) -> DataFrame:
    """Every miss with every kind of candidate: same names elsewhere and in other case as well (no SQL for the distance of directories; tested against brute force)."""
    known = _known_files(spark, d)
    moved = known.select(F.concat(F.lit("moved/"), "rel").alias("path")).unionByName(known.select(F.upper("rel").alias("path"))).unionByName(known.select(F.regexp_replace("rel", ".([.][a-z]+)$", "$1").alias("path")))
    return S.similar_paths(moved.unionByName(_path_claims(spark, d)).distinct().join(known.hint("merge"), F.col("path") == F.col("rel"), "left_anti"), known)


_SYMBOLS = """sym AS (SELECT DISTINCT full_name FROM symbol_spans WHERE full_name IS NOT NULL), keys AS (SELECT full_name AS key FROM sym UNION SELECT regexp_extract(full_name, '([^.:#]+)$', 1) FROM sym)"""


def _symbol_keys(spark: SparkSession, d: str) -> DataFrame:
    names = _t(spark, d, "symbol_spans").where("full_name is not null").select("full_name").distinct()
    bare = F.regexp_extract("full_name", "([^.:#]+)$", 1)
    return names.select(F.explode(F.array("full_name", bare)).alias("key")).distinct()


@_query(f"""WITH {_SPANS}, {_SYMBOLS} SELECT name, bool_or(name IN (SELECT key FROM keys)) AS resolved, count(DISTINCT doc_id) AS n_docs FROM spans
WHERE regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z_][A-Za-z0-9_]*)*$') GROUP BY name""")
def symbol_claims(spark: SparkSession, d: str) -> DataFrame:
    """Symbol resolvers: every accepted spelling of a symbol is a join key."""
    claims = _spans(spark, d).where(F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z_][A-Za-z0-9_]*)*$"))
    hit = claims.join(_symbol_keys(spark, d).withColumn("hit", F.lit(True)), F.col("name") == F.col("key"), "left")
    return hit.groupBy("name").agg(F.coalesce(F.max("hit"), F.lit(False)).alias("resolved"), F.count_distinct("doc_id").alias("n_docs"))


@_query(f"""WITH {_SPANS}, {_SYMBOLS}, asked AS (SELECT DISTINCT name, lower(name) AS q FROM spans WHERE regexp_matches(name, '^[a-z]+_[a-z_]+$') AND name NOT IN (SELECT key FROM keys)),
  pool AS (SELECT DISTINCT regexp_extract(full_name, '([^.:#]+)$', 1) AS candidate FROM sym WHERE regexp_matches(full_name, '^[ -~]+$')),
  near AS (SELECT name AS query, candidate, levenshtein(q, lower(candidate)) AS distance, q FROM asked, pool WHERE abs(length(q) - length(candidate)) <= 2 AND levenshtein(q, lower(candidate)) BETWEEN 1 AND 2)
SELECT query, candidate, distance::INT AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, starts_with(lower(candidate), substring(q, 1, 3)) DESC, candidate)::INT AS rank FROM near) WHERE rank <= 3""")
def did_you_mean(spark: SparkSession, d: str) -> DataFrame:
    """Ranked suggestions over a length band, plain edit distance (the oracle has no other)."""
    keys = _symbol_keys(spark, d)
    misses = _spans(spark, d).where(F.col("name").rlike("^[a-z]+_[a-z_]+$")).select("name").distinct().join(keys.hint("merge"), F.col("name") == F.col("key"), "left_anti")
    pool = _t(spark, d, "symbol_spans").where(F.col("full_name").rlike("^[ -~]+$")).select(F.regexp_extract("full_name", "([^.:#]+)$", 1).alias("candidate"))
    return S.ranked(misses, pool, "name", "candidate", limit=F.lit(2), swaps=False, top=2)


@_query()
def did_you_mean_osa(spark: SparkSession, d: str) -> DataFrame:
    """All names that resolve to nothing, with swaps of neighbours as one edit (no SQL counterpart; tested against brute force)."""
    keys = _symbol_keys(spark, d)
    misses = _spans(spark, d).select("name").distinct().join(keys.hint("merge"), F.col("name") == F.col("key"), "left_anti")
    pool = _t(spark, d, "symbol_spans").select(F.regexp_extract("full_name", "([^.:#]+)$", 1).alias("candidate"))
    return S.ranked(misses, pool, "name", "candidate", limit=S.narrow_limit(F.col("query")), top=2)


@_query()
def similar_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Near symbols with owner and visibility penalties."""
    keys = _symbol_keys(spark, d)
    misses = _spans(spark, d).where(T.name_shape("name").isin("dotted", "camel", "snake")).select("name").distinct().join(keys.hint("merge"), F.col("name") == F.col("key"), "left_anti")
    return S.similar_symbols(misses, _t(spark, d, "symbol_spans"))


@_query(f"""WITH {_SPANS}, env AS (SELECT DISTINCT name FROM spans WHERE regexp_matches(name, '^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$')), ext AS (SELECT DISTINCT upper(substring(n_name, 1, 2)) AS p FROM nation)
SELECT name, EXISTS (SELECT 1 FROM ext WHERE starts_with(name, p)) AS external FROM env""")
def env_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Environment resolver: external names by prefix. The prefixes (25 at most) become a broadcast side."""
    names = _spans(spark, d).where(T.name_shape("name") == "env").select("name").distinct()
    prefixes = _t(spark, d, "nation").select(F.upper(F.substring("n_name", 1, 2)).alias("p")).distinct()
    hit = names.join(F.broadcast(prefixes), F.startswith(F.col("name"), F.col("p")), "left")
    return hit.groupBy("name").agg(F.max(F.col("p").isNotNull()).alias("external"))


@_query(f"""{_RANGES}, refs AS (SELECT path, line, unnest(regexp_extract_all(text, '([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+)', 1)) AS file FROM lines)
SELECT DISTINCT r.path, r.title, r.start_line, f.file FROM ranges r JOIN refs f ON f.path = r.path AND f.line BETWEEN r.start_line AND r.end_line""")
def section_files(spark: SparkSession, d: str) -> DataFrame:
    """Range join of claims and sections."""
    lines = _lines(spark, d)
    refs = lines.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+)"), 1)).alias("file"))
    return H.section_files(D.section_ranges(D.headings(lines), lines), refs)


# --- history -------------------------------------------------------------------------------------

_BLAME = "blame AS (SELECT 'o' || l_orderkey AS file, l_linenumber AS line, 'h' || l_suppkey AS hash, l_shipdate AS ts FROM lineitem)"
_COMMITS = "commits AS (SELECT 'c' || o_custkey AS file, 'k' || o_orderkey AS hash, o_orderdate AS ts, o_orderpriority AS subject FROM orders)"
_TIMES = f"""WITH {_BLAME}, {_COMMITS}, ranges AS (SELECT file AS path, 'all' AS title, 1 AS start_line, max(line) AS end_line FROM blame GROUP BY file),
  times AS (SELECT r.path, title, start_line, end_line, max(ts) AS edited FROM ranges r JOIN blame b ON b.file = r.path AND b.line BETWEEN start_line AND end_line GROUP BY ALL HAVING count(ts) = end_line - start_line + 1),
  refs AS (SELECT DISTINCT 'o' || l_orderkey AS path, 'c' || (l_partkey % 150 + 1) AS file FROM lineitem)"""


def _blame(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.concat(F.lit("h"), "l_suppkey").alias("hash"), F.col("l_shipdate").alias("ts"))


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("file"), F.concat(F.lit("k"), "o_orderkey").alias("hash"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("subject"))


def _order_sections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    blame = _blame(spark, d)
    ranges = blame.groupBy(F.col("file").alias("path")).agg(F.max("line").alias("end_line")).select("path", F.lit("all").alias("title"), F.lit(1).alias("start_line"), "end_line")
    return H.section_times(ranges, blame), ranges


@_query(f"""{_TIMES}, churn AS (SELECT t.path, t.title, t.start_line, r.file, edited, count(DISTINCT hash) AS n_commits, max(c.ts) AS latest FROM times t JOIN refs r USING (path) JOIN commits c ON c.file = r.file AND c.ts > edited GROUP BY ALL)
SELECT path, file, n_commits FROM churn WHERE n_commits >= 3 OR (n_commits >= 1 AND epoch(latest) - epoch(edited) >= 7776000)""")
def stale_churn(spark: SparkSession, d: str) -> DataFrame:
    """Section edit time, churn of referenced files, staleness predicate."""
    times, ranges = _order_sections(spark, d)
    refs = _t(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("path"), F.lit(1).alias("line"), F.concat(F.lit("c"), F.expr("l_partkey % 150 + 1")).alias("file"))
    return H.stale(H.section_churn(times, H.section_files(ranges, refs), _commits(spark, d))).select("path", "file", "n_commits")


@_query(f"""{_TIMES}, sym AS (SELECT DISTINCT 'o' || l_orderkey AS path, 's' || l_suppkey AS full_name, 'o' || (l_orderkey + 1) AS file, 1 AS a, l_linenumber AS b FROM lineitem),
  bodies AS (SELECT t.path, s.full_name, edited, count(DISTINCT hash) AS n, max(ts) AS latest FROM times t JOIN sym s USING (path) JOIN blame b ON b.file = s.file AND b.line BETWEEN s.a AND s.b AND b.ts > edited GROUP BY ALL),
  due AS (SELECT * FROM bodies WHERE n >= 3 OR (n >= 1 AND epoch(latest) - epoch(edited) >= 7776000)),
  churn AS (SELECT t.path, r.file, edited, count(DISTINCT hash) AS n, max(c.ts) AS latest FROM times t JOIN refs r USING (path) JOIN commits c ON c.file = r.file AND c.ts > edited GROUP BY ALL),
  sections AS (SELECT path, max(n) AS n FROM churn WHERE n >= 3 OR (n >= 1 AND epoch(latest) - epoch(edited) >= 7776000) GROUP BY path)
SELECT 'stale-symbol' AS rule, path, n AS n_commits FROM due UNION ALL SELECT 'stale-section', path, n FROM sections WHERE path NOT IN (SELECT path FROM due)""")
def stale_findings(spark: SparkSession, d: str) -> DataFrame:
    """Stale symbols suppress the finding of their section (left anti)."""
    times, ranges = _order_sections(spark, d)
    items = _t(spark, d, "lineitem")
    refs = items.select(F.concat(F.lit("o"), "l_orderkey").alias("path"), F.lit(1).alias("line"), F.concat(F.lit("c"), F.expr("l_partkey % 150 + 1")).alias("file"))
    symbols = items.select(
        F.concat(F.lit("o"), "l_orderkey").alias("path"), F.lit("all").alias("title"), F.lit(1).alias("start_line"), F.concat(F.lit("s"), "l_suppkey").alias("full_name"),
        F.concat(F.lit("o"), F.expr("l_orderkey + 1")).alias("file"), F.lit(1).alias("body_start"), F.col("l_linenumber").alias("body_end"),
    ).distinct()
    return H.stale_findings(times, H.section_files(ranges, refs), _commits(spark, d), symbols, _blame(spark, d)).select("rule", "path", "n_commits")


_SPAN_BLAME = """span AS (SELECT DISTINCT file, full_name, decl_line, doc_start, doc_end, body_start, body_end FROM symbol_spans WHERE doc_start > 0 AND doc_end >= doc_start AND body_end >= body_start),
  blame AS (SELECT file, line, 'h' || ((line * 37 + length(file)) % 50) AS hash, (line * 37 + length(file)) % 400 AS day FROM (SELECT DISTINCT file, unnest(range(least(doc_start, body_start), greatest(doc_end, body_end) + 1)) AS line FROM span))"""


@_query(f"""WITH {_SPAN_BLAME}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, decl_line ORDER BY full_name, doc_start) AS k FROM span) WHERE k = 1),
  two AS (SELECT * FROM (SELECT * EXCLUDE k, row_number() OVER (PARTITION BY file, doc_start, doc_end ORDER BY decl_line, full_name) AS k FROM one) WHERE k = 1),
  written AS (SELECT t.*, (SELECT max(day) FROM blame b WHERE b.file = t.file AND b.line BETWEEN doc_start AND doc_end) AS w FROM two t),
  body AS (SELECT w.file, full_name, decl_line, count(*) AS body_lines, count(*) FILTER (day > w) AS newer_lines, count(DISTINCT CASE WHEN day > w THEN hash END) AS n_commits
    FROM written w JOIN blame b ON b.file = w.file AND b.line BETWEEN body_start AND body_end AND NOT b.line BETWEEN doc_start AND doc_end GROUP BY w.file, full_name, decl_line)
SELECT * FROM body WHERE newer_lines > 0 AND (n_commits >= 2 OR newer_lines / body_lines >= 0.5)""")
def stale_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comment analysis over symbol spans; line times come from a formula both engines share."""
    spans = _t(spark, d, "symbol_spans").where("doc_start > 0 and doc_end >= doc_start and body_end >= body_start")
    every = F.sequence(F.least("doc_start", "body_start"), F.greatest("doc_end", "body_end"))
    mark = F.col("line") * 37 + F.length("file")
    lines = spans.select("file", F.explode(every).alias("line")).distinct()
    blame = lines.select("file", "line", F.concat(F.lit("h"), mark % 50).alias("hash"), F.timestamp_seconds((mark % 400) * 86_400).alias("ts"))
    keys = ["file", "full_name", "decl_line", "doc_start", "doc_end", "body_start", "body_end"]
    return H.stale_comments(spans.select(*keys).distinct(), blame)


_RENAMES = """ren AS (SELECT n_name AS old, (SELECT b.n_name FROM nation b WHERE b.n_nationkey = a.n_nationkey + 5) AS new FROM nation a WHERE a.n_nationkey + 5 <= 24)"""


@_query(f"WITH RECURSIVE {_RENAMES}, walk AS (SELECT old, new FROM ren UNION ALL SELECT w.old, r.new FROM walk w JOIN ren r ON w.new = r.old) SELECT old, new FROM walk WHERE new NOT IN (SELECT old FROM ren)")
def rename_chain(spark: SparkSession, d: str) -> DataFrame:
    nation = _t(spark, d, "nation").select("n_name", "n_nationkey")
    target = nation.select(F.col("n_name").alias("new"), (F.col("n_nationkey") - 5).alias("n_nationkey"))
    renames = nation.join(target, "n_nationkey").select(F.col("n_name").alias("old"), "new", F.lit(1).alias("ts"))
    return H.collapse_renames(renames)


@_query("""SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) GROUP BY user_id, event_type, g""")
def blame_runs(spark: SparkSession, d: str) -> DataFrame:
    """Run lengths of the persistent cache (gaps and islands)."""
    return H.run_lengths(_t(spark, d, "events"), "user_id", "event_id", "event_type")


@_query("SELECT path, count(*) AS n FROM doc_lines WHERE path IN (SELECT file FROM findings WHERE batch_no = 1) OR path LIKE 'docs/%' GROUP BY path")
def changed_only(spark: SparkSession, d: str) -> DataFrame:
    """Restriction to changed documents by a semi-join."""
    changed = _t(spark, d, "findings").where("batch_no = 1").select(F.col("file").alias("path"))
    lines = _t(spark, d, "doc_lines").select("path", "line")
    docs = lines.where("path like 'docs/%'").select("path").distinct()
    return H.changed_only(lines, changed.unionByName(docs)).groupBy("path").agg(F.count("*").alias("n"))


@_query(f"""WITH {_COMMITS}, p AS (SELECT 'c' || c_custkey AS source, 'c' || (c_custkey + 1) AS translation FROM customer), last_ AS (SELECT file AS translation, max(ts) AS last_ts FROM commits GROUP BY file)
SELECT source, p.translation, count(DISTINCT hash) AS n_newer FROM p JOIN last_ l ON l.translation = p.translation JOIN commits c ON c.file = source AND c.ts > last_ts GROUP BY ALL""")
def pair_lag(spark: SparkSession, d: str) -> DataFrame:
    pairs = _t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("c"), F.expr("c_custkey + 1")).alias("translation"))
    return P.lag(pairs, _commits(spark, d)).select("source", "translation", "n_newer")


# --- pairs ----------------------------------------------------------------------------------------

_PATHS = "paths AS (SELECT source AS path FROM pairs WHERE source IS NOT NULL UNION SELECT translation FROM pairs WHERE translation IS NOT NULL)"
_DETECT = f"""WITH {_PATHS}, lang AS (SELECT unnest(['zh', 'de', 'es', 'fr', 'ja', 'ko', 'pt', 'ru', 'it']) AS lang),
  cand AS (SELECT path AS source, lang, unnest([0, 1, 2, 3]) AS prio, unnest([regexp_replace(path, '[.][^./]*$', '') || '-' || lang || regexp_extract(path, '([.][^./]*)$', 1),
      regexp_replace(path, '[.][^./]*$', '') || '.' || lang || regexp_extract(path, '([.][^./]*)$', 1), regexp_replace(path, '[.][^./]*$', '') || '_' || lang || regexp_extract(path, '([.][^./]*)$', 1),
      CASE WHEN regexp_matches(path, '(?:^|/)en/') THEN regexp_replace(path, '(^|/)en/', '\\1' || lang || '/') END]) AS translation FROM paths, lang),
  found AS (SELECT source, translation, lang, row_number() OVER (PARTITION BY translation ORDER BY prio, source) AS k FROM cand WHERE translation IN (SELECT path FROM paths) AND translation <> source)"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    pairs = _t(spark, d, "pairs")
    return pairs.select(F.col("source").alias("path")).unionByName(pairs.select(F.col("translation").alias("path"))).where("path is not null").distinct()


@_query(f"{_DETECT} SELECT source, translation, lang FROM found WHERE k = 1")
def pair_detect(spark: SparkSession, d: str) -> DataFrame:
    return P.detect(_paths(spark, d))


@_query(f"""{_DETECT}, two AS (SELECT * FROM found WHERE k = 1), tree AS (SELECT DISTINCT regexp_extract(source, '^(.*?)(?:^|/)?en/', 1) AS prefix, lang FROM two WHERE regexp_matches(source, '(?:^|/)en/')),
  w AS (SELECT CASE WHEN prefix = '' THEN '' ELSE prefix || '/' END AS pre, prefix, lang FROM tree),
  j AS (SELECT starts_with(path, pre || 'en/') AS src, path, pre, lang, regexp_replace(substring(path, length(prefix) + 1), '^/?[a-z]+/', '') AS rest FROM paths, w WHERE starts_with(path, pre || 'en/') OR starts_with(path, pre || lang || '/')),
  n AS (SELECT DISTINCT CASE WHEN src THEN 'pair-missing' ELSE 'pair-orphan' END AS rule, path, pre || CASE WHEN src THEN lang ELSE 'en' END || '/' || rest AS counterpart FROM j)
SELECT rule, path, counterpart FROM n WHERE counterpart NOT IN (SELECT path FROM paths)""")
def pair_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Missing and orphaned pages of translated trees (two anti-joins)."""
    paths = _paths(spark, d)
    return P.gaps(paths, P.detect(paths))


def _sentence_digests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _t(spark, d, "pair_sentences").where("pair_id is not null").groupBy("pair_id", "side", "sent_no").agg(F.max("text").alias("text"))
    s = s.withColumn("path", F.concat_ws("-", F.substring("side", 1, 1), "pair_id"))
    listed = F.sort_array(F.collect_list(F.struct("sent_no", F.size(T.code_spans("text")).alias("n"))))
    levels = s.groupBy("path").agg(F.transform(listed, lambda x: x["n"]).alias("levels"))
    names = s.select("path", F.explode(T.code_spans("text")).alias("x")).groupBy("path").agg(F.array_sort(F.collect_set("x")).alias("links"))
    digests = levels.join(names, "path", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))
    ids = s.select("pair_id").distinct()
    return ids.select(F.concat(F.lit("s-"), "pair_id").alias("source"), F.concat(F.lit("t-"), "pair_id").alias("translation")), digests


_SENT = """sent AS (SELECT pair_id, side, sent_no, max(text) AS text FROM pair_sentences WHERE pair_id IS NOT NULL GROUP BY ALL),
  lev AS (SELECT pair_id, side, list(len(regexp_extract_all(text, '`([^`\\n]+)`', 1)) ORDER BY sent_no) AS l FROM sent GROUP BY ALL),
  two AS (SELECT s.pair_id, s.l AS a, t.l AS b FROM lev s JOIN lev t ON t.pair_id = s.pair_id AND s.side = 'source' AND t.side = 'translation')"""


@_query(f"""WITH {_SENT}, z AS (SELECT pair_id, unnest(range(1, len(a) + 1)) AS p, unnest(a) AS x, unnest(b) AS y FROM two WHERE len(a) = len(b)),
  f AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY p) AS k FROM z WHERE x <> y)
SELECT 's-' || pair_id AS source, 'count' AS at, len(a)::VARCHAR AS was, len(b)::VARCHAR AS found FROM two WHERE len(a) <> len(b)
UNION ALL SELECT 's-' || pair_id, '#' || p, x::VARCHAR, y::VARCHAR FROM f WHERE k = 1""")
def pair_first_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Positional comparison of ordered parts: count, else the first place that differs."""
    pairs, digests = _sentence_digests(spark, d)
    return P.first_mismatch(pairs, digests, "levels", "pair-heading").select("source", "at", "was", "found")


@_query(f"""WITH {_SENT}, names AS (SELECT DISTINCT pair_id, side, unnest(regexp_extract_all(text, '`([^`\\n]+)`', 1)) AS x FROM sent),
  m AS (SELECT n.pair_id, n.side, x FROM names n WHERE EXISTS (SELECT 1 FROM two t WHERE t.pair_id = n.pair_id) AND NOT EXISTS (SELECT 1 FROM names o WHERE o.pair_id = n.pair_id AND o.side <> n.side AND o.x = n.x))
SELECT 's-' || pair_id AS source, side, array_to_string(list_slice(list_sort(list(x)), 1, 10), ',') AS missing FROM m GROUP BY pair_id, side""")
def pair_link_diff(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric difference of a page and its translation."""
    pairs, digests = _sentence_digests(spark, d)
    return P.set_differences(pairs, digests, "links", "pair-link").select("source", "side", F.array_join("missing", ",").alias("missing"))


# --- coverage, baseline, reports ----------------------------------------------------------------------

_COVER = f"""WITH {_SPANS}, said AS (SELECT DISTINCT name FROM spans), fact AS (SELECT repo AS grp, full_name AS name, regexp_extract(full_name, '([^.:#]+)$', 1) AS alias, file, decl_line FROM symbol_spans WHERE exported AND full_name IS NOT NULL AND repo IS NOT NULL),
  per AS (SELECT grp, name, bool_or(name IN (SELECT name FROM said) OR alias IN (SELECT name FROM said)) AS documented FROM fact GROUP BY grp, name)"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    spans = _t(spark, d, "symbol_spans").where("exported and full_name is not null and repo is not null")
    return spans.select(F.col("repo").alias("grp"), F.col("full_name").alias("name"), F.regexp_extract("full_name", "([^.:#]+)$", 1).alias("alias"), "file", F.col("decl_line").alias("line"))


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return L.coverage(_facts(spark, d), _spans(spark, d).select("name"))


@_query(f"{_COVER} SELECT grp, count(*) AS total, count(*) FILTER (documented) AS documented, coalesce(array_to_string(list_sort(list(name) FILTER (NOT documented)), ','), '') AS missing FROM per GROUP BY grp")
def coverage_by_repo(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d).withColumn("missing", F.array_join("missing", ","))


@_query(f"""{_COVER}, c AS (SELECT grp, count(*) AS total, count(*) FILTER (documented) AS documented FROM per GROUP BY grp)
SELECT grp, round(100.0 * documented / total)::INT AS rounded, floor(100.0 * documented / total)::INT AS floored, floor(100.0 * documented / total + 0.5)::INT AS half_up FROM c""")
def coverage_percent(spark: SparkSession, d: str) -> DataFrame:
    """The three roundings of a documented share."""
    c = _coverage(spark, d)
    return c.select("grp", *[T.percent("documented", "total", rule).alias(name) for rule, name in (("round", "rounded"), ("floor", "floored"), ("half_up", "half_up"))])


@_query(f"""{_COVER} SELECT 'undocumented' AS rule, 'info' AS severity, p.grp, p.name, min((f.file, coalesce(f.decl_line, -1)))[1] AS file FROM per p JOIN fact f USING (grp, name) WHERE NOT documented GROUP BY p.grp, p.name""".replace("min((f.file, coalesce(f.decl_line, -1)))[1]", "min(f.file)"))
def undocumented(spark: SparkSession, d: str) -> DataFrame:
    return L.undocumented(_coverage(spark, d), _facts(spark, d)).drop("line")


_FIND = "find AS (SELECT *, substring(sha256(concat_ws('|', coalesce(rule, ''), coalesce(repo, ''), coalesce(file, ''), coalesce(message, ''))), 1, 16) AS fp FROM findings)"


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "findings").withColumn("fingerprint", T.fingerprint("rule", "repo", "file", "message"))


@_query(f"WITH {_FIND} SELECT finding_id, fp AS fingerprint, fp IN (SELECT fp FROM find WHERE batch_no = 0) AS baselined FROM find")
def baseline_apply(spark: SparkSession, d: str) -> DataFrame:
    findings = _findings(spark, d)
    return L.apply_baseline(findings, findings.where("batch_no = 0")).select("finding_id", "fingerprint", "baselined")


@_query(f"""WITH {_FIND}, b AS (SELECT fp, rule, file, message FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY file, line, coalesce(col, -1), rule, message) AS k FROM find WHERE batch_no = 0) WHERE k = 1)
SELECT fp AS fingerprint, rule, file FROM b WHERE fp NOT IN (SELECT fp FROM find WHERE batch_no > 0)""")
def baseline_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Frozen entries that no later batch reports."""
    findings = _findings(spark, d)
    return L.fixed_entries(findings.where("batch_no > 0"), L.freeze(findings.where("batch_no = 0"))).select("fingerprint", "rule", "file")


@_query("""SELECT repo, count(*) FILTER (lower(severity) = 'error') AS errors, count(*) FILTER (lower(severity) = 'warning') AS warnings, count(*) FILTER (lower(severity) = 'info') AS infos,
  max(CASE lower(severity) WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) AS worst FROM findings WHERE NOT coalesce(baselined, false) GROUP BY repo""")
def severity_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.summary(_t(spark, d, "findings"), ["repo"])


@_query("""SELECT file, rule, count(*) AS n, max(CASE lower(severity) WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) AS worst,
  bool_and(coalesce(baselined, false)) OR max(CASE lower(severity) WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) <= 1 AS skipped, array_to_string(list_sort(list(line)), ',') AS lines FROM findings GROUP BY file, rule""")
def junit_cases(spark: SparkSession, d: str) -> DataFrame:
    return L.junit_cases(_t(spark, d, "findings")).withColumn("lines", F.array_join("lines", ","))


@_query("""SELECT finding_id, row_number() OVER (PARTITION BY repo ORDER BY file, line, coalesce(col, -1), CASE lower(severity) WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END DESC, rule, message, finding_id) AS place FROM findings""")
def report_order(spark: SparkSession, d: str) -> DataFrame:
    """The total order of reports, within each repository; a repository of any size is spread over the tasks."""
    findings = _t(spark, d, "findings").withColumn("col", F.coalesce("col", F.lit(-1)))
    return L.placed(findings, "repo", [*L.report_order(), F.col("finding_id")]).select("finding_id", "place")


@_query("""SELECT finding_id, '::' || CASE lower(severity) WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'notice' END || ' file=' || replace(replace(replace(replace(replace(file, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C')
  || ',line=' || line || '::' || replace(replace(replace(message, '%', '%25'), chr(13), '%0D'), chr(10), '%0A') AS annotation,
  CASE WHEN coalesce(line, 0) <= 0 THEN file WHEN coalesce(col, 0) <= 0 THEN file || ':' || line ELSE file || ':' || line || ':' || col END AS position FROM findings WHERE file IS NOT NULL AND message IS NOT NULL AND line IS NOT NULL""")
def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Workflow annotations and positions, with their escapes."""
    s = F.lower("severity")
    level = F.when(s == "error", "error").when(s == "warning", "warning").otherwise("notice")
    text = F.concat(F.lit("::"), level, F.lit(" file="), T.escape_workflow("file", True), F.lit(",line="), "line", F.lit("::"), T.escape_workflow("message"))
    rows = _t(spark, d, "findings").where("file is not null and message is not null and line is not null")
    return rows.select("finding_id", text.alias("annotation"), T.position_text("file", "line", "col").alias("position"))


@_query("""SELECT finding_id, CASE WHEN length(trim(message)) > 60 THEN substring(trim(message), 1, 57) || '...' ELSE trim(message) END AS snippet, format('{:,}', finding_id * 1204) AS human FROM findings WHERE message IS NOT NULL""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """Context snippets and human numbers."""
    rows = _t(spark, d, "findings").where("message is not null")
    return rows.select("finding_id", T.context_snippet("message", 60).alias("snippet"), T.human_int(F.col("finding_id") * 1204).alias("human"))


@_query("""WITH f AS (SELECT file, line, coalesce(col, -1) AS col, regexp_extract(message, '`([^`]+)`', 1) AS text, suggestion AS fix, rule FROM findings WHERE NOT coalesce(baselined, false) AND suggestion IS NOT NULL AND line > 0)
SELECT file, line, col, text AS old, fix AS new, rule FROM (SELECT *, row_number() OVER (PARTITION BY file, line, col, text ORDER BY rule, fix) AS k FROM f WHERE fix <> text) WHERE k = 1""")
def fix_plan(spark: SparkSession, d: str) -> DataFrame:
    findings = _t(spark, d, "findings").withColumns({"text": F.regexp_extract("message", "`([^`]+)`", 1), "fix": F.col("suggestion"), "col": F.coalesce("col", F.lit(-1))})
    return L.fix_plan(findings)


@_query(f"WITH {_SPANS}, {_SYMBOLS} SELECT DISTINCT {_SHAPE} AS kind, name AS norm FROM spans WHERE name IN (SELECT key FROM keys)")
def mention_set(spark: SparkSession, d: str) -> DataFrame:
    """Distinct resolved claims, the input of coverage."""
    claims = _spans(spark, d).select(T.name_shape("name").alias("kind"), F.col("name").alias("norm"))
    ok = claims.join(_symbol_keys(spark, d), F.col("norm") == F.col("key"), "left_semi").withColumn("status", F.lit("ok"))
    return L.mention_set(ok)


@_query("""WITH p AS (SELECT DISTINCT source AS path, translation AS file FROM pairs WHERE source IS NOT NULL), m AS (SELECT path, file FROM p UNION SELECT file, path FROM p), r AS (SELECT DISTINCT source AS path, translation AS file FROM pairs WHERE source IS NOT NULL UNION SELECT DISTINCT source, source FROM pairs WHERE source IS NOT NULL)
SELECT path, file FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.path = r.path AND m.file = r.file)""")
def mate_filter(spark: SparkSession, d: str) -> DataFrame:
    """References to a document's own translation do not count for staleness."""
    pairs = _t(spark, d, "pairs").where("source is not null").select("source", "translation").distinct()
    refs = pairs.select(F.col("source").alias("path"), F.col("translation").alias("file")).unionByName(pairs.select(F.col("source").alias("path"), F.col("source").alias("file"))).distinct()
    return H.drop_mates(refs, pairs)
