"""Queries that run the check's own operators (tokens, facts, claims, verdicts) over the driver's tables, with their SQL.

``documents`` are the pages, ``source_files`` the code. The SQL reads the same texts by itself: fences by recursion
over their marks, code spans by cutting lines at their backquotes, facts by the patterns that name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions import text as T
from claimlake.operators import comments as C
from claimlake.operators import documents as D
from claimlake.operators import extract as X
from claimlake.operators import ledger as L
from claimlake.operators import resolve as R
from claimlake.plans import driver_queries as Q
from claimlake.session import materialise
from claimlake.sources import facts as S
from claimlake.sources import tokens

QUERIES: dict[str, Q.Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Q.Query) -> Q.Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """(path, text): documents by number, line ends plain, without a byte-order mark."""
    docs = Q._t(spark, d, "documents").where("doc_id is not null and text is not null")
    return docs.select(F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), F.regexp_replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), "^\ufeff", "").alias("text"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_table(_pages(spark, d))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """(file, text): one content per path, the smallest of its copies."""
    files = Q._t(spark, d, "source_files").where("file is not null and content is not null")
    return files.groupBy("file").agg(F.regexp_replace(F.min("content"), "\r\n?", "\n").alias("text"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return S.fact_table(_sources(spark, d))


# --- SQL: lines, fences, spans --------------------------------------------------------------------------------------

_BASE = rf"""WITH RECURSIVE page AS (SELECT 'docs/' || doc_id || '.md' AS path, string_split(replace(CASE WHEN starts_with(text, chr(65279)) THEN substring(text, 2) ELSE text END, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
  lines AS (SELECT path, unnest(CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END) AS text, unnest(range(1, len(l) + CASE WHEN l[-1] = '' THEN 0 ELSE 1 END))::INT AS line FROM page),
  {Q.fence_sql(chr(92) + "s{0,6}")}"""
_SPAN = r""", cut AS (SELECT path, line, string_split(text, '`') AS p FROM marked WHERE NOT fenced),
  span AS (SELECT path, line, p, i, trim(p[i + 1]) AS text FROM (SELECT path, line, p, unnest(range(1, len(p) - 1, 2)) AS i FROM cut) WHERE p[i + 1] <> '')"""


@_query(f"""{_BASE} SELECT path, min(line) AS line, max(line) AS end_line, lower(max(CASE WHEN opens THEN lang END)) AS lang,
  coalesce(string_agg(CASE WHEN NOT opens AND NOT closes THEN text END, chr(10) ORDER BY line), '') AS code FROM marked WHERE fenced GROUP BY path, block""")
def token_fences(spark: SparkSession, d: str) -> DataFrame:
    """Fence scanner of the Markdown tokenizer."""
    return _tokens(spark, d).where("kind = 'fence'").select("path", "line", "end_line", "lang", F.col("text").alias("code"))


@_query(rf"""{_BASE}, below AS (SELECT *, lead(text) OVER (PARTITION BY path ORDER BY line) AS next_text, lead(fenced) OVER (PARTITION BY path ORDER BY line) AS next_fenced FROM marked)
SELECT path, line, length(regexp_extract(text, '^ {{0,3}}(#{{1,6}})[ \t]', 1)) AS level, regexp_extract(text, '^ {{0,3}}#{{1,6}}[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$', 1) AS title FROM below
WHERE NOT fenced AND regexp_extract(text, '^ {{0,3}}#{{1,6}}[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$', 1) <> ''
UNION ALL SELECT path, line, CASE WHEN contains(next_text, '=') THEN 1 ELSE 2 END, trim(text) FROM below WHERE NOT fenced AND trim(text) <> '' AND regexp_matches(next_text, '^ {{0,3}}(=+|-{{2,}})[ \t]*$')
  AND NOT regexp_matches(text, '^\s*(?:[-*+>|]|\d+[.)])') AND NOT regexp_matches(text, '^ {{0,3}}#{{1,6}}[ \t]+\S')""")
def token_headings(spark: SparkSession, d: str) -> DataFrame:
    """Heading scanner: marked and underlined ones."""
    return _tokens(spark, d).where("kind = 'heading'").select("path", "line", "level", F.col("text").alias("title"))


@_query(f"{_BASE}{_SPAN} SELECT path, line, text, octet_length(encode(array_to_string(p[1:i], '`'))) + 2 AS col FROM span")
def token_spans(spark: SparkSession, d: str) -> DataFrame:
    """Code-span scanner, columns in bytes."""
    return _tokens(spark, d).where("kind = 'span'").select("path", "line", "text", F.col("col").cast("bigint").alias("col"))


_CELLS = r"regexp_matches(text, '^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$')"


@_query(rf"""{_BASE}, t AS (SELECT path, line, text, contains(text, '|') AND NOT fenced AS piped, {_CELLS} AND contains(text, '|') AS delimiter FROM marked),
  h AS (SELECT *, piped AND lead(delimiter) OVER w AND NOT regexp_matches(text, '^ {{0,3}}#{{1,6}}[ \t]+\S') AS begins, sum(CASE WHEN contains(text, '|') THEN 0 ELSE 1 END) OVER w AS run FROM t WINDOW w AS (PARTITION BY path ORDER BY line))
SELECT path, line, (SELECT max(x.line) FROM t x, h y WHERE y.path = h.path AND y.line = x.line AND x.path = h.path AND y.run = h.run AND x.line > h.line) - line - 1 AS n_rows,
  len(string_split(trim(trim(text), '|'), '|')) AS n_cols FROM h WHERE begins""")
def token_tables(spark: SparkSession, d: str) -> DataFrame:
    """Table scanner: header line, body rows, columns."""
    return _tokens(spark, d).where("kind = 'table'").select("path", "line", F.col("level").alias("n_rows"), F.col("text").cast("bigint").alias("n_cols"))


# --- claims ---------------------------------------------------------------------------------------------------------

_NAMED = rf"""{_BASE}{_SPAN}, bare AS (SELECT path, line, text, regexp_replace(text, '\(\)$', '') AS name FROM span WHERE length(text) <= 200 AND NOT regexp_matches(text, '^[^{{}}]*\{{[^{{}}]*,[^{{}}]*\}}[^{{}}]*$')),
  shaped AS (SELECT path, line, text, name, {Q._SHAPE} AS shape, text LIKE '%()' AS call FROM bare),
  classed AS (SELECT *, CASE WHEN regexp_matches(name, '^(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS) /') THEN 'route' WHEN shape = 'flag' THEN 'flag' WHEN shape = 'env' THEN 'env' WHEN regexp_matches(name, '^https?://') THEN 'url'
      WHEN shape = 'path' AND NOT regexp_matches(name, '^/|\s') THEN 'path' WHEN regexp_matches(name, '^/[A-Za-z{{:*][^\s]*$') AND NOT regexp_matches(name, '^/(?:etc|usr|var|tmp|home|opt|bin|dev|proc)(?:/|$)|[.][a-z]{{1,4}}$') THEN 'route'
      WHEN regexp_matches(name, '^[\w-]+[.](?:{X.FILE_EXTENSIONS})$') THEN 'path'
      WHEN regexp_matches(name, '^[A-Za-z0-9_./-]+(?: +[A-Za-z0-9_./-]+)+$') AND regexp_matches(name, '[.](?:{X.FILE_EXTENSIONS})$') AND contains(split_part(name, ' ', 1), '/') AND NOT regexp_matches(split_part(name, ' ', 1), '[.](?:{X.FILE_EXTENSIONS})$') THEN 'path'
      WHEN shape IN ('dotted', 'scoped') OR call THEN 'symbol' END AS kind FROM shaped),
  claim AS (SELECT path, line, kind, text, CASE kind WHEN 'flag' THEN lower(replace(regexp_replace(name, '^-+', ''), '_', '-'))
      WHEN 'path' THEN array_to_string(list_filter(string_split(regexp_replace(name, '[:#]L?[0-9].*$', ''), '/'), lambda s: s NOT IN ('', '.')), '/') ELSE name END AS norm,
    CASE WHEN shape IN ('dotted', 'scoped') AND call THEN 3 WHEN kind IN ('path', 'flag', 'env', 'route') THEN 3 ELSE 2 END AS confidence FROM classed WHERE kind IS NOT NULL)"""


def _span_claims(spark: SparkSession, d: str) -> DataFrame:
    return X.span_claims(_tokens(spark, d)).where("not text like '%{%,%}%'")


@_query(f"{_NAMED} SELECT path, line, kind, text, norm, confidence FROM claim")
def claims_spans(spark: SparkSession, d: str) -> DataFrame:
    """Code-span pass: whole spans classified by their shape."""
    return _span_claims(spark, d).select("path", "line", "kind", "text", "norm", "confidence")


_SHELL = f"""{_BASE}, top AS (SELECT path, block, min(line) AS line, lower(max(CASE WHEN opens THEN lang END)) AS lang FROM marked WHERE fenced GROUP BY path, block),
  code AS (SELECT m.path, m.line, m.text, t.lang FROM marked m JOIN top t ON t.path = m.path AND t.block = m.block WHERE m.fenced AND NOT m.opens AND NOT m.closes)"""
_CMD = r""", cmds AS (SELECT path, line, unnest(string_split_regex(regexp_replace(text, '^\s*[$>%] ', ''), '\s*(?:&&|\|\||[|;])\s*')) AS cmd FROM code
    WHERE lang IN ('sh', 'bash', 'shell', 'console', 'zsh', 'shell-session', 'terminal', '') AND NOT regexp_matches(text, '^\s*#')),
  script AS (SELECT path, line, cmd, regexp_extract(cmd, '^(?:sudo\s+)?(?:(?:bash|sh|python3?|node|source|\.)\s+)?((?:\./)?[\w.-]+(?:/[\w.-]+)+|\./[\w.-]+)', 1) AS s,
    regexp_extract(cmd, '^(make|just|task|npm run|cmake --build \S+ --target)\s+([A-Za-z][\w:.-]*)', 1) AS tool, regexp_extract(cmd, '^(make|just|task|npm run|cmake --build \S+ --target)\s+([A-Za-z][\w:.-]*)', 2) AS target FROM cmds)"""


@_query(f"""{_SHELL}{_CMD} SELECT path, line, 'command' AS kind, s AS text FROM script WHERE s <> ''
UNION ALL SELECT path, line, 'target', cmd FROM script WHERE tool <> ''
UNION ALL SELECT path, line, 'install', x FROM (SELECT path, line, unnest(list_transform(regexp_extract_all(cmd, '((?:pip3?|npm|cargo|go|dotnet add|yarn|gem)\\s+(?:install|get|add|package|i)\\s+(?:-[A-Za-z-]+\\s+)*[A-Za-z0-9@][A-Za-z0-9@._/-]*)', 1),
  lambda x: regexp_extract(x, '^([a-z]+)', 1) || ':' || regexp_extract(x, '([^\\s]+)$', 1))) AS x FROM cmds)""")
def claims_shell(spark: SparkSession, d: str) -> DataFrame:
    """Shell lines: scripts, targets, installs."""
    return X.shell_claims(_tokens(spark, d)).where("kind <> 'route'").select("path", "line", "kind", "text")


@_query(f"""{_SHELL} SELECT path, line, trim(text) AS text, lang || ':' || name AS norm FROM (
  SELECT path, line, text, 'go' AS lang, regexp_extract(text, '^\\s*(?:import\\s+)?(?:\\w+\\s+)?"([\\w.-]+/[\\w./-]+)"', 1) AS name FROM code WHERE lang = 'go'
  UNION ALL SELECT path, line, text, 'python', regexp_extract(text, '^\\s*(?:from\\s+([\\w.]+)\\s+import\\b|import\\s+([\\w.]+))', 1) || regexp_extract(text, '^\\s*(?:from\\s+([\\w.]+)\\s+import\\b|import\\s+([\\w.]+))', 2) FROM code WHERE lang IN ('python', 'py')
  UNION ALL SELECT path, line, text, 'js', regexp_extract(text, '(?:from\\s+|require\\(\\s*|import\\s+)[''"]([^''"]+)[''"]', 1) FROM code WHERE lang IN ('js', 'javascript', 'ts', 'typescript', 'jsx', 'tsx')
  UNION ALL SELECT path, line, text, 'c', regexp_extract(text, '^\\s*#\\s*include\\s+[<"]([^<>"]+)[>"]', 1) FROM code WHERE lang IN ('c', 'cpp', 'c++', 'h')
  UNION ALL SELECT path, line, text, 'rust', regexp_extract(text, '^\\s*use\\s+([\\w:]+)', 1) FROM code WHERE lang IN ('rust', 'rs')) WHERE name <> ''""")
def claims_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports in code blocks, by language."""
    return X.import_claims(_tokens(spark, d)).select("path", "line", "text", "norm")


@_query(f"""{_BASE}, said AS (SELECT path, line, text, list_distinct(regexp_extract_all(text, '`(--?[A-Za-z][\\w-]*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)`', 1)) AS d, regexp_extract_all(text, '`(--?[A-Za-z][\\w-]*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)`', 1) AS s,
    regexp_extract(text, '(?i)(?:defaults? to|default is|default value is|\\(default:?|by default,? it is)\\s+`?"?([\\w.:/-]+)`?', 1) AS v FROM lines)
SELECT path, line, 'route' AS kind, x AS norm FROM (SELECT path, line, unnest(regexp_extract_all(text, '\\b((?:GET|POST|PUT|DELETE|PATCH) /[^\\s`''",)|]*)', 1)) AS x FROM lines)
UNION ALL SELECT path, line, 'default', CASE WHEN s[1] LIKE '-%' THEN 'flag:' || lower(replace(regexp_replace(s[1], '^-+', ''), '_', '-')) ELSE 'env:' || s[1] END || '=' || regexp_replace(v, '[.]$', '') FROM said WHERE len(s) = 1 AND v <> ''
UNION ALL SELECT path, line, 'toolchain', regexp_replace(regexp_replace(x, '[.]js', ''), '\\s+v?', ':') FROM (SELECT path, line, unnest(regexp_extract_all(lower(text), '(?:^|[^a-z0-9])((?:go|python|node(?:[.]js)?|rust|cmake|[.]net|java|ruby)\\s+v?[0-9]+(?:[.][0-9]+)*)', 1)) AS x FROM lines
  WHERE regexp_matches(lower(text), 'requires?|needs?|at least|or later|or newer|minimum|tested (?:with|on)|>=') AND NOT regexp_matches(lower(text), 'no longer|does not require|dropped|not required'))""")
def claims_prose(spark: SparkSession, d: str) -> DataFrame:
    """Routes, defaults and toolchain requirements stated in lines."""
    return X.prose_claims(D.explode_lines(_pages(spark, d), "path", "text")).select("path", "line", "kind", "norm")


# --- facts ----------------------------------------------------------------------------------------------------------

_EXT = "regexp_extract(lower(file), '[.]([a-z]+)$', 1)"
_CODE = rf"""WITH src AS (SELECT file, regexp_replace(min(content), '\r\n?', chr(10), 'g') AS body FROM source_files WHERE file IS NOT NULL AND content IS NOT NULL GROUP BY file),
  source AS (SELECT file, CASE {_EXT} WHEN 'go' THEN 'go' WHEN 'py' THEN 'py' WHEN 'rs' THEN 'rust' WHEN 'cs' THEN 'csharp' WHEN 'odin' THEN 'odin' ELSE CASE WHEN {_EXT} IN ('js', 'jsx', 'mjs', 'ts', 'tsx') THEN 'js' WHEN {_EXT} IN ('c', 'h', 'cc', 'cpp', 'hpp') THEN 'c' END END AS lang,
    CASE WHEN starts_with(body, chr(65279)) THEN substring(body, 2) ELSE body END AS text FROM src),
  row_ AS (SELECT file, lang, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM source WHERE lang IS NOT NULL AND text <> '')"""


@_query(rf"""{_CODE}, lit AS (SELECT file, line, unnest(regexp_extract_all(text, '"[A-Za-z0-9_./:{{}}*$@+<>~%-]{{2,80}}"|''[A-Za-z0-9_./:{{}}*$@+<>~%-]{{2,80}}''', 0)) AS x FROM row_)
SELECT file, line::INT AS line, x[2:-2] AS name, count(*) AS n FROM lit WHERE regexp_matches(x, '[A-Za-z]') GROUP BY ALL""")
def fact_literals(spark: SparkSession, d: str) -> DataFrame:
    """String literals that could name something, all languages."""
    return _facts(spark, d).where("kind = 'literal'").groupBy("file", "line", "name").agg(F.count("*").alias("n"))


def _uses_sql() -> str:
    """The patterns of flags, environment, routes and keys, by language, over raw lines."""
    import re

    parts = []
    for lang, patterns in S._USES.items():
        for kind, pattern in patterns:
            if kind == "opaque":
                continue
            names = [n for n in re.compile(pattern).groupindex if n.startswith("name")]
            plain = re.sub(r"\(\?P<(\w+)>", "(", pattern).replace("'", "''")
            groups = re.compile(pattern).groupindex
            for name in names:
                parts.append(f"SELECT file, '{kind}' AS kind, line, unnest(regexp_extract_all(text, '{plain}', {groups[name]})) AS name FROM row_ WHERE lang = '{lang}'")
    return " UNION ALL ".join(parts)


@_query(rf"{_CODE}, used AS ({_uses_sql()}) SELECT file, kind, line::INT AS line, name FROM used WHERE name <> ''")
def fact_uses(spark: SparkSession, d: str) -> DataFrame:
    """Flags, environment variables, routes and keys that code declares or reads."""
    return _facts(spark, d).where("kind in ('flag', 'env', 'route', 'key')").select("file", "kind", "line", "name")


_LEXED = {
    lang: pattern.replace("'", "''") for lang, pattern in S._STRINGS.items()
}
_TOP = {
    "go": (("func", r"^func\s+(\w+)", 1, ""),), "py": (("func", r"^(?:async\s+)?def\s+(\w+)", 1, ""), ("type", r"^class\s+(\w+)", 1, "")),
    "rust": (("func", r"^(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\S*\s*)*fn\s+(\w+)", 1, ""), ("type", r"^(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union|type)\s+(\w+)", 1, "")),
    "js": (("func", r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)", 1, ""),),
}


def _declared_sql() -> str:
    parts = []
    for lang, patterns in _TOP.items():
        for kind, pattern, _, _ in patterns:
            parts.append(f"SELECT file, '{kind}' AS kind, regexp_extract(text, '{pattern}', 1) AS name FROM blank WHERE lang = '{lang}'")
    return " UNION ALL ".join(parts)


_BLANK = " UNION ALL ".join(f"SELECT file, lang, unnest(string_split(regexp_replace(text, '(?s){rx}', '~', 'g'), chr(10))) AS text FROM source WHERE lang = '{lang}'" for lang, rx in _LEXED.items() if lang in _TOP)


@_query(rf"{_CODE}, blank AS ({_BLANK}), top AS ({_declared_sql()}) SELECT file, kind, name, count(*) AS n FROM top WHERE name <> '' GROUP BY ALL")
def fact_functions(spark: SparkSession, d: str) -> DataFrame:
    """Declarations at the outermost level: functions of Go, Python, Rust and scripts, types of Python and Rust."""
    top = F.col("owner") == ""
    kinds = ((F.col("kind") == "func") & F.col("lang").isin("go", "py", "rust", "js")) | ((F.col("kind") == "type") & F.col("lang").isin("py", "rust"))
    return _facts(spark, d).where(top & kinds).groupBy("file", "kind", "name").agg(F.count("*").alias("n"))


def _span_facts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of ``symbol_spans`` in the shape of facts."""
    spans = Q._t(spark, d, "symbol_spans").where("full_name is not null and file is not null").select("file", "full_name", "exported").distinct()
    parts = F.split("full_name", "[.:#]+")
    return spans.select(
        "file", F.lit("go").alias("lang"), F.lit("func").alias("kind"), F.element_at(parts, -1).alias("name"), F.lit("").alias("owner"),
        F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".").alias("value"), F.lit(1).alias("line"), F.lit(1).alias("end_line"), F.coalesce("exported", F.lit(False)).alias("exported"),
    )


_KEYS = r"""sp AS (SELECT DISTINCT string_split_regex(full_name, '[.:#]+') AS p FROM symbol_spans WHERE full_name IS NOT NULL AND file IS NOT NULL),
  symkey AS (SELECT DISTINCT unnest([array_to_string(p, '.'), p[-1], CASE WHEN len(p) > 1 THEN p[-2] || '.' || p[-1] ELSE p[-1] END]) AS key, p[1] AS head FROM sp)"""


@_query(f"WITH {_KEYS} SELECT DISTINCT key FROM symkey")
def symbol_key_table(spark: SparkSession, d: str) -> DataFrame:
    """Every accepted spelling of a symbol: whole, with its package, bare."""
    return S.symbol_keys(_span_facts(spark, d)).select("key").distinct()


# --- verdicts -------------------------------------------------------------------------------------------------------


def _status(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("path", "line", "text", "norm", "status")


@_query(rf"""{_NAMED}, {_KEYS}, ok AS (SELECT DISTINCT key FROM symkey), heads AS (SELECT DISTINCT regexp_extract(array_to_string(p, '.'), '^([A-Za-z_]\w*)', 1) AS h FROM sp UNION SELECT DISTINCT regexp_extract(key, '^([A-Za-z_]\w*)', 1) FROM symkey)
SELECT path, line, text, norm, CASE WHEN norm IN (SELECT key FROM ok) THEN 'ok' WHEN regexp_extract(norm, '^([A-Za-z_]\w*)', 1) NOT IN (SELECT h FROM heads) AND regexp_matches(norm, '[.:]') THEN 'skipped' ELSE 'missing' END AS status FROM claim WHERE kind = 'symbol'""")
def verdict_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbol resolvers over the claims of all pages."""
    none = spark.createDataFrame([], "name string")
    return _status(R.symbols(_span_claims(spark, d), S.symbol_keys(_span_facts(spark, d)), none, none.withColumnRenamed("name", "key")))


@_query(rf"""{_NAMED}, known AS (SELECT DISTINCT file AS rel FROM source_files WHERE file IS NOT NULL), dirs AS (SELECT DISTINCT array_to_string(string_split(rel, '/')[1:n], '/') AS rel FROM (SELECT rel, unnest(range(1, len(string_split(rel, '/')))) AS n FROM known)),
  every AS (SELECT rel FROM known UNION SELECT rel FROM dirs)
SELECT path, line, text, norm, CASE WHEN norm IN (SELECT rel FROM every) OR 'docs/' || norm IN (SELECT rel FROM every) THEN 'ok' ELSE 'missing' END AS status FROM claim WHERE kind = 'path'""")
def verdict_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path resolver over the claims of all pages: files and directories, from the root and the page."""
    files = Q._known_files(spark, d)
    dirs = files.select(F.explode(T.ancestors("rel")).alias("rel")).where("rel <> '.'").distinct()
    table = files.withColumn("is_dir", F.lit(False)).unionByName(dirs.withColumn("is_dir", F.lit(True)))
    # The resolver asks for its claims several times; the pages are scanned once.
    claims = materialise(_span_claims(spark, d).where("kind = 'path'"), "claims")
    return _status(R.paths(claims, table))


@_query(rf"""{_NAMED}, {_CODE[5:]}, used AS ({_uses_sql()}), flag AS (SELECT DISTINCT lower(replace(regexp_replace(name, '^-+', ''), '_', '-')) AS k FROM used WHERE kind = 'flag' AND name <> ''),
  lit AS (SELECT DISTINCT regexp_replace(x[2:-2], '^-+', '') AS k FROM (SELECT unnest(regexp_extract_all(text, '"[A-Za-z0-9_./:{{}}*$@+<>~%-]{{2,80}}"|''[A-Za-z0-9_./:{{}}*$@+<>~%-]{{2,80}}''', 0)) AS x FROM row_) WHERE regexp_matches(x, '[A-Za-z]'))
SELECT path, line, text, norm, CASE WHEN norm IN (SELECT k FROM flag) OR norm IN (SELECT k FROM lit) THEN 'ok' WHEN NOT EXISTS (SELECT 1 FROM flag) THEN 'skipped' ELSE 'missing' END AS status FROM claim WHERE kind = 'flag'""")
def verdict_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flag resolver: declared flags and literals of the sources."""
    return _status(R.flags(_span_claims(spark, d), _facts(spark, d)))


@_query(rf"""{_NAMED}, {_CODE[5:]}, used AS ({_uses_sql()}), env AS (SELECT DISTINCT name AS k FROM used WHERE kind = 'env' AND name <> ''),
  lit AS (SELECT DISTINCT regexp_replace(x[2:-2], '^-+', '') AS k FROM (SELECT unnest(regexp_extract_all(text, '"[A-Za-z0-9_./:{{}}*$@+<>~%-]{{2,80}}"|''[A-Za-z0-9_./:{{}}*$@+<>~%-]{{2,80}}''', 0)) AS x FROM row_) WHERE regexp_matches(x, '[A-Za-z]')),
  cst AS (SELECT norm FROM claim WHERE false)
SELECT path, line, text, norm, CASE WHEN norm IN (SELECT k FROM env) OR norm IN (SELECT k FROM lit) THEN 'ok' WHEN NOT EXISTS (SELECT 1 FROM env) OR regexp_matches(norm, '{R.EXTERNAL_ENV}') THEN 'skipped' ELSE 'missing' END AS status FROM claim WHERE kind = 'env'""")
def verdict_envs(spark: SparkSession, d: str) -> DataFrame:
    """Environment resolver: variables the sources read, literals, names that systems own."""
    return _status(R.envs(_span_claims(spark, d), _facts(spark, d).where("kind <> 'const'")))


_ORDERS = "substring(o_orderpriority, 1, 1)"


@_query(f"""WITH asked AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'GET ' WHEN 1 THEN 'POST ' WHEN 2 THEN 'DELETE ' ELSE '' END AS verb, CASE c_custkey % 3 WHEN 0 THEN '' ELSE '/api' END AS pre, c_nationkey AS a, c_custkey % 7 AS b FROM customer),
  known AS (SELECT DISTINCT n_nationkey AS a, CASE n_nationkey % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method FROM nation WHERE n_nationkey % 5 <> 0)
SELECT id, verb || pre || '/' || 'n' || a || '/items/' || b AS norm, CASE WHEN EXISTS (SELECT 1 FROM known k WHERE k.a = asked.a AND (verb = '' OR verb = k.method || ' ')) THEN 'ok' ELSE 'missing' END AS status FROM asked""")
def verdict_routes(spark: SparkSession, d: str) -> DataFrame:
    """Route resolver: methods, parameters, routers mounted under a prefix."""
    key = F.col("c_custkey")
    verb = F.when(key % 4 == 0, "GET ").when(key % 4 == 1, "POST ").when(key % 4 == 2, "DELETE ").otherwise("")
    norm = F.concat(verb, F.when(key % 3 == 0, "").otherwise("/api"), F.lit("/n"), F.col("c_nationkey"), F.lit("/items/"), key % 7)
    asked = Q._t(spark, d, "customer").select(F.concat(F.lit("c"), key).alias("path"), key.cast("int").alias("line"), F.lit(1).alias("col"), F.lit("route").alias("kind"), norm.alias("text"), norm.alias("norm"), F.lit(3).alias("confidence"))
    nation = Q._t(spark, d, "nation").where("n_nationkey % 5 <> 0")
    known = nation.select(F.lit("route").alias("kind"), F.concat(F.when(F.col("n_nationkey") % 2 == 0, "GET").otherwise("POST"), F.lit(" /n"), "n_nationkey", F.lit("/items/{id}")).alias("name"))
    return R.routes(asked, known).select(F.col("line").cast("bigint").alias("id"), "norm", "status")


@_query(rf"""{Q._MARKED}{Q._HEADINGS}, pages AS (SELECT DISTINCT path FROM lines), asked AS (SELECT path, line, path || '#' || replace(slug, '-', '_') AS norm FROM heads UNION ALL SELECT path, line, path || '#' || slug || '-none' FROM heads UNION ALL SELECT path, line, 'x/' || path || '#' || slug FROM heads),
  slugs AS (SELECT DISTINCT path, replace(lower(slug), '_', '-') AS k FROM heads)
SELECT a.path, line, norm, CASE WHEN EXISTS (SELECT 1 FROM slugs s WHERE s.path = split_part(norm, '#', 1) AND s.k = replace(lower(regexp_replace(norm, '^.*#', '')), '_', '-')) THEN 'ok'
  WHEN split_part(norm, '#', 1) NOT IN (SELECT path FROM pages) THEN 'skipped' ELSE 'missing' END AS status FROM asked a""")
def verdict_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchor resolver: headings of every page asked for loosely spelled, with a wrong ending, and on a page that does not exist."""
    lines = Q._lines(spark, d)
    heads = D.headings(lines)
    spelled = F.explode(F.array(F.concat_ws("#", "path", F.translate("slug", "-", "_")), F.concat_ws("#", "path", F.concat("slug", F.lit("-none"))), F.concat_ws("#", F.concat(F.lit("x/"), "path"), "slug")))
    asked = heads.select("path", "line", spelled.alias("norm")).select("path", "line", F.lit(1).alias("col"), F.lit("anchor").alias("kind"), F.col("norm").alias("text"), "norm", F.lit(3).alias("confidence"))
    known = heads.select("path", "slug").unionByName(lines.select("path").distinct().withColumn("slug", F.lit(None).cast("string")))
    return R.anchors(asked, known).select("path", "line", "norm", "status")


@_query("""WITH asked AS (SELECT s_suppkey AS id, unnest(['Go.Items[' || s_suppkey || '].name', 'go.items.name', 'go.' || lower(s_name)]) AS norm FROM supplier), keys AS (SELECT 'go.items.name' AS k UNION SELECT 'go.' || lower(s_name) FROM supplier WHERE s_suppkey % 2 = 0)
SELECT id, norm, CASE WHEN lower(regexp_replace(norm, '\\[[0-9]+\\]', '', 'g')) IN (SELECT lower(k) FROM keys) THEN 'ok' ELSE 'missing' END AS status FROM asked""")
def verdict_config(spark: SparkSession, d: str) -> DataFrame:
    """Configuration keys: without case and list positions."""
    s = Q._t(spark, d, "supplier")
    spelled = F.explode(F.array(F.concat(F.lit("Go.Items["), "s_suppkey", F.lit("].name")), F.lit("go.items.name"), F.concat(F.lit("go."), F.lower("s_name"))))
    asked = s.select(F.lit("p").alias("path"), F.col("s_suppkey").cast("int").alias("line"), F.lit(1).alias("col"), F.lit("config").alias("kind"), spelled.alias("norm")).select("*", F.col("norm").alias("text"), F.lit(3).alias("confidence"))
    keys = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("go."), F.lower("s_name")).alias("key")).unionByName(spark.createDataFrame([("go.items.name",)], "key string"))
    return R.config_keys(asked, keys, spark.createDataFrame([], "name string")).select(F.col("line").cast("bigint").alias("id"), "norm", "status")


@_query("""WITH asked AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'install' WHEN 1 THEN 'target' WHEN 2 THEN 'toolchain' ELSE 'default' END AS kind, p_size AS n FROM part)
SELECT id, kind, CASE kind WHEN 'install' THEN CASE WHEN n % 2 = 0 THEN 'ok' ELSE 'missing' END WHEN 'target' THEN CASE WHEN n % 3 = 0 THEN 'missing' WHEN n % 3 = 1 THEN 'ok' ELSE 'skipped' END
  WHEN 'toolchain' THEN CASE WHEN n % 3 = 0 THEN 'ok' WHEN n % 3 = 1 THEN 'missing' ELSE 'skipped' END ELSE CASE WHEN n % 2 = 0 THEN 'ok' ELSE 'missing' END END AS status,
  CASE WHEN kind = 'toolchain' AND n % 3 = 1 THEN CASE WHEN n % 2 = 0 THEN 'warning' ELSE 'info' END ELSE '' END AS level FROM asked""")
def verdict_project(spark: SparkSession, d: str) -> DataFrame:
    """Installs, targets, toolchains and defaults against manifests and declared values."""
    k, n = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 4 == 0, "install").when(k % 4 == 1, "target").when(k % 4 == 2, "toolchain").otherwise("default")
    norm = (
        F.when(k % 4 == 0, F.when(n % 2 == 0, "pip:widget").otherwise("pip:widgte")).when(k % 4 == 1, F.when(n % 3 == 0, "make:deploy").when(n % 3 == 1, "make:build").otherwise("just:build"))
        .when(k % 4 == 2, F.when(n % 3 == 0, "go:1.26").when(n % 3 == 1, F.when(n % 2 == 0, "go:1.20").otherwise("go:1.30")).otherwise("ruby:3")).otherwise(F.when(n % 2 == 0, "flag:wait=1m").otherwise("flag:wait=2m"))
    )
    asked = Q._t(spark, d, "part").select(F.lit("p").alias("path"), k.cast("int").alias("line"), F.lit(1).alias("col"), kind.alias("kind"), norm.alias("text"), norm.alias("norm"), F.lit(3).alias("confidence"))
    project = {"names": {"pip": "widget"}, "versions": {"go": "1.26"}, "targets": {"make": ["build"]}}
    facts = spark.createDataFrame([("flag", "--wait", "60s", "a.go", 1)], "kind string, name string, value string, file string, line int")
    return R.project_claims(asked, project, facts).select(F.col("line").cast("bigint").alias("id"), "kind", "status", F.when(F.col("status") == "missing", F.coalesce("level", F.lit(""))).otherwise("").alias("level"))


@_query("""WITH reg AS (SELECT n_nationkey AS k, CASE n_nationkey % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, '/n' || n_nationkey || '/{id}' AS path FROM nation)
SELECT method, path, EXISTS (SELECT 1 FROM customer c WHERE c_nationkey = k AND c_custkey % 3 = 0 AND (c_custkey % 2 = 0 OR method = 'GET')) AS documented FROM reg""")
def route_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Registered routes that some claimed route meets."""
    nation = Q._t(spark, d, "nation")
    path = F.concat(F.lit("/n"), "n_nationkey", F.lit("/{id}"))
    routes = nation.select(F.when(F.col("n_nationkey") % 2 == 0, "GET").otherwise("POST").alias("method"), path.alias("path"), T.route_segments(path).alias("segs"))
    said = Q._t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.when(F.col("c_custkey") % 2 == 1, "GET").alias("method"), T.route_segments(F.concat(F.lit("/n"), "c_nationkey", F.lit("/"), "c_custkey")).alias("segs"))
    return L.route_coverage(routes, said)


@_query()
def claims_all(spark: SparkSession, d: str) -> DataFrame:
    """All passes together: denied and placeholder claims dropped, the first pass wins."""
    toks = _tokens(spark, d)
    return X.claims(toks, D.explode_lines(_pages(spark, d), "path", "text"))


@_query()
def comment_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Code-like words of comments that neither their file nor the index knows."""
    sources, facts = _sources(spark, d), _facts(spark, d)
    return C.mentions(S.doc_spans(sources), sources, S.symbol_keys(facts), facts.where("kind = 'literal'"))


@_query()
def example_faults(spark: SparkSession, d: str) -> DataFrame:
    """Go examples that cannot parse."""
    return C.example_faults(_tokens(spark, d))
