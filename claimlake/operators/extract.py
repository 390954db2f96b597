"""Claims out of document tokens: one projection per pass, the first pass wins.

Claims: path, line, col, kind, text, norm, confidence (3 high, 2 medium, 1 low), pass.
Kinds: path, anchor, url, flag, env, symbol, config, route, import, command, install, target, toolchain, default.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.functions import text as T

COLUMNS = ("path", "line", "col", "kind", "text", "norm", "confidence", "pass")
#: Names that stand for something else in examples (fixed values).
PLACEHOLDERS = r"(?i)(?:^|[/._-])(?:foo|bar|baz|path/to|example|my[-_]?\w*|your[-_]?\w*|xxx+|nnn+|num|placeholder)(?:$|[/._-])|[<>{}$…]|\.\.\."
#: Extensions that make a bare name, or a name with blanks, a file (fixed values).
FILE_EXTENSIONS = "go|py|rs|js|ts|tsx|c|h|cpp|cs|md|rst|toml|yaml|yml|json|sh|txt|mod|lock|cfg|ini|odin"
#: Programs of others; what follows them describes them (fixed values).
OTHER_PROGRAMS = "git go npm npx yarn pnpm cargo rustup pip pip3 python python3 node docker kubectl curl wget make cmake dotnet brew apt apt-get tar ssh sudo cd ls cat grep find export".split()
#: Hosts that are never probed (fixed values).
LOCAL_HOSTS = r"^https?://(?:localhost|127\.|0\.0\.0\.0|10\.|192\.168\.|\[::1\]|[^/]*\bexample\.(?:com|org|net)|[^/]*\.(?:local|test|invalid|example))(?:[:/]|$)"
_SHELL = ("sh", "bash", "shell", "console", "zsh", "shell-session", "terminal", "")


def _claim(df: DataFrame, kind: Column, text: Column, norm: Column, confidence: Column, number: int) -> DataFrame:
    return df.select("path", "line", F.coalesce("col", F.lit(1)).alias("col"), kind.alias("kind"), text.alias("text"), norm.alias("norm"), confidence.cast("int").alias("confidence"), F.lit(number).alias("pass"))


def span_claims(tokens: DataFrame) -> DataFrame:
    """Whole code spans by their shape; calls lose their parentheses, braces are expanded."""
    spans = tokens.where("kind = 'span' and length(text) <= 200").select("path", "line", "col", F.explode(T.expand_braces("text")).alias("text"))
    bare = F.regexp_replace("text", "\\(\\)$", "")
    shaped = spans.withColumns({"bare": bare, "shape": T.name_shape(bare), "call": F.col("text").endswith("()")})
    first = F.col("bare").rlike("^(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS) /")
    kind = (
        F.when(first, "route").when(F.col("shape") == "flag", "flag").when(F.col("shape") == "env", "env").when(F.col("bare").rlike("^https?://"), "url")
        .when((F.col("shape") == "path") & ~F.col("bare").rlike("^/|\\s"), "path").when(F.col("bare").rlike("^/[A-Za-z{:*][^\\s]*$") & ~F.col("bare").rlike("^/(?:etc|usr|var|tmp|home|opt|bin|dev|proc)(?:/|$)|[.][a-z]{1,4}$"), "route")
        .when(F.col("bare").rlike(f"^[\\w-]+[.](?:{FILE_EXTENSIONS})$"), "path")
        .when(_spaced(F.col("bare")), "path")
        .when(F.col("shape").isin("dotted", "scoped") | F.col("call"), "symbol")
    )
    confidence = F.when(F.col("shape").isin("dotted", "scoped") & F.col("call"), 3).when(kind.isin("path", "flag", "env", "route"), 3).otherwise(2)
    norm = F.when(kind == "flag", T.flag_key("bare")).when(kind == "path", T.clean_path(F.regexp_replace("bare", "[:#]L?[0-9].*$", ""))).otherwise(F.col("bare"))
    return _claim(shaped.where(kind.isNotNull()), kind, F.col("text"), norm, confidence, 1)


def _spaced(name: Column) -> Column:
    """A file name with blanks: the first word has a directory and no extension, the last one an extension."""
    first = F.regexp_extract(name, "^([^ ]+) ", 1)
    return name.rlike("^[A-Za-z0-9_./-]+(?: +[A-Za-z0-9_./-]+)+$") & name.rlike(f"[.](?:{FILE_EXTENSIONS})$") & F.contains(first, F.lit("/")) & ~first.rlike(f"[.](?:{FILE_EXTENSIONS})$")


def token_claims(tokens: DataFrame) -> DataFrame:
    """Claims inside spans of several words (command lines, expressions): symbols, flags, environment, paths.

    Flags behind another program's name are that program's; ``go run`` starts one of ours.
    """
    spans = tokens.where("kind = 'span' and length(text) <= 200").where(F.col("text").rlike("\\s|\\(.+\\)")).where(~_spaced(F.col("text")))
    program = F.regexp_extract("text", "^\\s*(\\S+)", 1)
    ours = ~program.isin(*OTHER_PROGRAMS) | F.col("text").rlike("^\\s*go\\s+run\\s")
    each = lambda pattern, keep=None: (spans if keep is None else spans.where(keep)).select("path", "line", "col", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias("x"))
    edge = "(?:^|[\\s=,(\\[])"
    symbols = each("(?:^|[^\\w./:-])([A-Za-z_]\\w*(?:(?:[.]|::)[A-Za-z_]\\w*)+)(?![\\w/-]|[.]\\w|::)").where(~F.col("x").rlike(f"[.](?:{FILE_EXTENSIONS})$"))
    flags = each(edge + "(--?[A-Za-z][\\w-]*)", ours)
    envs = each("(?:^|[\\s=,($\\[{])([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)(?!\\w)")
    files = each(edge + "((?:[.]{0,2}/)?(?:[\\w.-]+/)+[\\w-][\\w.-]*)(?=$|[\\s,)\\]])").where(~F.col("x").rlike("^/"))
    out = _claim(symbols, F.lit("symbol"), F.col("x"), F.col("x"), F.lit(2), 1)
    out = out.unionByName(_claim(flags, F.lit("flag"), F.col("x"), T.flag_key("x"), F.when(F.col("x").startswith("--"), 2).otherwise(1), 1))
    out = out.unionByName(_claim(envs, F.lit("env"), F.col("x"), F.col("x"), F.lit(2), 1))
    return out.unionByName(_claim(files, F.lit("path"), F.col("x"), T.clean_path("x"), F.lit(2), 1))


def external_names(tokens: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(path, name): names that a document's examples import from packages the repository does not own.

    ``namespaces``: head, the first parts of the repository's own names.
    """
    items = lambda text: F.transform(F.split(text, ","), lambda x: F.trim(F.regexp_replace(x, "^.*\\sas\\s+|^.*::|[()\\s]", "")))
    rust = _fence_lines(tokens, "rust", "rs").withColumns({"head": F.regexp_extract("code", "^\\s*(?:pub\\s+)?use\\s+(\\w+)", 1), "bound": F.regexp_extract("code", "use\\s+(?:\\w+::)*(\\{[^}]*\\}|[\\w\\s]+);?\\s*$", 1)})
    python = _fence_lines(tokens, "python", "py").withColumns({"head": F.regexp_extract("code", "^\\s*(?:from|import)\\s+(\\w+)", 1), "bound": F.coalesce(F.nullif(F.regexp_extract("code", "^\\s*from\\s+\\S+\\s+import\\s+(.+)$", 1), F.lit("")), F.regexp_extract("code", "^\\s*import\\s+(.+)$", 1))})
    script = _fence_lines(tokens, "js", "javascript", "ts", "typescript", "jsx", "tsx").withColumns({"head": F.regexp_extract("code", "from\\s+['\"](@?[\\w-]+)", 1), "bound": F.regexp_extract("code", "^\\s*import\\s+(?:type\\s+)?(.+?)\\s+from\\b", 1)})
    go = _fence_lines(tokens, "go").withColumns({"head": F.regexp_extract("code", "\"([\\w.-]+)[\\w./-]*\"\\s*$", 1), "bound": F.regexp_extract("code", "^\\s*(?:import\\s+)?\"(?:[\\w.-]+/)*([\\w-]+)\"\\s*$", 1)})
    every = reduce(DataFrame.unionByName, [x.where("head <> '' and bound <> ''").select("path", "head", F.regexp_replace("bound", "[{}*]", "").alias("bound")) for x in (rust, python, script, go)])
    own = namespaces.select("head").unionByName(namespaces.sparkSession.createDataFrame([("crate",), ("self",), ("super",)], "head string")).distinct()
    foreign = every.join(own, "head", "left_anti")
    return foreign.select("path", F.explode(items(F.col("bound"))).alias("name")).where("name <> ''").distinct()


def table_defaults(tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """Defaults in the column of that name of tables whose first cell names a flag, a variable or a key. ``lines``: path, line, text."""
    tables = tokens.where("kind = 'table'").select("path", F.col("line").alias("top"), F.col("level").alias("n"))
    cells = lambda c: F.transform(F.split(F.regexp_replace(F.trim(c), "^[|]|[|]$", ""), "[|]", -1), lambda x: F.trim(x))
    head = tables.join(lines.select("path", F.col("line").alias("top"), cells(F.col("text")).alias("head")), ["path", "top"])
    at = F.array_position(F.transform("head", lambda x: x.rlike("(?i)^`?default(?: value)?`?$")), True)
    rows = head.withColumn("at", at).where("at > 1 and n > 0").select("path", "at", F.explode(F.sequence(F.col("top") + 2, F.col("top") + 1 + F.col("n"))).alias("line"))
    body = rows.join(lines.select("path", "line", F.col("text").alias("row"), cells(F.col("text")).alias("cells")), ["path", "line"])
    subject = F.regexp_extract(F.get("cells", F.lit(0)), "`([^`]+)`", 1)
    value = F.get("cells", (F.col("at") - 1).cast("int"))
    kind = F.when(subject.rlike("^--?[A-Za-z]"), F.concat(F.lit("flag:"), T.flag_key(subject))).when(subject.rlike("^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$"), F.concat(F.lit("env:"), subject)).when(subject.rlike("^[a-z]\\w*(?:[.]\\w+)*$"), F.concat(F.lit("key:"), subject))
    named = body.withColumns({"subject": kind, "value": F.regexp_replace(value, "^`|`$", ""), "col": F.lit(1)}).where("subject is not null and value <> ''")
    return _claim(named, F.lit("default"), F.trim("row"), F.concat_ws("=", "subject", "value"), F.lit(3), 6)


def link_claims(tokens: DataFrame) -> DataFrame:
    """Link targets as urls, paths and anchors, seen from the document's directory."""
    links = tokens.where("kind in ('link', 'image') and target is not null and target <> ''").withColumn("what", T.link_kind("target"))
    plain = F.regexp_replace(F.regexp_replace("target", "[?#].*$", ""), "%20", " ")
    resolved = T.join_relative(T.dir_name("path"), plain)
    urls = _claim(links.where("what = 'url'"), F.lit("url"), F.col("target"), F.col("target"), F.lit(3), 2)
    paths = _claim(links.where("what in ('path', 'path_anchor')"), F.lit("path"), F.col("target"), resolved, F.lit(3), 2)
    anchored = links.where("what in ('anchor', 'path_anchor')").where(~F.col("target").rlike("#L[0-9]+"))
    page = F.when(F.col("what") == "anchor", F.col("path")).otherwise(resolved)
    anchors = _claim(anchored, F.lit("anchor"), F.col("target"), F.concat_ws("#", page, F.substring_index("target", "#", -1)), F.lit(3), 2)
    return urls.unionByName(paths).unionByName(anchors)


def _fence_lines(tokens: DataFrame, *langs: str) -> DataFrame:
    fences = tokens.where((F.col("kind") == "fence") & F.coalesce("lang", F.lit("")).isin(*langs))
    return fences.select("path", F.col("line").alias("top"), F.posexplode(F.split("text", "\n")).alias("pos", "code")).select("path", "top", (F.col("top") + F.col("pos") + 1).alias("line"), F.lit(1).alias("col"), "code")


def shell_claims(tokens: DataFrame) -> DataFrame:
    """Commands, scripts, flags, installs, targets and requests in shell lines."""
    lines = _fence_lines(tokens, *_SHELL).where(~F.col("code").rlike("^\\s*#"))
    parts = lines.select("path", "line", "col", F.explode(F.split(F.regexp_replace("code", "^\\s*[$>%] ", ""), "\\s*(?:&&|\\|\\||[|;])\\s*")).alias("cmd"))
    script = F.regexp_extract("cmd", "^(?:sudo\\s+)?(?:(?:bash|sh|python3?|node|source|\\.)\\s+)?((?:\\./)?[\\w.-]+(?:/[\\w.-]+)+|\\./[\\w.-]+)", 1)
    scripts = _claim(parts.where(script != ""), F.lit("command"), script, T.clean_path(script), F.lit(3), 3)
    package = parts.select("path", "line", "col", F.explode(T.install_claims("cmd")).alias("x"))
    installs = _claim(package, F.lit("install"), F.col("x"), F.col("x"), F.lit(3), 3)
    tool, target = (F.regexp_extract("cmd", "^(make|just|task|npm run|cmake --build \\S+ --target)\\s+([A-Za-z][\\w:.-]*)", n) for n in (1, 2))
    targets = _claim(parts.where(tool != ""), F.lit("target"), F.col("cmd"), F.concat_ws(":", F.regexp_extract(tool, "^(\\w+)", 1), target), F.lit(3), 3)
    path = F.regexp_extract("cmd", "^curl\\b.*?https?://(?:localhost|127[.]0[.]0[.]1)(?::[0-9]+)?(/[^\\s'\"?]*)", 1)
    method = F.regexp_extract("cmd", "-X\\s*([A-Z]+)", 1)
    requests = _claim(parts.where(path != ""), F.lit("route"), F.col("cmd"), F.when(method == "", path).otherwise(F.concat_ws(" ", method, path)), F.lit(3), 3)
    return scripts.unionByName(installs).unionByName(targets).unionByName(requests)


def import_claims(tokens: DataFrame) -> DataFrame:
    """Imports in code blocks, by language."""
    patterns = {
        ("go",): "^\\s*(?:import\\s+)?(?:\\w+\\s+)?\"([\\w.-]+/[\\w./-]+)\"", ("python", "py"): "^\\s*(?:from\\s+([\\w.]+)\\s+import\\b|import\\s+([\\w.]+))", ("c", "cpp", "c++", "h"): "^\\s*#\\s*include\\s+[<\"]([^<>\"]+)[>\"]",
        ("js", "javascript", "ts", "typescript", "jsx", "tsx"): "(?:from\\s+|require\\(\\s*|import\\s+)['\"]([^'\"]+)['\"]", ("rust", "rs"): "^\\s*use\\s+([\\w:]+)",
    }
    out = []
    for langs, pattern in patterns.items():
        lines = _fence_lines(tokens, *langs)
        name = F.regexp_extract("code", pattern, 1)
        if "|import" in pattern:
            name = F.concat(name, F.regexp_extract("code", pattern, 2))
        out.append(_claim(lines.where(name != ""), F.lit("import"), F.trim("code"), F.concat_ws(":", F.lit(langs[0]), name), F.lit(3), 3))
    return reduce(DataFrame.unionByName, out)


def config_claims(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """Top keys of JSON examples of which at least one is a known key; surer when half of them are. ``known``: key."""
    tops = _fence_lines(tokens, "json", "jsonc", "json5").withColumn("key", F.regexp_extract("code", "^ {0,4}\"([A-Za-z][\\w.-]*)\"\\s*:", 1)).where("key <> ''")
    fenced = tops.join(known.select("key", F.lit(1).alias("hit")).distinct(), "key", "left")
    share = Window.partitionBy("path", "top")
    rated = fenced.withColumns({"n": F.count("*").over(share), "n_hit": F.count("hit").over(share)}).where("n_hit > 0")
    return _claim(rated, F.lit("config"), F.col("key"), F.col("key"), F.when(F.col("n_hit") * 2 >= F.col("n"), 3).otherwise(2), 3)


def bare_claims(tokens: DataFrame) -> DataFrame:
    """Paths in prose, medium at most."""
    bare = tokens.where("kind = 'bare'").where(F.col("text").rlike("[.][A-Za-z]{1,5}$|^(?:docs|src|cmd|pkg|internal|tests?|scripts|tools)/"))
    return _claim(bare, F.lit("path"), F.col("text"), T.clean_path("text"), F.lit(2), 4)


def prose_claims(lines: DataFrame) -> DataFrame:
    """Routes, defaults and toolchain requirements stated in lines. ``lines``: path, line, text."""
    col = lines.withColumn("col", F.lit(1))
    routes = col.select("path", "line", "col", F.explode(F.regexp_extract_all("text", F.lit("\\b((?:GET|POST|PUT|DELETE|PATCH) /[^\\s`'\",)|]*)"), 1)).alias("x"))
    subjects = F.regexp_extract_all("text", F.lit("`(--?[A-Za-z][\\w-]*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)`"), 1)
    value = F.regexp_extract("text", "(?i)(?:defaults? to|default is|default value is|\\(default:?|by default,? it is)\\s+`?\"?([\\w.:/-]+)`?", 1)
    stated = col.where((F.size(subjects) == 1) & (value != ""))
    subject = F.get(subjects, F.lit(0))
    defaults = F.concat_ws("=", F.when(subject.startswith("-"), F.concat(F.lit("flag:"), T.flag_key(subject))).otherwise(F.concat(F.lit("env:"), subject)), F.regexp_replace(value, "[.]$", ""))
    needs = F.lower("text").rlike("requires?|needs?|at least|or later|or newer|minimum|tested (?:with|on)|>=") & ~F.lower("text").rlike("no longer|does not require|dropped|not required")
    tools = col.where(needs).select("path", "line", "col", F.explode(T.toolchain_claims("text")).alias("x"))
    return (
        _claim(routes, F.lit("route"), F.col("x"), F.col("x"), F.lit(2), 5)
        .unionByName(_claim(stated, F.lit("default"), F.trim("text"), defaults, F.lit(3), 6))
        .unionByName(_claim(tools, F.lit("toolchain"), F.col("x"), F.col("x"), F.lit(3), 7))
    )


def claims(tokens: DataFrame, lines: DataFrame, ignore: list[str] | None = None, config_keys: DataFrame | None = None) -> DataFrame:
    """All passes, denied and placeholder claims dropped, one claim per document, line, kind and norm (the first pass wins)."""
    every = reduce(DataFrame.unionByName, [span_claims(tokens), token_claims(tokens), link_claims(tokens), shell_claims(tokens), import_claims(tokens), bare_claims(tokens), prose_claims(lines), table_defaults(tokens, lines)])
    if config_keys is not None:
        every = every.unionByName(config_claims(tokens, config_keys))
    every = every.where("norm is not null and norm <> ''").where(~((F.col("kind").isin("path", "command")) & F.col("norm").rlike(PLACEHOLDERS)))
    for pattern in ignore or []:
        every = every.where(~F.col("text").rlike(pattern))
    # Only claims that something exists are turned off by a sentence that denies it, and only in code spans.
    said = every.where(F.col("pass") == 1).where(F.col("kind").isin(*EXISTENCE))
    kept = said.join(lines.withColumnRenamed("text", "around"), ["path", "line"], "left").where(~_denied()).select(*COLUMNS).unionByName(every.where(~((F.col("pass") == 1) & F.col("kind").isin(*EXISTENCE))))
    first = Window.partitionBy("path", "line", "kind", "norm").orderBy("pass", "col", "text")
    return kept.withColumn("n", F.row_number().over(first)).where("n = 1").select(*COLUMNS)


EXISTENCE = ("path", "command", "symbol", "import")


def _denied() -> Column:
    """Whether the line ``around`` a code span denies it; the span begins at ``col``, in bytes."""
    around = F.coalesce("around", F.lit(""))
    raw = F.encode(around, "UTF-8")
    before = F.decode(F.substring(raw, F.lit(1), F.greatest(F.col("col") - 1, F.lit(0))), "UTF-8")
    rest = F.decode(F.substring(raw, F.col("col"), F.length(raw)), "UTF-8")
    after = F.when(F.contains(rest, F.lit("`")), F.regexp_replace(rest, "(?s)^[^`]*`", "")).otherwise(F.lit(""))
    return F.coalesce(T.negated(F.regexp_replace(before, "`+$", ""), after), F.lit(False))
