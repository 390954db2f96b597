"""Facts of a source tree: declarations of seven languages, flags, environment, routes, defaults, literals.

One pass per file in Arrow batches gives rows of one schema; each kind of fact is a filter on it.
Strings and comments are blanked by a small lexer per language family before declarations are read,
and a declaration counts only outside function bodies.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.session import materialise

SCHEMA = "file string, lang string, kind string, name string, owner string, value string, line int, end_line int, exported boolean"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
LANG_OF = {"go": "go", "py": "py", "rs": "rust", "js": "js", "jsx": "js", "mjs": "js", "ts": "js", "tsx": "js", "cs": "csharp", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "odin": "odin"}
_STRINGS = {
    "go": r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "py": r"#[^\n]*|\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "rust": r"//[^\n]*|/\*.*?\*/|r#*\".*?\"#*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'",
    "js": r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "csharp": r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|@\"(?:\"\"|[^\"])*\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "c": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "odin": r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
}
_STRING = {k: re.compile(v, re.S) for k, v in _STRINGS.items()}
#: (kind, pattern with groups name and optionally owner), tried on blanked lines outside bodies.
_DECLS = {
    "go": (
        ("method", r"^func\s+\(\s*\w*\s*\*?(?P<owner>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)"), ("func", r"^func\s+(?P<name>\w+)"), ("type", r"^\s*type\s+(?P<name>\w+)"), ("const", r"^\s*(?:const|var)\s+(?P<name>\w+)"),
    ),
    "rust": (
        ("func", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\S*\s*)*fn\s+(?P<name>\w+)"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|union|type)\s+(?P<name>\w+)"),
        ("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)"), ("const", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:"), ("macro", r"^\s*macro_rules!\s*(?P<name>\w+)"),
    ),
    "js": (
        ("type", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum|namespace)\s+(?P<name>[\w$]+)"), ("type", r"^\s*(?:export\s+)?type\s+(?P<name>[\w$]+)\s*[=<]"),
        ("func", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)"), ("const", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)"),
        ("method", r"^\s+(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*\*?(?P<name>#?[\w$]+)\s*(?:<[^>]*>)?\([^)]*\)[^;{]*\{"),
    ),
    "csharp": (
        ("type", r"^\s*(?:(?:public|internal|private|protected|static|sealed|abstract|partial|readonly|ref)\s+)*(?:class|struct|interface|enum|record)\s+(?:struct\s+|class\s+)?(?P<name>\w+)"),
        ("module", r"^\s*namespace\s+(?P<name>[\w.]+)"),
        ("method", r"^\s*(?:(?:public|internal|private|protected|static|virtual|override|abstract|async|sealed|partial|extern|new)\s+)+[\w<>\[\],.?\s]+?\s(?P<name>\w+)\s*(?:<[^>]*>)?\("),
        ("property", r"^\s*(?:(?:public|internal|private|protected|static|virtual|override|abstract|required)\s+)+[\w<>\[\],.?]+\s+(?P<name>\w+)\s*(?:\{|=>)"),
    ),
    "c": (
        ("macro", r"^\s*#\s*define\s+(?P<name>\w+)"), ("type", r"^\s*(?:typedef\s+)?(?:struct|enum|union|class)\s+(?P<name>\w+)\s*[:{]"), ("type", r"^\s*\}\s*(?P<name>\w+)\s*;"), ("type", r"^typedef\s+[^;{]*?\b(?P<name>\w+)\s*;"),
        ("module", r"^\s*namespace\s+(?P<name>\w+)"), ("func", r"^(?!\s*(?:return|else|if|for|while|switch|typedef)\b)[\w:<>*&,\s]+?[\s*&](?:(?P<owner>\w+)::)?(?P<name>~?\w+)\s*\([^;]*\)?[^;=]*[;{]?\s*$"),
    ),
    "odin": (("func", r"^\s*(?P<name>\w+)\s*::\s*(?:#force_inline\s+)?proc\b"), ("type", r"^\s*(?P<name>\w+)\s*::\s*(?:distinct\s+)?(?:struct|enum|union|bit_set)\b"), ("const", r"^\s*(?P<name>\w+)\s*::\s*\S")),
}
_DECL = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in _DECLS.items()}
#: (kind, pattern) over raw lines; groups name, value.
_USES = {
    "go": (
        ("flag", r"\b(?:flag|fs|flags|cmd\.(?:Persistent)?Flags\(\))\.\w*(?:Var)?P?\((?:&\w+(?:\.\w+)*,\s*)?\"(?P<name>[\w.-]+)\"(?:,\s*\"\w?\")?(?:,\s*(?P<value>[^,()]+))?"),
        ("env", r"\bos\.(?:Getenv|LookupEnv|Setenv)\(\"(?P<name>\w+)\""), ("route", r"\.(?:HandleFunc|Handle|Get|Post|Put|Delete|Patch|GET|POST|PUT|DELETE|PATCH)\(\"(?P<name>(?:[A-Z]+ )?/[^\"]*)\""),
        ("key", r"`[^`]*\b(?:json|yaml|toml):\"(?P<name>[\w.-]+)"),
    ),
    "py": (
        ("flag", r"(?:add_argument|Option|option)\((?:[^\"'()]*,\s*)?(?:[\"']-\w[\"'],\s*)?[\"']--(?P<name>[\w-]+)[\"'](?:.*?\bdefault\s*=\s*(?P<value>[^,)]+))?"), ("env", r"\bos\.(?:environ(?:\.get)?[\[(]|getenv\()\s*[\"'](?P<name>\w+)[\"']"),
        ("route", r"@\w+(?:\.\w+)*\.(?:route|get|post|put|delete|patch|websocket)\(\s*[\"'](?P<name>/[^\"']*)[\"']"),
    ),
    "rust": (("env", r"\benv::var(?:_os)?\(\"(?P<name>\w+)\""), ("flag", r"#\[arg\([^\]]*\blong\s*=\s*\"(?P<name>[\w-]+)\"(?:[^\]]*default_value(?:_t)?\s*=\s*\"?(?P<value>[^\",)\]]+))?"), ("route", r"\.route\(\s*\"(?P<name>/[^\"]*)\"|#\[(?:get|post|put|delete|patch)\(\"(?P<name2>/[^\"]*)\"")),
    "js": (
        ("env", r"\bprocess\.env\.(?P<name>\w+)"), ("flag", r"\.option\(\s*[\"'](?:-\w,\s*)?--(?P<name>[\w-]+)[^\"']*[\"'](?:,\s*[\"'][^\"']*[\"'](?:,\s*(?P<value>[^,)]+))?)?"),
        ("route", r"\b(?:app|router|server|fastify)\.(?:get|post|put|delete|patch|all|use)\(\s*[\"'`](?P<name>/[^\"'`]*)[\"'`]"),
    ),
    "csharp": (("env", r"GetEnvironmentVariable\(\"(?P<name>\w+)\""), ("flag", r"new\s+Option<[^>]*>\(\s*\"--(?P<name>[\w-]+)\""), ("route", r"\.Map(?:Get|Post|Put|Delete|Patch|Group)\(\s*\"(?P<name>/[^\"]*)\"|\[(?:Route|Http\w+)\(\"(?P<name2>[^\"]+)\"")),
    "c": (("env", r"\b(?:secure_)?getenv\(\s*\"(?P<name>\w+)\""), ("flag", r"\{\s*\"(?P<name>[\w-]+)\"\s*,\s*(?:no|required|optional)_argument")),
    "odin": (("env", r"\bos\.get_env\(\s*\"(?P<name>\w+)\""),),
}
_USE = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in _USES.items()}
#: Marks of types whose members cannot be listed from their text, by language.
_OPAQUE = {
    "py": re.compile(r"\bdef\s+__getattr(?:ibute)?__\b|\bsetattr\(\s*(?:self|cls)\b"), "js": re.compile(r"^\s*(?:readonly\s+)?\[\w+\s*:\s*(?:string|number|symbol)\]\s*:|\bnew\s+Proxy\("),
    "csharp": re.compile(r":\s*DynamicObject\b|\bTryGetMember\b"), "go": re.compile(r"^\s*\*?\w+\.\w+\s*(?:`.*)?$"), "rust": re.compile(r"^\s*(?:type\s+Target\s*=|#\[delegate)"), "c": re.compile(r"^\s*[A-Z][A-Z0-9_]+\([^;]*\)\s*$"),
}
#: What a module passes on under its own name: the items and where they come from.
_PASSED_ON = {
    "py": re.compile(r"^from\s+(?P<module>\.+[\w.]*)\s+import\s+\(?(?P<items>[^()#]+)"), "js": re.compile(r"^\s*export\s+(?:type\s+)?(?P<items>\*|\{[^}]*\})\s+from\s+[\"'](?P<module>\.[^\"']*)[\"']"),
    "rust": re.compile(r"^\s*pub\s+use\s+(?P<module>(?:\w+::)*\w+)::(?P<items>\*|\{[^}]*\}|\w+(?:\s+as\s+\w+)?)\s*;"),
}
_LITERAL = re.compile(r"\"([A-Za-z0-9_./:{}*$@+<>~%-]{2,80})\"|'([A-Za-z0-9_./:{}*$@+<>~%-]{2,80})'")
_VERBS = frozenset("if for while switch catch return else do new throw await match loop using lock foreach with".split())


def _blanked(text: str, lang: str) -> list[str]:
    return _STRING[lang].sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] in "/#" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1], text).split("\n")


def _exported(name: str, line: str, lang: str) -> bool:
    if lang == "go":
        return name[:1].isupper()
    if lang == "rust":
        return bool(re.match(r"^\s*pub\b", line))
    if lang == "js":
        return "export" in line
    if lang == "csharp":
        return "public" in line
    return not name.startswith("_")


def _python_declarations(rows: list[str]) -> Iterator[tuple[str, str, str, int, int, str]]:
    scopes: list[tuple[int, str, str]] = []
    for n, line in enumerate(rows, 1):
        m = re.match(r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)", line) or re.match(r"^(\s*)()([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)", line)
        if not m:
            continue
        depth = len(m[1].expandtabs())
        scopes = [s for s in scopes if s[0] < depth]
        if any(kind == "def" for _, kind, _ in scopes):
            continue
        owner = ".".join(name for _, _, name in scopes)
        end = n
        for k in range(n, len(rows)):
            if rows[k].strip() and len(rows[k]) - len(rows[k].lstrip()) <= len(m[1]):
                break
            end = k + 1
        yield ("method" if owner else "func") if m[2] == "def" else "type" if m[2] else "const", m[3], owner, n, end if m[2] else n, line
        if m[2]:
            scopes.append((depth, m[2], m[3]))


def _brace_declarations(rows: list[str], lang: str) -> Iterator[tuple[str, str, str, int, int, str]]:
    depth, scopes = 0, []  # (depth inside, name, is_type)
    for n, line in enumerate(rows, 1):
        inside_body = any(not is_type for d, _, is_type in scopes if d <= depth)
        opened = None
        impl = re.match(r"^\s*(?:unsafe\s+)?impl\b(?:<[^>]*>)?\s*(?:[\w:<>, ]+\s+for\s+)?(\w+)", line) if lang == "rust" else None
        if impl and not inside_body:
            opened = (impl[1], True)
        elif not inside_body:
            for kind, pattern in _DECL[lang]:
                m = pattern.match(line)
                if not m or m["name"] in _VERBS:
                    continue
                if kind == "method" and lang == "js" and not scopes:
                    continue
                owner = (m.groupdict().get("owner") or "") or ".".join(name for _, name, is_type in scopes if is_type and name)
                end, level = n, 0
                for k in range(n - 1, len(rows)):
                    level += rows[k].count("{") - rows[k].count("}")
                    if level <= 0 and ("}" in rows[k] or ";" in rows[k] and k > n - 1 or k == n - 1 and "{" not in rows[k]):
                        end = k + 1
                        break
                yield kind, m["name"], owner, n, end, line
                opened = (m["name"], kind in ("type", "module"))
                break
        before = depth
        depth += line.count("{") - line.count("}")
        scopes = [s for s in scopes if s[0] <= depth]
        if depth > before:
            name, is_type = opened if opened else ("", bool(re.match(r"^\s*(?:export\s+)?(?:extern\s+\"\s*\"|namespace)\b", line)) or bool(scopes and scopes[-1][2] and re.match(r"^\s*\{\s*$", line)))
            scopes.append((depth, name, is_type))


_GO_GROUP = re.compile(r"^(const|var|type)\s*\(\s*$")
_GO_BODY = re.compile(r"^\s*(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*\{\s*$")
_GO_FIELD = re.compile(r"^\s+(\w+(?:\s*,\s*\w+)*)\s+((?:\[\w*\]|\*|map\[\w+\])*)([\w.]+|func\(|chan\b|interface\b|struct\b)")
_GO_TAG = re.compile(r"`[^`]*\b(?:json|yaml|toml):\"([\w.-]+)")


def _go_members(rows: list[str], raw: list[str]) -> Iterator[tuple[str, str, str, str | None, int]]:
    """(kind, name, owner, value, line) of what declarations hold: grouped names, fields with their tags, interface methods."""
    group, owner, form, level = "", "", "", 0
    for n, line in enumerate(rows, 1):
        opens = _GO_GROUP.match(line)
        body = _GO_BODY.match(line) if not owner else None
        if opens:
            group = opens[1]
        elif group and line.startswith(")"):
            group = ""
        elif body and (group == "type" or line.startswith("type")):
            if group:
                yield "type", body[1], "", None, n
            owner, form, level = body[1], body[2], 0
        elif owner and level == 1:
            if form == "interface":
                m = re.match(r"^\s+(\w+)\(", line)
                if m:
                    yield "method", m[1], owner, None, n
            else:
                m = _GO_FIELD.match(line)
                for name in re.split(r"\s*,\s*", m[1]) if m else ():
                    yield "field", name, owner, None, n
                tag = _GO_TAG.search(raw[n - 1])
                if m and tag and tag[1] != "-":
                    yield "tag", tag[1], owner, m[3].rpartition(".")[2], n
        elif group in ("const", "var") and not owner:
            m = re.match(r"^\t(\w+(?:\s*,\s*\w+)*)", line)
            for name in re.split(r"\s*,\s*", m[1]) if m else ():
                yield "const", name, "", None, n
        elif group == "type" and not owner and (m := re.match(r"^\t(\w+)(?:\[[^\]]*\])?\s+\S", line)):
            yield "type", m[1], "", None, n
        if owner:
            level += line.count("{") - line.count("}")
            if level <= 0:
                owner = ""


def _passed_on(file: str, lang: str, module: str, line: str) -> Iterator[tuple[str, str, str]]:
    """(bound name or ``*``, item, module it comes from) of a line that re-exports."""
    m = _PASSED_ON[lang].match(line)
    if not m or lang == "py" and not file.endswith("__init__.py"):
        return
    here = file.rpartition("/")[0].split("/") if "/" in file else []
    if lang == "py":
        up = len(m["module"]) - len(m["module"].lstrip("."))
        source = ".".join([*here[: len(here) - up + 1], *filter(None, m["module"].lstrip(".").split("."))])
    elif lang == "js":
        parts = list(here)
        for x in m["module"].split("/"):
            parts = parts[:-1] if x == ".." else parts if x in (".", "") else [*parts, re.sub(r"\.(?:m?js|tsx?|jsx)$", "", x)]
        source = ".".join(parts)
    else:
        first, *rest = m["module"].split("::")
        top = here[: here.index("src") + 1] if "src" in here else here[:1]
        base = top if first == "crate" else module.split("::") if first == "self" else module.split("::")[:-1] if first == "super" else [*module.split("::"), first]
        source = "::".join([*base, *rest])
    for item in re.split(r"\s*,\s*", m["items"].strip("{} \t\n")):
        name, _, bound = re.sub(r"\s+as\s+", "\x00", item.strip()).partition("\x00")
        if name:
            yield bound or name, name, source


#: A router's prefix, a URL pattern of a list of them, the method that a registration is named after.
_PREFIX = re.compile(r"^(\w+)\s*=\s*\w+\([^)]*\b(?:url_)?prefix\s*=\s*[\"']([^\"']+)[\"']", re.M)
_DJANGO = re.compile(r"\b(?:re_)?path\(\s*r?[\"']([^\"']*)[\"']")
_VERB = re.compile(r"(?:[.@]|\[Http|\.Map|#\[)(get|post|put|delete|patch)\s*\(", re.I)


def scan(file: str, text: str) -> list[tuple]:
    """All facts of one source file."""
    lang = LANG_OF.get(file.rsplit(".", 1)[-1].lower())
    if not lang or not text:
        return []
    text = text.removeprefix("\ufeff").replace("\r\n", "\n")
    rows, raw = _blanked(text, lang), text.split("\n")
    declared = _python_declarations(rows) if lang == "py" else _brace_declarations(rows, lang)
    module = ""
    if lang == "go" or lang == "odin":
        m = re.search(r"^package\s+(\w+)", text, re.M)
        module = m[1] if m else ""
    elif lang in ("py", "js", "rust"):
        module = re.sub(r"(?:/(?:__init__|index|mod|lib|main))?\.\w+$", "", file).replace("/", "." if lang != "rust" else "::")
    out = [(file, lang, "module", module, "", None, 1, len(raw), True)] if module else []
    spans = []
    for kind, name, owner, line, end, row in declared:
        out.append((file, lang, kind, name, owner or "", module, line, end, _exported(name, raw[line - 1] if line <= len(raw) else row, lang)))
        if kind == "type":
            spans.append((line, end, name))
    if lang == "go":
        seen = {(r[2], r[3], r[4]) for r in out}
        for kind, name, owner, value, line in _go_members(rows, raw):
            if (kind, name, owner) not in seen:
                out.append((file, lang, kind, name, owner, value if kind == "tag" else module, line, line, name[:1].isupper()))
    for n, line in enumerate(rows, 1):
        if lang in _PASSED_ON and ("export" in line or "use" in line or "from" in line):
            out += [(file, lang, "reexport", bound, item, f"{module}|{source}", n, n, True) for bound, item, source in _passed_on(file, lang, module, raw[n - 1])]
        if lang in _OPAQUE and _OPAQUE[lang].search(line):
            around = [s for s in spans if s[0] <= n <= s[1]]
            if around:
                out.append((file, lang, "opaque", max(around)[2], "", None, n, n, True))
    prefixes = dict(_PREFIX.findall(text)) if lang == "py" and "prefix" in text else {}
    for n, line in enumerate(raw, 1):
        if lang == "py" and file.endswith("urls.py"):
            out += [(file, lang, "route", "/" + m[1].lstrip("^/").rstrip("$"), "", None, n, n, True) for m in _DJANGO.finditer(line)]
        for kind, pattern in _USE[lang]:
            for m in pattern.finditer(line):
                name = m["name"] or m.groupdict().get("name2")
                value = m.groupdict().get("value")
                if kind == "route":
                    verb = _VERB.search(m[0])
                    value = verb[1].upper() if verb else None
                    mount = next((p for v, p in prefixes.items() if re.match(rf"@{v}\.", m[0])), None)
                    if mount:
                        out.append((file, lang, kind, mount.rstrip("/") + name, "", value, n, n, True))
                out.append((file, lang, kind, name, "", value.strip().strip("\"'") if value else None, n, n, True))
        for m in _LITERAL.finditer(line):
            word = m[1] or m[2]
            if re.search(r"[A-Za-z]", word):
                out.append((file, lang, "literal", word, "", None, n, n, True))
    return out


def _fact_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [row for file, text in zip(batch["file"], batch["text"], strict=True) if file for row in scan(file, text or "")]
        yield pd.DataFrame(rows, columns=_COLUMNS)


def fact_table(sources: DataFrame) -> DataFrame:
    """Fact rows of ``sources`` (file, text)."""
    return sources.select("file", "text").mapInPandas(_fact_batches, SCHEMA)


SYMBOL_KINDS = ("func", "method", "type", "const", "macro", "property", "module", "field")


def symbol_keys(facts: DataFrame) -> DataFrame:
    """(key, lang, full, kind, file, line, exported): one row per accepted spelling of a symbol."""
    s = facts.where(F.col("kind").isin(*SYMBOL_KINDS))
    sep = F.when(F.col("lang").isin("rust", "c"), "::").otherwise(".")
    join = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), ".")
    full = F.replace(join(F.col("value"), F.col("owner"), F.col("name")), F.lit("."), sep)
    short = F.replace(join(F.col("owner"), F.col("name")), F.lit("."), sep)
    last = F.regexp_extract("value", "([^.:]+)$", 1)
    package = F.replace(join(last, F.col("owner"), F.col("name")), F.lit("."), sep)
    named = s.select("lang", "kind", "file", "line", "exported", "name", full.alias("full"), short.alias("short"), package.alias("package"))
    keys = F.array_distinct(F.array("full", "short", "package", "name"))
    own = named.select(F.explode(keys).alias("key"), "lang", "full", "kind", "file", "line", "exported")
    return own.unionByName(_passed_on_keys(facts, named.withColumn("module", s_module(F.col("full"), F.col("short")))))


def s_module(full: Column, short: Column) -> Column:
    """What stands before a symbol's own name."""
    return F.when(full == short, "").otherwise(F.regexp_replace(F.substring(full, F.lit(1), F.length(full) - F.length(short)), "[.:]+$", ""))


def _passed_on_keys(facts: DataFrame, named: DataFrame) -> DataFrame:
    """Spellings under the modules that pass a symbol on, through any number of modules that pass on everything."""
    lines = facts.where("kind = 'reexport'").select("lang", F.col("name").alias("bound"), F.col("owner").alias("item"), F.substring_index("value", "|", 1).alias("module"), F.substring_index("value", "|", -1).alias("target"))
    whole = lines.where("item = '*'").select("module", "target")
    through = reexport_closure(whole).select("module", F.col("origin").alias("target"))
    stars = through.join(named.where("kind <> 'module'").withColumnRenamed("module", "target"), "target").select("module", F.col("short").alias("bound"), "lang", "full", "kind", "file", "line", "exported")
    single = lines.where("item <> '*'").join(named.select(F.col("module").alias("target"), F.col("name").alias("item"), "full", "kind", "file", "line", "exported"), ["target", "item"])
    single = single.select("module", "bound", "lang", "full", "kind", "file", "line", "exported")
    again = through.withColumnsRenamed({"module": "top", "target": "module"}).join(single, "module").drop("module").withColumnRenamed("top", "module")
    every = stars.unionByName(single).unionByName(again.select(*single.columns))
    sep = F.when(F.col("lang") == "rust", "::").otherwise(".")
    last = F.regexp_extract("module", "([^.:]+)$", 1)
    keys = F.array_distinct(F.array(F.concat("module", sep, "bound"), F.concat(last, sep, "bound"), F.col("bound")))
    return every.select(F.explode(keys).alias("key"), "lang", "full", "kind", "file", "line", "exported")


def exported_surface(facts: DataFrame) -> DataFrame:
    """(grp, name, alias, kind, file, line) of what others may use: exported symbols, flags, environment."""
    symbols = facts.where(F.col("kind").isin("func", "method", "type", "const", "macro") & F.col("exported")).where(~F.col("file").rlike("(?:^|/)(?:[^/]*_test[.]go|test_[^/]*[.]py|tests?/)"))
    owned = F.when(F.col("owner") == "", F.col("name")).otherwise(F.concat_ws(".", "owner", "name"))
    s = symbols.select(F.coalesce("value", F.lit("")).alias("grp"), owned.alias("alias"), F.concat_ws(".", F.nullif(F.regexp_extract("value", "([^.:]+)$", 1), F.lit("")), owned).alias("name"), "kind", "file", "line")
    u = facts.where(F.col("kind").isin("flag", "env")).select(F.concat("kind", F.lit("s")).alias("grp"), "name", F.col("name").alias("alias"), "kind", "file", "line")
    return s.unionByName(u.select(*s.columns))


# --- documentation beside declarations ----------------------------------------------------

DOC_SCHEMA = "file string, full_name string, kind string, decl_line int, doc_start int, doc_end int, body_start int, body_end int, doc array<string>, exported boolean"


def doc_spans_of(file: str, text: str) -> list[tuple]:
    """Declarations of a file with the lines of their comment (or docstring) and body."""
    rows = (text or "").removeprefix("﻿").replace("\r\n", "\n").split("\n")
    out = []
    for _, lang, kind, name, owner, module, line, end, exported in scan(file, text or ""):
        if kind not in ("func", "method", "type", "const", "macro"):
            continue
        full = ".".join(p for p in (module, owner, name) if p)
        if lang == "py":
            first = next((k for k in range(line, min(end, len(rows))) if rows[k].strip() and rows[k - 1].rstrip().endswith((":", ")", ","))), None)
            m = re.match(r"^\s*[rRuU]?(\"\"\"|''')", rows[first]) if first is not None else None
            if not m:
                continue
            last = first if rows[first].count(m[1]) > 1 else next((k for k in range(first + 1, len(rows)) if m[1] in rows[k]), first)
            doc = [re.sub(r"^\s*[rRuU]?(?:\"\"\"|''')|(?:\"\"\"|''')\s*$", "", r).strip() for r in rows[first : last + 1]]
            out.append((file, full, kind, line, first + 1, last + 1, min(last + 2, end), end, doc, exported))
            continue
        top = line - 1
        while top > 0 and re.match(r"^\s*(?:#\[|\[\w|@\w)", rows[top - 1]):
            top -= 1
        last = top
        while top > 0 and re.match(r"^\s*(?://|/\*|\*)", rows[top - 1]):
            top -= 1
        if top < last:
            doc = [re.sub(r"^\s*(?:///?!?|/\*\*?|\*(?!/))\s?|\*/\s*$", "", r).strip() for r in rows[top:last]]
            out.append((file, full, kind, line, top + 1, last, line, end, doc, exported))
    return out


def doc_spans(sources: DataFrame) -> DataFrame:
    """Documentation spans of ``sources`` (file, text)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for file, text in zip(batch["file"], batch["text"], strict=True) if file for row in doc_spans_of(file, text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOC_SCHEMA.split(", ")])

    return sources.select("file", "text").mapInPandas(run, DOC_SCHEMA)


def reexport_closure(edges: DataFrame) -> DataFrame:
    """(module, origin): what a module offers through re-exports (``pub use x::*``, ``export *``), to any depth, cycles ignored.

    ``edges``: module, target. Stops as soon as a step adds nothing; every pair is followed once.
    """
    step = edges.select("module", F.col("target").alias("origin")).where("module <> target").distinct()
    known = step
    while not step.isEmpty():
        further = step.join(edges.select(F.col("module").alias("origin"), "target"), "origin").select("module", F.col("target").alias("origin")).where("module <> origin")
        step = materialise(further.distinct().join(known, ["module", "origin"], "left_anti"), "reexports")
        known = known.unionByName(step)
    return known


def key_paths(fields: DataFrame, roots: DataFrame) -> DataFrame:
    """(key): dotted configuration keys of nested types, to any depth, without running through a type twice.

    ``fields``: type, tag, child (type of the field, null for a leaf). ``roots``: type.
    """
    level = roots.select("type", F.lit("").alias("key"), F.array("type").alias("seen")).distinct()
    out = level.select("key").limit(0)
    while not level.isEmpty():
        nxt = level.join(fields, "type").select(F.when(F.col("key") == "", F.col("tag")).otherwise(F.concat_ws(".", "key", "tag")).alias("key"), F.col("child").alias("type"), "seen")
        nxt = materialise(nxt, "keys")
        out = out.unionByName(nxt.select("key"))
        level = nxt.where("type is not null and not array_contains(seen, type)").withColumn("seen", F.concat("seen", F.array("type")))
    return out.distinct()
