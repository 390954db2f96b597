"""Column functions over names, paths, values and messages. All run inside the JVM.

Regular expressions use ASCII classes only, so that other engines agree on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- lines, paths, names --------------------------------------------------------------


def lines_of(text: ColumnLike) -> Column:
    """Lines without their ends; the last one is dropped if the text ends with a line end."""
    return F.split(F.regexp_replace(_c(text), "\\r?\\n\\z", ""), "\\r?\\n", -1)


def clean_path(path: ColumnLike) -> Column:
    """Forward slashes, ``.`` and empty segments gone, ``..`` folded as far as the path reaches."""
    segments = F.split(F.translate(_c(path), "\\", "/"), "/", -1)
    kept = F.filter(segments, lambda s: ~s.isin("", "."))
    folded = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda done, s: F.when((s == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(folded, "/")


def base_name(path: ColumnLike) -> Column:
    return F.regexp_extract(_c(path), "([^/]*)$", 1)


def dir_name(path: ColumnLike) -> Column:
    """The part before the last slash, ``.`` for a bare name."""
    return F.when(F.contains(_c(path), F.lit("/")), F.regexp_replace(_c(path), "/[^/]*$", "")).otherwise(F.lit("."))


def stem(path: ColumnLike) -> Column:
    return F.regexp_replace(base_name(path), "(.)[.][^.]*$", "$1")


def extension(path: ColumnLike) -> Column:
    return F.lower(F.regexp_extract(base_name(path), "[^.][.]([^.]+)$", 1))


def ancestors(path: ColumnLike) -> Column:
    """All directories above a path, nearest first, the root as ``.``."""
    parts = F.split(_c(path), "/", -1)
    ups = F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.transform(ups, lambda p: F.when(p == "", F.lit(".")).otherwise(p))


def join_relative(base_dir: ColumnLike, target: ColumnLike) -> Column:
    """A link target seen from a document's directory; rooted targets start at the root."""
    t = _c(target)
    return F.when(t.startswith("/"), clean_path(t)).otherwise(clean_path(F.concat_ws("/", _c(base_dir), t)))


def glob_regex(pattern: str, basename: bool = False) -> str:
    """A regular expression for a glob: ``*`` and ``?`` within a segment, ``**`` across, classes, braces.

    With ``basename`` a pattern without a slash matches the last segment anywhere.
    """
    out, n = [], 0
    while n < len(pattern):
        c = pattern[n]
        if pattern.startswith("**/", n):
            out.append("(?:[^/]+/)*")
            n += 3
            continue
        if pattern.startswith("**", n):
            out.append(".*")
            n += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[n + 2 :]:
            end = pattern.index("]", n + 2)
            inner = pattern[n + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            n = end
        elif c == "{" and "}" in pattern[n:]:
            end = pattern.index("}", n)
            out.append("(?:" + "|".join(glob_regex(p)[1:-1] for p in pattern[n + 1 : end].split(",")) + ")")
            n = end
        else:
            out.append("\\" + c if c in ".^$+()|{}[]\\" else c)
        n += 1
    body = "".join(out)
    if basename and "/" not in pattern:
        body = "(?:.*/)?" + body
    return f"^{body}$"


def glob_matches(path: ColumnLike, patterns: list[str], basename: bool = True) -> Column:
    """Whether a path matches one of the patterns; false for none."""
    hits = [_c(path).rlike(glob_regex(p, basename)) for p in patterns]
    out = F.lit(False)
    for hit in hits:
        out = out | hit
    return out


def name_shape(name: ColumnLike) -> Column:
    """``flag``, ``env``, ``path``, ``dotted``, ``scoped``, ``snake``, ``camel``, ``pascal``, ``plain`` or ``other``."""
    n = _c(name)
    return (
        F.when(n.rlike("^--?[A-Za-z][A-Za-z0-9-]*$"), "flag")
        .when(n.rlike("^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$"), "env")
        .when(n.rlike("^[^\\s]*/[^\\s]*$"), "path")
        .when(n.rlike("^[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)+$"), "scoped")
        .when(n.rlike("^[A-Za-z_][A-Za-z0-9_]*(?:[.][A-Za-z_][A-Za-z0-9_]*)+$"), "dotted")
        .when(n.rlike("^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$"), "snake")
        .when(n.rlike("^[a-z]+[a-z0-9]*(?:[A-Z][a-z0-9]*)+$"), "camel")
        .when(n.rlike("^(?:[A-Z][a-z0-9]+){2,}$"), "pascal")
        .when(n.rlike("^[A-Za-z0-9]+$"), "plain")
        .otherwise("other")
    )


def flag_key(flag: ColumnLike) -> Column:
    """One spelling per command-line flag: lower case, dashes, no leading dashes."""
    return F.lower(F.translate(F.regexp_replace(_c(flag), "^-+", ""), "_", "-"))


def slug(heading: ColumnLike) -> Column:
    """The anchor of a heading: a given ``{#id}`` and link targets gone, tags and punctuation dropped, blanks as dashes."""
    text = F.regexp_replace(_c(heading), "\\s*\\{\\s*#[^{}]*\\}\\s*$", "")
    text = F.regexp_replace(text, "!?\\[([^\\[\\]]*)\\](?:\\([^()]*\\)|\\[[^\\[\\]]*\\])", "$1")
    text = F.regexp_replace(text, "\\\\[<>]", "")
    text = F.regexp_replace(F.lower(F.regexp_replace(text, "</?[A-Za-z][^<>]*>", "")), "[^\\p{L}\\p{N}_\\s-]", "")
    return F.regexp_replace(F.trim(text), "\\s", "-")


# --- values ------------------------------------------------------------------------------


def duration_seconds(value: ColumnLike) -> Column:
    """Seconds of a duration such as ``1h30m``, ``250ms`` or ``-10s``; null for anything else."""
    v = F.lower(F.trim(_c(value)))
    parts = F.regexp_extract_all(v, F.lit("([0-9]+(?:[.][0-9]+)?(?:ns|us|µs|ms|s|m|h))"), 1)
    unit = lambda p: F.regexp_extract(p, "([a-zµ]+)$", 1)
    number = lambda p: F.regexp_extract(p, "^([0-9.]+)", 1).cast("double")
    scale = lambda u: (
        F.when(u == "ns", 1e-9).when(u.isin("us", "µs"), 1e-6).when(u == "ms", 1e-3).when(u == "s", 1.0).when(u == "m", 60.0).otherwise(3600.0)
    )
    total = F.aggregate(parts, F.lit(0.0).cast("double"), lambda acc, p: acc + number(p) * scale(unit(p)))
    return F.when(v.rlike("^[+-]?(?:[0-9]+(?:[.][0-9]+)?(?:ns|us|µs|ms|s|m|h))+$"), F.when(v.startswith("-"), -total).otherwise(total))


#: Spellings of no value, of true and of false (fixed values).
NO_VALUE = ("", "none", "nil", "null", "(empty)", "empty", "unset", "not set", "-")
TRUE_VALUES, FALSE_VALUES = ("true", "yes", "on", "enabled"), ("false", "no", "off", "disabled")


def plain_value(value: ColumnLike) -> Column:
    """A default without code marks and one pair of quotes; every spelling of no value, true and false is one."""
    bare = F.trim(F.regexp_replace(F.trim(_c(value)), "^`+|`+$", ""))
    bare = F.when(bare.rlike("(?s)^\".*\"$|^'.*'$") & (F.length(bare) > 1), F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    low = F.lower(bare)
    return F.when(low.isin(*NO_VALUE), "").when(low.isin(*TRUE_VALUES), "true").when(low.isin(*FALSE_VALUES), "false").otherwise(bare)


def same_default(documented: ColumnLike, declared: ColumnLike) -> Column:
    """Whether two defaults mean the same: as text, as numbers, or as durations."""
    a, b = plain_value(documented), plain_value(declared)
    digits = lambda v: F.regexp_replace(v, "(?<=[0-9])_(?=[0-9])", "")
    number = lambda v: F.when(digits(v).rlike("^[+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?$"), digits(v).try_cast("double"))
    equal = a == b
    for view in (number, duration_seconds):
        equal = equal | F.coalesce(view(a) == view(b), F.lit(False))
    return F.coalesce(equal, F.lit(False))


def version_floor(spec: ColumnLike) -> Column:
    """(major, minor) of the lower bound in a version requirement, null without one.

    A requirement is a list of constraints, each an operator and a version; upper bounds and exclusions say nothing.
    """
    parts = F.transform(F.split(_c(spec), ",|\\s+(?=[<>=!~^])"), lambda p: F.trim(p))
    lower = F.filter(parts, lambda p: ~p.rlike("^(?:<|!)") & p.rlike("[0-9]"))
    version = F.regexp_extract(F.get(lower, F.lit(0)), "([0-9]+(?:[.][0-9]+)?)", 1)
    major = F.nullif(F.regexp_extract(version, "^([0-9]+)", 1), F.lit("")).cast("int")
    minor = F.coalesce(F.nullif(F.regexp_extract(version, "[.]([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(major.isNotNull(), F.struct(major.alias("major"), minor.alias("minor")))


def numbers_in(text: ColumnLike) -> Column:
    """Distinct numbers and dotted versions of a text, sorted."""
    words = F.transform(F.split(_c(text), "[^A-Za-z0-9_.]+"), lambda w: F.regexp_replace(w, "^[.]+|[.]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.rlike("^[0-9]+(?:[.][0-9]+)*$"))))


def identifiers_in(text: ColumnLike) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(text), F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1)))


def expand_braces(text: ColumnLike) -> Column:
    """``a.{x,y}`` as two texts; a text without braces as itself."""
    t = _c(text)
    head, inner, tail = (F.regexp_extract(t, "^([^{}]*)\\{([^{}]*,[^{}]*)\\}([^{}]*)$", n) for n in (1, 2, 3))
    return F.when(inner != "", F.transform(F.split(inner, ","), lambda x: F.concat(head, F.trim(x), tail))).otherwise(F.array(t))


def literal_like(value: ColumnLike) -> Column:
    """Whether a string literal could name something: 2 to 80 identifier-like characters with a letter."""
    v = _c(value)
    return v.rlike("^[A-Za-z0-9_./:{}*$@+<>~%-]{2,80}$") & v.rlike("[A-Za-z]")


def context_snippet(line: ColumnLike, most: int = 160) -> Column:
    """A source line for a report, cut to ``most`` characters."""
    t = F.trim(_c(line))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


# --- routes -----------------------------------------------------------------------------------


def route_segments(path: ColumnLike) -> Column:
    """Canonical segments of a route: every parameter ``{}``, every rest ``**``, the exact-match mark ``{$}`` kept."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(_c(path)), "[?#].*$", ""), "^https?://[^/]*", "")
    segments = F.filter(F.split(bare, "/", -1), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.when(s == "{$}", s)
        .when(s.rlike("^[*]|(?:[.]{3}|:[.]?[*])\\}$|[.]{2}>$"), "**")
        .when(s.rlike("^:.|^<.*>$|\\{.*\\}"), "{}")
        .otherwise(s),
    )


def _unmarked(segments: Column) -> Column:
    n = F.size(segments)
    return F.when((n > 0) & (F.get(segments, n - 1) == "{$}"), F.slice(segments, F.lit(1), n - 1)).otherwise(segments)


def route_matches(wanted: ColumnLike, registered: ColumnLike) -> Column:
    """Segment by segment; a parameter on either side matches one segment, a registered rest any number of them."""
    a, b = _unmarked(_c(wanted)), _unmarked(_c(registered))
    fixed = lambda x, y: F.forall(F.zip_with(x, y, lambda p, q: F.coalesce((p == q) | p.isin("{}", "**") | (q == "{}"), F.lit(False))), lambda ok: ok)
    stop = F.array_position(b, "**")
    head = F.greatest(stop - 1, F.lit(0)).cast("int")
    open_ended = (stop > 0) & (F.size(a) >= head) & fixed(F.slice(a, F.lit(1), head), F.slice(b, F.lit(1), head))
    return open_ended | ((stop == 0) & (F.size(a) == F.size(b)) & fixed(a, b))


def glob_pattern(pattern: ColumnLike) -> Column:
    """:func:`glob_regex` of a column: ``*`` and ``?`` within a segment, ``**`` across, classes and alternatives kept."""
    p = F.regexp_replace(_c(pattern), "([.^$+()|\\\\])", "\\\\$1")
    p = F.regexp_replace(F.regexp_replace(p, "\\[!", "[^"), "\\{([^{}]*)\\}", "(?:$1)")
    p = F.regexp_replace(p, "[*]{2}/", "\u0001")
    p = F.replace(F.replace(p, F.lit("**"), F.lit("\u0002")), F.lit("*"), F.lit("[^/]*"))
    p = F.regexp_replace(p, "(?<![(\u0001])[?]", "[^/]")
    p = F.replace(F.replace(p, F.lit("\u0001"), F.lit("(?:[^/]+/)*")), F.lit("\u0002"), F.lit(".*"))
    return F.concat(F.lit("^"), F.replace(p, F.lit(","), F.lit("|")), F.lit("$"))


# --- ranks, hashes, output ------------------------------------------------------------------------


def severity_rank(severity: ColumnLike) -> Column:
    s = F.lower(_c(severity))
    return F.when(s == "error", 3).when(s == "warning", 2).when(s == "info", 1).otherwise(0)


def severity_of(confidence: ColumnLike) -> Column:
    c = _c(confidence)
    return F.when(c >= 3, "error").when(c == 2, "warning").otherwise("info")


def fingerprint(*parts: ColumnLike) -> Column:
    """Position-free identity: 16 hex digits of a SHA-256 over the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def human_int(number: ColumnLike) -> Column:
    return F.format_number(_c(number).cast("bigint"), 0)


def position_text(file: ColumnLike, line: ColumnLike, col: ColumnLike) -> Column:
    """``file``, ``file:line`` or ``file:line:col``; absent parts are null or zero."""
    f, n, c = _c(file), F.coalesce(_c(line), F.lit(0)), F.coalesce(_c(col), F.lit(0))
    return F.when(n <= 0, f).when(c <= 0, F.concat_ws(":", f, n)).otherwise(F.concat_ws(":", f, n, c))


def escape_workflow(text: ColumnLike, is_property: bool = False) -> Column:
    """Escapes of workflow annotations; properties escape ``:`` and ``,`` too."""
    t = F.replace(F.replace(F.replace(_c(text), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.replace(F.replace(t, F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C")) if is_property else t


def escape_cell(text: ColumnLike) -> Column:
    """A text inside a Markdown table cell."""
    return F.regexp_replace(F.replace(_c(text), F.lit("|"), F.lit("\\|")), "\\s*\\r?\\n\\s*", " ")


def percent(part: ColumnLike, total: ColumnLike, rule: str = "round") -> Column:
    """Documented share in percent, 100 for nothing to document.

    ``round``: half away from zero; ``floor``: truncation; ``half_up``: one half added, then truncation.
    """
    share = F.lit(100.0) * _c(part) / _c(total)
    value = {"round": F.round(share), "floor": F.floor(share), "half_up": F.floor(share + 0.5)}[rule]
    return F.when(_c(total) == 0, F.lit(100)).otherwise(value.cast("int"))


# --- claims in prose ------------------------------------------------------------------------------

#: Cues that what follows does not exist; they reach over the clause (fixed values).
STRONG_CUES = (
    "removed deleted dropped retired abandoned discontinued obsolete defunct formerly".split(), ["no longer"],
    ["provide", "exist", "have", "export", "define", "ship", "offer"], ["there is no"],
    "不提供 不存在 不再有 沒有提供 刪除 移除 拿掉 廢棄 已下線 已被下線 曾經 原本 舊的 過去的 以前的".split(),
)
#: Cues that must stand right before the name (fixed values).
WEAK_CUES, WEAK_CJK = "no not never without old legacy former deprecated".split(), ["不是", "非"]
#: What may follow a name that is gone (fixed values).
GONE_VERBS, GONE_WORDS, GONE_CJK = "was were is are has\\s+been have\\s+been got been now".split(), "removed deleted dropped retired gone".split(), "已刪除 已移除 已拿掉 已廢棄 已被刪除 已被移除 已被拿掉 已被廢棄 不存在 不再存在 已經不在".split()
NEGATION_REACH = 48


def _strong_cue() -> str:
    words, phrases, verbs, there, cjk = STRONG_CUES
    spaced = [x.replace(" ", "\\s+") for x in (*words, *phrases)]
    return "\\b(?:" + "|".join(spaced) + ")\\b|\\bdoes\\s*(?:not|n't)\\s+(?:" + "|".join(verbs) + ")|\\b" + there[0].replace(" ", "\\s+") + "|" + "|".join(cjk)


NEGATION_STRONG = "(?is)^.*(?:" + _strong_cue() + ")"
NEGATION_WEAK = "(?i)(?:\\b(?:" + "|".join(WEAK_CUES) + ")\\b|" + "|".join(WEAK_CJK) + ")[\\s:：*_（(]{0,4}$"
NEGATION_AFTER = "(?i)^.{0,30}?(?:\\b(?:" + "|".join(GONE_VERBS) + ")\\s+(?:" + "|".join(GONE_WORDS) + ")\\b|\\bno\\s+longer\\s+exists?|\\bdoes\\s*(?:not|n't)\\s+exist|" + "|".join(GONE_CJK) + ")"


def negated(before: ColumnLike, after: ColumnLike) -> Column:
    """Whether the words around a claim say that the thing does not exist.

    A strong cue before it reaches to the end of its clause, over other names but not past a colon behind one;
    a weak cue must stand beside it. ``before`` and ``after`` are the rest of the line without the claim's own marks.
    """
    b = _c(before)
    reach = F.regexp_replace(F.regexp_replace(b, NEGATION_STRONG, ""), "`[^`]*`", "``")
    strong = b.rlike(NEGATION_STRONG) & (F.length(reach) <= NEGATION_REACH) & ~reach.rlike("[;.。；]") & ~reach.rlike("``[^`]*[:：][^`]*$")
    return strong | b.rlike(NEGATION_WEAK) | _c(after).rlike(NEGATION_AFTER)


def code_spans(text: ColumnLike) -> Column:
    """Texts between single backquotes of a line or paragraph."""
    return F.regexp_extract_all(_c(text), F.lit("`([^`\\n]+)`"), 1)


def link_targets(text: ColumnLike) -> Column:
    """Targets of inline links and images, in order."""
    return F.regexp_extract_all(_c(text), F.lit("\\]\\(([^()\\s]+)\\)"), 1)


def link_kind(target: ColumnLike) -> Column:
    t = _c(target)
    return F.when(t.rlike("^[a-z][a-z0-9+.-]*://"), "url").when(t.rlike("^(?:mailto|tel|data|javascript):"), "other").when(t.startswith("#"), "anchor").when(F.contains(t, F.lit("#")), "path_anchor").otherwise("path")


def toolchain_claims(text: ColumnLike) -> Column:
    """``tool:version`` for every tool with a version in a sentence, tools in lower case."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit("(?:^|[^a-z0-9])((?:go|python|node(?:[.]js)?|rust|cmake|[.]net|java|ruby)\\s+v?[0-9]+(?:[.][0-9]+)*)"), 1)
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "[.]js", ""), "\\s+v?", ":"))


def install_claims(line: ColumnLike) -> Column:
    """``tool:package`` of install commands in a line of shell."""
    found = F.regexp_extract_all(
        _c(line), F.lit("((?:pip3?|npm|cargo|go|dotnet add|yarn|gem)\\s+(?:install|get|add|package|i)\\s+(?:-[A-Za-z-]+\\s+)*[A-Za-z0-9@][A-Za-z0-9@._/-]*)"), 1
    )
    return F.transform(found, lambda x: F.concat(F.regexp_extract(x, "^([a-z]+)", 1), F.lit(":"), F.regexp_extract(x, "([^\\s]+)$", 1)))
