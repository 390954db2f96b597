"""Functions and methods of source files paired with their documentation.

One scan per file finds every definition, its own documentation and the type it
belongs to, and every type with its parents (line and block comments, strings and
templates are told from code by a lexer of the language family; Go structs and
interfaces have what they embed for parents). Documentation that a function only
inherits is then resolved: a definition without documentation of its own, or with
an "inherit" tag, is joined with its declaration elsewhere (a prototype in a header,
another part of the type), with what the tag names, and with the same method of its
parent types, again and again until nothing more resolves; a Go type also inherits
from the interfaces whose methods it all has. What stays empty is dropped.

A parent's name means the type of that name in the same file, else the only one in
the same directory, else the only one in the repository; if there are several, none.

Defined results for odd input
-----------------------------
* null file_id, null or empty content, unknown language: no rows.
* null lang: the file extension decides; a known lang wins over the extension.
* copies of a file under another ``file_id``: rows for each of them.
* line ends (LF, CRLF, CR), a byte-order mark, a missing last newline: no difference.
* definitions that are quoted in strings or commented out: no rows.
* extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.session import materialise, settled

EXTENSIONS = {
    "go": "go", "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "rs": "rust", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "cs": "csharp",
}
LANGUAGES = {"c++": "c", "cpp": "c", "c#": "csharp", "cs": "csharp", "golang": "go", "py": "python", "js": "javascript", "ts": "typescript", "rs": "rust"}
_KNOWN = frozenset(EXTENSIONS.values())
SCHEMA = (
    "name string, owner string, kind string, bases array<string>, decl_line int, body_end int, has_body boolean,"
    " doc string, params array<string>, trivial boolean, inherits boolean, cref string, code string, scope string"
)


@dataclass
class Definition:
    name: str
    owner: str
    kind: str
    decl_line: int
    first_line: int
    body_end: int
    has_body: bool
    doc: str = ""
    bases: list[str] = field(default_factory=list)


@dataclass
class Comment:
    start: int  # lines, from 1
    end: int
    text: str
    alone: bool  # nothing but blanks before it on its first and after it on its last line
    style: str  # "//", "/*", "#"


# --- the lexer ------------------------------------------------------------------------

_TOKENS = {
    "go": r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)",
    "c": r"//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|R\"(?P<d>[^()\s]{0,16})\(.*?(?:\)(?P=d)\"|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)",
    "csharp": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\$*\"\"\".*?(?:\"\"\"+|\Z)|(?:@\$?|\$@)\"(?:\"\"|[^\"])*(?:\"|\Z)|\$?\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)",
    "rust": r"//[^\n]*|/\*|b?r(?P<h>#*)\".*?(?:\"(?P=h)|\Z)|b?\"(?:\\.|[^\"\\])*(?:\"|\Z)|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'",
    "javascript": r"//[^\n]*|/\*.*?(?:\*/|\Z)|`|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[dgimsuvy]*",
}
_TOKENS["typescript"] = _TOKENS["javascript"]
_TOKEN = {k: re.compile(v, re.S) for k, v in _TOKENS.items()}


def _template_end(text: str, at: int) -> int:
    """The end of a template literal whose backquote is at ``at``; expressions in it may hold templates."""
    n, depth = at + 1, []
    while n < len(text):
        c = text[n]
        if c == "\\":
            n += 2
            continue
        if not depth or depth[-1] == "`":
            if c == "`":
                if not depth:
                    return n + 1
                depth.pop()
            elif c == "$" and text[n + 1 : n + 2] == "{":
                depth.append("{")
                n += 1
        elif c == "`":
            depth.append("`")
        elif c == "{":
            depth.append("{")
        elif c == "}":
            depth.pop()
        n += 1
    return n


_NESTED = re.compile(r"/\*|\*/")


def _nested_end(text: str, at: int) -> int:
    depth = 0
    for m in _NESTED.finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


_KEEP_BREAKS = re.compile(r"[^\n]")


def lex(text: str, lang: str) -> tuple[str, list[tuple[int, int]]]:
    """(code with comments and strings blanked, spans of the comments)."""
    parts, comments, at = [], [], 0
    for_scan = _TOKEN[lang]
    while True:
        m = for_scan.search(text, at)
        if not m:
            break
        start, end = m.start(), m.end()
        if m[0] == "`" and lang in ("javascript", "typescript"):
            end = _template_end(text, start)
        elif m[0] == "/*":
            end = _nested_end(text, start)
        token = text[start:end]
        parts.append(text[at:start])
        if token.startswith(("//", "/*")):
            comments.append((start, end))
            parts.append(_KEEP_BREAKS.sub(" ", token))
        else:
            blank = _KEEP_BREAKS.sub(" ", token)
            parts.append('"' + blank[1:-1] + '"' if len(blank) > 1 and blank[0] == blank[-1] == " " and token.strip()[:1] in "\"'`@$rbR/" else blank)
        at = end
    parts.append(text[at:])
    code = "".join(parts)
    if lang in ("c", "csharp"):
        code = _without_disabled(code)
    return code, comments


def _without_disabled(code: str) -> str:
    """Blanks what ``#if 0`` or ``#if false`` switches off, and all directive lines."""
    out, off, depth = [], 0, 0
    more = False
    for line in code.split("\n"):
        bare = line.lstrip()
        directive = bare.startswith("#") or more
        more = directive and line.rstrip().endswith("\\")
        if bare.startswith("#"):
            word = re.match(r"#\s*(\w*)\s*(.*)", bare)
            if word[1] in ("if", "ifdef", "ifndef"):
                depth += 1
                if not off and word[1] == "if" and re.match(r"\(?\s*(?:0|false)\s*\)?\s*$", word[2]):
                    off = depth
            elif word[1] in ("else", "elif") and off == depth:
                off = 0
            elif word[1] == "endif":
                if off == depth:
                    off = 0
                depth -= 1
        out.append(" " * len(line) if off or directive else line)
    return "\n".join(out)


class _Lines:
    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self.rows = text.split("\n")

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def row(self, number: int) -> str:
        return self.rows[number - 1] if 0 < number <= len(self.rows) else ""


def _comments(text: str, lines: _Lines, spans: list[tuple[int, int]]) -> dict[int, Comment]:
    """Comments by their last line; one line comment per line."""
    found = {}
    for start, end in spans:
        first, last = lines.of(start), lines.of(max(start, end - 1))
        before = text[lines.starts[first - 1] : start].strip()
        after = lines.row(last)[end - lines.starts[last - 1] :].strip()
        token = text[start:end]
        found[last] = Comment(first, last, token, not before and not after, token[:2])
    return found


_PAIRS = {pair: re.compile(f"[{re.escape(pair)}]") for pair in ("()", "{}", "<>")}


def _matching(code: str, at: int, opener: str, closer: str) -> int:
    """Offset just past the bracket that closes the one at ``at``, or -1."""
    depth = 0
    for m in _PAIRS[opener + closer].finditer(code, at):
        depth += 1 if m[0] == opener else -1
        if not depth:
            return m.end()
    return -1


# --- brace languages ---------------------------------------------------------------------

_NO_NAMES = frozenset(
    "if for while switch catch return sizeof do else new throw await typeof delete in of instanceof case function using lock fixed foreach when"
    " unless match loop unsafe static_assert defined nameof yield with super this import export default void class struct enum union namespace".split()
)
_FUNCTIONS = {
    "go": re.compile(r"^[ \t]*func[ \t]*(?P<recv>\([^()]*\)[ \t]*)?(?P<name>[^\W\d]\w*)[ \t]*(?P<generic>\[[^\]]*\])?[ \t]*(?=\()", re.M),
    "rust": re.compile(
        r"^[ \t]*(?P<head>(?:(?:pub(?:[ \t]*\([^()]*\))?|default|const|async|unsafe|extern(?:[ \t]*\"[ ]*\")?)[ \t]+)*)fn[ \t]+(?P<name>(?:r#)?[^\W\d]\w*)", re.M
    ),
    "c": re.compile(r"(?P<name>~?[^\W\d]\w*(?:::~?\w+)*)[ \t\n]*(?=\()"),
    "csharp": re.compile(r"(?P<name>[^\W\d]\w*)[ \t]*(?P<generic><[\w\s,]*>)?[ \t\n]*(?=\()"),
}
_JS_FUNCTIONS = (
    re.compile(r"(?<![\w$.])(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<name>[A-Za-z_$][\w$]*)[ \t]*(?=[(<])"),
    re.compile(
        r"(?<![\w$.])(?:(?:const|let|var)[ \t]+)?(?P<name>[A-Za-z_$#][\w$]*(?:\.[A-Za-z_$][\w$]*)*)[ \t]*(?::[^=;{}()\n]*(?:\([^()\n]*\)[^=;{}()\n]*=>[^=;{}\n]*)?)?=[ \t\n]*(?:async\b[ \t\n]*)?"
        r"(?:function\b[ \t]*\*?[ \t]*(?:[A-Za-z_$][\w$]*)?[ \t]*(?=[(<])|(?P<arrow>(?=[(<])|[A-Za-z_$][\w$]*[ \t]*(?==>)))"
    ),
    re.compile(r"(?<![\w$.#])(?P<name>[A-Za-z_$][\w$]*)[ \t]*:[ \t\n]*(?:async\b[ \t\n]*)?(?:function\b[ \t]*\*?[ \t]*(?:[A-Za-z_$][\w$]*)?[ \t]*(?=\()|(?P<arrow>(?=\()))"),
    re.compile(
        r"(?:^|(?<=[{};,]))[ \t]*(?:(?:public|private|protected|static|readonly|override|abstract|declare|async|get|set|accessor)[ \t]+)*\*?[ \t]*"
        r"(?P<name>#?[A-Za-z_$][\w$]*)[ \t]*\??(?P<method>)(?=[(<])", re.M
    ),
)
_TYPES = {
    "javascript": re.compile(r"(?<![\w$.])class[ \t]+(?P<name>[A-Za-z_$][\w$]*)(?P<rest>[^{};]*)\{"),
    "csharp": re.compile(r"(?<![\w.])(?:class|struct|interface|record(?:[ \t]+(?:class|struct))?)[ \t]+(?P<name>\w+)(?P<rest>[^{};]*)\{"),
    "rust": re.compile(r"(?<![\w.])(?:impl|trait)\b(?P<name>[^{};]*)(?P<rest>)\{"),
    "c": re.compile(r"(?<![\w.])(?:class|struct)[ \t]+(?P<name>\w+)(?P<rest>[^{};()=]*)\{"),
    "go": re.compile(r"^[ \t]*(?:type[ \t]+)?(?P<name>[^\W\d]\w*)(?:\[[^\]\n]*\])?[ \t]+(?P<rest>struct|interface)[ \t]*\{", re.M),
}
_TYPES["typescript"] = re.compile(r"(?<![\w$.])(?:class|interface)[ \t]+(?P<name>[A-Za-z_$][\w$]*)(?P<rest>[^{};]*)\{")


@dataclass
class _Type:
    name: str
    bases: list[str]
    start: int
    end: int
    methods: list[tuple[str, int]] = field(default_factory=list)  # declared without a body, with their offsets


_GO_EMBEDDED = re.compile(r"^[ \t]*\*?(?:\w+\.)?([^\W\d]\w*)(?:\[[^\]\n]*\])?[ \t]*(?:\"[ ]*\")?[ \t]*$", re.M)
_GO_METHOD = re.compile(r"^[ \t]*([^\W\d]\w*)[ \t]*(?=\()", re.M)


_OUTER = re.compile(r"(?:\bnamespace\b[\w:\s]*|\bextern\s*\"[ ]*\"\s*)$")


class _Braces:
    """How deep in curly brackets a place of the code is, and which type holds it."""

    def __init__(self, code: str, types: list[_Type]):
        self.at: list[int] = []
        self.depth: list[int] = []
        level = 0
        for m in _PAIRS["{}"].finditer(code):
            level += 1 if m[0] == "{" else -1
            self.at.append(m.start())
            self.depth.append(level)
        self.edges: list[int] = []
        self.owners: list[_Type | None] = []
        open_types: list[_Type] = []
        for place, closes, n in sorted([(t.start, 0, n) for n, t in enumerate(types)] + [(t.end, 1, n) for n, t in enumerate(types)]):
            if closes:
                open_types = [t for t in open_types if t is not types[n]]
            else:
                open_types.append(types[n])
            self.edges.append(place)
            self.owners.append(open_types[-1] if open_types else None)

    def of(self, at: int) -> int:
        k = bisect_right(self.at, at)
        return self.depth[k - 1] if k else 0

    def owner(self, at: int) -> _Type | None:
        k = bisect_right(self.edges, at - 1)
        return self.owners[k - 1] if k else None

    def outside(self, code: str, at: int) -> bool:
        """Whether a place stands in no block but those of namespaces and linkage."""
        depth, k = self.of(at), bisect_right(self.at, at) - 1
        while depth > 0 and k >= 0:
            if code[self.at[k]] == "{" and self.depth[k] == depth:
                if not _OUTER.search(code, max(0, self.at[k] - 200), self.at[k]):
                    return False
                depth -= 1
            k -= 1
        return True

    def direct(self, at: int, inside: _Type | None) -> bool:
        """Whether a place stands in the type's body itself, not in a deeper block."""
        return inside is not None and self.of(at) == self.of(inside.start)


def _types(code: str, lang: str) -> list[_Type]:
    found = []
    pattern = _TYPES.get(lang)
    for m in pattern.finditer(code) if pattern else ():
        end = _matching(code, m.end() - 1, "{", "}")
        name, rest = m["name"], m["rest"]
        bases: list[str] = []
        methods: list[tuple[str, int]] = []
        if lang == "go":
            body, stop = m.end(), (end if end > 0 else len(code)) - 1
            flat = _flat(code[body:stop])
            bases = [e[1] for e in _GO_EMBEDDED.finditer(flat)]
            if rest == "interface":
                methods = [(e[1], body + e.start(1)) for e in _GO_METHOD.finditer(flat)]
        elif lang == "rust":
            words = re.sub(r"<[^<>]*>|\bwhere\b.*", "", re.sub(r"<[^<>]*>", "", name), flags=re.S)
            trait, _, target = words.partition(" for ")
            name = (target or trait).strip().split("::")[-1].split(":")[0].strip()
            if target:
                bases = [trait.strip().split("::")[-1]]
            elif code.startswith("trait", m.start()):
                name, _, supers = words.strip().partition(":")
                name, bases = name.strip(), [b.strip().split("::")[-1] for b in supers.split("+") if b.strip()]
        elif lang == "csharp":
            listed = re.sub(r"\bwhere\b.*", "", rest, flags=re.S).partition(":")[2]
            bases = [b.strip().split(".")[-1] for b in re.sub(r"<[^<>]*>|\([^()]*\)", "", listed).split(",") if b.strip()]
        elif lang == "c":
            bases = [b.split()[-1] for b in re.sub(r"<[^<>]*>", "", rest.partition(":")[2]).split(",") if b.split()]
        else:
            listed = re.sub(r"<[^<>]*>", "", rest)
            bases = [b.strip().split(".")[-1] for part in re.findall(r"\b(?:extends|implements)\b([^{]*?)(?=\bextends\b|\bimplements\b|$)", listed) for b in part.split(",") if b.strip()]
        found.append(_Type(name, [re.sub(r"\W+$", "", b) for b in bases], m.end() - 1, end if end > 0 else len(code), methods))
    return found


def _flat(body: str) -> str:
    """A block's code with deeper blocks blanked, lines kept."""
    out, level, at = [], 0, 0
    for m in _PAIRS["{}"].finditer(body):
        out.append(body[at : m.start()] if not level else _KEEP_BREAKS.sub(" ", body[at : m.start()]))
        level += 1 if m[0] == "{" else -1
        out.append("~")
        at = m.end()
    return "".join([*out, body[at:]])


_CS_ATTRIBUTES = re.compile(r"^(?:\s*\[[^\[\]]*\])+\s*")
_WORDY = re.compile(r"\w")
_NOT_A_HEAD = re.compile(r"[=!+/%^|?.\"'-]|\breturn\b|\bnew\b|\bthrow\b|\belse\b|\bawait\b|\bcase\b|\bgoto\b")
_ACCESS = re.compile(r"^(?:\s*(?:public|private|protected|signals|slots)\s*:(?!:))+\s*")
_BLANK = re.compile(r"[ \t\n]*")
_SPACE = re.compile(r"\s*")
_GO_TAIL = re.compile(r"[^\n{;=]*")
_GO_TYPE_TAIL = re.compile(r"\b(?:interface|struct)\s*$")
_RUST_TAIL = re.compile(r"[^{};]*")
_C_TAIL = re.compile(r"(?:\s|const\b|noexcept\b(?:\s*\([^()]*\))?|override\b|final\b|volatile\b|&&?|__attribute__\s*\(\(.*?\)\)|->\s*[\w:<>*&\s]+|:\s*\w+\s*[({][^{};]*)*")
_CS_TAIL = re.compile(r"\s*(?::\s*(?:base|this)\s*\([^()]*\)\s*)?(?:where\b[^{};=]*)?")
_JS_TAIL = re.compile(r"\s*(?::\s*(?:[^{};=()]|\([^()]*\)|=>|\{[^{}]*\}(?=\s*[\[|&{>]))*)?")
_JS_ARROW = re.compile(r"\s*(?::.*)?=>")
_JS_BODILESS = re.compile(r"[^\n]*;")


def _after_params(code: str, at: int, lang: str) -> tuple[str, int]:
    """What follows the parameter list that opens at or after ``at``: ("body"|"proto"|"expr"|"", offset)."""
    if at < len(code) and code[at] == "<":
        at = _matching(code, at, "<", ">")
        if at >= 0:
            at = _BLANK.match(code, at).end()
    if at < 0 or at >= len(code) or code[at] != "(":
        return "", -1
    end = _matching(code, at, "(", ")")
    if end < 0:
        return "", -1
    if lang == "go":
        tail = _GO_TAIL.match(code, end).end()
        while code.startswith("{", tail) and _GO_TYPE_TAIL.search(code[end:tail]):
            close = _matching(code, tail, "{", "}")
            if close < 0:
                return "", -1
            tail = _GO_TAIL.match(code, close).end()
        return ("body", tail) if code.startswith("{", tail) else ("proto", end)
    if lang == "rust":
        tail = _RUST_TAIL.match(code, end).end()
        return ("body", tail) if code.startswith("{", tail) else ("proto", tail)
    if lang == "c":
        tail = _C_TAIL.match(code, end).end()
        return ("body", tail) if code.startswith("{", tail) else ("proto", tail) if code.startswith(";", tail) else ("", -1)
    if lang == "csharp":
        tail = _CS_TAIL.match(code, end).end()
        return ("body", tail) if code.startswith("{", tail) else ("expr", tail) if code.startswith("=>", tail) else ("proto", tail) if code.startswith(";", tail) else ("", -1)
    here = _SPACE.match(code, _JS_TAIL.match(code, end).end()).end()
    if code.startswith("=>", here) or _JS_ARROW.match(code, end):
        after = _SPACE.match(code, code.find("=>", end) + 2).end()
        return ("arrow-body", after) if code.startswith("{", after) else ("arrow", after)
    return ("body", here) if code.startswith("{", here) else ("proto", here)


def _scan_braces(text: str, lang: str) -> tuple[list[Definition], dict[int, Comment], _Lines]:
    code, spans = lex(text, lang)
    lines = _Lines(text)
    comments = _comments(text, lines, spans)
    types = _types(code, lang)
    found: list[Definition] = []
    seen: set[int] = set()
    braces = _Braces(code, types)
    owner_of = braces.owner
    for t in types:
        row = lines.of(t.start)
        found.append(Definition("", t.name, "type", row, row, lines.of(t.end - 1), False, bases=t.bases))
        for name, place in t.methods:
            row = lines.of(place)
            found.append(Definition(name, t.name, "method", row, row, row, False))

    def add(name: str, at: int, head: int, what: str, body: int, owner: str = "", bases: list[str] | None = None) -> None:
        if at in seen:
            return
        seen.add(at)
        end = _matching(code, body, "{", "}") if what.endswith("body") else code.find(";", body) if what != "proto" else body
        last = lines.of(max(at, (end if end > 0 else len(text)) - 1))
        first = lines.of(head)
        kind = "method" if owner else "function"
        found.append(Definition(name, owner, kind, lines.of(at), first, last, what != "proto", bases=bases or []))

    def statement_start(at: int) -> int:
        """Where the code of the definition at ``at`` begins: after the last ``; { }`` before it."""
        back = max(code.rfind(c, 0, at) for c in ";{}") + 1
        while back < at and code[back] in " \t\n":
            back += 1
        return back

    if lang in ("javascript", "typescript"):
        for pattern in _JS_FUNCTIONS:
            for m in pattern.finditer(code):
                name, at = m["name"], m.start("name")
                if name.lstrip("#") in _NO_NAMES:
                    continue
                groups = m.groupdict()
                if "method" in groups and (what := _after_params(code, m.end(), lang))[0] != "body":
                    inside = owner_of(at)
                    if not (braces.direct(at, inside) and what[0] == "proto" and _JS_BODILESS.match(code, m.end())):
                        continue
                elif "method" not in groups:
                    if groups.get("arrow") is not None and groups["arrow"]:
                        after = _SPACE.match(code, code.find("=>", m.end()) + 2).end()
                        what = ("arrow-body", after) if code[after : after + 1] == "{" else ("arrow", after)
                    else:
                        what = _after_params(code, m.end(), lang)
                        if groups.get("arrow") is not None and not what[0].startswith("arrow"):
                            continue
                    if not what[0] or what[0] == "proto":
                        continue
                start = max(code.rfind(c, 0, at) for c in "\n;{}") + 1
                start = min(at, _BLANK.match(code, start).end())
                inside = owner_of(at)
                method = braces.direct(at, inside)
                add(name.split(".")[-1].lstrip("#"), at + len(name) - len(name.split(".")[-1]), start, what[0], what[1], inside.name if method else "", inside.bases if method else None)
        return found, comments, lines
    for m in _FUNCTIONS[lang].finditer(code):
        name, at = m["name"], m.start("name")
        if name in _NO_NAMES:
            continue
        begin = m.end()
        if lang == "rust":
            begin = _BLANK.match(code, begin).end()
        what, body = _after_params(code, begin, lang)
        if not what:
            continue
        inside = owner_of(at)
        if lang == "go":
            recv = re.findall(r"[^\W\d]\w*", re.sub(r"\[[^\]]*\]", "", m["recv"] or ""))
            add(name, at, re.compile(r"[ \t]*").match(code, m.start()).end(), what, body, recv[-1] if recv else "")
        elif lang == "rust":
            head = re.compile(r"[ \t]*").match(code, m.start()).end()
            add(name, at, head, what, body, inside.name if inside else "", inside.bases if inside else None)
        else:
            head = statement_start(at)
            before = code[head:at]
            if lang == "csharp" and "[" in before:
                before = _CS_ATTRIBUTES.sub("", before)
            parts = name.split("::")
            if lang == "c":
                before = _ACCESS.sub("", before) if ":" in before else before
                if ")" in before and before.rstrip().endswith((":", ",")):
                    continue  # a member's initialiser
            made = inside and name.lstrip("~") == inside.name or len(parts) > 1 and parts[-1].lstrip("~") == parts[-2]
            if not _WORDY.search(before) and not made:
                continue
            if _NOT_A_HEAD.search(before.replace("->", "").replace("::", "")) and "operator" not in before:
                continue
            if before.count("(") != before.count(")") and "__attribute__" not in before:
                continue
            if what == "proto" and lang == "c" and not inside and not braces.outside(code, at):
                continue
            if lang == "csharp" and not inside:
                if what == "proto":
                    continue
            offset = code.rfind(before, head, at) if before else at
            owner = inside.name if inside else parts[-2] if len(parts) > 1 else ""
            add(parts[-1], at, offset if before.strip() else at, what, body, owner, inside.bases if inside else None)
    return found, comments, lines


_BETWEEN = {
    "rust": re.compile(r"^\s*#!?\[.*"),
    "csharp": re.compile(r"^\s*(?:\[.*|#(?:region|endregion|pragma|nullable|if|endif|else|line|warning)\b.*)"),
    "javascript": re.compile(r"^\s*@[\w$.]+.*"),
    "typescript": re.compile(r"^\s*@[\w$.]+.*"),
    "go": re.compile(r"^\s*//(?:go:|nolint\b|export |line )\S*.*"),
    "c": re.compile(r"^\s*(?:#\s*(?:pragma|if|ifdef|ifndef|endif|else|define|undef|line)\b.*|__attribute__\s*\(\(.*|\[\[.*\]\]\s*|template\s*<.*>\s*|extern\s+\"C\"\s*)$"),
}
_DIRECTIVE = re.compile(r"^\s*(?://\s*(?:eslint-|@ts-|prettier-ignore|istanbul |NOLINT|clang-format|tslint:)|/\*\s*(?:eslint-|@ts-|prettier-ignore|istanbul ))")


def _doc_above(d: Definition, lang: str, comments: dict[int, Comment], lines: _Lines) -> str:
    """The text of the comment that ends directly above a definition, markers removed, or nothing."""
    row = d.first_line - 1
    between = _BETWEEN.get(lang)
    while row > 0:
        text = lines.row(row)
        if not text.strip():
            return ""
        c = comments.get(row)
        comment_line = c is not None and c.alone
        if between and between.match(text) and (lang == "go" or not comment_line):
            row -= 1
            continue
        if comment_line and _DIRECTIVE.match(text):
            row -= 1
            continue
        if not comment_line and text.rstrip().endswith((")", "]")) and lang in ("javascript", "typescript", "rust", "csharp"):
            # An attribute or decorator over several lines.
            top, depth = row, 0
            while top > 0:
                t = lines.row(top)
                depth += t.count(")") + t.count("]") - t.count("(") - t.count("[")
                if depth <= 0:
                    break
                top -= 1
            if top < row and between and between.match(lines.row(top)):
                row = top - 1
                continue
        break
    c = comments.get(row)
    if c is None or not c.alone:
        return ""
    if c.style == "/*":
        if lang in ("rust", "csharp") and not (c.text.startswith("/**") and not c.text.startswith(("/***", "/**/"))):
            return ""
        body = re.sub(r"^/\*+!?|\**\*/$", "", c.text)
        return "\n".join(re.sub(r"^\s*\*+(?=\s|$|\w|@|\{) ?", "", line) for line in body.split("\n"))
    marker = r"^\s*///(?!/)" if lang in ("rust", "csharp") else r"^\s*//+[!/]?"
    block = []
    while (c := comments.get(row)) is not None and c.alone and c.style == "//":
        text = lines.row(row)
        if not re.match(marker, text):
            break
        if not (between and lang == "go" and between.match(text)) and not _DIRECTIVE.match(text):
            block.append(re.sub(marker + " ?", "", text))
        row -= 1
    return "\n".join(reversed(block))


# --- Python ------------------------------------------------------------------------------------

_PY_TOKEN = re.compile(
    r"#[^\n]*|(?P<prefix>(?<![\w])[rRbBuUfFtT]{0,3})(?P<quote>\"\"\"|'''|\"|')", re.S
)


def _py_strings(text: str) -> tuple[str, dict[int, tuple[int, str, str]]]:
    """(code with strings and comments blanked, string by offset of its first character: (end, prefix, value))."""
    parts, strings, at = [], {}, 0
    while True:
        m = _PY_TOKEN.search(text, at)
        if not m:
            break
        start = m.start()
        parts.append(text[at:start])
        if m["quote"] is None:
            end = m.end()
        else:
            quote = m["quote"]
            stop = re.compile((r"(?:\\.|(?!" + quote + r")[^\\" + ("" if len(quote) == 3 else r"\n") + r"])*"), re.S)
            inner = stop.match(text, m.end())
            end = inner.end() + (len(quote) if text.startswith(quote, inner.end()) else 0)
            strings[start] = (end, m["prefix"].lower(), inner[0])
        token = text[start:end]
        blank = _KEEP_BREAKS.sub(" ", token)
        parts.append("\x02" + blank[1:] if m["quote"] is not None and blank else blank)
        at = end
    parts.append(text[at:])
    return "".join(parts), strings


_PY_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*(?:\[[^\]]*\][ \t]*)?(?=\()", re.M)
_PY_CLASS = re.compile(r"^([ \t]*)class[ \t]+([^\W\d]\w*)[ \t]*(?:\[[^\]]*\])?[ \t]*(\([^()]*(?:\([^()]*\)[^()]*)*\))?[ \t]*:", re.M)


def _indent(text: str) -> int:
    return len(text.expandtabs(8))


_DENT = re.compile(r"[ \t]*")
_PY_COLON = re.compile(r"[ \t]*(?:->[^:\n]*(?:\[[^\]]*\][^:\n]*)*)?:")
_PY_AFTER = re.compile(r"[ \t\n\r;]*")


def _block_ends(dents: list[int | None]) -> list[int]:
    """By line (from 0): the number of lines up to the end of the block that it opens."""
    ends, waiting = [len(dents)] * len(dents), []
    for n, dent in enumerate(dents):
        if dent is None:
            continue
        while waiting and dents[waiting[-1]] >= dent:
            ends[waiting.pop()] = n
        waiting.append(n)
    return ends


def _end_below(dents: list[int | None], start: int, depth: int) -> int:
    return next((k for k in range(start, len(dents)) if dents[k] is not None and dents[k] <= depth), len(dents))


def _scan_python(text: str) -> list[Definition]:
    code, strings = _py_strings(text)
    lines = _Lines(text)
    rows = code.split("\n")
    classes = [(_indent(m[1]), m[2], [b.split("=")[0].strip().split(".")[-1].split("[")[0] for b in (m[3] or "()")[1:-1].split(",") if b.strip() and "=" not in b], lines.of(m.start(2))) for m in _PY_CLASS.finditer(code)]
    dents = [_indent(_DENT.match(row)[0]) if row.strip() else None for row in rows]
    ends = _block_ends(dents)
    found = [Definition("", name, "type", line, line, ends[line - 1], False, bases=bases) for _, name, bases, line in classes]
    open_classes: list[tuple] = []
    waiting = iter(classes)
    following = next(waiting, None)
    for m in _PY_DEF.finditer(code):
        depth = _indent(m[1])
        end = _matching(code, m.end(), "(", ")")
        if end < 0:
            continue
        colon = _PY_COLON.match(code, end)
        if not colon:
            continue
        line = lines.of(m.start(2))
        after = _PY_AFTER.match(code, colon.end()).end()
        value = strings.get(after)
        last = lines.of(colon.end())
        same_line = lines.of(after) == last
        doc = ""
        if value and "f" not in value[1] and "b" not in value[1] and "t" not in value[1]:
            first = lines.row(lines.of(after))
            if same_line or _indent(re.match(r"[ \t]*", first)[0]) > depth:
                tail = code[value[0] :].split("\n", 1)[0].strip()
                if not tail or tail.startswith((";", "#")) or tail.startswith("\x02"):
                    doc = value[2]
                    if "r" not in value[1]:
                        doc = doc.replace("\\\n", "").replace('\\"', '"').replace("\\'", "'")
                    doc = doc or " "
        bottom = ends[line - 1] if last <= line else max(last, _end_below(dents, last, depth))
        while bottom > line and not lines.row(bottom).strip():
            bottom -= 1
        while following and following[3] < line:
            open_classes = [c for c in open_classes if ends[c[3] - 1] >= following[3]] + [following]
            following = next(waiting, None)
        holding = [c for c in open_classes if c[0] < depth and ends[c[3] - 1] >= line]
        owner, bases = (holding[-1][1], holding[-1][2]) if holding else ("", [])
        found.append(Definition(m[2], owner, "method" if owner else "function", line, line, bottom, True, doc, bases))
    return found


# --- what documentation says ----------------------------------------------------------------------

#: Notes that stand where documentation is missing (fixed values).
_STUB = re.compile(
    r"^\W*(?:(?:TODO|FIXME|XXX|HACK|TBD|WIP|NOTE TO SELF)\b.*|tbd|tba|n/?a|none|null|nothing|stub|undocumented|placeholder|description|summary|docs?|documentation"
    r"|auto-?generated(?: method)?(?: stub)?(?: comment)?|(?:method|function) stub|(?:missing|no|add|write|insert|needs?) (?:docs?|documentation|description|comment)s?(?: here| needed| yet)?"
    r"|(?:to be|not yet) (?:written|documented|done|implemented)|not implemented(?: yet)?|coming soon|fill (?:this|me) in|see above|ditto|same as above|\.{2,}|\?+)\W*$",
    re.I,
)
_SEPARATOR = re.compile(r"^[\W_]*$|^\s*([-=*#~_+/])\1{2,}.*\1{3,}\s*$")
_BARE_TAG = re.compile(
    r"^\s*(?:[@\\](?:param|arg|argument|tparam|typeparam|property|prop|throws|exception|raises?)\b(?:\s*\[[^\]]*\])?(?:\s*\{[^{}]*\})?(?:\s+[\w.$\[\]=*&]+)?\s*[-:]?\s*"
    r"|[@\\]\w+(?:\s*\{[^{}]*\})?\s*[.:-]?\s*|\{@?inherit-?docs?\}\s*|@?inherit-?docs?\s*|:\w+(?:\s+[\w.*]+)*:\s*|\{@\w+\}\s*"
    r"|(?:args?|arguments?|param(?:eter)?s?|returns?|raises?|yields?|examples?|notes?|throws|exceptions?|errors?|panics?|safety|remarks?|see also|attributes|usage)\s*:?\s*|#+\s*(?:examples?|arguments?|returns?|panics|errors|safety)\s*)$",
    re.I,
)
_XML = re.compile(r"</?[A-Za-z][\w.:-]*(?:\s[^<>]*)?/?>|<!--.*?-->")
#: Words that add nothing to a name (fixed values).
_FILLER = frozenset(
    "a an the this that it its is does do of for to in on and or function method func fn def procedure routine helper implementation implements implement class object"
    " type value handler member operation call calls called simply just we i s ed es ing".split()
)
_INHERIT = re.compile(r"^\s*\{?@?inherit-?docs?\b|<inheritdoc\b|^\s*\(non-javadoc\)|^\s*see (?:base|parent|super)", re.I | re.M)


_CREF = re.compile(r"<inheritdoc\b[^<>]*\bcref\s*=\s*\"(?:[A-Z]:)?([\w.]+)", re.I)
#: The tag itself, where the inherited text goes.
_INHERIT_TAG = r"(?i)\{@inheritdoc\}|<inheritdoc\b[^<>]*/?>(?:\s*</inheritdoc>)?|@inheritdoc\b"


_WORD_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
#: Stems of a task's words, emptied when they are many.
_STEMS: dict[str, str] = {}


def _words(text: str) -> list[str]:
    return [p.lower() for p in _WORD_PARTS.findall(text)]


def _stem(word: str) -> str:
    known = _STEMS.get(word)
    if known is None:
        known = next((word[: -len(tail)] for tail in ("ing", "ies", "es", "ed", "s", "e", "y") if len(word) > len(tail) + 2 and word.endswith(tail)), word)
        if len(_STEMS) > 50_000:
            _STEMS.clear()
        _STEMS[word] = known
    return known


def substance(doc: str, name: str) -> str:
    """What documentation says beyond blanks, separators, bare tags, notes to do and the name itself."""
    kept: list[str] = []
    if not doc or doc.isspace():
        return ""
    for line in (_XML.sub(" ", doc) if "<" in doc else doc).split("\n"):
        bare = line.strip()
        if not bare or _SEPARATOR.match(bare) or _BARE_TAG.match(bare) or _STUB.match(bare):
            continue
        kept.append(bare)
    if not kept:
        return ""
    parts = _words(name)
    own = {*map(_stem, parts), name.lower().strip("_"), "".join(parts)}
    said = " ".join(kept)
    said = said.replace(name, " ") if name else said
    return "\n".join(kept) if any(w not in _FILLER and w not in own and _stem(w) not in own for w in _words(said)) else ""


_PARAM = re.compile(r"^\s*(?:[@\\]param(?:\s*\{[^{}]*\})?\s+\[?([\w.$]+)|:param(?:\s+\w+)?\s+([\w*]+)\s*:|<param\s+name=\"([^\"]+)\"|[-*]?\s*`?(\*{0,2}\w+)`?(?:\s*\([^()]*\))?\s*:\s+\S)")


def doc_params(doc: str) -> list[str]:
    """Names of the parameters that documentation describes, in order."""
    names, listed = [], False
    for line in doc.split("\n"):
        if re.match(r"^\s*(?:args?|arguments?|param(?:eter)?s?)\s*:?\s*$", line, re.I):
            listed = True
            continue
        m = _PARAM.match(line)
        if m and (name := m[1] or m[2] or m[3] or (m[4] if listed else None)) and name not in names:
            names.append(name)
        elif listed and not line.strip():
            listed = False
    return names


def language_of(lang: str | None, file: str | None) -> str | None:
    known = (lang or "").strip().lower()
    known = LANGUAGES.get(known, known)
    return known if known in _KNOWN else EXTENSIONS.get((file or "").rsplit(".", 1)[-1].lower())


def scan_file(content: str | None, lang: str | None, file: str | None = None) -> list[Definition]:
    """All definitions of a file with their own documentation, in order."""
    language = language_of(lang, file)
    if not content or not language:
        return []
    text = re.sub(r"\r\n?", "\n", content.lstrip("\ufeff"))
    if language == "python":
        return _scan_python(text)
    found, comments, lines = _scan_braces(text, language)
    for d in found:
        if d.kind != "type":
            d.doc = _doc_above(d, language, comments, lines)
    return sorted(found, key=lambda d: (d.decl_line, d.name))


def _scope(language: str, file: str | None, file_id: int) -> str:
    """What a type's name is unique in: a file, a directory (Go), a repository (C, C#)."""
    if language in ("c", "csharp"):
        return ""
    path = file or str(file_id)
    return path.rpartition("/")[0] if language == "go" else path


def _scan_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file_id", "repo", "file", "lang", *(c.split()[0] for c in SCHEMA.split(", "))]
    for batch in batches:
        rows = []
        for file_id, repo, file, lang, content in batch[["file_id", "repo", "file", "lang", "content"]].itertuples(index=False, name=None):
            rows_of = re.sub(r"\r\n?", "\n", (content or "").lstrip("\ufeff")).split("\n")
            language = language_of(lang, file)
            for d in scan_file(content, lang, file):
                said = substance(d.doc, d.name) if d.name else ""
                code = "\n".join(rows_of[d.first_line - 1 : d.body_end]) if d.has_body else ""
                doc = re.sub(r"\n{3,}", "\n\n", "\n".join(line.rstrip() for line in d.doc.split("\n"))).strip()
                rows.append(
                    (file_id, repo, file, language, d.name, d.owner, d.kind, d.bases, d.decl_line, d.body_end, d.has_body, doc, doc_params(d.doc), not said, bool(_INHERIT.search(d.doc)), (_CREF.search(d.doc) or [None, None])[1], code, _scope(language, file, file_id))
                )
        yield pd.DataFrame(rows, columns=columns)


def scan_functions(source_files: DataFrame) -> DataFrame:
    """One row per definition or prototype of every file; nothing is dropped yet."""
    narrow = source_files.where("file_id is not null").select("file_id", "repo", "file", "lang", "content")
    return narrow.mapInPandas(_scan_batches, "file_id bigint, repo string, file string, lang string, " + SCHEMA)


_PAIR_COLUMNS = ("file_id", "repo", "file", "lang", "symbol", "kind", "decl_line", "doc", "params", "code", "doc_origin")


def _named(rows: DataFrame, origin: str) -> DataFrame:
    return rows.withColumns({"symbol": F.concat_ws(".", F.nullif("owner", F.lit("")), "name"), "doc_origin": F.lit(origin)}).select(*_PAIR_COLUMNS)


def own_functions(source_files: DataFrame) -> DataFrame:
    """The functions of :func:`pair_functions` whose documentation stands at themselves; one scan, nothing is joined."""
    return _named(scan_functions(source_files).where("has_body and not trivial"), "own")


@settled("paired")
def pair_functions(source_files: DataFrame) -> DataFrame:
    """Code and description of every documented function.

    Columns: file_id, repo, file, lang, symbol, kind, decl_line, doc, params, code, doc_origin
    (``own`` or ``inherited``). Functions whose documentation is missing or trivial and cannot
    be inherited are not in the result; an "inherit" tag beside other text is replaced by
    what it stands for.
    """
    scanned = materialise(scan_functions(source_files), "functions")
    own = scanned.where("has_body and not trivial")
    found = _inherited(scanned)
    if found is None:
        return _named(own, "own")
    key = ["repo", "lang", "scope", "owner", "name"]
    taken = found.withColumnRenamed("type", "owner")
    tagged = own.where("inherits").join(taken, key, "left")
    said = F.regexp_replace("doc", F.lit(_INHERIT_TAG), F.regexp_replace(F.col("d.doc"), r"([\\\\$])", r"\\\\$1"))
    tagged = tagged.withColumn("doc", F.coalesce(said, F.col("doc"))).drop("d")
    missing = scanned.where("has_body and trivial").drop("doc", "params").join(taken, key)
    missing = missing.withColumns({"doc": F.col("d.doc"), "params": F.col("d.params")})
    return _named(own.where("not inherits"), "own").unionByName(_named(tagged, "own")).unionByName(_named(missing, "inherited"))


_TYPE = ["repo", "lang", "scope", "type"]


def _parents(scanned: DataFrame) -> DataFrame:
    """(repo, lang, scope, type, p_scope, p_type) of every type and parent whose name means one type."""
    types = scanned.where("owner <> ''").select("repo", "lang", "scope", F.col("owner").alias("type")).distinct()
    named = scanned.where("kind = 'type' and size(bases) > 0").select("repo", "lang", "scope", F.col("owner").alias("type"), F.explode("bases").alias("p_type")).where("p_type <> ''").distinct()
    here = named.join(types.select("repo", "lang", "scope", F.col("type").alias("p_type")), ["repo", "lang", "scope", "p_type"], "left_semi").withColumn("p_scope", F.col("scope"))
    rest = named.join(here, [*_TYPE, "p_type"], "left_anti")
    folder = F.regexp_extract("scope", "^(.*)/[^/]*$", 1)
    only = lambda by: F.when(F.min(by) == F.max(by), F.min(by)).alias("p_scope")
    near = types.groupBy("repo", "lang", folder.alias("folder"), F.col("type").alias("p_type")).agg(only("scope")).where("p_scope is not null")
    beside = rest.withColumn("folder", folder).join(near, ["repo", "lang", "folder", "p_type"]).drop("folder")
    rest = rest.join(beside, [*_TYPE, "p_type"], "left_anti")
    whole = types.groupBy("repo", "lang", F.col("type").alias("p_type")).agg(only("scope")).where("p_scope is not null")
    far = rest.join(whole, ["repo", "lang", "p_type"])
    columns = [*_TYPE, "p_scope", "p_type"]
    # A Go type has the interfaces of its package whose methods it all has.
    go = scanned.where("lang = 'go' and kind = 'method' and owner <> ''").select("repo", "lang", "scope", F.col("owner").alias("type"), "name", "has_body").distinct()
    asked = go.where("not has_body").select("repo", "lang", "scope", F.col("type").alias("p_type"), "name")
    met = go.where("has_body").select(*_TYPE, "name").join(asked, ["repo", "lang", "scope", "name"]).groupBy(*_TYPE, "p_type").agg(F.count("*").alias("n"))
    has_all = met.join(asked.groupBy("repo", "lang", "scope", "p_type").agg(F.count("*").alias("n")), ["repo", "lang", "scope", "p_type", "n"]).withColumn("p_scope", F.col("scope"))
    out = here.select(*columns)
    for more in (beside, far, has_all):
        out = out.unionByName(more.select(*columns))
    return out.where("type <> p_type or scope <> p_scope").distinct()


def _inherited(scanned: DataFrame) -> DataFrame | None:
    """(repo, lang, scope, type, name, d: doc and params) of functions that take documentation from elsewhere; None if none asks for it."""
    asking = scanned.where("has_body and (trivial or inherits) and (owner <> '' or lang = 'c')")
    wanted = asking.select("repo", "lang", "scope", F.col("owner").alias("type"), "name").distinct()
    if wanted.isEmpty():
        return None
    # One documentation per (type, method): copies of a file and repeated declarations fold here.
    told = scanned.where("name <> '' and not trivial and not inherits and (owner <> '' or lang = 'c')")
    docs = materialise(told.groupBy("repo", "lang", "scope", F.col("owner").alias("type"), "name").agg(F.min_by(F.struct("doc", "params"), F.struct("file_id", "decl_line")).alias("d")), "docs")
    parents = materialise(_parents(scanned), "parents")
    origin = ["repo", "lang", "scope", "type", "name"]
    # What a tag names, then the declaration elsewhere.
    target = F.split("cref", r"\.")
    named = asking.where("cref is not null").select("repo", "lang", "scope", F.col("owner").alias("type"), "name", F.element_at(target, -1).alias("t_name"), F.coalesce(F.try_element_at(target, F.lit(-2)), F.col("owner")).alias("t_type")).distinct()
    of_name = docs.groupBy("repo", "lang", F.col("type").alias("t_type"), F.col("name").alias("t_name")).agg(F.min_by("d", "scope").alias("d"))
    tagged = named.join(of_name, ["repo", "lang", "t_type", "t_name"]).groupBy(*origin).agg(F.min_by("d", F.struct("t_type", "t_name")).alias("d"))
    elsewhere = wanted.join(docs, origin).select(*origin, "d")
    done = tagged.unionByName(elsewhere.join(tagged, origin, "left_anti"))
    done = materialise(done, "inherit")
    front = wanted.join(done, origin, "left_anti").select(*origin, F.col("scope").alias("at_scope"), F.col("type").alias("at_type"))
    seen = front
    step = parents.select("repo", "lang", F.col("scope").alias("at_scope"), F.col("type").alias("at_type"), "p_scope", "p_type")
    while True:
        up = front.join(step, ["repo", "lang", "at_scope", "at_type"]).select(*origin, F.col("p_scope").alias("at_scope"), F.col("p_type").alias("at_type")).distinct()
        up = up.join(seen, [*origin, "at_scope", "at_type"], "left_anti")  # a circle of parents ends here
        at = docs.select("repo", "lang", F.col("scope").alias("at_scope"), F.col("type").alias("at_type"), "name", "d")
        up = materialise(up.join(at, ["repo", "lang", "at_scope", "at_type", "name"], "left"), "inherit")
        hit = up.where("d is not null").groupBy(*origin).agg(F.min_by("d", F.struct("at_type", "at_scope")).alias("d"))
        done = done.unionByName(hit)
        front = up.where("d is null").drop("d").join(hit, origin, "left_anti").select(*origin, "at_scope", "at_type")
        if front.isEmpty():
            return done
        seen = seen.unionByName(up.select(*seen.columns))
