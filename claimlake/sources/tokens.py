"""Documents as token rows: Markdown, reStructuredText and AsciiDoc in one schema.

Tokenizers keep state from line to line, so they run in Python over Arrow batches,
one document at a time; everything after them is relational.
"""

from __future__ import annotations

import re
import textwrap
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, kind string, line int, end_line int, col int, text string, target string, lang string, level int"
KINDS = ("heading", "fence", "span", "link", "image", "comment", "bare", "label", "table")
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

_URL = re.compile(r"https?://[^\s<>\"'`\])]+")
_BARE = re.compile(r"(?<![\w/.@~-])(?:\.{0,2}/)?(?:[\w.@-]+/)+[\w.@-]*\w")


class _Tokens:
    def __init__(self, path: str):
        self.path, self.rows = path, []

    def add(self, kind: str, line: int, text: str, col: int = 1, end: int | None = None, target: str | None = None, lang: str | None = None, level: int | None = None) -> None:
        self.rows.append((self.path, kind, line, end or line, col, text, target, lang, level))


def _byte_col(line: str, at: int) -> int:
    return len(line[:at].encode()) + 1


def _blank(line: str, start: int, end: int) -> str:
    return line[:start] + " " * (end - start) + line[end:]


def split_lines(text: str) -> list[str]:
    lines = re.split(r"\r?\n", text.removeprefix("\ufeff"))
    return lines[:-1] if lines and lines[-1] == "" else lines


def _inline_markdown(out: _Tokens, number: int, line: str, definitions: dict[str, str]) -> None:
    """Spans, links, images and bare paths of a line; each kind hides what it took from the next."""
    rest = line
    for m in re.finditer(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", line):
        out.add("span", number, m[2].strip(), _byte_col(line, m.start(2)))
        rest = _blank(rest, m.start(), m.end())
    for m in re.finditer(r"(!?)\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(\s*<?([^()\s<>]*(?:\([^()\s]*\)[^()\s<>]*)*)>?(?:\s+[\"'(][^\"')]*[\"')])?\s*\)", rest):
        if m[3]:
            out.add("image" if m[1] else "link", number, line[m.start(2) : m.end(2)], _byte_col(line, m.start()), target=m[3])
        rest = _blank(rest, m.start(), m.end())
    for m in re.finditer(r"(!?)\[([^\[\]]+)\](?:\[([^\[\]]*)\])?(?![(:])", rest):
        goal = definitions.get((m[3] or m[2]).strip().lower())
        if goal:
            out.add("image" if m[1] else "link", number, m[2], _byte_col(line, m.start()), target=goal)
            rest = _blank(rest, m.start(), m.end())
    for m in re.finditer(r"<((?:https?|mailto):[^<>\s]+)>", rest):
        out.add("link", number, m[1], _byte_col(line, m.start()), target=m[1])
        rest = _blank(rest, m.start(), m.end())
    for m in _URL.finditer(rest):
        url = m[0].rstrip(".,;:!?")
        out.add("link", number, url, _byte_col(line, m.start()), target=url)
        rest = _blank(rest, m.start(), m.end())
    for m in _BARE.finditer(rest):
        out.add("bare", number, m[0], _byte_col(line, m.start()))


def markdown(path: str, text: str) -> list[tuple]:
    out, lines = _Tokens(path), split_lines(text)
    n = 0
    if lines and lines[0].rstrip() == "---":
        end = next((k for k in range(1, len(lines)) if lines[k].rstrip() in ("---", "...")), None)
        n = end + 1 if end else 0
    definitions, hidden = {}, set()
    for k, line in enumerate(lines):
        m = re.match(r"^ {0,3}\[([^\[\]^]+)\]:\s*<?(\S+?)>?(?:\s|$)", line)
        if m:
            definitions.setdefault(m[1].strip().lower(), m[2])
            hidden.add(k)
    while n < len(lines):
        line = lines[n]
        fence = re.match(r"^\s{0,6}(`{3,}|~{3,})\s*([^`]*)$", line)
        if fence:
            close = re.compile(rf"^\s{{0,6}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$")
            end = next((k for k in range(n + 1, len(lines)) if close.match(lines[k])), len(lines))
            out.add("fence", n + 1, "\n".join(lines[n + 1 : end]), end=min(end + 1, len(lines)), lang=(fence[2].split() or [""])[0].strip("{}.").lower())
            n = end + 1
            continue
        if "<!--" in line:
            at = line.index("<!--")
            end = next((k for k in range(n, len(lines)) if "-->" in lines[k][at if k == n else 0 :]), len(lines) - 1)
            body = "\n".join([line[at + 4 :], *lines[n + 1 : end + 1]] if end > n else [line[at + 4 :]])
            out.add("comment", n + 1, body.split("-->")[0].strip(), _byte_col(line, at), end=end + 1)
            if end > n:
                if line[:at].strip():
                    _inline_markdown(out, n + 1, line[:at], definitions)
                n = end + 1
                continue
            line = re.sub(r"<!--.*?-->", lambda m: " " * len(m[0]), line)
        atx = re.match(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$", line)
        below = lines[n + 1] if n + 1 < len(lines) else ""
        if atx and atx[2]:
            out.add("heading", n + 1, atx[2], level=len(atx[1]))
        elif line.strip() and re.match(r"^ {0,3}(=+|-{2,})[ \t]*$", below) and not re.match(r"^\s*(?:[-*+>|]|\d+[.)])", line) and n not in hidden:
            out.add("heading", n + 1, line.strip(), level=1 if "=" in below else 2)
        elif "|" in line and re.match(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$", below) and "|" in below:
            end = n + 2
            while end < len(lines) and "|" in lines[end]:
                end += 1
            out.add("table", n + 1, str(len(line.strip().strip("|").split("|"))), end=end, level=end - n - 2)
        for m in re.finditer(r"\{#([\w-]+)\}|<a\s+(?:id|name)=[\"']([^\"']+)", line):
            out.add("label", n + 1, m[1] or m[2])
        if n not in hidden:
            _inline_markdown(out, n + 1, line, definitions)
        n += 1
    return out.rows


_RST_CODE = ("code-block", "code", "sourcecode", "parsed-literal", "literalinclude")


def rst(path: str, text: str) -> list[tuple]:
    out, lines = _Tokens(path), split_lines(text)
    styles: list[tuple[str, bool]] = []
    n, skip = 0, -1
    adorned = re.compile(r"^([!-/:-@\[-`{-~])\1{1,}\s*$")
    while n < len(lines):
        line = lines[n]
        below = lines[n + 1] if n + 1 < len(lines) else ""
        above = lines[n - 1] if n else ""
        if line.strip() and not line[0].isspace() and adorned.match(below) and len(below.rstrip()) >= len(line.rstrip()) and not adorned.match(line):
            style = (below[0], bool(adorned.match(above)))
            if style not in styles:
                styles.append(style)
            out.add("heading", n + 1, line.strip(), level=styles.index(style) + 1)
            n += 2
            continue
        label = re.match(r"^\.\. _([^:]+):\s*(\S*)\s*$", line)
        directive = re.match(r"^(\s*)\.\. ([\w:-]+)::\s*(.*)$", line)
        literal = line.rstrip().endswith("::") and not directive
        if label and not label[2]:
            out.add("label", n + 1, label[1].strip("`"))
        elif label:
            out.add("link", n + 1, label[1].strip("`"), target=label[2])
        elif directive or literal:
            depth = len(directive[1]) if directive else len(line) - len(line.lstrip())
            end = n + 1
            while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > depth):
                end += 1
            body = [b for b in lines[n + 1 : end]]
            while body and not body[-1].strip():
                body.pop()
            name = directive[2] if directive else "literal"
            if name in _RST_CODE or name == "literal":
                while body and (not body[0].strip() or re.match(r"^\s*:\w[\w-]*:", body[0])):
                    body.pop(0)
                out.add("fence", n + 1, textwrap.dedent("\n".join(body)), end=n + 1 + len(body), lang=(directive[3].strip().lower() if directive and name != "literalinclude" else ""))
                if name == "literalinclude":
                    out.add("link", n + 1, name, target=directive[3].strip())
                n = end
                if literal and line.strip() != "::":
                    _inline_rst(out, n, line)
                continue
            if name in ("image", "figure", "include", "toctree", "download"):
                if directive[3].strip():
                    out.add("image" if name in ("image", "figure") else "link", n + 1, name, target=directive[3].strip())
                for k in range(n + 1, end) if name == "toctree" else ():
                    page = lines[k].strip()
                    if page and not page.startswith(":"):
                        out.add("link", k + 1, page, target=re.sub(r".*<(.*)>$", r"\1", page))
                n = end
                continue
            if name.split(":")[-1] in ("function", "class", "method", "attribute", "data", "exception", "module", "autofunction", "autoclass", "automodule", "automethod"):
                out.add("span", n + 1, directive[3].strip(), lang=name)
        elif line.startswith(".. "):
            out.add("comment", n + 1, line[3:].strip())
        elif line.lstrip().startswith(">>>"):
            end = n
            while end < len(lines) and lines[end].strip():
                end += 1
            out.add("fence", n + 1, "\n".join(lines[n:end]), end=end, lang="pycon")
            n = end
            continue
        elif n != skip:
            _inline_rst(out, n + 1, line)
        n += 1
    return out.rows


def _inline_rst(out: _Tokens, number: int, line: str) -> None:
    rest = line
    for pattern, kind in ((r"``(.+?)``", "span"), (r":([\w:]+):`([^`]+)`", "role"), (r"`([^`<>]*)<([^`<>]+)>`__?", "link"), (r"(?<![:`\w])`([^`]+)`(?!_|`)", "span")):
        for m in re.finditer(pattern, rest):
            if kind == "role":
                text, _, goal = m[2].partition("<")
                goal = goal.rstrip("> ") or text.strip()
                role = m[1].split(":")[-1]
                if role in ("ref", "doc", "download", "file"):
                    out.add("link", number, text.strip(), _byte_col(line, m.start()), target=("#" + goal if role == "ref" else goal), lang=role)
                else:
                    out.add("span", number, goal.lstrip("~!."), _byte_col(line, m.start()), lang=role)
            elif kind == "link":
                out.add("link", number, m[1].strip(), _byte_col(line, m.start()), target=m[2].strip())
            else:
                out.add("span", number, m[1].strip(), _byte_col(line, m.start(1)))
        rest = re.sub(pattern, lambda m: " " * len(m[0]), rest)
    for m in _URL.finditer(rest):
        out.add("link", number, m[0].rstrip(".,;"), _byte_col(line, m.start()), target=m[0].rstrip(".,;"))
    for m in _BARE.finditer(_URL.sub(lambda m: " " * len(m[0]), rest)):
        out.add("bare", number, m[0], _byte_col(line, m.start()))


def asciidoc(path: str, text: str) -> list[tuple]:
    out, lines = _Tokens(path), split_lines(text)
    n, lang, anchor = 0, "", None
    while n < len(lines):
        line = lines[n]
        block = re.match(r"^(-{4,}|\.{4,}|={4,}|/{4,})\s*$", line)
        title = re.match(r"^(={1,6})\s+(\S.*)$", line)
        source = re.match(r"^\[source(?:,\s*([\w+-]+))?.*\]\s*$", line)
        named = re.match(r"^\[\[([^\],]+).*\]\]\s*$|^\[#([\w-]+).*\]\s*$", line)
        if source:
            lang = (source[1] or "").lower()
        elif named:
            anchor = named[1] or named[2]
            out.add("label", n + 1, anchor)
        elif block and not title:
            end = next((k for k in range(n + 1, len(lines)) if lines[k].rstrip() == line.rstrip()), len(lines))
            if line[0] == "/":
                out.add("comment", n + 1, "\n".join(lines[n + 1 : end]), end=end + 1)
            elif line[0] in "-.":
                out.add("fence", n + 1, "\n".join(lines[n + 1 : end]), end=min(end + 1, len(lines)), lang=lang)
            if line[0] != "=":
                n = end
            lang = ""
        elif title:
            out.add("heading", n + 1, title[2].strip(), level=len(title[1]), target=anchor)
            anchor = None
        elif line.startswith("//"):
            out.add("comment", n + 1, line[2:].strip())
        elif line.startswith("|==="):
            end = next((k for k in range(n + 1, len(lines)) if lines[k].startswith("|===")), len(lines) - 1)
            out.add("table", n + 1, "0", end=end + 1, level=sum(x.startswith("|") for x in lines[n + 1 : end]))
        else:
            rest = line
            for m in re.finditer(r"(image|include|link|xref)::?([^\[\]\s]+)\[([^\[\]]*)\]|(https?://[^\[\]\s]+)\[([^\[\]]*)\]|<<#?([^,<>]+)(?:,([^<>]*))?>>", line):
                goal = m[2] or m[4] or "#" + m[6]
                out.add("image" if m[1] == "image" else "link", n + 1, m[3] or m[5] or m[7] or goal, _byte_col(line, m.start()), target=goal)
                rest = _blank(rest, m.start(), m.end())
            for m in re.finditer(r"(?<!`)`\+?([^`+]+)\+?`(?!`)", rest):
                out.add("span", n + 1, m[1].strip(), _byte_col(line, m.start(1)))
                rest = _blank(rest, m.start(), m.end())
            for m in _URL.finditer(rest):
                out.add("link", n + 1, m[0].rstrip(".,;"), _byte_col(line, m.start()), target=m[0].rstrip(".,;"))
                rest = _blank(rest, m.start(), m.end())
            for m in _BARE.finditer(rest):
                out.add("bare", n + 1, m[0], _byte_col(line, m.start()))
        n += 1
    return out.rows


def format_of(path: str, text: str) -> str:
    """The document format by extension; a ``.txt`` is looked into."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("rst", "rest"):
        return "rst"
    if ext in ("adoc", "asciidoc", "asc"):
        return "asciidoc"
    if ext == "txt":
        head = "\n".join(split_lines(text)[:120])
        if re.search(r"^\.\. [\w-]+::", head, re.M) or re.search(r"^\S.*\n(=+|-+|~+)\n", head) and "](" not in head and not re.search(r"^#{1,6} ", head, re.M):
            return "rst"
    return "markdown"


_PARSERS = {"markdown": markdown, "rst": rst, "asciidoc": asciidoc}


def tokenize(path: str, text: str) -> list[tuple]:
    return _PARSERS[format_of(path, text)](path, text)


def _token_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [row for path, text in zip(batch["path"], batch["text"], strict=True) if text for row in tokenize(path, text)]
        frame = pd.DataFrame(rows, columns=_COLUMNS)
        for name in ("line", "end_line", "col", "level"):
            frame[name] = frame[name].astype("Int32")
        yield frame


def token_table(documents: DataFrame) -> DataFrame:
    """Token rows of ``documents`` (path, text)."""
    return documents.select("path", "text").where("path is not null and text is not null").mapInPandas(_token_batches, SCHEMA)
