"""Pages in Markdown, HTML, wiki text or LaTeX as clean text that keeps its structure.

Two operators share one reading of the ``doc_lines`` table (repeated rows folded,
lines of a page in order, one page in memory at a time):

:func:`page_structure`  one row per line and kind of structure on it, and
:func:`clean_pages`     one row per page with the text that remains.

Both walk each page once with the line grammar of its notation, which is found
from the page itself. :func:`line_blocks` is the line-block distribution: markup
stripped, lengths summed over sliding windows of lines, surge and dive points
located, the text between them kept. It measures how dense the text is around a
line, so it can tell content from wrapping but not which kind of structure a
line has; the structure therefore comes from the grammars. It reads no grammar itself:
markup of all notations is taken off by the same patterns (:func:`strip_markup`).

Defined results for odd input
-----------------------------
* null text: a blank line. Null path or line: the row is ignored.
* repeated (path, line): the row scanned last; among equals the greater text.
* a code block, comment or formula left open runs to the end of the page.
* empty pages and pages without markup: no structure, text unchanged.
* extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("heading", "item", "code", "formula", "inline")

_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*|/)?>|<![A-Za-z][^<>]*>")
_TAG_NAME = re.compile(r"</?\s*([A-Za-z][A-Za-z0-9:-]*)")
_COMMENT = re.compile(r"<!--.*?-->")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>")
#: Tags that only wrap a block (fixed values of the notation).
BLOCK_TAGS = frozenset(
    "p div ul ol li dl dt dd html head body title meta link section article header footer nav main aside blockquote center figure"
    " figcaption details summary hr table thead tbody tfoot tr td th caption colgroup col pre h1 h2 h3 h4 h5 h6 form fieldset".split()
)
_H = re.compile(r"<(h[1-6])(?:\s[^<>]*)?>", re.I)
_LI = re.compile(r"<li(?:\s[^<>]*)?>", re.I)


class _Line:
    """What one line becomes: its kinds and its clean text (None: the line goes)."""

    __slots__ = ("kinds", "text")

    def __init__(self, text: str | None = None, *kinds: str):
        self.kinds, self.text = set(kinds), text


def _mark(line: _Line, inline: bool, formula: bool) -> _Line:
    if inline:
        line.kinds.add("inline")
    if formula:
        line.kinds.add("formula")
    if line.text:
        line.text = re.sub(r"(?<=\S) {2,}(?=\S)", " ", line.text)
    return line


class _Shield:
    """Keeps parts of a line out of reach of later patterns."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, text: str) -> str:
        self.parts.append(text)
        return f"\x00{len(self.parts) - 1}\x01"

    def back(self, text: str) -> str:
        for _ in range(3):
            text, n = re.subn("\x00(\\d+)\x01", lambda m: self.parts[int(m[1])], text)
            if not n:
                break
        return text


def _strip_tags(text: str) -> tuple[str, bool]:
    """Text without tags; whether one of them was inline. Images leave their alternative text."""
    seen = False

    def gone(m: re.Match) -> str:
        nonlocal seen
        name = _TAG_NAME.match(m[0])
        if not name or name[1].lower() in BLOCK_TAGS:
            return ""
        seen = True
        alt = re.search(r"\balt\s*=\s*[\"']([^\"']*)", m[0]) if name[1].lower() == "img" else None
        return alt[1] if alt else " " if name[1].lower() == "br" else ""

    return _TAG.sub(gone, text), seen


# --- Markdown -------------------------------------------------------------------

_MD_CODE = re.compile(r"(?<![`\\])(`+)(?!`)(.+?)(?<!`)\1(?!`)")
_MD_MATH = re.compile(r"\$\$(?=\S)[^$]+\$\$|(?<![\\$\w])\$(?=[^\s$])[^$]*?(?<=[^\s\\])\$(?![\w$])|\\\(.+?\\\)|\\\[.+?\\\]")
_MD_IMAGE = re.compile(r"!\[([^\[\]]*)\](?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\[\]]*\])")
_MD_LINK = re.compile(r"(?<!\\)\[([^\[\]]+)\](?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\[\]]*\])")
_MD_NOTE = re.compile(r"\[\^[^\[\]\s]+\]")
_MD_EMPHASIS = (
    re.compile(r"(?<![*\\])(\*\*\*|\*\*)(?=[^\s*])(.+?)(?<=[^\s*])\1(?!\*)"),
    re.compile(r"(?<![*\\\w])(\*)(?=[^\s*])(.+?)(?<=[^\s*])\1(?![*\w])"),
    re.compile(r"(?<![_\\\w])(___|__|_)(?=[^\s_])(.+?)(?<=[^\s_])\1(?!\w)"),
    re.compile(r"(?<![~\\])(~~)(?=[^\s~])(.+?)(?<=[^\s~])\1(?!~)"),
)
_MD_FENCE = re.compile(r"^\s*(?:>\s*)*(?:[-*+]\s+|\d{1,9}[.)]\s+)?(`{3,}|~{3,})\s*([^`]*)$")
_MD_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
_MD_ITEM = re.compile(r"^(\s*)(?:>\s*)*([-*+]|\d{1,9}[.)])[ \t]+(\S.*)$")
_MD_RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_MD_UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_MD_DELIMITER = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_MD_DEFINITION = re.compile(r"^ {0,3}\[[^\[\]]+\]:\s*\S+")


def _md_inline(text: str) -> tuple[str, bool, bool]:
    shield, inline, formula, n = _Shield(), False, False, 0

    def code(m: re.Match) -> str:
        nonlocal inline
        inline = True
        return shield.put(m[2].strip() or m[2])

    def math(m: re.Match) -> str:
        nonlocal formula
        formula = True
        return shield.put(m[0])

    if "`" in text:
        text = _MD_CODE.sub(code, text)
    if "<!--" in text:
        text, n = _COMMENT.subn("", text)
        inline |= n > 0
    if "<" in text:
        text = _WIKI_MATH.sub(lambda m: math(re.match(r".*", f"${m[1]}$")), text)
    if "$" in text or "\\" in text:
        text = _MD_MATH.sub(math, text)
    if "<" in text:
        text, n = _AUTOLINK.subn(lambda m: shield.put(m[1]), text)
        inline |= n > 0
        text, n = _strip_tags(text)
        inline |= n
    if "[" in text:
        for pattern in (_MD_IMAGE, _MD_LINK):
            text, n = pattern.subn(lambda m: m[1], text)
            inline |= n > 0
        text, n = _MD_NOTE.subn("", text)
        inline |= n > 0
    if "*" in text or "_" in text or "~" in text:
        for pattern in _MD_EMPHASIS:
            text, n = pattern.subn(lambda m: m[2], text)
            inline |= n > 0
    if _ENTITY.search(text):
        text, inline = html.unescape(text).replace("\xa0", " "), True
    return shield.back(text), inline, formula


def _skip_to(lines: list[str], start: int, pattern: re.Pattern) -> int:
    """The line at or after ``start`` that holds ``pattern``, else the last line."""
    for n in range(start, len(lines)):
        if pattern.search(lines[n]):
            return n
    return len(lines) - 1


_END_COMMENT, _END_DOLLARS, _END_BRACKET = re.compile("-->"), re.compile(r"\$\$\s*$"), re.compile(r"\\\]\s*$")


def _front_matter(lines: list[str]) -> int:
    """How many lines the front matter takes."""
    if lines and lines[0].lstrip("\ufeff").rstrip() == "---":
        for n in range(1, len(lines)):
            if lines[n].rstrip() in ("---", "..."):
                return n + 1
    return 0


def _markdown(lines: list[str]) -> list[_Line]:
    out = [_Line() for _ in lines]
    n = _front_matter(lines)
    in_list = False
    while n < len(lines):
        line = lines[n]
        bare = line.strip()
        if not bare:
            out[n].text = ""
            n += 1
            continue
        fence = _MD_FENCE.match(line)
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            close = re.compile(rf"^\s*(?:>\s*)*{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$")
            last = n + 1
            while last < len(lines) and not close.match(lines[last]):
                last += 1
            out[n] = _Line("```" + fence[2].strip(), "code")
            if re.match(r"^\s*(?:>\s*)*(?:[-*+]|\d{1,9}[.)])\s", line):
                out[n].kinds.add("item")
            for k in range(n + 1, min(last, len(lines))):
                out[k].text = lines[k]
            if last < len(lines):
                out[last].text = "```"
            n = last + 1
            continue
        if bare.startswith("<!--") and not re.search(r"-->\s*\S", bare):
            n = _skip_to(lines, n, _END_COMMENT) + 1
            continue
        tag = re.match(r"^<(pre|script|style|table|math)\b", bare, re.I)
        if tag:
            n = _html_block(lines, n, tag[1].lower(), out)
            continue
        if bare.startswith("$$") or bare.startswith("\\["):
            pair = _END_DOLLARS if bare[0] == "$" else _END_BRACKET
            last = n if len(bare) > 2 and pair.search(bare[2:]) else _skip_to(lines, n + 1, pair)
            out[n].kinds.add("formula")
            for k in range(n, last + 1):
                out[k].text = lines[k].strip()
            n = last + 1
            continue
        if "|" in line and n + 1 < len(lines) and "-" in lines[n + 1] and "|" in lines[n + 1] and _MD_DELIMITER.match(lines[n + 1]):
            while n < len(lines) and lines[n].strip() and "|" in lines[n]:
                out[n].text = None if _MD_DELIMITER.match(lines[n]) and "-" in lines[n] else lines[n].strip()
                n += 1
            continue
        indent = len(line) - len(line.lstrip(" ")) if "\t" not in line[:4] else 4
        if indent >= 4 and not in_list and (n == 0 or not lines[n - 1].strip()):
            out[n].kinds.add("code")
            last = n
            while last < len(lines) and (not lines[last].strip() or lines[last].startswith(("    ", "\t"))):
                last += 1
            while not lines[last - 1].strip():
                last -= 1
            for k in range(n, last):
                out[k].text = lines[k]
            n = last
            continue
        head = _MD_ATX.match(line)
        html_head = _H.search(bare) if bare.lower().startswith("<h") else None
        item = None if _MD_RULE.match(line) else _MD_ITEM.match(line)
        if _MD_DEFINITION.match(line):
            pass
        elif head or html_head:
            text, inline, formula = _md_inline(head[2] if head else bare)
            level = len(head[1]) if head else int(html_head[1][1])
            out[n] = _mark(_Line("#" * level + " " + text.strip(), "heading"), inline, formula)
            in_list = False
        elif item:
            text, inline, formula = _md_inline(item[3])
            mark = item[2] if item[2][0].isdigit() else "-"
            out[n] = _mark(_Line(f"{item[1]}{mark} {text.strip()}", "item"), inline, formula)
            in_list = True
        elif _MD_RULE.match(line) or _MD_UNDERLINE.match(line):
            pass
        else:
            text, inline, formula = _md_inline(re.sub(r"^\s*(?:>\s*)+", "", line))
            out[n] = _mark(_Line(text.strip()), inline, formula)
            if _LI.search(line):
                out[n].kinds.add("item")
            if indent == 0 and (n == 0 or not lines[n - 1].strip()):
                in_list = False
            below = lines[n + 1] if n + 1 < len(lines) else ""
            if _MD_UNDERLINE.match(below) and not re.match(r"^ {0,3}-$", below) and text.strip() and (indent == 0 or not in_list):
                out[n].kinds.add("heading")
                out[n].text = ("# " if "=" in below else "## ") + text.strip()
                n += 1
            open_comment = line.rfind("<!--")
            if open_comment > line.rfind("-->"):
                n = _skip_to(lines, n + 1, _END_COMMENT)
        n += 1
    return out


# --- HTML -----------------------------------------------------------------------


def _html_block(lines: list[str], n: int, tag: str, out: list[_Line]) -> int:
    """A block whose content is not running text; the line after it."""
    end = re.compile(rf"</{tag}\s*>", re.I)
    last = _skip_to(lines, n, end)
    if tag == "pre":
        out[n].kinds.add("code")
        for k in range(n, last + 1):
            text = html.unescape(_TAG.sub("", lines[k]))
            out[k].text = text if text.strip() or n < k < last else None
        out[n].text = "```" + ("\n" + out[n].text if out[n].text else "")
        out[last].text = (out[last].text + "\n" if out[last].text else "") + "```"
    elif tag == "math":
        out[n].kinds.add("formula")
        for k in range(n, last + 1):
            out[k].text = html.unescape(_TAG.sub("", lines[k])).strip() or None
        out[n].text = "$$" + ("\n" + out[n].text if out[n].text else "")
        out[last].text = (out[last].text + "\n" if out[last].text else "") + "$$"
    elif tag == "table":
        for k in range(n, last + 1):
            cells = re.sub(r"</t[dh]\s*>", " | ", lines[k], flags=re.I)
            out[k].text = html.unescape(_TAG.sub("", cells)).strip(" |") or None
    return last + 1


def _html_inline(text: str) -> tuple[str, bool, bool]:
    shield = _Shield()
    text, formulas = _WIKI_MATH.subn(lambda m: shield.put(f"${html.unescape(m[1])}$"), text)
    text, comments = _COMMENT.subn("", text)
    text, tags = _strip_tags(text)
    entities = _ENTITY.search(text) is not None
    return shield.back(html.unescape(text).replace("\xa0", " ")), tags or comments > 0 or entities, formulas > 0


def _html(lines: list[str]) -> list[_Line]:
    out = [_Line() for _ in lines]
    n = _front_matter(lines)
    while n < len(lines):
        line = lines[n]
        bare = line.strip()
        if not bare:
            out[n].text = ""
            n += 1
            continue
        if bare.startswith("<!--") and not re.search(r"-->\s*\S", bare):
            n = _skip_to(lines, n, _END_COMMENT) + 1
            continue
        block = re.match(r"^(?:<(?:div|center|figure|section)\b[^<>]*>\s*)*<(pre|script|style|table|math)\b", bare, re.I)
        whole = block and (block[1].lower() != "math" or not re.search(r"</math\s*>", bare, re.I) or re.match(r"^<math\b[^<>]*>.*</math\s*>$", bare, re.I))
        if whole:
            n = _html_block(lines, n, block[1].lower(), out)
            continue
        text, inline, formula = _html_inline(line)
        text = text.strip()
        only_tags = not text and not formula
        out[n] = _mark(_Line(text or None), inline and not (only_tags and not re.search(r"<(?:img|a|code)\b", line, re.I)), formula)
        head = _H.search(line)
        if head and text:
            out[n].kinds.add("heading")
            out[n].text = "#" * int(head[1][1]) + " " + text
        elif _LI.search(line):
            out[n].kinds.add("item")
            out[n].text = "- " + text
        open_comment = line.rfind("<!--")
        if open_comment > line.rfind("-->"):
            n = _skip_to(lines, n + 1, _END_COMMENT)
        n += 1
    return out


# --- wiki text --------------------------------------------------------------------

_WIKI_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\s].*?)[ \t]*\1[ \t]*$")
_WIKI_ITEM = re.compile(r"^([*#]+)[ \t]*(\S.*)$")
_WIKI_CODE = re.compile(r"^<(pre|source|syntaxhighlight|code|nowiki)\b[^<>]*>", re.I)


_WIKI_MATH = re.compile(r"<math\b[^<>]*>(.*?)</math\s*>", re.I)
_WIKI_SHIELDED = (re.compile(r"<nowiki>(.*?)</nowiki>", re.I), re.compile(r"<code\b[^<>]*>(.*?)</code>", re.I))
#: Inline marks with the group that stays (0: none) and a text that every one of them holds.
_WIKI_PARTS = tuple(
    (re.compile(pattern, re.I), keep, mark)
    for pattern, keep, mark in (
        (r"<!--.*?-->", 0, "<!--"), (r"<ref\b[^<>]*/>", 0, "<"), (r"<ref\b[^<>]*>.*?</ref>", 0, "<"),
        (r"\[\[(?:File|Image|Datei|Archivo)\s*:[^\[\]|]*(?:\|[^\[\]|]*)*\|([^\[\]|]*)\]\]", 1, "[["), (r"\[\[(?:File|Image)\s*:[^\[\]]*\]\]", 0, "[["),
        (r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", 1, "[["), (r"\[\[([^\[\]|]+)\]\]", 1, "[["),
        (r"\[(?:https?|ftp|mailto):\S+\s+([^\[\]]+)\]", 1, "["), (r"\[((?:https?|ftp):[^\s\[\]]+)\]", 1, "["),
        (r"\{\{[^{}|]*\|([^{}|]*)\}\}", 1, "{{"), (r"\{\{[^{}]*\}\}", 0, "{{"),
        (r"'''''(.+?)'''''", 1, "''"), (r"'''(.+?)'''", 1, "''"), (r"''(.+?)''", 1, "''"),
    )
)


def _wiki_inline(text: str) -> tuple[str, bool, bool]:
    shield, inline, formulas = _Shield(), False, 0
    if "<" in text:
        text, formulas = _WIKI_MATH.subn(lambda m: shield.put(f"${html.unescape(m[1])}$"), text)
        for pattern in _WIKI_SHIELDED:
            text, n = pattern.subn(lambda m: shield.put(m[1]), text)
            inline |= n > 0
    for pattern, keep, mark in _WIKI_PARTS:
        if mark in text:
            text, n = pattern.subn(r"\1" if keep else "", text)
            inline |= n > 0
    text, tags = _strip_tags(text)
    entities = _ENTITY.search(text) is not None
    return shield.back(html.unescape(text).replace("\xa0", " ")), inline or tags or entities, formulas > 0


def _wiki(lines: list[str]) -> list[_Line]:
    out = [_Line() for _ in lines]
    n = _front_matter(lines)
    while n < len(lines):
        line = lines[n]
        bare = line.strip()
        if not bare:
            out[n].text = ""
            n += 1
            continue
        if bare.startswith("<!--") and not re.search(r"-->\s*\S", bare):
            n = _skip_to(lines, n, _END_COMMENT) + 1
            continue
        code = _WIKI_CODE.match(bare)
        if code and (code[1].lower() not in ("code", "nowiki") or not re.search(rf"</{code[1]}\s*>", bare, re.I)):
            last = _skip_to(lines, n, re.compile(rf"</{code[1]}\s*>", re.I))
            out[n].kinds.add("code")
            for k in range(n, last + 1):
                out[k].text = lines[k]
            out[n].text, out[last].text = "```", "```"
            n = last + 1
            continue
        if re.match(r"^<math\b", bare, re.I) and (not re.search(r"</math\s*>", bare, re.I) or re.match(r"^<math\b[^<>]*>.*</math\s*>$", bare, re.I)):
            n = _html_block(lines, n, "math", out)
            continue
        if bare.startswith("{|"):
            last = _skip_to(lines, n, re.compile(r"^\s*\|\}"))
            for k in range(n + 1, last):
                out[k].text = re.sub(r"^\s*[|!][-+}]?\s*", "", lines[k]).strip() or None
            n = last + 1
            continue
        if re.match(r"^<table\b", bare, re.I):
            n = _html_block(lines, n, "table", out)
            continue
        head, item = _WIKI_HEAD.match(line), _WIKI_ITEM.match(line)
        html_head = _H.search(bare) if bare.lower().startswith("<h") else None
        if head or html_head:
            text, inline, formula = _wiki_inline(head[2] if head else bare)
            level = len(head[1]) if head else int(html_head[1][1])
            out[n] = _mark(_Line("#" * level + " " + text.strip(), "heading"), inline, formula)
        elif item:
            text, inline, formula = _wiki_inline(item[2])
            out[n] = _mark(_Line("  " * (len(item[1]) - 1) + "- " + text.strip(), "item"), inline, formula)
        elif re.match(r"^-{4,}\s*$", bare) or re.match(r"^(?:__[A-Z]+__\s*)+$", bare):
            pass
        else:
            text, inline, formula = _wiki_inline(re.sub(r"^[:;]+\s*", "", line))
            out[n] = _mark(_Line(text.strip() or None), inline, formula)
            if _LI.search(line):
                out[n].kinds.add("item")
            if line.rfind("<!--") > line.rfind("-->"):
                n = _skip_to(lines, n + 1, _END_COMMENT)
        n += 1
    return out


# --- LaTeX --------------------------------------------------------------------------

_TEX_HEAD = re.compile(r"^\s*\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title)\*?\s*(?:\[[^\]]*\])?\{(.*)\}\s*(?:\\label\{[^{}]*\})?\s*$")
_TEX_LEVEL = {"title": 1, "part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
_TEX_CODE = re.compile(r"^\s*\\begin\{(verbatim\*?|Verbatim|lstlisting|minted|alltt)\}")
_TEX_DISPLAY = re.compile(r"^\s*\\begin\{((?:equation|align|alignat|gather|multline|displaymath|eqnarray|flalign|math)\*?)\}")
_TEX_TABLE = re.compile(r"^\s*\\begin\{(tabular\*?|tabularx|longtable|table\*?)\}")
_TEX_WRAP = re.compile(
    r"^\s*\\(?:begin|end|documentclass|usepackage|label|maketitle|tableofcontents|centering|noindent|newpage|clearpage|author|date|bibliography(?:style)?|input|include)\b"
    r"(?:\s*(?:\[[^\]]*\]|\{[^{}]*\}))*\s*$"
)
_TEX_MATH = re.compile(r"\\\(.+?\\\)|\$\$.+?\$\$|(?<!\\)\$(?!\$)(?:[^$\\]|\\.)+\$|\\\[.+?\\\]")


def _tex_inline(text: str) -> tuple[str, bool, bool]:
    shield, inline = _Shield(), False
    text, n = re.subn(r"\\verb\*?([^\w\s])(.*?)\1", lambda m: shield.put(m[2]), text)
    inline |= n > 0
    text, formulas = _TEX_MATH.subn(lambda m: shield.put("$" + re.sub(r"^(?:\\[(\[]|\$\$?)|(?:\\[)\]]|\$\$?)$", "", m[0]) + "$"), text)
    cut = re.search(r"(?<!\\)%", text)
    if cut and text[: cut.start()].strip():
        text, inline = text[: cut.start()], True
    elif cut:
        text = ""
    for _ in range(4):
        before = text
        for pattern, repl in (
            (r"~?\\(?:cite[a-z]*|ref|eqref|pageref|label|index|autoref)\*?(?:\[[^\]]*\])*\{[^{}]*\}", ""),
            (r"\\footnote\{[^{}]*\}", ""),
            (r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1"),
            (r"\\url\{([^{}]*)\}", r"\1"),
            (r"\\includegraphics(?:\[[^\]]*\])?\{[^{}]*\}", ""),
            (r"\{\\(?:it|bf|tt|em|sc|sl|rm|sf|itshape|bfseries|ttfamily|small|large)\b\s*([^{}]*)\}", r"\1"),
            (r"\\[A-Za-z]+\*?\{([^{}]*)\}", r"\1"),
        ):
            text, n = re.subn(pattern, repl, text)
            inline |= n > 0
        if text == before:
            break
    text = re.sub(r"\\([%&#_{}$])", r"\1", text.replace("~", " "))
    return shield.back(text), inline, formulas > 0


def _latex(lines: list[str]) -> list[_Line]:
    out = [_Line() for _ in lines]
    n = _front_matter(lines)
    while n < len(lines):
        line = lines[n]
        bare = line.strip()
        if not bare:
            out[n].text = ""
            n += 1
            continue
        if bare.startswith("%"):
            n += 1
            continue
        block = _TEX_CODE.match(line) or _TEX_DISPLAY.match(line) or _TEX_TABLE.match(line) or re.match(r"^\s*\\begin\{(comment)\}", line)
        if block:
            last = _skip_to(lines, n, re.compile(r"\\end\{" + re.escape(block[1]) + r"\}"))
            kind = "code" if _TEX_CODE.match(line) else "formula" if _TEX_DISPLAY.match(line) else None
            for k in range(n + 1, last):
                out[k].text = lines[k] if kind == "code" else lines[k].strip() if block[1] != "comment" else None
            if kind:
                out[n].kinds.add(kind)
                out[n].text = out[last].text = "```" if kind == "code" else "$$"
            n = last + 1
            continue
        opener = "\\]" if bare.startswith("\\[") else "$$" if bare.startswith("$$") else None
        if opener:
            closed = opener in bare[2:]
            last = n if closed else _skip_to(lines, n + 1, re.compile(re.escape(opener)))
            out[n].kinds.add("formula")
            for k in range(n, last + 1):
                out[k].text = lines[k].strip().replace("\\[", "$$").replace("\\]", "$$")
            n = last + 1
            continue
        head = _TEX_HEAD.match(line)
        item = re.match(r"^(\s*)\\item\b\s*(?:\[([^\]]*)\]\s*)?(.*)$", line)
        if head:
            text, inline, formula = _tex_inline(head[2])
            out[n] = _mark(_Line("#" * _TEX_LEVEL[head[1]] + " " + text.strip(), "heading"), inline, formula)
        elif item:
            text, inline, formula = _tex_inline(((item[2] or "") + " " + item[3]).strip())
            out[n] = _mark(_Line("- " + text.strip(), "item"), inline, formula)
        elif _TEX_WRAP.match(line):
            pass
        else:
            text, inline, formula = _tex_inline(line)
            out[n] = _mark(_Line(text.strip() or None), inline, formula)
        n += 1
    return out


# --- the page as a whole ----------------------------------------------------------------

_PARSERS = {"markdown": _markdown, "html": _html, "wiki": _wiki, "latex": _latex}
_OPENERS = (
    (re.compile(r"^\s*(`{3,}|~{3,})[^`]*$"), None, "markdown", 12),
    (re.compile(r"^\s*<(source|syntaxhighlight)\b", re.I), "</{}", "wiki", 12),
    (re.compile(r"^\s*<(pre)\b", re.I), "</{}", None, 0),
    (re.compile(r"^\s*\\begin\{(verbatim\*?|lstlisting|minted|Verbatim)\}"), "\\end{{{}}}", "latex", 12),
    (re.compile(r"^\s*(<!--)(?!.*-->)"), "-->", None, 0),
    (re.compile(r"^\s*<(math)\b(?!.*</math)", re.I), "</{}", None, 0),
    (re.compile(r"^\s*(\$\$)\s*$"), "$$", None, 0),
)
#: What speaks for a notation outside code, and how much (fixed weights).
_SIGNS = {
    "latex": (
        (re.compile(r"^\s*\\(?:documentclass|usepackage|begin\{document|end\{document)"), 25),
        (re.compile(r"^\s*\\(?:(?:sub)*section|chapter|paragraph)\*?\{"), 8),
        (re.compile(r"^\s*\\(?:begin|end)\{[a-zA-Z]+\*?\}"), 6),
        (re.compile(r"^\s*\\item\b"), 4),
        (re.compile(r"\\(?:emph|textbf|textit|texttt|underline|href|cite|ref|footnote)\{|\{\\(?:it|bf|tt)\b"), 3),
    ),
    "html": (
        (re.compile(r"^\s*<(?:!doctype|html|/html|body|/body|head)\b", re.I), 25),
        (re.compile(r"^\s*(?:<div[^<>]*>)?<p[\s>]", re.I), 5),
        (re.compile(r"^\s*</?(?:li|ul|ol)[\s>]", re.I), 5),
        (re.compile(r"</p>\s*$", re.I), 3),
        (re.compile(r"^\s*<h[1-6][\s>]", re.I), 2),
        (re.compile(r"^\s*<pre\b", re.I), 2),
    ),
    "wiki": (
        (re.compile(r"^(={1,6})[^=].*\1\s*$"), 6),
        (re.compile(r"<(?:ref|nowiki)\b|\[\[(?:File|Image|Category):", re.I), 6),
        (re.compile(r"\[\[[^\[\]]+\]\]|'''[^']+'''|''[^']+''|\{\{[^{}]+\}\}|\[https?://\S+ [^\]]+\]"), 3),
        (re.compile(r"^[*#]+[^\s*#]"), 2),
        (re.compile(r"^\{\||^\|\}"), 6),
        (re.compile(r"^\s*<pre\b|<math\b", re.I), 1),
    ),
    "markdown": (
        (re.compile(r"^ {0,3}#{1,6}[ \t]+\S"), 3),
        (re.compile(r"!?\[[^\[\]]+\]\([^()\s]+\)|\[[^\[\]]+\]\[[^\[\]]+\]|\[\^\w+\]"), 4),
        (re.compile(r"(?<![\w*])\*{1,3}[^\s*](?:[^*]*[^\s*])?\*{1,3}(?![\w*])|~~[^~]+~~|(?<![\w`])`[^`\s][^`]*`|(?<!\w)_{1,2}[^\s_][^_]*_{1,2}(?!\w)"), 2),
        (re.compile(r"^\s*(?:[-+*]|\d{1,9}[.)])[ \t]+\S"), 2),
        (re.compile(r"^\|?\s*:?-{2,}:?\s*\|"), 6),
        (re.compile(r"<https?://[^\s<>]+>"), 3),
        (re.compile(r"^\s*</?(?:h[1-6]|div|details|summary|img|center|kbd|b|sup|br)\b", re.I), 1),
        (re.compile(r"(?<![\\$\w])\$[^\s$][^$]*[^\s$]\$(?![\w$])"), 2),
        (re.compile(r"<(?:b|kbd|sup|sub|br|a|img|i|span)\b[^<>]*>|<!--.*?-->|&[a-z]+;|&#\d+;", re.I), 1),
    ),
}
_OPENING = re.compile(r"\s*[`~<\\$]")
#: A mark that every sign of a notation has.
_SIGN_MARKS = {"latex": re.compile(r"\\"), "html": re.compile("<"), "wiki": re.compile(r"[=<\['{*#|]"), "markdown": re.compile(r"[#\[*_`~+|<$&-]|^\s*\d")}
_HINTS = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "wiki": "wiki", "mediawiki": "wiki", "tex": "latex"}


def notation_of(lines: list[str], path: str = "") -> str | None:
    """The notation of a page, from its lines outside code; the file extension only breaks ties."""
    score = dict.fromkeys(_SIGNS, 0.0)
    framed = raw = False  # paragraphs or lists in tags, paragraphs without: HTML headings alone also stand in Markdown
    n = _front_matter(lines)
    if n:
        score["markdown"] += 4
    while n < len(lines):
        line = lines[n]
        for pattern, end, kind, weight in _OPENERS if _OPENING.match(line) else ():
            m = pattern.match(line)
            if m:
                if kind:
                    score[kind] += weight
                if end is None:
                    close = re.compile(rf"^\s*{re.escape(m[1][0])}{{{len(m[1])},}}\s*$")
                else:
                    close = re.compile(re.escape(end.format(m[1])), re.I)
                same = end is not None and close.search(line[m.end() :])
                n = n if same else _skip_to(lines, n + 1, close)
                break
        else:
            for kind, signs in _SIGNS.items():
                if not _SIGN_MARKS[kind].search(line):
                    continue
                for pattern, weight in signs:
                    if pattern.search(line):
                        score[kind] += weight
                        framed |= kind == "html" and weight >= 3
            raw |= bool(line.strip()) and not line.lstrip().startswith("<") and (n == 0 or not lines[n - 1].strip())
            if n and _MD_UNDERLINE.match(line) and len(line.strip()) > 2 and lines[n - 1].strip():
                score["markdown"] += 5
        n += 1
    if raw and not framed:
        score["markdown"], score["html"] = score["markdown"] + score["html"], 0.0
    if max(score.values()) <= 0:
        return None
    hint = _HINTS.get(path.rsplit(".", 1)[-1].lower())
    return max(score, key=lambda k: (score[k], k == hint))


def parse_page(lines: list[str], path: str = "") -> tuple[str | None, list[_Line]]:
    lines = [line.rstrip("\r\n") for line in lines]
    if lines:
        lines[0] = lines[0].lstrip("\ufeff")
    notation = notation_of(lines, path)
    return notation, _PARSERS[notation](lines) if notation else [_Line(line) for line in lines]


def clean_text(parsed: list[_Line]) -> str:
    """The remaining lines, runs of blank ones folded."""
    text = "\n".join(line.text for line in parsed if line.text is not None)
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n")


#: Markup of any notation, taken off without knowing which it is: comments, tags, commands, marks at a line's start and around words.
_STRIP = tuple(
    (re.compile(pattern, re.I), by)
    for pattern, by in (
        (r"<!--.*?-->|(?<!\\)%.*$", ""),
        (r"</?[a-z][^<>]*>|<![a-z][^<>]*>", ""),
        (r"\\(?:begin|end|label|ref|cite[a-z]*|documentclass|usepackage|includegraphics|input|bibliography\w*)\*?(?:\[[^\]]*\])*(?:\{[^{}]*\})*", ""),
        (r"\\[a-z]+\*?(?:\[[^\]]*\])*", ""),
        (r"!?\[\[?([^\[\]|]*?)(?:\|([^\[\]]*))?\]\]?(?:\([^()]*\))?", r"\1\2"),
        (r"\{\{[^{}]*\}\}|&(?:#\w+|[a-z]+);", ""),
        (r"^\s*(?:[-*+>|#=:;!]+|\d+[.)])\s*|[\s|=#-]+$", ""),
        (r"[*_`~{}|]+|'{2,}|\$", ""),
    )
)


def strip_markup(line: str) -> str:
    """A line's text without markup, whatever its notation."""
    for pattern, by in _STRIP:
        line = pattern.sub(by, line)
    return " ".join(line.split())


def line_blocks(lengths: list[int], width: int = 3, share: float = 0.5, follow: int = 2) -> list[bool]:
    """Which lines lie between a surge and the next dive of the line-block distribution.

    ``lengths`` are text lengths without markup; the block of a line is the sum of ``width`` lines from it on.
    The distribution surges at a line with text whose block exceeds ``share`` of the mean block and whose next
    ``follow`` blocks are not empty (the end of the page counts as such), and dives where a block falls to a
    tenth of the mean, or a line without text follows into a block below ``share`` of it.
    """
    n = len(lengths)
    sums = [sum(lengths[i : i + width]) for i in range(n)]
    full = [s for s in sums if s]
    mean = sum(full) / len(full) if full else 0.0
    keep, inside = [False] * n, False
    for i in range(n):
        if not inside:
            inside = lengths[i] > 0 and sums[i] > share * mean and all(sums[k] for k in range(i + 1, min(n, i + 1 + follow)))
        elif sums[i] <= 0.1 * mean or (not lengths[i] and sums[i] <= share * mean):
            inside = False
        keep[i] = inside
    return keep


# --- Spark --------------------------------------------------------------------------------


def ordered_lines(doc_lines: DataFrame) -> DataFrame:
    """Repeated rows folded, each page whole in one partition and in order.

    The fold is a partial aggregation on (path, line); rescans of a hot page
    shrink to its lines before anything is moved by page.
    """
    newest = F.max_by(F.coalesce("text", F.lit("")), F.struct(F.col("scanned_at").isNotNull(), "scanned_at", F.coalesce("text", F.lit(""))))
    folded = doc_lines.where("path is not null and line is not null").groupBy("path", "line").agg(newest.alias("text"))
    return folded.repartition("path").sortWithinPartitions("path", "line")


def _pages(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[str, list[int], list[str]]]:
    """Pages of a sorted partition; only the page being gathered is held."""
    path, numbers, texts = None, [], []
    for batch in batches:
        for p, n, t in zip(batch["path"], batch["line"], batch["text"], strict=True):
            if p != path:
                if path is not None:
                    yield path, numbers, texts
                path, numbers, texts = p, [], []
            numbers.append(n)
            texts.append(t)
    if path is not None:
        yield path, numbers, texts


def _structure_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for path, numbers, texts in _pages(batches):
        for number, line in zip(numbers, parse_page(texts, path)[1], strict=True):
            rows.extend((path, number, kind) for kind in KINDS if kind in line.kinds)
        if len(rows) > 20_000:
            yield pd.DataFrame(rows, columns=["path", "line", "kind"])
            rows = []
    yield pd.DataFrame(rows, columns=["path", "line", "kind"])


def _clean_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for path, _, texts in _pages(batches):
        notation, parsed = parse_page(texts, path)
        yield pd.DataFrame([(path, notation or "none", clean_text(parsed))], columns=["path", "notation", "text"])


def _block_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for path, numbers, texts in _pages(batches):
        bare = [strip_markup(t.lstrip("\ufeff")) for t in texts]
        rows = [(path, n, text) for n, text, k in zip(numbers, bare, line_blocks([len(t) for t in bare]), strict=True) if k]
        yield pd.DataFrame(rows, columns=["path", "line", "text"])


def page_structure(doc_lines: DataFrame) -> DataFrame:
    """(path, line, kind) of every line with structure; kinds as in :data:`KINDS`."""
    return ordered_lines(doc_lines).mapInPandas(_structure_batches, "path string, line int, kind string")


def clean_pages(doc_lines: DataFrame) -> DataFrame:
    """(path, notation, text): headings as ``#``, items as ``-`` or numbers, code in fences, formulas in dollars."""
    return ordered_lines(doc_lines).mapInPandas(_clean_batches, "path string, notation string, text string")


def block_text(doc_lines: DataFrame) -> DataFrame:
    """(path, line, text) of the lines that the line-block distribution keeps."""
    return ordered_lines(doc_lines).mapInPandas(_block_batches, "path string, line int, text string")
