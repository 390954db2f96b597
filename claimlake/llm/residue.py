"""Template residue, filler text, error pages and script notices in documents.

Every document is read once and gives evidence of two kinds.

Its own text, by detectors:

placeholders   unfilled fields in the forms of common template languages;
filler         runs of sample words and stock filler sentences;
messages       sentences that are an error page or ask for scripts.

What other documents say about it, by comparison:

terms          the words of the address slug, of the title and of the body, compared
               in pairs: a response carries the address of the page it replaces, but
               speaks of something else;
responses      a sentence (numbers, identifiers and paths removed) that stands on several
               pages of several hosts, pages that say little else, is a response sentence.
               It is told by its company alone, in any language: sentences that also stand
               in full documents, and those of copies of one document, are not.

:func:`response_scores` adds the second kind and the placeholders up to one score for all
documents; :func:`residue_evidence` adds the other detectors, which also see residue in
a part of a page that is otherwise content. Code (fenced, inline, ``<pre>``) and quoted
text is not content of its own, and a sentence that talks about placeholders or filler
names them without being residue.

Defined results for odd input
-----------------------------
* null or blank text, null doc_id: no row. Null source: a host of its own name. Null path: no address to compare.
* repeated rows: one row per doc_id. Texts of any length are read whole.
* empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.session import materialise, settled

#: Words that name a field to be filled in (fixed values).
FIELD_WORDS = (
    "name title author date year version company organization organisation contact email mail phone address url link license licence description summary"
    " project product repo repository module package path command user username customer team city country logo number text content topic subject feature"
).split()
_FIELD = "(?:" + "|".join(FIELD_WORDS) + ")"
_NAME = r"[.$]?[A-Za-z][\w.-]*(?:[ _.-]\w+|\[[\"'\w]+\])*"
_UPPER = r"[A-Z][A-Z0-9]*(?:[ _.-][A-Z0-9]+)*"
#: Forms that only template languages use: any name is a field.
_TEMPLATE = re.compile(
    rf"\{{\{{[-#/^&>!~]?\s*{_NAME}(?:\s*\|[^{{}}\n]*)?\s*[-~]?\}}\}}|\{{%-?\s*{_NAME}[^%\n]{{0,60}}-?%\}}|<%[=-]?\s*@?{_NAME}(?:\(\))?\s*-?%>|@@{_NAME}@@|%%{_NAME}%%|#\{{\s*{_NAME}\s*\}}"
    rf"|<<\s*{_NAME}\s*>>|\[\[\s*{_UPPER}\s*\]\]|<insert\b[^<>\n]{{1,60}}>|\[insert\b[^\[\]\n]{{1,60}}\](?!\()",
    re.I,
)
_UPPER_DOUBLE = re.compile(rf"^\[\[\s*{_UPPER}\s*\]\]$")
#: Forms with other uses: the name must be written as a field.
_AMBIGUOUS = re.compile(
    rf"(?<![\w/\\$])\$\{{\s*({_UPPER})\s*\}}(?![/\w])|(?<![\w$])\$({_UPPER})\$(?!\w)|(?<![\w/{{$#%])\{{\s*({_UPPER})\s*\}}(?![\w/}}-])"
    rf"|(?<!\w)__({_UPPER})__(?!\w)|(?<![\w%])%({_UPPER})%(?!\w)|(?<![\w\]\[!])\[\s*((?:your|my|the|our)[ _]+[^\[\]\n]{{1,40}}|[^\[\]\n]{{1,40}}[ _]here|{_UPPER})\s*\](?![\w(\[:])"
    rf"|(?<=[Dd]ear )<\s*((?i:{_FIELD}))\s*>"
    rf"|<\s*((?:your|my|our|the)[ _-]+[\w -]{{1,40}}|[\w -]{{1,40}}[ _-]here|{_UPPER}[_ -]{_UPPER})\s*>",
)
_AMBIGUOUS_LOWER = re.compile(r"(?<![\w\]\[!])\[\s*((?:your|insert|enter)\s[^\[\]\n]{1,40}|[^\[\]\n]{1,40}\shere)\s*\](?![\w(\[:])", re.I)
_FIELD_IN = re.compile(rf"(?<![A-Za-z]){_FIELD}s?(?![A-Za-z])", re.I)
#: Words of sentences about placeholders and filler.
_TALK = re.compile(
    r"\b(?:placeholders?|templates?|syntax|pattern|literal(?:ly)?|variables?|notation|such as|for example|e\.g\.|called|named|written|escape[ds]?|quote[ds]?|expands?|substitut\w+|format string|left in|(?:is|are) reported"
    r"|Platzhalter|Vorlage|plantillas?|marcador(?:es)?)\b|占位符|模板",
    re.I,
)

#: Words of the stock Latin filler (fixed values).
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud"
    " exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint"
    " occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
    " perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae"
    " vitae dicta explicabo nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt".split()
)
_LATIN_STRONG = LATIN - frozenset("do in ad id non est sit ut et ex ea qui sed ipsum dolor magna eu quis minim labore commodo enim error ab aut rem magni quasi ratione iste".split())
#: Words typed where text was still to come (fixed values).
_KEYSTROKES = frozenset("x xx xxx xxxx xxxxx xxxxxx asdf asdfg asdfgh qwer qwert qwerty foo bar baz qux quux test testing blah bla yadda tbd tba tk lipsum".split())
#: Words of sentences that say no more than that text will stand here (fixed values).
_TEXT_WORDS = frozenset("text texts more even some sample dummy test another other here and or a placeholder content words lines still".split())
#: Stock sentences that stand for text still to come, one alternative each.
_FILLER_SENTENCE = re.compile(
    r"^(?:this is |here is |hier steht |esto es |)(?:(?:a |an |some |ein |un )?(?:placeholder|sample|dummy|example|filler|beispiel|blind|platzhalter)[ -]?(?:copy|text|content|paragraph|texte?)\b[\s.,!]*)+(?:do not publish)?[.!]*$"
    r"|^(?:your|some|more|the) (?:text|content|description|title|copy) (?:goes|comes|belongs|will go|to go) here\b"
    r"|^(?:replace|fill in|rewrite|delete) this (?:paragraph|text|section|sentence)\b"
    r"|^(?:insert|add|enter|write|type|put) (?:your |a |some |the )?(?:description|text|content|title|summary|copy|details?|something) here\b"
    r"|^(?:add|write|insert|put|give|enter|provide|describe) (?:a |an |the |your |some )?(?:short |brief |one-line |longer )?(?:summary|description|overview|introduction|paragraph|explanation|example|text|title|tagline)s?\b[^.!?]{0,60}\bhere\b"
    r"|^(?:content|text|description|documentation|details?|more|page|section)?[ ,]*(?:is |are |will be )?coming soon[.!…]*$"
    r"|^(?:to be (?:written|added|done|completed|announced)|under construction|work in progress|nothing here yet)[.!…]*$"
    r"|^(?:(?:blah|bla)[\s,]+){2,}|(?:[\s,]+(?:blah|bla)){2,}[.!]*$"
    r"|^(?:texto de (?:ejemplo|relleno)|contenido próximamente|inserte (?:aquí )?(?:el |la |su )?\w+|hier (?:steht|folgt|kommt) (?:ihr |der |ein )?(?:text|inhalt)|(?:text|inhalt) folgt)\b"
    r"|^(?:此处(?:填写|插入|输入)|在此(?:输入|填写|插入)|这里(?:填写|插入|输入)|示例文本|占位文本|占位内容|内容即将|敬请期待|待补充|即将推出)",
    re.I,
)

_REASONS = (
    r"bad request|unauthori[sz]ed|payment required|forbidden|(?:page |file )?not found|method not allowed|not acceptable|request time-?out|conflict|gone|length required|payload too large"
    r"|unsupported media type|too many requests|internal server error|server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|access denied|permission denied"
)
#: Sentences of error pages, from their first word on.
_ERROR = re.compile(
    r"^(?:http(?:/\d(?:\.\d)?)? )?(?:status(?: code)? |error(?: code)?:? ?)#?[45]\d\d\b"
    r"|^#?[45]\d\d ?[-–—:|]+ ?[^\W\d]"
    r"|^[45]\d\d (?:" + _REASONS + r")\b(?! (?:when|if|while|unless|for|to|is|are|means|as)\b)"
    r"|^(?!gone|conflict|not implemented|not acceptable)(?:" + _REASONS + r")[.!]*$"
    r"|^(?:error|fehler|warning|错误|fatal error|exception): ?(?:the |this |your |you |a |an )?(?:" + _REASONS + r"|request|connection|server|page|resource|access|permission|something|could not|unable|failed|cannot|database|session|authentication|rate limit\w*|upstream|maintenance|invalid|unexpected)\b"
    r"|^(?:(?:oops|whoops|uh[- ]oh|sorry|we(?:'|’)?re (?:very )?sorry|we are (?:very )?sorry|error|hmm)[!.,:;… ]+(?:but )?)*(?:"
    r"(?:the|this|that|your) (?:requested )?(?:page|resource|file|url|address|site|link|document)(?: you (?:are looking for|requested|were looking for|tried to (?:open|reach)|asked for))? (?:could ?n[o']t be found|cannot be (?:found|displayed|shown|loaded)|can't be (?:found|reached)|was not found|does(?: not|n't) exist|no longer exists|is not available|is (?:currently |temporarily )?unavailable|has been (?:removed|moved|deleted)|may have (?:moved|been (?:moved|removed)))"
    r"|(?:page|resource|file) not found|we (?:could ?n[o']t|cannot|can't) find (?:the|that|this) page|there is nothing here"
    r"|something went (?:terribly |badly )?wrong|an? (?:unexpected |unknown |internal )?error (?:has )?occurr?ed"
    r"|(?:the|our) (?:upstream |web |origin )?(?:server|service|site|backend|gateway) (?:did not (?:answer|respond)|is (?:temporarily |currently )?(?:unavailable|down|overloaded|not available)|met an? (?:unexpected|error)|encountered an?|returned an? (?:invalid|bad|error|unexpected)|refused|could not (?:complete|process)|failed|timed out)"
    r"|(?:you|your (?:ip|account|client))(?: (?:do|does) not| don't| are not| is not) (?:have (?:the )?(?:permission|access|rights)|(?:allowed|permitted|authori[sz]ed))"
    r"|(?:you|your (?:ip|account|client|address)) (?:have|has) been (?:rate[- ]limited|blocked|banned|logged out|denied)|too many requests|access (?:to this (?:page|resource) )?(?:is |was |has been )?(?:denied|forbidden|blocked)"
    r"|authentication (?:is )?(?:required|failed)|(?:you must|please) (?:log|sign) in to (?:continue|view|see|access)|your session has (?:expired|timed out|ended)"
    r"|we(?: are|'re|’re)? (?:currently |temporarily )?(?:down|offline|closed|unavailable)(?: for (?:scheduled |planned )?maintenance)?|(?:the )?(?:site|service|page) is (?:currently |temporarily )?(?:down|under|undergoing|in) (?:for )?maintenance"
    r"|this (?:site|page) (?:can(?:no|'|’)?t be reached|is not working)|service (?:temporarily )?unavailable"
    r"|die (?:angeforderte |gewünschte |aufgerufene )?seite (?:existiert nicht|wurde nicht gefunden|konnte nicht|ist nicht)|(?:die )?seite (?:wurde )?nicht gefunden|(?:der )?zugriff (?:wurde )?(?:verweigert|nicht gestattet)|der (?:dienst|server) ist (?:vorübergehend |derzeit |zurzeit )?nicht (?:verfügbar|erreichbar)|interner serverfehler|etwas ist schief ?gelaufen|ein (?:unerwarteter )?fehler ist aufgetreten|bitte melden sie sich an\b|zu viele anfragen"
    r"|(?:la )?página (?:solicitada )?no (?:se ha )?(?:encontrad|existe|está disponible|se encuentra)\w*|(?:la )?dirección solicitada ya no existe|(?:el )?acceso (?:ha sido )?(?:denegado|prohibido)|(?:el )?servicio (?:temporalmente )?no (?:está )?disponible|error interno del servidor|algo salió mal|se ha producido un error|demasiadas (?:solicitudes|peticiones)|inicie sesión para continuar"
    r"|(?:您(?:访问|请求)的)?(?:该)?页面(?:未找到|不存在|已被删除|无法(?:找到|显示|访问))|找不到(?:该)?页面|访问被(?:拒绝|禁止)|(?:您)?没有权限|(?:该)?服务(?:器)?(?:暂时|目前)?(?:不可用|无法(?:访问|使用)|繁忙|维护中|错误)|服务器内部错误|(?:系统|网站)(?:正在)?维护|请求过多|请登录后(?:重试|继续)|出错了|发生(?:未知)?错误"
    r"|(?:la )?page (?:demandée |que vous (?:cherchez|recherchez) )?(?:est introuvable|introuvable|n['’]existe (?:pas|plus)|n['’]a pas été trouvée)|accès (?:refusé|interdit)|une erreur (?:inattendue )?(?:est survenue|s['’]est produite)|(?:le )?service (?:est )?(?:temporairement )?indisponible"
    r"|(?:a )?página (?:solicitada )?não (?:foi )?(?:encontrada|existe)|acesso negado|ocorreu um erro|(?:o )?serviço (?:está )?(?:temporariamente )?indisponível|ページが見つかりません|お探しのページは|アクセスが拒否されました|エラーが発生しました"
    r"|just a moment\b[.… ]*$|checking (?:if the site connection is secure|your browser before)|verify(?:ing)? (?:that )?you are (?:a )?human|accessdenied\b|nosuch(?:key|bucket)\b"
    r")",
    re.I,
)
_SCRIPT = re.compile(
    r"^(?:(?:oops|sorry|loading|we(?:'|’)re sorry|warning|notice|attention|achtung|please note)[!.…,: ]*(?:but )?)*(?:"
    r"(?:you (?:need|have|must)|please|kindly|turn on|enable|activate|allow|to (?:use|view|see|continue|run)|in order to|it (?:looks|seems|appears)|your browser|this (?:site|page|app|application|website|document|viewer|form|content)|the (?:site|page|app|viewer|reader)|javascript|java script|scripts?|scripting|cookies|if nothing (?:appears|happens)|checking your browser|without javascript)\b[^\n]{0,120}"
    r"(?:(?:enable|turn|switch|allow|activate|require|need|support|run)\w*(?: on| to have)?[^\n]{0,60}\b(?:javascript|java script|scripts?|scripting)\b|\b(?:javascript|java script|scripts?|scripting)\b[^\n]{0,60}\b(?:disabled|blocked|required|needed|enabled|turned off|turned on|switched off|must|not (?:run|supported|available|enabled)|allowed|active)\b|before you proceed|scripts)"
    r"|(?:javascript|scripts?|scripting)\b(?: and cookies)? (?:is|are|seems? to be|must be|has been|needs? to be) (?:currently )?(?:disabled|blocked|required|turned off|not|off|active|enabled|needed)"
    r"|this (?:site|page|app|application|website) (?:requires|needs|works best with|depends on) (?:javascript|scripts?)"
    r"|(?:bitte )?(?:aktivieren|erlauben|schalten) sie (?:bitte )?(?:javascript|skripte)|javascript (?:ist|muss|wird)\b[^\n]{0,40}(?:deaktiviert|aktiviert|benötigt|ausgeschaltet)|diese (?:seite|anwendung) (?:benötigt|erfordert) javascript|sie müssen javascript"
    r"|(?:por favor,? )?(?:active|habilite|active usted|necesita|debe (?:activar|habilitar))[^\n]{0,20}javascript|javascript (?:está|debe estar) (?:desactivado|deshabilitado|activado|habilitado)|esta (?:página|aplicación) (?:requiere|necesita) javascript"
    r"|(?:请|您需要|您必须|必须|需要)(?:先)?(?:启用|开启|打开|允许) ?javascript|(?:您的)?浏览器(?:已禁用|未启用|不支持) ?javascript|(?:本|此)(?:页|页面|网站|应用)(?:需要|要求)(?:启用)? ?javascript|javascript ?(?:已被|被)?(?:禁用|未启用)"
    r"|(?:veuillez |merci d['’])?activer? javascript|javascript (?:est|doit être) (?:désactivé|activé|requis)|(?:por favor,? )?(?:ative|habilite) o javascript|javascriptを有効に"
    r")",
    re.I,
)

#: Navigation and page furniture around a document's own text (fixed values).
_CHROME = re.compile(
    r"^(?:skip to (?:main )?content|home(?: ?[|·•/] ?\w+)+|was this page helpful\?.*|yes ?no|© .*|copyright .*|menu( +\w+( \w+)?)*|search(?: docs)?|← ?back|back|last edited by .*|this page also uses cookies\.?|v\d[\d.]*"
    r"|contact the site owner.*|you may return to the home page.*|popular pages:.*|reference #\w+|request id [\w-]+\.?.*|loading…|edge/\w+)$",
    re.I,
)
_FENCED = re.compile(r"^([ \t]*(?:>[ \t]*)*)(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t]*(?:>[ \t]*)*\2[`~]*[ \t]*$|\Z)", re.S | re.M)
_INLINE = re.compile(r"(?<!`)(`+)(?!`)(?:[^`]|(?!\1)`+)*?\1(?!`)")
_PRE = re.compile(r"<(pre|code|samp|kbd|script|style|textarea)\b[^<>]*>.*?</\1\s*>", re.S | re.I)
_QUOTED = re.compile(r"\"[^\"\n]{1,200}\"|“[^”\n]{1,200}”|„[^“”\n]{1,200}[“”]|«[^»\n]{1,200}»|「[^」\n]{1,200}」|‘[^’\n]{2,200}’(?!\w)")
_UNSEEN = re.compile("[\\ufeff\\u200b-\\u200f\\u2060\\u00ad]")
_STARS = re.compile(r"[*_]{1,3}")
_LINE_MARKS = re.compile(r"[ \t]*(?:[>#|+-]+[ \t]*|\d+[.)][ \t]+)+")
_MARKED = frozenset("*_")
_SENTENCE_END = re.compile("[.!?…。！？|]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？])\s*|(?<!\w)\|(?!\w)")
_ANY_FIELD = re.compile(r"[{\[<%$]|@@|__")
_TAGS = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>")
_WORD = re.compile(r"[^\W\d_]+")


def content_of(text: str) -> str:
    """Text without code."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = _UNSEEN.sub("", text).replace("\xa0", " ")
    if "```" in text or "~~~" in text:
        text = _FENCED.sub("\n", text)
    if "<" in text:
        text = _PRE.sub(" ", text)
    return _INLINE.sub(" ‧ ", text) if "`" in text else text


_PIECE = re.compile(r"(?<=[.!?:;])\s+|\n+")


def placeholders(content: str) -> list[str]:
    """Unfilled fields in text without code."""
    found: list[str] = []
    if not _ANY_FIELD.search(content):
        return found
    for piece in _PIECE.split(content):
        if not _ANY_FIELD.search(piece):
            continue
        hits = [m[0] for m in _TEMPLATE.finditer(piece) if not m[0].startswith("[[") or _UPPER_DOUBLE.match(m[0])]
        for m in _AMBIGUOUS.finditer(piece):
            name = next(g for g in m.groups() if g)
            if _FIELD_IN.search(name.replace("_", " ")):
                hits.append(m[0])
        hits += [m[0] for m in _AMBIGUOUS_LOWER.finditer(piece)]
        if hits:
            rest = piece
            for h in hits:
                rest = rest.replace(h, " ")
            if not _TALK.search(rest):
                found += hits
    return found


def _is_filler(sentence: str, words: list[str]) -> bool:
    n = len(words)
    if n >= 4:
        if not _LATIN_STRONG.isdisjoint(words) and sum(w in LATIN for w in words) >= 0.7 * n and sum(w in _LATIN_STRONG for w in words) >= 2:
            return True
        if not _KEYSTROKES.isdisjoint(words) and sum(w in _KEYSTROKES for w in words) >= 0.8 * n and (len(set(words)) > 1 or n > 5):
            return True
    if n >= 2 and "text" in words and _TEXT_WORDS.issuperset(words):
        return True
    if n >= 6 and words[0] in _STARTERS and len(set(zip(words[::2], words[1::2], strict=False))) == 1:
        return True
    return bool(_FILLER_SENTENCE.match(sentence))


_STARTERS = frozenset("sample text dummy test example placeholder filler".split())
_JOINED = re.compile(r"\n(?<=[^\s.!?。：:|>]\n)(?=[a-zäöüß])")


def _unstarred(m: re.Match) -> str:
    """Emphasis marks go, underscores inside a word stay."""
    text, a, b = m.string, m.start(), m.end()
    if "*" in m[0]:
        return ""
    before = text[a - 1] if a else " "
    after = text[b] if b < len(text) else " "
    inside = (before.isalnum() or before == "_") and (after.isalnum() or after == "_")
    return m[0] if inside or (before.isspace() and after.isspace()) else ""


def sentences(content: str) -> list[str]:
    """Sentences and lines without marks, tags and quoted text."""
    # Lines of a paragraph belong together unless they are rows or headings of their own.
    text = _QUOTED.sub(" ‧ ", content)
    if "<" in text:
        text = _TAGS.sub("\n", text)
    text = _JOINED.sub(" ", text)
    if not _MARKED.isdisjoint(text):
        text = _STARS.sub(_unstarred, text)
    out = []
    for line in text.split("\n"):
        start = _LINE_MARKS.match(line)
        if start:
            line = line[start.end() :]
        for s in _SENTENCE.split(line) if _SENTENCE_END.search(line) else (line,):
            s = " ".join(s.split()).strip(" \t-–—*>|#")
            if s:
                out.append(s)
    return out


_VARIES, _VARYING = re.compile(r"\S*[\d/]\S*"), re.compile(r"[\d/]")
_IDEOGRAPH = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
_HEADING = re.compile(r"^(?:#{1,6}[ \t]+(\S.*)|<title[^<>]*>([^<>]*)</title>|<h1[^<>]*>([^<>]*)</h1>)", re.I | re.M)
_SLUG = re.compile(r"[^\W\d_]{3,}")


def _common(a: set[str], b: set[str]) -> int:
    """1 if two sets of words share one, -1 if not, 0 if one of them is empty."""
    return 0 if not a or not b else -1 if a.isdisjoint(b) else 1


def examine(text: str | None, path: str | None = None) -> dict:
    """The evidence in one document.

    ``lines`` are its sentences as (hash, words), ``page`` the hash of all of them; ``slug_title``,
    ``slug_body`` and ``title_body`` compare words: 1 some in common, -1 none, 0 nothing to compare.
    """
    e = {"placeholders": 0, "filler": 0, "messages": 0, "words": 0, "page": 0, "slug_title": 0, "slug_body": 0, "title_body": 0, "lines": []}
    if not text or not text.strip():
        return e
    content = content_of(text)
    e["placeholders"] = len(placeholders(content))
    body: set[str] = set()
    lines = []
    for s in sentences(content):
        low = s.lower()
        words = _WORD.findall(low)
        if _CHROME.match(s):
            body.update(words)
            continue
        if _ERROR.match(s) or _SCRIPT.match(s):
            e["messages"] += 1
        elif _is_filler(s, words) and not _TALK.search(_FILLER_SENTENCE.sub("", s)):
            e["filler"] += 1
        if _VARYING.search(low):
            words = _WORD.findall(_VARIES.sub(" ", low))
        if words:
            body.update(words)
            size = len(words) if low.isascii() else max(len(words), len(_IDEOGRAPH.findall(low)) // 2)
            lines.append((xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63), size))
    e["lines"] = lines
    e["words"] = sum(n for _, n in lines)
    e["page"] = hash(tuple(sorted(h for h, _ in lines)))
    heading = _HEADING.search(content)
    title = set(_WORD.findall(next(g for g in heading.groups() if g is not None).lower())) if heading else set()
    slug = set(_SLUG.findall(re.sub(r"\.\w+$", "", (path or "").rsplit("/", 1)[-1].lower())))
    rest = body - title if heading else body
    e["slug_title"], e["slug_body"], e["title_body"] = _common(slug, title), _common(slug, rest), _common(title, rest)
    return e


_SCHEMA = "doc_id bigint, source string, placeholders int, filler int, messages int, words int, page bigint, slug_title int, slug_body int, title_body int, hash array<bigint>, size array<int>"
_FIELDS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _examine_batches(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text, source, path in batch[["doc_id", "text", "source", "path"]].itertuples(index=False, name=None):
            e = examine(text, path)
            if e["lines"] or e["placeholders"]:
                rows.append((doc_id, source, *(e[f] for f in _FIELDS[2:-2]), [h for h, _ in e["lines"]], [n for _, n in e["lines"]]))
        yield pd.DataFrame(rows, columns=_FIELDS)


def evidence(documents: DataFrame) -> DataFrame:
    """What :func:`examine` finds in every document; texts are read once, hashes and counts stay."""
    narrow = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source", "path")
    return materialise(narrow.mapInPandas(_examine_batches, _SCHEMA), "residue")


def response_sentences(seen: DataFrame, min_copies: int = 6, page_words: int = 40, copy_words: int = 16) -> DataFrame:
    """(hash): sentences that stand on ``min_copies`` or more pages, of two or more hosts, that say little else.

    The typical page (geometric mean) has at most ``page_words`` words. Where all pages are the same,
    they are copies of one document unless they are as short as ``copy_words``. One partial
    aggregation over all sentences: a sentence that a third of all pages have is one row per task.
    """
    each = seen.select("source", "page", F.log(F.col("words") + 1.0).alias("room"), F.explode(F.array_distinct("hash")).alias("hash"))
    host = F.coalesce("source", F.lit(""))
    stats = each.groupBy("hash").agg(
        F.count("*").alias("copies"), F.min(host).alias("a"), F.max(host).alias("b"), F.min("page").alias("p"), F.max("page").alias("q"), F.avg("room").alias("room")
    )
    limit = F.when(F.col("p") != F.col("q"), F.lit(math.log(page_words + 1))).otherwise(F.lit(math.log(copy_words + 1)))
    return stats.where((F.col("copies") >= min_copies) & (F.col("a") != F.col("b")) & (F.col("room") <= limit)).select("hash", "copies")


#: What the evidence adds to a page's score (fixed weights); a response has 1 or more.
SHARE, FILLED, SLUG_TITLE, SLUG_BODY, TITLE_BODY = 1.5, 1.5, 0.1, 0.3, 0.05


def scored(seen: DataFrame) -> DataFrame:
    """``seen`` with ``response`` (share of the words in response sentences), ``copies`` (of the rarest of these) and ``score``."""
    lines = seen.select("doc_id", "page", "words", F.explode(F.arrays_zip("hash", "size")).alias("l")).select("doc_id", "page", "words", F.col("l.hash").alias("hash"), F.col("l.size").alias("size"))
    # Not broadcast: the sentences grow with the documents.
    hit = lines.join(response_sentences(seen).hint("merge"), "hash").groupBy("doc_id", "page").agg(F.sum("size").alias("held"), F.min("copies").alias("copies"))
    out = seen.drop("hash", "size").join(hit.hint("merge"), ["doc_id", "page"], "left")
    share = F.coalesce(F.col("held") / F.greatest(F.lit(1), F.col("words")), F.lit(0.0))
    score = (
        SHARE * F.col("response")
        + F.when(F.col("placeholders") > 0, FILLED).otherwise(0.0)
        - SLUG_TITLE * F.col("slug_title") - SLUG_BODY * F.col("slug_body") - TITLE_BODY * F.col("title_body")
    )
    return out.withColumn("response", share).withColumn("score", score).withColumn("copies", F.coalesce("copies", F.lit(1)))


@settled("scores")
def response_scores(documents: DataFrame) -> DataFrame:
    """(doc_id, score, response, copies, placeholders, slug_title, slug_body, title_body, residue) of every document."""
    rows = scored(evidence(documents)).withColumn("residue", F.col("score") >= 1)
    best = F.max_by(F.struct("score", "response", "copies", "placeholders", "slug_title", "slug_body", "title_body", "residue"), F.struct("score", "page")).alias("r")
    return rows.groupBy("doc_id").agg(best).select("doc_id", "r.*")


@settled("residues")
def residue_evidence(documents: DataFrame) -> DataFrame:
    """Every document with residue and why: (doc_id, placeholders, filler, messages, copies, score, reason).

    A page without any detector's hit is reported by its score alone.
    """
    rows = scored(evidence(documents)).where("placeholders + filler + messages > 0 or score >= 1")
    reason = F.when(F.col("placeholders") > 0, "placeholder").when(F.col("filler") > 0, "filler").when(F.col("messages") > 0, "message").otherwise("response")
    return rows.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("placeholders", "filler", "messages", "copies", "score")]).withColumn("reason", reason)
