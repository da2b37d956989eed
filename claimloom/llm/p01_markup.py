"""Problem 1: markup residue in text documents.

Candidate constructs and the blocks of text between them are the nodes of one
graph.  A minimum cut decides which constructs are markup and which only look
like it, and which blocks are content and which boilerplate; further cuts decide
between two languages that could both have written a construct.  Terminal
capacities are the costs of classifiers over form and shape; smoothness edges
join constructs that stand near each other or inside the same element or
environment, neighbouring blocks, and blocks with the page furniture around
them.  The constructs left as markup are then rewritten, each by its kind and
nothing else: headings, lists, code and formulas are kept in one plain notation;
boilerplate blocks are left out.

The block classifier is fitted on a bounded sample of documents, in which the
place or wording of blocks labels them well enough.  The costs of constructs are set
by hand: nothing in a text labels them.
"""

from __future__ import annotations

import html
import json
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.lookalike import fold, skeleton
from claimloom.llm.mincut import min_cut

LANGUAGES = ("html", "markdown", "wiki", "latex")

# Element names of HTML, and of the tags that belong to wiki text.
HTML_TAGS = "a|abbr|address|article|aside|b|big|blockquote|body|br|button|caption|center|cite|code|col|dd|del|div|dl|dt|em|figcaption|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|li|link|main|mark|meta|nav|ol|option|p|pre|q|s|samp|script|section|select|small|span|strike|strong|style|sub|sup|table|tbody|td|textarea|tfoot|th|thead|title|tr|tt|u|ul|var|video"
WIKI_TAGS = "ref|references|math|chem|syntaxhighlight|source|nowiki|gallery|poem|noinclude|includeonly|onlyinclude|timeline"


class Mark(NamedTuple):
    start: int
    end: int
    kind: str
    #: cost of being taken for content, cost of being taken for markup
    content: float
    markup: float
    #: cost of each language that may have written it
    language: dict[str, float]


_SURE = 50.0
_TAG = re.compile(rf"</?(?:(?P<w>{WIKI_TAGS})|(?P<h>{HTML_TAGS}))(?:\s[^<>]*)?/?>", re.IGNORECASE)
_COMMENT = re.compile(r"<!--.*?-->|<!doctype[^>]*>", re.IGNORECASE | re.DOTALL)
_ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
_WIKI_LINK = re.compile(r"\[\[[^\[\]\n]+\]\]")
_TEMPLATE = re.compile(r"\{\{[^{}]+\}\}")
_WIKI_HEAD = re.compile(r"^(={2,6})[ \t]*[^=\n].*?[ \t]*\1[ \t]*$", re.MULTILINE)
_QUOTES = re.compile(r"(?<!')('{2,5})(?=[^'\s])[^'\n]+?(?<=[^'\s])\1(?!')")
_MAGIC = re.compile(r"__(?:NO)?(?:TOC|EDITSECTION|FORCETOC|INDEX|NEWSECTIONLINK|GALLERY)__|#REDIRECT\b")
_WIKI_TABLE = re.compile(r"^(?:\{\|.*|\|\}|\|-.*|\|[^|\n]+\|\|.*)$", re.MULTILINE)
_EXTERNAL = re.compile(r"\[https?://[^\s\]]+ [^\]\n]+\]")
_HASH = re.compile(r"^(#{1,6})[ \t]+\S.*$", re.MULTILINE)
_SETEXT = re.compile(r"^(?P<t>[^\s\-=|#>*].*\S|\S)\n(?P<u>={3,}|-{3,})[ \t]*$", re.MULTILINE)
_EMPHASIS = re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])[^*\n]+?(?<=[^\s*])\1(?![\w*])")
_BOLD = re.compile(r"(?<![\w_])__(?=[^\s_])[^_\n]+?(?<=[^\s_])__(?![\w_])")
_UNDER = re.compile(r"(?<![\w_\\{])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_])")
_FENCE = re.compile(r"^(```|~~~)[^\n`]*\n.*?(?:^\1[ \t]*$|\Z)", re.MULTILINE | re.DOTALL)
_TICK = re.compile(r"(?<!`)`(?=[^\s`])[^`\n]+?`(?!`)")
_MD_LINK = re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]+(?: \"[^\"\n]*\")?\)")
_FOOTNOTE = re.compile(r"\[\^[\w-]+\]:?")
_MD_TABLE = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$", re.MULTILINE)
_BLOCKQUOTE = re.compile(r"^> ?(?=\S).*$", re.MULTILINE)
_STRIKE = re.compile(r"~~(?=\S)[^~\n]+?~~")
_COMMAND = re.compile(r"\\(?:[a-zA-Z]{2,}\*?|[$&%#_{}\\])(?:\[[^\]\n]*\])?")
_DISPLAY = re.compile(r"\\\[.*?\\\]|\\\(.*?\\\)", re.DOTALL)
_LATEX_COMMENT = re.compile(r"^%.*$", re.MULTILINE)
_FORMULA = re.compile(r"\$\$(?P<d>[^$]+?)\$\$|(?<![\w$\\])\$(?P<i>(?=[^\s\d$])[^$\n]*?[^\s$])\$(?![\w$])")
_CODE = re.compile(r"<(pre|code|syntaxhighlight|source|script|style)\b[^<>]*>.*?</\1>", re.IGNORECASE | re.DOTALL)
#: Documents without any of these hold no markup at all.
_ANY = re.compile(r"[<\\*`#{_~]|&[a-zA-Z#]|\[[\[^!\w]|\]\(|''|==|---|^> |\$", re.MULTILINE)


def find_marks(t: str) -> list[Mark]:
    """Candidate constructs of a text, in order; what stands in code isn't searched."""
    if not _ANY.search(t):
        return []
    marks: list[Mark] = []
    hidden: list[tuple[int, int]] = []

    def add(m: re.Match | tuple[int, int], kind: str, content: float, markup: float, **language: float) -> None:
        a, b = m if isinstance(m, tuple) else m.span()
        if not any(x <= a < y for x, y in hidden):
            marks.append(Mark(a, b, kind, content, markup, language))

    def hide(a: int, b: int) -> None:
        if b > a:
            hidden.append((a, b))

    if "```" in t or "~~~" in t:
        for m in _FENCE.finditer(t):
            add(m, "code", _SURE, 0, markdown=0)
            hide(m.start() + 3, m.end())
    if "<" in t:
        inner = []
        for m in _CODE.finditer(t):
            inner.append((t.index(">", m.start()) + 1, t.rindex("<", m.start(), m.end())))
        for m in _COMMENT.finditer(t):
            add(m, "tag", _SURE, 0, html=0)
        hidden += [s for s in inner if s[1] > s[0] and "<code" not in t[s[0] : s[1]].lower()]
        for m in _TAG.finditer(t):
            if m.group("w"):
                add(m, "tag", _SURE, 0, wiki=0)
            elif m.group("h").lower() in ("code", "pre"):
                add(m, "tag", _SURE, 0, html=0.0, wiki=1.5)
            else:
                add(m, "tag", _SURE, 0, html=0)
    if "&" in t:
        for m in _ENTITY.finditer(t):
            if html.unescape(m.group()) != m.group():
                add(m, "entity", _SURE, 0, html=0)
    if "[" in t:
        for m in _WIKI_LINK.finditer(t):
            add(m, "link", _SURE, 0, wiki=0)
        for m in _MD_LINK.finditer(t):
            add(m, "link", _SURE, 0, markdown=0)
        for m in _FOOTNOTE.finditer(t):
            add(m, "note", _SURE, 0, markdown=0)
        for m in _EXTERNAL.finditer(t):
            add(m, "link", _SURE, 0, wiki=0)
    if "{{" in t:
        for m in _TEMPLATE.finditer(t):
            add(m, "template", _SURE, 0, wiki=0, **({"latex": 2.0} if "\\" in m.group() else {}))
    if "==" in t:
        for m in _WIKI_HEAD.finditer(t):
            add(m, "heading", _SURE, 0, wiki=0)
    if "''" in t:
        for m in _QUOTES.finditer(t):
            add(m, "emphasis", 2.0, 0, wiki=0)
    if "__" in t:
        for m in _MAGIC.finditer(t):
            add(m, "magic", _SURE, 0, wiki=0)
        for m in _BOLD.finditer(t):
            if not _MAGIC.match(m.group()):
                add(m, "emphasis", 2.5, 0, markdown=0)
    if "_" in t:
        for m in _UNDER.finditer(t):
            add(m, "emphasis", 0.6, 1.0, markdown=0)
    if "|" in t:
        for m in _WIKI_TABLE.finditer(t):
            add(m, "table", _SURE if m.group()[:2] in ("{|", "|}", "|-") and not _MD_TABLE.match(m.group()) else 0.8, 0, wiki=0, markdown=0.5) if not _MD_TABLE.match(m.group()) else None
        for m in _MD_TABLE.finditer(t):
            add(m, "table", _SURE, 0, markdown=0)
    if "#" in t:
        lines = list(_HASH.finditer(t))
        if lines:
            at = {m.start() for m in lines}
            for m in lines:
                one = len(m.group(1)) == 1
                after = t[m.end() + 1 : m.end() + 3]
                before = t[t.rfind("\n", 0, max(0, m.start() - 1)) + 1 : max(0, m.start() - 1)] if m.start() else ""
                run = m.end() + 1 in at or after[:2] in ("* ", "# ") or before[:2] in ("# ", "* ")
                if one and run:
                    add(m, "list", 1.5, 0, wiki=0, markdown=1.5)
                elif one:
                    add(m, "heading", 1.5, 0, markdown=0, wiki=0.8 if not m.group()[2:3].isupper() else 1.6)
                else:
                    add(m, "heading", _SURE, 0, markdown=0)
    if "==" in t or "---" in t:
        for m in _SETEXT.finditer(t):
            if "|" not in m.group("t"):
                add((m.start("u"), m.end("u")), "underline", _SURE if m.group("u")[0] == "=" else 2.0, 0, markdown=0)
    if "*" in t:
        for m in _EMPHASIS.finditer(t):
            if "|" not in m.group():
                add(m, "emphasis", 2.0, 0, markdown=0)
    if "`" in t:
        for m in _TICK.finditer(t):
            add(m, "code", 2.0, 0, markdown=0)
    if "~~" in t:
        for m in _STRIKE.finditer(t):
            add(m, "emphasis", 2.0, 0, markdown=0)
    if "\n>" in t or t[:1] == ">":
        for m in _BLOCKQUOTE.finditer(t):
            para = m.start() == 0 or t[max(0, m.start() - 2) : m.start()] == "\n\n"
            words = m.group()[1:].lstrip()
            prose = words[:1].isupper() or t[: m.start()].rstrip("\n").rsplit("\n", 1)[-1][:1] == ">"
            add(m, "quote", 2.0 if para and prose else 0.4, 0.0 if para else 1.6, markdown=0)
    if "\\" in t:
        for m in _DISPLAY.finditer(t):
            add(m, "formula", 2.0, 0, latex=0)
        for m in _COMMAND.finditer(t):
            word = m.group()[1:2].isalpha()
            add(m, "command", _SURE if word and t[m.end() : m.end() + 1] in "{[" else 2.0 if word else 1.6, 0, latex=0)
    if "$" in t:
        for m in _FORMULA.finditer(t):
            body = m.group("d") or m.group("i")
            hard = any(c in body for c in "\\^_=") or len(body) == 1
            if m.group("d"):
                add(m, "formula", 3.0, 0, markdown=0, latex=0.9)
            elif hard:
                add(m, "formula", 2.5, 0, latex=0, markdown=1.1)
            else:
                add(m, "formula", 0.3, 1.2, latex=0, markdown=0.3)
    if "%" in t:
        for m in _LATEX_COMMENT.finditer(t):
            add(m, "comment", 0.8, 1.1, latex=0)
    marks.sort(key=lambda m: (m.start, -m.end))
    return marks


def _edges(marks: list[Mark], t: str, weight: float) -> list[tuple[int, int, float]]:
    """Adjacency (the next few constructs, weaker with distance) and proximity inside one element or environment."""
    out = []
    for i, a in enumerate(marks):
        for j in range(i + 1, min(len(marks), i + 5)):
            gap = max(0, marks[j].start - a.end)
            out.append((i, j, weight / ((j - i) * (1 + gap / 1500))))
    out += [(i, j, 2 * weight) for i, j in _elements(marks, t)]
    return out


def _elements(marks: list[Mark], t: str) -> list[tuple[int, int]]:
    """Opening and closing tag of each element."""
    out, opened, names = [], [], Counter()
    for i, m in enumerate(marks):
        if m.kind != "tag":
            continue
        s = t[m.start : m.end]
        if s[1:2].isalpha() and s[-2:] != "/>":
            name = re.match(r"\w+", s[1:]).group().lower()
            if name not in _VOID:
                opened.append((name, i))
                names[name] += 1
        elif s[1:2] == "/" and names[name := s[2:-1].strip().lower()]:
            while True:
                inner, k = opened.pop()
                names[inner] -= 1
                if inner == name:
                    out.append((k, i))
                    break
    return out


_CELL = re.compile(r"<(?:li|td|th|dt|dd)\b", re.IGNORECASE)


class Block(NamedTuple):
    start: int
    end: int
    #: shape, for the classifier
    features: tuple[str, ...]
    #: whether its place or wording makes it boilerplate: a label to fit on, right for most blocks but not for all
    known: bool
    #: furniture elements around it (numbers of their opening tags)
    inside: tuple[int, ...]


_VOID = frozenset("area base br col embed hr img input link meta source track wbr li p dt dd tr td th option".split())
# Elements that hold the furniture of a page, and what its controls say.
FURNITURE = frozenset("nav footer button form select menu dialog aside".split())
CONTROLS = re.compile(r"(?:(?:log|sign) (?:in|out|up)|register|home|menu|search|share|next(?: page)?|previous(?: page)?|back to top|(?:accept|reject) all|download(?: pdf)?|print|contact(?: us)?|about(?: us)?|help|(?:cookie )?settings|cookies|privacy policy|terms of use|subscribe|follow us|(?:read|view|load) more|skip to content|close)", re.IGNORECASE)
#: Documents the block classifier is fitted on at most, and what its starting odds weigh, in blocks.
FIT_DOCS, FIT_PRIOR = 2_000, 50
#: Log-odds of boilerplate for each shape that fitting begins with, and of boilerplate as such.
BLOCK_ODDS = {"words:0": 1.0, "words:3": 0.3, "words:10": -2.0, "ends": -1.5, "open": 0.5, "linked": 2.0, "unlinked": -0.5, "control": 6.0, "no control": -0.3}
BIAS = -3.0


def find_blocks(t: str, marks: list[Mark]) -> list[Block]:
    """Lines of text between constructs that end a block; outside of page furniture, headings, list items, cells, code and formulas are left out: they stay."""
    tags = [(m.start, m.end, t[m.start : m.end]) for m in marks if m.kind == "tag"]
    breaks = sorted({x for a, b, s in tags if _BLOCKS.fullmatch(s) for x in (a, b)})
    kept = sorted((m.start, m.end) for m in marks if m.kind in ("heading", "list", "table", "code", "formula", "underline", "quote"))
    spans = [(marks[i].start, marks[j].end, re.match(r"\w+", t[marks[i].start + 1 :]).group().lower(), i) for i, j in _elements(marks, t)]
    kept += [(a, b) for a, b, name, _ in spans if re.fullmatch("h[1-6]|title|pre|code|math|chem|script|style|table", name)]
    links = [(a, b) for a, b, name, _ in spans if name == "a"] + [(m.start, m.end) for m in marks if m.kind == "link"]
    furniture = [(a, b, i) for a, b, name, i in spans if name in FURNITURE]
    covered, solid = bytearray(len(t)), bytearray(len(t))
    for a, b in kept:
        covered[a:b] = b"\x01" * (b - a)
    for m in marks:
        solid[m.start : m.end] = b"\x01" * (m.end - m.start)
    linked = bytearray(len(t))
    for a, b in links:
        linked[a:b] = b"\x01" * (b - a)
    out, at = [], 0
    cuts = sorted({*breaks, *(m.start() for m in re.finditer("\n", t)), len(t)})
    for end in cuts:
        a, b, at = at, end, end
        shown = "".join(c for c, x in zip(t[a:b], solid[a:b], strict=True) if not x).strip() if any(solid[a:b]) else t[a:b].strip()
        around = tuple(i for x, y, i in furniture if x <= a and b <= y)
        if not shown or not around and (any(covered[a:b]) or re.match(r"[-+*•#|\\]|\d+[.)]", shown) or _CELL.search(t, a, b)):
            continue
        words = len(shown.split())
        own = sum(1 for c, x in zip(t[a:b], linked[a:b], strict=True) if x and not c.isspace())
        control = bool(CONTROLS.fullmatch(shown.rstrip(".:>» ")))
        ends = shown[-1] in ".!?:;”\"'"
        features = ("words:10" if words >= 10 else "words:3" if words >= 3 else "words:0", "ends" if ends else "open", "linked" if 2 * own >= len(shown) else "unlinked", "control" if control else "no control")
        out.append(Block(a, b, features, bool(around or control), around))
    return out


def _counted(texts: list[str]) -> str:
    """Counts of shapes among blocks that are boilerplate by place or wording and among the others, as JSON."""
    seen: dict[str, Counter] = {"1": Counter(), "0": Counter()}
    for text in texts:
        t = skeleton(text)
        for b in find_blocks(t, find_marks(t)):
            seen["1" if b.known else "0"].update(("", *b.features))
    return json.dumps(seen)


def _pooled(counts: list[str]) -> dict[str, float]:
    """Log-odds of boilerplate for each shape; both classes begin with FIT_PRIOR blocks that agree with the starting odds."""
    seen = {k: sum((Counter(json.loads(c)[k]) for c in counts), Counter()) for k in "10"}

    def share(k: str, f: str, odds: float) -> float:
        return (seen[k][f] + FIT_PRIOR / (1 + math.exp(-odds))) / (seen[k][""] + FIT_PRIOR)

    return {f: math.log(share("1", f, o / 2) / share("0", f, -o / 2)) for f, o in BLOCK_ODDS.items()}


def fit_blocks(texts: list[str]) -> dict[str, float]:
    """Log-odds of boilerplate for each shape of a block, from the blocks of some texts."""
    return _pooled([_counted(texts)])


def label(t: str, marks: list[Mark], blocks: list[Block] = (), odds: dict[str, float] | None = None) -> tuple[list[tuple[Mark, str]], list[Block]]:
    """(constructs that are markup, each with the language it counts for; blocks that are boilerplate), by one cut of both."""
    if not marks:
        return [], []
    costs, edges = [(m.content, m.markup) for m in marks], _edges(marks, t, 0.7)
    for i, b in enumerate(blocks, len(marks)):
        score = BIAS + sum((odds or BLOCK_ODDS)[f] for f in b.features)
        costs.append((max(score, 0.0), max(-score, 0.0)))
        edges += [(k, i, 4.0) for k in b.inside]
        if i > len(marks):
            edges.append((i - 1, i, 0.5 / (1 + (b.start - blocks[i - len(marks) - 1].end) / 200)))
    residue = min_cut(costs, edges)
    kept = [m for m, x in zip(marks, residue, strict=False) if x]
    dropped = [b for b, x in zip(blocks, residue[len(marks) :], strict=True) if x]
    if not kept:
        return [], dropped
    best = [min(m.language, key=m.language.get) for m in kept]
    if any(len(m.language) > 1 for m in kept):
        # Two languages are told apart at a time; constructs of neither keep out of that cut.
        for a, b in {tuple(sorted(m.language)) for m in kept if len(m.language) > 1}:
            at = [i for i, m in enumerate(kept) if a in m.language or b in m.language]
            sub = [kept[i] for i in at]
            costs = [(m.language.get(a, _SURE), m.language.get(b, _SURE)) for m in sub]
            for i, m, second in zip(at, sub, min_cut(costs, _edges(sub, t, 1.0)), strict=True):
                if a in m.language and b in m.language:
                    best[i] = b if second else a
    return list(zip(kept, best, strict=True)), dropped


def languages(text: str) -> list[str]:
    """Markup languages that occur in a text, however little."""
    t = skeleton(text)
    return sorted({x for _, x in label(t, find_marks(t))[0]})


_BLOCKS = re.compile(r"</?(?:p|div|section|article|header|footer|nav|table|tr|ul|ol|dl|blockquote|figure|html|head|body|center|form|main|aside|tbody|thead)\b[^<>]*>|<(?:br|hr)\b[^<>]*>", re.IGNORECASE)


def _code(body: str) -> str:
    return "\n" + "\n".join("    " + x for x in body.strip("\n").split("\n")) + "\n"


_PAIRED = frozenset("script style ref pre syntaxhighlight source code nowiki math chem".split())
# What LaTeX commands and environments do with their argument.
_HEADS = re.compile(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph|title)\*?(?:\[|$)")
_DROPPED = re.compile(r"\\(?:[a-z]*cite\w*|footnote|label|ref|eqref|pageref|documentclass|usepackage|bibliography\w*|input)\*?(?:\[|$)")
_KEPT = re.compile(r"\\(?:emph|text\w+|underline|mbox|url)\*?(?:\[|$)")
_ENVIRONMENT = re.compile(r"\\(begin|end)(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_MATHS = frozenset("equation align gather multline displaymath math eqnarray flalign alignat".split())
_VERBATIM = frozenset("verbatim Verbatim lstlisting minted alltt".split())
#: Formulas of LaTeX of any length, also over several lines of one paragraph.
_LONG_FORMULA = re.compile(r"(?<![\\\w$])\$(?=[^\s$])(?:[^$\n\\]|\\.|\n(?![ \t]*\n))+?(?<=[^\s\\])\$(?![\w$])", re.DOTALL)
# Templates that stand for notes, boxes and sorting.
_SILENT = re.compile(r"cit|sfn|harv|ref|note|efn|infobox|navbox|short description|defaultsort|authority|coord|use |#", re.IGNORECASE)
_BULLET = re.compile(r"^[*#:;]+(?=[ \t]+\S)", re.MULTILINE)
_TIE = re.compile(r"(?<=\S)~(?=\S)")


def _argument(t: str, at: int) -> int:
    """End of the braced argument that opens at ``at``; ``at`` if none does or it isn't closed."""
    if t[at : at + 1] != "{":
        return at
    depth, i = 0, at
    while i < len(t):
        if t[i] == "\\":
            i += 1
        elif t[i] == "{":
            depth += 1
        elif t[i] == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return at


class Rewrite:
    """Edits of a text, one construct at a time; what stands in code, formulas or deleted parts is left alone."""

    def __init__(self, t: str, read: str, marks: list[tuple[Mark, str]]):
        self.t, self.read, self.marks = t, read, marks
        self.starts = [m.start for m, _ in marks]
        self.edits: list[tuple[int, int, str]] = []
        #: 1 for characters of parts that stay as they are or come out by one edit, 2 behind their first
        self.solid = bytearray(len(t))

    def put(self, a: int, b: int, new: str = "") -> None:
        self.edits.append((a, b, new))

    def whole(self, a: int, b: int, new: str | None = None) -> None:
        """Part a..b comes out as ``new``, or as it is."""
        if not self.inside(a):
            self.solid[a:b] = b"\x02" * (b - a)
            self.solid[a] = 1
            self.edits.append((a, b, self.t[a:b] if new is None else new))

    def inside(self, at: int) -> bool:
        return self.solid[at] > 0

    def language_near(self, at: int) -> str:
        """Language of the nearest construct."""
        i = bisect_left(self.starts, at)
        near = self.marks[max(0, i - 1) : i + 1]
        return min(near, key=lambda x: max(x[0].start - at, at - x[0].end))[1]

    def line(self, m: Mark) -> tuple[int, int]:
        """The construct with its line end."""
        return m.start, m.end + (self.read[m.end : m.end + 1] == "\n")

    def text(self) -> str:
        out, at = [], 0
        for a, b, new in sorted(self.edits, key=lambda e: (e[0], -e[1])):
            # an insertion may stand at the end of the edit before
            if a < at or a < len(self.t) and self.solid[a] == 2:
                continue
            out += (self.t[at:a], new)
            at = b
        return "".join([*out, self.t[at:]])

    # one construct of each kind

    def tag(self, m: Mark, language: str) -> None:
        s = self.read[m.start : m.end]
        name = re.match(r"</?(\w+)", s)
        if not name:
            return self.put(m.start, m.end)
        name, closing, empty = name.group(1).lower(), s[1] == "/", s.endswith("/>")
        end = None if closing or empty or name not in _PAIRED else re.compile(rf"</{name}\s*>", re.IGNORECASE).search(self.read, m.end)
        if end and name in ("script", "style", "ref"):
            return self.whole(m.start, end.end(), "")
        if end and name in ("pre", "syntaxhighlight", "source") or end and name == "code" and "\n" in self.t[m.end : end.start()]:
            body = re.sub(r"</?code[^<>]*>", "", self.t[m.end : end.start()], flags=re.IGNORECASE)
            return self.whole(m.start, end.end(), _code(body if name in ("syntaxhighlight", "source") else html.unescape(body)))
        if end and name in ("code", "nowiki"):
            return self.whole(m.start, end.end(), html.unescape(self.t[m.end : end.start()]))
        if end and name in ("math", "chem"):
            return self.whole(m.start, end.end(), "$" + self.t[m.end : end.start()].strip() + "$")
        if name == "title" or re.fullmatch("h[1-6]", name):
            return self.put(m.start, m.end, "\n" if closing else "\n# ")
        if name == "li":
            return self.put(m.start, m.end, "" if closing else "\n- ")
        if name in ("td", "th") and not closing:
            at = m.start
            while at and self.read[at - 1].isspace():
                at -= 1
            if self.read[max(0, at - 5) : at].lower() in ("</td>", "</th>"):
                return self.put(at - 5, m.end, " | ")
        self.put(m.start, m.end, "\n" if _BLOCKS.fullmatch(s) else "")

    def entity(self, m: Mark, language: str) -> None:
        self.put(m.start, m.end, html.unescape(self.read[m.start : m.end]))

    def link(self, m: Mark, language: str) -> None:
        s = self.read[m.start : m.end]
        if s.startswith("[["):
            if re.match(r"\[\[(?:Category|File|Image):", s, re.IGNORECASE):
                return self.put(*self.line(m))
            # what is shown is the label behind the last bar, or the target
            bar = s.rfind("|")
            self.put(m.start, m.start + (bar + 1 if bar > 0 else 2))
            return self.put(m.end - 2, m.end)
        if "](" in s:
            self.put(m.start, m.start + 1 + (s[0] == "!"))
            return self.put(m.start + s.rindex("]("), m.end)
        self.put(m.start, m.start + s.index(" ") + 1)
        self.put(m.end - 1, m.end)

    def note(self, m: Mark, language: str) -> None:
        self.put(m.start, m.end)

    magic = note

    def template(self, m: Mark, language: str) -> None:
        """A template shows its last unnamed argument; those that cite, name or sort show nothing in the text."""
        name, *arguments = self.t[m.start + 2 : m.end - 2].split("|")
        shown = [x.strip() for x in arguments if "=" not in x]
        self.whole(m.start, m.end, shown[-1] if shown and not _SILENT.match(name.strip()) else "")

    def heading(self, m: Mark, language: str) -> None:
        s = self.read[m.start : m.end]
        self.put(m.start, m.start + re.match(r"[#=]+[ \t]*", s).end(), "# ")
        if s[0] == "=":
            self.put(m.start + re.search(r"[ \t]*=+[ \t]*$", s).start(), m.end)

    def list(self, m: Mark, language: str) -> None:
        if language == "wiki":
            self.put(m.start, m.start + 1, "-")

    def underline(self, m: Mark, language: str) -> None:
        self.put(*(2 * [self.read.rfind("\n", 0, m.start - 1) + 1]), "# ")
        self.put(m.start - 1, m.end)

    def emphasis(self, m: Mark, language: str) -> None:
        s = self.read[m.start : m.end]
        n = min(len(s) - len(s.lstrip(s[0])), len(s) - len(s.rstrip(s[0])))
        self.put(m.start, m.start + n)
        self.put(m.end - n, m.end)

    def code(self, m: Mark, language: str) -> None:
        s = self.t[m.start : m.end]
        if s[:3] in ("```", "~~~"):
            self.whole(m.start, m.end, _code(re.sub(r"^(?:```|~~~)[^\n]*\n?|\n?(?:```|~~~)[ \t]*$", "", s)))
        else:
            self.whole(m.start, m.end, s.strip("`"))

    def table(self, m: Mark, language: str) -> None:
        s = self.read[m.start : m.end]
        if s[:2] in ("{|", "|}", "|-") or _MD_TABLE.match(s):
            self.put(*self.line(m))
        elif language == "wiki":
            self.put(m.start, m.start + 1 + (s[1:2] in (" ", "\t")))
            for x in re.finditer(r"\|\|", s):
                self.put(m.start + x.start(), m.start + x.end(), "|")

    def quote(self, m: Mark, language: str) -> None:
        self.put(m.start, m.start + 1 + (self.read[m.start + 1 : m.start + 2] == " "))

    def formula(self, m: Mark, language: str) -> None:
        s = self.t[m.start : m.end]
        n = 2 if s[:2] in ("$$", "\\[", "\\(") else 1
        self.whole(m.start, m.end, "$" + s[n:-n].strip() + "$")

    def comment(self, m: Mark, language: str) -> None:
        self.put(*self.line(m))

    def environment(self, m: Mark) -> bool:
        """Environments of formulas and code, as a whole."""
        head = _ENVIRONMENT.match(self.read, m.start)
        if not head or head.group(1) != "begin":
            return False
        name = head.group(2)
        plain = name.rstrip("*")
        end = self.read.find(f"\\end{{{name}}}", head.end())
        if end < 0 or plain not in _MATHS and plain not in _VERBATIM and plain != "comment":
            return False
        body, stop = self.t[head.end() : end], end + len(name) + 6
        if plain in _VERBATIM:
            self.whole(m.start, stop, _code(re.sub(r"^(?:\[[^\]\n]*\]|\{[^{}\n]*\})+[ \t]*(?=\n)", "", body)))
        else:
            body = re.sub(r"\\(?:label|tag)\*?\{[^{}]*\}|\\(?:nonumber|notag)\b", "", body)
            self.whole(m.start, stop, "" if plain == "comment" else "$" + body.strip() + "$")
        return True

    def command(self, m: Mark, language: str) -> None:
        t, s = self.read, self.read[m.start : m.end]
        if not s[1].isalpha():
            at = m.start
            if s == "\\\\":
                while at and t[at - 1] in " \t":
                    at -= 1
            return self.put(at, m.end, "" if s[:2] == "\\\\" else s[1:])
        head = _ENVIRONMENT.match(t, m.start)
        if head:
            end = head.end()
            while t[end : end + 1] in ("{", "["):
                more = re.compile(r"\{[^{}\n]*\}|\[[^\]\n]*\]").match(t, end)
                if not more or head.group(1) == "end":
                    break
                end = more.end()
            return self.put(m.start, end)
        end = _argument(t, m.end)
        name = re.match(r"\\[a-zA-Z]+", s).group()
        if name == "\\item":
            at = m.start
            while at and t[at - 1] in " \t":
                at -= 1
            return self.put(at if not at or t[at - 1] == "\n" else m.start, re.compile(r"[ \t]*").match(t, m.end).end(), "- ")
        if end > m.end and _HEADS.match(s):
            self.put(m.start, m.end + 1, "\n# ")
            return self.put(end - 1, end, "\n")
        if end > m.end and _DROPPED.match(s):
            return self.whole(m.start - (t[m.start - 1 : m.start] == "~"), end, "")
        if end > m.end and name == "\\href" and (last := _argument(t, end)) > end:
            self.put(m.start, end + 1)
            return self.put(last - 1, last)
        if end > m.end and _KEPT.match(s):
            self.put(m.start, m.end + 1)
            return self.put(end - 1, end)
        while (more := _argument(t, end)) > end:
            end = more
        self.whole(m.start, end + (t[end : end + 1] in (" ", "\t")), "")


def clean_text(text: str, odds: dict[str, float] | None = None) -> tuple[str, list[str]]:
    """(text without markup and boilerplate, languages found); ``odds`` are those of :func:`fit_blocks`.

    Only constructs that the cut took for markup are rewritten, each by its kind
    and language.  Headings come out as lines ``# heading``, list items as
    ``- item``, code indented by four spaces, formulas between single dollar
    signs.  A text without markup comes out as it is; '' stays ''.
    """
    t = fold(text)
    read = skeleton(t)
    if len(read) != len(t):
        # a letter whose Latin reading is longer: places must agree
        read = "".join(x if len(x) == 1 else c for c, x in ((c, skeleton(c)) for c in t))
    every = find_marks(read)
    marks, dropped = label(read, every, find_blocks(read, every) if every else (), odds)
    found = sorted({x for _, x in marks})
    if not found:
        return text, found
    r = Rewrite(t, read, marks)
    for b in dropped:
        r.whole(b.start, b.end, "\n")
    # code and formulas first: what stands in them is no construct of its own
    for m, language in marks:
        if m.kind == "code" or m.kind == "command" and r.environment(m):
            r.inside(m.start) or getattr(r, m.kind)(m, language)
        elif m.kind == "tag" and re.match(r"<(?:pre|code|nowiki|syntaxhighlight|source|script|style|ref|math|chem)\b", read[m.start : m.end], re.IGNORECASE):
            r.tag(m, language)
    for m, language in marks:
        if m.kind == "formula" and not r.inside(m.start):
            r.formula(m, language)
    if "latex" in found:
        commands = [m for m, x in marks if x == "latex" and m.kind == "command" and read[m.start + 1].isalpha() and not _KEPT.match(read[m.start : m.end]) and not _DROPPED.match(read[m.start : m.end])]
        for x in _LONG_FORMULA.finditer(read):
            if not r.inside(x.start()) and any(x.start() < m.start < x.end() for m in commands):
                r.whole(*x.span())
    for m, language in marks:
        if m.kind != "formula" and not r.inside(m.start):
            getattr(r, m.kind)(m, language)
    if "wiki" in found:
        for x in _BULLET.finditer(read):
            if not r.inside(x.start()) and r.language_near(x.start()) == "wiki":
                r.put(*x.span(), "-")
    if "latex" in found:
        for x in _TIE.finditer(read):
            if not r.inside(x.start()) and r.language_near(x.start()) == "latex":
                r.put(*x.span(), " ")
    out = re.sub(r"[ \t]+$", "", r.text(), flags=re.MULTILINE)
    return re.sub(r"\n{3,}", "\n\n", out).strip("\n"), found


def document_markup(docs: DataFrame) -> DataFrame:
    """``(doc_id, markups)`` for ``(doc_id, text)``: the languages found in each document; NULL and empty texts have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "markups": [languages(t) if t else [] for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(read, "doc_id long, markups array<string>")


def document_text(docs: DataFrame) -> DataFrame:
    """``(doc_id, markups, clean)``: every document of ``(doc_id, text)`` as clean text; NULL texts come out as ''.

    The block classifier is fitted on FIT_DOCS documents with a tag or link at most, chosen by hash.
    """
    some = docs.select("doc_id", "text").where(F.col("text").rlike(r"<[a-zA-Z]|\]\(|\[\[")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    parts = some.select("text").repartition(8).mapInPandas(lambda batches: (pd.DataFrame({"odds": [_counted(list(b["text"]))]}) for b in batches), "odds string").collect()
    odds = _pooled([r["odds"] for r in parts])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [clean_text(t or "", odds) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "markups": [x[1] for x in got], "clean": [x[0] for x in got]})

    return docs.select("doc_id", "text").mapInPandas(read, "doc_id long, markups array<string>, clean string")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return document_markup(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", F.explode("markups").alias("markup"))


def p1_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The clean text of every document that holds markup."""
    return document_text(spark.read.parquet(f"{sf}/documents.parquet")).where("size(markups) > 0").select("doc_id", "clean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_clean": p1_clean}
SQL: dict[str, str] = {}
