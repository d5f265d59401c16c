"""Markup residue in texts: HTML, Markdown, wiki and LaTeX markup and braced style codes become clean text with recognisable structure.

All syntaxes end in one stream of events. A first scan sets code, formulas, style codes and entities aside; the rest goes through the standard library's streaming HTML
parser, whose events write the text; tokenizers for templates, links, LaTeX, lines and emphasis then write the same kinds of events in its place. Every event leaves a mark where
it happened, so that a text holds markup exactly if an event was seen. Each tokenizer is one pass over the text with a stack of openings: spans and nesting have no limit, and the time grows with the text.

For every line the ratio of text to tags is taken and smoothed with a Gaussian kernel; the smoothed ratios fall into two clusters at a threshold. Lines in the low cluster that hold
nothing but tags, or nothing but links, as navigation does, are no content and go; where the ratios form one cluster, all lines are content.

Structure in the result: a heading is a line after "¶ ", a list item one after "• " or "1) ", a quoted line one after "│ "; code lines are indented by four spaces, inline
code stands in "⟨ ⟩", and a formula in "⟦ ⟧".
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of HTML, of subtitle formats and of wiki pages.
TAGS = frozenset(
    "a abbr article aside audio b big blockquote body br button c center cite code col dd del details div dl dt em figure font footer form gallery h1 h2 h3 h4 h5 h6 head header hr html i "
    "img input ins kbd label lang li link main mark math meta nav noinclude nowiki ol option p pre q ref references rt ruby s samp script section select small source span strike strong style sub "
    "summary sup svg table tbody td textarea tfoot th thead title tr tt u ul v var video wbr".split()
)
_BREAKS = frozenset("br p div ul ol tr table blockquote pre h1 h2 h3 h4 h5 h6 section article header footer hr dl dt dd li".split())
_HIDDEN = frozenset(("script", "style"))
# LaTeX commands of headings, and those that stand without braces.
_HEADINGS = frozenset("part chapter section subsection subsubsection paragraph subparagraph title".split())
_BARE = {"item": "• ", "ldots": "…", "dots": "…", "textbackslash": "\\", **dict.fromkeys("centering noindent newline par hline maketitle".split(), "")}
_DROPPED = frozenset("begin end label ref cite href url includegraphics usepackage documentclass".split())

#: Marks inside a text at work: a kept span's number stands between KEEP and DONE, TAG is an event, and link text stands between LINK and UNLINK.
KEEP, DONE, TAG, LINK, UNLINK = "\x02", "\x03", "\x04", "\x05", "\x06"
_MARKS = re.compile("[\x02-\x06]")
_KEPT = re.compile("\x02(\\d+)\x03")

_RAW = re.compile(
    r"""^[ \t]*(?P<fence>```+|~~~+)(?P<info>[^\n`~]*)$
    |(?P<style>\{\\(?:[^{}\n()\s]|\([^{}()\n]*\))*\}|\{[yYcCfFsSpPoH]:[^{}\n]*\})
    |\\begin\{(?P<env>verbatim|lstlisting|equation\*?|align\*?|math|displaymath|gather\*?)\}
    |\\end\{(?P<endenv>verbatim|lstlisting|equation\*?|align\*?|math|displaymath|gather\*?)\}
    |(?P<open>\\\(|\\\[)|(?P<close>\\\)|\\\])
    |(?P<dollars>\$\$)|(?P<dollar>\$)
    |(?P<tick>`+)
    |(?P<math><math\b[^<>]*>)|(?P<endmath></math>)
    |(?P<entity>&(?:\#[0-9]+|\#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)
    |(?P<less><(?![^<>]*>))
    |(?P<blank>\n[ \t]*\n)""",
    re.M | re.X,
)
_CODE_LIKE = re.compile(r"[A-Za-z]\w*[_(\[.]\w*")
_UNFINISHED = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*=[^<>]*)?\Z")
_LINK_TARGET = re.compile(r"\((?:[^()\s]|\([^()\s]*\))+(?:\s+\"[^\"\n]*\")?\)")
_OPEN_TARGET = re.compile(r"\((?:https?|ftp)://[^()\s]*")
_EXTERNAL = re.compile(r"\[(?:https?|ftp)://[^\s\[\]]+(?: ([^\[\]\n]*))?\]")
_NO_PAGE = re.compile(r"(?:File|Image|Category|Datei|Bild|Kategorie|Fichier|Catégorie|Archivo|Categoría):", re.I)
_LATEX = re.compile(r"\\(?P<cmd>[a-zA-Z]+)\*?(?:\[[^\[\]\n]*\])?(?P<brace>\{)?|\{\\(?P<decl>[a-zA-Z]+\d*)(?![a-zA-Z{])\s?|(?P<open>\{)|(?P<close>\})|(?P<br>\\\\(?=\s|$))")
_MD_HEAD = re.compile(r"^ {0,3}(#(?= +\D)|#{2,6}) +(\S.*?)(?: +#+)?\s*$")
_MD_QUOTE = re.compile(r"^ {0,3}>(?: |$)(.*)$")
_MD_STAR = re.compile(r"^\s*[*+] +(?=[^\s*+])(.*)$")
_MD_NUMBER = re.compile(r"^\s*(\d{1,3})\. +(\S.*)$")
_WIKI_OPEN = re.compile(r"^(={2,6})(?= *[^=\s])")
_WIKI_CLOSE = re.compile(r"(?<=[^=\s]) *(={2,6})\s*$")
_WIKI_ITEM = re.compile(r"^([*#]{1,4})(?=[^\s*#\d])(.*)$")
_WIKI_TABLE = re.compile(r"^(\{\||\|\}|\|-|! )")
_RULE = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$")
_UNDERLINE = re.compile(r"^={3,}\s*$")
_EMPHASIS = re.compile(r"\*+|_+|~~+|'{2,}|\n[ \t]*\n")
#: A text with none of these signs holds no markup.
CANDIDATE = r"[<&{}\\`~*]|\[\[|\]\]|\]\(|''|_\w|\w_|\$[^$]*\$|\[https?:|\[ftp:|(?m:^ {0,3}(#|>|=|\||\d{1,3}\. |\+ ))"


def _apply(t: str, edits: list[tuple[int, int, str]]) -> str:
    """Text with stretches replaced; what lies inside a replaced stretch is not edited again."""
    out, at = [], 0
    for a, b, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if a >= at:
            out += [t[at:a], new]
            at = b
    return "".join(out) + t[at:]


class Raw:
    """First scan: code, formulas, style codes and entities are set aside; the rest stays as text for the parser."""

    def __init__(self) -> None:
        self.kept: list[str] = []

    def keep(self, s: str, tag: bool = True) -> str:
        self.kept.append(s)
        return f"{TAG if tag else ''}{KEEP}{len(self.kept) - 1}{DONE}"

    def _lines(self, s: str) -> str:
        return self.keep("\n".join("    " + x for x in s.strip("\n").split("\n")))

    def scan(self, t: str) -> str:
        tokens = list(_RAW.finditer(t))
        places: dict[str, list[int]] = defaultdict(list)  # tokens that can close something, by what they close
        names = []
        for i, m in enumerate(tokens):
            kind = m.lastgroup if m.lastgroup != "info" else "fence"
            name = kind
            if kind == "fence":
                name = m["fence"] if not m["info"].strip() else ""
            elif kind == "tick":
                name = m[0]
            elif kind == "endenv":
                name = "end " + m["endenv"]
            elif kind == "close":
                name = m[0]
            names.append(kind)
            places[name].append(i)

        def after(name: str, i: int) -> int | None:
            at = places[name]
            k = bisect_right(at, i)
            return at[k] if k < len(at) else None

        edits = []
        skip = -1
        for i, m in enumerate(tokens):
            if m.start() < skip:
                continue
            kind, j, new, end = names[i], None, None, m.end()
            if kind == "fence":
                j = after(m["fence"], i)
                body = t[m.end() : tokens[j].start() if j is not None else len(t)]
                if body.strip("\n"):
                    new, end = "\n" * (m.start() > 0 and t[m.start() - 1] != "\n") + self._lines(body), tokens[j].end() if j is not None else len(t)
                else:
                    new = TAG
            elif kind == "style":
                new = TAG
            elif kind == "env":
                j = after("end " + m["env"], i)
                if j is not None:
                    body, end = t[m.end() : tokens[j].start()], tokens[j].end()
                    new = self._lines(body) if m["env"] in ("verbatim", "lstlisting") else self.keep(f"⟦{body.strip()}⟧")
            elif kind == "open":
                j = after("\\)" if m[0] == "\\(" else "\\]", i)
                new = TAG
                if j is not None:
                    new, end = self.keep(f"⟦{t[m.end() : tokens[j].start()].strip()}⟧"), tokens[j].end()
            elif kind == "close":
                new = TAG
            elif kind == "dollars":
                j = after("dollars", i)
                if j is not None and t[m.end() : tokens[j].start()].strip():
                    new, end = self.keep(f"⟦{t[m.end() : tokens[j].start()].strip()}⟧"), tokens[j].end()
            elif kind == "dollar":
                j = after("dollar", i)
                if j is not None:
                    n, body = tokens[j], t[m.end() : tokens[j].start()]
                    opens = body[:1].strip() and not (m.start() and (t[m.start() - 1] in "\\$" or _wordish(t[m.start() - 1])))
                    closes = body[-1:].strip() and not _wordish(t[n.end() : n.end() + 1])
                    if opens and closes and "\n" not in body and any(c in body for c in "\\^_{"):
                        new, end = self.keep(f"⟦{body.strip()}⟧"), n.end()
            elif kind == "tick":
                j, blank = after(m[0], i), after("blank", i)
                before, behind = t[m.start() - 1 : m.start()] if m.start() else "", t[m.end() : m.end() + 1]
                if j is not None and (blank is None or j < blank) and not (before.isascii() and before.isalnum()):
                    n = tokens[j]
                    body, next_one = t[m.end() : n.start()], t[n.end() : n.end() + 1]
                    if body.strip() and not (next_one.isascii() and next_one.isalnum()):
                        new, end = self.keep(f"⟨{body.strip()}⟩"), n.end()
                if new is None and (_CODE_LIKE.match(t, m.end()) or behind == "" and before in tuple(")]_")):
                    new = TAG  # an opening or an end of code whose other one is missing
            elif kind == "math":
                j = after("endmath", i)
                if j is not None:
                    new, end = self.keep(f"⟦{t[m.end() : tokens[j].start()].strip()}⟧"), tokens[j].end()
            elif kind == "entity":
                name = m[0][1:]
                if name[0] == "#" or name in html5:
                    new = self.keep(html.unescape(m[0]))
            elif kind == "less":
                if (u := _UNFINISHED.match(t, m.start())) and u[1].lower() in TAGS and (t[m.start() + 1] == "/" or "=" in u[0]):
                    new, end = TAG, len(t)  # a tag that is cut off
                else:
                    new = self.keep("<", tag=False)
            if new is not None:
                edits.append((m.start(), end, new))
                skip = end
        return _apply(t, edits)


class Events(HTMLParser):
    """Parser events written as text with marks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.hidden = 0
        self.lists: list[int | None] = []
        self.pre = 0

    def _put(self, s: str) -> None:
        if self.hidden:
            s = "".join(c for c in s if c == TAG)
        if s:
            self.out.append(s)

    def _newline(self) -> None:
        for s in reversed(self.out):
            if s := s.rstrip("\x04\x05\x06"):
                if s[-1] != "\n":
                    self._put("\n")
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in TAGS:
            self._put(self.get_starttag_text() or "")
            return
        self.out.append(TAG)
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in _BREAKS:
            if tag == "br":
                self._put("\n")
            else:
                self._newline()
            if tag in ("ul", "ol"):
                self.lists.append(0 if tag == "ol" else None)
            elif tag == "li":
                if self.lists and self.lists[-1] is not None:
                    self.lists[-1] += 1
                    self._put(f"{self.lists[-1]}) ")
                else:
                    self._put("• ")
            elif tag[0] == "h" and tag[1:].isdigit():
                self._put("¶ ")
            elif tag == "pre":
                self.pre += 1
                self._put("    ")
        elif tag == "code" and not self.pre:
            self._put("⟨")
        elif tag == "a":
            self._put(LINK)
        elif tag in ("td", "th"):
            self._put(" ")

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag not in TAGS:
            self._put(self.get_starttag_text() or "")
            return
        self.out.append(TAG)
        if tag in _BREAKS:
            self._put("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag not in TAGS:
            self._put(f"</{tag}>")
            return
        self.out.append(TAG)
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BREAKS and tag != "br":
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            if tag == "pre":
                self.pre = max(0, self.pre - 1)
            self._newline()
        elif tag == "code" and not self.pre:
            self._put("⟩")
        elif tag == "a":
            self._put(UNLINK)

    def handle_data(self, data: str) -> None:
        self._put(data.replace("\n", "\n    ") if self.pre else data)

    def handle_entityref(self, name: str) -> None:
        self._put("&" + name)

    def handle_charref(self, name: str) -> None:
        self._put(TAG + html.unescape(f"&#{name};"))

    def handle_comment(self, data: str) -> None:
        self.out.append(TAG)

    def unknown_decl(self, data: str) -> None:
        self._put(f"<![{data}]>")

    def handle_decl(self, decl: str) -> None:
        self.out.append(TAG)


def _wordish(c: str) -> bool:
    """Letters and digits of scripts that part words; in others a sign of emphasis stands right between letters."""
    return c.isalnum() and not "⺀" <= c <= "鿿" and not "가" <= c <= "힣" and not "฀" <= c <= "๿"


def templates(t: str) -> str:
    """``{{...}}`` goes, however nested; an opening or an end without the other one goes too where it touches a word."""
    edits, stack = [], []
    for m in re.finditer(r"\{\{|\}\}", t):
        if m[0] == "{{":
            stack.append(m.start())
        elif stack:
            edits.append((stack.pop(), m.end(), TAG))
        elif m.start() and _wordish(t[m.start() - 1]):
            edits.append((m.start(), m.end(), TAG))
    edits += [(a, a + 2, TAG) for a in stack if _wordish(t[a + 2 : a + 3])]
    return _apply(t, edits)


def wiki_links(t: str) -> str:
    """``[[page|label]]`` becomes its label; links to files and categories go."""
    edits, stack = [], []
    for m in re.finditer(r"\[\[|\]\]|\|", t):
        if m[0] == "[[":
            stack.append([m.start(), None])
        elif m[0] == "|":
            if stack:
                stack[-1][1] = m.end()
        elif stack:
            a, bar = stack.pop()
            if _NO_PAGE.match(t, a + 2):
                edits.append((a, m.end(), TAG))
            else:
                edits += [(a, bar or a + 2, TAG), (m.start(), m.end(), TAG)]
        elif m.start() and _wordish(t[m.start() - 1]):
            edits.append((m.start(), m.end(), TAG))
    edits += [(a, a + 2, TAG) for a, _ in stack if t[a + 2 : a + 3].isalnum()]
    return _apply(t, edits)


def links(t: str) -> str:
    """``[text](target)``, ``![text](target)`` and ``[http://target text]`` become their text."""
    t = _EXTERNAL.sub(lambda m: TAG + LINK + (m[1] or "") + UNLINK, t)
    edits, stack = [], []
    for m in re.finditer(r"[\[\]\n]", t):
        if m[0] == "\n":
            if t[m.end() : m.end() + 1] == "\n":
                stack.clear()
        elif m[0] == "[":
            stack.append(m.start())
        else:
            a = stack.pop() if stack else None
            full = _LINK_TARGET.match(t, m.end())
            target = full or _OPEN_TARGET.match(t, m.end())
            if target and (a is not None or target[0].startswith(("(http", "(ftp"))):
                if a is not None:
                    edits.append((a - (t[a - 1 : a] == "!"), a + 1, TAG + LINK))
                edits.append((m.start(), target.end(), UNLINK if a is not None else TAG))
    return _apply(t, edits)


def latex(t: str) -> str:
    """Commands go, their arguments stay; headings, items and environments become structure."""
    if "\\" not in t:
        return t
    edits, stack = [], []
    for m in _LATEX.finditer(t):
        cmd = m["cmd"]
        if cmd and m["brace"] and (len(cmd) > 1):
            if stack and stack[-1][0] == "arg?" and stack[-1][2] != m.start():
                stack.pop()
            stack.append((cmd, m.start(), m.end()))
        elif cmd and cmd in _BARE:
            end = m.end() + (t[m.end() : m.end() + 1] == " " and cmd in ("item", "centering", "noindent", "par", "newline"))
            edits.append((m.start(), end, TAG + _BARE[cmd]))
            if m["brace"]:
                stack.append(("arg", m.end() - 1, m.end()))
        elif cmd:
            if m["brace"]:
                stack.append(("{", m.end() - 1, m.end()))
        elif m["decl"]:
            stack.append(("decl", m.start(), m.end()))
        elif m["open"]:
            follows = stack and stack[-1][0] == "arg?" and stack[-1][2] == m.start()
            if stack and stack[-1][0] == "arg?":
                stack.pop()
            stack.append(("arg" if follows else "{", m.start(), m.end()))
        elif m["close"]:
            if stack and stack[-1][0] == "arg?":
                stack.pop()
            if not stack:
                continue
            what, a, b = stack.pop()
            if what == "{":
                continue
            if what in _HEADINGS:
                edits += [(a, b, TAG + "¶ "), (m.start(), m.end() + (t[m.end() : m.end() + 1] in ("\n", " ")), "\n")]
            elif what in _DROPPED:
                edits.append((a, m.end() + (t[m.end() : m.end() + 1] == "\n" and what in ("begin", "end")), TAG))
            else:
                edits += [(a, b, TAG), (m.start(), m.end(), "")]
            if what not in ("decl",):
                stack.append(("arg?", 0, m.end()))
        elif m["br"]:
            edits.append((m.start(), m.end(), TAG))
    for what, a, b in stack:  # openings without an end
        if what not in ("{", "arg", "arg?"):
            edits.append((a, b, TAG + ("¶ " if what in _HEADINGS else "")))
    return _apply(t, edits)


def line_structure(t: str) -> str:
    """Headings, quotes, list items and tables, which lines begin with."""
    rows = t.split("\n")
    bare = [_MARKS.sub("", r) if _MARKS.search(r) else r for r in rows]
    numbered = [_MD_NUMBER.match(r) for r in bare]
    ordered = sum(m is not None for m in numbered) > 1
    stars = sum(_MD_STAR.match(r) is not None for r in bare)
    wiki_table = sum(_WIKI_TABLE.match(r) is not None for r in bare) > 1
    ruled = any(_RULE.match(r) for r in bare)
    closes: dict[str, list[int]] = defaultdict(list)
    for i, r in enumerate(bare):
        if m := _WIKI_CLOSE.search(r):
            closes[m[1]].append(i)
    out: list[str] = []
    until = -1
    for i, (row, r) in enumerate(zip(rows, bare)):
        tags = "".join(c for c in row if c == TAG)
        if i <= until:  # last line of a heading over several lines
            out.append(tags + (_WIKI_CLOSE.sub("", r) if i == until else r))
        elif m := _WIKI_OPEN.match(r):
            at = closes[m[1]]
            k = bisect_right(at, i - 1)
            until = at[k] if k < len(at) else i
            head = r[m.end() :].strip()
            out.append(TAG + tags + "¶ " + (_WIKI_CLOSE.sub("", head) if until == i else head))
        elif _UNDERLINE.match(r) and out and bare[i - 1].strip():
            out[-1] = TAG + "¶ " + out[-1]
        elif (m := _WIKI_CLOSE.search(r)) and r[m.start() : m.start() + 1] == " " and len(m[1]) == 2:
            out.append(TAG + tags + "¶ " + r[: m.start()])  # a heading whose opening is missing
        elif m := _MD_HEAD.match(r):
            out.append(TAG + tags + "¶ " + m[2])
        elif m := _MD_QUOTE.match(r):
            out.append(TAG + tags + ("│ " + m[1]).rstrip())
        elif (m := _MD_STAR.match(r)) and (stars > 1 or r.lstrip()[0] == "*" and len(m[1]) > 1):
            out.append(TAG + tags + "• " + m[1])
        elif ordered and (m := numbered[i]):
            out.append(f"{TAG}{tags}{m[1]}) {m[2]}")
        elif wiki_table and _WIKI_TABLE.match(r):
            out.append(TAG + tags + re.sub(r"^(\{\||\|\}|\|-|! ).*?$|\|\|", " ", r))
        elif ruled and "|" in r:
            out.append(TAG + tags + ("" if _RULE.match(r) else r.strip().strip("|").replace("|", " ").strip()))
        elif (m := _WIKI_ITEM.match(r)) and m[2].strip() and m[1] not in m[2]:
            out.append(TAG + tags + "• " + m[2].strip())
        else:
            out.append(row)
    return "\n".join(out)


def emphasis(t: str) -> str:
    """Pairs of signs of emphasis go; stacks of openings by sign, emptied at blank lines. Strong signs without the other one go too where they touch a longer word."""
    edits: list[tuple[int, int, str]] = []
    stacks: dict[str, list[tuple[int, int]]] = defaultdict(list)

    def loose() -> None:
        for sign, stack in stacks.items():
            for a, n in stack:
                if (sign in "*~" and n == 2 or sign == "'" and n == 3) and t[a + n : a + n + 3].isalpha() and len(t[a + n : a + n + 3]) == 3:
                    edits.append((a, a + n, TAG))
            stack.clear()

    for m in _EMPHASIS.finditer(t):
        if m[0][0] == "\n":
            loose()
            continue
        sign, n, a = m[0][0], len(m[0]), m.start()
        before, behind = t[a - 1 : a] if a else "", t[m.end() : m.end() + 1]
        opens = bool(behind.strip()) and not _wordish(before)
        shuts = bool(before.strip()) and not _wordish(behind)
        stack = stacks[sign]
        if shuts and stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][1] != n:
                k -= 1
            if k >= 0 and (stack[k][0] + n < a):
                edits += [(stack[k][0], stack[k][0] + n, TAG), (a, m.end(), "")]
                del stack[k:]
                continue
            if sign == "*" and n > stack[-1][1] and len(stack) > 1 and stack[-1][1] + stack[-2][1] == n:
                edits += [(p, p + w, TAG) for p, w in stack[-2:]] + [(a, m.end(), "")]
                del stack[-2:]
                continue
        if opens and n <= (5 if sign == "'" else 3):
            if len(stack) > 64:  # runs of different lengths only, none of which found its end
                stack[:] = [x for i, x in enumerate(stack) if x[1] not in {y[1] for y in stack[i + 1 :]}]
            stack.append((a, n))
        elif shuts and (sign in "*~" and n == 2 or sign == "'" and n == 3) and t[max(0, a - 3) : a].isalpha() and a >= 3:
            edits.append((a, m.end(), TAG))
    loose()
    return _apply(t, edits)


def content_lines(lines: list[str]) -> list[bool]:
    """Which lines are content: text-to-tag ratios, smoothed with a Gaussian and split at the threshold between two clusters."""
    n = len(lines)
    count = np.array([x.count(TAG) for x in lines], float)
    if not count.any():
        return [True] * n
    text = [_KEPT.sub("x", x) for x in lines]
    own = np.array([len(_MARKS.sub("", x).strip(" \t•¶│")) for x in text], float)
    linked = np.array([LINK in x and not re.sub("\x05[^\x06]*\x06?", "", x).strip(" \t•¶│|·-\x04\x06") for x in text])
    ratio = own / np.maximum(count, 1)
    x = np.arange(-2, 3)
    kernel = np.exp(-(x**2) / 2.0)
    kernel /= kernel.sum()
    smooth = np.convolve(np.pad(ratio, 2, mode="edge"), kernel, "valid")
    low, high = smooth.min(), smooth.max()
    for _ in range(20):  # two clusters on a line
        cut = (low + high) / 2
        under = smooth <= cut
        if under.all() or not under.any():
            break
        a, b = smooth[under].mean(), smooth[~under].mean()
        if (a, b) == (low, high):
            break
        low, high = a, b
    cut = (low + high) / 2
    one = low == high or n == 1
    return [bool(c == 0 or one or s > cut or (o > 0 and not k)) for o, c, s, k in zip(own, count, smooth, linked)]


def clean(text: str) -> tuple[str, bool]:
    """(clean text, whether it held markup). Entities are decoded once; what they spell is not read as markup again."""
    raw = Raw()
    t = raw.scan(_MARKS.sub("", text))
    if "<" in t or "&" in t:
        events = Events()
        events.feed(t)
        events.close()
        t = "".join(events.out)
    if "{{" in t or "}}" in t:
        t = templates(t)
    if "[" in t or "]" in t:
        t = links(wiki_links(t))
    t = emphasis(line_structure(latex(t)))
    if TAG not in t:
        return text, False
    lines = t.split("\n")
    t = _MARKS_LEFT.sub("", "\n".join(x for x, ok in zip(lines, content_lines(lines)) if ok))
    t = _KEPT.sub(lambda m: raw.kept[int(m[1])], t)
    t = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", t))
    return t.strip("\n").rstrip(), True


_MARKS_LEFT = re.compile("[\x04-\x06]")
_RESULT = T.StructType([T.StructField("clean", T.StringType()), T.StructField("marked", T.BooleanType())])


@F.pandas_udf(_RESULT)
def _clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([clean(t) for t in s], columns=_RESULT.names)


def strip_markup(df: DataFrame, text: str) -> DataFrame:
    """Rows with markup, with ``clean`` added: the text without it. Rows without any of its signs are not sent to Python.

    Null and empty texts hold none and fall out; texts of any length and nesting are processed whole; repeated rows stay repeated; an existing column ``clean`` is replaced.
    """
    rows = df.filter(F.col(text).rlike(CANDIDATE)).withColumn("_m", _clean(F.col(text)))
    return rows.filter("_m.marked").withColumn("clean", F.col("_m.clean")).drop("_m")
