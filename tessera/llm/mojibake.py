"""Garbled text from a wrong character encoding: round-trip repair.

A text that was decoded in another encoding than the one it was written in is re-encoded under each candidate legacy encoding, and the
bytes are decoded strictly under the encoding that was meant: UTF-8, or one of the single- and double-byte encodings of the languages at hand. This is
done for the whole text, for each of its lines, and for the runs of characters beyond ASCII inside a line, and it is repeated for nested layers as long as the
garbling cost drops. A reading is accepted when it drops the cost by at least DROP bits below that of the text as it stands, and below that of the text's
consistent form, so that look-alike letters and wide forms are no garbling.

The cost is that of a model of letter pairs and words per language, fitted on all catalog lines and captions, whose letters and words are counted where they lie; no list of letters or words is given beforehand. Characters
that no text is written with (replacement characters, controls, unassigned code points) have the highest cost; where they remain after the round trips, the bytes are lost: the row is
garbled and not recovered.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.confusables import LOOK_ALIKES, forms

# Legacy encodings in which bytes are commonly misread, and those in which text was commonly written.
MISREAD_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "koi8_u", "cp866", "iso8859_2", "iso8859_5", "iso8859_15", "cp852", "cp1253", "cp1254")
MISREAD_WIDE = ("cp932", "gbk", "euc_kr", "big5")
WRITTEN_IN = ("cp1252", "cp1251", "koi8_r", "koi8_u", "cp1250", "iso8859_2", "cp866", "iso8859_5", "cp437", "cp850", "mac_roman")
WRITTEN_WIDE = ("euc_jp", "cp932")
#: A task that counts words sends off its counts when it holds this many of them.
COUNTED_AT_ONCE = 200_000
#: Costs of letter pairs that are summed up at once, for all languages together.
COSTS_AT_ONCE = 600_000
#: A catalog may name at most this many languages; more are an error.
MAX_LANGUAGES = 500
#: A reading is accepted when it costs at least this many bits less: one as UTF-8, which strict decoding proves, and one under another encoding.
DROP, DROP_UNPROVEN = 3.0, 8.0
#: A letter beyond ASCII that makes up less of a language's characters is none of its letters.
STRAY = 1e-4
#: Weight of what is known of the second character alone in the probability of a pair.
_BACK_OFF = 0.1
#: All lines are counted; counts of a language with more letter pairs are given as shares, for so many. Garbled words grow with the data, so that those
#: which come a fixed number of times would pass for known ones in large tables.
SHARES_OF = 250_000
#: A word is known in a language if its lines have it this often, and as often among ``SHARES_OF`` letter pairs.
KNOWN_TIMES = 5
_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^ ]+")
#: Bits of a character that a language's lines don't show.
_PLAIN, _OWN_SCRIPT, _NEW_LETTER, _RARE_SIGN, _OTHER_SCRIPT, _NEVER = 10.0, 11.0, 13.0, 18.0, 22.0, 30.0
#: A plain word costs at most this many bits more than under the language that fits it best: names say little about the language.
_NAME = 10.0
#: Bits of a capital behind a small letter.
_CASE = 6.0


def _byte_table(name: str) -> str:
    """Character of each byte; bytes that an encoding leaves open stand for the control character of their number, as lenient decoders do."""
    out = []
    for i in range(256):
        try:
            out.append(bytes([i]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(i))
    return "".join(out)


def _strict_table(name: str) -> list[str | None]:
    out: list[str | None] = []
    for i in range(256):
        try:
            out.append(bytes([i]).decode(name))
        except UnicodeDecodeError:
            out.append(None)
    return out


def never_written(ch: str) -> bool:
    """Characters that stand for lost bytes: U+FFFD, controls, surrogates, private and unassigned code points."""
    return ch == "�" or ch >= "\x7f" and unicodedata.category(ch) in ("Cc", "Cs", "Co", "Cn")


class Encodings:
    """Candidate round trips, made once per worker."""

    def __init__(self, known) -> None:
        self.known = known
        #: What UTF-8 may give: what is written, or the signs of a further layer.
        self.layer = frozenset(known).union(*map(_byte_table, MISREAD_AS))
        self.back_of = {n: {c: i for i, c in enumerate(_byte_table(n))} for n in MISREAD_AS}
        self.maps = {n: codecs.charmap_build(_byte_table(n)) for n in MISREAD_AS}
        #: Characters that no text is written with can't have been meant.
        self.meant = {n: [c if c in known else None for c in _strict_table(n)] for n in WRITTEN_IN}
        #: All characters that a byte may have been misread as.
        self.bytewise = frozenset().union(*map(_byte_table, MISREAD_AS))
        self.runs: dict[str, dict[str, str]] = {}
        self.signs: dict[str, bool] = {}
        self.sets: dict[str, list[dict[int, str]]] = {}
        self.wides: dict[str, list[str]] = {}

    def _raw(self, run: str, name: str) -> bytes | None:
        """Bytes of a run under an encoding it may have been misread in, if they may be UTF-8."""
        back = self.back_of.get(name)
        if back and not 0xC2 <= back.get(run[0], 0) <= 0xF4:  # no first byte of UTF-8
            return None
        try:
            return bytes(map(back.__getitem__, run)) if back else run.encode(name)
        except (KeyError, UnicodeEncodeError):
            return None

    def run(self, run: str) -> dict[str, str]:
        """Readings of a run of characters beyond ASCII as UTF-8, by the encoding it was misread in. Strict decoding tells UTF-8 apart; it needs two bytes at least."""
        got = self.runs.get(run)
        if got is None:
            if len(self.runs) > 200_000:
                self.runs.clear()
            got = {}
            for name in (MISREAD_AS + MISREAD_WIDE) if len(run) > 1 or run > "\u0fff" else ():
                raw = self._raw(run, name)
                if raw is None:
                    continue
                try:
                    new = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if new != run and all(c in self.layer or "\u2000" <= c <= "\u2bff" or "\u3000" <= c <= "\u9fff" or "\ufe00" <= c <= "\ufe0f" or "\uff00" <= c <= "\uffef" or c >= "\U0001f000" for c in new):
                    got[name] = new
            if any(self.known.issuperset(x) for x in got.values()):
                got = {n: x for n, x in got.items() if self.known.issuperset(x)}
            self.runs[run] = got
        return got

    def proven(self, runs: list[str]) -> bool:
        """Whether any of some runs has a reading as UTF-8, as it stands or with a space behind it that was a no-break one."""
        for r in runs:
            got = self.signs.get(r)
            if got is None:
                if len(self.signs) > 200_000:
                    self.signs.clear()
                got = self.signs[r] = bool(self.run(r) or self.run(r + "\xa0"))
            if got:
                return True
        return False

    def utf8(self, text: str) -> list[str]:
        """Readings of a whole text as UTF-8 under one encoding: each of its runs must have one."""
        runs = _RUN.findall(text)
        names = set(self.run(runs[0])) if runs else set()
        for r in runs[1:]:
            if not names:
                return []
            names &= self.run(r).keys()
        return sorted({_RUN.sub(lambda m, n=n: self.run(m[0])[n], text) for n in names})

    def legacy(self, odd: str) -> list[dict[int, str]]:
        """Translations of a set of characters from each misreading to each single-byte encoding that may have been meant; those to characters that no text is written with are left out."""
        got = self.sets.get(odd)
        if got is None:
            if len(self.sets) > 100_000:
                self.sets.clear()
            got, seen = [], {tuple(odd)}
            raws = dict.fromkeys(tuple(map(back.get, odd)) for back in self.back_of.values()) if self.bytewise.issuperset(odd) else ()  # encodings that agree on the bytes are tried once
            for raw in raws:
                if None in raw:
                    continue
                for table in self.meant.values():
                    new = tuple([table[b] for b in raw])
                    if None in new or new in seen:
                        continue
                    seen.add(new)
                    got.append(dict(zip(map(ord, odd), new)))
            self.sets[odd] = got
        return got

    def wide(self, text: str) -> list[str]:
        """Readings as double-byte text; strict decoding leaves few. Those of short texts are kept."""
        if not self.bytewise.issuperset(text):
            return []
        got = self.wides.get(text)
        if got is None:
            got = self._wide(text)
            if len(text) <= 200:
                if len(self.wides) > 20_000:
                    self.wides.clear()
                self.wides[text] = got
        return got

    def _wide(self, text: str) -> list[str]:
        out: list[str] = []
        seen = set()
        for name in MISREAD_AS:
            try:
                raw = codecs.charmap_encode(text, "strict", self.maps[name])[0]
            except UnicodeEncodeError:
                continue
            if raw in seen:
                continue
            seen.add(raw)
            for meant in WRITTEN_WIDE:
                try:
                    new = raw.decode(meant)
                except UnicodeDecodeError:
                    continue
                if new != text and new not in out and all(c in self.known or "\u3000" <= c <= "\u9fff" or "\uff00" <= c <= "\uffef" for c in new if c > "\x7f"):
                    out.append(new)
        return out


Counts = dict[str, tuple[Counter, Counter, Counter, Counter]]


def letters_of(words: Counter) -> tuple[Counter, Counter]:
    """Letter pairs and words, in small letters and without the signs around them, of words as they stand. Words that mix scripts count in their consistent form."""
    form = {ord(k): v for k, v in forms().items()}
    pairs: Counter = Counter()
    cores: Counter = Counter()
    as_often: defaultdict[int, list[str]] = defaultdict(list)
    for w, n in words.items():
        w = w.lower()
        if not w.isascii() and len(set(map(letter_script, w)) - {None}) > 1:
            w = w.translate(form)
        as_often[n].append(w)
        cores[core(w)] += n
    for n, ws in as_often.items():
        s = f" {' '.join(ws)} "
        for ab, times in Counter(zip(s, s[1:])).items():
            pairs[ab] += n * times
    return pairs, cores


def counts_of(pairs: Counter, cores: Counter) -> tuple[Counter, Counter, Counter, Counter]:
    """Counts of a language: letter pairs, first and second characters of them, known words."""
    firsts: Counter = Counter()
    singles: Counter = Counter()
    for (a, b), n in pairs.items():
        firsts[a] += n
        singles[b] += n
    share = min(1.0, SHARES_OF / max(1, sum(pairs.values())))
    pairs, firsts, singles, cores = (Counter({x: n * share for x, n in sorted(c.items())}) for c in (pairs, firsts, singles, cores))
    # words that come once or twice may be slips
    return pairs, firsts, singles, Counter({w: n for w, n in cores.items() if n >= KNOWN_TIMES and w})


def count_letters(lines: list[tuple[str, str]]) -> Counts:
    """Letter pairs, first and single characters and words of each language."""
    words: defaultdict[str, Counter] = defaultdict(Counter)
    for lang, text in lines:
        words[lang].update(text.split())
    return {lang: counts_of(*letters_of(c)) for lang, c in words.items()}


def core(w: str) -> str:
    """A word without the signs around it."""
    if w[:1].isalnum() and w[-1].isalnum():
        return w
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


def kind(ch: str) -> str:
    """Letter, digit, space or sign."""
    return "L" if ch.isalpha() else "N" if ch.isdigit() else " " if ch == " " else "S"


@lru_cache(1 << 16)
def letter_script(ch: str) -> str | None:
    """Script of a letter."""
    return Model.script(ch) if ch.isalpha() else None


class Model:
    """Cost of words in bits under the letter pairs and known words of each language."""

    def __init__(self, counts: Counts) -> None:
        self.langs = sorted(counts) or ["?"]
        #: Words and pairs whose costs are kept; fewer for more languages, so that they take some 20 MB each.
        self.limit = max(10_000, 2_400_000 // len(self.langs))
        #: Letter pairs whose costs are summed up at once.
        self.at_once = max(1000, COSTS_AT_ONCE // len(self.langs))
        none = (Counter(), Counter(), Counter(), Counter())
        self.pairs, self.firsts, self.singles = ({x: counts.get(x, none)[i] for x in self.langs} for i in range(3))
        self.totals = {x: sum(self.singles[x].values()) + 200.0 for x in self.langs}
        self.scripts = {x: {self.script(c) for c, n in self.singles[x].items() if c.isalpha() and n * 200 >= self.totals[x]} for x in self.langs}
        strays: dict[str, set[str]] = {}
        for x in self.langs:  # letters of other scripts and very rare ones are names or slips, and count as unseen
            own = self.singles[x]
            stray = {c for c, n in own.items() if c.isalpha() and c > "\x7f" and (self.script(c) not in self.scripts[x] or n < STRAY * self.totals[x] and "CJK" not in self.scripts[x])}
            strays[x] = stray
            self.singles[x] = Counter({c: n for c, n in own.items() if c not in stray})
            self.pairs[x] = Counter({ab: n for ab, n in self.pairs[x].items() if stray.isdisjoint(ab)})
        every: Counter = Counter()
        for c in self.singles.values():
            every.update(c)
        self.seen = frozenset(c for c, n in every.items() if n > 1)
        #: Characters that texts of these languages are written with: those of the lines, and common signs and Latin letters.
        self.written = self.seen | {c.upper() for c in self.seen} | frozenset("ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßŒœ“”„‘’‚«»‹›…–—€£¥§°²³µªº×÷½¼¾·•¡¿©®™№♪\xa0")
        self.sign_after: Counter = Counter()
        self.after: Counter = Counter()
        for c in self.pairs.values():
            for (x, y), n in c.items():
                self.after[kind(x)] += n
                if not y.isalpha():
                    self.sign_after[kind(x), y] += n
        #: Pairs that some language shows.
        self.shown = set().union(*self.pairs.values())
        self.known: dict[tuple[str, str], int] = {}
        self.before: dict[str, list[tuple[float, float, float]]] = {}
        self.behind: dict[str, list[float]] = {}
        self.pair_costs = np.zeros((4096, len(self.langs)))
        self.rows: dict[str, int] = {}
        self.costs = np.zeros((4096, len(self.langs)))
        #: What a known word costs less than its pairs, under each language.
        self.gain: dict[str, np.ndarray] = {}
        for i, x in enumerate(self.langs):
            words = counts.get(x, none)[3]
            total = sum(words.values()) + 200.0
            for w, n in words.items():
                if not strays[x].isdisjoint(w):
                    continue
                s = f" {w} "
                less = float(self.pair_costs[[self.pair(ab) for ab in zip(s, s[1:])]].sum(0)[i]) - (1.0 - math.log2(n / total))
                if less > 0:
                    self.gain.setdefault(w, np.zeros(len(self.langs)))[i] = less

    @staticmethod
    @lru_cache(1 << 16)
    def script(ch: str) -> str:
        name = unicodedata.name(ch, "?").split(" ")[0]
        return "CJK" if name in ("HIRAGANA", "KATAKANA", "CJK", "KATAKANA-HIRAGANA", "IDEOGRAPHIC") else name

    def _floor(self, ch: str, lang: str) -> float:
        """Bits of a letter that a language's lines don't show."""
        if ch < "\x7f":
            return _PLAIN
        s = self.script(ch)
        if s in self.scripts[lang]:
            return _OWN_SCRIPT if ch in self.seen or s == "CJK" else _NEW_LETTER
        return _OTHER_SCRIPT

    def pair(self, ab: tuple[str, str]) -> int:
        """Row of the costs of the second character behind the first, under each language. Signs are shared by the languages: they back off to what follows a character of that kind in any of them."""
        got = self.known.get(ab)
        if got is None:
            a, b = ab
            if not b.isalpha() and b != " ":
                k = kind(a)
                bases = [max(self.sign_after[k, b] / (self.after[k] + 1.0), 2.0 ** -(_NEVER if never_written(b) else _RARE_SIGN))] * len(self.langs)
            elif a.isalpha() and b.isalpha() and max(a, b) > "\x7f" and self.script(a) != self.script(b):
                bases = [2.0**-_OTHER_SCRIPT] * len(self.langs)
            else:
                bases = self.behind.get(b) or self._behind(b)
            before = self.before.get(a) or self._before(a)
            if ab in self.shown:
                out = [-math.log2(trust * self.pairs[x][ab] / f + rest * base) for x, (trust, rest, f), base in zip(self.langs, before, bases)]
            else:
                out = [-math.log2(rest * base) for (_, rest, _), base in zip(before, bases)]
            got = self.known[ab] = len(self.known)
            if got >= len(self.pair_costs):
                self.pair_costs = np.resize(self.pair_costs, (2 * got, len(self.langs)))
            self.pair_costs[got] = out
        return got

    def _behind(self, b: str) -> list[float]:
        """Probability of a letter or space by itself, under each language."""
        got = self.behind[b] = [n / self.totals[x] if (n := self.singles[x][b]) else 2.0 ** -self._floor(b, x) for x in self.langs]
        return got

    def _before(self, a: str) -> list[tuple[float, float, float]]:
        """Weight of the pairs of a first character, that of the second character alone, and how often the first one comes, under each language."""
        got = self.before[a] = []
        for x in self.langs:
            f = self.firsts[x][a]
            trust = (1 - _BACK_OFF) * f / (f + 5.0)
            got.append((trust, 1 - trust, f or 1))
        return got

    def _sums(self, words: list[str]) -> np.ndarray:
        """Costs of the pairs of some words in small letters, less what known ones gain, under each language."""
        out: list[np.ndarray] = []
        ids: list[int] = []
        starts: list[int] = []
        for w in words:
            if len(ids) >= self.at_once:
                out.append(np.add.reduceat(self.pair_costs[ids], starts))
                ids, starts = [], []
            if not ids and len(self.known) > self.limit:
                for kept in (self.known, self.before, self.behind):
                    kept.clear()
            s = f" {w} "
            own = list(map(self.known.get, zip(s, s[1:])))
            if None in own:
                own = [self.pair(x) for x in zip(s, s[1:])]
            starts.append(len(ids))
            ids += own
        out.append(np.add.reduceat(self.pair_costs[ids], starts))
        got = np.concatenate(out)
        for i, w in enumerate(words):
            if (less := self.gain.get(core(w))) is not None:
                got[i] -= less
        return got

    @staticmethod
    def _capped(costs: np.ndarray, words: list[str]) -> None:
        """Names say little about the language: cap the costs of plain words."""
        plain = [i for i, w in enumerate(words) if w.isascii()]
        if plain:
            own = costs[plain]
            costs[plain] = np.minimum(own, own.min(1, keepdims=True) + _NAME)

    def _add(self, words: list[str]) -> None:
        """Keep the costs of words."""
        got = self._sums([w.lower() for w in words])
        self._capped(got, words)
        for i, w in enumerate(words):
            if not (w.isascii() or w.islower() or w.isupper()):
                got[i] += _CASE * sum(b.isupper() and a.islower() for a, b in zip(w, w[1:]))
        at = len(self.rows)
        if (end := at + len(words)) > len(self.costs):
            self.costs = np.resize(self.costs, (max(end, 2 * len(self.costs)), len(self.langs)))
        self.costs[at:end] = got
        self.rows.update(zip(words, range(at, end)))

    def least(self, readings: list[set[str]]) -> np.ndarray:
        """For each of some sets of words in small letters, a bound below the cost of each of its words under each language: that of their pairs, without what capitals add."""
        flat = [w for ws in readings for w in ws]
        got = self._sums(flat)
        self._capped(got, flat)
        return np.minimum.reduceat(got, np.cumsum([0] + [len(ws) for ws in readings[:-1]]))

    def each(self, words: list[str]) -> np.ndarray:
        """Cost of each word under each language."""
        at = list(map(self.rows.get, words))
        if None in at:
            new = dict.fromkeys(w for w, i in zip(words, at) if i is None)
            if len(self.rows) + len(new) > self.limit:
                self.rows.clear()
                new = dict.fromkeys(words)
            self._add(list(new))
            at = list(map(self.rows.get, words))
        return self.costs[at]

    def add(self, words: list[str]) -> np.ndarray:
        return self.each(words).sum(0) if words else np.zeros(len(self.langs))

    def cost(self, text: str) -> float:
        """Garbling cost of a text: that of the language which fits best."""
        return float(self.add(_words(text)).min())


def _words(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class Repairer:
    """Round-trip repair of texts; one for each task."""

    def __init__(self, counts: Counts) -> None:
        self.model = Model(counts)
        self.enc = Encodings(self.model.written)
        self.forms = {ord(k): v for k, v in forms().items()}
        #: Latin letters as those of another script that look like them.
        self.scripts = [{ord(b): a for a, b in zip(froms, tos)} for name, (froms, tos) in LOOK_ALIKES.items() if name in ("cyrillic", "greek")]
        #: Rows of the least costs of the readings of words.
        self.least: dict[str, int] = {}
        self.bounds = np.zeros((4096, len(self.model.langs)))
        self.fine: set[str] = set()
        self.read: dict[tuple[str, str], np.ndarray] = {}

    def _least(self, words: list[str]) -> np.ndarray:
        """Least cost of any reading of each of some words, under each language."""
        at = list(map(self.least.get, words))
        if None in at:
            new = list(dict.fromkeys(w for w, i in zip(words, at) if i is None))
            if len(self.least) + len(new) > self.model.limit:
                self.least.clear()
                new = list(dict.fromkeys(words))
            step = self.model.at_once // 50
            for i in range(0, len(new), step):
                self._bound(new[i : i + step])
            at = list(map(self.least.get, words))
        return self.bounds[at]

    def _bound(self, words: list[str]) -> None:
        """Keep the least costs of words."""
        # other words of a text may change where one of them does not
        got = self.model.least([{w.translate(h).lower() for h in self.enc.legacy("".join(sorted({c for c in w if c > "\x7f"})))} | {w.lower()} for w in words])
        at = len(self.least)
        if (end := at + len(words)) > len(self.bounds):
            self.bounds = np.resize(self.bounds, (max(end, 2 * len(self.bounds)), len(self.model.langs)))
        self.bounds[at:end] = got
        self.least.update(zip(words, range(at, end)))

    def _legacy(self, text: str, touched: list[str], total: np.ndarray, cost: float) -> tuple[str, float] | None:
        """Cheapest reading of a text in which every character stands for one byte; ``total`` is what its plain words cost."""
        # no reading costs less under a language than the cheapest ones of the words apart
        if not touched or not self.enc.bytewise.issuperset(text) or cost - float((total + self._least(touched).sum(0)).min()) < DROP_UNPROVEN:
            return None
        odd = "".join(sorted({c for w in touched for c in w if c > "\x7f"}))
        hows = self.enc.legacy(odd)
        if not hows or not any(c.isalpha() for c in text):  # signs alone are of no language
            return None
        for w in touched:
            got = self.read.get((odd, w))
            if got is None:
                if len(self.read) > self.model.limit // 20:
                    self.read.clear()
                got = self.read[odd, w] = self.model.each([w.translate(h) for h in hows])
            total = total + got
        costs = total.min(1)
        at = int(costs.argmin())
        return (text.translate(hows[at]), float(costs[at])) if costs[at] < cost - DROP_UNPROVEN else None

    def _best(self, text: str, words: list[str], costs: np.ndarray, cost: float, runs: list[str], proven: bool) -> tuple[str, float] | None:
        """Cheapest other reading of a whole text that costs less. Where one as UTF-8 exists, which strict decoding proves, the others are not tried."""
        if proven:
            best = min(((new, self.model.cost(new)) for new in self.enc.utf8(text)), key=lambda x: x[1], default=None)
            if best:
                return best if best[1] < cost - DROP else None
        at = [i for i, w in enumerate(words) if not w.isascii()]
        best = self._legacy(text, [words[i] for i in at], costs.sum(0) - costs[at].sum(0), cost)
        if 3 * sum(map(len, runs)) >= len(text):  # double-byte text has at least every other byte beyond ASCII
            for new in self.enc.wide(text):
                c = self.model.cost(new)
                if c < cost - DROP_UNPROVEN and (best is None or c < best[1]):
                    best = (new, c)
        return best

    def _runs(self, text: str, cost: float) -> tuple[str, float] | None:
        """Text with other readings of its runs of characters beyond ASCII, each chosen by the cost of the words it touches.

        A space behind a run may have been a no-break one, whose byte belongs to the run.
        """
        out, at = [], 0
        for m in _RUN.finditer(text):
            if m.start() < at:
                continue
            run, end = m[0], m.end()
            options = [(run, end)] + [(x, end) for x in self.enc.run(run).values()]
            if text[end : end + 1] == " ":
                options += [(x, end + 1) for x in self.enc.run(run + "\xa0").values() if self.enc.known.issuperset(x)]
            if len(options) > 1:
                a, b = text.rfind(" ", 0, m.start()) + 1, text.find(" ", end + 1)
                left, b = text[a : m.start()], b if b >= 0 else len(text)
                run, end = min(options, key=lambda o: self.model.cost(left + o[0] + text[o[1] : b]))
            out += [text[at : m.start()], run]
            at = end
        new = "".join(out) + text[at:]
        if new == text:
            return None
        c = self.model.cost(new)
        return (new, c) if c < cost - DROP else None

    def _in_script(self, m: re.Match) -> str:
        """A word whose letters of two scripts look alike, in the letters of the other script than Latin."""
        w = m[0]
        if not w.isascii():
            plain = w.translate(self.forms)
            for table in self.scripts:
                if any(ord(c) in table for c in plain) and any(c.isalpha() and c > "\x7f" and self.model.script(c) == self.model.script(next(iter(table.values()))) for c in plain):
                    return plain.translate(table)
        return w

    def reading(self, text: str) -> str:
        """The text as it was written, or the text itself if no other reading is better."""
        now, words = text, _words(text)
        costs = self.model.each(words)
        first = now_cost = float(costs.sum(0).min())
        while True:  # layers; each must make the cost drop, so that it ends
            spans = _RUN.findall(now)
            proven = self.enc.proven(spans)
            got = self._best(now, words, costs, now_cost, spans, proven)
            runs = self._runs(now, now_cost) if proven else None
            if runs and (not got or runs[1] < got[1] - DROP):
                got = runs
            if not got:
                break
            now, now_cost = got
            words = _words(now)
            costs = self.model.each(words)
        if now == text:
            return text
        # a disguise is no garbling: its consistent form, or the same with the letters of the script that a word is in, costs less than any reading
        for plain in {text.translate(self.forms), _WORD.sub(self._in_script, text)} - {text}:
            first = min(first, self.model.cost(plain))
        return now if now_cost < first - DROP else text

    def text(self, text: str) -> tuple[str, bool, bool]:
        """(text as it was written, garbled, recovered)."""
        if text.isascii():
            return text, False, False
        return self._ended(text, self._read(text))

    def _read(self, text: str) -> str:
        """The text with the best reading of each line, or of all of them together."""
        lines = text.split("\n")
        fixed = "\n".join(line if line.isascii() else self.reading(line) for line in lines)
        if fixed != text and len(lines) > 1:  # the lines together say more about the encoding
            whole = self.reading(text)
            if whole != text and self.model.cost(whole) <= self.model.cost(fixed):
                fixed = whole
        return fixed

    def _ended(self, text: str, fixed: str) -> tuple[str, bool, bool]:
        new = set(fixed) - self.fine
        gone = set(filter(never_written, new))
        self.fine |= new - gone
        return fixed, fixed != text or bool(gone), fixed != text and not gone

    def doubtful(self, lines: list[str]) -> np.ndarray:
        """Which lines may have another reading: those with a UTF-8 one or a double-byte one that costs less, and those whose words' cheapest readings together cost less. The costs of all lines are summed up at once; for the others ``reading`` gives the line itself."""
        if not lines:
            return np.zeros(0, bool)
        out = np.zeros(len(lines), bool)
        bytewise = []  # a line with a character that no byte stands for has none but UTF-8 readings of its runs
        for i, line in enumerate(lines):
            if self.enc.proven(_RUN.findall(line)):
                out[i] = True
            elif self.enc.bytewise.issuperset(line):
                bytewise.append(i)
        if not bytewise:
            return out
        words = [_words(lines[i]) for i in bytewise]
        flat = [w for ws in words for w in ws]
        starts = np.cumsum([0] + [len(ws) for ws in words[:-1]])
        costs = self.model.each(flat)
        now = np.add.reduceat(costs, starts).min(1)
        odd = [i for i, w in enumerate(flat) if not w.isascii()]
        costs[odd] = self._least([flat[i] for i in odd])
        cheaper = now - np.add.reduceat(costs, starts).min(1) >= DROP_UNPROVEN
        for i, c, cheap in zip(bytewise, now, cheaper):
            line = lines[i]
            out[i] = cheap or 3 * sum(map(len, _RUN.findall(line))) >= len(line) and any(self.model.cost(x) < c - DROP_UNPROVEN for x in self.enc.wide(line))
        return out

    def texts(self, batch: list[str], together: int = 300_000) -> list[tuple[str, bool, bool]]:
        """``text`` of each of many, about ``together`` characters at a time."""
        out: list[tuple[str, bool, bool]] = []
        part: list[str] = []
        size = 0
        for t in batch:
            part.append(t)
            size += len(t)
            if size >= together:
                out += self._texts(part)
                part, size = [], 0
        return out + self._texts(part)

    def _texts(self, batch: list[str]) -> list[tuple[str, bool, bool]]:
        lines = [x for t in batch for x in t.split("\n") if not x.isascii()]
        flags = iter(self.doubtful(lines).tolist())
        lost = set(filter(never_written, set().union(*batch)))
        out = []
        for t in batch:
            n = sum(not x.isascii() for x in t.split("\n")) if "\n" in t else int(not t.isascii())
            read = any([next(flags) for _ in range(n)])
            out.append(self._ended(t, self._read(t)) if read else (t, not lost.isdisjoint(t), False))
        return out


_WORKER: dict[str, Repairer] = {}


def worker_repairer(name: str, shared) -> Repairer:
    """One repairer for each Python worker, which keeps the costs of the words it has seen from task to task."""
    if name not in _WORKER:
        _WORKER.clear()
        _WORKER[name] = Repairer(shared.value)
    return _WORKER[name]


_SCREEN: list[Encodings] = []


@lru_cache(200_000)
def _odd_run(run: str) -> bool:
    """Whether a run has a character that is never written or a reading as UTF-8."""
    if not _SCREEN:
        _SCREEN.append(Encodings(frozenset()))
    return any(map(never_written, run)) or bool(_SCREEN[0].run(run))


def sound(line: str) -> bool:
    """Whether a line shows no sign of garbling: no character that is never written and no reading as UTF-8."""
    return line.isascii() or "\x7f" not in line and not any(map(_odd_run, _RUN.findall(line)))


def fit(lines: list[tuple[str, str]], captions: list[tuple[str, str]] = ()) -> Counts:
    """Counts of the catalog lines and of those lines of captions that show no sign of garbling."""
    return count_letters(list(lines) + [(lang, line) for lang, text in captions for line in text.split("\n") if sound(line)])


_RESULT = T.StructType([T.StructField("repaired", T.StringType()), T.StructField("garbled", T.BooleanType()), T.StructField("recovered", T.BooleanType())])


def _labelled(catalog: DataFrame) -> DataFrame:
    return catalog.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").distinct()


def _languages(catalog: DataFrame) -> list[str]:
    """Languages that the catalog names."""
    langs = [r[0] for r in catalog.select("lang").filter("lang IS NOT NULL").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"the catalog names more than {MAX_LANGUAGES} languages")
    return sorted(langs)


def model_lines(catalog: DataFrame, per_language: int | None = None) -> list[tuple[str, str]]:
    """Labelled lines of every language; with ``per_language``, at most so many of each, chosen by a hash of the line."""
    rows = _labelled(catalog)
    _languages(rows)
    if per_language is not None:
        rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
        rows = rows.withColumn("n", rank).filter(F.col("n") <= per_language).select("lang", "text")
    return sorted((r[0], r[1]) for r in rows.collect())


def caption_lines(subtitles: DataFrame, tracks: DataFrame, langs: list[str]) -> DataFrame:
    """(lang, text) of all captions whose track is labelled with one of the languages, as often as they come."""
    label = F.substring(F.lower(F.trim("lang")), 1, 2).alias("lang")
    named = tracks.select("track_id", label).filter(F.col("lang").isin(langs))
    return subtitles.filter("text IS NOT NULL").select("track_id", "text").join(named, "track_id").select("lang", "text")


def _partial(words: dict[str, Counter]) -> pa.RecordBatch:
    """Letter pairs and words of each language with their counts."""
    rows: list[tuple[str, bool, str, int]] = []
    for lang, c in words.items():
        pairs, cores = letters_of(c)
        rows += [(lang, True, a + b, n) for (a, b), n in pairs.items()]
        rows += [(lang, False, w, n) for w, n in cores.items() if w]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _PARTIAL.types)], schema=_PARTIAL)


_PARTIAL = pa.schema([("lang", pa.string()), ("pair", pa.bool_()), ("key", pa.string()), ("n", pa.int64())])


def counted(lines: DataFrame) -> Counts:
    """``count_letters`` of all rows (lang, text, screened), in which lines of screened texts that show a sign of garbling are left out. Only letter pairs and known words come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.mojibake import COUNTED_AT_ONCE, _partial, sound

        words: defaultdict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text, screened in zip(*(c.to_pylist() for c in b.columns)):
                if not screened or sound(text):
                    words[lang].update(text.split())
                else:
                    for line in text.split("\n"):
                        if sound(line):
                            words[lang].update(line.split())
            if sum(map(len, words.values())) >= COUNTED_AT_ONCE:
                yield _partial(words)
                words.clear()
        if any(words.values()):
            yield _partial(words)

    parts = lines.select("lang", "text", "screened").mapInArrow(count, "lang string, pair boolean, key string, n long")
    total = F.sum(F.when(F.col("pair"), F.col("n"))).over(W.partitionBy("lang"))
    sums_of = parts.groupBy("lang", "pair", "key").agg(F.sum("n").alias("n")).withColumn("share", F.least(F.lit(1.0), F.lit(float(SHARES_OF)) / total))
    rows = sums_of.filter(F.col("pair") | (F.col("n") * F.col("share") >= KNOWN_TIMES)).select("lang", "pair", "key", "n").toArrow()
    sums: defaultdict[str, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    for b in rows.to_batches():
        for lang, pair, key, n in zip(*(c.to_pylist() for c in b.columns)):
            sums[lang][0 if pair else 1][(key[0], key[1]) if pair else key] = n
    return {lang: counts_of(*c) for lang, c in sorted(sums.items())}


def fitted(subtitles: DataFrame, catalog: DataFrame, tracks: DataFrame | None = None) -> Counts:
    """Model counts from all catalog lines and captions; without tracks, from the catalog alone."""
    lines = _labelled(catalog).withColumn("screened", F.lit(False))
    langs = _languages(catalog)
    if tracks is not None and langs:
        lines = lines.unionByName(caption_lines(subtitles, tracks, langs).withColumn("screened", F.lit(True)))
    return counted(lines)


def repair(df: DataFrame, text: str, counts: Counts) -> DataFrame:
    """Add ``repaired``, ``garbled`` and ``recovered`` for the texts that have a character beyond ASCII; other rows fall out.

    Null, empty and plain ASCII texts can't be garbled and give no row. Texts of any length are processed whole; repeated rows stay repeated;
    existing columns of these names are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(counts)  # letter pairs and known words
    name = uuid.uuid4().hex

    @F.pandas_udf(_RESULT)
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from tessera.llm.mojibake import worker_repairer

        r = worker_repairer(name, shared)
        for s in batches:
            # a text that is not garbled need not come back
            yield pd.DataFrame([(x if g else None, g, k) for x, g, k in r.texts(s.tolist())], columns=_RESULT.names)

    rows = df.filter(F.col(text).rlike(r"[^\x00-\x7f]")).withColumn("_fix", fix(F.col(text)))
    return rows.withColumns({c: F.coalesce("_fix.repaired", text) if c == "repaired" else F.col(f"_fix.{c}") for c in _RESULT.names}).drop("_fix")


def garbled_rows(subtitles: DataFrame, catalog: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """(sub_id, text, repaired, recovered) of the garbled rows; re-delivered rows count once."""
    rows = repair(subtitles.select("sub_id", "text"), "text", fitted(subtitles, catalog, tracks))
    return rows.filter("garbled").select("sub_id", "text", "repaired", "recovered").distinct()
