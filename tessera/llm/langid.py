"""Document language by compression: per-language zstandard dictionaries, smallest encoding wins.

For every language a raw-content dictionary is fitted on a bounded sample of labelled rows: lines of the clean caption catalog give a first dictionary, with which the sentences
of labelled documents are checked; those that agree with their label make up the final one. Each sentence of a text is encoded with
the dictionary of each language of its script, and with one of each other script where its script has a single language; the language with the smallest encoding is chosen.
When the margin is narrow the choice is rejected: the sentence takes the language that prevails in its text, if that is among the near ones and its margin over the whole text is
not narrow itself, and else it has no language. Neighbouring sentences of one language form a segment.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the fit, for each language: labelled documents that are read, chosen by a hash of their number; characters they have together, the last of them counted whole;
#: catalog lines, chosen by a hash; and bytes of the dictionary.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 2_000_000
CATALOG_LINES = 500
DICTIONARY_BYTES = 24_000
#: More languages than this are an error.
MAX_LANGUAGES = 500
#: Level of compression; higher ones cost more and hardly ever choose otherwise.
LEVEL = 3
#: A margin is narrow below this many bytes or this share of the encoding.
MARGIN_BYTES, MARGIN_SHARE = 2, 0.06
#: A sentence is in another language than the one that prevails in its text only if that language's encoding is shorter by more than this share.
SWITCH_SHARE = 0.1
#: A sentence of a labelled document is left out of the fit if another language's encoding is shorter by this share.
FOREIGN_SHARE = 0.3
#: Every dictionary ends with these signs and every sentence is encoded behind them: an encoder that has matched them has paid its fixed cost,
#: so that a match of a few letters shows in the size of even the shortest sentence.
_NEUTRAL = b"<0#1%2$3&4*5+6=7>8@9^0~1|2}3{4]5[6>7_8-9;0:1/2<3#4%5$6&7*8+9=0>"

_SENTENCE = re.compile(r"[^.!?。！？…\n]+(?:[.!?。！？…]+[\"”»“)）’]*)?")
_ENDED = re.compile(r"[.!?。！？…][\"”»“)）’]*\s*$")
_PHRASE = re.compile(r"[(（]?[„“\"«][^„“”\"»«]*[“”\"»][)）]?")
_LETTER = re.compile(r"[^\W\d_]")
_CYRILLIC, _JAPANESE = re.compile(r"[Ѐ-ӿ]"), re.compile(r"[぀-ヿ一-鿿]")


def script_of(s: str) -> str | None:
    """Script of most letters of a sentence; None if it has no letters to speak of."""
    if s.isascii():
        return "Latin" if sum(map(str.isalpha, s)) > 1 else None
    n = len(_LETTER.findall(s))
    if n < 2:
        return None
    cyr, jap = len(_CYRILLIC.findall(s)), len(_JAPANESE.findall(s))
    if jap * 3 >= n:  # a sign of these says more than a letter
        return "Japanese"
    return "Cyrillic" if cyr * 5 >= n * 2 else "Latin"


class Classifier:
    """Sizes of a sentence under each language's dictionary."""

    def __init__(self, contents: dict[str, bytes], scripts: dict[str, str]) -> None:
        self.by_script: dict[str, list] = defaultdict(list)
        for lang, content in sorted(contents.items()):
            d = zstd.ZstdCompressionDict(content + _NEUTRAL, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            c = zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.by_script[scripts[lang]].append((lang, c))
        #: What a sentence of a script is encoded with: a language that is alone in its script is compared with one of each other script.
        self.rivals = {x: own if len(own) > 1 else own + [other[0] for y, other in self.by_script.items() if y != x] for x, own in self.by_script.items()}

    def sizes(self, s: str) -> list[tuple[int, str]]:
        """(bytes, language), smallest first; empty for a sentence without words or in a script of no language."""
        rivals = self.rivals.get(script_of(s) or "")
        if not rivals:
            return []
        raw = _NEUTRAL + s.encode("utf-8", "replace")
        return sorted((len(c.compress(raw)), lang) for lang, c in rivals)


def narrow(best: int, other: int, share: float = MARGIN_SHARE) -> bool:
    return other - best < max(MARGIN_BYTES, share * other)


def segments(text: str, model: Classifier) -> list[tuple[int, int, str | None, float, bool]]:
    """(start, end, language, confidence, whole) of the segments of a text.

    whole: the segment has a sentence that is complete; if the text has none, every segment counts as whole. Wordless stretches give no segment.
    """
    found = []
    for m in _SENTENCE.finditer(text):
        s = m[0]
        core = _PHRASE.sub(" ", s)
        if core is not s and len(_LETTER.findall(core)) < 5:
            core = s
        core = core.strip()
        sizes = model.sizes(core)
        if not sizes:
            continue
        head = s.lstrip(" \t(（\"“„«—–-♪")
        whole = bool(_ENDED.search(s)) and not (m.start() == 0 and head[:1].islower())
        found.append((m.start(), m.end(), sizes, len(core), whole))
    if not found:
        return []
    weight: Counter = Counter()
    for _, _, sizes, n, _ in found:
        weight[sizes[0][1]] += n * (1 if len(sizes) == 1 or not narrow(sizes[0][0], sizes[1][0]) else 0.1)
    main = max(sorted(weight), key=lambda x: weight[x])
    pooled: Counter = Counter()
    times: Counter = Counter()
    for _, _, sizes, _, _ in found:
        if any(x == main for _, x in sizes):
            for size, x in sizes:
                pooled[x] += size
                times[x] += 1
    rest = [pooled[x] for x in pooled if x != main and times[x] == times[main]]
    sure = not rest or not narrow(pooled[main], min(rest))
    anyone = any(w for *_, w in found)
    out: list[tuple[int, int, str | None, float, bool]] = []
    for a, b, sizes, n, whole in found:
        best, lang = sizes[0]
        by = {x: size for size, x in sizes}
        if lang != main and main in by and narrow(best, by[main], SWITCH_SHARE):
            best, lang = by[main], main
        other = min((size for size, x in sizes if x != lang), default=None)
        if other is None:
            conf = 1.0
        else:
            conf = max(0.0, (other - best) / other)
            if narrow(best, other) and (lang != main or not sure):
                lang = None
        whole = whole or not anyone
        if out and out[-1][2] == lang:
            p = out[-1]
            share = (p[3] * (p[1] - p[0]) + conf * (b - a)) / (b - p[0])
            out[-1] = (p[0], b, lang, share, p[4] or whole)
        else:
            out.append((a, b, lang, conf, whole))
    return out


def label_code(lang: Column, codes: list[str]) -> Column:
    """Language that a label names: its first two letters, ignoring case and surrounding blanks; null if they name none."""
    two = F.substring(F.lower(F.trim(lang)), 1, 2)
    return F.when(two.isin(codes), two)


def _common_words(sentences: list[str]) -> Counter:
    """Sentences without their rare words, which are names more often than not, and how often each comes."""
    words = Counter(w for s in sentences for w in s.split())
    rare = 1 + len(sentences) // 500
    if words.total() < 2 * len(sentences):  # words are not parted by blanks
        rare = 0
    short = (" ".join(w for w in s.split() if words[w] > rare) for s in sentences)
    return Counter(t for t in short if t)


def _content(seen: dict[str, int], size: int) -> bytes:
    """Dictionary of a language, the commonest sentences last."""
    content = b""
    for t in sorted(seen, key=lambda t: (-seen[t], t)):
        raw = t.encode() + b" "
        if len(content) + len(raw) > size:
            break
        content = raw + content
    return content


def fit(documents: DataFrame, catalog: DataFrame, languages: DataFrame) -> tuple[dict[str, bytes], dict[str, str]]:
    """Dictionary content and script of each language. All samples are bounded by the parameters above, and are the same for the same table."""
    listed = languages.filter("lang IS NOT NULL").select("lang", "script").limit(MAX_LANGUAGES + 1).collect()
    if len(listed) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    scripts = {r[0]: r[1] for r in listed}
    codes = sorted(scripts)
    if not codes:
        return {}, {}
    lines = defaultdict(list)
    named = catalog.filter("text IS NOT NULL").select(label_code(F.col("lang"), codes).alias("l"), "text").filter("l IS NOT NULL").distinct()
    rank = F.row_number().over(W.partitionBy("l").orderBy(F.xxhash64("text"), "text"))
    for lang, text in named.withColumn("n", rank).filter(F.col("n") <= CATALOG_LINES).select("l", "text").orderBy("l", "text").collect():
        lines[lang].append(text)
    # the same number of documents of each language: a share by hash of about three times as many, so that no more than these are shuffled, and then the first ones
    labelled = documents.select(label_code(F.col("lang"), codes).alias("l"), "text", F.xxhash64("doc_id").alias("h")).filter("l IS NOT NULL AND text IS NOT NULL")
    counts = {r[0]: r[1] for r in labelled.groupBy("l").count().collect()}  # as many rows as languages
    span = 1 << 30
    share = F.create_map(*(F.lit(y) for x, n in counts.items() for y in (x, min(span, span * 3 * SAMPLE_DOCS // n + 1)))) if counts else None
    some = labelled.filter(F.pmod("h", F.lit(span)) < share[F.col("l")]) if counts else labelled.limit(0)
    w = W.partitionBy("l").orderBy("h", "text")
    some = some.withColumn("n", F.row_number().over(w)).withColumn("c", F.sum(F.length("text").cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.length("text"))
    sample = some.filter((F.col("n") <= SAMPLE_DOCS) & (F.col("c") < SAMPLE_CHARS)).select("l", "text").orderBy("l", "h").collect()
    first = {x: "\n".join(lines[x]).encode() for x in codes if lines[x]}
    if not first:  # no catalog: the labels alone
        first = {x: " ".join(t for lang, t in sample if lang == x).encode()[-DICTIONARY_BYTES:] for x in codes}
        first = {x: c for x, c in first.items() if c}
    contents = first
    for _ in range(2):  # the second round knows the phrases that the catalog lacks
        model = Classifier(contents, scripts)
        good = defaultdict(list)
        for lang, text in sample:
            found = [(m[0].strip(), sizes) for m in _SENTENCE.finditer(text) if (sizes := model.sizes(_PHRASE.sub(" ", m[0]).strip()))]
            votes: Counter = Counter()
            for s, sizes in found:
                votes[sizes[0][1]] += len(s)
            if not votes or max(sorted(votes), key=lambda x: votes[x]) != lang:
                continue  # another language prevails than the label says
            for s, sizes in found:
                own = next((size for size, x in sizes if x == lang), None)
                if own is not None and own - sizes[0][0] < FOREIGN_SHARE * own:
                    good[lang].append(_PHRASE.sub(" ", s))
        seen = {x: _common_words(good[x]) for x in first}
        most: Counter = Counter()
        for c in seen.values():
            most |= c
        # what comes in texts of several languages belongs to the one that has it most often
        trimmed = {x: _content({t: n for t, n in c.items() if n == most[t]}, DICTIONARY_BYTES) for x, c in seen.items()}
        contents = {x: c + first[x] if len(c) < DICTIONARY_BYTES // 2 else c for x, c in trimmed.items()}
    return contents, scripts


_SEGMENT = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("lang", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("whole", T.BooleanType()),
    ]
)


def identify(df: DataFrame, text: str, contents: dict[str, bytes], scripts: dict[str, str], out: str = "segments") -> DataFrame:
    """Add array ``out`` of segments (start, end, lang, confidence, whole), offsets in characters.

    Null, empty and wordless texts have an empty array; a segment whose margin is narrow has a null language. Texts of any length are processed
    whole; rows stay as they are, repeated ones too.
    """

    @F.pandas_udf(T.ArrayType(_SEGMENT))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Classifier(contents, scripts)
        names = _SEGMENT.names
        for s in batches:
            yield pd.Series([[dict(zip(names, x)) for x in segments(t, model)] if t else [] for t in s], dtype=object)

    return df.withColumn(out, run(F.col(text)))


def languages_of(segs: str = "segments") -> Column:
    """Languages in which a text has a whole sentence."""
    return F.expr(f"array_sort(array_distinct(transform(filter({segs}, x -> x.whole AND x.lang IS NOT NULL), x -> x.lang)))")
