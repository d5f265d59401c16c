"""Visually identical text with different characters: one consistent form for comparison.

Texts are exploded to positioned code points. The decomposition table, built from the Unicode data of the standard library, splits a code point into its parts: wide and narrow forms into
ordinary ones, accented letters into letter and marks, space characters into a plain space, invisible characters into nothing; the look-alike table replaces letters of other scripts by the Latin
letters they are drawn like. Both are fixed, so that they are joined with each other once, and code points meet the result in one broadcast join. Strings are rebuilt; where they hold marks of
their own, these are ordered by class behind their letter, and letters with marks that have a character of their own are recomposed.

What can be seen is kept: case, digits, raised digits, punctuation, accents, line breaks, ligatures, emoji sequences.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters that are drawn like a Latin letter, by script.
LOOK_ALIKES = {
    "cyrillic": ("АВЕЅІӀЈКМНОРСТУХԌԚԜѴҮаеѕіјорсухһԁԛԝӏѵү", "ABESIIJKMHOPCTYXGQWVYaesijopcyxhdqwlvy"),
    "greek": ("ΑΒΕΖΗΙͿΚΜΝΟΡΤΥΧϹϳνορϲ", "ABEZHIJKMNOPTYXCjvopc"),
    "armenian": ("ՕՍՏզհյոսցօ", "OUSqhjnugo"),
    "cherokee": ("ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCEHJKLMPSTVWZ"),
    "coptic": ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥ", "ABEHIKMNOPCTXopc"),
    "lisu": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    "katakana": ("ニハカロエタトヘー", "二八力口工夕卜へ一"),
}
# Marks that are shown although they belong to the format characters.
_SHOWN_FORMATS = frozenset("\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u08e2\U000110bd")
# Invisible characters that are no format characters.
_HIDDEN = frozenset("\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0") | frozenset(map(chr, [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))
_CODE_POINTS = (*range(0x80, 0xD800), *range(0xE002, 0x30000), *range(0xE0000, 0xE01F0))
_JOINER, _EMOJI_STYLE = "\ue000", "\ue001"  # private code points that stand for them meanwhile


@lru_cache(1)
def _bases() -> dict[str, str]:
    return {a: b for froms, tos in LOOK_ALIKES.values() for a, b in zip(froms, tos, strict=True)}


def _parts(ch: str) -> list[str]:
    """Parts of a code point; none if it is invisible."""
    kind = unicodedata.category(ch)
    if ch in _HIDDEN or kind == "Cf" and ch not in _SHOWN_FORMATS:
        return []
    if kind == "Zs":
        return [" "]
    parts = unicodedata.decomposition(ch).split()
    if parts[:1] in (["<wide>"], ["<narrow>"]):
        return [p for x in parts[1:] for p in _parts(chr(int(x, 16)))]
    return list(unicodedata.normalize("NFD", ch))


@lru_cache(1)
def decompositions() -> dict[str, list[str]]:
    """Every code point beyond ASCII that has other parts than itself."""
    return {ch: p for ch in map(chr, _CODE_POINTS) if (p := _parts(ch)) != [ch]}


@lru_cache(1)
def mark_classes() -> dict[str, int]:
    """Combining marks that are ordered, with their class."""
    return {ch: c for ch in map(chr, _CODE_POINTS) if (c := unicodedata.combining(ch))}


@lru_cache(1)
def compositions() -> dict[str, str]:
    """Letters with marks in order that have a character of their own."""
    marked = ((unicodedata.normalize("NFD", ch), ch) for ch in map(chr, _CODE_POINTS) if not "가" <= ch <= "힣" and unicodedata.normalize("NFC", ch) == ch)
    return {d: ch for d, ch in marked if d != ch}


@lru_cache(1)
def forms() -> dict[str, str]:
    """Every code point that alone has another form, with that form."""
    bases = _bases()
    out = {}
    for ch in {*decompositions(), *bases}:
        form = unicodedata.normalize("NFC", "".join(bases.get(x, x) for x in decompositions().get(ch, [ch])))
        if form != ch:
            out[ch] = form
    return out


def decomposition_table(spark: SparkSession) -> DataFrame:
    """(ch, parts): some thousand rows, fixed by Unicode, whatever the data."""
    d = decompositions()
    return spark.createDataFrame(pa.table({"ch": list(d), "parts": pa.array(list(d.values()), pa.list_(pa.string()))}))


def look_alike_table(spark: SparkSession) -> DataFrame:
    """(part, base): the fixed list of look-alike letters."""
    b = _bases()
    return spark.createDataFrame(pa.table({"part": list(b), "base": list(b.values())}))


def form_table(spark: SparkSession) -> DataFrame:
    """(ch, form): the decompositions joined with the look-alikes, recomposed where a character of its own remains."""
    alone = look_alike_table(spark).select(F.col("part").alias("ch"), F.array("part").alias("parts"))
    d = decomposition_table(spark)
    parts = d.unionByName(alone.join(d, "ch", "left_anti")).select("ch", F.posexplode_outer("parts").alias("at", "part"))
    mapped = parts.join(look_alike_table(spark), "part", "left").select("ch", F.struct("at", F.coalesce("base", "part", F.lit("")).alias("f")).alias("p"))
    form = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["f"]), "")
    return mapped.groupBy("ch").agg(form.alias("form")).select("ch", _recomposed(F.col("form")).alias("form")).filter("ch <> form")


def _map(entries: dict, kind: str) -> Column:
    """A map of fixed entries."""
    return F.from_json(F.lit(json.dumps(entries)), f"map<string,{kind}>")


def _recomposed(c: Column) -> Column:
    """Letters are taken apart, marks behind each letter put in order of their class, and letters with marks written as one character where there is one. Only where a text holds marks."""
    known, apart, classes = _map(compositions(), "string"), _map({x: d for d, x in compositions().items()}, "string"), _map(mark_classes(), "int")
    clusters = F.regexp_extract_all(c, F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), F.lit(0))

    def ordered(x: Column) -> Column:
        """Marks of class 0 stay where they are, the others are sorted between them."""
        chars = F.split(x, "")
        group = lambda i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda ch: F.coalesce(classes[ch], F.lit(0)) == 0))
        placed = F.array_sort(F.transform(chars, lambda ch, i: F.struct(group(i).alias("g"), F.coalesce(classes[ch], F.lit(0)).alias("class"), i.alias("at"), ch.alias("ch"))))
        return F.array_join(F.transform(placed, lambda p: p["ch"]), "")

    def one(x: Column) -> Column:
        first = F.substring(x, 1, 1)
        y = ordered(F.concat(F.coalesce(apart[first], first), x.substr(F.lit(2), F.length(x))))
        return F.when(F.length(x) > 1, F.coalesce(known[y], y)).otherwise(x)

    return F.when(c.rlike(r"\p{M}"), F.array_join(F.transform(clusters, one), "")).otherwise(c)


#: Characters that have no other form: texts of these alone are in the consistent form already.
_SETTLED = r"\A[\x00-\x7f\u00a1-\u00ac\u00ae-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2116\u2122\u2190-\u2328\u3001-\u3029\u3030\u3041-\u3078\u307a-\u3093\u4e00-\u9fff]*\z"
_EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"


def _split(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose text is in its form already, and the distinct other ones, with a hash of the text by which its code points stay together."""
    rows = rows.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    settled = F.coalesce(F.col("_t").rlike(_SETTLED), F.lit(True))
    rest = rows.filter(~settled).withColumn("_h", F.xxhash64("_t")).groupBy("_k", "_h").agg(F.first("_t").alias("_t"))
    return rows.filter(settled).select("_k", "_t", F.col("_t").alias("_f")), rest


def _formed(rest: DataFrame) -> DataFrame:
    """(_k, _t, _f) of distinct rows: exploded to code points, mapped, and rebuilt in the task of their key. Only the first code point carries the text."""
    # joiners and style marks inside emoji are visible: they are set aside, and come back in the end
    guarded: Column = F.regexp_replace("_t", rf"({_EMOJI}\x{{FE0F}}?)\x{{200D}}(?={_EMOJI})", "$1" + _JOINER)
    guarded = F.regexp_replace(guarded, rf"({_EMOJI})\x{{FE0F}}", "$1" + _EMOJI_STYLE)
    chars = rest.select("_k", "_h", "_t", F.posexplode(F.split(guarded, "")).alias("pos", "ch")).withColumn("_t", F.when(F.col("pos") == 0, F.col("_t")))
    mapped = chars.join(F.broadcast(form_table(rest.sparkSession)), "ch", "left").select("_k", "_h", "_t", F.struct("pos", F.coalesce("form", "ch").alias("f")).alias("c"))
    built = mapped.groupBy("_k", "_h").agg(F.max("_t").alias("_t"), F.array_sort(F.collect_list("c")).alias("cs"))
    text = F.array_join(F.transform("cs", lambda x: x["f"]), "")
    return built.select("_k", "_t", F.translate(_recomposed(text), _JOINER + _EMOJI_STYLE, "\u200d\ufe0f").alias("_f"))


def consistent_form(rows: DataFrame, key: str, text: str, out: str = "form") -> DataFrame:
    """(key, text, out) for each distinct pair of key and text, with the text in its consistent form.

    Null keys and null texts are kept, a null text has a null form, an empty text an empty one; repeated rows count once; other columns
    are dropped. Texts are processed whole; a text's code points stay in the task of its key, so that nothing but the texts is shuffled.
    """
    plain, rest = _split(rows, key, text)
    done = plain.distinct().unionByName(_formed(rest))
    return done.select(F.col("_k").alias(key), F.col("_t").alias(text), F.col("_f").alias(out))


#: Lines with at most this many bytes of text are broadcast; beyond it, both sides are shuffled by their form.
BROADCAST_BYTES = 8_000_000


def look_alike_pairs(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(line_id, sub_id): pairs whose texts look the same but aren't equal.

    ``lines`` has line_id and text, ``texts`` sub_id and text. Re-delivered rows count once; null and empty texts form no pair.
    """
    a = consistent_form(lines, "line_id", "text").select("line_id", F.col("text").alias("line_text"), "form")
    size = lines.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    a = F.broadcast(a) if size <= BROADCAST_BYTES else a
    plain, rest = _split(texts, "sub_id", "text")
    pairs = [b.join(a, b["_f"] == a["form"]).filter("_t <> line_text AND form <> ''").select("line_id", F.col("_k").alias("sub_id")) for b in (plain, _formed(rest))]
    return pairs[0].unionByName(pairs[1]).distinct()
