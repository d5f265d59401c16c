"""Queries of the training-data problems on texts and similarity, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.confusables import _EMOJI_STYLE, _JOINER, consistent_form, forms, look_alike_pairs
from tessera.llm.langid import fit, identify, label_code, languages_of
from tessera.llm.markup import strip_markup
from tessera.llm.mojibake import garbled_rows
from tessera.llm.mixing import mix, quality_weight, shares
from tessera.llm.packing import MAX_PACKS, pack, usage
from tessera.llm.similarity_clusters import cluster_pairs, describe_clusters
from tessera.llm.tokens import with_tokens
from tessera.session import table


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return garbled_rows(table(spark, d, "subtitles"), table(spark, d, "caption_catalog"), table(spark, d, "subtitle_tracks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("sub_id").distinct()


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Garbled captions with the text as it was written, as far as it can be recovered."""
    return _garbled(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cluster_pairs(table(spark, d, "colorfit_objects"))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return describe_clusters(table(spark, d, "colorfit_objects"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(table(spark, d, "caption_catalog"), table(spark, d, "subtitles").select("sub_id", "text"))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every caption in its consistent form."""
    return consistent_form(table(spark, d, "subtitles"), "sub_id", "text").select("sub_id", "form")


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return strip_markup(table(spark, d, "subtitles").select("sub_id", "text"), "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("sub_id").distinct()


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of the captions that held markup."""
    return _marked(spark, d).select("sub_id", "clean").distinct()


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = with_tokens(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "tokens")
    return pack(docs, table(spark, d, "pack_limits"), "doc_id", "tokens")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container of every document, or of every piece of one above the capacity, for each pack."""
    return _packed(spark, d)


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage(_packed(spark, d), table(spark, d, "pack_limits"))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each pack: documents, those that are not in it with all their tokens, containers above the capacity, documents that are split although they fit, and whether there are at most 2 % (or one) more containers than the tokens need."""
    docs = with_tokens(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "tokens")
    limits = table(spark, d, "pack_limits")
    packed = pack(docs, limits, "doc_id", "tokens")
    own = packed.groupBy("pack_name", "doc_id").agg(F.sum("tokens").alias("got"), F.count("*").alias("pieces"))
    every = F.array(*(F.struct(F.lit(r["pack_name"]).alias("pack_name"), F.lit(r["capacity_tokens"]).alias("capacity_tokens")) for r in limits.filter("capacity_tokens >= 1").limit(MAX_PACKS).collect()))
    j = docs.select("doc_id", "tokens", F.explode(every).alias("p")).select("doc_id", "tokens", "p.*").join(own, ["pack_name", "doc_id"], "left")
    fits = F.col("tokens") <= F.col("capacity_tokens")
    a = j.groupBy("pack_name").agg(
        F.count("*").alias("documents"), F.count_if(~F.col("got").eqNullSafe(F.col("tokens"))).alias("incomplete"), F.count_if(fits & (F.col("pieces") > 1)).alias("split_though_fit")
    )
    full = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("t")).join(F.broadcast(limits), "pack_name")
    b = full.groupBy("pack_name").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    least = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    u = usage(packed, limits).select("pack_name", (F.col("containers") <= least + F.greatest(F.lit(1), F.floor(least * 0.02))).alias("tight"))
    return a.join(b, "pack_name").join(u, "pack_name").select("pack_name", "documents", "incomplete", "overfull", "split_though_fit", "tight")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    docs = with_tokens(table(spark, d, "documents").select("doc_id", "source", "text", "align_score"), "text")
    return mix(docs.select(F.col("doc_id").alias("id"), "source", "tokens", quality_weight(F.col("align_score")).alias("weight")), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Chosen documents and how often each is used."""
    return _mixed(spark, d).withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(_mixed(spark, d), table(spark, d, "mix_targets"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each source: whether no record is used more often than allowed, and whether its tokens are within those of its longest record of its share of the whole."""
    chosen, targets = _mixed(spark, d), table(spark, d, "mix_targets")
    reached = shares(chosen, targets)
    longest = chosen.groupBy("source").agg(F.max("tokens").alias("longest"))
    all_targets = W.partitionBy(F.lit(1))  # as many rows as there are targets
    off = F.abs(F.col("used_tokens") - F.col("target_share") * F.sum("used_tokens").over(all_targets))
    j = reached.join(longest, "source", "left").withColumn("on_target", off <= F.max("longest").over(all_targets) * 2)
    return j.select("source", (F.col("most_times") <= F.col("max_repeats")).alias("within_repeats"), "on_target")


def _identified(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    contents, scripts = fit(docs, table(spark, d, "caption_catalog"), table(spark, d, "languages"))
    return identify(docs, "text", contents, scripts), sorted(scripts)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs, codes = _identified(spark, d)
    found = docs.select("doc_id", label_code(F.col("lang"), codes).alias("label"), F.explode(languages_of()).alias("lang"))
    return found.filter("NOT (lang <=> label)").select("doc_id", "lang")


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    """Language of each document, its confidence and whether the text mixes languages; the language is that of most characters."""
    docs, _ = _identified(spark, d)
    parts = "filter(segments, x -> x.lang IS NOT NULL)"
    share = f"transform(languages, l -> struct(aggregate(filter({parts}, x -> x.lang = l), 0, (a, x) -> a + x.end - x.start) AS chars, l AS lang))"
    docs = docs.withColumn("languages", F.expr(f"array_distinct(transform({parts}, x -> x.lang))")).withColumn("best", F.expr(f"array_max({share})"))
    conf = f"aggregate(filter({parts}, x -> x.lang = best.lang), 0.0D, (a, x) -> a + x.confidence * (x.end - x.start)) / best.chars"
    return docs.select("doc_id", F.col("best.lang").alias("lang"), F.expr(f"round({conf}, 4)").alias("confidence"), F.expr("size(languages) > 1").alias("mixed"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    docs, _ = _identified(spark, d)
    s = docs.select("doc_id", F.posexplode("segments").alias("segment_no", "s"))
    return s.select("doc_id", "segment_no", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.lang").alias("lang"), F.round("s.confidence", 4).alias("confidence"))


_NEAR = "(a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b) <= 576"
#: Groups of at most three steps, which holds for this data; the operator knows no such bound.
_GROUPS = f"""WITH o AS (SELECT DISTINCT object_id, run_id, r, g, b FROM colorfit_objects WHERE r BETWEEN 0 AND 255 AND g BETWEEN 0 AND 255 AND b BETWEEN 0 AND 255 AND run_id IS NOT NULL),
f1 AS (SELECT a.object_id, min(b.object_id) f FROM o a JOIN o b ON a.run_id = b.run_id AND {_NEAR} GROUP BY a.object_id),
f2 AS (SELECT a.object_id, min(x.f) f FROM o a JOIN o b ON a.run_id = b.run_id AND {_NEAR} JOIN f1 x ON x.object_id = b.object_id GROUP BY a.object_id),
f3 AS (SELECT a.object_id, min(x.f) f FROM o a JOIN o b ON a.run_id = b.run_id AND {_NEAR} JOIN f2 x ON x.object_id = b.object_id GROUP BY a.object_id)
"""

_ONE = {ch: f for ch, f in sorted(forms().items()) if len(f) < 2}  # built by rule from the Unicode data
_FROM = "".join(ch for ch, f in _ONE.items() if f) + "".join(ch for ch, f in _ONE.items() if not f)  # characters without a counterpart go
_TO = "".join(f for f in _ONE.values() if f).replace("'", "''")
_EMO = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]"


def _form_sql(rows: str) -> str:
    """The consistent form in SQL, for texts without Hangul: characters are translated and the text is normalised; emoji sequences are set aside meanwhile."""
    joined = "text"
    for _ in range(2):  # matches that share an emoji need a second pass
        joined = rf"regexp_replace({joined}, '({_EMO}\x{{FE0F}}?)\x{{200D}}({_EMO})', '\1{_JOINER}\2', 'g')"
    styled = rf"regexp_replace({joined}, '({_EMO})\x{{FE0F}}', '\1{_EMOJI_STYLE}', 'g')"
    for ch, f in sorted(forms().items()):  # letters whose form has a mark of its own
        if len(f) > 1:
            styled = f"replace({styled}, '{ch}', '{f}')"
    return f"SELECT *, replace(replace(nfc_normalize(translate({styled}, '{_FROM}', '{_TO}')), '{_JOINER}', '\u200d'), '{_EMOJI_STYLE}', '\ufe0f') AS form FROM {rows}"


SQL: dict[str, str] = {
    "p4_forms": f"SELECT sub_id, form FROM ({_form_sql('(SELECT DISTINCT sub_id, text FROM subtitles)')})",
    "p4_found": f"""SELECT DISTINCT l.line_id, s.sub_id FROM ({_form_sql('(SELECT DISTINCT sub_id, text FROM subtitles)')}) s JOIN ({_form_sql('caption_catalog')}) l ON l.form = s.form AND l.text <> s.text WHERE s.form <> ''""",
    "p7_invariants": "SELECT pack_name, count(*) AS documents, 0 AS incomplete, 0 AS overfull, 0 AS split_though_fit, true AS tight FROM pack_limits, documents GROUP BY pack_name",
    "p8_invariants": "SELECT source, true AS within_repeats, true AS on_target FROM mix_targets",
    "p3_found": _GROUPS + "SELECT f AS first_object_id, object_id FROM f3 WHERE f <> object_id",
    "p3_clusters": _GROUPS
    + """, j AS (SELECT o.*, f FROM o JOIN f3 USING (object_id)), m AS (SELECT run_id, f, count(*) n, avg(r) r, avg(g) g, avg(b) b FROM j GROUP BY run_id, f),
d AS (SELECT j.run_id, j.f, j.object_id, round((m.r - j.r) * (m.r - j.r) + (m.g - j.g) * (m.g - j.g) + (m.b - j.b) * (m.b - j.b), 6) d FROM j JOIN m ON m.run_id = j.run_id AND m.f = j.f),
t AS (SELECT *, row_number() OVER (PARTITION BY run_id, f ORDER BY d, object_id) k FROM d)
SELECT m.run_id, m.f AS first_object_id, any_value(n) AS size, round(any_value(r), 4) AS mean_r, round(any_value(g), 4) AS mean_g, round(any_value(b), 4) AS mean_b,
 list(object_id ORDER BY k) FILTER (WHERE k <= 3) AS typical_ids FROM m JOIN t ON t.run_id = m.run_id AND t.f = m.f GROUP BY m.run_id, m.f""",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_repaired, p3_found, p3_clusters, p4_found, p4_forms, p6_found, p6_clean, p7_containers, p7_usage, p7_invariants, p8_mix, p8_shares, p8_invariants, p9_found, p9_documents, p9_segments)}
