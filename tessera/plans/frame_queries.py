"""Queries of the byte, colour and palette operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import color as C
from tessera.operators import arrays as A
from tessera.operators import palette as P
from tessera.operators import payloads as B
from tessera.plans.adapters import blocks, colours, frames, palette, payloads, pixels

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BYTES = """b AS (SELECT doc_id, pos, CAST('0x' || substr(h, 2 * pos + 1, 2) AS INTEGER) b FROM
 (SELECT doc_id, h, unnest(range(length(h) // 2)) pos FROM (SELECT doc_id, hex(encode(text)) h FROM documents WHERE text IS NOT NULL AND text <> '')))"""
_PIXELS = "p AS (SELECT CAST((l_partkey * 65793 + l_suppkey * 257 + l_linenumber) % 16777216 AS INTEGER) xrgb FROM lineitem)"
_COLOURS = """c AS (SELECT DISTINCT object_id, run_id, r * 65536 + g * 256 + b xrgb FROM colorfit_objects
 WHERE r BETWEEN 0 AND 255 AND g BETWEEN 0 AND 255 AND b BETWEEN 0 AND 255 AND run_id IS NOT NULL)"""
_CHANNELS = _COLOURS + ", k AS (SELECT object_id, run_id, xrgb, (xrgb >> 16) & 255 r, (xrgb >> 8) & 255 g, xrgb & 255 b FROM c)"
_FRAMES = "f AS (SELECT event_type stream, event_id, ts, CAST(floor(value * 100) AS INTEGER) s FROM events)"
_PALETTE = "pal AS (SELECT CAST(n_nationkey AS INTEGER) idx, CAST((n_nationkey * 7919 + n_regionkey * 104729 + 12345) * 37 % 16777216 AS INTEGER) xrgb FROM nation)"
_GRAY = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"


# --- bytes ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_BYTES}, h AS (SELECT doc_id, b, count(*) n FROM b GROUP BY ALL), t AS (SELECT doc_id, sum(n) t FROM h GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_bytes, count(*) AS alphabet, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM h JOIN t USING (doc_id) GROUP BY doc_id""")
def byte_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Size, alphabet and entropy in bits of every document's bytes."""
    h = payloads(spark, d).select("doc_id", F.octet_length("payload").cast("long").alias("n_bytes"), B.byte_histogram("payload").alias("h"))
    bits = F.aggregate(F.filter("h", lambda n: n > 0), F.lit(0.0), lambda a, n: a - n / F.col("n_bytes") * F.log2(n / F.col("n_bytes")))
    return h.select("doc_id", "n_bytes", F.size(F.filter("h", lambda n: n > 0)).cast("long").alias("alphabet"), F.round(bits, 6).alias("entropy"))


@query(f"WITH {_BYTES} SELECT CAST(v AS INTEGER) AS b, count(b) AS n FROM range(256) r(v) LEFT JOIN b ON b = v GROUP BY v")
def byte_histogram_keep_empty(spark: SparkSession, d: str) -> DataFrame:
    return _byte_counts(spark, d)


@query(f"WITH {_BYTES}, h AS (SELECT b, count(*) n FROM b GROUP BY b) SELECT b, n, round(n / sum(n) OVER (), 9) AS p FROM h")
def byte_histogram_normalized(spark: SparkSession, d: str) -> DataFrame:
    return P.normalize(_byte_counts(spark, d).filter("n > 0")).select("b", "n", F.round("p", 9).alias("p"))


def _byte_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all 256 byte values; the values that no document has are there too, as every histogram has all of them."""
    h = payloads(spark, d).select(F.posexplode(B.byte_histogram("payload")).alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n"))
    return spark.range(256).select(F.col("id").cast("int").alias("b")).join(h, "b", "left").select("b", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {_BYTES}, e AS (SELECT doc_id, pos, (b - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY pos), 0) + 256) % 256 v FROM b)
SELECT doc_id, v AS delta, count(*) AS n FROM e GROUP BY ALL""")
def delta8_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of the byte deltas of every document."""
    return payloads(spark, d).select("doc_id", F.posexplode(B.byte_histogram(B.delta_encode("payload"))).alias("delta", "n")).filter("n > 0")


@query(f"""WITH {_BYTES}, w AS (SELECT doc_id, pos // 2 pos, sum(b << (8 * (pos % 2))) w FROM b GROUP BY doc_id, pos // 2)
SELECT doc_id, CAST(sum((w - coalesce(l, 0) + 65536) % 65536) AS BIGINT) AS delta_sum FROM (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) l FROM w) GROUP BY doc_id""")
def delta16_sum(spark: SparkSession, d: str) -> DataFrame:
    w = payloads(spark, d).select("doc_id", B.words("payload", 2, pad=True).alias("w"))
    diffs = F.transform("w", lambda x, i: F.when(i == 0, x).otherwise(F.pmod(x - F.get("w", i - 1), F.lit(65536))))
    return w.select("doc_id", F.aggregate(diffs, F.lit(0).cast("long"), lambda a, x: a + x).alias("delta_sum"))


@query(f"WITH {_BYTES} SELECT doc_id, count(*) AS same FROM b GROUP BY doc_id")
def delta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that delta decoding gives back as they were; all of them."""
    p = payloads(spark, d).select("doc_id", "payload", B.delta_decode(B.delta_encode("payload")).alias("back"))
    return p.select("doc_id", B.mapped(lambda a, b: sum(x == y for x, y in zip(bytes(a), bytes(b))), T.LongType(), "payload", "back").alias("same"))


@query(f"WITH {_BYTES} SELECT doc_id, pos // 4 AS pos, CAST(sum(b * (CAST(1 AS BIGINT) << (8 * (pos % 4)))) AS BIGINT) AS word FROM b GROUP BY doc_id, pos // 4")
def little_endian_words(spark: SparkSession, d: str) -> DataFrame:
    w = payloads(spark, d).select("doc_id", F.posexplode(B.words("payload", 4, pad=True)).alias("pos", "word"))
    return w.withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT doc_id, n AS size, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM (SELECT doc_id, source, octet_length(encode(text)) n FROM documents WHERE text IS NOT NULL)""")
def start_indices(spark: SparkSession, d: str) -> DataFrame:
    """Start of every document when those of a source are put behind each other."""
    from tessera.session import table

    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"))
    return A.start_indices(docs, ["source"], "doc_id", "size", slot=F.expr("doc_id div 1000")).select("doc_id", "size", "start")


@query(f"""WITH {_FRAMES} SELECT event_id, CASE WHEN len(a) % 16 = 0 THEN len(a) ELSE len(a) + 16 - len(a) % 16 END AS padded, a[1] // 4 AS first_quarter
FROM (SELECT event_id, [s, s % 7, s % 5] || CASE WHEN s % 2 = 0 THEN [s] ELSE [] END a FROM f)""")
def pad_and_divide(spark: SparkSession, d: str) -> DataFrame:
    a = frames(spark, d).select("event_id", F.expr("concat(array(s, s % 7, s % 5), CASE WHEN s % 2 = 0 THEN array(s) ELSE slice(array(s), 1, 0) END)").alias("a"))
    return a.select("event_id", F.size(A.fill_up_to_multiple(F.col("a"), 16)).alias("padded"), A.divide_by(F.col("a"), 4)[0].alias("first_quarter"))


@query("""SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4.0) * 4 AS INTEGER) AS padded, upper(substr(hex(encode(text)), 1, 8)) AS head FROM documents WHERE text IS NOT NULL AND text <> ''""")
def pad_raw_bytes(spark: SparkSession, d: str) -> DataFrame:
    p = payloads(spark, d).withColumn("q", A.pad_binary(F.col("payload"), 4))
    return p.select("doc_id", F.octet_length("q").alias("padded"), F.substring(F.hex("q"), 1, 8).alias("head"))


@query(f"""WITH {_FRAMES} SELECT event_id, [s % 256, (s // 256) % 256, 9] AS bytes FROM f""")
def prepend_value(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("event_id", A.prepend_value(F.array(F.lit(9)), F.col("s"), 2).alias("bytes"))


@query(f"""WITH {_FRAMES} SELECT stream, event_id, CAST((((2 * first_value(s) OVER w - sum(s) OVER w) % 65536) + 65536) % 65536 AS BIGINT) AS diff FROM f
WINDOW w AS (PARTITION BY stream ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def delta_image(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("o", F.struct("ts", "event_id"))
    return A.delta_image(f, ["stream"], "o", "s", 16, slot=F.to_date("ts")).select("stream", "event_id", "diff")


@query(f"""WITH {_FRAMES} SELECT stream, event_id, (s - coalesce(lag(s) OVER (PARTITION BY stream ORDER BY ts, event_id), 0) + 65536) % 65536 AS diff FROM f""")
def delta_image_successive(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("o", F.struct("ts", "event_id"))
    return A.delta_image_successive(f, ["stream"], "o", "s", 16, slot=F.to_date("ts")).select("stream", "event_id", "diff")


@query("""SELECT vec_id // 4 AS grp, pos * 4 + vec_id % 4 AS at, round(v, 6) AS v FROM (SELECT vec_id, unnest(range(64)) pos, unnest(embedding)::DOUBLE v FROM embeddings)""")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    """Four blocks each, value by value: a0 b0 c0 d0 a1 ..."""
    b = blocks(spark, d).withColumn("grp", F.expr("vec_id div 4")).withColumn("set_no", F.expr("vec_id % 4"))
    return A.interleave(b, ["grp"], "set_no", "pos", 4).select("grp", "at", F.round("v", 6).alias("v"))


@query(f"""WITH {_BYTES}, s AS (SELECT doc_id, pos // 2 p, max(CASE WHEN pos % 2 = 0 THEN b END) a, coalesce(max(CASE WHEN pos % 2 = 1 THEN b END), 0) c FROM b GROUP BY ALL)
SELECT doc_id, p * 2 AS pos, (c % 16) * 16 + a % 16 AS b FROM s UNION ALL SELECT doc_id, p * 2 + 1, c // 16 * 16 + a // 16 FROM s""")
def interleave_nibbles(spark: SparkSession, d: str) -> DataFrame:
    """Even and odd bytes of documents, padded to an even size, as nibbles side by side."""
    return _interleaved(spark, d, 2, 4)


@query(f"""WITH {_BYTES}, n AS (SELECT doc_id, CAST(ceil(count(*) / 4.0) AS BIGINT) * 4 n FROM b GROUP BY doc_id), g AS (SELECT doc_id, n, unnest(range(n)) i FROM n), k AS (SELECT g.doc_id, n, i, coalesce(b, 0) b FROM g LEFT JOIN b ON b.doc_id = g.doc_id AND b.pos = i)
SELECT doc_id, i // (n // 2) * 2 + i % (n // 2) // 2 * 4 + i % 2 AS pos, b FROM k""")
def interleave_words(spark: SparkSession, d: str) -> DataFrame:
    """The two halves of documents, padded to a multiple of four bytes, interleaved by words of 16 bits."""
    halves = lambda b: [bytes(b)[: len(b) // 2], bytes(b)[len(b) // 2 :]]
    p = payloads(spark, d).withColumn("payload", A.pad_binary(F.col("payload"), 4))
    out = p.select("doc_id", B.interleave(B.mapped(halves, T.ArrayType(T.BinaryType()), "payload"), 16).alias("x"))
    return out.select("doc_id", F.posexplode(B.words("x", 1)).alias("pos", "b")).withColumn("pos", F.col("pos").cast("long"))


def _interleaved(spark: SparkSession, d: str, n: int, bits: int) -> DataFrame:
    sets = lambda b: [bytes(b)[i::n] for i in range(n)]
    p = payloads(spark, d).withColumn("payload", A.pad_binary(F.col("payload"), n))
    out = p.select("doc_id", B.interleave(B.mapped(sets, T.ArrayType(T.BinaryType()), "payload"), bits).alias("x"))
    return out.select("doc_id", F.posexplode(B.words("x", 1)).alias("pos", "b")).withColumn("pos", F.col("pos").cast("long"))


# --- colours ---------------------------------------------------------------------------------------------------------------

_TO555 = "((((r * 249 + 1014) >> 11) << 10) | (((g * 249 + 1014) >> 11) << 5) | ((b * 249 + 1014) >> 11))"
_TO565 = "((((r * 249 + 1014) >> 11) << 11) | (((g * 253 + 505) >> 10) << 5) | ((b * 249 + 1014) >> 11))"


@query(f"""WITH {_CHANNELS}, q AS (SELECT *, {_TO555} x5, {_TO565} x6 FROM k)
SELECT object_id, x5 AS xrgb1555, x6 AS rgb565,
 (((((x5 >> 10) & 31) * 527 + 23) >> 6) << 16) | (((((x5 >> 5) & 31) * 527 + 23) >> 6) << 8) | (((x5 & 31) * 527 + 23) >> 6) AS back_555,
 (((((x6 >> 11) & 31) * 527 + 23) >> 6) << 16) | (((((x6 >> 5) & 63) * 259 + 33) >> 6) << 8) | (((x6 & 31) * 527 + 23) >> 6) AS back_565,
 (((x5 >> 10) & 31) << 11) | (((((x5 >> 5) & 31) * 130 + 33) >> 6) << 5) | (x5 & 31) AS from_555_to_565,
 (((x6 >> 11) & 31) << 10) | (((((x6 >> 5) & 63) * 31 + 31) >> 6) << 5) | (x6 & 31) AS from_565_to_555 FROM q""")
def packed_conversions(spark: SparkSession, d: str) -> DataFrame:
    """Rounded conversions between 8-8-8, 5-5-5 and 5-6-5 in all directions."""
    c = colours(spark, d)
    x = F.col("xrgb")
    c = c.select("object_id", C.convert_packed(x, "xrgb8888", "xrgb1555").alias("xrgb1555"), C.convert_packed(x, "xrgb8888", "rgb565").alias("rgb565"))
    a, b = F.col("xrgb1555"), F.col("rgb565")
    return c.select(
        "object_id", a, b, C.convert_packed(a, "xrgb1555", "xrgb8888").alias("back_555"), C.convert_packed(b, "rgb565", "xrgb8888").alias("back_565"),
        C.convert_packed(a, "xrgb1555", "rgb565").alias("from_555_to_565"), C.convert_packed(b, "rgb565", "xrgb1555").alias("from_565_to_555"),
    )


@query(f"""WITH {_CHANNELS} SELECT object_id, ((r >> 3) << 10) | ((g >> 3) << 5) | (b >> 3) AS w555, ((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3) AS w565,
 ((b >> 3) << 10) | ((g >> 3) << 5) | (r >> 3) AS bgr555, (b << 16) | (g << 8) | r AS bgr888 FROM k""")
def truncated_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that drop low bits, and colours with red and blue swapped."""
    x = F.col("xrgb")
    w = C.truncate_packed(x, "xrgb1555")
    return colours(spark, d).select("object_id", w.alias("w555"), C.truncate_packed(x, "rgb565").alias("w565"), C.swap_red_blue(w, "xrgb1555").alias("bgr555"), C.swap_red_blue(x).alias("bgr888"))


@query("""SELECT DISTINCT object_id, CAST('0x' || substr(upper(csscolor), 2) AS INTEGER) AS xrgb, substr(upper(csscolor), 2) AS hex FROM colorfit_objects
WHERE regexp_full_match(csscolor, '#[0-9A-Fa-f]{6}')""")
def hex_colours(spark: SparkSession, d: str) -> DataFrame:
    from tessera.session import table

    o = table(spark, d, "colorfit_objects").select("object_id", C.from_hex(F.col("csscolor")).alias("xrgb")).filter("xrgb IS NOT NULL")
    return o.select("object_id", "xrgb", C.to_hex(F.col("xrgb")).alias("hex")).distinct()


_F = "f AS (SELECT object_id, xrgb, r / 255.0::DOUBLE r, g / 255.0::DOUBLE g, b / 255.0::DOUBLE b FROM k)"
_LIN = "(CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END)"
_LINEAR = "l AS (SELECT object_id, xrgb, " + ", ".join(f"{_LIN.format(c)} {c}" for c in "rgb") + " FROM f)"
_LABF = "(CASE WHEN {0} > 216.0 / 24389.0 THEN pow({0}, 1.0 / 3.0) ELSE (24389.0 / 27.0 * {0} + 16.0) / 116.0 END)"
_LAB = f"""x AS (SELECT object_id, xrgb, (r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.950489 x, r * 0.2126729 + g * 0.7151522 + b * 0.0721750 y, (r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.088840 z FROM l),
lab AS (SELECT object_id, xrgb, 116 * {_LABF.format('y')} - 16 L, 500 * ({_LABF.format('x')} - {_LABF.format('y')}) a, 200 * ({_LABF.format('y')} - {_LABF.format('z')}) bb FROM x)"""


@query(f"WITH {_CHANNELS}, {_F} SELECT object_id, round({_GRAY}, 5) AS gray, CASE WHEN {_GRAY} < 0.5 THEN 0 ELSE 1 END AS bw, CAST(least(31, floor({_GRAY} * 31 + 0.5)) AS INTEGER) AS gray5 FROM f")
def grays(spark: SparkSession, d: str) -> DataFrame:
    g = C.to_gray(C.to_rgbf(F.col("xrgb")))
    return colours(spark, d).select("object_id", F.round(g, 5).alias("gray"), P.to_black_white(g, 0.5).alias("bw"), C.from_rgbf((g, g, g), "xrgb1555").bitwiseAND(F.lit(31)).alias("gray5"))


@query(f"""WITH {_CHANNELS}, {_F}, y AS (SELECT *, r - b co, g - (b + (r - b) / 2) cg FROM f)
SELECT object_id, round(b + co / 2 + cg / 2, 5) AS y, round(cg, 5) AS cg, round(co, 5) AS co, round((cg + 1) / 2, 5) AS cg_norm, xrgb AS back FROM y""")
def ycgco(spark: SparkSession, d: str) -> DataFrame:
    """YCgCo of the colours, normalised chroma, and the colour that comes back."""
    y = C.to_ycgco(C.to_rgbf(F.col("xrgb")))
    return colours(spark, d).select(
        "object_id", F.round(y[0], 5).alias("y"), F.round(y[1], 5).alias("cg"), F.round(y[2], 5).alias("co"), F.round(C.ycgco_normalized(y)[1], 5).alias("cg_norm"), C.from_rgbf(C.from_ycgco(y)).alias("back")
    )


@query(f"WITH {_CHANNELS}, {_F}, {_LINEAR}, {_LAB} SELECT object_id, round(L, 4) AS l, round(a, 4) AS a, round(bb, 4) AS b, xrgb AS back FROM lab")
def cielab(spark: SparkSession, d: str) -> DataFrame:
    """L*a*b* of the linearised colours, and the colour that comes back."""
    df = C.with_packed_of_lab(C.with_lab(colours(spark, d), "xrgb", "m"), ("ml", "ma", "mb"), "back")
    return df.select("object_id", *((F.round(f"m{c}", 4) + F.lit(0.0)).alias(c) for c in "lab"), "back")


@query(f"WITH {_CHANNELS}, {_F}, {_LINEAR} SELECT object_id, round(r, 5) AS r, round(g, 5) AS g, round(b, 5) AS b, xrgb AS back FROM l")
def linear_rgb(spark: SparkSession, d: str) -> DataFrame:
    lin = C.to_linear(C.to_rgbf(F.col("xrgb")))
    return colours(spark, d).select("object_id", *(F.round(x, 5).alias(n) for x, n in zip(lin, "rgb")), C.from_rgbf(C.to_srgb(lin)).alias("back"))


@query(f"WITH {_CHANNELS}, {_F} SELECT object_id, round(floor(r * 31 + 0.5) / 31, 6) AS r, round(floor(g * 63 + 0.5) / 63, 6) AS g, round(floor(b * 31 + 0.5) / 31, 6) AS b FROM f")
def round_to_grid(spark: SparkSession, d: str) -> DataFrame:
    q = C.round_to_grid(C.to_rgbf(F.col("xrgb")), (31, 63, 31))
    return colours(spark, d).select("object_id", *(F.round(x, 6).alias(n) for x, n in zip(q, "rgb")))


_PAIRS = ", n AS (SELECT *, lead(xrgb) OVER (PARTITION BY run_id ORDER BY object_id) nx FROM c), k AS (SELECT object_id, xrgb, ((xrgb >> 16) & 255) / 255.0::DOUBLE r, ((xrgb >> 8) & 255) / 255.0::DOUBLE g, (xrgb & 255) / 255.0::DOUBLE b, ((nx >> 16) & 255) / 255.0::DOUBLE r2, ((nx >> 8) & 255) / 255.0::DOUBLE g2, (nx & 255) / 255.0::DOUBLE b2 FROM n WHERE nx IS NOT NULL)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return colours(spark, d).withColumn("nx", F.lead("xrgb").over(W.partitionBy("run_id").orderBy("object_id"))).filter("nx IS NOT NULL")


@query(f"""WITH {_COLOURS}{_PAIRS}, m AS (SELECT *, (r + r2) / 2 rm FROM k) SELECT object_id,
 round(((2 + rm) * (r - r2) * (r - r2) + 4 * (g - g2) * (g - g2) + (3 - rm) * (b - b2) * (b - b2)) / 9, 6) AS weighted,
 round(CASE WHEN r = r2 AND g = g2 AND b = b2 THEN 0 ELSE ((2 + rm) * (r - r2) * (r - r2) + 4 * (g - g2) * (g - g2) + 2 + (1 - rm) * (b - b2) * (b - b2)) / 9 END, 6) AS "offset",
 round(pow(0.2126 * (r - r2) + 0.7152 * (g - g2) + 0.0722 * (b - b2), 2), 6) AS gray,
 round(0.4 * pow((r - r2 - 2 * (g - g2) + b - b2) / 4 + (g - g2), 2) + 0.3 * pow(((g - g2) - (r - r2 + b - b2) / 2) / 2, 2) + 0.3 * pow((r - r2 - b + b2) / 2, 2), 6) AS ycgco FROM m""")
def colour_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each colour to the next one of its run, in several spaces."""
    a, b = C.to_rgbf(F.col("xrgb")), C.to_rgbf(F.col("nx"))
    r6 = lambda c: F.round(c, 6)
    return _pairs(spark, d).select(
        "object_id", r6(C.mse_rgb(a, b)).alias("weighted"), r6(C.mse_rgb(a, b, "offset")).alias("offset"), r6(C.mse_gray(C.to_gray(a), C.to_gray(b))).alias("gray"), r6(C.mse_ycgco(C.to_ycgco(a), C.to_ycgco(b))).alias("ycgco")
    )


_LAB2 = f"""WITH {_CHANNELS}, {_F}, {_LINEAR}, {_LAB}, o AS (SELECT c.run_id, lab.* FROM lab JOIN c USING (object_id)),
n AS (SELECT object_id, run_id, L, a, bb, lead(L) OVER w L2, lead(a) OVER w a2, lead(bb) OVER w b2 FROM o WINDOW w AS (PARTITION BY run_id ORDER BY object_id)),
h AS (SELECT run_id, object_id, (sqrt(pow((a - a2) / 255, 2) + pow((bb - b2) / 255, 2)) + abs(L - L2) / 100) / 2.414213562 d FROM n WHERE L2 IS NOT NULL)"""


def _lab_pairs(spark: SparkSession, d: str) -> DataFrame:
    """L*a*b* of each colour (x) and of the next one of its run (y)."""
    return C.with_lab(C.with_lab(_pairs(spark, d), "xrgb", "x"), "nx", "y")


def _hyab():
    return C.hyab(tuple(F.col(f"x{c}") for c in "lab"), tuple(F.col(f"y{c}") for c in "lab"))


@query(_LAB2 + " SELECT object_id, round(d, 5) AS hyab FROM h")
def hyab_distance(spark: SparkSession, d: str) -> DataFrame:
    return _lab_pairs(spark, d).select("object_id", F.round(_hyab(), 5).alias("hyab"))


@query(_LAB2 + " SELECT run_id, round(avg(d), 6) AS mse, round(10 * log10(1 / avg(d)), 4) AS psnr, bool_and(d < 0.2) AS below FROM h GROUP BY run_id HAVING avg(d) > 0")
def run_psnr(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of neighbours in a run, its ratio in dB, and whether all lie below a threshold."""
    m = _lab_pairs(spark, d).select("run_id", _hyab().alias("d")).groupBy("run_id").agg(F.avg("d").alias("m"), F.every(F.col("d") < 0.2).alias("below")).filter("m > 0")
    return m.select("run_id", F.round("m", 6).alias("mse"), F.round(C.psnr(F.col("m")), 4).alias("psnr"), "below")


_P7 = "sqrt(pow({0}, 7) / (pow({0}, 7) + 6103515625.0))"


@query(_LAB2.split("h AS (SELECT")[0] + f"""g AS (SELECT object_id, L l1, a a1, bb b1, L2 l2, a2, b2, 1.5 - 0.5 * {_P7.format('((sqrt(a * a + bb * bb) + sqrt(a2 * a2 + b2 * b2)) / 2)')} g FROM n WHERE L2 IS NOT NULL),
q AS (SELECT object_id, l1, l2, sqrt(pow(a1 * g, 2) + b1 * b1) c1, sqrt(pow(a2 * g, 2) + b2 * b2) c2, (degrees(atan2(b1, a1 * g)) + 360) % 360 h1, (degrees(atan2(b2, a2 * g)) + 360) % 360 h2 FROM g),
r AS (SELECT *, (c1 + c2) / 2 cm, pow((l1 + l2) / 2 - 50, 2) k, CASE WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END dh,
 CASE WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END hm FROM q),
u AS (SELECT object_id, (l2 - l1) / (1 + 0.015 * k / sqrt(20 + k)) x, (c2 - c1) / (1 + 0.045 * cm) y, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) /
 (1 + 0.015 * cm * (1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.2 * cos(radians(4 * hm - 63)))) z,
 -2 * {_P7.format('cm')} * sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) t FROM r) SELECT object_id, round(sqrt(greatest(0, x * x + y * y + z * z + t * y * z)), 4) AS delta_e FROM u""")
def ciede2000(spark: SparkSession, d: str) -> DataFrame:
    return C.with_ciede2000(_lab_pairs(spark, d), "x", "y", "e").select("object_id", F.round("e", 4).alias("delta_e"))


@query("WITH g AS (SELECT range v FROM range({0})) SELECT CAST(v AS INTEGER) AS word, CAST(255 * (v >> 10) // 31 * 65536 + 255 * ((v >> 5) & 31) // 31 * 256 + 255 * (v & 31) // 31 AS INTEGER) AS xrgb FROM g".format(32768))
def colour_space_555(spark: SparkSession, d: str) -> DataFrame:
    """Every 15-bit colour."""
    w = spark.range(32768).select(F.col("id").cast("int").alias("word"))
    r, g, b = C.channels(F.col("word"), "xrgb1555")
    return w.select("word", C.pack(tuple(F.floor(x * 255 / 31) for x in (r, g, b))).alias("xrgb"))


@query("WITH g AS (SELECT range v FROM range(65536)) SELECT CAST(v AS INTEGER) AS word, CAST(255 * (v >> 11) // 31 * 65536 + 255 * ((v >> 5) & 63) // 63 * 256 + 255 * (v & 31) // 31 AS INTEGER) AS xrgb, CAST(v % 256 AS INTEGER) AS x, CAST(v // 256 AS INTEGER) AS y FROM g")
def colour_map_565(spark: SparkSession, d: str) -> DataFrame:
    """Every 16-bit colour, laid out as an image of 256 x 256."""
    w = spark.range(65536).select(F.col("id").cast("int").alias("word"))
    r, g, b = C.channels(F.col("word"), "rgb565")
    return w.select("word", C.pack((F.floor(r * 255 / 31), F.floor(g * 255 / 63), F.floor(b * 255 / 31))).alias("xrgb"), F.expr("word % 256").alias("x"), F.expr("word div 256").alias("y"))


# --- palettes ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {_PIXELS} SELECT xrgb, count(*) AS n FROM p GROUP BY xrgb")
def colour_histogram(spark: SparkSession, d: str) -> DataFrame:
    return P.histogram(pixels(spark, d), "xrgb")


_DIST = "((2 + ((({0} >> 16) & 255) + (({1} >> 16) & 255)) / 510.0) * pow(((({0} >> 16) & 255) - (({1} >> 16) & 255)) / 255.0, 2) + 4 * pow(((({0} >> 8) & 255) - (({1} >> 8) & 255)) / 255.0, 2) + (3 - ((({0} >> 16) & 255) + (({1} >> 16) & 255)) / 510.0) * pow((({0} & 255) - ({1} & 255)) / 255.0, 2)) / 9"


@query(f"WITH {_PIXELS}, {_PALETTE}, u AS (SELECT DISTINCT xrgb FROM p), dd AS (SELECT u.xrgb, idx, round({_DIST.format('u.xrgb', 'pal.xrgb')}, 9) dist FROM u, pal) SELECT xrgb, arg_min(idx, (dist, idx)) AS idx, min(dist) AS dist FROM dd GROUP BY xrgb")
def nearest_palette_colour(spark: SparkSession, d: str) -> DataFrame:
    return P.nearest(pixels(spark, d), palette(spark, d))


@query(f"""WITH {_COLOURS}, m AS (SELECT DISTINCT xrgb, xrgb & 14737600 target FROM c), i AS (SELECT target, dense_rank() OVER (ORDER BY target) - 1 idx FROM (SELECT DISTINCT target FROM m))
SELECT idx, count(*) AS n FROM c JOIN m USING (xrgb) JOIN i USING (target) GROUP BY idx""")
def quantize_closest(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of each palette index, for a palette of three, three and two bits a channel."""
    c = colours(spark, d)
    m = c.select("xrgb").distinct().withColumn("target", F.col("xrgb").bitwiseAND(F.lit(0xE0E0C0)))
    return P.quantize_closest(c, m).groupBy("idx").agg(F.count("*").alias("n"))


_PAL_ARR = f"{_PALETTE}, arr AS (SELECT list(xrgb ORDER BY idx) a FROM pal)"


@query(f"WITH {_PAL_ARR} SELECT unnest(range(26)) AS idx, unnest([255] || a) AS xrgb FROM arr")
def add_color0(spark: SparkSession, d: str) -> DataFrame:
    return _palette_array(spark, d).select(F.posexplode(P.add_color0(F.col("a"), 255)).alias("idx", "xrgb")).withColumn("idx", F.col("idx").cast("long"))


def _palette_array(spark: SparkSession, d: str) -> DataFrame:
    return palette(spark, d).agg(F.expr("transform(array_sort(collect_list(struct(idx, xrgb))), x -> x.xrgb)").alias("a"))


@query(f"WITH {_PALETTE}, z AS (SELECT idx, xrgb, (SELECT xrgb FROM pal WHERE idx = 7) c7, (SELECT xrgb FROM pal WHERE idx = 0) c0 FROM pal) SELECT idx, CASE WHEN idx = 0 THEN c7 WHEN idx = 7 THEN c0 ELSE xrgb END AS xrgb, CASE WHEN idx = 0 THEN 7 WHEN idx = 7 THEN 0 ELSE idx END AS moved FROM z")
def move_color0(spark: SparkSession, d: str) -> DataFrame:
    """Palette with the colour of index 7 swapped to the front, and where each index goes."""
    color = palette(spark, d).filter("idx = 7").first()["xrgb"]
    a = _palette_array(spark, d).select(F.posexplode(P.move_color0(F.col("a"), color)).alias("idx", "xrgb"))
    return a.withColumn("moved", P.move_index0(F.col("idx"), F.lit(7)))


@query("SELECT CASE WHEN s_nationkey = 0 THEN 0 ELSE s_nationkey + 16 END AS idx, count(*) AS n FROM supplier GROUP BY 1")
def shift_indices(spark: SparkSession, d: str) -> DataFrame:
    from tessera.session import table

    return P.shift_indices(table(spark, d, "supplier").select(F.col("s_nationkey").alias("idx")), "idx", 16).groupBy("idx").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT vec_id, unnest(range(64)) pos, CAST(abs(floor(unnest(embedding)::DOUBLE * 64)) AS INTEGER) % {m} v FROM embeddings)
SELECT vec_id, pos // {k} AS pos, CAST(sum(v << ((pos % {k}) * {bits})) AS BIGINT) AS b FROM v GROUP BY vec_id, pos // {k}""".format(m=16, k=2, bits=4))
def prune_indices_4(spark: SparkSession, d: str) -> DataFrame:
    return _pruned(spark, d, 4)


@query("""WITH v AS (SELECT vec_id, unnest(range(64)) pos, CAST(abs(floor(unnest(embedding)::DOUBLE * 64)) AS INTEGER) % {m} v FROM embeddings)
SELECT vec_id, pos // {k} AS pos, CAST(sum(v << ((pos % {k}) * {bits})) AS BIGINT) AS b FROM v GROUP BY vec_id, pos // {k}""".format(m=2, k=8, bits=1))
def prune_indices_1(spark: SparkSession, d: str) -> DataFrame:
    return _pruned(spark, d, 1)


def _pruned(spark: SparkSession, d: str, bits: int) -> DataFrame:
    v = blocks(spark, d).withColumn("v", F.expr(f"cast(abs(floor(v * 64)) as int) % {1 << bits}"))
    return A.pack_bits(v, ["vec_id"], "pos", "v", bits).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {_COLOURS}, s AS (SELECT run_id, list(DISTINCT xrgb & 12632256) a FROM c GROUP BY run_id), m AS (SELECT max(len(a)) t FROM s)
SELECT run_id, len(a) AS colours, t AS padded, CAST(ceil(t / 16.0) * 16 AS INTEGER) AS padded16 FROM s, m""")
def equalize_palettes(spark: SparkSession, d: str) -> DataFrame:
    """Palettes of all runs padded to the largest, and to a multiple of 16."""
    s = colours(spark, d).groupBy("run_id").agg(F.collect_set(F.col("xrgb").bitwiseAND(F.lit(0xC0C0C0))).alias("a"))
    e = P.equalize_palettes(s.withColumn("colours", F.size("a")), "a")
    return e.select("run_id", F.col("colours").cast("long").alias("colours"), F.size("a").cast("long").alias("padded"), F.size(A.fill_up_to_multiple(F.col("a"), 16)).alias("padded16"))


@query(f"""WITH {_PALETTE}, w AS (SELECT idx, ((((xrgb & 255) * 249 + 1014) >> 11) << 10) | (((((xrgb >> 8) & 255) * 249 + 1014) >> 11) << 5) | ((((xrgb >> 16) & 255) * 249 + 1014) >> 11) w FROM pal)
SELECT idx, w % 256 AS low, w // 256 AS high FROM w""")
def palette_to_raw(spark: SparkSession, d: str) -> DataFrame:
    """Palette as little-endian 5-5-5 words with red and blue swapped."""
    w = palette(spark, d).select("idx", C.swap_red_blue(C.convert_packed(F.col("xrgb"), "xrgb8888", "xrgb1555"), "xrgb1555").alias("w"))
    return w.select("idx", F.expr("w % 256").alias("low"), F.expr("w div 256").cast("int").alias("high"))


@query(f"WITH {_PIXELS}, q AS (SELECT xrgb % 25 idx FROM p), {_PALETTE} SELECT xrgb, count(*) AS n FROM q JOIN pal USING (idx) GROUP BY xrgb")
def decode_palette_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Colours of indexed pixels; the palette is bounded, and broadcast."""
    p = pixels(spark, d).select(F.expr("xrgb % 25").alias("idx")).groupBy("idx").agg(F.count("*").alias("c"))
    return p.join(F.broadcast(palette(spark, d)), "idx").groupBy("xrgb").agg(F.sum("c").alias("n"))


@query()
def convert_paletted(spark: SparkSession, d: str) -> DataFrame:
    """Each run reduced to at most 16 colours on the 5-5-5 grid: colours, palette size and error in dB."""
    c = colours(spark, d)
    m = P.reduce_frames(c, "run_id", "xrgb", 16)
    j = C.with_lab(C.with_lab(c.join(m, ["run_id", "xrgb"]), "xrgb", "x"), "target", "y").withColumn("dd", _hyab())
    return j.groupBy("run_id").agg(F.count("*").alias("pixels"), F.countDistinct("target").alias("palette_size"), F.round(C.psnr(F.avg("dd")), 3).alias("psnr"))


@query()
def convert_common_palette(spark: SparkSession, d: str) -> DataFrame:
    """One palette of 32 colours for all runs, fitted on all their colours."""
    c = colours(spark, d)
    m = P.reduce_common(c, "xrgb", 32)
    return c.join(m, "xrgb").groupBy("run_id", "target").agg(F.count("*").alias("n"))


@query(f"WITH {_PIXELS}, q AS (SELECT DISTINCT xrgb % 25 idx FROM p), {_PALETTE} SELECT pal.idx, xrgb, {_TO555.replace('r *', '((xrgb >> 16) & 255) *').replace('g *', '((xrgb >> 8) & 255) *').replace('b *', '(xrgb & 255) *')} AS w555 FROM q JOIN pal ON pal.idx = q.idx")
def raw_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Indexed pixels as raw bytes, looked up in their palette, written as 5-5-5 words and read back."""
    used = pixels(spark, d).select(F.expr("xrgb % 25").alias("idx")).distinct().agg(F.array_sort(F.collect_set("idx")).alias("i"))  # at most 25 values
    img = used.crossJoin(F.broadcast(_palette_array(spark, d)))  # one row each
    raw = img.select("i", B.indexed_to_colors(B.mapped(lambda v: bytes(list(v)), T.BinaryType(), "i"), "a").alias("xrgb"))
    both = raw.select("i", "xrgb", B.words(B.colors_to_raw("xrgb", "xrgb1555"), 2).alias("w"))
    return both.select(F.explode(F.arrays_zip("i", "xrgb", "w")).alias("z")).select(F.col("z.i").cast("int").alias("idx"), "z.xrgb", F.col("z.w").cast("int").alias("w555"))


@query()
def reorder_colors(spark: SparkSession, d: str) -> DataFrame:
    """New place of each palette entry when like colours are put next to each other."""
    rows = palette(spark, d).orderBy("idx").collect()  # at most 256 entries
    order = P.distance_order([r["xrgb"] for r in rows])
    return spark.createDataFrame([(rows[i]["idx"], new, rows[i]["xrgb"]) for new, i in enumerate(order)], "idx int, new_idx int, xrgb int")
