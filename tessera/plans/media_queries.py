"""Queries of the tile, analytics, codec, audio and temporal operators, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import analytics as M
from tessera.operators import audio as AU
from tessera.operators import codecs as Z
from tessera.operators import dxt as V
from tessera.operators import palette as P
from tessera.operators import payloads as B
from tessera.operators import temporal as T
from tessera.operators import tiles as G
from tessera.plans.adapters import blocks, colours, document_bytes, frames, palette, payloads, tiles
from tessera.plans.frame_queries import _BYTES, _COLOURS, _FRAMES, _PALETTE
from tessera.session import table
from tessera.sources.srt import escape_text, parse_srt, srt_cue, srt_time

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BLOCKS = "e AS (SELECT vec_id, label, CAST(unnest(range(64)) AS INTEGER) pos, unnest(embedding)::DOUBLE v FROM embeddings)"

# --- tiles -------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_BLOCKS} SELECT vec_id, ((pos % 8) // 4 * 8 + pos // 8) * 4 + pos % 4 AS sprite_at, (pos // 16 // 8 * 2 + pos % 16 // 8) * 64 + pos // 16 % 8 * 8 + pos % 8 AS tile_at,
 pos // 8 // 4 * 2 + pos % 8 // 4 AS block, round(v, 6) AS v FROM e""")
def sprite_and_tile_positions(spark: SparkSession, d: str) -> DataFrame:
    """Places of pixels as sprites 4 wide, as tiles of a strip 16 wide, and the 4 x 4 block they lie in."""
    pos = F.col("pos")
    return blocks(spark, d).select(
        "vec_id", G.sprite_position(pos, 8, 8, 4).cast("int").alias("sprite_at"), G.tile_position(pos, 16).cast("int").alias("tile_at"), G.block_of(pos, 8, 4).cast("int").alias("block"), F.round("v", 6).alias("v")
    )


@query(f"WITH {_BLOCKS} SELECT vec_id, (pos // 8 - 3) * 4 + pos % 8 - 2 AS pos, round(v, 6) AS v FROM e WHERE pos % 8 BETWEEN 2 AND 5 AND pos // 8 BETWEEN 3 AND 6")
def crop_block(spark: SparkSession, d: str) -> DataFrame:
    """The 4 x 4 block at (2, 3)."""
    return G.crop(blocks(spark, d), "pos", 8, 2, 3, 4).select("vec_id", F.col("pos").cast("int").alias("pos"), F.round("v", 6).alias("v"))


@query(f"WITH {_BLOCKS} SELECT vec_id, pos // 8 // 4 * 2 + pos % 8 // 4 AS block, round(avg(v), 6) AS mean, count(*) AS n FROM e GROUP BY ALL")
def block_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of the quad-tree children of each block."""
    b = blocks(spark, d).withColumn("block", G.block_of(F.col("pos"), 8, 4).cast("int"))
    return b.groupBy("vec_id", "block").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("n"))


_TILES = "t AS (SELECT p_partkey p, list_transform(range(64), lambda i: (p_size % 7 + (i % 8) * (p_size % 3) + (i // 8) * (p_size % 2)) % 5) t FROM part)"


@query(f"WITH {_TILES}, f AS (SELECT t, min(p) p0 FROM t GROUP BY t), i AS (SELECT t, row_number() OVER (ORDER BY p0) - 1 id FROM f) SELECT p AS tile_pos, id AS tile_id, id AS entry FROM t JOIN i USING (t)")
def tile_map(spark: SparkSession, d: str) -> DataFrame:
    return G.tile_map(tiles(spark, d), "tile_pos", "tile").withColumns({c: F.col(c).cast("long") for c in ("tile_id", "entry")})


_FL = {"h": "(i // 8) * 8 + 7 - i % 8", "v": "(7 - i // 8) * 8 + i % 8", "hv": "63 - i"}


@query(f"""WITH {_TILES}, x AS (SELECT p, t, {', '.join(f'list_transform(range(64), lambda i: t[CAST({e} AS BIGINT) + 1]) {k}' for k, e in _FL.items())} FROM t),
k AS (SELECT *, least(t, h, v, hv) key FROM x), f AS (SELECT key, min(p) p0, arg_min(t, p) t0 FROM k GROUP BY key), i AS (SELECT *, row_number() OVER (ORDER BY p0) - 1 id FROM f)
SELECT p AS tile_pos, id AS tile_id, id + 1024 * CASE WHEN p = p0 THEN 0 WHEN hv = t0 THEN 3 WHEN v = t0 THEN 2 WHEN h = t0 THEN 1 ELSE 0 END AS entry FROM k JOIN i USING (key)""")
def tile_map_flips(spark: SparkSession, d: str) -> DataFrame:
    return G.tile_map(tiles(spark, d), "tile_pos", "tile", flips=True).withColumns({c: F.col(c).cast("long") for c in ("tile_id", "entry")})


_FLIPPED = f"x AS (SELECT p, p % 7 f, t, {', '.join(f'list_transform(range(64), lambda i: t[CAST({e} AS BIGINT) + 1]) {k}' for k, e in _FL.items())} FROM t), k AS (SELECT *, least(t, h, v, hv) key FROM x)"
_BITS = "CASE WHEN p = p0 THEN 0 WHEN hv = t0 THEN 3 WHEN v = t0 THEN 2 WHEN h = t0 THEN 1 ELSE 0 END"


@query(f"""WITH {_TILES}, {_FLIPPED}, f AS (SELECT f, key, min(p) p0, arg_min(t, p) t0 FROM k GROUP BY f, key), i AS (SELECT f, key, p0, t0, row_number() OVER (PARTITION BY f ORDER BY p0) - 1 id FROM f)
SELECT k.f AS frame, p AS tile_pos, id AS tile_id, id + 1024 * {_BITS} AS entry FROM k JOIN i ON i.f = k.f AND i.key = k.key""")
def frame_tile_maps(spark: SparkSession, d: str) -> DataFrame:
    """A screen map for each of seven frames, with flips."""
    t = tiles(spark, d).withColumn("frame", F.col("tile_pos") % 7)
    return G.tile_map(t, "tile_pos", "tile", flips=True, frame="frame").withColumns({c: F.col(c).cast("long") for c in ("tile_id", "entry")})


@query(f"""WITH {_TILES}, {_FLIPPED}, f AS (SELECT key, arg_min(p, (f, p)) p0, arg_min(t, (f, p)) t0, min((f, p)) o FROM k GROUP BY key), i AS (SELECT key, p0, t0, row_number() OVER (ORDER BY o) - 1 id FROM f)
SELECT f AS frame, p AS tile_pos, id AS tile_id, id + 16384 * {_BITS} AS entry FROM k JOIN i USING (key)""")
def common_tile_map(spark: SparkSession, d: str) -> DataFrame:
    """Screen maps of seven frames over one set of tiles."""
    t = tiles(spark, d).withColumn("frame", F.col("tile_pos") % 7)
    return G.common_tile_map(t, "frame", "tile_pos", "tile", flips=True).withColumns({c: F.col(c).cast("long") for c in ("tile_id", "entry")})


_GRAYS = f"WITH {_BLOCKS}, g AS (SELECT vec_id, label, pos, CAST(greatest(0, least(255, floor((v + 0.5) * 255))) AS INTEGER) * 65793 x FROM e), n AS (SELECT vec_id, pos, x, lead(x) OVER (PARTITION BY label, pos ORDER BY vec_id) y FROM g)"


@query(_GRAYS + """, c AS (SELECT vec_id, pos, (x & 255) / 255.0::DOUBLE a, (y & 255) / 255.0::DOUBLE b FROM n WHERE y IS NOT NULL)
SELECT vec_id, CAST(pos // 8 // 4 * 2 + pos % 8 // 4 AS INTEGER) AS block, round(avg(pow(a - b, 2) * (2 + (a + b) / 2 + 4 + 3 - (a + b) / 2) / 9), 6) AS mse FROM c GROUP BY ALL""")
def block_mse(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance of the 4 x 4 blocks of each gray 8 x 8 image and the next one of its label."""
    x = F.expr("cast(greatest(0, least(255, floor((v + 0.5) * 255))) as int) * 65793")
    g = blocks(spark, d).select("vec_id", "label", "pos", x.alias("x")).withColumn("y", F.lead("x").over(W.partitionBy("label", "pos").orderBy("vec_id"))).filter("y IS NOT NULL")
    return G.block_mse(g, ["vec_id"], "pos", "x", "y", 8, 4).withColumn("mse", F.round("mse", 6))


# --- analytics ---------------------------------------------------------------------------------------------------------------


@query("""SELECT run_id, min(r) AS min_r, max(r) AS max_r, min(g) AS min_g, max(g) AS max_g, min(b) AS min_b, max(b) AS max_b,
 round(sqrt(pow(max(r) - min(r), 2) + pow(max(g) - min(g), 2) + pow(max(b) - min(b), 2)), 6) AS diagonal
FROM colorfit_objects WHERE r BETWEEN 0 AND 255 AND g BETWEEN 0 AND 255 AND b BETWEEN 0 AND 255 AND run_id IS NOT NULL GROUP BY run_id""")
def bounding_boxes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "colorfit_objects").filter(" AND ".join(f"{c} BETWEEN 0 AND 255" for c in "rgb") + " AND run_id IS NOT NULL")
    return M.bounding_box(o, ["run_id"], ["r", "g", "b"]).withColumn("diagonal", F.round("diagonal", 6))


@query(f"WITH {_BLOCKS}, n AS (SELECT *, lead(v) OVER (PARTITION BY label, pos ORDER BY vec_id) w FROM e) SELECT vec_id, round(corr(v, w), 5) AS r, round(sum(v * w), 5) AS conv FROM n WHERE w IS NOT NULL GROUP BY vec_id")
def correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation and convolution at shift zero of each block and the next one of its label."""
    n = blocks(spark, d).withColumn("w", F.lead("v").over(W.partitionBy("label", "pos").orderBy("vec_id"))).filter("w IS NOT NULL")
    return n.groupBy("vec_id").agg(F.round(F.corr("v", "w"), 5).alias("r"), F.round(M.convolution0(F.col("v"), F.col("w")), 5).alias("conv"))


@query(f"""WITH {_BLOCKS}, k AS (SELECT range u FROM range(8)), s AS (SELECT vec_id, pos // 8 y, u, sum(v * cos(pi() / 8 * (pos % 8 + 0.5) * u)) c FROM e, k GROUP BY ALL)
SELECT vec_id, CAST(s.u AS INTEGER) AS u, CAST(k.u AS INTEGER) AS v, round(sum(c * cos(pi() / 8 * (y + 0.5) * k.u)), 5) AS coefficient FROM s, k GROUP BY vec_id, s.u, k.u""")
def dct(spark: SparkSession, d: str) -> DataFrame:
    """DCT-II coefficients of every 8 x 8 block."""
    return M.dct2(blocks(spark, d), ["vec_id"], "pos", "v").withColumn("coefficient", F.round("coefficient", 5) + F.lit(0.0))


@query("""WITH x AS (SELECT user_id % 16 id, event_type, floor(value) v FROM events) SELECT id, event_type AS stat, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM x GROUP BY ALL""")
def statistics_counters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 16).alias("id"), F.col("event_type").alias("stat"), F.floor("value").alias("v"))
    return e.groupBy("id", "stat").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


@query("""WITH x AS (SELECT event_type, CAST(user_id % 37 AS INTEGER) i, sum(floor(value)) v FROM events GROUP BY ALL), m AS (SELECT event_type, max(i) t FROM x GROUP BY event_type),
g AS (SELECT event_type, CAST(unnest(range(t + 1)) AS INTEGER) i FROM m) SELECT g.event_type AS stat, g.i AS idx, coalesce(v, 0.0)::DOUBLE AS total FROM g LEFT JOIN x ON x.event_type = g.event_type AND x.i = g.i""")
def indexed_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters by name and index, those never counted included."""
    e = table(spark, d, "events").select(F.col("event_type").alias("stat"), (F.col("user_id") % 37).alias("idx"), F.floor("value").alias("total"))
    return M.counters(e, ["stat"], "idx", "total")


@query("""SELECT source, count(*) AS frames, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, round(sum(octet_length(encode(text))) / 1024.0 / count(*), 4) AS kb_per_frame, max(octet_length(encode(text))) + 4 AS max_memory,
 round(100.0 * sum(length(text)) / sum(octet_length(encode(text))), 4) AS chars_per_100_bytes FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source""")
def size_report(spark: SparkSession, d: str) -> DataFrame:
    """Frames, sizes, memory needed and characters in a hundred bytes of each source."""
    t = table(spark, d, "documents").filter("text IS NOT NULL AND source IS NOT NULL").select("source", F.octet_length("text").cast("long").alias("b"), F.length("text").alias("c"))
    return t.groupBy("source").agg(
        F.count("*").alias("frames"), F.sum("b").alias("bytes"), F.round(F.sum("b") / 1024.0 / F.count("*"), 4).alias("kb_per_frame"), (F.max("b") + 4).alias("max_memory"), F.round(F.sum("c") * 100.0 / F.sum("b"), 4).alias("chars_per_100_bytes")
    )


_MIX = "CAST(floor((({0} >> {2}) & 255) * 0.75 + (({1} >> {2}) & 255) * 0.25 + 0.5) AS INTEGER)"
_MSE = "((2 + ({a} // 65536 + {b} // 65536) / 510.0) * pow(({a} // 65536 - {b} // 65536) / 255.0, 2) + 4 * pow((({a} >> 8) & 255) / 255.0 - (({b} >> 8) & 255) / 255.0, 2) + (3 - ({a} // 65536 + {b} // 65536) / 510.0) * pow(({a} & 255) / 255.0 - ({b} & 255) / 255.0, 2)) / 9"


@query(f"""WITH {_PALETTE}, m AS (SELECT a.idx i, b.idx j, {_MIX.format('a.xrgb', 'b.xrgb', 16)} * 65536 + {_MIX.format('a.xrgb', 'b.xrgb', 8)} * 256 + {_MIX.format('a.xrgb', 'b.xrgb', 0)} mix FROM pal a, pal b)
SELECT i, j, arg_min(idx, (round({_MSE.format(a='mix', b='xrgb')}, 9), idx)) AS idx FROM m, pal GROUP BY i, j""")
def fade_table(spark: SparkSession, d: str) -> DataFrame:
    """Nearest palette entry to a quarter fade of each pair of entries."""
    return M.fade_table(palette(spark, d), 0.25)


@query()
def fade_index_map(spark: SparkSession, d: str) -> DataFrame:
    """Whole fade table: the palette closed under fading by one step and mixing, reduced to 256 colours, and the nearest entry to all 65,536 pairs."""
    return M.fade_index_map(palette(spark, d), 1)


# --- coders ------------------------------------------------------------------------------------------------------------------


@query(f"WITH {_BYTES} SELECT doc_id, count(*) AS n_bytes, true AS lz4, true AS lzss, true AS rans FROM b GROUP BY doc_id")
def coder_round_trips(spark: SparkSession, d: str) -> DataFrame:
    """Whether each coder gives back every document's bytes."""
    p = payloads(spark, d)
    for c in Z.CODERS:
        p = p.withColumn(f"_{c}", Z.encode(F.col("payload"), c))
    back = [(Z.decode(F.col(f"_{c}"), c) == F.col("payload")).alias(c) for c in Z.CODERS]
    return p.select("doc_id", F.octet_length("payload").cast("long").alias("n_bytes"), *back)


@query()
def compressed_sizes(spark: SparkSession, d: str) -> DataFrame:
    p = payloads(spark, d)
    return p.select("doc_id", F.octet_length("payload").alias("n_bytes"), *(F.octet_length(Z.encode(F.col("payload"), c)).alias(f"{c}_bytes") for c in Z.CODERS))


_RANS = f"""WITH {_BYTES}, h AS (SELECT doc_id, b, count(*) n FROM b GROUP BY ALL), f AS (SELECT *, n * 16384.0::DOUBLE / sum(n) OVER (PARTITION BY doc_id) f FROM h),
c AS (SELECT doc_id, b, CAST(greatest(1, least(16383, floor(f + 0.5))) AS BIGINT) c, round(f - floor(f), 9) fr FROM f), s AS (SELECT *, 16384 - sum(c) OVER (PARTITION BY doc_id) d FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN d > 0 THEN -fr ELSE fr END, b) r, CASE WHEN d > 0 THEN 16383 - c ELSE c - 1 END room FROM s),
u AS (SELECT doc_id, b, r, d, unnest(range(1, CAST(least(room, abs(d)) AS BIGINT) + 1)) u FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY u, r) o FROM u),
m AS (SELECT doc_id, b, CAST(count(*) * sign(max(d)) AS BIGINT) m FROM o WHERE o <= abs(d) GROUP BY ALL)"""


@query(_RANS + " SELECT r.doc_id, r.b, r.c + coalesce(m, 0) AS c FROM r LEFT JOIN m ON r.doc_id = m.doc_id AND r.b = m.b")
def scaled_counts(spark: SparkSession, d: str) -> DataFrame:
    """Symbol counts of every document scaled to 2^14."""
    return M.scaled_counts(P.histogram(document_bytes(spark, d), "b", "doc_id"), ["doc_id"], "b", "n")


# --- block codecs --------------------------------------------------------------------------------------------------------------

_W5 = "(((((({0} >> 16) & 255) * 249 + 1014) >> 11) << 10) | ((((({0} >> 8) & 255) * 249 + 1014) >> 11) << 5) | ((({0} & 255) * 249 + 1014) >> 11))"
_CH = "CASE WHEN i = 0 THEN a{0} WHEN i = 1 THEN b{0} WHEN i = 2 THEN CASE WHEN c0 > c1 THEN (2 * a{0} + b{0} + 1) // 3 ELSE (a{0} + b{0} + 1) // 2 END ELSE CASE WHEN c0 > c1 THEN (a{0} + 2 * b{0} + 1) // 3 ELSE 0 END END"


@query(f"""WITH {_COLOURS}, w AS (SELECT object_id, {_W5.format('xrgb')} c0, {_W5.format('((xrgb * 31 + 77) % 16777216)')} c1, unnest(range(4)) i FROM c),
x AS (SELECT *, (c0 >> 10) & 31 ar, (c0 >> 5) & 31 ag, c0 & 31 ab, (c1 >> 10) & 31 br, (c1 >> 5) & 31 bg, c1 & 31 bb FROM w),
y AS (SELECT object_id, i, {_CH.format('r')} r, {_CH.format('g')} g, {_CH.format('b')} b FROM x)
SELECT object_id, CAST(i AS INTEGER) AS i, CAST((((r * 527 + 23) >> 6) << 16) | (((g * 527 + 23) >> 6) << 8) | ((b * 527 + 23) >> 6) AS INTEGER) AS xrgb FROM y""")
def dxt_decode(spark: SparkSession, d: str) -> DataFrame:
    """The four colours that two end-point words stand for."""
    from tessera.functions import color as C

    w = lambda x: C.convert_packed(x, "xrgb8888", "xrgb1555")
    c = colours(spark, d).select("object_id", w(F.col("xrgb")).alias("c0"), w(F.expr("cast((cast(xrgb as bigint) * 31 + 77) % 16777216 as int)")).alias("c1"), F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("i"))
    return c.select("object_id", "i", V.decoded_pixel(F.col("c0"), F.col("c1"), F.col("i")).alias("xrgb"))


def _images(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, xrgb): 8 x 8 images whose channels come from a block and its two neighbours of the label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.expr("transform(embedding, x -> cast(greatest(0, least(255, floor((x + 0.5) * 255))) as int))").alias("c"))
    w = W.partitionBy("label").orderBy("vec_id")
    n = e.withColumns({"g": F.coalesce(F.lag("c", 1).over(w), "c"), "b": F.coalesce(F.lag("c", 2).over(w), "c")})
    return n.select("vec_id", "label", F.expr("transform(sequence(0, 63), i -> c[i] * 65536 + g[i] * 256 + b[i])").alias("xrgb"))


@query("SELECT vec_id, 32 AS bytes, true AS close FROM embeddings")
def dxt_encode(spark: SparkSession, d: str) -> DataFrame:
    """Coded size of 8 x 8 images, and whether the decoded image stays within 0.1 of mean distance."""

    @F.pandas_udf("bytes int, close boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for x in s:
                x = np.asarray(x)
                data = V.encode_image(x, 8, 8)
                back = V.decode_image(data, 8, 8)
                err = V.distance(V._rgbf(x), V._rgbf(back), "weighted").mean()
                rows.append((len(data), bool(err < 0.1)))
            yield pd.DataFrame(rows, columns=["bytes", "close"])

    return _images(spark, d).select("vec_id", run("xrgb").alias("r")).select("vec_id", "r.bytes", "r.close")


_GRID = "(((((({0} >> 16) & 255) * 249 + 1014) >> 11) * 527 + 23) >> 6) * 65536 + (((((({0} >> 8) & 255) * 249 + 1014) >> 11) * 527 + 23) >> 6) * 256 + (((((({0} & 255) * 249 + 1014) >> 11) * 527 + 23) >> 6))"


@query(f"""WITH p AS (SELECT p_partkey, unnest(range(64)) i, p_size, p_partkey * 7919 % 16777216 a, (p_partkey * 104729 + 77) % 16777216 b FROM part), c AS (SELECT p_partkey, i, CASE WHEN i * p_size % 3 = 0 THEN a ELSE b END x FROM p)
SELECT p_partkey, CAST(i AS INTEGER) AS pos, CAST({_GRID.format('x')} AS INTEGER) AS xrgb FROM c""")
def dxt_two_colours(spark: SparkSession, d: str) -> DataFrame:
    """8 x 8 images of two colours, coded and decoded: each pixel comes back as its colour on the grid of the format."""
    from pyspark.sql import types as ty

    def through(a, b, size) -> list[int]:
        img = np.where(np.arange(64) * int(size) % 3 == 0, int(a), int(b))
        return V.decode_image(V.encode_image(img, 8, 8), 8, 8).tolist()

    p = table(spark, d, "part").select("p_partkey", "p_size", F.expr("p_partkey * 7919 % 16777216").alias("a"), F.expr("(p_partkey * 104729 + 77) % 16777216").alias("b"))
    return p.select("p_partkey", F.posexplode(B.mapped(through, ty.ArrayType(ty.IntegerType()), "a", "b", "p_size")).alias("pos", "xrgb"))


@query("SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame_no, true AS equal FROM embeddings")
def dxtv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Motion-coded streams of 8 x 8 images: whether decoding gives what the coder saw."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        prev = dec = None
        rows = []
        for i, x in enumerate(pdf["xrgb"]):
            data, prev = V.dxtv_encode(np.asarray(x).reshape(8, 8), prev, 90)
            dec = V.dxtv_decode(data, 8, 8, dec)
            rows.append((i, bool((dec == prev).all())))
        return pd.DataFrame({"label": pdf["label"].iloc[0], "frame_no": [r[0] for r in rows], "equal": [r[1] for r in rows]})

    return _images(spark, d).groupBy("label").applyInPandas(run, "label int, frame_no int, equal boolean")


@query(f"WITH {_FRAMES} SELECT event_id, CAST(s % 2 + (s * 16) * 256 AS BIGINT) AS word, s % 2 AS flags, s * 16 AS size, CAST(2 * 32 + 2048 + 32768 + CAST(s % 65536 AS BIGINT) * 65536 AS BIGINT) AS adpcm, CAST(s % 65536 AS BIGINT) AS adpcm_size FROM f")
def frame_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header words of motion-coded and ADPCM frames, and their fields read back."""
    f = frames(spark, d).withColumn("word", V.dxtv_header(F.col("s") % 2, F.col("s") * 16)).withColumn("adpcm", AU.adpcm_header(F.lit(2), F.col("s") % 65536))
    return f.select("event_id", "word", F.expr("cast(word & 255 as int)").alias("flags"), F.expr("cast(shiftright(word, 8) as int)").alias("size"), "adpcm", AU.adpcm_header_fields(F.col("adpcm"))["size"].alias("adpcm_size"))


# --- audio -------------------------------------------------------------------------------------------------------------------

@query(f"""WITH {_FRAMES} SELECT event_id, (s % 256 - 128 + 128) * 257 - 32768 AS s8, s % 256 * 257 - 32768 AS u8, s % 65536 - 32768 AS u16,
 CAST(trunc(greatest(-32768, least(32767, (s % 2001 - 1000) / 1000.0 * 32768))) AS INTEGER) AS f32 FROM f""")
def sample_formats(spark: SparkSession, d: str) -> DataFrame:
    """Samples of all formats as signed 16-bit ones."""
    s = F.col("s")
    return frames(spark, d).select(
        "event_id", AU.to_signed16(s % 256 - 128, "s8").alias("s8"), AU.to_signed16(s % 256, "u8").alias("u8"), AU.to_signed16(s % 65536, "u16").alias("u16"), AU.to_signed16((s % 2001 - 1000) / 1000.0, "f32").alias("f32")
    )


@query("SELECT vec_id, pos % 32 * 2 + pos // 32 AS at, round(v, 6) AS v FROM (SELECT vec_id, unnest(range(64)) pos, unnest(embedding)::DOUBLE v FROM embeddings)")
def interleave_samples(spark: SparkSession, d: str) -> DataFrame:
    """Two planes of 32 samples as L0 R0 L1 R1."""
    b = blocks(spark, d)
    return b.select("vec_id", AU.interleaved_position(F.floor(F.col("pos") / 32), F.col("pos") % 32, 2).alias("at"), F.round("v", 6).alias("v"))


_INT16 = "CAST(greatest(-32768, least(32767, floor(v * 20000))) AS INTEGER)"


@query("SELECT vec_id, 64 AS samples, true AS close FROM embeddings")
def adpcm_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """ADPCM of two planes of 32 samples: samples that come back, and whether the mean error is below an eighth of the range."""
    x = F.transform("embedding", lambda v: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(v * 20000))).cast("int"))
    e = table(spark, d, "embeddings").select("vec_id", x.alias("x")).withColumn("back", AU.un_adpcm(AU.adpcm("x", 2)))
    err = F.aggregate(F.zip_with("x", "back", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda a, v: a + v) / 64
    spread = (F.array_max("x") - F.array_min("x")) / 8
    return e.select("vec_id", F.size("back").alias("samples"), (err <= F.greatest(F.lit(64.0), spread)).alias("close"))


_STEP_LIST = "[" + ", ".join(map(str, AU.STEPS)) + "]"


@query(f"""WITH RECURSIVE n AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(abs(floor(v::DOUBLE * 64)) AS INTEGER) % 16) k FROM embeddings),
r(vec_id, k, i, value, idx) AS (SELECT vec_id, k, 0, CAST(100 AS BIGINT), CAST(10 AS BIGINT) FROM n
 UNION ALL SELECT vec_id, k, i + 1, greatest(-32768, least(32767, value + CASE WHEN q & 8 = 8 THEN -m ELSE m END)), greatest(0, least(88, idx + [-1, -1, -1, -1, 2, 4, 6, 8][(q & 7) + 1])) FROM
 (SELECT *, k[i + 1] q, (s >> 3) + CASE WHEN k[i + 1] & 4 = 4 THEN s ELSE 0 END + CASE WHEN k[i + 1] & 2 = 2 THEN s >> 1 ELSE 0 END + CASE WHEN k[i + 1] & 1 = 1 THEN s >> 2 ELSE 0 END m FROM
  (SELECT *, {_STEP_LIST}[idx + 1] s FROM r WHERE i < 63)))
SELECT vec_id, i AS pos, CAST(value AS INTEGER) AS sample FROM r""")
def adpcm_decode(spark: SparkSession, d: str) -> DataFrame:
    """Samples of frames of 64 that are made of the nibbles of each block."""
    k = F.transform("embedding", lambda v: F.abs(F.floor(v.cast("double") * 64)).cast("int") % 16)

    def frame(nibbles) -> bytes:
        import struct

        v = [int(x) for x in nibbles]
        return struct.pack("<IhBB", 1 << 5 | 16 << 7 | 4 << 13 | 128 << 16, 100, 10, 0) + bytes(a | b << 4 for a, b in zip(v[::2], v[1::2]))

    from pyspark.sql import types as ty

    f = table(spark, d, "embeddings").select("vec_id", k.alias("k")).select("vec_id", AU.un_adpcm(B.mapped(frame, ty.BinaryType(), "k")).alias("x"))
    return f.select("vec_id", F.posexplode("x").alias("pos", "sample"))


_SINC = "CASE WHEN abs(u) >= 16 THEN 0 WHEN u = 0 THEN 1 ELSE sin(pi() * u) / (pi() * u) * (0.5 + 0.5 * cos(pi() * u / 16)) END"


@query(f"""WITH e AS (SELECT vec_id, embedding x FROM embeddings), k AS (SELECT range k, range * 22050 / 16000.0::DOUBLE t FROM range(47)), p AS (SELECT k, t, CAST(floor(t) AS BIGINT) + unnest(range(-24, 25)) i FROM k),
u AS (SELECT k, i, (t - i) * 16000 / 22050.0::DOUBLE u FROM p), w AS (SELECT k, i, {_SINC} w FROM u), s AS (SELECT k, sum(w) n FROM w GROUP BY k)
SELECT vec_id, CAST(w.k AS INTEGER) AS pos, round(sum(w * x[i + 1]::DOUBLE) / any_value(n), 5) AS sample FROM e, w JOIN s ON s.k = w.k WHERE i BETWEEN 0 AND 63 GROUP BY vec_id, w.k""")
def resample(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 64 samples taken from 22050 to 16000 Hz."""
    from pyspark.sql import types as ty

    out = B.mapped(lambda x: AU.resample(np.asarray(x, float), 22050, 16000).tolist(), ty.ArrayType(ty.DoubleType()), "embedding")
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(out).alias("pos", "sample")).withColumn("sample", F.round("sample", 5) + F.lit(0.0))


@query(f"""WITH x AS (SELECT vec_id, unnest(range(64)) i, unnest(embedding)::DOUBLE v FROM embeddings), s AS (SELECT vec_id, i, {_INT16} s FROM x)
SELECT vec_id, i % 32 * 4 + i // 32 * 2 + b AS pos, CASE WHEN b = 0 THEN (s + 65536) % 256 ELSE (s + 65536) % 65536 // 256 END AS byte FROM s, (SELECT unnest([0, 1]) b)""")
def raw_samples(spark: SparkSession, d: str) -> DataFrame:
    """Two planes of 32 signed 16-bit samples as interleaved raw data."""
    x = F.transform("embedding", lambda v: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(v.cast("double") * 20000))).cast("int"))
    e = table(spark, d, "embeddings").select("vec_id", AU.to_raw(x, "s16", 2, interleave=True).alias("raw"))
    return e.select("vec_id", F.posexplode(B.words("raw", 1)).alias("pos", "byte")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH RECURSIVE {_FRAMES}, n AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY ts, event_id) k, s % 700 n FROM f),
r(stream, k, buf, no, got, delta, carry) AS (SELECT DISTINCT stream, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM n
 UNION ALL SELECT stream, k, b - coalesce(g, 0), no + CASE WHEN g IS NULL THEN 0 ELSE 1 END, g, CAST(0 AS BIGINT), carry + coalesce(g - 367.5, 0) FROM
 (SELECT r.stream, n.k, r.no, r.carry, r.buf + n.n b, CASE WHEN r.buf + n.n >= CAST(ceil(ceil(367.5 - r.carry) / 16.0) * 16 AS BIGINT) THEN CAST(ceil(ceil(367.5 - r.carry) / 16.0) * 16 AS BIGINT) END g FROM r JOIN n ON n.stream = r.stream AND n.k = r.k + 1))
SELECT stream, CAST(no - 1 AS INTEGER) AS window_no, CAST(got AS INTEGER) AS n_samples, 0 AS padded FROM r WHERE got IS NOT NULL
UNION ALL SELECT stream, CAST(no AS INTEGER), CAST(ceil(buf / 16.0) * 16 AS INTEGER), CAST(ceil(buf / 16.0) * 16 - buf AS INTEGER) FROM r WHERE buf > 0 AND (stream, k) IN (SELECT (stream, max(k)) FROM n GROUP BY stream)""")
def repackage(spark: SparkSession, d: str) -> DataFrame:
    """Streams of sample counts re-windowed to 367.5 samples on average, in multiples of 16."""
    f = frames(spark, d).withColumn("n", F.col("s") % 700)
    return T.repackage(f, "stream", ["ts", "event_id"], "n", 367.5, 16)


# --- pipelines -----------------------------------------------------------------------------------------------------------------


def _image_frames(spark: SparkSession, d: str) -> DataFrame:
    """The 8 x 8 images as frames: streams by label, frames in order of vec_id."""
    from pyspark.sql import types as ty

    raw = B.mapped(lambda x: B.color_bytes(x, "xrgb8888"), ty.BinaryType(), "xrgb")
    return _images(spark, d).select(F.col("label").alias("stream"), F.col("vec_id").alias("frame_no"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit("xrgb8888").alias("format"), raw.alias("payload"))


@query("SELECT vec_id AS frame_no, true AS back, 256 AS bytes FROM embeddings")
def pipeline_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Frames through tiles, deltas and three coders, and through the inverse pipeline: whether each gives back what went in after the tiles."""
    from tessera.plans.image_steps import STEPS
    from tessera.plans.pipeline import Pipeline

    tiled = Pipeline(STEPS).add("tiles").run(_image_frames(spark, d)).drop("max_memory").withColumn("was", F.col("payload"))
    p = Pipeline(STEPS).add("delta_image").add("delta16").add("lz4").add("rans").add("lzss")
    back = p.inverse().run(p.run(tiled))
    return back.select("frame_no", (F.col("payload") == F.col("was")).alias("back"), F.octet_length("payload").alias("bytes"))


@query(f"""WITH {_BLOCKS}, g AS (SELECT vec_id, label, pos, CAST(greatest(0, least(255, floor((v + 0.5) * 255))) AS INTEGER) x FROM e), w AS (SELECT vec_id, label, pos, CASE WHEN x * 16843009::BIGINT IS NULL THEN 0 ELSE x END x FROM g),
m AS (SELECT vec_id, pos, lag(x, 0) OVER q r, coalesce(lag(x, 1) OVER q, x) g, coalesce(lag(x, 2) OVER q, x) b FROM w WINDOW q AS (PARTITION BY label, pos ORDER BY vec_id)),
k AS (SELECT vec_id, pos, CASE WHEN (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255 >= 0.5 THEN 1 ELSE 0 END i FROM m), s AS (SELECT vec_id, pos // 8 n, CAST(sum(i << (pos % 8)) AS INTEGER) byte FROM k GROUP BY vec_id, pos // 8)
SELECT vec_id AS frame_no, n AS pos, byte FROM s""")
def pipeline_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Frames in black and white, one bit a pixel."""
    from tessera.plans.image_steps import STEPS
    from tessera.plans.pipeline import Pipeline

    f = Pipeline(STEPS).add("black_white", threshold=0.5).add("prune_indices", bits=1).run(_image_frames(spark, d))
    return f.select("frame_no", F.posexplode(B.words("payload", 1)).alias("pos", "byte")).select("frame_no", F.col("pos").cast("long").alias("pos"), F.col("byte").cast("int").alias("byte"))


@query()
def pipeline_counters(spark: SparkSession, d: str) -> DataFrame:
    """Frames, bytes, ratio and memory of a chain of palette, tile and coder steps."""
    from tessera.plans.image_steps import STEPS
    from tessera.plans.pipeline import Pipeline, counters

    f = _image_frames(spark, d)
    p = Pipeline(STEPS).add("paletted", colors=16, grid="xrgb1555").add("reorder_colors").add("tiles").add("delta8").add("lz4")
    return counters(f, p.run(f))


@query(f"""WITH {_FRAMES}, n AS (SELECT stream, count(*) * 100 n FROM f GROUP BY stream) SELECT stream, CAST(ceil(n / 16.0) * 16 AS BIGINT) AS samples, CAST((-n) % 16 + CASE WHEN n % 16 = 0 THEN 0 ELSE 16 END AS BIGINT) AS padded FROM n""")
def audio_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Audio frames of 100 samples re-windowed to 367.5 on average, as ADPCM and back: samples that come out of each stream, and how many of them were added at its end."""
    from tessera.plans.audio_steps import STEPS
    from tessera.plans.pipeline import Pipeline

    f = frames(spark, d)
    wave = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: (F.col("s") % 2000 + i * 10).cast("double"))
    no = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    f = f.select("stream", no.alias("frame_no"), F.lit(1).alias("channels"), F.lit("s16").alias("sample_format"), wave.alias("samples"))
    p = Pipeline(STEPS).add("repackage", channels=1, format="s16", per_frame=367.5, modulo=16).add("adpcm").add("lzss")
    back = p.inverse().run(p.run(f))
    n = F.sum(F.size("samples")).cast("long")
    whole = f.groupBy("stream").agg((F.count("*") * 100).alias("n"))
    return back.groupBy("stream").agg(n.alias("samples")).join(whole, "stream").select("stream", "samples", (F.col("samples") - F.col("n")).alias("padded"))


# --- time ----------------------------------------------------------------------------------------------------------------------

_SUBS = "u AS (SELECT DISTINCT sub_id, track_id, start_s, end_s FROM subtitles WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s) AND end_s > start_s AND track_id IS NOT NULL)"


def _subs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "subtitles").select("sub_id", "track_id", "start_s", "end_s")
    return s.filter("start_s IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s) AND end_s > start_s AND track_id IS NOT NULL").distinct()


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    """A tick every 5 seconds up to each track's last end."""
    t = _subs(spark, d).groupBy("track_id").agg(F.max("end_s").alias("e"))
    return t.select("track_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("e") / 5).cast("int"))).alias("n")).withColumn("t", F.col("n") * 5.0)


_TICKS = "k AS (SELECT track_id, unnest(range(0, CAST(floor(e / 5) AS BIGINT) + 1)) n FROM (SELECT track_id, max(end_s) e FROM u GROUP BY track_id))"


@query(f"WITH {_SUBS}, {_TICKS} SELECT k.track_id, CAST(n AS INTEGER) AS n, sub_id FROM k JOIN u ON u.track_id = k.track_id AND start_s <= n * 5.0 AND n * 5.0 < end_s")
def active_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions that are shown at each tick of a track."""
    return T.active_intervals(_ticks(spark, d), _subs(spark, d), "track_id", "t", "start_s", "end_s", 8.0).select("track_id", "n", "sub_id")


@query(f"WITH {_SUBS}, {_TICKS} SELECT k.track_id, CAST(n AS INTEGER) AS n, arg_max(sub_id, (start_s, sub_id)) AS sub_id FROM k JOIN u ON u.track_id = k.track_id AND start_s <= n * 5.0 GROUP BY ALL")
def latest_caption(spark: SparkSession, d: str) -> DataFrame:
    """Caption that began last before each tick."""
    s = _subs(spark, d).select("track_id", F.col("start_s").alias("t"), "sub_id")
    return T.as_of(_ticks(spark, d), s, "track_id", "t", "sub_id").filter("sub_id IS NOT NULL").select("track_id", "n", "sub_id")


@query(f"""WITH {_SUBS}, {_TICKS}, i AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_s, sub_id) - 1 i FROM u), c AS (SELECT track_id, max(n) top FROM k GROUP BY track_id),
f AS (SELECT i.track_id, i, CAST(ceil(start_s / 5) AS BIGINT) f, top FROM i JOIN c USING (track_id)), e AS (SELECT track_id, i, top, max(f - i) OVER (PARTITION BY track_id ORDER BY i ROWS UNBOUNDED PRECEDING) + i e FROM f WHERE f <= top)
SELECT track_id, i AS cap_no, e AS frame_no FROM e WHERE e <= top""")
def inject_captions(spark: SparkSession, d: str) -> DataFrame:
    """Tick with which each caption goes out, at most one for each tick."""
    s = _subs(spark, d).withColumn("cap_no", F.row_number().over(W.partitionBy("track_id").orderBy("start_s", "sub_id")) - 1)
    return T.inject(_ticks(spark, d).withColumnRenamed("n", "frame_no"), s, "track_id", "frame_no", "t", "cap_no", "start_s")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS turn FROM events")
def interleave_streams(spark: SparkSession, d: str) -> DataFrame:
    return T.interleave_streams(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", F.col("turn").cast("long").alias("turn"))


@query("""WITH RECURSIVE n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM events),
r(user_id, event_id, k, last, kept) AS (SELECT user_id, event_id, k, value, true FROM n WHERE k = 1
 UNION ALL SELECT n.user_id, n.event_id, n.k, CASE WHEN (n.value - last) * (n.value - last) >= 100 THEN n.value ELSE last END, (n.value - last) * (n.value - last) >= 100 FROM r JOIN n ON n.user_id = r.user_id AND n.k = r.k + 1)
SELECT event_id FROM r WHERE kept""")
def drop_repeated_frames(spark: SparkSession, d: str) -> DataFrame:
    return T.drop_repeats(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 100.0).select("event_id")


@query("SELECT file_id, round(video_nr_of_frames / video_frame_rate_hz, 4) AS duration_s, CAST(floor(video_frame_rate_hz * 65536 + 0.5) AS BIGINT) AS rate_fixed FROM media_files WHERE video_nr_of_frames IS NOT NULL AND video_frame_rate_hz > 0")
def presentation_times(spark: SparkSession, d: str) -> DataFrame:
    """Time behind the last frame, and the rate as a 16.16 fixed-point number."""
    m = table(spark, d, "media_files").filter("video_nr_of_frames IS NOT NULL AND video_frame_rate_hz > 0")
    return m.select("file_id", F.round(F.col("video_nr_of_frames") / F.col("video_frame_rate_hz"), 4).alias("duration_s"), F.floor(F.col("video_frame_rate_hz") * 65536 + 0.5).alias("rate_fixed"))


@query("""WITH s AS (SELECT DISTINCT sub_id, start_s, end_s, text FROM subtitles WHERE start_s >= 0 AND end_s > start_s AND NOT isnan(start_s) AND NOT isnan(end_s) AND end_s < 360000 AND text IS NOT NULL),
m AS (SELECT sub_id, CAST(round(start_s * 1000) AS BIGINT) a, CAST(round(end_s * 1000) AS BIGINT) b FROM s)
SELECT sub_id, printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) AS start_text, printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) AS end_text, true AS back FROM m WHERE b > a""")
def srt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Captions written as SubRip cues and read again: whether each gives one cue with its times and its whole text."""
    ok = "start_s >= 0 AND end_s > start_s AND NOT isnan(start_s) AND NOT isnan(end_s) AND end_s < 360000 AND text IS NOT NULL AND round(end_s * 1000) > round(start_s * 1000)"
    keys = ["sub_id", "start_s", "end_s", "text"]
    s = table(spark, d, "subtitles").filter(ok).select(*keys).distinct().select("sub_id", F.col("start_s").alias("a"), F.col("end_s").alias("b"), F.col("text").alias("t"))
    s = s.withColumn("file", srt_cue(F.lit(1), F.col("a"), F.col("b"), escape_text(F.col("t"))))
    c = parse_srt(s, ["sub_id", "a", "b", "t"], "file", escaped=True)
    same = F.col("ok") & (F.abs(F.col("a") - F.col("start_s")) < 0.00051) & (F.abs(F.col("b") - F.col("end_s")) < 0.00051) & (F.col("t") == F.col("text"))
    j = c.groupBy("sub_id", "a", "b", "t").agg((F.bool_and(F.coalesce(same, F.lit(False))) & (F.count("*") == 1)).alias("back"))
    return j.select("sub_id", srt_time(F.col("a")).alias("start_text"), srt_time(F.col("b")).alias("end_text"), "back")
