import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import container as K
from tessera.sources import sinks as S

FRAMES = [("pixels", b"abcd"), ("audio", b"xy"), ("colormap", b"\1\2"), ("caption", K.caption_payload(1.5, 2.25, "Hé")), ("pixels", b"")]


def test_container_bytes():
    data = K.build(FRAMES, b"meta", rate=25.0, width=16, height=8, bits=8, sample_rate=22050, channels=1, sample_bits=16, video_steps=(60, 50), audio_steps=(61,), color_map_bits=15, color_map_size=256, video_memory=77, audio_offset=-3)
    assert data[:4] == b"0h2v"
    heads, frames, meta = K.parse(data)
    assert frames == FRAMES and meta == b"meta" and K.caption_of(frames[3][1]) == (1.5, 2.25, "Hé")
    assert heads["video"][0] == 2 and heads["audio"][:2] == (1, 1) and heads["captions"][0] == 1
    f = K.header_fields(heads)
    assert (f["rate"], f["width"], f["height"], f["bits"], f["video_steps"], f["audio_steps"], f["color_map_size"], f["video_memory"], f["audio_offset"]) == (25.0, 16, 8, 8, [60, 50], [61], 256, 77, -3)
    assert K.build(frames, meta, **f) == data
    for bad in (data[:30], b"\0" * 40, b"", data[:-6]):
        with pytest.raises(ValueError):
            K.parse(bad)
    for wrong in ({"metadata": b"x" * 70000}, {"video_steps": (1, 2, 3, 4, 5)}):
        with pytest.raises(ValueError):
            K.build(FRAMES, **wrong)


def test_container_source(spark, tmp_path):
    spark.dataSource.register(K.ContainerSource)
    rows = [("x", 0, "header", json.dumps({"rate": 12.5, "width": 4}).encode())] + [("x", i + 1, k, p) for i, (k, p) in enumerate(FRAMES)] + [("x", 9, "metadata", b"m")]
    df = spark.createDataFrame(rows, K.SCHEMA).coalesce(1)
    df.write.format("framebox").mode("append").option("height", 2).option("video_steps", "60,50").save(str(tmp_path / "c"))
    back = spark.read.format("framebox").load(str(tmp_path / "c")).orderBy("frame_no").collect()
    assert [(r["kind"], bytes(r["payload"])) for r in back[: len(FRAMES)]] == FRAMES
    head = json.loads(bytes(back[len(FRAMES)]["payload"]))
    assert (head["rate"], head["width"], head["height"], head["video_steps"]) == (12.5, 4, 2, [60, 50]) and bytes(back[-1]["payload"]) == b"m"
    with pytest.raises(Exception, match="no such file"):
        spark.read.format("framebox").load(str(tmp_path / "none")).count()


def test_png_and_files(spark, tmp_path):
    img = np.array([0xFF0000, 0x00FF00, 0x0000FF, 0xFFFFFF, 0, 0x123456])
    S.write_file(str(tmp_path / "a" / "i.png"), S.png_bytes(img, 3, 2))
    data = (tmp_path / "a" / "i.png").read_bytes()
    at = data.index(b"IDAT")
    rows = zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]])
    assert rows[:10] == b"\0\xff\0\0\0\xff\0\0\0\xff"
    r = S.read_images(spark, str(tmp_path / "a")).first()
    assert (r["width"], r["height"], r["format"]) == (3, 2, "xrgb8888") and np.frombuffer(bytes(r["payload"]), "<u4").tolist() == img.tolist()
    with pytest.raises(ValueError):
        S.png_bytes(img, 4, 2)
    df = spark.createDataFrame([("x", [[1, 2], [3]], b"\5\6", b"pix"), ("y", None, None, b"q")], "name string, maps array<array<int>>, palette_raw binary, payload binary")
    assert S.write_blobs(df, str(tmp_path / "b"), "name") == 4
    assert {p.name: p.read_bytes() for p in (tmp_path / "b").iterdir()} == {"x": b"pix", "x_map": b"\1\0\2\0\3\0", "x_pal": b"\5\6", "y": b"q"}


def test_colour_maps(spark, tmp_path):
    for fmt, h in (("xrgb1555", 128), ("rgb565", 256)):
        S.write_file(str(tmp_path / fmt / "m.png"), S.color_map_png(fmt))
        r = S.read_images(spark, str(tmp_path / fmt)).first()
        px = np.frombuffer(bytes(r["payload"]), "<u4")
        assert (r["width"], r["height"]) == (256, h) and px[0] == 0 and px[-1] == 0xFFFFFF and len(np.unique(px)) == len(px)


def test_wav():
    w = S.wav_bytes([1, 2, 3, 4], 2, 8000)
    assert w[:4] == b"RIFF" and w[8:16] == b"WAVEfmt " and struct.unpack("<HHIIHH", w[20:36]) == (1, 2, 8000, 32000, 4, 16) and w[44:] == b"\1\0\3\0\2\0\4\0"
    assert S.wav_bytes([-128, 127], 1, 8000, "s8")[44:] == b"\0\xff" and S.wav_bytes([0, 65535], 1, 8000, "u16")[44:] == b"\0\x80\xff\x7f"


def test_statistics(spark, tmp_path):
    df = spark.createDataFrame([(1, b"aab", 6), (2, b"", 6), (3, None, 6)], "k int, payload binary, was int")
    rows = {r["k"]: r for r in S.byte_statistics_rows(df, ["k"], "payload", "was").collect()}
    assert rows[1]["alphabet"] == 2 and abs(rows[1]["entropy"] - 0.918296) < 1e-5 and rows[1]["ratio"] == 50.0 and abs(rows[1]["shares"][97] - 2 / 3) < 1e-12
    assert rows[2]["alphabet"] == 0 and rows[2]["entropy"] == 0 and rows[3]["shares"] is None
    S.write_statistics_csv(S.byte_statistics_rows(df.filter("k = 1"), ["k"], "payload"), ["k"], str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).first()["b98"].startswith("0.33")
    c = spark.createDataFrame([(0xFF0102, 3, 0xFF0000)], "xrgb int, clusterindex int, clustercolor int")
    S.write_clusters_csv(c, str(tmp_path / "c"))
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "c")).first()) == ("255", "1", "2", "#FF0102", "3", "#FF0000")
    f = spark.createDataFrame([("s", 1, 1, 1, "xrgb8888", b"\1\2\3\0")], "stream string, frame_no int, width int, height int, format string, payload binary").withColumn("palette", F.lit(None).cast("array<int>"))
    assert bytes(S.statistics_images(f, "in").first()["png"]).startswith(b"\x89PNG")


def test_c_source(spark):
    df = spark.createDataFrame([(list(range(12)),)], "v array<int>")
    text = df.select(S.c_array("data", F.col("v")).alias("t")).first()["t"]
    assert text == "_Alignas(4) const uint8_t data[12] = {\n    0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x08, 0x09,\n    0x0A, 0x0B\n};\n"
    assert df.select(S.c_defines("img", width=F.lit(3)).alias("t")).first()["t"] == "#define IMG_WIDTH 3\n"


def test_video_frames_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([("v", 0, 0, 0.04, 1, 1, b"abcd"), ("v", 1, 1, 0.04, 1, 1, b"efgh")], "stream string, frame_no int, pts long, time_base double, width int, height int, payload binary")
    df.write.parquet(str(tmp_path / "v"))
    assert [r["pts_s"] for r in S.read_video_frames(spark, str(tmp_path / "v")).orderBy("frame_no").collect()] == [0.0, 0.04]
    df.withColumn("width", F.lit(9)).drop("pts").withColumn("frame_rate", F.lit(25.0)).write.parquet(str(tmp_path / "w"))
    with pytest.raises(Exception, match="doesn't fit"):
        S.read_video_frames(spark, str(tmp_path / "w")).collect()
    (tmp_path / "m").write_bytes(b"meta")
    assert S.read_metadata(str(tmp_path / "m"), True) == b"meta" and S.read_metadata("é", False) == "é".encode()
    for bad in ("", "x" * 70000):
        with pytest.raises(ValueError):
            S.read_metadata(bad, False)


def test_uniform(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "w int, h int")
    assert S.assert_uniform(df, "w").count() == 2
    with pytest.raises(Exception, match="differ"):
        S.assert_uniform(df, "w", "h").collect()
