import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import payloads as B
from tessera.plans import audio_steps, image_steps
from tessera.plans.frames import complete
from tessera.plans.pipeline import Pipeline, counters

SCHEMA = "stream string, frame_no long, width int, height int, format string, payload binary, other string"


def images(seed=1, n=4, size=16):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:size, 0:size]
    return [((x * 12 + 3 * i) % 256) << 16 | ((y * 9 + i) % 256) << 8 | r.integers(0, 4, (size, size)) * 60 for i in range(n)]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(s, i, 16, 16, "xrgb8888", B.color_bytes(img.reshape(-1), "xrgb8888"), "keep") for s in ("a", "b") for i, img in enumerate(images(1 if s == "a" else 2))]
    rows.append(("b", 99, 16, 16, "xrgb8888", None, "null"))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def P():
    return Pipeline(image_steps.STEPS)


def got(df):
    return {(r["stream"], r["frame_no"]): r for r in df.collect()}


def colors_of(r):
    from tessera.plans.frames import Frame

    return image_steps.colors(Frame(r["width"], r["height"], r["format"], r["palette"], None, None, bytes(r["payload"])))


def test_names_and_types():
    p = P()
    for bad in (lambda: p.add("nothing"), lambda: p.add("pad_pixels"), lambda: p.add("pad_pixels", multiple="4"), lambda: p.add("pad_pixels", multiple=True), lambda: p.add("tiles", more=1), lambda: p.add("tile_map", flips=1)):
        with pytest.raises((ValueError, TypeError)):
            bad()
    p.add("tiles").add("delta8").add("lz4").add("prune_indices", bits=4)
    assert str(p) == "tiles -> delta8 -> lz4 -> prune_indices(bits=4)" and len(p) == 4
    assert p.decoding_steps() == ["prune_indices", "lz4", "delta8"] and str(p.inverse()) == "unprune_indices(bits=4) -> unlz4 -> undelta8"
    p.clear()
    assert len(p) == 0 and str(p) == ""
    with pytest.raises(ValueError):
        image_steps.STEPS.register("tiles", "convert")(None)
    with pytest.raises(ValueError):
        image_steps.STEPS.register("x", "magic")


def test_every_listed_step_is_there():
    image = "black_white paletted truecolor common_palette tiles sprites tile_map common_tile_map add_color0 move_color0 reorder_colors shift_indices prune_indices delta8 delta16 delta_image lz4 lzss rans dxt dxtv pixels_to_raw pad_pixels pad_color_map equalize_color_maps color_map_to_raw pad_color_map_data dump_png"
    assert set(image.split()) <= set(image_steps.STEPS)
    assert {"resample", "repackage", "lz4", "lzss", "rans", "adpcm", "samples_to_raw", "pad_audio"} <= set(audio_steps.STEPS)


@pytest.mark.parametrize("steps", [
    [("delta8", {})], [("delta16", {})], [("delta_image", {})], [("lz4", {}), ("rans", {})], [("lzss", {})], [("delta_image", {}), ("delta8", {}), ("lz4", {})],
])
def test_inverse_gives_back_what_went_in(frames, steps):
    p = P()
    for name, params in steps:
        p.add(name, **params)
    was, back = got(frames), got(p.inverse().run(p.run(frames)))
    assert {k: (r["payload"], r["other"]) for k, r in back.items()} == {k: (r["payload"], r["other"]) for k, r in was.items()}


def test_palette_chain(frames):
    p = P().add("paletted", colors=8, grid="xrgb1555").add("add_color0", color=0x123456)
    a = got(p.run(frames))
    b = got(P().add("paletted", colors=8, grid="xrgb1555").add("add_color0", color=0x123456).add("move_color0", color=0x123456).add("reorder_colors").run(frames))
    for k, r in a.items():
        if r["payload"] is None:
            continue
        assert len(r["palette"]) <= 9 and r["palette"][0] == 0x123456 and 0 not in set(r["payload"])
        assert (colors_of(r) == colors_of(b[k])).all()  # edits of a palette change no colour
    packed = P().add("paletted", colors=8, grid="xrgb1555").add("prune_indices", bits=4)
    c, d = got(packed.run(frames)), got(packed.inverse().run(packed.run(frames)))
    e = got(P().add("paletted", colors=8, grid="xrgb1555").run(frames))
    for k in c:
        if c[k]["payload"] is not None:
            assert len(c[k]["payload"]) == 128 and c[k]["format"] == "paletted4" and d[k]["payload"] == e[k]["payload"]
    raw = got(P().add("paletted", colors=8, grid="xrgb1555").add("pad_color_map", multiple=16).add("color_map_to_raw", format="rgb565", swap=True).add("pad_color_map_data", multiple=64).add("shift_indices", by=4).run(frames))
    for k, r in raw.items():
        if r["payload"] is not None:
            assert len(r["palette"]) == 16 and len(r["palette_raw"]) == 64
            was = np.frombuffer(bytes(e[k]["payload"]), np.uint8)
            assert (np.frombuffer(bytes(r["payload"]), np.uint8) == np.where(was == 0, 0, was + 4)).all()
    with pytest.raises(Exception, match="passes 255"):
        P().add("paletted", colors=8, grid="xrgb1555").add("shift_indices", by=250).run(frames).collect()
    with pytest.raises(Exception, match="indexed pixels"):
        P().add("reorder_colors").run(frames).collect()


def test_batch_steps(frames):
    r = got(P().add("common_palette", colors=16, grid="rgb565").run(frames))
    pals = {tuple(x["palette"]) for x in r.values() if x["payload"] is not None}
    assert len(pals) == 1 and len(next(iter(pals))) <= 16
    one = frames.filter("stream = 'a'")
    mixed = complete(P().add("paletted", colors=4, grid="xrgb1555").run(one.filter("frame_no < 2"))).unionByName(P().add("paletted", colors=9, grid="xrgb1555").run(one.filter("frame_no >= 2")))
    sizes = {len(x["palette"]) for x in P().add("equalize_color_maps").run(mixed).collect()}
    assert len(sizes) == 1 and max(sizes) <= 9


def test_geometry(frames):
    t, was = got(P().add("tiles").run(frames)), got(frames)
    for k, r in t.items():
        if r["payload"] is None:
            continue
        img = np.frombuffer(bytes(was[k]["payload"]), "<u4").reshape(16, 16)
        want = np.concatenate([img[y : y + 8, x : x + 8].reshape(-1) for y in (0, 8) for x in (0, 8)])
        assert (np.frombuffer(bytes(r["payload"]), "<u4") == want).all()
    s = got(P().add("sprites", width=4).run(frames))[("a", 0)]
    img = np.frombuffer(bytes(was["a", 0]["payload"]), "<u4").reshape(16, 16)
    assert (s["width"], s["height"]) == (4, 64) and (np.frombuffer(bytes(s["payload"]), "<u4") == np.concatenate([img[:, x : x + 4].reshape(-1) for x in range(0, 16, 4)])).all()
    m = got(P().add("black_white", threshold=0.4).add("tiles").add("tile_map", flips=True).run(frames))
    for k, r in m.items():
        if r["payload"] is not None:
            assert len(r["maps"][0]) == 4 and len(r["payload"]) == 64 * (1 + max(e & 1023 for e in r["maps"][0]))
    flat = frames.filter("stream = 'a' AND frame_no < 2").withColumn("payload", F.lit(bytes(16 * 16 * 4)))
    c = P().add("tiles").add("common_tile_map", flips=True).run(flat.unionByName(frames.filter("stream = 'a' AND frame_no = 3"))).collect()
    assert len(c) == 1 and len(c[0]["maps"]) == 3 and c[0]["maps"][0] == [0, 0, 0, 0] == c[0]["maps"][1] or c[0]["maps"][0][0] == 0
    px = np.frombuffer(bytes(c[0]["payload"]), np.uint8).reshape(-1, 64, 4)
    assert max(e & 16383 for m in c[0]["maps"] for e in m) + 1 == len(px)
    # maps and tiles give back the frame
    last = np.frombuffer(bytes(t["a", 3]["payload"]), np.uint8).reshape(-1, 8, 8, 4)
    for e, want in zip(c[0]["maps"][2], last):
        tile = px[e & 16383].reshape(8, 8, 4)
        tile = tile[:: -1 if e >> 15 & 1 else 1, :: -1 if e >> 14 & 1 else 1]
        assert (tile == want).all()


def test_codecs_and_raw(frames):
    for fmt in ("xrgb1555", "rgb565"):
        p = P().add("dxt", format=fmt, swap=True)
        r, back = got(p.run(frames)), got(p.inverse().run(p.run(frames)))
        assert all(x["payload"] is None or len(x["payload"]) == 128 for x in r.values())
        err = np.abs((colors_of(back["a", 1]) >> 8 & 255) - (colors_of(complete(frames).filter("stream = 'a' AND frame_no = 1").first()) >> 8 & 255)).mean()
        assert err < 20
    v = P().add("dxtv", quality=95, format="xrgb1555")
    r, back = got(v.run(frames)), got(v.inverse().run(v.run(frames)))
    assert all(x["payload"] is None or len(x["payload"]) % 4 == 0 for x in r.values()) and back["b", 3]["format"] == "xrgb8888"
    raw = got(P().add("truecolor", format="rgb565").add("pixels_to_raw", format="xrgb1555", swap=False).add("pad_pixels", multiple=300).run(frames))
    assert raw["a", 0]["format"] == "raw" and len(raw["a", 0]["payload"]) == 600


def test_memory_and_counters(frames):
    p = P().add("truecolor", format="rgb565").add("lz4").add("pad_pixels", multiple=1000)
    r = got(p.run(frames))
    q = got(P().add("truecolor", format="rgb565").add("lz4").run(frames))
    for k, x in r.items():
        if x["payload"] is not None:
            assert x["max_memory"] == 1004 == len(x["payload"]) + 4 and q[k]["max_memory"] == len(q[k]["payload"]) + 4
    assert got(P().add("lz4").run(frames))["a", 0]["max_memory"] == 0  # the first step does not count
    assert got(P().add("tiles").add("pad_pixels", record_size=False, multiple=5000).run(frames))["a", 0]["max_memory"] == 0
    c = counters(frames, p.run(frames)).first()
    assert (c["frames_in"], c["frames_out"], c["bytes_in"], c["bytes_out"], c["max_memory"], c["ratio"]) == (9, 9, 8 * 1024, 8000, 1004, 97.6563)
    assert counters(frames.limit(0), p.run(frames.limit(0))).first()["ratio"] == 0.0


def test_output_steps(frames, tmp_path):
    out = P().add("tiles").add("write_parquet", path=str(tmp_path / "t")).add("delta8").run(frames)
    assert out.count() == 9 and (tmp_path / "t").exists()
    assert P().add("dump_png", path=str(tmp_path / "png")).run(frames).count() == 9
    files = sorted((tmp_path / "png").iterdir())
    assert len(files) == 8 and files[0].name == "a_0.png" and files[0].read_bytes().startswith(b"\x89PNG")
    c = P().add("combine", width=4).run(frames.filter("payload IS NOT NULL"))
    assert {(r["stream"], len(r["payload"]), tuple(r["starts"])) for r in c.collect()} == {(s, 4096, (0, 256, 512, 768)) for s in "ab"}


def test_streaming(spark, frames, tmp_path):
    frames.filter("payload IS NOT NULL").repartition(1).sortWithinPartitions("frame_no").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="common_palette"):
        P().add("common_palette", colors=4, grid="rgb565").run_stream(live)
    p = P().add("delta_image").add("delta8")
    q = p.run_stream(live).writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    a, b = got(spark.table("deltas")), got(p.run(frames.filter("payload IS NOT NULL")))
    assert {k: r["payload"] for k, r in a.items()} == {k: r["payload"] for k, r in b.items()}


def test_audio(spark):
    x = [np.round(8000 * np.sin(np.arange(500) * 0.05 + i)).tolist() for i in range(6)]
    df = spark.createDataFrame([("s", i, 1, "s16", v) for i, v in enumerate(x)], "stream string, frame_no long, channels int, sample_format string, samples array<double>")
    A = lambda: Pipeline(audio_steps.STEPS)
    p = A().add("repackage", channels=1, format="s16", per_frame=400.0, modulo=16).add("adpcm").add("lz4")
    r = p.run(df).orderBy("frame_no").collect()
    assert sum(len(w["samples"]) for w in r) == 3008 and r[0]["max_memory"] > 0
    back = p.inverse().run(p.run(df)).orderBy("frame_no").collect()
    flat, want = np.concatenate([w["samples"] for w in back])[:3000], np.concatenate(x)
    assert np.abs(flat - want).mean() < 200
    raw = A().add("resample", rate_in=22050, channels_in=1, format_in="s16", rate=11025, channels=2, format="u8").add("samples_to_raw", interleave=True).add("pad_audio", multiple=64).run(df).collect()
    assert all(len(w["payload"]) % 64 == 0 for w in raw) and sum(len(w["samples"]) for w in raw) == 3000
    for bad in (lambda: A().add("resample", rate=1), lambda: A().add("repackage", channels=3, format="s16", per_frame=1.0, modulo=1).run(df)):
        with pytest.raises((TypeError, ValueError)):
            bad()
