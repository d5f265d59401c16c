from pyspark.sql import functions as F

from tessera.plans import media_queries as Q
from tessera.sources import srt

TEXTS = ["plain", "a\n\nb", "", "  ", "\n", " lead\ntrail \t", "a\\|b\\r\\\\c", "\r\nx\r", "1\n00:00:01,000 --> 00:00:02,000\n\n2\n", "\\", "\\\\|", "a\n \n\nb\\"]


def _save(spark, folder, texts):
    rows = [(i, "t", i * 1.0, i + 0.5, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "sub_id long, track_id string, start_s double, end_s double, text string").write.parquet(f"{folder}/subtitles.parquet")
    return str(folder)


def test_every_text_comes_back(spark, tmp_path):
    got = Q.srt_round_trip(spark, _save(spark, tmp_path, TEXTS)).collect()
    assert len(got) == len(TEXTS) and all(r["back"] for r in got)
    files = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").withColumn("value", srt.srt_cue(F.lit(1), F.lit(1.0), F.lit(2.0), srt.escape_text(F.col("t"))))
    back = srt.parse_srt(files, "k", escaped=True).collect()
    assert {r["k"]: r["text"] for r in back} == dict(enumerate(TEXTS)) and len(back) == len(TEXTS)


def test_a_lost_text_is_seen(spark, tmp_path, monkeypatch):
    real = srt.srt_cue
    monkeypatch.setattr(Q, "srt_cue", lambda n, a, b, text: real(n, a, b, F.regexp_replace(text, "lost", "")))
    got = Q.srt_round_trip(spark, _save(spark, tmp_path, ["kept", "lost it"])).collect()
    assert {r["sub_id"]: r["back"] for r in got} == {0: True, 1: False}
