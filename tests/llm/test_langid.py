import random

import pytest

from tessera.llm import langid as L

WORDS = {
    "en": "the old sailor sees a small boat near the river and the teacher carries warm bread to the quiet garden every winter with".split(),
    "de": "der alte Matrose sieht ein kleines Boot am Fluss und die Lehrerin trägt warmes Brot in den stillen Garten jeden Winter mit".split(),
    "es": "el viejo marinero ve un pequeño barco cerca del río y la maestra lleva pan caliente al jardín tranquilo cada invierno con".split(),
    "ru": "старый моряк видит маленькую лодку у реки и учительница несёт тёплый хлеб в тихий сад каждую зиму вместе".split(),
    "uk": "старий моряк бачить маленький човен біля річки та вчителька несе теплий хліб до тихого саду щозими разом".split(),
    "ja": ["古い船乗りが", "川の近くで", "小さなボートを", "見る。", "先生が", "静かな庭へ", "温かいパンを", "運ぶ。"],
}
SCRIPTS = {"en": "Latin", "de": "Latin", "es": "Latin", "ru": "Cyrillic", "uk": "Cyrillic", "ja": "Japanese"}


def sentence(lang, r):
    w = [r.choice(WORDS[lang]) for _ in range(9)]
    return "".join(w).replace("。", "") + "。" if lang == "ja" else " ".join(w).capitalize() + "."


@pytest.fixture(scope="module")
def contents():
    r = random.Random(3)
    return {x: " ".join(sentence(x, r) for _ in range(150)).encode() for x in WORDS}


def test_held_out_accuracy(contents):
    model, r = L.Classifier(contents, SCRIPTS), random.Random(4)
    right = n = 0
    for lang in WORDS:
        for _ in range(100):
            s = L.segments(" ".join(sentence(lang, r) for _ in range(3)), model)
            n += 1
            right += [x[2] for x in s] == [lang]
    assert right / n > 0.98


def test_mixed_text_has_segments(contents):
    model, r = L.Classifier(contents, SCRIPTS), random.Random(5)
    t = f"{sentence('en', r)} {sentence('en', r)} {sentence('ru', r)} {sentence('de', r)}"
    s = L.segments(t, model)
    assert [x[2] for x in s] == ["en", "ru", "de"] and s[0][0] == 0 and s[-1][1] == len(t)


def test_every_language_is_compared_and_can_be_rejected(contents):
    model = L.Classifier(contents, SCRIPTS)
    assert len(model.sizes("先生が静かな庭へ")) == 3  # Japanese against one language of each other script
    (_, _, lang, conf, _), = L.segments("先生が静かな庭へ温かいパンを運ぶ。", model)
    assert lang == "ja" and 0 < conf < 1
    # words that no language knows: the margin is narrow, also in a text of one language
    assert all(x[2] is None for x in L.segments("Xqzv Wkrp Jjyt Bnmq.", model))
    same = dict(contents, de=contents["en"])
    assert all(x[2] is None for x in L.segments("The old sailor sees a small boat. The teacher carries warm bread.", L.Classifier(same, SCRIPTS)))
    assert L.segments("123 !!! ...", model) == [] and L.segments("", model) == []


def test_fit_takes_lines_of_every_language_and_long_documents(spark, monkeypatch):
    r = random.Random(6)
    langs = spark.createDataFrame(sorted(SCRIPTS.items()), "lang string, script string")
    catalog = spark.createDataFrame([(x, sentence(x, r)) for x in WORDS for _ in range(60)], "lang string, text string")
    docs = [(i, " ".join(sentence(x, r) for _ in range(6)), x.upper() + " ", "k") for i, x in enumerate(list(WORDS) * 20)]
    docs.append((1000, " ".join(sentence("de", r) for _ in range(3000)), None, "k"))
    docs += [(1001, None, "en", None), (1002, "", "en", None), (1003, docs[0][1], "de", "k"), (1003, docs[0][1], "de", "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, segments string")
    monkeypatch.setattr(L, "CATALOG_LINES", 10)
    contents, scripts = L.fit(df, catalog, langs)
    assert set(contents) == set(WORDS) and scripts == SCRIPTS
    got = {}
    for row in L.identify(df, "text", contents, scripts).select("doc_id", L.languages_of().alias("l")).collect():
        got.setdefault(row["doc_id"], []).append(row["l"])
    assert sum(got[i] == [[x]] for i, x in enumerate(list(WORDS) * 20)) >= 117
    assert got[1000] == [["de"]] and got[1001] == [[]] and got[1002] == [[]] and len(got[1003]) == 2
    assert L.fit(df.limit(0), catalog.limit(0), langs.limit(0)) == ({}, {})
    assert L.identify(df.limit(0), "text", contents, scripts).count() == 0
    with pytest.raises(ValueError):
        monkeypatch.setattr(L, "MAX_LANGUAGES", 3)
        L.fit(df, catalog, langs)
