import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import confusables as C


def _brute(t):
    """The form by the standard library's normalisation."""
    if t is None:
        return None
    t = re.sub("(?<=[\U0001f300-\U0001faff☀-➿])‍(?=[\U0001f300-\U0001faff☀-➿])|(?<=[\U0001f300-\U0001faff☀-➿]️)‍(?=[\U0001f300-\U0001faff☀-➿])", C._JOINER, t)
    t = re.sub("(?<=[\U0001f300-\U0001faff☀-➿])️", C._EMOJI_STYLE, t)
    bases = C._bases()
    parts = "".join(x for ch in t for x in C.decompositions().get(ch, [ch]))
    parts = "".join(bases.get(x, x) for x in unicodedata.normalize("NFD", parts))
    return unicodedata.normalize("NFC", parts).replace(C._JOINER, "‍").replace(C._EMOJI_STYLE, "️")


ALPHABET = "aeiosu éüñḉ̧̣̈​ 　­еоасΑοհＡｂ１カｶﾞがｶ\n.²ﬁ❤️👩‍🚀Ab"


def test_settled_texts_are_in_their_form():
    settled = re.compile(C._SETTLED.replace(r"\A", "^").replace(r"\z", "$"), re.S)
    changed = C.forms()
    for i in [*range(1, 0xD800), *range(0xE000, 0x110000)]:
        if settled.match(chr(i)) and chr(i) != "\n":
            assert chr(i) not in changed, hex(i)
            assert not unicodedata.combining(chr(i))


def test_forms_of_single_characters():
    f = C.forms()
    assert f["Ａ"] == "A" and f[" "] == " " and f["　"] == " " and f["​"] == "" and f["а"] == "a" and f["ё"] == "ë"
    for ch in "\U000e0041\U000e0100ᅟㅤﾠ­﻿⁠":
        assert f[ch] == "", hex(ord(ch))
    for ch in "é²½ﬁ…Ｑ"[:-1]:
        assert ch not in f


def test_consistent_form_is_that_of_the_standard_library(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 14))) for _ in range(1500)]
    texts += [None, "", "​​", "ẹ́", "ẹ́", "e​́", "́a", "한국", unicodedata.normalize("NFD", "한국"), "аbс " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "sub_id long, text string")
    for x in C.consistent_form(df.unionByName(df), "sub_id", "text").collect():
        want = _brute(x["text"])
        if x["text"] and re.search("[가-힣ᄀ-ᇿ]", x["text"]):
            want = unicodedata.normalize("NFD", want)
        # where only some of a letter's marks have a character of their own with it, the form stays decomposed: the same text in either case
        assert x["form"] == want or unicodedata.normalize("NFC", x["form"]) == want, (x["text"], x["form"], want)
    assert C.consistent_form(df.limit(0), "sub_id", "text").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=12))
def test_brute_force_is_stable(t):
    assert _brute(_brute(t)) == _brute(t)


def test_pairs(spark):
    lines = spark.createDataFrame([(1, "Café at dawn."), (2, "plain"), (3, None), (4, ""), (5, "naïve"), (1, "Café at dawn.")], "line_id long, text string")
    texts = [
        (10, "Café at dawn."), (11, "Café at dаwn."), (12, "Café at dawn."), (13, "Cafe at dawn."), (14, "café at dawn."), (15, "Ｃafé at dawn．"), (16, "pl​ain"),
        (17, None), (18, ""), (19, "​"), (16, "pl​ain"), (20, "naïve"), (21, "Café at\ndawn."), (22, "Café at  dawn."),
    ]
    t = spark.createDataFrame([(a, b, "x") for a, b in texts], "sub_id long, text string, form string")
    want = {(1, 10), (1, 11), (1, 15), (2, 16), (5, 20)}
    got = C.look_alike_pairs(lines, t.select("sub_id", "text")).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    import pytest

    with pytest.MonkeyPatch.context() as m:  # beyond the size of a broadcast
        m.setattr(C, "BROADCAST_BYTES", -1)
        assert {tuple(x) for x in C.look_alike_pairs(lines, t.select("sub_id", "text")).collect()} == want
    assert C.look_alike_pairs(lines.limit(0), t.select("sub_id", "text")).count() == 0
