import pytest

from tessera.llm import mojibake as M

LINES = {
    "fr": "Le médecin dessine une boîte en bois à côté de la gare. L’été dernier, la fillette a caché la clé près du théâtre. Où êtes-vous allés ? Ça déjà, c’est très étrange — voilà : “oui” « non » 5 €.",
    "de": "Die Köchin trägt das warme Brot über die große Brücke. Für schöne Mädchen müssen wir später zurück. Die Ärztin hört „ja“ – 7 €.",
    "es": "El niño encontró la lámpara en el sótano mañana. ¿Dónde está el pequeño camión? La estación quedó detrás del jardín, ¡qué película! — 8 €.",
    "ru": "Ночной сторож покупает странную картину на крыше. Девочка теряет тёплый хлеб в порту на рассвете. Никто нам об этом не сказал.",
    "ja": "女の子が不思議な絵を描く。シーンの階段の下で車掌が黄色い傘を買う。それがどういう意味か分かりません。",
    "en": "The old sailor sees the small boat — it’s over… “yes” I don’t know what that means at 5 €. The café is near the river.",
}
TEXTS = [x for k in LINES for x in LINES[k].split(". ")[:2]]


@pytest.fixture(scope="module")
def repairer():
    lines = [(k, x + ".") for k, v in LINES.items() for x in v.split(". ")] * 20
    return M.Repairer(M.fit(lines))


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "koi8_r"])
def test_round_trip(repairer, wrong):
    enc = {n: M._byte_table(n) for n in M.MISREAD_AS}
    for t in TEXTS:
        bad = "".join(enc[wrong][b] if b > 127 else chr(b) for b in t.encode("utf-8"))
        if bad != t:
            assert repairer.text(bad) == (t, True, True), (wrong, t, repairer.text(bad))


def test_nested_layers_without_a_limit(repairer):
    t = "Le médecin cache la clé près du théâtre"
    for _ in range(8):
        t = t.encode("utf-8").decode("latin-1")
    assert repairer.text(t) == ("Le médecin cache la clé près du théâtre", True, True)


def test_single_byte_and_double_byte(repairer):
    ru, ja = "Ночной сторож покупает странную картину на крыше", "女の子が不思議な絵を描く"
    assert repairer.text(ru.encode("koi8_r").decode("cp1251")) == (ru, True, True)
    assert repairer.text(ru.encode("cp1251").decode("cp1252")) == (ru, True, True)
    assert repairer.text(ja.encode("euc_jp").decode("latin-1")) == (ja, True, True)


def test_clean_texts_stay(repairer):
    for t in TEXTS + ["", "plain ascii", "…", "naïve café", "Αt dawn thе sailor", "５ € Ｄｅｒ"]:
        assert repairer.text(t)[:2] == (t, False), t


def test_many_at_once_is_one_by_one(repairer):
    bad = [t.encode("utf-8").decode("latin-1") for t in TEXTS] + ["La cl� est l�", "", "plain", "a\nLe mÃ©decin\nplain", "Ночной".encode("koi8_r").decode("cp1251")]
    batch = [x for pair in zip(bad, TEXTS + ["x"] * len(bad)) for x in pair]
    assert repairer.texts(batch) == [repairer.text(t) for t in batch] == repairer.texts(batch, together=50) and repairer.texts([]) == []
    long = "Le médecin cache la clé près du théâtre. " * 5000
    assert repairer.texts([long, long.encode("utf-8").decode("latin-1")]) == [(long, False, False), (long, True, True)]


def test_lost_bytes(repairer):
    assert repairer.text("La cl� est l�") == ("La cl� est l�", True, False)
    fixed, garbled, recovered = repairer.text("Le mÃ©decin cache la cl�")
    assert (fixed, garbled, recovered) == ("Le médecin cache la cl�", True, False)


def test_rows_and_bounds(spark):
    catalog = spark.createDataFrame([("fr", LINES["fr"]), ("de", LINES["de"]), (None, "x"), ("fr", None)] * 3, "lang string, text string")
    assert len(M.model_lines(catalog)) == 2 and len(M.model_lines(catalog, 1)) == 2
    many = spark.createDataFrame([(f"l{i % 3}", f"line {i}") for i in range(300)], "lang string, text string")
    got = M.model_lines(many, 40)  # a bound for every language, not for all in their order
    assert {x: sum(a == x for a, _ in got) for x in ("l0", "l1", "l2")} == {"l0": 40, "l1": 40, "l2": 40}
    subs = spark.createDataFrame([(1, 1, "mÃ©decin"), (1, 1, "mÃ©decin"), (2, None, None), (3, 1, ""), (4, 2, "médecin")], "sub_id long, track_id long, text string")
    tracks = spark.createDataFrame([(1, "FR "), (2, None)], "track_id long, lang string")
    rows = M.garbled_rows(subs.withColumn("repaired", subs["text"]), catalog, tracks).collect()
    assert [(r["sub_id"], r["repaired"], r["recovered"]) for r in rows] == [(1, "médecin", True)]
    assert M.garbled_rows(subs.limit(0), catalog.limit(0), tracks.limit(0)).count() == 0


def test_model_counts_every_line(spark):
    lines = [("fr", f"Le médecin numéro {i} cache la clé") for i in range(2500)] + [("de", "Die Köchin trägt Brot")]
    captions = [(1 + i % 3, f"La gare {i} près du théâtre\nça “{i}” mÃ©decin" if i % 2 else f"Où {i}\xa0êtes-vous\u2003allés") for i in range(24_000)]
    tracks = {1: "FR ", 2: "de", 3: None}
    subs = spark.createDataFrame([(n, *c) for n, c in enumerate(captions)], "sub_id long, track_id long, text string").repartition(7)
    got = M.fitted(subs, spark.createDataFrame(lines, "lang string, text string"), spark.createDataFrame(list(tracks.items()), "track_id long, lang string"))
    labelled = [(tracks[k].strip().lower(), x) for k, x in captions if tracks[k]]
    assert got == M.fit(lines, labelled)  # nothing is sampled, and the counts of the tasks add up
    assert sum(got["fr"][0].values()) == pytest.approx(M.SHARES_OF) and "mã©decin" not in got["fr"][3]


def test_known_words_are_a_share_of_all():
    line = "Le médecin dessine une boîte en bois à côté de la gare"
    small, large = (M.count_letters([("fr", line)] * n + [("fr", "mщdecin")] * (n // 2000))["fr"][3] for n in (10_000, 200_000))
    assert set(small) == set(large) and "médecin" in large and "mщdecin" not in large  # a garbled word that grows with the data doesn't get known


def test_clean_lines_are_screened_in_bulk(repairer, monkeypatch):
    read, tried = [], []
    monkeypatch.setattr(M.Repairer, "reading", lambda self, text: read.append(text) or text)
    monkeypatch.setattr(M.codecs, "charmap_encode", lambda text, *a, f=M.codecs.charmap_encode: tried.append(text) or f(text, *a))
    clean = ["Это", "— 8 €", "сторож", "女の子が"] * 50
    assert all(repairer.enc.wide(t) for t in clean[:3])  # a double-byte reading that costs more is no reason to read the line
    assert repairer.texts(clean) == [(t, False, False) for t in clean]
    odd = [x.encode("utf-8").decode("latin-1") + tail for x in TEXTS for tail in ("", " ♪", " ５", "女")]
    odd += [x + tail for x in ("оПВЮКЭНМ РЕПЪЕР", "Le mйdecin cache la clй prиs du thйвtre") for tail in ("", " ♪", "\nЭто")]
    assert not read and len(tried) <= 3 * len(M.MISREAD_AS)  # the readings of a line that comes often are made once
    monkeypatch.undo()
    assert repairer.texts(odd) == [repairer.text(t) for t in odd]


def test_bounds_in_bulk_are_those_of_each_word(repairer):
    words = [w for t in TEXTS for x in (t, t.encode("utf-8").decode("latin-1")) for w in M._words(x)] + ["médecin" * 300, "İa", "“été”"]
    model = M.Model(M.fit([(k, x + ".") for k, v in LINES.items() for x in v.split(". ")] * 20))
    one = [model.each([w])[0].tolist() for w in words]
    model.rows.clear()
    model.at_once = 40  # sums are cut in many places
    assert model.each(words).tolist() == one
    odd = [w for w in words if not w.isascii()]
    low, costs = repairer._least(odd), repairer.model.each
    for w, bound in zip(odd, low):
        hows = repairer.enc.legacy("".join(sorted({c for c in w if c > "\x7f"})))
        assert (costs([w] + [w.translate(h) for h in hows]).min(0) >= bound - 1e-9).all(), w


def test_single_byte_readings_are_those_of_all_encodings(repairer):
    enc = repairer.enc
    for odd in ("é", "éè", "’“”", "Ãâ", "дж", "女"):
        want = set()
        for n in M.MISREAD_AS:
            back = {c: i for i, c in enumerate(M._byte_table(n))}
            for m in M.WRITTEN_IN:
                new = tuple(M._strict_table(m)[back[c]] if c in back else None for c in odd)
                if new != tuple(odd) and all(c is not None and c in enc.known for c in new):
                    want.add(new)
        got = [tuple(h[ord(c)] for c in odd) for h in enc.legacy(odd)]
        assert set(got) == want and len(got) == len(want)
