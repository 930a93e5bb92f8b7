import unicodedata

import numpy as np

from tamiza.llm import abuse, copies, lookalike, mojibake

SPANISH = [
    "Bajó a 17500 pesos y la compré para mi mamá.",
    "La cámara está bien, el botón también, según mi hermana.",
    "Qué mal: la señal inalámbrica no sirve y el niño lloró.",
    "Pagué de más por la garantía; aquí nadie respondió.",
    "El técnico explicó el trámite y la batería duró más.",
    "DESPUÉS DE UN AÑO SEGÚN EL TÉCNICO YA NO SIRVIÓ MÁS",
] * 40


def table(texts):
    c = mojibake.classes()[mojibake._codes(texts)]
    n = np.bincount(c[:-1] * mojibake.CLASSES + c[1:], minlength=mojibake.CLASSES**2).astype(float).reshape(mojibake.CLASSES, -1)
    total = n.sum()
    a, b = (np.maximum(n.sum(x) / total, mojibake.FLOOR) for x in (1, 0))
    return np.log2((n + 0.05) / (total + 0.05 * mojibake.CLASSES) / (a[:, None] * b[None, :])).astype(np.float32)


def test_round_trips():
    r = mojibake.Repairer(table(SPANISH))
    for text in SPANISH[:6]:
        for page in ("latin-1", "cp1252", "cp1251", "cp850", "cp437", "mac_roman"):
            try:
                bad = text.encode().decode(page)
            except UnicodeDecodeError:
                continue
            assert r.repair(bad) == (True, text), (page, bad)
        twice = text.encode().decode("latin-1").encode().decode("latin-1")
        assert r.repair(twice) == (True, text)
        swapped = text.encode("latin-1").decode("cp850")
        assert r.repair(swapped)[0]


def test_sound_text_stays():
    r = mojibake.Repairer(table(SPANISH))
    for text in [*SPANISH[:6], "", " ", "Privet «Привет» façade Straße 30 °C ±5 ½ 2ª", "ATENÇÃO NÃO", "👨‍👩‍👧 ❤️ “así” – ya"]:
        assert r.repair(text) == (False, text)
    assert r.repair("raz�n") == (True, "raz�n")


def test_pair_counts_are_exact(spark):
    rows = [("ab ñ",), (None,), ("",), ("ñb",)] * 3
    df = spark.createDataFrame(rows, "t string")
    got = {r.pair: r.n for r in mojibake.pair_counts(df, df.t).collect()}
    want = {}
    for (t,) in rows:
        if t:
            s = f" {t} "
            for a, b in zip(s, s[1:]):
                k = ord(a) * mojibake.CLASSES + ord(b)
                want[k] = want.get(k, 0) + 1
    for k, n in want.items():
        if k != 32 * mojibake.CLASSES + 32:
            assert got[k] == n


def test_repair_frame(spark):
    df = spark.createDataFrame([(1, "Baj" + "ó".encode().decode("latin-1"), "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")], "id int, t string, restored string")
    got = {r.id: (r.garbled, r.restored) for r in mojibake.repair(df, "t", table(SPANISH)).collect()}
    assert got == {1: (True, "Bajó"), 2: (False, None), 3: (False, "")}
    assert mojibake.repair(df.limit(0), "t", table(SPANISH)).count() == 0


def test_lost_letters(spark):
    words = spark.createDataFrame([("batería", 9), ("también", 5), ("cambió", 5), ("cambié", 4), ("años", 3), ("él", 2)], "token string, n long")
    df = spark.createDataFrame([(1, "La bater\ufffda, TAMBI\ufffdN", 7), (2, "cambi\ufffd", 7), (3, None, 7), (4, "\ufffd \ufffdl A\ufffdos", 7), (5, "", 7)], "i int, t string, n int")
    got = {r.i: r.t for r in mojibake.restore_lost(df, "t", words, ["i"]).collect()}
    assert got == {1: "La batería, TAMBIÉN", 2: "cambi\ufffd", 3: None, 4: "\ufffd él Años", 5: ""}
    assert mojibake.restore_lost(df.limit(0), "t", words, ["i"]).count() == 0


def test_segments_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(-0.5, 1, 12)
        got = mojibake.segments(s.tolist(), drop=1e9)
        best = max((s[i:j].sum(), i, j) for i in range(12) for j in range(i + 1, 13))
        if best[0] > 0:
            assert any(abs(s[a:b].sum() - best[0]) < 1e-9 for a, b in got)


def brute_form(text):
    """The common form of one text, said plainly; for texts without foreign letters."""
    out = []
    for ch in text:
        o = ord(ch)
        if unicodedata.category(ch) == "Zs":
            out.append(" ")
        elif ch in "\xad​‌⁠﻿":
            continue
        elif 0xFF01 <= o <= 0xFF5E or 0xFB00 <= o <= 0xFB06:
            out.append(unicodedata.normalize("NFKC", ch))
        else:
            out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


def test_normal_form(spark):
    texts = ["En\xa0la  caﬁa", "Ｅｓｔá　ｄｅ", "marcó bien​ x", "us‌o", "", " ", "\t\n", "normal", "ệ ệ q́x", "\xa0" * 3, "á" * 3000, "﻿ho\xadla… 1º ½ ™", "a\nb c"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(99, None, "x"), (98, texts[0], "y")], "id int, t string, form string")
    got = {r.id: r.form for r in lookalike.normalize(df, "t").collect()}
    assert got == {**{i: brute_form(t) for i, t in enumerate(texts)}, 99: None, 98: brute_form(texts[0])}


def test_foreign_letters(spark):
    cases = {"cоmprе": "compre", "а": "a", "Привет": "Привет", "β 5kΩ µm": "β 5kΩ µm", "οjο": "ojo", "bоtо́n": "botón", "👨‍👩‍👧 ❤️": "👨‍👩‍👧 ❤️", "i‍n": "in"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert all(r.form == r.want for r in lookalike.normalize(df, "t").collect())
    assert lookalike.normalize(df.limit(0), "t").count() == 0


def test_copies_against_brute_force(spark):
    import re
    import string

    texts = {
        "A3": "La compra fue  buena, de verdad", "A1": "LA COMPRA\nfue buena de verdad!!", "A2": "la compra fue mala de verdad", "B1": "Peso: dos kilos; Color: gris claro; Uso: casa",
        "B2": "uso: CASA | peso: dos kilos | color: gris claro", "B3": "Uso: casa\nColor: gris claro\nPeso: dos kilos", "B4": "Peso dos kilos Color gris claro Uso casa", "C1": "a: b; c: d", "C2": "c: d; a: b",
        "D1": "tres palabras no", "D2": "Tres palabras no", "E1": "sí está muy bien", "E2": "si esta muy bien", "F1": None, "F2": " ", "G1": "!!! ??? ... ---", "G2": "... --- !!! ???", "H1": "muy bien todo aquí 👍", "H2": "muy bien todo aquí",
    }

    def leaf(x):
        return "".join(c for c in x.lower() if not c.isspace() and not unicodedata.category(c).startswith("P") and c not in string.punctuation)

    def forms(x):
        parts = [p for p in re.split(r"[;|\n\r]+", x) if p.strip()]
        rec = len(parts) >= 3 and all(re.match(r"(?s)[^:]+:.*\S", p) for p in parts)
        return {leaf(x)} | ({"R" + "|".join(sorted(map(leaf, parts)))} if rec else set())

    ok = {k: forms(v) for k, v in texts.items() if v and len(v.split()) >= 4 and leaf(v)}
    group = {k: k for k in ok}
    for _ in ok:
        for a in ok:
            for b in ok:
                if ok[a] & ok[b]:
                    group[a] = group[b] = min(group[a], group[b])
    want = {(group[k], k) for k in ok if group[k] != k}
    df = spark.createDataFrame([(k, v, "t", "clash") for k, v in texts.items()] + [("A3", texts["A3"], "t", "again"), (None, texts["A3"], "t", "null")], "id string, text string, tbl string, id_keep string")
    members, kept = copies.groups(df, "id", "text", ["tbl"])
    assert {(r.id_keep, r.id) for r in members.collect()} == want
    assert {r.id_keep: r.n_copies for r in kept.collect()} == {g: 1 + sum(x == g for x, _ in want) for g, _ in want}
    assert copies.groups(df.limit(0), "id", "text", ["tbl"])[1].count() == 0


def test_nested_digest(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, ("A b", ["x", "Y!"], {"k": "v"})), (2, ("ab", ["y", "x"], {"K": "V"})), (3, ("ab", ["y", "x", "x"], {"k": "v"})), (4, None)], "i int, s struct<a: string, b: array<string>, c: map<string, string>>")
    kind = df.schema["s"].dataType
    got = {r.i: (r.d, r.c) for r in df.select("i", copies.digest(F.col("s"), kind).alias("d"), copies.canonical(F.col("s"), kind).alias("c")).collect()}
    assert got[1] == got[2] and got[2][0] != got[3][0] and got[2][1] != got[3][1] and got[4][0] != got[3][0]


def test_abuse_held_out():
    rng = np.random.default_rng(1)
    fine = ["la pantalla se ve bien", "el teclado es malo y lento", "qué tonta compra hice", "no sirve para nada", "me encanta el color", "el disco falla cada semana", "tardó diez días en llegar", "la batería es una porquería"]
    bad = ["eres un {} sin cerebro", "los de la tienda son unos {}", "lárgate de aquí, {}", "te voy a golpear, {}"]
    words = ["zopenco", "mamerto", "patán", "cretino"]
    texts, labels = [], []
    for _ in range(600):
        s = list(rng.choice(fine, 3))
        is_bad = rng.random() < 0.3
        if is_bad:
            w = str(rng.choice(words))
            w = [w, " ".join(w), w.replace("a", "4").replace("o", "0"), w.upper()][rng.integers(4)]
            s.insert(int(rng.integers(4)), str(rng.choice(bad)).format(w))
        texts.append(". ".join(s))
        labels.append("abusive" if is_bad != (rng.random() < 0.02) else "none")
    m = abuse.fit(texts[:400], labels[:400])
    p, kind = m.score(texts[400:])
    truth = np.array([any(b.split("{}")[0].strip(" ,")[:8] in abuse.plain(t) or b[:8] in t for b in bad) for t in texts[400:]])
    assert ((p >= 0.5) == truth).mean() > 0.95
    empty, kinds = m.score([None, "", " ", "?!"])
    assert empty.tolist() == [0, 0, 0, 0] and kinds == [None] * 4
    assert abuse.fit([], []).score(["x"])[0].tolist() == [0]


def test_abuse_disguises():
    for t in ["p 4 y 4 s 0", "P.A.Y.A.S.O", "ｐａｙａｓｏ", "pаyаsо", "pa​ya​so", "paaayaso", "PAYASO", "páyasó"]:
        assert "payaso" in abuse.plain(t)
    assert abuse.plain("cuesta 4500 pesos") == "cuesta 0 pesos"


def test_position_sums_match_features():
    w = np.random.default_rng(0).normal(size=1 << abuse.BITS).astype(np.float32)
    own = [" hola que tal ", " a ", " bien gracias "]
    idx, start = abuse.features(own)
    want = np.add.reduceat(w[idx], start)
    total = np.concatenate([[0], np.cumsum(abuse.position_sums(own, w))])
    end = np.cumsum([len(s) for s in own])
    assert np.allclose(want, total[end] - total[end - [len(s) for s in own]], atol=1e-4)


def test_every_character(spark):
    """Each character of Unicode that has another form comes out in it; all others stay."""
    special = {*lookalike.ALIKE, *lookalike.ALIKE_INSIDE} | {chr(o) for a, b in lookalike._HIDDEN for o in range(a, b + 1)} | {"‍"}
    chars = [c for c in map(chr, range(0x20, 0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF and unicodedata.category(c) not in ("Cn", "Co") and not 0x3400 <= ord(c) <= 0xD7FF and not 0x20000 <= ord(c) < 0x2F800 and not 0x12000 <= ord(c) <= 0x1CFFF]
    foreign = [c for c in chars if (d := unicodedata.normalize("NFD", c))[0] in {**lookalike.ALIKE, **lookalike.ALIKE_INSIDE}]
    chars = [c for c in chars if c not in special and c not in set(foreign)]
    df = spark.createDataFrame([(c,) for c in chars], "t string")
    got = {r.t: r.form for r in lookalike.normalize(df, "t").collect()}
    wrong = [(hex(ord(c)), got[c], lookalike.plain_form(c)) for c in chars if got[c] != lookalike.plain_form(c)]
    assert not wrong, wrong[:20]
    assert sum(lookalike.plain_form(c) != c for c in chars) > 3000
    hidden = sorted({chr(o) for a, b in lookalike._HIDDEN for o in range(a, b + 1)})
    assert {r.form for r in lookalike.normalize(spark.createDataFrame([(f"x{c}y",) for c in hidden], "t string"), "t").collect()} == {"xy"}


def test_whole_families(spark):
    cases = {
        "ℎola": "hola", "Ångel": "Ångel", "ĳ ǆ ŉ": "ij dž ʼn", "ⓗⓞⓛⓐ": "hola", "hⓞla": "hola", "ᏞᎪ": "LA", "ɡracias": "gracias", "ꓮꓐ": "AB", "𝓱𝓸𝓵𝓪 𝟏": "hola 1", "ﾀﾞ": "ダ", "ｶ": "カ",
        "① Ⓐ ™ º ² ½ … ℃ № ㎏ µ ≠ “a” ´ ¨": "① Ⓐ ™ º ² ½ … ℃ № ㎏ µ ≠ “a” ´ ¨", "한국어": "한국어", "ạ̇": "ạ̇", "ạ̇": "ạ̇", "नमस्ते สวัสดี ภาษาไทยคำ": "नमस्ते สวัสดี ภาษาไทยคำ", "1️⃣ 🇪🇸": "1️⃣ 🇪🇸",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [(r.t, r.form) for r in lookalike.normalize(df, "t").collect() if r.form != r.want] == []
    assert {r.t for r in lookalike.differing(df, "t").collect()} == {t for t, w in cases.items() if t != w}


def test_sound_signs_beside_damage():
    r = mojibake.Repairer(table([*SPANISH, "El sistema es Windows® original 25 º ±3 2 × 3, 5 °C", "El botón lo explicó el técnico"] * 3))
    for signs in ("Windows® original", "25 º de pie", "±3 por 2 × 3", "5 °C de más"):
        text = f"El sistema es {signs}. " + "El botón lo explicó el técnico"
        bad = f"El sistema es {signs}. " + "El botón lo explicó el técnico".encode("cp850").decode("latin-1")
        bad = bad.replace("de más", "de m" + "á".encode("cp850").decode("latin-1") + "s")
        garbled, got = r.repair(bad)
        assert garbled and got == text, (bad, got)


def test_restored_texts_are_the_originals(spark):
    """Sound reviews of the data, garbled by known pages: what comes back is what was."""
    from pyspark.sql import functions as F

    from tamiza.llm import corpus

    d = "/root/testdata/sf0.001"
    r = mojibake.Repairer(corpus.review_pmi(spark, d))
    texts = [x.raw_text for x in spark.read.parquet(f"{d}/raw_reviews.parquet").filter(F.col("raw_text").rlike("[áéíóúñ]")).select("raw_text").distinct().collect()]
    texts = [t for t in texts if not r.repair(t)[0] and all(c < "Ā" for c in t)]
    assert len(texts) > 100
    for page, share in (("latin-1", 0.99), ("cp1252", 0.99), ("mac_roman", 0.99)):
        bad = [(t, t.encode().decode(page, "replace")) for t in texts]
        bad = [(t, b) for t, b in bad if "�" not in b]
        assert sum(r.repair(b) == (True, t) for t, b in bad) >= share * len(bad), page
    swapped = [(t, t.encode("cp850", "replace").decode("latin-1")) for t in texts]
    swapped = [(t, b) for t, b in swapped if "?" not in b.replace("?", "", t.count("?"))]
    assert sum(r.repair(b) == (True, t) for t, b in swapped) >= 0.85 * len(swapped)
