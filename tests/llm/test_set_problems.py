import collections
import fractions
import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamiza.llm import mixing, overlap, packing, quality, quality_holdout, queries, sampling


def words(x):
    x = unicodedata.normalize("NFD", x.lower())
    return re.findall(r"[^\W_]+", "".join(c for c in x if unicodedata.category(c) != "Mn"))


def test_overlaps_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"palabra{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = list(rng.choice(vocab, 40))
        for j in range(4):
            w = list(base)
            for _ in range(int(rng.integers(0, 14))):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
            if j == 3:
                rng.shuffle(w)
            rows.append((len(rows), " ".join(w).upper() if j == 1 else ", ".join(w), ["train", "test", "valid", "train"][j], "x"))
    rows += [(900, "uno dos tres", "train", "x"), (901, "uno dos tres", "test", "x"), (902, None, "train", "x"), (903, "", "test", "x"), (904, "á b c d", None, "x"), (905, "á b c d", "train", "x"), (906, "A B C D", "test", "x"), (905, "á b c d", "train", "x")]
    df = spark.createDataFrame(rows, "rec_id long, t string, split string, cls string")
    want = set()
    c = {r[0]: (collections.Counter(words(r[1])), r[2]) for r in rows if r[1]}
    for a, (x, s) in c.items():
        for b, (y, t) in c.items():
            if s == "train" and t in ("valid", "test"):
                n, m = sum(x.values()), sum(y.values())
                if min(n, m) >= 4 and sum((x & y).values()) >= 0.8 * max(n, m):
                    want.add((min(a, b), max(a, b)))
    got = {tuple(r) for r in overlap.record_pairs(*overlap.overlaps(df, "rec_id", "t", "split")).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and (905, 906) in got
    n = collections.Counter(x for p in got for x in p)
    assert {r.id: r.n_links for r in overlap.link_counts(*overlap.overlaps(df, "rec_id", "t", "split")).collect()} == dict(n)
    assert overlap.record_pairs(*overlap.overlaps(df.limit(0), "rec_id", "t", "split")).count() == 0


def test_controlled_rounding():
    rng = np.random.default_rng(2)
    for _ in range(60):
        r, c = int(rng.integers(1, 6)), int(rng.integers(1, 6))
        table = {}
        for i in range(r):
            n, share = int(rng.integers(0, 40)), rng.dirichlet(np.ones(c))
            table |= {(f"r{i}", f"c{j}"): n * share[j] for j in range(c)}
        got = sampling.controlled_rounding(table)
        for k, v in table.items():
            assert math.floor(v + 1e-9) <= got[k] <= math.ceil(v - 1e-9)
        for i in range(r):
            assert sum(v for (a, _), v in got.items() if a == f"r{i}") == round(sum(v for (a, _), v in table.items() if a == f"r{i}"))
        for j in range(c):
            x = sum(v for (_, b), v in table.items() if b == f"c{j}")
            assert math.floor(x + 1e-9) <= sum(v for (_, b), v in got.items() if b == f"c{j}") <= math.ceil(x - 1e-9)


def test_draw_is_exact_and_repeatable(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("category"), (F.col("id") % 2).cast("string").alias("second"))
    quota = spark.createDataFrame([("p", "a", "0", 100), ("p", "a", "1", 0), ("p", "b", "0", 1), ("p", "b", "1", 1667), ("q", "a", "0", 833)], "plan string, category string, second string, quota long")
    got = sampling.draw(rows, quota)
    n = {(r.plan, r.category, r.second): r["count"] for r in got.groupBy("plan", "category", "second").count().collect()}
    assert n == {("p", "a", "0"): 100, ("p", "b", "0"): 1, ("p", "b", "1"): 1667, ("q", "a", "0"): 833}
    assert got.select("plan", "id").distinct().count() == got.count()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in sampling.draw(rows.repartition(3), quota).collect()}


def test_needs(spark):
    df = spark.createDataFrame([("1", " Alegría ", "s"), ("1", "ALEGRÍA", "s"), ("2", "alegría", None), ("3", "Miedo", "s"), ("4", None, "s"), ("5", " ", "s"), (None, "Miedo", "s")], "id string, e string, s string")
    rows = sampling.eligible(df, "id", F.col("e"), F.col("s"), F.lit(True))
    t = spark.createDataFrame([("p", 100, "Alegría", 50, 1), ("p", 100, "Miedo", 50, 2), ("p", 100, "Asco", 0, 0)], "plan string, sample_pct int, category string, target_pct int, min_rows int")
    got = {r.category: (r.need, r.available, r.met) for r in sampling.needs(rows, t).collect()}
    assert got == {"Alegría": (2, 2, True), "Miedo": (2, 1, False), "Asco": (0, 0, True)}
    empty = sampling.needs(rows.limit(0), t)
    assert {r.category: r.met for r in empty.collect()} == {"Alegría": False, "Miedo": False, "Asco": True}
    assert sampling.draw(rows, sampling.quotas(rows, sampling.needs(rows, t))).count() == 3
    assert sampling.draw(rows.limit(0), sampling.quotas(rows.limit(0), empty)).count() == 0


def test_mixing(spark):
    docs = spark.createDataFrame([(i, s, 10, "x") for i, s in enumerate(["a"] * 600 + ["b"] * 300 + ["c"] * 95 + [None] * 5)], "doc_id long, source string, size long, copies string")
    t = spark.createDataFrame([("a", 30, 1), ("b", 45, 3), ("c", 25, 2), ("d", 5, 9)], "source string, target_pct int, max_repeats int")
    rate = mixing.rates(mixing.by_source(docs), t)
    r = {x.source: x for x in rate.collect()}
    assert {k: x.met for k, x in r.items()} == {"a": True, "b": True, "c": False, "d": False}
    assert abs(r["b"].rate - 9950 * 0.45 / 3000) < 1e-9 and r["c"].rate == 2 and r["d"].rate == 0
    mixed = mixing.mix(docs, rate, "doc_id")
    got = {x.source: x for x in mixing.report(mixed, rate).collect()}
    assert got["c"].size_out == 1900 and got["d"].size_out == 0 and got["b"].most_copies == 2
    assert abs(got["a"].size_out / 9950 - 0.30) < 0.05 and abs(got["b"].size_out / 9950 - 0.45) < 0.05
    assert mixing.emitted(mixed).count() == sum(x.size_out for x in got.values()) // 10
    none = mixing.rates(mixing.by_source(docs.limit(0)), t)
    assert [x.size for x in none.collect()] == [0] * 4 and mixing.report(mixing.mix(docs.limit(0), none, "doc_id"), none).count() == 4


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(rng.choice(["casa", "perro", "mesa", "luz"], int(rng.integers(1, 60)))), 1) for i in range(300)]
    texts += [(900, "casa " * 1000, 1), (901, None, 1), (902, "", 1), (903, "  ", 1), (5, "otra vez cinco", 1)]
    return spark.createDataFrame(texts, "doc_id long, text string, size int")


def test_packing(spark, docs):
    cap = 400
    got = packing.pack(docs, "doc_id", "text", cap, block=64).toPandas()
    load = got.groupby("container")["size"].sum()
    assert load.max() <= cap
    own = packing.pieces(docs, "doc_id", "text", cap).toPandas()
    assert sorted(zip(got.uid, got.piece)) == sorted(zip(own.uid, own.piece)) and not got.duplicated(["uid", "piece"]).any()
    assert set(got[got.n_tokens > cap].id) == set(got[got.piece > 0].id) == {900}
    assert got[got.n_tokens <= cap].groupby("uid").size().max() == 1
    assert len(load) <= math.ceil(own["size"].sum() / cap) * 1.03 + 1
    assert not {901, 902, 903} & set(got.id)
    assert packing.pack(docs.limit(0), "doc_id", "text", cap).count() == 0


def test_evolve_keeps_every_item():
    rng = np.random.default_rng(0)
    size = np.sort(rng.integers(1, 60, 200))
    for g in packing.evolve(size, 100, [], 1, 4, 20):
        assert sorted(i for b in g for i in b) == list(range(200)) and max(packing._loads(g, size)) <= 100
    first = packing.evolve(size, 100, [], 1, 1, 0)[0]
    best = packing.evolve(size, 100, [first], 2, 5, 60)[0]
    assert len(best) <= len(first)


def test_quality(spark):
    """Trees from weak labels of documents, calibrated on half of the hand-checked texts, judge the other half, which they never saw."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    trees = quality.fit(docs, "text", "doc_id", hand=quality_holdout.TEXTS[::2])
    unseen = quality_holdout.TEXTS[1::2]
    df = spark.createDataFrame([(i, t, y, "x") for i, (t, y) in enumerate(unseen)] + [(900, None, 2, "x"), (901, " ", 2, "x"), (902, "", 2, "x"), (903, unseen[0][0], 2, "x")], "doc_id int, text string, prose int, commas string")
    got = {r.doc_id: r.prose for r in quality.score(df, "text", trees).collect()}
    assert got[900] is None and got[901] is None and got[902] is None and got[903] == got[0]
    hits = sum((got[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(unseen))
    weak = quality.weak_label(quality.statistics(quality.counts([t for t, _ in unseen])))
    alone = sum(w == y for w, (_, y) in zip(weak, unseen))
    assert hits >= 0.9 * len(unseen) and hits >= alone, (hits, alone, len(unseen))
    assert quality.score(df.limit(0), "text", trees).count() == 0


def test_quality_without_both_kinds(spark):
    df = spark.createDataFrame([(1, "Me gusta mucho la pantalla y el teclado de esta laptop."), (2, None)], "doc_id int, text string")
    for rows in (df, df.limit(0)):
        trees = quality.fit(rows, "text", "doc_id")
        assert not trees.value and {r.prose for r in quality.score(df, "text", trees).collect()} == {None}


def test_quality_sample_does_not_hang_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a, b = (quality.fit(d, "text", "doc_id", most=60) for d in (docs.repartition(7), docs.coalesce(1)))
    assert all((x == y).all() for x, y in zip(a.value, b.value)) and len(a.value) == len(b.value)


def test_counts_against_patterns():
    """Every count, said as a pattern over one text."""
    import regex

    ws = r"[ \t\n\x0b\f\r]"
    pat = {
        "letters": r"\p{L}", "digits": r"\p{N}", "upper": r"\p{Lu}", "commas": ",", "symbols": r"[^\p{L}\p{N} \t\n\x0b\f\r.,;:!?¡¿\"'()…“”-]", "lines": r"(?m)^[ \t\x0b\f\r]*+[^ \t\n\x0b\f\r]",
        "marked": rf"(?m)^[ \t\x0b\f\r]*+(?:[-*•·>+]|[0-9]{{1,4}}[.)])(?:{ws}|\Z)", "labels": rf"(?m)^[^:\n]{{1,40}}+:(?:{ws}|\Z)", "ends": rf"[\p{{L}}\p{{N}})\"”][.!?…]++(?:{ws}|\Z)", "hard": r"(?i)[bcdfghjklmnñpqrstvwxyz]{5,}+",
        "mixed": r"\p{L}\p{N}|\p{N}\p{L}|[#@]\p{L}|://|\p{Ll}\p{Lu}", "short_lines": r"(?m)^[ \t\x0b\f\r]*+[^\s]++(?: [^\s]++)?+[ \t\x0b\f\r]*+$", "ended": r"(?m)[.!?…][\"”»)]*+[ \t\x0b\f\r]*+(?:[\u2600-\u27BF\uFE0F\U0001F000-\U0001FAFF]++[ \t\x0b\f\r]*+)?$",
    }
    texts = [t for t, _ in quality_holdout.TEXTS] + ["", " ", "\n\n", "a", ".", "x" * 9000, "ñ: sí.\n\n- a1b2c3 http://x.y #tag @yo camelCase\n12) uno\n  3. dos tres  \n", "Bien. 👍👍 \nMal \"así.\"\nfin...", "palabra " * 3, "𝟙𝟚 ǅ ß"]
    got = quality.counts(texts)
    for name, p in pat.items():
        assert got[name].tolist() == [len(regex.findall(p, t)) for t in texts], name
    for i, t in enumerate(texts):
        w = regex.findall(r"[\p{L}\p{N}]+", t.lower())
        assert (got["words"][i], got["distinct"][i], got["pairs"][i], got["common"][i]) == (len(w), len(set(w)), len(set(zip(w, w[1:]))), sum(x in quality.COMMON for x in w)), t


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([("- Uno: dos 3\n- cuatro, la de la.\n", 7.0)], "text string, n_words double")
    r = quality.with_statistics(df, "text").collect()[0]
    assert (r.n_words, r.n_lines, r.marked_lines, r.ended_lines, r.commas) == (7, 2, 1.0, 0.5, 1 / 7)
    assert r.common_words == 4 / 7 and r.digit_ratio == 1 / 33 and r.distinct_words == 6 / 7


def test_boost_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    t = quality.boost(x[:1500], y[:1500])
    assert ((t.prose(x[1500:]) > 0.5) == y[1500:]).mean() > 0.93


def test_search_beats_best_fit():
    """Containers that three items fill exactly: best fit alone wastes a tenth of them."""
    rng = np.random.default_rng(0)
    size = []
    for _ in range(40):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2 + 1))
        size += [a, b, 1000 - a - b]
    size = np.sort(np.array(size))
    alone: packing.Bins = []
    packing.best_fit(list(range(len(size))), size, 1000, alone, [])
    assert len(packing.evolve(size, 1000, [], 0, 5, 60)[0]) <= len(alone) - 4


def test_both_kinds_of_vocabulary_agree():
    """Ranks and JSON of the same vocabulary count alike, also over long runs of white space."""
    from tamiza.llm import tokens

    texts = ["", " ", "hola, ¿qué tal? <|endoftext|>", "x" + " " * 30000 + "y", " " * 20001, " \n" * 20000 + "hola mundo", "a" * 30000, "hola" + " " * 9999 + " z " + "\n" * 12000 + " fin " + " " * 15000]
    assert tokens.counter("/opt/tokenizers/byte_bpe_50k.tiktoken")(texts) == tokens.counter("/opt/tokenizers/byte_bpe_50k.json")(texts)


def test_columns_are_bounded(spark):
    """A second attribute of many values: category totals stay exact."""
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("category"), F.col("id").cast("string").alias("second"))
    few = sampling.columned(rows, 50)
    assert few.select("second").distinct().count() == 50 and sampling.columned(rows, 4000).select("second").distinct().count() == 4000
    need = spark.createDataFrame([("p", "A ", 300, 1000, True), ("p", "b", 4000, 3000, False), ("p", "c", 1, 0, False)], "plan string, category string, need long, available long, met boolean")
    drawn = sampling.draw(few, sampling.quotas(few, need))
    assert {(r.category, r["count"]) for r in drawn.groupBy("category").count().collect()} == {("a", 300), ("b", 3000)}
    assert {(r.category, r.drawn) for r in sampling.shortfalls(drawn, need).collect()} == {("b", 3000), ("c", 0)}


def test_reduced_keeps_margins():
    """Blocks of columns, then what they leave: cells and column totals at their floor or ceiling, row totals exact, few cells left."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        r, c, blocks = int(rng.integers(1, 7)), int(rng.integers(1, 60)), int(rng.integers(1, 5))
        count = {(f"r{i}", f"c{j:02d}"): int(rng.integers(1, 9)) for i in range(r) for j in range(c) if rng.random() < 0.8}
        have = collections.Counter()
        for (a, _), n in count.items():
            have[a] += n
        shares = {p: {a: (int(rng.integers(1, n + 1)), n) for a, n in sorted(have.items())} for p in "pq"}
        got, left = {}, collections.defaultdict(dict)
        for k in range(blocks):
            block = [(f"c{j:02d}", [(a, n) for (a, b), n in count.items() if b == f"c{j:02d}"]) for j in range(k, c, blocks)]
            parts = collections.Counter()
            for p, a, b, q, x in sampling.reduced(block, shares):
                got[p, a, b] = q
                if x:
                    left[p][a, b] = x
                    parts[p] += 1
            assert all(n <= 2 * r for n in parts.values())
        for p, t in left.items():
            for k, n in sampling.controlled_rounding(t).items():
                got[(p, *k)] += n
        for p, share in shares.items():
            exact = {(a, b): fractions.Fraction(share[a][0] * n, share[a][1]) for (a, b), n in count.items()}
            assert all(math.floor(v) <= got[(p, *k)] <= math.ceil(v) for k, v in exact.items())
            for b in {b for _, b in exact}:
                x = sum(v for k, v in exact.items() if k[1] == b)
                assert math.floor(x) <= sum(got[(p, *k)] for k in exact if k[1] == b) <= math.ceil(x)
            assert all(sum(got[(p, *k)] for k in exact if k[0] == a) == share[a][0] for a in share)


def test_sample_of_many_sources(spark, tmp_path):
    """p5_sample: more than 10 000 sources keep their names, and each its own share, as few do; the layout of the rows changes nothing."""
    n, d = 10_500, F.col("id")
    rows = spark.range(3 * n).select(F.concat(F.lit("r"), d.cast("string")).alias("id_review"), F.lit("texto").alias("final_clean_text"), F.when(d % 3 == 0, "Miedo").otherwise("Alegría").alias("emotion"), F.concat(F.lit("s"), F.floor(d / 3).cast("string")).alias("source"))
    none = spark.createDataFrame([], "id_review string, intensity int, source string")
    targets = spark.createDataFrame([("p", "fase5_records", "emotion", 50, "Alegría", 50, 1), ("p", "fase5_records", "emotion", 50, "Miedo", 30, 1)], "plan string, tbl string, field string, sample_pct int, category string, target_pct int, min_rows int")
    out = []
    for k in (1, 5):
        at = str(tmp_path / str(k))
        for name, df in (("fase5_records", rows.repartition(k)), ("complete", none), ("sample_targets", targets)):
            df.write.parquet(f"{at}/{name}.parquet")
        out.append(queries.p5_sample(spark, at).collect())
    assert {tuple(r) for r in out[0]} == {tuple(r) for r in out[1]}
    assert all(r.second == f"s{int(r.id[1:]) // 3}" for r in out[0])
    # Every source has 2 of 21 000 and 1 of 10 500: 0.75 and 0.45 of them are drawn, 1.2 together.
    assert collections.Counter(r.category for r in out[0]) == {"alegría": 7875, "miedo": 4725}
    assert set(collections.Counter(r.second for r in out[0]).values()) == {1, 2} and len({r.second for r in out[0]}) == n
    assert set(collections.Counter((r.second, r.category) for r in out[0]).values()) == {1}
