"""Dictionary spelling: edit-distance lookup by deletes, token and text correction, split-word merge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamiza.functions.lineage import written
from tamiza.functions.text import consonant_skeleton
from tamiza.lexicons import rules as lx

KEEP, GAIN, CORPUS = 2.2, 0.9, 2.5
PART, STRICT, LOOSE, GAP = 3.0, 2.2, 1.6, 0.5
_WORD = r"(?iu)[a-záéíóúüñ]+"


def deletes(w: Column, distance: int = 1) -> Column:
    """The word and everything it becomes by up to `distance` deletions."""
    one = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    out = F.array_union(F.array(w), one(w))
    for _ in range(distance - 1):
        out = F.array_union(out, F.flatten(F.transform(out, one)))
    return out


def within_one(a: Column, b: Column) -> Column:
    """Edit distance 0 or 1, in which swapping two neighbours is one step; NULL beyond."""
    lev = F.levenshtein(a, b)
    swapped = lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2))
    swaps = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: swapped(i) == b)
    return F.when(lev <= 1, lev).when((lev == 2) & (F.length(a) == F.length(b)) & swaps, 1)


def osa(x: pd.Series, y: pd.Series) -> pd.Series:
    """Optimal string alignment: as edit distance with swaps, no part edited twice."""

    def one(a: str, b: str) -> int:
        two, prev = [], list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = [i]
            for j, d in enumerate(b, 1):
                best = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (c != d))
                if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                    best = min(best, two[j - 2] + 1)
                row.append(best)
            two, prev = prev, row
        return prev[-1]

    return pd.Series([one(a, b) for a, b in zip(x, y)], dtype="int32")


def near_words(queries: DataFrame, dictionary: DataFrame, distance: int = 1) -> DataFrame:
    """(token, word, n, d) within `distance`; queries: (token), dictionary: (word, n). Words meet by a common delete."""
    q = queries.select("token", F.explode(deletes(F.col("token"), distance)).alias("k"))
    w = dictionary.select("word", "n", F.explode(deletes(F.col("word"), distance)).alias("k"))
    pairs = q.join(w, "k").select("token", "word", "n").distinct()
    a, b = F.col("token"), F.col("word")
    return pairs.withColumn("d", within_one(a, b) if distance == 1 else F.pandas_udf(osa, "int")(a, b)).filter(F.col("d") <= distance)


def near_frequent(counts: DataFrame, ratio: float) -> DataFrame:
    """(token, word, d): every token of the counts (token, n) with each word one edit away that is at least `ratio` times as frequent. The bound is the pair's own, so it is the same at every size."""
    q = counts.select("token", F.col("n").alias("own"), F.explode(deletes(F.col("token"))).alias("k"))
    w = counts.select(F.col("token").alias("word"), "n", F.explode(deletes(F.col("token"))).alias("k"))
    pairs = q.join(w, "k").filter(F.col("n") >= F.col("own") * ratio).select("token", "word").distinct()
    return pairs.withColumn("d", within_one(F.col("token"), F.col("word"))).filter(F.col("d") <= 1)


def best_words(queries: DataFrame, dictionary: DataFrame, distance: int = 1) -> DataFrame:
    """(token, word, d): nearest, then most frequent, then first by alphabet."""
    w = Window.partitionBy("token").orderBy("d", F.desc("n"), "word")
    return near_words(queries, dictionary, distance).withColumn("k", F.row_number().over(w)).filter("k = 1").select("token", "word", "d")


def frequency_dictionary(corpus: DataFrame, lexicon: DataFrame, top: int = 50_000) -> DataFrame:
    """(word, n): corpus words that are technical or common, protected terms at 100 000, the lexicon's `top` words. corpus: (token, n), lexicon: (word, zipf)."""
    own = corpus.select(F.col("token").alias("word"), "n").join(lexicon, "word", "left").filter(F.col("word").isin(*lx.TECH_TERMS) | (F.coalesce("zipf", F.lit(0.0)) >= CORPUS)).select("word", "n")
    spark = corpus.sparkSession
    terms = spark.createDataFrame([(t, 100_000) for t in lx.TECH_TERMS], "word string, n long")
    common = lexicon.orderBy(F.desc("zipf"), "word").limit(top).select("word", F.greatest(F.lit(1), F.floor(F.pow(F.lit(10.0), F.col("zipf")))).cast("long").alias("n"))
    return own.unionByName(terms).unionByName(common).groupBy("word").agg(F.sum("n").alias("n"))


def token_corrections(tokens: DataFrame, dictionary: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(token, word) of distinct lower-case tokens that change: neither short, numeric, protected, common nor known; the nearest word has the same consonants and is clearly more common."""
    t = tokens.select(F.lower("token").alias("token")).distinct()
    t = t.filter((F.length("token") > 2) & ~F.col("token").rlike(r"\p{N}") & ~F.col("token").isin(*lx.TECH_TERMS))
    t = t.join(lexicon.select(F.col("word").alias("token"), F.col("zipf").alias("own")), "token", "left").withColumn("own", F.coalesce("own", F.lit(0.0))).filter(F.col("own") < KEEP)
    t = t.join(dictionary.select(F.col("word").alias("token")), "token", "left_anti")
    best = best_words(t.select("token"), dictionary).join(lexicon, "word", "left")
    good = best.join(t, "token").filter((F.coalesce("zipf", F.lit(0.0)) >= F.col("own") + GAIN) & (consonant_skeleton(F.col("word")) == consonant_skeleton(F.col("token"))))
    return good.select("token", "word")


def spellcheck_corrections(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, word): unknown words take the nearest word within two edits."""
    t = tokens.filter(F.col("token") != F.upper("token")).select(F.lower("token").alias("token")).distinct()
    t = t.filter((F.length("token") > 2) & ~F.col("token").rlike(r"\p{N}") & ~F.col("token").isin(*lx.PROTECTED_TERMS))
    t = t.join(dictionary.select(F.col("word").alias("token")), "token", "left_anti")
    return best_words(t, dictionary, 2).select("token", "word")


def replace_tokens(df: DataFrame, column: str, corrections: DataFrame, id_cols: list[str], name: str | None = None) -> DataFrame:
    """Df with corrected words, the case of each kept, all else untouched. corrections: (token, word). Only texts with a correction meet it, by join on the token."""
    name = name or column
    parts = F.regexp_extract_all(F.col(column), F.lit(r"(?iu)[a-záéíóúüñ]+|[^a-záéíóúüñ]+"), F.lit(0))
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(_WORD), F.lit(0)), lambda w: F.lower(w)))
    need = df.select(*id_cols, F.explode(words).alias("token")).join(corrections, "token").groupBy(*id_cols).agg(F.map_from_entries(F.collect_set(F.struct("token", "word"))).alias("__m"))

    def fix(p: Column) -> Column:
        to = F.try_element_at(F.col("__m"), F.lower(p))
        cased = F.when((p == F.upper(p)) & (F.length(p) > 1), F.upper(to)).when(F.substring(p, 1, 1) == F.upper(F.substring(p, 1, 1)), F.concat(F.upper(F.substring(to, 1, 1)), F.substring(to, 2, 1 << 30))).otherwise(to)
        return F.when(to.isNotNull(), cased).otherwise(p)

    rows = df.join(need, id_cols, "left")
    return rows.withColumn(name, F.when(F.col("__m").isNull(), F.col(column)).otherwise(F.array_join(F.transform(parts, fix), ""))).drop("__m")


def _pair_words(pair: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(l, r, word, top, second): the best word that a vowel between l and r makes, its frequency and the runner-up's; an accented word within a quarter of the best wins."""
    options = F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(lx.VOWELS)])
    made = pair.select("l", "r", F.explode(options).alias("x")).select("l", "r", "x.i", F.concat("l", "x.v", "r").alias("word")).join(lexicon.filter("zipf > 0"), "word")
    ranked = F.sort_array(F.collect_list(F.struct("zipf", "i", "word")), asc=False)
    marked = lambda w: w["word"].rlike("[áéíóú]")
    top = made.groupBy("l", "r").agg(ranked.alias("w")).withColumn("m", F.when(~marked(F.col("w")[0]), F.get(F.filter("w", marked), F.lit(0))))
    use = F.when(F.col("m.zipf") >= F.col("w")[0]["zipf"] - 0.25, F.col("m")).otherwise(F.col("w")[0])
    return top.select("l", "r", use["word"].alias("word"), use["zipf"].alias("top"), F.coalesce(F.get("w", F.lit(1))["zipf"], F.lit(0.0)).alias("second"))


def _pair_rulings(pair: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(l, r, kind, word, strict, waits) of the pairs that something may happen to. kind: `join` for one word, `first` where only the first word changes, NULL for neither; strict: the joined word is common; waits: r, a single letter, may belong to the word behind it."""
    freq = lambda c: lexicon.select(F.col("word").alias(c), F.col("zipf").alias(f"f{c}"))
    p = pair.join(_pair_words(pair, lexicon), ["l", "r"], "left").join(freq("l"), "l", "left").join(freq("r"), "r", "left").na.fill(0.0, ["fl", "fr", "top", "second"])
    single = lambda c: (F.length(c) == 1) & ~F.col(c).isin(*lx.NO_MERGE_LETTERS)
    torn = ~F.col("l").isin(*lx.NO_MERGE_WORDS) & ~F.col("r").isin(*lx.NO_MERGE_WORDS) & (single("l") | single("r") | (F.col("fl") < PART) | (F.col("fr") < PART))
    clear = (F.col("top") >= STRICT) | ((F.col("top") >= LOOSE) & (F.col("top") - F.col("second") >= GAP))
    est = F.col("l") == "est"
    verb = F.col("r").isin(*lx.AFTER_ESTA) | F.col("r").rlike("(?:ando|iendo|yendo)$")
    rulings = [
        (est & F.col("r").isin(*lx.VOWELS), F.lit("join"), F.lit("está")),
        (est & (F.col("fr") >= PART), F.lit("first"), F.when(verb, "está").otherwise("esta")),
        (F.col("word").isNotNull() & torn & clear, F.lit("join"), F.col("word")),
    ]
    kind, word = F.lit(None).cast("string"), F.lit(None).cast("string")
    for when, k, w in reversed(rulings):
        kind, word = F.when(when, k).otherwise(kind), F.when(when, w).otherwise(word)
    waits = ~est & (F.length("r") == 1) & (F.length("l") > 1) & (F.col("fl") >= PART)
    return p.select("l", "r", kind.alias("kind"), word.alias("to"), (F.col("top") >= STRICT).alias("strict"), waits.alias("waits")).filter("kind IS NOT NULL OR strict")


def merge_split_words(df: DataFrame, column: str, lexicon: DataFrame, name: str | None = None) -> DataFrame:
    """D15 on a column: words torn in two are joined by a vowel where a lexicon (word, zipf) of any size knows the result.

    Every distinct pair of neighbours is judged once, by joins with the lexicon; a text then meets the rulings of its own
    pairs, and of rulings that overlap the leftmost one counts. NULL stays NULL.
    """
    name = name or column
    rows = written(df.select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("__n"), F.regexp_extract_all(F.col(column), F.lit(r"(?iu)[a-záéíóúüñ]+|[^a-záéíóúüñ]+"), F.lit(0)).alias("__p")))
    is_word = lambda x: x.rlike(r"(?iu)\A[a-záéíóúüñ]")
    blank = lambda x: x.rlike(r"(?U)\A[\s\x1c-\x1f\x85]+\z")
    part = lambda k: F.get("__p", F.col("i") + k)
    at = rows.select("__n", "__p", F.explode(F.sequence(F.lit(0), F.greatest(F.size("__p") - 1, F.lit(0)))).alias("i")).filter(is_word(part(0)) & blank(part(1)) & part(2).isNotNull())
    third = F.when((F.length(part(2)) == 1) & blank(part(3)), F.lower(part(4)))
    at = at.select("__n", "i", F.lower(part(0)).alias("l"), F.lower(part(2)).alias("r"), third.alias("t"))
    pair = at.select("l", "r").unionByName(at.filter("t IS NOT NULL").select(F.col("r").alias("l"), F.col("t").alias("r"))).distinct()
    ruled = written(_pair_rulings(pair, lexicon))
    found = at.join(ruled.filter("kind IS NOT NULL"), ["l", "r"])
    later = ruled.filter("strict").select(F.col("l").alias("r"), F.col("r").alias("t"), F.lit(True).alias("taken"))
    found = found.join(later, ["r", "t"], "left").filter(~(F.col("waits") & F.coalesce("taken", F.lit(False))))
    own = found.groupBy("__n").agg(F.array_sort(F.collect_list(F.struct("i", "kind", "to"))).alias("c"))
    # Left to right: what a ruling takes begins behind the parts of the one before.
    none = F.array().cast("array<struct<i:int,kind:string,to:string>>")
    chosen = F.aggregate("c", none, lambda acc, c: F.when(F.coalesce(F.array_max(F.transform(acc, lambda x: x["i"])), F.lit(-9)) + 2 < c["i"], F.concat(acc, F.array(c))).otherwise(acc))
    own = own.select("__n", F.map_from_entries(F.transform(chosen, lambda c: F.struct(c["i"], F.struct(c["kind"], c["to"])))).alias("__m"))

    def cased(word: Column, like: Column) -> Column:
        first = F.substring(like, 1, 1)
        return F.when(like == F.upper(like), F.upper(word)).when(first == F.upper(first), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))).otherwise(word)

    def mended(x: Column, i: Column) -> Column:
        here = F.try_element_at("__m", i)
        gone = lambda k: F.coalesce(F.try_element_at("__m", i - k)["kind"] == "join", F.lit(False))
        like = F.when(here["kind"] == "join", F.concat(x, F.coalesce(F.get("__p", i + 2), F.lit("")))).otherwise(x)
        return F.when(here.isNotNull(), cased(here["to"], like)).when(gone(1) | gone(2), F.lit("")).otherwise(x)

    text = F.when(F.col("__m").isNull(), F.col(f"row.{column}")).otherwise(F.array_join(F.transform("__p", mended), ""))
    out = rows.join(own, "__n", "left").select("row", text.alias("__text")).select("row.*", "__text")
    return out.withColumn(name, F.col("__text")).drop("__text")
