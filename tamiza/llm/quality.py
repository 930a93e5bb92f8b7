"""Per-document text quality statistics, and how likely a text is natural prose.

The statistics of a batch of texts are taken together, over one array of their
code points: every count is a sum over positions, lines or words, so no text is
walked through by a pattern. Gradient-boosted trees are fitted on them: labelling
rules vote on a sample of at most `most` documents, those of smallest hash; texts
on which the rules disagree or are silent are left out, and the trees' scores are
calibrated (Platt) on a holdout checked by hand, which the trees never see. The
trees read the statistics only, never the rules.

Defined cases: NULL, empty and blank texts have statistics of 0 and no
probability; repeated texts score alike; very long texts are whole; where the
sample does not hold both kinds (an empty table, say) there is no model, and no
text has a probability. Input columns stay, whatever their names; those named like
a result are replaced.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words of Spanish, English and Portuguese.
COMMON = (
    "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante ni contra otros ese eso mi tan "
    "the of and to in is it for on with was that this i my at by an be as when "
    "os do da em um uma não na se mais dos mas ao ou pelo quando foi"
).split()
# Classes of characters, one bit each.
LETTER, NUMBER, UPPER, LOWER, BLANK, SYMBOL, STOP, TAIL, CONSONANT, MARKER, BEFORE_STOP, SEPARATOR = (np.uint16(1 << k) for k in range(12))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and small letter of every code point."""
    bits, small = np.zeros(sys.maxunicode + 1, dtype=np.uint16), np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for o in range(sys.maxunicode + 1):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind[0] == "L":
            bits[o] |= LETTER | BEFORE_STOP
            low = c.lower()
            if len(low) == 1:
                small[o] = ord(low)
        elif kind[0] == "N":
            bits[o] |= NUMBER | BEFORE_STOP
        bits[o] |= {"Lu": UPPER, "Ll": LOWER}.get(kind, np.uint16(0))
    own = lambda chars: [ord(c) for c in chars]
    bits[own(" \t\n\x0b\f\r")] |= BLANK | TAIL
    plain = np.zeros(len(bits), dtype=bool)
    plain[own(" \t\n\x0b\f\r.,;:!?¡¿\"'()…“”-")] = True
    bits[((bits & (LETTER | NUMBER)) == 0) & ~plain] |= SYMBOL
    bits[own(".!?…")] |= STOP
    bits[own("\"”»)")] |= TAIL
    for lo, hi in ((0x2600, 0x27BF), (0xFE0F, 0xFE0F), (0x1F000, 0x1FAFF)):
        bits[lo : hi + 1] |= TAIL
    bits[own("bcdfghjklmnñpqrstvwxyzBCDFGHJKLMNÑPQRSTVWXYZ")] |= CONSONANT
    bits[own("-*•·>+")] |= MARKER
    bits[own(")\"”")] |= BEFORE_STOP
    bits[own("|;\t{}[]")] |= SEPARATOR
    return bits, small


_POWERS = np.cumprod(np.full(4096, 0x100000001B3, dtype=np.uint64), dtype=np.uint64)


def _hashes(small: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word. at: positions of word characters; starts: where words begin among them."""
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    h = np.add.reduceat((small[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place % len(_POWERS)], starts)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


@cache
def _common() -> np.ndarray:
    text = " ".join(COMMON)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero(codes != 32)
    return np.unique(_hashes(codes, at, np.flatnonzero(np.diff(at, prepend=-2) > 1)))


def _following(mask: np.ndarray) -> np.ndarray:
    """For each position the first one from there on where the mask does not hold."""
    at = np.where(mask, np.int32(len(mask)), np.arange(len(mask), dtype=np.int32))
    return np.minimum.accumulate(at[::-1])[::-1]


def counts(texts: list[str]) -> dict[str, np.ndarray]:
    """Raw counts of each text."""
    bits_of, small_of = _tables()
    n = len(texts)
    codes = np.frombuffer(("\n".join(texts) + "\n\n\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=n)
    bits = bits_of[codes]
    is_ = lambda bit: (bits & bit) != 0
    doc = np.append(np.repeat(np.arange(n, dtype=np.int32), lens + 1), np.full(2, n, dtype=np.int32))  # a text's end is a line break; two more stand behind the last
    idx = np.arange(len(codes), dtype=np.int32)
    per_doc = lambda mask: np.bincount(doc[mask], minlength=n + 1)[:n]
    before = lambda mask: np.concatenate([[False], mask[:-1]])
    after = lambda mask: np.concatenate([mask[1:], [False]])
    char = lambda c: codes == ord(c)

    letter, number, blank, stop = is_(LETTER), is_(NUMBER), is_(BLANK), is_(STOP)
    out = {"chars": lens, "letters": per_doc(letter), "digits": per_doc(number), "upper": per_doc(is_(UPPER)), "symbols": per_doc(is_(SYMBOL)), "commas": per_doc(char(","))}

    # Lines: each ends with its line break.
    line = np.concatenate([[0], np.flatnonzero(char("\n"))[:-1] + 1])
    line_doc = doc[line]
    per_line = lambda mask: np.bincount(line_doc[mask], minlength=n + 1)[:n]
    none = np.int32(len(codes) - 1)
    first = lambda mask: np.minimum.reduceat(np.where(mask, idx, none), line)
    last = lambda mask: np.maximum.reduceat(np.where(mask, idx, np.int32(-1)), line)
    begin, end = first(~blank), last(~blank)
    filled = end >= 0
    solid = last(~is_(TAIL))
    digit = (codes >= 48) & (codes <= 57)
    beyond = _following(digit)[begin]
    numbered = (beyond > begin) & (beyond - begin <= 4) & np.isin(codes[beyond], [46, 41]) & blank[np.minimum(beyond + 1, none)]
    marked = (is_(MARKER)[begin] & blank[np.minimum(begin + 1, none)]) | numbered
    colon = first(char(":"))
    labelled = (colon < none) & (colon - line >= 1) & (colon - line <= 40) & blank[np.minimum(colon + 1, none)]
    word_begins = ~blank & before(blank)
    word_begins[0] = ~blank[0]
    tokens, dark = np.add.reduceat(word_begins.astype(np.int64), line), np.add.reduceat((~blank).astype(np.int64), line)
    short = (tokens == 1) | (tokens == 2) & (end - begin + 1 - dark == 1)
    out |= {"lines": per_line(filled), "ended": per_line((solid >= 0) & stop[solid]), "marked": per_line(filled & marked), "labels": per_line(labelled), "short_lines": per_line(short)}

    run_end = _following(stop)
    out["ends"] = per_doc(stop & before(is_(BEFORE_STOP)) & blank[np.minimum(run_end, none)])
    space = char(" ")
    arrows = (char(">") | char("·")) & before(blank) & after(blank)
    out["separators"] = per_doc(is_(SEPARATOR)) + per_doc(arrows) + per_doc(space & ~before(space) & after(space)) + per_doc(char('"') & after(char(":")))
    consonant = is_(CONSONANT)
    out["hard"] = per_doc(consonant & ~before(consonant) & (_following(consonant) - idx >= 5))
    pair = (letter & after(number)) | (number & after(letter)) | ((char("#") | char("@")) & after(letter)) | (is_(LOWER) & after(is_(UPPER)))
    # Neighbouring pairs share a character: of a run of them every other one counts.
    run = pair & ~before(pair)
    even = (idx - np.maximum.accumulate(np.where(run, idx, np.int32(0)))) % 2 == 0
    out["mixed"] = per_doc(pair & even) + per_doc(char(":") & after(char("/")) & after(after(char("/"))))

    word = letter | number
    at = np.flatnonzero(word)
    word_starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    if not len(at):
        return out | {k: np.zeros(n, dtype=np.int64) for k in ("words", "common", "distinct", "pairs")}
    h, of = _hashes(small_of[codes], at, word_starts), doc[at[word_starts]]

    def distinct(h: np.ndarray, of: np.ndarray) -> np.ndarray:
        key = h ^ (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return np.bincount(of[np.unique(key, return_index=True)[1]], minlength=n)[:n]

    same = of[1:] == of[:-1]
    two = (h[:-1] * np.uint64(0x9DDFEA08EB382D69) + (h[1:] ^ (h[1:] >> np.uint64(17))))[same]
    return out | {"words": np.bincount(of, minlength=n), "common": np.bincount(of[np.isin(h, _common())], minlength=n), "distinct": distinct(h, of), "pairs": distinct(two, of[1:][same])}


def statistics(raw: dict[str, np.ndarray]) -> pd.DataFrame:
    """The statistics, all doubles, 0 for texts without characters."""
    get = lambda x: raw[x].astype(float) if isinstance(x, str) else x

    def per(a, b) -> np.ndarray:
        x, y = get(a), get(b)
        return np.divide(x, y, out=np.zeros(len(x)), where=y != 0)

    between = np.maximum(get("words") - 1, 1.0)
    return pd.DataFrame(
        {
            "n_chars": get("chars"),
            "n_words": get("words"),
            "n_lines": get("lines"),
            "mean_word_length": per("letters", "words"),
            "words_per_line": per("words", "lines"),
            "symbol_ratio": per("symbols", "chars"),
            "digit_ratio": per("digits", "chars"),
            "upper_ratio": per("upper", "letters"),
            "ended_lines": per("ended", "lines"),
            "marked_lines": per("marked", "lines"),
            "label_lines": per("labels", "lines"),
            "sentence_ends": per("ends", "words"),
            "separators": per("separators", "words"),
            "common_words": per("common", "words"),
            "distinct_words": per("distinct", "words"),
            "distinct_pairs": per("pairs", between),
            # As a power of the length, so that long texts compare with short ones.
            "word_variety": per(np.log1p(get("distinct")), np.log1p(get("words"))),
            "pair_variety": per(np.log1p(get("pairs")), np.log1p(between)),
            "hard_words": per("hard", "words"),
            "mixed_tokens": per("mixed", "words"),
            "one_word_lines": per("short_lines", "lines"),
            "commas": per("commas", "words"),
        }
    )


def _batches(texts: list[str | None], most: int = 400_000) -> Iterator[list[str]]:
    """Texts in batches of about `most` characters."""
    own, size = [], 0
    for t in texts:
        own.append(t or "")
        size += len(own[-1])
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


NAMES = tuple(
    "n_chars n_words n_lines mean_word_length words_per_line symbol_ratio digit_ratio upper_ratio ended_lines marked_lines label_lines sentence_ends separators common_words distinct_words distinct_pairs word_variety pair_variety hard_words mixed_tokens one_word_lines commas".split()
)
#: What the trees read: all but the sizes, which say nothing about the kind, and what falls with the size.
READ = tuple(n for n in NAMES if n not in ("n_chars", "n_words", "n_lines", "distinct_words", "distinct_pairs"))


def _measured(df: DataFrame, text: str, trees: Trees | None = None) -> DataFrame:
    """df with a struct `__k` of the statistics, and of the probability of prose by the trees, if any are given."""
    names = [*NAMES, "prose"] if trees else list(NAMES)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            got = [statistics(counts(own)) for own in _batches(s.tolist())]
            out = pd.concat(got, ignore_index=True) if got else pd.DataFrame(columns=list(NAMES), dtype=float)
            if trees:
                blank = np.array([t is None or not t.strip() for t in s], dtype=bool)
                out["prose"] = np.where(blank, np.nan, trees.prose(out[list(READ)].to_numpy(dtype=float)))
            yield out

    # Not deterministic to the optimizer: a filter on a result must not run it a second time.
    return df.select("*", run.asNondeterministic()(df[text]).alias("__k"))


def with_statistics(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    rows = _measured(df, text)
    return rows.select(*[rows[c] for c in df.columns if c not in {prefix + n for n in NAMES}], *[F.col(f"__k.{n}").alias(prefix + n) for n in NAMES])


def weak_label(s: pd.DataFrame) -> np.ndarray:
    """1 prose, 0 structure or junk, -1 where the rules disagree or are silent."""
    varied = s.word_variety >= 0.65
    weak = (s.common_words >= 0.22) & varied & (s.n_words >= 6) & (s.separators < 0.05) & (s.marked_lines < 0.5) & (s.label_lines < 0.5)
    strong = (s.sentence_ends >= 0.03) & (s.common_words >= 0.2) & (s.words_per_line >= 6) & (s.marked_lines <= 0.5)
    junk = (
        (s.common_words <= 0.08).astype(int)
        + ((s.pair_variety <= 0.55) & (s.n_words >= 12)).astype(int)
        + ((s.separators >= 0.25) & (s.common_words <= 0.2)).astype(int)
        + ((s.separators >= 0.4) & (s.sentence_ends < 0.03)).astype(int)
        + ((s.label_lines >= 0.8) & (s.n_lines >= 4) & (s.ended_lines <= 0.2) & (s.words_per_line < 8)).astype(int)
        + ((s.marked_lines >= 0.8) & (s.n_lines >= 4) & (s.ended_lines <= 0.2)).astype(int)
        + ((s.one_word_lines >= 0.7) & (s.n_lines >= 4)).astype(int)
        + ((s.symbol_ratio >= 0.3)).astype(int)
        + ((s.mixed_tokens >= 0.5)).astype(int)
    )
    return np.where((weak | strong) & (junk == 0), 1, np.where((junk > 0) & ~strong, 0, -1))


@dataclass
class Trees:
    """Additive trees of depth `depth`; score is a log-odds of prose."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        every = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(len(v).bit_length() - 1):
                node = 2 * node + 1 + (x[every, f[node]] > c[node])
            out += v[node - (len(v) - 1)]
        return out

    def prose(self, x: np.ndarray) -> np.ndarray:
        """NaN where there is no model."""
        if not self.value:
            return np.full(len(x), np.nan)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 160, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, seed: int = 3) -> Trees:
    """Histogram gradient boosting with logistic loss; rows and features are subsampled per tree."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    t, z, leaves = Trees(base), np.full(len(y), base), 1 << depth
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        rows = np.nonzero(rng.random(len(y)) < 0.7)[0]
        cols = rng.permutation(x.shape[1])[: max(3, x.shape[1] * 2 // 5)]
        feature, cut = np.zeros(leaves - 1, dtype=np.int64), np.full(leaves - 1, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for k in range(leaves - 1):
            own = rows[node[rows] == k]
            best, gain = None, 1e-6
            if len(own) >= 10:
                gs, hs = g[own].sum(), h[own].sum()
                for j in cols:
                    if not len(cuts[j]):
                        continue
                    gl = np.cumsum(np.bincount(binned[own, j], g[own], minlength=len(cuts[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], h[own], minlength=len(cuts[j]) + 1))[:-1]
                    s = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    b = int(np.argmax(s))
                    if s[b] > gain:
                        best, gain = (j, cuts[j][b]), s[b]
            if best:
                feature[k], cut[k] = best
            at = node == k
            node[at] = 2 * k + 1 + (x[at, feature[k]] > cut[k])
        leaf = node - (leaves - 1)
        value = rate * np.bincount(leaf[rows], g[rows], minlength=leaves) / (np.bincount(leaf[rows], h[rows], minlength=leaves) + l2)
        t.feature.append(feature)
        t.cut.append(cut)
        t.value.append(value)
        z += value[leaf]
    return t


def calibrate(t: Trees, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling with a weak pull to the uncalibrated scores."""
    z, a, b = t.raw(x), 1.0, 0.0
    # Soft targets keep the slope finite where the holdout is separated.
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        ga, gb = ((p - soft) * z).sum() + 0.5 * (a - 1), (p - soft).sum() + 0.05 * b
        w = p * (1 - p) + 1e-6
        haa, hab, hbb = (w * z * z).sum() + 0.5, (w * z).sum(), w.sum() + 0.05
        det = haa * hbb - hab**2
        # Short steps: Newton's own overshoot where scores are saturated.
        a, b = a - float(np.clip((hbb * ga - hab * gb) / det, -0.2, 0.2)), b - float(np.clip((haa * gb - hab * ga) / det, -0.5, 0.5))
    t.scale, t.shift = float(max(a, 0.05)), float(b)


def holdout() -> list[tuple[str, int]]:
    """(text, 1 for prose): texts written and checked by hand, not taken from any data."""
    from tamiza.llm import quality_holdout

    return quality_holdout.TEXTS


def fit(df: DataFrame, text: str, id_col: str, most: int = 20_000, hand: list[tuple[str, int]] | None = None) -> Trees:
    """Trees fitted on at most `most` weakly labelled documents and calibrated on texts labelled by hand, `hand` or the holdout; no trees where the sample does not hold both kinds."""
    key = F.xxhash64(F.lit(5), F.col(id_col)).alias("__key")
    sample = df.filter(F.col(text).rlike(r"[^\s]")).select(key, F.col(text).alias("__text"))
    # Cut by hash before statistics are taken, so only about the sample's texts are measured; the smallest hashes of them count.
    n = max(df.count(), 1)
    share = min(1.0, 1.3 * most / n)
    sample = sample.filter(F.pmod("__key", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    s = with_statistics(sample, "__text").select("__key", *NAMES).orderBy(F.pmod("__key", F.lit(1 << 20)), "__key", *NAMES).limit(most).toPandas()
    y = weak_label(s)
    known = y >= 0
    x, y = s[list(READ)].to_numpy(dtype=float)[known], y[known]
    if not len(y) or y.min() == y.max():
        return Trees()
    t = boost(x, y)
    texts, labels = zip(*(hand or holdout()))
    calibrate(t, statistics(counts(list(texts)))[list(READ)].to_numpy(dtype=float), np.array(labels))
    return t


def score(df: DataFrame, text: str, trees: Trees, name: str = "prose") -> DataFrame:
    """df with its statistics and the probability of prose; NULL for texts without characters other than white space."""
    rows = _measured(df, text, trees)
    keep = [rows[c] for c in df.columns if c != name and c not in NAMES]
    return rows.select(*keep, *[F.col(f"__k.{n}").alias(n) for n in NAMES], F.nanvl(F.col("__k.prose"), F.lit(None)).alias(name))
