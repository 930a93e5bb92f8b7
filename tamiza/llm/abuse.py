"""Abusive, hateful or sexual content.

A linear classifier over character n-grams, features scaled by naive Bayes
log-count ratios (NB-SVM with logistic loss). It is fitted on sentences: of a
labelled text it is unknown which sentence made the label, so after each round
only the windows that the model itself finds worst stand for their text, and
texts whose label the model contradicts strongly count as wrongly labelled.
A text's score is that of its worst sentence.

Before n-grams are taken, disguises are undone the same way in training and
scoring: look-alike and full-width letters, accents, zero-width characters,
digits and signs for letters, letters set apart, drawn-out letters.

The labels used for fitting are bounded by `most` (hash-ordered, so any size gives
the same kind of sample) and `longest`; all texts are scored, whole.

Defined cases: NULL, blank and empty texts score 0; repeated texts score alike;
very long texts are scored sentence by sentence, long sentences by overlapping
windows; without labelled texts of both kinds every score is 0; an empty table
gives an empty result. Input columns stay; those named like the results are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiza.llm import lookalike

BITS = 18
ORDERS = (2, 3, 4, 5)
KINDS = ("abusive", "hateful", "sexual")
#: Windows of sentences longer than this many characters.
WINDOW, STEP = 72, 24
_SIGNS = str.maketrans({"4": "a", "3": "e", "1": "i", "0": "o", "5": "s", "7": "t", "@": "a", "$": "s"})
_MIXED = re.compile(r"(?=\S*[a-z])(?=\S*[0-9@$])[a-z0-9@$*]+")
#: What stands between blanks and holds a digit or sign; only there _MIXED can match.
_CHUNK = re.compile(r"(?<!\S)(?=\S*[0-9@$])\S+")
_APART = re.compile(r"(?<![a-z0-9@$])(?:[a-z0-9@$*](?:[.\-_·*]|\s)\s?){3,}[a-z0-9@$*](?![a-z0-9@$])")
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")
_BETWEEN = re.compile(r"[.\-_·\s]")
_DIGITS, _DRAWN, _OTHER = re.compile(r"[0-9]+"), re.compile(r"([a-z])\1+"), re.compile(r"[^a-z0*]+")
_ENDS = re.compile(r"[.!?¡¿…;:\n\r]+")
_INVISIBLE = dict.fromkeys(map(ord, "\xad᠎​‌‍‎‏‪‫‬‭‮⁠﻿"))
_LETTERS = {ord(a): b for a, b in {**lookalike.ALIKE, **lookalike.ALIKE_INSIDE}.items()} | _INVISIBLE


@lru_cache(1 << 16)
def _folded(run: str) -> str:
    """A run of characters beyond ASCII without look-alikes and marks."""
    run = unicodedata.normalize("NFKD", run.translate(_LETTERS)).translate(_LETTERS)
    return "".join(c for c in run if not unicodedata.combining(c))


def plain(text: str) -> str:
    """Lower case letters without accents and disguises."""
    if not text.isascii():
        text = _BEYOND_ASCII.sub(lambda m: _folded(m[0]), text)
    text = text.lower()
    text = _APART.sub(lambda m: _BETWEEN.sub("", m[0]), text)
    text = _CHUNK.sub(lambda c: _MIXED.sub(lambda m: m[0].translate(_SIGNS), c[0]), text)
    text = _DIGITS.sub("0", text)
    return _DRAWN.sub(r"\1", text)


def sentences(text: str) -> list[str]:
    out = []
    for s in _ENDS.split(plain(text)):
        s = _OTHER.sub(" ", s).strip()
        if s:
            out.append(f" {s} ")
    return out


def spans(n: int) -> list[tuple[int, int]]:
    """Windows of a sentence of n characters; the last ends with it."""
    if n <= WINDOW:
        return [(0, n)]
    return [(a, a + WINDOW) for a in range(0, n - WINDOW, STEP)] + [(n - WINDOW, n)]


def n_grams(n: np.ndarray) -> np.ndarray:
    return sum(np.maximum(n - k + 1, 0) for k in ORDERS)


def length(n: np.ndarray) -> np.ndarray:
    """What a window's sum is divided by; very short windows say little."""
    return np.sqrt(np.maximum(n, 80))


def _hashed(own: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: positions in the joined text where an n-gram starts, and its hash."""
    lens = np.array([len(s) for s in own], dtype=np.int64)
    codes = np.frombuffer("".join(own).encode("latin-1"), dtype=np.uint8).astype(np.uint64)
    n = len(codes)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(n)  # characters left in the sentence
    h = np.zeros(n, dtype=np.uint64)
    for k in range(1, min(max(ORDERS), n) + 1):
        h[: n - k + 1] = h[: n - k + 1] * np.uint64(0x100000001B3) + codes[k - 1 :] + np.uint64(1)
        if k in ORDERS:
            ok = np.nonzero(left >= k)[0]
            x = h[ok] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            x ^= x >> np.uint64(31)
            yield ok, ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)


def position_sums(own: list[str], weights: np.ndarray) -> np.ndarray:
    """For each position of the joined sentences the weights of the n-grams that start there."""
    out = np.zeros(sum(map(len, own)))
    for at, x in _hashed(own):
        out[at] += weights[x]
    return out


def features(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all sentences in one array, and where each sentence starts."""
    parts = []
    for lo in range(0, len(own), 4000):  # by parts, since hashes of all orders and their places are held at once
        at, idx = (np.concatenate(x) for x in zip(*_hashed(own[lo : lo + 4000])))
        parts.append(idx[np.argsort(at, kind="stable")])
    counts = n_grams(np.array([len(s) for s in own], dtype=np.int64))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)[:-1]])


@dataclass
class Linear:
    weights: np.ndarray
    bias: float


def fit_linear(idx: np.ndarray, start: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 8, l2: float = 1e-4, seed: int = 1) -> Linear:
    """Logistic loss over features scaled by naive Bayes log-count ratios; AdaGrad."""
    dim, end = 1 << BITS, np.append(start[1:], len(idx))
    row = np.repeat(np.arange(len(start), dtype=np.int32), end - start)
    pos = np.bincount(idx[(y == 1)[row]], minlength=dim) + 1.0
    neg = np.bincount(idx[(y == 0)[row]], minlength=dim) + 1.0
    ratio = np.log((pos / pos.sum()) / (neg / neg.sum())).astype(np.float64)
    seen = (pos + neg) > 3  # n-grams of one sentence only tell nothing about others
    ratio[~seen] = 0.0
    # What has no ratio has no effect: only the other n-grams are walked through, numbered anew.
    use = np.flatnonzero(ratio)
    number = np.full(dim, -1, dtype=np.int32)
    number[use] = np.arange(len(use), dtype=np.int32)
    known = ratio[idx] != 0
    x_all, row = number[idx[known]], row[known]
    del known
    scale_all = ratio[use][x_all]
    scale_all /= length(end - start)[row]
    counts = np.bincount(row, minlength=len(start))
    del row
    first = np.cumsum(counts) - counts
    w, b = np.zeros(len(use)), 0.0
    gw, gb = np.full(len(use), 1e-6), 1e-6
    touched = np.zeros(len(use), dtype=bool)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(start))
        for lo in range(0, len(order), 256):
            pick = order[lo : lo + 256]
            n = counts[pick]
            own = np.repeat(np.arange(len(pick)), n)
            at = np.arange(len(own)) + (first[pick] - np.cumsum(n) + n)[own]
            x, scale = x_all[at], scale_all[at]
            z = np.bincount(own, w[x] * scale, minlength=len(pick)) + b
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick]
            touched[x] = True
            u = np.flatnonzero(touched)
            touched[u] = False
            d = np.bincount(x, g[own] * scale, minlength=len(use))[u] / len(pick) + l2 * w[u]
            gw[u] += d * d
            w[u] -= 0.5 * d / np.sqrt(gw[u])
            db = g.mean()
            gb += db * db
            b -= 0.5 * db / np.sqrt(gb)
    out = np.zeros(dim, dtype=np.float32)
    out[use] = w * ratio[use]
    return Linear(out, float(b))


def scaled_logits(model: Linear, idx: np.ndarray, start: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0)
    n = np.diff(np.append(start, len(idx)))
    return np.add.reduceat(model.weights[idx].astype(np.float64), start) / length(n) + model.bias


@dataclass
class Model:
    any: Linear | None = None
    kinds: dict[str, Linear] = field(default_factory=dict)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        """Probability of the worst window of each text, and its kind."""
        p, kind = np.zeros(len(texts)), [None] * len(texts)
        own, of, lo, hi, base = [], [], [], [], 0
        for i, t in enumerate(texts):
            for s in sentences(t) if t else ():
                for a, b in spans(len(s)):
                    lo.append(base + a)
                    hi.append(base + b)
                    of.append(i)
                own.append(s)
                base += len(s)
        if self.any is None or not own:
            return p, kind
        total = np.concatenate([[0.0], np.cumsum(position_sums(own, self.any.weights))])
        lo_, hi_, of_ = np.array(lo), np.array(hi), np.array(of)
        z = (total[hi_] - total[lo_]) / length(n_grams(hi_ - lo_)) + self.any.bias
        p_s = 1 / (1 + np.exp(-z))
        np.maximum.at(p, of_, p_s)
        worst = np.nonzero(p_s >= np.maximum(p[of_], 0.3))[0]
        if len(worst) and self.kinds:
            names, joined = list(self.kinds), "".join(own)
            i2, s2 = features([joined[lo[j] : hi[j]] for j in worst])
            best = np.argmax(np.stack([scaled_logits(m, i2, s2) for m in self.kinds.values()]), axis=0)
            for j, k in zip(worst, best):
                kind[of[j]] = names[k]
        return p, kind


def fit(texts: list[str], labels: list[str], rounds: int = 4) -> Model:
    """labels: none or a kind, one per text."""
    own, of = [], []
    for i, t in enumerate(texts):
        s = [x[a:b] for x in sentences(t) for a, b in spans(len(x))]
        own += s
        of += [i] * len(s)
    bad = np.array([x != "none" for x in labels])
    if not own or not bad.any() or bad.all():
        return Model()
    of_ = np.array(of)
    idx, start = features(own)
    y = bad[of_].astype(np.int64)
    weight = np.ones(len(own))
    share = np.bincount(of_, minlength=len(texts)).astype(float)
    weight[y == 1] = 1 / share[of_[y == 1]]
    model = fit_linear(idx, start, y, weight, epochs=5)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-scaled_logits(model, idx, start)))
        top = np.zeros(len(texts))
        np.maximum.at(top, of_, p)
        # The worst sentences of a bad text stand for it; its others say nothing either way.
        stands = bad[of_] & (p >= np.maximum(top[of_] * 0.98, 0.0))
        wrong = (bad & (top < 0.15)) | (~bad & (top > 0.85)) if r else np.zeros(len(texts), dtype=bool)
        weight = np.where(wrong[of_], 0.0, np.where(bad[of_], np.where(stands, 2.0, 0.0), 1.0))
        use = weight > 0
        keep = np.nonzero(use)[0]
        end = np.append(start[1:], len(idx))
        sub = np.concatenate([idx[start[i] : end[i]] for i in keep])
        lens = (end - start)[keep]
        model = fit_linear(sub, np.concatenate([[0], np.cumsum(lens)[:-1]]), y[keep], weight[keep], epochs=6 + 3 * (r == rounds - 1))
    p = 1 / (1 + np.exp(-scaled_logits(model, idx, start)))
    kinds = {}
    good = np.nonzero((y == 1) & (p > 0.5))[0]
    if len(good):
        gi, gs = features([own[j] for j in good])
        lab = np.array([labels[of[j]] for j in good])
        for k in KINDS:
            if (lab == k).any() and (lab != k).any():
                kinds[k] = fit_linear(gi, gs, (lab == k).astype(np.int64), np.ones(len(good)), epochs=5)
    return Model(model, kinds)


def labelled(labels: DataFrame, texts: DataFrame, most: int = 12_000, longest: int = 20_000) -> tuple[list[str], list[str]]:
    """At most `most` labelled texts of at most `longest` characters, one label each; texts whose annotators disagree are left out. Both bounds together bound what the driver holds."""
    one = labels.filter(F.col("label").isNotNull() & F.col("id_review").isNotNull()).groupBy("tbl", "id_review").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    one = one.filter("label = other").orderBy(F.xxhash64("tbl", "id_review"), "tbl", "id_review").limit(most).select("tbl", "id_review", "label")
    rows = texts.join(F.broadcast(one), ["tbl", "id_review"]).filter(F.length("text") <= longest)  # at most `most` rows are broadcast
    got = rows.groupBy("tbl", "id_review").agg(F.first("text").alias("text"), F.first("label").alias("label")).orderBy("tbl", "id_review").select("text", "label").toPandas()
    return got["text"].tolist(), got["label"].tolist()


def score(df: DataFrame, text: str, model: Model, name: str = "abuse_score", kind: str = "abuse_kind") -> DataFrame:
    """df with the score of every text (0 to 1) and the kind of its worst sentence where that scores 0.3 or more."""

    @F.pandas_udf("p double, kind string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            ps, ks = [], []
            own = s.tolist()
            for at in range(0, len(own), 1000):
                p, k = model.score(own[at : at + 1000])
                ps.append(p)
                ks += k
            yield pd.DataFrame({"p": np.concatenate(ps) if ps else [], "kind": pd.Series(ks, dtype=object)})

    # Not deterministic to the optimizer: a filter on the score must not run the model a second time.
    run = run.asNondeterministic()
    rows = df.select("*", run(df[text]).alias("__s"))
    return rows.select(*[rows[c] for c in df.columns if c not in (name, kind)], F.col("__s.p").alias(name), F.col("__s.kind").alias(kind))
