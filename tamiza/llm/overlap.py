"""Same or near-same records across splits.

A text is the multiset of its words (case, accents and punctuation ignored); its
shingles are the words, each with the number of its occurrence, so exact Jaccard
similarity of shingle sets is that of the multisets. Two texts overlap if they
share at least `share` of the words of the longer one.

Texts of equal word multisets form one class; only classes are compared. Each
class gets BANDS minwise hashes of ROWS rows and a sketch of 192 one-bit minwise
hashes. What is shuffled of a class is BANDS rows of five numbers: the band's
key, the number of words and the sketch, which stands for the class. Classes of different sides that
agree in a band, and whose sketches do not differ by more than a pair at the
threshold would (three and a half standard deviations), are candidates; they meet their
shingles by the sketch (equal sketches of several classes just give several
candidates), and the exact similarity decides. At the lowest similarity that can
meet share 0.8 (Jaccard 2/3, both texts equally long) a pair is found with
probability 0.98, at Jaccard 0.72 with 0.999, at 0.8 with 1 - 1e-5.

Memory and skew: a band value shared by many classes is split by AQE's skew join;
copies cost nothing, since they are one class. Confirmed class pairs are expanded
to record pairs by joins on the class.

Defined cases: NULL, blank and texts under `min_words` words have no overlaps;
records of NULL or unknown split belong to no side; repeated rows of one id count
once; very long texts are whole; empty tables give empty results. Only named
columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiza.functions.lineage import written

BANDS, ROWS = 44, 6
SKETCH = 192
S = ("s0", "s1", "s2")
#: Shingles hashed at a time; what they take stays in the cache.
_PART = 512


_WORD = re.compile(r"[^\W_]+")
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")


@lru_cache(1 << 16)
def _bare(run: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", run) if unicodedata.category(c) != "Mn")


def shingles(text: str) -> list[str]:
    """Sorted words without case, accents and punctuation; repetitions carry their number."""
    own = text.lower()
    if not own.isascii():
        own = _BEYOND_ASCII.sub(lambda m: _bare(m[0]), own)
    out = sorted(_WORD.findall(own))
    last, k = None, 0
    for i, w in enumerate(out):
        k = k + 1 if w == last else 0
        last = w
        if k:
            out[i] = f"{w} {k}"
    return out


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    """What a word's code is XORed with and multiplied by, for each hash; the multipliers are odd."""
    a, b = np.random.default_rng(20240229).integers(0, 2**32, (2, BANDS * ROWS + SKETCH), dtype=np.uint32)
    return a, b | np.uint32(1)


class Minwise:
    """Minwise hashes (texts x seeds, uint32) of texts given as lists of shingles."""

    def __init__(self, start: int, end: int) -> None:
        (self.xor, self.times), self.known = (x[None, start:end] for x in _seeds()), {}

    def _codes(self, words: list[str]) -> list[int]:
        out = []
        for w in words:
            c = self.known.get(w)
            if c is None:
                if len(self.known) > 1_000_000:
                    self.known.clear()
                c = self.known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little")
            out.append(c)
        return out

    def of(self, texts: list[list[str]]) -> np.ndarray:
        out = np.full((len(texts), self.xor.size), 0xFFFFFFFF, dtype=np.uint32)
        codes, at, starts = [], [], []

        def flush() -> None:
            if codes:
                h = np.array(codes, dtype=np.uint32)[:, None] ^ self.xor
                h *= self.times
                low = np.minimum.reduceat(h, starts, axis=0)
                for k, i in enumerate(at):  # a long text comes in several parts
                    np.minimum(out[i], low[k], out=out[i])
                codes.clear(), at.clear(), starts.clear()

        for i, own in enumerate(texts):
            for lo in range(0, len(own), _PART):
                starts.append(len(codes))
                at.append(i)
                codes += self._codes(own[lo : lo + _PART])
                if len(codes) >= _PART:
                    flush()
        flush()
        return out


def _cut(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, side, cls, n, words, s0, s1, s2) of (id, side, text) with enough words; cls is the digest of the shingles, s0 to s2 are their sketch."""
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Minwise(BANDS * ROWS, BANDS * ROWS + SKETCH)
        for b in batches:
            own = [shingles(t) for t in b.column("text").to_pylist()]
            keep = [i for i, w in enumerate(own) if len(w) >= min_words]
            joined = ["\n".join(own[i]) for i in keep]
            first: dict[str, int] = {}
            of = [first.setdefault(j, len(first)) for j in joined]  # copies are hashed once
            sig = hashes.of([j.split("\n") for j in first])
            bits = np.packbits((sig >> 13) & 1, axis=1).view(np.int64)[of] if of else np.zeros((0, 3), dtype=np.int64)
            cls = [hashlib.blake2b(j.encode("utf-8", "surrogatepass"), digest_size=16).digest() for j in first]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), b.column("side").take(at), pa.array([cls[i] for i in of], pa.binary()), pa.array([len(own[i]) for i in keep], pa.int32()), pa.array(joined, pa.string()), *[pa.array(bits[:, k]) for k in range(3)]],
                names=["id", "side", "cls", "n", "words", *S],
            )

    return rows.mapInArrow(run, f"id {kind.simpleString()}, side int, cls binary, n int, words string, s0 long, s1 long, s2 long")


def _banded(classes: DataFrame) -> DataFrame:
    """(band, n, s0, s1, s2): one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Minwise(0, BANDS * ROWS)
        mix = np.random.default_rng(7).integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                p = b.slice(at, 1000)
                rows = hashes.of([w.split("\n") for w in p.column("words").to_pylist()]).reshape(p.num_rows, BANDS, ROWS)
                key = np.zeros((p.num_rows, BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    key += (rows[:, :, r].astype(np.uint64) + np.uint64(1)) * mix[r]
                key ^= key >> np.uint64(29)
                key = key * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64).ravel()), *[pa.array(np.repeat(p.column(c).to_numpy(), BANDS)) for c in ("n", *S)]], names=["band", "n", *S])

    return classes.select("words", "n", *S).mapInArrow(run, "band long, n int, s0 long, s1 long, s2 long")


def class_pairs(classes: DataFrame, share: float) -> DataFrame:
    """(a, b): class of the first side, class of the second, that overlap. classes: cls, side (1, 2 or 3 for both), n, words, s0, s1, s2."""
    name = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("n", *S)]
    ends = [f"{x}_{c}" for x in "ab" for c in S]
    left, right = (_banded(classes.filter(F.col("side").bitwiseAND(k) > 0)).select("band", *name(x)) for k, x in ((1, "a"), (2, "b")))
    differ = (1 - share / (2 - share)) / 2
    limit = int(SKETCH * differ + 3.5 * (SKETCH * differ * (1 - differ)) ** 0.5)
    apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in S), F.lit(0))
    longer = lambda n, m: F.lit(share) * F.greatest(n, m) - 1e-9
    lengths = F.least("a_n", "b_n") >= longer("a_n", "b_n")
    maybe = left.join(right, "band").filter(lengths & (apart <= limit)).select(*ends).distinct()
    of = lambda x, k: classes.filter(F.col("side").bitwiseAND(k) > 0).select(F.col("cls").alias(x), F.col("words").alias(f"w{x}"), *name(x))
    maybe = maybe.join(of("a", 1), [f"a_{c}" for c in S]).join(of("b", 2), [f"b_{c}" for c in S])
    # Shingles are distinct within a text: what two sets share is what the texts share, repetitions counted.
    shared = F.size(F.array_intersect(F.split("wa", "\n"), F.split("wb", "\n")))
    return maybe.filter((F.col("a") != F.col("b")) & lengths).filter(shared >= longer("a_n", "b_n")).select("a", "b")


def overlaps(df: DataFrame, id_col: str, text: str, split: str, first: tuple[str, ...] = ("train",), second: tuple[str, ...] = ("valid", "test"), share: float = 0.8, min_words: int = 4) -> tuple[DataFrame, DataFrame]:
    """(members, links): (cls, id, side) of every class in a link, and (a, b) linked classes; a holds `first` records, b `second` ones, a = b for a class on both sides."""
    side = F.when(F.col(split).isin(*first), 1).when(F.col(split).isin(*second), 2)
    rows = df.select(F.col(id_col).alias("id"), side.alias("side"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & F.col("side").isNotNull() & F.col("text").isNotNull())
    # Words are cut out of the texts once: the classes and both sides' members are read from here.
    rows = written(_cut(rows, min_words))
    # Read four times below: for the bands of either side and for the words of either end of a candidate.
    one = lambda c: F.first(c).alias(c)
    classes = written(rows.groupBy("cls").agg(F.bit_or("side").alias("side"), *map(one, ("n", "words", *S))))
    links = class_pairs(classes, share).unionByName(classes.filter("side = 3").select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    return rows.select("cls", "id", "side"), links


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(rec_a, rec_b): record pairs of all links, the smaller id first."""
    one = members.filter("side = 1").select(F.col("cls").alias("a"), F.col("id").alias("x"))
    two = members.filter("side = 2").select(F.col("cls").alias("b"), F.col("id").alias("y"))
    return links.join(one, "a").join(two, "b").select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cls, side, n_links): every record of a linked class with the number of records it overlaps on the other side; no pair is expanded."""
    size = members.distinct().groupBy("cls", "side").agg(F.count("*").alias("n"))
    of = lambda me, other, side: links.join(size.filter(F.col("side") == side).select(F.col("cls").alias(other), "n"), other).groupBy(F.col(me).alias("cls")).agg(F.sum("n").alias("n_links")).withColumn("side", F.lit(3 - side))
    return members.distinct().join(of("a", "b", 2).unionByName(of("b", "a", 1)), ["cls", "side"]).select("id", "cls", "side", "n_links")
