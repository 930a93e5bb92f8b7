"""Garbled text from wrong character encoding.

1. Adjacent character pairs of the whole corpus are counted, and every pair gets
   its pointwise mutual information. Rare characters count with a floor
   probability, otherwise a garbled sequence that occurs often would pass for a
   close pair.
2. In each text the maximum-scoring segments of (OFFSET - PMI) are its improbable runs.
3. Only inside those runs the inverse mappings are tried: bytes of a single-byte
   code page read as UTF-8 (once or twice), or as another single-byte code page
   where that turns the run into probable Spanish.

Defined cases: NULL gives no finding and a NULL restored text; empty and blank
texts come back unchanged; U+FFFD is a finding, and the text keeps it, since the
original byte is lost; repeated rows are judged alike; an empty table gives no
statistics and no findings except those of UTF-8 read wrongly. Input columns
stay, whatever their names; a column named like one of the two results is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character classes: code points below 0x250 stand for themselves, the rest by blocks. This bounds the pair table at CLASSES squared rows.
CLASSES = 1024
#: Rare characters count as if they had this share.
FLOOR = 1 / 40
#: A pair scores OFFSET - PMI: pairs below this many bits speak for an improbable run.
OFFSET = -1.0
#: A segment ends when its score falls this far below its best.
DROP = 6.0
#: Bits by which a single-byte mapping must raise the mean PMI of a run, and the mean it must reach.
GAIN, REACH = 3.0, -3.0

#: Characters that make a text worth looking at: all but ASCII and the Spanish letters, and capitals behind small letters.
CANDIDATE = r"[^\x00-\x7FáéíóúüñÁÉÍÓÚÜÑ]|[a-záéíóúüñ][ÁÉÍÓÚÜÑ]"

#: Code pages text is wrongly read in. The order decides between readings that agree.
PAGES = ("cp1252", "latin-1", "cp1251", "cp850", "cp437", "mac_roman", "iso8859_15", "cp1250")
SINGLE = ("cp1252", "cp850", "cp437", "mac_roman", "latin-1")
_SPANISH = frozenset("áéíóúüñÁÉÍÓÚÜÑ")
_TYPOGRAPHIC = frozenset("‘’“”–—…")
_SIGNS = _TYPOGRAPHIC | frozenset("¡¿«»°")
_OPENING, _CLOSING = frozenset("¡¿«“‘"), frozenset("»”’…")
_MISSING = "�"


def classes() -> np.ndarray:
    cp = np.arange(0x110000, dtype=np.int64)
    out = np.where(cp < 0x250, cp, np.where(cp < 0x3000, 0x250 + (cp - 0x250) // 32, 960 + np.minimum((cp - 0x3000) >> 14, 63)))
    out[[9, 10, 11, 12, 13]] = 32
    return out.astype(np.int32)


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of all texts, each between spaces."""
    return np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)


def pair_counts(df: DataFrame, *texts: Column) -> DataFrame:
    """(pair, n): adjacent character pairs of all texts; counted per partition, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = classes()
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for b in batches:
            own = [x for x in b.column(0).to_pylist() if x]
            for at in range(0, len(own), 4000):
                c = cls[_codes(own[at : at + 4000])]
                pairs = c[:-1] * CLASSES + c[1:]
                for lo in range(0, len(pairs), 1 << 20):
                    p, n = np.unique(pairs[lo : lo + (1 << 20)], return_counts=True) if len(pairs) < 4096 else (None, None)
                    if p is None:
                        total += np.bincount(pairs[lo : lo + (1 << 20)], minlength=CLASSES * CLASSES)
                    else:
                        total[p] += n
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    one = df.select(F.explode(F.array(*texts)).alias("__text")) if len(texts) > 1 else df.select(texts[0].alias("__text"))
    return one.filter(F.col("__text").isNotNull()).mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def mutual_information(pairs: DataFrame) -> np.ndarray:
    """PMI in bits of every class pair; the table has at most CLASSES squared rows, whatever the corpus."""
    rows = pairs.toPandas()
    n = np.zeros(CLASSES * CLASSES)
    n[rows["pair"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.float64)
    n = n.reshape(CLASSES, CLASSES)
    total = max(n.sum(), 1.0)
    a, b = (np.maximum(n.sum(axis) / total, FLOOR) for axis in (1, 0))
    return np.log2((n + 0.05) / (total + 0.05 * CLASSES) / (a[:, None] * b[None, :])).astype(np.float32)


def segments(scores: list[float], drop: float = DROP) -> list[tuple[int, int]]:
    """Maximum-scoring segments [from, to) of a score sequence, from left to right."""
    out, total, best, start, end = [], 0.0, 0.0, 0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, best, start = 0.0, 0.0, i
        total += s
        if total > best:
            best, end = total, i + 1
        elif best > 0 and (total <= 0 or total < best - drop):
            out.append((start, end))
            total = best = 0.0
    if best > 0:
        out.append((start, end))
    return out


class Repairer:
    """Repairs single texts with a given PMI table."""

    def __init__(self, pmi: np.ndarray) -> None:
        self.pmi, self.cls = pmi, classes()
        self.bytes_of: dict[str, dict[str, int]] = {}
        self.char_of: dict[str, dict[int, str]] = {}
        for page in {*PAGES, *SINGLE}:
            to = {}
            for b in range(0x80, 0x100):
                try:
                    to[b] = bytes([b]).decode(page)
                except UnicodeDecodeError:
                    to[b] = chr(b)
            self.char_of[page] = to
            self.bytes_of[page] = {c: b for b, c in to.items()}

    def _pmi(self, text: str) -> np.ndarray:
        c = self.cls[_codes([text])]
        return self.pmi[c[:-1], c[1:]]

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Improbable runs as character ranges of the text."""
        n = len(text)
        return [(max(a - 1, 0), min(b, n)) for a, b in segments((OFFSET - self._pmi(text)).tolist())]

    @staticmethod
    def _plausible(c: str) -> bool:
        """What a text may hold, or what may be read once more (control characters of the upper half)."""
        o = ord(c)
        return 0x80 <= o <= 0x17F or 0x2010 <= o <= 0x2044 or o in (0x20AC, 0x2122, 0x200D, 0xFE0F, 0xFEFF) or 0x2190 <= o <= 0x27BF or 0x1F000 <= o <= 0x1FAFF

    def _utf8(self, group: str) -> str:
        """A group of non-ASCII characters with every UTF-8 sequence in it read again; the page that explains most characters wins."""
        best, most = group, 0
        for page in PAGES:
            b = self.bytes_of[page]
            out, i, done = [], 0, 0
            while i < len(group):
                lead = b.get(group[i], 0)
                k = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
                if k and i + k <= len(group):
                    try:
                        c = bytes([b.get(x, 0) for x in group[i : i + k]]).decode("utf-8")
                        if self._plausible(c):
                            out.append(c)
                            i += k
                            done += k
                            continue
                    except UnicodeDecodeError:
                        pass
                out.append(group[i])
                i += 1
            if done > most:
                best, most = "".join(out), done
        return best

    def _reread(self, text: str, runs: list[tuple[int, int]]) -> str:
        """UTF-8 read as a code page: groups of non-ASCII characters that touch a run."""
        out, i, r = [], 0, 0
        while i < len(text):
            if text[i] < "\x80":
                out.append(text[i])
                i += 1
                continue
            j = i
            while j < len(text) and text[j] >= "\x80":
                j += 1
            while r < len(runs) and runs[r][1] < i:
                r += 1
            touches = r < len(runs) and runs[r][0] <= j
            out.append(self._utf8(text[i:j]) if touches and j - i > 1 else text[i:j])
            i = j
        return "".join(out)

    @staticmethod
    def _fits(text: str, i: int, sign: str) -> bool:
        """Whether a sign stands where such a sign would: opening ones before a word, closing ones behind, degrees behind a number."""
        before, after = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
        if sign in _OPENING:
            return not before.isalnum() and (after.isalnum() or after >= "\x80")
        if sign in _CLOSING:
            return before != "" and not before.isspace() and not after.isalnum()
        if sign == "°":
            return before.isdigit() or text[max(i - 2, 0) : i - 1].isdigit()
        return before.isspace() and after.isspace()

    def _swap(self, text: str, runs: list[tuple[int, int]]) -> str:
        """A code page read as another: the pair of pages that makes the runs most probable."""
        at = sorted({i for a, b in runs for i in range(a, b) if text[i] >= "\x80"})
        if all(text[i] in _TYPOGRAPHIC for i in at):
            return text
        before = self._pmi(text)
        best, most = text, 0.0
        for wrong in SINGLE:
            for right in SINGLE:
                if wrong == right:
                    continue
                new, hits = list(text), []
                for i in at:
                    b = self.bytes_of[wrong].get(text[i])
                    c = self.char_of[right].get(b) if b is not None else None
                    if c in _SPANISH and (text[i] not in _SPANISH or c.islower() != text[i].islower()):
                        new[i] = c
                        hits.append(i)
                if not hits:
                    continue
                after = self._pmi("".join(new))
                small = self._pmi("".join(new).lower()) - 1.0 if len("".join(new).lower()) == len(text) else after
                gain, strong, kept, better = 0.0, False, [], []
                for i in hits:
                    x, y = before[i : i + 2].mean(), after[i : i + 2].mean()
                    if new[i].isupper():  # capitals are rarer: small letters tell as much
                        y = max(y, small[i : i + 2].mean())
                    letters = [t for t in (text[i - 1 : i] if i else "", text[i + 1 : i + 2]) if t.isalpha() and (t < "\x80" or t in _SPANISH)]
                    if not any(t.islower() == new[i].islower() for t in letters):
                        continue
                    if y > x:
                        better.append(i)
                    if y - x >= GAIN and y >= REACH and text[i] not in _TYPOGRAPHIC:
                        kept.append(i)
                        gain += y - x
                        strong = strong or text[i] != "\xa0"
                if strong and gain > most:
                    # The pages are settled: all letters they make more probable follow, and signs that carry no letters, in the runs.
                    fixed = list(text)
                    for i in at:
                        c = self.char_of[right].get(self.bytes_of[wrong].get(text[i], 0), "")
                        if i in kept or i in better and text[i] not in _SPANISH or c in _SIGNS and text[i] not in _SPANISH and text[i] not in _SIGNS and self._fits(text, i, c):
                            fixed[i] = c
                    best, most = "".join(fixed), gain
        return best

    def repair(self, text: str) -> tuple[bool, str]:
        """(garbled, restored text)."""
        now = text
        for _ in range(3):
            runs = self.runs(now)
            if not runs:
                break
            new = self._reread(now, runs)
            if new == now:
                new = self._swap(now, runs)
            if new == now:
                break
            now = new
        return now != text or _MISSING in text, now


def repair(df: DataFrame, text: str, pmi: np.ndarray, garbled: str = "garbled", restored: str = "restored") -> DataFrame:
    """df with a flag for garbled texts and the restored texts. Texts of plain Spanish letters don't leave the JVM."""

    @F.pandas_udf("garbled boolean, restored string")
    def fix(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        r = Repairer(pmi)
        for s in parts:
            got = [(None, None) if x is None else r.repair(x) for x in s]
            yield pd.DataFrame(got, columns=["garbled", "restored"]).astype(object)

    # Not deterministic to the optimizer: a filter on the result must not run it a second time.
    fix = fix.asNondeterministic()
    x = df[text]
    rows = df.select("*", fix(F.when(x.rlike(CANDIDATE), x)).alias("__fix"), x.alias("__was"))
    keep = [rows[c] for c in df.columns if c not in (garbled, restored)]
    return rows.select(*keep, F.coalesce(rows["__fix.garbled"], F.lit(False)).alias(garbled), F.coalesce(rows["__fix.restored"], rows["__was"]).alias(restored))


#: Letters a lost byte may have been, and how clearly one word must lead.
LOST_LETTERS = [*"áéíóúñü"]
LEAD = 0.8


def restore_lost(df: DataFrame, text: str, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """df with lost characters (U+FFFD) restored in words where the corpus leaves one choice.

    A word with one or two lost letters takes the counted word that fits it, if that
    makes up LEAD of all that fit. corpus: (token, n) in lower case. keys tell the rows
    apart. Other words stay as they are; so do NULL texts.
    """
    word = r"[\p{L}�]+"
    lost = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(word), F.lit(0))), lambda w: w.contains(_MISSING) & w.rlike(r"\p{L}"))
    own = df.select(*keys, F.explode(lost).alias("__w"))
    letters = F.array(*map(F.lit, LOST_LETTERS))
    n = F.length("__w") - F.length(F.replace("__w", F.lit(_MISSING), F.lit("")))
    first = lambda x, c: F.concat(F.substring_index(x, _MISSING, 1), c, F.substr(x, F.length(F.substring_index(x, _MISSING, 1)) + 2))
    words = own.select("__w").distinct().withColumn("__n", n).filter("__n <= 2").select("__w", "__n", F.explode(letters).alias("__c"))
    words = words.withColumn("token", first(F.col("__w"), F.col("__c")))
    two = words.filter("__n = 2").select("__w", "token", F.explode(letters).alias("__c")).select("__w", first(F.col("token"), F.col("__c")).alias("token"))
    fits = words.filter("__n = 1").select("__w", "token").unionByName(two).join(corpus, "token")
    best = fits.groupBy("__w").agg(F.max_by("token", "n").alias("__to"), (F.max("n") / F.sum("n")).alias("__share")).filter(F.col("__share") >= LEAD).select("__w", "__to")
    found = own.join(best, "__w").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__w", "__to"))).alias("__m"))

    def fix(p: Column) -> Column:
        to = F.try_element_at(F.col("__m"), F.lower(p))
        known = F.replace(p, F.lit(_MISSING), F.lit(""))
        cased = F.when((known == F.upper(known)) & (F.length(known) > 1), F.upper(to)).when(F.substring(p, 1, 1).rlike(r"\p{Lu}"), F.concat(F.upper(F.substring(to, 1, 1)), F.substring(to, 2, 1 << 30))).otherwise(to)
        return F.coalesce(cased, p)

    parts = F.regexp_extract_all(F.col(text), F.lit(rf"{word}|[^\p{{L}}�]+"), F.lit(0))
    rows = df.join(found, keys, "left")
    return rows.withColumn(text, F.when(F.col("__m").isNull(), F.col(text)).otherwise(F.array_join(F.transform(parts, fix), ""))).select(*df.columns)
