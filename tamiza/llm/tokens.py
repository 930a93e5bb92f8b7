"""Sizes in tokens of a public tokenizer.

The vocabulary file is a parameter; it is read on every executor and never
copied. Its ending says what it is: `.tiktoken` holds the ranks of a byte-level
vocabulary, anything else is a tokenizer's JSON. Special tokens in a text are
ordinary text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default vocabulary; the variable of the same use lets a cluster mount it elsewhere.
VOCABULARY = os.environ.get("TAMIZA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: how the byte-level vocabularies cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space beyond this many characters are cut out before the pattern, which backtracks through them, sees them.
_LONG_RUN = 10_000

_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def _ranked(path: str) -> Callable[[list[str]], list[int]]:
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding(os.path.basename(path), pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    one = tiktoken.Encoding(os.path.basename(path), pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    # All but the last sign of a run is a piece by itself where text follows; the last goes with that text.
    run = re.compile(rf"(\s{{{_LONG_RUN},}})(?=\s\S)|(\s{{{_LONG_RUN},}})\Z")

    def count(text: str) -> int:
        if len(text) <= _LONG_RUN:
            return len(encode(text))
        n, at = 0, 0
        for m in run.finditer(text):
            n += len(encode(text[at : m.start()])) + len(one(m[0]))
            at = m.end()
        return n + len(encode(text[at:]))

    return lambda texts: [count(t) for t in texts]


def _described(path: str) -> Callable[[list[str]], list[int]]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(e.ids) for at in range(0, len(texts), 256) for e in t.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of texts, by the vocabulary of a file."""
    if path not in _loaded:
        _loaded[path] = (_ranked if path.endswith(".tiktoken") else _described)(path)
    return _loaded[path]


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Number of tokens; 0 for NULL."""
    path = path or VOCABULARY

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = counter(path)
        for s in parts:
            yield pd.Series(of(s.fillna("").tolist()), dtype="int64")

    # Not deterministic to the optimizer: a filter on the size must not run the tokenizer a second time.
    return count.asNondeterministic()(text)
