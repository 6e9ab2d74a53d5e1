"""Sizes of texts in tokens of a public byte-level tokenizer, whose file's path is a parameter."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file of base64 tokens and ranks.
RANKS = os.environ.get("PLUMBLINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern by which this public vocabulary cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Characters after which a longer text is cut, at the next place where the pattern cuts it in any case.
STRETCH = 100_000
#: Between two letters one space begins a new piece whatever surrounds it.
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")

_encoders: dict[str, object] = {}


def encoder(ranks: str = RANKS):
    """The tokenizer, made once per process."""
    if ranks not in _encoders:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks] = tiktoken.Encoding("plumbline", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[ranks]


def count(text: str, ranks: str = RANKS) -> int:
    """Tokens of a whole text; cutting a long one changes nothing."""
    e, n, at = encoder(ranks), 0, 0
    while len(text) - at > STRETCH and (m := _CUT.search(text, at + STRETCH)):
        n += len(e.encode_ordinary(text[at : m.start()]))
        at = m.start()
    return n + len(e.encode_ordinary(text[at:]))


def with_tokens(df: DataFrame, text_col: str, keep: list[str], ranks: str = RANKS) -> DataFrame:
    """The columns keep of df and tokens (long), 0 for a null text; the text itself goes no further."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [count(t, ranks) if isinstance(t, str) else 0 for t in b["__text"]]
            yield b.drop(columns="__text").assign(tokens=n)

    rows = df.select(*keep, F.col(text_col).alias("__text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", tokens long"
    return rows.mapInPandas(run, types)
