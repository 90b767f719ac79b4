"""Token counts of whole texts with a public tokenizer.

The vocabulary file's path is a parameter; the file stays where it is and is
opened once per Python worker. A NULL text has 0 tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the public byte-level vocabularies split a text before pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in pieces cut before a blank, which no token crosses.
PIECE = 100_000


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of one whole text."""
    if not text:
        return 0
    enc, total, at = encoding(path), 0, 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            gap = text.rfind(" ", at + 1, end)
            # a lone blank opens the next token, so the cut changes no count
            while gap > at and (text[gap - 1].isspace() or text[gap + 1 : gap + 2].isspace()):
                gap = text.rfind(" ", at + 1, gap)
            end = gap if gap > at else len(text)
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def token_counts(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, path: str = TOKENIZER) -> DataFrame:
    """(id_col, keep..., tokens long) of every document."""
    keep = keep or []
    cols = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(t, path) for t in b.column(len(cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(cols))], pa.array(n, pa.int64())], [*cols, "tokens"])

    return docs.select(*[F.col(c) for c in cols], F.col(text_col).alias("_text")).mapInArrow(run, f"{kinds}, tokens long")
