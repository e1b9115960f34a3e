"""Token counts with a public tokenizer; its vocabulary file is a parameter and stays outside the repository."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of this byte-level vocabulary (a fixed value).
DEFAULT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts from this length on are counted in stretches of at least ``STRETCH`` characters.
LONG, STRETCH = 1_000_000, 100_000
# after a character that is no white space, before a single blank or line break and a letter: no match of the pattern goes over it
SEAM = re.compile(r"(?<=\S)(?=[ \n][^\W\d_])")


def stretches(text: str, least: int = STRETCH) -> Iterator[str]:
    """The text in parts that have its tokens; what has no seam stays whole."""
    at = 0
    while seam := SEAM.search(text, at + least):
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


def count_tokens(df: DataFrame, text_col: str, keep: dict[str, str], vocabulary: str = DEFAULT_VOCABULARY, pattern: str = DEFAULT_PATTERN) -> DataFrame:
    """The columns ``keep`` (name -> type, taken as they are) and ``n_tokens`` of the whole text; rows without text are left out.

    The vocabulary (a file of about a megabyte) is read on the driver and sent to the executors, which need no copy of their own.
    """
    with open(vocabulary, "rb") as f:
        words = df.sparkSession.sparkContext.broadcast(f.read())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, words.value.splitlines())}
        enc = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in parts:
            counts = [sum(len(enc.encode_ordinary(p)) for p in (stretches(text) if len(text) >= LONG else [text])) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int32())], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{k}` {v}" for k, v in keep.items()) + ", n_tokens int"
    src = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), *(F.col(k).cast(v).alias(k) for k, v in keep.items()))
    return src.mapInArrow(run, schema)
