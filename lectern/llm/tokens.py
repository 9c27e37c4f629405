"""Token counts by a public byte-level BPE vocabulary. The vocabulary's path is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.runtime import arrow_map, spread, table

VOCABULARY = os.environ.get("LECTERN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are encoded in stretches of about this many characters, so that no text is too long for the encoder.
STRETCH = 200_000
# Places where one match of the split pattern ends and another begins whatever stands around: a cut there changes no token.
_SEAM = regex.compile(r"(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY):
    """One encoder per worker process and vocabulary."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, size: int = STRETCH) -> list[str]:
    """The text in stretches of about ``size`` characters that have the tokens of the whole. Only a run of more letters, digits, blanks or signs than that is cut within."""
    out, a = [], 0
    while len(text) - a > size:
        seam, back = None, 1024
        while seam is None:  # the last seam, looked for further and further back
            lo = max(a + 1, a + size - back)
            for seam in _SEAM.finditer(text, lo, a + size):
                pass
            if lo == a + 1:
                break
            back *= 4
        b = seam.start() if seam else a + size
        out.append(text[a:b])
        a = b
    return [*out, text[a:]]


def count(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a text; none for null."""
    if not text:
        return 0
    e = encoder(path)
    return sum(len(e.encode_ordinary(s)) for s in stretches(text))


def offsets(text: str, path: str = VOCABULARY) -> np.ndarray:
    """Character offset of each token's start, and the text's length at the end; tokens inside a character share its offset."""
    e = encoder(path)
    sizes = [len(b) for s in stretches(text) for b in e.decode_tokens_bytes(e.encode_ordinary(s))]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    starts = np.concatenate(([0], np.cumsum(width)))
    return np.searchsorted(starts, ends, side="left")


def counted(docs: DataFrame, keys: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The key columns and ``tokens``."""
    src = spread(docs.select(*keys, F.col(text).alias("__text")))
    schema = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys) + ", tokens bigint"

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = [count(t, path) for t in b.column(len(keys)).to_pylist()]
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(n, pa.int64())], names=[*keys, "tokens"])

    return arrow_map(src, run, schema)


def limit(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    """(capacity, overlap) of a row of the fixed table size_limits."""
    r = table(spark, sf_dir, "size_limits").where(F.col("limit_name") == name).select("capacity_tokens", "overlap_tokens").first()
    return int(r[0]), int(r[1] or 0)
