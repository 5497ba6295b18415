"""Byte-level BPE with the tiktoken library and a local rank file.

A long text is cut at boundaries that the pre-splitting pattern always has, so segments are encoded one by one in
bounded memory and give the ids of the whole text.  A stretch without such a boundary is split by the pattern
itself, piece by piece, which needs no backtracking over the stretch.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wattledger.llm.common import map_batches

#: Characters of a segment, about; a segment ends at the next safe boundary after it.
SEGMENT = 1 << 15
#: A segment longer than this has no safe boundary and goes through the pattern piece by piece.
LONGEST = 1 << 17

#: A space or line feed after a letter or digit: no match of the pattern has white space after something else, and what
#: comes after does not depend on what came before.  A letter beside an ASCII digit: no match has both.
_SAFE = re.compile(r"(?<=[^\W_])(?=[ \n])|(?<=[0-9])(?=[^\W\d_])|(?<=[^\W\d_])(?=[0-9])")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file: lines of base64 bytes and rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pieces() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Parts of a text, cut only where the pattern always ends a match."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = SEGMENT, longest: int = LONGEST) -> np.ndarray:
    """Ids of a text without special tokens, as little-endian unsigned 32-bit integers."""
    if len(text) <= size:
        return np.array(enc.encode_ordinary(text), "<u4")
    parts = []
    for segment in segments(text, size):
        if len(segment) <= longest:
            parts.append(np.array(enc.encode_ordinary(segment), "<u4"))
        else:
            for piece in _pieces().finditer(segment):
                parts.append(np.array(enc._encode_single_piece(piece[0].encode()), "<u4"))
    return np.concatenate(parts) if parts else np.empty(0, "<u4")


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace a text column by a binary column of token ids (little-endian unsigned 32-bit).

    A null or empty text has no ids (an empty binary).  Other columns stay; a column that already has the name of
    ``ids`` is replaced.  ``ranks_path`` must be readable where tasks run, as an installed package's file is.
    """
    keep = [f for f in df.schema.fields if f.name not in (text, ids)]
    schema = T.StructType([*keep, T.StructField(ids, T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks_path)
        out = [encode_text(enc, v.as_py() or "").tobytes() for v in batch.column(0)]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.binary())], names=schema.names)

    return map_batches(df.select(text, *[f.name for f in keep]), run, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the raw bytes that a binary column of token ids stands for; null ids give empty bytes."""
    keep = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks_path)
        raw = [enc.decode_bytes(np.frombuffer(v.as_py() or b"", "<u4").tolist()) for v in batch.column(ids)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=schema.names)

    return map_batches(df.select(*[f.name for f in keep]), run, schema)
