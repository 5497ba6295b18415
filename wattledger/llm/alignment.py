"""Alignment of two tokenizers: which tokens end at the same byte, and how often each pair of ids does so in the corpus.

1. Each text is encoded by both.  Where tokens of both end at the same byte a group closes, and the two tokens that end
   there are linked.  A task gathers (pair, document, times) records of many documents, at most ``RECORDS`` of them and
   ``DOCS`` documents: a piece.  It sorts them by pair, side B first, divides them by the low digits of the B id (the
   radix) and writes one run for each: the pairs and their sums compressed by zstd, and apart from them the documents.
   Runs are rows of a table in the shared folder, so texts are encoded once.
2. Counting reads only the pairs of the runs.  The runs of a radix are merged by a heap, ``FAN`` at a time, in as many
   rounds as it takes.  The last merge runs B by B, so the largest count of each B id is known as soon as its last pair
   has passed.  What a merge holds is bounded by the pairs there are of two vocabularies, not by the corpus; an id that
   stands in a third of all links is summed up before it is moved.
3. The runs meet the counts of their radix, some runs at a time, and give back what each document's links add up to;
   a piece's documents add up what the radixes give back.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.session import cut

#: Records and documents of a piece, at most, but for one document more.
RECORDS, DOCS = 1 << 20, 1 << 15
#: Radixes, a power of two; runs that are merged or given back together.
RADIX, FAN = 64, 64
#: Characters that are encoded together, about, and of a part of a long text.
TOGETHER, SEGMENT = 1 << 20, 1 << 16

#: One space between two characters that are neither white space nor the mark that stands for a space in side B.
#: No match of side A's pattern goes over it, and no piece of side B has a space behind something else.
_SAFE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


@dataclass
class Side:
    """A tokenizer's bytes of each id, and how many they are."""

    encode: object
    raw: list[bytes]
    size: np.ndarray


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: Characters whose classes (letter, number, white space) all versions of Unicode agree on.
_SETTLED = re.compile(r"[^\x00-\u024F]")


def _same_ranks(model: dict, letters: dict[str, int], special: set[int]) -> tiktoken.Encoding | None:
    """The vocabulary as ranks of the tiktoken library, which is several times faster; none if the ranks of its merges
    are not the merges' order, or its words are cut in another way, so that ids could differ."""
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"].get("merges", [])]
    vocab, cut_by = model["model"]["vocab"], model.get("pre_tokenizer") or {}
    ordered = [vocab[a + b] for a, b in merges]
    if ordered != sorted(ordered) or cut_by.get("type") != "ByteLevel" or not cut_by.get("use_regex") or cut_by.get("add_prefix_space") or model.get("normalizer"):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if i not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    """Side A: byte-level BPE of a file of the tokenizers library.

    Texts of settled characters go through the same vocabulary in the tiktoken library where that gives the same ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters = _byte_letters()
    raw = [b""] * tokenizer.get_vocab_size()
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    added = {t["id"] for t in model.get("added_tokens", [])}
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        raw[i] = token.encode() if i in added else bytes(letters[c] for c in token)
    ranks = _same_ranks(model, letters, added)

    def encode(texts: list[str]) -> list[list[int]]:
        odd = [k for k, t in enumerate(texts) if ranks is None or _SETTLED.search(t)]
        out: list = [None] * len(texts)
        for k, e in zip(odd, tokenizer.encode_batch_fast([texts[k] for k in odd], add_special_tokens=False)):
            out[k] = e.ids
        return [ranks.encode_ordinary(t) if ids is None else ids for t, ids in zip(texts, out)]

    return Side(encode, raw, np.array([len(r) for r in raw], np.int64))


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """Side B: pieces with byte fallback of the sentencepiece library."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        raw.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Side(lambda texts: model.encode(texts, num_threads=1), raw, np.array([len(r) for r in raw], np.int64))


def _segments(text: str, size: int) -> list[str]:
    """Parts of a text that are encoded one by one; the space between two of them belongs to neither."""
    out, at = [], 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if found is None:
            break
        out.append(text[at : found.start()])
        at = found.end()
    return [*out, text[at:]]


def encode(texts: list[str], a: Side, b: Side, segment: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of each text on both sides: A of a space and the text, B of the text."""
    parts = [_segments(t, segment) for t in texts]
    flat = [p for ps in parts for p in ps]
    ids_a, ids_b = a.encode([" " + p for p in flat]), b.encode(flat)
    at = 0
    for ps in parts:
        here = range(at, at + len(ps))
        at += len(ps)
        yield tuple(np.array(list(itertools.chain.from_iterable(ids[k] for k in here)), np.int64) for ids in (ids_a, ids_b))


@dataclass
class Aligned:
    """A text's tokens on both sides and the places of those that close a group."""

    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray


_NOTHING = Aligned(*(np.empty(0, np.int64) for _ in range(4)))


def align(text: str, ids_a: np.ndarray, ids_b: np.ndarray, a: Side, b: Side) -> Aligned:
    """Tokens of both sides; none for an empty text or where a side's bytes are not those of a space and the text."""
    raw = (" " + text).encode()
    if not text or any(b"".join([side.raw[i] for i in ids.tolist()]) != raw for side, ids in ((a, ids_a), (b, ids_b))):
        return _NOTHING
    ends_a, ends_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
    mark = np.zeros(len(raw) + 1, bool)
    mark[ends_a] = True
    last_b = np.flatnonzero(mark[ends_b])
    last_a = np.searchsorted(ends_a, ends_b[last_b])
    return Aligned(ids_a, ids_b, last_a, last_b)


@lru_cache(maxsize=4)
def _decimals(size: int, mark: str) -> np.ndarray:
    return np.array([f"{i}{mark}" for i in range(size)], object)


def groups_text(x: Aligned, size_a: int, size_b: int) -> str:
    """The groups as ``a1,a2|b1;a3|b2,b3``."""
    if not len(x.a):
        return ""
    parts = np.empty(len(x.a) + len(x.b), object)
    at_a, at_b = np.arange(len(x.a)), np.arange(len(x.b))
    group_a, group_b = np.searchsorted(x.last_a, at_a), np.searchsorted(x.last_b, at_b)
    place_a = at_a + np.concatenate(([0], x.last_b + 1))[group_a]
    place_b = at_b + x.last_a[group_b] + 1
    parts[place_a], parts[place_b] = _decimals(size_a, ",")[x.a], _decimals(size_b, ",")[x.b]
    parts[place_a[x.last_a]], parts[place_b[x.last_b]] = _decimals(size_a, "|")[x.a[x.last_a]], _decimals(size_b, ";")[x.b[x.last_b]]
    return "".join(parts.tolist())[:-1]


def _small(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in as few bytes as they need."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


def _press(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as one zstd frame, each with its item size and length."""
    small = [_small(x) for x in arrays]
    head = np.array([v for x in small for v in (x.itemsize, len(x))], "<u8")
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(x.tobytes() for x in small))


def _unpress(data: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    head = np.frombuffer(raw, "<u8", 2 * n).tolist()
    out, at = [], 16 * n
    for width, length in zip(head[::2], head[1::2]):
        out.append(np.frombuffer(raw, f"<u{width}", length, at).astype(np.int64))
        at += width * length
    return out


def _heads(pairs: np.ndarray, sums: np.ndarray) -> bytes:
    """Sorted pairs (b << 32 | a), by their steps, and their sums."""
    return _press(np.diff(pairs, prepend=0), sums)


def _unheads(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, sums = _unpress(data, 2)
    return np.cumsum(steps), sums


def runs(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, radix: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(radix, pairs and sums, documents) of a piece's records, which come in the order of their documents."""
    digit = pair >> 32 & (radix - 1)
    order = np.lexsort((pair, digit))
    pair, doc, times, digit = pair[order], doc[order], times[order], digit[order]
    borders = np.flatnonzero(np.diff(digit, prepend=-1, append=-1))
    for start, stop in zip(borders[:-1].tolist(), borders[1:].tolist()):
        p, t = pair[start:stop], times[start:stop]
        first = np.flatnonzero(np.diff(p, prepend=-1))
        sizes = np.diff(np.append(first, len(p)))
        yield int(digit[start]), _heads(p[first], np.add.reduceat(t, first)), _press(sizes, doc[start:stop], t)


def merged(heads: list[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, sum) in the order of pairs, from any number of runs, by a heap of their next pairs."""
    streams = [zip(*(x.tolist() for x in _unheads(h))) for h in heads]
    for pair, same in itertools.groupby(heapq.merge(*streams), key=lambda x: x[0]):
        yield pair, sum(n for _, n in same)


def _encoded(df: DataFrame, key: str, text: str, paths: tuple[str, str], records: int, docs: int, radix: int) -> DataFrame:
    """Rows of documents (radix null) and rows of runs."""
    schema = T.StructType([
        T.StructField("piece", T.LongType()), T.StructField("doc", T.IntegerType()), T.StructField("key", df.schema[key].dataType),
        *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")], T.StructField("groups_sha256", T.StringType()),
        T.StructField("radix", T.IntegerType()), T.StructField("heads", T.BinaryType()), T.StructField("body", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_side(paths[0]), piece_side(paths[1])
        task = TaskContext.get().partitionId() << 32
        piece, held, size, ordinal = 0, [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            parts = [np.concatenate(x) for x in zip(*held)] if held else []
            found = list(runs(*parts, radix)) if parts else []
            if found:
                n = len(found)
                nothing = {f.name: pa.nulls(n, f.type) for f in arrow if f.name not in ("piece", "radix", "heads", "body")}
                columns = nothing | {
                    "piece": pa.array([task + piece] * n, pa.int64()), "radix": pa.array([f[0] for f in found], pa.int32()),
                    "heads": pa.array([f[1] for f in found], pa.binary()), "body": pa.array([f[2] for f in found], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in arrow], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = pa.schema([
                    ("piece", pa.int64()), ("doc", pa.int32()), ("key", batch.schema.field("key").type),
                    *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
                    ("radix", pa.int32()), ("heads", pa.binary()), ("body", pa.binary()),
                ])
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= TOGETHER) and ordinal + end - at < docs:
                    chars += len(texts[end])
                    end += 1
                rows = []
                for t, ids in zip(texts[at:end], encode(texts[at:end], a, b)):
                    x = align(t, *ids, a, b)
                    groups = groups_text(x, len(a.raw), len(b.raw))
                    rows.append((len(x.a), len(x.b), len(x.last_a), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
                    if len(x.last_a):
                        pair, times = np.unique(x.b[x.last_b] << 32 | x.a[x.last_a], return_counts=True)
                        held.append((pair, np.full(len(pair), ordinal + len(rows) - 1, np.int64), times))
                        size += len(pair)
                n = len(rows)
                n_a, n_b, groups, digest = zip(*rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array([task + piece] * n, pa.int64()), pa.array(range(ordinal, ordinal + n), pa.int32()),
                    batch.column("key").slice(at, n), *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups, groups)),
                    pa.array(digest, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                ], schema=arrow)
                ordinal += n
                at = end
                if size >= records or ordinal >= docs:
                    yield from flush()
                    piece, held, size, ordinal = piece + 1, [], 0, 0
        if arrow is not None:
            yield from flush()

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def pair_counts(heads: DataFrame, fan: int = FAN) -> DataFrame:
    """(radix, counts) of run heads (radix, piece, heads): the sorted pairs of a radix, their counts, and whether each
    count is the highest of its B id.
    """

    def merge(table: pa.Table) -> pa.Table:
        pairs = list(merged(table.column("heads").to_pylist()))
        packed = _heads(*(np.array(x, np.int64) for x in zip(*pairs)))
        return pa.table({
            "radix": table.column("radix").slice(0, 1), "piece": table.column("shelf").slice(0, 1),
            "heads": pa.array([packed], pa.binary()),
        })

    def best(table: pa.Table) -> pa.Table:
        pairs, sums, flags = [], [], []
        for _, one in itertools.groupby(merged(table.column("heads").to_pylist()), key=lambda x: x[0] >> 32):
            mine = list(one)  # at most as many as side A has ids
            most = max(n for _, n in mine)
            for pair, n in mine:
                pairs.append(pair)
                sums.append(n)
                flags.append(n == most)
        steps, sums, flags = np.diff(np.array(pairs, np.int64), prepend=0), np.array(sums, np.int64), np.array(flags, np.int64)
        return pa.table({"radix": table.column("radix").slice(0, 1), "counts": pa.array([_press(steps, sums, flags)], pa.binary())})

    pieces = heads.agg(F.count_distinct("piece")).first()[0]
    while pieces > fan:
        pieces = -(-pieces // fan)
        shelved = heads.withColumn("shelf", F.pmod(F.xxhash64("piece"), F.lit(pieces)).cast("bigint"))
        heads = shelved.groupBy("radix", "shelf").applyInArrow(merge, "radix int, piece bigint, heads binary")
    return heads.groupBy("radix").applyInArrow(best, "radix int, counts binary")


def alignments(df: DataFrame, key: str = "doc_id", text: str = "text", byte_path: str | None = None,
               piece_path: str | None = None, records: int = RECORDS, docs: int = DOCS, radix: int = RADIX,
               fan: int = FAN) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A null or empty text, and one whose tokens' bytes on a side are not those of a space and the text, has no tokens:
    zeros and ''.  Special tokens' names in a text are plain text.  Repeated rows and null keys are rows of their own,
    and each repetition counts.  An empty table gives no rows.  Tokens have at least one byte, so a group has one link.
    """
    paths = (byte_path or public_tokenizers.path("byte_bpe_50k.json"), piece_path or public_tokenizers.path("piece_bpe_32k.model"))
    written = cut(_encoded(df, key, text, paths, records, docs, radix))
    rows = written.filter("radix is not null")
    counts = cut(pair_counts(rows.select("radix", "piece", "heads"), fan))
    pieces = written.agg(F.count_distinct("piece")).first()[0]
    shelves = max(1, -(-pieces // fan))

    def give_back(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            steps, sums, flags = _unpress(right.column("counts")[0].as_py(), 3)
            known = np.cumsum(steps)
            for piece, heads, body in zip(*(left.column(c).to_pylist() for c in ("piece", "heads", "body"))):
                pairs, _ = _unheads(heads)
                sizes, doc, times = _unpress(body, 3)
                at = np.repeat(np.searchsorted(known, pairs), sizes)
                who, back = np.unique(doc, return_inverse=True)
                total, first = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
                np.add.at(total, back, times * sums[at])
                np.add.at(first, back, times * flags[at])
                out.append((piece, _press(who, total, first)))
        return pa.table({"piece": pa.array([p for p, _ in out], pa.int64()), "back": pa.array([z for _, z in out], pa.binary())})

    shelf = F.pmod(F.xxhash64("piece"), F.lit(shelves)).cast("int")
    spread = counts.withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))))
    back = rows.select("radix", "piece", "heads", "body", shelf.alias("shelf")).groupBy("radix", "shelf").cogroup(
        spread.groupBy("radix", "shelf")
    ).applyInArrow(give_back, "piece bigint, back binary")

    fields = [f for f in written.schema.fields if f.name not in ("piece", "doc", "radix", "heads", "body", "groups_sha256")]
    schema = T.StructType([*fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                           T.StructField("groups_sha256", T.StringType())])

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        doc = left.column("doc").to_numpy()
        total, first = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        for z in right.column("back").to_pylist():
            who, t, f = _unpress(z, 3)
            total[who] += t
            first[who] += f
        columns = {f.name: left.column(f.name) for f in fields} | {
            "n_best": pa.array(first[doc]), "count_sum": pa.array(total[doc]), "groups_sha256": left.column("groups_sha256"),
        }
        return pa.table([columns[n] for n in schema.names], names=schema.names)

    done = written.filter("radix is null").drop("radix", "heads", "body").groupBy("piece").cogroup(
        back.groupBy("piece")
    ).applyInArrow(add_up, schema)
    return done.withColumnRenamed("key", key)
