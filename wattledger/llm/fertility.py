"""Quality rules from public tokenisers: how many characters a token covers, how often bytes stand in for pieces, and
how varied the tokens of a text are, against bands for its script.

Words are encoded one by one, and a worker keeps what it has measured, so most words are encoded once.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.llm import bpe
from wattledger.llm.common import map_batches

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: The vocabulary of many languages.
WIDE = "byte_bpe_multi_50k.tiktoken"
#: Words of texts that are measured together, about; a longer text is measured alone.
TOGETHER = 200_000

#: First and last code point of each script's letters, main blocks only.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
#: Entropy does not grow with a text beyond so many pieces.
ENOUGH = 1024
#: Bands by script: least characters per piece, per byte-level token and per token of the vocabulary of many languages,
#: most characters per token of any, largest share of byte-fallback pieces, least entropy of pieces as a share of what
#: it could be.  Each lies between what clean text of the script measures and what its letters at random do (``spread``
#: gives the former for a corpus); a script whose letters are pieces of their own has few different pieces.
BANDS = {
    "latin": (1.45, 1.40, 1.50, 9.0, 0.25, 0.35),
    "greek": (0.70, 0.55, 1.35, 6.0, 0.25, 0.25),
    "cyrillic": (1.15, 0.62, 1.60, 8.0, 0.25, 0.30),
    "hebrew": (0.65, 0.55, 1.27, 6.0, 0.25, 0.25),
    "arabic": (0.65, 0.60, 1.30, 6.0, 0.15, 0.25),
    "devanagari": (0.55, 0.45, 0.70, 5.0, 0.30, 0.25),
    "thai": (0.65, 0.42, 0.90, 5.0, 0.20, 0.25),
    "kana": (0.65, 0.50, 0.90, 5.0, 0.30, 0.25),
    "han": (0.55, 0.38, 0.60, 5.0, 0.40, 0.30),
    "hangul": (0.45, 0.30, 0.75, 5.0, 0.40, 0.25),
    "none": (0.80, 0.50, 0.50, 9.0, 0.50, 0.30),
    "other": (0.20, 0.20, 0.20, 9.0, 1.00, 0.25),
}
#: Characters of the words whose measures a worker keeps, at most, but for those of one batch.
KEEP = 3_000_000

FIELDS = (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()),
    ("script", T.StringType()), ("chars_per_piece", T.DoubleType()), ("chars_per_token", T.DoubleType()),
    ("byte_share", T.DoubleType()), ("entropy", T.DoubleType()), ("chars_per_wide_token", T.DoubleType()),
)


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def _letters(words: list[str]) -> np.ndarray:
    """For each word its letters in each script, in the order of SCRIPTS, and its letters in all."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    known, at = np.unique(codes, return_inverse=True)
    kind = np.full((len(known), 2), len(SCRIPTS) + 1)  # the script, and whether it is a letter at all
    for i, code in enumerate(known.tolist()):
        if chr(code).isalpha():
            kind[i] = next((k for k, (_, a, b) in enumerate(SCRIPTS) if a <= code <= b), len(SCRIPTS) + 1), len(SCRIPTS)
    width, owner = len(SCRIPTS) + 2, np.repeat(np.arange(len(words)), sizes)
    counts = sum(np.bincount(owner * width + kind[at, k], minlength=len(words) * width) for k in (0, 1))
    return counts.reshape(len(words), width)[:, :-1]


def _script(counts: np.ndarray) -> str:
    """The script of most letters; 'none' without letters, 'other' if no listed script has half of them."""
    total, best = int(counts[-1]), int(counts[:-1].argmax())
    return "none" if not total else SCRIPTS[best][0] if 2 * counts[best] >= total else "other"


def script_of(words: list[str]) -> str:
    """The script of most letters of some words."""
    return _script(_letters(words).sum(0)) if words else "none"


class _Words:
    """Measures of words, kept from batch to batch; all are forgotten when their characters become too many."""

    def __init__(self, pieces_path: str, ranks_path: str, wide_path: str):
        self.model, self.is_byte = _pieces(pieces_path)
        self.encodings = [bpe.encoding(p) for p in (ranks_path, wide_path)]
        self._forget()

    def _forget(self):
        self.slot: dict[str, int] = {}
        self.chars = 0
        #: Of each word: characters, pieces, byte pieces, tokens, wide tokens, first place in ``ids``, letters by script.
        self.rows = np.empty((1 << 12, 6 + len(SCRIPTS) + 1), np.int64)
        self.ids, self.used = np.empty(1 << 14, np.int32), 0

    def slots(self, vocabulary: list[str]) -> np.ndarray:
        new = [w for w in vocabulary if w not in self.slot]
        size = sum(map(len, new))
        if self.chars and self.chars + size > KEEP:
            self._forget()
            new = vocabulary
            size = sum(map(len, new))
        if new:
            self._add(new)
            self.chars += size
        return np.fromiter(map(self.slot.__getitem__, vocabulary), np.int64, len(vocabulary))

    def _add(self, new: list[str]):
        first, n = len(self.slot), len(new)
        while len(self.rows) < first + n:
            self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
        pieces = self.model.encode(new, num_threads=1)
        sizes = np.array([len(x) for x in pieces], np.int64)
        ids = np.fromiter(itertools.chain.from_iterable(pieces), np.int32, int(sizes.sum()))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        rows = self.rows[first : first + n]
        rows[:, 0] = [len(w) for w in new]
        rows[:, 1] = sizes
        rows[:, 2] = np.bincount(np.repeat(np.arange(n), sizes), self.is_byte[ids], n)
        for k, enc in enumerate(self.encodings):
            rows[:, 3 + k] = [
                len(enc.encode_ordinary(" " + w)) if len(w) < bpe.SEGMENT else len(bpe.encode_text(enc, " " + w)) for w in new
            ]
        rows[:, 5] = self.used + np.cumsum(sizes) - sizes
        rows[:, 6:] = _letters(new)
        self.used += len(ids)
        self.slot.update(zip(new, range(first, first + n)))

    def pieces(self, slots: np.ndarray) -> np.ndarray:
        """Ids of the pieces of words, one after the other."""
        sizes, start = self.rows[slots, 1], self.rows[slots, 5]
        return self.ids[np.arange(int(sizes.sum())) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)]


@lru_cache(maxsize=2)
def _words(pieces_path: str, ranks_path: str, wide_path: str) -> _Words:
    return _Words(pieces_path, ranks_path, wide_path)


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


def repeated_words(codes: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more; ``codes`` numbers the text's words."""
    if len(codes) < 4:
        return 0
    _, pair = np.unique(codes[:-1].astype(np.int64) * (int(codes.max()) + 1) + codes[1:], return_inverse=True)
    _, triple, counts = np.unique(
        pair[:-1].astype(np.int64) * (int(codes.max()) + 1) + codes[2:], return_inverse=True, return_counts=True
    )
    twice = counts[triple] > 1
    inside = np.zeros(len(codes), bool)
    for shift in range(3):
        inside[shift : shift + len(twice)] |= twice
    return int(inside.sum())


def _entropy(ids: np.ndarray) -> float:
    """Entropy of the ids in bits, over what so many ids, or ENOUGH of them, could have at most; 1 for fewer than two."""
    if len(ids) < 2:
        return 1.0
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return min(1.0, float(-(share * np.log2(share)).sum() / np.log2(min(len(ids), ENOUGH))))


def _verdict(script: str, piece: float, token: float, wide: float, share: float, entropy: float) -> bool:
    least_piece, least_token, least_wide, most, largest, least = BANDS[script]
    return (
        least_piece <= piece <= most and least_token <= token <= most and least_wide <= wide <= most
        and share <= largest and entropy >= least
    )


def measure_texts(texts: list[str], pieces_path: str, ranks_path: str, wide_path: str | None = None) -> list[tuple]:
    """The values of FIELDS for each text."""
    words = _words(pieces_path, ranks_path, wide_path or public_tokenizers.path(WIDE))
    split = [_WORD.findall(t) for t in texts]
    out: list[tuple] = []
    at = 0
    while at < len(split):
        end, size = at, 0
        while end < len(split) and (end == at or size + len(split[end]) <= TOGETHER):
            size += len(split[end])
            end += 1
        flat = [w for ws in split[at:end] for w in ws]
        codes, vocabulary = pd.factorize(np.array(flat, object)) if flat else (np.empty(0, np.int64), [])
        slots = words.slots(list(vocabulary))
        first = 0
        for k in range(at, end):
            own = codes[first : first + len(split[k])]
            first += len(split[k])
            n, text = len(own), texts[k]
            repeated = repeated_words(own)
            n_symbols = sum(map(text.count, SYMBOLS))
            failed = n < 50 or 100 * repeated > 50 * n
            mine = slots[own]
            sums = words.rows[mine].sum(0)
            word_chars = int(sums[0])
            if n:
                piece, token, wide = (word_chars / max(1, int(sums[j])) for j in (1, 3, 4))
                share = int(sums[2]) / max(1, int(sums[1]))
                entropy, script = _entropy(words.pieces(mine)), _script(sums[6:])
            else:
                piece, token, wide, share, entropy, script = 0.0, 0.0, 0.0, 0.0, 1.0, "none"
            out.append((n, word_chars, n_symbols, repeated_lines(text), repeated, failed,
                        not failed and _verdict(script, piece, token, wide, share, entropy), script, piece, token, share, entropy, wide))
        at = end
    return out


def measure(df: DataFrame, text: str = "text", pieces_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Replace the text by the values of FIELDS; other columns stay, those of the same names are replaced.

    A null or empty text has no words and fails the base rules.  ``kept`` is false where they fail, and otherwise says
    whether all measures lie in the bands of the text's script.
    """
    pieces_path = pieces_path or public_tokenizers.path("piece_bpe_32k.model")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = [n for n, _ in FIELDS]
    keep = [f for f in df.schema.fields if f.name != text and f.name not in names]
    schema = T.StructType([*keep, *(T.StructField(n, t) for n, t in FIELDS)])
    kinds = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measure_texts([v or "" for v in batch.column(text).to_pylist()], pieces_path, ranks_path)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(f.name) for f in keep), *(pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*found), FIELDS))],
            names=schema.names,
        )

    return map_batches(df.select(text, *[f"`{f.name}`" for f in keep]), run, schema)


def spread(measured: DataFrame, by: str = "script", at: tuple[float, ...] = (0.001, 0.01, 0.5, 0.99, 0.999)) -> DataFrame:
    """(by, n, and an array of quantiles of each measure) over the rows that pass the base rules, for setting bands."""
    names = [n for n, t in FIELDS if t == T.DoubleType()]
    return measured.filter("not base_failed").groupBy(by).agg(
        F.count("*").alias("n"), *[F.percentile_approx(n, list(at), 10_000).alias(n) for n in names]
    )
