"""Quality of documents by a linear-chain conditional random field over their lines.

A chain has one place per line and two labels, bad and good.  A line's features are its length, its shares of capitals,
digits, symbols, marks and spaces, its words' lengths, how it ends, and how often it or its words repeat; each measure
falls into a bin, and the bins of the line before and of the line after are features of their own.  Hashed words of the
line complete them.  Transitions between labels are learned with the weights.  A document's score is the mean of its
lines' marginal probabilities of being good, weighted by their lengths.

Forward-backward is a scan: a line is a 2 x 2 matrix, and products of matrices over ever longer stretches are formed for
all lines of many texts side by side, so a chain of any length takes as many steps as its length has binary digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.llm.common import map_batches
from wattledger.session import cut

#: Training takes at most so many documents of each label, and so many characters from the middle of each.
TRAIN_DOCS, TRAIN_CHARS = 1_000, 20_000
#: Hash buckets of words.
BUCKETS = 1 << 14
#: Bytes of texts whose lines are measured and labelled together, about; a longer text is taken alone.
TOGETHER = 1 << 20
#: Bytes that are looked at in one go.
PIECE = 1 << 20

#: Bytes by kind: capitals, small letters, digits, white space, sentence ends, symbols, other marks, beyond ASCII.
_KINDS = 8
_KIND = np.full(256, 6, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 7
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[[33, 46, 63]] = 4
_KIND[[ord(c) for c in "#*$%&|<>~^_=+@\\{}[]"]] = 5
_KIND[[0x21]] = 6  # one exclamation mark does not end a plain sentence; two are noise

#: Borders of the bins of each measure of a line.
_SHARES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_BORDERS = (
    ("bytes", np.array([1, 5, 15, 40, 80, 160, 320, 640, 1280, 5120])),
    ("words", np.array([1, 2, 4, 8, 16, 32, 64, 128, 512])),
    ("capital", _SHARES), ("digit", _SHARES), ("space", _SHARES), ("symbol", _SHARES), ("mark", _SHARES), ("beyond", _SHARES),
    ("word length", np.array([1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 10, 14, 25])),
    ("same as the line before", np.array([0.5])), ("seen earlier", np.array([0.5])),
    ("repeated words", np.array([0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.95])),
    ("ends a sentence", np.array([0.5])), ("begins small", np.array([0.5])),
)
_SIZES = np.array([len(b) + 1 for _, b in _BORDERS])
_AT = np.cumsum(_SIZES) - _SIZES
#: Bins of a line; as many again for the line before and the line after, and one for a line without either.
BINS = int(_SIZES.sum())
WIDTH = 3 * BINS + 2


@dataclass
class Model:
    """Weights of bins and of hashed words for the label good, and log transitions between bad and good."""

    weights: np.ndarray
    transitions: np.ndarray


@dataclass
class Lines:
    """Lines of many texts in a row: first line of each text, bins of each line, (line, bucket) of words, lengths."""

    first: np.ndarray
    bins: np.ndarray
    word_line: np.ndarray
    word_bucket: np.ndarray
    weight: np.ndarray


def _pieces(begins: np.ndarray, stops: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, first, end) of each piece of ``size`` bytes and of the sorted spans that lie in it in part."""
    for low in range(0, size, PIECE):
        high = min(size, low + PIECE)
        first, end = int(np.searchsorted(stops, low, "right")), int(np.searchsorted(begins, high))
        if first < end:
            yield low, high, first, end


def _word_hashes(data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word: a sum over its bytes and their places, gathered piece by piece."""
    out = np.zeros(len(begins), np.uint64)
    for low, high, a, b in _pieces(begins, stops, len(data)):
        start, sizes = np.maximum(begins[a:b], low), np.minimum(stops[a:b], high) - np.maximum(begins[a:b], low)
        inside = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(start - inside, sizes)
        mixed = (data[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= (at - np.repeat(begins[a:b], sizes)).astype(np.uint64) * np.uint64(2) + np.uint64(0x100000001B3)
        mixed ^= mixed >> np.uint64(31)
        out[a:b] += np.add.reduceat(mixed, inside)
    return out * np.uint64(0xD6E8FEB86659FD93)


def measure(texts: list[bytes]) -> Lines:
    """Lines of texts, cut at line feeds; an empty text has one empty line."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lengths = ends - starts
    text_start = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    first = np.searchsorted(starts, text_start)
    text = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(starts))))
    n = len(starts)
    kinds = _KIND[data]
    counts = np.zeros((n, _KINDS), np.int64)
    for low, high, a, b in _pieces(starts, ends + 1, len(data)):
        inside = np.maximum(starts[a:b], low) - low
        for k in range(_KINDS):
            counts[a:b, k] += np.add.reduceat(kinds[low:high] == k, inside, dtype=np.int64)
    counts[:, 6] -= 1  # the line feed itself
    size = np.maximum(1, lengths)

    gap = (kinds == 3) | (data == 10)
    begins = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    stops = np.flatnonzero(~gap & np.concatenate((gap[1:], [True]))) + 1
    hashes = _word_hashes(data, begins, stops)
    word_line = np.searchsorted(starts, begins, "right") - 1
    words = np.bincount(word_line, minlength=n)
    long = np.bincount(word_line, stops - begins, minlength=n)
    # Words equal to the word before them or to an earlier one of the same line.
    same = np.zeros(len(hashes), bool)
    order = np.lexsort((np.arange(len(hashes)), hashes, word_line))
    again = (hashes[order][1:] == hashes[order][:-1]) & (word_line[order][1:] == word_line[order][:-1])
    same[order[1:][again]] = True
    repeated = np.bincount(word_line, same, minlength=n) / np.maximum(1, words)

    # Hash of a line: its words' hashes in their order.
    turn = np.arange(len(hashes), dtype=np.uint64) - (np.cumsum(words) - words)[word_line].astype(np.uint64)
    folded = (hashes ^ (hashes >> np.uint64(30))) * (np.uint64(2) * turn + np.uint64(0xBF58476D1CE4E5B9))
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, word_line, folded)
    has = words > 0
    before = np.concatenate(([False], (whole[1:] == whole[:-1]) & (text[1:] == text[:-1]))) & has
    order = np.lexsort((np.arange(n), whole, text))
    earlier = np.zeros(n, bool)
    twice = (whole[order][1:] == whole[order][:-1]) & (text[order][1:] == text[order][:-1])
    earlier[order[1:][twice]] = True
    last = data[np.maximum(ends - 1, starts)]
    head = data[starts]
    values = (
        lengths, words, counts[:, 0] / np.maximum(1, counts[:, 0] + counts[:, 1]), counts[:, 2] / size, counts[:, 3] / size,
        counts[:, 5] / size, (counts[:, 6] + counts[:, 4]) / size, counts[:, 7] / size, long / np.maximum(1, words),
        before, earlier & has, repeated, (_KIND[last] == 4) & has, (_KIND[head] == 1) & has,
    )
    bins = np.stack([a + np.searchsorted(b, v, "right") for a, (_, b), v in zip(_AT, _BORDERS, values)], axis=1)
    bucket = (hashes >> np.uint64(50)).astype(np.int64) % BUCKETS
    return Lines(first, bins, word_line, bucket, np.maximum(1, lengths).astype(np.float64))


def _neighbours(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Whether a line has a line before it, and one after it, in its text."""
    n = len(lines.bins)
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[lines.first] = False
    after[np.append(lines.first[1:], n) - 1] = False
    return before, after


def scores(lines: Lines, weights: np.ndarray) -> np.ndarray:
    """Each line's score for good over bad.  A word's weight counts as its share of the line."""
    own = weights[lines.bins].sum(1)
    left, right = weights[BINS + lines.bins].sum(1), weights[2 * BINS + lines.bins].sum(1)
    before, after = _neighbours(lines)
    out = own.copy()
    out[1:] += np.where(before[1:], left[:-1], 0)
    out[:-1] += np.where(after[:-1], right[1:], 0)
    out += np.where(before, 0, weights[3 * BINS]) + np.where(after, 0, weights[3 * BINS + 1])
    words = np.bincount(lines.word_line, weights[WIDTH + lines.word_bucket], len(own))
    out += 4 * words / np.maximum(1, np.bincount(lines.word_line, minlength=len(own)))
    return np.clip(out, -30, 30)


def gradient(lines: Lines, by_line: np.ndarray) -> np.ndarray:
    """Sum over lines of a line's value times its features."""
    out = np.zeros(WIDTH + BUCKETS)
    before, after = _neighbours(lines)
    left = np.append(np.where(before[1:], by_line[1:], 0), 0)  # what a line does to the one after it
    right = np.append(0, np.where(after[:-1], by_line[:-1], 0))
    for k, value in enumerate((by_line, left, right)):
        out[k * BINS : (k + 1) * BINS] = np.bincount(lines.bins.ravel(), np.repeat(value, lines.bins.shape[1]), BINS)
    out[3 * BINS], out[3 * BINS + 1] = by_line[~before].sum(), by_line[~after].sum()
    share = 4 * by_line / np.maximum(1, np.bincount(lines.word_line, minlength=len(by_line)))
    out[WIDTH:] = np.bincount(lines.word_bucket, share[lines.word_line], BUCKETS)
    return out


def _products(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices from each text's first line to each line, all lines at once, each scaled to sum 1."""
    done = steps / steps.sum((1, 2), keepdims=True)
    text_at = np.zeros(len(steps), np.int64)
    text_at[first] = first
    text_at = np.maximum.accumulate(text_at)
    depth = np.arange(len(steps)) - text_at
    width = 1
    while width <= depth.max(initial=0):
        here = np.flatnonzero(depth >= width)
        joined = done[here - width] @ done[here]
        done[here] = joined / joined.sum((1, 2), keepdims=True)
        width *= 2
    return done


def marginals(score: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and expected counts of each pair of labels of neighbours, by forward-backward.

    Before a text's first line both labels are equally likely and no transition counts.
    """
    n = len(score)
    emit = np.exp(np.stack([np.minimum(0, -score), np.minimum(0, score)], axis=1))
    step = np.exp(transitions)
    head = np.zeros(n, bool)
    head[first] = True
    forth = np.where(head[:, None, None], np.eye(2), step) * emit[:, None, :]
    alpha = _products(forth, first).sum(1)
    # Backward: the matrix of the line after, from the last line of a text to the first.
    tail = np.append(head[1:], True)
    back = np.empty_like(forth)
    back[:-1] = step * emit[1:, None, :]
    back[tail] = np.eye(2)
    turned = np.ascontiguousarray(np.swapaxes(back, 1, 2)[::-1])
    beta = _products(turned, np.flatnonzero(tail[::-1])).sum(1)[::-1]
    both = alpha * beta
    both /= both.sum(1, keepdims=True)
    inner = np.flatnonzero(~head)
    joint = alpha[inner - 1, :, None] * step * (emit * beta)[inner, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return both[:, 1], joint.sum(0)


def fit(texts: list[tuple[bytes, int]], epochs: int = 6, batch: int = 32, rate: float = 0.2, seed: int = 5) -> Model:
    """Train on (text, 0 or 1) with AdaGrad on the conditional likelihood; all lines of a text carry its label.

    Without texts all weights are zero, and every score is one half.
    """
    model = Model(np.zeros(WIDTH + BUCKETS), np.array([[0.0, -2.0], [-2.0, 0.0]]))
    if not texts:
        return model
    rng = np.random.default_rng(seed)
    sum_w, sum_t = np.full_like(model.weights, 1e-4), np.full((2, 2), 1e-4)
    parts = []
    for i in range(0, len(texts), batch):
        some = texts[i : i + batch]
        lines = measure([t for t, _ in some])
        sizes = np.diff(np.append(lines.first, len(lines.bins)))
        parts.append((lines, np.repeat([y for _, y in some], sizes), sizes))
    for _ in range(epochs):
        for k in rng.permutation(len(parts)):
            lines, label, sizes = parts[k]
            good, pairs = marginals(scores(lines, model.weights), lines.first, model.transitions)
            # A text counts as one, however many lines it has.
            each = np.repeat(1 / sizes, sizes)
            grad = gradient(lines, (good - label) * each) / len(sizes) + 1e-4 * model.weights
            inner = np.ones(len(label), bool)
            inner[lines.first] = False
            for y in (0, 1):
                pairs[y, y] -= (label[inner] == y).sum()
            pairs /= max(1, inner.sum())
            sum_w += grad**2
            sum_t += pairs**2
            model.weights -= rate * grad / np.sqrt(sum_w)
            model.transitions -= rate * pairs / np.sqrt(sum_t)
            model.transitions = np.clip(model.transitions, -6, 6)
    return model


def label_lines(texts: list[bytes], model: Model) -> tuple[Lines, np.ndarray]:
    """Lines of texts and each one's probability of being good."""
    lines = measure(texts)
    return lines, marginals(scores(lines, model.weights), lines.first, model.transitions)[0]


def score_texts(texts: list[bytes], model: Model) -> list[float]:
    """Mean probability of the lines of each text, weighted by their bytes."""
    out: list[float] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
            size += len(texts[end]) + 1
            end += 1
        lines, good = label_lines(texts[at:end], model)
        mean = np.add.reduceat(good * lines.weight, lines.first) / np.add.reduceat(lines.weight, lines.first)
        out += np.clip(mean, 0, 1).tolist()
        at = end
    return out


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
           docs_each: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> list[tuple[bytes, int]]:
    """Up to ``docs_each`` texts of each label, in an order drawn by the key's hash, and up to ``chars`` of each.

    Keys with null labels, labels other than 0 and 1, or both labels do not count, nor do null texts.  Of different
    texts under one key the smallest counts.  Labels are thinned by hash to about four times what is wanted before
    they are sorted; what is joined with the texts has at most ``2 * docs_each`` rows.
    """
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k"))
        .agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("other")).filter("y = other")
        .select("k", "y", F.xxhash64("k").alias("h"))
    )
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("x"))
    present = cut(known.join(texts.select("k").distinct(), "k", "left_semi"))
    counts = {r["y"]: r["count"] for r in present.groupBy("y").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for y, n in sorted(counts.items()) for x in (y, min(1.0, 4.0 * docs_each / n))])
    thin = F.pmod("h", F.lit(1 << 31)) < F.element_at(share, F.col("y")) * F.lit(1 << 31)
    chosen = present.filter(thin).withColumn(
        "n", F.row_number().over(W.partitionBy("y").orderBy("h", "k"))
    ).filter(F.col("n") <= docs_each).select("k", "y")
    begin = F.greatest(F.lit(1), F.floor((F.char_length("x") - chars) / 2).cast("int") + 1)
    middle = texts.filter("x is not null").join(F.broadcast(chosen), "k").select("k", "y", F.substring("x", begin, F.lit(chars)).alias("x"))
    rows = middle.groupBy("k", "y").agg(F.min("x").alias("x")).collect()
    return [(r["x"].encode(), r["y"]) for r in sorted(rows, key=lambda r: str(r["k"]))]


def train(docs: DataFrame, labels: DataFrame, **how) -> Model:
    """Fit on the bounded sample of ``sample``, dealt out in an order that mixes the labels."""
    rows = sample(docs, labels, **how)
    order = np.random.default_rng(3).permutation(len(rows))
    return fit([rows[i] for i in order])


def predict(docs: DataFrame, model: Model, text: str = "text", score: str = "score", predicted: str = "predicted",
            least: float = 0.7) -> DataFrame:
    """Replace the text by its score and by 1 where that is ``least`` or more, else 0; columns so named are replaced.

    A null text counts as empty, and an empty one is one empty line.  The model's size is fixed by its bins and buckets.
    """
    keep = [f for f in docs.schema.fields if f.name not in (text, score, predicted)]
    schema = T.StructType([*keep, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [v.as_py() or b"" for v in batch.column(0).cast(pa.binary())]
        found = score_texts(texts, shared.value)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(found, pa.float64()), pa.array([int(s >= least) for s in found], pa.int32())],
            names=schema.names,
        )

    return map_batches(docs.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{f.name}`") for f in keep]), run, schema)
