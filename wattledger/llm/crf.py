"""Language of words and documents by a linear-chain conditional random field.

A word is a run of letters.  Its features are its byte n-grams with marks at both ends (which makes prefixes and
suffixes of them too) and its entry in a lexicon gathered from the training words.  Learned transitions say how
seldom the language changes from word to word; training therefore also sees texts spliced from two languages.
Forward-backward gives each word's probabilities; a document's language is the one with the largest mean.

The chain is never cut: a text is laid out in blocks, the product of a block's matrices carries the state over it, and
inside all blocks the recursions run side by side.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.llm.common import map_batches

#: Training takes at most so many documents of each language, and so many words from the middle of each.
TRAIN_DOCS, TRAIN_WORDS = 1_000, 60
#: Hash buckets of the n-grams; sizes of the n-grams.
BUCKETS, SIZES = 1 << 16, (2, 3, 4)
#: Words of the lexicon, at most, and how often training must have seen one.
LEXICON, SEEN = 20_000, 3
#: Words of a block, and of texts that are labelled together.
BLOCK, TOGETHER = 32, 150_000
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased; none if it has no letter."""
    # The pattern also meets numerals such as ½; the search stops at the first letter.
    return _WORD.findall(text.lower()) if any(c.isalpha() for c in text) else []


@dataclass
class Model:
    """Labels, feature weights (buckets and then lexicon entries), lexicon, transitions (log) and their start."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    transitions: np.ndarray


def _features(vocabulary: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature number) of every feature of every word."""
    marked = [b"\x02" + w.encode() + b"\x03" for w in vocabulary]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    who, which = [], []
    code = data + np.uint64(1)
    for n in range(2, max(SIZES) + 1):
        code = code[:-1] * np.uint64(0x100000001B3) + data[n - 1 :] if len(code) > 1 else code[:0]
        if n in SIZES:
            inside = word[: len(code)] == word[n - 1 : n - 1 + len(code)]
            mixed = code[inside] * np.uint64(0x9E3779B97F4A7C15)
            who.append(word[: len(code)][inside])
            which.append((mixed >> np.uint64(64 - 16)).astype(np.int64) % BUCKETS)
    known = [(k, BUCKETS + lexicon[w]) for k, w in enumerate(vocabulary) if w in lexicon]
    who.append(np.array([k for k, _ in known], np.int64))
    which.append(np.array([f for _, f in known], np.int64))
    return np.concatenate(who), np.concatenate(which)


def _scores(vocabulary: list[str], model: Model) -> np.ndarray:
    """Each word's score for each label."""
    who, which = _features(vocabulary, model.lexicon)
    out = np.stack([
        np.bincount(who, model.weights[which, k], len(vocabulary)) for k in range(len(model.labels))
    ], axis=1)
    return np.clip(out, -30, 30)


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Probabilities of each word's labels by forward-backward; ``scores`` has the words of all texts in a row.

    Before the first word all labels are equally likely, and the transition to it counts.
    """
    k = scores.shape[1]
    step = np.exp(transitions)
    near = np.exp(scores - scores.max(1, keepdims=True))
    blocks = -(-lengths // block)
    first = np.cumsum(blocks) - blocks  # of each text
    total = int(blocks.sum())
    at = np.cumsum(lengths) - lengths
    number = np.arange(len(scores)) - np.repeat(at, lengths)
    row, column = np.repeat(first, lengths) + number // block, number % block
    e = np.ones((total, block, k))
    e[row, column] = near
    valid = np.zeros((total, block), bool)
    valid[row, column] = True
    whole = valid.all(0)

    carry = np.tile(np.eye(k), (total, 1, 1))
    for t in range(block):
        new = (carry @ step) * e[:, t, None, :]
        new /= new.sum((1, 2), keepdims=True)
        carry = new if whole[t] else np.where(valid[:, t, None, None], new, carry)
    into, outof = np.full((total, k), 1 / k), np.full((total, k), 1 / k)
    for j in range(1, int(blocks.max(initial=0))):
        here = first[blocks > j] + j
        a = np.einsum("bi,bij->bj", into[here - 1], carry[here - 1])
        into[here] = a / a.sum(1, keepdims=True)
    for j in range(1, int(blocks.max(initial=0))):
        here = (first + blocks - 1 - j)[blocks > j]
        b = np.einsum("bij,bj->bi", carry[here + 1], outof[here + 1])
        outof[here] = b / b.sum(1, keepdims=True)
    alpha = np.empty_like(e)
    a = into
    for t in range(block):
        a = (a @ step) * e[:, t]
        a /= a.sum(1, keepdims=True)
        alpha[:, t] = a
    b = outof
    for t in range(block - 1, -1, -1):
        alpha[:, t] *= b
        new = (e[:, t] * b) @ step.T
        new /= new.sum(1, keepdims=True)
        b = new if whole[t] else np.where(valid[:, t, None], new, b)
    out = alpha[row, column]
    return out / out.sum(1, keepdims=True)


def _spliced(texts: list[tuple[list[str], int]], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Training chains: each text, and for every second one a chain of parts of two texts."""
    chains = [(w, [y] * len(w)) for w, y in texts]
    for _ in range(len(texts) // 2):
        (a, y), (b, z) = (texts[i] for i in rng.integers(0, len(texts), 2))
        cut_a, cut_b = rng.integers(1, len(a) + 1), rng.integers(0, len(b))
        chains.append((a[:cut_a] + b[cut_b:], [y] * int(cut_a) + [z] * (len(b) - int(cut_b))))
    return chains


def fit(texts: list[tuple[list[str], str]], epochs: int = 4, batch: int = 64, rate: float = 0.3, seed: int = 7) -> Model:
    """Train on (words, label) with AdaGrad on the conditional likelihood."""
    texts = [(w, y) for w, y in texts if w]
    labels = sorted({y for _, y in texts})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)), {}, np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    counts = Counter(w for ws, _ in texts for w in ws)
    lexicon = {w: i for i, (w, c) in enumerate(counts.most_common(LEXICON)) if c >= SEEN}
    k = len(labels)
    model = Model(labels, np.zeros((BUCKETS + len(lexicon), k)), lexicon, np.full((k, k), -2.0) + 2 * np.eye(k))
    chains = _spliced([(w, labels.index(y)) for w, y in texts], rng)
    vocabulary = sorted({w for ws, _ in chains for w in ws})
    number = {w: i for i, w in enumerate(vocabulary)}
    coded = [(np.array([number[w] for w in ws]), np.array(ys)) for ws, ys in chains]
    who, which = _features(vocabulary, lexicon)
    order = np.argsort(who, kind="stable")
    which, start = which[order], np.searchsorted(who[order], np.arange(len(vocabulary) + 1))
    sum_w, sum_t = np.full_like(model.weights, 1e-6), np.full((k, k), 1e-6)
    for _ in range(epochs):
        shuffled = rng.permutation(len(coded))
        for i in range(0, len(coded), batch):
            part = [coded[j] for j in shuffled[i : i + batch]]
            ids, ys = (np.concatenate([p[x] for p in part]) for x in (0, 1))
            lengths = np.array([len(p[0]) for p in part])
            used, back = np.unique(ids, return_inverse=True)
            sizes = start[used + 1] - start[used]
            owner = np.repeat(np.arange(len(used)), sizes)
            feats = which[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start[used], sizes)]
            scores = np.stack([np.bincount(owner, model.weights[feats, c], len(used)) for c in range(k)], axis=1)
            scores = np.clip(scores, -30, 30)[back]
            single, pair = _expected(scores, lengths, model.transitions)
            single[np.arange(len(ys)), ys] -= 1
            inner = np.ones(len(ys), bool)
            inner[np.cumsum(lengths) - lengths] = False
            now = np.flatnonzero(inner)
            np.subtract.at(pair, (ys[now - 1], ys[now]), 1)
            by_word = np.stack([np.bincount(back, single[:, c], len(used)) for c in range(k)], axis=1)
            grad = np.stack([np.bincount(feats, by_word[owner, c], len(model.weights)) for c in range(k)], axis=1)
            grad = grad / len(part) + 1e-5 * model.weights
            sum_w += grad**2
            model.weights -= rate * grad / np.sqrt(sum_w)
            pair /= len(part)
            sum_t += pair**2
            model.transitions -= rate * pair / np.sqrt(sum_t)
    return Model(labels, model.weights.astype(np.float32), lexicon, model.transitions)


def _expected(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels of words and expected counts of transitions between words of a text."""
    k, most, n = scores.shape[1], int(lengths.max()), len(lengths)
    step = np.exp(transitions)
    at = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(n), lengths)
    column = np.arange(len(scores)) - np.repeat(at, lengths)
    e = np.ones((n, most, k))
    e[row, column] = np.exp(scores - scores.max(1, keepdims=True))
    valid = np.arange(most) < lengths[:, None]
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = np.full((n, k), 1 / k)
    for t in range(most):
        a = (a @ step) * e[:, t]
        a /= a.sum(1, keepdims=True)
        alpha[:, t] = a
    b = np.full((n, k), 1 / k)
    for t in range(most - 1, -1, -1):
        beta[:, t] = b
        new = (e[:, t] * b) @ step.T
        b = np.where(valid[:, t, None], new / new.sum(1, keepdims=True), b)
    single = alpha * beta
    single /= single.sum(2, keepdims=True)
    joint = alpha[:, :-1, :, None] * step * (e * beta)[:, 1:, None, :]
    joint /= np.maximum(joint.sum((2, 3), keepdims=True), 1e-300)
    return single[row, column], (joint * valid[:, 1:, None, None]).sum((0, 1))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", docs_each: int = TRAIN_DOCS,
          words_each: int = TRAIN_WORDS, **how) -> Model:
    """Fit on a bounded sample: up to ``docs_each`` documents of each label in an order drawn by the key's hash, and up
    to ``words_each`` words from the middle of each.  Rows without label or text do not count.

    Labels are counted first and the hash then thinned to about four times what is wanted, so the one task of a label
    that sorts its candidates gets as many rows from a large table as from a small one.
    """
    order = W.partitionBy("y").orderBy("h", "k")
    part = F.split(F.trim("x"), r"\s+", -1)
    begin = F.greatest(F.lit(1), F.floor((F.size("w") - words_each) / 2).cast("int") + 1)
    labelled = docs.select(
        F.col(key).alias("k"), F.col(label).cast("string").alias("y"), F.col(text).alias("x"), F.xxhash64(key).alias("h")
    ).filter("y is not null and x is not null and length(x) > 0")
    # One row per label, as many as the model has anyway.
    counts = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    if not counts:
        return fit([])
    share = F.create_map(*[F.lit(x) for y, n in sorted(counts.items()) for x in (y, min(1.0, 4.0 * docs_each / n))])
    thin = F.pmod("h", F.lit(1 << 31)) < F.element_at(share, F.col("y")) * F.lit(1 << 31)
    sample = (
        labelled.filter(thin)
        .withColumn("w", part).select("k", "y", "h", F.slice("w", begin, F.lit(words_each)).alias("w"))
        .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= docs_each).select("k", "y", "w")
    )
    rows = sorted(sample.collect(), key=lambda r: (r["y"], str(r["k"]), r["w"]))
    return fit([(words(" ".join(r["w"])), r["y"]) for r in rows], **how)


def label_texts(texts: list[str], model: Model) -> list[tuple[str, float]]:
    """(language, mean probability of its label) of each text; ('und', 0.0) for one without letters."""
    split = [words(t) for t in texts]
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    if not model.labels:
        return out
    at = 0
    while at < len(split):
        end, size = at, 0
        while end < len(split) and (end == at or size + len(split[end]) <= TOGETHER):
            size += len(split[end])
            end += 1
        some = [k for k in range(at, end) if split[k]]
        if some:
            codes, vocabulary = pd.factorize(np.array([w for k in some for w in split[k]], object))
            lengths = np.array([len(split[k]) for k in some])
            probs = marginals(_scores(list(vocabulary), model)[codes], lengths, model.transitions)
            sums = np.add.reduceat(probs, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
            for k, best, mean in zip(some, sums.argmax(1).tolist(), sums.max(1).tolist()):
                out[k] = (model.labels[best], min(1.0, mean))
        at = end
    return out


def label_words(text: str, model: Model) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of one text."""
    found = words(text)
    if not found or not model.labels:
        return []
    codes, vocabulary = pd.factorize(np.array(found, object))
    probs = marginals(_scores(list(vocabulary), model)[codes], np.array([len(found)]), model.transitions)
    return [(w, model.labels[b], float(p)) for w, b, p in zip(found, probs.argmax(1), probs.max(1))]


def predict(docs: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score",
            keep_text: bool = False) -> DataFrame:
    """Replace the text by its language and score, or add them to it; columns named like the new ones are replaced.

    The model is broadcast: its size is fixed by the numbers of buckets and of lexicon entries.  A text that is null or
    has no letter is 'und' with score 0, and so is every text under a model without labels.
    """
    gone = (label, score) if keep_text else (text, label, score)
    keep = [f for f in docs.schema.fields if f.name not in gone]
    schema = T.StructType([*keep, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = label_texts([v or "" for v in batch.column(text).to_pylist()], shared.value)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(f.name) for f in keep), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
            names=schema.names,
        )

    used = dict.fromkeys([text, *(f.name for f in keep)])
    return map_batches(docs.select(*[f"`{c}`" for c in used]), run, schema)
