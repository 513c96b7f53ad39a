"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with marks for its ends) and itself, hashed to buckets that each have a vector. So an unseen
misspelling or ending shares most vectors with the words it comes from. The vectors of a bag are averaged and go through a linear
softmax of two classes. A text is as toxic as its most toxic word, so one insult counts the same in a short text and in a very
long one. Vectors and softmax are trained jointly, in numpy, on a bounded sample of labelled texts: while training, the words of a
text are weighted by their own scores, evenly at first and ever more sharply, up to the maximum that scoring takes.

Averaging and softmax are linear up to the last step, so scoring needs one number per bucket: its vector times the difference of
the two softmax weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import lean, slices, stored

#: Most labelled texts, and most characters of them, that the model is fitted on. The texts with the smallest hashes are taken.
MAX_TEXTS = 2_000
MAX_CHARS = 6_500_000
BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
REJECT = 0.3
#: Bytes of text that a task scores at once.
_SLICE = 1 << 20
#: Buckets that fewer texts of the sample have stay at zero.
MIN_TEXTS = 5
_ROUNDS = 80
_AT_ONCE = 20_000
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_EDGES = "\"'.,;:!?()[]{}<>|*#&%$@^~`+-=_/\\"


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the n-grams of all words and of the words themselves, in order of the owners; each word has one at least.

    ASCII punctuation at the ends of a word does not count, unless it is all there is. All words are hashed at once.
    """
    marked = [f"<{w.strip(_EDGES) or w}>" for w in words]
    size = np.array([len(m) for m in marked])
    code = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(end, size) - np.arange(len(code))
    power = _ODD ** np.arange(int(size.max()) + 1, dtype=np.uint64)
    owners, hashes = [np.arange(len(words))], [np.add.reduceat(code * power[left], end - size)]
    gram = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        gram = gram[:len(code) - n + 1] * _ODD + code[n - 1:]
        if n in GRAMS:
            whole = np.flatnonzero(left[:len(gram)] >= n)
            owners.append(owner[whole])
            hashes.append(gram[whole] + np.uint64(n))
        gram = gram[:-1]
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(31))) * _MIX
    order = np.argsort(owner, kind="stable")
    return owner[order], (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)[order]


def coded_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-case words of all texts, each different one held once, and where each text's words begin (and end). White space at
    the ends of a text gives empty words."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    return lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()


@dataclass
class Model:
    """One number per bucket, and the bias: the log odds of class 1 of a word are the mean over its buckets, plus the bias."""

    weight: np.ndarray
    bias: float


def train(sample: list[tuple[str, int]], seed: int = 7) -> Model:
    """Fit on (text, 0 or 1). Texts without words are passed over; with one class or none, scores are a constant."""
    # Numbers from the start: the driver holds no millions of strings.
    words, bounds = coded_words(pa.array([t for t, _ in sample], pa.string()))
    places = words.dictionary.to_pylist()
    token = words.indices.to_numpy().astype(np.int64)
    of_text = np.repeat(np.arange(len(sample)), np.diff(bounds))
    if "" in places:
        real = token != places.index("")
        token, of_text = token[real], of_text[real]
    kept, n_words = np.unique(of_text, return_counts=True)
    y = np.array([sample[i][1] for i in kept], float)
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    n_places = len(places)
    sizes, parts = [], []
    for start in range(0, n_places, _AT_ONCE):
        owner, bag = bags(places[start:start + _AT_ONCE])
        sizes.append(np.bincount(owner))
        parts.append(bag)
    size, bag = np.concatenate(sizes), np.concatenate(parts)
    del words, places, owner, parts
    first = np.cumsum(n_words) - n_words
    of_text = np.repeat(np.arange(len(y)), n_words)
    bag_start = np.cumsum(size) - size
    texts_with = np.bincount(np.unique(token * len(y) + of_text) // len(y), minlength=n_places)
    common = np.bincount(bag, np.repeat(texts_with, size), BUCKETS) >= MIN_TEXTS
    used = np.flatnonzero(common)
    bag = np.where(common, np.cumsum(common) - 1, len(used))[bag]  # the last vector is that of all rare buckets: zero
    # Each class weighs the same up to a factor; the threshold for rejection is below one half.
    balance = np.where(y == 1, min(4.0, (len(y) - y.sum()) / y.sum()), 1.0)

    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (len(used) + 1, DIM)).astype(np.float32)
    vectors[-1] = 0
    softmax = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, softmax, bias)]
    for turn in range(1, _ROUNDS + 1):
        sharp = 0.1 * 1.08 ** turn
        difference = softmax[:, 1] - softmax[:, 0]
        per_word = np.add.reduceat((vectors @ difference)[bag], bag_start) / size
        z = per_word[token] + bias[1] - bias[0]
        e = np.exp(sharp * (z - np.maximum.reduceat(z, first)[of_text]))
        share_of = e / np.add.reduceat(e, first)[of_text]
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(share_of * z, first), -30, 30)))
        slope = balance * (p - y) / len(y)
        to_word = np.bincount(token, slope[of_text] * share_of, n_places) / size
        to_bucket = np.bincount(bag, np.repeat(to_word, size), len(used) + 1).astype(np.float32)
        to_bucket[-1] = 0
        along = vectors.T @ to_bucket
        grads = (to_bucket[:, None] * difference[None, :], np.stack([-along, along], axis=1),
                 np.array([-slope.sum(), slope.sum()]))
        # Steps in the size of the usual gradient. Those of rare buckets stay small beside the largest: few texts teach little.
        for param, grad, (m, v), damp in zip((vectors, softmax, bias), grads, state, (0.1, 0, 0)):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.98
            v += 0.02 * grad * grad
            usual = np.sqrt(v / (1 - 0.98 ** turn))
            usual += damp * usual.max() + 1e-9
            param -= np.float32(0.08 / (1 - 0.9 ** turn)) * m / usual
    weight = np.zeros(BUCKETS)
    weight[used] = (vectors @ (softmax[:, 1] - softmax[:, 0]))[:-1]
    return Model(weight, float(bias[1] - bias[0]))


class Scorer:
    """Scores texts; one is made per task."""

    def __init__(self, model: Model) -> None:
        self._model = model

    def words(self, words: list[str]) -> np.ndarray:
        """Log odds of each word, without the bias; minus infinity for an empty one."""
        out = np.full(len(words), -np.inf)
        for start in range(0, len(words), _AT_ONCE):
            part = words[start:start + _AT_ONCE]
            owner, bucket = bags(part)
            out[start:start + len(part)] = np.bincount(owner, self._model.weight[bucket]) / np.bincount(owner)
        if "" in words:
            out[words.index("")] = -np.inf
        return out

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Probability of class 1 of each text; one without words has that of the bias alone."""
        words, bounds = coded_words(texts)
        value = self.words(words.dictionary.to_pylist())[words.indices.to_numpy()]
        log_odds = np.full(len(texts), self._model.bias)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            most = np.maximum.reduceat(value, bounds[some])
            log_odds[some] += np.where(np.isfinite(most), most, 0)
        return 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may be learnt from; a null id counts as one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_texts: int = MAX_TEXTS, max_chars: int = MAX_CHARS) -> Model:
    """Learn from labelled rows of ``docs`` (doc_id, text) that are not held out; ``labels`` has doc_id and toxic (0 or 1).

    Null labels and null texts are passed over. The ``max_texts`` labelled rows with the smallest hashes of their ids are taken, in that order until
    their texts have ``max_chars`` characters in all; texts longer than a fiftieth of that are left out, ids that repeat are taken once. Only
    these come to the driver.
    """
    known = (labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # The choice needs ids only; then one scan fetches the texts of the chosen ones.
    chosen = (known.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
              .orderBy("h", "doc_id").limit(max_texts))
    sample = stored(docs.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(chosen), "doc_id"), "labelled")
    taken, chars = [], 0
    sizes = sample.groupBy("h", "doc_id").agg(F.max(F.length("text")).alias("n")).where(F.col("n") <= max_chars // 50).orderBy("h", "doc_id")
    for row in sizes.collect():
        chars += row["n"]
        if chars > max_chars:
            break
        taken.append((row["doc_id"],))
    few = docs.sparkSession.createDataFrame(taken, "doc_id long")
    texts_of = (sample.where(F.length("text") <= max_chars // 50).join(F.broadcast(few), "doc_id")
                .groupBy("h", "doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("h", "doc_id"))
    return train([(r["text"], r["toxic"]) for r in texts_of.collect()])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one column more, ``name``; null and empty texts have a score too."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))  # one number per bucket
    at = docs.columns.index(text)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in (part for whole in stream for part in slices(whole, _SLICE, at)):
            made = pa.array(scorer(batch.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])
    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields]).add(name, DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; repeated rows each have one, an empty table gives none."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= reject).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` below the score ``reject``; all rows if nothing was learnt.

    That is so if the usable labels have fewer than two classes (or too few texts to train any bucket): the score is then one constant, which
    says nothing about a text.
    """
    model = fit(docs, labels)
    if not model.weight.any():
        return docs
    name = "score" + "_" * max(map(len, docs.columns))  # longer than any other
    return score(docs, model, name=name).where(F.col(name) < reject).select(*docs.columns)
