"""Toxicity of documents by a support vector machine over a gapped subsequence kernel.

Two words are alike as far as they share subsequences of three letters, each weighed by a decay for every
letter it spans, so inserted letters and gaps cost a little and do not hide a word. The kernel is replaced by
its projection on landmark words (Nystroem), a linear machine is trained there on the words of labelled
sentences, and its weights are folded back onto subsequences, which makes scoring a sum over a word's own.
A sentence is as toxic as its worst word, a document as its worst sentence.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carestrata.llm import hashing
from carestrata.llm.memory import only
from carestrata.llm.merge_replay import batches_of
from carestrata.llm.tables import Workspace, joined

ALPHABET = 64
SPAN = 6
DECAY = 0.7
LONGEST = 24
#: Characters of words that a worker remembers with their margins.
REMEMBERED = 4_000_000
#: Characters of text taken apart at once.
TEXT_AT_ONCE = 1 << 20

_patterns = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_weights = np.array([DECAY ** (b + 1 - 3) for _, b in _patterns])
_spelled = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
#: The last two letters of such a run: quicker to look for, and rare in ordinary text.
_spelled_end = re.compile(r"[ \t]\S[ \t]\S(?!\S)")
_inner = re.compile(r"[\W\d_]+")


def tokens(text: str) -> list[str]:
    """Distinct words of a text in lower case; letters set apart by single spaces are also read together."""
    text = text.lower()
    found = text.split()
    if _spelled_end.search(text):
        found += ["".join(run.split()) for run in _spelled.findall(text)]
    return list(set(found))


def letters(word: str) -> str:
    """The word without anything but letters: marks and digits inside do not break it up."""
    return word if word.isalpha() else _inner.sub("", word)


def windows(word: str) -> list[str]:
    """A very long word as overlapping stretches."""
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return [word[i:i + LONGEST] for i in range(0, len(word) - step, step)]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences of all words: row, code and weight, summed over equal codes of a row, rows at length one."""
    width = max([3, *map(len, words)])
    n = len(words)
    codes = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(n, width)
    plain = (codes >= 97) & (codes <= 122)
    symbols = np.where(codes == 0, 0, np.where(plain, codes - 96, 27 + codes % 37)).astype(np.int64)
    parts, weights = [], []
    for (a, b), weight in zip(_patterns, _weights):
        if b >= width:
            continue
        first, middle, last = symbols[:, :width - b], symbols[:, a:width - b + a], symbols[:, b:]
        code = (first * ALPHABET + middle) * ALPHABET + last
        parts.append(np.where(last > 0, code, -1))
        weights.append(np.full(width - b, weight))
    code, weight = np.concatenate(parts, axis=1), np.concatenate(weights)
    rows, columns = np.nonzero(code >= 0)
    keys = rows * ALPHABET ** 3 + code[rows, columns]
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[columns[order]]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, starts) if len(starts) else np.zeros(0)
    keys = keys[starts]
    rows, codes = keys // ALPHABET ** 3, keys % ALPHABET ** 3
    norms = np.sqrt(np.bincount(rows, weight ** 2, minlength=n))
    return rows, codes, weight / norms[rows]


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised kernel of every left word with every right word."""
    out = np.zeros((len(left), len(right)))
    table = np.zeros((ALPHABET ** 3, len(right)), np.float32)
    rows, codes, weights = features(right)
    table[codes, rows] = weights
    for at in range(0, len(left), 500):
        rows, codes, weights = features(left[at:at + 500])
        np.add.at(out, at + rows, table[codes] * weights[:, None])
    return out


def train(positive: list[str], negative: list[str], landmarks: int = 160, ridge: float = 1e-5) -> np.ndarray:
    """Weight of every subsequence, and last the bias, of a squared-hinge machine on landmark features."""
    def spread(words: list[str], count: int) -> list[str]:
        """Words far from each other in the kernel, the first ones first."""
        pool = words[:1500]
        chosen, close = [0], kernel(pool, pool[:1])[:, 0]
        while len(chosen) < min(count, len(pool)):
            chosen.append(int(close.argmin()))
            close = np.maximum(close, kernel(pool, [pool[chosen[-1]]])[:, 0])
        return [pool[i] for i in dict.fromkeys(chosen)]

    marks = spread(positive, landmarks // 2) + spread(negative, landmarks - landmarks // 2)
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    words = positive + negative
    x = np.column_stack((kernel(words, marks) @ root, np.ones(len(words))))
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    cost = np.r_[np.full(len(positive), 0.5 / len(positive)), np.full(len(negative), 0.5 / len(negative))]
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-9
    for _ in range(50):
        active = y * (x @ w) < 1
        a = x[active] * cost[active, None]
        new = np.linalg.solve(x[active].T @ a + penalty, a.T @ y[active])
        if np.allclose(new, w, atol=1e-10):
            break
        w = new
    rows, codes, weights = features(marks)
    folded = np.bincount(codes, (root @ w[:-1])[rows] * weights, minlength=ALPHABET ** 3)
    return np.r_[folded, w[-1]].astype(np.float32)


class Scorer:
    """Margins of words, remembered, and of texts."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.known: dict[str, float] = {}
        self.held = 0

    def learn(self, words: list[str]) -> None:
        bias = float(self.weights[-1])
        spelled = [letters(w) for w in words]
        for at in range(0, len(words), 4000):
            some, owner = [], []
            for i, word in enumerate(spelled[at:at + 4000]):
                for part in windows(word):
                    some.append(part)
                    owner.append(i)
            rows, codes, weights = features(some)
            margin = np.bincount(rows, self.weights[codes] * weights, minlength=len(some))
            best = np.full(min(4000, len(words) - at), -np.inf)
            np.maximum.at(best, owner, margin)
            self.known.update(zip(words[at:at + 4000], (best + bias).tolist()))

    def texts(self, texts: list[str]) -> list[tuple[float, str]]:
        """Margin of each text's worst word, and the word; no words: minus infinity."""
        parts = [tokens(t) for t in texts]
        words = set().union(*parts)
        new = [w for w in words if w not in self.known]
        if self.held > REMEMBERED:
            self.known, self.held, new = {}, 0, list(words)
        self.held += sum(map(len, new))
        self.learn(sorted(new, key=len))
        return [self.worst(part) for part in parts]

    def worst(self, words: list[str]) -> tuple[float, str]:
        """Highest margin of known words and the word that has it, the last in order of those that tie."""
        if not words:
            return -np.inf, ""
        margins = [self.known[w] for w in words]
        highest = max(margins)
        if margins.count(highest) == 1:
            return highest, words[margins.index(highest)]
        return highest, max(w for w, margin in zip(words, margins) if margin == highest)


def _scorer(weights: bytes) -> Scorer:
    return only(("string kernel", weights), lambda: Scorer(np.frombuffer(weights, np.float32)))


def _words(batches):
    for batch in batches:
        texts, labels = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
        for first, some in batches_of(texts, TEXT_AT_ONCE):
            words, marks = [], []
            for label, text in zip(labels[first:], some):
                own = {letters(w) for w in tokens(text)}
                words += own
                marks += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(marks, pa.int32())], ["word", "toxic"])


def _marks(batches):
    """Three MinHash values of each text's shingles, null without any: near copies have most of them in common."""
    for batch in batches:
        for row, data, offsets in hashing.pieces(batch.column(1)):
            starts, ends, first = hashing.words(data, offsets)
            grams = hashing.shingles(hashing.hash_spans(data, starts, ends), 3)
            texts = len(offsets) - 1
            least, none = np.zeros((3, texts), np.int64), first[1:] - first[:-1] < 3
            for i in range(texts):
                own = grams[first[i]:max(first[i], first[i + 1] - 2)]
                for k in range(3 if len(own) else 0):
                    least[k, i] = hashing.signed(hashing.mix(own ^ np.uint64(k * 7919)).min(keepdims=True))[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, texts), *(pa.array(m, mask=none) for m in least)], ["doc_id", "m0", "m1", "m2"])


def without_copies(work: Workspace, sample: DataFrame) -> DataFrame:
    """One document, that of smallest doc_id, of those with the same label and the same three marks: copied words are
    no evidence of their own.

    One equal mark is common among unlike texts; three are not. Texts of fewer than three words have no marks and all
    stay."""
    marks = sample.select("doc_id", "text").mapInArrow(_marks, "doc_id long, m0 long, m1 long, m2 long")
    marks = work.cut(marks.join(sample.select("doc_id", "toxic").distinct(), "doc_id"))
    first = marks.filter("m0 is not null").groupBy("toxic", "m0", "m1", "m2").agg(F.min("doc_id").alias("doc_id"))
    kept = first.select("doc_id").union(marks.filter("m0 is null").select("doc_id")).distinct()
    return work.cut(sample.join(kept, "doc_id"))


def _worst(weights: bytes):
    def run(batches):
        scorer = _scorer(weights)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, some in batches_of(texts, TEXT_AT_ONCE):
                found = scorer.texts(some)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(some)), pa.array([max(m, -9.0) for m, _ in found], pa.float64()),
                     pa.array([w for _, w in found], pa.string())], ["toxic", "margin", "word"])
    return run


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, with labels drawn in a little."""
    x = np.column_stack((margin, np.ones(len(margin))))
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class Model:
    """Weights of subsequences and the map from margins to scores."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights.tobytes(), slope, offset


def fit(work: Workspace, docs: DataFrame, labels: DataFrame, sample_rows: int, rounds: int = 2) -> Model | None:
    """Train on at most about ``sample_rows`` labelled documents, chosen by a hash of doc_id; None without both labels."""
    rows = labels.count()
    share = min(1.0, sample_rows / max(rows, 1))
    chosen = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = work.cut(chosen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    sample = work.cut(joined(docs.select("doc_id", "text"), chosen.withColumnRenamed("doc_id", "l_id"),
                             F.col("doc_id") == F.col("l_id"), "inner").select("doc_id", "toxic", "text"))
    sample = without_copies(work, sample)
    sizes = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return None
    rate = toxic / (toxic + clean)
    counts = work.cut(sample.select("toxic", "text").mapInArrow(_words, "word string, toxic int")
                      .filter(F.length("word") >= 3).groupBy("word")
                      .agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("n")))
    vocabulary = max(counts.count(), 2)
    p, n = F.col("p"), F.col("n")
    part = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    gain = part(p, F.lit(rate)) + part(n - p, F.lit(1 - rate))
    scored = counts.filter(p > 0.7 * n).withColumn("gain", gain)
    strong = scored.orderBy(F.desc("gain"), "word").limit(1500).collect()
    # words that toxic documents have by more than chance over the whole vocabulary; the best ten for want of any
    sure = [r["word"] for r in strong if r["gain"] > np.log(10.0 * vocabulary)]
    positive = sure or [r["word"] for r in strong[:10]]
    common = counts.filter("p < n").orderBy(F.desc(n - p), "word").limit(3000)
    mixed = counts.filter("p = 0").orderBy(F.xxhash64("word"), "word").limit(4000)
    negative = [r["word"] for r in common.union(mixed).select("word").distinct().orderBy("word").collect()]
    negative = [w for w in negative if w not in set(positive)]
    if not positive or not negative:
        return None
    for _ in range(rounds):
        weights = train(positive, negative)
        worst = sample.select("toxic", "text").mapInArrow(_worst(weights.tobytes()), "toxic int, margin double, word string").collect()
        hard = {letters(r["word"]) for r in worst if r["toxic"] == 0 and r["margin"] > -0.5}
        more = sorted(x for h in hard if len(h) >= 3 for x in windows(h))[:4000]
        if not more:
            break
        negative = list(dict.fromkeys(negative + more))
        positive = [w for w in positive if w not in hard] or positive
    else:
        weights = train(positive, negative)
        worst = sample.select("toxic", "text").mapInArrow(_worst(weights.tobytes()), "toxic int, margin double, word string").collect()
    slope, offset = _logistic(np.array([r["margin"] for r in worst]), np.array([r["toxic"] for r in worst]))
    return Model(weights, slope, offset)


def _score(model: Model, threshold: float, carried: str | None):
    """Scores of a batch; the text is a column of its own, or the ``carried`` field of the row."""
    def run(batches):
        scorer = _scorer(model.weights)
        for batch in batches:
            column = batch.column("row").field(carried) if carried else batch.column("text")
            texts = [t or "" for t in column.to_pylist()]
            for first, some in batches_of(texts, TEXT_AT_ONCE):
                found = scorer.texts(some)
                margin = np.array([max(m, -9.0) for m, _ in found])
                score = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, len(some)).cast(pa.int64()),
                    batch.column("held_out").slice(first, len(some)), pa.array(score),
                    pa.array((score >= threshold).astype(np.int32)), pa.array([w for _, w in found], pa.string()),
                    batch.column("row").slice(first, len(some))],
                    ["doc_id", "held_out", "score", "predicted", "worst_word", "row"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", *,
             threshold: float = 0.3, sample_rows: int = 20_000, carry: list[str] | None = None) -> DataFrame:
    """Score of every whole text: doc_id, held_out, score, predicted, worst_word and ``row`` of the ``carry`` columns.

    held_out: crc32(doc_id as text) mod 4 is 2; such labels are never read. At most about ``sample_rows`` other
    labels are, chosen by a hash of doc_id; several labels of one document count as the highest. The score
    depends on the text alone. Texts without words (null, empty) get the lowest score. A null doc_id is not
    held out. Without labels of both kinds every score is 0. Repeated rows score alike; other columns are
    ignored; an empty table gives an empty result. Only weights (1 MB) go to the tasks; nothing is shuffled to score.
    """
    work = Workspace(docs.sparkSession)
    held_out = F.coalesce(F.crc32(docs[doc_id].cast("string")) % 4 == 2, F.lit(False))
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), held_out.alias("held_out"),
                         F.struct(*[docs[c].alias(c) for c in carry or [doc_id]]).alias("row"))
    seen = labels.select(labels[doc_id].alias("doc_id"), labels[label].alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    model = fit(work, source, seen, sample_rows)
    work.drop(*[frame for frame, _ in work.paths])
    if model is None:
        return source.select(F.col("doc_id").cast("long"), "held_out", F.lit(0.0).alias("score"),
                             F.lit(0).alias("predicted"), F.lit("").alias("worst_word"), "row")
    row_type = source.schema["row"].dataType.simpleString()
    carried = text if carry and text in carry else None
    return source.select("doc_id", "held_out", "row", *[] if carried else ["text"]).mapInArrow(
        _score(model, threshold, carried), f"doc_id long, held_out boolean, score double, predicted int, worst_word string, row {row_type}")
