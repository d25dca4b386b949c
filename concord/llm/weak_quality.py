"""Quality classifier from weak labels (operator 2).

Heuristic labellers vote good, bad or nothing on every document.  Their
accuracies are unknown and their votes overlap; expectation-maximisation
over the counts of all vote patterns (at most 3 ** number of labellers, so
they fit the driver whatever the corpus) estimates, per labeller, how often
it accuses bad and good documents, and the share of good ones.
The posterior of its votes is a document's soft label.

Soft labels of a bounded sample of ``TRAIN`` documents train a linear scorer
over ``2 ** BITS`` hashed features (shapes of words and steps of a few
shares).  The scorer, not the labellers, judges every document, so it also
covers documents on which the labellers abstain.

Defined results: a null or empty text has no features and gets the scorer's
intercept; repeated rows are counted and scored each; a null id stays null;
with no documents nothing is learned and no row returned; columns other than
id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, ship_package, texts
from .quality_rules import Text

TRAIN = 4000        # documents whose soft labels train the scorer, at most twice as many
BITS = 16
MOST_WRONG = 0.02   # of its votes on good documents, a labeller accuses at most
GOOD, BAD, NONE = 2, 1, 0


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else NONE


LABELLERS: dict[str, Callable[[Text], int]] = {
    "signs": lambda t: _vote(4 * t.n_symbols > t.n_words, t.n_words > 0 and 50 * t.n_symbols < t.n_words),
    "shouting": lambda t: _vote(2 * t.upper[1] > t.upper[0], 5 * t.upper[1] < t.upper[0]),
    "windows": lambda t: _vote(10 * t.n_repeat_words > 4 * t.n_words, t.n_words >= 50 and 20 * t.n_repeat_words < t.n_words),
    "lines": lambda t: _vote(3 * t.n_dup_lines > len(t.lines), len(t.lines) >= 4 and not t.n_dup_lines),
    "one_word": lambda t: _vote(t.n_words >= 8 and 10 * t.top_word > 3 * t.n_words, t.n_words >= 30 and 20 * t.top_word < 3 * t.n_words),
    "letters": lambda t: _vote(10 * t.letters < 7 * t.word_chars, 20 * t.letters > 17 * t.word_chars),
    "variety": lambda t: _vote(t.n_words >= 30 and 4 * _distinct(t) < t.n_words, 30 <= t.n_words <= 1000 and 2 * _distinct(t) > t.n_words),
}


def _distinct(t: Text) -> int:
    return int(t.word_numbers.max()) + 1 if t.n_words else 0


def votes(t: Text) -> int:
    """The vote pattern as one number, base 3."""
    code = 0
    for f in LABELLERS.values():
        code = 3 * code + f(t)
    return code


def unpack(codes: np.ndarray) -> np.ndarray:
    """(patterns, labellers) of vote patterns."""
    n = len(LABELLERS)
    return codes[:, None] // 3 ** np.arange(n - 1, -1, -1) % 3


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, rounds: int = 200, most_wrong: float = MOST_WRONG) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good per pattern, per labeller the rate of bad votes
    among its votes on [bad, good] documents).

    An abstention says nothing.  Labellers find different faults, so most of
    them pass most bad documents, and without a bound the two classes could
    settle on one kind of fault against all others; a labeller is therefore
    taken to accuse a good document at most ``most_wrong`` of the time."""
    v = unpack(codes)
    accused = (v == BAD).sum(1)
    good = np.where(accused > 0, 0.3 ** accused, 0.9)
    rates = np.zeros((2, v.shape[1]))
    for _ in range(rounds):
        for k, weight in enumerate((counts * (1 - good), counts * good)):
            bad = ((v == BAD) * weight[:, None]).sum(0) + 0.5
            rates[k] = bad / (bad + ((v == GOOD) * weight[:, None]).sum(0) + 0.5)
        rates[0] = np.clip(rates[0], most_wrong, 0.999)
        rates[1] = np.clip(rates[1], 1e-4, most_wrong)
        prior = np.clip((counts * good).sum() / counts.sum(), 0.01, 0.99)
        log = [np.log(p) + ((v == BAD) * np.log(r) + (v == GOOD) * np.log(1 - r)).sum(1) for p, r in ((1 - prior, rates[0]), (prior, rates[1]))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return good, rates


def features(t: Text) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their weights (unit length): the shapes of words
    (capitals, letters, digits and signs; and without the middle), and steps
    of the text's repetition and letter shares."""
    seen: Counter = Counter()
    for shape, n in Counter(t.raw.translate(_SHAPES).split()).items():
        seen[zlib.crc32(shape) >> (32 - BITS)] += n
        seen[zlib.crc32(shape[:1] + b"|" + shape[-1:], 7) >> (32 - BITS)] += n
    words = max(1, t.n_words)
    shares = (t.n_repeat_words / words, t.n_dup_lines / max(1, len(t.lines)), t.top_word / words if words >= 8 else 0, t.letters / max(1, t.word_chars))
    for k, share in enumerate(shares):
        seen[zlib.crc32(b"%d" % int(8 * share), 13 + k) >> (32 - BITS)] += 1 + t.n_words // 8
    at = np.fromiter(seen.keys(), np.int64, len(seen))
    x = np.sqrt(np.fromiter(seen.values(), np.float64, len(seen)))
    return at, x / max(np.linalg.norm(x), 1e-12)


_SHAPES = bytes(ord("A") if 65 <= i <= 90 else ord("a") if 97 <= i <= 122 or i >= 128 else ord("0") if 48 <= i <= 57 else i for i in range(256))


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 300, l2: float = 1e-5) -> np.ndarray:
    """Weights (intercept last) of a logistic regression on soft labels, by
    full gradients with AdaGrad steps."""
    size = 1 << BITS
    w = np.zeros(size + 1)
    if not rows:
        return w
    at = np.concatenate([a for a, _ in rows])
    x = np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    history = np.full(size + 1, 1e-8)
    for _ in range(epochs):
        z = np.bincount(owner, weights=w[at] * x, minlength=len(rows)) + w[size]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / len(rows)
        g = np.append(np.bincount(at, weights=error[owner] * x, minlength=size), error.sum())
        g[:size] += l2 * w[:size]
        history += g * g
        w -= 0.5 * g / np.sqrt(history)
    return w


def classify(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``score`` (scorer's probability of good),
    ``weak_label`` (posterior of its votes), ``kept`` (score of at least a half)."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = texts(docs, text, key)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, n = np.unique(np.array([votes(Text(t)) for t in b.column(0).to_pylist()], dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

    patterns = rows.select("text").mapInArrow(vote, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    codes, counts = np.array([r[0] for r in patterns], np.int64), np.array([r[1] for r in patterns], np.float64)
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    posterior = expectation_maximisation(codes, counts)[0] if len(codes) else np.zeros(0)
    label = dict(zip(codes.tolist(), posterior.tolist()))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_texts = [Text(t) for t in b.column(0).to_pylist()]
            found = [features(t) for t in all_texts]
            yield pa.RecordBatch.from_arrays([
                pa.array([label[votes(t)] for t in all_texts], pa.float64()), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()),
                pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())], names=["y", "at", "x"])

    total = max(1, int(counts.sum()))
    chosen = hash_sample(rows, ["doc_id", "text"], TRAIN, total)
    sample = sorted(tuple(r) for r in chosen.select("text").mapInArrow(sampled, "y double, at binary, x binary").collect())
    w = train_scorer([(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64)) for _, a, x in sample], np.array([y for y, _, _ in sample]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, labels = np.zeros(len(b)), np.zeros(len(b))
            for i, raw in enumerate(b.column(1).to_pylist()):
                t = Text(raw)
                at, x = features(t)
                scores[i] = 1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -50, 50)))
                labels[i] = label[votes(t)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(labels), pa.array(scores >= 0.5)],
                                             names=["doc_id", "score", "weak_label", "kept"])

    return rows.mapInArrow(judge, "doc_id bigint, score double, weak_label double, kept boolean")
