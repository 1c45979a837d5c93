"""Quality classifier: a linear-chain conditional random field over lines.

Every line gets features of its bytes and words (shares of byte classes, word lengths, repeats), binned at quantiles of the
training lines. A two-state chain (bad, good) scores each line by its own bins and those of the lines before and after
it, and each step by a transition. It is trained by gradient ascent on documents whose lines all carry the document's
label, each document with the same weight. A document's quality is the mean of its lines' forward-backward marginals
weighted by line length, calibrated by a logistic curve on the training documents.

Training rows: at most SAMPLE of each label, chosen by a hash of the id, never of the held-out fold. Scores use the text only.
Null and empty texts are one empty line; very long ones are scored whole. Without labels every score is the same. Equal texts get equal scores, so ties
are theirs. Rows with a null id, or one that is no number, are scored, not held out, and come back with a null id. Repeated rows give repeated
rows, an empty table an empty table. Other columns are not read.
As all lines of a training document carry its label, the moves that the chain learns are those that stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, WordHashes, chunks, mix, text_bytes
from glossa.llm.labelled import held_out, logistic, priors, sample, sigmoid

#: Labelled rows of each label that the model is fitted on, at most; gradient steps.
SAMPLE, STEPS = 1500, 150
THRESHOLD = 0.3
FEATURES = ["length", "lower", "upper", "digit", "stop", "bang", "other_mark", "symbol", "bar", "high", "words", "word_length", "distinct", "again", "line_again", "ends_stop", "capital_words"]
CUTS = 7
#: Byte classes. Fixed values.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!", b"?;:'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", b"|"]
CLASS = np.full(256, 9, np.uint8)
CLASS[128:] = 8
for _k, _bytes in enumerate(CLASSES):
    CLASS[list(_bytes)] = _k
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\x0b\x0c\r")] = True


def line_features(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text; each line's weight; its features."""
    data = b"\n".join(texts) + b"\n"
    flat = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(flat == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lines = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), lines)
    size = (ends - starts).astype(np.float64)
    n = np.maximum(size, 1)
    kinds = CLASS[flat]
    counts = [np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(9)]
    blank = BLANK[flat]
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    per_line = np.diff(np.searchsorted(begins, np.concatenate([starts, [len(flat)]])))
    line_of = np.repeat(np.arange(len(starts)), per_line)
    h = hashes.array(data.split())
    words = np.maximum(per_line, 1).astype(np.float64)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    again = np.bincount(line_of[same], minlength=len(starts))
    key = np.sort((line_of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(starts))
    capital = np.bincount(line_of[kinds[begins] == 1], minlength=len(starts))
    # lines that their document holds more than once
    first_word = np.cumsum(per_line) - per_line
    turned = mix(h + (np.arange(len(h)) - np.repeat(first_word, per_line)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(turned, dtype=np.uint64)])
    line_hash = mix(total[first_word + per_line] - total[first_word] + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, where, times = np.unique(line_hash, return_inverse=True, return_counts=True)
    repeated = (times[where] > 1) & (per_line > 0)
    last = flat[np.maximum(ends - 1, 0)]
    ends_stop = np.isin(last, list(b".!?")) & (size > 0)
    letters = np.maximum(counts[0] + counts[1] + counts[8], 1)
    x = np.column_stack([
        np.log1p(size), counts[0] / n, counts[1] / letters, counts[2] / n, counts[3] / n, counts[4] / n, counts[5] / n, counts[6] / n, counts[7] / n, counts[8] / n,
        np.log1p(per_line), size / words, distinct / words, again / words, repeated, ends_stop, capital / words,
    ])
    return lines, size + 1, x


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """Where each feature is cut: just above zero and at quantiles."""
    return [np.unique(np.concatenate([[1e-9], np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1])])) for k in range(x.shape[1])] if len(x) else [np.array([1e-9])] * len(FEATURES)


BINS = CUTS + 3


def bins_of(x: np.ndarray, cuts: list[np.ndarray], lines: np.ndarray) -> np.ndarray:
    """(lines, 3 * features) indexes of weights: own bins, those of the line before and of the line after (0: none)."""
    own = np.stack([np.searchsorted(c, x[:, k], "right") + 1 for k, c in enumerate(cuts)], axis=1)
    first = np.cumsum(lines) - lines
    before = np.roll(own, 1, axis=0)
    before[first] = 0
    after = np.roll(own, -1, axis=0)
    after[first + lines - 1] = 0
    return np.concatenate([own, before, after], axis=1) + BINS * np.arange(3 * len(cuts))


class Chains:
    """Forward-backward over chains of several lengths, step by step for all at once."""

    def __init__(self, lines: np.ndarray):
        self.lines = lines
        self.order = np.argsort(-lines, kind="stable")
        self.sorted = lines[self.order]
        self.first = (np.cumsum(lines) - lines)[self.order]
        self.last = self.first + self.sorted - 1
        longest = int(self.sorted[0]) if len(lines) else 0
        self.live = np.searchsorted(-self.sorted, -np.arange(longest), side="left")

    def run(self, theta: np.ndarray, move: np.ndarray, pairs: bool = False):
        """Marginals of state 1 at each place; with pairs also the expected moves of each place after the first, (places, 2, 2)."""
        n = len(theta)
        score = np.stack([np.zeros(n), theta], axis=1)
        alpha, beta = score.copy(), np.zeros((n, 2))
        for t in range(1, len(self.live)):
            at = self.first[: self.live[t]] + t
            a = alpha[at - 1]
            alpha[at] += np.logaddexp(a[:, :1] + move[0], a[:, 1:] + move[1])
        for t in range(len(self.live) - 2, -1, -1):
            at = self.first[: self.live[t + 1]] + t
            b = beta[at + 1] + score[at + 1]
            beta[at] = np.logaddexp(b[:, :1] + move[:, 0], b[:, 1:] + move[:, 1])
        whole = np.empty(len(self.lines))
        whole[self.order] = np.logaddexp(alpha[self.last, 0], alpha[self.last, 1])
        norm = np.repeat(whole, self.lines)
        p = np.exp(alpha[:, 1] + beta[:, 1] - norm)
        if not pairs:
            return p
        inner = np.ones(n, bool)
        inner[self.first] = False
        at = np.flatnonzero(inner)
        both = alpha[at - 1][:, :, None] + move + (beta[at] + score[at])[:, None, :] - norm[at][:, None, None]
        return p, at, np.exp(both)


class Model:
    """Weights of the chain and of the calibration."""

    def __init__(self, cuts, weights, move, curve):
        self.cuts, self.weights, self.move, self.curve = cuts, weights, move, curve

    def margins(self, texts: list[bytes], hashes: WordHashes) -> np.ndarray:
        """Length-weighted mean marginals as log odds."""
        lines, size, x = line_features(texts, hashes)
        theta = self.weights[bins_of(x, self.cuts, lines)].sum(axis=1)
        p = Chains(lines).run(theta, self.move)
        first = np.cumsum(lines) - lines
        m = np.clip(np.add.reduceat(p * size, first) / np.add.reduceat(size, first), 1e-4, 1 - 1e-4)
        return np.log(m / (1 - m))

    def scores(self, texts: list[bytes], hashes: WordHashes) -> np.ndarray:
        return sigmoid(self.curve[0] * self.margins(texts, hashes) + self.curve[1])


def fit(texts: list[bytes], y: np.ndarray, prior: float) -> Model:
    """The chain and its calibration from labelled texts."""
    if not len(y) or y.min() == y.max():
        return Model([np.array([1e-9])] * len(FEATURES), np.zeros(3 * len(FEATURES) * BINS), np.zeros((2, 2)), np.array([0.0, np.log(prior / (1 - prior))]))
    hashes = WordHashes()
    lines, _, x = line_features(texts, hashes)
    cuts = cuts_of(x)
    bins = bins_of(x, cuts, lines)
    chains = Chains(lines)
    weight = np.repeat(1.0 / lines, lines)
    weight /= weight.sum()
    target = np.repeat(y, lines)
    w, move = np.zeros(3 * len(FEATURES) * BINS), np.zeros((2, 2))
    slow = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
    for step in range(1, STEPS + 1):
        p, at, both = chains.run(w[bins].sum(axis=1), move, True)
        g = np.bincount(bins.ravel(), np.repeat(weight * (target - p), bins.shape[1]), len(w)) - 1e-4 * w
        observed = np.zeros((2, 2))
        np.add.at(observed, (target[at], target[at]), weight[at])
        g_move = observed - (both * weight[at][:, None, None]).sum(axis=0) - 1e-3 * move
        for value, grad, a, b in ((w, g, 0, 1), (move, g_move, 2, 3)):
            slow[a] = 0.9 * slow[a] + 0.1 * grad
            slow[b] = 0.99 * slow[b] + 0.01 * grad**2
            value += 0.1 * (slow[a] / (1 - 0.9**step)) / (np.sqrt(slow[b] / (1 - 0.99**step)) + 1e-6)
    model = Model(cuts, w, move, np.array([1.0, 0.0]))
    share = y.mean()
    odds = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    curve = logistic(model.margins(texts, hashes)[:, None], y.astype(float), odds, ridge=0.1)
    model.curve = curve
    return model


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch, texts in chunks(batches, "text", 1 << 20):
            s = model.scores(texts, hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], schema=schema)

    rows = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def train_quality(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> Model:
    """The model from at most `each` training rows of each label."""
    scratch = Scratch(docs.sparkSession)
    rows = sample(docs, labels, "quality", each, scratch).toArrow().sort_by([("d", "ascending"), ("text", "ascending")])
    return fit(text_bytes(rows["text"].combine_chunks()), np.asarray(rows["y"].combine_chunks()).astype(np.int64), priors(labels, "quality"))


def op9_crf_quality(spark, sf_dir):
    """All documents scored for quality."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, train_quality(docs, labels))


QUERIES = {"op9_crf_quality": op9_crf_quality}
SQL: dict[str, str] = {}
