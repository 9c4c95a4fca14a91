"""Document quality from a linear-chain conditional random field over lines.

Every line is described by shares of character classes, by repeated words and by the same figures of its neighbouring lines; a
two-state chain labels it good or bad. Training starts from the documents' labels and relabels once the lines of bad documents that
the chain takes for good. The marginals of forward-backward, weighted by the length of lines, make the document's quality, and a
logistic regression on the half of the sample that the chain has not seen calibrates it.

All figures of a batch of texts are computed together on arrays of code points, and forward-backward runs over the documents of a
batch in step, so that the cost is a few array passes over the text.

Defined cases. Null and empty texts, and texts of white space, have no line to judge: their score is the share of good labels. Equal
texts have equal scores. Without a good or without a bad label every score is that share. Repeated rows stay repeated; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_share, map_arrow, sample_share, schema_ddl, split_of
from .toxicity import fit_logistic, learnable

#: Labelled rows that are learned from, at most (about; chosen by hash), lines of such a row, lines of all of them (about), and
#: lines of one training sequence. Longer labelled rows are not learned from; every row is scored on all of its lines.
FIT_ROWS, ROW_LINES, FIT_LINES, SEQUENCE = 6_000, 1_000, 300_000, 128
THRESHOLD = 0.7
ROUNDS, RELABEL_ROUNDS, RATE, RIDGE = 120, 60, 0.1, 1e-3

_UPPER, _LETTER, _DIGIT, _SPACE, _SYMBOL, _PIPE, _SHOUT, _STOP, _COMMA = (1 << i for i in range(9))
OWN = 13
#: The figures that are also taken from the lines before and after.
SHARED = (1, 2, 3, 4, 5, 6)


def _classes() -> np.ndarray:
    t = np.zeros(0x3000, np.uint16)
    for cp in range(len(t)):
        c = chr(cp)
        t[cp] = (_UPPER if c.isupper() else 0) | (_LETTER if c.isalpha() else 0) | (_DIGIT if c.isdigit() else 0) | (_SPACE if c.isspace() else 0)
    for chars, bit in (("#*$%&<>=~^_{}[]\\@", _SYMBOL), ("|", _PIPE), ("!?", _SHOUT), (".", _STOP), (",;:", _COMMA)):
        for c in chars:
            t[ord(c)] |= bit
    return t


_TABLE: list[np.ndarray] = []


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(figures of every line, its length without white space, the number of lines of each text)."""
    if not _TABLE:
        _TABLE.append(_classes())
    lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    cps = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _TABLE[0][np.minimum(cps, 0x2FFF)]
    kind = np.where(cps >= 0x2FFF, _LETTER, kind)
    starts = np.r_[0, np.flatnonzero(cps == 10)[:-1] + 1]
    count = lambda mask: np.add.reduceat(mask.astype(np.int32), starts).astype(np.float32)
    space = (kind & _SPACE) > 0
    n = np.add.reduceat((~space).astype(np.int32), starts).astype(np.float32)
    letters = count((kind & _LETTER) > 0)
    # words: a hash of each, by powers over the place in the word
    first = ~space & np.r_[True, space[:-1]]
    at = np.flatnonzero(first)
    of_line = np.searchsorted(starts, at, "right") - 1
    words = np.bincount(of_line, minlength=len(starts)).astype(np.float32)
    repeat = np.zeros(len(starts), np.float32)
    if len(at):
        place = np.arange(len(cps)) - np.repeat(np.r_[0, at], np.diff(np.r_[0, at, len(cps)]))
        powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)
        h = np.add.reduceat(np.where(space, 0, cps).astype(np.uint64) * powers[place & 63], at)
        for lag in (1, 2):
            if len(h) > lag:
                same = (h[lag:] == h[:-lag]) & (of_line[lag:] == of_line[:-lag])
                repeat = np.maximum(repeat, np.bincount(of_line[lag:][same], minlength=len(starts)))
    w, m = np.maximum(words, 1), np.maximum(n, 1)
    own = np.zeros((len(starts), OWN), np.float32)
    own[:, 0] = np.log1p(n) / 5
    own[:, 1] = np.minimum(count((kind & _SYMBOL) > 0) / w, 3)
    own[:, 2] = np.minimum(count((kind & _PIPE) > 0) / w, 1.5) * 2
    own[:, 3] = np.minimum(count((kind & _SHOUT) > 0) / w, 3)
    own[:, 4] = count((kind & _UPPER) > 0) / np.maximum(letters, 1) * 2
    own[:, 5] = repeat / w * 2
    own[:, 6] = 1 - letters / m
    own[:, 7] = count((kind & _DIGIT) > 0) / m * 2
    own[:, 8] = np.minimum(m / w, 20) / 8
    own[:, 9] = np.minimum(count((kind & _STOP) > 0) / w * 4, 3)
    own[:, 10] = np.minimum(count((kind & _COMMA) > 0) / w * 4, 3)
    own[:, 11] = n == 0
    own[:, 12] = words < 4
    doc = np.repeat(np.arange(len(texts)), lines)
    around = own[:, SHARED]
    before, after = np.zeros_like(around), np.zeros_like(around)
    if len(doc) > 1:
        inside = (doc[1:] == doc[:-1])[:, None]
        before[1:] = around[:-1] * inside
        after[:-1] = around[1:] * inside
    return np.concatenate([np.ones((len(own), 1), np.float32), own, before, after], 1), n, lines


def forward_backward(unary: np.ndarray, lines: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains laid end to end: P(good) of every line, the edge marginals summed, and each chain's log partition.

    unary is the score of the good state; edge[a, b] that of going from state a to state b. Chains run in step, the longest first.
    """
    order = np.argsort(-lines, kind="stable")
    begin = np.r_[0, lines.cumsum()[:-1]][order]
    size = lines[order]
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # chains longer than t
    a, b = np.zeros((2, len(unary))), np.zeros((2, len(unary)))
    for t, k in enumerate(active):
        i = begin[:k] + t
        if t:
            p0, p1 = a[0, i - 1], a[1, i - 1]
            a[0, i] = np.logaddexp(p0 + edge[0, 0], p1 + edge[1, 0])
            a[1, i] = np.logaddexp(p0 + edge[0, 1], p1 + edge[1, 1]) + unary[i]
        else:
            a[1, i] = unary[i]
    for t in range(len(active) - 2, -1, -1):
        i = begin[: active[t + 1]] + t
        n0, n1 = b[0, i + 1], b[1, i + 1] + unary[i + 1]
        b[0, i] = np.logaddexp(n0 + edge[0, 0], n1 + edge[0, 1])
        b[1, i] = np.logaddexp(n0 + edge[1, 0], n1 + edge[1, 1])
    total = a + b
    good = 1 / (1 + np.exp(np.clip(total[0] - total[1], -60, 60)))
    z = np.empty(len(lines))
    z[order] = np.logaddexp(total[0, begin], total[1, begin])
    pairs = np.zeros((2, 2))
    inner = np.ones(len(unary), bool)
    inner[np.r_[0, lines.cumsum()[:-1]][lines > 0]] = False
    j = np.flatnonzero(inner)
    zz = np.repeat(z, lines)[j]
    for s in (0, 1):
        for r in (0, 1):
            pairs[s, r] = np.exp(np.minimum(a[s, j - 1] + edge[s, r] + (unary[j] if r else 0) + b[r, j] - zz, 0)).sum()
    return good, pairs, z


@dataclass
class Crf:
    weights: np.ndarray
    edge: np.ndarray
    coef: list[float] = field(default_factory=list)
    prior: float = 0.5

    def marginals(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return forward_backward(x @ self.weights, lines, self.edge)[0]

    def document_features(self, texts: list[str | None]) -> np.ndarray:
        """For each text: length-weighted mean of P(good), its square, the least of a line, the share of length taken for bad; NaN without lines."""
        x, n, lines = line_features([t or "" for t in texts])
        good = self.marginals(x, lines)
        begin = np.r_[0, lines.cumsum()[:-1]]
        total = np.add.reduceat(n, begin)
        with np.errstate(invalid="ignore", divide="ignore"):
            q = np.add.reduceat(n * good, begin) / total
            bad = np.add.reduceat(n * (good < 0.5), begin) / total
        least = np.minimum.reduceat(np.where(n > 0, good, 1.0), begin)
        return np.c_[q, q * q, least, bad]

    def scores(self, texts: list[str | None]) -> list[float]:
        if not texts:
            return []
        if not self.coef:
            return [self.prior] * len(texts)
        f = self.document_features(texts)
        z = np.clip(self.coef[0] + f @ np.array(self.coef[1:]), -30, 30)
        return np.where(np.isnan(z), self.prior, 1 / (1 + np.exp(-z))).tolist()


def _fit_chain(x: np.ndarray, y: np.ndarray, lines: np.ndarray, weights: np.ndarray, edge: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the conditional log-likelihood, over all sequences of the bounded sample."""
    inner = np.ones(len(x), bool)
    inner[np.r_[0, lines.cumsum()[:-1]]] = False
    j = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[j - 1], y[j]), 1)
    theta = np.concatenate([weights, edge.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        good, pairs, _ = forward_backward(x @ theta[:-4], lines, theta[-4:].reshape(2, 2))
        g = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / len(x) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Crf:
    # the bounded sample, kept: nothing below is then worked out for all documents
    rows = cut(learnable(docs, labels, "quality", bound))
    rows = rows.withColumn("lines", F.length("text") - F.length(F.translate("text", "\n", "")) + 1).filter(F.coalesce("lines", F.lit(1)) <= ROW_LINES)
    share = sample_share(rows.agg(F.sum("lines")).first()[0] or 0, FIT_LINES)
    rows = rows.filter(hash_share(F.col("doc_id"), share, 12)).select("text", "y", "half")

    def figures(pieces: Iterator[dict]) -> Iterator[dict]:
        for p in pieces:
            texts = [t or "" for t in p["text"]]
            x, n, lines = line_features(texts)
            ends = lines.cumsum()
            yield {"x": [x[e - k : e].astype("<f4").tobytes() for k, e in zip(lines, ends, strict=True)], "n": [n[e - k : e].astype("<f4").tobytes() for k, e in zip(lines, ends, strict=True)], "y": p["y"], "half": p["half"]}

    # the bounded sample: figures of lines, not texts
    got = map_arrow(rows, figures, "x binary, n binary, y int, half long").collect()
    got.sort(key=lambda r: (r["half"], r["x"]))
    good_share = (sum(r["y"] for r in got) + 0.5) / (len(got) + 1)
    first, second = ([r for r in got if r["half"] == h] for h in (0, 1))
    width = 1 + OWN + 2 * len(SHARED)
    model = Crf(np.zeros(width), np.zeros((2, 2)), [], good_share)
    if any(len({r["y"] for r in part}) < 2 for part in (first, second)):
        return model
    xs, ys, lines = [], [], []
    for r in first:
        x = np.frombuffer(r["x"], "<f4").reshape(-1, width)
        for i in range(0, len(x), SEQUENCE):
            xs.append(x[i : i + SEQUENCE])
            ys.append(np.full(len(xs[-1]), r["y"]))
            lines.append(len(xs[-1]))
    x, y, lines = np.concatenate(xs).astype(float), np.concatenate(ys), np.array(lines)
    model.weights, model.edge = _fit_chain(x, y, lines, model.weights, model.edge, ROUNDS)
    good = model.marginals(x, lines)
    begin = np.r_[0, lines.cumsum()[:-1]]
    worst = np.repeat(np.minimum.reduceat(good, begin), lines)
    y = np.where((y == 0) & (good > 0.8) & (good > worst), 1, y)
    model.weights, model.edge = _fit_chain(x, y, lines, model.weights, model.edge, RELABEL_ROUNDS)
    f, t = [], []
    for r in second:
        x, n = np.frombuffer(r["x"], "<f4").reshape(-1, width), np.frombuffer(r["n"], "<f4")
        if n.sum():
            good = model.marginals(x.astype(float), np.array([len(x)]))
            q = float((n * good).sum() / n.sum())
            f.append((q, q * q, float(np.where(n > 0, good, 1).min()), float((n * (good < 0.5)).sum() / n.sum())))
            t.append(r["y"])
    model.coef = fit_logistic(np.array(f), np.array(t, float), ridge=0.1)
    if not all(map(math.isfinite, model.coef)):
        model.coef = []
    return model


def score(docs: DataFrame, model: Crf) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(pieces: Iterator[dict]) -> Iterator[dict]:
        for p in pieces:
            yield {"doc_id": p["doc_id"], "score": shared.value.scores(p["text"])}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def line_labels(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, line, good): the label of every line, by its marginal."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(pieces: Iterator[dict]) -> Iterator[dict]:
        for p in pieces:
            if not p["text"]:
                continue
            x, _, lines = line_features([t or "" for t in p["text"]])
            good = shared.value.marginals(x, lines)
            yield {"doc_id": [i for i, k in zip(p["doc_id"], lines, strict=True) for _ in range(k)], "line": [j for k in lines for j in range(k)], "good": good}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, line long, good double")


def classify(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    held = F.coalesce(split_of(F.col("doc_id")) == 2, F.lit(False))
    out = score(docs, train(docs, labels, bound))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """docs without the rows that the classifier rejects; one narrow pass, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, bound))

    def run(pieces: Iterator[dict]) -> Iterator[dict]:
        for p in pieces:
            keep = [i for i, s in enumerate(shared.value.scores(p["text"])) if s >= THRESHOLD]
            yield {k: [v[i] for i in keep] for k, v in p.items()}

    return map_arrow(docs, run, schema_ddl(docs))
