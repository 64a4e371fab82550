"""Toxicity: a two-state linear-chain conditional random field tags toxic tokens; marginals give document scores.

Labels are per document, so tokens are labelled first: a word or word beginning is a cue if the learning documents
that hold it are toxic far more often than chance (a log-odds ratio at least ``MIN_Z`` standard errors above 0);
a token of a toxic document with a cue is toxic, every other token is not. The field has a weight for each cue, for
cues on the neighbouring tokens and for the label transitions. Forward-backward marginals of all tokens of a text
then give its expected number of toxic tokens, the largest marginal and the density; a logistic regression on the
learning documents turns these into the score, and tokens with a marginal above a half are the offending spans.

The chain of all texts of a batch is swept as one: a text's first token forgets what came before it. Products of the
2 x 2 step matrices are taken for many blocks of tokens at once, so no text is cut, however long.

Fitted on a bounded sample: ``MAX_ROWS`` labelled documents of each class (those of least hash), ``MAX_CUES`` cues and
``MAX_SEGMENTS`` token segments, ``MAX_HITS`` with cues from one document. Labels, lang, source and doc_id are no inputs of a score.

Null and empty texts get the score of a text without toxic tokens. Without both classes every score is 0. Repeated
rows are scored each; repeated labels of a document count as toxic if one of them is. Null labels are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, shared, table

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
MAX_ROWS, MAX_CUES, MAX_SEGMENTS, MAX_HITS = 5_000, 5_000, 4_000, 4
MIN_DOCUMENTS, MIN_Z, MIN_LOG_ODDS = 3, 3.0, 2.0
BEGINNINGS = (4, 5, 6)
MARGIN = 8
STEPS, RATE, RIDGE = 80, 0.3, 1e-3
BLOCK = 128

_TOKEN = re.compile(r"\w+")


def features(token: str) -> list[str]:
    """The token itself and its beginnings."""
    return ["=" + token, *("^" + token[:n] for n in BEGINNINGS if len(token) >= n)]


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))


def sweep(emission: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, beta, step matrices) of one long chain; ``first`` marks tokens that begin a text.

    ``emission`` is the potential of label 1 against label 0, ``trans`` the 2 x 2 potentials of label pairs. Alpha and
    beta are scaled to sum 1 at each token, so only their ratios mean anything.
    """
    n = len(emission)
    blocks = -(-n // BLOCK)
    steps = np.empty((blocks * BLOCK, 2, 2))
    steps[:n] = np.where(first[:, None, None], 1.0, trans)
    steps[:n, :, 1] *= emission[:, None]
    steps[:n] /= steps[:n].sum(axis=(1, 2), keepdims=True)
    steps[n:] = np.eye(2)
    by_block = steps.reshape(blocks, BLOCK, 2, 2)
    ahead = np.empty_like(by_block)
    behind = np.empty_like(by_block)
    run = np.broadcast_to(np.eye(2), (blocks, 2, 2))
    for i in range(BLOCK):
        run = run @ by_block[:, i]
        run = run / run.sum(axis=(1, 2), keepdims=True)
        ahead[:, i] = run
    run = np.broadcast_to(np.eye(2), (blocks, 2, 2))
    for i in reversed(range(BLOCK)):
        behind[:, i] = run
        run = by_block[:, i] @ run
        run = run / run.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.empty((blocks, 2)), np.empty((blocks, 2))
    state = np.array([0.5, 0.5])
    for b in range(blocks):
        enter[b] = state
        state = state @ ahead[b, -1]
        state = state / state.sum()
    state = np.array([0.5, 0.5])
    for b in reversed(range(blocks)):
        leave[b] = state
        state = run[b] @ state
        state = state / state.sum()
    alpha = np.einsum("bi,blij->blj", enter, ahead).reshape(-1, 2)[:n]
    beta = np.einsum("blij,bj->bli", behind, leave).reshape(-1, 2)[:n]
    return alpha / alpha.sum(1, keepdims=True), beta / beta.sum(1, keepdims=True), steps[:n]


@dataclass
class Field:
    """The chain's weights: cues, bias, neighbouring cues, and log potentials of label pairs (0 to 0 is 0)."""

    cues: dict[str, int]
    weights: np.ndarray
    bias: float = -3.0
    beside: float = 0.0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def emission(self, own: np.ndarray, cued: np.ndarray, first: np.ndarray) -> np.ndarray:
        near = np.zeros(len(own))
        near[1:] += cued[:-1] & ~first[1:]
        near[:-1] += cued[1:] & ~first[1:]
        return np.exp(np.clip(self.bias + own + self.beside * near, -30, 30)), near

    def marginals(self, own: np.ndarray, cued: np.ndarray, first: np.ndarray) -> np.ndarray:
        emission, _ = self.emission(own, cued, first)
        alpha, beta, _ = sweep(emission, first, np.exp(self.pairs))
        both = alpha * beta
        return both[:, 1] / both.sum(1)

    def ids(self, token: str) -> list[int]:
        return [i for f in features(token) if (i := self.cues.get(f)) is not None]


def learning_rows(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """text, toxic: at most ``max_rows`` documents of each class, none held out, one row (the least text) for each id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # The first by hash of each class: every task keeps its own first ones, and those are merged.
    clean, toxic = (known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for c in (0, 1))
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(clean.unionAll(toxic)), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _feature_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(b["text"], b["toxic"]):
            found = {f for token in set(_TOKEN.findall(text.lower())) for f in features(token)}
            (toxic if label else clean).update(found)
        names = list(toxic.keys() | clean.keys())
        if names:
            yield pd.DataFrame({"feature": names, "a": [toxic[f] for f in names], "b": [clean[f] for f in names]})


def cues(sample: DataFrame) -> list[str]:
    """Features that mark toxic documents, the surest first."""
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return []
    counts = sample.mapInPandas(_feature_counts, "feature string, a long, b long").groupBy("feature").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= MIN_DOCUMENTS)
    odds = F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("b") + 0.5) / (n[0] + 1))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = counts.withColumns({"odds": odds, "z": z}).where((F.col("odds") >= MIN_LOG_ODDS) & (F.col("z") >= MIN_Z))
    return [r.feature for r in best.orderBy(F.desc("z"), "feature").limit(MAX_CUES).collect()]


def _segments(names: list[str]):
    known = set(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tokens_out, label_out = [], []
            for text, label in zip(b["text"], b["toxic"]):
                tokens = _TOKEN.findall(text.lower())
                hits = [i for i, t in enumerate(tokens) if not known.isdisjoint(features(t))][:MAX_HITS]
                # A stretch without choice as well: the field must see ordinary text of both classes.
                for i in [*hits, len(tokens) // 2]:
                    tokens_out.append(tokens[max(0, i - MARGIN) : i + MARGIN + 1])
                    label_out.append(int(label))
            yield pd.DataFrame({"tokens": tokens_out, "toxic": label_out})

    return run


def fit_field(segments: list[tuple[list[str], int]], names: list[str]) -> Field:
    """Gradient ascent (Adam) on the conditional log likelihood of the segments' token labels."""
    model = Field({f: i for i, f in enumerate(names)}, np.zeros(len(names)))
    rows, cols, truth, first = [], [], [], []
    for tokens, toxic in segments:
        for k, token in enumerate(tokens):
            ids = model.ids(token)
            rows += [len(truth)] * len(ids)
            cols += ids
            truth.append(int(toxic and bool(ids)))
            first.append(k == 0)
    if not truth:
        return model
    rows, cols, truth, first = np.array(rows, np.int64), np.array(cols, np.int64), np.array(truth), np.array(first)
    n = len(truth)
    cued = np.zeros(n, bool)
    cued[rows] = True
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[inner - 1], truth[inner]), 1)
    params = np.concatenate([model.weights, [model.bias, model.beside], model.pairs.ravel()])
    m, v = np.zeros_like(params), np.zeros_like(params)
    k = len(names)
    for step in range(1, STEPS + 1):
        model.weights, model.bias, model.beside = params[:k], params[k], params[k + 1]
        model.pairs = params[k + 2 :].reshape(2, 2)
        own = np.bincount(rows, model.weights[cols], n) if len(rows) else np.zeros(n)
        emission, near = model.emission(own, cued, first)
        alpha, beta, steps = sweep(emission, first, np.exp(model.pairs))
        both = alpha * beta
        p = both[:, 1] / both.sum(1)
        joint = alpha[inner - 1][:, :, None] * steps[inner] * beta[inner][:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        wrong = truth - p
        pair_grad = seen - joint.sum(0)
        pair_grad[0, 0] = 0.0
        grad = np.concatenate([np.bincount(cols, wrong[rows], k) if len(rows) else np.zeros(k),
                               [wrong.sum(), (wrong * near).sum()], pair_grad.ravel()]) - RIDGE * n * 0.01 * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.bias, model.beside = params[:k], float(params[k]), float(params[k + 1])
    model.pairs = params[k + 2 :].reshape(2, 2)
    return model


class Tagger:
    """Marginals of whole texts; the cue sums of tokens are kept in a bounded cache."""

    #: Tokens swept at once: bounds the arrays, while a longer text is still swept whole.
    GROUP = 150_000

    def __init__(self, model: Field, room: int = 200_000):
        self.model, self.room = model, room
        self.sums: dict[str, float] = {}

    def own(self, tokens: list[str]) -> np.ndarray:
        """The cue sum of each token; nan where it has no cue."""
        sums = self.sums
        for token in tokens:
            if token not in sums:
                if len(sums) >= self.room:
                    sums.clear()
                ids = self.model.ids(token)
                sums[token] = float(self.model.weights[ids].sum()) if ids else math.nan
        return np.fromiter((sums[t] if t in sums else self._again(t) for t in tokens), float, len(tokens))

    def _again(self, token: str) -> float:
        ids = self.model.ids(token)
        return float(self.model.weights[ids].sum()) if ids else math.nan

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The marginals of each text's tokens, in order."""
        group: list[np.ndarray] = []
        size = 0
        for text in texts:
            group.append(self.own(_TOKEN.findall(text.lower())))
            size += len(group[-1])
            if size >= self.GROUP:
                yield from self._sweep(group)
                group, size = [], 0
        yield from self._sweep(group)

    def _sweep(self, group: list[np.ndarray]) -> list[np.ndarray]:
        ends = np.cumsum([len(g) for g in group])
        if not len(ends) or not ends[-1]:
            return [np.zeros(0)] * len(group)
        own = np.concatenate(group)
        cued = ~np.isnan(own)
        first = np.zeros(len(own), bool)
        starts = ends - [len(g) for g in group]
        first[starts[starts < len(own)]] = True
        p = self.model.marginals(np.where(cued, own, 0.0), cued, first)
        return np.split(p, ends[:-1])


def summary(p: np.ndarray) -> list[float]:
    """What a document's score is made of."""
    total = float(p.sum())
    return [1.0, math.log1p(total), float(p.max()) if len(p) else 0.0, total / math.sqrt(len(p) + 1)]


def fit_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - ridge @ w)
    return w


def fit(documents: DataFrame, labels: DataFrame) -> Field | None:
    """The field and its score weights; what reaches the driver is bounded by the sample's parameters."""
    sample = learning_rows(documents, labels)
    names = cues(sample)
    if not names:
        return None
    segments = sample.mapInPandas(_segments(names), "tokens array<string>, toxic int")
    segments = segments.orderBy(F.xxhash64("tokens"), "toxic").limit(MAX_SEGMENTS)
    model = fit_field([(r.tokens, r.toxic) for r in segments.collect()], names)
    opened = shared(documents.sparkSession, model, Tagger)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = opened()
        for b in batches:
            x = [summary(p) for p in tagger.texts(list(b["text"]))]
            yield pd.DataFrame({"x": x, "y": b["toxic"]})

    rows = sample.mapInPandas(run, "x array<double>, y int").collect()  # at most 2 * MAX_ROWS short rows
    model.score = fit_scores(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))
    return model


def offending(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Code-point offsets of the tokens that are likelier toxic than not."""
    if not (p > 0.5).any():
        return []
    lowered = text.lower()
    spans = [m.span() for m, x in zip(_TOKEN.finditer(lowered), p) if x > 0.5]
    if len(lowered) == len(text):
        return spans
    # A few letters get longer in lower case; each lower-case place belongs to one letter of the text.
    letter = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
    return [(int(letter[a]), int(letter[b - 1]) + 1) for a, b in spans]


def score(documents: DataFrame, model: Field | None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic and the offending spans of every document."""
    opened = shared(documents.sparkSession, model, lambda m: Tagger(m) if m else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = opened()
        for b in batches:
            texts = [t or "" for t in b["text"]]
            scores, spans = [], []
            for text, p in zip(texts, tagger.texts(texts) if tagger else (np.zeros(0) for _ in texts)):
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(tagger.model.score, summary(p))))))) if tagger else 0.0)
                spans.append(offending(text, p))
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "held_out": b["held_out"], "score": scores,
                "predicted": [int(s >= THRESHOLD) for s in scores], "n_toxic": [len(s) for s in spans],
                "toxic_spans": [",".join(f"{a}:{z}" for a, z in s) for s in spans]})

    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInPandas(
        run, "doc_id long, held_out boolean, score double, predicted int, n_toxic long, toxic_spans string")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))
