"""Mixing by soft membership: rates of documents at which expected domain totals meet target weights.

A classifier fitted on a labelled table gives each document its posterior over domains. A document
of n tokens, rate r and posterior p adds r * n * p to the domains' expected totals; rates, from 0 to
`most`, are those that minimise

    1/2 sum_d (total_d / T - weight_d)^2 / share_d + mu/2 sum_i (n_i / T) (r_i - 1)^2

(T: all tokens; weight_d: wanted tokens of domain d over T; share_d: the natural share of domain d, which evens out the curvature), by
accelerated projected gradient. Each step is one distributed pass that returns a sum per domain. A
rate depends on the posterior alone, so posteriors are kept to 1 / RESOLUTION and documents of one
posterior are one cell with their summed tokens; no rate has to be stored between steps, as it
follows from the few residual vectors so far. Targets that bounded rates can't meet are met as nearly
as the sum says; `Plan.reached` tells how far.

The classifier holds each word's log-odds of a domain against the rest. A text's evidence is, for each
domain, its few strongest words, the mean of all, and what the words look like; a softmax
regression, fitted on evidence from words learnt without the text, turns it to a posterior. So a few
telling words count alike in short and long texts, and the noise of many words doesn't add up.

Fitting the classifier takes a bounded sample: at most per_domain labelled ids of each domain, the
first by hash, without those whose text is over sample_chars characters. All else covers all rows.

Defined results: null and empty texts have no tokens and the prior as posterior; a domain without
natural share is left out of the sum; labels of null count as none, of several the greatest counts;
with one or no labelled domain every posterior is the prior; rows are kept one to one; `mixed`
replaces columns named as its own, `resampled` keeps all columns as they are whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm.common import Scratch, apart, mapped, place, quoted, together

BUCKETS = 1 << 16
RESOLUTION = 200
PER_DOMAIN, SAMPLE_CHARS = 1500, 20_000
MEMORY = 200_000
#: Words whose evidence counts by itself: the strongest, and the sum of the STRONGEST strongest.
STRONGEST = 3
#: Documents that a mark's counts are drawn to the common share with.
DRAWN = 4.0
FOLDS = 3
#: Marks beside the words: what a word looks like, and the share of words that repeat, in tenths.
SHAPES, TENTHS = 32, 10


def _shape(word: str, plain: str) -> int:
    """Has letters; mostly upper case; digits; signs; mostly no letters."""
    loud = 8 * ("!!" in word)
    if plain.isalpha():
        return 1 + 2 * (len(plain) > 1 and plain.isupper()) + loud
    letters = sum(map(str.isalpha, word))
    upper = sum(map(str.isupper, word))
    signs = any(c in "#*$%&|<>" for c in word)
    return (letters > 0) + 2 * (upper > 1 and 2 * upper > letters) + 4 * any(map(str.isdigit, word)) + (loud or 8 * signs) + 16 * (2 * letters < len(word))


class Marks(dict):
    """word -> bucket * SHAPES + shape, remembered up to MEMORY words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        plain = word.strip(".,;:!?\"'()")
        self[word] = got = zlib.crc32(plain.lower().encode("utf-8", "surrogatepass")) % BUCKETS * SHAPES + _shape(word, plain)
        return got


def features(text: str | None, marks: Marks) -> tuple[np.ndarray, np.ndarray, int]:
    """Mark numbers, their weights, and the number of words. A word weighs 1 however often it occurs;
    the shapes weigh their share of the words, as does the tenth of repeated words, times 20."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0), 0
    distinct = set(words)
    seen = list(map(marks.get, distinct))
    if None in seen:
        seen = [marks[w] if x is None else x for w, x in zip(distinct, seen, strict=True)]
    got = np.array(seen, np.int64)
    n = np.bincount(got % SHAPES, minlength=SHAPES)
    shapes = n.nonzero()[0]
    tenth = BUCKETS + SHAPES + min(TENTHS - 1, int(TENTHS * (1 - len(distinct) / len(words))))
    own = np.unique(got // SHAPES)
    ids = np.concatenate([own, BUCKETS + shapes, [tenth]])
    return ids, np.concatenate([np.ones(len(own)), 20 * n[shapes] / len(distinct), [20.0]]), len(words)


def evidence(found: tuple[np.ndarray, np.ndarray, int], weights: np.ndarray) -> np.ndarray:
    """For each domain: the strongest word, the STRONGEST strongest, the mean of all words, and the shapes; then the log of the number of words."""
    ids, w, _ = found
    d = weights.shape[1]
    if not len(ids):
        return np.zeros(4 * d + 1)
    n = int(np.searchsorted(ids, BUCKETS))
    own = weights[ids[:n]]
    top = np.sort(own if n <= STRONGEST else np.partition(own, n - STRONGEST, axis=0)[n - STRONGEST :], axis=0)
    return np.concatenate([top[-1], top.sum(0), own.mean(0), w[n:] @ weights[ids[n:]], [math.log(n)]])


@dataclass(frozen=True)
class DomainModel:
    """weights: marks x domains, log-odds of a mark; logits = (evidence - mean) / scale * slopes + shift."""

    domains: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slopes: np.ndarray
    shift: np.ndarray

    def posterior(self, found: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
        if not len(found[0]) or not len(self.slopes):
            return self.prior
        logits = (evidence(found, self.weights) - self.mean) / self.scale @ self.slopes + self.shift
        p = np.exp(logits - logits.max())
        return p / p.sum()


def _softmax_fit(x: np.ndarray, y: np.ndarray, size: int, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and shift of a weighted softmax regression, by damped Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    k = z.shape[1]
    target = np.eye(size)[y]
    w = np.zeros((k, size))
    free = np.ones((k, 1))
    free[-1] = 1e-3

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        logits = z @ w
        logits = logits - logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        return float(-(weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum() + ridge / 2 * (free * w * w).sum()), p

    now, p = at(w)
    for _ in range(rounds):
        g = z.T @ (weight[:, None] * (p - target)) + ridge * free * w
        h = np.zeros((k * size, k * size))
        for a in range(size):
            for b in range(size):
                h[a * k : (a + 1) * k, b * k : (b + 1) * k] = (z * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
        h += np.diag(np.tile(ridge * free[:, 0], size)) + 1e-9 * np.eye(k * size)
        step = np.linalg.solve(h, g.T.ravel()).reshape(size, k).T
        damp = 1.0
        while damp > 1e-4 and at(w - damp * step)[0] > now:
            damp /= 2
        w = w - damp * step
        before, (now, p) = now, at(w)
        if before - now <= 1e-9 * abs(before):
            break
    return w[:-1], w[-1]


def train(texts: list[str], labels: list[str], domains: tuple[str, ...], prior: dict[str, float]) -> DomainModel:
    """Log-odds of marks, and the regression on evidence from marks that were learnt without the text."""
    base = np.array([max(prior.get(d, 0.0), 1e-6) for d in domains], float)
    base /= base.sum()
    marks, y = Marks(), np.array([domains.index(x) for x in labels], np.int64)
    found = [features(t, marks) for t in texts]
    size, d = BUCKETS + SHAPES + TENTHS, len(domains)

    def weights(rows: np.ndarray) -> np.ndarray:
        n = np.zeros((size, d))
        for i in rows:
            ids, w, _ = found[i]
            n[ids, y[i]] += np.minimum(w, 1)
        docs = np.maximum(np.bincount(y[rows], minlength=d), 1e-9)
        part = docs / docs.sum()
        rest = n.sum(1, keepdims=True) - n
        return np.log((n + DRAWN * part) / docs) - np.log((rest + DRAWN * (1 - part)) / np.maximum(docs.sum() - docs, 1e-9))

    none = np.zeros(4 * d + 1)
    if len(set(labels)) < 2 or len(labels) < 2 * FOLDS:
        return DomainModel(domains, np.zeros((size, d), np.float32), base, none, none + 1, np.empty((0, d)), np.zeros(d))
    fold = np.random.default_rng(5).permutation(len(y)) % FOLDS
    sums = np.zeros((len(y), 4 * d + 1))
    for k in range(FOLDS):
        own = weights(np.flatnonzero(fold != k)).astype(np.float32)
        for i in np.flatnonzero(fold == k):
            sums[i] = evidence(found[i], own)
    weight = base[y] / np.maximum(np.bincount(y, minlength=d), 1)[y]
    mean, scale = sums.mean(0), np.maximum(sums.std(0), 1e-6)
    slopes, shift = _softmax_fit((sums - mean) / scale, y, d, weight / weight.sum())
    return DomainModel(domains, weights(np.arange(len(y))).astype(np.float32), base, mean, scale, slopes, shift)


def learn(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...], per_domain: int = PER_DOMAIN, sample_chars: int = SAMPLE_CHARS) -> DomainModel:
    """From docs(doc_id, text) and labels(doc_id, domain); the prior counts all labels. The sample is
    chosen among the ids, so that only its documents' texts move; they come to the driver."""
    known = labels.where(F.col("domain").isin(*domains)).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    prior = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    parts = [known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain) for d in domains]
    ids = F.broadcast(reduce(DataFrame.unionByName, parts))  # at most per_domain rows for each domain
    got = docs.select("doc_id", "text").where(F.length("text") <= sample_chars).join(ids, "doc_id").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in got], [r["domain"] for r in got], domains, prior)


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """docs with n_tokens (words) and posterior, array<double> in domain order, in steps of 1 / RESOLUTION."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # marks x domains: bounded
    made = {"n_tokens": T.LongType(), "posterior": T.ArrayType(T.DoubleType())}
    at = place(docs, "text", tuple(made))

    def start():
        m, marks = shared.value, Marks()

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            found, p = [], []
            for t in batch.column(at):
                f = features(t.as_py(), marks)
                found.append(f[2])
                p.append(stepped(m.posterior(f)))
            flat = pa.array(np.concatenate(p) if p else np.empty(0))
            offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(m.domains))
            return [pa.array(found, pa.int64()), pa.ListArray.from_arrays(offsets, flat)]

        return each

    return mapped(docs, made, start)


def stepped(p: np.ndarray) -> np.ndarray:
    """The nearest posterior in whole steps: the largest remainders are rounded up."""
    x = p * RESOLUTION
    low = np.floor(x)
    up = np.argsort(low - x, kind="stable")[: int(round(RESOLUTION - low.sum()))]
    low[up] += 1
    return low / RESOLUTION


@dataclass(frozen=True)
class Plan:
    """What gives any posterior its rate: the residuals of each step, scaled by the natural shares.

    wanted and reached: tokens of each domain over all tokens before, as asked for and as expected at the rates."""

    residuals: np.ndarray
    mu: float
    most: float = math.inf
    wanted: tuple[float, ...] = ()
    reached: tuple[float, ...] = ()

    def rates(self, p: np.ndarray) -> np.ndarray:
        r = y = np.ones(len(p))
        for k, g in enumerate(self.residuals):
            new = np.clip(y - (p @ g + self.mu * (y - 1)) / (1 + self.mu), 0, self.most)
            r, y = new, new + k / (k + 3) * (new - r)
        return r


def _totals(cells: DataFrame, plan: Plan, size: int) -> np.ndarray:
    """Expected tokens per domain at the plan's rates, one sum per domain and batch, then overall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column(0).flatten()).reshape(-1, size)
            sums = (plan.rates(p) * np.asarray(batch.column(1), float)) @ p
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(sums)], ["d", "s"])

    out = np.zeros(size)
    for r in cells.mapInArrow(run, "d int, s double").groupBy("d").agg(F.sum("s").alias("s")).collect():
        out[r["d"]] = r["s"]
    return out


def fit(cells: DataFrame, weights: list[float], mu: float = 1e-3, steps: int = 40, enough: float = 1e-6, most: float = math.inf) -> Plan:
    """The plan for cells(posterior, tokens) and target weights."""
    size = len(weights)
    want = np.array(weights, float)
    plan = Plan(np.zeros((0, size)), mu, most)
    total = _totals(cells, plan, size)
    every = total.sum()
    if not every:
        return replace(plan, wanted=tuple(want), reached=(0.0,) * size)
    share = total / every
    scale = np.where(share > 1e-9, 1 / np.maximum(share, 1e-9), 0.0)
    before = total
    for k in range(steps):
        # The point where the gradient is taken lies beyond the last rates by momentum, and totals are linear.
        beta = (k - 1) / (k + 2) if k else 0.0
        at = total + beta * (total - before)
        plan = replace(plan, residuals=np.vstack([plan.residuals, (at / every - want) * scale]))
        before, total = total, _totals(cells, plan, size)
        if np.abs(total - before).max() <= enough * every:
            break
    return replace(plan, wanted=tuple(want), reached=tuple(total / every))


def rate_of(docs: DataFrame, plan: Plan, name: str = "rate") -> DataFrame:
    """docs, which have posterior, with the plan's rate."""
    at, size = place(docs, "posterior", (name,)), plan.residuals.shape[1]
    rates = lambda batch: [pa.array(plan.rates(np.asarray(batch.column(at).flatten()).reshape(-1, size)))]
    return mapped(docs, {name: T.DoubleType()}, lambda: rates)


def copies(rate: Column, *key: Column) -> Column:
    """floor(rate), and one more with the odds of what is left, by a hash of the key."""
    u = F.pmod(F.xxhash64(F.lit("mix"), *key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + u).cast("int")


def mixed(docs: DataFrame, model: DomainModel, weights: dict[str, float], budget: float = 1.0, most: float = math.inf) -> tuple[DataFrame, Plan]:
    """docs with n_tokens, posterior, rate and copies (the rate made whole), and the plan that gives the rates.

    budget: the tokens wanted, over those that docs have; most: the greatest rate."""
    total = sum(weights.values()) / budget
    want = [weights.get(d, 0.0) / total for d in model.domains]
    scratch, work = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("n_tokens", "posterior", "rate", "copies")]
    known = scratch.keep(posteriors(docs.select(*map(quoted, keep)), model))
    cells = work.keep(known.groupBy("posterior").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    plan = fit(cells, want, most=most)
    work.drop()
    rated = rate_of(known, plan)
    key = [F.col("doc_id")] if "doc_id" in docs.columns else [F.col("text")]
    return rated.withColumn("copies", copies(F.col("rate"), *key)), plan


#: Domains of the labels table, and what a training mixture should hold of each: fixed beforehand, whatever a corpus has.
LABEL_DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
#: No document is repeated more often than this.
MOST = 4.0


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of labels(doc_id, quality, toxic): toxic, else clean or low by quality; null if neither is known."""
    one = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")
    return one.select("doc_id", domain.alias("domain"))


def resampled(docs: DataFrame, model: DomainModel, weights: dict[str, float], budget: float = 1.0, most: float = math.inf) -> DataFrame:
    """docs, each row as often as its rate says: rows of rate under 1 may go, of 1 or more all stay."""
    rows, _ = mixed(apart(docs, "doc_id", "text"), model, weights, budget, most)
    again = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return together(again, docs, "doc_id", "text")
