"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums, over all letter triples that are subsequences of both, the product of
their decayed spans, so that an insult with gaps or inserted characters stays near the plain one; it
is scaled to 1 for a word with itself. Landmarks are words of labelled
sentences; features are the kernel values against them, whitened by the landmarks' own kernel
matrix. Labels hold errors: the score is calibrated on documents that the fit hasn't met, with a floor
for documents whose label nothing in the text explains.

The machine is trained on labelled sentences, as bags of words of which one decides: a sentence's row
is its witness, the word of greatest margin, and witnesses are chosen anew after each fit (multiple-instance
training). A label is of a document, and its sentences bear it, but not all of a toxic document's are
toxic: of these take part the ones that hold a word which marks toxic sentences and documents by likelihood ratio,
each also with a character put into its witness. Of clean documents all sentences take part. Sentences
that share a witness share a row, whose weight is the root of their number.

A document's score is that of its worst unit (a word, or letters set apart by blanks), whatever its
length. As the machine is linear in the kernel, its landmarks fold into one weight per triple, and
a word costs the same however many landmarks there are.

Fitting takes a bounded sample: at most `per_class` labelled ids of each class, the first by hash,
without those whose text is over `sample_chars` characters. Scoring covers all.

Defined results: null and empty texts get the score of no unit at all (near 0); labels of null count
as none; an id with several labels is toxic if one is; without both classes all scores are 0; rows
are kept one to one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm.common import mapped, place

DECAY, REACH = 0.7, 8
#: Letter codes: 1 to 26 for a to z (without accents), 27 for digits, 28 to 31 for other letters.
BASE = 32
LONGEST = 24
LANDMARKS = 224
PER_CLASS, SAMPLE_CHARS = 2500, 20_000
VARIANTS, FOLDS = 8, 3
MEMORY = 300_000
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """For each code point: its letter code, 0 for what is skipped, 255 for the line feed."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x33480):  # no script lies beyond
        ch = chr(c)
        if ch.isalpha():
            plain = unicodedata.normalize("NFKD", ch.lower())[0]
            table[c] = ord(plain) - 96 if "a" <= plain <= "z" else 28 + c % 4
        elif ch.isdigit():
            table[c] = 27
    table[10] = 255
    return table


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All i < j < k < n with k - i < REACH, and their decayed spans."""
    at = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + REACH))], np.int64).reshape(-1, 3)
    return at[:, 0], at[:, 1], at[:, 2], DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def _by_length(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit numbers and letter codes (one row each), for each length of at least 3; long units as overlapping windows."""
    raw = np.frombuffer("\n".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    t = _codes()[raw]
    t = t[t != 0]
    ends = t == 255
    which = np.cumsum(ends)[~ends]
    letters = t[~ends].astype(np.int64)
    sizes = np.bincount(which, minlength=len(units))
    starts = np.cumsum(sizes) - sizes
    for n in range(3, LONGEST + 1):
        own = np.flatnonzero(sizes == n)
        if len(own):
            yield own, letters[starts[own][:, None] + np.arange(n)]
    for u in np.flatnonzero(sizes > LONGEST):
        at = np.append(np.arange(0, sizes[u] - LONGEST, LONGEST // 2), sizes[u] - LONGEST)
        yield np.full(len(at), u), letters[starts[u] + at[:, None] + np.arange(LONGEST)]


def _triple_ids(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triple numbers of each row, the weights of all rows, and each row's norm in the kernel's space."""
    i, j, k, w = _triples(rows.shape[1])
    ids = (rows[:, i] * BASE + rows[:, j]) * BASE + rows[:, k]
    # A triple that occurs several times is one feature: sort each row, and sum over equal neighbours.
    ranked = np.sort(ids * len(w) + np.arange(len(w)), axis=1)
    same = ranked // len(w)
    new = np.ones(same.shape, bool)
    new[:, 1:] = same[:, 1:] != same[:, :-1]
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(w[ranked % len(w)].ravel(), starts)
    return ids, w, np.sqrt(np.bincount(starts // len(w), sums * sums, len(rows)))


def triple_features(units: list[str]) -> np.ndarray:
    """The kernel's own features: units x letter triples."""
    out = np.zeros((len(units), BASE**3), np.float32)
    for own, rows in _by_length(units):
        ids, w, norm = _triple_ids(rows)
        np.add.at(out, (own[:, None], ids), w / norm[:, None])
    return out


def kernel(units: list[str], landmark_features: np.ndarray) -> np.ndarray:
    """units x landmarks; of the windows of a long unit the greatest value counts."""
    by_triple = np.ascontiguousarray(landmark_features.T)
    out = np.zeros((len(units), len(landmark_features)), np.float32)
    for own, rows in _by_length(units):
        for a in range(0, len(rows), 32):
            ids, w, norm = _triple_ids(rows[a : a + 32])
            np.maximum.at(out, own[a : a + 32], np.einsum("btm,t->bm", by_triple[ids], w.astype(np.float32)) / norm[:, None].astype(np.float32))
    return out


def spaced(words: list[str]) -> list[str]:
    """Runs of three or more words of one character, put together."""
    out, run = [], []
    last = -2
    for i in [i for i, w in enumerate(words) if len(w) == 1]:
        if i != last + 1:
            if len(run) > 2:
                out.append("".join(run))
            run = []
        run.append(words[i])
        last = i
    if len(run) > 2:
        out.append("".join(run))
    return out


def units_of(text: str | None) -> list[str]:
    words = (text or "").lower().split()
    return words + spaced(words)


@dataclass(frozen=True)
class Machine:
    """weights: by letter triple; score = floor + (1 - floor) / (1 + exp(-(slope * margin + shift))), margin the greatest of a text's units."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    landmarks: tuple[str, ...] = ()
    floor: float = 0.0

    def margins(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), -np.inf)
        for own, rows in _by_length(units):
            for a in range(0, len(rows), 2048):
                ids, w, norm = _triple_ids(rows[a : a + 2048])
                np.maximum.at(out, own[a : a + 2048], self.weights[ids] @ w / norm + self.bias)
        return np.where(np.isneginf(out), self.bias, out)

    def probability(self, margin: float) -> float:
        return self.floor + (1 - self.floor) / (1 + math.exp(-max(-500.0, min(500.0, self.slope * margin + self.shift))))


class Scorer:
    """A machine and the margins of the units that it has met."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}

    def scores(self, texts: list[str | None]) -> list[float]:
        units = [units_of(t) for t in texts]
        new = [u for u in {u for some in units for u in some} if u not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = list({u for some in units for u in some})
        if new:
            self.known.update(zip(new, self.machine.margins(new).tolist(), strict=True))
        get = self.known.__getitem__
        return [self.machine.probability(max(map(get, some), default=self.machine.bias)) for some in units]


def _svm(z: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Squared hinge loss by Newton steps on the active set; the last weight is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    loss = lambda w: w @ ridge @ w + (c * np.maximum(0, 1 - y * (z @ w)) ** 2).sum()
    now, active = loss(w), np.ones(len(z), bool)
    for _ in range(rounds):
        a = z[active] * c[active, None]
        step = np.linalg.solve(ridge + a.T @ z[active], a.T @ y[active]) - w
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now, active = now, loss(w), y * (z @ w) < 1
        if before - now <= 1e-6 * before:
            break
    return w


def _platt(margin: np.ndarray, target: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slope and shift of a logistic curve through the margins, with targets from 0 to 1; w: where to begin."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    loss = lambda w: np.logaddexp(0, x @ w).sum() - target @ (x @ w) + 5e-4 * w @ w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step, size = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * w), 1.0
        while size > 1e-3 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def _calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, shift and floor, by expectation and maximisation: a document bears the label 1 for what the
    machine sees with the odds of a logistic curve of the margin, and else by chance, with the odds `floor`."""
    # The ends of the curve are held back as if one more document of the other label had been there.
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    low, high = 1 / (neg + 2), (pos + 1) / (pos + 2)
    w, floor = np.array([1.0, -np.median(margin)]), 0.5 * pos / (pos + neg)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(margin * w[0] + w[1], -30, 30)))
        seen = np.where(y > 0, p / (p + floor * (1 - p)), 0.0)
        before = floor
        floor = float((1 - seen[y > 0]).sum() / (1 - seen).sum())
        w = _platt(margin, low + (high - low) * seen, w)
        if abs(floor - before) < 1e-7:
            break
    return float(w[0]), float(w[1]), floor


def _bag(sentence: str) -> set[str]:
    """The letters and digits of each unit, without those of over 2 * LONGEST characters."""
    return {re.sub(r"[\W_]+", "", u) for u in units_of(sentence) if 3 <= len(u) <= 2 * LONGEST} - {""}


def _variants(unit: str, rng: np.random.Generator, n: int) -> list[str]:
    """The unit with one character put in."""
    places = rng.integers(1, max(2, len(unit)), n)
    return [unit[:p] + chr(97 + int(rng.integers(26))) + unit[p:] for p in places]


def train(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, cost: float = 50_000.0, balance: float = 100.0, rounds: int = 4, begin: int = 3000) -> Machine:
    """A machine from the sentences of labelled documents; the first fit takes `begin` words of clean ones at most, the others add all that have a loss.

    cost: of the toxic rows together; balance: of the clean ones over that, so that words near insults stay clean and
    insults with a character put in come out above them."""
    rng = np.random.default_rng(17)
    y = np.array([1 if x else -1 for x in labels])
    if not (y > 0).any() or not (y < 0).any():
        return Machine(np.zeros(BASE**3), -1.0, 0.0, -50.0)
    # A sentence counts once, however many copies have it, and as clean if a clean document has it.
    sentences: dict[str, int] = {}
    for t, label in zip(texts, y.tolist(), strict=True):
        for s in {" ".join(s.lower().split()) for s in SENTENCE.split(t or "")}:
            sentences[s] = min(label, sentences.get(s, 1))
    parts = [(_bag(s), label) for s, label in sorted(sentences.items())]
    df = {1: Counter(), -1: Counter()}
    for bag, label in parts:
        df[label].update(bag)
    n_pos, n_neg = max(1, sum(label > 0 for _, label in parts)), max(1, sum(label < 0 for _, label in parts))

    def evidence(u: str) -> float:
        """Signed log-likelihood ratio that the unit marks toxic sentences."""
        a, b = df[1][u], df[-1][u]
        p, q, r = a / n_pos, b / n_neg, (a + b) / (n_pos + n_neg)
        part = lambda k, n, x: (k * math.log(x) if k else 0) + ((n - k) * math.log(1 - x) if k < n and x < 1 else 0)
        return (2 if p > q else -2) * (part(a, n_pos, p) + part(b, n_neg, q) - part(a, n_pos, r) - part(b, n_neg, r))

    # A passage that returns with changes makes many sentences and documents of the same neighbours: a unit counts
    # as often as it has different ones, and as it is in different documents.
    near: dict[str, set] = {}
    for s, label in sentences.items():
        if label > 0:
            words = ["", *(re.sub(r"[\W_]+", "", u) for u in s.split()), ""]
            for left, u, right in zip(words, words[1:], words[2:], strict=False):
                if u in df[1]:
                    near.setdefault(u, set()).add((left, right))
    bags = [set().union(*(_bag(s) for s in SENTENCE.split(t or ""))) for t in texts]
    in_docs = {k: Counter(u for bag, label in zip(bags, y.tolist(), strict=True) if label == k for u in bag) for k in (1, -1)}
    n_bad, n_good = int((y > 0).sum()), int((y < 0).sum())

    def least_odds(u: str) -> float:
        """Two standard errors below the log ratio of how often toxic and clean documents hold the unit."""
        a, b = min(in_docs[1][u], len(near.get(u, ()))) + 0.5, in_docs[-1][u] + 0.5
        return math.log(a / (n_bad + 1)) - math.log(b / (n_good + 1)) - 2 * math.sqrt(1 / a + 1 / b)

    marked = {u: evidence(u) for u in df[1] if df[1][u] > 1 and len(u) > 2}
    # Of n words without any meaning the greatest ratio is about 2 ln n.
    enough = 6 + 2 * math.log(1 + len(df[1]))
    marks = sorted((u for u in marked if marked[u] > enough and least_odds(u) > math.log(5)), key=lambda u: (-marked[u], u))
    if not marks:
        marks = sorted(marked, key=lambda u: (-marked[u], u))[:20]
    if not marks:
        return Machine(np.zeros(BASE**3), -1.0, 0.0, math.log(n_pos / n_neg))
    common = [u for u, _ in sorted(df[-1].items(), key=lambda x: (-x[1], x[0])) if len(u) > 3]
    chosen = list(dict.fromkeys(marks[: 2 * landmarks // 3] + common[: landmarks // 3]))
    phi = triple_features(chosen)
    values, vectors = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    use = values > 1e-6 * values[-1]
    white = vectors[:, use] / np.sqrt(values[use])
    spot = lambda us: kernel(us, phi) @ white

    names = sorted({*df[1], *df[-1]})
    number = {u: k for k, u in enumerate(names)}
    marks_set = set(marks)
    may = np.array([u in marks_set for u in names])
    at = {s: k for k, (s, _) in enumerate(sorted(sentences.items()))}
    units = [np.array(sorted(number[u] for u in bag), np.int64) for bag, _ in parts]
    toxic = np.array([label > 0 and bool(len(units[k])) and bool(may[units[k]].any()) for k, (_, label) in enumerate(parts)])
    clean = np.array([label < 0 and bool(len(units[k])) for k, (_, label) in enumerate(parts)])
    of_doc = [np.array(sorted({at[" ".join(s.lower().split())] for s in SENTENCE.split(t or "")}), np.int64) for t in texts]
    fold = rng.permutation(len(texts)) % FOLDS
    # What the fits don't read needn't lie beside them.
    del parts, bags, near, in_docs

    def witnesses(rows: np.ndarray, worth: np.ndarray) -> Counter:
        """Of each sentence its word of greatest worth, and of how many sentences it is that."""
        return Counter(int(u[worth[u].argmax()]) for u in (units[k] for k in rows))

    def fit(docs: np.ndarray) -> Machine:
        own = np.unique(np.concatenate([of_doc[i] for i in docs]))
        bad, good = own[toxic[own]], own[clean[own]]
        if not len(bad) or not len(good):
            return Machine(np.zeros(BASE**3), -1.0, 0.0, 0.0)
        # Before there is a machine: the strongest mark of a toxic sentence, and any word of a clean one.
        first = np.array([marked.get(u, 0.0) if may[k] else -math.inf for k, u in enumerate(names)])
        plus, minus = witnesses(bad, first), witnesses(good, rng.random(len(names)))
        if len(minus) > begin:
            minus = Counter({k: minus[k] for k in sorted(rng.choice(sorted(minus), begin, replace=False).tolist())})
        for _ in range(rounds):
            words = [names[k] for k in sorted(plus)]
            n = np.sqrt([plus[k] for k in sorted(plus)])
            against = sorted(minus)
            m = np.sqrt([minus[k] for k in against])
            rows = words + [v for u in words for v in _variants(u, rng, VARIANTS)]
            gain = np.concatenate([n, np.repeat(n, VARIANTS)])
            z = spot(rows + [names[k] for k in against])
            w = _svm(z, np.r_[np.ones(len(rows)), -np.ones(len(against))], cost * np.r_[gain / gain.sum(), balance * m / m.sum()])
            machine = Machine(phi.T.astype(np.float64) @ (white @ w[:-1]), float(w[-1]), 1.0, 0.0, tuple(chosen))
            margin = machine.margins(names)
            plus = witnesses(bad, np.where(may, margin, -math.inf))
            # All whose margin has a loss join those that were there: so no fit forgets the last one's.
            minus |= Counter({k: n for k, n in witnesses(good, margin).items() if margin[k] > -1})
        return machine

    worst = np.zeros(len(texts))
    for k in range(FOLDS):  # margins for the calibration are of documents that the machine hasn't met
        machine = fit(np.flatnonzero(fold != k))
        margin = machine.margins(names)
        for i in np.flatnonzero(fold == k):
            own = [units[j] for j in of_doc[i] if len(units[j])]
            worst[i] = max(margin[u].max() for u in own) if own else machine.bias
    slope, shift, floor = _calibrated(worst, y)
    whole = fit(np.arange(len(texts)))
    return Machine(whole.weights, whole.bias, slope, shift, whole.landmarks, floor)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> Machine:
    """From docs(doc_id, text) and labels(doc_id, toxic). The sample is chosen among the ids, so that
    only its documents' texts move; they come to the driver."""
    one = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") == 1).alias("is_toxic"))
    chosen = [one.where(F.col("is_toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for x in (True, False)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class rows
    got = docs.select("doc_id", "text").where(F.length("text") <= sample_chars).join(ids, "doc_id").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in got], [int(r["is_toxic"]) for r in got])


def score(docs: DataFrame, machine: Machine, at_once: int = 400) -> DataFrame:
    """docs with score, 0 to 1; a column by that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # one weight per letter triple: 256 KB
    at = place(docs, "text", ("score",))

    def start():
        scorer = Scorer(shared.value)

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(at)
            parts = (texts.slice(i, at_once).to_pylist() for i in range(0, batch.num_rows, at_once))
            return [pa.array([s for part in parts for s in scorer.scores(part)], pa.float64())]

        return each

    return mapped(docs, {"score": T.DoubleType()}, start)
