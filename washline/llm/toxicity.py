"""Toxicity: subsequence string kernel, Nystroem landmarks, linear support vector machine.

A text is cut into units: its white-space separated words, lower-cased, with only
their letters kept (so ``i.d.i.o.t`` is ``idiot``); neighbouring one-letter words
are joined (``i d i o t``). Two units are compared by the gap-weighted subsequence
kernel of order ``ORDER`` (decay ``DECAY`` per spanned character), which forgives
inserted characters. A unit is mapped to its kernel values with the landmarks, a
linear machine scores the map, and a text takes its most toxic unit, turned into a
probability by a logistic link. Units of more than ``WINDOW`` letters are read in
overlapping windows, so whole texts are scored.

Training is multiple-instance: labels are per text, so each toxic training text
gives one witness unit (first by the likelihood ratio of its character 4-grams and of the unit
itself, then by the machine's own score), and units of clean training texts are the negatives,
mined for the hard ones. A unit that clean texts hold, too, only weighs less. In the first
round texts whose witness has under ``FAINT`` of the strongest witness's evidence wait.
The training rows are a bounded sample: the ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean
labelled texts with the smallest hash of their id, from rows that are not held out (of
several texts with one id the smallest); ``WITNESSES``, ``COMMON``, ``SPREAD`` and ``HARD``
bound the units that one fit of the machine works on.

Insults of two words whose halves are harmless leave training texts on the wrong side. If
these are more than ``UNEXPLAINED`` of the toxic or of the clean ones, a second machine is
fitted to word sequences: the kernel of two neighbouring units with a landmark pair is the
product of their unit kernels, a text's feature is the largest product in it, and the
machine weighs these features and the score of the text's most toxic unit.

Defined results: null, empty and letterless texts score as a text without any
toxic unit; without toxic or without clean training rows every score is 0 (with a warning);
rows with a null label are not learned from; repeated rows are scored one by one; columns
named ``score`` or ``predicted`` are replaced, all others kept.
"""

from __future__ import annotations

import warnings
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.llm import common as C

ORDER, DECAY, WINDOW, STRIDE = 3, 0.7, 24, 8
MAX_TOXIC, MAX_CLEAN, LANDMARKS = 1500, 3000, 32
FAINT, UNEXPLAINED, PAIRS = 0.1, 0.1, 16
WITNESSES, COMMON, SPREAD, HARD = 400, 1000, 3000, 1500
CACHE_UNITS = 2_000_000

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def units(buf: np.ndarray, offsets: np.ndarray):
    """(bytes, starts, ends, units per text) of the texts' units."""
    low = C.lower_ascii(buf)
    gap = C.SPACE[low]
    keep = _LETTER[low] | gap
    low, at = low[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    starts, ends = C.words(low, at)
    lead = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
    single = lead[ends] - lead[starts] == 1
    rows = np.repeat(np.arange(len(at) - 1), C.per_text(at, starts))
    join = np.flatnonzero(single[1:] & single[:-1] & (rows[1:] == rows[:-1]))
    if len(join):
        edge = np.zeros(len(low) + 1, np.int64)
        np.add.at(edge, ends[join], 1)
        np.add.at(edge, starts[join + 1], -1)
        keep = np.cumsum(edge)[:-1] == 0
        low, at = low[keep], np.concatenate([[0], np.cumsum(keep)])[at]
        starts, ends = C.words(low, at)
    return low, starts, ends, C.per_text(at, starts)


def codes(words: list[str], fill: int) -> np.ndarray:
    """Code points, one row per word, padded with ``fill``."""
    size = max([1, *map(len, words)])
    out = np.full((len(words), size), fill, np.int32)
    for i, w in enumerate(words):
        out[i, :len(w)] = [ord(c) for c in w]
    return out


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of order ORDER: ``s`` (V, L) against ``t`` (V or 1, m, l) -> (V, m)."""
    lam = np.float32(DECAY)
    cols = np.moveaxis(t, 2, 0)
    shape = (len(cols), len(s), cols.shape[2])
    # by order: the decayed sums over the prefixes read so far; one character of ``s`` at a time, so these stay in the processor's cache
    sums = [np.zeros(shape, np.float32) for _ in range(ORDER - 1)]
    total = np.zeros(shape[1:], np.float32)
    for c in s.T:
        same = (c[None, :, None] == cols) * (lam * lam)
        total += (same[1:] * sums[-1][:-1]).sum(0)
        for p in range(ORDER - 2, -1, -1):
            hit = same.copy()
            if p:
                hit[0] = 0
                hit[1:] *= sums[p - 1][:-1]
            for k in range(1, len(hit)):
                hit[k] += lam * hit[k - 1]
            sums[p] *= lam
            sums[p] += hit
    return total


def own_kernel(s: np.ndarray) -> np.ndarray:
    """kernel(x, x) for each row of ``s`` (padding counts as unlike anything)."""
    t = np.where(s < 0, -9, s)
    return kernel(s, t[:, None, :])[:, 0]


def normalised(words: list[str], landmarks: np.ndarray, own: np.ndarray, step: int = 256) -> np.ndarray:
    """Normalised kernel of each word with each landmark; 0 for words shorter than the order."""
    out = np.zeros((len(words), len(own)), np.float32)
    order = np.argsort([len(w) for w in words], kind="stable")
    for lo in range(0, len(words), step):
        part = order[lo:lo + step]
        s = codes([words[i] for i in part], -1)
        k, d = kernel(s, landmarks[None]), own_kernel(s)
        out[part] = k / np.sqrt(np.maximum(d, 1e-12))[:, None] / np.sqrt(np.maximum(own, 1e-12))[None]
    return out


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i:i + WINDOW] for i in range(0, len(word) - WINDOW + STRIDE, STRIDE)]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 40) -> np.ndarray:
    """Linear support vector machine (squared hinge, primal Newton); the last coefficient is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    reg = np.eye(x.shape[1])
    reg[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        active = y * (x @ w) < 1
        a, cw = x[active], c * weight[active]
        new = np.linalg.solve(reg + (a * cw[:, None]).T @ a, (a * cw[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


@dataclass
class KernelMachine:
    """Landmarks (bounded: LANDMARKS strings), their coefficients, and the link a*x+b."""

    landmarks: list[str] = field(default_factory=list)
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -1.0
    link: tuple[float, float] = (0.0, -35.0)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    pair_beta: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def pair_marks(self):
        marks = codes([a for a, _ in self.pairs] + [b for _, b in self.pairs], -2)
        return marks, own_kernel(np.where(marks < 0, -1, marks))

    def pair_features(self, words: list[str], at: np.ndarray, counts: np.ndarray, ready) -> np.ndarray:
        """(texts, pairs): the largest product kernel over neighbouring units; ``at`` numbers the units' words in order."""
        k, n = len(self.pairs), np.cumsum([0, *counts])
        near = normalised([w[:WINDOW] for w in words], *ready)
        out = np.zeros((len(counts), k), np.float32)
        has = np.asarray(counts) > 0
        if has.any():
            product = np.zeros((len(at), k), np.float32)
            product[:-1] = near[at[:-1], :k] * near[at[1:], k:]
            product[n[1:][has] - 1] = 0         # a text's last unit has no neighbour
            out[has] = np.maximum.reduceat(product, n[:-1][has])
        return out

    def text_scores(self, best: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Scores from the most toxic unit and the pair features; ``pair_beta`` holds the weights of both, then the bias."""
        return best * self.pair_beta[0] + features @ self.pair_beta[1:-1] + self.pair_beta[-1]

    def prepared(self):
        marks = codes(self.landmarks, -2)
        return marks, own_kernel(np.where(marks < 0, -1, marks))

    def unit_scores(self, found: list[str], ready=None) -> np.ndarray:
        """Machine score of each unit; a long unit takes its best window."""
        if not self.landmarks:
            return np.full(len(found), self.bias)
        marks, own = ready or self.prepared()
        parts = [windows(w) for w in found]
        flat = normalised([p for ps in parts for p in ps], marks, own) @ self.beta + self.bias
        return np.maximum.reduceat(flat, np.cumsum([0, *map(len, parts)])[:-1]) if found else flat

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.link[0] * best + self.link[1], -35, 35)))


def _grams(word: str, n: int = 4) -> set[str]:
    return {word[i:i + n] for i in range(max(1, len(word) - n + 1))}


def _machine(positive: Counter, negative: list[str], landmarks: list[str]) -> KernelMachine:
    m = KernelMachine(landmarks, np.zeros(len(landmarks)))
    marks, own = m.prepared()
    values, vectors = np.linalg.eigh(normalised(landmarks, marks, own).astype(float))
    good = values > 1e-4
    nystroem = vectors[:, good] / np.sqrt(values[good])
    pos = list(positive)
    # a character inserted in the middle of a witness leaves it a witness
    gapped = [w[:i] + "qxz"[i % 3] + w[i:] for w in pos if len(w) <= 12 for i in (len(w) // 3, len(w) // 2) if i > 0]
    x = normalised(pos + gapped + negative, marks, own).astype(float) @ nystroem
    y = np.concatenate([np.ones(len(pos) + len(gapped)), -np.ones(len(negative))])
    weight = np.concatenate([np.sqrt([positive[w] for w in pos]), np.full(len(gapped), 0.5), np.ones(len(negative))])
    weight[y > 0] *= len(y) / 2 / max(weight[y > 0].sum(), 1e-9)
    weight[y < 0] *= len(y) / 2 / max(weight[y < 0].sum(), 1e-9)
    w = squared_hinge(x, y, weight)
    m.beta, m.bias = nystroem @ w[:-1], float(w[-1])
    return m


def train(texts: list[tuple[int, list[str]]], landmarks: int = LANDMARKS) -> KernelMachine:
    """Fit on (label, distinct units) pairs of the training texts."""
    return learn(texts, landmarks)[0]


def learn(texts: list[tuple[int, list[str]]], landmarks: int = LANDMARKS) -> tuple[KernelMachine, dict[str, float]]:
    """The machine of ``train`` and its score of each training unit."""
    texts = [(y, list(u)) for y, u in sorted({(y, tuple(u)) for y, u in texts if u})]     # copies are no evidence
    toxic, clean = ([u for y, u in texts if y == k] for k in (1, 0))
    if not toxic or not clean:
        warnings.warn("no toxicity machine: the training rows hold only one label", stacklevel=3)
        return KernelMachine(), {}
    bad, good = Counter(), Counter()
    for target, group in ((bad, toxic), (good, clean)):
        for u in group:
            target.update(set().union(*(_grams(w) for w in u)))
    share = len(toxic) / (len(toxic) + len(clean))

    llr = {g: evidence(n, good[g], share) for g, n in bad.items()}
    in_clean = Counter(w for u in clean for w in u)
    in_toxic = Counter(w for u in toxic for w in u)

    told_by = {}
    for w, n in in_toxic.items():
        whole = evidence(n, in_clean[w], share)
        told_by[w] = (min(max(llr.get(g, 0.0) for g in _grams(w)), 4 * whole), whole, w)
    # the unit with the most telling 4-gram, that itself leans to the toxic texts
    told = [max(told_by[w] for w in u) for u in toxic]
    firsts = [w for _, _, w in told]
    strongest = max(e for e, _, _ in told)
    picks = [w if e > FAINT * strongest else "" for e, _, w in told]
    vocabulary = sorted(in_clean, key=lambda w: (-in_clean[w], w))
    step = max(1, len(vocabulary) // SPREAD)
    negative = list(dict.fromkeys([*vocabulary[:COMMON], *vocabulary[::step]]))
    found, pool = list(in_clean), list(in_clean | in_toxic)
    machine = KernelMachine()
    for _ in range(2):
        positive = Counter(p for p in picks if p)
        if not positive:
            break
        ranked = sorted(positive, key=lambda w: (-positive[w], w))[:WITNESSES]
        # farthest-first choice of landmarks among the witnesses
        marks = codes(ranked, -2)
        sim = normalised(ranked, marks, own_kernel(np.where(marks < 0, -1, marks)))
        chosen, near = [0], sim[0].copy()
        while len(chosen) < min(landmarks * 3 // 4, len(ranked)):
            i = int(np.argmin(near))
            if near[i] > 0.98:
                break
            chosen.append(i)
            near = np.maximum(near, sim[i])
        own = [ranked[i] for i in chosen]
        hard = negative[-WITNESSES:]
        marks = codes(own, -2)
        close = normalised(hard, marks, own_kernel(np.where(marks < 0, -1, marks))).max(1)
        own += [hard[i] for i in np.argsort(-close)[:landmarks - len(own)]]
        machine = _machine(positive, negative, list(dict.fromkeys(own)))
        score = dict(zip(pool, machine.unit_scores(pool)))
        scores = np.array([score[w] for w in found])
        worst = [found[i] for i in np.argsort(-scores)[:HARD] if scores[i] > -1.0]
        mined = set(worst)
        negative = [w for w in negative if w not in mined] + worst[::-1]
        best = [max(u, key=lambda w: (score[w], w)) for u in toxic]
        picks = [w if score[w] > 0 else f for w, f in zip(best, firsts)]
    if not machine.landmarks:
        warnings.warn("no toxicity machine: no unit leans to the toxic texts", stacklevel=3)
        return machine, {}
    x = np.array([max(score[w] for w in u) for u in [*toxic, *clean]])
    machine.link = link(x, np.array([1.0] * len(toxic) + [0.0] * len(clean)))
    return machine, score


def evidence(n: int, m: int, share: float) -> float:
    """Log-likelihood ratio of something that ``n`` toxic and ``m`` clean texts hold, if it leans to the toxic ones."""
    if n <= share * (n + m):
        return 0.0
    return 2 * (n * np.log(n / ((n + m) * share)) + (m * np.log(m / ((n + m) * (1 - share))) if m else 0.0))


def link(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic link a*x+b by Newton steps, lightly regularised."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum()])
        q = p * (1 - p)
        h = np.array([[(q * x * x).sum() + 0.01, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train_pairs(machine: KernelMachine, texts: list[tuple[int, list[str]]]) -> KernelMachine:
    """Add the machine for neighbouring units; ``texts`` holds (label, units in order)."""
    texts = [(y, list(u)) for y, u in sorted({(y, tuple(u)) for y, u in texts if u})]
    y = np.array([float(t[0]) for t in texts])
    best = np.array([max(machine.unit_scores(list(dict.fromkeys(u)))) for _, u in texts])
    toxic, clean = np.flatnonzero(y).tolist(), np.flatnonzero(y == 0).tolist()
    held = [set(zip(u, u[1:])) for _, u in texts]
    good, share = Counter(p for i in clean for p in held[i]), len(toxic) / len(texts)
    chosen: list[tuple[str, str]] = []
    left, strongest = toxic, 0.0
    while left and len(chosen) < PAIRS:         # the strongest pair of the texts that no pair explains yet
        bad = Counter(p for i in left for p in held[i])
        strength, pair = max(((evidence(n, good[p], share), p) for p, n in bad.items()), default=(0.0, None))
        strongest = max(strongest, strength)
        if strength <= FAINT * strongest or bad[pair] < 2:      # a pair that one text holds says nothing about others
            break
        chosen.append(pair)
        left = [i for i in left if pair not in held[i]]
    if not chosen:
        return machine
    machine.pairs = chosen
    words = sorted({w for _, u in texts for w in u})
    number = {w: i for i, w in enumerate(words)}
    at = np.array([number[w] for _, u in texts for w in u])
    x = machine.pair_features(words, at, np.array([len(u) for _, u in texts]), machine.pair_marks()).astype(float)
    weight = np.where(y > 0, 0.5 / len(toxic), 0.5 / len(clean)) * len(texts)
    machine.pair_beta = squared_hinge(np.column_stack([best, x]), 2 * y - 1, weight)
    machine.link = link(machine.text_scores(best, x), y)
    return machine


def _training_rows(batches, in_order: bool = False):
    """Distinct units of each training text, or all of them in order."""
    for b in batches:
        buf, off = C.utf8(b.column(1))
        for lo, hi in C.slices(off):
            low, starts, ends, counts = units(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            raw, cut = low.tobytes(), np.cumsum([0, *counts])
            got = []
            for i in range(hi - lo):
                own = [raw[starts[k]:ends[k]].decode("utf-8", "replace") for k in range(cut[i], cut[i + 1])]
                got.append("\n".join([w[:WINDOW] for w in own] if in_order else sorted({p for w in own for p in windows(w)})))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(got, pa.string())], names=["label", "units"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> KernelMachine:
    """Learn ``label`` (0/1) of ``labels(doc_id, ...)`` from ``docs(doc_id, text)``."""
    C.ship(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = (known.where("label = 1").orderBy(*order).limit(MAX_TOXIC)
              .unionByName(known.where("label = 0").orderBy(*order).limit(MAX_CLEAN)))
    rows = (docs.select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id").where("text is not null")
            .groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text"))
    got = rows.mapInArrow(_training_rows, "label int, units string").collect()
    texts = sorted((r.label, r.units.split("\n") if r.units else []) for r in got)
    machine, score = learn(texts)
    if not machine.landmarks:
        return machine
    wrong = [[(max(score[w] for w in u) > 0) != bool(y) for y, u in texts if u and y == k] for k in (0, 1)]
    if any(sum(w) > UNEXPLAINED * len(w) for w in wrong):
        got = rows.mapInArrow(lambda it: _training_rows(it, in_order=True), "label int, units string").collect()
        machine = train_pairs(machine, sorted((r.label, r.units.split("\n") if r.units else []) for r in got))
    return machine


class _Scorer:
    """A machine with a bounded cache of unit scores, keyed by content hash."""

    def __init__(self, machine: KernelMachine):
        self.machine, self.ready = machine, machine.prepared() if machine.landmarks else None
        self.keys, self.values = np.zeros(0, C.U64), np.zeros(0)
        self.marks = machine.pair_marks() if machine.pairs else None

    def best(self, buf, offsets) -> np.ndarray:
        low, starts, ends, counts = units(buf, offsets)
        out = np.full(len(counts), -1e9)
        if not len(starts):
            return out
        keys, first, back = np.unique(C.span_hashes(C.prefix_sums(low), starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        scores = np.empty(len(keys))
        scores[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw, f = low.tobytes(), first[new]
            scores[new] = self.machine.unit_scores(
                [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[f], ends[f])], self.ready)
            if len(self.keys) + len(new) > CACHE_UNITS:
                self.keys, self.values = np.zeros(0, C.U64), np.zeros(0)
            place = np.searchsorted(self.keys, keys[new])
            self.keys, self.values = np.insert(self.keys, place, keys[new]), np.insert(self.values, place, scores[new])
        has = counts > 0
        cuts = np.concatenate([[0], np.cumsum(counts)])[:-1][has]
        out[has] = np.maximum.reduceat(scores[back], cuts)
        if self.machine.pairs:
            raw = low.tobytes()
            words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[first], ends[first])]
            found = self.machine.pair_features(words, back, counts, self.marks)
            out[has] = self.machine.text_scores(out[has], found[has])
        return out


_SCORERS: dict = {}


def transform(machine: KernelMachine, docs: DataFrame, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    C.ship(docs.sparkSession)
    keep, schema = C.with_columns_schema(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    model = docs.sparkSession.sparkContext.broadcast(machine)
    key = f"{docs.sparkSession.sparkContext.applicationId}-{id(machine)}-{machine.link}-{machine.landmarks[:3]}"

    def run(batches):
        from washline.llm import toxicity as home     # the worker's own module: its cache outlives a task
        if key not in home._SCORERS:
            home._SCORERS.clear()
            home._SCORERS[key] = home._Scorer(model.value)
        scorer = home._SCORERS[key]
        for b in batches:
            buf, off = C.utf8(b.column(text))
            parts = [scorer.best(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]) for lo, hi in C.slices(off)]
            best = np.concatenate(parts) if parts else np.zeros(0)
            none = model.value.text_scores(model.value.bias, np.zeros(len(model.value.pairs))) if model.value.pairs else model.value.bias
            s = model.value.probability(np.where(best < -1e8, none, best))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[*keep, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, C.table(spark, sf_dir, "labels").where(~C.held_out(F.col("doc_id"))))
    return transform(machine, docs).select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
