"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal updates.

Tokens are runs of letters, of digits and of other signs (white space separates);
their 1- and 2-grams are hashed into ``2**bits`` weights; a 2-gram of a word with
itself, and a 3-gram that returns to its first word, share a slot for all words, so
stuttering text is seen whatever it repeats. A text is scored as one sparse dot
product, the mean weight of its n-grams, through the logistic link.

Training rows are a bounded sample: the ``max_train`` labelled documents with the
smallest hash of their id. Everything else reads all rows and whole texts.

Defined results: null and empty texts score the bias alone; rows with a null label
or without a document are not learned from; without any labelled row the score is
0.5; repeated rows are scored one by one; columns named ``score`` or ``predicted``
are replaced, all others kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.llm import common as C

MAX_TRAIN = 6000
BITS = 20
_KIND = np.full(256, 1, np.uint8)       # letters and every byte of a longer UTF-8 sequence
_KIND[:128] = 3                         # signs
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[C.SPACE] = 0


_AGAIN, _ECHO = C.mix(np.array([101, 102], C.U64))


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text row) of every n-gram of the texts."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[buf]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    cut = offsets[1:-1]
    new[cut[cut < n]] = True
    edges = np.flatnonzero(new)
    ends = np.append(edges[1:], n)
    ink = kind[edges] > 0
    starts, ends = edges[ink], ends[ink]
    counts = C.per_text(offsets, starts)
    h = C.span_hashes(C.prefix_sums(C.lower_ascii(buf)), starts, ends)
    rows = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        two = C.mix(h[:-1] * C.U64(0x2545F4914F6CDD1D) + h[1:])
    two[h[1:] == h[:-1]] = _AGAIN       # "w w", whatever the word
    same = rows[1:] == rows[:-1]
    echo = (h[2:] == h[:-2]) & (rows[2:] == rows[:-2])      # "w x w"
    slots = np.concatenate([h, two[same], np.full(int(echo.sum()), _ECHO)]) >> C.U64(64 - bits)
    return slots.astype(np.int64), np.concatenate([rows, rows[:-1][same], rows[:-2][echo]])


def _examples(batches, bits):
    """One row per training document: its label, distinct slots and their shares."""
    for b in batches:
        buf, off = C.utf8(b.column(1))
        labels = b.column(0).to_pylist()
        for lo, hi in C.slices(off):
            slots, rows = features(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], bits)
            order = np.argsort(rows, kind="stable")
            cuts = np.searchsorted(rows[order], np.arange(hi - lo + 1))
            out = []
            for i in range(hi - lo):
                idx, c = np.unique(slots[order[cuts[i]:cuts[i + 1]]], return_counts=True)
                x = (c / max(1, c.sum())).astype(np.float32)
                out.append((labels[lo + i], idx.astype(np.int32).tobytes(), x.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()),
                 pa.array([o[2] for o in out], pa.binary())], names=["label", "slots", "shares"])


def ftrl(examples: list, dims: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4,
         epochs: int = 4, scale: float = 10.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Follow-the-regularised-leader (proximal, per-coordinate rates): weights and bias.

    ``examples``: (label, slots, shares); shares are multiplied by ``scale``.
    The weight of a coordinate is derived from its sums z and n when it is met.
    """
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)       # the last slot is the bias

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for e in rng.permutation(len(examples)):
            y, slots, shares = examples[e]
            i = np.append(slots, dims)
            x = np.append(shares * scale, 1.0)
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(dims + 1))
    return (w[:-1] * scale).astype(np.float32), float(w[-1])


@dataclass
class HashedNgramClassifier:
    """A fitted model: ``2**bits`` weights and a bias (bounded: 4 MB at 20 bits)."""

    weights: np.ndarray
    bias: float
    bits: int

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, label: str, max_train: int = MAX_TRAIN,
            bits: int = BITS) -> "HashedNgramClassifier":
        """Learn ``label`` (0/1) of ``labels(doc_id, ...)`` from the texts of ``docs(doc_id, text)``."""
        C.ship(docs.sparkSession)
        picked = (labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
                  .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train))
        rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "text")
        out = rows.mapInArrow(lambda it: _examples(it, bits), "label int, slots binary, shares binary").collect()
        examples = sorted((int(r.label), bytes(r.slots), bytes(r.shares)) for r in out)
        examples = [(y, np.frombuffer(a, np.int32), np.frombuffer(b, np.float32).astype(float)) for y, a, b in examples]
        w, b = ftrl(examples, 1 << bits)
        return HashedNgramClassifier(w, b, bits)

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text."""
        n = len(offsets) - 1
        slots, rows = features(buf, offsets, self.bits)
        dot = np.bincount(rows, weights=self.weights[slots], minlength=n)
        grams = np.bincount(rows, minlength=n)
        return 1.0 / (1.0 + np.exp(-np.clip(dot / np.maximum(grams, 1) + self.bias, -35, 35)))

    def transform(self, docs: DataFrame, threshold: float = 0.7, text: str = "text") -> DataFrame:
        """``docs`` with ``score`` and ``predicted``."""
        C.ship(docs.sparkSession)
        keep, schema = C.with_columns_schema(docs, [T.StructField("score", T.DoubleType()),
                                                    T.StructField("predicted", T.IntegerType())])
        model = docs.sparkSession.sparkContext.broadcast((self.weights, self.bias, self.bits))

        def run(batches):
            own = HashedNgramClassifier(*model.value)
            for b in batches:
                buf, off = C.utf8(b.column(text))
                parts = [own.score(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]) for lo, hi in C.slices(off)]
                s = np.concatenate(parts) if parts else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in keep] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    names=[*keep, "score", "predicted"])

        return docs.mapInArrow(run, schema)


def quality_model(docs: DataFrame, labels: DataFrame) -> HashedNgramClassifier:
    """Fit on the labelled rows that are not held out."""
    return HashedNgramClassifier.fit(docs, labels.where(~C.held_out(F.col("doc_id"))), "quality")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, C.table(spark, sf_dir, "labels"))
    return model.transform(docs).select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
