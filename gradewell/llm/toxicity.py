"""Toxicity by multiple-instance learning (operator 1).

A document is a bag of sentences. A sentence's score is logistic in its words, and
the document's is their noisy-or, 1 - prod(1 - p): one bad sentence is enough, and
the label of the document alone teaches which sentences are bad. Words are hashed to
2^18 features; words, sentences and bags are built by numpy over whole Arrow batches.

The model is fitted on at most about ``sample`` labelled documents of ``sample_bytes``
together (drawn by hash of doc_id, whole texts), whose hashed words reach the driver; its 1 MB of weights is
broadcast and scores every whole text.

Defined cases: null, empty or wordless text has no sentence and the score 0; a text
without sentence ends is one sentence; repeated rows are scored one by one; labels
that are null are not learned from; without any label of 1 every score is 0; a
document labelled twice counts twice; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import kernels as K
from gradewell.llm.common import crc_mod, documents

BITS = 18
THRESHOLD = 0.3
GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass(frozen=True)
class Params:
    sample: int = 16000
    sample_bytes: int = 128 << 20
    least_documents: int = 8     # words of fewer sample documents have no weight,
    evidence: float = 4.0        # nor those whose share of toxic documents exceeds the usual by fewer standard deviations
    epochs: int = 40
    batch: int = 256
    rate: float = 0.5
    l2: float = 1e-4
    start: float = -6.0          # first log-odds of any sentence
    seed: int = 7


def bags(column):
    """(feature of each word, start of each sentence's words, start of each document's
    sentences, byte spans of the sentences, bytes, offsets)."""
    data, off = K.buffer(column)
    s, e, h, woff = K.words(data, off, ws=GAPS)
    feature = (h >> np.uint64(64 - BITS)).astype(np.int32)
    mark = np.cumsum(ENDS[data], dtype=np.int64) if len(data) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    key = mark[s] if len(s) else mark[:0]
    new = np.ones(len(s), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    soff = np.searchsorted(first, woff)
    last = np.append(first[1:], len(s))[:len(first)] - 1
    return feature, first, soff, (s[first], e[last]), data, off


def softplus(z):
    return np.logaddexp(0.0, z)


def sums(values, first):
    return np.add.reduceat(values, first) if len(first) else values[:0]


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def sentences(self, feature, first):
        """Log-odds of each sentence."""
        return sums(self.weights[feature].astype(np.float64), first) + self.bias


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], p: Params = Params()) -> Model:
    """docs: (features, starts of sentences, label). Adagrad on the noisy-or likelihood."""
    dims = 1 << BITS
    weights, bias = np.zeros(dims), p.start
    seen, toxic = np.zeros(dims), np.zeros(dims)
    docs = [d for d in docs if len(d[0])]
    for f, _, y in docs:
        own = np.unique(f)
        seen[own] += 1
        toxic[own] += y
    usual = np.clip(np.mean([y for _, _, y in docs] or [0.5]), 1e-6, 1 - 1e-6)
    sigma = np.sqrt(np.maximum(seen, 1) * usual * (1 - usual))
    keep = (seen >= p.least_documents) & (toxic - seen * usual >= p.evidence * sigma)
    if not any(y for _, _, y in docs):
        return Model(weights, -100.0)
    gw, gb = np.full(dims, 1e-4), 1e-2
    rng = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), p.batch):
            part = [docs[i] for i in order[a:a + p.batch]]
            f = np.concatenate([d[0] for d in part])
            nw = np.array([len(d[0]) for d in part])
            ns = np.array([len(d[1]) for d in part])
            first = np.concatenate([d[1] + o for d, o in zip(part, np.concatenate(([0], np.cumsum(nw)[:-1])))])
            heads = np.concatenate(([0], np.cumsum(ns)[:-1]))
            y = np.array([d[2] for d in part])
            z = sums(np.where(keep[f], weights[f], 0.0), first) + bias
            total = np.maximum(sums(softplus(z), heads), 1e-9)
            slope = np.where(y == 1, -1 / np.expm1(np.minimum(total, 500)), 1.0)
            slope = np.repeat(np.clip(slope, -50, 1), ns) / (1 + np.exp(-z)) / len(part)
            per_word = np.repeat(slope, np.diff(np.append(first, len(f))))
            touched, at = np.unique(f, return_inverse=True)
            g = np.bincount(at, per_word) + p.l2 * weights[touched]
            g *= keep[touched]
            gw[touched] += g * g
            weights[touched] -= p.rate / np.sqrt(gw[touched]) * g
            b = slope.sum()
            gb += b * b
            bias -= p.rate / np.sqrt(gb) * b
    weights[~keep] = 0
    return Model(weights, float(bias))


def _features(batches):
    for b in K.slices(batches):
        feature, first, soff, _, _, _ = bags(b.column("text"))
        wfirst = np.append(first, len(feature))[soff]
        own = first - np.repeat(wfirst[:-1], np.diff(soff))
        yield pa.RecordBatch.from_arrays(
            [K.string_list(feature, wfirst, pa.int32()), K.string_list(own.astype(np.int32), soff, pa.int32()), b.column("y")],
            ["f", "s", "y"])


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Fit on the documents of ``docs`` that ``labels`` (doc_id, toxic) covers: all, or a share that is
    expected to hold ``sample`` documents and ``sample_bytes`` of text at most."""
    docs = docs.select("doc_id", "text")
    known = labels.where("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("y"))
    size = docs.select("doc_id", F.octet_length("text").alias("b")).join(known.select("doc_id"), "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    space = 1 << 30
    limit = int(space * min(1.0, p.sample / max(1, size["n"]), p.sample_bytes / max(1, size["b"] or 0)))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < limit)
    rows = docs.join(drawn, "doc_id").select("text", "y").mapInArrow(_features, "f array<int>, s array<int>, y int").toArrow()
    f, s, y = (rows.column(k).combine_chunks() for k in range(3))
    fo, so = f.offsets.to_numpy(), s.offsets.to_numpy()
    fv, sv = f.values.to_numpy(), s.values.to_numpy()
    bag = [(fv[a:b], sv[c:d], l) for a, b, c, d, l in zip(fo, fo[1:], so, so[1:], y.to_pylist())]
    bag.sort(key=lambda d: (len(d[0]), d[2], d[0].tobytes()))  # the same model however rows arrive
    return fit(bag, p)


def _score(model, threshold: float):
    def run(batches):
        m = model.value
        for b in K.slices(batches):
            feature, first, soff, (s, e), data, off = bags(b.column("text"))
            z = m.sentences(feature, first)
            upto = np.concatenate(([0.0], np.cumsum(softplus(z))))
            score = np.array([-np.expm1(-softplus(z[x:y]).sum()) for x, y in zip(soff[:-1], soff[1:])]) if len(soff) > 1 else upto[:0]
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            bad = np.flatnonzero(z > np.log(threshold / (1 - threshold)))
            doc = np.searchsorted(soff, bad, "right") - 1
            where: list[list[str]] = [[] for _ in range(b.num_rows)]
            for d, x, y in zip(doc.tolist(), s[bad].tolist(), e[bad].tolist()):
                where[d].append(f"{chars[x] - chars[off[d]]}:{chars[y] - chars[off[d]]}")
            score = np.clip(score, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)),
                 pa.array(np.diff(soff).astype(np.int32)), pa.array([",".join(w) for w in where], pa.string())],
                ["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"])
    return run


def score(docs: DataFrame, model: Model, held_out=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, offending: start:end (code points) of
    the sentences that reach the threshold on their own."""
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), threshold),
                           "doc_id long, held_out boolean, score double, predicted int, n_sentences int, offending string")


def op1_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held), labels.where(~held))
    return score(docs, model, held)
