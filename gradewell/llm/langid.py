"""Language identification by sparse multinomial logistic regression (operator 3).

Features are character 1- to 4-grams of the lower-cased text (everything but letters
is one space), hashed to 2^16; their value is the share in the text times the inverse
document frequency, which is counted over all training documents. Weights are fitted by follow-the-regularised-
leader with elastic-net penalties on about ``sample`` training documents, the same number of
each language and ``least`` of it or all (drawn by hash of doc_id, whole texts, ``sample_bytes`` together
at most); the bias then takes back what the drawing changed in the languages' shares. A temperature fitted on a fifth of them, kept out of the
fit, calibrates the scores. Weights are broadcast (2^16 x languages, zero for most).

Defined cases: null text or text without a letter is "und" with score 0; so is every
text if nothing can be learned; with one known language every other text gets it;
repeated rows are predicted one by one; rows without lang are not learned from;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import kernels as K
from gradewell.llm.common import crc_mod, documents

BITS = 16
SCALE = 30.0


@dataclass(frozen=True)
class Params:
    sample: int = 4000
    least: int = 50
    sample_bytes: int = 64 << 20
    orders: tuple = (1, 2, 3, 4)
    epochs: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    seed: int = 5


def _letters() -> np.ndarray:
    """For each code point of the first plane, whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x10000)])


LETTER = _letters()


def letters(texts: list):
    """(code points with non-letters as space and a 0 before and after each text, place of the 0 before each)."""
    texts = [(t or "").lower() for t in texts]
    joined = "\0" + "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(c, 0xFFFF)
    ok = LETTER[low]
    high = np.flatnonzero(c > 0xFFFF)
    if len(high):
        ok = ok.copy()
        ok[high] = [chr(x).isalpha() for x in c[high].tolist()]
    out = np.where(ok, c, 32).astype(np.uint64)
    zero = np.flatnonzero(c == 0)
    out[zero] = 0
    return out, ok, zero


def grams(c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, whether within one text and not all spaces) of the n-gram at every place."""
    m = max(0, len(c) - n + 1)
    v = np.zeros(m, np.uint64)
    inside, solid = np.ones(m, bool), np.zeros(m, bool)
    for k in range(n):
        part = c[k:k + m]
        v += part * K.ORDER[k]
        inside &= part != 0
        solid |= part != 32
    return (K.mix(v + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64), inside & solid


def _features(c, zero, orders):
    """For each order: features and starts of the texts among them."""
    for n in orders:
        f, ok = grams(c, n)
        at = np.flatnonzero(ok)
        yield f[at], np.searchsorted(at, zero)


def _frequencies(orders):
    def run(batches):
        total, flag = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool)
        for b in K.slices(batches):
            c, _, zero = letters(b.column("text").to_pylist())
            parts = list(_features(c, zero, orders))
            for i in range(b.num_rows):
                flag[:] = False
                for f, off in parts:
                    flag[f[off[i]:off[i + 1]]] = True
                total += flag
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["f", "n"])
    return run


def _counted(orders):
    def run(batches):
        for b in K.slices(batches):
            c, _, zero = letters(b.column("text").to_pylist())
            parts = list(_features(c, zero, orders))
            fs, ns = [], []
            for i in range(b.num_rows):
                f, n = np.unique(np.concatenate([f[off[i]:off[i + 1]] for f, off in parts]), return_counts=True)
                fs.append(f.astype(np.int32))
                ns.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(fs, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.int32()))], ["lang", "f", "n"])
    return run


def softmax(z):
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


class Model:
    def __init__(self, langs, table, bias, temperature):
        self.langs, self.table, self.bias, self.temperature = langs, table, bias, temperature


def fit(examples: list, idf: np.ndarray, p: Params = Params()) -> Model:
    """examples: (lang, features, counts)."""
    langs = sorted({e[0] for e in examples if len(e[1])})
    k = len(langs)
    z, n = np.zeros(((1 << BITS) + 1, k)), np.zeros(((1 << BITS) + 1, k))  # the last row is the bias

    def weights(i):
        a = z[i]
        w = -(a - np.sign(a) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)
        return np.where(np.abs(a) <= p.l1, 0.0, w)

    data = [(langs.index(lang), np.append(f, 1 << BITS), np.append(c / c.sum() * idf[f] * SCALE, 1.0)) for lang, f, c in examples if len(f)]
    rng = np.random.default_rng(p.seed)
    order = rng.permutation(len(data))
    kept_out, own = order[:len(order) // 5], order[len(order) // 5:]
    for _ in range(p.epochs if k else 0):
        for i in rng.permutation(own).tolist():
            y, f, x = data[i]
            w = weights(f)
            g = softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g[None, :]
            s = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / p.alpha
            z[f] += g - s * w
            n[f] += g * g
    table = weights(np.arange((1 << BITS) + 1))
    temperature = 1.0
    if len(kept_out):
        logits = np.array([data[i][2] @ table[data[i][1]] for i in kept_out])
        y = np.array([data[i][0] for i in kept_out])
        grid = np.exp(np.linspace(-3, 3, 61))
        loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(langs, (table[:-1] * idf[:, None] * SCALE).astype(np.float32), table[-1], temperature)


def train(docs: DataFrame, p: Params = Params()) -> Model:
    """Fit on the rows of ``docs`` with a lang."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    size = {r["lang"]: r for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()}
    total = sum(r["n"] for r in size.values())
    df = np.zeros(1 << BITS, np.int64)
    counts = known.select("text").mapInArrow(_frequencies(p.orders), "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # at most 2^16 rows
        df[r[0]] = r[1]
    idf = np.log((1 + total) / (1 + df)) + 1
    quota = max(p.least, -(-p.sample // max(1, len(size))))
    share = {x: min(1.0, quota / r["n"]) for x, r in size.items()}
    over = sum(share[x] * r["b"] for x, r in size.items()) / p.sample_bytes
    share = {x: v / max(1.0, over) for x, v in share.items()}
    space = 1 << 30
    limits = docs.sparkSession.createDataFrame([(x, int(space * v)) for x, v in share.items()], "lang string, below int")
    drawn = (known.join(F.broadcast(limits), "lang")  # one row a language
             .where(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < F.col("below")).select("lang", "text"))
    rows = drawn.mapInArrow(_counted(p.orders), "lang string, f array<int>, n array<int>").toArrow()
    lang, f, n = (rows.column(i).combine_chunks() for i in range(3))
    off = f.offsets.to_numpy()
    fv, nv = f.values.to_numpy(), n.values.to_numpy()
    examples = [(x, fv[a:b].astype(np.int64), nv[a:b].astype(np.float64)) for x, a, b in zip(lang.to_pylist(), off, off[1:])]
    examples.sort(key=lambda e: (e[0], len(e[1]), e[1].tobytes(), e[2].tobytes()))  # the same model however rows arrive
    model = fit(examples, idf, p)
    if model.langs:  # languages drawn more often than they occur lose what the drawing gave them
        shift = -np.log(np.maximum([share[x] for x in model.langs], 1e-300))
        model.bias = model.bias + model.temperature * (shift - shift.max())
    return model


def _predict(model, orders):
    def run(batches):
        m = model.value
        for b in K.slices(batches, 1 << 20):
            c, ok, zero = letters(b.column("text").to_pylist())
            rows = b.num_rows
            logits, size = np.zeros((rows, len(m.langs))), np.zeros(rows)
            if m.langs:
                for f, off in _features(c, zero, orders):
                    size += np.diff(off)
                    full = np.flatnonzero(np.diff(off))
                    if len(full):
                        logits[full] += np.add.reduceat(m.table[f], off[full], axis=0, dtype=np.float64)
            has = np.add.reduceat(ok.astype(np.int64), zero[:-1]) > 0 if rows else np.zeros(0, bool)
            named = has & (size > 0) & bool(m.langs)
            p = softmax((logits / np.maximum(size, 1)[:, None] + m.bias) / m.temperature) if m.langs else np.zeros((rows, 1))
            best = p.argmax(axis=1) if rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"),
                 pa.array([m.langs[i] if u else "und" for i, u in zip(best.tolist(), named.tolist())], pa.string()),
                 pa.array(np.where(named, p.max(axis=1) if rows else 0.0, 0.0), pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model, held_out=None, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), p.orders),
                           "doc_id long, held_out boolean, lang_pred string, score double")


def op3_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_mod(F.col("doc_id"), 3) == 1
    return predict(docs, train(docs.where(~held)), held)
