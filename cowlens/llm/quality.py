"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), linear in the number of features.
Words (A-Z in lower case) are hashed into 2**BITS cells, weighed by log counts of unit length; structure statistics
(shares of bytes and words of a kind, repetition) and metadata (lengths) are real features with factors of their own,
so pairs of words, of statistics, and of both interact.

Training is in numpy on the driver: Adam over a bounded sample of labelled documents (`sample` of least hash of each
label). Labels, language, source and doc_id are never inputs.

Defined results: null and empty texts are scored as texts without words. Rows whose label is null don't train. Without
any label the score is 0.5. Repeated rows get equal scores. Extra columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import least_hashes, release, ship, text_pieces
from .textops import Words

BITS, RANK = 14, 8
STATS = ("upper", "digits", "symbols", "marks", "bangs", "spaces", "lines", "high", "distinct", "pairs", "follow", "word_length", "log_words", "log_bytes")


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[[ord(c) for c in chars]] = 1
    return out


_KINDS = [_lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _lut("0123456789"), _lut("#*$%&|<>"), _lut(".,;:?\"'()-"), _lut("!"), _lut(" \t"), _lut("\n"), (np.arange(256) > 127).astype(np.float64)]


def features(column):
    """For runs of texts: (first row, cell of each distinct word, its weight, begins, statistics)."""
    for i, j, buf, offs in text_pieces(column):
        n, words, plain = j - i, Words(buf, offs, lower=True), Words(buf, offs)
        size = np.diff(offs)
        owner = words.text_of()
        key = (owner << BITS) | (words.hash >> np.uint64(64 - BITS)).astype(np.int64)
        key, count = np.unique(key, return_counts=True)
        begin = np.searchsorted(key >> BITS, np.arange(n + 1))
        weight = np.log1p(count)
        length = np.sqrt(_sums(weight * weight, begin))
        weight = weight / np.repeat(np.maximum(length, 1e-9), np.diff(begin))
        stats = np.zeros((n, len(STATS)))
        for k, lut in enumerate(_KINDS):
            stats[:, k] = _sums(lut[buf], offs) / np.maximum(size, 1)
        many = np.maximum(words.count, 1)
        whole = np.unique((owner.astype(np.uint64) << np.uint64(44)) | (plain.hash >> np.uint64(20)))
        stats[:, 8] = np.bincount((whole >> np.uint64(44)).astype(np.int64), minlength=n)[:n] / np.sqrt(many)
        same = np.r_[False, (words.hash[1:] == words.hash[:-1]) & (owner[1:] == owner[:-1])] if len(owner) else np.zeros(0, bool)
        stats[:, 9] = np.bincount(owner[same], minlength=n)[:n] / many
        tail = buf[words.ends - 1] if len(owner) else np.zeros(0, np.uint8)
        stats[:, 10] = np.bincount(owner[_lut("#*$%&|<>!")[tail] > 0], minlength=n)[:n] / many
        stats[:, 11] = size / many / 10
        stats[:, 12], stats[:, 13] = np.log1p(words.count) / 10, np.log1p(size) / 10
        yield i, key & ((1 << BITS) - 1), weight, begin, stats


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(x)]
    return total[begin[1:]] - total[begin[:-1]]


class FactorisationMachine:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.b, self.seed = 0.0, seed
        self.w, self.v = np.zeros(1 << BITS), r.normal(0, 0.05, (1 << BITS, RANK))
        self.ws, self.vs = np.zeros(len(STATS)), r.normal(0, 0.05, (len(STATS), RANK))
        self.mean, self.scale = np.zeros(len(STATS)), np.ones(len(STATS))

    def raw(self, cell, weight, begin, stats):
        """Scores before the sigmoid, and the sums that gradients need."""
        s = (stats - self.mean) / self.scale
        s = np.clip(s, -8, 8)
        vx = self.v[cell] * weight[:, None]
        full = np.flatnonzero(np.diff(begin))
        first = begin[:-1][full]
        sums, squares, linear = s @ self.vs, (s * s) @ (self.vs * self.vs), s @ self.ws + self.b
        if len(full):
            sums[full] += np.add.reduceat(vx, first)
            squares[full] += np.add.reduceat(vx * vx, first)
            linear[full] += np.add.reduceat(self.w[cell] * weight, first)
        return linear + 0.5 * (sums * sums - squares).sum(1), sums, s

    def score(self, *x) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*x)[0], -50, 50)))

    def train(self, docs: list[tuple], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, decay: float = 1e-4) -> None:
        """docs: (cells, weights, statistics) of each document. Adam; the rate falls to zero."""
        stats = np.stack([d[2] for d in docs])
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
        p = {"w": self.w, "v": self.v, "ws": self.ws, "vs": self.vs, "b": np.zeros(1)}
        m, q = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        r, step, steps = np.random.default_rng(self.seed), 0, epochs * -(-len(docs) // batch)
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for at in range(0, len(order), batch):
                part = [docs[i] for i in order[at : at + batch]]
                y = labels[order[at : at + batch]]
                begin = np.cumsum([0, *(len(d[0]) for d in part)])
                cell, weight, st = np.concatenate([d[0] for d in part]), np.concatenate([d[1] for d in part]), np.stack([d[2] for d in part])
                raw, sums, s = self.raw(cell, weight, begin, st)
                d = (1 / (1 + np.exp(-np.clip(raw, -50, 50))) - y) / len(part)
                owner = np.repeat(np.arange(len(part)), np.diff(begin))
                dw = d[owner] * weight
                cells, back = np.unique(cell, return_inverse=True)
                gw, gv = np.bincount(back, dw, len(cells)), np.zeros((len(cells), RANK))
                np.add.at(gv, back, dw[:, None] * (sums[owner] - self.v[cell] * weight[:, None]))
                gs = d[:, None] * s
                g = {"ws": gs.sum(0), "vs": gs.T @ sums - self.vs * (gs * s).sum(0)[:, None], "b": np.array([d.sum()])}
                step += 1
                lr = rate * (1 - step / (steps + 1))
                for k, x, rows in (("w", gw, cells), ("v", gv, cells), *((k, g[k], slice(None)) for k in g)):
                    x = x + decay * p[k][rows]
                    m[k][rows] = 0.9 * m[k][rows] + 0.1 * x
                    q[k][rows] = 0.99 * q[k][rows] + 0.01 * x * x
                    p[k][rows] -= lr * m[k][rows] / (np.sqrt(q[k][rows]) + 1e-8)
                self.b = float(p["b"][0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, seed: int = 11) -> FactorisationMachine:
    """A model of docs (doc_id, text) and labels (doc_id, label): `sample` labelled ids of least hash, for 0 and for 1.

    Texts become features where they are, one text for each id; the driver gets at most 2**BITS cells of each.
    """
    ship(docs.sparkSession)
    model, wanted = FactorisationMachine(seed), {}
    rows = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    for label in (0, 1):
        own = rows.where(F.col("label") == label).select("doc_id").distinct()
        wanted |= dict.fromkeys(least_hashes(own, sample, seed), label)
    if not wanted:
        return model

    def describe(batches):
        release()
        for b in batches:
            for i, cell, weight, begin, stats in features(b.column("text")):
                n = len(stats)
                cut = lambda x, kind: pa.array([x[begin[k] : begin[k + 1]].astype(kind).tobytes() for k in range(n)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, n), cut(cell, "<u2"), cut(weight, "<f4"), pa.array([x.tobytes() for x in stats], pa.binary())], names=["doc_id", "cells", "weights", "stats"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    some = docs.where(F.col("doc_id").isin(list(wanted))).select("doc_id", F.col("text").cast("string").alias("text"))
    found = some.mapInArrow(describe, f"doc_id {id_type}, cells binary, weights binary, stats binary")
    got = sorted(found.groupBy("doc_id").agg(F.min(F.struct("cells", "weights", "stats")).alias("x")).collect())
    if not got:
        return model
    read = lambda x, kind: np.frombuffer(x, kind).astype(np.int64 if kind == "<u2" else np.float64)
    examples = [(read(r["x"]["cells"], "<u2"), read(r["x"]["weights"], "<f4"), read(r["x"]["stats"], "<f8")) for r in got]
    model.train(examples, np.array([wanted[r["doc_id"]] for r in got], np.float64))
    return model


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """All columns of docs but text, and score and predicted (1 if score >= threshold)."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release()
        for b in batches:
            parts = [sent.value.score(*x) for _, *x in features(b.column("text"))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, "text").mapInArrow(run, schema)
