"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads running text in both directions, gives every byte a distribution over languages, and a document's
distribution is the mean over all its bytes. Texts are read whole, in segments of CORE bytes with CONTEXT more bytes of
the text on either side: these warm up the states and are not pooled, so no label depends on where a segment is cut,
within a character or not, beyond CONTEXT bytes.

Training is in numpy on the driver, by backpropagation through time over windows of a bounded sample of labelled
documents: `sample` of least hash for each language, `windows` places of WINDOW characters in each, one text for each
doc_id, however often it occurs. The model has a few thousand weights, whatever the corpus.

Defined results: null texts and texts without a letter are `und`, with score 0. Repeated rows get equal results, ties
go to the language first in code point order. Extra columns are carried along; lang_pred and score are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import release, ship, text_pieces
from .textops import ranges

CORE, CONTEXT, WINDOW = 448, 32, 72
#: Segments that are read together, so that a step's arrays stay in the processor's cache.
TOGETHER = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class BiGRU:
    """Two gated recurrent layers over bytes, one for each direction, and a softmax on both states.

    Weights are stacked by direction: E (257, e), W (2, 3h, e), U (2, 3h, h), c (2, 3h, 1), O (2, l, h), o (l, 1). Gates lie
    in the order update, reset, new state; segments lie along the last axis of all arrays.
    """

    def __init__(self, langs: list[str], embed: int = 8, hidden: int = 8, seed: int = 5):
        r = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[-1]), s).astype(np.float32)
        self.p = {
            "E": r.normal(0, 0.5, (257, embed)).astype(np.float32), "W": draw(2, 3 * hidden, embed), "U": draw(2, 3 * hidden, hidden),
            "c": np.zeros((2, 3 * hidden, 1), np.float32), "O": draw(2, len(langs), hidden), "o": np.zeros((len(langs), 1), np.float32),
        }

    def _read(self, seg: np.ndarray, saved: list | None = None) -> np.ndarray:
        """Both directions' parts of the scores (time, direction, language, segment), each direction in its own order.

        seg: (time, direction, segment) bytes. What follows a segment's end is padding: it comes after all its positions in
        both directions and changes none. saved: gets (state before, gates, new state, state) of each step.
        """
        k, u = self.hidden, self.p["U"]
        inputs = np.ascontiguousarray((self.p["W"] @ self.p["E"].T + self.p["c"]).transpose(0, 2, 1))  # gate sums of each byte
        gates, new_u = np.ascontiguousarray(u[:, : 2 * k]), np.ascontiguousarray(u[:, 2 * k :])
        many = seg.shape[2]
        h, out = np.zeros((2, k, many), inputs.dtype), np.empty((len(seg), 2, len(self.langs), many), inputs.dtype)
        row, x = np.empty((many, 3 * k), inputs.dtype), np.empty((2, 3 * k, many), inputs.dtype)
        for t in range(len(seg)):
            for d in (0, 1):
                np.take(inputs[d], seg[t, d], axis=0, out=row, mode="clip")
                x[d] = row.T
            zr = gates @ h
            zr += x[:, : 2 * k]
            _sigmoid(zr)
            z, r = zr[:, :k], zr[:, k:]
            n = new_u @ (r * h)
            n += x[:, 2 * k :]
            n *= 2  # tanh(n) = 2 / (1 + exp(-2 n)) - 1
            _sigmoid(n)
            n *= 2
            n -= 1
            new = n - h
            new *= z
            new += h
            if saved is not None:
                saved.append((h, z, r, n, new))
            h = new
            np.matmul(self.p["O"], h, out=out[t])
        return out

    def positions(self, raw: np.ndarray, size: np.ndarray, saved: list | None = None):
        """Distributions (time, language, segment) at all positions. raw: (time, segment) bytes, of size[k] in segment k."""
        seg, back = both_ways(raw, size)
        with np.errstate(over="ignore"):  # 1 / (1 + exp(large)) is 0, as it should be
            parts = self._read(seg, saved)
        logit = parts[::-1, 1].copy() if back is None else np.take_along_axis(parts[:, 1], back[:, None, :], 0)
        logit += parts[:, 0]
        logit += self.p["o"]
        logit -= logit.max(1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(1, keepdims=True)
        return logit, seg, back

    def gradients(self, raw: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray):
        """Loss and its gradients, by backpropagation through time."""
        saved: list = []
        prob, seg, back = self.positions(raw, size, saved)
        inside = np.arange(len(raw))[:, None] < size[None, :]
        scale = (inside * weight[None, :] / inside.sum())[:, None, :].astype(prob.dtype)
        every = np.arange(len(label))
        loss = float(-(np.log(prob[:, label, every] + 1e-9) * scale[:, 0]).sum())
        d_logit = prob.copy()
        d_logit[:, label, every] -= 1
        d_logit *= scale
        if back is None:
            reverse = d_logit[::-1]
        else:  # of each position at the step at which the second direction reads it
            reverse = np.zeros_like(d_logit)
            np.put_along_axis(reverse, back[:, None, :], d_logit, 0)
        d_out = np.stack([d_logit, reverse], 1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = d_logit.sum((0, 2))[:, None]
        k, u = self.hidden, self.p["U"]
        gates_t, new_t, out_t = u[:, : 2 * k].transpose(0, 2, 1), u[:, 2 * k :].transpose(0, 2, 1), self.p["O"].transpose(0, 2, 1)
        d_h = np.zeros_like(saved[0][0])
        d_xs = np.empty((2, len(seg), seg.shape[2], 3 * k), d_h.dtype)
        for t in reversed(range(len(seg))):
            h, z, r, n, new = saved[t]
            g["O"] += d_out[t] @ new.transpose(0, 2, 1)
            d_new = d_h + out_t @ d_out[t]
            d_z, d_n = d_new * (n - h) * z * (1 - z), d_new * z * (1 - n * n)
            d_rh = new_t @ d_n
            d_zr = np.concatenate([d_z, d_rh * h * r * (1 - r)], 1)
            d_h = d_new * (1 - z) + d_rh * r + gates_t @ d_zr
            g["U"][:, : 2 * k] += d_zr @ h.transpose(0, 2, 1)
            g["U"][:, 2 * k :] += d_n @ (r * h).transpose(0, 2, 1)
            d_xs[:, t, :, : 2 * k], d_xs[:, t, :, 2 * k :] = d_zr.transpose(0, 2, 1), d_n.transpose(0, 2, 1)
        for d in (0, 1):  # by byte: what its occurrences add up to
            read, flat = seg[:, d].ravel(), d_xs[d].reshape(-1, 3 * k)
            by = np.stack([np.bincount(read, flat[:, i], len(g["E"])) for i in range(3 * k)]).astype(d_h.dtype)
            g["W"][d], g["c"][d, :, 0] = by @ self.p["E"], by.sum(1)
            g["E"] += by.T @ self.p["W"][d]
        return loss, g

    def train(self, segments: list[bytes], labels: np.ndarray, steps: int = 300, batch: int = 96, rate: float = 0.02, seed: int = 7) -> float:
        """Adam over random batches in which every language weighs the same. Returns the last losses' mean."""
        r = np.random.default_rng(seed)
        weight = (len(labels) / np.maximum(np.bincount(labels, minlength=len(self.langs)), 1) / len(self.langs)).astype(np.float32)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            at = r.integers(0, len(segments), batch)
            loss, g = self.gradients(*padded([segments[i] for i in at]), labels[at], weight[labels[at]])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in self.p:
                x = g[k] * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return float(np.mean(losses[-50:]))

    def means(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean distribution over all bytes of each text; zeros where there are none. Texts lie end to end in buf."""
        size = np.diff(offs)
        many = -(-size // CORE)
        owner = np.repeat(np.arange(len(size)), many)
        core = offs[:-1][owner] + CORE * ranges(np.zeros(len(size), np.int64), many)
        begin, end = np.maximum(core - CONTEXT, offs[owner]), np.minimum(core + CORE + CONTEXT, offs[owner + 1])
        out = np.zeros((len(size), len(self.langs)))
        order = np.argsort(end - begin, kind="stable")
        steps = np.arange(CORE + 2 * CONTEXT)[:, None]
        at = 0
        while at < len(order):
            part = order[at : at + TOGETHER]
            part = part[end[part] - begin[part] <= 1.3 * (end[part[0]] - begin[part[0]]) + 2]  # little padding
            at += len(part)
            sizes = end[part] - begin[part]
            place = begin[part] + steps[: int(sizes.max())]
            prob = self.positions(buf[np.minimum(place, len(buf) - 1)], sizes)[0]
            pooled = (place >= core[part]) & (place < np.minimum(core[part] + CORE, end[part]))
            prob *= pooled[:, None, :]
            np.add.at(out, owner[part], prob.sum(0).T)
        return out / np.maximum(size, 1)[:, None]


def both_ways(raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Segments in both directions, (time, direction, segment), with 256 for padding at the end; and, for each position, the
    step at which the second direction reads it (None: all are of one size, so counted from the end)."""
    seg = np.empty((len(raw), 2, raw.shape[1]), np.int64)
    seg[:, 0] = raw
    if (size == len(raw)).all():
        seg[:, 1] = raw[::-1]
        return seg, None
    t = np.arange(len(raw))[:, None]
    back = size[None, :] - 1 - t
    inside = back >= 0
    back = np.where(inside, back, t)
    seg[:, 0][~inside] = 256
    seg[:, 1] = np.take_along_axis(seg[:, 0], back, 0)
    return seg, back


def padded(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, segment) bytes, and the segments' sizes."""
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    width = int(size.max(initial=1))
    inside = np.arange(width)[None, :] < size[:, None]
    raw = np.zeros((len(segments), width), np.uint8)
    raw[inside] = np.frombuffer(b"".join(segments), np.uint8)
    return np.ascontiguousarray(raw.T), size


def label(model: BiGRU, column) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of an Arrow string array."""
    langs, scores = [], [np.zeros(0)]
    for i, j, buf, offs in text_pieces(column, 1 << 22):
        mean = model.means(buf, offs)
        lettered = np.array([x is not None and any(map(str.isalpha, x)) for x in column.slice(i, j - i).to_pylist()], bool)
        best = mean.argmax(1)
        langs += [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        scores.append(np.where(lettered, np.clip(mean[np.arange(len(best)), best], 0.0, 1.0), 0.0))
    return langs, np.concatenate(scores)


def training_windows(labelled: DataFrame, sample: int, windows: int, seed: int) -> list[tuple[str, str]]:
    """(lang, window) of `sample` documents of least hash for each language. Counts come first, and rows whose hash is above
    some times the share that is wanted are left out before anything is sorted, so about as many go on as are wanted."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    many = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("doc_id")).collect()}  # one row a language
    if not many:
        return []
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11)
    limit = F.create_map(*(F.lit(x) for k, n in many.items() for x in (k, int(min(1.0, 4 * sample / max(1, n)) * (1 << 53)))))
    near = rows.withColumn("h", h).where(F.col("h") <= limit[F.col("lang")])
    at = lambda k: F.pmod(F.xxhash64(F.lit(seed + 1 + k), "doc_id"), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))) + 1
    cut = F.array_distinct(F.array(*(F.substring("text", at(k).cast("int"), F.lit(WINDOW)) for k in range(windows))))
    one = near.select("lang", "doc_id", "h", cut.alias("cut")).groupBy("lang", "h", "doc_id").agg(F.min("cut").alias("cut"))
    ranked = one.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= sample)
    got = ranked.select("lang", "h", F.explode("cut").alias("window")).collect()  # languages x sample x windows x WINDOW characters at most
    return sorted((r[0], r[2]) for r in got if r[2])


def fit(labelled: DataFrame, sample: int = 500, windows: int = 8, steps: int = 300, seed: int = 5) -> BiGRU:
    """A model of labelled (doc_id, text, lang) rows."""
    got = training_windows(labelled, sample, windows, seed)
    langs = sorted({x[0] for x in got}) or ["und"]
    model = BiGRU(langs, seed=seed)
    if got:
        r = np.random.default_rng(seed)
        shout = r.random(len(got)) < 0.1  # capitals are rare in the sample, but whole texts are written in them
        short = r.random(len(got)) < 0.3  # and so are texts of a word or two
        size = r.integers(4, 25, len(got))
        texts = [(w.upper() if up else w)[: k if few else None] for (_, w), up, few, k in zip(got, shout, short, size.tolist(), strict=True)]
        model.train([x.encode("utf-8", "replace") for x in texts], np.array([langs.index(x[0]) for x in got]), steps=steps)
    return model


def identify(docs: DataFrame, model: BiGRU, with_text: bool = False) -> DataFrame:
    """All columns of docs (text only if asked for), and lang_pred and score, which replace columns of these names."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score") and (with_text or c != "text")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release()
        for b in batches:
            langs, scores = label(sent.value, b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def held_out(modulus: int, remainder: int, name: str = "doc_id") -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus == remainder
