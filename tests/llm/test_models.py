"""Language ID, quality classifier, URL filter and vector dedup: gradients, held-out accuracy, brute force, edge cases."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cowlens.llm import langid, quality, urls, vectors
from cowlens.llm.entries import URL_RULES


def test_bigru_gradients_agree_with_differences():
    m = langid.BiGRU(["a", "b", "c"], embed=4, hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    y, w = np.array([0, 2, 1]), np.array([1.0, 2.0, 0.5])
    r = np.random.default_rng(0)
    for segments in ([b" abc", b" d", b" efghij"], [b"abab", b"babc", b"cccc"]):
        raw, size = langid.padded(segments)

        def loss():
            return m.gradients(raw, size, y, w)[0]

        _, g = m.gradients(raw, size, y, w)
        for k, p in m.p.items():
            for _ in range(8):
                at = tuple(r.integers(0, n) for n in p.shape) if k != "E" else (int(raw[r.integers(0, 4), 2]), int(r.integers(0, p.shape[1])))
                old = p[at]
                p[at] = old + 1e-5
                up = loss()
                p[at] = old - 1e-5
                down = loss()
                p[at] = old
                assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6 + 1e-4 * abs(g[k][at]), k


def plain_means(m, text):
    """Mean over all bytes, one byte after the other."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    p, k, raw = {n: v.astype(np.float64) for n, v in m.p.items()}, m.hidden, text.encode()
    parts = []
    for d in (0, 1):
        h, out = np.zeros(k), []
        for b in raw[:: 1 - 2 * d]:
            x = p["W"][d] @ p["E"][b] + p["c"][d, :, 0]
            zr = sig(x[: 2 * k] + p["U"][d, : 2 * k] @ h)
            n = np.tanh(x[2 * k :] + p["U"][d, 2 * k :] @ (zr[k:] * h))
            h = h + zr[:k] * (n - h)
            out.append(p["O"][d] @ h)
        parts.append(out[:: 1 - 2 * d])
    e = np.exp(np.array(parts[0]) + np.array(parts[1]) + p["o"][:, 0])
    return (e / e.sum(1, keepdims=True)).mean(0)


def test_language_means_are_those_of_the_whole_text():
    m = langid.BiGRU(["a", "b", "c"])
    texts = [d[1] for d in corpus(2, 12)] + ["x", "é" * 300, "x" * 100, corpus(3, 1)[0][1] * 20]
    langs, scores = langid.label(m, pa.array([*texts, None, "", "12", *texts]))
    for i, t in enumerate(texts):
        mean = plain_means(m, t)
        assert abs(scores[i] - mean.max()) < 2e-3 and (mean.max() - np.sort(mean)[-2] < 4e-3 or langs[i] == m.langs[int(mean.argmax())])
    n = len(texts)
    assert langs[n : n + 3] == ["und"] * 3 and not scores[n : n + 3].any() and langs[n + 3 :] == langs[:n] and np.allclose(scores[n + 3 :], scores[:n], atol=1e-5)


def test_training_sample_is_by_document_and_language(spark):
    """A row that repeats, and a rare language, in a small sample of a large table."""
    rows = [(0, "the same text again", "en")] * 5000 + [(i, f"text number {i} in the table", "en") for i in range(1, 300)] + [(1000 + i, f"texte {i}", "fr") for i in range(3)]
    rows += [(5, "another text of that id", "en"), (None, "no id", "fr"), (7000, None, "en"), (7001, "x", None), (7002, "", "en")]
    got = langid.training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100, 2, 5)
    texts = [x[1] for x in got if x[0] == "en"]
    assert 95 <= len(set(texts)) <= 100 and len(set(texts)) == len(texts) and {x[1] for x in got if x[0] == "fr"} == {"texte 0", "texte 1", "texte 2", "no id"}


def corpus(seed, n):
    r = random.Random(seed)
    syll = {"en": ["the", "ing", "ou", "th"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "oi", "que", "é"]}
    out = []
    for i in range(n):
        lang = r.choice(list(syll))
        out.append((i, " ".join("".join(r.choice(syll[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 60))), lang, "s", 7))
    return out


def test_language_id(spark):
    data = corpus(1, 150)
    extra = [(1000, None, "en", None, 1), (1001, "", None, None, 1), (1002, "12 !! ½", None, None, 1), (1003, "the " * 4000, None, None, None), (None, "que eau", "fr", "s", 1), (0, *data[0][1:])]
    docs = spark.createDataFrame(data + extra, "doc_id long, text string, lang string, source string, score long")
    held = langid.held_out(3, 1)
    model = langid.fit(docs.where(~held), sample=60, steps=120)
    out = langid.identify(docs, model).select("*", held.alias("h")).collect()
    assert len(out) == len(data) + len(extra) and all(0 <= r.score <= 1 for r in out)
    truth = {d[0]: d[2] for d in data}
    test = [r for r in out if r.h and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) >= 0.95 * len(test) > 10
    by = {r.doc_id: r for r in out}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1000, 1001, 1002)) and by[1003].lang_pred == "en"
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0)).langs == ["und"]


def test_factorisation_identity():
    m = quality.FactorisationMachine(3)
    m.w = np.random.default_rng(1).normal(size=m.w.shape)
    x = next(iter(quality.features(pa.array(["one two two three!!", None, "A B"]))))[1:]
    cell, weight, begin, stats = x
    got = m.raw(*x)[0]
    for k in range(3):
        v = np.concatenate([m.v[cell[begin[k] : begin[k + 1]]] * weight[begin[k] : begin[k + 1], None], m.vs * np.clip(stats[k], -8, 8)[:, None]])
        pairs = sum(v[i] @ v[j] for i in range(len(v)) for j in range(i))
        linear = (m.w[cell[begin[k] : begin[k + 1]]] * weight[begin[k] : begin[k + 1]]).sum() + np.clip(stats[k], -8, 8) @ m.ws
        assert math.isclose(got[k], linear + pairs, rel_tol=1e-9)


def test_quality(spark):
    r = random.Random(5)
    good = lambda: " ".join(r.choice(["plain", "words", "here", "and", "there", "now"]) + r.choice(["", "s", "ly"]) for _ in range(80))
    junk = [lambda: good().upper().replace(" ", "!! "), lambda: "buy " * 90, lambda: good().replace(" ", "%%% ")]
    data = [(i, (r.choice(junk) if i % 4 == 0 else good)(), int(i % 4 != 0)) for i in range(300)]
    docs = spark.createDataFrame([*((i, t) for i, t, _ in data), (900, None), (901, ""), (None, "x"), (902, "y" * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, q) for i, _, q in data), (903, None), (None, 1)], "doc_id long, label int")
    model = quality.fit(docs, labels.where(~langid.held_out(5, 0)))
    out = {x.doc_id: x for x in quality.score(docs, model).select("*", langid.held_out(5, 0).alias("h")).collect()}
    test = [i for i, _, _ in data if out[i].h]
    assert sum(out[i].predicted == dict((a, c) for a, _, c in data)[i] for i in test) >= 0.95 * len(test) > 10
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in out.values()) and len(out) == 304
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).where(F.col("score").isNull()).count() == 0


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("https://Www.Example.COM/en/1?x=/#y", "www.example.com", "/en/1", "www.example.com/en/"),
        ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/"),
        ("http://m.example.com/EN/", "m.example.com", "/EN/", "com/"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/"),
        ("x://a.net/es/2", "a.net", "/es/2", "net/es/"),
        ("x://net/fr/", "net", "/fr/", "net/fr/"),
        ("http://a.com", "a.com", "", None),
        ("http://a.com?b/c", "a.com", "", None),
        ("a://b://c/d", "b:", "//c/d", None),
        ("http:///p", "", "/p", None),
        ("nothing", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
    ],
)
def test_url_rules(url, host, path, rule):
    assert urls.split_url(url) == (host, path)
    assert urls.Rules(URL_RULES).find(host, path)[0] == rule


def test_segmenter_is_the_best_split():
    s = urls.Segmenter({"the": 50, "th": 20, "rou": 5, "er": 30, "herou": 1, "e": 2})

    def cost(parts):
        return sum(s.logp.get(p, s.unknown if len(p) == 1 else -1e9) for p in parts)

    def every(x):
        return [[]] if not x else [[x[:k], *rest] for k in range(1, len(x) + 1) for rest in every(x[k:])]

    for name in ("therou", "ether", "zzthe", "x", ""):
        assert math.isclose(cost(s.split(name)), max(map(cost, every(name))))
    assert s.split("therother") == ["the", "r", "o", "the", "r"] or len(s.split("therother")) > 1


def test_url_filter(spark):
    rows = [(i, f"http://{h}/{p}", "<p>good news bad spam site</p>", None) for i, (h, p) in enumerate([("goodsite.com", "a/1"), ("newssite.com", "b/2")] * 20 + [("spam.net", "es/1"), ("badspam.net", "fr/2")] * 20 + [("spambad.org", "x"), ("goodnews.org", "y")])]
    pages = spark.createDataFrame([*rows, (None, None, None, 1), (77, "", None, 2)], "page_id long, url string, html string, host int").drop("host").withColumn("verdict", F.lit(3))
    out = urls.filter_urls(pages, URL_RULES).collect()
    by = {r.page_id: r for r in out}
    assert len(out) == len(rows) + 2 and by[80].verdict == "block" and by[81].verdict == "allow" and by[80].rule is None
    assert by[80].host_words == ["spam", "bad", "org"] or by[80].host_words[:2] == ["spam", "bad"]
    assert by[None].verdict == "allow" and by[77].host == ""
    assert urls.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(2)
    rows, n = [], 0
    for label in (1, 2, None):
        centre = r.normal(size=32)
        for k in range(90):
            v = centre + r.normal(size=32) * (0.1 if k < 60 else 3)
            rows.append((n, v.tolist(), label))
            n += 1
    rows += [(n, rows[0][1], 1), (n + 1, rows[0][1], 1), (n + 2, rows[0][1], 2), (n + 3, None, 1), (n + 4, [], 1), (n + 5, [0.0] * 32, 1), (n + 6, [float("nan")] * 32, 1), (n + 7, [1.0, None], 1), (n + 8, [1e300] * 32, 1), (n + 9, [2e-300] * 32, 1), (n + 10, [1.0, 2.0], 1), (n + 11, [2.0, 4.0], 1)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.98, window=16).collect()}

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v) / np.abs(v).max()
        return x / np.sqrt(x @ x)

    units, parent, links = [unit(v) for _, v, _ in rows], list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    assert got == {i: (links[i], parent[i], parent[i] == i) for i in range(len(rows))}
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_with_a_common_mean_and_groups_lose_no_pairs(spark):
    """A hot label whose vectors share a mean, and a large group of mutual cosine 0.9 in another: planted pairs at the threshold are found."""
    r = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rows, pairs, at = [], [], 0
    for label, n, cosine in ((1, 6000, 0.9), (2, 2500, 0.9), (2, 3500, 0.0)):
        mean = unit(r.normal(size=64))
        x = unit(np.sqrt(cosine) * mean + np.sqrt(1 - cosine) * unit(r.normal(size=(n, 64))))
        side = r.normal(size=(n // 20, 64))
        base = x[: n // 20]
        side = unit(side - (side * base).sum(1, keepdims=True) * base)
        y = 0.981 * base + np.sqrt(1 - 0.981**2) * side
        rows += [(at + i, v.tolist(), label) for i, v in enumerate([*x, *y])]
        pairs += [(at + i, at + n + i) for i in range(n // 20)]
        at += n + n // 20
    got = {v.vec_id: v.component_id for v in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.98, window=4).collect()}
    assert sum(got[a] != got[b] for a, b in pairs) <= 2
