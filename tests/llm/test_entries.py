"""The registered queries on small whole tables: against their SQL in DuckDB, or against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict
from datetime import date
from decimal import Decimal

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cowlens.llm import entries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(tmp_path_factory, rows):
    r, path = np.random.default_rng(6), tmp_path_factory.mktemp("entries")
    line = "common line of words that many documents hold"
    docs = [x[:5] for x in rows] + [(500 + i, f"{line}\n" + " ".join(f"v{i}x{k}" for k in range(5)), "en", "hot", 1) for i in range(25)]
    docs += [(600, f"{line}\n" * 30, "en", "hot", 1), (601, " ".join(["a b c"] * 4000), "en", "b", 1), (602, " ".join(f"w{k % 700}" for k in range(9000)), None, "a", 1)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.table({n: pa.array([d[k] for d in docs], pa.int64() if n in ("doc_id", "n_chars") else pa.string()) for k, n in enumerate(names)}), f"{path}/documents.parquet")
    x = r.normal(size=(40, 8)).astype(np.float32)
    vectors = [*x.tolist(), *(x[:20] * np.float32(2)).tolist(), *(x[:10] + np.float32(0.05)).tolist(), None, [], [0.0] * 8, [float("nan")] * 8, [None, 1.0]]
    pq.write_table(pa.table({"vec_id": pa.array([*range(len(vectors) - 1), None], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([k % 2 if k % 11 else None for k in range(len(vectors))], pa.int32())}), f"{path}/embeddings.parquet")
    ids = [d[0] for d in docs if d[0] is not None]
    pq.write_table(pa.table({"doc_id": pa.array([*ids, None], pa.int64()), "quality": pa.array([*(i % 2 for i in ids), 1], pa.int32()), "toxic": pa.array([0] * (len(ids) + 1), pa.int32())}), f"{path}/labels.parquet")
    hosts = ["goodnews.com", "bad.net", "Badnews.org", "newsgood.org", "badbad.net", "m.example.com", "www.example.com", "x.org", "good.example.com"]
    paths = ["", "/", "/en/1", "/es/bad", "/fr/2", "/news?x=/en/", "/EN/good", "/a#b"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "http://", "://com/es/"]
    pq.write_table(pa.table({"page_id": pa.array([*range(len(urls) - 1), None], pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array([[None, "<p>good news good bad</p>", "bad <b>news</b> goodnews"][k % 3] for k in range(len(urls))], pa.string())}), f"{path}/pages.parquet")
    return str(path)


def plain(x):
    return round(float(x), 9) if isinstance(x, float | Decimal) else x.isoformat() if isinstance(x, date) else x


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_against_sql(spark, folder, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.sql(entries.ORACLES[name])
    got = entries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    rows = Counter(tuple(map(plain, x)) for x in got.select(*want.columns).collect())
    assert rows == Counter(tuple(map(plain, x)) for x in want.fetchall())


def read(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def held(doc_id, modulus, remainder):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus == remainder


def test_models_return_their_columns(spark, folder):
    docs = read(folder, "documents")
    got = entries.op1_language_id(spark, folder).collect()
    assert Counter((x.doc_id, x.held_out) for x in got) == Counter((d["doc_id"], held(d["doc_id"], 3, 1)) for d in docs)
    letters = Counter(d["doc_id"] for d in docs if any(map(str.isalpha, d["text"] or "")))
    assert all(0 <= x.score <= 1 for x in got) and Counter(x.doc_id for x in got if x.lang_pred in ("en", "de")) == letters
    assert all(x.lang_pred == "und" and x.score == 0 for x in got if x.lang_pred not in ("en", "de"))
    got = entries.op6_quality_classifier(spark, folder).collect()
    assert Counter((x.doc_id, x.held_out) for x in got) == Counter((d["doc_id"], held(d["doc_id"], 5, 0)) for d in docs)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)


def test_tokens_and_packing(spark, folder):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(entries.tokenizer_path())
    docs = [(d["doc_id"], d["text"] or "") for d in read(folder, "documents")]
    ids = {t: [*tok.encode(t, add_special_tokens=False).ids, 1] for _, t in docs}
    got = Counter((x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in entries.op10_token_counts(spark, folder).collect())
    assert got == Counter((d, len(t.encode()), len(ids[t]) - 1, len(ids[t]) > 1025) for d, t in docs)
    out = entries.op5_packing(spark, folder).collect()
    want = Counter()
    for d, t in docs:
        for s in range(0, len(ids[t]), 2048):
            raw = np.array(ids[t][s : s + 2048], "<u4").tobytes()
            want[d, s, len(raw) // 4, zlib.crc32(raw), len(ids[t])] += 1
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in out) == want
    bins = defaultdict(list)
    for x in out:
        bins[x.sequence_id].append((x.offset, x.length))
    for b in bins.values():
        ends = [0, *(o + n for o, n in sorted(b))]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 2048
    assert len(bins) <= 2 + sum(n for b in bins.values() for _, n in b) // 1900


def test_url_filter_against_plain_bayes(spark, folder):
    pages = read(folder, "pages")
    words = Counter(w for p in pages for w in re.findall("[a-z]+", re.sub("<[^>]*>", " ", p["html"] or "")))
    total = sum(words.values())

    def splits(x):
        return [[]] if not x else [[x[:k], *rest] for k in range(1, len(x) + 1) for rest in splits(x[k:])]

    known = {}

    def segment(x):
        if x not in known:
            cost = lambda parts: sum(math.log(words[p] / total) if p in words else -math.log(10 * total) if len(p) == 1 else -math.inf for p in parts)
            known[x] = max(splits(x), key=cost)
        return known[x]

    def parse(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    def rule(host, path):
        fit = [(len(r), r, v) for v, r in entries.URL_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return max(fit)[1:] if fit else (None, None)

    counts = {v: Counter() for v in ("block", "allow")}
    seen = []
    for p in pages:
        host, path = parse(p["url"])
        r, v = rule(host, path)
        toks = [f"{k}:{w}" for k, x in (("h", host), ("p", path.lower())) for n in re.findall("[a-z]+", x) for w in segment(n)]
        seen.append((p["page_id"], host, path, r, v, toks))
        if v:
            counts[v].update(toks)
    size = {v: sum(c.values()) + (1 << 16) for v, c in counts.items()}
    odds = lambda t: math.log((counts["block"][t] + 1) / size["block"]) - math.log((counts["allow"][t] + 1) / size["allow"])
    want = {}
    for page, host, path, r, v, toks in seen:
        score = sum(map(odds, toks))
        assert v or abs(score) > 1e-9 or not toks
        want[page] = (host, path, r, v or ("block" if score > 0 else "allow"), round(score, 6))
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict, round(x.block_log_odds, 6)) for x in entries.op4_url_filter(spark, folder).collect()}
    assert got == want and {v for _, _, r, v, _ in want.values() if r is None} == {"allow", "block"}


def test_mixing_takes_its_targets(spark, folder):
    docs = read(folder, "documents")
    got = entries.op9_mixing(spark, folder).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((x.doc_id, x.size) for x in got) == Counter((d["doc_id"], size(d["text"])) for d in docs)
    by = Counter()
    for d in docs:
        by[d["source"]] += size(d["text"])
    assert {x.source_size for x in got} == {*by.values()} and all(0 <= x.taken <= 2 * x.size for x in got)
    assert abs(sum(t for _, t in {(x.source_size, x.target) for x in got}) / sum(by.values()) - 1.5) < 1e-9
    taken = Counter()
    for x in got:
        taken[x.source_size, x.target] += x.taken
    longest = max(size(d["text"]) for d in docs)
    assert all(abs(n - target) <= longest / 2 + 1 for (_, target), n in taken.items())
