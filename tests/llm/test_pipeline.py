"""Each stage of the pipeline on what its predecessor kept, against plain Python; then run() as a whole."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from cowlens.llm.entries import tokenizer_path

from .test_text_operators import expected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEEDS = {"en": "the ing of and tion ou", "de": "der sch ung ein und ich", "fr": "le eau oi que et ment"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    r = random.Random(8)
    text = lambda lang, n: " ".join("".join(r.choice(SEEDS[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(n))
    passage = text("en", 70)
    rows = []
    for i in range(90):
        lang = r.choice(list(SEEDS))
        rows.append((i, text(lang, r.randint(20, 120)), lang, r.choice(["s1", "s2", None])))
    rows += [(100 + i, rows[i][1], rows[i][2], "s3") for i in range(10)]
    rows += [(120 + i, rows[20 + i][1] + " the end", rows[20 + i][2], "s1") for i in range(10)]
    rows += [(140 + i, text("en", 90) + "\n" + passage + " the", "en", "s2") for i in range(5)]
    rows += [(160, None, None, "s1"), (161, "", "en", None), (162, "1 2 3", "en", "s1"), (163, passage, "en", "s1"), (164, passage + " " + passage, "en", "s1"), rows[0]]
    path = tmp_path_factory.mktemp("sf")
    data = [(*x, None if x[1] is None else len(x[1])) for x in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def collected(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=str)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    before = collected(docs)
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs
        assert k == len(cp.STAGES) - 1 or docs.columns == names
    first = collected(kept["language ID"])
    assert Counter(before) - Counter(first) == Counter(x for x in before if not any(map(str.isalpha, x[1] or "")))

    second = collected(kept["n-gram Jaccard join"])
    want = expected_components(first)
    ids = Counter(doc for doc, _, component in want.elements() if doc == component)
    assert Counter(x[0] for x in second) == Counter(dict.fromkeys(ids, 1)) and set(second) <= set(first)

    third = collected(kept["substring dedup"])
    split = {x: WORD.findall(x[1]) for x in second}
    seen = Counter(tuple(w[k : k + 35]) for w in split.values() for k in range(len(w) - 34))
    cut = []
    for x, w in split.items():
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        if len(gone) < len(w):
            cut.append((x[0], " ".join(y for j, y in enumerate(w) if j not in gone) if gone else x[1], *x[2:]))
    assert third == sorted(cut, key=str)
    was = {x[0]: len(x[1]) for x in second}
    assert any(len(x[1]) < was[x[0]] for x in third) and len(third) < len(second), (len(second), len(third), [(x[0], was[x[0]], len(x[1])) for x in third if x[0] >= 100])

    fourth = collected(kept["mixing sources to target weights"])
    assert set(fourth) <= set(third) and max(Counter(fourth).values()) <= 2
    sizes = lambda xs: sum(len(WORD.findall(x[1])) for x in xs)
    assert abs(sizes(fourth) / sizes(third) - 1.5) < 0.1

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    pieces = Counter()
    for x in fourth:
        ids = [*tok.encode(x[1], add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            raw = np.array(ids[s : s + 2048], "<u4").tobytes()
            pieces[x[0], s, len(raw) // 4, zlib.crc32(raw)] += 1
    out = kept["packing"].collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in out) == pieces
    by = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 2048


def test_run_is_its_stages(spark, folder):
    a = Counter(tuple(r) for r in cp.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())
    b = Counter(tuple(r) for r in cp.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())
    assert a == b and sum(a.values()) > 50


def test_freed_arrays_leave_the_process():
    """Arrays below one that lives on, after a larger one was freed: a worker that waits keeps none of them."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import cowlens.llm.shared, numpy as np, re
held = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
large = np.ones(30 << 20, "u1"); del large
before = held()
parts = [np.ones(3 << 20, "u1") for _ in range(50)]
keep = parts[-1]; del parts
print(held() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 30
