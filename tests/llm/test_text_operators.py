"""Substring dedup, Jaccard join, rules, tokens, packing and mixing against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cowlens.llm import jaccard, mixing, packing, rules, substring, tokens
from cowlens.llm.components import components
from cowlens.llm.shared import text_pieces
from cowlens.llm.textops import Words, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
split = lambda t: WORD.findall(t or "")


@pytest.mark.parametrize("width", [35, 4, 60])
def test_substring(docs, rows, width):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.lang) for r in substring.remove_repeated(docs, width, carry=["lang"]).collect())
    seen = Counter(tuple(w[k : k + width]) for r in rows for w in [split(r[1])] for k in range(len(w) - width + 1))
    want = Counter()
    for r in rows:
        w = split(r[1])
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        want[r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g), r[2]] += 1
    assert got == want


def test_cover_meets_every_pair_of_residues():
    for v, d in substring.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def expected_components(rows, percent=80):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for r in rows:
        w = split((r[1] or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)].append(r[0])
    return Counter((r[0], len(s), min(ids[root(i)]) if s and ids[root(i)] else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))


def test_jaccard(docs, rows):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert got == expected_components(rows)


def test_jaccard_large_group_of_near_copies(spark):
    """Copies that differ by a few words each, more than a tile has centres."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"v{i}" if k in (i % 50, (i * 7) % 50) else w for k, w in enumerate(base))) for i in range(60)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == expected_components(rows)


def test_words_of_regular_patterns_are_told_apart(spark):
    """Thue-Morse words and their complements agree under any polynomial of an odd base modulo a power of two."""
    for size in (2048,):
        x = "".join("ab"[i.bit_count() % 2] for i in range(size))
        y = "".join("ba"[i.bit_count() % 2] for i in range(size))
        same = [f"w{k}" for k in range(34)]
        data = spark.createDataFrame([(1, " ".join([*same, x])), (2, " ".join([*same, y])), (3, x), (4, y), (5, x)], "doc_id long, text string")
        assert {r.doc_id: r.n_removed for r in substring.remove_repeated(data).collect()} == dict.fromkeys(range(1, 6), 0)
        assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(data).collect() if r.doc_id > 2} == {3: 3, 4: 4, 5: 3}


def test_word_hashes_are_those_of_the_bytes():
    r = np.random.default_rng(4)
    texts = [" ".join("".join("abAB\x00é"[c] for c in r.integers(0, 6, n)) for n in r.integers(1, 40, 60)) + " " + "y" * int(r.integers(250, 262)) for _ in range(20)]
    found = [{}, {}]
    for lower in (False, True):
        for i, j, buf, offs in text_pieces(pa.array(texts)):
            w = Words(buf, offs, lower)
            names = [x for t in texts[i:j] for x in split(t.translate({65: 97, 66: 98}) if lower else t)]
            for stream in (0, 1):
                for name, h in zip(names, w.hashes(stream).tolist(), strict=True):
                    assert found[stream].setdefault(name, h) == h
            at = w.window_starts(35)
            keys = [(" ".join(names[k : k + 35]), *h) for k, *h in zip(at, w.windows(35, 0)[at].tolist(), w.windows(35, 1)[at].tolist())]
            assert len(set(keys)) == len({k[0] for k in keys}) == len({k[1] for k in keys}) == len({k[2] for k in keys})
    for f in found:
        assert len(set(f.values())) == len(f) > 400


def test_shingles_are_functions_of_the_words():
    def one(t):
        raw = t.encode()
        h, _ = shingles(Words(np.frombuffer(b"q " + raw, np.uint8), np.array([0, 2, 2 + len(raw)]), True))
        return set(h.tolist())

    assert one("a b c d e f") & one("zz zz A b  c\nd e") - one("zz")
    assert not (one("a b c d e") - one("q")) & (one("a b c d f") - one("q"))


@pytest.mark.parametrize("per_task", [1_000_000, 20])
def test_components(spark, per_task):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (6, 3), (7, 8), (8, 7), (None, 1), *((100, k) for k in range(101, 140)), *((k, k + 1) for k in range(200, 240))]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), per_task=per_task).collect()}
    want = {1: 1, 2: 1, 3: 1, 6: 1, 4: 4, 5: 4, 7: 7, 8: 7} | {k: 100 for k in range(100, 140)} | {k: 200 for k in range(200, 241)}
    assert got == want


def test_rules(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.quality_rules(docs).collect())
    want = Counter()
    for r in rows:
        t, w = r[1] or "", split(r[1])
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)] += 1
    assert got == want


def test_common_lines_deplete(spark):
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))  # noqa: E731  lines are normalised: digits alone would not differ
    line = lambda i: " ".join(f"{letters(i)}q{letters(k)}" for k in range(13))
    unique = lambda i: "\n".join(line(100 * i + k) for k in range(8))
    common = "\n".join(line(900_000 + k) for k in range(8))
    data = [(i, unique(i) + ("\n" + common if i < 40 else ""), "h") for i in range(60)] + [(60 + i, common + "\n" + line(70_000 + i), "h") for i in range(5)] + [(99, common, "other")]
    got = {r.doc_id: (r.kept, r.n_line_words_removed) for r in rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert all(got[i][0] for i in range(60)) and not any(got[60 + i][0] for i in range(5))
    assert got[0][1] == 8 * 13 and got[50][1] == 0 and got[99] == (True, 0)



def test_common_lines_of_a_large_source(spark):
    word = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    line = lambda i: " ".join(f"{word(i)}q{word(k)}" for k in range(60))
    common = line(90_000)
    data = [(i, line(i), "h") for i in range(1500)] + [(2000 + i, common, "h") for i in range(25)]
    got = {r.doc_id: (r.kept, r.n_line_words_removed) for r in rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == (True, 0) for i in range(1500)) and all(got[2000 + i] == (False, 60) for i in range(25))

ODD = ["", "a  b", "a   b", "  a", "a ", "a  ", " a \n b", "a\n  b", "don't I'll", "<|endoftext|>hi <|endoftext|> yo", "日本語 テキスト", "a\x1cb c", "aaaaaaaaaaa aaaa aaa", "½ ² x²", "\r\n a\r\n", "é ª º µ", "a  b", "x" * 3000]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts(docs, rows):
    path, tok = library()
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.lang) for r in tokens.count_tokens(docs, path, 100).collect())
    n = {t: len(tok.encode(t or "", add_special_tokens=False).ids) for t in {r[1] for r in rows}}
    assert got == Counter((r[0], len((r[1] or "").encode()), n[r[1]], n[r[1]] > 100, r[2]) for r in rows)
    odd = [*ODD, " ".join(ODD), *ODD]
    want = [tok.encode(t, add_special_tokens=False).ids for t in odd]
    for bits in (3, 20):  # a table that overflows within a text, and one that doesn't
        assert tokens.Counter(path, bits).count(odd).tolist() == [len(x) for x in want]
        encoder, got = packing.Encoder(path, bits), []
        for _ in range(2):
            for i, j, buf, offs in text_pieces(pa.array(odd)):
                ids, begin = encoder.encode(buf, offs, 1)
                got += [ids[begin[k] : begin[k + 1]].tolist() for k in range(j - i)]
        assert got == 2 * [[*x, 1] for x in want]
    with pytest.raises(ValueError, match="n_tokens"):
        tokens.count_tokens(docs.withColumn("n_tokens", F.lit(1)), path)


def test_long_pieces():
    import random

    path, tok = library()
    merger, r = tokens.Merger(path), random.Random(1)
    for letters in ("a", "ab", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz"):
        x = "".join(r.choice(letters) for _ in range(20_000))
        assert merger.surviving([x.encode(), b" the", x[:1500].encode()]).tolist() == [len(tok.encode(t).ids) for t in (x, " the", x[:1500])]


def test_packing_spreads_repeated_rows_and_replaces_its_columns(spark):
    rows = spark.createDataFrame([(None, 0, 5, 5, "z", 1, 2)] * 4000, "doc_id long, start long, length long, doc_tokens long, offset string, sequence_id int, `group` int")
    out = packing.pack(rows, 64, group_size=500)
    groups = Counter(r.sequence_id % 8 for r in out.collect())
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "group", "sequence_id", "offset"]
    assert len(groups) == 8 and max(groups.values()) < 700


def test_packing(docs, rows):
    path, tok = library()
    size = 64
    out = packing.pack(packing.token_pieces(docs, path, size), size, group_size=20).collect()
    want = Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), size):
            raw = np.array(ids[s : s + size], "<u4").tobytes()
            want[r[0], s, len(raw) // 4, zlib.crc32(raw), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= size


def test_first_fit_decreasing():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 50):
        lengths = r.integers(1, 100, n)
        bins, offs = packing.first_fit_decreasing(lengths, 100)
        room, want = [], {}
        for i in np.argsort(-lengths, kind="stable"):
            k = next((k for k, x in enumerate(room) if x >= lengths[i]), len(room))
            if k == len(room):
                room.append(100)
            want[i] = (k, 100 - room[k])
            room[k] -= lengths[i]
        assert [want[i] for i in range(n)] == list(zip(bins.tolist(), offs.tolist()))


def test_mixing(docs, rows):
    a = Counter(tuple(r) for r in mixing.mix_sizes(docs).collect())
    assert a == Counter(tuple(r) for r in mixing.mix_sizes(docs).collect())
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, full = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), set()
    while True:
        rest, share = total - sum(2 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        new = {s for s in order if s not in full and rest * weight[s] / share > 2 * sizes[s]}
        if not new:
            break
        full |= new
    goal = {s: 2 * sizes[s] if s in full else rest * weight[s] / share for s in order}
    taken = Counter()
    for (_, source, size, source_size, target, copies, words), n in a.items():
        assert source_size == sizes[source] and abs(target - goal[source]) < 1e-6 * max(1, target) and words == copies * size <= 2 * size
        taken[source] += n * words
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(len(split(r[1])) for r in rows if r[3] == s)


def test_mixing_repeated_rows_and_clashing_columns(spark):
    """A row that fills its source, and columns of the names that the operator uses itself."""
    text = "a b c d"
    rows = [(1, text, "x", 1.0)] * 1000 + [(None, text, "x", 1.0)] * 300 + [(k, text + " e" * (k % 7), "a", 2.0) for k in range(10, 700)] + [(k, text, None, 0.0) for k in range(5000, 5100)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string, mean double").repartition(5)
    names = ["shift", "tilt", "flip_by", "flip_u", "__size", "__u", "doc", "mix", "u", "part", "row", "local", "n"]
    docs = plain.select("*", *(F.lit(7).alias(c) for c in names), F.lit("old").alias("size"))
    out = mixing.mix(docs).collect()
    assert [*out[0].asDict()] == ["doc_id", "text", "source", "mean", *names, *mixing.NEW] and len(out) == len(rows) and all(r.shift == 7 for r in out)
    for source in ("x", "a", None):
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10 and all(r.taken == r.copies * r.size <= 2 * r.size for r in own)
        assert sum(r.size for r in own) == own[0].source_size
    assert len({r.copies for r in out if r.doc_id == 1}) == 2  # split over its copies
    key = lambda df: Counter((r.doc_id, r.source, r.size, r.taken) for r in df.collect())
    assert key(mixing.mix_sizes(plain)) == key(mixing.mix_sizes(plain.repartition(3))) == Counter((r.doc_id, r.source, r.size, r.taken) for r in out)


def test_tilts_meet_targets_and_are_exponential(spark):
    r = np.random.default_rng(3)
    sizes = {s: r.lognormal(4, 1.2, 200).astype(int) + 1 for s in ("a", "b", "c", "d")}
    hist = spark.createDataFrame([(s, int(x), 1) for s, xs in sizes.items() for x in xs], "source string, size long, docs long")
    part = {"a": 0.05, "b": 0.9, "c": 1.7, "d": 1.99}
    goals = spark.createDataFrame([(s, int(xs.sum()), float(part[s] * xs.sum())) for s, xs in sizes.items()], "source string, source_size long, target double")
    for x in mixing.tilts(hist, goals).collect():
        own = sizes[x.source]
        rate = np.minimum(2, np.exp(np.minimum(x.tilt * own / own.mean(), 1)))
        assert abs((rate * own).sum() / (part[x.source] * own.sum()) - 1) < 1e-5


def test_empty_tables(empty):
    path, _ = library()
    for out in (substring.remove_repeated(empty), jaccard.near_duplicates(empty), rules.quality_rules(empty), tokens.count_tokens(empty, path), packing.pack(packing.token_pieces(empty, path)), mixing.mix_sizes(empty)):
        assert out.count() == 0


def test_kept_digest(docs):
    r = substring.remove_repeated(docs).select("kept_text", F.sha2("kept_text", 256).alias("h")).first()
    assert r.h == hashlib.sha256(r.kept_text.encode()).hexdigest()
