"""URL filter: rules first, then host word segmentation and multinomial naive Bayes.

Concatenated names in hosts and paths, of any length, are split into words by Viterbi over a unigram model, whose words
are those of the pages' own text (letters only). A concatenation that occurs as a word now and then is rarer than the
product of its parts, so it is split all the same. Naive Bayes scores the words of host and path. It learns from the
pages that a rule decides, so what a rule says of some hosts carries over to their like; both classes have equal
priors, so a url without words is allowed.

Counts of words and of tokens cover all pages; they are combined before the shuffle, so a host with a third of all
pages costs a row a task. The unigram model has a size: the `vocabulary` most frequent words (of the least frequent
ones that are still in, those of least hash) of up to 63 letters, which is what a host's name can hold; naive Bayes
hashes its tokens into 2**TOKEN_BITS cells. Both are sent to the executors.

Defined results: null urls and urls without `://` have empty host and path, fit no rule and have no tokens: allow.
Null html gives no words. Repeated rows get equal results; extra columns are carried along, but for html and those of the
result's names, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, ship, worker_store

TOKEN_BITS = 16
#: Letters of a host's name between its dots, at most.
MOST_LETTERS = 63
UPPER = {c: c + 32 for c in range(65, 91)}
LETTERS, NAMES = re.compile("[a-z]+"), re.compile(r"[^\W\d_]+")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); A-Z of the host in lower case."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:end].translate(UPPER), rest[end:]
    end = next((i for i, c in enumerate(rest) if c in "?#"), len(rest))
    return host, rest[:end]


class Rules:
    """(verdict, 'host/path') pairs; a rule fits its host and its subdomains; the longest rule wins."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        at = 0
        while host:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = rule, verdict
                    break
            at = host.find(".", at) + 1
            if not at:
                break
        return best


class Segmenter:
    """Unigram Viterbi. Unknown stretches cost more with every letter, so known words win where they can."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.logp = {w: math.log(n / total) for w, n in counts.items()}
        self.lengths = sorted({*map(len, counts)})
        self.unknown = math.log(1 / (10 * total))

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for i in range(1, len(name) + 1):
            top, at = best[i - 1] + self.unknown, i - 1
            for long in self.lengths:
                j = i - long
                if j < 0:
                    break
                p = self.logp.get(name[j:i])
                if p is not None and best[j] + p > top:
                    top, at = best[j] + p, j
            best.append(top)
            back.append(at)
        out, i = [], len(name)
        while i:
            out.append(name[back[i] : i])
            i = back[i]
        return out[::-1]


def tokens(host: str, path: str, segmenter: Segmenter, seen: dict[str, list[str]]) -> list[str]:
    """Segmented words of the host and the path's names, marked apart."""
    out = seen.get(host)
    if out is None:
        out = [f"h:{w}" for name in NAMES.findall(host) for w in segmenter.split(name)]
        if len(seen) < 50_000 and len(host) <= 255:
            seen[host] = out
    return out + [f"p:{w}" for name in NAMES.findall(path.lower()) for w in segmenter.split(name)]


def cell(token: str) -> int:
    """A fixed hash (FNV-1a), equal on all machines."""
    h = 0xCBF29CE484222325
    for b in token.encode("utf-8", "replace"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return (h ^ (h >> 32)) & ((1 << TOKEN_BITS) - 1)


def word_counts(pages: DataFrame, vocabulary: int, seed: int = 13) -> dict[str, int]:
    """The most frequent words of the pages' text, tags left out."""
    tag = re.compile(r"<[^>]*>")

    def run(batches):
        total: Counter[str] = Counter()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for html in b.column("html").slice(at, 256).to_pylist():
                    total.update(w for w in LETTERS.findall(tag.sub(" ", html or "").lower()) if len(w) <= MOST_LETTERS)
                if len(total) > 200_000:  # pass on what there is; sums are taken later
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    sums = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = cut(sums)
    least, before, share = 0, 0, 1.0  # how often a word must occur, from how many words occur how often
    for r in sums.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():  # ends after `vocabulary` rows
        least = r["n"]
        if before + r["words"] >= vocabulary:
            share = (vocabulary - before) / r["words"]
            break
        before += r["words"]
    kept = sums.where((F.col("n") > least) | ((F.col("n") == least) & (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "word"), 11) <= int(share * (1 << 53)))))
    return {r["word"]: r["n"] for r in kept.collect()}


def learn(pages: DataFrame, rules: Rules, segmenter) -> np.ndarray:
    """Log-odds of block by token cell, from the pages that a rule decides."""

    def run(batches):
        total, seen = Counter(), {}
        for b in batches:
            for url in b.column("url").to_pylist():
                host, path = split_url(url)
                verdict = rules.find(host, path)[1]
                if verdict:
                    total.update((verdict == "block", cell(t)) for t in tokens(host, path, segmenter.value, seen))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.bool_()), pa.array([k[1] for k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["block", "cell", "n"])

    sums = pages.select(F.col("url").cast("string").alias("url")).mapInArrow(run, "block boolean, cell int, n long").groupBy("block", "cell").agg(F.sum("n").alias("n"))
    counts = np.ones((2, 1 << TOKEN_BITS))  # Laplace
    for r in sums.collect():  # 2 * 2**TOKEN_BITS rows at most
        counts[int(r["block"]), r["cell"]] += r["n"]
    logs = np.log(counts / counts.sum(1, keepdims=True))
    return logs[1] - logs[0]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], vocabulary: int = 200_000) -> DataFrame:
    """Columns of pages but html; host, path, rule, verdict, block_log_odds, host_words."""
    spark = pages.sparkSession
    ship(spark)
    new = ["host", "path", "rule", "verdict", "block_log_odds", "host_words"]
    keep = [c for c in pages.columns if c not in (*new, "html")]
    table = Rules(rules)
    segmenter = spark.sparkContext.broadcast(Segmenter(word_counts(pages, vocabulary)))
    odds = spark.sparkContext.broadcast(learn(pages, table, segmenter))
    schema = T.StructType([pages.schema[c] for c in keep])
    for name, kind in zip(new, (*[T.StringType()] * 4, T.DoubleType(), T.ArrayType(T.StringType())), strict=True):
        schema = schema.add(name, kind)

    def run(batches):
        seen: dict[str, list[str]] = {}
        cells = worker_store("urls:cells", dict)
        for b in batches:
            rows = []
            for url in b.column("url").cast(pa.string()).to_pylist():
                host, path = split_url(url)
                rule, verdict = table.find(host, path)
                found = tokens(host, path, segmenter.value, seen)
                score = 0.0
                for t in found:
                    at = cells.get(t)
                    if at is None:
                        at = cell(t)
                        if len(t) <= 64:
                            if len(cells) > 200_000:
                                cells.clear()
                            cells[t] = at
                    score += float(odds.value[at])
                rows.append((host, path, rule, verdict or ("block" if score > 0 else "allow"), score, [t[2:] for t in found if t[0] == "h"]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True))], names=[*keep, *new])

    return pages.select(*keep).mapInArrow(run, schema)
