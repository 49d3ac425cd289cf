"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of anything but white space and ASCII punctuation, A-Z lower-cased.  Every window of a
document as long as an item's size class has a 64-bit SimHash of its word pairs (running bit counts make each
window a subtraction); an item has the fingerprint of its first words, as many as its class.  Size classes are
the numbers of ``SIZES``; an item's is the largest that it has words for.

A fingerprint within ``RADIUS`` bits of another agrees with it in one of four 16-bit blocks but for
``RADIUS // 4`` bits (else each block would hold more, together more than the radius).  So each item is filed
under all values that near each of its blocks, and a window meets all items within the radius, none missed.
Those are compared on their whole length: weighted Jaccard of five-word shingles, a shingle weighing its
number times log(1 + items / items that hold it).

A fingerprint speaks for an item's first words only, so copies changed there are found by anchors: shingles of
an item that together weigh more than the part of it that ``LEAST`` lets a copy miss, wherever they stand.  Any
window as alike as that holds one of them.  All windows as long as the item that hold an anchor are compared,
also those that stick out of the document's start or end, there cut, so none at ``LEAST`` or more is missed.

An item of fewer words than a shingle is one shingle, all its words; documents that hold these in a row hold it.

Items go to the executors in blocks of ``ITEM_BLOCK``, each block one pass over the documents.

Defined results: null and empty texts hold no item, and items without a word are held by none; items equal in id
and words count once, and equal items with other ids are all reported, as are all texts of one id and items without an
id (``op9_decontamination`` counts an id once, and lists null last, once, for all hits without an id).
Repeated documents are judged one by one.  Of windows equally alike the first is reported.  Documents and items of any length
are searched whole: running counts are kept for ``_STEP`` words at a time.  An empty benchmark leaves all documents clean, an
empty table gives an empty table.  ``find`` replaces a column of the name it adds; all others pass through, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import vec
from corpusmill.llm.names import free_names
from corpusmill.llm.store import written

SHINGLE, LEAST, RADIUS, ITEM_BLOCK = 5, 0.8, 11, 5_000
SIZES = (5, 6, 7, 8, 11, 16, 22, 32, 45, 64, 90, 128)
_STEP = 1 << 16  # words whose bit counts are held at once

_TABLE = vec.LOWER.copy()
_TABLE[[b for b in range(128) if not chr(b).isalnum()]] = 32


def _pairs(words: np.ndarray) -> np.ndarray:
    return vec.mix(words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:])


def fingerprints(words: np.ndarray, size: int, counts: np.ndarray | None = None) -> np.ndarray:
    """SimHash of each run of ``size`` words."""
    counts = bit_counts(words) if counts is None else counts
    m = size - 1
    if len(counts) <= m:
        return np.zeros(0, np.uint64)
    ones = counts[m:] - counts[:-m]
    return np.packbits(ones > m // 2, axis=1).view(np.uint64).reshape(-1)


def bit_counts(words: np.ndarray) -> np.ndarray:
    """Running counts of the 64 bits of the word pairs' hashes, modulo 2**16."""
    bits = np.unpackbits(_pairs(words).view(np.uint8).reshape(-1, 8), axis=1) if len(words) > 1 else np.zeros((0, 64), np.uint8)
    out = np.zeros((len(bits) + 1, 64), np.uint16)
    np.cumsum(bits, axis=0, dtype=np.uint16, out=out[1:])
    return out


def _shingle_weights(words: np.ndarray, idf: dict[int, float], other: float) -> dict[int, float]:
    out: dict[int, float] = {}
    for s in vec.shingles(words, SHINGLE).tolist():
        out[s] = out.get(s, 0.0) + idf.get(s, other)
    return out


class Index:
    """Items of one block: by size class, the four tables of near block values and what verifies."""

    def __init__(self, items: list[tuple[int, list[int], list[int]]], total: int, radius: int = RADIUS):
        self.radius, self.total = radius, total
        self.items = [(i, np.array(w, np.int64).view(np.uint64)) for i, w, _ in items]
        self.idf: dict[int, float] = {}
        for (_, words), (_, _, df) in zip(self.items, items, strict=True):
            self.idf.update(zip(vec.shingles(words, SHINGLE).tolist(), (math.log(1 + total / max(1, d)) for d in df), strict=True))
        self.other = math.log(1 + total)
        self.weights = [_shingle_weights(w, self.idf, self.other) for _, w in self.items]
        flips = [0] + [sum(1 << b for b in c) for r in range(1, radius // 4 + 1) for c in combinations(range(16), r)]
        flips = np.array(flips, np.uint16)
        self.classes = []
        size_of = [max((s for s in SIZES if s <= len(w)), default=0) for _, w in self.items]
        self.short: dict[int, dict[int, list[int]]] = {}  # by number of words: shingle -> items
        for k, (_, w) in enumerate(self.items):
            if len(w) < SHINGLE:
                self.short.setdefault(len(w), {}).setdefault(int(vec.shingles(w, SHINGLE)[0]), []).append(k)
        for size in sorted(set(size_of) - {0}):
            own = np.array([k for k, s in enumerate(size_of) if s == size])
            prints = np.array([fingerprints(self.items[k][1][:size], size)[0] for k in own], np.uint64)
            tables = []
            for b in range(4):
                near = prints.view(np.uint16).reshape(-1, 4)[:, b][:, None] ^ flips[None, :]
                who = np.repeat(np.arange(len(own)), len(flips))
                order = np.argsort(near.reshape(-1), kind="stable")
                starts = np.searchsorted(near.reshape(-1)[order], np.arange(65537))
                tables.append((starts, who[order], np.diff(starts) > 0))
            self.classes.append((size, own, prints, tables))
        self.total_weight = [sum(w.values()) for w in self.weights]
        self.keys = [np.array(sorted(w), np.uint64) for w in self.weights]
        anchors: dict[int, list[int]] = {}
        for k, weight in enumerate(self.weights):
            if not size_of[k]:
                continue
            left = (1 - LEAST) * self.total_weight[k] + 1e-9
            for s in sorted(weight, key=lambda s: (-weight[s], s)):  # noqa: B023
                anchors.setdefault(s, []).append(k)
                left -= weight[s]
                if left < 0:
                    break
        self.anchors = np.array(sorted(anchors), np.uint64)
        self.holders = [anchors[s] for s in self.anchors.tolist()]
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.anchors >> np.uint64(44)).astype(np.int64)] = True

    def near(self, prints: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(windows, items of class k) of all fingerprints within the radius."""
        _, own, known, tables = self.classes[k]
        blocks = prints.view(np.uint16).reshape(-1, 4)
        windows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b, (starts, who, some) in enumerate(tables):
            w = np.flatnonzero(some[blocks[:, b]])
            v = blocks[w, b].astype(np.int64)
            n = starts[v + 1] - starts[v]
            w = np.repeat(w, n)
            at = np.repeat(starts[v] - (np.cumsum(n) - n), n) + np.arange(len(w))
            i = who[at]
            good = np.bitwise_count(prints[w] ^ known[i]) <= self.radius
            windows.append(w[good])
            items.append(i[good])
        pairs = np.unique(np.concatenate(windows) * len(own) + np.concatenate(items))
        return pairs // len(own), own[pairs % len(own)]

    def similarity(self, words: np.ndarray, k: int) -> float:
        mine, item = _shingle_weights(words, self.idf, self.other), self.weights[k]
        both = sum(min(v, item[s]) for s, v in mine.items() if s in item)
        every = sum(mine.values()) + sum(item.values()) - both
        return both / every if every else 0.0

    def anchored(self, words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """(document, item's place, similarity, first word) of the best window by anchors, at ``LEAST`` or more."""
        if len(words) < SHINGLE or not len(self.anchors):
            return
        seen = vec.shingles(words, SHINGLE)
        at = np.flatnonzero(self.some[(seen >> np.uint64(44)).astype(np.int64)] & (doc[: len(seen)] == doc[SHINGLE - 1 :]))
        key = np.minimum(np.searchsorted(self.anchors, seen[at]), len(self.anchors) - 1)
        good = self.anchors[key] == seen[at]
        held: dict[tuple[int, int], list[int]] = {}
        for p, k in zip(at[good].tolist(), key[good].tolist(), strict=True):
            for i in self.holders[k]:
                held.setdefault((int(doc[p]), i), []).append(p)
        for (d, i), places in held.items():
            first, past = int(np.searchsorted(doc, d, "left")), int(np.searchsorted(doc, d, "right")) - SHINGLE + 1
            m = len(self.items[i][1]) - SHINGLE + 1
            best: tuple[float, int] = (0.0, 0)
            runs: list[list[int]] = []  # of first shingles of windows that hold an anchor
            for p in places:
                if runs and p - m <= runs[-1][1]:
                    runs[-1][1] = p
                else:
                    runs.append([p - m + 1, p])
            for lo, hi in runs:
                own = seen[max(first, lo) : min(past, hi + m)]
                shared = np.unique(own[np.isin(own, self.keys[i])]).tolist()
                if sum(self.weights[i][s] for s in shared) >= LEAST * self.total_weight[i] - 1e-9:
                    best = max(best, self._slide(own.tolist(), max(first, lo), lo, hi, m, i), key=lambda x: x[0])
            if best[0] >= LEAST - 1e-9:
                w = max(first, best[1])
                s = self.similarity(words[w : min(past + SHINGLE - 1, best[1] + m + SHINGLE - 1)], i)
                if s >= LEAST - 1e-9:
                    yield d, i, s, w

    def _slide(self, own: list[int], start: int, lo: int, hi: int, m: int, i: int) -> tuple[float, int]:
        """The best (similarity, first shingle) of item i and the windows of m shingles from lo to hi; ``own``
        has the shingles from ``start`` on, places before and behind it are empty."""
        item, count, both, mine, best = self.weights[i], dict[int, int](), 0.0, 0.0, (0.0, lo)

        def change(p: int, by: int) -> None:
            nonlocal both, mine
            if start <= p < start + len(own):
                s = own[p - start]
                one = self.idf.get(s, self.other)
                mine += by * one
                if s in item:
                    n = count.get(s, 0)
                    count[s] = n + by
                    both += min((n + by) * one, item[s]) - min(n * one, item[s])

        for p in range(lo, lo + m - 1):
            change(p, 1)
        for w in range(lo, hi + 1):
            change(w + m - 1, 1)
            alike = both / (mine + self.total_weight[i] - both)
            if alike > best[0] + 1e-12:
                best = (alike, w)
            change(w, -1)
        return best

    def matches(self, words: np.ndarray, doc: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        """(document, item's place) -> (similarity, first word) of the best windows at ``LEAST`` or more.

        ``doc`` has the document of each word; windows stay inside one."""
        found: dict[tuple[int, int], tuple[float, int]] = {}
        overlap = max((s for s, *_ in self.classes), default=1) - 1
        for at in range(0, max(1, len(words) - 1), _STEP):
            counts = bit_counts(words[at : at + _STEP + overlap])
            for k, (size, *_) in enumerate(self.classes):
                prints = fingerprints(words, size, counts)[:_STEP]
                inside = np.flatnonzero(doc[at : at + len(prints)] == doc[at + size - 1 : at + size - 1 + len(prints)])
                windows, items = self.near(prints[inside], k)
                for w, i in zip(inside[windows] + at, items, strict=True):
                    d = int(doc[w])
                    past = min(w + len(self.items[i][1]), int(np.searchsorted(doc, d, "right")))
                    s = self.similarity(words[w:past], int(i))
                    if s >= LEAST - 1e-9 and s > found.get((d, int(i)), (0.0, 0))[0]:
                        found[d, int(i)] = (s, int(w))
        for m, held in self.short.items():
            seen = vec.shingles(words, m) if len(words) >= m else np.zeros(0, np.uint64)
            inside = np.flatnonzero(doc[: len(seen)] == doc[m - 1 : m - 1 + len(seen)])
            for w in inside[np.isin(seen[inside], np.array(sorted(held), np.uint64))].tolist():
                for i in held[int(seen[w])]:
                    found.setdefault((int(doc[w]), i), (1.0, w))
        for d, i, s, w in self.anchored(words, doc):
            if s > found.get((d, i), (0.0, 0))[0]:
                found[d, i] = (s, w)
        return found


def item_rows(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item_id, words, df): word hashes of each item, and of each of its shingles the items that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, shingles = [], []
            for _, at, hashes in vec.document_words(batch.column("text"), table=_TABLE):
                for i in range(len(at) - 1):
                    own = hashes[at[i] : at[i + 1]]
                    words.append(own.view(np.int64))
                    shingles.append(vec.shingles(own, SHINGLE).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.list_(pa.int64())), pa.array(shingles, pa.list_(pa.int64()))], names=["item_id", "words", "shingles"])

    rows = benchmark.select(F.col(f"`{key}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "item_id long, words array<long>, shingles array<long>")
    # a passage is an id with its words; the id may be null
    rows = rows.where(F.size("words") > 0).withColumn("passage", F.xxhash64(F.col("item_id").isNull(), "item_id", "words")).dropDuplicates(["passage"])
    each = rows.select("passage", F.posexplode("shingles").alias("at", "s"))
    df = each.groupBy("s").agg(F.count_distinct("passage").alias("df"))
    listed = each.join(df, "s").groupBy("passage").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "df"))), lambda x: x["df"]).alias("df"))
    return rows.join(listed, "passage").select("item_id", "words", "df")


_HITS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType())])


@lru_cache(2)
def _index(key: str, packed: bytes, total: int) -> Index:
    import pickle

    return Index(pickle.loads(packed), total)


def _finder(block: list[tuple], total: int, passed: list[T.StructField], text: str, out: str):
    import hashlib
    import pickle

    packed = pickle.dumps(block)
    key = hashlib.sha256(packed).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, packed, total)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())]))
        for batch in batches:
            hits: list[list] = [[] for _ in range(len(batch))]
            for a, at, words in vec.document_words(batch.column(text), table=_TABLE):
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                for (d, i), (s, w) in index.matches(words, doc).items():
                    hits[a + d].append({"item_id": index.items[i][0], "similarity": s, "first_word": w - int(at[d])})
            arrays = [batch.column(f.name) for f in passed] + [pa.array(hits, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f.name for f in passed), out])

    return run


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", out: str = "hits") -> DataFrame:
    """``docs`` with column ``out``: the items each document holds (item_id, similarity, first_word)."""
    items = written(item_rows(benchmark, item_text, item_key), "benchmark-items")
    total = items.count()
    passed = [f for f in docs.schema.fields if f.name != out]
    so_far, more = free_names([*docs.columns, out], 2)
    need = docs.select(*[f"`{f.name}`" for f in docs.schema.fields if f.name != out or f.name == text])
    before, result = T.StructField(so_far, T.ArrayType(_HITS)), None
    block: list[tuple] = []

    def through(result: DataFrame) -> DataFrame:
        held = [*need.schema.fields, before]
        found = result.mapInArrow(_finder(list(block), total, held, text, more), T.StructType([*held, T.StructField(more, T.ArrayType(_HITS))]))
        return found.select(*[f"`{f.name}`" for f in need.schema.fields], F.concat(so_far, more).alias(so_far))

    result = need.withColumn(so_far, F.array().cast(T.ArrayType(_HITS)))
    for r in items.toLocalIterator():
        block.append((r["item_id"], list(r["words"]), list(r["df"])))
        if len(block) == ITEM_BLOCK:
            result = through(result)
            block.clear()
    if block:
        result = through(result)
    return result.select(*[f"`{f.name}`" for f in passed], F.col(so_far).alias(out))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    hits = free_names(docs.columns, 1)[0]
    return find(docs, benchmark, text, out=hits).where(F.size(hits) == 0).drop(hits)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Each document's benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item_id"])))
    return found.select("doc_id", F.size(items).cast("long").alias("n_items"), items.alias("items"), F.array_max(F.transform("hits", lambda x: x["similarity"])).alias("similarity"))
