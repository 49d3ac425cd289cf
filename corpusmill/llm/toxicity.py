"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other; each later model gets the probabilities of the earlier
ones as features.  While fitting, those are out-of-fold predictions (``FOLDS`` folds by id), so a later model
learns from probabilities as honest as those it will see.  The labels table holds two categories: junk
(quality 0) and toxic; the chain is junk, then toxic.  Any list of label columns can be chained.

A text's features are the presence of its words (A-Z lower-cased), of their first 3 to 6 characters and of their
last two bytes, and whether two, or three, different words share such a beginning or end: a word family says more than
one of its words.  A category's model uses those that mark it: features in at least ``MIN_DOCS`` labelled rows
of the category that are ``MIN_LIFT`` times as frequent there as elsewhere and by chance only with a probability of
exp(-``SURPRISE``).  So a long clean text has little to add up.  How many there are is bounded by the sample.

The models are fitted on the driver from a sample of about ``MAX_LABELLED`` labelled rows (by hash of the id;
all rows where there are fewer); every document is scored whole.

Defined results: a null or empty text has no features and gets the models' base rates.  Without labelled rows
of a category, its probability is 0 everywhere.  Repeated rows are scored one by one; a label row repeated for
an id counts each time; null labels are left out, and so is a null id.  A probability at the threshold rejects.  Texts of
any length are scored whole; in one of more than 2 MB, words of a family are counted by parts of 1 MB.  An empty
table gives an empty table.  Columns of the names that are added are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import vec
from corpusmill.llm.names import free_names
from corpusmill.llm.store import written

MAX_LABELLED, FOLDS, MIN_DOCS, MIN_LIFT, SURPRISE = 12_000, 5, 4, 3.0, 5.0
HEADS, TAIL, MORE = (3, 4, 5, 6), 2, (2, 3)
_ROOT = ~np.uint64(3)  # the low bits of a feature tell how many words it asks for


def word_features(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(document of each word, feature hashes of each word by family)."""
    data = vec.LOWER[data]
    starts, ends = vec.word_spans(data, docs[:-1])
    hashes = vec.Hashes(data)
    points = np.append(np.flatnonzero((data & 0xC0) != 0x80), [len(data)] * max(HEADS))
    first = np.searchsorted(points, starts)
    families = [hashes.of(starts, ends)]
    for k, n in enumerate(HEADS):
        families.append(vec.mix(hashes.of(starts, np.minimum(points[first + n], ends)) + np.uint64(k + 1)))
    families.append(vec.mix(hashes.of(np.maximum(starts, ends - TAIL), ends) + np.uint64(99)))
    return np.searchsorted(docs, starts, "right") - 1, families


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    offsets, data = vec.text_buffers(column)
    for a, b in vec.pieces(offsets):
        part, docs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) <= 2 * vec.PIECE:
            yield a, part, docs
            continue
        at = 0
        while at < len(part):  # a long document in parts, cut at white space
            end = min(len(part), at + vec.PIECE)
            while end < len(part) and not vec.SPACE[part[end]]:
                end += 1
            yield a, part[at:end], np.array([0, end - at])
            at = end


def features_of(doc: np.ndarray, families: list[np.ndarray], roots: np.ndarray | None = None, maybe: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, features), each pair once; of ``roots`` (sorted) alone where given."""
    docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for kind, f in enumerate(families):
        root, of, word = f & _ROOT, doc, families[0]
        if roots is not None:
            near = np.flatnonzero(maybe[(root >> np.uint64(44)).astype(np.int64)])
            near = near[roots[np.minimum(np.searchsorted(roots, root[near]), len(roots) - 1)] == root[near]]
            root, of, word = root[near], of[near], word[near]
        key = vec.mix(root + of.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        _, once = np.unique(vec.mix(key + word * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        _, first, n = np.unique(key[once], return_index=True, return_counts=True)
        docs.append(of[once][first])
        found.append(root[once][first])
        for t, least in enumerate(MORE if kind else (), 1):
            docs.append(docs[-t][n >= least])
            found.append(found[-t][n >= least] | np.uint64(t))
    return np.concatenate(docs), np.concatenate(found)


def _pairs(column: pa.Array, roots: np.ndarray | None = None, maybe: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, features), each pair once, for pieces of about 1 MB or single longer documents."""
    for a, parts in groupby(_texts(column), key=lambda part: part[0]):
        got = [features_of(*word_features(part, at), roots, maybe) for _, part, at in parts]
        if len(got) == 1:
            yield got[0][0] + a, got[0][1]
        else:  # one long document
            every = np.unique(np.concatenate([found for _, found in got]))
            yield np.full(len(every), a), every


def _counted(n_labels: int):
    """(feature, rows with it, rows with it of each category), one row per feature and piece of about 1 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array([batch.column(f"y{i}").to_numpy(zero_copy_only=False) for i in range(n_labels)], np.int64)
            for docs, found in _pairs(batch.column("text")):
                keys, place = np.unique(found, return_inverse=True)
                sums = [np.bincount(place, minlength=len(keys)), *(np.bincount(place, y[docs], len(keys)) for y in labels)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(s.astype(np.int64)) for s in sums)], names=["f", "n", *(f"n{i}" for i in range(n_labels))])

    return run


@dataclass
class Link:
    """One category's linear model over features and the probabilities of the links before it."""

    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    before: np.ndarray
    bias: float

    def scores(self, rows: np.ndarray, cols: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        z = self.bias + (np.bincount(rows, self.weights[cols], n) if len(rows) else np.zeros(n)) + earlier @ self.before
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Present:
    """Which of the given features stand in each document of a column."""

    def __init__(self, features: np.ndarray):
        self.features, self.roots = features, np.unique(features & _ROOT)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(features >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(documents, places in ``features``), each pair once, sorted."""
        out = [np.zeros(0, np.int64)]
        size = len(self.features)
        if size:
            for docs, found in _pairs(column, self.roots, self.maybe):
                place = np.minimum(np.searchsorted(self.features, found), size - 1)
                hit = self.features[place] == found
                out.append(docs[hit] * size + place[hit])
        pairs = np.sort(np.concatenate(out))
        return pairs // max(1, size), pairs % max(1, size)


def _fitted(rows: np.ndarray, cols: np.ndarray, size: int, earlier: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by Adam on the whole sample; ``earlier`` is dense."""
    n, m = len(y), earlier.shape[1]
    w = np.zeros(size + m + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(rows, w[:size][cols], n) + earlier @ w[size:-1]
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.concatenate([np.bincount(cols, r[rows], size), earlier.T @ r, [r.sum()]])
        g[:-1] += ridge / max(1, n) * w[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        w -= 0.2 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w[:size], w[size:-1], float(w[-1])


class Chain:
    """Fitted links by category, in order."""

    def __init__(self, names: list[str], links: list[Link | None]):
        self.names, self.links = names, links

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, names: list[str], text: str = "text", key: str = "doc_id", most: int = MAX_LABELLED) -> Chain:
        """``labels`` has ``key`` and a 0/1 column for each of ``names``."""
        marks = labels.select(F.col(f"`{key}`").cast("long").alias("id"), *[F.col(f"`{c}`").cast("int").alias(f"y{i}") for i, c in enumerate(names)]).dropna()
        total = marks.count()
        if not total:
            return cls(names, [None] * len(names))
        if total > most:
            marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * most / total))
        rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(marks), "id")  # about `most` rows
        rows = written(rows, "toxicity-sample")
        sums = rows.agg(F.count("*").alias("n"), *[F.sum(f"y{i}").alias(f"y{i}") for i in range(len(names))]).first()
        schema = "f long, n long, " + ", ".join(f"n{i} long" for i in range(len(names)))
        counts = written(rows.mapInArrow(_counted(len(names)), schema).groupBy("f").agg(F.sum("n").alias("n"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))]), "toxicity-counts")
        chosen = []
        for i in range(len(names)):
            inside, outside = max(1, sums[f"y{i}"] or 0), max(1, sums["n"] - (sums[f"y{i}"] or 0))
            lift = (F.col(f"n{i}") / inside) / ((F.col("n") - F.col(f"n{i}") + 0.5) / outside)
            base, share = inside / max(inside + 1, sums["n"]), F.col(f"n{i}") / F.col("n")
            surprise = F.col("n") * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))
            top = counts.where((F.col(f"n{i}") >= MIN_DOCS) & (lift >= MIN_LIFT) & (surprise >= SURPRISE)).select("f").toArrow()
            chosen.append(np.sort(top["f"].to_numpy().view(np.uint64)) if len(top) else np.zeros(0, np.uint64))
        every = np.unique(np.concatenate(chosen))
        sample = rows.mapInArrow(_sampled(every, len(names)), "id long, has array<int>, " + ", ".join(f"y{i} int" for i in range(len(names)))).orderBy("id").toArrow()
        n, ids = len(sample), sample["id"].to_numpy()
        if not n:
            return cls(names, [None] * len(names))
        has = sample["has"].combine_chunks()
        lengths, cols = np.diff(has.offsets.to_numpy()), has.values.to_numpy(zero_copy_only=False)[has.offsets[0].as_py() : has.offsets[-1].as_py()]
        docs_of = np.repeat(np.arange(n), lengths)
        fold = (vec.mix(ids.astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
        earlier, links = np.zeros((n, 0)), []
        for i in range(len(names)):
            y = sample[f"y{i}"].to_numpy().astype(float)
            if not 0 < y.sum() < n:
                links.append(None)
                earlier = np.column_stack([earlier, np.zeros(n)])
                continue
            place = np.searchsorted(chosen[i], every[cols])
            place = np.minimum(place, max(0, len(chosen[i]) - 1))
            own = chosen[i][place] == every[cols] if len(chosen[i]) else np.zeros(len(cols), bool)
            r, c, size = docs_of[own], place[own], len(chosen[i])
            honest = np.zeros(n)
            for k in range(FOLDS):
                train = fold != k
                if not 0 < y[train].sum() < train.sum():
                    continue
                number = np.cumsum(train) - 1
                mine = train[r]
                part = Link(chosen[i], *_fitted(number[r[mine]], c[mine], size, earlier[train], y[train]))
                honest[~train] = part.scores(r, c, n, earlier)[~train]
            links.append(Link(chosen[i], *_fitted(r, c, size, earlier, y)))
            earlier = np.column_stack([earlier, honest])
        return cls(names, links)

    def probabilities(self, column: pa.Array) -> np.ndarray:
        n, earlier = len(column), np.zeros((len(column), 0))
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x.features for x in self.links if x)]))
        rows, cols = Present(every)(column)
        for x in self.links:
            if x is None:
                earlier = np.column_stack([earlier, np.zeros(n)])
                continue
            place = np.minimum(np.searchsorted(x.features, every[cols]), max(0, len(x.features) - 1)) if len(cols) else cols
            own = x.features[place] == every[cols] if len(x.features) and len(cols) else np.zeros(len(cols), bool)
            earlier = np.column_stack([earlier, x.scores(rows[own], place[own], n, earlier)])
        return earlier

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with column p_<name> for each category; columns of those names are replaced."""
        added = [T.StructField(f"p_{c}", T.DoubleType()) for c in self.names]
        names = {f.name for f in added}
        passed = [f for f in docs.schema.fields if f.name not in names]
        schema = T.StructType([*passed, *added])
        need = docs.select(*[f"`{f.name}`" for f in docs.schema.fields if f.name not in names or f.name == text])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = self.probabilities(batch.column(text))
                arrays = [batch.column(f.name) for f in passed] + [pa.array(p[:, i].copy()) for i in range(p.shape[1])]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

        return need.mapInArrow(run, schema)


def _sampled(every: np.ndarray, n_labels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = Present(every)
        for batch in batches:
            rows, cols = present(batch.column("text"))
            offsets = np.searchsorted(rows, np.arange(len(batch) + 1))
            has = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cols, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), has, *(batch.column(f"y{i}") for i in range(n_labels))], names=["id", "has", *(f"y{i}" for i in range(n_labels))])

    return run


CATEGORIES = ["junk", "toxic"]
THRESHOLD = 0.5


def table_labels(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 0).cast("int").alias("junk"), F.col("toxic").cast("int").alias("toxic"))


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with p_junk, p_toxic and toxic (boolean)."""
    scored = Chain.fit(docs, labels, CATEGORIES, text, key).score(docs, text)
    return scored.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs``, all columns as they are, without the documents judged toxic."""
    made = ["p_junk", "p_toxic", "toxic"]
    clash = [c for c in docs.columns if c.lower() in made]
    aside = dict(zip(clash, free_names([*docs.columns, *made], len(clash)), strict=True))
    kept = judged(docs.withColumnsRenamed(aside), labels, text, key).where("not toxic").drop(*made)
    return kept.withColumnsRenamed({v: k for k, v in aside.items()}).select(*[f"`{c}`" for c in docs.columns])


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Each document's probabilities and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs, table_labels(spark, sf_dir)).select("doc_id", "p_junk", "p_toxic", "toxic")
