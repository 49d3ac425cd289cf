"""N-gram Jaccard join: rare-first prefix filtering, four filters, one verification per pair, linked to components.

1. Frequent shingles are ranked: every task counts the shingles that it sees in two documents or more, the
   counts are summed, and the most frequent (``RANKED`` at most, a whole class of counts at a time) give the
   order: others first, by hash, then these from rare to frequent.  Any one order gives the same result.
2. Documents with equal shingle sets become one class; a class has its set's prefix under that order.
3. Two sets link only if they share a shingle of both prefixes, at places that leave room for the overlap
   they need (positional filter), and are of like size (length filter).  The suffix filter splits a set by
   hash into about as many ranges as it has shingles and keeps the parity of each range's count: sets differ
   in at least as many shingles as parities, so a pair with more unlike parities than it may have unlike
   shingles goes.  What is left is verified on the whole sets.
4. Only what decides components is verified, each pair once.  In a round every shingle proposes one class (a
   pivot, that with the fewest rare shingles before it, later another), and each class is verified against
   that pivot, of those that pass its filters, which shares most of its prefix (shingles of ``FEW`` classes at most
   propose all their pairs, once).  What links is joined.  ``PIVOT_ROUNDS``
   rounds at most, as long as they join anything.  Then all pairs that share a shingle, pass the filters, are not yet in one
   component and were not refused before are verified, so no link between different components is lost, and
   a group of near copies costs its size and not its square.  Of a pair in this step the shorter set must
   hold the shingle early enough for sets of its own size (the indexing prefix), so groups whose documents
   all differ by too much are told apart without pairing them up.

Sets are made again from the texts for those classes alone that have a pair to verify.

Defined results: null or empty texts (or white space alone) have no shingles and link with nothing.  Texts of
fewer words than a shingle have one shingle, all their words.  Repeated rows are rows of one class.  A null
id takes part in links but is never a component's smallest id; without any id in a component, its id is null.
Texts of any length are used whole.  Ties of counts in the order go by hash, ties between pivots too; neither
changes a result.  An empty table gives an empty table.  Of other columns only text and key are read, and in
``one_of_each`` all pass through whatever their names are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import vec
from corpusmill.llm.components import components
from corpusmill.llm.names import free_names
from corpusmill.llm.store import dropped, written

RANKED, PIVOT_ROUNDS, MOST_RANGES, MAP_WORDS, FEW = 1 << 17, 4, 1 << 16, 1 << 18, 3
#: Bytes of a batch sent to Python, and shingles that a worker gathers before it counts them.
BATCH, GATHERED = 1 << 20, 1 << 21
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_Batches = Iterator[pa.RecordBatch]


def _hand_back() -> None:
    """Give freed memory back to the system: workers live on between tasks and stages, and so would what they once took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def _lean(run: Callable[[_Batches], _Batches]) -> Callable[[_Batches], _Batches]:
    """``run`` in a worker that keeps nothing: neither from tasks before nor from this one."""

    @wraps(run)
    def leanly(batches: _Batches) -> _Batches:
        _hand_back()
        try:
            yield from run(batches)
        finally:
            _hand_back()

    return leanly


def _made(df: DataFrame, name: str) -> DataFrame:
    """``written`` for what Python makes of texts: batches are cut by bytes, not at 10,000 rows of any length."""
    conf = df.sparkSession.conf
    before = conf.get(_BYTES, None)
    conf.set(_BYTES, str(BATCH))
    try:
        return written(df, name)
    finally:
        if before is None:
            conf.unset(_BYTES)
        else:
            conf.set(_BYTES, before)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingles) of each text."""
    for a, at, words in vec.document_words(column, lower=True):
        for i in range(len(at) - 1):
            yield a + i, np.unique(vec.shingles(words[at[i] : at[i + 1]], k))


def _counted(parts: list[np.ndarray]) -> pa.RecordBatch:
    """Shingles that two sets or more of ``parts`` hold, with their number; ``parts`` is emptied."""
    held = np.concatenate(parts)
    parts.clear()
    held.sort()  # in place: these shingles are the most that a worker holds
    keys, again = np.unique(held[1:][held[1:] == held[:-1]], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(again + 1, pa.int64())], names=["shingle", "n"])


def _repeats(k: int):
    """Shingles that two documents or more of this task hold, with their number, ``GATHERED`` after ``GATHERED``."""

    @_lean
    def run(batches: _Batches) -> _Batches:
        parts, n = [], 0
        for batch in batches:
            for _, held in _sets(batch.column("text"), k):
                parts.append(held)
                n += len(held)
                if n >= GATHERED:
                    yield _counted(parts)
                    n = 0
        if n:
            yield _counted(parts)

    return run


def frequent(docs: DataFrame, k: int, most: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, their counts): at most ``most``, cut between classes of counts."""
    counts = _made(docs.mapInArrow(_repeats(k), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "ngram-counts")
    classes = counts.groupBy(F.floor(F.log2("n")).alias("c")).agg(F.count("*").alias("size")).orderBy(F.desc("c")).collect()
    total, least = 0, None
    for c in classes:  # a few dozen rows
        total += c["size"]
        if total > most:
            break
        least = c["c"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where(F.floor(F.log2("n")) >= int(least)).toArrow()
    dropped(counts)
    keys, n = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def set_key(held: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over the mixed shingles: equal sets have equal keys."""
    one = int(np.add.reduce(vec.mix(held))) if len(held) else 0
    two = int(np.add.reduce(vec.mix(held ^ np.uint64(0xA5A5A5A55A5A5A5A)))) if len(held) else 0
    return one - (one >> 63 << 64), two - (two >> 63 << 64)


def parities(held: np.ndarray) -> np.ndarray:
    """Whether each range of shingles holds an odd number of them, 64 ranges a word.

    Ranges are the low bits of the hash, as many as shingles (the next power of two)."""
    ranges = min(max(64, 1 << max(0, len(held) - 1).bit_length()), MOST_RANGES)
    odd = np.bincount((held & np.uint64(ranges - 1)).astype(np.int64), minlength=ranges) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _signed(k: int, num: int, den: int, keys: np.ndarray, counts: np.ndarray):
    """id, hash, n, the set's key, its prefix in rare-first order, and the parities of its ranges."""

    @_lean
    def run(batches: _Batches) -> _Batches:
        for batch in batches:
            n, one, two, prefix, odd = [], [], [], [], []
            for _, held in _sets(batch.column("text"), k):
                size = len(held)
                if len(keys) and size:
                    at = np.minimum(np.searchsorted(keys, held), len(keys) - 1)
                    ordered = held[np.argsort(np.where(keys[at] == held, counts[at], 0), kind="stable")]
                else:
                    ordered = held
                a, b = set_key(held)
                n.append(size)
                one.append(a)
                two.append(b)
                prefix.append(ordered[: size - -(-num * size // den) + 1].view(np.int64) if size else np.zeros(0, np.int64))
                odd.append(parities(held))
            arrays = [batch.column("id"), batch.column("hash"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "hash", "n", "k1", "k2", "prefix", "odd"])

    return run


def _whole(k: int):
    """The whole sets of the texts of classes."""

    @_lean
    def run(batches: _Batches) -> _Batches:
        for batch in batches:
            cls, known, out = batch.column("cls").to_pylist(), batch.column("k1").to_pylist(), ([], [])
            for i, held in _sets(batch.column("text"), k):
                if set_key(held)[0] == known[i]:  # another text of the same hash is not this class
                    out[0].append(cls[i])
                    out[1].append(held.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64()))], names=["cls", "held"])

    return run


def _needed(n: Column, m: Column, num: int, den: int) -> Column:
    """The least overlap of sets of n and m shingles that link."""
    return F.ceil((n + m) * num / F.lit(float(num + den)) - 1e-9)


def _fits(x: str, y: str, num: int, den: int) -> Column:
    """Length and positional filter for postings x and y of one shingle."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (n * den >= m * num) & (m * den >= n * num) & (F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos")) >= _needed(n, m, num, den))


def _folded(odd: Column, words: Column) -> Column:
    """Parities of as few ranges as ``words`` hold: ranges that fall together add up."""
    summed = F.transform(F.sequence(F.lit(1), words), lambda i: F.aggregate(F.sequence(i, F.size(odd), words), F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(F.element_at(odd, j))))
    return F.when(F.size(odd) == words, odd).otherwise(summed)


def _near(pairs: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b and more) whose parities (``known``: cls, n, odd) leave room for the overlap they need."""
    kept = pairs.columns
    for x in ("a", "b"):
        pairs = pairs.join(known.select(F.col("cls").alias(x), F.col("odd").alias(f"odd_{x}"), F.col("n").alias(f"n_{x}")), x)
    words = F.least(F.size("odd_a"), F.size("odd_b"))
    unlike = F.aggregate(F.zip_with(_folded(F.col("odd_a"), words), _folded(F.col("odd_b"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.where(unlike <= F.col("n_a") + F.col("n_b") - 2 * _needed(F.col("n_a"), F.col("n_b"), num, den)).select(*kept)


def _marked(docs: DataFrame, need: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose hash may be in ``need``: a bitmap of 2 MB, whatever is needed, spares the others
    the way to the join."""
    place = lambda c: F.col(c).bitwiseAND(MAP_WORDS * 64 - 1)
    words = need.groupBy(F.shiftright(place("its_hash"), 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(its_hash & 63 as int))")).alias("bits"))
    every = words.unionByName(docs.sparkSession.range(MAP_WORDS).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    bitmap = written(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("words")), "ngram-bitmap").scalar()
    return docs.where(F.getbit(F.get(bitmap, F.shiftright(place("hash"), 6).cast("int")), F.col("hash").bitwiseAND(63).cast("int")) == 1)


class _Sets:
    """The whole sets of classes, made from the texts when a pair first needs them."""

    def __init__(self, docs: DataFrame, known: DataFrame, k: int):
        self.docs, self.known, self.k, self.made = docs, known, k, []

    def of(self, pairs: DataFrame) -> DataFrame:
        """(cls, held) of at least all classes of ``pairs`` (a, b)."""
        need = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        if self.made:
            need = need.join(self.all().select("cls"), "cls", "left_anti")
        need = written(self.known.join(need, "cls").select("cls", F.col("id").alias("its_id"), F.col("hash").alias("its_hash"), "k1"), "ngram-need")
        if not self.made or not need.isEmpty():
            # null-safe: a class of rows without an id is found by its text
            texts = _marked(self.docs, need).join(need, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("hash") == F.col("its_hash"))).select("cls", "k1", "text")
            held = texts.mapInArrow(_whole(self.k), "cls long, held array<long>").groupBy("cls").agg(F.first("held").alias("held"))
            self.made.append(_made(held, "ngram-sets"))
        dropped(need)
        return self.all()

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.made)


def _verified(pairs: DataFrame, sets: _Sets, num: int, den: int) -> DataFrame:
    """``pairs`` (a, b) with ``links``: whether their sets do.  A set of a goes to where that of b is."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    held = sets.of(pairs).join(ends, "cls", "left_semi")
    pairs = pairs.join(held.select(F.col("cls").alias("a"), F.col("held").alias("held_a")), "a")
    pairs = pairs.join(held.select(F.col("cls").alias("b"), F.col("held").alias("held_b")), "b")
    both = F.size(F.array_intersect("held_a", "held_b")).cast("long")
    return pairs.select("a", "b", (both * den >= (F.size("held_a") + F.size("held_b") - both) * num).alias("links"))


def classes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows: id, hash, n, k1, k2; classes with the smallest id (null if all are), its text's hash, prefix and parities), both written."""
    every = _made(docs.mapInArrow(_signed(k, num, den, *frequent(docs, k)), "id long, hash long, n long, k1 long, k2 long, prefix array<long>, odd array<long>"), "ngram-rows")
    rows = written(every.select("id", "hash", "n", "k1", "k2"), "ngram-rows")
    one = every.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("least"), F.first("prefix").alias("prefix"), F.first("odd").alias("odd"))
    one = written(one.select("k1", "k2", "n", "least.id", "least.hash", "prefix", "odd").withColumn("cls", F.monotonically_increasing_id()), "ngram-classes")
    dropped(every)
    return rows, one


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def shared_postings(whole: DataFrame, num: int, den: int) -> DataFrame:
    """(cls, n, pos, shingle, early, df) of the prefixes' shingles that more than one class holds; df is their
    number or more.

    ``early``: a set of the same size could still link with this as their first common shingle; the shorter
    set of a pair that links has such a place, so a shingle without any makes no pair."""
    early = F.col("n") - F.col("pos") >= _needed(F.col("n"), F.col("n"), num, den)
    postings = whole.select("cls", "n", F.posexplode("prefix").alias("pos", "shingle")).withColumn("early", early)
    # counted by half of its bits: a chance agreement only lets a posting stay
    half = F.shiftright("shingle", 32).cast("int")
    shared = postings.groupBy(half.alias("half")).agg(F.count("*").alias("df"), F.max("early").alias("some")).where("df > 1 and some").select("half", "df")
    return written(postings.join(shared, half == F.col("half")).select("cls", "n", "pos", "shingle", "early", "df"), "ngram-postings")


def _pairs_of_few(postings: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, shared): all pairs that fit of classes that share a shingle which ``FEW`` classes hold at most: no
    more rows than there are postings."""
    few = postings.where(F.col("df") <= FEW).groupBy("shingle").agg(F.collect_list(F.struct("cls", "n", "pos")).alias("x"))
    at = lambda i: F.get("x", F.lit(i))
    each = [F.struct(at(i).alias("x"), at(j).alias("y")) for i in range(FEW) for j in range(i + 1, FEW)]
    met = few.where(F.size("x") > 1).select(F.explode(F.array(*each)).alias("p")).select("p.x", "p.y").where("y is not null").where(_fits("x", "y", num, den))
    return met.groupBy(F.greatest("x.cls", "y.cls").alias("a"), F.least("x.cls", "y.cls").alias("b")).agg(F.count("*").alias("shared"))


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("label", F.col("cls"))
    return postings.join(labels, postings["cls"] == labels["node"], "left").select(postings["*"], F.coalesce("label", "cls").alias("label"))


def _proposed(rows: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """(a, b, shared): classes and the pivots of their shingles, with the number of shingles that propose them."""
    order = F.struct((~F.col("early")).alias("late"), F.when(F.lit(turn == 0), F.col("pos")).otherwise(0).alias("at"), F.xxhash64("cls", F.lit(turn)).alias("h"), "cls", "n", "pos", "label")
    pivot = rows.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(order).alias("p")).where("lo <> hi").select("shingle", "p.cls", "p.n", "p.pos", "p.label")
    met = rows.alias("x").join(pivot.alias("y"), "shingle").where((F.col("x.label") != F.col("y.label")) & _fits("x", "y", num, den))
    return met.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(F.count("*").alias("shared"))


def _open(rows: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(all pairs (a, b) of classes of different labels that share a shingle and fit, the table they are read from)."""
    by_label = rows.groupBy("shingle", "label").agg(F.count("*").alias("c"))
    top = by_label.groupBy("shingle").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").select("shingle", F.col("top.label").alias("top"))
    rows = written(rows.join(top, "shingle"), "ngram-open")  # pairs inside the top label need no look
    shorter = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cls") < F.col("y.cls")))
    apart = (F.col("x.label") != F.col("y.label")) & shorter & _fits("x", "y", num, den)
    minor, major = F.col("label") != F.col("top"), F.col("label") == F.col("top")
    early = rows.where("early")
    one = early.where(minor).alias("x").join(rows.alias("y"), "shingle").where(apart)
    two = early.where(major).alias("x").join(rows.where(minor).alias("y"), "shingle").where(apart)
    ends = (F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))
    return one.select(*ends).unionByName(two.select(*ends)).distinct(), rows


def linked(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: id, hash (of the text), n_shingles, component_id (the smallest id reachable
    by links of Jaccard ``num / den`` or more between sets of ``k``-word shingles) and label (a number for
    each component, null without shingles)."""
    text, key = F.col(f"`{text}`"), F.col(f"`{key}`")
    docs = docs.select(key.cast("long").alias("id"), _hash(text).alias("hash"), text.cast("string").alias("text"))
    rows, whole = classes(docs, k, num, den)
    postings = shared_postings(whole, num, den)
    known = written(whole.drop("prefix", "odd"), "ngram-known")
    odd = written(whole.select("cls", "n", "odd").join(postings.select("cls").distinct(), "cls", "left_semi"), "ngram-parities")
    of_few = written(_near(_pairs_of_few(postings, num, den), odd, num, den), "ngram-few")
    every, postings = postings, written(postings.where(F.col("df") > FEW).drop("df"), "ngram-postings")
    dropped(whole, every)
    sets, labels, refused = _Sets(docs, known, k), None, []

    def joined(pairs: DataFrame) -> bool:
        """Verify (a, b); whether any links.  Labels and refused pairs are brought up to date."""
        nonlocal labels
        seen = written(_verified(pairs, sets, num, den), "ngram-seen")
        refused.append(written(seen.where("not links").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "ngram-refused"))
        links = seen.where("links").select("a", "b")
        if any_links := not links.isEmpty():
            every = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
            found = written(components(every), "ngram-labels")
            dropped(*([labels] if labels is not None else []))
            labels = found
        dropped(seen, pairs)
        return any_links

    def unseen(pairs: DataFrame) -> DataFrame:
        """``pairs`` as they are, without those that were refused."""
        if not refused:
            return pairs
        gone = reduce(DataFrame.unionByName, refused).select(F.col("a").alias("lo"), F.col("b").alias("hi"))
        return pairs.join(gone, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")

    def few() -> DataFrame:
        """The pairs of rare shingles that are not in one component yet."""
        rows = of_few
        for x in ("a", "b") if labels is not None else ():
            rows = rows.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")), x, "left")
        return unseen(rows if labels is None else rows.where("label_a is null or label_b is null or label_a <> label_b").select("a", "b", "shared"))

    for turn in range(PIVOT_ROUNDS):
        fit = _near(unseen(_proposed(_labelled(postings, labels), turn, num, den)), odd, num, den).unionByName(few())
        best = fit.groupBy("a").agg(F.max(F.struct("shared", F.xxhash64("b").alias("h"), "b")).alias("m")).select("a", "m.b")
        # two pivots may have chosen each other
        best = best.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min(F.struct("a", "b")).alias("m")).select("m.a", "m.b")
        best = written(best, "ngram-pairs")
        if best.isEmpty() or not joined(best):
            break
    pairs, rows_open = _open(_labelled(postings, labels), num, den)
    last = written(_near(unseen(pairs), odd, num, den).unionByName(few().select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ngram-pairs")
    dropped(rows_open)
    if not last.isEmpty():
        joined(last)
    dropped(postings, odd, of_few, *sets.made, *refused)

    named = known.select("k1", "k2", "n", "id", "cls")
    named = named.withColumn("label", F.col("cls")) if labels is None else named.join(labels, named["cls"] == labels["node"], "left").select("k1", "k2", "n", "id", F.coalesce("label", "cls").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.join(least, "label").select("k1", "k2", "n", "label", "component_id")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}") == F.col(f"c.{c}") for c in ("k1", "k2", "n")])
    return rows.alias("r").join(named.alias("c"), same, "left").select("r.id", "r.hash", F.col("r.n").alias("n_shingles"), F.coalesce("component_id", "r.id").alias("component_id"), "label")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (nulls last).

    Rows without shingles stay; rows equal in id and text stay once."""
    rows = written(linked(docs, text, key, k, num, den), "ngram-linked")
    first = rows.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("m")).select("m.id", "m.hash")
    its, mark, kept_id, kept_mark = free_names(docs.columns, 4)
    kept = first.unionByName(rows.where("label is null").select("id", "hash")).select(F.coalesce("id", F.lit(-(1 << 63))).alias(kept_id), F.col("hash").alias(kept_mark))
    keyed = docs.withColumns({its: F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))), mark: _hash(F.col(f"`{text}`"))})
    stay = (F.col(its) == F.col(kept_id)) & (F.col(mark) == F.col(kept_mark))
    return keyed.join(kept, stay, "left_semi").dropDuplicates([its, mark]).select(*[f"`{c}`" for c in docs.columns])


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Each document's component under 3-word shingles and Jaccard 0.9."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linked(docs, k=3, num=90, den=100).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
