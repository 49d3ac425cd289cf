"""Personal data: fixed patterns as seeds, then contexts that the seeds teach.

1. Every whole text is scanned for e-mail addresses, IP addresses, card numbers and phone numbers: the seeds.
2. A seed induces lexical patterns: the word before it, the two words before it, the word behind it, the words
   on both sides, and its form (leading digit, lengths of digit runs, marks) between neighbours that are words,
   numbers or the text's ends, on either side and on both.  Patterns that at least ``MIN_SEEDS`` different seeds
   share are looked up in all texts: each place where one meets a seed or a word that looks like an identifier
   (a digit or an at sign, five characters at least) is an edge between pattern and instance, and each place
   where it meets another word counts against the pattern.
3. Spark scores the graph ``ROUNDS`` times: a pattern's confidence is the summed score of its instances'
   places over all its places; an instance's score is the noisy-or of its patterns; seeds stay at 1.
4. Patterns of confidence ``MIN_CONFIDENCE`` or more give their unseen instances as spans of kind ``ctx``: such
   are numbers of a card's form that the fixed pattern loses as another number follows them.

Looking up takes one pass whatever the corpus induces: executors get a bitmap of ``2 ** MAP_BITS`` bits (2 MB),
and what passes it is joined with the patterns themselves.

Defined results: a null or empty text has no spans; its digest is that of the empty string.  Repeated rows
each get their spans; rows are told apart by id and text, so ids may be null or repeat.  Spans that start together
are listed in the order of the kinds, ``ctx`` last.  An empty table gives an empty table.  ``redact`` passes all
other columns through whatever their names.  Scanning is linear in the text, however long: no pattern is tried
at more places than one per run of its characters.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import vec
from corpusmill.llm.names import free_names
from corpusmill.llm.store import dropped, written

KINDS = ("email", "ip", "card", "phone")
CONTEXT = "ctx"
MIN_SEEDS, MIN_CONFIDENCE, ROUNDS, MAP_BITS = 3, 0.8, 3, 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed kinds, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)]
    # 1 to 3 digits after leading zeros are what can be 255 at most
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) < 4 and int(g.lstrip("0") or 0) < 256 for g in m.groups())]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, CONTEXT)[k]}:{a}:{b}" for a, k, b in spans)


_SEEN = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("row_hash", T.LongType()),
    *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()),
    T.StructField("base", T.StringType()), T.StructField("seeds", T.ArrayType(T.StructType([T.StructField("pattern", T.LongType()), T.StructField("instance", T.LongType())]))),
])
_EDGE = T.StructType([
    T.StructField("pattern", T.LongType()), T.StructField("instance", T.LongType()), T.StructField("seed", T.BooleanType()), T.StructField("row_id", T.LongType()),
    T.StructField("row_hash", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("places", T.LongType()),
])


def _hash_bytes(part: bytes) -> int:
    data = np.frombuffer(part, np.uint8)
    return int(vec.span_hashes(data, np.zeros(1, np.int64), np.array([len(data)]))[0].view(np.int64))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")
#: Odd multipliers that tell the kinds of patterns, and their words' places, apart.
_BEFORE, _TWO, _TWO_FAR, _BEHIND, _LEFT, _RIGHT = (np.uint64(0x9E3779B97F4A7C15 + 0x1B873593CC9E2D51 * 2 * i & (1 << 64) - 1 | 1) for i in range(6))


class Words:
    """A text's words: their places in code points, and the hashes of what they are with A-Z lower-cased."""

    def __init__(self, text: str, keys: np.ndarray | None = None):
        self.text = text
        self.at = [m.span() for m in _WORD.finditer(text)]
        self.starts = [a for a, _ in self.at]
        if keys is None:
            data = vec.LOWER[np.frombuffer(text.encode(), np.uint8)]
            keys = vec.span_hashes(data, *vec.word_spans(data, np.zeros(0, np.int64)))
        self.keys = keys

    def over(self, a: int, b: int) -> tuple[int, int]:
        """The first and the last word that the span (a, b) touches."""
        return max(0, bisect_right(self.starts, a) - 1), max(0, bisect_left(self.starts, b) - 1)

    def _side(self, i: int) -> str:
        if not 0 <= i < len(self.at):
            return "|"
        word = self.text[slice(*self.at[i])]
        return "w" if any(c.isalpha() for c in word) else "n" if any(c.isdigit() for c in word) else "-"

    def patterns(self, a: int, b: int) -> list[int]:
        """The hashes of the patterns that the entity at (a, b) stands in, as signed numbers."""
        i, j = self.over(a, b)
        before, behind, k = i > 0, j + 1 < len(self.at), self.keys
        found = []
        with np.errstate(over="ignore"):
            if before:
                found.append(k[i - 1] * _BEFORE)
            if i > 1:
                found.append(k[i - 2] * _TWO_FAR + k[i - 1] * _TWO)
            if behind:
                found.append(k[j + 1] * _BEHIND)
            if before and behind:
                found.append(k[i - 1] * _LEFT + k[j + 1] * _RIGHT)
        entity = self.text[a:b]
        form = entity[0] * entity[0].isdigit() + _RUN.sub(lambda m: f"9{len(m[0])}" if m[0][0].isdigit() else "a", entity)
        left, right = self._side(i - 1), self._side(j + 1)
        forms = (f"{left}\n{form}\n", f"\n{form}\n{right}", f"{left}\n{form}\n{right}")
        return [int(h.view(np.int64)) for h in found] + [_hash_bytes(f.encode()) for f in forms]


def _patterns_of_words(keys: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, hash of the pattern each stands in), by kind of pattern."""
    near, far = np.flatnonzero(row[1:] == row[:-1]) + 1, np.flatnonzero(row[2:] == row[:-2]) + 2
    between = near[:-1][(near[1:] == near[:-1] + 1)] if len(near) else near
    with np.errstate(over="ignore"):
        yield near, keys[near - 1] * _BEFORE
        yield far, keys[far - 2] * _TWO_FAR + keys[far - 1] * _TWO
        yield near - 1, keys[near] * _BEHIND
        yield between, keys[between - 1] * _LEFT + keys[between + 1] * _RIGHT


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {f.name: [] for f in _SEEN}
        for doc, mark, text in zip(batch.column("row_id"), batch.column("row_hash"), batch.column("text"), strict=True):
            text = text.as_py() or ""
            spans = base_spans(text)
            count = Counter(k for _, k, _ in spans)
            joined = listed(spans)
            words = Words(text) if spans else None
            seeds = [{"pattern": p, "instance": _instance(text[a:b])} for a, _, b in spans for p in words.patterns(a, b)]
            for name, value in zip(rows, (doc.as_py(), mark.as_py(), *(count[k] for k in range(4)), hashlib.sha256(joined.encode()).hexdigest(), joined, seeds), strict=True):
                rows[name].append(value)
        seed_type = pa.list_(pa.struct([("pattern", pa.int64()), ("instance", pa.int64())]))
        kinds = [pa.int64()] * 6 + [pa.string(), pa.string(), seed_type]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))


def _instance(entity: str) -> int:
    return _hash_bytes(entity.lower().encode())


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s] in "([<\"'":
        s += 1
    while e > s and text[e - 1] in ".,;:!?)]>\"'":
        e -= 1
    return s, e


def _entities(words: Words) -> tuple[list[tuple[int, int, bool]], set[int]]:
    """((start, end, whether it is a seed) of seeds and words like identifiers; the words these cover)."""
    spans = base_spans(words.text)
    found, covered = [], set()
    for a, _, b in spans:
        found.append((a, b, True))
        i, j = words.over(a, b)
        covered.update(range(i, j + 1))
    for i, (s, e) in enumerate(words.at):
        if i in covered or e - s < 5:
            continue
        s, e = _trimmed(words.text, s, e)
        if e - s >= 5 and any(c in "@0123456789" for c in words.text[s:e]):
            found.append((s, e, False))
            covered.add(i)
    return found, covered


def _edges(bitmap: bytes):
    """Places of patterns that the bitmap may hold: with the instance there, or how often without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little").view(bool)
        shift = np.uint64(64 - MAP_BITS)
        digit = np.zeros(256, bool)
        digit[[64, *range(48, 58)]] = True
        for batch in batches:
            out: list[tuple] = []
            others: Counter = Counter()
            offsets, data = vec.text_buffers(batch.column("text"))
            for a, b in vec.pieces(offsets):
                part, docs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends = vec.word_spans(part, docs[:-1])
                keys = vec.span_hashes(vec.LOWER[part], starts, ends)
                row, first = np.searchsorted(docs, starts, "right") - 1, np.searchsorted(starts, docs)
                taken = np.zeros(len(starts), bool)
                marks = np.concatenate([[0], np.cumsum(digit[part])])
                for k in np.flatnonzero(marks[docs[1:]] > marks[docs[:-1]]).tolist():
                    words = Words(part[docs[k] : docs[k + 1]].tobytes().decode(), keys[first[k] : first[k + 1]])
                    found, covered = _entities(words)
                    taken[[first[k] + i for i in covered]] = True
                    for s, e, seed in found:
                        mine = np.array(words.patterns(s, e), np.int64)
                        held = mine[maybe[(mine.view(np.uint64) >> shift).astype(np.int64)]].tolist()
                        one = _instance(words.text[s:e]) if held else 0
                        out += [(p, one, seed, batch.column("row_id")[a + k].as_py(), batch.column("row_hash")[a + k].as_py(), s, e, 1) for p in held]
                for at, hashes in _patterns_of_words(keys, row):
                    hit = hashes[maybe[(hashes >> shift).astype(np.int64)] & ~taken[at]]
                    values, times = np.unique(hit.view(np.int64), return_counts=True)
                    others.update(dict(zip(values.tolist(), times.tolist(), strict=True)))
            out += [(k, None, False, None, None, None, None, n) for k, n in others.items()]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=_EDGE.names)

    return run


def _bitmap(patterns: DataFrame) -> bytes:
    """A bit for the leading ``MAP_BITS`` bits of each pattern; at most 2 MB, whatever their number."""
    place = F.shiftrightunsigned("pattern", 64 - MAP_BITS)
    rows = patterns.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(pattern, {64 - MAP_BITS}) & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << MAP_BITS - 6, np.int64)
    words[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return words.tobytes()


def discovered(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """(row_id, row_hash, start, end) of the unseen identifiers that high-confidence patterns point at."""
    spark = rows.sparkSession
    seeds = seen.select(F.explode("seeds").alias("s")).select("s.pattern", "s.instance").distinct()
    induced = written(seeds.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SEEDS).select("pattern"), "pii-patterns")
    if induced.isEmpty():
        return spark.createDataFrame([], "row_id long, row_hash long, start long, end long")
    # the bitmap lets some others through
    places = written(rows.mapInArrow(_edges(_bitmap(induced)), _EDGE).join(induced, "pattern", "left_semi"), "pii-edges")
    # the graph: places summed for each pattern and instance; places without an instance only weigh
    graph = written(places.groupBy("pattern", "instance").agg(F.sum("places").alias("places"), F.max("seed").alias("seed")), "pii-graph")
    weight = graph.groupBy("pattern").agg(F.sum("places").alias("all_places"))
    edges = graph.where("instance is not null").join(weight, "pattern")
    edges = edges.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(0.0))
    for _ in range(ROUNDS):
        trust = edges.groupBy("pattern").agg((F.sum(F.col("score") * F.col("places")) / F.first("all_places")).alias("trust"))
        edges = edges.join(trust, "pattern")
        doubt = edges.groupBy("instance").agg(F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("trust"))))).alias("doubt"), F.max("seed").alias("known"))
        edges = written(edges.select("pattern", "instance", "places", "seed", "all_places").join(doubt, "instance").withColumn("score", F.when(F.col("known"), 1.0).otherwise(1 - F.col("doubt"))).drop("doubt", "known"), "pii-graph")
    trusted = edges.groupBy("pattern").agg((F.sum(F.col("score") * F.col("places")) / F.first("all_places")).alias("trust")).where(F.col("trust") >= MIN_CONFIDENCE).select("pattern")
    found = written(places.where("instance is not null and not seed").join(trusted, "pattern", "left_semi").select("row_id", "row_hash", "start", "end").distinct(), "pii-found")
    dropped(places, graph, edges, induced)
    return found


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: row_id (its ``key``), row_hash, the counts and digest of the base spans,
    and ``spans`` (array of structs start, kind, end: all spans, sorted)."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("row_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.length(F.col(f"`{text}`"))).alias("row_hash"), F.col(f"`{text}`").cast("string").alias("text"))
    seen = written(rows.mapInArrow(_scan, _SEEN), "pii-seen")
    more = discovered(rows, seen).groupBy("row_id", "row_hash").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), F.col("end"))).alias("more"))
    joined = seen.alias("s").join(more.alias("m"), F.col("s.row_id").eqNullSafe(F.col("m.row_id")) & (F.col("s.row_hash") == F.col("m.row_hash")), "left")
    part = lambda x, i: F.split(x, ":").getItem(i)
    base = F.when(F.col("s.base") == "", F.array().cast("array<struct<start:long,rank:int,end:long>>")).otherwise(F.transform(F.split("s.base", ","), lambda x: F.struct(part(x, 1).cast("long").alias("start"), (F.array_position(F.lit(list(KINDS)), part(x, 0)) - 1).cast("int").alias("rank"), part(x, 2).cast("long").alias("end"))))
    every = F.array_sort(F.concat(base, F.coalesce(F.col("m.more"), F.array().cast("array<struct<start:long,rank:int,end:long>>"))))
    names = F.lit([*KINDS, CONTEXT])
    return joined.select("s.row_id", "s.row_hash", *[f"s.n_{k}" for k in KINDS], "s.base_sha256", F.transform(every, lambda x: F.struct(x["start"].alias("start"), F.element_at(names, x["rank"] + 1).alias("kind"), x["end"].alias("end"))).alias("spans"))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; spans that touch or overlap
    become one.  Other columns stay; a null text stays null."""
    its, mark, found_id, found_mark, spans = free_names(docs.columns, 5)
    found = find(docs, text, key).where(F.size("spans") > 0).select(F.col("row_id").alias(found_id), F.col("row_hash").alias(found_mark), F.col("spans").alias(spans)).dropDuplicates([found_id, found_mark])
    keyed = docs.withColumns({its: F.col(f"`{key}`").cast("long"), mark: F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.length(F.col(f"`{text}`")))})
    joined = keyed.join(found, F.col(its).eqNullSafe(F.col(found_id)) & (F.col(mark) == F.col(found_mark)), "left")
    # from left to right: (pieces so far, place up to which the text is used)
    state = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    source = F.col(f"`{text}`")
    step = lambda s, x: F.struct(
        F.when(x["start"] < s["at"], s["done"]).otherwise(F.concat(s["done"], F.substring(source, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]"))).alias("done"),
        F.greatest(s["at"], x["end"]).alias("at"),
    )
    folded = F.aggregate(spans, state, step, lambda s: F.concat(s["done"], F.substring(source, (s["at"] + 1).cast("int"), F.length(source))))
    return joined.withColumn(text, F.when(F.col(spans).isNull(), source).otherwise(folded)).select(*[f"`{c}`" for c in docs.columns])


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Each document's personal data."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(F.col("row_id").alias("doc_id"), *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"))
