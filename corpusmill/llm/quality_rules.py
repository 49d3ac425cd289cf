"""Quality rules, line first.

Every line is judged alone by three rules; lines that fail are removed, and a document that loses too much
of its text is rejected.  The document measures of the base rules (repeated
windows, repeated lines, symbols) are taken from the same pass.

Line rules (each can be set off by its threshold):

* punctuation - more than ``max_marks`` punctuation marks per word (``min_marks`` at least), the mark of
  shouting and of symbol noise;
* navigation - separators such as ``|`` in at least a quarter as many places as words, or a line of fewer
  than ``min_line_words`` words without closing punctuation;
* boilerplate - a line of at most ``max_boiler_words`` words that ``learnt`` has found in unrelated documents,
  or one in which at least half of the words repeat the word before them.

Boilerplate is learnt from all documents: a line's hash (A-Z lower-cased, white space at its ends left out) goes
with the signature of its document, the least hash of its words, which copies and nearly all near copies share.
Lines that come with ``LEAST_SOURCES`` signatures or more, with one in ``SHARE`` of all documents, and with at least one in
``SPREAD`` as many signatures as documents are boilerplate.  So a group of copies, of any size, teaches nothing, and no
more than ``SHARE`` times the lines of an average document can be learnt, which bounds what is sent to executors
whatever the corpus.

Defined results: a null or empty text has no words, all counts 0, and is not kept.  Repeated rows are judged
one by one, and count as copies when boilerplate is learnt.  Lines are cut at ``\\n`` alone; a line without a word counts
nowhere.  A text at a threshold passes (only more than ``max_lost`` rejects).  An empty table teaches nothing and gives
an empty table.  Columns of the names of ``MEASURES`` are replaced, all others pass through.  Texts of any length are
used whole; memory follows the longest, at about 60 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import vec

LEAST_SOURCES, SHARE, SPREAD = 8, 10_000, 5
MAX_BOILER_WORDS = 40
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30

MEASURES = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_lines", T.LongType()), T.StructField("n_bad_lines", T.LongType()),
    T.StructField("lost_chars", T.LongType()), T.StructField("kept", T.BooleanType()),
])


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_MARK = _table(b"!#$%&*+/<=>?@\\^_`{|}~\"()[],.;:")
_BAR = _table(b"|>")
_CLOSING = _table(b".!?:;\"')]}")
_CLOSING_WIDE = {"…".encode(), "”".encode(), "。".encode(), "！".encode(), "？".encode()}


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window found twice or more in this document."""
    if len(words) <= window:
        return 0
    runs = vec.shingles(words, window)
    _, place, count = np.unique(runs, return_inverse=True, return_counts=True)
    again = count[place] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(again)] += again
    edge[window : window + len(again)] -= again
    return int((np.cumsum(edge) > 0).sum())


def _lines(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of documents, and their documents.

    A line starts at a document's start and after each line feed; an empty document has one empty line."""
    starts = np.sort(np.concatenate([docs[:-1], np.flatnonzero(data == 10) + 1]))
    past = np.append(starts[1:], len(data))
    ends = np.where((past > starts) & (data[np.maximum(past - 1, 0)] == 10) if len(data) else False, past - 1, past)
    return starts, ends, np.searchsorted(docs, starts, "right") - 1


class LineRules:
    """The thresholds, and the hashes of learnt lines (sorted); ``judge`` gives the measures of a column of texts
    and, if asked, the cleaned texts."""

    def __init__(self, boilerplate: np.ndarray | None = None, max_marks: float = 0.7, min_marks: int = 5, min_line_words: int = 3, max_boiler_words: int = MAX_BOILER_WORDS, max_lost: float = 0.5):
        self.max_marks, self.min_marks, self.min_line_words = max_marks, min_marks, min_line_words
        self.max_boiler_words, self.max_lost = max_boiler_words, max_lost
        self.boilerplate = np.zeros(0, np.uint64) if boilerplate is None else boilerplate

    def judge(self, column: pa.Array, with_text: bool = False) -> tuple[dict[str, list], list[str]]:
        offsets, data = vec.text_buffers(column)
        out: dict[str, list] = {f.name: [] for f in MEASURES}
        texts: list[str] = []
        for a, b in vec.pieces(offsets):
            self._piece(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], out, texts if with_text else None)
        return out, texts

    def _piece(self, data: np.ndarray, docs: np.ndarray, out: dict[str, list], texts: list[str] | None) -> None:
        n = len(docs) - 1
        line_starts, line_ends, line_of_doc = _lines(data, docs)
        starts, ends = vec.word_spans(data, docs[:-1])
        hashes = vec.span_hashes(data, starts, ends)
        solid = _sums(~vec.SPACE[data] & ((data & 0xC0) != 0x80))
        symbol, mark, bar = _sums(_SYMBOL[data]), _sums(_MARK[data]), _sums(_BAR[data])
        first_word, past_word = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
        words = past_word - first_word
        marks, bars = mark[line_ends] - mark[line_starts], bar[line_ends] - bar[line_starts]
        chars = solid[line_ends] - solid[line_starts]
        full = words > 0
        closed = np.zeros(len(words), bool)
        if full.any():
            last = ends[past_word[full] - 1]
            closed[full] = _CLOSING[data[last - 1]]
            for k in np.flatnonzero(full & ~closed):
                e = ends[past_word[k] - 1]
                closed[k] = data[e - 1] > 127 and (data[max(0, e - 3) : e].tobytes() in _CLOSING_WIDE or data[max(0, e - 2) : e].tobytes() == b"\xc2\xbb")
        bad = (marks > self.max_marks * words) & (marks >= self.min_marks)
        bad |= (bars >= 2) & (4 * bars >= words)
        bad |= ~closed & (words < self.min_line_words)
        if len(self.boilerplate):
            short = np.flatnonzero(full & (words <= self.max_boiler_words))
            keys = vec.span_hashes(vec.LOWER[data], starts[first_word[short]], ends[past_word[short] - 1])
            at = np.minimum(np.searchsorted(self.boilerplate, keys), len(self.boilerplate) - 1)
            bad[short] |= self.boilerplate[at] == keys
        stutter = np.zeros(len(hashes), bool)
        stutter[1:] = hashes[1:] == hashes[:-1]
        again = _sums(stutter)
        bad |= (words >= 2 * WINDOW) & (2 * (again[past_word] - again[first_word]) >= words)
        bad &= full
        line_hash = vec.span_hashes(data, line_starts, line_ends)
        doc_word = np.searchsorted(starts, docs)
        by_doc = lambda x: np.bincount(line_of_doc, x, n).astype(np.int64)
        lost, n_bad, n_lines = by_doc(chars * bad), by_doc(bad), by_doc(full)
        doc_line = np.searchsorted(line_of_doc, np.arange(n + 1))
        for k in range(n):
            mine = hashes[doc_word[k] : doc_word[k + 1]]
            lines = slice(doc_line[k], doc_line[k + 1])
            seen = line_hash[lines][full[lines]]
            repeats = repeated_words(mine)
            total = int(solid[docs[k + 1]] - solid[docs[k]])
            failed = len(mine) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(mine)
            row = (len(mine), total, int(symbol[docs[k + 1]] - symbol[docs[k]]), len(seen) - len(np.unique(seen)), repeats, failed, int(n_lines[k]), int(n_bad[k]), int(lost[k]), bool(not failed and lost[k] <= self.max_lost * total))
            for name, value in zip(out, row, strict=True):
                out[name].append(bool(value) if isinstance(value, np.bool_) else value)
            if texts is not None:
                failing = set(line_starts[lines][bad[lines]].tolist())
                good, at = [], int(docs[k])
                for line in data[docs[k] : docs[k + 1]].tobytes().split(b"\n"):
                    if not line or at not in failing:  # an empty line can stand where the next text starts
                        good.append(line)
                    at += len(line) + 1
                texts.append(b"\n".join(good).decode())


def _line_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, source, n): hashes of the short lines with the signatures of their documents; n documents hold both."""
    for batch in batches:
        offsets, data = vec.text_buffers(batch.column("text"))
        for a, b in vec.pieces(offsets):
            part, docs = vec.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            line_starts, line_ends, doc = _lines(part, docs)
            starts, ends = vec.word_spans(part, docs[:-1])
            keys = vec.span_hashes(part, starts, ends)
            first, past = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
            short = np.flatnonzero((past > first) & (past - first <= MAX_BOILER_WORDS))
            words_of = np.searchsorted(starts, docs)
            source = np.zeros(b - a, np.uint64)
            some = np.flatnonzero(np.diff(words_of))
            if len(some):
                source[some] = np.minimum.reduceat(vec.mix(keys ^ np.uint64(0x5851F42D4C957F2D)), words_of[some])
            line = vec.span_hashes(part, starts[first[short]], ends[past[short] - 1])
            far = np.uint64(0xC2B2AE3D27D4EB4F)
            _, once = np.unique(vec.mix(line + doc[short].astype(np.uint64) * far), return_index=True)  # once a document
            line, its = line[once], source[doc[short][once]]
            _, first_of, n = np.unique(vec.mix(line + its * far), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(line[first_of].view(np.int64)), pa.array(its[first_of].view(np.int64)), pa.array(n, pa.int64())], names=["line", "source", "n"])


def learnt(docs: DataFrame, text: str = "text", least: int = LEAST_SOURCES, share: int = SHARE, spread: int = SPREAD) -> np.ndarray:
    """The sorted hashes of the lines that unrelated documents of ``docs`` share."""
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    total = texts.count()
    pairs = texts.mapInArrow(_line_sources, "line long, source long, n long").groupBy("line", "source").agg(F.sum("n").alias("n"))
    lines = pairs.groupBy("line").agg(F.count("*").alias("sources"), F.sum("n").alias("n"))
    found = lines.where((F.col("sources") >= max(least, -(-total // share))) & (F.col("sources") * spread >= F.col("n"))).select("line").toArrow()
    return np.sort(found["line"].to_numpy().view(np.uint64))


def measure(docs: DataFrame, text: str = "text", rules: LineRules | None = None, cleaned: str | None = None) -> DataFrame:
    """``docs`` with the columns of ``MEASURES`` (and, if named, the text without its failing lines).

    Columns of ``docs`` that have the name of a measure are replaced.
    """
    rules, added = rules or LineRules(), [*MEASURES.fields, *([T.StructField(cleaned, T.StringType())] if cleaned else [])]
    names = {f.name for f in added}
    kept = [f for f in docs.schema.fields if f.name not in names or f.name == text]
    need = docs.select(*[f"`{f.name}`" for f in kept])
    passed = [f for f in kept if f.name not in names]
    schema = T.StructType([*passed, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, texts = rules.judge(batch.column(text), cleaned is not None)
            arrays = [batch.column(f.name) for f in passed] + [pa.array(got[f.name], pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64()) for f in MEASURES]
            arrays += [pa.array(texts, pa.string())] * (cleaned is not None)
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return need.mapInArrow(run, schema)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Each document's measures and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = measure(docs, rules=LineRules(learnt(docs)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "lost_chars")
