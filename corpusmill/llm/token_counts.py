"""Token counts at every prefix, by dynamic programming.

``PrefixCounts`` holds, for one text, the exact number of tokens of the text cut at the end of each piece
(a run without ASCII white space; the tokenizer never joins anything over white space, so
``count[k] = count[k-1] + tokens(piece k)``).  Inside a piece a second table gives the count at every prefix
of a pre-token: the encoding of ``w[:i]`` ends in a token ``t = w[j:i]`` that stays apart from the last token
of the encoding of ``w[:j]``; exactly one ``t`` does, so ``count[i] = count[j] + 1``.  The word-end mark of
the vocabulary only changes which last token is allowed.  Budget and truncation questions are look-ups.

Defined results: a null or empty text has 0 bytes and 0 tokens.  Repeated rows are counted one by one.  A text with
exactly as many tokens as the limit is not over it.  Texts of any length are counted whole, an empty table gives an
empty table.  Columns of the names of ``COUNTS`` are replaced, all others pass through.  Memory follows the distinct pieces of about 1 MB of text and the longest single piece.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.llm import vec

LIMIT = 2048
#: Distinct pieces whose counts a worker keeps.
CACHE = 1_000_000

COUNTS = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("over_limit", T.BooleanType()), T.StructField("fit_chars", T.LongType()),
])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The public byte-to-letter table of byte-level BPE: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _latin_splitter(spec: dict):
    """The split of this kind of file (lower case, a pattern's matches, bytes as letters), else None."""
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in splits] != ["Split", "ByteLevel"]:
        return None
    first, second = splits
    if not first["invert"] or first["behavior"] != "Removed" or second["add_prefix_space"] or second["use_regex"] or any(not t["content"].startswith("<|") for t in spec["added_tokens"]):
        return None
    return regex.compile(first["pattern"]["Regex"]).findall


class WordTokens:
    """A tokenizer file's counts: of whole pieces by the library, of prefixes by the table."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path))
        self.splits, self.latin = _latin_splitter(spec), re.compile("[!-~\u00a1-\u024f]+").fullmatch
        spec = spec["model"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["merges"])
        self.rank = {tuple(m): i for i, m in enumerate(pairs)}
        self.vocabulary = spec["vocab"]
        self.end = spec.get("end_of_word_suffix") or ""
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocabulary)
        self.letters = _byte_letters()
        self._apart: dict[tuple[str, str], bool] = {}
        self.cache: dict[int, int] = {}

    def count_pieces(self, pieces: list[str]) -> list[int]:
        """Tokens of pieces without white space.

        Latin pieces are split here by the tokenizer's own pattern and only their pre-tokens go to its model;
        the library takes the others whole."""
        if not self.splits:
            return self.count(pieces)
        known: dict[str, int] = {}
        out, rest = [], []
        model, letters = self.library.model, self.letters
        for i, piece in enumerate(pieces):
            if not self.latin(piece) or "<|" in piece:
                rest.append(i)
                out.append(0)
                continue
            n = 0
            for w in self.splits(piece.lower()):
                if (c := known.get(w)) is None:
                    c = known[w] = len(model.tokenize("".join([letters[b] for b in w.encode()])))
                n += c
            out.append(n)
        for i, c in zip(rest, self.count([pieces[i] for i in rest]), strict=True):
            out[i] = c
        return out

    def count(self, texts: list[str]) -> list[int]:
        batch = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        out: list[int] = []
        for i in range(0, len(texts), 4096):
            out += [len(e) for e in batch(texts[i : i + 4096], add_special_tokens=False)]
        return out

    def _merge(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            pair, out, i = (parts[best], parts[best + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            bare = token[: -len(self.end)]
            return [*bare[:-1], bare[-1] + self.end] if bare else []
        return [*token]

    def apart(self, a: str, b: str) -> bool:
        """Whether two tokens side by side encode to themselves."""
        if (known := self._apart.get((a, b))) is None:
            if len(self._apart) > 200_000:
                self._apart.clear()
            known = self._apart[a, b] = self._merge(self._symbols(a) + self._symbols(b)) == [a, b]
        return known

    def whole(self, token: str) -> bool:
        return token in self.vocabulary and self._merge(self._symbols(token)) == [token]

    def pretoken_prefixes(self, word: str) -> list[int]:
        """Tokens of ``word[:i]`` for i from 0 to its length; ``word`` is one normalised pre-token."""
        cuts, symbols = [0], ""
        for c in word:
            symbols += "".join(self.letters[b] for b in c.encode())
            cuts.append(len(symbols))
        last, count = [""], [0]  # of the encoding of symbols[:i] as the inside of a word
        for i in range(1, len(symbols) + 1):
            for j in range(max(0, i - self.longest), i):
                t = symbols[j:i]
                if t in self.vocabulary and last[j] is not None and (self.apart(last[j], t) if j else self.whole(t)):
                    last.append(t)
                    count.append(count[j] + 1)
                    break
            else:
                last.append(None)
                count.append(0)
        if not self.end:
            return [count[c] for c in cuts]
        ended = [0]
        for i in cuts[1:]:
            for j in range(max(0, i - self.longest), i):
                t = symbols[j:i] + self.end
                if t in self.vocabulary and last[j] is not None and (self.apart(last[j], t) if j else self.whole(t)):
                    ended.append(count[j] + 1)
                    break
            else:
                ended.append(len(self._merge(self._symbols(symbols[:i] + self.end))))
        return ended

    def piece_fit(self, piece: str, budget: int) -> int:
        """Code points of the longest proper prefix of a piece with at most ``budget`` tokens."""
        plain = self.library.normalizer.normalize_str(piece) if self.library.normalizer else piece
        special = any(t.content in piece for t in self.library.get_added_tokens_decoder().values())
        if len(plain) != len(piece) or special or not self.library.pre_tokenizer:
            n = len(piece) - 1
            while n and self.count([piece[:n]])[0] > budget:
                n -= 1
            return n
        best = used = 0
        for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain):
            if plain[a] == "'" and b - a > 1:  # cut inside, a contraction is a mark and letters
                inside = [0, *self.count([plain[a:e] for e in range(a + 1, b)]), self.count([plain[a:b]])[0]]
            else:
                inside = self.pretoken_prefixes(plain[a:b])
            best = max([best, *(a + i for i, c in enumerate(inside) if used + c <= budget)])
            used += inside[-1]
            if used > budget:
                break
        return min(best, len(piece) - 1)


class PrefixCounts:
    """One text's table: ``ends`` (byte offsets of the ends of its pieces) and ``counts`` (tokens up to there)."""

    def __init__(self, tokens: WordTokens, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, each: np.ndarray):
        self.tokens, self.data, self.starts, self.ends = tokens, data, starts, ends
        self.counts = np.cumsum(each)

    @classmethod
    def of(cls, tokens: WordTokens, text: str) -> PrefixCounts:
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends = vec.word_spans(data, np.zeros(0, np.int64))
        each = tokens.count([data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)])
        return cls(tokens, data, starts, ends, np.array(each, np.int64))

    @property
    def total(self) -> int:
        return int(self.counts[-1]) if len(self.counts) else 0

    def fit(self, budget: int) -> int:
        """Code points of the longest prefix of the text with at most ``budget`` tokens."""
        k = int(np.searchsorted(self.counts, budget, "right"))
        if k == len(self.counts):
            return int(((self.data & 0xC0) != 0x80).sum())
        piece = self.data[self.starts[k] : self.ends[k]].tobytes().decode()
        left = budget - (int(self.counts[k - 1]) if k else 0)
        return int(((self.data[: self.starts[k]] & 0xC0) != 0x80).sum()) + self.tokens.piece_fit(piece, left)

    def between(self, first: int, past: int) -> int:
        """Tokens of the pieces from ``first`` to before ``past``."""
        at = lambda k: int(self.counts[k - 1]) if k else 0
        return at(past) - at(first)


@lru_cache(2)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def _piece_counts(tokens: WordTokens, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    keys, first, place = np.unique(vec.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    cache, known = tokens.cache, keys.tolist()
    new = [i for i, k in enumerate(known) if k not in cache]
    if len(cache) + len(new) > CACHE:
        cache.clear()
        new = list(range(len(known)))
    raw = data.tobytes()
    at = first[new]
    words = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    found = dict(zip([known[i] for i in new], tokens.count_pieces(words), strict=True))
    if len(found) < CACHE:
        cache.update(found)
        found = cache
    return np.array([found[k] for k in known], np.int64)[place.reshape(-1)] if known else np.zeros(0, np.int64)


def count_column(column: pa.Array, path: str, limit: int = LIMIT) -> dict[str, list]:
    tokens, (offsets, data) = _tokens(path), vec.text_buffers(column)
    out: dict[str, list] = {f.name: [] for f in COUNTS}
    for a, b in vec.pieces(offsets):
        part, docs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends = vec.word_spans(part, docs[:-1])
        each, words = _piece_counts(tokens, part, starts, ends), np.searchsorted(starts, docs)
        for k in range(b - a):
            s, w = docs[k], slice(words[k], words[k + 1])
            table = PrefixCounts(tokens, part[s : docs[k + 1]], starts[w] - s, ends[w] - s, each[w])
            for name, value in zip(out, (int(docs[k + 1] - s), table.total, table.total > limit, table.fit(limit)), strict=True):
                out[name].append(value)
    return out


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``docs`` with the columns of ``COUNTS``: bytes, tokens, whether over ``limit``, and the code points of
    the longest prefix within it.  Columns of those names are replaced."""
    path = path or default_path()
    names = {f.name for f in COUNTS}
    passed = [f for f in docs.schema.fields if f.name not in names]
    need = docs.select(*[f"`{f.name}`" for f in docs.schema.fields if f.name not in names or f.name == text])
    schema = T.StructType([*passed, *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = count_column(batch.column(text), path, limit)
            arrays = [batch.column(f.name) for f in passed] + [pa.array(got[f.name], pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64()) for f in COUNTS]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return need.mapInArrow(run, schema)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Each document's bytes and tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")
