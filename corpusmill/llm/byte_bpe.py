"""Byte-level BPE encoding and decoding by tree reduction.

A text is halved until its parts are short, the parts are encoded, and neighbours are joined on the way up.
Joining is associative (the parts form a monoid whose unit is the empty text): around the boundary a window
is encoded again and grows until both of its edges stand at places where the split pattern ends a match
whatever stands further off; tokens outside the window then keep their places, so they are spliced unchanged.

Such a place is one between a character that is not white space and a single space that is followed by
another that is not: no alternative of the pattern has a space anywhere but in front, a run of one space is
never taken by the white-space alternatives when something follows it, and what stands behind the place is
not looked at.  Where a text has no such place, the window grows to its ends.

Decoding concatenates the tokens' bytes up the same tree.  Defined results: a null or empty text has no
tokens.  Ids outside the vocabulary raise.  Texts of any length go through the same tree; memory follows the
longest (4 bytes a token).  Repeated rows are encoded one by one, an empty table gives an empty table; columns
of the names that are added are replaced, all others pass through.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters of a leaf of the tree, and ids of one when decoding.
LEAF = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class TreeCodec:
    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.leaf = tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = [0] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.decimal = [str(i) for i in range(len(self.sizes))]

    # ---- encoding
    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        # lone surrogates can't occur: Spark's strings are UTF-8
        return self._encode(text, 0, len(text), leaf)

    def _encode(self, text: str, a: int, b: int, leaf: int) -> list[int]:
        if b - a <= leaf:
            return self.leaf.encode_ordinary(text[a:b])
        m = (a + b) // 2
        return self._join(text, a, m, b, self._encode(text, a, m, leaf), self._encode(text, m, b, leaf))

    @staticmethod
    def stable(text: str, i: int) -> bool:
        return 0 < i < len(text) - 1 and text[i] == " " and not text[i - 1].isspace() and not text[i + 1].isspace()

    def _join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        lo = hi = m
        while lo > a and not (lo < m - 1 and self.stable(text, lo)):  # both neighbours were seen by the left part
            lo -= 1
        # the left part saw all up to m; the right part saw all from m
        while hi < b and not (hi > m and hi < b - 1 and self.stable(text, hi)):
            hi += 1
        middle = self.leaf.encode_ordinary(text[lo:hi])
        past, first = self._before(left, len(text[lo:m].encode())), self._after(right, len(text[m:hi].encode()))
        del left[past:]
        left += middle
        left += right[first:]
        return left

    def _before(self, ids: list[int], n_bytes: int) -> int:
        """How many of ``ids`` are left without the last tokens that make up exactly ``n_bytes``."""
        k, left = len(ids), n_bytes
        while left > 0:
            k -= 1
            left -= self.sizes[ids[k]]
        assert left == 0, "a window's edge is inside a token"
        return k

    def _after(self, ids: list[int], n_bytes: int) -> int:
        """How many of ``ids`` make up exactly the first ``n_bytes``."""
        k, left = 0, n_bytes
        while left > 0:
            left -= self.sizes[ids[k]]
            k += 1
        assert left == 0, "a window's edge is inside a token"
        return k

    # ---- decoding
    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        parts = [self.leaf.decode_bytes(ids[i : i + leaf]) for i in range(0, len(ids), leaf)] or [b""]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0]


@lru_cache(2)
def codec(path: str) -> TreeCodec:
    return TreeCodec(path)


def _mapped(docs: DataFrame, text: str, added: list[T.StructField], rows) -> DataFrame:
    """``docs`` with ``added`` in place of columns of the same names; ``rows(column)`` gives their values."""
    names = {f.name for f in added}
    passed = [f for f in docs.schema.fields if f.name not in names]
    need = docs.select(*[f"`{f.name}`" for f in docs.schema.fields if f.name not in names or f.name == text])
    schema, kinds = T.StructType([*passed, *added]), {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.ArrayType(T.IntegerType()): pa.list_(pa.int32()), T.BooleanType(): pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):  # ids of few documents at a time
                part = batch.slice(at, 512)
                got = rows(part.column(text))
                arrays = [part.column(f.name) for f in passed] + [pa.array([r[k] for r in got], kinds[f.dataType]) for k, f in enumerate(added)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return need.mapInArrow(run, schema)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` in column ``ids``."""
    path = path or default_path()

    def rows(column: pa.Array) -> list[tuple]:
        return [(codec(path).encode(t.as_py() or ""),) for t in column]

    return _mapped(docs, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], rows)


def decode(docs: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with the text of ``ids`` in column ``text``; bytes that are no UTF-8 become U+FFFD."""
    path = path or default_path()

    def rows(column: pa.Array) -> list[tuple]:
        return [(codec(path).decode(t.as_py() or []).decode(errors="replace"),) for t in column]

    return _mapped(docs, ids, [T.StructField(text, T.StringType())], rows)


TOKENS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def digest(docs: DataFrame, text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``docs`` with the number of tokens, the digest of the ids, the digest of the decoded bytes, and if asked
    the ids."""
    path = path or default_path()

    def rows(column: pa.Array) -> list[tuple]:
        tree, out = codec(path), []
        for t in column:
            ids = tree.encode(t.as_py() or "")
            listed = ",".join([tree.decimal[i] for i in ids])
            out.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(tree.decode(ids)).hexdigest(), *([ids] * with_ids)))
        return out

    return _mapped(docs, text, [*DIGEST, *([TOKENS] * with_ids)], rows)


def op3_byte_level_bpe(spark, sf_dir: str) -> DataFrame:
    """Each document's tokens, encoded and decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
