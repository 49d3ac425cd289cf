"""The pipeline's stages, one after the other, against plain versions on tables with edge rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import tiktoken  # noqa: F401  the library that the tokens are held against

import corpus_pipeline
from corpusmill.llm import byte_bpe, ngram_join, pii

from .test_llm_operators import jaccard_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic string, own_0 long, _text string, hits int"


def documents():
    rng = random.Random(11)
    say = lambda n: " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randrange(60)}" for _ in range(n))
    passages = [say(30), say(45)]
    clean = [say(rng.randint(30, 90)) for _ in range(60)]
    texts = [(t, "clean") for t in clean]
    texts += [(" ".join(w if i % 9 else rng.choice(["vile", "rotten", "lowlife"]) for i, w in enumerate(say(50).split())), "toxic") for _ in range(24)]
    texts += [(clean[0], "copy"), (clean[1] + " more", "copy"), (clean[2].title(), "copy")]
    texts += [(f"{say(20)} {p} {say(20)}", "leak") for p in passages]
    texts += [(f"{say(25)} mail u{i}@x.org or +1 (555) 123-456{i} now", "pii") for i in range(3)]
    texts += [(None, "null"), ("", "null"), (" \n ", "null")]
    rows = [(i, t, "en", kind, len(t or ""), "mine", i, "kept", 5) for i, (t, kind) in enumerate(texts)]
    rows += [rows[5], (None, say(40), None, "clean", None, None, None, None, None)]
    return rows, passages


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows, passages = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 1, int(r[3] == "toxic")) for r in rows if r[0] is not None and r[3] in ("clean", "toxic")] + [(None, 0, 1), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([*enumerate(passages), (9, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def redacted(text):
    at, out = 0, []
    for a, k, b in pii.base_spans(text):
        if a >= at:
            out += [text[at:a], f"[{pii.KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def expected(rows):
    """What each stage leaves, by plain versions."""
    stages = {}
    rows = stages["toxicity"] = [r for r in rows if r[3] != "toxic"]
    groups, kept = defaultdict(list), {}
    for r, (_, n, component) in zip(rows, jaccard_components([r[:2] for r in rows], 5, 80, 100), strict=True):
        groups[component if n else ("alone", r[0], r[1])].append(r)
    for members in groups.values():
        first = min(members, key=lambda r: (r[0] is None, r[0]))
        kept[first[:2]] = first
    rows = stages["ngram_jaccard"] = list(kept.values())
    rows = stages["decontamination"] = [r for r in rows if r[3] != "leak"]
    rows = stages["pii"] = [(r[0], t := r[1] and redacted(r[1]), *r[2:4], None if t is None else len(t), *r[5:]) for r in rows]
    tree = byte_bpe.codec(byte_bpe.default_path())
    ids = [tree.leaf.encode_ordinary(r[1] or "") for r in rows]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    stages["byte_bpe"] = [(r[0], r[2], r[3], len(i), i, sha(",".join(map(str, i)).encode()), sha((r[1] or "").encode())) for r, i in zip(rows, ids, strict=True)]
    return stages


def test_stages_equal_the_plain_versions(spark, tables):
    d, rows = tables
    docs, want = spark.read.parquet(f"{d}/documents.parquet"), expected(rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, d), "test")
        assert name == "byte_bpe" or docs.columns == columns
        assert sorted(map(repr, map(tuple, docs.collect()))) == sorted(map(repr, want[name])), name
    assert re.search("PHONE", str(want["pii"])) and len(want["ngram_jaccard"]) < len(want["toxicity"]) - 3


def test_ngram_jaccard_stage_cuts_batches_by_bytes(spark, monkeypatch):
    made = ngram_join._repeats

    def watched(k):
        run = made(k)

        def seen(batches):
            for batch in batches:
                assert batch.nbytes < 2 << 20, f"a batch of {batch.nbytes} bytes"
                yield from run(iter([batch]))

        return seen

    monkeypatch.setattr(ngram_join, "_repeats", watched)
    docs = spark.range(0, 600, 1, 1).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 999), i -> concat('w', id, 'x', i))) as text")  # 5 MB in one task
    assert corpus_pipeline.ngram_jaccard_stage(spark, docs, "").count() == 600


def test_empty_tables(spark, tables, tmp_path):
    d, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
