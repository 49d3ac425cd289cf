"""Each operator of corpusmill.llm against a brute-force version, and on edge rows."""

import hashlib
import html as html_library
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import byte_bpe, decontaminate, html_extract, ngram_join, pii, quality_rules, secret_scan, token_counts, toxicity, url_filter, vec
from corpusmill.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [None, "", " \n\t ", "a", "é", "A b\nA b\n\nA b", "x" * 5000, "word " * 3000, "😀 日本語 ß\x1c\x85 x", "a\n"]


def rows_of(spark, texts, start=0):
    """Documents with extra columns of clashing names; ids from ``start``."""
    schema = "doc_id long, text string, n long, kept boolean, label long, row_id string"
    return spark.createDataFrame([(start + i, t, 7, None, None, "x") for i, t in enumerate(texts)], schema)


# ---- words
def test_words_and_hashes():
    for size in (64, 1 << 20):
        old, vec.PIECE = vec.PIECE, size
        try:
            texts = [*EDGE, "tail of a piece " * 40, "A" * 300 + " b"]
            seen = {}
            for a, at, hashes in vec.document_words(pa.array(texts), lower=True):
                for i in range(len(at) - 1):
                    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[a + i] or ""))
                    assert len(words) == at[i + 1] - at[i]
                    for w, h in zip(words, hashes[at[i] : at[i + 1]], strict=True):
                        assert seen.setdefault(w, h) == h
            assert len(set(seen.values())) == len(seen)
        finally:
            vec.PIECE = old


# ---- 1
def jaccard_components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least[find(x)], i)
    return [(i, len(sets[x]), least[find(x)] if least[find(x)] < 1 << 60 else None) for x, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_join(spark, k, num):
    rng = random.Random(k)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(40)] for _ in range(3)]
    texts = list(EDGE)
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(40)] = rng.choice(["zz", f"q{i}"])
        texts.append(" ".join(w).title() if i % 9 == 0 else " ".join(w))
    rows = list(enumerate(texts)) + [(5, texts[20]), (None, texts[30]), (None, "alone here"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.linked(df, k=k, num=num, den=100).select("id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(jaccard_components(rows, k, num, 100), key=repr)


def counted_components(rows, k, num, den):
    """The same by counting the shingles that any two documents share."""
    sets, held, both = [], defaultdict(list), Counter()
    for x, (_, t) in enumerate(rows):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
        for s in sets[-1]:
            held[s].append(x)
    for xs in held.values():
        both.update((a, b) for i, a in enumerate(xs) for b in xs[i + 1 :])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (a, b), n in both.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(least.get(find(x), i), i)
    return {(i, len(sets[x]), least[find(x)]) for x, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard_join_of_the_tables_documents(spark, k, num):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = ngram_join.linked(docs, k=k, num=num, den=100).select("id", "n_shingles", "component_id")
    assert {tuple(r) for r in got.collect()} == counted_components(rows, k, num, 100)


def test_jaccard_join_of_near_copies_without_ids(spark):
    words = [f"w{i}" for i in range(60)]
    bridge, far = [*words[:-3], "x", "y", "z"], [*words[3:-3], "x", "y", "z"]
    lone = [f"v{i}" for i in range(40)]
    rows = [(5, " ".join(words)), (None, " ".join(bridge)), (9, " ".join(far)), (None, " ".join(lone)), (None, " ".join([*lone, "more"])), (None, " ".join(lone[::-1])), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.linked(df, k=3, num=90, den=100).select("id", "n_shingles", "component_id")
    want = jaccard_components(rows, 3, 90, 100)
    assert [c for *_, c in want[:3]] == [5, 5, 5] and jaccard_components([rows[0], rows[2]], 3, 90, 100)[1][2] == 9
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    kept = sorted((r["text"] or "" for r in ngram_join.one_of_each(df, k=3, num=90, den=100).collect()), key=len)
    assert len(kept) == 4 and " ".join(words) in kept and " ".join(lone[::-1]) in kept and "" in kept


def test_parities_bound_what_differs():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (40, 40), (70, 120), (900, 1100), (5000, 4000), (200_000, 200_000)):
        common = int(0.8 * min(n, m))
        every = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        x, y = np.unique(every[:n]), np.unique(np.concatenate([every[:common], every[n : n + m - common]]))
        a, b = ngram_join.parities(x), ngram_join.parities(y)
        words = min(len(a), len(b))
        fold = lambda p: np.bitwise_xor.reduce(p.reshape(-1, words), axis=0)  # noqa: E731, B023
        assert int(np.bitwise_count((fold(a) ^ fold(b)).view(np.uint64)).sum()) <= len(np.setxor1d(x, y))


def test_jaccard_join_of_nothing(spark):
    assert ngram_join.linked(rows_of(spark, [])).count() == 0 and ngram_join.one_of_each(rows_of(spark, [])).count() == 0


def test_jaccard_join_takes_texts_in_small_batches(spark, monkeypatch):
    def watched(make):
        def made(*args):
            run = make(*args)

            def seen(batches):
                for batch in batches:
                    assert batch.nbytes < 2 << 20, f"a batch of {batch.nbytes} bytes"
                    yield from run(iter([batch]))

            return seen

        return made

    for name in ("_repeats", "_signed", "_whole"):
        monkeypatch.setattr(ngram_join, name, watched(getattr(ngram_join, name)))
    texts = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(600)), lambda i: F.concat(F.lit("w"), (F.col("id") / 2).cast("int"), F.lit("x"), i)))
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), texts.alias("text"))  # 10 MB in one task
    got = ngram_join.linked(docs, k=3, num=90, den=100)
    assert got.where("component_id <> id - id % 2 or n_shingles <> 599").count() == 0 and got.count() == 2000


def test_jaccard_join_workers_keep_no_memory():
    code = """if True:
        import re
        import numpy as np, pyarrow as pa
        from corpusmill.llm import ngram_join

        def held():
            return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

        text = pa.array([" ".join(f"w{(i * 7919 + j * j) % 9973}" for j in range(300)) for i in range(10_000)])
        ids, keys = pa.array(range(10_000)), np.arange(1 << 17, dtype=np.uint64)
        before = held()
        for run in (ngram_join._repeats(5), ngram_join._signed(5, 80, 100, keys, np.ones(1 << 17, np.int64))):
            for out in run(iter([pa.RecordBatch.from_arrays([ids, ids, text], names=["id", "hash", "text"])])):
                del out
        print(held() - before)
    """
    kept = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout)
    assert kept < 10, f"{kept:.0f} MB kept"


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = rows_of(spark, [text, text + " more", "other words that are not like it", "", None, text]).unionByName(rows_of(spark, [text])).withColumnsRenamed({"n": "own_0", "kept": "_key", "row_id": "_text"})
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2, 3, 4]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    labels = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert labels == {x: find(x) for x in linked}


# ---- 2
SECRET_TEXTS = [
    *EDGE, "password=abcdef", 'API_KEY : "abc.def/1" x', "password=token:abcdefgh", "secret = short", "AKIA" + "Z" * 16 + " AKIA" + "Q" * 15, "a" * 23 + " " + "a" * 24 + "g" + "0" * 30, "😀 passwd:'s3cr3t-+=' Token==abcdef 0123456789abcdef01234567",
    "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "TOKEN:=abcde", "apikey=AKIA" + "A1" * 12,
]


def secrets_of(text):
    kinds = (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    return sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m[g]) >= least)


def test_secrets(spark):
    df = rows_of(spark, SECRET_TEXTS + SECRET_TEXTS[-3:])
    got = {r["doc_id"]: r["found"] for r in secret_scan.joined_back(df, secret_scan.scan(df)).collect()}
    for i, t in enumerate(SECRET_TEXTS + SECRET_TEXTS[-3:]):
        assert [(x["start"], x["rank"], x["end"], x["kind"]) for x in got[i] if x["rank"] < 3] == secrets_of(t)
    assert "hub" in [x["kind"] for x in got[len(EDGE) + 7]] and [x["kind"] for x in got[len(EDGE) + 8]] == ["pem"]
    assert secret_scan.joined_back(df.limit(0), secret_scan.scan(df.limit(0))).count() == 0


def test_ledger_scans_unseen_pairs_only(spark):
    from corpusmill.llm.store import written

    one = rows_of(spark, ["password=abcdef", "AKIA" + "Z" * 16, "clean", None, "clean"])
    first = written(secret_scan.scan(one, rules=secret_scan.BASE[:1]), "t")
    assert first.count() == 4 and all(r["rules"] == ["assign@1"] for r in first.collect())  # clean blobs too
    assert secret_scan.unseen(one, first, rules=secret_scan.BASE[:1]).count() == 0
    again = secret_scan.scan(one, first, rules=secret_scan.BASE[:1])
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    # a marked finding of a seen pair stays as it is: the pair isn't scanned again
    marked = first.withColumn("found", F.transform("found", lambda x: x.withField("start", F.lit(77).cast("long"))))
    both = one.unionByName(rows_of(spark, ["secret=zzzzzz"], 9))
    second = secret_scan.scan(both, written(marked, "t"))
    got = {r["doc_id"]: [(x["kind"], x["start"]) for x in r["found"]] for r in secret_scan.joined_back(both, second).collect()}
    assert got == {0: [("assign", 77)], 1: [("access", 0)], 2: [], 3: [], 4: [], 9: [("assign", 0)]}
    todo = {len(r["todo"]) for r in secret_scan.unseen(both, first).collect()}
    assert todo == {len(secret_scan.RULES) - 1, len(secret_scan.RULES)}


def test_a_rules_new_version_replaces_its_findings(spark):
    from dataclasses import replace

    from corpusmill.llm.store import written

    docs = rows_of(spark, ["password=abcdef AKIA" + "Z" * 16, "token=abcdefghij"])
    first = written(secret_scan.scan(docs), "t")
    newer = (*secret_scan.BASE[1:], replace(secret_scan.BASE[0], least=8, version=2))  # and other places
    second = written(secret_scan.scan(docs, first, rules=newer, quick=None), "t")
    got = {r["doc_id"]: [(x["kind"], x["rank"]) for x in r["found"]] for r in secret_scan.joined_back(docs, second, rules=newer).collect()}
    assert got == {0: [("access", 0)], 1: [("assign", 2)]}
    assert all(sorted(r["rules"]) == sorted({x.name for x in (*newer, *secret_scan.RULES[3:])}) for r in second.collect())
    # the old pack finds its own findings gone, and scans again
    assert {tuple(r["todo"]) for r in secret_scan.unseen(docs, second).collect()} == {("assign@1",)}
    clash = docs.select("doc_id", "text", F.lit(1).alias("_blob"), F.lit(2).alias("own_0"), F.lit(3).alias("blob"))
    assert secret_scan.joined_back(clash, second, rules=newer).columns == ["doc_id", "_blob", "own_0", "blob", "found"]


# ---- 3
def test_tree_codec():
    tree = byte_bpe.codec(byte_bpe.default_path())
    rng = random.Random(0)
    texts = [t or "" for t in EDGE] + ["".join(rng.choice(" \n\tab'sé1!语  ") for _ in range(rng.randint(1, 200))) for _ in range(150)]
    for text in texts:
        ids = tree.leaf.encode_ordinary(text)
        for leaf in (1, 7, 64, 1 << 14):
            assert tree.encode(text, leaf) == ids and tree.decode(ids, leaf) == text.encode()


def test_codec_columns(spark):
    df = rows_of(spark, EDGE)
    tree = byte_bpe.codec(byte_bpe.default_path())
    back = byte_bpe.decode(byte_bpe.encode(df).drop("text")).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t in enumerate(EDGE)}
    for r in byte_bpe.digest(df).collect():
        ids = tree.leaf.encode_ordinary(EDGE[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((EDGE[r["doc_id"]] or "").encode()).hexdigest())
    assert byte_bpe.digest(df.limit(0)).count() == 0


def test_codec_of_the_tables_documents(spark):
    tree = byte_bpe.codec(byte_bpe.default_path())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r["doc_id"]: (len(ids := tree.leaf.encode_ordinary(r["text"] or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect()}
    got = byte_bpe.op3_byte_level_bpe(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


# ---- 4
def page(body, host="h"):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- c --><div class="ad">buy</div>{body}<footer>&copy; {host}</footer></body></html>'


@pytest.mark.parametrize(
    "body,text",
    [
        ("<article><h1>A &amp; B</h1><p><b>one<br>two</b></p><p> x\n y&nbsp;z </p></article>", "A & B\none two\nx y z"),
        ("<article><p>a<p>b<ul><li>c<li>d</ul><article><p>no</p></article></article>", "a\nb\nc\nd"),
        ("<main><aside>s</aside><form>f<p>g</p></form><p>t<sup>2</sup></p><div role=alert>n</div></main>", "t2"),
        ('<article><p><b class="x">A</b> <i>B</i> c</p></article>', "A B c"),
        ('<article><div class="header">h</div><section class="side-effects"><p>s</p></section><p class="related">r</p></article>', "h\ns\nr"),
        ("<article><p>a</p><article><p>reply</p><article>deep</article></article><div role=comment>no</div></article>", "a"),
        ("<article><article><p>listed</p></article></article>", "listed"), ("<article><header><h1>t</h1></header><p>a</p><footer>f</footer></article>", "t\na"),
        ("<article></article>", ""), ("<article><p>3 < 4 & 5 > 2</p></article>", "3 < 4 & 5 > 2"), ('<article><p>a</p><img alt="unclosed><p>b</p></article>', "a\nb"), ("<article><p>a<!-- <p>x</p> -->b</p></article>", "ab"),
    ],
)
def test_extraction(body, text):
    pages = [page(body), *(page(f"<article><p>p{i}</p></article>") for i in range(4))]
    assert html_extract.extract(pages)[0] == text and html_extract.extract(pages)[2] == "p1"
    assert html_extract.extract([page(body)]) == [text]


def test_pages_without_an_article_keep_all_open_text():
    one = [page(f"<p>intro {i}</p><div class=a><p>{'long ' * 30}{i}</p></div>") for i in range(6)]
    two = [page(f"<div class=b><p>short {i}</p></div>") for i in range(4)]
    got = html_extract.extract([*one, *two])
    assert got == [*(f"intro {i}\n{'long ' * 30}{i}" for i in range(6)), *(f"short {i}" for i in range(4))]
    # one page alone shows no template, so what only a template can tell stays
    assert html_extract.extract(two[:1]) == ["buy\nshort 0"] and html_extract.extract(one[:1]) == ["buy\n" + got[0]]


def test_the_template_decides_what_is_text():
    said = lambda i: f"<h1>Site</h1><p>text <b>{i}</b></p><p>also {i * i}</p>" + f"<section><p>part {i}</p><span>Read on</span></section>" * (i % 3 + 1)
    pages = [page(f"<article>{said(i)}<p>All rights</p></article>") for i in range(5)]
    want = [f"text {i}\nalso {i * i}" + f"\npart {i}" * (i % 3 + 1) for i in range(5)]
    assert html_extract.extract(pages) == want
    # two pages show no template, and copies are no template
    assert html_extract.extract(pages[:2]) == [w.replace("text", "Site\ntext").replace(f"part {i}", f"part {i}\nRead on") + "\nAll rights" for i, w in enumerate(want[:2])]
    assert html_extract.extract([page("<article><p>copy</p></article>", h) for h in "abcd"]) == ["copy"] * 4
    # a text that only some of a slot's pages share, and slots outside an article
    assert html_extract.extract([page(f"<article><p>{'same' if i else 'other'}</p><p>{i}</p></article>") for i in range(5)])[1] == "same\n1"
    assert html_extract.extract([page(f"<ul><li><a>Home</a></li><li><a>Shop</a></li></ul><p>open {i}</p>") for i in range(5)]) == [f"open {i}" for i in range(5)]


def test_slots_outside_articles_are_told_by_how_they_vary():
    # the class words say nothing: adverts come from a pool, the menu is all links, the text varies
    pool = ["Buy one", "Buy two", "Last days"]

    def bare(i, ad="zq", body="xw"):
        return f"<html><body><div class={ad}>{pool[i % 3]}</div><div class=m><span><a>{i} a</a></span> <span><a>b {i}</a></span></div><div class={body}><p>Said {i} <a>here</a></p><p>Same words</p><p>{i * 7} more</p></div><div class=k9>All rights {0}</div></body></html>"

    want = [f"Said {i} here\n{i * 7} more" for i in range(9)]
    assert html_extract.extract([bare(i) for i in range(9)]) == want
    assert html_extract.extract([bare(i, "content", "ad-sidebar") for i in range(9)]) == want
    off, html_extract.equivalence_classes = html_extract.equivalence_classes, lambda pages: {}
    try:  # without a template all open text stays
        assert html_extract.extract([bare(i) for i in range(9)])[1] == "Buy two\n1 a b 1\nSaid 1 here\nSame words\n7 more\nAll rights 0"
    finally:
        html_extract.equivalence_classes = off


def test_template_is_the_shared_spine():
    pages = [html_extract.Page(page("<article>" + "<p>x</p>" * n + "</article>")) for n in (1, 2, 3)]
    spine = [r for r, _ in html_extract.template(pages)]
    assert "article" in spine and "/article" in spine and "nav" in spine and "p" not in spine


def test_extraction_of_tables(spark):
    rows = [(1, "http://a/x", page("<article><p>t</p></article>")), (1, "http://a/x", page("<article><p>t</p></article>")), (None, None, None), (2, "nohost", ""), (1 << 60, "http://a/y", "<p>" * 20000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(map(tuple, html_extract.main_texts(df).collect()), key=repr)
    assert got == sorted([(1, "http://a/x", "t", 1), (1, "http://a/x", "t", 1), (None, None, "", 0), (2, "nohost", "", 0), (1 << 60, "http://a/y", "deep", 4)], key=repr)
    assert html_extract.main_texts(df.limit(0)).count() == 0
    limit, html_extract.MAX_BROADCAST = html_extract.MAX_BROADCAST, 0
    try:
        assert sorted(map(tuple, html_extract.main_texts(df).collect()), key=repr) == got
    finally:
        html_extract.MAX_BROADCAST = limit


def test_extraction_of_the_tables_pages():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    hosts = defaultdict(list)
    for r in rows:
        hosts[re.search("://([^/?#]*)", r["url"])[1]].append(r["html"])
    for pages in hosts.values():
        for source, text in zip(pages, html_extract.extract(pages), strict=True):
            body = re.search("<article>(.*?)</article>", source, re.S)[1]
            blocks = (" ".join(html_library.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body))
            assert text == "\n".join(b for b in blocks if b)


# ---- 5
def test_toxicity(spark):
    rng = random.Random(5)
    clean = [f"w{i}" for i in range(400)]
    texts, marks = [], []
    for i in range(400):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 200))]
        bad, junk = i % 8 == 0, i % 5 == 0
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["Vile!", "rotten,", f"lowei{rng.randrange(50)}"]))
        texts.append(" ".join(x + "%%%" for x in w) if junk else " ".join(w))
        marks.append((i, int(junk), int(bad)))
    docs, labels = rows_of(spark, texts), spark.createDataFrame(marks, "doc_id long, junk int, toxic int")
    chain = toxicity.Chain.fit(docs, labels.where("doc_id < 300"), toxicity.CATEGORIES)
    held = {r["doc_id"]: r for r in chain.score(docs).collect() if r["doc_id"] >= 300}
    wrong = [i for i, r in held.items() if (r["p_toxic"] >= 0.5) != bool(marks[i][2])]
    assert len(wrong) <= 3 and sum((r["p_junk"] >= 0.5) != bool(marks[i][1]) for i, r in held.items()) <= 2
    assert len(chain.links[1].before) == 1 and len(chain.links[0].before) == 0
    long = " ".join(rng.choice(clean) for _ in range(300_000))
    edge = {r["doc_id"]: r["p_toxic"] for r in chain.score(rows_of(spark, [*EDGE, long, long + " vile! rotten, vile! rotten,"])).collect()}
    assert all(edge[i] < 0.5 for i in range(len(EDGE) + 1)) and edge[len(EDGE) + 1] >= 0.5
    assert edge[0] == edge[1]


def test_toxic_rows_held_out_are_found(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), toxicity.table_labels(spark, d)
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))
    chain = toxicity.Chain.fit(docs.select("doc_id", "text"), labels.where(half == 0), toxicity.CATEGORIES)
    held = labels.where(half == 1)
    scored = chain.score(docs.select("doc_id", "text").join(held, "doc_id")).withColumn("found", F.col("p_toxic") >= toxicity.THRESHOLD)
    n = {(r["toxic"], r["found"]): r["count"] for r in scored.groupBy("toxic", "found").count().collect()}
    assert n[1, True] >= 0.9 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) <= 0.005 * n[0, False], n


def test_word_families_are_counted():
    texts = ["abcde abcdf", "abcdeX abcdeY abcdeX", "abcdeX abcdeY abcdeZ", None, "abcde " * 3]
    got = defaultdict(set)
    for docs, found in toxicity._pairs(pa.array(texts)):
        for d, f in zip(docs.tolist(), found.tolist(), strict=True):
            assert f not in got[d]
            got[d].add(f)
    heads = {d: sorted(f & 3 for f in got[d]) for d in range(5)}
    # heads of 3 and 4 letters are shared by two words, those of 5 too in the second text, by three words in the third
    assert heads == {0: [0] * (2 + 2 + 2 * 2 + 2) + [1, 1], 1: [0] * (2 + 3 + 2 + 2) + [1] * 3, 2: [0] * (3 + 3 + 3 + 3) + [1] * 3 + [2] * 3, 3: [], 4: [0] * 6}
    old, vec.PIECE = vec.PIECE, 64
    try:
        long = [" ".join(f"w{i}" for i in range(200))]
        assert sum(len(f) for _, f in toxicity._pairs(pa.array(long))) > 200
    finally:
        vec.PIECE = old


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, junk int, toxic int")
    got = toxicity.judged(rows_of(spark, EDGE), labels)
    assert got.where("toxic").count() == 0 and got.count() == len(EDGE)
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, 1), (2, 0, 0)], "doc_id long, junk int, toxic int")
    assert toxicity.judged(rows_of(spark, EDGE), nulls).where("toxic").count() == 0
    assert toxicity.judged(rows_of(spark, []), nulls).count() == 0


# ---- 6
def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_path())
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    texts = [*EDGE, "foo<|endoftext|>bar", "İSTANBUL ΣΑΣ Σ", "don't we'RE 123 4'5", "a\x1cb\x1fc d　e", "👩‍👩‍👧 Ⱥx ﬁ", "thwhbleou erst, " * 30]
    got = token_counts.count_tokens(rows_of(spark, texts), limit=10).collect()
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), count(t), count(t) > 10)
    assert token_counts.count_tokens(rows_of(spark, [])).count() == 0


def test_token_counts_of_the_tables_documents(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_path())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    counts = [len(e.ids) for e in library.encode_batch([r["text"] or "" for r in docs], add_special_tokens=False)]
    want = {r["doc_id"]: (len((r["text"] or "").encode()), n, n > 2048) for r, n in zip(docs, counts, strict=True)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.op6_token_counts(spark, "/root/testdata/sf0.01").collect()} == want


def test_prefix_counts():
    tokens = token_counts._tokens(token_counts.default_path())
    count = lambda t: tokens.count([t])[0]
    for t in ["", "a b", "internationalization of überkeit", "don't 'stop", "é x́y  ", "ab<|endoftext|>cd", "x!!!...? 1234"]:
        table = token_counts.PrefixCounts.of(tokens, t)
        for budget in range(6):
            assert table.fit(budget) == max(i for i in range(len(t) + 1) if count(t[:i]) <= budget), (t, budget)
    for w in ("internationalization", "thwhbleou", "!!!???...", "日本語"):
        assert tokens.pretoken_prefixes(w) == [count(w[:i]) for i in range(len(w) + 1)]
    table = token_counts.PrefixCounts.of(tokens, "one two three")
    assert table.between(1, 3) == count("two three") and table.total == count("one two three")


# ---- 7
def base_measures(t):
    words = WORD.findall(t or "")
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def plain_verdict(t, boiler):
    """The line rules in plain Python."""
    bad, total = 0, sum(len(w) for w in WORD.findall(t or ""))
    for line in (t or "").split("\n"):
        w = WORD.findall(line)
        if not w:
            continue
        marks, bars = len(re.findall(r"[!#$%&*+/<=>?@\\^_`{|}~\"()\[\],.;:]", line)), len(re.findall(r"[|>]", line))
        fails = marks > 0.7 * len(w) and marks >= 5
        fails |= bars >= 2 and 4 * bars >= len(w)
        fails |= len(w) < 3 and not re.search(r"[.!?:;\"')\]}…”»。！？]$", w[-1])
        fails |= len(w) <= 40 and plain_line(line) in boiler
        fails |= len(w) >= 16 and 2 * sum(a == b for a, b in zip(w, w[1:])) >= len(w)
        bad += sum(map(len, w)) * fails
    return not base_measures(t)[5] and bad <= 0.5 * total


def plain_line(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\t\n\v\f\r"))


def plain_boilerplate(texts):
    """Lines of unrelated documents; a document's source is the word whose hash is least."""
    sources, docs = defaultdict(set), Counter()
    for t in texts:
        data = np.frombuffer(re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode(), np.uint8)
        words = vec.span_hashes(data, *vec.word_spans(data, np.zeros(0, np.int64)))
        if not len(words):
            continue
        source = int(min(vec.mix(words ^ np.uint64(0x5851F42D4C957F2D))))
        for line in {plain_line(x) for x in t.split("\n") if 0 < len(WORD.findall(x)) <= 40}:
            sources[line].add(source)
            docs[line] += 1
    return {line for line, s in sources.items() if len(s) >= max(8, -(-len(texts) // 10_000)) and 5 * len(s) >= docs[line]}


def test_quality(spark):
    prose = "The quick brown fox jumps over the lazy dog, and then it rests for a while.\n"
    fresh = lambda n, at=0: "".join(" ".join(f"word{i + at}x{j}" for j in range(14)) + ".\n" for i in range(n))  # noqa: E731  no window twice
    texts = [*EDGE, fresh(5), prose * 6, "SHOUT!! LOUD!! " * 20, "a | b | c | d | e\n" * 20, "\n\na\na\n" + prose, "x y z " * 9 + "#*$%&|<>", "Home\nAbout us\nAll rights reserved.\n" + fresh(4)]
    footer = "All rights reserved by us.\n Write to the EDITOR of this page.\n"
    texts += [fresh(1, 100 + i) + footer for i in range(12)] + [fresh(3, 200) + "More of the same here, again.\n"] * 40
    df = rows_of(spark, texts)
    boiler = quality_rules.learnt(df)
    assert len(boiler) == 2 == len(plain_boilerplate(texts))
    got = {r["doc_id"]: r for r in quality_rules.measure(df, rules=quality_rules.LineRules(boiler), cleaned="clean").collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base_measures(t)
        assert got[i]["n"] == 7 and got[i]["kept"] == plain_verdict(t, plain_boilerplate(texts)), t
    n = len(EDGE)
    assert [got[n + i]["kept"] for i in range(7)] == [True, False, False, False, False, False, True]
    assert got[n + 6]["clean"].startswith("All rights reserved.\nword0x0") and got[n]["clean"] == texts[n]
    assert got[n + 7]["clean"] == fresh(1, 100) and got[n + 30]["kept"] and got[n + 30]["n_bad_lines"] == 0
    empty = rows_of(spark, [])
    assert quality_rules.measure(empty, rules=quality_rules.LineRules(quality_rules.learnt(empty))).count() == 0


def test_quality_of_the_tables_documents(spark):
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    boiler = plain_boilerplate([r["text"] for r in rows])
    want = {r["doc_id"]: (*base_measures(r["text"]), plain_verdict(r["text"], boiler)) for r in rows}
    got = quality_rules.op7_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert boiler and {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) for r in got} == want


# ---- 8
def test_base_spans():
    def plain(text):
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii._luhn(d)]
        found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(found)

    rng = random.Random(2)
    texts = [t or "" for t in EDGE] + ["a@b.c x@y a.b@@c.d@e.f", "1.2.3.4.5 256.1.1.1 01.002.0003.4", "4111 1111-1111 1111 4111111111111112", "+1 (658) 555-4270 +12 +123456789012345678", "é+1 234 567 89"]
    texts += ["".join(rng.choice("a1.2@+- (9)b") for _ in range(60)) for _ in range(1500)]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t


def test_personal_data_and_contexts(spark):
    texts = [*EDGE, *(f"write to contact{i}: u{i}@mail.org now" for i in range(3)), *(f"some reach: p{i}@mail.org here" for i in range(9)), "people reach: user-77-x, often", "no the 12345 and the 67890", "reach: me"]
    df = rows_of(spark, texts)
    got = {r["row_id"]: r for r in pii.find(df).collect()}
    kinds = {i: [x["kind"] for x in r["spans"]] for i, r in got.items()}
    n = len(EDGE)
    assert all(kinds[i] == [] for i in range(n)) and kinds[n] == ["email"] and kinds[n + 12] == ["ctx"] and kinds[n + 13] == []
    assert texts[n + 12][got[n + 12]["spans"][0]["start"] : got[n + 12]["spans"][0]["end"]] == "user-77-x"
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[n]["base_sha256"] == hashlib.sha256(f"email:{texts[n].index('u0')}:{texts[n].index(' now')}".encode()).hexdigest()
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(None, texts[n], 7, None, None, "x")], df.schema))
    assert pii.find(twice).count() == 2 * len(texts) + 1
    clash = df.select("doc_id", "text", F.lit(1).alias("_row_id"), F.lit(2).alias("own_0"), F.lit(3).alias("spans"))
    clean = {r["doc_id"]: r for r in pii.redact(clash).collect()}
    assert clean[0]["text"] is None and clean[n]["text"] == "write to contact0: [EMAIL] now" and clean[n + 12]["text"] == "people reach: [CTX], often" and clean[4]["text"] == EDGE[4]
    assert all((r["_row_id"], r["own_0"], r["spans"]) == (1, 2, 3) for r in clean.values())
    assert pii.redact(df).columns == df.columns and pii.redact(twice).count() == 2 * len(texts) + 1
    assert pii.find(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def plain_contexts(texts, least=pii.MIN_SEEDS, confidence=pii.MIN_CONFIDENCE):
    """The spans that contexts add, by dictionaries of whole patterns."""
    def side(w):
        return "|" if w is None else "w" if any(c.isalpha() for c in w) else "n" if any(c.isdigit() for c in w) else "-"

    def low(w):
        return re.sub("[A-Z]", lambda m: m[0].lower(), w)

    def around(words, i, j, entity):
        get = lambda k: words[k][0] if 0 <= k < len(words) else None
        one, two, behind = get(i - 1), get(i - 2), get(j + 1)
        if one is not None:
            yield "L", low(one)
            if two is not None:
                yield "LL", low(two), low(one)
        if behind is not None:
            yield "R", low(behind)
            if one is not None:
                yield "LR", low(one), low(behind)
        if entity is not None:
            form = (entity[0] if entity[0].isdigit() else "") + re.sub(r"[0-9]+|[^\W\d_]+", lambda m: f"9{len(m[0])}" if m[0][0].isdigit() else "a", entity)
            yield from (("FL", side(one), form), ("FR", form, side(behind)), ("F", side(one), form, side(behind)))

    seeds, edges, places = defaultdict(set), defaultdict(lambda: defaultdict(int)), Counter()
    known, found = set(), []
    for d, t in enumerate(texts):
        words, spans, covered, here = [(m[0], m.start(), m.end()) for m in WORD.finditer(t or "")], pii.base_spans(t or ""), set(), []
        for a, _, b in spans:
            touch = [k for k, (_, s, e) in enumerate(words) if s < b and e > a]
            here.append((a, b, True, touch[0], touch[-1]))
            covered.update(touch)
        for k, (w, s, e) in enumerate(words):
            bare = w.lstrip("([<\"'").rstrip(".,;:!?)]>\"'")
            if k not in covered and len(bare) >= 5 and re.search("[0-9@]", bare):
                s += len(w) - len(w.lstrip("([<\"'"))
                here.append((s, s + len(bare), False, k, k))
                covered.add(k)
        for a, b, seed, i, j in here:
            name = t[a:b].lower()
            found.append((d, a, b, seed, name, list(around(words, i, j, t[a:b]))))
            for p in found[-1][-1]:
                edges[p][name] += 1
                places[p] += 1
                if seed:
                    seeds[p].add(name)
                    known.add(name)
        for k in range(len(words)):
            if k not in covered:
                places.update(around(words, k, k, None))
    induced = {p for p, s in seeds.items() if len(s) >= least}
    seeded = {(p, name) for p, names in seeds.items() for name in names}
    score = {(p, n): 1.0 * ((p, n) in seeded) for p in induced for n in edges[p]}
    trust = lambda: {p: sum(score[p, n] * c for n, c in edges[p].items()) / places[p] for p in induced}
    for _ in range(pii.ROUNDS):
        now, doubt = trust(), defaultdict(lambda: 1.0)
        for p in induced:
            for n in edges[p]:
                doubt[n] *= max(1e-9, 1 - now[p])
        sure = {n for p, n in seeded if p in induced}
        score = {(p, n): 1.0 if n in sure else 1 - doubt[n] for p, n in score}
    good = {p for p, x in trust().items() if x >= confidence}
    return {(d, a, b) for d, a, b, seed, _, ps in found if not seed and good.intersection(ps)}


def test_contexts_equal_the_plain_version(spark):
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    want = plain_contexts([r["text"] for r in rows])
    got = pii.find(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    place = {r["doc_id"]: i for i, r in enumerate(rows)}
    assert want and {(place[r["row_id"]], x["start"], x["end"]) for r in got for x in r["spans"] if x["kind"] == "ctx"} == want


# ---- 9
def test_windows_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    items = [(i, [int(x) for x in rng.integers(-(2**62), 2**62, n)], [1] * max(1, n - 4)) for i, n in enumerate([5, 9, 20, 40])]
    index = decontaminate.Index(items, 4)
    for k, (_, own, prints, _) in enumerate(index.classes):
        for _ in range(300):
            bits = rng.choice(64, int(rng.integers(0, 15)), replace=False)
            near = prints[0] ^ np.uint64(sum(1 << int(b) for b in bits))
            windows, found = index.near(np.array([near]), k)
            assert (own[0] in found) == (len(bits) <= decontaminate.RADIUS) and (len(windows) > 0) >= (len(bits) <= decontaminate.RADIUS)


def test_fingerprints_are_sliding():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 60).astype(np.uint64)
    for size in (5, 16, 33):
        slow = [decontaminate.fingerprints(words[i : i + size], size)[0] for i in range(60 - size + 1)]
        assert decontaminate.fingerprints(words, size).tolist() == [int(x) for x in slow]


def near_copies():
    """(item, document) by kind of change, all at 0.8 or more over windows as long as the item, cut at the document's ends."""
    rng = np.random.default_rng(4)
    say = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    for n in (15, 31, 44, 60, 300, 600):
        for _ in range(5):
            item, k = say(n), (n - 4) // 9
            mid = n // 2
            yield n, "head replaced", item, np.concatenate([say(70), say(k), item[k:], say(70)])
            yield n, "head missing", item, np.concatenate([say(70), item[k:], say(70)])
            yield n, "head cut by the start", item, np.concatenate([item[n // 6 :], say(70)])
            yield n, "tail cut by the end", item, np.concatenate([say(70), item[: n - n // 6]])
            yield n, "tail replaced", item, np.concatenate([say(70), item[: n - k], say(70)])
            yield n, "words put in", item, np.concatenate([say(70), item[:mid], say(max(1, n // 20)), item[mid:], say(70)])


def best_window(item, text):
    """The best Jaccard of five-word shingles of item-long windows of text, cut at its ends (shingles all weigh the same)."""
    sets = lambda w: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    item, text, best = item.tolist(), text.tolist(), 0.0
    whole = sets(item)
    for w in range(5 - len(item), len(text) - 4):
        mine = sets(text[max(0, w) : w + len(item)])
        both = (mine & whole).total()
        best = max(best, both / (mine.total() + whole.total() - both))
    return best


def test_all_near_copies_are_found():
    missed = 0
    for n, what, item, text in near_copies():
        index = decontaminate.Index([(1, item.view(np.int64).tolist(), [1] * (n - 4))], 1)
        other = np.random.default_rng(n).integers(0, 2**63, 50).astype(np.uint64)
        words, doc = np.concatenate([other, text, other]), np.repeat([0, 1, 2], [50, len(text), 50])
        found = index.matches(words, doc)
        if n <= 300:  # by brute force
            best = best_window(item, text)
            assert ((1, 0) in found) == (best >= 0.8 - 1e-12), (n, what, best)
            assert not found or abs(found[1, 0][0] - best) < 1e-9
        elif what != "words put in":
            missed += (1, 0) not in found
        assert set(found) <= {(1, 0)}
    assert not missed


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [say(n) for n in (6, 15, 30, 59, 140)]
    bench = spark.createDataFrame([*enumerate(passages), (2, passages[2]), (7, passages[3]), (8, "Only four, short words"), (9, None), (None, say(20)), (10, "...")], "item_id long, text string")
    edited = passages[3].split()
    edited[-1] = "changed"
    texts = [*EDGE, *(f"{say(50)} {p.title()}, {say(80)}" for p in passages), " ".join(edited), passages[3][: len(passages[3]) // 2], say(70_000) + "\n" + passages[1], say(500), say(9) + " only FOUR short words!", "only four"]
    df = rows_of(spark, texts).withColumnsRenamed({"row_id": "own_0", "label": "_more"})
    got = {r["doc_id"]: sorted(h["item_id"] for h in r["hits"]) for r in decontaminate.find(df, bench).collect()}
    n = len(EDGE)
    assert [got[n + i] for i in range(11)] == [[0], [1], [2], [3, 7], [4], [3, 7], [], [1], [], [8], []] and all(got[i] == [] for i in range(n))
    first = next(h for r in decontaminate.find(df, bench).collect() if r["doc_id"] == n + 1 for h in r["hits"])
    assert first["first_word"] == 50 and first["similarity"] == 1.0
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [*range(n), n + 6, n + 8, n + 10]
    block, decontaminate.ITEM_BLOCK = decontaminate.ITEM_BLOCK, 2
    try:
        assert {r["doc_id"]: sorted(h["item_id"] for h in r["hits"]) for r in decontaminate.find(df, bench).collect()} == got
    finally:
        decontaminate.ITEM_BLOCK = block
    assert decontaminate.clean(df, bench.limit(0)).count() == len(texts) and decontaminate.find(df.limit(0), bench).count() == 0


def plain_leaks(docs, items):
    """document -> items of which some window as long as the item, cut at the document's ends, is 0.8 alike."""
    split = lambda t: WORD.findall("".join(c if c.isalnum() or ord(c) > 127 else " " for c in re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    sets = lambda w: [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    known = {i: Counter(sets(split(t))) for i, t in items}
    df = Counter(s for c in known.values() for s in c)
    weight = lambda s: np.log(1 + len(known) / df.get(s, 1))
    holders = defaultdict(list)
    for i, c in known.items():
        for s in c:
            holders[s].append(i)
    found = {}
    for d, t in docs:
        own, hits = sets(split(t)), defaultdict(set)
        for p, s in enumerate(own):
            for i in holders.get(s, ()):
                n = known[i].total()
                hits[i].update(range(p - n + 1, p + 1))
        found[d] = set()
        for i, starts in hits.items():
            n = known[i].total()
            for w in starts:
                mine = Counter(own[max(0, w) : w + n])
                both = sum(weight(s) * k for s, k in (mine & known[i]).items())
                if both >= (0.8 - 1e-9) * sum(weight(s) * k for s, k in (mine | known[i]).items()):
                    found[d].add(i)
                    break
    return found


def test_decontamination_of_the_tables_documents(spark):
    import pyarrow.parquet as pq

    docs, items = (pq.read_table(f"/root/testdata/sf0.01/{n}.parquet").to_pylist() for n in ("documents", "benchmark"))
    want = plain_leaks([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])
    got = {r["doc_id"]: set(r["items"]) for r in decontaminate.op9_decontamination(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and any(want.values())


def test_items_of_one_id_or_none_are_all_searched(spark):
    said = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcde"]
    bench = spark.createDataFrame([(1, said[0]), (1, said[1]), (1, said[1]), (None, said[2]), (None, said[3])], "item_id long, text string")
    df = rows_of(spark, said)
    got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontaminate.find(df, bench).collect()}
    assert got == {0: [1], 1: [1], 2: [None], 3: [None], 4: []}
    assert [r["doc_id"] for r in decontaminate.clean(df, bench).collect()] == [4]


# ---- 10
@pytest.mark.parametrize("range_bits,ranges", [(1 << 26, 1), (1024, 4)])
def test_cascade_is_exact(spark, range_bits, ranges):
    listed = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"))
    every = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filter.Cascade(listed, every, range_bits)
    got = cascade.mark(every.unionByName(every.limit(10)).unionByName(spark.createDataFrame([(None,)], "key string")), "key", "on")
    assert {r["key"] for r in got.where("on").collect()} == {f"k{i}" for i in range(300)} and got.count() == 6011
    assert cascade.ranges == ranges and all(len(p.levels) > 1 for p in cascade.parts)


def test_urls(spark):
    urls = ["http://A.Example.com/en/x?q#f", "https://www.example.com/en/", "http://x.net/es/1", "http://notcom/en/", "http://com", "http://b.org/a/1?utm_source=x", "http://b.org/c/1", "a://b://c/d", "//x/y", None, "", "http://é.net/fr/#x"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.campaign_sections(df)).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[2] == ("x.net", "/es/1", "net/es/", "block") and got[3] == ("notcom", "/en/", None, "allow") and got[4] == ("com", "", None, "allow")
    assert got[5] == ("b.org", "/a/1", None, "block") and got[6] == ("b.org", "/c/1", None, "allow") and got[7] == ("b:", "//c/d", None, "allow")
    assert got[8] == got[9] == got[10] == ("", "", None, "allow") and got[11] == ("é.net", "/fr/", "net/fr/", "block")
    empty = df.limit(0)
    assert url_filter.judge(empty, url_filter.campaign_sections(empty)).count() == 0
