"""Every registered query of the engine against its SQL on the smallest tables."""

import math
import os
import re
from collections import defaultdict
from difflib import SequenceMatcher

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusmill.plans import queries, reports
from corpusmill.plans import registry as engine

assert queries.QUERIES and reports

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        path = f"{TABLES}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


def same(spark, duck, query, sql):
    got = query(spark, TABLES)
    names = sorted(got.columns)
    theirs = duck.execute(sql)
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == names
    left = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    right = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in theirs.fetchall()), key=repr)
    assert left == right
    return left


#: Queries without a row on these tables.
EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    assert same(spark, duck, engine.QUERIES[name], engine.SQL[name]) or name in EMPTY


def documents():
    return pq.read_table(f"{TABLES}/documents.parquet").to_pylist()


def normal(text):
    bare = re.sub(r"[\s\x1c-\x1f]+", "", text or "").lower()
    return bare.translate(str.maketrans("？！。，、：；", "?!.,,:;"))


def ratio(a, b):
    """With the bounds that difflib itself offers first."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= 0.94 and m.quick_ratio() >= 0.94 and m.ratio() >= 0.94


def test_near_dup_greedy_is_the_loop(spark):
    kept, status = defaultdict(list), {}
    for r in sorted(documents(), key=lambda r: r["doc_id"]):
        text, seen = normal(r["text"]), status.setdefault(("seen", r["lang"]), {})
        if text in seen:
            status[r["doc_id"]] = "exact_duplicate" if seen[text] == "kept" else "near_duplicate"
            continue
        seen[text] = status[r["doc_id"]] = "near_duplicate" if any(ratio(text, k) for k in kept[r["lang"]]) else "kept"
        if seen[text] == "kept":
            kept[r["lang"]].append(text)
    got = {r["doc_id"]: r["status"] for r in engine.QUERIES["near_dup_greedy"](spark, TABLES).collect()}
    assert got == {k: v for k, v in status.items() if not isinstance(k, tuple)} and len(set(got.values())) == 3


def test_overlap_near_is_brute_force(spark):
    labelled = {r["doc_id"] for r in pq.read_table(f"{TABLES}/labels.parquet").to_pylist()}
    rows = [(r["doc_id"], r["lang"], normal(r["text"])) for r in documents()]
    train = sorted(r for r in rows if r[0] in labelled)
    equal = {t for *_, t in train}
    want = {i: next((d for _, d, o in train if ratio(t, o)), None) for i, _, t in rows if i not in labelled and t not in equal}
    got = {r["item"]: r["dataset"] for r in engine.QUERIES["overlap_near"](spark, TABLES).collect()}
    assert got == {i: d for i, d in want.items() if d}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(engine.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_near_copies_with_other_first_lines_meet(spark, tmp_path):
    body = " ".join(f"word{i}" for i in range(25))
    rows = [(1, "en", f"One\n{body}"), (2, "en", f"Two\n{body}"), (3, "de", f"Two\n{body}"), (4, "en", f"{body} end"), (5, "en", f"One\n{body}"), (6, "en", body[::-1])]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["status"] for r in engine.QUERIES["near_dup_greedy"](spark, str(tmp_path)).collect()}
    assert got == {1: "kept", 2: "near_duplicate", 3: "kept", 4: "near_duplicate", 5: "exact_duplicate", 6: "kept"}


@pytest.mark.parametrize("n", [38, 39, 40, 44])
def test_source_mix_of_any_number_of_documents(spark, tmp_path, n):
    rows = [{"doc_id": i, "lang": ("en", "de")[i % 3 == 0]} for i in range(n)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = sorted(con.execute(engine.SQL["source_mix"]).fetchall())
    assert sorted((r["source_id"],) for r in reports.source_mix(spark, str(tmp_path)).collect()) == want
