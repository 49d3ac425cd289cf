"""Files in and out, providers, reports, the stream."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import jsonl, providers, report
from corpusmill.streaming.clean import clean_stream

SCHEMA = "id string, n long"


@pytest.fixture
def bad(tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"id": "a", "n": 1}\n\n{bad\n[1, 2]\n  \n{"id": "b"}', encoding="utf-8")
    return str(path)


def test_counting_and_issues(spark, bad, tmp_path):
    rows, errors = jsonl.read_counted(spark, bad, SCHEMA)
    assert [(r["_line"], r["id"], r["n"]) for r in rows.orderBy("_line").collect()] == [(1, "a", 1), (6, "b", None)]
    assert {r["error"]: r["n"] for r in errors.collect()} == {"json_decode_error": 1, "not_json_object": 1}
    _, issues = jsonl.read_issues(spark, bad, SCHEMA, "d")
    assert sorted((r["line"], r["issue_type"]) for r in issues.collect()) == [(3, "json_decode_error"), (4, "not_json_object")]
    assert jsonl.read_counted(spark, str(tmp_path / "none"), SCHEMA)[1].first()["error"] == "missing_file"
    assert jsonl.read_lenient(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_strict_and_lenient(spark, bad):
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read_strict(spark, bad, SCHEMA).collect()
    assert {"a", "b"} <= {r["id"] for r in jsonl.read_lenient(spark, bad, SCHEMA).collect()}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n long, _file string")
    path = str(tmp_path / "out")
    jsonl.write(df, path)
    assert spark.read.json(path).columns == ["id", "n"]
    assert jsonl.append_new(df.select("id", "n").unionByName(spark.createDataFrame([("c", 3)], SCHEMA)), path, "id") == 1
    assert jsonl.append_new(df.select("id", "n"), path, "id") == 0 and spark.read.json(path).count() == 3
    jsonl.write_object(str(tmp_path / "r.json"), {"a": {"b": "ü"}})
    assert jsonl.nested(jsonl.read_object(str(tmp_path / "r.json")), "a", "b") == "ü"
    assert jsonl.read_object(str(tmp_path / "no.json"), {"d": 1}) == {"d": 1} and jsonl.nested({}, "x", default=0) == 0


@pytest.mark.parametrize(
    "raw,out",
    [('```json\n["a", " b，"]\n```', ["a", "b"]), ('好的：["a","b"] 完', ["a", "b"]), ('["a", "b', ['["a", "b']), ("输出：\n1. a\n2、b\n- c\n]", ["a", "b", "c"]), ("", []), (None, []), ("[]", []), ("[1, null]", ["1", "None"])],
)
def test_answer_list(spark, raw, out):
    assert spark.createDataFrame([(raw,)], "t string").select(providers.answer_list(F.col("t"))).first()[0] == out


def test_answer_objects(spark):
    one = lambda raw, c: spark.createDataFrame([(raw,)], "t string").select(c(F.col("t"), "struct<a:long>")).first()[0]
    assert [r["a"] for r in one('x [{"a": 1}, 2, {"a": 3}] y', providers.answer_objects)] == [1, 3]
    assert one('```json\n{"a": 5}\n```', providers.answer_object)["a"] == 5 and one('so {"a": 6} it', providers.answer_object)["a"] == 6
    assert one("nothing", providers.answer_object) is None and one("[1]", providers.answer_objects) == []


def test_providers(spark):
    df = spark.createDataFrame([("ab",), ("c",), (None,)], "t string")
    got = providers.embedded(df, lambda: lambda texts: [[float(len(t)), 0.0] for t in texts], "t", prefix="q:").collect()
    assert sorted(r["vector"] for r in got) == [[1.0, 0.0]] * 3
    assert sorted(r["o"] for r in providers.generated(df.dropna(), lambda: lambda xs: [x * 2 for x in xs], "t", "o").collect()) == ["abab", "cc"]
    calls, naps = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError
        return x

    assert providers.with_retry(flaky, 3, 0.5, naps.append)(1) == 1 and naps == [0.5, 1.0]
    with pytest.raises(TypeError):
        providers.Retriever(object())


def test_reports(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "valid"), (None, "train")], "c string, s string")
    assert report.as_object(report.distributions(df, ["c"])) == {"c": {"a": 2, "unknown": 1}}
    assert report.markdown(report.side_by_side(df, "c", "s", ["train", "valid"]), ["c"]).splitlines()[2:] == ["| a | 1 | 1 |", "| unknown | 1 | 0 |"]
    assert report.cell(None) == "N/A" and report.cell(0.5) == "0.5000" and report.cell(3) == "3"


def test_stream_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    good = {"id": "1", "category": "logistics", "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "where is it?"}, {"role": "assistant", "content": "It is on its way to you now."}]}
    (source / "a.json").write_text("\n".join(json.dumps(r) for r in (good, good, {**good, "id": "2", "category": "x"})))
    schema = "id string, category string, messages array<struct<role:string,content:string>>"
    out, rejects = str(tmp_path / "out"), str(tmp_path / "rejects")
    for turn in range(2):
        clean_stream(spark.readStream.schema(schema).json(str(source)), out, rejects, str(tmp_path / f"cp{turn}")).awaitTermination()
    assert [r["id"] for r in spark.read.json(out).collect()] == ["1"]
    assert [(r["id"], r["reason"]) for r in spark.read.json(rejects).collect()] == [("2", "invalid_category")]


def test_lines_of_many_splits_are_numbered(spark, tmp_path):
    path = str(tmp_path / "many.jsonl")
    with open(path, "w") as out:
        out.writelines(("\n" if i % 7 == 0 else f'{{"a": {i}}}\n') for i in range(1, 40_001))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        every = jsonl.lines(spark, path)
        assert every.rdd.getNumPartitions() >= 4
        wrong = every.where(F.concat(F.lit('{"a": '), "_line", F.lit("}")) != F.col("value"))
        assert every.count() == 40_000 - 40_000 // 7 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_a_missing_file_may_be_empty(spark, tmp_path):
    assert jsonl.read_strict(spark, str(tmp_path / "none.jsonl"), "a long", required=False).count() == 0
