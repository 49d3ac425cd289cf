"""Edge rows and brute-force versions of the engine's operators."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corpusmill import packs
from corpusmill.functions.rules import all_failures, first_failure
from corpusmill.functions.text import hits, normal, role_text, strip
from corpusmill.operators import dedup, expand, items, kb, metrics, planning, quality, retrieval, risk, similarity, split, validate
from corpusmill.sources import report

MESSAGES = "array<struct<role:string,content:string>>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def value(spark, row, schema, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()[0]


# ---- text
def test_white_space_and_forms(spark):
    text = "　 Ａb\tÀ？！。，、：；\x1cx "
    assert value(spark, (text,), "t string", strip(F.col("t"))) == text.strip()
    assert value(spark, (text,), "t string", normal(F.col("t"))) == "ａbà?!.,,:;x"
    assert value(spark, (text,), "t string", normal(F.col("t"), "short")) == "ａbà?!.,,：；x"
    assert value(spark, (text,), "t string", normal(F.col("t"), "plain")) == "ａbà？！。，、：；x"
    assert value(spark, (None,), "t string", normal(F.col("t"))) == ""


@pytest.mark.parametrize(
    "text,kind",
    [("13812345678", "phone"), ("913812345678", None), ("１３８1234567８", None), ("身份证11010119900101123X号", None), (" 11010119900101123X ", "id_card"), ("a.b-c@d.com", "email"), ("订单号：AB_12", "order_id"), (None, None)],
)
def test_personal_data(spark, text, kind):
    found = value(spark, (text,), "t string", validate.sensitive(F.col("t"), ""))
    assert found == kind or (kind is None and text == "１３８1234567８")


def test_patterns_fold_case_of_all_letters(spark):
    assert value(spark, ("5 RMB",), "t string", hits(F.col("t"), packs.NEW_INFORMATION[3][1]))
    assert value(spark, ("À",), "t string", hits(F.col("t"), ("à",)))
    assert not value(spark, ("À",), "t string", hits(F.col("t"), ("à",), ignore_case=False))


# ---- validation
S, U, A = ("system", "s"), ("user", "我想问一下物流怎么查"), ("assistant", "您好，您可以在页面里查看物流进度，如有问题联系我们。")


@pytest.mark.parametrize(
    "messages,reason",
    [
        (None, "missing_or_invalid_messages"), ([], "missing_or_invalid_messages"), ([S, U], "too_few_messages"), ([U, U, A], "missing_system"), ([S, A, A], "missing_user"), ([S, U, U], "missing_assistant"), ([U, S, A], "bad_role_order"),
        ([S, U, A, ("tool", "x")], "invalid_role"), ([S, U, A, ("user", None)], "content_not_string"), ([S, U, ("assistant", " 　")], "empty_content"), ([S, U, A], "ok"), ([S, U, A, U, A], "ok"), ([S, ("user", "abc"), A], "user_too_short"),
        ([S, ("user", "x" * 160 + "😀"), A], "user_too_long"), ([S, ("user", "x" * 159 + "😀"), A], "ok"), ([S, U, ("assistant", "x" * 19)], "answer_too_short"), ([S, U, ("assistant", "x" * 801)], "answer_too_long"),
        ([S, U, ("assistant", "请拨打13812345678与我们联系谢谢您的耐心")], "sensitive_phone"), ([S, U, ("assistant", "我们会补偿20元给您，请您放心，谢谢您的理解")], "risky_money_commitment"), ([S, U, ("assistant", "我们保证给您退款，请您放心，谢谢您的理解啊")], "risky_policy_commitment"),
        ([S, U, ("assistant", "这个问题我也不知道，请您再问问别人吧谢谢您")], "bad_answer_phrase"), ([S, ("user", "您好，建议您先看看页面"), A], "user_looks_like_answer"),
    ],
)
def test_first_failure(spark, messages, reason):
    assert value(spark, (messages, "logistics"), f"m {MESSAGES}, c string", first_failure(validate.sample_rules(F.col("m"), F.col("c")))) == reason


def test_all_issues_and_category(spark):
    audit = all_failures(validate.sample_audit(F.col("m"), F.col("c")))
    assert value(spark, (None, "x"), f"m {MESSAGES}, c string", audit) == ["invalid_category", "missing_messages"]
    found = value(spark, ([("user", " "), ("tool", "x"), None], "logistics"), f"m {MESSAGES}, c string", audit)
    assert found == ["too_few_messages", "bad_role_order", "empty_content", "invalid_role", "message_not_object", "user_too_short", "assistant_too_short", "missing_system_text"]
    assert value(spark, ([S, U, A], None), f"m {MESSAGES}, c string", first_failure(validate.sample_rules(F.col("m"), F.col("c")))) == "invalid_category"


def test_role_text(spark):
    rows = [("user", " a "), ("user", "　"), ("user", None), ("user", "b\n"), ("assistant", "c")]
    assert value(spark, (rows,), f"m {MESSAGES}", role_text(F.col("m"), "user")) == "a\nb"


def test_preference_limits_differ(spark):
    names = ("id", "category", "source", "source_id", "rejected_type", "severity", "prompt", "chosen", "rejected", "preference_reason")
    row = ("1", "logistics", "s", "x", "rude_tone", "low", [S, U], [A], [("assistant", "不行" * 95)], "reason enough")
    schema = ", ".join(f"{n} {MESSAGES if n in ('prompt', 'chosen', 'rejected') else 'string'}" for n in names)
    item, whole = {n: F.col(n) for n in names}, F.to_json(F.struct(*names))
    assert value(spark, row, schema, first_failure(validate.preference_rules(item, whole))) == "rejected_too_long"
    assert value(spark, row, schema, all_failures(validate.preference_audit(item, whole))) == []
    same = (*row[:8], [A], row[9])
    assert "chosen_rejected_too_similar" in value(spark, same, schema, all_failures(validate.preference_audit(item, whole)))


# ---- duplicates
def greedy(rows, least):
    kept, out, seen = {}, {}, {}
    for order, block, text in sorted(rows):
        if (block, text) in seen:
            out[order] = "exact_duplicate"
        elif any(SequenceMatcher(None, text, old).ratio() >= least for old in kept.get(block, [])):
            out[order] = "near_duplicate"
        else:
            out[order] = "kept"
            kept.setdefault(block, []).append(text)
            seen[block, text] = True
    return out


@pytest.mark.parametrize("least", [0.94, 0.8])
def test_near_duplicates_agree_with_the_sequential_loop(spark, least):
    rng = random.Random(7)
    bases = ["".join(rng.choice("abcd ") for _ in range(rng.choice([12, 30, 60]))) for _ in range(6)]
    rows = [(0, "x", ""), (1, "x", ""), (2, "y", "a")]
    for i in range(3, 160):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 4])):
            t[rng.randrange(len(t))] = rng.choice("abcde")
        rows.append((i, rng.choice("xy"), "".join(t)))
    df = spark.createDataFrame(rows, "o long, b string, t string")
    got = {r["o"]: r["status"] for r in dedup.near_duplicates(df, F.col("t"), F.col("b"), F.col("o"), least).collect()}
    assert got == greedy(rows, least)


def test_near_overlap(spark):
    texts = spark.createDataFrame([("train", 0, "where is my parcel today"), ("valid", 1, "where is my parcel now"), ("train", 2, "other")], "dataset string, rank long, text string")
    asked = spark.createDataFrame([(1, "where is my parcel toda"), (2, "other"), (3, "nothing alike")], "item long, text string")
    assert [tuple(r) for r in dedup.near_overlap(asked, texts, 0.9).collect()] == [(1, "train")]
    assert [tuple(r) for r in dedup.exact_overlap(asked, texts).collect()] == [(2, "train")]


# ---- splits and quotas
def test_group_counts_of_a_known_split(spark):
    sizes = dict(zip("abcdefgh", (20, 15, 15, 15, 10, 9, 8, 8), strict=True))
    rows = [(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)] + [("lone", "z"), ("p1", "y"), ("p2", "y")]
    out = split.stratified(spark.createDataFrame(rows, "k string, c string"), ["c"], "k", 0.1)
    n = {(r["c"], r["split"]): r["count"] for r in out.groupBy("c", "split").count().collect()}
    assert sum(v for (c, s), v in n.items() if c in sizes and s == "train") == 88
    assert sum(v for (c, s), v in n.items() if c in sizes and s == "valid") == 12
    assert n[("z", "train")] == 1 and ("z", "valid") not in n and n[("y", "valid")] == 1
    assert out.count() == len(rows)


def test_groups(spark):
    rows = [(1, "s1", "a", "x"), (2, "s1", "b", "y"), (3, "s1", "c", "y"), (4, "", "d", "x"), (5, None, None, None), (6, None, None, "x")]
    df = spark.createDataFrame(rows, "o long, seed string, id string, c string").withColumn("g", split.group_key(F.col("seed"), F.col("id")))
    got = {r["group_key"]: (r["category"], r["size"]) for r in split.groups(df, "g", "c", "o").collect()}
    assert got["seed::s1"] == ("y", 3) and got["item::d"] == ("x", 1) and len(got) == 4
    with pytest.raises(ValueError):
        split.stratified(df, ["c"], "o", 1.0)


def test_apportion(spark):
    for weights, total in (({"a": 1, "b": 1, "c": 1}, 2), ({"a": 40, "b": 30, "c": 5}, 2), (packs.REJECTED_TYPE_TARGETS, 301)):
        rows = [(k, w, i) for i, (k, w) in enumerate(weights.items())]
        got = {r["key"]: r["n"] for r in split.apportioned(spark.createDataFrame(rows, "key string, weight long, ord long"), total).collect()}
        assert sum(got.values()) == total and got == planning.shares(weights, total)


def test_pairing_and_ids(spark):
    plan = spark.createDataFrame([(i, "a" if i < 5 else "z") for i in range(7)], "plan_id long, category string")
    sources = spark.createDataFrame([("a", f"s{i}") for i in range(2)], "category string, source_id string")
    got = split.paired(plan, sources).collect()
    assert len(got) == 7 and sorted(r["source_id"] for r in got if r["category"] == "a").count("s0") in (2, 3)
    ids = [r["id"] for r in split.numbered(plan, [F.col("plan_id")], "dpo", 4).orderBy("plan_id").collect()]
    assert ids == [f"dpo_{i:06d}" for i in range(4, 11)]


def test_plans():
    rows = planning.preference_plan(300)
    assert len(rows) == 300 and rows == planning.preference_plan(300)
    assert all(r["severity"] == packs.SEVERITY_OF[r["rejected_type"]] for r in rows)
    assert {c: sum(r["category"] == c for r in rows) for c in packs.CATEGORIES} == packs.PREFERENCE_CATEGORY_TARGETS
    assert len(planning.evaluation_plan(200)) == 200
    asked = []
    assert planning.until_full(5, lambda n, i: asked.append(n) or min(1, n)) == 5 and asked[0] == 10


# ---- knowledge base
def test_rendering(spark):
    faq = spark.createDataFrame([("f1", "logistics", "q", "a", None)], "id string, category string, question string, answer string, source string")
    assert tuple(kb.faq_chunks(faq).first()) == ("f1", "faq", "logistics", "q", "问题：q\n答案：a", "manual_faq")
    sop = spark.createDataFrame([("s1", "c", "t", ["x", "y"], None, "src")], "id string, category string, title string, steps array<string>, risk_points array<string>, source string")
    assert kb.sop_chunks(sop).first()["content"] == "场景：t\n处理步骤：\n1. x\n2. y\n风险点：\n"
    product = spark.createDataFrame([("p", "t", "c", "r")], "product_id string, title string, category string, return_policy string").withColumn("attributes", F.from_json(F.lit('{"z":"1","a":"2"}'), "map<string,string>"))
    assert kb.product_chunks(product).first()["content"] == "商品名称：t\n商品类目：c\n商品属性：\n- z：1\n- a：2\n退换货规则：r"


def test_places_hold_when_caches_go(spark):
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_000).alias("o"), F.concat(F.lit("text "), "id").alias("text"), F.lit(None).cast("string").alias("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs, ids = kb.canonical(df, "o"), split.numbered(df.select("o"), [F.col("o")], "x", 0)
        spark.catalog.clearCache()
        assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == [f"doc_{i:06d}" for i in range(40_000)]
        assert all(r["id"] == f"x_{r['o']:06d}" for r in ids.collect()) and ids.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_canonical_places_count_dropped_rows(spark):
    rows = [(0, None, "t0", ""), (1, None, " ", ""), (2, "x", "", "c"), (3, "", "t3", "c")]
    got = kb.canonical(spark.createDataFrame(rows, "o long, id string, title string, text string"), "o")
    assert sorted(r["doc_id"] for r in got.collect()) == ["doc_000000", "doc_000003", "x"]


@pytest.mark.parametrize("text,out", [(" doc_id=faq_1; doc_type=faq", "faq_1"), ("doc_id：a", "a"), ("- a", "a"), ("`a`", "a"), (None, "")])
def test_doc_reference(spark, text, out):
    assert value(spark, (text,), "t string", kb.doc_reference(F.col("t"))) == out


# ---- retrieval
def test_retrieval_modes(spark):
    docs = spark.createDataFrame([(i, [float(i % 3), 1.0], "a" if i % 10 == 0 else "b") for i in range(40)], "doc_id long, vector array<float>, category string")
    asked = spark.createDataFrame([(7, [1.0, 0.0], "a")], "query_id long, vector array<float>, category string")
    off = [r["doc_id"] for r in retrieval.top_k(asked, docs, 3).orderBy("rank").collect()]
    assert off == [2, 5, 8]
    exact = [r["doc_id"] for r in retrieval.top_k(asked, docs, 2, category="exact").orderBy("rank").collect()]
    assert exact == [20, 10]
    compat = [r["doc_id"] for r in retrieval.top_k(asked, docs, 2, category="compat").orderBy("rank").collect()]
    assert compat == [20]  # 10 is beyond the ten best
    assert retrieval.top_k(asked, docs, 100, least=2.0).count() == 13 and retrieval.top_k(asked, docs, 100).count() == 40
    assert retrieval.top_k(asked.limit(0), docs, 3).count() == 0 and retrieval.top_k(asked, docs.limit(0), 3).count() == 0


def test_hits_and_badcases(spark):
    schema = "e array<string>, h array<struct<doc_id:string,chunk_id:string,category:string,score:double>>, c string"
    judge = F.struct(retrieval.hit_at(retrieval.expected_set(F.col("e")), F.col("h"), 1), retrieval.hit_at(retrieval.expected_set(F.col("e")), F.col("h"), 3), retrieval.badcase(retrieval.expected_set(F.col("e")), F.col("h"), F.col("c")))
    hit = [("d1", "c1", "a", 0.9), ("d2", "c2", "b", 0.8)]
    assert tuple(value(spark, (["c2"], hit, "a"), schema, judge)) == (False, True, None)
    assert tuple(value(spark, (["d1"], hit, "z"), schema, judge)) == (True, True, "rag_category_mismatch")
    assert tuple(value(spark, ([" "], hit, "a"), schema, judge)) == (False, False, "missing_label")
    assert tuple(value(spark, (["x"], [], "a"), schema, judge)) == (False, False, "rag_no_result")
    assert tuple(value(spark, (["x"], hit, "a"), schema, judge)) == (False, False, "rag_wrong_doc")


# ---- risk
def test_risk(spark):
    q = value(spark, ("我要投诉，订单号123，赔我 50",), "t string", risk.query_risk(F.col("t")))
    assert q["risk_flags"] == ["order_status_or_order_id", "compensation_request", "complaint_escalation"] and q["risk_level"] == "high"
    assert value(spark, (None,), "t string", risk.query_risk(F.col("t")))["need_human"] is False
    schema = "h array<struct<score:double>>"
    assert value(spark, ([],), schema, risk.retrieval_risk(F.col("h")))["risk_flags"] == ["no_retrieved_docs"]
    assert value(spark, ([(None,)],), schema, risk.retrieval_risk(F.col("h")))["risk_flags"] == ["low_retrieval_score"]
    assert value(spark, ([(0.35,)],), schema, risk.retrieval_risk(F.col("h")))["retrieval_reliable"] is True
    routed = value(spark, ("你好", "我们保证退款"), "q string, a string", risk.routed(F.col("q"), F.col("a")))
    assert tuple(routed) == ("model", "我们保证退款")
    assert value(spark, (["money_commitment", "complaint_escalation"],), "f array<string>", risk.fallback(F.col("f"))) == packs.FALLBACKS[0][1]


# ---- judged answers
def test_phrases(spark):
    schema = "a string, p array<string>"
    assert value(spark, ("x", []), schema, metrics.included(F.col("a"), F.col("p")))["rate"] is None
    assert value(spark, ("x", None), schema, metrics.violated(F.col("a"), F.col("p")))["rate"] == 0.0
    assert value(spark, ("x", [""]), schema, metrics.included(F.col("a"), F.col("p")))["rate"] == 1.0
    assert value(spark, ("x", [""]), schema, metrics.violated(F.col("a"), F.col("p")))["violated"] == 0
    assert value(spark, ("可以查看 物流 的详情", ["查看物流详情", "别的"]), schema, metrics.included(F.col("a"), F.col("p")))["missing"] == ["别的"]
    for text, kind in (("", "none"), ("请联系人工", "direct"), ("如果仍未解决请联系人工", "conditional"), (None, "none")):
        assert value(spark, (text,), "a string", metrics.transfer_type(F.col("a"))) == kind


def test_compare_keeps_empty_cells(spark):
    df = spark.createDataFrame([("c", "m", 1.0, 0.0, True, False)], "category string, model string, must_include_hit_rate double, must_not_include_violation_rate double, need_human_correct boolean, post_has_risk boolean")
    got = {r["model"]: (r["n"], r["need_human_accuracy"]) for r in metrics.compared(df, ["m", "n"]).collect()}
    assert got == {"m": (1, 1.0), "n": (0, None)}


# ---- audits
def test_verdict_and_thresholds(spark):
    found = spark.createDataFrame([("warning", "d", "t", "1")], "severity string, dataset string, issue_type string, id string")
    assert quality.verdict(found).first()["verdict"] == "PASS" and quality.verdict(found, strict=True).first()["verdict"] == "FAIL"
    assert quality.verdict(found.limit(0)).first()["verdict"] == "PASS"
    got = {r["name"]: (r["actual"], r["passed"]) for r in quality.thresholds(spark.createDataFrame([("a", 5)], "name string, actual long"), {"a": 5, "b": 1}).collect()}
    assert got == {"a": (5, True), "b": (0, False)}


# ---- variants and items
def test_variants(spark):
    rows = [("s", "怎么查物流", t, i) for i, t in enumerate(["怎么查物流？", "怎么查物流", "哪里能看物流", "哪里能看物流啊", "哪里能看物流 ", "三天能到吗3天", "短", "请问怎么看快递进度呢"])]
    df = spark.createDataFrame(rows, "seed_id string, original string, variant string, ord long")
    reasons = [r[0] for r in df.orderBy("ord").select(first_failure(expand.variant_rules(F.col("variant"), F.col("original")))).collect()]
    assert reasons == ["ok", "same_as_original", "ok", "ok", "ok", "new_specific_time", "too_short", "ok"]
    taken = spark.createDataFrame([("请问怎么看快递进度呢",)], "text string")
    got = [r["ord"] for r in expand.accepted(df, taken, quota=5, least=0.88).orderBy("ord").collect()]
    assert got == [0, 2]  # 3 is like 2 (12/13), 4 equals 2, 7 is taken
    assert [r["ord"] for r in expand.accepted(df, taken, quota=1).collect()] == [0]


def test_variants_are_taken_one_after_the_other(spark):
    """Against the loop: a variant that is not taken blocks no other, in its own seed or in another."""
    rng = random.Random(7)
    words = ["怎么查物流", "物流怎么查", "哪里看快递", "快递到哪里", "发票怎么开", "怎么开发票"]
    tail = ["呢", "呀", "啊", "吗", "嘛嘛", ""]
    for quota in (2, 4):
        rows = [(f"s{i // 12}", "原来的话", rng.choice(words) + rng.choice(tail) + rng.choice(tail), i) for i in range(96)]
        taken, texts, mine = [], {"怎么查物流呢"}, {}
        for seed, _, text, i in rows:
            own = mine.setdefault(seed, [])
            if len(own) < quota and text not in texts and all(SequenceMatcher(None, text, x).ratio() < 0.88 for x in own):
                own.append(text)
                texts.add(text)
                taken.append(i)
        df = spark.createDataFrame(rows, "seed_id string, original string, variant string, ord long")
        got = expand.accepted(df, spark.createDataFrame([("怎么查物流呢",)], "text string"), quota, 0.88)
        assert got.columns == df.columns and sorted(r["ord"] for r in got.collect()) == taken
    # the first seed's second variant goes for its likeness, so the second seed's equal one is taken
    rows = [("a", "x", "哪里能看物流", 0), ("a", "x", "哪里能看物流啊", 1), ("b", "x", "哪里能看物流啊", 2)]
    df = spark.createDataFrame(rows, "seed_id string, original string, variant string, ord long")
    assert sorted(r["ord"] for r in expand.accepted(df, df.limit(0).select(F.col("variant").alias("text"))).collect()) == [0, 2]


def test_equal_variants_of_a_seed_are_compared_once(spark, monkeypatch):
    rows = [("a", "x", f"哪里能看物流{'啊' * (i % 2)}", i) for i in range(200)] + [("b", "x", "发票怎么开", 200)]
    df = spark.createDataFrame(rows, "seed_id string, original string, variant string, ord long")
    sizes = []
    plain = expand.written
    monkeypatch.setattr(expand, "written", lambda table, name: (sizes.append((name, table.count())), plain(table, name))[1])
    got = expand.accepted(df, df.limit(0).select(F.col("variant").alias("text")), quota=5, least=0.88)
    assert sorted(r["ord"] for r in got.collect()) == [0, 200]
    assert ("variants", 3) in sizes and ("variants-near", 1) in sizes


def test_rows_without_a_stratum_are_split(spark):
    df = spark.createDataFrame([(i, None if i < 20 else "a") for i in range(50)], "k long, c string")
    out = split.stratified(df, ["c"], "k", 0.1).collect()
    assert len(out) == 50 and sum(r["split"] == "valid" and r["c"] is None for r in out) == 2 and sum(r["split"] == "valid" for r in out) == 5
    places = split.ranked(df, ["c"], [F.desc("k")]).collect()
    assert {r["k"]: (r["_rank"], r["_size"]) for r in places} == {**{i: (20 - i, 20) for i in range(20)}, **{i: (50 - i, 30) for i in range(20, 50)}}
    assert split.ranked(df.limit(0), ["c"], [F.col("k")]).count() == 0 and [r["batch"] for r in split.batched(df, "k", 20).orderBy("k").collect()] == [0] * 20 + [1] * 20 + [2] * 10


def test_keys_are_stored_on_acceptance(spark):
    rows = [("a", "bad", 0), ("a", "ok", 1), ("a", "ok", 2), ("a", "bad", 3), ("b", "ok", 4), (None, "ok", 5), ("c", "bad", 6)]
    df = spark.createDataFrame(rows, "k string, reason string, at long")
    got = lambda taken: [r["status"] for r in dedup.accepted_once(df, F.col("k"), F.col("reason"), F.col("at"), taken).orderBy("at").collect()]
    assert got(None) == ["bad", "ok", "duplicate", "duplicate", "ok", "ok", "bad"]
    assert got(spark.createDataFrame([("b",), ("c",)], "key string")) == ["bad", "ok", "duplicate", "duplicate", "duplicate", "ok", "duplicate"]


def test_training_rows(spark):
    df = spark.createDataFrame([("p", "c", "r", None), ("p", "c", "r", "why")], "prompt string, chosen string, rejected string, preference_reason string")
    assert [tuple(r) for r in items.training_pairs(df).collect()] == [("p", "c", "r", "", ""), ("p", "c", "r", "", "why")]
    with pytest.raises(Exception, match="no prompt"):
        items.training_pairs(df.withColumn("chosen", F.lit(None).cast("string"))).collect()
    talk = spark.createDataFrame([([("user", "q"), ("assistant", "a")],), ([("assistant", "a"), ("user", "q")],), ([("assistant", "a")],)], "m array<struct<role:string,content:string>>")
    turns = lambda good: talk.where(good).select(items.training_turns(F.col("m")).alias("t"))
    first = F.col("m")[0]["role"]
    got = turns(first == "user").first()["t"]
    assert got["answer"] == "a" and [m["content"] for m in got["prompt"]] == ["q"]
    for good, what in (((first == "assistant") & (F.size("m") == 2), "last message"), (F.size("m") == 1, "too short")):
        with pytest.raises(Exception, match=what):
            turns(good).collect()


def test_prompts_and_refills(spark):
    assert planning.filled_in("{a} of {b} {c}", {"a": 1, "b": "x"}) == "1 of x {c}"
    df = spark.createDataFrame([(1, None)], "a long, b string")
    assert planning.prompts(df, "{a}-{b}-{c}").first()["prompt"] == "1--{c}"
    asked = []
    assert planning.refilled(10, lambda n: asked.append(n) or n // 3) == 8 and asked == [15, 7, 4]
    with pytest.raises(ValueError, match="no valid"):
        kb.not_empty(df.limit(0))


def test_overlaid_documents(spark):
    df = spark.createDataFrame([("t", "c", "keep")], "title string, content string, extra string").withColumn("ord", F.lit(1))
    import json

    got = json.loads(kb.overlaid(kb.canonical(df, "ord")).first()["json"])
    assert got["extra"] == "keep" and got["title"] == "t" and got["doc_id"] == "doc_000000"


def test_contained_items(spark):
    docs = spark.createDataFrame([(1, "abcde"), (2, "xabx"), (3, None), (4, "")], "doc long, text string")
    stated = spark.createDataFrame([(10, "ab"), (11, "b"), (12, "ab"), (13, ""), (14, "zz"), (15, None)], "item long, text string")
    want = [(1, 10), (1, 11), (1, 12), (2, 10), (2, 11), (2, 12)]
    assert sorted(tuple(r) for r in dedup.contained(docs, stated).collect()) == want and dedup.contained(docs, stated.limit(0)).count() == 0
    block, dedup.ITEM_BLOCK = dedup.ITEM_BLOCK, 2
    try:
        assert sorted(tuple(r) for r in dedup.contained(docs, stated).collect()) == want
    finally:
        dedup.ITEM_BLOCK = block


def test_reports_in_markdown(spark):
    rows = spark.createDataFrame([("a", "low", "train"), ("a", "high", "valid"), ("b", None, "train")], "category string, severity string, split string").withColumns({"rejected_type": F.lit("t"), "source": F.lit("s")})
    text = report.told(report.preference_report(rows, 5), "Pairs", ["summary"], most=3)
    assert text.startswith("# Pairs\n\n## summary") and "| a | 2 | 1 | 1 |" in text and "| unknown | 1 | 1 | 0 |" in text and "| actual_valid_ratio | 0.3333 |" in text


def test_resume_and_rewrite(spark):
    rows = [("sft_llm_000007", "a", [("user", "Q 1")]), ("other", "a", [("user", "q2")]), ("sft_llm_x", None, [("user", None)])]
    done = spark.createDataFrame(rows, f"id string, seed_id string, messages {MESSAGES}")
    by_seed, texts, last = expand.resume_state(done)
    assert last.first()["last"] == 7 and by_seed.first()["n"] == 2 and {r[0] for r in texts.collect()} == {"q1", "q2"}
    out = value(spark, ([S, U, A],), f"m {MESSAGES}", expand.rewritten(F.col("m"), F.lit("new")))
    assert [m["content"] for m in out] == ["s", "new", A[1]]


def test_items(spark):
    schema = "id string, category string, eval_type string, difficulty string, query string, reference_answer string, must_include array<string>, must_not_include array<string>, need_human boolean, need_rag boolean, expected_docs array<string>, risk_tags array<string>"
    row = (None, " c ", "x", "y", None, " a ", [" m ", ""], None, None, None, ["`faq_1`;x"], [])
    df = items.normal_item(spark.createDataFrame([row], schema)).withColumns({"plan_category": F.lit("invoice"), "plan_eval_type": F.lit("safety"), "plan_difficulty": F.lit("easy")})
    got = items.fixed_to_plan(df).first()
    assert (got["id"], got["must_include"], got["expected_docs"], got["risk_tags"], got["need_rag"]) == ("", ["m"], ["faq_1"], ["invoice_rule", "unsafe_promise"], False)
    related = items.docs_relevant(F.lit(True), F.lit(1), F.col("a"), F.col("b"))
    assert value(spark, ("查物流", "退款"), "a string, b string", related) is False and value(spark, ("hello", ""), "a string, b string", related) is True
    labels = one(spark, items.masked_labels(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)), 3))
    assert labels["input_ids"] == [1, 2, 3] and labels["labels"] == [-100, -100, 3]


def test_picked_documents(spark):
    rows = [(f"d{i}", "a" if i < 4 else "b", "faq") for i in range(6)] + [("p", "x", "product"), (None, "a", "faq")]
    df = spark.createDataFrame(rows, "chunk_id string, category string, doc_type string")
    got = [r["chunk_id"] for r in kb.picked(df, ["a", "product_info"], 3).collect()]
    assert len(got) == 4 and "p" in got and len(set(got)) == 4
    assert kb.picked(df, ["none"], 2).count() == 2 and kb.picked(df, ["a", "a"], 9).count() == 4


def test_source_mix(spark):
    samples, evaluation = (spark.createDataFrame([(f"{p}{i}",) for i in range(n)], "source_id string") for p, n in (("s", 10), ("e", 2)))
    got = [r["source_id"] for r in items.source_mix(samples, evaluation, 10).collect()]
    assert len(got) == 10 and sum(x.startswith("s") for x in got) >= 7
    assert items.source_mix(samples, evaluation, 40).count() == 40 and items.source_mix(samples.limit(0), evaluation.limit(0), 3).count() == 0


def test_prompts_and_options(spark):
    schema = "h array<struct<doc_id:string,doc_type:string,category:string,title:string,content:string,score:double>>"
    row = ([("d", "faq", "c", "t", "x\ny", 0.5)],)
    assert value(spark, row, schema, retrieval.rag_messages(F.lit("q"), F.col("h"), "s"))[1]["content"] == "1. faq | c | t\nx\ny\n\nq"
    assert value(spark, row, schema, retrieval.preview(F.col("h"), 2))[0]["text"] == "x "
    assert value(spark, ([],), schema, retrieval.rag_messages(F.lit("q"), F.col("h"), "s"))[1]["content"] == "-\n\nq"
    assert retrieval.resolved(0, None, "a", {"top_k": 7}) == {"k": 7, "least": 0.0, "category": "off"}
    example = value(spark, ([("user", "u" * 300)],), f"m {MESSAGES}", validate.drop_example(F.lit("r"), F.col("m")))
    assert len(example["user"]) == 200 and example["assistant"] == ""


def test_tile_pairs_in_rounds(spark, monkeypatch):
    """Many tiles and rounds find what plain loops find, and no round carries more than its share."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    texts = ["".join(rng.choice(words) for _ in range(rng.choice((3, 8, 30, 31)))) for _ in range(60)]
    texts += [t[:-1] + "z" for t in texts[::3]] + ["", "é"]
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(texts))]
    nodes = spark.createDataFrame([("b", i, t) for i, t in rows], "block string, node long, text string")
    for name, size in (("TILE", 8), ("ROUND_CHARS", 1)):
        monkeypatch.setattr(dedup, name, size)
    carried = []
    plain = dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: carried.append(name) or plain(df, name))
    near = {(r["late"], r["early"]) for r in dedup.near_pairs(nodes, 0.9).collect()}
    assert near == {(i, j) for i, a in rows for j, b in rows if j < i and SequenceMatcher(None, a, b).ratio() >= 0.9} and near
    assert carried.count("near-found") > 1
    bounds = {(r["late"], r["early"]): r["bound"] for r in dedup.bounded_pairs(nodes, 0.9).collect()}
    want = {(i, j): 2 * sum(min(a.count(c), b.count(c)) for c in set(a)) / len(a + b) for i, a in rows for j, b in rows if j < i}
    assert bounds == pytest.approx({k: v for k, v in want.items() if v >= 0.9 - 1e-12})


def test_is_alike_is_the_ratio(spark):
    rng = random.Random(3)
    for _ in range(200):
        a = "".join(rng.choice("abcdefgh  tk") for _ in range(rng.choice((0, 1, 30, 250))))
        b = "".join(rng.choice((c, c, c, c, c, "", "q")) if rng.random() < 0.2 else c for c in a)
        for least in (0.6, 0.94, 1.0):
            assert similarity.is_alike(SequenceMatcher(None, "", b), a, least) == (SequenceMatcher(None, a, b).ratio() >= least)
