"""The engine's registered queries over the driver's tables, and their SQL.

Every query runs over whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill import packs
from corpusmill.functions.rules import all_failures, first_failure
from corpusmill.functions.text import normal, role_text
from corpusmill.operators import dedup, expand, items, kb, metrics, planning, quality, retrieval, risk, split, validate
from corpusmill.plans.registry import QUERIES, SQL, registered
from corpusmill.plans.tables import (
    ANSWERS, DIALOGUES, KB, PAIRS, answers, dialogues, sql_all_hits, sql_first_hit, sql_hits, sql_holds, sql_normal, sql_role, sql_strip, table, turn_pairs, vectors,
)
from corpusmill.plans.tables import kb as kb_table
from corpusmill.sources import providers, report
from corpusmill.sources.jsonl import parsed
from corpusmill.store import written

__all__ = ["QUERIES", "SQL"]

def _md5(column):
    return F.md5(column)


# ---------------------------------------------------------------- samples: texts, normal forms, validation
_ROLES3 = {r: sql_role("messages", r) for r in packs.ROLES}


@registered(f"SELECT id, {_ROLES3['system']} AS system, {_ROLES3['user']} AS user_text, {_ROLES3['assistant']} AS assistant FROM ({DIALOGUES})")
def sft_extract_roles(spark, d):
    return dialogues(spark, d).select("id", role_text(F.col("messages"), "system").alias("system"), role_text(F.col("messages"), "user").alias("user_text"), role_text(F.col("messages"), "assistant").alias("assistant"))


@registered("SELECT doc_id, " + ", ".join(f"md5({sql_normal('text', f)}) AS {f}_md5" for f in ("full", "short", "plain")) + " FROM documents")
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", *[_md5(normal(F.col("text"), f)).alias(f"{f}_md5") for f in ("full", "short", "plain")])


def _sql_first_failure(user_chars, answer_chars) -> str:
    """The cleaning rules over rows with messages, category, u, a and s (role texts)."""
    roles = "list_transform(messages, lambda m: m.role)"
    each = f"list_filter(list_transform(messages, lambda m: CASE WHEN m.role IS NULL OR m.role NOT IN ('system', 'user', 'assistant') THEN 'invalid_role' WHEN m.content IS NULL THEN 'content_not_string' WHEN {sql_strip('m.content')} = '' THEN 'empty_content' END), lambda x: x IS NOT NULL)"
    cats = ", ".join(f"'{c}'" for c in packs.CATEGORIES)
    question, strong = sql_holds("u", packs.QUESTION_MARKERS), sql_holds("u", packs.ANSWER_STRONG)
    weak = " + ".join(f"contains(u, '{p}')::INT" for p in packs.ANSWER_WEAK)
    return f"""CASE WHEN messages IS NULL OR len(messages) < 1 THEN 'missing_or_invalid_messages' WHEN len(messages) < 3 THEN 'too_few_messages'
      WHEN NOT list_contains({roles}, 'system') THEN 'missing_system' WHEN NOT list_contains({roles}, 'user') THEN 'missing_user' WHEN NOT list_contains({roles}, 'assistant') THEN 'missing_assistant'
      WHEN {roles}[1:3] <> ['system', 'user', 'assistant'] THEN 'bad_role_order' WHEN len({each}) > 0 THEN {each}[1]
      WHEN category NOT IN ({cats}) THEN 'invalid_category'
      WHEN length(u) < {user_chars[0]} THEN 'user_too_short' WHEN length(u) > {user_chars[1]} THEN 'user_too_long' WHEN length(a) < {answer_chars[0]} THEN 'answer_too_short' WHEN length(a) > {answer_chars[1]} THEN 'answer_too_long'
      WHEN {sql_first_hit("u || chr(10) || a", packs.SENSITIVE)} IS NOT NULL THEN {sql_first_hit("u || chr(10) || a", packs.SENSITIVE, "sensitive_")}
      WHEN {sql_hits("a", packs.MONEY_COMMITMENT)} THEN 'risky_money_commitment' WHEN {sql_hits("a", packs.POLICY_COMMITMENT)} THEN 'risky_policy_commitment'
      WHEN {sql_holds("a", packs.BAD_ANSWERS)} THEN 'bad_answer_phrase' WHEN NOT {question} AND ({strong} OR {weak} >= 2) THEN 'user_looks_like_answer'
      WHEN s = '' THEN 'empty_system' ELSE 'ok' END"""


_TEXTS = f"SELECT *, {_ROLES3['system']} AS s, {_ROLES3['user']} AS u, {_ROLES3['assistant']} AS a FROM"
_PAIR_MESSAGES = f"SELECT *, [{{'role': 'system', 'content': 's'}}, {{'role': 'user', 'content': \"user\"}}, {{'role': 'assistant', 'content': answer}}] AS messages FROM ({PAIRS})"
WIDE = {"user_chars": (4, 400), "answer_chars": (20, 2000)}


@registered(f"SELECT category, {_sql_first_failure((4, 160), (20, 800))} AS reason, count(*) AS n FROM ({_TEXTS} ({DIALOGUES})) GROUP BY 1, 2")
def drop_reason_histogram(spark, d):
    rows = dialogues(spark, d)
    return rows.groupBy("category", first_failure(validate.sample_rules(F.col("messages"), F.col("category"))).alias("reason")).agg(F.count("*").alias("n"))


@registered(f"SELECT id, {_sql_first_failure(WIDE['user_chars'], WIDE['answer_chars'])} AS reason FROM ({_TEXTS} ({_PAIR_MESSAGES}))")
def validate_first_failure(spark, d):
    return turn_pairs(spark, d).select("id", first_failure(validate.sample_rules(F.col("messages"), F.col("category"), **WIDE)).alias("reason"))


_AUDIT = f"""SELECT id, unnest(list_filter(list_concat([
    CASE WHEN len(messages) < 3 THEN 'too_few_messages' END, CASE WHEN list_transform(messages, lambda m: m.role)[1:3] IS DISTINCT FROM ['system', 'user', 'assistant'] THEN 'bad_role_order' END],
    flatten(list_transform(messages, lambda m: [CASE WHEN m.role NOT IN ('system', 'user', 'assistant') THEN 'invalid_role' END, CASE WHEN {sql_strip("m.content")} = '' THEN 'empty_content' END])),
    [CASE WHEN length(u) < 4 THEN 'user_too_short' END, CASE WHEN length(a) < 20 THEN 'assistant_too_short' END, {sql_first_hit("u || chr(10) || a", packs.SENSITIVE, "sensitive_")},
     CASE WHEN {sql_hits("a", packs.ASSISTANT_COMMITMENT)} THEN 'risky_assistant_commitment' END, CASE WHEN {sql_holds("a", packs.BAD_ANSWERS)} THEN 'bad_answer_phrase' END, CASE WHEN s = '' THEN 'missing_system_text' END]
  ), lambda x: x IS NOT NULL)) AS issue_type FROM ({_TEXTS} ({DIALOGUES}))"""


@registered(_AUDIT)
def validate_all_issues(spark, d):
    return dialogues(spark, d).select("id", F.explode(all_failures(validate.sample_audit(F.col("messages"), F.col("category")))).alias("issue_type"))


@registered(f"SELECT id, CASE WHEN category NOT IN ({', '.join(repr(c) for c in packs.CATEGORIES)}) THEN 'invalid_category' WHEN NOT list_contains(list_transform(messages, lambda m: m.role), 'user') THEN 'missing_user' WHEN NOT list_contains(list_transform(messages, lambda m: m.role), 'assistant') THEN 'missing_assistant' ELSE 'ok' END AS reason FROM ({DIALOGUES})")
def validate_before_split(spark, d):
    return dialogues(spark, d).select("id", first_failure(validate.split_rules(F.col("messages"), F.col("category"))).alias("reason"))


@registered(f"SELECT doc_id, {sql_first_hit('text', packs.SENSITIVE, 'sensitive_')} AS kind FROM documents")
def pii_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", validate.sensitive(F.col("text")).alias("kind"))


# ---------------------------------------------------------------- risk
def _sql_risk(e: str, kinds) -> str:
    return f"array_to_string({sql_all_hits(e, kinds, False)}, ',')"


@registered(f"SELECT doc_id, f <> '' AS need_human, CASE WHEN f <> '' THEN 'high' ELSE 'low' END AS risk_level, f AS flags FROM (SELECT doc_id, {_sql_risk('text', packs.QUERY_RISKS)} AS f FROM documents)")
def risk_precheck(spark, d):
    r = risk.query_risk(F.col("text"))
    return table(spark, d, "documents").select("doc_id", r["need_human"].alias("need_human"), r["risk_level"].alias("risk_level"), F.array_join(r["risk_flags"], ",").alias("flags"))


@registered(f"SELECT doc_id, f <> '' AS has_risk, f AS flags FROM (SELECT doc_id, {_sql_risk('text', packs.ANSWER_RISKS)} AS f FROM documents)")
def risk_postcheck(spark, d):
    r = risk.answer_risk(F.col("text"))
    return table(spark, d, "documents").select("doc_id", r["has_risk"].alias("has_risk"), F.array_join(r["risk_flags"], ",").alias("flags"))


_HIT_SCORE = "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 100) / 100.0 END"


def _with_hits(spark, d):
    docs = table(spark, d, "documents")
    score = (F.col("doc_id") % 100) / 100.0
    return docs.withColumn("hits", F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<struct<score:double>>")).otherwise(F.array(F.struct(score.alias("score")))))


def _sql_fallback(flags: str) -> str:
    return "CASE " + " ".join(f"WHEN list_has_any({flags}, {list(names)!r}) THEN '{text}'" for names, text in packs.FALLBACKS[:-1]) + f" ELSE '{packs.FALLBACKS[-1][1]}' END"


_FLAGGED = f"""SELECT doc_id, text, list_concat({sql_all_hits('text', packs.QUERY_RISKS, False)}, CASE WHEN doc_id % 11 = 0 THEN ['no_retrieved_docs'] WHEN (doc_id % 100) / 100.0 < 0.35 THEN ['low_retrieval_score'] ELSE [] END) AS f,
  {sql_all_hits('text', packs.ANSWER_RISKS, False)} AS g FROM documents"""


@registered(f"SELECT doc_id, CASE WHEN len(f) > 0 THEN 'fallback' ELSE 'model' END AS route, md5(CASE WHEN len(f) > 0 THEN {_sql_fallback('f')} ELSE text END) AS answer_md5 FROM ({_FLAGGED})")
def safe_route(spark, d):
    r = risk.routed(F.col("text"), F.col("text"), F.col("hits"))
    return _with_hits(spark, d).select("doc_id", r.alias("r")).select("doc_id", "r.route", _md5(F.col("r.answer")).alias("answer_md5"))


@registered(f"SELECT doc_id, len(x) > 0 AS need_human, array_to_string(x, ',') AS flags, md5(CASE WHEN len(x) > 0 THEN {_sql_fallback('x')} ELSE text END) AS answer_md5 FROM (SELECT doc_id, text, list_concat(f, g) AS x FROM ({_FLAGGED}))")
def risk_control(spark, d):
    r = risk.controlled(F.col("text"), F.col("text"), F.col("hits"), replace=True)
    return _with_hits(spark, d).select("doc_id", r.alias("r")).select("doc_id", "r.need_human", F.array_join("r.risk_flags", ",").alias("flags"), _md5(F.col("r.final_answer")).alias("answer_md5"))


# ---------------------------------------------------------------- duplicates and overlap
_NORM = sql_normal("text")


@registered(f"SELECT min(doc_id) AS doc_id, lang, count(*) AS n FROM documents GROUP BY lang, {_NORM}")
def exact_dedup(spark, d):
    rows = table(spark, d, "documents").withColumn("text", normal(F.col("text")))
    return rows.groupBy("lang", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("s")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "lang", "n")


@registered(f"SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, {_NORM} ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def exact_dedup_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.sha2(normal(F.col("text")), 256).alias("h"))
    return dedup.first_of(docs, [F.col("lang"), F.col("h")], [F.col("doc_id")]).drop("h")


@registered(f"""
WITH t AS (SELECT min(doc_id) AS node, x AS text, lang AS block, length(x) AS n FROM (SELECT doc_id, lang, {_NORM} AS x FROM documents) GROUP BY x, lang),
h AS (SELECT node, c, count(*) AS k FROM (SELECT node, unnest(string_split(text, '')) AS c FROM t) WHERE c <> '' GROUP BY ALL),
p AS (SELECT l.node AS late, r.node AS early, l.n + r.n AS chars FROM t l JOIN t r ON l.block = r.block AND r.node < l.node
      WHERE CASE WHEN l.n + r.n = 0 THEN 1.0 ELSE 2.0 * least(l.n, r.n) / (l.n + r.n) END >= 0.94 - 1e-12),
s AS (SELECT late, early, sum(least(a.k, b.k)) AS shared FROM p JOIN h a ON a.node = late JOIN h b ON b.node = early AND b.c = a.c GROUP BY ALL)
SELECT late, early, round(2.0 * coalesce(shared, 0) / chars, 9) AS bound FROM p LEFT JOIN s USING (late, early) WHERE 2.0 * coalesce(shared, 0) / chars >= 0.94 - 1e-12""")
def near_dup_prefilter_pairs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("block"), normal(F.col("text")).alias("text"))
    nodes = written(rows.groupBy("block", "text").agg(F.min("doc_id").alias("node")), "near-nodes")
    pairs = dedup.bounded_pairs(nodes, 0.94)
    return pairs.select("late", "early", F.round("bound", 9).alias("bound"))


@registered()
def near_dup_greedy(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", normal(F.col("text")).alias("text"))
    return dedup.near_duplicates(rows, F.col("text"), F.col("lang"), F.col("doc_id"), 0.94).select("doc_id", "status")


def _labelled(spark, d):
    docs, known = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id")
    texts = docs.select("doc_id", "lang", F.sha2(normal(F.col("text")), 256).alias("text"))
    return texts.join(known, "doc_id", "left_semi"), texts.join(known, "doc_id", "left_anti")


@registered(f"""WITH t AS (SELECT doc_id, lang, sha256({_NORM}) AS h, doc_id IN (SELECT doc_id FROM labels) AS y FROM documents)
SELECT t.doc_id AS item, k.lang AS dataset FROM t JOIN (SELECT h, max_by(lang, doc_id) AS lang FROM t WHERE y GROUP BY h) k USING (h) WHERE NOT y""")
def overlap_exact(spark, d):
    train, rest = _labelled(spark, d)
    return dedup.exact_overlap(rest.select(F.col("doc_id").alias("item"), "text"), train.select(F.col("lang").alias("dataset"), F.col("doc_id").alias("rank"), "text"))


@registered(f"""SELECT doc_id AS doc, item_id AS item FROM (SELECT doc_id, {_NORM} AS t FROM documents) d JOIN (SELECT item_id, {_NORM} AS i FROM benchmark) b ON contains(t, i) WHERE i <> ''""")
def overlap_contains(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), normal(F.col("text")).alias("text"))
    return dedup.contained(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("item"), normal(F.col("text")).alias("text")))


@registered()
def overlap_near(spark, d):
    """Documents without labels, against those with."""
    docs, known = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id")
    rows = docs.select("doc_id", "lang", normal(F.col("text")).alias("text"))
    train, rest = rows.join(known, "doc_id", "left_semi"), rows.join(known, "doc_id", "left_anti")
    return dedup.near_overlap(rest.select(F.col("doc_id").alias("item"), "text"), train.select(F.col("lang").alias("dataset"), F.col("doc_id").alias("rank"), "text"))


# ---------------------------------------------------------------- audits
@registered(f"WITH s AS ({DIALOGUES}) SELECT DISTINCT seed_id FROM s WHERE len(messages) >= 6 AND seed_id IN (SELECT seed_id FROM s WHERE len(messages) < 6)")
def seed_leakage(spark, d):
    rows = dialogues(spark, d)
    return quality.leaked(rows.where(F.size("messages") >= 6), rows.where(F.size("messages") < 6), "seed_id")


@registered("""WITH e AS (SELECT item_id AS item, unnest(['doc_' || item_id, 'doc_' || item_id * 37, 'doc_' || item_id * 997]) AS doc_id FROM benchmark)
SELECT item, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS missing FROM e WHERE doc_id NOT IN (SELECT 'doc_' || doc_id FROM documents) GROUP BY item""")
def missing_expected_docs(spark, d):
    expected = F.array(*[F.concat(F.lit("doc_"), F.col("item_id") * k) for k in (1, 37, 997)])
    items_ = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), expected.alias("expected_docs"))
    return quality.missing_docs(items_, kb_table(spark, d).select(F.col("chunk_id").alias("doc_id"))).select("item", F.array_join("missing", ",").alias("missing"))


@registered(f"SELECT md5({_NORM}) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return quality.duplicates(table(spark, d, "documents"), _md5(normal(F.col("text"))))


_KB_AUDIT = f"""SELECT chunk_id AS id, unnest(list_filter(['invalid_doc_type', 'invalid_category', CASE WHEN {sql_strip('title')} = '' THEN 'missing_title' END,
  CASE WHEN length({sql_strip('content')}) < 10 THEN 'content_too_short' END, {sql_first_hit("title || chr(10) || content", packs.SENSITIVE, "sensitive_")}], lambda x: x IS NOT NULL)) AS issue_type FROM ({KB})"""


def _kb_rules():
    key = validate.kb_key(F.col("chunk_id"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return key, validate.kb_audit(key, F.col("doc_type"), F.col("category"), F.col("title"), F.col("content"))


@registered(_KB_AUDIT)
def kb_audit(spark, d):
    key, rules = _kb_rules()
    return quality.issues(kb_table(spark, d), "kb_all", key, rules).select("id", "issue_type")


def _issues(spark, d):
    key, rules = _kb_rules()
    rows, docs = dialogues(spark, d), kb_table(spark, d)
    return (
        quality.issues(rows, "sft_train", F.col("id"), validate.sample_audit(F.col("messages"), F.col("category")))
        .unionByName(quality.issues(docs, "kb_all", key, rules))
        .unionByName(quality.duplicate_issues(docs, "kb_all", _md5(normal(F.col("content"))), "duplicate_content", "warning", False))
    )


_ISSUES = f"""SELECT 'error' AS severity, 'sft_train' AS dataset, issue_type FROM ({_AUDIT}) UNION ALL SELECT 'error', 'kb_all', issue_type FROM ({_KB_AUDIT})
  UNION ALL SELECT 'warning', 'kb_all', 'duplicate_content' FROM (SELECT 1 FROM documents GROUP BY {_NORM} HAVING count(*) > 1)"""


@registered(f"""SELECT CASE grouping(severity, dataset, issue_type) WHEN 7 THEN 'total' WHEN 3 THEN 'severity' WHEN 5 THEN 'dataset' ELSE 'issue_type' END AS section,
  coalesce(severity, dataset, issue_type, 'all') AS key, count(*) AS n FROM ({_ISSUES}) GROUP BY GROUPING SETS ((), (severity), (dataset), (issue_type))""")
def issue_rollup(spark, d):
    return quality.rolled_up(_issues(spark, d))


@registered(f"SELECT count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings, CASE WHEN count(*) FILTER (severity = 'error') = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({_ISSUES})")
def quality_verdict(spark, d):
    return quality.verdict(_issues(spark, d))


@registered("""WITH c AS (SELECT 'kb_all_min' AS name, count(*) AS actual FROM documents UNION ALL SELECT 'eval_set_min', count(*) FROM benchmark UNION ALL SELECT 'sft_train_min', count(DISTINCT conv_id) FROM conversations)
SELECT m.name, coalesce(actual, 0)::BIGINT AS actual, least::BIGINT AS least, coalesce(actual, 0) >= least AS passed
FROM (VALUES ('sft_train_min', 1800), ('sft_valid_min', 200), ('eval_set_min', 200), ('dpo_total_min', 300), ('dpo_valid_min', 20), ('kb_all_min', 80)) m(name, least) LEFT JOIN c USING (name)""")
def threshold_gate(spark, d):
    n = lambda name, df: df.agg(F.count("*").alias("actual")).select(F.lit(name).alias("name"), "actual")
    counts = report.merged([n("kb_all_min", table(spark, d, "documents")), n("eval_set_min", table(spark, d, "benchmark")), n("sft_train_min", table(spark, d, "conversations").select("conv_id").distinct())])
    return quality.thresholds(counts)


@registered("SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY tag")
def tag_frequency(spark, d):
    return quality.tag_counts(table(spark, d, "documents").select(F.array("lang", "source").alias("tags")), "tags")


@registered("SELECT lang, count(text) AS n, min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 2) AS average FROM documents GROUP BY lang")
def length_stats(spark, d):
    return quality.length_stats(table(spark, d, "documents"), F.col("text"), "lang")


@registered("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def count_by_priority(spark, d):
    return quality.counted(table(spark, d, "orders"), "o_orderpriority")


# ---------------------------------------------------------------- groups, splits, quotas
_GROUPS = """SELECT group_key, c AS category, size, n_categories FROM (
  SELECT 'seed::' || user_id AS group_key, event_type AS c, count(*) AS n, min(event_id) AS f, sum(count(*)) OVER (PARTITION BY user_id)::BIGINT AS size, count(*) OVER (PARTITION BY user_id) AS n_categories,
    row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS k FROM events GROUP BY user_id, event_type) WHERE k = 1"""


def _groups(spark, d):
    keyed = table(spark, d, "events").withColumn("group_key", split.group_key(F.col("user_id").cast("string"), F.col("event_id").cast("string")))
    return split.groups(keyed, "group_key", "event_type", "event_id")


@registered(_GROUPS)
def group_mode_category(spark, d):
    return _groups(spark, d)


@registered(f"SELECT group_key, n_categories FROM ({_GROUPS}) WHERE n_categories > 1")
def group_conflicts(spark, d):
    return _groups(spark, d).where("n_categories > 1").select("group_key", "n_categories")


def _sql_split(rows: str, strata: str, key: str) -> str:
    return f"""SELECT {key}, {strata}, CASE WHEN k <= CASE WHEN n = 1 THEN 0 ELSE least(greatest(round_even(n * 0.1::DOUBLE, 0), 1), n - 1) END THEN 'valid' ELSE 'train' END AS split FROM (
      SELECT {key}, {strata}, count(*) OVER (PARTITION BY {strata}) AS n, row_number() OVER (PARTITION BY {strata} ORDER BY md5('42:' || {key}), {key}) AS k FROM ({rows}))"""


@registered(_sql_split(_GROUPS, "category", "group_key"))
def stratified_group_split(spark, d):
    return split.stratified(_groups(spark, d), ["category"], "group_key", 0.1).select("group_key", "category", "split")


@registered(_sql_split("SELECT doc_id, lang, source FROM documents", "lang, source", "doc_id"))
def stratified_item_split(spark, d):
    return split.stratified(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 0.1).select("doc_id", "lang", "source", "split")


@registered(f"SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid FROM ({_sql_split('SELECT doc_id, lang, source FROM documents', 'lang, source', 'doc_id')}) GROUP BY source")
def split_pivot_report(spark, d):
    return report.side_by_side(stratified_item_split(spark, d), "source", "split", ["train", "valid"])


@registered("""WITH w AS (SELECT o_orderpriority AS key, count(*) AS weight FROM orders GROUP BY 1), r AS (SELECT key, weight, weight * 300 / sum(weight) OVER () AS raw FROM w)
SELECT key, weight, (floor(raw) + (row_number() OVER (ORDER BY raw - floor(raw) DESC, key) <= 300 - sum(floor(raw)) OVER ())::INT)::BIGINT AS n FROM r""")
def apportion_quota(spark, d):
    weights = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("weight")).withColumn("ord", F.col("key"))
    return split.apportioned(weights, 300).select("key", "weight", "n")


_LANGS = "['en', 'fr', 'de', 'es']"


@registered(f"""WITH s AS (SELECT lang AS category, doc_id AS source_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
p AS (SELECT item_id AS plan_id, {_LANGS}[item_id % 4 + 1] AS category, row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) - 1 AS turn FROM benchmark)
SELECT p.plan_id, p.category, s.source_id FROM p JOIN s ON s.category = p.category AND s.k = p.turn % s.n""")
def plan_source_pairing(spark, d):
    plan = table(spark, d, "benchmark").select(F.col("item_id").alias("plan_id"), F.element_at(F.lit(["en", "fr", "de", "es"]), (F.col("item_id") % 4 + 1).cast("int")).alias("category"))
    return split.paired(plan, table(spark, d, "documents").select(F.col("lang").alias("category"), F.col("doc_id").alias("source_id")))


@registered("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 3")
def sample_per_category(spark, d):
    return split.sampled(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 3)


@registered("SELECT format('eval_{:06d}', row_number() OVER (ORDER BY item_id) + 16) AS id, item_id FROM benchmark")
def id_assignment(spark, d):
    return split.numbered(table(spark, d, "benchmark").select("item_id"), [F.col("item_id")], "eval", 17).select("id", "item_id")


@registered("SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // 10 AS batch FROM benchmark")
def plan_batches(spark, d):
    return split.batched(table(spark, d, "benchmark").select("item_id"), "item_id", 10)


# ---------------------------------------------------------------- knowledge base
@registered(f"SELECT id AS chunk_id, 'faq' AS doc_type, category, \"user\" AS title, '问题：' || \"user\" || chr(10) || '答案：' || answer AS content, 'manual_faq' AS source FROM ({PAIRS})")
def kb_render_faq(spark, d):
    return kb.faq_chunks(turn_pairs(spark, d).select("id", "category", F.col("user").alias("question"), "answer", F.lit(None).cast("string").alias("source")))


@registered(f"""SELECT id AS chunk_id, 'sop' AS doc_type, category, id AS title, '场景：' || id || chr(10) || '处理步骤：' || chr(10) || array_to_string(list_transform(messages, lambda m, i: i || '. ' || m.content), chr(10))
  || chr(10) || '风险点：' || chr(10) || array_to_string(list_transform(messages, lambda m: '- ' || m.role), chr(10)) AS content, source FROM ({DIALOGUES})""")
def kb_render_sop(spark, d):
    rows = dialogues(spark, d)
    return kb.sop_chunks(rows.select("id", "category", F.col("id").alias("title"), F.transform("messages", lambda m: m["content"]).alias("steps"), F.transform("messages", lambda m: m["role"]).alias("risk_points"), "source"))


@registered("""SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, 'product' AS doc_type, 'product_info' AS category, p_name AS title,
  '商品名称：' || p_name || chr(10) || '商品类目：' || p_type || chr(10) || '商品属性：' || chr(10) || '- brand：' || p_brand || chr(10) || '- size：' || p_size || chr(10) || '退换货规则：' || p_brand AS content, 'manual_product' AS source FROM part""")
def kb_render_product(spark, d):
    attributes = F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string"))
    return kb.product_chunks(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), attributes.alias("attributes"), F.col("p_brand").alias("return_policy")))


@registered(f"SELECT chunk_id, md5('标题：' || title || chr(10) || '类型：' || doc_type || chr(10) || '类别：' || category || chr(10) || '内容：' || content) AS text_md5 FROM ({KB}) WHERE title <> ''")
def embedding_text(spark, d):
    return kb_table(spark, d).where("title <> ''").select("chunk_id", _md5(kb.embedding_text(F.col("title"), F.col("doc_type"), F.col("category"), F.col("content"))).alias("text_md5"))


@registered("SELECT format('doc_{:06d}', row_number() OVER (ORDER BY doc_id) - 1) AS doc_id, lang AS doc_type, source AS category, md5(text) AS content_md5 FROM documents")
def kb_canonical(spark, d):
    rows = table(spark, d, "documents").select("text", F.col("lang").alias("type"), F.col("source").alias("category"), F.col("doc_id").alias("ord"))
    return kb.canonical(rows, "ord").select("doc_id", "doc_type", "category", _md5(F.col("content")).alias("content_md5"))


# ---------------------------------------------------------------- retrieval
def _sql_top(where: str = "", k: int = 5) -> str:
    dot = "list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[])"
    return f"""SELECT query_id, rank, doc_id, round(score, 6) AS score, qc, dc FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {dot} AS score, q.label::VARCHAR AS qc, d.label::VARCHAR AS dc,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY {dot} DESC, d.vec_id)::INT AS rank FROM embeddings q JOIN embeddings d ON q.vec_id % 20 = 0 {where}) WHERE rank <= {k}"""


def _top(spark, d, **options):
    return retrieval.top_k(*vectors(spark, d), **options).withColumn("score", F.round("score", 6))


@registered(f"SELECT query_id, rank, doc_id, score FROM ({_sql_top()})")
def vector_topk(spark, d):
    return _top(spark, d)


@registered(f"SELECT query_id, rank, doc_id, score FROM ({_sql_top()}) WHERE score >= 0.3")
def vector_topk_threshold(spark, d):
    return _top(spark, d, least=0.3)


@registered(f"SELECT query_id, rank, doc_id, score FROM ({_sql_top('AND q.label = d.label')})")
def vector_topk_filtered_exact(spark, d):
    return _top(spark, d, category="exact")


_COMPAT = f"SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS rank, doc_id, score FROM ({_sql_top(k=25)}) WHERE qc = dc"


@registered(f"SELECT * FROM ({_COMPAT}) WHERE rank <= 5")
def vector_topk_filtered_compat(spark, d):
    return _top(spark, d, category="compat")


def _evaluated(spark, d):
    """Each query's hits against what is expected: the next two ids; every seventh query expects nothing."""
    queries, docs = vectors(spark, d)
    found = retrieval.top_k(queries, docs, 6).where("doc_id <> query_id")
    named = found.join(docs.select("doc_id", "category"), "doc_id")
    hit = F.struct("rank", F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("c"), "doc_id").alias("chunk_id"), "category", "score")
    hits = named.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(hit)), 1, 5).alias("hits"))
    best = F.element_at(F.col("hits"), (F.col("query_id") / 20 % 5 + 1).cast("int"))["doc_id"]
    expected = F.when(F.col("query_id") / 20 % 7 == 0, F.array().cast("array<string>")).when(F.col("query_id") / 20 % 3 == 0, F.array(F.lit("none"))).otherwise(F.array(best))
    return retrieval.evaluated(hits.join(queries.select("query_id", "category"), "query_id").withColumn("expected_docs", expected))


_EVALUATED = f"""SELECT query_id, qc AS category, x, e, top1_score, top_c, list_contains(x[1:1], e) AS hit_1, list_contains(x[1:3], e) AS hit_3, list_contains(x, e) AS hit_5, n_e FROM (
  SELECT query_id, qc, x, top1_score, top_c, CASE WHEN query_id // 20 % 7 = 0 THEN '' WHEN query_id // 20 % 3 = 0 THEN 'none' ELSE x[query_id // 20 % 5 + 1] END AS e, (query_id // 20 % 7 <> 0)::INT AS n_e FROM (
    SELECT query_id, qc, list(doc_id::VARCHAR ORDER BY rank)[1:5] AS x, arg_min(score, rank) AS top1_score, arg_min(dc, rank) AS top_c FROM ({_sql_top(k=6)}) WHERE query_id <> doc_id GROUP BY query_id, qc))"""
_BADCASE = "CASE WHEN n_e = 0 THEN 'missing_label' WHEN NOT hit_5 THEN 'rag_wrong_doc' WHEN top_c <> category THEN 'rag_category_mismatch' END"


@registered(f"""SELECT category, count(*) AS n, avg(hit_1::INT) AS recall_1, avg(hit_3::INT) AS recall_3, avg(hit_5::INT) AS recall_5, round(avg(top1_score), 5) AS avg_top1, count({_BADCASE}) AS n_badcases
FROM ({_EVALUATED}) GROUP BY ROLLUP (category)""")
def recall_at_k(spark, d):
    return retrieval.summarized(_evaluated(spark, d)).withColumn("avg_top1", F.round("avg_top1", 5))


@registered(f"SELECT query_id, {_BADCASE} AS badcase_type FROM ({_EVALUATED}) WHERE {_BADCASE} IS NOT NULL")
def retrieval_badcases(spark, d):
    return _evaluated(spark, d).where("badcase_type is not null").select("query_id", "badcase_type")


# ---------------------------------------------------------------- judged answers
_PLAIN = sql_normal("answer", "plain")
_JUDGED = f"""SELECT *, len(miss) AS n_miss, len(vio) AS n_vio, 1 - len(miss) / nullif(len(must_include), 0) AS inc_rate, coalesce(len(vio) / nullif(len(must_not_include), 0), 0.0) AS vio_rate,
  (kind = 'direct' OR (kind = 'conditional' AND category IN ('complaint', 'manual_transfer', 'quality_issue'))) AS predicted, length(answer) AS n_answer, {sql_strip('answer')} = '' AS empty, array_to_string(flags, ',') AS risk_flags
FROM (SELECT *, list_filter(must_include, lambda p: NOT contains(plain, {sql_normal('p', 'plain')})) AS miss, list_filter(must_not_include, lambda p: p <> '' AND contains(plain, {sql_normal('p', 'plain')})) AS vio,
  CASE WHEN NOT {sql_holds('plain', packs.HUMAN_WORDS)} THEN 'none' WHEN {sql_holds('plain', packs.CONDITION_WORDS)} THEN 'conditional' ELSE 'direct' END AS kind, {sql_all_hits('answer', packs.ANSWER_RISKS, False)} AS flags
  FROM (SELECT *, {_PLAIN} AS plain FROM ({ANSWERS})))"""


@registered(f"SELECT id, inc_rate AS must_include_hit_rate, coalesce(array_to_string(miss, '|'), '') AS missing, vio_rate AS must_not_include_violation_rate, coalesce(array_to_string(vio, '|'), '') AS violations, kind AS transfer, predicted AS predicted_need_human, need_human = predicted AS need_human_correct, n_answer AS answer_length, empty AS empty_answer, risk_flags AS post_risk_flags FROM ({_JUDGED})")
def phrase_metrics(spark, d):
    return metrics.judged(answers(spark, d)).select(
        "id", "must_include_hit_rate", F.array_join("must_include_missing", "|").alias("missing"), "must_not_include_violation_rate", F.array_join("must_not_include_violations", "|").alias("violations"),
        F.col("predicted_human_transfer_type").alias("transfer"), "predicted_need_human", "need_human_correct", "answer_length", "empty_answer", F.array_join("post_risk_flags", ",").alias("post_risk_flags"),
    )


_MEANS = "count(*) AS n, round(avg(inc_rate), 9) AS must_include_avg_hit_rate, round(1 - avg(vio_rate), 9) AS non_violation_rate, round(avg((need_human = predicted)::INT), 9) AS need_human_accuracy"
_MORE = "round(avg(empty::INT), 9) AS empty_answer_rate, round(avg((risk_flags <> '')::INT), 9) AS post_risk_rate"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@registered(f"SELECT category, {_MEANS}, {_MORE} FROM ({_JUDGED}) GROUP BY ROLLUP (category)")
def generation_summary(spark, d):
    return _rounded(metrics.summarized(metrics.judged(answers(spark, d)), "category"))


@registered(f"""WITH j AS ({_JUDGED}), c AS (SELECT DISTINCT category FROM j), m AS (SELECT unnest(['de', 'en', 'es', 'fr', 'none']) AS model),
g AS (SELECT category, model, {_MEANS}, round(avg((risk_flags <> '')::INT), 9) AS post_risk_rate FROM j GROUP BY category, model)
SELECT c.category, m.model, coalesce(n, 0) AS n, must_include_avg_hit_rate, non_violation_rate, need_human_accuracy, post_risk_rate FROM c CROSS JOIN m LEFT JOIN g USING (category, model)""")
def model_category_compare(spark, d):
    return _rounded(metrics.compared(metrics.judged(answers(spark, d)), ["de", "en", "es", "fr", "none"]))


@registered(f"""SELECT id, reasons FROM (SELECT id, array_to_string(list_filter([CASE WHEN empty THEN 'empty_answer' END, CASE WHEN len(miss) > 0 THEN 'missing_must_include' END, CASE WHEN len(vio) > 0 THEN 'must_not_include_violation' END,
  CASE WHEN need_human <> predicted THEN 'need_human_wrong' END, CASE WHEN risk_flags <> '' THEN 'post_risk' END], lambda x: x IS NOT NULL), ',') AS reasons FROM ({_JUDGED})) WHERE reasons <> ''""")
def generation_badcases(spark, d):
    return metrics.badcases(metrics.judged(answers(spark, d))).select("id", F.array_join("badcase_reasons", ",").alias("reasons"))


# ---------------------------------------------------------------- items, variants, parsing
def _items(spark, d):
    """Benchmark items as evaluation items, with marks that each validator's rules see."""
    b = table(spark, d, "benchmark")
    k = F.col("item_id")
    pick = lambda names, by: F.element_at(F.lit(list(names)), (by % len(names) + 1).cast("int"))
    return b.select(
        k.alias("id"), pick((*packs.CATEGORIES, "other"), k).alias("category"), pick(packs.EVAL_TYPES, k).alias("eval_type"), pick(packs.DIFFICULTIES, k).alias("difficulty"), F.col("text").alias("query"), F.concat(F.lit("  "), "text").alias("reference_answer"),
        F.array(F.lit(" a "), F.lit("")).alias("must_include"), F.when(k % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("b"))).alias("must_not_include"), (k % 3 == 0).alias("need_human"), (k % 2 == 0).alias("need_rag"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("doc_id= `faq_"), k, F.lit("`; doc_type=faq")))).alias("expected_docs"), F.array(F.lit("order_status")).alias("risk_tags"),
    )


_ITEMS = f"""SELECT item_id AS id, [{', '.join(repr(c) for c in (*packs.CATEGORIES, 'other'))}][item_id % 9 + 1] AS category, ['sft', 'rag', 'safety', 'human_transfer'][item_id % 4 + 1] AS eval_type,
  text AS query, text AS answer, item_id % 5 = 0 AS no_not, item_id % 3 = 0 AS need_human, item_id % 2 = 0 AS need_rag, item_id % 4 = 0 AS no_docs FROM benchmark"""


@registered(f"""SELECT id, CASE WHEN category = 'other' THEN 'invalid_category' WHEN length(t) < 4 THEN 'bad_query' WHEN length(t) > 120 THEN 'query_too_long' WHEN length(t) < 10 THEN 'bad_reference_answer' WHEN length(t) > 400 THEN 'reference_answer_too_long'
  WHEN no_not THEN 'empty_must_not_include' WHEN eval_type = 'rag' AND NOT need_rag THEN 'rag_type_but_need_rag_false' WHEN eval_type = 'human_transfer' AND NOT need_human THEN 'human_transfer_but_need_human_false'
  WHEN need_rag AND no_docs THEN 'need_rag_but_no_expected_docs' ELSE 'ok' END AS reason FROM (SELECT *, {sql_strip('query')} AS t FROM ({_ITEMS}))""")
def eval_item_gate(spark, d):
    rows = _items(spark, d)
    return rows.select("id", first_failure(validate.eval_rules({c: F.col(c) for c in rows.columns})).alias("reason"))


@registered(f"""SELECT id, unnest(list_filter([CASE WHEN category = 'other' THEN 'invalid_category' END, CASE WHEN length({sql_strip('query')}) < 4 THEN 'bad_query' END, CASE WHEN length({sql_strip('query')}) < 10 THEN 'bad_reference_answer' END, CASE WHEN no_not THEN 'empty_must_not_include' END,
  CASE WHEN eval_type = 'rag' AND NOT need_rag THEN 'rag_eval_type_need_rag_false' END, CASE WHEN eval_type = 'human_transfer' AND NOT need_human THEN 'human_transfer_need_human_false' END, CASE WHEN need_rag AND no_docs THEN 'need_rag_missing_expected_docs' END,
  {sql_first_hit("query || chr(10) || '  ' || answer", packs.SENSITIVE, 'sensitive_')}], lambda x: x IS NOT NULL)) AS issue_type FROM ({_ITEMS})""")
def eval_item_audit(spark, d):
    rows = _items(spark, d)
    return rows.select("id", F.explode(all_failures(validate.eval_audit({c: F.col(c) for c in rows.columns}))).alias("issue_type"))


@registered(f"""SELECT id::VARCHAR AS id, need_rag OR eval_type = 'rag' AS need_rag, need_human OR eval_type = 'human_transfer' AS need_human,
  'order_status' || CASE WHEN need_human OR eval_type = 'human_transfer' THEN ',human_transfer_required' ELSE '' END || CASE WHEN need_rag OR eval_type = 'rag' THEN ',rag_required' ELSE '' END || CASE WHEN eval_type = 'safety' THEN ',unsafe_promise' ELSE '' END AS tags,
  CASE WHEN no_docs THEN '' ELSE 'faq_' || id END AS docs FROM ({_ITEMS})""")
def eval_item_fix(spark, d):
    rows = items.normal_item(_items(spark, d)).withColumns({f"plan_{c}": F.col(c) for c in ("category", "eval_type", "difficulty")})
    return items.fixed_to_plan(rows).select("id", "need_rag", "need_human", F.array_join("risk_tags", ",").alias("tags"), F.array_join("expected_docs", ",").alias("docs"))


@registered(f"SELECT id, md5({sql_normal(chr(34) + 'user' + chr(34))} || '||' || category || '||' || {sql_normal('answer')}) AS key_md5 FROM ({PAIRS})")
def preference_keys(spark, d):
    rows = turn_pairs(spark, d)
    return rows.select("id", _md5(items.preference_key(F.slice("messages", 1, 2), F.col("category"), F.col("answer"))).alias("key_md5"))


_MARKS = {k: v for k, v in {
    "fabricated_policy": "15 天", "compensation_commitment": "赔偿", "missing_action": "稍后", "rude_tone": "别问", "fake_order_or_logistics_status": "包裹在", "over_marketing": "加购", "no_human_transfer": "直接", "unsafe_overpromise": "百分百",
}.items()}


def _preferences(spark, d):
    """Pairs as preference items: the rejected answer is the question, with the mark of its kind on two of three turns."""
    kind = F.element_at(F.lit(list(packs.REJECTED_TYPES)), (F.col("turn") % 9 + 1).cast("int"))
    mark = F.lit("")
    for name, text in _MARKS.items():
        mark = F.when(kind == name, text).otherwise(mark)
    rows = turn_pairs(spark, d).withColumn("rejected_text", F.concat("user", F.when(F.col("conv_id") % 3 > 0, mark).otherwise(F.lit(""))))
    return rows.withColumns({
        "source": F.lit("from_sft"), "source_id": F.col("id"), "rejected_type": kind, "severity": F.when(F.col("turn") % 4 == 0, "grave").otherwise("low"), "prompt": F.slice("messages", 1, 2), "chosen": F.slice("messages", 3, 1),
        "rejected": F.array(F.struct(F.lit("assistant").alias("role"), F.col("rejected_text").alias("content"))), "preference_reason": F.when(F.col("conv_id") % 10 == 0, "short").otherwise("a reason of length"),
    })


_PREFERENCES = f"""SELECT *, {sql_strip("answer")} AS c, {sql_strip("rt")} AS r, replace("user" || chr(1) || answer || chr(1) || rt, chr(10), chr(92) || 'n') AS j FROM (SELECT *,
  "user" || CASE WHEN conv_id % 3 > 0 THEN CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MARKS.items())} ELSE '' END ELSE '' END AS rt FROM (SELECT *, {list(packs.REJECTED_TYPES)!r}[turn % 9 + 1] AS kind FROM ({PAIRS})))"""
_MATCHES = f"CASE kind {' '.join(f'WHEN {k!r} THEN {sql_hits(chr(114), v)}' for k, v in packs.REJECTED_MARKERS.items() if k != 'wrong_intent')} ELSE TRUE END"


@registered(f"""SELECT id, CASE WHEN length(c) < 10 THEN 'chosen_too_short' WHEN length(r) < 4 THEN 'rejected_too_short' WHEN length(r) > 180 THEN 'rejected_too_long'
  WHEN {sql_first_hit('j', packs.SENSITIVE)} IS NOT NULL THEN {sql_first_hit('j', packs.SENSITIVE, 'sensitive_')} WHEN {sql_hits('c', packs.ASSISTANT_COMMITMENT)} THEN 'chosen_has_risky_commitment'
  WHEN NOT {_MATCHES} THEN 'rejected_type_not_matched' WHEN conv_id % 10 = 0 THEN 'preference_reason_too_short' ELSE 'ok' END AS reason FROM ({_PREFERENCES})""")
def preference_gate(spark, d):
    """No question here is like its answer, so the SQL needs no similarity; a test has both sides of that rule."""
    rows = _preferences(spark, d)
    names = ("id", "category", "source", "rejected_type", "severity", "prompt", "chosen", "rejected", "preference_reason")
    rules = validate.preference_rules({c: F.col(c) for c in names}, F.to_json(F.struct(*names)))
    return rows.select("id", first_failure(rules).alias("reason"))


_PREFERENCE_AUDIT = f"""SELECT id, unnest(list_filter([CASE WHEN turn % 4 = 0 THEN 'invalid_severity' END, CASE WHEN length(c) < 10 THEN 'chosen_too_short' END, CASE WHEN length(r) < 4 THEN 'rejected_too_short' END, CASE WHEN length(r) > 200 THEN 'rejected_too_long' END,
  CASE WHEN {sql_hits('c', packs.ASSISTANT_COMMITMENT)} THEN 'chosen_has_risky_commitment' END, {sql_first_hit('j', packs.SENSITIVE, 'sensitive_')}, CASE WHEN conv_id % 10 = 0 THEN 'bad_preference_reason' END], lambda x: x IS NOT NULL)) AS issue_type FROM ({_PREFERENCES})"""


def _preference_issues(spark, d):
    rows = _preferences(spark, d)
    names = ("id", "category", "source", "source_id", "rejected_type", "severity", "prompt", "chosen", "rejected", "preference_reason")
    return rows, quality.issues(rows, "dpo_train", F.col("id"), validate.preference_audit({c: F.col(c) for c in names}, F.to_json(F.struct(*names))))


@registered(_PREFERENCE_AUDIT)
def preference_audit(spark, d):
    return _preference_issues(spark, d)[1].select("id", "issue_type")


@registered(f"""SELECT 'error' AS severity, issue_type, count(*) AS n FROM ({_PREFERENCE_AUDIT}) GROUP BY 2 UNION ALL SELECT 'warning', 'duplicate_dpo_key', count(*) FROM (
  SELECT 1 FROM ({_PREFERENCES}) GROUP BY {sql_normal(chr(34) + 'user' + chr(34))} || '||' || kind || '||' || {sql_normal('rt')} HAVING count(*) > 1) HAVING count(*) > 0""")
def preference_dataset_audit(spark, d):
    rows, found = _preference_issues(spark, d)
    again = quality.duplicate_issues(rows, "dpo_train", items.preference_key(F.col("prompt"), F.col("rejected_type"), F.col("rejected_text")), "duplicate_dpo_key", "warning", False)
    return found.unionByName(again).groupBy("severity", "issue_type").agg(F.count("*").alias("n"))


@registered(f"""SELECT id, CASE WHEN length(v) < 4 THEN 'too_short' WHEN length(v) > 120 THEN 'too_long' WHEN {sql_normal('v', 'short')} = {sql_normal('o', 'short')} THEN 'same_as_original'
  WHEN {sql_holds('v', packs.VARIANT_STRONG)} OR (NOT {sql_holds('v', packs.QUESTION_MARKERS)} AND {sql_holds('v', packs.VARIANT_WEAK)}) THEN 'looks_like_answer'
  {" ".join(f"WHEN {sql_hits('v', p)} AND NOT {sql_hits('o', p)} THEN '{name}'" for name, p in packs.NEW_INFORMATION)} WHEN {sql_hits('v', packs.NEW_POLICY)} AND NOT {sql_hits('o', packs.NEW_POLICY)} THEN 'new_risky_policy_or_commitment' ELSE 'ok' END AS reason
FROM (SELECT id, {sql_strip(chr(34) + 'user' + chr(34))} AS v, answer AS o FROM ({PAIRS}))""")
def variant_gate(spark, d):
    return turn_pairs(spark, d).select("id", first_failure(expand.variant_rules(F.col("user"), F.col("answer"))).alias("reason"))


@registered("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, CASE WHEN json_valid(props) THEN CASE WHEN json_type(props) = 'OBJECT' THEN NULL ELSE 'not_json_object' END ELSE 'json_decode_error' END AS error FROM events GROUP BY ALL")
def json_parse_permissive(spark, d):
    rows = parsed(table(spark, d, "events").select("event_type", F.col("props").alias("value")), "k string")
    return rows.groupBy("event_type", "k", F.col("_error").alias("error")).agg(F.count("*").alias("n"))


@registered("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text || '|' || item_id ELSE array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || '"''，,')), lambda x: x <> ''), '|') END AS items FROM benchmark""")
def llm_output_parse(spark, d):
    written_ = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("sure:\n```json\n"), F.to_json(F.array("text", F.col("item_id").cast("string"))), F.lit("\n``` done"))).otherwise(F.concat(F.lit("- "), F.regexp_replace("text", "\n", "\n- ")))
    return table(spark, d, "benchmark").select("item_id", F.array_join(providers.answer_list(written_), "|").alias("items"))


_IDS = "list_transform(string_split({}, ' '), lambda w: length(w)::INT)"


@registered(f"""SELECT id, md5(array_to_string(list_concat(p, a)[1:200], ',')) AS ids_md5, md5(array_to_string(list_concat(list_transform(p, lambda x: -100), a)[1:200], ',')) AS labels_md5
FROM (SELECT id, {_IDS.format(chr(34) + "user" + chr(34))} AS p, {_IDS.format("answer")} AS a FROM ({PAIRS}))""")
def masked_training_labels(spark, d):
    """Ids are the lengths of the texts' words; the last message is the answer."""
    turns = items.training_turns(F.col("messages"))
    ids = lambda c: F.transform(F.split(c, " "), F.length)
    made = items.masked_labels(ids(F.col("user")), ids(turns["answer"]), 200)
    return turn_pairs(spark, d).select("id", _md5(F.array_join(made["input_ids"], ",")).alias("ids_md5"), _md5(F.array_join(made["labels"], ",")).alias("labels_md5"))


def _sql_shares(plan: str, weights: dict[str, int]) -> str:
    total, rows = sum(weights.values()), ", ".join(f"('{k}', {v}, {i})" for i, (k, v) in enumerate(weights.items()))
    return f"""SELECT '{plan}' AS plan, k AS category, (v * t // {total} + (row_number() OVER (ORDER BY v * t % {total} DESC, i) <= t - sum(v * t // {total}) OVER ())::INT)::BIGINT AS n
      FROM (VALUES {rows}) w(k, v, i), (SELECT 3 * count(*) AS t FROM benchmark)"""


@registered(f"SELECT * FROM ({_sql_shares('preference', packs.PREFERENCE_CATEGORY_TARGETS)} UNION ALL {_sql_shares('evaluation', packs.EVAL_CATEGORY_TARGETS)}) WHERE n > 0")
def generation_plan(spark, d):
    """Plans of preference pairs and evaluation items, three for each item of the benchmark, counted by category."""
    total = 3 * table(spark, d, "benchmark").count()
    rows = [{"plan": "preference", "category": r["category"]} for r in planning.preference_plan(total)] + [{"plan": "evaluation", "category": r["category"]} for r in planning.evaluation_plan(total)]
    return planning.as_table(spark, rows).groupBy("plan", "category").agg(F.count("*").alias("n"))
