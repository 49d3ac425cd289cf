"""Registered queries of whole reports, dataset audits, acceptance, splits and look-ups, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill import packs
from corpusmill.functions.rules import first_failure
from corpusmill.functions.text import last_of_role, normal, strip
from corpusmill.operators import dedup, expand, items, kb, planning, quality, retrieval, split, validate
from corpusmill.plans import queries as q
from corpusmill.plans.registry import registered
from corpusmill.plans.tables import DIALOGUES, PAIRS, dialogues, sql_hits, sql_normal, sql_strip, table, turn_pairs
from corpusmill.sources import report


def _sql_counts(rows: str, section: str, key: str, side: str = "'all'") -> str:
    return f"SELECT '{section}' AS section, coalesce(({key})::VARCHAR, 'unknown') AS key, {side} AS side, count(*)::DOUBLE AS value FROM ({rows}) GROUP BY ALL"


def _sql_summary(rows: str, section: str, **named: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{k}' AS key, 'all' AS side, ({e})::DOUBLE AS value FROM ({rows})" for k, e in named.items())


def _sql_ratio(part: str, whole: str) -> str:
    return f"round_even(({part}) / greatest({whole}, 1)::DOUBLE, 4)"


# ---------------------------------------------------------------- whole reports
_PAIR_REASONS = f"SELECT *, 'pairs' AS source, {q._sql_first_failure(q.WIDE['user_chars'], q.WIDE['answer_chars'])} AS reason FROM ({q._TEXTS} ({q._PAIR_MESSAGES}))"
_OK = f"SELECT * FROM ({_PAIR_REASONS}) WHERE reason = 'ok'"


@registered(" UNION ALL ".join([
    _sql_summary(_PAIR_REASONS, "summary", raw_items="count(*)", cleaned_items="count(*) FILTER (reason = 'ok')", dropped_items="count(*) FILTER (reason <> 'ok')", drop_ratio=_sql_ratio("count(*) FILTER (reason <> 'ok')", "count(*)")),
    _sql_counts(f"SELECT * FROM ({_PAIR_REASONS}) WHERE reason <> 'ok'", "drop_reasons", "reason"), _sql_counts(_OK, "category_distribution", "category"), _sql_counts(_OK, "source_distribution", "source"), _sql_counts(_OK, "seed_id_retention", "seed_id"),
    _sql_summary(_OK, "length_stats", user_min="min(length(u))", user_max="max(length(u))", user_avg="round(avg(length(u)), 2)", assistant_min="min(length(a))", assistant_max="max(length(a))", assistant_avg="round(avg(length(a)), 2)"),
]))
def cleaning_report(spark, d):
    rows = turn_pairs(spark, d).withColumn("source", F.lit("pairs"))
    return report.cleaning_report(rows.withColumn("reason", first_failure(validate.sample_rules(F.col("messages"), F.col("category"), **q.WIDE))))


_SIDES = q._sql_split(q._GROUPS, "category", "group_key")
_SPLIT_GROUPS = f"SELECT * FROM ({_SIDES}) JOIN (SELECT group_key, n_categories FROM ({q._GROUPS})) USING (group_key)"
_SPLIT_EVENTS = f"SELECT e.event_type AS category, 'events' AS source, e.user_id::VARCHAR AS seed_id, s.split FROM events e JOIN ({_SIDES}) s ON s.group_key = 'seed::' || e.user_id"


def _sql_sided(rows: str, section: str, key: str) -> str:
    return f"{_sql_counts(rows, section, key)} UNION ALL {_sql_counts(rows, section, key, 'split')}"


@registered(" UNION ALL ".join([
    _sql_summary(_SPLIT_EVENTS, "summary", raw_items="count(*) + 3", invalid_items="3", train_items="count(*) FILTER (split = 'train')", valid_items="count(*) FILTER (split = 'valid')", actual_valid_item_ratio=_sql_ratio("count(*) FILTER (split = 'valid')", "count(*)")).replace("(3)::DOUBLE AS value FROM", "(any_value(3))::DOUBLE AS value FROM"),
    _sql_summary(_SPLIT_GROUPS, "summary", total_groups="count(*)", train_groups="count(*) FILTER (split = 'train')", valid_groups="count(*) FILTER (split = 'valid')", actual_valid_group_ratio=_sql_ratio("count(*) FILTER (split = 'valid')", "count(*)"), group_category_conflicts="count(*) FILTER (n_categories > 1)"),
    _sql_summary(f"SELECT seed_id, count(DISTINCT split) AS n FROM ({_SPLIT_EVENTS}) GROUP BY 1", "summary", seed_leakage_count="count(*) FILTER (n > 1)"),
    _sql_sided(_SPLIT_EVENTS, "category_distribution", "category"), _sql_sided(_SPLIT_EVENTS, "source_distribution", "source"), _sql_sided(_SPLIT_GROUPS, "group_category_distribution", "category"),
]))
def split_report(spark, d):
    events = table(spark, d, "events").withColumns({"group_key": split.group_key(F.col("user_id").cast("string"), F.col("event_id").cast("string")), "category": F.col("event_type"), "source": F.lit("events"), "seed_id": F.col("user_id").cast("string")})
    groups = split.stratified(split.groups(events, "group_key", "category", "event_id"), ["category"], "group_key", 0.1)
    rows = split.split_rows(events, "group_key", "category", "event_id", 0.1)
    return report.split_report(rows.select("category", "source", "seed_id", "split"), groups, invalid=3)


_LEVELS = "['easy', 'medium', 'hard'][id % 3 + 1]"


@registered(" UNION ALL ".join([
    _sql_summary(q._ITEMS, "summary", generated_items="count(*)"), _sql_summary(PAIRS, "summary", planned_items="count(*)"),
    *[_sql_counts(q._ITEMS, f"{c}_distribution", e) for c, e in (("category", "category"), ("eval_type", "eval_type"), ("difficulty", _LEVELS), ("need_human", "need_human"), ("need_rag", "need_rag"), ("risk_tag", "'order_status'"))],
    _sql_counts(PAIRS, "plan_category_distribution", "category"), _sql_counts(PAIRS, "plan_eval_type_distribution", "CASE WHEN turn % 2 = 0 THEN 'sft' ELSE 'rag' END"), _sql_counts(PAIRS, "plan_difficulty_distribution", "'easy'"),
]))
def evaluation_report(spark, d):
    plan = turn_pairs(spark, d).select("category", F.when(F.col("turn") % 2 == 0, "sft").otherwise("rag").alias("eval_type"), F.lit("easy").alias("difficulty"))
    return report.evaluation_report(q._items(spark, d), plan)


_PREF_SPLIT = f"SELECT * FROM ({q._PREFERENCES}) JOIN ({q._sql_split(f'SELECT id, category FROM ({PAIRS})', 'category', 'id')}) USING (id, category)"


@registered(" UNION ALL ".join([
    _sql_summary(_PREF_SPLIT, "summary", planned_items="any_value(300)", candidate_items="count(*)", train_items="count(*) FILTER (split = 'train')", valid_items="count(*) FILTER (split = 'valid')", actual_valid_ratio=_sql_ratio("count(*) FILTER (split = 'valid')", "count(*)")),
    *[_sql_sided(_PREF_SPLIT, f"{c}_distribution", e) for c, e in (("category", "category"), ("rejected_type", "kind"), ("source", "'from_sft'"), ("severity", "CASE WHEN turn % 4 = 0 THEN 'grave' ELSE 'low' END"))],
]))
def preference_report(spark, d):
    rows = q._preferences(spark, d).select("id", "category", "rejected_type", "source", "severity")
    return report.preference_report(split.stratified(rows, ["category"], "id", 0.1), 300)


_EVAL_ISSUES = f"""SELECT 'error' AS severity, issue_type FROM ({q.SQL["eval_item_audit"]})
  UNION ALL SELECT 'error', 'duplicate_query' FROM (SELECT 1 FROM benchmark GROUP BY {sql_normal("text")} HAVING count(*) > 1)
  UNION ALL SELECT 'error', 'duplicate_id' FROM (SELECT 1 FROM benchmark GROUP BY item_id HAVING count(*) > 1)
  UNION ALL SELECT 'error', 'expected_docs_not_in_kb' FROM (SELECT id FROM ({q._ITEMS}) WHERE need_rag AND NOT no_docs)"""


def _eval_issues(spark, d):
    rows = q._items(spark, d)
    known = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"))
    missing = quality.missing_docs(rows.select(F.col("id").alias("item"), F.transform("expected_docs", kb.doc_reference).alias("expected_docs")), known)
    judged = rows.join(missing, F.col("id") == F.col("item"), "left")
    audit = quality.issues(judged, "eval_set", F.col("id"), validate.eval_audit({c: F.col(c) for c in rows.columns}, F.col("missing")))
    again = quality.duplicate_issues(rows, "eval_set", normal(F.col("query")), "duplicate_query", with_id=False)
    return rows, audit.unionByName(again).unionByName(quality.duplicate_issues(rows, "eval_set", F.col("id").cast("string"), "duplicate_id"))


@registered(f"SELECT severity, issue_type, count(*) AS n FROM ({_EVAL_ISSUES}) GROUP BY ALL")
def eval_dataset_audit(spark, d):
    return _eval_issues(spark, d)[1].groupBy("severity", "issue_type").agg(F.count("*").alias("n"))


@registered(" UNION ALL ".join([
    _sql_summary(_EVAL_ISSUES, "summary", errors="count(*)", warnings="count(*) FILTER (severity = 'warning')", issues="count(*)", passed="(count(*) = 0)::INT"),
    *[f"SELECT 'thresholds' AS section, name AS key, '{c}' AS side, {c}::INT::DOUBLE AS value FROM ({q.SQL['threshold_gate']})" for c in ("actual", "least", "passed")],
    f"SELECT 'issues' AS section, issue_type AS key, severity AS side, count(*)::DOUBLE AS value FROM ({_EVAL_ISSUES}) GROUP BY ALL",
    _sql_counts("SELECT * FROM documents", "kb_all: lang_distribution", "lang"), _sql_counts(q._ITEMS, "eval_set: eval_type_distribution", "eval_type"),
]))
def quality_report(spark, d):
    rows, found = _eval_issues(spark, d)
    return report.quality_report(found, q.threshold_gate(spark, d), {"kb_all": table(spark, d, "documents").select("lang"), "eval_set": rows.select("eval_type")})


# ---------------------------------------------------------------- acceptance
_VARIANTS = """SELECT conv_id % 10 AS seed_id, 'how is ' || lower(list_last(string_split(text, ' '))) AS variant, 1000 * conv_id + turn AS ord FROM conversations WHERE role = 'user'"""
_TAKEN = "SELECT DISTINCT 'howis' || lower(split_part(text, ' ', 1)) AS text FROM conversations"


def _variants(spark, d):
    turns = table(spark, d, "conversations")
    last = F.lower(F.element_at(F.split("text", " "), -1))
    rows = turns.where("role = 'user'").select((F.col("conv_id") % 10).alias("seed_id"), F.lit("").alias("original"), F.concat(F.lit("how is "), last).alias("variant"), (1000 * F.col("conv_id") + F.col("turn")).alias("ord"))
    return rows, turns.select(F.concat(F.lit("howis"), F.lower(F.split_part("text", F.lit(" "), F.lit(1)))).alias("text"))


@registered(f"""WITH RECURSIVE v AS (SELECT seed_id, {sql_normal("variant", "short")} AS t, ord, length({sql_strip("variant")}) AS n FROM ({_VARIANTS})),
s AS (SELECT *, row_number() OVER (ORDER BY ord) AS k FROM v WHERE n BETWEEN 4 AND 120 AND t NOT IN (SELECT {sql_normal("text", "short")} FROM ({_TAKEN}))),
w AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS texts, []::BIGINT[] AS seeds, []::BIGINT[] AS ords UNION ALL
  SELECT s.k, CASE WHEN ok THEN list_append(texts, t) ELSE texts END, CASE WHEN ok THEN list_append(seeds, seed_id) ELSE seeds END, CASE WHEN ok THEN list_append(ords, ord) ELSE ords END
  FROM (SELECT s.*, w.texts, w.seeds, w.ords, NOT list_contains(w.texts, s.t) AND len(list_filter(w.seeds, lambda x: x = s.seed_id)) < 6 AS ok FROM w JOIN s ON s.k = w.k + 1) s)
SELECT seed_id, ord FROM s WHERE ord IN (SELECT unnest(ords) FROM w WHERE k = (SELECT max(k) FROM w))""")
def variant_accept(spark, d):
    """Up to six a seed; only equal texts are alike here, which SQL can say (a test has the others)."""
    rows, taken = _variants(spark, d)
    return expand.accepted(rows, taken, quota=6, least=1.0).select("seed_id", "ord")


@registered(f"""WITH r AS (SELECT id, {sql_normal(chr(34) + "user" + chr(34))} AS key, 1000 * conv_id + turn AS ord, CASE WHEN length(answer) > 300 THEN 'too_long' ELSE 'ok' END AS reason FROM ({PAIRS})),
f AS (SELECT key, min(ord) AS first FROM r WHERE reason = 'ok' GROUP BY 1)
SELECT id, CASE WHEN key IN (SELECT {sql_normal("text")} FROM benchmark) OR ord > first THEN 'duplicate_query' ELSE reason END AS status FROM r LEFT JOIN f USING (key)""")
def accepted_once(spark, d):
    rows = turn_pairs(spark, d).withColumn("reason", F.when(F.length("answer") > 300, "too_long").otherwise("ok"))
    taken = table(spark, d, "benchmark").select(normal(F.col("text")).alias("key"))
    return dedup.accepted_once(rows, normal(F.col("user")), F.col("reason"), 1000 * F.col("conv_id") + F.col("turn"), taken, "duplicate_query").select("id", "status")


@registered(f"""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {sql_normal(chr(34) + "user" + chr(34))} || '||' || {sql_normal("answer")} ORDER BY conv_id, turn) AS k FROM ({PAIRS})) WHERE k = 1""")
def exact_pair_dedup(spark, d):
    key = F.sha2(F.concat(normal(F.col("user")), F.lit("||"), normal(F.col("answer"))), 256)
    return dedup.first_of(turn_pairs(spark, d).select("id", "conv_id", "turn", key.alias("key")), [F.col("key")], [F.col("conv_id"), F.col("turn")]).select("id")


# ---------------------------------------------------------------- splits, samples, batches
_NULL_LANG = "SELECT doc_id, nullif(lang, 'es') AS stratum FROM documents"


@registered(q._sql_split(_NULL_LANG, "stratum", "doc_id"))
def stratified_null_split(spark, d):
    """Documents without a stratum are one."""
    rows = table(spark, d, "documents").select("doc_id", F.nullif("lang", F.lit("es")).alias("stratum"))
    return split.stratified(rows, ["stratum"], "doc_id", 0.1).select("doc_id", "stratum", "split")


_MIX = """SELECT doc_id AS source_id, md5({seed} || ':' || doc_id) AS h FROM documents WHERE {where}"""


@registered(f"""SELECT source_id FROM (SELECT *, row_number() OVER (ORDER BY h, source_id) AS k FROM ({_MIX.format(seed="'42'", where="lang = 'en'")})) WHERE k <= (SELECT floor(count(*) * 0.2 * 0.7::DOUBLE) FROM documents)
UNION ALL SELECT source_id FROM (SELECT *, row_number() OVER (ORDER BY h, source_id) AS k FROM ({_MIX.format(seed="'42'", where="lang = 'de'")})) WHERE k <= (SELECT floor(count(*) * 0.2) - floor(floor(count(*) * 0.2) * 0.7::DOUBLE) FROM documents)""")
def source_mix(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "lang")
    of = lambda lang: docs.where(F.col("lang") == lang).select("source_id")
    return items.source_mix(of("en"), of("de"), docs.count() / 5)


@registered("""WITH k AS (SELECT doc_id, lang FROM documents), w AS (SELECT unnest(['en', 'fr', 'none']) AS f),
own AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY f ORDER BY md5('42:doc_' || doc_id), 'doc_' || doc_id) AS r FROM k JOIN w ON lang = f) WHERE r <= 4),
spare AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:doc_' || doc_id), 'doc_' || doc_id) AS r FROM k) WHERE r <= 4 AND (SELECT count(*) FROM w WHERE f NOT IN (SELECT lang FROM k)) > 0)
SELECT DISTINCT 'doc_' || doc_id AS chunk_id FROM (SELECT * FROM own UNION ALL SELECT * FROM spare)""")
def kb_picked(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("chunk_id"), F.col("lang").alias("category"), F.lit("faq").alias("doc_type"))
    return kb.picked(docs, ["en", "fr", "none"], 4).select("chunk_id")


# ---------------------------------------------------------------- items, documents, prompts
@registered(f"""SELECT id, trim(text) AS query FROM (SELECT item_id AS id, CASE WHEN item_id % 5 = 0 THEN '  ' ELSE text END AS text, item_id % 2 = 0 AS need_rag FROM benchmark) WHERE need_rag AND {sql_strip("text")} <> ''""")
def retrieval_asked(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 5 == 0, "  ").otherwise(F.col("text")).alias("user_query"), (F.col("item_id") % 2 == 0).alias("need_rag"))
    return retrieval.asked(rows).select("id", F.trim("query").alias("query"))


@registered("""SELECT batch, (i - 1)::INT AS at, plan[i] AS plan, answer[i] AS answer FROM (
  SELECT item_id // 10 AS batch, list(item_id ORDER BY item_id) AS plan, string_split(arg_min(text, item_id), ' ')[1:7] AS answer, unnest(range(1, 8)) AS i FROM benchmark GROUP BY 1) WHERE i <= least(len(plan), len(answer))""")
def aligned_answers(spark, d):
    rows = table(spark, d, "benchmark").groupBy(F.floor(F.col("item_id") / 10).alias("batch")).agg(F.array_sort(F.collect_list("item_id")).alias("plan"), F.slice(F.split(F.min_by("text", "item_id"), " "), 1, 7).alias("answer"))
    return items.aligned(rows, "plan", "answer")


@registered(f"""SELECT id, list_filter(messages, lambda m: m.role = 'user')[-1].content AS last_user, list_filter(messages, lambda m: m.role = 'assistant')[-1].content AS last_answer FROM ({DIALOGUES})""")
def last_messages(spark, d):
    return dialogues(spark, d).select("id", last_of_role(F.col("messages"), "user").alias("last_user"), last_of_role(F.col("messages"), "assistant").alias("last_answer"))


@registered(f"SELECT id, md5('Rewrite: ' || \"user\" || chr(10) || 'of ' || category || ' {{n}} times') AS prompt_md5 FROM ({PAIRS})")
def prompts_filled(spark, d):
    rows = planning.prompts(turn_pairs(spark, d).select("id", "user", "category"), "Rewrite: {user}\nof {category} {n} times")
    return rows.select("id", F.md5("prompt").alias("prompt_md5"))


_KINDS = list(packs.REJECTED_MARKERS)


@registered(f"""SELECT doc_id, CASE kind {" ".join(f"WHEN '{k}' THEN {sql_hits('t', v)}" for k, v in packs.REJECTED_MARKERS.items())} ELSE TRUE END AS matches
FROM (SELECT doc_id, {_KINDS!r}[doc_id % {len(_KINDS)} + 1] AS kind, text || CASE doc_id % 4 WHEN 0 THEN '一定 15天 赔偿' WHEN 1 THEN '稍后 再买 直接 别问' ELSE '' END AS t FROM documents)""")
def rejected_type_match(spark, d):
    kind = F.element_at(F.lit(_KINDS), (F.col("doc_id") % len(_KINDS) + 1).cast("int"))
    text = F.concat("text", F.when(F.col("doc_id") % 4 == 0, "一定 15天 赔偿").when(F.col("doc_id") % 4 == 1, "稍后 再买 直接 别问").otherwise(F.lit("")))
    return table(spark, d, "documents").select("doc_id", validate.type_matches(text, kind).alias("matches"))


_TERM = "CASE item_id % 4 WHEN 0 THEN '退货' WHEN 1 THEN '物流' WHEN 2 THEN '发票' ELSE '' END"
_OWN_TERMS = f"list_filter({list(packs.DOMAIN_TERMS)!r}, lambda t: contains(asked, t))"


@registered(f"""WITH i AS (SELECT item_id, text || {_TERM} AS asked, item_id % 3 > 0 AS need_rag FROM benchmark),
e AS (SELECT item_id, unnest([item_id * 2, item_id * 3]) AS doc_id, unnest([1, 2]) AS place FROM benchmark),
t AS (SELECT item_id, string_agg(split_part(text, chr(10), 1) || chr(10) || text || CASE doc_id % 3 WHEN 0 THEN '退货' WHEN 1 THEN '物流' ELSE '' END, chr(10) ORDER BY place) AS docs_text FROM e JOIN documents USING (doc_id) GROUP BY 1)
SELECT item_id AS item, md5(coalesce(docs_text, '')) AS docs_md5, CASE WHEN NOT need_rag THEN TRUE WHEN len({_OWN_TERMS}) = 0 THEN TRUE ELSE len(list_filter({_OWN_TERMS}, lambda t: contains(coalesce(docs_text, ''), t))) > 0 END AS related FROM i LEFT JOIN t USING (item_id)""")
def docs_related(spark, d):
    docs = table(spark, d, "documents")
    known = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("doc_id").alias("ord"), F.substring_index("text", "\n", 1).alias("title"), F.concat("text", F.when(F.col("doc_id") % 3 == 0, "退货").when(F.col("doc_id") % 3 == 1, "物流").otherwise(F.lit(""))).alias("content"))
    item = F.col("item_id")
    mark = F.when(item % 4 == 0, "退货").when(item % 4 == 1, "物流").when(item % 4 == 2, "发票").otherwise(F.lit(""))
    rows = table(spark, d, "benchmark").select(item.alias("item"), F.array((item * 2).cast("string"), (item * 3).cast("string")).alias("expected_docs"), F.concat("text", mark).alias("asked"), (item % 3 > 0).alias("need_rag"))
    told = rows.join(items.looked_up(rows.select("item", "expected_docs"), known), "item", "left")
    return told.select("item", F.md5(F.coalesce("docs_text", F.lit(""))).alias("docs_md5"), items.docs_relevant(F.col("need_rag"), F.size("expected_docs"), F.col("asked"), F.col("docs_text")).alias("related"))


@registered(f"""SELECT id, md5({sql_strip("answer")}) AS rejected_md5, severity FROM (SELECT *, CASE WHEN turn % 4 = 0 THEN 'grave' ELSE 'low' END AS severity FROM ({PAIRS}))""")
def preference_items(spark, d):
    answer = F.struct(F.concat(F.lit("  "), "answer").alias("rejected"), F.lit(" reason ").alias("preference_reason"))
    made = items.training_pairs(items.preference_item(q._preferences(spark, d).withColumns({"metadata": F.lit("{}"), "told": answer}), F.col("told")).withColumn("both", F.concat_ws("|", "id", "severity")).withColumn("preference_reason", F.col("both")))
    return made.select(F.split_part("preference_reason", F.lit("|"), F.lit(1)).alias("id"), F.md5(strip(F.col("rejected")[0]["content"])).alias("rejected_md5"), F.split_part("preference_reason", F.lit("|"), F.lit(2)).alias("severity"))
