"""Validators of samples, knowledge-base rows, evaluation items and preference items.

Each function gives rules in order; ``first_failure`` and ``all_failures`` read them.  Messages are
ARRAY<STRUCT<role, content>>; a null message is one that was no object.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill import packs
from corpusmill.functions.rules import Rule, coded
from corpusmill.functions.text import blank, count_held, filled, first_full, first_hit, hits, holds_any, normal, role_text, string_list, strip
from corpusmill.operators.similarity import ratio


def _among(value: Column, names: Sequence[str]) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False))


def _roles(messages: Column) -> Column:
    return F.transform(F.filter(messages, lambda m: m.isNotNull()), lambda m: m["role"])


def _has(roles: Column, role: str) -> Column:
    return F.exists(roles, lambda r: r.eqNullSafe(role))


def _length(text: Column) -> Column:
    return F.length(filled(text))


def sensitive(text: Column, prefix: str = "sensitive_", kinds=packs.SENSITIVE) -> Column:
    """The code of the first kind of personal data, else null."""
    return F.concat(F.lit(prefix), first_hit(text, kinds))


def commitment(answer: Column) -> Column:
    """Money before policy, else null."""
    return first_hit(answer, (("risky_money_commitment", packs.MONEY_COMMITMENT), ("risky_policy_commitment", packs.POLICY_COMMITMENT)))


def looks_like_answer(user: Column) -> Column:
    """A user's text in the tone of an answer: a question mark clears it, a strong marker or two weak ones don't."""
    return F.when(holds_any(user, packs.QUESTION_MARKERS), False).when(holds_any(user, packs.ANSWER_STRONG), True).otherwise(count_held(user, packs.ANSWER_WEAK) >= 2)


def message_rules(messages: Column) -> list[Rule]:
    roles = _roles(messages)
    first = F.slice(roles, 1, 3).eqNullSafe(F.array(*map(F.lit, packs.ROLES)))
    each = F.transform(
        messages,
        lambda m: F.when(m.isNull(), "message_not_object").when(~_among(m["role"], packs.ROLES), "invalid_role").when(m["content"].isNull(), "content_not_string").when(blank(m["content"]), "empty_content"),
    )
    return [
        Rule("missing_or_invalid_messages", messages.isNull() | (F.size(messages) < 1)),
        Rule("too_few_messages", F.size(roles) < 3),
        *[Rule(f"missing_{r}", ~_has(roles, r)) for r in packs.ROLES],
        Rule("bad_role_order", ~first),
        Rule(codes=F.array_compact(each)),
    ]


def sample_rules(messages: Column, category: Column, user_chars=(4, 160), answer_chars=(20, 800), strict_category: bool = True, check_style: bool = True) -> list[Rule]:
    """Rules of the cleaning step, meant for the first failure."""
    user, answer, system = (role_text(messages, r) for r in ("user", "assistant", "system"))
    return [
        *message_rules(messages),
        *([Rule("invalid_category", ~_among(category, packs.CATEGORIES))] if strict_category else []),
        Rule("user_too_short", F.length(user) < user_chars[0]),
        Rule("user_too_long", F.length(user) > user_chars[1]),
        Rule("answer_too_short", F.length(answer) < answer_chars[0]),
        Rule("answer_too_long", F.length(answer) > answer_chars[1]),
        coded(sensitive(F.concat_ws("\n", user, answer))),
        coded(commitment(answer)),
        Rule("bad_answer_phrase", holds_any(answer, packs.BAD_ANSWERS)),
        *([Rule("user_looks_like_answer", looks_like_answer(user))] if check_style else []),
        Rule("empty_system", system == ""),
    ]


def split_rules(messages: Column, category: Column) -> list[Rule]:
    """Rules before splitting."""
    roles = _roles(messages)
    return [
        Rule("invalid_category", ~_among(category, packs.CATEGORIES)),
        Rule("missing_messages", messages.isNull() | (F.size(messages) < 1)),
        Rule("missing_user", ~_has(roles, "user")),
        Rule("missing_assistant", ~_has(roles, "assistant")),
    ]


def sample_audit(messages: Column, category: Column) -> list[Rule]:
    """All issues of a sample; without messages only that and the category are told."""
    roles, none = _roles(messages), messages.isNull() | (F.size(messages) < 1)
    user, answer, system = (role_text(messages, r) for r in ("user", "assistant", "system"))
    some = lambda c: F.coalesce(~none & c, F.lit(False))
    each = F.flatten(
        F.transform(
            messages,
            lambda m: F.when(m.isNull(), F.array(F.lit("message_not_object"))).otherwise(
                F.array_compact(F.array(F.when(~_among(m["role"], packs.ROLES), "invalid_role"), F.when(blank(m["content"]), "empty_content")))
            ),
        )
    )
    return [
        Rule("invalid_category", ~_among(category, packs.CATEGORIES)),
        Rule("missing_messages", none),
        Rule("too_few_messages", some(F.size(roles) < 3)),
        Rule("bad_role_order", some(~F.slice(roles, 1, 3).eqNullSafe(F.array(*map(F.lit, packs.ROLES))))),
        Rule(codes=F.when(~none, each)),
        Rule("user_too_short", some(F.length(user) < 4)),
        Rule("assistant_too_short", some(F.length(answer) < 20)),
        coded(F.when(~none, sensitive(F.concat_ws("\n", user, answer)))),
        Rule("risky_assistant_commitment", some(hits(answer, packs.ASSISTANT_COMMITMENT))),
        Rule("bad_answer_phrase", some(holds_any(answer, packs.BAD_ANSWERS))),
        Rule("missing_system_text", some(system == "")),
    ]


def kb_key(chunk_id: Column, product_id: Column, id_: Column) -> Column:
    return filled(first_full(chunk_id, product_id, id_))


def kb_audit(key: Column, doc_type: Column, category: Column, title: Column, content: Column) -> list[Rule]:
    return [
        Rule("missing_doc_id", filled(key) == ""),
        Rule("invalid_doc_type", ~_among(doc_type, packs.KB_DOC_TYPES)),
        Rule("invalid_category", ~_among(category, packs.CATEGORIES) & ~doc_type.eqNullSafe("product")),
        Rule("missing_title", blank(title)),
        Rule("content_too_short", F.length(strip(filled(content))) < 10),
        coded(sensitive(F.concat_ws("\n", F.coalesce(title, F.lit("None")), F.coalesce(content, F.lit("None"))))),
    ]


def eval_rules(item: dict[str, Column], related: Column | None = None) -> list[Rule]:
    """Rules of an evaluation item for the first failure; ``related`` says whether its documents bear on it."""
    query, answer = (strip(filled(item[c])) for c in ("query", "reference_answer"))
    rag, human = (F.coalesce(item[c], F.lit(False)) for c in ("need_rag", "need_human"))
    empty = lambda c: F.size(string_list(item[c])) == 0
    return [
        *[Rule(f"missing_{c}", item[c].isNull()) for c in ("category", "eval_type", "difficulty", "query", "reference_answer", "must_include", "must_not_include", "need_human", "need_rag", "risk_tags")],
        Rule("invalid_category", ~_among(item["category"], packs.CATEGORIES)),
        Rule("invalid_eval_type", ~_among(item["eval_type"], packs.EVAL_TYPES)),
        Rule("invalid_difficulty", ~_among(item["difficulty"], packs.DIFFICULTIES)),
        Rule("bad_query", F.length(query) < 4),
        Rule("query_too_long", F.length(query) > 120),
        Rule("bad_reference_answer", F.length(answer) < 10),
        Rule("reference_answer_too_long", F.length(answer) > 400),
        *[Rule(f"empty_{c}", empty(c)) for c in ("must_include", "must_not_include", "risk_tags")],
        Rule("rag_type_but_need_rag_false", (item["eval_type"] == "rag") & ~rag),
        Rule("human_transfer_but_need_human_false", (item["eval_type"] == "human_transfer") & ~human),
        Rule("need_rag_but_no_expected_docs", rag & empty("expected_docs")),
        *([Rule("rag_docs_not_relevant", rag & ~related)] if related is not None else []),
    ]


def eval_audit(item: dict[str, Column], missing_docs: Column | None = None) -> list[Rule]:
    """All issues of an evaluation item; ``missing_docs`` is the array of documents that don't exist."""
    query, answer = item["query"], item["reference_answer"]
    empty = lambda c: item[c].isNull() | (F.size(string_list(item[c])) == 0)
    rag = item["need_rag"].eqNullSafe(True)
    no_docs = item["expected_docs"].isNull() | (F.size(item["expected_docs"]) < 1)
    return [
        *[Rule(f"missing_{c}", item[c].isNull()) for c in ("id", "category", "eval_type", "difficulty", "query", "reference_answer", "must_include", "must_not_include", "need_human", "need_rag", "risk_tags")],
        Rule("invalid_category", ~_among(item["category"], packs.CATEGORIES)),
        Rule("invalid_eval_type", ~_among(item["eval_type"], packs.EVAL_TYPES)),
        Rule("invalid_difficulty", ~_among(item["difficulty"], packs.DIFFICULTIES)),
        Rule("bad_query", _length(strip(query)) < 4),
        Rule("bad_reference_answer", _length(strip(answer)) < 10),
        *[Rule(f"empty_{c}", empty(c)) for c in ("must_include", "must_not_include", "risk_tags")],
        Rule("need_human_not_bool", item["need_human"].isNull()),
        Rule("need_rag_not_bool", item["need_rag"].isNull()),
        Rule("rag_eval_type_need_rag_false", item["eval_type"].eqNullSafe("rag") & ~rag),
        Rule("human_transfer_need_human_false", item["eval_type"].eqNullSafe("human_transfer") & ~item["need_human"].eqNullSafe(True)),
        Rule("need_rag_missing_expected_docs", rag & no_docs),
        *([Rule("expected_docs_not_in_kb", rag & ~no_docs & (F.size(F.coalesce(missing_docs, F.array().cast("array<string>"))) > 0))] if missing_docs is not None else []),
        coded(sensitive(F.concat_ws("\n", F.coalesce(query, F.lit("None")), F.coalesce(answer, F.lit("None"))))),
    ]


def _shape(messages: Column, least: int, exact: bool) -> Column:
    n = F.size(F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>")))
    return n != least if exact else n < least


def type_matches(text: Column, kind: Column, markers=packs.REJECTED_MARKERS) -> Column:
    """Whether a rejected answer bears the marks of its kind; a kind without marks always does."""
    out = F.lit(True)
    for name, patterns in markers.items():
        out = F.when(kind == name, hits(text, patterns)).otherwise(out)
    return out


def preference_rules(item: dict[str, Column], row_json: Column, most_alike: float = 0.82, match_type: bool = True) -> list[Rule]:
    """Rules of a preference item for the first failure; ``row_json`` is the whole row as JSON."""
    roles = _roles(item["prompt"])
    chosen, rejected = (strip(filled(F.get(item[c], F.lit(0))["content"])) for c in ("chosen", "rejected"))
    return [
        *[Rule(f"missing_{c}", item[c].isNull()) for c in ("id", "category", "source", "rejected_type", "severity", "prompt", "chosen", "rejected", "preference_reason")],
        Rule("invalid_category", ~_among(item["category"], packs.CATEGORIES)),
        Rule("invalid_rejected_type", ~_among(item["rejected_type"], packs.REJECTED_TYPES)),
        Rule("bad_prompt", _shape(item["prompt"], 2, False)),
        Rule("bad_chosen", _shape(item["chosen"], 1, True)),
        Rule("bad_rejected", _shape(item["rejected"], 1, True)),
        Rule("prompt_missing_system_or_user", ~(_has(roles, "system") & _has(roles, "user"))),
        *[Rule(f"{c}_not_assistant", ~F.get(item[c], F.lit(0))["role"].eqNullSafe("assistant")) for c in ("chosen", "rejected")],
        Rule("chosen_too_short", F.length(chosen) < 10),
        Rule("rejected_too_short", F.length(rejected) < 4),
        Rule("rejected_too_long", F.length(rejected) > 180),
        coded(sensitive(row_json)),
        Rule("chosen_has_risky_commitment", hits(chosen, packs.ASSISTANT_COMMITMENT)),
        Rule("chosen_rejected_too_similar", ratio(normal(chosen), normal(rejected)) >= most_alike),
        *([Rule("rejected_type_not_matched", (item["rejected_type"] != "wrong_intent") & ~type_matches(rejected, item["rejected_type"]))] if match_type else []),
        Rule("preference_reason_too_short", _length(strip(item["preference_reason"])) < 8),
    ]


def preference_audit(item: dict[str, Column], row_json: Column, most_alike: float = 0.82) -> list[Rule]:
    """All issues of a preference item."""
    roles = _roles(item["prompt"])
    short = _shape(item["prompt"], 2, False)
    chosen, rejected = (role_text(item[c], "assistant") for c in ("chosen", "rejected"))
    lone = lambda c: _shape(item[c], 1, True) | ~F.get(item[c], F.lit(0))["role"].eqNullSafe("assistant")
    return [
        *[Rule(f"missing_{c}", item[c].isNull()) for c in ("id", "category", "source", "source_id", "rejected_type", "severity", "prompt", "chosen", "rejected", "preference_reason")],
        Rule("invalid_category", ~_among(item["category"], packs.CATEGORIES)),
        Rule("invalid_rejected_type", ~_among(item["rejected_type"], packs.REJECTED_TYPES)),
        Rule("invalid_severity", ~_among(item["severity"], packs.SEVERITIES)),
        Rule("bad_prompt", short),
        Rule("prompt_missing_system_or_user", ~short & ~(_has(roles, "system") & _has(roles, "user"))),
        Rule("bad_chosen", lone("chosen")),
        Rule("bad_rejected", lone("rejected")),
        Rule("chosen_too_short", F.length(chosen) < 10),
        Rule("rejected_too_short", F.length(rejected) < 4),
        Rule("rejected_too_long", F.length(rejected) > 200),
        Rule("chosen_rejected_too_similar", (chosen != "") & (rejected != "") & (ratio(normal(chosen), normal(rejected)) >= most_alike)),
        Rule("chosen_has_risky_commitment", hits(chosen, packs.ASSISTANT_COMMITMENT)),
        coded(sensitive(row_json)),
        Rule("bad_preference_reason", _length(strip(item["preference_reason"])) < 8),
    ]


def drop_example(reason: Column, messages: Column, width: int = 200) -> Column:
    """What a report shows of a dropped sample."""
    cut = lambda role: F.substring(role_text(messages, role), 1, width)
    return F.struct(reason.alias("reason"), cut("user").alias("user"), cut("assistant").alias("assistant"))
