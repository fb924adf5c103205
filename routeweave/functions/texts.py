"""What may be said about an event, and its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of events with their labels, texts that stand for no end, and the text of a hijack.
LABELS = {"hijack": "前缀劫持", "sub_hijack": "子前缀劫持", "prefix_outage": "前缀中断", "as_outage": "AS中断", "country_outage": "国家中断", "leak": "路由泄漏"}
NO_END = ("", "-", "None", "NaT")
HIJACK_TEXT = "在北京时间 %s , 归属于 %s 的前缀 %s 被 %s 劫持。"


def event_kind(label: Column) -> Column:
    """The kind of a label; kinds and unknown texts are themselves."""
    kinds = F.create_map(*[F.lit(x) for kind, text in LABELS.items() for x in (text, kind)])
    return F.coalesce(F.try_element_at(kinds, label), label)


def guardrails(event_type: Column, end_time: Column) -> Column:
    """struct(lifecycle_state, attribution_state, ratio_state, blocked_claims, reason_codes): what an event's record supports, and what must not be concluded from it."""
    kind = event_kind(event_type)
    leak, prefix, ratio = kind == "leak", kind == "prefix_outage", kind.isin("as_outage", "country_outage")
    ended = end_time.isNotNull() & ~end_time.isin(*NO_END)
    some = lambda holds, *names: F.when(F.coalesce(holds, F.lit(False)), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    claims = F.concat(F.array(F.lit("causal_conclusion")), some(leak, "event_end", "duration", "recovery_state", "ongoing_state"), some(prefix, "responsible_as", "causal_attribution"), some(ratio, "stored_ratio_as_authoritative"))
    reasons = F.concat(some(leak, "legacy_leak_lifecycle_missing"), some(prefix, "legacy_moas_attribution_bias"), some(ratio, "legacy_ratio_recompute_required"))
    return F.struct(
        F.when(leak, "unavailable").when(ended, "recorded").otherwise("unknown").alias("lifecycle_state"), F.when(prefix, "legacy_biased").otherwise("detector_fact_only").alias("attribution_state"),
        F.when(ratio, "recompute_required").otherwise("not_applicable").alias("ratio_state"), claims.alias("blocked_claims"), reasons.alias("reason_codes"),
    )


def named_as(asn: Column, name: Column, country: Column) -> Column:
    """``AS 1(name , country )``; parts that are NULL are left out, and the brackets if both are."""
    inside = F.when(name.isNotNull() & country.isNotNull(), F.concat(name, F.lit(" , "), country)).otherwise(F.coalesce(name, country))
    return F.concat(F.lit("AS "), asn.cast("string"), F.when(inside.isNull(), "").otherwise(F.concat(F.lit("("), inside, F.lit(" )"))))


def hijack_text(at: Column, owner: Column, prefix: Column, suspect: Column) -> Column:
    """One sentence: when, whose prefix, by whom. ``owner`` and ``suspect`` of ``named_as``."""
    return F.format_string(HIJACK_TEXT, at, owner, prefix, suspect)
