"""Entities named in a request, by ordered word rules and number patterns; all built-in expressions.

Each rule list is tried in order and the first rule of which a word occurs decides. Words are sought as
substrings; `text` is taken as it is, `lowered` in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from switchyard.functions.text import extract_ip, extract_percent, extract_topn, first_match

# Words and what they mean, in the order in which they are tried, so that the same entities are found.
TIME_RANGES = [(["近24小时", "24小时"], "last_24h"), (["近7天"], "last_7d"), (["近14天"], "last_14d"), (["近30天"], "last_30d"), (["近90天"], "last_90d"), (["今天"], "today"), (["昨天"], "yesterday"), (["本周"], "this_week")]
SEVERITIES = [(["严重", "critical", "p1"], "critical"), (["次严重", "major", "p2"], "major"), (["一般", "minor", "p3"], "minor")]
ALARM_STATES = [(["未恢复", "active"], "active"), (["已恢复", "closed"], "closed")]
SCOPES = [(["全网"], "network"), (["核心网"], "core_network"), (["端口"], "port"), (["接口"], "interface"), (["链路"], "link"), (["基站"], "site"), (["设备"], "device"), (["区域", "地市", "bgp", "ospf", "isis"], "network")]
REGIONS = [([r], r) for r in ("北京", "上海", "广州", "深圳", "华东", "华南", "华北", "华中", "西北", "西南")]
INTENTS = [(["趋势"], "trend"), (["离线设备数"], "offline_count"), (["关联率", "相关性"], "analysis"), (["top", "前"], "topn"), (["根因"], "root_cause"), (["预测"], "forecast")]
METRICS = [(["丢包率", "丢包"], "packet_loss"), (["时延", "延迟"], "latency"), (["抖动"], "jitter"), (["cpu"], "cpu_usage"), (["内存"], "memory_usage"), (["带宽"], "bandwidth_usage"), (["吞吐"], "throughput"), (["错误包"], "error_packet"), (["恢复时长"], "recovery_duration")]
PROTOCOLS = [([p], p) for p in ("bgp", "ospf", "isis", "mpls")]
#: Name, rules, and whether words are sought in lower case.
RULES = {
    "severity": (SEVERITIES, False), "alarm_status": (ALARM_STATES, False), "object_scope": (SCOPES, False), "region_hint": (REGIONS, False),
    "intent": (INTENTS, False), "metric": (METRICS, True), "protocol": (PROTOCOLS, True),
}
TIME_CONFIDENCE = 0.95


def first_word(text: Column, rules: list[tuple[list[str], str]]) -> Column:
    """The word that made the first matching rule match; null if none does."""
    return first_match(text, [([w], w) for words, _ in rules for w in words])


def time_range(text: Column, timezone: str) -> Column:
    """A relative time range as a struct: mode, preset, timezone, the word found, confidence; null if none is named."""
    preset = first_match(text, TIME_RANGES)
    found = F.struct(F.lit("relative").alias("mode"), preset.alias("preset"), F.lit(timezone).alias("timezone"), first_word(text, TIME_RANGES).alias("original_text"), F.lit(TIME_CONFIDENCE).alias("confidence"))
    return F.when(preset.isNotNull(), found)


def extract_entities(text: Column, timezone: str) -> Column:
    """All entities of a text as a map of name to text (time_range as JSON); names without a value are left out."""
    low = F.lower(text)
    values = {"time_range": F.to_json(time_range(text, timezone)), "topn": extract_topn(text).cast("string"), "device_ip": extract_ip(text), "threshold_percent": extract_percent(text).cast("string")}
    values |= {name: first_match(low if lowered else text, rules) for name, (rules, lowered) in RULES.items()}
    return F.map_filter(F.create_map(*(x for name, v in values.items() for x in (F.lit(name), v))), lambda _, v: v.isNotNull())
