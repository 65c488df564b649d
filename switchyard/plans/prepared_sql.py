"""SQL that checks the queries of packed fields, failing rows and orphan references."""

from __future__ import annotations

_SEP = r",;|\t\n\r、，；｜"
_QUOTED = """(?:"(?:[^"]|"")*"|''(?:[^'']|'''')*''|“[^”]*”)"""
_TAGS = rf"""
  WITH f AS (SELECT row_id, regexp_replace(tags, '^\s+|\s+$', '', 'g') AS t FROM seed_cases_template WHERE tags IS NOT NULL),
  b AS (SELECT row_id, CASE WHEN regexp_matches(t, '^\[.*\]$', 's') THEN t[2:-2] ELSE t END AS t FROM f),
  p AS (SELECT row_id, list_transform(regexp_extract_all(t, '[ ]*{_QUOTED}[^{_SEP}]*|[^{_SEP}]+'), lambda x: trim(x)) AS ps FROM b),
  v AS (SELECT row_id, list_filter(list_transform(ps, lambda x: CASE WHEN x[1] = '"' THEN trim(replace(x[2:-2], '""', '"')) WHEN x[1] IN ('''', '“') THEN trim(x[2:-2]) ELSE x END), lambda x: x <> '') AS vs FROM p),
  found AS (SELECT row_id, CAST(unnest(generate_series(1, len(vs))) AS INTEGER) AS pos, unnest(vs) AS tag FROM v WHERE len(vs) > 0)
"""

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_PLAIN = r"""regexp_replace(CASE WHEN @[1] = '"' THEN replace(@[2:-2], '""', '"') ELSE @ END, '^\s+|\s+$', '', 'g')"""
_RAW = rf"""
  WITH q AS (SELECT line_id, raw_line AS r, regexp_full_match(raw_line, '{_FIELD}(?:,{_FIELD})*', 's') AS ok, length(regexp_replace(regexp_replace(raw_line, '"(?:[^"]|"")*"', '', 'gs'), '[^,]', '', 'gs')) + 1 AS n FROM seed_cases_raw),
  x AS (SELECT *, regexp_extract(r, '^({_FIELD})', 1, 's') AS c, regexp_extract(r, '^(?:{_FIELD},){{5}}({_FIELD})', 1, 's') AS j FROM q),
  u AS (SELECT *, {_PLAIN.replace("@", "c")} AS case_id, {_PLAIN.replace("@", "j")} AS slots FROM x),
  found AS (SELECT line_id, CASE WHEN NOT ok THEN 'quoting' WHEN n <> 14 THEN 'columns' WHEN NOT regexp_full_match(case_id, '[A-Za-z0-9_.-]{{1,64}}') THEN 'case_id'
    WHEN slots <> '' AND NOT (json_valid(slots) AND json_type(CASE WHEN json_valid(slots) THEN slots ELSE '0' END) = 'OBJECT' AND NOT regexp_matches(slots, ',\s*[}}\]]|:\s*-?(NaN|Infinity)')) THEN 'slots_json' END AS reason FROM u)
"""

_COLUMNS = "case_id scene_id label text route_type slots_json tags priority owner version enabled risk_level source notes".split()
_VALUE = r"""CASE WHEN fs[#][1] = '"' THEN replace(fs[#][2:-2], '""', '"') ELSE fs[#] END"""
_CLEAN = rf"nullif(regexp_replace({_VALUE}, '^\s+|\s+$', '', 'g'), '')"
_SPECIAL = {
    "text": f"CASE WHEN {_CLEAN} IS NOT NULL THEN {_VALUE} END",
    "priority": f"TRY_CAST({_CLEAN} AS INTEGER)",
    "enabled": f"CASE WHEN lower({_CLEAN}) IN ('1', 'true', 'yes', 'y', 'on') THEN true WHEN lower({_CLEAN}) IN ('0', 'false', 'no', 'n', 'off') THEN false END",
}
_LOADED = rf"""{_RAW}, fields AS (SELECT line_id, regexp_extract_all(raw_line, '(?:^|,)({_FIELD})', 1, 's') AS fs FROM seed_cases_raw JOIN found USING (line_id) WHERE reason IS NULL)
  SELECT line_id, {", ".join(_SPECIAL.get(c, _CLEAN).replace("#", str(i + 1)) + f" AS {c}" for i, c in enumerate(_COLUMNS))} FROM fields"""

_ORPHANS = """
  WITH refs AS (
    SELECT 'seed_cases_template' AS ref_table, CAST(row_id AS VARCHAR) AS ref_id, scene_id AS k, created_at AS t FROM seed_cases_template
    UNION ALL SELECT 'capability_intents', intent_id, capability_id, created_at FROM capability_intents),
  found AS (
    SELECT ref_table, ref_id, t,
      CASE WHEN NOT EXISTS (SELECT 1 FROM capabilities c WHERE c.capability_id = k) THEN 'missing'
           WHEN EXISTS (SELECT 1 FROM capabilities c WHERE c.capability_id = k AND c.created_at <= t) THEN 'deleted'
           ELSE 'late' END AS kind
    FROM refs WHERE k IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM capabilities c WHERE c.capability_id = k AND c.created_at <= t AND (c.deleted_at IS NULL OR t < c.deleted_at)))
"""

SQL = {
    "p3_found": _TAGS + "SELECT row_id, pos, tag FROM found",
    "p3_tag_counts": _TAGS + "SELECT tag, count(*) AS n_uses, CAST(count(*) FILTER (pos = 1) AS BIGINT) AS n_first FROM found GROUP BY tag",
    "p4_found": _RAW + "SELECT line_id, reason FROM found WHERE reason IS NOT NULL",
    "p4_loaded": _LOADED,
    "p6_found": _ORPHANS + "SELECT ref_table, ref_id, kind FROM found",
    "p6_by_month": _ORPHANS + "SELECT ref_table, strftime(t, '%Y-%m') AS month, kind, COUNT(*) AS n_orphans FROM found GROUP BY 1, 2, 3",
}
