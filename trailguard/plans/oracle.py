"""DuckDB SQL of the registered queries: common table expressions by name, and a query over them for each."""

from __future__ import annotations

from .agent_log import BASE_SQL, LATEST_SQL, LOG_SQL

SK = r"\b(sk[-_](?:live|test)[-_][A-Za-z0-9]{10,})\b"
API = r"\b(api[-_]?key[-_]?[A-Za-z0-9]{16,})\b"
BEARER = r"""(?i)(?:auth[_ ]?token|bearer|token)[:\s]+["'']?([A-Za-z0-9+/=_-]{20,})["'']?"""
ACCT = r"\b(acct_[A-Za-z0-9_]{8,})\b"
_FOUND = " UNION ALL ".join(f"SELECT session_id, n, {i} AS pattern, unnest(regexp_extract_all(text, '{p}', 1)) AS value, unnest(range(len(regexp_extract_all(text, '{p}', 1)))) AS pos FROM agent_log WHERE kind = 'result' AND tool_name = 'read_ticket'" for i, p in enumerate((SK, API, BEARER, ACCT)))
MASK = "CASE WHEN length({0}) <= 4 THEN '****' WHEN length({0}) <= 10 THEN left({0}, 2) || '...' || right({0}, 2) ELSE left({0}, 3) || '...' || right({0}, 4) END"
B64, HEX = "base64(cast({0} AS blob))", "lower(hex({0}))"
FORMS = {
    "literal": "{0}", "base64": B64, "hex": HEX, "url_encoded": "url_encode({0})", "reversed": "reverse({0})",
    "base64_hex": B64.format(HEX), "hex_base64": HEX.format(B64), "base64_url": B64.format("url_encode({0})"), "base64_reversed": B64.format("reverse({0})"),
}
_FORMS = " UNION ALL ".join(f"SELECT session_id, n AS taint_n, hash, preview, {i} AS form_ord, '{k}' AS form, {v.format('value')} AS form_value FROM taint" for i, (k, v) in enumerate(FORMS.items()))

CTE = {
    "base": BASE_SQL,
    "latest": LATEST_SQL,
    "agent_log": LOG_SQL,
    "found": _FOUND,
    "taint": f"SELECT session_id, min(n) AS n, value, sha256(value) AS hash, {MASK.format('value')} AS preview FROM found GROUP BY session_id, value",
    "forms": _FORMS,
    "hits": "SELECT s.session_id, s.n, f.hash AS tainted_hash, f.preview, f.form AS match_form FROM agent_log s JOIN forms f ON f.session_id = s.session_id AND f.taint_n < s.n AND contains(s.text, f.form_value) WHERE s.tool_name = 'send_message' QUALIFY row_number() OVER (PARTITION BY s.session_id, s.n ORDER BY f.taint_n, f.form_ord) = 1",
    # one row per session and event; a leg is the event that lit it, 0 for dark, and is checked before the event lights it
    "legs": """
SELECT session_id, CAST(0 AS BIGINT) AS n, TIMESTAMP '1970-01-01' AS ts, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS a_us, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS b_us, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS c_us FROM (SELECT DISTINCT session_id FROM agent_log)
UNION ALL
SELECT session_id, n, ts,
  CASE WHEN ka THEN a WHEN la THEN n ELSE 0 END, CASE WHEN ka THEN a_us WHEN la THEN us ELSE 0 END,
  CASE WHEN kb THEN b WHEN lb THEN n ELSE 0 END, CASE WHEN kb THEN b_us WHEN lb THEN us ELSE 0 END,
  CASE WHEN kc THEN c WHEN lc THEN n ELSE 0 END, CASE WHEN kc THEN c_us WHEN lc THEN us ELSE 0 END
FROM (SELECT e.session_id, e.n, e.ts, epoch_us(e.ts) AS us, p.a, p.a_us, p.b, p.b_us, p.c, p.c_us,
    e.tool_name IS NOT DISTINCT FROM 'read_ticket' AS la, e.tool_name IS NOT DISTINCT FROM 'fetch_page' AS lb, (e.tool_name IS NOT DISTINCT FROM 'send_message' OR e.kind = 'syscall') AS lc,
    p.a > 0 AND e.n - p.a < 32 AND epoch_us(e.ts) - p.a_us < 259200000000 AS ka, p.b > 0 AND e.n - p.b < 32 AND epoch_us(e.ts) - p.b_us < 259200000000 AS kb, p.c > 0 AND e.n - p.c < 32 AND epoch_us(e.ts) - p.c_us < 259200000000 AS kc
  FROM legs p JOIN agent_log e ON e.session_id = p.session_id AND e.n = p.n + 1)
""",
    "states": "SELECT session_id, n, a AS source_lit, b AS untrusted_lit, c AS sink_lit FROM legs WHERE n > 0",
    "excerpts": "SELECT e.session_id, e.n, e.text, s.untrusted_lit AS epoch, lead(e.n, 8) OVER (PARTITION BY e.session_id, s.untrusted_lit ORDER BY e.n) AS until FROM agent_log e JOIN states s USING (session_id, n) WHERE e.tool_name = 'fetch_page'",
    "all_bound": "SELECT DISTINCT k.session_id, k.n FROM agent_log k JOIN states s USING (session_id, n) JOIN excerpts e ON e.session_id = k.session_id AND e.epoch = s.untrusted_lit AND e.n < k.n AND (e.until IS NULL OR k.n < e.until) WHERE k.tool_name = 'send_message' AND s.untrusted_lit > 0 AND len(list_filter(range(1, length(k.text) - 14), lambda i: contains(e.text, substring(k.text, i, 16)))) > 0",
    "verdicts": "SELECT k.session_id, k.n, k.ts, k.text, s.source_lit, s.untrusted_lit, s.sink_lit, h.tainted_hash, h.preview, h.match_form, CASE WHEN h.tainted_hash IS NOT NULL THEN 'EXFIL' WHEN s.source_lit > 0 AND s.untrusted_lit > 0 AND s.sink_lit > 0 AND b.n IS NOT NULL THEN 'SUSPICIOUS' END AS verdict FROM agent_log k JOIN states s USING (session_id, n) LEFT JOIN hits h USING (session_id, n) LEFT JOIN all_bound b USING (session_id, n) WHERE k.tool_name = 'send_message'",
    "trips": "SELECT *, CASE verdict WHEN 'EXFIL' THEN 'prevented' ELSE 'allowed_monitor' END AS action, CASE verdict WHEN 'EXFIL' THEN 0.95 ELSE 0.6 END AS confidence, epoch_us(ts) * 1000 AS trip_ts_ns FROM verdicts WHERE verdict IS NOT NULL",
    "calls": "SELECT event_id, ts, 'node' || cast(user_id % 3 AS string) AS node, cast(user_id % 20 AS integer) AS pid, CASE WHEN event_type IN ('error', 'click') THEN 'connect' ELSE 'write' END AS syscall, '10.96.0.' || cast(event_id % 12 AS string) AS dest_ip, cast(443 AS integer) AS dest_port, event_id AS ingest_seq FROM events WHERE event_type IN ('error', 'click', 'view')",
}
_NEEDS = {
    "latest": ["base"], "agent_log": ["latest"], "found": ["agent_log"], "taint": ["found"], "forms": ["taint"], "hits": ["forms"], "legs": ["agent_log"], "states": ["legs"],
    "excerpts": ["states"], "all_bound": ["excerpts"], "verdicts": ["hits", "all_bound"], "trips": ["verdicts"],
}


def sql(query: str, *names: str) -> str:
    """query with the named expressions, and those that they need, before it."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        wanted.add(name)

    for name in names:
        add(name)
    parts = ", ".join(f"{k} AS ({v})" for k, v in CTE.items() if k in wanted)
    # a query that goes on with expressions of its own begins with a comma
    return f"WITH RECURSIVE {parts} {query}" if parts else query
