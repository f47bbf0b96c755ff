"""A session log for the registered queries, derived from the table `events` by one SQL text that Spark and DuckDB read
alike: views read tickets (some with a secret), clicks fetch web pages, purchases send messages, signups search, errors
are system calls. A message's body is, by event_id, the session's latest secret, plain or encoded, or its latest web text,
or something else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings

BASE_SQL = """
SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id, ts, event_type, value,
  CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'sk-live-' || substring(md5(cast(cast(event_id AS string) AS binary)), 1, 24) END AS secret,
  CASE WHEN event_type = 'click' THEN 'Product note ' || substring(md5(cast('c' || cast(event_id AS string) AS binary)), 1, 20) || ' details' END AS web
FROM events
"""
LATEST_SQL = """
SELECT *, max(CASE WHEN secret IS NOT NULL THEN n END) OVER (PARTITION BY session_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS secret_n,
  max(CASE WHEN web IS NOT NULL THEN n END) OVER (PARTITION BY session_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS web_n
FROM base
"""
LOG_SQL = """
SELECT l.session_id, l.n, l.event_id, l.ts, l.value, l.secret,
  CASE l.event_type WHEN 'view' THEN 'result' WHEN 'click' THEN 'result' WHEN 'error' THEN 'syscall' ELSE 'request' END AS kind,
  CASE l.event_type WHEN 'view' THEN 'read_ticket' WHEN 'click' THEN 'fetch_page' WHEN 'purchase' THEN 'send_message' WHEN 'signup' THEN 'search_docs' END AS tool_name,
  CASE l.event_type WHEN 'view' THEN 'tickets' WHEN 'click' THEN 'web' WHEN 'purchase' THEN 'messenger' WHEN 'signup' THEN 'docs' END AS server_id,
  CASE l.event_type
    WHEN 'view' THEN coalesce('Customer record ' || l.secret, 'Ticket ' || cast(l.event_id AS string) || ' is open')
    WHEN 'click' THEN l.web
    WHEN 'purchase' THEN CASE l.event_id % 7
      WHEN 0 THEN s.secret WHEN 1 THEN replace(base64(cast(s.secret AS binary)), chr(13) || chr(10), '') WHEN 2 THEN lower(hex(s.secret)) WHEN 3 THEN reverse(s.secret)
      WHEN 5 THEN 'FYI ' || w.web ELSE 'Quarterly numbers of order ' || cast(l.event_id AS string) END
  END AS text
FROM latest l
LEFT JOIN base s ON s.session_id = l.session_id AND s.n = l.secret_n
LEFT JOIN base w ON w.session_id = l.session_id AND w.n = l.web_n
"""
AGENT_LOG_SQL = f"WITH base AS ({BASE_SQL}), latest AS ({LATEST_SQL}) {LOG_SQL}"
#: Sessions of this log last weeks, so legs hold for days here; their other limit is the default.
SETTINGS = Settings(
    leg_ttl_s=3 * 86400,
    tool_tags={"read_ticket": ["sensitive_source"], "send_message": ["external_sink"], "http_post": ["external_sink"], "fetch_page": [], "internal_note": []},
    server_tags={"tickets": ["sensitive_source"], "messenger": ["external_sink"], "web": []},
    egress_allowlist=("10.96.0.1", "10.96.0.10"),
    sensitive_paths=("/etc/shadow", "/var/run/secrets", "/secrets"),
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def agent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(AGENT_LOG_SQL.replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))
