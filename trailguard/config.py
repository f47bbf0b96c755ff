"""Settings with their defaults, validation, and the small dimension tables made from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Secret patterns: name, regular expression, group that is the secret. Fixed values. Word boundaries and white space are
#: spelled out as ASCII, which is what they mean here; Java's \b and \s would take more characters.
PATTERNS = (
    ("sk_key", r"(?<![A-Za-z0-9_])(sk[-_](?:live|test)[-_][A-Za-z0-9]{10,})(?![A-Za-z0-9_])", 1),
    ("api_key", r"(?<![A-Za-z0-9_])(api[-_]?key[-_]?[A-Za-z0-9]{16,})(?![A-Za-z0-9_])", 1),
    ("bearer", r"(?i)(?:auth[_ ]?token|bearer|token)[:\t\n\f\r ]+[\"']?([A-Za-z0-9+/=_-]{20,})[\"']?", 1),
    ("account", r"(?<![A-Za-z0-9_])(acct_[A-Za-z0-9_]{8,})(?![A-Za-z0-9_])", 1),
)
MODES, MIN_VERDICTS, FORMATS = ("block", "monitor"), ("EXFIL", "SUSPICIOUS"), ("json", "parquet")


@dataclass(frozen=True)
class Settings:
    leg_ttl_s: float = 30 * 60
    decay_after_calls: int = 32
    content_bind_min_len: int = 16
    fragment_max_chunks: int = 16
    fragment_max_bytes: int = 65536
    payload_capture_bytes: int = 512
    idle_timeout_s: float = 30 * 60
    max_concurrent: int = 32
    max_records: int = 1000
    mode: str = "block"
    min_verdict: str = "SUSPICIOUS"
    evidence_format: str = "json"
    untrusted_tool_results: bool = True
    tool_tags: dict[str, list[str]] = field(default_factory=dict)
    server_tags: dict[str, list[str]] = field(default_factory=dict)
    egress_allowlist: tuple[str, ...] = ()
    sensitive_paths: tuple[str, ...] = ()
    patterns: tuple[tuple[str, str, int], ...] = PATTERNS

    def __post_init__(self) -> None:
        for name, value, known in (("mode", self.mode, MODES), ("min_verdict", self.min_verdict, MIN_VERDICTS), ("evidence_format", self.evidence_format, FORMATS)):
            if value not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}, not {value!r}")
        for name in ("content_bind_min_len", "fragment_max_chunks", "fragment_max_bytes"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        # zero means the default for retention, and capture has a fixed range
        object.__setattr__(self, "max_records", self.max_records or 1000)
        object.__setattr__(self, "payload_capture_bytes", max(64, min(1024, self.payload_capture_bytes)))

    def warnings(self) -> list[str]:
        """What makes detection impossible although the settings are valid."""
        tags = [t for own in (*self.tool_tags.values(), *self.server_tags.values()) for t in own]
        return [f"no tool or server is tagged {t}" for t in ("sensitive_source", "external_sink") if t not in tags]


def _tags(spark: SparkSession, name: str, tags: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame(list(tags.items()), f"{name} string, tags array<string>")


def tool_tags(spark: SparkSession, settings: Settings) -> DataFrame:
    return _tags(spark, "tool_name", settings.tool_tags)


def server_tags(spark: SparkSession, settings: Settings) -> DataFrame:
    return _tags(spark, "server_id", settings.server_tags)


def allowlist(spark: SparkSession, settings: Settings) -> DataFrame:
    return spark.createDataFrame([(ip,) for ip in settings.egress_allowlist], "ip string")
