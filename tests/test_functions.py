import base64
import gzip
import json

import pytest
from pyspark.sql import functions as F

from trailguard import config
from trailguard.functions import render
from trailguard.functions import text as t

SECRET = "sk-live-51TxJANEd0eR3aLt0k3n98765"


def value(spark, column, **literals):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column).first()
    return row[0]


@pytest.mark.parametrize("v,want", [("abcd", "****"), ("abcdefgh", "ab...gh"), ("abcdefghijkl", "abc...ijkl"), ("", "****")])
def test_mask(spark, v, want):
    assert value(spark, t.mask("v"), v=v) == want


@pytest.mark.parametrize(
    "text,want",
    [
        (f"key {SECRET} end", [SECRET]),
        ("api_key_abcdefghij0123456789", ["api_key_abcdefghij0123456789"]),
        ('Auth_Token: "abcdefghij0123456789=="', ["abcdefghij0123456789=="]),
        ("acct_12345678, again acct_12345678", ["acct_12345678", "acct_12345678"]),
        (f"é{SECRET}é", [SECRET]),
        (f"x{SECRET}", []),
        ("sk-live-short", []),
        ("token\x0babcdefghij0123456789", []),
    ],
)
def test_secrets(spark, text, want):
    assert [s["value"] for s in value(spark, t.secrets("v", config.PATTERNS), v=text)] == want


def test_forms(spark):
    got = {f["form"]: f["form_value"] for f in value(spark, t.encoded_forms("v"), v=SECRET)}
    b64, hx = base64.b64encode(SECRET.encode()).decode(), SECRET.encode().hex()
    assert got == {"literal": SECRET, "base64": b64, "hex": hx, "url_encoded": SECRET, "reversed": SECRET[::-1], "base64_hex": base64.b64encode(hx.encode()).decode(), "hex_base64": b64.encode().hex(), "base64_url": b64, "base64_reversed": base64.b64encode(SECRET[::-1].encode()).decode()}
    assert value(spark, t.encoded_forms("v"), v="") == []


@pytest.mark.parametrize("v,want", [("c2VjcmV0", "secret"), (" c2VjcmV0\n", "secret"), ("c2Vjcm", "secr"), ("c2Vj cmV0", None), ("abc", None), ("c2VjcmV0=", None), ("a-b_", None)])
def test_base64(spark, v, want):
    assert value(spark, t.try_base64("v"), v=v) == want


@pytest.mark.parametrize("v,want", [("73656372", "secr"), ("7365637", None), ("zz", None), ("73 6563", None), ("AbCd", "\xab\xcd")])
def test_hex(spark, v, want):
    assert value(spark, t.try_hex("v"), v=v) == want


@pytest.mark.parametrize("v,want", [("plain text", True), ("\x01\x02\x03\x04\x05\x06", False), ("ab\x01", False), ("abcd\x01", True), ("deadbeef", True)])
def test_plausible(spark, v, want):
    assert value(spark, t.plausible("v"), v=v) is want


def test_json_leaves_and_result_text(spark):
    doc = json.dumps({"b": ["x", {"z": "y"}], "a": "w", "n": 1})
    assert value(spark, t.json_leaves("v"), v=doc) == ["w", "x", "y"]
    assert value(spark, t.json_leaves("v"), v="no json") == []
    assert value(spark, t.result_text("v"), v=json.dumps({"content": [{"type": "text", "text": "T"}], "meta": {"k": "M"}})) == "T\nM\n"
    assert value(spark, t.result_text("v"), v="raw") == "raw"
    assert value(spark, t.result_text("v"), v='{"n": 1}') == '{"n": 1}'


def test_inflated_takes_other_compressors(spark):
    token = base64.b64encode(gzip.compress(SECRET.encode(), 1)).decode()
    assert value(spark, t.inflated("v"), v=f"x {token} H4sInonsense") == [SECRET]


def test_redact_and_grams(spark):
    df = spark.createDataFrame([(f"a {SECRET} b", [{"form_value": SECRET, "preview": "sk-...8765"}, {"form_value": "", "preview": "!"}])], "s string, f array<struct<form_value:string,preview:string>>")
    assert df.select(t.redact("s", "f")).first()[0] == "a sk-...8765 b"
    assert sorted(value(spark, t.grams("v", 3), v="abcabc")) == ["abc", "bca", "cab"]
    assert value(spark, t.grams("v", 9), v="abc") == []


def test_render(spark):
    assert value(spark, render.dotted_quad("v"), v=0x0100007F) == "127.0.0.1"
    assert value(spark, render.normal_ip("v"), v=" ::FFFF:10.0.0.1%eth0") == "10.0.0.1"
    hex64 = "ab" * 32
    assert value(spark, render.container_id("v"), v=f"0::/kubepods/cri-containerd-{hex64}.scope") == hex64
    assert value(spark, render.cgroup_v2_path("v"), v="1:cpu:/x\n0::/a/b") == "/a/b"
    assert value(spark, render.percent("v"), v=0.1333) == "13.3%"
    assert value(spark, t.redact_header("v"), v="Bearer abcdef") == "Bear…[REDACTED]"


def test_milliseconds_are_exact(spark):
    for ms in range(1705969041660, 1705969041668):
        assert [value(spark, render.ns_to_ms("v"), v=ms * 1_000_000 + ns) for ns in (0, 1, 999_999)] == [ms] * 3
    assert value(spark, render.ns_to_ms("v"), v=-1_500_000) == -1  # as integers divide in SQL


def test_settings():
    assert config.Settings(max_records=0, payload_capture_bytes=9).max_records == 1000
    assert config.Settings(payload_capture_bytes=5000).payload_capture_bytes == 1024
    with pytest.raises(ValueError):
        config.Settings(mode="kill")
    assert len(config.Settings().warnings()) == 2
