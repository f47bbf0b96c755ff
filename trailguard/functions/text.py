"""Text, secret and encoding functions. Lengths are bytes: a text is turned into one character per byte where that
matters, so substrings and lengths of characters are those of bytes."""

from __future__ import annotations

import base64
import json
import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_bytes(c: ColumnOrName) -> Column:
    """One character per byte of the UTF-8 text."""
    return F.decode(F.encode(col(c), "UTF-8"), "ISO-8859-1")


def from_bytes(c: ColumnOrName) -> Column:
    """Back to text; bytes that a cut left without the rest of their character stay as they are."""
    return F.encode(col(c), "ISO-8859-1").cast("string")


def sha256(c: ColumnOrName) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def mask(c: ColumnOrName) -> Column:
    """Preview of a secret: at most its first three and last four characters."""
    c = col(c)
    n = F.length(c)
    return F.when(n <= 4, "****").when(n <= 10, F.concat(F.substring(c, 1, 2), F.lit("..."), F.right(c, F.lit(2)))).otherwise(F.concat(F.substring(c, 1, 3), F.lit("..."), F.right(c, F.lit(4))))


def _place(pattern: int):
    return lambda value, pos: F.struct(F.lit(pattern).alias("pattern"), pos.alias("pos"), value.alias("value"))


def secrets(text: ColumnOrName, patterns) -> Column:
    """Array of (pattern, pos, value): matches of all patterns in order, then by place."""
    parts = []
    for i, (_, regex, group) in enumerate(patterns):
        found = F.regexp_extract_all(col(text), F.lit(regex), F.lit(group))
        parts.append(F.transform(found, _place(i)))
    return F.concat(*parts) if parts else F.expr("cast(array() as array<struct<pattern:int,pos:int,value:string>>)")


def _b64(c: Column) -> Column:
    return F.translate(F.base64(c.cast("binary")), "\r\n", "")


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c.cast("binary")))


#: Encoded forms of a secret, in the order in which they are matched; the tenth, gzip, is matched by inflating.
FORMS = {
    "literal": lambda v: v,
    "base64": _b64,
    "hex": _hex,
    "url_encoded": F.url_encode,
    "reversed": F.reverse,
    "base64_hex": lambda v: _b64(_hex(v)),
    "hex_base64": lambda v: _hex(_b64(v)),
    "base64_url": lambda v: _b64(F.url_encode(v)),
    "base64_reversed": lambda v: _b64(F.reverse(v)),
}
#: Forms that a decoded text is searched for.
SINGLE = ("literal", "base64", "hex", "url_encoded", "reversed")


def encoded_forms(value: ColumnOrName, names=tuple(FORMS)) -> Column:
    """Array of (form_ord, form, form_value); empty for an empty value."""
    v = col(value)
    all_ = F.array(*[F.struct(F.lit(i).alias("form_ord"), F.lit(name).alias("form"), make(v).alias("form_value")) for i, (name, make) in enumerate(FORMS.items()) if name in names])
    return F.when(F.length(v) > 0, all_).otherwise(F.slice(all_, F.lit(1), F.lit(0)))


def redact(text: ColumnOrName, forms: ColumnOrName) -> Column:
    """text with the form_value of each of the forms (array of form_value, preview), in order, replaced by its preview."""
    return F.aggregate(F.filter(col(forms), lambda f: f["form_value"] != ""), col(text), lambda out, f: F.replace(out, f["form_value"], f["preview"]))


# ---- strict decoding -----------------------------------------------------------------------------------------------
_B64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{2,3})?$"
DEPTH, MOST_BYTES, LEAST_BYTES = 3, 8192, 4


def try_base64(s: ColumnOrName) -> Column:
    """What standard base64, padded or not, of the whole trimmed text stands for, a character per byte; else null."""
    t = F.translate(F.trim(F.regexp_replace(col(s), r"^\s+|\s+$", "")), "\r\n", "")
    fits = (F.length(t) >= LEAST_BYTES) & t.rlike(_B64)
    padded = F.rpad(t, ((F.length(t) + 3) / 4).cast("int") * 4, "=")
    return F.when(fits, F.decode(F.unbase64(padded), "ISO-8859-1"))


def try_hex(s: ColumnOrName) -> Column:
    t = F.regexp_replace(col(s), r"^\s+|\s+$", "")
    return F.when((F.length(t) >= LEAST_BYTES) & (F.length(t) % 2 == 0) & t.rlike("^[0-9A-Fa-f]+$"), F.decode(F.unhex(t), "ISO-8859-1"))


def plausible(s: ColumnOrName) -> Column:
    """Whether a decoded text (a character per byte) may be a further layer: hex, base64 or mostly printable."""
    s = col(s)
    n, raw = F.length(s), F.encode(s, "ISO-8859-1")
    valid = F.is_valid_utf8(raw.cast("string"))
    text = F.when(valid, F.decode(raw, "UTF-8"))
    of_bytes = F.floor(F.length(F.regexp_replace(s, r"[^\x20-\x7E\n\r\t]", "")) * 100 / n)
    of_chars = F.floor(F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")) * 100 / F.length(text))
    looks_hex = s.rlike("^[0-9A-Fa-f]+$") & (n % 2 == 0) & (n >= LEAST_BYTES)
    looks_b64 = F.regexp_replace(s, r"^\s+|\s+$", "").rlike(r"^[A-Za-z0-9+/]{2,}={0,2}$") & (n >= LEAST_BYTES)
    return (n > 0) & (n <= MOST_BYTES) & (looks_hex | looks_b64 | (F.when(valid, of_chars).otherwise(of_bytes) >= 80))


def decode_layers(s: ColumnOrName) -> Column:
    """One step: array of (step, decoded) for base64 then hex, of what is not empty or too long."""
    each = F.array(F.struct(F.lit("base64").alias("step"), try_base64(s).alias("decoded")), F.struct(F.lit("hex").alias("step"), try_hex(s).alias("decoded")))
    return F.filter(each, lambda x: F.length(x["decoded"]).between(1, MOST_BYTES))


# ---- JSON ----------------------------------------------------------------------------------------------------------
def _load(text: str):
    def constant(name: str):
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=constant)
    except (ValueError, TypeError, RecursionError):
        return None


def _leaves(node, out: list[str]) -> list[str]:
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            todo += [x[k] for k in sorted(x, reverse=True)]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_leaves(text: pd.Series) -> pd.Series:
    """String leaves of JSON of any depth, keys in order; none if it isn't JSON. Built-in functions have no recursion."""
    return text.map(lambda t: _leaves(_load(t), []) if isinstance(t, str) else [])


_MOST_TEXT, _MOST_DEPTH = 64 * 1024, 8


def _result_text(raw: str) -> str:
    node = _load(raw)
    if node is None:
        return raw
    out: list[str] = []
    size = 0

    def add(s: str) -> None:
        nonlocal size
        data = s.encode()
        if size + len(data) + 1 > _MOST_TEXT:
            out.append(data[: _MOST_TEXT - size].decode(errors="ignore"))
            size = _MOST_TEXT
        else:
            out.append(s + "\n")
            size += len(data) + 1

    def walk(x, depth: int, top: bool) -> None:
        if depth > _MOST_DEPTH or size >= _MOST_TEXT:
            return
        if isinstance(x, str):
            add(x)
        elif isinstance(x, list):
            for y in x:
                walk(y, depth + 1, False)
        elif isinstance(x, dict):
            for k in sorted(x):
                if not (top and k == "content"):
                    walk(x[k], depth + 1, False)

    content = node.get("content") if isinstance(node, dict) else None
    if isinstance(content, list) and all(isinstance(c, dict) for c in content):
        for c in content:
            if c.get("type") == "text" and isinstance(c.get("text"), str):
                out.append(c["text"] + "\n")
                size += len(out[-1].encode())
    walk(node, 0, True)
    return "".join(out) or raw


@F.pandas_udf(T.StringType())
def result_text(raw: pd.Series) -> pd.Series:
    """Text of a tool result: text blocks first, then other string leaves, keys in order; what isn't JSON as it is."""
    return raw.map(lambda r: _result_text(r) if isinstance(r, str) else r)


_GZIP = re.compile(r"H4sI[A-Za-z0-9+/]*={0,2}")


def _inflate(token: str) -> str | None:
    try:
        raw = base64.b64decode(token + "=" * (-len(token) % 4))
        return zlib.decompressobj(31).decompress(raw, 65536).decode("latin-1")
    except (ValueError, zlib.error):
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def inflated(text: pd.Series) -> pd.Series:
    """What gzip members in base64 within a text inflate to (at most 64 KiB each), whichever compressor made them."""

    def one(t):
        held = map(_inflate, _GZIP.findall(t) if isinstance(t, str) else ())
        return [x for x in held if x is not None]

    return text.map(one)


@F.pandas_udf(T.StringType())
def redact_inflated(text: pd.Series, literals: pd.Series) -> pd.Series:
    """text with each gzip member in base64 that holds one of the literals (array of form_value, preview; the first that
    it holds) replaced by its preview."""

    def one(t, known):
        def swap(token):
            held = _inflate(token[0]) or ""
            return next((f["preview"] for f in known if f["form_value"].encode().decode("latin-1") in held), token[0])

        return _GZIP.sub(swap, t) if isinstance(t, str) and known is not None else t

    return pd.Series([one(t, known) for t, known in zip(text, literals, strict=True)], dtype=object)


def grams(text: ColumnOrName, n: int) -> Column:
    """Distinct runs of n characters."""
    t = col(text)
    return F.when(F.length(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, F.lit(n))))).otherwise(F.expr("cast(array() as array<string>)"))


def redact_header(c: ColumnOrName) -> Column:
    c = col(c)
    return F.when(F.length(c) == 0, "").when(F.length(c) <= 8, "[REDACTED]").otherwise(F.concat(F.substring(c, 1, 4), F.lit("…[REDACTED]")))
