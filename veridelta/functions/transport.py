"""Topics, quality of service and integrity of messages, as column expressions; CBOR by a vectorised codec."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, LongType, StringType


def local_name(iri: Column) -> Column:
    """What follows the last '#', or else '/', or else ':'."""
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).when(iri.contains("/"), F.substring_index(iri, "/", -1)).when(iri.contains(":"), F.substring_index(iri, ":", -1)).otherwise(iri)


def topic(kind: Column, node_id: Column, prefix: str = "ld") -> Column:
    """prefix/type/id with wildcards replaced and a leading '$' dropped."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(local_name(c), "[#+\\x00]", "_"), r"^\$+", "")
    return F.concat(F.lit(prefix + "/"), clean(kind), F.lit("/"), clean(node_id))


def quality_of_service(confidence: Column, verified: Column) -> Column:
    """2 for verified or at least 0.9; 1 from 0.5 or without a confidence; else 0."""
    return F.when(F.coalesce(verified, F.lit(False)) | (confidence >= 0.9), 2).when(confidence.isNull() | (confidence >= 0.5), 1).otherwise(0)


def expiry_seconds(valid_until: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil((F.unix_micros(valid_until.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1e6)).cast("long")


def integrity(text: Column, algorithm: str = "sha256") -> Column:
    bits = {"sha256": 256, "sha384": 384, "sha512": 512}[algorithm]
    return F.concat(F.lit(algorithm + "-"), F.base64(F.unhex(F.sha2(text, bits))))


def verify_integrity(text: Column, declared: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for a in ("sha256", "sha384", "sha512"):
        out = F.when(declared.startswith(a + "-"), integrity(text, a) == declared).otherwise(out)
    return F.coalesce(out, F.lit(False))


def is_context_allowed(url: Column, exact: list[str] = (), globs: list[str] = (), block_remote: bool = False) -> Column:
    """No list allows everything; '*' and '?' are wild in globs."""
    if block_remote:
        return F.lit(False)
    if not exact and not globs:
        return F.lit(True)
    import re

    ok = url.isin(*exact) if exact else F.lit(False)
    for g in globs:
        ok = ok | url.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g) + "$")
    return ok


def within_limits(text: Column, most_chars: int = 10 << 20, most_depth: int = 100) -> Column:
    """Size and nesting of JSON text; strings are taken out before brackets are counted."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    steps = F.filter(F.split(bare, ""), lambda c: c.isin("{", "[", "}", "]"))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda s, c: F.struct((s["d"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("d"), F.greatest(s["m"], s["d"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("m")))["m"]
    return (F.length(text) <= most_chars) & (depth <= most_depth)


def _head(kind: int, n: int) -> bytes:
    for size, mark, code in ((24, n, ""), (1 << 8, 24, ">B"), (1 << 16, 25, ">H"), (1 << 32, 26, ">I"), (1 << 64, 27, ">Q")):
        if n < size:
            return bytes([kind << 5 | mark]) + (struct.pack(code, n) if code else b"")
    raise ValueError("integer too large")


def cbor_encode(x: object) -> bytes:
    if x is None or isinstance(x, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[x]
    if isinstance(x, int):
        return _head(0, x) if x >= 0 else _head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, str):
        raw = x.encode()
        return _head(3, len(raw)) + raw
    if isinstance(x, list):
        return _head(4, len(x)) + b"".join(map(cbor_encode, x))
    return _head(5, len(x)) + b"".join(cbor_encode(k) + cbor_encode(v) for k, v in x.items())


def cbor_decode(raw: bytes) -> object:
    def read(i: int) -> tuple[object, int]:
        kind, n = raw[i] >> 5, raw[i] & 31
        i += 1
        if kind == 7:
            if n == 27:
                return struct.unpack(">d", raw[i : i + 8])[0], i + 8
            return {20: False, 21: True, 22: None}[n], i
        if n >= 24:
            size = 1 << (n - 24)
            n, i = int.from_bytes(raw[i : i + size], "big"), i + size
        if kind == 0:
            return n, i
        if kind == 1:
            return -1 - n, i
        if kind in (2, 3):
            return (raw[i : i + n] if kind == 2 else raw[i : i + n].decode()), i + n
        out: list = []
        for _ in range(n * (2 if kind == 5 else 1)):
            x, i = read(i)
            out.append(x)
        return (dict(zip(out[::2], out[1::2])) if kind == 5 else out), i

    return read(0)[0]


@pandas_udf(BinaryType())
def to_cbor(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else cbor_encode(json.loads(t)))


@pandas_udf(StringType())
def from_cbor(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else json.dumps(cbor_decode(b)))


def payload_stats(text: Column) -> Column:
    """A struct of sizes in bytes: json, cbor, and either compressed."""
    return F.struct(F.octet_length(text).alias("json"), F.octet_length(to_cbor(text)).alias("cbor"), gzip_size(text.cast("binary")).alias("gzip_json"), gzip_size(to_cbor(text)).alias("gzip_cbor"))


@pandas_udf(LongType())
def gzip_size(raw: pd.Series) -> pd.Series:
    import gzip

    return raw.map(lambda b: None if b is None else len(gzip.compress(bytes(b), mtime=0)))


def mqtt5_properties(compressed: bool, valid_until: Column, now: Column, **user: Column) -> Column:
    """A struct of content type, payload format, message expiry and user properties."""
    kind = "application/cbor" if compressed else "application/ld+json"
    pairs = [x for k, v in user.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(F.lit(kind).alias("content_type"), F.lit(0 if compressed else 1).alias("payload_format_indicator"), F.when(valid_until.isNotNull(), expiry_seconds(valid_until, now)).alias("message_expiry_interval"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("user_properties"))


def integrity_context(url: Column, content: Column, algorithm: str = "sha256") -> Column:
    return F.struct(url.alias("@id"), integrity(content, algorithm).alias("@integrity"))


#: Bytes of a message at most.
MAX_PAYLOAD = 256_000


def to_payload(text: Column, compress: bool = True, most: int = MAX_PAYLOAD) -> Column:
    """A JSON document as a message: CBOR, or compact JSON. A larger one than allowed is an error."""
    raw = to_cbor(text) if compress else F.to_json(F.parse_json(text)).cast("binary")
    return F.when(F.octet_length(raw) <= most, raw).when(raw.isNotNull(), F.raise_error(F.concat(F.lit("payload too large: "), F.octet_length(raw).cast("string"))).cast("binary"))


def from_payload(raw: Column, compressed: bool = True, context: str | None = None) -> Column:
    """The JSON document of a message; a context (JSON) is put before what it says."""
    text = from_cbor(raw) if compressed else raw.cast("string")
    if context is None:
        return text
    return F.regexp_replace(text, r"(?s)^\s*\{(\s*\})?", F.concat(F.lit('{"@context": '), F.lit(context.replace("\\", "\\\\").replace("$", "\\$")), F.when(text.rlike(r"^\s*\{\s*\}"), F.lit("}")).otherwise(F.lit(", "))))


def quality_of_service_detailed(document: Column) -> Column:
    """A struct (qos, reasoning, confidence_used, human_verified) of a JSON document: by its own confidence or verification, or else that of its first property in order that has one."""
    v = F.try_parse_json(document)
    num = lambda x, p: F.try_variant_get(x, p, "double")
    yes = lambda x, p: F.coalesce(F.try_variant_get(x, p, "boolean"), F.lit(False))
    names = F.filter(F.json_object_keys(document), lambda k: ~k.startswith("@"))
    m = F.try_variant_get(v, "$", "map<string,variant>")
    props = F.transform(names, lambda k: F.struct(k.alias("k"), num(m[k], '$["@confidence"]').alias("c"), yes(m[k], '$["@humanVerified"]').alias("h")))
    hit = F.try_element_at(F.filter(props, lambda p: p["h"] | p["c"].isNotNull()), F.lit(1))
    own, verified = num(v, '$["@confidence"]'), yes(v, '$["@humanVerified"]')
    by_prop = ~verified & own.isNull() & hit.isNotNull()
    c = F.when(by_prop, hit["c"]).otherwise(own)
    h = F.when(by_prop, hit["h"]).otherwise(verified)
    where = F.when(by_prop, F.concat(F.lit("property '"), hit["k"], F.lit("'"))).otherwise("document-level")
    qos = F.when(h, 2).when(c.isNull(), 1).when(c >= 0.9, 2).when(c >= 0.5, 1).otherwise(0)
    why = F.when(h, F.concat(F.lit("human verified ("), where, F.lit(")"))).when(c.isNull(), F.lit("no confidence")).otherwise(F.concat(F.lit("confidence "), F.when(c >= 0.9, "of 0.9 or more").when(c >= 0.5, "from 0.5 below 0.9").otherwise("below 0.5"), F.lit(" ("), where, F.lit(")")))
    return F.struct(qos.alias("qos"), why.alias("reasoning"), c.alias("confidence_used"), h.alias("human_verified"))
