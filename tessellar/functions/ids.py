"""Identifiers and hashes that are functions of content, and canonical JSON."""

from __future__ import annotations

import hashlib
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def short_sha(*parts: Column, n: int = 16, sep: str = ":") -> Column:
    """First n hexadecimal digits of the SHA-256 of the parts; a missing part is the text None."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(sep, *texts), 256), 1, n)


def document_id(path: Column) -> Column:
    return F.concat(F.lit("doc-"), short_sha(path, n=12))


def page_id(version: Column, page: Column) -> Column:
    return F.concat(version, F.lit("#p"), F.lpad(page.cast("string"), 4, "0"))


def element_id(page: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("element-"), short_sha(page, n=10), F.lit("-"), F.lpad(ordinal.cast("string"), 4, "0"))


def ref_id(sha256: Column, page: Column, bbox: Column) -> Column:
    return short_sha(sha256, page, bbox)


def edition_id(document: Column, sha256: Column, fingerprint: Column | None = None) -> Column:
    base = F.concat(document, F.lit("@"), F.substring(sha256, 1, 12))
    return base if fingerprint is None else F.concat(base, F.lit("~"), fingerprint)


def fingerprint(tools: Column) -> Column:
    """Of a map of tool versions, whatever its order."""
    pairs = F.array_sort(F.map_entries(tools))
    return F.substring(F.sha2(F.to_json(pairs), 256), 1, 8)


def no_floats(kind: T.DataType, path: str = "$") -> None:
    """Canonical JSON holds no floating-point numbers: refuse a schema that does, naming the place."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        raise ValueError(f"a floating-point number at {path}")
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            no_floats(f.dataType, f"{path}.{f.name}")
    elif isinstance(kind, T.ArrayType):
        no_floats(kind.elementType, f"{path}[]")
    elif isinstance(kind, T.MapType):
        no_floats(kind.valueType, f"{path}{{}}")


def canonical_json(**fields: Column) -> Column:
    """JSON with keys in order and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def _canonical(value: object, path: str) -> object:
    if isinstance(value, float):
        raise ValueError(f"a floating-point number at {path}")
    if isinstance(value, (set, frozenset)):
        raise ValueError(f"a set at {path}")
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, dict):
        if any(not isinstance(k, str) for k in value):
            raise ValueError(f"a key that is not text at {path}")
        return {k: _canonical(v, f"{path}.{k}") for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_canonical(v, f"{path}[{i}]") for i, v in enumerate(value)]
    if value is None or isinstance(value, (bool, int)):
        return value
    raise ValueError(f"{type(value).__name__} at {path}")


def canonical_bytes(value: object) -> bytes:
    """Canonical JSON of a driver-side document (a snapshot's payload)."""
    return json.dumps(_canonical(value, "$"), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def payload_hash(value: object, without: str | None = None) -> str:
    if without and isinstance(value, dict):
        value = {k: v for k, v in value.items() if k != without}
    return hashlib.sha256(canonical_bytes(value)).hexdigest()
