"""The protobuf wire form of messages, for files that exchange them with other programs.

A message is a sequence of (field number, wire type) keys and payloads, as the public encoding specification has it. This
encodes and decodes the four schemas, whose field numbers follow their order (the version is field 1).
"""

from __future__ import annotations

import struct
from typing import Any

from pyspark.sql import types as T


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("a message ends inside a number")
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def _scalar(number: int, kind: T.DataType, value: Any) -> bytes:
    if isinstance(kind, T.StringType):
        raw = str(value).encode()
        return _varint(number << 3 | 2) + _varint(len(raw)) + raw
    if isinstance(kind, T.FloatType):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def encode(message: dict[str, Any], schema: T.StructType) -> bytes:
    out = b""
    for number, f in enumerate(schema, 1):
        value, kind = message.get(f.name), f.dataType
        if value is None:
            continue
        if isinstance(kind, T.MapType):
            for k, v in value.items():
                entry = _scalar(1, kind.keyType, k) + _scalar(2, kind.valueType, v)
                out += _varint(number << 3 | 2) + _varint(len(entry)) + entry
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.LongType):
            if value:
                packed = b"".join(_varint(v) for v in value)
                out += _varint(number << 3 | 2) + _varint(len(packed)) + packed
        elif isinstance(kind, T.ArrayType):
            out += b"".join(_scalar(number, kind.elementType, v) for v in value)
        else:
            out += _scalar(number, kind, value)
    return out


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _fields(data: bytes):
    at = 0
    while at < len(data):
        key, at = _read_varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _read_varint(data, at)
            yield number, _signed(value)
            continue
        size, at = (4, at) if wire == 5 else (8, at) if wire == 1 else _read_varint(data, at)
        if at + size > len(data):
            raise ValueError("a message ends inside a field")
        raw, at = data[at : at + size], at + size
        yield number, struct.unpack("<f", raw)[0] if wire == 5 else raw


def _value(kind: T.DataType, raw: Any) -> Any:
    return raw.decode() if isinstance(kind, T.StringType) else raw


def decode(data: bytes, schema: T.StructType) -> dict[str, Any]:
    """The fields present; repeated ones are empty at least. Unknown fields are skipped."""
    out: dict[str, Any] = {f.name: None for f in schema}
    for f in schema:
        if isinstance(f.dataType, T.MapType):
            out[f.name] = {}
        elif isinstance(f.dataType, T.ArrayType):
            out[f.name] = []
    for number, raw in _fields(data):
        if not 1 <= number <= len(schema):
            continue
        f = schema[number - 1]
        kind = f.dataType
        if isinstance(kind, T.MapType):
            entry = dict(_fields(raw))
            out[f.name][_value(kind.keyType, entry.get(1, b""))] = _value(kind.valueType, entry.get(2, b""))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.LongType):
            if isinstance(raw, int):
                out[f.name].append(raw)
            else:
                at = 0
                while at < len(raw):
                    n, at = _read_varint(raw, at)
                    out[f.name].append(_signed(n))
        elif isinstance(kind, T.ArrayType):
            out[f.name].append(_value(kind.elementType, raw))
        else:
            out[f.name] = _value(kind, raw)
    return out
