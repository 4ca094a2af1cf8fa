"""Wire formats of entries: varint-delimited records, protocol-buffer fields, without a protobuf library."""

from __future__ import annotations

from collections.abc import Iterator

FIELDS = ["signature", "corpus", "root", "path", "language"]
#: Field numbers of an entry and of a VName.
ENTRY_FIELDS = {"source": 1, "edge_kind": 2, "target": 3, "fact_name": 4, "fact_value": 5}
VNAME_FIELDS = {"signature": 1, "corpus": 2, "root": 3, "path": 4, "language": 5}


class WireError(ValueError):
    pass


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("a varint breaks off")
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def records(data: bytes) -> Iterator[bytes]:
    """The records of a delimited stream: each after its length."""
    at = 0
    while at < len(data):
        n, at = read_varint(data, at)
        if at + n > len(data):
            raise WireError("a record breaks off")
        yield data[at : at + n]
        at += n


def delimited(record: bytes) -> bytes:
    return varint(len(record)) + record


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field; unknown wire types are an error."""
    at = 0
    while at < len(message):
        key, at = read_varint(message, at)
        kind = key & 7
        if kind == 0:
            value, at = read_varint(message, at)
        elif kind == 2:
            n, at = read_varint(message, at)
            if at + n > len(message):
                raise WireError("a field breaks off")
            value, at = message[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = message[at : at + n], at + n
        else:
            raise WireError(f"wire type {kind}")
        yield key >> 3, value


def _field(number: int, value: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(value)) + value if value else b""


def encode_vname(v: dict) -> bytes:
    return b"".join(_field(k, (v.get(n) or "").encode()) for n, k in VNAME_FIELDS.items())


def decode_vname(data: bytes) -> dict:
    out, names = dict.fromkeys(FIELDS, ""), {k: n for n, k in VNAME_FIELDS.items()}
    for number, value in fields(data):
        if number in names:
            out[names[number]] = value.decode()
    return out


def encode_entry(e: dict) -> bytes:
    source, target = encode_vname(e["source"] or {}), encode_vname(e["target"]) if e.get("target") else b""
    out = varint(1 << 3 | 2) + varint(len(source)) + source + _field(2, (e.get("edge_kind") or "").encode())
    if e.get("target"):
        out += varint(3 << 3 | 2) + varint(len(target)) + target
    return out + _field(4, (e.get("fact_name") or "").encode()) + _field(5, bytes(e.get("fact_value") or b""))


def decode_entry(data: bytes) -> dict:
    out = {"source": dict.fromkeys(FIELDS, ""), "edge_kind": "", "target": None, "fact_name": "", "fact_value": b""}
    for number, value in fields(data):
        if number in (1, 3):
            out["source" if number == 1 else "target"] = decode_vname(value)
        elif number in (2, 4):
            out["edge_kind" if number == 2 else "fact_name"] = value.decode()
        elif number == 5:
            out["fact_value"] = bytes(value)
    return out


class Names:
    """VNames as their wire bytes and back, each distinct one of a task made once; emptied when it is full, so its memory is bounded."""

    def __init__(self, most: int = 50_000):
        self.most, self.bytes, self.values = most, {}, {}

    def encode(self, v: tuple) -> bytes:
        """Five texts -> the message after its length."""
        out = self.bytes.get(v)
        if out is None:
            if len(self.bytes) >= self.most:
                self.bytes.clear()
            out = self.bytes[v] = delimited(encode_vname(dict(zip(FIELDS, v, strict=True))))
        return out

    def decode(self, data: bytes) -> tuple:
        out = self.values.get(data)
        if out is None:
            if len(self.values) >= self.most:
                self.values.clear()
            out = self.values[data] = tuple(decode_vname(data).values())
        return out
