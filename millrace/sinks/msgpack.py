"""The parts of MessagePack that the forward protocol needs, written and read."""

from __future__ import annotations

import struct
from typing import Any


def array(n: int) -> bytes:
    return bytes([0x90 | n]) if n < 16 else b"\xdc" + struct.pack(">H", n) if n < 1 << 16 else b"\xdd" + struct.pack(">I", n)


def mapping(n: int) -> bytes:
    return bytes([0x80 | n]) if n < 16 else b"\xde" + struct.pack(">H", n) if n < 1 << 16 else b"\xdf" + struct.pack(">I", n)


def text(s: str) -> bytes:
    b = s.encode()
    n = len(b)
    head = bytes([0xA0 | n]) if n < 32 else b"\xd9" + bytes([n]) if n < 256 else b"\xda" + struct.pack(">H", n) if n < 1 << 16 else b"\xdb" + struct.pack(">I", n)
    return head + b


def binary(b: bytes) -> bytes:
    n = len(b)
    return (b"\xc4" + bytes([n]) if n < 256 else b"\xc5" + struct.pack(">H", n) if n < 1 << 16 else b"\xc6" + struct.pack(">I", n)) + b


def integer(n: int) -> bytes:
    if 0 <= n < 128:
        return bytes([n])
    if -32 <= n < 0:
        return struct.pack("b", n)
    for code, fmt, low, high in ((0xCC, ">B", 0, 1 << 8), (0xCD, ">H", 0, 1 << 16), (0xCE, ">I", 0, 1 << 32), (0xCF, ">Q", 0, 1 << 64), (0xD2, ">i", -(1 << 31), 0), (0xD3, ">q", -(1 << 63), 0)):
        if low <= n < high:
            return bytes([code]) + struct.pack(fmt, n)
    raise ValueError(n)


def event_time(seconds: int, nanoseconds: int) -> bytes:
    """The protocol's time: extension 0 with seconds and nanoseconds."""
    return b"\xd7\x00" + struct.pack(">II", seconds & 0xFFFFFFFF, nanoseconds)


def pack(x: Any) -> bytes:
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if x is None:
        return b"\xc0"
    if isinstance(x, int):
        return integer(x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        return text(x)
    if isinstance(x, bytes):
        return binary(x)
    if isinstance(x, dict):
        return mapping(len(x)) + b"".join(pack(k) + pack(v) for k, v in x.items())
    return array(len(x)) + b"".join(map(pack, x))


def unpack(b: bytes, at: int = 0) -> tuple[Any, int]:
    """(value, place after it). An event time comes back as seconds with a fraction."""
    c = b[at]
    at += 1

    def take(fmt: str) -> tuple[int, int]:
        n = struct.calcsize(fmt)
        return struct.unpack(fmt, b[at : at + n])[0], at + n

    def raw(n: int, at: int) -> tuple[bytes, int]:
        if at + n > len(b):
            raise ValueError("cut off")
        return b[at : at + n], at + n

    def items(n: int, at: int) -> tuple[list, int]:
        out = []
        for _ in range(n):
            v, at = unpack(b, at)
            out.append(v)
        return out, at

    def pairs(n: int, at: int) -> tuple[dict, int]:
        flat, at = items(2 * n, at)
        return dict(zip(flat[::2], flat[1::2])), at

    if c < 0x80:
        return c, at
    if c >= 0xE0:
        return c - 256, at
    if c < 0x90:
        return pairs(c & 15, at)
    if c < 0xA0:
        return items(c & 15, at)
    if c < 0xC0:
        v, at = raw(c & 31, at)
        return v.decode(), at
    if c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], at
    ints = {0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q", 0xCA: ">f", 0xCB: ">d"}
    if c in ints:
        return take(ints[c])
    sized = {0xC4: (">B", raw), 0xC5: (">H", raw), 0xC6: (">I", raw), 0xD9: (">B", raw), 0xDA: (">H", raw), 0xDB: (">I", raw), 0xDC: (">H", items), 0xDD: (">I", items), 0xDE: (">H", pairs), 0xDF: (">I", pairs)}
    if c in sized:
        fmt, read = sized[c]
        n, at = take(fmt)
        v, at = read(n, at)
        return (v.decode() if 0xD9 <= c <= 0xDB else v), at
    if c in (0xC7, 0xD7):
        if c == 0xC7:
            n, at = take(">B")
        kind, at = b[at], at + 1
        s, ns = struct.unpack(">II", b[at : at + 8])
        if kind:
            raise ValueError(f"extension {kind}")
        return s + ns / 1e9, at + 8
    raise ValueError(f"code {c:#x}")
