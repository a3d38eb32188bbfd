"""Vector tiles: protocol-buffer bytes of polygon and point layers."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

EXTENT = 4096
AREAS, POINTS = "DEPARE", "SOUNDG"


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def _field(number: int, data: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(data)) + data


def _number(number: int, value: int) -> bytes:
    return varint(number << 3) + varint(value)


def _value(v) -> bytes:
    if isinstance(v, bool):
        return _number(7, int(v))
    if isinstance(v, str):
        return _field(1, v.encode())
    return varint(3 << 3 | 1) + struct.pack("<d", float(v))


def _geometry(points: list[tuple[int, int]], closed: bool) -> list[int]:
    (x, y), rest = points[0], points[1:]
    out = [1 << 3 | 1, zigzag(x), zigzag(y)]
    if closed:
        out.append(len(rest) << 3 | 2)
        for nx, ny in rest:
            out += [zigzag(nx - x), zigzag(ny - y)]
            x, y = nx, ny
        out.append(1 << 3 | 7)
    return out


def layer(name: str, features: Iterable[tuple[dict, list[tuple[int, int]]]], closed: bool) -> bytes:
    """A layer of (properties, points); names and values are listed once each, in order of first use."""
    keys: dict[str, int] = {}
    values: dict[tuple[type, object], int] = {}
    body = bytearray()
    for properties, points in features:
        tags = [i for k, v in properties.items() for i in (keys.setdefault(k, len(keys)), values.setdefault((type(v), v), len(values)))]
        data = _field(2, b"".join(map(varint, tags))) + _number(3, 3 if closed else 1)
        if points and (not closed or len(points) > 2):
            data += _field(4, b"".join(map(varint, _geometry(points, closed))))
        body += _field(2, data)
    return _number(15, 2) + _field(1, name.encode()) + bytes(body) + b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _value(v)) for _, v in values) + _number(5, EXTENT)


def area_tile(features: list[tuple[dict, list[tuple[int, int]], tuple[int, int]]]) -> bytes:
    """Cells as polygons and as points with the same properties."""
    return _field(3, layer(AREAS, ((p, ring) for p, ring, _ in features), True)) + _field(3, layer(POINTS, ((p, [at]) for p, _, at in features), False))


def point_tile(features: list[tuple[dict, tuple[int, int]]]) -> bytes:
    return _field(3, layer(POINTS, ((p, [at]) for p, at in features), False))


def _parts(data: memoryview) -> Iterator[tuple[int, int | float | memoryview]]:
    """Fields of a message: (number, value); what has a length comes as its bytes."""
    at = 0

    def read() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = read()
        match key & 7:
            case 0:
                yield key >> 3, read()
            case 1:
                yield key >> 3, struct.unpack_from("<d", data, at)[0]
                at += 8
            case 2:
                n = read()
                yield key >> 3, data[at : at + n]
                at += n
            case other:
                raise ValueError(f"wire type {other} is not one of tiles")


def _numbers(data: memoryview) -> list[int]:
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def _points(commands: list[int]) -> list[tuple[int, int]]:
    out, x, y, at = [], 0, 0, 0
    while at < len(commands):
        command, times = commands[at] & 7, commands[at] >> 3
        at += 1
        for _ in range(times if command != 7 else 0):
            dx, dy = ((v >> 1) ^ -(v & 1) for v in commands[at : at + 2])
            x, y, at = x + dx, y + dy, at + 2
            out.append((x, y))
    return out


def features(tile: bytes) -> Iterator[tuple[str, dict, list[tuple[int, int]]]]:
    """(layer, properties, points) of a tile's features, in the order of the tile. Numbers come as floats."""
    for _, body in _parts(memoryview(tile)):
        parts = list(_parts(body))
        name = next(bytes(v).decode() for n, v in parts if n == 1)
        keys = [bytes(v).decode() for n, v in parts if n == 3]
        held = [next(_parts(v)) for n, v in parts if n == 4]
        values = [bool(v) if n == 7 else bytes(v).decode() if n == 1 else float(v) for n, v in held]
        for n, v in parts:
            if n == 2:
                one = dict(_parts(v))
                tags = _numbers(one.get(2, memoryview(b"")))
                yield name, {keys[k]: values[i] for k, i in zip(tags[::2], tags[1::2], strict=True)}, _points(_numbers(one.get(4, memoryview(b""))))
