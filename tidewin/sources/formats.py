"""Array files that Spark has no reader for: NetCDF classic and MATLAB level 5, decoded from their bytes.

``readers.decode_files`` reads files of any file system and gives their bytes to a decoder, one file a row; a decoder gives
one variable as an array. Only the wanted variable's bytes are turned into numbers.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

#: Fixed values of the NetCDF classic format: external types, list tags.
NC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
NC_DIMENSION, NC_VARIABLE, NC_ATTRIBUTE = 10, 11, 12
#: Fixed values of MATLAB level 5: data types of elements, and classes of numeric arrays.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED = 14, 15
MAT_NUMERIC = range(6, 16)


class _Header:
    """A cursor over a NetCDF header; the version decides how wide counts and places are."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or len(data) < 8 or data[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF classic file")
        self.data, self.at, self.version = data, 4, data[3]

    def number(self, wide: bool) -> int:
        size = 8 if wide else 4
        value = int.from_bytes(self.data[self.at : self.at + size], "big")
        self.at += size
        return value

    def count(self) -> int:
        return self.number(self.version == 5)

    def take(self, size: int) -> bytes:
        out = self.data[self.at : self.at + size]
        self.at += -(-size // 4) * 4
        return out

    def name(self) -> str:
        return self.take(self.count()).decode()

    def list_of(self, tag: int, item: Callable) -> list:
        found, n = self.number(False), self.count()
        if found not in (0, tag):
            raise ValueError("broken NetCDF header")
        return [item() for _ in range(n)]

    def attribute(self) -> tuple[str, np.ndarray]:
        name, kind = self.name(), np.dtype(NC_TYPES[self.number(False)])
        n = self.count()
        return name, np.frombuffer(self.take(n * kind.itemsize), kind, n)

    def attributes(self) -> dict[str, np.ndarray]:
        return dict(self.list_of(NC_ATTRIBUTE, self.attribute))


def netcdf_variable(data: bytes, variable: str) -> np.ndarray:
    """A variable of a NetCDF classic file (versions 1, 2 and 5) in double precision, unpacked: fill values are NaN, then scale and offset.

    Variables along the record dimension lie interleaved, a record of each after the other; they are read as a strided view.
    """
    h = _Header(data)
    records = h.count()
    dims = h.list_of(NC_DIMENSION, lambda: (h.name(), h.count()))
    h.attributes()

    def one():
        name = h.name()
        shape = [h.count() for _ in range(h.count())]
        attributes = h.attributes()
        kind = np.dtype(NC_TYPES[h.number(False)])
        h.count()
        return name, shape, attributes, kind, h.number(h.version != 1)

    variables = h.list_of(NC_VARIABLE, one)
    along = lambda ids: bool(ids) and dims[ids[0]][1] == 0
    size = lambda ids, kind: int(np.prod([dims[i][1] for i in (ids[1:] if along(ids) else ids)], dtype=np.int64)) * kind.itemsize
    moving = [size(ids, kind) for _, ids, _, kind, _ in variables if along(ids)]
    step = moving[0] if len(moving) == 1 else sum(-(-x // 4) * 4 for x in moving)
    for name, ids, attributes, kind, begin in variables:
        if name != variable:
            continue
        inner = [dims[i][1] for i in (ids[1:] if along(ids) else ids)]
        strides = [int(np.prod(inner[k + 1 :], dtype=np.int64)) * kind.itemsize for k in range(len(inner))]
        shape, strides = ([records, *inner], [step, *strides]) if along(ids) else (inner, strides)
        raw = np.ndarray(shape, kind, data, begin, strides)
        out = raw.astype(float)
        for fill in ("_FillValue", "missing_value"):
            if fill in attributes and len(attributes[fill]):
                out[raw == attributes[fill][0]] = np.nan
        scale, offset = (float(attributes[a][0]) if a in attributes else b for a, b in (("scale_factor", 1.0), ("add_offset", 0.0)))
        return out * scale + offset
    raise KeyError(f"no variable {variable!r}")


def netcdf_bytes(variables: dict[str, np.ndarray]) -> bytes:
    """A NetCDF classic file (version 1) of one-dimensional arrays of doubles, each with a dimension of its own."""
    text = lambda s: struct.pack(">i", len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    dims = b"".join(text(f"n_{k}") + struct.pack(">i", len(v)) for k, v in variables.items())
    head = b"CDF\1" + struct.pack(">i", 0) + struct.pack(">ii", NC_DIMENSION, len(variables)) + dims + struct.pack(">ii", 0, 0) + struct.pack(">ii", NC_VARIABLE, len(variables))
    parts = [text(k) + struct.pack(">ii", 1, i) + struct.pack(">iiii", 0, 0, 6, 8 * len(v)) for i, (k, v) in enumerate(variables.items())]
    at = len(head) + sum(len(p) + 4 for p in parts)
    for part, v in zip(parts, variables.values(), strict=True):
        head += part + struct.pack(">i", at)
        at += 8 * len(v)
    return head + b"".join(np.asarray(v, ">f8").tobytes() for v in variables.values())


def _elements(data: bytes, order: str):
    """(type, bytes) of the data elements that follow one another; small ones stand in their own tag."""
    at = 0
    while at + 8 <= len(data):
        first = int.from_bytes(data[at : at + 4], "little" if order == "<" else "big")
        if first >> 16:
            yield first & 0xFFFF, data[at + 4 : at + 4 + (first >> 16)]
            at += 8
            continue
        size = int.from_bytes(data[at + 4 : at + 8], "little" if order == "<" else "big")
        yield first, data[at + 8 : at + 8 + size]
        at += 8 + (size if first == MAT_COMPRESSED else -(-size // 8) * 8)


def mat_variable(data: bytes, variable: str) -> np.ndarray:
    """A numeric array of a MATLAB level 5 file in double precision, in its own shape; compressed or not, of either byte order.

    Cells, structures, sparse and character arrays are passed over; of complex ones the real part is given.
    """
    mark = data[126:128]
    if mark not in (b"IM", b"MI"):
        raise ValueError("not a MATLAB level 5 file")
    order = "<" if mark == b"IM" else ">"
    for kind, body in _elements(data[128:], order):
        if kind == MAT_COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order), (0, b""))
        if kind != MAT_MATRIX:
            continue
        parts = _elements(body, order)
        flags, shape, name = (x[1] for _, x in zip(range(3), parts, strict=False))
        if name.decode("latin-1") != variable or np.frombuffer(flags, order + "u4")[0] & 0xFF not in MAT_NUMERIC:
            continue
        stored, values = next(parts, (9, b""))
        return np.frombuffer(values, order + MAT_TYPES[stored]).astype(float).reshape(np.frombuffer(shape, order + "i4"), order="F")
    raise KeyError(f"no numeric variable {variable!r}")


def netcdf_decoder(variable: str) -> Callable[[bytes], list[float]]:
    """For ``decode_files``: one variable, its last dimension fastest."""
    return lambda data: netcdf_variable(data, variable).ravel().tolist()


def mat_decoder(variable: str) -> Callable[[bytes], list[float]]:
    """For ``decode_files``: one array, row by row."""
    return lambda data: mat_variable(data, variable).ravel().tolist()
