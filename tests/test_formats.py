"""NetCDF classic and MATLAB level 5 files, built byte by byte here, and read through Spark."""
import struct
import zlib

import numpy as np
import pytest

from tidewin.sources import formats, readers


def text(s):
    return struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)


def netcdf_with_records(version):
    """Dimensions time (records) and x; a packed short along both, a double along time, a float grid, a byte along time."""
    count = (lambda n: struct.pack(">q", n)) if version == 5 else (lambda n: struct.pack(">i", n))
    place = (lambda n: struct.pack(">i", n)) if version == 1 else (lambda n: struct.pack(">q", n))
    name = lambda s: count(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    tag = lambda t, n: struct.pack(">i", t) + count(n)
    packed = np.array([[1, 2, 3], [4, -99, 6]], ">i2")
    seconds, grid, flag = np.array([0.5, 1.5], ">f8"), np.arange(6, dtype=">f4").reshape(2, 3), np.array([7, 8], ">i1")
    attributes = tag(12, 3) + name("_FillValue") + struct.pack(">i", 3) + count(1) + b"\xff\x9d\0\0" + name("scale_factor") + struct.pack(">i", 6) + count(1) + struct.pack(">d", 0.5) + name("add_offset") + struct.pack(">i", 6) + count(1) + struct.pack(">d", 10)
    head = b"CDF" + bytes([version]) + count(2) + tag(10, 3) + name("time") + count(0) + name("x") + count(3) + name("y") + count(2)
    head += tag(12, 1) + name("title") + struct.pack(">i", 2) + count(5) + b"hello\0\0\0"
    head += tag(11, 4)
    parts = [
        name("packed") + count(2) + count(0) + count(1) + attributes + struct.pack(">i", 3) + count(8),
        name("seconds") + count(1) + count(0) + tag(0, 0) + struct.pack(">i", 6) + count(8),
        name("grid") + count(2) + count(2) + count(1) + tag(0, 0) + struct.pack(">i", 5) + count(24),
        name("flag") + count(1) + count(0) + tag(0, 0) + struct.pack(">i", 1) + count(4),
    ]
    fixed = len(head) + sum(map(len, parts)) + 4 * len(place(0))
    record = fixed + 24
    begins = [record, record + 8, fixed, record + 16]
    body = b"".join(p + place(b) for p, b in zip(parts, begins, strict=True)) + grid.tobytes()
    for r in range(2):
        body += packed[r].tobytes() + b"\0\0" + seconds[r : r + 1].tobytes() + flag[r : r + 1].tobytes() + b"\0\0\0"
    return head + body


@pytest.mark.parametrize("version", [1, 2, 5])
def test_netcdf(version):
    data = netcdf_with_records(version)
    np.testing.assert_array_equal(formats.netcdf_variable(data, "packed"), [[10.5, 11, 11.5], [12, np.nan, 13]])
    assert formats.netcdf_variable(data, "seconds").tolist() == [0.5, 1.5] and formats.netcdf_variable(data, "flag").tolist() == [7, 8]
    assert formats.netcdf_variable(data, "grid").tolist() == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(KeyError):
        formats.netcdf_variable(data, "other")
    for broken in (b"", b"CDF", b"\x89HDF\r\n\x1a\n", data[:40]):
        with pytest.raises((ValueError, KeyError, IndexError)):
            formats.netcdf_variable(broken, "grid")


def test_netcdf_round_trip():
    own = {"a": np.array([1.5, -2, np.nan]), "long name": np.zeros(0), "b": np.arange(1000) / 7}
    data = formats.netcdf_bytes(own)
    for k, v in own.items():
        np.testing.assert_array_equal(formats.netcdf_variable(data, k), v)


def mat_element(kind, body, order):
    return struct.pack(order + "II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def mat_matrix(name, values, cls, kind, order):
    small = struct.pack(order + "I", len(name) << 16 | 1) + name.encode().ljust(4, b"\0") if len(name) <= 4 else mat_element(1, name.encode(), order)
    return mat_element(14, mat_element(6, struct.pack(order + "II", cls, 0), order) + mat_element(5, np.array(values.shape, order + "i4").tobytes(), order) + small + mat_element(kind, values.astype(values.dtype.newbyteorder(order)).tobytes(order="F"), order), order)


@pytest.mark.parametrize("order", ["<", ">"])
def test_mat(order):
    wide, ints, chars = np.arange(6.0).reshape(2, 3), np.array([[1, -2, 3]], np.int16), np.array([[104, 105]], np.uint16)
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x100) + (b"IM" if order == "<" else b"MI")
    packed = zlib.compress(mat_matrix("compressed", wide * 2, 6, 9, order))
    data = head + mat_matrix("text", chars, 4, 4, order) + mat_matrix("w", wide, 6, 9, order) + struct.pack(order + "II", 15, len(packed)) + packed + mat_matrix("ints", ints, 6, 3, order)
    assert formats.mat_variable(data, "w").tolist() == wide.tolist() and formats.mat_variable(data, "compressed").tolist() == (wide * 2).tolist() and formats.mat_variable(data, "ints").tolist() == [[1, -2, 3]]
    for name in ("text", "none"):
        with pytest.raises(KeyError):
            formats.mat_variable(data, name)
    with pytest.raises(ValueError):
        formats.mat_variable(b"x" * 200, "w")


def test_files_through_spark(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"s{i}.nc").write_bytes(formats.netcdf_bytes({"x": np.arange(i + 1.0), "y": np.ones(2)}))
    got = readers.decode_files(spark, str(tmp_path / "*.nc"), formats.netcdf_decoder("x")).collect()
    assert sorted(r["x"] for r in got) == [[0.0], [0.0, 1.0], [0.0, 1.0, 2.0]]
    (tmp_path / "m.nc").write_bytes(netcdf_with_records(2))
    assert readers.decode_files(spark, str(tmp_path / "m.nc"), formats.netcdf_decoder("seconds")).first()["x"] == [0.5, 1.5]
