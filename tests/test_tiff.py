"""Compressed slices: round trips, files made by hand, damaged ones."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelspark.sources import files, tiff

KINDS = [(c, p, s) for c in tiff.COMPRESSIONS for p in (False, True) for s in (None, 1, 3)]


def pictures():
    r = np.random.default_rng(1)
    return [np.zeros((5, 7), np.uint8), r.integers(0, 256, (9, 13)).astype(np.uint8), np.repeat(r.integers(0, 256, 30), 40).astype(np.uint8).reshape(20, 60), r.integers(0, 3, (200, 300)).astype(np.uint8), np.array([[7]], np.uint8)]


@pytest.mark.parametrize("compression, predictor, strip", KINDS)
def test_round_trip(compression, predictor, strip):
    for v in pictures():
        raw = tiff.encode(v, compression, predictor, strip)
        assert (tiff.decode(raw) == v).all() and tiff.decode(raw).shape == v.shape


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.sampled_from([b"a", b"bb" * 70, b"abc" * 50]), max_size=60).map(b"".join))
def test_packing_of_any_bytes(data):
    assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data


def test_codes_grow_and_clear():
    """Enough different strings for all widths of code and several clearings of the table."""
    data = np.random.default_rng(2).integers(0, 256, 60_000).astype(np.uint8).tobytes() + bytes(range(256)) * 300
    packed = tiff.pack_lzw(data)
    assert tiff.unpack_lzw(packed) == data and len(packed) < 1.6 * len(data)


def codes(*values, width=9):
    bits = "".join(f"{v:0{width}b}" for v in values)
    return bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


def test_known_bytes():
    """The examples in the specifications of the two formats."""
    assert tiff.unpack_lzw(codes(256, 7, 258, 8, 8, 258, 6, 6, 257)) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.pack_lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == codes(256, 7, 258, 8, 8, 258, 6, 6, 257)
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22") + b"\xaa" * 10
    assert tiff.unpack_bits(packed) == plain == tiff.unpack_bits(tiff.pack_bits(plain))
    assert tiff.unpack_bits(b"\x80\x00\x05") == b"\x05"


def by_hand(order, w, h, strips, **tags):
    """A file by its bytes, its directory after the data, in either order of bytes."""
    data, at = b"".join(strips), 8
    starts = [at + sum(map(len, strips[:k])) for k in range(len(strips))]
    where = at + len(data)
    out, far, entries = b"", b"", {256: (3, [w]), 257: (3, [h]), 258: (3, [8] * tags.get("samples", 1)), 259: (3, [tags.get("kind", 1)]), 262: (3, [tags.get("photo", 1)]), 273: (4, starts), 277: (3, [tags.get("samples", 1)]), 278: (3, [tags.get("rows", h)]), 279: (4, [len(s) for s in strips])}
    entries |= {317: (3, [2])} if tags.get("predictor") else {}
    lists = where + 2 + 12 * len(entries) + 4
    for tag, (kind, values) in sorted(entries.items()):
        packed = struct.pack(order + ("H" if kind == 3 else "I") * len(values), *values)
        if len(packed) > 4:
            packed, far = struct.pack(order + "I", lists + len(far)), far + packed
        out += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, where) + data + struct.pack(order + "H", len(entries)) + out + b"\0" * 4 + far


@pytest.mark.parametrize("order", ["<", ">"])
def test_files_made_by_hand(order):
    v = np.array([[7, 7, 7], [8, 8, 7], [7, 6, 6]], np.uint8)
    assert (tiff.decode(by_hand(order, 3, 3, [codes(256, 7, 258, 8, 8, 258, 6, 6, 257)], kind=5)) == v).all()
    assert (tiff.decode(by_hand(order, 3, 3, [zlib.compress(v[:2].tobytes()), zlib.compress(v[2:].tobytes())], kind=32946, rows=2)) == v).all()
    steps = np.array([[7, 0, 0], [8, 0, 255], [7, 255, 0]], np.uint8)
    assert (tiff.decode(by_hand(order, 3, 3, [zlib.compress(steps.tobytes())], kind=8, predictor=True)) == v).all()
    assert (tiff.decode(by_hand(order, 3, 3, [b"\xfe\x07", b"\xff\x08\x00\x07", b"\x00\x07\xff\x06"], kind=32773, rows=1)) == v).all()
    assert (tiff.decode(by_hand(order, 3, 3, [(255 - v).tobytes()], photo=0)) == v).all()
    colour = np.array([[[10, 20, 30], [255, 255, 255], [255, 0, 0]]], np.uint8)
    assert tiff.decode(by_hand(order, 3, 1, [colour.tobytes()], photo=2, samples=3)).tolist() == [[(2990 + 11740 + 3420) // 1000, 255, 76]]


def test_damaged_files():
    good = tiff.encode(np.arange(12, dtype=np.uint8).reshape(3, 4))
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.decode(b"PK" + good[2:])
    with pytest.raises(ValueError, match="short"):
        tiff.decode(good[:-3])
    with pytest.raises(ValueError, match="known"):
        tiff.decode(by_hand("<", 3, 1, [b"abc"], kind=7))
    with pytest.raises(ValueError, match="damaged"):
        tiff.unpack_lzw(codes(256, 7, 400, 257))


def test_stack_of_compressed_slices(spark, tmp_path):
    r = np.random.default_rng(3)
    v = r.integers(0, 256, (4, 6, 5))
    rows = spark.createDataFrame([(*map(int, p), int(v[tuple(p)])) for p in np.argwhere(v)], "x int, y int, z int, intensity int")
    key = lambda df: sorted(tuple(x) for x in df.select("x", "y", "z", "intensity").collect())
    for k, (c, p) in enumerate((c, p) for c in tiff.COMPRESSIONS for p in (False, True)):
        tiff.write_stack(rows, str(tmp_path / str(k)), 4, 6, compression=c, predictor=p)
        assert key(tiff.read_stack(spark, str(tmp_path / str(k)))) == key(rows)


def test_a_folder_gives_its_metadata_only(spark, tmp_path):
    (tmp_path / "info.json").write_text('{"Margin": 4, "SubStacks": {"0000": {"X0": 1, "Y0": 2, "Z0": 3, "Width": 5, "Height": 6, "Depth": 7, "Files": ["a.tif"]}}}')
    for k in range(3):
        (tmp_path / f"full_{k}.tif").write_bytes(b"large")
    (tmp_path / "other.json").write_text("{}")
    for path in (tmp_path, tmp_path / "info.json"):
        assert [r.asDict()["x0"] for r in files.read_tiles(spark, str(path)).collect()] == [1]
    (tmp_path / "named.meta").write_bytes((tmp_path / "info.json").read_bytes())
    assert files.read_tiles(spark, str(tmp_path / "named.meta")).first().margin == 4
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no tile metadata"):
        files.read_tiles(spark, str(tmp_path / "none"))
