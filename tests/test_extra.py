"""Marker bookkeeping, sources and sinks, transforms, registration: against plain statements and round trips."""

import io
import json
import pickle
import plistlib
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from voxelspark.functions.numbering import numbered
from voxelspark.operators import learning, markers, matching, registration, shape, spatial
from voxelspark.sources import files, sinks, tiff


def test_merge_in_order(spark):
    r = np.random.default_rng(1)
    rows = [(k, f"{r.integers(0, 4):02d}", *map(float, r.integers(0, 40, 3)), float(r.integers(0, 9))) for k in range(260)]
    kept = []
    for tile in sorted({t for _, t, *_ in rows}):
        before = list(kept)
        for m in sorted(x for x in rows if x[1] == tile):
            kept.append(m)
            if before:
                d = [np.sqrt(sum((a - b) ** 2 for a, b in zip(m[2:5], n[2:5]))) for n in before]
                near = before[min(range(len(before)), key=lambda k: (d[k], before[k][1], before[k][0]))]
                if min(d) < 8:
                    if m[5] < near[5]:
                        kept.remove(m)
                    elif near in kept:
                        kept.remove(near)
    df = spark.createDataFrame(rows, "id long, tile_id string, x double, y double, z double, depth double")
    got = sorted(tuple(m) for m in markers.merge_in_order(df, 8.0).collect())
    assert got == sorted(kept) and 20 < len(got) < 250


def test_marker_readers(spark, tmp_path):
    (tmp_path / "a.apo").write_text("##x, y,z , n\n1.5, 2,3,7\n4,5,6,8\n")
    got = markers.read_apo(spark, str(tmp_path / "a.apo")).orderBy("x").collect()
    assert [(r.x, r.y, r.z, r.n) for r in got] == [(1.5, 2, 3, "7"), (4, 5, 6, "8")]
    (tmp_path / "w.marker").write_text("#x,y,z,radius,shape,name,comment\n11.9,12,13,0,1,c,m=5.5\tv=2\tr=1.5\thue=0.25\n")
    r = markers.read_whole_volume(spark, str(tmp_path / "w.marker")).first()
    assert tuple(r) == (10, 11, 12, "c", 5.5, 2.0, 1.5, 0.25)
    (tmp_path / "p.marker").write_text("##x,y,z,radius,shape,name,comment\n1,2,3,0,1,a,m=5.00\n10,2,3,0,1,a,m=5.00\n")
    assert sorted(m.x for m in markers.load(spark, str(tmp_path / "p.marker")).collect()) == [0, 9]
    assert markers.load(spark, str(tmp_path / "p.marker"), size=(10, 10, 10)).count() == 2
    with pytest.raises(Exception, match="outside the volume"):
        markers.load(spark, str(tmp_path / "p.marker"), size=(9, 10, 10)).collect()
    assert markers.load(spark, str(tmp_path / "a.apo")).count() == 2
    with pytest.raises(ValueError, match="neither"):
        markers.load(spark, str(tmp_path / "a.txt"))
    with pytest.raises(ValueError, match="distances"):
        markers.reject_far(spark.range(1), 3.0)
    assert markers.reject_far(spark.range(1), None).first().rejected is False


def test_tile_metadata(spark, tmp_path):
    info = {"Width": 9, "Height": 8, "Depth": 7, "Margin": 2, "SubStacks": {"000000": {"Width": 5, "Height": 4, "Depth": 3, "X0": 0, "Y0": 1, "Z0": 2, "Files": ["a.tif"]}, "010000": {"Width": 5, "Height": 4, "Depth": 3, "X0": 4, "Y0": 1, "Z0": 2}}}
    want = [("000000", 0, 1, 2, 5, 4, 3, ["a.tif"], 2), ("010000", 4, 1, 2, 5, 4, 3, None, 2)]
    for name, raw in (("info.plist", plistlib.dumps(info)), ("info.plist.pkl", pickle.dumps(info)), ("info.json", json.dumps(info).encode())):
        (tmp_path / name).write_bytes(raw)
        # a folder: the first of the usual names that is there
        assert [tuple(r) for r in files.read_tiles(spark, str(tmp_path / name)).orderBy("tile_id").collect()] == want
        assert [tuple(r) for r in files.read_tiles(spark, str(tmp_path)).orderBy("tile_id").collect()] == want
    for bad in (b"nothing", pickle.dumps(io.BytesIO), json.dumps([1]).encode()):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(ValueError, match="neither"):
            files.read_tiles(spark, str(tmp_path / "bad"))


def test_stacks(spark, tmp_path):
    r = np.random.default_rng(2)
    v = r.integers(0, 3, (4, 6, 5)) * 50  # z, y, x
    at = np.argwhere(v)
    rows = spark.createDataFrame([(int(x), int(y), int(z), int(v[z, y, x])) for z, y, x in at], "x int, y int, z int, intensity int")
    tiff.write_stack(rows, str(tmp_path / "t" / "00"), 5, 6, first=10)
    key = lambda df: sorted(tuple(m) for m in df.select("x", "y", "z", "intensity").collect())
    names = sorted(p.name for p in (tmp_path / "t" / "00").iterdir() if not p.name.startswith("."))
    assert names == [f"full_{k:06d}.tif" for k in range(10, 14)]
    assert key(tiff.read_stack(spark, str(tmp_path / "t")).withColumn("z", F.col("z") - 10)) == key(rows)
    assert key(tiff.read_series(spark, str(tmp_path / "t"))) == key(rows) == key(tiff.read_tile(spark, str(tmp_path / "t"), "00"))
    listed = [f"00/{n}" for n in names[1:3]]
    assert key(tiff.read_tile(spark, str(tmp_path / "t"), "00", listed=listed)) == key(rows.where("z in (1, 2)").withColumn("z", F.col("z") - 1))
    with pytest.raises(Exception, match="(?i)does not exist|not found"):
        tiff.read_tile(spark, str(tmp_path / "t"), "00", listed=["00/none.tif"]).count()
    assert key(tiff.read_stack(spark, str(tmp_path / "t"), flip=True).withColumn("z", F.col("z") - 10)) == key(rows.withColumn("y", 5 - F.col("y")))
    tiff.stack_to_store(spark, str(tmp_path / "t"), str(tmp_path / "store"), "v1")
    store = spark.read.parquet(str(tmp_path / "store"))
    assert key(store.withColumn("z", F.col("z") - 10)) == key(rows) and store.first().volume_id == "v1"


def test_small_sinks(spark, tmp_path):
    t = spark.createDataFrame([("000001", "090", 3, 40), ("000002", "180", 5, 60)], "tile_id string, view_id string, t0 int, t1 int")
    sinks.write_thresholds(t, str(tmp_path / "th"))
    assert sorted(files.read_thresholds(spark, str(tmp_path / "th")).collect()) == sorted(t.collect())
    scores = spark.createDataFrame([("000001", 3, 1, 2, 0.75, 0.6, 0.666667)], "tile_id string, tp long, fp long, fn long, precision double, recall double, f1 double")
    sinks.write_eval_logs(scores, str(tmp_path / "logs"))
    sinks.write_eval_logs(scores, str(tmp_path / "logs"))
    r = files.read_eval_logs(spark, str(tmp_path / "logs" / "*" / "eval.log")).first()
    assert (r.substack, r.method, r.precision, r.TP, r.FP, r.FN, r.n_true, r.n_pred) == ("000001", "unfiltered", 0.75, 3, 1, 2, 5, 4)
    sinks.write_workbook({"a&b": scores, "t": t}, str(tmp_path / "book.xlsx"))
    with zipfile.ZipFile(tmp_path / "book.xlsx") as z:
        assert z.testzip() is None and 'name="a&amp;b"' in z.read("xl/workbook.xml").decode()
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    import xml.etree.ElementTree as ET

    values = [[c.findtext(".//{*}t") or c.findtext("{*}v") for c in row] for row in ET.fromstring(sheet).iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}row")]
    assert values == [scores.columns, ["000001", "3", "1", "2", "0.75", "0.6", "0.666667"]]


def test_training_sets(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 4)) * [1, 2, 3, 0] + 5
    df = spark.createDataFrame([(k, int(k % 2), row.tolist()) for k, row in enumerate(x)], "id long, label int, features array<double>")
    path = str(tmp_path / "set")
    sinks.write_examples(df, path)
    mean, std = sinks.read_figures(spark, path)
    back = sinks.read_examples(spark, path).orderBy("id").toPandas()
    assert np.allclose(np.stack(back.features) * std + mean, x) and back.label.tolist() == [k % 2 for k in range(200)]
    parts = [{m.id for m in sinks.read_examples(spark, path, s).collect()} for s in ((0, 0.7), (0.7, 1))]
    assert not parts[0] & parts[1] and len(parts[0] | parts[1]) == 200 and 110 < len(parts[0]) < 170
    order = [[m.id for m in sinks.read_examples(spark, path, shuffle=s).collect()] for s in (1, 1, 2)]
    assert order[0] == order[1] != order[2] and sorted(order[0]) == list(range(200))


def test_local_figures(spark):
    good = [[0.5, 0.1, 0.2], [0.1, 0.9, 0.4]]
    rows = [(k, good[k % 2] if k < 4 else [0.0, 0.0, 0.01]) for k in range(12)]
    df = spark.createDataFrame(rows, "id long, patch array<double>")
    stored = (np.zeros(3), np.ones(3))
    m, s = learning.local_standardizer(df, stored)
    assert np.allclose(m, np.mean(good, axis=0)) and np.allclose(s, np.std(good, axis=0))
    # three of twelve are fewer than a third
    assert learning.local_standardizer(df.where("id <> 0"), stored) is stored and learning.local_standardizer(df.limit(0), stored) is stored


def test_hues(spark):
    r = np.random.default_rng(4)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in r.integers(0, 60, (180, 2)) if a != b})
    got = {m.id: m.color for m in matching.hues(spark.range(70), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len(got) == 70 and all(got[a] != got[b] for a, b in edges) and {got[k] for e in edges for k in e} <= set(matching.HUES)
    # seventeen that all touch need more than the usual hues
    full = [(a, b) for a in range(17) for b in range(a)]
    got = {m.id: m.color for m in matching.hues(spark.range(17), spark.createDataFrame(full, "u long, v long")).collect()}
    assert len(set(got.values())) == 17 and len(set(got.values()) & set(matching.HUES)) == 16
    many = spark.range(1200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert matching.hues(spark.range(3), many.limit(0)).count() == 3


def test_numbers_in_order(spark):
    got = numbered(spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("id")).repartition(7), F.col("id").desc()).collect()
    assert sorted((m.id, m.number) for m in got) == [(k, 999 - k) for k in range(1000)]


def turn(axis, a):
    c, s = np.cos(a), np.sin(a)
    i, j = [(1, 2), (2, 0), (0, 1)][axis]
    r = np.eye(3)
    r[i, i] = r[j, j] = c
    r[i, j], r[j, i] = -s, s
    return r


def test_motions():
    r = np.random.default_rng(5)
    for _ in range(20):
        a = r.uniform(-1.2, 1.2, 3)
        m = turn(2, a[2]) @ turn(0, a[0]) @ turn(1, a[1])
        assert np.allclose(shape.angles(m), a)
        motions = [(turn(k, r.uniform(-3, 3)), r.normal(size=3)) for k in range(3)]
        x = want = r.normal(size=3)
        for rot, t in motions:
            want = rot @ want + t
        whole = shape.compose(*motions)
        assert np.allclose(whole[0] @ x + whole[1], want)
        back = shape.inverse(whole)
        assert np.allclose(back[0] @ want + back[1], x)
    up = turn(2, 0.4) @ turn(0, np.pi / 2)
    assert np.allclose(shape.angles(up), [np.pi / 2, 0.4, 0.0])
    line = shape.motion_line("v", (np.eye(3), np.array([3.0, 4.0, 0.0]))).split(" , ")
    assert line[0] == "v" and line[4] == "3 4 0" and [float(v) for v in line[5:]] == [0.0, 5.0]


def test_transform_line_can_be_read(spark, tmp_path):
    m = (turn(2, 0.3), np.array([1.0, -2.5, 1e-3]))
    (tmp_path / "t.txt").write_text(shape.motion_line("v1", m) + "\n")
    row = files.read_transforms(spark, str(tmp_path / "t.txt")).first()
    assert row.id == "v1" and np.allclose(np.array(row.r).reshape(3, 3), m[0]) and np.allclose(row.t, m[1])


def test_quaternion():
    for a in (0.1, 0.7):
        q = np.array([0, 0, np.sin(a / 2)])
        assert np.allclose(registration.rotation(q), turn(2, a))


def test_metric_by_hand(spark):
    r = np.random.default_rng(6)
    a, b = r.integers(1, 256, (2, 6, 6, 6))
    rows = lambda v: spark.createDataFrame([(*map(int, p), int(v[tuple(p)])) for p in np.argwhere(v)], "x int, y int, z int, intensity int")
    got = registration.metrics(rows(a), rows(b), [(np.eye(3), np.zeros(3)), (np.eye(3), np.array([1.0, 0, 0])), (turn(2, np.pi / 2), np.zeros(3))], np.full(3, 2.5), bins=8)
    moved = np.zeros_like(b)
    moved[:-1] = b[1:]
    turned = np.zeros_like(b)
    for x, y, z in np.ndindex(b.shape):
        p = np.rint(turn(2, np.pi / 2) @ (np.array([x, y, z]) - 2.5) + 2.5).astype(int)
        turned[x, y, z] = b[tuple(p)]
    for k, other in enumerate((b, moved, turned)):
        counts = np.zeros((8, 8))
        np.add.at(counts, (a.ravel() // 32, other.ravel() // 32), 1)
        # the turned places are whole numbers but for rounding
        assert got[k] == pytest.approx(registration.information(counts), abs=1e-9 if k < 2 else 0.05)


def test_registration_finds_a_turn(spark):
    x, y, z = np.mgrid[:24, :24, :12]
    blob = lambda cx, cy, cz, w: 200 * np.exp(-((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) / (2 * w * w))
    spots = np.array([[6, 8, 5], [16, 7, 6], [12, 17, 4], [8, 15, 8]])
    c, m = (np.array(blob(0, 0, 0, 1).shape) - 1) / 2, (turn(2, 0.1), np.array([1.0, -1.0, 0.0]))
    fixed = sum(blob(*s, 2.5) for s in spots)
    moving = sum(blob(*(m[0] @ (s - c) + m[1] + c), 2.5) for s in spots)
    rows = lambda v: spark.createDataFrame([(*map(int, p), int(min(255, v[tuple(p)]))) for p in np.argwhere(v >= 1)], "x int, y int, z int, intensity int")
    found = registration.register(rows(fixed), rows(moving), levels=((2, 8), (1, 6)), bins=16)
    # where the motions take the spots
    got = (spots - found.centre) @ found.rotation().T + found.shift + found.centre
    want = (spots - c) @ m[0].T + m[1] + c
    assert np.sqrt(((got - want) ** 2).sum(1)).max() < 0.8 < np.sqrt(((spots - want) ** 2).sum(1)).max()


def test_box_join(spark):
    r = np.random.default_rng(7)
    x = np.round(r.uniform(-20, 120, (300, 3)), 1)
    b = [(k, *sum(([int(a), int(a + w)] for a, w in zip(r.integers(-10, 90, 3), r.integers(1, 60, 3))), [])) for k in range(25)]
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "id long, x double, y double, z double")
    boxes = spark.createDataFrame(b, "box int, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int")
    want = sorted((k, m[0]) for k, p in enumerate(x) for m in b if all(m[1 + 2 * i] <= p[i] <= m[2 + 2 * i] - 1 for i in range(3)))
    for cell in (7.0, 64.0):
        assert sorted((m.id, m.box) for m in spatial.box_join(points, boxes, cell).collect()) == want


def test_fit_of_new_points():
    r = np.random.default_rng(8)
    plane = r.uniform(0, 20, (60, 2))
    x = np.column_stack([plane, 2 * plane[:, 0] - plane[:, 1] + 3])
    new = r.uniform(2, 18, (5, 2))
    got = shape.lowess(plane, x, 10.0, new=new)
    assert np.allclose(got, np.column_stack([new, 2 * new[:, 0] - new[:, 1] + 3]))
    with pytest.raises(ValueError, match="weight"):
        shape.lowess(plane, x, 1.0, new=np.array([[500.0, 500.0]]))


def test_entry_survives_a_missing_library(monkeypatch):
    def gone(name):
        raise ModuleNotFoundError("No module named 'somewhere'", name="somewhere")

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", gone)
    with pytest.warns(UserWarning, match="somewhere"):
        names = __spark_entry__.queries()
    assert "tile_thresholds" in names and "find_cells_local" in names
