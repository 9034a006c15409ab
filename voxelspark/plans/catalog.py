"""All queries over volumes, markers and patches with their SQL, by name.

A query wires derived views (``fixtures``) to operators; its SQL says the same thing the plain way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.operators import blocks, detect, kernels, learning, markers, matching, shape, spatial, threshold, tiling
from voxelspark.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
AXES = ("x", "y", "z")
#: The box of the markers and that of the voxels, their margins and tile counts.
BOX, BOX_MARGIN, BOX_TILES = (509, 503, 251), 40, (2, 2, 2)
VOLUME, VOLUME_MARGIN, VOLUME_TILES = (64, 64, 32), 8, (2, 2, 1)


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(list(views), sql)
        return f

    return add


def _grid_sql(size, counts, margin) -> str:
    """The tiles as SQL, written out by the same rounding."""
    parts = []
    for i in range(counts[0]):
        for j in range(counts[1]):
            for k in range(counts[2]):
                row = [f"'{i:02d}{j:02d}{k:02d}' AS tile_id"]
                for a, w, n, q in zip(AXES, size, counts, (i, j, k), strict=True):
                    step = int((w - margin) / n + 0.5)
                    row += [f"{q * step} AS {a}0", f"{min(w, q * step + step + margin)} AS {a}1"]
                parts.append("SELECT " + ", ".join(row))
    return " UNION ALL ".join(parts)


TILES = f"tiles AS ({_grid_sql(VOLUME, VOLUME_TILES, VOLUME_MARGIN)})"
BOXES = f"tiles AS ({_grid_sql(BOX, BOX_TILES, BOX_MARGIN)})"
IN_TILE = "x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND z >= z0 AND z < z1"
TILED = f"{TILES}, tv AS (SELECT tile_id, x, y, z, intensity FROM voxels JOIN tiles ON {IN_TILE})"
HIST = f"{TILED}, hist AS (SELECT t.tile_id, b.bin, CAST(count(v.x) AS BIGINT) AS n FROM (SELECT DISTINCT tile_id FROM tv) t CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(256)) b LEFT JOIN tv v ON v.tile_id = t.tile_id AND v.intensity = b.bin GROUP BY ALL)"
PREFIX = """p AS (SELECT tile_id, bin + 1 AS t, CAST(sum(n) OVER w AS DOUBLE) AS s, sum(CASE WHEN n > 0 THEN n * ln(n) ELSE 0.0 END) OVER w AS e FROM hist WINDOW w AS (PARTITION BY tile_id ORDER BY bin)),
 q AS (SELECT tile_id, t, s, e FROM p UNION ALL SELECT DISTINCT tile_id, 0, 0.0, 0.0 FROM p)"""


def _h(a: str, b: str) -> str:
    return f"(CASE WHEN {b}.s > {a}.s THEN ln({b}.s - {a}.s) - ({b}.e - {a}.e) / ({b}.s - {a}.s) ELSE 0.0 END)"


CUTS = f"""cuts AS (SELECT tile_id, t0, t1 FROM (SELECT a.tile_id, a.t AS t0, b.t AS t1, row_number() OVER (PARTITION BY a.tile_id ORDER BY round({_h("o", "a")} + {_h("a", "b")} + {_h("b", "c")}, 9) DESC, a.t, b.t) AS r
 FROM q a JOIN q b ON a.tile_id = b.tile_id AND a.t < b.t JOIN q o ON o.tile_id = a.tile_id AND o.t = 0 JOIN q c ON c.tile_id = a.tile_id AND c.t = 256 WHERE a.t >= 1 AND b.t <= 255) x WHERE r = 1)"""
D = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


def _voxels(spark, d):
    return view(spark, d, "voxels")


def _stored(spark, d, name="voxels"):
    """A volume as a block store."""
    return blocks.store(blocks.pack(view(spark, d, name)))


def _patches(spark, d):
    return blocks.patches(_stored(spark, d), _centres(spark, d), 1).select("id", F.col("patch").cast("array<int>").alias("patch"))


def _tiled(spark, d):
    return tiling.assign_tiles(_voxels(spark, d), VOLUME, VOLUME_TILES, VOLUME_MARGIN)


def _hist(spark, d):
    return threshold.histogram(_tiled(spark, d), "tile_id")


def _true(spark, d):
    return view(spark, d, "markers_true")


def _pred(spark, d):
    return view(spark, d, "markers_pred")


# ---- tiles, scans, histograms, thresholds


@query(f"WITH {BOXES} SELECT * FROM tiles")
def tile_grid(spark, d):
    return tiling.tile_grid(spark, BOX, BOX_TILES, BOX_MARGIN)


@query(f"WITH {TILED} SELECT tile_id, x, y, z, intensity FROM tv", ("voxels",))
def voxel_tiles(spark, d):
    return _tiled(spark, d).select("tile_id", *AXES, "intensity")


@query("SELECT x, y, z, intensity FROM voxels WHERE x >= 8 AND x < 40 AND y >= 16 AND y < 32 AND z >= 4 AND z < 20", ("voxels",))
def tile_scan(spark, d):
    return tiling.box_scan(_voxels(spark, d), {"x": (8, 40), "y": (16, 32), "z": (4, 20)})


@query(
    """SELECT gx.x, gy.y, gz.z, coalesce(v.intensity, 0) AS intensity FROM (SELECT CAST(range AS INT) AS x FROM range(-2, 10)) gx CROSS JOIN (SELECT CAST(range AS INT) AS y FROM range(-2, 10)) gy
    CROSS JOIN (SELECT CAST(range AS INT) AS z FROM range(-2, 10)) gz LEFT JOIN voxels v ON v.x = gx.x AND v.y = gy.y AND v.z = gz.z""",
    ("voxels",),
)
def halo_scan_padded(spark, d):
    return tiling.padded_scan(_voxels(spark, d), {a: (0, 8) for a in AXES}, 2)


@query(f"WITH {HIST} SELECT tile_id, bin, n FROM hist", ("voxels",))
def intensity_histogram(spark, d):
    return _hist(spark, d)


@query(
    f"""WITH {HIST}, {PREFIX} SELECT tile_id, CAST(threshold AS INT) AS threshold FROM (SELECT a.tile_id, a.t - 1 AS threshold, row_number() OVER (PARTITION BY a.tile_id ORDER BY round({_h("o", "a")} + {_h("a", "c")}, 9) DESC, a.t) AS r
    FROM q a JOIN q o ON o.tile_id = a.tile_id AND o.t = 0 JOIN q c ON c.tile_id = a.tile_id AND c.t = 256 WHERE a.t BETWEEN 1 AND 255) x WHERE r = 1""",
    ("voxels",),
)
def kapur(spark, d):
    return threshold.kapur(_hist(spark, d), "tile_id")


@query(
    f"""WITH {HIST}, {PREFIX}, pairs AS (SELECT a.tile_id, a.t AS a, b.t AS b, {_h("a", "b")} AS h FROM q a JOIN q b ON a.tile_id = b.tile_id AND a.t < b.t)
    SELECT tile_id, t0, t1, t2 FROM (SELECT x.tile_id, x.b AS t0, y.b AS t1, z.b AS t2, row_number() OVER (PARTITION BY x.tile_id ORDER BY round(x.h + y.h + z.h + e.h, 9) DESC, x.b, y.b, z.b) AS r
      FROM pairs x JOIN pairs y ON y.tile_id = x.tile_id AND y.a = x.b JOIN pairs z ON z.tile_id = x.tile_id AND z.a = y.b JOIN pairs e ON e.tile_id = x.tile_id AND e.a = z.b AND e.b = 256 WHERE x.a = 0 AND z.b <= 255) WHERE r = 1""",
    ("voxels",),
)
def three_kapur(spark, d):
    """Three cuts a tile by the dynamic programme; the SQL tries all triples."""
    return threshold.multi_kapur(_hist(spark, d), "tile_id", 3)


@query(f"WITH {HIST}, {PREFIX}, {CUTS} SELECT tile_id, t0, t1 FROM cuts", ("voxels",))
def two_kapur(spark, d):
    return threshold.two_kapur(_hist(spark, d), "tile_id")


@query(f"WITH {HIST}, {PREFIX}, {CUTS} SELECT tile_id, x, y, z, intensity FROM tv JOIN cuts USING (tile_id) WHERE intensity > t0", ("voxels",))
def foreground(spark, d):
    t = _tiled(spark, d)
    return threshold.foreground(t, F.broadcast(threshold.two_kapur(threshold.histogram(t, "tile_id"), "tile_id")), "tile_id").select("tile_id", *AXES, "intensity")


@query(f"WITH {HIST}, {PREFIX}, {CUTS} SELECT tile_id, t0, t1, CAST(count(*) AS BIGINT) AS foreground FROM tv JOIN cuts USING (tile_id) WHERE intensity > t0 GROUP BY ALL", ("voxels",))
def tile_thresholds(spark, d):
    """The flagship: per tile both thresholds and the foreground, from the histogram alone (the voxels are read once)."""
    hist = _hist(spark, d)
    cuts = threshold.two_kapur(hist, "tile_id")
    return hist.join(cuts, "tile_id").where(F.col("bin") > F.col("t0")).groupBy("tile_id", "t0", "t1").agg(F.sum("n").alias("foreground"))


@query(
    f"""WITH {HIST}, {PREFIX}, {CUTS}, f AS (SELECT tile_id, t0, t1, count(*) AS n FROM tv JOIN cuts USING (tile_id) WHERE intensity > t0 GROUP BY ALL)
    SELECT tile_id, CASE WHEN t0 <= 1 THEN 'no signal' WHEN t1 < 15 THEN 'too dark' WHEN n < 10 THEN 'too few voxels' ELSE 'ok' END AS verdict FROM f""",
    ("voxels",),
)
def tile_guards(spark, d):
    n = F.col("foreground")
    verdict = F.when(F.col("t0") <= 1, "no signal").when(F.col("t1") < 15, "too dark").when(n < 10, "too few voxels").otherwise("ok")
    return tile_thresholds(spark, d).select("tile_id", verdict.alias("verdict"))


@query(
    f"""WITH {HIST}, {PREFIX}, {CUTS} SELECT tile_id, x, y, z, CASE WHEN intensity > t1 THEN 'high' WHEN intensity > t0 THEN 'low' ELSE 'background' END AS class FROM tv JOIN cuts USING (tile_id)""",
    ("voxels",),
)
def voxel_class_colors(spark, d):
    t = _tiled(spark, d)
    cuts = threshold.two_kapur(threshold.histogram(t, "tile_id"), "tile_id")
    kind = F.when(F.col("intensity") > F.col("t1"), "high").when(F.col("intensity") > F.col("t0"), "low").otherwise("background")
    return t.join(F.broadcast(cuts), "tile_id").select("tile_id", *AXES, kind.alias("class"))


@query(
    """WITH s AS (SELECT min(mass) AS low, max(mass) AS high FROM markers_pred), h AS (SELECT CAST(floor(coalesce((mass - low) / nullif(high - low, 0), 0) * 255) AS INT) AS bin FROM markers_pred, s),
    tv AS (SELECT 'g' AS tile_id, bin AS intensity, 1 AS x FROM h), hist AS (SELECT 'g' AS tile_id, b.bin, CAST(count(v.x) AS BIGINT) AS n FROM (SELECT CAST(range AS INT) AS bin FROM range(256)) b LEFT JOIN tv v ON v.intensity = b.bin GROUP BY ALL), """
    + PREFIX
    + ", "
    + CUTS
    + " SELECT round(low + t0 / 255.0 * (high - low), 6) AS threshold FROM cuts, s",
    ("markers_pred",),
)
def max_entropy_attr(spark, d):
    return threshold.max_entropy_of(_pred(spark, d), "mass")


@query("SELECT x, y, z, 10 * (intensity // 25) AS decile_bin, round(intensity / 255.0, 6) AS scaled FROM voxels", ("voxels",))
def intensity_scaled(spark, d):
    return _voxels(spark, d).select(*AXES, (F.floor(F.col("intensity") / 25).cast("int") * 10).alias("decile_bin"), F.round(F.col("intensity") / F.lit(255.0), 6).alias("scaled"))


DECILES = tuple(range(10, 100, 10))


@query("SELECT " + ", ".join(f"round(quantile_cont(intensity, {p / 100}), 6) AS p{p}" for p in DECILES) + " FROM voxels", ("voxels",))
def percentiles(spark, d):
    """The deciles of a volume's intensities."""
    p = F.percentile("intensity", F.array(*[F.lit(p / 100) for p in DECILES]))
    return _voxels(spark, d).agg(p.alias("p")).select(*[F.round(F.col("p")[k], 6).alias(f"p{n}") for k, n in enumerate(DECILES)])


@query("SELECT x, y, z, round((intensity - avg(intensity) OVER ()) / stddev_samp(intensity) OVER (), 6) AS value FROM voxels", ("voxels",))
def image_normalize(spark, d):
    v = _voxels(spark, d)
    stats = v.agg(F.avg("intensity").alias("m"), F.stddev_samp("intensity").alias("s"))
    return v.crossJoin(F.broadcast(stats)).select(*AXES, F.round((F.col("intensity") - F.col("m")) / F.col("s"), 6).alias("value"))


@query("SELECT y AS x, 63 - x AS y, 31 - z AS z, intensity FROM voxels", ("voxels",))
def permute_flip(spark, d):
    return _voxels(spark, d).select(F.col("y").alias("x"), (63 - F.col("x")).alias("y"), (31 - F.col("z")).alias("z"), "intensity")


@query(
    "SELECT CAST(floor(x / 2.0) AS INT) AS x, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(z / 2.0) AS INT) AS z, round(avg(intensity), 6) AS intensity FROM voxels GROUP BY 1, 2, 3", ("voxels",)
)
def pyramid_shrink(spark, d):
    return kernels.shrink(_voxels(spark, d), 2)


@query("SELECT coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(a.z, b.z) AS z, coalesce(a.intensity, 0) AS r, coalesce(b.intensity, 0) AS g FROM voxels a FULL JOIN volume_b b ON a.x = b.x AND a.y = b.y AND a.z = b.z", ("voxels", "volume_b"))
def rgb_zip(spark, d):
    return kernels.channels(r=_voxels(spark, d), g=view(spark, d, "volume_b"))


# ---- neighbourhoods

_CELLS = "c AS (SELECT x, y, z, intensity FROM voxels)"
_OFF = "(SELECT CAST(range AS INT) AS {0} FROM range(-{1}, {1} + 1))"


def _cube_sql(n: int) -> str:
    return " CROSS JOIN ".join(_OFF.format(a, n) for a in ("dx", "dy", "dz"))


@query(
    f"""WITH {_CELLS}, k AS (SELECT * FROM {_cube_sql(2)} WHERE dx*dx+dy*dy+dz*dz <= 4)
    SELECT c.x, c.y, c.z, c.intensity, round(sum(n.intensity), 6) AS local_mass FROM c CROSS JOIN k JOIN c n ON n.x = c.x + dx AND n.y = c.y + dy AND n.z = c.z + dz GROUP BY ALL""",
    ("voxels",),
)
def ball_convolution(spark, d):
    return blocks.convolve(_stored(spark, d), kernels.ball(2)).select(*AXES, F.col("intensity").cast("int").alias("intensity"), F.round("local_mass", 6).alias("local_mass"))


@query(
    f"""WITH {_CELLS}, k AS (SELECT *, exp(-(dx*dx+dy*dy+dz*dz) / 2.0) AS w FROM {_cube_sql(2)} WHERE dx*dx+dy*dy+dz*dz <= 4)
    SELECT c.x, c.y, c.z, c.intensity, round(sum(n.intensity * w), 6) AS local_mass FROM c CROSS JOIN k JOIN c n ON n.x = c.x + dx AND n.y = c.y + dy AND n.z = c.z + dz GROUP BY ALL""",
    ("voxels",),
)
def soft_convolution(spark, d):
    return blocks.convolve(_stored(spark, d), kernels.ball(2, soft=True)).select(*AXES, F.col("intensity").cast("int").alias("intensity"), F.round("local_mass", 6).alias("local_mass"))


_FLAT = """
e AS (SELECT a.x*1000000007::BIGINT+a.y*100003+a.z AS u, b.x*1000000007::BIGINT+b.y*100003+b.z AS v, a.intensity AS av, b.intensity AS bv FROM c a JOIN c b ON abs(a.x-b.x)+abs(a.y-b.y)+abs(a.z-b.z)=1),
r AS (SELECT DISTINCT u, u AS v FROM e WHERE bv > av UNION SELECT e.v, r.v FROM r JOIN e ON e.u = r.u AND e.av = e.bv)
"""


@query(f"WITH RECURSIVE {_CELLS}, {_FLAT} SELECT x, y, z, intensity FROM c WHERE x*1000000007::BIGINT+y*100003+z NOT IN (SELECT u FROM r)".replace("SELECT DISTINCT u, u AS v FROM e", "SELECT DISTINCT u, 0 AS v FROM e").replace("SELECT e.v, r.v FROM r", "SELECT e.v, 0 FROM r"), ("voxels",))
def regional_maxima(spark, d):
    return kernels.regional_maxima(_voxels(spark, d), spatial.components)


@query(
    f"""WITH {_CELLS}, s AS (SELECT c.x, c.y, c.z, n.intensity AS v, count(*) AS k FROM c CROSS JOIN ({"SELECT * FROM " + _cube_sql(1)}) o JOIN c n ON n.x = c.x + dx AND n.y = c.y + dy AND n.z = c.z + dz WHERE n.intensity <> 0 GROUP BY ALL),
    h AS (SELECT x, y, z, sum(-(k / 27.0) * ln(k / 27.0)) AS h, sum(k) AS k FROM s GROUP BY x, y, z)
    SELECT c.x, c.y, c.z, c.intensity, round(coalesce(h, 0.0) + CASE WHEN coalesce(k, 0) < 27 THEN -((27.0 - coalesce(k, 0)) / 27.0) * ln((27.0 - coalesce(k, 0)) / 27.0) ELSE 0.0 END, 6) AS entropy FROM c LEFT JOIN h USING (x, y, z)""",
    ("voxels",),
)
def local_entropy(spark, d):
    return blocks.local_entropy(_stored(spark, d), 1).select(*AXES, F.col("intensity").cast("int").alias("intensity"), F.round("entropy", 6).alias("entropy"))


@query(
    f"""WITH {_CELLS}, cb AS (SELECT x, y, z, intensity FROM volume_b), """
    + ", ".join(
        f"""s{t} AS (SELECT c.x, c.y, c.z, n.intensity AS v, count(*) AS k FROM {t} c CROSS JOIN (SELECT * FROM {_cube_sql(1)}) o JOIN {t} n ON n.x = c.x + dx AND n.y = c.y + dy AND n.z = c.z + dz WHERE n.intensity <> 0 GROUP BY ALL),
    h{t} AS (SELECT x, y, z, sum(-(k / 27.0) * ln(k / 27.0)) AS h, sum(k) AS k FROM s{t} GROUP BY x, y, z),
    w{t} AS (SELECT c.x, c.y, c.z, c.intensity AS i, pow(100.0, coalesce(h, 0.0) + CASE WHEN coalesce(k, 0) < 27 THEN -((27.0 - coalesce(k, 0)) / 27.0) * ln((27.0 - coalesce(k, 0)) / 27.0) ELSE 0.0 END) AS w FROM {t} c LEFT JOIN h{t} USING (x, y, z))"""
        for t in ("c", "cb")
    )
    + " SELECT a.x, a.y, a.z, CAST(round_even(round((a.i * a.w + b.i * b.w) / (a.w + b.w), 9), 0) AS INT) AS intensity FROM wc a JOIN wcb b ON a.x = b.x AND a.y = b.y AND a.z = b.z",
    ("voxels", "volume_b"),
)
def content_fusion(spark, d):
    return kernels.content_fusion(blocks.local_entropy(_stored(spark, d), 1), blocks.local_entropy(_stored(spark, d, "volume_b"), 1))


_CENTRES = "SELECT id, CAST(2 + id % 12 AS INT) AS x, CAST(2 + (id * 7) % 12 AS INT) AS y, CAST(2 + (id * 5) % 12 AS INT) AS z FROM markers_true"


def _centres(spark, d):
    cell = lambda k: (2 + (F.col("id") * k) % 12).cast("int")
    return _true(spark, d).select("id", cell(1).alias("x"), cell(7).alias("y"), cell(5).alias("z"))


_PATCH = f"""pt AS ({_CENTRES}), o AS (SELECT *, (dz + 1) * 9 + (dy + 1) * 3 + dx + 1 AS pos FROM {_cube_sql(1)}),
 pv AS (SELECT pt.id, pt.x + dx AS x, pt.y + dy AS y, pt.z + dz AS z, pos, coalesce(v.intensity, 0) AS v FROM pt CROSS JOIN o LEFT JOIN voxels v ON v.x = pt.x + dx AND v.y = pt.y + dy AND v.z = pt.z + dz)"""


@query(f"WITH {_PATCH} SELECT id, array_to_string(list(v ORDER BY pos), ' ') AS patch FROM pv GROUP BY id", ("voxels", "markers_true"))
def patch_extract(spark, d):
    p = _patches(spark, d)
    return p.select("id", F.array_join(F.transform("patch", lambda v: v.cast("string")), " ").alias("patch"))


@query(f"WITH {_PATCH} SELECT pos AS pos, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM pv GROUP BY pos", ("voxels", "markers_true"))
def standardize(spark, d):
    p = _patches(spark, d).select(F.posexplode("patch").alias("pos", "v"))
    return p.groupBy("pos").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


@query(
    f"WITH {_PATCH}, s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS s FROM pv GROUP BY pos) SELECT id, pv.pos, round((v - m) / nullif(s, 0), 6) AS value FROM pv JOIN s ON pv.pos = s.pos",
    ("voxels", "markers_true"),
)
def patch_standardized(spark, d):
    p = _patches(spark, d).select("id", F.posexplode("patch").alias("pos", "v"))
    return learning.standardized(p, "pos", "v").select("id", "pos", F.round("value", 6).alias("value"))


@query(
    f"""WITH {_PATCH}, g AS (SELECT id, avg(v) AS mean FROM pv GROUP BY id HAVING avg(v) > 5) SELECT CAST(count(DISTINCT id) AS BIGINT) AS patches, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM pv WHERE id IN (SELECT id FROM g)""",
    ("voxels", "markers_true"),
)
def local_standardize(spark, d):
    p = _patches(spark, d)
    mean = F.aggregate("patch", F.lit(0.0), lambda a, v: a + v) / F.size("patch")
    v = p.where(mean > 5).select("id", F.explode("patch").alias("v"))
    return v.agg(F.count_distinct("id").alias("patches"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


@query(f"WITH {_PATCH} SELECT x, y, z, CAST(sum(v) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS coverage FROM pv GROUP BY x, y, z", ("voxels", "markers_true"))
def overlap_add(spark, d):
    c = _centres(spark, d)
    return kernels.overlap_add(_patches(spark, d), c, 1)


@query(
    f"""WITH {_PATCH}, s AS (SELECT x, y, z, CAST(sum(v) AS DOUBLE) / count(*) AS m FROM pv GROUP BY x, y, z), r AS (SELECT min(m) AS low, max(m) AS high FROM s)
    SELECT x, y, z, round((m - least(low, 0)) / greatest(high - least(low, 0), 1), 6) AS value FROM s, r""",
    ("voxels", "markers_true"),
)
def overlap_normalize(spark, d):
    c = _centres(spark, d)
    m = kernels.overlap_add(_patches(spark, d), c, 1).select(*AXES, (F.col("total") / F.col("coverage")).alias("m"))
    span = m.agg(F.least(F.min("m"), F.lit(0.0)).alias("low"), F.max("m").alias("high"))
    return m.crossJoin(F.broadcast(span)).select(*AXES, F.round((F.col("m") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1.0)), 6).alias("value"))


@query(
    f"""WITH g AS (SELECT DISTINCT CAST(round_even(x, 0) AS INT) AS cx, CAST(round_even(y, 0) AS INT) AS cy, CAST(round_even(z, 0) AS INT) AS cz FROM markers_true
    WHERE least(x - {BOX_MARGIN}, {BOX[0]} - {BOX_MARGIN} - x, y - {BOX_MARGIN}, {BOX[1]} - {BOX_MARGIN} - y, z - {BOX_MARGIN}, {BOX[2]} - {BOX_MARGIN} - z) > 0), o AS (SELECT * FROM {_cube_sql(2)}),
    s AS (SELECT cx + dx AS x, cy + dy AS y, cz + dz AS z, sum(exp(-(dx*dx+dy*dy+dz*dz) / 2.0)) AS w FROM g CROSS JOIN o GROUP BY 1, 2, 3)
    SELECT x, y, z, round(w / max(w) OVER (), 6) AS target FROM s WHERE x BETWEEN 0 AND {BOX[0] - 1} AND y BETWEEN 0 AND {BOX[1] - 1} AND z BETWEEN 0 AND {BOX[2] - 1}""",
    ("markers_true",),
)
def gaussian_target(spark, d):
    """Training target of the whole box: markers inside the margin, smoothed and scaled to 1."""
    return learning.gaussian_targets(_true(spark, d), BOX, BOX_MARGIN).withColumn("target", F.round("target", 6))


@query(
    """SELECT DISTINCT CAST(x AS INT) + dx AS x, CAST(y AS INT) + dy AS y, CAST(z AS INT) + dz AS z FROM markers_true CROSS JOIN (SELECT CAST(range AS INT) AS dx FROM range(-12, 13, 3))
    CROSS JOIN (SELECT CAST(range AS INT) AS dy FROM range(-12, 13, 3)) CROSS JOIN (SELECT CAST(range AS INT) AS dz FROM range(-12, 13, 3)) WHERE least(x - 40, 469 - x, y - 40, 463 - y, z - 40, 211 - z) > 0""",
    ("markers_true",),
)
def positive_sites(spark, d):
    inner = _true(spark, d).where(tiling.margin_depth(BOX, 40) > 0)
    steps = range(-12, 13, 3)
    cells = inner.select(*[F.col(a).cast("int").alias(a) for a in AXES]).distinct()
    # axis by axis: what is carried on are places of the volume, however many markers reach them
    for a in AXES:
        cells = cells.withColumn(a, F.explode(F.array(*[F.col(a) + s for s in steps]))).distinct()
    return cells


@query(
    "SELECT v.x, v.y, v.z FROM voxels v WHERE NOT EXISTS (SELECT 1 FROM markers_true m WHERE (m.x-v.x)*(m.x-v.x)+(m.y-v.y)*(m.y-v.y)+(m.z-v.z)*(m.z-v.z) < 900)",
    ("voxels", "markers_true"),
)
def negative_sites(spark, d):
    """Voxels with no marker within 30."""
    v = _voxels(spark, d).withColumn("id", F.col("x") * 65536 + F.col("y") * 256 + F.col("z"))
    near = spatial.distance_join(_true(spark, d).select(*AXES), v.select("id", *AXES), 30.0).select(F.col("b_id").alias("id"))
    return v.join(near, "id", "left_anti").select(*AXES)


@query(
    """SELECT x, y, z, CASE WHEN EXISTS (SELECT 1 FROM markers_true m WHERE m.x >= v.x - 7 AND m.x < v.x + 8 AND m.y >= v.y - 7 AND m.y < v.y + 8 AND m.z >= v.z - 7 AND m.z < v.z + 8) THEN 1 ELSE 0 END AS label
    FROM voxels v""",
    ("voxels", "markers_true"),
)
def patch_labels(spark, d):
    """Whether any marker lies in the patch (half-size 5 and 2 more) around a voxel: a box join through grid cells."""
    v = _voxels(spark, d)
    near = spatial.distance_join(_true(spark, d).select(*AXES), v.select(*AXES), 15.0)
    hit = F.lit(True)
    for a in AXES:
        hit = hit & (F.col(f"a_{a}") >= F.col(f"b_{a}") - 7) & (F.col(f"a_{a}") < F.col(f"b_{a}") + 8)
    found = near.where(hit).select(*[F.col(f"b_{a}").alias(a) for a in AXES]).distinct().withColumn("label", F.lit(1))
    return v.join(found, list(AXES), "left").select(*AXES, F.coalesce("label", F.lit(0)).alias("label"))


@query(
    """WITH g AS (SELECT a.x, b.y, c.z, CAST(round_even(b.y - 2.0, 0) AS INT) AS sx, CAST(round_even(14.0 - a.x, 0) AS INT) AS sy, c.z - 1 AS sz FROM (SELECT CAST(range AS INT) AS x FROM range(64)) a
    CROSS JOIN (SELECT CAST(range AS INT) AS y FROM range(64)) b CROSS JOIN (SELECT CAST(range AS INT) AS z FROM range(32)) c)
    SELECT g.x, g.y, g.z, CASE WHEN sx > 0 AND sx < 63 AND sy > 0 AND sy < 63 AND sz > 0 AND sz < 31 THEN coalesce(v.intensity, 0) ELSE 0 END AS intensity FROM g LEFT JOIN voxels v ON v.x = sx AND v.y = sy AND v.z = sz""",
    ("voxels",),
)
def resample_nn(spark, d):
    """Quarter turn: x' = 14 - y, y' = x + 2, z' = z + 1."""
    grid = kernels.full_grid(spark, VOLUME)
    return kernels.resample_nearest(_voxels(spark, d), grid, ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)), (14.0, 2.0, 1.0), VOLUME)


@query(
    """WITH p AS (SELECT id, 1 + (id % 50) + (id % 4) * 0.25 AS x, 2 + (id % 40) + 0.5 AS y, (id % 20) + 0.75 AS z FROM markers_true),
    k AS (SELECT p.id, CAST(floor(x) + a AS INT) AS cx, CAST(floor(y) + b AS INT) AS cy, CAST(floor(z) + c AS INT) AS cz,
      (CASE a WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE b WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE c WHEN 1 THEN z - floor(z) ELSE 1 - z + floor(z) END) AS w
      FROM p CROSS JOIN (SELECT range AS a FROM range(2)) CROSS JOIN (SELECT range AS b FROM range(2)) CROSS JOIN (SELECT range AS c FROM range(2)))
    SELECT k.id, round(sum(w * coalesce(v.intensity, 0)), 6) AS value FROM k LEFT JOIN voxels v ON v.x = cx AND v.y = cy AND v.z = cz GROUP BY k.id""",
    ("voxels", "markers_true"),
)
def resample_linear(spark, d):
    n = F.col("id")
    at = _true(spark, d).select("id", (1 + n % 50 + (n % 4) * 0.25).alias("x"), (2 + n % 40 + 0.5).alias("y"), (n % 20 + 0.75).alias("z"))
    return kernels.resample_linear(_voxels(spark, d), at)


@query(
    """WITH j AS (SELECT a.intensity // 16 AS f, b.intensity // 16 AS m, CAST(count(*) AS DOUBLE) AS n FROM voxels a JOIN volume_b b ON a.x = b.x AND a.y = b.y AND a.z = b.z GROUP BY 1, 2),
    t AS (SELECT f, m, n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY f) / sum(n) OVER () AS pf, sum(n) OVER (PARTITION BY m) / sum(n) OVER () AS pm FROM j) SELECT round(sum(p * ln(p / (pf * pm))), 6) AS mutual_information FROM t""",
    ("voxels", "volume_b"),
)
def mutual_information(spark, d):
    """Joint histogram of two aligned images in 16 bins: counted once, the marginals are sums of it."""
    a, b = _voxels(spark, d), view(spark, d, "volume_b").withColumnRenamed("intensity", "other")
    joint = a.join(b, list(AXES)).groupBy(F.floor(F.col("intensity") / 16).alias("f"), F.floor(F.col("other") / 16).alias("m")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    f, m = joint.groupBy("f").agg(F.sum("n").alias("nf")), joint.groupBy("m").agg(F.sum("n").alias("nm"))
    total = joint.agg(F.sum("n").alias("total"))
    p = joint.join(f, "f").join(m, "m").crossJoin(F.broadcast(total))
    return p.agg(F.round(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nf") * F.col("nm")))), 6).alias("mutual_information"))


# ---- markers


@query("SELECT id, CASE WHEN x BETWEEN 40 AND 469 AND y BETWEEN 40 AND 463 AND z BETWEEN 40 AND 211 THEN 1 ELSE 0 END AS inside, round(least(x - 40, 469 - x, y - 40, 463 - y, z - 40, 211 - z), 6) AS depth FROM markers_pred", ("markers_pred",))
def inside_margin(spark, d):
    return _pred(spark, d).select("id", tiling.inside(BOX, 40).cast("int").alias("inside"), F.round(tiling.margin_depth(BOX, 40.0), 6).alias("depth"))


@query("SELECT id FROM markers_pred WHERE NOT (x BETWEEN 0 AND 508 AND y BETWEEN 0 AND 502 AND z BETWEEN 0 AND 250)", ("markers_pred",))
def marker_bounds(spark, d):
    return _pred(spark, d).where(~tiling.inside(tuple(w - 1 for w in BOX), 0)).select("id")


def _comments(spark, d):
    text = F.concat_ws("\t", F.format_string("m=%.1f", "mass"), F.format_string("v=%.1f", F.col("id") % 7 + F.lit(0.0)), F.lit("hue=0.50"), F.lit(""), F.lit("1.5 2.5"), F.lit("0.6:0.3:0.1"), F.format_string("%.1f", F.col("id") % 5 + F.lit(0.5)))
    name = F.format_string("MS_center %d(%06d)", F.col("id"), F.col("id") % 8)
    return _true(spark, d).select("id", *AXES, "mass", name.alias("name"), text.alias("comment"))


@query("SELECT id, round(round(mass, 1), 6) AS mass, CAST(id % 7 AS DOUBLE) AS volume, 0.5 AS hue, '0.6 0.3 0.1' AS evr, id % 5 + 0.5 AS radius FROM markers_true".replace("round(round(mass, 1), 6)", "CAST(printf('%.1f', mass) AS DOUBLE)"), ("markers_true",))
def marker_parse(spark, d):
    p = markers.parse_comments(_comments(spark, d).drop("mass"))
    return p.select("id", "mass", "volume", "hue", F.array_join(F.transform("evr", lambda v: v.cast("string")), " ").alias("evr"), "radius")


@query("SELECT id, CAST(round(x + 1) AS BIGINT) AS x, CAST(round(y + 1) AS BIGINT) AS y, CAST(round(z + 1) AS BIGINT) AS z, 'm=' || printf('%.2f', mass) || chr(9) || 'v=1.00' || chr(9) || 'hue=0.25' AS comment FROM markers_pred", ("markers_pred",))
def marker_format(spark, d):
    rows = _pred(spark, d).select("*", F.lit(1.0).alias("volume"), F.lit(0.25).alias("hue"), F.col("id").cast("string").alias("name"))
    return markers.format_markers(rows).select(F.col("name").cast("long").alias("id"), *AXES, "comment")


@query("SELECT id, lpad(CAST(id % 8 AS VARCHAR), 6, '0') AS substack FROM markers_true", ("markers_true",))
def extract_substack(spark, d):
    return _comments(spark, d).select("id", markers.substack_of().alias("substack"))


@query("SELECT id, round(10 - y, 6) AS x, round(x - 4, 6) AS y, round(z + 3, 6) AS z FROM markers_true", ("markers_true",))
def rigid_points(spark, d):
    r, t = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]), np.array([10.0, -4.0, 3.0])
    moved = shape.rigid(_true(spark, d), r, t)
    back_and_forth = shape.rigid(shape.rigid(moved, r, t, inverse=True), r, t)
    return back_and_forth.select("id", *[F.round(a, 6).alias(a) for a in AXES])


@query("SELECT id FROM markers_pred WHERE mass <= 1200", ("markers_pred",))
def distance_filter(spark, d):
    return _pred(spark, d).withColumnRenamed("mass", "distance").where("distance <= 1200").drop("distance").select("id")


@query(f"SELECT a.id AS a_id, b.id AS b_id, round({D}, 6) AS d FROM markers_true a JOIN markers_true b ON a.id < b.id ORDER BY {D}, a.id, b.id LIMIT 100", ("markers_true",))
def pairwise_distance(spark, d):
    return spatial.pairwise_nearest(_true(spark, d), 100, 4.0).withColumn("d", F.round("d", 6))


@query(f"SELECT a.id AS a_id, b.id AS b_id, round({D}, 6) AS d, round(1.0 / greatest(0.001, {D}), 6) AS weight FROM markers_true a JOIN markers_pred b ON {D} < 32", ("markers_true", "markers_pred"))
def match_candidates(spark, d):
    p = matching.candidates(_true(spark, d), _pred(spark, d), 32.0)
    return p.select("a_id", "b_id", F.round("d", 6).alias("d"), F.round("weight", 6).alias("weight"))


@query(f"SELECT a.id AS a_id, b.id AS b_id FROM markers_true a JOIN markers_pred b ON {D} <= 8", ("markers_true", "markers_pred"))
def radius_join(spark, d):
    return spatial.distance_join(_true(spark, d), _pred(spark, d), 8.0, inclusive=True).select("a_id", "b_id")


@query(f"SELECT a.id, round(sum(b.mass), 4) AS ball_mass, CAST(count(*) AS BIGINT) AS n FROM markers_true a JOIN markers_true b ON {D} <= 10 GROUP BY a.id", ("markers_true",))
def ball_mass(spark, d):
    m = _true(spark, d)
    around = spatial.ball_sums(m.select("id", *AXES), m, 10.0, {"ball_mass": F.col("mass")}).where("n > 0")
    return around.groupBy("id").agg(F.round(F.sum("ball_mass"), 4).alias("ball_mass"), F.sum("n").alias("n"))


@query(f"SELECT id, nearest, d FROM (SELECT b.id, a.id AS nearest, round({D}, 6) AS d, row_number() OVER (PARTITION BY b.id ORDER BY {D}, a.id) AS r FROM markers_pred b CROSS JOIN markers_true a) t WHERE r = 1", ("markers_true", "markers_pred"))
def nearest_center(spark, d):
    near = spatial.knn_join(_pred(spark, d), _true(spark, d), 1, 8.0)
    return near.select(F.col("a_id").alias("id"), F.col("b_id").alias("nearest"), F.round("d", 6).alias("d"))


_KNN = f"k AS (SELECT a.id AS u, b.id AS v, {D} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS r FROM markers_true a JOIN markers_true b ON a.id <> b.id)"


@query(f"WITH {_KNN} SELECT u AS id, array_to_string(list(printf('%.4f', d) ORDER BY r), ' ') AS distances FROM k WHERE r <= 5 GROUP BY u", ("markers_true",))
def knn_distances(spark, d):
    m = _true(spark, d)
    near = spatial.knn_join(m, m, 5, 16.0, other_than_self=True)
    ds = F.transform(F.array_sort(F.collect_list(F.struct("rank", "d"))), lambda s: F.format_string("%.4f", s["d"]))
    return near.groupBy(F.col("a_id").alias("id")).agg(F.array_join(ds, " ").alias("distances"))


@query(f"WITH {_KNN} SELECT u, v, round(d, 6) AS d FROM k WHERE r <= 6", ("markers_true",))
def knn_graph(spark, d):
    return shape.knn_edges(_true(spark, d), 6, 16.0).withColumn("d", F.round("d", 6))


@query(f"WITH {_KNN} SELECT least(u, v) AS u, greatest(u, v) AS v, round(min(d), 6) AS d FROM k WHERE r <= 6 AND d < 48 GROUP BY 1, 2", ("markers_true",))
def color_edges(spark, d):
    e = shape.knn_edges(_true(spark, d), 6, 16.0).where("d < 48")
    return e.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.round(F.min("d"), 6).alias("d"))


@query(f"WITH {BOXES} SELECT id, tile_id, round(x - x0, 6) AS x, round(y - y0, 6) AS y, round(z - z0, 6) AS z FROM markers_pred JOIN tiles ON x BETWEEN x0 AND x1 - 1 AND y BETWEEN y0 AND y1 - 1 AND z BETWEEN z0 AND z1 - 1", ("markers_pred",))
def split_markers(spark, d):
    both = spatial.box_join(_pred(spark, d), tile_grid(spark, d))
    return both.select("id", "tile_id", *[F.round(F.col(a) - F.col(f"{a}0"), 6).alias(a) for a in AXES])


@query(
    f"""WITH {BOXES}, m AS (SELECT id, tile_id, x, y, z, least(x-x0-20, x1-20-x, y-y0-20, y1-20-y, z-z0-20, z1-20-z) AS depth FROM markers_pred JOIN tiles ON x BETWEEN x0 AND x1-1 AND y BETWEEN y0 AND y1-1 AND z BETWEEN z0 AND z1-1), k AS (SELECT * FROM m WHERE depth >= 0)
    SELECT id, tile_id, round(depth, 6) AS depth FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE a.tile_id <> b.tile_id AND {D} < 8 AND (b.depth > a.depth OR (b.depth = a.depth AND (b.tile_id > a.tile_id OR (b.tile_id = a.tile_id AND b.id > a.id)))))""",
    ("markers_pred",),
)
def merge_markers(spark, d):
    split = spatial.box_join(_pred(spark, d), tile_grid(spark, d))
    m = markers.with_depth(split, 20).where("depth >= 0").select("id", "tile_id", *AXES, "depth")
    return markers.merge_tiles(m, 8.0).select("id", "tile_id", F.round("depth", 6).alias("depth"))


@query("SELECT id, round((mass - avg(mass) OVER ()) / stddev_pop(mass) OVER (), 6) AS z FROM markers_pred", ("markers_pred",))
def mass_zscore(spark, d):
    m = _pred(spark, d)
    s = m.agg(F.avg("mass").alias("m"), F.stddev_pop("mass").alias("s"))
    return m.crossJoin(F.broadcast(s)).select("id", F.round((F.col("mass") - F.col("m")) / F.col("s"), 6).alias("z"))


@query(f"WITH n AS (SELECT b.id, a.id AS c, b.x, b.y, b.z, row_number() OVER (PARTITION BY b.id ORDER BY {D}, a.id) AS r FROM markers_pred b CROSS JOIN markers_true a) SELECT c AS id, CAST(count(*) AS BIGINT) AS volume, round(sqrt((var_pop(x) + var_pop(y) + var_pop(z)) / 3), 6) AS radius FROM n WHERE r = 1 GROUP BY c", ("markers_true", "markers_pred"))
def cluster_radius(spark, d):
    p = _pred(spark, d)
    own = spatial.knn_join(p, _true(spark, d), 1, 64.0).select(F.col("a_id").alias("id"), F.col("b_id").alias("c"))
    spread = F.sqrt((F.var_pop("x") + F.var_pop("y") + F.var_pop("z")) / 3)
    return p.join(own, "id").groupBy(F.col("c").alias("id")).agg(F.count(F.lit(1)).alias("volume"), F.round(spread, 6).alias("radius"))


@query(
    f"SELECT b.id, round(coalesce(sum(a.x * a.mass) / sum(a.mass), b.x), 6) AS x, round(coalesce(sum(a.y * a.mass) / sum(a.mass), b.y), 6) AS y, round(coalesce(sum(a.z * a.mass) / sum(a.mass), b.z), 6) AS z FROM markers_pred b LEFT JOIN markers_true a ON {D} <= 12 GROUP BY b.id, b.x, b.y, b.z",
    ("markers_true", "markers_pred"),
)
def mean_shift_step(spark, d):
    moved = shape.mean_shift_step(_pred(spark, d), _true(spark, d).withColumnRenamed("mass", "weight"), 12.0)
    return moved.select("id", *[F.round(a, 6).alias(a) for a in AXES])


def _shift_sql(n: int) -> str:
    step = f"SELECT b.id, coalesce(sum(a.x * a.mass) / sum(a.mass), b.x) AS x, coalesce(sum(a.y * a.mass) / sum(a.mass), b.y) AS y, coalesce(sum(a.z * a.mass) / sum(a.mass), b.z) AS z FROM {{}} b LEFT JOIN markers_true a ON {D} <= 12 GROUP BY b.id, b.x, b.y, b.z"
    return ", ".join(f"s{k + 1} AS ({step.format(f's{k}' if k else 'markers_pred')})" for k in range(n))


@query(f"WITH {_shift_sql(3)} SELECT id, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM s3", ("markers_true", "markers_pred"))
def mean_shift_k3(spark, d):
    points, seeds = _true(spark, d).withColumnRenamed("mass", "weight"), _pred(spark, d)
    for _ in range(3):
        seeds = shape.mean_shift_step(seeds, points, 12.0)
    return seeds.select("id", *[F.round(a, 5).alias(a) for a in AXES])


# ---- matching and evaluation


#: The sequential walks, row by row, in a recursive query that carries what is taken.
_WALK = f"""e AS (SELECT a.id AS a_id, b.id AS b_id, {D} AS d, row_number() OVER (ORDER BY {D}, a.id, b.id) AS rn FROM markers_true a JOIN markers_pred b ON {D} < 8),
 w AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS ua, CAST([] AS BIGINT[]) AS ub UNION ALL
  SELECT e.rn, CASE WHEN list_contains(ua, e.a_id) OR list_contains(ub, e.b_id) THEN ua ELSE list_append(ua, e.a_id) END, CASE WHEN list_contains(ua, e.a_id) OR list_contains(ub, e.b_id) THEN ub ELSE list_append(ub, e.b_id) END FROM w JOIN e ON e.rn = w.rn + 1),
 g AS (SELECT unnest(ua) AS a_id, unnest(ub) AS b_id FROM w WHERE rn = (SELECT max(rn) FROM w))"""


def _suppress_sql(order: str) -> str:
    return f"""WITH RECURSIVE p AS (SELECT id, row_number() OVER (ORDER BY {order}, id) AS rn FROM markers_pred), n AS (SELECT a.id, list(b.id) AS near FROM markers_pred a JOIN markers_pred b ON a.id <> b.id AND {D} <= 12 GROUP BY a.id),
 q AS (SELECT p.rn, p.id, coalesce(n.near, CAST([] AS BIGINT[])) AS near FROM p LEFT JOIN n USING (id)),
 w AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT q.rn, CASE WHEN list_has_any(kept, q.near) THEN kept ELSE list_append(kept, q.id) END FROM w JOIN q ON q.rn = w.rn + 1)
 SELECT unnest(kept) AS id FROM w WHERE rn = (SELECT max(rn) FROM w)"""


_BOTH = ("markers_true", "markers_pred")


def _greedy(spark, d):
    return matching.greedy_near(_true(spark, d), _pred(spark, d), 8.0)


@query(f"WITH RECURSIVE {_WALK} SELECT g.a_id, g.b_id, round(d, 6) AS d FROM g JOIN e USING (a_id, b_id)", _BOTH)
def greedy_match(spark, d):
    return _greedy(spark, d).select("a_id", "b_id", F.round("d", 6).alias("d"))


@query()
def max_weight_match(spark, d):
    """Matched on pairs under 32, accepted under 8."""
    return matching.max_weight_near(_true(spark, d), _pred(spark, d), 32.0).where("d < 8").select("a_id", "b_id", F.round("d", 6).alias("d"))


@query(
    f"""WITH RECURSIVE {_WALK} SELECT CASE WHEN id IN (SELECT a_id FROM g) THEN 'TP' ELSE 'FN' END AS kind, id, x, y, z FROM markers_true UNION ALL SELECT 'FP', id, x, y, z FROM markers_pred WHERE id NOT IN (SELECT b_id FROM g)""",
    _BOTH,
)
def error_markers(spark, d):
    return matching.classify(_true(spark, d), _pred(spark, d), _greedy(spark, d))


@query("SELECT 'FN' AS kind, a.id FROM markers_true a WHERE NOT EXISTS (SELECT 1 FROM markers_pred b WHERE " + D + " < 8) UNION ALL SELECT 'FP', b.id FROM markers_pred b WHERE NOT EXISTS (SELECT 1 FROM markers_true a WHERE " + D + " < 8)", ("markers_true", "markers_pred"))
def fp_fn(spark, d):
    """Markers without any counterpart in reach, on both sides."""
    pairs = spatial.distance_join(_true(spark, d), _pred(spark, d), 8.0)
    lost = _true(spark, d).join(pairs.select(F.col("a_id").alias("id")).distinct().hint("shuffle_hash"), "id", "left_anti").select(F.lit("FN").alias("kind"), "id")
    extra = _pred(spark, d).join(pairs.select(F.col("b_id").alias("id")).distinct().hint("shuffle_hash"), "id", "left_anti").select(F.lit("FP").alias("kind"), "id")
    return lost.unionByName(extra)


_INSIDE = "x BETWEEN 40 AND 469 AND y BETWEEN 40 AND 463 AND z BETWEEN 40 AND 211"


@query(
    f"""WITH RECURSIVE {_WALK}, c AS (SELECT (SELECT count(*) FROM markers_true WHERE {_INSIDE} AND id IN (SELECT a_id FROM g)) AS tp, (SELECT count(*) FROM markers_pred WHERE {_INSIDE} AND id NOT IN (SELECT b_id FROM g)) AS fp,
    (SELECT count(*) FROM markers_true WHERE {_INSIDE} AND id NOT IN (SELECT a_id FROM g)) AS fn) SELECT tp, fp, fn, PRF FROM c""",
    _BOTH,
)
def eval_greedy(spark, d):
    return matching.evaluate(_true(spark, d), _pred(spark, d), BOX, 40, 16.0, by_weight=False)[0]


@query()
def eval_max_weight(spark, d):
    """The scores of a prediction of which a tenth is rejected beforehand."""
    return matching.evaluate(_true(spark, d), _pred(spark, d).withColumn("rejected", F.col("id") % 10 == 3), BOX, 40, 16.0)[0]


_LOG = f"""{BOXES}, hit AS (SELECT DISTINCT a.id FROM markers_true a JOIN markers_pred b ON {D} < 8), found AS (SELECT DISTINCT b.id FROM markers_true a JOIN markers_pred b ON {D} < 8),
 t AS (SELECT tile_id, sum(CASE WHEN m.id IN (SELECT id FROM hit) THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN m.id IN (SELECT id FROM hit) THEN 0 ELSE 1 END) AS fn FROM markers_true m JOIN tiles ON {IN_TILE} GROUP BY tile_id),
 f AS (SELECT tile_id, sum(CASE WHEN m.id IN (SELECT id FROM found) THEN 0 ELSE 1 END) AS fp FROM markers_pred m JOIN tiles ON {IN_TILE} GROUP BY tile_id),
 log AS (SELECT tile_id, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp, CAST(coalesce(fn, 0) AS BIGINT) AS fn FROM t FULL JOIN f USING (tile_id))"""
_PRF = """round(CASE WHEN tp = 0 THEN CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp = 0 THEN CASE WHEN fn = 0 THEN 1.0 ELSE 0.0 END ELSE tp / (tp + fn) END, 6) AS recall,
 round(CASE WHEN tp > 0 THEN 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) WHEN fp = 0 AND fn = 0 THEN 1.0 ELSE 0.0 END, 6) AS f1"""

ORACLE["eval_greedy"] = ORACLE["eval_greedy"].replace("PRF FROM", f"{_PRF} FROM")


def _eval_log(spark, d):
    """Per tile: markers with and without a counterpart in reach."""
    pairs = spatial.distance_join(_true(spark, d), _pred(spark, d), 8.0)
    hit, found = pairs.select(F.col("a_id").alias("id"), F.lit(1).alias("hit")).distinct(), pairs.select(F.col("b_id").alias("id"), F.lit(1).alias("hit")).distinct()
    tiled = lambda m: tiling.assign_tiles(m, BOX, BOX_TILES, BOX_MARGIN)
    t = tiled(_true(spark, d).join(hit, "id", "left")).groupBy("tile_id").agg(F.count("hit").alias("tp"), F.count_if(F.col("hit").isNull()).alias("fn"))
    f = tiled(_pred(spark, d).join(found, "id", "left")).groupBy("tile_id").agg(F.count_if(F.col("hit").isNull()).alias("fp"))
    return t.join(f, "tile_id", "full").fillna(0, ["tp", "fp", "fn"]).select("tile_id", "tp", "fp", "fn")


@query(f"WITH {_LOG} SELECT tile_id, tp, fp, fn, {_PRF} FROM log", ("markers_true", "markers_pred"))
def prf1(spark, d):
    return matching.prf(_eval_log(spark, d))


@query(f"WITH {_LOG}, r AS (SELECT coalesce(tile_id, 'TOTAL') AS tile_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM log GROUP BY GROUPING SETS ((tile_id), ())) SELECT tile_id, tp, fp, fn, {_PRF} FROM r", ("markers_true", "markers_pred"))
def results_rollup(spark, d):
    log = _eval_log(spark, d).rollup("tile_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.grouping("tile_id").alias("all"))
    return matching.prf(log.withColumn("tile_id", F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("tile_id"))).drop("all"))


#: Runs of a model: the reach of a match and the attribute a prediction needs.
REACHES, NEEDS = (4, 8, 12), (0, 1000, 1500)
_RUNS = f"""p AS (SELECT a.id AS a, b.id AS b, b.mass, {D} AS d FROM markers_true a JOIN markers_pred b ON {D} < 12),
 g AS (SELECT r, need FROM (SELECT unnest([4, 8, 12]) AS r), (SELECT unnest([0, 1000, 1500]) AS need)),
 k AS (SELECT r, need, count(DISTINCT a) AS tp, count(DISTINCT b) AS found FROM g LEFT JOIN p ON d < r AND mass > need GROUP BY r, need),
 l AS (SELECT r, need, CAST(tp AS BIGINT) AS tp, CAST((SELECT count(*) FROM markers_pred WHERE mass > need) - found AS BIGINT) AS fp, CAST((SELECT count(*) FROM markers_true) - tp AS BIGINT) AS fn FROM k),
 runs AS (SELECT r, need, tp, fp, fn, {_PRF} FROM l)"""


def _runs(spark, d):
    """``r, need, tp, fp, fn``: markers with a counterpart in reach, for every run."""
    true, pred = _true(spark, d), _pred(spark, d).select("id", *AXES, "mass")
    runs = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(n).alias("need")) for r in REACHES for n in NEEDS]))
    near = spatial.distance_join(true.select("id", *AXES), pred, float(max(REACHES))).select("a_id", "b_id", "d", "b_mass", runs.alias("k")).where("d < k.r AND b_mass > k.need")
    hits = near.groupBy("k.r", "k.need").agg(F.count_distinct("a_id").alias("tp"), F.count_distinct("b_id").alias("found"))
    every = pred.select("mass", runs.alias("k")).where("mass > k.need").groupBy("k.r", "k.need").agg(F.count(F.lit(1)).alias("n"))
    log = every.join(hits, ["r", "need"], "left").fillna(0, ["tp", "found"])
    return log.crossJoin(F.broadcast(true.agg(F.count(F.lit(1)).alias("all")))).select("r", "need", "tp", (F.col("n") - F.col("found")).alias("fp"), (F.col("all") - F.col("tp")).alias("fn"))


def _pivot_sql(rows: str, columns: str, values: tuple[int, ...]) -> str:
    parts = []
    for score in ("precision", "recall", "f1"):
        cells = ", ".join(f"max(CASE WHEN {columns} = {v} THEN {score} END) AS {columns}_{v}" for v in values)
        parts.append(f"SELECT '{score}' AS score, {rows}, {cells} FROM runs GROUP BY {rows}")
    return f"WITH {_RUNS} " + " UNION ALL ".join(parts)


def _pivots(spark, d, rows: str, columns: str, values: tuple[int, ...]):
    scores, out = matching.model_scores(_runs(spark, d), "r", "need"), None
    for score in ("precision", "recall", "f1"):
        wide = matching.model_pivot(scores, rows, columns, score, list(values))
        part = wide.select(F.lit(score).alias("score"), rows, *[F.col(f"`{columns}={v}`").alias(f"{columns}_{v}") for v in values])
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_RUNS} SELECT * FROM runs", ("markers_true", "markers_pred"))
def model_scores(spark, d):
    """Precision, recall and F1 of every run."""
    return matching.model_scores(_runs(spark, d), "r", "need")


@query(_pivot_sql("need", "r", REACHES), ("markers_true", "markers_pred"))
def model_pivot(spark, d):
    """Model selection: each score as a table of one parameter by the other."""
    return _pivots(spark, d, "need", "r", REACHES)


@query(_pivot_sql("r", "need", NEEDS), ("markers_true", "markers_pred"))
def model_pivot_transposed(spark, d):
    return _pivots(spark, d, "r", "need", NEEDS)


_SWEEP = f"""vals AS (SELECT v, count(*) AS n FROM (SELECT DISTINCT mass AS v FROM markers_pred WHERE {_INSIDE}) JOIN markers_pred ON mass > v WHERE {_INSIDE} GROUP BY v HAVING count(*) > 10),
 pairs AS (SELECT a.id AS a, b.id AS b, b.mass AS m, row_number() OVER (ORDER BY {D}, a.id, b.id) AS k FROM markers_true a JOIN markers_pred b ON {D} < 8),
 r AS (SELECT v, a, b, k, 0 AS won FROM vals JOIN pairs ON m > v UNION ALL
  SELECT v, a, b, k, won FROM (SELECT *, max(won) OVER (PARTITION BY v, a) AS wa, max(won) OVER (PARTITION BY v, b) AS wb FROM
   (SELECT v, a, b, k, CASE WHEN k = min(k) OVER (PARTITION BY v, a) AND k = min(k) OVER (PARTITION BY v, b) THEN 1 ELSE 0 END AS won FROM r WHERE won = 0)) WHERE won = 1 OR (wa = 0 AND wb = 0)),
 h AS (SELECT v, count(*) AS tp FROM r JOIN markers_true t ON t.id = r.a WHERE won = 1 AND {_INSIDE} GROUP BY v),
 f AS (SELECT v, count(*) AS found FROM r JOIN markers_pred t ON t.id = r.b WHERE won = 1 AND {_INSIDE} GROUP BY v),
 l AS (SELECT vals.v AS value, CAST(n AS BIGINT) AS n, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(n - coalesce(found, 0) AS BIGINT) AS fp,
   CAST((SELECT count(*) FROM markers_true WHERE {_INSIDE}) - coalesce(tp, 0) AS BIGINT) AS fn FROM vals LEFT JOIN h ON h.v = vals.v LEFT JOIN f ON f.v = vals.v),
 curve AS (SELECT value, n, tp, fp, fn, {_PRF} FROM l)"""


def _sweep(spark, d):
    return matching.pr_sweep(_true(spark, d), _pred(spark, d), "mass", BOX, 40, 8.0)


@query(f"WITH RECURSIVE {_SWEEP} SELECT * FROM curve", ("markers_true", "markers_pred"))
def pr_curve(spark, d):
    """Precision, recall and F1 at every value of an attribute; the SQL matches anew for each."""
    return _sweep(spark, d)


@query(f"WITH RECURSIVE {_SWEEP} SELECT * FROM curve WHERE f1 > 0 ORDER BY f1 DESC, value LIMIT 1", ("markers_true", "markers_pred"))
def pr_best(spark, d):
    """The value with the best F1."""
    return matching.best_cut(_sweep(spark, d))


@query(
    f"""WITH RECURSIVE d AS (SELECT DISTINCT mass FROM markers_pred WHERE {_INSIDE}), s AS (SELECT min(mass) AS low, max(mass) AS high FROM d), b AS (SELECT CAST(floor(coalesce((mass - low) / nullif(high - low, 0), 0) * 255) AS INT) AS bin FROM d, s),
    hist AS (SELECT 'g' AS tile_id, n.bin, CAST(count(b.bin) AS BIGINT) AS n FROM (SELECT CAST(range AS INT) AS bin FROM range(256)) n LEFT JOIN b ON n.bin = b.bin GROUP BY ALL), {PREFIX}, {CUTS},
    e AS (SELECT round(low + t0 / 255.0 * (high - low), 6) AS v FROM cuts, s), {_SWEEP.replace(f"(SELECT DISTINCT mass AS v FROM markers_pred WHERE {_INSIDE})", "e")} SELECT * FROM curve""",
    ("markers_true", "markers_pred"),
)
def pr_entropy(spark, d):
    """The scores where the entropy of all values of the attribute would cut."""
    values = _pred(spark, d).where(tiling.inside(BOX, 40)).select("mass").distinct()
    at = threshold.max_entropy_of(values, "mass").first().threshold
    return matching.pr_sweep(_true(spark, d), _pred(spark, d), "mass", BOX, 40, 8.0, at=[at]).where(F.col("value") == at)


@query(f"SELECT CAST(floor(({D} - 10) / 0.5) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM markers_true a JOIN markers_true b ON a.id < b.id WHERE {D} >= 10 AND {D} < 22 GROUP BY 1", ("markers_true",))
def distance_histogram(spark, d):
    m = _true(spark, d).select("id", *AXES)
    return spatial.shell_counts(m, 10.0, 22.0, 0.5).select(F.col("bin").cast("int").alias("bin"), "n")


@query("SELECT coalesce(a.id, b.id) AS id, round(coalesce((a.x + b.x) / 2, a.x, b.x), 6) AS x, round(coalesce((a.y + b.y) / 2, a.y, b.y), 6) AS y, round(coalesce((a.z + b.z) / 2, a.z, b.z), 6) AS z, CASE WHEN a.id IS NULL THEN 'second' WHEN b.id IS NULL THEN 'first' ELSE 'both' END AS origin FROM markers_true a FULL JOIN markers_pred b ON a.id = b.id", ("markers_true", "markers_pred"))
def fuse_markers(spark, d):
    """Two views fused on known matches (equal ids)."""
    a, b = _true(spark, d), _pred(spark, d)
    matches = a.join(b, "id", "left_semi").select(F.col("id").alias("a_id"), F.col("id").alias("b_id"))
    fused = markers.fuse(a, b, matches)
    return fused.select(F.coalesce("a_id", "b_id").alias("id"), *[F.round(c, 6).alias(c) for c in AXES], "origin")


@query("SELECT name, id, distance FROM (SELECT 'n' || (id % 97) AS name, id, mass AS distance, row_number() OVER (PARTITION BY id % 97 ORDER BY mass, id) AS r FROM markers_pred) t WHERE r = 1", ("markers_pred",))
def best_distance_per_name(spark, d):
    m = _pred(spark, d).select(F.concat(F.lit("n"), (F.col("id") % 97).cast("string")).alias("name"), "id", F.col("mass").alias("distance"))
    return markers.best_per_name(m)


def _pair_sql(a: int, b: int) -> str:
    return f"CASE WHEN n = 4 OR (n = 3 AND s{a}) OR (n = 2 AND ((s0 AND s2) OR (s1 AND s3) OR (s{a} AND s{b}))) OR (n = 1 AND (s{a} OR s{b})) THEN '{a * 90:03d}_{b * 90:03d}' END"


@query(
    f"""WITH s AS (SELECT id, {", ".join(f"(id * 7 + {k} * 13) % 60 >= 30 AS s{k}" for k in range(4))} FROM markers_true), t AS (SELECT *, CAST(s0 AS INT) + CAST(s1 AS INT) + CAST(s2 AS INT) + CAST(s3 AS INT) AS n FROM s)
    SELECT CAST(id AS VARCHAR) AS tile_id, n AS n_seen, concat_ws(',', {", ".join(_pair_sql(a, b) for a in (0, 2) for b in (1, 3))}) AS pairs FROM t""",
    ("markers_true",),
)
def visible_pairs(spark, d):
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    v = _true(spark, d).select(F.col("id").cast("string").alias("tile_id"), "id", k.alias("k"))
    views = v.select("tile_id", F.format_string("%03d", F.col("k") * 90).alias("view_id"), ((F.col("id") * 7 + F.col("k") * 13) % 60).cast("int").alias("t1"))
    return markers.visible_pairs(views, ("000", "090", "180", "270"))


@query(f"WITH {BOXES}, m AS (SELECT tile_id, id, x, y, z FROM markers_true JOIN tiles ON {IN_TILE}), c AS (SELECT tile_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM m GROUP BY tile_id) SELECT tile_id, id FROM (SELECT tile_id, id, row_number() OVER (PARTITION BY tile_id ORDER BY (x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz), id) AS r FROM m JOIN c USING (tile_id)) t WHERE r = 1", ("markers_true",))
def tile_medoids(spark, d):
    m = tiling.assign_tiles(_true(spark, d), BOX, BOX_TILES, BOX_MARGIN).select("tile_id", "id", *AXES)
    c = m.groupBy("tile_id").agg(*[F.avg(a).alias(f"c{a}") for a in AXES])
    d2 = sum((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in AXES)
    return m.join(F.broadcast(c), "tile_id").groupBy("tile_id").agg(F.min_by("id", F.struct(d2, F.col("id"))).alias("id"))


@query(f"SELECT a.id AS u, b.id AS v, round(exp(-({D}) * ({D}) / 900), 6) AS weight FROM markers_true a JOIN markers_true b ON a.id <> b.id AND {D} < 30", ("markers_true",))
def gaussian_kernel(spark, d):
    m = _true(spark, d).select("id", *AXES)
    pairs = spatial.near_pairs(m, 30.0, "weight", lambda d: spatial.half_up(np.exp(-d * d / 900), 6))
    return pairs.select(F.col("a_id").alias("u"), F.col("b_id").alias("v"), "weight")


@query("SELECT CAST(count(*) AS DOUBLE) AS total, round(sum(a.x), 4) AS sx, round(sum(b.x), 4) AS su, round(sum(a.x * b.x), 4) AS sxu, round(sum(a.x * b.y), 4) AS sxv, round(sum(a.y * b.x), 4) AS syu, round(sum(a.z * b.z), 4) AS szw FROM markers_true a JOIN markers_view_b b ON a.id = b.id", ("markers_true", "markers_view_b"))
def horn_moments(spark, d):
    m = shape.moments(_view_pairs(spark, d))
    return m.select("total", *[F.round(c, 4).alias(c) for c in ("sx", "su", "sxu", "sxv", "syu", "szw")])


def _view_pairs(spark, d):
    b = view(spark, d, "markers_view_b").select("id", *[F.col(a).alias(c) for a, c in zip(AXES, "uvw", strict=True)])
    return _true(spark, d).join(b, "id")


def _motion(spark, r, t):
    rows = [(i, *[round(float(v), 5) + 0.0 for v in r[i]], round(float(t[i]), 4) + 0.0) for i in range(3)]
    return spark.createDataFrame(rows, "row int, r0 double, r1 double, r2 double, t double")


_TURN = "SELECT 0 AS row, 0.0 AS r0, -1.0 AS r1, 0.0 AS r2, 10.0 AS t UNION ALL SELECT 1, 1.0, 0.0, 0.0, -4.0 UNION ALL SELECT 2, 0.0, 0.0, 1.0, 3.0"


@query(_TURN)
def rigid_from_pairs(spark, d):
    return _motion(spark, *shape.fit_rigid(_view_pairs(spark, d)))


@query(_TURN)
def rigid_from_landmarks(spark, d):
    """Landmarks of which a fifth are wrong: the consensus is the true motion."""
    wrong = F.col("id") % 5 == 0
    pairs = _view_pairs(spark, d).withColumns({c: F.when(wrong, F.col(c) + 40 + F.col("id") % 17).otherwise(F.col(c)) for c in "uvw"})
    return _motion(spark, *shape.ransac(pairs, trials=200))


@query()
def icp(spark, d):
    """Markers shifted by a little: matching and fitting in turn bring them back."""
    moved = _true(spark, d).withColumns({"x": F.col("x") + 1.5, "y": F.col("y") - 1.0})
    r, t, _ = shape.icp(moved, _true(spark, d), 4.0, 5)
    return _motion(spark, r, t)


@query(_suppress_sql("mass DESC"), ("markers_pred",))
def suppress_markers(spark, d):
    """Greedy suppression by descending mass within 12."""
    return matching.suppress(_pred(spark, d), 12.0).select("id")


@query(_suppress_sql("mass"), ("markers_pred",))
def suppress_lightest(spark, d):
    """As the split search does it: by ascending mass."""
    return matching.suppress(_pred(spark, d), 12.0, heaviest_first=False).select("id")


@query()
def merge_views(spark, d):
    """Four view pairs of one tile: fused within their frames, the third view's turned back, fused again."""
    a, b = _true(spark, d), _pred(spark, d)
    r, t = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]), np.array([10.0, -4.0, 3.0])
    far = lambda df: shape.rigid(df, r, t)
    found = {("000", "090"): a, ("000", "270"): b, ("180", "090"): far(a), ("180", "270"): far(b.where("id % 3 = 0"))}
    match = lambda p, q: matching.greedy_near(p, q, 4.0)
    whole = markers.merge_views(found, ("000", "090", "180", "270"), match, lambda df: shape.rigid(df, r, t, inverse=True), BOX)
    return whole.select(*[F.round(c, 4).alias(c) for c in AXES])


@query()
def min_connected_k(spark, d):
    return spark.createDataFrame([(shape.smallest_connected_k(_true(spark, d), 64.0, 32),)], "k int")


@query()
def geodesic_patch(spark, d):
    m = _true(spark, d)
    return shape.geodesic_near(m, shape.knn_edges(m, 6, 16.0), 60.0, lambda d: spatial.half_up(d, 6))


@query()
def manifold_filter(spark, d):
    m = _true(spark, d)
    patches = shape.geodesic_near(m, shape.knn_edges(m, 6, 16.0), 60.0)
    found = shape.manifold_distances(patches, m, 30.0)
    return found.groupBy("id").agg(F.round(F.min("distance"), 4).alias("distance"))


@query()
def find_cells(spark, d):
    """All tiles of the volume: thresholds, seeds, mean shift, suppression."""
    found = detect.find_cells(_voxels(spark, d), VOLUME, VOLUME_TILES, VOLUME_MARGIN, seed_radius=2.0)
    return found.select("tile_id", "id", *[F.round(a, 4).alias(a) for a in AXES], F.round("mass", 4).alias("mass"), F.round("z_score", 4).alias("z_score"))


@query()
def deconvolve_identity(spark, d):
    """The deconvolution with a predictor that gives each patch back."""
    return learning.deconvolve(_voxels(spark, d), {a: (0, w) for a, w in zip(AXES, VOLUME, strict=True)}, 1, 2, lambda x: x)


@query(
    "SELECT a.id, round(least(2.0, coalesce(min(" + D + ") / 3, 2.0)), 6) AS sigma FROM markers_true a LEFT JOIN markers_true b ON a.id <> b.id AND " + D + " < 16 GROUP BY a.id",
    ("markers_true",),
)
def shrunk_sigma(spark, d):
    return learning.shrunk_sigma(_true(spark, d), 2.0, 16.0).withColumn("sigma", F.round("sigma", 6))


@query()
def cluster_shares(spark, d):
    p = _pred(spark, d)
    own = spatial.knn_join(p, _true(spark, d), 1, 64.0).select(F.col("a_id").alias("id"), F.col("b_id").alias("cluster"))
    found = shape.principal_shares(p.join(own, "id"), "cluster")
    return found.select("cluster", "n", *[F.round(F.col("evr")[k], 6).alias(f"share{k}") for k in range(3)])
