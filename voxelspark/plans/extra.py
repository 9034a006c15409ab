"""More queries: detection in detail, marker bookkeeping, registration and regression, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelspark.operators import blocks, detect, kernels, learning, markers, matching, registration, shape, spatial, tiling
from voxelspark.plans.catalog import AXES, BOX, BOX_MARGIN, BOX_TILES, BOXES, IN_TILE, ORACLE, VOLUME, VOLUME_MARGIN, VOLUME_TILES, D, _comments, _cube_sql, _motion, _pred, _true, _view_pairs, _voxels, query
from voxelspark.plans.fixtures import with_views

_BOTH = ("markers_true", "markers_pred")


def _shares_sql(moments: str, few: str) -> str:
    """Shares of the eigenvalues of symmetric matrices ``xx..zz`` of a table, by the closed form for three by three; ``few`` in their place for small groups."""
    return f"""t AS (SELECT *, (xx + yy + zz) / 3 AS q, (xx-(xx+yy+zz)/3)*(xx-(xx+yy+zz)/3) + (yy-(xx+yy+zz)/3)*(yy-(xx+yy+zz)/3) + (zz-(xx+yy+zz)/3)*(zz-(xx+yy+zz)/3) + 2*(xy*xy + xz*xz + yz*yz) AS p2 FROM {moments}),
 u AS (SELECT *, sqrt(p2 / 6) AS p FROM t),
 v AS (SELECT *, CASE WHEN p > 0 THEN ((xx-q)*((yy-q)*(zz-q) - yz*yz) - xy*(xy*(zz-q) - yz*xz) + xz*(xy*yz - (yy-q)*xz)) / (2*p*p*p) ELSE 0.0 END AS r FROM u),
 w AS (SELECT *, acos(greatest(-1.0, least(1.0, r))) / 3 AS phi FROM v),
 e AS (SELECT *, q + 2*p*cos(phi) AS e0, q + 2*p*cos(phi + 2*pi()/3) AS e2 FROM w),
 shares AS (SELECT *, {few} FROM e)"""


def _few(n: int, values) -> str:
    parts = ("e0", "(3*q - e0 - e2)", "e2")
    return ", ".join(f"round(CASE WHEN n < {n} THEN {v} ELSE {e} / greatest(3*q, 1e-300) END, 5) AS share{k}" for k, (e, v) in enumerate(zip(parts, values, strict=True)))


_COV = ", ".join(f"coalesce(covar_samp({a}, {b}), 0.0) AS {a}{b}" for i, a in enumerate(AXES) for b in AXES[i:])


def _rounded_shares(df, key: str):
    return df.select(key, "n", *[F.round(F.col("evr")[k], 5).alias(f"share{k}") for k in range(3)])


# ---- detection


@query()
def seeds(spark, d):
    found = detect.seeds(_voxels(spark, d), VOLUME, VOLUME_TILES, VOLUME_MARGIN, radius=2.0)
    return found.select("tile_id", *AXES, "intensity", F.round("local_mass", 4).alias("local_mass"))


@query()
def find_cells_local(spark, d):
    found = detect.find_cells_local(_voxels(spark, d), VOLUME, VOLUME_TILES, VOLUME_MARGIN, seed_radius=2.0)
    return found.select("tile_id", "id", *[F.round(a, 4).alias(a) for a in AXES], F.round("mass", 4).alias("mass"), F.round("z_score", 4).alias("z_score"))


@query()
def mean_shift_full(spark, d):
    """All markers climb to rest, tile by tile."""
    tiled = lambda df: tiling.assign_tiles(df, BOX, BOX_TILES, BOX_MARGIN)
    found = shape.mean_shift(tiled(_pred(spark, d)), tiled(_true(spark, d).withColumnRenamed("mass", "weight")), 12.0)
    return found.select("tile_id", "id", *[F.round(a, 3).alias(a) for a in AXES], "volume", F.round("mass", 2).alias("mass"))


@query(f"SELECT b.id, CAST(count(*) AS BIGINT) AS n, round(sum(a.mass), 4) AS mass FROM markers_pred b JOIN markers_true a ON {D} <= 10 GROUP BY b.id", _BOTH)
def final_masses(spark, d):
    found = detect.final_masses(_pred(spark, d), _true(spark, d).withColumnRenamed("mass", "weight"))
    return found.select("id", "n", F.round("mass", 4).alias("mass"))


@query(
    f"""WITH s AS (SELECT b.id, sqrt(a.mass / 255) * a.x AS x, sqrt(a.mass / 255) * a.y AS y, sqrt(a.mass / 255) * a.z AS z FROM markers_pred b JOIN markers_true a ON {D} <= 40),
    m AS (SELECT id, CAST(count(*) AS BIGINT) AS n, {_COV} FROM s GROUP BY id), {_shares_sql("m", _few(64, detect.FEW_SHARES))} SELECT id, n, share0, share1, share2 FROM shares""",
    _BOTH,
)
def weighted_shares(spark, d):
    return _rounded_shares(detect.weighted_shares(_pred(spark, d), _true(spark, d).withColumnRenamed("mass", "weight"), 40.0), "id")


@query(
    f"""WITH n AS (SELECT b.id, a.id AS c, b.mass, {D} AS d, row_number() OVER (PARTITION BY b.id ORDER BY {D}, a.id) AS r FROM markers_pred b CROSS JOIN markers_true a)
    SELECT c AS id, CAST(count(*) AS BIGINT) AS volume, round(sum(mass), 4) AS mass FROM n WHERE r = 1 AND d <= 12 GROUP BY c""",
    _BOTH,
)
def cluster_volume_mass(spark, d):
    """Points within reach belong to the centre nearest to them."""
    p = _pred(spark, d)
    own = spatial.knn_join(p, _true(spark, d), 1, 12.0, within=12.0).select(F.col("a_id").alias("id"), F.col("b_id").alias("c"))
    return p.join(own, "id").groupBy(F.col("c").alias("id")).agg(F.count(F.lit(1)).alias("volume"), F.round(F.sum("mass"), 4).alias("mass"))


ORACLE["cluster_shares"] = with_views(
    list(_BOTH),
    f"""WITH n AS (SELECT b.id, a.id AS c, b.x, b.y, b.z, row_number() OVER (PARTITION BY b.id ORDER BY {D}, a.id) AS r FROM markers_pred b CROSS JOIN markers_true a),
    m AS (SELECT c AS cluster, CAST(count(*) AS BIGINT) AS n, {_COV} FROM n WHERE r = 1 GROUP BY c),
    {_shares_sql("m", _few(10, (0.333, 0.333, 0.333)).replace(", 5)", ", 6)"))} SELECT cluster, n, share0, share1, share2 FROM shares""",
)

_CENTRE = "SELECT id, CAST(floor(x / 40) AS BIGINT) AS x, CAST(floor(y / 40) AS BIGINT) AS y, CAST(floor(z / 40) AS BIGINT) AS z, mass FROM markers_pred"


@query(f"SELECT x, y, z, max(id) AS id, CAST(count(*) AS BIGINT) AS n, arg_max(mass, id) AS mass FROM ({_CENTRE}) c GROUP BY x, y, z", ("markers_pred",))
def collapse_centres(spark, d):
    """Centres at one place are one: the last one's mass holds."""
    c = _pred(spark, d).select("id", *[F.floor(F.col(a) / 40).alias(a) for a in AXES], "mass")
    return c.groupBy(*AXES).agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"), F.max_by("mass", "id").alias("mass"))


# ---- markers


@query("SELECT id FROM markers_pred WHERE x BETWEEN 0 AND 508 AND y BETWEEN 0 AND 502 AND z BETWEEN 0 AND 250", ("markers_pred",))
def within_volume(spark, d):
    return markers.within_volume(_pred(spark, d), BOX).select("id")


_NAMED = "SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN 'centre (landmark ' || id || ')' ELSE 'MS_center ' || id END AS name FROM markers_pred"


def _named(spark, d):
    n = F.col("id")
    name = F.when(n % 5 == 0, F.lit(None).cast("string")).when(n % 3 == 0, F.format_string("centre (landmark %d)", n)).otherwise(F.format_string("MS_center %d", n))
    return _pred(spark, d).select("id", name.alias("name"))


@query(f"SELECT id, name FROM ({_NAMED}) m WHERE name IS NULL OR name NOT LIKE '%(landmark%'", ("markers_pred",))
def without_landmarks(spark, d):
    return markers.without_landmarks(_named(spark, d))


@query("SELECT id, coalesce(CASE WHEN id % 7 <> 0 THEN mass END >= 1000, false) AS rejected FROM markers_pred", ("markers_pred",))
def reject_far(spark, d):
    """A marker without a distance is never rejected."""
    m = _pred(spark, d).select("id", F.when(F.col("id") % 7 != 0, F.col("mass")).alias("distance"))
    return markers.reject_far(m, 1000.0).select("id", "rejected")


@query("SELECT id, 0.0 AS distance FROM markers_pred", ("markers_pred",))
def constant_distance(spark, d):
    return _pred(spark, d).select("id", F.lit(0.0).alias("distance"))


@query("SELECT x, y, z, round(1 / (1 + exp(-(intensity - 128) / 32.0)), 6) AS value FROM voxels", ("voxels",))
def logistic(spark, d):
    return _voxels(spark, d).select(*AXES, F.round(learning.logistic((F.col("intensity") - 128) / F.lit(32.0)), 6).alias("value"))


@query("SELECT id, x, y, z FROM markers_true WHERE id IN (SELECT id FROM markers_pred WHERE mass > 950)", _BOTH)
def patch_rows(spark, d):
    """The rows of a patch by its index."""
    return _true(spark, d).join(_pred(spark, d).where("mass > 950").select("id"), "id", "left_semi").select("id", *AXES)


_SUBSTACK = "(SELECT id, x, y, z, lpad(CAST(id % 8 AS VARCHAR), 6, '0') AS substack FROM markers_true)"


def _with_substack(spark, d):
    return _comments(spark, d).select("id", *AXES, markers.substack_of().alias("substack"))


@query(f"SELECT substack, CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM {_SUBSTACK} m GROUP BY substack", ("markers_true",))
def points_by_substack(spark, d):
    return _with_substack(spark, d).groupBy("substack").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(a), 6).alias(a) for a in AXES])


@query(f"SELECT id, substack FROM {_SUBSTACK} m WHERE substack IN (SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') FROM nation WHERE n_regionkey = 1)", ("markers_true",))
def substacks_listed(spark, d):
    """Points of the substacks of a list."""
    from voxelspark.plans.fixtures import read

    listed = read(spark, d, "nation").where("n_regionkey = 1").select(F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias("substack"))
    return _with_substack(spark, d).join(listed, "substack", "left_semi").select("id", "substack")


@query(
    f"""WITH p AS (SELECT substack, v.view_id FROM (SELECT DISTINCT substack FROM {_SUBSTACK} m) s CROSS JOIN (VALUES ('000_090'), ('000_270'), ('180_090'), ('180_270')) v(view_id)),
    f AS (SELECT lpad(CAST(id % 8 AS VARCHAR), 6, '0') AS substack, CASE id % 3 WHEN 0 THEN '000_090' WHEN 1 THEN '180_270' ELSE '000_270' END AS view_id, count(*) AS n FROM markers_pred GROUP BY 1, 2)
    SELECT substack, view_id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM p LEFT JOIN f USING (substack, view_id)""",
    _BOTH,
)
def pair_results(spark, d):
    """Results of all view pairs of a tile: what isn't there is empty."""
    wanted = _with_substack(spark, d).select("substack").distinct().withColumn("view_id", F.explode(F.array(*[F.lit(v) for v in ("000_090", "000_270", "180_090", "180_270")])))
    n = F.col("id") % 3
    view_id = F.when(n == 0, "000_090").when(n == 1, "180_270").otherwise("000_270")
    found = _pred(spark, d).groupBy(F.lpad((F.col("id") % 8).cast("string"), 6, "0").alias("substack"), view_id.alias("view_id")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(found, ["substack", "view_id"], "left").fillna(0, ["n"])


@query("SELECT DISTINCT CAST(floor(mass / 10) AS BIGINT) AS radius FROM markers_pred", ("markers_pred",))
def distinct_values(spark, d):
    return _pred(spark, d).select(F.floor(F.col("mass") / 10).alias("radius")).distinct()


@query(
    "SELECT CAST(count(*) FILTER (label = 1) AS BIGINT) AS positives, CAST(count(*) FILTER (label = 0) AS BIGINT) AS negatives, CAST(count(*) FILTER (mass > 1000) AS BIGINT) AS rejected, round(count(*) FILTER (label = 1) / count(*) FILTER (label = 0), 6) AS ratio FROM (SELECT CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS label, mass FROM markers_pred) m",
    ("markers_pred",),
)
def label_ratio(spark, d):
    label = (F.col("id") % 4 == 0).cast("int")
    return learning.label_counts(_pred(spark, d).select(label.alias("label"), (F.col("mass") > 1000).alias("rejected")))


@query()
def merge_in_order(spark, d):
    split = spatial.box_join(_pred(spark, d), tiling.tile_grid(spark, BOX, BOX_TILES, BOX_MARGIN))
    m = markers.with_depth(split, 20).where("depth >= 0").select("id", "tile_id", *AXES, "depth")
    return markers.merge_in_order(m, 8.0).select("id", "tile_id", F.round("depth", 6).alias("depth"))


@query(
    f"""WITH {BOXES}, m AS (SELECT tile_id, id, dense_rank() OVER (ORDER BY tile_id) AS t, row_number() OVER (PARTITION BY tile_id ORDER BY id) AS n FROM markers_true JOIN tiles ON {IN_TILE})
    SELECT tile_id, id, 'MS_center ' || (n - 1) AS name, round((t - 1) * 0.31 % 1, 6) AS hue FROM m""",
    ("markers_true",),
)
def numbered_markers(spark, d):
    """Names numbered within the tile, and a hue that turns from tile to tile."""
    tiles = tiling.tile_grid(spark, BOX, BOX_TILES, BOX_MARGIN)
    return markers.numbered(tiling.assign_tiles(_true(spark, d), BOX, BOX_TILES, BOX_MARGIN).select("tile_id", "id"), tiles).select("tile_id", "id", "name", F.round("hue", 6).alias("hue"))


@query("SELECT id, CAST((row_number() OVER (ORDER BY id DESC) - 1) % 64 AS INT) AS job FROM markers_true", ("markers_true",))
def seeds_to_jobs(spark, d):
    """Seeds dealt to 64 jobs in turn, the last one first."""
    return markers.dealt(_true(spark, d).select("id"), 64)


@query()
def color_hues(spark, d):
    m = _true(spark, d)
    edges = shape.knn_edges(m, 5, 16.0).where("d < 48 AND u < v")
    return matching.hues(m.select("id"), edges.select("u", "v"))


# ---- patches


@query(
    f"""WITH k AS (SELECT c.x, c.y, c.z, CAST(n.intensity * 32 // 256 AS INT) AS b, count(*) AS n FROM (SELECT * FROM voxels WHERE x % 4 = 1 AND y % 4 = 1 AND z % 4 = 1) c CROSS JOIN ({"SELECT * FROM " + _cube_sql(1)}) o JOIN voxels n ON n.x = c.x + dx AND n.y = c.y + dy AND n.z = c.z + dz GROUP BY ALL),
    f AS (SELECT x, y, z, sum(CASE WHEN b > 0 THEN n ELSE 0 END) AS above FROM k GROUP BY x, y, z), a AS (SELECT x, y, z, b, n FROM k WHERE b > 0 UNION ALL SELECT x, y, z, 0, 27 - above FROM f WHERE above < 27)
    SELECT x, y, z, round(-sum(n / 27.0 / 8 * log2(n / 27.0 / 8)), 6) AS entropy FROM a GROUP BY x, y, z""",
    ("voxels",),
)
def density_entropy(spark, d):
    """Every fourth voxel on each axis: entropy, base two, of the density of the values around in 32 bins."""
    return blocks.density_entropy(blocks.store(blocks.pack(_voxels(spark, d))), 1, 32, 4, 1).withColumn("entropy", F.round("entropy", 6))


@query(
    """WITH w AS (SELECT id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, least(2.0, coalesce((SELECT min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) FROM markers_true b WHERE b.id <> a.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 256) / 3, 2.0)) AS sigma FROM markers_true a)
    SELECT CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y, CAST(z + dz AS INT) AS z, round(max(exp(-(dx*dx+dy*dy+dz*dz) / (2 * sigma * sigma))), 6) AS target FROM w CROSS JOIN ("""
    + _cube_sql(1)
    + ") o WHERE sigma > 0 GROUP BY 1, 2, 3",
    ("markers_true",),
)
def joint_targets(spark, d):
    """Gaussians as wide as the nearest other marker allows, combined by their maximum (markers at one place have no width)."""
    m = _true(spark, d)
    sigma = learning.shrunk_sigma(m, 2.0, 16.0).where("sigma > 0")
    return learning.joint_targets(m, sigma, 1).select(*[F.col(a).cast("int").alias(a) for a in AXES], F.round("target", 6).alias("target"))


# ---- registration and regression

_MOMENTS = """m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(u) AS mu, avg(v) AS mv, avg(w) AS mw, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz,
 covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, covar_pop(z, u) AS zu, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv, covar_pop(z, v) AS zv, covar_pop(x, w) AS xw, covar_pop(y, w) AS yw, covar_pop(z, w) AS zw FROM pairs),
 c AS (SELECT *, yy*zz - yz*yz AS ixx, xz*yz - xy*zz AS ixy, xy*yz - xz*yy AS ixz, xx*zz - xz*xz AS iyy, xy*xz - xx*yz AS iyz, xx*yy - xy*xy AS izz, xx*(yy*zz - yz*yz) - xy*(xy*zz - yz*xz) + xz*(xy*yz - yy*xz) AS det FROM m),
 l AS (SELECT 0 AS row, mu AS mean, xu AS a, yu AS b, zu AS c, * EXCLUDE (row) FROM (SELECT 0 AS row, * FROM c) t UNION ALL SELECT 1, mv, xv, yv, zv, * EXCLUDE (row) FROM (SELECT 0 AS row, * FROM c) t UNION ALL SELECT 2, mw, xw, yw, zw, * EXCLUDE (row) FROM (SELECT 0 AS row, * FROM c) t),
 g AS (SELECT CAST(row AS INT) AS row, mean, mx, my, mz, (a*ixx + b*ixy + c*ixz) / det AS r0, (a*ixy + b*iyy + c*iyz) / det AS r1, (a*ixz + b*iyz + c*izz) / det AS r2 FROM l)
 SELECT row, round(r0, 5) + 0.0 AS r0, round(r1, 5) + 0.0 AS r1, round(r2, 5) + 0.0 AS r2, round(mean - r0*mx - r1*my - r2*mz, 4) + 0.0 AS t FROM g"""
#: Pairs that a motion takes exactly onto each other: the least-squares map of their moments is that motion.
_FIT = f"WITH pairs AS (SELECT a.id, a.x, a.y, a.z, b.x AS u, b.y AS v, b.z AS w FROM markers_true a JOIN markers_view_b b ON a.id = b.id), {_MOMENTS}"
_VIEWS = ["markers_true", "markers_view_b"]
ORACLE["rigid_from_pairs"] = with_views(_VIEWS, _FIT)
ORACLE["rigid_from_landmarks"] = with_views(_VIEWS, _FIT.replace("ON a.id = b.id", "ON a.id = b.id AND a.id % 5 <> 0"))


@query(_FIT, tuple(_VIEWS))
def arun_from_pairs(spark, d):
    return _motion(spark, *shape.arun(shape.moments(_view_pairs(spark, d)).first().asDict()))


@query()
def register_volumes(spark, d):
    """A volume moved by a little, brought back by mutual information: the shift found."""
    fixed = _voxels(spark, d)
    moving = fixed.select((F.col("x") + 1).alias("x"), "y", "z", "intensity")
    found = registration.register(fixed, moving, levels=((2, 12), (1, 12)))
    return spark.createDataFrame([(float(round(found.metric, 4)), *[float(round(v, 3)) for v in found.shift])], "metric double, x double, y double, z double")


@query(
    """WITH p AS (SELECT a.id, a.z AS z0, a.x AS x0, a.y AS y0, b.x, b.y, b.z, exp(-((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) / 900) AS w FROM markers_true a JOIN markers_true b ON a.id <> b.id AND exp(-((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) / 900) > 1e-4),
    m AS (SELECT id, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, sum(w*z)/sum(w) AS mz FROM p GROUP BY id),
    s AS (SELECT p.id, x0, y0, mx, my, mz, sum((x-mx)*(x-mx)) AS xx, sum((x-mx)*(y-my)) AS xy, sum((y-my)*(y-my)) AS yy, sum((x-mx)*(z-mz)) AS xz, sum((y-my)*(z-mz)) AS yz, count(*) AS n FROM p JOIN m ON p.id = m.id GROUP BY ALL)
    SELECT id, CAST(n AS BIGINT) AS n, round(mz + (x0-mx) * (xz*yy - yz*xy) / (xx*yy - xy*xy) + (y0-my) * (yz*xx - xz*xy) / (xx*yy - xy*xy), 4) AS z FROM s WHERE n > 2 AND xx*yy - xy*xy > 1""",
    ("markers_true",),
)
def lowess_pass(spark, d):
    """One pass of local regression of the markers' height over the plane, for all markers at once by moments."""
    return shape.local_plane(_true(spark, d), 30.0).select("id", "n", F.round("z", 4).alias("z"))


_ANGLE = "(id % 60) * 0.05 - 1.5"
_R = "SELECT id, cos({a}) AS c, sin({a}) AS s, x, y, z FROM markers_true".replace("{a}", _ANGLE)


@query(
    f"""WITH r AS ({_R})
    SELECT id, round(c, 6) + 0.0 AS r00, round(-s, 6) + 0.0 AS r01, round(s * c, 6) + 0.0 AS r10, round(-s, 6) + 0.0 AS r12, round(s * s, 6) + 0.0 AS r20, round(c, 6) + 0.0 AS r22,
      round(x, 4) AS tx, round(c * y - s * z, 4) AS ty, round(s * y + c * z, 4) AS tz FROM r""",
    ("markers_true",),
)
def composed_transforms(spark, d):
    """A turn about z and a shift, then a turn about x: one motion."""
    a = (F.col("id") % 60) * F.lit(0.05) - F.lit(1.5)
    zero, one = F.lit(0.0), F.lit(1.0)
    c, s = F.cos(a), F.sin(a)
    first = ((c, -s, zero), (s, c, zero), (zero, zero, one)), tuple(F.col(k) for k in AXES)
    second = ((one, zero, zero), (zero, c, -s), (zero, s, c)), (zero, zero, zero)
    r, t = registration.compose_columns(first, second)
    out = {"r00": r[0][0], "r01": r[0][1], "r10": r[1][0], "r12": r[1][2], "r20": r[2][0], "r22": r[2][2]}
    return _true(spark, d).select("id", *[(F.round(v, 6) + 0.0).alias(k) for k, v in out.items()], *[F.round(v, 4).alias(f"t{k}") for k, v in zip(AXES, t, strict=True)])
