"""Volumes and point clouds derived from the star-schema tables by integer arithmetic, as SQL both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _at(k: str, a: int, b: int, m: int) -> str:
    return f"CAST(({k}*{a}+{k}*{k}*{b})%{m} AS DOUBLE)"


def _point(k: str) -> tuple[str, str, str]:
    return _at(k, 7919, 31, 509), _at(k, 104729, 17, 503), _at(k, 1299709, 13, 251)


_X, _Y, _Z = _point("p_partkey")
_SX, _SY, _SZ = _point("(s_suppkey+1000003)")

#: name -> (views it needs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "voxels": (
        (),
        """SELECT x, y, z, MAX(i) AS intensity FROM (SELECT CAST(l_orderkey%64 AS INT) AS x, CAST(l_partkey%64 AS INT) AS y,
        CAST((l_suppkey*7+l_linenumber)%32 AS INT) AS z, CAST((CAST(l_quantity AS INT)*5)%256 AS INT) AS i FROM lineitem) t GROUP BY x, y, z""",
    ),
    "markers_true": ((), f"SELECT p_partkey AS id, {_X} AS x, {_Y} AS y, {_Z} AS z, p_retailprice AS mass FROM part"),
    "markers_pred": (
        (),
        f"""SELECT p_partkey AS id, {_X}+((p_partkey*17)%13-6)*0.5 AS x, {_Y}+((p_partkey*29)%11-5)*0.5 AS y, {_Z}+((p_partkey*23)%9-4)*1.25 AS z, p_retailprice AS mass
        FROM part WHERE p_partkey%10<>0 UNION ALL SELECT 1000000+s_suppkey AS id, {_SX} AS x, {_SY} AS y, {_SZ} AS z, s_acctbal AS mass FROM supplier""",
    ),
    "markers_view_b": (("markers_true",), "SELECT id, 10-y AS x, x-4 AS y, z+3 AS z, mass FROM markers_true"),
    "volume_b": (("voxels",), "SELECT x, y, z, CAST((intensity*3+x)%256 AS INT) AS intensity FROM voxels"),
}


def _needs(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for x in [*_needs(list(VIEWS[name][0])), name]:
            if x not in out:
                out.append(x)
    return out


def with_views(names: list[str], body: str) -> str:
    """The SQL of a query over derived views, as one statement."""
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in _needs(names)]
    head = body.lstrip()
    if head.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {head[15:]}" if ctes else head
    if head.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {head[5:]}" if ctes else head
    return f"WITH {', '.join(ctes)} {head}" if ctes else head


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    sql = with_views(list(VIEWS[name][0]), VIEWS[name][1]) if VIEWS[name][0] else VIEWS[name][1]
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in used})
