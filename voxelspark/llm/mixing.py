"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

The mix has as many words as all documents together. Each source is due its weight's share; a source
whose share exceeds ``max_epochs`` times its own words is clamped there and the excess is reshared by
weight among the rest, until none is above. That fixed point is a water level: in order of words a unit
of weight, the clamped sources are a prefix, so two running sums over the sources find it.

A source is then repeated ``floor(target / words)`` times whole; the fraction left is sampled: documents
in order of a seeded hash of their id, as long as they fit, then again (``FILL_ROUNDS`` times in all)
those small enough for what is left. A round is one threshold a source, found level by level: sums over
sixteen hash buckets a source show the one where the running sum crosses, the next level looks into that
one alone, until it holds about ``FEW`` rows of the largest source; so no task ever holds a source, and
only tables of a row a source and bucket are ordered.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source is a source of its
own, last in order; rows that share an id are taken or left together; a source without words gets target
0; empty tables give empty results; extra columns are ignored by ``plan`` and kept by ``draw``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.llm.storage import cut, table

#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"
SEED, MAX_EPOCHS, FILL_ROUNDS = "mix-1", 3, 3
#: Rows of a bucket that are put in order one by one.
FEW = 1000
#: Greater than every hexadecimal string.
ALL = "g"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_of(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """A row for each source: ``source, source_size, target`` by the water level."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # a source is clamped if, with all before it clamped, its share would exceed its cap
    marked = capped.withColumn("clamped", F.col("cap") < level * F.col("weight"))
    left = F.sum("source_size").over(everything) - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(left.cast("double") / free * F.col("weight"))
    return marked.withColumn("target", target).select("source", "source_size", "target")


def _threshold(rows: DataFrame, budget: DataFrame, k: int, levels: int) -> DataFrame:
    """For each source of ``budget(source, room)`` the largest hash whose running sum of sizes stays within room.

    Gives ``source, upto{k}, room{k}`` (what is left after it).
    """
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    start = lambda n: F.substring("h", 1, n)
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    crossing = budget.select("source", F.lit("").alias("bucket"), F.lit(0).cast("long").alias("before"), "room")
    for level in range(1, levels + 1):
        # sixteen buckets at most of each source: those inside the bucket where its sum crosses
        inner = rows.withColumn("in", start(level - 1)).alias("r").join(crossing.alias("c"), same("r", "c") & (F.col("r.in") == F.col("c.bucket"))) if level > 1 else rows.alias("r").join(crossing.alias("c"), same("r", "c"))
        sums = inner.groupBy("c.source", "before", "room", start(level).alias("bucket")).agg(F.sum("size").alias("words"))
        sums = sums.withColumn("at", F.col("before") + F.coalesce(F.sum("words").over(running), F.lit(0)))
        crossing = cut(sums.where((F.col("at") <= F.col("room")) & (F.col("at") + F.col("words") > F.col("room"))).select("source", "bucket", F.col("at").alias("before"), "room"))
    inside = (
        rows.withColumn("bucket", start(levels)).alias("r").join(crossing.alias("c"), same("r", "c") & (F.col("r.bucket") == F.col("c.bucket")))
        .select("c.source", "c.bucket", "before", "room", "h", "size")
        .withColumn("sum", F.col("before") + F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        .where(F.col("sum") <= F.col("room")).groupBy("source").agg(F.max("h").alias("h"), F.max("sum").alias("sum"))
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("all"))
    return (
        budget.alias("b").join(crossing.alias("c"), same("b", "c"), "left").join(inside.alias("i"), same("b", "i"), "left").join(totals.alias("t"), same("b", "t"), "left")
        .select(
            "b.source",
            F.coalesce(F.col("i.h"), F.col("c.bucket"), F.lit(ALL)).alias(f"upto{k}"),
            (F.col("b.room") - F.coalesce(F.col("i.sum"), F.col("c.before"), F.col("t.all"), F.lit(0))).alias(f"room{k}"),
        )
    )


def _extra(rounds: int) -> Column:
    """Whether a row is in the fractional sample, from its source's thresholds."""
    taken = F.col("h") <= F.col("upto1")
    for k in range(2, rounds + 1):
        taken = taken | ((F.col("size") <= F.col(f"room{k - 1}")) & (F.col("h") <= F.col(f"upto{k}")))
    return taken


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(sizes, sources): ``id, source, size, h`` of each row; of each source its size, target, whole repetitions and thresholds."""
    sizes = table(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), order_of(id_col, seed).alias("h")), "mix-sizes")
    sources = targets(sizes, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("room0", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    sources = cut(sources)
    rows_of_largest = sizes.groupBy("source").count().agg(F.max("count")).first()[0] or 1
    levels = max(1, math.ceil(math.log(max(1.0, rows_of_largest / FEW), 16)))
    for k in range(1, FILL_ROUNDS + 1):
        rows = sizes.where("size > 0")
        if k > 1:
            rows = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", *[f"s.{c}" for c in sources.columns if c != "source"])
            rows = rows.where(~_extra(k - 1) & (F.col("size") <= F.col(f"room{k - 1}"))).select("source", "size", "h")
        found = _threshold(rows, sources.select("source", F.col(f"room{k - 1}").alias("room")), k, levels)
        sources = cut(sources.alias("s").join(found.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source"))).select("s.*", f"upto{k}", f"room{k}"))
    return sizes, sources


def _copies() -> Column:
    return F.col("whole") + _extra(FILL_ROUNDS).cast("long")


def takings(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row."""
    sizes, sources = plan(docs, **options)
    both = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return both.select(F.col("id").alias(options.get("id_col", "doc_id")), "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def draw(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, **options) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken, with its columns."""
    _, sources = plan(docs, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed, **options)
    names = [f"_mix{k}" for k in range(len(docs.columns))]
    held = docs.toDF(*names)
    at = {c: names[docs.columns.index(c)] for c in (id_col, source_col, text_col)}
    held = held.withColumn("size", size_of(at[text_col])).withColumn("h", order_of(at[id_col], seed))
    both = held.join(sources, F.col(at[source_col]).eqNullSafe(F.col("source")))
    repeated = both.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.when(F.col("size") > 0, _copies()).otherwise(0).cast("int"))))
    return repeated.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM r),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
             / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
      FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, cap < level * weight AS clamped FROM l),
t AS (SELECT source, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE
        CAST(sum(source_size) OVER () - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS DOUBLE)
        / CAST(sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () AS DOUBLE) * weight END AS target FROM m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(0.0, target - whole * source_size) AS room0 FROM p),
e0 AS (SELECT d.doc_id, d.size, d.h, q.* FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
e1 AS (SELECT *, size > 0 AND sum(size) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= room0 AS in1 FROM e0),
f1 AS (SELECT *, room0 - sum(CASE WHEN in1 THEN size ELSE 0 END) OVER (PARTITION BY source) AS room1 FROM e1),
e2 AS (SELECT *, NOT in1 AND size > 0 AND size <= room1 AND sum(CASE WHEN NOT in1 AND size <= room1 THEN size ELSE 0 END)
        OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= room1 AS in2 FROM f1),
f2 AS (SELECT *, room1 - sum(CASE WHEN in2 THEN size ELSE 0 END) OVER (PARTITION BY source) AS room2 FROM e2),
e3 AS (SELECT *, NOT in1 AND NOT in2 AND size > 0 AND size <= room2 AND sum(CASE WHEN NOT in1 AND NOT in2 AND size <= room2 THEN size ELSE 0 END)
        OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= room2 AS in3 FROM f2)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN in1 OR in2 OR in3 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM e3
"""
