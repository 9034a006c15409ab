"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A text is the set of its lower-cased words, each weighted by the square root of its count. Sample ``k`` gives every word
a step ``r`` and a scale ``c``, both Gamma(2, 1), and a phase ``b``, uniform, all from hashes of word and ``k``. A weight
``w`` is cut down to ``y = exp(r (t - b))`` with ``t = floor(ln w / r + b)``; the word with the least ``c / (y exp(r))``
is the sample, together with its ``t``. Two texts agree in a sample with a probability that equals their generalised
Jaccard similarity (sum of the smaller weights by sum of the larger), so the share of equal samples is its estimate.

A sample is kept as 32 bits of its hash. ``SAMPLES`` of them give the similarity to about a tenth.

``edited_likeness`` also fingerprints each text with its last third replaced by the beginning of the next text. Rows
are dealt in order of id to buckets of about ``BUCKET_BYTES`` of text; the first row of a bucket is also sent to the
bucket before, so every neighbour is at hand after one shuffle of the texts, and all else happens in these buckets:
word counts, samples (a word that both versions hold equally often is sampled once) and the neighbour's fingerprint.

Defined results: a null text counts as empty; texts without words have a fingerprint of their own, which is like itself
alone; ids go down, null ids come last (with the least long), rows of one id go by a hash of the text; the next of the
last row is the first, so a single row follows itself; rows with equal id and text are followed by each other, and where
they are very many (a 256th of all rows) they are computed as two. Extra columns are ignored. An empty table gives an
empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.llm.hot import SHARE

SPACE = r"[\x20\x09-\x0D]+"
SAMPLES = 24
#: Text of a bucket: what a task holds of word counts is some ten times as much.
BUCKET_BYTES = 8 << 20
_NONE = 0xFFFFFFFF


def _uniform(bits: Column, shift: int, n: int) -> Column:
    """``n`` bits of a hash as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << n) - 1)).cast("double") + F.lit(0.5)) * F.lit(2.0**-n)


def sample(word: Column, log_weight: Column, k: int) -> Column:
    """One long that is least for the word sampled: ``ln(c / (y exp(r)))`` in its upper half, the sample's hash in its lower."""
    first = F.xxhash64(word, F.lit(k))
    second = F.xxhash64(first)
    r = -F.log(_uniform(first, 0, 21) * _uniform(first, 21, 21))
    c = -F.log(_uniform(second, 0, 32) * _uniform(second, 32, 32))
    phase = _uniform(first, 42, 21)
    t = F.floor(log_weight / r + phase)
    # between -96 and 4 by the bits of the numbers it is made of
    height = F.log(c) - r * (t.cast("double") - phase + 1.0)
    place = ((height + 96.0) * F.lit(float(1 << 24))).cast("long")
    return F.shiftleft(place, 32).bitwiseOR(F.xxhash64(first, t).bitwiseAND(F.lit(_NONE)))


def _sampled(words: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """``keys, least``: the least sample of every k over rows ``keys, word, n``; null where no word counts."""
    least = words.groupBy(*keys).agg(*[F.min(sample(F.col("word"), F.log(F.sqrt("n")), k)).alias(f"s{k}") for k in range(samples)])
    return least.select(*keys, F.array(*[f"s{k}" for k in range(samples)]).alias("least"))


def _kept(least: Column) -> Column:
    """The 32 bits that stand for each sample."""
    return F.transform(least, lambda x: F.coalesce(x.bitwiseAND(F.lit(_NONE)), F.lit(_NONE)))


def hexed(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples in which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)).cast("double") / samples


def _words(text: Column) -> Column:
    return F.split(F.lower(text), SPACE)


def signatures(docs: DataFrame, text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``docs`` with ``signature``, an array of ``samples`` longs below 2**32, for use in joins and comparisons."""
    names = [f"_doc{k}" for k in range(len(docs.columns))]
    held = docs.toDF(*names).withColumn("row", F.monotonically_increasing_id())
    text = F.coalesce(F.col(names[docs.columns.index(text_col)]), F.lit(""))
    each = held.select("row", F.explode(_words(text)).alias("word"))
    counts = each.groupBy("row", F.xxhash64("word").alias("word")).agg(F.sum(F.when(F.col("word") != "", 1).otherwise(0)).alias("n"))
    found = _sampled(counts, ["row"], samples).select("row", _kept(F.col("least")).alias("_signature"))
    return held.join(found, "row").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], F.col("_signature").alias("signature"))


def _bucket(starts: list[tuple[int, int]]) -> Column:
    """The last bucket whose first key isn't above the row's, by bisection."""
    ids, digests = F.lit([s[0] for s in starts]), F.lit([s[1] for s in starts])
    steps = F.lit([1 << k for k in reversed(range((len(starts) - 1).bit_length()))]) if len(starts) > 1 else None

    def onward(at: Column, step: Column) -> Column:
        to = at + step
        first = F.get(ids, to)
        return F.when((first < F.col("place")) | ((first == F.col("place")) & (F.get(digests, to) <= F.col("digest"))), to).otherwise(at)

    return F.aggregate(steps, F.lit(0), onward) if steps is not None else F.lit(0)


def _in_order(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int) -> tuple[DataFrame, int] | None:
    """``bucket, extra, place, digest, id, text, copies``: rows dealt in order, the first of each bucket also behind the bucket before."""
    spark = docs.sparkSession
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    # ids go down: the complement turns the order without overflow
    place, digest = F.coalesce(F.bitwise_not(id_), F.lit((1 << 63) - 1)), F.xxhash64(text)
    keys = docs.select(place.alias("place"), digest.alias("digest"), F.octet_length(text).alias("bytes"))
    total, n_bytes = keys.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    if not total:
        return None
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / bucket_bytes))
    ranged = keys.select("place", "digest").repartitionByRange(n, "place", "digest")
    first = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("place", "digest")).alias("s")).select("s.*")
    starts = sorted((r[0], r[1]) for r in first.collect())
    rows = docs.select(place.alias("place"), digest.alias("digest"), F.col(id_col).alias("id"), text.alias("text"))
    many = [(r[0], r[1], r[2]) for r in keys.groupBy("place", "digest").count().where(F.col("count") > max(1, total // SHARE)).collect()]
    if many:
        hot = F.broadcast(spark.createDataFrame(many, "place long, digest long, n long"))
        # two of the copies: one that is followed by its like, as all but the last are, and the last
        two = rows.join(hot, ["place", "digest"]).groupBy("place", "digest", "id", "n").agg(F.max("text").alias("text"))
        two = two.withColumn("copies", F.explode(F.array(F.col("n") - 1, F.lit(1).cast("long")))).select(*rows.columns, "copies")
        rows = rows.join(hot.drop("n"), ["place", "digest"], "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(two)
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    rows = rows.select("*", F.explode(F.array(_bucket(starts))).alias("at"))
    first_of = (F.get(F.lit([s[0] for s in starts]), F.col("at")) == F.col("place")) & (F.get(F.lit([s[1] for s in starts]), F.col("at")) == F.col("digest"))
    here, before = F.struct(F.col("at").alias("bucket"), F.lit(0).alias("extra")), F.struct(((F.col("at") + len(starts) - 1) % len(starts)).alias("bucket"), F.lit(1).alias("extra"))
    dealt = rows.select(F.explode(F.when(first_of, F.array(here, before)).otherwise(F.array(here))).alias("to"), *rows.columns).select("to.*", *[c for c in rows.columns if c != "at"])
    return dealt, len(starts)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row."""
    dealt = _in_order(docs, id_col, text_col, bucket_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if dealt is None:
        return docs.sparkSession.createDataFrame([], schema)
    rows, buckets = dealt
    order = Window.partitionBy("bucket").orderBy("extra", "place", "digest", F.desc("copies"))
    rows = rows.repartitionById(buckets, "bucket").select("bucket", "extra", "id", "copies", "text", F.lead("text").over(order).alias("next"), F.row_number().over(order).alias("number"))
    n = F.char_length("text")
    cut = rows.withColumn("n_chars", n.cast("long")).withColumn("gone", F.floor(n / 3).cast("int"))
    head = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("gone"))
    # what both versions share ends before the word in which the text is cut
    part = F.char_length(F.regexp_extract(F.reverse("head"), r"^[^\x20\x09-\x0D]*", 0))
    cut = cut.select("*", F.explode(F.array(head)).alias("head")).withColumn("begin", F.substring(F.coalesce("next", F.lit("")), F.lit(1), F.col("gone")))
    cut = cut.select("*", F.explode(F.array(F.char_length("head") - part)).alias("whole"))
    both, word = F.substring("head", F.lit(1), F.col("whole")), F.substring("head", F.col("whole") + 1, F.char_length("head"))
    rest = F.substring("text", F.col("whole") + 1, F.char_length("text"))
    split = cut.select(
        "bucket", "number", "extra", "copies", "id", "n_chars", F.sha2(F.concat("head", "begin"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(_words(both).alias("both"), _words(rest).alias("own"), _words(F.concat(word, "begin")).alias("new")))).alias("w"),
    )
    keys = ["bucket", "number", "extra", "copies", "id", "n_chars", "edited_sha256"]
    sized = split.select(*keys, F.size("w.both").alias("b"), (F.size("w.both") + F.size("w.own")).alias("o"), F.concat("w.both", "w.own", "w.new").alias("words"))
    each = sized.select(*keys, "b", "o", F.posexplode("words").alias("pos", "word"))
    one = F.when(F.col("word") != "", 1).otherwise(0)
    counts = each.groupBy(*keys, F.xxhash64("word").alias("word")).agg(
        F.sum(F.when(F.col("pos") < F.col("o"), one).otherwise(0)).alias("own"), F.sum(F.when((F.col("pos") < F.col("b")) | (F.col("pos") >= F.col("o")), one).otherwise(0)).alias("new")
    )
    # version 3 is both, 1 the text as it is, 2 the edited text
    as_is, edited = (F.struct(F.col(c).alias("n"), F.lit(v).alias("version")) for c, v in (("own", 1), ("new", 2)))
    versions = F.when(F.col("own") == F.col("new"), F.array(F.struct(F.col("own").alias("n"), F.lit(3).alias("version")))).otherwise(F.array(as_is, edited))
    least = _sampled(counts.select(*keys, "word", F.explode(versions).alias("v")).select(*keys, "word", "v.*"), [*keys, "version"], samples)
    of = least.groupBy(*keys).agg(F.collect_list(F.struct("version", "least")).alias("all"))

    def lowest(version: int) -> Column:
        mine = F.transform(F.filter("all", lambda x: x["version"].bitwiseAND(F.lit(version)) != 0), lambda x: x["least"])
        none = F.array_repeat(F.lit(None).cast("long"), samples)
        return _kept(F.aggregate(mine, none, lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y))))

    signed = of.select(*keys, lowest(1).alias("signature"), lowest(2).alias("edited"))
    near = signed.withColumn("after", F.lead("signature").over(Window.partitionBy("bucket").orderBy("number"))).where("extra = 0")
    out = near.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", hexed(F.col("signature")).alias("fingerprint"), hexed(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited"), samples).alias("near_edited"), likeness(F.col("signature"), F.col("after"), samples).alias("near_next"), "copies",
    )
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("copies", "_copy")
