"""N-gram Jaccard join with adaptive multi-match prefixes.

Every distinct shingle set is a class; copies count once.  The tokens of a class are put in one
global order, rare first, by a fixed-size count sketch over all documents.  Two sets of Jaccard
similarity t or more share at least l tokens among the first n - ceil(t n) + l of each, for any
l up to ceil(t n).  Each class picks its own l: the one with the least estimated cost, where a
longer prefix reads more postings but leaves fewer candidates, as each candidate needs l of them.
A pair is a candidate by the smaller l of its two classes.  Candidates are verified on whole sets.

Large groups of near copies would yield all their pairs.  So classes that share a min-hash with
many others are first compared with one central class of that group only; pairs inside the
components found so are left out of the join, as their link can't change any component.  All
other pairs still go through the join, which loses none.  A token that many classes of one such
component share meets only the classes outside it, so that the component's own pairs are never made.

A class is named by 128 bits of its set, so that at 10**11 classes a false merge has a probability
of about 10**-16.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import columns, guarded, ship, slices, table
from plumbline.llm.components import components
from plumbline.llm.shingles import digest, mix, shingle_sets

#: Buckets of the count sketch, whatever the size of the input.
SKETCH_BITS = 18
#: Longest multi-match prefix, and the cost of verifying a candidate against reading a posting.
MAX_MATCHES, VERIFY_COST = 16, 20.0
#: Min-hashes of a class; how many of them find large groups; the size from which a group is large;
#: how many must agree before a class is compared with a group's centre.
BANDS, KEYS, LARGE_GROUP, AGREE = 12, 3, 16, 8


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _profile(width: int, id_type: pa.DataType):
    """(id, hash, n, cls, bucket, uses): a row for each document and one for each sketch bucket in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches):
            sets = shingle_sets(batch.column(2).to_pylist(), width)
            n = len(sets)
            full = [h for h in sets if h.size]
            if full:
                uses += np.bincount(_bucket(np.concatenate(full)), minlength=1 << SKETCH_BITS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h.size for h in sets], pa.int64()), pa.array([digest(h) if h.size else None for h in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())],
                names=["_id", "_hash", "n", "cls", "bucket", "uses"],
            )
        used = np.flatnonzero(uses)
        for at in range(0, used.size, 1 << 16):
            own = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(own.size, id_type), pa.nulls(own.size, pa.int64()), pa.nulls(own.size, pa.int64()), pa.nulls(own.size, pa.binary()), pa.array(own, pa.int32()), pa.array(uses[own])],
                names=["_id", "_hash", "n", "cls", "bucket", "uses"],
            )

    return run


def matches(extra: np.ndarray, must: int, alike: int) -> int:
    """The number of shared tokens to ask for.

    extra[i] estimates the other postings of token i.  A pair of equal sizes needs ``alike`` common
    tokens, so only the first n - alike + k places can hold the k-th shared one of a good pair.
    Reading costs a posting each; a candidate, which uses up k of them, costs VERIFY_COST.
    """
    most = np.arange(1, max(1, min(MAX_MATCHES, must)) + 1)
    read = np.cumsum(extra)[extra.size - alike + most - 1]
    return 1 + int(np.argmin(read * (1 + VERIFY_COST / most)))


def _prefixes(width: int, num: int, den: int, sketch):
    """(cls, n, l, tokens, weight, bands) of each document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = sketch.value
        noise = float(uses.mean())
        doubt = noise**0.5  # what the sketch can't tell from noise
        seeds = [np.uint64(0x5851F42D4C957F2D * (j + 1) % 2**64) for j in range(BANDS)]
        for batch in slices(batches):
            rows = []
            for h in shingle_sets(batch.column(0).to_pylist(), width):
                if not h.size:
                    continue
                n = h.size
                must = -(-num * n // den)
                df = uses[_bucket(h)]
                order = np.lexsort((h, df))
                df = df[order]
                k = matches(np.maximum(df - noise, 0.0) + doubt, must, -(-2 * num * n // (num + den)))
                p = n - must + k
                rows.append((digest(h), n, k, h[order[:p]].view(np.int64), float(df[:p].mean()), [int(mix(h ^ s).min().view(np.int64)) for s in seeds]))
            if rows:
                c = list(zip(*rows))
                tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c[3])]), pa.int32()), pa.array(np.concatenate(c[3])))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), tokens, pa.array(c[4], pa.float64()), pa.array(c[5], pa.list_(pa.int64()))], names=["cls", "n", "l", "tokens", "weight", "bands"])

    return run


def _sets(width: int):
    """(cls, set) of each class once a task; a text of another class under the same id is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            own = []
            for c, h in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), width)):
                if c not in seen and digest(h) == c:
                    seen.add(c)
                    own.append((c, h.view(np.int64)))
            for at in range(0, len(own), 1000):
                c, h = zip(*own[at : at + 1000])
                sets = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, h)]), pa.int32()), pa.array(np.concatenate(h)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), sets], names=["cls", "set"])

    return run


def _met(left: DataFrame, right: DataFrame, when: Column, num: int, den: int) -> DataFrame:
    """(a, b, l): a row for each token that classes of different labels share within their prefixes for l matches."""
    x, y = left.alias("x"), right.alias("y")
    l = F.least("x.l", "y.l")
    least = F.ceil(F.lit(num) * (F.col("x.n") + F.col("y.n")) / F.lit(num + den))
    reach = lambda s: F.col(f"{s}.pos") < F.col(f"{s}.n") - F.ceil(F.lit(num) * F.col(f"{s}.n") / F.lit(den)) + l
    meet = (
        (F.col("x.token") == F.col("y.token"))
        & when
        & (F.col("x.label") != F.col("y.label"))
        & (F.lit(den) * F.least("x.n", "y.n") >= F.lit(num) * F.greatest("x.n", "y.n"))
        & reach("x")
        & reach("y")
        & (l + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) - 1 >= least)
    )
    return x.join(y, meet).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"), l.alias("l"))


def _verified(pairs: DataFrame, rows: DataFrame, firsts: DataFrame, width: int, num: int, den: int, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar enough."""
    pairs = table(pairs, f"{name}-pairs")
    ids = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct().join(firsts, "cls").select("cls", F.col("first.id").alias("first_id"), F.col("first.hash").alias("first_hash"))
    ids = table(ids, f"{name}-ids")
    texts = rows.join(guarded(ids), (rows["_hash"] == ids["first_hash"]) & rows["_id"].eqNullSafe(ids["first_id"])).select("cls", "_text")
    sets = table(texts.mapInArrow(_sets(width), "cls binary, set array<long>").dropDuplicates(["cls"]), f"{name}-sets")
    side = lambda k: sets.select(F.col("cls").alias(k), F.col("set").alias(f"set_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")).cast("long"))
    good = F.lit(den) * F.col("common") >= F.lit(num) * (F.size("set_a") + F.size("set_b") - F.col("common"))
    return table(both.where(good).select("a", "b"), f"{name}-links")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``.

    Documents whose shingle sets have a Jaccard similarity of ``threshold`` (a fraction of two
    whole numbers) or more are linked; ``component_id`` is the smallest id reachable by links.
    Null and empty texts, and texts without words, have no shingles and are linked with nothing.
    Repeated rows are copies of each other.  Rows with a null id keep it, have the component of
    the rows they are linked with, and never give a component its id: it is null if no linked row
    has one.  Two rows with one id and different texts are two documents, each with its component.
    Further columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    num, den = threshold
    rows = columns(docs, id_col, text_col).select("_id", F.xxhash64("_text").alias("_hash"), "_text")
    id_type = rows.schema["_id"].dataType
    schema = T.StructType([T.StructField("_id", id_type), T.StructField("_hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("bucket", T.IntegerType()), T.StructField("uses", T.LongType())])
    seen = table(rows.mapInArrow(_profile(width, to_arrow_type(id_type)), schema), "profile")
    members = seen.where("bucket is null").select("_id", "_hash", "n", "cls")
    uses = np.zeros(1 << SKETCH_BITS, np.int64)
    counted = seen.where("bucket is not null").groupBy("bucket").agg(F.sum("uses").alias("uses")).toPandas()  # 2**SKETCH_BITS rows at most
    uses[counted["bucket"].to_numpy()] = counted["uses"].to_numpy()
    sketch = spark.sparkContext.broadcast(uses)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash")))  # one row, by id and text
    firsts = table(members.where("cls is not null").groupBy("cls").agg(first.alias("first")), "classes")

    classes = rows.select("_text").mapInArrow(_prefixes(width, num, den, sketch), "cls binary, n long, l int, tokens array<long>, weight double, bands array<long>")
    classes = table(classes.dropDuplicates(["cls"]), "prefixes")
    keyed = classes.select("cls", "weight", "bands", F.posexplode(F.slice("bands", 1, KEYS)).alias("band", "key"))
    centres = keyed.groupBy("band", "key").agg(F.count("*").alias("size"), F.max(F.struct("weight", "cls", "bands")).alias("centre")).where(F.col("size") > LARGE_GROUP)
    alike = F.aggregate(F.zip_with("bands", "centre.bands", lambda p, q: (p == q).cast("int")), F.lit(0), lambda p, q: p + q)
    centres = table(centres, "centres")  # of large groups only
    stars = keyed.join(guarded(centres), ["band", "key"]).where((F.col("cls") != F.col("centre.cls")) & (alike >= AGREE))
    stars = stars.select(F.least("cls", "centre.cls").alias("a"), F.greatest("cls", "centre.cls").alias("b")).distinct()
    stars = _verified(stars, rows, firsts, width, num, den, "star")
    labels = components(stars)
    n_labels = labels.count()
    labelled = classes.join(guarded(labels.withColumnRenamed("node", "cls"), n_labels), "cls", "left").withColumn("label", F.coalesce("label", "cls")) if n_labels else classes.withColumn("label", F.col("cls"))
    postings = labelled.select("cls", "n", "l", "label", F.posexplode("tokens").alias("pos", "token"))
    heavy = postings.groupBy("token", "label").agg(F.count("*").alias("size")).where(F.col("size") > LARGE_GROUP).select("token", "label")
    heavy = table(heavy, "heavy")
    if n_labels and not heavy.isEmpty():
        marked = postings.join(heavy.withColumn("heavy", F.lit(True)), ["token", "label"], "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
        light, crowd = marked.where("not heavy"), marked.where("heavy")
        aimed = marked.join(heavy.withColumnRenamed("label", "aim"), "token").where(F.col("label") != F.col("aim"))
        outside = (F.col("x.label") == F.col("y.aim")) & (~F.col("y.heavy") | (F.col("x.cls") < F.col("y.cls")))
        met = _met(light, light, F.col("x.cls") < F.col("y.cls"), num, den).union(_met(crowd, aimed, outside, num, den))
    else:
        met = _met(postings, postings, F.col("x.cls") < F.col("y.cls"), num, den)
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("l").alias("l")).where("shared >= l").select("a", "b")
    links = _verified(pairs, rows, firsts, width, num, den, "pair")
    found = components(stars.union(links)).withColumnRenamed("node", "cls")
    named = table(firsts.join(found, "cls", "left").select("cls", F.col("first.id").alias("first_id"), F.coalesce("label", "cls").alias("label")), "labels")
    least_id = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    final = named.join(least_id, "label").select("cls", "component_id")
    return members.join(final, "cls", "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))
