"""Lloyd's clustering in whole numbers, by differences: each round looks only at what has changed.

Vectors are packed once into blocks, in a table bucketed by block; what each vector's owner is, and how far, is a second,
much smaller table with the same buckets, written anew each round, so that the two meet without a shuffle. A centroid that
didn't move is no nearer to anything than it was: a vector whose owner stood still is compared with the centroids that
moved alone, and only one whose owner moved with all. Vectors that change owner are subtracted from the old one's sums and
added to the new one's; a task sums these transfers, and the k sums themselves are kept on the driver, whose size is that
of the parameters k and ``dim``. All numbers are exact, so the result doesn't depend on the order of work.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, mapped, own_folder, slices, written

#: Vectors of one block.
BLOCK = 512
#: Blocks that a bucket is to have, and the most buckets of a table.
BLOCKS_OF_BUCKET, BUCKETS = 16, 50_000
#: A vector with a component of this size or more is left out: its distances would fit no long.
LIMIT = float(1 << 30)
LONGEST = (1 << 63) - 1


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` components, none null or non-finite, or of LIMIT and more."""
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LIMIT) & ~F.isnan(x.cast("double"))), F.lit(False))


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(vectors * scale).astype(np.int64)


def narrow(numbers: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest type that holds them."""
    top = int(np.abs(numbers).max(initial=0))
    return numbers.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid: in doubles while these are exact, in longs while these suffice, else in Python's integers."""
    top = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)), 1)
    dim = vectors.shape[1]
    if 4 * dim * top * top < 1 << 53:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] + (c * c).sum(1) - 2 * (v @ c.T)).astype(np.int64)
    kind = np.int64 if 4 * dim * top * top < 1 << 63 else object
    v = vectors.astype(kind)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids.astype(kind)], 1)


def nearest(vectors: np.ndarray, centroids: np.ndarray, moved: np.ndarray, owner: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) anew: ``moved`` says of each centroid whether it did; an owner of -1 is none yet. Of equally near ones the smallest number counts."""
    owner, far = owner.copy(), far.copy()
    free = (owner < 0) | moved[owner]
    if vectors.dtype == object or not free.all() and int(far[~free].max(initial=0)) == LONGEST:
        free[:] = True
    if free.any():
        d = distances(vectors[free], centroids)
        owner[free] = best = d.argmin(1)
        far[free] = np.minimum(d[np.arange(len(d)), best], LONGEST).astype(np.int64)
    at, others = np.flatnonzero(~free), np.flatnonzero(moved)
    if len(at) and len(others):
        d = distances(vectors[at], centroids[others])
        best = d.argmin(1)
        d, best = d[np.arange(len(d)), best], others[best]
        nearer = (d < far[at]) | ((d == far[at]) & (best < owner[at]))
        owner[at[nearer]], far[at[nearer]] = best[nearer], d[nearer]
    return owner, far


_PACKED = "block long, ids array<{}>, kind string, vectors binary"
_STATE = "block long, owner binary, far binary, cluster int, members long, sums array<decimal(38,0)>"
_STATE_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
_STATE_NAMES = ["block", "owner", "far", "cluster", "members", "sums"]


def packed(df: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """Blocks of whole-number vectors, with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in slices(batch, BLOCK):
                given = rows.column(1)
                rows = rows.filter(pc.fill_null(pc.equal(pc.list_value_length(given), dim), False))
                x = rows.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
                fits = (np.abs(x) < LIMIT).all(1)  # false for null and non-finite components too
                if fits.any():
                    found = narrow(whole(x[fits], scale))
                    ids = rows.column(0).filter(pa.array(fits))
                    yield pa.record_batch([pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([found.dtype.str]), pa.array([found.tobytes()], pa.binary())], ["block", "ids", "kind", "vectors"])
                    block += 1

    rows = df.select(df[key].alias("key"), df[vector].alias("vector"))
    return mapped(rows, run, _PACKED.format(rows.schema["key"].dataType.simpleString()))


def bucketed(df: DataFrame, label: str, buckets: int) -> DataFrame:
    """df as a Parquet table in the shared folder, bucketed by block."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{own_folder(spark)}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    found = spark.table(name)
    found.written_to, found.named = path, name
    return found


def released(*tables: DataFrame | None) -> None:
    for df in tables:
        if df is not None:
            df.sparkSession.sql(f"drop table if exists {df.named}")
            dropped(df)


def assigned(blocks: DataFrame, state: DataFrame | None, centroids: list[list[int]], moved: list[bool]) -> DataFrame:
    """The next state: for each block its vectors' owners and distances, and for each task, with a null block, what went to each cluster and came from it."""
    if state is None:
        rows = blocks.select("block", "kind", "vectors", F.lit(None).cast("binary").alias("owner"), F.lit(None).cast("binary").alias("far"))
    else:
        rows = blocks.select("block", "kind", "vectors").join(state.where("block is not null").select("block", "owner", "far"), "block")
    dim = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, has_moved = np.array(centroids, np.int64), np.array(moved, bool)
        transfers: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for row in slices(batch, 1):
                block, kind, data, owner, far = (row.column(n)[0].as_py() for n in range(5))
                vectors = np.frombuffer(data, kind).astype(np.int64).reshape(-1, dim)
                owner = np.full(len(vectors), -1, "<i4") if owner is None else np.frombuffer(owner, "<i4")
                far = np.zeros(len(vectors), "<i8") if far is None else np.frombuffer(far, "<i8")
                new, far = nearest(vectors, at, has_moved, owner, far)
                for sign, side in ((1, new), (-1, owner)):
                    left = (new != owner) & (side >= 0)
                    for c in np.unique(side[left]).tolist():
                        own = vectors[left & (side == c)]
                        n, sums = transfers.get(c, (0, [0] * dim))
                        transfers[c] = n + sign * len(own), [a + sign * b for a, b in zip(sums, own.sum(0).tolist())]
                yield pa.record_batch([pa.array([x], kind) for x, kind in zip((block, new.astype("<i4").tobytes(), far.astype("<i8").tobytes(), None, None, None), _STATE_TYPES)], _STATE_NAMES)
        for c, (n, sums) in transfers.items():
            yield pa.record_batch([pa.array([x], kind) for x, kind in zip((None, None, None, c, n, list(map(Decimal, sums))), _STATE_TYPES)], _STATE_NAMES)

    return mapped(rows, run, _STATE)


def transferred(state: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    """Adds a round's transfers to the global sums: at most k x dim numbers come to the driver."""
    moves = state.where("block is null").select("cluster", "members", "sums")
    for r in moves.groupBy("cluster").agg(F.sum("members").alias("n")).collect():
        counts[r["cluster"]] += int(r["n"])
    for r in moves.select("cluster", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("part").alias("total")).collect():
        sums[r["cluster"]][r["place"]] += int(r["total"])


def seeds(df: DataFrame, key: str, vector: str, k: int, dim: int, scale: int, salt: str) -> list[list[int]]:
    """The k vectors whose ids have the smallest digests with the salt, in that order; of repeated ids the smaller vector comes first."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = df.select(df[key].alias("key"), df[vector].alias("vector"))
    least = rows.where(usable(F.col("vector"), dim)).select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(k).collect()
    return [whole(np.array(r["vector"], np.float64), scale).tolist() for r in least]


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3", key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((key, cluster int, distance long), centroids): vectors, as floor(scale * component), after so many rounds.

    Centroids start as the vectors whose ids have the smallest digests. Each round assigns every vector to the nearest (of
    equal ones, the smaller number), and each centroid that has vectors becomes the floor of their mean; then vectors are
    assigned once more. Rounds end early where no centroid moves any more, which changes nothing.
    Vectors that are null, of another length, or with a null, non-finite or out-of-range component (2^30 and more) are left
    out; repeated rows and null keys are vectors like others (a null key counts as no text in digests); fewer vectors than k give fewer centroids, and no vectors no rows.
    A distance beyond a long is given as the largest long. Other columns are left out, so their names can't clash.
    """
    key_type = df.schema[key].dataType.simpleString()
    centroids = seeds(df, key, vector, k, dim, scale, salt)
    if not centroids:
        return df.sparkSession.createDataFrame([], f"key {key_type}, cluster int, distance long").withColumnRenamed("key", key), []
    plain = written(packed(df, key, vector, dim, scale), "lloyd-blocks")
    buckets = min(BUCKETS, max(1, -(-plain.count() // BLOCKS_OF_BUCKET)))
    blocks = bucketed(plain.repartition(buckets, "block"), "lloyd_blocks", buckets)
    dropped(plain)
    state, moved, sums, counts = None, [True] * len(centroids), [[0] * dim for _ in centroids], [0] * len(centroids)
    for turn in range(rounds + 1):
        last, state = state, bucketed(assigned(blocks, state, centroids, moved), "lloyd_state", buckets)
        released(last)
        if turn == rounds:
            break
        transferred(state, sums, counts)
        new = [[s // n for s in of] if n else old for of, n, old in zip(sums, counts, centroids)]
        moved, centroids = [a != b for a, b in zip(new, centroids)], new
        if not any(moved):
            break

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in slices(batch, 1):
                ids, owner, far = row.column(0).flatten(), row.column(1)[0].as_py(), row.column(2)[0].as_py()
                yield pa.record_batch([ids, pa.array(np.frombuffer(owner, "<i4")), pa.array(np.frombuffer(far, "<i8"))], ["key", "cluster", "distance"])

    joined = blocks.select("block", "ids").join(state.where("block is not null").select("block", "owner", "far"), "block")
    found = written(mapped(joined.select("ids", "owner", "far"), rows, f"key {key_type}, cluster int, distance long"), "lloyd")
    released(blocks, state)
    return found.withColumnRenamed("key", key), centroids


def described(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """found with cluster_inertia, inertia (distances summed; at most the largest long) and centroid_sha256, from a row for each cluster."""
    totals = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    every = min(sum(totals.values()), LONGEST)
    rows = [(c, min(totals.get(c, 0), LONGEST), every, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    of = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select(found.columns + of.columns[1:])  # k rows, a parameter
