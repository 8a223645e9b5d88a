"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors are turned by one random rotation and dealt to the list of their nearest centroid.  A query first searches its own
list, and takes the distance of its k-th best there along to the other lists it visits.  Lists are read in blocks of
columns, and after each block a hypothesis test on the partial distance abandons the candidates that can hardly come under the
query's k-th best so far.  What survives is measured on the original vectors in double precision.

Centroids are fitted on a bounded sample; every vector is indexed.  A long list is dealt over tiles by a hash of the id, so a
vector that very many rows share does not fill one task, and the queries of a list that many visit are dealt over copies of it.

Defined results: vectors that are null, all zero, hold null or non-finite components, or have not the table's most frequent
length take no part; rows that repeat an id are candidates of their own, but not of a query with that id; ties go to the
smaller id; queries with no candidate have no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersely.llm.common import cut, partitions, table, whole_groups

#: Rows of a list on average, lists at most, sampled rows for each list, share of the lists that a query visits, rows of a tile,
#: queries of a tile.  The share suits vectors without clusters, the hardest case; clustered ones need far less for the same recall.
LIST, LISTS, SAMPLE, PROBES, TILE, ASKING = 1000, 4096, 32, 0.7, 8192, 4096
#: Columns of a block, rows of the first and the largest step, queries that are read together, and the strictness of the
#: test: the higher, the fewer wrong rejections.
BLOCK, FIRST, STEP, TOGETHER, EPSILON = 16, 16, 1024, 256, 2.5


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray  # of rotated vectors
    counts: np.ndarray  # rows of each list


def usable(vector: Column, size: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == size) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(1)
        values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
        step = len(values) // max(len(rows), 1)
        yield pa.record_batch({"vec_id": batch.column(0), "v": pa.array([values[i * step : (i + 1) * step] for i in range(len(rows))], pa.binary())})


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, v`` (doubles as bytes) of the usable rows, and their length."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    most = rows.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = most["d"] if most else 1
    return rows.where(usable(F.col("v"), size)).mapInArrow(_packed, "vec_id long, v binary"), size


def _means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of ``x`` by Lloyd's rounds; an empty list takes the farthest row."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near, far = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    square = (c * c).sum(axis=1)
    for a in range(0, len(x), 1024):
        d = square - 2 * x[a : a + 1024] @ c.T
        near[a : a + 1024] = d.argmin(axis=1)
        far[a : a + 1024] = d.min(axis=1) + (x[a : a + 1024] ** 2).sum(axis=1)
    return near, far


def build(rows: DataFrame, size: int, total: int, list_rows: int = LIST) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and centroids, from a sample of at most about ``SAMPLE * LISTS`` rows chosen by a hash of their id."""
    k = max(1, min(LISTS, -(-total // list_rows)))
    part = min(1.0, max(SAMPLE * k, 2000) / max(total, 1))
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < F.lit(int(part * 1_000_003) + 1)).orderBy("vec_id", "v").select("v").limit(SAMPLE * LISTS).collect()
    rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((size, size)))[0]
    x = np.unique(np.array([np.frombuffer(r["v"], np.float64) for r in some]).reshape(-1, size), axis=0) @ rotation
    return rotation, _means(x, min(k, len(x))) if len(x) else np.zeros((1, size))


def _assign(batches: Iterable[pa.RecordBatch], rotation: np.ndarray, centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            near, _ = _nearest(_matrix(batch.column(1), len(rotation)) @ rotation, centroids)
            yield pa.record_batch({"vec_id": batch.column(0), "v": batch.column(1), "list": pa.array(near.astype(np.int32))})


VISIT = "vec_id long, v binary, top double, list int, nth int"


def _counts(df: DataFrame, lists: int) -> np.ndarray:
    """Rows of each list; at most ``LISTS`` numbers."""
    out = np.zeros(lists, np.int64)
    for r in df.groupBy("list").count().collect():
        out[r["list"]] = r["count"]
    return out


def _route(batches: Iterable[pa.RecordBatch], index: Index, probes: int, least: int) -> Iterator[pa.RecordBatch]:
    """Each query (``vec_id, v, top``) once for each of its nearest lists: ``probes``, and more until they hold ``least`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(1), len(index.rotation)) @ index.rotation
        order = np.argsort((index.centroids**2).sum(axis=1) - 2 * x @ index.centroids.T, axis=1, kind="stable")
        n = np.maximum(probes, (np.cumsum(index.counts[order], axis=1) < least).sum(axis=1) + 1).clip(max=order.shape[1])
        row = np.repeat(np.arange(len(x)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = pa.array(row)
        yield pa.record_batch({"vec_id": batch.column(0).take(at), "v": batch.column(1).take(at), "top": batch.column(2).take(at), "list": pa.array(order[row, nth].astype(np.int32)), "nth": pa.array(nth.astype(np.int32))})


@dataclass
class Tile:
    """Rows of a list, turned, as blocks of columns with their squared lengths."""

    ids: np.ndarray
    blocks: list[np.ndarray]
    norms: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, turned: np.ndarray, block: int = BLOCK) -> Tile:
        blocks = [np.ascontiguousarray(turned[:, c : c + block]) for c in range(0, turned.shape[1], block)]
        return cls(ids, blocks, (blocks[0] ** 2).sum(axis=1))


def scan(ids: np.ndarray, turned: np.ndarray, top: np.ndarray, tile: Tile, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, row) that may be among a query's ``k`` nearest, and how many (row, block) products were worked out.

    ``top``: squared distances that are known to be reached by ``k`` others.  Rows are read in growing steps, so the first ones soon
    give a query without such a distance its own.
    """
    block, size, n = tile.blocks[0].shape[1], turned.shape[1], len(tile.ids)
    asked = [np.ascontiguousarray(turned[:, c : c + block]) for c in range(0, size, block)]
    norm = (asked[0] ** 2).sum(axis=1)
    limit, work, a, step = top.astype(np.float64), 0, 0, FIRST
    query, row, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # scaled to all columns, a true neighbour's partial distance hardly exceeds the limit by more than this; partial distances only grow,
    # so one over the limit itself is out for sure
    bound = lambda limit, d: limit * min((1 + epsilon / np.sqrt(d)) ** 2 * d / size, 1 + 1e-9)
    while a < n:
        b = min(a + step, n)
        part = tile.norms[a:b, None] - 2 * tile.blocks[0][a:b] @ asked[0].T + norm
        work += part.size
        r, q = np.nonzero((part <= bound(limit, min(block, size)) + 1e-9 * norm) & (tile.ids[a:b, None] != ids))
        r += a
        d = ((tile.blocks[0][r] - asked[0][q]) ** 2).sum(axis=1)
        for c in range(1, len(asked)):
            d = d + ((tile.blocks[c][r] - asked[c][q]) ** 2).sum(axis=1)
            work += len(r)
            stay = d <= bound(limit[q], min((c + 1) * block, size))
            r, q, d = r[stay], q[stay], d[stay]
        query, row, far = np.concatenate((query, q)), np.concatenate((row, r)), np.concatenate((far, d))
        order = np.lexsort((far, query))
        query, row, far = query[order], row[order], far[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        full = nth == k - 1
        limit[query[full]] = np.minimum(limit[query[full]], far[full])
        stay = far <= limit[query] * (1 + 1e-9)  # those as far as the k-th stay for the exact pass
        query, row, far = query[stay], row[stay], far[stay]
        a, step = b, min(2 * step, STEP)
    return query, row, work


def _search(batches: Iterable[pa.RecordBatch], rotation: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    size = len(rotation)
    for frame in whole_groups(batches, "place", at_least=TILE):
        place, ids, asks, packed, top = (frame[c].to_numpy() for c in ("place", "vec_id", "asks", "v", "top"))
        edges = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)]))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(edges[:-1], edges[1:]):
            x = np.frombuffer(b"".join(packed[a:b]), np.float64).reshape(-1, size)
            own, ask = ids[a:b], asks[a:b]
            if ask.all() or not ask.any():
                continue
            held, some = x[~ask], x[ask]
            tile, turned, who, far = Tile.of(own[~ask], held @ rotation), some @ rotation, own[ask], top[a:b][ask] ** 2
            for c in range(0, len(who), TOGETHER):
                part = slice(c, c + TOGETHER)
                q, r, _ = scan(who[part], turned[part], far[part] * (1 + 1e-9), tile, k)
                score = np.sqrt(((held[r] - some[part][q]) ** 2).sum(axis=1))
                order = np.lexsort((tile.ids[r], score, q))
                q, r, score = q[order], r[order], score[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                out.append((who[part][q[best]], tile.ids[r[best]], score[best]))
        if out:
            query, vec, score = (np.concatenate(c) for c in zip(*out))
            yield pa.record_batch({"query_id": pa.array(query), "vec_id": pa.array(vec), "score": pa.array(score)})


def neighbours(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probes: float = PROBES, list_rows: int = LIST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row that ``queries`` (on vec_id) takes."""
    rows, size = vectors(df, id_col, vector_col)
    rows = cut(rows)
    rotation, centroids = build(rows, size, rows.count(), list_rows)
    dealt = cut(rows.mapInArrow(lambda b: _assign(b, rotation, centroids), "vec_id long, v binary, list int"))
    index = Index(rotation, centroids, _counts(dealt, len(centroids)))
    tiles = np.maximum(-(-index.counts // TILE), 1)
    numbers = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    nth_of = lambda xs: F.get(numbers(xs), F.col("list"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def search(visits: DataFrame) -> DataFrame:
        """The ``k`` best of each query in the lists that it visits, with their ``rank``."""
        copies = np.maximum(-(-_counts(visits, len(centroids)) // ASKING), 1)
        part = lambda xs: F.pmod(F.xxhash64("vec_id"), nth_of(xs)).cast("int")
        every = lambda xs: F.explode(F.sequence(F.lit(0), nth_of(xs).cast("int") - 1))
        homes = dealt.select("vec_id", "v", "list", F.lit(0.0).alias("top"), part(tiles).alias("tile"), every(copies).alias("copy"), F.lit(False).alias("asks"))
        asking = visits.select("vec_id", "v", "list", "top", part(copies).alias("copy"), every(tiles).alias("tile"), F.lit(True).alias("asks"))
        place = (F.col("list").cast("long") * (1 << 25) + F.col("tile")) * (1 << 25) + F.col("copy")
        met = homes.unionByName(asking).withColumn("place", place).drop("list", "tile", "copy")
        found = met.repartition(partitions(df), "place").sortWithinPartitions("place", "vec_id").mapInArrow(lambda b: _search(b, rotation, k), "query_id long, vec_id long, score double")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = rows.where(queries).withColumn("top", F.lit(float("inf")))
    own = cut(search(cut(asked.mapInArrow(lambda b: _route(b, index, 1, 0), VISIT))))
    # the distance that k rows of its own list reach
    reached = own.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("top"))
    known = asked.drop("top").join(reached, "vec_id", "left").select("vec_id", "v", F.coalesce("top", F.lit(float("inf"))).alias("top"))
    wanted = int(np.ceil(probes * len(centroids)))
    others = search(cut(known.mapInArrow(lambda b: _route(b, index, wanted, 20 * k), VISIT).where("nth > 0")))
    both = own.unionByName(others).withColumn("rank", F.row_number().over(order))
    return both.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
