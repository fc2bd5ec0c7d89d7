"""Exact top-k inner-product search with a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it, and sorted into annuli: blocks of at most BLOCK vectors
of one pivot with neighbouring distances. A query q can find nothing better than q.p + |q| * r in an annulus around p of
outer radius r, since q.x = q.p + q.(x - p) and |x - p| <= r; and by the triangle inequality nothing better than
(|q|^2 + max|x|^2 - d^2) / 2, d being the least distance between q and the annulus.

Neighbouring annuli stand together on a shelf, which one task holds: every vector is shipped once a pass, and queries, in
blocks of QUERIES by their nearest pivot, are shipped once a shelf. A first pass sends each block to the shelf with its
best bound, which gives every query's k-th score so far; a second one sends it to those other shelves alone that have an
annulus whose bound is not below some query's k-th score. On a shelf annuli are expanded in order of their bounds, with a
running k best, until no bound is above any query's k-th score; only what beats the first pass is passed on. Scores are
whole numbers and exact, ties go to the smaller id, also in the bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import column, map_arrow, quoted, save

#: Pivots, sampled vectors that they are chosen from, vectors an annulus, queries a block.
PIVOTS, SAMPLE, BLOCK, QUERIES = 32, 4096, 2048, 512
#: Vectors a shelf at least, and its bytes at most.
SHELF_ROWS, SHELF_BYTES = 8192, 64 << 20
#: Annuli are described on the driver, 48 bytes each; beyond so many the annuli grow. So many are bounded at once.
MAX_ANNULI, SLICE = 200_000, 4096
#: Sums of products below this are exact in float64; those below the next one in int64.
EXACT, WHOLE = 2.0**52, 2.0**62
LEAST = np.iinfo(np.int64).min


def choose_pivots(sample: np.ndarray, k: int = PIVOTS, rounds: int = 5) -> np.ndarray:
    """Centres of a few rounds of k-means from a farthest-first start."""
    if not len(sample):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(picked) < min(k, len(sample)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    pivots = sample[picked].astype(np.float64)
    for _ in range(rounds):
        near = nearest(sample, pivots)[0]
        for i in range(len(pivots)):
            if (near == i).any():
                pivots[i] = sample[near == i].mean(axis=0)
    return pivots


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)
    at = d.argmin(axis=1)
    return at, np.sqrt(((x - pivots[at]) ** 2).sum(axis=1))


def bounds(q: np.ndarray, pivots: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Upper bounds of queries (rows) on annuli (columns) as whole numbers: what is above them by less than rounding errors
    can be counts as reached."""
    square = (q**2).sum(axis=1)
    size = np.sqrt(square)
    direct = q @ pivots[pivot].T + size[:, None] * high
    away = np.sqrt(np.maximum(square[:, None] - 2 * q @ pivots.T + (pivots**2).sum(axis=1), 0))[:, pivot]
    gap = np.maximum(np.maximum(away - high, low - away) - 1e-6 * (1 + size[:, None] + norm), 0)
    triangle = (square[:, None] + norm**2 - gap**2) / 2
    best = np.minimum(np.minimum(direct, triangle), size[:, None] * norm)
    return np.floor(best + 1e-9 * (1 + (size[:, None] + norm) ** 2))


def top(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score): each row's k best without its own id, ties to the smaller id."""
    scores = np.where(ids[None, :] == own[:, None], LEAST, scores)
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        rows, cols = np.nonzero((scores >= edge[:, None]) & (scores > LEAST))
    else:
        rows, cols = np.nonzero(scores > LEAST)
    return best_of(rows, ids[cols], scores[rows, cols], k)


def best_of(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, sorted by row, falling score and id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[keep], scores[keep]


class Shelf:
    """Annuli that a task holds, and the expansion of a block of queries over them."""

    def __init__(self, pivots: np.ndarray, width: int, kind: str, whole: bool):
        self.pivots, self.width, self.kind, self.whole = pivots, width, kind, whole
        self.about: list[tuple] = []
        self.blobs: list[tuple[bytes, bytes]] = []

    def add(self, pivot: int, low: float, high: float, norm: float, least: int, ids: bytes, vs: bytes) -> None:
        self.about.append((pivot, low, high, norm, least))
        self.blobs.append((ids, vs))

    def expand(self, q: np.ndarray, own: np.ndarray, edge: np.ndarray, edge_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score): of every query's k best on this shelf, those that come before (edge, edge_id)."""
        pivot, low, high, norm, least = (np.array(x) for x in zip(*self.about))
        up = bounds(q, self.pivots, pivot, low, high, norm)
        edge, edge_id = edge.copy(), edge_id.copy()
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for i in np.lexsort((least, -up.max(axis=0))).tolist():
            live = np.flatnonzero((up[:, i] > edge) | ((up[:, i] == edge) & (least[i] < edge_id)))
            if not len(live):
                continue
            ids, x = np.frombuffer(self.blobs[i][0], "<i8"), matrix(self.blobs[i][1], self.width, self.kind)
            if self.whole:
                scores = q[live].astype(np.int64) @ x.astype(np.int64).T
            else:
                scores = (q[live] @ x.T).astype(np.int64)
            rows, near, got = top(scores, ids, own[live], k)
            rows = live[rows]
            better = (got > edge[rows]) | ((got == edge[rows]) & (near < edge_id[rows]))
            found = best_of(*(np.concatenate([a, b[better]]) for a, b in zip(found, (rows, near, got))), k)
            last = np.flatnonzero(np.arange(len(found[0])) - np.searchsorted(found[0], found[0]) == k - 1)
            edge[found[0][last]], edge_id[found[0][last]] = found[2][last], found[1][last]
        return found


def matrix(blob: bytes, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(-1, width).astype(np.float64)


def quantised(vectors: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(id, v binary of float64 whole numbers, norm, most) of the rows that take part; most: the largest component's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out, norm, most = [], [], [], []
            for i, v in zip(column(batch, "id").to_pylist(), column(batch, "v")):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(x * scale)
                keep.append(i)
                out.append(x.astype("<f8").tobytes())
                with np.errstate(over="ignore"):
                    norm.append(float(np.sqrt((x**2).sum())))
                most.append(float(np.abs(x).max()))
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(out, pa.binary()), pa.array(norm, pa.float64()), pa.array(most, pa.float64())], ["id", "v", "norm", "most"])

    src = vectors.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vec_col)).alias("v"))
    return map_arrow(src, run, "id long, v binary, norm double, most double")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every`, the k best of all other ids.

    Components are floor(scale * x). Vectors that are null or empty, or hold null or non-finite components, or have a null
    id, take no part, nor do those of another length than the most frequent one (of ties the longer). Equal vectors and
    rows of one id each take part, a query's own id never. Scores are exact; vectors so large that a score might not fit
    64 bits (a product of two norms of 2**62 and more) are an error. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = save(quantised(vectors, scale, id_col, vec_col), "vectors")
    lengths = rows.groupBy(F.length("v").alias("bytes")).agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max("most").alias("most"))
    common = lengths.orderBy(F.desc("n"), F.desc("bytes")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if common is None:
        return spark.createDataFrame([], schema)
    if common["norm"] ** 2 >= WHOLE:
        raise ValueError("inner products may not fit 64 bits")
    rows = rows.where(F.length("v") == common["bytes"])
    width, n, whole = common["bytes"] // 8, common["n"], common["norm"] ** 2 >= EXACT
    kind = "<i2" if common["most"] < 1 << 15 else "<f8"
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").collect()
    pivots = choose_pivots(np.stack([matrix(bytes(r["v"]), width, "<f8")[0] for r in sample]))
    shared = spark.sparkContext.broadcast(pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(b"".join(column(batch, "v").to_pylist()), width, "<f8")
                at, d = nearest(x, shared.value)
                small = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([column(batch, "id"), small, column(batch, "norm"), pa.array(at.astype(np.int32)), pa.array(d)], ["id", "v", "norm", "pivot", "d"])

    keyed = map_arrow(rows.select("id", "v", "norm"), key, "id long, v binary, norm double, pivot int, d double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = max(BLOCK, -(-n // MAX_ANNULI))

    def cut(size: int, one_pivot: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            made = TaskContext.get().partitionId() << 40

            def out():
                v, i, p, d, m = (list(x) for x in zip(*held))
                held.clear()
                cols = [pa.array([made]), pa.array([p[0]], pa.int32()), pa.array([min(d)]), pa.array([max(d)]), pa.array([max(m)]), pa.array([min(i)]), pa.array([len(i)]), pa.array([np.array(i, "<i8").tobytes()]), pa.array([b"".join(v)])]
                return pa.RecordBatch.from_arrays(cols, ["name", "pivot", "low", "high", "norm", "least", "n", "ids", "vs"])

            for batch in batches:
                for row in zip(*(column(batch, c).to_pylist() for c in ("v", "id", "pivot", "d", "norm"))):
                    if held and (len(held) >= size or (one_pivot and held[-1][2] != row[2])):
                        yield out()
                        made += 1
                    held.append(row)
            if held:
                yield out()

        return run

    packed = "name long, pivot int, low double, high double, norm double, least long, n long, ids binary, vs binary"
    order = ("pivot", "d", "id", "v")
    annuli = save(map_arrow(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order), cut(block, True), packed), "annuli")
    asked = keyed.where(F.col("id") % every == 0)
    asks = save(map_arrow(asked.repartitionByRange(parts, *order).sortWithinPartitions(*order), cut(QUERIES, False), packed), "queries")
    about = annuli.select("name", "pivot", "low", "high", "norm", "least", "n").toPandas().sort_values(["pivot", "low", "least", "name"])  # 48 bytes an annulus
    per = max(1, min(max(SHELF_ROWS, n // (2 * parts)), SHELF_BYTES // (width * np.dtype(kind).itemsize)))
    before = about["n"].cumsum() - about["n"]
    about["shelf"] = (before // per).astype("int64")
    shelves = int(about["shelf"].max()) + 1
    info = spark.sparkContext.broadcast({c: about[c].to_numpy() for c in about.columns})
    by_name = about.sort_values("name")
    places = spark.sparkContext.broadcast((by_name["name"].to_numpy(), by_name["shelf"].to_numpy()))

    def plan(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = info.value
            for batch in batches:
                for j in range(batch.num_rows):
                    name, q = column(batch, "name")[j].as_py(), matrix(column(batch, "vs")[j].as_py(), width, kind)
                    best, hit = np.full(shelves, -np.inf), np.zeros(shelves, bool)
                    if not first:
                        edge, edge_id = (np.frombuffer(column(batch, c)[j].as_py(), "<i8")[:, None] for c in ("edge", "edge_id"))
                    for lo in range(0, len(a["shelf"]), SLICE):
                        part = {c: a[c][lo : lo + SLICE] for c in a}
                        up = bounds(q, shared.value, part["pivot"], part["low"], part["high"], part["norm"])
                        np.maximum.at(best, part["shelf"], up.max(axis=0))
                        if not first:
                            open_ = ((up > edge) | ((up == edge) & (part["least"] < edge_id))).any(axis=0)
                            hit[part["shelf"][open_]] = True
                    seeds = np.flatnonzero(best == best.max())
                    seed = seeds[name % len(seeds)]  # equal bounds are dealt out, so no shelf gets all blocks of a hot vector
                    if first:
                        hit[seed] = True
                    else:
                        hit[seed] = False
                    at = np.flatnonzero(hit)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), name)), pa.array(at.astype(np.int32))], ["name", "shelf"])

        return run

    def shelve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shelf = places.value
        for batch in batches:
            at = np.searchsorted(names, column(batch, "name").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(shelf[at].astype(np.int32)), *batch.columns], ["shelf", *batch.schema.names])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, shelf = None, None
        for batch in batches:
            names = ("shelf", "name", "pivot", "low", "high", "norm", "least", "ids", "vs", "edge", "edge_id")
            for row in zip(*(column(batch, c) for c in names)):
                at, name, pivot, low, high, norm, least, ids, vs, edge, edge_id = (x.as_py() for x in row)
                if at != on:
                    on, shelf = at, Shelf(shared.value, width, kind, whole)
                if edge is None:
                    shelf.add(pivot, low, high, norm, least, ids, vs)
                    continue
                own = np.frombuffer(ids, "<i8")
                rows, near, got = shelf.expand(matrix(vs, width, kind), own, np.frombuffer(edge, "<i8"), np.frombuffer(edge_id, "<i8"), k)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), name)), pa.array(rows.astype(np.int32)), pa.array(own[rows]), pa.array(near), pa.array(got)], ["name", "place", "query_id", "vec_id", "score"])

    shelved = map_arrow(annuli.drop("n"), shelve, "shelf int, " + packed.replace("n long, ids", "ids"))
    none = F.lit(None).cast("binary")
    shelved = shelved.withColumn("edge", none).withColumn("edge_id", none)

    def matched(limits: DataFrame, first: bool) -> DataFrame:
        """limits: the blocks of queries with edge and edge_id, the k-th score and id that a new one has to beat."""
        pairs = map_arrow(limits.select("name", "vs", "edge", "edge_id"), plan(first), "name long, shelf int")
        sent = pairs.join(limits, "name").select(*shelved.columns)
        dealt = shelved.union(sent).repartitionById(shelves, F.col("shelf"))
        dealt = dealt.sortWithinPartitions("shelf", F.col("edge").isNotNull(), "name")
        return map_arrow(dealt, match, "name long, place int, query_id long, vec_id long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("name", "place", "query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids, place, score, vec in zip(*(column(batch, c).to_pylist() for c in ("name", "ids", "place", "score", "vec"))):
                out = np.full((2, len(ids) // 8), LEAST, "<i8")
                at = np.array(place or [], np.int64)
                out[0, at], out[1, at] = np.array(score or [], np.int64), np.array(vec or [], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out[0].tobytes()], pa.binary()), pa.array([out[1].tobytes()], pa.binary())], ["name", "edge", "edge_id"])

    limit = "name long, edge binary, edge_id binary"
    unknown = [F.lit(None).cast(f"array<{t}>").alias(c) for c, t in (("place", "int"), ("score", "long"), ("vec", "long"))]
    start = map_arrow(asks.select("name", "ids", *unknown), edges, limit)
    seeds = save(matched(asks.join(start, "name"), True), "found")
    kth = ranked(seeds).where(F.col("rank") == k).groupBy("name").agg(F.collect_list(F.struct("place", "score", "vec_id")).alias("x"))  # QUERIES at most
    kth = kth.select("name", F.col("x.place").alias("place"), F.col("x.score").alias("score"), F.col("x.vec_id").alias("vec"))
    limits = save(map_arrow(asks.select("name", "ids").join(kth, "name", "left"), edges, limit), "edges")
    rest = matched(asks.join(limits, "name"), False)
    return ranked(seeds.union(rest)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
