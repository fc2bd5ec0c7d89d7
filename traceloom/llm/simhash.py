"""SimHash fingerprints of word shingles, and their links within a Hamming distance.

Method: segment-popcount embedding. The 64 bits are cut into segments; a fingerprint's image is the vector of its
segments' bit counts, a point of a grid. One flipped bit changes one count by one, so the Manhattan distance of two images
is a lower bound of the fingerprints' Hamming distance. The join is a range join on that grid. Of three groups of segments
the two that differ least differ by 2 * bits // 3 steps at most together, so it runs on the counts of every two groups:
each fingerprint goes to its own cell and to the cells half that radius around it, and two that are in range meet in a
cell between them. In a cell, pairs pass the Manhattan bound over all segments first and the exact Hamming test then.

Segments are of 4 bits, 16 counts. Pairs that meet by chance grow with the square of the fingerprints; beyond WIDE_ROWS of
them segments are of 2 bits, whose 32 counts tell more apart, at twice the cells a fingerprint. Either gives all links.
Cells that hold more than `cell_rows` fingerprints are cut into chunks, and every pair of chunks meets in one task; nothing
is capped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import binary_texts, column, joinable, map_arrow, mix, quoted, save, small, times_taken
from traceloom.llm.components import stars
from traceloom.llm.resemblance import classes

SEED = 42
#: Distinct fingerprints up to which segments are of 4 bits.
WIDE_ROWS = 1 << 24


def shingle_hashes(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of `size` words joined by one space; of the whole sequence if it is shorter; none if empty."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - size].tolist()
    return np.fromiter([h(joined[s:e], seed) for s, e in zip(starts, ends[size - 1 :].tolist())], np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The number whose bit is set where over half the hashes set it."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, fp long) for every row. A null or wordless text has fingerprint zero; text_key is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_texts(batch, "text")
            fps = np.fromiter((majority(shingle_hashes(t.lower().split(), size)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "text_key"), pa.array(fps.view(np.int64))], ["id", "text_key", "fp"])

    text = F.col(quoted(text_col))
    src = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return map_arrow(src, run, "id long, text_key long, fp long")


def image_table(width: int) -> np.ndarray:
    """For every byte, its segments' bit counts as thermometers: of a segment with c bits set, the lowest c are."""
    byte = np.arange(256)
    out = np.zeros(256, np.int64)
    for at in range(0, 8, width):
        count = np.bitwise_count(byte >> at & (1 << width) - 1).astype(np.int64)
        out |= ((1 << count) - 1) << at
    return out.astype(np.uint8)


def images(fps: np.ndarray, width: int) -> np.ndarray:
    """Bit counts of the segments of `width` bits, as thermometers: the Manhattan distance of two images is the number of
    their unlike bits."""
    return image_table(width)[np.ascontiguousarray(fps, np.uint64).view(np.uint8)].view(np.uint64)


def group_pairs(width: int) -> list[list[int]]:
    """The segments, by number, of every two of three groups."""
    edges = np.linspace(0, 64 // width, 4).round().astype(int)
    groups = [list(range(a, b)) for a, b in itertools.pairwise(edges.tolist())]
    return [a + b for a, b in itertools.combinations(groups, 2)]


def neighbours(image: np.ndarray, segments: list[int], width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, image) of the grid's cells within `radius` steps of every image, a step being one count up or down in one of
    the segments; the own cell first, every cell once."""
    full = np.uint64((1 << width) - 1)
    row, cell = np.arange(len(image)), image
    for _ in range(radius):
        rows, cells = [row], [cell]
        for s in segments:
            shift = np.uint64(s * width)
            count = cell >> shift & full
            rest = cell ^ count << shift
            for other in ((count << np.uint64(1) | np.uint64(1)) & full, count >> np.uint64(1)):
                moved = other != count
                rows.append(row[moved])
                cells.append((rest | other << shift)[moved])
        row, cell = np.concatenate(rows), np.concatenate(cells)
        if radius > 1:
            order = np.lexsort((cell, row))
            row, cell = row[order], cell[order]
            first = np.r_[True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])]
            row, cell = row[first], cell[first]
    return row, cell


def _pairs_small(start: np.ndarray, size: np.ndarray, fp: np.ndarray, image: np.ndarray, bits: int):
    """Linked index pairs within many small runs: the rows of a run against those d places on, for each d."""
    out = []
    rows = np.repeat(start + size, size) - np.concatenate([np.arange(s, s + n) for s, n in zip(start, size)]) if len(start) else np.zeros(0, np.int64)
    at = np.concatenate([np.arange(s, s + n) for s, n in zip(start, size)]) if len(start) else np.zeros(0, np.int64)
    d = 1
    while len(at):
        live = rows > d
        at, rows = at[live], rows[live]
        i = at[np.bitwise_count(image[at] ^ image[at + d]) <= bits] if len(at) else at
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= bits]
        if len(i):
            out.append((i, i + d))
        d += 1
    return out


def _pairs_large(lo: int, hi: int, fp: np.ndarray, image: np.ndarray, bits: int):
    """A spanning forest of one large run's links: each reached row is compared once with the rows not reached yet."""
    out, left = [], np.arange(lo, hi)
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            block, front = front[:64], front[64:]
            near = np.bitwise_count(image[block][:, None] ^ image[left][None, :]) <= bits
            near &= np.bitwise_count(fp[block][:, None] ^ fp[left][None, :]) <= bits
            got = near.any(axis=0)
            if got.any():
                out.append((block[near[:, got].argmax(axis=0)], left[got]))
                front, left = np.concatenate([front, left[got]]), left[~got]
    return out


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]], fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those that join two parts not joined before."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    us, vs = [], []
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        for u, v in zip(fp[a].view(np.int64).tolist(), fp[b].view(np.int64).tolist()):
            if (x := find(u)) != (y := find(v)):
                parent[x] = y
                us.append(u)
                vs.append(v)
    return np.array(us, np.int64), np.array(vs, np.int64)


def cell_links(cell: np.ndarray, fp: np.ndarray, bits: int, width: int = 4, large: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links (a spanning forest of them) among rows sorted by cell."""
    image = images(fp, width)
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[start, len(cell)])
    few = (size > 1) & (size <= large)
    pairs = _pairs_small(start[few], size[few], fp, image, bits)
    for s, n in zip(start[size > large].tolist(), size[size > large].tolist()):
        pairs += _pairs_large(s, s + n, fp, image, bits)
    return _forest(pairs, fp)


def links(fps: DataFrame, bits: int = 4, cell_rows: int = 4096, width: int | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) at `bits` or fewer differing bits, enough of them that
    their components are those of all links."""
    width = width or (4 if fps.count() <= WIDE_ROWS else 2)
    choices, radius = group_pairs(width), (2 * bits // 3 + 1) // 2

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                signed = column(batch, "fp").slice(lo, 4096).to_numpy(zero_copy_only=False)
                image = images(signed.view(np.uint64), width)
                for k, segments in enumerate(choices):
                    own = sum(((1 << width) - 1) << s * width for s in segments)
                    row, cell = neighbours(image & np.uint64(own), segments, width, radius)
                    key = mix(cell + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(signed[row])], ["cell", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_cell, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cell = np.concatenate([kept_cell, column(batch, "cell").to_numpy(zero_copy_only=False)])
                fp = np.concatenate([kept_fp, column(batch, "fp").to_numpy(zero_copy_only=False)])
                cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
                kept_cell, kept_fp, cell, fp = cell[cut:], fp[cut:], cell[:cut], fp[:cut]
            else:
                cell, fp = kept_cell, kept_fp
            if len(cell) > 1:
                u, v = cell_links(cell, fp.view(np.uint64), bits, width)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    dealt = map_arrow(fps.select("fp"), cells, "cell long, fp long")
    sizes = dealt.groupBy("cell").count().where(F.col("count") > cell_rows)
    hot, n_hot = small(save(sizes, "cells"), 32)
    if n_hot:
        many = dealt.join(hot, "cell", "left").withColumn("k", F.coalesce(F.ceil(F.col("count") / cell_rows), F.lit(1)).cast("long"))
        mine = F.pmod(F.xxhash64("fp"), F.col("k"))
        many = many.withColumn("c", mine).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        dealt = many.select(F.when(F.col("k") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("c", "j"), F.greatest("c", "j"))).alias("cell"), "fp")
    return map_arrow(dealt.repartition("cell").sortWithinPartitions("cell"), link, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable) and text_key.

    Null and wordless texts have fingerprint zero and link like any other. A null id takes no part in the choice of the
    smallest one; a component of null ids alone has a null component_id. Repeated rows each give a row. Other input
    columns are ignored, whatever their names. An empty table gives an empty one.
    """
    per_doc = save(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = save(per_doc.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = stars(links(distinct, bits)).select(F.col("node").alias("fp"), "root")
    n = distinct.count()
    classes = save(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    least = joinable(classes.groupBy("root").agg(F.min("least").alias("component_id")), "least", n)
    table = joinable(classes.join(least, "root").select("fp", "component_id"), "components", n)
    joined = per_doc.join(table, "fp")
    return joined.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key")


def one_of_each(docs: DataFrame, size: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The input's rows and columns, whatever their names, of each component only the row of smallest id (of equal ids,
    smallest text hash; of rows equal in both, one). An empty table gives an empty one.

    Without `similarity` components are those of fingerprints within `bits`; a component of null ids alone cannot be told
    from another then, so rows without an id are judged by fingerprint alone. With it a link is two texts whose sets of
    `size`-word shingles reach that Jaccard similarity: those that fingerprints within `bits` lead to are verified first,
    and resemblance.classes finds the rest."""
    if similarity is None:
        found = near_duplicates(docs, size, bits, id_col, text_col).withColumnRenamed("doc_id", "id")
        group = F.when(F.col("component_id").isNull(), F.col("fingerprint")).otherwise(F.col("component_id").cast("string"))
    else:
        found = classes(docs, lambda words: shingle_hashes(words, size), majority, lambda fps: links(fps, bits), similarity, id_col, text_col)
        group = F.col("root")
    rows = found.groupBy(group.alias("g"), "id", "text_key").agg(F.count("*").alias("n"))
    first = rows.groupBy("g").agg(F.min(F.struct(F.col("id").isNull().alias("o"), "id", "text_key", "n")).alias("x"))
    first = first.select(F.col("x.id").alias("id"), F.col("x.text_key").alias("text_key"), F.col("x.n").alias("n"), F.lit(1).cast("long").alias("c"))
    return times_taken(docs, first, id_col, text_col)
