"""Exact links between shingle sets whose Jaccard similarity reaches a threshold.

A 64-bit fingerprint tells pairs of similarity 0.95 from the rest, not those of 0.8, whose fingerprints differ in some ten
bits. This module finds all of them, starting from the links that fingerprints give.

Two sets of at most `top` elements each and of similarity s or more differ in at most k = 2 * top * (1 - s) / (1 + s)
elements. Cut the range of the hashes into m > k parts: the sets differ in k parts at most. So each set sends a signature
for each of the first d + 1 parts that hold any of its elements, where it differs from no set of its partners' sizes in more
than d: of two sets, the one whose d + 1 parts end first has one among them in which both agree, and the other sends that
too. A few parts more than needed make up for empty ones, and a set with too many of those sends its smallest hashes too,
of which similar sets share one. Sizes fall in intervals of ratio s; a set takes part in its own interval and the next.
Equal signatures thus meet the sets of every linked pair, while sets that merely share a passage rarely agree in a part.

Signatures are many, a half of the elements, and few are shared. They are never stored: a task packs those of many texts by
slice of their range into arrays, which are shuffled, and only those that two sets share are written. 44 bits of each are
kept, which may make two sets meet by chance but never keeps two apart.

Sets that share a signature are a posting, and all postings of one smallest set are a family, which holds each set once.
Round by round, the first members of a family (one, then four, sixteen and so on) are compared with its later members of
other components; a family whose members are all in one component is done. A family of near copies ends with its first
round, so pairs to verify do not grow with the square of a group. Texts around one passage may be many in a family of which
no two are similar; so pairs are made and bounded where the family meets, and are never rows of a table. The bound is the
unlike bits of two sketches, which hold the parity of a set's counts in about as many parts of the hash range as it has
elements: a part whose parities differ holds an element that only one set has. What passes goes to the exact test on whole
sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import BROADCAST_BYTES, binary_texts, column, joinable, map_arrow, mix, quoted, save
from traceloom.llm.components import stars

#: Counts of a set's profile, unless told otherwise.
CELLS = 32
#: Slices of the signatures' range, and signatures that a task packs at a time.
SLICES, PACKED = 4096, 1 << 18
#: Members of a family that meet in one task, besides the first.
CHUNK = 4096
#: What is known of each text.
ROW = ["id", "text_key", "fp", "sid", "n", "sketch"]
ROW_TYPES = "id long, text_key long, fp long, sid long, n long, sketch binary"
#: Sets that a task remembers to have signed.
REMEMBERED = 100_000


def slots(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hash range, of `parts` equal ones, that each hash lies in."""
    return (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


@lru_cache(8)
def intervals(similarity: float) -> list[int]:
    """The largest size in each interval: sets of that similarity lie in one interval or in two neighbouring ones."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, math.floor(tops[-1] / similarity + 1e-9)))
    return tops


def set_key(hashes: np.ndarray) -> int:
    """A 64-bit key of a set of hashes."""
    key = mix(np.array([mix(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))
    return int(key.view(np.int64)[0])


def signatures(hashes: np.ndarray, similarity: float = 0.8) -> np.ndarray:
    """Signatures of a set of distinct hashes in ascending order: any two sets of that similarity share one."""
    n, out, tops = len(hashes), [], intervals(similarity)
    if not n:
        return np.zeros(0, np.uint64)
    mixed, own = mix(hashes), int(np.searchsorted(tops, n))
    for table in (own, own + 1):
        share, most = (1 - similarity) / (1 + similarity), min(tops[table], math.floor(n / similarity + 1e-6))
        differ, need = math.floor(2 * tops[table] * share + 1e-6), math.floor((n + most) * share + 1e-6) + 1
        spare = 3 + differ // 10
        part = slots(hashes, differ + 1 + spare)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        salt = np.uint64((table + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        out.append(mix(mix(np.add.reduceat(mixed, starts)[:need] ^ salt) + part[starts[:need]]))
        if len(starts) < need:
            first = n - math.ceil(similarity * n - 1e-9) + 1
            out.append(mix(mixed[:first] + salt))
    return np.concatenate(out)


def profile(hashes: np.ndarray, cells: int = CELLS) -> bytes:
    """Counts of a set's hashes in equal parts of their range; two profiles' Manhattan distance is a lower bound on the
    number of elements in which the sets differ."""
    return np.bincount(slots(hashes, cells).astype(np.int64), minlength=cells).astype(np.int32).tobytes()


def sketch(hashes: np.ndarray) -> bytes:
    """The parities of a set's profile of as many counts as it has elements, rounded up to a power of two, 64 at least."""
    cells = max(64, 1 << max(len(hashes) - 1, 0).bit_length())
    return np.packbits(np.frombuffer(profile(hashes, cells), np.int32).astype(np.uint8) & 1).tobytes()


def unlike(a: bytes, b: bytes) -> int:
    """Unlike bits of two sketches, a lower bound on the number of elements in which the sets differ. Of two counts side by
    side the parities' XOR is that of their sum, so the longer sketch is brought to the shorter one's length."""
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):
        bits = np.unpackbits(np.frombuffer(b, np.uint8))
        b = np.packbits(bits[::2] ^ bits[1::2]).tobytes()
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, distinct hashes in ascending order, reach the similarity. Two empty sets do."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def arrays(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The bytes of runs of data, `counts` items each, as a binary array."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def pack(sigs: list[np.ndarray], sids: list[int]) -> pa.RecordBatch:
    """Signatures of the sets `sids` by slice: the 32 bits of each that follow the slice's, and its set."""
    sig, sid = np.concatenate(sigs), np.repeat(np.array(sids, np.int64), [len(x) for x in sigs])
    cut = (sig >> np.uint64(52)).astype(np.uint16)
    order, counts = np.argsort(cut, kind="stable"), np.bincount(cut, minlength=SLICES)
    some = np.flatnonzero(counts)
    low, owner = (sig[order] >> np.uint64(20)).astype(np.uint32), sid[order]
    none = [pa.nulls(len(some), pa.int64())] * 5
    columns = [pa.array(some.astype(np.int32)), *none, pa.nulls(len(some), pa.binary()), arrays(low, counts[some]), arrays(owner, counts[some])]
    return pa.RecordBatch.from_arrays(columns, ["slice", "id", "text_key", "fp", "sid", "n", "sketch", "sigs", "owners"])


def shared(sig: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sig, sid, place): of the signatures that two or more sets have, their sets, numbered by key from 0."""
    order = np.argsort(sig, kind="stable")
    sig, sid = sig[order], sid[order]
    same = sig[1:] == sig[:-1]
    twice = np.r_[same, False] | np.r_[False, same] if len(sig) else np.zeros(0, bool)
    sig, sid = sig[twice], sid[twice]
    order = np.lexsort((sid, sig))
    sig, sid = sig[order], sid[order]
    fresh = np.r_[True, (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])][: len(sig)]
    sig, sid = sig[fresh], sid[fresh]
    start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
    size = np.diff(np.r_[start, len(sig)])
    place, keep = np.arange(len(sig)) - np.repeat(start, size), np.repeat(size > 1, size)
    return sig[keep], sid[keep], place[keep]


def describe(docs: DataFrame, hashes: Callable, fingerprint: Callable, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text_key, fp, sid, n, sketch) for every row: its fingerprint, the key, size and sketch of its shingle set; and
    (lead, sid, mask): the later sets of the postings whose smallest set is `lead`, two that share one having a common bit in
    their masks. Both come from one pass over the texts and are parts of one table; the second may have repeated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()
        sigs, owners, held = [], [], 0
        for batch in batches:
            fps, sids, sizes, sketches = [], [], [], []
            for text in binary_texts(batch, "text"):
                all_hashes = hashes(text.lower().split())
                own = np.unique(all_hashes)
                sid = set_key(own)
                fps.append(fingerprint(all_hashes))
                sids.append(sid)
                sizes.append(len(own))
                sketches.append(sketch(own))
                if sid not in signed and len(own):
                    sigs.append(signatures(own, similarity))
                    owners.append(sid)
                    held += len(sigs[-1])
                if len(signed) > REMEMBERED:
                    signed.clear()
                signed.add(sid)
                if held >= PACKED:
                    yield pack(sigs, owners)
                    sigs, owners, held = [], [], 0
            keys, fp, none = np.array(sids, np.int64), np.array(fps, np.uint64).view(np.int64), pa.nulls(len(sids), pa.binary())
            cut = (keys.view(np.uint64) >> np.uint64(52)).astype(np.int32)
            columns = [pa.array(cut), column(batch, "id"), column(batch, "text_key"), pa.array(fp), pa.array(keys), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), none, none]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "id", "text_key", "fp", "sid", "n", "sketch", "sigs", "owners"])
        if held:
            yield pack(sigs, owners)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last slice waits for the next batch, as only that shows whether it goes on.
        last_sig, last_sid = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in itertools.chain(batches, [None]):
            sig, sid, edge = last_sig, last_sid, len(last_sig)
            if batch is not None:
                row = column(batch, "sigs").is_null()
                texts, packs = batch.filter(row), batch.filter(column(batch, "sigs").is_valid())
                if texts.num_rows:
                    none = pa.nulls(texts.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(column(texts, c) for c in ROW), none, none], [*ROW, "lead", "mask"])
                if not packs.num_rows:
                    continue
                low = column(packs, "sigs").to_pylist()
                cut = np.repeat(column(packs, "slice").to_numpy().astype(np.int64), [len(x) // 4 for x in low])
                sig = np.r_[sig, cut << 32 | np.frombuffer(b"".join(low), np.uint32)]
                sid = np.r_[sid, np.frombuffer(b"".join(column(packs, "owners").to_pylist()), np.int64)]
                edge = int(np.searchsorted(sig >> 32, sig[-1] >> 32))
            last_sig, last_sid = sig[edge:], sid[edge:]
            sig, sid, place = shared(sig[:edge], sid[:edge])
            lead = sid[np.flatnonzero(place == 0)][np.cumsum(place == 0) - 1] if len(sid) else sid
            later = np.flatnonzero(place)
            order = later[np.lexsort((sid[later], lead[later]))]
            lead, sid, mask = lead[order], sid[order], np.int64(1) << (sig[order] & 63)
            fresh = np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (sid[1:] != sid[:-1])][: len(lead)])
            if not len(fresh):
                continue
            lead, sid, mask = lead[fresh], sid[fresh], np.bitwise_or.reduceat(mask, fresh)
            for lo in range(0, len(fresh), 1 << 16):
                k, none = slice(lo, lo + (1 << 16)), pa.nulls(len(fresh[lo : lo + (1 << 16)]), pa.int64())
                columns = [none, none, none, pa.array(sid[k]), none, pa.nulls(len(none), pa.binary()), pa.array(lead[k]), pa.array(mask[k])]
                yield pa.RecordBatch.from_arrays(columns, [*ROW, "lead", "mask"])

    text = F.col(quoted(text_col))
    src = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    packed = map_arrow(src, run, f"slice int, {ROW_TYPES}, sigs binary, owners binary")
    found = map_arrow(packed.repartition("slice").sortWithinPartitions("slice"), gather, f"{ROW_TYPES}, lead long, mask long")
    found = save(found, "described")
    return found.where("lead is null").select(*ROW), found.where("lead is not null").select("lead", "sid", "mask")


def unlike_rows(sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """unlike() of the sketches i and j, pair by pair; those of a pair are of one length, or one is twice as long."""
    length = np.fromiter(map(len, sketches), np.int64, len(sketches))
    at, table = np.zeros(len(sketches), np.int64), {}
    for size in np.unique(length).tolist():
        rows = np.flatnonzero(length == size)
        at[rows] = np.arange(len(rows))
        bits = np.frombuffer(b"".join([sketches[r] for r in rows.tolist()]), np.uint8).reshape(-1, size)
        table[size, size] = bits.view(np.uint64)
        if size > 8:
            half = np.unpackbits(bits, axis=1)
            table[size, size // 2] = np.packbits(half[:, ::2] ^ half[:, 1::2], axis=1).view(np.uint64)
    out, least = np.zeros(len(i), np.int64), np.minimum(length[i], length[j])
    kind = length[i] * (1 << 32) + length[j]
    for k in np.unique(kind).tolist():
        pairs = np.flatnonzero(kind == k)
        a, b, size = k >> 32, k & (1 << 32) - 1, int(least[pairs[0]])
        step = max(1, (4 << 20) // size)
        for lo in range(0, len(pairs), step):
            p = pairs[lo : lo + step]
            out[p] = np.bitwise_count(table[a, size][at[i[p]]] ^ table[b, size][at[j[p]]]).sum(axis=1, dtype=np.int64)
    return out


def near(open_rows: DataFrame, heads: DataFrame, small: bool, fresh: int, leaders: int, similarity: float) -> DataFrame:
    """The pairs (u, v) that pass the bound, of the members `fresh` to `fresh + leaders` of each family and its later members of
    other components that share a posting. open_rows: lead, sid, mask, place, root, m (the family's last place). A family
    meets in chunks, to each of which the leaders go."""
    share = (1 - similarity) / (1 + similarity)

    def found(sids: np.ndarray, place: np.ndarray, root: np.ndarray, n: np.ndarray, mask: np.ndarray, sketches: list[bytes], last: np.ndarray):
        """last: the end of each row's group."""
        first = np.flatnonzero((place >= fresh) & (place < fresh + leaders))
        many = last[first] - first - 1
        cuts = np.flatnonzero(np.diff(np.cumsum(many) >> 18, prepend=0)).tolist()
        for lo, hi in itertools.pairwise([0, *(c for c in cuts if c), len(first)]):
            i = np.repeat(first[lo:hi], many[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi])
            fit = (root[i] != root[j]) & ((mask[i] & mask[j]) != 0) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
            i, j = i[fit], j[fit]
            if not len(i):
                continue
            fit = unlike_rows(sketches, i, j) <= (n[i] + n[j]) * share + 1e-6
            pairs = np.unique(np.stack([sids[i[fit]], sids[j[fit]]], axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last group waits for the next batch, as only that shows whether it goes on.
        names = ["lead", "chunk", "place", "sid", "root", "n", "mask"]
        held, held_sketches = [np.zeros(0, np.int64)] * len(names), []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = [np.r_[x, column(batch, c).to_numpy()] for x, c in zip(held, names)]
                held_sketches = held_sketches + column(batch, "sketch").to_pylist()
            lead, chunk, place, sids, root, n, mask = held
            if not len(lead):
                continue
            start = np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (chunk[1:] != chunk[:-1])])
            edge = len(lead) if batch is None else int(start[-1])
            last = np.repeat(np.r_[start[1:], len(lead)], np.diff(np.r_[start, len(lead)]))
            yield from found(*(x[:edge] for x in (sids, place, root, n, mask)), held_sketches[:edge], last[:edge])
            held, held_sketches = [x[edge:] for x in held], held_sketches[edge:]

    own, leads = F.expr(f"place div {CHUNK}"), (F.col("place") >= fresh) & (F.col("place") < fresh + leaders)
    rows = open_rows.where(F.col("place") >= fresh).withColumn("chunk", F.explode(F.when(leads, F.sequence(own, F.expr(f"m div {CHUNK}"))).otherwise(F.array(own))))
    other = heads.select("sid", "n", "sketch")
    rows = rows.join(F.broadcast(other) if small else other, "sid").select("lead", "chunk", "place", "sid", "root", "n", "mask", "sketch")
    return map_arrow(rows.repartition("lead", "chunk").sortWithinPartitions("lead", "chunk", "place"), meet, "u long, v long").distinct()


def bounded(pairs: DataFrame, heads: DataFrame, small: bool, similarity: float) -> DataFrame:
    """The pairs (u, v) that pass the bound. heads: sid, id, text_key, n, sketch; small: whether that may be broadcast."""
    share = (1 - similarity) / (1 + similarity)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (column(batch, "nu").to_numpy() + column(batch, "nv").to_numpy()) * share + 1e-6
            near = [unlike(a, b) <= m for a, b, m in zip(column(batch, "pu").to_pylist(), column(batch, "pv").to_pylist(), most.tolist())]
            near = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "u").filter(near), column(batch, "v").filter(near)], ["u", "v"])

    both = pairs.where("u <> v").distinct()
    for side in ("u", "v"):
        other = heads.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"p{side}"))
        both = both.join(F.broadcast(other) if small else other, side)
    both = both.where(F.least("nu", "nv") >= similarity * F.greatest("nu", "nv") - 1e-9)
    return map_arrow(both, bound, "u long, v long")


def verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame, hashes: Callable, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (u, v) of set keys, each given once, whose sets reach the similarity."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(hashes(t.lower().split())).tobytes() for t in binary_texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "sid"), pa.array(found, pa.binary())], ["sid", "elements"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in column(batch, c)] for c in ("eu", "ev"))
            near = pa.array([similar(x, y, similarity) for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "u").filter(near), column(batch, "v").filter(near)], ["u", "v"])

    left = save(pairs, "near")
    if left.isEmpty():
        return left
    needed = left.select(F.col("u").alias("sid")).union(left.select(F.col("v").alias("sid"))).distinct()
    needed = save(needed.join(heads, "sid").select(F.coalesce("id", F.lit(0)).alias("i"), F.col("id").isNull().alias("o"), F.col("text_key").alias("t"), "sid"), "needed")
    held = F.broadcast(needed) if needed.count() * 64 <= BROADCAST_BYTES else needed.hint("shuffle_hash")
    own, text = F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col))
    texts = docs.select(F.coalesce(own, F.lit(0)).alias("i"), own.isNull().alias("o"), F.xxhash64(text).alias("t"), text.alias("text")).join(held, ["i", "o", "t"])
    whole = save(map_arrow(texts.select("sid", "text"), sets, "sid long, elements binary").groupBy("sid").agg(F.min("elements").alias("elements")), "sets")
    joined = left.join(whole.select(F.col("sid").alias("u"), F.col("elements").alias("eu")), "u")
    joined = joined.join(whole.select(F.col("sid").alias("v"), F.col("elements").alias("ev")), "v").select("u", "v", "eu", "ev")
    return save(map_arrow(joined, exact, "u long, v long"), "linked")


def classes(docs: DataFrame, hashes: Callable, fingerprint: Callable, fingerprint_links: Callable, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, root) for every row: rows have one root if a chain of links joins them, a link being two texts whose
    sets of shingles reach the similarity.

    hashes(words) gives a text's shingle hashes, fingerprint(hashes) its fingerprint, fingerprint_links(table of fp) the links
    (u, v) among fingerprints that are compared first. Null and wordless texts have the empty set and are copies of each
    other. An empty table gives an empty one.
    """
    described, met = describe(docs, hashes, fingerprint, similarity, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("o"), "id", "text_key", "fp", "n", "sketch")).alias("x")
    heads = described.groupBy("sid").agg(first).select("sid", "x.id", "x.text_key", "x.fp", "x.n", "x.sketch")
    heads = save(heads, "heads")
    n, wide = heads.agg(F.count("*"), F.coalesce(F.sum(F.length("sketch")), F.lit(0))).first()
    small = 64 * n + wide <= BROADCAST_BYTES
    of_fp = save(heads.groupBy("fp").agg(F.min("sid").alias("least")), "of_fp")
    named = joinable(of_fp, "of_fp", n)
    pairs = heads.join(named, "fp").select(F.col("least").alias("u"), F.col("sid").alias("v"))
    for_link = fingerprint_links(of_fp.select("fp")).join(joinable(of_fp.select(F.col("fp").alias("u"), F.col("least").alias("a")), "of_fp", n), "u")
    for_link = for_link.join(joinable(of_fp.select(F.col("fp").alias("v"), F.col("least").alias("b")), "of_fp", n), "v")
    pairs = pairs.union(for_link.select(F.col("a").alias("u"), F.col("b").alias("v")))
    linked = verified(bounded(pairs, heads, small, similarity), heads, docs, hashes, similarity, id_col, text_col)
    met = met.groupBy("lead", "sid").agg(F.bit_or("mask").alias("mask"))
    met = met.union(met.select("lead", F.col("lead").alias("sid"), F.lit(-1).cast("long").alias("mask")).distinct())
    place = F.row_number().over(Window.partitionBy("lead").orderBy("sid")).cast("long") - 1
    open_rows = save(met.withColumn("place", place), "families")
    fresh, leaders = 0, 1
    roots = stars(linked)
    while True:
        known = joinable(roots.select(F.col("node").alias("sid"), "root"), "roots", n)
        marked = open_rows.join(known, "sid", "left").select("lead", "sid", "mask", "place", F.coalesce("root", "sid").alias("root"))
        still = marked.groupBy("lead").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("place").alias("m"))
        still = still.where((F.col("a") != F.col("b")) & (F.col("m") > fresh)).select("lead", "m")
        open_rows = save(marked.join(still, "lead"), "open")
        if open_rows.isEmpty():
            break
        pairs = near(open_rows, heads, small, fresh, leaders, similarity)
        linked = verified(pairs, heads, docs, hashes, similarity, id_col, text_col)
        if not linked.isEmpty():
            roots = stars(linked.union(roots))
        open_rows = open_rows.select("lead", "sid", "mask", "place")
        fresh, leaders = fresh + leaders, 4 * leaders
    root = joinable(roots.select(F.col("node").alias("sid"), "root"), "roots", n)
    return described.select("id", "text_key", "sid").join(root, "sid", "left").select("id", "text_key", F.coalesce("root", "sid").alias("root"))
