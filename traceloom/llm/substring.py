"""Exact removal of word windows that occur more than once.

Method: level-wise doubling over window lengths 9, 18 and 35 (each at most twice the one before). At the first level only
the smallest 9-word hash of every 35-word window is looked at (rightmost of ties): equal windows choose the same one, so
a window can repeat only if its chosen 9 words do. Chosen places that repeat are extended to 18 words, to the right and
to the left; of the 35-word windows, those whose 18-word part repeats are counted at full length under 128-bit hashes.
Only candidates are counted at each length, and all counts are partial aggregates, so a passage that a third of the
documents share is no hot key: its hash is one row a task. Windows of full length that turn out to be alone are the few,
so they, and not the repeated ones, go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import BROADCAST_BYTES, WordTable, binary_texts, column, hash_words, map_arrow, prefix_sums, quoted, row_field, save, sliding_argmin, spans, whole_row, window_hashes, with_row

BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def levels(window: int) -> list[int]:
    """Lengths that double, rounded up, to the window's: 35 gives 9, 18, 35."""
    return [-(-window // 4), -(-window // 2), window]


class Words:
    """A step's documents as flat word hashes."""

    def __init__(self, docs: list[list[bytes]], window: int, table: WordTable):
        self.first, self.half, self.window = levels(window)
        self.ids, self.counts = table.step(docs)
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts
        self.hashes = table.values
        self.sums, self.inverse = prefix_sums(self.hashes[self.ids, 0], BASES[0])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The starts of all full windows, for each its document and the place of its chosen short window."""
        per = np.maximum(self.counts - self.window + 1, 0)
        doc = np.repeat(np.arange(len(per)), per)
        starts = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per) + self.begins[doc]
        if not len(starts):
            return starts, doc, starts
        n = len(self.ids) - self.first + 1
        short = window_hashes(self.sums, self.inverse, np.arange(n), self.first)
        return starts, doc, sliding_argmin(short, self.window - self.first + 1)[starts]

    def hash_at(self, starts: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        if which and not hasattr(self, "other"):
            self.other = prefix_sums(self.hashes[self.ids, 1], BASES[1])
        return window_hashes(*((self.sums, self.inverse) if not which else self.other), starts, length)


def _steps(batches: Iterator[pa.RecordBatch], field: str = "") -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Steps of a batch with their words, of the column `text` or of a field of the struct `row`."""
    for batch in batches:
        texts = binary_texts(row_field(batch, field) if field else batch)
        for lo, hi in spans(texts):
            yield batch.slice(lo, hi - lo), [t.split() for t in texts[lo:hi]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once. The count is a partial aggregate; its table is written, so that the join
    shuffles both sides on its own and may split a hot key's rows."""
    often = save(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "often")
    return rows.join(often, key, "left_semi")


def _chosen(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        table = WordTable(hash_words)
        for batch, words in _steps(batches):
            w = Words(words, window, table)
            starts, doc, at = w.anchors()
            if not len(at):
                continue
            new = np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]
            at, doc = at[new], doc[new]
            ahead, back = at + w.half <= w.ends[doc], at - (w.half - w.first) >= w.begins[doc]
            right = w.hash_at(np.where(ahead, at, w.ends[doc] - w.half), w.half)
            left = w.hash_at(np.where(back, at - (w.half - w.first), w.begins[doc]), w.half)
            key = column(batch, "key").to_numpy(zero_copy_only=False)[doc]
            cols = [_signed(w.hash_at(at, w.first)), pa.array(key), pa.array((at - w.begins[doc]).astype(np.int32)), _signed(right), _signed(left)]
            yield pa.RecordBatch.from_arrays(cols, ["h", "key", "pos", "ahead", "back"])

    return map_arrow(docs, run, "h long, key long, pos int, ahead long, back long")


def _candidate_windows(w: Words, sides: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and documents of the full windows whose 18-word part repeats. sides: a document's int32 numbers, place*2 + side."""
    starts, doc, at = w.anchors()
    if not len(starts):
        return starts, doc
    flags = np.zeros((2, len(w.ids)), bool)
    for i, blob in enumerate(sides):
        if blob:
            x = np.frombuffer(blob, ">i4").astype(np.int64)
            x = x[x // 2 < w.counts[i]]
            flags[x % 2, w.begins[i] + x // 2] = True
    ahead = at - starts <= w.window - w.half
    hit = np.where(ahead, flags[0][at], flags[1][at])
    return starts[hit], doc[hit]


def _pack(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(key, binary): a document's numbers, four bytes each; their count is bounded by its words."""
    hexed = F.array_join(F.transform(F.collect_set(value), lambda x: F.lpad(F.hex(x), 8, "0")), "")
    return rows.groupBy("key").agg(F.unhex(hexed).alias(name))


def repeated_windows(keyed: DataFrame, window: int = 35) -> DataFrame:
    """(key, sides, alone) for documents (key long, text) with candidate windows; see removed_mask for their meaning."""
    first = save(_chosen(keyed, window), "places")
    again = _repeated(first, "h")
    both = again.select("key", F.explode(F.array(F.struct(F.col("ahead").alias("h"), (F.col("pos") * 2).alias("side")), F.struct(F.col("back").alias("h"), (F.col("pos") * 2 + 1).alias("side")))).alias("x")).select("key", "x.h", "x.side")
    sides = save(_pack(_repeated(save(both, "halves"), "h"), "side", "sides"), "sides")
    held = _bounded(sides, "sides")

    def run(batches):
        table = WordTable(hash_words)
        for batch, words in _steps(batches):
            w = Words(words, window, table)
            starts, doc = _candidate_windows(w, column(batch, "sides").to_pylist())
            key = column(batch, "key").to_numpy(zero_copy_only=False)[doc]
            cols = [_signed(w.hash_at(starts, w.window)), _signed(w.hash_at(starts, w.window, 1)), pa.array(key), pa.array((starts - w.begins[doc]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "key", "pos"])

    windows = map_arrow(keyed.join(held, "key").select("key", "text", "sides"), run, "a long, b long, key long, pos int")
    alone = windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("pos").alias("pos")).where("n = 1")
    alone = save(_pack(alone, "pos", "alone"), "alone")
    return sides.join(alone, "key", "left")


def _bounded(packed: DataFrame, *names: str) -> DataFrame:
    """The table with a broadcast hint if its measured bytes are within the bound."""
    size = packed.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in names), F.lit(64)))).first()[0] or 0
    return F.broadcast(packed) if size <= BROADCAST_BYTES else packed


def _removed(w: Words, sides: list[bytes | None], alone: list[bytes | None]) -> np.ndarray:
    """For every word, whether a window that occurs elsewhere covers it."""
    starts, doc = _candidate_windows(w, sides)
    edge = np.zeros(len(w.ids) + 1, np.int64)
    keep = np.zeros(len(w.ids) + 1, bool)
    keep[starts] = True
    for i, blob in enumerate(alone):
        if blob:
            x = np.frombuffer(blob, ">i4").astype(np.int64)
            keep[w.begins[i] + x[x < w.counts[i]]] = False
    starts = np.flatnonzero(keep)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + w.window, -1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Every row's columns `id`, n_words, n_removed, kept (the words left, joined by one space) and kept_sha256,
    and the whole input row as struct `row` if `carry`.

    Words are runs of bytes other than space and tab to carriage return, compared unchanged. Each row is a document:
    equal rows repeat each other's windows, also under one id or a null one. Null, empty and short texts lose nothing.
    Documents are told apart by a 64-bit hash of id and text, windows by 128 bits.
    """
    own, text = F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col))
    keyed = docs.select(whole_row(docs) if carry else text.alias("text"), own.alias("id"), F.xxhash64(own, text).alias("key"))
    found = save(repeated_windows(docs.select(F.xxhash64(own, text).alias("key"), text.alias("text")), window), "windows")
    found = _bounded(found, "sides", "alone")

    def run(batches):
        table = WordTable(hash_words)
        for batch, words in _steps(batches, text_col if carry else ""):
            w = Words(words, window, table)
            gone = _removed(w, column(batch, "sides").to_pylist(), column(batch, "alone").to_pylist())
            removed, kept = np.zeros(len(words), np.int64), []
            for i, ws in enumerate(words):
                mask = gone[w.begins[i] : w.ends[i]]
                removed[i] = mask.sum()
                kept.append(b" ".join(ws if not removed[i] else [x for x, g in zip(ws, mask.tolist()) if not g]))
            digest = [hashlib.sha256(k).hexdigest() for k in kept]
            cols = [column(batch, "id"), pa.array(w.counts), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest)]
            names = ["id", "n_words", "n_removed", "kept", "kept_sha256"]
            if carry:
                cols, names = [*cols, column(batch, "row")], [*names, "row"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "id long, n_words long, n_removed long, kept string, kept_sha256 string"
    return map_arrow(keyed.join(found, "key", "left").drop("key"), run, with_row(schema, docs) if carry else schema)
