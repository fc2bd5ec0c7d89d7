"""Merge-type piece encoding with seeded merge dropout, and decoding.

The vocabulary is a public SentencePiece BPE model with byte fallback. Encoding puts every adjacent pair whose join is a
piece on an agenda, best piece first and leftmost of ties, and merges from it; with dropout, a candidate taken from the
agenda is skipped if a hash of (key, place, piece) falls below the rate, for good, though a later neighbour may offer
another. No piece holds a space after another character, so each run of spaces with what follows it is encoded alone.
Every occurrence of a word has a key of its own, a hash of seed, document and place: reruns agree, and equal words in
different places are drawn apart. What is remembered of a word is its encoding without dropout and the merges that make
it; an occurrence whose key skips none of these has that encoding, any other is encoded under its key. Pieces' bytes
joined, without the first space, are the text.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import column, map_arrow, mix, quoted, spans

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 11
#: Units that a Python worker remembers, about 280 bytes each, and their characters.
REMEMBERED, REMEMBERED_CHARS = 900_000, 16_000_000
SEGMENT = re.compile(r" *[^ \n]+|\n| +")
_MASK = (1 << 64) - 1
_STEP = 0xD1B54A32D192ED03


class Model:
    """pieces: texts and numbers, best first."""

    def __init__(self, pieces: list[tuple[str, int]], byte_ids: list[int], decoded: list[bytes]):
        self.rank = {p: r for r, (p, _) in enumerate(pieces)}
        self.number = [i for _, i in pieces]
        self.hashes = mix(np.arange(1, len(pieces) + 1, dtype=np.uint64)).tolist()
        self.byte_ids = byte_ids
        self.decoded = decoded
        self.whole = not any(" " in p.lstrip(" ") or ("\n" in p and len(p) > 1) for p in self.rank)

    @staticmethod
    def load(path: str = MODEL) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, decoded = [], [0] * 256, []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                decoded.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                decoded.append(b"")
            else:
                pieces.append((p.replace("▁", " "), i))
                decoded.append(p.replace("▁", " ").encode())
        order = sorted(pieces, key=lambda x: (-sp.get_score(x[1]), x[1]))
        return Model(order, byte_ids, decoded)

    def segments(self, text: str) -> list[str]:
        """Parts that no piece spans."""
        return SEGMENT.findall(text) if self.whole else [text]

    def units(self, text: str) -> list[str]:
        """A text, as after a space, cut at single spaces and line ends into names of segments: a name without a line end
        is the segment of a space and the name; one with a line end in front is that line end and the rest; any other
        segment has two line ends in front."""
        if not self.whole:
            return ["\n\n " + text]
        out = []
        for i, line in enumerate(text.split("\n")):
            if "  " in line or line[:1] == " ":
                out += ["\n"] * (i > 0) + ["\n\n" + s for s in SEGMENT.findall(line if i else " " + line)]
                continue
            words = line.split(" ")
            if i:
                words[0] = "\n" + words[0]
            out += words
        return out

    def named(self, unit: str) -> list[str]:
        """The segments of a unit's name."""
        if unit[:1] != "\n":
            return [" " + unit]
        if unit[:2] == "\n\n":
            return [unit[2:]]
        return ["\n", unit[1:]] if len(unit) > 1 else ["\n"]

    def encode_segment(self, seg: str, key: int = 0, limit: int = 0, path: list[tuple[int, int]] | None = None) -> list[int]:
        """Piece numbers. A candidate is skipped if the hash of key, place and piece is below limit. Merges, as rank and
        place, are added to `path`."""
        rank, n = self.rank.get, len(seg)
        agenda = [(r, a, a + 1, a + 2) for a in range(n - 1) if (r := rank(seg[a : a + 2])) is not None]
        heapify(agenda)
        end, begin = list(range(1, n + 1)), list(range(-1, n))  # end[a]: of the symbol at a; begin[b]: of the one that ends at b
        while agenda:
            r, a, m, b = heappop(agenda)
            if end[a] != m or end[m] != b:
                continue
            if limit and draw(key, a, self.hashes[r]) < limit:
                continue
            if path is not None:
                path.append((r, a))
            end[a], end[m], begin[b] = b, -1, a
            if a:
                p = begin[a]
                if (r := rank(seg[p:b])) is not None:
                    heappush(agenda, (r, p, a, b))
            if b < n:
                e = end[b]
                if (r := rank(seg[a:e])) is not None:
                    heappush(agenda, (r, a, b, e))
        out, a = [], 0
        while a < n:
            b = end[a]
            if (i := rank(seg[a:b])) is not None:
                out.append(self.number[i])
            else:
                out += [self.byte_ids[x] for x in seg[a:b].encode()]
            a = b
        return out

    def encode(self, text: str, key: int = 0, rate: float = 0.0) -> list[int]:
        """One text, every segment under one key. A text that is cut into segments otherwise, as by units(), has the same
        pieces without dropout."""
        if not text:
            return []
        limit = int(rate * (1 << 24))
        return [i for s in self.segments(" " + text) for i in self.encode_segment(s, key, limit)]

    def decode(self, ids) -> str:
        return b"".join(map(self.decoded.__getitem__, ids))[1:].decode()


def draw(key: int, place: int, piece: int) -> int:
    """24 bits of a keyed hash of a place in a segment and the hash of a piece."""
    x = (place + 1) * _STEP + key & _MASK ^ piece
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return (x ^ x >> 31) >> 40


def draws(key: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """draw() of many at once."""
    return mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP) + key ^ piece) >> np.uint64(40)


class Batch:
    """encode_segment for many segments at once. Whether a candidate is skipped depends on its piece, its place and the
    key alone, so the agenda's next candidate is the best one left: every round takes it in all segments together."""

    NONE = np.int32(1 << 30)

    def __init__(self, model: Model, limit: int):
        self.model, self.limit = model, limit
        self.hashes = np.array(model.hashes, np.uint64)
        self.number = np.array(model.number, np.int32)
        self.single = np.full(1 << 16, -1, np.int32)  # ranks of one-character pieces
        pairs = {}
        for p, r in model.rank.items():
            if len(p) == 1 and ord(p) < 1 << 16:
                self.single[ord(p)] = r
            for i in range(1, len(p)):
                if (x := model.rank.get(p[:i])) is not None and (y := model.rank.get(p[i:])) is not None:
                    pairs[x << 16 | y] = r
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.ranks = np.full((1 << self.bits) + 64, self.NONE, np.int32)
        for key, r in pairs.items():
            at = (key * 0x9E3779B97F4A7C15 & _MASK) >> (64 - self.bits)
            while self.keys[at] != -1:
                at += 1
            self.keys[at], self.ranks[at] = key, r

    def skips(self, rank: np.ndarray, start: np.ndarray, key: np.ndarray) -> np.ndarray:
        return draws(key, start, self.hashes[rank]) < self.limit

    def merged(self, left: np.ndarray, right: np.ndarray, start: np.ndarray, key: np.ndarray | None) -> np.ndarray:
        """Ranks of pairs' pieces; NONE where there is none or it is skipped. Without keys nothing is skipped."""
        name = left.astype(np.int64) << 16 | right
        at = (name.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(name), self.NONE, np.int32)
        own = np.flatnonzero((left >= 0) & (right >= 0))
        while len(own):
            found = self.keys[at[own]]
            hit = found == name[own]
            out[own[hit]] = self.ranks[at[own[hit]]]
            own = own[~hit & (found != -1)]
            at[own] += 1
        if key is not None:
            has = np.flatnonzero(out != self.NONE)
            out[has[self.skips(out[has], start[has], key[has])]] = self.NONE
        return out

    def encode(self, segments: list[str], keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Numbers, their counts a segment, and the merges (segment, rank and place, in order of segments) of segments of
        about equally many characters; a segment with a character that is no piece gets none."""
        own = (lambda r: None) if keys is None else keys.__getitem__
        path = []
        n = len(segments)
        sizes = np.fromiter(map(len, segments), np.int64, n)
        width = int(sizes.max())
        chars = np.frombuffer("".join([x.ljust(width, "\0") for x in segments]).encode("utf-32-le"), "<u4").reshape(n, width)
        sym = np.where(np.arange(width) < sizes[:, None], self.single[np.minimum(chars, 0xFFFF)], -1)
        known = ((sym >= 0).sum(axis=1) == sizes)[:, None]
        sym = np.where(known, sym, -1)
        start = np.tile(np.arange(width), (n, 1))
        cand = np.full((n, width), self.NONE, np.int32)
        if width > 1:
            cand[:, :-1] = self.merged(sym[:, :-1].ravel(), sym[:, 1:].ravel(), start[:, :-1].ravel(), own(np.repeat(np.arange(n), width - 1))).reshape(n, -1)
        rows, done, places = np.arange(n), np.full((n, width), -1, np.int32), np.arange(width)
        while len(rows):
            j = cand.argmin(axis=1)
            best = cand[np.arange(len(rows)), j]
            live = best != self.NONE
            if not live.all():
                done[rows[~live], : sym.shape[1]] = sym[~live]
                rows, sym, start, cand, j, best = rows[live], sym[live], start[live], cand[live], j[live], best[live]
                if not len(rows):
                    break
            w = sym.shape[1]
            at = np.minimum(places[: w - 1] + (places[: w - 1] > j[:, None]), w - 1)
            every = np.arange(len(rows))
            if keys is None:
                path.append((rows, best, start[every, j]))
            sym, start, cand = (np.take_along_axis(x, at, axis=1) for x in (sym, start, cand))
            sym[every, j] = best
            cand[every, j] = self.NONE
            if w - 1 > 1:
                right = j + 1 < w - 1
                e, c = every[right], j[right]
                cand[e, c] = self.merged(sym[e, c], sym[e, c + 1], start[e, c], own(rows[e]))
                left = j > 0
                e, c = every[left], j[left] - 1
                cand[e, c] = self.merged(sym[e, c], sym[e, c + 1], start[e, c], own(rows[e]))
        has = done >= 0
        if path:
            row, rank, place = (np.concatenate(x) for x in zip(*path))
            order = np.argsort(row, kind="stable")
            merges = row[order], rank[order], place[order]
        else:
            merges = (np.zeros(0, np.int64),) * 3
        return self.number[done[has]], has.sum(axis=1), merges


class Remembered:
    """Units' packed piece numbers without dropout and the merges that make them. A Python worker keeps it from task to
    task, and it starts anew when full."""

    def __init__(self, model: Model, seed: int, limit: int):
        self.model, self.seed, self.limit = model, seed, limit
        self.batch = Batch(model, limit)
        self.forget()

    def forget(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.chars = 0
        self.units: list[str] = []
        self.plain: list[bytes] = []
        #: Of each unit: characters of the segment that a batch may encode, 0 if none; where its merges begin; how many.
        self.lengths, self.first, self.merges = (np.zeros(0, np.int64) for _ in range(3))
        self.ranks, self.places = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        return mix(numbers * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed & _MASK))

    def one(self, unit: str, number: int) -> bytes:
        key = int(self.keys(np.array([number], np.uint64))[0])
        ids = [i for s in self.model.named(unit) for i in self.model.encode_segment(s, key, self.limit)]
        return pack(f"<{len(ids)}i", *ids)

    def parts(self, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """Indexes of positive lengths, in parts of about one length."""
        order = np.argsort(lengths, kind="stable")
        lo = int((lengths <= 0).sum())
        sizes = lengths[order]
        while lo < len(order):
            hi = min(lo + 8192, int(np.searchsorted(sizes, sizes[lo] + 2, side="right")))
            yield order[lo:hi]
            lo = hi

    def learn(self, units: list[str]) -> None:
        """Remember new units."""
        n = len(units)
        plain: list[bytes] = [b""] * n
        lengths = np.fromiter((len(u) + 1 if u[:1] != "\n" and len(u) <= 40 else 0 for u in units), np.int64, n)
        rows, ranks, places = [], [], []
        for part in self.parts(lengths):
            ids, counts, (row, rank, place) = self.batch.encode([" " + units[i] for i in part.tolist()])
            packed, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
            at = 0
            for i, end in zip(part.tolist(), ends):
                plain[i] = packed[at:end]
                at = end
            lengths[part[counts == 0]] = 0
            rows.append(part[row])
            ranks.append(rank)
            places.append(place)
        for i in np.flatnonzero(lengths == 0).tolist():
            path: list[tuple[int, int]] = []
            ids = [x for s in self.model.named(units[i]) for x in self.model.encode_segment(s, path=path)]
            plain[i] = pack(f"<{len(ids)}i", *ids)
            rows.append(np.full(len(path), i))
            ranks.append(np.array([r for r, _ in path], np.int64))
            places.append(np.array([a for _, a in path], np.int64))
        row = np.concatenate(rows or [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(row, kind="stable")
        merges = np.bincount(row, minlength=n)
        self.first = np.concatenate([self.first, len(self.ranks) + np.cumsum(merges) - merges])
        self.merges = np.concatenate([self.merges, merges])
        self.lengths = np.concatenate([self.lengths, lengths])
        if rows:
            self.ranks = np.concatenate([self.ranks, np.concatenate(ranks)[order].astype(np.int32)])
            self.places = np.concatenate([self.places, np.concatenate(places)[order].astype(np.int32)])
        self.units += units
        self.plain += plain
        self.chars += sum(map(len, units))

    def changed(self, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Indexes of the occurrences whose key skips a merge of their unit."""
        out = []
        for lo in range(0, len(ids), 1 << 15):
            own, key = ids[lo : lo + (1 << 15)], keys[lo : lo + (1 << 15)]
            n = self.merges[own]
            at = np.arange(int(n.sum())) + np.repeat(self.first[own] - (np.cumsum(n) - n), n)
            skip = self.batch.skips(self.ranks[at], self.places[at], np.repeat(key, n))
            out.append(lo + np.unique(np.repeat(np.arange(len(own)), n)[skip]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, units: list[list[str]], numbers: list) -> list[bytes]:
        """Packed numbers of texts given as units and a number for every one's key."""
        if len(self.units) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        n = sum(map(len, units))
        ids = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(units)), np.int64, n)
        self.learn(list(islice(self.numbers, len(self.units), None)))
        drawn = np.concatenate([np.asarray(d, np.uint64) for d in numbers] or [np.zeros(0, np.uint64)])
        coded = list(map(self.plain.__getitem__, ids.tolist()))
        if self.limit:
            keys = self.keys(drawn)
            at = self.changed(ids, keys)
            lengths = self.lengths[ids[at]]
            for part in self.parts(lengths):
                own = at[part]
                coded_ids, counts, _ = self.batch.encode([" " + self.units[i] for i in ids[own].tolist()], keys[own])
                packed, ends = coded_ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
                lo = 0
                for i, end in zip(own.tolist(), ends):
                    coded[i] = packed[lo:end]
                    lo = end
            for i in at[lengths == 0].tolist():
                coded[i] = self.one(self.units[ids[i]], int(drawn[i]))
        out, lo = [], 0
        for us in units:
            out.append(b"".join(coded[lo : lo + len(us)]))
            lo += len(us)
        return out


_kept: dict[tuple, Remembered] = {}


def encode_pieces(docs: DataFrame, rate: float = RATE, seed: int = SEED, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_chars, n_pieces, pieces_sha256, decoded_sha256, lossless, and pieces if `ids`.

    pieces are numbers of the public model, int32; their digest is over little-endian bytes. Null and empty texts have
    no pieces and decode to the empty text. Any other text decodes to itself, also with characters that no piece holds
    and with the mark that the model writes for a space. A document's draw depends on its id, seed and text alone, so
    equal rows are encoded alike; a null id counts as -1. Other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Model.load(model))  # one vocabulary, under 2 MB
    src = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    limit = int(rate * (1 << 24))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        name = (model, seed, limit)
        if name not in _kept:
            _kept.clear()
            _kept[name] = Remembered(m, seed, limit)
        kept = _kept[name]
        for batch in batches:
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            raw = [t.encode() for t in texts]
            numbers = [(-1 if x is None else x) for x in column(batch, "id").to_pylist()]
            for lo, hi in spans(raw):
                units = [m.units(t) if t else [] for t in texts[lo:hi]]
                salts = [(x * 0xD1B54A32D192ED03 + seed) & _MASK for x in numbers[lo:hi]]
                keys = [mix(np.arange(len(u), dtype=np.uint64) + np.uint64(x)) for u, x in zip(units, salts)]
                coded = kept.encode(units, keys)
                sha = [hashlib.sha256(c).hexdigest() for c in coded]
                back, same = [], []
                for c, t in zip(coded, raw[lo:hi]):
                    text = b"".join(map(m.decoded.__getitem__, np.frombuffer(c, "<i4").tolist()))[1:]
                    back.append(hashlib.sha256(text).hexdigest())
                    same.append(text == t)
                counts = np.array([len(c) // 4 for c in coded], np.int64)
                cols = [column(batch, "id").slice(lo, hi - lo), pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array(counts), pa.array(sha), pa.array(back), pa.array(same)]
                names = ["doc_id", "n_chars", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"]
                if ids:
                    flat = np.frombuffer(b"".join(coded), "<i4")
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat)))
                    names.append("pieces")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_chars long, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean"
    return map_arrow(src, run, schema + (", pieces array<int>" if ids else ""))
