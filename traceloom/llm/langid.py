"""Language identification by unigram pieces, summed over all segmentations.

A language is a probability for every piece of a fixed public vocabulary (and for every single byte). A word, with the
space before it, has the probability of all its segmentations together, by the forward algorithm; a text has the product
of its words'. Piece probabilities are fitted by expectation maximisation on a bounded sample of labelled documents
(SAMPLE a language, smallest keyed hashes). Words are scored once a task and remembered in bounded memory. Texts are taken
as they are: the vocabulary has pieces of either case, and all of them count, of any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import WordTable, binary_texts, column, map_arrow, quoted, row_field, spans, whole_row, with_row

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents a language that the fit reads, rounds of the fit, bytes of a word that the fit takes at once.
SAMPLE, ROUNDS, PART = 250, 3, 64
UNKNOWN = "und"
_KEY = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The 256 bytes, then all other pieces of the model but its control marks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    return [bytes([b]) for b in range(256)] + sorted(p for p in found if len(p) > 1)


def piece_key(piece: bytes) -> int:
    """A 64-bit polynomial of the bytes from the last to the first."""
    key = 0
    for b in reversed(piece):
        key = key * int(_KEY) + b + 1 & (1 << 64) - 1
    return key


class Pieces:
    """Finds the pieces that end at a place of many words at once; 0 to 255 are bytes, the last number is no piece. Pieces
    are told apart by 64-bit keys, which this vocabulary is checked to hold apart."""

    def __init__(self, pieces: list[bytes]):
        self.none = len(pieces)
        self.longest = max(map(len, pieces))
        self.keys, self.numbers, self.slots = {}, {}, {}
        for n in sorted({len(p) for p in pieces} - {1}):
            own = sorted((piece_key(p), i) for i, p in enumerate(pieces) if len(p) == n)
            if len({k for k, _ in own}) < len(own):
                raise ValueError("two pieces of one key")
            self.keys[n], self.numbers[n] = np.array([k for k, _ in own], np.uint64), np.array([i for _, i in own], np.int32)
            self.slots[n] = np.zeros(1 << 16, bool)
            self.slots[n][(self.keys[n] >> np.uint64(48)).astype(np.int64)] = True

    def ending(self, text: np.ndarray, end: int) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray]]:
        """For every length of which a piece ends at `end`: the length, the words that have one, and its number."""
        key = text[:, end - 1].astype(np.uint64) + np.uint64(1)
        yield 1, slice(None), text[:, end - 1].astype(np.int32)
        for n in range(2, min(self.longest, end) + 1):
            key = key * _KEY + text[:, end - n] + np.uint64(1)
            if n not in self.keys:
                continue
            rows = np.flatnonzero(self.slots[n][(key >> np.uint64(48)).astype(np.int64)])
            if not len(rows):
                continue
            at = np.minimum(np.searchsorted(self.keys[n], key[rows]), len(self.keys[n]) - 1)
            same = self.keys[n][at] == key[rows]
            if same.any():
                yield n, rows[same], self.numbers[n][at[same]]


def blocks(words: list[bytes], rows: int = 16384, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of about one length: their places in the list, lengths, and bytes as a matrix filled up with zeros."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order, lo = np.argsort(lengths, kind="stable"), 0
    while lo < len(order):
        hi = min(lo + rows, len(order))
        while hi > lo + 1 and (hi - lo) * int(lengths[order[hi - 1]]) > cells:
            hi = lo + (hi - lo) // 2
        at = order[lo:hi]
        width = max(1, int(lengths[at[-1]]))
        flat = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in at.tolist()), np.uint8)
        yield at, lengths[at], flat.reshape(len(at), width)
        lo = hi


def word_scores(words: list[bytes], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Natural log probabilities, words by languages. probs: pieces + 1 rows (the last zero) by languages."""
    out = np.zeros((len(words), probs.shape[1]))
    for at, lengths, text in blocks(words):
        width = text.shape[1]
        ring = {0: np.ones((len(at), probs.shape[1]))}
        scale = np.zeros((len(at), probs.shape[1]))
        for end in range(1, width + 1):
            total = np.zeros_like(scale)
            for n, rows, piece in pieces.ending(text, end):
                total[rows] += ring[end - n][rows] * probs[piece]
            ring[end] = total
            ring.pop(end - pieces.longest, None)
            if (done := lengths == end).any():
                out[at[done]] = scale[done] + np.log(total[done])
            if end % 12 == 0 and end < width:
                live = np.maximum(total, 1e-280)
                scale += np.log(live)
                for k in ring:
                    ring[k] = ring[k] / live
    return out


def fit(words: list[bytes], counts: np.ndarray, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by EM over all segmentations of its words; of words over PART bytes, over those
    that are cut at each PART bytes."""
    parts = [(w[lo : lo + PART], c) for w, c in zip(words, counts.tolist()) for lo in range(0, len(w), PART)]
    words, counts = [w for w, _ in parts], np.array([c for _, c in parts], np.float64)
    probs = np.full(pieces.none + 1, 1.0 / pieces.none)
    probs[-1] = 0
    for _ in range(rounds):
        got = np.zeros(pieces.none + 1)
        for at, lengths, text in blocks(words, cells=1 << 18):
            width, found = text.shape[1], {}
            alpha = np.zeros((width + 1, len(at)))
            alpha[0] = 1
            for end in range(1, width + 1):
                found[end] = list(pieces.ending(text, end))
                for n, rows, piece in found[end]:
                    alpha[end][rows] += alpha[end - n][rows] * probs[piece]
            whole = np.maximum(alpha[lengths, np.arange(len(at))], 1e-300)
            share = counts[at] / whole
            beta = np.zeros((width + 1, len(at)))
            beta[lengths, np.arange(len(at))] = 1
            for end in range(width, 0, -1):
                for n, rows, piece in found[end]:
                    flow = probs[piece] * beta[end][rows]
                    np.add.at(got, piece, alpha[end - n][rows] * flow * share[rows])
                    beta[end - n][rows] += flow
        probs = got + 0.02
        probs[-1] = 0
        probs /= probs.sum()
    return probs


def train(docs: DataFrame, pieces: list[bytes], sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Piece probabilities a language from `sample` different (id, text) of each (columns id, text, lang; no nulls)."""
    rows = docs.withColumn("t", F.xxhash64("text"))
    best = Window.partitionBy("lang").orderBy("h", "id", "t")
    chosen = rows.select("lang", "id", "t", F.xxhash64("id", F.lit(17)).alias("h")).distinct()
    chosen = chosen.withColumn("n", F.row_number().over(best)).where(F.col("n") <= sample).select("lang", "id", "t")
    texts = rows.join(F.broadcast(chosen), ["lang", "id", "t"])  # sample narrow rows a language
    texts = texts.groupBy("lang", "id", "t").agg(F.first("text").alias("text"))  # equal rows once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table: dict[str, Counter] = {}
            for lang, text in zip(column(batch, "lang").to_pylist(), binary_texts(batch)):
                table.setdefault(lang, Counter()).update(text.split())
            for lang, own in table.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.binary()), pa.array(list(own.values()))], ["lang", "word", "n"])

    words = map_arrow(texts.select("lang", "text"), count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def own(table: pa.Table) -> pa.Table:
        order = sorted(zip(table["word"].to_pylist(), table["n"].to_pylist()))
        probs = fit([b" " + w for w, _ in order], np.array([n for _, n in order], np.float64), Pieces(pieces))
        return pa.table({"lang": table["lang"][:1], "probs": pa.array([probs.tobytes()], pa.binary())})

    got = words.groupBy("lang").applyInArrow(own, "lang string, probs binary").collect()
    return {r["lang"]: np.frombuffer(bytes(r["probs"])) for r in sorted(got, key=lambda r: r["lang"].encode())}


def identify(docs: DataFrame, folds: int = 5, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, carry: bool = False) -> DataFrame:
    """One row per input row, with the whole input row as struct `row` if `carry`: doc_id, held_out, lang_pred, score (posterior of the prediction under equal priors).

    Learns from rows with text, language and id whose crc32(id) mod folds is not 0; rows without an id count as held
    out. A null text or one without a letter is `und` with score 0, as is every text if nothing was learned. Whole
    texts are scored, of any length. Equal texts get equal results. Ties go to the smaller language name.
    """
    own, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    held = F.coalesce(F.crc32(own.cast("string").cast("binary")) % folds == 0, F.lit(True))
    src = docs.select(whole_row(docs) if carry else text.alias("text"), own.cast("long").alias("id"), held.alias("held"))
    pieces = load_pieces(vocabulary)
    learn = docs.select(own.cast("long").alias("id"), text.alias("text"), F.col(quoted(lang_col)).cast("string").alias("lang"), held.alias("held"))
    model = train(learn.where("not held and lang is not null and text is not null").drop("held"), pieces, sample)
    langs = list(model)
    probs = np.stack([model[x] for x in langs], axis=1) if langs else np.zeros((len(pieces) + 1, 0))
    shared = docs.sparkSession.sparkContext.broadcast((pieces, langs, probs))  # 32,000 pieces by languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, langs, probs = shared.value
        finder = Pieces(pieces)
        table = WordTable(lambda words: word_scores([b" " + w for w in words], finder, probs))
        for batch in batches:
            raw = [t or "" for t in (row_field(batch, text_col) if carry else column(batch, "text")).to_pylist()]
            texts = [t.encode("utf-8", "replace") for t in raw]
            best, score = [], []
            for lo, hi in spans(texts):
                ids, counts = table.step([t.split() for t in texts[lo:hi]])
                for i, own in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
                    if not langs or not len(own) or not any(map(str.isalpha, raw[lo + i])):
                        best.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    total = table.values[own].sum(axis=0)
                    k = int(total.argmax())
                    best.append(langs[k])
                    score.append(float(1 / np.exp(total - total[k]).sum()))
            cols, names = [column(batch, "id"), column(batch, "held"), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            if carry:
                cols, names = [*cols, column(batch, "row")], [*names, "row"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return map_arrow(src, run, with_row(schema, docs) if carry else schema)
