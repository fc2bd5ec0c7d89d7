"""Language-model scores of a log-bilinear model trained with noise-contrastive estimation.

Vocabulary: the end mark and the most frequent training words are classes of their own; any other word belongs to one of
HASHED classes by its first and last two bytes, and within a class has the probability (c + 1) / (N + V + 1) of the
class's own counts, one share being left for unseen words. The class of the next token is predicted by a log-bilinear
model: the context's vectors, weighted by place and added, times the classes' vectors, plus biases. It is trained in
numpy on every training token: each task descends on its own tokens from one common start, with noise shared by a batch,
and the tasks' parameters are averaged by their tokens. Scores are normalised over all classes by batched products.

Counts cover the whole corpus. The most frequent words' counts are broadcast (FREQUENT rows); the others are joined in
a shuffle, which no frequent word enters, so it has no hot key.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import WordTable, binary_texts, column, map_arrow, quoted, save, spans, usual_batches

WORDS, HASHED, FREQUENT = 192, 128, 50_000
WIDTH, CONTEXT, NOISE, BATCH, RATE, SEED = 24, 3, 64, 1024, 0.15, 3
#: Tokens that stand together in a batch.
RUN = 64
#: Tokens that a task counts before it passes its counts on.
REMEMBERED = 400_000
END = b""


def hashed_class(word: bytes) -> int:
    return zlib.crc32(word[:2] + b"|" + word[-2:]) % HASHED


def count_tokens(src: DataFrame) -> DataFrame:
    """(token, n_all, n_train) over all rows of src (text, train); the end mark is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            tokens = list(table[0].keys() | table[1].keys())
            trained = np.array([table[1][t] for t in tokens], np.int64)
            other = np.array([table[0][t] for t in tokens], np.int64)
            table[0].clear(), table[1].clear()
            for lo in range(0, len(tokens), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(tokens[part], pa.binary()).cast(pa.string()), pa.array(trained[part] + other[part]), pa.array(trained[part])], ["token", "n_all", "n_train"])

        for batch in batches:
            for text, train in zip(binary_texts(batch), column(batch, "train").to_pylist()):
                table[train].update(text.lower().split())
                table[train][END] += 1
                if len(table[0]) + len(table[1]) > REMEMBERED:
                    yield from flush()
        yield from flush()

    return map_arrow(src, run, "token string, n_all long, n_train long").groupBy("token").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


class Classes:
    """Classes of tokens, and what their words share; classes are the own words first, then the hashed ones."""

    def __init__(self, own: list[bytes], frequent: dict[bytes, int], totals: dict[int, tuple[int, int]], tokens: int):
        self.own = {w: i for i, w in enumerate(own)}
        self.frequent, self.tokens = frequent, tokens
        self.size = len(own) + HASHED
        count = np.array([frequent[w] for w in own] + [totals.get(h, (0, 0))[0] for h in range(HASHED)], np.float64)
        self.share = (count + 0.5) / (count.sum() + 0.5 * self.size)
        kinds = np.array([0] * len(own) + [totals.get(h, (0, 0))[1] for h in range(HASHED)], np.float64)
        self.log_within = np.where(np.arange(self.size) < len(own), 0.0, np.log10(count + kinds + 1))

    def rows(self, words: list[bytes]) -> np.ndarray:
        """A row a word: its class, and its training count or -1 if it is not frequent."""
        own, frequent, first = self.own.get, self.frequent.get, len(self.own)
        kind = [c if (c := own(w)) is not None else first + hashed_class(w) for w in words]
        return np.array([kind, [frequent(w, -1) for w in words]], np.int64).reshape(2, -1).T


def contexts(seq: np.ndarray, counts: np.ndarray, before: int) -> np.ndarray:
    """The classes 1 to CONTEXT places back, a row a place; before a document's start the class `before`."""
    at = np.arange(len(seq)) - np.repeat(np.cumsum(counts) - counts, counts)
    ctx = np.empty((CONTEXT, len(seq)), np.int16)
    for i in range(CONTEXT):
        ctx[i, i + 1 :] = seq[: max(len(seq) - i - 1, 0)]
        ctx[i, at <= i] = before
    return ctx


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()
    words.append(END)
    return words


def start(share: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
    rng, k = np.random.default_rng(seed), len(share)
    return {
        "r": rng.normal(0, 0.1, (k + 1, WIDTH)).astype("f4"),
        "q": rng.normal(0, 0.1, (k, WIDTH)).astype("f4"),
        "c": np.ones((CONTEXT, WIDTH), "f4") / CONTEXT,
        "b": np.log(share).astype("f4"),
    }


def _scatter(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    ids = ids.astype(np.int16)
    order = np.argsort(ids, kind="stable")
    counts = np.bincount(ids, minlength=size)
    some = np.flatnonzero(counts)
    out = np.zeros((size, rows.shape[1]), "f4")
    out[some] = np.add.reduceat(np.take(rows, order, axis=0), (np.cumsum(counts) - counts)[some], axis=0)
    return out


class Nce:
    """Descent on noise-contrastive loss, Adagrad a parameter, noise shared by a batch."""

    def __init__(self, share: np.ndarray, params: dict[str, np.ndarray], seed: int):
        self.p = {k: v.copy() for k, v in params.items()}
        self.g = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}
        self.cum, self.log_noise = np.cumsum(share), np.log(share * NOISE).astype("f4")
        self.rng, self.steps, self.tokens = np.random.default_rng(seed), 0, 0

    def step(self, target: np.ndarray, ctx: np.ndarray, place: np.ndarray) -> None:
        """One batch of runs of tokens; place: a token's in its run."""
        p, n = self.p, len(target)
        k = len(p["b"])
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), k - 1)
        vec = [np.take(p["r"], c, axis=0) for c in ctx]  # a context place: batch by width
        h = vec[0] * p["c"][0]
        for v, w in zip(vec[1:], p["c"][1:]):
            h += v * w
        qt, qn = np.take(p["q"], target, axis=0), p["q"][noise]
        against = p["b"] - self.log_noise
        pos = np.einsum("ij,ij->i", h, qt) + np.take(against, target)
        gn = h @ qn.T
        gn += against[noise]
        with np.errstate(over="ignore"):  # a vanishing gradient
            gp = np.float32(-1 / n) / (1 + np.exp(pos))  # of the loss in the score
            np.negative(gn, out=gn)
            np.exp(gn, out=gn)
            gn += np.float32(1)
            np.divide(np.float32(1 / n), gn, out=gn)
        gq = gp[:, None] * qt
        gq += gn @ qn
        ones = np.ones(n, "f4")
        # A token is the target at its own place and a context at the places after it: one scatter takes both
        # gradients of all tokens; contexts from before their run, or before the document, are added apart.
        both = np.zeros((n, 2 * WIDTH), "f4")
        np.multiply(gp[:, None], h, out=both[:, :WIDTH])
        late, apart = both[:, WIDTH:], []
        for i in range(1, CONTEXT + 1):
            part = gq * p["c"][i - 1]
            out = (place < i) | (ctx[i - 1] == k)
            apart.append((ctx[i - 1][out], part[out]))
            part[out] = 0
            late[:-i] += part[i:]
        grads = _scatter(target, both, k + 1)
        grad_q, grad_r = grads[:k, :WIDTH].copy(), grads[:, WIDTH:].copy()
        np.add.at(grad_r, np.concatenate([c for c, _ in apart]), np.concatenate([x for _, x in apart]))
        np.add.at(grad_q, noise, gn.T @ h)
        grad_b = np.bincount(target, gp, k).astype("f4")
        np.add.at(grad_b, noise, ones @ gn)
        grad_c = np.stack([np.einsum("ij,ij->j", v, gq) for v in vec])
        for name, grad in (("r", grad_r), ("q", grad_q), ("c", grad_c), ("b", grad_b)):
            self.g[name] += grad * grad
            p[name] -= np.float32(RATE if name != "c" else RATE / 10) * grad / np.sqrt(self.g[name])
        self.steps += 1
        self.tokens += n

    def learn(self, seq: np.ndarray, ctx: np.ndarray) -> None:
        """Steps over all tokens; a batch takes runs of RUN tokens at even distances."""
        every = np.arange(len(seq))
        n = max(1, len(seq) // (BATCH if self.steps > 200 else BATCH // 4))
        for i in range(n):
            at = np.concatenate([every[lo : lo + RUN] for lo in range(i * RUN, len(seq), n * RUN)] or [every[:0]])
            if len(at):
                self.step(seq[at], ctx[:, at], at % RUN)


def log_probs(params: dict[str, np.ndarray], seq: np.ndarray, ctx: np.ndarray, rows: int = 512) -> np.ndarray:
    """Base-10 log probability of every token's class, normalised over all classes."""
    out = np.empty(len(seq))
    qt = np.concatenate([params["q"], params["b"][:, None]], axis=1).T.copy()  # with a last row for the biases
    placed = params["r"][None] * params["c"][:, None, :]  # place, class, width
    placed = np.concatenate([placed, np.zeros_like(placed[:, :, :1])], axis=2)
    placed[0, :, -1] = 1
    top = float(np.abs(qt).max(axis=1) @ sum(np.abs(p).max(axis=0) for p in placed))  # no score is larger
    shift, ones = np.float32(max(0.0, top - 80)), np.ones(qt.shape[1], "f4")
    room = np.empty((rows, qt.shape[1]), "f4")
    for lo in range(0, len(seq), rows):
        part, own = ctx[:, lo : lo + rows], seq[lo : lo + rows]
        h = np.take(placed[0], part[0], axis=0)
        for i in range(1, CONTEXT):
            h += np.take(placed[i], part[i], axis=0)
        s = np.matmul(h, qt, out=room[: len(own)])
        got = s[np.arange(len(own)), own]
        high = s.max(axis=1, keepdims=True) if shift else 0
        if shift:
            s -= high
        np.exp(s, out=s)
        out[lo : lo + rows] = got - np.ravel(high) - np.log(s @ ones)
    return out / np.log(10)


class Normalised:
    """log_probs for contexts of three places by tables: the scores of every class after every class at a place, and the
    normalisers of all contexts, made by one matrix product a nearest class. The tables depend on the model alone."""

    def __init__(self, params: dict[str, np.ndarray]):
        placed = params["r"].astype("f8")[None] * params["c"].astype("f8")[:, None, :]
        self.scores = [p @ params["q"].astype("f8").T for p in placed]
        self.scores[0] = self.scores[0] + params["b"]
        top = [s.max(axis=1) for s in self.scores]
        near, mid, far = (np.exp(s - t[:, None]) for s, t in zip(self.scores, top))
        k = len(near)
        self.logs = np.empty((k, k, k), "f4")
        for i in range(k):
            z = np.maximum((mid * near[i]) @ far.T, 1e-300)
            self.logs[i] = np.log(z) + top[0][i] + top[1][:, None] + top[2][None, :]

    def log_probs(self, seq: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        score = sum(s[c, seq] for s, c in zip(self.scores, ctx))
        return (score - self.logs[ctx[0], ctx[1], ctx[2]]) / np.log(10)


_tables: dict[int, Normalised] = {}


def scorer(params: dict[str, np.ndarray]):
    """A function of (classes, contexts); a Python worker keeps one model's tables from task to task."""
    if len(params["c"]) != 3:
        return lambda seq, ctx: log_probs(params, seq, ctx)
    name = zlib.crc32(_pack(params).tobytes())
    if name not in _tables:
        _tables.clear()
        _tables[name] = Normalised(params)
    return _tables[name].log_probs


def _pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].reshape(-1).astype("f8") for k in ("r", "q", "c", "b")])


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, lo = {}, 0
    for k in ("r", "q", "c", "b"):
        out[k] = flat[lo : lo + like[k].size].reshape(like[k].shape).astype("f4")
        lo += like[k].size
    return out


def train(src: DataFrame, classes: Classes, first: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parameters averaged over tasks by tokens; every row of src (text) is read once."""
    shared = src.sparkSession.sparkContext.broadcast((classes, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, first = shared.value
        model, table = Nce(classes.share, first, SEED), WordTable(classes.rows)
        for batch in batches:
            texts = binary_texts(batch)
            for lo, hi in spans(texts):
                ids, counts = table.step([tokens_of(t) for t in texts[lo:hi]])
                seq = table.values[ids, 0]
                model.learn(seq, contexts(seq, counts, classes.size))
        if model.tokens:
            total = _pack(model.p) * model.tokens
            yield pa.RecordBatch.from_arrays([pa.array([model.tokens % 64]), pa.array([model.tokens]), pa.array([total.tobytes()], pa.binary())], ["part", "n", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table["total"])
        return pa.table({"n": [sum(table["n"].to_pylist())], "total": pa.array([total.tobytes()], pa.binary())})

    with usual_batches(src.sparkSession):  # a step of the descent ends where a batch does
        parts = map_arrow(src.select("text"), run, "part long, n long, total binary").groupBy("part").applyInArrow(add, "n long, total binary").collect()  # 64 rows at most
    if not parts:
        return first
    return _unpack(sum(np.frombuffer(bytes(r["total"])) for r in parts) / sum(r["n"] for r in parts), first)


def score(docs: DataFrame, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (base-10 logs).

    Learns from rows whose crc32(id) mod folds is not `fold`; rows without an id are held out. A null text is empty and
    has the end mark alone. base_score is the add-one unigram score with one share for unseen tokens; score is the
    model's, over the same tokens. Whole texts are scored, of any length; equal rows give a row each; other columns
    play no part. With nothing to learn from, counts are zero and classes equally likely.
    """
    held = F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % folds == fold, F.lit(True))
    src = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"), held.alias("held"), (~held).alias("train"))
    counts = save(count_tokens(src.select("text", "train")), "tokens")
    train_tokens, kinds = counts.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum((F.col("n_train") > 0).cast("long")), F.lit(0))).first()
    top = counts.orderBy(F.desc("n_all"), "token").limit(FREQUENT).collect()  # FREQUENT rows
    frequent = {r["token"].encode(): r["n_train"] for r in top}
    frequent.setdefault(END, 0)
    own = [END] + sorted((w for w in frequent if w != END), key=lambda w: (-frequent[w], w))[:WORDS]
    named = set(own)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(HASHED, np.int64), np.zeros(HASHED, np.int64)
        for batch in batches:
            for t, c in zip(binary_texts(batch, "token"), column(batch, "n_train").to_pylist()):
                if c and t not in named:
                    h = hashed_class(t)
                    n[h] += c
                    v[h] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(HASHED)), pa.array(n), pa.array(v)], ["h", "n", "v"])

    sums = map_arrow(counts.select("token", "n_train"), totals, "h long, n long, v long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    classes = Classes(own, frequent, {r["h"]: (r["n"], r["v"]) for r in sums}, train_tokens)
    params = train(src.where("train"), classes, start(classes.share))
    shared = docs.sparkSession.sparkContext.broadcast((classes, params))
    denominator = float(np.log10(train_tokens + kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, params = shared.value
        first, table, model_score = len(classes.own), WordTable(classes.rows), scorer(params)
        for batch in batches:
            texts, keys = binary_texts(batch), column(batch, "key").to_numpy(zero_copy_only=False)
            for lo, hi in spans(texts):
                ids, n = table.step([tokens_of(t) for t in texts[lo:hi]])
                words, kind, count = table.words, *table.values.T
                seq, doc = kind[ids], np.repeat(np.arange(hi - lo), n)
                log_count = np.log10(np.maximum(count, 0) + 1.0)
                rare, hashed = count < 0, kind >= first
                size = hi - lo
                base = np.bincount(doc, log_count[ids], size)
                model = np.bincount(doc, model_score(seq, contexts(seq, n, classes.size)) - classes.log_within[seq] + np.where(hashed[ids], log_count[ids], 0), size)
                known = np.bincount(doc[(count > 0)[ids]], minlength=size)
                info = np.stack([n.astype("f8"), known.astype("f8"), base, model], axis=1)
                mine = keys[lo:hi]
                seldom = rare[ids]
                pair, times = np.unique(doc[seldom] * len(words) + ids[seldom], return_counts=True)
                token = pa.array([b"\n%d" % k for k in mine.tolist()] + [words[i] for i in (pair % max(len(words), 1)).tolist()], pa.binary()).cast(pa.string())
                blobs = [x.tobytes() for x in info] + [None] * len(pair)
                yield pa.RecordBatch.from_arrays([token, pa.array(np.concatenate([mine, mine[pair // max(len(words), 1)]])), pa.array(np.concatenate([np.zeros(size, np.int32), times.astype(np.int32)])), pa.array(blobs, pa.binary())], ["token", "key", "n", "info"])

    keyed = src.select("doc_id", "held", F.xxhash64("doc_id", "text").alias("key"), "text")
    rows = map_arrow(keyed.select("key", "text"), run, "token string, key long, n int, info binary")
    seen = counts.where("n_train > 0").select("token", F.col("n_train").alias("c"))
    joined = rows.join(seen.hint("merge"), "token", "left")  # sorted and spilled: the vocabulary may be of any size
    value = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    found = F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)
    per = joined.groupBy("key").agg(F.sum(value).alias("log"), F.sum(found).alias("found"), F.max("info").alias("info"), F.count("info").alias("m"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(column(batch, "info").to_pylist()), "f8").reshape(-1, 4)
            m = column(batch, "m").to_numpy(zero_copy_only=False)
            log = column(batch, "log").to_numpy(zero_copy_only=False) / m
            found = column(batch, "found").to_numpy(zero_copy_only=False) // m
            known = x[:, 1].astype(np.int64) + found.astype(np.int64)
            cols = [column(batch, "key"), pa.array(x[:, 0].astype(np.int64)), pa.array(known), pa.array(x[:, 2] + log - x[:, 0] * denominator), pa.array(x[:, 3] + log)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "n_tokens", "n_known", "base_score", "score"])

    scored = map_arrow(per, unpack, "key long, n_tokens long, n_known long, base_score double, score double")
    out = keyed.select("doc_id", "held", "key").join(scored, "key")
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
