"""The corpus operators on small tables, against brute force, and in the corner cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from traceloom.llm import common, components, langid, lm, mixing, pieces, simhash, substring, topk, toxicity, warc, winnow

WORD = rb"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, row string, score string"


def words(text):
    return re.findall(WORD, (text or "").encode())


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, one id twice, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, long), (6, long), (7, passage + " tail a"), (8, "head b " + passage), (8, "head b " + passage), (9, "über çà 日本 ▁ x  y"), (9, "other text"), (None, "no id here"), (10, "12 34 !!"), (11, "x" * 50_000), (12, "\x85a\xa0b \x1fc")]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None if i == 5 else f"s{(i or 0) % 2}", None, "a", "b", "c", "d") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_substring(documents, odd, empty):
    for df in (documents, odd):
        rows = df.select("doc_id", "text").collect()
        seqs = [words(r.text) for r in rows]
        seen = Counter(tuple(w[i : i + 35]) for w in seqs for i in range(len(w) - 34))
        want = []
        for r, w in zip(rows, seqs):
            gone = [False] * len(w)
            for i in range(len(w) - 34):
                if seen[tuple(w[i : i + 35])] > 1:
                    gone[i : i + 35] = [True] * 35
            kept = b" ".join(x for x, g in zip(w, gone) if not g)
            want.append((str(r.doc_id), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
        got = substring.remove_repeats(df).collect()
        assert sorted((str(r.id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert substring.remove_repeats(empty).collect() == []
    assert substring.levels(35) == [9, 18, 35]


def test_substring_by_shuffle(documents, monkeypatch):
    want = sorted(map(tuple, substring.remove_repeats(documents).select("id", "kept_sha256").collect()))
    monkeypatch.setattr(substring, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, substring.remove_repeats(documents).select("id", "kept_sha256").collect())) == want


def brute_simhash(text):
    w = (text or "").encode().lower()
    w = re.findall(WORD, w)
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=4):
    n, group = len(fps), list(range(len(fps)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                group[find(i)] = find(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


def test_simhash(documents, odd, empty):
    for df in (documents, odd):
        rows = df.select("doc_id", "text").collect()
        fps = [brute_simhash(r.text) for r in rows]
        comp = brute_components([r.doc_id for r in rows], fps)
        got = simhash.near_duplicates(df).collect()
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted((str(r.doc_id), f"{f:016x}", str(c)) for r, f, c in zip(rows, fps, comp))
    assert simhash.near_duplicates(empty).collect() == [] and simhash.one_of_each(empty).collect() == []
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns
    want = set(r.component_id for r in simhash.near_duplicates(documents).collect())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_links_in_dense_clusters_and_hot_cells(spark):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(6):
        x = int(rng.integers(0, 2**63))
        for _ in range(120):
            fps.add(x)
            for b in rng.integers(0, 64, 3):
                x ^= 1 << int(b)
    fps = np.array(sorted(fps), np.uint64)
    want = brute_components(list(range(len(fps))), fps.tolist())
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for rows, width in ((4096, 4), (8, 4), (4096, 2)):
        roots = dict(map(tuple, components.stars(simhash.links(df, 4, rows, width)).collect()))
        got = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
        a, b = defaultdict(set), defaultdict(set)
        for i, (g, w) in enumerate(zip(got, want)):
            a[g].add(i)
            b[w].add(i)
        assert sorted(map(sorted, a.values())) == sorted(map(sorted, b.values()))


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = dict(map(tuple, components.stars(df).collect()))
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def test_pieces_equal_the_library(documents, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    m = pieces.Model.load()
    for r in [*documents.limit(60).collect(), *odd.collect()]:
        t = r.text or ""
        assert m.decode(m.encode(t)) == t and m.decode(m.encode(t, 9, 0.3)) == t
        if "▁" not in t and t and len(t) < 40_000:
            assert m.encode(t) == sp.encode(t)
    for df in (documents, odd):
        plain, a, b = (pieces.encode_pieces(df, rate=x, seed=y).collect() for x, y in ((0.0, 1), (0.1, 1), (0.1, 2)))
        texts = Counter((str(r.doc_id), r.text or "") for r in df.collect())
        assert all(r.lossless for r in plain + a + b)
        assert Counter((str(r.doc_id), m.decode(r.pieces)) for r in a) == texts
        assert {r.pieces_sha256 for r in a} != {r.pieces_sha256 for r in b}
        assert sorted(r.pieces_sha256 for r in a) == sorted(r.pieces_sha256 for r in pieces.encode_pieces(df, seed=1).collect())
        assert sum(r.n_pieces for r in a) > sum(r.n_pieces for r in plain)
    assert pieces.encode_pieces(empty).collect() == []


def test_batched_merges_equal_the_agenda(documents):
    m = pieces.Model.load()
    limit = 1 << 22
    kept = pieces.Remembered(m, 3, limit)
    units = [m.units(r.text) for r in documents.limit(30).collect()]
    got = kept.encode(units, [[i % 4 for i in range(len(u))] for u in units])
    assert got == [b"".join(kept.one(x, i % 4) for i, x in enumerate(u)) for u in units]


def test_every_occurrence_draws_its_own_dropout(spark):
    m = pieces.Model.load()
    assert len(m.encode("a")) == 1  # one merge, of the space and the letter
    n = 4000
    rows = [(1, " ".join(["a"] * n)), (2, " ".join(["information"] * n))]
    got = {r.doc_id: r for r in pieces.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0.08 * n < got[1].n_pieces - n < 0.12 * n  # five standard deviations are 0.024 n
    parts = "|".join(m.decoded[i].decode() for i in got[2].pieces)
    assert len(set(re.split(r"\|(?= )", parts))) > 20  # four at most with four keys


def brute_top(rows, k=20, every=20):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk(spark, sf, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert sorted(map(tuple, topk.top_k(table).collect())) == brute_top(rows)
    nan = float("nan")
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [-1.0, 3.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in few], "vec_id long, embedding array<float>, id int")
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute_top(few)
    assert topk.top_k(df.limit(0)).collect() == []
    same = spark.createDataFrame([(i, [0.25, 0.75], 0) for i in range(300)], df.schema)
    assert sorted(map(tuple, topk.top_k(same).collect())) == brute_top([(i, [0.25, 0.75]) for i in range(300)])


def test_warc(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    big = "<p>" + "z" * 2000
    odd = spark.createDataFrame([(9001, "u\r\nX: y", big), (9002, None, big), (9003, "v", big), (9004, "v", None), (9005, "v", ""), (9006, "v", "s"), (9007, "w", "s"), (None, "n", big), (9003, "v", big)], "page_id long, url string, html string")
    df = pages.union(odd).withColumn("key", warc.F.lit(1)).withColumn("refers", warc.F.lit("x"))
    folder = f"file://{tmp_path}/w"
    warc.write_archives(df, folder, shards=3, roll=4000)
    got = warc.read_archives(spark, folder).collect()
    rows = df.collect()
    last = defaultdict(lambda: -1)
    for r in rows:
        if r.page_id is not None:
            last[r.html or ""] = max(last[r.html or ""], r.page_id)
    want = []
    for r in rows:
        p = (r.html or "").encode()
        refers = last[r.html or ""] if len(p) >= 1000 and r.page_id is not None and r.page_id < last[r.html or ""] else None
        want.append((str(r.page_id), len(p), hashlib.sha1(p).hexdigest(), "revisit" if refers else "response", str(refers)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    names = sorted(p.name for p in (tmp_path / "w/data").iterdir() if p.name.endswith(".gz"))
    assert len(names) > 3
    warc.write_archives(df, f"{folder}2", shards=3, roll=4000)
    assert all((tmp_path / "w/data" / n).read_bytes() == (tmp_path / "w2/data" / n).read_bytes() for n in names)
    assert warc.round_trip(df.limit(0), f"{folder}3").collect() == []


def test_warc_judges_rows_of_one_id_by_their_own_payload(spark, tmp_path, monkeypatch):
    a, b, c = ("<p>" + x * 2000 for x in "abc")
    df = spark.createDataFrame([(1, "u", a), (1, "u", b), (2, "u", a), (3, "u", a), (3, "u", c), (4, "u", c), (5, "u", a)], "page_id long, url string, html string")
    want = sorted([(1, "revisit", 5, None), (1, "response", None, b), (2, "revisit", 5, None), (3, "revisit", 5, None), (3, "revisit", 4, None), (4, "response", None, c), (5, "response", None, a)], key=str)
    for i, limit in enumerate((1 << 26, -1)):
        monkeypatch.setattr(warc, "small", lambda df, n, limit=limit, small=common.small: small(df, n, limit))
        warc.write_archives(df, f"file://{tmp_path}/{i}", shards=2)
        got = warc.read_archives(spark, f"file://{tmp_path}/{i}").collect()
        assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload and bytes(r.payload).decode()) for r in got), key=str) == want


def brute_winnow(t, k=winnow.GRAM, w=winnow.WINDOW):
    grams = [int(winnow.winnow([t[i : i + k]])[0][0][0]) for i in range(len(t) - k + 1)] if len(t) >= k else []
    if not grams:
        return [(int(h), 0) for h in winnow.winnow([t])[0][0]]
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        part = grams[i : i + w]
        j = i + max(x for x in range(len(part)) if part[x] == min(part))
        if (grams[j], j) not in out[-1:]:
            out.append((grams[j], j))
    return out


def test_winnow(spark, documents, odd, empty):
    texts = ["", "short", "a" * 100, "日本語" * 30] + [r.text[:400] for r in documents.limit(10).collect()]
    assert [list(zip(map(int, h), map(int, p))) for h, p in winnow.winnow(texts)] == [brute_winnow(t) for t in texts]
    for parts in (1, 7):
        rows = documents.select("doc_id", "text").orderBy("doc_id", ascending=False).collect()
        got = {r.doc_id: r for r in winnow.fingerprint_edits(documents, parts=parts).collect()}
        assert len(got) == len(rows)
        for i, r in enumerate(rows):
            n, t = rows[(i + 1) % len(rows)].text, r.text
            edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            f = [winnow.winnow([x])[0][0] for x in (t, edited, n)]
            g = got[r.doc_id]
            assert (g.n_chars, g.edited_sha256, g.fingerprint, g.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), winnow.as_text(f[0]), winnow.as_text(f[1]))
            assert g.near_edited == pytest.approx(winnow.likeness(f[0], f[1])) and g.near_next == pytest.approx(winnow.likeness(f[0], f[2]))
    assert winnow.fingerprint_edits(odd).count() == odd.count() and winnow.fingerprint_documents(odd).count() == odd.count()
    assert winnow.fingerprint_edits(empty).collect() == []
    assert winnow.fingerprint_edits(odd.where("doc_id = 4")).first().near_next == 1.0


def test_mixing(documents, odd, empty):
    assert mixing.targets({"a": 100, "b": 10, None: 10}) == {"a": 75.0, "b": 30.0, None: 15.0}
    for df in (documents, odd):
        rows = mixing.mix_copies(df).collect()
        assert len(rows) == df.count() and all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
        assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))
        assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix_copies(df.repartition(5)).collect()))
    rows = mixing.mix_copies(documents).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1.5 * max(r.size for r in own)
    assert Counter(r.doc_id for r in mixing.mix(documents).collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mixing.mix_copies(empty).collect() == [] and mixing.mix(empty).collect() == []


def test_langid(documents, odd, empty):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    got = langid.identify(documents).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd).collect()}
    assert {i for i, p, _ in by if p == "und"} == {1, 2, 3, 10}
    assert langid.identify(empty).collect() == []


def test_forward_sums_all_segmentations():
    vocab = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"bc", b"abc"]
    rng = np.random.default_rng(1)
    probs = np.append(rng.random(len(vocab)), 0.0)
    probs /= probs.sum()
    p = dict(zip(vocab, probs))

    def total(w):
        return 1.0 if not w else sum(p[w[:n]] * total(w[n:]) for n in range(1, len(w) + 1) if w[:n] in p)

    for w in (b" abc", b" aabcbc", b"x", b" " + b"abc" * 3):
        assert langid.word_scores([w], langid.Pieces(vocab), probs[:, None])[0, 0] == pytest.approx(math.log(total(w)))
    long = b" " + b"abcab" * 2000
    assert langid.word_scores([long], langid.Pieces(vocab), probs[:, None])[0, 0] < -1000


def test_lm(documents, odd, empty):
    for df in (documents, odd):
        rows = df.select("doc_id", "text").collect()
        docs = [(r, [w.lower() for w in words(r.text)] + [b""]) for r in rows]
        count = Counter(w for r, ws in docs if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for w in ws)
        n, v = sum(count.values()), len(count)
        want = sorted((str(r.doc_id), len(ws), sum(w in count for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 3)) for r, ws in docs)
        got = lm.score(df).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
        assert all(math.isfinite(r.score) for r in got)
    got = [r for r in lm.score(documents).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm.score(empty).collect() == []


def test_lm_tables_are_normalised():
    rng = np.random.default_rng(2)
    k = 9
    params = {"r": rng.normal(size=(k + 1, lm.WIDTH)).astype("f4"), "q": rng.normal(size=(k, lm.WIDTH)).astype("f4"), "c": rng.normal(size=(3, lm.WIDTH)).astype("f4"), "b": rng.normal(size=k).astype("f4")}
    ctx = rng.integers(0, k + 1, (3, 50)).astype(np.int16)
    table = lm.Normalised(params)
    every = np.stack([table.log_probs(np.full(50, t), ctx) for t in range(k)])
    assert np.allclose((10**every).sum(axis=0), 1, atol=1e-4)
    assert np.allclose(every, np.stack([lm.log_probs(params, np.full(50, t), ctx) for t in range(k)]), atol=1e-4)


def test_toxicity(spark, sf, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert np.mean([r.score for r in held if toxic[r.doc_id]]) > 3 * np.mean([r.score for r in held if not toxic[r.doc_id]])
    few = labels.limit(0)
    assert {r.score for r in toxicity.score(odd, few).collect()} == {0.5}
    assert toxicity.score(odd, labels).count() == odd.count() and toxicity.score(empty, few).collect() == []
