"""Corner cases of the corpus operators' contracts, and their models against plain versions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from traceloom.llm import common, langid, lm, mixing, simhash, substring, topk, toxicity, warc, winnow
from tests.llm.test_operators import brute_top

ODD_NAMES = "doc_id long, text string, source string, _id int, _key int, _copies int, _copy int, _text_key int, row int, i int, o int, t int, c int, n int, m int, k int, copy int, `a.b` int, `x``y` int"


def odd_docs(spark, rows):
    return spark.createDataFrame([(*r, *[j * 7 + x for x in range(16)]) for j, r in enumerate(rows)], ODD_NAMES)


def test_topk_lengths_and_large_scores(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    few = [(i, [0.5, 0.25 * i, -1.0]) for i in range(50)]
    others = [(100, []), (120, [1.0]), (140, [1.0, 2.0]), (160, [1.0, 2.0])]
    assert sorted(map(tuple, topk.top_k(df(few + others)).collect())) == brute_top(few)
    assert topk.top_k(df([(0, []), (20, [])])).collect() == []
    large = [(i, [5e5 * i + 1, 3e6, -float(i)]) for i in range(45)]  # products beyond 2**53
    assert max(s for *_, s in brute_top(large)) > 1 << 53
    assert sorted(map(tuple, topk.top_k(df(large)).collect())) == brute_top(large)
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(df([(0, [1e20]), (1, [1e20])]))


def test_topk_over_many_shelves(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("QUERIES", 4), ("SHELF_ROWS", 16), ("SLICE", 3), ("PIVOTS", 5)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, np.round(rng.normal(size=6), 2).tolist()) for i in range(400)] + [(i, [0.5] * 6) for i in range(400, 700)]
    rows += [(40, [0.25] * 6), (40, [0.25] * 6)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=7).collect()
    want = [r for r in brute_top(rows, 7) if r[0] != 40]
    assert sorted(tuple(r) for r in got if r.query_id != 40) == want
    assert len([r for r in got if r.query_id == 40]) == 21  # three rows of one id are three queries


@pytest.mark.parametrize("limit", [common.BROADCAST_BYTES, -1])
def test_mix_hands_out_copies_exactly(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rows = [(1, "x y z", "b")] * 100 + [(2, "a b", "a"), (3, "c " * 40, "c"), (None, "n m", "b"), (None, "n m", "b"), (None, "n q", "b")] + [(10 + i, "w " * i, "a") for i in range(5)]
    docs = odd_docs(spark, rows)
    docs = docs.union(docs.limit(30)) if limit > 0 else docs
    want = Counter()
    for r in mixing.mix_copies(docs).collect():
        want[r.doc_id, r.text_key] += r.copies
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.h) for r in out.select("doc_id", common.F.xxhash64("text").alias("h")).collect())
    assert got == Counter({k: v for k, v in want.items() if v})
    inputs = Counter(map(tuple, docs.collect()))
    assert all(v <= 3 * inputs[r] for r, v in Counter(map(tuple, out.collect())).items())


@pytest.mark.parametrize("limit", [common.BROADCAST_BYTES, -1])
def test_one_of_each_and_rows_of_any_names(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    long = " ".join(f"w{i}" for i in range(60))
    docs = odd_docs(spark, [(5, long, "a"), (3, long, "b"), (3, long, "b"), (9, "else here", None), (None, "no id", None), (None, None, None)])
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["3", "9", "None", "None"]
    assert set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))
    cut = substring.remove_repeats(docs, carry=True).select(*common.unpacked(docs.columns))
    assert Counter(map(tuple, cut.collect())) == Counter(map(tuple, docs.collect()))
    labelled = docs.withColumn("lang", common.F.lit("en"))
    assert langid.identify(labelled, carry=True).select(*common.unpacked(labelled.columns)).count() == 6
    pages = docs.selectExpr("doc_id page_id", "text html", "source url", "`a.b`")
    assert warc.marked(pages).count() == 6


def test_warc_again_in_one_folder_and_long_payloads(spark, tmp_path):
    long = "".join(random.Random(3).choices("abcdefgh \n<>", k=300_000))
    df = spark.createDataFrame([(1, "u", long), (2, "u", "b" * 70_000), (3, "u", long)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write_archives(df, folder, shards=2)
    first = sorted((r.page_id, r.record_type, r.refers_to, r.payload and bytes(r.payload).decode()) for r in warc.read_archives(spark, folder).collect())
    assert first == [(1, "revisit", 3, None), (2, "response", None, "b" * 70_000), (3, "response", None, long)]
    (tmp_path / "w/manifest.tmp").mkdir()
    (tmp_path / "w/manifest.tmp/part-left").write_text("of a failed run")
    warc.write_archives(df.where("page_id = 2"), folder, shards=2)
    assert [r.page_id for r in warc.read_archives(spark, folder).collect()] == [2]
    assert not (tmp_path / "w/manifest.tmp").exists() and not (tmp_path / "w/manifest/manifest.tmp").exists()


def plain_ftrl(rows, bits):
    """The method coordinate by coordinate in plain Python."""
    z, n, a, b, l1, l2 = {}, {}, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    none = 1 << bits

    def weight(i):
        bound = 0.0 if i == none else l1
        if abs(z.get(i, 0.0)) <= bound:
            return 0.0
        return -(z[i] - math.copysign(bound, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for y, at in rows:
        at = [*at, none]
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / a
            z[i] = z.get(i, 0.0) + g - s * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return {i: x for i in z if (x := weight(i))}


def plain_features(text):
    """Buckets of words, stems, neighbours and words one apart, from the package's hashes of single words."""
    words = toxicity.words_of(text.encode())
    h = [int(x) for x in toxicity.word_hashes(words)[:, 0]] if words else []
    out = set(h)
    for w in words:
        for n in toxicity.STEMS:
            if len(w) > n:
                out.add(int(common.hash_words([w[:n]], n)[0, 0]))
    for gap, salt in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        for x, y in zip(h, h[gap:]):
            out.add(int(common.mix(np.array([(x * salt + y) & (1 << 64) - 1], np.uint64))[0]))
    return sorted({x >> (64 - toxicity.BUCKET_BITS) for x in out})


def test_toxicity_equals_plain_ftrl(spark):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("an", "entor", "is", "oxical")]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)) + ["Vile, scum!"] * (i % 3 == 0))) for i in range(120)]
    rows += [rows[7]] * 50 + [(8, "another text of one id")]
    labels = [(i, int(i % 3 == 0)) for i in range(120)] + [(5, None), (6, 9), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    sampled = toxicity.sample_features(docs, table, 4, 2, 60).orderBy("h", "id", "toxic", "t").collect()
    assert len(sampled) == 60 and len({(r.id, r.t) for r in sampled}) == 60
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(tuple(plain_features(t)))
    assert all(tuple(np.frombuffer(r.at, "<i4").tolist()) in texts[r.id] for r in sampled)
    order = [(r.toxic, np.frombuffer(r.at, "<i4").tolist()) for r in sampled] * toxicity.EPOCHS
    want = plain_ftrl(order, toxicity.BUCKET_BITS)
    at, w = toxicity.fitted(toxicity.sample_features(docs, table, 4, 2, 60))
    assert dict(zip(at.tolist(), w.tolist())) == pytest.approx(want)
    bias = want.get(1 << toxicity.BUCKET_BITS, 0.0)
    for r in toxicity.score(docs, table, sample=60).collect():
        s = [1 / (1 + math.exp(-bias - sum(want.get(i, 0.0) for i in f))) for f in texts[r.doc_id]]
        assert min(abs(r.score - x) for x in s) < 1e-9


def segmentations(word, pieces):
    return [[]] if not word else [[p, *rest] for n in range(1, len(word) + 1) if (p := word[:n]) in pieces for rest in segmentations(word[n:], pieces)]


def test_em_and_posterior_by_listing_segmentations(spark, monkeypatch):
    vocabulary = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"bc", b"abc", b"Abcabcabc"]
    number = {p: i for i, p in enumerate(vocabulary)}

    def em(words, counts):
        p = np.full(len(vocabulary), 1 / len(vocabulary))
        for _ in range(langid.ROUNDS):
            got = np.zeros(len(p))
            for w, c in zip(words, counts):
                ways = segmentations(w, number)
                weights = [math.prod(p[number[x]] for x in s) for s in ways]
                for s, x in zip(ways, weights):
                    for piece in s:
                        got[number[piece]] += c * x / sum(weights)
            p = (got + 0.02) / (got + 0.02).sum()
        return p

    words, counts = [b" abc", b" abcab", b" cab", b" Abcabcabc", b" q"], np.array([5, 2, 3, 1, 4])
    assert langid.fit(words, counts, langid.Pieces(vocabulary))[:-1] == pytest.approx(em(words, counts))
    long = b" " + b"ab" * 50
    assert np.isfinite(langid.fit([long], np.array([2]), langid.Pieces(vocabulary))).all()
    monkeypatch.setattr(langid, "load_pieces", lambda path: vocabulary)
    texts = {"x": ["abc abc q", "ab cab", "abc"], "y": ["bcq bcq", "q q bc", "cc q"]}
    rows = [(i * 2 + j, t, lang) for j, (lang, ts) in enumerate(texts.items()) for i, t in enumerate(ts)]
    got = langid.identify(spark.createDataFrame(rows + rows[:1] * 40, "doc_id long, text string, lang string")).collect()
    learned = {(i, t, lang) for i, t, lang in rows if not next(r for r in got if r.doc_id == i).held_out}
    model = {}
    for lang in texts:
        table = Counter(b" " + w.encode() for _, t, own in learned if own == lang for w in t.split())
        model[lang] = em(list(table), list(table.values()))
    text = {i: t for i, t, _ in rows}
    for r in got:
        logs = {lang: sum(math.log(sum(math.prod(p[number[x]] for x in s) for s in segmentations(b" " + w.encode(), number))) for w in text[r.doc_id].split()) for lang, p in model.items()}
        best = max(logs, key=logs.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()))


def test_the_vocabulary_is_whole():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=langid.VOCABULARY)
    pieces = langid.load_pieces()
    texts = {sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    assert texts <= set(pieces) and len(pieces) == len(set(pieces)) and any(p != p.lower() for p in pieces)


def test_shared_runs_share_a_selected_gram(spark):
    rng = random.Random(2)
    n = winnow.GRAM + winnow.WINDOW - 1
    for _ in range(30):
        run = "".join(rng.choices("abc é日", k=n))
        a, b = ("".join(rng.choices("abcxyz ", k=rng.randint(0, 200))) for _ in range(2))
        (ha, pa_), (hb, pb) = winnow.winnow([a + run + "tail", "head" + b + run])
        ia = {int(h) for h, p in zip(ha, pa_) if len(a) <= p <= len(a) + n - winnow.GRAM}
        ib = {int(h) for h, p in zip(hb, pb) if len(b) + 4 <= p <= len(b) + 4 + n - winnow.GRAM}
        assert ia & ib
    docs = spark.createDataFrame([(1, "some text that is long enough to have a few selected grams, and more of it" * 3), (2, "short")], "doc_id long, text string")
    for r in winnow.fingerprint_edits(docs).collect():
        assert len(r.fingerprint) == 8 * len(r.places) and len(r.edited_fingerprint) == 8 * len(r.edited_places)
        assert all(0 <= p < r.n_chars for p in r.places) and r.places == sorted(r.places)


def test_winnow_with_equal_and_null_ids(spark):
    rows = [(3, "three " * 9), (2, "bb " * 20), (2, "aa " * 30), (2, "aa " * 30), (None, "null " * 12), (None, None), (1, "")]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    for parts in (1, 3):
        got = winnow.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), parts=parts).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)


def test_lm_joins_rare_words(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {r.doc_id: r for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 300)
    for r in lm.score(docs).collect():
        w = whole[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (w.n_tokens, w.n_known, w.train_tokens)
        assert r.base_score == pytest.approx(w.base_score) and r.score == pytest.approx(w.score)
