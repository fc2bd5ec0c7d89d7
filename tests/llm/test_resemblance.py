"""Links at a Jaccard similarity of 0.8 of five-word shingles against all pairs."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from traceloom.llm import resemblance, simhash
from tests.llm.test_operators import words


def brute_shingles(text):
    w = words((text or "").encode().lower().decode())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(ids, texts, similarity=0.8):
    """The smallest id that each text reaches."""
    sets, group, by_shingle = [brute_shingles(t) for t in texts], list(range(len(texts))), defaultdict(list)

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, s in enumerate(sets):
        met = Counter(j for x in s for j in by_shingle[x]) if s else Counter({j: 0 for j in by_shingle[None]})
        for j, both in met.items():
            if both >= similarity * (len(s) + len(sets[j]) - both) - 1e-9:
                group[find(i)] = find(j)
        for x in s or [None]:
            by_shingle[x].append(i)
    least = {}
    for i in range(len(ids)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_similar_sets_share_a_signature(similarity):
    rng = np.random.default_rng(1)
    for n in [*range(1, 41), 75, 100, 124, 125, 126, 300, 1500]:
        for _ in range(30):
            pool = np.unique(rng.integers(0, 2**64, 3 * n + 5, dtype=np.uint64))
            rng.shuffle(pool)
            # The most elements that may be replaced, only taken away, or only added.
            swap = next(d for d in range(n, -1, -1) if n - d >= similarity * (n + d) - 1e-9)
            grow = next(d for d in range(n, -1, -1) if n >= similarity * (n + d) - 1e-9)
            for other in (np.r_[pool[swap:n], pool[n : n + swap]], pool[: n + grow]):
                a, b = np.sort(pool[:n]), np.sort(other)
                assert resemblance.similar(a, b, similarity)
                assert np.intersect1d(resemblance.signatures(a, similarity), resemblance.signatures(b, similarity)).size
                gap = np.abs(np.frombuffer(resemblance.profile(a), np.int32) - np.frombuffer(resemblance.profile(b), np.int32)).sum()
                assert gap <= len(np.setxor1d(a, b))
    # Sets whose hashes all lie in one part, so that most parts are empty.
    a = np.arange(100, dtype=np.uint64) << np.uint64(8)
    b = np.sort(np.r_[a[11:], a[:11] + np.uint64(1)])
    assert resemblance.similar(a, b, 0.8) and np.intersect1d(resemblance.signatures(a), resemblance.signatures(b)).size


def test_unlike_bits_are_a_lower_bound():
    rng = np.random.default_rng(2)
    for n, m in [(0, 0), (0, 1), (1, 40), (64, 65), (500, 520), (500, 600), (1020, 1030), (300, 5000)]:
        for both in {0, min(n, m) // 2, min(n, m)}:
            pool = rng.integers(0, 2**64, n + m, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - both : n - both + m])
            bound = resemblance.unlike(resemblance.sketch(a), resemblance.sketch(b))
            assert bound == resemblance.unlike(resemblance.sketch(b), resemblance.sketch(a)) <= len(np.setxor1d(a, b))
    # Sets alike by a half are told from those that must be verified.
    pool = np.unique(rng.integers(0, 2**64, 800, dtype=np.uint64))
    rng.shuffle(pool)
    assert resemblance.unlike(resemblance.sketch(pool[:600]), resemblance.sketch(pool[200:])) > 1200 * 0.2 / 1.8


def test_packed_signatures_give_every_posting():
    rng = np.random.default_rng(4)
    for limit in (50, 1 << 63):
        sig = rng.integers(0, limit, 5000, dtype=np.int64)
        sid = rng.integers(-20, 20, 5000) if limit > 50 else rng.integers(-(2**63), 2**63 - 1, 5000, dtype=np.int64)
        sig = np.r_[sig, sig[:300]]
        sid = np.r_[sid, sid[:150], sid[150:300] ^ 1]
        want = defaultdict(set)
        for g, x in zip(sig.tolist(), sid.tolist()):
            want[g].add(x)
        got = list(zip(*(x.tolist() for x in resemblance.shared(sig, sid))))
        assert sorted(got) == sorted((g, x, i) for g, s in want.items() if len(s) > 1 for i, x in enumerate(sorted(s)))
    assert [len(x) for x in resemblance.shared(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0, 0]


def edited(rng, w, share):
    return [f"e{rng.random()}" if rng.random() < share else x for x in w]


def test_classes_against_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 12, 40, 150, 600]))]
        for share in (0, 0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05):
            texts.append(" ".join(edited(rng, base, share)))
    # A large group of near copies, a chain whose ends are unlike, texts around one passage, and short ones.
    base = [f"h{i}" for i in range(120)]
    texts += [" ".join(edited(rng, base, 0.02)) for _ in range(150)]
    texts += [" ".join(f"c{i}" for i in range(4 * k, 4 * k + 90)) for k in range(30)]
    texts += [" ".join([f"p{i}" for i in range(40)] + [f"q{rng.random()}" for _ in range(30)]) for _ in range(60)]
    texts += ["", None, " \t", "one", "One", "one two", "a b c d e", "a b c d e f", "A b c d e", "a b c d e f g h i j", "a b c d e f g h i k"]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (len(texts), texts[2])]
    want = brute_classes([r[0] for r in rows], [r[1] for r in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = simhash.one_of_each(docs, size=5, similarity=0.8)
    assert kept.columns == ["doc_id", "text"]
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == sorted(set(want))
    least = {}
    for r in resemblance.classes(docs, lambda w: simhash.shingle_hashes(w, 5), simhash.majority, simhash.links).collect():
        least.setdefault(r.root, set()).add(r.id)
    by_want = defaultdict(set)
    for (i, _), c in zip(rows, want):
        by_want[c].add(i)
    assert sorted(sorted(x) for x in least.values()) == sorted(sorted(x) for x in by_want.values())


def test_odd_tables(spark):
    schema = "doc_id long, text string, id string, root string, sid string, `a.b` string"
    rows = [(None, "some words of a text here", "x", "x", "x", "x"), (None, "some words of a text here", "x", "x", "x", "x"), (5, "some words of a text here", "y", "y", "y", "y"), (7, None, "z", None, None, None), (8, "", None, None, None, None), (9, " ".join(f"l{i}" for i in range(30_000)), None, None, None, None)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, schema), size=5, similarity=0.8).collect()
    assert sorted((r.doc_id, r.id) for r in kept if r.id) == [(5, "y"), (7, "z")] and {r.doc_id for r in kept} == {5, 7, 9}
    empty = simhash.one_of_each(spark.createDataFrame([], schema), size=5, similarity=0.8)
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "id", "root", "sid", "a.b"]


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    kept = simhash.one_of_each(docs, size=5, similarity=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_classes([r.doc_id for r in rows], [r.text for r in rows])))


def test_signatures_and_sets_of_all_texts_are_not_stored(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    elements = sum(len(brute_shingles(r.text)) for r in docs.select("text").collect())
    monkeypatch.setattr("traceloom.llm.common.shared_dir", lambda _: f"file://{tmp_path}")
    simhash.one_of_each(docs, size=5, similarity=0.8).count()
    # All tables together, the postings included, take less than half the sets' 8 bytes an element.
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 4 * elements


def test_classes_where_nothing_is_broadcast(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    for name in ("common", "resemblance"):
        monkeypatch.setattr(f"traceloom.llm.{name}.BROADCAST_BYTES", 0)
    monkeypatch.setattr(resemblance, "PACKED", 5000)
    kept = simhash.one_of_each(docs, size=5, similarity=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_classes([r.doc_id for r in rows], [r.text for r in rows])))


def test_pairs_around_a_passage_are_never_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join([f"p{i}" for i in range(120)] + [f"q{rng.random()}" for _ in range(60)]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr("traceloom.llm.common.shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(resemblance, "CHUNK", 16)
    assert simhash.one_of_each(docs, size=5, similarity=0.8).count() == len(set(brute_classes(list(range(300)), texts)))
    tables = [t for t in tmp_path.iterdir() if t.name.split("-")[0] in ("met", "near", "linked", "candidates")]
    rows = {t.name: spark.read.parquet(str(t)).count() for t in tables}
    assert rows and max(rows.values()) <= 10 * 300
