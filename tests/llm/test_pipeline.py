"""The pipeline against its stages' brute-force rules."""

import hashlib
from collections import Counter

import corpus_pipeline
from traceloom.llm import common, langid, mixing, pieces, resemblance, simhash, substring
from traceloom.llm.common import save
from traceloom.llm.pipeline import language_id
from tests.llm.test_resemblance import brute_classes
from tests.llm.test_operators import words


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r for r in docs.collect() if any(map(str.isalpha, r.text or ""))]
    comp = brute_classes([r.doc_id for r in rows], [r.text for r in rows])
    rows = [r for r, c in zip(rows, comp) if r.doc_id == c]
    seqs = [words(r.text) for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in seqs for i in range(len(w) - 34))
    texts, table = {}, []
    for r, w in zip(rows, seqs):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        texts[r.doc_id] = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else r.text
        table.append((r.doc_id, texts[r.doc_id], r.source))
    cut = spark.createDataFrame(table, "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix_copies(cut).collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    m = pieces.Model.load()
    assert Counter(r.doc_id for r in got) == Counter({k: v for k, v in copies.items() if v})
    assert all(r.lossless and m.decode(r.pieces) == texts[r.doc_id] and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark):
    from tests.llm.test_operators import DOCS

    rows = [(1, None, None, None, None, "a", "b", "c", "d"), (2, "", "en", "s", 0, "a", "b", "c", "d"), (3, "some text here", None, None, 14, "a", "b", "c", "d"), (3, "some text here", None, None, 14, "a", "b", "c", "d"), (None, "another one", "en", "s", 11, "a", "b", "c", "d")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, DOCS)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if i < 4:
                assert out.columns == docs.columns
                docs = save(out, "test")
        assert out.count() >= 0


def test_texts_stay_where_no_language_was_learned(spark):
    rows = [(1, "some text", None), (2, "12 34", None), (3, None, None), (4, "more über", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got) == [(1, "some text", None), (4, "more über", None)]


def test_stages_hand_python_small_batches(spark, monkeypatch):
    bound, mapped = common.BATCH_BYTES, common.map_arrow

    def checked(df, f, schema):
        def run(batches):
            def small(batches):
                for batch in batches:
                    assert batch.nbytes < 1.5 * bound, f"a batch of {batch.nbytes} bytes"
                    yield batch

            return f(small(batches))

        return mapped(df, run, schema)

    for module in (langid, pieces, resemblance, simhash, substring):
        monkeypatch.setattr(module, "map_arrow", checked)
    text = "concat_ws(' ', transform(sequence(1, 400), x -> concat('w', (x * 7 + id * 31) % 1009, 'x', id % 1500)))"
    docs = spark.range(3000, numPartitions=1).selectExpr("id as doc_id", f"{text} as text", "'en' as lang", "'s' as source")
    docs = save(docs, "test").coalesce(1)
    assert docs.selectExpr("sum(length(text))").first()[0] > 4 * bound / 2
    for name, stage in corpus_pipeline.STAGES[:3] + corpus_pipeline.STAGES[4:]:
        assert stage(spark, docs, "").count() > 0, name
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with common.usual_batches(spark):
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != held == str(bound)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == held
