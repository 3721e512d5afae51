"""The stages against plain versions of what each must decide."""

import os
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from keyorder.llm import langid, packing, quality, queries
from keyorder.llm.common import shared_dir
from test_jaccard import brute as jaccard_brute
from test_quality import brute as word_counts


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.documents(spark, sf)
    before = docs
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        after = written(stage(spark, before, sf), name)
        assert after.columns == docs.columns
        kept[name] = {r.doc_id for r in after.collect()}
        before = after
    texts = {r.doc_id: r.text for r in docs.collect()}

    model = langid.fit(docs)
    accepted = {r.doc_id for r in langid.identify(docs, "text", model).collect() if r.accepted}
    assert kept["language_id"] == accepted and len(accepted) > 0.95 * len(texts)

    failed = {i for i in accepted if word_counts(texts[i])[0] < 10 or 100 * word_counts(texts[i])[4] > 20 * word_counts(texts[i])[0]}
    assert not kept["quality_rules"] & failed
    clean = {i for i in accepted - failed if word_counts(texts[i])[2:] == (0, 0, 0)}
    assert clean <= kept["quality_rules"]

    whole = jaccard_brute([(i, texts[i]) for i in sorted(kept["quality_rules"])])
    assert kept["near_duplicates"] == {i for i, (_, c) in whole.items() if i == c}

    rows = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == kept["near_duplicates"]
    coder = packing.WordCoder(queries.tokenizer_path("word_bpe_49k.json"), 1)
    ids = dict(zip(texts, coder.encode(pa.array(list(texts.values()), pa.string())), strict=True))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in rows) == sum(len(ids[i]) for i in kept["near_duplicates"])


def written(df, name):
    return quality.materialize(df, f"test-{name}")


def test_told_languages_judge_quality(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.documents(spark, sf).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    found = pipeline.language_id(spark, docs, sf)
    told = {r.doc_id: r.lang_pred for r in langid.identify(docs, "text", langid.fit(docs)).collect()}
    assert {r.doc_id: r.lang for r in found.collect()} == {r.doc_id: told[r.doc_id] for r in found.collect()} and None not in told.values()


def test_columns_of_any_name_stay(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.documents(spark, sf)
    names = ["typical", "m0", "_group", "group", "row", "_letters", "lang_pred", "score", "accepted", "kept", "distance", "n_words", "component_id", "_row", "c0", "id", "start", "ids"]
    wide = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in names})
    for name, stage in pipeline.STAGES:
        plain, more = stage(spark, docs, sf), stage(spark, wide, sf)
        if name == "packing":
            assert plain.columns == more.columns and plain.count() > 0
            break
        assert more.columns == wide.columns
        rows = more.collect()
        assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in names)
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect())


def test_stages_leave_one_table(spark):
    before = set(os.listdir(shared_dir(spark)))
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert {m.rsplit("-", 1)[0] for m in set(os.listdir(shared_dir(spark))) - before} == {"pipeline-packing"}


def test_empty_and_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "same words in both of these", "en", "s", 5), (3, "same words in both of these", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            stage(spark, part, "").collect()


def test_repeated_rows_are_one_document(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, "en", "s", 5), (3, "other", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_repeated_ids_with_other_texts(spark):
    shared, unique = (" ".join(f"{w}{i}" for i in range(200)) for w in ("a", "b"))
    near = " ".join(f"c{i}" for i in range(200))
    rows = [(1, shared), (5, shared), (5, unique), (7, near), (7, f"{near} end"), (None, shared), (None, "seven words that no other row has"), (8, "x"), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = [(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect()]
    assert sum(i == 7 for i, _ in found) == 1
    left = [x for x in found if x[0] != 7]
    assert sorted(left, key=str) == sorted([rows[0], rows[2], *rows[6:]], key=str)
