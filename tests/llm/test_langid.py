import zlib

import zstandard
from pyspark.sql import functions as F

from keyorder.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = queries.documents(spark, sf).select("doc_id", "lang")
    found = queries.op1_language_id(spark, sf).join(docs, "doc_id").collect()
    assert len(found) == docs.count()
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    assert sum(r.accepted for r in found) / len(found) > 0.95


def test_nulls_ties_and_more_columns(spark):
    rows = [(i, "the cat sat on the mat and the dog ran " * 3 + str(i), "en") for i in range(60)]
    rows += [(100 + i, "le chat est sur le tapis et le chien court " * 3 + str(i), "fr") for i in range(40)]
    model = langid.fit(spark.createDataFrame(rows + [(999, None, "de"), (998, "x", None), (997, "123", "it")], "doc_id long, text string, lang string"))
    assert list(model) == ["en", "fr"]
    texts = [None, "", "123 !", "the cat and the dog sat on the mat", "le chien et le chat sur le tapis", "zq", "the dog " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("*", "1 AS score", "'x' AS lang_pred", "'y' AS _letters", "'z' AS letters", "'r' AS row", "'w' AS _text")
    found = {r.doc_id: r for r in langid.identify(df, "text", model).collect()}
    assert [found[i].lang_pred for i in range(7)] == ["und", "und", "und", "en", "fr", "en", "en"]
    assert [found[i].accepted for i in range(3)] == [False] * 3 and found[3].accepted and not found[5].accepted
    assert found[0].text is None and (found[0]._letters, found[0].letters, found[0].row, found[0]._text) == ("y", "z", "r", "w")


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model == {}
    r = langid.identify(df, "text", model).first()
    assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
    assert langid.identify(df.limit(0), "text", model).collect() == []


def test_query_equals_plain_compression(spark, data):
    docs = {r.doc_id: r for r in queries.documents(spark, data).collect()}
    model = langid.fit(queries.documents(spark, data).filter(~queries.held_out()))
    coders = {}
    for lang, words in model.items():
        params = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=False, write_checksum=False, write_dict_id=False)
        coders[lang] = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
    rows = queries.op1_language_id(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r.doc_id].text or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        folded = text.lower().encode()
        sizes = {lang: sum(len(c.compress(folded[i : i + 2048])) for i in range(0, len(folded), 2048)) for lang, c in coders.items()}
        best, second = sorted(sizes.values())[:2]
        assert sizes[r.lang_pred] == best and r.score == 1 - best / second and r.accepted == (r.score >= 0.003)


def test_bound_on_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    rows = [(i, f"words of language number {i % 4}", "abcd"[i % 4] if i < 16 else "d") for i in range(20)]
    assert sorted(langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == ["a", "d"]


def test_prediction_sees_only_the_text(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.documents(spark, sf)
    model = langid.fit(docs.filter(~queries.held_out()))
    plain = langid.identify(docs.select("doc_id", "text"), "text", model, keep=["doc_id"])
    mixed = langid.identify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), "text", model, keep=["doc_id"])
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, mixed.collect()))


def test_a_language_of_one_document_leaves_the_others(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text", "lang")
    fifth = "zwylka brontu mefisk olondra quaspe tirvun hexalo dremmik pozhna ulvetti " * 10
    one = spark.createDataFrame([(10_000_000, fifth, "xx")], docs.schema)
    seen = docs.filter(~queries.held_out())
    plain, more = langid.fit(seen), langid.fit(seen.unionByName(one))
    assert set(more) == {*plain, "xx"}
    assert {lang: more[lang] for lang in plain} == plain
    held = docs.filter(queries.held_out())

    def verdicts(model):
        found = langid.identify(held, "text", model, keep=["doc_id"])
        return {r.doc_id: (r.lang_pred, r.accepted) for r in found.collect()}

    assert verdicts(more) == verdicts(plain)
    assert langid.identify(one, "text", more).first().lang_pred == "xx"
