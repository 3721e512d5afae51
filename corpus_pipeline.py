"""A corpus pipeline over ``documents``: the stages in order, each written and read again.

What every stage makes of odd rows: null, empty and wordless texts have no
language and go in the first stage (a later stage alone: the base rules of
quality reject them, near_duplicates keeps each, packing packs its closing id).
Texts of any length are taken whole.  Rows that repeat an id and a text are one
document in near_duplicates and as many as they are elsewhere; rows that repeat
an id with another text, and rows without an id, are documents of their own.  An
empty table gives no rows.  More columns, whatever they are called, stay until
packing, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyorder.llm import jaccard, langid, packing, quality
from keyorder.llm.common import discard, documents, materialize, scratch, write_table
from keyorder.llm.queries import packed, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with numbered columns, so that none is taken for one that an operator adds; and the number of each."""
    numbered = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*numbered.values()), numbered


def _named(rows: DataFrame, numbered: dict[str, str], **changed: str) -> DataFrame:
    return rows.select(*(F.col(changed.get(c, n)).alias(c) for c, n in numbered.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells clearly; that language becomes their ``lang``, by which quality is judged."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    rows, of = _numbered(docs)
    return _named(langid.identify(rows, of["text"], model).filter("accepted"), of, lang="lang_pred")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source.

    Documents are written with their counts, so these are taken once and no text is shuffled.
    """
    rows, of = _numbered(docs)
    counted = materialize(quality.statistics(rows, of["text"]), "pipeline-counted")
    by = of["lang"], of["source"]
    return _named(quality.judge(counted, quality.fit(counted, *by), *by).filter("kept"), of)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of similar documents.

    Rows that repeat an id and its text are one document; rows that repeat an id
    with another text are documents of their own.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
        return _near_duplicate_rows(docs)
    found = materialize(jaccard.join(docs, "doc_id", "text"), "pipeline-near")
    gone = found.filter("doc_id != component_id").select("doc_id").distinct()
    # A merge at every size: the list of what goes grows with the input.
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def _near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """As ``near_duplicates`` where ids repeat or are null: rows are numbered, and what stays is decided for each row."""
    rows, of = _numbered(docs)
    rows = rows.dropDuplicates([of["doc_id"], of["text"]]).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "pipeline-rows")  # so a row's number stays
    found = materialize(jaccard.join(rows, "row", of["text"]), "pipeline-near").select("row", "component_id")
    ranked = found.join(rows.select("row", F.col(of["doc_id"]).alias("id")).hint("merge"), "row")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    stay = ranked.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return _named(rows.join(stay.hint("merge"), "row", "left_semi"), of)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return packed(packing.pack(docs, "doc_id", "text", tokenizer_path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

#: The stages train models and search near duplicates: no SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch(spark) as keep:  # what a stage has written on its way goes, also where it fails
            after = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep(after)
        docs = spark.read.parquet(after)
        if before:
            discard(spark, before)
        before = after
    return docs
