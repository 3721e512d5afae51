"""Language identification by compression.

Every language has a raw-content zstandard dictionary of its texts.  A text is
lower-cased, then compressed with each, in blocks, and the language whose
dictionary gives the fewest bytes is predicted (of equals, the one with more
labelled texts).  The margin to the runner-up decides whether the prediction is
accepted.

Fitting takes a bounded sample (``SAMPLE_DOCS`` documents a language, at most
``SAMPLE_BYTES`` of each, of the ``MAX_LANGS`` languages with most labelled
texts); counts of languages and predictions cover all rows and whole texts.  No
dictionary depends on another language's texts; one of few texts is small and
explains less, so its language may lose texts to a related larger one.

Null texts and texts without a letter are ``und`` and rejected.  With no
labelled text at all, every text is ``und``.  A text of any length is compressed
whole, repeated rows get the same answer each, an empty table gives no rows.
Columns with the names of new ones are replaced; all others are kept, whatever
they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyorder.llm.common import released, slices, text_buffer

#: Documents in the sample of a language.
SAMPLE_DOCS = 512
#: Bytes taken of each sampled document: a stretch from a place that its hash chooses.
SAMPLE_BYTES = 512
#: Texts are compressed in blocks, so that the dictionary, not the text's own beginning, explains each.
BLOCK_BYTES = 2048
LEVEL = 6
#: Least relative gain over the runner-up of an accepted prediction.
MIN_MARGIN = 0.003
#: Languages that are learned: each costs a compression of every text and at most SAMPLE_DOCS * SAMPLE_BYTES in every worker.
MAX_LANGS = 256
UNDETERMINED = "und"
CHUNK_BYTES = 1 << 20


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, n, piece): a bounded sample, even over the n rows of each language.

    Languages are counted first; rows whose hash falls under a threshold set by
    the count are read, and the smallest hashes of those are taken.
    """
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    known = labelled.filter(lang.isNotNull() & F.rlike(F.coalesce(text, F.lit("")), F.lit(r"\p{L}")))
    rows = known.select(lang.alias("_lang"), F.xxhash64(F.col(id_col), F.lit("sample")).alias("_h"), text.alias("_text"))
    counts = labelled.filter(lang.isNotNull()).groupBy(lang.alias("_lang")).agg(F.count("*").alias("_n"))
    most = counts.orderBy(F.desc("_n"), "_lang").limit(MAX_LANGS).collect()
    # At most MAX_LANGS rows, so no text is shuffled.
    counts = F.broadcast(labelled.sparkSession.createDataFrame([tuple(r) for r in most], "_lang string, _n long"))
    chance = 4.0 * SAMPLE_DOCS / F.col("_n")
    place = F.pmod(F.xxhash64("_h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.join(counts, "_lang").filter(place < chance)
    begin = F.pmod(F.col("_h"), F.greatest(F.lit(1), F.length("_text") - SAMPLE_BYTES)).cast("int") + 1
    near = near.select("_lang", "_n", "_h", F.substr("_text", begin, F.lit(SAMPLE_BYTES)).alias("piece"))
    first = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "piece"))
    return near.withColumn("_k", first).filter(F.col("_k") <= SAMPLE_DOCS).select(
        F.col("_lang").alias("lang"), F.col("_n").alias("n"), "piece"
    )


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary of each language, the most frequent language first."""
    found: dict[tuple[int, str], list[str]] = {}
    for row in sample(labelled, id_col, text_col, lang_col).collect():
        found.setdefault((-row["n"], row["lang"]), []).append(row["piece"].lower())
    # Each in full: a language with few texts must not set the size of the others.
    return {lang: "\n".join(sorted(pieces)).encode() for (_, lang), pieces in sorted(found.items())}


class Identifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.coders = []
        for data in dictionaries.values():
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            content.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=params))

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, texts: list[bytes], lettered: list[bool]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, accepted = [], [], []
        for text, letters in zip(texts, lettered, strict=True):
            if not letters or not self.langs:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                accepted.append(False)
                continue
            sizes = self.sizes(text)
            order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
            second = sizes[order[1]] if len(order) > 1 else 2 * sizes[order[0]]
            margin = 1 - sizes[order[0]] / max(1, second)
            langs.append(self.langs[order[0]])
            scores.append(margin)
            accepted.append(margin >= MIN_MARGIN)
        return langs, scores, accepted


def identify(df: DataFrame, text_col: str, dictionaries: dict[str, bytes], keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` (all by default) with lang_pred, score and accepted; one narrow pass.

    score is the relative margin, 0 to 1.  Columns of ``df`` with the names of the new ones are replaced.
    """
    new = ("lang_pred", "score", "accepted")
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    text = F.col(text_col).cast("string")
    letters = F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))
    # The columns to keep as one, out of the way of all other names.
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    inside = names.index(text_col) if text_col in names and df.schema[text_col].dataType == T.StringType() else None
    source = df.select(row, letters.alias("letters"), *([text.alias("text")] if inside is None else []))
    learned = df.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Identifier(learned.value)
        for batch in batches:
            texts = batch.column(2) if inside is None else batch.column(0).field(inside)
            for begin, end in slices(texts, CHUNK_BYTES):
                part = batch.slice(begin, end - begin)
                data, at = text_buffer(texts.slice(begin, end - begin))
                cuts = at.tolist()
                folded = [data[a:b].decode().lower().encode() for a, b in zip(cuts, cuts[1:])]
                out = model.predict(folded, part.column(1).to_pylist())
                made = (pa.array(c, t) for c, t in zip(out, (pa.string(), pa.float64(), pa.bool_()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["row", *new])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([source.schema["row"], *(T.StructField(n, t) for n, t in zip(new, kinds, strict=True))])
    return source.mapInArrow(released(run), schema).select("row.*", *new)
