"""Language ID (operator 5): the language whose zstandard dictionary compresses a text best.

Each language has a raw-content dictionary: excerpts of texts known to be in it. A text is cut to its letters in
lower case, then compressed once per language, in blocks that each start anew from the dictionary, so a long text
doesn't become its own dictionary. The language with the fewest bytes wins; a narrow margin to the next marks the
answer as rejected.

Dictionaries come from a bounded sample: excerpts of EXCERPT characters of about SAMPLE texts a language, those
with the least hash of text, DICTIONARY bytes at most. There are as many dictionaries as languages in the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import documents, in_small_batches

SAMPLE = 400
EXCERPT = 600
DICTIONARY = 112 << 10
BLOCK = 8 << 10
LEVEL = 3
#: Least advantage over the next language, as a part of the latter's bytes.
MARGIN = 0.02
UNKNOWN = "und"
PREDICTED = "lang_pred string, score double, rejected boolean"


def _letters(column: pa.Array) -> pa.Array:
    """Letters in lower case, each run of anything else as a space."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), r"[^\p{L}]+", " "), " ")


def dictionaries(docs: DataFrame, sample: int = SAMPLE) -> dict[str, bytes]:
    """A dictionary for each language of rows (text, lang); rows without text or lang teach nothing."""
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    by = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not counts:
        return {}
    # A hash bound for each language lets through about twice the sample.
    bound = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 2 * sample / n) * 2.0**40)]), F.col("lang"))
    at = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - EXCERPT)).cast("int") + 1
    few = known.where(by < bound).select("lang", by.alias("h"), F.substring("text", at, F.lit(EXCERPT)).alias("text"))
    least = few.groupBy("lang").agg(F.slice(F.array_sort(F.collect_set(F.struct("h", "text"))), 1, sample)["text"].alias("texts"))
    out = {}
    for r in least.toLocalIterator():
        texts = [x.encode() for x in _letters(pa.array(r.texts, pa.string())).to_pylist() if x]
        # What comes last is nearest to the text that is compressed.
        out[r.lang] = b" ".join(reversed(texts))[-DICTIONARY:]
    return {k: v for k, v in out.items() if v}


class Languages:
    def __init__(self, contents: dict[str, bytes], margin: float):
        self.names, self.margin = sorted(contents), margin
        self.compressors = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False))

    def of(self, letters: str) -> tuple[str, float, bool]:
        if not letters or not self.names:
            return UNKNOWN, 0.0, True
        data = letters.encode()
        # Each frame has a few bytes that don't depend on the language.
        sizes = sorted((sum(len(c.compress(data[k : k + BLOCK])) for k in range(0, len(data), BLOCK)), name) for c, name in zip(self.compressors, self.names, strict=True))
        score = 1.0 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
        return sizes[0][1], score, score < self.margin


def language_of(contents: dict[str, bytes], margin: float = MARGIN):
    """A function of a text column: struct of lang_pred, score and rejected.

    score is the advantage over the next language in bytes, from 0 to 1. A null text, or one without a letter, is
    `und` with score 0 and rejected; so is every text if there is no dictionary. Ties go to the first name.
    """

    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Languages(contents, margin)
        for column in columns:
            found = [known.of(x) for x in _letters(column).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))], ["lang_pred", "score", "rejected"])

    of.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(of, PREDICTED)


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text leaves 2 when divided by 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document.

    A null text, one without a letter, and every text of a table that teaches no language is `und` with score 0; a null
    doc_id counts as an empty one; every row is answered; an empty table stays empty.
    """
    in_small_batches(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    of = language_of(dictionaries(docs.where(~F.col("held_out"))))
    return docs.select("doc_id", "held_out", of("text").alias("x")).select("doc_id", "held_out", "x.*")
