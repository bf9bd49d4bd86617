"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from corvid.llm import bpe, digest, licenses, lines, mixing, paragraphs, quality, sharding, simhash, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consectetur " * 12_000
ROWS = [
    (1, "some plain text of more than ten words for the rules to keep it here", "en", "a", 1),
    (1, "some plain text of more than ten words for the rules to keep it here", "en", "a", 1),
    (2, None, None, None, None),
    (None, "a text without an id that has more than ten words in it to be kept", "en", "a", 2),
    (3, "", "en", None, 0),
    (4, LONG, "en", "b", 3),
    (5, "tie one two three", "en", "b", 4),
    (6, "tie one two three", "en", "b", 4),
]
CLASH = ["key", "seq", "a", "b", "fp", "size", "shard", "bucket", "_key", "_text", "_rest", "n_words", "kept", "place", "text_key", "ids"]


def byte_bpe(docs):
    import public_tokenizers as p

    return bpe.digests(docs, bpe.vocabulary_file(p.path("byte_bpe_50k.tiktoken")), p.PATTERN)


ONE_ROW_EACH = {
    "lines": lines.report,
    "bpe": byte_bpe,
    "paragraphs": paragraphs.remove_repeats,
    "simhash": simhash.near_duplicates,
    "mixing": mixing.mix,
    "quality": quality.judge,
    "digest": digest.compare_edited,
    "suffixes": suffixes.remove_repeats,
    "sharding": sharding.assign,
}
CARRY = {"quality": quality.clean, "lines": lines.dedup, "simhash": simhash.keep_one, "mixing": mixing.mixed_documents}


def clashing(docs):
    return docs.withColumns({c: F.lit(7) for c in CLASH})


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_a_row_for_every_row(spark, name):
    docs = clashing(spark.createDataFrame(ROWS, SCHEMA))
    got = ONE_ROW_EACH[name](docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    same = [r for r in got if r.doc_id == 1]
    assert name == "sharding" or same[0] == same[1] or name == "digest" or name == "mixing"


@pytest.mark.parametrize("name", [*ONE_ROW_EACH, "licenses"])
def test_empty_table(spark, name):
    empty = spark.createDataFrame([], SCHEMA)
    assert (ONE_ROW_EACH | {"licenses": licenses.scan})[name](empty).collect() == []


@pytest.mark.parametrize("name", CARRY)
def test_columns_are_carried(spark, name):
    docs = clashing(spark.createDataFrame(ROWS, SCHEMA))
    out = CARRY[name](docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == 7 for r in rows for c in CLASH)
    assert CARRY[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_simhash_of_nulls(spark):
    rows = simhash.near_duplicates(spark.createDataFrame(ROWS, SCHEMA)).collect()
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == "0" * 16 == by[3].fingerprint and by[3].component_id == 2
    assert by[None].component_id is None and by[6].component_id == 5


def test_repeats_of_a_repeated_row(spark):
    text = "".join(chr(97 + k * k % 23) for k in range(400))
    rows = suffixes.remove_repeats(spark.createDataFrame([(1, text, "", "", 0)] * 2, SCHEMA)).collect()
    assert [r.n_removed for r in rows] == [400, 400]


def test_components_of_a_long_chain(spark):
    from corvid.llm.common import components

    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in components(edges).collect()} == {0}
