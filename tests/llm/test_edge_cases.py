"""Every operator over nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from athanor.llm.audio import audio_digests, audio_patches
from athanor.llm.decontamination import find_leaks, without_leaks
from athanor.llm.language_model import interpolated_scores
from athanor.llm.licences import scan_licences
from athanor.llm.near_duplicates import kept_documents, near_duplicate_classes
from athanor.llm.packing import pack_documents
from athanor.llm.secrets import redact_secrets, scan_secrets, secret_digests
from athanor.llm.sharding import histogram_shards
from athanor.llm.toxicity import toxicity_scores, without_toxic
from athanor.llm.training_order import write_training_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, slot string, score string, spans string, kept string, n long, keys string, id string, key string"


def _row(i, t):
    return (i, t, None, None, None, 1, "s", "x", "y", "z", 2, "k", "i", "q")


ROWS = [_row(1, None), _row(2, ""), _row(3, "  \n\t "), _row(4, "one"), _row(5, "same words here again and again"), _row(5, "same words here again and again"), _row(6, "same words here again and again"), _row(None, "no id at all"), _row(7, "long " * 40_000), _row(8, "x" * 60_000), _row(9, "\x00 odd   ſecret: K \U0001f600")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(1, 10)] + [(4, None, None)], "doc_id long, quality int, toxic int")


def _benchmark(spark):
    return spark.createDataFrame([(1, "same words here again and again"), (2, None), (3, ""), (4, "one")], "item_id long, text string")


PER_ROW = {
    "secrets": lambda s, d: scan_secrets(d),
    "secret_digests": lambda s, d: secret_digests(d),
    "redacted": lambda s, d: redact_secrets(d),
    "licences": lambda s, d: scan_licences(d),
    "shards": lambda s, d: histogram_shards(d, shards=4),
    "audio": lambda s, d: audio_digests(d),
    "near": lambda s, d: near_duplicate_classes(d),
    "toxicity": lambda s, d: toxicity_scores(d, _labels(s)),
    "language_model": lambda s, d: interpolated_scores(d),
}
OTHERS = {
    "packing": lambda s, d: pack_documents(d),
    "order": lambda s, d: write_training_order(d),
    "patches": lambda s, d: audio_patches(d),
    "leaks": lambda s, d: find_leaks(d, _benchmark(s)),
    "without_leaks": lambda s, d: without_leaks(d, _benchmark(s)),
    "without_toxic": lambda s, d: without_toxic(d, _labels(s)),
    "kept": lambda s, d: kept_documents(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_every_row(spark, docs, name):
    assert len(PER_ROW[name](spark, docs).collect()) == len(ROWS)


@pytest.mark.parametrize("name", [*PER_ROW, *OTHERS])
def test_empty_table(spark, none, name):
    assert (PER_ROW | OTHERS)[name](spark, none).collect() == []


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_others_run(spark, docs, name):
    OTHERS[name](spark, docs).collect()


def test_near_duplicates_of_odd_rows(spark, docs):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicate_classes(docs).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 2, 5, True), (6, 2, 5, False)} <= got
    assert (None, 1, None, True) in got
    kept = sorted((r.doc_id or 0) for r in kept_documents(docs).collect())
    assert kept == [0, 1, 2, 3, 4, 5, 7, 8, 9]


def test_leaks_of_odd_rows(spark, docs):
    got = sorted((r.doc_id, r.item_id, r.start, r.end, r.distance) for r in find_leaks(docs, _benchmark(spark)).collect())
    assert got == [(4, 4, 0, 3, 0), (5, 1, 0, 31, 0), (5, 1, 0, 31, 0), (6, 1, 0, 31, 0)]


def test_equal_texts_have_equal_audio(spark, docs):
    rows = audio_digests(docs).filter("doc_id in (5, 6)").drop("doc_id").distinct().collect()
    assert len(rows) == 1


def test_clashing_names_are_replaced(spark, docs):
    out = histogram_shards(docs, shards=4)
    assert out.columns.count("size") == 1 and dict(out.dtypes)["slot"] == "bigint"
    assert dict(scan_secrets(docs).dtypes)["spans"].startswith("array")
    assert out.filter(F.col("size") != F.coalesce(F.octet_length("text"), F.lit(0)) + 1).count() == 0


def test_packing_and_order_of_odd_rows(spark, docs):
    """Null ids, repeated rows and clashing names: every row's ids come out, as often as it occurs."""
    pieces = pack_documents(docs, length=64).collect()
    assert sum(r.start == 0 for r in pieces) == len(ROWS) and sum(r.start == 0 and r.doc_id is None for r in pieces) == 1
    assert sum(r.start == 0 and r.doc_id == 5 for r in pieces) == 2
    rows = write_training_order(docs).collect()
    begun = [i for r in rows for i, start in zip(r.doc_ids, r.doc_starts) if start == 0]
    assert sorted(map(str, begun)) == sorted(str(r[0]) for r in ROWS)


def test_scratch_can_be_dropped(spark, tmp_path):
    from athanor.llm.scratch import Scratch, drop_scratch

    table = Scratch(spark, "test").write(spark.range(3), "t")
    assert table.count() == 3
    path = table.inputFiles()[0].removeprefix("file://")
    drop_scratch()
    import os

    assert not os.path.exists(path)


def test_near_duplicates_want_integer_ids(spark):
    with pytest.raises(TypeError):
        near_duplicate_classes(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_rows_without_an_id_are_decontaminated(spark, docs):
    more = docs.unionByName(spark.createDataFrame([_row(None, "and same words here again and again too")], SCHEMA))
    left = without_leaks(more, _benchmark(spark))
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in ROWS if r[0] not in (4, 5, 6)) and left.columns == more.columns
