"""Texts reach Python functions in shares of bounded size, and nothing is lost between them."""

from unittest import mock

import duckdb
import pyarrow as pa
import pytest

from bondsight.functions import textfns as tf
from bondsight.operators import corpus as c
from bondsight.operators import shares as sh

LINE = "It rained in the town. " * 9 + "On May 5, 2024 it didn't.\n"
#: 64 texts of 256 kB, none, an empty one, and one beyond a share's size.
TEXTS = [LINE * (1 << 18 >> 8)] * 64 + [None, "", LINE * (3 << 12)]


def task(name):
    """The function that a task runs over Arrow batches."""
    docs = mock.MagicMock()
    docs.where.return_value = docs
    getattr(c, name)(docs)
    return docs.select.return_value.mapInArrow.call_args[0][0]


@pytest.mark.parametrize(("name", "found"), [("sentences", tf.sentences_of), ("logical_lines", tf.lines_of), ("dates", tf.find_dates)])
def test_tasks_hold_a_share_of_a_batch(spark, name, found):
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(TEXTS)), "text": TEXTS})
    ids = [set(out.column("doc_id").to_pylist()) for out in task(name)(iter([batch]))]
    per_text = sh.SHARE_BYTES // len(TEXTS[0])
    assert max(map(len, ids)) <= per_text + 2 and len(ids) > 64 // (per_text + 1)
    assert set().union(*ids) == {i for i, t in enumerate(TEXTS) if found(t or "")}


def test_shares_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": TEXTS})
    assert [t for share in sh.shares(iter([batch, batch.slice(60)]), "text") for t in share.column("text").to_pylist()] == [*TEXTS, *TEXTS[60:]]
    assert not list(sh.shares(iter([batch.slice(0, 0)]), "text"))


def test_each_text_in_spark(spark):
    docs = spark.createDataFrame([(1, "One. Two.", "a"), (2, None, "b"), (3, "Three", None)], "doc_id long, text string, of string")
    assert sorted(map(tuple, c.sentences(docs, "of").collect())) == [(1, 0, 4, "One.", "a"), (1, 5, 9, "Two.", "a"), (3, 0, 5, "Three", None)]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(sh.BATCH_BYTES)


def test_entities_without_a_semicolon():
    assert tf.html_lines("<h1>A &amp; B&amp</h1><p>&copy; &copyx &am &#38;&#38 &nosuch;</p>", False) == "A & B&\n© ©x &am && &nosuch;"
    assert tf.html_lines("<h1>A &amp; B&amp</h1><p>&copy; &copyx &am &#38;&#38 &nosuch;</p>", False, closed=True) == "A & B&amp\n© &copyx &am &&#38 &nosuch;"


@pytest.mark.parametrize("name", ["N02_html_to_lines", "N03_boilerplate_drop"])
def test_titles_cut_inside_an_entity(spark, tmp_path, name):
    """Pages of larger tables have titles that end in &amp, as text was cut after it was escaped."""
    from bondsight import plans

    rows = [(i, f"u{i}", f"<html><head><title>x</title></head><body><article><h1>{t}</h1><p>{t} a &amp; b</p></article></body></html>") for i, t in enumerate(["R&amp;D &amp", "R&am", "&amp;&amp;&a", "A &", "&quo"] * 6)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, plans.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(plans.ORACLES[name]).fetchall())
