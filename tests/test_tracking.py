"""Small cases of program tracking and floors: nulls, ties, empty tables, columns that pass through."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import health as HL
from tidewatch.operators import tracking as T

PROGRAMS = "name string, status string, last_checked string, snapshot_hash string, last_changed string, notes string"
SOURCES = "source_id string, program_names string, signal string"
RESULTS = "source_id string, ord int, ok boolean, snapshot_hash string, changes int"
JUDGMENTS = "source_id string, program_name string, ord int, relevant boolean, classified boolean, confidence string, new_status string, why string"
COUNTS = "source_id string, rows int, sections int, previous int, pre_screened int, boards int, unreadable int"


def run(spark, results, judgments, sources=(("s", "A | B", None),)):
    programs = spark.createDataFrame([("A", "open", "", "h0", "", "kept"), ("B", None, "", "h0", "", None), ("C", "open", "", "h0", "", "")], PROGRAMS)
    out, said = T.tracked(programs, spark.createDataFrame(list(sources), SOURCES), spark.createDataFrame(results, RESULTS), spark.createDataFrame(judgments, JUDGMENTS), F.lit("now"))
    assert out.columns == programs.columns
    return {r.name: tuple(r)[1:] for r in out.collect()}, [(r.name, r.was, r.status) for r in said.orderBy("ord").collect()]


def test_empty_tables_change_nothing(spark):
    got, said = run(spark, [], [])
    assert got == {"A": ("open", "", "h0", "", "kept"), "B": (None, "", "h0", "", None), "C": ("open", "", "h0", "", "")} and said == []


def test_a_failed_source_is_checked_and_keeps_its_hash(spark):
    got, _ = run(spark, [("s", 1, False, "h1", None), ("unlisted", 2, True, "h2", 5)], [])
    assert got["A"] == ("open", "now", "h0", "", "kept") and got["C"] == ("open", "", "h0", "", "")


def test_judgments_count_in_order(spark):
    said = lambda k, status, **more: tuple({"source_id": "s", "program_name": "A", "ord": k, "relevant": True, "classified": True, "confidence": "high", "new_status": status, "why": ""} .__or__(more).values())
    rows = [said(1, "closed"), said(2, "closed"), said(3, "dormant", confidence="low"), said(4, "unknown"), said(5, "elsewhere"), said(6, "dormant", classified=None), said(7, "open"), said(8, "open", program_name="B", confidence=None)]
    got, found = run(spark, [("s", 1, True, "h1", 0)], rows)
    assert found == [("A", "open", "closed"), ("A", "closed", "open"), ("B", "", "open")]
    assert got["A"] == ("open", "now", "h1", "now", "kept") and got["B"] == ("open", "now", "h1", "now", None)
    assert run(spark, [], rows, [("s", "A", " LOW ")])[1] == []


@pytest.mark.parametrize(
    ("row", "error"),
    [
        (("s", None, None, None, None, None, None), ""),
        (("s", 0, 0, 5, None, None, None), "returned 0 rows, down from 5 tracked rows"),
        (("s", 0, 0, 5, 2, None, None), ""),
        (("s", 3, 1, None, None, 4, 2), ""),
        (("s", 3, 1, None, None, 4, 3), "3 of 4 boards could not be read"),
        (("floor", 3, 1, None, None, 0, 0), "parsed only 1 sections, expected at least 2"),
        (("floor", 2, 9, None, None, 0, 0), "parsed only 2 rows, expected at least 3"),
    ],
)
def test_floors(spark, row, error):
    got = HL.plausible(spark.createDataFrame([row], COUNTS), spark.createDataFrame([("floor", 3, 2)], "source_id string, min_rows int, min_sections int")).first()
    assert (got.ok, got.error) == (error == "", error)


def test_cells_and_notes(spark):
    df = spark.createDataFrame([(" a|b \n c ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.cell(F.col("t"))).collect()] == ["a\\|b c", ""]
    empty = F.lit(None).cast("string")
    note = T.notes(empty, F.lit(None).cast("boolean"), empty, empty, empty, F.lit(True), empty, F.lit("changed"))
    assert [tuple(x) for x in df.select(note).first()[0]] == [("", "page changed on the source")]


def test_every_new_row_of_the_pin_query_is_fresh(spark):
    from tidewatch.plans import catalog

    sf = "/root/testdata/sf0.001"
    new = catalog.both_boards(spark, sf)[1].count()
    today = catalog.pins_refresh(spark, sf).where(F.col("deadline") == "2024-03-05").count()
    assert today == new
