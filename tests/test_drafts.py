"""Drafted questions run through search and gate; feedback newest first."""

import datetime

from pyspark.sql import functions as F

from lyceum.operators import events
from lyceum.plans import course


def test_drafts_are_searched_and_judged(spark):
    texts = ["Kinetic energy is the energy of motion. Work changes kinetic energy.", "A lattice is a regular arrangement of points. The lattice repeats in space.", "Entropy counts the states of a system. Entropy never falls in isolation."]
    pages = spark.createDataFrame([(str(i), t, f"Page {i}", f"w/{i}.md", "w", False, None) for i, t in enumerate(texts)], "id string, content string, title string, file_path string, module string, time_sensitive boolean, location string")
    drafts = spark.createDataFrame(
        [
            (7, "What is kinetic energy?", "w/0.md", ["kinetic energy"]),
            (7, "What is kinetic energy?", "w/0.md", ["kinetic energy"]),  # repeated: judged again
            (8, "What is kinetic energy?", "w/gone.md", ["kinetic energy"]),  # another page
            (9, "What does the lattice repeat in?", "w/1.md", ["tensor"]),  # another term
            (10, "What does the lattice repeat in?", "w/1.md", None),  # no term expected
            (11, "Who won the football world cup last year?", "w/2.md", ["entropy"]),
            (12, None, None, None),
            (13, "", "w/2.md", []),
        ],
        "id int, query string, file_path string, terms array<string>",
    )
    got = course.check_drafts(pages, drafts)
    assert got.columns == ["id", "query", "file_path", "terms", "search_finds_it"]
    assert sorted((r.id, r.search_finds_it) for r in got.collect()) == [(7, True), (7, True), (8, False), (9, False), (10, True), (11, False), (12, False), (13, False)]
    assert course.check_drafts(pages, drafts.limit(0)).count() == 0


def test_newest_feedback_first(spark):
    day = datetime.date
    rows = spark.createDataFrame([(1, day(2024, 1, 1)), (5, day(2024, 1, 9)), (3, day(2024, 1, 10)), (4, day(2024, 1, 4)), (6, None), (None, day(2024, 1, 9))], "id long, day date")
    got = events.newest(rows, F.lit("2024-01-10").cast("date")).orderBy("place").collect()
    assert [(r.place, r.id) for r in got] == [(0, 5), (1, 4), (2, 3), (3, None)]
    assert [r.id for r in events.newest(rows, F.lit("2024-01-10").cast("date"), 0).collect()] == [3]
    assert events.newest(rows.limit(0), F.lit("2024-01-10").cast("date")).count() == 0
