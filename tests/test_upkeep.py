"""Parts that are replaced, names that are seeded, indexes that are reconciled."""

import pytest

from fieldmark.operators import evidence, maintenance


def files(folder):
    return {p.name: (p.stat().st_mtime_ns, p.read_bytes()) for p in folder.glob("*.parquet")}


def test_a_part_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "reports")
    schema = "zone string, line int"
    rows = spark.createDataFrame([(z, i) for z in "abc" for i in range(5)], schema)
    maintenance.replace_parts(rows, path, "zone", ["a", "b", "c"])
    before = {z: files(tmp_path / "reports" / f"zone={z}") for z in "abc"}
    maintenance.replace_parts(spark.createDataFrame([("b", 9)], schema), path, "zone", ["b"])
    assert sorted(map(tuple, spark.read.parquet(path).select("zone", "line").collect())) == [*[("a", i) for i in range(5)], ("b", 9), *[("c", i) for i in range(5)]]
    assert all(files(tmp_path / "reports" / f"zone={z}") == before[z] for z in "ac")
    for found, expected in ((["b"], ["b", "c"]), (["b", "d"], ["b"]), ([], ["a"])):  # rows that didn't arrive, or that nobody expected
        with pytest.raises(ValueError, match="parts"):
            maintenance.replace_parts(spark.createDataFrame([(z, 1) for z in found], schema), path, "zone", expected)
    assert spark.read.parquet(path).count() == 11


def test_seeded(spark):
    stored = spark.createDataFrame([(4, "a", "A"), (7, "b", "B")], "id long, slug string, name string")
    incoming = spark.createDataFrame([("b", "B2", 1), ("b", "B3", 2), ("d", None, 1), ("c", "C", 1)], "slug string, name string, seq int")
    got = sorted(map(tuple, maintenance.seeded(stored, incoming).collect()))
    assert got == [(4, "a", "A"), (7, "b", "B3"), (8, "c", "C"), (9, "d", None)]
    assert sorted(map(tuple, maintenance.seeded(stored.limit(0), incoming).collect())) == [(1, "b", "B3"), (2, "c", "C"), (3, "d", None)]
    assert maintenance.seeded(stored, incoming.limit(0)).count() == 2


FIRST = ("10.1/X", "A title of it", "J of it", [2019, 2020], "journal-article", None, "1234", "Müller", [])
SECOND = ("10.1/x", "https://doi.org/10.1/X", "A title of it.", 2021, "article", "journal", False)


@pytest.mark.parametrize(
    ("first", "second", "want"),
    [
        ({}, {}, set()),
        (None, {}, {("first", "absent")}),
        ({}, None, {("second", "absent")}),
        (None, None, {("first", "absent")}),
        ({"kind": "book"}, {"venue_kind": "repository", "kind": "preprint"}, {("first", "kind")}),
        ({"subtype": "preprint", "issn": None}, {}, {("first", "subtype"), ("first", "no issn")}),
        ({"journal": "bioRxiv"}, {}, {("first", "preprint"), ("first", "journal")}),
        ({"journal": "News!"}, {}, {("first", "blocked venue"), ("first", "journal")}),
        ({"title": "Other"}, {}, {("first", "title"), ("both", "title")}),
        ({"years": [2015]}, {}, {("first", "year"), ("first", "too old"), ("both", "year")}),
        ({"years": None}, {}, {("first", "year")}),
        ({"first_author": None}, {}, {("first", "no authors")}),
        ({"first_author": "Else"}, {}, {("first", "author")}),
        ({"notices": ["Retraction", "correction"]}, {"retracted": True}, {("first", "notice"), ("second", "retracted")}),
        ({}, {"venue_kind": "repository", "kind": "dataset", "doi": "10.1/other"}, {("second", "venue"), ("second", "not reviewed"), ("second", "doi")}),
        ({}, {"title": None, "year": None, "venue_kind": None, "doi": None}, set()),
        ({}, {"year": 2022}, {("both", "year")}),
    ],
)
def test_two_indexes(spark, first, second, want):
    papers = spark.createDataFrame([("p", "10.1/x", "A Title of It", "Muller, A.", 2020, "J. of It")], evidence.PAPERS)
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    row = lambda base, schema, change: [] if change is None else [tuple(change.get(n, v) for n, v in zip(names(schema), base, strict=True))]
    a = spark.createDataFrame(row(FIRST, evidence.FIRST_INDEX, first), evidence.FIRST_INDEX)
    b = spark.createDataFrame(row(SECOND, evidence.SECOND_INDEX, second), evidence.SECOND_INDEX)
    got = evidence.index_violations(papers, a, b, blocked=("News",)).collect()
    assert {(r["index"], r["violation"]) for r in got} == want and len(got) == len(want)
