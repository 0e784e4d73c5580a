"""Sources read by scope, date and offset, and zipped checklists."""

import io
import json
import zipfile

import pytest

from fieldmark.sources import connectors
from fieldmark.sources.archive import Archive, read_archive
from fieldmark.sources.windowed import Page, Provider, Question, TooMany, divided, is_last, pages, windowed_source

SCHEMA = "id long, scope string, changed string"


def provider(folder, page=7, most=50, counted=True, end=lambda last: last):
    """Rows of a file, by scope and day of change; a file "down" names scopes that don't answer from an offset on."""

    def chosen(q):
        rows = [tuple(r) for r in json.loads((folder / "rows").read_text())]
        return sorted(r for r in rows if r[1] == q.scope and (q.since or "") <= r[2] <= q.until)

    def fetch(q, offset, n):
        down = folder / "down"
        if down.exists() and json.loads(down.read_text()).get(q.scope, 1 << 40) <= offset:
            raise ConnectionError(f"{q.scope} is down")
        with (folder / "asked").open("a") as log:
            log.write(json.dumps([*q, offset, n]) + "\n")
        rows = chosen(q)
        return Page(rows[offset : offset + n], end(offset + n >= len(rows)))

    return Provider(fetch, (lambda q: len(chosen(q))) if counted else None, page, most)


def rows_of(n, scope, day="2024-01-{:02d}"):
    return [(i, scope, day.format(i % 20 + 1)) for i in range(n)]


def test_pages_end():
    assert is_last(Page([(1,)], "true"), False) and is_last(Page([(1,)], True), False) and is_last(Page([], "false"), False)
    assert not is_last(Page([(1,)], "False"), True) and is_last(Page([(1,)]), True) and not is_last(Page([(1,)]), False)


@pytest.mark.parametrize("end", [lambda last: last, lambda last: str(last).lower(), lambda last: None])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 49, 50])
def test_all_pages(tmp_path, n, end):
    (tmp_path / "rows").write_text(json.dumps(rows_of(n, "a")))
    p = provider(tmp_path, end=end)._replace(silence_ends=False)
    if n == 50 and end(True) is None:  # nothing says that row 50 is the last, and no more may be asked
        with pytest.raises(TooMany):
            list(pages(p, Question("a", None, "2024-02-01")))
    else:
        assert sorted(pages(p, Question("a", None, "2024-02-01"))) == sorted(rows_of(n, "a"))


def test_days_are_divided_until_all_can_be_paged(tmp_path):
    rows = rows_of(200, "a")
    (tmp_path / "rows").write_text(json.dumps(rows))
    p = provider(tmp_path)
    questions = divided(p, Question("a", None, "2024-02-01"))
    assert len(questions) > 3 and all(p.count(q) <= 50 for q in questions)
    assert sorted(r for q in questions for r in pages(p, q)) == sorted(rows)
    (tmp_path / "rows").write_text(json.dumps([(i, "a", "2024-01-05") for i in range(51)]))
    with pytest.raises(TooMany):
        divided(p, Question("a", None, "2024-02-01"))
    with pytest.raises(TooMany):  # without a count it is found out while paging, and still is no end
        list(pages(provider(tmp_path, counted=False), Question("a", None, "2024-02-01")))


def test_stream_moves_its_dates_when_all_was_read(spark, tmp_path):
    (tmp_path / "rows").write_text(json.dumps(rows_of(60, "a") + rows_of(20, "b")))
    (tmp_path / "day").write_text("2024-01-10")
    cursor = tmp_path / "cursor"

    def run(scopes, checkpoint="c", full=False):
        spark.dataSource.register(windowed_source("windowed_rows", SCHEMA, provider(tmp_path), scopes, lambda: (tmp_path / "day").read_text(), str(cursor)))
        stream = spark.readStream.format("windowed_rows").option("full", str(full)).load()
        got = []
        query = stream.writeStream.foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / checkpoint)).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(got)

    def asked(scope):
        return [x for x in map(json.loads, (tmp_path / "asked").read_text().splitlines()) if x[0] == scope]

    until = lambda day: lambda r: r[2] <= day
    everything = rows_of(60, "a") + rows_of(20, "b")
    (tmp_path / "down").write_text(json.dumps({"b": 7}))
    with pytest.raises(Exception, match="b is down"):
        run(["a", "b"])
    assert not cursor.exists()
    (tmp_path / "down").unlink()
    assert run(["a", "b"]) == sorted(filter(until("2024-01-10"), everything))
    (tmp_path / "day").write_text("2024-01-15")
    (tmp_path / "down").write_text(json.dumps({"b": 0}))
    with pytest.raises(Exception, match="b is down"):
        run(["a", "b"])
    assert json.loads(cursor.read_text()) == {"a": "2024-01-10", "b": "2024-01-10"}
    (tmp_path / "down").unlink()
    (tmp_path / "asked").write_text("")
    later = sorted(r for r in everything if "2024-01-10" <= r[2] <= "2024-01-15")
    assert run(["a", "b"]) == later
    assert {x[1] for x in asked("a")} == {"2024-01-10"}  # the lower bound of the days of change was asked for

    # another checkpoint goes on from the file's dates; a scope that is new starts from the beginning, others go on; "full" reads all again
    (tmp_path / "day").write_text("2024-01-20")
    (tmp_path / "rows").write_text(json.dumps(everything + rows_of(9, "c")))
    known = json.loads(cursor.read_text())
    assert known["a"] >= "2024-01-10"
    want = [r for r in everything if known[r[1]] <= r[2] <= "2024-01-20"] + rows_of(9, "c")
    assert run(["a", "b", "c"], "c2") == sorted(want)
    assert run(["a", "b", "c"], "c3", full=True) == sorted(everything + rows_of(9, "c"))


def test_batch_reads_in_parts(spark, tmp_path):
    (tmp_path / "rows").write_text(json.dumps(rows_of(200, "a") + rows_of(3, "b")))
    spark.dataSource.register(windowed_source("windowed_batch", SCHEMA, provider(tmp_path), ["a", "b", "none"], lambda: "2024-02-01"))
    df = spark.read.format("windowed_batch").load()
    assert sorted(map(tuple, df.collect())) == sorted(rows_of(200, "a") + rows_of(3, "b"))
    assert df.rdd.getNumPartitions() > 5
    since = spark.read.format("windowed_batch").option("since", "2024-01-18").load()
    assert sorted(map(tuple, since.collect())) == sorted(r for r in rows_of(200, "a") + rows_of(3, "b") if r[2] >= "2024-01-18")


TAXON = "id\ttaxonID\tscientificName\tacceptedNameUsage\tkingdom\tphylum\tclass\torder\tfamily\ttaxonRank\ttaxonomicStatus"
ROWS = [
    ("1\t1\tLantana camara L.\t\tPlantae\t\t\t\t\tSPECIES\tACCEPTED", "IN", "Alien", "Invasive"),
    ("2\t2\tAcacia old Syn.\tAcacia new Acc.\tPlantae\t\t\t\t\tSPECIES\tSYNONYM", "IN", "Alien", "Null"),
    ("3\t3\tMystery plant \"Foo\t\tPlantae\t\t\t\t\tSPECIES\tACCEPTED", "IN", "Native|Alien", "Null"),
    ("4\t4\tDoubtful thing Bar\t\tPlantae\t\t\t\t\tSPECIES\tDOUBTFUL", "IN", "Alien", "Null"),
    ("5\t5\tMimosa diplotricha var. inermis (Adelb.) Veldkamp\t\tPlantae\t\t\t\t\tVARIETY\tACCEPTED", "us", "Alien", "not invasive"),
    ("6\t6\tSus scrofa\t\tAnimalia\t\t\t\t\tSPECIES\tACCEPTED", "IN", "", "Invasive"),
]


def members(newline="\n"):
    taxon, place, profile = [TAXON], ["id\tlocationID\tcountryCode\toccurrenceStatus\testablishmentMeans"], ["id\tisInvasive\thabitat"]
    for line, country, means, invasive in ROWS:
        i = line.split("\t")[0]
        taxon.append(line)
        place += [f"{i}\tX\t{country}\tPresent\t{means}", f"{i}\tX\t{country}\tPresent\tlater"]
        profile.append(f"{i}\t{invasive}\tTerrestrial")
    return {n: newline.join([*x, ""]) for n, x in (("taxon", taxon), ("distribution", place), ("speciesprofile", profile))}


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n\n"])
def test_archive_is_its_unpacked_folder(spark, tmp_path, newline):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members(newline).items():
            z.writestr(f"{name}.txt", text)
            (tmp_path / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "list.zip").write_bytes(buffer.getvalue())
    got = sorted(map(tuple, read_archive(spark, str(tmp_path / "list.zip")).collect()))
    assert got == sorted(map(tuple, connectors.read_checklist(spark, str(tmp_path)).collect()))
    assert [r[0] for r in got] == ["Acacia new", "Lantana camara", "Mimosa diplotricha var. inermis", "Mystery plant", "Sus scrofa"]
    assert got == sorted(map(tuple, read_archive(spark, f"file://{tmp_path}/list.zip").collect()))
    lines = spark.read.format(Archive.name()).load(str(tmp_path / "list.zip"))
    assert lines.rdd.getNumPartitions() == 3
    assert {(r["member"], r["count"]) for r in lines.groupBy("member").count().collect()} == {("taxon", 6), ("distribution", 12), ("speciesprofile", 6)}


def test_archive_without_a_member(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "list.zip", "w") as z:
        for name, text in members().items():
            if name != "speciesprofile":
                z.writestr(f"{name}.txt", text)
    got = read_archive(spark, str(tmp_path / "list.zip")).collect()
    assert len(got) == 5 and {r.is_invasive for r in got} == {None}
