import json

from pyspark.sql import functions as F

from fieldmark.functions import geo, text, vision
from fieldmark.operators import ingest
from fieldmark.sources import connectors
from fieldmark.streaming import ingest as streams


def rows(spark, records, schema):
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in records], 1))


COMMUNITY = {"id": 7, "uri": "u/7", "time_observed_at": "2024-03-01T23:30:00+05:30", "observed_on": "2024-03-01", "license_code": "CC-BY", "obscured": False, "geojson": {"type": "Point", "coordinates": [76.5, 11.6]}, "taxon": {"id": 1, "name": "Senna didymobotrya", "rank": "species", "iconic_taxon_name": "Plantae"}, "photos": [{"license_code": "cc-by-nc", "url": "p/square.jpg", "original_dimensions": {"width": 4, "height": 3}}]}


def test_community(spark):
    bare = {"id": 8, "uri": "u/8", "observed_on": "2024-03-02", "geojson": {"coordinates": [1.0, 2.0]}, "taxon": {"name": "X", "iconic_taxon_name": "Aves"}, "photos": [{"license_code": "all-rights", "url": "q"}], "captive": True}
    got = connectors.community(rows(spark, [COMMUNITY, bare, {"id": 9, "taxon": {"name": "Y"}}, {"id": 10}], connectors.COMMUNITY)).collect()
    assert [r.external_id for r in got] == ["7", "8"]
    assert (str(got[0].captured_at), got[0].image_url, got[0].kingdom, got[0].lat, got[0].lon) == ("2024-03-01 18:00:00", "p/medium.jpg", "Plantae", 11.6, 76.5)
    assert (str(got[1].captured_at), got[1].image_url, got[1].kingdom, got[1].captive, got[1].taxon_rank) == ("2024-03-02 00:00:00", None, "Animalia", True, "")


def test_museum_and_aquatic(spark):
    a = {"key": 1, "species": "Iguana iguana", "speciesKey": 5, "taxonRank": "UNRANKED", "decimalLatitude": 25.1, "decimalLongitude": -80.9, "year": 2020, "month": 2, "day": 30, "license": "http://creativecommons.org/licenses/by-nc/4.0/legalcode", "media": [{"type": "Sound"}, {"type": "StillImage", "identifier": "i", "license": "http://creativecommons.org/publicdomain/zero/1.0/"}]}
    b = {"key": 2, "scientificName": "Genus", "taxonRank": "GENUS", "decimalLatitude": 1.0, "decimalLongitude": 2.0, "year": 2020, "month": 2, "day": 3, "informationWithheld": "x", "basisOfRecord": "LIVING_SPECIMEN", "datasetKey": "m"}
    got = connectors.museum(rows(spark, [a, b, {"key": 3}, {**b, "key": 4, "datasetKey": "mirror"}], connectors.MUSEUM), "mirror").collect()
    assert [(r.external_id, r.taxon_rank, r.obscured, r.captive, r.image_url, r.record_licence, r.captured_at is None) for r in got[:2]] == [("1", "species", False, False, "i", "cc-by-nc", True), ("2", "genus", True, True, None, None, False)]
    assert [(r.external_id, r.basis) for r in got] == [("1", "unknown"), ("2", "living_specimen"), ("4", "mirror")]
    assert connectors.museum(rows(spark, [a, {"key": 3}], connectors.MUSEUM), broken=True).filter("unparseable").count() == 1
    c = {"key": 1, "group": "Plants", "genus": "Salvinia", "species": "molesta", "decimalLatitude": 1.0, "decimalLongitude": 2.0, "latLongAccuracy": "Accurate", "status": "Failed", "year": 2020, "month": 1}
    got = connectors.aquatic(rows(spark, [c, {**c, "key": 2, "latLongAccuracy": None, "status": "established", "day": 5, "group": "Fishes"}], connectors.AQUATIC)).collect()
    assert [(r.taxon_name, r.uncertainty_m, r.failed_introduction, r.kingdom, r.captured_at is None) for r in got] == [("Salvinia molesta", 100.0, True, "Plantae", True), ("Salvinia molesta", 50000.0, False, "Animalia", False)]


def test_checklist(spark, tmp_path):
    (tmp_path / "taxon.txt").write_text("id\tscientificName\tacceptedNameUsage\tkingdom\ttaxonomicStatus\n1\tSenna didymobotrya L.\t\tPlantae\tACCEPTED\n2\tOld name\tNew species Auth.\tPlantae\tSYNONYM\n3\tX y\t\tPlantae\tDOUBTFUL\n4\tA b var. c Auth.\t\tPlantae\tACCEPTED\n")
    (tmp_path / "distribution.txt").write_text("id\tcountryCode\testablishmentMeans\toccurrenceStatus\n1\tIN\tAlien\tPresent\n1\tin\tNative\tPresent\n1\tINDIA\tAlien\tPresent\n2\tTZ\t\tPresent\n3\tIN\tAlien\tPresent\n4\tUS\tNative|Alien\tPresent\n")
    (tmp_path / "speciesprofile.txt").write_text("id\tisInvasive\thabitat\n1\tnot invasive\tx\n1\tInvasive\tx\n2\tNull\tx\n")
    got = {(r.scientific_name, r.country): (r.means, r.is_invasive) for r in connectors.read_checklist(spark, str(tmp_path)).collect()}
    assert got == {("Senna didymobotrya", "IN"): ("Alien", True), ("New species", "TZ"): (None, None), ("A b var. c", "US"): ("Native|Alien", None)}
    names = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", "P"), ("d", "P")], "name string, kingdom string")
    matches = spark.createDataFrame([("a", "P", "EXACT", 90, 1, None), ("b", "P", "FUZZY", 95, 2, 20), ("c", "P", "FUZZY", 94, 3, None)], "name string, kingdom string, matchType string, confidence int, usageKey long, acceptedUsageKey long")
    assert {r.name: r.taxon_key for r in connectors.resolve_names(names, matches).collect()} == {"a": 1, "b": 20, "c": None, "d": None}
    assert [r.name for r in connectors.unresolved(names, matches).collect()] == ["d"]


def test_stream_takes_each_record_once(spark, tmp_path):
    folder, places = tmp_path / "in", [str(tmp_path / x) for x in ("store", "ledger", "checkpoint")]
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps(r) for r in [COMMUNITY, COMMUNITY, {**COMMUNITY, "id": 8, "obscured": True}]))
    run = lambda: streams.ingest(streams.landing(spark, str(folder), connectors.COMMUNITY), connectors.community, *places, "2030-01-01 00:00:00")
    run()
    (folder / "2.json").write_text("\n".join(json.dumps(r) for r in [COMMUNITY, {**COMMUNITY, "id": 11, "time_observed_at": "1999-05-05T00:00:00+00:00"}]))
    run()
    stored = spark.read.parquet(places[0])
    assert sorted((r.external_id, r.year) for r in stored.collect()) == [("11", 1999), ("7", 2024)]
    assert {(r.batch, r.reason): r.n for r in spark.read.parquet(places[1]).collect()} == {(0, "accepted"): 1, (0, "skipped_dupe"): 1, (0, "obscured_location"): 1, (1, "accepted"): 1, (1, "skipped_dupe"): 1}


def test_stream_with_zones_broken_records_and_failures(spark, tmp_path):
    import pytest

    folder, places = tmp_path / "in", [str(tmp_path / x) for x in ("store", "ledger", "checkpoint")]
    folder.mkdir()
    far = {**COMMUNITY, "id": 20, "geojson": {"type": "Point", "coordinates": [1.0, 1.0]}}
    (folder / "1.json").write_text("\n".join(json.dumps(r) for r in [COMMUNITY, far, {"id": 9, "taxon": {"name": "Y"}}]))
    zones = spark.createDataFrame([(3, [[(76.0, 11.0), (77.0, 11.0), (77.0, 12.0), (76.0, 12.0)]])], "id int, rings array<array<struct<x: double, y: double>>>").withColumn("bounds", geo.bounds(F.col("rings")))
    run = lambda parse: streams.ingest(streams.landing(spark, str(folder), connectors.COMMUNITY), parse, *places, "2030-01-01 00:00:00", zones, seconds=300)

    def fails(_):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        run(fails)
    assert [r.reason for r in spark.read.parquet(places[1]).collect()] == ["error: ValueError"]
    assert run(lambda raw: connectors.community(raw, broken=True)) is False
    assert [(r.external_id, r.zone_id) for r in spark.read.parquet(places[0]).collect()] == [("7", 3)]
    assert {r.reason: r.n for r in spark.read.parquet(places[1]).collect()} == {"accepted": 1, "outside_zone": 1, "unparseable": 1}


def test_outages_of_providers_alone_are_set_aside(spark):
    import pytest

    from fieldmark.sources.paged import Refused

    def down(kind):
        raise kind

    def in_a_task():
        spark.range(1).mapInPandas(lambda batches: down(ConnectionError("far away")), "id long").collect()

    got = streams.run_all({"a": lambda: 1, "b": lambda: down(Refused(503)), "c": in_a_task})
    assert got["a"] == "ok" and got["b"] == "Refused: status 503" and got["c"] != "ok"
    with pytest.raises(RuntimeError):
        streams.run_all({"b": lambda: down(TimeoutError("slow"))})
    with pytest.raises(KeyError):  # an error of the engine's own code
        streams.run_all({"a": lambda: 1, "b": lambda: down(KeyError("x"))})


def test_a_batch_that_died_between_store_and_ledger_counts_once(spark, tmp_path, monkeypatch):
    import pytest
    from pyspark.sql import DataFrame, DataFrameWriter

    folder, places = tmp_path / "in", [str(tmp_path / x) for x in ("store", "ledger", "checkpoint")]
    folder.mkdir()
    records = [{**COMMUNITY, "id": 30 + i, "time_observed_at": f"{1999 + i % 3}-05-05T00:00:00+00:00"} for i in range(9)]
    run = lambda: streams.ingest(streams.landing(spark, str(folder), connectors.COMMUNITY), connectors.community, *places, "2030-01-01 00:00:00")
    (folder / "1.json").write_text("\n".join(json.dumps(r) for r in records[:4]))
    run()
    (folder / "2.json").write_text("\n".join(json.dumps(r) for r in [*records[2:], records[8], {**COMMUNITY, "id": 50, "obscured": True}]))
    writes = DataFrameWriter.parquet

    def dies(self, path, *a, **k):
        if path.startswith(places[1]):
            raise OSError("the driver is gone")
        return writes(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(Exception, match="gone"):
        run()
    monkeypatch.setattr(DataFrameWriter, "parquet", writes)
    assert spark.read.parquet(places[0]).count() == 9  # stored, but not in the ledger
    # a part of what it stored is lost too, as after a commit that broke off
    import shutil

    lost = next(p for p in (tmp_path / "store" / "year=2000").iterdir() if p.suffix == ".parquet" and spark.read.parquet(str(p)).filter("ingest_batch = 1").count())
    gone = spark.read.parquet(str(lost)).count()
    lost.unlink()
    shutil.rmtree(tmp_path / "ledger" / "batch=1", ignore_errors=True)
    assert gone and spark.read.parquet(places[0]).count() == 9 - gone
    run()
    assert spark.read.parquet(places[0]).groupBy("external_id").count().filter("count > 1").count() == 0
    assert spark.read.parquet(places[0]).count() == 9
    assert {(r.batch, r.reason): r.n for r in spark.read.parquet(places[1]).collect()} == {(0, "accepted"): 4, (1, "accepted"): 5, (1, "skipped_dupe"): 3, (1, "obscured_location"): 1}
    assert isinstance(spark.range(1), DataFrame)


def test_pages_are_read_from_the_last_id_on(spark, tmp_path):
    from fieldmark.sources.paged import Refused, paged_source, polite

    log = tmp_path / "top"
    log.write_text("23")

    def fetch(above, n):
        top = int(log.read_text())
        return [(i, f"row {i}") for i in range(above + 1, min(above + n, top) + 1)]

    spark.dataSource.register(paged_source("rows_by_id", "id long, text string", fetch, page=10))
    run = lambda: spark.readStream.format("rows_by_id").load().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(once=True).start().awaitTermination()
    run()
    log.write_text("41")
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(1, 42))

    now, waits, answers = [0.0], [], [Refused(429, 7), Refused(503), Refused(503, 500), "ok"]

    def ask():
        a = answers.pop(0)
        if isinstance(a, Refused):
            raise a
        return a

    def sleep(s):
        waits.append(s)
        now[0] += s

    assert polite(ask, per_second=2, clock=lambda: now[0], sleep=sleep)() == "ok"
    assert [w for w in waits if w] == [7, 2, 60]


def plain_waits(batches, most, window):
    """Every request in turn, batch by batch."""
    hits, out = {}, []
    for batch in batches:
        for client, t in sorted(batch, key=lambda r: r[1]):
            mine = hits[client] = [h for h in hits.get(client, []) if t - h < window]
            wait = None if len(mine) < most else float(window - (t - mine[0]))
            if wait is None:
                mine.append(t)
            out.append((client, t, wait))
    return sorted(out, key=str)


def test_limited_requests(spark, tmp_path):
    import random

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, rng = tmp_path / "e", random.Random(4)
    folder.mkdir()
    batches = [[("a", t) for t in (0, 10, 20, 59, 60, 65)] + [("b", 1)], [("a", 100), ("a", 119), ("c", 130), ("c", 130)]]
    batches += [[(rng.choice("abcdefgh"), at + rng.randrange(40)) for _ in range(60)] for at in range(150, 400, 40)]
    batches += [[("z", 2_000)], [("z", 3_000)], [("z", 4_000)]]
    batches = [[(c, 1_000_000 + t) for c, t in b] for b in batches]
    try:
        stream = spark.readStream.schema("client string, t long").option("maxFilesPerTrigger", 1).json(str(folder)).withColumn("t", F.timestamp_seconds("t"))
        got, rows = [], []
        query = streams.limited(stream, "client", "t", 3).writeStream.foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            for k, batch in enumerate(batches):
                (folder / f"{k}.tmp").write_text("\n".join(json.dumps({"client": c, "t": t}) for c, t in batch))
                (folder / f"{k}.tmp").rename(folder / f"{k}.json")
                query.processAllAvailable()
                rows.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress[-1:]))
        finally:
            query.stop()
        assert sorted(((c, at // 1_000_000, w) for c, at, w in got), key=str) == plain_waits(batches, 3, 60)
        assert max(rows) >= 8 and rows[-1] <= 1  # the clients that stayed away are gone; "z" still is within its window
    finally:
        spark.conf.set(provider, before)


def test_stream_windows(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:59"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:00:30")], "client string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted((r.client, r.in_window) for r in streams.requests_in_window(df, "client", "t").collect()) == [("a", 1), ("a", 2), ("a", 2), ("b", 1)]
    df.write.json(str(tmp_path / "e"))
    stream = spark.readStream.schema("client string, t timestamp").json(str(tmp_path / "e"))
    q = streams.monthly_counts(stream, "t", ["client"]).writeStream.format("memory").queryName("months").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.client, r.n) for r in spark.table("months").collect()} == {("a", 3), ("b", 1)}
    q = streams.distinct_within(stream, ["client"], "t", "1 hour").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2


def test_geometry(spark):
    square = '{"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,4],[0,4],[0,0]], [[1,1],[3,1],[3,3],[1,3],[1,1]]]}'
    multi = '{"type": "MultiPolygon", "coordinates": [[[[0,0],[2,0],[2,2],[0,2]]], [[[10,10],[12,10],[12,12],[10,12]]]]}'
    df = spark.createDataFrame([(square,), (multi,)], "g string").withColumn("r", geo.from_geojson(F.col("g")))
    inside = lambda x, y: geo.contains(F.col("r"), F.lit(float(x)), F.lit(float(y)))
    got = df.select(inside(0.5, 0.5), inside(2, 2.1), inside(11, 11), inside(5, 5), geo.bounds(F.col("r")), geo.centroid_lat(F.col("r"))).collect()
    assert tuple(got[0])[:4] == (True, False, False, False) and tuple(got[1])[:4] == (True, False, True, False)
    assert tuple(got[1][4]) == (0.0, 0.0, 12.0, 12.0) and abs(got[0][5] - 2.0) < 1e-12
    sizes = spark.createDataFrame([(4.0, 10), (60.0, 100), (60.0, 1)], "extent double, n int").select(geo.grid_size(F.col("extent"), F.col("n"))).collect()
    assert [r[0] for r in sizes] == [0.5, 2.0, 10.0]


def test_text_functions(spark):
    df = spark.createDataFrame([("  Café — “x”  1·5\n1,200 ha 3.50 and two", "cafe-\"x\" 1.5", "https://creativecommons.org/licenses/by-sa/4.0/")], "t string, q string, l string")
    r = df.select(text.contains(F.col("t"), F.col("q")), text.numbers_in(F.col("t"), words=True), text.short_licence(F.col("l")), text.alnum(F.lit("É-b 2"))).first()
    odd = spark.createDataFrame([("Ｆｕｌｌ &amp; ﬁne Ǎ—ž",), (None,)], "t string").select(text.normalise_any(F.col("t"))).collect()
    assert [x[0] for x in odd] == ["full & fine a-z", None]
    names = spark.createDataFrame([("Senna didymobotrya L.",), ("A b Auth. var. c Auth.",), ("A",), ("A b f.",)], "n string").select(text.canonical_name(F.col("n"))).collect()
    assert [x[0] for x in names] == ["Senna didymobotrya", "A b var. c", "A", "A b"]
    assert r[0] and set(r[1]) == {"1", "5", "1200", "3.5", "2"} and r[2:] == ("cc-by-sa", "eb2")


def test_vision(spark):
    df = spark.createDataFrame([(list(range(72)),), (list(range(72, 0, -1)),)], "p array<int>").select(vision.dhash(F.col("p")).alias("h"))
    assert [r.h for r in df.collect()] == [0, -1]
    one = spark.range(1).select(vision.crop(*[F.lit(x) for x in (0.9, 0.0, 1.0, 0.5)], F.lit(100), F.lit(50)), vision.letterbox(F.lit(1280), F.lit(640)), vision.hamming(F.lit(5), F.lit(6))).first()
    assert (one[0].right, one[0].top, one[1].scale, one[1].pad_y, one[2]) == (100, 0, 0.5, 160.0, 2)


def test_assignment_takes_the_lowest_zone(spark):
    box = lambda i, x: (i, [[(x, 0.0), (x + 1.5, 0.0), (x + 1.5, 1.0), (x, 1.0)]])
    zones = spark.createDataFrame([box(5, 0.0), box(2, 0.5), box(9, -3.0)], "id int, rings array<array<struct<x: double, y: double>>>").withColumn("bounds", geo.bounds(F.col("rings")))
    points = spark.createDataFrame([(1, 0.2, 0.5), (2, 0.7, 0.5), (3, -2.5, 0.9), (4, 50.0, 50.0)], "id long, lon double, lat double")
    for most in (10, 0):
        assert {r.id: r.assigned_zone for r in ingest.assign_zones(points, zones, ["id"], most).collect()} == {1: 5, 2: 2, 3: 9, 4: None}


def test_uploads_and_pixels(spark):
    import struct

    png = lambda w, h: b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", w, h)
    files = [("image/png", png(10, 10)), ("image/png", png(20000, 20000)), ("image/gif", b"GIF8"), ("image/jpeg", b""), ("image/jpeg", b"\xff\xd8\xff..."), ("image/webp", b"RIFF0000WEBPx"), ("image/png", b"text"), ("image/png", b"x" * 200), (None, b"x")]
    df = spark.createDataFrame([(i, k, bytearray(c)) for i, (k, c) in enumerate(files)], "i int, kind string, content binary")
    got = [r[0] for r in df.orderBy("i").select(vision.upload_problem(F.col("kind"), F.col("content"), 100)).collect()]
    assert got == [None, "not a readable image", "unsupported type", "empty", None, None, "not a readable image", "too large", "unsupported type"]
    one = spark.range(1).select(vision.letterbox(F.lit(1280), F.lit(640)).alias("s")).select(vision.unboxed(F.lit(320.0), F.lit(320.0), F.col("s"), F.lit(1280), F.lit(640)).alias("u"), vision.centre_crop(F.lit(448), F.lit(300)).alias("c"), vision.normalised_colours(F.array(F.lit(255), F.lit(0))).alias("p")).first()
    assert (one.u.x, one.u.y) == (0.5, 0.5) and one.c.left == 55 and one.c.top == 0 and abs(one.p[0] - (1 - 0.485) / 0.229) < 1e-12


def test_models(spark):
    import random

    from fieldmark.operators import metrics

    report = '{"classes": ["a"], "results": {"test": {"photos": 9, "answered": 0.8}}, "chosen": {"c": 1}}'
    got = metrics.model_versions(spark.createDataFrame([("m", "plants", report)], "name string, task string, report string")).first()
    assert got.metrics == {"classes": '["a"]', "chosen": '{"c":1}', "test_photos": "9", "answered": "0.8"}
    rng = random.Random(1)
    df = spark.createDataFrame([([rng.gauss(3 * (k == 0), 1), rng.gauss(3 * (k == 1), 1), 0.5], k) for k in (0, 1) for _ in range(60)], "embedding array<double>, label int")
    model, best, losses = metrics.fit_head(df, df, (0.0, 1.0), rounds=20)
    assert best == 0.0 and losses[0.0] < losses[1.0] and model.numClasses == 2
