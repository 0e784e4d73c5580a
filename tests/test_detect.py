"""Jobs over images against a plain loop, with failures at every step."""

import datetime

import pytest
from pyspark.sql import functions as F

from fieldmark.operators import detect, ingest

MEDIA = "id long, image_url string, captured_at timestamp_ntz, width int, height int, status string, phash long, ingested_at timestamp_ntz, zone_id int, lon double, lat double"
DAY, LATER = datetime.datetime(2024, 5, 1), datetime.datetime(2025, 1, 2)
NOW = "2025-01-02 00:00:00"


def load(url):
    if url.startswith("gone"):
        raise ConnectionError("no answer " + "x" * 400)
    return url.split(":")[1].encode()


def decode(content):
    if content == b"bad":
        raise ValueError("not an image")
    return int(content), int(content)


def detector():
    def find(pictures):
        if any(p == 16191 for p in pictures):
            raise RuntimeError("one picture is too much")
        return [[(p % 3, 0.5, 0.1, 0.1, 0.2, 0.2)] * (p % 4) for p in pictures]

    return find


STEPS = detect.Steps(load, decode, detector)


def made():
    """Media of which some are near others; the detector fails at 16191."""
    urls = {1: "ok:256", 2: "ok:257", 3: "gone:1", 4: "ok:bad", 5: None, 6: "ok:16191", 7: "ok:70000", 8: "ok:70001", 9: "ok:70003", 10: "ok:259", 11: "ok:99999", 12: "ok:123456", 13: "ok:-7", 14: "ok:-5"}
    rows = []
    for i, url in urls.items():
        moment = None if i in (8, 2) else DAY
        rows.append((i, url, moment, None if i in (7, 9) else 640, 480, "done" if i == 12 else "new", 99998 if i == 12 else None, LATER, i % 3, 1.0, 2.0))
    return rows


def plain(rows):
    """Outcome by id, one image after another."""
    known, out = {r[0]: (r[2], r[3], r[4], r[6]) for r in rows if r[6] is not None}, {}
    for i, url, moment, w, h, status, _, *_ in rows:
        if status != "new" or url is None:
            continue
        try:
            picture, bits = decode(load(url))
        except ConnectionError:
            out[i] = ("failed", "download", None, 0)
            continue
        except ValueError:
            out[i] = ("failed", "unreadable", None, 0)
            continue
        near = [j for j, (m, x, y, p) in known.items() if moment is not None and (m, x, y) == (moment, w, h) and ((p ^ bits) & (2**64 - 1)).bit_count() <= 2]
        known[i] = (moment, w, h, bits)
        if near:
            out[i] = ("skipped", "near_duplicate", min(near), 0)
        else:
            out[i] = ("failed", "detector", None, 0) if picture == 16191 else ("done", None, None, picture % 4)
    return out


def seen(df):
    return {r["id"]: (r["status"], r["reason"], r["twin"], len(r["boxes"])) for r in df.collect()}


def test_every_image_has_one_outcome(spark, tmp_path):
    rows = made()
    media, jobs = spark.createDataFrame(rows, MEDIA).repartition(3), detect.Jobs(spark, str(tmp_path / "jobs"))
    got = detect.run_detection(media, jobs, STEPS, NOW, batch=3)
    want = plain(rows)
    assert seen(got) == want
    assert {x[:2] for x in want.values()} == {("done", None), ("failed", "download"), ("failed", "unreadable"), ("failed", "detector"), ("skipped", "near_duplicate")}
    assert want[10][2] == 1 and want[11][2] == 12 and want[8][0] == want[2][0] == "done" and want[9][2] == 7 and want[14][2] == 13
    details = {r["id"]: r["detail"] for r in got.collect()}
    assert details[3].startswith("ConnectionError: no answer") and len(details[3]) == detect.DETAIL and details[6].startswith("RuntimeError")
    assert not (tmp_path / "jobs" / "fetched" / "run=1").exists()
    counts = detect.run_counts(got).first()
    assert (counts["claimed"], counts["failed"], counts["duplicates"]) == (12, 3, 4) and counts["with_boxes"] + counts["empty"] == 5
    boxes = detect.detections_of(media, got, 9)
    assert boxes.count() == counts["boxes"] and {r["year"] for r in boxes.filter("media_id IN (2, 8)").collect()} == {2025}
    state = {r["id"]: r["status"] for r in jobs.state(media, NOW).collect()}
    assert state == {r[0]: want[r[0]][0] if r[0] in want else r[5] for r in rows}
    # nothing is left to do
    assert detect.run_detection(media, jobs, STEPS, NOW).count() == 0 and seen(jobs.outcomes()) == want


def test_limits_make_the_same_outcomes(spark, tmp_path):
    rows = made()
    media, jobs = spark.createDataFrame(rows, MEDIA), detect.Jobs(spark, str(tmp_path / "jobs"))
    sizes = [detect.run_detection(media, jobs, STEPS, NOW, limit=5).count() for _ in range(4)]
    assert sizes == [5, 5, 2, 0] and seen(jobs.outcomes()) == plain(rows)


def test_a_stopped_run_goes_on(spark, tmp_path):
    rows = [r for r in made() if r[0] in (1, 2, 7)]
    media, jobs = spark.createDataFrame(rows, MEDIA), detect.Jobs(spark, str(tmp_path / "jobs"))

    def none():
        raise OSError("no model")

    with pytest.raises(Exception, match="no model"):
        detect.run_detection(media, jobs, STEPS._replace(detector=none), NOW, lease="10 minutes")
    assert jobs.runs("claims") == [1] and jobs.runs("fetched") == [1] and jobs.runs("outcomes") == []
    assert {r["status"] for r in jobs.state(media, NOW).collect()} == {"processing"}
    # others can't have its images before its lease is over
    assert detect.run_detection(media, jobs, STEPS, "2025-01-02 00:09:59").count() == 0

    def offline(url):
        raise AssertionError("fetched again")

    got = detect.run_detection(media, jobs, STEPS._replace(load=offline), NOW, run=1)
    assert seen(got) == plain(rows) and jobs.outcomes().count() == 3


def test_a_lease_ends(spark, tmp_path):
    rows = [r for r in made() if r[0] in (1, 2, 7)]
    media, jobs = spark.createDataFrame(rows, MEDIA), detect.Jobs(spark, str(tmp_path / "jobs"))

    def none():
        raise OSError("no model")

    with pytest.raises(Exception, match="no model"):
        detect.run_detection(media, jobs, STEPS._replace(detector=none), NOW, lease="10 minutes")
    assert {r["status"] for r in jobs.state(media, "2025-01-02 00:10:00").collect()} == {"new"}
    assert detect.run_detection(media, jobs, STEPS, "2025-01-02 00:10:00").count() == 3
    # the dead run comes back: its outcomes don't count beside the later ones
    assert detect.run_detection(media, jobs, STEPS._replace(detector=lambda: lambda ps: [[] for _ in ps]), NOW, run=1).count() == 3
    assert seen(jobs.outcomes()) == plain(rows) and jobs.read("outcomes", detect.OUTCOME).count() == 6


def test_no_images(spark, tmp_path):
    media, jobs = spark.createDataFrame([], MEDIA), detect.Jobs(spark, str(tmp_path / "jobs"))
    got = detect.run_detection(media, jobs, STEPS, NOW)
    assert got.count() == 0 and detect.run_counts(got).first()["boxes"] == 0 and jobs.state(media, NOW).count() == 0


def test_stored_media_count_as_earlier(spark):
    schema = "id long, captured_at timestamp_ntz, width int, height int, phash long"
    new = spark.createDataFrame([(1, DAY, 1, 1, 0), (2, DAY, 1, 1, 1), (3, DAY, None, 1, 8), (4, DAY, 1, 1, None), (5, DAY, 1, 1, 255)], schema)
    old = spark.createDataFrame([(9, DAY, 1, 1, 3), (8, DAY, None, 1, 8), (7, None, 1, 1, 255)], schema)
    assert sorted(map(tuple, ingest.near_duplicate_media(new, 2, old).collect())) == [(1, 9), (2, 1), (3, 8)]
    assert sorted(map(tuple, ingest.near_duplicate_media(new).collect())) == [(2, 1)]
    assert ingest.near_duplicate_media(new, 2, old.limit(0)).select(F.count("*")).first()[0] == 1
