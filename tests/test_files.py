import json
import zipfile

import pytest
from pyspark.sql import functions as F

from orrery.operators import assets as A
from orrery.sources import files as S
from orrery.streaming import arrivals

NOW = "TIMESTAMP '2024-01-01 00:00:00'"


def folder_of(path):
    def put(name, content):
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_bytes(content if isinstance(content, bytes) else json.dumps(content).encode())

    put("a.jpg", b"one")
    put("a.json", {"tags": [" Dragon", "run", "dragon"], "meta": {"lot": 3, "source_path": "elsewhere"}})
    put("b.PNG", b"one")
    put("c.webp", b"two")
    put("c.json", {"tags": ["a b"]})
    put("d.jpeg", b"three")
    put("d.json", {"colour": 1})
    put("e.jpg", b"four")
    put("e.json", b" " * (S.SIDECAR_BYTES + 1))
    put("f.jpg", b"stored")
    put("g.txt", b"text")
    put("lone.json", {"tags": []})
    put("deep/h.jpg", b"five")
    put("i.jpg", b"six")
    put("i.json", {"meta": {"a": {"b": {"c": {"d": 1}}}}})


def test_entries(spark, tmp_path):
    folder_of(tmp_path)
    found = {r.path.rsplit("/", 1)[-1]: r.reason for r in S.entries(spark, str(tmp_path)).collect()}
    assert found == {n: None for n in ("a.jpg", "b.PNG", "c.webp", "d.jpeg", "e.jpg", "f.jpg", "i.jpg")} | {"g.txt": S.NO_PICTURE, "lone.json": S.NO_PICTURE}
    assert S.count_entries(spark, str(tmp_path), recursive=True).first().n == 10


def test_import(spark, tmp_path):
    folder_of(tmp_path)
    stored = spark.createDataFrame([("stored-id", "ignored")], "id string, x string").withColumn("sha256", F.sha2(F.lit("stored").cast("binary"), 256))
    found, new = S.import_folder(spark, str(tmp_path), stored, now=F.expr(NOW), tags=("run",), meta='{"dataset":"demo","lot":1}')
    rows = {r.path.rsplit("/", 1)[-1]: r for r in found.collect()}
    made = {r.original_filename: r for r in new.collect()}
    assert {n: r.outcome for n, r in rows.items()} == {
        "a.jpg": "created", "b.PNG": "duplicate", "c.webp": "refused", "d.jpeg": "refused", "e.jpg": "refused", "f.jpg": "duplicate", "g.txt": "skipped", "lone.json": "skipped", "i.jpg": "refused"
    }
    assert rows["f.jpg"].asset_id == "stored-id" and rows["b.PNG"].asset_id == rows["a.jpg"].asset_id == made["a.jpg"].id
    assert "unexpected keys: colour" in rows["d.jpeg"].reason and "larger" in rows["e.jpg"].reason and "too deep" in rows["i.jpg"].reason
    assert list(made) == ["a.jpg"] and made["a.jpg"].tags == ["run", "dragon"] and made["a.jpg"].file_ext == "jpg"
    meta = json.loads(made["a.jpg"].meta)
    assert meta["dataset"] == "demo" and meta["lot"] == 3 and meta["source_path"].endswith("/a.jpg")
    assert {r.outcome: r.n for r in A.report(found).collect()} == {"created": 1, "duplicate": 2, "refused": 4, "skipped": 2}


MANIFEST = {
    "images": [{"id": 7, "license": 1, "flickr_url": "https://f.org/7"}, {"id": 3, "license": 2}, {"id": 0, "license": 1}, {"id": 5, "license": 1, "flickr_url": "ftp://x"}, {"id": 9}],
    "licenses": [{"id": 1, "url": S.LICENCES[0]}, {"id": 2, "url": "http://other/"}],
    "categories": [{"id": 1, "name": "traffic  light"}, {"id": 2, "name": "Dog"}, {"id": 3, "name": "no/tag"}],
    "annotations": [{"image_id": 7, "category_id": 2}, {"image_id": 7, "category_id": 1}, {"image_id": 7, "category_id": 2}, {"image_id": 7, "category_id": 3}, {"image_id": 5, "category_id": 9}],
}


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MANIFEST))
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr(S.MEMBER, json.dumps(MANIFEST))
    for name in ("m.json", "m.zip"):
        rows = S.offered(S.manifest(spark, str(tmp_path / name))).orderBy("place").collect()
        assert [(r.identifier, r.refused) for r in rows] == [(7, False), (3, True), (0, True), (5, False), (9, True)]
        assert rows[0].tags == ["dog", "traffic-light"] and rows[0].source_url == "https://f.org/7" and rows[0].licence == S.LICENCES[0]
        assert rows[3].tags == [] and rows[3].source_url.endswith("/000000000005.jpg")
    with pytest.raises(Exception, match="has no"):
        S.manifest(spark, str(tmp_path / "m.zip"), member="other").collect()
    with pytest.raises(Exception, match="more than 10 bytes"):
        S.manifest(spark, str(tmp_path / "m.zip"), most=10).collect()


def test_media(spark, tmp_path):
    ids = [f"{i}2345678-0000-0000-0000-00000000000{i}" for i in range(3)]
    files = spark.createDataFrame([(i, "jpg", f"c{i}".encode()) for i in ids], "id string, file_ext string, content binary")
    for _ in range(2):
        paths = {r.id: r.path for r in S.store_media(files, str(tmp_path)).collect()}
    (tmp_path / "02" / f"{ids[0]}.thumb.webp").write_bytes(b"t")
    assert all(open(paths[i], "rb").read() == f"c{i}".encode() for i in ids) and paths[ids[1]].endswith(f"/12/{ids[1]}.jpg")
    stored = S.media_files(spark, str(tmp_path))
    assert stored.count() == 4
    orphans, missing = A.disk_differences(stored, files.where(F.col("id") != ids[2]), F.expr("TIMESTAMP '2099-01-01 00:00:00'"))
    assert [r.path.rsplit("/", 1)[-1] for r in orphans.collect()] == [f"{ids[2]}.jpg"] and [r.id for r in missing.collect()] == [ids[1]]


def test_arriving_contents_come_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def run():
        out = str(tmp_path / "out")
        query = arrivals.arriving(spark, str(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(out).count()

    (source / "a").write_bytes(b"one")
    (source / "b").write_bytes(b"one")
    (source / "c").write_bytes(b"two")
    assert run() == 2
    (source / "d").write_bytes(b"two")
    (source / "e").write_bytes(b"three")
    assert run() == 3
