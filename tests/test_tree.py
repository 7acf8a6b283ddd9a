import os

import pytest

from orrery.sources import tree as T


def make(root):
    for name in ("b.jpg", "a.PNG", "note.txt", "z/y/deep.webp", "z/in.jpeg", "z/in.json", "lone.json", "c.jpg", "c.json", "m/x.jpg"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"of " + name.encode())
    os.symlink(root / "b.jpg", root / "d.jpg")
    os.symlink(root / "nowhere", root / "e.jpg")
    os.symlink(root / "z", root / "linked")
    os.mkfifo(root / "pipe.jpg")
    os.symlink(root / "c.json", root / "b.json")
    (root / "c.json").write_bytes(b" " * (T.SIDECAR_BYTES + 1))


def test_every_entry_has_its_reason_and_the_order_of_a_walk(spark, tmp_path):
    make(tmp_path)
    rows = T.ordered(T.walk(spark, str(tmp_path), recursive=True, tasks=3)).collect()
    assert [(r.path, r.reason) for r in rows] == [
        ("linked", T.LINK), ("a.PNG", None), ("b.jpg", None), ("c.jpg", None), ("d.jpg", T.LINK), ("e.jpg", T.LINK), ("lone.json", T.NO_PICTURE),
        ("note.txt", T.NO_PICTURE), ("pipe.jpg", T.IRREGULAR), ("m/x.jpg", None), ("z/in.jpeg", None), ("z/y/deep.webp", None),
    ]
    sizes = {r.path: r.size_bytes for r in rows}
    assert sizes["b.jpg"] == len(b"of b.jpg") and sizes["pipe.jpg"] is None and all(r.modified for r in rows if not r.reason)
    assert T.count_entries(spark, str(tmp_path), recursive=True).first().n == 12


def test_one_level_has_no_links_to_directories(spark, tmp_path):
    make(tmp_path)
    # A link to a directory is listed as a file is not: only a recursive walk tells of it.
    rows = T.ordered(T.walk(spark, str(tmp_path))).collect()
    assert [r.path for r in rows] == ["a.PNG", "b.jpg", "c.jpg", "d.jpg", "e.jpg", "lone.json", "note.txt", "pipe.jpg"]
    assert T.count_entries(spark, "file://" + str(tmp_path)).first().n == 8


def test_contents_come_with_their_sidecars(spark, tmp_path):
    make(tmp_path)
    rows = {r.path: r for r in T.walk(spark, str(tmp_path), recursive=True, contents=True).collect()}
    assert rows["z/in.jpeg"].content == b"of z/in.jpeg" and rows["z/in.jpeg"].sidecar == b"of z/in.json" and rows["z/in.jpeg"].refusal is None
    assert rows["b.jpg"].refusal == T.LINK and rows["b.jpg"].sidecar is None and rows["b.jpg"].content == b"of b.jpg"
    assert rows["c.jpg"].refusal == T.TOO_LARGE and rows["a.PNG"].sidecar is None and rows["a.PNG"].refusal is None
    assert rows["pipe.jpg"].content is None


def test_a_file_that_vanishes_is_told(tmp_path, monkeypatch):
    make(tmp_path)
    opened = T._opened

    def after_a_while(path):
        if path.endswith("b.jpg"):
            os.remove(path)
        return opened(path)

    monkeypatch.setattr(T, "_opened", after_a_while)
    reader = T.TreeReader(str(tmp_path), False, False, 4)
    rows = {r[1]: r[4] for part in reader.partitions() for r in reader.read(part)}
    assert rows["b.jpg"] == T.VANISHED and rows["a.PNG"] is None


def test_the_tree_is_dealt_to_tasks(tmp_path):
    for i in range(20):
        (tmp_path / f"d{i:02}" / "s").mkdir(parents=True)
        (tmp_path / f"d{i:02}" / "s" / f"{i}.jpg").write_bytes(b"x")
    reader = T.TreeReader(str(tmp_path), True, False, 8)
    parts = reader.partitions()
    assert len(parts) == 8
    found = sorted(r[1] for p in parts for r in reader.read(p))
    assert found == sorted(f"d{i:02}/s/{i}.jpg" for i in range(20))
    with pytest.raises(ValueError, match="not a directory"):
        T.TreeReader(str(tmp_path / "none"), True, False, 8).partitions()
