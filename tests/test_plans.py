import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from nearkin.plans import collisions, edit
from nearkin.plans.index import HashIndex, dead_sources, live_and_dead
from nearkin.schemas import STRING, UNIT, VIDEO, SourceMismatch
from nearkin.sources import files, video

SRC = "struct<frame_pos:struct<tb_num:int,tb_den:int,ts:bigint,first_ts:bigint>,path:string,mirrored:string>"


def strings(spark, rows):
    return spark.createDataFrame(rows, "hi long, lo long, src string")


def frames(spark, rows):
    return spark.createDataFrame([(hi, lo, ((1, 1000, t, 0), p, "Normal")) for hi, lo, t, p in rows], f"hi long, lo long, src {SRC}")


def test_equal_hashes_stay_apart_and_are_found(spark, tmp_path):
    index = HashIndex.create(spark, f"{tmp_path}/i", STRING)
    index.add(strings(spark, [(0, 0b101, "5_1"), (0, 0b101, "5_2"), (0, 0b100, "4")]))
    index.add(strings(spark, []))
    query = spark.createDataFrame([(0, 0b101)], "hi long, lo long")
    assert sorted(r["other"]["src"] for r in index.search(query, 0).collect()) == ["5_1", "5_2"]
    assert sorted(r["other"]["src"] for r in index.search(query, 1).collect()) == ["4", "5_1", "5_2"]
    assert HashIndex.open(spark, f"{tmp_path}/i", STRING).scan().count() == 3


def test_tombstones_and_rebuilding(spark, tmp_path):
    index = HashIndex.create(spark, f"{tmp_path}/i", STRING)
    index.add(strings(spark, [(0, 5, "5_1"), (0, 5, "5_2"), (0, 4, "4")]))
    assert index.remove(F.col("src") == "5_1") == 1 and index.remove(F.col("src") == "5_1") == 0
    stats = lambda i: tuple(i.stats().first())[:2]
    assert stats(index) == (2, 1)
    other = index.rebuild_to(f"{tmp_path}/j")
    assert stats(other) == (2, 0) and stats(index) == (2, 1)
    index.backup(f"{tmp_path}/b")
    index.rebuild()
    assert stats(index) == (2, 0) and stats(HashIndex.open(spark, f"{tmp_path}/b")) == (2, 1)
    index.add(strings(spark, [(0, 5, "5_1")]))  # what was removed can come again
    assert stats(index) == (3, 0)
    index.vacuum()
    assert stats(index) == (3, 0) and len(os.listdir(f"{tmp_path}/i/rows")) == 2


def test_writers_that_meet_keep_their_own_rows(spark, tmp_path, monkeypatch):
    """Two adds that read the same state stand beside each other; a delete or rebuild that others overtook fails."""
    from nearkin.plans import index as module

    one, two = (HashIndex.create(spark, f"{tmp_path}/i", STRING) if i == 0 else HashIndex.open(spark, f"{tmp_path}/i", STRING) for i in (0, 1))
    rows = lambda *names: spark.createDataFrame([(0, 0, n) for n in names], "hi long, lo long, src string").coalesce(1)
    state = one._state()
    one.add(rows("a", "b"))
    with monkeypatch.context() as m:
        m.setattr(HashIndex, "_state", lambda self: state)
        two.add(rows("c", "d"))  # as if it had read the index before the first add
        with pytest.raises(module.Conflict):
            two.rebuild()
        with pytest.raises(module.Conflict):
            two.remove(F.col("src") == "c")
    assert one.remove(F.col("src") == "a") == 1
    assert {r["src"] for r in two.scan().collect()} == {"b", "c", "d"}
    one.add(rows("e"), tag="batch 7")
    assert two.has("batch 7") and not two.has("batch 8")


def test_payload_types_are_checked(spark, tmp_path):
    HashIndex.create(spark, f"{tmp_path}/i", STRING)
    with pytest.raises(SourceMismatch):
        HashIndex.open(spark, f"{tmp_path}/i", UNIT)
    assert HashIndex.open(spark, f"{tmp_path}/i", STRING).scan().count() == 0
    untyped = HashIndex.open(spark, f"{tmp_path}/i")
    assert untyped.ident is None and untyped.downcast(STRING).upcast().ident is None
    with pytest.raises(SourceMismatch):
        untyped.downcast(VIDEO)
    with pytest.raises(ValueError):
        HashIndex.create(spark, f"{tmp_path}/k", "other:1")


def test_goals_run_in_order(spark, tmp_path):
    index = HashIndex.create(spark, f"{tmp_path}/i", VIDEO)
    index.add(frames(spark, [(0, i, i, f"v{i // 2}") for i in range(10)]))
    assert edit.run(index, ["stats"])[0] == {"alive": 10, "dead": 0, "dead_percent": 0.0}
    edit.run(index, [f"list:{tmp_path}/list", f"export:{tmp_path}/out"])
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/list").collect()]
    assert len(lines) == 10 and "Source=v2, Hash=BQAAAAAAAAAAAAAAAAAAAA" in lines
    assert edit.run(index, ["randel:2", "stats", f"import:{tmp_path}/out", "rebuild", "stats"])[1:] == [{"alive": 6, "dead": 4, "dead_percent": 40.0}, None, None, {"alive": 16, "dead": 0, "dead_percent": 0.0}]
    spark.createDataFrame([(("v0",), ("v1",))], "reference struct<path:string>, other struct<path:string>").write.json(f"{tmp_path}/hits")
    live = index.scan().where("src.path in ('v0', 'v1')").count()
    assert edit.run(index, [f"purge:{tmp_path}/hits"]) == [live] and index.scan().where("src.path in ('v0', 'v1')").count() == 0
    for bad in ("stats:1", "list", "randel:x", "other", "purge:"):
        with pytest.raises(ValueError):
            edit.run(index, ["stats", bad])


def test_shares_of_dead_rows(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "path string, removed boolean")
    assert tuple(dead_sources(rows, "path").first()) == (1, 2, 50.0)
    assert live_and_dead(rows.limit(0)).first()["dead_percent"] is None


def items(spark, rows):
    return spark.createDataFrame(rows, "seq long, path string, hi long, lo long, ts long")


def test_collisions_respect_arrival(spark):
    rows = items(spark, [(0, "a", 0, 0, 10), (1, "b", 0, 1, 20), (1, "b", 0, 7, 21), (2, "c", -1, -1, 0), (3, "d", 0, 0, 5)])
    found = collisions.collisions(rows, rows, 1)
    assert {(r["reference"]["path"], r["other"]["path"], r["distance"]) for r in found.collect()} == {("b", "a", 1), ("d", "a", 0), ("d", "b", 1)}
    assert {r["path"] for r in collisions.other_paths(found).collect()} == {"a", "b"}
    assert {r["path"] for r in collisions.all_paths(found).collect()} == {"a", "b", "d"}
    report = [tuple(r) for r in collisions.report(found).orderBy("entry", "item").collect()]
    assert report == [("0000", 0, "0000_the_new_one", "b"), ("0000", 1, "0001_dup", "a"), ("0000", 2, "0002_debuginfo", None), ("0001", 0, "0000_the_new_one", "d"), ("0001", 1, "0001_dup", "a"), ("0001", 2, "0002_dup", "b"), ("0001", 3, "0003_debuginfo", None)]
    shown = collisions.debug_lines(found, limit=2).collect()
    assert len(shown) == 2 and shown[0]["verdict"] == "0 <= 23" and shown[0]["reference_time"] == "00:00:00.005"
    pictures = spark.createDataFrame([("a", 10, [1]), ("b", 20, [2]), ("d", 5, [3])], "path string, ts long, px array<int>")
    assert {tuple(r["reference_px"]) for r in collisions.debug_lines(found, pictures).collect()} == {(2,), (3,)}


def test_earlier_matches_equal_pairs(spark):
    import random

    rng = random.Random(1)
    rows = [(i, str(i), 0, rng.choice([0, 1, 3, 7, 255, 1 << 40]), 0) for i in range(60)]
    got = {r["seq"]: tuple(r)[1:] for r in collisions.earlier_matches(items(spark, rows).select("seq", "hi", "lo"), 1).collect()}
    want = {}
    for i, _, _, lo, _ in rows:
        near = [(j, (lo ^ other).bit_count()) for j, _, _, other, _ in rows if j < i and (lo ^ other).bit_count() <= 1]
        if near:
            want[i] = (len(near), min(j for j, _ in near), min(d for _, d in near))
    assert got == want


@pytest.mark.parametrize("stretch", [7, 100_000])
def test_earlier_matches_of_hot_hashes(spark, stretch, monkeypatch):
    """One hash in most items, over several stretches of the order."""
    monkeypatch.setattr(collisions, "STRETCH", stretch)
    rows = [(i * 3, str(i), 0, 0 if i % 5 else 1, 0) for i in range(60)] + [(1000, "x", 0, 255, 0)]
    got = {r["seq"]: tuple(r)[1:] for r in collisions.earlier_matches(items(spark, rows).select("seq", "hi", "lo"), 1).collect()}
    want = {i * 3: (i, 0, min((0 if i % 5 else 1) ^ (0 if j % 5 else 1) for j in range(i))) for i in range(1, 60)}
    assert got == want


def test_catalogues(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    new, gone = collisions.catalogue_changes(paths("a", "b", "b", "c"), paths("b", "d", "d"))
    assert {r["path"] for r in new.collect()} == {"a", "c"} and [r["path"] for r in gone.collect()] == ["d"]
    assert [r["path"] for r in collisions.catalogue_changes(paths("c", "a"), paths("x"), limit=1)[0].collect()] == ["a"]
    assert collisions.random_paths(paths("a", "a", "b", "c"), 2, seed=1).distinct().count() == 2


def test_entry_numbers(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert collisions.next_entry(names("0000", "0007_x")).first()["next"] == 8 and collisions.next_entry(names()).first()["next"] == 0
    with pytest.raises(Exception, match="without a number"):
        collisions.next_entry(names("x")).collect()


def png(width, height, colour):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(colour) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_files_and_images(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(png(2, 1, (255, 0, 1)))
    (tmp_path / "sub" / "b.png").write_bytes(b"")
    listed = files.list_files(spark, [str(tmp_path), str(tmp_path)])
    assert [os.path.basename(r["path"]) for r in listed.collect()] == ["a.png"]
    image = files.read_images(spark, [str(tmp_path)], drop_invalid=True).first()
    assert (image["w"], image["h"], image["px"]) == (2, 1, [0xFF0001] * 2)
    with pytest.raises(Exception):  # noqa: B017
        files.list_files(spark, [f"{tmp_path}/none"]).collect()


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("dir/", "")
        z.writestr("dir/b.png", png(1, 1, (1, 2, 3)))
        z.writestr("a.jpg", b"not decoded")
    (tmp_path / "x.cbz").write_bytes(buffer.getvalue())
    (tmp_path / "y.txt").write_bytes(b"")
    pages = files.archive_pages(spark, [str(tmp_path)])
    assert [(r["page"], r["name"], r["kind"]) for r in pages.orderBy("page").collect()] == [(0, "dir/b.png", "png"), (1, "a.jpg", "jpeg")]
    assert [r["file"] for r in files.page_files(pages).orderBy("file").collect()] == ["page_0.jpg", "page_1.jpg"]
    assert files.image_kind("x", b"GIF89a") == "gif" and files.image_kind("x", b"RIFF0000WEBP") == "webp" and files.image_kind("x", b"?") is None
    (tmp_path / "z.cbz").write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        files.archive_pages(spark, [str(tmp_path)]).collect()


def test_video_source(spark, tmp_path):
    path = f"{tmp_path}/v.raw"
    video.write_raw(path, [(100 + 40 * i, bytes([i % 256] * 4)) for i in range(250)], 2, 2, first_ts=100)
    spark.dataSource.register(video.VideoSource)
    read = lambda **o: spark.read.format("nearkin_video").options(path=path, **o)
    assert read().load().count() == 250
    late = read(from_ms=9000).load()
    assert late.agg(F.min("ts")).first()[0] == 9100 and late.first()["px"] == [225 * 0x010101] * 4
    assert read(from_ms=10_000).load().count() == 0
    assert [r["ts"] for r in read(step_ms=3000).load().orderBy("ts").collect()] == [100, 3100, 6100, 9100]
    assert read().schema("path string, ts long").load().columns == ["path", "ts"]
    with pytest.raises(Exception):  # noqa: B017
        read(decoder="none").load().collect()
    bad = read(decoder="y4m", on_error="row").schema("path string, error string").load().collect()
    assert len(bad) == 1 and bad[0]["path"] == path and "YUV4MPEG2" in bad[0]["error"]


def y4m(frames, w, h, kind="mono"):
    small = {"mono": 0, "444": w * h, "420jpeg": -(-w // 2) * -(-h // 2)}[kind]
    return f"YUV4MPEG2 W{w} H{h} F25:1 Ip A1:1 C{kind}\n".encode() + b"".join(b"FRAME\n" + bytes(f) + bytes([128]) * small * 2 for f in frames)


def test_y4m_files(spark, tmp_path):
    spark.dataSource.register(video.VideoSource)
    for kind in ("mono", "444", "420jpeg"):
        (tmp_path / "v.y4m").write_bytes(y4m([[i] * 15 for i in range(50)], 5, 3, kind))
        rows = spark.read.format("nearkin_video").options(path=f"file:{tmp_path}/v.y4m", decoder="y4m", from_ms=1000, step_ms=400).load().orderBy("ts").collect()
        assert [(r["ts"], r["tb_num"], r["tb_den"], r["w"], r["h"]) for r in rows] == [(t, 1, 25, 5, 3) for t in (25, 35, 45)]
        assert rows[0]["px"] == [25 * 0x010101] * 15
    red = b"YUV4MPEG2 W2 H2 F25:1 C444\nFRAME\n" + bytes([76] * 4 + [85] * 4 + [255] * 4)
    assert next(video.y4m_frames(io.BytesIO(red), 0, {"px"}))[6] == [0xFE0000] * 4
    with pytest.raises(ValueError, match="cut short"):
        list(video.y4m_frames(io.BytesIO(red[:-1]), 0, {"px"}))
