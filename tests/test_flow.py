import json

import numpy as np
from test_plans import png

from nearkin import __main__ as cli
from nearkin.operators import quality, sampling
from nearkin.plans import flow
from nearkin.plans.index import HashIndex
from nearkin.schemas import VIDEO

FRAME = "id long, video string, ts long, phantom boolean, w int, h int, px array<int>"


def clip(seed, n, mirror=False, noise=0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        coarse = np.kron(rng.integers(50, 256, (6, 8)), np.ones((4, 4), int))
        coarse = coarse[:, ::-1] if mirror else coarse
        out.append(np.clip(coarse + np.random.default_rng(9).integers(-noise, noise + 1, coarse.shape), 41, 255))
    return out


def table(spark, clips):
    rows, i = [], 0
    for name, images in clips.items():
        for t, image in enumerate(images):
            rows.append((i, name, t * 1000, False, image.shape[1], image.shape[0], image.ravel().tolist()))
            i += 1
    return spark.createDataFrame(rows, FRAME)


def test_new_videos_are_searched_reported_and_stored(spark, tmp_path):
    black = [np.zeros((24, 32), int)] * 2
    clips = {"a": clip(1, 4), "b": clip(2, 4), "c": [*clip(1, 4, noise=2), *black], "d": clip(2, 4, mirror=True)}
    made = flow.process(spark, table(spark, clips), f"{tmp_path}/i", f"{tmp_path}/o", create=True)
    assert (made["new"], made["gone"], made["duplicates"]) == (4, 0, 2)  # c of a; d of b, by its mirror images
    report = {(r["entry"], r["name"].split("_", 1)[1], r["target"]) for r in spark.read.parquet(f"{tmp_path}/o/report").collect()}
    assert {("0000", "the_new_one", "c"), ("0000", "dup", "a"), ("0001", "the_new_one", "d"), ("0001", "dup", "b")} <= report
    assert spark.read.parquet(f"{tmp_path}/o/graveyard").count() == 2
    assert HashIndex.open(spark, f"{tmp_path}/i", VIDEO).scan().count() == made["stored_rows"] == 16

    ignored = quality.judge(table(spark, {"x": clip(3, 1)})).select("hi", "lo")
    later = {"b": clips["b"], "c": clips["c"], "e": [*clip(3, 1), *clip(1, 4, noise=1)]}
    again = flow.process(spark, table(spark, later), f"{tmp_path}/i", f"{tmp_path}/p", ignored=ignored)
    assert (again["new"], again["gone"], again["duplicates"], again["removed_rows"], again["stored_rows"]) == (1, 2, 1, 8, 4)
    others = {r["other"]["path"] for r in flow.read_collisions(spark, f"{tmp_path}/p/collisions").collect()}
    assert others == {"c"}  # a is gone
    assert [r["reason"] for r in spark.read.parquet(f"{tmp_path}/p/graveyard").collect()] == ["ignored"]


def test_command_line(spark, tmp_path, capsys):
    table(spark, {"a": clip(1, 3), "b": clip(1, 3)}).write.parquet(f"{tmp_path}/frames")
    cli.main(["find", f"{tmp_path}/frames", f"{tmp_path}/i", f"{tmp_path}/o", "--create", "--threshold", "20"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["duplicates"] == 1
    cli.main(["edit", f"{tmp_path}/i", f"purge:{tmp_path}/o/collisions", "stats"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"alive": 0, "dead": 6, "dead_percent": 100.0}
    (tmp_path / "pics").mkdir()
    for name, colour in (("x", (250, 250, 250)), ("y", (200, 0, 0)), ("z", (0, 0, 0))):
        (tmp_path / "pics" / f"{name}.png").write_bytes(png(9, 9, colour))
    cli.main(["compare", f"{tmp_path}/pics", f"{tmp_path}/c"])
    histogram = {int(r["distance"]): int(r["n"]) for r in spark.read.csv(f"{tmp_path}/c/histogram", header=True).collect()}
    assert sum(histogram.values()) == 1 and len(histogram) == 129  # the black picture has nothing left to hash


def test_from_files_to_report(spark, tmp_path, capsys):
    """Folders of videos, one of them broken, a folder of ignored pictures: sampling, quality, mirrors, search, report."""
    from test_plans import y4m

    (tmp_path / "v").mkdir()
    (tmp_path / "pics").mkdir()

    def film(name, images):  # one second for each image
        (tmp_path / "v" / name).write_bytes(y4m([np.asarray(i).ravel().tolist() for i in images for _ in range(25)], 32, 24))

    scenes = clip(1, 8)
    film("a.y4m", scenes)
    film("b.y4m", [*scenes[:6], np.zeros((24, 32), int), scenes[7]])
    film("c.y4m", clip(2, 8))
    film("d.y4m", clip(2, 8, mirror=True))
    (tmp_path / "v" / "e.y4m").write_bytes(b"no video")
    logo = clip(3, 1)[0]
    film("f.y4m", [logo[:, ::-1]] * 8)
    # the ignored picture, as grey rows of a PNG
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(int(v) for v in line) for line in logo)
    (tmp_path / "pics" / "logo.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 32, 24, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    out = f"{tmp_path}/out"
    command = ["videos", f"{tmp_path}/v", "--index", f"{tmp_path}/i", "--out", out, "--decoder", "y4m", "--ignore-dir", f"{tmp_path}/pics"]
    cli.main([*command, "--create"])
    done = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (done["failed"], done["duplicates"]) == (1, 2)
    assert [r["path"].rsplit("/", 1)[1] for r in spark.read.json(f"{out}/errors").collect()] == ["e.y4m"]
    names = {(r["name"].split("_", 1)[1], r["target"] and r["target"].rsplit("/", 1)[1]) for r in spark.read.parquet(f"{out}/report").collect()}
    assert names == {("the_new_one", "b.y4m"), ("dup", "a.y4m"), ("the_new_one", "d.y4m"), ("dup", "c.y4m"), ("debuginfo", None)}
    grave = {(r["video"].rsplit("/", 1)[1], r["file"]) for r in spark.read.parquet(f"{out}/graveyard").collect()}
    assert ("b.y4m", "too_one_color_00:00:06.440.jpg") in grave
    assert all(f.startswith("ignored_00:00:0") for v, f in grave if v == "f.y4m") and any(v == "f.y4m" for v, _ in grave)
    stored = {r["path"].rsplit("/", 1)[1] for r in HashIndex.open(spark, f"{tmp_path}/i", VIDEO).scan().select("src.path").distinct().collect()}
    assert stored == {"a.y4m", "b.y4m", "c.y4m", "d.y4m"}
    (tmp_path / "v" / "c.y4m").unlink()
    cli.main(command)
    again = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (again["gone"], again["failed"], again["collisions"]) == (1, 1, 0)


def test_mirror_images_near_ignored_ones_are_left_out(spark):
    frames = table(spark, {"a": clip(5, 2)})
    judged = quality.judge(frames).orderBy("id").collect()
    ignored = spark.createDataFrame([(judged[0]["mirror_hi"], judged[0]["mirror_lo"])], "hi long, lo long")
    got = flow.classify(frames, flow.Quality(), 5, ignored).orderBy("id").collect()
    assert [(r["reason"], r["mirror_hi"] is None) for r in got] == [("ok", True), ("ok", False)]


def test_scheduled_frames_drift(spark):
    frames = spark.createDataFrame([("a", t, 20_000) for t in range(0, 20_000, 40)] + [("b", 0, 0), ("b", 40, 0)] + [("c", t, 100_000) for t in range(0, 100_000, 1000)], "video string, ts long, length_ms long")
    got = {}
    for r in sampling.scheduled_frames(frames).orderBy("video", "ts").collect():
        got.setdefault(r["video"], []).append((r["ts"], r["phantom"]))
    want, now, target = [(0, False)], 0, 0
    for series, gap in sampling.gaps([4000, 4200], 20):
        target = now + gap
        now = -(-target // 40) * 40
        if now < 20_000:
            want.append((now, series > 0))
    assert got["a"] == want and got["b"] == [(0, False)]
    cut = 5000 + 40_000 * 70_000 // 240_000
    assert all(cut <= t <= 100_000 - cut for t, _ in got["c"]) and got["c"][0][0] == -(-cut // 1000) * 1000
