import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from semblance import cli


def png(path, rows):
    raw = b"".join(b"\0" + bytes(c for pixel in row for c in pixel) for row in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"tEXt", b"c\0" + os.urandom(1500)) + chunk(b"IEND", b""))


def test_commands(spark, tmp_path, capsys):
    root, cat = tmp_path / "root", tmp_path / "cat"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    base = os.urandom(5000)
    for name, data in (("a", base), ("sub/b", base), ("larger", base + b"\n"), ("other", os.urandom(2000)), ("skip.tmp", base), (".git/c", base), ("small", b"x")):
        (root / name).write_bytes(data)
    half = [[(0, 0, 0)] * 16 + [(255, 255, 255)] * 16 for _ in range(32)]
    png(root / "one.png", half)
    png(root / "two.png", [list(r) for r in half[:31]] + [[(10, 10, 10)] * 32])
    png(root / "far.png", [[(255, 255, 255)] * 16 + [(0, 0, 0)] * 16 for _ in range(32)])
    run = lambda *a: (cli.main([a[0], "--catalog", str(cat), *a[1:]], spark), capsys.readouterr().out)[1]
    first = dict(x.split(": ") for x in run("index", str(root), "-x", "*.tmp").splitlines())
    assert (first["new"], first["skipped_by_name"], first["too_small"], first["unchanged"]) == ("7", "1", "1", "0")
    again = dict(x.split(": ") for x in run("index", str(root), "-x", "*.tmp").splitlines())
    assert (again["new"], again["unchanged"]) == ("0", "7")
    at = os.path.realpath(root)
    assert run("finddupes", "-t", "csv").splitlines() == ["size;hardlinked;path1;path2", f"5000;False;{at}/a;{at}/sub/b"]
    assert json.loads(run("finddupes", "-t", "json"))["items"] == [{"size": 5000, "num_files": 2, "files": [f"{at}/a", f"{at}/sub/b"]}]
    assert f"{at}/sub/b;delete;same content as {at}/a" in run("finddupes")
    assert sorted(run("finddupes", "-w", "truncated", "-t", "csv").splitlines()) == sorted(["largesize;largepath;smallsize;smallpath", f"5001;{at}/larger;5000;{at}/a", f"5001;{at}/larger;5000;{at}/sub/b"])
    run("image", "-S", "3,4")
    pairs = run("finddupes", "-w", "image", "-S", "4", "-t", "csv", "-s", "0.8").splitlines()
    assert len(pairs) == 3 and all("one.png" in p and "two.png" in p for p in pairs[1:])
    ids = {r.name: r.contentid for r in cli.Catalog(spark, str(cat)).read("file").collect()}
    said = tmp_path / "decisions"
    said.write_text(f"{at}/sub/b;keep\n")
    plan = run("finddupes", "-d", str(said)).splitlines()
    assert f"{at}/a;delete;another one was chosen" in plan and f"{at}/sub/b;keep;decided" in plan
    run("feedback", str(root / "one.png"), str(root / "far.png"), "similar")
    run("feedback", str(root / "one.png"), str(root / "far.png"), "different")
    run("feedback", str(root / "one.png"), str(root / "two.png"), "similar")
    run("feedback", str(root / "two.png"), str(root / "far.png"), "similar")
    run("feedback", str(root / "far.png"), str(root / "two.png"), "unknown")
    spoken = {(r.contentid1, r.contentid2): r.aresimilar for r in cli.Catalog(spark, str(cat)).read("imagefeedback").collect()}
    pair = lambda a, b: (min(ids[a], ids[b]), max(ids[a], ids[b]))
    assert spoken == {pair("one.png", "far.png"): 0, pair("one.png", "two.png"): 1}
    (cat / "lock").touch()
    with pytest.raises(SystemExit):
        run("index", str(root))
    (cat / "lock").unlink()
    known = spark.createDataFrame([(min(ids["one.png"], ids["two.png"]), max(ids["one.png"], ids["two.png"]), 1)], "contentid1 long, contentid2 long, aresimilar int")
    cli.Catalog(spark, str(cat)).write(imagefeedback=known)
    lines = run("stats").splitlines()
    assert len(lines) == 6 and lines[0].startswith("sig")
    (root / "a").unlink()
    gone = dict(x.split(": ") for x in run("index", str(root), "-x", "*.tmp").splitlines())
    assert gone["deleted"] == "1" and run("finddupes", "-t", "csv").splitlines()[1:] == []
    assert cli.Catalog(spark, str(cat)).read("content").where(F.col("size") == 5000).count() == 1
