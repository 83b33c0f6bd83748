import hashlib
import os
import shutil

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semblance import session
from semblance.functions import formatting, hashing
from semblance.operators import catalog, exact, feedback, prefix, signatures, similarity, store
from semblance.plans import deletion, progress, render
from semblance.schema import pairs_from_text, pairs_to_text, parts_from_text, parts_to_text
from semblance.sources import files as sources
from semblance.streaming import incremental


def counting_bytes(n):
    return bytes(i % 256 for i in range(n))


# Hashes of bytes that count from 0 to 255 and over again.
FIRST = "5b00669c480d5cffbdfa8bdba99561160f2d1b77"
FULL = {1025: "409c9978384c2832af4a98bafe453dfdaa8e8054", 2049: "170751534f1a95fd80a7a25787ecad2b60368e0a"}
PREFIX_2048 = "f10ccfde60c17db26e7d85d35665c7661dbbeb2c"


def test_content_hashes(spark):
    sizes = [1024, 1025, 2048, 2049, 5 << 20]
    df = spark.createDataFrame([(n, bytearray(counting_bytes(n))) for n in sizes], "n int, content binary")
    c = F.col("content")
    rows = {r.n: r for r in df.select("n", hashing.full_sha1(c).alias("full"), hashing.first1k_sha1(c).alias("first"), hashing.prefix_sha1s(c).alias("parts"), hashing.range_sha1(c, 10, 20).alias("cut")).collect()}
    assert all(r.first == FIRST for r in rows.values()) and all(rows[n].full == v for n, v in FULL.items())
    assert [sorted(rows[n].parts) for n in sizes] == [[], [], [], [2048], [2048 << i for i in range(12)]]
    assert rows[2049].parts[2048] == PREFIX_2048
    assert rows[1024].cut == hashlib.sha1(counting_bytes(1024)[10:30]).hexdigest()
    for n in sizes:
        for step in (7, 1000, 1 << 22):
            if n < 10_000 or step > 7:
                data = counting_bytes(n)
                full, first, parts, size = hashing.sha1s_of_stream(data[i : i + step] for i in range(0, n, step))
                assert (full, first, parts, size) == (rows[n].full, FIRST, rows[n].parts, n)


def test_image_kinds_and_hex(spark):
    heads = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FFE000104A464946", "gif": "474946383761", "tiff": "49492A00", "pbm": "503420", "pgm": "50350A", "ppm": "503320", "rgb": "01DA", "rast": "59A66A95", "xbm": "23646566696E6520", "bmp": "424D", None: "00"}
    df = spark.createDataFrame([(k, bytearray(bytes.fromhex(v) + b" " * 1024)) for k, v in heads.items()], "kind string, content binary")
    assert all(r.kind == r.got for r in df.select("kind", hashing.image_kind(F.col("content")).alias("got")).collect())
    words = ["ffffffffffffffff", "cac7ad2520000000", "0000000000000001"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.hex_to_long(F.col("w")).alias("n")).select("w", "n", hashing.long_to_hex(F.col("n")).alias("back")).collect()
    assert [r.n for r in got] == [-1, -3834906182720421888, 1] and [r.back for r in got] == words


def test_formatting(spark):
    # Sizes and durations as users see them.
    sizes = {0: "0", 999: "999", 1000: "1,000", 1023: "1,023", 1024: "1,024 (1.0 KiB)", 2048: "2,048 (2.0 KiB)", 414747471: "414,747,471 (395.5 MiB)", 34418050942: "34,418,050,942 (32.1 GiB)", 2000 * 2**40: "2,199,023,255,552,000 (2000.0 TiB)", 2 * 10**15: "2,000,000,000,000,000 (1819.0 TiB)"}
    times = {0: "0s", 59: "59s", 60: "1m 0s", 71: "1m 11s", 3600: "1h 0m", 86400: "1d 0h"}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "n long, want string")
    assert all(r.want == r.got for r in df.select("want", formatting.format_bytes(F.col("n")).alias("got")).collect())
    df = spark.createDataFrame([(k, v) for k, v in times.items()], "n long, want string")
    assert all(r.want == r.got for r in df.select("want", formatting.format_time_delta(F.col("n")).alias("got")).collect())
    assert formatting.split_patterns(None, ".git,CVS") == [".git", "CVS"] and formatting.split_patterns(["a,b", "c"], "x") == ["a", "b", "c"]
    names = ["x(", "7", "afoob", ".git", "gitx", "[", "a\nb"]
    rx = lambda p: [n for n in names if spark.createDataFrame([(n,)], "n string").where(F.col("n").rlike(formatting.globs_to_regex(p))).count()]
    assert rx(["*(", "[0-9]", "*foo*"]) == ["x(", "7", "afoob"] and rx([".git"]) == [".git"] and rx(["*"]) == names
    assert (formatting.max_distance(0.8, 3), formatting.max_distance(0.8, 1), formatting.max_distance(0.9, 1), formatting.max_distance(0.95, 3)) == (12, 19, 9, 3)
    for args in ((0.75, 3), (1.0, 1)):
        with pytest.raises(ValueError):
            formatting.max_distance(*args)
    assert formatting.threads_of("1.5C", 4) == 6 and formatting.threads_of("C", 4) == 4 and formatting.fit_into(200, 100, 50, 50) == (50, 25)


def files(spark, rows):
    return spark.createDataFrame([(c, s, d, n, i) for c, s, d, n, i in rows], "contentid long, size long, dir string, name string, inode long")


def test_equal_pairs_buckets_and_plan(spark):
    rows = [(1, 1024, "/d", "a", 1), (1, 1024, "/d", "b", 2), (1, 1024, "/d", "c", 3), (2, 1100, "/d", "x", 4), (2, 1100, "/d", "y", 5), (3, 2000, "/d", "u", 6), (4, 1500, "/d", "h1", 7), (4, 1500, "/d", "h2", 7)]
    got = [tuple(r) for r in exact.equal_pairs(files(spark, rows)).orderBy("ctxt_index", "ctxt_subindex").collect()]
    assert got == [
        (4, 1500, True, "/d/h1", "/d/h2", 0, 3, 0), (2, 1100, False, "/d/x", "/d/y", 1, 3, 0), (1, 1024, False, "/d/a", "/d/b", 2, 3, 0), (1, 1024, False, "/d/a", "/d/c", 2, 3, 1), (1, 1024, False, "/d/b", "/d/c", 2, 3, 2),
    ]
    buckets = exact.equal_buckets(files(spark, rows))
    assert [(r.contentid, r.files, r.is_first) for r in buckets.orderBy("size", ascending=False).collect()] == [(2, ["/d/x", "/d/y"], True), (1, ["/d/a", "/d/b", "/d/c"], False)]
    plan = {r.path: r.action for r in deletion.deletion_plan(files(spark, rows), "keep_last").collect()}
    assert plan == {"/d/a": "delete", "/d/b": "delete", "/d/c": "keep", "/d/x": "delete", "/d/y": "keep", "/d/h1": "keep", "/d/h2": "keep"}
    assert exact.equal_pairs(files(spark, [])).count() == 0
    odd = files(spark, [(1, 5, "/d", 'a;"b"', 1), (1, 5, "/d", "z", 2)])
    assert render.equal_pairs_csv(exact.equal_pairs(odd)).first().line == '5;False;"/d/a;""b""";/d/z'
    assert render.json_document(render.bucket_json(exact.equal_buckets(odd))) == '{"items": [\n{"size":5,"num_files":2,"files":["/d/a;\\"b\\"","/d/z"]}\n]}'


def test_truncated_files(spark):
    made = {
        "input_1": bytes(9000), "input_3": bytes(9000) + b"\2", "input_4": bytes(9000) + b"\1\2", "input_5": bytes(9000) + b"\2", "input_6": bytes(9000) + b"\2",
        "input_7": bytes(5000) + b"\1" * 3999, "input_8": bytes(8999), "input_9": b"\n" * 4000,
    }
    ids = {}
    for name, data in made.items():
        ids.setdefault(data, len(ids))
    c = F.col("content")
    contents = spark.createDataFrame([(i, len(d), bytearray(d)) for d, i in ids.items()], "id long, size long, content binary").select("id", "size", hashing.full_sha1(c).alias("fullsha1"), hashing.first1k_sha1(c).alias("first1ksha1"), hashing.prefix_sha1s(c).alias("parts"), "content")
    where = spark.createDataFrame([(ids[d], "/d", n) for n, d in made.items()], "contentid long, dir string, name string")
    got = [(r.large_size, r.large_path[3:], r.small_size, r.small_path[3:]) for r in prefix.truncated_pairs(contents, where).orderBy("ctxt_index", "ctxt_subindex").collect()]
    assert sorted(got) == sorted([(9002, "input_4", 9000, "input_1"), (9002, "input_4", 8999, "input_8"), *((9001, f"input_{i}", n, s) for n, s in ((9000, "input_1"), (8999, "input_8")) for i in (3, 5, 6)), (9000, "input_1", 8999, "input_8")])
    assert [g[0] for g in got] == sorted((g[0] for g in got), reverse=True)


# Signature files and their comparisons.
HAMMING_IN = "1234567890abcdef\n1234567890abcdef\n1234567890abcdee\n1234567890abcde0\nna\n123456789Fabcdef\n123456789Fabcdee\n1234567890abcdef\n123456089f000000\n"
HAMMING_OUT = """0: 88 6=2,1,,,2,1,,,,,,,,,, 1:0 2:1 3:4 5:4 6:5 7:0
1: 88 6=2,1,,,2,1,,,,,,,,,, 0:0 2:1 3:4 5:4 6:5 7:0
7: 88 6=2,1,,,2,1,,,,,,,,,, 0:0 1:0 2:1 3:4 5:4 6:5
2: 87 6=,3,,1,1,1,,,,,,,,,, 0:1 1:1 3:3 5:5 6:4 7:1
5: 76 6=,1,,,3,1,,,1,,,,,,, 0:4 1:4 2:5 3:8 6:1 7:4
6: 75 6=,1,,,1,3,,1,,,,,,,, 0:5 1:5 2:4 3:7 5:1 7:5
3: 72 6=,,,1,3,,,1,1,,,,,,, 0:4 1:4 2:3 5:8 6:7 7:4""".split("\n")
GRAY_IN = ["0123456789abcdef0123456789ab0000", "0123456789abcdef0123456789ab0000", "0123456789abcdef0123456789abff00", "0123456789abcdef0123456789abffff"]
HISTOGRAM_OUT = """0: 78 3=1,,,,,,1,,,,,,1,,,,,,, 1:0 2:6 3:12
1: 78 3=1,,,,,,1,,,,,,1,,,,,,, 0:0 2:6 3:12
2: 78 3=,,,,,,3,,,,,,,,,,,,, 0:6 1:6 3:6
3: 66 3=,,,,,,1,,,,,,2,,,,,,, 0:12 1:12 2:6""".split("\n")


def lines_of(compared, width):
    rows = render.kernel_lines(compared, width).join(compared.select("id", "score"), "id").orderBy(F.desc("score"), "id").collect()
    return [r.line for r in rows]


def test_signature_comparisons(spark, tmp_path):
    (tmp_path / "h").write_text("header\n" + HAMMING_IN)
    rows = sources.read_hamming_text(spark, str(tmp_path / "h"))
    assert lines_of(similarity.compare(rows, "hamming", 10, [17 - d for d in range(16)], 9), 16) == HAMMING_OUT
    for bands in (1, 3):
        (tmp_path / f"g{bands}").write_text("header\n" + "".join(" ".join([x] * bands) + "\n" for x in GRAY_IN))
        rows = sources.read_histogram_text(spark, str(tmp_path / f"g{bands}"))
        assert lines_of(similarity.compare(rows, "histogram", 20, [32 - d for d in range(32)], 4), 20) == HISTOGRAM_OUT


@pytest.mark.parametrize("cost,block", [(1e12, 1), (0, 40), (0, 4096), (1.5, 4096)])
def test_close_hashes_against_all_pairs(spark, monkeypatch, cost, block):
    import random

    monkeypatch.setattr(similarity, "COMPARE_NS", cost)
    monkeypatch.setattr(similarity, "BLOCK", block)
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(12)]
    words = sorted({(b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(0, 14)))) - (1 << 63) for b in base for _ in range(12)})
    classes = spark.createDataFrame([(w,) for w in words], "h long")
    for d in (0, 3, 7, 12, 15):
        want = {(a, b) for a in words for b in words if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= d}
        assert {(r.h1, r.h2) for r in similarity.close_hashes(classes, d).collect()} == want


def test_scores_saturate(spark):
    rows = spark.range(300).select("id", F.lit(7).cast("long").alias("h"))
    top = similarity.compare(rows, "hamming", 6, similarity.HAMMING_FACTORS, 2)
    assert [(r.id, r.score, r.total, len(r.pairs)) for r in top.orderBy("id").collect()] == [(0, 255 * 80, 299, 299), (1, 255 * 80, 299, 299)]


def test_store(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "a", 7)], "id long, name string, x int")
    ids = lambda **q: [r.id for r in store.find(df, sort="id desc", **q).collect()]
    assert ids(name="a") == [3, 1] and ids(x=store.Null) == [2] and ids(x=store.Null()) == [2] and ids(name=store.In(["a", "b"]), x=7) == [3] and ids(name=store.In([])) == []
    assert store.load(df, 2).name == "b"
    for bad in (lambda: store.load(df, 9), lambda: store.find(df, nothing=1), lambda: store.In("ab")):
        with pytest.raises((LookupError, ValueError, TypeError)):
            bad()
    assert [r.x for r in store.update_one(df, 2, x=9).orderBy("id").collect()] == [5, 9, 7] and store.delete(df, x=store.Null).count() == 2
    assert store.violations(df, "dir").count() == 1 and [r.name for r in store.referenced_at_least(df, "name", 2).collect()] == ["a"]
    new = spark.createDataFrame([("z",), ("a",), ("c",), ("c",), (None,)], "name string")
    assert sorted(tuple(r) for r in store.get_or_insert(spark.createDataFrame([(4, "a")], "id long, name string"), new, "name").collect()) == [(4, "a"), (5, "c"), (6, "z")]


def test_catalog_runs(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "name string, mtime long")
    new = spark.createDataFrame([("b", 1), ("c", 2), ("d", 1)], "name string, mtime long")
    assert {r.name: r.state for r in catalog.classify(old, new, ["name"]).collect()} == {"a": "deleted", "b": "unchanged", "c": "changed", "d": "new"}
    paths = spark.createDataFrame([("/a/b",), ("/a/b/c",), ("/a/bc",)], "p string")
    under = lambda **k: [r.p for r in paths.where(catalog.under_roots(F.col("p"), ["/a/b"], **k)).collect()]
    assert under() == ["/a/b", "/a/b/c"] and under(strict_compat=True) == ["/a/b", "/a/b/c", "/a/bc"]
    parts = spark.createDataFrame([("2048:ab 4096:cd", "3:0 7:4"), ("", "")], "a string, b string")
    got = parts.select(parts_to_text(parts_from_text(F.col("a"))).alias("a"), pairs_to_text(pairs_from_text(F.col("b"))).alias("b")).collect()
    assert [tuple(r) for r in got] == [("2048:ab 4096:cd", "3:0 7:4"), ("", "")]


def test_local_listing_and_stream(spark, tmp_path):
    root = tmp_path / "in"
    (root / ".git").mkdir(parents=True)
    (root / "sub").mkdir()
    for path, size in (("a", 1024), ("sub/b", 2049), (".hidden", 1500), (".git/x", 2000), ("small", 10)):
        (root / path).write_bytes(counting_bytes(size))
    os.symlink(root / "a", root / "link")
    os.link(root / "a", root / "hard")
    rows = {r.name: r for r in sources.list_local(spark, [str(root)], [".git"]).collect()}
    assert set(rows) == {"a", "b", ".hidden", "small", "link", "hard"} and not rows["link"].regular and rows["a"].inode == rows["hard"].inode
    listed = sources.list_store(spark, [str(root)], 1024)
    assert {r.name for r in listed.collect()} >= {"a", "b", "hard"}
    hashed = {r.name: r for r in sources.hash_large_files(sources.list_local(spark, [str(root / "sub")]), 100).collect()}
    assert hashed["b"].fullsha1 == FULL[2049] and hashed["b"].parts == {2048: PREFIX_2048}
    seen = []
    incremental.index_stream(incremental.file_stream(spark, str(root / "sub")), lambda df, _: seen.extend(df.collect()), str(tmp_path / "check")).awaitTermination()
    assert [(r.name, r.fullsha1) for r in seen] == [("b", FULL[2049])]


def test_feedback(spark):
    now = spark.createDataFrame([(1, 2, 1), (3, 4, 0)], "contentid1 long, contentid2 long, aresimilar int")
    changes = spark.createDataFrame([(1, 2, 0, 1, False), (3, 4, 1, 2, True), (5, 6, 1, 3, False), (5, 6, 0, 2, False)], "contentid1 long, contentid2 long, aresimilar int, seq long, deleted boolean")
    after = feedback.upsert_feedback(now, changes)
    assert sorted(tuple(r) for r in after.collect()) == [(1, 2, 0), (5, 6, 1)]
    found = feedback.canonical(spark.createDataFrame([(2, 1), (1, 2), (6, 5), (9, 9)], "a long, b long"), "a", "b")
    r = feedback.confusion(found, after).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 0, 0.5, 1.0)
    assert feedback.confusion(found, after.limit(0)).first().precision is None


def test_image_signatures(spark):
    import numpy as np

    white = np.full((20, 30, 3), 255, np.uint8)
    for image in (white, white * 0, white // 2):
        assert signatures.difference_signature(image) == signatures.average_signature(image) == "f" * 16
    assert signatures.histogram_signature(white) == " ".join((["0"] * 15 + ["ffff"]) * 3) and len(signatures.histogram_signature(white[..., 0]).split()) == 16
    split = white.copy()
    split[:, :15] = 0
    assert signatures.average_signature(split) == "0f" * 8 and len(signatures.cosine_signature(split)) == 16 and signatures.equalised_signature(split) == "0f" * 8
    rows = [(1, (20, 30, 3, bytearray(split.tobytes()))), (2, (20, 30, 3, bytearray(b"short")))]
    df = spark.createDataFrame(rows, "contentid long, image struct<height: int, width: int, nChannels: int, data: binary>")
    got = {(r.contentid, r.iht): r.hash for r in signatures.image_signatures(df, [1, 4]).collect()}
    assert got[1, 4] == "0f" * 8 and got[2, 4] is None and got[2, 1] is None
    contents = spark.createDataFrame([(1, True), (2, True), (3, False)], "id long, isimage boolean")
    hashes = spark.createDataFrame([(1, 3, "f"), (2, 1, None)], "contentid long, iht int, hash string")
    todo = lambda **k: sorted(tuple(r) for r in signatures.missing_signatures(contents, hashes, [1, 3], **k).collect())
    assert todo() == [(1, 1), (2, 3)] and todo(retry_failed=True) == [(1, 1), (2, 1), (2, 3)] and todo(strict_compat=True) == []


def test_queries_and_their_sql(spark):
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n != "pipeline" and not n.startswith("op")]
    assert len(names) >= 36 and set(names) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() >= 0


def test_band_cost_counts_rows_and_meetings():
    import random

    rnd = random.Random(1)
    words = [[rnd.getrandbits(16) & 0xF0FF for _ in range(4)] for _ in range(60)]
    counts = np.zeros((4, 1 << 16))
    for w in words:
        for b in range(4):
            counts[b, w[b]] += 1
    for d in (3, 7, 12):
        left, right = d // 4 // 2, d // 4 - d // 4 // 2
        near = lambda r: similarity._mask_words(r)
        meet = sum((x[b] ^ m) == (y[b] ^ o) for x in words for y in words for b in range(4) for m in near(left) for o in near(right))
        assert similarity.band_cost(counts, d) == pytest.approx(similarity.ROW_NS * 240 * (len(near(left)) + len(near(right))) + similarity.MEET_NS * meet)


def test_text_signature_takes_points_at_equal_distances(spark):
    import random

    rnd = random.Random(4)
    texts = ["".join(rnd.choices("abc é ß € 😀 z", k=k)) for k in (0, 1, 63, 64, 65, 100, 1000, 20_000)] + [None, "x" * 64]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(2)
    got = {r.id: r.h for r in rows.select("id", signatures.text_signature("text").alias("h")).collect()}
    for i, t in enumerate(texts):
        if t is None or len(t) < 64:
            assert got[i] is None
        else:
            v = [ord(t[k * len(t) // 64]) for k in range(64)]
            assert got[i] & (1 << 64) - 1 == int("".join("1" if x * 64 >= sum(v) else "0" for x in v), 2)


def test_kernel_results_are_read_back(spark, tmp_path):
    (tmp_path / "h").write_text("header\n" + HAMMING_IN)
    compared = similarity.compare(sources.read_hamming_text(spark, str(tmp_path / "h")), "hamming", 10, [17 - d for d in range(16)], 9)
    (tmp_path / "out").write_text("\n".join(HAMMING_OUT) + "\nnot a line\n")
    back = sources.read_kernel_results(spark, str(tmp_path / "out"))
    key = lambda df: sorted(tuple(r) for r in df.select("id", "score", "total", "counts", "pairs").collect())
    assert key(back) == key(compared)
    assert {(r.numpairs, r.listed, r.consistent) for r in similarity.listed_counts(back).collect()} == {(6, 6, True)}
    wrong = back.withColumn("total", F.col("total") + (F.col("id") == 3).cast("long"))
    assert [r.id for r in similarity.listed_counts(wrong).where("not consistent").collect()] == [3]


def test_batch_lists_and_signature_lines(spark, tmp_path):
    (tmp_path / "list").write_text("7 /a b/c.png\n8 /d\n")
    assert sorted((r.id, r.path) for r in sources.read_batch_list(spark, str(tmp_path / "list")).collect()) == [("7", "/a b/c.png"), ("8", "/d")]
    signed = spark.createDataFrame([(7, "00ff"), (8, None)], "id long, hash string")
    assert sorted(r.line for r in render.signature_lines(signed).collect()) == ["7 00ff", "8 FAILED"]


def test_progress_texts(spark):
    import io

    # Texts as users see them.
    assert progress.speed_text(30, 10) == " 180/min" and progress.speed_text(50, 10) == "   5/sec" and progress.speed_text(10**6, 1) == ">999/sec" and progress.speed_text(1, 0) == "unknown"
    assert progress.bar_text("Load", 1, 4, 30) == "Load: " + "=" * 10 + " " * 30 + "  25.0% in 30s [    2/min ] [ ETA   1m 30s ]"
    assert progress.finished_text("Load", 4, 4, 3600) == "Load: " + "=" * 40 + " 4/4 in 1h 0m [    0/min ]"
    out = io.StringIO()
    with progress.Progress(spark, "Count", out=out):
        spark.range(1000, numPartitions=8).repartition(4).count()
    assert "Count: " + "=" * 40 in out.getvalue() and out.getvalue().endswith("]\n")


def test_reviewed_plan(spark):
    rows = files(spark, [(1, 9, "/d", "a", 1), (1, 9, "/d", "b", 2), (1, 9, "/d", "c", 3), (2, 9, "/d", "x", 4), (2, 9, "/d", "y", 5), (3, 9, "/d", "u", 6), (3, 9, "/d", "v", 7)])
    said = spark.createDataFrame([("/d/b", "keep"), ("/d/x", "delete"), ("/d/y", "delete"), ("/nowhere", "keep")], "path string, action string")
    got = {r.path: (r.action, r.reason) for r in deletion.decided_plan(rows, said).collect()}
    assert {k: v[0] for k, v in got.items()} == {"/d/a": "delete", "/d/b": "keep", "/d/c": "delete", "/d/x": "keep", "/d/y": "delete", "/d/u": "keep", "/d/v": "delete"}
    assert got["/d/a"][1] == "another one was chosen" and got["/d/x"][1] == "last one of its content" and got["/d/b"][1] == "decided"


def test_kept_tables(spark, tmp_path, monkeypatch):
    df = spark.range(5)
    name = f"named-{os.getpid()}"
    first = session.kept(df, name)
    assert session.kept(spark.range(9), name).count() == 5  # the first run's
    other = session.kept(df.withColumn("x", F.lit(1)))
    assert os.path.isdir(other._kept_at) and other.count() == 5
    session.discard(other)
    session.discard(df)
    assert not os.path.exists(other._kept_at) and os.path.isdir(first._kept_at)
    shutil.rmtree(first._kept_at)
    again = session.kept(df)
    assert session.drop_kept(spark) >= 1 and not os.path.exists(again._kept_at)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master, getConf, getCheckpointDir = "spark://host:7077", lambda self: Conf(), lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())


def test_signature_files_are_numbered_over_blocks(spark, tmp_path):
    lines = [f"{i * 2654435761 % 2**64:016x}" if i % 7 else "na" for i in range(4000)]
    (tmp_path / "h").write_text("header\n" + "\n".join(lines) + "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = {r.id: r.h for r in sources.read_hamming_text(spark, str(tmp_path / "h")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {i: h & (1 << 64) - 1 for i, h in got.items()} == {i: int(x, 16) for i, x in enumerate(lines) if x != "na"}


def test_blocks_count_and_list_like_all_pairs(spark, monkeypatch):
    """Several blocks and tiles, copies and null bins; counts, pairs and lists agree with all pairs."""
    import random

    monkeypatch.setattr(similarity, "COMPARE_NS", 0)
    monkeypatch.setattr(similarity, "BLOCK", 160)
    monkeypatch.setattr(similarity, "SPREAD", 1)
    monkeypatch.setattr(similarity, "CENTRES", 2)
    monkeypatch.setattr(similarity, "WIDE", 16)
    monkeypatch.setattr(similarity, "TILE", {"hamming": 64, "histogram": 64})
    monkeypatch.setattr(similarity, "HELD", 50)
    rnd = random.Random(3)
    bits = [rnd.getrandbits(64) for _ in range(6)]
    hashes = [(rnd.choice(bits) ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(0, 9)))) - (1 << 63) for _ in range(150)]
    hashes += hashes[:20]
    centres = {n: [[rnd.randrange(256) for _ in range(n)] for _ in range(5)] for n in (16, 48)}
    bins = [[min(255, max(0, v + rnd.randrange(-30, 31))) for v in rnd.choice(centres[n])] for n in (16, 48) for _ in range(60)]
    bins += [list(b) for b in bins[:10]] + [[255] * 48, [0] * 48, [None] + bins[0][1:], [None] + bins[0][1:]]

    def percent(a, b):
        if len(a) != len(b) or None in a or None in b:
            return 99
        sad = sum(abs(x - y) for x, y in zip(a, b, strict=True))
        return 100 * (sad // 3 if len(a) == 48 else sad) // 4096

    for kind, values, limit, within in (("hamming", hashes, 12, 12), ("histogram", bins, 9, 8)):
        near = (lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()) if kind == "hamming" else percent
        want = {i: [(j, d) for j, b in enumerate(values) if j != i and (d := near(a, b)) <= within] for i, a in enumerate(values)}
        rows = spark.createDataFrame(list(enumerate(values)), f"id long, h {'long' if kind == 'hamming' else 'array<int>'}")
        pairs = similarity.similar_pairs(rows, kind, limit).collect()
        assert sorted((r.id1, r.id2, r.distance) for r in pairs) == sorted((i, j, d) for i, x in want.items() for j, d in x if i < j)
        factors = similarity.HAMMING_FACTORS if kind == "hamming" else similarity.HISTOGRAM_FACTORS
        got = {r.id: r for r in similarity.compare(rows, kind, limit, factors).collect()}
        assert set(got) == {i for i, x in want.items() if x}
        for i, r in got.items():
            assert [tuple(p) for p in r.pairs] == want[i] and r.total == len(want[i]) and r.score == sum(factors[d] for _, d in want[i])
        few = {r.id: r for r in similarity.compare(rows, kind, limit, factors, 40, listed=3).collect()}
        assert sorted(few) == sorted(sorted(got, key=lambda i: (-got[i].score, i))[:40])
        assert all([tuple(p) for p in r.pairs] == [(j, d) for j, d in want[i] if d <= (3 if kind == "hamming" else 2)] for i, r in few.items())


def test_comparisons_send_no_pairs_between_tasks(spark, monkeypatch):
    """Scores come from counts, and lists from the centres: no table of all close pairs is made."""
    monkeypatch.setattr(similarity, "COMPARE_NS", 0)
    monkeypatch.setattr(similarity, "_close_in_blocks", lambda *a: pytest.fail("all pairs were made"))
    monkeypatch.setattr(similarity, "_close_by_bands", lambda *a: pytest.fail("all pairs were made"))
    rows = spark.createDataFrame([(1, 7), (2, 6), (3, -1)], "id long, h long")
    assert [(r.id, r.total, [tuple(p) for p in r.pairs]) for r in similarity.compare(rows, "hamming", 12, similarity.HAMMING_FACTORS).orderBy("id").collect()] == [(1, 1, [(2, 1)]), (2, 1, [(1, 1)])]


def test_text_signatures_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(signatures, "PIECE", 100)
    texts = [None, "", "a" * 63, "ä" * 64, "abc" * 40, "é€𝄞x" * 50, "y" * 500]
    column = pa.array(["zz", *texts])[1:]
    whole = [signatures.points_of(pa.array([t or ""]))[0][0] for t in texts]
    want = [None if len(t or "") < 64 else int("".join("1" if p * 64 >= w.sum() else "0" for p in w), 2) for t, w in zip(texts, whole, strict=True)]
    assert [None if x is None else x & (1 << 64) - 1 for x in signatures.text_signature.func(column).to_pylist()] == want


def test_format_bytes_rounds_ties_to_even(spark):
    """As Python's and SQL's printf do: 1.25 is 1.2, 1.75 is 1.8, and what only comes near a tie is not one."""
    numbers = [1280, 1792, 1279, 1281, 1024 + 717, 1024 + 718, 2047, 1048575, (1 << 20) + (1 << 18), (1 << 30) * 7 + (1 << 28), (1 << 40) * 3 + (1 << 38), (1 << 40) - 1, (1 << 53) + 1, (1 << 62) + (1 << 38) + 1]
    numbers += [(k << 10) + f for k in range(1, 40) for f in (51, 256, 461, 768, 1023)]
    units = lambda n: next((p for p in (4, 3, 2, 1) if n >= 1024**p))
    want = [f"{n:,} ({n / 1024 ** units(n):.1f} {formatting.UNITS[units(n)]})" for n in numbers]
    rows = spark.createDataFrame(list(enumerate(numbers)), "i long, n long").select("i", formatting.format_bytes(F.col("n")).alias("s"))
    assert [r.s for r in rows.orderBy("i").collect()] == want
