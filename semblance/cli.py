"""Command line over a catalog of Parquet tables: index, image, finddupes, stats.

    python -m semblance index --catalog DIR ROOT... [-x GLOBS] [-X GLOBS]
    python -m semblance image --catalog DIR [-T 1.5C] [-s 0.8] [-S 3 | 1,2 | all]
    python -m semblance finddupes --catalog DIR [ROOT...] [-w bitequal|truncated|image] [-t csv|json|plan] [-d DECISIONS] [-o FILE] [-s 0.9] [-S 3]
    python -m semblance feedback --catalog DIR PATH1 PATH2 similar|different|unknown
    python -m semblance stats --catalog DIR

Each run of a command writes whole new tables and then points the catalog at them, so a broken run changes nothing.
Commands that write exclude each other. DECISIONS is a file of lines ``path;keep`` or ``path;delete``. ``-q`` before
the command turns the progress on standard error off.
"""

from __future__ import annotations

import argparse
import contextlib
import os
import shutil
import sys
import time
import uuid
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import formatting, hashing
from .operators import catalog, exact, feedback, prefix, signatures, similarity, store
from .plans import deletion, render
from .plans.progress import Progress, time_text
from .session import drop_kept, ship_package
from .sources import files as sources

TABLES = {"file": "dir STRING, name STRING, contentid BIGINT, size BIGINT, mtime BIGINT, dev BIGINT, inode BIGINT", "content": schema.CONTENT, "imagehash": "contentid BIGINT, iht INT, hash STRING", "imagecmp": schema.IMAGECMP, "imagefeedback": schema.IMAGEFEEDBACK}
#: Paths that Spark's image reader is given at once.
PATHS_AT_ONCE = 10_000
# Least similarities at which each signature is measured.
MEASURED_AT = {1: 0.95, 2: 0.999, 3: 0.9, 4: 0.95, 5: 0.8}


class Catalog:
    """Tables under a local or mounted folder; ``current`` there names the version of each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)
        os.makedirs(self.root, exist_ok=True)

    def _pointer(self) -> dict[str, str]:
        path = os.path.join(self.root, "current")
        return dict(line.split("=", 1) for line in open(path).read().split()) if os.path.exists(path) else {}

    def read(self, name: str) -> DataFrame:
        version = self._pointer().get(name)
        return self.spark.read.schema(TABLES[name]).parquet(os.path.join(self.root, version)) if version else self.spark.createDataFrame([], TABLES[name])

    @contextlib.contextmanager
    def locked(self):
        """For one writer at a time. Versions that no run points at any more go first."""
        lock = os.path.join(self.root, "lock")
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            raise SystemExit(f"another command writes to {self.root}; if none does, delete {lock}") from None
        try:
            used = set(self._pointer().values())
            for name in os.listdir(self.root):
                if name.rpartition("-")[0] in TABLES and name not in used:
                    shutil.rmtree(os.path.join(self.root, name), ignore_errors=True)
            yield
        finally:
            os.remove(lock)

    def write(self, **tables: DataFrame) -> None:
        pointer = self._pointer()
        for name, df in tables.items():
            version = f"{name}-{uuid.uuid4().hex}"
            df.select(*[F.col(c.split()[0]) for c in _columns(TABLES[name])]).write.parquet(os.path.join(self.root, version))
            pointer[name] = version
        new = os.path.join(self.root, f"current.{uuid.uuid4().hex}")
        with open(new, "w") as file:
            file.write("\n".join(f"{k}={v}" for k, v in pointer.items()))
        os.replace(new, os.path.join(self.root, "current"))


def _columns(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return out


def index(cat: Catalog, roots: list[str], skip_files: list[str], skip_dirs: list[str]) -> DataFrame:
    """Brings the catalog up to date with the roots and returns one row of counters."""
    roots = [os.path.realpath(r) for r in roots]
    listing = sources.list_local(cat.spark, roots, skip_dirs).dropDuplicates(["dir", "name"])
    fine = catalog.exclude_names(listing, "name", skip_files).where("regular").where(F.col("size") >= catalog.MIN_SIZE)
    old, keys = cat.read("file"), ["dir", "name"]
    inside = catalog.under_roots(F.concat_ws("/", "dir", "name"), roots)
    states = catalog.classify(old.where(inside), fine, keys)
    changed = fine.join(states.where("state in ('new', 'changed')"), keys, "left_semi")
    hashed = sources.hash_large_files(changed).where("fullsha1 is not null").withColumn("isimage", hashing.image_kind(F.col("head")).isNotNull())
    contents = cat.read("content")
    fresh = hashed.groupBy("fullsha1").agg(*[F.any_value(c).alias(c) for c in ("first1ksha1", "size", "parts", "isimage")])
    ids = store.get_or_insert(contents.select("id", "fullsha1"), fresh, "fullsha1")
    all_contents = contents.unionByName(fresh.join(contents, "fullsha1", "left_anti").join(ids, "fullsha1").select(*contents.columns))
    found = hashed.select("dir", "name", "fullsha1").join(ids, "fullsha1").join(changed.select("dir", "name", "size", "mtime", "dev", "inode"), keys).withColumnRenamed("id", "contentid").select(*old.columns)
    gone = states.where("state in ('deleted', 'changed')").select(*keys)
    failed = changed.join(hashed.select(*keys), keys, "left_anti").select(*keys, F.lit(True).alias("bad"))
    counted = listing.join(failed, keys, "left").withColumn("failed", F.coalesce("bad", F.lit(False)))
    counters = catalog.index_counters(counted, states, keys, skip_files, skip_dirs).first()
    cat.write(content=all_contents, file=old.join(gone, keys, "left_anti").unionByName(found))
    return counters


def _loaded(spark: SparkSession, paths: DataFrame):
    """Images (path, image) of paths, some thousands at a time, so that the driver never holds all."""
    rows = paths.select("path").distinct().toLocalIterator()
    while some := [r.path for r in islice(rows, PATHS_AT_ONCE)]:
        yield spark.read.format("image").option("dropInvalid", False).load(some).select(F.regexp_replace("image.origin", "^file:/+", "/").alias("path"), "image")


def images(cat: Catalog, similarity_: float, kinds: list[int], shown: bool = True) -> dict[int, float]:
    """Signatures that are missing, and the comparison of each kind at the similarity. Seconds that each kind's signatures took."""
    contents, first = cat.read("content"), cat.read("file").groupBy("contentid").agg(F.min(F.concat_ws("/", "dir", "name")).alias("path"))
    spent = {}
    for k in kinds:
        began = time.time()
        hashes = cat.read("imagehash")
        todo = signatures.missing_signatures(contents, hashes, [k]).join(first, "contentid")
        with Progress(cat.spark, f"Signatures of kind {k}", shown):
            made = [signatures.image_signatures(todo.join(some, "path").select("contentid", "image"), [k]) for some in _loaded(cat.spark, todo)]
            for part in made:
                hashes = hashes.unionByName(part)
            if made:
                cat.write(imagehash=hashes)
        spent[k] = time.time() - began
    hashes, compared = cat.read("imagehash"), cat.read("imagecmp").where(~F.col("iht").isin(kinds))
    for k in kinds:
        kind = signatures.REGISTRY[k].kind
        h = signatures.histogram_bins(F.col("hash")) if kind == "histogram" else hashing.hex_to_long(F.col("hash"))
        rows = hashes.where((F.col("iht") == k) & F.col("hash").isNotNull()).select(F.col("contentid").alias("id"), h.alias("h"))
        factors = similarity.HISTOGRAM_FACTORS if kind == "histogram" else similarity.HAMMING_FACTORS
        got = similarity.compare(rows, kind, formatting.max_distance(similarity_, k), factors)
        compared = compared.unionByName(got.select(F.col("id").alias("contentid"), F.lit(k).alias("iht"), F.lit(similarity_).alias("similarity_threshold"), "score", F.col("total").alias("numpairs"), "pairs"))
    with Progress(cat.spark, "Comparing signatures", shown):
        cat.write(imagecmp=compared)
    return spent


def record_feedback(cat: Catalog, path1: str, path2: str, verdict: str) -> None:
    """What a person says of two indexed files' contents; the last word counts, and ``unknown`` takes it back."""
    path = F.concat_ws("/", "dir", "name")
    found = {r.path: r.contentid for r in cat.read("file").select(path.alias("path"), "contentid").where(F.col("path").isin(os.path.realpath(path1), os.path.realpath(path2))).collect()}
    ids = [found.get(os.path.realpath(p)) for p in (path1, path2)]
    if None in ids or ids[0] == ids[1]:
        raise SystemExit("feedback is on two different contents that are indexed")
    change = cat.spark.createDataFrame([(min(ids), max(ids), int(verdict == "similar"), 1, verdict == "unknown")], "contentid1 long, contentid2 long, aresimilar int, seq long, deleted boolean")
    cat.write(imagefeedback=feedback.upsert_feedback(cat.read("imagefeedback"), change))


def find(cat: Catalog, what: str, form: str, roots: list[str], least: float, kinds: list[int], decisions: str | None = None) -> tuple[str, DataFrame]:
    """(header, lines) of the duplicates asked for."""
    path = F.concat_ws("/", "dir", "name")
    shown = cat.read("file").where(catalog.under_roots(path, [os.path.realpath(r) for r in roots]))
    if what == "truncated":
        paths = shown.groupBy(F.col("contentid").alias("large_id")).agg(F.min(path).alias("path"))
        many = cat.read("content").join(shown.select(F.col("contentid").alias("id")).distinct(), "id", "left_semi")
        pairs = prefix.truncated_pairs(many, shown, lambda needed: sources.hash_file_prefixes(needed, paths))
        if form == "plan":
            return "path;action;reason", render.csv_lines(deletion.truncated_plan(pairs), F.col("path"), F.col("action"), F.col("reason"))
        return render.HEADERS[what], render.truncated_csv(pairs)
    if what == "image":
        k = kinds[0]
        compared = cat.read("imagecmp").where(F.col("iht") == k).withColumnRenamed("contentid", "id")
        rows = similarity.with_paths(compared, shown, signatures.REGISTRY[k].divisor, least, all_paths=form == "json")
        return ("", render.similar_bucket_json(rows)) if form == "json" else (render.HEADERS[what], render.similar_csv(rows))
    if form == "json":
        return "", render.bucket_json(exact.equal_buckets(shown))
    if form == "plan":
        plan = deletion.deletion_plan(shown)
        if decisions:
            said = cat.spark.read.option("sep", ";").schema("path string, action string").csv(os.path.abspath(decisions))
            plan = deletion.decided_plan(shown, said)
        return "path;action;reason", render.csv_lines(plan, F.col("path"), F.col("action"), F.col("reason"))
    return render.HEADERS["bitequal"], render.equal_pairs_csv(exact.equal_pairs(cat.read("file"), shown))


def stats(cat: Catalog) -> str:
    known, out = cat.read("imagefeedback"), []
    for k, least in MEASURED_AT.items():
        near = cat.read("imagecmp").where(F.col("iht") == k).select("contentid", F.explode("pairs").alias("o")).where(formatting.similarity_of(F.col("o.distance"), k) >= least)
        found = feedback.canonical(near.select(F.col("contentid").alias("a"), F.col("o.contentid").alias("b")), "a", "b")
        out.append((k, feedback.confusion(found, known).first().asDict()))
    return render.stats_table(out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="semblance", description=__doc__.split("\n")[0])
    parser.add_argument("-q", "--quiet", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    add = {name: commands.add_parser(name) for name in ("index", "image", "finddupes", "feedback", "stats")}
    for p in add.values():
        p.add_argument("--catalog", default=os.path.join(os.path.expanduser("~"), ".semblance"))
    add["index"].add_argument("roots", nargs="+")
    add["index"].add_argument("-x", "--exclude-files", action="append")
    add["index"].add_argument("-X", "--exclude-dirs", action="append")
    add["image"].add_argument("-T", "--threads", default="C")
    for name, least in (("image", 0.8), ("finddupes", 0.9)):
        add[name].add_argument("-s", "--similarity", type=float, default=least)
        add[name].add_argument("-S", "--signatures", default="3")
    add["finddupes"].add_argument("roots", nargs="*")
    add["finddupes"].add_argument("-w", "--what", choices=["bitequal", "truncated", "image"], default="bitequal")
    add["finddupes"].add_argument("-t", "--type", choices=["csv", "json", "plan"], default="plan")
    add["finddupes"].add_argument("-o", "--output")
    add["finddupes"].add_argument("-d", "--decisions")
    add["feedback"].add_argument("path1")
    add["feedback"].add_argument("path2")
    add["feedback"].add_argument("verdict", choices=["similar", "different", "unknown"])
    args = parser.parse_args(argv)
    if spark is None:
        threads = formatting.threads_of(getattr(args, "threads", "C"), os.cpu_count() or 1)
        spark = SparkSession.builder.master(os.environ.get("MASTER", f"local[{threads}]")).appName("semblance").config("spark.ui.enabled", "false").getOrCreate()
    ship_package(spark)
    cat = Catalog(spark, args.catalog)
    kinds = sorted(signatures.REGISTRY) if getattr(args, "signatures", "") == "all" else [int(x) for x in getattr(args, "signatures", "3").split(",")]
    try:
        _run(args, cat, kinds)
    finally:
        drop_kept(spark)


def _run(args: argparse.Namespace, cat: Catalog, kinds: list[int]) -> None:
    if args.command == "index":
        with cat.locked(), Progress(cat.spark, "Indexing", not args.quiet):
            counters = index(cat, args.roots, formatting.split_patterns(args.exclude_files, ""), formatting.split_patterns(args.exclude_dirs, ".git,CVS,RCS"))
        print("\n".join(f"{k}: {v}" for k, v in counters.asDict().items()))
    elif args.command == "image":
        with cat.locked():
            spent = images(cat, args.similarity, kinds, not args.quiet)
        for k, seconds in spent.items():
            print(f"  hash type {k} used {time_text(seconds)}", file=sys.stderr)
    elif args.command == "feedback":
        with cat.locked():
            record_feedback(cat, args.path1, args.path2, args.verdict)
    elif args.command == "stats":
        print(stats(cat))
    else:
        header, lines = find(cat, args.what, args.type, args.roots, args.similarity, kinds, args.decisions)
        out = open(args.output, "w", encoding="utf-8") if args.output else sys.stdout
        try:
            if args.type == "json" and args.what != "truncated":
                print(render.json_document(lines), file=out)
            else:
                print(header, file=out)
                for row in lines.toLocalIterator():
                    print(row[0], file=out)
        finally:
            if args.output:
                out.close()
