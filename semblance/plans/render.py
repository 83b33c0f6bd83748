"""Results as the lines and files that users read: semicolon-separated values, JSON, report tables, kernel text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.rlike(r'[;"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, *columns: Column, name: str = "line") -> DataFrame:
    """A column of lines with ``;`` between values, quoted where they must be."""
    return df.select(F.concat_ws(";", *[_quoted(c) for c in columns]).alias(name))


def equal_pairs_csv(pairs: DataFrame) -> DataFrame:
    return csv_lines(pairs, F.col("size"), F.initcap(F.col("hardlinked").cast("string")), F.col("path1"), F.col("path2"))


def truncated_csv(pairs: DataFrame) -> DataFrame:
    return csv_lines(pairs, *[F.col(c) for c in ("large_size", "large_path", "small_size", "small_path")])


def similar_csv(pairs: DataFrame) -> DataFrame:
    return csv_lines(pairs, F.format_string("%.6f", F.col("similarity")), F.col("path1"), F.col("path2"))


HEADERS = {"bitequal": "size;hardlinked;path1;path2", "truncated": "largesize;largepath;smallsize;smallpath", "image": "similarity;path1;path2"}


def bucket_json(buckets: DataFrame) -> DataFrame:
    """One JSON object a bucket, with properly escaped paths."""
    return buckets.select(F.to_json(F.struct("size", F.col("n_files").alias("num_files"), "files")).alias("item"))


def similar_bucket_json(buckets: DataFrame) -> DataFrame:
    others = F.transform("others", lambda o: F.struct(o["similarity"].alias("similarity"), o["paths"].alias("paths")))
    return buckets.select(F.to_json(F.struct("score", F.struct(F.col("center").alias("paths")).alias("center"), others.alias("others"))).alias("item"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("sep", ";").option("header", True).mode("overwrite").csv(path)


def write_json(items: DataFrame, path: str) -> None:
    """One object a line: any number of writers, valid at any size."""
    items.write.mode("overwrite").text(path)


def json_document(items: DataFrame, most: int = 100_000) -> str:
    """``{"items": [...]}`` of a result small enough for a screen; larger ones are written by write_json."""
    rows = items.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} items: write them with write_json")
    return '{"items": [\n' + ",\n".join(r.item for r in rows) + "\n]}"


def kernel_lines(compared: DataFrame, width: int) -> DataFrame:
    """``id: score total=c0,c1,… o:d o:d…`` of a comparison; a count of none is left out."""
    counts = F.map_from_entries(F.transform("counts", lambda c: F.struct(c["distance"], c["count"])))
    row = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: F.coalesce(F.element_at(counts, d).cast("string"), F.lit(""))), ",")
    pairs = F.array_join(F.transform("pairs", lambda p: F.concat(p["contentid"].cast("string"), F.lit(":"), p["distance"].cast("string"))), " ")
    return compared.select("id", F.format_string("%d: %d %d=%s %s", F.col("id"), F.col("score"), F.col("total"), row, pairs).alias("line"))


def signature_lines(signed: DataFrame) -> DataFrame:
    """``id signature`` of rows (id, hash), ``id FAILED`` where there is none."""
    return signed.select(F.concat(F.col("id").cast("string"), F.lit(" "), F.coalesce("hash", F.lit("FAILED"))).alias("line"))


def stats_table(rows: list[tuple[int, dict]]) -> str:
    """A line for each signature with its counts and shares."""
    out = ["sig    tp    fp    fn  precision  recall      f1"]
    show = lambda x: "     -" if x is None else f"{x:6.3f}"
    for iht, r in rows:
        out.append(f"{iht:>3} {r['tp']:>5} {r['fp']:>5} {r['fn']:>5}     {show(r['precision'])}  {show(r['recall'])}  {show(r['f1'])}")
    return "\n".join(out)
