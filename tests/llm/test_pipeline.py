import os
import random
import shutil

import pytest

import corpus_pipeline
from semblance.session import kept, shared_folder

LANG = {"en": ["the", "ing", "ou", "th", "re", "st"], "de": ["sch", "ung", "ver", "ein", "ü", "ch"]}


def text(rnd, lang, n):
    return ["".join(rnd.choices(LANG[lang], k=rnd.randrange(2, 6))) for _ in range(n)]


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rnd = random.Random(4)
    docs = {i: text(rnd, rnd.choice(["en", "de"]), rnd.randrange(60, 120)) for i in range(1, 121)}
    langs = {i: "de" if any(x.startswith(("sch", "ung", "ver", "ein", "ü", "ch")) for x in w[:3]) else "en" for i, w in docs.items()}
    item = text(rnd, "en", 30)
    docs[200] = docs[3][:40] + ["changed"] + docs[3][41:]
    docs[201] = list(docs[4])
    passage = text(rnd, "en", 70)
    docs[10] = docs[10] + passage
    docs[11] = docs[11][:30] + passage + docs[11][30:]
    docs[12] = docs[12] + item[15:] + ["and"] + item[:15]
    rows = [(i, " ".join(w), langs.get(i, "en"), "s", len(" ".join(w))) for i, w in docs.items()]
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, "12 34 56", "en", "s", 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        table = kept(stage(spark, table, str(tmp_path)))
        seen[name] = {r.doc_id: r for r in table.collect()}
        if name != "packed":
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(1, 121)) - {12}
    assert set(seen["language"]) == clean | {12, 200, 201}
    assert set(seen["near_copies"]) == clean | {12}
    assert set(seen["passages"]) == clean | {12}
    assert seen["passages"][11].text.split() == docs[11][:30] + docs[11][100:] and seen["passages"][11].n_chars == len(seen["passages"][11].text)
    assert all(seen["passages"][i].text == " ".join(docs[i]) for i in clean - {11})
    assert set(seen["leaks"]) == clean and set(seen["packed"]) == clean
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == clean


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


#: Names that the stages use for themselves, or have used.
CLASHES = ["row", "id", "hash", "letters", "cls", "root", "component_id", "text_hash", "_hash", "_text", "_letters", "_lang_pred", "_lang_score", "_doc", "_tag", "_drop", "tag", "start", "end", "part", "g", "kind", "blob", "key", "ids", "a.b"]


def test_repeated_rows_clashing_columns_and_nulls(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, " ".join(text(rnd, lang, 80)), lang, "s", i) for i in range(60) for lang in [rnd.choice(["en", "de"])]]
    rows += [rows[5], rows[5], (5, "another text " + rows[7][1], "en", "s", 1), (None, " ".join(text(rnd, "en", 70)), "en", None, None), (61, None, None, None, None), (62, None, "en", "s", 0), (63, rows[9][1].translate({i: i - 32 for i in range(97, 123)}), None, "s", 3)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, *[f"{r[0]}{c}" for c in CLASHES]) for r in rows], names + "".join(f", `{c}` string" for c in CLASHES)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (None, rows[20][1]), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = table.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = kept(stage(spark, table, str(tmp_path)))
        assert table.columns == columns, name
        for r in table.collect():
            assert all(r[c] == f"{r.doc_id}{c}" for c in CLASHES), name
    left = [r.doc_id for r in table.collect()]
    # 20 holds an item, 63 is 9 again, and of 7 and the longer text the one of the lesser id stays
    assert sorted(left, key=str) == sorted([*(i for i in range(60) if i not in (7, 20)), 5, None], key=str)
    whole = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "length").fillna(-1).collect())
    assert sum(n for _, n in whole) > 0 and {d for d, _ in whole} == {-1 if d is None else d for d in left}


def test_a_named_run_takes_up_what_is_done(spark, tmp_path, monkeypatch):
    rnd = random.Random(7)
    spark.createDataFrame([(i, " ".join(text(rnd, "en", 60)), "en", "s", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    calls, name = [], f"run-{tmp_path.name}-{os.getpid()}"

    def counting(stage):
        return lambda spark, docs, sf_dir: (calls.append(stage.__name__), stage(spark, docs, sf_dir))[1]

    def broken(spark, docs, sf_dir):
        raise RuntimeError("lost")

    stages = [(n, counting(f)) for n, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages[:2], ("passages", broken), *stages[3:]])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, str(tmp_path), resume=name)
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    rows = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path), resume=name).collect()}
    shutil.rmtree(os.path.join(shared_folder(spark), name))
    assert rows == set(range(20))
