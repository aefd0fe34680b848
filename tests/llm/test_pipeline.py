"""The pipeline against a plain version of each stage, and on awkward documents."""

import hashlib
import struct

import corpus_pipeline as pipeline

from quarry.llm import decontaminate, neardup, queries, repeats, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}

    scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
    rows = {d: t for d, t in rows.items() if scores[d] < 0.5}
    classes = neardup.brute_force(sorted(rows.items()))
    rows = {d: t for d, t in rows.items() if classes[d] == d}
    kept = {}
    cut = {r[0]: r for r in repeats.brute_force(sorted(rows.items()))}
    stage = spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")
    for r in repeats.without_repeats(stage).collect():
        kept[r.doc_id] = r.text
        assert hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == cut[r.doc_id][3]
        assert cut[r.doc_id][2] or r.text == rows[r.doc_id]
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    leaked = {r.doc_id for r in decontaminate.leaks(spark.createDataFrame(sorted(kept.items()), "doc_id long, text string"), items).collect()}
    kept = {d: t for d, t in kept.items() if d not in leaked}

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in pipeline.run(spark, sf).collect()}
    want = {}
    for d, t in kept.items():
        ids = own.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
    assert got == want
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), sf).columns == columns, name


def test_awkward_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, least long, toxic int"
    rows = [(1, None, None, None, None, 1, 1), (2, "", "en", "s", 0, 1, 1), (3, "a b c", "en", "s", 5, 1, 1), (3, "a b c", "en", "s", 5, 1, 1), (None, "no id here at all", "en", "s", 17, 1, 1), (5, "word " * 20_000, "en", "s", 100_000, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.where("doc_id = 5").count() == 1, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert pipeline.STAGES[-1][1](spark, docs, sf).count() == len(rows)


def test_rows_of_one_id_go_by_their_own_texts(spark, sf):
    item = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text), key=len)
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    near = text["a"].replace("a59", "other")
    rows = [(1, text["a"]), (7, text["b"]), (7, near), (7, text["c"]), (None, text["d"]), (None, text["e"]), (None, text["d"].upper()), (None, text["e"]), (9, text["c"])]
    out = pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    kept = sorted(((r.doc_id, r.text.lower()) for r in out), key=str)
    assert kept == sorted([(1, text["a"]), (7, text["b"]), (7, text["c"]), (None, text["d"]), (None, text["e"])], key=str)
    rows = [(None, item), (None, text["a"]), (7, item), (7, text["b"]), (8, text["c"])]
    out = pipeline.drop_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(None, text["a"]), (7, text["b"]), (8, text["c"])], key=str)


def test_run_on_awkward_tables(spark, sf, tmp_path):
    import shutil

    for name in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path)
    item = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text), key=len)
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    rows = [(1, texts["a"]), (2, texts["a"]), (2, texts["b"]), (None, texts["c"]), (None, texts["c"]), (None, None), (3, ""), (4, item), (None, item + " more"), (5, "w " * 30_000), (6, texts["d"] + " " + texts["b"])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, marks string, score double, label int"
    docs = spark.createDataFrame([(*r, None, None, None, 1, "m", 0.5, 1) for r in rows], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = sorted(((r.doc_id, r.n_tokens) for r in pipeline.run(spark, str(tmp_path)).collect()), key=str)
    # copies, near copies and leaks are gone; of document 6 only what document 2 does not hold is left
    assert [d for d, _ in out] == [1, 2, 5, 6, None, None]
    assert dict(out[:4])[6] < dict(out[:4])[1] * 1.1
    empty = tmp_path / "empty"
    empty.mkdir()
    for name in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{name}.parquet", empty)
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    assert pipeline.run(spark, str(empty)).count() == 0
