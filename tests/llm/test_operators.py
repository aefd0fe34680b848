"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import io
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import cotrain, decontaminate, fingerprint, langid, lexicon, license, neardup, queries, repeats, scan, sstable, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, marks string, score double, same string, words string"
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(45))
TEXTS = [
    (1, f"start one {PASSAGE} end one"),
    (2, f"other words {PASSAGE} and more"),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "a a a " * 40),
    (7, LONG),
    (8, LONG + " tail"),
    (9, f"start one {PASSAGE} end one"),
    (9, f"start one {PASSAGE} end one"),
    (10, "Released under the MIT License. Apache License, Version 2.0 and CC BY-NC cc by nc"),
    (11, "İ ß 日本語 \x00 it's <|endoftext|> é́ 12.5"),
    (12, "one two three"),
    (None, "a row without an id, " * 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", None, 7, "m", 0.5, "x", "y") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def vocab(name):
    return queries.vocabulary(name)


def thue_morse(a, b):
    """Two different words of 1,024 letters on which plain polynomial hashes modulo 2^64 clash, whatever the base."""
    return "".join((a, b)[i.bit_count() % 2] for i in range(1024))


CLASH = thue_morse("a", "b"), thue_morse("b", "a")


def cut_rows(df, *sizes):
    kept = F.sha2(F.col("kept_text").cast("binary"), 256)
    return sorted((tuple(r) for r in repeats.remove_repeats(df, *sizes).select("doc_id", "n_words", "n_removed", kept).collect()), key=str)


@pytest.mark.parametrize("sizes", [(), (1 << 16, 500), (2000, 3)])
def test_repeats(spark, docs, odd, sizes):
    """Also in many groups, and with so small ones that every prefix is split and salted."""
    head = " ".join(f"q{i}" for i in range(19))
    clash = [(i, f"{head} {CLASH[k]}") for i, k in enumerate((0, 1, 0))]
    nulls = [(None, f"x {PASSAGE}"), (None, f"y {PASSAGE}"), (None, f"x {PASSAGE}"), (None, None), (5, f"z {PASSAGE}"), (5, f"{PASSAGE} z")]
    for df in (docs, odd, spark.createDataFrame(clash + nulls, "doc_id long, text string")):
        assert cut_rows(df, *sizes) == sorted(repeats.brute_force(plain(df)), key=str)
    assert repeats.digest(odd.limit(0)).count() == 0


def test_hot_passage(spark):
    """A passage that every row holds, and a third of all rows alike."""
    rows = [(None if i % 3 == 0 else i, f"same {PASSAGE}" if i % 3 == 0 else f"u{i} {PASSAGE} v{i} {PASSAGE}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert cut_rows(df, 5000, 12) == sorted(repeats.brute_force(rows), key=str)


def test_passages(spark):
    rows = [(1, f"a b {PASSAGE} c"), (2, f"d {PASSAGE} e f {PASSAGE}"), (3, "nothing here")]
    found = repeats.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in found} == {(2, 1, 45, PASSAGE), (2, 48, 45, PASSAGE)}


def test_repeats_keep_other_columns(odd):
    out = repeats.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(TEXTS)
    assert out.where("doc_id = 5").first().text == "   \n\t "


def test_near_duplicates(docs, odd):
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == neardup.brute_force(plain(docs))
    found = neardup.classes(odd).collect()
    assert len(found) == len(TEXTS)
    by = {r.doc_id: r.class_id for r in found}
    assert by[9] == 1 and by[8] == 7 and by[3] == by[4] == by[5] == 3 and by[12] == 12
    assert neardup.classes(odd.limit(0)).count() == 0


def test_hub_of_near_copies(spark):
    """Copies far from each other and near one hub that is not the least id are one class."""
    base = [f"h{i}" for i in range(200)]
    rows = [(50, " ".join(base))]
    for c in range(12):
        words = list(base)
        for k in range(3):
            at = (c * 16 + k * 5) % 200
            words[at] = f"c{c}k{k}"
        rows.append((c, " ".join(words)))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == neardup.brute_force(rows)


def test_bridge_between_linked_subfamilies(spark):
    """p-q is the only link between two subfamilies, and every bucket they share holds decoys of lesser ids."""
    import random

    r = random.Random(3)
    base = [f"h{i}" for i in range(400)]

    def edited(words, places, mark):
        words = list(words)
        for k in places:
            words[k] = f"{mark}x{k}"
        return words

    p, q = base, edited(base, range(5, 85, 10), "q")
    rows = [(0, edited(p, range(105, 145, 10), "a")), (1, edited(q, range(205, 245, 10), "b")), (1000, p), (1001, q)]
    rows += [(c, edited(base, r.sample(range(255, 395, 5), 10), f"d{c}")) for c in range(2, 302)]
    rows = [(d, " ".join(words)) for d, words in rows]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == neardup.brute_force(rows)
    assert got[1000] == got[1001] == got[1] == 0 and len(set(got.values())) == 301


@pytest.mark.parametrize("seed", [1, 2])
def test_two_hubs_with_satellites(spark, seed):
    """x and y are near each other, and each has 40 satellites that are near it alone."""
    import random

    r = random.Random(seed)
    x = [f"w{i}" for i in range(300)]
    y = list(x)
    for k in (40, 150, 260):
        y[k] = f"y{k}"
    rows = [(500, x), (501, y)]
    for c in range(80):
        words = list((x, y)[c % 2])
        for k in r.sample(range(300), 5):
            words[k] = f"s{c}k{k}"
        rows.append((c, words))
    rows = [(d, " ".join(words)) for d, words in rows]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == neardup.brute_force(rows)
    assert got[500] == got[501]


def test_clashing_words_are_no_copies(spark):
    rows = [(1, CLASH[0]), (2, CLASH[1]), (3, CLASH[0].upper() + "!"), (4, " ".join(CLASH[0])), (5, " ".join(CLASH[1]))]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == neardup.brute_force(rows) == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


@pytest.mark.parametrize("limits", [(2000, 10**6), (3, 10**6), (2000, 1000)])
def test_blocks_of_a_bucket(spark, docs, monkeypatch, limits):
    monkeypatch.setattr(neardup, "MEMBERS", limits[0])
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", limits[1])
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == neardup.brute_force(plain(docs))


def test_repeats_within_a_text_lose_no_link(spark):
    """The same shingles, ten of them a hundred times over in one text: equal sets."""
    rows = []
    for k in range(8):
        head, cycle = [f"k{k}w{i}" for i in range(100)], [f"k{k}c{i}" for i in range(10)]
        rows += [(2 * k, " ".join(head + cycle * 2)), (2 * k + 1, " ".join(head + cycle * 100))]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == neardup.brute_force(rows) == {d: d - d % 2 for d, _ in rows}


def test_registers_estimate_probability_jaccard():
    import numpy as np

    doc = np.repeat([0, 1], 400)
    found = scan.mix(np.append(np.arange(400), np.arange(100, 500)).astype(np.uint64))
    held = neardup.registers(2, doc, found, np.ones(800), 4096)
    assert abs((held[0] == held[1]).mean() - 0.6) < 0.04


@pytest.mark.parametrize("name", ["op2_template_decontamination", "op5_diagonal_licenses"])
def test_against_sql(name, spark, sf, duck):
    from conftest import same_rows

    same_rows(queries.queries()[name](spark, sf), duck, queries.oracle_sql()[name])


def test_licenses(odd):
    got = {(r.doc_id, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license.scan_licenses(odd).collect()}
    assert license.scan_licenses(odd).count() == len(TEXTS)
    assert (10, 4, 1, 14, "apache-2,cc-by-nc,mit", "apache-2,cc-by-nc,mit") in got
    assert (4, 0, None, None, "", "") in got
    near = "permission is hereby granted free of charge to any person who is obtaining a copy of this software and associated documentation files the software to deal in the software without any restriction"
    assert license.scan_licenses(odd.limit(1).withColumn("text", F.lit(near))).first().labels == "mit"
    assert license.scan_licenses(odd.limit(0)).count() == 0


def test_templates(spark):
    items = spark.createDataFrame([(1, "If Alice buys 3 kg of apples for 5 dollars and then Alice sells 3 kg back to Bob, how many does Alice keep?"), (2, "short one Here"), (3, None), (4, "")], "item_id long, text string")
    again = "Foo. If Carol buys 7 kg of apples for 9 dollars and then Carol sells 7 kg back to Dan, how many does Carol keep?"
    mixed = "If Carol buys 7 kg of apples for 9 dollars and then Eve sells 8 kg back to Dan, how many does Zoe keep?"
    rows = [(1, again), (2, mixed), (3, None), (4, ""), (5, "a short one Here, too"), (6, "nothing of the kind"), (None, again), (None, "nothing"), (7, "nothing"), (7, again), (8, mixed), (8, mixed)]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (None, 1), (5, 2), (7, 1)}
    assert decontaminate.leaks(items.limit(0).withColumnRenamed("item_id", "doc_id"), items).count() == 0
    assert decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items.limit(0)).count() == 0


def test_template_occurrences_and_opening_names(spark):
    """Each occurrence counts by itself, and names that open a sentence are slots, too."""
    item = "Tom has 12 apples. Tom gives 5 to Ann. Then Ann gives 2 back to New York. How many apples does Tom have left now?"
    other = item.replace("Tom", "Sam").replace("12", "31").replace("5", "9").replace("Ann", "Eve").replace("New York", "Paris")
    mixed = "Sam has 31 apples. Leo gives 9 to Eve. Then Max gives 4 back to Paris. How many apples does Kim have left now?"
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(7, "Nobody. " + item.lower().replace("tom", "Tom")), (1, f"{item} and {other}"), (2, f"{long} {item} {long}"), (3, other), (5, f"{other} z {mixed} z {other.replace('Sam', 'Bill')}"), (6, item.replace("apples.", "red apples."))]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, item string, place int")
    found = {r.doc_id: r for r in decontaminate.leaks(docs, items).collect()}
    assert set(found) - {7} == {1, 2, 3, 5, 6}
    assert all(found[d].coverage == 1 and found[d].consistency == 1 for d in (1, 2, 3, 5))
    plain = "The river runs by the old mill. It turns the wheel all day. Then the miller sleeps at night."
    items = spark.createDataFrame([(1, plain)], "item_id long, text string")
    docs = spark.createDataFrame([(1, plain.upper()), (2, plain.lower())], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, items).collect()} == {1, 2}


def test_templates_joined_by_shuffle(spark, sf, duck, monkeypatch):
    from conftest import same_rows

    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    name = "op2_template_decontamination"
    same_rows(queries.queries()[name](spark, sf), duck, queries.oracle_sql()[name])


@pytest.mark.parametrize("most", [fingerprint.BROADCAST_TERMS, 0])
def test_fingerprints(spark, docs, odd, monkeypatch, most):
    monkeypatch.setattr(fingerprint, "BROADCAST_TERMS", most)
    odds = odd.where("doc_id <> 11")  # Java and Python differ in the small letters of the capital dotted I
    one = odd.where("doc_id = 4")
    ties = spark.createDataFrame([(7 if i % 3 else None, f"word{i % 5} some more of it {i % 7}") for i in range(300)], "doc_id long, text string")
    for df in (docs, odds, ties, one):
        got = [tuple(r) for r in fingerprint.fingerprints(df).collect()]
        assert sorted(got, key=str) == sorted(fingerprint.brute_force(plain(df)), key=str)
    found = fingerprint.fingerprints(odd).collect()
    assert len(found) == len(TEXTS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert len({r.fingerprint for r in found if r.doc_id in (3, 4)}) == 1
    assert fingerprint.fingerprints(odd.limit(0)).count() == 0


def test_fingerprints_tell_edits(docs):
    got = fingerprint.fingerprints(docs).collect()
    assert sum(r.near_edited > r.near_next for r in got) > 0.7 * len(got)


def test_toxicity(spark, docs, odd, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.digest(odd, labels).collect()
    assert len(found) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert toxicity.digest(odd, labels.limit(0)).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.digest(docs.limit(0), labels).count() == 0
    assert toxicity.scored(odd, toxicity.train(docs, labels)).columns[-1] == "score"


def test_toxicity_learns_pairs():
    """Either term alone is harmless, both together are toxic: only an interaction can tell."""
    import random

    import numpy as np

    r = random.Random(5)
    rows = []
    for _ in range(3000):
        a, b = r.random() < 0.4, r.random() < 0.4
        slots = {r.randrange(1000, 3000) for _ in range(20)} | ({11} if a else set()) | ({22} if b else set())
        rows.append((int(a and b), np.array(sorted(slots), np.int32).tobytes()))
    machine = toxicity.fit(rows)
    m = machine.margins(3, np.array([0, 1, 2, 2]), np.array([11, 22, 11, 22]))
    assert m[2] > 0 > max(m[0], m[1])


@pytest.mark.parametrize("kind", ["one of both", "both"])
def test_toxicity_learns_pairs_that_tell_nothing_alone(kind):
    """Each term's own rows are as toxic as the rest; toxic are those with one of the two, or those with both."""
    import random

    import numpy as np

    r = random.Random(5)
    rows = []
    for _ in range(6000):
        if kind == "both":
            k = r.random()
            a, b = k < 0.16, k < 0.02 or 0.16 <= k < 0.30
            toxic = int(a and b) if a or b else int(r.random() < 0.13)
        else:
            a, b = r.random() < 0.5, r.random() < 0.5
            toxic = int(a != b)
        slots = {r.randrange(1000, 3000) for _ in range(20)} | ({11} if a else set()) | ({22} if b else set())
        rows.append((toxic, np.array(sorted(slots), np.int32).tobytes()))
    base = sum(t for t, _ in rows) / len(rows)
    for slot in (11, 22):
        own = [t for t, x in rows if slot in np.frombuffer(x, np.int32)]
        assert abs(sum(own) - base * len(own)) < 2 * (base * (1 - base) * len(own)) ** 0.5
    m = toxicity.fit(rows).margins(3, np.array([0, 1, 2, 2]), np.array([11, 22, 11, 22]))
    assert (m[2] > 0 > max(m[0], m[1])) if kind == "both" else (m[2] < 0 < min(m[0], m[1]))


def test_toxicity_scores_by_hand(spark, docs):
    """The machine's sum over single terms and over all pairs of them, term by term."""
    import itertools
    import math

    import numpy as np

    def slot(word):
        data = np.frombuffer(word, np.uint8)
        return int(scan.hash_bytes(data, np.array([0]), np.array([len(word)]))[0]) & ((1 << toxicity.SLOT_BITS) - 1)

    large = "/root/testdata/sf0.1"
    machine = toxicity.train(spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet"))
    assert len(machine.weight)
    rows = [(i, t) for i, t in TEXTS if i not in (7, 8)] + [(1000 + r.doc_id, r.text) for r in docs.limit(40).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.score) for r in toxicity.scored(df, machine).collect()), key=str)
    for (i, t), (j, _, score) in zip(sorted(rows, key=str), got, strict=True):
        found = {slot(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))}
        at = sorted(int(machine.known[s]) for s in found if machine.known[s] >= 0)
        margin = machine.bias + sum(machine.weight[a] for a in at) + sum(float(machine.vectors[a] @ machine.vectors[b]) for a, b in itertools.combinations(at, 2))
        assert i == j and abs(score - 1 / (1 + math.exp(-max(-40.0, min(40.0, margin))))) < 1e-9


def test_one_row_for_each_label(spark):
    """Of many rows under one labelled doc_id one is fitted on, whatever the order of the rows."""
    rows = [(i, f"w{i % 7} {'bad' if i % 3 == 0 else 'good'} x{i}") for i in range(300)] + [(5, f"noise {k}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    one, two = (toxicity.train(d, labels) for d in (docs, docs.repartition(7)))
    assert one.bias == two.bias and (one.weight == two.weight).all() and (one.vectors == two.vectors).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for found, kind in ((toxicity.digest(docs, labels), "toxic"), (cotrain.scored(docs, labels), "quality")):
        rows = found.join(labels, "doc_id").where("held_out").select("score", F.col(kind).alias("y")).toPandas()
        good, bad = rows[rows.y == 1].score.values, rows[rows.y == 0].score.values
        assert (good[:, None] > bad[None, :]).mean() > 0.93


def test_quality_on_awkward_rows(spark, odd, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = cotrain.scored(odd, labels, 200).collect()
    assert len(found) == len(TEXTS) and all(0 <= r.score <= 1 for r in found)
    assert cotrain.scored(odd, labels.limit(0)).first().score == 0.5
    assert cotrain.scored(odd.limit(0).select("doc_id", "text"), labels).count() == 0
    again = odd.unionByName(odd).select("doc_id", F.concat(F.lit("x " * 100_000), F.coalesce("text", F.lit(""))).alias("text"))
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 13)], "doc_id long, quality int")
    found = cotrain.scored(again, marks).collect()
    assert len(found) == 2 * len(TEXTS) and all(0 <= r.score <= 1 for r in found)


def test_views_teach_each_other(spark):
    """Text tells what metadata cannot learn from few labels, and the other way round; by brute force over all rows."""
    import numpy as np

    good, bad = "the quick story of a river " * 5, "$$$ ### %%% !!! *** &&& " * 5
    rows = [(i, (good if i % 2 else bad) + f"{i}", "en", f"s{i % 2}", 100 + i % 3) for i in range(3000)]
    # texts that tell nothing, from sources that only pseudo-labels can teach
    rows += [(i, "12345 67890 " * 9, "en", f"s{i % 2}", 100) for i in range(3000, 3200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    found = {r.doc_id: r for r in cotrain.scored(docs, labels).collect()}
    assert np.mean([(found[i].score >= 0.5) == (i % 2 == 1) for i, *_ in rows[:3000]]) > 0.99
    assert all((found[i].metadata_score >= 0.5) == (i % 2 == 1) for i, *_ in rows)
    first = cotrain.train(docs, labels, rounds=0)
    second = cotrain.train(docs, labels, rounds=1)
    text = lambda part: cotrain.text_view(len(part), np.frombuffer("".join(r[1] for r in part).encode(), np.uint8), np.append(0, np.cumsum([len(r[1]) for r in part])))
    names = lambda part: cotrain.metadata_view(*zip(*[r[2:] for r in part], strict=True))
    known = [r for r in rows if r[0] < 40 and not toxicity.held_out_by_hand(r[0]) and zlib.crc32(str(r[0]).encode()) % 5 != 1]
    free = [r for r in rows if r[0] >= 40 or toxicity.held_out_by_hand(r[0])]
    a, b = cotrain.Sums(), cotrain.Sums()
    a.add_text(text(known).astype(np.float16).astype(np.float32), np.array([r[0] % 2 for r in known]))
    a.add_names(names(known), np.array([r[0] % 2 for r in known]))
    _, by_text, by_names = first.scores(text(free), names(free))
    sure = lambda p: np.where(p >= cotrain.SURE, 1, np.where(p <= 1 - cotrain.SURE, 0, -1))
    b.add_names(names(free), sure(by_text))
    b.add_text(text(free), sure(by_names))
    assert b.names[:, 0].sum() > 0
    want = cotrain.Views(a.with_pseudo(b))
    assert np.allclose(want.slots, second.views.slots) and np.allclose(want.line, second.views.line, rtol=1e-3, atol=1e-3)


def test_languages(spark, sf, docs):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    models = langid.train(docs)
    long = " ".join(r.text for r in docs.where("lang = 'de'").orderBy("doc_id").limit(30).collect())
    awkward = [(1, None, None), (2, "http://x.example.de/de/a", ""), (3, "nonsense", "<html lang=fr><p>"), (None, None, "<html>"), (1, None, None), (None, "HTTP://U@Example.DE:80/x", f"<html LANG='de-AT'><script>x</script>{long}")]
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()] + awkward * 2
    got = langid.identify(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, prior int").repartition(5), docs).collect()
    key = lambda r: (str(r[0]), r[1], round(r[2], 6), r[3], str(r[4]))
    assert sorted(map(key, got)) == sorted(map(key, langid.brute_force(rows, models)))
    assert langid.identify(pages, docs.limit(0)).first().lang == "und"
    assert langid.identify(pages.limit(0), docs).count() == 0


def test_many_languages(spark):
    """No cap on languages, and a very long page."""
    docs = spark.createDataFrame([(i, " ".join(f"k{i}q{j}" for j in range(60)), f"l{i:03d}") for i in range(260)], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(i, None, "<p>" + " ".join(f"k{i}q{j}" for j in range(20, 60)) * (400 if i == 3 else 1)) for i in (0, 3, 77, 259)], "page_id long, url string, html string")
    assert {r.page_id: r.lang for r in langid.identify(pages, docs).collect()} == {i: f"l{i:03d}" for i in (0, 3, 77, 259)}


def test_text_alone_tells_the_language(spark, docs):
    """Pages made of labelled documents, with nothing else to go by, a misleading declaration, and a site's habit."""
    rows = [(r.doc_id, r.lang, r.text) for r in docs.where("length(text) > 300 and lang in ('en', 'de', 'fr', 'es')").collect()]
    pages = [(i, None, f"<p>{t}") for i, _, t in rows] + [(10_000 + i, f"http://www.one.example/{i}", f'<html lang="xx"><p>{t}') for i, _, t in rows]
    # no text at all: the site of many French pages, and the declaration others use
    french = [t for _, k, t in rows if k == "fr"]
    pages += [(20_000 + i, f"http://fr.site.example/{i}", f'<html lang="fr"><p>{french[i % len(french)]}') for i in range(60)]
    pages += [(30_000, "http://fr.site.example/z", ""), (30_001, None, '<html lang="fr">')]
    got = {r.page_id: r.lang for r in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert sum(got[i] == k for i, k, _ in rows) > 0.97 * len(rows)
    assert sum(got[10_000 + i] == k for i, k, _ in rows) > 0.97 * len(rows)
    assert got[30_000] == got[30_001] == "fr"


def reference(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_transducer_coding(docs, odd):
    from tokenizers import Tokenizer

    path = vocab("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    for df in (docs, odd):
        got = {r.doc_id: r for r in lexicon.digest(df, path).collect()}
        for d, t in plain(df):
            ids, text = reference(own, t)
            assert got[d].n_tokens == len(ids)
            assert got[d].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            assert got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert lexicon.digest(odd.limit(0), path).count() == 0


ODD = [" ".join(CLASH), "It's don't we're they'll I'd you've ''s 'story 'll'd x'ss 'r 'rex 'v 'l", "a<|endoftext|>b <|startoftext|>", "İstanbul ŉ ß ẞ ǅ", "日本語 テスト 123 ½ ²", "éa   x\x1cy\x85z 　 z", "ÀÉ d'été 12 3.4%%% a_b __", "'", "a'", "🙂🙂 ok\r\n\tz  \n\n a", "ﬁ Å Ω", "\x00a\x7f", "  b", "x" * 700, "-- '' \"'s"]


def test_odd_texts_word_bpe():
    from tokenizers import Tokenizer

    with open(vocab("word_bpe_49k.json"), encoding="utf-8") as file:
        text = file.read()
    own, merges = Tokenizer.from_str(text), lexicon.Merges(text)
    words = [b"the", b"then", b"story", b"a", b"zz"]
    coder = lexicon.Coder(lexicon.compile_lexicon(dict(zip(words, merges.encode(words), strict=True))), text)
    for t, (ids, decoded, n) in zip(ODD, coder.texts(ODD), strict=True):
        want, back = reference(own, t)
        assert (ids, decoded.decode(), n) == (struct.pack(f"<{len(want)}I", *want), back, len(want)), t


def test_transducer_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["stop", "stops", "top", "tops", "tap", "taps", "é"])}
    lex = lexicon.Lexicon(lexicon.compile_lexicon(words))
    assert [lex.rank(w) for w in sorted(words)] == list(range(len(words)))
    assert all(lex.lookup(w) == ids for w, ids in words.items())
    assert lex.lookup(b"sto") is None and lex.lookup(b"") is None and lex.lookup(b"topsy") is None
    assert len(lex.final) < sum(map(len, words)) - 8  # suffixes are shared
    assert lexicon.Lexicon(lexicon.compile_lexicon({})).lookup(b"a") is None


def text_order(row):
    """doc_id, nulls first, then the signed hash of the text."""
    import xxhash

    h = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
    return (row[0] is not None, row[0] or 0, h - (1 << 64) if h >> 63 else h)


def test_shards(spark, docs, odd):
    from tokenizers import Tokenizer

    path = vocab("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        encoder = sstable.Encoder(file.read())
    for t in ODD:
        assert encoder.encode(t) == own.encode(t, add_special_tokens=False).ids
    for df in (docs, odd):
        shards = sstable.write_shards(df, path)
        got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in sstable.read_back(shards).collect()))
        start = 0
        for at, _, n, _ in got:
            assert at == start
            start += n
        for (d, t), (_, doc, n, crc) in zip(sorted(plain(df), key=text_order), got, strict=True):
            ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
            assert (doc, n, crc) == (d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
    some = {d: t for d, t in plain(docs) if d in (3, 77)}
    found = sstable.lookup(sstable.write_shards(docs, path), [3, 77, 10**9])
    assert found == {d: [*own.encode(t, add_special_tokens=False).ids, 2] for d, t in some.items()}
    assert sstable.digest(odd.limit(0), path).count() == 0


def test_many_rows_of_one_id(spark):
    """Rows of one id, or without any, with one text: over several tasks and shards, each once."""
    from tokenizers import Tokenizer

    path, text = vocab("byte_bpe_50k.json"), "the same text again"
    n = len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids) + 1
    rows = spark.range(6000).select(F.when(F.col("id") % 6 == 0, F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    shards = sstable.write_shards(rows.repartition(8), path)
    assert shards.select("part").distinct().count() > 1
    found = sstable.read_back(shards).collect()
    assert sorted(r.start for r in found) == [n * i for i in range(6000)]
    assert sorted((r.doc_id for r in found), key=lambda d: -1 if d is None else d) == [None] * 5000 + list(range(0, 6000, 6))
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == [None] * 5000 + list(range(0, 6000, 6))


def test_shard_file():
    writer = sstable.Writer(2)
    ids = {d: [d % 50_000, 7] * (1 + d % 40) for d in range(-50, 4000, 3)}
    for d, x in ids.items():
        writer.add(d, x)
    data = writer.finish()
    shard = sstable.Shard(io.BytesIO(data))
    assert shard.n_blocks > 3 and {d: x.tolist() for d, x in shard} == ids
    assert all(shard.get(d).tolist() == x for d, x in ids.items())
    missing = [d for d in range(-50, 4000) if d not in ids]
    assert all(shard.get(d) is None for d in missing)
    assert sum(shard.may_hold(d) for d in missing) < 0.05 * len(missing)
    hurt = bytearray(data)
    hurt[40] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        sstable.Shard(io.BytesIO(hurt)).get(-50)
    with pytest.raises(ValueError):
        sstable.Shard(io.BytesIO(data[:-1]))


def test_word_scan():
    import numpy as np

    texts = ["Ab, cd\x00e", "", "ünï x", "ab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    raw = data.tobytes().lower()
    words = scan.Words(data, offsets, scan.PLAIN)
    assert [raw[a:b] for a, b in zip(words.starts, words.ends, strict=True)] == [w for t in texts for w in re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())]
    assert words.hash[0] == words.hash[-1] and len(set(words.hash.tolist())) == 5


def test_hashes_of_bytes():
    import random

    import numpy as np

    r = random.Random(1)
    words = [bytes(r.randrange(97, 100) for _ in range(r.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))) for _ in range(3000)]
    words += [w.encode() for w in CLASH] + [b"\x00", b"\x00\x00", b"ab", b"ab\x00"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    found = scan.hash_bytes(data, starts, ends)
    known = dict(zip(words, found.tolist(), strict=True))
    assert [known[w] for w in words] == found.tolist()
    assert len(set(found.tolist())) == len(set(words))
    moved = np.append(np.frombuffer(b"zzz", np.uint8), data)
    assert (scan.hash_bytes(moved, starts + 3, ends + 3) == found).all()
    a, b = np.array([r.randrange(len(words)) for _ in range(2000)]), np.array([r.randrange(len(words)) for _ in range(2000)])
    alike = (ends - starts)[a] == (ends - starts)[b]
    a, b = a[alike], b[alike]
    assert scan.same_bytes(data, starts[a], starts[b], (ends - starts)[a]).tolist() == [words[i] == words[j] for i, j in zip(a, b, strict=True)]


def test_word_digests():
    import numpy as np

    texts = ["a b", "A, b!", "ab", "a", "", "...", CLASH[0], CLASH[1], "a b c", "a bc"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw]))
    found = neardup.word_digests(data, scan.Words(data, offsets, scan.PLAIN), scan.PLAIN)
    assert found[0] == found[1] and found[4] == found[5] and len(set(found)) == len(texts) - 2


def test_anchors_by_hand():
    """A window's anchor depends on its words alone, and runs of windows with one anchor are complete."""
    import numpy as np

    text = (" ".join(f"t{i * i % 83}" for i in range(120)) + " x " * 40).encode()
    data = np.frombuffer(text + b" " + text, np.uint8)
    words = scan.Words(data, np.array([0, len(text), len(data)]), scan.SPACED)
    a = repeats.Anchors(words)
    n = len(text.split())
    covered = [(int(d), int(f) - int(words.first[d]) + k) for d, f, c in zip(a.doc, a.first, a.count, strict=True) for k in range(c)]
    assert sorted(covered) == [(d, i) for d in (0, 1) for i in range(n - repeats.WINDOW + 1)]
    assert all(0 <= at - f < repeats.SLIDE for at, f in zip(a.at, a.first, strict=True))
    half = len(a.at) // 2
    assert (a.at[:half] + n == a.at[half:]).all() and (a.key[:half] == a.key[half:]).all() and (a.nth[:half] == a.nth[half:]).all()
