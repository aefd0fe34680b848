"""Small operators without a catalogue query."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import codecs, formats, packs
from quarry.operators import classify, mutate, placement, segments


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_entries(spark):
    entries = spark.createDataFrame([(1, 1, 0, 5, None), (1, 2, 5, 5, "a"), (2, 1, 0, 3, None)], "ino long, idx long, off long, len long, child_addr string")
    recipes = spark.createDataFrame([("a", 1, 5, 2), ("a", 2, 7, 3)], "addr string, idx long, off long, len long")
    assert rows(segments.children(entries, recipes)) == [(1, 1, 0, 5), (1, 200_001, 5, 2), (1, 200_002, 7, 3), (2, 1, 0, 3)]
    batches = spark.createDataFrame([(7, "abcdefgh")], "batch long, body string")
    assert rows(segments.slices(spark.createDataFrame([(1, 7, 2, 3)], "ino long, batch long, at int, len int"), batches)) == [(1, "cde")]
    kinds = spark.createDataFrame([(1, 0, 2), (1, 1, 2), (2, 0, 24), (3, 0, 2)], "ino long, zone int, algo int")
    assert rows(classify.repackable(kinds)) == [(3,)]


def test_choices(spark):
    files = spark.createDataFrame([(1, "f", 2, None, None, "a"), (2, "d", 2, None, None, "b"), (3, "f", 0, None, None, "c"), (4, "f", 1, 3, 5, "d"), (5, "f", 1, 3, 2, "e"), (6, "f", 1, None, None, "\x01x")], "ino long, type string, segments int, cls int, gen int, name string")
    assert [r.ino for r in classify.sweepable(files, 5).orderBy("ino").collect()] == [1, 5]
    assert rows(placement.admitted(spark.createDataFrame([(1, 8192), (2, 8193)], "ino long, worst long"), 2)) == [(1, 8192, "go"), (2, 8193, "no-space")]
    marks = spark.createDataFrame([(1, 5), (1, 9), (2, 3), (3, 4)], "ino long, ts long")
    done = spark.createDataFrame([(1, 7), (2, 3)], "ino long, ts long")
    assert rows(placement.pending(marks, done, 10)) == [(1, 5), (3, 4)]
    assert rows(placement.pending(marks, done, 1)) == [(3, 4)]
    flags = spark.createDataFrame([(1, True, 5), (2, True, 6), (3, False, 7), (4, True, 8)], "ino long, flag boolean, size long")
    assert [(r.ino, r.island, r.batch) for r in placement.binary_batches(flags, 8).orderBy("ino").collect()] == [(1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 3, 0)]


def test_sessions(spark):
    content = spark.createDataFrame([(1, "hello world"), (2, "x"), (3, None)], "ino long, content string")
    writes = spark.createDataFrame([(1, 2, 6, "there"), (1, 1, 0, "J"), (2, 1, 3, "yy"), (3, 1, 0, "new")], "ino long, seq int, off int, data string")
    assert rows(mutate.written(content, writes)) == [(1, "Jello there"), (2, "x\0\0yy"), (3, "new")]
    assert rows(mutate.truncated(content, spark.createDataFrame([(1, 4), (2, 3)], "ino long, size int"))) == [(1, "hell"), (2, "x\0\0")]
    assert rows(mutate.touched_segments(writes, 4)) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0)]
    names = spark.createDataFrame([(1, "a", 5), (1, "b", 6)], "parent long, name string, child long")
    moves = spark.createDataFrame([(1, "a", 2, "c")], "parent long, name string, to_parent long, to_name string")
    assert rows(mutate.renamed(names, moves)) == [(1, "a", "D", 5), (2, "c", "P", 5)]
    assert rows(mutate.created(9, names.select("name", "child"))) == [(9, "a", "P", 5), (9, "b", "P", 6)]


def test_packs():
    text = "# comment\nname = demo\nalgo = 0x28\nnonsense\nodd = 1\nsniff.offset = 3\nsniff.magic = 504Bzz\nsniff.magic = 7F45\nsniff.offset = 010\nsniff.ext = zip,jar\ncaps = seek|external, other\ntype = container\nenumerate = bin/list {in}\nblob_ext = ../x\nraw_ext = .raw\nsibling_tags = mbr#, map"
    found = codecs.parse_manifest(text)
    assert (found["name"], found["algo"], found["type"], found["caps"]) == ("demo", 40, "container", ["seek", "external"])
    assert found["magics"] == [(b"PK", 3), (b"\x7fE", 8)] and found["exts"] == ["zip", "jar"]
    assert found["commands"] == {"enumerate": "bin/list {in}"} and "blob_ext" not in found and found["raw_ext"] == ".raw" and found["tags"] == ["mbr", "map"]
    assert codecs.parse_manifest("")["algo"] == -1
    r = codecs.registry()
    assert r.by_algo(2) == "zlib" and r.generation() == 1
    with pytest.raises(ValueError, match="taken"):
        r.register("other", 2, bytes, bytes)
    r.packs_allowed = False
    with pytest.raises(ValueError, match="off"):
        r.register("pack", 77, bytes, bytes)
    assert packs.arguments("tool {in} -o {out} {dir}/x{idx}", **{"in": "/a b", "out": "/o", "idx": "3"}) == ["tool", "/a b", "-o", "/o", "/x3"]
    assert packs.arguments("bin/tool", pack="/p") == ["/p/bin/tool"]
    assert packs.run("/bin/cp {in} {out}", b"abc") == b"abc"
    assert packs.run("/bin/false", b"abc") is None and packs.run("/bin/nothing-there", b"x") is None
    assert packs.run("/bin/sleep 5", b"x", seconds=1) is None
    assert packs.run("/bin/cp {in} {out}", b"abc", allowed=False) is None


def test_deflate_grid():
    import random

    r = random.Random(2)
    raw = b" ".join(r.choice([b"alpha", b"beta", b"gamma", b"%d" % r.randrange(99)]) for _ in range(400))
    for level, memory, strategy, window in ((6, 8, 0, -15), (3, 7, 0, -15), (1, 1, 0, -15), (5, 8, zlib.Z_HUFFMAN_ONLY, -15), (6, 9, zlib.Z_RLE, -15), (7, 8, zlib.Z_FIXED, -15), (9, 7, 0, -12)):
        c = zlib.compressobj(level, zlib.DEFLATED, window, memory, strategy)
        stream = c.compress(raw) + c.flush()
        found = codecs.deflate_parameters(raw, stream, window if window == -12 else 0)
        assert found and codecs.deflate_again(raw, found) == stream
    assert codecs.deflate_parameters(b"", codecs.deflate_again(b"", {"level": 9, "memory": 8, "strategy": 0, "window": -15})) == {"level": 6, "memory": 8, "strategy": 0, "window": -15}


def test_recipes():
    entries = [formats.Entry(0, 10, 1, 24, 3, 5, 77), formats.Entry(10, 2, 0, 0, 4, 0, 1 << 40)]
    plain = formats.recipe_blob(formats.Recipe(12, entries))
    assert formats.recipe_of(plain).entries == entries and formats.recipe_of(plain).version == 1
    assert formats.recipe_of(formats.recipe_blob(formats.Recipe(1 << 33, entries))).version == 2
    wide = formats.recipe_blob(formats.Recipe(12, [formats.Entry(0, 1, 63, 1023, (1 << 32) - 1, 9, 5)]), wide=True)
    assert formats.recipe_of(wide).entries[0].slot == (1 << 32) - 1
    windows = formats.Recipe(12, entries, windows=[(1, 2, 1, 3, 6, 8, 0, -12)])
    assert formats.recipe_of(formats.recipe_blob(windows)).windows == windows.windows
    children = formats.Recipe(12, entries, children=[b"a" * 32, b"b" * 32])
    assert formats.recipe_of(formats.recipe_blob(children)).children == children.children
    hurt = bytearray(wide)
    hurt[30] ^= 1
    for bad in (b"", plain[:-1], plain + b"x", plain + b"WINW" + bytes(4), bytes(hurt), b"\x09" + plain[1:]):
        with pytest.raises(ValueError):
            formats.recipe_of(bad)
    with pytest.raises(ValueError):
        formats.recipe_blob(formats.Recipe(12, entries, windows=[(1, 2, 1, 3, 6, 8, 0, -12)], children=[b"a" * 32]))


def test_headers():
    import gzip
    import io
    import tarfile

    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, body in (("a", b"x" * 700), ("b", b""), ("c", b"yy")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    tar = out.getvalue()
    odd = bytearray(tar)
    odd[512 + 700] = 7  # bytes in the padding, and behind the end
    for whole in (tar, bytes(odd) + b"tail", b"", b"no tar at all" * 100):
        recipe, bodies = formats.tar_recipe(whole)
        assert formats.tar_rebuilt(recipe, bodies) == whole
    recipe, bodies = formats.tar_recipe(tar)
    assert bodies == [b"x" * 700, b"", b"yy"]
    with pytest.raises(ValueError):
        formats.tar_rebuilt(recipe, [b"x" * 699, b"", b"yyy"])
    with pytest.raises(ValueError):
        formats.tar_rebuilt(recipe, bodies[:2])
    named = io.BytesIO()
    with gzip.GzipFile("name.txt", "wb", 6, named, 5) as z:
        z.write(b"hello" * 50)
    data = named.getvalue()
    assert formats.gzip_header(data) == 10 + 9
    assert formats.gzip_rebuilt(*formats.gzip_recipe(data)) == data
    assert formats.gzip_header(data[:17]) is None and formats.gzip_recipe(data[:-1]) is None and formats.gzip_recipe(b"x" * 40) is None
    assert formats.flac_blocks(b"fLaC" + bytes([4, 0, 0, 2]) + b"ab" + bytes([0x81, 0, 0, 1]) + b"c") == [(4, 8, 2), (1, 14, 1)]
    assert formats.flac_blocks(b"fLaC" + bytes([4, 0, 0, 9])) is None and formats.flac_blocks(b"RIFF") is None
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"0" * 13) + chunk(b"IDAT", b"zz") + chunk(b"IEND", b"")
    assert [(k, n, ok) for k, _, n, ok in formats.png_chunks(png + b"more")] == [(b"IHDR", 13, True), (b"IDAT", 2, True), (b"IEND", 0, True)]
    assert formats.png_chunks(png[:-1]) is None


def test_pictures_in_programs():
    from quarry.plans.formats import _picture

    one = _picture(20_000)
    body = b"MZ\xff\xd8\xff\x00" + one + b"mid" + _picture(5) + one
    assert formats.carved(body) == [(6, len(one)), (len(body) - len(one), len(one))]
    assert formats.jpeg_end(one[:-1], 0) == 0
    assert formats.spliced(b"abef", [(2, b"cd"), (6, b"gh")]) == b"abcdefgh"


def test_repack_plan(spark, sf):
    """The plan by hand: what zlib makes of each chunk, in whole blocks."""
    from quarry.plans import catalogue
    from quarry.plans.formats import _repack

    rows = _repack(spark, sf, "zlib", 65_536).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    import re

    for r in rows:
        head = {0: b"\x1f\x8b", 1: b"\x7fELF"}.get(r.ino % 7, b"")
        text = re.sub(r"[^\x00-\x7F]", "x", docs[r.ino])
        body = head + text[:300].ljust(300, ".").encode() + text.encode()
        then = sum(-(-(8 + len(zlib.compress(body[i : i + 65_536], 6))) // 4096) * 4096 for i in range(0, len(body), 65_536))
        assert (r.size, r.now, r.then) == (len(body), -(-(len(body) + 8) // 4096) * 4096, then)
    found = {r.family: r for r in catalogue.queries()["repack_plan"](spark, sf).collect()}
    assert sum(r.files for r in found.values()) == len(docs) and sum(r.saving for r in found.values()) == sum(r.now - r.then for r in rows)


def test_order(spark):
    from quarry.operators import order

    data = [(i, f"g{i % 3}", (i * 7) % 50, "ab"[(i * 7) % 50 // 13 % 2]) for i in range(200)]
    df = spark.createDataFrame(data, "id long, g string, n long, flag string")
    got = {r.id: r.total for r in order.sums_within(df, "g", "n", [F.col("n").asc(), F.col("id").asc()]).collect()}
    run = {}
    for i, g, n, _ in sorted(data, key=lambda x: (x[1], x[2], x[0])):
        run[g] = run.get(g, 0) + n
        assert got[i] == run[g]
    got = {r.id: r.run for r in order.runs(df, "flag", ["n", "id"]).collect()}
    count, before = 0, None
    for i, _, _, flag in sorted(data, key=lambda x: (x[2], x[0])):
        count += flag != before
        before = flag
        assert got[i] == count


def test_sweep_works_on_tables(spark):
    from quarry.streaming import sweep

    marks = spark.createDataFrame([(1, 5), (2, 3), (3, 9)], "ino long, ts long")
    live = spark.createDataFrame([(k,) for k in range(6)], "ino long")
    state = {"done": []}

    def tables():
        return marks, spark.createDataFrame(state["done"], "ino long, ts long"), live

    seen = []

    def work(kind, files):
        own = sorted(r.ino for r in files.collect())
        seen.append((kind, own))
        state["done"] += [(i, 100) for i in own]

    tick = sweep.Tick
    out = sweep.run([tick(pending=3), tick(pending=1), tick(signal=True), tick(pending=0)], tables, work, 2)
    assert out == ["drain", "drain", "manual", ""]
    assert seen == [("drain", [1, 2]), ("drain", [3]), ("manual", list(range(6)))]


def test_stream_without_anything_new(spark, tmp_path):
    from quarry.streaming import log

    schema = "k long, seq long, op string, v double"
    (tmp_path / "in").mkdir()
    args = (str(tmp_path / "out"), str(tmp_path / "check"))
    log.ingest(log.read_log(spark, str(tmp_path / "in"), schema), *args)
    assert log.snapshot(spark, args[0]).count() == 0
    spark.createDataFrame([(1, 1, "P", 1.0), (1, 2, "P", 2.0), (2, 3, "P", 3.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log.ingest(log.read_log(spark, str(tmp_path / "in"), schema), *args)
    log.ingest(log.read_log(spark, str(tmp_path / "in"), schema), *args)
    spark.createDataFrame([(1, 9, "D", 0.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log.ingest(log.read_log(spark, str(tmp_path / "in"), schema), *args)
    want = [(1, 9, "D", 0.0), (2, 3, "P", 3.0)]
    assert rows(log.snapshot(spark, args[0])) == want and rows(log.compact(spark, args[0], str(tmp_path / "one"))) == want
