"""Properties that hold whatever the data."""

import gzip
import io
import random
import struct
import tarfile
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry import model
from quarry.functions import codecs
from quarry.operators import audit, classify, heat, namespace, overlay, placement, seal, segments, stats


def rows(df):
    return sorted(map(tuple, df.collect()))


def store(spark, seed):
    r = random.Random(seed)
    base = [(k, float(k)) for k in range(1, 30) if r.random() < 0.6]
    log = [(r.randint(1, 40), s, r.choice("PPD"), float(s)) for s in range(200)]
    return base, log, spark.createDataFrame(base, "k long, v double"), spark.createDataFrame(log, "k long, seq long, op string, v double")


@pytest.mark.parametrize("seed", [1, 2])
def test_overlay_is_a_replay(spark, seed):
    base, log, b, d = store(spark, seed)
    for cut in (0, 77, 200):
        now = dict(base)
        for k, s, op, v in log:
            if s < cut:
                now.pop(k, None) if op == "D" else now.__setitem__(k, v)
        assert rows(overlay.at(b, d, cut)) == sorted(now.items())
    assert rows(overlay.fold(b, d).drop("origin")) == rows(overlay.live(b, d)) == sorted(now.items())
    folded = overlay.live(b, overlay.until(d, 100))
    assert rows(overlay.live(folded, d.where("seq >= 100"))) == sorted(now.items())
    assert overlay.get(b, d, 999).count() == 0


def test_empty_log_and_base(spark):
    _, _, b, d = store(spark, 3)
    assert rows(overlay.live(b, d.limit(0))) == rows(b)
    assert overlay.valid_prefix(d, d.seq < 0).count() == 200
    assert overlay.valid_prefix(d, d.seq == 50).count() == 50


def test_flipped_byte_merges_nothing(spark):
    shared = "x" * model.GRID + "y" * model.GRID
    two = spark.createDataFrame([(1, shared), (2, shared)], "ino long, content string")
    flip = spark.createDataFrame([(1, shared), (2, "".join("z" if i % model.GRID == 5 else c for i, c in enumerate(shared)))], "ino long, content string")
    assert segments.dedupe_stats(segments.cut(two)).first().cross_merged == 2
    assert segments.dedupe_stats(segments.cut(flip)).first().cross_merged == 0
    nothing = segments.dedupe_stats(segments.cut(two.limit(0))).first()
    assert (nothing.segments, nothing.logical, nothing.physical) == (0, 0, 0)


def test_islands_over_slices(spark):
    edge = 1 << 16
    blocks = [*range(3), 7, *range(edge - 2, 2 * edge + 3), 3 * edge]
    found = stats.islands(spark.createDataFrame([(b,) for b in blocks], "block long"))
    assert rows(found.select("start", "length")) == [(0, 3), (7, 1), (edge - 2, edge + 5), (3 * edge, 1)]


def test_planted_faults(spark):
    ext = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 4, 6), (2, 1, 0, 5), (3, 1, 0, 9), (4, 1, 0, 5), (5, 1, 0, 5)], "ino long, idx long, off long, len long")
    sizes = spark.createDataFrame([(1, 10), (2, 6), (3, 8), (4, 5), (6, 3)], "ino long, size long")
    assert rows(audit.tiling(ext, sizes)) == [(1, "OVERLAP"), (2, "COVERAGE"), (3, "BOUNDS"), (4, "ok"), (5, "SIZE"), (6, "SIZE")]
    a = spark.createDataFrame([(1, 0, 10), (2, 100, 300)], "l long, lo long, hi long")
    b = spark.createDataFrame([(7, 9, 120), (8, 300, 301)], "r long, lo long, hi long")
    assert rows(audit.overlaps(a, b, 16)) == [(1, 7, 9, 10), (2, 7, 100, 120)]
    import random

    r = random.Random(4)
    one = [(i, lo, lo + int(2 ** r.uniform(0, 22))) for i, lo in enumerate(r.sample(range(-(10**6), 10**6), 60))]
    two = [(i, lo, lo + int(2 ** r.uniform(0, 12)) - 1) for i, lo in enumerate(r.sample(range(-(10**6), 10**6), 60))]
    want = sorted((i, j, max(p, u), min(q, v)) for i, p, q in one for j, u, v in two if p < v and u < q and u < v)
    assert rows(audit.overlaps(spark.createDataFrame(one, "l long, lo long, hi long"), spark.createDataFrame(two, "r long, lo long, hi long"), 4)) == want


def test_namespace(spark):
    names = spark.createDataFrame([(1, "a", 2, "d", 0), (2, "b", 3, "d", 0), (3, "c", 4, "f", 5), (1, "c!jxl", 5, "f", 1), (1, "c", 6, "f", 1)], "parent long, name string, child long, type string, size long")
    walked = namespace.walk(names, 1, 4)
    assert {r.path for r in walked.collect()} == {"/a", "/a/b", "/a/b/c", "/c!jxl", "/c"}
    assert {(r.path, r.ino) for r in namespace.recursive_sql(spark, names, 1).collect()} == {(r.path, r.ino) for r in walked.collect()}
    links = spark.createDataFrame([(6, "/a/b/c")], "ino long, target string")
    assert namespace.resolve(names, links, spark.createDataFrame([("/c",)], "path string"), 1, 4).first().ino == 4
    assert rows(namespace.siblings(names, ["jxl"])) == [(1, "c!jxl", 5, 6)]
    assert rows(namespace.first_names(walked))[0] == (2, "/a")
    with pytest.raises(ValueError, match="deeper"):
        namespace.walk(names, 1, 2)
    with pytest.raises(Exception, match="no row for"):
        namespace.walk_strict(names, names.limit(1).selectExpr("child ino"), 1, 4).collect()


def test_prefix_sums(spark):
    files = spark.createDataFrame([(i, (i * 37) % 101 + 1) for i in range(500)], "ino long, size long")
    total = 0
    want = []
    for size, ino in sorted((s, i) for i, s in rows(files)):
        total += size
        want.append((ino, size, total))
    assert rows(heat.prefix_sums(files, "size", [F.col("size").asc(), F.col("ino").asc()])) == sorted(want)
    assert placement.batches(files.selectExpr("'x' family", "*"), 64).where("last_batch < first_batch").count() == 0


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_byte_functions(data):
    assert codecs.bcj_x86(codecs.bcj_x86(data), False) == data
    assert codecs._crc32c_many([data, b"", data[:7]]).tolist() == [codecs.crc32c_of(data), 0, codecs.crc32c_of(data[:7])]


def test_known_values():
    assert codecs.crc32c_of(b"123456789") == 0xE3069283
    c = zlib.compressobj(9, zlib.DEFLATED, -15, 8)
    raw = b"abcabcabd" * 50
    assert codecs.deflate_parameters(raw, c.compress(raw) + c.flush()) is not None
    assert codecs.deflate_parameters(raw, b"no") is None


@given(st.lists(st.binary(min_size=16, max_size=16), min_size=1, max_size=10), st.integers(1, 4), st.randoms())
@settings(max_examples=40, deadline=None)
def test_reed_solomon(data, m, rnd):
    parity = seal.rs_encode(data, m)
    lost = rnd.sample(range(len(data) + m), m)
    hurt = [None if i in lost else d for i, d in enumerate(data)]
    left = [None if i + len(data) in lost else p for i, p in enumerate(parity)]
    assert seal.rs_decode(hurt, left) == data


def test_parity_heals(spark):
    symbols = spark.createDataFrame([(g, i, g * 10 + i) for g in range(3) for i in range(4)], "grp long, idx int, value long")
    hurt = symbols.selectExpr("grp", "idx", "if(grp = 1 and idx = 2, null, value) value")
    assert rows(seal.heal(hurt, seal.parity(symbols))) == rows(symbols)


def test_members(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        info = tarfile.TarInfo("b")
        info.size = 2
        f.addfile(info, io.BytesIO(b"hi"))
    body = [(1, z.getvalue()), (2, t.getvalue()), (3, gzip.compress(b"zz")), (4, b"PK\x03\x04broken"), (5, None)]
    found = codecs.members(spark.createDataFrame(body, "ino long, body binary"))
    assert [(r.ino, r.name, bytes(r.body)) for r in found.orderBy("ino").collect()] == [(1, "a.txt", b"hello"), (2, "b", b"hi"), (3, "data", b"zz")]


def test_classes(spark):
    elf = b"\x7fELF" + bytes(14) + struct.pack("<H", 62) + bytes(5000)
    pe = bytearray(b"MZ" + bytes(5000))
    struct.pack_into("<I", pe, 60, 128)
    pe[128:132] = b"PE\0\0"
    one = spark.createDataFrame([(1, elf), (2, bytes(pe)), (3, elf[:100]), (4, b"\xca\xfe\xba\xbe" + bytes(5000))], "i int, b binary")
    assert rows(one.select("i", classify.binary_family(F.col("b")))) == [(1, 20), (2, 24), (3, 0), (4, 25)]
    sizes = spark.createDataFrame([("12",), ("3K",), ("1m",), ("x",)], "s string")
    assert [r[0] for r in sizes.select(classify.parse_size(F.col("s"))).collect()] == [12, 3072, 1 << 20, None]
    paths = spark.createDataFrame([("/a/./b/../c//",), ("../x",), ("",)], "p string")
    assert [r[0] for r in paths.select(namespace.normal_path(F.col("p"))).collect()] == ["/a/c", "/x", "/"]
    acl = spark.sql("select array(struct('user' tag, 5 id, 6 perm), struct('mask' tag, 0 id, 4 perm), struct('other' tag, 0 id, 0 perm)) a")
    assert acl.select(classify.acl_permitted(F.col("a"), 5, [], "r"), classify.acl_permitted(F.col("a"), 5, [], "w"), classify.acl_permitted(F.col("a"), 9, [], "r")).first() == (True, False, False)
