"""Queries over byte formats and containers. Containers and programs are made from the test tables inside each query, so
the SQL can say what must come out."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import codecs, formats, packs
from quarry.model import dirents, table
from quarry.operators import classify, namespace, segments
from quarry.plans.catalogue import _DIR, _EXT, _SEG, _extents, _segments, query
from quarry.sources import files as sources
from quarry.sources.scratch import folder

_DOCS = "d as (select doc_id, text, cast(octet_length(encode(text)) as bigint) size from documents where text is not null)"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", "text", F.octet_length("text").cast("long").alias("size"))


# --- classes by bytes ---------------------------------------------------------------------------------------------
def _program(kind: int) -> bytes:
    """Test programs by number: ELF of four machines, PE, an MZ without PE, six Mach-O magics, a small ELF, none."""
    elf = [62, 3, 183, 40]
    if kind < 4:
        head = b"\x7fELF" + bytes(14) + struct.pack("<H", elf[kind])
    elif kind in (4, 5):
        head = bytearray(b"MZ" + bytes(198))
        struct.pack_into("<I", head, 60, 128 if kind == 4 else 16)
        head[128:132] = head[16:20] = b"PE\0\0"
    elif kind < 12:
        head = bytes.fromhex(("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "BEBAFECA")[kind - 6])
    elif kind == 12:
        return b"\x7fELF" + bytes(100)
    else:
        head = b"plain"
    return bytes(head).ljust(5000, b"\0")


@query("select doc_id ino, case when doc_id % 14 = 0 then 20 when doc_id % 14 = 1 then 21 when doc_id % 14 = 2 then 22 when doc_id % 14 = 3 then 23 when doc_id % 14 = 4 then 24 when doc_id % 14 between 6 and 11 then 25 else 0 end family from documents")
def binary_families(spark, sf):
    bodies = F.array(*[F.lit(_program(k)) for k in range(14)])
    body = F.get(bodies, (F.col("doc_id") % 14).cast("int"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ino"), classify.binary_family(body).alias("family"))


_MAGIC_BODIES = ("504B0304AA", "1F8B08", "89504E470D0A1A0A00", "664C6143", "FFD8FFE0", "FFFB90", "FF0A", "0000000C4A584C20", "4D414320", "7776706B", "494433", "4D5A90", "504B0506")


@query("""with r(kind, codec) as (values (0, 'zip'), (1, 'gz'), (2, 'png'), (3, 'flac'), (4, 'jxl'), (5, 'mp3'), (6, 'jxl'), (7, 'jxl'), (8, 'ape'), (9, 'wavpack'), (10, 'mp3'))
select doc_id ino, case when codec is not null then 100 when doc_id % 5 = 0 then 50 end score, coalesce(codec, case when doc_id % 5 = 0 then 'text' end) codec from documents left join r on kind = doc_id % 13""")
def sniff_scores(spark, sf):
    body = F.unhex(F.get(F.array(*map(F.lit, _MAGIC_BODIES)), (F.col("doc_id") % 13).cast("int")))
    name = F.concat(F.lit("f."), F.when(F.col("doc_id") % 5 == 0, "java").otherwise("bin"))
    best = table(spark, sf, "documents").select(F.col("doc_id").alias("ino"), classify.sniff(name, body).alias("best"))
    return best.select("ino", "best.score", "best.codec")


@query("select doc_id ino, case when doc_id % 3 = 0 then 100 when doc_id % 4 = 0 then 50 else 0 end score from documents")
def pack_scores(spark, sf):
    manifest = codecs.parse_manifest("name = demo\nalgo = 40\nsniff.offset = 2\nsniff.magic = 4142\nsniff.ext = wad,PK3")
    i = F.col("doc_id")
    body = F.when(i % 3 == 0, F.unhex(F.lit("00004142"))).otherwise(F.unhex(F.lit("41420000")))
    name = F.concat(F.lit("game."), F.when(i % 4 == 0, "pk3").otherwise("txt"))
    score = classify.pack_score(name, body, [(m.hex().upper(), o) for m, o in manifest["magics"]], manifest["exts"])
    return table(spark, sf, "documents").select(i.alias("ino"), score.alias("score"))


@query("select * from (values ('fast', 6, 'zstd'), ('balanced', 19, 'zstd'), ('dense', 19, 'zstd'), ('archive', 19, 'zstd'), ('faster', 3, 'zstd'), ('fastest', 19, 'lz4'), ('turbo', 1, 'none'), ('other', null, null)) v(profile, level, codec)")
def profile_ladder(spark, sf):
    names = spark.createDataFrame([(p,) for p in [*classify.PROFILES, "other"]], "profile string")
    return names.select("profile", classify.profile_level(F.col("profile")).alias("level"), classify.profile_codec(F.col("profile")).alias("codec"))


@query("select * from (values ('12', 12::bigint), ('3K', 3072), ('3 kb ', 3072), ('1m', 1048576), ('2G', 2147483648), ('4b', 4), ('x', null), ('5T', null), ('', null), ('99999999999G', null)) v(given, size)")
def size_options(spark, sf):
    given = spark.createDataFrame([(s,) for s in ("12", "3K", "3 kb ", "1m", "2G", "4b", "x", "5T", "", "99999999999G")], "given string")
    return given.select("given", classify.parse_size(F.col("given")).alias("size"))


@query("select n_name given, case when n_nationkey % 3 = 0 then 'dir' || n_regionkey else '' end parent, case when n_nationkey % 3 = 2 then null else n_name end leaf from nation")
def split_paths(spark, sf):
    i, name = F.col("n_nationkey"), F.col("n_name")
    path = F.when(i % 3 == 0, F.concat(F.lit("//dir"), F.col("n_regionkey"), F.lit("//"), name, F.lit("/"))).when(i % 3 == 1, name).otherwise("///")
    parts = namespace.split_path(path)
    return table(spark, sf, "nation").select(name.alias("given"), F.coalesce(parts["parent"], F.lit("")).alias("parent"), parts["leaf"].alias("leaf"))


@query("select cast(p_partkey as bigint) part, cast(ceil((p_size * 1000 + 8) / 4096) as bigint) blocks, case when p_size between 0 and 15 then cast(65536 * (1::bigint << p_size) as bigint) end meta from part")
def extent_sizes(spark, sf):
    size = F.col("p_size").cast("long")
    return table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("part"), formats.blocks_of(size * 1000).alias("blocks"), formats.meta_extent(size).alias("meta"))


# --- keys, mixers, recipes ----------------------------------------------------------------------------------------
@query(f"with {_DIR} select parent, name, hex(encode(name)) raw, printf('%016X', parent) ino_key, printf('%016X', parent) || printf('%04X', octet_length(encode(name))) || hex(encode(name)) dirent_key, '03' || printf('%016X', child) || printf('%04X', octet_length(encode(name))) || hex(encode(name)) xattr_key, '04' || upper(sha256(name)) recipe_key, row_number() over (order by parent, octet_length(encode(name)), name) place from dirent where type = 'd'")
def row_keys(spark, sf):
    """Keys, and the order of their bytes: by parent, then length of the name, then name."""
    rows = dirents(spark, sf).where("type = 'd'")
    keys = rows.select("parent", "name", F.hex(F.col("name").cast("binary")).alias("raw"), formats.inode_key(F.col("parent")).alias("a"), formats.dirent_key(F.col("parent"), F.col("name")).alias("b"), formats.xattr_key(F.col("child"), F.col("name")).alias("c"), formats.recipe_key(F.unhex(F.sha2(F.col("name").cast("binary"), 256))).alias("d"))
    # directories only: their number is that of regions, nations and customers
    from quarry.operators.order import prefix_sums

    placed = prefix_sums(keys.withColumn("one", F.lit(1).cast("long")), "one", [F.col("b").asc()])
    return placed.select("parent", "name", "raw", F.hex("a").alias("ino_key"), F.hex("b").alias("dirent_key"), F.hex("c").alias("xattr_key"), F.hex("d").alias("recipe_key"), F.col("total").alias("place"))


@query(f"with {_DIR} select parent, name from dirent")
def key_roundtrip(spark, sf):
    keys = dirents(spark, sf).select(formats.key_parts(formats.dirent_key(F.col("parent"), F.col("name"))).alias("p"))
    return keys.select("p.parent", "p.name")


_MUL = "cast((({x})::uhugeint * {f}::uhugeint) % 18446744073709551616::uhugeint as ubigint)"


def _mix_sql(c: tuple[int, int, int, int, int]) -> tuple[str, str]:
    one = _MUL.format(x=f"xor(x, x >> {c[0]})", f=c[1])
    two = _MUL.format(x=f"xor(y, y >> {c[2]})", f=c[3])
    return one, two


_S1, _S2 = _mix_sql(formats.SPLITMIX)
_M1, _M2 = _mix_sql(formats.MURMUR)


@query(f"with k as (select o_orderkey, cast(o_orderkey * 7919 as ubigint) x from orders), a as (select *, {_S1} y, {_M1} m from k), b as (select o_orderkey, {_S2} s, {_M2.replace('y', 'm')} t from a) select cast(o_orderkey as bigint) k, printf('%016X', xor(s, s >> 31)) splitmix, printf('%016X', xor(t, t >> 33)) murmur from b")
def hash_mixers(spark, sf):
    x = F.col("o_orderkey").cast("long") * 7919
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k"), hexed(formats.mixer(formats.SPLITMIX)(x)).alias("splitmix"), hexed(formats.mixer(formats.MURMUR)(x)).alias("murmur"))


def _recipe_entries(spark: SparkSession, sf: str) -> DataFrame:
    number = F.when(F.col("zone") == "O", 1).otherwise(0).cast("long")
    algo = F.when(F.col("algo") == "A", 1).otherwise(2).cast("long")
    return _extents(spark, sf).select("ino", "idx", "off", F.col("len").alias("length"), number.alias("zone"), algo.alias("algo"), F.col("idx").alias("slot"), F.lit(0).cast("long").alias("batch_off"), F.col("block").cast("long").alias("pba"))


_ENTRIES = f"{_EXT}, e as (select ino, idx, off, len length, case when zone = 'O' then 1 else 0 end zone, case when algo = 'A' then 1 else 2 end algo, idx slot, 0 batch_off, cast(block as bigint) pba from ext)"


@query(f"with {_ENTRIES} select * from e")
def recipe_roundtrip(spark, sf):
    return formats.recipe_entries(formats.recipe_blobs(_recipe_entries(spark, sf)))


@query(f"with {_ENTRIES} select ino, cast(16 + 32 * count(*) as bigint) narrow, cast(24 + 40 * count(*) as bigint) wide, true same from e group by ino")
def recipe_sizes(spark, sf):
    entries = _recipe_entries(spark, sf)
    wide = formats.recipe_blobs(entries, wide=True)
    again = formats.recipe_blobs(formats.recipe_entries(wide)).select("ino", F.col("blob").alias("again"))
    both = formats.recipe_blobs(entries).join(wide.select("ino", F.col("blob").alias("wide")), "ino").join(again, "ino")
    return both.select("ino", F.length("blob").cast("long").alias("narrow"), F.length("wide").cast("long").alias("wide"), (F.col("blob") == F.col("again")).alias("same"))


# --- reads through batches and children ---------------------------------------------------------------------------
@query("select doc_id * 2 ino, substring(text, 6, 100) content from documents where text is not null")
def batch_slices(spark, sf):
    batches = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("batch"), F.col("text").alias("body"))
    entries = batches.select((F.col("batch") * 2).alias("ino"), "batch", F.lit(5).alias("at"), F.lit(100).alias("len"))
    return segments.slices(entries, batches)


@query(f"with {_EXT}, c as (select cast(p_partkey as bigint) addr, i idx, cast((i - 1) * 10 as bigint) off, cast(10 as bigint) len from part, unnest([1, 2]) u(i) where p_partkey % 5 = 0) select ino, idx, off, len from ext where block % 5 <> 0 union all select ino, ext.idx * 100000 + c.idx, c.off, c.len from ext join c on addr = block where block % 5 = 0")
def child_recipes(spark, sf):
    entries = _extents(spark, sf).withColumn("child_addr", F.when(F.col("block") % 5 == 0, F.col("block").cast("long")))
    parts = table(spark, sf, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").cast("long").alias("addr"), F.explode(F.array(F.lit(1), F.lit(2))).alias("idx"))
    recipes = parts.select("addr", F.col("idx").cast("long").alias("idx"), ((F.col("idx") - 1) * 10).cast("long").alias("off"), F.lit(10).cast("long").alias("len"))
    return segments.children(entries, recipes)


# --- containers ---------------------------------------------------------------------------------------------------
#: Files that a test container holds.
_HELD = 10


def _containers(spark: SparkSession, sf: str) -> DataFrame:
    """(ino, body): zip files of ten documents each, tar files of the next ten, and gzip files of one."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        ino, out = int(rows.ino.iloc[0]), io.BytesIO()
        if ino % 3 == 0:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for d, t in zip(rows.doc_id, rows.text, strict=True):
                    z.writestr(f"d{d}.txt", t)
        elif ino % 3 == 1:
            with tarfile.open(fileobj=out, mode="w") as z:
                for d, t in zip(rows.doc_id, rows.text, strict=True):
                    info = tarfile.TarInfo(f"d{d}.txt")
                    info.size = len(t.encode())
                    z.addfile(info, io.BytesIO(t.encode()))
        else:
            out.write(gzip.compress(rows.text.iloc[0].encode(), mtime=0))
        return pd.DataFrame({"ino": [ino], "body": [out.getvalue()]})

    docs = table(spark, sf, "documents").where("text is not null").select(F.expr(f"doc_id div {_HELD}").alias("ino"), "doc_id", "text")
    return docs.groupBy("ino").applyInPandas(pack, "ino long, body binary")


_MEMBERS = f"m as (select doc_id // {_HELD} ino, row_number() over (partition by doc_id // {_HELD} order by doc_id) - 1 idx, 'd' || doc_id || '.txt' name, cast(octet_length(encode(text)) as bigint) usize, text from documents where text is not null), h as (select ino, idx, case when ino % 3 = 2 then 'data' else name end name, usize, text from m where ino % 3 < 2 or idx = 0)"


@query(f"with {_MEMBERS} select ino, idx, name, usize, sha256(text) content from h")
def container_members(spark, sf):
    found = codecs.members(_containers(spark, sf))
    return found.select("ino", "idx", "name", "usize", F.sha2("body", 256).alias("content"))


@query(f"with {_MEMBERS} select ino, name, sha256(text) content from h where ino % 3 < 2 and idx = 3")
def archive_entries(spark, sf):
    wanted = table(spark, sf, "documents").select(F.expr(f"doc_id div {_HELD}").alias("ino"), F.concat(F.lit("d"), F.col("doc_id"), F.lit(".txt")).alias("name"), "doc_id").where(f"doc_id % {_HELD} = 3").drop("doc_id")
    missing = wanted.select("ino", F.concat("name", F.lit(".gone")).alias("name"))
    found = codecs.entries(_containers(spark, sf), wanted.unionByName(missing))
    return found.select("ino", "name", F.sha2("body", 256).alias("content"))


@query(f"with {_MEMBERS} select ino, count(*) members, true same from h where ino % 3 = 1 group by ino")
def tar_rebuild(spark, sf):
    """Tars taken apart and put together again, bit for bit."""

    def work(frames):
        for frame in frames:
            rows = []
            for ino, body in zip(frame.ino, frame.body, strict=True):
                recipe, bodies = formats.tar_recipe(bytes(body))
                rows.append((ino, len(bodies), formats.tar_rebuilt(recipe, bodies) == bytes(body)))
            yield pd.DataFrame(rows, columns=["ino", "members", "same"])

    return _containers(spark, sf).where("ino % 3 = 1").mapInPandas(work, "ino long, members long, same boolean")


@query(f"with {_MEMBERS} select ino, idx, name, usize size, true valid from h where ino % 3 = 1")
def tar_headers(spark, sf):
    """Names, sizes and checksums straight from the 512-byte headers."""

    def work(frames):
        for frame in frames:
            rows = [(ino, i, header[:100].rstrip(b"\0").decode(), formats.tar_size(header), formats.tar_valid(header)) for ino, body in zip(frame.ino, frame.body, strict=True) for i, (header, _, _) in enumerate(formats.tar_parts(bytes(body))[0])]
            yield pd.DataFrame(rows, columns=["ino", "idx", "name", "size", "valid"])

    return _containers(spark, sf).where("ino % 3 = 1").mapInPandas(work, "ino long, idx long, name string, size long, valid boolean")


@query(f"with {_MEMBERS} select ino, 10::bigint header, usize size, true same from h where ino % 3 = 2")
def gzip_rebuild(spark, sf):
    """Gzip files as header, content and deflate parameters, and made again bit for bit."""

    def work(frames):
        for frame in frames:
            rows = []
            for ino, body in zip(frame.ino, frame.body, strict=True):
                found = formats.gzip_recipe(bytes(body))
                rows.append((ino, len(found[0]), len(found[1]), formats.gzip_rebuilt(*found) == bytes(body)) if found else (ino, -1, -1, False))
            yield pd.DataFrame(rows, columns=["ino", "header", "size", "same"])

    return _containers(spark, sf).where("ino % 3 = 2").mapInPandas(work, "ino long, header long, size long, same boolean")


@query(f"with {_MEMBERS} select ino, count(*) members, cast(sum(usize) as bigint) original, 'accept' verdict from h where ino % 3 < 2 group by ino having count(*) > 0 union all select ino, 0, 0, 'decline' from (select distinct ino from m) where ino % 3 = 2")
def container_decomposition(spark, sf):
    """Containers taken apart if all of their members come out whole; the others stay as they are."""
    bodies = _containers(spark, sf)
    sizes = codecs.members(bodies.where("ino % 3 < 2")).groupBy("ino").agg(F.count("*").alias("members"), F.sum("usize").alias("original"), F.bool_and(F.length("body") == F.col("usize")).alias("whole"))
    rows = bodies.select("ino").join(sizes, "ino", "left")
    good = F.coalesce(F.col("whole"), F.lit(False))
    return rows.select("ino", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("original", F.lit(0)).alias("original"), F.when(good, "accept").otherwise("decline").alias("verdict"))


def _picture(n: int) -> bytes:
    """A JPEG stream of n coded bytes, with a thumbnail inside a segment."""
    thumb = b"\xff\xd8\xff\xd9"
    segment = lambda mark, body: bytes((0xFF, mark)) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xE1, thumb) + segment(0xC0, bytes(6)) + segment(0xDA, bytes(6)) + b"\x11" * n + b"\xff\x00\xff\xd0" + b"\xff\xd9"


_PICTURE = len(_picture(0))


@query(f"select cast(p_partkey as bigint) ino, i idx, cast(100 + p_size + i * ({_PICTURE} + 20000 + p_size) as bigint) off, cast({_PICTURE} + 20000 as bigint) size, true whole from part, unnest(range(0, 2)) u(i)")
def media_carve(spark, sf):
    def body(frames):
        for frame in frames:
            made = [b"MZ".ljust(100 + s, b"\0") + _picture(20_000) + bytes(s) + _picture(20_000) + _picture(9) + b"tail" for s in frame["size"]]
            yield pd.DataFrame({"ino": frame.ino, "body": made})

    programs = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("ino"), F.col("p_size").alias("size"))
    return formats.carves(programs.mapInPandas(body, "ino long, body binary"))


# --- codecs and packs ---------------------------------------------------------------------------------------------
@query(f"with {_DOCS}, c(level) as (values (1), (4), (6), (9)) select doc_id ino, size, true found from d")
def deflate_search(spark, sf):
    """Streams of several levels; what is found makes each again, so its size and a level are known."""

    def pack(frames):
        for frame in frames:
            out = []
            for d, t in zip(frame.doc_id, frame.text, strict=True):
                c = zlib.compressobj((1, 4, 6, 9)[d % 4], zlib.DEFLATED, -15, (8, 9)[d % 2], zlib.Z_DEFAULT_STRATEGY)
                out.append(c.compress(t.encode()) + c.flush())
            yield pd.DataFrame({"ino": frame.doc_id, "stream": out})

    streams = _docs(spark, sf).select("doc_id", "text").mapInPandas(pack, "ino long, stream binary")
    found = codecs.reproduced(streams)
    return found.select("ino", "size", F.col("level").isNotNull().alias("found"))


@query("select codec, true same, (select count(*) from documents where text is not null) files from (values ('none'), ('zlib'), ('bcj-zlib'), ('zstd')) v(codec)")
def codec_roundtrip(spark, sf):
    docs, registry = table(spark, sf, "documents").where("text is not null"), codecs.registry()
    parts = [docs.select(F.lit(name).alias("codec"), registry.roundtrip_udf(name)("text").alias("same")) for name in registry.names()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("codec", "same").agg(F.count("*").alias("files"))


@query("select * from (values ('bcj-zlib', 3, 1, true), ('none', 0, 1, true), ('zlib', 2, 1, true), ('zstd', 1, 1, true), ('demo', 40, 7, false)) v(codec, algo, generation, builtin), (select 7 newest, 4 builtins)")
def registry_list(spark, sf):
    """The registry with a pack from a manifest, its newest generation, and how many codecs are built in."""
    registry = codecs.registry()
    manifest = codecs.parse_manifest("# a pack\nname = demo\nalgo = 0x28\ngeneration = 7\nnonsense\ncaps = seek|wholefile")
    registry.register(manifest["name"], manifest["algo"], bytes, bytes, manifest["generation"])
    return registry.table(spark).withColumn("newest", F.lit(registry.generation())).withColumn("builtins", F.lit(sum(c["builtin"] for c in registry._all.values())))


@query("select cast(n_nationkey as bigint) ino, case when n_nationkey % 5 = 4 then null else n_name || n_name end body from nation")
def pack_execution(spark, sf):
    """A pack's program on the executors: it writes {in} twice, and fails on every fifth."""
    blank = "${IFS}"  # a template is cut at blanks
    manifest = codecs.parse_manifest("name = twice\nalgo = 41\nencode = /bin/sh -c cat<{in}>{out};cat<{in}>>{out};grep" + blank + "-qv" + blank + "^no" + blank + "{in}")
    body = F.when(F.col("n_nationkey") % 5 == 4, F.lit("no")).otherwise(F.col("n_name"))
    files = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("ino"), body.cast("binary").alias("body"))
    found = packs.executed(files, manifest, "encode")
    return found.select("ino", F.col("body").cast("string").alias("body"))


@query("select cast(n_nationkey as bigint) ino, cast(octet_length(encode(n_name)) as bigint) size, case when n_nationkey % 2 = 0 then cast(octet_length(encode(n_name)) as bigint) end packed, case when n_nationkey % 2 = 0 then 'larger' else 'declined' end verdict from nation")
def pack_guard(spark, sf):
    """A pack that copies is never smaller; with packs switched off every file is declined."""
    manifest = codecs.parse_manifest("name = copy\nalgo = 42\nencode = /bin/cp {in} {out}\ndecode = /bin/cp {in} {out}")
    files = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("ino"), F.col("n_name").cast("binary").alias("body"))
    return packs.guarded(files.where("ino % 2 = 0"), manifest).unionByName(packs.guarded(files.where("ino % 2 = 1"), manifest, allowed=False))


_CRC = "list_reduce(list_prepend(4294967295::uinteger, list_transform(range(0, octet_length(encode(chunk))), lambda i: cast(('0x' || substring(hex(encode(chunk)), cast(2 * i + 1 as bigint), 2)) as uinteger))), lambda c, b: xor(c >> 8, list_extract(t, cast(xor(c, b) & 255 as integer) + 1)))"


@query(f"""with recursive step(i, k, v) as (select i, 0, i::uinteger from range(0, 256) r(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 2197175160::uinteger) else v >> 1 end from step where k < 8),
tab as (select list(v order by i) t from step where k = 8), {_SEG} select ino, lba, cast(xor({_CRC}, 4294967295::uinteger) as bigint) crc from seg, tab""")
def crc32c_check(spark, sf):
    segs = _segments(spark, sf).select("ino", "lba", "chunk")
    return segs.select("ino", "lba", codecs.crc32c("chunk").alias("crc"))


# --- plans over packed sizes --------------------------------------------------------------------------------------
_NAME = "case when doc_id % 4 = 0 then 'a.md' else 'a.bin' end"
_KIND = "case when doc_id % 7 = 0 then 'container' when doc_id % 7 = 1 then 'binary' else 'text' end"


def _repack(spark: SparkSession, sf: str, codec: str, chunk: int) -> DataFrame:
    """(ino, family, size, now, then): files of their own content, what they take now and what they would take packed in
    chunks of a size."""
    i = F.col("doc_id")
    head = F.when(i % 7 == 0, F.unhex(F.lit("1F8B"))).when(i % 7 == 1, F.unhex(F.lit("7F454C46"))).otherwise(F.lit(b""))
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    body = F.concat(head, F.rpad(plain, 300, ".").cast("binary"), plain.cast("binary"))
    name = F.when(i % 4 == 0, "a.md").otherwise("a.bin")
    rows = table(spark, sf, "documents").where("text is not null").select(i.alias("ino"), name.alias("name"), body.alias("body"))
    sized = rows.select("ino", classify.repack_family(F.col("name"), F.col("body")).alias("family"), F.length("body").cast("long").alias("size"), codecs.registry().size_udf(codec, chunk)("body").alias("then"))
    return sized.withColumn("now", formats.blocks_of(F.col("size")) * formats.BLOCK)


def _rolled(rows: DataFrame) -> DataFrame:
    return rows.groupBy("family").agg(F.count("*").alias("files"), F.sum("now").alias("now"), F.sum("then").alias("then"), F.sum(F.col("now") - F.col("then")).alias("saving"))


_REPACK = f"z as (select doc_id ino, {_KIND} family, cast(length(text) + 300 + case when doc_id % 7 = 0 then 2 when doc_id % 7 = 1 then 4 else 0 end as bigint) size from documents where text is not null), y as (select ino, family, size, cast(ceil((size + 8) / 4096) as bigint) * 4096 now, (size // 4000) * cast(ceil(4008 / 4096) as bigint) * 4096 + case when size % 4000 > 0 then cast(ceil((size % 4000 + 8) / 4096) as bigint) * 4096 else 0 end then_ from z)"


@query(f"with {_REPACK} select family, count(*) files, cast(sum(now) as bigint) now, cast(sum(then_) as bigint) \"then\", cast(sum(now - then_) as bigint) saving from y group by family")
def repack_plan_plain(spark, sf):
    """The plan for chunks that are stored as they are: sizes that SQL can tell."""
    return _rolled(_repack(spark, sf, "none", 4_000))


@query()
def repack_plan(spark, sf):
    """The plan by real compression; checked by hand in the tests."""
    return _rolled(_repack(spark, sf, "zlib", 65_536))


@query(f"with {_REPACK} select ino, family, size, now, then_ \"then\", now - then_ saving from y order by saving desc, ino limit 20")
def repack_top(spark, sf):
    rows = _repack(spark, sf, "none", 4_000).withColumn("saving", F.col("now") - F.col("then"))
    return rows.orderBy(F.desc("saving"), "ino").limit(20).select("ino", "family", "size", "now", "then", "saving")


# --- host files ---------------------------------------------------------------------------------------------------
@query("select 'n_nationkey=' || n_nationkey dir, cast(octet_length(encode(n_name)) + 1 as bigint) size, sha256(n_name || chr(10)) content from nation")
def host_import(spark, sf):
    """A tree of one file a nation, written and read as host files."""
    path = folder(spark, "host")
    table(spark, sf, "nation").select("n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = sources.host_tree(spark, path)
    return found.select(F.regexp_extract("path", "/(n_nationkey=[0-9]+)/[^/]*$", 1).alias("dir"), F.col("size").cast("long").alias("size"), F.sha2("body", 256).alias("content")).where("dir <> ''")


@query("select n_name name, cast(octet_length(encode(n_comment)) as bigint) size, n_comment content from (select n_name, n_name || ' of ' || n_regionkey n_comment from nation)")
def file_export(spark, sf):
    """Files copied in, listed with their sizes, and read out again."""
    path = folder(spark, "files")
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.concat("n_name", F.lit(" of "), F.col("n_regionkey")).alias("content"))
    sources.write_ordered(rows, "name", path)
    return spark.read.parquet(path).select("name", F.octet_length("content").cast("long").alias("size"), "content")


@query(f"with {_DIR} select name, child ino, parent, row_number() over (order by encode(name), child) place from dirent where type = 'd'")
def name_order(spark, sf):
    """Names in the order of their bytes, ids within a name."""
    from quarry.operators.order import prefix_sums

    rows = dirents(spark, sf).where("type = 'd'").select("name", F.col("child").alias("ino"), "parent", F.lit(1).cast("long").alias("one"))
    placed = prefix_sums(rows, "one", [F.col("name").cast("binary").asc(), F.col("ino").asc()])
    return placed.select("name", "ino", "parent", F.col("total").alias("place"))


@query("select cast(o_orderkey as bigint) k, o_totalprice v from orders where o_orderkey >= 100 and o_orderkey < 900")
def bulk_build(spark, sf):
    """A key-ordered table built in one pass, and a range read from it."""
    path = folder(spark, "ordered")
    sources.write_ordered(table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_totalprice").alias("v")), "k", path)
    return spark.read.parquet(path).where("k >= 100 and k < 900")
