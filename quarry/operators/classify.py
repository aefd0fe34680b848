"""What content is: text or binary families, codec scores, the lane a file takes, permissions, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of the text families, by family number.
TEXT_FAMILIES = {
    1: ("c", "h", "cpp", "cc", "hpp"),
    2: ("py",),
    3: ("js", "ts", "mjs"),
    4: ("java",),
    5: ("rs",),
    6: ("go",),
    7: ("json", "xml", "yaml", "yml", "toml", "csv"),
    8: ("txt", "md", "log", "rst"),
    9: ("html", "css"),
    10: ("sh", "bash"),
}
SNIFFED_TEXT = 11
#: The bytes of a head that are looked at, and the share of them (in percent) that must be printable.
TEXT_HEAD, TEXT_SHARE = 8192, 85
#: Families of programs (ELF for x86-64, x86, 64-bit ARM and others, PE, Mach-O), and the least size.
ELF_X64, ELF_X86, ELF_A64, ELF_OTHER, PE, MACHO = 20, 21, 22, 23, 24, 25
PROGRAM_SIZE = 4096
#: ELF machine numbers, and the leading bytes of Mach-O in both byte orders, thin and fat.
ELF_MACHINES = {62: ELF_X64, 3: ELF_X86, 183: ELF_A64}
MACHO_MAGICS = ("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "BEBAFECA")
#: Leading bytes (hex), their offset, and the codec they name.
MAGICS = (
    ("504B0304", 0, "zip"),
    ("7573746172", 257, "tar"),
    ("1F8B", 0, "gz"),
    ("89504E470D0A1A0A", 0, "png"),
    ("664C6143", 0, "flac"),
    ("494433", 0, "mp3"),
    ("0000000C4A584C20", 0, "jxl"),
    ("FF0A", 0, "jxl"),
    ("FFD8FF", 0, "jxl"),
    ("4D414320", 0, "ape"),
    ("7776706B", 0, "wavpack"),
)
#: Scores of a magic, of a text family (or an extension that a pack names), and of a program.
MAGIC_SCORE, EXTENSION_SCORE, PROGRAM_SCORE = 100, 50, 40
#: Profiles in their order, the level each compresses at and its codec.
PROFILES = {"fast": 6, "balanced": 19, "dense": 19, "archive": 19, "faster": 3, "fastest": 19, "turbo": 1}
PROFILE_CODECS = {"fastest": "lz4", "turbo": "none"}
#: Stored classes of which a file may enter a batch again; a plain one only if it is a program.
RETRIED, PLAIN = ("memlimit", "uncompressible", "guard"), "generic"
#: Names of the engine's own rows begin so.
INTERNAL = "\x01"


def _bytes(body: Column, head: int) -> Column:
    """The first bytes as a string of as many characters, U+0000 to U+00FF."""
    return F.decode(F.substring(body.cast("binary"), 1, head), "ISO-8859-1")


def is_text(body: Column, head: int = TEXT_HEAD) -> Column:
    """No NUL in a head of so many bytes, and 85 % of them printable ASCII or white space. body is text or bytes."""
    chars = _bytes(body, head)
    clean = F.length(F.regexp_replace(chars, r"[^ -~\t\n\r]", ""))
    return (F.length(chars) > 0) & (F.instr(chars, "\x00") == 0) & (clean * 100 >= F.length(chars) * TEXT_SHARE)


def extension(name: Column) -> Column:
    """The extension in small letters (ASCII only), empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def text_family(name: Column, body: Column) -> Column:
    """By extension, which beats content; else 11 for what reads as text; else 0."""
    known = _lookup({e: n for n, exts in TEXT_FAMILIES.items() for e in exts})
    return F.coalesce(F.element_at(known, extension(name)), F.when(is_text(body), SNIFFED_TEXT).otherwise(0))


def binary_family(body: Column) -> Column:
    """Programs by their bytes; 0 for all else, for bodies under 4096 bytes, and for an MZ without its PE header."""
    body = body.cast("binary")
    at = lambda i, n: F.hex(F.substring(body, F.lit(i + 1), F.lit(n)))
    little = lambda i, n: F.conv(F.concat(*[at(i + k, 1) for k in reversed(range(n))]), 16, 10).cast("long")
    machine = F.coalesce(F.element_at(_lookup(ELF_MACHINES), little(18, 2).cast("int")), F.lit(ELF_OTHER))
    pe_at = little(60, 4)
    pe = (pe_at >= 64) & (pe_at + 4 <= F.length(body)) & (F.hex(F.substring(body, F.least(pe_at, F.lit(2**31 - 5)).cast("int") + 1, F.lit(4))) == "50450000")
    return F.when(F.length(body) < PROGRAM_SIZE, 0).when(at(0, 4) == "7F454C46", machine).when(at(0, 2) == "4D5A", F.when(pe, PE).otherwise(0)).when(at(0, 4).isin(*MACHO_MAGICS), MACHO).otherwise(0)


def rules(spark: SparkSession) -> DataFrame:
    """The magic rules as a table: codec, magic (hex), offset, score."""
    return spark.createDataFrame([(c, m, o, MAGIC_SCORE) for m, o, c in MAGICS], "codec string, magic string, offset int, score int")


def magic_at(body: Column, magic: str, offset: int = 0) -> Column:
    """Whether the bytes (hex) stand at an offset."""
    return F.hex(F.substring(body.cast("binary"), offset + 1, len(magic) // 2)) == magic


def sniff(name: Column, body: Column) -> Column:
    """The best (score, codec) of a file, null without any rule that fits: a magic (MPEG audio also by its frame sync),
    a text family, a program. The rules are a fixed list, so they are worked into the expression: no join."""
    fits = lambda score, codec: F.struct(F.lit(score).alias("score"), F.lit(codec).alias("codec"))
    hits = [F.when(magic_at(body, m, o), fits(MAGIC_SCORE, c)) for m, o, c in MAGICS]
    second = F.conv(F.hex(F.substring(body.cast("binary"), 2, 1)), 16, 10).cast("int")
    hits.append(F.when(magic_at(body, "FF") & (second >= 0xE0), fits(MAGIC_SCORE, "mp3")))
    hits.append(F.when(text_family(name, body) > 0, fits(EXTENSION_SCORE, "text")))
    hits.append(F.when(binary_family(body) > 0, fits(PROGRAM_SCORE, "program")))
    return F.array_max(F.filter(F.array(*hits), lambda x: x.isNotNull()))


def pack_score(name: Column, body: Column, magics: list[tuple[str, int]], exts: list[str]) -> Column:
    """What a pack's manifest rules give: 100 for any magic (hex, offset), else 50 for an extension, else 0."""
    hit = reduce(lambda a, b: a | b, [magic_at(body, m, o) for m, o in magics], F.lit(False))
    return F.when(hit, MAGIC_SCORE).when(extension(name).isin([e.lower() for e in exts]), EXTENSION_SCORE).otherwise(0)


def repack_family(name: Column, body: Column) -> Column:
    """The families of a repacking plan: container, binary, text, raw."""
    head = F.substring(body.cast("binary"), 1, 4096)
    container = magic_at(body, "1F8B") | magic_at(body, "7573746172", 257) | magic_at(body, "89504E470D0A1A0A") | (magic_at(body, "504B") & (F.length(body.cast("binary")) >= 4))
    return F.when(container, "container").when(magic_at(body, "7F454C46"), "binary").when(text_family(name, head) > 0, "text").otherwise("raw")


#: The order in which lanes are tried.
LANES = ("anchored", "write-hot", "flac", "tar", "gz", "png", "jxl", "mp3", "container", "text-batch", "program-batch", "generic")


def lane(size: Column, anchored: Column, wheat: Column, codec: Column, text: Column, program: Column, block: int = 4096) -> Column:
    """The lane of a file: the first that takes it."""
    out = F.when(size < block, "sub-block-batch").when(anchored, "anchored").when(wheat >= 2, "write-hot")
    for one in ("flac", "tar", "gz", "png", "jxl", "mp3"):
        out = out.when(codec == one, one)
    return out.when(codec == "zip", "container").when(text, "text-batch").when(program, "program-batch").otherwise("generic")


def permitted(mode: Column, owner: Column, group: Column, uid: int, gids: list[int], want: str) -> Column:
    """POSIX mode bits: the owner's, the group's or the others' triple; root may read and write everything, and run
    what anyone may run."""
    bit = {"r": 4, "w": 2, "x": 1}[want]
    own = F.shiftright(mode, 6).bitwiseAND(bit) != 0
    grp = F.shiftright(mode, 3).bitwiseAND(bit) != 0
    oth = mode.bitwiseAND(bit) != 0
    if uid == 0:
        return F.lit(True) if want != "x" else mode.bitwiseAND(0o111) != 0
    return F.when(owner == uid, own).when(group.isin(gids), grp).otherwise(oth)


def acl_permitted(entries: Column, uid: int, gids: list[int], want: str) -> Column:
    """entries: array of (tag, id, perm), tags owner, user, owning-group, group, mask, other; the first class that
    matches decides; mask limits users and groups."""
    bit = {"r": 4, "w": 2, "x": 1}[want]
    has = lambda which: F.exists(which, lambda e: e["perm"].bitwiseAND(bit) != 0)
    of = lambda tag, ids=None: F.filter(entries, lambda e: (e["tag"] == tag) & (F.lit(True) if ids is None else e["id"].isin(ids)))
    mask = (F.size(of("mask")) == 0) | has(of("mask"))
    groups = F.concat(of("owning-group", gids), of("group", gids))
    return F.when(F.size(of("owner", [uid])) > 0, has(of("owner", [uid]))).when(F.size(of("user", [uid])) > 0, has(of("user", [uid])) & mask).when(F.size(groups) > 0, has(groups) & mask).otherwise(has(of("other")))


def version_key(version: Column) -> Column:
    """Numeric order of dotted triples; anything else sorts after them by its text."""
    triple = version.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")
    numbers = F.transform(F.split(version, r"\."), lambda x: F.try_to_number(x, F.lit("999999999999")).cast("long"))
    return F.struct((~triple).alias("text"), F.when(triple, numbers).alias("numbers"), F.when(~triple, version).alias("raw"))


def parse_size(text: Column) -> Column:
    """Digits, then K, M or G (powers of 1024) and B or not, with blanks between and behind; null for anything else."""
    rule = r"^\s*([0-9]+)[ \t]*([KkMmGg]?)[Bb]?[ \t]*$"
    number, suffix = F.regexp_extract(text, rule, 1), F.upper(F.regexp_extract(text, rule, 2))
    power = F.when(suffix == "", 0).otherwise(F.instr(F.lit("KMG"), suffix))
    size = F.try_multiply(number.try_cast("decimal(20,0)").cast("decimal(20,0)"), F.pow(F.lit(1024), power).cast("decimal(10,0)"))
    return F.when((number != "") & (size < F.lit("9223372036854775808").cast("decimal(20,0)")), size.cast("long"))


def profile_level(name: Column) -> Column:
    return F.element_at(_lookup(PROFILES), name)


def profile_codec(name: Column) -> Column:
    """The codec that a profile's plain sweep uses; null for an unknown one."""
    return F.when(F.array_contains(F.lit(list(PROFILES)), name), F.coalesce(F.element_at(_lookup(PROFILE_CODECS), name), F.lit("zstd")))


def anchored(path: Column, folders: list[str]) -> Column:
    """Whether a path lies below one of the folders whose files stay as they are."""
    return reduce(lambda a, b: a | b, [path.startswith(f.rstrip("/") + "/") for f in folders], F.lit(False))


def internal(name: Column) -> Column:
    """The engine's own rows, and rows without a name."""
    return F.coalesce(name == "", F.lit(True)) | name.startswith(INTERNAL)


def rebatchable(cls: Column, program: Column) -> Column:
    """Which stored classes may enter a batch again."""
    return F.coalesce(cls.isin(*RETRIED) | (program & (cls == PLAIN)), F.lit(False))


def retried(files: DataFrame, generations: DataFrame) -> DataFrame:
    """files(ino, lane, gen) that a lane settled under an older generation than generations(lane, generation) has now: one
    row a file, with the lane that is to try again."""
    return files.join(generations, "lane").where(F.col("gen") < F.col("generation")).select("ino", "lane", "gen", "generation")


def sweepable(files: DataFrame, generation: int) -> DataFrame:
    """files(ino, type, segments, cls, gen, name): live regular files with content that are not internal, and were
    not settled under this or a later codec generation."""
    terms = [F.col("type") == "f", F.col("segments") > 0, ~internal(F.col("name")), F.col("cls").isNull() | (F.col("gen") < generation)]
    return files.where(reduce(lambda a, b: a & b, terms))


def repackable(entries: DataFrame, batched_zone: int = 1, window_algo: int = 24) -> DataFrame:
    """entries(ino, zone, algo): files without an entry in a shared batch and without a view of another file."""
    return entries.groupBy("ino").agg(F.bool_or((F.col("zone") == batched_zone) | (F.col("algo") == window_algo)).alias("_tied")).where(~F.col("_tied")).select("ino")
