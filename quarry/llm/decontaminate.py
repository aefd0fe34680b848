"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders (#num, #name, #unit), so a benchmark question asked anew
with other values has the same template. All windows of WINDOW canonical words are hashed and joined to the windows of
the benchmark items. The windows found are told apart by occurrence: those on one diagonal (place in the document
less place in the item) and, for copies with words put in or left out, those on neighbouring diagonals. An item
is leaked into a document if one occurrence holds at least COVERAGE of its windows and its slots are consistent: the values
that item and document have there are paired, a re-parameterised copy replaces each value by one other value
throughout, and the share of item values that go to a single document value must be at least CONSISTENCY.

Canonical forms. Number: digits with inner points and commas. Unit: a word of UNITS right after a number. Name: a
word with a capital, then small letters, inside a sentence; also where it opens one, if it stands inside a sentence, too,
NEAR words off at most. Of names in a row only the last counts, so that one of two words can stand for one of a single
word. Everything else is lower case.

The benchmark's windows are broadcast only if they are at most BROADCAST_WINDOWS; beyond that, rows of (document, place,
hash) are joined to them by shuffle, and the documents' words are fetched for the windows found. A window that many
documents hold costs a row for each of them, never pairs of documents. All on Spark's own functions.

Defined cases: null or empty text of a document or an item has no windows and leaks nothing; an item of fewer words
than WINDOW has one window, all its words; copies of an item are items of their own; several texts under one doc_id, or
under none, are matched each by itself, and the best of them counts; a null doc_id or item_id is matched like any other
and comes back as null; other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import held, id_back, id_key, node_key, text_of

WINDOW = 8
COVERAGE = 0.5
CONSISTENCY = 0.8
#: Some 40 MB at most.
BROADCAST_WINDOWS = 200_000

#: Units after a number.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "sec", "min", "h", "hour", "hours", "day", "days", "week", "weeks", "year", "years", "mile", "miles", "foot", "feet", "inch", "inches", "pound", "pounds", "ounce", "ounces", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees", "watt", "watts", "volt", "volts", "meter", "meters", "liter", "liters", "gram", "grams", "minute", "minutes", "second", "seconds")

#: Words on either side among which a word that opens a sentence is looked for as a name.
NEAR = 64

_TOKEN = r"[.!?\n]|[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+"
_STOPS = (".", "!", "?", "\n")


def _is_number(t: Column) -> Column:
    return (t >= "0") & (t < ":")


def _is_name(t: Column) -> Column:
    first, rest = F.substring(t, 1, 1), F.substring(t, F.lit(2), F.length(t))
    # most words are in small letters and need one look only
    return (t != F.lower(t)) & (first != F.lower(first)) & (rest != "") & (rest == F.lower(rest))


def _typed(tokens: Column) -> Column:
    """The canonical form of each token, null for the ends of sentences and for names before a name."""

    def by_case(cased: Column) -> Column:
        def inner(t: Column, i: Column) -> Column:
            return F.when(F.get(cased, i) & (i > 0) & ~F.get(tokens, i - 1).isin(*_STOPS), t)

        def by_names(names: Column) -> Column:
            def one(t: Column, i: Column) -> Column:
                low = F.lower(t)
                again = F.array_contains(F.slice(names, F.greatest(i - NEAR, F.lit(0)) + 1, F.lit(2 * NEAR)), t)
                name = F.get(names, i).isNotNull() | F.coalesce(again, F.lit(False))
                last = F.when(~F.coalesce(F.get(cased, i + 1), F.lit(False)), "#name")
                unit = (i > 0) & _is_number(F.get(tokens, i - 1)) & low.isin(*UNITS)
                return F.when(F.get(cased, i), F.when(name, last).otherwise(low)).when(t.isin(*_STOPS), F.lit(None)).when(_is_number(t), "#num").when(unit, "#unit").otherwise(low)

            return F.transform(tokens, one)

        return held(F.transform(tokens, inner), by_names)

    return held(F.transform(tokens, _is_name), by_case)


def canonical(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows(keep..., text) -> (keep..., words, shapes): the words of each text and their canonical forms."""
    cut = rows.select(*keep, F.regexp_extract_all(F.col("text"), F.lit(_TOKEN), F.lit(0)).alias("tokens"))
    both = cut.select(*keep, F.arrays_zip(F.col("tokens").alias("word"), held(F.col("tokens"), _typed).alias("shape")).alias("both"))
    kept = both.select(*keep, F.filter("both", lambda x: x["shape"].isNotNull()).alias("both"))
    return kept.select(*keep, F.col("both.word").alias("words"), F.col("both.shape").alias("shapes"))


def _hashes(shapes: Column) -> Column:
    """Each form by its hash, so that windows are hashed over numbers."""
    return F.transform(shapes, lambda x: F.xxhash64(x))


def _rolled(forms: Column, length: int) -> Column:
    """All windows of a length over hashed forms: place and hash."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(forms) - length), lambda i: F.struct(i.alias("place"), F.xxhash64(F.slice(forms, i + 1, length)).alias("gram"), F.lit(length).alias("length")))
    return F.when(F.size(forms) >= length, hashes).otherwise(F.array().cast("array<struct<place:int,gram:bigint,length:int>>"))


def item_windows(items: DataFrame) -> DataFrame:
    """(item, windows, at, gram, length, slots): each window of each item; slots pairs places with the item's values."""
    shapes = canonical(items.select(id_key("item_id").alias("item"), text_of().alias("text")), ["item"])
    length = F.least(F.size("shapes"), F.lit(WINDOW))
    sized = shapes.where(F.size("shapes") > 0).select("*", length.alias("length"), (F.size("shapes") - length + 1).alias("windows"))
    each = sized.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    places = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda k: F.get("shapes", F.col("at") + k).startswith("#"))
    slots = F.transform(places, lambda k: F.struct(k.alias("k"), F.get("words", F.col("at") + k).alias("value")))
    return each.select("item", "windows", "at", "length", slots.alias("slots"), F.xxhash64(F.slice(_hashes(F.col("shapes")), F.col("at") + 1, F.col("length"))).alias("gram"))


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, item, windows, at, place, pairs) for each window that a document and an item share."""
    wanted = item_windows(items)
    facts = wanted.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("length") < WINDOW, F.col("length"))).alias("short")).first()
    shapes = canonical(docs.select(node_key().alias("doc"), text_of().alias("text")), ["doc"])
    rolled = held(_hashes(F.col("shapes")), lambda x: F.concat(*[_rolled(x, n) for n in [WINDOW, *sorted(facts.short)]]))
    small = facts.n <= BROADCAST_WINDOWS
    every = shapes.withColumn("rolled", rolled).select("doc", *(["words"] if small else []), F.explode_outer("rolled").alias("w")).select("*", "w.place", "w.gram", "w.length").drop("w")
    if small:
        found = every.join(F.broadcast(wanted), ["gram", "length"])
    else:
        found = every.join(wanted, ["gram", "length"]).join(shapes.select("doc", "words").dropDuplicates(["doc"]), "doc")
    pairs = F.transform("slots", lambda s: F.struct(s["value"].alias("item_value"), F.get("words", F.col("place") + s["k"]).alias("doc_value")))
    # rows alike give the same hits: one of each goes on
    return found.select("doc", "item", "windows", "at", "place", pairs.alias("pairs")).distinct()


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(node, doc_id, item_id, windows, found, coverage, slot_values, consistency) for each text and item that share a
    window, by the best occurrence: one that is a leak, then the largest coverage and consistency. node tells several
    texts under one doc_id apart (see node_key)."""
    off = F.col("place") - F.col("at")
    by_off = Window.partitionBy("doc", "item").orderBy("off")
    far = F.coalesce(F.col("off") - F.lag("off").over(by_off) > F.least(F.lit(WINDOW), F.col("windows") - 1), F.lit(False))
    cut = _hits(docs, items).withColumn("off", off).withColumn("far", far.cast("int"))
    cut = cut.withColumn("part", F.sum("far").over(by_off.rangeBetween(Window.unboundedPreceding, 0)))
    each = cut.withColumn("one", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("off").cast("long").alias("no")), F.struct(F.lit(1).alias("kind"), F.col("part").alias("no")))))
    found = each.groupBy("doc", "item", "windows", "one").agg(
        F.count_distinct("at").alias("found"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    values = F.size(F.array_distinct(F.col("pairs.item_value")))
    consistency = F.when(values == 0, 1.0).otherwise(values / F.size("pairs"))
    facts = found.select("doc", "item", "windows", "found", (F.col("found") / F.col("windows")).alias("coverage"), consistency.alias("consistency"), values.cast("long").alias("slot_values"))
    leak = (F.col("coverage") >= COVERAGE) & (F.col("consistency") >= CONSISTENCY)
    best = facts.groupBy("doc", "item", "windows").agg(F.max(F.struct(leak.alias("leak"), "coverage", "consistency", "slot_values", "found")).alias("best"))
    return best.select(F.col("doc").alias("node"), id_back("doc.doc").alias("doc_id"), id_back("item").alias("item_id"), F.col("windows").cast("long").alias("windows"), "best.*")


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The matches that are leaks, by text."""
    return matches(docs, items).where("leak").drop("leak")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, found, coverage, slot_values, consistency) of the leaks."""
    best = leaked(docs, items).groupBy("doc_id", "item_id", "windows").agg(F.max(F.struct("coverage", "consistency", "slot_values", "found")).alias("best"))
    return best.select("doc_id", "item_id", "windows", "best.found", "best.coverage", "best.slot_values", "best.consistency")


def oracle() -> str:
    """The same by SQL, windows as lists of words instead of hashes."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    stops = r"('.', '!', '?', chr(10))"

    def name(x: str) -> str:
        return f"(({x})[1] <> lower(({x})[1]) and ({x})[2:] <> '' and ({x})[2:] = lower(({x})[2:]))"

    def shapes(table: str, key: str) -> str:
        return rf"""select {key} k, list_filter(list_transform(t, lambda x, i: {{'word': x, 'shape':
  case when x in {stops} then null when x >= '0' and x < ':' then '#num'
  when {name("x")} and (mids[i] is not null or list_contains(mids[greatest(i - {NEAR}, 1) : greatest(i - 1 - {NEAR}, 0) + {2 * NEAR}], x)) then case when {name("coalesce(t[i + 1], '')")} then null else '#name' end
  when i > 1 and t[i - 1] >= '0' and t[i - 1] < ':' and lower(x) in ({units}) then '#unit' else lower(x) end}}), lambda y: y.shape is not null) w
  from (select {key}, t, list_transform(t, lambda x, i: case when i > 1 and {name("x")} and t[i - 1] not in {stops} then x end) mids
  from (select {key}, regexp_extract_all(coalesce(text, ''), '[.!?\n]|[0-9]+(?:[.,][0-9]+)*|[\p{{L}}\p{{M}}]+') t from {table}))"""

    def windows(name: str) -> str:
        return f"select k, w, len(w) - {WINDOW - 1} n, i - 1 place, list_transform(w[i : i + {WINDOW - 1}], lambda x: x.shape) gram, w[i : i + {WINDOW - 1}] own from {name}, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) u(i)"

    return f"""
with a as ({shapes("documents", "doc_id")}), b as ({shapes("benchmark", "item_id")}), x as ({windows("a")}), y as ({windows("b")}),
h as (select x.k doc_id, y.k item_id, y.n windows, y.place pos, x.place - y.place off_, x.own da, y.own ia from x join y on x.gram = y.gram),
c as (select *, case when off_ - lag(off_) over (partition by doc_id, item_id order by off_) > least({WINDOW}, windows - 1) then 1 else 0 end far from h),
d as (select *, sum(far) over (partition by doc_id, item_id order by off_ range unbounded preceding) part from c),
o as (select *, 0 kind, cast(off_ as bigint) no from d union all select *, 1, cast(part as bigint) from d),
f as (select doc_id, item_id, windows, kind, no, count(distinct pos) found from o group by all),
p as (select distinct doc_id, item_id, kind, no, ia[j].word iv, da[j].word dv from o, unnest(range(1, {WINDOW + 1})) u(j) where ia[j].shape like '#%'),
s as (select doc_id, item_id, kind, no, count(distinct iv) v, count(*) c from p group by all),
g as (select doc_id, item_id, cast(windows as bigint) windows, found, found / windows coverage, cast(coalesce(v, 0) as bigint) slot_values, coalesce(v / c, 1.0)::double consistency
from f left join s using (doc_id, item_id, kind, no) where found / windows >= {COVERAGE} and coalesce(v / c, 1.0) >= {CONSISTENCY})
select * from g qualify row_number() over (partition by doc_id, item_id order by coverage desc, consistency desc, slot_values desc, found desc) = 1"""
