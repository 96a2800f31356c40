"""Line deduplication as an exact set-similarity join.

A line's tokens are its distinct lower-cased words, as 58-bit hashes and, above
them, five bits of the word's length.  They are ordered by rarity; a line's
prefix is the part of that order in which two lines of Jaccard similarity
``THRESHOLD`` must share a token.  Lines that share a prefix token are candidates
if they pass the length and positional filters and a bound from parity maps: a
token flips one of 64 bits, so each bit in which two lines' maps differ comes
from a token that only one of them has; lines of over ``LONG`` words have 128.  Postings stand by token and class of length; classes are
so wide that similar lines are of one class or of neighbours, and a line's
tokens stand in its own class and, as far as the longer line of a pair may have
it, in the next one.  So lines of other lengths never meet.  The
Jaccard similarity of the whole lines is then verified: a pair's union is the
tokens of both texts put together.  A line goes when an earlier line (by
doc_id, then line number) is similar to it or has the same tokens.  Lines of
the same tokens are one group throughout, so copies are never paired.

One earlier similar line is enough for a line to go.  So each line is first
compared with the earliest of the lines that share three MinHash values with
it, for each three of them, where ``LARGE`` lines or more do; lines that this finds similar take part in
the join as earlier lines only.  A large group of near copies thus costs some
pairs a line and, but for the few lines left, not its square; no line stays
without the join.

Everything is a DataFrame operation.  The order only has to be one and the same
everywhere, and any order gives the same lines.  Long words are rare, so the
first order is by length, which takes no pass over the words.  From all
postings it is then told how many pairs they would make; if that is over
``MOST_PAIRS`` a line, the words of all lines are counted and the lines described
again, by counts.  These are kept as logarithms in a table of ``2**BUCKET_BITS``
bytes whatever the size of the vocabulary; words of one bucket count together.
That table is what every task gets.  Token sets are not stored: those of candidates are cut again from their
lines, and a bit table of ``2**PLACE_BITS`` bits keeps most other lines out of
that exchange.

Defined cases: null text is empty; lines without words are always kept and
count as lines; rows that share a doc_id are read as one document, a null
doc_id comes last; lines at one place of rows that repeat are one line; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlens.llm.common import stash, text_of, unstash

THRESHOLD = 0.8
BUCKET_BITS = 18
PLACE_BITS = 22
#: Parts in which as many pairs as there are lines are verified.
PARTS = 4
#: Lines of one band from which on they are compared with its earliest line first.
LARGE = 2
#: Lines of more words have a parity map of 128 bits: near copies that are not similar differ in few bits, and the flips of many tokens fill 64.
LONG = 16
#: Parts, by token, in which the join of as many groups as ``MANY`` or more is made, so that not all postings are on disk at once.
TOKEN_PARTS = 5
MANY = 1 << 16
#: Pairs of postings for each line from which on words are counted.
MOST_PAIRS = 1000
_LAST = 9223372036854775807
_HASH = (1 << 58) - 1  # the level stands in the five bits above
_PLACE = ("d", "line", "x")
_BETWEEN = r"[^a-z0-9\p{L}\p{N}]+"  # most characters are told by the first two ranges


def _words() -> Column:
    """The lower-cased words of ``text``, and an empty one where it does not begin or end with a word."""
    return F.split(F.lower("text"), _BETWEEN)


def _hash(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(_HASH))


def _token(word: Column) -> Column:
    """The word's hash, and above it a level that is less for longer words."""
    level = F.greatest(F.lit(31) - F.octet_length(word), F.lit(0)).cast("long")
    return F.shiftleft(level, 58).bitwiseOR(_hash(word))


def _tokens() -> Column:
    """The distinct words of ``text`` as tokens, the longest first."""
    return F.sort_array(F.array_remove(F.array_distinct(F.transform(_words(), _token)), _token(F.lit(""))))


def _held(spark, table: bytes) -> Column:
    """A table of bytes as a column; as a subquery it stays out of the text of plans."""
    return spark.createDataFrame([(bytearray(table),)], "table binary").scalar()


def _lines(docs: DataFrame) -> DataFrame:
    """d (doc_id, null last), doc_id, line, text, and x, which tells texts at one place apart."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(text_of(), "\n")).alias("line", "text"))
    return lines.select(_d().alias("d"), "doc_id", "line", "text", F.xxhash64("text").alias("x"))


def _d() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def word_table(docs: DataFrame, bits: int = BUCKET_BITS) -> bytes:
    """Entry b: the base-2 logarithm of how often the words of bucket b occur."""
    words = docs.select(text_of().alias("text")).select(F.explode(_words()).alias("word"))
    counts = words.select(_hash(F.col("word")).bitwiseAND(F.lit((1 << bits) - 1)).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).toArrow()  # 2**bits rows at most
    level = np.zeros(1 << bits, np.uint8)
    level[counts["b"].to_numpy()] = np.minimum(np.log2(counts["n"].to_numpy()), 31).astype(np.uint8)
    return level.tobytes()


def described(lines: DataFrame, level: bytes | None, threshold: float) -> DataFrame:
    """Lines with n (distinct words), two keys of them, their parity map, the tokens of the prefix (31 bits of each) and the bands; the order is by ``level`` or by length."""

    def rarity(x: Column) -> Column:
        table, at = F.lit(level), x.bitwiseAND(F.lit(len(level) - 1)).cast("int") + 1  # a subquery cannot stand inside transform
        return F.shiftleft(F.ascii(F.substring(table, at, F.lit(1)).cast("string")).cast("long"), 58).bitwiseOR(x.bitwiseAND(F.lit(_HASH)))

    def flips(tokens: Column) -> Column:
        return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 52).cast("int"))))

    place = ("d", "doc_id", "line", "x")
    sets = lines.select(*place, _tokens().alias("set")).select(*place, "set", F.size("set").alias("n"))
    ordered = sets.withColumn("rare", F.sort_array(F.transform("set", rarity)) if level else F.col("set")).withColumn("mixed", F.sort_array(F.transform("set", lambda x: x.bitwiseAND(F.lit(_HASH)))))
    half = F.when(F.col("n") > LONG, flips(F.filter("set", lambda x: x.bitwiseAND(F.lit(1)) == 1))).otherwise(F.lit(0).cast("long"))
    length = F.when(F.col("n") > 0, F.greatest(F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)).otherwise(0)
    prefix = F.transform(F.slice("rare", F.lit(1), length), lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    end = lambda k: F.slice("mixed", F.greatest(F.col("n") - (k - 1), F.lit(1)), F.lit(k))
    bands = F.array(F.xxhash64(F.lit(0), F.slice("mixed", 1, 3)), F.xxhash64(F.lit(1), end(3)), F.xxhash64(F.lit(2), F.slice("mixed", 1, 2), end(1)))
    return ordered.select(*place, "n", F.xxhash64("set").alias("k1"), F.xxhash64(F.lit(1), "set").alias("k2"), flips(F.col("set")).alias("bits"), half.alias("half"), prefix.alias("prefix"), bands.alias("bands"))


def _least_overlap(a: Column, b: Column, threshold: float) -> Column:
    return F.ceil((a + b) * F.lit(threshold / (1 + threshold)) - 1e-9)


def _fits(a, b, threshold: float) -> Column:
    """a and b, functions from a name to a column, may be similar by length and parity."""
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    by_length = F.least(a("n"), b("n")) >= F.lit(threshold) * F.greatest(a("n"), b("n")) - 1e-9
    most = a("n") + b("n") - 2 * _least_overlap(a("n"), b("n"), threshold)
    # half has the flips of every other token of a long line, so bits less these are those of the rest.
    whole = differ(a("bits"), b("bits"))
    halves = differ(a("half"), b("half")) + differ(a("bits").bitwiseXOR(a("half")), b("bits").bitwiseXOR(b("half")))
    return by_length & (whole <= most) & ((F.least(a("n"), b("n")) <= LONG) | (halves <= most))


def _earlier(a, b) -> Column:
    return (a("d") < b("d")) | ((a("d") == b("d")) & (a("line") < b("line")))


def slot_table(rows: DataFrame, columns: tuple[str, ...], bits: int = PLACE_BITS) -> bytes:
    """A bit for each value of ``_slot``: is there a row of this slot?"""
    slots = rows.select(_slot(columns, bits).alias("s"))
    maps = slots.groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()  # 2**bits bits at most
    size = 1 << 12
    table = bytearray(max(size, 1 << (bits - 3)) + size)
    for r in maps:  # buckets are counted from 1, that of 0 is 0 or 1
        table[r.k * size : (r.k + 1) * size] = r.m
    return bytes(table)


def _slot(columns: tuple[str, ...], bits: int = PLACE_BITS) -> Column:
    """A value from 1 on."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << bits) - 1)) + 1


def _in_table(table: Column, columns: tuple[str, ...]) -> Column:
    slot = _slot(columns)
    at, bit = F.bitmap_bucket_number(slot) * F.lit(1 << 12) + F.shiftright(F.bitmap_bit_position(slot), 3) + 1, F.bitmap_bit_position(slot).bitwiseAND(F.lit(7)).cast("int")
    byte = F.conv(F.hex(F.substring(table, at.cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1


def _repeated(rows: DataFrame, columns: tuple[str, ...]) -> Column:
    """Whether a row's ``columns`` may stand in ``rows`` more than once; false is certain, and spares most rows a shuffle."""
    often = rows.groupBy(*columns).count().where("count > 1")
    return _in_table(_held(rows.sparkSession, slot_table(often, columns)), columns)


def _verified(pairs: DataFrame, groups: DataFrame, docs: DataFrame, threshold: float, tag: str, n_groups: int) -> DataFrame:
    """id of each b of the stashed pairs (a, b), a earlier, whose lines are similar.

    Pairs are taken in parts by a, as many as hold about a ``PARTS``-th of as
    many pairs as there are groups, so that token sets of all lines are not on
    disk at once.
    """
    parts = max(1, -(-PARTS * pairs.count() // max(n_groups, 1)))
    found = None
    for k in range(parts):
        part = pairs.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == k)
        wanted = part.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        places = stash(groups.select("id", "d", "line", "x").join(wanted, "id", "left_semi"), f"{tag}-places")
        spark = docs.sparkSession
        own = docs.select("doc_id", "text", _d().alias("d")).where(_in_table(_held(spark, slot_table(places, ("d",))), ("d",)))
        some = _lines(own).select(*_PLACE, "text").where(_in_table(_held(spark, slot_table(places, _PLACE)), _PLACE))
        sets = stash(some.join(places, list(_PLACE)).select("id", _tokens().alias("set")), f"{tag}-sets")  # rows that repeat give a set twice
        both = part.join(sets.withColumnsRenamed({"id": "a", "set": "of_a"}), "a").join(sets.withColumnsRenamed({"id": "b", "set": "of_b"}), "b")
        both = both.select("b", F.size("of_a").alias("na"), F.size("of_b").alias("nb"), F.size(F.array_intersect("of_a", "of_b")).alias("common"))
        similar = both.where(F.col("common") >= F.lit(threshold) * (F.col("na") + F.col("nb") - F.col("common")) - 1e-9)
        similar = stash(similar.select(F.col("b").alias("id")).distinct(), f"{tag}-similar")
        unstash(sets)
        unstash(places)
        found = similar if found is None else found.union(similar)
    return found.distinct()


def _class(threshold: float) -> Column:
    """The class of a line's length; those of similar lines differ by one at most."""
    n, base = F.col("n"), 1 / threshold
    return F.floor(F.log(n) / math.log(base) + 1e-9) if base > 1 else n.cast("long")


def _posted(step: Column, x: Column) -> Column:
    return F.shiftleft(step, 32).bitwiseOR(x.cast("long"))


def posted_prefixes(left: DataFrame, threshold: float) -> DataFrame:
    """Rows by token, a prefix token and a class of length; at is its place, or -1 - place if the line is found similar already and stands as an earlier one only.

    Lines of one class differ in length by less than similar lines may.  A
    line's prefix stands in its own class (own); of it, what the shorter line
    of a pair may share with a line of the next class stands there too.  prev
    has the two tokens before it: where two lines share one of those too, they
    have met by it.
    """
    n, base, step = F.col("n"), 1 / threshold, _class(threshold)
    longer = F.greatest(n, F.ceil(F.pow(F.lit(base), step + 1) * (1 - 1e-6))) if base > 1 else n + 1
    shared = F.when(n >= F.lit(threshold) * longer - 1e-9, F.greatest(n - _least_overlap(n, longer, threshold) + 1, F.lit(0))).otherwise(0).cast("int")
    rows = left.select("id", "d", "line", "n", "bits", "half", "gone", step.alias("step"), F.size("prefix").alias("size"), "prefix", F.posexplode(F.concat("prefix", F.slice("prefix", F.lit(1), shared))).alias("pos", "x"))
    own = F.col("pos") < F.col("size")
    at = F.when(own, F.col("pos")).otherwise(F.col("pos") - F.col("size"))
    before = lambda k: F.coalesce(F.get("prefix", at - k).cast("long") + 1, F.lit(0).cast("long"))  # 0: none
    token = _posted(F.col("step") + F.when(own, 0).otherwise(1), F.col("x"))
    return rows.select("id", "d", "line", "n", "bits", "half", F.when(F.col("gone"), -1 - at).otherwise(at).alias("at"), F.shiftleft(before(1), 32).bitwiseOR(before(2)).alias("prev"), own.alias("own"), token.alias("token"))


def _met(a, b) -> Column:
    """Lines that share a token among the two before this one have met by that."""
    parts = lambda x: (F.shiftright(x("prev"), 32), x("prev").bitwiseAND(F.lit((1 << 32) - 1)))
    return reduce(or_, [(x == y) & (x > 0) for x in parts(a) for y in parts(b)])


def pairs_of_postings(groups: DataFrame, threshold: float, cells: int = 1 << 16) -> float:
    """About how many pairs (of two orders, and with itself) the postings of the lines' own classes make: the sum of their counts' squares.

    Each token adds 1 or -1 to one of ``cells`` sums; their squares add up to
    that sum but for about a hundredth of it.
    """
    posted = groups.select(_class(threshold).alias("step"), F.explode("prefix").alias("x"))
    h = F.xxhash64(_posted(F.col("step"), F.col("x")))
    signed = posted.select(h.bitwiseAND(F.lit(cells - 1)).alias("c"), (1 - 2 * F.shiftright(h, 20).bitwiseAND(F.lit(1))).alias("v"))
    sums = signed.groupBy("c").agg(F.sum("v").alias("v")).toArrow()["v"].to_numpy()  # ``cells`` rows at most
    return float((sums.astype(float) ** 2).sum())


def leaders_of(groups: DataFrame, threshold: float, large: int) -> DataFrame:
    """Pairs (a, b) of the earliest line of a band of ``large`` lines or more with each later line of it that it may be similar to."""
    keyed = groups.select("id", "d", "line", "n", "bits", "half", F.explode("bands").alias("key"))
    keyed = keyed.where(_repeated(keyed.select("key"), ("key",)))
    leaders = keyed.groupBy("key").agg(F.min(F.struct("d", "line", "id", "n", "bits", "half")).alias("o"), F.count(F.lit(1)).alias("often")).where(F.col("often") >= large)
    # Joined on a derived value, so that adaptive execution can split a hot key.
    leaders = leaders.select(F.bitwise_not("key").alias("j"), "o.*")
    later = keyed.withColumn("j", F.bitwise_not("key")).drop("key")
    a, b = ((lambda c, x=x: F.col(f"{x}.{c}")) for x in "ab")
    pairs = leaders.alias("a").join(later.alias("b"), (a("j") == b("j")) & _earlier(a, b) & _fits(a, b, threshold))
    return pairs.select(a("id").alias("a"), b("id").alias("b")).distinct()


def similar_groups(groups: DataFrame, docs: DataFrame, threshold: float, large: int = LARGE) -> DataFrame:
    """id of each group of lines that is similar to an earlier one; groups are stashed."""
    a, b = ((lambda c, x=x: F.col(f"{x}.{c}")) for x in "ab")
    n_groups = groups.count()
    pairs = stash(leaders_of(groups, threshold, large), "line-leaders")
    gone = stash(_verified(pairs, groups, docs, threshold, "line-leaders", n_groups), "line-gone")
    unstash(pairs)

    # Most lines are not in the table of those found similar, and need no join.
    named = groups.select("id", "d", "line", "n", "bits", "half", "prefix", _in_table(_held(groups.sparkSession, slot_table(gone, ("id",))), ("id",)).alias("named"))
    flagged = named.where("named").drop("named").join(gone.withColumn("similar", F.lit(True)), "id", "left")
    left = named.where("not named").withColumn("gone", F.lit(False)).drop("named").unionByName(flagged.withColumn("gone", F.col("similar").isNotNull()).drop("similar"))
    left = stash(left, "line-left")
    everything = posted_prefixes(left, threshold)
    # Both sides are one plan, names and all, so that their exchange is made once: no part of the condition is of one side alone.
    room = F.least(*[x("n") - F.greatest(x("at"), -1 - x("at")) for x in (a, b)])
    matches = (a("token") == b("token")) & _earlier(a, b) & (F.least(a("n"), b("at")) >= 0) & (a("own") | b("own")) & ~_met(a, b)  # n is 1 at least: b is not gone
    parts = TOKEN_PARTS if n_groups >= MANY else 1
    made = []
    for k in range(parts):
        posted = everything.where(F.col("token").bitwiseAND(F.lit((1 << 31) - 1)) % parts == k) if parts > 1 else everything
        joined = posted.alias("a").join(posted.alias("b"), matches & _fits(a, b, threshold) & (room >= _least_overlap(a("n"), b("n"), threshold)))
        made.append(stash(joined.select(F.struct(a("d"), a("line"), a("id").alias("id")).alias("at"), b("id").alias("b")).distinct(), "line-pairs"))
    unstash(left)
    pairs = made[0]
    if parts > 1:  # lines may meet in several parts
        pairs = stash(reduce(DataFrame.union, made).distinct(), "line-pairs")
        for part in made:
            unstash(part)
    if pairs.count() * PARTS <= n_groups:
        found = gone.union(_verified(pairs.select(F.col("at.id").alias("a"), "b"), groups, docs, threshold, "line-few", n_groups))
        unstash(pairs)
        return found
    # Nearly always the earliest candidate is similar; the others are compared where it is not.
    first = stash(pairs.groupBy("b").agg(F.min("at").alias("at")).select(F.col("at.id").alias("a"), "b"), "line-first")
    found = gone.union(_verified(first, groups, docs, threshold, "line-first", n_groups))
    rest = pairs.select(F.col("at.id").alias("a"), "b").join(found.withColumnRenamed("id", "b"), "b", "left_anti").join(first, ["a", "b"], "left_anti")
    rest = stash(rest, "line-rest")
    unstash(pairs)
    unstash(first)
    found = found.union(_verified(rest, groups, docs, threshold, "line-rest", n_groups))
    unstash(rest)
    return found


def _grouped(texts: DataFrame, level: bytes | None, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The lines, described, and a row for each group of lines of the same tokens; both stashed."""
    lines = stash(described(texts, level, threshold), "lines")
    held = ("d", "line", "x", "n", "bits", "half", "prefix", "bands")
    found = lines.where("n > 0").select("k1", "k2", *held)
    found = found.withColumn("repeated", _repeated(found.select("k1", "k2"), ("k1", "k2")))
    groups = found.where("repeated").groupBy("k1", "k2").agg(F.min(F.struct(*held)).alias("o"), F.count(F.lit(1)).alias("places")).select("k1", "k2", "places", "o.*")
    alone = found.where("not repeated").select("k1", "k2", F.lit(1).cast("long").alias("places"), *held)
    return lines, stash(groups.union(alone).withColumn("id", F.monotonically_increasing_id()), "line-groups")


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, bits: int = BUCKET_BITS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (sorted line numbers, from 0) of every document."""
    texts = _lines(docs)
    lines, groups = _grouped(texts, None, threshold)
    if pairs_of_postings(groups, threshold) > MOST_PAIRS * max(groups.count(), 1):
        unstash(lines)
        unstash(groups)
        lines, groups = _grouped(texts, word_table(docs, bits), threshold)
    some = F.col("n") > 0
    own = lines.select("d", "doc_id", "line", F.when(some, F.bitwise_not("k1")).alias("j1"), F.when(some, F.bitwise_not("k2")).alias("j2"))
    own = stash(own, "line-keys")
    unstash(lines)
    later = similar_groups(groups, docs, threshold).withColumn("similar", F.lit(True))
    flags = groups.select("id", "k1", "k2", "places", F.col("d").alias("d0"), F.col("line").alias("l0")).join(later, "id", "left").where("places > 1 or similar")
    # Joined on derived values, so that adaptive execution can split a hot line.
    flags = flags.select(F.bitwise_not("k1").alias("j1"), F.bitwise_not("k2").alias("j2"), "d0", "l0", F.coalesce("similar", F.lit(False)).alias("similar"))
    flags = stash(flags, "line-flags")
    named = own.withColumn("named", F.coalesce(_in_table(_held(own.sparkSession, slot_table(flags, ("j1", "j2"))), ("j1", "j2")), F.lit(False)))
    first = (F.col("d") == F.col("d0")) & (F.col("line") == F.col("l0"))
    gone = F.when(F.col("similar").isNotNull() & (F.col("similar") | ~first), F.col("line"))
    told = named.where("named").join(flags, ["j1", "j2"], "left").select("doc_id", gone.alias("gone"))
    told = told.union(named.where("not named").select("doc_id", F.lit(None).cast("int").alias("gone")))
    return told.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count("gone").alias("n_removed"), F.array_sort(F.collect_list("gone")).alias("removed"))


def without_lines(docs: DataFrame, threshold: float = THRESHOLD, bits: int = BUCKET_BITS) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``."""
    gone = removed_lines(docs, threshold, bits).where("n_removed > 0").select(F.col("doc_id").alias("_d"), F.col("removed").alias("_r"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), "doc_id", "text")
    kept = F.array_join(F.expr("filter(split(text, '\n'), (x, i) -> not array_contains(_r, i))"), "\n")
    joined = held.join(gone, held["doc_id"].eqNullSafe(gone["_d"]), "left")
    cut = joined.withColumn("text", F.when(F.col("_r").isNull(), F.col("text")).otherwise(kept))
    return cut.select(*[F.col("text") if c == "text" else F.col("held").getField(c).alias(c) for c in docs.columns])
