"""Unicode obfuscation: hidden characters, masks, and what normalising changes, in two profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlens.functions import patterns as P
from promptlens.functions import text as T

HIDDEN = f"[{P.ZERO_WIDTH}{P.INVISIBLE}]"


def positions(c: Column, pattern: str) -> Column:
    """Places, from 0, of the characters of a class."""
    found = F.filter(F.transform(F.split(c, ""), lambda ch, i: F.when(F.rlike(ch, F.lit(pattern)), i)), lambda x: x.isNotNull())
    return F.when(F.rlike(c, F.lit(pattern)), found).otherwise(F.array().cast("array<int>"))


def remove_hidden(c: Column) -> Column:
    """Without zero-width characters and odd spaces; these go, too, and become no blank."""
    return F.regexp_replace(c, HIDDEN, "")


def mask(c: Column) -> Column:
    """One sign for each character: Z zero-width, I odd space, H a letter or digit beyond ASCII, a dot else."""
    out = c
    for pattern, mark in ((P.ZERO_WIDTH, "\x01"), (P.INVISIBLE, "\x02"), (r"[\p{L}\p{Nd}&&[^\x00-\x7F]]", "\x03"), (r"(?s)[^\x01\x02\x03]", ".")):
        out = F.regexp_replace(out, pattern, mark)
    return F.translate(out, "\x01\x02\x03", "ZIH")


def strict_mask(c: Column) -> Column:
    """As ``mask`` with the strict profile's classes; H marks only letters that look like Latin ones."""
    out = c
    for pattern, mark in ((P.STRICT_ZERO_WIDTH, "\x01"), (P.STRICT_INVISIBLE, "\x02"), (f"[{P.HOMOGLYPHS}]", "\x03"), (r"(?s)[^\x01\x02\x03]", ".")):
        out = F.regexp_replace(out, pattern, mark)
    return F.translate(out, "\x01\x02\x03", "ZIH")


def changed(a: Column, b: Column) -> Column:
    """(at, was, now) where two texts differ, up to the end of the shorter."""
    least = F.least(F.length(a), F.length(b))
    both = F.slice(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("was"), y.alias("now"))), 1, least)
    pairs = F.transform(both, lambda p, i: F.struct(i.alias("at"), p["was"].alias("was"), p["now"].alias("now")))
    none = F.array().cast("array<struct<at:int,was:string,now:string>>")
    return F.when((a == b) | (least == 0), none).otherwise(F.filter(pairs, lambda p: p["was"] != p["now"]))


def _changes(places: Column, a: Column, b: Column) -> Column:
    return F.size(places) + F.abs(F.length(a) - F.length(b))


def diff_of(places: Column, a: Column, b: Column) -> Column:
    """The changes in short: how many places, the difference in length, and the first three."""
    by = F.length(b) - F.length(a)
    shown = F.transform(F.slice(places, 1, 3), lambda p: F.format_string("pos%d:'%s'=>'%s'", p["at"], p["was"], p["now"]))
    parts = F.concat(
        F.concat(F.lit("changed_positions="), F.size(places).cast("string")),
        F.when(by != 0, F.concat(F.lit(",length_diff="), by.cast("string"))).otherwise(""),
        F.when(F.size(places) > 0, F.concat(F.lit(",samples=["), F.array_join(shown, ","), F.lit("]"))).otherwise(""),
    )
    return F.when(a == b, F.lit("no_changes")).otherwise(parts)


def strict_diff_of(places: Column, a: Column, b: Column) -> Column:
    """The changes with their code points, up to five parts."""
    point = lambda ch: F.format_string("'%s' (U+%04X)", ch, F.ascii(ch))
    shown = F.transform(F.slice(places, 1, 5), lambda p: F.concat(F.lit("pos "), p["at"].cast("string"), F.lit(": "), point(p["was"]), F.lit(" -> "), point(p["now"])))
    longer = F.concat(F.lit("Length changed: "), F.length(a).cast("string"), F.lit(" -> "), F.length(b).cast("string"))
    parts = F.concat(shown, F.when(F.length(a) != F.length(b), F.array(longer)).otherwise(F.array().cast("array<string>")))
    return F.when(a == b, F.lit("No changes")).otherwise(F.array_join(F.slice(parts, 1, 5), "; "))


ANALYSIS = ("zero_width_found", "invisible_chars_found", "unicode_obfuscation_flag", "zero_width_count", "invisible_count", "zero_width_positions", "normalization_changes", "unicode_diff")


def with_unicode(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ANALYSIS, normalized_text, zero_width_removed and special_char_mask of a column.

    Changes are those of NFKC after hidden characters went.  The flag: any
    hidden character, more than five changes, or changes in more than a
    twentieth of the text.  Null is read as empty.
    """
    c = F.coalesce(F.col(column), F.lit(""))
    df = df.withColumns({"zero_width_removed": remove_hidden(c), "zero_width_count": F.regexp_count(c, F.lit(P.ZERO_WIDTH)), "invisible_count": F.regexp_count(c, F.lit(P.INVISIBLE))})
    df = df.withColumn("normalized_text", T.nfkc(F.col("zero_width_removed")))
    df = df.withColumn("_places", changed(F.col("zero_width_removed"), F.col("normalized_text")))
    a, b = F.col("zero_width_removed"), F.col("normalized_text")
    df = df.withColumns({"normalization_changes": _changes(F.col("_places"), a, b), "unicode_diff": diff_of(F.col("_places"), a, b), "zero_width_positions": positions(c, P.ZERO_WIDTH), "special_char_mask": mask(c), "zero_width_found": F.col("zero_width_count") > 0, "invisible_chars_found": F.col("invisible_count") > 0})
    n = F.col("normalization_changes")
    many = (n > 5) | (F.coalesce(F.try_divide(n, F.length(c)), F.lit(0.0)) > 0.05)
    return df.withColumn("unicode_obfuscation_flag", F.col("zero_width_found") | F.col("invisible_chars_found") | many).drop("_places")


def with_strict_unicode(df: DataFrame, column: str, raw: str | None = None) -> DataFrame:
    """``df`` with ANALYSIS of a column by the strict profile: changes against the ``raw`` column, more than three raise the flag."""
    c = F.coalesce(F.col(column), F.lit(""))
    before = F.coalesce(F.col(raw), F.lit("")) if raw else F.lit("")
    df = df.withColumns({"_places": changed(before, c) if raw else changed(c, c), "zero_width_count": F.regexp_count(c, F.lit(P.STRICT_ZERO_WIDTH)), "invisible_count": F.regexp_count(c, F.lit(P.STRICT_INVISIBLE))})
    given = before != ""
    n = F.when(given & (before != c), _changes(F.col("_places"), before, c)).otherwise(0)
    diff = F.when(given, strict_diff_of(F.col("_places"), before, c)).otherwise(F.lit("Raw text not provided"))
    df = df.withColumns({"normalization_changes": n, "unicode_diff": diff, "zero_width_positions": positions(c, P.STRICT_ZERO_WIDTH), "zero_width_found": F.col("zero_width_count") > 0, "invisible_chars_found": F.col("invisible_count") > 0})
    return df.withColumn("unicode_obfuscation_flag", F.col("zero_width_found") | F.col("invisible_chars_found") | (F.col("normalization_changes") > 3)).drop("_places")


def with_clean(df: DataFrame, column: str) -> DataFrame:
    """``df`` with clean_text (no zero-width characters, NFKC), zero_width_removed (how many went) and the strict ANALYSIS of it against the column."""
    c = F.coalesce(F.col(column), F.lit(""))
    df = df.withColumns({"clean_text": T.nfkc(F.regexp_replace(c, P.STRICT_ZERO_WIDTH, "")), "zero_width_removed": F.regexp_count(c, F.lit(P.STRICT_ZERO_WIDTH))})
    return with_strict_unicode(df, "clean_text", column)
