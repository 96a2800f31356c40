"""Rule, heuristic, unicode and code columns; severity and scores."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlens.functions import patterns as P
from promptlens.functions.patterns import pyre
from promptlens.functions.text import strip


def matches(c: Column, pattern: str, ci: bool = False) -> Column:
    return F.regexp_like(c, F.lit(pyre(pattern, ci)))


def folded(c: Column) -> Column:
    """The text in lower case as case-blind patterns see it: with the letters that fold to an ASCII one beside A-Z."""
    return F.translate(F.lower(c), "\u017f\u0131", "si")


def holds(low: Column, needed: list[str]) -> Column:
    """Whether ``low`` has at least one alternative of every entry."""
    some = [reduce(or_, [F.contains(low, F.lit(x)) for x in entry.split("|")]) for entry in needed]
    return reduce(and_, some)


def rule_hit(c: Column, low: Column, name: str, pattern: str, ci: bool) -> Column:
    """The rule's pattern, tried only on texts that have the literals it needs."""
    if name in P.BEYOND_ASCII:
        return (F.octet_length(c) != F.length(c)) & matches(c, pattern, ci)
    return holds(low, P.NEEDED[name]) & matches(c, pattern, ci) if name in P.NEEDED else matches(c, pattern, ci)


def block_rule(c: Column, rules=None, low: Column | None = None) -> Column:
    """The id of the first rule that matches, in order; null when none does.  ``low``: ``folded(c)``, if it is at hand."""
    low = folded(c) if low is None else low
    return F.coalesce(*[F.when(rule_hit(c, low, i, p, ci), F.lit(i)) for i, p, ci in rules or P.BLOCK])


def block_match(c: Column, rules=None) -> Column:
    """(rule_id, matched_text) of the first rule that matches; null when none does."""
    low = folded(c)
    return F.coalesce(*[F.when(rule_hit(c, low, i, p, ci), F.struct(F.lit(i).alias("rule_id"), F.regexp_extract(c, pyre(p, ci), 0).alias("matched_text"))) for i, p, ci in rules or P.BLOCK])


def flag_signatures(c: Column, rules=None, low: Column | None = None) -> Column:
    low = folded(c) if low is None else low
    return F.array_compact(F.array(*[F.when(rule_hit(c, low, i, p, ci), F.lit(f"flag:{i}")) for i, p, ci in rules or P.FLAG]))


def verdict(block: Column, signatures: Column) -> Column:
    return F.when(block.isNotNull(), F.lit("blocked")).when(F.size(signatures) > 0, F.lit("flagged")).otherwise(F.lit("passed"))


def base64_run(c: Column, least: int = 50) -> Column:
    return matches(c, "[A-Za-z0-9+/]{%d,}={0,2}" % least)


def repeated_chars(c: Column, least: int = 20) -> Column:
    return F.regexp_like(c, F.lit(r"(?d)(.)\1{%d,}" % (least - 1)))


def long_line(c: Column, most: int = 500) -> Column:
    return F.exists(F.split(c, "\n"), lambda x: F.length(x) > most)


def tag_count(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("<")), F.regexp_count(c, F.lit(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s+[^>]*)?>(?!</|>)"))).otherwise(0)


def html_comment(c: Column) -> Column:
    return F.contains(c, F.lit("<!--")) & F.regexp_like(c, F.lit("(?s)<!--.*?-->"))


def many_delimiters(c: Column, least: int = 5) -> Column:
    return sum((F.length(c) - F.length(F.replace(c, F.lit(d), F.lit("")))) / 3 for d in P.MANY_DELIMITERS) >= least


def _found(low: Column, text: Column, patterns: list[str]) -> Column:
    """The patterns that occur; those that are literals, but for escapes, are looked up as such."""
    out = []
    for p in patterns:
        literal = re.sub(r"\\(\W)", r"\1", p).lower()
        plain = re.sub(r"\\\W", "", p)
        if not re.search(r"[\\()\[\]|?*+{}^$.]", plain):
            hit = F.contains(low, F.lit(literal))
        else:
            needed = [w for w in re.findall(r"[a-z]{4,}|new", re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\??", " ", p))]
            hit = holds(low, needed) & matches(text, p, True)
        out.append(F.when(hit, F.lit(p)))
    return F.array_compact(F.array(*out))


FLAGS = ("has_base64", "has_delimiters", "has_repeats", "has_long_line", "has_tags", "has_comments", "has_keywords", "has_many_delimiters")
WEIGHTS = dict(zip(FLAGS, (0.2, 0.3, 0.1, 0.15, 0.1, 0.15, 0.4, 0.2), strict=True))


def with_heuristics(df: DataFrame, column: str, sample: int = P.SAMPLE) -> DataFrame:
    """``df`` with the eight checks over the first ``sample`` characters of a column, the pattern list and the score.

    The columns are made in steps, so that the sample, its lower case and the
    lists are found once each.
    """
    df = df.withColumn("_head", F.substring(F.coalesce(F.col(column), F.lit("")), 1, sample))
    df = df.withColumn("_low", folded(F.col("_head")))
    t, low = F.col("_head"), F.col("_low")
    df = df.withColumns({"_delimiters": _found(low, t, P.DELIMITERS), "_keywords": _found(low, t, P.KEYWORDS)})
    made = (base64_run(t), F.size("_delimiters") > 0, repeated_chars(t), long_line(t), tag_count(t) > 2, html_comment(t), F.size("_keywords") > 0, many_delimiters(t))
    df = df.withColumns(dict(zip(FLAGS, made, strict=True)))
    score = F.lit(0.0)
    for k, w in WEIGHTS.items():
        score = score + F.when(F.col(k), F.lit(w)).otherwise(F.lit(0.0))
    named = lambda k, n: F.when(F.col(k), F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
    parts = (named("has_base64", "long_base64"), F.col("_delimiters"), named("has_repeats", "repeated_chars"), named("has_long_line", "long_single_line"), named("has_tags", "xml_tags"), named("has_comments", "html_comments"), F.col("_keywords"), named("has_many_delimiters", "many_delimiters"))
    return df.withColumns({"detected_patterns": F.concat(*parts), "suspicious_score": F.least(F.lit(1.0), score)}).drop("_head", "_low", "_delimiters", "_keywords")


HEURISTICS = (*FLAGS, "suspicious_score", "detected_patterns")


def is_suspicious(score: Column) -> Column:
    return score > 0.3


def unicode_scan(c: Column) -> dict[str, Column]:
    zero, invisible = F.regexp_count(c, F.lit(P.ZERO_WIDTH)), F.regexp_count(c, F.lit(P.INVISIBLE))
    places = F.filter(F.transform(F.split(c, ""), lambda ch, i: F.when(F.regexp_like(ch, F.lit(P.ZERO_WIDTH)), i)), lambda x: x.isNotNull())
    mask = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, P.ZERO_WIDTH, "\x01"), P.INVISIBLE, "\x02"), r"[\p{L}\p{Nd}&&[^\x00-\x7F]]", "\x03"), r"(?s)[^\x01\x02\x03]", ".")
    return {"zero_width_count": zero, "invisible_count": invisible, "zero_width_positions": places, "mask": F.translate(mask, "\x01\x02\x03", "ZIH"), "obfuscated": (zero > 0) | (invisible > 0)}


CODE = ("is_code", "language", "confidence", "snippets")


def with_code(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """``df`` with is_code, language (the highest score, fence hints first), confidence and snippets of a column; blocks of white space alone do not count."""
    c, none = F.col(column), F.array().cast("array<string>")
    fence, ticked = F.lit(r"```(\w*)\n?([\s\S]*?)```"), F.contains(c, F.lit("`"))
    pairs = F.arrays_zip(F.transform(F.regexp_extract_all(c, fence, F.lit(1)), F.lower).alias("hint"), F.transform(F.regexp_extract_all(c, fence, F.lit(2)), strip).alias("body"))
    inline = F.filter(F.transform(F.regexp_extract_all(c, F.lit("`([^`]+)`"), F.lit(1)), strip), lambda x: F.length(x) > 10)
    blank = F.array().cast("array<struct<hint:string,body:string>>")
    df = df.withColumns({"_low": F.lower(c), "_blocks": F.when(ticked, F.filter(pairs, lambda x: x["body"] != "")).otherwise(blank), "_inline": F.when(ticked, inline).otherwise(none)})
    hits = lambda n, p: F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(pyre(p)), F.lit(1))))
    distinct = {n: F.when(holds(F.col("_low"), P.NEEDED[n]), hits(n, p)).otherwise(0) if n in P.NEEDED else hits(n, p) for n, p in P.LANGUAGES}
    often = lambda char, pattern, least: F.when(F.contains(c, F.lit(char)), F.when(F.regexp_count(c, F.lit(pattern)) >= least, 0.1).otherwise(0.0)).otherwise(0.0)
    df = df.withColumns({f"_s_{n}": F.round(F.lit(0.2) * x, 3) for n, x in distinct.items()} | {"_hints": F.filter(F.transform("_blocks", lambda x: x["hint"]), lambda x: x != ""), "_bonus": often(";", r";[\s\n]", 3) + often("{", r"\{[^}]*\}", 2)})
    named = [F.struct(F.col(f"_s_{n}").alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, n in enumerate(distinct)]
    own = lambda h: sum(F.when(h == n, F.col(f"_s_{n}")).otherwise(0.0) for n in distinct)
    hinted = F.transform(F.array_distinct("_hints"), lambda h: F.struct((F.lit(0.3) * F.size(F.filter("_hints", lambda x: x == h)) + own(h)).alias("s"), F.lit(1).alias("o"), h.alias("n")))
    df = df.withColumns({"_best": F.array_max(F.concat(F.array(*named), hinted)), "_snippets": F.slice(F.concat(F.transform("_blocks", lambda x: x["body"]), "_inline"), 1, 10)})
    df = df.withColumn("_confidence", F.round(F.least(F.lit(1.0), F.when(F.size("_blocks") > 0, 0.4).otherwise(0.0) + F.col("_best.s") + F.col("_bonus")), 3))
    is_code = (F.col("_confidence") >= 0.35) | (F.size("_snippets") > 0)
    made = {"is_code": is_code, "language": F.when(is_code & (F.col("_best.s") > 0), F.col("_best.n")), "confidence": F.col("_confidence"), "snippets": F.col("_snippets")}
    return df.withColumns({prefix + k: v for k, v in made.items()}).drop("_low", "_blocks", "_inline", "_hints", "_bonus", "_best", "_snippets", "_confidence", *[f"_s_{n}" for n in distinct])


def severity(signatures: Column, is_code: Column, upstream: Column) -> Column:
    n, u = F.size(signatures), F.coalesce(upstream, F.lit(0.0))
    return F.greatest(F.when(is_code, 1).otherwise(0), F.when(n >= 3, 2).when(n >= 1, 1).otherwise(0), F.when(u >= 0.5, 2).when(u >= 0.3, 1).otherwise(0))
