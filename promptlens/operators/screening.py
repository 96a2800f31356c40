"""The whole screen of a request: channels, rules, code, severity, the record that goes on, and its audit row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.functions import patterns as P
from promptlens.functions import screen as S
from promptlens.functions import text as T

Rule = tuple[str, str, bool]


@dataclass(frozen=True)
class RuleSet:
    """Ordered block and flag rules: (id, pattern, ignore case)."""

    block: list[Rule] = field(default_factory=lambda: list(P.BLOCK))
    flag: list[Rule] = field(default_factory=lambda: list(P.FLAG))

    def counts(self) -> dict[str, int]:
        return {"block": len(self.block), "flag": len(self.flag), "total": len(self.block) + len(self.flag)}

    @staticmethod
    def load(spark: SparkSession, path: str) -> RuleSet:
        """The built-in rules and those of the files, which follow them; a file's rule of a built-in id takes its place."""
        from promptlens.sources.files import read_rules

        found = read_rules(spark, path)
        own = {r[0] for rules in found.values() for r in rules}
        return RuleSet([r for r in BUILT_IN["block"] if r[0] not in own] + found["block"], [r for r in BUILT_IN["flag"] if r[0] not in own] + found["flag"])


#: The rules that no file brings.
BUILT_IN = {"block": P.BLOCK[:7], "flag": P.FLAG[:6]}


def channels(prepared: str = "prepared_input") -> tuple[Column, Column]:
    """The sanitised user and external text of a prepared record; the analysed text stands in where both are empty."""
    user = T.sanitize(F.col(f"{prepared}.text_embed_stub.normalized_user"))
    external = T.sanitize(F.array_join(F.coalesce(F.col(f"{prepared}.text_embed_stub.normalized_external"), F.array().cast("array<string>")), " "))
    fallback = T.sanitize(F.col(f"{prepared}.layer0.normalized_text"))
    return F.when((user == "") & (external == ""), fallback).otherwise(user), external


def metadata(prepared: str = "prepared_input") -> dict[str, Column]:
    """request_id (``unknown`` without one), session_id, timestamp, emoji_descriptions and the upstream score of a prepared record."""
    return {
        "request_id": F.coalesce(F.col(f"{prepared}.metadata.request_id"), F.lit("unknown")),
        "session_id": F.col(f"{prepared}.metadata.session_id"),
        "timestamp": F.col(f"{prepared}.metadata.timestamp"),
        "emoji_descriptions": F.coalesce(F.col(f"{prepared}.text_embed_stub.emoji_descriptions"), F.array().cast("array<string>")),
        "upstream_score": F.coalesce(F.col(f"{prepared}.layer0.heuristic_flags.suspicious_score"), F.lit(0.0)),
    }


def screen_prepared(df: DataFrame, rules: RuleSet | None = None, prepared: str = "prepared_input") -> DataFrame:
    """``screen`` of a column of prepared records."""
    user, external = channels(prepared)
    return screen(df.withColumns(metadata(prepared) | {"clean_user": user, "clean_external": external}), rules)


def screen(df: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """The screen of rows with request_id, clean_user, clean_external, emoji_descriptions and upstream_score.

    The user's text is checked by every block rule before the external one;
    a blocked row has its rule and matched text and nothing further.  Other
    rows have the sorted distinct flag signatures of both, what code they
    hold, and a severity from 0 to 2 (blocked: 2).
    """
    rules = rules or RuleSet()
    df = df.withColumns({"_low_user": S.folded(F.col("clean_user")), "_low_external": S.folded(F.col("clean_external"))})
    text = {x: F.col(f"clean_{x}") for x in ("user", "external")}
    low = {x: F.col(f"_low_{x}") for x in text}
    first = F.coalesce(*[S.block_rule(text[x], rules.block, low[x]) for x in text])
    df = df.withColumn("rule_id", first)
    df = df.withColumns({"blocked": F.col("rule_id").isNotNull(), "clean_text": T.strip(F.concat_ws(" ", "clean_user", "clean_external"))})
    matched = [F.when(F.col("rule_id") == i, F.coalesce(*[F.nullif(F.regexp_extract(text[x], P.pyre(p, ci), 0), F.lit("")) for x in text])) for i, p, ci in rules.block]
    none = F.array().cast("array<string>")
    flags = F.array_sort(F.array_distinct(F.concat(*[S.flag_signatures(text[x], rules.flag, low[x]) for x in text])))
    df = df.withColumns({"matched_text": F.coalesce(*matched), "threat_signatures": F.when(~F.col("blocked"), flags).otherwise(none)})
    df = S.with_code(S.with_code(df, "clean_user", "_u_"), "clean_external", "_e_")
    open_ = ~F.col("blocked")
    df = df.withColumns(
        {
            "reason": F.when(F.col("blocked"), F.concat(F.lit("Matched block pattern: "), "rule_id")),
            "is_code": open_ & (F.col("_u_is_code") | F.col("_e_is_code")),
            "detected_language": F.when(open_, F.coalesce("_u_language", "_e_language")),
            "confidence_code": F.when(open_, F.greatest("_u_confidence", "_e_confidence")).otherwise(0.0),
            "code_snippets": F.when(open_, F.slice(F.concat("_u_snippets", "_e_snippets"), 1, 10)).otherwise(none),
            "jailbreak_flag": F.lit(False),
        }
    )
    severity = F.when(F.col("blocked"), 2).otherwise(S.severity(F.col("threat_signatures"), F.col("is_code"), F.col("upstream_score")))
    df = df.withColumns({"severity": severity, "verdict": F.when(F.col("blocked"), "blocked").when(F.size("threat_signatures") > 0, "flagged").otherwise("passed")})
    return df.drop("_low_user", "_low_external", *[f"_{x}_{c}" for x in "ue" for c in S.CODE])


def audit(screened: DataFrame, key: str, forwarded: Column | None = None, keep_raw: bool = False) -> DataFrame:
    """One audit row of each screened request; the text is always signed, and kept only on request."""
    ids = F.when(F.col("blocked"), F.array(F.concat(F.lit("block:"), "rule_id"))).otherwise(F.col("threat_signatures"))
    return screened.select(
        F.col("request_id").cast("string").alias("request_id"),
        F.current_timestamp().alias("timestamp"),
        "blocked",
        F.to_json(ids).alias("matched_rule_ids"),
        "detected_language",
        F.col("severity").cast("int").alias("severity"),
        (F.lit(False) if forwarded is None else forwarded).alias("forwarded"),
        T.hmac_sha256(F.col("clean_text"), key).alias("raw_text_hmac"),
        F.when(F.lit(keep_raw), F.col("clean_text")).alias("raw_text"),
    )


AUDIT = "request_id STRING, timestamp TIMESTAMP, blocked BOOLEAN, matched_rule_ids STRING, detected_language STRING, severity INT, forwarded BOOLEAN, raw_text_hmac STRING, raw_text STRING"


def create_audit_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({AUDIT}) USING parquet")


def append_audit(screened: DataFrame, name: str, key: str, **how) -> None:
    audit(screened, key, **how).write.mode("append").insertInto(name)
