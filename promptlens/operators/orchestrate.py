"""The staged run over requests: screen, preparation, images, final score; a stage's outcome is data, and a rejected request stops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.functions import screen as S
from promptlens.functions import text as T
from promptlens.functions import unicode as U
from promptlens.operators import screening

CLEAN, REJECTED, ERROR, SKIPPED = "clean", "rejected", "error", "skipped"


@dataclass(frozen=True)
class Stages:
    """Which stages run, whether a rejected request stops, and whether one with an error goes on."""

    screen: bool = True
    prepare: bool = True
    images: bool = True
    stop_on_reject: bool = True
    fail_open: bool = True
    stego_limit: float = 0.5

    def run(self, df: DataFrame, key: str) -> DataFrame:
        """Rows with request_id, text, external_chunks and image_scores (arrays) through all stages.

        A text that is null is the error of the first stage.  A stage that is
        off, or that a stopped request does not reach, is ``skipped``.
        """
        df = df.withColumns({"external_chunks": F.coalesce("external_chunks", F.array().cast("array<string>")), "image_scores": F.coalesce("image_scores", F.array().cast("array<double>")), "_open": F.lit(True)})
        return self.final(self.imaged(self.prepared(self.screened(df), key)))

    def screened(self, df: DataFrame) -> DataFrame:
        if not self.screen:
            return df.withColumns({"layer0_status": F.lit(SKIPPED), "rule_id": F.lit(None).cast("string"), "layer0_score": F.lit(0.0)})
        df = df.withColumns({"_clean": T.sanitize(F.col("text")), "_other": T.sanitize(F.array_join("external_chunks", " "))})
        rule = F.coalesce(S.block_rule(F.col("_clean")), S.block_rule(F.col("_other")))
        df = df.withColumn("rule_id", rule)
        status = F.when(F.col("text").isNull(), ERROR).when(F.col("rule_id").isNotNull(), REJECTED).otherwise(CLEAN)
        df = df.withColumns({"layer0_status": status, "layer0_score": F.when(F.col("rule_id").isNotNull(), 1.0).otherwise(0.0)})
        stopped = (F.lit(self.stop_on_reject) & (F.col("layer0_status") == REJECTED)) | (F.lit(not self.fail_open) & (F.col("layer0_status") == ERROR))
        return df.withColumn("_open", ~stopped).drop("_clean", "_other")

    def prepared(self, df: DataFrame, key: str) -> DataFrame:
        df = df.withColumn("clean_text", T.normalize(F.col("text")))
        df = S.with_heuristics(U.with_unicode(df, "text"), "clean_text").withColumn("_emojis", T.emojis(F.coalesce("text", F.lit(""))))
        on = F.col("_open") & F.lit(self.prepare)
        chunks = F.size("external_chunks")
        result = F.struct("zero_width_count", "invisible_count", "unicode_obfuscation_flag", "has_base64", "has_delimiters", "suspicious_score", "detected_patterns", F.size("_emojis").alias("emoji_count"), T.emoji_descriptions(F.col("_emojis")).alias("emoji_descriptions"), T.count_characters(F.col("text")).alias("original_char_count"), F.length("clean_text").alias("normalized_char_count"), chunks.alias("hmacs_generated"))
        df = df.withColumn("input_prep", F.when(on, result))
        df = df.withColumns({"input_prep_status": F.when(on, CLEAN).otherwise(SKIPPED), "clean_text": F.when(on, F.col("clean_text")), "hmacs": F.when(on, T.sign_all(F.col("external_chunks"), key)), "prep_score": F.when(on, F.col("suspicious_score")).otherwise(0.0)})
        return df.drop("_emojis", "normalized_text", "zero_width_removed", "special_char_mask", *U.ANALYSIS, *S.HEURISTICS)

    def imaged(self, df: DataFrame) -> DataFrame:
        on = F.col("_open") & F.lit(self.images) & (F.size("image_scores") > 0)
        score = F.when(on, F.array_max("image_scores")).otherwise(0.0)
        df = df.withColumns({"image_status": F.when(on, CLEAN).otherwise(SKIPPED), "images_processed": F.when(on, F.size("image_scores")).otherwise(0), "image_score": score})
        return df.withColumn("stego_detected", F.col("image_score") > self.stego_limit)

    def final(self, df: DataFrame) -> DataFrame:
        """overall_score is the greatest of the stages' scores; status the first error, then rejection, else clean."""
        errors = F.when(F.col("layer0_status") == ERROR, F.array(F.struct(F.lit("layer0").alias("layer"), F.lit("no text").alias("error")))).otherwise(F.array().cast("array<struct<layer:string,error:string>>"))
        status = F.when(F.col("layer0_status") == ERROR, F.lit(CLEAN if self.fail_open else ERROR)).when(F.col("layer0_status") == REJECTED, REJECTED).otherwise(CLEAN)
        return df.withColumns({"errors": errors, "overall_score": F.greatest("layer0_score", "prep_score", "image_score"), "status": status}).drop("_open")


def rules_health(rules: screening.RuleSet | None = None) -> dict[str, int]:
    return (rules or screening.RuleSet()).counts()
