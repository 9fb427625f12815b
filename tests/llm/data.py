"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with the names of outputs and of what the operators use inside.
CLASHES = ("score", "fingerprint", "component_id", "n_words", "rank", "a", "q", "t", "j", "phase", "slot", "id", "words",
           "mix_slot", "spans", "labels", "lang_pred", "toxic_score", "quality_score", "__f", "__toxic", "__lang", "doc")


def documents(spark: SparkSession, rows: list[tuple], clash: bool = False) -> DataFrame:
    """Rows of (doc_id, text[, source])."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
