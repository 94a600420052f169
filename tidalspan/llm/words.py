"""Words, shared by the text operators: maximal runs of anything but ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pattern of a word, and the letters that are folded.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words: bytes.split() parts at exactly the white space of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def documents(spark, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
