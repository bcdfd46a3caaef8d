"""What the operators share: picking columns, word bytes, and places that survive an executor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import dropped, shared_dir, written  # noqa: F401  what the operators write on the way

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Words of letters, digits and everything beyond ASCII.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
SPACED = r"[^\x20\x09-\x0D]+"

#: For bytes.translate: A-Z lower-cased, what separates ALNUM words turned into a space.
ALNUM_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: The same for SPACED words.
SPACED_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased ALNUM words of a UTF-8 text; all separators are ASCII, so bytes do."""
    return text.translate(ALNUM_TABLE).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Lower-cased SPACED words of a UTF-8 text."""
    return text.translate(SPACED_TABLE).split() if text else []


def lower_for_ascii(c: Column) -> Column:
    """A text whose words compare with lower-case ASCII words as if only A-Z were lower-cased.

    `lower` is several times faster than `translate`, which looks up every character. It changes other letters too, but
    into ASCII only the Kelvin sign; a text with one goes the slow way.
    """
    return F.when(c.contains("\u212a"), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column is called so (Spark compares without case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
