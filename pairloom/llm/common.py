"""Shared helpers: the cluster's shared folder, written intermediate tables, and word syntax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import remove, shared_path, shared_root, written

__all__ = ["BREAK_CHARS", "LOWER", "UPPER", "WORD_BREAK", "ascii_lower", "folder_of", "own_buffers", "remove", "shared_path", "shared_root", "table", "words", "written"]

#: Fixed values of the contracts: a word is a run of characters other than space and \t \n \v \f \r.
WORD_BREAK = r"[\x20\x09-\x0D]+"
BREAK_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def words(col):
    """The words of a text; none for null, empty and blank texts."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), WORD_BREAK), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_buffers(texts):
    """An Arrow text column without nulls (empty instead) and not a view into a longer one, which some of Arrow's text
    kernels misread."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(range(len(texts)), pa.int64()))


def folder_of(block, folders: int):
    """The folder of a table in which a block's rows lie; blocks are numbered by partition and place, (partition << 24) +
    place, and consecutive ones go to different folders. Takes a number or a column."""
    if isinstance(block, Column):
        place = F.pmod(block, F.lit(1 << 24))
        return F.pmod(place + 31 * ((block - place) / (1 << 24)).cast("long"), F.lit(folders)).cast("int")
    return (block % (1 << 24) + 31 * (block >> 24)) % folders
