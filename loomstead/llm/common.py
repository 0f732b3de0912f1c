"""What the corpus operators share: the tables they read, the shared folder, and size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.storage import kept as written
from loomstead.storage import sized_join

__all__ = ["SPACE_CLASS", "commonest", "crc32_text", "documents", "fresh", "in_fold", "settled", "sized_join", "utf8_bytes", "written"]

#: Characters that part words.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text", "lang", "source", "n_chars")))


def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc32_text(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as the empty text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder. A null id counts as the empty text (crc32 0)."""
    return crc32_text(doc_id.cast("string")) % modulus == remainder


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of df has (names compare without case, as Spark does)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def settled(column: Column) -> Column:
    """The column, tied to a row number, which is never negative. Spark doesn't move filters below a column that counts rows,
    so it can't put this column's expression into others, where a lambda would compute it anew for each element."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def commonest(counts: DataFrame, count: str, most: int) -> tuple[DataFrame, int]:
    """The rows of counts whose count is above a threshold, and how many they are: at most `most`, ties at the edge all left
    out. The threshold comes from a histogram of 16 bands in each power of two, so the driver sees some hundred numbers and
    not rows of every partition, as a limited sort would send."""

    def above(rows: DataFrame, band: Column, room: int) -> tuple[int, int]:
        """The least band that fits in with all above it, and how many rows these are."""
        best, held = -1, 0
        for b, n in sorted(((r[0], r[1]) for r in rows.groupBy(band.alias("b")).agg(F.count("*")).collect()), reverse=True):
            if held + n > room:
                return best, held
            best, held = b, held + n
        return 0, held

    c = F.col(count)
    power = F.floor(F.log2(c.cast("double")) * 16).cast("int")  # 16 bands in each power of two: some hundred in all
    low, held = above(counts, power, most)
    if low == 0 and held:
        return counts, held
    return counts.filter(power >= low) if low > 0 else counts.limit(0), held
