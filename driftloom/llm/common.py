"""What the operators of this subpackage share: text columns, bounded blocks, memo tables, block counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one step inside a task holds as Python objects.
BLOCK_BYTES = 1 << 20


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone; a null text is empty.  Other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes in a text or binary column, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    low, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(low, i - low)
            low, held = i, 0
        held += int(n)
    if low < batch.num_rows:
        yield batch.slice(low)


class Memo(dict):
    """Values by key, made when first asked for.  Two generations bound what it holds."""

    def __init__(self, make: Callable | None, bound: int):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        """Between blocks: once full, what is held becomes the old generation."""
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()

    def lacking(self, keys) -> list:
        """Distinct keys of neither generation."""
        old = self.old
        return [k for k in set(keys) if k not in self and k not in old]


def parts(df: DataFrame, rows: int, per_part: int) -> int:
    """How many parts of about ``per_part`` rows: it follows the input, and uses the cluster when that is small."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-rows // per_part), min(least, max(1, rows // 256)))


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN and infinite components; false for null and empty ones."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Usable rows as (vec_id, vector of doubles).  Rows that repeat both id and vector count once; no id, no part."""
    v = F.col(vector_col).cast("array<double>")
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
        .where(F.col("vec_id").isNotNull() & finite(F.col("vector")))
        .dropDuplicates()
    )
