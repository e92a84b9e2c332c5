"""Vectors that numeric operators share: which rows take part, and their one length."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str, *carry: str, multiple: int = 1) -> tuple[DataFrame, int]:
    """(id long, vector array<double>, the carried columns) of rows whose vector is whole, and the vectors' length.

    A vector is whole if it isn't null and no component is null or not finite. Vectors of different lengths can't be
    compared: the length that most whole vectors have counts (ties: the smaller), among the positive multiples of
    `multiple`; rows of other lengths are left out. Without such rows the length is 0 and the table empty.
    """
    vector = F.col(vector_column).cast("array<double>")
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above all
    size = F.size("vector")
    kept = rows.where(fine).select(F.col(id_column).cast("long").alias("id"), vector.alias("vector"), *carry).where((size > 0) & (size % multiple == 0))
    length = kept.groupBy(size.alias("size")).count().orderBy(F.desc("count"), "size").first()
    length = length["size"] if length else 0
    return kept.where(size == length), length
