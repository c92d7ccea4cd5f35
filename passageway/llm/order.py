"""Running sums over groups of any size, without ever bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which every (group, class) is dealt by a hash.
PARTS = 1024


def hash_part(*key: Column, parts: int = PARTS) -> Column:
    """A part number from an md5 of the key, alike on every engine that has md5."""
    text = F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in key))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % parts


def size_class(size: Column) -> Column:
    """Numbers that grow with the size: exact below 64, then 32 classes for each doubling."""
    bits = F.length(F.bin(size)).cast("int")
    shift = F.greatest(bits - 6, F.lit(0))
    return (bits * 64 + F.call_function("shiftright", size, shift)).cast("bigint")


def running_sum(df: DataFrame, group: list[str], amount: str, klass: str, part: str, order: list[str], out: str) -> DataFrame:
    """``out``: the sum of ``amount`` over the rows of the group up to and with this one, ordered by
    (``klass``, ``part``, ``order``).

    ``group`` columns must not be null. Three levels: sums of classes within the group, of parts within the class,
    of rows within the part. No window holds more than the classes of a group, the parts of a class, or the rows of
    one part (a 1,024th of the rows of a class), so a group with a third of all rows is no burden for one task.
    ``amount`` is an integer, so that sums do not depend on their order.
    """
    cell = [*group, klass, part]
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*cell).agg(F.sum(amount).alias("_cell_sum"))
    classes = cells.groupBy(*group, klass).agg(F.sum("_cell_sum").alias("_class_sum"))
    classes = classes.select(*group, klass, F.coalesce(F.sum("_class_sum").over(before(group, klass)), F.lit(0)).alias("_class_before"))
    parts = cells.select(*cell, F.coalesce(F.sum("_cell_sum").over(before([*group, klass], part)), F.lit(0)).alias("_part_before"))
    starts = parts.join(classes, [*group, klass]).select(*cell, (F.col("_class_before") + F.col("_part_before")).alias("_start"))
    within = F.sum(amount).over(Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_within", within).join(starts, cell).withColumn(out, F.col("_start") + F.col("_within")).drop("_start", "_within")
