"""Maps and lists as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(left: Column, right: Column) -> Column:
    """Both maps in one; where both have a key, the right one's value stands. A null map counts as empty."""
    held = F.coalesce(F.map_keys(right), F.array())
    rest = F.map_filter(left, lambda k, _: ~F.array_contains(held, k))
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.map_concat(rest, right))


def get_or(values: Column, key, default) -> Column:
    """The value of key in a map, or default where it has none."""
    return F.coalesce(F.try_element_at(values, F.lit(key)), F.lit(default))


def levelled(items: Column, n: Column) -> Column:
    """The first n items; a shorter list goes on with its last one. An empty list stays empty."""
    last = F.get(items, F.size(items) - 1)
    return F.when(F.size(items) > 0, F.slice(F.concat(items, F.array_repeat(last, n)), F.lit(1), n)).otherwise(items)


def joined(items: Column, separator: str = ", ") -> Column:
    """A list as text."""
    return F.concat_ws(separator, items)
