"""Unit prices out of a model's answer, and their spread over the items of a contract.

An answer is one row, so its prices stay an array in that row from parsing to spreading:
no shuffle is needed and a row holds no more than its own text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: (characters removed, separators)
DIALECTS = {
    "main": ("[^0-9;.,-]", "[;,-]"),
    "computers": ("[^0-9;.]", ";"),
}


def price_clean(answer: Column, dialect: str = "main") -> Column:
    """Keep only digits, stops and the dialect's separators; the main one also merges stops."""
    kept = F.regexp_replace(answer, DIALECTS[dialect][0], "")
    return F.regexp_replace(kept, r"\.+", ".") if dialect == "main" else kept


def price_split(cleaned: Column, dialect: str = "main") -> Column:
    """Pieces in their order, blanks included."""
    return F.split(cleaned, DIALECTS[dialect][1], -1)


def price_cast(pieces: Column) -> Column:
    """Pieces to numbers; what is not a number is missing."""
    return F.transform(pieces, lambda p: p.try_cast("double"))


def parse_prices(answer: Column, dialect: str = "main") -> Column:
    return price_cast(price_split(price_clean(answer, dialect), dialect))


def count_nonmissing(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: v.isNotNull()))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def kept_prices(prices: Column) -> Column:
    """Equal prices once; missing ones only where there is nothing else."""
    none = F.array(F.lit(None).cast("double"))
    filled = F.filter(F.array_distinct(F.coalesce(prices, none)), lambda p: p.isNotNull())
    return _bound(filled, lambda f: F.when(F.size(f) > 0, f).otherwise(none))


def _mean(values: Column, count: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / count


def _layout(kept: Column, item_count: Column) -> tuple[Column, Column, Column]:
    """Number of items, whether each price is one item's, and the prices of a block."""
    total, m = F.size(kept), F.coalesce(item_count, F.lit(0)).cast("int")
    return m, (m > total) & kept[0].isNotNull(), F.when(m > 0, F.floor(total / m)).otherwise(0).cast("int")


def _block_mean(kept: Column, block: Column, g: Column) -> Column:
    return _mean(F.slice(kept, (g - 1) * block + 1, block), block)


def spread_prices(prices: Column, item_count: Column) -> Column:
    """``ARRAY<STRUCT<item_group, mean_unit_price>>`` for the items 1..item_count.

    k prices over m items: blocks of floor(k / m) in order, each block's mean being one
    item's price; surplus blocks fall away. With fewer prices than items each price is
    one item's. A contract of several items and no price gets no group at all.
    """
    def named(g: Column, price: Column) -> Column:
        return F.struct(g.cast("long").alias("item_group"), price.alias("mean_unit_price"))

    def groups(kept: Column) -> Column:
        m, one_each, block = _layout(kept, item_count)
        single = F.transform(kept, lambda p, i: named(i + 1, p))
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda g: named(g, _block_mean(kept, block, g)))
        return F.when(one_each, single).when(block > 0, blocks).otherwise(F.filter(single, lambda s: F.lit(False)))

    return _bound(kept_prices(prices), groups)


def item_prices(kept: Column, item_count: Column, item_group: Column) -> Column:
    """The price :func:`spread_prices` gives one item, in an array that is empty if the item is given none.

    ``kept`` comes from :func:`kept_prices`, once per answer; an item takes no more than its own block of it.
    """
    g = item_group.cast("int")

    def own(kept: Column) -> Column:
        m, one_each, block = _layout(kept, item_count)
        price = F.when(one_each, F.get(kept, g - 1)).otherwise(_block_mean(kept, block, g))
        given = F.when(one_each, g <= F.size(kept)).otherwise((block > 0) & (g <= m))
        return F.when(given, F.array(price)).otherwise(F.slice(kept, 1, 0))

    return _bound(F.coalesce(kept, F.array(F.lit(None).cast("double"))), own)
