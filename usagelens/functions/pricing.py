"""Price books, longest-prefix price lookup and exact integer cost.

Prices are whole thousandths of a dollar per million tokens, so tokens times
price is a whole number of nano-dollars.  Costs are kept as BIGINT
micro-dollars: sums do not depend on row order or on the engine.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from usagelens.runtime import materialize
from usagelens.schema import PRICES

# USD per million tokens (prefix, input, output, cache write, cache read).
DEFAULT_PRICES = (
    ("gpt-6-astra", "10", "50", "0", "1"),
    ("gpt-6.1-sol", "2", "10", "0", "0.10"),
    ("gpt-6-sol", "2", "10", "0", "0.20"),
    ("gpt-6-luna", "0.10", "0.50", "0", "0.01"),
    ("gpt-5.6-sol", "4", "20", "0", "0.40"),
    ("gpt-5.6-terra", "2", "12", "0", "0.20"),
    ("gpt-5.6-luna", "0.20", "1.20", "0", "0.02"),
    ("gpt-5.5", "5", "30", "0", "0.50"),
    ("gpt-5.3-codex", "1.75", "14", "0", "0.175"),
    ("gpt-5.2", "1.75", "14", "0", "0.175"),
    ("gpt-4o", "2.50", "10", "0", "1.25"),
    ("gpt-4.1", "2", "8", "0", "0.50"),
)

# Up to this many prefixes the lookup is one CASE expression inside the scan
# stage; a longer book is joined to the distinct models instead.
INLINE_PREFIXES = 48

_PARTS = ("in_milli", "out_milli", "cw_milli", "cr_milli")


def _milli(value) -> int:
    scaled = Decimal(str(value)) * 1000
    if scaled != scaled.to_integral_value():
        raise ValueError(f"price {value} has more than three decimals")
    if scaled < 0:
        raise ValueError(f"price {value} is negative")
    return int(scaled)


@dataclass(frozen=True)
class PriceBook:
    """Validated prices: tuples of (prefix, in, out, write, read) in thousandths."""

    rows: tuple

    def __post_init__(self):
        prefixes = [row[0] for row in self.rows]
        if len(set(prefixes)) != len(prefixes):
            raise ValueError("duplicate prefix")
        if any(not prefix for prefix in prefixes):
            raise ValueError("empty prefix")
        if any(price < 0 for row in self.rows for price in row[1:]):
            raise ValueError("negative price")

    @classmethod
    def from_dollars(cls, rows) -> "PriceBook":
        return cls(tuple((str(row[0]), *(_milli(price) for price in row[1:])) for row in rows))

    @classmethod
    def from_csv(cls, path: str) -> "PriceBook":
        """Read ``prefix,in,out,cw,cr`` in dollars, with a header line."""
        with open(path, newline="", encoding="utf-8") as handle:
            return cls.from_dollars([tuple(row) for row in list(csv.reader(handle))[1:] if row])

    @classmethod
    def from_dataframe(cls, prices: DataFrame) -> "PriceBook":
        """Fetch a price table, a hand-kept list of model prefixes."""
        return cls(tuple(tuple(row) for row in prices.select("prefix", *_PARTS).collect()))

    def dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), PRICES)


def default_prices() -> PriceBook:
    return PriceBook.from_dollars(DEFAULT_PRICES)


def _price_struct(row) -> Column:
    parts = [F.lit(value).cast("long").alias(name) for name, value in zip(_PARTS, row[1:])]
    return F.struct(F.lit(row[0]).alias("prefix"), *parts)


def price_expression(model, book: PriceBook) -> Column:
    """Struct of the longest matching prefix and its four prices, NULL if none matches."""
    name = F.col(model) if isinstance(model, str) else model
    chain = F
    for row in sorted(book.rows, key=lambda r: (-len(r[0]), r[0])):
        chain = chain.when(name.startswith(row[0]), _price_struct(row))
    if chain is F:
        return F.lit(None).cast("struct<prefix:string,in_milli:long,out_milli:long,cw_milli:long,cr_milli:long>")
    return chain


def attach_prices(rows: DataFrame, book: PriceBook, model: str = "model",
                  inline_prefixes: int = INLINE_PREFIXES) -> DataFrame:
    """Add ``price`` (struct, NULL without a match) and ``priced``.

    A short book becomes a CASE expression: no join, no shuffle.  A longer book
    is matched against the distinct models, cut to every prefix length that
    occurs, by an equi-join; the result is staged and joined back by model.  A
    stream joins each row with the prefixes of its model, as a static table.
    """
    if len(book.rows) <= inline_prefixes:
        priced = rows.withColumn("price", price_expression(model, book))
    elif rows.isStreaming:
        priced = _prices_of_stream(rows, book, model)
    else:
        spark = rows.sparkSession
        prices = book.dataframe(spark)
        lengths = sorted({len(row[0]) for row in book.rows})
        cuts = F.explode(F.array(*[
            F.when(F.length("_model") >= n, F.substring("_model", 1, n)) for n in lengths
        ]))
        best = (
            rows.select(F.col(model).alias("_model")).where(F.col("_model").isNotNull()).distinct()
            .select("_model", cuts.alias("prefix"))
            .join(prices, "prefix")
            .groupBy("_model")
            .agg(F.max_by(F.struct("prefix", *_PARTS), F.length("prefix")).alias("price"))
        )
        best = materialize(best)
        priced = rows.join(best, F.col(model) == F.col("_model"), "left").drop("_model")
    return priced.withColumn("priced", F.col("price").isNotNull())


def _prices_of_stream(rows: DataFrame, book: PriceBook, model: str) -> DataFrame:
    """One left join with a map of the book for each prefix length, the longest first."""
    prices = book.dataframe(rows.sparkSession)
    found = rows
    lengths = sorted({len(row[0]) for row in book.rows}, reverse=True)
    for n in lengths:
        part = prices.where(F.length("prefix") == n).select(
            F.col("prefix").alias(f"_cut_{n}"), F.struct("prefix", *_PARTS).alias(f"_price_{n}"))
        found = found.join(part, F.substring(model, 1, n) == F.col(f"_cut_{n}"), "left").drop(f"_cut_{n}")
    return found.withColumn("price", F.coalesce(*[f"_price_{n}" for n in lengths])).drop(
        *[f"_price_{n}" for n in lengths])


def _count(name: str) -> Column:
    """A count is zero where it is NULL."""
    return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))


def attach_cost(rows: DataFrame, book: PriceBook, target: str = "cost_micros") -> DataFrame:
    """Price usage rows: adds ``target`` and ``priced``.

    The cost is in micro-dollars, half a micro-dollar rounded up.  Cached input
    is part of the input and priced apart.  Negative output and cache-write counts
    are priced like others, so the cost can be negative; it is never NULL.  A row
    without a price costs nothing.
    """
    zero = F.lit(0).cast("long")
    whole = F.greatest(_count("input_tokens"), zero)
    priced = attach_prices(rows, book).withColumns({
        "_whole": whole,
        "_cached": F.least(F.greatest(_count("cache_read_tokens"), zero), whole),
        "_out": _count("output_tokens"),
        "_write": _count("cache_creation_tokens"),
    })
    price = F.col("price")
    nanos = (
        (F.col("_whole") - F.col("_cached")) * price["in_milli"]
        + F.col("_out") * price["out_milli"]
        + F.col("_write") * price["cw_milli"]
        + F.col("_cached") * price["cr_milli"]
    )
    half_up = F.coalesce(nanos, zero) + 500
    micros = F.call_function("div", half_up - F.pmod(half_up, F.lit(1000).cast("long")), F.lit(1000).cast("long"))
    return priced.withColumn(target, micros).drop("price", "_whole", "_cached", "_out", "_write")


def round_micros(micros, digits: int) -> Column:
    """Micro-dollars rounded half up to ``digits`` decimals, still in micro-dollars."""
    step = 10 ** (6 - digits)
    column = F.col(micros) if isinstance(micros, str) else micros
    return F.call_function("div", column + step // 2, F.lit(step).cast("long")) * step


def micros_of_dollars(dollars) -> Column:
    """Stored dollars (DOUBLE) as whole micro-dollars."""
    column = F.col(dollars) if isinstance(dollars, str) else dollars
    return F.round(column * 1_000_000).cast("long")
