"""Aggregate functions by name, as Spark expressions.

Each entry makes a column from the target columns and options. Scope says where a function may stand: "scalar" (one row
from all rows), "hash" (with keys, under the name hash_<function>), or both.

Kept from the functions' usual meaning: nulls are skipped; an ungrouped aggregate of no rows is one row, a grouped one
none; variance and stddev divide by n - ddof with ddof 0; skew and kurtosis are biased, kurtosis in excess of 3; lists
keep nulls and distinct drops them. Spark's own ways stay by default and have a switch: NaN is the greatest value for
min and max (skip_nan=True leaves it out), an integer sum that overflows is an error (wrap=True wraps), and skew and
kurtosis of equal values are null. Order-dependent functions need `order_by`, since rows of a distributed table have no
order of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DecimalType, IntegerType, LongType, ShortType

Make = Callable[..., Column]
WORD = Decimal(1 << 64)


@dataclass(frozen=True)
class Function:
    """make(columns..., options...) gives the aggregate; result(type of the first column), if it is known, the type that
    the aggregate is cast to, or None."""

    make: Make
    targets: int = 1
    scalar: bool = True
    hash: bool = True
    result: Callable[[DataType], DataType | None] | None = None


def counted(c: Column, mode: str = "only_valid") -> Column:
    if mode == "only_valid":
        return F.count(c)
    if mode == "only_null":
        return F.count_if(c.isNull())
    if mode == "all":
        return F.count(F.lit(1))
    raise ValueError(f"mode {mode!r} is none of only_valid, only_null, all")


def counted_distinct(c: Column, mode: str = "only_valid") -> Column:
    null = F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))
    if mode == "only_valid":
        return F.count_distinct(c)
    if mode == "only_null":
        return null
    if mode == "all":
        return F.count_distinct(c) + null
    raise ValueError(f"mode {mode!r} is none of only_valid, only_null, all")


def enough(value: Column, c: Column, skip_nulls: bool, min_count: int) -> Column:
    """value, or null with too few non-null rows, or with any null row unless nulls are skipped."""
    if min_count > 1:
        value = F.when(F.count(c) >= min_count, value)
    if not skip_nulls:
        value = F.when(F.count(F.lit(1)) == F.count(c), value)
    return value


def summed(c: Column, skip_nulls: bool = True, min_count: int = 1, wrap: bool = False) -> Column:
    if wrap:
        total = F.sum(c.cast("decimal(38,0)"))
        low = F.pmod(total, F.lit(WORD))
        value = F.when(low >= F.lit(WORD / 2), low - F.lit(WORD)).otherwise(low).cast("long")
    else:
        value = F.sum(c)
    value = enough(value, c, skip_nulls, min_count)
    return F.coalesce(value, F.lit(0)) if min_count == 0 else value


def mean(c: Column, skip_nulls: bool = True, min_count: int = 1) -> Column:
    return enough(F.avg(c), c, skip_nulls, min_count)


def primes_beyond(limit: int) -> list[int]:
    """The first primes whose product is greater than limit."""
    found, whole, n = [], 1, 2
    while whole <= limit:
        if all(n % p for p in found):
            found.append(n)
            whole *= n
        n += 1
    return found


def powers_of_root(p: int) -> list[int]:
    """The powers 0, 1, ..., p - 2 of the least number whose powers are all residues of the prime p but 0."""
    for g in range(1, p):
        powers = [pow(g, k, p) for k in range(p - 1)]
        if len(set(powers)) == p - 1:
            return powers
    raise ValueError(f"{p} is no prime")


def whole_product(c: Column) -> Column:
    """The exact product of integers, by partial sums alone: for each of some primes, factors become exponents of one
    residue, whose sum gives the product's residue; the residues together give the product. A product beyond 64 bits is
    an error."""
    c = c.cast("long")
    primes = primes_beyond(1 << 64)
    whole = 1
    for p in primes:
        whole *= p
    number = lambda n: F.lit(Decimal(n)).cast("decimal(38,0)")
    total = number(0)
    for p in primes:
        powers = powers_of_root(p)
        exponents = F.array(*[F.lit(powers.index(r) if r else None).cast("int") for r in range(p)])
        exponent = F.pmod(F.coalesce(F.sum(F.get(exponents, F.pmod(c, F.lit(p)).cast("int"))), F.lit(0)), F.lit(p - 1)).cast("int")
        residue = F.when(F.count_if(F.pmod(c, F.lit(p)) == 0) > 0, F.lit(0)).otherwise(F.get(F.array(*map(F.lit, powers)), exponent))
        total = (total + number(whole // p * pow(whole // p, -1, p)) * residue.cast("decimal(3,0)")).cast("decimal(38,0)")
    low = F.pmod(total, number(whole)).cast("decimal(38,0)")
    low = F.when(low > number(whole // 2), (low - number(whole)).cast("decimal(38,0)")).otherwise(low)
    # The residues hold numbers up to whole / 2, about 1.6e19; what may be beyond is told by the product as double.
    size = F.abs(F.product(F.when(c != 0, c)))
    value = F.when(F.count_if(c == 0) > 0, F.lit(0).cast("long")).when(size > 1.2e19, F.raise_error(F.lit("the product is beyond 64 bits")).cast("long")).otherwise(low.cast("long"))
    return F.when(F.count(c) > 0, value)


def product(c: Column, skip_nulls: bool = True, min_count: int = 1, exact: bool = False) -> Column:
    """The product as double; exact=True, the default for integer columns, multiplies integers as a long."""
    return enough(whole_product(c) if exact else F.product(c), c, skip_nulls, min_count)


def extreme(function: Callable[[Column], Column]) -> Make:
    def make(c: Column, skip_nulls: bool = True, min_count: int = 1, skip_nan: bool = False) -> Column:
        return enough(function(F.when(~F.isnan(c), c) if skip_nan else c), c, skip_nulls, min_count)

    return make


def min_max(c: Column, **options) -> Column:
    return F.struct(extreme(F.min)(c, **options).alias("min"), extreme(F.max)(c, **options).alias("max"))


def any_of(c: Column, skip_nulls: bool = True, min_count: int = 1) -> Column:
    # Without skipping, a true value decides; only then does a null make the answer unknown.
    value = F.bool_or(c)
    return value if skip_nulls and min_count <= 1 else enough(value, c, True, min_count) if skip_nulls else F.when(value, value).otherwise(enough(value, c, False, min_count))


def all_of(c: Column, skip_nulls: bool = True, min_count: int = 1) -> Column:
    value = F.bool_and(c)
    return value if skip_nulls and min_count <= 1 else enough(value, c, True, min_count) if skip_nulls else F.when(~value, value).otherwise(enough(value, c, False, min_count))


def spread(population: Callable, sample: Callable, root: bool) -> Make:
    def make(c: Column, ddof: int = 0, skip_nulls: bool = True, min_count: int = 0) -> Column:
        if ddof == 0:
            value = population(c)
        elif ddof == 1:
            value = sample(c)
        else:
            n = F.count(c)
            value = F.when(n > ddof, F.var_pop(c) * n / (n - ddof))
            value = F.sqrt(value) if root else value
        return enough(value, c, skip_nulls, min_count)

    return make


def median(c: Column, accuracy: int = 10000, exact: bool = False) -> Column:
    return F.median(c) if exact else F.percentile_approx(c, 0.5, accuracy).cast("double")


def quantiles(c: Column, q: float | tuple[float, ...] = 0.5, accuracy: int = 10000, exact: bool = False) -> Column:
    q = [q] if isinstance(q, float) else list(q)
    return F.percentile(c, q) if exact else F.transform(F.percentile_approx(c, q, accuracy), lambda x: x.cast("double"))


def ordered(order_by: str | None, name: str) -> Column:
    if order_by is None:
        raise ValueError(f"{name} depends on the order of rows; give order_by")
    return F.col(order_by)


def first(c: Column, order_by: str | None = None, skip_nulls: bool = True) -> Column:
    order = ordered(order_by, "first")
    return F.min_by(c, F.when(c.isNotNull(), order) if skip_nulls else order)


def last(c: Column, order_by: str | None = None, skip_nulls: bool = True) -> Column:
    order = ordered(order_by, "last")
    return F.max_by(c, F.when(c.isNotNull(), order) if skip_nulls else order)


def first_last(c: Column, **options) -> Column:
    return F.struct(first(c, **options).alias("first"), last(c, **options).alias("last"))


def index(c: Column, value=None, position: str | None = None) -> Column:
    """The least position (a column of 0, 1, ... that the caller gives) where c equals value; -1 if none does."""
    return F.coalesce(F.min(F.when(c == F.lit(value), ordered(position, "index"))), F.lit(-1)).cast("long")


def pivot_wider(key: Column, value: Column, key_names: tuple[str, ...] = ()) -> Column:
    """A struct with a field for each name: the one value whose key it is, or null. Several values that aren't null for
    one key are an error."""
    if not key_names:
        raise ValueError("pivot_wider needs key_names")

    def field(name):
        mine = F.when(key == F.lit(name), value)
        several = F.raise_error(F.lit(f"more than one value that isn't null for the pivot key {name!r}"))
        return F.when(F.count(mine) <= 1, F.max(mine)).otherwise(several).alias(str(name))

    return F.struct(*map(field, key_names))


def distinct(c: Column, mode: str = "only_valid") -> Column:
    if mode == "only_valid":
        return F.array_sort(F.collect_set(c))
    if mode == "all":
        return F.transform(F.array_sort(F.collect_set(F.struct(c.alias("x")))), lambda s: s["x"])
    raise ValueError(f"mode {mode!r} is none of only_valid, all")


def listed(c: Column) -> Column:
    return F.transform(F.collect_list(F.struct(c.alias("x"))), lambda s: s["x"])


def wide_decimal(kind: DataType) -> DataType | None:
    return DecimalType(38, kind.scale) if isinstance(kind, DecimalType) else None


def same_decimal(kind: DataType) -> DataType | None:
    return kind if isinstance(kind, DecimalType) else None


REGISTRY: dict[str, Function] = {
    "count": Function(counted),
    "count_all": Function(lambda: F.count(F.lit(1)), targets=0),
    "count_distinct": Function(counted_distinct),
    "sum": Function(summed, result=wide_decimal),
    "mean": Function(mean, result=same_decimal),
    "product": Function(product),
    "min": Function(extreme(F.min)),
    "max": Function(extreme(F.max)),
    "min_max": Function(min_max),
    "any": Function(any_of),
    "all": Function(all_of),
    "variance": Function(spread(F.var_pop, F.var_samp, root=False)),
    "stddev": Function(spread(F.stddev_pop, F.stddev_samp, root=True)),
    "skew": Function(lambda c, skip_nulls=True, min_count=0: enough(F.skewness(c), c, skip_nulls, min_count)),
    "kurtosis": Function(lambda c, skip_nulls=True, min_count=0: enough(F.kurtosis(c), c, skip_nulls, min_count)),
    "approximate_median": Function(median),
    "tdigest": Function(quantiles),
    "first": Function(first),
    "last": Function(last),
    "first_last": Function(first_last),
    "index": Function(index, hash=False),
    "pivot_wider": Function(pivot_wider, targets=2),
    "distinct": Function(distinct, scalar=False),
    "list": Function(listed, scalar=False),
    "one": Function(lambda c: F.any_value(c), scalar=False),
}


def names(grouped: bool) -> list[str]:
    return [f"hash_{n}" if grouped else n for n, f in REGISTRY.items() if (f.hash if grouped else f.scalar)]


def register(name: str, make: Make, targets: int = 1, scalar: bool = True, hash: bool = True, replace: bool = False) -> None:
    """Adds an aggregate of one's own: make(columns..., options...) gives its column. With keys its name is hash_<name>."""
    if name.startswith("hash_") or not name:
        raise ValueError("the name is given without hash_")
    if name in REGISTRY and not replace:
        raise ValueError(f"there is an aggregate {name!r} already")
    REGISTRY[name] = Function(make, targets, scalar, hash)


def expression(name: str, columns: tuple[str, ...], grouped: bool, options: dict, types: tuple[DataType, ...] = ()) -> Column:
    """The column of a named aggregate; a ValueError says what is wrong with the name, the targets or the options.
    types: those of the target columns, where known."""
    plain = name.removeprefix("hash_")
    function = REGISTRY.get(plain)
    if function is None:
        raise ValueError(f"no aggregate function {name!r}; there are {', '.join(names(grouped))}")
    if grouped and not name.startswith("hash_"):
        raise ValueError(f"{name!r} is a scalar aggregate; with keys, use 'hash_{plain}'")
    if not grouped and name.startswith("hash_"):
        raise ValueError(f"{name!r} is a grouped aggregate and needs keys")
    if not (function.hash if grouped else function.scalar):
        raise ValueError(f"{name!r} is no {'grouped' if grouped else 'scalar'} aggregate")
    if len(columns) != function.targets:
        raise ValueError(f"{name!r} takes {function.targets} target columns, not {len(columns)}")
    if function.make is product and types and isinstance(types[0], (ByteType, ShortType, IntegerType, LongType)):
        options = {"exact": True, **options}
    try:
        value = function.make(*map(F.col, columns), **options)
    except TypeError as e:
        raise ValueError(f"options of {name!r}: {e}") from None
    kind = function.result(types[0]) if function.result and types else None
    return value.cast(kind) if kind is not None else value
