"""Resource quantities such as `100m` or `2Gi`."""

from pyspark.sql import functions as F

from fleetlens.schemas import QUANTITY_UNITS

_BINARY = QUANTITY_UNITS.index("Ki")
_DEFAULT = "k"


def parse_quantity(col):
    """struct(value DOUBLE, unit STRING). Text without a unit counts in `k`; bad numbers give null."""
    two, one = F.right(col, F.lit(2)), F.right(col, F.lit(1))
    unit = (
        F.when(two.isin(*QUANTITY_UNITS[_BINARY:]), two)
        .when(one.isin(*QUANTITY_UNITS[:_BINARY]), one)
        .otherwise(F.lit(_DEFAULT))
    )
    # the number is the text before the unit
    value = F.trim(F.call_function("substring_index", col, unit, F.lit(1))).try_cast("double")
    return F.when(col.isNotNull(), F.struct(value.alias("value"), unit.alias("unit")))


def _steps(unit, target, mode):
    """(multiply, divide, scale) from one unit to another."""
    i, j = QUANTITY_UNITS.index(unit), QUANTITY_UNITS.index(target)
    if mode == "exact":
        # n, u, m lie at 1000^-3..-1 and k at 1000^1: the family has no unit for 1000^0
        size = lambda o: 1000.0 ** (o - 3 if o < 3 else o - 2) if o < _BINARY else 1024.0 ** (o - _BINARY + 1)
        return size(i), size(j), 1.0
    from_k, from_ki = (lambda o: o - QUANTITY_UNITS.index(_DEFAULT)), (lambda o: o - _BINARY)
    if i < _BINARY and j < _BINARY:
        return 1.0, 1.0, 1000.0 ** (i - j)
    if i >= _BINARY and j >= _BINARY:
        return 1.0, 1.0, 1024.0 ** (i - j)
    if i < _BINARY:
        return 1.024, 1.0, 1000.0 ** (from_ki(j) - from_k(i))
    return 1.0, 1.024, 1000.0 ** (from_ki(i) - from_k(j))


def convert_quantity(quantity, unit, mode="reference"):
    """Value of a quantity in another unit (a name or a column).

    `reference` follows the rules of the system that is replaced: within one family it scales by the family's
    base, and between the families it goes through one k/Ki step of 1.024 (1.5 k is 1536 Mi).
    `exact` uses the true sizes of the decimal and binary units.

    The factors of all unit pairs are a constant array, so a row costs the places of its units and one element.
    """
    if mode not in ("reference", "exact"):
        raise ValueError("mode must be reference or exact")
    targets = [unit] if isinstance(unit, str) else QUANTITY_UNITS
    entries = []
    for u in QUANTITY_UNITS:
        for t in targets:
            multiply, divide, scale = _steps(u, t, mode)
            entries.append(f"named_struct('m', {multiply!r}D, 'd', {divide!r}D, 's', {scale!r}D)")
    units = F.array(*[F.lit(u) for u in QUANTITY_UNITS])
    place = F.array_position(units, quantity["unit"])
    if len(targets) > 1:
        target = F.array_position(units, unit)
        place = F.when(target > 0, (place - 1) * len(targets) + target)
    # an unknown unit has place 0 or less
    step = F.get(F.expr(f"array({', '.join(entries)})"), (place - 1).cast("int"))
    return quantity["value"] * step["m"] / step["d"] * step["s"]


def show_quantity(quantity):
    """Value and unit as one text."""
    return F.concat(quantity["value"].cast("string"), quantity["unit"])


def normalize_quantities(df, cols, unit, mode="reference"):
    """Replace quantity texts by numbers in one unit."""
    return df.withColumns({c: convert_quantity(parse_quantity(F.col(c)), unit, mode) for c in cols})
