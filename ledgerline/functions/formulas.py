"""Business formulas as Column -> Column functions.

All stay JVM-side (no UDF) so they fuse into whole-stage codegen.

Rounding: the reference rounds decimal values HALF_UP to 2 places.  Doubles
are never rounded directly (binary doubles round differently per engine);
money stays ``decimal`` until the final cast, and ratios of integer-valued
quantities are rounded with exact integer arithmetic (:func:`half_up_ratio`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import ColumnOrName, col


def idiv(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Exact floor division of non-negative integral values, in decimal(38,0).

    Spark's decimal quotient is rounded HALF_UP to 6 places, so its floor can
    only be one too large; that case is corrected by the product test.
    """
    a = col(a).cast("decimal(38,0)")
    b = col(b).cast("decimal(38,0)")
    q0 = F.floor(a / b)
    return F.when(q0 * b > a, q0 - 1).otherwise(q0)


def half_up_ratio(num: ColumnOrName, den: ColumnOrName, scale: int = 2,
                  factor: int = 1) -> Column:
    """``round(num * factor / den, scale)`` HALF_UP (ties away from zero),
    exactly, for integral ``num`` and positive ``den``; 0.0 when ``den`` is 0."""
    num = col(num).cast("decimal(38,0)")
    den = col(den).cast("decimal(38,0)")
    unit = 10 ** scale
    q = idiv(F.abs(num) * F.lit(2 * factor * unit) + den, den * F.lit(2)).cast("double") / F.lit(float(unit))
    return F.when(den == 0, F.lit(0.0)).when(num < 0, -q).otherwise(q)


FINE = 8  # decimals at which measured (non-money) values enter exact sums


def fine_units(value: ColumnOrName) -> Column:
    """A measured value as an integral number of 1e-8 units (decimal(38,0))."""
    return (col(value).cast(f"decimal(26,{FINE})") * F.lit(10 ** FINE)).cast("decimal(38,0)")


def fine_sum(value: ColumnOrName, scale: int) -> Column:
    """Sum at full scale, rounded HALF_UP to ``scale`` places once, at the end."""
    return F.round(F.sum(col(value).cast(f"decimal(26,{FINE})")), scale).cast("double")


def fine_avg(value: ColumnOrName, scale: int) -> Column:
    """Average at full scale, rounded HALF_UP to ``scale`` places once, at the
    end; NULL for a group without values."""
    n = F.count(col(value)).cast("decimal(38,0)")
    return F.when(n > 0, half_up_ratio(F.sum(fine_units(value)), n * F.lit(10 ** (FINE - scale)), 0)
                  / F.lit(float(10 ** scale)))


def cents(amount: ColumnOrName) -> Column:
    """decimal(.,2) money -> integral number of cents (long)."""
    return (col(amount).cast("decimal(20,2)") * 100).cast("long")


# C1
def stage_conversion_rate(won: ColumnOrName, total: ColumnOrName) -> Column:
    """won / total * 100, 2 dp HALF_UP, 0.0 when total is 0."""
    return half_up_ratio(won, total, 2, factor=100)


# C2
def mask_pii(value: ColumnOrName) -> Column:
    """NULL, empty or <= 2 chars -> '***'; else first + '*' * (n-2) + last."""
    v = col(value)
    n = F.length(v)
    masked = F.concat(F.substring(v, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(v, -1, 1))
    return F.when(v.isNull() | (n <= 2), F.lit("***")).otherwise(masked)


# C3
def power_kw(voltage: ColumnOrName, current: ColumnOrName) -> Column:
    """round(V * A / 1000, 3) HALF_UP: the exact product in watts, rounded to
    whole watts, as kilowatts."""
    v = col(voltage).cast("decimal(18,8)")
    a = col(current).cast("decimal(18,8)")
    return F.round(v * a, 0).cast("double") / F.lit(1000.0)


# C4
def safe_temperature(temperature: ColumnOrName, limit: float = 85.0) -> Column:
    return col(temperature) < F.lit(limit)


# C5
def cac(spend_cents: ColumnOrName, acquisitions: ColumnOrName) -> Column:
    """spend / acquisitions, 2 dp HALF_UP; 0.0 when there are none.
    ``spend_cents`` is the spend in integral cents."""
    return half_up_ratio(spend_cents, acquisitions, 0) / F.lit(100.0)


# C6
def consent_filter(consent: ColumnOrName) -> Column:
    """Predicate: keep rows whose consent flag is true (NULL/missing dropped)."""
    return F.coalesce(col(consent), F.lit(False))


# C7
def inventory_turnover(cogs_cents: ColumnOrName, inventory_cents: ColumnOrName) -> Column:
    """cogs / inventory, 2 dp HALF_UP; 0.0 when inventory is 0."""
    return half_up_ratio(cogs_cents, inventory_cents, 2)


# C8
def dispatch_sla_met(actual_hours: ColumnOrName, target_hours: ColumnOrName) -> Column:
    return col(actual_hours) <= col(target_hours)


# C9
def convert_currency(amount: ColumnOrName, rate: ColumnOrName) -> Column:
    """amount * rate, 2 dp HALF_UP (decimal product), returned as double."""
    prod = col(amount).cast("decimal(18,2)") * col(rate).cast("decimal(10,4)")
    return F.round(prod, 2).cast("double")


RATE_UNITS = 10_000  # rates have four decimals


def rate_units(rate: ColumnOrName) -> Column:
    return (col(rate).cast("decimal(10,4)") * F.lit(RATE_UNITS)).cast("decimal(38,0)")


def to_usd(amount: ColumnOrName, currency: ColumnOrName, eur_to_currency: ColumnOrName,
           eur_to_usd: ColumnOrName) -> Column:
    """An amount in USD, 2 dp HALF_UP in one rounding: USD stays, EUR is
    multiplied by the EUR-to-USD rate, any other currency is divided by its EUR
    rate first.  NULL if a rate that it needs is missing."""
    c, money = col(currency), col(amount).cast("decimal(18,2)")
    amount_cents = (money * F.lit(100)).cast("decimal(38,0)")
    den = F.when(c == "EUR", F.lit(RATE_UNITS).cast("decimal(38,0)")).otherwise(rate_units(eur_to_currency))
    converted = half_up_ratio(amount_cents * rate_units(eur_to_usd), den, 0) / F.lit(100.0)
    return (F.when(c == "USD", money.cast("double"))
            .when(den.isNotNull() & (den > 0) & col(eur_to_usd).isNotNull(), converted))


# C10
def pct_variance(old: ColumnOrName, new: ColumnOrName) -> Column:
    """abs(new - old) / old (a fraction, not x100); 0.0 when old is 0."""
    o, n = col(old).cast("double"), col(new).cast("double")
    return F.when(o == 0, F.lit(0.0)).otherwise(F.abs(n - o) / o)
