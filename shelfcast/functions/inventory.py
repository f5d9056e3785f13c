"""Order-policy formulas as Catalyst columns."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value) -> Column:
    """Column arguments pass through, strings name columns, numbers become literals."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def floor_at_zero(value: Column) -> Column:
    """Null stays null and NaN becomes null, which ``greatest(0, x)`` would not do."""
    return F.when(F.isnan(value), None).when(value < 0, F.lit(0.0)).otherwise(value.cast("double"))


def ceil_units(value: Column) -> Column:
    return F.ceil(value).cast("bigint")


def economic_order_quantity(demand: Column, ordering_cost: Column, holding_cost: Column) -> Column:
    return ceil_units(F.sqrt(2 * demand * ordering_cost / holding_cost))


def safety_stock(z: Column, uncertainty: Column, lead_time: Column) -> Column:
    buffer = ceil_units(z * uncertainty * F.sqrt(lead_time.cast("double")))
    return F.when(lead_time > 0, buffer).otherwise(F.lit(0).cast("bigint"))


def batch_rounded(quantity: Column, batch_size: Column) -> Column:
    return ceil_units(quantity / batch_size) * batch_size.cast("bigint")


def normal_quantile(level) -> Column:
    """Inverse normal CDF of a service level given as a number or as a column."""
    if isinstance(level, (int, float)):
        if not 0.0 < level < 1.0:
            raise ValueError(f"a service level lies between 0 and 1, both excluded; got {level}")
        return F.lit(NormalDist().inv_cdf(level))
    return _normal_quantile_column(as_column(level))


# Rational approximations of the normal quantile, Wichura (1988), algorithm AS 241
# (PPND16). Numerator and denominator coefficients, constant term first.
_CENTRAL = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_NEAR_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_FAR_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(coefficients, x: Column) -> Column:
    def horner(terms):
        total = F.lit(terms[-1])
        for c in reversed(terms[:-1]):
            total = total * x + F.lit(c)
        return total

    return horner(coefficients[0]) / horner(coefficients[1])


def _normal_quantile_column(p: Column) -> Column:
    q = p - 0.5
    r = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1 - p)))
    tail = F.when(r <= 5, _ratio(_NEAR_TAIL, r - 1.6)).otherwise(_ratio(_FAR_TAIL, r - 5))
    central = q * _ratio(_CENTRAL, 0.180625 - q * q)
    signed = F.when(F.abs(q) <= 0.425, central).otherwise(F.when(q < 0, -tail).otherwise(tail))
    return F.when((p > 0) & (p < 1), signed)


def stocked_out(stock_level: Column) -> Column:
    return stock_level <= 0


def promotional_price(price: Column, discount: Column) -> Column:
    """Discounted price to two places, in decimal arithmetic so that half cents round up."""
    exact = price.cast("decimal(18,6)") * (1 - discount.cast("decimal(9,6)"))
    return F.round(exact, 2).cast("double")
