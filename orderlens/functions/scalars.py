"""Column functions: time differences, rounding, ratios, labels."""

from pyspark.sql import functions as F

DAY_SECONDS = 86400


def seconds_between(start, end):
    """Whole seconds from start to end, without any time-zone step."""
    return (end - start).cast("interval second").cast("bigint")


def days_floor(start, end):
    """Whole days rounded down: one hour early is day -1."""
    return F.floor(seconds_between(start, end) / F.lit(DAY_SECONDS)).cast("int")


def days_fraction(start, end):
    return seconds_between(start, end) / F.lit(float(DAY_SECONDS))


def days_truncated(start, end):
    """Fractional days cut to an integer toward zero."""
    return days_fraction(start, end).cast("int")


def year_month(ts):
    return F.substring(ts.cast("date").cast("string"), 1, 7)


def weekday_monday0(ts):
    return F.weekday(ts.cast("date")).cast("int")


def weekday_sunday0_text(ts):
    return (F.dayofweek(ts.cast("date")) - 1).cast("string")


def parse_timestamp(text):
    """Malformed text becomes null."""
    return text.try_cast("timestamp_ntz")


def half_even(x, places=0):
    """Round on the scaled double, exact halves to the even neighbour."""
    scale = F.lit(float(10**places))
    return F.rint(x * scale) / scale


def half_up(x, places=0):
    """Round on the scaled double, exact halves away from zero."""
    scale = F.lit(float(10**places))
    return F.signum(x) * F.floor(F.abs(x) * scale + F.lit(0.5)) / scale


def to_cents(money):
    """Money is whole cents: integer sums do not depend on the order of the rows."""
    return F.rint(money * 100).cast("bigint")


def sum_money(money):
    return F.sum(to_cents(money)) / F.lit(100.0)


def avg_money(money):
    return F.try_divide(F.sum(to_cents(money)), F.count(money)) / F.lit(100.0)


def ratio(a, b):
    """a / b, null when b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x, low=None, high=None):
    """Limit to [low, high]; null stays null."""
    out = x
    if low is not None:
        out = F.greatest(out, low)
    if high is not None:
        out = F.least(out, high)
    return F.when(x.isNotNull(), out)


def share_where(cond):
    """Share of rows where cond holds, over the rows where it is not null."""
    return F.avg(cond.cast("double"))


def share_in(cond, subset):
    """Share of the rows of a subset where cond holds."""
    return F.avg(F.when(subset, cond.cast("double")))


def effect_label(rho):
    size = F.abs(rho)
    return F.when(size < 0.1, "Small").when(size < 0.3, "Moderate").otherwise("Large")


def is_negative(score):
    """1 for scores 1 and 2, null for a missing score."""
    return F.when(score.isNotNull(), (score <= 2).cast("int"))


def wilson(k, n, z=1.96):
    """Wilson score interval of k out of n, in percent, as (low, high) columns."""
    k, n = k.cast("double"), n.cast("double")
    z2 = z * z
    p = F.try_divide(k, n)
    per_n = F.try_divide(F.lit(1.0), n)
    shrink = 1 + per_n * z2
    middle = (p + per_n * (z2 / 2)) / shrink
    reach = F.sqrt(p * (1 - p) * per_n + per_n * per_n * (z2 / 4)) * z / shrink
    low = F.when(p.isNotNull(), F.greatest(F.lit(0.0), middle - reach) * 100)
    high = F.when(p.isNotNull(), F.least(F.lit(1.0), middle + reach) * 100)
    return low, high
