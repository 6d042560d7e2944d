"""Tail probabilities as SQL expressions over column names, for small frames of test results.

They run inside Spark, so a test result stays lazy up to its p-value. The ``log`` forms give natural
logarithms, so that tails far below the smallest double keep their digits.
"""

import math

from pyspark.sql import functions as F

SERIES_TERMS = 80
FRACTION_STEPS = 300
ROOT_TWO_PI = repr(math.sqrt(2 * math.pi)) + "D"
ROOT_PI = repr(math.sqrt(math.pi)) + "D"
LOG_ROOT_TWO_PI = repr(math.log(2 * math.pi) / 2) + "D"
# samples beyond this size have a t tail that a normal tail at a corrected place gives
LARGE = 100_000


def _upper(z):
    """Normal upper tail for z >= 0: a power series near zero, a continued fraction beyond."""
    density = f"(exp(-({z}) * ({z}) / 2) / {ROOT_TWO_PI})"
    series = f"""aggregate(sequence(1, {SERIES_TERMS}),
        named_struct('total', ({z}), 'term', ({z})),
        (s, j) -> named_struct(
            'total', s.total + s.term * ({z}) * ({z}) / (2 * j + 1),
            'term', s.term * ({z}) * ({z}) / (2 * j + 1)),
        s -> 0.5D - {density} * s.total)"""
    return f"(case when ({z}) < 3 then {series} else {density} / {_mills(z)} end)"


def _mills(z):
    """Normal density over upper tail for z >= 3, as a continued fraction."""
    return f"aggregate(sequence({SERIES_TERMS}, 1), ({z}), (s, j) -> ({z}) + j / s)"


def _normal_log_sf(z):
    far = f"(-({z}) * ({z}) / 2 - {LOG_ROOT_TWO_PI} - ln({_mills(z)}))"
    return f"(case when ({z}) >= 3 then {far} else ln({_normal_sf(f'({z})')}) end)"


def _normal_sf(z):
    return f"(case when {z} >= 0 then {_upper(z)} else 1 - {_upper(f'-({z})')} end)"


def normal_sf(z):
    """Upper tail of the standard normal distribution."""
    return F.expr(_normal_sf(f"double({z})"))


def normal_log_sf(z):
    """Logarithm of the upper tail of the standard normal distribution."""
    return F.expr(_normal_log_sf(f"double({z})"))


def chi2_sf(x, dof):
    """Upper tail of chi-square for a whole number of degrees of freedom: its finite sum."""
    return F.expr(_chi2_sf(f"double({x})", f"int({dof})"))


def _chi2_sf(x, dof):
    odd = f"({dof} % 2 = 1)"
    start = f"""(case when {odd} then 2 * exp(-{x} / 2) / {ROOT_TWO_PI} * sqrt({x})
        else exp(-{x} / 2) end)"""
    total = f"""aggregate(
        filter(sequence(1, greatest({dof}, 1)), j -> 2 * j <= {dof}),
        named_struct('total', 0D, 'term', {start}),
        (s, j) -> named_struct(
            'total', s.total + s.term,
            'term', s.term * {x} / (case when {odd} then 2 * j + 1 else 2 * j end)),
        s -> s.total)"""
    tail = f"2 * {_upper(f'sqrt({x})')}"
    return f"((case when {odd} then {tail} else 0D end) + {total})"


def chi2_log_sf(x, dof):
    """Logarithm of the upper tail of chi-square.

    Beyond the mean the terms of the sum fall from the last one back to the first, so they are taken relative
    to the last one.
    """
    x, dof = f"double({x})", f"int({dof})"
    odd, terms = f"({dof} % 2 = 1)", f"(({dof} - {dof} % 2) div 2)"
    # term j over term j - 1, for j from 2 on; the first is sqrt(x) (odd) or 1 (even)
    step = f"({x} / (case when {odd} then 2 * j - 1 else 2 * (j - 1) end))"
    later = f"filter(sequence(1, greatest({terms}, 1)), j -> j > 1 and j <= {terms})"
    last = f"((case when {odd} then ln({x}) / 2 else 0D end) + aggregate({later}, 0D, (s, j) -> s + ln({step})))"
    falling = f"""aggregate(reverse({later}), named_struct('total', 1D, 'term', 1D),
        (s, j) -> named_struct('total', s.total + s.term / {step}, 'term', s.term / {step}),
        s -> s.total)"""
    rest = f"(case when {odd} then exp(-{last}) / {_mills(f'sqrt({x})')} else 0D end)"
    front = f"(case when {odd} then ln(2D) - {LOG_ROOT_TWO_PI} else 0D end)"
    return F.expr(
        f"""case when {x} is null or {dof} < 1 then double(null)
            when {x} < greatest({dof}, 9) then ln({_chi2_sf(x, dof)})
            when {dof} = 1 then ln(2D) + {_normal_log_sf(f'sqrt({x})')}
            else -{x} / 2 + {front} + {last} + ln({falling} + {rest}) end"""
    )


def _gamma_step(a):
    """Gamma(a + 1/2) / Gamma(a): asymptotic series at a + 12, stepped back to a."""
    b = f"({a} + 12)"
    series = f"""sqrt({b}) * (1 - 1 / (8 * {b}) + 1 / (128 * {b} * {b})
        + 5 / (1024 * {b} * {b} * {b}) - 21 / (32768 * {b} * {b} * {b} * {b}))"""
    return f"""aggregate(sequence(0, 11), {series},
        (s, j) -> s * ({a} + j) / ({a} + j + 0.5D))"""


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function, forward recurrence."""
    even = f"(m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m)))"
    odd = f"(-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1)))"
    d1, c1 = f"(1 / (1 + {even} * s.d))", f"(1 + {even} / s.c)"
    d2, c2 = f"(1 / (1 + {odd} * {d1}))", f"(1 + {odd} / {c1})"
    return f"""aggregate(transform(sequence(1, {FRACTION_STEPS}), j -> double(j)),
        named_struct('c', 1D, 'd', 1 / (1 - ({a} + {b}) * {x} / ({a} + 1)),
            'h', 1 / (1 - ({a} + {b}) * {x} / ({a} + 1))),
        (s, m) -> named_struct('c', {c2}, 'd', {d2}, 'h', s.h * {c1} * {d1} * {c2} * {d2}),
        s -> s.h)"""


def correlation_p(rho, n):
    """Two-sided p-value of a correlation under the t distribution with n - 2 degrees of freedom."""
    rho, a = f"double({rho})", f"((double({n}) - 2) / 2)"
    square, rest = f"({rho} * {rho})", f"(1 - {rho} * {rho})"
    front = f"(exp({a} * log1p(-{square})) * abs({rho}) * {_gamma_step(a)} / {ROOT_PI})"
    return F.expr(
        f"""case when {rho} is null or {n} < 3 then double(null)
            when {square} >= 1 then 0D
            when {rest} < ({a} + 1) / ({a} + 2.5D)
                then {front} * {_beta_fraction(a, "0.5D", rest)} / {a}
            else 1 - {front} * {_beta_fraction("0.5D", a, square)} * 2 end"""
    )


def _large_sample_place(rho, n):
    """Normal deviate with the tail of the t statistic of a correlation in a large sample."""
    a = f"(double({n}) - 2.5D)"
    b = f"(48 * {a} * {a})"
    z = f"sqrt(-{a} * log1p(-{rho} * {rho}))"
    return f"aggregate(array(0D), {z}, (z, i) -> z + (z * z * z + 3 * z) / {b})"


def correlation_log_p(rho, n):
    """Logarithm of the two-sided p-value of a correlation (null below three pairs)."""
    a = f"((double({n}) - 2) / 2)"
    square, rest = "(double({0}) * double({0}))".format(rho), "(1 - double({0}) * double({0}))".format(rho)
    rho = f"double({rho})"
    front = f"({a} * log1p(-{square}) + ln(abs({rho})) + ln({_gamma_step(a)}) - ln({ROOT_PI}))"
    near = f"ln({_beta_fraction(a, '0.5D', rest)}) - ln({a})"
    far_from_one = f"log1p(-exp({front}) * {_beta_fraction('0.5D', a, square)} * 2)"
    return F.expr(
        f"""case when {rho} is null or {n} < 3 then double(null)
            when {square} >= 1 then -double('Infinity')
            when {rho} = 0 then 0D
            when {n} > {LARGE} then least(0D, ln(2D) + {_normal_log_sf(_large_sample_place(rho, n))})
            when {rest} < ({a} + 1) / ({a} + 2.5D) then {front} + {near}
            else {far_from_one} end"""
    )


def neg_log10(log_p):
    """-log10(p) from the logarithm of p; never below zero."""
    return F.greatest(F.lit(0.0), -log_p / math.log(10.0))
