"""Normal distribution function and quantile.

Spark SQL has no erf. Both functions are written once as SQL text over doubles, so the same
text runs in Spark and in an ANSI SQL engine that checks it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail (highest power first).
HART_NUM = [3.52624965998911e-02, 7.00383064443688e-01, 6.37396220353165e+00,
            3.3912866078383e+01, 1.12079291497871e+02, 2.21213596169931e+02,
            2.20206867912376e+02]
HART_DEN = [8.83883476483184e-02, 1.75566716318264e+00, 1.6064177579207e+01,
            8.67807322029461e+01, 2.96564248779674e+02, 6.37333633378831e+02,
            7.93826512519948e+02, 4.40413735824752e+02]

# Wichura's AS 241 (PPND16) coefficients, lowest power first.
PPF_MID_NUM = [3.3871328727963666080e+0, 1.3314166789178437745e+2, 1.9715909503065514427e+3,
               1.3731693765509461125e+4, 4.5921953931549871457e+4, 6.7265770927008700853e+4,
               3.3430575583588128105e+4, 2.5090809287301226727e+3]
PPF_MID_DEN = [1.0e+0, 4.2313330701600911252e+1, 6.8718700749205790830e+2,
               5.3941960214247511077e+3, 2.1213794301586595867e+4, 3.9307895800092710610e+4,
               2.8729085735721942674e+4, 5.2264952788528545610e+3]
PPF_NEAR_NUM = [1.42343711074968357734e+0, 4.63033784615654529590e+0, 5.76949722146069140550e+0,
                3.64784832476320460504e+0, 1.27045825245236838258e+0, 2.41780725177450611770e-1,
                2.27238449892691845833e-2, 7.74545014278341407640e-4]
PPF_NEAR_DEN = [1.0e+0, 2.05319162663775882187e+0, 1.67638483018380384940e+0,
                6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2,
                5.47593808499534494600e-4, 1.05075007164441684324e-9]
PPF_FAR_NUM = [6.65790464350110377720e+0, 5.46378491116411436990e+0, 1.78482653991729133580e+0,
               2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
               2.71155556874348757815e-5, 2.01033439929228813265e-7]
PPF_FAR_DEN = [1.0e+0, 5.99832206555887937690e-1, 1.36929880922735805310e-1,
               1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5,
               1.42151175831644588870e-7, 2.04426310338993978564e-15]


def _lit(v: float) -> str:
    return f"{v:.20e}"


def _horner(coeffs: list[float], x: str) -> str:
    """Nested polynomial, highest power first."""
    text = _lit(coeffs[0])
    for c in coeffs[1:]:
        text = f"({text} * {x} + {_lit(c)})"
    return text


def norm_cdf_sql(x: str) -> str:
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2e0) * {_horner(HART_NUM, a)} / {_horner(HART_DEN, a)}"
    frac = f"({a} + 0.65e0)"
    for k in (4, 3, 2, 1):
        frac = f"({a} + {k}e0 / {frac})"
    far = f"exp(-{a} * {a} / 2e0) / {frac} / 2.506628274631e0"
    tail = (f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {near} "
            f"ELSE {far} END)")
    return f"(CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) > 0e0 THEN 1e0 - {tail} ELSE {tail} END)"


def norm_ppf_sql(p: str) -> str:
    """NULL outside (0, 1)."""
    q = f"(({p}) - 5e-1)"
    r0 = f"(0.180625e0 - {q} * {q})"
    mid = (f"{q} * {_horner(PPF_MID_NUM[::-1], r0)} / {_horner(PPF_MID_DEN[::-1], r0)}")
    r = f"sqrt(-ln(CASE WHEN {q} < 0e0 THEN ({p}) ELSE 1e0 - ({p}) END))"
    r1, r2 = f"({r} - 1.6e0)", f"({r} - 5e0)"
    near = f"{_horner(PPF_NEAR_NUM[::-1], r1)} / {_horner(PPF_NEAR_DEN[::-1], r1)}"
    far = f"{_horner(PPF_FAR_NUM[::-1], r2)} / {_horner(PPF_FAR_DEN[::-1], r2)}"
    return (f"(CASE WHEN ({p}) <= 0e0 OR ({p}) >= 1e0 THEN NULL "
            f"WHEN abs({q}) <= 4.25e-1 THEN {mid} "
            f"ELSE (CASE WHEN {q} < 0e0 THEN -1e0 ELSE 1e0 END) * "
            f"(CASE WHEN {r} <= 5e0 THEN {near} ELSE {far} END) END)")


def norm_cdf(column: str) -> Column:
    return F.expr(norm_cdf_sql(column))


def norm_ppf(column: str) -> Column:
    return F.expr(norm_ppf_sql(column))
