"""Normal distribution as arithmetic that Spark SQL and other SQL engines evaluate alike (neither has erf)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Numerator and denominator of Hart's rational approximation of the upper tail.
_NUM = (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911)
_DEN = (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184)
# Coefficients of Wichura's approximation of the quantile, centre, middle and tail.
_A = (3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
_C = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
_D = (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
_E = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def lit(v: float) -> str:
    """A double in both engines: a plain decimal point would make a decimal."""
    return f"{v:.17e}"


def _poly(x: str, coefficients) -> str:
    out = lit(coefficients[-1])
    for k in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {lit(k)})"
    return out


def cdf(x: str) -> str:
    """SQL text of the standard normal distribution function of the double expression ``x``."""
    z = f"abs({x})"
    near = f"exp(-({x}) * ({x}) / {lit(2)}) * {_poly(z, _NUM)} / {_poly(z, _DEN)}"
    far = f"exp(-({x}) * ({x}) / {lit(2)}) / (({z} + {lit(1)} / ({z} + {lit(2)} / ({z} + {lit(3)} / ({z} + {lit(4)} / ({z} + {lit(0.65)}))))) * {lit(2.506628274631)})"
    tail = f"(case when {z} > {lit(37)} then {lit(0)} when {z} < {lit(7.07106781186547)} then {near} else {far} end)"
    return f"(case when ({x}) > {lit(0)} then {lit(1)} - {tail} else {tail} end)"


def ppf(p: str) -> str:
    """SQL text of the standard normal quantile of the double expression ``p`` in (0, 1)."""
    q = _off_centre(p)
    return _quantile(q, _near_centre(q), _far_off(p, q))


def _off_centre(p: str) -> str:
    return f"(({p}) - {lit(0.5)})"


def _near_centre(q: str) -> str:
    return f"({lit(0.180625)} - {q} * {q})"


def _far_off(p: str, q: str) -> str:
    return f"sqrt(-ln(case when {q} < {lit(0)} then ({p}) else {lit(1)} - ({p}) end))"


def _quantile(q: str, r0: str, r1: str) -> str:
    centre = f"{q} * {_poly(r0, _A)} / {_poly(r0, _B)}"
    mid, tail = f"({r1} - {lit(1.6)})", f"({r1} - {lit(5)})"
    outer = f"(case when {r1} <= {lit(5)} then {_poly(mid, _C)} / {_poly(mid, _D)} else {_poly(tail, _E)} / {_poly(tail, _F)} end)"
    return f"(case when abs{q} <= {lit(0.425)} then {centre} when {q} < {lit(0)} then -{outer} else {outer} end)"


def with_ppf(df: DataFrame, p: str, name: str) -> DataFrame:
    """:func:`ppf` of column ``p`` by way of columns: its text writes its parts out dozens of times."""
    df = df.withColumn("_q", F.expr(_off_centre(p)))
    df = df.withColumns({"_r0": F.expr(_near_centre("(_q)")), "_r1": F.expr(_far_off(p, "(_q)"))})
    return df.withColumn(name, F.expr(_quantile("(_q)", "_r0", "_r1"))).drop("_q", "_r0", "_r1")
