"""Column expressions that the operators share. All stay in the JVM; none fails under ANSI mode on bad input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(col: str | Column) -> Column:
    """A column as double; what is no finite number becomes NULL, the only missing marker used here."""
    x = F.col(col) if isinstance(col, str) else col
    d = x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None).cast("double")).otherwise(d)


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b; NULL where b is 0 or the quotient is not finite."""
    return number(F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b))


def rounded(x: str | Column, scale: int = 10_000) -> Column:
    """Rounded so that engines which sum in another order agree: the half-way point is moved off natural ties."""
    x = F.col(x) if isinstance(x, str) else x
    return (F.floor(x * scale + 0.5003) / scale).cast("double")


def sigmoid(z: str | Column, clip: float = 35.0) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), z))))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clipped(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def clipped(x: Column, low, high) -> Column:
    """x within [low, high]; NULL stays NULL (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low))


def normalised_npi(col: str | Column) -> Column:
    """A provider number as text without a trailing .0; NULL unless it is ten digits."""
    x = F.col(col) if isinstance(col, str) else col
    text = F.trim(F.regexp_replace(F.trim(x.cast("string")), r"\.0$", ""))
    return F.when(text.rlike(r"^\d{10}$"), text)


def pseudonym(col: str | Column, salt: str) -> Column:
    """SHA-256 of salt:id; an empty salt is refused."""
    if not salt:
        raise ValueError("a pseudonym needs a salt")
    x = F.col(col) if isinstance(col, str) else col
    return F.sha2(F.concat(F.lit(f"{salt}:"), x.cast("string")), 256)


def hash_order(*cols: str | Column, seed: int | str = 0) -> Column:
    """60 bits of SHA-256 over seed and columns: an order that neither partitions nor engines change."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256), 1, 15), 16, 10).cast("bigint")


def hash_uniform(*cols: str | Column, seed: int | str = 0) -> Column:
    """A number in [0, 1) that depends on seed and columns only."""
    return hash_order(*cols, seed=seed) / float(1 << 60)


def row_mean(*cols: str) -> Column:
    """Mean of the columns that are not NULL; NULL if none is."""
    xs = F.array_compact(F.array(*cols))
    return F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs))


def row_median(*cols: str) -> Column:
    xs = F.array_sort(F.array_compact(F.array(*cols)))
    n = F.size(xs)
    return F.when(n > 0, (F.get(xs, F.floor((n - 1) / 2).cast("int")) + F.get(xs, F.floor(n / 2).cast("int"))) / 2)


def row_std(*cols: str) -> Column:
    """Sample deviation of the columns that are not NULL; NULL for fewer than two."""
    xs = F.array_compact(F.array(*cols))
    mean = row_mean(*cols)
    squares = F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return F.when(F.size(xs) > 1, F.sqrt(squares / (F.size(xs) - 1)))


def categories(col: str, values: list[str], prefix: str | None = None) -> dict[str, Column]:
    """A 0/1 column for each value; other and missing values give all zeros."""
    return {f"{prefix or col}_{v}": F.coalesce((F.col(col) == v).cast("double"), F.lit(0.0)) for v in sorted(values)}


def contains_flags(col: str, words: list[str], prefix: str) -> dict[str, Column]:
    """Whether each word occurs in the text (as a part of it, not as a token)."""
    return {f"{prefix}{w.lower().replace('-', '_')}": F.coalesce(F.col(col).contains(w).cast("double"), F.lit(0.0)) for w in words}


def bin_code(x: Column, edges: Column) -> Column:
    """How many edges lie below x; missing values fall into the last bin."""
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e < x))).otherwise(F.size(edges))


def fractional_days(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 86_400e6


# Numerators and denominators of the rational approximations of the normal quantile (algorithm AS 241, PPND16),
# constant term first: the middle, the near and the far tail.
NORMAL_QUANTILE = {
    "middle": (
        (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
        (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    ),
    "near": (
        (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    "far": (
        (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
}


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that stands in the expression once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution function, to 1e-16 in relative terms; NULL outside (0, 1)."""
    quotient = lambda part: lambda x: polynomial(NORMAL_QUANTILE[part][0], x) / polynomial(NORMAL_QUANTILE[part][1], x)
    beyond = lambda t: F.when(t <= 5, let(t - 1.6, quotient("near"))).otherwise(let(t - 5, quotient("far")))

    def inside(q: Column) -> Column:
        off = q - 0.5
        tails = F.signum(off) * let(F.sqrt(-F.log(F.least(q, 1 - q))), beyond)
        return F.when((q > 0) & (q < 1), F.when(F.abs(off) <= 0.425, off * let(0.180625 - off * off, quotient("middle"))).otherwise(tails))

    return let(p, inside)


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of a text column as 64 hexadecimal digits, in the JVM."""
    import hashlib

    block = (secret if len(secret) <= 64 else hashlib.sha256(secret).digest()).ljust(64, b"\0")
    padded = lambda by: F.lit(bytes(b ^ by for b in block))
    inner = F.sha2(F.concat(padded(0x36), message.cast("binary")), 256)
    return F.sha2(F.concat(padded(0x5C), F.unhex(inner)), 256)
