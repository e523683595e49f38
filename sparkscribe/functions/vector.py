"""Vector expressions over array<float> or array<double>, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def bind(c: Column, f) -> Column:
    """f of a value that is computed once: a lambda's variable, not the expression, stands in f's result."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def l2_normalize(a: Column) -> Column:
    """Double components of unit length; a zero vector stays."""
    sized = lambda v: F.struct(v.alias("v"), norm(v).alias("n"))
    return bind(bind(a, sized), lambda s: F.transform(s["v"], lambda x: x.cast("double") / F.when(s["n"] == 0, 1.0).otherwise(s["n"])))


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """Deterministic unit vector: words of SHA-256 over 'counter:text', each as a number from -1 to 1, cut at dim, as floats."""
    digests = F.transform(F.sequence(F.lit(0), F.lit((dim + 7) // 8 - 1)), lambda i: F.sha2(F.concat(i.cast("string"), F.lit(":"), text), 256))
    words = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.conv(F.substring(digest, j * 8 + 1, F.lit(8)), 16, 10).cast("double"))
    raw = F.slice(F.flatten(F.transform(digests, words)), 1, dim)
    return F.transform(l2_normalize(F.transform(raw, lambda u: (u / 4294967296.0 * 2 - 1).cast("float"))), lambda x: x.cast("float"))


def uniform(*key) -> Column:
    """A number in [0, 1) from the SHA-256 of a key: the same in any order, partitioning or engine."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(*key) -> Column:
    """A standard normal number from a key (Box-Muller)."""
    u = F.greatest(uniform(*key, "u"), F.lit(1e-12))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * uniform(*key, "v"))
