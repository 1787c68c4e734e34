"""Random numbers computed from a key, so a recomputed task returns the same draw.

`md5_*` give the same bits in Spark, plain SQL engines and Python and serve value checks.
`hash_uniform` is the fast one for sampling. Neither is secret, so neither may protect a
release: that is what `operators.privacy.release_gaussian` is for.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS_52 = 4503599627370496.0  # 2**52
_TWO_PI = 2.0 * math.pi


def _key(salt: str, cols) -> Column:
    return F.concat_ws(":", F.lit(salt), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def md5_uniform(salt: str, *cols) -> Column:
    """Uniform in the open interval (0, 1) from the first 52 bits of an md5."""
    digits = F.conv(F.substring(F.md5(_key(salt, cols)), 1, 13), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(_BITS_52)


def md5_normal(salt: str, *cols) -> Column:
    """Standard normal by Box-Muller over two keyed uniforms."""
    u, v = md5_uniform(salt + "/r", *cols), md5_uniform(salt + "/a", *cols)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(_TWO_PI) * v)


def md5_gumbel(salt: str, *cols) -> Column:
    """Standard Gumbel, for arg-max sampling."""
    return -F.ln(-F.ln(md5_uniform(salt, *cols)))


def hash_uniform(salt: str, *cols) -> Column:
    """Fast uniform in (0, 1); stays inside whole-stage codegen."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return (F.shiftrightunsigned(F.xxhash64(F.lit(salt), *parts), 12) + F.lit(0.5)) / F.lit(_BITS_52)


def py_uniform(salt: str, *parts) -> float:
    """Driver-side twin of `md5_uniform`."""
    text = ":".join([salt, *[str(p) for p in parts]])
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / _BITS_52


def py_gumbel(salt: str, *parts) -> float:
    """Driver-side twin of `md5_gumbel`."""
    return -math.log(-math.log(py_uniform(salt, *parts)))


def sql_uniform(salt: str, *exprs: str) -> str:
    """The same uniform as SQL text, for value checks."""
    key = " || ':' || ".join([f"'{salt}'", *[f"CAST({e} AS VARCHAR)" for e in exprs]])
    return f"((CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT) + 0.5) / {_BITS_52:.1f}::DOUBLE)"


def sql_normal(salt: str, *exprs: str) -> str:
    """The same normal as SQL text."""
    u, v = sql_uniform(salt + "/r", *exprs), sql_uniform(salt + "/a", *exprs)
    return f"(sqrt(-2.0::DOUBLE * ln({u})) * cos({_TWO_PI!r}::DOUBLE * {v}))"


def sql_gumbel(salt: str, *exprs: str) -> str:
    """The same Gumbel as SQL text."""
    return f"(-ln(-ln({sql_uniform(salt, *exprs)})))"
