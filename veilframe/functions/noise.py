"""Sources of noise for released values.

``SecureNoise`` draws at run time from the operating system's secure source. A plan that draws must be materialised before it is released: see
``veilframe.operators.dp.release``. ``HashNoise`` derives the draw from a key and a seed, which gives the
same value in any engine and partitioning; a known seed removes all privacy, so it is for tests.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


class SecureNoise:
    def uniform(self, key: Column) -> Column:
        """A draw from (0, 1): 52 bits of the initialisation vector that an encryption takes from the JVM's
        secure random source. ``rand`` is in what is encrypted only so that every row draws anew."""
        sealed = F.aes_encrypt(F.rand().cast("string").cast("binary"), F.lit(bytearray(16)))
        return (F.conv(F.substring(F.hex(sealed), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

    def normal(self, key: Column) -> Column:
        """Box and Muller on two draws."""
        a, b = (self.uniform(F.concat(key, F.lit(tail))) for tail in ("#a", "#b"))
        return F.sqrt(-2 * F.log(a)) * F.cos(b * (2 * math.pi))

    def laplace(self, scale: Column | float, key: Column) -> Column:
        u = self.uniform(key) - 0.5
        b = F.lit(scale) if isinstance(scale, (int, float)) else scale
        return -b * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(5e-324)))

    def gaussian(self, sigma: Column | float, key: Column) -> Column:
        return (F.lit(sigma) if isinstance(sigma, (int, float)) else sigma) * self.normal(key)


class HashNoise(SecureNoise):
    def __init__(self, seed: str):
        self.seed = seed

    def uniform(self, key: Column) -> Column:
        digest = F.md5(F.concat_ws("|", key, F.lit(self.seed)).cast("binary"))
        return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def hash_uniform_sql(key: str, seed: str) -> str:
    """``HashNoise.uniform`` in SQL; ``key`` is a text expression."""
    return f"((('0x' || substr(md5({key} || '|{seed}'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"


def hash_laplace_sql(scale: str, key: str, seed: str) -> str:
    u = f"({hash_uniform_sql(key, seed)} - 0.5)"
    return f"(-({scale}) * sign({u}) * ln(1 - 2 * abs({u})))"


def hash_gaussian_sql(sigma: str, key: str, seed: str) -> str:
    a, b = (hash_uniform_sql(f"({key} || '{tail}')", seed) for tail in ("#a", "#b"))
    return f"(({sigma}) * sqrt(-2 * ln({a})) * cos(({b}) * 2 * pi()))"
