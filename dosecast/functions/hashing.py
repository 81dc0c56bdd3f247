"""Reproducible randomness: every draw is an md5 of (seed, key), never ``rand()``.

Results therefore do not depend on partitioning, retries or the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters then digits, the alphabet of the random names.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

_HEX_DIGITS = 15  # 60 bits, the most that fits a signed long
_RANGE = float(1 << (4 * _HEX_DIGITS))


def md5_key(*parts) -> Column:
    """Hex digest of the parts joined by ':'; plain Python values become literals."""
    return F.md5(F.concat_ws(":", *[_text(p) for p in parts]))


def md5_long(*parts) -> Column:
    """A non-negative 60-bit integer drawn from the parts.

    Never null, and said so: otherwise every join on it would digest the key a second
    time to check.
    """
    drawn = F.conv(F.substring(md5_key(*parts), 1, _HEX_DIGITS), 16, 10).cast("bigint")
    return F.coalesce(drawn, F.lit(0).cast("bigint"))


def md5_unit(*parts) -> Column:
    """A uniform double in [0, 1) drawn from the parts."""
    return md5_long(*parts).cast("double") / F.lit(_RANGE)


def random_token(*parts, length: int = 5) -> Column:
    """A random name over letters and digits; constant parts give a constant."""
    digest = md5_key(*parts)
    letters = []
    for i in range(length):
        draw = F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("int")
        letters.append(F.substring(F.lit(ALPHABET), draw % len(ALPHABET) + 1, F.lit(1)))
    return F.concat(*letters)


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))
