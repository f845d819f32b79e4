"""Pseudonyms, k-anonymity gates and keyed noise, all as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = b"test-key"
SALT = "salt"
K = 5
EPSILON = 1.0
MONEY_SENSITIVITY = 1.0


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The two key pads of HMAC-SHA256."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_hex(message: Column, key: bytes = KEY) -> Column:
    """HMAC-SHA256 in hex: two nested hashes over literal pads, no Python."""
    inner, outer = (F.lit(bytearray(p)) for p in pads(key))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def pseudonym(actor: Column, key: bytes = KEY, salt: str = SALT) -> Column:
    return F.when(actor.isNotNull(), F.concat(F.lit("px_"), F.substring(hmac_hex(F.concat(F.lit(f"{salt}:"), actor), key), 1, 20)))


def laplace(name: Column, epsilon: float = EPSILON, sensitivity: float = MONEY_SENSITIVITY, key: bytes = KEY) -> Column:
    """Noise that the same key, epsilon and name always give alike."""
    bits = F.conv(F.substring(hmac_hex(F.concat(F.lit(f"{epsilon}:"), name), key), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    u = bits / float(2**64) - 0.5
    return -(sensitivity / epsilon) * F.when(u >= 0, 1.0).otherwise(-1.0) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-12)))


def suppress(value: Column, actors: Column, k: int = K) -> Column:
    """Zero below k."""
    return F.when(actors >= k, value).otherwise(F.lit(0))


def withhold(value: Column, actors: Column, k: int = K) -> Column:
    """Null below k."""
    return F.when(actors >= k, value)


def noisy(value: Column, actors: Column, name: Column, k: int = K, epsilon: float = EPSILON) -> Column:
    return F.when(actors >= k, F.round(value + laplace(name, epsilon), 2))


def laplace_reference(name: str, epsilon: float = EPSILON, sensitivity: float = MONEY_SENSITIVITY, key: bytes = KEY) -> float:
    """The same draw for one name, for tests."""
    import hashlib
    import hmac

    u = int(hmac.new(key, f"{epsilon}:{name}".encode(), hashlib.sha256).hexdigest()[:16], 16) / 2**64 - 0.5
    return -(sensitivity / epsilon) * math.copysign(1.0, u) * math.log(max(1 - 2 * abs(u), 1e-12))
