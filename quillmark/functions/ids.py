"""Entity ids, hash draws and roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.bind import bound

ID = r"^S[123]-(0|[1-9][0-9]{0,9})$"


def key_of(entity_id: Column) -> Column:
    """S2-17 -> 20000000017. A malformed id raises; null stays null."""
    good = F.substring(entity_id, 2, 1).cast("long") * 10_000_000_000 + F.substring(entity_id, 4, 10).cast("long")
    return F.when(entity_id.isNull(), F.lit(None).cast("long")).when(entity_id.rlike(ID), good).otherwise(F.raise_error(F.concat(F.lit("malformed id: "), entity_id)))


def id_of(key: Column) -> Column:
    return F.concat(F.lit("S"), F.floor(key / 10_000_000_000).cast("long").cast("string"), F.lit("-"), (key % 10_000_000_000).cast("string"))


def draw(key: Column, salt: int) -> Column:
    """A value in [0, 1) fixed by key and salt: the first 52 bits of an MD5, so that other engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(salt)), key.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


_MASK = 0xFFFFFFFF


def _times(z: Column, by: int) -> Column:
    """The low 64 bits of a product. Parts of 32 and 16 bits are multiplied, so that no product or sum overflows, which ANSI mode forbids."""
    low, high, mask = by & _MASK, by >> 32, F.lit(_MASK)
    part = lambda x, y: x * F.lit(y & 0xFFFF) + F.shiftleft((x * F.lit(y >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)  # noqa: E731  the low 32 bits of x * y, and more

    def product(x: Column) -> Column:
        a, b = x.bitwiseAND(mask), F.shiftrightunsigned(x, 32)
        top = F.shiftleft((part(a, high) + part(b, low)).bitwiseAND(mask), 32)
        return _plus(_plus(a * F.lit(low & 0xFFFF), F.shiftleft(a * F.lit(low >> 16), 16)), top)

    return bound(z, product)


def _plus(x: Column, y: Column) -> Column:
    """The low 64 bits of a sum."""
    mask = F.lit(_MASK)

    def total(p: Column) -> Column:
        low = p["x"].bitwiseAND(mask) + p["y"].bitwiseAND(mask)
        high = F.shiftrightunsigned(p["x"], 32) + F.shiftrightunsigned(p["y"], 32) + F.shiftrightunsigned(low, 32)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))

    return bound(F.struct(x.alias("x"), y.alias("y")), total)


def _mixed(z: Column, by: int) -> Column:
    return bound(z, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, by)))


def splitmix(key: Column, salt: int) -> Column:
    """The splitmix64 finaliser's top 53 bits over 2**53."""
    step = (salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    z = _plus(key.cast("long"), F.lit(step - (1 << 64) if step >> 63 else step))
    z = _times(_mixed(z, 30), 0xBF58476D1CE4E5B9)
    z = _times(_mixed(z, 27), 0x94D049BB133111EB)
    return F.shiftrightunsigned(_mixed(z, 31), 11) / F.lit(float(1 << 53))


def role(key: Column, held: float, first: float, third: float, seed: int) -> Column:
    """3 roles besides 0: held out with rate `held`; of the rest 1 with rate `first`, then 3 with rate `third`, else 2... as
    codes 0 (unused), 1 (model), 2 (held out), 3 (embedder)."""
    u, v = draw(key, seed), draw(key, seed + 1)
    return F.when(u < held, 2).when(v < first, 1).when(v < first + min(third, 1 - first), 3).otherwise(0)


def fold(key: Column, n: int) -> Column:
    return F.floor(draw(key, 99) * n).cast("int")
