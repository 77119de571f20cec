"""Generalised Morton codes as Column expressions: level symbols, keys of several words, decoding. All stays in codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orthobox.schema import WORD_BITS, PointSchema

CHUNK = 8  # bits of a value that one table look-up spreads


def get_bit(value: Column, bit: int) -> Column:
    return F.shiftright(value, bit).bitwiseAND(F.lit(1).cast("long"))


def set_bit(value: Column, bit: int) -> Column:
    return value.bitwiseOR(F.lit(1 << bit).cast("long"))


def clear_bit(value: Column, bit: int) -> Column:
    return value.bitwiseAND(F.lit(~(1 << bit)).cast("long"))


def bit_width(value: Column) -> Column:
    """Bits that a non-negative value needs; 0 needs 0."""
    return F.when(value == 0, F.lit(0)).otherwise(F.length(F.bin(value))).cast("long")


def pop_count(value: Column) -> Column:
    return F.bit_count(value).cast("long")


def kth_set_bit(value: Column, k: int) -> Column:
    """Position of the k-th set bit (from 0, least significant first); null if there are fewer."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(value, i) == 1)
    return F.get(bits, F.lit(k)).cast("long")


def _table(values: list[int]) -> Column:
    """A constant array. As one string it is a single literal, which the optimizer folds into an array once a plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _spread(value: Column, moves: dict[int, int]) -> list[Column]:
    """Terms whose bitwise or has bit `moves[b]` set where the value has bit b: one look-up for every CHUNK bits."""
    out = []
    for low in range(0, max(moves) + 1, CHUNK):
        here = {b - low: to for b, to in moves.items() if low <= b < low + CHUNK}
        if not here:
            continue
        size = 1 << (max(here) + 1)
        table = [sum(1 << to for b, to in here.items() if v >> b & 1) for v in range(size)]
        at = F.shiftright(value, low).bitwiseAND(F.lit(size - 1).cast("long")).cast("int")
        out.append(F.get(_table(table), at) if len(here) > 1 else F.shiftleft(get_bit(value, low + max(here)), here[max(here)]))
    return out


def _or(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), terms) if terms else F.lit(0).cast("long")


def _packed(bits: list[tuple[str, int]]) -> Column:
    """(attribute, bit) pairs, the most significant first, as one long."""
    moves: dict[str, dict[int, int]] = {}
    for k, (name, b) in enumerate(bits):
        moves.setdefault(name, {})[b] = len(bits) - 1 - k
    return _or([t for name, m in moves.items() for t in _spread(F.col(name), m)])


def level_symbol(schema: PointSchema, level: int) -> Column:
    """One bit of each attribute that takes part in the level, the first attribute's being the most significant."""
    return _packed([(a.name, a.width - level - 1) for a in schema.level_members(level)])


def full_symbol(schema: PointSchema, level: int) -> int:
    """The largest symbol of the level."""
    return (1 << len(schema.level_members(level))) - 1


def words(schema: PointSchema) -> list[Column]:
    """The key as longs of WORD_BITS bits, most significant first; the last may hold fewer. Comparing them in turn is
    comparing keys."""
    bits = schema.key_bits()
    return [_packed(bits[k : k + WORD_BITS]) for k in range(0, len(bits), WORD_BITS)]


def word_names(schema: PointSchema) -> list[str]:
    return [f"z{k}" for k in range(schema.n_words)]


def with_key(df, schema: PointSchema):
    """df with the key's words added as z0, z1, ..."""
    return df.withColumns(dict(zip(word_names(schema), words(schema))))


def binary_key(schema: PointSchema) -> Column:
    """The key as binary, which orders as unsigned bytes do."""
    return F.unhex(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words(schema)]))


def decoded(schema: PointSchema, names: list[str] | None = None) -> dict[str, Column]:
    """Each attribute from the words of a key."""
    names, bits = names or word_names(schema), schema.key_bits()
    moves: dict[str, dict[int, dict[int, int]]] = {a: {} for a in schema.names}
    for k, (name, bit) in enumerate(bits):
        word, at = divmod(k, WORD_BITS)
        size = min(WORD_BITS, len(bits) - word * WORD_BITS)
        moves[name].setdefault(word, {})[size - 1 - at] = bit
    return {a: _or([t for word, m in own.items() for t in _spread(F.col(names[word]), m)]) for a, own in moves.items()}


def prefix(schema: PointSchema, level: int) -> list[Column]:
    """What levels 0 .. level hold of each attribute; two points are in one cell of the level if these agree."""
    kept = schema.prefix_bits(level)
    return [F.shiftright(F.col(a.name), a.bits - kept[a.name]).alias(a.name) for a in schema.attributes]
