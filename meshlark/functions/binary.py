"""Fields of fixed binary layouts as column expressions, and the layouts written back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u8(raw: Column, at: int | Column) -> Column:
    place = F.lit(at) + 1 if isinstance(at, int) else at + 1
    return F.conv(F.hex(F.substring(raw, place, F.lit(1))), 16, 10).cast("int")


def u16(raw: Column, at: int | Column) -> Column:
    return u8(raw, at) + 256 * u8(raw, at + 1)


def i16(raw: Column, at: int | Column) -> Column:
    n = u16(raw, at)
    return F.when(n > 32767, n - 65536).otherwise(n)


def u32(raw: Column, at: int | Column) -> Column:
    return u16(raw, at).cast("long") + 65536 * u16(raw, at + 2).cast("long")


def le(value: Column, size: int) -> Column:
    """Hex digits of a whole number, little end first; negative numbers in two's complement."""
    n = value.cast("long")
    return F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(n, 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)])


def _crc_table() -> list[int]:
    """Remainders of the polynomial x^16 + x^12 + x^5 + 1 for every byte."""
    out = []
    for byte in range(256):
        r = byte << 8
        for _ in range(8):
            r = (r << 1) ^ (0x1021 if r & 0x8000 else 0)
        out.append(r & 0xFFFF)
    return out


CRC = _crc_table()


def crc16(raw: Column, start: int = 0) -> Column:
    """CRC-16 (start value 0xFFFF, all bits turned at the end) of the bytes from ``start`` on."""
    table = F.split(F.lit(",".join(map(str, CRC))), ",").cast("array<int>")

    def of(own: Column) -> Column:
        step = lambda crc, i: F.element_at(table, F.shiftright(crc, 8).bitwiseXOR(u8(own, i)) + 1).bitwiseXOR(F.shiftleft(crc, 8).bitwiseAND(0xFFFF))
        places = F.when(F.length(own) > start, F.sequence(F.lit(start), F.length(own) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.lit(0xFFFF), step).bitwiseXOR(0xFFFF)

    return F.element_at(F.transform(F.array(raw), of), 1)  # the bytes are computed once, not for each step


def wrap32(n: Column) -> Column:
    """A whole number as 32 bits with sign."""
    return n.bitwiseAND(2**32 - 1).bitwiseXOR(2**31) - 2**31


#: Binary operators of the bytecode, by opcode (fixed values).
OPERATORS = {
    0x30: lambda a, b: wrap32(a) * wrap32(b), 0x40: lambda a, b: wrap32(a) + wrap32(b), 0x41: lambda a, b: wrap32(a) - wrap32(b), 0x50: lambda a, b: F.call_function("shiftleft", a, b.cast("int")), 0x51: lambda a, b: F.call_function("shiftright", a, b.cast("int")),
    0x60: lambda a, b: (a < b).cast("long"), 0x61: lambda a, b: (a > b).cast("long"), 0x62: lambda a, b: (a <= b).cast("long"), 0x63: lambda a, b: (a >= b).cast("long"), 0x70: lambda a, b: (a == b).cast("long"),
    0x71: lambda a, b: (a != b).cast("long"), 0x80: lambda a, b: a.bitwiseAND(b), 0xA0: lambda a, b: a.bitwiseOR(b), 0xB0: lambda a, b: ((a != 0) & (b != 0)).cast("long"), 0xC0: lambda a, b: ((a != 0) | (b != 0)).cast("long"),
}


def applied(op: Column, a: Column, b: Column) -> Column:
    """The operator's value on two whole numbers, wrapped to 32 bits; null for other opcodes and for shifts outside 0..31."""
    out = None
    for code, of in OPERATORS.items():
        hit = (op == code) & (b.between(0, 31) if code in (0x50, 0x51) else F.lit(True))
        out = F.when(hit, wrap32(of(a, b))) if out is None else out.when(hit, wrap32(of(a, b)))
    return out


def printable(raw: Column) -> Column:
    """Text of bytes up to 255 that are shifted by 32 from ASCII; null without an end or with another byte before it."""
    digits = F.hex(raw)
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(0), F.length(raw) - 1)).otherwise(F.array().cast("array<int>"))
    values = F.transform(places, lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    end = F.array_position(values, 255)
    own = F.slice(values, 1, F.greatest(end.cast("int") - 1, F.lit(0)))
    text = F.array_join(F.transform(own, lambda v: F.char(v + 32)), "")
    return F.when((end > 0) & ~F.exists(own, lambda v: v > 94), text)


def blended(back: Column, front: Column, mode: Column) -> Column:
    """Colour channels added (mode 1) or taken away (mode 2), kept between 0 and 255; null for another mode."""
    return F.when(mode == 1, F.least(F.lit(255), back + front)).when(mode == 2, F.greatest(F.lit(0), back - front))


def gameplay_operands(raw: Column) -> Column:
    """Operands (name, kind, bank, value) of a fixed-width instruction; null if its opcode or length isn't known.

    The bank's nibbles say whether an operand is literal or a variable; nothing is evaluated.
    """
    op, first, second = u8(raw, 0), F.shiftright(u8(raw, 1), 4), u8(raw, 1).bitwiseAND(15)

    def operand(name: str, at: int, size: int, bank: Column, target: bool = False) -> Column:
        kind = F.lit("variable") if target else F.when(bank != 0, "variable").otherwise("literal")
        return F.struct(F.lit(name).alias("name"), kind.alias("kind"), bank.alias("bank"), (u8(raw, at) if size == 1 else u16(raw, at)).alias("value"))

    third, fourth = F.shiftright(u8(raw, 2), 4), u8(raw, 2).bitwiseAND(15)
    of = {
        0x58: (5, [("item", 2, 2, first), ("quantity", 4, 1, second)]),
        0x5B: (7, [("materia", 3, 1, first), ("ap0", 4, 1, second), ("ap1", 5, 1, third), ("ap2", 6, 1, fourth)]),
        0x70: (4, [("formation", 2, 2, second)]),
        0x80: (4, [("target", 2, 1, first, True), ("value", 3, 1, second)]),
        0x82: (4, [("target", 2, 1, first, True), ("bit", 3, 1, second)]),
        0x83: (4, [("target", 2, 1, first, True), ("bit", 3, 1, second)]),
    }
    out = None
    for code, (width, operands) in of.items():
        hit, made = (op == code) & (F.length(raw) == width), F.array(*[operand(*x) for x in operands])
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return out
