"""Programs of 16-bit words as rows of instructions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Opcodes (fixed values): the last valid one, jumps with an operand, return, and the range of pushes with an operand.
LAST, JUMPS, RETURN, PUSH = 0x355, (0x200, 0x201), 0x203, (0x101, 0x1FF)


def size(op: Column) -> Column:
    return F.when(op.between(*PUSH) | op.isin(*JUMPS), 2).otherwise(1)


def kind(op: Column) -> Column:
    return F.when(op.between(0x204, 0x2FF), "call").when(op == RETURN, "return").when(op.isin(*JUMPS), "jump").when(op.between(*PUSH), "push").otherwise("plain")


def instructions(programs: DataFrame, key: str, words: str) -> DataFrame:
    """key, status, pc, op, arg (-1: none) of every instruction, decoded one after another from the first word.

    An opcode beyond the last valid one, or an operand beyond the end, makes the program
    one row of status invalid.
    """
    w = F.col(words)
    at = lambda i: F.get(w, i)
    start = F.struct(F.lit(0).alias("next"), F.lit(False).alias("bad"), F.array().cast("array<struct<pc:int,op:int,arg:int>>").alias("found"))

    def step(state: Column, i: Column) -> Column:
        op, width = at(i), size(at(i))
        bad = (op > LAST) | (i + width > F.size(w))
        one = F.struct(i.alias("pc"), op.alias("op"), F.when(width == 2, at(i + 1)).otherwise(-1).alias("arg"))
        took = F.struct((i + width).alias("next"), bad.alias("bad"), F.concat(state["found"], F.array(one)).alias("found"))
        return F.when(state["bad"] | (i < state["next"]), state).otherwise(took)

    places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    decoded = programs.select(key, F.aggregate(places, start, step).alias("s"))
    none = F.array(F.struct(F.lit(-1).alias("pc"), F.lit(-1).alias("op"), F.lit(-1).alias("arg")))
    rows = decoded.select(key, F.when(F.col("s.bad"), "invalid").otherwise("ok").alias("status"), F.explode(F.when(F.col("s.bad"), none).otherwise(F.col("s.found"))).alias("i"))
    return rows.select(key, "status", "i.pc", "i.op", "i.arg")
