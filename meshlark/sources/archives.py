"""Binary sources: compressed members, archives, scene meshes, save slots and packed graphs.

Files are read with Spark's ``binaryFile`` source (one row per file), and each function
here turns a binary column into rows or columns in Arrow batches.  A file or member that
breaks its format gives a row with ``error`` and no other value, never an exception, so
one bad file doesn't lose the rest.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats.
RING, START, SHORTEST = 4096, 4096 - 18, 3
HEAD, ENTRY, LOOKUP, FOLDER, NAME, RECORD = 16, 27, 900 * 4, 130, 20, 24
SLOT, SLOTS, SLOT_HEAD = 4340, 15, 9
CRC_POLYNOMIAL, CRC_START = 0x1021, 0xFFFF
ABSENT = 65535


def inflate(data: bytes, most: int = 1 << 20) -> bytes:
    """Text of a ring-buffer compressed member: a flag byte for eight tokens, low bit first; a set bit is a byte, else twelve bits of place and four of length."""
    window = bytearray(START)  # what the ring holds before the first byte: zeros
    size, at, n = len(window), 0, len(data)
    while at < n:
        flags, at = data[at] | 0x100, at + 1
        if at == n:
            raise ValueError("flags without a token")
        while flags > 1 and at < n:
            if flags & 1:
                window.append(data[at])
                at += 1
            else:
                if at + 2 > n:
                    raise ValueError("a reference is cut off")
                low, high = data[at], data[at + 1]
                at += 2
                # the ring's place as a distance back from where the next byte goes
                back = (len(window) - (low | (high & 0xF0) << 4) - 1) % RING + 1
                for _ in range((high & 15) + SHORTEST):
                    window.append(window[-back] if back <= len(window) else 0)
            if len(window) - size > most:
                raise ValueError("more than the limit")
            flags >>= 1
    return bytes(window[size:])


def inflated(data: Column, most: int = 1 << 20) -> Column:
    """struct(text, error) of compressed members."""

    @F.pandas_udf("text binary, error string")
    def run(members: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_safe(lambda m=m: inflate(m, most)) for m in members], columns=["text", "error"])

    return run(data)


def _safe(f: Callable[[], object]) -> tuple[object, str | None]:
    try:
        return f(), None
    except (ValueError, TypeError, struct.error) as e:
        return None, str(e)


def _name(raw: bytes) -> str:
    return raw.partition(b"\0")[0].decode("ascii")


def entries(data: bytes) -> list[tuple[str, int, int, bytes]]:
    """Members of an archive (name, place of the text, size, text), with names, bounds and overlaps checked."""
    count = struct.unpack_from("<I", data, HEAD - 4)[0]
    conflicts_at = HEAD + count * ENTRY + LOOKUP
    free = conflicts_at + 2
    for _ in range(struct.unpack_from("<H", data, conflicts_at)[0]):
        free += 2 + FOLDER * struct.unpack_from("<H", data, free)[0]
    out = []
    for i in range(count):
        raw, place = struct.unpack_from(f"<{NAME}sI", data, HEAD + i * ENTRY)
        name = _name(raw)
        if place < free or place + RECORD > len(data) or _name(data[place : place + NAME]) != name:
            raise ValueError(f"{name}: no record at {place}")
        size = struct.unpack_from("<I", data, place + NAME)[0]
        if place + RECORD + size > len(data):
            raise ValueError(f"{name}: beyond the archive")
        out.append((name, place + RECORD, size, data[place + RECORD : place + RECORD + size]))
    spans = sorted((p - RECORD, p + s) for _, p, s, _ in out)
    if any(end > begin for (_, end), (begin, _) in zip(spans, spans[1:], strict=False)):
        raise ValueError("records overlap")
    return out


def crc16(data: bytes) -> int:
    crc = CRC_START
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (CRC_POLYNOMIAL if crc & 0x8000 else 0)) & 0xFFFF
    return crc ^ 0xFFFF


def slots(data: bytes) -> list[tuple[int, int, int, str]]:
    """Save slots (slot, stored, computed, status); a slot of zeros is empty."""
    if len(data) != SLOT_HEAD + SLOT * SLOTS:
        raise ValueError("no save file by its size")
    out = []
    for i in range(SLOTS):
        one = data[SLOT_HEAD + i * SLOT :][:SLOT]
        stored, computed = struct.unpack_from("<H", one)[0], crc16(one[4:])
        status = "empty" if not any(one[4:]) and stored in (0, computed) else "checksum" if stored != computed else "valid"
        out.append((i, stored, computed, status))
    return out


def mesh(data: bytes) -> list[tuple[int, list[int], list[int | None]]]:
    """Triangles of a scene (number, nine whole numbers, three neighbours or none): count, 24 bytes each with a pad after each corner, then 6 bytes each."""
    count = struct.unpack_from("<I", data)[0]
    if len(data) < 4 + 30 * count:
        raise ValueError("the mesh is cut off")
    corners = np.frombuffer(data, "<i2", 12 * count, 4).reshape(count, 3, 4)[:, :, :3].reshape(count, 9)
    access = np.frombuffer(data, "<u2", 3 * count, 4 + 24 * count).reshape(count, 3)
    return [(i, corners[i].tolist(), [None if v == ABSENT else int(v) for v in access[i]]) for i in range(count)]


READERS = {
    "archive": (entries, "name string, place long, size long, text binary"),
    "slots": (slots, "slot int, stored int, computed int, status string"),
    "mesh": (mesh, "tri int, corners array<int>, access array<int>"),
}


def scan(files: DataFrame, kind: str, *, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of binary files: path, error, and the columns of the kind (archive, slots, mesh).  A null file gives an error row."""
    read, schema = READERS[kind]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"], strict=True):
                rows, error = _safe(lambda c=c: read(c))
                made = [(p, None, *r) for r in rows] if error is None else [(p, error, *[None] * len(names))]
                frame = pd.DataFrame(made, columns=["path", "error", *names])
                yield frame.astype({n: "Int64" for n, t in (x.split() for x in schema.split(", ")) if t in ("int", "long")})

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, f"path string, error string, {schema}")


def fingerprint(files: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """path, size, sha256, known: whether the digest is the one stated for a path's last part (null: none stated)."""
    digest = F.sha2("content", 256)
    stated = F.create_map(*[F.lit(x) for kv in (known or {"": ""}).items() for x in kv])
    return files.select("path", F.length("content").cast("long").alias("size"), digest.alias("sha256"), (F.element_at(stated, F.element_at(F.split("path", "/"), -1)) == digest).alias("known"))


def verified(written: DataFrame, meant: DataFrame) -> DataFrame:
    """Rows that a written table lacks or has too many of, as multisets: the columns, and lost or extra."""
    return meant.exceptAll(written).withColumn("status", F.lit("lost")).union(written.exceptAll(meant).withColumn("status", F.lit("extra")))


def packed_archive(members: Column) -> Column:
    """An archive (hex digits) of an array of (name, text), in order: head, table of contents, look-up, members."""
    zeros = lambda n: F.repeat(F.lit("00"), n)
    little = lambda v, size: F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(v.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)])
    named = lambda s: F.rpad(F.hex(s.cast("binary")), 2 * NAME, "0")
    first = HEAD + F.size(members) * ENTRY + LOOKUP + 2
    size = lambda m: F.octet_length(m["text"])
    before = lambda i: F.aggregate(F.slice(members, 1, i), F.lit(0), lambda n, m: n + RECORD + size(m))
    contents = F.array_join(F.transform(members, lambda m, i: F.concat(named(m["name"]), little(first + before(i), 4), zeros(F.lit(ENTRY - NAME - 4)))), "")
    bodies = F.array_join(F.transform(members, lambda m: F.concat(named(m["name"]), little(size(m), 4), F.hex(m["text"].cast("binary")))), "")
    return F.concat(zeros(F.lit(HEAD - 4)), little(F.size(members), 4), contents, zeros(F.lit(LOOKUP)), F.lit("0000"), bodies)
