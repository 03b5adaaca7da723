"""Scalar functions on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of word kinds in the keyword, operator and separator vocabulary.
KOS_PREFIXES = {"KEYWORD": "kwrd_", "OPERATOR": "op_", "SEPARATOR": "sep_"}


def kos_word(kind: Column, value: Column) -> Column:
    """The prefixed word of a keyword, operator or separator; null for other kinds."""
    out = F.lit(None).cast("string")
    for name, prefix in KOS_PREFIXES.items():
        out = F.when(kind == name, F.concat(F.lit(prefix), value)).otherwise(out)
    return out


def major(name: Column, mark: str = "_") -> Column:
    """What stands before the first ``mark``; the whole if there is none."""
    return F.substring_index(name, mark, 1)


def minor(name: Column, mark: str = "_") -> Column:
    """What stands after the first ``mark``; null if there is none."""
    at = F.instr(name, mark)
    return F.when(at > 0, F.substring(name, at + len(mark), F.length(name)))


def bare(name: Column, edge: str = "_") -> Column:
    """Lower-cased, without ``edge`` characters at either end."""
    return F.btrim(F.lower(name), F.lit(edge))


def clipped_place(place: Column, most: int = 3) -> Column:
    """``child_place=k`` with k at most ``most``; ``child_place=UNK`` for null."""
    return F.coalesce(F.concat(F.lit("child_place="), F.least(place, F.lit(most)).cast("string")), F.lit("child_place=UNK"))


def identity_hash(text: Column) -> Column:
    """SHA-1 as URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha1(text))), "+/", "-_"), F.lit("="))


def seed_of(salt: Column, keys: Column, position: Column) -> Column:
    """sha256("salt|keys|position") mod 2**32, a seed for one example."""
    whole = F.concat_ws("|", salt, keys, position.cast("string"))
    return F.conv(F.right(F.sha2(whole, 256), F.lit(8)), 16, 10).cast("long")


def file_size(size: Column) -> Column:
    """Bytes as a number with a binary unit."""
    step = F.when(size < 1, 0).otherwise(F.least(F.floor(F.log2(size.cast("double")) / 10 + 1e-12), F.lit(4)))
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")])
    return F.concat(F.format_number(size / F.pow(F.lit(1024.0), step), 2), F.lit(" "), F.get(units, step.cast("int")))


def code_slice(code: Column, begin: Column, end: Column) -> Column:
    """Characters ``begin`` to ``end``, from 0, the end exclusive."""
    return F.substring(code, begin + 1, end - begin)
