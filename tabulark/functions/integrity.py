"""Whether an image file is whole, from its bytes, in column expressions.

A PNG is walked chunk by chunk: each chunk's length, its checksum, the header first, and the end chunk. A JPEG is
walked marker by marker: segments by their lengths, coded data up to the next marker, a frame, a scan, and the end
marker. Nothing is decoded; ``sources.files.decodable`` asks Spark's image source as a second opinion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures and names of the two formats.
PNG, JPG = "89504E470D0A1A0A", "FFD8FF"
_HEADER, _END = "49484452", "49454E44"

#: Steps of a first walk, which most files end; only the others get as many steps as their length allows.
SHORT = 512


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(content: Column, at: Column, size: int) -> Column:
    """The unsigned big-endian number of ``size`` bytes from place ``at`` (from 1) on."""
    return F.conv(F.hex(F.substring(content, at, F.lit(size))), 16, 10).cast("bigint")


def _walk(content: Column, start: int, least: int, step: Callable[[Column], Column]) -> Column:
    """The verdict of a walk from place ``start``: null once the end is met in order, else what is wrong.

    ``step`` makes a struct ``at, seen, verdict`` of the one before; verdict "" goes on. A step takes at least
    ``least`` bytes."""
    begin = F.struct(F.lit(start).cast("bigint").alias("at"), F.lit(0).alias("seen"), F.lit("").alias("verdict"))
    most = F.greatest(F.floor(F.length(content) / least) + 1, F.lit(1)).cast("int")

    def walked(count: Column) -> Column:
        move = lambda x, _: F.when(x["verdict"] == "", step(x)).otherwise(x)
        return F.aggregate(F.sequence(F.lit(1), count), begin, move, lambda x: x["verdict"])

    first = walked(F.least(most, F.lit(SHORT)))
    verdict = _let(first, lambda v: F.when(v == "", walked(most)).otherwise(v))
    return F.when(verdict == "whole", F.lit(None)).when(verdict == "", "truncated").otherwise(verdict)


def _state(at: Column, seen: Column, verdict: Column) -> Column:
    return F.struct(at.cast("bigint").alias("at"), seen.cast("int").alias("seen"), verdict.alias("verdict"))


def _png_step(content: Column) -> Callable[[Column], Column]:
    def step(x: Column) -> Column:
        at = x["at"].cast("int")
        head = F.struct(_number(content, at, 4).alias("size"), F.hex(F.substring(content, at + 4, F.lit(4))).alias("name"))
        return _let(head, lambda c: taken(x, at, c["size"], c["name"]))

    def taken(x: Column, at: Column, size: Column, name: Column) -> Column:
        over = at + 11 + F.coalesce(size, F.lit(0)) > F.length(content)
        body = F.substring(content, at + 4, (size + 4).cast("int"))
        wrong = F.crc32(body) != _number(content, (at + 8 + size).cast("int"), 4)
        empty = (size != 13) | (_number(content, at + 8, 4) == 0) | (_number(content, at + 12, 4) == 0)
        verdict = (
            F.when(over, "truncated")
            .when((x["seen"] == 0) & (name != _HEADER), "structure")
            .when(wrong, "checksum")
            .when((x["seen"] == 0) & empty, "structure")
            .when(name == _END, "whole")
            .otherwise("")
        )
        return _state(F.when(over, x["at"]).otherwise(at + 12 + size), F.lit(1), verdict)

    return step


#: Bits of ``seen``: a frame, a scan, and being inside a scan's coded data.
_FRAME, _SCAN, _CODED = 1, 2, 4


def _jpeg_step(content: Column) -> Callable[[Column], Column]:
    def step(x: Column) -> Column:
        at, seen = x["at"].cast("int"), x["seen"]
        return F.when(seen.bitwiseAND(_CODED) != 0, _let(coded(at), lambda f: skipped(x, f))).otherwise(_let(head(at), lambda h: taken(x, at, h["lead"], h["kind"], h["size"])))

    def coded(at: Column) -> Column:
        # In coded data a marker is FF and neither 00 nor a restart.
        rest = F.decode(F.substring(content, at, F.length(content)), "ISO-8859-1")
        return F.regexp_instr(rest, F.lit(r"\xFF[\x01-\xCF\xD8-\xFE]"))

    def skipped(x: Column, found: Column) -> Column:
        return _state(x["at"] + found - 1, x["seen"].bitwiseAND(_FRAME | _SCAN), F.when(found == 0, "truncated").otherwise(""))

    def head(at: Column) -> Column:
        return F.struct(_number(content, at, 1).alias("lead"), _number(content, at + 1, 1).alias("kind"), _number(content, at + 2, 2).alias("size"))

    def taken(x: Column, at: Column, lead: Column, kind: Column, size: Column) -> Column:
        seen = x["seen"]
        single = (kind == 0x01) | kind.between(0xD0, 0xD8)
        frame = kind.between(0xC0, 0xCF) & ~kind.isin(0xC4, 0xC8, 0xCC)
        full = seen.bitwiseAND(_FRAME | _SCAN) == _FRAME | _SCAN
        verdict = (
            F.when(at + 1 > F.length(content), "truncated")
            .when((lead != 0xFF) | (kind == 0), "structure")
            .when(kind == 0xFF, "")
            .when(kind == 0xD9, F.when(full, "whole").otherwise("structure"))
            .when(single, "")
            .when((at + 1 + F.coalesce(size, F.lit(0)) > F.length(content)) | (at + 3 > F.length(content)), "truncated")
            .when(size < 2, "structure")
            .otherwise("")
        )
        onward = F.when(kind == 0xFF, x["at"] + 1).when(single, x["at"] + 2).otherwise(x["at"] + 2 + F.coalesce(size, F.lit(0)))
        gained = F.when(kind == 0xDA, F.lit(_SCAN | _CODED)).when(frame, F.lit(_FRAME)).otherwise(F.lit(0))
        return _state(onward, seen.bitwiseOR(gained), verdict)

    return step


def damage(content: Column) -> Column:
    """Null for a whole PNG or JPEG; else "empty", "unknown" (no signature of the two), "structure", "checksum" or "truncated".

    Null or no bytes are empty. What follows the end is not read."""

    def judged(own: Column) -> Column:
        start = F.hex(F.substring(own, 1, 8))
        return F.when(start == PNG, _walk(own, 9, 12, _png_step(own))).when(start.startswith(JPG), _walk(own, 3, 1, _jpeg_step(own))).otherwise("unknown")

    return F.when(content.isNull() | (F.length(content) == 0), "empty").otherwise(_let(content, judged))
