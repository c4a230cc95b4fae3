"""Parts that state their own length: one reader for chunks, boxes and segments.

A Layout is a table of how a format writes a part: the header's fields, what
its length counts, what follows the payload.  parts() walks any layout by
these alone and never past the bytes it was given.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Container, Iterator
from dataclasses import dataclass
from typing import NamedTuple

#: Parts of one level at most: a file can't keep a walk busy.
MOST_PARTS = 1 << 16


class Broken(ValueError):
    """Bytes that aren't what the layout says must be there."""


class Part(NamedTuple):
    tag: bytes | int
    begin: int
    end: int


@dataclass(frozen=True)
class Layout:
    """name: for messages.  header: struct format; order: where size and tag stand in it.

    included: bytes of the header that the stated size counts; trailer:
    bytes behind the payload; even: whether parts start at even distances;
    strict: whether a bad part is an error, or just the end; final: the tags
    behind which nothing is read; wide: a size of 1 stands for a 64-bit
    number that follows, one of 0 for all that is left; between: what may
    stand before a header; named: what a tag must look like.
    """

    name: str
    header: str
    size: int
    tag: int
    included: int = 0
    trailer: int = 0
    even: bool = False
    strict: bool = False
    final: Container = ()
    wide: bool = False
    between: re.Pattern | None = None
    named: re.Pattern | None = None

    def head(self, data: bytes, at: int, stop: int) -> tuple[Part, int] | None:
        """The part at `at` and where the next one may start; None where no header fits."""
        length = struct.calcsize(self.header)
        if at + length + self.trailer > stop:
            return None
        values = struct.unpack_from(self.header, data, at)
        size, tag = values[self.size], values[self.tag]
        if self.named and not self.named.match(data, at, at + length):
            raise Broken(f"{self.name}: no part begins at offset {at}")
        begin, included = at + length, self.included
        if self.wide and size == 0:
            size = stop - at
        elif self.wide and size == 1:
            if begin + 8 > stop:
                return None
            (size,) = struct.unpack_from(">Q", data, begin)
            begin, included = begin + 8, included + 8
        end = begin + size - included
        if end < begin or end + self.trailer > stop:
            raise Broken(f"{self.name}: part {tag!r} at offset {at} states a length that the file does not hold")
        after = end + self.trailer
        return Part(tag, begin, end), after + (after - at) % 2 * self.even


# PNG, RIFF, ISO base media and JPEG by their specifications.
PNG = Layout("PNG", ">I4s", 0, 1, trailer=4, strict=True, final=(b"IEND",), named=re.compile(rb"[\s\S]{4}[A-Za-z]{4}"))
RIFF = Layout("RIFF", "<4sI", 1, 0, even=True)
BOX = Layout("ISO box", ">I4s", 0, 1, included=8, wide=True)
JPEG = Layout("JPEG", ">BBH", 2, 1, included=2, strict=True, final=(0xDA,), between=re.compile(rb"(?:\xff[\x01\xd0-\xd8]|\xff(?=\xff))*"), named=re.compile(rb"\xff"))


def parts(data: bytes, layout: Layout, begin: int = 0, stop: int | None = None) -> Iterator[Part]:
    """The parts of data[begin:stop], one level, in order; raises Broken where a strict layout's bytes are bad."""
    at, stop = begin, len(data) if stop is None else min(stop, len(data))
    for _ in range(MOST_PARTS):
        if layout.between:
            at = layout.between.match(data, at, stop).end()
        try:
            found = layout.head(data, at, stop)
        except Broken:
            if layout.strict:
                raise
            return
        if found is None:
            return
        yield found[0]
        if found[0].tag in layout.final:
            return
        at = found[1]
    if layout.strict:
        raise Broken(f"{layout.name}: more than {MOST_PARTS} parts; stopped walking")


def nested(data: bytes, layout: Layout, holders: dict[bytes, int], depth: int, begin: int = 0, stop: int | None = None) -> Iterator[Part]:
    """Parts in file order, and behind each holder (a tag with bytes of its own before the parts inside) what it holds, `depth` levels down."""
    for part in parts(data, layout, begin, stop):
        yield part
        if depth and part.tag in holders:
            yield from nested(data, layout, holders, depth - 1, part.begin + holders[part.tag], part.end)


# JUMBF (ISO 19566-5): superboxes that open with a description


class Described(NamedTuple):
    kind: bytes
    label: str


def _opened(data: bytes, begin: int, end: int, tail: bytes, depth: int) -> Iterator[Described]:
    """The description that opens data[begin:end] and those of the superboxes behind it; none if it isn't one whose type id ends in tail."""
    first = next(parts(data, BOX, begin, end), None)
    if first is None or first.tag != b"jumd":
        return
    body = data[first.begin : first.end]
    kind, toggles, rest = body[:16], body[16:17], body[17:]
    if not toggles or not kind.endswith(tail):
        return
    yield Described(kind[:4], rest.partition(b"\0")[0].decode("utf-8", "replace") if toggles[0] & 2 else "")
    if depth:
        yield from superboxes(data, tail, first.end, end, depth - 1)


def superboxes(data: bytes, tail: bytes, begin: int = 0, end: int | None = None, depth: int = 6) -> Iterator[Described]:
    for part in parts(data, BOX, begin, end):
        if part.tag == b"jumb":
            yield from _opened(data, part.begin, part.end, tail, depth)


def jumbf(data: bytes, tail: bytes) -> list[Described]:
    """Descriptions in a file's JUMBF bytes, be they whole boxes or the inside of one."""
    return list(superboxes(data, tail)) or list(_opened(data, 0, len(data), tail, 6))


# CBOR (RFC 8949)

_ARGUMENTS = {24: ">B", 25: ">H", 26: ">I", 27: ">Q"}


def cbor_head(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(major type, argument, where the content begins) of the item at `at`."""
    if not 0 <= at < len(data):
        return None
    major, short = data[at] >> 5, data[at] & 31
    if short < 24:
        return major, short, at + 1
    form = _ARGUMENTS.get(short)
    if form is None or at + 1 + struct.calcsize(form) > len(data):
        return None
    return major, struct.unpack_from(form, data, at + 1)[0], at + 1 + struct.calcsize(form)


def cbor_text(data: bytes, at: int, most: int) -> str | None:
    """The text item of 1 to `most` bytes at `at`."""
    head = cbor_head(data, at)
    if head is None or head[0] != 3 or not 0 < head[1] <= most or head[2] + head[1] > len(data):
        return None
    return data[head[2] : head[2] + head[1]].decode("utf-8", "replace")
