"""Payload files: decoders that turn one file into its messages.

A decoder is a callable ``(file, size, context) -> iterator of Message``; register one
under a name to read another format. Two come with the package:

* ``framed``: each message is the mark ``GSF1``, the length of a JSON header as a
  little-endian uint32, the header, and Nj * Ni little-endian float32 values;
* ``raw``: nothing but little-endian float32 values, whose shape and times come from
  the manifest row.

Members are numbered by their position in the file.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

MARK = b"GSF1"


@dataclass
class Message:
    header: dict[str, Any]
    offset: int
    length: int


def encode(header: dict[str, Any], values: bytes) -> bytes:
    text = json.dumps(header).encode()
    return MARK + struct.pack("<I", len(text)) + text + values


def framed(file: BinaryIO, size: int, context: dict[str, Any]) -> Iterator[Message]:
    """Headers and value ranges of a framed file; the values are not read."""
    position = 0
    while position < size:
        file.seek(position)
        start = file.read(8)
        if len(start) < 8 or start[:4] != MARK:
            raise ValueError(f"no message at byte {position}")
        (n,) = struct.unpack("<I", start[4:])
        header = json.loads(file.read(n))
        length = 4 * header["Nj"] * header["Ni"]
        if position + 8 + n + length > size:
            raise ValueError(f"message at byte {position} is cut short")
        yield Message(header, position + 8 + n, length)
        position += 8 + n + length


def raw(file: BinaryIO, size: int, context: dict[str, Any]) -> Iterator[Message]:
    """Equal grids one after the other, described by ``context``."""
    length = 4 * context["Nj"] * context["Ni"]
    if size % length:
        raise ValueError(f"{size} bytes are no multiple of a {context['Nj']}x{context['Ni']} grid")
    for position in range(0, size, length):
        yield Message(context, position, length)


DECODERS: dict[str, Callable[[BinaryIO, int, dict[str, Any]], Iterator[Message]]] = {
    "framed": framed,
    "raw": raw,
}
