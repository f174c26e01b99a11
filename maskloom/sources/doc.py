"""Paragraphs of legacy Word files: the compound file's sector chains, then the document's piece table."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

_SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_LAST = 0xFFFFFFFA  # sector numbers from here on end a chain or mean no sector


def _chain(first: int, table: list[int]) -> Iterator[int]:
    at, seen = first, 0
    while at < _LAST:
        if at >= len(table) or seen > len(table):
            raise ValueError("a chain of sectors leaves the file or has no end")
        yield at
        at, seen = table[at], seen + 1


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name."""
    if not data.startswith(_SIGNATURE) or len(data) < 512:
        raise ValueError("not a compound file")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    size, small = 1 << shift, 1 << small_shift
    directory, _, cutoff, small_first, _, more, n_more = struct.unpack_from("<IIIIIII", data, 48)
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    longs = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
    held = longs(data[76:512])
    for _ in range(n_more):
        if more >= _LAST:
            break
        *own, more = longs(sector(more))
        held += own
    table = [x for i in held if i < _LAST for x in longs(sector(i))]
    read = lambda first: b"".join(map(sector, _chain(first, table)))
    small_table = longs(read(small_first)) if small_first < _LAST else []
    entries, inner, out = read(directory), b"", {}
    for at in range(0, len(entries) - 127, 128):
        n, kind = struct.unpack_from("<HB", entries, at + 64)
        first, length = struct.unpack_from("<II", entries, at + 116)
        if kind == 5:
            inner = read(first) if first < _LAST else b""
        elif kind == 2:
            name = entries[at : at + max(n - 2, 0)].decode("utf-16-le", "replace")
            whole = read(first) if length >= cutoff else b"".join(inner[i * small : (i + 1) * small] for i in _chain(first, small_table))
            out[name] = whole[:length]
    return out


def text(data: bytes) -> str:
    """The text of the main document, pieces put together."""
    found = streams(data)
    word = found.get("WordDocument", b"")
    if len(word) < 0x1AA or word[:2] != b"\xec\xa5":
        raise ValueError("no Word document within")
    flags, n_chars = struct.unpack_from("<H", word, 0x0A)[0], struct.unpack_from("<i", word, 0x4C)[0]
    if flags & 0x100:
        raise ValueError("the document is encrypted")
    table = found["1Table" if flags & 0x200 else "0Table"]
    at, length = struct.unpack_from("<II", word, 0x1A2)
    end = at + length
    while at < end and table[at] == 1:  # properties of pieces, passed over
        at += 3 + struct.unpack_from("<H", table, at + 1)[0]
    if at >= end or table[at] != 2:
        raise ValueError("no table of pieces")
    n = (struct.unpack_from("<I", table, at + 1)[0] - 4) // 12
    places = struct.unpack_from(f"<{n + 1}i", table, at + 5)
    out = []
    for i in range(n):
        where = struct.unpack_from("<I", table, at + 5 + 4 * (n + 1) + 8 * i + 2)[0]
        count, start = places[i + 1] - places[i], where & 0x3FFFFFFF
        if where & 0x40000000:
            out.append(word[start // 2 : start // 2 + count].decode("cp1252", "replace"))
        else:
            out.append(word[start : start + 2 * count].decode("utf-16-le", "replace"))
    return "".join(out)[:n_chars]


def paragraphs(data: bytes) -> Iterator[str]:
    """Paragraphs with something in them; a table's row is one, its cells between bars. Of fields the result is read, not the instruction."""
    whole = text(data)
    while (less := re.sub("\x13[^\x13\x14\x15]*(?:\x14([^\x13\x14\x15]*))?\x15", lambda m: m[1] or "", whole)) != whole:
        whole = less
    for line in re.split("[\r\x0c]", re.sub("\x07\x07", "\x07\r", whole)):
        cells = [re.sub("[\x00-\x08\x0e-\x1f]", "", c.replace("\x0b", " ").replace("\x1e", "-").replace("\x1f", "")).strip() for c in line.split("\x07")]
        own = f"|{'|'.join(cells[:-1])}|" if len(cells) > 1 and not cells[-1] else " ".join(cells)
        if own.strip("| "):
            yield own.strip()
