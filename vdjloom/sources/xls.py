"""Workbooks of the old binary form (S10): the cells' saved values and merged ranges of one sheet.

A file is a small file system (the compound file format) that holds the workbook as a stream of
records. Both formats are published by their maker; only what a table needs is read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

# The file's first bytes, and the numbers of the records that are read.
SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
BOUNDSHEET, SST, CONTINUE, END, MERGED = 0x85, 0xFC, 0x3C, 0x0A, 0xE5
LABEL_SST, LABEL, NUMBER, RK, MUL_RK, FORMULA, STRING, BOOL_ERR = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205
_NO_SECTOR = 0xFFFFFFFA  # from here on a sector number is a mark


def _stream(data: bytes, names: tuple[str, ...]) -> bytes:
    """The first of the named streams of a compound file."""
    size, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir, _, cutoff, first_mini, _, first_more, _ = struct.unpack_from("<7I", data, 48)
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    tables = list(struct.unpack_from("<109I", data, 76))
    seen = 0
    while first_more < _NO_SECTOR and seen <= len(data) // size:
        *more, first_more = struct.unpack(f"<{size // 4}I", sector(first_more))
        tables += more
        seen += 1
    fat: list[int] = []
    for n in tables:
        if n < _NO_SECTOR:
            fat += struct.unpack(f"<{size // 4}I", sector(n))

    def chain(n: int, table: list[int]) -> Iterator[int]:
        left = len(table)
        while n < _NO_SECTOR and left >= 0:
            yield n
            n, left = table[n], left - 1
        if left < 0:
            raise ValueError("workbook: its sectors run in a circle")

    read = lambda n: b"".join(map(sector, chain(n, fat)))
    folder = read(first_dir)
    found: dict[str, tuple[int, int]] = {}
    for at in range(0, len(folder), 128):
        length, kind = struct.unpack_from("<HB", folder, at + 64)
        if kind:
            name = folder[at : at + max(0, length - 2)].decode("utf-16-le")
            found.setdefault("" if kind == 5 else name, struct.unpack_from("<II", folder, at + 116))
    for name in names:
        if name in found:
            start, length = found[name]
            if length >= cutoff:
                return read(start)[:length]
            small, raw = read(found[""][0]), read(first_mini)
            table = list(struct.unpack(f"<{len(raw) // 4}I", raw))
            return b"".join(small[n * mini : (n + 1) * mini] for n in chain(start, table))[:length]
    raise ValueError("workbook: no sheets in this file")


def _records(book: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(book):
        kind, length = struct.unpack_from("<HH", book, at)
        yield kind, book[at + 4 : at + 4 + length]
        at += 4 + length


def _text(b: bytes, at: int, length: int) -> str:
    """A text of one record: a byte that tells the width of a character, then the characters."""
    wide = b[at] & 1
    return b[at + 1 : at + 1 + length * (1 + wide)].decode("utf-16-le" if wide else "latin-1")


def _shared(parts: list[bytes]) -> list[str]:
    """The shared texts. One may go on in the next record, which then tells its own width."""
    out: list[str] = []
    part, at = 0, 8

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while n:
            if at >= len(parts[part]):
                part, at = part + 1, 0
            piece = parts[part][at : at + n]
            got, at, n = got + piece, at + len(piece), n - len(piece)
        return got

    for _ in range(struct.unpack_from("<I", parts[0], 4)[0]):
        length, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        wide, text = flags & 1, ""
        while len(text) < length:
            if at >= len(parts[part]):
                part, at = part + 1, 1
                wide = parts[part][0] & 1
            n = min((length - len(text)) << wide, len(parts[part]) - at)
            text += parts[part][at : at + n].decode("utf-16-le" if wide else "latin-1")
            at += n
        take(4 * runs + extra)
        out.append(text)
    return out


def _packed_number(rk: int) -> float:
    x = float((rk ^ 0x80000000) - 0x80000000 >> 2) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return x / 100 if rk & 1 else x


def workbook(data: bytes, sheet: str | None, max_cells: int) -> tuple[list[str], list[list[str]], list[tuple[int, int, int, int]]]:
    """(sheet names, rows of texts, merged ranges as row and column bounds). Numbers are texts as Python writes a float."""
    book = _stream(data, ("Workbook", "Book"))
    sheets: dict[str, int] = {}
    shared: list[bytes] = []
    last = None
    for kind, b in _records(book, 0):
        if kind == BOUNDSHEET:
            sheets[_text(b, 7, b[6])] = struct.unpack_from("<I", b)[0]
        elif kind == SST or (kind == CONTINUE and last == SST):
            shared.append(b)
            kind = SST
        elif kind == END:
            break
        last = kind
    texts = _shared(shared) if shared else []
    cells: dict[tuple[int, int], str] = {}
    merged, waiting = [], None
    for kind, b in _records(book, sheets[sheet or next(iter(sheets))]):
        if kind == END:
            break
        if kind == MERGED:
            ranges = struct.unpack_from(f"<{4 * struct.unpack_from('<H', b)[0]}H", b, 2)
            merged += [(r0, r1 + 1, c0, c1 + 1) for r0, r1, c0, c1 in zip(*[iter(ranges)] * 4)]
            continue
        if kind == STRING and waiting:
            cells[waiting] = _text(b, 2, struct.unpack_from("<H", b)[0])
            waiting = None
            continue
        if kind not in (LABEL_SST, LABEL, NUMBER, RK, MUL_RK, FORMULA, BOOL_ERR):
            continue
        at = struct.unpack_from("<HH", b)
        if kind == LABEL_SST:
            cells[at] = texts[struct.unpack_from("<I", b, 6)[0]]
        elif kind == LABEL:
            cells[at] = _text(b, 8, struct.unpack_from("<H", b, 6)[0])
        elif kind == NUMBER:
            cells[at] = str(struct.unpack_from("<d", b, 6)[0])
        elif kind == RK:
            cells[at] = str(_packed_number(struct.unpack_from("<I", b, 6)[0]))
        elif kind == MUL_RK:
            for i in range((len(b) - 6) // 6):
                cells[at[0], at[1] + i] = str(_packed_number(struct.unpack_from("<I", b, 6 + 6 * i)[0]))
        elif kind == BOOL_ERR:
            cells[at] = str(b[6])
        elif b[12:14] != b"\xff\xff":
            cells[at] = str(struct.unpack_from("<d", b, 6)[0])
        elif b[6] == 0:
            waiting = at
        elif b[6] in (1, 2):
            cells[at] = str(b[8])
    height, width = (max((k[i] for k in cells), default=-1) + 1 for i in (0, 1))
    if height * width > max_cells:
        raise ValueError(f"sheet of more than {max_cells} cells")
    return list(sheets), [[cells.get((r, c), "").strip() for c in range(width)] for r in range(height)], merged
