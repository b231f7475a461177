"""Old workbooks, written here record by record."""

import struct

import pytest

from vdjloom.sources import discovery as D
from vdjloom.sources import xls


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def text(s, wide=False):
    return bytes([int(wide)]) + s.encode("utf-16-le" if wide else "latin-1")


def old_workbook(small=False):
    """A sheet with shared texts (one cut in two by a record's end), numbers of all kinds, a formula and a merged range."""
    names = ["group", "名", "long " * 3, "end"]
    sst = struct.pack("<II", 4, 4) + struct.pack("<H", 5) + text(names[0]) + struct.pack("<H", 1) + text(names[1], True)
    first = sst + struct.pack("<H", 15) + text(names[2][:6])
    more = text(names[2][6:], True) + struct.pack("<H", 3) + bytes([8]) + struct.pack("<H", 1) + names[3].encode() + bytes(4)
    rk = (25 << 2 | 2) & 0xFFFFFFFF
    cells = [
        record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)), record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)), record(0xFD, struct.pack("<HHHI", 1, 0, 0, 2)),
        record(0x203, struct.pack("<HHHd", 1, 1, 0, 7)), record(0x27E, struct.pack("<HHHI", 2, 1, 0, rk)), record(0xBD, struct.pack("<HHHIHIH", 3, 0, 0, rk | 1, 0, rk, 1)),
        record(0x06, struct.pack("<HHH", 4, 0, 0) + bytes([0, 0, 0, 0, 0, 0, 255, 255]) + bytes(6)), record(0x207, struct.pack("<H", 4) + text("made")),
        record(0x06, struct.pack("<HHHd", 4, 1, 0, 1.5) + bytes(6)), record(0x204, struct.pack("<HHHH", 5, 0, 0, 3) + text("old")), record(0x205, struct.pack("<HHHBB", 5, 1, 0, 1, 0)),
        record(0xFD, struct.pack("<HHHI", 6, 0, 0, 3)), record(0xE5, struct.pack("<H4H", 1, 1, 2, 0, 0)), record(0x0A, b""),
    ]
    head = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    where = len(head) + len(record(0x85, bytes(8 + 5))) + len(record(0xFC, first)) + len(record(0x3C, more)) + len(record(0x0A, b""))
    book = head + record(0x85, struct.pack("<IBBB", where, 0, 0, 5) + text("First")) + record(0xFC, first) + record(0x3C, more) + record(0x0A, b"")
    assert len(book) == where
    book += record(0x809, struct.pack("<HHHHII", 0x600, 16, 0, 0, 0, 0)) + b"".join(cells)
    length = len(book) if small else max(len(book), 4096)
    book = book.ljust(length, b"\0")

    def entry(name, kind, start, size):
        n = name.encode("utf-16-le") + b"\0\0"
        return n.ljust(64, b"\0") + struct.pack("<HB", len(n), kind) + bytes(49) + struct.pack("<II", start, size) + bytes(4)

    def sectors(b):
        return b.ljust(-(-len(b) // 512) * 512, b"\0")

    body = sectors(book)
    n = len(body) // 512
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    fat = [0xFFFFFFFD, end, end] + [i + 1 for i in range(3, 3 + n - 1)] + [end]
    fat += [free] * (128 - len(fat))
    mini = [i + 1 for i in range(-(-length // 64) - 1)] + [end]
    mini += [free] * (128 - len(mini))
    root = entry("Root Entry", 5, 3 if small else end, len(body) if small else 0)
    directory = sectors(root + entry("Workbook", 2, 0 if small else 3, length))
    header = xls.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<I", 1) + struct.pack("<7I", 1, 0, 4096, 2, 1, end, 0) + struct.pack("<109I", 0, *[free] * 108)
    return header + struct.pack("<128I", *fat) + directory + struct.pack("<128I", *mini) + body


@pytest.mark.parametrize("small", [False, True])
def test_old_workbook(spark, tmp_path, small):
    p = tmp_path / "w.xls"
    p.write_bytes(old_workbook(small))
    names, rows, merged = D.workbook(str(p))
    assert names == ["First"] and merged == [(1, 3, 0, 1)]
    assert rows == [["group", "名"], ["long long long", "7.0"], ["", "25.0"], ["0.25", "25.0"], ["made", "1.5"], ["old", "1"], ["end", ""]]
    got = [tuple(r) for r in D.sheet_table(spark, str(p)).orderBy("row_number").collect()]
    assert got[:2] == [(1, "long long long", "7.0"), (2, "long long long", "25.0")]


def test_broken_files():
    with pytest.raises((ValueError, KeyError, struct.error, IndexError)):
        xls.workbook(xls.SIGNATURE + bytes(600), None, 10)
    with pytest.raises(ValueError):
        xls.workbook(old_workbook(), None, 3)
