"""Byte layouts for exchange with other programs: records, blocks, sorted tables, archives and logs.  Tables stay columnar.

Numbers are little-endian; lengths and offsets are base-128 varints.  Everything here works on the bytes of one
file; :mod:`exchange` applies it to tables of files.
"""

from __future__ import annotations

import bisect
import struct
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa

from .errors import TORN, FormatError

# Fixed values of the layouts.
BLOCK = 4096
RESTART_EVERY = 16
TABLE_MAGIC = b"\x57\xfb\x80\x8b\x24\x75\x47\xdb"
TABLE_FOOTER = 48
SPACE_MARK = 42
CRC_POLYNOMIAL = 0x82F63B78
CRC_MASK = 0xA282EAD8


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(raw):
            raise FormatError(TORN)
        value |= (raw[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if raw[at - 1] < 128:
            return value, at


def crc_table() -> list[int]:
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (CRC_POLYNOMIAL if c & 1 else 0)
        table.append(c)
    return table


def masked_crc(raw: bytes, table: list[int]) -> int:
    c = 0xFFFFFFFF
    for b in raw:
        c = table[(c ^ b) & 255] ^ c >> 8
    c ^= 0xFFFFFFFF
    return ((c >> 15 | c << 17) + CRC_MASK) & 0xFFFFFFFF


# Blocks


class BlockWriter:
    """Collects bytes and cuts them into blocks: length, encoding, body; 1 is snappy, used where it is not larger, 0 is raw."""

    def __init__(self, size: int = BLOCK):
        self.size, self.head, self.snappy = size, "<H" if size < 1 << 16 else "<I" if size < 1 << 32 else "<Q", pa.Codec("snappy")
        self.waiting, self.out, self.count, self.drained = bytearray(), bytearray(), 0, 0

    @property
    def buffered(self) -> int:
        return len(self.waiting)

    @property
    def written(self) -> int:
        return self.drained + len(self.out)

    def drain(self) -> bytes:
        """The blocks since the last call, which are let go."""
        raw, self.out = bytes(self.out), bytearray()
        self.drained += len(raw)
        return raw

    def write(self, raw: bytes) -> None:
        self.waiting += raw
        self._cut(self.size)

    def flush(self) -> None:
        self._cut(0)

    def _cut(self, keep: int) -> None:
        # a full block waits until a byte follows it
        while len(self.waiting) > keep:
            part = bytes(self.waiting[: self.size])
            del self.waiting[: self.size]
            packed = self.snappy.compress(part, asbytes=True)
            kind, body = (1, packed) if len(packed) <= len(part) else (0, part)
            self.out += struct.pack(self.head, len(body)) + bytes([kind]) + body
            self.count += 1


class BlockReader:
    """Reads through blocks; ``seek`` goes to the start of a block by its place in the file."""

    def __init__(self, raw: bytes, size: int = BLOCK, at: int = 0):
        self.raw, self.head, self.snappy = raw, "<H" if size < 1 << 16 else "<I" if size < 1 << 32 else "<Q", pa.Codec("snappy")
        self.seek(at)

    def seek(self, at: int, whence: int = 0) -> None:
        if whence:
            raise ValueError("blocks are found from the start of the file only")
        self.next, self.held, self.place = at, b"", 0

    def _more(self) -> bool:
        if self.next >= len(self.raw):
            return False
        width = struct.calcsize(self.head)
        if self.next + width + 1 > len(self.raw):
            raise FormatError(TORN)
        (length,) = struct.unpack_from(self.head, self.raw, self.next)
        kind, body = self.raw[self.next + width], self.raw[self.next + width + 1 : self.next + width + 1 + length]
        if len(body) < length:
            raise FormatError(TORN)
        self.held, self.place = self.held[self.place :] + unpacked(kind, body, self.snappy), 0
        self.next += width + 1 + length
        return True

    def peek(self, n: int) -> bytes:
        """The next bytes, fewer at the end, without moving on."""
        while len(self.held) - self.place < n and self._more():
            pass
        return self.held[self.place : self.place + n]

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        self.place += len(out)
        return out

    def read_byte(self) -> int | None:
        one = self.read(1)
        return one[0] if one else None

    def read_number(self) -> int:
        value, used = read_varint(self.peek(10), 0)
        self.place += used
        return value


def unpacked(kind: int, body: bytes, snappy: pa.Codec) -> bytes:
    return snappy.decompress(body, decompressed_size=read_varint(body, 0)[0], asbytes=True) if kind else bytes(body)


class PieceReader(BlockReader):
    """Reads once through blocks of the standard size that come in pieces of any length, the first one at ``at``."""

    def __init__(self, pieces: Iterable[bytes], at: int):
        super().__init__(b"")
        self.found, self.starts, self.passed = self._blocks(pieces, at), deque(), 0

    def _blocks(self, pieces: Iterable[bytes], at: int) -> Iterator[tuple[int, bytes]]:
        rest = b""
        for piece in pieces:
            raw, place = rest + piece, 0
            while place + 3 <= len(raw) and (end := place + 3 + struct.unpack_from("<H", raw, place)[0]) <= len(raw):
                yield at, unpacked(raw[place + 2], raw[place + 3 : end], self.snappy)
                place, at = end, at + end - place
            rest = raw[place:]
        if rest:
            raise FormatError(TORN)

    def seek(self, at: int, whence: int = 0) -> None:
        if at or whence:
            raise ValueError("pieces are read once and in order")
        self.held, self.place = b"", 0

    def _more(self) -> bool:
        start, body = next(self.found, (None, b""))
        if start is None:
            return False
        self.starts.append(start)
        self.held, self.place = self.held[self.place :] + body, 0
        return True

    def start(self, block: int) -> int:
        """Where a block lies; blocks before it are not asked for again."""
        while self.passed < block:
            self.starts.popleft()
            self.passed += 1
        return self.starts[0]


def blocks(raw: bytes, size: int = BLOCK) -> bytes:
    w = BlockWriter(size)
    w.write(raw)
    w.flush()
    return bytes(w.out)


def read_blocks(raw: bytes, size: int = BLOCK) -> bytes:
    reader, parts = BlockReader(raw, size), []
    while part := reader.read(1 << 16):
        parts.append(part)
    return b"".join(parts)


# Sorted tables


class TableWriter:
    """A sorted table: blocks of prefix-compressed entries, an index block, a footer.  Keys must rise."""

    def __init__(self):
        self.out, self.crc, self.last, self.index = bytearray(), crc_table(), b"", []
        self._start()

    def _start(self) -> None:
        self.block, self.restarts, self.n = bytearray(), [], 0

    def _entry(self, key: bytes, value: bytes, restart: bool) -> None:
        shared = 0
        if restart:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(self.last), len(key)) and self.last[shared] == key[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1

    def _end(self) -> tuple[int, int]:
        raw = bytes(self.block) + struct.pack(f"<{max(1, len(self.restarts)) + 1}I", *(self.restarts or [0]), max(1, len(self.restarts)))
        at = len(self.out)
        self.out += raw + b"\0" + struct.pack("<I", masked_crc(raw + b"\0", self.crc))
        self._start()
        return at, len(raw)

    def set(self, key: bytes, value: bytes) -> None:
        if key <= self.last:
            raise ValueError("keys must rise, and the empty key is none")
        self._entry(key, value, self.n % RESTART_EVERY == 0)
        if len(self.block) + 4 * (len(self.restarts) + 1) >= BLOCK:
            self.index.append((key, self._end()))

    def close(self) -> bytes:
        if self.n or not self.index:
            last = self.last
            self.index.append((last, self._end()))
        meta = self._end()
        for key, (at, size) in self.index:  # a block is found by its last key
            self._entry(key, varint(at) + varint(size), True)
        index = self._end()
        handles = b"".join(varint(x) for x in (*meta, *index))
        self.out += handles + b"\0" * (TABLE_FOOTER - len(TABLE_MAGIC) - len(handles)) + TABLE_MAGIC
        return bytes(self.out)


class TableReader:
    def __init__(self, raw: bytes):
        if len(raw) < TABLE_FOOTER or raw[-len(TABLE_MAGIC) :] != TABLE_MAGIC:
            raise FormatError("the footer is not a sorted table's")
        self.raw, self.crc = raw, crc_table()
        at, handles = 0, []
        for _ in range(4):
            value, at = read_varint(raw[-TABLE_FOOTER:], at)
            handles.append(value)
        self.index = list(self._block(*handles[2:]))

    def _block(self, at: int, size: int) -> Iterator[tuple[bytes, bytes]]:
        raw = self.raw[at : at + size + 5]
        if len(raw) < size + 5 or struct.unpack("<I", raw[-4:])[0] != masked_crc(raw[:-4], self.crc):
            raise FormatError("a block does not match its checksum")
        (n,) = struct.unpack_from("<I", raw, size - 4)
        end, at, key = size - 4 - 4 * n, 0, b""
        while at < end:
            shared, at = read_varint(raw, at)
            own, at = read_varint(raw, at)
            length, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            yield key, raw[at + own : at + own + length]
            at += own + length

    def find(self, key: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        """Entries from the first key that is not below ``key``; blocks before it are not read."""
        first = bisect.bisect_left([k for k, _ in self.index], key)
        for _, handle in self.index[first:]:
            at, used = read_varint(handle, 0)
            size, _ = read_varint(handle, used)
            for found, value in self._block(at, size):
                if found >= key:
                    yield found, value

    def get(self, key: bytes) -> bytes | None:
        found, value = next(self.find(key), (None, None))
        return value if found == key else None


# Archives


def event_block(events: list[tuple[bytes, int]]) -> bytes:
    """(data, timestamp) pairs, newest first with ties as given, then the zero that ends the list."""
    newest_first = sorted(events, key=lambda e: -e[1])
    return b"".join(varint(len(d)) + struct.pack("<I", ts & 0xFFFFFFFF) + d for d, ts in newest_first) + b"\0"


def space_bytes(events: Iterable[tuple[str, int, bytes, dict[str, str]]]) -> bytes:
    """A space's section, from (grouping, ts, data, indexes) in insertion order."""
    sections: dict[bytes, list] = {}
    for event in [[grouping, ts, data, indexes, None] for grouping, ts, data, indexes in events]:
        for key in ("g" + event[0], *[f"i{name}:{value}" for name, value in event[3].items()]):
            sections.setdefault(key.encode(), []).append(event)
    out, table = bytearray([SPACE_MARK]), TableWriter()
    for key in sorted(sections):
        writer, at = BlockWriter(), len(out)
        for event in sorted(sections[key], key=lambda e: -e[1]):
            if key[:1] == b"g":
                event[4] = (at + writer.written, writer.buffered)
                writer.write(varint(len(event[2])) + struct.pack("<I", event[1] & 0xFFFFFFFF) + event[2])
            else:
                writer.write(struct.pack("<qH", *event[4]))
        writer.write(b"\0")
        writer.flush()
        table.set(key, varint(at) + varint(len(writer.out)))
        out += writer.out
    index = table.close()
    return bytes(out) + index + struct.pack("<q", len(index))


def archive_bytes(spaces: dict[str, list]) -> bytes:
    out, table = bytearray(), TableWriter()
    for space in sorted(spaces, key=str.encode):
        body = space_bytes(spaces[space])
        table.set(space.encode(), struct.pack("<qq", len(out), len(body)))
        out += body
    index = table.close()
    return bytes(out) + index + struct.pack("<q", len(index))


def trailer(table: TableWriter) -> bytes:
    index = table.close()
    return index + struct.pack("<q", len(index))


def archive_pieces(sections: Iterable[tuple[str, bytes, bytes]]) -> Iterator[bytes]:
    """An archive file in pieces, from (space, key, bytes) of its sections in order; a section may come in several."""
    at, spaces = 0, TableWriter()
    for space, own in groupby(sections, key=lambda s: s[0]):
        start, table = at, TableWriter()
        yield bytes([SPACE_MARK])
        at += 1
        for key, parts in groupby(own, key=lambda s: s[1]):
            begin = at
            for part in parts:
                at += len(part[2])
                yield part[2]
            table.set(key, varint(begin - start) + varint(at - begin))
        end = trailer(table)
        at += len(end)
        yield end
        spaces.set(space.encode(), struct.pack("<qq", start, at - start))
    yield trailer(spaces)


def trailing_table(raw: bytes) -> TableReader:
    return table_at(lambda low, high: raw[low:high], 0, len(raw))


def table_at(get, low: int, high: int) -> TableReader:
    """The table that the bytes from ``low`` to ``high`` end with; ``get`` gives the bytes of a range."""
    if high - low < 8:
        raise FormatError("the file is too short for an index")
    (size,) = struct.unpack("<q", get(high - 8, high))
    if not 0 < size <= high - low - 8:
        raise FormatError("the index length does not fit the file")
    return TableReader(get(high - 8 - size, high - 8))


class Backwards:
    """A file whose parts (offset, bytes) come from the last to the first; ranges are asked for from the end on."""

    def __init__(self, parts: Iterable[tuple[int, bytes]]):
        self.parts, self.held = iter(parts), []
        self.low, raw = next(self.parts)
        self.held.append((self.low, raw))
        self.end = self.top = self.low + len(raw)

    def get(self, low: int, high: int) -> bytes:
        if not 0 <= low <= high <= self.top:
            raise FormatError("the tables of the file do not fit together")
        self.top = high
        self.held = [p for p in self.held if p[0] < high]
        while self.low > low:
            at, raw = next(self.parts, (0, b""))
            if at + len(raw) != self.low:
                raise FormatError("a part of the file is missing")
            self.low = at
            if at < high:
                self.held.append((at, raw))
        start = self.held[-1][0] if self.held else low
        return b"".join(raw for _, raw in reversed(self.held))[low - start : high - start]


def archive_sections(parts: Iterable[tuple[int, bytes]]) -> Iterator[tuple[str, bytes, int, int, int]]:
    """(space, key, where the space begins, where in it the section, its size), from the parts of a file, the last one first.

    Only tables are held: the file's, and one space's at a time.
    """
    file = Backwards(parts)
    spaces = [(*struct.unpack("<qq", where), space.decode()) for space, where in table_at(file.get, 0, file.end).find()]
    for base, size, space in sorted(spaces, reverse=True):
        table = table_at(file.get, base, base + size)
        if file.get(base, base + 1) != bytes([SPACE_MARK]):
            raise FormatError("a space does not start with its mark")
        for key, where in table.find():
            yield space, key, base, *_pair(where)


def section_events(pieces: Iterable[bytes], at: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(block, byte in it, place, ts, data) of the events of a grouping's section that begins at ``at``."""
    reader, passed, place = PieceReader(pieces, at), 0, 0
    while len(reader.peek(1)):
        # the block that was being filled when the event was written: a full one counts until a byte follows
        block = max(0, -(-passed // BLOCK) - 1)
        where = (reader.start(block), passed - BLOCK * block)
        length = reader.read_number()
        if not length:
            break
        (ts,) = struct.unpack("<I", reader.read(4))
        data = reader.read(length)
        if len(data) < length:
            raise FormatError(TORN)
        passed += len(varint(length)) + 4 + length
        place += 1
        yield *where, place, ts, data


def section_entries(pieces: Iterable[bytes], at: int) -> Iterator[tuple[int, int]]:
    """(block, byte in it) of the events of an index key's section."""
    reader = PieceReader(pieces, at)
    while len(entry := reader.read(10)) == 10:  # then the zero that ends the list
        yield struct.unpack("<qH", entry)


def read_space(raw: bytes) -> Iterator[tuple[str, int, int, bytes, list[str]]]:
    """(grouping, place in it, ts, data, index keys) of a space's events."""
    if not raw or raw[0] != SPACE_MARK:
        raise FormatError("a space does not start with its mark")
    on: dict[tuple[int, int], list[str]] = {}
    sections = [(k.decode(), *_pair(v)) for k, v in trailing_table(raw).find()]
    for key, at, size in sections:
        if key[0] == "i":
            reader, end = BlockReader(raw[: at + size], at=at), False
            while not end:
                entry = reader.peek(10)
                end = len(entry) < 10  # the zero that ends the list
                if not end:
                    on.setdefault(struct.unpack("<qH", reader.read(10)), []).append(key[1:])
    for key, at, size in sections:
        if key[0] != "g":
            continue
        reader, starts, passed, place = BlockReader(raw[: at + size], at=at), [at], 0, 0
        while len(reader.peek(1)):
            # the block that was being filled when the event was written: a full one counts until a byte follows
            while passed > BLOCK * len(starts):
                starts.append(starts[-1] + 3 + struct.unpack_from("<H", raw, starts[-1])[0])
            where = (starts[-1], passed - BLOCK * (len(starts) - 1))
            length = reader.read_number()
            if not length:
                break
            (ts,) = struct.unpack("<I", reader.read(4))
            data = reader.read(length)
            passed += len(varint(length)) + 4 + length
            place += 1
            yield key[1:], place, ts, data, on.get(where, [])


def _pair(raw: bytes) -> tuple[int, int]:
    a, at = read_varint(raw, 0)
    return a, read_varint(raw, at)[0]


def read_archive(raw: bytes) -> Iterator[tuple]:
    """(space, grouping, place, ts, data, index keys) of every event."""
    for space, where in trailing_table(raw).find():
        at, size = struct.unpack("<qq", where)
        for event in read_space(raw[at : at + size]):
            yield space.decode(), *event


# Logs


def serialize(data: bytes, indexes: dict[str, str], tails: dict[str, int]) -> bytes:
    """A log record: its length, the data, and for every index key the offset of the older record."""
    keys = sorted({f"{name}:{value}" for name, value in indexes.items()})
    body = varint(len(data)) + data + varint(len(keys))
    for key in keys:
        raw = key.encode()
        body += varint(len(raw)) + raw + varint(tails.get(key, 0))
    return struct.pack("<I", len(body)) + body


def deserialize(raw: bytes) -> tuple[bytes, dict[str, int]]:
    if len(raw) < 4:
        raise FormatError(TORN)
    (size,) = struct.unpack_from("<I", raw)
    if len(raw) < 4 + size:
        raise FormatError(TORN)
    length, at = read_varint(raw, 4)
    data, at = raw[at : at + length], at + length
    n, at = read_varint(raw, at)
    offsets = {}
    for _ in range(n):
        size, at = read_varint(raw, at)
        key, at = raw[at : at + size].decode(), at + size
        offsets[key], at = read_varint(raw, at)
    return data, offsets


def records(raw: bytes, mode: str = "FAILFAST", at: int = 0) -> Iterator[tuple[int, bytes, dict[str, int]]]:
    """(offset, data, older offsets) of records in a row, up to a length of zero; a torn last one is an error, or with ``DROP_TAIL`` it is left out."""
    if mode not in ("FAILFAST", "DROP_TAIL"):
        raise ValueError(f"unknown mode {mode}")
    while at < len(raw):
        try:
            size = struct.unpack_from("<I", raw, at)[0] if len(raw) - at >= 4 else None
            if size == 0:
                return
            found = deserialize(raw[at : at + 4 + (size or 0)] if size is not None else raw[at:])
        except FormatError:
            if mode == "DROP_TAIL":
                return
            raise
        yield at, *found
        at += 4 + size


#: What logs begin and, once sealed, end with; files of other programs have their own, which is passed instead.
LOG_HEADER, LOG_FOOTER = b"tidelog-log", b"tidelog-sealed"


def log_bytes(events: Iterable[tuple[bytes, dict[str, str]]], seal: bool = True, header: bytes = LOG_HEADER, footer: bytes = LOG_FOOTER) -> bytes:
    """A log file of (data, indexes); sealed, it ends with the table of its tails."""
    out, tails = bytearray(header), {}
    for data, indexes in events:
        at, record = len(out), serialize(data, indexes, tails)
        out += record
        tails |= {f"{name}:{value}": at for name, value in indexes.items()}
    if seal:
        table = TableWriter()
        for key in sorted(tails, key=str.encode):
            table.set(key.encode(), varint(tails[key]))
        index = table.close()
        out += b"\0\0\0\0" + index + struct.pack("<q", len(index)) + footer
    return bytes(out)


def read_log(raw: bytes, mode: str = "FAILFAST", header: bytes = LOG_HEADER) -> Iterator[tuple[int, bytes, dict[str, int]]]:
    if raw[: len(header)] != header:
        raise FormatError("the header is not a log's")
    yield from records(raw, mode, len(header))


def log_tails(raw: bytes, footer: bytes = LOG_FOOTER) -> dict[str, int] | None:
    """The table of tails of a sealed log, None for one that is open."""
    if raw[-len(footer) :] != footer:
        return None
    return {k.decode(): read_varint(v, 0)[0] for k, v in trailing_table(raw[: -len(footer)]).find()}
