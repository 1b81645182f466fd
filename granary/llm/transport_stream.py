"""MPEG transport streams as a media column.

`write_transport_streams` stores a binary column losslessly in transport-stream packets: program
tables (PAT, PMT) before each random-access point, then packetised elementary packets (PES) with
presentation and decoding time stamps, a clock reference and the random-access flag in the
adaptation field, continuity counters, and stuffing in the last packet of each PES.

`read_transport_streams` parses any stream of 188-byte packets: it reads the program tables and
checks their CRC, checks continuity counters for each PID, reassembles the PES of
every program's streams, and returns their time stamps with their random-access points, and one
payload for each program and PID.

Defined results: a null media value gives a row with zero counts and empty lists;
so does an empty one. Packets without the sync byte, and a cut last packet, are counted in
bad_packets and passed over. A payload packet that repeats its predecessor is taken once; any other
jump of the counter without the discontinuity flag counts as a continuity error, and the bytes are
kept. Equal payloads give equal streams. Rows don't depend on each other, so repeated rows and ties
give repeated results; an empty table gives an empty one. Input columns other than the id (and
those named in `keep`) are left behind, so their names can't clash. A stream is held whole in one
worker, as its value in the column is; batches are cut to a bounded number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import encoded, pieces

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC = 188, 0x47
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES
CLOCK = 90_000

PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
#: PES header with both time stamps; packets of a whole access unit; bytes of data in it, so that none needs stuffing.
_HEADER, _PACKETS = 19, 22
_UNIT = 176 - _HEADER + 184 * (_PACKETS - 1)
_FRAME_TICKS, _UNITS_PER_GROUP = 3_003, 8


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section with its CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


_PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0])
    return (head + section).ljust(PACKET, b"\xff")


def _stamp(marker: int, ticks: np.ndarray) -> np.ndarray:
    t = ticks.astype(np.int64)
    return np.stack([marker << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1], axis=-1).astype(np.uint8)


def _clock_field(dst: np.ndarray, length: int, key: np.ndarray, ticks: np.ndarray) -> None:
    """Adaptation field of `length` bytes after its length byte: flags, clock reference, stuffing."""
    dst[:, 4], dst[:, 5] = length, np.where(key, 0x50, 0x10)
    for k in range(4):
        dst[:, 6 + k] = (ticks >> (25 - 8 * k)) & 255
    dst[:, 10], dst[:, 11] = (ticks & 1) << 7 | 0x7E, 0
    dst[:, 12 : 5 + length] = 255


def _headers(first: int, sizes: np.ndarray) -> np.ndarray:
    """PES headers of consecutive access units."""
    out = np.zeros((len(sizes), _HEADER), np.uint8)
    out[:, 2], out[:, 3] = 1, STREAM_ID
    out[:, 4], out[:, 5] = (sizes + 13) >> 8, (sizes + 13) & 255
    number = first + np.arange(len(sizes))
    out[:, 6], out[:, 7], out[:, 8] = np.where(number % _UNITS_PER_GROUP == 0, 0x84, 0x80), 0xC0, 10
    dts = CLOCK + number * _FRAME_TICKS
    out[:, 9:14], out[:, 14:19] = _stamp(3, dts + 2 * _FRAME_TICKS), _stamp(1, dts)
    return out


def _unit_packets(first: int, data: np.ndarray) -> np.ndarray:
    """Packets of access units of equal size: (units, packets, 188), without continuity counters."""
    n, size = data.shape
    total = _HEADER + size
    count = 1 + max(0, -(-(total - 176) // 184))
    out = np.full((n, count, PACKET), 255, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2], out[:, :, 3] = SYNC, ES_PID >> 8, ES_PID & 255, 0x10
    out[:, 0, 1] |= 0x40
    out[:, 0, 3] = 0x30
    number = first + np.arange(n)
    _clock_field(out[:, 0], max(7, 183 - total), number % _UNITS_PER_GROUP == 0, CLOCK + number * _FRAME_TICKS)
    body = np.concatenate([_headers(first, np.full(n, size)), data], axis=1)
    head = min(total, 176)
    out[:, 0, PACKET - head :] = body[:, :head]
    for k in range(1, count):
        part = body[:, head + 184 * (k - 1) : head + 184 * k]
        if (gap := 184 - part.shape[1]) > 0:
            out[:, k, 3], out[:, k, 4] = 0x30, gap - 1
            if gap > 1:
                out[:, k, 5] = 0
        out[:, k, 4 + gap :] = part
    return out


def mux(payload: bytes) -> bytes:
    """The payload as one program with one elementary stream; an empty payload is one empty unit."""
    whole, rest = divmod(len(payload), _UNIT)
    data = np.frombuffer(payload, np.uint8)
    units = []
    if whole:
        units.append(_unit_packets(0, data[: whole * _UNIT].reshape(whole, _UNIT)).reshape(-1, PACKET))
    if rest or not whole:
        units.append(_unit_packets(whole, data[whole * _UNIT :].reshape(1, rest)).reshape(-1, PACKET))
    packets = np.concatenate(units)
    packets[:, 3] |= (np.arange(len(packets)) & 15).astype(np.uint8)
    out, group = [], _UNITS_PER_GROUP * _PACKETS
    for k, at in enumerate(range(0, len(packets), group)):
        out += [_table_packet(0, _PAT, k), _table_packet(PMT_PID, _PMT, k), packets[at : at + group].tobytes()]
    return b"".join(out)


@dataclass
class Stream:
    packets: int = 0
    bad_packets: int = 0
    crc_errors: int = 0
    continuity_errors: int = 0
    programs: list[dict] = field(default_factory=list)
    units: list[dict] = field(default_factory=list)
    payloads: list[dict] = field(default_factory=list)


def _sections(chunks: list[bytes], stream: Stream) -> list[bytes]:
    """Whole sections with a right CRC, from each run of packets that begins with a pointer field."""
    out = []
    for chunk in chunks:
        at = 1 + chunk[0] if chunk else 0
        while at + 3 <= len(chunk) and chunk[at] != 0xFF:
            size = 3 + ((chunk[at + 1] & 15) << 8 | chunk[at + 2])
            section = chunk[at : at + size]
            if len(section) < size or crc32_mpeg(section):
                stream.crc_errors += 1
                break
            out.append(section)
            at += size
    return out


def _ticks(es: np.ndarray, at: np.ndarray) -> np.ndarray:
    b = [es[at + k].astype(np.int64) for k in range(5)]
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def demux(media: bytes | None) -> Stream:
    out = Stream()
    raw = np.frombuffer(media or b"", np.uint8)
    whole = len(raw) // PACKET
    out.bad_packets = int(len(raw) % PACKET > 0)
    p = raw[: whole * PACKET].reshape(whole, PACKET)
    good = p[:, 0] == SYNC
    out.packets, out.bad_packets = int(good.sum()), out.bad_packets + int(whole - good.sum())
    p = p[good]
    pid = (p[:, 1] & 31).astype(np.int64) << 8 | p[:, 2]
    start, counter = p[:, 1] & 0x40 > 0, p[:, 3] & 15
    adapted, loaded = p[:, 3] & 0x20 > 0, p[:, 3] & 0x10 > 0
    offset = np.where(adapted, 5 + p[:, 4].astype(np.int64), 4)
    loaded &= offset < PACKET
    flags = np.where(adapted & (p[:, 4] > 0), p[:, 5], 0)
    keep = np.flatnonzero(loaded)
    order = keep[np.argsort(pid[keep], kind="stable")]
    same = np.concatenate([[False], pid[order][1:] == pid[order][:-1]]) if len(order) else np.zeros(0, bool)
    step = np.concatenate([[1], (counter[order][1:].astype(np.int64) - counter[order][:-1]) & 15]) if len(order) else np.zeros(0, np.int64)
    again = np.zeros(len(order), bool)
    for i in np.flatnonzero(same & (step == 0)):
        again[i] = bool((p[order[i]] == p[order[i - 1]]).all())
    out.continuity_errors = int((same & (step != 1) & ~again & (flags[order] & 0x80 == 0)).sum())
    order = order[~again]

    def of(number: int) -> np.ndarray:
        return order[pid[order] == number]

    def chunks(number: int) -> list[bytes]:
        found: list[bytes] = []
        for i in of(number):
            body = p[i, offset[i] :].tobytes()
            if start[i]:
                found.append(body)
            elif found:
                found[-1] += body
        return found

    tables: dict[int, int] = {}
    for section in _sections(chunks(0), out):
        if section[0] == 0:
            for at in range(8, len(section) - 4, 4):
                number = section[at] << 8 | section[at + 1]
                if number:
                    tables[number] = (section[at + 2] & 31) << 8 | section[at + 3]
    streams: list[tuple[int, int]] = []
    for number, where in sorted(tables.items()):
        found: dict[int, int] = {}
        for section in _sections(chunks(where), out):
            if section[0] == 2 and section[3] << 8 | section[4] == number:
                at = 12 + ((section[10] & 15) << 8 | section[11])
                while at + 5 <= len(section) - 4:
                    found[(section[at + 1] & 31) << 8 | section[at + 2]] = section[at]
                    at += 5 + ((section[at + 3] & 15) << 8 | section[at + 4])
        out.programs.append({"program": number, "pmt_pid": where, "streams": [{"pid": k, "type": v} for k, v in sorted(found.items())]})
        streams += [(number, k) for k in sorted(found)]
    for program, number in streams:
        parts = []
        own = of(number)
        sizes = PACKET - offset[own]
        es = p[own][np.arange(PACKET) >= offset[own][:, None]]
        places = np.cumsum(sizes) - sizes
        begins = places[start[own]]
        ends = np.append(begins[1:], len(es))
        room = ends - begins >= 9
        begins, ends, first = begins[room], ends[room], own[start[own]][room]
        real = (es[begins] == 0) & (es[begins + 1] == 0) & (es[begins + 2] == 1) if len(begins) else np.zeros(0, bool)
        begins, ends, first = begins[real], ends[real], first[real]
        have, extra = es[begins + 7] >> 6, es[begins + 8].astype(np.int64)
        padded = np.append(es, np.zeros(32, np.uint8))
        pts = np.where(have >= 2, _ticks(padded, begins + 9), -1)
        dts = np.where(have == 3, _ticks(padded, begins + 14), pts)
        for a, b, more, x, y, i in zip(begins.tolist(), ends.tolist(), extra.tolist(), pts.tolist(), dts.tolist(), first.tolist(), strict=True):
            data = es[a + 9 + more : b].tobytes()
            out.units.append({"program": program, "pid": number, "pts": x, "dts": y, "random_access": bool(flags[i] & 0x40), "packet": i, "length": len(data)})
            parts.append(data)
        out.payloads.append({"program": program, "pid": number, "payload": b"".join(parts)})
    return out


_STREAMS = pa.list_(pa.struct([("pid", pa.int32()), ("type", pa.int32())]))
_PROGRAMS = pa.list_(pa.struct([("program", pa.int32()), ("pmt_pid", pa.int32()), ("streams", _STREAMS)]))
_UNITS = pa.list_(pa.struct([("program", pa.int32()), ("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("packet", pa.int64()), ("length", pa.int64())]))
_PAYLOADS = pa.list_(pa.struct([("program", pa.int32()), ("pid", pa.int32()), ("payload", pa.binary())]))
_READ = (
    "packets long, bad_packets long, crc_errors long, continuity_errors long, "
    "programs array<struct<program:int,pmt_pid:int,streams:array<struct<pid:int,type:int>>>>, "
    "units array<struct<program:int,pid:int,pts:long,dts:long,random_access:boolean,packet:long,length:long>>, "
    "payloads array<struct<program:int,pid:int,payload:binary>>"
)


def _kept(df: DataFrame, keep: list[str], column: str, to: str) -> tuple[DataFrame, str]:
    source = df.select(*keep, F.col(column).alias(to))
    return source, "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)


def write_transport_streams(df: DataFrame, payload_col: str, keep: list[str]) -> DataFrame:
    """The columns of `keep` and `media`, a transport stream that holds the payload (null: empty)."""
    source, schema = _kept(df, keep, payload_col, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "media"):
            media = pa.array([mux(x) for x in encoded(piece.column("media"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), media], names=[*keep, "media"])

    return source.mapInArrow(run, f"{schema}media binary")


def read_transport_streams(df: DataFrame, media_col: str, keep: list[str]) -> DataFrame:
    """The columns of `keep` and what the stream holds: program tables, errors, units, and the payload of each program and PID."""
    source, schema = _kept(df, keep, media_col, "__media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "__media"):
            got = [demux(x) for x in piece.column("__media").to_pylist()]
            counts = ["packets", "bad_packets", "crc_errors", "continuity_errors"]
            arrays = [pa.array([getattr(x, c) for x in got], pa.int64()) for c in counts]
            arrays += [pa.array([x.programs for x in got], _PROGRAMS), pa.array([x.units for x in got], _UNITS), pa.array([x.payloads for x in got], _PAYLOADS)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *arrays], names=[*keep, *counts, "programs", "units", "payloads"])

    return source.mapInArrow(run, schema + _READ)
