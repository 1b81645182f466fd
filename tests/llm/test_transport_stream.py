from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from granary.llm import queries
from granary.llm import transport_stream as ts


def broken(media: bytes, packet: int, change) -> bytes:
    data = bytearray(media)
    part = memoryview(data)[packet * 188 : packet * 188 + 188]
    change(part)
    return bytes(data)


@pytest.mark.parametrize("size", [0, 1, 64, 156, 157, 158, 175, 176, 177, 340, 341, 342, 4020, 4021, 4022, 8042, 40_000, 1_000_003])
def test_round_trip(size):
    payload = random.Random(size).randbytes(size)
    media = ts.mux(payload)
    got = ts.demux(media)
    assert len(media) % 188 == 0 and media[::188] == b"G" * (len(media) // 188)
    assert only(got) == payload and media == ts.mux(payload)
    assert (got.bad_packets, got.crc_errors, got.continuity_errors) == (0, 0, 0)
    assert got.programs == [{"program": 1, "pmt_pid": 0x1000, "streams": [{"pid": 0x100, "type": 6}]}]
    assert [u["dts"] for u in got.units] == [90_000 + 3003 * k for k in range(len(got.units))]
    assert all(u["pts"] - u["dts"] == 6006 for u in got.units)
    assert [u["random_access"] for u in got.units] == [k % 8 == 0 for k in range(len(got.units))]


def only(stream):
    (one,) = stream.payloads
    return one["payload"]


def moved(packet, pid):
    """The packet under another PID."""
    return packet[:1] + bytes([packet[1] & 0xE0 | pid >> 8, pid & 255]) + packet[3:]


def test_streams_of_two_programs():
    """A second program, with its own table and PIDs, woven into the first one's packets."""
    payloads = [bytes(range(256)) * 30, b"second program" * 500]
    first, second = ([m[k : k + 188] for k in range(0, len(m), 188)] for m in map(ts.mux, payloads))
    pat = ts._section(0, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | p).to_bytes(2, "big") for n, p in ((1, 0x1000), (2, 0x1001))))
    pmt = ts._section(2, 2, (0xE200).to_bytes(2, "big") + b"\xf0\x00" + bytes([ts.STREAM_TYPE]) + (0xE200).to_bytes(2, "big") + b"\xf0\x00")
    other = [ts._table_packet(0x1001, pmt, p[3]) if p[1] & 31 == 0x10 else moved(p, 0x200) for p in second if (p[1] & 31, p[2]) != (0, 0)]
    own = [ts._table_packet(0, pat, p[3]) if (p[1] & 31, p[2]) == (0, 0) else p for p in first]
    woven = [p for k in range(max(len(own), len(other))) for p in (*own[k : k + 1], *other[k : k + 1])]
    got = ts.demux(b"".join(woven))
    assert (got.crc_errors, got.continuity_errors) == (0, 0)
    assert [(p["program"], p["pid"], p["payload"]) for p in got.payloads] == [(1, 0x100, payloads[0]), (2, 0x200, payloads[1])]
    assert [p["program"] for p in got.programs] == [1, 2] and {(u["program"], u["pid"]) for u in got.units} == {(1, 0x100), (2, 0x200)}


def test_known_section_crc():
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_lost_repeated_and_broken_packets():
    payload = bytes(range(256)) * 40
    media = ts.mux(payload)
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    lost = ts.demux(b"".join(packets[:5] + packets[6:]))
    assert lost.continuity_errors == 1 and len(only(lost)) == len(payload) - 184
    again = ts.demux(b"".join([*packets[:6], packets[5], *packets[6:]]))
    assert again.continuity_errors == 0 and only(again) == payload
    assert ts.demux(media[:-10]).bad_packets == 1
    unsynced = ts.demux(broken(media, 5, lambda p: p.__setitem__(0, 0)))
    assert (unsynced.bad_packets, unsynced.continuity_errors) == (1, 1)
    assert ts.demux(broken(media, 0, lambda p: p.__setitem__(13, 99))).crc_errors == 1
    assert ts.demux(b"").units == [] and ts.demux(None).payloads == []


def test_operators_on_odd_rows(spark, odd_docs, no_docs):
    streams = ts.write_transport_streams(odd_docs, "text", ["doc_id"])
    read = ts.read_transport_streams(streams, "media", ["doc_id"]).select("doc_id", F.col("payloads")[0]["payload"].cast("string").alias("text"), "continuity_errors")
    want = sorted(((r.doc_id, r.text or "", 0) for r in odd_docs.collect()), key=str)
    assert sorted(map(tuple, read.collect()), key=str) == want
    assert ts.read_transport_streams(ts.write_transport_streams(no_docs, "text", ["doc_id"]), "media", ["doc_id"]).count() == 0


def test_query_against_plain_python(spark, sf):
    import hashlib
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_transport_streams(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = ts.mux(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature.endswith("errors=0")
