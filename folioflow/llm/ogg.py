"""Ogg media columns: texts' bytes stored as 8-bit samples in an Ogg file, and the reader of such files.

The file multiplexes two logical streams; even packets go to the first, odd ones to the second. A
packet holds ``PACKET`` samples, a page carries up to 255 lacing values, packets continue over pages,
and a page's granule position counts the samples of its own stream up to the last packet that ends
on it (-1 if none does). The first packet of each stream is a header: magic, version, channel,
channels, sample rate.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm.common import ship
from folioflow.llm.kernels import buffers

PACKET, RATE, CHANNELS = 4096, 8000, 2
MAGIC = b"PCM8raw\x00"
_HEADER = struct.Struct("<8sBBBxI")
_PAGE = struct.Struct("<4sBBqIIIB")
#: Ogg's CRC is that of zlib with bits in the other order, from 0 and not inverted.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """The checksum of a page whose checksum field is zero: polynomial 0x04c11db7, no reflection, from 0."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    page = head + lacing + body
    return page[:22] + page_crc(page).to_bytes(4, "little") + page[26:]


def _pages(serial: int, channel: int, packets: list[bytes]) -> Iterator[bytes]:
    """The pages of one logical stream: its header alone on the first, as Ogg wants it."""
    yield _page(serial, 0, 2, 0, bytes([_HEADER.size]), _HEADER.pack(MAGIC, 1, channel, CHANNELS, RATE))
    lacing, body, number, granule, ends, going = bytearray(), bytearray(), 1, 0, -1, False
    for packet in packets:
        laces = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        for lace in laces:
            if len(lacing) == 255:
                yield _page(serial, number, int(going), ends, bytes(lacing), bytes(body))
                number, going, ends = number + 1, at > 0, -1
                lacing.clear()
                body.clear()
            lacing.append(lace)
            body += packet[at : at + lace]
            at += lace
        granule += len(packet)
        ends = granule
    yield _page(serial, number, int(going) | 4, ends if packets else 0, bytes(lacing), bytes(body))


def encode(payload: bytes, serial: int = 1) -> bytes:
    """The Ogg file of the payload: its packets dealt to two multiplexed streams."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    streams = [list(_pages(serial + c, c, packets[c::CHANNELS])) for c in range(CHANNELS)]
    heads = [s.pop(0) for s in streams]
    mixed = [s[i] for i in range(max(map(len, streams))) for s in streams if i < len(s)]
    return b"".join(heads + mixed)


class Damaged(ValueError):
    """The file breaks a rule of the container."""


def demux(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Per serial its packets and each packet's end in samples, from checked pages.

    Raises Damaged for a wrong checksum or capture pattern, a missing page, or a packet that never ends.
    """
    at, streams, open_, pages = 0, {}, {}, {}
    while at < len(data):
        if len(data) - at < 27:
            raise Damaged("cut page header")
        magic, version, flags, granule, serial, number, crc, n = _PAGE.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise Damaged("no page here")
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        page = data[at : at + size]
        if len(page) < size or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise Damaged("wrong checksum")
        if number != pages.get(serial, -1) + 1 or bool(flags & 2) != (number == 0) or bool(flags & 1) != bool(open_.get(serial)):
            raise Damaged("missing page")
        pages[serial] = number
        packets, part, pos, done = streams.setdefault(serial, []), bytearray(open_.get(serial) or b""), 27 + n, []
        for lace in lacing:
            part += page[pos : pos + lace]
            pos += lace
            if lace < 255:
                done.append(bytes(part))
                part = bytearray()
        open_[serial] = bytes(part)
        end = granule  # of the last packet that ends here; those before it end where the next begins
        ends = []
        for packet in reversed(done):
            ends.append(end)
            end -= len(packet)
        packets += zip(done, reversed(ends), strict=True)
        at += size
    if any(open_.values()):
        raise Damaged("cut packet")
    return streams


def decode(data: bytes) -> tuple[bytes, dict]:
    """The payload and what the streams tell: packets, pages' timing and rate."""
    byserial = demux(data)
    streams = {}
    for packets in byserial.values():
        if not packets:
            raise Damaged("no header")
        magic, _, channel, channels, rate = _HEADER.unpack(packets[0][0])
        if magic != MAGIC:
            raise Damaged("another codec")
        streams[channel] = (packets[1:], channels, rate)
    if sorted(streams) != list(range(next(iter(streams.values()))[1])):
        raise Damaged("missing stream")
    order = [streams[c][0] for c in sorted(streams)]
    parts = [s[i][0] for i in range(max(map(len, order))) for s in order if i < len(s)]
    samples = [s[-1][1] if s else 0 for s in order]
    if samples != [sum(len(p) for p, _ in s) for s in order]:
        raise Damaged("granule positions and packets differ")
    return b"".join(parts), {"packets": len(parts), "rate": streams[0][2], "samples": samples, "seconds": max(samples) / streams[0][2]}


def padded(text: bytes, unit: int = 64) -> bytes:
    """The text's bytes with zeros up to a positive multiple of ``unit``."""
    return text + bytes((-len(text)) % unit or (unit if not text else 0))


def feature(payload: bytes, told: dict) -> str:
    """Figures of the samples: duration, mean, root mean square around the middle, zero crossings."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"packets={told['packets']};ms={int(told['seconds'] * 1000)};mean={int(x.sum()) * 1000 // len(x)};ms2={int((x * x).sum()) // len(x)};zc={crossings}"


SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, feature string"


def media_column(docs: DataFrame) -> DataFrame:
    """Per document the Ogg file of its text, and what is read back from that file.

    A null or empty text is stored as 64 zero bytes. Equal texts give equal files: nothing but the
    text enters. A file that does not read back raises, and with it the task.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                data, off = buffers(part.column(1))
                rows: list[list] = [[], [], [], []]
                raw = data.tobytes()
                for a, b in zip(off[:-1], off[1:], strict=True):
                    media = encode(padded(raw[a:b]))
                    payload, told = decode(media)
                    for values, v in zip(rows, (int(b - a), media, payload, feature(payload, told)), strict=True):
                        values.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.string())], names=["doc_id", "n_bytes", "media", "payload", "feature"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
