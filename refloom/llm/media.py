"""Ogg columns: page checksums, packet reassembly, demultiplexing and granule timestamps.

The codec is plain Python over bytes objects; the columns are filled one row at a time. Nothing is shuffled.

Edge cases: ids are passed through, null ones too; a null text is an empty text, an empty text is stored as 64 zero bytes; a page whose
checksum is wrong is skipped and counted, as are the gaps in a stream's page numbers; packets that a gap
interrupts are dropped and counted;
bytes between pages are skipped until the next capture pattern; an empty file has no pages.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import arrow_types, mapped_texts, tidy

BLOCK = 4096  #: samples of a data packet
RATE = 8000  #: samples a second in a written file
STREAMS = 2  #: logical streams that a payload is dealt to
HEADER = "<4sBBqIIIB"  # capture, version, flags, granule, serial, page number, checksum, segments
IDENT = "<8sBBIIQ"  # magic, stream, streams, rate, block, payload bytes
MAGIC = b"PCM8\x00\x01\x00\x00"
_REV8 = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """The container's CRC-32: polynomial 0x04c11db7, most significant bit first, start 0, no final
    xor. Reversing the bits of each byte turns it into zlib's reflected CRC without its xors."""
    return int(f"{zlib.crc32(page.translate(_REV8), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


@dataclass
class Packet:
    serial: int
    index: int
    data: bytes
    granule: int  # samples of the stream that are complete with this packet; -1 if it can't be told
    start_s: float = -1.0
    end_s: float = -1.0


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    begun: bool = False
    ended: bool = False
    partial: bytes | None = None
    next_page: int | None = None
    rate: int = RATE


@dataclass
class OggFile:
    pages: int = 0
    bad_pages: int = 0
    skipped_bytes: int = 0
    lost_pages: int = 0
    lost_packets: int = 0
    streams: dict[int, Stream] = field(default_factory=dict)


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(HEADER, b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    crc = page_crc(head + lacing + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + lacing + body


def _stream_pages(serial: int, packets: list[tuple[bytes, int]], segments: int = 255) -> Iterator[bytes]:
    """Pages of one logical stream. The first packet stands alone on its page; the others fill pages
    of at most `segments` lacing values, so that a packet may run on into the next page."""
    first, granule = packets[0]
    number = 0
    yield _page(serial, number, 2, granule, bytes([255] * (len(first) // 255) + [len(first) % 255]), first)
    lacing, body, done, carried, rest = bytearray(), bytearray(), -1, False, packets[1:]
    for k, (data, granule) in enumerate(rest):
        values = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        for i, v in enumerate(values):
            if len(lacing) == segments:
                number += 1
                yield _page(serial, number, int(carried), done, bytes(lacing), bytes(body))
                lacing, body, done, carried = bytearray(), bytearray(), -1, i > 0
            lacing.append(v)
            body += data[at : at + v]
            at += v
        done = granule
    number += 1
    yield _page(serial, number, 4 | int(carried), done, bytes(lacing), bytes(body))


def encode(payload: bytes) -> bytes:
    """The payload's bytes as unsigned 8-bit samples, dealt by blocks to STREAMS multiplexed streams."""
    streams = []
    for s in range(STREAMS):
        packets, total = [(struct.pack(IDENT, MAGIC, s, STREAMS, RATE, BLOCK, len(payload)), 0)], 0
        for at in range(s * BLOCK, len(payload), STREAMS * BLOCK):
            block = payload[at : at + BLOCK]
            total += len(block)
            packets.append((block, total))
        streams.append(list(_stream_pages(0x5EED0000 + s, packets)))
    out = [pages[0] for pages in streams]  # all first pages come before any data
    for k in range(1, max(map(len, streams))):
        out += [pages[k] for pages in streams if k < len(pages)]
    return b"".join(out)


def decode(data: bytes) -> OggFile:
    """Verifies, demultiplexes and reassembles a physical stream; see the module's docstring."""
    out, at, size = OggFile(), 0, len(data)
    while at < size:
        if data[at : at + 4] != b"OggS":
            found = data.find(b"OggS", at)
            found = size if found < 0 else found
            out.skipped_bytes += found - at
            at = found
            continue
        if at + 27 > size:
            out.bad_pages += 1
            break
        _, version, flags, granule, serial, number, crc, count = struct.unpack_from(HEADER, data, at)
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if len(lacing) < count or end > size or version or page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            out.bad_pages += 1
            out.skipped_bytes += 4
            at += 4  # look for the next capture pattern behind this one
            continue
        out.pages += 1
        s = out.streams.setdefault(serial, Stream(serial))
        s.begun |= bool(flags & 2)
        s.ended |= bool(flags & 4)
        if number != (s.next_page or 0):
            out.lost_pages += max(1, number - (s.next_page or 0))
            out.lost_packets += s.partial is not None
            s.partial = None
        s.next_page = number + 1
        if not flags & 1 and s.partial is not None:
            out.lost_packets += 1
            s.partial = None
        skip = bool(flags & 1) and s.partial is None
        whole, pos, body = [], at + 27 + count, bytearray(s.partial or b"")
        for v in lacing:
            body += data[pos : pos + v]
            pos += v
            if v < 255:
                if skip:
                    out.lost_packets += 1
                    skip = False
                else:
                    whole.append(bytes(body))
                body = bytearray()
        s.partial = bytes(body) if lacing and lacing[-1] == 255 and not skip else None
        first = len(s.packets)
        for k, w in enumerate(whole):
            s.packets.append(Packet(serial, first + k, w, -1))
            if first + k == 0 and w[:8] == MAGIC and len(w) >= struct.calcsize(IDENT):
                s.rate = struct.unpack_from(IDENT, w)[3] or RATE
        if whole and granule >= 0:  # the page's granule is that of its last whole packet; go back from there
            for p in reversed(s.packets[first:]):
                n = 0 if p.index == 0 else len(p.data)
                p.granule, p.start_s, p.end_s = granule, (granule - n) / s.rate, granule / s.rate
                granule -= n
        at = end
    out.lost_packets += sum(s.partial is not None for s in out.streams.values())
    return out


def payload_of(f: OggFile) -> bytes:
    """Data packets of all streams in order of presentation: by start time, then by stream."""
    blocks, want = [], 0
    for s in f.streams.values():
        _, stream, streams, _, block, want = struct.unpack_from(IDENT, s.packets[0].data)
        blocks += [((round(p.start_s * s.rate) // block) * streams + stream, p.data) for p in s.packets[1:]]
    out = b"".join(d for _, d in sorted(blocks, key=lambda x: x[0]))
    if not f.streams or len(out) != want or f.bad_pages or f.lost_pages or f.lost_packets:
        raise ValueError(f"{len(out)} of {want} payload bytes, {f.bad_pages} bad pages, {f.lost_packets} lost packets")
    return out


def payload(text: str | None) -> bytes:
    """UTF-8 of a text, null as empty, with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def with_media(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as an Ogg file."""
    return mapped_texts(docs, lambda texts: ([len((t or "").encode()) for t in texts], [encode(payload(t)) for t in texts]), "n_bytes long, media binary", text, id_col)


def packets(files: DataFrame, media: str = "media", id_col: str = "doc_id") -> DataFrame:
    """One row for each packet of each file: serial, index, granule, start and end in seconds, data. A
    null file has no packets."""
    columns = "serial long, packet long, granule long, start_s double, end_s double, data binary"
    types = arrow_types(files.sparkSession, f"doc_id long, {columns}")

    def fill(batches):
        import pyarrow as pa

        names = ["doc_id", *[c.split()[0] for c in columns.split(", ")]]
        for b in batches:
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(i, p.serial, p.index, p.granule, p.start_s, p.end_s, p.data) for s in decode(m).streams.values() for p in s.packets] if m is not None else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), types)], names=names)
        tidy()

    return files.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{media}`").alias("m")).mapInArrow(fill, f"doc_id long, {columns}")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(media: bytes) -> tuple:
    """The columns FEATURES of a file. One that doesn't give its payload back whole has only media columns and a
    feature that begins with "damaged"."""
    f = decode(media)
    found = f"pages={f.pages};streams={len(f.streams)};packets={sum(len(s.packets) for s in f.streams.values())};bad={f.bad_pages}"
    stored = (len(media), hashlib.sha256(media).hexdigest())
    try:
        back = payload_of(f)
    except (ValueError, IndexError, ZeroDivisionError, struct.error):
        return (None, None, None, *stored, f"damaged;{found};lost={f.lost_pages},{f.lost_packets};skipped={f.skipped_bytes}")
    ends = ",".join(f"{s.packets[-1].end_s:.6f}" for s in f.streams.values())
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), *stored, f"{found};ends={ends};eos={sum(s.ended for s in f.streams.values())}"


def describe(files: DataFrame, media: str = "media", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, FEATURES) of stored files; a null file is an empty one, which is damaged."""
    return mapped_texts(files, lambda got: [*zip(*[digest(m or b"") for m in got])] or [()] * 6, FEATURES, media, id_col)


def media_features(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, FEATURES): every whole text is stored as an Ogg file, whose bytes are read back and described.
    A task holds one Arrow batch of texts and one file at a time."""

    def fill(texts):
        rows = [(len((t or "").encode()), *digest(encode(payload(t)))) for t in texts]
        return [*zip(*rows)] or [()] * 7

    return mapped_texts(docs, fill, f"n_bytes long, {FEATURES}", text, id_col)
