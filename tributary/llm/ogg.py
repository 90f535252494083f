"""Media columns in Ogg: pages with checksums, packets from lacing values, multiplexed streams, timestamps.

``write`` lays packets of 8-bit samples into pages of several logical streams;
``read`` checks every page's checksum and sequence number, looks for the next
capture pattern after damage, joins packets over page borders by their lacing
values, parts the streams by serial number and dates each packet by the page's
granule position (here: samples so far) and the stream's rate.

The page checksum is CRC-32 with polynomial 0x04C11DB7, unreflected, start 0.
It is the bit-reversal of the reflected CRC of bit-reversed bytes, so zlib and
a table of 256 bytes do the work.

Defined cases: a null text is the empty text, whose payload is one frame of
padding; repeated rows give equal media; an empty table gives no rows; other
columns of the input are left out by the query and kept by the column
functions.  Of a null file all values are null.  Of a damaged one (a page, a
stream or its end missing, or no stream at all) the payload's values and the
feature are null, and bad and lost pages and lost frames are counted; frames
that are left keep the place that their granule names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples in a packet; payloads are padded to a multiple of it with PAD.
FRAME, PAD, RATE = 576, b"\xff", 48_000
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
MAGIC = b"pcm8"
IDENT = struct.Struct("<4sBII")  # magic, number of this stream, number of streams, rate
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The checksum of a page whose own checksum field is zero."""
    plain = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(plain.to_bytes(4, "little").translate(REVERSED), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def paginate(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """Pages of one stream: the first packet on a page of its own, then 255 lacing values a page."""
    pages, lacing, body, done, flags = [], bytearray(), [], -1, FIRST
    for k, packet in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while values:
            if len(lacing) == 255:
                pages.append([done, flags, bytes(lacing), b"".join(body)])
                lacing, body, done, flags = bytearray(), [], -1, CONTINUED if at else 0
            take, values = values[: 255 - len(lacing)], values[255 - len(lacing) :]
            size = sum(take) if len(take) < 3 else 255 * (len(take) - 1) + take[-1]
            lacing += take
            body.append(packet[at : at + size])
            at += size
        done = granules[k]
        if k == 0:
            pages.append([done, flags, bytes(lacing), b"".join(body)])
            lacing, body, done, flags = bytearray(), [], -1, 0
    if lacing:
        pages.append([done, flags, bytes(lacing), b"".join(body)])
    if pages:
        pages[-1][1] |= LAST
    return [page(serial, n, g, f, la, b) for n, (g, f, la, b) in enumerate(pages)]


def write(payload: bytes, streams: int = 2, rate: int = RATE) -> bytes:
    """Frames dealt to ``streams`` logical streams in turns, their pages interleaved, first pages first."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    base = zlib.crc32(payload)
    laid = []
    for s in range(streams):
        own = frames[s::streams]
        ends = [min((s + k * streams + 1) * FRAME, len(payload)) for k in range(len(own))]
        laid.append(paginate((base + s) & 0xFFFFFFFF, [IDENT.pack(MAGIC, s, streams, rate), *own], [0, *ends]))
    longest = max(map(len, laid))
    return b"".join(p[k] for k in range(longest) for p in laid if k < len(p))


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # -1 where no packet ends a page
    pages: int = 0
    ended: bool = False
    lost: int = 0  # pages missing by their numbers
    rest: list[bytes] | None = None


@dataclass
class Media:
    streams: dict[int, Stream]
    bad_pages: int
    skipped: int  # bytes outside sound pages


def read(data: bytes) -> Media:
    streams: dict[int, Stream] = {}
    at, bad, skipped, n = 0, 0, 0, len(data)
    while at < n:
        if data[at : at + 4] != CAPTURE or at + 27 > n:
            nxt = data.find(CAPTURE, at + 1)
            nxt = n if nxt < 0 else nxt
            skipped, at = skipped + nxt - at, nxt
            continue
        _, _, flags, granule, serial, number, crc, count = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        body = at + 27 + count
        end = body + sum(lacing)
        whole = data[at:end]
        if len(lacing) < count or end > n or checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            bad, skipped, at = bad + 1, skipped + 1, at + 1  # its length can't be trusted either
            continue
        s = streams.setdefault(serial, Stream(serial))
        if number > s.pages:
            s.lost += number - s.pages
            s.rest = None
        s.pages = number + 1
        part = s.rest if flags & CONTINUED else []
        ended = 0
        start = body
        run = 0
        for v in lacing:
            run += v
            if v < 255:
                if part is not None:  # else the packet's beginning is lost
                    part.append(data[start : start + run])
                    s.packets.append(b"".join(part) if len(part) > 1 else part[0])
                    s.granules.append(-1)
                    ended += 1
                part, start, run = [], start + run, 0
        if run and part is not None:
            part.append(data[start : start + run])
        s.rest = part if run else []
        if ended:
            s.granules[-1] = granule
        s.ended |= bool(flags & LAST)
        at = end
    return Media(streams, bad, skipped)


@dataclass
class Samples:
    """What is left of a payload: its frames by their place, and what is missing."""

    frames: dict[int, bytes]
    count: int  # frames that there should be, as far as granules tell
    rate: int
    whole: bool  # all streams are named, present and ended, and none lacks a page
    lost_pages: int

    @property
    def payload(self) -> bytes | None:
        """The samples in order; none if there is no stream, or if anything is missing."""
        if not self.whole or len(self.frames) != self.count:
            return None
        return b"".join(self.frames[i] for i in range(self.count))

    @property
    def times(self) -> list[float]:
        """The end of each frame in seconds."""
        return [(i + 1) * FRAME / self.rate for i in sorted(self.frames)]


def demultiplex(media: Media) -> Samples:
    """Frames at the places that their granule positions name, so that a hole moves none of them."""
    names = {s.serial: IDENT.unpack(s.packets[0]) for s in media.streams.values() if s.packets and len(s.packets[0]) == IDENT.size and s.packets[0][:4] == MAGIC}
    total, rate = max(((n, r) for _, _, n, r in names.values()), default=(max(1, len(media.streams)), RATE))
    frames: dict[int, bytes] = {}
    lost = sum(s.lost for s in media.streams.values())
    whole = len(names) == len(media.streams) == total and not lost and all(s.ended for s in media.streams.values())
    for s in media.streams.values():
        own, g = (s.packets[1:], s.granules[1:]) if s.serial in names else (s.packets, s.granules)
        end = None
        for packet, granule in zip(reversed(own), reversed(g)):  # a page's last packet has the page's granule; a stream's frames are ``total`` apart
            end = granule // FRAME - 1 if granule >= 0 else end - total if end is not None else None
            if end is None or end < 0 or len(packet) != FRAME:
                whole = False
            else:
                frames[end] = packet
    return Samples(frames, max(frames, default=-1) + 1, rate, whole and bool(media.streams), lost)


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + PAD * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def feature(payload: bytes | None, times: list[float], pages: int) -> str | None:
    """Seconds, pages, mean and deviation of the samples, and the share of rises between neighbours; null without samples."""
    if not payload:
        return None
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    rises = float((np.diff(x) > 0).mean()) if len(x) > 1 else 0.0
    return f"seconds={times[-1] if times else 0.0:.6f};pages={pages};mean={x.mean():.4f};std={x.std():.4f};rises={rises:.4f}"


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with a binary column: the text's padded bytes as an Ogg file."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([write(padded(t)) for t in b], dtype=object)

    return docs.withColumn(media, run(F.col(text)))


KIND = ("payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, streams int, bad_pages int, "
        "lost_pages int, lost_frames int, seconds double")


def described(data: bytes | None) -> tuple:
    """The values of KIND of one stored file: all null of a null, payload and feature null where something is missing."""
    if data is None:
        return (None,) * len(KIND.split(","))
    m = read(data)
    found = demultiplex(m)
    payload, times = found.payload, found.times
    own = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    return (*own, len(data), hashlib.sha256(data).hexdigest(), feature(payload, times, sum(s.pages for s in m.streams.values())), len(m.streams), m.bad_pages,
            found.lost_pages, found.count - len(found.frames), times[-1] if times else 0.0)


def with_samples(docs: DataFrame, media: str = "media", out: str = "samples") -> DataFrame:
    """``docs`` with a struct read from the Ogg column: payload digests, features, streams, damage and seconds."""
    names, kinds = zip(*(c.split() for c in KIND.split(", ")))
    whole = {"bigint": "Int64", "int": "Int32", "double": "Float64"}

    @F.pandas_udf(KIND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [described(data) for data in b]
            yield pd.DataFrame({n: pd.array([r[i] for r in rows], dtype=whole[k]) if k in whole else pd.Series([r[i] for r in rows], dtype=object)
                                for i, (n, k) in enumerate(zip(names, kinds))})

    return docs.withColumn(out, run(F.col(media)))


def media_features(docs: DataFrame) -> DataFrame:
    """Each text of ``docs`` (doc_id, text) stored as Ogg and read back."""
    stored = with_media(docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")))
    return with_samples(stored.drop("text")).select(
        "doc_id", "n_bytes", *[f"samples.{c}" for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "streams", "bad_pages", "seconds")])
