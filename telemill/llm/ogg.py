"""Ogg as a media column: pages, packets, logical streams and timestamps (RFC 3533), without any codec.

``mux`` writes logical streams into one physical stream; ``parse`` verifies the checksum of each page, skips damaged
ones and finds the next capture pattern, separates the logical streams by serial number, reassembles packets from
lacing values across pages, notices missing pages, and derives each packet's end time from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .arrow import map_columns

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
_HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: Of the sample streams that this module writes: 8-bit mono samples, so many in a packet and a second.
FRAME, RATE = 576, 8000
SAMPLES, MARKS = b"\x7fsamples", b"\x7fmarks\0\0"
_SAMPLE_HEAD = struct.Struct("<8sBBHIQ")
_MARK = struct.Struct("<QQI")
#: Packets of samples between two packets of the marks stream; not a divisor of a page, so packets span pages.
MARK_EVERY, SEGMENTS = 50, 250


def checksum(page: bytes) -> int:
    """Ogg's CRC: polynomial 0x04c11db7, most significant bit first, no inversion.

    That is zlib's CRC with bits read the other way round, so it is zlib's over bit-reversed bytes, reversed.
    """
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def paginate(serial: int, packets: list[bytes], granules: list[int], segments: int = SEGMENTS) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream; the first packet has a page of its own, as the standard wants."""
    pages: list[tuple[int, bytes]] = []
    done = 0  # packets that have ended
    position = 0
    for group in (packets[:1], packets[1:]):
        lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in group)
        body = b"".join(group)
        at = 0
        for k in range(0, len(lacing), segments):
            part = lacing[k : k + segments]
            size = sum(part)
            ended = len(part) - part.count(255)
            done += ended
            position = granules[done - 1] if ended else position
            last = done == len(packets) and k + segments >= len(lacing)
            flags = CONTINUED * (k > 0 and lacing[k - 1] == 255) | FIRST * (not pages) | LAST * last
            pages.append((position, _page(flags, granules[done - 1] if ended else -1, serial, len(pages), part, body[at : at + size])))
            at += size
    return pages


def mux(streams: list[tuple[int, list[bytes], list[int]]]) -> bytes:
    """(serial, packets, granule position at each packet's end) of each logical stream, grouped by position."""
    pages = [paginate(*s) for s in streams]
    first = [p[0][1] for p in pages]
    rest = sorted(((granule, k, i) for k, p in enumerate(pages) for i, (granule, _) in enumerate(p) if i), key=lambda x: x)
    return b"".join(first) + b"".join(pages[k][i][1] for _, k, i in rest)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position at the end of the page on which each packet ended; and how many packets ended after it there.
    granules: list[int] = field(default_factory=list)
    later: list[int] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    #: What has been read of a packet that goes on on the next page; None: no packet is open.
    partial: bytes | None = None
    number: int = -1
    #: How many streams with this serial number came before.
    link: int = 0

    def take(self, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
        self.pages += 1
        if self.number >= 0 and number != self.number + 1:
            self.gaps += 1
            self.partial = None
        self.number = number
        headless = False  # the page starts within a packet whose beginning is lost
        if flags & CONTINUED:
            headless = self.partial is None
        elif self.partial is not None:
            self.gaps += 1
            self.partial = None
        values = np.frombuffer(lacing, np.uint8)
        stops = np.cumsum(values, dtype=np.int64)
        stops = stops[values < 255].tolist()
        at = 0
        for i, stop in enumerate(stops):
            if not headless:
                self.packets.append((self.partial or b"") + body[at:stop])
                self.granules.append(granule)
                self.later.append(len(stops) - 1 - i)
            headless, self.partial, at = False, None, stop
        if lacing and lacing[-1] == 255 and not headless:
            self.partial = (self.partial or b"") + body[at:]
        self.ended |= bool(flags & LAST)

    def positions(self, duration) -> list[int]:
        """Granule position at each packet's end: that of its page, less the durations of later packets there."""
        out, after = [0] * len(self.packets), 0
        for i in range(len(self.packets) - 1, -1, -1):
            if self.later[i] == 0:
                after = 0
            out[i] = self.granules[i] - after
            after += duration(self.packets[i])
        return out


def clock(head: bytes) -> tuple[int, int] | None:
    """(granules a second, granules before time 0) by a stream's first packet; None for an unknown kind."""
    if head[:8] == SAMPLES and len(head) >= _SAMPLE_HEAD.size:
        return _SAMPLE_HEAD.unpack_from(head)[4], 0
    if head[:8] == b"OpusHead" and len(head) >= 12:
        return 48_000, int.from_bytes(head[10:12], "little")
    if head[:7] == b"\x01vorbis" and len(head) >= 16:
        return int.from_bytes(head[12:16], "little"), 0
    if head[:8] == b"Speex   " and len(head) >= 40:
        return int.from_bytes(head[36:40], "little"), 0
    return None


def seconds(s: Stream) -> list[float | None]:
    """When each packet ends; None if that is unknown.

    Of sample streams every packet's duration is known; of others a page tells only when its last packet ends.
    """
    known = clock(s.packets[0]) if s.packets else None
    if known is None or known[0] <= 0:
        return [None] * len(s.packets)
    rate, skipped = known
    at = s.positions(lambda p: 0 if p[:8] == SAMPLES else len(p)) if s.packets[0][:8] == SAMPLES else [-1 if later else g for g, later in zip(s.granules, s.later, strict=True)]
    return [None if g < 0 else max(0, g - skipped) / rate for g in at]


@dataclass
class Parsed:
    #: By serial number; of chained streams with one number those after the first by (number, 1), (number, 2) and so on.
    streams: dict[int | tuple[int, int], Stream]
    pages: int
    bad_pages: int
    lost_bytes: int


def parse(data: bytes) -> Parsed:
    out = Parsed({}, 0, 0, 0)
    now: dict[int, Stream] = {}
    links: dict[int, int] = {}
    at, n = 0, len(data)
    while at + 27 <= n:
        if data[at : at + 4] != CAPTURE:
            found = data.find(CAPTURE, at)
            out.lost_bytes += (found if found >= 0 else n) - at
            if found < 0:
                return out
            at = found
            continue
        _, version, flags, granule, serial, number, crc, count = _HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        stop = at + 27 + count + sum(lacing)
        whole = len(lacing) == count and stop <= n and version == 0
        if not whole or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : stop]) != crc:
            out.bad_pages += 1
            out.lost_bytes += 4
            at += 4
            continue
        out.pages += 1
        if flags & FIRST or serial not in now:  # a beginning always opens a new logical stream
            link = links[serial] = links.get(serial, -1) + 1
            now[serial] = out.streams[(serial, link) if link else serial] = Stream(serial, link=link)
        now[serial].take(flags, granule, number, lacing, data[at + 27 + count : stop])
        at = stop
    out.lost_bytes += n - at
    return out


def store(raw: bytes) -> bytes:
    """``raw`` padded with bytes 255 to a positive multiple of FRAME, as 8-bit samples beside a stream of marks."""
    payload = raw + b"\xff" * (FRAME - len(raw) % FRAME if len(raw) % FRAME or not raw else 0)
    seed = zlib.crc32(payload)
    serials = (seed, (seed + 0x5BD1E995) & 0xFFFFFFFF)
    n = len(payload) // FRAME
    head = _SAMPLE_HEAD.pack(SAMPLES, 1, 8, FRAME, RATE, len(raw))
    packets = [head, *(payload[i : i + FRAME] for i in range(0, len(payload), FRAME))]
    marks, at = [MARKS], [0]
    for k in range(0, n, MARK_EVERY):
        block = payload[k * FRAME : (k + MARK_EVERY) * FRAME]
        marks.append(_MARK.pack(k * FRAME, len(block), zlib.crc32(block)))
        at.append(k * FRAME + len(block))
    return mux([(serials[0], packets, [0, *range(FRAME, len(payload) + 1, FRAME)]), (serials[1], marks, at)])


def restore(media: bytes) -> dict:
    """Reads what ``store`` wrote: payload, unpadded length and features; ``error`` is set where it can't."""
    p = parse(media)
    by_kind = {s.packets[0][:8]: s for s in p.streams.values() if s.packets}
    samples, marks = by_kind.get(SAMPLES), by_kind.get(MARKS)
    if samples is None or marks is None:
        return {"error": "no sample or mark stream"}
    _, _, _, _, rate, length = _SAMPLE_HEAD.unpack(samples.packets[0])
    payload = b"".join(samples.packets[1:])
    ends = samples.positions(lambda packet: 0 if packet[:8] == SAMPLES else len(packet))
    error = "damaged pages" if p.bad_pages or samples.gaps or marks.gaps or not (samples.ended and marks.ended) else None
    for mark in marks.packets[1:]:
        start, size, crc = _MARK.unpack(mark)
        if zlib.crc32(payload[start : start + size]) != crc:
            error = "a block differs from its mark"
    if ends[-1] != len(payload):
        error = "granule positions don't add up"
    x = np.frombuffer(payload, np.uint8)
    sums = np.add.reduceat(x, np.arange(0, len(x), FRAME), dtype=np.int64)
    high = x > 127
    feature = (
        f"streams={len(p.streams)};pages={p.pages};packets={sum(len(s.packets) for s in p.streams.values())};seconds={ends[-1] / rate:.6f};"
        f"mean={sums.sum() / len(x):.6f};rms={(int(np.bincount(x, minlength=256) @ np.arange(256) ** 2) / len(x)) ** 0.5:.6f};"
        f"frame_max={sums.max() / FRAME:.6f};frame_min={sums.min() / FRAME:.6f};crossings={int(np.count_nonzero(high[1:] != high[:-1]))}"
    )
    return {"payload": payload, "length": length, "feature": feature, "error": error, "ends": ends, "rate": rate}


def demultiplex(df: DataFrame, media: str = "media", row_id: str = "doc_id") -> DataFrame:
    """One row for each logical stream of each value of the binary column ``media``.

    Columns: row_id, serial, link (streams with this serial number before it, as chained files have), head (first 8 bytes of its first packet), n_pages, n_packets, sizes (of packets), granules
    (of the pages on which they ended), seconds (at which they end; null where the stream's kind doesn't tell), gaps
    (missing pages), ended, bad_pages and lost_bytes (of the whole value) and data (its packets, joined).  A null or empty value, or one without any sound page, gives no row.
    """

    def run(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("row_id", "serial", "link", "head", "n_pages", "n_packets", "sizes", "granules", "seconds", "gaps", "ended", "bad_pages", "lost_bytes", "data")}
        for key, value in zip(cols["row_id"], cols["media"], strict=True):
            parsed = parse(value or b"")
            for s in parsed.streams.values():
                row = (key, s.serial, s.link, s.packets[0][:8] if s.packets else b"", s.pages, len(s.packets), [len(x) for x in s.packets], s.granules, seconds(s), s.gaps, s.ended, parsed.bad_pages, parsed.lost_bytes, b"".join(s.packets))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
        return out

    schema = "row_id long, serial long, link int, head binary, n_pages long, n_packets long, sizes array<int>, granules array<long>, seconds array<double>, gaps int, ended boolean, bad_pages int, lost_bytes long, data binary"
    return map_columns(df.selectExpr(f"cast(`{row_id}` as long) as row_id", f"`{media}` as media"), run, schema)


def encode(docs: DataFrame) -> DataFrame:
    """doc_id and media: each whole text of ``docs`` as stored Ogg bytes (null: as an empty text)."""

    def run(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "media": [store((t or "").encode()) for t in cols["text"]]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, media binary")


def digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its text stored as Ogg, read back from the stored bytes, and described.

    Null text: as empty, which is one frame of bytes 255.  Null or repeated ids and repeated rows: a row each.  Empty
    table: no rows.  Other columns of ``docs`` are ignored.  Reading back something else than what was stored raises.
    """

    def run(cols: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for key, text in zip(cols["doc_id"], cols["text"], strict=True):
            raw = (text or "").encode()
            media = store(raw)
            got = restore(media)
            if got["error"]:
                raise ValueError(f"doc_id {key}: {got['error']}")
            payload = got["payload"]
            row = (key, got["length"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), got["feature"])
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_columns(docs.select("doc_id", "text"), run, schema)
