"""Media columns: byte payloads as AVI motion-JPEG (lossless intra frames), and shots found in such columns."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import documents_of, raw, slices

WIDTH, HEIGHT, FPS = 16, 12, 12
FRAME = WIDTH * HEIGHT
#: Frames that are coded or decoded at once, so that work arrays don't grow with a text: 18 MB of bits at most.
BLOCK = 10_000
#: Fixed values of ITU-T T.81: marker bytes, and the sample that precedes the first one at 8 bits.
SOI, EOI, SOF3, DHT, SOS, FIRST = b"\xff\xd8", b"\xff\xd9", 0xC3, 0xC4, 0xDA, 128
#: Difference category s has a code of 9 - s bits and s more bits, so that every sample takes nine bits.
BITS = 9


def _codes() -> np.ndarray:
    """Nine bits for each difference from -255 to 255 (row: difference + 255)."""
    out = np.zeros((511, BITS), np.uint8)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = "1" * (8 - s) + "0" + (format(d if d > 0 else d + (1 << s) - 1, f"0{s}b") if s else "")
        out[d + 255] = [int(b) for b in code]
    return out


_CODES = _codes()
_WEIGHTS = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int16)
_DIFFERENCE = np.zeros(512, np.int16)
_DIFFERENCE[_CODES @ _WEIGHTS] = np.arange(-255, 256)
_TABLE = bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
_HEAD = (
    SOI
    + b"\xff" + bytes([DHT]) + struct.pack(">H", 2 + len(_TABLE)) + _TABLE
    + b"\xff" + bytes([SOF3]) + struct.pack(">HBHHB", 11, 8, HEIGHT, WIDTH, 1) + bytes([1, 0x11, 0])
    + b"\xff" + bytes([SOS]) + struct.pack(">HB", 8, 1) + bytes([1, 0x00, 1, 0, 0])
)


def pad_payload(text: bytes) -> bytes:
    """The text with blanks up to a positive multiple of a frame."""
    return text + b" " * (-len(text) % FRAME if text else FRAME)


def _coded(samples: np.ndarray) -> bytes:
    """The entropy-coded bytes of frames, one after another."""
    frames = samples.astype(np.int16)
    before = np.empty_like(frames)
    before[:, :, 1:] = frames[:, :, :-1]
    before[:, 1:, 0] = frames[:, :-1, 0]
    before[:, 0, 0] = FIRST
    bits = _CODES[(frames - before + 255).reshape(len(frames), FRAME)]
    return np.packbits(bits.reshape(len(frames), -1), axis=1).tobytes()


def write_avi(payload: bytes) -> bytes:
    """A RIFF AVI file whose frames hold the payload's bytes as 8-bit grey samples, in lossless JPEG."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, HEIGHT, WIDTH)
    packed = b"".join(_coded(frames[i : i + BLOCK]) for i in range(0, len(frames), BLOCK))
    width = FRAME * BITS // 8
    chunks, index, at = [], [], 4
    for i in range(len(frames)):
        jpeg = _HEAD + packed[i * width : (i + 1) * width].replace(b"\xff", b"\xff\x00") + EOI
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
        chunks.append(struct.pack("<4sI", b"00dc", len(jpeg)) + jpeg + b"\0" * (len(jpeg) % 2))
        at += len(chunks[-1])
    chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body
    group = lambda name, body: chunk(b"LIST", name + body)
    largest = max(map(len, chunks))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    body = group(b"hdrl", chunk(b"avih", avih) + group(b"strl", chunk(b"strh", strh) + chunk(b"strf", strf)))
    body += group(b"movi", b"".join(chunks)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", b"AVI " + body)


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, size
        at += 8 + size + size % 2


def read_index(data: bytes) -> tuple[int, list[tuple[int, int]]]:
    """Frames per second, and the place and size of each video frame by the file's own index."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, entries = FPS, None, None
    for name, at, size in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[at : at + 4] == b"movi":
            movi = at
        elif name == b"LIST" and data[at : at + 4] == b"hdrl":
            for inner, place, _ in _chunks(data, at + 4, at + size):
                if inner == b"avih":
                    fps = max(1, round(1_000_000 / max(1, struct.unpack_from("<I", data, place)[0])))
        elif name == b"idx1":
            entries = [(o, n) for tag, _, o, n in struct.iter_unpack("<4sIII", data[at : at + size]) if tag.endswith((b"dc", b"db"))]
    if movi is None or entries is None:
        raise ValueError("an AVI file without frames or index")
    return fps, [(movi + o + 8, n) for o, n in entries]


@dataclass
class Scan:
    """What a JPEG frame's headers say, and its entropy-coded bytes."""

    height: int = 0
    width: int = 0
    predictor: int = 0
    table: bytes = b""
    data: bytes = b""


def _scan_of(data: bytes, at: int, size: int) -> Scan:
    end, place, out = at + size, at + 2, Scan()
    if data[at:place] != SOI or data[end - 2 : end] != EOI:
        raise ValueError("not a JPEG frame")
    while place < end:
        if data[place] != 0xFF:
            raise ValueError("a JPEG frame without its next marker")
        marker, length = data[place + 1], struct.unpack_from(">H", data, place + 2)[0]
        body = data[place + 4 : place + 2 + length]
        if marker == DHT:
            out.table = body
        elif marker == SOF3:
            bits, out.height, out.width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError(f"frames of {bits} bits and {parts} components aren't read")
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError(f"frames coded by process {marker - 0xC0} aren't read, only lossless ones (3)")
        elif marker == SOS:
            out.predictor, out.data = body[3], data[place + 2 + length : end - 2].replace(b"\xff\x00", b"\xff")
            return out
        place += 2 + length
    raise ValueError("a JPEG frame without a scan")


def _lengths_and_symbols(table: bytes) -> dict[tuple[int, int], int]:
    """Huffman codes of a table segment, as (bits, code) -> difference category."""
    out, code, at = {}, 0, 17
    for bits, n in enumerate(table[1:17], 1):
        for _ in range(n):
            out[bits, code] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _decode_frame(scan: Scan) -> np.ndarray:
    """A lossless frame by its own table, size and predictor (1: left, 2: above); a bit at a time."""
    if scan.predictor not in (1, 2):
        raise ValueError(f"predictor {scan.predictor} isn't read, only 1 and 2")
    codes = _lengths_and_symbols(scan.table)
    bits = np.unpackbits(np.frombuffer(scan.data, np.uint8)).tolist()
    moves, at = np.empty(scan.height * scan.width, np.int32), 0
    for i in range(len(moves)):
        n = code = 0
        while (n, code) not in codes:
            if n == 16 or at >= len(bits):
                raise ValueError("a frame's bits fit no code")
            n, code, at = n + 1, code << 1 | bits[at], at + 1
        s, value = codes[n, code], 0
        if at + s > len(bits):
            raise ValueError("a frame ends too early")
        for b in bits[at : at + s]:
            value = value << 1 | b
        at += s
        moves[i] = value if s == 0 or value >> (s - 1) else value - (1 << s) + 1
    moves = moves.reshape(scan.height, scan.width)
    moves[0, 0] += FIRST
    if scan.predictor == 1:
        moves[:, 0] = np.cumsum(moves[:, 0])
        return (np.cumsum(moves, axis=1) & 0xFF).astype(np.uint8)
    moves[0] = np.cumsum(moves[0])
    return (np.cumsum(moves, axis=0) & 0xFF).astype(np.uint8)


def _decode_own(scans: list[bytes]) -> np.ndarray:
    """All frames at once where every code has nine bits."""
    bits = np.unpackbits(np.frombuffer(b"".join(scans), np.uint8)).reshape(-1, BITS)
    codes = np.zeros(len(bits), np.int16)
    for i in range(BITS):
        codes = (codes << 1) | bits[:, i]
    moves = _DIFFERENCE[codes].reshape(-1, HEIGHT, WIDTH).astype(np.int32)
    moves[:, 0, 0] += FIRST
    moves[:, :, 0] = np.cumsum(moves[:, :, 0], axis=1)
    return (np.cumsum(moves, axis=2) & 0xFF).astype(np.uint8)


def read_frames(data: bytes) -> tuple[int, np.ndarray]:
    """Frames per second and the decoded frames (n, height, width) of an AVI file of lossless JPEG frames, whatever
    their Huffman tables and size (all of one size). ValueError says why a file can't be read."""
    fps, entries = read_index(data)
    own, other = [], []
    for at, size in entries:
        if data[at : at + len(_HEAD)] == _HEAD and not other:
            own.append(data[at + len(_HEAD) : at + size - 2].replace(b"\xff\x00", b"\xff"))
        else:
            other.append(_decode_frame(_scan_of(data, at, size)))
    if len({f.shape for f in other} | ({(HEIGHT, WIDTH)} if own else set())) > 1:
        raise ValueError("frames of several sizes")
    frames = [_decode_own(own[i : i + BLOCK]) for i in range(0, len(own), BLOCK)] + ([np.stack(other)] if other else [])
    return fps, np.concatenate(frames) if frames else np.empty((0, HEIGHT, WIDTH), np.uint8)


def find_shots(frames: np.ndarray, reach: int = 12, factor: float = 3.0, least: float = 0.25) -> list[tuple[int, int]]:
    """First and last frame of each shot. A cut stands where the difference of neighbouring histograms (16 bins,
    0 to 1) is over `least` and over the mean plus `factor` standard deviations of the differences within `reach`
    frames around it, itself left out."""
    n = len(frames)
    if n == 0:
        return []
    flat = (frames.reshape(n, -1) >> 4).astype(np.int64) + (np.arange(n) * 16)[:, None]
    histogram = np.bincount(flat.ravel(), minlength=n * 16).reshape(n, 16)
    moved = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / (2.0 * frames[0].size)
    m = len(moved)
    if not m:
        return [(0, 0)]
    sums, squares = np.concatenate([[0.0], np.cumsum(moved)]), np.concatenate([[0.0], np.cumsum(moved * moved)])
    low, high = np.maximum(0, np.arange(m) - reach), np.minimum(m, np.arange(m) + reach + 1)
    others = np.maximum(1, high - low - 1)
    mean = (sums[high] - sums[low] - moved) / others
    spread = np.sqrt(np.maximum(0.0, (squares[high] - squares[low] - moved * moved) / others - mean * mean))
    cuts = np.flatnonzero((moved > least) & (moved > mean + factor * spread)) + 1
    starts = [0, *map(int, cuts)]
    return list(zip(starts, [s - 1 for s in starts[1:]] + [n - 1]))


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _encoded(batches):
    for batch in slices(batches, 2 << 20):
        texts = [t or b"" for t in raw(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_avi(pad_payload(t)) for t in texts], pa.binary())], schema=_MEDIA)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (binary): each text's UTF-8 bytes, padded with blanks to whole frames, as an AVI
    file. Null text counts as empty, which gives one blank frame. Very long texts are stored whole, in more frames. Null ids
    and repeated rows stay (there are no ties); extra columns play no part, whatever their names; an empty table gives none.
    Narrow."""
    return documents_of(docs, id_col, text_col).mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


_CLIPS = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean_sample", pa.float64()), ("error", pa.string())])
_CLIP_TYPES = "doc_id long, clip int, first_frame int, last_frame int, start_s double, end_s double, mean_sample double, error string"


def _clipped(batches):
    for batch in slices(batches):
        rows = []
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if data is None:
                continue
            try:
                fps, frames = read_frames(data)
            except (ValueError, struct.error, IndexError) as e:
                rows.append((doc, *[None] * 6, str(e) or "broken file"))
                continue
            rows += [(doc, i, a, b, a / fps, (b + 1) / fps, float(frames[a : b + 1].mean()), None) for i, (a, b) in enumerate(find_shots(frames))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 8, _CLIPS)], schema=_CLIPS)


def clip_rows(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clips of a media column: id, clip number, first and last frame, start and end in seconds, mean sample, and
    error. Null media, and files without frames, give no clips; one that can't be read gives one row that says why in
    error, with nulls elsewhere. Null ids and repeated rows stay; an empty table gives none."""
    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(_clipped, _CLIP_TYPES)


def encoded_clips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """clip_rows of encode_media in one pass, as encoded_digest."""
    return documents_of(docs, id_col, text_col).mapInArrow(lambda batches: _clipped(b.select([0, 2]) for b in _encoded(batches)), _CLIP_TYPES)


_DIGEST = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
_DIGEST_TYPES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digested(batches):
    for batch in slices(batches):
        rows = []
        for data in batch.column(2).to_pylist():
            if data is None:
                rows.append((None,) * 6)
                continue
            stored = len(data), hashlib.sha256(data).hexdigest()
            try:
                frames = read_frames(data)[1]
            except (ValueError, struct.error, IndexError):
                rows.append((None, None, None, *stored, None))
                continue
            payload = frames.tobytes()
            shots = find_shots(frames)
            feature = f"frames={len(frames)} shots={len(shots)} lengths={','.join(str(b - a + 1) for a, b in shots)}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, feature))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * 6, _DIGEST[2:]))], schema=pa.schema(_DIGEST))


def media_digest(media: DataFrame) -> DataFrame:
    """What encode_media's column holds, read back from its stored bytes: payload and file digests, and the shots.

    feature: frames, shots and the shots' lengths in frames, as `frames=3 shots=2 lengths=1,2`. Null media have
    a row with nulls, and so have media that can't be read, but for their own size and digest. Repeated rows have equal
    results, very long files are read whole, and there are no ties. Columns beside the three that are read play no part.
    An empty table gives none.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digested, _DIGEST_TYPES)


def encoded_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_digest of encode_media in one pass: each file is written and read back by the same Python worker, a slice of
    rows at a time. Apart, each task has two workers, and the second takes files in batches of as many rows as the first
    takes texts."""
    return documents_of(docs, id_col, text_col).mapInArrow(lambda batches: _digested(_encoded(batches)), _DIGEST_TYPES)
