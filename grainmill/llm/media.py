"""Matroska media columns: a muxer for 8-bit samples and a parser of EBML elements into packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed element identifiers of the Matroska format (IETF RFC 9559).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS, AUDIO = 0xAE, 0xA0, 0xBB, 0xB7, 0xE1
TIMESTAMP, SIMPLE_BLOCK, BLOCK, SCALE = 0xE7, 0xA3, 0xA1, 0x2AD7B1
TRACK_NUMBER, TRACK_TYPE, CODEC, DEFAULT_DURATION = 0xD7, 0x83, 0x86, 0x23E383
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
_MASTERS = {SEGMENT, CLUSTER, TRACKS, INFO, CUES, TRACK_ENTRY, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
#: Children of the segment; one of them ends a cluster of unknown size.
_TOP = {CLUSTER, CUES, TRACKS, INFO, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}

FRAME, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER, RATE = 512, 8, 8, 8000


def _size(n: int, width: int = 0) -> bytes:
    """A variable-length integer; all ones is kept for unknown sizes."""
    while width < 8 and (not width or n >= (1 << 7 * width) - 1):
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(data)) + data


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEADER = _element(EBML, b"".join([_uint(0x4286, 1), _uint(0x42F7, 1), _uint(0x42F2, 4), _uint(0x42F3, 8), _element(0x4282, b"matroska"), _uint(0x4287, 4), _uint(0x4285, 2)]))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, b"".join([
    _uint(TRACK_NUMBER, 1), _uint(0x73C5, 1), _uint(TRACK_TYPE, 2), _uint(0x9C, 1), _element(CODEC, b"A_PCM/INT/LIT"), _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE),
    _element(AUDIO, _element(0xB5, struct.pack(">d", RATE)) + _uint(0x9F, 1) + _uint(0x6264, 8)),
])))


def _laced(frames: list[bytes], flavour: int) -> tuple[int, bytes]:
    """Flags and body of a block: no lacing for a frame, fixed-size for equal ones, else EBML or Xiph by ``flavour``."""
    if len(frames) == 1:
        return 0x80, frames[0]
    sizes, count = [len(f) for f in frames], bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 0x84, count + b"".join(frames)
    if flavour % 2:
        return 0x82, count + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1]) + b"".join(frames)
    coded = _size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = 1
        while abs(b - a) >= (1 << 7 * width - 1) - 1:
            width += 1
        coded += _size(b - a + (1 << 7 * width - 1) - 1, width)
    return 0x86, count + coded + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """Store ``payload`` as 8-bit PCM in Matroska: frames of 64 ms, laced blocks, clusters and a cue for each cluster."""
    per_block = FRAME * FRAMES_PER_BLOCK
    per_cluster = per_block * BLOCKS_PER_CLUSTER
    clusters = []
    for c in range(0, len(payload), per_cluster):
        body = [_uint(TIMESTAMP, c * 1000 // RATE)]
        for k, b in enumerate(range(c, min(c + per_cluster, len(payload)), per_block)):
            piece = payload[b : min(b + per_block, len(payload))]
            flags, data = _laced([piece[i : i + FRAME] for i in range(0, len(piece), FRAME)], k)
            body.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (b - c) * 1000 // RATE, flags) + data))
        clusters.append(_element(CLUSTER, b"".join(body)))
    info = _element(INFO, _uint(SCALE, 1_000_000) + _element(0x4489, struct.pack(">d", len(payload) * 1000 / RATE)) + _element(0x4D80, b"grainmill") + _element(0x5741, b"grainmill"))
    head = info + _TRACKS
    points, at = [], len(head)
    for c, data in enumerate(clusters):
        points.append(_element(CUE_POINT, _uint(CUE_TIME, c * per_cluster * 1000 // RATE) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        at += len(data)
    return _HEADER + _element(SEGMENT, head + b"".join(clusters) + _element(CUES, b"".join(points)))


def _vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """The variable-length integer at ``at``, where it ends, and whether all its bits are set (an unknown size)."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"the data end within an integer at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    low = n & (1 << 7 * width) - 1
    return (n if keep_marker else low), at + width, low == (1 << 7 * width) - 1


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose lacing header begins at ``at``."""
    if not lacing:
        return [(at, end)]
    if at >= end:
        raise ValueError("a lacing header beyond its block")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:  # fixed
        each, rest = divmod(end - at, n)
        if rest:
            raise ValueError("fixed-size lacing doesn't divide its block")
        sizes = [each] * n
    elif lacing == 1:  # Xiph
        for _ in range(n - 1):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise ValueError("a lacing header beyond its block")
            sizes.append(size + data[at])
            at += 1
    else:  # EBML: the first size, then signed differences
        for k in range(n - 1):
            first = at
            value, at, _ = _vint(data, at, end)
            sizes.append(value if not k else sizes[-1] + value - (1 << 7 * (at - first) - 1) + 1)
    if lacing != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError("the frames of a block leave it")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def parse(data: bytes) -> dict:
    """Tracks, cues and the packet table of a Matroska file.

    Each packet is (cluster, block, frame, track, timestamp in ns, first byte, size, keyframe). Void elements, checksums
    and unknown elements are passed over; segments and clusters may have unknown sizes. Broken data raise ValueError.
    """
    out: dict = {"tracks": [], "cues": [], "packets": [], "clusters": 0, "blocks": 0, "lacings": [0, 0, 0, 0], "doctype": None}
    state = {"scale": 1_000_000, "cluster": 0}
    default: dict[int, int] = {}

    def uint(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def block(a: int, b: int, simple: bool) -> None:
        track, a, _ = _vint(data, a, b)
        if a + 3 > b:
            raise ValueError("a block without its header")
        rel, flags = struct.unpack_from(">hB", data, a)
        lacing = flags >> 1 & 3
        out["lacings"][lacing] += 1
        when = (state["cluster"] + rel) * state["scale"]
        for k, (x, y) in enumerate(_frames(data, a + 3, b, lacing)):
            out["packets"].append((out["clusters"] - 1, out["blocks"], k, track, when + k * default.get(track, 0), x, y - x, bool(flags & 0x80) if simple else None))
        out["blocks"] += 1

    def leaf(ident: int, body: int, stop: int, holder: dict | None) -> None:
        if ident == EBML:
            inner = body
            while inner < stop:
                kind, inner, _ = _vint(data, inner, stop, keep_marker=True)
                length, inner, _ = _vint(data, inner, stop)
                if kind == 0x4282:
                    out["doctype"] = data[inner : inner + length].decode("ascii", "replace")
                inner += length
        elif ident == TIMESTAMP:
            state["cluster"] = uint(body, stop)
        elif ident == SCALE:
            state["scale"] = uint(body, stop)
        elif ident in (SIMPLE_BLOCK, BLOCK):
            block(body, stop, ident == SIMPLE_BLOCK)
        elif holder is not None:
            if ident == CODEC:
                holder["codec"] = data[body:stop].decode("ascii", "replace")
            elif key := {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "duration", CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER: "cluster"}.get(ident):
                holder[key] = uint(body, stop)

    at, open_ = 0, [(0, len(data), None)]  # the elements that are open: identifier, end, what they describe; as deep as the file says
    while open_:
        parent, end, holder = open_[-1]
        ident = 0
        if at < end:
            ident, body, _ = _vint(data, at, end, keep_marker=True)
        if at >= end or (parent == CLUSTER and ident in _TOP):  # a cluster of unknown size ends where the next element of its level begins
            open_.pop()
            if parent == TRACK_ENTRY and "duration" in holder:
                default[holder["number"]] = holder.pop("duration")
            continue
        size, body, unknown = _vint(data, body, end)
        stop = end if unknown else body + size
        if stop > end:
            raise ValueError(f"an element at byte {at} leaves its parent")
        at = stop
        if ident not in _MASTERS:
            leaf(ident, body, stop, holder)
            continue
        if ident == CLUSTER:
            out["clusters"] += 1
            state["cluster"] = 0
        elif ident == TRACK_ENTRY:
            out["tracks"].append(holder := {"number": None, "type": None, "codec": None})
        elif ident == CUE_POINT:
            out["cues"].append(holder := {"time": None, "track": None, "cluster": None})
        open_.append((ident, stop, holder))
        at = body
    return out


def pad64(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def packets(df: DataFrame, media_col: str = "media", key: str = "doc_id") -> DataFrame:
    """The packet table of a column of Matroska files: one row for each frame.

    A null, empty or broken file gives one row with a null packet and the error; a file is read as a whole, however long and
    however deeply its elements are nested. A file without packets gives no row. Files with equal or null keys each give their
    own rows, told apart by order only; an empty table gives an empty result; further columns are not passed on, whatever their names.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, cluster int, block int, frame int, track int, timestamp_ns bigint, first_byte bigint, n_bytes bigint, keyframe boolean, error string"
    names = ["cluster", "block", "frame", "track", "timestamp_ns", "first_byte", "n_bytes", "keyframe", "error"]
    kinds = [pa.int32()] * 4 + [pa.int64()] * 3 + [pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time: its packets may be many
                data = batch.column(1)[i].as_py()
                try:
                    if not data:
                        raise ValueError("no data")
                    rows = [(*p, None) for p in parse(data)["packets"]]
                except (ValueError, IndexError, struct.error, KeyError, OverflowError) as e:
                    rows = [(None,) * 8 + (str(e) or type(e).__name__,)]
                if rows:
                    columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    own = pa.array([batch.column(0)[i].as_py()] * len(rows), type=batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([own, *columns], names=[key, *names])

    return df.select(key, media_col).mapInArrow(run, schema)


def store_texts(df: DataFrame, text_col: str = "text", key: str = "doc_id", with_media: bool = True) -> DataFrame:
    """Store each whole text as Matroska and read it back through the parser.

    Returns the key, ``n_bytes`` of the unpadded text, the payload's length, digest and tail checksum as read back from the
    stored bytes, the stored form's length and digest, and a feature string (tracks, clusters, blocks, packets, lacings,
    last timestamp, cues, mean sample). ``with_media`` adds the file itself. A null text is the empty one: 64 zero bytes. Long
    texts are stored whole. Equal texts have equal values, whatever their keys; repeated rows and null keys each give a row; an
    empty table gives an empty result; further columns are not passed on, whatever their names.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_media
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media

    def one(text: str | None) -> tuple:
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        media = mux(pad64(raw))
        got = parse(media)
        payload = b"".join(media[p[5] : p[5] + p[6]] for p in got["packets"])
        last = got["packets"][-1]
        feature = f"tracks={len(got['tracks'])};clusters={got['clusters']};blocks={got['blocks']};packets={len(got['packets'])};lacing={','.join(map(str, got['lacings']))};last_ns={last[4]};cues={len(got['cues'])};mean={sum(payload) / len(payload):.3f}"
        row = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        return (*row, media) if with_media else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [one(t) for t in part.column(1).to_pylist()]
                columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[key, *names])

    return df.select(key, text_col).mapInArrow(run, schema + ", media binary" * with_media)
