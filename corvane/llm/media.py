"""Media columns: ISO base media files, read by their boxes alone.

``scan`` walks the nested boxes of a file and decodes the sample tables of all its
tracks, sound, video and others, and the runs of movie fragments; the payload is
never decoded. ``encode`` writes a payload as 8-bit PCM samples of such a file.

Defined cases: a null file gives nulls with the error "null"; a truncated or
malformed file, however its tables contradict each other, gives nulls and the
error's text, and no file stops the job; a file without tracks is an error;
repeated rows give repeated results; an empty table gives an empty result; other
columns are left alone. A null or empty text is stored as 64 zero bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.common import documents

#: Boxes whose payload is a list of boxes (ISO/IEC 14496-12). Fixed values.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}
#: Flags of a fragment's header and run, and the bytes that each field takes. Fixed values.
TFHD = ((0x1, "base", 8), (0x2, "description", 4), (0x8, "duration", 4), (0x10, "size", 4), (0x20, "flags", 4))
TRUN = ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift"))
NOT_SYNC = 0x10000
DEPTH = 16
CHUNK = 4096
RATE = 8000
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class MediaError(ValueError):
    pass


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _table(kind: bytes, rows: np.ndarray) -> bytes:
    return _full(kind, struct.pack(">I", len(rows)), np.asarray(rows, ">u4").tobytes())


def encode(payload: bytes, chunk: int = CHUNK, rate: int = RATE) -> bytes:
    """A movie with one track of unsigned 8-bit mono PCM; a sample is a byte, each chunk starts with a sync sample."""
    n = len(payload)
    whole, rest = divmod(n, chunk)
    chunks = whole + bool(rest)
    runs = [(1, chunk, 1)] * bool(whole) + [(whole + 1, rest, 1)] * bool(rest)
    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))

    def moov(first: int) -> bytes:
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _table(b"stts", np.array([(n, 1)])),
            _table(b"stsc", np.array(runs).reshape(-1, 3)),
            _full(b"stsz", struct.pack(">II", 1, n)),
            _table(b"stco", first + chunk * np.arange(chunks)),
            _table(b"stss", 1 + chunk * np.arange(chunks)),
        )
        dref = _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", dref), stbl)
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n, 0x55C4, 0))
        mdia = _box(b"mdia", mdhd, _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIII", 0, 0, rate, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    start = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(start) + _box(b"mdat", payload)


def boxes(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, end) of the payload of every box, containers before what they hold."""
    end = len(data) if end is None else end
    if len(path) > DEPTH:
        raise MediaError(f"boxes nested deeper than {DEPTH}")
    while start < end:
        if end - start < 8:
            raise MediaError(f"{end - start} stray bytes at {start}")
        size, kind, head = int.from_bytes(data[start : start + 4], "big"), bytes(data[start + 4 : start + 8]), 8
        if size == 1:
            size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise MediaError(f"box {kind!r} at {start} has size {size}")
        here = (*path, kind)
        yield here, start + head, start + size
        if kind in CONTAINERS:
            yield from boxes(data, start + head, start + size, here)
        start += size


def _ints(data: bytes, at: int, end: int, n: int, width: int = 1, kind: str = ">u4") -> np.ndarray:
    size = n * width * np.dtype(kind).itemsize
    if at + size > end:
        raise MediaError(f"a table of {n} entries ends beyond its box")
    return np.frombuffer(data, kind, n * width, at).astype(np.int64).reshape(n, width)


def _field(data: bytes, fmt: str, at: int, end: int) -> tuple:
    if at < 0 or at + struct.calcsize(fmt) > end:
        raise MediaError(f"a box ends within its field at {at}")
    return struct.unpack_from(fmt, data, at)


def _rows(data: bytes, span: tuple[int, int], width: int = 1, kind: str = ">u4") -> np.ndarray:
    """A table that begins with its number of entries."""
    (n,) = _field(data, ">I", span[0] + 4, span[1])
    return _ints(data, span[0] + 8, span[1], n, width, kind)


def _entry(data: bytes, span: tuple[int, int], handler: str) -> dict:
    """The first sample description: codec, and what sound or video entries say of their form."""
    lo, hi = span
    (count,) = _field(data, ">I", lo + 4, hi)
    if not count:
        raise MediaError("no sample description")
    out = {"codec": data[lo + 12 : lo + 16].decode("latin-1"), "channels": None, "bits": None, "rate": None, "width": None, "height": None}
    if handler == "soun":
        out["channels"], out["bits"], _, _, rate = _field(data, ">HHHHI", lo + 32, hi)
        out["rate"] = rate >> 16
    elif handler == "vide":
        out["width"], out["height"] = _field(data, ">HH", lo + 40, hi)
    return out


def _samples(data: bytes, at: dict, n: int, fixed: int) -> dict:
    """Chunks and keyframes as (start, length), total duration, and the largest composition shift."""
    stts = _rows(data, at[b"stts"], 2)
    if int(stts[:, 0].sum()) != n:
        raise MediaError("stts and stsz disagree")
    sizes = None if fixed else _ints(data, at[b"stsz"][0] + 12, at[b"stsz"][1], n)[:, 0]
    if b"stco" in at:
        offsets = _rows(data, at[b"stco"])[:, 0]
    elif b"co64" in at:
        offsets = _rows(data, at[b"co64"], 1, ">u8")[:, 0]
    else:
        raise MediaError("no chunk offsets")
    runs = _rows(data, at[b"stsc"], 3)
    first = np.append(runs[:, 0], len(offsets) + 1)
    if len(offsets) and (not len(runs) or first[0] != 1) or (np.diff(first) < 0).any() or len(first) > 2 and (np.diff(first[:-1]) <= 0).any():
        raise MediaError("stsc does not run from the first chunk to the last")
    per = np.repeat(runs[:, 1], np.diff(first)) if len(offsets) else np.zeros(0, np.int64)
    if len(per) != len(offsets) or int(per.sum()) != n:
        raise MediaError("stsc, stco and stsz disagree")
    first = np.concatenate(([0], np.cumsum(per)))  # of each chunk
    ends = fixed * np.arange(n + 1, dtype=np.int64) if fixed else np.concatenate(([0], np.cumsum(sizes)))
    lengths = ends[first[1:]] - ends[first[:-1]]
    if len(offsets) and (int(offsets.min()) < 0 or int((offsets + lengths).max()) > len(data)):
        raise MediaError("a chunk ends beyond the file")
    if b"stss" in at:
        sync = _rows(data, at[b"stss"])[:, 0] - 1
        if len(sync) and (sync[0] < 0 or sync[-1] >= n or (np.diff(sync) <= 0).any()):
            raise MediaError("stss does not name samples in order")
        chunk = np.searchsorted(first, sync, "right") - 1
        stop = np.minimum(np.append(sync[1:], n), first[chunk + 1])[: len(sync)]
        keys = np.stack((offsets[chunk] + ends[sync] - ends[first[chunk]], ends[stop] - ends[sync]), 1)
    else:
        keys = np.stack((offsets, lengths), 1)
    shift = 0
    if b"ctts" in at:
        ctts = _rows(data, at[b"ctts"], 2, ">i4" if data[at[b"ctts"][0]] else ">u4")
        if int(ctts[:, 0].sum()) != n:
            raise MediaError("ctts and stsz disagree")
        shift = int(ctts[:, 1].max(initial=0))
    return {"chunks": np.stack((offsets, lengths), 1), "keyframes": keys, "ticks": int((stts[:, 0] * stts[:, 1]).sum()), "shift": shift}


def _track(data: bytes, at: dict) -> dict:
    if missing := [k for k in (b"tkhd", b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz") if k not in at]:
        raise MediaError(f"no box {missing[0]!r}")
    lo, hi = at[b"tkhd"]
    (number,) = _field(data, ">I", lo + (20 if data[lo] else 12), hi)
    lo, hi = at[b"mdhd"]
    timescale, duration = _field(data, ">IQ", lo + 20, hi) if data[lo] else _field(data, ">II", lo + 12, hi)
    handler = data[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12].decode("latin-1")
    fixed, n = _field(data, ">II", at[b"stsz"][0] + 4, at[b"stsz"][1])
    return {"track": number, "handler": handler, "timescale": timescale, "duration": duration, "samples": n, **_entry(data, at[b"stsd"], handler), **_samples(data, at, n, fixed)}


def _fragment(data: bytes, moof: int, found: list[tuple], tracks: dict[int, dict], defaults: dict[int, tuple]) -> None:
    """Add the runs of one movie fragment to their tracks."""
    head: dict = {}
    for kind, lo, hi in found:
        flags = int.from_bytes(data[lo + 1 : lo + 4], "big")
        if kind == b"tfhd":
            (number,) = _field(data, ">I", lo + 4, hi)
            if number not in tracks:
                raise MediaError(f"a fragment of track {number}, which is not there")
            duration, size, sync = defaults.get(number, (0, 0, 0))
            head, at = {"track": tracks[number], "base": moof, "duration": duration, "size": size, "flags": sync}, lo + 8
            for bit, name, width in TFHD:
                if flags & bit:
                    (head[name],) = _field(data, ">Q" if width == 8 else ">I", at, hi)
                    at += width
        elif kind == b"trun":
            if not head:
                raise MediaError("a run without its fragment's header")
            (n,) = _field(data, ">I", lo + 4, hi)
            at, start, first = lo + 8, head["base"], None
            if flags & 1:
                start += _field(data, ">i", at, hi)[0]
                at += 4
            if flags & 4:
                (first,) = _field(data, ">I", at, hi)
                at += 4
            names = [name for bit, name in TRUN if flags & bit]
            table = _ints(data, at, hi, n, len(names)) if names else np.zeros((n, 0), np.int64)
            columns = {name: table[:, k] for k, name in enumerate(names)}
            sizes = columns.get("size", np.full(n, head["size"], np.int64))
            marks = columns.get("flags", np.full(n, head["flags"], np.int64)).copy()
            if first is not None and n:
                marks[0] = first
            starts = start + np.cumsum(sizes) - sizes
            if n and (start < 0 or int(starts[-1] + sizes[-1]) > len(data)):
                raise MediaError("a run ends beyond the file")
            sync, track = (marks & NOT_SYNC) == 0, head["track"]
            track["chunks"] = np.concatenate((track["chunks"], [(start, int(sizes.sum()))])) if n else track["chunks"]
            track["keyframes"] = np.concatenate((track["keyframes"], np.stack((starts[sync], sizes[sync]), 1)))
            track["samples"] += n
            track["ticks"] += int(columns.get("duration", np.full(n, head["duration"], np.int64)).sum())
            head["base"] = int(starts[-1] + sizes[-1]) if n and not flags & 1 else head["base"]


def tracks(data: bytes) -> list[dict]:
    """Every track: number, handler, codec, form, timescale, duration, samples; starts and lengths of chunks and of keyframes.

    A keyframe's range runs from its sync sample to the next sync sample or the end
    of its chunk; in fragments it is the sample. Without a table of sync samples
    every sample is one, and ranges are whole chunks.
    """
    parts: list[dict[bytes, tuple[int, int]]] = []
    fragments: list[tuple[int, list[tuple]]] = []
    defaults: dict[int, tuple] = {}
    for path, lo, hi in boxes(data):
        if path[-1] == b"trak":
            parts.append({})
        elif path[-1] == b"moof":
            fragments.append((lo - 8, []))
        elif b"trak" in path:
            parts[-1].setdefault(path[-1], (lo, hi))
        elif path[-1] == b"trex":
            number, _, duration, size, sync = _field(data, ">IIIII", lo + 4, hi)
            defaults[number] = (duration, size, sync)
        elif b"traf" in path and path[-1] in (b"tfhd", b"trun"):
            fragments[-1][1].append((path[-1], lo, hi))
    if not parts:
        raise MediaError("no tracks")
    found = [_track(data, at) for at in parts]
    for moof, runs in fragments:
        _fragment(data, moof, runs, {t["track"]: t for t in found}, defaults)
    for t in found:
        t["duration"] = t["duration"] or t["ticks"]
    return found


def scan(data: bytes) -> dict:
    """The first sound track of ``tracks``, or else the first track."""
    try:
        found = tracks(data)
    except (ValueError, IndexError, OverflowError, MemoryError, struct.error) as e:
        raise e if isinstance(e, MediaError) else MediaError(str(e)) from e
    return next((t for t in found if t["handler"] == "soun"), found[0])


def payload(data: bytes, found: dict) -> bytes:
    """The stored bytes, by the chunk table."""
    return b"".join(data[a : a + n] for a, n in found["chunks"].tolist())


def feature(found: dict) -> str:
    keys = ",".join(f"{a}+{n}" for a, n in found["keyframes"].tolist())
    return f"codec={found['codec'].strip()};channels={found['channels']};bits={found['bits']};rate={found['rate']};duration={found['duration']}/{found['timescale']};samples={found['samples']};keyframes={keys}"


RANGES = "array<struct<offset:long,length:long>>"
TRACK = f"struct<track:long,handler:string,codec:string,duration:double,samples:long,channels:int,bits:int,rate:int,width:int,height:int,keyframes:{RANGES}>"
SCAN_SCHEMA = f"codec string, duration double, samples long, keyframes {RANGES}, tracks array<{TRACK}>, error string"


def media_columns(df: DataFrame, column: str, key: str) -> DataFrame:
    """The key column with every track of each file of a binary column, and those of the first sound track (or first track) as columns."""
    kind = df.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    i, s = pa.int32(), pa.string()
    track = pa.struct([("track", pa.int64()), ("handler", s), ("codec", s), ("duration", pa.float64()), ("samples", pa.int64()), ("channels", i), ("bits", i), ("rate", i), ("width", i), ("height", i), ("keyframes", span)])

    def told(t: dict) -> dict:
        ranges = [{"offset": a, "length": n} for a, n in t["keyframes"].tolist()]
        return t | {"duration": t["duration"] / t["timescale"] if t["timescale"] else None, "keyframes": ranges}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                try:
                    if data is None:
                        raise MediaError("null")
                    found = [told(t) for t in tracks(data)]
                    x = next((t for t in found if t["handler"] == "soun"), found[0])
                    rows.append((x["codec"], x["duration"], x["samples"], x["keyframes"], [{f.name: t[f.name] for f in track} for t in found], None))
                except (ValueError, IndexError, OverflowError, MemoryError, struct.error) as e:
                    rows.append((None, None, None, None, None, str(e) or type(e).__name__))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [s, pa.float64(), pa.int64(), span, pa.list_(track), s]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [key, "codec", "duration", "samples", "keyframes", "tracks", "error"])

    return df.select(key, column).mapInArrow(each, f"`{key}` {kind}, {SCAN_SCHEMA}")


def stored_texts(docs: DataFrame) -> DataFrame:
    """Every whole text as a stored media file, and what reading that file back gives."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in b.column(1).to_pylist():
                raw = (text or "").encode()
                pad = max(64, -(-len(raw) // 64) * 64) - len(raw)
                media = encode(raw + bytes(pad))
                found = scan(media)
                back = payload(media, found)
                row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(found))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            s, i = pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, (i, i, s, i, i, s, s), strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(
        each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(documents(spark, sf_dir))
