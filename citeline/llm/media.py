"""Media columns from ISO base media containers, without decoding payloads.

Method. Boxes are walked recursively by their 32- or 64-bit sizes; of each track the sample tables are
decoded (stts durations, stsz/stz2 sizes, stsc chunk runs, stco/co64 chunk offsets, stss sync
samples), and codec, duration and the byte range of every keyframe are stored. Payload bytes in mdat
are never read for that. Of fragmented files the runs of samples (tfhd, trun and the defaults of trex) are added to
their tracks in file order. ``build`` writes a container whose frames are 8x8 grey pictures of 8-bit samples.

Defined cases: null content has error ``null``; content that is empty, cut short or no container has
an error text and null features, never an exception; nesting deeper than any real file's, and tables that claim more
samples than the file has bytes, are errors; very long files cost what their tables cost; no ties arise; a caller's
columns named as the new ones stay and the new ones get an underscore; several tracks come in file order; no sync table
means that every sample is a keyframe; equal contents give equal rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.llm.common import small_batches

#: Boxes that only hold other boxes.
PARENTS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf")
DEEPEST, LONGEST = 32, (1 << 63) - 1
#: A stored frame: 8x8 grey samples of one byte; the rate; frames from one keyframe to the next; frames in a chunk.
FRAME, RATE, KEY_EVERY, IN_CHUNK = 64, 25, 16, 32

TRACK = "struct<track:int,handler:string,codec:string,timescale:long,duration:long,samples:long,media_bytes:long,keyframes:array<struct<offset:long,size:long>>>"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def build(payload: bytes) -> bytes:
    """An ISO container that holds ``payload`` (a positive multiple of 64 bytes) losslessly as grey frames."""
    n = len(payload) // FRAME
    if not n or len(payload) % FRAME:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    chunks, rest = divmod(n, IN_CHUNK)
    runs = [(1, IN_CHUNK)] * (chunks > 0) + [(chunks + 1, rest)] * (rest > 0)
    keys = range(1, n + 1, KEY_EVERY)
    starts = range(0, n, IN_CHUNK)

    def moov(base: int) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, many, 1) for first, many in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64", struct.pack(f">I{len(starts)}Q", len(starts), *(base + s * FRAME for s in starts))),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), matrix, struct.pack(">II", 8 << 16, 8 << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    base = len(head) + len(moov(0)) + 16
    return head + moov(base) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of the boxes between two places."""
    while start < end:
        if end - start < 8:
            raise ValueError("cut box head")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("cut box head")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind.decode('latin-1')} leaves its parent")
        yield kind, body, start + size
        start += size


def tracks(content: bytes) -> list[dict]:
    """Features of each track, from the sample tables alone."""
    data, found = memoryview(content), []
    defaults: dict[int, tuple] = {}  # by track id: duration, size, flags
    fragment: dict = {}

    def table(form: str, at: int, end: int, many: int) -> list[tuple]:
        if at + struct.calcsize(form) * many > end:
            raise ValueError("cut table")
        return list(struct.iter_unpack(form, data[at : at + struct.calcsize(form) * many]))

    def run_of(a: int, b: int) -> None:
        """The samples of a trun box: (offset, size, duration, whether a keyframe), added to their track."""
        flags, n = struct.unpack_from(">II", data, a)
        flags, at = flags & 0xFFFFFF, a + 8
        each = 4 * ((flags >> 8) & 15).bit_count()
        if each * n > b - at or n > len(data):
            raise ValueError("cut table")
        place = fragment["next"]
        if flags & 1:
            place, at = fragment["base"] + struct.unpack_from(">i", data, at)[0], at + 4
        first = None
        if flags & 4:
            first, at = struct.unpack_from(">I", data, at)[0], at + 4
        if each * n > b - at:
            raise ValueError("cut table")
        duration, size, mark = fragment["defaults"]
        for i in range(n):
            own = {}
            for bit in (0x100, 0x200, 0x400, 0x800):
                if flags & bit:
                    own[bit], at = struct.unpack_from(">I", data, at)[0], at + 4
            length = own.get(0x200, size)
            seen = own.get(0x400, first if first is not None and not i else mark)
            fragment["samples"].append((place, length, own.get(0x100, duration), not seen & 0x10000))
            place += length
        if n * size > LONGEST or not 0 <= place <= LONGEST:
            raise ValueError("samples leave the file")
        fragment["next"] = place

    def walk(start: int, end: int, t: dict | None, depth: int = 0) -> None:
        if depth > DEEPEST:
            raise ValueError("boxes nested too deep")
        for kind, a, b in boxes(data, start, end):
            if kind == b"trak":
                found.append(new := {})
                walk(a, b, new, depth + 1)
            elif kind in PARENTS:
                if kind == b"moof":
                    fragment.update(moof=a - 8, next=a - 8)
                walk(a, b, t, depth + 1)
            elif kind == b"trex":
                number, _, *rest = struct.unpack_from(">5I", data, a + 4)
                defaults[number] = tuple(rest)
            elif kind == b"tfhd" and "moof" in fragment:
                flags, number = struct.unpack_from(">II", data, a)
                at, (duration, size, mark), base = a + 8, defaults.get(number, (0, 0, 0)), fragment["moof"]
                if flags & 1:
                    base, at = struct.unpack_from(">Q", data, at)[0], at + 8
                at += 4 * bool(flags & 2)
                given = []
                for bit, old in ((8, duration), (16, size), (32, mark)):
                    given.append(struct.unpack_from(">I", data, at)[0] if flags & bit else old)
                    at += 4 * bool(flags & bit)
                track = next((x for x in found if x.get("id") == number), None)
                if track is None:
                    raise ValueError("fragment of no track")
                fragment.update(base=base, defaults=tuple(given), samples=track.setdefault("runs", []), next=base if flags & 1 else fragment["next"])
            elif kind == b"trun" and "samples" in fragment:
                run_of(a, b)
            elif t is None:
                continue
            elif kind == b"tkhd":
                t["id"] = struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0]
            elif kind == b"mdhd":
                t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
            elif kind == b"hdlr":
                t["handler"] = bytes(data[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd":
                t["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1").rstrip()
            elif kind == b"stts":
                t["stts"] = table(">II", a + 8, b, struct.unpack_from(">I", data, a + 4)[0])
            elif kind == b"stss":
                t["stss"] = [x for (x,) in table(">I", a + 8, b, struct.unpack_from(">I", data, a + 4)[0])]
            elif kind == b"stsc":
                t["stsc"] = table(">III", a + 8, b, struct.unpack_from(">I", data, a + 4)[0])
            elif kind in (b"stco", b"co64"):
                t["chunks"] = [x for (x,) in table(">I" if kind == b"stco" else ">Q", a + 8, b, struct.unpack_from(">I", data, a + 4)[0])]
            elif kind == b"stsz":
                same, n = struct.unpack_from(">II", data, a + 4)
                if same * n > len(data):
                    raise ValueError("samples leave the file")
                t["sizes"] = [same] * n if same else [x for (x,) in table(">I", a + 12, b, n)]
            elif kind == b"stz2":
                bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
                if bits == 4:
                    t["sizes"] = [x for (y,) in table(">B", a + 12, b, (n + 1) // 2) for x in (y >> 4, y & 15)][:n]
                else:
                    t["sizes"] = [x for (x,) in table(">B" if bits == 8 else ">H", a + 12, b, n)]

    try:
        walk(0, len(data), None)
    except (struct.error, IndexError) as short:
        raise ValueError("cut table") from short
    if not found:
        raise ValueError("no track")
    out = []
    for number, t in enumerate(found, 1):
        sizes, chunks, runs = t.get("sizes", []), t.get("chunks", []), t.get("stsc", [])
        places, sample, run = [], 0, 0
        for chunk, at in enumerate(chunks, 1):
            while run + 1 < len(runs) and runs[run + 1][0] <= chunk:
                run += 1
            for _ in range(runs[run][1] if runs else 0):
                if sample == len(sizes):
                    break
                places.append(at)
                at += sizes[sample]
                sample += 1
        if sample < len(sizes):
            raise ValueError("samples outside all chunks")
        sync = t.get("stss") or ([] if "stss" in t else range(1, len(sizes) + 1))
        if any(not 1 <= k <= len(sizes) for k in sync):
            raise ValueError("sync sample that does not exist")
        sync = list(sync)
        for place, size, _, is_key in t.get("runs", []):
            places.append(place)
            sizes.append(size)
            if is_key:
                sync.append(len(sizes))
        if t.get("runs"):
            t["stts"] = [*t.get("stts", []), *((1, each) for _, _, each, _ in t["runs"])]
        longest = max([*(t.get("stts") and [sum(many * each for many, each in t["stts"])] or []), t.get("duration") or 0, *places, 0])
        if longest > LONGEST and t.get("duration") == (1 << 64) - 1:
            t["duration"] = None  # unknown, as the standard writes it
        elif longest > LONGEST:
            raise ValueError("a number is too large")
        out.append({
            "track": number, "handler": t.get("handler"), "codec": t.get("codec"), "timescale": t.get("timescale"),
            "duration": sum(many * each for many, each in t["stts"]) if t.get("stts") else t.get("duration"),
            "samples": len(sizes), "media_bytes": sum(sizes),
            "keyframes": [{"offset": places[k - 1], "size": sizes[k - 1]} for k in sync], "places": places, "sizes": sizes,
        })
    return out


def stored_bytes(content: bytes, track: dict) -> bytes:
    """The samples of a track in order, as stored."""
    return b"".join(content[a : a + n] for a, n in zip(track["places"], track["sizes"]))


def feature(track: dict) -> str:
    """Codec, seconds as a fraction, samples and the byte range of every keyframe, as one line."""
    ranges = ",".join(f"{k['offset']}+{k['size']}" for k in track["keyframes"])
    return f"codec={track['codec']};duration={track['duration']}/{track['timescale']};samples={track['samples']};keyframes={ranges}"


def media_columns(df: DataFrame, content: str = "content") -> DataFrame:
    """All rows with ``tracks`` and ``media_error`` for the containers in a binary column."""

    @F.pandas_udf(f"struct<tracks:array<{TRACK}>,error:string>")
    def run(values):
        import pandas as pd

        out = []
        for v in values:
            try:
                if v is None:
                    raise ValueError("null")
                out.append(([{k: x for k, x in t.items() if k not in ("places", "sizes")} for t in tracks(bytes(v))], None))
            except ValueError as why:
                out.append((None, str(why)))
        return pd.DataFrame({"tracks": [t for t, _ in out], "error": [e for _, e in out]})

    def free(name: str) -> str:
        while name in df.columns:
            name += "_"
        return name

    small_batches(df.sparkSession)
    made = free("_m")
    return df.withColumn(made, run(F.col(content))).withColumns({free("tracks"): F.col(f"{made}.tracks"), free("media_error"): F.col(f"{made}.error")}).drop(made)


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as a container, read the container back and return digests and features."""
    fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                raw = (value.as_py() or "").encode()
                media = build(raw + bytes(-len(raw) % FRAME if raw else FRAME))
                track = tracks(media)[0]
                payload = stored_bytes(media, track)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)))
            columns = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, fields))], names=[key, *(n for n, _ in fields)])

    small_batches(df.sparkSession)
    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in fields)
    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {schema}")
