"""Raster file formats as bytes: half planes, scanline EXR, RGBE and uncompressed DNG. Pure NumPy, used in Arrow kernels."""

from __future__ import annotations

import struct
import zlib

import numpy as np

CFA_ORDER = ("RGGB", "GRBG", "GBRG", "BGGR")  # positions are stored in files
PLANE_MAGIC = 0x48524632  # "HRF2"


def to_half(values: np.ndarray) -> np.ndarray:
    """IEEE half floats of what a half can hold; NaN is 0."""
    return np.clip(np.nan_to_num(values, nan=0.0, posinf=65504, neginf=-65504), -65504, 65504).astype(np.float16)


def write_plane(raster: np.ndarray, cfa: str = "RGGB") -> bytes:
    """height x width x channels -> five big-endian numbers, then big-endian halves."""
    h, w, c = raster.shape
    return struct.pack(">5i", PLANE_MAGIC, w, h, c, CFA_ORDER.index(cfa)) + to_half(raster).astype(">f2").tobytes()


def plane_bytes(width: int, height: int, channels: int) -> int:
    return 20 + 2 * width * height * channels


def read_plane(data: bytes) -> tuple[np.ndarray, str]:
    magic, w, h, c, cfa = struct.unpack_from(">5i", data)
    if magic != PLANE_MAGIC:
        raise ValueError("not a half-float plane")
    if len(data) != plane_bytes(w, h, c):
        raise ValueError("a plane of the wrong length")
    return np.frombuffer(data, ">f2", offset=20).astype(np.float32).reshape(h, w, c), CFA_ORDER[cfa]


# --- EXR ------------------------------------------------------------------------------------------------

EXR_MAGIC, EXR_NONE, EXR_ZIPS = 20000630, 0, 2


def _zip(raw: bytes) -> bytes:
    """A scanline as EXR packs it: halves of bytes apart, differences, then deflate."""
    b = np.frombuffer(raw, np.uint8)
    apart = np.concatenate([b[0::2], b[1::2]]).astype(np.int16)
    apart[1:] = (apart[1:] - apart[:-1] + 128) & 255
    return zlib.compress(apart.astype(np.uint8).tobytes())


def _unzip(packed: bytes, size: int) -> bytes:
    d = np.frombuffer(zlib.decompress(packed), np.uint8).astype(np.int64)
    d[1:] -= 128
    b = (np.cumsum(d) & 255).astype(np.uint8)
    out = np.empty(size, np.uint8)
    out[0::2], out[1::2] = b[: (size + 1) // 2], b[(size + 1) // 2 :]
    return out.tobytes()


def _attribute(name: str, kind: str, value: bytes) -> bytes:
    return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(value)) + value


def exr_header(width: int, height: int, compression: int) -> bytes:
    channel = lambda n: n + b"\0" + struct.pack("<iB3xii", 1, 0, 1, 1)
    box = struct.pack("<4i", 0, 0, width - 1, height - 1)
    return struct.pack("<ii", EXR_MAGIC, 2) + b"".join([
        _attribute("channels", "chlist", channel(b"B") + channel(b"G") + channel(b"R") + b"\0"),
        _attribute("compression", "compression", bytes([compression])),
        _attribute("dataWindow", "box2i", box),
        _attribute("displayWindow", "box2i", box),
        _attribute("lineOrder", "lineOrder", b"\0"),
        _attribute("pixelAspectRatio", "float", struct.pack("<f", 1.0)),
        _attribute("screenWindowCenter", "v2f", struct.pack("<2f", 0, 0)),
        _attribute("screenWindowWidth", "float", struct.pack("<f", 1.0)),
    ]) + b"\0"


def exr_line(y: int, rgb: np.ndarray, compression: int) -> bytes:
    """One scanline block of width x 3 values; packed only where that makes it smaller."""
    raw = to_half(rgb[:, ::-1]).T.astype("<f2").tobytes()
    packed = _zip(raw) if compression == EXR_ZIPS else raw
    body = packed if len(packed) < len(raw) else raw
    return struct.pack("<ii", y, len(body)) + body


def assemble_exr(width: int, height: int, compression: int, lines: list[bytes]) -> bytes:
    header = exr_header(width, height, compression)
    at = len(header) + 8 * height
    offsets = at + np.concatenate([[0], np.cumsum([len(x) for x in lines])[:-1]]).astype(np.int64) if lines else np.empty(0, np.int64)
    return header + offsets.astype("<i8").tobytes() + b"".join(lines)


def write_exr(rgb: np.ndarray, compression: int = EXR_ZIPS) -> bytes:
    h, w, _ = rgb.shape
    return assemble_exr(w, h, compression, [exr_line(y, rgb[y], compression) for y in range(h)])


def read_exr(data: bytes) -> np.ndarray:
    """height x width x 3 of a scanline file of half channels, uncompressed or deflated by line."""
    magic, _ = struct.unpack_from("<ii", data)
    if magic != EXR_MAGIC:
        raise ValueError("not an EXR file")
    at, attributes = 8, {}
    while data[at]:
        end = data.index(0, at)
        kind_end = data.index(0, end + 1)
        (size,) = struct.unpack_from("<i", data, kind_end + 1)
        attributes[data[at:end].decode()] = data[kind_end + 5 : kind_end + 5 + size]
        at = kind_end + 5 + size
    at += 1
    names, chlist, k = [], attributes["channels"], 0
    while chlist[k]:
        end = chlist.index(0, k)
        if struct.unpack_from("<i", chlist, end + 1)[0] != 1:
            raise ValueError("only half channels are read")
        names.append(chlist[k:end].decode())
        k = end + 17
    if not {"R", "G", "B"} <= set(names):
        raise ValueError("R, G and B are wanted")
    compression = attributes["compression"][0]
    if compression not in (EXR_NONE, EXR_ZIPS):
        raise ValueError("only uncompressed and line-wise deflated files are read")
    x0, y0, x1, y1 = struct.unpack("<4i", attributes["dataWindow"])
    w, h = x1 - x0 + 1, y1 - y0 + 1
    out, size = np.empty((h, w, 3), np.float32), 2 * w * len(names)
    for start in np.frombuffer(data, "<i8", h, at):
        y, n = struct.unpack_from("<ii", data, start)
        body = data[start + 8 : start + 8 + n]
        raw = body if n == size else _unzip(body, size)
        line = np.frombuffer(raw, "<f2").reshape(len(names), w)
        for c, name in enumerate("RGB"):
            out[y - y0, :, c] = line[names.index(name)]
    return out


# --- RGBE -----------------------------------------------------------------------------------------------

def to_rgbe(rgb: np.ndarray) -> np.ndarray:
    top = rgb.max(axis=-1)
    mantissa, exponent = np.frexp(np.maximum(top, 1e-38))
    scale = np.where(top > 1e-32, mantissa * 256 / np.maximum(top, 1e-38), 0)
    out = np.zeros((*rgb.shape[:-1], 4), np.uint8)
    out[..., :3] = np.clip(rgb * scale[..., None], 0, 255)
    out[..., 3] = np.where(top > 1e-32, exponent + 128, 0)
    return out


def from_rgbe(x: np.ndarray) -> np.ndarray:
    """Mantissas stand for the middle of their step; exponent 0 is black."""
    scale = np.ldexp(1.0, x[..., 3].astype(int) - 136)
    return np.where(x[..., 3:] > 0, (x[..., :3] + 0.5) * scale[..., None], 0).astype(np.float32)


def _runs(values: np.ndarray) -> bytes:
    out, at, n = bytearray(), 0, len(values)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(values.astype(int))) + 1, [n]])
    literal = 0
    def flush(until: int) -> None:
        nonlocal literal
        while literal < until:
            k = min(128, until - literal)
            out.append(k)
            out.extend(values[literal : literal + k].tobytes())
            literal += k
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= 4:
            flush(a)
            at = a
            while at < b:
                k = min(127, b - at)
                out += bytes([128 + k, values[at]])
                at += k
            literal = b
    flush(n)
    return bytes(out)


def write_rgbe(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    head, px = f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {h} +X {w}\n".encode(), to_rgbe(rgb)
    if not 8 <= w <= 32767:
        return head + px.tobytes()
    return head + b"".join(bytes([2, 2, w >> 8, w & 255]) + b"".join(_runs(px[y, :, c]) for c in range(4)) for y in range(h))


def read_rgbe(data: bytes) -> np.ndarray:
    if not data.startswith(b"#?"):
        raise ValueError("not a Radiance file")
    at = data.index(b"\n\n") + 2
    end = data.index(b"\n", at)
    fields = data[at:end].split()
    if len(fields) != 4 or fields[0] != b"-Y" or fields[2] != b"+X":
        raise ValueError("only files from top to bottom, left to right are read")
    h, w, at = int(fields[1]), int(fields[3]), end + 1
    out = np.empty((h, w, 4), np.uint8)
    for y in range(h):
        if not (8 <= w <= 32767 and data[at : at + 2] == b"\x02\x02" and not data[at + 2] & 128):
            out[y] = np.frombuffer(data, np.uint8, 4 * w, at).reshape(w, 4)
            at += 4 * w
            continue
        at += 4
        for c in range(4):
            line = bytearray()
            while len(line) < w:
                n = data[at]
                if n > 128:
                    line += data[at + 1 : at + 2] * (n - 128)
                    at += 2
                else:
                    line += data[at + 1 : at + 1 + n]
                    at += 1 + n
            out[y, :, c] = np.frombuffer(bytes(line), np.uint8)
    return from_rgbe(out)


# --- DNG ------------------------------------------------------------------------------------------------

def read_dng(data: bytes) -> np.ndarray:
    """height x width counts of an uncompressed one-sample strip file, either byte order."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = {1: 1, 3: 2, 4: 4}.get(kind)
        if size is None:
            continue
        where = at + 10 + 12 * k if size * count <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(order + str(count) + {1: "B", 2: "H", 4: "I"}[size], data, where)
    width, height, bits = tags[256][0], tags[257][0], tags.get(258, (16,))[0]
    if tags.get(277, (1,))[0] != 1 or bits != 16 or tags.get(259, (1,))[0] != 1:
        raise ValueError("one uncompressed sample of 16 bits is wanted")
    body = b"".join(data[a : a + s] for a, s in zip(tags[273], tags[279], strict=True))
    return np.frombuffer(body, order + "u2").reshape(height, width)


def write_dng(counts: np.ndarray) -> bytes:
    h, w = counts.shape
    body = counts.astype("<u2").tobytes()
    entries = [(256, 4, w), (257, 4, h), (258, 3, 16), (259, 3, 1), (262, 3, 32803), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(body))]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries) + b"\0\0\0\0"
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + ifd


# --- camera planes --------------------------------------------------------------------------------------

def srgb_table() -> np.ndarray:
    """Linear values of the 256 encoded ones."""
    x = np.arange(256) / 255
    return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4).astype(np.float32)


def luma_plane(y: np.ndarray, step: int) -> np.ndarray:
    return (y[::step, ::step] / np.float32(255)).astype(np.float32)


def yuv_to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Full-range BT.601 with half-size chroma planes, clamped to 0..1."""
    up = lambda p: np.repeat(np.repeat(p, 2, 0), 2, 1)[: y.shape[0], : y.shape[1]].astype(float) - 128
    l, cb, cr = y.astype(float), up(u), up(v)
    rgb = np.stack([l + 1.402 * cr, l - 0.344136 * cb - 0.714136 * cr, l + 1.772 * cb], axis=-1)
    return (np.clip(rgb, 0, 255) / 255).astype(np.float32)


# --- 8-bit images ---------------------------------------------------------------------------------------

PNG_MAGIC, PNG_CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 4: 2, 6: 4}


def png(rgb: np.ndarray) -> bytes:
    """height x width x 3 bytes as a PNG."""
    h, w, _ = rgb.shape
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    lines = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A PNG line from its differences: to the left, above, their mean, or the nearest of three."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.add.accumulate(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = [0] * len(row)
    for i, (d, up) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        left = out[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + up) // 2
        else:
            corner = int(above[i - step]) if i >= step else 0
            guess = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
        out[i] = (d + guess) % 256
    return np.array(out, np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """height x width x channels bytes of an 8-bit PNG without interlacing; alpha is dropped."""
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        size, tag = struct.unpack(">I4s", data[at : at + 8])
        if tag == b"IHDR":
            head = struct.unpack(">2I5B", data[at + 8 : at + 21])
        elif tag == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in PNG_CHANNELS or head[6]:
        raise ValueError("only 8-bit PNGs of grey or RGB, not interlaced")
    w, h, channels = head[0], head[1], PNG_CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * channels)
    lines, above = [], np.zeros(w * channels, np.uint8)
    for line in raw:
        above = _unfiltered(int(line[0]), line[1:], above, channels)
        lines.append(above)
    image = np.stack(lines).reshape(h, w, channels) if lines else np.zeros((0, w, channels), np.uint8)
    return image[..., : channels - 1] if head[3] in (4, 6) else image


def linear_image(data: bytes) -> np.ndarray:
    """An 8-bit image as linear values, by the table of its 256 levels."""
    return srgb_table()[read_png(data)]
