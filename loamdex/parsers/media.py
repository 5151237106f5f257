"""Images and sound as sentences that can be searched."""

from __future__ import annotations

import io
import re
import struct
import unicodedata
import wave

from loamdex.parsers.base import Document, lossy
from loamdex.sources.mime import sniff

# What the formats are called, and what is said of each.
IMAGE_MIMES = ("image/png", "image/jpeg", "image/gif", "image/webp", "image/svg+xml", "image/bmp", "image/tiff", "image/x-icon")
IMAGE_EXTENSIONS = frozenset("png jpg jpeg gif webp svg bmp tiff tif ico".split())
IMAGE_NOTES = {
    "png": "PNG lossless image",
    "jpg": "JPEG photograph image",
    "jpeg": "JPEG photograph image",
    "gif": "GIF image animation",
    "webp": "WebP image",
    "svg": "SVG vector graphic scalable",
    "bmp": "BMP bitmap image",
    "ico": "icon favicon",
}
AUDIO_MIMES = ("audio/mpeg", "audio/wav", "audio/flac", "audio/ogg", "audio/aac", "audio/mp4", "audio/x-wav")
AUDIO_LABELS = {"mp3": "MP3", "wav": "WAV", "flac": "FLAC", "ogg": "OGG", "aac": "AAC", "m4a": "M4A", "wma": "WMA", "opus": "Opus"}


def _jpeg_size(raw: bytes) -> tuple[int, int] | None:
    at = 2
    while raw[:2] == b"\xff\xd8" and at + 9 < len(raw):
        if raw[at] != 0xFF:
            at += 1
        elif raw[at + 1] in (0xC0, 0xC2):
            height, width = struct.unpack_from(">HH", raw, at + 5)
            return width, height
        else:
            at += 2 + struct.unpack_from(">H", raw, at + 2)[0]
    return None


def image_size(raw: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, JPEG, GIF, WebP or BMP."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return struct.unpack_from(">II", raw, 16)
    if raw[:3] == b"GIF" and len(raw) >= 10:
        return struct.unpack_from("<HH", raw, 6)
    if raw[:2] == b"BM" and len(raw) >= 26:
        return struct.unpack_from("<II", raw, 18)
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP" and len(raw) >= 30:
        if raw[12:16] == b"VP8 " and raw[23:26] == b"\x9d\x01\x2a":
            return tuple(x & 0x3FFF for x in struct.unpack_from("<HH", raw, 26))
        if raw[12:16] == b"VP8L":
            bits = struct.unpack_from("<I", raw, 21)[0]
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        return None
    return _jpeg_size(raw)


def _shape(width: int, height: int) -> str:
    if width == height:
        return "square image"
    if width > 2 * height:
        return "panoramic wide image"
    if height > 2 * width:
        return "tall vertical image"
    return "landscape orientation" if width > height else "portrait orientation"


def svg_text(body: str) -> str:
    """What stands in the titles, descriptions and texts of a drawing."""
    found = [m for tag in ("title", "desc", "text") for m in re.findall(rf"<{tag}[^>]*>(.*?)</{tag}>", body, re.S)]
    clean = ("".join(c for c in x if unicodedata.category(c) != "Cc").strip() for x in found)
    return ". ".join(c for c in clean if c)


def image(raw: bytes, mime: str | None = None, extension: str | None = None) -> Document:
    kind, ext = sniff(raw) or mime or "image/unknown", extension or "image"
    known = {"extension": ext, "size_bytes": str(len(raw))} | ({"format": kind} if sniff(raw) else {})
    said = [f"Image file ({ext.upper()})"]
    if size := image_size(raw) if kind.startswith("image/") else None:
        width, height = size
        known |= {"width": str(width), "height": str(height)}
        said += [f"{width}x{height} pixels", _shape(width, height)]
        pixels = width * height / 1e6
        said += ["high resolution"] if pixels > 8 else ["thumbnail icon small"] if pixels < 0.1 else []
    if (ext == "svg" or "svg" in kind) and (words := svg_text(lossy(raw))):
        said.append(words)
    if ext in IMAGE_NOTES:
        said.append(IMAGE_NOTES[ext])
    return Document(". ".join(said), "image", metadata=known)


def duration(seconds: float) -> str:
    """M:SS, or H:MM:SS from an hour on."""
    whole = int(seconds + 0.5)
    minutes, rest = divmod(whole, 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}:{minutes:02}:{rest:02}" if hours else f"{minutes}:{rest:02}"


def _wav(raw: bytes) -> dict:
    with wave.open(io.BytesIO(raw)) as w:
        return {"rate": w.getframerate(), "channels": w.getnchannels(), "frames": w.getnframes(), "codec": f"pcm_s{8 * w.getsampwidth()}le"}


def _flac(raw: bytes) -> dict:
    """The first block of a FLAC file, and its comments."""
    if raw[:4] != b"fLaC":
        raise ValueError("no FLAC header")
    bits = int.from_bytes(raw[18:26], "big")
    found = {"rate": bits >> 44, "channels": (bits >> 41 & 7) + 1, "frames": bits & (1 << 36) - 1, "codec": "flac", "tags": {}}
    at, last = 4, False
    while not last and at + 4 <= len(raw):
        last, kind, size = bool(raw[at] & 128), raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        if kind == 4:
            found["tags"] = _comments(raw[at + 4 : at + 4 + size])
        at += 4 + size
    return found


def _comments(block: bytes) -> dict[str, str]:
    at = 4 + struct.unpack_from("<I", block)[0]
    n = struct.unpack_from("<I", block, at)[0]
    at, tags = at + 4, {}
    for _ in range(n):
        size = struct.unpack_from("<I", block, at)[0]
        key, _, value = lossy(block[at + 4 : at + 4 + size]).partition("=")
        tags[key.lower()] = value
        at += 4 + size
    return tags


_FRAMES = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TCON": "genre", "TDRC": "year", "TYER": "year"}
_RATES = (44100, 48000, 32000)


def _mp3(raw: bytes) -> dict:
    """Tags of version 2, and rate and channels of the first frame."""
    tags, at = {}, 0
    if raw[:3] == b"ID3":
        end = 10 + sum((b & 127) << s for b, s in zip(raw[6:10], (21, 14, 7, 0), strict=True))
        at = 10
        while at + 10 < end and raw[at : at + 4] in {k.encode() for k in _FRAMES} | {b"TSSE", b"COMM", b"TRCK", b"APIC", b"TXXX"}:
            size = int.from_bytes(raw[at + 4 : at + 8], "big") if raw[3] < 4 else sum((b & 127) << s for b, s in zip(raw[at + 4 : at + 8], (21, 14, 7, 0), strict=True))
            name, body = _FRAMES.get(raw[at : at + 4].decode()), raw[at + 10 : at + 10 + size]
            if name and body:
                tags[name] = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace").strip("\0")
            at += 10 + size
        at = end
    frame = re.compile(rb"\xff[\xfa\xfb\xf2\xf3]").search(raw, at)
    if not frame or frame.start() + 4 > len(raw):
        raise ValueError("no frame")
    head = raw[frame.start() : frame.start() + 4]
    rate = _RATES[min(head[2] >> 2 & 3, 2)] // (1 if head[1] & 8 else 2)
    return {"rate": rate, "channels": 1 if head[3] >> 6 == 3 else 2, "codec": "mp3", "tags": tags}


_READERS = ((b"RIFF", _wav), (b"fLaC", _flac), (b"ID3", _mp3), (b"\xff\xfb", _mp3), (b"\xff\xfa", _mp3), (b"\xff\xf3", _mp3))


def audio(raw: bytes, mime: str | None = None, extension: str | None = None) -> Document:
    """Rate, channels, length, codec and tags of a recording; of what can't be read, that it is there."""
    label, known = AUDIO_LABELS.get((extension or "").lower(), "Audio"), {"extension": extension or "audio"}
    try:
        found = next(read for head, read in _READERS if raw.startswith(head))(raw)
    except (StopIteration, ValueError, EOFError, IndexError, RuntimeError, struct.error, wave.Error):
        known |= {"size_bytes": str(len(raw)), "parse_method": "fallback"}
        return Document(f"Audio file ({label}). Format could not be fully parsed. Size: {len(raw)} bytes", "audio", metadata=known)
    rate, channels, frames = found["rate"], found["channels"], found.get("frames")
    known |= {"codec": found["codec"], "sample_rate": str(rate), "channels": str(channels)}
    said = [f"Audio file ({label})", f"Sample rate: {rate} Hz", {1: "Mono", 2: "Stereo"}.get(channels, f"{channels} channels")]
    if frames and rate:
        known |= {"duration_seconds": f"{frames / rate:.2f}", "duration": duration(frames / rate)}
        said.append(f"Duration: {known['duration']}")
    said.append(f"Codec: {found['codec']}")
    tags = found.get("tags", {})
    for name in ("title", "artist", "album", "genre"):
        if name in tags:
            known[name] = tags[name]
            said.append(f"{name.capitalize()}: {tags[name]}")
    if year := tags.get("year") or tags.get("date"):
        known["year"] = year
    return Document(". ".join(said), "audio", tags.get("title"), metadata=known)
