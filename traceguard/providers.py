"""Models that a deployment may plug in. Without them every score is 0 and every list empty, as when one fails to load.

A provider is a factory without arguments, called once in each Python worker; what it returns takes a list of
texts (or of images) and returns as many results. If that fails for a list, its items are tried one by one, and
those that fail count as "no result".
"""

from __future__ import annotations

import ipaddress
import logging
import math
import socket
import struct
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterable, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
ScoreProvider = Callable[[], Callable[[Sequence[str]], Sequence[float]]]
VectorProvider = Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]
#: Names and places in texts: for each text a list of (entity, start, end, score), in characters.
EntityProvider = Callable[[], Callable[[Sequence[str]], Sequence[Sequence[tuple[str, int, int, float]]]]]
OcrProvider = Callable[[], Callable[[Sequence[bytes]], Sequence[str]]]
#: What gets an image: a function of a URL that was found to be public, returning its bytes or None.
Fetcher = Callable[[str], bytes | None]

# Limits of one image in bytes and pixels, of its download and of reading a message's images in seconds.
MOST_IMAGE_BYTES, MOST_IMAGE_PIXELS = 8 * 1024 * 1024, 40_000_000
FETCH_SECONDS, OCR_SECONDS = 8.0, 12.0

#: Providers by id with a name of their own; held here, so that no id is ever used again.
_names: dict[int, tuple[object, str]] = {}
#: Loaded models of this worker, by name; the ones used last are kept.
_loaded: dict[str, object] = {}
MOST_LOADED = 8


def _name(provider: object) -> str:
    return _names.setdefault(id(provider), (provider, uuid.uuid4().hex))[1]


def _model(name: str, factory: Callable):
    """The loaded model, or None where loading fails."""
    if name not in _loaded:
        try:
            model = factory()
        except Exception:
            log.exception("a provider failed to load; its results count as missing")
            return None
        while len(_loaded) >= MOST_LOADED:
            del _loaded[next(iter(_loaded))]
        _loaded[name] = model
    return _loaded[name]


def _run(name: str, factory: Callable, values: list, empty, convert: Callable = lambda v: v) -> list:
    """Converted results of the values that are not empty."""
    model = _model(name, factory)
    out = [empty] * len(values)
    at = [i for i, v in enumerate(values) if v]
    if model is None or not at:
        return out

    def take(part: list[int]) -> None:
        for i, v in zip(part, [convert(v) for v in model([values[i] for i in part])], strict=True):
            out[i] = v

    try:
        take(at)
    except Exception:
        log.exception("a provider failed; its items are tried one by one")
        for i in at:
            try:
                take([i])
            except Exception:
                out[i] = empty
    return out


def _full(texts: Iterable[str | None]) -> list[str | None]:
    return [t if t and t.strip() else None for t in texts]


def scores(text: Column, provider: ScoreProvider | None) -> Column:
    """A score for each text; 0 without a provider, for blank texts, and where it fails."""
    if provider is None:
        return F.lit(0.0)
    name = _name(provider)

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(_run(name, provider, _full(x.to_pylist()), 0.0, float), pa.float64())

    return F.coalesce(run(text), F.lit(0.0))


def similarity(provider: VectorProvider, seeds: Sequence[str]) -> ScoreProvider:
    """Scores of texts by their cosine with the centroid of the seeds' unit vectors."""

    def factory():
        encode = provider()
        units = [_unit(v) for v in encode(list(seeds))]
        centroid = _unit([sum(x) / len(units) for x in zip(*units, strict=True)])
        return lambda texts: [sum(a * b for a, b in zip(_unit(v), centroid, strict=True)) for v in encode(list(texts))]

    return factory


def _unit(vector: Sequence[float]) -> list[float]:
    norm = math.sqrt(sum(float(x) * float(x) for x in vector))
    return [float(x) / norm if norm else 0.0 for x in vector]


def array_scores(texts: Column, provider: ScoreProvider | None) -> Column:
    """A score for each text of an array; null without a provider."""
    if provider is None:
        return F.lit(None).cast("array<double>")
    name = _name(provider)

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        rows = x.to_pylist()
        found = iter(_run(name, provider, _full(t for r in rows for t in (r or [])), 0.0, float))
        return pa.array([None if r is None else [next(found) for _ in r] for r in rows], pa.list_(pa.float64()))

    return run(texts)


def vectors(text: Column, provider: VectorProvider | None) -> Column:
    """An embedding for each text, null without one."""
    if provider is None:
        return F.lit(None).cast("array<double>")
    name = _name(provider)

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(_run(name, provider, _full(x.to_pylist()), None, lambda v: [float(c) for c in v]), pa.list_(pa.float64()))

    return run(text)


def _spans(text: str, found: Sequence[tuple[str, int, int, float]]) -> list[dict]:
    return [{"entity": str(e), "start": int(a), "end": int(b), "score": float(s), "value": text[int(a) : int(b)]} for e, a, b, s in found]


_SPAN = pa.list_(pa.struct([("entity", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("value", pa.string())]))
_SPAN_DDL = "array<struct<entity:string,start:int,end:int,score:double,value:string>>"


def entity_spans(text: Column, provider: EntityProvider | None) -> Column:
    """Spans of names and places of a text, of the shape that ``pii`` uses; null without a provider."""
    if provider is None:
        return F.lit(None).cast(_SPAN_DDL)
    name = _name(provider)

    @F.arrow_udf(_SPAN_DDL)
    def run(x: pa.Array) -> pa.Array:
        texts = _full(x.to_pylist())
        return pa.array([_spans(t or "", f) for t, f in zip(texts, _run(name, provider, texts, []), strict=True)], _SPAN)

    return run(text)


def array_entity_spans(texts: Column, provider: EntityProvider | None) -> Column:
    """Spans of each text of an array; null without a provider."""
    if provider is None:
        return F.lit(None).cast(f"array<{_SPAN_DDL}>")
    name = _name(provider)

    @F.arrow_udf(f"array<{_SPAN_DDL}>")
    def run(x: pa.Array) -> pa.Array:
        rows = x.to_pylist()
        flat = _full(t for r in rows for t in (r or []))
        found = iter([_spans(t or "", f) for t, f in zip(flat, _run(name, provider, flat, []), strict=True)])
        return pa.array([None if r is None else [next(found) for _ in r] for r in rows], pa.list_(_SPAN))

    return run(texts)


def pixels(image: bytes) -> int:
    """Width times height as the header of a PNG, GIF, BMP, JPEG or WebP says; 0 where that can't be read."""
    try:
        if image[:8] == b"\x89PNG\r\n\x1a\n":
            wide, high = struct.unpack(">II", image[16:24])
        elif image[:6] in (b"GIF87a", b"GIF89a"):
            wide, high = struct.unpack("<HH", image[6:10])
        elif image[:2] == b"BM":
            wide, high = (abs(x) for x in struct.unpack("<ii", image[18:26]))
        elif image[:4] == b"RIFF" and image[8:12] == b"WEBP":
            if image[12:16] == b"VP8X":
                wide, high = (int.from_bytes(image[a : a + 3], "little") + 1 for a in (24, 27))
            elif image[12:16] == b"VP8L":
                bits = int.from_bytes(image[21:25], "little")
                wide, high = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            else:
                wide, high = (x & 0x3FFF for x in struct.unpack("<HH", image[26:30]))
        elif image[:2] == b"\xff\xd8":
            at = 2
            while True:
                marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    high, wide = struct.unpack(">HH", image[at + 5 : at + 9])
                    break
                at += 2 + size
        else:
            return 0
        return wide * high
    except (struct.error, IndexError):
        return 0


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def http_fetch(url: str) -> bytes | None:
    """The body of a 200 answer of at most MOST_IMAGE_BYTES, without following redirects; None otherwise."""
    try:
        with urllib.request.build_opener(_NoRedirect).open(url, timeout=FETCH_SECONDS) as answer:
            body = answer.read(MOST_IMAGE_BYTES + 1) if answer.status == 200 else None
    except (OSError, ValueError, urllib.error.URLError):
        return None
    return body if body and len(body) <= MOST_IMAGE_BYTES else None


def fetch_image(url: str | None, fetcher: Fetcher, resolves: Callable[[str, int], bool] | None = None) -> bytes | None:
    """The image at a URL whose host resolves to public addresses only; None where that or the download fails."""
    try:
        parts = urlsplit(url or "")
        port = parts.port or (443 if parts.scheme == "https" else 80)
        if parts.scheme not in ("http", "https") or not parts.hostname or not (resolves or resolves_public)(parts.hostname, port):
            return None
        body = fetcher(url)
        return body if body and len(body) <= MOST_IMAGE_BYTES else None
    except Exception:
        log.exception("an image could not be fetched")
        return None


def ocr_texts(inline: Column, provider: OcrProvider | None, urls: Column | None = None, fetcher: Fetcher | None = None, resolves: Callable[[str, int], bool] | None = None, seconds: float = OCR_SECONDS) -> Column:
    """Texts of a message's images: ``inline`` their bytes (null: none), ``urls`` where others are; an array of nulls without a provider.

    Only with a ``fetcher`` is anything fetched. Images over the limits and those that fail give null. A message
    whose images take longer than ``seconds`` gives nulls for all of them.
    """
    if provider is None:
        return F.transform(inline, lambda _: F.lit(None).cast("string"))
    name = _name(provider)

    def texts(row: dict) -> list[str | None]:
        end, out = time.monotonic() + seconds, []
        for image, url in zip(row["inline"], row["urls"] or [None] * len(row["inline"]), strict=True):
            if image is None and url and fetcher is not None:
                image = fetch_image(url, fetcher, resolves)
            fits = image is not None and len(image) <= MOST_IMAGE_BYTES and pixels(image) <= MOST_IMAGE_PIXELS
            out += _run(name, provider, [image if fits else None], None)
            if time.monotonic() > end:
                log.warning("reading a message's images took too long")
                return [None] * len(row["inline"])
        return out

    @F.arrow_udf("array<string>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if r is None or r["inline"] is None else texts(r) for r in x.to_pylist()], pa.list_(pa.string()))

    places = urls if urls is not None else F.lit(None).cast("array<string>")
    return run(F.struct(inline.alias("inline"), places.alias("urls")))


def resolves_public(host: str, port: int = 443) -> bool:
    """Whether every address that a host resolves to is public; False where it doesn't resolve."""
    try:
        found = {ipaddress.ip_address(x[4][0]) for x in socket.getaddrinfo(host, port, proto=socket.IPPROTO_TCP)}
    except (OSError, ValueError):
        return False
    plain = [getattr(a, "ipv4_mapped", None) or a for a in found]
    return bool(plain) and all(a.is_global and not a.is_multicast for a in plain)
