"""Small codecs and dimension tables: diagram URLs, media types, layouts, spans, contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as fx

#: Media types by file ending.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "emf": "image/x-emf", "wmf": "image/x-wmf", "tiff": "image/tiff", "tif": "image/tiff", "bmp": "image/bmp"}


def media_type(extension: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MEDIA.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(extension)), F.lit("application/octet-stream"))


def file_media_type(path: Column) -> Column:
    return media_type(fx.extension(path))


def encode_source(source: Column) -> Column:
    """Raw deflate and URL-safe base64 without padding, as diagram services take it."""

    @F.pandas_udf("string")
    def pack(texts):
        import base64
        import zlib

        def one(t):
            if t is None:
                return None
            z = zlib.compressobj(6, zlib.DEFLATED, -15)
            return base64.urlsafe_b64encode(z.compress(t.encode()) + z.flush()).rstrip(b"=").decode()

        return texts.map(one)

    return pack(source)


def decode_source(code: Column) -> Column:
    @F.pandas_udf("string")
    def unpack(texts):
        import base64
        import zlib

        return texts.map(lambda t: None if t is None else zlib.decompress(base64.urlsafe_b64decode(t + "=" * (-len(t) % 4)), -15).decode())

    return unpack(code)


def diagram_url(base: str, kind: Column, fmt: Column, source: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), kind, F.lit("/"), fmt, F.lit("/"), encode_source(source))


def contains(start: Column, end: Column, at: Column) -> Column:
    """Whether a half-open span holds a place."""
    return (at >= start) & (at < end)


def merged_span(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return F.least(a[0], b[0]), F.greatest(a[1], b[1])


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def contains_ci(text: Column, part: Column) -> Column:
    return F.lower(text).contains(F.lower(part))


def has_passive_pattern(text: Column) -> Column:
    from docloom.operators.plugins import PASSIVE

    return F.lower(text).rlike("|".join(PASSIVE))


def placeholder(placeholders: Column, *kinds: str) -> Column:
    """The index of the first placeholder of one of the kinds, null without one."""
    return F.get(F.filter(placeholders, lambda p: p["type"].isin(*kinds)), F.lit(0))["idx"]
