"""Bytes of fetched files as texts: packed ones unpacked, then the first character set that fits."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import mapped

#: Where character sets are named, how far into a page, and those tried after the named ones.
NAMED = r"""(?i)charset\s*=\s*["']?\s*([a-zA-Z0-9._-]+)"""
NAMED_INSIDE = (rb"""(?i)<meta[^>]+charset=["']?\s*([a-zA-Z0-9._-]+)""", rb"""(?i)<\?xml[^>]+encoding=["']\s*([a-zA-Z0-9._-]+)""")
LOOKED_AT = 4096
TRIED = ("utf-8", "utf-8-sig", "cp932", "shift_jis", "euc_jp", "latin-1")


def charsets(content: bytes, content_type: str) -> list[str]:
    """Names to try, in order: the header's, the page's own, the usual ones."""
    named = re.findall(NAMED, content_type)[:1]
    inside = (re.search(pattern, content[:LOOKED_AT]) for pattern in NAMED_INSIDE)
    return list(dict.fromkeys([*[n.lower() for n in named], *[m[1].decode("ascii", "ignore").lower() for m in inside if m], *TRIED]))


def decode(content: bytes | None, content_type: str | None) -> str:
    """The text in the first character set that fits without errors; null is empty."""
    for name in charsets(content or b"", content_type or ""):
        try:
            return (content or b"").decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("utf-8", "replace")


def unpack(url: str | None, content: bytes | None) -> bytes | None:
    """The content of a gzip file, told by its name or first bytes; as it is where it cannot be unpacked."""
    if content is None or not ((url or "").endswith(".gz") or content[:2] == b"\x1f\x8b"):
        return content
    out, rest = [], content
    try:
        while rest:  # members one after the other
            reader = zlib.decompressobj(wbits=31)
            out.append(reader.decompress(rest))
            if not reader.eof:
                return content
            rest = reader.unused_data.lstrip(b"\0")
        return b"".join(out)
    except zlib.error:
        return content


@F.arrow_udf(T.StringType())
def _decoded(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    return mapped(decode, pa.string(), rows)


@F.arrow_udf(T.StringType())
def _unpacked(rows: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    return mapped(lambda url, content, kind: decode(unpack(url, content), kind), pa.string(), rows)


def decoded(content: Column | str, content_type: Column | str) -> Column:
    """The text of a page's bytes."""
    return _decoded(content, content_type)


def unpacked(url: Column | str, content: Column | str, content_type: Column | str) -> Column:
    """The text of a file's bytes, which may be packed."""
    return _unpacked(url, content, content_type)
