"""Deterministic ids: SHA-256 over normalized identity parts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, functions as F

# White space as identities understand it, and the separator of parts.
SPACE = r"(?U)[\s\x1c-\x1f]+"
SEPARATOR = "\x1f"


_clean = ContextVar("clean parts", default=False)


@contextmanager
def clean_parts(known: bool = True) -> Iterator[None]:
    """Ids whose columns are made within it have parts that, if known, hold no white space but single blanks between other
    characters (clean() says so of the texts that they are made of): these are lower-cased alone, which gives the same ids."""
    token = _clean.set(known)
    try:
        yield
    finally:
        _clean.reset(token)


def clean(text: Column) -> Column:
    """Whether a text is not empty and normal() but for its case, and so are texts made of it and others by visible characters; true for null."""
    return F.coalesce((text != "") & (F.trim(F.regexp_replace(text, SPACE, " ")) == text), F.lit(True))


def normal(part: Column | str) -> Column:
    """Trimmed, lower-cased, white space runs as one blank; null as empty."""
    c = F.coalesce((F.lit(part) if isinstance(part, str) else part).cast("string"), F.lit(""))
    return F.lower(c) if _clean.get() else F.trim(F.regexp_replace(F.lower(c), SPACE, " "))


def stable_id(kind: str, *parts: Column | str) -> Column:
    """`kind:` and 16 hex digits; a str part is a literal."""
    raw = F.concat_ws(SEPARATOR, F.lit(kind), *[normal(p) for p in parts])
    return F.concat(F.lit(kind + ":"), F.substring(F.sha2(raw, 256), 1, 16))


def code(id: Column) -> Column:
    """A text as bytes: 16 hexadecimal digits at its end, as stable ids have them, as the 8 bytes that they stand for.  Texts that
    differ have different codes."""
    digits = F.substring(id, -16, 16)
    bytes_ = F.unhex(digits)
    head = F.substring(id, F.lit(1), F.length(id) - 16).cast("binary")
    stable = (F.length(id) >= 16) & (F.octet_length(bytes_) == 8) & (F.lower(digits) == digits)  # unhex() gives null for other characters
    # bytes that differ come first, as sorts look at these
    return F.when(stable, F.concat(bytes_, head, F.unhex(F.lit("01")))).otherwise(F.concat(id.cast("binary"), F.unhex(F.lit("00"))))


def decoded(code: Column) -> Column:
    """The text of a code()."""
    n = F.octet_length(code)
    short = F.concat(F.decode(F.substring(code, F.lit(9), n - 9), "UTF-8"), F.lower(F.hex(F.substring(code, 1, 8))))
    return F.when(F.substring(code, -1, 1) == F.unhex(F.lit("01")), short).otherwise(F.decode(F.substring(code, F.lit(1), n - 1), "UTF-8"))
