"""Text functions of the service: durations, sidecars, cursors, labels, secrets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest page, rows that an unpaged answer or a prefix scan may have.
PAGE_MOST = 10_000
ROWS_MOST = 500_000
U32_MOST = 4_294_967_295


class BadArgument(ValueError):
    """A request that can't be answered as it stands (HTTP 400)."""


class TooLarge(ValueError):
    """An unpaged answer over the ceiling (HTTP 413)."""


def http_code(error: Exception) -> int:
    return 413 if isinstance(error, TooLarge) else 400 if isinstance(error, BadArgument) else 500


def clock_text(ms: Column) -> Column:
    """`Dd HHhMMmSS.ds` of milliseconds."""
    s = F.floor(ms / 1000)
    return F.format_string("%dd %02dh%02dm%02d.%ds", F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60, F.floor(ms / 100) % 10)


def short_clock_text(ms: Column) -> Column:
    """As clock_text without the parts that are zero; `0s` of none."""
    s = F.floor(ms / 1000)
    parts = [(F.floor(s / 86400), "d"), (F.floor(s / 3600) % 24, "h"), (F.floor(s / 60) % 60, "m"), (s % 60, "s")]
    text = F.concat_ws(" ", *[F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in parts])
    return F.when(text == "", "0s").otherwise(text)


def checksum_of(sidecar: Column) -> Column:
    """The first 64 hex signs of a checksum file in lower case, null without."""
    found = F.lower(F.regexp_extract(sidecar, r"\b[0-9a-fA-F]{64}\b", 0))
    return F.when(found != "", found)


def signature_of(sidecar: Column) -> Column:
    """64 bytes of `v1 ed25519 <base64>`, null if it is anything else."""
    part = F.split(F.regexp_replace(sidecar, r"^\s+|\s+$", ""), r"\s+")
    raw = F.try_to_binary(F.get(part, F.lit(2)), F.lit("base64"))
    return F.when((F.size(part) == 3) & (F.get(part, F.lit(0)) == "v1") & (F.get(part, F.lit(1)) == "ed25519") & (F.length(raw) == 64), raw)


def gzip_comment(head: Column) -> Column:
    """The first printable JSON object in a file's head, parsed for its original size."""
    found = F.regexp_extract(F.decode(F.substring(head, 1, 66560), "ISO-8859-1"), r"\{[\x20-\x7e]*?\}", 0)
    return F.from_json(F.when(found != "", found), "original_size long")


def safe_name(name: str) -> str:
    """A file name without a path."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name) or ".." in name:
        raise BadArgument(f"not a plain file name: {name!r}")
    return name


def page_options(limit: str | int | None, after: str | None) -> tuple[int | None, tuple[str, int] | None]:
    """(limit, cursor): a positive whole number of at most PAGE_MOST; 16 hex signs, a colon and a 32-bit number."""
    if limit is not None:
        if not re.fullmatch(r"[0-9]+", str(limit)) or int(limit) < 1:
            raise BadArgument("limit must be a positive integer")
        limit = min(int(limit), PAGE_MOST)
    return limit, None if after is None else cursor(after)


def cursor(text: str) -> tuple[str, int]:
    found = re.fullmatch(r"([0-9a-fA-F]{16}):([0-9]{1,10})", text)
    if not found or int(found[2]) > U32_MOST:
        raise BadArgument("cursor must be <16 hex>:<32-bit number>")
    return found[1].lower(), int(found[2])


def cursor_ok(text: Column) -> Column:
    """cursor() as a predicate on a column."""
    number = F.regexp_extract(text, "^[0-9a-fA-F]{16}:([0-9]{1,10})$", 1)
    return (number != "") & (F.when(number != "", number).cast("long") <= U32_MOST)


def key_pattern(pattern: str) -> str:
    """A hex prefix of at least 32 signs."""
    if not re.fullmatch(r"[0-9a-fA-F]{32,}", pattern):
        raise BadArgument("a pattern has at least 32 hex signs")
    return pattern.lower()


def key_label(key: Column) -> Column:
    """First byte of a key as a sign if printable, else as hex."""
    first = F.substring(key, 1, 1)
    code = F.conv(F.hex(first), 16, 10).cast("int")
    return F.when(code.between(33, 126), F.chr(code)).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(first))))


def hex_short(x: Column, most: int = 48) -> Column:
    """Hex of at most `most` bytes and how many follow."""
    rest = F.octet_length(x) - most
    return F.concat(F.lower(F.hex(F.substring(x, 1, most))), F.when(rest > 0, F.concat(F.lit("...+"), rest.cast("string"))).otherwise(""))


def chunk_name(chain: Column, net: Column, start: Column, end: Column) -> Column:
    return F.format_string("blocks-%s-%s-%08d-%08d.xdmp", chain, net, start, end)


def record_hash(*columns: Column) -> Column:
    """SHA-256 of a record's JSON text."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def origins(raw: Column) -> Column:
    """Allowed origins of a comma list; null (none allowed) without any."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def scrub(message: Column) -> Column:
    """A log line with credentials masked."""
    out = F.regexp_replace(message, r"(?i)(password|passwd|token|secret|api[_-]?key|authorization)(\"?\s*[:=]\s*\"?)[^\s\",}]+", "$1$2[redacted]")
    return F.regexp_replace(out, r"(://)[^/\s:@]+:[^/\s@]+@", "$1[redacted]@")


def metric_name_ok(name: Column) -> Column:
    return name.rlike("^[a-zA-Z_:][a-zA-Z0-9_:]*$")


def label_text(value: Column) -> Column:
    """A label's value as the exposition format wants it."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def number_text(value: Column) -> Column:
    return F.when(F.isnan(value), "NaN").when(value == float("inf"), "+Inf").when(value == -float("inf"), "-Inf").otherwise(F.regexp_replace(value.cast("string"), r"\.0$", ""))


def route_label(path: Column) -> Column:
    """A request's route without its arguments."""
    name = F.regexp_extract(path, r"^/(utxos|firstseen|balance|info|status|metrics)(?:/|$|\?)", 1)
    return F.when(name != "", F.concat(F.lit("/"), name)).when(path == "/", "rpc").otherwise("other")
