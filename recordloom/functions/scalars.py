"""Scalar column functions: numbers, dates, hashes, sizes, MIME types, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for an unknown contact.
UNKNOWN_CONTACTS = ("", "(Unknown)", "null")
#: MIME types of binary contents and their file extensions.
MIME_EXTENSIONS = {
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif", "image/bmp": "bmp", "image/webp": "webp", "image/tiff": "tiff", "image/tif": "tif",
    "video/mp4": "mp4", "video/3gpp": "3gp", "video/quicktime": "mov", "video/avi": "avi", "video/mov": "mov", "video/wmv": "wmv", "video/flv": "flv",
    "audio/mpeg": "mp3", "audio/mp3": "mp3", "audio/mp4": "m4a", "audio/amr": "amr", "audio/wav": "wav", "audio/ogg": "ogg", "audio/aac": "aac", "audio/m4a": "m4a",
    "application/pdf": "pdf", "application/zip": "zip", "application/rar": "rar", "application/7z": "7z",
    "application/msword": "doc", "application/vnd.ms-excel": "xls", "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "application/octet-stream": "bin",
}
#: MIME types that stand for each file extension of several types.
EXTENSION_MIMES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "mp3": "audio/mpeg", "m4a": "audio/mp4", "mov": "video/quicktime", "tif": "image/tiff"}
#: Content types that stay inline.
INLINE_TYPES = (
    "text/plain", "text/html", "text/xml", "text/css", "text/javascript", "text/csv", "text/rtf", "text/x-vcard", "text/vcard",
    "application/xml", "application/json", "application/javascript", "application/smil", "application/xhtml+xml", "application/vnd.wap.multipart.related",
)


def as_text(c: Column | str) -> Column:
    """A column of a name or a column."""
    return F.col(c) if isinstance(c, str) else c


def normalize_phone(number: Column | str) -> Column:
    """Digits only; of eleven digits that begin with 1 the last ten."""
    digits = F.regexp_replace(as_text(number), "[^0-9]", "")
    return F.regexp_replace(digits, "^1([0-9]{10})$", "$1")


def null_text(c: Column | str) -> Column:
    """The text, null where it is empty or ``null``."""
    c = as_text(c)
    return F.when((c != "") & (c != "null"), c)


def strict_int(c: Column | str, kind: str = "int") -> Column:
    """The whole number, null unless the text is nothing but one (no blanks)."""
    c = as_text(c)
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c).try_cast(kind)


def flag(c: Column | str) -> Column:
    """1 for the text ``1``, else 0."""
    return F.coalesce((as_text(c) == "1").cast("int"), F.lit(0))


def epoch_ms(ts: Column | str) -> Column:
    """Whole milliseconds since the epoch of a timestamp with or without zone (session zone UTC)."""
    return F.floor(F.unix_micros(as_text(ts).cast("timestamp")) / 1000).cast("bigint")


def utc_year(ms: Column | str) -> Column:
    """The UTC year of epoch milliseconds."""
    return F.year(F.timestamp_millis(as_text(ms)))


def readable_date(ms: Column | str, zone: str = "America/New_York") -> Column:
    """``Jan 2, 2006 3:04:05 PM`` in the given zone."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(as_text(ms)), zone), "MMM d, yyyy h:mm:ss a")


def decode_base64(text: Column | str) -> Column:
    """The bytes of strictly padded base64 (line breaks allowed); null if it isn't."""
    bare = F.regexp_replace(as_text(text), "[\r\n]", "")
    good = (F.length(bare) % 4 == 0) & bare.rlike("^[A-Za-z0-9+/]*={0,2}$")
    return F.when(good, F.try_to_binary(bare, F.lit("base64")))


def normalize_mime(ct: Column | str) -> Column:
    """The type without parameters, trimmed, in lower case."""
    return F.lower(F.trim(F.element_at(F.split(as_text(ct), ";"), 1)))


def mime_extension(ct: Column | str) -> Column:
    """The file extension of a MIME type, ``bin`` for others."""
    pairs = F.create_map(*[F.lit(x) for kv in MIME_EXTENSIONS.items() for x in kv])
    return F.coalesce(pairs[normalize_mime(ct)], F.lit("bin"))


def extension_mime(name: Column | str) -> Column:
    """The MIME type of a file name, ``application/octet-stream`` for others."""
    ext = F.lower(F.regexp_extract(as_text(name), r"\.([A-Za-z0-9]+)$", 1))
    pairs = F.create_map(*[F.lit(x) for k, v in {**{v: k for k, v in MIME_EXTENSIONS.items()}, **EXTENSION_MIMES}.items() for x in (k, v)])
    return F.coalesce(pairs[ext], F.lit("application/octet-stream"))


def safe_filename(name: Column | str) -> Column:
    """Separators, colons, double dots and NUL replaced by underscores."""
    return F.regexp_replace(F.regexp_replace(as_text(name), r"\.\.", "_"), r"[/\\:\x00]", "_")


def sniff_type(content: Column | str) -> Column:
    """The type that the first bytes show (png, jpeg, gif, mp4, pdf, zip), null for others."""
    c = as_text(content)
    head = lambda n, at=1: F.hex(F.substring(c, at, n))
    return (
        F.when(head(8) == "89504E470D0A1A0A", "image/png").when(head(3) == "FFD8FF", "image/jpeg").when(head(4) == "47494638", "image/gif")
        .when(head(4, 5) == "66747970", "video/mp4").when(head(4) == "25504446", "application/pdf").when(head(4) == "504B0304", "application/zip")
    )


def hash_of_path(path: Column | str) -> Column:
    """The content hash in an attachment path, null if it has none."""
    found = F.regexp_extract(as_text(path), r"^attachments/[^/]*/([0-9a-f]{64})(?:/|$)", 1)
    return F.when(found != "", found)


def path_of_hash(digest: Column | str) -> Column:
    """The folder of a content hash."""
    h = as_text(digest)
    return F.concat(F.lit("attachments/"), F.substring(h, 1, 2), F.lit("/"), h)


def is_hash(c: Column | str) -> Column:
    """Is the text 64 lower-case hexadecimal digits?"""
    return F.coalesce(as_text(c).rlike("^[0-9a-f]{64}$"), F.lit(False))


def parse_size(c: Column | str) -> Column:
    """Bytes of a size such as ``500MB``, ``1.5 KB`` or ``12``; null if it is none."""
    c = F.upper(F.trim(as_text(c)))
    number = F.regexp_extract(c, r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)I?B?$", 1)
    unit = F.regexp_extract(c, r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)I?B?$", 2)
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).when(unit == "T", 1 << 40).otherwise(1)
    return F.when(number != "", (number.cast("double") * factor).cast("bigint"))


def format_size(c: Column | str) -> Column:
    """Bytes with one decimal and a unit of 1,024 steps."""
    c = as_text(c)
    out = F.concat(c.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(c >= 1024**power, F.concat(F.format_string("%.1f", c / float(1024**power)), F.lit(f" {unit}"))).otherwise(out)
    return out


def thousands(c: Column | str) -> Column:
    """A whole number with commas."""
    return F.format_number(as_text(c), 0)


def slug(c: Column | str) -> Column:
    """The anchor of a heading: lower case, signs dropped, blanks as hyphens."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(as_text(c)), r"[^a-z0-9 _-]", ""), r"[ ]+", "-"), F.lit("-"))


def is_phone_text(c: Column | str) -> Column:
    """May the text be a phone number by its characters?"""
    return F.coalesce(as_text(c).rlike(r"^\+?[0-9\s().-]+$"), F.lit(False))


def is_unknown(name: Column | str) -> Column:
    """Does a contact name, as written, stand for nobody?"""
    return F.coalesce(as_text(name).isin(*UNKNOWN_CONTACTS), F.lit(True))


def event_id(*parts: Column) -> Column:
    """The first eight bytes of the hash of the parts, as hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
