"""Scalar rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Storage classes by id; 1 is the default class. Fixed values of the listing dialects.
CLASS_A = {"STANDARD": 1, "NEARLINE": 2, "COLDLINE": 3, "ARCHIVE": 4}
CLASS_B = {
    "STANDARD": 1,
    "REDUCED_REDUNDANCY": 1,
    "INTELLIGENT_TIERING": 1,
    "OUTPOSTS": 1,
    "STANDARD_IA": 2,
    "ONEZONE_IA": 2,
    "GLACIER_IR": 3,
    "GLACIER_INSTANT_RETRIEVAL": 3,
    "GLACIER": 4,
    "DEEP_ARCHIVE": 4,
}
#: Operations by the actions that hour files name. Fixed values.
ACTIONS = {
    "GetObject": "GET",
    "HeadObject": "HEAD",
    "HeadBucket": "HEAD",
    "ListObjects": "LIST",
    "ListObjectsV2": "LIST",
    "ListMultipartUploads": "LIST",
    "ListParts": "LIST",
    "PutObject": "PUT",
    "CopyObject": "PUT",
    "CreateMultipartUpload": "PUT",
    "UploadPart": "PUT",
    "UploadPartCopy": "PUT",
    "CompleteMultipartUpload": "PUT",
    "DeleteObject": "DELETE",
    "DeleteObjects": "DELETE",
}
#: End of an open version.
OPEN = 4291747200


def mapped(value: Column, table: dict[str, int], default: int = 0) -> Column:
    """The table's number for the exact name."""
    of = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(of[value], F.lit(default)).cast("int")


def action_op(action: Column) -> Column:
    """The operation of an hour file's action; OTHER for names that aren't in the table."""
    of = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return F.coalesce(of[action], F.lit("OTHER"))


def usage_op(operation: Column, method: Column) -> Column:
    """The operation of a usage row: by its spelling in either API, whatever its case, else by the HTTP method.

    Listings come first, since a listing may be a GET of the bucket.
    """
    x = F.upper(F.coalesce(operation, F.lit("")))
    is_listing = x.contains("LIST") | (x == "GET_BUCKET")
    spelt = {
        "GET": r"^GET|^STORAGE\..*\.GET$",
        "PUT": r"^PUT|^POST_OBJECT$|^POST_UPLOADS$|^STORAGE\..*\.(INSERT|PATCH|UPDATE)$",
        "HEAD": r"^HEAD",
        "DELETE": r"^DELETE|^STORAGE\..*\.DELETE$",
    }
    out = F.when(is_listing, "LIST")
    for op, pattern in spelt.items():
        out = out.when(x.rlike(pattern) | F.coalesce(method == op, F.lit(False)), op)
    return out.otherwise("OTHER")


#: The bucket's own lifecycle engine, by its user agent; and raw operations that are priced as deletes and as listings. Fixed values.
LIFECYCLE = "GCS Lifecycle Management"
FREE_OPERATIONS = ("DELETE_Object", "storage.objects.delete", "POST_Nested_Delete_Multi_Objects")
LISTING_OPERATIONS = ("GET_Bucket", "storage.objects.list")


def price_class(op: Column, raw: Column | None = None, user_agent: Column | None = None, prefix: Column | None = None) -> Column:
    """free: deletes and the lifecycle engine; A: listings, reads of the bucket itself and all that isn't known; B: reads."""
    none = F.lit(None).cast("string")
    raw, agent, prefix = (none if c is None else c for c in (raw, user_agent, prefix))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    free = is_(agent == LIFECYCLE) | is_(op == "DELETE") | is_(raw.isin(*FREE_OPERATIONS))
    listing = is_(op == "LIST") | is_(raw.isin(*LISTING_OPERATIONS)) | (is_(op == "GET") & is_(prefix == ""))
    return F.when(free, "free").when(listing, "A").when(is_(op.isin("GET", "HEAD")), "B").otherwise("A")


def log2_bin(size: Column) -> Column:
    """0 for sizes of 0 or less, else the number of binary digits; exact for all 63 bits."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("int")


def size_rank(size: Column) -> Column:
    """Floor of log2; null for sizes of 0 or less."""
    return F.when(size > 0, F.length(F.bin(size)) - 1).cast("int")


def read_bin(size: Column) -> Column:
    """50 bins to each doubling; -9999 for empty reads."""
    return F.when(size > 0, F.round(F.log2(size.cast("double")) * 50).cast("int")).otherwise(F.lit(-9999))


def trigrams(text: Column) -> Column:
    """Distinct packed trigrams of an ASCII text in lower case; an empty array for others and for texts under 3 characters."""
    x = F.lower(text)
    at = F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1)))
    code = lambda i, k: F.ascii(F.substring(x, i + k, F.lit(1)))
    packed = F.transform(at, lambda i: code(i, 0) * 65536 + code(i, 1) * 256 + code(i, 2))
    return F.when((F.length(x) >= 3) & (F.length(x) == F.octet_length(x)), F.array_distinct(packed)).otherwise(F.array().cast("array<int>"))


def ngrams(text: Column, sizes: tuple[int, ...] = (1, 2)) -> Column:
    """Distinct substrings of the given lengths."""

    def of(k: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1)))
        return F.when(F.length(text) >= k, F.transform(at, lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, sizes)))


def suffixes(text: Column, least: int = 3) -> Column:
    """Every suffix of `least` characters or more."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (least - 1), F.lit(1)))
    return F.when(F.length(text) >= least, F.transform(at, lambda i: F.substring(text, i, F.length(text)))).otherwise(F.array().cast("array<string>"))


HEX = "0123456789abcdef"


def hex_dropped(text: Column, at: Column, size: Column, least: int = 16, tail: int = 8) -> Column:
    """Whether an occurrence of `size` characters at position `at` (from 1) of a text in lower case is left out of an index
    that skips the insides of runs of `least` hex digits: it begins after a run's first digit, and before its last `tail`
    digits or without reaching past its end."""
    ahead, own = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.length(text))
    before = F.length(ahead) - F.length(F.rtrim(ahead, F.lit(HEX)))
    after = F.length(own) - F.length(F.ltrim(own, F.lit(HEX)))
    return (before >= 1) & (after >= 1) & (before + after >= least) & ((after > tail) | (size <= after))


def scan_time(scan_id: Column) -> Column:
    """Epoch seconds of 'YYYY-MM-DD' or 'YYYY-MM-DDTHHMM'."""
    return F.unix_seconds(F.coalesce(F.try_to_timestamp(scan_id, F.lit("yyyy-MM-dd'T'HHmm")), F.try_to_timestamp(scan_id, F.lit("yyyy-MM-dd"))))


def username(name: Column) -> Column:
    """Lower case, without a mail domain; what isn't a letter, digit, dash or underscore becomes one dash, none at the ends.

    A name of which nothing is left is refused.
    """
    local = F.substring_index(F.regexp_replace(name, r"^\s+|\s+$", ""), "@", 1)
    out = F.btrim(F.regexp_replace(F.lower(local), "[^a-z0-9_-]+", "-"), F.lit("-"))
    return F.when(out == "", F.raise_error(F.concat(F.lit("no usable username in "), name))).otherwise(out)


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
