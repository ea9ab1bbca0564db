"""Container probes on opening bytes. Bytes come as upper-case hexadecimal digits; byte k is digits 2k+1 and 2k+2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

PROBE_BYTES = 512
STILL_BYTES = 32

# Opening bytes of generic raw containers, by place.
RAW_MAGICS = ["FUJIFILMCCD-RAW", "\x00MRM", "IIU\x00", "IIRO", "IIRS", "FOVb"]
RAW_BRANDS = ["ftypcrx", "ftypcr3"]
DNG_VERSION_TAG = 50706
# Brands of still containers.
AVIF_BRANDS = ["avif", "avis"]
HEIC_BRANDS = ["heic", "heix", "mif1", "msf1"]

# File extensions that are decoded as raw.
RAW_EXTENSIONS = "3fr arw cr2 cr3 crw dcr erf fff iiq kdc mef mos mrw nef nrw orf pef raf raw rw2 rwl sr2 srf srw x3f".split()


def hexed(text: str) -> str:
    return text.encode("latin-1").hex().upper()


def at(hex_: Column, byte: Column | int, n: int) -> Column:
    """n bytes from a place, as digits."""
    start = byte * 2 + 1 if isinstance(byte, int) else (byte * 2 + 1).cast("int")
    return F.substring(hex_, start, 2 * n) if isinstance(start, int) else F.substring(hex_, start, F.lit(2 * n))


def number(digits: Column, little: Column, n: int) -> Column:
    """An unsigned number of n bytes in either byte order; 0 where bytes are missing."""
    turned = F.concat(*[F.substring(digits, 2 * (n - 1 - k) + 1, 2) for k in range(n)])
    whole = F.length(digits) == 2 * n
    return F.when(whole, F.conv(F.when(little, turned).otherwise(digits), 16, 10).cast("long")).otherwise(0)


def has_tag(hex_: Column, tag: int) -> Column:
    """Whether the first TIFF directory has the tag inside the bytes given; false for bytes that are no TIFF header."""
    little = at(hex_, 0, 2) == "4949"
    size = F.length(hex_) / 2
    start = number(at(hex_, 4, 4), little, 4)
    entries = F.when(start + 2 <= size, number(at(hex_, F.least(start, F.lit(PROBE_BYTES)), 2), little, 2)).otherwise(0)
    places = F.filter(F.transform(F.sequence(F.lit(0), F.least(entries, F.lit(PROBE_BYTES // 12)) - F.when(entries > 0, 1).otherwise(0)), lambda k: start + 2 + 12 * k), lambda p: p + 12 <= size)
    tiff = (little | (at(hex_, 0, 2) == "4D4D")) & (number(at(hex_, 2, 2), little, 2) == 42)
    return F.coalesce(tiff & (entries > 0) & F.exists(places, lambda p: number(at(hex_, p, 2), little, 2) == tag), F.lit(False))


def raw_route(hex_: Column) -> Column:
    """dng, generic or error, by the opening bytes."""
    head = F.substring(hex_, 1, 2 * PROBE_BYTES)
    generic = F.lit(False)
    for m in RAW_MAGICS:
        generic = generic | head.startswith(hexed(m))
    for m in RAW_BRANDS:
        generic = generic | (at(head, 4, len(m)) == hexed(m))
    little, big = at(head, 0, 2) == hexed("II"), at(head, 0, 2) == hexed("MM")
    tiff = (little | big) & (number(at(head, 2, 2), little, 2) == 42)
    return F.when(F.length(head) < 16, "error").when(generic, "generic").when(~tiff, "error").when(has_tag(head, DNG_VERSION_TAG), "dng").otherwise("generic")


def still_format(hex_: Column) -> Column:
    """jpeg, webp, jxl, avif, heic or unknown, from the first 32 bytes; unknown for fewer than 12.

    Of a container the major brand decides, else the first compatible brand that is known, else it counts as heic.
    """
    n = (F.length(hex_) / 2).cast("int")
    brand = at(hex_, 8, 4)
    box = F.conv(at(hex_, 0, 4), 16, 10).cast("long")
    limit = F.least(n.cast("long"), F.lit(STILL_BYTES), box)
    known = [hexed(x) for x in AVIF_BRANDS + HEIC_BRANDS]
    brands = F.array(brand, *[F.when(F.lit(k + 4) <= limit, at(hex_, k, 4)) for k in range(16, STILL_BYTES, 4)])
    first = F.get(F.filter(brands, lambda b: F.coalesce(b.isin(known), F.lit(False))), 0)
    ftyp = F.when(first.isin([hexed(x) for x in AVIF_BRANDS]), "avif").otherwise("heic")
    return (
        F.when(n < 12, "unknown")
        .when(hex_.startswith("FFD8FF"), "jpeg")
        .when((at(hex_, 0, 4) == hexed("RIFF")) & (brand == hexed("WEBP")), "webp")
        .when(hex_.startswith("FF0A") | hex_.startswith("0000000C4A584C200D0A870A"), "jxl")
        .when(at(hex_, 4, 4) == hexed("ftyp"), ftyp)
        .otherwise("unknown")
    )


def extension(path: Column) -> Column:
    """Lower-cased extension of the last path segment, empty without a dot or behind a last dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def route_of_path(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext == "dng", "dng").when(ext.isin(RAW_EXTENSIONS), "raw").otherwise("unsupported")


def probe_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, route, still of all files below a folder, of each of which only the first 512 bytes are read."""
    files.register(spark)
    heads = spark.read.format("file_heads").option("bytes", PROBE_BYTES).load(path).select("path", "length", F.hex("head").alias("head"))
    return heads.select("path", "length", raw_route(F.col("head")).alias("route"), still_format(F.col("head")).alias("still"))


def key_values(line: Column) -> Column:
    """The key=value tokens of a line as a map; of a repeated key the last counts, tokens without = are left out."""
    pairs = F.filter(F.split(line, " +"), lambda t: t.contains("="))
    key = lambda t: F.substring_index(t, "=", 1)
    last = lambda k: F.element_at(F.filter(pairs, lambda t: key(t) == k), -1)
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, key)), lambda k: F.struct(k, F.regexp_replace(last(k), "^[^=]*=", ""))))


def dims_from_name(name: Column) -> tuple[Column, Column, Column]:
    """(width, height, planes) of a name that holds WxH_Pp, null otherwise."""
    part = lambda k: F.regexp_extract(name, r"([0-9]+)x([0-9]+)_([0-9]+)p", k)
    return tuple(F.when(part(k) != "", part(k).cast("long")) for k in (1, 2, 3))
