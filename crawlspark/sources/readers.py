"""Sources (SRC2, SRC4, SRC5) and body decoding (TXT20)."""

from __future__ import annotations

import codecs
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import exploded, let

PAGES = "page_id long, url string, html string"
ATTEMPTS = ("attempt_id long, request_id long, ts timestamp_ntz, url string, host string, lane string, "
            "success boolean, status_code int, elapsed_s double")
LATIN1 = r"(?:^|[;\s<>/])charset=['\"]*(iso-8859-1|latin-?1)['\"]*(?:$|[;\s<>/])"
FALLBACK_CHARSETS = ("utf-8", "gbk", "gb18030", "big5", "latin1")


def read_pages(spark: SparkSession, location: str, *columns: str, fmt: str = "parquet") -> DataFrame:
    """SRC2: page snapshot; name the columns wanted so that the scan reads nothing else."""
    reader = spark.read.schema(PAGES) if fmt == "json" else spark.read
    df = reader.format(fmt).load(location)
    return df.select(*columns) if columns else df


def read_bodies(spark: SparkSession, location: str, glob: str | None = None, packed: bool = False) -> DataFrame:
    """SRC4: raw bodies with path, length, modification time and content: one file each, or ``packed``.

    Packed files hold many small bodies, each a line of base64, as :func:`writers.write_bodies` makes them: a file for
    each would cost more than what it holds. Columns that are not used are not read: a listing of paths and lengths opens
    no file that is not packed. ``digest`` is made of the content, so that a read can be checked against what was written.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(location)
    if packed:
        # What stands behind the last line end is a line only if it is not empty; an empty line is an empty body.
        lines = let(F.split(F.col("content").cast("string"), "\n"), lambda ls: F.filter(
            ls, lambda line, i: (line != "") | (i < F.size(ls) - 1)))
        files = exploded(files, lines, "pos", "line", "path", "modificationTime").withColumn("content", F.unbase64("line")).withColumn(
            "length", F.octet_length("content").cast("long"))
    return files.select("path", "length", F.col("modificationTime").alias("modified"),
                        F.col("content").alias("body"), F.sha2("content", 256).alias("digest"))


def first_bytes(body: str = "body", n: int = 8):
    return F.hex(F.substring(F.col(body), 1, n))


def attempt_stream(spark: SparkSession, location: str, schema: str = ATTEMPTS, files_per_trigger: int | None = None) -> DataFrame:
    """SRC5: attempts as a stream; event time becomes a zoned timestamp, as watermarks require."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(location).withColumn("ts", F.col("ts").cast("timestamp"))


def text_codec(name: str | None):
    """The codec of this name if it is a text encoding (``hex`` or ``zip`` are codecs, but none of text)."""
    try:
        found = codecs.lookup((name or "").strip(" \t'\""))
    except (LookupError, ValueError):
        return None
    return found if found._is_text_encoding else None


def parameter(value: str, name: str) -> str | None:
    """Value of a parameter (``name=value``) of a header or tag, quotes taken off."""
    for part in re.split(r"[;\s<>/]+", value.lower()):
        key, eq, rest = part.partition("=")
        if eq and key == name:
            return rest.strip("'\"")
    return None


def named_charsets(body: bytes, content_type: str | None):
    """What the header says, then what a ``<meta>`` tag in the first 1024 bytes says."""
    yield parameter(content_type or "", "charset")
    for tag in re.findall("<meta\\b[^>]*>", body[:1024].decode("latin-1").lower()):
        inner = re.sub(r"content\s*=\s*[\"']", " ", re.sub(r"\s*=\s*", "=", tag))
        if found := parameter(inner, "charset"):
            yield found
            return


def decode_body(body: bytes, content_type: str | None) -> tuple[str, str]:
    """Chosen charset and text; each candidate is tried by decoding once. latin1, the last, takes any bytes."""
    for name in (*named_charsets(body, content_type), *FALLBACK_CHARSETS):
        if codec := text_codec(name):
            try:
                return name, codec.decode(body, "strict")[0]
            except UnicodeError:
                continue
    raise AssertionError("latin1 decodes any bytes")


def decode_bodies(df: DataFrame, body: str = "body", content_type: str = "content_type") -> DataFrame:
    """TXT20: adds ``charset`` and ``html`` to rows with a binary body.

    Bodies that are valid UTF-8 and that nothing says are in another charset, and those whose header names latin1, are
    decoded by Spark's own functions; only the others go through Python's codecs. Each body is decoded once; the two kinds
    are filters of the same input, which is read for each. A worker is handed a hundred bodies at a time, where an Arrow
    batch would hold ten thousand, of any size, several times over.
    """
    head = F.lower(F.decode(F.substring(body, 1, 1024), "ISO-8859-1"))
    plain = (F.is_valid_utf8(F.col(body).cast("string")) & F.coalesce(F.lower(F.col(content_type)).rlike(r"charset=[\"']?utf-?8\b"), F.lit(False))
             & F.col(body).isNotNull())
    unsaid = (F.is_valid_utf8(F.col(body).cast("string")) & ~F.coalesce(F.lower(F.col(content_type)).contains("charset"), F.lit(False))
              & ~head.contains("charset"))
    header = F.lower(F.coalesce(F.col(content_type), F.lit("")))
    latin1 = F.when(F.regexp_count(header, F.lit("charset")) == 1, F.regexp_extract(header, LATIN1, 1)).otherwise("")
    is_latin1 = (latin1 != "") & F.col(body).isNotNull()
    keep = [c for c in df.columns if c != body]
    in_spark = F.coalesce(plain | unsaid, F.lit(False)) | is_latin1
    native = df.filter(in_spark).select(
        *keep, F.when(is_latin1, latin1).otherwise("utf-8").alias("charset"),
        F.when(is_latin1, F.decode(body, "ISO-8859-1")).otherwise(F.col(body).cast("string")).alias("html"))
    decode = F.udf(lambda b, named: None if b is None else decode_body(bytes(b), named), "charset string, html string", useArrow=False)
    rest = df.filter(~in_spark).withColumn("_decoded", decode(body, content_type))
    return native.unionByName(rest.select(*keep, "_decoded.charset", "_decoded.html"))


# Python workers need not have this package installed: what they run is sent along by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
