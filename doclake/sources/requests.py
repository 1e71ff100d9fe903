"""Request tables: envelopes, base64 content, strict UTF-8 (s2, s7, s8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions import text as tx
from doclake.functions.frames import let

REQUEST_FIELDS = (
    "req_id bigint, file_name string, file_content string, s3_path string, bucket_name string, output_format string, "
    "ai_optimized boolean, include_metadata boolean, extract_key_sections boolean, max_chunk_size int, region string, "
    "processing_images boolean"
)
ENVELOPE = f"body string, {REQUEST_FIELDS}"


def scan_requests(events: DataFrame) -> DataFrame:
    """s7: requests from JSON event rows (column ``value``).

    ``body`` may be a JSON string, an object or absent; read as a string, the first two are the same JSON text.
    """
    parsed = events.select(F.from_json("value", ENVELOPE).alias("e"))
    names = [f.split()[0] for f in REQUEST_FIELDS.split(", ")]
    inner = F.from_json("e.body", REQUEST_FIELDS)
    direct = F.struct(*[F.col(f"e.{n}").alias(n) for n in names])
    request = F.when(F.col("e.body").isNotNull(), inner).otherwise(direct)
    return parsed.select(request.alias("r")).select("r.*")


#: One by one, not as ranges: a regular expression looks single characters up in a table.
_DIGITS64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def decoded(content: Column) -> Column:
    """s8: base64 → bytes, null when invalid. Characters outside the alphabet are ignored, what follows complete padding
    too, and missing padding is an error (Spark alone would accept it)."""
    def padded(clean: Column) -> Column:
        data = F.substring_index(clean, "=", 1)
        rest = F.substr(clean, F.octet_length(data) + 1)
        left = F.octet_length(data) % 4
        return (
            F.when((left == 0) & (F.replace(rest, F.lit("="), F.lit("")) == ""), data)
            .when((left == 2) & F.startswith(rest, F.lit("==")), F.concat(data, F.lit("==")))
            .when((left == 3) & F.startswith(rest, F.lit("=")), F.concat(data, F.lit("=")))
        )

    def made(joined: Column) -> Column:
        other = F.try_to_binary(let(F.regexp_replace(joined, f"[^{_DIGITS64}=]", ""), padded), F.lit("base64"))
        whole = F.when(F.octet_length(joined) % 4 == 0, F.unbase64(joined)).otherwise(other)
        return F.when(joined.rlike(rf"\A[{_DIGITS64}]*+={{0,2}}+\z"), whole).otherwise(other)

    # lines of base64 are its usual form
    return let(F.replace(F.replace(content, F.lit("\r\n"), F.lit("")), F.lit("\n"), F.lit("")), made)


def decode_base64(requests: DataFrame) -> DataFrame:
    """requests + ``bytes`` and the reason why there are none."""
    with_bytes = requests.withColumn("bytes", decoded(F.col("file_content")))
    return with_bytes.withColumn(
        "decode_reason",
        F.when(F.col("bytes").isNull(), "bad_base64").when(F.octet_length("bytes") == 0, "empty_content"),
    )


def utf8_text(content: Column) -> Column:
    """s2: bytes → text with ``\\n`` line ends, null when the bytes are not UTF-8."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), tx.normalise_newlines(as_text))


def decode_text(files: DataFrame) -> DataFrame:
    """files(…, content) → docs(…, text, reason)."""
    text = files.withColumn("text", utf8_text(F.col("content"))).drop("content")
    return text.withColumn("reason", F.when(F.col("text").isNull(), "invalid_utf8"))
