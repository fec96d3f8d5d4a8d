"""Scanning, fingerprinting, admission and routing of raw documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lorespark.functions import rules, text as tx


def reasons(*checks: tuple[Column, str]) -> Column:
    """Array of the messages whose check holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in checks]))


def decode(content: Column, strict: bool = True) -> Column:
    """Bytes or text to text: BOM dropped, line ends unified.

    Strict decoding yields null for bytes that are not UTF-8; otherwise they
    are replaced.
    """
    raw = content.cast("string")
    text = F.try_validate_utf8(raw) if strict else F.make_valid_utf8(raw)
    return tx.unify_newlines(F.regexp_replace(text, r"^\ufeff", ""))


def text_corpus(df: DataFrame, content: str, strict: bool = True) -> DataFrame:
    """Add decoded ``text`` and ``problem`` (null for usable rows).

    Rows with a problem are the quarantine; nothing is dropped here.
    """
    text = decode(F.col(content), strict)
    problem = (
        F.when(F.octet_length(content) == 0, "empty document")
        .when(F.col("text").isNull(), "not valid UTF-8")
        .when(tx.strip(F.col("text")) == "", "only white space")
    )
    return df.withColumn("text", text).withColumn("problem", problem)


def html_corpus(
    df: DataFrame, content: str, max_bytes: int = rules.MAX_HTML_BYTES
) -> DataFrame:
    """Add ``size_bytes`` and ``problem`` for the HTML size and emptiness gate."""
    size = F.octet_length(content)
    problem = (
        F.when(size == 0, "empty document")
        .when(size > max_bytes, "over the size limit")
        .when(~F.is_valid_utf8(F.col(content).cast("string")), "not valid UTF-8")
        .when(tx.strip(F.col(content).cast("string")) == "", "only white space")
    )
    return df.withColumn("size_bytes", size.cast("bigint")).withColumn("problem", problem)


def fingerprints(df: DataFrame, id_col: str, content: str) -> DataFrame:
    body = F.col(content)
    return df.select(
        id_col,
        F.sha2(body, 256).alias("sha256"),
        F.sha1(body).alias("sha1"),
        F.md5(body).alias("md5"),
        F.octet_length(body).cast("bigint").alias("size_bytes"),
    )


#: Longer file names are reported; they are never cut.
MAX_NAME = 255


def normalized_file_name(name: Column) -> Column:
    """Safe ASCII file name, or null when nothing safe is left."""
    base = F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"(?s)([^/]*)$", 1)
    base = tx.strip(base)
    safe = F.regexp_replace(tx.fold_ascii(base), r"[\x00-\x1f\x7f]", "")
    safe = F.regexp_replace(safe, r"\s+", "_")
    safe = F.regexp_replace(safe, r"[^A-Za-z0-9._+-]", "")
    safe = F.regexp_replace(F.regexp_replace(safe, r"_+", "_"), r"^[ ._-]+|[ ._-]+$", "")
    extension = F.lower(F.regexp_extract(safe, r"(\.[^.]*)$", 1))
    stem = F.regexp_replace(safe, r"\.[^.]*$", "")
    stem = F.regexp_replace(stem, r"^[ ._-]+|[ ._-]+$", "")
    stem = F.when(stem == "", "file").otherwise(stem)
    stem = F.when(
        F.upper(stem).isin(rules.RESERVED_NAMES), F.concat(F.lit("file_"), stem)
    ).otherwise(stem)
    bad = base.isin("", ".", "..") | (safe == "")
    return F.when(~bad, F.concat(stem, extension))


def plain_mime(mime: Column) -> Column:
    return F.lower(tx.strip(F.substring_index(mime, ";", 1)))


def admit_uploads(
    df: DataFrame,
    max_bytes: int = rules.MAX_UPLOAD_BYTES,
    extensions: Sequence[str] = rules.ALLOWED_EXTENSIONS,
    mime_types: Sequence[str] = rules.ALLOWED_MIME_TYPES,
) -> DataFrame:
    """(name, mime, size, …) plus normalized fields, ``reasons`` and ``admitted``."""
    out = df.withColumn("file_name", normalized_file_name(F.col("name")))
    out = out.withColumn(
        "extension",
        F.coalesce(F.lower(F.regexp_extract("file_name", r"\.([^.]*)$", 1)), F.lit("")),
    ).withColumn("mime_type", plain_mime(F.col("mime")))
    pairs = [
        (F.col("extension") == ext) & ~F.col("mime_type").isin(list(allowed))
        for ext, allowed in rules.MIME_BY_EXTENSION.items()
    ]
    mismatch = pairs[0]
    for pair in pairs[1:]:
        mismatch = mismatch | pair
    out = out.withColumn(
        "reasons",
        reasons(
            (F.col("file_name").isNull(), "invalid file name"),
            (F.length("file_name") > MAX_NAME, "file name too long"),
            (F.col("size") <= 0, "zero bytes"),
            (F.col("size") > max_bytes, "too large"),
            (~F.col("extension").isin(list(extensions)), "extension not allowed"),
            (~F.col("mime_type").isin(list(mime_types)), "type not allowed"),
            (mismatch, "type does not match extension"),
        ),
    )
    return out.withColumn("admitted", F.size("reasons") == 0)


def route_formats(df: DataFrame, extension: Column, mime: Column) -> DataFrame:
    """Add ``parser``: the first one in order that supports both facts.

    The capability list has a fixed handful of rows, so it is written as one
    ``when`` chain inside the scan stage instead of a join.
    """
    ext = F.nullif(F.lower(tx.strip(extension)), F.lit(""))
    ext = F.when(F.contains(ext, F.lit("/")) | F.contains(ext, F.lit("\\")),
                 F.nullif(F.regexp_extract(ext, r"[^/\\.](\.[^./\\]+)$", 1), F.lit(""))
                 ).otherwise(ext)
    ext = F.when(F.startswith(ext, F.lit(".")), ext).otherwise(F.concat(F.lit("."), ext))
    kind = F.nullif(F.nullif(plain_mime(mime), F.lit("")), F.lit("application/octet-stream"))
    known = ext.isNotNull() | kind.isNotNull()
    choice = F.when(~known, F.lit(None).cast("string"))
    for name, extensions, mimes in rules.PARSER_CAPABILITIES:
        fits = (ext.isNull() | ext.isin(*extensions)) & (kind.isNull() | kind.isin(*mimes))
        choice = choice.when(fits, name)
    return df.withColumn("parser", choice)


def usable_text(df: DataFrame, text: str, minimum: int = rules.MIN_USABLE_CHARS) -> DataFrame:
    """Add ``clean`` and ``usable``: enough characters after cleaning.

    A text is cleaned once: a filter on what is generated is not moved in front
    of it, nor in front of an earlier join, with the whole cleaning repeated.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != "clean"]
    cleaned = df.select(*kept, F.explode(F.array(tx.clean_text(F.col(text)))).alias("clean"))
    return cleaned.withColumn("usable", F.length("clean") >= minimum)
