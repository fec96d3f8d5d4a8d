"""Content addressing: SHA-256 over canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def canonical_json(keep_nulls: bool = True, **fields: Column) -> Column:
    """JSON object with alphabetical keys, no blanks and raw non-ASCII text."""
    body = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    options = {"ignoreNullFields": "false" if keep_nulls else "true"}
    text = F.to_json(body, options)
    # Jackson writes control escapes in upper case; the canonical form is lower.
    lowered = text
    for digit in "ABCDEF":
        lowered = F.regexp_replace(
            lowered, rf"\\u00([01]){digit}", rf"\\u00$1{digit.lower()}"
        )
    return F.when(text.rlike(r"\\u00[01][A-F]"), lowered).otherwise(text)


def sha256_json(keep_nulls: bool = True, **fields: Column) -> Column:
    return F.sha2(canonical_json(keep_nulls, **fields), 256)


def chunk_hash(text: Column, content_type: Column, heading_context: Column) -> Column:
    return sha256_json(
        text=text, content_type=content_type, heading_context=heading_context
    )
