"""Field encryption: base64 of a random IV and AES-CBC of the text, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks rows whose fields are encrypted.
MARK = "__encrypted"


def encrypt_fields(df: DataFrame, fields: list[str], key: bytes) -> DataFrame:
    """``df`` with text fields encrypted under a key of 16, 24 or 32 bytes; nulls stay null."""
    sealed = {f: F.base64(F.aes_encrypt(F.col(f).cast("string").cast("binary"), F.lit(key), F.lit("CBC"), F.lit("PKCS"))) for f in fields}
    return df.withColumns(sealed | {MARK: F.lit(1)})


def decrypt_fields(df: DataFrame, fields: list[str], key: bytes) -> DataFrame:
    """What encrypt_fields was given; rows without the mark are left as they are."""
    opened = {f: F.when(F.col(MARK) == 1, F.aes_decrypt(F.unbase64(f), F.lit(key), F.lit("CBC"), F.lit("PKCS")).cast("string")).otherwise(F.col(f)) for f in fields}
    return df.withColumns(opened).drop(MARK)
