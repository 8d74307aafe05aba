"""Folds of documents by a checksum of their id."""

from pyspark.sql import Column, functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))
