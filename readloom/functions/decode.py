"""Packed bases and quality bytes as text, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX, BASES = "0123456789ABCDEF", "=ACMGRSVTWYHKDBN"


def decode_seq(packed: Column, width: Column) -> Column:
    """Two bases a byte, high half first, cut to `width`. A null input gives null; a negative width, or one of more bases
    than there are, is an error."""
    text = F.translate(F.hex(packed), HEX, BASES)
    bad = (width < 0) | (F.length(packed) * 2 < width)
    return F.when(packed.isNull() | width.isNull(), F.lit(None).cast("string")).when(bad, F.raise_error(F.lit("sequence width does not fit the packed bases")).cast("string")).otherwise(F.substring(text, F.lit(1), width.cast("int")))


def _byte(raw: Column, i: Column) -> Column:
    return F.conv(F.substring(F.hex(raw), 2 * i - 1, F.lit(2)), 16, 10).cast("int")


def decode_qual(raw: Column, missing: str = "star") -> Column:
    """Phred bytes plus 33 as text. All bytes 255 is a missing quality: `*`, or with missing="space" as many spaces; else a
    byte of 255 counts as 0 in star mode and wraps at 256 in space mode."""
    n = F.length(raw)
    if missing == "star":
        value = lambda i: F.when(_byte(raw, i) == 255, F.lit(0)).otherwise(_byte(raw, i)) + 33
        none = F.lit("*")
    elif missing == "space":
        value = lambda i: (_byte(raw, i) + 33).bitwiseAND(255)
        none = F.repeat(F.lit(" "), n)
    else:
        raise ValueError("missing is 'star' or 'space'")
    text = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.char(value(i))), "")
    return F.when(raw.isNull(), F.lit(None).cast("string")).when(n == 0, F.lit("")).when(F.hex(raw) == F.repeat(F.lit("FF"), n), none).otherwise(text)


def decode_seqqual(df: DataFrame, seq: str | None = "seq", qual: str | None = "qual", width: str = "qwidth") -> DataFrame:
    """df with the packed columns that it has as text; other columns stay."""
    has_seq, has_qual = seq in df.columns, qual in df.columns
    if not has_seq and not has_qual:
        raise ValueError("no column to decode")
    if has_seq and width not in df.columns:
        raise ValueError(f"decoding {seq} needs {width}")
    made = ({seq: decode_seq(F.col(seq), F.col(width))} if has_seq else {}) | ({qual: decode_qual(F.col(qual))} if has_qual else {})
    return df.withColumns(made)
