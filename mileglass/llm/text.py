"""Small text helpers shared by the operators of this package."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mileglass.session import run_dir

# Blank characters that separate words, as a Java and Python character class.
BLANKS = r"\x20\x09-\x0D"
_WORD = re.compile(rf"[^{BLANKS}]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def lower_text(text: str) -> str:
    """The same for a Python string."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def blank_words(text: str) -> list[str]:
    """Maximal runs of characters that are not blank."""
    return text.split() if text.isascii() and not _ODD_BLANK.search(text) else _WORD.findall(text)


# str.split() also splits at these ASCII control characters.
_ODD_BLANK = re.compile(r"[\x1c-\x1f]")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor and is not computed twice.
    """
    spark: SparkSession = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_blocks(texts: pa.Array, most: int = 1 << 19) -> Iterator[pa.Array]:
    """``texts`` in order, cut into blocks of about ``most`` bytes; a longer text is a block with few others."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    starts = np.flatnonzero(np.diff(ends // most, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(texts)]):
        yield texts.slice(a, b - a)


def free_name(df: DataFrame | Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column has it (in any case of letters)."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    while name.lower() in taken:
        name = "_" + name
    return name


def replace_spans(text: Column, spans: Column, filler: str) -> Column:
    """``text`` with each span (struct start, end in characters; sorted, apart from each other) replaced."""
    n = F.size(spans)
    ends = F.transform(F.sequence(F.lit(0), n), lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)).cast("int"))
    pieces = F.transform(ends, lambda end, i: F.substring(
        text, end + 1, (F.coalesce(F.get(spans, i)["start"].cast("int"), F.length(text)) - end)))
    return F.when(n > 0, F.array_join(pieces, filler)).otherwise(text)
