"""Text analysis as Columns; offsets count code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = "[a-z0-9]+(?:-[a-z0-9]+)*"
UNICODE_TOKEN = r"(?U)[^\W_]+(?:-[^\W_]+)*"
UNICODE_WORD = r"(?U)[^\W_]+"
MAX_QUERY = 2048


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words, inner hyphens kept, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def cut(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a text column, a row at least."""
    size = pa.compute.binary_length(batch[column]).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(size):
        if i > start and (held + n > most or i - start >= 4096):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


@F.pandas_udf(T.StringType())
def fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFC, case folding, NFC: what Spark has no function for."""
    nfc = lambda t: unicodedata.normalize("NFC", t)
    for s in parts:
        yield s.map(lambda t: None if t is None else nfc(nfc(t).casefold()))


@F.pandas_udf(T.StringType())
def compose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def unicode_terms(text: Column, hyphens: bool = True) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(UNICODE_TOKEN if hyphens else UNICODE_WORD), F.lit(0))


def analyzer_version(name: str = "v0") -> Column:
    return F.lit(f"{name}/{unicodedata.unidata_version}" if name != "v0" else "v0")


def analyse(text: Column, name: str = "v0") -> Column:
    if name == "v0":
        return tokens(text)
    if name == "unicode_nfc":
        return unicode_terms(text)
    raise ValueError(f"no analyzer {name}")


def squeeze(text: Column) -> Column:
    """White space runs become one space, ends are trimmed; case and marks stay."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def query_surface(text: Column) -> Column:
    """NFC and single spaces; null where control characters or too many characters are."""
    bad = text.rlike(r"[\p{Cc}\p{Cf}&&[^\t\n\r]]") | (F.length(text) > MAX_QUERY)
    return F.when(~bad, squeeze(compose(text)))


def content(text: Column, kind: Column) -> Column:
    """LF line ends and NFC; prose is squeezed, code keeps its spaces."""
    plain = compose(F.regexp_replace(text, "\r\n?", "\n"))
    return F.when(kind == "code", plain).otherwise(squeeze(plain))


def atoms(text: Column) -> Column:
    """Identifiers, capitalised names and lone numbers that a rewrite has to keep."""
    ids = F.regexp_extract_all(text, F.lit(r"\b[A-Z]+-[0-9]+\b"), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\b"), F.lit(0))
    numbers = F.regexp_extract_all(text, F.lit(r"(?<![\w-])[0-9]+(?![\w-])"), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(ids, names, numbers)))


def searchable(title: Column, body: Column) -> Column:
    return F.concat_ws("\n", title, body)


def encoder_input(text: Column, entity: Column, policy: str) -> Column:
    return text if policy == "body" else F.concat(F.lit("Entity: "), entity, F.lit("\n"), text)


def token_length(text: Column) -> Column:
    """The declared proxy where no word-piece vocabulary is at hand: a token per four characters."""
    return F.ceil(F.length(text) / 4.0)


def words(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
