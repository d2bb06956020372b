"""Column helpers shared by the operators on texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, and a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def quoted(name: str) -> str:
    """A column's name as one part, whatever dots or backticks it holds."""
    return "`" + name.replace("`", "``") + "`"


def as_column(x: str | Column) -> Column:
    return F.col(quoted(x)) if isinstance(x, str) else x


def others(names: list[str], made: tuple[str, ...] | list[str]) -> list[str]:
    """``names`` without those that clash with ``made``, compared as Spark does: without case."""
    taken = {m.lower() for m in made}
    return [n for n in names if n.lower() not in taken]


def numbered_columns(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1, ...: Arrow functions take no dots in names."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(as_column(text), F.lit(""))


def word_count(text: str | Column) -> Column:
    """Words of the whole text as long; a null text has none."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def hidden(name: str) -> str:
    """Name of a working column, unlikely to clash with the input's columns."""
    return f"__lapforge_{name}"


#: Rows of whole texts that Spark sends to a Python worker at once.
BATCH = 1024


def small_batches(df: DataFrame) -> None:
    """Lowers the session's Arrow batches to ``BATCH`` rows where they have Spark's default.

    Batches are counted in rows, and 10,000 texts are held by the executor and by its
    worker at once; results don't depend on it.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH))
