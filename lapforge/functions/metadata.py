"""Units, description and interpolation of a channel, kept in its column's metadata."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

TIME = "timecodes"


@dataclass(frozen=True)
class ChannelMetadata:
    """What a channel measures, and whether values between its samples are linear."""

    units: str = ""
    desc: str = ""
    interpolate: bool = False

    @classmethod
    def of(cls, field: T.StructField | pa.Field) -> ChannelMetadata:
        """From a Spark or Arrow field; what is missing is empty or False."""
        found = {(k.decode() if isinstance(k, bytes) else k): (v.decode() if isinstance(v, bytes) else v) for k, v in (field.metadata or {}).items()}
        return cls(str(found.get("units", "")), str(found.get("desc", "")), str(found.get("interpolate", "")) == "True")

    from_field = of

    @classmethod
    def from_table(cls, schema: T.StructType | pa.Schema | pa.Table) -> ChannelMetadata:
        """From a channel's table: its first column that is not the time."""
        fields = schema.schema if isinstance(schema, pa.Table) else schema
        return next((cls.of(f) for f in fields if f.name != TIME), cls())

    from_channel_table = from_table

    def spark(self) -> dict[str, str]:
        return {"units": self.units, "desc": self.desc, "interpolate": str(self.interpolate)}

    def to_field_metadata(self) -> dict[bytes, bytes]:
        """Metadata of an Arrow field."""
        return {k.encode(): v.encode() for k, v in self.spark().items()}


def channel_metadata(df: DataFrame, name: str) -> ChannelMetadata:
    return ChannelMetadata.of(df.schema[name])


def with_metadata(column: Column, name: str, meta: ChannelMetadata) -> Column:
    """``column`` named and described; expressions lose metadata, so results need this."""
    return column.alias(name, metadata=meta.spark())


def catalogue(df: DataFrame, fixed: tuple[str, ...]) -> DataFrame:
    """(channel, units, desc, interpolate, type): one row for each channel column."""
    rows = [(f.name, *(lambda m: (m.units, m.desc, m.interpolate))(ChannelMetadata.of(f)), f.dataType.simpleString()) for f in df.schema if f.name not in fixed]
    return df.sparkSession.createDataFrame(rows, "channel string, units string, desc string, interpolate boolean, type string")


def to_arrow(df: DataFrame) -> pa.Table:
    """An Arrow table whose fields carry the columns' metadata as bytes."""
    table = df.toArrow()
    fields = [pa.field(f.name, f.type, f.nullable, ChannelMetadata.of(df.schema[f.name]).to_field_metadata() if df.schema[f.name].metadata else None) for f in table.schema]
    return table.cast(pa.schema(fields))
