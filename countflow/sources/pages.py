"""What Parquet files prove without their data: footers, page headers and dictionary pages.

A dictionary page lists every value of a column chunk if all its data pages refer to the
dictionary. Page headers (thrift, compact protocol) tell whether they do, so neither data
page nor value is decoded.
"""

from __future__ import annotations

import functools
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: page types, and encodings that refer to a dictionary.
DICTIONARY_PAGE, DATA_PAGES, BY_DICTIONARY = 2, (0, 3), (2, 8)
#: Fixed values of the format: widths of plain numbers.
PLAIN = {"INT32": "<i4", "INT64": "<i8", "FLOAT": "<f4", "DOUBLE": "<f8"}


def paths(scan: DataFrame) -> DataFrame:
    """The files of a scan, as a frame: (path). Read by Spark from the scan's own metadata, never listed on the driver."""
    return scan.select(F.col("_metadata.file_path").alias("path")).distinct()


@functools.lru_cache(maxsize=4)
def open_file(path: str) -> tuple[pa.NativeFile, pq.ParquetFile]:
    if path.startswith("file:"):
        f = pa.OSFile("/" + unquote(path[5:]).lstrip("/"))
    elif "://" in path:
        fs, inner = pa.fs.FileSystem.from_uri(path)
        f = fs.open_input_file(inner)
    else:
        f = pa.OSFile(path)
    return f, pq.ParquetFile(f)


class _Thrift:
    """Reads one struct of the compact protocol: field ids with their integers or inner structs; other kinds are passed over."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def whole(self) -> int:
        n = self.varint()
        return n >> 1 ^ -(n & 1)

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            return self.byte()
        if kind in (4, 5, 6):
            return self.whole()
        if kind == 7:
            self.at += 8
        elif kind == 8:
            n = self.varint()
            self.at += n
            if self.at > len(self.data):
                raise IndexError
        elif kind in (9, 10):
            head = self.byte()
            n = self.varint() if head >> 4 == 15 else head >> 4
            for _ in range(n):
                self.byte() if head & 15 in (1, 2) else self.value(head & 15)
        elif kind == 12:
            return self.struct()
        else:
            raise ValueError(f"kind {kind}")
        return None

    def struct(self) -> dict:
        out, field = {}, 0
        while head := self.byte():
            field = field + (head >> 4) if head >> 4 else self.whole()
            out[field] = self.value(head & 15)
        return out


def _header(f, at: int, left: int) -> tuple[dict, int]:
    n = 128
    while True:
        reader = _Thrift(f.read_at(min(n, left), at))
        try:
            return reader.struct(), reader.at
        except IndexError:
            if n >= left:
                raise ValueError("page header without end") from None
            n *= 8


def dictionary(path: str, row_group: int, column: int) -> pa.Array | None:
    """The values of a chunk's dictionary if every data page refers to it; None if it proves nothing.

    Writers enter a value on its first use, so the dictionary holds exactly the distinct
    non-null values (NaN among them).
    """
    f, parquet = open_file(path)
    chunk = parquet.metadata.row_group(row_group).column(column)
    name = chunk.path_in_schema
    if not chunk.has_dictionary_page or chunk.physical_type not in (*PLAIN, "BYTE_ARRAY"):
        return None
    kind = parquet.schema_arrow.field(name).type
    begin = min(x for x in (chunk.dictionary_page_offset, chunk.data_page_offset) if x)
    at, end, raw, size = begin, begin + chunk.total_compressed_size, None, 0
    while at < end:
        head, used = _header(f, at, end - at)
        page, body = head[1], at + used
        if page == DICTIONARY_PAGE:
            data = f.read_at(head[3], body)
            raw = data if chunk.compression == "UNCOMPRESSED" else pa.Codec(chunk.compression.lower()).decompress(data, head[2]).to_pybytes() if chunk.compression in ("SNAPPY", "ZSTD", "GZIP", "BROTLI", "LZ4_RAW") else None
            size = head[7][1]
        elif page in DATA_PAGES:
            if (head[5][2] if page == 0 else head[8][4]) not in BY_DICTIONARY:
                return None
        at = body + head[3]
    return None if raw is None else _plain(raw, size, chunk.physical_type, kind)


def _plain(raw: bytes, n: int, physical: str, kind: pa.DataType) -> pa.Array | None:
    if physical == "BYTE_ARRAY":
        if not (pa.types.is_string(kind) or pa.types.is_large_string(kind)):
            return None
        offsets, pieces, at = np.zeros(n + 1, np.int32), [], 0
        for i in range(n):
            size = int.from_bytes(raw[at : at + 4], "little")
            pieces.append(raw[at + 4 : at + 4 + size])
            at += 4 + size
            offsets[i + 1] = offsets[i] + size
        return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(b"".join(pieces)))
    values = np.frombuffer(raw, PLAIN[physical], n)
    if pa.types.is_decimal(kind) or pa.types.is_nested(kind):
        return None
    plain = pa.array(values)
    if getattr(kind, "bit_width", 0) == plain.type.bit_width:
        return pa.Array.from_buffers(kind, n, plain.buffers())
    return plain.cast(kind) if pa.types.is_integer(kind) else None
