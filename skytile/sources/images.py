"""Image files: Spark's image source as blocks, and a plain PNG writer for results and tests."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skytile.session import stored
from skytile.sources.annotations import base_name


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, prefix, w, h, bands, data): pixels row by row, bands last in the order blue, green, red. Other files are left out."""
    i = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select("image.*")
    return i.select(F.col("origin").alias("path"), base_name(F.col("origin")).alias("prefix"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("nChannels").alias("bands"), "data")


def as_blocks(images: DataFrame, rasters: DataFrame, block: int) -> DataFrame:
    """Images as square blocks of their rasters (prefix, image_id), as pixel jobs take them."""
    kinds = pa.schema([("image_id", pa.int64()), ("block_x", pa.int32()), ("block_y", pa.int32()), ("x0", pa.int32()), ("y0", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("bands", pa.int32()), ("data", pa.binary())])

    def cut(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], r["bands"])
                for by, y in enumerate(range(0, r["h"], block)):
                    row = [(r["image_id"], x // block, by, x, y, (p := a[y : y + block, x : x + block]).shape[1], p.shape[0], r["bands"], p.tobytes()) for x in range(0, r["w"], block)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*row), kinds)], schema=kinds)

    named = images.join(rasters.select("prefix", "image_id"), "prefix").select("image_id", "w", "h", "bands", "data")
    return named.mapInArrow(cut, "image_id long, block_x int, block_y int, x0 int, y0 int, w int, h int, bands int, data binary")


def png(data: Column, w: Column, h: Column, bands: Column) -> Column:
    """The pixels (one band, or blue, green, red) as a PNG file."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    @F.pandas_udf("binary")
    def encode(d: pd.Series, w: pd.Series, h: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for raw, ww, hh, bb in zip(d, w, h, b):
            a = np.frombuffer(raw, np.uint8).reshape(int(hh), int(ww), int(bb))[..., ::-1]
            rows = np.concatenate([np.zeros((int(hh), 1), np.uint8), a.reshape(int(hh), -1)], axis=1)
            head = struct.pack(">IIBBBBB", int(ww), int(hh), 8, 0 if bb == 1 else 2, 0, 0, 0)
            out.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b""))
        return pd.Series(out)

    return encode(data, w, h, bands)


def write_files(files: DataFrame, path: str) -> DataFrame:
    """Write (name, data), a file for each row, below ``path``; returns the names. A repeated task writes the same file again."""

    def write(batches):
        from pyarrow import fs

        system, local = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{local}/{name}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    return stored(files.select("name", "data").mapInArrow(write, "name string"), "written")
