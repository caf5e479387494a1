"""Classic netCDF grids z(lat, lon) as rows and rows as such files, one task a file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import counts

_TYPES = {1: (">i1", 1), 2: ("S1", 1), 3: (">i2", 2), 4: (">i4", 4), 5: (">f4", 4), 6: (">f8", 8)}


class Classic:
    """Dimensions and variables of a classic (CDF-1 or CDF-2) file held as bytes."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2):
            raise ValueError("not a classic netCDF file")
        self.data, self.at, self.wide = data, 8, data[3] == 2
        self.dims = [(self._name(), self._int()) for _ in range(self._list())]
        self._attributes()
        self.vars = {}
        for _ in range(self._list()):
            name = self._name()
            dims = [self._int() for _ in range(self._int())]
            attributes = self._attributes()
            kind, _ = self._int(), self._int()
            begin = struct.unpack_from(">q" if self.wide else ">i", self.data, self.at)[0]
            self.at += 8 if self.wide else 4
            self.vars[name] = (dims, kind, begin, attributes)

    def _int(self) -> int:
        self.at += 4
        return struct.unpack_from(">i", self.data, self.at - 4)[0]

    def _list(self) -> int:
        return (self._int(), self._int())[1]

    def _name(self) -> str:
        n = self._int()
        out = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return out

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list()):
            name, kind, n = self._name(), self._int(), self._int()
            code, size = _TYPES[kind]
            out[name] = np.frombuffer(self.data, code, n, self.at)
            self.at += -(-n * size // 4) * 4
        return out

    def values(self, name: str) -> np.ndarray:
        dims, kind, begin, attributes = self.vars[name]
        shape = [self.dims[d][1] for d in dims]
        raw = np.frombuffer(self.data, _TYPES[kind][0], int(np.prod(shape)), begin).reshape(shape)
        out = raw.astype(float)
        for missing in ("_FillValue", "missing_value"):
            if missing in attributes:
                out[raw == attributes[missing][0]] = np.nan
        if "scale_factor" in attributes or "add_offset" in attributes:
            out = out * float(attributes.get("scale_factor", [1.0])[0]) + float(attributes.get("add_offset", [0.0])[0])
        return out


def read_grids(spark: SparkSession, path: str, variable: str = "z", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows (path, i_lon, i_lat, lon, lat, z) of the nodes of each file that hold a number."""
    return grid_rows(spark.read.format("binaryFile").load(path), variable, lon, lat)


def grid_rows(files: DataFrame, variable: str = "z", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """As ``read_grids``, from rows (path, content) of files."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                grid = Classic(bytes(content))
                x, y, z = grid.values(lon), grid.values(lat), grid.values(variable)
                j, i = np.nonzero(~np.isnan(z))
                yield pd.DataFrame({"path": name, "i_lon": i.astype("int32"), "i_lat": j.astype("int32"), "lon": x[i], "lat": y[j], "z": z[j, i]})

    return files.select("path", "content").mapInPandas(rows, "path string, i_lon int, i_lat int, lon double, lat double, z double")


def _padded(text: bytes) -> bytes:
    return struct.pack(">i", len(text)) + text + bytes(-len(text) % 4)


def classic_bytes(lon: np.ndarray, lat: np.ndarray, z: np.ndarray) -> bytes:
    """A CDF-2 file with lon, lat and z(lat, lon), all doubles."""
    arrays = {"lon": ([0], lon), "lat": ([1], lat), "z": ([1, 0], z)}
    names = list(arrays)
    dims = struct.pack(">iii", 0, 10, 2) + b"".join(_padded(n.encode()) + struct.pack(">i", len(arrays[n][1])) for n in names[:2])

    def header(begins: list[int]) -> bytes:
        out = b"CDF\x02" + dims + struct.pack(">iiii", 0, 0, 11, len(names))
        for name, begin in zip(names, begins):
            axes, values = arrays[name]
            out += _padded(name.encode()) + struct.pack(f">i{len(axes)}i", len(axes), *axes) + struct.pack(">iiiIq", 0, 0, 6, min(values.size * 8, 2**32 - 4), begin)
        return out

    at, begins = len(header([0, 0, 0])), []
    for name in names:
        begins.append(at)
        at += arrays[name][1].size * 8
    return header(begins) + b"".join(arrays[n][1].astype(">f8").tobytes() for n in names)


def grid_files(nodes: DataFrame, spacing: float, path: str) -> DataFrame:
    """Rows (path, content): a netCDF file of the full grid for each value of the column ``path`` of ``nodes`` (i_lon, i_lat, z).

    Nodes without a row are NaN, several rows of a node are averaged before they meet, so that a task holds
    no more than one grid.
    """
    n_lon, n_lat = counts(spacing)
    once = nodes.groupBy(F.col(path).alias("path"), "i_lon", "i_lat").agg(F.avg("z").alias("z"))

    def file(rows: pd.DataFrame) -> pd.DataFrame:
        z = np.full((n_lat, n_lon), np.nan)
        z[rows["i_lat"], rows["i_lon"]] = rows["z"]
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [classic_bytes(-180.0 + spacing * np.arange(n_lon), -90.0 + spacing * np.arange(n_lat), z)]})

    return once.groupBy("path").applyInPandas(file, "path string, content binary")


def save(files: DataFrame, folder: str) -> None:
    """Write each row (path, content) as a file under ``folder``, a URI that all executors reach. A task that runs again writes the same files."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                store.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("path", "content").mapInPandas(put, "n long").agg(F.sum("n")).collect()
