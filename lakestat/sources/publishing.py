"""Several tables published together: readers see all of a publication or none of it.

``root/data`` has a folder of Parquet tables for each attempt, ``root/published`` a text file for each publication, named
by its number, that says where every table lies. Tables are written first and the file is put in place last, by one
rename; an attempt that fails before leaves what was published as it was. Between writers at the same time the rename
decides on HDFS, where it is one step and does not replace. Elsewhere (local disks, object stores) only the look before it
does, which two writers may pass together: let one job write there. Folders of old and failed attempts are not deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, root: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{root}/published")
    return hadoop, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the publications in ``root``, in order; none if there is no such folder."""
    _, folder, fs = _files(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def contents(spark: SparkSession, root: str, version: int | None = None) -> dict[str, str]:
    """Folder of each table in a publication, the newest unless one is named; nothing where none was made."""
    known = versions(spark, root)
    if version is not None and version not in known:
        raise ValueError(f"no publication {version}")
    if not known:
        return {}
    return json.loads(spark.read.text(f"{root}/published/{known[-1] if version is None else version:012d}", wholetext=True).first().value)


def published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a publication, the newest unless one is named. A later publication does not change what is being read."""
    return spark.read.parquet(contents(spark, root, version)[name])


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], base: int | None = None) -> int:
    """Writes the tables and publishes them together; returns the number. Tables not given stay as they were.

    ``base`` is the publication that the tables were made from, the newest one if null. If another was published after
    it, this one is refused with a RuntimeError, for its tables know nothing of the other's rows.
    """
    known = versions(spark, root)
    start = base if base is not None else (known[-1] if known else 0)
    places = contents(spark, root, start) if start else {}
    attempt = f"{root}/data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{attempt}/{name}")
        places[name] = f"{attempt}/{name}"
    hadoop, folder, fs = _files(spark, root)
    fs.mkdirs(folder)
    waiting, final = hadoop.Path(f"{attempt}/published"), hadoop.Path(folder, f"{start + 1:012d}")
    out = fs.create(waiting, False)
    out.write(json.dumps(places).encode())
    out.close()
    if fs.exists(final) or not fs.rename(waiting, final):
        raise RuntimeError(f"publication {start + 1} was made by another writer")
    return start + 1
