"""What the operators share: tables, the shared folder, row keys and a per-process cache for kernels."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: ASCII white space; what ``bytes.split()`` cuts at, and a class that Java, RE2 and Python read alike.
SPACES = r"[ \t\n\r\x0B\f]+"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: what spark.checkpoint.dir or setCheckpointDir names.

    Only a session of one machine may do without: it has a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="phrasemill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut there, and it outlives any executor.

    The table goes when it is discarded, or when the driver's Python ends.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/phrasemill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001 - the session has ended and its folder with it
            pass

    atexit.register(remove)
    out = spark.read.schema(df.schema).parquet(at)
    out._phrasemill_remove = remove
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        t._phrasemill_remove()
        atexit.unregister(t._phrasemill_remove)


def column(df: DataFrame, name: str) -> Column:
    """df's column of exactly that name, whatever is in it: dots and the like."""
    return df["`" + name.replace("`", "``") + "`"]


def row_of(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets a name of an operator's."""
    return F.struct(*(column(df, c).alias(c) for c in df.columns))


def _hashable(c: Column, kind: DataType) -> Column:
    """c, or its JSON where its type holds a map or a variant anywhere: Spark hashes neither."""

    def odd(t: DataType) -> bool:
        inner = [f.dataType for f in t.fields] if isinstance(t, StructType) else [t.elementType] if isinstance(t, ArrayType) else []
        return t.typeName() in ("map", "variant") or any(map(odd, inner))

    return F.to_json(F.struct(c.alias("c"))) if odd(kind) else c


def row_hash(df: DataFrame, columns: list[str] | None = None, seed: int | None = None) -> Column:
    """64 bits over the row's values; a null isn't taken for an empty or a missing neighbour."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return F.xxhash64(*([] if seed is None else [F.lit(seed)]), *(x for f in fields for c in [column(df, f.name)] for x in (_hashable(c, f.dataType), F.isnull(c))))


def by_bytes(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """texts in slices of about ``most`` bytes, one text at least."""
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // most
    bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(texts)] if len(texts) else [0]
    for begin, end in zip(bounds, bounds[1:]):
        yield texts.slice(begin, end - begin)


def kept(name: str, make):
    """make()'s value, one for each Python process: kernels keep vocabularies here from task to task."""
    cache = sys.modules.setdefault("_phrasemill_kept", types.ModuleType("_phrasemill_kept")).__dict__
    if name not in cache:
        cache[name] = make()
    return cache[name]


class Known(dict):
    """A dict that makes what is missing, and starts anew beyond ``most`` entries or ``most_bytes`` of keys.

    A key that is long, such as a line without a space, isn't kept: it would hardly be met again.
    """

    LONG = 64

    def __init__(self, make, most: int = 400_000, most_bytes: int = 24 << 20):
        super().__init__()
        self.make, self.most, self.most_bytes, self.held = make, most, most_bytes, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.LONG:
            if len(self) >= self.most or self.held >= self.most_bytes:
                self.clear()
                self.held = 0
            self[key] = value
            self.held += len(key)
        return value


def plain(token: bytes) -> bytes:
    """A word of a text in lower case, its letters and digits only."""
    return "".join(c for c in token.decode("utf-8", "replace").lower() if c.isalnum()).encode()
