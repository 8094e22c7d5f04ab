"""Writing intermediate results where all executors can read them, and steps on the shared file system."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's ``spark.checkpoint.dir`` names, which all executors share.

    On a cluster one has to be set; a temporary one serves local sessions alone
    (tests).
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codeloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once a row.

    A generator of one row stands between them and their uses; without it the
    planner may copy an expression into every place that names it, and plans
    of several levels grow to many times their size.
    """
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


class SharedFolder:
    """Files under a path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(conf)
        self.names = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def glob(self, pattern: str) -> list[str]:
        """Names below the folder that fit ``pattern``, sorted."""
        found = self.fs.globStatus(self._at(pattern)) or []
        root = self.fs.makeQualified(self._at("")).toUri().getPath().rstrip("/") + "/"
        return sorted(f.getPath().toUri().getPath().removeprefix(root) for f in found)

    def read(self, name: str) -> str | None:
        """The text of a small file; None if there is none."""
        if not self.exists(name):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A small file as a whole: it is written beside its place and renamed over what is there."""
        fresh = f"{name}.new"
        stream = self.fs.create(self._at(fresh), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        option = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(option.OVERWRITE.getClass(), 1)
        options[0] = option.OVERWRITE
        self.names.rename(self._at(fresh), self._at(name), options)

    def move(self, old: str, new: str) -> None:
        """A folder put in place of another, if there is one."""
        self.delete(new)
        self.fs.mkdirs(self._at(new).getParent())
        if not self.fs.rename(self._at(old), self._at(new)):
            raise OSError(f"cannot move {self.path}/{old} to {new}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
