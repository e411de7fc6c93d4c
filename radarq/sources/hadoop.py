"""Small files and renames on any file system that Spark knows, from the driver."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """A folder on a Hadoop file system; names are relative to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def direct(self) -> str:
        """The folder, made if need be, where it really lies: a mount of other stores gives the store behind it."""
        self._fs.mkdirs(self.path(""))
        return self._fs.resolvePath(self.path("")).toString().rstrip("/")

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder, in order; nothing if there is none."""
        if not self._fs.exists(self.path(name)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(name)))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def read(self, name: str) -> str:
        source = self._fs.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def write_once(self, name: str, text: str) -> bool:
        """A file appears with all its text, or, if it is there already, stays as it is: then False.

        It is written aside and renamed without overwriting, which is atomic where the store's rename is, as
        on HDFS and local disks; a store without such a rename needs one writer at a time.
        """
        folder, _, last = name.rpartition("/")
        aside = f"{folder}/.{last}-{uuid.uuid4().hex}"
        self._fs.mkdirs(self.path(folder))
        out = self._fs.create(self.path(aside), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.path(aside), self.path(name), options)
            return True
        except Py4JJavaError as e:
            self.delete(aside)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise

    def move(self, source: str, target: str) -> None:
        """source becomes target, in place of what is there; if source is gone and target there, this has been done before."""
        if not self.exists(source):
            if not self.exists(target):
                raise FileNotFoundError(f"neither {source} nor {target} in {self.folder}")
            return
        self._fs.mkdirs(self.path(target).getParent())
        self.delete(target)
        if not self._fs.rename(self.path(source), self.path(target)):
            raise OSError(f"{source} can't become {target} in {self.folder}")

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)
