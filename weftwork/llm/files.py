"""Files of the shared folder, through the file system that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """Small files, listings, renames and deletions on the driver, for any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.hadoop = self.jvm.org.apache.hadoop.fs
        path = self.hadoop.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.hadoop.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """(name, bytes) of what a folder holds; none if it does not exist."""
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self.path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """The whole file appears at once under ``name``, or not at all if another writer was first."""
        import uuid

        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        self.write(draft, text)
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        options[0] = none
        try:
            self.context.rename(self.path(draft), self.path(name), options)
            return True
        except Exception as error:
            self.fs.delete(self.path(draft), False)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
