"""The file system behind paths, through Hadoop's API: any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Entries that mark a folder as a code base.
MARKERS = (".git", "package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml")


class Files:
    """Entries under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.api = self.at().getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def exists(self, *parts: str) -> bool:
        return self.api.exists(self.at(*parts))

    def is_directory(self) -> bool:
        return self.exists() and self.api.getFileStatus(self.at()).isDirectory()

    def names(self, *parts: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.api.listStatus(self.at(*parts))) if self.exists(*parts) else []

    def changed(self, *parts: str) -> float:
        """Seconds since the epoch."""
        return self.api.getFileStatus(self.at(*parts)).getModificationTime() / 1000

    def size(self, *parts: str) -> int:
        return self.api.getContentSummary(self.at(*parts)).getLength() if self.exists(*parts) else 0

    def delete(self, *parts: str) -> bool:
        return self.api.delete(self.at(*parts), True)

    def read(self, *parts: str) -> str:
        stream = self.api.open(self.at(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, text: str, *parts: str) -> None:
        """Replaces a small file at once: readers see the old text or the new one."""
        new = [*parts[:-1], f".{parts[-1]}.new"]
        stream = self.api.create(self.at(*new), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.api.rename(self.at(*new), self.at(*parts)):  # where renaming doesn't replace
            self.delete(*parts)
            self.api.rename(self.at(*new), self.at(*parts))


def checked_folder(spark: SparkSession, path: str) -> str:
    """path without a slash at its end, if it is a folder."""
    if not Files(spark, path).is_directory():
        raise ValueError(f"not a directory: {path}")
    return path.rstrip("/")


def is_code_folder(spark: SparkSession, path: str) -> bool:
    """A folder with one of MARKERS in it."""
    found = Files(spark, path)
    return found.is_directory() and any(found.exists(m) for m in MARKERS)
