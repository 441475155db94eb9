"""Small files in a folder that Spark reaches: numbered states, of which the highest holds, and parts that become one file."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: How often a change of a state tries again behind other writers.
ATTEMPTS = 100
_changing = threading.Lock()


class Folder:
    """A folder in whatever file system its name says."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.conf, self.folder = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), folder
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def sizes(self) -> dict[str, int]:
        """Bytes of each file; nothing if the folder is not there."""
        return {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self.path())} if self.fs.exists(self.path()) else {}

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, content: bytes) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def rename_to_new(self, old: str, new: str) -> bool:
        """False if the new name is taken; the old file is gone then, too."""
        whole = self.path().makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.conf)
        kind = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(kind, 1)
        self.jvm.java.lang.reflect.Array.set(options, 0, kind.getEnumConstants()[0])  # NONE: never over another file
        try:
            context.rename(self.path(old), self.path(new), options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self.delete(old)
            return False
        return True

    def join(self, first: str, others: list[str]) -> bool:
        """Appends the other files to the first, by the file system itself; local files by copying. False where there is neither."""
        others = [n for n, size in self.sizes().items() if n in set(others) and size]
        if not others:
            return True
        others = sorted(others)
        if self.fs.getScheme() == "file":
            raw = self.fs.getRawFileSystem() if hasattr(self.fs, "getRawFileSystem") else self.fs
            self.delete(f".{first}.crc")
            out = raw.append(self.path(first))
            try:
                for n in others:
                    stream = raw.open(self.path(n))
                    self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, self.conf, False)
                    stream.close()
            finally:
                out.close()
            return True
        paths = self.jvm.java.lang.reflect.Array.newInstance(self.path().getClass(), len(others))
        for i, n in enumerate(others):
            self.jvm.java.lang.reflect.Array.set(paths, i, self.path(n))
        try:
            self.fs.concat(self.path(first), paths)
        except Py4JJavaError as e:
            if "UnsupportedOperationException" not in e.java_exception.getClass().getName():
                raise
            return False
        return True


class States(Folder):
    """A small JSON value that is replaced as a whole: files 1.json, 2.json, ..., of which the highest holds."""

    def numbers(self) -> list[int]:
        names = [n.removesuffix(".json") for n in self.sizes() if n.endswith(".json")]
        return sorted(int(n) for n in names if n.isdigit())

    def at(self, number: int) -> dict:
        return json.loads(self.read(f"{number}.json"))

    def latest(self) -> dict:
        numbers = self.numbers()
        return self.at(numbers[-1]) if numbers else {}

    def change(self, changed: Callable[[dict], dict]) -> None:
        """Writes the changed value under another name and renames it to the next number, which must not exist; who comes second takes
        the newer value and tries again."""
        with _changing:
            for _ in range(ATTEMPTS):
                numbers = self.numbers()
                new = f"_{uuid.uuid4().hex}"
                self.write(new, json.dumps(changed(self.at(numbers[-1]) if numbers else {}), ensure_ascii=False, sort_keys=True).encode())
                if self.rename_to_new(new, f"{numbers[-1] + 1 if numbers else 1}.json"):
                    return
        raise RuntimeError(f"other writers were first {ATTEMPTS} times")
