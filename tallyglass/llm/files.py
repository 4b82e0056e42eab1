"""Binary files in the shared folder, written and range-read by tasks through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def resolve(uri: str):
    """The file system of a URI or plain path, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class Output:
    """A file that appears under its name only when it is complete.

    Each attempt of a task writes a name of its own, so a retry never meets the rest of a lost one; readers go by the
    list of names that finished tasks returned.
    """

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
        self.fs, self.path = resolve(self.uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.uri


class Ranges:
    """Range reads of a file."""

    def __init__(self, uri: str):
        f, path = resolve(uri)
        self.file = f.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError("range beyond the file")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        self.file.close()
