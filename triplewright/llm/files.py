"""Files that tasks write and read themselves in the shared folder, by pyarrow's file systems (local or mounted, HDFS, S3, GCS).

A file gets a name of its own per task attempt and counts only if a table written by Spark names it: what a lost or repeated attempt has
left behind is never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, and its path there. A path without a scheme is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }:{rest}")


def create(folder: str, ending: str):
    """(uri, stream to write to) of a new file in a folder, which is made if it isn't there."""
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{ending}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def read_stream(uri: str):
    system, path = place(uri)
    return system.open_input_stream(path, compression=None, buffer_size=1 << 20)


def local_path(uri: str) -> str | None:
    """Where the file is on this machine, if its folder is mounted here."""
    system, path = place(uri)
    return path if isinstance(system, fs.LocalFileSystem) else None
