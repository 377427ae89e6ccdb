"""Files that tasks write and read by themselves, through pyarrow's file systems."""

from __future__ import annotations

#: What other names of a file system's scheme pyarrow calls it.
SCHEMES = {"s3a": "s3", "s3n": "s3", "viewfs": "viewfs", "gcs": "gs", "wasbs": "abfss", "wasb": "abfs"}


def known_scheme(folder: str) -> str:
    """The folder with its scheme as pyarrow calls it: what Spark writes as s3a: is s3: there."""
    scheme, mark, rest = folder.partition("://")
    return SCHEMES.get(scheme.lower(), scheme) + mark + rest if mark else folder


def file_system(folder: str):
    """(file system, path in it) of a folder of a cluster or of this machine."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(known_scheme(folder))


def removed(folder: str) -> None:
    """Deletes a folder that nobody reads any more."""
    files, path = file_system(folder)
    files.delete_dir(path)
