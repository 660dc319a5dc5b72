"""Files in shared storage, written and read by executors."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; a plain path is local."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))
    return pafs.LocalFileSystem(), uri


def attempt(folder: str, name: str) -> str:
    """A name that no other attempt of the task uses; the manifest lists the attempts that count."""
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def write(uri: str, *parts) -> None:
    fs, path = opened(uri)
    with fs.open_output_stream(path, compression=None) as out:
        for p in parts:
            out.write(p)


def read(uri: str) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        return f.readall()
