"""Small files and parts of large ones, in any store that Arrow reads; paths without a scheme are local."""

from __future__ import annotations

import json

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri:
        uri = uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri  # one store under the names that Spark and Arrow have for it
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


def size(uri: str) -> int:
    fs, path = opened(uri)
    return fs.get_file_info(path).size or 0


def exists(uri: str) -> bool:
    fs, path = opened(uri)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def listed(uri: str) -> list[str]:
    """The file itself, or the files of a folder by name, without hidden ones and marks."""
    fs, path = opened(uri)
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return [uri]
    names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(path)) if i.type == pafs.FileType.File and i.base_name[0] not in "._"]
    return [f"{uri.rstrip('/')}/{n}" for n in sorted(names)]


def sizes(uri: str) -> dict[str, int]:
    """Bytes of each of listed(uri), from one listing."""
    fs, path = opened(uri)
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return {uri: size(uri)}
    size_of = {i.base_name: i.size or 0 for i in fs.get_file_info(pafs.FileSelector(path)) if i.type == pafs.FileType.File and i.base_name[0] not in "._"}
    return {f"{uri.rstrip('/')}/{n}": size_of[n] for n in sorted(size_of)}


def part(uri: str, start: int, length: int) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)


def tree_bytes(uri: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    fs, path = opened(uri)
    if fs.get_file_info(path).type == pafs.FileType.File:
        return size(uri)
    return sum(i.size or 0 for i in fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)) if i.type == pafs.FileType.File and not i.base_name.endswith(".crc"))


def write_json(uri: str, value: dict) -> None:
    """Write beside, then put in place."""
    fs, path = opened(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path + ".part") as f:
        f.write(json.dumps(value).encode())
    fs.move(path + ".part", path)


def read_json(uri: str) -> dict | None:
    """The document, or None where it is missing or broken."""
    if not exists(uri):
        return None
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        try:
            return json.loads(f.readall())
        except ValueError:
            return None


def identity(uri: str) -> tuple | None:
    """What changes whenever the file does: time and size; None where it is missing."""
    fs, path = opened(uri)
    i = fs.get_file_info(path)
    return None if i.type == pafs.FileType.NotFound else (str(i.mtime), i.size)
