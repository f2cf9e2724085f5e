"""Files by URI, for code that runs on executors: what pyarrow's file systems reach; a plain path is a local one."""

from __future__ import annotations


def filesystem(uri: str):
    """File system and path of a URI."""
    from pyarrow import fs

    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def names(uri: str, suffix: str) -> list[str]:
    """Sorted paths of the files with a suffix in a folder, or of the one file that uri is; none if there is nothing."""
    from pyarrow import fs

    files, path = filesystem(uri)
    info = files.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        return []
    if info.type == fs.FileType.File:
        return [path]
    return sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.path.endswith(suffix))


def force(files, path: str) -> None:
    """Force a file or folder of the local file system to disk; elsewhere a closed file is as durable as the store makes it."""
    import os

    from pyarrow import fs

    if isinstance(files, fs.LocalFileSystem):
        fd = os.open(path, os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)
