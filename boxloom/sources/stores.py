"""Files of any store that Arrow opens, for the Python data sources."""

from __future__ import annotations

from pyarrow import fs


def store_of(path: str) -> fs.FileSystem:
    """The file system of a path or URI."""
    return fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()


def inner(path: str) -> str:
    """The path inside its store."""
    return fs.FileSystem.from_uri(path)[1] if "://" in path or path.startswith("file:") else path


def files_below(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(name, size) of a file, or of all files below a folder whose names end so and that are not hidden, by name."""
    store, root = store_of(path), inner(path)
    info = store.get_file_info(root)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda f: any(p[:1] in ("_", ".") for p in f.path[len(root) :].split("/"))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(suffix) and (info.is_file or not hidden(f)))
