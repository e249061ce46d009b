"""Access to shared folders from inside tasks."""

from urllib.parse import unquote

from pyarrow import fs


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a folder given as a path or an address."""
    if path.startswith("file:"):
        path = unquote("/" + path[5:].lstrip("/"))
    if path.startswith("/"):
        return fs.LocalFileSystem(), path.rstrip("/") or "/"
    system, folder = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system, folder.rstrip("/")


def listed(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """Entries right below a folder; empty if it is gone."""
    return system.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def below(folder: str, path: str) -> str:
    return path[len(folder):].lstrip("/")
