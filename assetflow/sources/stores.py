"""The stores that files are in, as tasks open them."""

from __future__ import annotations

from pyarrow import fs

# Stores where a file appears only when it is complete, and where a move would be a second copy.
OBJECT_STORES = {"s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "az", "abfss": "az"}


def split_uri(uri: str) -> tuple[str, str, str]:
    """(kind of store, bucket or host, path in it) of a file as Spark lists it.

    The path is taken as it stands: names may hold spaces, ``%`` and ``#``. For object stores it
    begins with the bucket or container.
    """
    scheme, found, rest = uri.partition("://")
    if not found:
        return "file", "", uri.removeprefix("file:")
    if scheme == "file":
        return "file", "", "/" + rest.lstrip("/")
    authority, _, key = rest.partition("/")
    kind = OBJECT_STORES.get(scheme, scheme)
    if kind == "az":  # container@account.host
        container, _, host = authority.partition("@")
        return kind, host.partition(".")[0], f"{container}/{key}"
    if kind in ("s3", "gs"):
        return kind, "", f"{authority}/{key}"
    return kind, authority, f"/{key}"


def open_store(kind: str, authority: str) -> fs.FileSystem:
    if kind == "file":
        return fs.LocalFileSystem()
    if kind == "s3":
        return fs.S3FileSystem()
    if kind == "gs":
        return fs.GcsFileSystem()
    if kind == "az":
        return fs.AzureFileSystem(authority)
    host = f"{kind}://{authority}" if authority else "default"
    return fs.HadoopFileSystem.from_uri(host) if authority else fs.HadoopFileSystem(host)


def locate(uri: str, stores: dict) -> tuple[fs.FileSystem, str, bool]:
    """(store, path, whether it is an object store); a task opens each store once."""
    kind, authority, path = split_uri(uri)
    if (kind, authority) not in stores:
        stores[kind, authority] = open_store(kind, authority)
    return stores[kind, authority], path, kind in OBJECT_STORES.values()
