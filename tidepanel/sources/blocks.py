"""Arrays in files of the shared folder, for blocks that many tasks read.

A block that meets every other block would be shuffled once per meeting. Here the task that fills a block writes it
once, its row carries only the path, and tasks that need the block read the file. No name is used twice: a repeated
attempt leaves a file that no row names.
"""

from __future__ import annotations

import json
import uuid

import numpy as np

_LINE = 64  # arrays begin at multiples of this


def file_system(path: str):
    """(file system, path in it); a URI names any store that Arrow reaches, a plain path is a shared folder."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def save(folder: str, **arrays: np.ndarray) -> str:
    """Name of a new file of ``folder`` that holds the arrays."""
    store, place = file_system(folder)
    store.create_dir(place, recursive=True)
    name, at, about = uuid.uuid4().hex, 0, {}
    for key, value in arrays.items():
        about[key] = (value.dtype.str, value.shape, at)
        at += -(-value.nbytes // _LINE) * _LINE
    head = json.dumps(about).encode()
    head += b" " * (-(len(head) + 8) % _LINE)
    with store.open_output_stream(f"{place}/{name}") as file:
        file.write(len(head).to_bytes(8, "little") + head)
        for value in arrays.values():
            file.write(np.ascontiguousarray(value).tobytes())
            file.write(b"\0" * (-value.nbytes % _LINE))
    return name


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, not to be written to."""
    store, place = file_system(folder)
    with store.open_input_file(f"{place}/{name}") as file:
        data = file.read_buffer()
    first = 8 + int.from_bytes(data[:8].to_pybytes(), "little")
    out = {}
    for key, (kind, shape, at) in json.loads(data[8:first].to_pybytes()).items():
        count = int(np.prod(shape, dtype=np.int64))
        out[key] = np.frombuffer(data, kind, count, first + at).reshape(shape) if count else np.zeros(shape, kind)
    return out


def dealt(names: list[tuple[int, str]], most: int) -> list[list[str]]:
    """Files (rows, name) put together to blocks of at most ``most`` rows; a larger file is a block of its own."""
    out: list[list[str]] = []
    size = most
    for rows, name in names:
        if size + rows > most:
            out.append([])
            size = 0
        out[-1].append(name)
        size += rows
    return out
