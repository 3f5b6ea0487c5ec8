"""Sorted hash arrays in the shared folder, memory-mapped by the tasks that read them."""

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyarrow import fs


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Write one array. A repeated or parallel attempt replaces the file by an equal one."""
    system, path = _system(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{os.getpid()}-{os.urandom(6).hex()}"
    with system.open_output_stream(draft) as out:
        out.write(pa.py_buffer(np.ascontiguousarray(values)))
    system.move(draft, f"{path}/{name}")


def map_array(folder: str, name: str, dtype: np.dtype) -> np.ndarray:
    """A written array, mapped; an array that was never written is empty.

    A file in a remote store is copied first; the copy has no name, so it goes with the task.
    """
    system, path = _system(folder)
    info = system.get_file_info(f"{path}/{name}")
    if info.type != fs.FileType.File or not info.size:
        return np.zeros(0, dtype=dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype=dtype, mode="r")
    with tempfile.TemporaryFile() as copy, system.open_input_stream(f"{path}/{name}") as stream:
        while block := stream.read(1 << 24):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, dtype=dtype, mode="r")


class SortedShards:
    """Keys sorted inside shards (key modulo the number of shards) with a record per key."""

    def __init__(self, folder: str, name: str, shards: int, record: np.dtype):
        self.parts = [
            (
                map_array(folder, f"{name}-{i:06d}.keys", np.dtype(np.uint64)),
                map_array(folder, f"{name}-{i:06d}.values", record),
            )
            for i in range(shards)
        ]
        self.record = record

    @staticmethod
    def write(folder: str, name: str, shard: int, keys: np.ndarray, values: np.ndarray) -> None:
        write_array(folder, f"{name}-{shard:06d}.keys", keys)
        write_array(folder, f"{name}-{shard:06d}.values", values)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Records of the keys; all zero for absent ones."""
        out = np.zeros(len(keys), dtype=self.record)
        shards = (keys % np.uint64(len(self.parts))).astype(np.int64)
        order = np.lexsort((keys, shards))
        cuts = np.searchsorted(shards[order], np.arange(len(self.parts) + 1))
        for i, (known, values) in enumerate(self.parts):
            rows = order[cuts[i] : cuts[i + 1]]
            if not len(rows) or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[rows]), len(known) - 1)
            hit = known[at] == keys[rows]
            out[rows[hit]] = values[at[hit]]
        return out
