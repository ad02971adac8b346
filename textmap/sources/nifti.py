"""NIfTI-1 volumes: a reader of headers and values, and a writer, for masks and maps of one file each."""

from __future__ import annotations

import gzip
import struct

import numpy as np

# Data type codes of the format.
TYPES = {2: np.uint8, 4: np.int16, 8: np.int32, 16: np.float32, 64: np.float64, 256: np.int8, 512: np.uint16, 768: np.uint32}


def loads(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(values, 4x4 affine) of a .nii or .nii.gz file's bytes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", data[:4])[0] != 348 or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(order + "8h", data[40:56])
    code = struct.unpack(order + "h", data[70:72])[0]
    zoom = struct.unpack(order + "8f", data[76:108])
    offset, slope, inter = struct.unpack(order + "3f", data[108:120])
    q_code, s_code = struct.unpack(order + "2h", data[252:256])
    shape = dim[1 : 1 + dim[0]]
    values = np.frombuffer(data, np.dtype(TYPES[code]).newbyteorder(order), int(np.prod(shape)), int(offset)).reshape(shape, order="F")
    if slope not in (0.0, 1.0) or inter:
        values = values * (slope or 1.0) + inter
    affine = np.eye(4)
    if s_code > 0:
        affine[:3] = np.array(struct.unpack(order + "12f", data[280:328])).reshape(3, 4)
    elif q_code > 0:
        b, c, d, *shift = struct.unpack(order + "6f", data[256:280])
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine[:3, :3] = turn * np.array([zoom[1], zoom[2], zoom[3] * (-1 if zoom[0] < 0 else 1)])
        affine[:3, 3] = shift
    else:
        affine[:3, :3] = np.diag(zoom[1:4])
    return values, affine


def dumps(values: np.ndarray, affine: np.ndarray) -> bytes:
    """A gzipped single-file volume."""
    kind = next((c for c, t in TYPES.items() if np.dtype(t) == values.dtype), 64)
    values = values.astype(TYPES[kind])
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, kind, values.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *np.sqrt((np.array(affine)[:3, :3] ** 2).sum(axis=0)), *[1.0] * 4)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *np.array(affine, float)[:3].ravel())
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + values.tobytes(order="F"), mtime=0)


def volumes(maps, grid):
    """study_id, content: each study's map (study_id, voxel_id, value) as the bytes of a .nii.gz file. A task holds one volume at a time."""
    import pandas as pd

    shape, affine = tuple(grid.shape), np.array(grid.affine)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros(int(np.prod(shape)), np.float32)
        values[frame["voxel_id"].to_numpy()] = frame["value"].to_numpy()
        return pd.DataFrame({"study_id": [frame["study_id"].iloc[0]], "content": [dumps(values.reshape(shape), affine)]})

    kind = maps.schema["study_id"].dataType.simpleString()
    return maps.select("study_id", "voxel_id", "value").groupBy("study_id").applyInPandas(one, f"study_id {kind}, content binary")


def write_volumes(maps, grid, folder: str) -> None:
    """One <study>.nii.gz per study in a folder; each task writes its own, under a name that a task run again writes anew."""

    def write(frames):
        import pandas as pd
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(base, recursive=True)
        for frame in frames:
            for study, content in zip(frame["study_id"], frame["content"]):
                with system.open_output_stream(f"{base}/{study}.nii.gz", compression=None) as out:
                    out.write(content)
                yield pd.DataFrame({"study_id": [str(study)]})

    volumes(maps, grid).mapInPandas(write, "study_id string").count()


def read_mask(spark, path: str):
    """(mask table, grid) of a volume: its non-zero voxels."""
    from textmap.operators.space import Grid

    values, affine = loads(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    values = values.reshape(values.shape[:3])
    grid = Grid(tuple(int(n) for n in values.shape), tuple(map(tuple, affine.tolist())))
    i, j, k = (np.nonzero(values)[a] for a in range(3))
    rows = [(int((a * grid.shape[1] + b) * grid.shape[2] + c), int(a), int(b), int(c)) for a, b, c in zip(i, j, k)]
    return spark.createDataFrame(rows, "voxel_id long, i int, j int, k int"), grid
