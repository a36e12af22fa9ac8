from __future__ import annotations

import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tilequery.session import build_session

    s = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def png(path, img: np.ndarray) -> None:
    """Write an 8-bit RGB or RGBA picture."""
    h, w, c = img.shape
    raw = b"".join(b"\x00" + img[r].astype(np.uint8).tobytes() for r in range(h))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, 0)
    Path(path).write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="session")
def tile_dir(tmp_path_factory):
    """12 triplets of 32 x 32 tiles (RGB and RGBA, one blank), a stray file, YAML metadata."""
    root = tmp_path_factory.mktemp("tiles")
    rng = np.random.default_rng(1)
    train = root / "train"
    train.mkdir()
    for t in range(12):
        for k, kind in enumerate(("anchor", "neighbor", "distant")):
            img = rng.integers(0, 256, (32, 32, 4 if t % 2 else 3))
            if t == 3 and k == 0:
                img[:] = 255
            png(train / f"{t:05d}_{kind}.png", img)
        loc = lambda n: f"{{lat: {10.5 + n}, lon: {-50.0 + n}, size: 200000.0}}"
        (train / f"{t:05d}_meta.yaml").write_text(
            f"target:\n  source_files: [a{t}.nc]\n  anchor: {loc(t)}\n  neighbor: {loc(t + 0.5)}\n"
            f"distant:\n  source_files: [b{t}.nc, c{t}.nc]\n  loc: {loc(t + 5)}\n"
        )
    png(train / "other.png", rng.integers(0, 256, (4, 4, 3)))
    return root


def vectors(spark, x: np.ndarray, **extra):
    rows = [(i, [float(v) for v in r], *[e[i] for e in extra.values()]) for i, r in enumerate(x)]
    names = "".join(f", {n} {'string' if isinstance(v[0], str) else 'long'}" for n, v in extra.items())
    return spark.createDataFrame(rows, f"tile_id long, embedding array<double>{names}")


def stacked(df, column="emb", key="tile_id") -> np.ndarray:
    return np.array([r[0] for r in df.orderBy(key).select(column).collect()], dtype=float)
