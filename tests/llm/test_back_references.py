import numpy as np

from nearkin.llm import webp


def strips_of(parts):
    samples = np.concatenate([np.frombuffer(p, np.uint8) for p in parts])
    return webp.write_strips(samples, np.cumsum([0, *map(len, parts)]), 64)


def test_strips_refer_back_to_repeats():
    rng = np.random.default_rng(3)
    passage, noise = rng.bytes(192), rng.bytes(64)
    near = passage[:100] + bytes([passage[100] ^ 1]) + passage[101:]
    parts = [passage * 20, passage, passage + noise + near * 3, bytes(64), noise, b"ab" * 2048, rng.integers(0, 3, 4096, dtype=np.uint8).tobytes(), passage * 341 + noise]
    files = strips_of(parts)
    chunks = [webp.chunks_of(f)[0] for f in files]
    for part, chunk, image in zip(parts, chunks, webp.read_many(chunks), strict=True):
        assert (image >> 8 & 255).astype(np.uint8).tobytes() == part
        one = webp.Image(chunk)  # symbol by symbol
        assert (one.finish(webp._pixels(one.reader, one.packed, one.height, one.cache, one.groups)) >> 8 & 255).astype(np.uint8).tobytes() == part
    assert len(files[0]) < len(files[1]) + 64 and len(files[2]) < len(files[1]) + 256 and len(files[5]) < 100
    assert all(strips_of([p])[0] == f for p, f in zip(parts, files, strict=True))  # whatever stands beside it


def test_strips_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(webp, "PIECE", 256)
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 4, 64 * n, dtype=np.uint8).tobytes() for n in (1, 3, 4, 5, 40, 2)]
    images = webp.read_many([webp.chunks_of(f)[0] for f in strips_of(parts)])
    assert [(i >> 8 & 255).astype(np.uint8).tobytes() for i in images] == parts
