import hashlib
import zlib

import numpy as np
import pytest

from veilframe.llm import jpeg, media, queries

TEXTS = [None, "", "a", "é😀" * 40, "x" * 192, "y" * 193, "same", "same", "long text " * 30_000]


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string")
    rows = {r["doc_id"]: r for r in media.digest(media.store_texts(docs)).collect()}
    for i, text in enumerate(TEXTS):
        payload = jpeg.pad((text or "").encode())
        r = rows[i]
        assert len(payload) % 192 == 0 and r["n_bytes"] == len((text or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["n_scans"] == 8
    assert rows[6][1:] == rows[7][1:] and rows[0][1:] == rows[1][1:]


def test_all_bytes_and_tensors(spark):
    payload = bytes(range(256)) * 3
    frame = jpeg.Frame(jpeg.store(payload))
    assert jpeg.payload_of(frame) == payload
    got = media.tensors(spark.createDataFrame([(1, bytearray(jpeg.store(payload))), (2, None)], "id long, media binary")).orderBy("id").collect()
    assert (got[0]["height"], got[0]["width"]) == (16, 64) and len(got[0]["rgb"]) == 16 * 64 * 3
    assert got[1]["rgb"] is None


def writer(bits):
    whole = np.array(bits + [1] * (-len(bits) % 8), np.uint8)
    return np.packbits(whole).tobytes().replace(b"\xff", b"\xff\x00")


def number(v, n):
    return [v >> k & 1 for k in range(n - 1, -1, -1)]


def encode_sparse(blocks, split):
    """A plain progressive encoder for one grey component: DC in two passes, AC bands in two passes."""
    every = sorted({r << 4 | s for r in range(16) for s in range(11)} - {n << 4 for n in range(15, 15)})
    dc = jpeg.Codes(bytes([0] * 3 + [12] + [0] * 12), bytes(range(12)))
    ac = jpeg.Codes(bytes([0] * 7 + [176] + [0] * 8), bytes(every))
    put = lambda codes, s: number(codes.code[s][1], codes.code[s][0])

    def mag(v):
        n = abs(v).bit_length()
        return n, number(v if v > 0 else v + (1 << n) - 1, n)

    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\0" + bytes(range(1, 65))), jpeg._segment(0xC4, b"\x00" + dc.segment), jpeg._segment(0xC4, b"\x10" + ac.segment)]
    out.append(jpeg._segment(0xC2, b"\x08\x00\x08" + (8 * len(blocks)).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])))
    bits, last = [], 0
    for b in blocks:
        n, extra = mag((b[0] >> 1) - last)
        last = b[0] >> 1
        bits += put(dc, n) + extra
    out += [jpeg._scan_head([(1, 0)], 0, 0, 0, 1), writer(bits)]
    out += [jpeg._scan_head([(1, 0)], 0, 0, 1, 0), writer([b[0] & 1 for b in blocks])]
    down = lambda v: (abs(v) >> 1) * (1 if v > 0 else -1)
    for first, end in ((1, split), (split + 1, 63)):
        bits = []
        for b in blocks:
            run = 0
            for k in range(first, end + 1):
                v = down(b[k])
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits += put(ac, 0xF0)
                    run -= 16
                n, extra = mag(v)
                bits += put(ac, run << 4 | n) + extra
                run = 0
            if run:
                bits += put(ac, 0)
        out += [jpeg._scan_head([(1, 0)], first, end, 0, 1), writer(bits)]
    bits = []
    for b in blocks:
        k = 1
        while True:
            new = next((j for j in range(k, 64) if abs(b[j]) == 1), None)
            if new is None:
                break
            zeros, corrections, j = 0, [], k
            while j < new:
                if down(b[j]):
                    corrections.append(abs(b[j]) & 1)
                else:
                    zeros += 1
                    if zeros == 16:
                        bits += put(ac, 0xF0) + corrections
                        zeros, corrections = 0, []
                j += 1
            bits += put(ac, zeros << 4 | 1) + [int(b[new] > 0)] + corrections
            k = new + 1
        if k <= 63:
            bits += put(ac, 0) + [abs(b[j]) & 1 for j in range(k, 64) if down(b[j])]
    out += [jpeg._scan_head([(1, 0)], 1, 63, 1, 0), writer(bits), b"\xff\xd9"]
    return b"".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_symbol_by_symbol(seed):
    rng = np.random.default_rng(seed)
    blocks = rng.integers(-40, 41, (5, 64)) * (rng.random((5, 64)) < (0.05, 0.2, 0.5, 0.9, 1.0, 0.0)[seed])
    blocks += rng.integers(-1, 2, (5, 64)) * (rng.random((5, 64)) < 0.2)
    blocks[:, 0] = rng.integers(-500, 500, 5)
    frame = jpeg.Frame(encode_sparse(blocks.tolist(), 5 + 9 * seed))
    assert (frame.components[1].coefficients == blocks).all()
    grey = frame.rgb()
    assert grey.shape == (8, 40, 3) and (grey[..., 0] == grey[..., 2]).all()
    # against the plain definition of the inverse transform
    zig = jpeg._zigzag()
    f = np.zeros(64)
    f[zig] = blocks[0] * np.arange(1, 65)
    f = f.reshape(8, 8)
    c = np.where(np.arange(8) == 0, np.sqrt(0.5), 1.0)
    want = [
        [sum(c[u] * c[v] * f[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 + 128 for y in range(8)]
        for x in range(8)
    ]
    assert np.abs(np.clip(np.round(want), 0, 255) - grey[:, :8, 0].astype(int)).max() <= 1


def test_zigzag_starts_as_the_standard_says():
    assert jpeg._zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_bad_bytes():
    for data in (b"", b"\xff\xd8\xff\xd9x"[:2], b"GIF89a"):
        with pytest.raises((jpeg.JpegError, IndexError)):
            jpeg.Frame(data)


def test_query(spark):
    rows = queries.op6_media(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert r["payload_sha256"] == hashlib.sha256(jpeg.pad(docs[r["doc_id"]].encode())).hexdigest()


def test_payloads_beyond_one_width_of_rows():
    """Over 4095 rows of the usual width a frame gets wider."""
    payload = np.random.default_rng(1).integers(0, 256, 192 * (64 * jpeg.MOST_ROWS + 1), dtype=np.uint8).tobytes()
    assert jpeg.payload_of(jpeg.Frame(jpeg.store(payload))) == payload


def test_digest_of_null_and_foreign_bytes(spark):
    rows = [(1, 3, None), (2, 3, b""), (3, 3, b"\xff\xd8\xff\xd9"), (4, 3, b"\xff\xd8\xff\xc2\x00"), (5, 192, jpeg.store(b" " * 192))]
    got = {r["doc_id"]: r for r in media.digest(spark.createDataFrame([(a, b, None if c is None else bytearray(c)) for a, b, c in rows], "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["media_bytes"] is None and got[1]["feature"] is None
    assert [got[k]["media_bytes"] for k in (2, 3, 4)] == [0, 4, 5] and all(got[k]["payload_sha256"] is None for k in (2, 3, 4))
    assert got[5]["payload_bytes"] == 192
