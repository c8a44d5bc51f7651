import hashlib
import random
import struct
import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest

from pageloom.llm import media

SF = "/root/testdata/sf0.01"


def filtered(samples, kinds):
    """Any of the five filters applied literally, pixel by pixel."""
    out = []
    for r, kind in enumerate(kinds):
        line = [kind]
        for x in range(samples.shape[1]):
            a = int(samples[r, x - 1]) if x else 0
            b = int(samples[r - 1, x]) if r else 0
            c = int(samples[r - 1, x - 1]) if r and x else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(samples[r, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out.append(line)
    return np.array(out, np.uint8)


def test_all_filters_are_undone():
    rng = np.random.default_rng(0)
    for _ in range(20):
        samples = rng.integers(0, 256, (9, 17), dtype=np.uint8)
        assert (media.unfilter(filtered(samples, rng.integers(0, 5, 9).tolist())) == samples).all()


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 576, b"x" * 577, bytes(range(256)) * 50, b"line of text\n" * 4000, "é😀".encode() * 999])
def test_round_trip(data):
    payload = media.payload_of(data)
    assert len(payload) % 576 == 0 and payload and payload.startswith(data) and set(payload[len(data) :]) <= {255}
    png = media.encode_png(payload)
    assert media.decode_png(png).tobytes() == payload
    width, height = struct.unpack(">II", png[16:24])
    assert width * height == len(payload)


def test_damage_is_found():
    png = media.encode_png(media.payload_of(b"some text" * 200))
    for at in range(0, len(png), 7):
        bad = bytearray(png)
        bad[at] ^= 4
        with pytest.raises(media.CorruptMedia):
            media.decode_png(bytes(bad))
    for bad in (b"", png[:-5], png + b"x"):
        with pytest.raises(media.CorruptMedia):
            media.decode_png(bad)


def area_means(samples, size):
    """Means of equal areas, each pixel weighed by the part of it that lies in the area."""
    share = lambda n: np.array([[max(0.0, min(i + 1, (k + 1) * n / size) - max(i, k * n / size)) for i in range(n)] for k in range(size)]) * size / n
    rows, columns = share(samples.shape[0]), share(samples.shape[1])
    return rows @ samples @ columns.T


def test_cosine_hash_against_sums():
    rng = np.random.default_rng(1)
    for height in (1, 2, 23, 24, 25, 61):
        samples = rng.integers(0, 255, (height, 576), dtype=np.uint8)
        assert np.allclose(media.shrunk(samples), area_means(samples.astype(float), 24))
        samples.ravel()[-40:] = 255
        level = samples.astype(float)
        level.ravel()[-40:] = level.ravel()[:-40].mean()
        tile = area_means(level, 24)
        low = [[sum(tile[x, y] * np.cos(np.pi * u * (2 * x + 1) / 48) * np.cos(np.pi * v * (2 * y + 1) / 48) for x in range(24) for y in range(24)) for v in range(8)] for u in range(8)]
        low = np.array(low).round(6).ravel()
        bits = "".join("1" if c > np.median(low[1:]) else "0" for c in low)
        assert media.cosine_hash(samples).hex() == f"{int(bits, 2):016x}"


def test_features_tell_texts_apart_and_stay_near_for_small_edits():
    """Unlike texts, as the given table holds near copies, whose features should be equal or near."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(400, 4000))) for _ in range(150)]
    of = lambda t: int.from_bytes(media.cosine_hash(media.decode_png(media.encode_png(media.payload_of(t.encode())))))
    prints = [of(t) for t in texts]
    apart = [(a ^ b).bit_count() for a, b in zip(prints, prints[1:])]
    edited = [(of(t[:1000] + "XY" + t[1002:]) ^ p).bit_count() for t, p in zip(texts, prints)]
    print(len(set(prints)), np.mean(edited), np.mean(apart))
    assert len(set(prints)) >= 0.95 * len(texts) and np.mean(edited) < 0.25 * np.mean(apart)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts, same = {r.doc_id: r.text for r in docs.collect()}, {}
    for r in media.digest(docs).collect():
        data = texts[r.doc_id].encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        png = media.encode_png(payload)
        assert r.media_bytes == len(png) and r.media_sha256 == hashlib.sha256(png).hexdigest() and len(r.feature) == 16
        assert same.setdefault(data, r.feature) == r.feature
    assert len(texts) == docs.count()


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "é" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("hash", F.lit(2))
    got = media.digest(docs).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in got) == [(0, 576)] * 3 + [(400_000, 400_320)]
    assert len({r.media_sha256 for r in got}) == 2
    assert media.digest(docs.limit(0)).collect() == []
