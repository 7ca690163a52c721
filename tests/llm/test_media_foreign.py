"""Progressive JPEG files of another encoder (the one of the Java runtime), and columns with null, grey and damaged files."""

import numpy as np
import pytest

from plotline.llm import media


def encoded(spark, pixels: np.ndarray, quality: float) -> tuple[bytes, np.ndarray]:
    """A progressive file of ``pixels`` (grey or RGB), and the pixels that the same runtime reads from it."""
    jvm = spark._jvm
    h, w = pixels.shape[:2]
    grey = pixels.ndim == 2
    try:
        image = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
        raster = image.getRaster()
        for y in range(h):
            for x in range(w):
                for k in range(1 if grey else 3):
                    raster.setSample(x, y, k, int(pixels[y, x] if grey else pixels[y, x, k]))
        io = jvm.javax.imageio.ImageIO
        writer = io.getImageWritersByFormatName("jpeg").next()
        param = writer.getDefaultWriteParam()
        param.setProgressiveMode(1)
        param.setCompressionMode(2)
        param.setCompressionQuality(quality)
        out = jvm.java.io.ByteArrayOutputStream()
        target = io.createImageOutputStream(out)
        writer.setOutput(target)
        writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
        target.close()
        back = io.read(jvm.java.io.ByteArrayInputStream(out.toByteArray()))
        read = np.array([back.getRaster().getSample(x, y, k) for y in range(h) for x in range(w) for k in range(1 if grey else 3)]).reshape(pixels.shape)
    except Exception as e:  # a runtime without image codecs
        pytest.skip(f"no encoder: {e}")
    return bytes(out.toByteArray()), read


def picture(h: int, w: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    return np.clip(128 + 60 * np.sin(x / 7 + seed) + 40 * np.cos(y / 5) + rng.normal(0, 12, (h, w)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("h, w", [(24, 32), (19, 13)])
@pytest.mark.parametrize("quality", [0.95, 0.4])
def test_grey_files_of_another_encoder(spark, h, w, quality):
    file, want = encoded(spark, picture(h, w, 1), quality)
    pic = media.Picture(file)
    assert len(pic.scans) > 3 and any(s.ah for s in pic.scans) and max(len(s.ac or ()) for s in pic.scans) > 1
    got = media.decode(file)
    assert got.shape == (h, w, 3) and np.abs(got[..., 0].astype(int) - want).max() <= 1


def test_colour_files_of_another_encoder(spark):
    flat = np.stack([picture(32, 32, 2)] * 3, axis=2)
    flat[:, :16] = flat[:, :16] // 2 + np.array([60, 10, 0], np.uint8)  # chroma constant over whole samples: upsampling cannot differ inside
    file, want = encoded(spark, flat, 0.9)
    pic = media.Picture(file)
    assert any(len(s.comps) == 3 for s in pic.scans)  # interleaved DC
    diff = np.abs(media.decode(file).astype(int) - want)
    assert np.median(diff) <= 1 and diff[:, 2:12].max() <= 4 and diff.mean() < 3


def test_columns_of_mixed_files(spark):
    files = [encoded(spark, picture(16, 24, 3), 0.9)[0], encoded(spark, picture(24, 16, 4), 0.3)[0], encoded(spark, np.stack([picture(16, 16, 5)] * 3, 2), 0.7)[0]]
    own = media.payload_jpeg([np.arange(128, dtype=np.uint8)])[0]
    rows = [(i, None, f, "x") for i, f in enumerate(files)] + [(3, 128, own, "x"), (4, 64, None, "x"), (5, None, files[0][:200], "x"), (6, None, b"\xff\xd8nothing", "x"), (None, None, b"", None)]
    got = media.read_media(spark.createDataFrame(rows, "doc_id long, payload_bytes long, media binary, size string").coalesce(1)).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r, f in zip(got[:4], [*files, own]):
        x = media.decode(f)
        assert bytes(r.rgb) == x.tobytes() and (r.height, r.width) == x.shape[:2] and r.feature == media.tensor_features(x) and r.media_error is None
    assert bytes(got[3].payload) == bytes(range(128)) and got[0].payload is None
    for r in got[4:]:
        assert r.rgb is None and r.height is None and r.feature is None and r.media_error
    assert got[4].media_error == "no media"


def test_digests_by_hand(spark):
    import hashlib
    import zlib

    texts = [None, "", "word " * 30, "é" * 100, "x" * 64, "x" * 64]
    got = media.media_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in sorted(got, key=lambda r: r.doc_id):
        raw = (texts[r.doc_id] or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        file = media.payload_jpeg([np.frombuffer(p, np.uint8)])[0]
        (pic,), (coef,) = media.coefficients([file])
        slow = {c: np.zeros_like(x) for c, x in coef.items()}
        for scan in pic.scans:  # bit by bit, not by strides
            media._scan_serial(pic, scan, slow)
        want = (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(file), hashlib.sha256(file).hexdigest(), media.tensor_features(media.rgb(pic, slow)))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == want
