import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phrasemill.llm import gif


@given(st.lists(st.integers(0, 15), min_size=1, max_size=3000))
@settings(max_examples=40, deadline=None)
def test_lzw_round_trip(indices):
    data = bytes(indices)
    assert gif.lzw_decode(gif.lzw_encode(data, 4), 4, len(data)) == data


def test_lzw_beyond_a_full_table():
    data = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(data, 8), 8, len(data)) == data


def shown(width, height, palette, frames):
    """What each frame leaves on screen, pixel by pixel."""
    canvas = [[(0, 0, 0, 0)] * width for _ in range(height)]
    out = []
    for f in frames:
        own = palette if f.palette is None else f.palette
        before = [row[:] for row in canvas]
        for y in range(f.indices.shape[0]):
            for x in range(f.indices.shape[1]):
                i = int(f.indices[y, x])
                if i != f.transparent and f.top + y < height and f.left + x < width:
                    canvas[f.top + y][f.left + x] = (*map(int, own[i]), 255)
        out.append(np.array(canvas, np.uint8))
        if f.disposal == 2:
            for y in range(f.indices.shape[0]):
                for x in range(f.indices.shape[1]):
                    if f.top + y < height and f.left + x < width:
                        canvas[f.top + y][f.left + x] = (0, 0, 0, 0)
        elif f.disposal == 3:
            canvas = before
    return out


@pytest.mark.parametrize("seed", range(6))
def test_frames_round_trip(seed):
    rng = np.random.default_rng(seed)
    w, h = int(rng.integers(5, 40)), int(rng.integers(5, 40))
    palette = rng.integers(0, 256, (16, 3)).astype(np.uint8)
    frames = []
    for k in range(5):
        x, y = int(rng.integers(0, w - 1)), int(rng.integers(0, h - 1))
        fw, fh = int(rng.integers(1, w - x + 1)), int(rng.integers(1, h - y + 1))
        own = None if k % 2 else rng.integers(0, 256, (4, 3)).astype(np.uint8)
        index = rng.integers(0, 4, (fh, fw)).astype(np.uint8)
        frames.append(gif.Frame(x, y, index, own, int(rng.integers(0, 300)), k % 4, None if k % 3 else int(rng.integers(0, 4)), bool(k % 2)))
    found = gif.decode(gif.encode(w, h, palette, frames))
    for f, g, rgba in zip(frames, found, shown(w, h, palette, frames), strict=True):
        assert (g.delay_ms, g.disposal) == (10 * f.delay, f.disposal)
        assert (g.rgba == rgba).all()
    assert [g.start_ms for g in found] == [0, *np.cumsum([g.delay_ms for g in found])[:-1].tolist()]


def test_known_bytes():
    """The 10 x 10 sample image of the public description of the format."""
    data = bytes.fromhex(
        "474946383961 0a000a00910000ffffffff00000000ff00000021f90400000000002c000000000a000a000002168c2d99872a1cdc33a00275ec95faa8de608c04914c01003b".replace(" ", "")
    )
    (f,) = gif.decode(data)
    expected = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    palette = [(255, 255, 255), (255, 0, 0), (0, 0, 255), (0, 0, 0)]
    assert [[tuple(p[:3]) for p in row] for row in f.rgba.tolist()] == [[palette[int(c)] for c in row] for row in expected]


def test_histogram_leaves_transparent_pixels_out():
    rgba = np.array([[[0, 0, 0, 255], [255, 255, 255, 255], [255, 0, 0, 0]]], np.uint8)
    h = gif.histogram(rgba)
    assert h[0] == 1 and h[63] == 1 and h.sum() == 2


def test_hard_rows(spark):
    good = gif.encode(8, 8, gif.PALETTE, gif.drawing(np.linspace(-0.5, 0.5, 64)))
    huge = b"GIF89a" + b"\xff\xff\xff\xff\x00\x00\x00" + b"\x3b"
    rows = [(1, good, "x"), (1, good, "x"), (None, good, "x"), (2, None, "x"), (3, b"", "x"), (4, good[:40], "x"), (5, b"\x89PNG....", "x"), (6, huge, "x"), (7, good[:61] + b"\x3b", "x")]
    media = spark.createDataFrame(rows, "media_id long, data binary, frame string").withColumnRenamed("frame", "rgba")
    out = gif.frames(media).toPandas()
    counts = out.groupby("media_id", dropna=False).size()
    assert counts[1] == 8 and counts[counts.index.isna()].iloc[0] == 4
    bad = out[out.error.notna()]
    assert sorted(bad.media_id) == [2, 3, 4, 5, 6] and bad.rgba.isna().all()
    assert gif.frames(media.limit(0)).count() == 0


def test_frames_before_a_fault_are_kept(spark):
    good = gif.encode(8, 8, gif.PALETTE, gif.drawing(np.linspace(-0.5, 0.5, 64)))
    last = good.rindex(b"\x21\xf9\x04")
    media = spark.createDataFrame([(1, good[: last + 30]), (2, good)], "media_id long, data binary")
    out = gif.frames(media).toPandas().set_index("media_id")
    assert out.loc[1].error.isna().tolist() == [True, True, True, False]
    assert out.loc[1].rgba.tolist()[:3] == out.loc[2].rgba.tolist()[:3]
    assert gif.frames(media.where("media_id = 2"), most_pixels=63).toPandas().error.tolist() == ["the canvas is too large"]


def test_many_frames_on_a_large_canvas_are_handed_on():
    """50 frames of one pixel on 1000 x 1000: one canvas is held, not 50."""
    import tracemalloc

    one = np.zeros((1, 1), np.uint8)
    data = gif.encode(1000, 1000, gif.PALETTE, [gif.Frame(i, i, one + i % 16, disposal=1 + i % 3) for i in range(50)])
    tracemalloc.start()
    opaque = [int(gif.histogram(f.rgba).sum()) for f in gif.shown_frames(data)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(opaque) == 50 and peak < 40_000_000
    assert opaque[:5] == [1, 2, 2, 2, 3]  # the second is cleared, the third taken back


def test_query_draws_what_it_decodes(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 64)]) for i in range(5)] + [(9, None), (10, [1.0] * 3)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    out = gif.frames(gif.drawn(table)).toPandas().set_index(["media_id", "frame"])
    for i, v in vectors[:5]:
        for k, rgba in enumerate(shown(8, 8, gif.PALETTE, gif.drawing(np.array(v)))):
            row = out.loc[(i, k)]
            assert row.rgba == rgba.tobytes() and row.n_opaque == sum(row.histogram) == int((rgba[..., 3] > 0).sum())
    assert out.loc[9].error.notna().all() and out.loc[10].error.notna().all()
