"""The quality network reads every window, at even and at odd bytes."""

import numpy as np

from mortise.llm import quality_net as q


def test_every_window_is_convolved():
    text = bytes(np.random.default_rng(5).integers(0, 256, 1500, dtype=np.uint8))
    net = q.Net()
    want = np.stack([sum(net.tables[o][text[i + o]] for o in range(q.WIDTH)) for i in range(len(text) - q.WIDTH + 1)]).max(0)
    x = q.pieces(text)
    pairs = [(net.tables[k][:, None, :] + net.tables[k + 1][None, :, :]).reshape(65536, q.FILTERS) for k in range(0, q.WIDTH, 2)]
    whole = text[: q.CHUNK + (len(x) - 2) * (q.CHUNK - q.WIDTH + 1)]  # without the last chunk and its filling of blanks
    want = np.stack([sum(net.tables[o][whole[i + o]] for o in range(q.WIDTH)) for i in range(len(whole) - q.WIDTH + 1)]).max(0)
    assert np.allclose(q.pooled(x[:-1], pairs, net.bias).max(0), np.maximum(want, 0), atol=1e-5)
    assert np.allclose(q.outputs(x[:-1], net.tables, net.bias).max((0, 1)), want, atol=1e-5)
