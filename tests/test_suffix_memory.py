import random
import tracemalloc

from stylometra.llm import suffixdedup as S


def test_anchors_take_little_memory():
    """What anchors of 4 MB of texts take beside their result doesn't grow with the megabytes that go in at once."""
    rng = random.Random(3)
    texts = [rng.randbytes(20_000) for _ in range(200)]
    S.anchors(texts[:2])
    tracemalloc.start()
    try:
        found = S.anchors(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * sum(x.nbytes for x in found) + 40_000_000, peak
    parts = [S.anchors([t]) for t in texts]
    assert [x.tolist() for x in found[1:]] == [[v for p in parts for v in p[k].tolist()] for k in range(1, 5)]
    assert found[0].tolist() == [k for k, p in enumerate(parts) for _ in p[0]]
