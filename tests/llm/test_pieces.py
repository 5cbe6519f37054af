import random

from amendry.llm.suffix_groups import repeats_by_core


def test_pieces_find_every_window_that_holds_the_core():
    rng = random.Random(2)
    for _ in range(800):
        side = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5)))
        segments = sorted(((rng.randint(0, 4), side() + b"#SS#" + side()) for _ in range(9)), key=lambda x: x[0])
        segments = [x for x in segments if len(x[1]) >= 9]
        found = repeats_by_core([(d, t, t.index(b"#SS#"), 4) for d, t in segments], 9)
        want = {
            (i, a + x)
            for i, (d, t) in enumerate(segments)
            for a in range(len(t) - 8)
            if any(e < d and t[a : a + 9] in u for e, u in segments)
            for x in range(9)
        }
        assert {(i, a + x) for i, a, n in found for x in range(n)} == want
