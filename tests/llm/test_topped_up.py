"""Fillings of the linear program exchange pieces for longer ones of the rest."""

from collections import Counter

from quarrylight.llm import packing


def test_rooms_are_filled_from_the_rest():
    left = {7: 2, 5: 1, 9: 1}
    out = packing.topped_up([(((6, 1), (3, 1)), 4, True), (((10, 1),), 1, True)], left, 10)
    assert Counter(p for p, n, _ in out for _ in range(n)) == Counter({((7, 1), (3, 1)): 2, ((6, 1), (3, 1)): 2, ((10, 1),): 1})
    assert left == {6: 2, 5: 1, 9: 1}


def test_no_piece_is_lost():
    histogram = {n: 3 + n * 7 % 11 for n in range(5, 700, 3)}
    got: Counter = Counter()
    for pattern, times, _ in packing.planned(histogram, 1024, 60):
        assert sum(n * a for n, a in pattern) <= 1024
        for n, a in pattern:
            got[n] += a * times
    assert dict(got) == histogram
