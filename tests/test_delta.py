"""Delta debugging: cases with known minimal sets."""

import random

import pytest

from surmise.api import all_minimal, ddmin, ddmin_all

# Known minimal sets, inputs, the size of 10,019 items and the seed 10 (also below) are goldens, and must stay as they are.
PAIRS = [{1, 2}, {2, 3}, {3, 4}]
SETS = [{1, 30, 5, 70, 900, 1100, 5300, 7500, 9700}, {2, 5}, {4}]


def any_of(sets):
    return lambda items: any(s <= set(items) for s in sets)


def as_sets(found):
    return {frozenset(f) for f in found}


@pytest.mark.parametrize(("sets", "items"), [(PAIRS, [1, 2, 4, 5]), (PAIRS, [1, 2, 3, 4, 5]), ([{1, 3, 5}], [1, 2, 3, 4, 5])])
def test_one(sets, items):
    assert set(ddmin(any_of(sets), items)) in sets


def test_one_of_a_thousand():
    wanted = set(random.Random(10).sample(range(1000), 15))
    assert set(ddmin(any_of([wanted]), list(range(1000)))) == wanted


@pytest.mark.parametrize(("sets", "items"), [(PAIRS, [5, 5, 4, 4, 3, 3, 2, 2, 1]), (PAIRS, [1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 6, 7, 8, 9, *range(100)]), (SETS, [*range(19), *range(10_000)])])
def test_all(sets, items):
    assert as_sets(ddmin_all(any_of(sets), items)) == as_sets(sets)


def test_all_of_a_thousand():
    r = random.Random(10)
    sets = [set(r.sample(range(1000), 15)) for _ in range(2)]
    assert as_sets(ddmin_all(any_of(sets), list(range(1000)))) == as_sets(sets)


def test_one_is_minimal_wherever_it_lies():
    """Own cases: wanted items at both ends, neighbours, all of them, and a threshold that any three pass."""
    for size in (1, 2, 3, 8, 31):
        items = [f"i{k}" for k in range(size)]
        for wanted in ({items[0], items[-1]}, set(items), set(items[size // 2 :][:2])):
            assert set(ddmin(lambda part, w=wanted: w <= set(part), items)) == wanted
    assert len(ddmin(lambda part: len(part) >= 3, list(range(20)))) == 3


def test_nothing_passes():
    assert ddmin(lambda _: False, [1]) is None and ddmin_all(lambda _: False, [1]) == []
    with pytest.raises(ValueError):
        ddmin(lambda _: False, [1], raise_on_error=True)
    assert ddmin(lambda _: True, [1, 2]) == []


def test_supports_of_any_kind():
    sets = [{1, 2}, {3}]
    assert as_sets(all_minimal(lambda part: next((sorted(s) for s in sets if s <= set(part)), None), [1, 2, 3])) == as_sets(sets)
