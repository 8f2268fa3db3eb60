import numpy as np

from cohortlens.llm import jaccard


def test_a_single_equal_shingle_is_enough_at_64():
    """57 of 71 shingles are shared; every range of the hash but one, which holds a single
    shingle, has one that the other set lacks."""
    _, top = jaccard.class_of(64)
    parts = 40 * top // 180 + 1
    width = (1 << 64) // parts
    at = lambda part, i: part * width + (i + 1) * (width // 1000)
    own = [at(part, 500) for part in range(1, parts)]
    a, b = own[:7], own[7:14]
    broken = range(1, 15)
    assert parts >= 15
    shared = [at(0, 3), *(at(part % 14 + 1, part) for part in range(56))]
    extra = [at(part, 3) for part in range(15, parts)]
    shared = sorted(shared)[: 57 - len(extra)] + extra
    sets = [np.array(sorted(shared + x), np.uint64) for x in (a, b)]
    assert len(broken) == 14 and all(len(s) == 64 for s in sets)
    assert set(jaccard.range_keys(sets[0], 80, 100).tolist()) & set(jaccard.range_keys(sets[1], 80, 100).tolist())


def keys(u, p=80):
    return set(jaccard.range_keys(np.unique(u), p, 100).tolist())


def test_large_sets_without_a_common_shingle_do_not_meet():
    """Before, two sets of 4,000 met in one case of ten, in a range that is empty in both."""
    rng = np.random.default_rng(5)
    made = [keys(rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)) for _ in range(20)]
    assert not any(made[i] & made[j] for i in range(20) for j in range(i))


def test_sets_that_fill_few_ranges_meet_in_the_empty_ones():
    u = np.arange(1, 23, dtype=np.uint64)
    assert keys(u[:20]) & keys(u[2:])


def test_linked_sets_meet_however_their_hashes_lie():
    rng = np.random.default_rng(6)
    for turn in range(3000):
        n = int(rng.integers(5, 120))
        # From one end of the ring only to all of it.
        pool = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(turn % 12)) * np.uint64(2)
        n = len(pool)
        for p in (80, 90):
            gone = rng.permutation(n)[: n * (100 - p) // 100]
            half = rng.integers(0, len(gone) + 1)
            a, b = np.delete(pool, gone[:half]), np.delete(pool, gone[half:])
            assert keys(a, p) & keys(b, p)


def test_a_set_has_no_more_keys_than_it_needs():
    """A quarter of its size for each class it meets, two at most; before, up to 0.73 of it."""
    rng = np.random.default_rng(7)
    for n in (60, 333, 1000, 4100, 20000):
        u = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert len(jaccard.range_keys(u, 80, 100)) <= 2 * (n // 4 + 1)
        assert len(jaccard.range_keys(u, 90, 100)) <= 2 * (n // 9 + 1)


def test_linked_sets_meet_though_all_they_differ_in_lies_in_the_first_ranges():
    rng = np.random.default_rng(8)
    for n in (40, 64, 95, 300, 1000, 5000):
        pool = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        n = len(pool)
        for p in (80, 90):
            most = n * (100 - p) // 100
            # One shingle after another goes from the first ranges of one set, or of both in turn.
            gone = np.linspace(0, n // 2, most, dtype=np.int64)
            for a, b in ((pool, np.delete(pool, gone)), (np.delete(pool, gone[::2]), np.delete(pool, gone[1::2]))):
                assert keys(a, p) & keys(b, p)
