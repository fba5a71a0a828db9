"""Very long texts for personal data, and crowded cores for repeated strings."""

import random
import re
import time

import pytest

from jetloom.llm import repeats, semimarkov


def test_long_runs_of_digits_neither_fail_nor_take_quadratic_time():
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choices("0129. .", k=rng.randint(0, 40)))
        assert [m.span() for m in plain.finditer(text)] == [m.span() for m in semimarkov.IP.finditer(text)]
    assert semimarkov.base_spans("1.2.3." + "0" * 5000) == [("ip", 0, 5006)]
    assert semimarkov.base_spans("1.2.3." + "9" * 5000) == []
    start = time.time()
    for text in ("7" * 1_000_000, "0" * 1_000_000, "1." * 3 + "0" * 1_000_000, "a@" * 20_000, "+1 " * 50_000):
        semimarkov.base_spans(text)
    assert time.time() - start < 10
    semimarkov.span_features("1.2.3." + "9" * 5000, 0, 5006)


def test_taken_stretches():
    rng = random.Random(1)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 9)) for a in rng.choices(range(40), k=rng.randint(0, 6))]
        taken = semimarkov._Taken(spans)
        a = rng.randrange(45)
        b = a + rng.randint(1, 5)
        assert taken.covers(a, b) == any(x <= a and b <= y for x, y in spans)
        assert taken.meets(a, b) == any(x < b and y > a for x, y in spans)


class Pairs:
    """Stands for a field: every ``<...>`` it can see is a span, and so is an unclosed one at the end."""

    def decode(self, zone):
        return [(0, m.start(), m.end()) for m in re.finditer("<[^<>]*>?", zone.text)]


@pytest.mark.parametrize("seed", range(5))
def test_windows_find_whole_spans_once(seed, monkeypatch):
    monkeypatch.setattr(semimarkov, "WINDOW", 48)
    monkeypatch.setattr(semimarkov, "STEP", 40)
    rng = random.Random(seed)
    text = "".join(rng.choice([".", "..", "<" + "1" * rng.randint(0, 12) + ">"]) for _ in range(300))
    got = [(a, b) for _, a, b in semimarkov.decoded(text, Pairs())]
    assert got == [m.span() for m in re.finditer("<[^<>]*>", text)]


def test_numbers_of_single_digits_are_seen():
    seen = []

    class Noted(Pairs):
        def decode(self, zone):
            seen.append(zone.text)
            return []

    semimarkov.all_spans("call 5-5-5-0-1-4-2-2-9 or mail a@b.org", Noted())
    assert any("5-5-5-0-1-4-2-2-9" in zone for zone in seen)


def brute_starts(lefts, rights, core, length):
    whole = [(left, right) for left, right in zip(lefts, rights)]
    out = []
    for k, (left, right) in enumerate(whole):
        starts = []
        for l in range(max(0, length - core - len(right)), min(len(left), length - core) + 1):
            r = length - core - l
            own = left[len(left) - l :], right[:r]
            if any(j != k and (b[0][len(b[0]) - l :] if len(b[0]) >= l else None, b[1][:r] if len(b[1]) >= r else None) == own for j, b in enumerate(whole)):
                starts.append(l)
        out.append((max(starts), min(starts)) if starts else None)
    return out


@pytest.mark.parametrize("symbols", [10, 60, 10**9])
def test_groups_taken_apart_in_their_task(symbols, monkeypatch):
    monkeypatch.setattr(repeats, "SYMBOLS", symbols)
    monkeypatch.setattr(repeats, "WAYS", 3)
    plan = repeats.RepeatPlan(24)
    rng = random.Random(symbols)
    for _ in range(25):
        lefts = [bytes(rng.choices(b"ab", [8, 1], k=rng.choice([12, 12, 12, 5]))) for _ in range(30)]
        rights = [bytes(rng.choices(b"ab", [8, 1], k=rng.choice([12, 12, 12, 7]))) for _ in range(30)]
        found = {}
        for m, far, near in repeats.solved_group(plan, 0, plan.reach, lefts, rights, list(range(30))):
            old = found.get(m, (far, near))
            found[m] = max(far, old[0]), min(near, old[1])
        want = brute_starts(lefts, rights, plan.core, plan.length)
        assert [found.get(m) for m in range(30)] == want


def test_crowded_core_is_bounded():
    """Twenty thousand contexts of one core: no suffix array gets more than its symbols."""
    rng = random.Random(9)
    plan = repeats.RepeatPlan(400)
    base = [bytes(rng.choices(b"abcd", k=200)) for _ in range(2)]
    lefts, rights = [], []
    for _ in range(20_000):
        left, right = bytearray(base[0]), bytearray(base[1])
        left[rng.randrange(200)] = right[rng.randrange(200)] = 120 + rng.randrange(2)
        lefts.append(bytes(left))
        rights.append(bytes(right))
    sizes = []
    array = repeats.suffix_array
    repeats.suffix_array = lambda symbols: sizes.append(len(symbols)) or array(symbols)
    try:
        start = time.time()
        rows = repeats.solved_group(plan, 0, plan.reach, lefts, rights, list(range(20_000)))
    finally:
        repeats.suffix_array = array
    print(len(sizes), max(sizes, default=0), time.time() - start)
    assert rows and max(sizes, default=0) <= repeats.SYMBOLS
