"""Edits and packing on inputs that used to take quadratic time."""

import random
import re
import time

import pytest

from sieveline.llm import edit_counts, kk_pack

_PATTERN = re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]")


def test_mail_addresses_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["a@b.c", "a@b.c@d.e", "a@b.c_x@d.e", "a@b.c.-@d.ef", "@@a@b.co", "x@y", "x@y.", "x@-.z-", "a.b+c@d-e.f.g..", "é@b.c", ""]
    texts += ["".join(rng.choices("ab.@-_+ é", k=rng.randrange(1, 30))) for _ in range(4000)]
    for text in texts:
        assert edit_counts.mail_addresses(text) == [m.span() for m in _PATTERN.finditer(text)], text


@pytest.mark.parametrize("text", ["x" * 1_000_000 + " a@b.co", "a@b.co " + "y" * 1_000_000, "@" * 1_000_000, "a@" + "b" * 1_000_000, "a@b." + ".-" * 500_000, "a@b.c" * 200_000])
def test_long_runs_take_linear_time(text):
    began = time.perf_counter()
    edit_counts.redactions(text)
    assert time.perf_counter() - began < 2


def test_a_group_of_large_tails_packs_at_once():
    rng = random.Random(2)
    sizes = [rng.randrange(1000, 2048) for _ in range(512)]
    began = time.perf_counter()
    windows = kk_pack.pack_group(sizes, 2048)
    assert time.perf_counter() - began < 1
    assert sorted(i for w in windows for i in w) == list(range(512)) and all(sum(sizes[i] for i in w) <= 2048 for w in windows)


def test_the_first_count_is_a_bound():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 14))]
        n = max(1, -(-sum(sizes) // 20))
        while any(sum(sizes[i] for i in w) > 20 for w in kk_pack.difference(sizes, n)):
            n += 1
        assert len(kk_pack.pack_group(sizes, 20)) == len([w for w in kk_pack.difference(sizes, max(n, sum(2 * s > 20 for s in sizes))) if w])
