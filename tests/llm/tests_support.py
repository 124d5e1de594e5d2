"""Helpers of the tests in this folder."""

import re

SF_DIR = "/root/testdata/sf0.001"


def soup(rng, n, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
