"""Hashes of spans: equal for equal bytes, different for the texts that defeat polynomials modulo 2^64."""

import random

import numpy as np
import pyarrow as pa

from scanloom.llm import quality_rules, textblock


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_two_letter_texts_do_not_collide():
    for n in (512, 1024, 4096, 65536):
        one, two = thue_morse(n, "ab"), thue_morse(n, "ba")
        data = np.frombuffer((one + two).encode(), np.uint8)
        h = textblock.hash_spans(data, np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1]
    text = thue_morse(4096, "ab") + "\n" + thue_morse(4096, "ba")
    counts, *_ = quality_rules.measure(textblock.texts_of(pa.array([text])))
    assert counts["n_dup_lines"].tolist() == [0]


def test_hashes_follow_the_bytes_alone():
    rng = random.Random(4)
    parts = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 9))).encode() for _ in range(4000)] + [b"x" * 3_000_000, b"x" * 2_999_999, b"", b"a"]
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.append(0, ends[:-1])
    seen: dict[bytes, int] = {}
    for block in (50, 1 << 20):
        for p, h in zip(parts, textblock.hash_spans(data, starts, ends, block).tolist(), strict=True):
            assert seen.setdefault(p, h) == h
    assert len(set(seen.values())) == len(seen)
