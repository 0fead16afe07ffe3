"""A training round's spoilt pairs against a plain version that draws the same chances."""

from __future__ import annotations

import pytest

from talkframe.operators import datasets as ds
from talkframe.plans import QUERIES


class Chance:
    """Spark's hash of a seed, a row (id, variant, round) and more whole numbers."""

    def __init__(self, key: int, variant: int, number: int) -> None:
        self.xxhash = pytest.importorskip("xxhash")
        self.row = (key.to_bytes(8, "little", signed=True), variant.to_bytes(4, "little"), number.to_bytes(4, "little"))

    def draw(self, seed: int, *more: int) -> int:
        h = 42
        for part in (seed.to_bytes(4, "little"), *self.row, *(m.to_bytes(4, "little") for m in more)):
            h = self.xxhash.xxh64_intdigest(part, h)
        return h - (1 << 64) if h >> 63 else h

    def uniform(self, seed: int, *more: int) -> float:
        return self.draw(seed, *more) % (1 << 52) / (1 << 52)

    def below(self, n: int, seed: int, *more: int) -> int:
        return self.draw(seed, *more) % n


def spoilt(text: str, chance: Chance, seed: int, stop: float, capital: float, fillers: tuple, least: int, most: int) -> str:
    text = "".join(c for i, c in enumerate(text) if not (c in ".,;:!?" and chance.uniform(seed, i) < stop))
    text = "".join(c.lower() if chance.uniform(seed + 1, i) < (capital if i == 0 else 0.4 * capital) else c for i, c in enumerate(text))
    said, seed = text.split(), seed + 2
    if len(said) >= 3:
        room = max(1, len(said) - 1)
        low, high = min(least, room), min(most, room)
        for k in range(low + chance.below(high - low + 1, seed)):
            at = 0 if k == 0 and chance.uniform(seed + 1) < 0.5 else 1 + chance.below(len(said) - 1, seed + 2, k)
            said.insert(at, fillers[chance.below(len(fillers), seed + 3, k)])
    return " ".join(" ".join(said).split())


def test_round_as_drawn_by_hand(spark, small, duck):
    rules, want, seen = ds.ROUNDS[4], [], set()
    for key, text in duck.execute("SELECT item_id, text FROM benchmark ORDER BY item_id").fetchall():
        for variant in range(rules.versions):
            said = spoilt(text, Chance(key, variant, 5), 42, rules.stop, rules.capital, ds.FILLERS["medium"], 1, 3)
            if said != text and said not in seen:
                seen.add(said)
                want.append((key, text, variant, said))
    got = [(r["id"], r["output"], r["variant"], r["input"]) for r in QUERIES["corrupt_round"](spark, small).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
