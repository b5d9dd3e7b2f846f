import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from flowlens.llm.sharding import balanced_shards, minimax_cuts, sized_rows


def smallest_capacity(sizes, shards):
    """Plain search over ordered sizes."""

    def fits(capacity):
        used, room = 1, capacity
        for size in sizes:
            if size > capacity:
                return False
            if size > room:
                used, room = used + 1, capacity
            room -= size
        return used <= shards

    capacity = max([-(-sum(sizes) // shards), *sizes])
    while not fits(capacity):
        capacity += 1
    return capacity


def groups(rows):
    found = defaultdict(int)
    for _, text in rows:
        raw = (text or "").encode()
        found[int(hashlib.sha256(raw).hexdigest()[:15], 16)] += len(raw) + 1
    return found


@pytest.mark.parametrize("n,shards,seed", [(1, 4, 0), (7, 3, 1), (300, 5, 2), (300, 16, 3)])
def test_capacity_is_the_smallest(documents, n, shards, seed):
    dice = random.Random(seed)
    rows = [(i, "t" * dice.choice([1, 5, 40, dice.randrange(400)]) + str(i % (n - n // 4 or 1))) for i in range(n)]
    found = groups(rows)
    sizes = [found[k] for k in sorted(found)]
    cuts, capacity = minimax_cuts(sized_rows(documents(*rows)), shards)
    assert capacity == smallest_capacity(sizes, shards)
    loads = [0] * shards
    for k in found:
        loads[sum(k >= c for c in cuts)] += found[k]
    assert max(loads) == capacity and cuts == sorted(cuts)


ROWS = [(i, f"text number {i % 40} " * (1 + i % 7)) for i in range(400)] + [(None, None), (3, ""), (3, ""), (500, "é" * 9)]


@pytest.mark.parametrize("rows", [ROWS, ROWS + [(1000 + i, "the hot text " * 20) for i in range(300)]])
def test_rows_and_slots(documents, rows):
    got = balanced_shards(documents(*rows), 16).collect()
    assert len(got) == len(rows)
    sizes = sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got)
    assert sizes == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = defaultdict(set)
    for r in got:
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in homes.values())
    # every shard but the hot group's is within the largest group of its fair share
    loads = defaultdict(int)
    for r in got:
        loads[r["shard"]] += r["size"]
    largest = max(groups(rows).values())
    assert max(loads.values()) <= max(largest, sum(loads.values()) / 16 + max(s for s in groups(ROWS).values()))


def test_empty_table(documents):
    assert balanced_shards(documents().limit(0)).count() == 0
