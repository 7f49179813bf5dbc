import random
import zlib

from larkspan.llm.sharding import RoomTree, best_fit, pack_units, shard_by_bytes


def test_tree_finds_the_tightest_bin():
    rng = random.Random(2)
    tree, plain = RoomTree(), []
    for k in range(2000):
        if rng.random() < 0.6:
            item = (rng.randint(0, 50), k)
            tree.add(item)
            plain.append(item)
        else:
            size = rng.randint(0, 60)
            want = min((x for x in plain if x[0] >= size), default=None)
            assert tree.take_tightest(size) == want
            if want:
                plain.remove(want)
    assert tree._height(tree.root) <= 16


def test_packing():
    assert best_fit([5, 4, 3, 2], 7, 2) == [0, 1, 1, 0] and best_fit([5, 5, 5], 7, 2) is None
    sizes = sorted((random.Random(3).randint(1, 900) for _ in range(3000)), reverse=True)
    placed = pack_units(sizes, 24)
    loads = [sum(s for s, b in zip(sizes, placed, strict=True) if b == k) for k in range(24)]
    assert max(loads) - min(loads) < 0.01 * max(loads)
    assert pack_units([], 24) == []


def test_shards(documents):
    rng = random.Random(4)
    texts = ["x" * rng.randint(0, 300) + str(k % 90) for k in range(400)] + ["hot copy"] * 200 + [None, "", "é" * 2000]
    data = list(enumerate(texts)) + [(None, "n"), (5, texts[5])]
    rows = shard_by_bytes(documents(data), shards=6, grain=8).collect()
    assert len(rows) == len(data)
    by_id = dict(data)
    homes = {}
    for r in rows:
        text = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
        assert homes.setdefault(text, r.shard) == r.shard
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    loads = [sum(r.size for r in rows if r.shard == k) for k in range(6)]
    assert max(loads) <= 1.1 * sum(loads) / 6
    assert shard_by_bytes(documents([])).count() == 0
