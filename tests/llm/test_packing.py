import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftline.llm.packing import _knapsack, default_tokenizer, fractional, pack_documents, plan_packing, tokenizer

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def encode():
    found = tokenizers.Tokenizer.from_file(default_tokenizer())
    return lambda text: [*found.encode(text or "", add_special_tokens=False).ids, 0]


def pieces(rows, encode, size=2048):
    out = []
    for doc, text in rows:
        ids = encode(text)
        first = len(ids) % size or size
        bounds = [0, *range(first, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            out.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=repr)


def test_pieces_and_places(documents, odd_rows, random_prose, encode):
    rows = odd_rows + [(1000 + k, random_prose(k, 50 + 13 * k)) for k in range(80)] + [(2000, "a <|endoftext|> b<|endoftext|><|endoftext|>\n <|endoftext"), (2001, " " * 100_000)]
    found = pack_documents(documents(rows)).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == pieces(rows, encode)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    bound = -(-sum(r.length for r in found) // 2048)
    assert len(sequences) <= 1.02 * bound + 1


def test_small_sequences_and_empty_tables(documents, odd_rows, encode):
    found = pack_documents(documents(odd_rows), size=16).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == pieces(odd_rows, encode, 16)
    assert pack_documents(documents([])).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plans_have_a_place_for_every_piece(seed):
    pick = np.random.default_rng(seed)
    lengths = np.clip(pick.lognormal(6, 1, 3000), 1, 2048).astype(int)
    counts = Counter(lengths.tolist())
    plan = plan_packing(counts)
    placed = Counter()
    for config, times in plan:
        assert times > 0 and sum(config) <= 2048
        for n in config:
            placed[n] += times
    assert placed == counts
    assert sum(times for _, times in plan) <= 1.005 * -(-lengths.sum() // 2048) + 1


def test_fractional_solution_uses_no_more_than_there_is():
    counts = np.zeros(2049)
    counts[[700, 650, 1300, 100]] = [50, 40, 30, 7]
    used = Counter()
    for config, times in fractional(counts).items():
        assert sum(config) <= 2048
        for n in config:
            used[n] += times
    assert all(used[n] <= counts[n] + 1e-6 for n in used)
    assert plan_packing({}) == [] and plan_packing({2048: 3}) == [((2048,), 3)]


def test_knapsack_equals_brute_force():
    pick = np.random.default_rng(0)
    prices = np.zeros(31)
    prices[[3, 7, 8, 13]] = pick.random(4)
    last = _knapsack(prices, 30)
    best = [0.0]
    for room in range(1, 31):
        best.append(max([best[room - 1], *(best[room - n] + prices[n] for n in (3, 7, 8, 13) if n <= room)]))
    for room in range(1, 31):
        if last[room]:
            assert best[room] == pytest.approx(best[room - last[room]] + prices[last[room]])
        else:
            assert best[room] == best[room - 1]


def test_quick_tokenizer_equals_the_file(random_prose, encode):
    for text in (random_prose(1, 200), "", "漢字 é\n\n  x", "it's  1234 <|endoftext|> don't", "\x00\u2028 \u00a0tab\t"):
        assert tokenizer(default_tokenizer())(text).tolist() == encode(text)[:-1]
