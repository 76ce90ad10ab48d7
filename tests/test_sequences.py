"""Parsers, codes, summaries and indexes of one sequence."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phrasemill.functions import numbers
from phrasemill.operators import codec, parsers, succinct
from phrasemill.operators.parsers import PARSERS, StaticTrie, decode_lzend
from phrasemill.operators.suffix_index import RangeMin, RankIndex, count_occurrences, extension, lcp_array, runs, suffix_array
from phrasemill.operators.summaries import Attractor, CountMin, Counters, MinBuckets, PrefixSummary, SketchStrings, StringSummary

HARD = [b"", b"a", b"a" * 300, bytes(range(256)), b"$\0$\0" * 9, "日本語é".encode() * 7, b"abcab" * 40]
SMALL = {"topk_lz78": {"k": 5, "max_freq": 8}, "topk_lz77": {"k": 5, "window": 7, "max_freq": 8}, "blockwise_lz77": {"window": 7}, "lzend_blockwise": {"window": 7}, "twopass": {"k": 6}, "topk_lzend": {"k": 5}, "topk_sel": {"k": 5}, "topk_weiner": {"k": 9}, "topk_weiner_fast": {"k": 9}}
texts = st.binary(max_size=200) | st.text(alphabet="ab", max_size=200).map(str.encode)


@pytest.mark.parametrize("algo", sorted(PARSERS))
def test_round_trip(algo):
    parser = PARSERS[algo]
    if parser.decode is None:
        return

    @settings(max_examples=60, deadline=None)
    @given(texts)
    def check(data):
        for options in ({}, SMALL.get(algo, {})):
            assert parser.decode(parser.encode(data, **options), **options) == data

    check()
    for data in HARD:
        assert parser.decode(parser.encode(data), ) == data


@pytest.mark.parametrize("algo", ["lz78", "lz77", "lzend", "topk_lz78", "topk_lz77", "attract"])
def test_phrases_cover(algo):
    for data in HARD:
        assert sum(p[3] for p in PARSERS[algo].encode(data)) == len(data)


def test_bounded_lz78_equals_lz78_when_nothing_is_evicted():
    data = bytes(random.Random(7).choice(b"abc") for _ in range(2000))
    strings = lambda algo, **o: [p[3] for p in PARSERS[algo].encode(data, **o)]
    assert strings("topk_lz78", k=5000, max_freq=1 << 20) == strings("lz78")


def test_lzend_example():
    phrases = [("end", -1, -1, 1, 97), ("end", -1, -1, 1, 98), ("end", 0, -1, 2, 98), ("end", 1, -1, 3, 98), ("end", 1, -1, 2, 97), ("end", 4, -1, 7, 97)]
    assert decode_lzend(phrases)[::-1] == b"aabbbababbbababa"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=300))
def test_codes(values):
    assert codec.rans_decode(codec.rans_encode(values)) == values
    assert codec.decode_adaptive(codec.encode_adaptive(values)) == values
    tokens = [(i % 2, v) for i, v in enumerate(values)]
    coders = {0: "binary", 1: "huffman"}
    data, stats = codec.encode_block(tokens, coders)
    assert codec.decode_block(data, coders, lambda done: len(done) % 2) == tokens
    assert sum(n for n, _, _ in stats.values()) == len(values)


def test_trie_code_and_lookups():
    trie = StaticTrie([b"abc", b"abd", b"b", b"ba"])
    assert codec.decode_trie(*codec.encode_trie(trie.parent, trie.label)) == (trie.parent, trie.label)
    assert trie.spell(trie.longest(b"abdx", 0)[0]) == b"abd"
    assert codec.read_uint(codec.write_uint(123456, 5), 5) == 123456


@settings(max_examples=60, deadline=None)
@given(texts)
def test_suffix_index(data):
    order = suffix_array(data).tolist()
    assert order == sorted(range(len(data)), key=lambda i: data[i:])
    lcp = lcp_array(data, suffix_array(data))
    for a, b, n in zip(order, order[1:], lcp[1:], strict=False):
        assert n == extension(data, a, b)
    if data:
        pattern = data[len(data) // 2 :][:2]
        assert count_occurrences(data, pattern) == sum(data[i : i + len(pattern)] == pattern for i in range(len(data)))


def test_rank_and_range_minimum():
    data = b"in the\0beginning\0the end"
    index = RankIndex(data)
    for c in range(256):
        for i in range(len(data)):
            assert index.rank(c, i) == data[: i + 1].count(c)
    table = RangeMin(list(data))
    for i in range(len(data)):
        for j in range(i, len(data)):
            assert table.query(i, j) == min(range(i, j + 1), key=lambda p: (data[p], p))


def test_runs_by_brute_force():
    for data in (b"aabaabaaab", b"abababab", b"mississippi", b"aaaa"):
        wanted = set()
        for start in range(len(data)):
            for period in range(1, (len(data) - start) // 2 + 1):
                end = start + period
                while end < len(data) and data[end] == data[end - period]:
                    end += 1
                maximal = start == 0 or data[start - 1] != data[start - 1 + period]
                if end - start >= 2 * period and maximal and not any((start, p, end - start) in wanted for p in range(1, period)):
                    wanted.add((start, period, end - start))
        assert set(runs(data)) == wanted


def test_numbers():
    for x in range(257):
        for y in range(x):
            i = numbers.top_different_bit(x, y)
            assert numbers.keep_top(x, i) > y >= numbers.keep_top(x, i + 1)
    prints = numbers.PrefixPrints(b"abaaababaaab", 256)
    assert prints.of(0, 3) == prints.of(4, 7) == prints.of(6, 9) != prints.of(1, 4)
    assert numbers.parse_size("2Ki") == 2048 and numbers.parse_size("3M") == 3_000_000
    v, seen = 0b00111, 0
    while v < 32:
        v, seen = numbers.next_permutation(v), seen + 1
    assert seen == 10
    base = 65497
    window, power = b"abcd", numbers.power61(base, 4)
    fp = numbers.PrefixPrints(window, base).of(0, 4)
    assert numbers.roll(fp, base, power, ord("a"), ord("e")) == numbers.PrefixPrints(b"bcde", base).of(0, 4)


def test_summaries_keep_their_bounds():
    draw = random.Random(3)
    items = [int(draw.paretovariate(1)) for _ in range(20_000)]
    true = Counter(items)
    top = StringSummary(50)
    for x in items:
        top.insert(x)
    assert all(true[i] - len(items) / 51 <= n <= true[i] for i, n in top.report())
    exact = StringSummary(len(true))
    for x in items:
        exact.insert(x)
    assert dict(exact.report()) == true
    for conservative in (False, True):
        sketch = CountMin(2, 256, conservative)
        for x in items:
            sketch.increment(x)
        assert all(sketch.estimate(x) >= n for x, n in true.items())
    filtered = SketchStrings(20, 2, 1 << 12)
    for x in items:
        filtered.insert(x)
    assert {i for i, _ in true.most_common(5)} <= {i for i, _ in filtered.report()}


def test_counters_age_and_empty_out():
    called = []
    counters = Counters(4, 9, lambda: called.append(1))
    for v in range(4):
        counters.reset(v)
        counters.link(v)
    for _ in range(20):
        counters.increment(0)
    assert counters.count(0) == 8
    counters.decrement(0)
    assert counters.count(0) == 7
    for _ in range(4):
        counters.decrement_all()
    assert called and counters.threshold == 0
    assert sum(counters.population().values()) == 4
    assert [counters.extract_min() for _ in range(4)][-1] == 0 and counters.extract_min() is None


def test_prefix_summary_is_closed_under_prefixes():
    draw = random.Random(1)
    top = PrefixSummary(20, 16)
    state = top.EMPTY
    for _ in range(5000):
        state = top.extend(state, draw.choice(b"abc"))
        state = state if state[2] else top.EMPTY
    strings = {s for s, _ in top.strings()}
    assert strings and all(s[:-1] in strings or len(s) == 1 for s in strings)
    queue = MinBuckets()
    for i, n in enumerate((3, 1, 2)):
        queue.insert(i, n)
    queue.increase_key(1)
    assert queue.min_frequency() == 2 and queue.extract_min() in (1, 2)
    attractor = Attractor(30)
    place, length = attractor.match(b"abc", 0)
    attractor.update(place, length, ord("a"))
    assert attractor.chars.count(b"a") == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=300), st.binary(min_size=1, max_size=120), st.lists(st.integers(0, 5000), max_size=60))
def test_succinct(bits, data, values):
    plain, classes = succinct.BitRank(bits), succinct.ClassVector(bits)
    for i in range(len(bits)):
        assert plain.rank1(i) == classes.rank1(i) == sum(bits[: i + 1]) and plain.rank0(i) == i + 1 - plain.rank1(i)
        assert plain.access(i) == classes.access(i) == bits[i]
    assert plain.between(0, len(bits) - 1) == sum(bits)
    tree = succinct.WaveletTree(data)
    for c in set(data) | {0, 255}:
        assert [tree.rank(c, i) for i in range(len(data))] == [data[: i + 1].count(c) for i in range(len(data))]
    values = sorted(values)
    packed = succinct.EliasFano(values)
    assert [packed.access(i) for i in range(len(values))] == values
    assert packed.predecessor(2500) == sum(v <= 2500 for v in values) - 1


def test_online_lzend_is_the_greedy_one():
    draw = random.Random(1)
    texts = [b"", b"a", b"abababbababba" * 7, bytes(draw.choice(b"ab") for _ in range(700)), bytes(draw.choice(b"abcd ") for _ in range(1500))]
    for data in texts:
        wanted = [p[3] for p in parsers.encode_lzend(data)]
        for local in (False, True):
            assert [p[3] for p in parsers.encode_lzend_kk(data, prefer_local=local)] == wanted
            for window in (5, 64, 300):
                phrases = parsers.encode_lzend_kk(data, window, local)
                assert parsers.decode_lzend(phrases) == data and all(p[3] <= window for p in phrases)
    near, far = (parsers.encode_lzend_kk(texts[3], 64, local) for local in (True, False))
    assert near != far and sum(p[1] for p in near) > sum(p[1] for p in far)


def test_the_worked_example_of_lzend():
    phrases = [(1, 0, 1, "a"), (2, 0, 1, "b"), (3, 1, 2, "b"), (4, 2, 3, "b"), (5, 2, 2, "a"), (6, 5, 7, "a")]
    data = parsers.decode_lzend([("end", link - 1, -1, size, ord(last)) for _, link, size, last in phrases])
    ends = [sum(p[2] for p in phrases[: i + 1]) for i in range(6)]
    assert [data[:e][::-1].decode() for e in ends] == ["a", "ba", "baba", "bbababa", "abbbababa", "aabbbababbbababa"]


def test_longer_references_win():
    data = b"abcdefgh" * 12
    found = parsers.encode_psample(data, 2, 4, 64, sample_rsh=4)
    assert parsers.decode_copies(found) == data and max(p[3] for p in found) == 16
    assert parsers.read_escaped(parsers.write_escaped(found)) == found
    assert parsers.write_escaped([parsers.literal(ord("$"))]) == b"$\0\0\0\0"


def test_topk_lzend_has_no_longest_match():
    unit = bytes(random.Random(4).choice(b"abcdefgh") for _ in range(500))
    assert max(p[3] for p in parsers.encode_topk_lzend(unit * 4)) > 400


@pytest.mark.parametrize("k", [6, 20, 100, 3000])
def test_weiner_links(k):
    """Suffix links lead to the string without its first byte wherever that is a node, Weiner links back."""
    draw, known = random.Random(1), parsers.ReversedWindows(k, 16)
    data = bytes(draw.choice(b"abc ") for _ in range(400))
    for at in range(len(data)):
        known.feed(data, at, 5, True)
        spelled = {v: known.top.spell(v) for v in known.top.child.values()}
        node = {s: v for v, s in spelled.items()} | {b"": 0}
        assert known.suffix == {v: node[s[1:]] for v, s in spelled.items() if s[1:] in node}
        assert {(u, c): v for u, own in known.links.items() for c, v in own.items()} == {(u, spelled[v][0]): v for v, u in known.suffix.items()}
        assert all(data[e - len(spelled[v]) + 1 : e + 1][::-1] == spelled[v] for v, e in known.ended.items())
