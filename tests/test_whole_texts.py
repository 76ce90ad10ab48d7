"""The queries over whole items against plain programs."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from phrasemill.operators import container
from phrasemill.operators.parsers import PARSERS
from phrasemill.plans import catalog

TEXTS = {
    1: "the cat and the hat ran on; " * 4 + "then another man sat there, than the hand began: abcabcabcabcabcx" + "the cat and the hat" * 3,
    2: "Größe und Maß, über die Brücke, " * 3 + "und dann noch ein Stück Straße weiter, weiter, weiter in die Höhe und an",
    3: "abc",
    4: "x" * 130 + "the end, and an end",
}
DATA = {k: t.encode() for k, t in TEXTS.items()}
PRIME = (1 << 61) - 1


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    pq.write_table(pa.table({"item_id": pa.array(list(TEXTS), pa.int64()), "text": list(TEXTS.values())}), path / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": [TEXTS[1], "an end of the hand " * 5]}), path / "documents.parquet")
    return str(path)


def each(f):
    """The rows that f gives for every item."""
    return [(k, *r) for k, x in DATA.items() for r in f(x)]


def prints(x, base=65497):
    out = []
    for i in range(len(x) - 7):
        h = 0
        for c in x[i : i + 8]:
            h = (h * base + c) % PRIME
        out.append(h)
    return out


def order(x):
    return sorted(range(len(x)), key=lambda i: x[i:])


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def count(x, pattern):
    return sum(x.startswith(pattern, i) for i in range(len(x)))


def dictionary():
    out = {}
    for size in (1, 2, 3, 4):
        grams = Counter(d[i : i + size] for d in (DATA[1], b"an end of the hand " * 5) for i in range(len(d) - size + 1))
        out |= dict(sorted(grams.items(), key=lambda g: (-g[1], g[0]))[:200])
    return out


def references(x):
    last, out = {}, [0, 0]
    for i in range(len(x) - 3):
        g = x[i : i + 4]
        if g in last:
            out[i - last[g] < 16] += 1
        last[g] = i
    return [tuple(out)] if any(out) else []


def repeats(x):
    found = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            n = common(x[i:], x[i + p :])
            if n >= p:
                found.setdefault((i, n + p), p)
            i += n + 1
    return [(s, p, n) for (s, n), p in found.items()]


def nearest(x):
    sa = order(x)
    rank = {p: r for r, p in enumerate(sa)}
    return [(p, next((q for q in reversed(sa[: rank[p]]) if q < p), -1), next((q for q in sa[rank[p] + 1 :] if q < p), -1)) for p in range(len(x))]


def matches(x):
    own = dictionary()
    best = {i: max((s for s in (1, 2, 3, 4) if x[i : i + s] in own and i + s <= len(x)), default=0) for i in range(len(x))}
    return [(i, d) for i, d in best.items() if d]


def fold(x):
    h = 0
    for c in x:
        h = (h * 256 + c) % PRIME
    return h


def lz77(x):
    """Greedy: the longest string of two bytes or more that starts earlier, or one byte: lengths."""
    i, out = 0, []
    while i < len(x):
        n = max(common(x[j:], x[i:]) for j in range(i)) if i else 0
        out.append(n if n > 1 else 1)
        i += out[-1]
    return out


def lz78(x):
    """The longest phrase so far and one byte more: (number, place, number of that phrase, length, byte)."""
    own, i, out = [b""], 0, []
    while i < len(x):
        ref = max((w for w in own if x.startswith(w, i)), key=len)
        phrase = x[i : i + len(ref) + 1]
        out.append((len(out), i, own.index(ref), len(phrase), x[i + len(ref)] if i + len(ref) < len(x) else -1))
        own.append(phrase)
        i += len(phrase)
    return out


def lzend(x):
    """The longest string that ends where a phrase ended, and a byte: lengths."""
    i, ends, out = 0, [], []
    while i < len(x):
        n = max((n for n in range(1, len(x) - i) if any(e >= n and x[e - n : e] == x[i : i + n] for e in ends)), default=0)
        i += n + 1
        ends.append(i)
        out.append(n + 1)
    return out


def counted(parse):
    return lambda x: [(len(parse(x)), len(x))]


def covering(x):
    return [(p, k, at, n) for p in range(0, len(x), 10) for k, at, _, n, _ in lz78(x) if at <= p < at + n]


def tokens(x):
    """(block, type, value) of the LZ78 phrases."""
    return [(k // 64, *t) for k, _, ref, _, lit in lz78(x) for t in (("ref", ref), ("literal", lit)) if t[1] >= 0]


def token_stats(x):
    groups = {}
    for block, kind, value in tokens(x):
        groups.setdefault((block, kind), []).append(value)
    width = lambda v: (max(v) - min(v)).bit_length()
    return [(*g, len(v), min(v), max(v), sum(v), sum(a * a for a in v), width(v), width(v) * len(v)) for g, v in groups.items()]


def huffman(x):
    """Bits by merging the two rarest again and again."""
    own, bits = sorted(Counter(x).values()), 0
    if len(own) == 1:
        return [(own[0],)]
    while len(own) > 1:
        a, b, *rest = own
        bits += a + b
        own = sorted([*rest, a + b])
    return [(bits,)]


def united(x):
    third = len(x) // 3
    last = [(s + third, p, n) for s, p, n in repeats(x[third:])]
    return list(dict.fromkeys([*repeats(x[: len(x) - third]), *last]))


WANTED = {
    "rank_prefix": ("pos rank_e rank_own", lambda x: [(i, x[: i + 1].count(b"e"), x[: i + 1].count(x[i : i + 1])) for i in range(len(x))]),
    "range_rank": ("pos in_range", lambda x: [(i, x[max(0, i - 15) : i + 1].count(b"e")) for i in range(len(x))]),
    "range_min": ("pos least at", lambda x: [(i, *min((x[j], j) for j in range(max(0, i - 15), i + 1))) for i in range(len(x))]),
    "kr_fingerprints": ("pos fp", lambda x: list(enumerate(prints(x)))),
    "sampled_grams": ("pos fp", lambda x: [(i, f) for i, f in enumerate(prints(x)) if f % 4 == 0]),
    "minimizers": ("pos fp", lambda x: [(i, f) for i, f in enumerate(prints(x)) if f == min(prints(x)[max(0, i - 7) : i + 1])]),
    "suffix_ranks": ("pos rank", lambda x: [(p, r) for r, p in enumerate(order(x))]),
    "lcp": ("rank lcp", lambda x: [(r, common(x[p:], x[order(x)[r - 1] :]) if r else 0) for r, p in enumerate(order(x))]),
    "bwt": ("rank byte", lambda x: [(r, x[p - 1] if p else -1) for r, p in enumerate(order(x))]),
    "backward_search": ("pattern n", lambda x: [(p, count(x, p.encode())) for p in ("th", "an")]),
    "printable_bytes": ("pos shown", lambda x: [(i, f"'{chr(c)}'" if 32 <= c <= 126 else f"0x{c:02X}") for i, c in enumerate(x)]),
    "reversed_bytes": ("reversed", lambda x: [(x[::-1].hex().upper() + "00",)]),
    "alphabet_remap": ("pos symbol", lambda x: [(i, sorted(set(x)).index(c)) for i, c in enumerate(x)]),
    "fingerprint_append": ("whole joined", lambda x: [(fold(x), fold(x))]),
    "lce_pairs": ("i lce", lambda x: [(i, common(x[i:], x[i + 7 :])) for i in range(len(x) - 7)]),
    "reference_filters": ("kept filtered", references),
    "dictionary_probe": ("pos s freq", lambda x: [(i, x[i : i + 4].hex().upper(), dictionary()[x[i : i + 4]]) for i in range(len(x) - 3) if x[i : i + 4] in dictionary()]),
    "longest_match": ("pos depth", matches),
    "lz77_counts": ("z n", counted(lz77)),
    "lz78_counts": ("z n", counted(lz78)),
    "topk_lz78_counts": ("z n", counted(lz78)),
    "lzend_counts": ("z n", counted(lzend)),
    "phrase_statistics": ("n_phrases n_refs n_literals longest total_len", lambda x: [(len(lz77(x)), sum(n > 1 for n in lz77(x)), sum(n < 2 for n in lz77(x)), max(lz77(x)), len(x))]),
    "phrase_of_position": ("pos phrase_no start len", covering),
    "item_token_bits": ("block type n lo hi total squares width bits", token_stats),
    "item_token_histogram": ("type width n", lambda x: [(*k, n) for k, n in Counter((t, v.bit_length()) for _, t, v in tokens(x)).items()]),
    "huffman_totals": ("bits", huffman),
    "maximal_runs": ("start period length", repeats),
    "run_union": ("start period length", united),
    "sql_phrases": ("phrase_no pos ref len lit", lz78),
    "nearest_smaller": ("pos before after", nearest),
}


@pytest.mark.parametrize("name", WANTED)
def test_whole_query(spark, folder, name):
    columns, f = WANTED[name]
    found = catalog.queries()[name](spark, folder).select("item_id", *columns.split()).collect()
    assert sorted(map(tuple, found)) == sorted(each(f))


def test_token_bits_of_documents(spark, folder):
    """The documents' tokens, 2048 phrases to a block."""
    documents = {1: DATA[1], 2: b"an end of the hand " * 5}
    wanted = []
    for doc, x in documents.items():
        for kind, field in (("ref", 2), ("literal", 4)):
            v = [p[field] for p in lz78(x) if p[field] >= 0]
            width = (max(v) - min(v)).bit_length()
            wanted.append((doc, 0, kind, len(v), min(v), max(v), round(sum(v) / len(v), 2), width, width * len(v)))
    assert sorted(map(tuple, catalog.queries()["token_bits"](spark, folder).collect())) == sorted(wanted)


def test_container_ratios(spark, folder):
    sizes = sum(map(len, (DATA[1], b"an end of the hand " * 5)))
    for r in catalog.queries()["container_ratios"](spark, folder).collect():
        nout = sum(len(container.pack(x, r.algo, **{"lz78": {}, "lz77": {"threshold": 4}}.get(r.algo, {"k": 512, "window": 4096, "max_freq": 1024}))) for x in (DATA[1], b"an end of the hand " * 5))
        assert (r.n, r.nout, r.ratio) == (sizes, nout, round(nout / sizes, 4))


@pytest.mark.parametrize("algo", [*(a for a, p in PARSERS.items() if p.decode), container.RAW])
def test_containers(algo):
    draw = random.Random(3)
    for data in (b"", b"\0", b"$", bytes(range(256)), b"ab" * 3000, bytes(draw.choice(b"abc ") for _ in range(5000)), *DATA.values()):
        assert container.unpack(container.pack(data, algo)) == data
    with pytest.raises(ValueError):
        container.unpack(b"x" * 40)
