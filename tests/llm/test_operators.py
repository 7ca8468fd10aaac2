"""Operators against brute-force versions on whole small tables, and their defined cases."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelab.llm import ann, archive, cotraining, hmm, language_id, mixing, ngram_join, packing, quality_rules, template_extraction
from featurelab.llm.queries import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, _h int, n bigint, label int, size int"
LONG = " ".join(f"w{i % 7919}x{i % 31}" for i in range(60_000))
ODD = [
    (1, "a b c d e f g h", "en", "s1"),
    (1, "a b c d e f g h", "en", "s1"),
    (2, None, None, None),
    (3, "", "fr", "s2"),
    (4, " \n\t ", None, "s2"),
    (5, "12 34 %% ## !!", "de", None),
    (6, LONG, "en", "s1"),
    (7, LONG + " tail", "en", "s3"),
    (8, "one two", "fr", "s3"),
    (9, "ONE two", "fr", "s3"),
    (None, "a b c d e f g h", "en", "s1"),
    (10, "one  two   three\n\n four <|endoftext|> five ", "es", "s4"),
    (11, "naïve café 😀 Ünïcode text", "fr", "s4"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "x", 1, 2, 3, 4) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SMALL}/pages.parquet")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- quality rules


def base_counts(text):
    w = words(text)
    triples = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if triples[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def em(patterns, rounds=12):
    import math

    prior, good, bad = 0.7, [0.8] * 8, [0.8] * 8

    def post(v):
        x = math.log(prior / (1 - prior)) + sum(math.log(a / (1 - b)) if k == 1 else math.log((1 - a) / b) if k == -1 else 0 for k, a, b in zip(v, good, bad))
        return 1 / (1 + math.exp(-x))

    for _ in range(rounds):
        r = {v: post(v) for v in patterns}
        one, zero = sum(n * r[v] for v, n in patterns.items()), sum(n * (1 - r[v]) for v, n in patterns.items())
        f = lambda j, keep, w: sum(n * w(v) for v, n in patterns.items() if keep(v[j]))
        g = [min(0.99, max(0.55, (f(j, lambda x: x == 1, r.get) + 8) / (f(j, lambda x: x != 0, r.get) + 10))) for j in range(8)]
        b = [min(0.99, max(0.55, (f(j, lambda x: x == -1, lambda v: 1 - r[v]) + 8) / (f(j, lambda x: x != 0, lambda v: 1 - r[v]) + 10))) for j in range(8)]
        prior, good, bad = min(0.95, max(0.05, one / (one + zero))), g, b
    return post


def test_rules_counts_and_posterior(spark, documents):
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(documents).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        n, chars, symbols, lines, repeats = base_counts(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, chars, symbols, lines, repeats), r.doc_id
        assert g.base_failed == (n < 50 or 100 * repeats > 50 * n)
    judged = quality_rules._with_metrics(documents).withColumns({f"_v_{k}": v for k, v in quality_rules._votes().items()}).collect()
    votes = {r.doc_id: tuple(r[f"_v_{k}"] for k in quality_rules.RULES) for r in judged}
    post = em(Counter(votes.values()))
    for i, g in got.items():
        assert abs(g.posterior - post(votes[i])) < 1e-6
        assert g.kept == (not g.base_failed and g.posterior >= 0.5)
    assert 0.4 < np.mean([g.kept for g in got.values()]) < 1


def test_rules_cases(odd, empty):
    got = quality_rules.quality_verdicts(odd).collect()
    assert len(got) == len(ODD)
    for g in got:
        assert g.kept is not None and g.base_failed is not None
    by = {g.doc_id: g for g in got}
    assert by[2].n_words == by[3].n_words == by[4].n_words == 0 and not by[2].kept
    expected = sorted(base_counts(r[1]) for r in ODD)
    assert sorted((g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == expected
    assert quality_rules.quality_verdicts(empty).count() == 0
    assert set(quality_rules.filter_documents(odd).columns) == set(odd.columns)


# ---------------------------------------------------------------- n-gram join


def brute_components(rows, size, percent):
    sets = []
    for i, text in rows:
        w = words(lower(text))
        sets.append((i, frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    pairs = set()
    for k, (_, s) in enumerate(sets):
        for g in s:
            pairs.update((j, k) for j in where[g])
            where[g].append(k)
    for j, k in pairs:
        (a, x), (b, y) = sets[j], sets[k]
        if a is None or b is None:
            continue
        both = len(x & y)
        if 100 * both >= percent * (len(x) + len(y) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def variants(base, n, edits, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        w = base.split()
        for k in rng.choice(len(w), size=edits, replace=False):
            w[k] = f"v{rng.integers(1 << 40)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_join_matches_brute_force(spark, documents, size, percent):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.document_components(documents.select("doc_id", "text"), size, percent).collect()), key=str)
    assert got == brute_components(rows, size, percent)
    assert any(i != c for i, _, c in got)


@pytest.mark.parametrize("tiles", [{"chunk": 4}, {}, {"tile_rows": 3, "chunk": 4}, {"at_once": 40, "chunk": 4}])
def test_join_links_families_of_edited_copies(spark, tiles):
    if "at_once" in tiles:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    shared = " ".join(f"p{i}" for i in range(60))
    texts = []
    for seed, edits in enumerate((1, 2, 3, 5, 8)):
        base = " ".join(f"f{seed}q{i}" for i in range(200))
        texts += variants(base, 25, edits, seed)
        texts += [shared + " " + " ".join(f"z{seed}y{k}u{i}" for i in range(20 + 9 * k)) for k in range(12)]
    for seed in range(8):  # chains: each text is near the next one only
        w = [f"c{seed}r{i}" for i in range(150)]
        for step in range(10):
            texts.append(" ".join(w))
            w = w[4:] + [f"n{seed}e{step}w{k}" for k in range(4)]
    texts += texts[:20]
    rows = list(enumerate(texts, 100))
    try:
        found = ngram_join.document_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), **tiles)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_components(rows, 4, 85)


@pytest.mark.parametrize("tiles", [{"at_once": 64, "chunk": 8}, {"at_once": 64, "chunk": 8, "tile_rows": 20}])
def test_join_cuts_a_tile_that_fills_what_is_read_at_once(spark, tiles):
    """Copies of a text with 1, 4 and 12 words added: shingles of the text are in the prefixes of the first two kinds, of
    which those of the second are linked over the first only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 32)
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(k, text + "".join(f" e{k}w{i}" for i in range((1, 4, 12)[k % 3]))) for k in range(400)]
    try:
        found = ngram_join.document_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), **tiles)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
        read = ngram_join.document_sets(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), 4)
        hot, times = ngram_join._frequent(read)
        prefixes = ngram_join._tiles(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85, hot, times, tiles.get("tile_rows", 1 << 20))
        longest = max(r["count"] for r in prefixes.groupBy("shingle", "salt").count().collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_components(rows, 4, 85) and len({c for _, _, c in got}) == 1 + 133
    assert ("tile_rows" in tiles) == (longest < 64)


@pytest.mark.parametrize("seed", range(3))
def test_connected_matches_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found, n = ngram_join.connected(spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r.id: r.root for r in found.collect()}
    assert got == {x: find(x) for x in root if find(x) != x} and n == len(got)
    found, n = ngram_join.connected(spark.createDataFrame([], "a bigint, b bigint"))
    assert found.count() == n == 0


def test_join_keeps_rows_of_one_id_with_different_texts(spark):
    rows = [(1, "a b c d e f g h", "x"), (1, "a b c d e f g h", "y"), (1, "k l m n o p q", "x"), (None, "a b c d e", "x"), (None, "a b c d e", "x")]
    got = sorted((str(r.doc_id), r.text) for r in ngram_join.filter_documents(spark.createDataFrame(rows, "doc_id bigint, text string, node string")).collect())
    assert got == [("1", "a b c d e f g h"), ("1", "k l m n o p q"), ("None", "a b c d e"), ("None", "a b c d e")]


def test_join_cases(odd, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.document_components(odd).collect()), key=str)
    assert got == brute_components([(r[0], r[1]) for r in ODD], 4, 85)
    assert ngram_join.document_components(empty).count() == 0
    kept = [r.doc_id for r in ngram_join.filter_documents(odd).collect()]
    assert kept.count(1) == 1 and kept.count(None) == 1 and 7 not in kept and 9 not in kept and {2, 3, 4, 5, 6, 8} <= set(kept)


# ---------------------------------------------------------------- packing


def reference_pieces(rows, capacity=1024):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out = []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        at = len(ids) % capacity or min(capacity, len(ids))
        edges = [0, *range(at, len(ids) + 1, capacity)]
        out += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    return out


def check_packing(got, rows, slack):
    assert sorted([tuple(g)[:5] for g in got], key=str) == sorted(reference_pieces(rows), key=str)
    at = defaultdict(list)
    for g in got:
        at[g.sequence_id].append((g.offset, g.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(at) <= least_bins([g.length for g in got], 1024) + slack


def least_bins(lengths, capacity):
    """The best of simple bounds: pieces over capacity - a are alone, others over half can't share a bin."""
    best = 0
    for a in range(capacity // 2 + 1):
        alone = sum(x > capacity - a for x in lengths)
        large = [x for x in lengths if capacity // 2 < x <= capacity - a]
        small = sum(x for x in lengths if a <= x <= capacity // 2)
        best = max(best, alone + len(large) + max(0, -(-(small - len(large) * capacity + sum(large)) // capacity)))
    return best


def test_packing_small_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check_packing(packing.packed_pieces(documents, tokenizer_path()).collect(), rows, 1)


def test_packing_cases(odd, empty):
    check_packing(packing.packed_pieces(odd, tokenizer_path()).collect(), [(r[0], r[1]) for r in ODD], 1)
    assert packing.packed_pieces(empty, tokenizer_path()).count() == 0


def optimum(lengths, capacity):
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {bins[j]: j for j in range(len(bins))}.values():
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(12, 60, size=13).tolist()
    bins = packing.pack_lengths(np.bincount(lengths, minlength=101), 100)
    assert sorted(x for t, items in bins for x in items * t) == sorted(lengths)
    assert all(sum(items) <= 100 for _, items in bins)
    assert sum(t for t, _ in bins) == optimum(lengths, 100)


@pytest.mark.parametrize("seed", [272, 450, 462])
def test_a_long_row_of_bins_that_are_not_full_is_searched_too(seed, monkeypatch):
    monkeypatch.setattr(packing, "_incumbent", lambda counts, capacity, least: packing._best_fit(counts, capacity))
    lengths = np.random.default_rng(seed).integers(12, 50, size=14).tolist()
    counts = np.bincount([*lengths, *[97] * 500], minlength=101)  # nothing fits beside 97
    best = optimum(lengths, 100) + 500
    assert sum(t for t, _ in packing._best_fit(counts, 100)) > best
    assert sum(t for t, _ in packing.pack_lengths(counts, 100)) == best


def test_fillings_of_three_parts_are_listed():
    counts = np.bincount([50, 40, 34, 33, 33], minlength=101)
    found = list(packing._fillings(counts, 100, [10_000]))
    assert found[0] == (34, 33, 33)
    assert (50, 40) in found and (50, 34) not in found


@pytest.mark.parametrize("seed", range(6))
def test_fillings_are_the_undominated_ones(seed):
    lengths = np.random.default_rng(seed).integers(3, 30, size=9).tolist()
    counts, room = np.bincount(lengths, minlength=61), 60
    fillings = {tuple(sorted(c, reverse=True)) for n in range(10) for c in combinations(lengths, n) if sum(c) <= room}

    def dominated(f):
        out = list((Counter(lengths) - Counter(f)).elements())
        subsets = [c for n in range(len(f) + 1) for c in combinations(f, n)]
        return any(sum(c) <= x <= sum(c) + room - sum(f) and (len(c) > 1 or x > sum(c)) for c in subsets for x in out)

    assert sorted(packing._fillings(counts, room, [1_000_000])) == sorted(f for f in fillings if not dominated(f))


@pytest.mark.parametrize("seed", [72, 187, 221, 346, 383, 873])
def test_search_finds_packings_of_three_and_more_parts(seed):
    lengths = np.random.default_rng(seed).integers(12, 50, size=14).tolist()
    assert sum(t for t, _ in packing.pack_lengths(np.bincount(lengths, minlength=101), 100)) == optimum(lengths, 100)


# ---------------------------------------------------------------- mixing


def check_mix(got, rows):
    sizes = [(i, s, len(words(t))) for i, t, s in rows]
    totals = Counter()
    for _, s, n in sizes:
        totals[s] += n
    order = sorted((s for s in totals if s is not None)) + ([None] if None in totals else [])
    weight = dict(zip(order, [5, 2, 1] * len(order)))
    target, left, open_ = {}, 1.5 * sum(totals.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * totals[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        open_ -= over
    assert Counter((g.doc_id, g.size) for g in got) == Counter((i, n) for i, _, n in sizes)
    taken = Counter()
    source = {(i, n): s for i, s, n in sizes}
    for g in got:
        s = source[(g.doc_id, g.size)]
        assert g.source_size == totals[s] and abs(g.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= g.taken <= 2 * g.size
        taken[s] += g.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 1


def test_mixing(documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    one = mixing.document_shares(documents).collect()
    check_mix(one, rows)
    two = mixing.document_shares(documents.repartition(7)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def brute_mix(spark, rows, block, step):
    """(doc_id, size, taken, first slot) by going through the slots one by one."""
    frame = spark.createDataFrame([(i, s, len(words(t))) for i, t, s in rows], "doc_id bigint, source string, size bigint")
    hashed = [tuple(r) for r in frame.selectExpr("doc_id", "source", "size", "xxhash64(17, doc_id) AS h").collect()]
    targets = {r.source: r for r in mixing.source_targets(frame).collect()}
    order = sorted((s for s in targets if s is not None)) + ([None] if None in targets else [])
    need, streams = {}, {}
    for s in order:
        size, to_take = targets[s].source_size, round(targets[s].target)
        blocks = -(-size // block)
        need[s] = to_take // size * blocks + -(-(to_take % size) // block) if size else 0
        own = sorted((r for r in hashed if r[1] == s and r[2]), key=lambda r: (r[3] % 16, r[3], r[0], r[2]))
        streams[s] = [k for k, r in enumerate(own) for _ in range(r[2])], own, blocks, to_take
    total, upto, spans = sum(need.values()), 0, {}
    for s in order:
        low, upto = upto, upto + need[s]
        spans[s] = (int(low / total * 2**31), int(upto / total * 2**31))
    ranks, slots, over = Counter(), {}, []
    for k in range(total):
        point = k * step % 2**31
        (s,) = [s for s in order if spans[s][0] <= point < spans[s][1]]
        if ranks[s] < need[s]:
            slots[(s, ranks[s])] = k
        else:
            over.append(k)
        ranks[s] += 1
    short = sorted((r, order.index(s)) for s in order for r in range(ranks[s], need[s]))
    slots |= {(order[s], r): k for (r, s), k in zip(short, over)}
    taken, first = Counter(), {}
    for (s, rank), slot in slots.items():
        stream, own, blocks, to_take = streams[s]
        whole, at = divmod(rank, blocks)
        left = len(stream) if whole < to_take // len(stream) else to_take % len(stream)
        for k in stream[at * block : min((at + 1) * block, left)]:
            taken[(s, k)] += 1
            first[(s, k)] = min(first.get((s, k), slot), slot)
    out = [(r[0], r[2], taken[(s, k)], first.get((s, k))) for s in order for k, r in enumerate(streams[s][1])]
    return sorted([*out, *((i, 0, 0, None) for i, _, n, _ in hashed if not n)], key=str)


@pytest.mark.parametrize("step", [mixing.GOLDEN_31, 1 << 30, 5])
def test_mix_is_what_the_slots_read(spark, documents, step):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    got = sorted(((r.doc_id, r.size, r.taken, r.first_slot) for r in mixing.document_shares(documents, 64, step).collect()), key=str)
    assert got == brute_mix(spark, rows, 64, step)
    if step != mixing.GOLDEN_31:  # another schedule is another mix
        assert got != sorted(((r.doc_id, r.size, r.taken, r.first_slot) for r in mixing.document_shares(documents, 64).collect()), key=str)


def test_mixed_documents_come_in_the_order_of_their_slots(documents):
    mixed = [r.doc_id for r in mixing.mix_documents(documents, in_order=True).collect()]
    assert len(mixed) > len(set(mixed)) > 50
    total, sources = len(mixed), {r.doc_id: r.source for r in documents.collect()}
    whole = Counter(sources[i] for i in mixed)
    half = Counter(sources[i] for i in mixed[: total // 2])  # each source is spread over the mix
    assert all(abs(half[s] - n / 2) <= 0.25 * n + 2 for s, n in whole.items())
    parts = mixing.mix_documents(documents.repartition(3)).rdd.glom().map(lambda rows: [r.doc_id for r in rows]).collect()
    assert Counter(sum(parts, [])) == Counter(mixed)


def test_mixing_cases(odd, empty):
    check_mix(mixing.document_shares(odd).collect(), [(r[0], r[1], r[3]) for r in ODD])
    assert mixing.document_shares(empty).count() == 0
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mix_documents(empty).count() == 0


def test_schedule_has_low_discrepancy(spark):
    plan = mixing._plan(spark.createDataFrame([("a", 50_000, 75_000.0), ("b", 30_000, 30_000.0), ("c", 20_000, 20_000.0)], "source string, source_size bigint, target double"), 100)
    slots = mixing.schedule(plan, plan.agg({"needed": "sum"}).first()[0]).orderBy("slot").collect()
    need = {r.source_no: r.needed for r in plan.collect()}
    assert Counter(s.source_no for s in slots) == Counter(need)
    assert [s.slot for s in slots] == list(range(len(slots)))
    for s in need:
        assert sorted(x.rank for x in slots if x.source_no == s) == list(range(need[s]))
    total, seen = sum(need.values()), Counter()
    for k, s in enumerate(slots, 1):
        seen[s.source_no] += 1
        assert all(abs(seen[x] - k * need[x] / total) < 6 for x in need)


# ---------------------------------------------------------------- archive


def test_archive_round_trip(spark, tmp_path):
    import base64
    import hashlib

    rows = [(5, "http://a/", "<p>x</p>"), (3, "http://b/\r\nX: y", "<p>x</p>"), (9, None, None), (7, "u", ""), (8, "u", "é\r\n\r\nWARC/1.1\r\n"), (8, "u", "é\r\n\r\nWARC/1.1\r\n"), (2, "v", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, sha256 string")
    got = archive.archive_round_trip(pages).collect()
    assert len(got) == len(rows)
    body = {r[0]: (r[2] or "").encode() for r in rows}
    for g in got:
        same = [i for i, b in body.items() if b == body[g.page_id]]
        assert g.payload_bytes == len(body[g.page_id])
        assert g.payload_digest == base64.b32encode(hashlib.sha1(body[g.page_id]).digest()).decode()
        assert (g.record_type, g.refers_to) == (("response", None) if g.page_id == min(same) else ("revisit", min(same)))
    path = f"file://{tmp_path}/archive"
    archive.write_archive(pages, path, least_bytes=10)
    records = archive.read_archive(spark, path).collect()
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n" and rest[:length].startswith(b"HTTP/1.1 200 OK\r\n")
    parsed = archive.parse_records(archive.read_archive(spark, path)).collect()
    assert {p.page_id for p in parsed if p.payload_bytes < 10 and p.record_type == "revisit"} == set()
    assert archive.archive_round_trip(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- language model


def test_language_model_base_and_exact_likelihood(spark, documents, monkeypatch):
    import math

    kept = {}
    real = hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda *a, **k: kept.setdefault("model", real(*a, **k)))
    got = {r.doc_id: r for r in hmm.score_texts(hmm.held_out(documents), most=300).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    tokens = {i: [*words(lower(t)), None] for i, t in texts.items()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(x for i in train for x in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, g in got.items():
        assert g.held_out == (i not in train) and g.n_tokens == len(tokens[i]) and g.n_known == sum(x in c for x in tokens[i]) and g.train_tokens == n
        assert abs(g.base_score - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens[i])) < 1e-6 * len(tokens[i]) + 1e-6
        assert g.score < 0
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > 1.1 * sum(g.base_score for g in held)
    # the likelihood of a short text by enumerating all state paths
    m = kept["model"]
    seq = np.array([3, 300, 7, 0])
    from itertools import product

    total = sum(m["start"][p[0]] * m["emit"][p[0], seq[0]] * math.prod(m["move"][a, b] * m["emit"][b, s] for a, b, s in zip(p, p[1:], seq[1:])) for p in product(range(len(m["start"])), repeat=4))
    assert abs(hmm.forward(seq[:, None], np.array([4]), m)[0] - math.log(total)) < 1e-9
    assert np.allclose(m["emit"].sum(axis=1), 1) and np.allclose(m["move"].sum(axis=1), 1)


def test_baum_welch_counts_match_enumeration():
    from itertools import product
    import math

    rng = np.random.default_rng(3)
    m = {"start": rng.dirichlet([1, 1]), "move": rng.dirichlet([1, 1], 2), "emit": rng.dirichlet(np.ones(hmm.CLASSES), 2)}
    seqs = [np.array([1, 5, 5, 0]), np.array([2, 0]), np.array([0])]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((2, hmm.CLASSES))
    for s in seqs:
        paths = list(product(range(2), repeat=len(s)))
        p = np.array([m["start"][q[0]] * m["emit"][q[0], s[0]] * math.prod(m["move"][a, b] * m["emit"][b, x] for a, b, x in zip(q, q[1:], s[1:])) for q in paths])
        for q, w in zip(paths, p / p.sum()):
            start[q[0]] += w
            for a, b in zip(q, q[1:]):
                move[a, b] += w
            for a, x in zip(q, s):
                emit[a, x] += w
    for got, want in zip(hmm.expected_counts(seqs, m), (start, move, emit)):
        assert np.allclose(got, want)


def test_language_model_cases(odd, empty):
    got = hmm.score_texts(hmm.held_out(odd)).collect()
    assert len(got) == len(ODD)
    for g in got:
        assert np.isfinite(g.score) and np.isfinite(g.base_score)
    assert {g.n_tokens for g in got if g.doc_id in (2, 3, 4)} == {1}
    assert hmm.score_texts(hmm.held_out(empty)).count() == 0


# ---------------------------------------------------------------- language identification


def test_language_id_is_accurate(spark):
    got = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    lang = {r.doc_id: r.lang for r in rows}
    held = [g for g in got if g.held_out]
    assert len(got) == len(rows) and all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    assert np.mean([g.lang_pred == lang[g.doc_id] for g in held]) > 0.97
    assert all(0 <= g.score <= 1 for g in got)


def test_language_id_cases(spark, odd, empty):
    got = {g.doc_id: g for g in language_id.predicted_languages(odd).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 5))
    assert language_id.predicted_languages(odd).count() == len(ODD)
    assert language_id.predicted_languages(empty).count() == 0
    one = odd.filter("lang = 'en'")
    assert {g.lang_pred for g in language_id.predicted_languages(one).collect()} <= {"en", "und"}
    assert language_id.filter_documents(odd).columns == odd.columns


# ---------------------------------------------------------------- nearest neighbours


def brute_neighbours(rows, every, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = x @ q
            keep = ids != i
            order = np.lexsort((ids[keep], -s[keep]))[:k]
            out[int(i)] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist()))
    return out


def test_search_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_neighbours([(r.vec_id, r.embedding) for r in vectors.collect()], 20, 20)
    got = defaultdict(list)
    for r in ann.search(vectors).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) > 0.93
    for q in got:
        assert len(got[q]) == 20 and [x for x in got[q]] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_search_of_clustered_vectors_probes_few_lists(spark):
    """40 clusters, of which one has a third of all rows: its lists are dealt over shards, queries go in chunks."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 4
    rows = [(i, (centres[0 if i % 3 == 0 else rng.integers(1, 40)] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    want = brute_neighbours(rows, 20, 20)
    model = ann.fit_index(ann.usable(vectors), 3000)
    assert model["share"] < 0.5
    for options in ({}, {"shard_rows": 100, "chunk": 7}):
        got = defaultdict(list)
        for r in ann.search(vectors, **options).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert got.keys() == want.keys()
        assert sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) / (20 * len(want)) > 0.93


def test_search_misses_nothing_whatever_the_vectors(spark):
    """Flat ones, lengths of several orders, few rows that are far larger than most of the sample, ones whose squares no
    single precision holds, and many copies: the neighbours are those of brute force, in order."""
    rng = np.random.default_rng(5)
    n = 1500
    flat = rng.normal(size=(n, 24))
    cases = [flat, flat * np.exp(rng.normal(size=(n, 1)) * 1.5), np.where(np.arange(n)[:, None] % 50 < 1, flat * 0.001, flat * 100), flat * 1e30, np.where(rng.random((n, 1)) < 0.3, flat[:1], flat)]
    for x in cases:
        rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
        vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
        for options in ({}, {"shard_rows": 100, "chunk": 7, "shortlist": 20, "recall": 0.3}):
            got = defaultdict(list)
            for r in ann.search(vectors, 50, **options).orderBy("query_id", "rank").collect():
                got[r.query_id].append(r.vec_id)
            y = np.array([v for _, v in rows])
            for i in range(0, n, 50):
                score, ids = (y * y[i]).sum(axis=1), np.delete(np.arange(n), i)
                assert got[i] == ids[np.lexsort((ids, -score[ids]))][:20].tolist()


def test_lists_are_dealt_into_shards_of_bounded_rows():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 50, 64)
    sizes[5] = 900
    first, splits = ann._bundles(rng.normal(size=(64, 8)), sizes, 100)
    held = Counter()
    for i, n in enumerate(sizes):
        for k in range(splits[i]):
            held[first[i] + k] += n / splits[i]
    assert max(held.values()) <= 100 and splits[5] == 9 and len(held) < sizes.sum() / 25
    near, least = rng.normal(size=(3, 64)), 300
    probed = ann._probed(near, sizes, least)
    for q in range(3):
        order, reach = np.argsort(-near[q]), 0
        for i in order:
            assert probed[q, i] == (reach < least)
            reach += sizes[i]


def test_search_cases(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(12)] + [(20, None), (40, [0.0] * 4), (60, [1.0, None, 0.0, 0.0]), (80, [float("nan")] * 4), (100, [float("inf")] * 4), (120, [1.0, 2.0]), (5, rng.normal(size=4).tolist())]
    rows[7] = (7, rows[3][1])
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, score int")
    clean = [r for k, r in enumerate(rows[:12])]
    got = [(r.vec_id, r.rank) for r in ann.search(df.filter("vec_id <> 5")).orderBy("rank").collect()]
    f32 = [(i, np.array(v, dtype=np.float32)) for i, v in clean if i != 5]
    assert got == [(i, k) for k, (i, _) in enumerate(brute_neighbours(f32, 20, 20)[0], 1)]
    assert len(ann.search(df).collect()) == 11
    assert ann.search(df.limit(0)).count() == 0


# ---------------------------------------------------------------- co-training


def test_cotraining_beats_chance_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    test = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 = 1")
    got = {r.doc_id: r.score for r in cotraining.score_documents(docs, labels.join(test, "doc_id", "left_anti")).collect()}
    assert len(got) == docs.count()
    truth = [(got[r.doc_id], r.quality) for r in test.collect()]
    good, bad = [s for s, q in truth if q == 1], [s for s, q in truth if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.85


def auc(labels, scores):
    good, bad = [s for y, s in zip(labels, scores) if y], [s for y, s in zip(labels, scores) if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def two_views(spark, n=1500, labelled=150):
    """Documents whose words and whose source both tell good from bad, each with errors of its own."""
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for k in range(n):
        good = int(rng.random() < 0.6)
        of = [f"{'good' if rng.random() < (0.62 if good else 0.38) else 'poor'}{rng.integers(12)}" for _ in range(30)]
        docs.append((k, " ".join(of), "en", f"{'site' if (rng.random() < 0.95) == bool(good) else 'farm'}{rng.integers(3)}", 150))
        labels.append((k, good))
    return docs, labels, spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels[:labelled], "doc_id bigint, quality int")


def test_cotraining_views_teach_each_other(spark):
    _, labels, docs, some = two_views(spark)
    model = cotraining.co_train(docs, some)
    assert len(model.taught) == 2 and all(min(t[v]) > 10 for t in model.taught for v in cotraining.VIEWS)
    for t in model.taught:  # in the proportion of the labelled classes
        assert all(0.4 < t[v][1] / sum(t[v]) < 0.8 for v in cotraining.VIEWS)
    found = {rounds: {r.doc_id: r for r in cotraining.score_documents(docs, some, rounds=rounds).collect()} for rounds in (0, 2)}
    rest = labels[150:]
    one = {(rounds, c): auc([y for _, y in rest], [found[rounds][i][c] for i, _ in rest]) for rounds in (0, 2) for c in ("score", "text_score", "metadata_score")}
    assert one[(2, "score")] > max(one[(2, "text_score")], one[(2, "metadata_score")])
    assert one[(2, "text_score")] > one[(0, "text_score")] + 0.01  # the text's classifier has learned from the metadata's


def test_cotraining_features_by_hand():
    import pyarrow as pa

    text = "Ab, ab ab\nx 7é"
    ((at, x),) = cotraining.text_features(pa.array([text]))
    assert at == 0 and x.shape == (1, cotraining.CELLS + cotraining.CLASSES + 5)
    data = text.encode()
    shares = Counter(cotraining._CLASS[b] for b in data)
    got = x[0, cotraining.CELLS : cotraining.CELLS + cotraining.CLASSES] ** 2
    assert all(abs(got[k] - shares[k] / len(data)) < 1e-9 for k in range(cotraining.CLASSES))
    assert np.allclose(x[0, -5:], [np.log1p(5), sum(len(w.encode()) for w in text.split()) / 5 / 10, 4 / 5, 1 / 5, 1])
    # five words and four pairs of words
    assert abs((x[0, : cotraining.CELLS] ** 2).sum() - 1) < 1e-9 and 1 <= round(1 / min(v for v in x[0, : cotraining.CELLS] ** 2 if v)) <= 9
    known = {"source": {"s": 0, None: 1}, "lang": {"en": 0}}
    y = cotraining.metadata_features(pa.array(["s", None, "new"]), pa.array(["en", "xx", None]), pa.array([0, None, 1000]), known)
    assert y.sum(axis=1).tolist() == [3, 3, 3] and [int(np.flatnonzero(r)[0]) for r in y] == [0, 1, cotraining.SOURCES]


def test_cotraining_labels_of_one_class_to_fit_on(spark):
    docs, labels, frame, _ = two_views(spark, 60, 0)
    inside = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    one = [(i, 0 if i in inside else 1) for i, _ in labels]
    got = cotraining.score_documents(frame, spark.createDataFrame(one, "doc_id bigint, quality int")).collect()
    mean = sum(y for _, y in one) / len(one)
    assert len(got) == 60 and all(abs(r.score - mean) < 1e-9 and r.text_score == r.metadata_score == r.score for r in got)
    # and of one class to calibrate on
    two = [(i, 1 if i in inside else y) for i, y in labels]
    got = cotraining.score_documents(frame, spark.createDataFrame(two, "doc_id bigint, quality int")).collect()
    assert len(got) == 60 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got}) > 10


def test_cotraining_cases(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (6, 1, 0), (5, 0, 0), (5, None, 0), (8, 1, 0), (9, 0, 1), (10, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = cotraining.score_documents(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= g.score <= 1 for g in got)
    assert {g.score for g in cotraining.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert {g.score for g in cotraining.score_documents(odd, labels.filter("quality = 1")).collect()} == {1.0}
    assert cotraining.score_documents(empty, labels).count() == 0


# ---------------------------------------------------------------- template extraction


def test_extraction_of_every_page(spark, pages):
    import html as h

    got = {r.page_id: r for r in template_extraction.main_texts(pages).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>|<br>", body)]
        assert got[p.page_id].text == "\n".join(x for x in blocks if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_extraction_leaves_out_other_parts(spark):
    def page(i):
        return f"""<html><head><title>t{i}</title><style>p>a{{}}</style></head><body class="home"><header><h1>Site</h1></header>
        <nav><a href=x>menu</a></nav><div id="cookie-notice">We use cookies</div><main><h1>Head &amp; line {i}</h1>
        <p>First  <b>bold {i}</b>\n text.<p>Second {i}<div class="ad">Buy</div><form><input value="<p>"><label>Mail</label></form>
        <ul><li>item {i}</ul><p>Written by the staff of this site.</p><section class="comments"><p>nice {i}</p></section></main>
        <aside>More</aside><script>var x = "<p>no</p>";</script><footer>&copy; site</footer></body></html>"""

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(10)] + [(50, None, None), (51, "http://x/", ""), (52, "http://y/", "plain &lt;text&gt;"), (53, "http://z/", "<p>open <b>never closed")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, template string")
    got = {r.page_id: r.text for r in template_extraction.main_texts(df).collect()}
    for i in range(10):
        assert got[i] == f"Head & line {i}\nFirst bold {i} text.\nSecond {i}\nitem {i}"
    assert got[50] == got[51] == "" and got[52] == "plain <text>" and got[53] == "open never closed"
    assert template_extraction.main_texts(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "http://h/", page(1)) for i in range(12)], "page_id bigint, url string, html string")
    assert {r.text for r in template_extraction.main_texts(copies).collect()} == {"Head & line 1\nFirst bold 1 text.\nSecond 1\nitem 1\nWritten by the staff of this site."}


def test_extraction_deduces_a_template_per_layout(spark):
    layouts = {"story": "Told by the staff.", "offer": "Ask for the price.", "event": "Doors open at eight."}
    rows = [(10 * k + i, "http://h.example/", f'<html><body><div class="{name}"><p>{name} {i}<p>{line}</div></body></html>') for k, (name, line) in enumerate(layouts.items()) for i in range(10)]
    rows.append((99, "http://h.example/", '<html><body><section class="other"><p>once<p>Told by the staff.</section></body></html>'))
    got = {r.page_id: r.text for r in template_extraction.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {10 * k + i: f"{name} {i}" for k, name in enumerate(layouts) for i in range(10)} | {99: "once\nTold by the staff."}


PAGES = "page_id bigint, url string, html string"


def plain_page(i, paragraphs=3):
    """No element's name tells anything, and there is no article element."""
    said = "".join(f"<p>Paragraph {k} of page {i} says a good deal about topic {i * 7 + k} and its history.</p>" for k in range(1 + (i + paragraphs) % 4))
    return f"""<html><head><title>Page {i}</title></head><body class="k1"><div class="a1"><div><a href="/a">Start</a></div><div><a href="/{i}">Number {i}</a></div></div>
    <div class="b2"><h2>About {i}</h2>{said}</div><div class="c3"><span>Buy item {i * 13 % 101} now, today only</span></div><div class="d4">All rights kept</div></body></html>"""


def plain_text(i):
    return "\n".join([f"About {i}", *(f"Paragraph {k} of page {i} says a good deal about topic {i * 7 + k} and its history." for k in range(1 + (i + 3) % 4))])


def test_extraction_by_slots_of_the_template(spark):
    rows = [(i, f"http://plain.example/{i}", plain_page(i)) for i in range(12)] + [(100 + i, "http://plain.example/c", plain_page(3)) for i in range(5)]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = {r.page_id: r.text for r in template_extraction.main_texts(df).collect()}
    assert got == {i: plain_text(i) for i in range(12)} | {100 + i: plain_text(3) for i in range(5)}
    # it is the template that decides: without it, menus and offers stay
    assert template_extraction.main_text(plain_page(3), None, None) != plain_text(3)
    templates, _ = template_extraction.deduce_templates(df)
    (t,) = templates.collect()
    assert len(t.classes) == len(t.choices) == 1 and len(t.classes[0].roots) >= 7
    # another host with the same pages, but too few of them, has no template
    few = {r.page_id: r.text for r in template_extraction.main_texts(df.filter("page_id < 3")).collect()}
    assert all(few[i] != plain_text(i) for i in range(3))


def test_extraction_splits_a_layout_by_the_order_of_its_elements(spark):
    def turned(i):
        a, b = f'<div class="x"><p>Offer {i} for you</p></div>', f'<div class="y"><p>{plain_text(i)}</p><p>More on {i}</p></div>'
        return f"<html><body>{a + b if i % 2 else b + a}</body></html>"

    rows = [(i, "http://turned.example/", turned(i)) for i in range(20)]
    got = {r.page_id: r.text for r in template_extraction.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: " ".join(plain_text(i).split()) + f"\nMore on {i}" for i in range(20)}


def test_extraction_classes_match_vectors_by_hand(spark):
    rows = [(i, "http://plain.example/", plain_page(i)) for i in range(9)]
    (c,) = template_extraction.template_classes(spark.createDataFrame(rows, PAGES).repartition(4)).collect()
    vectors = defaultdict(lambda: [0] * 9)
    for i, _, source in rows:
        for e in template_extraction.page_events(source):
            if e[0] == template_extraction.OPEN:
                vectors[e[1]][i] += 1
    assert set(c.roots) == {path for path, v in vectors.items() if v == [1] * 9}


def test_extraction_keeps_what_only_sounds_like_other_parts(spark):
    page = """<body><article><h1 class="page-header">Head</h1><p>One</p><h2 id="related-work">Related work</h2><p class="comment">Two</p><div class="side-effects">Three</div></article></body>"""
    more = """<body><div class="ad-box">Buy</div><article><p>In</p></article><p>A long text outside of the article element, longer than what is in it</p></body>"""
    rows = [(1, "http://a/", page), (2, "http://b/", more)] + [(10 + i, "http://c/", page.replace("One", f"One {i}").replace("Two", f"Two {i}")) for i in range(9)]
    got = {r.page_id: r.text for r in template_extraction.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1] == "Head\nOne\nRelated work\nTwo\nThree"
    assert got[2] == "In\nA long text outside of the article element, longer than what is in it"
    assert all("Two %d" % i in got[10 + i] and "One %d" % i in got[10 + i] for i in range(9))


@pytest.mark.parametrize("piece", ["<a", "<a 'x", '<p title="', "<!", "</", "<div>", "<b>", "<div><b>", "</div>", "<p>", "<script", "<!--", "<a b=c ", "&amp;", "<b><hr>"])
def test_extraction_of_long_malformed_pages_takes_linear_time(piece):
    import time

    began = time.perf_counter()
    text = template_extraction.main_text("begin " + piece * ((1 << 20) // len(piece)) + " <p>end", None, None)
    assert time.perf_counter() - began < 20 and text.startswith("begin")


def test_extraction_of_unclosed_elements_and_end_tags_in_linear_time():
    import time

    began = time.perf_counter()
    for source in ("<div>" * 60_000 + "</b>" * 60_000, "<b>" * 60_000 + "<hr>" * 60_000, "<p>" + "<div>" + "<b>" * 60_000 + "<hr>" * 60_000, "<p><b>" * 60_000):
        template_extraction.main_text(source + "x", None, None)
    assert time.perf_counter() - began < 20


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, documents):
    import corpus_pipeline

    docs, before = documents, documents.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).persist()
        assert docs.columns == documents.columns
        if name != "source_mixing":
            assert docs.count() <= before
            before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    check_packing(out, [(r.doc_id, r.text) for r in docs.collect()], 1)


@pytest.mark.parametrize("extended", [False, True])
def test_pipeline_of_odd_and_empty_tables(spark, odd, empty, documents, extended):
    import corpus_pipeline

    base = documents.columns
    more = ["node", "_h"]  # names that operators use themselves
    odd, empty = (df.select(*base, *(more if extended else [])) for df in (odd, empty))
    long = documents.withColumn("doc_id", F.col("doc_id") + 1000)
    if extended:
        long = long.withColumns({"node": F.lit("x"), "_h": F.lit(1)})
    docs = odd.unionByName(long)
    for df in (docs, odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SMALL).persist()
            assert df.columns == [*base, *(more if extended else [])], name
        pieces = corpus_pipeline.STAGES[-1][1](spark, df, SMALL).collect()
        assert sorted({r.doc_id for r in pieces}) == sorted({r.doc_id for r in df.collect()})
        check_packing(pieces, [(r.doc_id, r.text) for r in df.collect()], 1)
    assert not pieces


def test_filters_of_empty_tables(empty):
    for f in (quality_rules.filter_documents, language_id.filter_documents, ngram_join.filter_documents, mixing.mix_documents):
        out = f(empty)
        assert out.columns == empty.columns and out.count() == 0


# ---------------------------------------------------------------- shared


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from types import SimpleNamespace

    from featurelab.llm import common

    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda *a: None)))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(unset("local-cluster[3,2,1000]"))
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(unset("spark://h:7077"))
    assert common.shared_dir(unset("local[2]")).startswith("file://")


def test_archive_of_pages_without_an_id(spark):
    rows = [(None, "u", "<p>a"), (3, "u", "<p>a"), (5, "u", "<p>a"), (None, "u", "<p>b"), (None, "u", "<p>b"), (3, "u", "<p>a")]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in archive.archive_round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()), key=str)
    assert got == sorted([(None, "revisit", 3), (3, "response", None), (3, "response", None), (5, "revisit", 3), (None, "response", None), (None, "response", None)], key=str)


def test_packing_with_ranks_gives_the_tokenizer_ids(documents, odd):
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    for df in (documents, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = packing.packed_pieces(df, tokenizer_path(), ranks=ranks).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(reference_pieces(rows))


def test_encoder_with_ranks_equals_the_tokenizer_on_odd_strings():
    encoder = packing.Encoder(tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken"))
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(tokenizer_path()), np.random.default_rng(3)
    signs = ["a", "B", "é", "ß", "1", "23", " ", "  ", "\n", "\t", "'s", "'ll", ".", ",", "!", "-", "😀", "日本", " ", "​", "\0", "_", "don't", "x\n\ny", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(signs, size=rng.integers(1, 14)))
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_short_texts_are_sliced_by_rows():
    import pyarrow as pa

    sizes = [len(x) for _, x in language_id.features(pa.array(["ab"] * 5000))]
    assert sum(sizes) == 5000 and max(sizes) == language_id.ROWS
