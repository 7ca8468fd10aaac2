"""Whitening, alignment of tokenizers and lines that documents share, against brute force; their defined cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest


from featurelab.llm import alignment, line_dedup, whitening
from featurelab.llm.queries import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
A, B, RANKS = map(tokenizer_path, ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
EXTRA = "doc_id bigint, text string, line int, doc string, h1 int, pair int, row int, links int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], EXTRA)


# ---------------------------------------------------------------- whitening


def exact(x):
    """Codes to (deviations, covariance), by whole numbers and numpy."""
    n, sums = len(x), [sum(map(int, c)) for c in x.T]
    deviations = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums)) for r in x]
    c = (x - np.array([s // n for s in sums])) - np.array([s % n for s in sums]) / n
    return deviations, c, c.T @ c / n


def check_whitening(rows, ids, vectors, components=32):
    """Rows of the result against numpy's decomposition of the covariance."""
    x = np.floor(64 * vectors.astype(np.float64)).astype(np.int64) + 1_000_000
    deviations, c, v = exact(x)
    e, axes = (a[..., ::-1] for a in np.linalg.eigh(v))
    k = min(components, x.shape[1])
    assert len(rows) == k * len(ids)
    by = defaultdict(dict)
    for r in rows:
        by[r.vec_id][r.component] = r
    assert [by[i][1].deviation for i in ids] == deviations and {r.n for r in rows} == {len(ids)}
    w = np.array([[by[i][j + 1].whitened for j in range(k)] for i in ids])
    real = e[:k] > 1e-12 * e[0]
    want = np.where(real, c @ axes[:, :k] / np.sqrt(np.where(real, e[:k], 1)), 0)
    signs = np.sign((w * want).sum(axis=0))
    assert np.abs(w * signs - want).max() < 1e-7
    assert np.allclose([by[ids[0]][j + 1].explained for j in range(k)], np.where(real, e[:k], 0) / np.trace(v), rtol=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-8


def test_whitening_of_the_whole_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = QUERIES["op11_embedding_whitening"](spark, SMALL).collect()
    check_whitening(rows, [r.vec_id for r in table], np.array([r.embedding for r in table], dtype=np.float32))


def test_components_by_the_range_finder_alone_and_by_all_dimensions(spark):
    random_ = np.random.default_rng(3)
    steep = random_.standard_normal((600, 40)) * 10.0 ** -np.arange(0, 20, 0.5)[:40] * 4000
    flat = random_.standard_normal((600, 40))
    for vectors, passes in ((steep, None), (flat, 4)):
        df = whitening.codes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>"))
        about = whitening.moments(df)
        e, axes, trace, done = whitening.principal_components(df, about, 5)
        _, _, v = exact(np.floor(64 * vectors).astype(np.int64) + 1_000_000)
        want, wanted = (a[..., ::-1] for a in np.linalg.eigh(v))
        assert np.allclose(e, want[:5], rtol=1e-10) and abs(trace / np.trace(v) - 1) < 1e-12
        assert np.abs(np.abs((axes * wanted[:, :5]).sum(axis=0)) - 1).max() < 1e-9
        assert done <= 3 if passes is None else done == passes  # flat spectra need all dimensions


def test_vectors_that_take_no_part_and_odd_ones(spark):
    good = [(i, [0.1 * i, float(i % 3), 5.0]) for i in range(7)] + [(3, [0.1, 0.2, 5.0]), (3, [0.1, 0.2, 5.0]), (None, [1.0, 1.0, 5.0])]
    bad = [(20, None), (21, []), (22, [1.0, None, 2.0]), (23, [1.0, float("nan"), 2.0]), (24, [float("inf"), 0.0, 0.0]), (25, [1.0, 2.0]), (26, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in good + bad], "vec_id bigint, embedding array<double>, component int, whitened double, n int")
    rows = whitening.whitened(df).collect()
    assert Counter(r.vec_id for r in rows) == {k: 3 * n for k, n in Counter(i for i, _ in good).items()}
    ids = [(i, k) for k, (i, _) in enumerate(good)]
    numbered = spark.createDataFrame([(k, v) for (_, k), (_, v) in zip(ids, good)], "vec_id bigint, embedding array<double>")
    check_whitening(whitening.whitened(numbered).collect(), list(range(len(good))), np.array([v for _, v in good]))
    assert all(r.whitened == 0 and r.explained == 0 for r in rows if r.component == 3)  # one dimension doesn't vary
    one = whitening.whitened(df.filter("vec_id = 5")).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 0, 0, 0, 0) for k in (1, 2, 3)]
    none = whitening.whitened(df.filter("vec_id > 19 and vec_id < 24"))
    assert none.count() == 0 and none.columns == whitening.whitened(df).columns


def test_deviations_beyond_64_bits_stay_exact_or_are_null():
    about = whitening.Moments(3, [3 * (1 << 40) + 1, 5])
    near, far = np.array([[(1 << 40) + (1 << 29), 2]]), np.array([[1 << 50, 2]])
    assert about.deviations(near) == [((3 << 29) - 1) ** 2 + 1]
    assert about.deviations(far) == [None]


# ---------------------------------------------------------------- alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.Pair(A, B)


def whole(tokenizers, text):
    """Both tokenizers over a whole text: ids and byte ends."""
    a, b, pair = tokenizers
    ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
    raw = [[names[i] for i in x] for names, x in zip((pair.a_bytes, pair.b_bytes), ids)]
    if not text or any(b"".join(r) != (" " + text).encode() for r in raw):
        return [], [], [], []
    return ids[0], np.cumsum([len(x) for x in raw[0]]).tolist(), ids[1], np.cumsum([len(x) for x in raw[1]]).tolist()


def brute(tokenizers, texts):
    """All columns of the result but the ids, one text after another, by comparing every A token with every B token."""
    out, linked = [], []
    for text in texts:
        a, ea, b, eb = whole(tokenizers, text)
        sa, sb, groups, i, j = [0, *ea], [0, *eb], [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            i2, j2 = ea.index(end) + 1, eb.index(end) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        links, k0 = [], 0
        for x in range(len(a)):
            while k0 < len(b) and eb[k0] <= sa[x]:
                k0 += 1
            k = k0
            while k < len(b) and sb[k] < ea[x]:
                links.append((a[x], b[k]))
                k += 1
        linked.append(links)
        out.append([len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    held = Counter(p for links in linked for p in set(links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [(*r[:4], sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), r[4]) for r, links in zip(out, linked)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_the_whole_table(spark, tokenizers):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_tokenizer_alignment"](spark, SMALL).collect()}
    assert got == dict(zip([r.doc_id for r in docs], brute(tokenizers, [r.text for r in docs])))


def odd_texts():
    random_ = random.Random(5)
    bits = ["a", "b", " ", " ", "  ", "\n", "\t", "é", "😀", "漢", "字", "<|endoftext|>", "<s>", "▁", "'s", "1", "23", "!", " ", "　", "the", "\x1c", "\r", "=", "0x", "\x00"]
    texts = ["".join(random_.choice(bits) for _ in range(random_.randrange(1, 14))) for _ in range(1500)]
    return texts + [" ", "  ", "a ", "a  ", " a", None, "", "same words here", "same words here", "x" * 3000, "=" * 3000 + "漢字" * 700, "word " * 9000]


def test_alignment_of_odd_texts(spark, tokenizers):
    texts = odd_texts()
    df = frame(spark, [(i % 1000 if i != 3 else None, t) for i, t in enumerate(texts)])  # ids repeat
    want = Counter((i % 1000 if i != 3 else None, *r) for i, r in enumerate(brute(tokenizers, texts)))
    for ranks, most in ((RANKS, 1_000_000), (None, 40)):  # all pairs broadcast; nearly all joined by a shuffle
        rows = alignment.alignments(df.repartition(3), A, B, ranks, broadcast_pairs=most).collect()
        assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in rows) == want
    assert alignment.alignments(df.limit(0), A, B).count() == 0


def test_forgotten_pieces_and_chunks_of_any_size(spark, tokenizers):
    texts = odd_texts()
    small = alignment.Pair(A, B, RANKS, remember=10)
    for i in range(0, len(texts), 7):
        some = texts[i : i + 7]
        first, place, sides = small.chunk(some)
        for k, text in enumerate(some):
            ids = [x for p in place[first[k] : first[k + 1]] for x in sides[0][1][sides[0][0][p] : sides[0][0][p + 1]].tolist()]
            assert ids == whole(tokenizers, text)[0]


def test_pieces_are_aligned_once(tokenizers, monkeypatch):
    """However many documents and chunks hold a piece, its groups and links are made once."""
    made = []
    align = alignment.Pair._align
    monkeypatch.setattr(alignment.Pair, "_align", lambda self, before: (made.append(len(self._wrong) - before), align(self, before))[1])
    texts = odd_texts()[-200:]
    want, pair = brute(tokenizers, texts), alignment.Pair(A, B, RANKS)
    for _ in range(3):
        for i in range(0, len(texts), 9):
            counts, digests, upto, links = pair.documents(texts[i : i + 9])
            assert list(zip(*(c.tolist() for c in counts), np.diff(upto).tolist(), digests)) == [(*r[:4], r[6]) for r in want[i : i + 9]]
            assert all((np.diff(links[x:y]) >= 0).all() for x, y in zip(upto[:-1], upto[1:]))
    assert sum(made) == len({p for t in texts if t for p in pair.pieces(t)})


# ---------------------------------------------------------------- lines


def line_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows, least=40, documents=5):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[line_key(line)].add(-(1 << 63) if i is None else i)
    shared = {k: max(v) for k, v in holders.items() if len(k) >= least and len(v) >= documents}
    out = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if shared.get(line_key(x), i) == i]
        out[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def test_odd_lines_and_documents(spark):
    common, edge, short = "The Same Line of a Licence, which Many Have", "x" * 39 + "é", "y" * 39
    rows = [(i, f"own line {i}\n  {common}\t\n{common.upper()}\r\nlast {i}") for i in range(30)]
    rows += [(100 + i, f"{edge}\n{short}\nü{edge}") for i in range(6)] + [(200 + i, f"four documents have this line of some length\n{i}") for i in range(4)]
    rows += [(300, f"{common}\n" * 40), (300, f"{common}\nanother text of the id"), (300, f"{common}\nanother text of the id")]
    rows += [(None, f"{common}\nno id"), (None, common), (401, None), (402, ""), (403, "\n\n"), (404, common), (405, "z" * 200_000 + f"\n{common}\n")]
    df = frame(spark, rows)
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digests(df).collect())
    assert got == brute_lines(rows)
    assert line_dedup.line_digests(df.limit(0)).count() == 0


def test_a_line_of_most_documents_runs_over_many_partitions(spark):
    hot = "this line is in nearly all of the documents there are"
    rows = [(i, "\n".join([hot] * (1 + i % 3) + [f"line number {i // 6} which six documents have together", f"only {i}"])) for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_digests(frame(spark, rows).repartition(5)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute_lines(rows)


def test_streams_cut_anywhere():
    """Rows in order, cut into partitions between documents and into batches anywhere, give what brute force gives."""
    random_ = random.Random(2)
    for _ in range(150):
        rows = sorted({(random_.randrange(5), 0, -random_.randrange(9), 0, random_.randrange(4)) for _ in range(random_.randrange(1, 60))})
        rows = [(a, b, -d, t, n) for a, b, d, t, n in rows]
        docs = defaultdict(set)
        for a, _, d, _, _ in rows:
            docs[a].add(d)
        want = sorted(r for r in rows if len(docs[r[0]]) >= 3 and r[2] != max(docs[r[0]]))
        borders = [k for k in range(1, len(rows)) if rows[k][:3] != rows[k - 1][:3]]
        cuts = [0, *sorted(random_.sample(borders, min(len(borders), random_.randrange(4)))), len(rows)]
        told = []
        for part, (i, j) in enumerate(zip(cuts, cuts[1:])):
            stream = line_dedup._Stream(3)
            while i < j:
                k = min(j, i + random_.randrange(1, 9))
                stream.feed(np.array(rows[i:k], dtype=np.int64))
                i = k
            stream.end()
            told += [(kind, part, seen, tuple(r)) for kind, seen, x in stream.out for r in x.tolist()]
        seen, begins = Counter(), {}
        for kind, part, n, r in told:
            if kind == line_dedup.SEEN:
                seen[r[0]] += n
                begins[r[0]] = min(begins.get(r[0], part), part)
        got = [r for kind, part, _, r in told if kind == line_dedup.DROP or (kind in (line_dedup.OPEN, line_dedup.OPEN_FIRST) and seen[r[0]] >= 3 and (kind == line_dedup.OPEN or part > begins[r[0]]))]
        assert sorted(got) == want


def test_bitmaps_say_what_stays(spark):
    line = "a line which five documents or more have in common"
    df = frame(spark, [(i, "\n".join(["own", line, "more", "end"])) for i in range(6)] + [(9, "nothing shared")])
    maps = {r.doc: r for r in line_dedup.keep_bitmaps(df).collect()}
    assert set(maps) == set(range(5)) and {r.n_dropped for r in maps.values()} == {1}
    assert np.unpackbits(np.frombuffer(zlib.decompress(maps[2].keep), np.uint8)).tolist() == [1, 0, 1, 1, 1, 1, 1, 1]
    assert line_dedup.deduplicated(df).columns == [*df.columns, "kept_text", "n_lines", "n_dropped"]
