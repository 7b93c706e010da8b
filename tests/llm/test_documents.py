"""Operators on documents against brute force, with awkward input."""

import collections
import random
import hashlib
import itertools
import os
import zlib

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import chunk_dedup, jaccard_join, line_crf, mixing, packing, sharding, suffix_dedup

SPACES = " \t\n\x0b\x0c\r"


def split(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def grams(text):
    w = split(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- mixing ----


def test_mix_awkward(spark):
    rows = cases.got(mixing.mix(cases.documents(spark), carry=("text", "source", "label")))
    assert len(rows) == len(cases.texts())
    assert all(r["size"] == len(split(r["text"])) and 0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert all(sum(c["words"] for c in r["copies"]) == r["taken"] for r in rows)
    by = collections.defaultdict(lambda: [0, 0, None, None])
    for r in rows:
        s = by[r["source"]]
        s[0] += r["size"]
        s[1] += r["taken"]
        s[2], s[3] = r["target"], r["source_size"]
    for size, taken, target, source_size in by.values():
        assert size == source_size and abs(taken - target) <= 0.5
    assert sum(s[2] for s in by.values()) == pytest.approx(1.5 * sum(s[0] for s in by.values()))
    again = cases.got(mixing.mix(cases.documents(spark).repartition(3), carry=("text", "source", "label")))
    pick = lambda rs: sorted((str(r["doc_id"]), str(r["text"]), r["taken"], str(r["copies"])) for r in rs)
    assert pick(rows) == pick(again)


def test_mix_empty_and_weightless(spark):
    assert mixing.mix(cases.empty(spark)).count() == 0
    rows = cases.got(mixing.mix(cases.documents(spark, [(1, ""), (2, None)])))
    assert [r["taken"] for r in rows] == [0, 0] and all(r["target"] == 0 for r in rows)


def test_water_level_reshares_excess():
    got = mixing.water_level([10, 1000, 10], [5, 2, 1], 1.5, 2)
    assert got[0] == 20 and got[1] == pytest.approx(1490) and got[2] == 20


def test_splitting_tree_is_exact():
    counts = [7, 0, 33, 100]
    tickets = [(s, 0, b) for s, n in enumerate(counts) for b in range(n)]
    tree = mixing.splitting_tree(tickets, 8, 3)
    assert [sum(t[s] for t in tree) for s in range(4)] == counts
    assert {t.total() for t in tree} <= {17, 18}
    assert tree == mixing.splitting_tree(tickets, 8, 3)
    assert all(t.total() == 0 for t in mixing.splitting_tree([], 3, 1))


def test_splitting_tree_draws_hypergeometrically():
    tickets, halves = [(int(b < 30), b) for b in range(90)], []
    for seed in range(2000):
        halves.append(mixing.splitting_tree(tickets, 2, seed)[0][1])
    # 45 of 90 tickets, 30 of them of one kind: mean 15, variance 45 * 1/3 * 2/3 * 45/89
    assert abs(np.mean(halves) - 15) < 0.2 and abs(np.var(halves) - 45 * 2 / 9 * 45 / 89) < 0.6


def test_mix_reruns_agree_for_one_id_with_many_texts(spark):
    docs = [(7, " ".join(cases.words(1 + 3 * i % 29, 300 + i))) for i in range(59)]
    one = mixing.mix(cases.documents(spark, docs).withColumn("source", F.lit("s")), volume=1.3, carry=("text",))
    two = mixing.mix(cases.documents(spark, docs[::-1]).withColumn("source", F.lit("s")).repartition(5), volume=1.3, carry=("text",))
    pick = lambda df: sorted((r["text"], r["taken"], str(r["copies"])) for r in cases.got(df))
    assert pick(one) == pick(two) and any(0 < r["taken"] % r["size"] for r in cases.got(one))


def test_mix_takes_what_its_shards_take(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 6)
    docs = [(i, " ".join(cases.words(5 + i % 40, i))) for i in range(150)]
    rows = cases.got(mixing.mix(cases.documents(spark, docs), shards=5))
    parts = cases.got(mixing.emit(mixing.mix(cases.documents(spark, docs), shards=5), 3))
    taken = collections.Counter()
    for r in parts:
        taken[r["doc_id"]] += r["words"]
        assert 0 <= r["shard"] < 5 and 0 <= r["part"] < 3
    assert taken == collections.Counter({r["doc_id"]: r["taken"] for r in rows if r["taken"]})


def test_emit_has_a_row_for_each_copy(spark):
    mixed = mixing.mix(cases.documents(spark))
    want = sum(len(r["copies"]) for r in cases.got(mixed))
    out = cases.got(mixing.emit(mixed))
    assert len(out) == want and all(0 <= r["shard"] < 16 for r in out)


# ---- substring dedup ----


def test_chunks_cover_all_words():
    raw = ("  " + " ".join(cases.words(500, 9)) + " \n").encode()
    starts, ends, n = chunk_dedup.chunks(raw)
    assert n.sum() == 500 and (starts[1:] > ends[:-1]).all()
    assert b"".join(raw[a:b] for a, b in zip(starts, ends)).replace(b" ", b"") == raw.strip().replace(b" ", b"")


def test_chunks_resist_insertions():
    w = cases.words(2000, 10)
    parts = lambda ws: {(r := " ".join(ws).encode())[a:b] for a, b, _ in zip(*chunk_dedup.chunks(r))} if (r := " ".join(ws).encode()) else set()  # noqa: E731, F841
    a, b = parts(w), parts(w[:700] + ["inserted"] + w[700:])
    assert len(a & b) > 0.97 * len(a)


def test_gear_hash_depends_on_16_bytes():
    a, b = os.urandom(100), os.urandom(40)
    x = chunk_dedup.gear_hash(np.frombuffer(a, np.uint8))
    y = chunk_dedup.gear_hash(np.frombuffer(b + a, np.uint8))
    assert (x[15:] == y[len(b) + 15 :]).all() and (x[:15] != y[len(b) : len(b) + 15]).any()
    slow = 0
    for i, c in enumerate(a):
        slow = ((slow << 1) + int(chunk_dedup.GEAR[c])) & 0xFFFF
        assert slow == x[i]


def test_substring_dedup_awkward(spark):
    docs = cases.documents(spark)
    rows = cases.got(chunk_dedup.dedup(docs))
    assert len(rows) == len(cases.texts())
    assert [c for c in rows[0] if c != "dedup"] == [c for c in docs.columns if c != "dedup"]
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    old = dict(cases.texts())
    passage = cases.words(80, 2)
    assert by[1][0]["text"] == old[1] and by[2][0]["text"] == ""
    assert by[4][0]["text"] == old[4]
    left = set(split(by[5][0]["text"])) & set(passage)
    assert len(left) < 25 and by[5][0]["text"].startswith(" ".join(cases.words(50, 5)))
    for i in (6, 7, 8, 9, 10, 11, 13, 15):
        assert by[i][0]["text"] == old[i] and by[i][0]["dedup"]["removed"] == []
    assert sorted(r["text"] is None for r in by[None]) == [False, True]
    assert by[12][0]["text"] == by[12][1]["text"]
    for r in rows:
        raw, at, kept = (dict(cases.texts()).get(r["doc_id"]) or "").encode(), 0, b""
        if r["doc_id"] is not None and r["text"] is not None:
            for s in r["dedup"]["removed"]:
                kept, at = kept + raw[at : s["start"]], s["end"]
            assert kept + raw[at:] == r["text"].encode()
    assert chunk_dedup.dedup(cases.empty(spark)).count() == 0


def test_stock_words_are_no_passage(spark):
    r = np.random.default_rng(4)
    stock = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    docs = [(i, " ".join(stock[k] for k in r.integers(0, len(stock), 120))) for i in range(300)]
    docs.append((300, " ".join(split(docs[0][1])[:50] + split(docs[1][1])[:20] + split(docs[2][1])[:20])))
    rows = {x["doc_id"]: x["text"] for x in cases.got(chunk_dedup.dedup(cases.documents(spark, docs)))}
    seen = set()
    for i, text in docs:
        w = split(text)
        here = [tuple(w[k : k + 26]) for k in range(len(w) - 25)]
        held = {j for k, g in enumerate(here) if g in seen for j in range(k, k + 26)}
        assert len(w) - len(split(rows[i])) <= len(held)
        seen.update(here)
    assert all(rows[i] == text for i, text in docs[:300])
    assert len(split(rows[300])) < 90


def test_first_copy_within_a_document_stays_whole():
    passage = cases.words(80, 70)
    text = " ".join(passage + cases.words(30, 71) + passage)
    left, _, spans = chunk_dedup.strip(text, None, 26)
    assert len(spans) == 1 and left.startswith(" ".join(passage + cases.words(30, 71)))
    assert len(split(left)) < 135
    left, _, _ = chunk_dedup.strip("one two three four " * 100, None, 26)
    assert 26 <= len(split(left)) < 100


def brute_chunks(raw):
    """Chunks as (start, end, words): a chunk ends at a word's end whose gear hash is divisible by 3, or after 64 words."""
    ends, h, out, first, n = [], 0, [], None, 0
    for i, c in enumerate(raw):
        h = ((h << 1) + int(chunk_dedup.GEAR[c])) & 0xFFFF
        space, after = c in b" \t\n\x0b\x0c\r", i + 1 == len(raw) or raw[i + 1] in b" \t\n\x0b\x0c\r"
        if not space and after:
            ends.append((i + 1, h))
    at = 0
    for k, (end, h) in enumerate(ends):
        if first is None:
            first = at + next(j for j, c in enumerate(raw[at:]) if c not in b" \t\n\x0b\x0c\r")
        n, at = n + 1, end
        if h % 3 == 0 or n == 64 or k == len(ends) - 1:
            out.append((first, end, n))
            first, n = None, 0
    return out


def brute_strip(docs, least=26):
    """The rule of the substring dedup by hand, on the chunks' bytes: (id, text) -> removed byte spans."""
    owner, parts = {}, {}
    for i, text in docs:
        raw = text.encode()
        own = brute_chunks(raw)
        held = set()
        for a in range(len(own)):
            run = next((b for b in range(a + 1, len(own) + 1) if sum(x[2] for x in own[a:b]) >= least), None)
            if run:
                held.add((a, run))
        for b in range(1, len(own) + 1):
            run = next((a for a in range(b - 1, -1, -1) if sum(x[2] for x in own[a:b]) >= least), None)
            if run is not None:
                held.add((run, b))
        what = lambda a, b: tuple(raw[x[0] : x[1]] for x in own[a:b])  # noqa: B023, E731
        windows = [(a, b, what(a, b)) for a, b in sorted(held)]
        parts[i] = (raw, own, windows)
        for _, _, w in windows:
            owner[w] = min(owner.get(w, i), i)
    out = {}
    for i, (raw, own, windows) in parts.items():
        gone, first = set(), {}
        for a, b, w in windows:
            first.setdefault(w, b)
            if owner[w] < i or a >= first[w]:
                gone.update(range(a, b))
        spans = []
        for k in sorted(gone):
            start, end = own[k][0], own[k + 1][0] if k + 1 < len(own) else len(raw)
            if spans and spans[-1][1] == start:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((start, end))
        out[i] = spans
    return out


def test_substring_dedup_equals_brute_force(spark):
    r = np.random.default_rng(8)
    stock, passages = cases.words(40, 500), [cases.words(int(n), 600 + int(n)) for n in r.integers(27, 120, 12)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(int(r.integers(1, 6))):
            kind = r.integers(4)
            if kind == 0:
                parts += [stock[k] for k in r.integers(0, 40, int(r.integers(5, 60)))]
            elif kind == 1:
                parts += cases.words(int(r.integers(1, 90)), 1000 + 10 * i)
            else:
                p = passages[r.integers(len(passages))]
                parts += p[int(r.integers(3)) :] if kind == 2 else p
        docs.append((i, " ".join(parts) + ("\n é " if i % 5 == 0 else "")))
    docs += [(70, "\n".join(cases.words(400, 71)) + " x" * 200), (71, docs[3][1]), (72, " " * 50), (73, "")]
    got = {x["doc_id"]: [(s["start"], s["end"]) for s in x["dedup"]["removed"]] for x in cases.got(chunk_dedup.dedup(cases.documents(spark, docs)))}
    want = brute_strip(docs)
    assert got == want and sum(map(bool, want.values())) > 20


# ---- packing ----


def test_pack_awkward(spark, tokenizer):
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(tokenizer)
    bpe.encode_special_tokens = True
    extra = [(20, "<|endoftext|> it's 12 they'll  two\n\n three\t"), (21, "é" * 3000), (22, " x　y")]
    docs = cases.texts() + extra
    rows = cases.got(packing.packed_digests(cases.documents(spark, docs), tokenizer))
    want = collections.Counter()
    for i, t in docs:
        ids = bpe.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        for p, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert want == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.packed_digests(cases.empty(spark), tokenizer).count() == 0


def test_encoder_equals_tokenizers(tokenizer):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(tokenizer)
    bpe.encode_special_tokens = True
    code = packing.encoder(tokenizer)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
    def same(text):
        assert code.encode_ordinary(text) == bpe.encode(text, add_special_tokens=False).ids

    same()


def test_long_texts_have_the_same_ids(tokenizer):
    code, text = packing.encoder(tokenizer), " ".join(cases.words(30_000, 3))
    assert code.encode_to_numpy(text).tolist() == code.encode_ordinary(text)


def test_added_tokens_have_their_ids(spark, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    from keyloom.llm import registry

    bpe = Tokenizer.from_file(tokenizer)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>\n x", "end <|endoftext|>", "<|endoftext", "it's  plain \n\n"]
    texts.append("word <|endoftext|> " * 60_000)
    cases.documents(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    want = collections.Counter()
    for i, t in enumerate(texts):
        ids = bpe.encode(t, add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        for p, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[i, p, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = cases.got(registry.op4_pack(spark, str(tmp_path), tokenizer))
    assert want == collections.Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert bpe.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    r = np.random.default_rng(seed)
    top = [2048, 300, 2048, 1100, 2047, 60][seed]
    n = [500, 400, 3, 1000, 2000, 5][seed]
    lengths = collections.Counter(r.integers(1, top + 1, n).tolist())
    runs = packing.best_plan(lengths)
    seen, bins = collections.Counter(), collections.defaultdict(list)
    for length, low, high, base, offset in runs.rows():
        for i in range(low, high):
            seen[length, i] += 1
            bins[base + i - low].append((offset, length))
    assert seen == collections.Counter((x, i) for x, c in lengths.items() for i in range(c))
    assert sorted(bins) == list(range(runs.bins()))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert runs.bins() <= packing.plan(lengths, short=1.0).bins()  # best fit alone


def test_sequences_join_ids(spark, tokenizer):
    pieces = packing.tokenise(cases.documents(spark, cases.texts()[:5]), tokenizer)
    packed = packing.pack(pieces)
    total = sum(len(r["ids"]) for r in cases.got(pieces))
    assert sum(len(r["ids"]) for r in cases.got(packing.sequences(packed))) == total


# ---- suffix dedup ----


def brute_repeats(docs, least=200):
    seen = collections.Counter(b[i : i + least] for _, b in docs for i in range(len(b) - least + 1))
    out = []
    for i, b in docs:
        runs = []
        for s in range(len(b) - least + 1):
            if seen[b[s : s + least]] > 1:
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = s + least
                else:
                    runs.append([s, s + least])
        kept, at = b"", 0
        for a, e in runs:
            kept, at = kept + b[at:a], e
        kept += b[at:]
        out.append((i, len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def suffix_rows(docs, **setting):
    rows = cases.got(suffix_dedup.dedup(docs, **setting))
    return collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows)


def test_suffix_dedup_awkward(spark):
    docs = cases.texts() + [(30, "ab" * 99 + "c"), (31, "xab" * 66 + "ab"), (32, "é" * 150), (33, "é" * 100), (34, "z" * 199)]
    assert suffix_rows(cases.documents(spark, docs)) == brute_repeats([(i, (t or "").encode()) for i, t in docs])
    assert suffix_dedup.dedup(cases.empty(spark)).count() == 0


def test_suffix_dedup_hot_anchor_is_exact(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 500)
    shared = " ".join(cases.words(45, 40))
    docs = [(i, f"{i} " * (i % 7) + shared[i % 5 :] + f" tail {i % 3} " + "q" * (i % 50)) for i in range(40)]
    assert suffix_rows(cases.documents(spark, docs)) == brute_repeats([(i, t.encode()) for i, t in docs])
    awkward = cases.texts() + [(30, "ab" * 400), (31, "xab" * 300 + "ab"), (32, "é" * 150), (33, "q" + "é" * 130)]
    assert suffix_rows(cases.documents(spark, awkward)) == brute_repeats([(i, (t or "").encode()) for i, t in awkward])


@pytest.mark.parametrize("seed", range(3))
def test_repeated_equals_brute_force(seed):
    r = np.random.default_rng(seed)
    pool = [bytes(r.integers(97, 99 + seed, 230).astype(np.uint8)) for _ in range(4)]
    parts = [pool[r.integers(4)][r.integers(30) :] + bytes(r.integers(97, 99, r.integers(40)).astype(np.uint8)) for _ in range(12)]
    ends = np.cumsum([len(p) for p in parts])
    hit = suffix_dedup.repeated(np.frombuffer(b"".join(parts), np.uint8), np.r_[0, ends[:-1]], ends)
    seen = collections.Counter(p[i : i + 200] for p in parts for i in range(len(p) - 199))
    want = [i + 200 <= len(p) and seen[p[i : i + 200]] > 1 for p in parts for i in range(len(p))]
    assert hit.tolist() == want


# ---- n-gram Jaccard join ----


def brute_classes(docs):
    n = len(docs)
    sets = [grams(t) for _, t in docs]
    like = lambda a, b: sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])) > 0
    links, root = [0] * n, list(range(n))
    for a, b in itertools.combinations(range(n), 2):
        if like(a, b):
            links[a] += 1
            links[b] += 1
            ra, rb = root[a], root[b]
            root = [ra if r == rb else r for r in root]
    return links, root


def test_jaccard_awkward(spark):
    docs = [(i, t) for i, t in cases.texts() if i is not None]
    rows = cases.got(jaccard_join.similar(cases.documents(spark, docs)))
    links, root = brute_classes(docs)
    least = {r: min(docs[i][0] for i in range(len(docs)) if root[i] == r) for r in set(root)}
    want = collections.Counter((docs[i][0], least[root[i]], links[i]) for i in range(len(docs)))
    assert want == collections.Counter((r["doc_id"], r["class_id"], r["links"]) for r in rows)
    rows = cases.got(jaccard_join.similar(cases.documents(spark)))
    assert len(rows) == len(cases.texts()) and sum(r["doc_id"] is None for r in rows) == 2
    assert jaccard_join.similar(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("large,block", [(2000, 512), (6, 4)])
def test_jaccard_near_copies_equal_brute_force(spark, monkeypatch, large, block):
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    base, docs = cases.words(150, 50), []
    for i in range(60):
        w = base.copy()
        for k in range(i % 6):
            w[(37 * i + 23 * k) % 150] = f"x{i}-{k}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(cases.words(20, 60 + i) + base[:60])) for i in range(20)]
    rows = {r["doc_id"]: (r["class_id"], r["links"]) for r in cases.got(jaccard_join.similar(cases.documents(spark, docs)))}
    links, root = brute_classes(docs)
    assert rows == {docs[i][0]: (docs[root[i]][0], links[i]) for i in range(len(docs))}


def test_jaccard_misses_few_pairs_at_every_depth():
    assert jaccard_join.AGREE <= 2
    assert all(jaccard_join.missed(0.8, d) < 1e-6 for d in range(1, jaccard_join.MAX_DEPTH + 1))
    r = np.random.default_rng(3)
    runs, kids = jaccard_join.RUNS, jaccard_join.CHILDREN
    a = r.random((100_000, runs, 1 + kids + kids * kids)) < 0.35  # patterns of agreement, at a similarity with many misses
    met = a[:, :, 0] & np.any([a[:, :, 1 + c] & a[:, :, 1 + kids + kids * c : 1 + kids + kids * (c + 1)].any(axis=2) for c in range(kids)], axis=0)
    found = met.any(axis=1) & (a[:, :, 0].sum(axis=1) >= jaccard_join.AGREE)
    assert abs((~found).mean() - jaccard_join.missed(0.35, 3)) < 0.01


def test_jaccard_paths_use_tokens_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LARGE", 3)
    base = cases.words(200, 90)
    docs = [(i, " ".join(base[: 190 + i] + [f"y{i}"])) for i in range(8)]
    keyed = cases.documents(spark, docs).selectExpr("doc_id", "doc_id AS key", "xxhash64(text) AS hash", "text")
    nodes = keyed.mapInArrow(jaccard_join._sketch, jaccard_join.COLUMNS_OF_SKETCH)
    rows = cases.got(jaccard_join._buckets(nodes))
    got = collections.defaultdict(set)
    for x in rows:
        got[x["path"]].add(x["node"])
    want = collections.defaultdict(set)
    for _, text in docs:
        g = jaccard_join.gram_set(text.encode())
        t = jaccard_join.sampled(g).tolist()
        for run in range(12):
            for c in range(2):
                for d in range(2):
                    s = run * 2 + c
                    want[run, t[run], c, t[12 + s], d, t[36 + s * 2 + d]].add(jaccard_join.xxhash.xxh3_128_digest(g.tobytes()))
    deep = collections.Counter(frozenset(s) for s in want.values() if len(s) > 3)
    assert deep and deep == collections.Counter(frozenset(s) for s in got.values() if len(s) > 3)


# ---- quality ----


def test_quality_held_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = line_crf.train(docs, labels)
    rows = cases.got(line_crf.score(docs, field).withColumn("held", line_crf.held_out()).join(labels.drop("toxic"), "doc_id"))
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held"]]
    assert sum((r["score"] >= 0.7) == r["quality"] for r in held) > 0.95 * len(held)
    assert sum(r["score"] >= 0.7 for r in held if r["quality"]) > 0.97 * sum(r["quality"] for r in held)


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (6, 1), (12, 0), (12, 0), (None, 1), (7, None), (99, 0)], "doc_id long, quality int")
    field = line_crf.train(cases.documents(spark), labels)
    rows = cases.got(line_crf.score(cases.documents(spark), field))
    assert len(rows) == len(cases.texts()) and all(0 <= r["score"] <= 1 for r in rows)
    none = line_crf.train(cases.documents(spark), labels.limit(0))
    assert {r["score"] for r in cases.got(line_crf.score(cases.documents(spark), none))} == {0.5}
    assert line_crf.score(cases.empty(spark), field).count() == 0
    assert line_crf.train(cases.empty(spark), labels).weights.sum() == 0


def test_quality_labels_of_other_documents_count_for_nothing(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    foreign = spark.range(1_000_000, 1_050_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    alone = line_crf.train(docs, labels, sample=100)
    among = line_crf.train(docs, labels.selectExpr("doc_id", "CAST(quality AS INT) AS quality").unionByName(foreign), sample=100)
    assert np.count_nonzero(alone.weights) > 50 and (alone.weights == among.weights).all() and (alone.transition == among.transition).all()
    with pytest.raises(ValueError, match="no label is of a document"):
        line_crf.train(docs, foreign)


def test_quality_features_and_scores_equal_plain_loops():
    r = random.Random(3)
    pool = ["the the cat", "", "a b a b", "!!! 12 %%", "Ünï words here", "the the cat", "x"]
    texts = ["\n".join(r.choices(pool, k=r.randrange(1, 6))) for _ in range(30)] + [""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    x, length, per_text = line_crf.line_features(data, np.cumsum([len(t.encode()) for t in texts]))
    lines = [line.encode() for t in texts for line in t.split("\n")]
    assert per_text.tolist() == [t.count("\n") + 1 for t in texts] and length.tolist() == [max(1, len(line)) for line in lines]
    c = line_crf.C
    share = lambda line: np.array([sum(line_crf.CLASS[b] == k for b in line) / max(1, len(line)) for k in range(c)])
    one = np.array([share(line) for line in lines])
    assert np.allclose(x[:, c * c : c * c + c], one, atol=1e-6)
    at = 0
    for t in texts:
        own = [line.encode() for line in t.split("\n")]
        for k, line in enumerate(own):
            row = x[at + k]
            before, after = (share(own[k - 1]) if k else 0, share(own[k + 1]) if k + 1 < len(own) else 0)
            assert np.allclose(row[c * c + c : c * c + 2 * c], np.sqrt(before), atol=1e-5) and np.allclose(row[c * c + 2 * c : c * c + 3 * c], np.sqrt(after), atol=1e-5)
            assert row[c * c + 3 * c] == pytest.approx(np.log1p(len(line)) / 5, abs=1e-5)
            w = line.split()
            same = sum(a == b for a, b in zip(w, w[1:])) / max(1, len(w))
            known = (len(w) - len(set(w))) / max(1, len(w))
            want = [1, bool(line) and own.count(line) > 1, not line, same, known, known**2]
            assert np.allclose(row[c * c + 3 * c + 1 :], want, atol=1e-5)
        at += len(own)
    field = line_crf.Field(np.random.default_rng(1).normal(size=x.shape[1]).astype(np.float32), np.array([[0.5, -0.3], [0.1, 0.8]]))
    got, at = line_crf.scores(field, x, length, per_text), 0
    for n, k in enumerate(per_text.tolist()):
        score = (x[at : at + k] @ field.weights).astype(float)
        weight = {}
        for path in itertools.product((0, 1), repeat=k):
            weight[path] = np.exp(sum(s for s, y in zip(score, path) if y) + sum(field.transition[a, b] for a, b in zip(path, path[1:])))
        total = sum(weight.values())
        good = [sum(w for p, w in weight.items() if p[i]) / total for i in range(k)]
        assert got[n] == pytest.approx(np.dot(good, length[at : at + k]) / length[at : at + k].sum(), abs=1e-6)
        at += k


def test_quality_long_documents_displace_no_others(spark, monkeypatch):
    monkeypatch.setattr(line_crf, "SAMPLE_LINES", 600)
    good = lambda i, n: "\n".join(" ".join(f"plain{k % 7} words" for k in range(i + j % 5 + 3)) for j in range(n))
    bad = lambda i, n: "\n".join("!!! ### 12%% " * (i % 4 + j % 3 + 1) for j in range(n))
    docs = [(i, good(i, 6) if i % 2 else bad(i, 6)) for i in range(40)]
    docs += [(100 + i, good(i, 2000) if i % 2 else bad(i, 2000)) for i in range(12)]
    docs += [(200, good(i, 3)) for i in range(400)] + [(201, bad(1, 3))] * 400
    labels = spark.createDataFrame([(i, 0 if i == 201 else 1 if i == 200 else i % 2) for i in {i for i, _ in docs}], "doc_id long, quality int")
    used = []
    fit = line_crf.fit
    monkeypatch.setattr(line_crf, "fit", lambda x, n, y: used.append((n, y)) or fit(x, n, y))
    field = line_crf.train(cases.documents(spark, docs), labels)
    (n, y), = used
    kept = [i for i in {i for i, _ in docs} if zlib.crc32(str(i).encode()) % 4 != 2]
    assert n.sum() <= 600 and len(n) >= len(kept) and set(y.tolist()) == {0, 1}
    assert (n == 6).sum() >= sum(i < 40 for i in kept)
    rows = cases.got(line_crf.score(cases.documents(spark, docs[:40]), field))
    assert all((r["score"] >= 0.5) == r["doc_id"] % 2 for r in rows)


def test_line_bound():
    assert line_crf.line_bound([1, 2, 3], 100) == 3 and line_crf.line_bound([5, 10**9, 7], 30) == 18
    assert line_crf.line_bound([10**9], 200) == 200 and line_crf.line_bound([], 5) == 1


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    per_text, transition = np.array([1, 4, 3]), r.normal(size=(2, 2))
    score = r.normal(size=8)
    good, pairs, total = line_crf.marginals(score, per_text, transition)
    want, moves, log_z, at = np.zeros(8), np.zeros((2, 2)), 0.0, 0
    for n in per_text:
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weight = [np.exp(sum(score[at + i] * y for i, y in enumerate(p)) + sum(transition[a, b] for a, b in itertools.pairwise(p))) for p in paths]
        z = sum(weight)
        log_z += np.log(z)
        for p, w in zip(paths, weight):
            want[at : at + n] += np.array(p) * w / z
            for a, b in itertools.pairwise(p):
                moves[a, b] += w / z
        at += n
    assert np.allclose(good, want) and np.allclose(pairs, moves) and np.isclose(total, log_z)


# ---- sharding ----


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_shards_awkward(spark, shards):
    rows = cases.got(sharding.shard_by_bytes(cases.documents(spark), shards))
    docs = cases.texts()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert want == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) and 0 <= k < shards for k, s in slots.items())
    assert sharding.shard_by_bytes(cases.empty(spark), shards).count() == 0


@pytest.mark.parametrize("shares", [(0.33,), (0.02, 0.3, 0.5, 0.9), (0.6,) * 20, (0.999,), (0.97,) * 15])
def test_groups_stay_whole_while_a_shard_has_room(spark, shares):
    shards, mean = 8, 40_000
    copies = [max(2, int(s * mean / 100)) for s in shares]
    docs = [(n * 10_000 + i, f"{n:03}" + "g" * 96) for n, c in enumerate(copies) for i in range(c)]
    rest = shards * mean - 100 * len(docs)
    r = np.random.default_rng(2)
    while rest > 0:
        n = int(min(rest, r.integers(20, 400)))
        docs.append((1_000_000 + rest, "x" * max(0, n - 8) + f"{rest:07}"[: max(0, n - 1)]))
        rest -= len(docs[-1][1]) + 1
    total = sum(len(t) + 1 for _, t in docs)
    rows = cases.got(sharding.shard_by_bytes(cases.documents(spark, docs), shards))
    text, size, slots, at = dict(docs), collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for x in rows:
        size[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        at[text[x["doc_id"]]].add(x["shard"])
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(size[s] - total / shards) <= max(400, 2 * sharding.HEAVY * total / shards) for s in range(shards))
    of = [at[f"{n:03}" + "g" * 96] for n in range(len(shares))]
    heavy = sorted(copies, reverse=True)
    room, fits = [0] * shards, []
    for c in heavy:
        k = room.index(min(room))
        fits.append((room[k] + c * 100) * shards <= total)
        room[k] += c * 100 * fits[-1]
    assert sum(len(s) == 1 for s in of) >= sum(fits)
    assert all(len(at[text[x["doc_id"]]]) == 1 for x in rows if x["whole"])


def test_group_larger_than_a_shard_is_cut(spark):
    docs = [(i, "hot text " * 20) for i in range(2000)] + [(5000 + i, f"{i} " * 40) for i in range(3000)]
    rows = cases.got(sharding.shard_by_bytes(cases.documents(spark, docs), 16))
    size = collections.Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert {r["whole"] for r in rows if r["doc_id"] < 5000} == {False}
    assert max(size.values()) - min(size.values()) <= 0.05 * sum(size.values()) / 16


def test_shards_are_even_and_keep_groups(spark):
    docs = [(i, "x" * (50 + i * 37 % 400) if i % 3 else "hot text " * 20) for i in range(6000)]
    docs += [(10_000 + i, f"copy {i // 2}") for i in range(200)]
    rows = cases.got(sharding.shard_by_bytes(cases.documents(spark, docs), 16))
    size, place = collections.Counter(), collections.defaultdict(set)
    for r in rows:
        size[r["shard"]] += r["size"]
        if r["doc_id"] >= 10_000:
            place[r["text_crc32"]].add(r["shard"])
    assert max(size.values()) - min(size.values()) <= 0.05 * sum(size.values()) / 16
    assert len(size) == 16 and all(len(s) == 1 for s in place.values())
    again = cases.got(sharding.shard_by_bytes(cases.documents(spark, docs).repartition(5), 16))
    pick = lambda rs: sorted((r["doc_id"], r["shard"], r["slot"]) for r in rs)
    assert pick(rows) == pick(again)




# ---- rows that are repeated very often ----


def most_rows_of_a_task(df, *keys):
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0]


def test_repeated_rows_are_dealt_over_salts_and_ranges(spark, monkeypatch):
    seen = {}
    rows = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'' AS text").unionByName(
        spark.range(500).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    )
    kept = packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: seen.setdefault(name, kept(df, name)))
    pieces = rows.selectExpr("doc_id", "CAST(length(text) + 1 AS INT) AS length").withColumn(packing.LOT, F.floor(F.rand(1) * (1 << 30)).cast("int"))
    pieces = kept(pieces, "pieces")
    packed = packing.pack(pieces)
    assert packing.LOT not in packed.columns and packed.count() == 20_500
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("k"), F.count("*").alias("m"))
    assert ends.filter("n <> end OR k <> m OR n > 2048").count() == 0
    spread = sharding.spread(kept(sharding.narrow(rows).withColumn("lot", F.rand(1)), "narrow"), 20_500 // 64)
    assert most_rows_of_a_task(spread, "group", "place") <= 2
    put = sharding.shard_by_bytes(rows, 8)
    assert put.count() == 20_500
    slots = put.groupBy("shard").agg(F.max("slot").alias("m"), F.countDistinct("slot").alias("n"), F.sum("size").alias("s")).collect()
    assert all(r.m + 1 == r.n for r in slots) and max(r.s for r in slots) - min(r.s for r in slots) < 3000


def test_jaccard_bucket_goes_to_few_pairs_of_blocks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(2000).select(F.col("id").cast("string").cast("binary").alias("node"), F.lit(2000).alias("count"))
    short, long = (jaccard_join._in_blocks(rows.withColumn("volume", F.lit(v))) for v in (100_000, 4 * jaccard_join.GRAMS))
    assert short.count() == 2 * 2000  # not once for each of eight blocks
    assert long.count() == 4 * 2000 and long.select("block").distinct().count() == 4
