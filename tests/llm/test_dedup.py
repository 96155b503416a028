"""Exact, passage and near duplicates against brute force."""
import hashlib
import random
import re

import numpy as np
import pytest

from insolvia.llm import components, exactdedup, setsketch, substring

WHITE = r"[\x20\x09-\x0D]"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def copies(rng):
    """Texts with exact copies, copies in other white space and lightly edited copies."""
    base = [words(rng, rng.randint(5, 90)) for _ in range(25)]
    out = list(base)
    for _ in range(60):
        t = rng.choice(base).split()
        kind = rng.randrange(3)
        if kind == 1:
            t[rng.randrange(len(t))] = "edited"
        out.append(("  " if kind == 2 else " ").join(t))
    return out + [None, "", " \n ", "one", "ONE", "one two"]


# exact copies


def test_exact_groups_equal_brute_force(documents):
    texts = copies(random.Random(1))
    rows = exactdedup.duplicate_groups(documents(texts)).collect()
    norm = [re.sub(WHITE, "", t or "") for t in texts]
    assert len(rows) == len(texts)
    for r in rows:
        same = [i for i, n in enumerate(norm) if n == norm[r.doc_id]]
        keep = min(same, key=lambda i: (-len(texts[i] or ""), i))
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), keep == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_exact_group_plan_has_no_python(documents):
    plan = exactdedup.duplicate_groups(documents(["a", "a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_exact_awkward_rows(awkward):
    rows = exactdedup.duplicate_groups(awkward).collect()
    assert len(rows) == awkward.count()
    short = [r for r in rows if r.text_sha256 == hashlib.sha256(b"shorttext").hexdigest()]
    assert {r.group_size for r in rows if r.doc_id in (0, 1, 2)} == {4} and len(short) == 4 and {r.keep_id for r in short} == {3} and sum(r.kept for r in short) == 2  # id 3 stands twice
    kept = exactdedup.drop_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 7]


def test_exact_null_ids_come_last(documents):
    rows = exactdedup.duplicate_groups(documents([(None, "a b"), (9, "ab"), (None, "z")])).collect()
    by = {(r.doc_id, r.text_sha256): r for r in rows}
    a = hashlib.sha256(b"ab").hexdigest()
    assert by[None, a].keep_id is None and by[9, a].keep_id is None  # more code points win before ids
    tie = exactdedup.duplicate_groups(documents([(None, "ab"), (9, "ab"), (-5, "ab")])).collect()
    assert {r.keep_id for r in tie} == {-5}


def test_exact_extreme_ids(documents):
    big = (1 << 63) - 1
    rows = exactdedup.duplicate_groups(documents([(big, "a"), (-big - 1, "a"), (None, "a")])).collect()
    assert {r.keep_id for r in rows} == {-big - 1}
    rows = exactdedup.duplicate_groups(documents([(big, "a"), (None, "a")])).collect()
    assert {r.keep_id for r in rows} == {big}


def test_exact_digest_collision_keeps_texts_apart(documents, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exactdedup.F, "md5", lambda c: F.lit("00" * 16))
    rows = exactdedup.duplicate_groups(documents(["a", "b", "a ", "b", "c"])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows) == [(0, 2, 2), (1, 1, 2), (2, 2, 2), (3, 1, 2), (4, 4, 1)]


# repeated passages


def removed_by_brute_force(texts, span):
    """texts: (id, words). Words that stay, by row."""
    first = {}
    for ident, w in texts:
        for i in range(len(w) - span + 1):
            k = tuple(w[i : i + span])
            first[k] = min(first.get(k, ident), ident)
    out = []
    for ident, w in texts:
        gone = set()
        for i in range(len(w) - span + 1):
            if first[tuple(w[i : i + span])] < ident:
                gone.update(range(i, i + span))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def passages(rng, span):
    shared = [words(rng, rng.randint(span - 2, 3 * span), 60) for _ in range(4)]
    out = []
    for _ in range(40):
        parts = [words(rng, rng.randint(0, 2 * span), 60)] + [p for _ in range(rng.randrange(3)) for p in (rng.choice(shared), words(rng, rng.randint(0, span), 60))]
        out.append("\t ".join(p for p in parts if p))
    return out + ["same " * 3 * span, "same " * 2 * span, "", None]


@pytest.mark.parametrize("span,core,bucket", [(10, 3, 20_000), (10, 3, 5), (7, 7, 20_000), (12, 1, 3)])
def test_passages_equal_brute_force(documents, span, core, bucket):
    texts = passages(random.Random(span + core), span)
    rows = {r.doc_id: r for r in substring.remove_repeats(documents(texts), span=span, core=core, bucket_strings=bucket).collect()}
    want = removed_by_brute_force([(i, (t or "").split()) for i, t in enumerate(texts)], span)
    for i, kept in enumerate(want):
        assert rows[i].kept_text == " ".join(kept)
        assert (rows[i].n_words, rows[i].n_removed) == (len((texts[i] or "").split()), len((texts[i] or "").split()) - len(kept))
        assert rows[i].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert any(r.n_removed for r in rows.values())


@pytest.mark.parametrize("limit", [1, 400, 64 << 20])
def test_buckets_are_bounded_by_bytes(documents, limit):
    texts = [(i, t) for i, t in enumerate(passages(random.Random(9), 10))]
    rows = {r.doc_id: r for r in substring.remove_repeats(documents(texts), span=10, core=3, bucket_bytes=limit).collect()}
    want = removed_by_brute_force([(i, (t or "").split()) for i, t in texts], 10)
    assert [rows[i].kept_text for i, _ in texts] == [" ".join(kept) for kept in want]


def test_a_common_passage_is_looked_up_by_runs_not_by_window(documents):
    """Every place meets one row, and windows of one smallest id side by side are one hit, in crowded buckets too."""
    rng = random.Random(3)
    common = " ".join(f"p{i}" for i in range(40))
    texts = [f"{words(rng, 12, 500)} {common} {words(rng, 12, 500)}" for _ in range(30)]
    for bucket in (1, 20_000):
        rows = substring.repeated_windows(documents(texts), span=10, core=3, bucket_strings=bucket).collect()
        assert sorted(r.id for r in rows) == list(range(1, 30))  # one row per text
        for r in rows:
            covered = sorted(k for h in r.hits for k in range(h.low, h.high + 1))
            assert covered == list(range(12, 43))  # each of the 31 windows once
            assert len(r.hits) <= 12  # at most one a super-k-mer


def test_a_text_that_repeats_itself_is_cut_into_bounded_strings(documents):
    rng = random.Random(4)
    cycle = [f"c{i}" for i in range(7)]
    texts = [
        (1, "one " * 3_500), (2, "one " * 2_777 + "end"), (3, " ".join(cycle * 900)), (4, "other " + " ".join((cycle * 500)[3:])),
        (5, " ".join(rng.choice("ab") for _ in range(2_500))),
    ]
    rows = {r.doc_id: r for r in substring.remove_repeats(documents(texts), span=10, core=3).collect()}
    want = removed_by_brute_force([(i, t.split()) for i, t in texts], 10)
    assert [rows[i].kept_text for i, _ in texts] == [" ".join(kept) for kept in want]
    data = b"one " * 5_000
    starts = np.arange(0, 20_000, 4)
    _, _, windows, _ = substring._super_kmers(np.frombuffer(data, np.uint8), starts, starts + 3, np.array([0, 5_000]), 10, 3)
    assert windows.max() == substring.MAX_WINDOWS and windows.sum() == 5_000 - 9


def test_passages_awkward_rows(awkward, nothing):
    rows = substring.remove_repeats(awkward).collect()
    assert len(rows) == awkward.count()
    by = {(r.doc_id, r.n_words): r.n_removed for r in rows}
    assert by[5, 80_000] == 0 and by[6, 80_000] == 80_000 and by[None, 2] == 0
    assert substring.remove_repeats(nothing).collect() == []


def test_repeated_rows_of_one_id_do_not_remove_each_other(documents):
    text = " ".join(f"w{i}" for i in range(60))
    rows = substring.remove_repeats(documents([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, 60)]


# near copies


def components_by_brute_force(texts, size, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    part = list(range(len(texts)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                part[y] = x
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("size,similarity", [(3, 0.85), (5, 0.8)])
@pytest.mark.parametrize("block", [4_096, 7])
def test_near_groups_equal_brute_force(documents, size, similarity, block):
    rng = random.Random(block)
    base = words(rng, 120).split()
    texts = copies(rng)
    for _ in range(60):  # a family of edits whose members are not all linked
        t = list(base)
        for _ in range(rng.randrange(8)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(9)}"
        texts.append(" ".join(t))
    rows = {r.doc_id: r for r in setsketch.near_duplicates(documents(texts), size=size, similarity=similarity, block=block).collect()}
    n, part = components_by_brute_force(texts, size, round(100 * similarity))
    assert [rows[i].n_shingles for i in range(len(texts))] == n
    assert [rows[i].component_id for i in range(len(texts))] == part
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.values())


def test_near_awkward_rows(awkward, nothing):
    rows = setsketch.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.component_id for r in rows if r.n_shingles == 1 and r.doc_id in (3, 4, None)} == {3}
    kept = setsketch.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 0), (False, 1), (False, 2), (False, 3), (False, 5), (False, 7), (True, None)]
    assert setsketch.near_duplicates(nothing).collect() == [] and setsketch.keep_one(nothing).collect() == []


def test_sketches_merge():
    a, b = (np.random.default_rng(k).integers(0, 1 << 62, 300).astype(np.uint64) for k in (1, 2))
    both = np.unique(np.concatenate([a, b]))
    assert (setsketch.merged(setsketch.sketch(a), setsketch.sketch(b)) == setsketch.sketch(both)).all()


def test_short_sketches_begin_long_ones():
    shingles = np.random.default_rng(8).integers(0, 1 << 62, 300).astype(np.uint64)
    assert (setsketch.sketch(shingles, 96) == setsketch.sketch(shingles, 512)[:96]).all()


def test_joint_estimate_is_close():
    r = np.random.default_rng(3)
    common, x, y = (r.integers(0, 1 << 62, k).astype(np.uint64) for k in (800, 100, 150))
    a, b = np.concatenate([common, x]), np.concatenate([common, y])
    found = setsketch.joint_estimate(setsketch.sketch(a), setsketch.sketch(b), len(a), len(b))
    assert abs(found - 800 / 1050) < 0.1


def counts(a, b):
    x, y = setsketch.sketch(a), setsketch.sketch(b)
    return np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([len(a)]), np.array([len(b)])


def test_slope_of_the_likelihood_tells_where_its_maximum_lies():
    r = np.random.default_rng(11)
    for _ in range(60):
        common, x, y = (r.integers(0, 1 << 62, int(k)).astype(np.uint64) for k in (r.integers(100, 600), r.integers(1, 120), r.integers(1, 120)))
        a, b = np.concatenate([common, x]), np.concatenate([common, y])
        up, down, n, m = counts(a, b)
        best = setsketch.joint_estimate(setsketch.sketch(a), setsketch.sketch(b), len(a), len(b))
        for asked in (0.5, 0.7, 0.85):
            cut = min(asked, min(len(a), len(b)) / max(len(a), len(b))) - 0.5 / setsketch.REGISTERS
            if abs(best - cut) > 0.01:  # the grid's step
                assert setsketch.reaches(asked, up, down, n, m, setsketch.REGISTERS, errors=0.0)[0] == (best >= cut)


def test_links_are_not_lost_to_the_estimate():
    r = np.random.default_rng(12)
    for size in (4, 10, 50, 400):
        for _ in range(40):
            only = max(1, size // 8)
            common, x, y = (r.integers(0, 1 << 62, int(k)).astype(np.uint64) for k in (8 * only, only, only if r.random() < 0.5 else 0))
            a, b = np.concatenate([common, x]), np.concatenate([common, y])
            assert setsketch.reaches(0.8, *counts(a, b), setsketch.REGISTERS)[0]
    far = [r.integers(0, 1 << 62, 400).astype(np.uint64) for _ in range(2)]
    assert not setsketch.reaches(0.8, *counts(*far), setsketch.REGISTERS)[0]


def test_null_and_repeated_ids_keep_their_documents(documents):
    """Clean documents stay whatever their ids; only texts that are like another one go."""
    one, two, three, four = (f"{w} alpha beta {w} gamma delta {w} epsilon zeta {w}" for w in ("red", "blue", "green", "white"))
    docs = documents([(1, one), (7, two), (7, three), (None, four), (None, one), (None, "lone words"), (None, "lone words"), (9, three), (8, None), (8, ""), (None, None)])
    kept = sorted((r.doc_id is None, r.doc_id, r.text or "") for r in setsketch.keep_one(docs).collect())
    assert kept == [(False, 1, one), (False, 7, *[t for t in (min(two, three), )]), (False, 7, max(two, three)), (False, 8, ""), (True, None, ""), (True, None, "lone words"), (True, None, four)]


def test_many_null_ids_are_one_row_each(documents):
    docs = documents([(None, f"text number {i} with words {i * 7} and {i * 13}") for i in range(200)] + [(3, "another text")])
    assert setsketch.keep_one(docs).count() == 201


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(5, 3), (3, 9), (4, 4)]
    parts = {r.node: r.part for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {parts[i] for i in range(100, 141)} == {100} and {parts[k] for k in range(200, 260)} == {7} and parts[9] == parts[5] == 3 and 4 not in parts
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
