"""Language, licences, toxicity, decontamination, BPE, token files and urls against brute force."""
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from insolvia.llm import bpe, decontam, langid, license, tokenfile, toxicity, urlfilter
from insolvia.llm.words import ALNUM

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def sentences(rng, syllables, n):
    return [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60))) for _ in range(n)]


# language


@pytest.fixture
def tongues(spark):
    rng = random.Random(4)
    rows = [(t, "aa") for t in sentences(rng, ["the", "ing", "er", "on", "th"], 80)] + [(t, "bb") for t in sentences(rng, ["que", "é", "oi", "eau", "le"], 80)]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")


def test_language_is_right_on_held_out_rows(tongues):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rows = langid.fit(tongues, ~held).predict(tongues.where(held)).collect()
    assert len(rows) > 20 and all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in rows)


def test_language_awkward_rows(tongues, awkward, nothing):
    model = langid.fit(tongues, F.lit(True))
    rows = model.predict(awkward).collect()
    assert len(rows) == awkward.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    assert all(r.c0 == "c0" for r in rows) and model.predict(nothing).collect() == []
    untaught = langid.fit(tongues.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in untaught.predict(tongues).collect()} == {"und"}


def test_weights_are_sparse_and_learn():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(200):
        label = k % 2
        rows.append((np.array([label, 2 + rng.integers(30)]), np.array([1.0, 0.2]), label))
    w = langid.train_weights(rows, 2, 64)
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 and (w[40:] == 0).all()


def test_temperature_softens_overconfident_logits():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, 400)
    wrong = rng.random(400) < 0.25
    logits = np.zeros((400, 2))
    logits[np.arange(400), np.where(wrong, 1 - labels, labels)] = 20.0
    assert langid.fit_temperature(logits, labels) > 5


# urls


def judged_by_brute_force(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = []
    for rule, verdict in rules:
        rule_host, rule_path = rule.split("/", 1)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            fits.append((len(rule), verdict == "block", rule))
    if fits:
        best = max(fits)
        return host, path, best[2], "block" if best[1] else "allow"
    return host, path, None, "allow" if host else "block"


def test_urls_equal_brute_force(spark):
    rng = random.Random(8)
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("a.b.com/", "block"), ("b.com/x", "allow"), ("b.com/x", "block")]
    urls = [None, "", "no scheme", "http://", "http://ORG", "http://Example.ORG/es/", "x://y://org/", "http://org/#a?b", "http://org:80/"]
    for _ in range(300):
        host = ".".join(rng.choice(["a", "b", "example", "EXAMPLE", "notexample"]) for _ in range(rng.randint(0, 3)) if True) + rng.choice([".org", ".com", "org", ".net"])
        urls.append(f"http://{host}{rng.choice(['', '/', '/es/', '/en/1', '/en/12', '/fr/2', '/de/', '/x', '/X'])}{rng.choice(['', '?q=/es/', '#top', '9'])}")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, spark.createDataFrame(rules, "rule string, verdict string")).collect()}
    assert got == {i: judged_by_brute_force(u, rules) for i, u in enumerate(urls)}


def test_urls_with_many_rules_and_repeated_rows(spark, tiny_driver):
    rules = spark.createDataFrame([(f"h{k}.net/p{k}", "block") for k in range(30)] + [(None, "block"), ("no slash", "allow")], "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://h3.net/p3/x")] * 3 + [(2, "http://h4.net/p3"), (None, None)], "page_id long, url string")
    rows = urlfilter.judge_urls(pages, rules).collect()
    assert sorted((r.page_id or 0, r.rule or "", r.verdict) for r in rows) == [(0, "", "block")] + [(1, "h3.net/p3", "block")] * 3 + [(2, "", "allow")]
    assert {r.verdict for r in urlfilter.judge_urls(pages, rules.where("false")).collect()} == {"allow", "block"}
    assert urlfilter.judge_urls(pages.where("false"), rules).collect() == []


# licences


def base_by_brute_force(text):
    w = plain_words(text)
    found = []
    for phrase, label in license.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(found)


def license_texts(rng):
    parts = [*license.PHRASES, "gnu general", "GNU General\nPublic License", "public license", "apache", "Apache-License", "cc cc by by", "mit mit license license", "der", "x1"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, ""]


def test_base_places_equal_brute_force(documents):
    texts = license_texts(random.Random(2))
    rows = {r.doc_id: r for r in license.scan_licenses(documents(texts)).collect()}
    for i, t in enumerate(texts):
        n, found = base_by_brute_force(t)
        r = rows[i]
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_templates_are_found_in_changed_wording(documents):
    bsd = license.TEMPLATES["bsd"].split()
    changed = " ".join(["noise"] * 40 + bsd[:15] + ["inserted", "words"] + bsd[15:] + ["noise"] * 20)
    rows = {r.doc_id: r for r in license.scan_licenses(documents([changed, " ".join(bsd[:5]), "with or without the of and this is"])).collect()}
    assert rows[0].labels == "bsd" and rows[0].score > 0.9 and rows[0].base_labels == "" and rows[0].spans[0].first_word == 40
    assert rows[1].labels == rows[2].labels == "" and rows[1].score < 0.3


def test_matching_statistics_equal_brute_force():
    rng = random.Random(5)
    alphabet = "a b c d e".split()
    draw = lambda n: " ".join(rng.choice(alphabet) for _ in range(n))
    templates = {f"t{k}": draw(25) for k in range(4)}
    automaton = license.LicenseAutomaton({"a b": "p"}, templates)
    runs = {tuple(w[i:j]) for t in [*templates.values(), "a b"] for w in [t.split()] for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    w = draw(120).split()
    state = length = 0
    for at, c in enumerate(automaton.numbers[x.encode()] for x in w):
        while state and c not in automaton.next[state]:
            state = automaton.link[state]
            length = automaton.size[state]
        if c in automaton.next[state]:
            state, length = automaton.next[state][c], length + 1
        assert length == max((n for n in range(at + 2) if n == 0 or tuple(w[at + 1 - n : at + 1]) in runs))


def test_license_from_a_later_paragraph_on(documents):
    texts = [license.LATER["mit"][-1].upper(), "\n".join(license.LATER["bsd"][:2]), license.LATER["apache"][0], license.LATER["isc"][0], license.LATER["zlib"][0], license.LATER["unlicense"][0]]
    rows = {r.doc_id: r for r in license.scan_licenses(documents(texts)).collect()}
    assert [rows[i].labels for i in range(6)] == ["mit", "bsd", "apache", "isc", "zlib", "unlicense"] and all(rows[i].score == 1 for i in range(6))


def test_states_know_every_place():
    rng = random.Random(5)
    templates = {f"t{k}": " ".join(rng.choice("abc") for _ in range(40)) for k in range(3)}
    automaton = license.LicenseAutomaton({"a b": "p"}, templates)
    for _ in range(200):
        run = [rng.choice("abc") for _ in range(rng.randint(1, 5))]
        state = 0
        for w in run:
            state = automaton.next[state].get(automaton.numbers[w.encode()], -1) if state >= 0 else -1
        want = sorted((k, at + len(run) - 1) for k, (words, _) in enumerate(automaton.templates) for at in range(len(words)) if words[at : at + len(run)] == [w.encode() for w in run])
        assert (sorted(automaton.places_of(state)) if state >= 0 else []) == want


def test_best_chain_equals_trying_all_chains():
    def longest(found, chain=()):
        best = sum_of(chain)
        for x in found:
            if not chain or (chain[-1][1] < x[1] and chain[-1][3] < x[3] and x[0] - chain[-1][1] <= license.MAX_GAP and x[2] - chain[-1][3] <= license.MAX_GAP):
                best = max(best, longest(found, (*chain, x)))
        return best

    def sum_of(chain):
        total = 0
        for i, (first, last, a, b) in enumerate(chain):
            over, until = chain[i - 1][1::2] if i else (-1, -1)
            total += max(0, min(last - max(first, over + 1), b - max(a, until + 1)) + 1)
        return total

    rng = random.Random(8)
    for _ in range(150):
        found = []
        for _ in range(rng.randint(1, 7)):
            first, a, n = rng.randint(0, 40), rng.randint(0, 40), rng.randint(4, 9)
            found.append((first, first + n - 1, a, a + n - 1))
        spans = license.best_chains(found)
        assert max(s[2] for s in spans) == longest(found)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_two_copies_of_a_license_are_two_spans(documents):
    text = license.TEMPLATES["isc"]
    row = license.scan_licenses(documents([f"{text} {text}"])).first()
    assert [(s.label, s.coverage) for s in row.spans if s.coverage > 0.9] == [("isc", 1.0)] * 2 and row.labels == "isc"


def test_license_awkward_rows(awkward, nothing):
    assert license.scan_licenses(awkward).count() == awkward.count() and license.scan_licenses(nothing).collect() == []


# toxicity


@pytest.fixture
def quarrels(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        w = sentences(rng, ["the", "ing", "er", "on", "th", "sta"], 1)[0].split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "zorgling", "zorgath", "zorgen"]))
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(quarrels):
    docs, labels = quarrels
    model = toxicity.fit(docs, labels, F.crc32("id") % 5 != 0)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = model.score(docs).where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert len(rows) > 40 and all((r.score >= 0.5) == bool(truth[r.doc_id]) for r in rows)
    assert "zorg" in model.lexicon.stems and "idiot" in model.lexicon.words
    misspelled, clean = model.score_texts(["what an idoit thing, an idiott", "what a thing"])
    assert model.lexicon.match("idiott")[2] == 1 and misspelled >= 0.5 > clean


def edits_within_one(a, b):
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    variants = {a[:i] + a[i + 1 :] for i in range(len(a))} if len(a) > len(b) else set()
    if len(a) == len(b):
        return 1 if sum(x != y for x, y in zip(a, b)) == 1 else 2
    if len(a) > len(b):
        return 1 if b in variants else 2
    return edits_within_one(b, a)


def test_automaton_matches_equal_brute_force():
    rng = random.Random(7)
    draw = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(5, 7)))
    words = {draw(): 1.0 for _ in range(30)}
    lexicon = toxicity.Lexicon(words, {})
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(3, 9)))
        want = min(edits_within_one(w, t) for t in words)
        got = lexicon.match(w)
        assert (got is not None) == (want <= 1) and (got is None or got[2] == want)


def test_quoted_hits_are_told_apart():
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {})
    flags = lambda text: [h[4] for h in lexicon.hits(text)[1]]
    assert flags('you idiot') == [False] and flags('the "idiot" here') == [True] and flags("he said idiot") == [True]


def test_misspelled_stems_and_short_terms(quarrels):
    """A misspelling inside a stem is a hit of the whole word; a four-letter term takes an edit at a lower weight."""
    docs, labels = quarrels
    model = toxicity.fit(docs, labels, F.lit(True))
    assert "zorg" in model.lexicon.stems and model.lexicon.match("zergling")[0::2] == ("zorgling", 1)
    misspelled, clean = model.score_texts(["what a zergling thing, a zergath", "what a thing"])
    assert misspelled >= 0.5 > clean
    lexicon = toxicity.Lexicon({"scum": 3.0, "idiot": 3.0}, {})
    short, long = lexicon.match("scumm"), lexicon.match("idiott")
    assert short[0::2] == ("scum", 1) and 0 < short[1] < long[1] and lexicon.match("scum") == ("scum", 3.0, 0)


def test_toxicity_awkward_rows(quarrels, awkward, nothing):
    docs, labels = quarrels
    model = toxicity.fit(docs, labels, F.lit(True))
    rows = model.score(awkward).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score < 0.5 for r in rows) and model.score(nothing).collect() == []
    assert {r.score for r in toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True)).score(docs).collect()} == {0.0}


# decontamination


def contamination_by_brute_force(texts, items, span):
    windows = {}
    for name, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - span + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + span]), set()).add(str(name))
    out = []
    for t in texts:
        w, hit, names = plain_words(t), set(), set()
        for k, of in windows.items():
            for i in range(len(w) - len(k) + 1):
                if tuple(w[i : i + len(k)]) == k:
                    hit.update(range(i, i + len(k)))
                    names |= of
        out.append((len(w), len(hit), sorted(names)))
    return out


def test_contamination_equals_brute_force(spark, documents):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice("abcdé") for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 6, 6, 9, 12, 14])] + [(99, None), (100, "a b, C!")]
    texts = [" ".join(rng.choice(["a", "B", "c-", "d", "é", "zz"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", items[7][1].upper().replace(" ", "_")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.find_contamination(documents(texts), bench, span=4, with_spans=True).collect()}
    want = contamination_by_brute_force(texts, items, 4)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_hit, r["items"]) == want[i]
        covered = sum(len(plain_words(t[a:b])) for a, b in ((s.start, s.end) for s in r.spans))
        assert covered == r.n_hit
    clean = decontam.clean_documents(documents(texts), bench, span=4)
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, w in enumerate(want) if not w[1]]


def test_contamination_awkward_rows(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "short text"), (2, "")], "item_id long, text string")
    rows = decontam.find_contamination(awkward, bench).collect()
    assert len(rows) == awkward.count() and sum(r.n_hit == 2 for r in rows) == 4
    assert decontam.clean_documents(awkward, bench).columns == awkward.columns
    assert decontam.find_contamination(nothing, bench).collect() == []
    assert all(r.n_hit == 0 for r in decontam.find_contamination(awkward, bench.where("false")).collect())
    with pytest.raises(ValueError):
        decontam.find_contamination(awkward, bench, max_words=1)


def test_contamination_in_blocks_equals_one_automaton(spark, documents, awkward):
    """A benchmark above one automaton's size is scanned in blocks, with the same answer."""
    rng = random.Random(19)
    items = [(k, " ".join(rng.choice("abcdé") for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 6, 6, 9, 12, 14, 30])] + [(99, None), (None, "a b, C!"), (7, "short text"), (8, "short text")]
    items += [(1000 + k, "e e e e") for k in range(40)]  # one window of many items is dealt out too
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(rng.choice(["a", "B", "c-", "d", "é", "zz", "e"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    docs = documents([(i % 40, t) for i, t in enumerate(texts)]).unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars"))
    plain = lambda rows: sorted([(r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r["items"], [(s.start, s.end) for s in r.spans]) for r in rows.collect()], key=str)
    whole = decontam.find_contamination(docs, bench, span=4, with_spans=True)
    dealt = decontam.find_contamination(docs, bench, span=4, with_spans=True, block_pairs=20)
    assert decontam._blocks(bench, 4, "item_id", "text", None, 20)[0] > 3 and plain(dealt) == plain(whole)
    same = lambda df: sorted(map(str, df.collect()))
    assert same(decontam.clean_documents(docs, bench, span=4, block_pairs=20)) == same(decontam.clean_documents(docs, bench, span=4))


def test_large_benchmark_is_not_refused(spark, documents):
    """More items than the 100,000 of the former cap."""
    bench = spark.range(100_001).select(F.col("id").alias("item_id"), F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" x y")).alias("text"))
    docs = documents(["the w77 x y here", "w77 y x", "W100000, x y"])
    found = {r.doc_id: r["items"] for r in decontam.find_contamination(docs, bench).collect()}
    assert found == {0: ["77"], 1: [], 2: ["100000"]} and [r.doc_id for r in decontam.clean_documents(docs, bench).collect()] == [1]


# BPE and token files


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def odd_texts(rng, n):
    alphabet = [*"ab 's tmre!<|>\n\t\u3000\xa0é日本😀\x85 \x1c12_.,\"", "<|endoftext|>", "'re", "  ", "word ", "\u2029", "\u200b"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encoding_equals_the_library(documents, library):
    texts = [*odd_texts(random.Random(3), 400), None, ""]
    for r in bpe.encode_texts(documents(texts)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_fragments_cover_the_text_and_are_many():
    encoder = bpe.encoder(bpe.default_vocabulary())
    text = " ".join(sentences(random.Random(1), ["the", "ing", "er"], 5)).encode()
    assert b"".join(encoder.fragments([text])[0]) == text and len(encoder.fragments([text])[0]) >= text.count(b" ")
    small = bpe.FragmentEncoder(bpe.default_vocabulary(), bpe.full_entry, kept=3)  # the memory bound does not change ids
    assert [list(x) for x in small.encode([text, text])] == [list(x) for x in encoder.encode([text, text])]


@pytest.mark.parametrize("kept", [3, 500_000])
def test_flat_encoding_equals_the_library(library, kept):
    encoder = bpe.FragmentEncoder(bpe.default_vocabulary(), bpe.ids_only, kept=kept)
    odd = odd_texts(random.Random(11), 200)
    plain = [t.replace("<|endoftext|>", "") for t in odd]
    for texts in ([], [""], ["", ""], odd, [*plain, ""], ["", *plain[:3]]):
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        for end in ([], [0]):
            values, sizes = encoder.encode_flat([t.encode() for t in texts], np.array(end, "<u4").tobytes())
            assert values.tolist() == [i for ids in want for i in [*ids, *end]]
            assert sizes.tolist() == [len(ids) + len(end) for ids in want]


def test_token_files_look_up_each_different_fragment_once_a_chunk(monkeypatch):
    class Counting(dict):
        asked = 0

        def get(self, key, default=None):
            Counting.asked += 1
            return super().get(key, default)

        def __getitem__(self, key):
            Counting.asked += 1
            return super().__getitem__(key)

    encoder = bpe.FragmentEncoder(bpe.default_vocabulary(), bpe.ids_only)
    encoder.cache = Counting()
    monkeypatch.setattr(tokenfile, "encoder", lambda *_: encoder)
    monkeypatch.setattr(tokenfile, "_put", lambda store, base, name, blocks: list(blocks))
    monkeypatch.setattr(tokenfile, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Part", (), {"partitionId": staticmethod(lambda: 0)}))}))
    run, _ = tokenfile._draft("", b"\0\0\0\0", "file:///tmp")
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["the same few words " * 20_000, "the same few words " * 10_000]})
    rows = [r for part in run([batch]) for r in part.to_pylist()]
    assert rows[0]["n"] > 100_000 and Counting.asked < 100


def test_decoding_gives_the_texts_back(documents):
    texts = [t for t in odd_texts(random.Random(5), 50)] + [None]
    back = bpe.decode_ids(bpe.encode_texts(documents(texts)))
    assert {r.doc_id: r.decoded for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_bpe_awkward_rows(awkward, nothing):
    rows = bpe.encode_texts(awkward).collect()
    assert len(rows) == awkward.count() and bpe.encode_texts(nothing).collect() == []


def test_packed_values_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype("<u4")
        raw = b"xx" + tokenfile.pack_values(v) + b"rest"
        back, end = tokenfile.unpack_values(raw, n, 2)
        assert (back == v).all() and raw[end:] == b"rest"
    assert len(tokenfile.pack_values(np.arange(200))) == 50 + 200


def test_token_files_round_trip(documents, library):
    texts = [*odd_texts(random.Random(8), 120), None, "", "long word " * 5000]
    rng = random.Random(1)
    ids = rng.sample(range(10_000), len(texts))
    manifest, ranks = tokenfile.write_token_files(documents(list(zip(ids, texts))))
    rows = {r.doc_id: r for r in tokenfile.read_token_files(manifest, ranks).collect()}
    start = 0
    for ident, text in sorted(zip(ids, texts)):
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        r = rows[ident]
        assert (r.start, r.n_tokens) == (start, len(want)) and r.ids == want.tobytes()
        start += len(want)
    counts = {}
    for r in rows.values():
        for t in np.frombuffer(r.ids, "<u4").tolist():
            counts[t] = counts.get(t, 0) + 1
    in_rank = [counts[r.token] for r in ranks.orderBy("rank").collect()]
    assert in_rank == sorted(in_rank, reverse=True)
    assert zlib.crc32(rows[ids[0]].ids) >= 0


def test_token_files_awkward_rows(awkward, nothing):
    rows = tokenfile.read_token_files(*tokenfile.write_token_files(awkward)).collect()
    assert len(rows) == awkward.count() and max(r.start for r in rows if r.doc_id is not None) < min(r.start for r in rows if r.doc_id is None)
    assert tokenfile.read_token_files(*tokenfile.write_token_files(nothing)).collect() == []


def test_alnum_table_equals_the_pattern():
    text = "".join(map(chr, range(0x250))) + "日本 ß ı ſ"
    assert [w.decode() for w in text.encode().translate(ALNUM).split()] == plain_words(text)
