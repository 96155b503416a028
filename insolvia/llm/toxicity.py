"""Toxicity scores from a learned lexicon, matched with misspellings and weighed by context.

1. Sample: about `per_label` labelled rows of each label, drawn by a hash of the id (the documented bound).
2. Lexicon: words and word beginnings (stems) that many toxic texts of the sample hold and clean ones
   hardly do; the shortest beginning that is as telling as the longer ones is kept.
3. Matching: the trie of the lexicon is intersected with a Levenshtein automaton for one edit. The
   product is walked as one automaton whose states (sets of trie node and edits made) are built when
   first met and kept. Stems end anywhere in a word and must begin exactly; whole words, those under a
   stem too, may be misspelled by one edit (a wrong, extra or missing letter; two swapped letters are two
   edits) when they have at least MIN_FUZZY letters, at a lower weight below FULL_FUZZY letters.
4. Context: the words within WINDOW of a hit and the marks around it tell quotation from abuse; a hit
   between quotation marks or beside reporting words counts as quoted.
5. Score: logistic regression over the weights, shares and contexts of a text's hits.

Defined cases: null or empty texts hold no hit and get the score of a text without hits (below one half
when most learned rows are clean); rows with a null label or id are never learned from; labels without
both classes give score 0 everywhere; a document labelled twice is learned twice; repeated rows get
equal answers; only the named columns are read.
"""
from __future__ import annotations

import math
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_collect, materialize
from .words import chunked, row_id, shown_id, text_bytes

PER_LABEL = 8_000
MIN_STEM, MAX_STEM = 4, 12
MIN_FUZZY, FULL_FUZZY = 4, 5
# What is left of a term's weight when it is misspelled: a short one may well be another word.
MISSPELLED, SHORT_MISSPELLED = 0.8, 0.4
WINDOW = 6
MAX_TERMS = 200_000

_TOKEN = re.compile(r"[^\s.,;:!?()\[\]{}\"“”„«»]+|[\"“”„«»]")
_QUOTES = frozenset("\"“”„«»")
# Words that report speech, in the languages at hand.
_REPORTING = frozenset("said says wrote quoted quote called word term insult slur dit écrit mot sagte schrieb wort dijo escribió palabra".split())


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Lexicon:
    """Terms with weights: whole words (fuzzy) and stems, as a trie walked with at most one edit."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.children: list[dict[str, int]] = [{}]
        self.word_at: dict[int, str] = {}
        self.stem_at: dict[int, str] = {}
        for terms, at in ((words, self.word_at), (stems, self.stem_at)):
            for term in sorted(terms):
                node = 0
                for c in term:
                    node = self.children[node].setdefault(c, len(self.children))
                    if node == len(self.children):
                        self.children.append({})
                at[node] = term
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state(self._closed({(0, 0)}))
        self.matches: dict[str, tuple[str, float, int] | None] = {}

    def _closed(self, pairs) -> frozenset:
        """With deletions: a trie edge taken without a character costs the one edit."""
        out = set(pairs)
        for node, edits in pairs:
            if edits == 0:
                out.update((child, 1) for child in self.children[node].values())
        return frozenset(p for p in out if not (p[1] == 1 and (p[0], 0) in out))

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.steps.append({})
        return self.states[pairs]

    def _step(self, state: int, c: str) -> int:
        moved = set()
        for node, edits in self.sets[state]:
            child = self.children[node].get(c)
            if child is not None:
                moved.add((child, edits))
            if edits == 0:
                moved.add((node, 1))  # an extra character
                moved.update((n, 1) for n in self.children[node].values())  # a wrong character
        to = self._state(self._closed(moved)) if moved else -1
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, float, int] | None:
        """The best term of a word: (term, weight, edits)."""
        try:
            return self.matches[word]
        except KeyError:
            pass
        best, state, node = None, self.start, 0
        for c in word:
            if node >= 0:  # stems begin exactly
                node = self.children[node].get(c, -1)
                if node in self.stem_at:
                    term = self.stem_at[node]
                    best = max(best or ("", -1.0, 0), (term, self.stems[term], 0), key=lambda b: b[1])
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                break
        if state >= 0:
            for at, edits in self.sets[state]:
                term = self.word_at.get(at)
                if term and (edits == 0 or len(term) >= MIN_FUZZY):
                    weight = self.words[term] * (1.0 if edits == 0 else MISSPELLED if len(term) >= FULL_FUZZY else SHORT_MISSPELLED)
                    if best is None or weight > best[1]:
                        best = (term, weight, edits)
        if len(self.matches) > 400_000:  # a memory bound; answers do not depend on it
            self.matches.clear()
        if len(self.sets) > 200_000:
            self.states, self.sets, self.steps = {}, [], []
            self.start = self._state(self._closed({(0, 0)}))
        self.matches[word] = best
        return best

    def hits(self, text: str) -> tuple[int, list[tuple[int, str, float, int, bool]]]:
        """Number of tokens; (place, term, weight, edits, quoted) of each hit."""
        tokens = tokens_of(text)
        found = list(map(self.match, tokens))
        out = []
        if any(found):
            open_quote, inside = False, []
            for t in tokens:
                if t in _QUOTES:
                    open_quote = not open_quote
                inside.append(open_quote)
            for at, m in enumerate(found):
                if m:
                    near = tokens[max(0, at - WINDOW) : at + WINDOW + 1]
                    out.append((at, *m, inside[at] or not _REPORTING.isdisjoint(near)))
        return len(tokens), out


def features(n: int, hits: list[tuple[int, str, float, int, bool]]) -> list[float]:
    """Plain and quoted hits of a text of n tokens: strongest weight, weights together, share of the tokens."""
    row = []
    for quoted in (False, True):
        w = [h[2] for h in hits if h[4] == quoted]
        row += [max(w, default=0.0), math.log1p(sum(w)), 100.0 * len(w) / n if n else 0.0]
    return row


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps with a ridge on all but the intercept (last)."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * max(1, len(y)) / 100)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    def __init__(self, lexicon: Lexicon | None, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score_texts(self, texts: list[str]) -> list[float]:
        return self.score_hits([self.lexicon.hits(t) if self.lexicon else (0, []) for t in texts])

    def score_hits(self, found: list[tuple[int, list]]) -> list[float]:
        if self.lexicon is None or not found:
            return [0.0] * len(found)
        x = np.array([features(n, hits) for n, hits in found])
        return (1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))).tolist()

    def score(self, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per input row: doc_id, score, n_hits, n_quoted, terms (place, term, edits, quoted)."""
        plain = (self.lexicon.words, self.lexicon.stems) if self.lexicon else None
        blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps((plain, self.weights)))
        place = pa.list_(pa.struct([("place", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))
        schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("n_hits", pa.int64()), ("n_quoted", pa.int64()), ("terms", place)])

        def run(batches):
            lists, weights = pickle.loads(blob.value)
            model = ToxicityModel(Lexicon(*lists) if lists else None, weights)
            for batch in chunked(batches, "text"):
                texts = [b.decode() for b in text_bytes(batch.column("text"))]
                found = [model.lexicon.hits(t) if model.lexicon else (0, []) for t in texts]
                rows = [hits for _, hits in found]
                terms = [[{"place": h[0], "term": h[1], "edits": h[3], "quoted": h[4]} for h in r] for r in rows]
                scores = model.score_hits(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(scores, pa.float64()), pa.array(list(map(len, rows)), pa.int64()), pa.array([sum(h[4] for h in r) for r in rows], pa.int64()), pa.array(terms, place)], schema=schema
                )

        rows = docs.select(row_id(ident).alias("id"), F.col(text).cast("string").alias("text"))
        done = rows.mapInArrow(run, "id long, score double, n_hits long, n_quoted long, terms array<struct<place: long, term: string, edits: int, quoted: boolean>>")
        return done.withColumn("id", shown_id(F.col("id"))).withColumnRenamed("id", "doc_id")


def _beginnings(tokens) -> set[tuple[str, bool]]:
    """Whole words (True) and their beginnings (False) of a text."""
    out = set()
    for w in set(tokens):
        if len(w) >= MIN_STEM - 1:
            out.add((w, True))
            out.update((w[:k], False) for k in range(MIN_STEM, min(len(w), MAX_STEM + 1)))
    return out


def _term_counts(wanted: frozenset | None):
    """Per task the number of texts that hold each term, by label; of the wanted terms, or of all."""
    def run(batches):
        counts = {0: Counter(), 1: Counter()}

        def table():
            rows = [(t, whole, label, n) for label, c in counts.items() for (t, whole), n in c.items()]
            for c in counts.values():
                c.clear()
            columns = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int32(), pa.int64()))], names=["term", "whole", "label", "n"])

        for batch in chunked(batches, "text"):
            for raw, label in zip(text_bytes(batch.column("text")), batch.column("label").to_pylist()):
                held = _beginnings(tokens_of(raw.decode()))
                counts[label].update(held if wanted is None else held & wanted)
            if sum(map(len, counts.values())) > 300_000:
                yield table()
        yield table()

    return run, "term string, whole boolean, label int, n long"


def choose_terms(counts: dict[tuple[str, bool], tuple[int, int]], clean: int, toxic: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems whose log-odds for toxic are high, from (toxic, clean) counts of texts; longer beginnings that add nothing
    are left out, whole words under a stem are kept: only they are matched with an edit."""
    weight = {}
    for key, (a, b) in counts.items():
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if odds > 2.5 and a >= 4 * b:
            weight[key] = odds
    words = {t: w for (t, whole), w in weight.items() if whole}
    stems: dict[str, float] = {}
    for (t, whole), w in sorted(weight.items(), key=lambda x: (len(x[0][0]), x[0])):
        if whole or any(t[:k] in stems for k in range(MIN_STEM, len(t))):
            continue
        # A beginning must hold more than its one commonest word does, else the word alone is the term.
        longest = max((counts[k][0] for k in counts if k[1] and k[0].startswith(t)), default=0)
        if counts[(t, whole)][0] >= 1.3 * longest:
            stems[t] = w
    return words, stems


def fit(docs: DataFrame, labels: DataFrame, learn: Column, ident: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = PER_LABEL) -> ToxicityModel:
    """Learn from the labelled rows for which `learn` (over the column id, as text) holds."""
    known = labels.select(F.col(ident).cast("long").alias("doc"), F.col(label).cast("int").alias("label")).where("doc is not null and label in (0, 1)")
    known = known.withColumn("id", F.col("doc").cast("string")).where(learn)
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, per_label / max(1, sizes.get(1, 0)))).otherwise(min(1.0, per_label / max(1, sizes.get(0, 0))))
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit("toxicity sample")), F.lit(1 << 40)) / F.lit(float(1 << 40)) < share).select("doc", "label")
    # At most about 2 * per_label small rows: safe to broadcast at any size of the corpus.
    sample = materialize(docs.select(F.col(ident).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "doc"), "toxicity-sample")
    have = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = have.get(1, 0), have.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel(None, np.zeros(7))

    support = max(3, toxic // 200)
    bad = sample.where("label = 1").select("text", "label").mapInArrow(*_term_counts(None)).groupBy("term", "whole").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    wanted = frozenset((r["term"], r["whole"]) for r in bounded_collect(bad, MAX_TERMS))
    both = sample.select("text", "label").mapInArrow(*_term_counts(wanted)).groupBy("term", "whole").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean")
    )
    counts = {(r["term"], r["whole"]): (r["toxic"], r["clean"]) for r in bounded_collect(both, MAX_TERMS)}
    words, stems = choose_terms(counts, clean, toxic)

    def sample_features(batches):
        lexicon = Lexicon(words, stems)
        for batch in chunked(batches, "text"):
            rows = [features(*lexicon.hits(b.decode())) for b in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("label")], names=["x", "label"])

    found = bounded_collect(sample.select("text", "label").mapInArrow(sample_features, "x array<double>, label int").orderBy("label", "x"), 4 * per_label + 1000)
    x, y = np.array([r["x"] for r in found]), np.array([r["label"] for r in found], float)
    return ToxicityModel(Lexicon(words, stems), fit_logistic(x, y))
