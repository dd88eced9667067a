"""Toxicity: a learned lexicon trie, intersected with Levenshtein automata, and scores of the context windows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import fitting, trimmed

SCHEMA = "doc_id long, score double, predicted int"
WORD = re.compile(r"[^\W\d_]+(?:['’*@$!1034]+[^\W_]+)*|[^\W_]+", re.UNICODE)
#: Words of reported or quoted speech, and of address, in English, German, French and Spanish.
REPORT = frozenset("""
said says quote quoted quotes wrote writes called reported reports according term word slur
sagte sagt schrieb nannte zitat zitiert wort begriff laut
dit écrit écrivait appelé citation cité mot terme selon
dijo dice escribió llamó cita citado palabra término según
""".split())
ADDRESS = frozenset("you your you're are is he she they tu du sie vous eres usted".split())
#: Which marks close a quotation that a mark opens.
PAIRS = {'"': '"', "'": "'", "`": "`", "“": "”", "„": "“”", "‘": "’", "«": "»", "»": "«"}
OPENS = re.compile(r"(?<!\w)[\"'`“„‘«»](?!\s)")
#: What a quoted hit weighs beside one in abuse, a misspelt one beside an exact one, and one with a word of address near it.
QUOTED, MISSPELT, ADDRESSED = 0.2, 0.5, 1.25
#: Characters on either side of a hit that its context window holds.
WINDOW = 48


@dataclass
class Automaton:
    """The product of the trie of all terms and the Levenshtein automaton of each, made deterministic on demand.

    A state is the set of (trie node, edits so far) that the read letters can reach; it dies as soon as no term
    is within reach. Terms of `fuzzy` letters and more allow one edit, others none. A term with a trailing *
    matches any word that begins with it, without edits.
    """

    terms: dict[str, float]
    fuzzy: int = 5
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    end: dict[int, str] = field(default_factory=dict)
    longest: list[int] = field(default_factory=lambda: [0])
    steps: dict[tuple[int, str], int] = field(default_factory=dict)
    states: list[frozenset] = field(default_factory=list)
    numbers: dict[frozenset, int] = field(default_factory=dict)

    def __post_init__(self):
        for term in self.terms:
            node, size = 0, 0 if term.endswith("*") else len(term)  # beginnings allow no edit
            for ch in term.rstrip("*"):
                self.longest[node] = max(self.longest[node], size)
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.longest.append(0)
                node = self.children[node][ch]
            self.longest[node] = max(self.longest[node], size)
            self.end[node] = term if node not in self.end or term.endswith("*") else self.end[node]
        self.number(frozenset())  # 0: dead
        self.start = self.number(self.close({(0, 0)}))

    def close(self, found: set) -> frozenset:
        """Add what leaving out a letter of the term reaches, and keep the fewest edits of a node."""
        todo = list(found)
        while todo:
            node, edits = todo.pop()
            if edits < 1 and self.longest[node] >= self.fuzzy:
                for nxt in self.children[node].values():
                    if (nxt, edits + 1) not in found:
                        found.add((nxt, edits + 1))
                        todo.append((nxt, edits + 1))
        return frozenset((n, e) for n, e in found if not (e and (n, 0) in found))

    def number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def step(self, state: int, ch: str) -> int:
        out = set()
        for node, edits in self.states[state]:
            if (nxt := self.children[node].get(ch)) is not None:
                out.add((nxt, edits))
            if edits < 1 and self.longest[node] >= self.fuzzy:
                out.add((node, edits + 1))  # a letter too many
                out |= {(nxt, edits + 1) for nxt in self.children[node].values()}  # another letter
            if node in self.end and self.end[node].endswith("*"):
                out.add((node, edits))  # the rest of a word is free
        self.steps[state, ch] = found = self.number(self.close(out))
        return found

    def match(self, word: str) -> tuple[str, int] | None:
        """The term within reach of a word, and the edits; the fewest edits, then the first term."""
        state, steps = self.start, self.steps
        for ch in word:
            nxt = steps.get((state, ch))
            state = self.step(state, ch) if nxt is None else nxt
            if not state:
                return None
        hits = [(e, self.end[n]) for n, e in self.states[state] if n in self.end and (not e or len(self.end[n]) >= self.fuzzy and not self.end[n].endswith("*"))]
        if not hits:
            return None
        edits, term = min(hits)
        return term, edits


@dataclass
class ToxicModel:
    terms: dict[str, float]
    weights: list[float]


N_FEATURES = 6


def in_quotation(before: str, after: str) -> bool:
    """Whether a mark that opens before a hit, and isn't closed there, is closed after it; both are its context window."""
    for m in OPENS.finditer(before):
        closing = f"[{re.escape(PAIRS[m.group()])}](?!\\w)"
        if not re.search(rf"(?<=\S){closing}", before[m.end() :]) and re.search(closing, after):
            return True
    return False


def features(text: str, automaton: Automaton, memory: dict) -> list[float]:
    """Of a whole text: its hits' scores summed, the largest, their density, misspelt hits, distinct terms, 1.

    A hit scores its term's weight, less if it is misspelt. Its window is WINDOW characters on both sides: it scores less
    where it stands in quotation marks or with a word of reported speech, and more with a word of address.
    """
    total = top = misspelt = words = 0.0
    kinds: dict[str, float] = {}
    low = text.lower()
    for m in WORD.finditer(low):
        words += 1
        w = m.group()
        found = memory.get(w, 0)
        if found == 0:
            if len(memory) > 400_000:
                memory.clear()
            found = memory[w] = automaton.match(w)
        if found is None:
            continue
        term, edits = found
        before, after = low[max(0, m.start() - WINDOW) : m.start()], low[m.end() : m.end() + WINDOW]
        near = set(WORD.findall(before)) | set(WORD.findall(after))
        share = QUOTED if in_quotation(before, after) or near & REPORT else ADDRESSED if near & ADDRESS else 1.0
        score = automaton.terms[term] * (MISSPELT if edits else 1.0) * share
        total += score
        top = max(top, score)
        misspelt += share * bool(edits)
        kinds[term] = max(kinds.get(term, 0.0), min(1.0, share))
    return [math.log1p(total), top, math.log1p(100 * total / max(words, 1)), math.log1p(misspelt), min(sum(kinds.values()), 4.0), 1.0]


def learn_terms(texts: list[str], toxic: list[int], least: int = 4, ratio: float = 8.0) -> dict[str, float]:
    """Words and word beginnings (term*) that many more toxic than other texts hold, with their log ratios.

    A beginning is taken if it holds well beyond each single word; what it covers is not listed again.
    """
    n1 = sum(toxic)
    n0 = len(toxic) - n1
    count: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in zip(texts, toxic, strict=True):
        words = set(WORD.findall(text.lower()))
        count[1 if y else 0].update(words | {f"{w[:k]}*" for w in words for k in range(4, min(8, len(w)))})
    share = lambda w: math.log((count[1][w] + 0.25) / (n1 + 1) / ((count[0][w] + 0.25) / (n0 + 1)))
    found = {w: x for w, c in count[1].items() if c >= least and (x := share(w)) >= math.log(ratio) and c >= 0.02 * n1}
    terms: dict[str, float] = {}
    for w in sorted(found, key=lambda w: (-count[1][w], not w.endswith("*") and 1, -len(w), w)):
        stem = w.rstrip("*")
        if any(stem.startswith(t.rstrip("*")) and t.endswith("*") or t.rstrip("*").startswith(stem) and w.endswith("*") for t in terms):
            continue
        if w.endswith("*") and any(count[1][x] >= 0.9 * count[1][w] for x in found if not x.endswith("*") and x.startswith(stem)):
            continue  # one word makes up the beginning
        terms[w] = round(found[w], 4)
    return terms


def fit(texts: list[str], toxic: list[int]) -> ToxicModel:
    """Terms from all rows; weights of the features by logistic regression, each row's features from terms that were
    learned without it (the rows are halved, and each half is measured by the other's terms).
    """
    terms = learn_terms(texts, toxic)
    x = np.zeros((len(texts), N_FEATURES))
    for half in (0, 1):
        other = Automaton(learn_terms(texts[1 - half :: 2], toxic[1 - half :: 2]))
        memory: dict = {}
        for i in range(half, len(texts), 2):
            x[i] = features(texts[i], other, memory)
    y, w = np.array(toxic, float), np.zeros(N_FEATURES)
    for _ in range(60):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([0.5] * (N_FEATURES - 1) + [1e-3])
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return ToxicModel(terms, w.tolist())


def score(model: ToxicModel, automaton: Automaton, memory: dict, text: str | None) -> float:
    z = float(np.dot(features(text or "", automaton, memory), model.weights))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train_row(doc_id) -> F.Column:
    """Rows to learn from: crc32 of doc_id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000, chars: int = 20_000) -> ToxicModel:
    """Fit on a bounded sample: the `rows` labelled training rows of smallest hash, whole, of rows * chars bytes at most."""
    known = labels.where(F.col("toxic").isNotNull() & train_row(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id", "toxic"), "doc_id").limit(rows)  # ids and labels only
    all_texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = all_texts.join(F.broadcast(picked), "doc_id").select(F.xxhash64("doc_id", "toxic").alias("h"), "doc_id", F.octet_length("text").cast("long").alias("bytes"))
    ids = fitting(sizes, rows * chars)
    picked = picked.where(F.col("doc_id").isin(ids))
    texts = all_texts.join(F.broadcast(picked), "doc_id").collect()
    texts.sort(key=lambda r: (r["doc_id"], r["text"], r["toxic"]))
    return fit([r["text"] for r in texts], [int(r["toxic"] > 0) for r in texts])


def toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted per row; whole texts of any length. Null counts as empty. Rows repeated whole, and rows
    of one id, get a result each; a score of exactly the threshold is 1. Only text is read; other columns may have any
    names. A model of no terms scores all texts alike. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        automaton, memory = Automaton(own.terms), {}
        for batch in batches:
            found = [score(own, automaton, memory, x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(trimmed(work), SCHEMA)
