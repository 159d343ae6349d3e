"""Language identification by cross-parsing.

For every language a suffix automaton of a bounded sample of whole labelled texts knows all substrings of that sample.  A text is
parsed greedily into the longest phrases that the automaton contains; the fewer phrases, the closer the text is to the
language.  Counts are normalised by the log of the sample's length, so that languages with less labelled text compare
fairly; the lowest rate wins.

Many texts are parsed at a time, in blocks that are first parsed as if a phrase began with each of them.  A block is then
parsed again from the state in which the one before it really ends, up to the first phrase that begins where one began in
the first parse; from there on both are the same.  So a phrase may cross any number of blocks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occura.llm.common import broadcast_if_small, carried, group, materialize, schema_of, slices, task

UNDETERMINED = "und"
#: Labelled rows that a language is learned from; the only bound on the sample.  More languages than MOST_LANGUAGES are an error.
SAMPLE_DOCS, MOST_LANGUAGES = 10, 500
#: Parts in which the rows of a language are ranked first; it changes the cost only.
SAMPLE_PARTS = 16
#: Characters that are parsed one after the other; it changes the cost only.
BLOCK = 256
#: Letters of a language, the most frequent ones, and states, those of the shortest substrings, that have a place in its automaton's table; all other
#: steps are looked up by hash.  They change the cost only.
COLUMNS, STATES = 64, 1 << 14
#: Bytes of text parsed at a time.
SLICE = 2 << 20

GAP, OTHER, FIRST_LETTER = 0, 1, 2
NONE = np.uint32(0xFFFFFFFF)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters_only(text: str) -> str:
    """Lower case, with each run of anything but letters as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(letters: str) -> list[dict[str, int]]:
    """The steps from each state of the automaton of all substrings, built online; state 0 is the root, and states stand in the order of their longest substrings' lengths."""
    steps: list[dict[str, int]] = [{}]
    suffix, longest, last = [-1], [0], 0
    for c in letters:
        new = len(steps)
        steps.append({})
        suffix.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = suffix[p]
        if p >= 0:
            q = steps[p][c]
            if longest[q] != longest[p] + 1:
                twin = len(steps)
                steps.append(dict(steps[q]))
                suffix.append(suffix[q])
                longest.append(longest[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = suffix[p]
                suffix[q] = q = twin
            suffix[new] = q
        last = new
    order = sorted(range(len(steps)), key=longest.__getitem__)
    place = [0] * len(steps)
    for k, state in enumerate(order):
        place[state] = k
    return [{c: place[to] for c, to in steps[state].items()} for state in order]


@dataclass
class Automaton:
    """Steps as arrays: a table for frequent letters of short substrings' states, and a hash table of (state, letter) for all others."""

    length: int
    states: int
    letters: list[str]
    table: np.ndarray
    keys: np.ndarray
    targets: np.ndarray

    @classmethod
    def of(cls, sample: str) -> Automaton:
        steps = suffix_automaton(sample)
        times: dict[str, int] = {}
        for c in sample:
            times[c] = times.get(c, 0) + 1
        letters = sorted(times, key=lambda c: (-times[c], c))
        own = {c: k for k, c in enumerate(letters)}
        common, rows = min(len(own), COLUMNS), min(len(steps), STATES)
        table = np.full((rows + 1, common + 2), NONE, np.uint32)
        table[:, common + 1] = 0
        pairs = []
        for state, ways in enumerate(steps):
            for c, to in ways.items():
                if state < rows and own[c] < common:
                    table[state, own[c]] = to
                else:
                    pairs.append((state * len(own) + own[c], to))
        bits = max(1, (2 * len(pairs)).bit_length())
        keys, targets = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.uint32)
        left = np.array(pairs, np.int64).reshape(-1, 2)
        at = slots(left[:, 0], bits)
        while len(left):  # each free slot takes the first that comes; the others go on to the next
            free = np.flatnonzero(keys[at] < 0)
            slot, first = np.unique(at[free], return_index=True)
            keys[slot], targets[slot] = left[free[first], 0], left[free[first], 1]
            rest = np.ones(len(left), bool)
            rest[free[first]] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << bits) - 1)
        return cls(len(sample), len(steps), letters, table.ravel(), keys, targets)


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


class Parser:
    """A language's automaton over the letters of all languages."""

    def __init__(self, automaton: Automaton, alphabet: dict[str, int]):
        """``alphabet`` numbers the letters of all languages; a letter that this sample does not have is a phrase by itself."""
        self.length, self.dead = automaton.length, automaton.states
        self.table, self.keys, self.targets = automaton.table, automaton.keys, automaton.targets
        self.letters, self.bits = max(1, len(automaton.letters)), len(automaton.keys).bit_length() - 1
        self.common = min(len(automaton.letters), COLUMNS)
        self.width = self.common + 2  # and one for letters without a column, one for what fills blocks up
        self.last = len(self.table) // self.width - 1
        self.column = np.full(FIRST_LETTER + len(alphabet) + 1, self.common, np.uint8)
        self.column[-1] = self.common + 1
        self.own = np.full(len(self.column), -1, np.int32)
        for k, c in enumerate(automaton.letters):
            number = GAP if c == " " else alphabet[c]
            self.own[number] = k
            if k < self.common:
                self.column[number] = k

    def step(self, state: np.ndarray, column: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Next states; NONE where the automaton has no way on."""
        after = self.table[np.minimum(state, self.last) * self.width + column]
        looked = np.flatnonzero(((state >= self.last) & (own >= 0)) | (own >= self.common))
        if len(looked):
            key = state[looked] * self.letters + own[looked]
            at, mask = slots(key, self.bits), len(self.keys) - 1
            while len(looked):
                there = self.keys[at]
                found = there == key
                after[looked[found]] = self.targets[at[found]]
                more = np.flatnonzero(~found & (there >= 0))
                looked, key, at = looked[more], key[more], (at[more] + 1) & mask
        return after

    def begin(self, after: np.ndarray, new: np.ndarray, column: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The states with a new phrase begun where ``new`` says so."""
        if not new.any():
            return after.astype(np.int64)
        root = self.step(np.zeros(len(column), np.int64), column, own)
        return np.where(new, np.where(root == NONE, self.dead, root), after).astype(np.int64)

    def phrases(self, blocks: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases that begin in each block (row); ``follows`` says which blocks go on with the text of the one before."""
        by_place = np.ascontiguousarray(blocks.T)
        columns, letters = self.column[by_place], self.own[by_place]
        n = blocks.shape[0]
        begins = np.zeros(columns.shape, bool)
        state, after = np.zeros(n, np.int64), np.full(n, NONE)
        for t, column in enumerate(columns):
            odd = letters[t]
            if t:
                after = self.step(state, column, odd)
            begins[t] = after == NONE
            state = self.begin(after, begins[t], column, odd)
        from_here = np.cumsum(begins[::-1], axis=0, dtype=np.int32)[::-1]
        found, first_end, end = from_here[0].astype(np.int64), state, state.copy()
        again = np.flatnonzero(follows)
        while len(again):
            rows, state, count = again, end[again - 1], np.zeros(len(again), np.int64)
            ends_as = np.empty(len(again), np.int64)
            open_rows = np.arange(len(again))
            for t, column in enumerate(columns):
                own, odd = column[rows], letters[t][rows]
                after = self.step(state, own, odd)
                new = after == NONE
                same = new & begins[t][rows]
                state = self.begin(after, new, own, odd)
                count += new & ~same
                if same.any():
                    done = open_rows[same]
                    found[again[done]], ends_as[done] = count[same] + from_here[t][rows[same]], first_end[rows[same]]
                    keep = ~same
                    rows, state, count, open_rows = rows[keep], state[keep], count[keep], open_rows[keep]
                    if not len(rows):
                        break
            found[rows], ends_as[open_rows] = count, state
            changed = again[ends_as != end[again]]
            end[again] = ends_as
            again = changed[changed + 1 < n] + 1
            again = again[follows[again]]
        return found


@dataclass
class LanguageModel:
    languages: list[str]
    alphabet: dict[str, int]
    parsers: list[Parser]


def joined(automata: dict[str, Automaton]) -> LanguageModel:
    """A parser for each language's automaton; every letter of any of them has a number."""
    letters = sorted({c for a in automata.values() for c in a.letters} - {" "})
    alphabet = {c: FIRST_LETTER + k for k, c in enumerate(letters)}
    languages = sorted(automata)
    return LanguageModel(languages, alphabet, [Parser(automata[x], alphabet) for x in languages])


def build(samples: dict[str, str]) -> LanguageModel:
    return joined({x: Automaton.of(text) for x, text in samples.items()})


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> LanguageModel:
    """Fit on the whole texts of SAMPLE_DOCS labelled rows of each language, those with the smallest hashes of id and text.

    A language's rows are ranked in SAMPLE_PARTS parts first, so that no task ranks more than the first rows of each.  Only rows with a label
    and a text that holds a letter count, and repeated rows count once.  A task builds each language's automaton; what comes to the driver is its arrays, some tens of
    bytes for each letter of the sample.  More than MOST_LANGUAGES languages raise ValueError.
    """
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("body"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    known = texts.filter("lang is not null and body is not null").filter(F.col("body").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("h")
    parts = Window.partitionBy("lang", F.pmod("h", F.lit(SAMPLE_PARTS))).orderBy("h")
    first = known.select("lang", "h").distinct().withColumn("place", F.row_number().over(parts)).filter(F.col("place") <= SAMPLE_DOCS)
    chosen = materialize(first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE_DOCS), "language_sample")
    if chosen.filter("place = 1").limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")

    def automaton(rows: pa.Table) -> pa.Table:
        texts = sorted(zip(rows.column("place").to_pylist(), rows.column("body").to_pylist(), strict=True))
        found = Automaton.of(" ".join(x for x in (letters_only(body) for _, body in texts) if x))
        return pa.table({"lang": rows.column("lang")[:1], "length": [found.length], "states": [found.states], "letters": ["".join(found.letters)], "table": [found.table.tobytes()], "keys": [found.keys.tobytes()], "targets": [found.targets.tobytes()]})

    sample = known.join(broadcast_if_small(chosen), ["lang", "h"]).groupBy("lang", "place").agg(F.min("body").alias("body"))
    rows = sample.groupBy("lang").applyInArrow(group(automaton), "lang string, length bigint, states bigint, letters string, table binary, keys binary, targets binary").collect()
    arrays = lambda r: (np.frombuffer(r["table"], np.uint32), np.frombuffer(r["keys"], np.int64), np.frombuffer(r["targets"], np.uint32))
    return joined({r["lang"]: Automaton(r["length"], r["states"], list(r["letters"]), *arrays(r)) for r in rows})


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((OTHER if chr(p).isalpha() else GAP for p in range(0x110000)), np.uint8, 0x110000)


def codes_by_point(alphabet: dict[str, int]) -> np.ndarray:
    """Code point → GAP, the number of a letter, or OTHER for letters that no sample has."""
    table = _letters().astype(np.int32)
    table[[ord(c) for c in alphabet]] = list(alphabet.values())
    return table


def in_blocks(texts: list[bytes | None], table: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, with single gaps between words, as numbers in rows of BLOCK; and the text of each row."""
    lowered = [(x or b"").decode("utf-8", "replace").lower() for x in texts]
    sizes = np.array([len(x) + 1 for x in lowered], np.int64)
    codes = table[np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    keep = np.flatnonzero((codes != GAP) | (np.r_[GAP, codes[:-1]] != GAP))  # a gap after a letter: every text ends with one
    codes, text = codes[keep], text[keep]
    last = np.r_[text[1:] != text[:-1], True][: len(text)] & (codes == GAP)
    codes, text = codes[~last], text[~last]
    lengths = np.bincount(text, minlength=len(texts))
    rows = -(-lengths // BLOCK)
    within = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    blocks = np.full((int(rows.sum()), BLOCK), pad, np.int32)
    blocks[np.repeat(np.cumsum(rows) - rows, lengths) + within // BLOCK, within % BLOCK] = codes
    return blocks, np.repeat(np.arange(len(texts)), rows)


def classify(texts: list[bytes | None], model: LanguageModel, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language with the fewest normalised phrases (-1: undetermined) and its score, the share of closeness."""
    blocks, owner = in_blocks(texts, table, FIRST_LETTER + len(model.alphabet))
    unknown = np.bincount(owner, minlength=len(texts)) == 0
    if not model.languages or not len(blocks):
        return np.full(len(texts), -1), np.zeros(len(texts))
    follows = np.r_[False, owner[1:] == owner[:-1]]
    rates = np.stack([math.log2(p.length + 2) * np.bincount(owner, weights=p.phrases(blocks, follows), minlength=len(texts)) for p in model.parsers])
    best = rates.argmin(axis=0)
    closeness = 1 / np.maximum(rates, 1e-9)
    score = closeness[best, np.arange(len(texts))] / closeness.sum(axis=0)
    return np.where(unknown, -1, best), np.where(unknown, 0.0, np.clip(score, 0, 1))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """One row per row of ``docs``: id, the columns given in ``more``, lang_pred, score (the winner's share of closeness).

    The whole text is parsed.  A null text, or one without a letter, gives ``und`` and 0; ties go to the first language in
    order.  An empty training set makes every text ``und``.  Repeated rows and null ids give a row each.  Columns in ``more``
    may have any name but those of the result.  No shuffle; the model (an automaton for each language) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = carried(docs, id_col, text_col, *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table, names = codes_by_point(model.alphabet), np.array([*model.languages, UNDETERMINED], object)
        for batch, texts in slices(batches, limit=SLICE):
            best, score = classify(texts, model, table)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("more"), pa.array(names[best], pa.string()), pa.array(score)], ["id", "more", "lang_pred", "score"])

    found = kept.mapInArrow(task(run), schema_of(kept, ["id", "more"], "lang_pred string, score double"))
    return found.select(F.col("id").alias(id_col), *[F.col("more")[x].alias(x) for x in kept.schema["more"].dataType.names[1:]], "lang_pred", "score")


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text"):
    """For ``common.keep_rows``: which texts have a language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return lambda texts: classify(texts, shared.value, codes_by_point(shared.value.alphabet))[0] >= 0
