"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of it. A text is cross-parsed: phrases are
the longest runs that the automaton can follow, and the language that needs the fewest phrases (for each character, times
the log of its text's length, the cost of a pointer into it) wins. Texts are parsed whole. Segments of SEGMENT symbols are
stepped through side by side, each as if a phrase began there; then each is parsed again from the state in which the one
before it really ended, until both parses stand in one state, so phrases run across segments and the count is that of one
pass.

Characters: A text is lower-cased; each letter and combining mark of the samples, of any script, is a symbol, runs of
everything else (space, digits, punctuation) are one separator symbol. A letter that a language's sample lacks ends a phrase
and is a phrase of its own.
A language of up to DENSE letters has its moves as one table, one of more letters (Chinese, Korean) as sorted keys.

Fit: a bounded, documented sample: the rows with the smallest hashes of doc_id, SAMPLE_ROWS a language at most, until
SAMPLE_CHARS symbols. Everything else covers every row.

Null texts and texts without a letter are "und" with score 0. No labelled row at all: every text is "und". Equal figures
go to the first language in order of its name. Rows that repeat are judged alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import kept, lean_batches, narrowed, read_table

SAMPLE_ROWS, SAMPLE_CHARS = 400, 40_000
SALTS = 64
DENSE = 94  # letters; with the separator and the unseen letter 96 columns
SEGMENT = 256
LANES = 1 << 14
SEP = 0


def normal_codes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts one behind the other, runs of separators squeezed, and where each text begins."""
    lower = [t.lower() for t in texts]
    flat = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = table[np.minimum(flat, len(table) - 1)]
    at = np.cumsum([0, *map(len, lower)])
    first = np.zeros(len(codes) + 1, bool)
    first[at] = True
    keep = codes != SEP
    keep[1:] |= (codes[1:] == SEP) & (codes[:-1] != SEP)
    keep |= first[:-1]
    sums = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], sums[at]


def letter_table(texts: list[str]) -> np.ndarray:
    """Code point -> symbol: the letters of texts have their own, the most common first; other letters share the last; the rest SEP."""
    seen = Counter("".join(texts).lower())
    kind = (unicodedata.category(chr(p))[0] for p in range(sys.maxunicode + 1))
    letters = np.fromiter((k in "LM" for k in kind), bool, sys.maxunicode + 1)
    own = sorted((c for c in seen if letters[ord(c)]), key=lambda c: (-seen[c], c))
    table = np.where(letters, len(own) + 1, SEP).astype(np.int32)
    for n, c in enumerate(own, 1):
        table[ord(c)] = n
    return table


class Automaton:
    """The suffix automaton of codes; letters are narrowed to those that occur in it, all others are one more symbol."""

    def __init__(self, codes: np.ndarray, symbols: int):
        own = np.unique(codes[codes != SEP])
        self.width = len(own) + 2
        self.local = np.full(symbols, len(own) + 1, np.int32)
        self.local[own] = np.arange(1, len(own) + 1)
        self.local[SEP] = SEP
        moves = suffix_moves(self.local[codes])
        self.root = np.ones(self.width, np.int32)  # an unknown symbol is a phrase of its own and leads to the root
        for c, s in moves[0].items():
            self.root[c] = 2 * s + 1
        at = [(s * self.width + c, 2 * t) for s, m in enumerate(moves) if s for c, t in m.items()]  # at the root a phrase begins
        key, to = (np.array(x, np.int64) for x in zip(*at, strict=True)) if at else (np.zeros(0, np.int64),) * 2
        self.table = None
        if len(own) <= DENSE:
            self.table = np.tile(self.root, len(moves))
            self.table[key] = to
        else:
            order = np.argsort(key)
            self.key, self.to = np.append(key[order], np.iinfo(np.int64).max), np.append(to[order], 0).astype(np.int32)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next states, times 2, plus 1 where the symbol begins a phrase: at the root, and where no move exists."""
        if self.table is not None:
            return self.table[(state >> 1) * self.width + c]
        key = (state >> 1).astype(np.int64) * self.width + c
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.to[at], self.root[c])


def suffix_moves(codes: np.ndarray) -> list[dict[int, int]]:
    """The moves of each state of the suffix automaton of codes."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return moves


def _stepped(moves: Automaton, padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each segment that begins at the root, and the state (times 2) at its end."""
    count, end = np.zeros(len(start), np.int64), np.zeros(len(start), np.int32)
    order = np.argsort(-size, kind="stable")
    for lo in range(0, len(order), LANES):
        lanes = order[lo : lo + LANES]
        s, z = start[lanes], size[lanes]
        state, n = np.zeros(len(s), np.int32), np.zeros(len(s), np.int32)
        for step, k in enumerate(np.searchsorted(-z, -np.arange(1, int(z[0]) + 1), "right")):
            move = moves.step(state[:k], moves.local[padded[s[:k] + step]])
            n[:k] += move & 1
            state[:k] = move
        count[lanes], end[lanes] = n, state & ~1
    return count, end


def _met(moves: Automaton, padded: np.ndarray, start: np.ndarray, size: np.ndarray, given: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many more phrases begin in segments entered in the given states than at the root, and the states they end in.

    Both parses go on side by side until they stand in one state; fresh is where the one from the root ends.
    """
    more, end = np.zeros(len(start), np.int64), fresh.copy()
    lane, a, b, step = np.arange(len(start)), given.copy(), np.zeros(len(start), np.int32), 0
    while len(lane):
        c = moves.local[padded[start[lane] + step]]
        a, b, step = moves.step(a, c), moves.step(b, c), step + 1
        more[lane] += (a & 1) - (b & 1)
        apart = (a | 1) != (b | 1)
        over = size[lane] == step
        end[lane[apart & over]] = a[apart & over] & ~1
        go = apart & ~over
        lane, a, b = lane[go], a[go], b[go]
    return more, end


class Model:
    """Automata of all languages, built from their sample texts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.table = letter_table([t for ts in samples.values() for t in ts])
        self.moves, self.cost = [], []
        for name in self.languages:
            codes = normal_codes(samples[name], self.table)[0][:SAMPLE_CHARS]
            self.moves.append(Automaton(codes, int(self.table.max()) + 1))
            self.cost.append(math.log2(max(len(codes), 2)))

    def phrases(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) by each language (columns)."""
        n = np.diff(at)
        pieces = -(-n // SEGMENT)
        owner = np.repeat(np.arange(len(n)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = at[owner] + number * SEGMENT
        size = np.minimum(SEGMENT, at[owner + 1] - start)
        padded = np.append(codes, np.zeros(SEGMENT, codes.dtype)).astype(np.int32)
        out = np.zeros((len(n), len(self.moves)), np.int64)
        for i, moves in enumerate(self.moves):
            count, fresh = _stepped(moves, padded, start, size)
            real, more = fresh.copy(), np.zeros(len(owner), np.int64)
            todo = np.flatnonzero((number[1:] > 0) & (fresh[:-1] != 0)) + 1  # behind a segment that ends within a phrase
            while len(todo):
                more[todo], end = _met(moves, padded, start[todo], size[todo], real[todo - 1], fresh[todo])
                behind = todo[end != real[todo]] + 1
                real[todo] = end
                behind = behind[behind < len(owner)]
                todo = behind[number[behind] > 0]
            out[:, i] = np.bincount(owner, weights=count + more, minlength=len(n)).astype(np.int64)
        return out

    def judge(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        codes, at = normal_codes(texts, self.table)
        cost = self.phrases(codes, at) * np.array(self.cost) / np.maximum(np.diff(at), 1)[:, None]
        best = np.argmin(cost, axis=1)
        low = cost[np.arange(len(best)), best]
        rest = np.partition(cost, 1, axis=1)[:, 1] if len(self.languages) > 1 else 2 * low
        score = np.clip(np.where(rest > 0, (rest - low) / np.maximum(rest, 1e-9), 0.0), 0.0, 1.0)
        lettered = [any(map(str.isalpha, t)) for t in texts]
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], [float(x) if ok else 0.0 for x, ok in zip(score, lettered, strict=True)]


def model_of(samples: bytes) -> Model:
    """The model of pickled samples; kept for as long as the worker lives."""
    return kept(("language", hashlib.sha256(samples).digest()), lambda: Model(pickle.loads(samples)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> bytes:
    """Sample texts by language from labelled docs (doc_id, text, lang), pickled. At most rows texts of each language."""
    lean_batches(docs.sparkSession)
    known = narrowed(docs, doc_id="doc_id", text="text", lang="lang").where("text is not null and lang is not null")
    # Ids first, so that texts of the sample alone are moved.
    # A common language is ranked in SALTS parts first, so that no task gets more than rows of each part.
    picked = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("key"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).alias("salt"))
    for part in (["lang", "salt"], ["lang"]):
        picked = picked.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("key", "doc_id"))).where(F.col("rank") <= rows)
    texts = known.join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    samples: dict[str, dict] = {}
    size: Counter = Counter()
    for r in texts.select("lang", "text", F.xxhash64("doc_id").alias("key")).orderBy("key", "lang", "text").toLocalIterator():
        if size[r["lang"]] < 2 * SAMPLE_CHARS:
            samples.setdefault(r["lang"], {})[r["text"]] = None  # copies teach nothing new
            size[r["lang"]] += len(r["text"])
    return pickle.dumps({k: list(v) for k, v in samples.items()})


def judged(model: Model, column: pa.Array) -> tuple[list[str], list[float]]:
    """The model's judgement of each text, about two million characters at a time."""
    preds, scores = [], []
    texts = [t or "" for t in column.to_pylist()]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < 2_000_000):
            size += len(texts[j])
            j += 1
        p, s = model.judge(texts[i:j])
        preds += p
        scores += s
        i = j
    return preds, scores


def identified(docs: DataFrame, samples: bytes) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches):
        model = model_of(shared.value)
        for batch in batches:
            preds, scores = judged(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return narrowed(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, samples: bytes) -> DataFrame:
    """docs without the rows in no language ("und"); a missing lang is filled with the prediction. Rows keep their columns."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"])
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches):
        model = model_of(shared.value)
        for batch in batches:
            preds, _ = judged(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string())], names=["row", "pred"])

    named = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, pred string").where("pred <> 'und'")
    return named.select(*[(F.coalesce(F.col("row.lang"), F.col("pred")) if c == "lang" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return identified(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE: dict[str, str] = {}
