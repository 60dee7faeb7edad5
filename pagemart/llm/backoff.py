"""Language-model scores from a weighted backoff automaton over the whole corpus.

States are known contexts (the last words read), arcs are known n-grams with a smoothed
log-probability, and a state's failure arc goes to the shorter context with the weight that is
left for unknown words. A text is read once from left to right: each word follows an arc of
the current state, or failure arcs until one has it.

An n-gram's probability is t * c(context, word) / c(context) + (1 - t) * p(word | shorter
context), down to the base model of single words. The trust t in a context is c / (c + MASS),
at most TRUST: rare contexts are trusted little, and frequent ones leave room for words never
seen after them. The probabilities of each state sum to 1; the failure weight is 1 - t.

The automaton grows with the corpus and stays distributed. Texts are put into blocks by hash.
Each block asks for the counts of its own distinct n-grams and adds its training counts; the
requests are dealt out by n-gram hash, added up, and the totals go back to the blocks, which
so hold exactly the part of the automaton that their texts can visit. Requests and answers are
sorted arrays, one per block and shard, so a frequent n-gram costs one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemart.llm.common import documents
from pagemart.llm.hashing import END, mixed, word_hashes
from pagemart.llm.language import remainder

ORDER = 2
MASS = 100.0
TRUST = 0.4
#: Tokens that are read in one go; a longer text is read in several lanes.
LANE = 1024
_STEP = 1 << 18
#: About so many bytes of text in a block; a block is one task's work and so bounds its memory.
BLOCK_BYTES = 6 << 20


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, place of each text's first token and of the end).

    The tokens of a text are its words and one end.
    """
    words, counts = word_hashes(texts)
    begins = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts + 1, out=begins[1:])
    found = np.full(begins[-1], END, np.uint64)
    is_word = np.ones(len(found), bool)
    is_word[begins[1:] - 1] = False
    found[is_word] = words
    return found, begins


def ngrams(found: np.ndarray, begins: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to order, the hash of the n-gram that ends at each token, 0 where none does.

    The word before the first is the end of the text before, which marks the beginning.
    """
    place = np.arange(len(found)) - np.repeat(begins[:-1], np.diff(begins))
    levels = [found]
    before = np.concatenate([[END], found[:-1]])
    before[begins[:-1]] = END
    for n in range(2, order + 1):
        context = before if n == 2 else np.concatenate([[np.uint64(0)], levels[-1][:-1]])
        grams = mixed(context * np.uint64(0xA0761D6478BD642F) + found, n)
        grams[grams == 0] = 1
        if n > 2:
            grams[place < n - 2] = 0
        levels.append(grams)
    return levels


def contexts(levels: list[np.ndarray], begins: np.ndarray) -> list[np.ndarray]:
    """For n = 2 to order, the (n-1)-gram before each token, 0 where there is none."""
    found = []
    for n in range(2, len(levels) + 1):
        before = np.concatenate([[np.uint64(0)], levels[n - 2][:-1]])
        before[begins[:-1]] = END if n == 2 else 0
        found.append(before)
    return found


def _counted(values: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values without 0, how often each stands in a training place)."""
    keys, inverse = np.unique(values, return_inverse=True)
    counts = np.bincount(inverse, weights=training, minlength=len(keys)).astype(np.uint32)
    return (keys[1:], counts[1:]) if len(keys) and keys[0] == 0 else (keys, counts)


def _shard_borders(shards: int) -> np.ndarray:
    """The first hash of each shard but the first."""
    return np.array([-(-(i << 64) // shards) for i in range(1, shards)], np.uint64)


def _cut(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.concatenate([[0], np.searchsorted(keys, _shard_borders(shards)), [len(keys)]])


def _packed(keys: np.ndarray, shards: int) -> bytes:
    """Sorted keys of one shard as six bytes each: the 48 bits below those that chose the shard.

    A shard has some million keys, so equal bits of different keys are as good as unheard of.
    """
    rest = (keys * np.uint64(shards)) >> np.uint64(16)
    high, low = (rest >> np.uint64(16)).astype(np.uint32), (rest & np.uint64(0xFFFF)).astype(np.uint16)
    return high.tobytes() + low.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    count = len(data) // 6
    high = np.frombuffer(data, np.uint32, count).astype(np.uint64)
    return (high << np.uint64(16)) | np.frombuffer(data, np.uint16, count, 4 * count)


class Block:
    """The n-grams of one block of texts."""

    def __init__(self, table: pa.Table, order: int):
        self.found, self.begins = tokens(table["text"])
        held_out = np.array(table["held_out"].to_pylist(), bool)
        self.training = np.repeat(~held_out, np.diff(self.begins))
        self.levels = ngrams(self.found, self.begins, order)

    def requests(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for values in self.levels:
            yield _counted(values, self.training)


def _total(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts, and the sum of their counts."""
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.concatenate([c for _, c in parts])
    return keys, np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64)


def _at(keys: np.ndarray, totals: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The total of each wanted key, 0 for those without one."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, totals[place], 0)


def _place(keys: np.ndarray, totals: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key that has a count, -1 for the others."""
    if not len(keys):
        return np.full(len(wanted), -1)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[place] == wanted) & (totals[place] > 0), place, -1)


class Automaton:
    """The part of the automaton that the texts of a block can visit.

    `states[l]` has a state for each n-gram of l + 1 words of the block, by its sorted hashes;
    those without a count in training are never entered. A state's arc for a word leads to the
    n-gram of both, so arcs are found by that n-gram's hash. The empty state has an arc for
    every word.
    """

    def __init__(self, block: Block, known: list[tuple[np.ndarray, np.ndarray]], n: int, v: int, mass: float):
        self.block, self.known, self.order = block, known, len(known)
        keys, counts = known[0]
        #: The place of each token among the single words, and the weight and count of those.
        self.words = np.searchsorted(keys, block.found).astype(np.int32)
        self.counts = counts
        self.base = np.log10(counts + 0.5) - np.log10(n + 0.5 * (v + 1))
        #: Per n-gram: weight of the arc that ends in it; of its state, the failure arc's weight
        #: and the place of the shorter state it leads to, -1 for the empty one.
        self.arcs: list[np.ndarray] = [np.zeros(0)]
        self.failures = [np.log10(1 - _trust(counts, mass))]
        self.shorter = [np.full(len(keys), -1, np.int32)]
        before = contexts(block.levels, block.begins)
        probability = 10.0**self.base
        for level in range(1, self.order):
            keys, totals = known[level]
            # A place of each n-gram in the texts tells its context, last word and shorter form.
            at = np.zeros(len(keys), np.int32)
            for start in range(0, len(block.found), _STEP):
                grams = block.levels[level][start : start + _STEP]
                where = np.flatnonzero(grams)
                at[np.searchsorted(keys, grams[where])] = where + start
            last = block.levels[level - 1][at]
            trust = _at(*known[level - 1], before[level - 1][at]).astype(float)
            seen = totals / np.maximum(trust, 1)
            trust = _trust(trust, mass)
            seen *= trust
            probability = probability[np.searchsorted(known[level - 1][0], last)]
            probability *= 1 - trust
            probability += seen
            del seen, trust, at
            self.arcs.append(np.log10(probability))
            self.shorter.append(_place(*known[level - 1], last).astype(np.int32))
            # The longest n-grams are no states: no failure arc leaves them.
            is_state = level + 1 < self.order
            self.failures.append(np.log10(1 - _trust(totals, mass)) if is_state else np.zeros(0))

    def starts(self, places: np.ndarray, is_begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states (length and place) before the tokens: the longest known contexts."""
        length, state = np.zeros(len(places), np.int64), np.full(len(places), -1)
        for level in range(self.order - 1):
            if level == 0:
                hashes = np.where(is_begin, END, self.block.found[places - 1])
            else:
                hashes = np.where(is_begin, 0, self.block.levels[level][places - 1])
            found = _place(*self.known[level], hashes.astype(np.uint64))
            length, state = np.where(found >= 0, level + 1, length), np.where(found >= 0, found, state)
        return length, state

    def step(self, tokens: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Read one token in each lane; the states change in place. Returns the log-probabilities.

        A lane follows failure arcs until a state has an arc for its token.
        """
        read = np.zeros(len(tokens))
        words = self.block.found[tokens]
        moved = np.zeros(len(tokens), bool)
        for level in range(self.order - 1, 0, -1):
            lanes = np.flatnonzero((length == level) & ~moved)
            if not len(lanes):
                continue
            own = state[lanes]
            grams = mixed(self.known[level - 1][0][own] * np.uint64(0xA0761D6478BD642F) + words[lanes], level + 1)
            grams[grams == 0] = 1
            arc = _place(*self.known[level], grams)
            has = arc >= 0
            read[lanes] += np.where(has, self.arcs[level][arc], self.failures[level - 1][own])
            moved[lanes] = has
            if level + 1 < self.order:
                to, longer = arc, level + 1
            else:
                to, longer = self.shorter[level][arc], level
            fallen = self.shorter[level - 1][own]
            state[lanes] = np.where(has, to, fallen)
            length[lanes] = np.where(has, longer, level - 1)
        lanes = np.flatnonzero(~moved)
        own = self.words[tokens[lanes]]
        read[lanes] += self.base[own]
        if self.order > 1:
            found = np.where(self.counts[own] > 0, own, -1)
            state[lanes], length[lanes] = found, (found >= 0).astype(np.int64)
        return read


def _trust(counts: np.ndarray, mass: float) -> np.ndarray:
    return np.minimum(counts / (counts + mass), TRUST)


def traverse(
    block: Block, known: list[tuple[np.ndarray, np.ndarray]], n: int, v: int, mass: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base score, score, known tokens) of each text of the block.

    `known` has the sorted n-grams of each length with their totals. Every text is read from left
    to right and its state carried from word to word. Texts are read side by side, a token of
    each in a step; a long one in lanes of LANE tokens, of which each starts in the state that the
    words before it lead to.
    """
    automaton = Automaton(block, known, n, v, mass)
    sizes = np.diff(block.begins)
    lanes = -(-sizes // LANE)
    text = np.repeat(np.arange(len(sizes)), lanes)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    first = block.begins[:-1][text] + nth * LANE
    length = np.minimum(block.begins[1:][text] - first, LANE)
    # The longest lanes first, so the lanes that still read are always the first ones.
    order = np.argsort(-length, kind="stable")
    text, first, length, nth = text[order], first[order], length[order], nth[order]
    depth, state = automaton.starts(first, nth == 0)
    scores = np.zeros(len(first))
    reading = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    for step, count in enumerate(reading):
        own = slice(0, count)
        scores[own] += automaton.step(first[own] + step, depth[own], state[own])
    starts = block.begins[:-1]
    return (
        np.add.reduceat(automaton.base[automaton.words], starts),
        np.bincount(text, scores, len(sizes)),
        np.add.reduceat((automaton.counts > 0)[automaton.words].astype(np.int64), starts),
    )


def score_documents(
    docs: DataFrame, held_out: Column, order: int = ORDER, mass: float = MASS
) -> DataFrame:
    """Scores of every text by a model of the rows where the column `held_out` is false.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). A null or empty
    text is one end token. Equal rows each get their own equal row and each count in training.
    Further columns are ignored. Without training rows every token has the probability 1. An
    empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    # An end counts as the beginning of the next text, so contexts of END are beginnings.
    rows = docs.select(
        "doc_id",
        "text",
        held_out.alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
    )

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        asked = list(Block(table, order).requests())
        cuts = [_cut(keys, blocks) for keys, _ in asked]
        columns: dict[str, list] = {"block": [], "shard": [], "keys": [], "counts": []}
        for shard in range(blocks):
            parts = [slice(c[shard], c[shard + 1]) for c in cuts]
            columns["block"].append(key[0].as_py())
            columns["shard"].append(shard)
            columns["keys"].append([_packed(k[p], blocks) for (k, _), p in zip(asked, parts, strict=True)])
            columns["counts"].append([c[p].tobytes() for (_, c), p in zip(asked, parts, strict=True)])
        return pa.table(columns, schema=REQUEST)

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        levels = []
        for level in range(order):
            parts = [
                (_unpacked(r["keys"][level]), np.frombuffer(r["counts"][level], np.uint32))
                for r in rows
            ]
            levels.append(_total(parts))
        answers = []
        for r in rows:
            asked = [_unpacked(k) for k in r["keys"]]
            totals = [
                t[np.searchsorted(k, a)].tobytes()
                for (k, t), a in zip(levels, asked, strict=True)
            ]
            answers.append(
                {
                    "block": r["block"],
                    "shard": r["shard"],
                    "totals": totals,
                    "n": int(levels[0][1].sum()),
                    "v": int((levels[0][1] > 0).sum()),
                }
            )
        return pa.Table.from_pylist(answers, schema=ANSWER)

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return RESULT.empty_table()
        block = Block(texts, order)
        answers = answers.sort_by("shard").to_pylist()
        n, v = sum(a["n"] for a in answers), sum(a["v"] for a in answers)
        known = []
        for level, (keys, _) in enumerate(block.requests()):
            totals = b"".join(a["totals"][level] for a in answers)
            known.append((keys, np.frombuffer(totals, np.int64)))
        base, scores, n_known = traverse(block, known, n, v, mass)
        columns = {
            "doc_id": texts["doc_id"],
            "held_out": texts["held_out"],
            "n_tokens": np.diff(block.begins),
            "n_known": n_known,
            "train_tokens": np.full(texts.num_rows, n),
            "base_score": base,
            "score": scores,
        }
        return pa.table(columns, schema=RESULT)

    lists = pa.list_(pa.binary())
    REQUEST = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("keys", lists), ("counts", lists)])
    ANSWER = pa.schema(
        [("block", pa.int32()), ("shard", pa.int32()), ("totals", lists), ("n", pa.int64()), ("v", pa.int64())]
    )
    new = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    result = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(new)])
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    RESULT = pa.schema(
        [("doc_id", _arrow(docs, "doc_id")), *zip(result.names[1:], kinds, strict=True)]
    )
    requests = rows.groupBy("block").applyInArrow(
        ask, "block int, shard int, keys array<binary>, counts array<binary>"
    )
    answers = requests.groupBy("shard").applyInArrow(
        answer, "block int, shard int, totals array<binary>, n long, v long"
    )
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, result)


def _arrow(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, remainder(F.col("doc_id"), 5) == 1)
