"""Encoding texts into pieces of a given vocabulary, the n best ways, and decoding them.

A text is a lattice: nodes are places between characters, edges are vocabulary pieces with a
log-probability (and byte pieces for characters without a piece). A forward Viterbi pass gives
the best score up to each place. A backward A-star search from the end, with those scores as
exact heuristic, then yields segmentations from best to worst.

No piece of the vocabulary reaches across the start of a word, so every path passes the places
between words. The lattice of a text is therefore searched word by word: words are segmented
once per worker, and only the few words whose second-best way costs least can differ among the
n best ways of the whole text. The result is that of a search over the whole lattice.

The vocabulary is read once by the driver and broadcast; its size does not depend on the data.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemart.llm.common import documents

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
#: Words a worker remembers, about 180 bytes each; beyond that it keeps those used again.
REMEMBERED = 250_000
#: Texts are answered in slices of about so many characters.
SLICE_CHARS = 1 << 19
#: A byte piece scores so much less than the rarest piece.
BYTE_PENALTY = 10.0
#: Scores are added up as whole numbers of this unit, so that equal ways are exactly equal.
UNIT = 1e-6

#: Stands for the cost of a second-best way where there is none.
NO_WAY = (1 << 63) - 1

#: What follows where the tree ends.
NO_NODE = (None, -1, {})

#: Fixed values of the piece format.
SPACE = "▁"
WHITE = "".join(filter(str.isspace, map(chr, range(0x3001))))


def read_vocabulary(path: str) -> tuple[list[tuple[int, str, float]], list[int]]:
    """(id, piece, log-probability) of the ordinary pieces, and the ids of the 256 bytes.

    A vocabulary made by merges scores its pieces by merge order, which cannot be added up;
    their log-probability is that of Zipf's law for the order. Other scores are taken as they
    are.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
    ordinary = [i for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
    scores = [model.get_score(i) for i in ordinary]
    if all(s == int(s) for s in scores):
        total = math.log(sum(1 / (r + 2) for r in range(len(ordinary))))
        scores = [-math.log(r + 2) - total for r in range(len(ordinary))]
    pieces = [(i, model.id_to_piece(i), s) for i, s in zip(ordinary, scores, strict=True)]
    for _, piece, _ in pieces:
        if re.search(rf"[^{SPACE}]{SPACE}| ", piece):
            raise ValueError(f"the piece {piece!r} reaches across words")
    return pieces, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


class Words(dict):
    """Words by number; an unknown one is segmented when it is asked for.

    The segmentations are in plain arrays, by number: objects of their own would take more
    memory than the words. Most words come once, so those that came again are worth keeping.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.clear()

    def clear(self) -> None:
        super().clear()
        #: Of word i: ids[ends[i]:ends[i + 1]], the score, and what the second-best way costs.
        self.ids, self.ends = array("i"), array("q", [0])
        self.scores, self.gaps = array("q"), array("q")
        #: Whether the word was asked for again.
        self.again = bytearray()

    def forget(self) -> None:
        """Only words that were asked for again since the last time stay, half of REMEMBERED at most."""
        names = list(self)
        kept = np.flatnonzero(np.frombuffer(self.again, np.uint8))[:REMEMBERED // 2]
        ends = np.frombuffer(self.ends, np.int64)
        sizes = ends[kept + 1] - ends[kept]
        ids = gathered(np.frombuffer(self.ids, np.int32), ends[kept], sizes)
        scores, gaps = (np.frombuffer(v, np.int64)[kept] for v in (self.scores, self.gaps))
        self.clear()
        self.update((names[i], number) for number, i in enumerate(kept.tolist()))
        self.ids.frombytes(ids.tobytes())
        self.ends.frombytes(np.cumsum(sizes, dtype=np.int64).tobytes())
        self.scores.frombytes(scores.tobytes())
        self.gaps.frombytes(gaps.tobytes())
        self.again = bytearray(len(kept))

    def __missing__(self, unit: str) -> int:
        ids, score, gap = self.codec.word(unit)
        self.ids.frombytes(ids)
        self.ends.append(len(self.ids))
        self.scores.append(score)
        self.gaps.append(gap)
        self.again.append(0)
        number = self[unit] = len(self)
        return number


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + sizes[i]] of every i, one after the other."""
    after = np.cumsum(sizes)
    return values[np.repeat(starts - after + sizes, sizes) + np.arange(after[-1] if len(after) else 0)]


def smallest(values: np.ndarray, count: int) -> list[int]:
    """The places of the `count` smallest values, the first of equal ones first."""
    places = np.arange(len(values))
    if 0 < count < len(values):
        places = np.flatnonzero(values <= np.partition(values, count - 1)[count - 1])
    return places[np.argsort(values[places], kind="stable")][:count].tolist()


class Codec:
    """The vocabulary as a tree of characters, and the words segmented so far."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.scores = {piece: round(s / UNIT) for _, piece, s in pieces}
        self.ids = {piece: i for i, piece, _ in pieces}
        self.longest = max(map(len, self.ids), default=1)
        self.byte_score = min(self.scores.values(), default=0) - round(BYTE_PENALTY / UNIT)
        # A node: the score and id of the piece that ends here, or None, and what follows.
        self.root: dict = {}
        for piece, score in self.scores.items():
            node: list = [None, 0, self.root]
            for c in piece:
                node = node[2].setdefault(c, [None, 0, {}])
            node[:2] = [float(score), self.ids[piece]]
        raw = [b""] * (max([*byte_ids, *self.ids.values()]) + 1)
        for piece, i in self.ids.items():
            raw[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        # The bytes of all pieces in one array, and how many each has.
        self.bytes, self.sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
        self.starts = np.cumsum(self.sizes) - self.sizes
        # White space that no longer piece holds stands alone, like a literal mark.
        joined = set("".join(p for p in self.ids if len(p) > 1))
        alone = re.escape("".join(c for c in WHITE if c not in joined and c != " ") + SPACE)
        self.units = re.compile(f" *[^ {alone}]+|[{alone}]| +")
        self.words = Words(self)
        self.ways: dict = {}

    def __reduce__(self):
        return Codec, (self.pieces, self.byte_ids)

    def forward(self, unit: str) -> tuple[list, list, list[int], list[int]]:
        """Best and second-best score up to each place, where the best path comes from, and
        the id of its last piece (-1 for bytes).

        Scores are whole numbers as floats, exact up to 2^53, which are quickly compared.
        """
        n, none = len(unit), -math.inf
        best, second = [0.0] + [none] * n, [none] * (n + 1)
        back, last = [0] * (n + 1), [-1] * (n + 1)
        if unit == SPACE:
            # A literal mark must not become a space: its bytes only.
            return [0.0, 3.0 * self.byte_score], second, back, last
        chars = unit.replace(" ", SPACE)
        first, longest = self.root.get, self.longest
        for i, c in enumerate(chars):
            here, behind, j = best[i], second[i], i + 1
            score, piece, following = first(c, NO_NODE)
            if score is None:
                score, piece = float(self.byte_score * len(unit[i].encode())), -1
            found = here + score
            if found > best[j]:
                other = behind + score
                second[j] = best[j] if best[j] > other else other
                best[j], back[j], last[j] = found, i, piece
            elif found > second[j]:
                second[j] = found
            for c in chars[j : i + longest]:
                if c not in following:
                    break
                score, piece, following = following[c]
                j += 1
                if score is not None:
                    found = here + score
                    if found > best[j]:
                        other = behind + score
                        second[j] = best[j] if best[j] > other else other
                        best[j], back[j], last[j] = found, i, piece
                    elif found > second[j]:
                        second[j] = found
        return best, second, back, last

    def word(self, unit: str) -> tuple[bytes, int, int]:
        """The best ids (as 32-bit numbers), their score, and what the second-best way costs."""
        best, second, back, last = self.forward(unit)
        end, ids = len(unit), []
        while end:
            start = back[end]
            if last[end] >= 0:
                ids.append(last[end])
            else:
                ids += [self.byte_ids[b] for b in reversed(unit[start:end].encode())]
            end = start
        ids.reverse()
        gap = best[-1] - second[-1]
        return array("i", ids).tobytes(), int(best[-1]), NO_WAY if gap == math.inf else int(gap)

    def _edges(self, unit: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, score) of the whole lattice of a unit, by start."""
        if unit == SPACE:
            yield 0, 1, 3 * self.byte_score
            return
        chars = unit.replace(" ", SPACE)
        for i in range(len(unit)):
            single = False
            for j in range(i + 1, min(i + self.longest, len(unit)) + 1):
                score = self.scores.get(chars[i:j])
                if score is not None:
                    single = single or j == i + 1
                    yield i, j, score
            if not single:
                yield i, i + 1, self.byte_score * len(unit[i].encode())

    def _edge_ids(self, unit: str, start: int, end: int) -> list[int]:
        piece = unit[start:end]
        known = self.ids.get(piece.replace(" ", SPACE)) if unit != SPACE else None
        return [known] if known is not None else [self.byte_ids[b] for b in piece.encode()]

    def search(self, unit: str, count: int) -> list[tuple[int, bytes]]:
        """The `count` best ways of a unit, as (cost against the best, ids).

        Backward A-star: a hypothesis is a path from some place to the end, and its priority is
        its own score plus the best score up to that place, which is exact. Among equal ones
        the one nearest to the beginning goes on, so ties are not spread out.
        """
        best = self.forward(unit)[0]
        into: list[list[tuple[int, int]]] = [[] for _ in range(len(unit) + 1)]
        for i, j, score in self._edges(unit):
            into[j].append((i, score))
        heap = [(-best[-1], len(unit), 0, 0, None)]
        made, found = 1, []
        while heap and len(found) < count:
            _, place, _, score, path = heapq.heappop(heap)
            if not place:
                ids: list[int] = []
                while path:
                    start, end, path = path
                    ids += self._edge_ids(unit, start, end)
                found.append((best[-1] - score, array("i", ids).tobytes()))
            for start, edge in into[place]:
                total = score + edge
                step = (-(total + best[start]), start, made, total, (start, place, path))
                heapq.heappush(heap, step)
                made += 1
        return found

    def encode(self, text: str, count: int) -> list[tuple[float, bytes]]:
        """The `count` best ways of a text, as (score, ids); a leading space is added."""
        units, words = self.units.findall(f" {text}"), self.words
        if len(words) > REMEMBERED:
            words.forget()
        known = len(words)
        numbers = np.fromiter(map(words.__getitem__, units), np.int64, len(units))
        np.frombuffer(words.again, np.uint8)[numbers[numbers < known]] = 1
        # An array cannot grow while a view of it is held.
        ends = np.frombuffer(words.ends, np.int64)
        starts, sizes = ends[numbers], ends[numbers + 1] - ends[numbers]
        best = gathered(np.frombuffer(words.ids, np.int32), starts, sizes).tobytes()
        score = int(np.frombuffer(words.scores, np.int64)[numbers].sum())
        gaps = np.frombuffer(words.gaps, np.int64)[numbers]
        del ends
        # A way that differs in any other word costs at least as much as `count` others.
        places = smallest(gaps, count - 1)
        ways: list[tuple[int, tuple]] = [(0, ())]
        for place in places:
            if gaps[place] == NO_WAY:
                continue
            unit = units[place]
            if len(self.ways) > REMEMBERED // 20:
                self.ways.clear()
            if (unit, count) not in self.ways:
                self.ways[unit, count] = self.search(unit, count)
            options = self.ways[unit, count]
            ways = [
                (cost + more, (*changes, (place, ids)) if rank else changes)
                for cost, changes in ways
                for rank, (more, ids) in enumerate(options)
            ]
            ways = sorted(ways, key=lambda w: w[0])[:count]
        after = 4 * np.cumsum(sizes)
        found = []
        for cost, changes in ways:
            parts, at = [], 0
            for place, ids in sorted(changes):
                parts += [best[at : after[place] - 4 * sizes[place]], ids]
                at = after[place]
            found.append(((score - cost) * UNIT, b"".join([*parts, best[at:]])))
        return found

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids; the added leading space goes."""
        ids = np.asarray(ids, np.int64)
        return gathered(self.bytes, self.starts[ids], self.sizes[ids]).tobytes().decode(errors="replace")[1:]


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_CHARS characters."""
    return ranges([None if t is None else len(t) for t in texts])


def ranges(lengths: list[int | None]) -> Iterator[tuple[int, int]]:
    """The same by the lengths of the texts."""
    start, size = 0, 0
    for i, length in enumerate(lengths):
        if i > start and size + (length or 0) > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += length or 0
    if start < len(lengths):
        yield start, len(lengths)


def _lists(parts: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(parts), np.int32), pa.int32())
    return pa.ListArray.from_arrays(offsets, values)


def codec(path: str = VOCABULARY) -> Codec:
    return Codec(*read_vocabulary(path))


def encode(docs: DataFrame, path: str = VOCABULARY, n_best: int = N_BEST) -> DataFrame:
    """All columns of `docs`, plus `ways` (score and ids, best first) and `round_trip`.

    `ways` has n_best entries, fewer if the text has fewer segmentations. `round_trip` tells
    that decoding the best ids gives the text back, and is null for a null text, whose `ways`
    is null; an empty text is one leading space. Repeated rows each get their own equal row.
    Columns of `docs` with the new names are replaced. An empty table gives no rows.
    """
    kept = docs.drop("ways", "round_trip")
    shared = docs.sparkSession.sparkContext.broadcast(codec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        # A worker may have served another operator; what that left is given back first.
        gc.collect()
        pa.default_memory_pool().release_unused()
        for batch in batches:
            for start, end in ranges(pc.utf8_length(batch["text"]).to_pylist()):
                # Only the texts of a slice are Python objects at a time.
                texts = batch["text"].slice(start, end - start).to_pylist()
                found = [None if t is None else own.encode(t, n_best) for t in texts]
                trips = [
                    None if ways is None else own.decode(np.frombuffer(ways[0][1], np.int32)) == text
                    for text, ways in zip(texts, found, strict=True)
                ]
                flat = [way for ways in found for way in ways or ()]
                each = pa.StructArray.from_arrays(
                    [pa.array([s for s, _ in flat], pa.float64()), _lists([i for _, i in flat])],
                    ["score", "ids"],
                )
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(ways or ()) for ways in found], out=offsets[1:])
                none = pa.array([ways is None for ways in found])
                ways = pa.ListArray.from_arrays(pa.array(offsets), each, mask=none)
                part = batch.slice(start, end - start)
                columns = [*part.columns, ways, pa.array(trips, pa.bool_())]
                yield pa.record_batch(columns, [*part.schema.names, "ways", "round_trip"])

    new = T.StructType.fromDDL("ways array<struct<score:double,ids:array<int>>>, round_trip boolean")
    return kept.mapInArrow(run, T.StructType([*kept.schema, *new]))


def decode(rows: DataFrame, path: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """All columns of `rows`, plus `text` from the ids; null ids give a null text."""
    kept = rows.drop("text")
    shared = rows.sparkSession.sparkContext.broadcast(codec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else shared.value.decode(i) for i in batch[ids].to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField("text", T.StringType())]))


def digest(encoded: DataFrame) -> DataFrame:
    """Piece counts, scores and a hash of the ids of each way."""
    return encoded.select(
        "doc_id",
        F.size(F.col("ways")[0]["ids"]).cast("long").alias("n_pieces"),
        F.transform("ways", lambda w: F.round(w["score"], 6)).alias("scores"),
        F.transform("ways", lambda w: F.xxhash64(w["ids"])).alias("ids_hash"),
        "round_trip",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(documents(spark, sf_dir).select("doc_id", "text")))
