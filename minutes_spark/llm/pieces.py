"""SentencePiece encoding and decoding: the n best segmentations of a text.

The lattice of a text has an arc for every vocabulary piece that occurs in it, weighted by the
piece's score, and for every character that is no piece an arc of its UTF-8 byte pieces, 10
below the lowest score. A space is the mark of the vocabulary and one more space is put in
front. Forward Viterbi gives the best score to every position; searching backward from the end
by A-star, that score is exactly what is left, so segmentations come out in order.

No piece reaches over the start of a space or over a character without a piece, so the lattice
of a text is a chain of short lattices. The search runs in each of them, and the n best of the
chain are the best combinations: only the n - 1 segments that lose least can take part in them.

Pieces of marks alone have no score in the vocabulary (a sentinel): one mark counts like a
character in bytes but keeps its id, and runs of marks are left out. The mark's own character in
a text is written in bytes, so decoding is exact.

Cases: a null text has null results; an empty text has one empty segmentation with score 0; of
equal scores the one found first comes first, the same in every run; fewer than n exist for
short texts; repeated rows get equal results; columns of the input stay unless
they have a result's name.
"""

import heapq
import re
from array import array
from collections import defaultdict
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import Index

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
#: Below the lowest score, for a character in bytes.
UNKNOWN = 10.0
#: Characters of text whose new segments are solved together, and the longest of those.
CHUNK_CHARS, TOGETHER = 500_000, 64
#: Solved segments that a worker keeps before it starts anew.
KEPT = 120_000
#: Texts whose results are Python objects at once.
_ROWS = 500
_SEGMENT = re.compile(r"[^ \n]+| [^ \n]*|\n")
RESULT = (
    "ids array<int>, score double, "
    "others array<struct<score:double,changes:array<struct<at:int,removed:int,ids:array<int>>>>>, exact boolean"
)


class Vocabulary:
    """Pieces, scores and byte pieces of a vocabulary; marks count as spaces."""

    def __init__(self, pieces):
        """``pieces``: (piece, score, kind) by id; kind is ``normal``, ``byte`` or another."""
        self.byte = [None] * 256
        self.raw = []
        self.trie = {}
        scores = [0.0] * len(pieces)
        scored = [s for p, s, kind in pieces if kind == "normal" and p.strip(MARK)]
        self.scores, self.unknown = scores, min(scored, default=0.0) - UNKNOWN
        for number, (piece, score, kind) in enumerate(pieces):
            text = piece.replace(MARK, " ")
            scores[number] = score = self.unknown if piece == MARK else score
            self.raw.append(b"")
            if kind == "byte":
                self.byte[int(piece[3:5], 16)] = number
                self.raw[-1] = bytes([int(piece[3:5], 16)])
            elif kind == "normal" and not (len(text) > 1 and not text.strip(" ")):
                self.raw[-1] = text.encode()
                if " " in text[1:] or ("\n" in text and len(text) > 1):
                    raise ValueError(f"piece {piece!r} reaches over the start of a space or a line")
                node = self.trie
                for letter in text:
                    node = node.setdefault(letter, {})
                node[None] = (number, score)

    @classmethod
    def load(cls, path=MODEL):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)

        def kind(number):
            if model.is_byte(number):
                return "byte"
            return "other" if model.is_control(number) or model.is_unknown(number) or model.is_unused(number) else "normal"

        return cls([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())])

    def bytes_of(self, letter):
        return [self.byte[b] for b in letter.encode("utf-8", "surrogatepass")]


class Lattice:
    """Arcs by end position: start, id (-1: in bytes), score; and the best score to each position."""

    def __init__(self, vocabulary, text):
        self.vocabulary, self.text = vocabulary, text
        size, trie = len(text), vocabulary.trie
        starts, ends, ids = array("i"), array("i"), array("i")
        scores = array("d")
        best = array("d", [-np.inf]) * (size + 1)
        came = array("i", [-1]) * (size + 1)
        best[0] = 0.0
        for at in range(size):
            node, base = trie.get(text[at]), best[at]
            if node is None or None not in node:
                one = vocabulary.unknown
                starts.append(at), ends.append(at + 1), ids.append(-1), scores.append(one)
                if base + one > best[at + 1]:
                    best[at + 1], came[at + 1] = base + one, len(ids) - 1
            end = at
            while node is not None:
                end += 1
                piece = node.get(None)
                if piece is not None:
                    number, one = piece
                    starts.append(at), ends.append(end), ids.append(number), scores.append(one)
                    if base + one > best[end]:
                        best[end], came[end] = base + one, len(ids) - 1
                if end == size:
                    break
                node = node.get(text[end])
        self.starts, self.ends, self.ids, self.scores = starts, ends, ids, scores
        self.best, self.came, self.size = best, came, size

    def path(self):
        """Ids of the best segmentation, and its arcs."""
        arcs, at = [], self.size
        while at:
            arcs.append(self.came[at])
            at = self.starts[self.came[at]]
        arcs.reverse()
        return self.spelled(arcs), arcs

    def spelled(self, arcs):
        out = []
        for arc in arcs:
            if self.ids[arc] < 0:
                out += self.vocabulary.bytes_of(self.text[self.starts[arc]])
            else:
                out.append(self.ids[arc])
        return tuple(out)

    def _arrays(self):
        """Ends of the arcs, and what each loses against the best way to its end; infinite for the best arc itself."""
        starts, ends, came = (np.frombuffer(x, np.int32) for x in (self.starts, self.ends, self.came))
        scores, best = (np.frombuffer(x, np.float64) for x in (self.scores, self.best))
        loss = best[ends] - (best[starts] + scores)
        loss[came[came >= 0]] = np.inf
        return ends, loss

    def loss(self, arcs):
        """Score that the second best segmentation lacks; infinite if there is none.

        The second best leaves the best way once, by the cheapest arc that ends on it.
        """
        if not arcs:
            return np.inf
        ends, loss = self._arrays()
        on = np.zeros(self.size + 1, bool)
        on[ends[np.array(arcs)]] = True
        return float(loss[on[ends]].min())

    def n_best(self, n):
        """(score, ids) of up to n segmentations, best first: A-star from the end.

        A forward score is the exact rest of a way, so a way taken from the queue follows the best arcs
        down to the start without entering the queue again. What it queues are its detours,
        arcs that end on that stretch, and of these no more than the segmentations still wanted. Of
        equal ways the one queued last goes on.
        """
        heap, out, queued = [(0.0, 0, self.size, ())], [], 0
        while heap and len(out) < n:
            lost, _, at, chain = heapq.heappop(heap)
            stretch, places = [], []
            while at:
                places.append(at)
                stretch.append(self.came[at])
                at = self.starts[self.came[at]]
            arcs = stretch[::-1]
            for arc, behind in _links(chain):
                arcs += [arc, *behind]
            out.append((self.best[self.size] - lost, self.spelled(arcs)))
            if len(out) == n:
                break
            for loss, step, arc in reversed(self._detours(places, n - len(out))):
                queued += 1
                heapq.heappush(heap, (lost + loss, -queued, self.starts[arc], (arc, stretch[:step][::-1], chain)))
        return out

    def _detours(self, places, wanted):
        """(loss, number of the place, arc) of the ``wanted`` cheapest other arcs into the places, cheapest first."""
        if self.size <= TOGETHER:
            step = dict(zip(places, range(len(places))))
            best, starts, scores, came = self.best, self.starts, self.scores, self.came
            found = [
                (best[end] - best[starts[arc]] - scores[arc], step[end], arc)
                for arc, end in enumerate(self.ends) if end in step and came[end] != arc
            ]
            return sorted(found)[:wanted]
        ends, loss = self._arrays()
        step = np.full(self.size + 1, -1)
        step[places] = np.arange(len(places))
        arcs = np.flatnonzero((step[ends] >= 0) & np.isfinite(loss))
        if len(arcs) > wanted:
            arcs = arcs[np.argpartition(loss[arcs], wanted - 1)[:wanted]]
        return sorted(zip(loss[arcs].tolist(), step[ends[arcs]].tolist(), arcs.tolist()))


def _links(chain):
    """(detour, best arcs behind it) from the start of the text to its end."""
    while chain:
        arc, behind, chain = chain
        yield arc, behind


def segments(text):
    """Parts of " " + text whose lattices form the chain of the whole lattice."""
    return _SEGMENT.findall(" " + text)


class Solved:
    """Best segmentations of distinct segments: ids end to end, scores, losses of the second best.

    All lattices are filled together: arcs of one length and one start depth never share an end.
    """

    def __init__(self, vocabulary, index):
        self.vocabulary, self.index = vocabulary, index
        self.parts, self.ids = [], np.zeros(0, np.int32)
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.sizes, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, parts):
        """Solve further segments; they are numbered on."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        score, loss = np.zeros(len(parts)), np.full(len(parts), np.inf)
        sizes, flats = np.zeros(len(parts), np.int64), {}
        short = np.flatnonzero(lengths <= TOGETHER)
        for at in np.flatnonzero(lengths > TOGETHER).tolist():
            lattice = Lattice(self.vocabulary, parts[at])
            ids, arcs = lattice.path()
            flats[at], sizes[at] = np.array(ids, np.int32), len(ids)
            score[at], loss[at] = lattice.best[lattice.size], lattice.loss(arcs)
        flat, sizes[short], score[short], loss[short] = self._together([parts[i] for i in short.tolist()], lengths[short])
        first = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), np.int32)
        ids[_spread(first[short], sizes[short])] = flat
        for at, own in flats.items():
            ids[first[at] : first[at] + len(own)] = own
        self.first = np.concatenate([self.first, first + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.parts += parts

    def _together(self, parts, lengths):
        """Ids end to end, sizes, scores and losses of short segments."""
        vocabulary, index = self.vocabulary, self.index
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)
        first = np.cumsum(lengths) - lengths
        depth = (np.arange(len(codes)) - np.repeat(first, lengths)).astype(np.uint8)
        left = np.repeat(lengths, lengths).astype(np.uint8) - depth
        # one more node than characters for each segment
        node = np.arange(len(codes), dtype=np.int32) + owner
        levels = []
        active, state = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.int32)
        length = 1
        while len(active):
            state = index.next(state, codes[active + length - 1])
            piece = index.piece[state]
            found = piece >= 0
            start, ids, scores = active[found], piece[found], index.score[state[found]]
            if length == 1:
                alone = active[~found]
                start = np.concatenate([start, alone])
                ids = np.concatenate([ids, np.full(len(alone), -1, ids.dtype)])
                scores = np.concatenate([scores, np.full(len(alone), vocabulary.unknown)])
            order = np.argsort(depth[start], kind="stable")
            start, ids, scores = start[order], ids[order], scores[order]
            cuts = np.searchsorted(depth[start], np.arange(TOGETHER + 1)).tolist()
            levels.append((length, start, node[start], ids, scores, cuts))
            on = (state > 0) & (left[active] > length)
            active, state = active[on], state[on]
            length += 1
        nodes = len(codes) + len(parts)
        best, after = np.full(nodes, -np.inf), np.full(nodes, -np.inf)
        came_level, came_arc = np.zeros(nodes, np.int8), np.zeros(nodes, np.int32)
        best[first + np.arange(len(parts))] = 0.0
        ends = first + lengths + np.arange(len(parts))
        after[ends] = 0.0
        deepest = int(lengths.max(initial=0))
        for d in range(deepest):
            for number, (length, _, start, _, scores, cuts) in enumerate(levels):
                low, high = cuts[d], cuts[d + 1]
                if low == high:
                    continue
                total, end = best[start[low:high]] + scores[low:high], start[low:high] + length
                better = np.flatnonzero(total > best[end])
                end = end[better]
                best[end], came_level[end], came_arc[end] = total[better], number, low + better
        for d in range(deepest - 1, -1, -1):
            for length, _, start, _, scores, cuts in levels:
                low, high = cuts[d], cuts[d + 1]
                if low < high:
                    own = start[low:high]
                    after[own] = np.maximum(after[own], scores[low:high] + after[own + length])
        ends_of = ends
        # walk back from all ends at once
        on = [np.zeros(len(level[1]), bool) for level in levels]
        at = ends
        starts = first + np.arange(len(parts))
        while len(at):
            level, arc = came_level[at], came_arc[at]
            at = at.copy()
            for number in np.unique(level):
                here = level == number
                on[number][arc[here]] = True
                at[here] = levels[number][2][arc[here]]
            going = at != starts
            at, starts = at[going], starts[going]
        second = np.full(len(parts), -np.inf)
        taken = np.full(len(codes), -2, np.int32)
        for chosen, (length, start, start_node, pieces, scores, _) in zip(on, levels):
            others = ~chosen
            through = best[start_node[others]] + scores[others] + after[start_node[others] + length]
            np.maximum.at(second, owner[start[others]], through)
            taken[start[chosen]] = pieces[chosen]
        score = best[ends_of]
        places = np.flatnonzero(taken > -2)
        ids = taken[places]
        width = np.ones(len(ids), np.int64)
        spelled = {}
        for code in np.unique(codes[places[ids < 0]]).tolist():
            spelled[code] = np.array(vocabulary.bytes_of(chr(code)), np.int32)
            width[(ids < 0) & (codes[places] == code)] = len(spelled[code])
        flat = np.repeat(ids, width)
        begin = np.cumsum(width) - width
        for code, own in spelled.items():
            for k in range(len(own)):
                flat[begin[(ids < 0) & (codes[places] == code)] + k] = own[k]
        return flat, np.bincount(owner[places], width, len(parts)).astype(np.int64), score, score - second


def _spread(first, sizes):
    """Positions first, first + 1, ... of each run, end to end."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


class TrieIndex:
    """The trie as arrays: states are edges, found by (state, character)."""

    def __init__(self, vocabulary):
        keys, pieces, scores = [], [-1], [0.0]
        todo = [(0, vocabulary.trie)]
        for state, edges in todo:
            for letter, below in edges.items():
                if letter is None:
                    continue
                keys.append(state << 21 | ord(letter))
                number, score = below.get(None, (-1, 0.0))
                pieces.append(number)
                scores.append(score)
                todo.append((len(keys), below))
        self.index = Index(np.array(keys, dtype=np.uint64))
        self.piece, self.score = np.array(pieces, np.int32), np.array(scores)

    def next(self, state, codes):
        return self.index.find(state.astype(np.uint64) << np.uint64(21) | codes.astype(np.uint64))


class Encoder:
    """Segmentations of texts, several at a time."""

    def __init__(self, vocabulary):
        self.vocabulary = vocabulary
        self.index = TrieIndex(vocabulary)
        self.known = self.solved = self.choices = None

    def forget(self):
        """Give back the memory of solved segments."""
        self.known = self.solved = self.choices = None

    def encode(self, texts, n=N_BEST):
        """For each text (ids, score, [(score, changes)] of the next ones), in chunks of texts."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= CHUNK_CHARS:
                yield from self._chunk(held, n)
                held, size = [], 0
        if held:
            yield from self._chunk(held, n)

    def _chunk(self, texts, n):
        if self.known is None or len(self.known) > KEPT:
            self.known, self.choices = defaultdict(count().__next__), {}
            self.solved = Solved(self.vocabulary, self.index)
        known, tokens = self.known, []
        for text in texts:
            parts = segments(text) if text else []
            tokens.append(np.array([known[part] for part in parts], np.int32))
        solved = self.solved
        solved.extend(list(islice(known, len(solved.parts), None)))
        for own in tokens:
            sizes = solved.sizes[own]
            ids = solved.ids[_spread(solved.first[own], sizes)]
            score = float(sum(solved.score[own].tolist()))
            yield ids, score, self._others(solved, own, sizes, score, n)

    def _others(self, solved, own, sizes, score, n):
        """The next n - 1 combinations; only the segments that lose least can take part."""
        if n < 2 or not len(own):
            return []
        losses = solved.loss[own]
        most = np.partition(losses, n - 2)[n - 2] if len(losses) >= n else np.inf
        order = np.flatnonzero(losses <= most)
        order = order[np.argsort(losses[order], kind="stable")[: n - 1]]
        combined = [(0.0, ())]
        for i in order[losses[order] < np.inf].tolist():
            number = int(own[i])
            if (number, n) not in self.choices:
                self.choices[number, n] = self._choices(solved, number, n)
            combined = heapq.nsmallest(
                n,
                (
                    (loss + less, changes if new is None else (*changes, (i, new)))
                    for loss, changes in combined
                    for less, new in self.choices[number, n]
                ),
            )
        if len(combined) < 2:
            return []
        offsets = np.cumsum(sizes) - sizes
        return [
            (score - loss, [(int(offsets[i]), int(sizes[i]), new) for i, new in sorted(changes)])
            for loss, changes in combined[1:]
        ]

    def _choices(self, solved, number, n):
        best = tuple(solved.ids[solved.first[number] : solved.first[number] + solved.sizes[number]].tolist())
        found = Lattice(self.vocabulary, solved.parts[number]).n_best(n)
        top = float(solved.score[number])
        return [(0.0, None)] + [(top - score, ids) for score, ids in found if ids != best]


@lru_cache(2)
def _encoder(path):
    return Encoder(Vocabulary.load(path))


@lru_cache(2)
def _spellings(path):
    """Bytes of each id; all that decoding needs."""
    return Vocabulary.load(path).raw


def decoded(raw, ids):
    """The text of an array of ids, without the space in front."""
    return b"".join([raw[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


def applied(ids, changes):
    """The ids of another segmentation: ``changes`` (at, removed, ids) made in ``ids``."""
    out = list(ids)
    for at, removed, new in reversed(changes):
        out[at : at + removed] = new
    return out


_CHANGE = pa.struct([("at", pa.int32()), ("removed", pa.int32()), ("ids", pa.list_(pa.int32()))])
_OTHER = pa.struct([("score", pa.float64()), ("changes", pa.list_(_CHANGE))])


def encode(docs, text="text", n=N_BEST, model=MODEL):
    """``docs`` with ids, score, others (the next n - 1 segmentations as changes of the best) and exact.

    ``exact``: the ids decode to the text, tried where they were made.
    """

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        parts = [part_of(texts.slice(at, _ROWS).to_pylist()) for at in range(0, max(1, len(texts)), _ROWS)]
        _encoder(model).forget()
        return pa.concat_arrays(parts)

    def part_of(texts):
        lists, offsets, scores, others, exact = [], [0], [], [], []
        encoder = _encoder(model)
        for text, (ids, score, more) in zip(texts, encoder.encode((x or "" for x in texts), n)):
            lists.append(ids)
            exact.append(decoded(encoder.vocabulary.raw, ids) == (text or ""))
            offsets.append(offsets[-1] + len(ids))
            scores.append(score)
            others.append(
                [
                    {"score": s, "changes": [{"at": a, "removed": r, "ids": list(i)} for a, r, i in changes]}
                    for s, changes in more
                ]
            )
        flat = np.concatenate([np.zeros(0, np.int32), *lists])
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
        return pa.StructArray.from_arrays(
            [ids, pa.array(scores, pa.float64()), pa.array(others, pa.list_(_OTHER)), pa.array(exact)],
            ["ids", "score", "others", "exact"],
        )

    done = docs.withColumn("_pieces", F.when(F.col(text).isNotNull(), run(F.col(text))))
    return done.withColumns({c: F.col(f"_pieces.{c}") for c in ("ids", "score", "others", "exact")}).drop("_pieces")


def decode(docs, ids="ids", into="decoded", model=MODEL):
    """``docs`` with the text of the segmentation in ``ids``; null for null."""

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        raw = _spellings(model)
        out = []
        for own in lists:
            if not own.is_valid:
                out.append(None)
                continue
            out.append(decoded(raw, own.values.to_numpy(zero_copy_only=False)))
        return pa.array(out, pa.string())

    return docs.withColumn(into, run(F.col(ids)))
