"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters within K edits of a place in a text shares at least
m - q + 1 - K*q of its character q-grams with that place, on diagonals (text position less
passage position) at most K apart. Shared q-grams are counted in bands of 2(K + 1) diagonals
that overlap by half; a band with enough of them is a candidate, and bands side by side are one.
Only the part of the text that a band reaches is aligned, column by column with a bit for each
letter of the passage; short passages are aligned many at a time. Passages that several items
share are indexed and verified once, and a hit is handed to all of them. Texts are read whole, very
long ones in parts that overlap. Letters A-Z count as lower case and each white-space character
as a space, so positions are those of the original text.

The benchmark is the query set: it is indexed in blocks of at most ``BLOCK_CHARS`` characters
and every text is held against each block. An item is looked for by windows of ``WINDOW``
characters, an item up to that size as a whole, and by overlapping passages of ``LEAST`` to
``PASSAGE`` characters, half an item where that lies between, each with an edit budget of its
own. So a part of an item is found too: any copied stretch of 95 characters, and of a shorter
item any of (3 P + n) / 4 for n characters and passages of P. Passages of an item that are found
side by side are one hit; its edits are those of the joined stretch, each part being within its
own budget.

Cases: null and empty texts have no hits; items that are null, blank or have no letters or
digits are left out; an item shorter than q is matched as it is; equal items each give their
hit; an empty benchmark gives no hits; repeated rows give repeated hits; ruled lines and other
repetitive texts are searched in linear time; other columns are not used by ``contaminated`` and stay
in ``decontaminated``, where only a column named ``_hits`` is lost.
"""

from bisect import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import durable

Q = 10
#: Edits allowed, as a share of a passage's characters.
EDITS = 0.06
WINDOW = 512
#: Characters of the passages that find parts of an item: at least, if the item has them, and at most.
LEAST, PASSAGE = 40, 64
#: Characters of benchmark text that are indexed, and sent to the executors, at once.
BLOCK_CHARS = 4_000_000
#: Characters looked up at once, and texts whose hits are Python objects at once.
_CHUNK, _ROWS = 1 << 18, 500
#: Characters that parts of a text share, and postings handled at once.
_OVERLAP, _POSTINGS = 2 * WINDOW, 1 << 20
#: Lanes that are aligned together, letters of a lane, and a letter that no text has.
_LANES, _LANE, _NO_LETTER = 1 << 13, 512, 0xFFFFFFFF
#: Meetings of equal q-grams, for each q-gram of a text that a passage has, beyond which bands are merged.
_DENSE = 8
_BITMAP = 22
_BASE = 0x9E3779B97F4A7C15
_PLAIN = {**{c: c + 32 for c in range(65, 91)}, **{c: 32 for c in range(9, 14)}}
HITS = "array<struct<item_id:long,start:int,end:int,edits:int>>"


def plain(codes):
    """Code points with A-Z in lower case and white space as a space, position by position."""
    codes = codes.copy()
    codes[(codes >= 65) & (codes <= 90)] += 32
    codes[(codes >= 9) & (codes <= 13)] = 32
    return codes


def codes_of(text):
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes, q):
    """A hash of each q code points; none if there are fewer."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    out = codes[: len(codes) - q + 1].astype(np.uint64)
    wide, base = codes.astype(np.uint64), np.uint64(_BASE)
    with np.errstate(over="ignore"):
        for at in range(1, q):
            out = out * base + wide[at : at + len(out)]
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def aligned(pattern, text, low, high, edits):
    """(edits, start, end) of the place in ``text`` nearest to ``pattern``, or None beyond ``edits``.

    Only cells on diagonals ``low`` to ``high`` (text position less pattern position) are filled.
    """
    far = len(pattern) + 1
    band = np.arange(low, high + 1)
    inside = (band >= 0) & (band <= len(text))
    row, origin = np.where(inside, 0, far), band.copy()
    padded = np.concatenate([np.zeros(max(0, -low) + 1, text.dtype), text, np.zeros(max(0, high + far - len(text)) + 1, text.dtype)])
    shift = max(0, -low) + 1
    steps = np.arange(len(band))
    for at, code in enumerate(pattern, 1):
        column = band + at
        letters = padded[low + at - 1 + shift : high + at + shift]
        best = row + (letters != code)
        down = np.append(row[1:] + 1, far)
        came = np.where(best <= down, origin, np.append(origin[1:], 0))
        best = np.minimum(best, down)
        best[(column < 0) | (column > len(text))] = far
        # an insertion continues the cheapest cell to the left
        level = best - steps
        lowest = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == lowest, steps, 0))
        row, origin = np.minimum(lowest + steps, far), came[source]
        row[(column < 0) | (column > len(text))] = far
        if row.min() > edits:
            return None
    cell = int(row.argmin())
    return int(row[cell]), int(origin[cell]), int(band[cell]) + len(pattern)


def _merged(bands, step, sizes):
    """(text, passage, first, last diagonal) of bands side by side; the largest passages come first."""
    order = np.lexsort((bands[:, 2], bands[:, 1], bands[:, 0], -sizes))
    bands, step = bands[order], step[order]
    if not len(bands):
        return
    new = np.ones(len(bands), bool)
    new[1:] = (bands[1:, :2] != bands[:-1, :2]).any(1) | (bands[1:, 2] - bands[:-1, 2] > step[1:])
    starts = np.flatnonzero(new)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bands)]):
        yield int(bands[a, 0]), int(bands[a, 1]), int(bands[a, 2]), int(bands[b - 1, 2])


def _runs(first, count):
    """first, first + 1, ... of each run, end to end."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def cuts(size, window=WINDOW):
    """(start, end) of an item's windows, then of its passages."""
    part = min(PASSAGE, max(LEAST, size // 2))
    out = {}
    for length, step in ((window, window), (part, max(1, min(part // 2, (size - part) // 4)))):
        last = max(0, size - length)
        for start in sorted({*range(0, last + 1, step), last}):
            out[start, min(size, start + length)] = None
    return list(out)


def _masks(pattern):
    masks = {}
    for at, code in enumerate(pattern):
        masks[code] = masks.get(code, 0) | 1 << at
    return masks


def _edits_behind(size, masks, codes, anchored):
    """Edits of a pattern of ``size`` against what ends behind each letter, from any start or, ``anchored``, from the first.

    A column of the alignment is held as two numbers, with a bit for each letter of the pattern
    that tells where costs rise and where they fall.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, out, mask = full, 0, size, [], masks.get
    for code in codes:
        equal = mask(code, 0)
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(across | plus)), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | anchored) & full
        equal |= minus
        plus, minus = (down << 1 & full) | (full & ~(equal | up)), up & equal
        out.append(score)
    return out


def near_ends(passages, sizes, edits, codes, starts, stops):
    """(lane, end, edits) of the ends in codes[start:stop] of a lane that its passage is near to.

    ``passages`` has a row of letters for each lane, at most 64. The columns of all lanes are filled
    together, a letter of the text in each at a time.
    """
    one, found = np.uint64(1), []
    full = np.where(sizes == 64, ~np.uint64(0), (one << np.minimum(sizes, 63).astype(np.uint64)) - one)
    top = one << (sizes - 1).astype(np.uint64)
    plus, minus, score = full.copy(), np.zeros(len(full), np.uint64), sizes.copy()
    with np.errstate(over="ignore"):
        for step in range(int((stops - starts).max(initial=0))):
            at = starts + step
            on = at < stops
            letter = np.where(on, codes[np.minimum(at, len(codes) - 1)], _NO_LETTER)
            equal = np.packbits(passages == letter[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
            across = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | (full & ~(across | plus)), plus & across
            score = score + ((up & top) > 0) - ((down & top) > 0)
            up = (up << one) & full
            equal = equal | minus
            plus, minus = ((down << one) & full) | (full & ~(equal | up)), up & equal
            near = np.flatnonzero((score <= edits) & on)
            if len(near):
                found.append(np.stack([near, at[near] + 1, score[near]]))
    return np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)


def places_at(pattern, codes, ends, costs):
    """(edits, start, end) of places with such ends apart from each other, nearest first, then from the left."""
    size, letters, back, out = len(pattern), pattern.tolist(), None, []
    order = np.lexsort((ends, costs))
    base = int(ends.min()) - 2 * size - 1
    busy = bytearray(int(ends.max()) - base + 1)
    for end, cost in zip(ends[order].tolist(), costs[order].tolist()):
        # a place is no shorter than this
        if busy.find(1, end - size + cost - base, end - base) >= 0:
            continue
        length = size
        if cost:
            back = back or _masks(letters[::-1])
            near = _edits_behind(size, back, codes[max(0, end - size - cost) : end][::-1].tolist(), 1)
            length = near.index(cost) + 1 if cost in near else 0
        start = end - length
        if length and busy.find(1, start - base, end - base) < 0:
            busy[start - base : end - base] = b"\1" * length
            out.append((cost, start, end))
    return out


@dataclass
class PassageIndex:
    """Postings of the q-grams of the distinct windows and passages of one block."""

    items: np.ndarray  # item ids
    texts: list  # code points of the items
    passages: list  # distinct code points
    held_by: np.ndarray  # (passage, item, offset), sorted
    only: np.ndarray  # the item of a passage that no other item holds, else -1
    sizes: np.ndarray
    budget: np.ndarray  # edits
    needed: np.ndarray  # q-grams
    grams: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each gram in the postings
    owner: np.ndarray  # passage of each posting
    start: np.ndarray  # of each passage in its own q-grams, by place
    own: np.ndarray  # number of each q-gram of a passage
    new: np.ndarray  # whether it stands there for the first time
    bitmap: np.ndarray
    q: int

    @classmethod
    def build(cls, rows, q=Q, share=EDITS, window=WINDOW):
        items = [item for item, _ in rows]
        texts = [plain(codes_of(text.strip())) for _, text in rows]
        known, passages, held_by = {}, [], []
        for n, codes in enumerate(texts):
            for a, b in cuts(len(codes), window):
                number = known.setdefault(codes[a:b].tobytes(), len(passages))
                if number == len(passages):
                    passages.append(codes[a:b])
                held_by.append((number, n, a))
        sizes = np.array([len(p) for p in passages], dtype=np.int64)
        # at least one q-gram must be needed, else nothing could be filtered
        budget = np.minimum((sizes * share).astype(np.int64), np.maximum(0, (sizes - q) // q))
        needed = np.maximum(1, sizes - q + 1 - budget * q)
        hashes = [gram_hashes(p, q) for p in passages]
        owner = np.repeat(np.arange(len(passages), dtype=np.int32), [len(h) for h in hashes])
        flat = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        grams, first, own = np.unique(flat, return_index=True, return_inverse=True)
        first = np.searchsorted(flat[order], grams)
        new = np.zeros(len(flat), bool)
        new[np.unique(owner * np.int64(len(grams) + 1) + own, return_index=True)[1]] = True
        bitmap = np.zeros(1 << _BITMAP, bool)
        bitmap[(grams >> np.uint64(64 - _BITMAP)).astype(np.int64)] = True
        held_by = np.array(sorted(held_by), dtype=np.int64).reshape(-1, 3)
        only = np.full(len(passages), -1)
        only[held_by[:, 0]] = held_by[:, 1]
        only[held_by[1:, 0][(held_by[1:, 0] == held_by[:-1, 0]) & (held_by[1:, 1] != held_by[:-1, 1])]] = -1
        return cls(
            np.array(items), texts, passages, held_by, only, sizes, budget, needed,
            grams, np.append(first, len(flat)), owner[order], np.searchsorted(owner, np.arange(len(passages) + 1)),
            own.astype(np.int64), new, bitmap, q,
        )

    def _shared(self, codes, document):
        """(text number, q-gram, position) of the q-grams of the text that some passage has."""
        hashes = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - _BITMAP)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return np.zeros((3, 0), np.int64)
        gram = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        true = self.grams[gram] == hashes[at]
        at, gram = at[true], gram[true]
        order = np.lexsort((gram, document[at]))
        return np.stack([document[at], gram, at])[:, order]

    def _pairs(self, text, gram):
        """(text, passage) that share enough q-grams, on all diagonals together; each place counts once."""
        count = self.first[gram + 1] - self.first[gram]
        so_far = np.cumsum(count)
        out, low, many = [], 0, len(self.passages)
        while low < len(gram):
            base = so_far[low] - count[low]
            high = max(low + 1, int(np.searchsorted(so_far, base + _POSTINGS, "right")))
            # a part ends with a text, unless the text alone is larger
            if high < len(gram) and text[high] == text[high - 1]:
                before = int(np.searchsorted(text, text[high], "left"))
                high = before if before > low else int(np.searchsorted(text, text[high], "right"))
            if text[high - 1] == text[low]:
                total = np.zeros(many, np.int64)
                for a in range(low, high, 4096):
                    b = min(high, a + 4096)
                    total += np.bincount(self.owner[_runs(self.first[gram[a:b]], count[a:b])], minlength=many)
                enough = np.flatnonzero(total >= self.needed)
                out.append(np.stack([np.full(len(enough), text[low]), enough]))
            else:
                owner = self.owner[_runs(self.first[gram[low:high]], count[low:high])].astype(np.int64)
                pair, total = np.unique(np.repeat(text[low:high], count[low:high]) * many + owner, return_counts=True)
                pair = pair[total >= self.needed[pair % many]]
                out.append(np.stack([pair // many, pair % many]))
            low = high
        return np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)

    def _candidates(self, codes, document):
        """Bands (text, passage, lowest diagonal) with enough shared q-grams, and (text, passage, positions) of
        pairs whose q-grams repeat so often that their bands would cover the text many times over."""
        text, gram, at = self._shared(codes, document)
        key = text * (len(self.grams) + 1) + gram
        keys, first, count = np.unique(key, return_index=True, return_counts=True)
        pair_text, pair = self._pairs(text[first], gram[first])
        if not len(pair):
            return np.zeros((0, 3), np.int64), []
        own = self.start[pair + 1] - self.start[pair]
        entry = _runs(self.start[pair], own)
        number = np.repeat(np.arange(len(pair)), own)
        place = entry - np.repeat(self.start[pair], own)
        wanted = pair_text[number] * (len(self.grams) + 1) + self.own[entry]
        found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        times = np.where(keys[found] == wanted, count[found], 0)
        meetings = np.bincount(number, times, len(pair))
        touched = np.bincount(number, times * self.new[entry], len(pair))
        dense = meetings > _DENSE * (touched + self.sizes[pair])
        wide = []
        for n in np.flatnonzero(dense).tolist():
            own_entries = np.flatnonzero((number == n) & (times > 0) & self.new[entry])
            positions = np.sort(at[_runs(first[found[own_entries]], times[own_entries])])
            wide.append((int(pair_text[n]), int(pair[n]), positions))
        keep = np.flatnonzero(~dense[number] & (times > 0))
        number, place, times, run = number[keep], place[keep], times[keep], first[found[keep]]
        position = at[_runs(run, times)]
        number, place = np.repeat(number, times), np.repeat(place, times)
        low = (position - place) // (self.budget[pair[number]] + 1)
        # each diagonal lies in the band that starts at its step and in the one before
        span = 2 * (len(codes) + WINDOW) + 3
        band = np.concatenate([low, low - 1]) + WINDOW + 2
        bands, n = np.unique(np.tile(number, 2) * span + band, return_counts=True)
        number, low = bands // span, bands % span - WINDOW - 2
        enough = n >= self.needed[pair[number]]
        number, low = number[enough], low[enough]
        return np.stack([pair_text[number], pair[number], low * (self.budget[pair[number]] + 1)], 1), wide

    def hits(self, texts):
        """For each text its (item, start, end, edits), one for each place."""
        found = [[] for _ in texts]
        tiny = [(n, "".join(map(chr, codes))) for n, codes in enumerate(self.texts) if len(codes) < self.q]
        held, size, places = [], 0, {}
        whole = {}
        for number, text in enumerate(texts):
            if not text:
                continue
            if tiny:
                self._exact(found[number], tiny, text.translate(_PLAIN))
            whole[number] = codes = plain(codes_of(text))
            # parts of a very long text overlap by more than a window with its edits
            for start in range(0, max(1, len(codes) - _OVERLAP), _CHUNK):
                held.append((number, start, codes[start : start + _CHUNK + _OVERLAP]))
                size += len(held[-1][2])
                if size >= _CHUNK:
                    self._chunk(held, places)
                    held, size = [], 0
        if held:
            self._chunk(held, places)
        for number, of_text in places.items():
            self._told(found[number], whole[number], of_text)
        return found

    def _exact(self, out, tiny, text):
        for item, part in tiny:
            at = text.find(part)
            while at >= 0:
                out.append((int(self.items[item]), at, at + len(part), 0))
                at = text.find(part, at + len(part))

    def _chunk(self, held, places):
        """Add to ``places``, by text and passage, the (edits, start, end) found in parts of texts."""
        gap = np.zeros(self.q, np.uint32)
        sizes = np.array([len(codes) for _, _, codes in held])
        begin = np.cumsum(sizes + self.q) - sizes - self.q
        codes = np.concatenate([x for _, _, part in held for x in (part, gap)])
        bands, wide = self._candidates(codes, np.repeat(np.arange(len(held)), sizes + self.q))

        def add(part, passage, cost, start, end):
            number, offset, _ = held[part]
            at = offset - int(begin[part])
            places.setdefault(number, {}).setdefault(passage, set()).add((int(cost), int(start) + at, int(end) + at))

        regions = []
        for part, passage, first, last in _merged(bands, self.budget[bands[:, 1]] + 1, self.sizes[bands[:, 1]]):
            budget = int(self.budget[passage])
            low = max(int(begin[part]), first - budget)
            regions.append((part, passage, low, min(int(begin[part] + sizes[part]), last + 3 * budget + 1 + int(self.sizes[passage]))))
        for part, passage, positions in wide:
            reach = int(self.sizes[passage] + self.budget[passage]) + 1
            for run in np.split(positions, np.flatnonzero(np.diff(positions) > 2 * reach) + 1):
                low = max(int(begin[part]), int(run[0]) - reach)
                regions.append((part, passage, low, min(int(begin[part] + sizes[part]), int(run[-1]) + self.q + reach)))

        whole, small = {}, []  # places of windows by (part, item): passages of the item would find them again
        for part, passage, low, high in regions:
            if self.sizes[passage] <= PASSAGE:
                small.append((part, passage, low, high))
                continue
            pattern = self.passages[passage]
            costs = np.array(_edits_behind(len(pattern), _masks(pattern.tolist()), codes[low:high].tolist(), 0), dtype=np.int64)
            near = np.flatnonzero(costs <= self.budget[passage])
            if len(near):
                for cost, start, end in places_at(pattern, codes, near + low + 1, costs[near]):
                    add(part, passage, cost, start, end)
                    whole.setdefault((part, int(self.only[passage])), []).append((start, end))
        small = [r for r in small if not any(a <= r[2] and r[3] <= b for a, b in whole.get((r[0], int(self.only[r[1]])), ()))]
        for low in range(0, len(small), _LANES):
            self._small(codes, np.array(small[low : low + _LANES], dtype=np.int64), add)

    def _small(self, codes, regions, add):
        """Verify passages of at most 64 letters; long regions are cut into lanes that overlap by a passage."""
        passage = regions[:, 1]
        reach = self.sizes[passage] + self.budget[passage] + 1
        count = np.maximum(1, -(-(regions[:, 3] - regions[:, 2] - reach) // _LANE))
        region = np.repeat(np.arange(len(regions)), count)
        starts = regions[region, 2] + _runs(np.zeros(len(regions), np.int64), count) * _LANE
        stops = np.minimum(starts + _LANE + reach[region], regions[region, 3])
        known, row = np.unique(passage, return_inverse=True)
        letters = np.full((len(known), 64), _NO_LETTER - 1, np.uint32)
        for at, number in enumerate(known.tolist()):
            letters[at, : self.sizes[number]] = self.passages[number]
        found = []
        for low in range(0, len(region), _LANES):
            lanes = slice(low, low + _LANES)
            own = passage[region[lanes]]
            lane, end, cost = near_ends(letters[row[region[lanes]]], self.sizes[own], self.budget[own], codes, starts[lanes], stops[lanes])
            found.append(np.stack([region[low + lane], end, cost]))
        at, end, cost = np.concatenate(found, 1)
        order = np.argsort(at, kind="stable")
        at, end, cost = at[order], end[order], cost[order]
        for number in np.unique(at).tolist():
            a, b = np.searchsorted(at, [number, number + 1])
            part, passage_, _, _ = regions[number].tolist()
            for place in places_at(self.passages[passage_], codes, end[a:b], cost[a:b]):
                add(part, passage_, *place)

    def _told(self, out, codes, of_text):
        """Hits of one text: items that hold the same passages at the same offsets are worked out once."""
        apart = {}
        for passage, found in of_text.items():
            taken, starts = [], []
            for cost, start, end in sorted(found):
                # places taken lie apart, so only the neighbours can overlap
                at = bisect(starts, start)
                if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
                    starts.insert(at, start)
                    taken.insert(at, (start, end, cost))
            apart[passage] = taken
        holders = {}
        for passage in sorted(apart):
            low, high = np.searchsorted(self.held_by[:, 0], [passage, passage + 1])
            for _, item, offset in self.held_by[low:high].tolist():
                holders.setdefault(item, []).append((passage, offset))
        alike = {}
        for item, held in holders.items():
            alike.setdefault(tuple(held), []).append(item)
        for held, items in alike.items():
            places = [
                (start, end, cost, offset, offset + int(self.sizes[passage]))
                for passage, offset in held
                for start, end, cost in apart[passage]
            ]
            told = self._joined(items[0], codes, places)
            for item in items:
                number = int(self.items[item])
                out += [(number, start, end, edits) for start, end, edits in told]

    def _joined(self, item, codes, held):
        """(start, end, edits) of the stretches that the places of one item in one text make up."""
        groups, open_ = [], []
        for place in sorted(held, key=lambda p: (p[0], -p[1])):
            start, end, _, low, high = place
            open_ = [g for g in open_ if g["end"] >= start]
            for group in open_:
                last = group["places"][-1]
                slack = 2 + 2 * int(EDITS * max(high - low, last[4] - last[3]))
                if low <= group["high"] and high >= group["low"] and abs(start - low - last[0] + last[3]) <= slack:
                    break
            else:
                group = {"places": [], "end": end, "low": low, "high": high}
                groups.append(group)
                open_.append(group)
            group["places"].append(place)
            group["end"] = max(group["end"], end)
            group["low"], group["high"] = min(group["low"], low), max(group["high"], high)
        out = []
        for group in groups:
            low, high, places = group["low"], group["high"], group["places"]
            match = next(((p[2], p[0], p[1]) for p in places if p[3:] == (low, high)), None)
            if not match:
                # the ways of all places lie in this band
                diagonals, most = [x + low for p in places for x in (p[0] - p[3], p[1] - p[4])], max(p[2] for p in places)
                far = 2 * (high - low)
                match = aligned(self.texts[item][low:high], codes, min(diagonals) - most, max(diagonals) + most, far)
            out.append((match[1], match[2], match[0], high - low))
        out.sort(key=lambda m: (-m[3], m[2], m[0]))
        kept, near = [], {}  # what is kept, by the parts of the text it touches
        for start, end, edits, _ in out:
            if not any(a <= start and end <= b for a, b in near.get(start // WINDOW, ())):
                kept.append((start, end, edits))
                for part in range(start // WINDOW, end // WINDOW + 1):
                    near.setdefault(part, []).append((start, end))
        return kept


def _hits_of(index, spark):
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf(HITS)
    def hits(texts: pa.Array) -> pa.Array:
        rows = [
            [{"item_id": i, "start": a, "end": b, "edits": e} for i, a, b, e in sorted(set(found))]
            for at in range(0, len(texts), _ROWS)
            for found in shared.value.hits(texts.slice(at, _ROWS).to_pylist())
        ]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
        return pa.array(rows, type=kind)

    return hits


def benchmark_blocks(benchmark, item="item_id", text="text", block_chars=BLOCK_CHARS):
    """Lists of (item, text) whose characters stay near ``block_chars``; one is held at a time."""
    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).filter(
        F.col("item").isNotNull() & F.col("text").rlike("[\\p{L}\\p{N}]")
    )
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for number in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number)
        yield sorted((r["item"], r["text"]) for r in part.toLocalIterator())


def contaminated(docs, benchmark, key="doc_id", text="text", q=Q, share=EDITS, block_chars=BLOCK_CHARS):
    """(key, item_id, start, end, edits): every place of a text near a benchmark passage."""
    spark, out = docs.sparkSession, None
    for rows in benchmark_blocks(benchmark, block_chars=block_chars):
        if not rows:
            continue
        hits = _hits_of(PassageIndex.build(rows, q, share), spark)
        found = docs.select(F.col(key).alias("_key"), hits(F.col(text)).alias("_hits")).select(
            F.col("_key").alias(key), F.inline("_hits")
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.select(F.col(key)).limit(0).select(key, F.inline(F.array().cast(HITS)))
    return out


def decontaminated(docs, benchmark, text="text", q=Q, share=EDITS, block_chars=BLOCK_CHARS):
    """The rows of ``docs`` without a benchmark passage; nothing is shuffled.

    What one block leaves is written before the next block looks at it, so that a worker never
    holds the indexes of two blocks.
    """
    searched = False
    for rows in benchmark_blocks(benchmark, block_chars=block_chars):
        if rows:
            docs = durable(docs, "decontaminated") if searched else docs
            hits = _hits_of(PassageIndex.build(rows, q, share), docs.sparkSession)
            docs = docs.withColumn("_hits", hits(F.col(text))).filter(F.size("_hits") == 0).drop("_hits")
            searched = True
    return docs
