"""Conversation structure repair by cheapest edits, ties by prefix-doubling path ranking.

A node is a number of rows read and what the output ends with. Costs to the end are found
backwards; an arc is optimal if it keeps the cost. An edit's initial leads from a node to one node
only, so the arc with the least initial continues the least audit. Then ranks double: two nodes
are ordered by the rank of their next 2^k initials and, where these are equal, by the rank of the
node 2^k edits ahead, which the doubled pointer names. Once every pointer stands at an end, equal
ranks mean equal audits, and any position of a path is read by the pointers of its binary digits.

Rows are sorted by range, so that a conversation of any length spreads over tasks, and cut into
blocks. Nearly all conversations are one block. For the others each block gives its least cost
between any two outputs, these compose from block to block, and each block then walks its own part.
Their repeated rows are found by grouped minima. Only the audit of a conversation, one cell of the
result, and the digest of its repaired rows, which runs over them in order as a stream, stay whole.

Cases: a null role or text counts as one space; null turns come first; rows of one turn follow
role, then the first 32 characters and the hash of the text; repeated rows are repeated turns; a null conversation id is a conversation; an
empty text is blank; very long texts share small blocks; an empty table gives an empty result; other
columns are not used, whatever their names.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import durable

SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of leaving a truncated row in.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
INITIALS = np.array(["", "D", "I", "K", "R"])
BLOCK_ROWS = 1024
BLOCK_CHARS = 1 << 22
_CHUNK = 1 << 16
_FAR = np.int64(1) << 60
# Outputs end with: 0 nothing, 1 a system row, 2 a user row, 3 an assistant row.
_NEXT = np.array([2, 2, 3, 2])
_ROLE = {2: "user", 3: "assistant"}
# What keeping a row of each initial (none, s, u, a) leads to, from each of these; -1 is not allowed.
_KEEP = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
_CODE = {"s": 1, "u": 2, "a": 3}
_END = np.array([0, _FAR, _FAR, 0])
_LEGAL = {"su", "ua", "au"}


def damaged(rows):
    """Rows as a fixed rule of conversation and turn damages them: dropped, emptied, unstopped, repeated, made user."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fate = F.crc32(name.cast("binary")) % 20
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    return rows.filter(fate != 0).select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


# --- blocks ---------------------------------------------------------------------------------


def _cut(most_rows, most_chars):
    def run(batches):
        part, number, held = TaskContext.get().partitionId(), 0, None

        def emit(table, starts, ends, whole):
            nonlocal number
            offsets = pa.array(np.append(starts, ends[-1]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks()) for c in ("turn", "role", "text")]
            blocks = np.arange(number, number + len(starts)) + (part << 32)
            number += len(starts)
            return pa.RecordBatch.from_arrays(
                [table.column("conv_id").combine_chunks().take(pa.array(starts)), pa.array(blocks), pa.array(whole), *lists],
                ["conv_id", "block", "whole", "turns", "roles", "texts"],
            )

        def cuts(table):
            ids = table.column("conv_id").combine_chunks()
            null, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            other = np.flatnonzero((null[1:] != null[:-1]) | (value[1:] != value[:-1])) + 1
            new = np.zeros(len(ids), bool)
            new[0] = True
            new[other] = True
            first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
            chars = np.cumsum(pc.binary_length(table.column("text").combine_chunks()).to_numpy())
            size = (np.arange(len(ids)) - first) // most_rows + (chars - chars[first]) // most_chars
            start = new.copy()
            start[1:] |= size[1:] != size[:-1]
            return np.flatnonzero(start), new

        began = False  # whether what is held starts its conversation, which may have begun in the task before
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            starts, new = cuts(table)
            if len(starts) > 1:
                # a block is whole if it starts its conversation and the next block starts another
                whole = new[starts[:-1]] & new[starts[1:]]
                whole[0] &= began
                yield emit(table.slice(0, starts[-1]), starts[:-1], starts[1:], whole)
                began = bool(new[starts[-1]])
            held = table.slice(starts[-1])
        if held is not None and held.num_rows:
            yield emit(held, np.array([0]), np.array([held.num_rows]), np.array([False]))

    return run


def blocks_of(rows, most_rows=BLOCK_ROWS, most_chars=BLOCK_CHARS):
    """(conv_id, block, whole, turns, roles, texts): sorted rows of a conversation in blocks.

    ``whole`` marks blocks that certainly hold all of their conversation.
    """
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.substring("text", 1, 32).asc(), F.xxhash64("text").asc()]
    # the last key deals equal rows to several tasks
    dealt = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*keys, "copy").drop("copy")
    ordered = dealt.sortWithinPartitions(*keys)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(
        _cut(most_rows, most_chars),
        f"conv_id {kind}, block long, whole boolean, turns array<long>, roles array<string>, texts array<string>",
    )


# --- costs, ranks and paths of many blocks --------------------------------------------------


class Rows:
    """Rows of many blocks side by side, with their faults."""

    def __init__(self, roles, texts, lengths, first=None):
        """``first`` tells which rows have an equal row before them as False; found inside blocks if not given."""
        self.lengths = np.asarray(lengths, np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.lengths)])
        self.roles, self.texts = roles, texts
        ends = [t.rstrip(SPACE)[-1:] for t in texts]
        self.blank = np.array([not e for e in ends], bool)
        if first is None:
            first = np.ones(len(texts), bool)
            for a, b in zip(self.offset[:-1].tolist(), self.offset[1:].tolist()):
                seen = set()
                for i in range(a, b):
                    said = (roles[i], texts[i])
                    first[i] = said not in seen
                    seen.add(said)
        self.duplicate = ~self.blank & ~first
        self.truncated = ~self.blank & first & np.array([e not in ".!?" for e in ends], bool)
        self.initial = [r[:1] for r in roles]
        self.code = np.array([_CODE.get(x, 0) for x in self.initial], np.int64)

    def counts(self, flags):
        return np.bincount(self.block_of(), flags, len(self.lengths)).astype(np.int64)

    def block_of(self):
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def illegal(self):
        pair = np.array([a + b not in _LEGAL for a, b in zip(self.initial[:-1], self.initial[1:])] + [False], bool)
        last = self.offset[1:][self.lengths > 0] - 1
        flags = pair if len(self.code) else np.zeros(0, bool)
        flags[last] = False
        return self.counts(flags)


def _inserted(cost):
    """``cost`` by output (axis 1), where rows may still be inserted."""
    return np.minimum(cost, np.minimum(INSERT + cost[:, _NEXT], 2 * INSERT + cost[:, _NEXT[_NEXT]]))


def costs_to_end(rows, ends):
    """Least costs of all nodes; ``ends`` has the costs behind each block by output, for one or more endings."""
    n, base = rows.lengths, rows.offset[:-1] + np.arange(len(rows.lengths))
    cost = np.full((int(n.sum()) + len(n), 4, ends.shape[2]), _FAR)
    cost[base + n] = _inserted(ends)
    order = np.argsort(-n, kind="stable")
    waiting = n[order]
    for back in range(1, int(n.max(initial=0)) + 1):
        at = order[: int(np.searchsorted(-waiting, -back, "right"))]
        here, row = (base + n)[at] - back, (rows.offset[:-1] + n)[at] - back
        after = cost[here + 1]
        worse = (TRUNCATED * rows.truncated[row])[:, None, None]
        must = (rows.blank | rows.duplicate)[row][:, None, None]
        target = _KEEP[rows.code[row]]
        kept = np.take_along_axis(after, np.maximum(target, 0)[:, :, None], 1)
        kept = np.where((target < 0)[:, :, None] | must, _FAR, worse + kept)
        changed = np.where(must, _FAR, REROLE + worse + after[:, _NEXT])
        cost[here] = _inserted(np.minimum(DELETE + after, np.minimum(kept, changed)))
    return np.minimum(cost, _FAR)


class Paths:
    """Least optimal audits from the nodes of blocks whose endings have one cost each."""

    def __init__(self, rows, ends):
        self.rows = rows
        self.base = rows.offset[:-1] + np.arange(len(rows.lengths))
        self.cost = costs_to_end(rows, ends[:, :, None])[:, :, 0]
        last = self.base + rows.lengths
        nodes = len(self.cost)
        row = np.full(nodes, -1)
        inner = np.ones(nodes, bool)
        inner[last] = False
        row[inner] = np.arange(len(rows.code))
        # the first edit, in the order of the initials, that keeps the cost
        cost, at = self.cost, np.flatnonzero(inner)
        label, step = np.zeros((nodes, 4), np.int8), np.tile(np.arange(4), (nodes, 1))
        go = np.arange(nodes)[:, None] * 4 + step
        here, after, r = cost[at], cost[at + 1], row[at]
        worse, must = (TRUNCATED * rows.truncated[r])[:, None], (rows.blank | rows.duplicate)[r][:, None]
        target = _KEEP[rows.code[r]]
        ways = [
            (4, ~must & (here == REROLE + worse + after[:, _NEXT]), (at[:, None] + 1) * 4 + _NEXT),
            (3, ~must & (target >= 0) & (here == worse + np.take_along_axis(after, np.maximum(target, 0), 1)), (at[:, None] + 1) * 4 + target),
            (2, here == INSERT + here[:, _NEXT], at[:, None] * 4 + _NEXT),
            (1, here == DELETE + after, (at[:, None] + 1) * 4 + np.arange(4)),
        ]
        for number, fits, to in ways:
            fits &= here < _FAR
            label[at] = np.where(fits, number, label[at])
            go[at] = np.where(fits, to, go[at])
        # behind the last row a path ends where the ending costs what the node costs, or goes on by insertion
        more = (cost[last] != ends) & (cost[last] < _FAR)
        label[last] = np.where(more, 2, 0)
        go[last] = np.where(more, last[:, None] * 4 + _NEXT, go[last])
        self.label, go = label.reshape(-1), go.reshape(-1)
        # ranks of 1, 2, 4, ... initials; a path that has ended stays at its end
        rank, length = self.label.astype(np.int64), (self.label > 0).astype(np.int64)
        self.pointers = []
        while True:
            self.pointers.append(go)
            ahead = go
            if not self.label[ahead].any():
                break
            rank = np.unique(rank * (int(rank.max()) + 1) + rank[ahead], return_inverse=True)[1]
            length = length + length[ahead]
            go = go[ahead]
        self.rank, self.length, self.exit = rank, length, go

    def start(self, block, output):
        return self.base[block] * 4 + output

    def walk(self, starts):
        """(which start, node) of every edit of the paths, in order."""
        count = self.length[starts]
        which = np.repeat(np.arange(len(starts)), count)
        place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        node = starts[which]
        for digit, pointer in enumerate(self.pointers):
            node = np.where((place >> digit) & 1, pointer[node], node)
        return which, node

    def audits(self, starts):
        """Audit of each start, spelled once for each rank."""
        _, first, same = np.unique(self.rank[starts], return_index=True, return_inverse=True)
        which, node = self.walk(starts[first])
        ends = np.searchsorted(which, np.arange(len(first) + 1))
        spelled = INITIALS[self.label[node]]
        texts = ["".join(spelled[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return [texts[i] for i in same.tolist()]

    def repaired(self, starts):
        """(roles, texts, counts) of the rows that the paths leave or insert."""
        which, node = self.walk(starts)
        label = self.label[node]
        stays = label != 1
        which, node, label = which[stays], node[stays], label[stays]
        place = node // 4
        block = np.searchsorted(self.base, place, "right") - 1
        row = place - block  # a block has one node more than rows
        output = _NEXT[node % 4]
        roles, texts = [], []
        for edit, r, o in zip(label.tolist(), row.tolist(), output.tolist()):
            roles.append(self.rows.roles[r] if edit == 3 else _ROLE[o])
            texts.append("" if edit == 2 else self.rows.texts[r])
        return roles, texts, np.bincount(which, minlength=len(starts))


def _chunks(batches, columns):
    """Parts of the batches with about ``_CHUNK`` rows of conversations."""
    for batch in batches:
        size = np.diff(batch.column("roles").offsets.to_numpy()).astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
        start = 0
        part = np.cumsum(size) // _CHUNK
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]:
            if end > start:
                yield batch.slice(start, end - start)
            start = end


def _rows_in(batch, firsts=None):
    roles, texts = batch.column("roles"), batch.column("texts")
    lengths = np.diff(roles.offsets.to_numpy()).astype(np.int64)
    known = None
    if firsts is not None:
        offset = np.concatenate([[0], np.cumsum(lengths)])
        known = np.zeros(int(offset[-1]), bool)
        for at, places in enumerate(firsts):
            known[offset[at] + np.array(places or [], dtype=np.int64)] = True
    return Rows(roles.flatten().to_pylist(), texts.flatten().to_pylist(), lengths, known)


def _turn_facts(batch):
    """(least, greatest, distinct) of the turns of each block; they are sorted, nulls first."""
    facts = []
    for turns in batch.column("turns"):
        values = turns.values.drop_null().to_numpy() if turns.values is not None else np.zeros(0, np.int64)
        facts.append((int(values[0]), int(values[-1]), int((np.diff(values) != 0).sum()) + 1) if len(values) else (None, None, 0))
    return facts


def _strings(values, counts):
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(values, pa.string()))


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_REPAIRED = "roles array<string>, texts array<string>"


def _solve_whole(batches):
    for batch in _chunks(batches, "roles"):
        rows = _rows_in(batch)
        paths = Paths(rows, np.tile(_END, (len(rows.lengths), 1)))
        starts = paths.start(np.arange(len(rows.lengths)), 0)
        roles, texts, counts = paths.repaired(starts)
        gaps = [0 if low is None else high - low + 1 - some for low, high, some in _turn_facts(batch)]
        numbers = [gaps, *(rows.counts(f) for f in (rows.blank, rows.duplicate, rows.truncated)), rows.illegal(), paths.cost.reshape(-1)[starts]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), *(pa.array(x, pa.int64()) for x in numbers), pa.array(paths.audits(starts)), _strings(roles, counts), _strings(texts, counts)],
            ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "roles", "texts"],
        )


# --- conversations of several blocks --------------------------------------------------------


def _summaries(batches):
    """Costs between any two outputs, counts and edges of every block."""
    for batch in _chunks(batches, "roles"):
        rows = _rows_in(batch, batch.column("firsts").to_pylist())
        ends = np.tile(np.where(np.eye(4, dtype=bool), 0, _FAR), (len(rows.lengths), 1, 1))
        base = rows.offset[:-1] + np.arange(len(rows.lengths))
        table = costs_to_end(rows, ends)[base].reshape(len(base), 16)
        facts = _turn_facts(batch)
        edge = [[rows.initial[a], rows.initial[b - 1]] for a, b in zip(rows.offset[:-1], rows.offset[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("block"),
                pa.array(table.tolist(), pa.list_(pa.int64())),
                pa.array([list(f) for f in facts], pa.list_(pa.int64())),
                pa.array(edge, pa.list_(pa.string())),
                pa.array(np.stack([*(rows.counts(f) for f in (rows.blank, rows.duplicate, rows.truncated)), rows.illegal()], 1).tolist(), pa.list_(pa.int64())),
            ],
            ["conv_id", "block", "table", "turns", "edge", "counts"],
        )


def _joined_counts(found):
    """gaps, blank, duplicate, truncated, illegal of a conversation from its blocks."""
    counts = np.sum([r["counts"] for r in found], axis=0).tolist()
    low = high = None
    some = 0
    for r in found:
        if r["turns"][0] is not None:
            some += r["turns"][2] - (high == r["turns"][0])
            low, high = r["turns"][0] if low is None else low, r["turns"][1]
    for a, b in zip(found[:-1], found[1:]):
        counts[3] += a["edge"][1] + b["edge"][0] not in _LEGAL
    return [0 if low is None else high - low + 1 - some, *counts]


def _compose(kind):
    def run(group: pa.Table) -> pa.Table:
        found = sorted(group.to_pylist(), key=lambda r: r["block"])
        ends, end = [], _END
        for r in reversed(found):
            ends.append([int(x) for x in end])
            end = np.minimum((np.array(r["table"]).reshape(4, 4) + np.array(end)[None, :]).min(1), _FAR)
        ends.reverse()
        counts = _joined_counts(found)
        return pa.Table.from_arrays(
            [
                group["conv_id"].combine_chunks().take(pa.array([0] * len(found))),
                pa.array([r["block"] for r in found]),
                pa.array(ends, pa.list_(pa.int64())),
                pa.array([[*counts, int(end[0])]] * len(found), pa.list_(pa.int64())),
            ],
            ["conv_id", "block", "ends", "numbers"],
        )

    return run


def _walks(batches):
    """Where each block's least path leaves it, and its audit, from each output it may be entered with."""
    for batch in _chunks(batches, "roles"):
        rows = _rows_in(batch, batch.column("firsts").to_pylist())
        paths = Paths(rows, np.array(batch.column("ends").to_pylist(), dtype=np.int64))
        exits, audits = [], []
        for output in range(4):
            starts = paths.start(np.arange(len(rows.lengths)), output)
            exits.append(paths.exit[starts] % 4)
            audits.append(paths.audits(starts))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("block"),
                batch.column("numbers"),
                pa.array(np.stack(exits, 1).tolist(), pa.list_(pa.int64())),
                pa.array([list(a) for a in zip(*audits)], pa.list_(pa.string())),
            ],
            ["conv_id", "block", "numbers", "exits", "audits"],
        )


def _enter(group: pa.Table) -> pa.Table:
    found = sorted(group.to_pylist(), key=lambda r: r["block"])
    entry, entries, audit = 0, [], []
    for r in found:
        entries.append(entry)
        audit.append(r["audits"][entry])
        entry = r["exits"][entry]
    numbers = found[0]["numbers"]
    last = [None] * (len(found) - 1)
    return pa.Table.from_arrays(
        [
            group["conv_id"].combine_chunks().take(pa.array([0] * len(found))),
            pa.array([r["block"] for r in found]),
            pa.array(entries, pa.int64()),
            pa.array([numbers, *last], pa.list_(pa.int64())),
            pa.array(["".join(audit), *last], pa.string()),
        ],
        ["conv_id", "block", "entry", "numbers", "audit"],
    )


def _render(batches):
    for batch in _chunks(batches, "roles"):
        rows = _rows_in(batch, batch.column("firsts").to_pylist())
        paths = Paths(rows, np.array(batch.column("ends").to_pylist(), dtype=np.int64))
        starts = paths.start(np.arange(len(rows.lengths)), batch.column("entry").to_numpy())
        roles, texts, counts = paths.repaired(starts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("block"), _strings(roles, counts), _strings(texts, counts)],
            ["conv_id", "block", "roles", "texts"],
        )


def _together(blocks, other):
    """Join on conversation, which may be null, and block."""
    other = other.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    return blocks.join(other, on, "left").drop("_conv", "_block")


def _digest(batches):
    """SHA-256 of each conversation's lines, which come in order."""
    state, conv, told = None, None, False
    for batch in batches:
        ids, done = [], []
        for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not told or c != conv:
                if told:
                    ids.append(conv)
                    done.append(state.hexdigest())
                state, conv, told = hashlib.sha256(line.encode()), c, True
            else:
                state.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(done, pa.string())], ["conv_id", "sha256"])
    if told:
        yield pa.RecordBatch.from_arrays([pa.array([conv], batch.column(0).type), pa.array([state.hexdigest()])], ["conv_id", "sha256"])


def _long(blocks, kind):
    """(conversations, repaired blocks) of conversations that are not one whole block."""
    rows = blocks.select("conv_id", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    said = rows.groupBy("conv_id", F.col("row.roles").alias("role"), F.sha2(F.col("row.texts"), 256).alias("text"))
    firsts = said.agg(F.min(F.struct("block", "at")).alias("first"))
    firsts = firsts.groupBy("conv_id", F.col("first.block").alias("block")).agg(F.collect_list("first.at").alias("firsts"))
    known = durable(_together(blocks, firsts), "long-blocks")
    summaries = known.mapInArrow(
        _summaries, f"conv_id {kind}, block long, table array<long>, turns array<long>, edge array<string>, counts array<long>"
    )
    ends = summaries.groupBy("conv_id").applyInArrow(_compose(kind), f"conv_id {kind}, block long, ends array<long>, numbers array<long>")
    known = durable(_together(known, ends), "long-blocks-with-ends")
    walks = known.mapInArrow(_walks, f"conv_id {kind}, block long, numbers array<long>, exits array<long>, audits array<string>")
    entered = durable(
        walks.groupBy("conv_id").applyInArrow(_enter, f"conv_id {kind}, block long, entry long, numbers array<long>, audit string"),
        "long-conversations",
    )
    repaired = _together(known, entered.select("conv_id", "block", "entry")).mapInArrow(
        _render, f"conv_id {kind}, block long, {_REPAIRED}"
    )
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    told = entered.filter(F.col("numbers").isNotNull())
    return told.select("conv_id", *(F.col("numbers")[i].alias(n) for i, n in enumerate(names)), "audit"), repaired


def repair(rows, most_rows=BLOCK_ROWS, most_chars=BLOCK_CHARS):
    """Repaired conversations: two tables.

    The first has a row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256. The second has the repaired turns in blocks: conv_id, block, roles, texts.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    blocks = durable(blocks_of(rows, most_rows, most_chars), "conversation-blocks")
    whole = blocks.filter("whole").mapInArrow(_solve_whole, f"conv_id {kind}, {_COUNTS}, {_REPAIRED}")
    told, parts = _long(blocks.filter("not whole").drop("whole"), kind)
    line = lambda r, t: F.concat(r, F.lit(":"), t)
    digest = F.sha2(F.array_join(F.zip_with("roles", "texts", line), "\n"), 256)
    short = whole.withColumn("repaired_sha256", digest).drop("roles", "texts")

    lines = parts.select("conv_id", "block", F.posexplode(F.zip_with("roles", "texts", line)).alias("at", "line"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "block", "at").select("conv_id", "line")
    digests = ordered.mapInArrow(_digest, f"conv_id {kind}, sha256 string").withColumnRenamed("conv_id", "_conv")
    joined = told.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    long = joined.withColumn("sha256", F.coalesce("sha256", F.sha2(F.lit(""), 256))).withColumnRenamed("sha256", "repaired_sha256")
    turns = whole.select("conv_id", F.lit(0).cast("long").alias("block"), "roles", "texts").unionByName(parts)
    return short.unionByName(long), turns
