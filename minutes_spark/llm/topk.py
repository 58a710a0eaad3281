"""Exact top-k by inner product with a pivot table.

Every vector is rounded to integers and gets its distances to ``pivots`` reference vectors once.
For a query q, a candidate x and any pivot p, |d(q, p) - d(x, p)| is at most d(q, x), and the
inner product is (|q|^2 + |x|^2 - d(q, x)^2) / 2; the largest difference over all pivots thus
bounds the score from above. Candidates are evaluated in the order of their bounds until no
bound reaches the k-th best score.

Queries and candidates meet in cells of at most ``cell_queries`` by ``cell_rows`` vectors; each
side is shuffled to the cells of its lane once, and a cell returns at most k rows a query.

Cases: vectors that are null or hold null or non-finite components take no part, neither as
query nor as candidate; a shorter vector counts as padded with zeros, an empty one scores 0;
rows with a query's id are its own and no candidates of it; a query row that stands several
times is one query, rows with one id and different vectors are several; candidates that stand
several times are listed as often; a null id is no query and comes last among equal scores;
very long vectors cost memory of a cell in proportion; without rows there is no result; other
columns are not used, whatever their names. Scores beyond 2^63 are not defined.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIVOTS = 32
#: Rows, those of the smallest hash, among which pivots are chosen: enough to spread them, a few MB on the driver.
PIVOT_SAMPLE = 2048
CELL_QUERIES = 8192
CELL_ROWS = 65536
#: Cells a task slot at least, as long as a cell keeps ``_LEAST_ROWS``.
_CELLS_A_SLOT = 4
_LEAST_ROWS = 1024
#: Candidates that a query evaluates first.
_FIRST = 256


def usable(vector):
    """Column: the vector is not null and all its components are finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def _matrix(vectors, width, scale):
    """Rows of an Arrow list array as integers, padded with zeros to ``width``."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    if len(vectors):
        offsets = vectors.offsets.to_numpy()
        lengths = np.diff(offsets)
        values = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
        out[np.arange(width) < lengths[:, None]] = np.floor(values * scale)
    return out


def _spread(vectors, count):
    """``count`` vectors far from each other, each the farthest from those before it; zero comes first."""
    chosen = [np.zeros(vectors.shape[1])]
    near = np.full(len(vectors), np.inf)
    while len(chosen) <= min(count, len(vectors)):
        near = np.minimum(near, ((vectors - chosen[-1]) ** 2).sum(1))
        if near.max() == 0:
            break
        chosen.append(vectors[int(near.argmax())])
    return np.array(chosen[: count + 1])


def pivot_table(rows, vector, width, kind, pivots, scale):
    """``rows`` (id, vector) as (id, x: integers as bytes, table: distances to all pivots as bytes)."""

    def measure(batches):
        for batch in batches:
            x = _matrix(batch.column(1), width, scale)
            wide = x.astype(np.float64)
            square = (wide**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (wide @ pivots.T)
            far = np.sqrt(np.maximum(square, 0)).astype(np.float32)
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x.astype(kind), far)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed], ["id", "x", "table"])

    id_type = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(measure, f"id {id_type}, x binary, table binary")


def _unpacked(column, kind, width):
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=kind).reshape(len(column), width)


def search_cell(query, table, rows, row_table, own, k):
    """(position, score) of the k best rows by score, then position.

    ``own`` is the range of positions that are no candidates. ``row_table`` has a line a pivot.
    """
    gap = np.abs(row_table - table[:, None]).max(0).astype(np.float64)
    squares, q2 = rows[1], float((query.astype(np.float64) ** 2).sum())
    # distances are stored as single floats; the margin covers their rounding
    gap = np.maximum(gap - 1e-6 * (table.max() + gap + 1), 0)
    bound = (q2 + squares - gap**2) / 2
    bound += 1e-6 * (1 + np.abs(bound)) + 1e-9 * (q2 + squares)
    bound[own[0] : own[1]] = -np.inf
    left = len(bound) - (own[1] - own[0])
    best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if left <= 0:
        return best_at, best
    first = min(_FIRST, len(bound))
    waiting = np.argpartition(-bound, first - 1)
    ordered, waiting, sorted_rest, at, size = waiting[:first], waiting[first:], False, 0, first
    ordered = ordered[bound[ordered] > -np.inf]
    while len(ordered):
        score = rows[0][ordered] @ query
        score = score if score.dtype == np.int64 else np.rint(score).astype(np.int64)
        least = best[-1] if len(best) == k else None
        if least is not None:
            ordered, score = ordered[score >= least], score[score >= least]
        best_at, best = np.concatenate([best_at, ordered]), np.concatenate([best, score])
        order = np.lexsort((best_at, -best))[:k]
        best_at, best = best_at[order], best[order]
        reach = best[-1] if len(best) == k else -np.inf
        if not sorted_rest:
            waiting = waiting[bound[waiting] >= max(reach, -np.finfo(float).max)]
            waiting = waiting[np.argsort(-bound[waiting], kind="stable")]
            falling, sorted_rest = -bound[waiting], True
        stop = int(np.searchsorted(falling, -reach, "right"))
        size *= 2
        ordered = waiting[at : min(at + size, stop)]
        at += len(ordered)
    return best_at, best


def _cell(width, kind, number, k, names):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows["id"], null_placement="at_end")
        rows = rows.take(order)
        known = rows["id"].drop_null().to_numpy()
        x = _unpacked(rows["x"], kind, width).astype(number)
        squares = (x.astype(np.float64) ** 2).sum(1)
        row_table = np.ascontiguousarray(_unpacked(rows["table"], np.float32, -1).T) if len(rows) else np.zeros((0, 0))
        asked, found, score = [], [], []
        if len(rows) and len(queries):
            q = _unpacked(queries["x"], kind, width).astype(number)
            q_table = _unpacked(queries["table"], np.float32, -1)
            ids = queries["id"].to_numpy()
            lows, highs = np.searchsorted(known, ids, "left"), np.searchsorted(known, ids, "right")
            for i in range(len(queries)):
                at, best = search_cell(q[i], q_table[i], (x, squares), row_table, (int(lows[i]), int(highs[i])), k)
                asked.append(np.full(len(at), i))
                found.append(at)
                score.append(best)
        asked, found = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (asked, found))
        score = np.concatenate(score) if score else np.zeros(0, np.int64)
        return pa.Table.from_arrays(
            [queries["id"].take(asked), queries["mark"].take(asked), rows["id"].take(found), pa.array(score, pa.int64())], names
        )

    return run


def top_k(queries, rows, key="vec_id", vector="embedding", k=20, scale=64, pivots=PIVOTS, cell_queries=CELL_QUERIES, cell_rows=CELL_ROWS):
    """(query_id, rank, ``key``, score): the ``k`` best rows of each query, ties to the smaller id.

    Components count as floor(``scale`` * component).
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(usable(F.col("v")))
    asked = queries.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    largest = F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))
    seen = rows.agg(F.count("*"), F.max(F.size("v")), largest).first()
    n_asked, asked_width, asked_largest = asked.agg(F.count("*"), F.max(F.size("v")), largest).first()
    width = max(seen[1] or 0, asked_width or 0, 1)
    reach = max(seen[2] or 0.0, asked_largest or 0.0) * scale + 1
    kind = next((t for t in (np.int16, np.int32) if reach < np.iinfo(t).max), np.int64)
    # sums of products that a float holds exactly are taken by the faster float product
    number = next((t for t, most in ((np.float32, 2**24), (np.float64, 2**53)) if width * reach**2 < most), np.int64)

    drawn = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(PIVOT_SAMPLE).toArrow()["v"].combine_chunks()
    spread = _spread(_matrix(drawn, width, scale).astype(np.float64), pivots)

    query_lanes = max(1, -(-n_asked // cell_queries))
    slots = _CELLS_A_SLOT * spark.sparkContext.defaultParallelism
    row_lanes = max(1, -(-seen[0] // cell_rows), min(seen[0] // _LEAST_ROWS, -(-slots // query_lanes)))
    cells = query_lanes * row_lanes

    measured = pivot_table(rows, "v", width, kind, spread, scale)
    # numbers of rows, not ids, deal the lanes: an id that many rows share fills no cell
    row_lane = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(row_lanes).cast("long"))
    right = measured.withColumn("lane", row_lane).select(
        "id", "x", "table",
        F.explode(F.sequence(F.col("lane"), F.col("lane") + (query_lanes - 1) * row_lanes, F.lit(row_lanes).cast("long"))).alias("cell"),
    )
    query_lane = F.pmod(F.xxhash64("id", "x"), F.lit(query_lanes).cast("long"))
    left = pivot_table(asked, "v", width, kind, spread, scale).dropDuplicates(["id", "x"])
    left = left.select("id", F.xxhash64("x").alias("mark"), "x", "table", query_lane.alias("lane")).select(
        "id", "mark", "x", "table",
        F.explode(F.sequence(F.col("lane") * row_lanes, F.col("lane") * row_lanes + (row_lanes - 1))).alias("cell"),
    )
    parts = min(cells, 100_000)
    met = (
        left.repartition(parts, "cell").groupBy("cell").cogroup(right.repartition(parts, "cell").groupBy("cell"))
    )
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["query_id", "mark", key, "score"]
    best = met.applyInArrow(
        _cell(width, kind, number, k, names),
        f"query_id {asked.schema['id'].dataType.simpleString()}, mark long, `{key}` {id_type}, score long",
    )
    ranked = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), F.asc_nulls_last(key))
    return best.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")
