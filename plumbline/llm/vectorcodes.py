"""Product codes of vectors by ball k-means over whole numbers.

Vectors are cut into equal parts; each part position has a codebook of its own, improved in rounds. A round is one pass over the
table: each task assigns its rows and adds the sums of its own parts for every entry, so that only (part, entry)
rows meet, at most ``parts * entries`` of them per task and in the driver. The rows with their codes are written after each pass and
read by the next, which needs them: an entry with the parts last assigned to it is a ball.

* The radius of a ball, at most its largest distance of the last pass and the way that the entry has moved since,
  bounds its neighbours: entries nearer than twice the radius. No other entry can be the nearest of any part of the ball.
* A part nearer to its entry than half the way to the nearest neighbour is in the stable core and stays.
* The neighbours in ascending distance divide the rest into annular rings: a part at distance r is compared with those within 2r only.

All distances that decide are exact whole numbers, so pruning never changes a code, ties included.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import columns, remove, settled_at

#: Rows compared at a time with all entries.
BLOCK = 4096


@dataclass
class Balls:
    """A codebook with the neighbours of each entry in ascending distance."""

    entries: np.ndarray                 # whole numbers, a row per entry
    order: np.ndarray | None = None     # per entry the others by distance, then index
    reach: np.ndarray | None = None     # their squared distances in that order; beyond the ball's neighbours the largest number

    @classmethod
    def of(cls, entries: np.ndarray, radius2: np.ndarray) -> Balls:
        """``radius2``: upper bounds of the squared radii."""
        apart = np.stack([((entries - e) ** 2).sum(axis=1) for e in entries])
        np.fill_diagonal(apart, -1)     # an entry itself comes first and is left out
        order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        reach = np.take_along_axis(apart, order, axis=1)
        beyond = np.iinfo(np.int64).max
        bound = np.array([min(4 * int(r), beyond - 1) for r in radius2], np.int64)
        return cls(entries, order, np.where(reach > bound[:, None], beyond, reach))


def _nearest(x: np.ndarray, entries: np.ndarray, names: np.ndarray, small: bool, rings: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(name, squared distance) of the nearest entry of each row; ties go to the smaller name. ``rings``: how many of the entries a row is compared with."""
    if small:   # all sums stay below 2^53, so floating point is exact
        a, b = x.astype(np.float64), entries.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    else:
        d = np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)
    if rings is not None:
        d[np.arange(len(entries)) >= rings[:, None]] = np.inf if small else np.iinfo(np.int64).max
    least = d.min(axis=1)
    return np.where(d == least[:, None], names, np.iinfo(np.int64).max).min(axis=1), least.astype(np.int64)


def assign(x: np.ndarray, balls: Balls, last: np.ndarray | None, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of parts; ``last``: the entries they were assigned to before."""
    if last is None:
        found = [_nearest(x[i:i + BLOCK], balls.entries, np.arange(len(balls.entries)), small) for i in range(0, len(x), BLOCK)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    code, own = last.copy(), ((x - balls.entries[last]) ** 2).sum(axis=1)
    rank = np.argsort(last, kind="stable")
    for rows in np.split(rank, np.flatnonzero(np.diff(last[rank])) + 1):
        i = last[rows[0]]
        rings = np.searchsorted(balls.reach[i], 4 * own[rows], side="right")
        rows, rings = rows[rings > 0], rings[rings > 0]         # the stable core stays
        for start in range(0, len(rows), BLOCK):
            part, ring = rows[start:start + BLOCK], rings[start:start + BLOCK]
            near = balls.order[i, :ring.max()]
            name, d = _nearest(x[part], balls.entries[near], near, small, ring)
            moves = (d < own[part]) | ((d == own[part]) & (name < i))
            code[part[moves]], own[part[moves]] = name[moves], d[moves]
    return code, own


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """vec_id, label and v: floor(scale * x) of the rows whose vector has components, all of them finite."""
    inner = columns(vectors, vec_id=id_col, label=label_col, v=vector_col)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return inner.where((F.size("v") > 0) & finite).withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * scale)))


@dataclass
class Codes:
    """What compression gives."""

    rows: DataFrame                 # vec_id, label, codes, error
    codebooks: list[np.ndarray]     # of each part, a row per entry


def _pass(state: DataFrame, books: list[Balls], small: bool) -> DataFrame:
    """Rows with new codes and their error, and rows (part, entry, n, far, sums) of what each task has assigned to an entry."""
    id_kind, label_kind = (state.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    first, parts = "codes" not in state.columns, len(books)

    def run(batches):
        width = books[0].entries.shape[1]
        n = [np.zeros(len(b.entries), np.int64) for b in books]
        far = [np.zeros(len(b.entries), np.int64) for b in books]
        sums = [np.zeros((len(b.entries), width), np.int64) for b in books]
        id_type = label_type = None
        names = ["vec_id", "label", "v", "codes", "error", "part", "entry", "n", "far", "sums"]
        for batch in batches:
            id_type, label_type = batch.schema.field("vec_id").type, batch.schema.field("label").type
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, width)
            last = None if first else batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts)
            codes, error = np.empty((batch.num_rows, parts), np.int64), np.zeros(batch.num_rows, np.int64)
            for p, balls in enumerate(books if batch.num_rows else []):
                codes[:, p], d = assign(x[:, p], balls, None if first else last[:, p], small)
                error += d
                n[p] += np.bincount(codes[:, p], minlength=len(n[p]))
                np.maximum.at(far[p], codes[:, p], d)
                np.add.at(sums[p], codes[:, p], x[:, p])
            listed = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel(), pa.int32()), parts).cast(pa.list_(pa.int32()))
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], listed, pa.array(error), *none], names)
        used = [(p, int(e)) for p in range(parts) for e in np.flatnonzero(n[p])]
        if used:
            none = [pa.nulls(len(used), t) for t in (id_type, label_type, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64())]
            facts = [pa.array([u[0] for u in used], pa.int32()), pa.array([u[1] for u in used], pa.int32()), pa.array([n[p][e] for p, e in used], pa.int64()),
                     pa.array([far[p][e] for p, e in used], pa.int64()), pa.array([sums[p][e].tolist() for p, e in used], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, *facts], names)

    read = state.select("vec_id", "label", "v", *([] if first else ["codes"]))
    return read.mapInArrow(run, f"vec_id {id_kind}, label {label_kind}, v array<bigint>, codes array<int>, error long, part int, entry int, n long, far long, sums array<bigint>")


def _moved(written: DataFrame, books: list[Balls]) -> list[Balls]:
    """The codebooks after a pass: every entry at the rounded-down mean of its parts; the balls of the assignment that was made."""
    width = books[0].entries.shape[1]
    total = written.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width)]).alias("sums"))
    entries, far = [b.entries.copy() for b in books], [[0] * len(b.entries) for b in books]
    for r in total.collect():       # one row per part and entry
        entries[r.part][r.entry] = [int(s) // r.n for s in r.sums]
        far[r.part][r.entry] = r.far
    out = []
    for old, new, d in zip(books, entries, far):
        way = ((new - old.entries) ** 2).sum(axis=1)
        out.append(Balls.of(new, np.array([int((f ** 0.5 + w ** 0.5) ** 2 * (1 + 1e-9)) + 1 for f, w in zip(d, way.tolist())], object)))
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codes:
    """Codes of all vectors: per row vec_id, label, codes (an entry for each part) and error (squared distances summed over parts).

    The codebooks start as the parts of the ``entries`` rows with the smallest ids (fewer if there are fewer; repeated ids by
    their vectors), and move ``rounds`` times. Rows whose vector is null or empty or holds null or non-finite components go.
    A null id is kept and starts no entry; without any other row to start from there are no codes, so the rows have null
    codes and errors. Repeated rows get a row each. An empty table gives no rows. Other columns of ``vectors`` are not looked
    at. Vectors of different lengths, lengths that the parts do not divide, and components too large for
    exact 64-bit distances are refused.
    """
    spark = vectors.sparkSession
    kept = whole_numbers(vectors, id_col, vector_col, label_col, scale)
    size = F.size("v")
    facts = kept.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("top")).first()
    if facts.least is not None and (facts.least != facts.most or facts.least % parts):
        raise ValueError(f"vectors have {facts.least} to {facts.most} components; one length that {parts} divides is needed")
    room = 0 if facts.least is None else 4 * facts.least * (facts.top + 1) ** 2
    if room >= 2 ** 62:
        raise ValueError("components are too large for exact distances")
    start = np.array([r.v for r in kept.where("vec_id is not null").orderBy("vec_id", "v").limit(entries).collect()], np.int64)
    if not len(start):
        return Codes(kept.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")), [])
    small, width = room < 2 ** 53, start.shape[1] // parts
    books = [Balls(start[:, p * width:(p + 1) * width]) for p in range(parts)]
    state, before = kept, None
    for _ in range(rounds):
        written, path = settled_at(_pass(state, books, small))
        books = _moved(written, books)
        if before:
            remove(spark, before)       # nothing reads it any more
        state, before = written.where("part is null"), path
    last, _ = settled_at(_pass(state, books, small).where("part is null").select("vec_id", "label", "codes", "error"))
    if before:
        remove(spark, before)
    return Codes(last, [b.entries for b in books])


def digest(codebooks: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in codebooks for x in b.ravel().tolist()).encode()).hexdigest()
