"""Near duplicates of embeddings by lattice hashing: cells of the E8 lattice in several tables.

Two vectors are linked if their cosine, in double precision, is LINK or more.

1. Equal vectors are one entry with its number of copies; a vector with any number of copies moves once a task.
2. In each table a unit vector is projected on random directions, eight coordinates a block, and every block is decoded
   to the nearest point of E8.  The vector is put into its own cell and into the PROBES - 1 nearest neighbouring ones
   (minimal vectors of the lattice, ranked by the distance of the projection to the neighbour, over all blocks).  Two
   vectors meet if they share a cell of a table.
3. Number of blocks, scale and number of tables follow from the number of entries by one rule: unrelated vectors meet
   LOAD others a table, and a pair at exactly LINK fails to meet in any table with a probability of MISS at most
   (measured on Gaussian differences when the plan is made); closer pairs meet more surely.
4. Cells are counted, those with one entry go, and larger ones are cut into a grid of blocks of BLOCK entries a side, so
   no task holds one whole.  Entries of a block whose signs on DIRECTIONS random directions differ in more than SIGNS
   places from those of all others there are dropped before vectors move (a pair at LINK is lost so with 2e-5, an
   unrelated pair stays with 4e-7).
5. The vectors that are left are fetched, and each pair of a block is verified by its cosine.  A pair is counted only in
   the smallest of the cells that it shares, so never twice; pairs never leave the task.
6. A block returns per entry how many entries and copies it is linked to there and one edge to the smallest entry it is
   connected with; counts add up, and components of the edges are found on Spark by label propagation.

Defined results: every row comes back with its id, whatever its type.  Vectors that are null, empty, zero or hold null
or non-finite components have no links and are a component of their own.  Vectors of different lengths never link.
Equal vectors link with each other, repeated rows too; copies count as links of each.  component_id is the smallest id
of the component, null if all are null; kept is false for a null id.  An empty table gives no rows; other columns do not
matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from linderos.llm.common import written
from linderos.llm.near import components

LINK = 0.9
PROBES = 3
LOAD = 256.0
MISS = 1e-4
BLOCK = 256
DIRECTIONS, SIGNS = 128, 36
MOST_BLOCKS, MOST_TABLES = 8, 512
SAMPLES = 20_000
SEED = 23
EDGE = 1e-9  # cosines this close to LINK are computed again, row by row

Batches = Iterator[pa.RecordBatch]


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of size 1, or eight of size 1/2 with an even number of minus signs."""
    found = []
    for i in range(8):
        for j in range(i):
            for a, b in product((1.0, -1.0), repeat=2):
                v = np.zeros(8)
                v[i], v[j] = a, b
                found.append(v)
    found += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


MINIMAL = _minimal_vectors()


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest lattice point of each row: the better of the nearest in D8 and in D8 shifted by a half."""
    def nearest_d8(z: np.ndarray) -> np.ndarray:
        r = np.rint(z)
        error = z - r
        odd = np.flatnonzero(r.sum(axis=1) % 2)
        worst = np.abs(error[odd]).argmax(axis=1)
        r[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
        return r

    even, half = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    closer = ((y - even) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], even, half)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_WEIGHTS = np.random.default_rng(SEED).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _numbered(points: np.ndarray) -> np.ndarray:
    """Lattice points as 64-bit numbers, linear in the point: a neighbour's number is the point's plus the step's."""
    return (2 * points).astype(np.int64).astype(np.uint64) @ _WEIGHTS


_STEPS = _numbered(MINIMAL)


def probed_cells(y: np.ndarray, start: np.uint64, probes: int = PROBES) -> np.ndarray:
    """Codes of the own cell and the probes - 1 nearest neighbouring ones of each row of projections (8 a block)."""
    cost, code = np.zeros((len(y), 1)), np.full((len(y), 1), start, dtype=np.uint64)
    for first in range(0, y.shape[1], 8):
        z = y[:, first:first + 8]
        point = nearest_e8(z)
        gain = (z - point) @ MINIMAL.T
        step = np.argpartition(-gain, probes - 1, axis=1)[:, :probes - 1]
        extra = np.hstack([np.zeros((len(y), 1)), 2 - 2 * np.take_along_axis(gain, step, axis=1)])
        own = _numbered(point)[:, None]
        number = np.hstack([own, own + _STEPS[step]])
        total = (cost[:, :, None] + extra[:, None, :]).reshape(len(y), -1)
        codes = _mixed(code[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + _mixed(number)[:, None, :]).reshape(len(y), -1)
        best = np.argpartition(total, min(probes, total.shape[1]) - 1, axis=1)[:, :probes]
        cost, code = np.take_along_axis(total, best, axis=1), np.take_along_axis(codes, best, axis=1)
    return code


def meeting_share(blocks: int, scale: float, link: float = LINK, probes: int = PROBES) -> float:
    """Share of pairs at cosine `link` that meet in one table."""
    rng = np.random.default_rng([SEED, blocks])
    y = rng.standard_normal((SAMPLES, 8 * blocks)) * scale + rng.random(8 * blocks)
    z = y + rng.standard_normal(y.shape) * scale * math.sqrt(2 - 2 * link)
    a, b = (probed_cells(v, np.uint64(0), probes) for v in (y, z))
    return float((a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean())


@dataclass(frozen=True)
class Plan:
    blocks: int
    scale: float
    tables: int
    link: float = LINK


@lru_cache(maxsize=16)
def plan_for(entries: int, link: float = LINK) -> Plan:
    """Blocks, scale and tables for a number of entries: the plan with the fewest tables that keeps LOAD and MISS.

    Projections of unit vectors are normal with deviation `scale`, so two unrelated ones share a cell of volume 1 with
    probability (4 pi scale^2)^-4 a block.
    """
    best = None
    spread = max(2.0, entries * PROBES**2 / LOAD)
    for blocks in range(1, MOST_BLOCKS + 1):
        scale = math.sqrt(spread ** (1 / (4 * blocks)) / (4 * math.pi))
        share = meeting_share(blocks, scale, link)
        tables = 1 if share >= 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-share)) if share > 0 else MOST_TABLES + 1
        if best is None or tables < best.tables:
            best = Plan(blocks, scale, tables, link)
    if best is None or best.tables > MOST_TABLES:
        raise ValueError(f"no plan for {entries} entries at {link}")
    return best


@lru_cache(maxsize=8)
def _directions(plan: Plan, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Projections (table after table), their offsets, the start number of each table, and the directions for signs."""
    rng = np.random.default_rng([SEED, width])
    n = 8 * plan.blocks * plan.tables
    starts = _mixed(rng.integers(0, 1 << 63, plan.tables, dtype=np.uint64))
    signs = rng.standard_normal((width, DIRECTIONS))
    return rng.standard_normal((width, n)) * plan.scale, rng.random(n), starts, signs


def cells_of(u: np.ndarray, plan: Plan) -> np.ndarray:
    """Sorted cell codes of unit vectors, PROBES a table."""
    projection, offset, starts, _ = _directions(plan, u.shape[1])
    y, per = u @ projection + offset, 8 * plan.blocks
    return np.sort(np.hstack([probed_cells(y[:, t * per:(t + 1) * per], starts[t]) for t in range(plan.tables)]).view(np.int64), axis=1)


def signs_of(u: np.ndarray, plan: Plan) -> np.ndarray:
    bits = np.packbits(u @ _directions(plan, u.shape[1])[3] > 0, axis=1)
    return np.ascontiguousarray(bits).view("<i8")


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


# ---------------------------------------------------------------- rows and entries


def _linkable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _packed(column: pa.ListArray) -> list[bytes | None]:
    """Vectors as doubles, or as floats where these hold the same values (the first byte tells); null where null."""
    out: list[bytes | None] = [None] * len(column)
    valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    widths = pc.list_value_length(column.take(pa.array(valid))).to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False) + 0.0, np.cumsum(widths)  # no -0.0
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        v = flat[(ends[rows] - width)[:, None] + np.arange(width)]
        with np.errstate(over="ignore"):
            short = v.astype("<f4")
        same = (short == v).all(axis=1)
        for mark, data, some in ((b"\4", short, same), (b"\10", v.astype("<f8"), ~same)):
            raw, size = data.tobytes(), data.itemsize * int(width)
            for k in np.flatnonzero(some):
                out[valid[rows[k]]] = mark + raw[k * size:(k + 1) * size]
    return out


def _vectors(packed: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(p, dtype="<f4" if p[0] == 4 else "<f8", offset=1) for p in packed], dtype=np.float64)


def _by_width(packed: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of one width after the other."""
    widths = np.array([(len(p) - 1) // (4 if p[0] == 4 else 8) for p in packed])
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield at, _vectors([packed[i] for i in at])


def rows_of(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, a, b, v: every row; a vector that can link with its 128-bit fingerprint, else nulls; written once."""
    given = table.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    given = given.select("id", F.when(_linkable(F.col("v")), F.col("v")).alias("v"))
    kind = StructType([given.schema["id"], StructField("a", LongType()), StructField("b", LongType()), StructField("v", BinaryType())])

    def pack(batches: Batches) -> Batches:
        for batch in batches:
            vectors = _packed(batch.column(1))
            prints = [None if v is None else np.frombuffer(xxhash.xxh3_128_digest(v), dtype="<i8") for v in vectors]
            halves = [pa.array([None if p is None else int(p[k]) for p in prints], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *halves, pa.array(vectors, pa.binary())], ["id", "a", "b", "v"])

    return written(given.mapInArrow(pack, kind), "lattice-rows")


def entries_of(rows: DataFrame) -> DataFrame:
    """entry (a number), a, b, v, copies, first_id: one row per different vector; written once."""
    grouped = rows.where(F.col("a").isNotNull()).groupBy("a", "b").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
    return written(grouped.withColumn("entry", F.monotonically_increasing_id()), "lattice-entries")


# ---------------------------------------------------------------- cells and links


PLACES = StructType([StructField("cell", LongType()), StructField("entry", LongType()), StructField("s0", LongType()), StructField("s1", LongType())])
FACTS = StructType([StructField("entry", LongType()), StructField("copies", LongType()), StructField("v", BinaryType()), StructField("cells", BinaryType())])
MEMBER = ["cell", "i", "j"]
NEEDED = StructType([
    StructField("cell", LongType()), StructField("i", IntegerType()), StructField("j", IntegerType()),
    StructField("chunk", IntegerType()), StructField("entry", LongType())])
LINKS = StructType([StructField(name, LongType()) for name in ("entry", "root", "linked", "copies")])


def _parts(batch: pa.RecordBatch, rows: int = 4_096) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(batch), rows):
        yield batch.slice(first, rows)


def _put(plan: Plan):
    def put(batches: Batches) -> Batches:
        for batch in batches:
            for part in _parts(batch):
                entry = part.column("entry").to_numpy()
                for at, v in _by_width(part.column("v").to_pylist()):
                    u = unit(v)
                    cells = cells_of(u, plan)
                    per = cells.shape[1]
                    each = [entry[at], *np.ascontiguousarray(signs_of(u, plan).T)]
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), *[pa.array(np.repeat(c, per)) for c in each]], PLACES.names)

    return put


def _known(plan: Plan):
    def known(batches: Batches) -> Batches:
        for batch in batches:
            for part in _parts(batch):
                packed = part.column("v").to_pylist()
                cells: list[bytes] = [b""] * len(packed)
                for at, v in _by_width(packed):
                    for place, own in zip(at, cells_of(unit(v), plan)):
                        cells[place] = own.astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([part.column("entry"), part.column("copies"), part.column("v"), pa.array(cells, pa.binary())], FACTS.names)

    return known


def members_of(places: DataFrame, block: int) -> DataFrame:
    """cell, i, j, chunk, entry, s0, s1: members of the blocks of all cells with two entries or more."""
    sizes = places.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    grid = F.ceil(F.col("members") / block).cast("int")
    cut = places.join(sizes, "cell").select(
        "cell", "entry", "s0", "s1", F.pmod(F.xxhash64("entry"), grid).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), grid - 1)).alias("other"))
    return cut.select("cell", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "entry", "s0", "s1")


def _whole_blocks(batches: Batches, least: int = 1 << 14) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows again, cut between blocks, with the number of each row's block; `least` rows or more at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        number = _block_numbers(table)
        cut = int(np.searchsorted(number, number[-1]))
        if cut:
            yield table.slice(0, cut), number[:cut]
        held = table.slice(cut).combine_chunks().to_batches()
    if sum(map(len, held)):
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _block_numbers(table)


def _block_numbers(table: pa.Table) -> np.ndarray:
    ids = np.stack([table.column(c).to_numpy().astype(np.int64) for c in MEMBER], axis=1)
    return np.concatenate([[0], np.cumsum((ids[1:] != ids[:-1]).any(axis=1))])


def _needed(batches: Batches) -> Batches:
    """Members that have a partner in their block whose signs are near enough."""
    for table, number in _whole_blocks(batches):
        signs = [table.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")]
        chunk = table.column("chunk").to_numpy()
        one = table.column("i").to_numpy() == table.column("j").to_numpy()
        stays = np.zeros(len(table), dtype=bool)
        for step in range(1, len(table)):
            left = np.flatnonzero(number[step:] == number[:-step])
            if not len(left):
                break
            right = left + step
            fits = sum(np.bitwise_count(s[left] ^ s[right]).astype(np.int64) for s in signs) <= SIGNS
            fits &= one[left] | (chunk[left] != chunk[right])
            stays[left[fits]] = stays[right[fits]] = True
        yield from table.filter(pa.array(stays)).select(NEEDED.names).combine_chunks().to_batches()


def _roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest place that each place is connected with."""
    root = np.arange(size)
    while True:
        before = root.copy()
        least = np.minimum(root[left], root[right])
        np.minimum.at(root, left, least)
        np.minimum.at(root, right, least)
        root = root[root]
        if (root == before).all():
            return root


def linked_pairs(v: np.ndarray, allowed: np.ndarray, link: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (left < right) of allowed pairs with cosine >= link."""
    u = unit(v)
    near = u @ u.T
    left, right = np.nonzero(np.triu((near >= link - EDGE) & allowed, 1))
    unsure = np.flatnonzero(np.abs(near[left, right] - link) <= EDGE)
    if len(unsure):
        exact = cosines(v[left[unsure]], v[right[unsure]]) >= link
        keep = np.ones(len(left), dtype=bool)
        keep[unsure] = exact
        left, right = left[keep], right[keep]
    return left, right


def first_met(left: np.ndarray, right: np.ndarray, cells: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose smallest common cell is this one."""
    used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    earlier = cells[used]
    earlier = np.where(earlier < cell, earlier, cell)
    codes, column, count = np.unique(earlier, return_inverse=True, return_counts=True)
    has = np.zeros((len(used), len(codes)), dtype=np.float32)
    has[np.repeat(np.arange(len(used)), earlier.shape[1]), column.ravel()] = 1
    has = has[:, (count > 1) & (codes < cell)]
    met = (has @ has.T)[place[:len(left)], place[len(left):]] > 0
    return left[~met], right[~met]


def _links(link: float):
    def links(batches: Batches) -> Batches:
        for table, number in _whole_blocks(batches, 1 << 10):
            bounds = np.flatnonzero(np.diff(number, prepend=-1, append=number[-1] + 1))
            found = []
            entries, copies, chunks = (table.column(c).to_numpy() for c in ("entry", "copies", "chunk"))
            packed, cells, codes = table.column("v"), table.column("cells"), table.column("cell").to_numpy()
            one = (table.column("i").to_numpy() == table.column("j").to_numpy())
            for first, end in zip(bounds[:-1], bounds[1:]):
                if end - first < 2:
                    continue
                order = first + np.argsort(entries[first:end])
                for at, v in _by_width(packed.take(pa.array(order)).to_pylist()):
                    rows = order[at]
                    allowed = np.ones((len(v), len(v)), dtype=bool) if one[first] else chunks[rows][:, None] != chunks[rows][None, :]
                    left, right = linked_pairs(v, allowed, link)
                    if len(left):
                        held = np.array([np.frombuffer(c, dtype="<i8") for c in cells.take(pa.array(rows)).to_pylist()])
                        left, right = first_met(left, right, held, int(codes[first]))
                    if not len(left):
                        continue
                    own, many = entries[rows], copies[rows]
                    count, total = np.zeros(len(v), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
                    for x, y in ((left, right), (right, left)):
                        np.add.at(count, x, 1)
                        np.add.at(total, x, many[y])
                    has = count > 0
                    found.append((own[has], own[_roots(len(v), left, right)][has], count[has], total[has]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], LINKS.names)

    return links


def links_of(entries: DataFrame, plan: Plan, block: int = BLOCK) -> DataFrame:
    """entry, root, linked, copies: for each block and entry its links there; written once."""
    def streamed(rows: DataFrame) -> DataFrame:
        return rows.repartition(*MEMBER).sortWithinPartitions(*MEMBER)

    places = written(entries.select("entry", "v").mapInArrow(_put(plan), PLACES), "lattice-places")
    members = members_of(places, block)
    needed = written(streamed(members).mapInArrow(_needed, NEEDED), "lattice-needed")
    some = entries.join(needed.select("entry").distinct(), "entry").select("entry", "copies", "v")
    facts = written(some.mapInArrow(_known(plan), FACTS), "lattice-facts")
    return written(streamed(needed.join(facts, "entry")).mapInArrow(_links(plan.link), LINKS), "lattice-links")


def near_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", link: float = LINK, block: int = BLOCK) -> DataFrame:
    """(id), n_links, component_id, kept, n_copies (rows with an equal vector): one row per row."""
    rows = rows_of(table, id_column, vector)
    entries = entries_of(rows)
    found = links_of(entries, plan_for(max(2, entries.count()), link), block)
    counts = found.groupBy("entry").agg(F.sum("copies").alias("linked"))
    labels = components(found, "entry", "root").select(F.col("node").alias("entry"), F.col("label").alias("head"))
    known = entries.join(counts, "entry", "left").join(labels, "entry", "left").select(
        "a", "b", "copies", "first_id", F.coalesce("linked", F.lit(0).cast("long")).alias("linked"), F.coalesce("head", "entry").alias("head"))
    known = written(known, "lattice-known")
    heads = known.groupBy("head").agg(F.min("first_id").alias("component_id"))
    told = known.join(heads, "head").select("a", "b", "copies", "linked", "component_id")
    with_links = rows.where(F.col("a").isNotNull()).select("id", "a", "b").join(told, ["a", "b"]).select(
        "id", (F.col("copies") - 1 + F.col("linked")).alias("n_links"), "component_id", F.col("copies").alias("n_copies"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    alone = rows.where(F.col("a").isNull()).select("id", zero.alias("n_links"), F.col("id").alias("component_id"), one.alias("n_copies"))
    return with_links.unionAll(alone).select(
        F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), "n_copies")
