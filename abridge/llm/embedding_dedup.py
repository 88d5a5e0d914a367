"""Near-duplicate vectors: spherical k-means cells, blocked cosine products in each cell, one representative a group.

Equal vectors of a label form a class first; only classes of one label and length are compared. A class belongs to its
nearest centre's cell and visits, as a guest, each later cell whose border is within the chord of the threshold:
two unit vectors at cosine >= t are at most sqrt(2 - 2t) apart, so a link that crosses a border lies
within that distance of it on both sides. Every link is thus found once, in the later of its ends' cells, and
recall is 1, not only likely; centres only affect speed. Where the data ask for more cells than centres can be fitted for at
once, every cell has centres of its own and is cut again by the same rule, so cells grow in number with the data, not in size.

Cells are cut into blocks of BLOCK rows; a task multiplies two blocks, the first not after the second, counts links
of both sides and keeps only a spanning forest of what it found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abridge.llm.common import connected_components, small_batches, stored

#: Vectors that centres are fitted on at most, rows of a block, members of a cell aimed at, vectors for each centre in fitting.
SAMPLE, BLOCK, CELL, EACH = 20_000, 4096, 2000, 20
#: Centres of one cell at most, and bytes of all that are sent to the executors.
INNER, SENT = 100, 64 << 20


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k unit centres of unit vectors by Lloyd's rounds; empty cells keep their centre."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), k, replace=False)].copy()
    for _ in range(rounds):
        own = (vectors @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, vectors)
        size = np.linalg.norm(total, axis=1)
        centres[size > 1e-12] = total[size > 1e-12] / size[size > 1e-12, None]
    return centres


def _unit(values: np.ndarray) -> np.ndarray:
    top = np.abs(values).max(axis=1, keepdims=True)
    values = values / top
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _block_links(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float) -> pd.DataFrame:
    """(rep, links, root) of the classes that link in two blocks of a cell, or within one: vectors linked here, the least class reached here.

    Two guests of a cell, or of a cell in it, are compared elsewhere.
    """
    same = right is None
    right = left if same else right
    dim = len(left["vec"].iloc[0]) // 8
    x, y = (_unit(np.frombuffer(b"".join(side["vec"]), np.float64).reshape(-1, dim)) for side in (left, right))
    a, b, ma, mb = (side[c].to_numpy() for c in ("rep", "many") for side in (left, right))
    near = np.zeros((len(x), len(y)), bool)
    for k in range(0, len(x), 512):
        near[k : k + 512] = x[k : k + 512] @ y.T >= threshold
        for flag in ("outer", "inner"):
            near[k : k + 512] &= left[flag].to_numpy(bool)[k : k + 512, None] | right[flag].to_numpy(bool)[None, :]
    if same:
        near = np.triu(near, 1)
    rows, cols = near.any(axis=1), near.any(axis=0)
    if same:
        rows = cols = rows | cols
    near, a, b, ma, mb = near[rows][:, cols], a[rows], b[cols], ma[rows], mb[cols]
    low, back, most = a.copy(), b.copy(), np.iinfo(np.int64).max
    while len(a):  # least class along links, to and fro, until it settles
        to = np.minimum(low, _least(near, back, most))
        fro = np.minimum(back, _least(near.T, to, most))
        if same:
            to = fro = np.minimum(to, fro)
        if (to == low).all() and (fro == back).all():
            break
        low, back = to, fro
    if same:
        return pd.DataFrame({"rep": a, "links": near @ mb + ma @ near, "root": low})
    return pd.DataFrame({"rep": np.concatenate([a, b]), "links": np.concatenate([near @ mb, ma @ near]), "root": np.concatenate([low, back])})


def _least(near: np.ndarray, values: np.ndarray, most: int) -> np.ndarray:
    """For each row the least value of the columns set in it."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(near), most)
    for k in range(0, len(near), 512):
        part = near[k : k + 512][:, order]
        out[k : k + 512] = np.where(part.any(axis=1), values[order][part.argmax(axis=1)], most)
    return out


def _shaped(centres: np.ndarray, dim: int) -> np.ndarray:
    """Centres for vectors of another length: cut, or filled with zeros. Any centres serve; those that vanish become the first axis."""
    if centres.shape[1] == dim:
        return centres
    out = np.zeros((len(centres), dim))
    out[:, : centres.shape[1]] = centres[:, :dim]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out = out / np.maximum(size, 1e-300)
    out[size[:, 0] < 1e-12] = np.eye(1, dim)
    return out


def _visits(values: np.ndarray, centres: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's own) for unit vectors: their nearest centre, and later ones across near borders."""
    cos = values @ centres.T
    own = cos.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    near = cos[np.arange(len(own)), own][:, None] - cos <= chord * apart[own]
    near &= np.arange(len(centres)) > own[:, None]
    near[np.arange(len(own)), own] = True
    row, cell = np.nonzero(near)
    return row, cell, own[row] == cell


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, cells: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; other columns are not read.

    Two rows link when their labels are equal and not null, their vectors have the same length and the cosine, in
    double precision, is at least `threshold`. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, nor do rows with a null id (their component is null, kept false). Rows that repeat an id
    each count as a vector. Centres are fitted on the `sample` valid classes of least hash among those of the most frequent length, and, where
    cells are cut again, on up to EACH x INNER classes of each cell; every class is indexed. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label"))
    inf = "double('Infinity')"
    fit = F.expr(f"vec_id is not null and label is not null and size(vec) > 0 and forall(vec, x -> x is not null and abs(x) < {inf}) and exists(vec, x -> x <> 0)")
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    # Minus zero is zero: its bits differ, but the vectors are equal, and vectors are compared by their bits below.
    rows = rows.withColumn("vec", F.expr("transform(vec, x -> if(x = 0, 0.0D, x))"))
    classes = stored(rows.where("fit").groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")), "classes")
    common = classes.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "d").limit(1).collect()
    dim = common[0]["d"] if common else 1
    largest = classes.groupBy("label").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
    seen = classes.where(F.size("vec") == dim).select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(sample).toArrow()
    fitted = _unit(_matrix(seen["vec"].combine_chunks(), dim)) if len(seen) else np.zeros((0, dim))
    wanted = cells or -(-largest // CELL)
    k = max(1, min(wanted, len(fitted) // EACH or 1))
    centres = spherical_kmeans(fitted, k) if len(fitted) else np.ones((1, dim)) / np.sqrt(dim)
    chord = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and vectors of each length in a batch."""
        size = pc.list_value_length(batch.column(at)).to_numpy()
        for d in np.unique(size):
            some = np.flatnonzero(size == d)
            yield some, _matrix(batch.column(at).take(pa.array(some)), int(d))

    inner: dict[int, np.ndarray] = {}
    if (more := min(INNER, -(-wanted // k), SENT // (8 * dim * k))) > 1:
        outer = spark.sparkContext.broadcast(centres)

        def cell_of(batches):
            for batch in batches:
                for some, values in by_length(batch, 0):
                    cell = (_unit(values) @ _shaped(outer.value, values.shape[1]).T).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array([v.tobytes() for v in values], pa.binary()), batch.column(1).take(pa.array(some))], ["cell", "vec", "h"])

        def centres_of(group: pd.DataFrame) -> pd.DataFrame:
            values = _unit(np.frombuffer(b"".join(group["vec"]), np.float64).reshape(-1, dim))
            found = spherical_kmeans(values, min(more, max(1, len(values) // EACH)))
            return pd.DataFrame({"cell": [int(group["cell"].iloc[0])], "centres": [found.tobytes()]})

        drawn = classes.where(F.size("vec") == dim).select("vec", F.xxhash64("vec").alias("h")).mapInArrow(cell_of, "cell int, vec binary, h long")
        nth = F.row_number().over(Window.partitionBy("cell").orderBy("h", "vec"))  # a window limit cuts each task's rows before they travel
        drawn = drawn.withColumn("nth", nth).where(F.col("nth") <= EACH * more)
        inner = {r["cell"]: np.frombuffer(r["centres"], np.float64).reshape(-1, dim) for r in drawn.groupBy("cell").applyInPandas(centres_of, "cell int, centres binary").collect()}
    sent = spark.sparkContext.broadcast((centres, inner))

    def assign(batches):
        centres, inner = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                for some, values in by_length(batch, 1):
                    unit, d = _unit(values), values.shape[1]
                    row, cell, own = _visits(unit, _shaped(centres, d), chord)
                    parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, bool)]
                    for c in np.unique(cell):
                        there = np.flatnonzero(cell == c)
                        if c in inner:
                            r, second, mine = _visits(unit[row[there]], _shaped(inner[c], d), chord)
                        else:
                            r, second, mine = np.arange(len(there)), np.zeros(len(there), np.int64), np.ones(len(there), bool)
                        for part, x in zip(parts, (row[there][r], c * INNER + second, own[there][r], mine)):
                            part.append(x)
                    row, cell, own, mine = map(np.concatenate, parts)
                    blobs, taken = [v.tobytes() for v in values], pa.array(some[row])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(taken), pa.array([blobs[i] for i in row], pa.binary()), batch.column(2).take(taken), batch.column(3).take(taken), pa.array(np.full(len(row), d), pa.int32()), pa.array(cell, pa.int64()), pa.array(own), pa.array(mine)],
                        ["label", "vec", "rep", "many", "dim", "cell", "outer", "inner"],
                    )

    placed = stored(classes.select("label", "vec", "rep", "many").mapInArrow(assign, "label string, vec binary, rep long, many long, dim int, cell long, outer boolean, inner boolean"), "placed")
    place = ["label", "dim", "cell"]
    blocks = placed.groupBy(place).agg(F.count("*").alias("k")).where("k > 1").select(*place, F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    cut = placed.join(blocks, place).withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = cut.withColumn("other", other).select(*place, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "many", "vec", "outer", "inner")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        left, right = group[group["block"] == i], None if i == j else group[group["block"] == j]
        if not len(left) or right is not None and not len(right):
            return pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        return _block_links(left, right, threshold)

    found = stored(cut.groupBy(*place, "i", "j").applyInPandas(compare, "rep long, links long, root long"), "found")
    roots = connected_components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(counted, "rep", "left").join(roots, classes["rep"] == roots["node"], "left")
    known = known.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("root", "rep").alias("low"))
    out = rows.where("fit").join(known, ["label", "vec"]).select("vec_id", F.col("links").alias("n_links"), F.col("low").alias("component_id"))
    out = out.union(rows.where("not fit").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.select(F.col("vec_id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.expr("vec_id = component_id"), F.lit(False)).alias("kept"))
