"""Embedding whitening with distributed block matrices of Spark MLlib.

Entries become whole numbers x; n and the sums S of the dimensions are exact, and so are the centred rows n x - S.
The centred rows, numbered without gaps, are dealt into blocks of a BlockMatrix; the transpose times the matrix is
the scatter, of which only width x width numbers reach the driver for a local eigh. The matrix times the
whitening matrix gives the projected rows. Rows of a block grow with the table, so that the number of blocks,
which the driver plans the products by, stays bounded.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are rows of
another length than the most common one (of equally common ones the longest); repeated rows and ids count each; a
component without variance has a null ``whitened``; where nothing varies ``explained`` and ``identity_error`` are null;
extra columns are ignored; an empty table gives no rows. Entries so large that n x leaves 64 bits are an error of Spark's.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F

from fluvion.llm.common import staged

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: rows of a block at least, and blocks at most
ROWS, BLOCKS = 1024, 2048
#: an eigenvalue below this share of the trace is no variance
FLAT = 1e-12

_USABLE = "size(embedding) > 0 and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"


def numbers(rows: DataFrame) -> DataFrame:
    """(vec_id, x): the usable vectors of the most common length as whole numbers."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long") + F.lit(SHIFT).cast("long"))
    usable = rows.where(_USABLE)
    most = usable.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return usable.where(F.size("embedding") == (most["width"] if most else 0)).select("vec_id", x.alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows``, written, with ``idx`` from 0 without gaps: the place in a written part, after the rows of the parts before."""
    low = (1 << 33) - 1
    rows = staged(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(low)).alias("seq")), "rows")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # one row per part
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    return rows.join(offsets, "part").withColumn("idx", F.col("seq") + F.col("offset")).drop("part", "seq", "offset")


def _constants(values: np.ndarray | list, kind: str) -> Column:
    return F.array(*(F.lit(v.item() if hasattr(v, "item") else v) for v in values)).cast(f"array<{kind}>")


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """Rows (idx, values) as a distributed matrix of one column of blocks."""
    vectors = rows.select(F.col("idx").alias("index"), array_to_vector("values").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, width)
    # read by several products; what an executor loses is made again from the written rows
    return matrix.toBlockMatrix(max(ROWS, -(-n // BLOCKS)), width).persist(StorageLevel.MEMORY_AND_DISK)


def multiplied(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a b, the dimension in the middle cut in ``splits`` parts, which Python's own ``multiply`` does not offer."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix: the sum over all rows, made in parts of a few blocks each."""
    return multiplied(matrix.transpose(), matrix, max(1, matrix.numRowBlocks // 4)).toLocalMatrix().toArray()


def eigen(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit vectors as columns, the largest entry of each positive."""
    e, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-e, kind="stable")[:components]
    e, vectors = e[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return e, vectors * signs


def projected(matrix: BlockMatrix, by: np.ndarray) -> DataFrame:
    """(idx, values): the rows of matrix times ``by``, written."""
    sc = matrix.blocks.context
    small = BlockMatrix(sc.parallelize([((0, 0), Matrices.dense(*by.shape, by.flatten("F").tolist()))], 1), *by.shape)
    rows = matrix.multiply(small).toIndexedRowMatrix().rows.map(lambda r: (r.index, r.vector.toArray().tolist()))
    return staged(rows.toDF("idx bigint, values array<double>"), "projected")


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable vector and component."""
    shape = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = shape.format(vectors.schema["vec_id"].dataType.simpleString())
    rows = staged(numbered(numbers(vectors)), "numbered")
    sums = {r["pos"]: (r["s"], r["n"]) for r in rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()}
    if not sums:
        return vectors.sparkSession.createDataFrame([], schema)
    width, n = len(sums), sums[0][1]
    exact = F.zip_with("x", _constants([sums[i][0] for i in range(width)], "bigint"), lambda x, s: x * F.lit(n).cast("long") - s)
    rows = rows.select("idx", "vec_id", exact.alias("d"))
    deviation = F.aggregate("d", F.lit(0).cast("long"), lambda total, d: total + d * d)
    rows = staged(rows.select("idx", "vec_id", deviation.alias("deviation"), F.transform("d", lambda d: d / n).alias("values")), "centred")

    matrix = block_matrix(rows, n, width)
    covariance = scatter(matrix) / n
    trace = float(np.trace(covariance))
    e, directions = eigen(covariance, components)
    varies = e > FLAT * trace if trace > 0 else np.zeros(len(e), bool)
    by = directions / np.sqrt(np.where(varies, e, 1.0))
    done = projected(matrix, by)

    error = None
    if varies.any():
        means = done.select(F.posexplode("values").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("m")).collect()
        means = [m for _, m in sorted((r["pos"], r["m"]) for r in means)]
        centred = done.select("idx", F.zip_with("values", _constants(means, "double"), lambda v, m: v - m).alias("values"))
        identity = (scatter(block_matrix(centred, n, len(e))) / n)[np.ix_(varies, varies)]
        error = float(np.abs(identity - np.eye(len(identity))).max())
    told = rows.select("idx", "vec_id", "deviation").join(done, "idx").select("vec_id", "deviation", F.posexplode("values").alias("at", "value"))
    share = _constants([float(x) / trace for x in e] if trace > 0 else [None] * len(e), "double")
    return told.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.get(_constants(varies.tolist(), "boolean"), "at"), F.col("value")).alias("whitened"),
        F.get(share, "at").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
