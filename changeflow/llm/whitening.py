"""Whitening of embeddings over their distinct vectors, by a weighted multiplicity covariance.

Entries become integers, so that equal vectors are equal exactly. Identical vectors are grouped and
counted; a distinct vector enters the fit with weight one, or with its count. Each partition centres its
vectors on the exact mean, multiplies them with themselves (one weighted GEMM) and emits one matrix, row
by row; these partial sums are added by aggregation. Each distinct vector is whitened once and the rows
are joined back to it; vectors that many rows share are broadcast, at most ``HOT`` of them, so that no
task receives all their rows.

Only sums and one matrix of dimension by dimension reach the driver, where its eigenvectors are taken.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F

from changeflow.session import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: A vector held by more than one in ``HOT`` of all rows is joined by broadcast: fewer than ``HOT`` exist.
HOT = 1000
#: Partial matrices are added in so many groups before they are added to one.
SALTS = 64
#: Rows that are multiplied at once.
ROWS = 4096
LONG = 2**63 - 1


def quantized(embeddings, column="embedding", scale=SCALE, shift=SHIFT):
    """``vec_id, x``: each vector as integers floor(scale * entry) + shift.

    Rows whose vector is null, is empty or holds a null or non-finite entry are left out, as are those with
    an entry that no long can hold.
    """
    vector = embeddings[column].cast("array<double>")
    # A double below 2**62 / scale leaves room for the shift in a long.
    limit = float(2**62) / scale

    def whole(c):
        # NaN counts as larger than any number.
        return F.when(F.abs(c) < limit, F.floor(c * scale).cast("long") + F.lit(shift).cast("long"))

    x = F.transform(vector, whole)
    usable = (F.size(vector) > 0) & F.forall(x, lambda c: c.isNotNull())
    return embeddings.select(
        embeddings["vec_id"].alias("vec_id"), F.when(usable, x).alias("x")
    ).where("x is not null")


def _matrix(column):
    """A list column of equal lengths as a matrix."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _parts(batches, column, weight):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            if part.num_rows:
                yield _matrix(part.column(column)), part.column(weight).to_numpy().astype(object)


def weighted_sums(frame, column, weight):
    """The weight of all rows, and the weighted sum of each dimension, exact for integers."""

    def summed(batches):
        total, sums = 0, None
        for x, w in _parts(batches, column, weight):
            total += sum(w)
            if np.issubdtype(x.dtype, np.integer) and np.abs(x.astype(float)).max() * float(sum(w)) >= LONG / 2:
                x = x.astype(object)
            part = (x * w.astype(x.dtype)[:, None]).sum(axis=0)
            part = part.astype(object)
            sums = part if sums is None else sums + part
        if sums is not None:
            values = [total, *sums]
            exact = [str(v) if isinstance(v, (int, np.integer)) else repr(float(v)) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array(exact)], names=["at", "value"])

    integral = frame.schema[column].dataType.elementType.simpleString() == "bigint"
    number = "decimal(38,0)" if integral else "double"
    rows = (
        frame.select(column, weight).mapInArrow(summed, "at int, value string")
        .groupBy("at").agg(F.sum(F.col("value").cast(number)).alias("value")).orderBy("at").collect()
    )
    kind = int if integral else float
    return int(rows[0].value), [kind(r.value) for r in rows[1:]]


def centred(x, total, sums):
    """x minus its mean, as doubles; integers are centred before they are rounded."""
    if np.issubdtype(x.dtype, np.integer):
        return distances(x, total, sums).astype(float) / total
    return x - np.array(sums) / total


def distances(x, total, sums):
    """total * x - sums, exactly."""
    if float(np.abs(x.astype(float)).max()) * total >= LONG / 4 or max(map(abs, sums)) >= LONG / 4:
        return x.astype(object) * total - np.array(sums, object)
    return x * total - np.array(sums, np.int64)


def covariance(frame, column, weight, total, sums):
    """The weighted covariance matrix of ``column``, centred before it is multiplied; divisor ``total``."""
    d = len(sums)

    def multiplied(batches):
        out = None
        for x, w in _parts(batches, column, weight):
            c = centred(x, total, sums)
            part = (c * w.astype(float)[:, None]).T @ c
            out = part if out is None else out + part
        if out is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d, dtype=np.int32)), pa.array(list(out), pa.list_(pa.float64()))], names=["at", "values"]
            )

    def added(table):
        total_row = _matrix(table.column("values").combine_chunks()).sum(axis=0)
        return table.slice(0, 1).set_column(table.schema.get_field_index("values"), "values", pa.array([total_row], pa.list_(pa.float64())))

    partial = frame.select(column, weight).mapInArrow(multiplied, "at int, values array<double>")
    salted = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    once = salted.groupBy("at", "salt").applyInArrow(added, "at int, values array<double>, salt int")
    rows = once.groupBy("at").applyInArrow(added, "at int, values array<double>, salt int").collect()
    matrix = np.zeros((d, d))
    for row in rows:
        matrix[row.at] = row["values"]
    return matrix / total


def components(matrix, most=COMPONENTS):
    """Eigenvalues in falling order and their unit vectors as columns, at most ``most`` of them."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], vectors[:, order]


def usable(values, dimension):
    """Which components have variance beyond rounding, and so can be whitened."""
    return values > max(values.max(initial=0.0), 0.0) * dimension * np.finfo(float).eps


def whitened_vectors(distinct, total, sums, values, vectors):
    """Each distinct vector with its deviation from the mean and its whitened components."""
    good = usable(values, len(sums))

    def made(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                if not part.num_rows:
                    continue
                x = _matrix(part.column("x"))
                far = distances(x, total, sums)
                if far.dtype != object and (far.astype(float) ** 2).sum(axis=1).max() < LONG / 2:
                    deviation = (far * far).sum(axis=1).tolist()
                else:
                    exact = far.astype(object)
                    deviation = [v if v <= LONG else None for v in (exact * exact).sum(axis=1)]
                projected = centred(x, total, sums) @ vectors[:, good] / np.sqrt(values[good])
                yield pa.RecordBatch.from_arrays(
                    [part.column("x"), part.column("count"), pa.array(deviation, pa.int64()), pa.array(list(projected), pa.list_(pa.float64()))],
                    names=["x", "count", "deviation", "whitened"],
                )

    return distinct.mapInArrow(made, "x array<bigint>, count long, deviation long, whitened array<double>")


def whiten(embeddings, column="embedding", most=COMPONENTS, weights="one"):
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row.

    ``weights="one"`` fits on each distinct vector once, ``"count"`` on each as often as it occurs; n is the
    fit's weight. deviation is null where no long can hold it. Components whose variance does not exceed
    rounding (fewer vectors than dimensions, or all equal) have a null whitened value and take no part in
    identity_error, which is 0 where no component is left. Vectors of another length than most distinct
    ones (of equally common lengths the largest counts) are left out, as ``quantized`` leaves out others.
    Ties of eigenvalues: any orthonormal basis. Repeated rows and ids are returned each; a null id stays
    null. An empty table gives no rows. Columns beside ``vec_id`` and ``column`` are not read. There is no
    text here; a very long vector costs its square in memory, as the covariance does.
    """
    spark = embeddings.sparkSession
    rows = quantized(embeddings, column)
    distinct = written(rows.groupBy("x").count(), "distinct-vectors")
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.sum("count").alias("rows"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    if top is None:
        return spark.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        )
    distinct, rows = (f.where(F.size("x") == top.d) for f in (distinct, rows))
    fit = distinct.withColumn("weight", F.col("count") if weights == "count" else F.lit(1).cast("long"))
    total, sums = weighted_sums(fit, "x", "weight")
    matrix = covariance(fit, "x", "weight", total, sums)
    values, vectors = components(matrix, most)
    white = written(whitened_vectors(distinct, total, sums, values, vectors), "whitened-vectors")
    error = 0.0
    if usable(values, top.d).any():
        again = white.withColumn("weight", F.col("count") if weights == "count" else F.lit(1).cast("long"))
        white_total, white_sums = weighted_sums(again, "whitened", "weight")
        unit = covariance(again, "whitened", "weight", white_total, white_sums)
        error = float(np.abs(unit - np.eye(len(unit))).max())
    trace = float(np.trace(matrix))
    shares = [float(max(v, 0.0)) / trace if trace > 0 else 0.0 for v in values]
    places = np.cumsum(usable(values, top.d)).tolist()
    good = usable(values, top.d).tolist()
    numbered = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("component"),
                (F.get("whitened", F.lit(places[i] - 1)) if good[i] else F.lit(None).cast("double")).alias("whitened"),
                F.lit(shares[i]).alias("explained"),
            )
            for i in range(len(values))
        ]
    )
    return (
        joined_back(rows, white, top.rows)
        .select("vec_id", "deviation", F.explode(numbered).alias("c"))
        .select(
            "vec_id",
            "c.component",
            F.lit(total).cast("long").alias("n"),
            "deviation",
            "c.whitened",
            "c.explained",
            F.lit(error).alias("identity_error"),
        )
    )


def joined_back(rows, white, n_rows, hot=HOT):
    """Each row with the deviation and whitened values of its vector."""
    many = white["count"] * hot > n_rows
    common, others = white.where(many), white.where(~many)
    if not common.limit(1).count():
        return rows.join(others, "x")
    rest = rows.join(F.broadcast(common.select("x")), "x", "left_anti").join(others, "x")
    return rows.join(F.broadcast(common), "x").unionByName(rest)
