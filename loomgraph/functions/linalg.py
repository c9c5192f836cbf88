"""Products of tall sparse matrices as aggregations, and leading singular vectors from them. X: (doc, term, x) in long form; U, W: (doc, vector array)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows(x: DataFrame, vocab: DataFrame, doc: str = "doc_id", small: bool = True) -> DataFrame:
    """(doc, idx: array<int>, val: array<double>): sparse rows, one for each document. vocab: (term, term_id); small: it may be broadcast."""
    own = x.join(F.broadcast(vocab) if small else vocab, "term").groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("term_id", "x"))).alias("e"))
    return own.select(doc, F.col("e.term_id").alias("idx"), F.col("e.x").alias("val"))


def _dense(pdf: pd.DataFrame, p: int) -> np.ndarray:
    out = np.zeros((len(pdf), p))
    lengths = [len(i) for i in pdf["idx"]]
    if sum(lengths):
        out[np.repeat(np.arange(len(pdf)), lengths), np.concatenate(pdf["idx"].to_list())] = np.concatenate(pdf["val"].to_list())
    return out


def gram(sparse: DataFrame, p: int) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X (p x p), column sums and the number of rows: a partial matrix from each task, summed by cell in Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, s, n = np.zeros((p, p)), np.zeros(p), 0
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                d = _dense(pdf.iloc[at : at + 2048], p)
                g, s, n = g + d.T @ d, s + d.sum(0), n + len(d)
        if n:
            i, j = np.nonzero(np.triu(g))
            yield pd.DataFrame({"i": np.concatenate([i, np.full(p, -1), [-2]]).astype(np.int32), "j": np.concatenate([j, np.arange(p), [0]]).astype(np.int32), "v": np.concatenate([g[i, j], s, [n]])})

    cells = sparse.select("idx", "val").mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    i, j, v = cells["i"].to_numpy(), cells["j"].to_numpy(), cells["v"].to_numpy()
    g, s = np.zeros((p, p)), np.zeros(p)
    g[i[i >= 0], j[i >= 0]] = v[i >= 0]
    g = np.triu(g) + np.triu(g, 1).T
    s[j[i == -1]] = v[i == -1]
    return g, s, int(v[i == -2].sum())


def gram_long(x: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(t1, t2, v), t1 <= t2: the Gram matrix by a self-join on the document; for short documents and few terms."""
    a, b = x.select(doc, F.col("term").alias("t1"), F.col("x").alias("x1")), x.select(doc, F.col("term").alias("t2"), F.col("x").alias("x2"))
    return a.join(b, doc).where("t1 <= t2").groupBy("t1", "t2").agg(F.sum(F.col("x1") * F.col("x2")).alias("v"))


def times(sparse: DataFrame, v: np.ndarray, doc: str = "doc_id", name: str = "u") -> DataFrame:
    """(doc, X v) as an array column; v: p x K, of bounded size, travels with the tasks."""

    @F.pandas_udf("array<double>")
    def run(idx: pd.Series, val: pd.Series) -> pd.Series:
        return pd.Series([(np.asarray(x) @ v[np.asarray(i, dtype=int)]) for i, x in zip(idx, val, strict=True)], dtype=object)

    return sparse.select(doc, run("idx", "val").alias(name))


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of every entry of the sparse rows."""
    lengths = np.fromiter(map(len, pdf["idx"]), np.int64, len(pdf))
    if not lengths.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.repeat(np.arange(len(pdf)), lengths), np.concatenate(pdf["idx"].to_list()).astype(np.int64), np.concatenate(pdf["val"].to_list())


def _add_outer(out: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray, u: np.ndarray) -> None:
    """out += X'U for the entries of X and the rows of U, touching the columns that occur only."""
    own, at = np.unique(col, return_inverse=True)
    for j in range(out.shape[1]):
        out[own, j] += np.bincount(at, weights=val * u[row, j], minlength=len(own))


def _by_row(out: np.ndarray, names: list[str]) -> pd.DataFrame:
    some = np.flatnonzero(out.any(axis=1))
    return pd.DataFrame({"i": some.astype(np.int32)} | {c: out[some, j] for j, c in enumerate(names)})


def _summed(parts: DataFrame, names: list[str], p: int) -> np.ndarray:
    """The p x k sum of the tasks' rows (i, values)."""
    cells = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out, at = np.zeros((p, len(names))), cells["i"].to_numpy()
    for j, c in enumerate(names):
        out[at, j] = cells[c].to_numpy()
    return out


def cross(sparse: DataFrame, u: DataFrame, p: int, k: int, doc: str = "doc_id", name: str = "u") -> np.ndarray:
    """X'U (p x k): partial matrices from each task, summed in Spark."""
    names = [f"c{j}" for j in range(k)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((p, k))
        for pdf in batches:
            _add_outer(g, *_flat(pdf), np.array(pdf[name].to_list()).reshape(-1, k))
        yield _by_row(g, names)

    return _summed(sparse.join(u, doc).select("idx", "val", name).mapInPandas(partial, "i int, " + ", ".join(f"{c} double" for c in names)), names, p)


def product(sparse: DataFrame, b: np.ndarray) -> np.ndarray:
    """X'(X B) in one pass over the rows: XB exists one batch at a time, in no table. b: p x l travels with the tasks."""
    names = [f"c{j}" for j in range(b.shape[1])]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(b.shape)
        for batch in batches:
            idx, val = batch.column(0), batch.column(1).flatten().to_numpy()
            size, col = np.diff(idx.offsets.to_numpy()), idx.flatten().to_numpy()
            if len(col):
                row, some = np.repeat(np.arange(len(idx)), size), np.flatnonzero(size)
                y = np.zeros((len(idx), b.shape[1]))
                y[some] = np.add.reduceat(val[:, None] * b[col], (np.cumsum(size) - size)[some], axis=0)
                _add_outer(g, row, col, val, y)
        yield pa.RecordBatch.from_pandas(_by_row(g, names), preserve_index=False)

    return _summed(sparse.select("idx", "val").mapInArrow(partial, "i int, " + ", ".join(f"{c} double" for c in names)), names, len(b))


def column_sums(sparse: DataFrame, p: int) -> tuple[np.ndarray, int]:
    """The sum of each column, and the number of rows."""
    cells = sparse.select(F.explode(F.arrays_zip("idx", "val")).alias("e")).groupBy("e.idx").agg(F.sum("e.val").alias("v")).toArrow()
    out = np.zeros(p)
    out[cells["idx"].to_numpy()] = cells["v"].to_numpy()
    return out, sparse.count()


def _orthonormal(block: np.ndarray, basis: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """An orthonormal basis of what the block adds to the basis; projected out twice, and columns that vanish are dropped."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        left, value, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, value > least]
    return block


def leading(sparse: DataFrame, k: int, p: int, less: np.ndarray | None = None, start: np.ndarray | None = None, extra: int = 6, tol: float = 1e-8, most: int = 60, held: int = 1 << 25, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Leading k eigenvectors (p x k) and values of X'X - diag(less), without the p x p matrix.

    Block Lanczos with full orthogonalisation: each round is one pass over the rows, the values and residuals come from the
    small projected matrix, and it ends when every residual is below tol times the gap to the next value, so that the spanned
    space is known to about tol, or at rounding error, where values are equal. A basis of more than `held` numbers is cut
    back to its best vectors. Blocks are k + extra wide; p times that is what a task holds. A space that is exhausted (rank
    below k) ends it too; start: vectors to begin with; residuals above 1e-8 of the greatest value after `most` rounds are an error.
    """
    width = min(p, k + extra)
    rng = np.random.default_rng(seed)
    q, aq = np.zeros((p, 0)), np.zeros((p, 0))
    block = rng.normal(size=(p, width))
    if start is not None:
        block[:, : min(start.shape[1], width)] = start[:, :width]
    block = _orthonormal(block, q)
    for _ in range(most):
        w = product(sparse, block)
        if less is not None:
            w = w - less[:, None] * block
        q, aq = np.hstack([q, block]), np.hstack([aq, w])
        small = q.T @ aq
        val, y = np.linalg.eigh((small + small.T) / 2)
        val, y = val[::-1], y[:, ::-1]
        kept = min(k, len(val))
        residual = np.linalg.norm(aq @ y[:, :kept] - q @ (y[:, :kept] * val[:kept]), axis=0)
        enough = max(tol * (val[k - 1] - val[k] if len(val) > k else 0.0), 1e-13 * abs(val[0]))
        block = _orthonormal(w, q)
        if q.shape[1] == p or not block.shape[1] or (len(val) > k and residual.max() <= enough):
            break
        if q.size + block.size > held and q.shape[1] > 3 * width:
            best = y[:, : 2 * width]
            q, aq = q @ best, aq @ best  # the next block is orthogonal to all of the basis, so to its best vectors too
    else:
        if residual.max() > 1e-8 * abs(val[0]):
            raise RuntimeError(f"no {k} vectors after {most} rounds; the greatest residual is {residual.max()}")
    vec = q @ y[:, :k]
    if vec.shape[1] < k:
        vec, val = np.pad(vec, ((0, 0), (0, k - vec.shape[1]))), np.pad(val, (0, k - len(val)))
    sign = np.sign(vec[np.abs(vec).argmax(0), np.arange(k)])
    return vec * np.where(sign == 0, 1, sign), val[:k]


def small_gram(u: DataFrame, k: int, name: str = "u") -> np.ndarray:
    """U'U (k x k) inside the JVM."""
    cells = [F.sum(F.col(name)[i] * F.col(name)[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    r = u.agg(*cells).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = r[f"c{i}_{j}"] or 0.0
    return out


def rotate(df: DataFrame, m: np.ndarray, name: str = "u", to: str | None = None) -> DataFrame:
    """The array column times a small matrix, inside the JVM."""
    cols = [sum((F.col(name)[i] * F.lit(float(m[i, j])) for i in range(m.shape[0])), F.lit(0.0)) for j in range(m.shape[1])]
    return df.withColumn(to or name, F.array(*cols))


def top_eigen(g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors and values of a symmetric matrix; each vector's largest entry is positive."""
    val, vec = np.linalg.eigh(g)
    vec, val = vec[:, ::-1][:, :k], val[::-1][:k]
    sign = np.sign(vec[np.abs(vec).argmax(0), np.arange(k)])
    return vec * np.where(sign == 0, 1, sign), val
