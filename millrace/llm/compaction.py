"""Compaction of small files by first fit, planned group at a time and executed.

Rows are written as one sorted file for each (day, lot, piece). Which of them
are small is known from counts, so the files that will be replaced stand in a
folder of their own. Small files of a day are put into groups as first fit over
descending sizes would: each group takes, again and again, the next file that
fits what is left of it, found by bisection, with taken files skipped by
union-find. Files of a group are read back, concatenated in joining order and
written as one; then the folder of replaced files goes in one call.

Rows are dealt by file, plans by day. A day has at most four pieces of as many
lots as a 150th of the table allows, so its plan is small at any input size.
Only days above a 150th of all rows, of which there are fewer than 150, come to
the driver.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.scratch import Scratch, named, renamed

#: A file's identity within the folder: its day since 1970 (may be null), lot and piece.
KEYS = ("day", "lot", "piece")


def first_fit(sizes: list[int], most: int) -> list[list[int]]:
    """Groups of positions in ``sizes``, which descend, as first fit opens and
    fills them: each item joins the earliest group that stays within ``most``,
    or opens one (alone, even if it is larger itself)."""
    n = len(sizes)
    low = [-s for s in sizes]
    skip = list(range(n + 1))

    def free(i: int) -> int:
        """The first item from ``i`` on that no group has taken."""
        root = i
        while skip[root] != root:
            root = skip[root]
        while skip[i] != root:
            skip[i], i = root, skip[i]
        return root

    groups = []
    while (i := free(0)) < n:
        group, left = [], most
        while i < n:
            group.append(i)
            skip[i] = i + 1
            left -= sizes[i]
            # sizes descend: the first that fits, no earlier than the next item
            i = free(max(i + 1, bisect_left(low, -left)))
        groups.append(group)
    return groups


def _plan(small: int, most: int):
    """Files of one day -> each with the first file of its group, its place in
    the group and the group's number of files."""

    def run(t: pa.Table) -> pa.Table:
        lot, piece, rows = (t.column(c).to_numpy() for c in ("lot", "piece", "n"))
        order = [i for i in np.lexsort((piece, lot, -rows)).tolist() if rows[i] < small]
        head, place, files = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64)
        for group in first_fit([int(rows[i]) for i in order], most):
            own = [order[i] for i in group]
            head[own], place[own], files[own] = own[0], np.arange(len(own)), len(own)
        return pa.table({"day": t.column("day"), "lot": lot, "piece": piece, "to_lot": lot[head], "to_piece": piece[head], "place": place.astype(np.int32), "files": files.astype(np.int32)})

    return run


@dataclass(frozen=True)
class Compacted:
    """``folder`` holds the final files; ``plan`` has a row for each starting
    file: day, lot, piece, the first source of its final file (to_lot,
    to_piece), its place there and how many files went into that one."""

    folder: str
    plan: DataFrame


def _source() -> list[Column]:
    """A plan's row under names that its files' rows don't have."""
    return [F.col(k).alias(f"{k[0]}_") for k in KEYS]


def _at() -> Column:
    """Whether a row belongs to the file (d_, l_, p_)."""
    return F.col("day").eqNullSafe(F.col("d_")) & (F.col("lot") == F.col("l_")) & (F.col("piece") == F.col("p_"))


def _folders(taken: list[str]) -> dict[str, str]:
    """Names of the folders' columns, longer until no column of the table is called so."""
    low, out = {c.lower() for c in taken}, {}
    for k in ("small", *KEYS):
        out[k] = k
        while out[k] in low:
            out[k] += "x"
        low.add(out[k])
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def day_of(at: str) -> Column:
    """Whole days since 1970 of a date or timestamp column."""
    return F.datediff(F.col(at).cast("date"), F.lit("1970-01-01").cast("date"))


def compact(rows: DataFrame, scratch: Scratch, at: str = "arrived_at", key: str = "click_id", lots: int = 150, small: int = 600, most: int = 400) -> Compacted:
    """Write ``rows`` as files by (day of ``at``, lot and piece by the checksum of
    ``key``), each sorted by ``at``, then ``key``, and compact them.

    A share x of the R rows is S(x) = 1 + R // x rows: a day of r rows has
    1 + r // S(lots) lots; files under S(small) rows are put together to at most
    S(most). All columns are kept in their order, whatever their names; files of
    one source are not touched. A null ``at`` is a day of its own (null), whose
    rows come first in any sort; a null ``key`` counts as an empty text. Repeated
    rows all stay. A table without rows leaves an empty folder.
    """
    spark, folder, n = rows.sparkSession, f"{scratch.base}/files", rows.count()
    share = lambda x: 1 + n // x
    own, back = renamed(rows)
    own = own.withColumn("day", day_of(back[at]))
    # fewer than `lots` days are that large
    large = own.groupBy("day").agg(F.count("*").alias("r")).where(F.col("r") >= share(lots)).collect()
    known = spark.createDataFrame([(r["day"], 1 + r["r"] // share(lots)) for r in large], "large int, lots int")
    h = F.crc32(F.coalesce(F.col(back[key]).cast("string"), F.lit("")).cast("binary"))
    own = own.join(F.broadcast(known), F.col("day").eqNullSafe(F.col("large")), "left").withColumns({
        "lot": F.pmod(F.floor(h / 16), F.coalesce("lots", F.lit(1))).cast("int"),
        "piece": F.least(F.pmod(h, F.lit(4)), F.pmod(F.floor(h / 4), F.lit(4))).cast("int"),
    })
    files = own.groupBy(*KEYS).agg(F.count("*").alias("n"))
    plan = scratch.keep(files.groupBy("day").applyInArrow(_plan(share(small), share(most)), "day int, lot int, piece int, to_lot int, to_piece int, place int, files int"), "plan")
    # files that stay and files to be replaced differ in their first folder
    to = plan.where("files > 1").select(*_source())
    marked = own.join(to.withColumn("small", F.lit(1)), _at(), "left").withColumn("small", F.coalesce("small", F.lit(0)))
    names = _folders(rows.columns)
    _write(marked, back, names, ["small", *KEYS], [back[at], back[key]], folder)
    if n and not to.isEmpty():
        _merge(rows, plan, folder, names)
    return Compacted(folder, plan)


def _write(df: DataFrame, back: dict[str, str], names: dict[str, str], by: list[str], sort: list[str], folder: str) -> None:
    """One file for each value of ``by``, its rows sorted, under the table's own names."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(parts, *by).sortWithinPartitions(*by, *sort).select(*back.values(), *by)
    dealt.toDF(*back, *(names[k] for k in by)).write.partitionBy(*(names[k] for k in by)).parquet(folder)


def _merge(rows: DataFrame, plan: DataFrame, folder: str, names: dict[str, str]) -> None:
    """Replace each group's files by one file of their rows in joining order."""
    spark, small = rows.sparkSession, f"{folder}/{names['small']}"
    schema = T.StructType([*rows.schema.fields, *(T.StructField(names[k], T.IntegerType()) for k in KEYS)])
    old = spark.read.schema(schema).option("basePath", f"{small}=1").parquet(f"{small}=1")
    _, back = renamed(rows)
    old = old.select(*named({k: f"`{c}`" for c, k in back.items()}), *(F.col(names[k]).alias(k) for k in KEYS), old.metadataColumn("_metadata")["row_index"].alias("row"))
    to = plan.where("files > 1").select(*_source(), "to_lot", "to_piece", "place")
    out = old.join(to, _at()).select(*back.values(), "day", F.col("to_lot").alias("lot"), F.col("to_piece").alias("piece"), "place", "row")
    _write(out, back, names, list(KEYS), ["place", "row"], f"{small}=2")
    _delete(spark, f"{small}=1")


DIGEST = "path string, n_rows long, min_key long, max_key long, cents long, ids_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in file order (path, key, value) -> a row for each file; of a file
    only running values and the hash's state are held."""
    path, state = None, None

    def done():
        p, n, lo, hi, cents, sha = path, *state
        return pa.RecordBatch.from_pylist([{"path": p, "n_rows": n, "min_key": lo, "max_key": hi, "cents": cents, "ids_sha256": sha.hexdigest()}], schema=pa.schema([("path", pa.string()), ("n_rows", pa.int64()), ("min_key", pa.int64()), ("max_key", pa.int64()), ("cents", pa.int64()), ("ids_sha256", pa.string())]))

    for b in batches:
        runs = pc.run_end_encode(b.column("path")) if b.num_rows else None
        start = 0
        for p, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()) if runs is not None else ():
            if p != path:
                if state:
                    yield done()
                path, state = p, [0, None, None, 0, hashlib.sha256()]
            ids, value = b.column("key").slice(start, end - start), b.column("value").slice(start, end - start)
            v = value.drop_null().to_numpy(zero_copy_only=False)
            v = v[np.isfinite(v)]
            both = pc.min_max(ids).as_py()
            text = ",".join("" if i is None else str(i) for i in ids.to_pylist())
            state[4].update((("," if state[0] else "") + text).encode())
            state[0] += end - start
            if both["min"] is not None:
                state[1] = both["min"] if state[1] is None else min(state[1], both["min"])
                state[2] = both["max"] if state[2] is None else max(state[2], both["max"])
            state[3] += int(np.floor(100 * v + 0.5).sum()) if len(v) else 0
            start = end
    if state:
        yield done()


def report(done: Compacted, spark: SparkSession, key: str = "click_id", value: str = "value") -> DataFrame:
    """One row per final file, read back from the folder: day, lot and piece of
    its first source, n_rows, min_key, max_key, cents (floor(100 * value + 0.5)
    summed; null and non-finite values count 0), sources in joining order,
    ids_sha256 over the keys in file order (null: empty), columns, path and
    rewritten. A folder without files gives no rows."""
    schema = "day int, lot int, piece int, sources string, rewritten boolean"
    groups = done.plan.groupBy("day", F.col("to_lot").alias("lot"), F.col("to_piece").alias("piece")).agg(F.sort_array(F.collect_list(F.struct("place", F.concat_ws("-", "lot", "piece").alias("s")))).alias("s"), (F.max("files") > 1).alias("rewritten"))
    groups = groups.select("day", "lot", "piece", F.array_join("s.s", ",").alias("sources"), "rewritten")
    if groups.isEmpty():
        return spark.createDataFrame([], f"{schema}, {DIGEST}, columns string")
    read = spark.read.option("recursiveFileLookup", "true").parquet(done.folder)
    columns = ",".join(read.columns)
    file = read.metadataColumn("_metadata")
    at = read.select(file["file_path"].alias("path"), file["row_index"].alias("row"), F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{value}`").cast("double").alias("value"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = at.repartition(parts, "path").sortWithinPartitions("path", "row").select("path", "key", "value").mapInArrow(_digest, DIGEST)
    part = lambda i: F.regexp_extract("path", r"/\w+=\d/\w+=([^/]+)/\w+=(\d+)/\w+=(\d+)/[^/]+$", i)
    found = found.select("*", part(1).try_cast("int").alias("day"), part(2).cast("int").alias("lot"), part(3).cast("int").alias("piece"))
    out = found.join(groups.withColumnsRenamed(dict(zip(KEYS, ("d_", "l_", "p_")))), _at())
    return out.select("day", "lot", "piece", "sources", "rewritten", *(x.split()[0] for x in DIGEST.split(", ")), F.lit(columns).alias("columns"))
