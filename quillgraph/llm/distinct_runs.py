"""Distinct counts over huge identifier sets: sorted 64-bit hash runs, delta-coded, merged by k-way union.

An identifier is represented by its 64-bit hash. The hash space is cut into 2^bits equal buckets; a *run* holds the
sorted hashes of one bucket with the group (one value per dimension) each was seen in. Runs are the mergeable partial
results: a run of any part of the data, built at any time, can be merged with any other. As no hash is in two
buckets, the numbers of distinct hashes of a group add up over buckets, so no task ever holds more than a bucket.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import materialize, parallelism

#: Rows that are turned into runs at once.
CHUNK_ROWS = 400_000
#: Entries a bucket should hold at most.
BUCKET_ENTRIES = 1_500_000
#: Entries below which a bucket isn't worth a task of its own.
FEW_ENTRIES = 50_000
#: Entries of one identifier in a chunk from which its entries are first united by group, in SPREAD parts.
HEAVY_ENTRIES = 4_000
SPREAD = 64
TWO_64 = 2.0**64


def encode_run(sorted_values: np.ndarray) -> bytes:
    """Sorted uint64 values as the differences of neighbours, 7 bits a byte, the high bit set on all but the last."""
    if not len(sorted_values):
        return b""
    d = np.diff(sorted_values, prepend=np.uint64(0))
    size = np.ones(len(d), np.int64)
    for k in range(1, 10):
        size += d >= np.uint64(1 << (7 * k))
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max())):
        on = size > k
        piece = ((d[on] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[start[on] + k] = piece | np.where(size[on] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def decode_run(data: bytes) -> np.ndarray:
    """Inverse of :func:`encode_run`."""
    b = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(b < 128)
    start = np.r_[0, end[:-1] + 1] if len(end) else end
    size = end - start + 1
    d = np.zeros(len(end), np.uint64)
    for k in range(int(size.max()) if len(end) else 0):
        on = size > k
        d[on] |= (b[start[on] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return np.cumsum(d, dtype=np.uint64)


def _width(n: int) -> type:
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32


def _pack(h: np.ndarray, codes: list[np.ndarray], values: list[np.ndarray]) -> dict:
    """A run of entries sorted by (hash, codes): only the values that occur, and codes of the least width."""
    row: dict = {"n": len(h), "run": encode_run(h)}
    for i, (c, v) in enumerate(zip(codes, values)):
        used, local = np.unique(c, return_inverse=True)
        row[f"v{i}"] = v[used].tolist()
        row[f"c{i}"] = local.astype(_width(len(used))).tobytes()
    return row


def _unpack(rows: list[dict], dims: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Entries of several runs, their codes turned into codes of common values."""
    hashes, codes, values = [], [[] for _ in range(dims)], [{} for _ in range(dims)]
    for r in rows:
        hashes.append(decode_run(r["run"]))
        for i in range(dims):
            v = r[f"v{i}"]
            to = np.array([values[i].setdefault(x, len(values[i])) for x in v], np.int64)
            codes[i].append(to[np.frombuffer(r[f"c{i}"], _width(len(v)))])
    h = np.concatenate(hashes) if hashes else np.array([], np.uint64)
    return h, [np.concatenate(c) if c else np.array([], np.int64) for c in codes], [np.array([*v, None], object)[:-1] for v in values]


def _union(h: np.ndarray, codes: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, group) entries in the order of hashes, and the group as one number.

    The concatenated runs are sorted by a merge sort that finds the sorted runs and merges them.
    """
    group = np.zeros(len(h), np.int64)
    for c, v in zip(codes, values):
        group = group * max(1, len(v)) + c
    by_hash = np.argsort(h, kind="stable")
    h, group = h[by_hash], group[by_hash]
    rank = np.cumsum(np.r_[False, h[1:] != h[:-1]]) if len(h) else np.array([], np.int64)
    wide, g = np.unique(group, return_inverse=True)
    key = np.unique(rank * max(1, len(wide)) + g)
    first = np.r_[True, rank[1:] != rank[:-1]] if len(h) else np.array([], bool)
    return h[first][key // max(1, len(wide))], wide[key % max(1, len(wide))]


def _split(group: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Codes per dimension of the numbers made by :func:`_union`."""
    out: list = []
    for v in reversed(values):
        out.append(group % max(1, len(v)))
        group = group // max(1, len(v))
    return out[::-1]


def _schema(dims: int) -> str:
    return "member string, bits int, bucket int, part int, n long, run binary, " + ", ".join(f"v{i} array<string>, c{i} binary" for i in range(dims))


def _rows(rows: list[dict], dims: int) -> pa.Table:
    kinds = [("member", pa.string()), ("bits", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("run", pa.binary())]
    kinds += [x for i in range(dims) for x in ((f"v{i}", pa.list_(pa.string())), (f"c{i}", pa.binary()))]
    return pa.Table.from_pylist(rows, pa.schema(kinds))


def _chunk_runs(t: pa.Table, members: list[str], dims: int, bits: int) -> pa.Table:
    codes, values = [], []
    for i in range(dims):
        enc = t.column(f"d{i}").combine_chunks().dictionary_encode(null_encoding="encode")
        enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
        codes.append(enc.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        values.append(np.array([*enc.dictionary.to_pylist(), None], object)[:-1])
    rows = []
    for m in members:
        col = t.column(m).combine_chunks()
        on = col.is_valid().to_numpy(zero_copy_only=False)
        raw = col.fill_null(0).to_numpy(zero_copy_only=False)[on].view(np.uint64)
        h, group = _union(raw, [c[on] for c in codes], values)
        per = _split(group, values)
        part = np.full(len(h), -1, np.int64)
        if len(h):
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            many = np.diff(np.r_[first, len(h)])
            heavy = np.repeat(many >= HEAVY_ENTRIES, many)
            if heavy.any():
                spread = [np.array([hash_text(x) for x in v], np.int64) for v in values]
                mix = np.zeros(int(heavy.sum()), np.int64)
                for c, s in zip(per, spread):
                    mix = mix * 31 + s[c[heavy]]
                part[heavy] = mix % SPREAD
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        cell = bucket * (SPREAD + 1) + part + 1
        order = np.argsort(cell, kind="stable")
        edges = np.r_[np.flatnonzero(np.diff(cell[order], prepend=-1)), len(h)]
        for a, z in itertools.pairwise(edges):
            own = order[a:z]
            rows.append({"member": m, "bits": bits, "bucket": int(bucket[own[0]]), "part": int(part[own[0]])} | _pack(h[own], [c[own] for c in per], values))
    return _rows(rows, dims)


def hash_text(x: str | None) -> int:
    """A small hash of a text that is the same in all processes."""
    import zlib

    return zlib.crc32(b"\0" if x is None else x.encode())


def build_runs(df: DataFrame, dims: list[Column], members: dict[str, Column], bits: int) -> DataFrame:
    """Runs of ``df``: (member, bits, bucket, part, n, run, v0, c0, ...), some per chunk of rows read.

    No shuffle. A null dimension is a group of its own; a null identifier is none.
    """
    cols = [d.cast("string").alias(f"d{i}") for i, d in enumerate(dims)]
    src = df.select(*cols, *[F.when(c.isNotNull(), F.xxhash64(c)).alias(m) for m, c in members.items()])
    names, k = list(members), len(dims)

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK_ROWS:
                yield from _chunk_runs(pa.Table.from_batches(held), names, k, bits).to_batches()
                held, n = [], 0
        if n:
            yield from _chunk_runs(pa.Table.from_batches(held), names, k, bits).to_batches()

    return src.mapInArrow(run, _schema(k))


def _dims(state: DataFrame) -> int:
    return sum(c.startswith("c") for c in state.columns)


def _unite(t: pa.Table, k: int) -> pa.Table:
    rows = t.to_pylist()
    h, codes, values = _unpack(rows, k)
    h, group = _union(h, codes, values)
    one = {x: rows[0][x] for x in ("member", "bits", "bucket")} | {"part": -1}
    return _rows([one | _pack(h, _split(group, values), values)], k)


def united(state: DataFrame) -> DataFrame:
    """First the entries of heavy identifiers alone, spread by group, so that what is left of one is a row per group."""
    k = _dims(state)
    heavy = state.where(F.col("part") >= 0).groupBy("member", "bucket", "part").applyInArrow(lambda t: _unite(t, k), _schema(k))
    return state.where(F.col("part") < 0).unionByName(heavy)


def _split_run(r: dict, dims: int, bits: int) -> list[dict]:
    """A run cut at the borders of finer buckets; its hashes are sorted, so each piece is a stretch of it."""
    h = decode_run(r["run"])
    codes = [np.frombuffer(r[f"c{i}"], _width(len(r[f"v{i}"]))) for i in range(dims)]
    values = [np.array([*r[f"v{i}"], None], object)[:-1] for i in range(dims)]
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.r_[np.flatnonzero(np.diff(bucket, prepend=-1)), len(h)]
    return [
        {"member": r["member"], "bits": bits, "bucket": int(bucket[a]), "part": r["part"]} | _pack(h[a:z], [c[a:z] for c in codes], values)
        for a, z in itertools.pairwise(edges)
    ]


def rebucket(state: DataFrame, bits: int) -> DataFrame:
    """The same entries in 2^bits buckets: finer runs are only renamed, coarser ones cut at the borders."""
    k = _dims(state)
    fine = state.where(F.col("bits") >= bits).withColumn("bucket", F.expr(f"shiftright(bucket, bits - {int(bits)})")).withColumn("bits", F.lit(bits).cast("int"))

    def cut(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from _rows(_split_run(b.slice(i, 1).to_pylist()[0], k, bits), k).to_batches()

    return fine.unionByName(state.where(F.col("bits") < bits).mapInArrow(cut, _schema(k)))


def merge_runs(*states: DataFrame) -> DataFrame:
    """One state of several, with one run per identifier column and bucket.

    The buckets are as many as the entries of all states together need, however few each state had: so many small loads
    merge into buckets that a task can hold.
    """
    k = _dims(states[0])
    if len({_dims(s) for s in states}) > 1:
        raise ValueError("the states differ in dimensions")
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    most = both.groupBy("member").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    both = rebucket(both, bucket_bits(most, parallelism(both.sparkSession)))
    return united(both).groupBy("member", "bucket").applyInArrow(lambda t: _unite(t, k), _schema(k))


def _count_sets(t: pa.Table, k: int) -> pa.Table:
    """Distinct hashes of a bucket per group of every subset of the dimensions."""
    h, codes, values = _unpack(t.to_pylist(), k)
    member = t.column("member")[0].as_py()
    h, group = _union(h, codes, values)
    codes = _split(group, values)
    rank = np.cumsum(np.r_[False, h[1:] != h[:-1]]) if len(h) else np.array([], np.int64)
    n = int(rank[-1]) + 1 if len(rank) else 0
    out = []
    for mask in range(1 << k):
        on = [i for i in range(k) if mask >> i & 1]
        g = np.zeros(len(h), np.int64)
        for i in on:
            g = g * max(1, len(values[i])) + codes[i]
        wide, local = np.unique(g, return_inverse=True)
        seen = np.unique(local * max(1, n) + rank) // max(1, n)
        counts = np.bincount(seen, minlength=len(wide))
        cols: dict = {"grouped_by": pa.array(np.full(len(wide), mask, np.int32)), "member": pa.array([member] * len(wide), pa.string())}
        for i in reversed(on):
            cols[f"d{i}"] = pa.array(values[i][wide % max(1, len(values[i]))], pa.string())
            wide = wide // max(1, len(values[i]))
        for i in range(k):
            cols.setdefault(f"d{i}", pa.nulls(len(counts), pa.string()))
        out.append(pa.table({"grouped_by": cols["grouped_by"], "member": cols["member"], **{f"d{i}": cols[f"d{i}"] for i in range(k)}, "n": pa.array(counts, pa.int64())}))
    return pa.concat_tables(out)


def count_distinct(state: DataFrame, members: list[str]) -> DataFrame:
    """(grouped_by, d0, ..., n_<member>, collisions_<member>, ...) for every combination of the dimensions.

    ``grouped_by`` has bit i set if dimension i is one of the group's; the others are null. ``collisions_<member>`` is
    n (n - 1) / 2^65: the expected number of identifiers missed because their hash is another's, and an upper bound of
    the probability that the number isn't exact. Groups without any identifier don't appear.
    """
    k = _dims(state)
    schema = "grouped_by int, member string, " + ", ".join(f"d{i} string" for i in range(k)) + ", n long"
    per = united(state).groupBy("member", "bucket").applyInArrow(lambda t: _count_sets(t, k), schema)
    keys = ["grouped_by", *[f"d{i}" for i in range(k)]]
    total = per.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("member") == m, F.col("n"))), F.lit(0)).alias(f"n_{m}") for m in members])
    wrong = {f"collisions_{m}": F.col(f"n_{m}").cast("double") * (F.col(f"n_{m}") - 1).cast("double") / 2.0 / TWO_64 for m in members}
    return total.withColumns({k: F.when(F.col(k.replace("collisions", "n")) > 0, v).otherwise(0.0) for k, v in wrong.items()})


def bucket_bits(rows: int, tasks: int = 8) -> int:
    """Bits of the hash that name the bucket, for an input of so many rows.

    No bucket gets more than BUCKET_ENTRIES of them, and there are as many buckets as tasks unless they would have fewer than FEW_ENTRIES.
    """
    buckets = max(rows / BUCKET_ENTRIES, min(tasks, rows / FEW_ENTRIES), 8)
    return math.ceil(math.log2(buckets))


def distinct_counts(df: DataFrame, dims: dict[str, Column], members: dict[str, Column], parts: Column | None = None) -> DataFrame:
    """Distinct identifiers per group, for every combination of the dimensions ``dims``.

    With ``parts`` (a boolean column) the rows with true and the others are stored as two partial states, which are
    then merged; the result is the same. Every null dimension value is a group; null identifiers don't count; repeated
    rows change nothing; texts are hashed whole; an empty input gives an empty result. Only the columns named are
    read. See :func:`count_distinct` for the result.
    """
    bits = bucket_bits(df.count(), parallelism(df.sparkSession))
    if parts is None:
        state = materialize(build_runs(df, list(dims.values()), members, bits))
    else:
        on = F.coalesce(parts, F.lit(False))
        state = materialize(merge_runs(*[materialize(build_runs(df.where(x), list(dims.values()), members, bits)) for x in (on, ~on)]))
    return count_distinct(state, list(members)).withColumnsRenamed({f"d{i}": name for i, name in enumerate(dims)})
