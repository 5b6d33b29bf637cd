"""Mixing sources to target weights: a min-cost flow over membership patterns, then a seeded choice of documents."""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.prefix import prefix_sums
from quillgraph.session import materialize

# Fixed value: how this public vocabulary cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str, tokenizer: str) -> DataFrame:
    """``df`` with ``n_tokens`` instead of the text; null texts have none."""
    kept = [c for c in df.columns if c != text]
    src = df.select(*kept, text)
    schema = ", ".join(f"`{n}` {k}" for n, k in src.dtypes[:-1]) + ", n_tokens long"

    def run(batches):
        enc = _encoder(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    return src.mapInArrow(run, schema)


@dataclass
class Flow:
    """A small min-cost flow, by shortest augmenting paths with potentials."""

    edges: list[list[int]] = field(default_factory=list)  # to, capacity left, cost
    out: dict[object, list[int]] = field(default_factory=dict)

    def add(self, a, b, capacity: int, cost: int) -> int:
        self.out.setdefault(a, []).append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out.setdefault(b, []).append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, source, sink) -> int:
        """Send as much as possible, as cheaply as possible."""
        potential = dict.fromkeys(self.out, 0)
        sent = 0
        while True:
            dist, via = {source: 0}, {}
            heap, tie = [(0, 0, source)], 0
            while heap:
                d, _, v = heapq.heappop(heap)
                if d > dist[v]:
                    continue
                for k in self.out[v]:
                    w, left, cost = self.edges[k]
                    nd = d + cost + potential[v] - potential[w]
                    if left > 0 and nd < dist.get(w, 1 << 62):
                        dist[w], via[w] = nd, k
                        tie += 1
                        heapq.heappush(heap, (nd, tie, w))
            if sink not in dist:
                return sent
            for v in potential:
                potential[v] += dist.get(v, dist[sink])
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.edges[via[v] ^ 1][0]
            amount = min(self.edges[k][1] for k in path)
            for k in path:
                self.edges[k][1] -= amount
                self.edges[k ^ 1][1] += amount
            sent += amount


def route(capacity: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[int, dict]:
    """Tokens of each pattern (the sources that hold a text) to each source, by copy: {(pattern, copy, source): tokens}.

    ``capacity``: tokens of the texts of a pattern; ``targets``: share and most repeats of a source. The k-th copy of a token
    costs k - 1, so repeats are as few and as even as possible; copy k is open to sources that may repeat so often. The
    size is ``total``, or the largest at which every quota can be filled.
    """
    whole = sum(s for s, _ in targets.values())
    live = {s: (share / whole, r) for s, (share, r) in targets.items() if share > 0 and r > 0}

    def attempt(size: int) -> tuple[bool, Flow, dict]:
        f, marks, need = Flow(), {}, 0
        for s, (share, _) in live.items():
            q = int(share * size)
            need += q
            f.add(("source", s), "sink", q, 0)
        for p, n in capacity.items():
            own = [s for s in p if s in live]
            for k in range(1, max((live[s][1] for s in own), default=0) + 1):
                f.add("start", (p, k), n, k - 1)
                for s in own:
                    if k <= live[s][1]:
                        marks[p, k, s] = f.add((p, k), ("source", s), n, 0)
        f.out.setdefault("start", [])
        f.out.setdefault("sink", [])
        return f.run("start", "sink") == need, f, marks

    if total is None:
        lo, hi = 0, sum(n * max((live[s][1] for s in p if s in live), default=0) for p, n in capacity.items())
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if attempt(mid)[0] else (lo, mid - 1)
        total = lo
    _, f, marks = attempt(total)
    return total, {k: f.edges[e ^ 1][1] for k, e in marks.items() if f.edges[e ^ 1][1] > 0}


def by_text(docs: DataFrame) -> DataFrame:
    """(key, pattern, ids, n_tokens) of documents (doc_id, source, key, n_tokens), each of them in one row.

    The least document of a text in each source stand together in one row, whose pattern is these sources: they are what the sources
    have in common. Every further document of that text in a source is a row of its own, of that source only. So a row has at most one
    document of a source, however many copies of a text there are, and none is lost.
    """
    first = docs.groupBy("key", "source").agg(F.min(F.struct("doc_id", "n_tokens")).alias("x"))
    ids = F.map_from_entries(F.collect_list(F.struct("source", F.col("x.doc_id")))).alias("ids")
    shared = first.groupBy("key").agg(F.sort_array(F.collect_set("source")).alias("pattern"), ids, F.max("x.n_tokens").alias("n_tokens"))
    more = docs.join(first.select("key", "source", F.col("x.doc_id").alias("doc_id")), ["key", "source", "doc_id"], "left_anti")
    own = more.select(F.concat("key", F.lit("/"), F.col("doc_id").cast("string")).alias("key"), F.array("source").alias("pattern"), F.create_map("source", "doc_id").alias("ids"), "n_tokens")
    return shared.unionByName(own)


def mix(docs: DataFrame, targets: DataFrame, *, tokenizer: str, total: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The sample (doc_id, source, copies, n_tokens) and a report per source; ``tokenizer`` is the path of a vocabulary file.

    Documents with the same text belong to all target sources that hold it (the pattern, see :func:`by_text`). The few
    patterns (at most 2^sources, checked) are summed up, the flow is solved on the driver, and the rows of a pattern are laid out in the
    order of a seeded hash; each source takes the rows whose middle token lies in its stretch, separately for each copy. So shares
    are met up to one document per stretch, and no document is taken more often than its source allows. All documents can be taken, also
    those whose text another one has.

    Repeated ids count once: of several rows of a ``doc_id`` with different sources or texts the one of the least (source, hash of the text)
    is the document. Null ids, texts or sources and unknown sources are left out, as are empty texts (no tokens); targets without
    documents can't be filled: the sample is empty if any such target has a share, unless ``total`` is given, which is filled as far as possible.
    """
    goal = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").collect()}
    if len(goal) > 4096:
        raise ValueError("too many sources for patterns")
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("source").isin(list(goal)))
    # Tokens are counted where the texts are read: no text is shuffled, only its hash and size.
    keyed = with_token_counts(usable.select("doc_id", "source", F.md5("text").alias("key"), "text"), "text", tokenizer).where(F.col("n_tokens") > 0)
    one = materialize(keyed.groupBy("doc_id").agg(F.min(F.struct("source", "key", "n_tokens")).alias("x")).select("doc_id", "x.*"))
    sized = materialize(by_text(one))
    groups = sized.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).limit(100_001).collect()
    if len(groups) > 100_000:
        raise ValueError("more than 100000 membership patterns")
    size, ways = route({tuple(r.pattern): r.n for r in groups}, goal, total)
    stretches, at = [], {}
    for (p, k, s), n in sorted(ways.items()):
        a = at.get((p, k), 0)
        stretches.append((list(p), k, s, a, a + n))
        at[p, k] = a + n
    spark = docs.sparkSession
    plan = spark.createDataFrame(stretches, "pattern array<string>, copy int, source string, a long, z long")
    order = sized.withColumn("place", F.concat(F.xxhash64("key", F.lit(seed)).cast("string"), "key")).withColumn("group", F.array_join("pattern", "\u0001"))
    laid = prefix_sums(order, "group", [F.col("place")], "n_tokens", "begin").withColumn("middle", F.col("begin") + F.col("n_tokens") / 2)
    taken = laid.join(F.broadcast(plan.withColumn("group", F.array_join("pattern", "\u0001")).drop("pattern")), "group").where((F.col("middle") >= F.col("a")) & (F.col("middle") < F.col("z")))
    sample = taken.groupBy(F.col("ids")[F.col("source")].alias("doc_id"), "source", "n_tokens").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    sample = materialize(sample.select("doc_id", "source", "copies", "n_tokens"))
    real = sample.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    whole = real.agg(F.sum("tokens")).first()[0] or 0
    own = targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").join(F.broadcast(real), "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    report = own.select(
        "source", "target_share", "max_repeats", (tokens / F.lit(max(whole, 1))).alias("actual_share"), tokens.alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.lit(size).cast("long").alias("planned_tokens"),
    )
    return sample, report
