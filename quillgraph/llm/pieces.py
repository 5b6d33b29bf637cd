"""Splitting oversized items at natural boundaries, with overlap.

An entry is a byte range of a file and consists of whole lines. Its lines are packed into blocks of BLOCK bytes, so
an entry of any size is spread over tasks. Where a piece starts depends on the one before, so each block is walked
from every state in which a walk can enter it (a few dozen; most walks join another after a few pieces), the blocks'
maps from entering to leaving state are composed, and then each block emits its pieces. Blocks are composed in stretches of
STRETCH, and then the stretches, so that no task sees all blocks of an entry. A block learns of its neighbours by messages to the
blocks beside it, not by a window over the entry.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.hierarchy import lookup
from quillgraph.operators.prefix import prefix_sums
from quillgraph.session import materialize, parallelism

LIMIT = 4096
OVERLAP = 256
BLOCK = 1 << 20
#: Blocks whose maps one task composes.
STRETCH = 4096


def assign_lines(entries: DataFrame, lines: DataFrame, block: int, long: int) -> DataFrame:
    """(entry_id, block, b, e, text): each line's bytes b to e (after its LF) in the splittable entry it belongs to.

    ``entries``: (entry_id, file_id, file_size, file_start, splittable), ``lines``: (file_id, line_no, byte_start, line). The
    join is on (file, block), so a file that holds most lines is spread like any other. Text is kept only of lines of
    more than ``long`` bytes, which may have to be cut.
    """
    one = entries.where(F.col("splittable") & F.col("entry_id").isNotNull() & F.col("file_start").isNotNull()).groupBy("entry_id").agg(
        *[F.min(c).alias(c) for c in ("file_id", "file_start", "file_size")]
    )
    own = lines.where(F.col("line").isNotNull() & F.col("byte_start").isNotNull()).select("file_id", F.col("byte_start").alias("b"), (F.col("byte_start") + F.octet_length("line") + 1).alias("e"),
                     F.when(F.octet_length("line") >= long, F.encode("line", "UTF-8")).alias("text"))
    last = lines.groupBy("file_id").agg(F.max("byte_start").alias("last"))
    spans = one.join(last, "file_id").withColumn("to", F.least(F.coalesce(F.col("file_start") + F.col("file_size"), F.col("last")), F.col("last")))
    spans = spans.where(F.col("to") >= F.col("file_start"))
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("file_start") / block), F.floor(F.col("to") / block))))
    placed = own.withColumn("block", F.floor(F.col("b") / block)).join(spans.select("file_id", "block", "entry_id", "file_start", "to"), ["file_id", "block"])
    inside = ((F.col("b") > F.col("file_start")) & (F.col("b") <= F.col("to"))) | ((F.col("b") == 0) & (F.col("file_start") == 0))
    return placed.where(inside).select("entry_id", "block", "b", "e", "text")


_PACKED = "entry_id long, block long, first long, last long, n_bytes long, starts binary, ends binary, long_at array<long>, long_text array<binary>, head_b array<long>, head_e array<long>, head_long_at array<long>, head_long_text array<binary>, tail array<long>"


def _pack(entry: int, block: int, b: np.ndarray, e: np.ndarray, text: list, limit: int, overlap: int) -> dict:
    long_at = [i for i in range(len(b)) if e[i] - b[i] > limit - overlap - 8]
    head = int(np.searchsorted(b, b[0] + limit, side="right"))
    tail = b[np.searchsorted(b, e[-1] - overlap) :]
    return {
        "entry_id": entry, "block": block, "first": int(b[0]), "last": int(e[-1]), "n_bytes": int((e - b).sum()),
        "starts": b.astype(np.int64).tobytes(), "ends": e.astype(np.int64).tobytes(), "long_at": [int(b[i]) for i in long_at], "long_text": [text[i] for i in long_at],
        "head_b": b[:head].tolist(), "head_e": e[:head].tolist(), "head_long_at": [int(b[i]) for i in long_at if i < head], "head_long_text": [text[i][: limit + 8] for i in long_at if i < head], "tail": tail.tolist(),
    }


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in ddl.split(","))])


def _in_rows(ddl: str, rows, at_once: int = 64):
    """Rows of a generator as Arrow batches."""
    schema, held = _schema(ddl), []
    for r in rows:
        held.append(r)
        if len(held) >= at_once:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def pack_blocks(placed: DataFrame, limit: int, overlap: int) -> DataFrame:
    """One row per (entry, block) with the starts and ends of its lines; see _PACKED.

    Repeated lines lie next to each other here and are dropped; of different lines at one place the shortest remains.
    """
    rows = placed.repartition(parallelism(placed.sparkSession), "entry_id", "block").sortWithinPartitions("entry_id", "block", "b", "e")

    def packed(key: tuple[int, int], b: list, e: list, text: list) -> dict:
        starts, ends = np.concatenate(b), np.concatenate(e)
        first = np.r_[True, starts[1:] != starts[:-1]]
        return _pack(*key, starts[first], ends[first], [t for t, on in zip(text, first) if on], limit, overlap)

    def run(batches):
        def groups():
            key, b, e, text = None, [], [], []
            for batch in batches:
                ent, blk, bs, es = (batch.column(i).to_numpy() for i in range(4))
                texts = batch.column(4)
                edge = np.flatnonzero((np.diff(ent, prepend=-1) != 0) | (np.diff(blk, prepend=-1) != 0) | (np.arange(len(ent)) == 0))
                for a, z in zip(edge, np.r_[edge[1:], len(ent)]):
                    k = (int(ent[a]), int(blk[a]))
                    if k != key:
                        if key is not None:
                            yield packed(key, b, e, text)
                        key, b, e, text = k, [], [], []
                    b.append(bs[a:z])
                    e.append(es[a:z])
                    text += texts.slice(a, z - a).to_pylist()
            if key is not None:
                yield packed(key, b, e, text)

        yield from _in_rows(_PACKED, groups())

    return rows.mapInArrow(run, _PACKED)


class Walk:
    """The pieces of a block: ``step`` goes from one piece to the next.

    A state is (start of a piece, end of the piece before). ``bounds`` are the line ends known: those of the block and
    of the lines up to ``limit`` bytes after it.
    """

    def __init__(self, r: dict, limit: int, overlap: int) -> None:
        self.limit, self.overlap, self.end = limit, overlap, r["end"]
        self.starts = np.frombuffer(r["starts"], np.int64).tolist()
        self.next_first = r["next_first"]
        self.lines = dict(zip(r["long_at"] or [], r["long_text"] or []))
        ends = np.frombuffer(r["ends"], np.int64).tolist()
        starts = list(self.starts)
        for b, e in ((r["h1b"], r["h1e"]), (r["h2b"], r["h2e"])):
            if b is not None:
                starts += b
                ends += e
        for at, texts in ((r["h1at"], r["h1text"]), (r["h2at"], r["h2text"])):
            for b, text in zip(at or [], texts or []):
                self.lines.setdefault(b, text)
        self.line_starts, self.bounds = starts, ends
        self.memo: dict = {}

    @classmethod
    def of(cls, starts: list[int], text: dict[int, bytes]) -> Walk:
        """Only what :meth:`char_start` needs."""
        own = cls.__new__(cls)
        own.line_starts, own.lines = starts, text
        return own

    def char_start(self, at: int) -> int:
        """``at``, moved back to the start of the character it is in."""
        i = bisect_right(self.line_starts, at) - 1
        b = self.line_starts[i]
        text = self.lines.get(b)
        while text is not None and at > b and at - b < len(text) and text[at - b] & 0xC0 == 0x80:
            at -= 1
        return at

    def cut(self, start: int, before: int) -> tuple[int, bool]:
        """End of the piece that starts at ``start``, and whether it is a line end."""
        if self.end <= start + self.limit:
            return self.end, True
        i = bisect_right(self.bounds, start + self.limit) - 1
        if i >= 0 and self.bounds[i] > max(before, start):
            return self.bounds[i], True
        return self.char_start(start + self.limit), False

    def step(self, start: int, before: int) -> tuple[int, tuple[int, int] | None]:
        """End of the piece, and the state of the next one if it isn't the last."""
        end, at_line = self.cut(start, before)
        if end >= self.end:
            return end, None
        if not at_line:
            return end, (max(self.char_start(end - self.overlap), start + 1), end)
        i = bisect_left(self.line_starts, max(start + 1, end - self.overlap))
        return end, (self.line_starts[i] if i < len(self.line_starts) else end, end)

    def leaves(self, state: tuple[int, int]) -> bool:
        return self.next_first is not None and state[0] >= self.next_first

    def through(self, state: tuple[int, int]) -> tuple[tuple[int, int] | None, int]:
        """The state that leaves the block (None: the entry ends) and the number of pieces until then."""
        chain = []
        at: tuple[int, int] | None = state
        while at is not None and not self.leaves(at) and at not in self.memo:
            chain.append(at)
            at = self.step(*at)[1]
        out, n = self.memo[at] if at in self.memo else (at, 0)
        for x in reversed(chain):
            n += 1
            self.memo[x] = (out, n)
        return out, n

    def entering(self, tail: list[int]) -> list[tuple[int, int]]:
        """All states in which a walk can enter this block; ``tail``: line starts shortly before it."""
        first = self.starts[0]
        states = []
        for e in [x for x in self.line_starts if first <= x <= first + self.limit]:
            s = self.line_starts[bisect_left(self.line_starts, max(first, e - self.overlap))]
            states.append((s, e))
        for s in tail:
            if first - self.overlap <= s < first:
                end = self.char_start(s + self.limit)
                states.append((max(self.char_start(end - self.overlap), s + 1), end))
        return [x for x in dict.fromkeys(states) if x[0] >= first and x[1] < self.end and not self.leaves(x)]


_MAPS = "entry_id long, block long, seq long, first long, next_first long, start_b long, in_s array<long>, in_e array<long>, out_s array<long>, out_e array<long>, n array<long>"
_PIECES = "entry_id long, piece_no long, piece_start long, piece_end long"
_STARTS = "entry_id long, block long, s long, e long, number long"


def _with_context(packed: DataFrame, limit: int) -> DataFrame:
    """The blocks of entries of more than ``limit`` bytes, each with what its walk needs of its neighbours in the entry.

    Blocks are numbered within their entry by running sums, and each sends its first lines to the two blocks before and its last
    ones to the two after it. What is the same for a whole entry is looked up, also where one entry has most blocks.
    """
    whole = packed.groupBy("entry_id").agg(F.max("last").alias("end"), F.min("first").alias("start_b"), F.sum("n_bytes").alias("entry_bytes"))
    whole = materialize(whole.where((F.col("entry_bytes") > limit) & (F.col("end") - F.col("start_b") > limit)))
    slim = lookup(packed.select("entry_id", "block", F.lit(1).alias("one")), whole, "entry_id").where(F.col("end").isNotNull())
    ranked = materialize(prefix_sums(slim, "entry_id", [F.col("block")], "one", "seq").drop("one"))
    own = packed.join(ranked, ["entry_id", "block"])
    head = ["head_b", "head_e", "head_long_at", "head_long_text"]
    to = F.explode(F.array(*[F.lit(x).cast("long") for x in (-2, -1, 1, 2)])).alias("to")
    sent = own.select("entry_id", "seq", to, "first", "last", *head, "tail").select(
        "entry_id", (F.col("seq") + F.col("to")).alias("seq"), "to",
        *[F.when(F.col("to") < 0, F.col(c)).alias(c) for c in ("first", *head)], *[F.when(F.col("to") > 0, F.col(c)).alias(c) for c in ("tail", "last")],
    )
    got = lambda c, d: F.max(F.when(F.col("to") == d, F.col(c)))
    empty = F.array().cast("array<bigint>")
    near = sent.groupBy("entry_id", "seq").agg(
        got("first", -1).alias("next_first"), got("last", 1).alias("before_end"),
        *[got(c, d).alias(f"h{-d}{n}") for d in (-1, -2) for c, n in zip(head, ("b", "e", "at", "text"))],
        F.concat(F.coalesce(got("tail", 2), empty), F.coalesce(got("tail", 1), empty)).alias("before"),
    )
    return own.select("entry_id", "block", "seq", "first", "last", "starts", "ends", "long_at", "long_text", "end", "start_b", "entry_bytes").join(near, ["entry_id", "seq"], "left")


def _records(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def split_entries(entries: DataFrame, lines: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """(entry_id, piece_no, piece_start, piece_end): pieces of every splittable entry of more than ``limit`` bytes.

    A piece ends at the last line end within ``limit`` bytes beyond the previous piece's end, or where there is none at the last
    character within ``limit``; the next starts at the first line start after this piece's start that is at most ``overlap``
    bytes before its end, or exactly ``overlap`` before (moved back to a character) if the piece ended inside a line.

    Repeated rows count once; entries without id, start or lines, and not (or not known to be) splittable ones, give no
    pieces; a null size reaches to the end of the file; null lines are none; lines of any length are cut by characters. Only the
    named columns are read. ``block`` must be more than ``limit``.
    """
    if block <= 2 * limit or overlap >= limit - 8:
        raise ValueError("a block must hold two pieces, and a piece more than the overlap")
    packed = materialize(pack_blocks(assign_lines(entries, lines, block, limit - overlap - 8), limit, overlap))
    blocks = materialize(_with_context(packed, limit))

    def maps(batches):
        def rows():
            for r in _records(batches):
                walk = Walk(r, limit, overlap)
                states = [(r["start_b"], r["start_b"])] if r["first"] == r["start_b"] else walk.entering(r["before"] or [])
                outs = [walk.through(s) for s in states]
                yield {k: r[k] for k in ("entry_id", "block", "seq", "first", "next_first", "start_b")} | {
                    "in_s": [s for s, _ in states], "in_e": [e for _, e in states], "out_s": [o[0] if o else None for o, _ in outs], "out_e": [o[1] if o else None for o, _ in outs], "n": [n for _, n in outs],
                }

        yield from _in_rows(_MAPS, rows())

    def emit(batches):
        def rows():
            for r in _records(batches):
                walk = Walk(r, limit, overlap)
                state, number = (r["s"], r["e"]), r["number"]
                while state is not None and not walk.leaves(state):
                    end, after = walk.step(*state)
                    yield {"entry_id": r["entry_id"], "piece_no": number, "piece_start": state[0], "piece_end": end}
                    state, number = after, number + 1

        yield from _in_rows(_PIECES, rows(), 4096)

    starts = compose(materialize(blocks.mapInArrow(maps, _MAPS)))
    return blocks.join(starts, ["entry_id", "block"]).mapInArrow(emit, _PIECES)


def _follow(r: dict, state: tuple[int, int]) -> tuple[tuple[int, int] | None, int]:
    """The state in which a walk that enters a block in ``state`` leaves it (None: the entry ends), and its pieces until then."""
    if r["next_first"] is not None and state[0] >= r["next_first"]:
        return state, 0
    i = next((i for i, x in enumerate(zip(r["in_s"], r["in_e"])) if x == state), None)
    if i is None:
        raise RuntimeError(f"entry {r['entry_id']} enters block {r['block']} in a state that wasn't walked")
    return (None if r["out_s"][i] is None else (r["out_s"][i], r["out_e"][i])), r["n"][i]


def compose(ways: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(entry_id, block, s, e, number): the state in which the walk of its entry enters each block, and the number of its next piece.

    ``ways`` are the blocks' maps. Stretches of ``stretch`` blocks are composed to one map each, the maps of the stretches are
    followed from an entry's start (a row per stretch, so that few rows of even a huge entry meet in a task), and then the blocks of each stretch.
    """
    n = parallelism(ways.sparkSession)
    placed = ways.withColumn("stretch", F.floor(F.col("seq") / stretch))
    by_stretch = placed.repartition(n, "entry_id", "stretch").sortWithinPartitions("entry_id", "stretch", "seq")
    joined = "entry_id long, stretch long, start_b long, block long, next_first long, in_s array<long>, in_e array<long>, out_s array<long>, out_e array<long>, n array<long>"

    def groups(batches):
        key, held = None, []
        for r in _records(batches):
            if (r["entry_id"], r["stretch"]) != key:
                if held:
                    yield held
                key, held = (r["entry_id"], r["stretch"]), []
            held.append(r)
        if held:
            yield held

    def join_stretch(batches):
        def rows():
            for held in groups(batches):
                outs = []
                for state in zip(held[0]["in_s"], held[0]["in_e"]):
                    at, count = state, 0
                    for r in held:
                        at, more = _follow(r, at)
                        count += more
                        if at is None:
                            break
                    outs.append((at, count))
                yield {k: held[0][k] for k in ("entry_id", "stretch", "start_b", "block", "in_s", "in_e")} | {
                    "next_first": held[-1]["next_first"], "out_s": [o[0] if o else None for o, _ in outs], "out_e": [o[1] if o else None for o, _ in outs], "n": [c for _, c in outs],
                }

        yield from _in_rows(joined, rows())

    def through(batches, start: str | None):
        """The entering states of the rows of each entry, or of each stretch from the state given with it."""
        at, number, key = None, 1, None
        for r in _records(batches):
            own = (r["entry_id"], r["stretch"] if start else 0)
            if own != key:
                key = own
                at, number = ((r["s"], r["e"]), r["number"]) if start else ((r["start_b"], r["start_b"]), 1)
            if at is None:
                continue
            left, more = _follow(r, at)
            if more:
                yield {"entry_id": r["entry_id"], "block": r["stretch"] if start is None else r["block"], "s": at[0], "e": at[1], "number": number}
            elif start is None:
                yield {"entry_id": r["entry_id"], "block": r["stretch"], "s": at[0], "e": at[1], "number": number}
            at, number = left, number + more

    whole = by_stretch.mapInArrow(join_stretch, joined).repartition(n, "entry_id").sortWithinPartitions("entry_id", "stretch")
    entered = whole.mapInArrow(lambda b: _in_rows(_STARTS, through(b, None), 4096), _STARTS).withColumnRenamed("block", "stretch")
    inner = placed.join(entered, ["entry_id", "stretch"]).repartition(n, "entry_id", "stretch").sortWithinPartitions("entry_id", "stretch", "seq")
    return inner.mapInArrow(lambda b: _in_rows(_STARTS, through(b, "stretch"), 4096), _STARTS)


def _bisected(b: list[int], e: list[int], lo: int, hi: int, limit: int, cuts: list[int], strength: list[int]) -> None:
    """Cut lines lo..hi at the strongest boundary in the middle third, and so on while more than ``limit`` bytes are left."""
    if e[hi - 1] - b[lo] <= limit or hi - lo < 2:
        return
    mid, third = (b[lo] + e[hi - 1]) // 2, (e[hi - 1] - b[lo]) // 6
    a, z = bisect_left(b, mid - third, lo + 1, hi), bisect_right(b, mid + third, lo + 1, hi)
    if a >= z:
        near = min(max(bisect_left(b, mid, lo + 1, hi), lo + 1), hi - 1)
        a, z = near, near + 1
    at = min(range(a, z), key=lambda i: (-strength[i], abs(b[i] - mid), i))
    _bisected(b, e, lo, at, limit, cuts, strength)
    cuts.append(at)
    _bisected(b, e, at, hi, limit, cuts, strength)


_SEGMENTS = "entry_id long, a long, z long"
_FOUND = "entry_id long, a long, z long, weak long, far long, cut long, before long"


def _best_cuts(segments: DataFrame, blocks: DataFrame, block: int, everywhere: bool) -> DataFrame:
    """(entry_id, a, z, cut, before): where each segment is cut, and the end of the line before the cut.

    Each block that has lines in the middle third of a segment names its best line start there, and the best of all is taken, by the
    same rule as in :func:`_bisected`. ``everywhere`` is for segments without any: the line start nearest after the middle, else the last one.
    """
    mid, third = F.floor((F.col("a") + F.col("z")) / 2), F.floor((F.col("z") - F.col("a")) / 6)
    lo, hi = (F.col("a"), F.col("z") - 1) if everywhere else (mid - third, mid + third)
    over = segments.withColumn("block", F.explode(F.sequence(F.floor(lo / block), F.floor(hi / block))))
    rows = over.join(blocks.select("entry_id", "block", "starts", "ends", "before_end", "before_empty"), ["entry_id", "block"])

    def run(batches):
        def best():
            for r in _records(batches):
                a, z = r["a"], r["z"]
                b, e = np.frombuffer(r["starts"], np.int64), np.frombuffer(r["ends"], np.int64)
                strength = _strengths(b, e, bool(r["before_empty"]))
                mid, third = (a + z) // 2, (z - a) // 6
                on = (b > a) & (b < z)
                if not everywhere:
                    on &= (b >= mid - third) & (b <= mid + third)
                at = np.flatnonzero(on)
                if not len(at):
                    continue
                if everywhere:
                    after = at[b[at] >= mid]
                    i = int(after[0] if len(after) else at[-1])
                    rank = (0, int(b[i]) - mid) if len(after) else (1, mid - int(b[i]))
                else:
                    i = int(at[np.lexsort((b[at], np.abs(b[at] - mid), -strength[at]))[0]])
                    rank = (-int(strength[i]), abs(int(b[i]) - mid))
                yield {"entry_id": r["entry_id"], "a": a, "z": z, "weak": rank[0], "far": rank[1], "cut": int(b[i]), "before": int(e[i - 1]) if i else r["before_end"]}

        yield from _in_rows(_FOUND, best(), 4096)

    found = rows.mapInArrow(run, _FOUND)
    one = found.groupBy("entry_id", "a", "z").agg(F.min(F.struct("weak", "far", "cut", "before")).alias("x"))
    return one.select("entry_id", "a", "z", "x.cut", "x.before")


def _strengths(b: np.ndarray, e: np.ndarray, before_empty: bool) -> np.ndarray:
    """How strong the boundary before each line is: 1, and 1 more each if the line before it and the line itself are empty."""
    empty = e - b == 1
    return 1 + np.r_[before_empty, empty[:-1]].astype(np.int64) + empty


def bisect_entries(entries: DataFrame, lines: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """(entry_id, piece_start, piece_end): the same entries by recursive bisection.

    An entry is cut at the strongest line boundary in its middle third (one after or before an empty line, else the nearest
    to the middle; without any there, the next line start after the middle), and so are its halves while they hold more than
    ``limit - overlap`` bytes; then each piece but an entry's first is started up to ``overlap`` bytes earlier, at a line start. A line
    that alone is too long is cut by characters, each piece but its first starting ``overlap`` bytes before the end of the one
    before. Nulls and repeats are handled as in :func:`split_entries`.

    Halves of more than ``block`` bytes are cut by all their blocks together, a level of the recursion at a time; smaller ones are each
    finished in a task. The rule is the same, so the pieces don't depend on ``block``.
    """
    packed = materialize(pack_blocks(assign_lines(entries, lines, block, limit - overlap - 8), limit, overlap))
    blocks = materialize(_with_context(packed, limit).select("entry_id", "block", "seq", "starts", "ends", "long_at", "long_text", "start_b", "end", "before_end", F.try_element_at("before", F.lit(-1)).alias("last_start")))
    blocks = blocks.withColumn("before_empty", F.col("before_end") - F.col("last_start") == 1)
    go = blocks.where(F.col("seq") == 0).select("entry_id", F.col("start_b").alias("a"), F.col("end").alias("z"))
    done, large = go.where(F.col("z") - F.col("a") <= block), materialize(go.where(F.col("z") - F.col("a") > block))
    while not large.isEmpty():
        cuts = materialize(_best_cuts(large, blocks, block, False))
        rest = large.join(cuts.select("entry_id", "a"), ["entry_id", "a"], "left_anti")
        near = materialize(_best_cuts(rest, blocks, block, True)) if not rest.isEmpty() else cuts.limit(0)
        both = cuts.unionByName(near)
        whole = large.join(both.select("entry_id", "a"), ["entry_id", "a"], "left_anti")  # a single line
        halves = both.select("entry_id", F.inline(F.array(F.struct("a", F.col("before").alias("z")), F.struct(F.col("cut").alias("a"), "z"))))
        now = materialize(halves)
        done = done.unionByName(whole).unionByName(now.where(F.col("z") - F.col("a") <= block))
        large = now.where(F.col("z") - F.col("a") > block)
    # The blocks of a segment, also those with the lines that it may overlap.
    over = done.withColumn("block", F.explode(F.sequence(F.floor((F.col("a") - overlap) / block), F.floor((F.col("z") - 1) / block))))
    parts = over.join(blocks.select("entry_id", "block", "starts", "ends", "long_at", "long_text", "start_b", "before_empty"), ["entry_id", "block"])
    by_segment = parts.repartition(parallelism(entries.sparkSession), "entry_id", "a").sortWithinPartitions("entry_id", "a", "block")

    def pieces_of(rows: list[dict]):
        a, z = rows[0]["a"], rows[0]["z"]
        b = np.concatenate([np.frombuffer(r["starts"], np.int64) for r in rows])
        e = np.concatenate([np.frombuffer(r["ends"], np.int64) for r in rows])
        text = {k: t for r in rows for k, t in zip(r["long_at"] or [], r["long_text"] or [])}
        weak = _strengths(b, e, bool(rows[0]["before_empty"]))
        on = (b >= a) & (b < z)
        known = b.tolist()
        walk = Walk.of(known, text)
        b, e, weak = b[on].tolist(), e[on].tolist(), weak[on].tolist()
        cuts: list[int] = []
        _bisected(b, e, 0, len(b), limit - overlap, cuts, weak)
        for lo, hi in zip([0, *cuts], [*cuts, len(b)]):
            start, end = known[bisect_left(known, b[lo] - overlap)], e[hi - 1]
            while end - start > limit:
                stop = walk.char_start(start + limit)
                yield {"entry_id": rows[0]["entry_id"], "piece_start": start, "piece_end": stop}
                start = max(walk.char_start(stop - overlap), start + 1)
            yield {"entry_id": rows[0]["entry_id"], "piece_start": start, "piece_end": end}

    def run(batches):
        def rows():
            key, held = None, []
            for r in _records(batches):
                if (r["entry_id"], r["a"]) != key:
                    if held:
                        yield from pieces_of(held)
                    key, held = (r["entry_id"], r["a"]), []
                held.append(r)
            if held:
                yield from pieces_of(held)

        yield from _in_rows("entry_id long, piece_start long, piece_end long", rows(), 4096)

    return by_segment.mapInArrow(run, "entry_id long, piece_start long, piece_end long")
