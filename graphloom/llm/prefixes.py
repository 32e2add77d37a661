"""The prefix trie of conversations, from neighbours in sorted order.

Every turn gets a digest of itself and all turns before it, so two
conversations share their first d turns exactly if their d-th digests are equal.
Sorted by these digests, the members of a trie node stand together, and what a
node is follows from how many first turns neighbours share (their LCP). Tasks
take stretches of the sorted conversations and join neighbours by union-find in
descending order of LCP: each join of two components creates the branching node
where they part (or widens it), and the turns between it and the nodes below
are its chain. Nodes whose members reach over an end of a stretch are few: the
common first turns of the neighbours there. They are contracted to partial sums,
which add up over stretches; all others are complete where they are made.

Sums over a subtree need no walk: of a node over the sorted conversations l..r,
a conversation's leaf counts where its successor does not go on from all of it,
and the bytes that it shares with its predecessor are the bytes saved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from graphloom.durable import Scratch, cut
from graphloom.llm.crowds import crowded, meet

#: Bytes of a digest; conversations, and bytes of digests, that a stretch has at most (but for one longer conversation).
WIDE, MOST_ROWS, MOST_BYTES = 16, 20_000, 16 << 20
#: Ids that are joined to one string before the strings of a node meet.
IDS = 4096
#: Bytes of digests by which conversations are dealt to ranges.
RANGE_BYTES = 256 * WIDE
_ROOT, _EMPTY = bytes(WIDE), hashlib.sha256(b"").hexdigest()


def turn_tokens(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, token, bytes)``: turns numbered from 0 by (turn, role, text), null turns first.

    A null role or text is empty; rows with a null conv_id are left out, as no
    conversation has them. Repeated rows are turns of their own. ``token`` is a
    digest of role and text, so no text is moved after this.
    """
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    token = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select("conv_id", place.cast("long").alias("place"), token.alias("token"), F.octet_length("text").cast("long").alias("bytes"))


def rebuilt(tokens: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of conversation c - c % ``group`` before its own turns after its first h; and all conv_ids.

    h is the CRC-32 of the decimal id modulo ``most``. A conversation that is
    absent gives no turns; ``%`` has the sign of c.
    """
    ids = tokens.select("conv_id").distinct()
    own_h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % most
    bases = ids.select(F.col("conv_id").alias("for"), (F.col("conv_id") - F.col("conv_id") % group).alias("conv_id"), own_h("conv_id").alias("h"))
    heads = tokens.where(F.col("place") < most).join(bases, "conv_id").where("place < h")  # at most ``most`` turns of a conversation, for at most ``group`` others
    own = tokens.where(F.col("place") >= own_h("conv_id"))
    part = lambda rows, c, n: rows.select(F.col(c).alias("conv_id"), (F.col("place") + (F.lit(n).cast("long") * most)).alias("place"), "token", "bytes")
    return part(heads, "for", 0).union(part(own, "conv_id", 1)), ids


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (conv_id, place), one with a null token for each conversation: a row for each with its digests and the bytes up to each turn."""
    at, chain, sums, last = None, [], [0], _ROOT
    out: list[tuple] = []
    held = 0

    def rows() -> pa.RecordBatch:
        ids, keys, upto = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(upto, pa.list_(pa.int64()))], ["conv_id", "keys", "upto"])

    for batch in batches:
        for c, token, size in zip(batch.column("conv_id").to_pylist(), batch.column("token").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            if c != at:
                if at is not None:
                    out.append((at, b"".join(chain), sums))
                    held += len(chain) + 1
                    if held > MOST_ROWS:
                        yield rows()
                        out, held = [], 0
                at, chain, sums, last = c, [], [0], _ROOT
            if token is not None:
                last = hashlib.sha256(last + token).digest()[:WIDE]
                chain.append(last)
                sums.append(sums[-1] + size)
    if at is not None:
        out.append((at, b"".join(chain), sums))
        yield rows()


def _shared(a: bytes, b: bytes) -> int:
    """First digests that two conversations share: by halving, as equal digests have equal ones before them."""
    low, high = 0, min(len(a), len(b)) // WIDE
    while low < high:
        mid = (low + high + 1) // 2
        if a[(mid - 1) * WIDE : mid * WIDE] == b[(mid - 1) * WIDE : mid * WIDE]:
            low = mid
        else:
            high = mid - 1
    return low


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition with its number, each row's place in it and the LCP with the row before and after; null at the partition's ends."""
    part, place, before, held = TaskContext.get().partitionId(), 0, None, None
    for batch in batches:
        keys = batch.column("keys").to_pylist()
        lcp = [None if p is None else _shared(p, k) for p, k in zip([before, *keys], keys, strict=False)]
        before = keys[-1] if keys else before
        made = pa.RecordBatch.from_arrays([pa.array([part] * len(keys), pa.int32()), pa.array(range(place, place + len(keys)), pa.int64()), *batch.columns, pa.array(lcp, pa.int64())], ["part", "place", *batch.schema.names, "lcp"])
        place += len(keys)
        if not keys:
            continue
        if held is not None:
            yield held.append_column("following", pa.array([*held.column("lcp").to_pylist()[1:], lcp[0]], pa.int64()))
        held = made
    if held is not None:
        yield held.append_column("following", pa.array([*held.column("lcp").to_pylist()[1:], None], pa.int64()))


@F.pandas_udf(LongType())
def _shared_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_shared(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


_NODE = "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, partial boolean"


def forest(conv: np.ndarray, turns: np.ndarray, lcp: np.ndarray, following: int, offsets: np.ndarray, keys: np.ndarray, upto: np.ndarray) -> pa.RecordBatch:
    """The nodes of a stretch of sorted conversations.

    ``turns`` are lengths, ``lcp`` what each shares with the one before (of the
    first row, with one outside; -1 if there is none), ``following`` what the
    last shares with the one after. Row i's digests are
    ``keys[offsets[i]:offsets[i] + turns[i]]``, its bytes up to d turns
    ``upto[offsets[i] + i + d]``.
    """
    n = len(conv)
    after = np.append(lcp[1:], following)
    leaves = np.concatenate([[0], np.cumsum(after < turns)])
    shared = upto[offsets + np.arange(n) + np.maximum(lcp, 0)]
    saved = np.concatenate([[0], np.cumsum(shared)])
    top = list(range(n))  # union-find: a component's leftmost row
    right, depth, least = list(range(n)), turns.tolist(), conv.tolist()
    branches, below = [0] * n, [[] for _ in range(n)]
    made: list[tuple] = []  # (lo, hi, l, r, least, branches): the nodes of depths lo + 1 to hi over rows l to r
    over: list[int] = []  # of each, the chain above

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    def close(x: int, at: int) -> None:
        """Make the chain of component x down to what lies over depth ``at``; the component then is one child of a node there."""
        if depth[x] > at:
            for k in below[x]:
                over[k] = len(made)
            made.append((at, depth[x], x, right[x], least[x], branches[x]))
            over.append(-1)
            depth[x], branches[x], below[x] = at, 1, [len(made) - 1]

    order = 1 + np.argsort(-lcp[1:], kind="stable")
    for i, at in zip(order.tolist(), lcp[order].tolist(), strict=True):
        a, b = find(i - 1), find(i)
        close(a, at)
        close(b, at)
        top[b], right[a], least[a] = a, right[b], min(least[a], least[b])
        branches[a] += branches[b]
        few, many = sorted((below[a], below[b]), key=len)
        many.extend(few)
        below[a], below[b] = many, []
    close(0, -1)
    lo, hi, left, last, small, kids = (np.array(x, np.int64) for x in zip(*made, strict=True))
    over_ = np.array(over, np.int64)
    sizes = hi - lo
    e = np.repeat(np.arange(len(made)), sizes)
    d = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[e] + 1
    l, r = left[e], last[e]  # noqa: E741
    went_on = (l == 0) & (d <= lcp[0])  # first seen in an earlier stretch
    goes_on = lambda l, r, d: ((l == 0) & (d <= lcp[0])) | ((r == n - 1) & (d <= following))  # noqa: E731, E741
    partial = goes_on(l, r, d)
    before = upto[offsets[l] + l + np.maximum(d - 1, 0)]
    spared = saved[r + 1] - saved[l + 1] - (r - l) * before + np.where(went_on, shared[0] - before, 0)
    children = np.where(d == hi[e], kids[e], 1) - ((l == 0) & (d < lcp[0]))  # a child that goes on from an earlier stretch counts there
    up = np.where(d == lo[e] + 1, over_[e], e)  # the chain that the parent is in
    known = (d > 0) & ~goes_on(left[up], last[up], d - 1)
    none = np.zeros((1, WIDE), np.uint8)
    table = np.concatenate([none, keys])  # row 0: the root's
    key_at = lambda d: np.where(d > 0, offsets[l] + d, 0)
    binary = lambda at: pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * WIDE).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(table[at]))])
    unknown = (d > 0) & ~known
    parent = pc.if_else(pa.array(unknown), binary(key_at(d - 1)), pa.scalar(None, pa.binary()))
    columns = [binary(key_at(d)), parent, pa.array(d), pa.array(small[e]), pa.array(small[up], mask=~known), pa.array(r - l + 1), pa.array(children), pa.array(leaves[r + 1] - leaves[l]), pa.array(spared), pa.array(partial)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _NODE.split(", ")])


def _stretches(most_rows: int):
    """Forests of rows in the order of (part, place), each of one part's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            part = batch.column("part").to_numpy()
            turns = np.array(pc.binary_length(batch.column("keys")).to_numpy(), np.int64) // WIDE
            ends, at = np.cumsum(turns * WIDE), 0
            while at < len(batch):
                to = min(at + most_rows, int(np.searchsorted(part, part[at], "right")), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_BYTES, "right")))
                rows = batch.slice(at, max(1, to - at))
                size = turns[at : at + len(rows)]
                at += len(rows)
                keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.uint8).reshape(-1, WIDE)
                upto = rows.column("upto").flatten().to_numpy()
                offsets = np.cumsum(size) - size
                yield from _sliced(forest(rows.column("conv_id").to_numpy(), size, rows.column("lcp").to_numpy().astype(np.int64), rows.column("following")[len(rows) - 1].as_py(), offsets, keys, upto))

    return run


def _sliced(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(batch), rows):
        yield batch.slice(i, rows)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of strings in the order of (key, block), the SHA-256 of each key's, joined by commas; none is kept."""
    at, sha, out = None, None, []
    table = lambda: pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], ["key", "ends_sha256"])
    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key == at:
                sha.update(b"," + ids.encode())
                continue
            if at is not None:
                out.append((at, sha.hexdigest()))
            at, sha = key, hashlib.sha256(ids.encode())
        if len(out) > MOST_ROWS:
            yield table()
            out = []
    if at is not None:
        out.append((at, sha.hexdigest()))
    if out:
        yield table()


def prefix_trie(tokens: DataFrame, members: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """A row for each distinct sequence of first turns of ``tokens (conv_id, place, token, bytes)``, the root (depth 0, no turn) included.

    ``members (conv_id)`` are the conversations, distinct and without null;
    those without turns belong to the root only, and without members there is
    no root. Other columns are ignored. Returns ``(conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    key)``: the smallest member, that of the parent (null for the root),
    members, children, leaves of the subtree, bytes of turns that members of
    the subtree's nodes share with another (each node's members but one times
    its last turn), the SHA-256 of the ids of the members that end here, and
    the node's own digest.

    Turns of one place in a conversation go by their token. A conversation is
    read by one task in order, which keeps 16 bytes a turn of it and 8 for its
    bytes; they are one row of the sorted table, so a conversation has at most
    2**27 turns. Copies of a conversation are sorted by id and may be in any
    number of tasks.
    """
    with Scratch() as s:
        none = members.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("token"), F.lit(0).cast("long").alias("bytes"))
        rows = tokens.select("conv_id", "place", "token", "bytes").union(none)
        chains = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place", "token").select("conv_id", "token", "bytes").mapInArrow(_chains, "conv_id long, keys binary, upto array<long>")
        chains = cut(chains)
        long_ = F.octet_length("keys") > RANGE_BYTES  # then equal beginnings stay together, whatever their ids
        dealt = chains.withColumn("head", F.substring("keys", 1, RANGE_BYTES)).repartitionByRange("head", long_, F.when(~long_, F.col("conv_id")))
        line = dealt.sortWithinPartitions("keys", "conv_id").select("conv_id", "keys", "upto")
        line = cut(line.mapInArrow(_neighbours, "part int, place long, conv_id long, keys binary, upto array<long>, lcp long, following long"))
        # the first and last row of each partition, whose number is set by the session: what they share across partitions
        over = Window.orderBy("part", "place")
        edge = line.where("lcp IS NULL OR following IS NULL").select("part", "place", "keys", (F.col("lcp").isNull()).alias("first"), F.col("following").isNull().alias("last"))
        edge = edge.withColumn("before", F.lag("keys").over(over)).withColumn("met", F.when(F.col("first"), F.when(F.col("before").isNull(), F.lit(-1).cast("long")).otherwise(_shared_of(F.coalesce("before", "keys"), "keys"))))
        edge = edge.withColumn("meets", F.when(F.col("last"), F.coalesce(F.lead("met").over(over), F.lit(-1).cast("long"))))
        edge = edge.groupBy("part").agg(F.max("met").alias("met"), F.max("meets").alias("meets"))
        line_ = line.join(F.broadcast(edge), "part").withColumn("lcp", F.coalesce("lcp", "met")).withColumn("following", F.coalesce("following", "meets")).drop("met", "meets")
        nodes = line_.repartition("part").sortWithinPartitions("part", "place").select("part", "conv_id", "keys", "upto", "lcp", "following").mapInArrow(_stretches(most_rows), _NODE)
        nodes = cut(nodes)
        sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        merged = cut(nodes.where("partial").groupBy("key", "depth").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *sums))
        columns = ["key", "parent_key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        whole = nodes.where("NOT partial").select(columns).union(merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns))
        # parents that reach over stretches are known only now; one may have very many children
        tops = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
        asked = whole.where("parent_key IS NOT NULL")
        asked = meet(asked.drop("parent_conv_id"), tops, "parent_key", "key", crowded(asked.select("parent_key"), "parent_key")).withColumnRenamed("found", "parent_conv_id")
        whole = whole.where("parent_key IS NULL").select(columns).union(asked.select(columns))
        last = F.when(F.octet_length("keys") > 0, F.expr(f"substring(keys, -{WIDE}, {WIDE})")).otherwise(F.lit(_ROOT))
        ids = chains.select(last.alias("key"), "conv_id").groupBy("key", F.floor(F.col("conv_id") / IDS).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
        ends = ids.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(_digests, "key binary, ends_sha256 string")
        out = whole.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
        return s.keep(cut(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key")))
