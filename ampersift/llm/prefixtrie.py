"""Trie of conversation prefixes by composable fingerprints.

Every conversation is rebuilt from the first turns of its base and its own later
turns, but no rebuilt text is ever made. A sequence of turns has the fingerprint
(length, hash), the product of those of its turns: (n, x)(m, y) = (n + m, x + B^n
y) modulo two primes. Running products over the stored turns of a conversation
are taken once, in slices of a global order whose products are combined
afterwards, so that a conversation may be of any length. The fingerprint of every
prefix of a rebuilt conversation follows in closed form from the running products
of the base, of the own turns, and of the own turns that are left out. Prefixes
with equal depth and fingerprint form a node. A prefix refers to the stored turn
that it ends with, by the SHA-256 of its role and text; a node is verified if all
its members end with the same turn, and by induction over the depth the nodes are
then exact. Should one fail, the products are taken anew with other bases.

The smallest conversation of a node owns it. The nodes it owns are the tail of
its own path, so that sums over a subtree are sums over the members of its top.

Cases: null roles and texts are empty; rows without a conv_id take no part; the
remainder of a negative id is negative, as in SQL; turns
sort null first, ties by SHA-256 of role and text, so that repeated rows are
repeated turns; a conversation whose turns all fall away is a member of the root
only; an empty table has no root and gives an empty table; texts of any length
are read once, for their digest and words; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampersift.llm.common import ready, store
from ampersift.operators.ordering import order_globally

# Two primes, and pairs of bases to try in turn.
PRIMES = (2147483647, 2147483629)
BASES = ((1103515245, 1664525003), (1389796137, 950706376), (742938285, 1226874159), (630360016, 784588716))
# A key with more than one in HEAVY of all rows has its counterpart broadcast:
# there are HEAVY such keys at most.
HEAVY = 2000
MOST_HEAD = 3
_WORD = r"[^\x20\x09-\x0D]+"


def power(base: int, exponent: Column, prime: int) -> Column:
    """base^exponent mod prime, for exponents below 2^40."""
    squares = F.array(*[F.lit(pow(base, 1 << bit, prime)).cast("long") for bit in range(40)])
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(39)),
        F.lit(1).cast("long"),
        lambda out, bit: F.when(F.getbit(exponent, bit) == 1, out * squares[bit] % prime).otherwise(out),
    )


def stored_turns(conversations: DataFrame) -> DataFrame:
    """Conversation, digest, words and two hashes of every turn, in one order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn"),
        digest.alias("ref"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
        *[F.pmod(F.xxhash64(F.lit(i), role, text), F.lit(p)).cast("long").alias(f"t{i}") for i, p in enumerate(PRIMES)],
    )
    # the last key spreads many equal rows over several slices
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    return order_globally(spread, "c", "turn", "ref", "_row").select("c", "ref", "words", "t0", "t1", "_slice")


def _products(bases: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Running length, words and hashes of each conversation within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [np.ones(1, np.int64) for _ in PRIMES]
        group, carried, waiting, first = None, [0, 0, 0, 0], None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("c").to_numpy()
            fresh = np.concatenate([[conv[0] != group], conv[1:] != conv[:-1]])
            starts = np.flatnonzero(fresh)
            run_of = np.cumsum(fresh) - 1  # -1: the conversation of the batch before
            begin = np.concatenate([starts, [0]])[run_of] if len(starts) else np.zeros(len(conv), int)
            begin = np.where(run_of < 0, 0, begin)
            goes_on = run_of < 0
            place = np.arange(len(conv)) - begin + np.where(goes_on, carried[0], 0)
            top = int(place.max()) + 1
            out = {"k": place + 1}

            def running(values: np.ndarray, before: int, begin=begin, goes_on=goes_on) -> np.ndarray:
                total = np.cumsum(values)
                return total - (total - values)[begin] + np.where(goes_on, before, 0)

            out["w"] = running(batch.column("words").to_numpy(), carried[1])
            for i, p in enumerate(PRIMES):
                while len(powers[i]) < top:
                    powers[i] = np.concatenate([powers[i], powers[i] * pow(bases[i], len(powers[i]), p) % p])
                out[f"h{i}"] = running(batch.column(f"t{i}").to_numpy() * powers[i][place] % p, carried[2 + i]) % p
            head = np.zeros(len(conv), bool)
            head[0] = first
            group, first = conv[-1], False
            carried = [int(out[n][-1]) for n in ("k", "w", "h0", "h1")]
            columns = [batch.column(n) for n in ("c", "ref", "words", "t0", "t1", "_slice")]
            columns += [pa.array(out[n], pa.int64()) for n in ("k", "w", "h0", "h1")] + [pa.array(head)]
            if waiting is not None:
                yield _slice_rows(waiting, False)
            waiting = columns
        if waiting is not None:
            yield _slice_rows(waiting, True)

    return run


_COLUMNS = ["c", "ref", "words", "t0", "t1", "_slice", "k", "w", "h0", "h1", "head", "tail"]
_TYPES = "c long, ref binary, words long, t0 long, t1 long, _slice long, k long, w long, h0 long, h1 long, head boolean, tail boolean"


def _slice_rows(columns: list, last: bool) -> pa.RecordBatch:
    tail = np.zeros(len(columns[0]), bool)
    tail[-1] = last
    return pa.RecordBatch.from_arrays([*columns, pa.array(tail)], names=_COLUMNS)


def running_products(turns: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """Every turn with its place k, and words w and hashes h0, h1 up to it."""
    local = store(turns.mapInArrow(_products(bases), _TYPES), "trie-local")
    # the first and the last turn of each slice: two rows a slice
    ends = local.where("head").select("c", "_slice", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), *_zeros()).union(
        local.where("tail").select("c", "_slice", F.lit(1), "k", "w", "h0", "h1")
    )
    before = Window.partitionBy("c").orderBy("_slice", "kind").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0).cast("long"))
    ends = ends.withColumns({"skip": earlier("n"), "skip_w": earlier("w")})
    for i, p in enumerate(PRIMES):
        ends = ends.withColumn(f"lift{i}", power(bases[i], F.col("skip"), p))
        ends = ends.withColumn(f"skip{i}", F.col(f"lift{i}") * F.col(f"h{i}") % p)
    ends = ends.withColumns({f"skip{i}": earlier(f"skip{i}") % p for i, p in enumerate(PRIMES)})
    offsets = ends.where("kind = 0").select("c", "_slice", "skip", "skip_w", "skip0", "skip1", "lift0", "lift1")
    joined = local.join(F.broadcast(offsets), ["c", "_slice"], "left")
    late = F.col("skip").isNotNull()
    shifted = {"k": F.when(late, F.col("k") + F.col("skip")).otherwise(F.col("k"))}
    shifted["w"] = F.when(late, F.col("w") + F.col("skip_w")).otherwise(F.col("w"))
    for i, p in enumerate(PRIMES):
        shifted[f"h{i}"] = F.when(late, (F.col(f"skip{i}") + F.col(f"lift{i}") * F.col(f"h{i}")) % p).otherwise(F.col(f"h{i}"))
    return joined.select("c", "ref", "words", "t0", "t1", *[v.alias(k) for k, v in shifted.items()])


def _zeros() -> list[Column]:
    return [F.lit(0).cast("long").alias(n) for n in ("w", "h0", "h1")]


def match(rows: DataFrame, side: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` left-joined to the unique ``side``. ``weight`` bounds the rows of
    a key from above or is their number, and adds up to ``total`` at most; so the
    keys with many rows are HEAVY at most, and these are broadcast."""
    heavy = side.where(F.col(weight) * HEAVY >= total).drop(weight).withColumn("_heavy", F.lit(True))
    light = side.where(F.col(weight) * HEAVY < total).drop(weight)
    seen = rows.join(F.broadcast(heavy), on, "left")
    columns = [c for c in [*rows.columns, *light.columns] if c not in on]
    rest = seen.where("_heavy IS NULL").select(*rows.columns).join(light, on, "left")
    return seen.where("_heavy").select(*on, *columns).union(rest.select(*on, *columns))


def prefixes(turns: DataFrame, every: int, period: int, bases: tuple[int, int]) -> DataFrame:
    """A row per prefix of every rebuilt conversation: c, depth, fingerprint,
    reference to and words of its last turn, words up to it, and the words (total)
    and turns (size) of the whole conversation."""
    kept = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(every)).cast("long")
    products = running_products(turns, bases)
    first = [F.max(F.when(F.col("k") == i, F.struct("ref", "words", "w", "h0", "h1"))).alias(f"e{i}") for i in range(1, MOST_HEAD + 1)]
    convs = store(
        products.withColumn("h", kept)
        .groupBy("c", "h")
        .agg(F.max("k").alias("n"), F.max("w").alias("all_w"), F.max(F.when(F.col("k") == F.col("h"), F.struct("w", "h0", "h1"))).alias("cut"), *first),
        "trie-conversations",
    )
    heads = [F.col(f"e{i}") for i in range(1, MOST_HEAD + 1)]
    bases_of = convs.select(F.col("c").alias("base"), F.array_compact(F.array(*heads)).alias("head"))
    linked = convs.select("c", "h", "n", "all_w", "cut", (F.col("c") - F.col("c") % period).alias("base")).join(bases_of, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(bases_of.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    linked = linked.withColumn("head", F.when(F.col("h") > 0, head).otherwise(F.slice("head", 1, 0)))
    linked = linked.withColumn("m", F.greatest(F.size("head"), F.lit(0)).cast("long"))
    own = F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))
    last = F.try_element_at("head", F.greatest(F.col("m"), F.lit(1)).cast("int"))
    zero = F.lit(0).cast("long")
    linked = linked.withColumn("last", F.when(F.col("m") > 0, last)).select(
        "c",
        "h",
        "m",
        "head",
        (F.col("m") + own).alias("size"),
        *[F.coalesce(F.col(f"last.{n}"), zero).alias(f"last_{n}") for n in ("w", "h0", "h1")],
        *[F.coalesce(F.col(f"cut.{n}"), zero).alias(f"cut_{n}") for n in ("w", "h0", "h1")],
        # a conversation with fewer turns than it drops has no own turn left
        F.when(own > 0, F.col("all_w") - F.coalesce(F.col("cut.w"), zero)).otherwise(zero).alias("own_w"),
        "n",
    )
    linked = store(linked.withColumn("total", F.col("last_w") + F.col("own_w")), "trie-heads")
    root = linked.select("c", zero.alias("depth"), zero.alias("f0"), zero.alias("f1"), F.lit(b"").alias("ref"), zero.alias("words"), zero.alias("upto"), "total", "size")
    exploded = linked.select("c", "total", "size", F.posexplode("head").alias("at", "e"))
    shared = exploded.select(
        "c", (F.col("at") + 1).cast("long"), F.col("e.h0"), F.col("e.h1"), F.col("e.ref"), F.col("e.words"), F.col("e.w"), "total", "size"
    )
    side = linked.drop("head", "own_w")
    suffix = match(products.select("c", "k", "ref", "words", "w", "h0", "h1"), side, ["c"], "n", _total(linked)).where(F.col("k") > F.col("h"))
    composed = []
    for i, p in enumerate(PRIMES):
        lift = F.lit(0)
        for drop in range(MOST_HEAD + 1):  # B^(m - h): the own turns begin h - m places earlier
            lift = F.when(F.col("h") - F.col("m") == drop, F.lit(pow(bases[i], -drop, p))).otherwise(lift)
        composed.append((F.col(f"last_h{i}") + lift.cast("long") * F.pmod(F.col(f"h{i}") - F.col(f"cut_h{i}"), F.lit(p).cast("long"))) % p)
    later = suffix.select(
        "c",
        F.col("m") + F.col("k") - F.col("h"),
        *composed,
        "ref",
        "words",
        F.col("last_w") + F.col("w") - F.col("cut_w"),
        "total",
        "size",
    )
    return store(root.union(shared).union(later), "trie-prefixes")


def _total(linked: DataFrame) -> int:
    return linked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


KEY = ["depth", "f0", "f1"]


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined conversations that end at each node, ascending.

    The ids are sorted over slices. A node within one slice is hashed there; ids
    of a node at the edge of a slice go on as chunks of text, which one task reads
    in their order, a batch at a time.
    """
    placed = order_globally(ends.select(*KEY, "c"), *KEY, "c").select(*KEY, "c", "_slice")
    names = [*KEY, "_slice", "seq", "digest", "chunk"]
    kinds = "depth long, f0 long, f1 long, _slice long, seq long, digest string, chunk binary"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of whole nodes; text of those at the edges, a row a batch."""
        open_key, at_edge, seq, state, last_slice = None, True, 0, None, 0
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in KEY], axis=1)
            if not len(keys):
                continue
            ids, rows = batch.column("c").to_pylist(), []
            last_slice = batch.column("_slice")[0].as_py()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[a].tolist())
                if key != open_key:
                    if open_key is not None:
                        if not at_edge:
                            rows += [(*k, last_slice, s, d, t) for k, s, d, t in state.close()]
                        at_edge = False
                    if not at_edge:
                        state = _Run(key)
                    open_key, seq = key, 0
                text = ",".join(map(str, ids[a:b])).encode()
                if at_edge:
                    rows.append((*key, last_slice, seq, None, text))
                    seq += 1
                else:
                    rows += [(*k, last_slice, s, d, t) for k, s, d, t in state.add(text)]
            yield _batch(rows, names, _KINDS)
        if open_key is not None and not at_edge:  # the last node of a slice may go on in the next
            yield _batch([(*k, last_slice, s, d, t) for k, s, d, t in state.rest()], names, _KINDS)

    found = store(placed.mapInArrow(pieces, kinds), "trie-ends")
    whole = found.where("digest IS NOT NULL").select(*KEY, "digest")
    partition = found.where("digest IS NULL").repartition(*KEY).sortWithinPartitions(*KEY, "_slice", "seq")

    hashed = [pa.int64()] * 3 + [pa.string()]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = []
            for *now, text in zip(*[batch.column(n).to_pylist() for n in (*KEY, "chunk")], strict=True):
                if now != key:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(text)
                else:
                    state.update(b"," + text)
            yield _batch(rows, [*KEY, "digest"], hashed)
        if key is not None:
            yield _batch([(*key, state.hexdigest())], [*KEY, "digest"], hashed)

    return whole.union(partition.select(*KEY, "chunk").mapInArrow(joined, "depth long, f0 long, f1 long, digest string"))


_KINDS = [pa.int64()] * 5 + [pa.string(), pa.binary()]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)


class _Run:
    """Ids of one node inside a slice: hashed as they come, and kept as text up to
    a bound; beyond it they go on as chunks like those at the edge."""

    KEEP = 1 << 20

    def __init__(self, key: tuple):
        self.key, self.hash, self.kept, self.size, self.sent = key, hashlib.sha256(), [], 0, 0

    def add(self, text: bytes) -> list:
        self.hash.update((b"," if self.kept or self.sent else b"") + text)
        self.kept.append(text)
        self.size += len(text)
        return self._send() if self.size > self.KEEP else []

    def _send(self) -> list:
        out = [(self.key, self.sent, None, b",".join(self.kept))]
        self.sent, self.kept, self.size = self.sent + 1, [], 0
        return out

    def close(self) -> list:
        """The node ends in this slice."""
        if not self.sent:
            return [(self.key, 0, self.hash.hexdigest(), None)]
        return self._send() if self.kept else []

    def rest(self) -> list:
        """The node may go on."""
        return self._send() if self.kept else []


def prefix_trie(conversations: DataFrame, every: int = 4, period: int = 20) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, a row each.

    Conversation c begins with the first crc32(c) mod ``every`` turns of
    conversation c - c mod ``period``, in place of so many of its own."""
    if not 1 <= every <= MOST_HEAD + 1:
        raise ValueError(f"every is 1 to {MOST_HEAD + 1}")
    ready(conversations.sparkSession)
    turns = stored_turns(conversations)
    for bases in BASES:
        rows = prefixes(turns, every, period, bases)
        groups = store(
            rows.groupBy(*KEY).agg(
                F.min("c").alias("owner"),
                F.max("size").alias("deepest"),
                F.count(F.lit(1)).alias("n_convs"),
                (F.min("ref") == F.max("ref")).alias("verified"),
            ),
            "trie-groups",
        )
        if groups.where("NOT verified").isEmpty():
            return _nodes(rows, groups)
    raise RuntimeError("no pair of bases tells all prefixes apart")


def _nodes(rows: DataFrame, groups: DataFrame) -> DataFrame:
    owners = groups.groupBy("owner").agg(
        F.min("depth").alias("since"), F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf")
    )
    total = groups.agg(F.coalesce(F.sum("n_convs"), F.lit(0))).first()[0]
    # rows of a conversation: one more than its turns
    sizes = rows.where("depth = 0").select("c", (F.col("size") + 1).alias("n"))
    before = rows.where("depth > 0").select("c", "depth", (F.col("upto") - F.col("words")).alias("owed"))
    owners = owners.withColumnRenamed("owner", "c").join(sizes, "c")
    # words of the owned tail: all less those above its first node
    owners = owners.join(before.withColumnRenamed("depth", "since"), ["c", "since"], "left")
    owners = store(owners.select("c", "since", "leaf", "n", F.coalesce("owed", F.lit(0).cast("long")).alias("owed")), "trie-owners")
    wide = match(rows, owners, ["c"], "n", total)
    tail = F.when(F.col("since").isNotNull(), F.col("total") - F.col("owed")).otherwise(F.lit(0).cast("long"))
    summed = wide.groupBy(*KEY).agg(
        F.min(F.struct("c", "total", tail.alias("tail"), "since", "size")).alias("top"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("words").alias("words"),
        F.max("upto").alias("upto"),
        F.sum("total").alias("all_total"),
        F.sum(tail).alias("all_tail"),
        F.coalesce(F.sum("leaf"), F.lit(0).cast("long")).alias("n_leaves"),
        F.sum(F.coalesce((F.col("since") - 1 == F.col("depth")).cast("long"), F.lit(0).cast("long"))).alias("branches"),
    )
    above = F.col("upto") - F.col("words")
    others = F.col("all_tail") - F.col("top.tail")
    saved = F.col("all_total") - F.col("n_convs") * above - others - (F.col("top.total") - above)
    # the owner goes on below the node, others branch off
    children = F.col("branches") + (F.col("top.size") > F.col("depth")).cast("long")
    nodes = summed.select(
        *KEY,
        F.col("top.c").alias("conv_id"),
        F.col("top.since").alias("since"),
        "n_convs",
        children.alias("n_children"),
        "n_leaves",
        saved.alias("saved_tokens"),
    )
    # where a path begins that its owner does not share further up, the parent is another's node
    starts = wide.where(F.col("since") - 1 == F.col("depth")).select(*KEY, F.col("c").alias("child"))
    parents = match(starts, groups.select(*KEY, "owner", "n_convs"), KEY, "n_convs", total).select(
        F.col("child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent")
    )
    digests = ends_digest(rows.where("depth = size"))
    out = nodes.join(parents, ["conv_id", "depth"], "left").join(digests, KEY, "left")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("since") < F.col("depth"), F.col("conv_id")).otherwise(F.col("parent"))
    return out.select(
        "conv_id",
        "depth",
        parent.cast("long").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
