"""Near-duplicate documents by bottom-k sketches of one hash function.

Documents with equal sets of word shingles (by 128 bits of hash) are one node. A node's
sketch holds the 64 smallest hashes of its set.

Inverted lists. Two sets with similarity t share each of the smallest hashes of their
union with chance t, so of 32 retained values they share at least `least` (12 for 0.85)
but for a chance below 1e-9; sets that are smaller than their sketches share ceil(t * n)
for certain. With any one order of values in which all nodes agree, two nodes that share
c of s values therefore share 4 among their first s - c + 4. That order puts values that
many nodes hold last (the most frequent ones are counted over all nodes), so passages
that many documents quote do not fill the lists, and no list and no partner is capped.

Clusters. Two nodes that share 4 list values and whose sizes fit may be linked; clusters
are what such pairs connect. To find them without all pairs of a group of copies, each
list pairs its members with one of them only, its hub; clusters found so far become one
label, and lists that still hold several labels elect new hubs as long as that pays. What
is left, pairs of members with different labels, is few and is looked at whole.

Links. Each cluster's texts travel once, to one task; a cluster beyond a bound is cut
into blocks, and each two blocks meet in a task of their own. There inverted lists of the
32 retained values give each node its overlaps, the union-sketch estimate filters them
(again with a chance below 1e-9 of losing a link; exact for small sets), and the full
shingle sets are compared exactly; pairs that are connected by then need no look.
Components of the links are found by large-star and small-star steps on tables in the
shared folder.

Defined results: null or empty texts have no shingles and no links; fewer than 5 words
are one shingle; rows with the same id are one document with all their links; a row
without an id links others, but is a component of its own; the smallest id represents a component; ids may be of any
type that can be ordered; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .line_dedup import mix

SKETCH, LISTED, COMMON = 64, 32, 4
#: values held by more nodes than RARE are ranked by their number of nodes; at most MOST_RANKED of them
RARE, MOST_RANKED = 16, 200_000
#: shingles of a cluster's block of texts; a task holds two blocks
CLUSTER = 2_000_000
#: new hubs are elected while the pairs left are more than so many times their rows, at most so often
PAIRS, ELECTIONS = 16, 6
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]


def least_shared(k: int, t: float, miss: float = 1e-9) -> int:
    """The largest c with P(Binomial(k, t) < c) <= miss."""
    c, below = 0, 0.0
    while c < k and below + (p := math.comb(k, c) * t**c * (1 - t) ** (k - c)) <= miss:
        below += p
        c += 1
    return c


def shingle_sets(texts: pa.StringArray, width: int) -> list[np.ndarray]:
    """Each text's set of hashed shingles, sorted, as int64 below 2**63."""
    flat, counts = base.split_words(base.translated(texts, LOWER))
    first = base.starts_of(counts)
    out = [np.zeros(0, np.int64)] * len(counts)
    if not len(flat):
        return out
    codes, words = base.coded(flat)
    w = np.array([xxhash.xxh3_64_intdigest(x) for x in words], np.uint64)[codes]
    with np.errstate(over="ignore"):
        n = max(0, len(w) - width + 1)
        h = np.zeros(n, np.uint64)
        for j in range(width):
            h += w[j : j + n] * _C[j % 5] ** np.uint64(j // 5 + 1)
        h = (mix(h, width) >> np.uint64(1)).astype(np.int64)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if b - a >= width:
                s = np.sort(h[a : b - width + 1])
                out[i] = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                x = np.uint64(b - a)
                for j in range(b - a):
                    x += w[a + j] * _C[j % 5] ** np.uint64(j // 5 + 1)
                out[i] = (mix(np.array([x]), b - a) >> np.uint64(1)).astype(np.int64)
    return out


def _int64_lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = base.starts_of(np.array([len(v) for v in values], np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """id, th (hash of the text), node and other (hashes of the shingle set, null if empty), n, sketch."""
    kind = docs.schema["id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.steps(batches):
            sets = shingle_sets(base.strings(base.col(b, "text")), width)
            both = [divmod(set_hash(s), 1 << 64) if len(s) else (None, None) for s in sets]
            node, other = (pa.array([h[k] if h[k] is None else h[k] >> 1 for h in both], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([base.col(b, "id"), base.col(b, "th"), node, other, pa.array([len(s) for s in sets], pa.int64()), _int64_lists([s[:SKETCH] for s in sets])], ["id", "th", "node", "other", "n", "sketch"])

    return docs.mapInArrow(emit, f"id {kind}, th long, node long, other long, n long, sketch array<long>")


def set_hash(s: np.ndarray) -> int:
    """128 bits of a sorted shingle set."""
    return xxhash.xxh3_128_intdigest(s.tobytes())


def likely(rows: DataFrame, key, wanted: DataFrame, wanted_key, most_bits: int = 1 << 26) -> DataFrame:
    """rows with f_maybe: whether the key may be wanted, by a filter of at most most_bits bits, so of bounded size, sent to all tasks.

    It only spares shuffling others; an exact join follows.
    """
    n = wanted.count()
    bits = max(1 << 10, 1 << (32 * n).bit_length())
    if bits > most_bits:
        bits = most_bits
        if n > bits // 4:
            return rows.withColumn("f_maybe", F.lit(True))
    k = wanted.select(F.pmod(wanted_key, F.lit(bits)).alias("k"))
    words = k.groupBy(F.shiftright("k", 6).alias("f_word")).agg(F.expr("bit_or(shiftleft(1L, CAST(k & 63 AS INT)))").alias("f_bits"))
    own = rows.withColumn("f_k", F.pmod(key, F.lit(bits))).join(F.broadcast(words), F.shiftright("f_k", 6) == F.col("f_word"), "left")
    hit = F.expr("coalesce(shiftrightunsigned(f_bits, CAST(f_k & 63 AS INT)) & 1L, 0L) = 1L")
    return own.withColumn("f_maybe", hit).drop("f_k", "f_word", "f_bits")


class NearDuplicates:
    """One run over docs; components() is its result. by_id: rows with the same id are one document."""

    def __init__(self, docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", by_id: bool = True):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        self.percent, self.t, self.width, self.id_col, self.by_id = percent, percent / 100, width, id_col, by_id
        self.scratch = base.Scratch(docs.sparkSession, "near")
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
        self.least = {k: least_shared(k, self.t) for k in (LISTED, SKETCH)}
        #: up to this size, sets and all that are similar to them lie whole in the lists
        self.whole = int(LISTED * self.t)

    def need(self, n):
        """Shared list values that a set of n shingles asks for, as a column."""
        return F.when(n <= self.whole, F.least(F.lit(COMMON), F.ceil(n * self.percent / 100))).otherwise(F.lit(min(COMMON, self.least[LISTED])))

    def lists(self, nodes: DataFrame) -> DataFrame:
        """v, node, n: the lists of at least two nodes."""
        listed = nodes.select(F.explode(F.slice("sketch", 1, LISTED)).alias("v")).groupBy("v").count()
        shared = self.scratch.save(listed.where("count >= 2"), "shared")
        top = shared.where(F.col("count") > RARE).orderBy(F.desc("count"), "v").limit(MOST_RANKED).toArrow().sort_by("v")
        hot, times = (top.column(c).combine_chunks().to_numpy() for c in ("v", "count"))
        whole, percent, least = self.whole, self.percent, self.least[LISTED]

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, got = base.col(b, "n").to_numpy(), base.col(b, "sketch")
                values, at = np.asarray(got.values), np.asarray(got.offsets)
                out = []
                for i, size in enumerate(n.tolist()):
                    v = values[at[i] : at[i + 1]][:LISTED]
                    c = -(-percent * size // 100) if size <= whole else least
                    if len(hot):
                        p = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
                        v = v[np.lexsort((v, np.where(hot[p] == v, times[p], 0)))]
                    out.append(v[: len(v) - c + min(COMMON, c)])
                k = np.array([len(v) for v in out])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)), pa.array(np.repeat(base.col(b, "node").to_numpy(), k)), pa.array(np.repeat(n, k))], ["v", "node", "n"])

        rows = nodes.select("node", "n", "sketch").mapInArrow(first, "v long, node long, n long")
        out = self.scratch.save(rows.join(shared.select("v"), "v"), "lists")
        self.scratch.drop("shared")
        return out

    def maybe(self, pairs: DataFrame) -> DataFrame:
        """a, b of rows (a, an, b, bn), one per shared list value: those that may be linked so far."""
        fits = F.least("an", "bn") * 100 >= F.greatest("an", "bn") * self.percent
        some = pairs.where(fits).groupBy("a", "b", "an", "bn").agg(F.count("*").alias("m"))
        return some.where(F.col("m") >= F.least(self.need(F.col("an")), self.need(F.col("bn")))).select("a", "b")

    def clusters(self, nodes: DataFrame) -> DataFrame:
        """node, comp: nodes that may be linked, over any number of others, have the same comp."""
        now = self.lists(nodes).withColumn("label", F.col("node"))
        found, left = None, None
        for turn in range(ELECTIONS):
            chosen = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label")))
            hubs = now.groupBy("v").agg(chosen.alias("h")).select("v", "h.hub", "h.hub_n", "h.hub_label")
            star = now.join(hubs, "v").where("label <> hub_label").select(F.col("hub").alias("a"), F.col("hub_n").alias("an"), F.col("node").alias("b"), F.col("n").alias("bn"))
            edges = self.maybe(star)
            found = self.joined(edges if found is None else edges.unionByName(found), f"turn{turn}")
            self.scratch.drop(f"turn{turn - 1}")
            new = now.drop("label").join(found.select(F.col("b").alias("node"), F.col("a").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
            per = new.groupBy("v", "label").agg(F.count("*").alias("m"))
            # pairs of members with different labels, of lists that hold several
            per = per.groupBy("v").agg(F.count("*").alias("labels"), F.sum("m").alias("rows"), F.sum(F.col("m").cast("double") * F.col("m")).alias("sq")).where("labels > 1")
            now = self.scratch.save(new.join(per.select("v", "rows", "sq"), "v"), f"mixed{turn}")
            self.scratch.drop("lists" if turn == 0 else f"mixed{turn - 1}")
            rows, pairs = now.agg(F.count("*"), F.sum((F.col("rows") - F.col("sq") / F.col("rows")) / 2)).first()
            now = now.drop("rows", "sq")
            if (pairs or 0) <= PAIRS * rows or left is not None and pairs > 0.8 * left:
                break
            left = pairs
        x, y = (now.select("v", F.col("node").alias(s), F.col("n").alias(f"{s}n"), F.col("label").alias(f"l{s}")) for s in "ab")
        rest = self.maybe(x.join(y, "v").where("a < b AND la <> lb"))
        out = self.joined(rest.unionByName(found), "clusters")
        self.scratch.drop(f"mixed{turn}", f"turn{turn}")
        return out.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(out.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())

    def joined(self, edges: DataFrame, name: str) -> DataFrame:
        """(a, b): a is the smallest node that b, another one, is connected with."""
        got = components(edges, self.scratch, f"{name}-cc")
        out = self.scratch.save(got.where("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b")), name)
        self.scratch.drop(f"{name}-cc-0", f"{name}-cc-1")
        return out

    def links(self, clusters: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs (a, b) that hold, as many as connect what all of them connect."""
        # a hash of the id, which may be null, is a key by which texts stay partitioned
        own = self.scratch.save(clusters.join(nodes.select("node", "n", F.xxhash64("rep_id").alias("rep_id"), "rep_th"), "node"), "own")
        blocks = own.groupBy("comp").agg(F.ceil(F.sum("n") / CLUSTER).cast("int").alias("blocks"))
        asks = own.join(blocks, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        asks = asks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asks = asks.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "rep_id", "rep_th")
        docs = self.docs.select(F.xxhash64("id").alias("id"), "th", "text")
        docs = likely(docs, F.xxhash64("id", "th"), own, F.xxhash64("rep_id", "rep_th")).where("f_maybe")
        sent = docs.join(asks, (F.col("id") == F.col("rep_id")) & (F.col("th") == F.col("rep_th")))
        # of equal rows one text is sent
        sent = sent.dropDuplicates(["rep_id", "rep_th", "i", "j"]).select("comp", "i", "j", "block", "node", "text")
        sent = sent.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "node")
        width, percent, least, whole = self.width, self.percent, self.least, self.whole

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []

            def close() -> pa.RecordBatch:
                a, b = matches(*zip(*held), percent, whole, least) if len(held) > 1 else ([], [])
                return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

            for batch in base.steps(batches):
                sets = shingle_sets(base.strings(base.col(batch, "text")), width)
                for comp, i, j, block, node, s in zip(*(base.col(batch, c).to_pylist() for c in ("comp", "i", "j", "block", "node")), sets):
                    if at != (comp, i, j):
                        if len(held) > 1:
                            yield close()
                        at, held = (comp, i, j), []
                    held.append((node, s, block, i != j))
            yield close()

        out = self.scratch.save(sent.mapInArrow(compare, "a long, b long"), "links")
        self.scratch.drop("own")
        return out

    def nodes(self) -> tuple[DataFrame, DataFrame]:
        """The nodes (node, n, sketch, rep_id, rep_th), and the rows (id, th, node, n)."""
        rows = self.scratch.save(sketches(self.docs, self.width), "sketches")

        def distinct(rows: DataFrame, name: str) -> DataFrame:
            rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep")
            found = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), rep, F.min("other").alias("low"), F.max("other").alias("high"))
            return self.scratch.save(found.select("node", "n", "sketch", F.col("rep.id").alias("rep_id"), F.col("rep.th").alias("rep_th"), "low", "high"), name)

        found = distinct(rows, "nodes")
        clash = found.where("low < high").select(F.col("node").alias("c_node"))
        if clash.count():  # other sets under the same half of the hash: both halves name them
            named = F.shiftrightunsigned(F.xxhash64("node", "other"), 1)
            rows = rows.join(clash, F.col("node") == F.col("c_node"), "left").withColumn("node", F.when(F.col("c_node").isNull(), F.col("node")).otherwise(named)).drop("c_node")
            found = distinct(rows, "nodes-apart")
        members = self.scratch.save(rows.select("id", "th", "node", "n"), "members")
        self.scratch.drop("sketches")
        return found.drop("low", "high"), members

    def members(self) -> tuple[DataFrame, DataFrame]:
        """(id, th, node, n) of the rows of docs, and (node, rep_id, comp) of the nodes, comp being the smallest node that is reached."""
        nodes, members = self.nodes()
        links = self.links(self.clusters(nodes), nodes)
        # one document may be several nodes, if rows share its id
        keyed = members.where("node IS NOT NULL AND id IS NOT NULL").select("id", "node")
        several = keyed.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("id", "a")
        same = keyed.join(several, "id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
        whole = self.scratch.save(components(links.unionByName(same) if self.by_id else links, self.scratch), "components")
        return members, nodes.select("node", "rep_id").join(whole, "node", "left").select("node", "rep_id", F.coalesce("comp", "node").alias("comp"))

    def components(self) -> DataFrame:
        """id, n_shingles, component_id; one row per row of docs."""
        members, low = self.members()
        least = low.groupBy("comp").agg(F.min("rep_id").alias("component_id"))
        names = low.join(least, "comp").select("node", "component_id")
        out = members.join(names, "node", "left")
        own = F.col("node").isNull() | F.col("id").isNull()
        return out.select("id", F.col("n").alias("n_shingles"), F.when(own, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))

    def kept(self) -> DataFrame:
        """id_col, n_shingles, component_id, kept per row of docs; it reads tables of the scratch folder."""
        return self.components().select(F.col("id").alias(self.id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def matches(nodes: tuple[int, ...], sets: tuple[np.ndarray, ...], block: tuple[int, ...], apart: tuple[bool, ...], percent: int, whole: int, least: dict[int, int]) -> tuple[list[int], list[int]]:
    """Pairs of the nodes that share at least percent of their union, as many as connect the same; if apart, pairs of different blocks only."""
    size = np.array([len(s) for s in sets])
    first = base.starts_of(size)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)  # numbers in the order of the hashes
    n, none = len(sets), len(values)
    sketch = np.full((n, SKETCH), none)
    for i in range(n):
        sketch[i, : size[i]] = code[first[i] : first[i] + min(SKETCH, size[i])]
    held = np.minimum(size, SKETCH)
    asked = np.where(size <= whole, -(-percent * size // 100), least[LISTED])
    # inverted lists of the retained values
    listed = sketch[:, :LISTED].ravel()
    order = np.argsort(listed, kind="stable")
    owner, begins = order // LISTED, np.searchsorted(listed[order], np.arange(none + 1))
    side, apart = np.array(block), apart[0]
    label, rank, mark = np.arange(n), np.zeros(none + 1, np.int64), np.zeros(none, bool)
    a, b = [], []
    for x in range(n - 1):
        lists = [owner[begins[v] : begins[v + 1]] for v in sketch[x, : min(LISTED, size[x])].tolist()]
        overlap = np.bincount(np.concatenate(lists), minlength=n)[x + 1 :]
        y = x + 1 + np.flatnonzero(overlap >= np.minimum(asked[x + 1 :], asked[x]))
        fits = (label[y] != label[x]) & (np.minimum(size[y], size[x]) * 100 >= np.maximum(size[y], size[x]) * percent)
        y = y[fits & (side[y] != side[x])] if apart else y[fits]
        if not len(y):
            continue
        own = sketch[x, : held[x]]
        rank[own] = np.arange(1, len(own) + 1)
        at = rank[sketch[y]]
        rank[own] = 0
        common = at > 0
        # a common value's rank in the union: its ranks in both less the common ones up to it
        among_least = common & (np.arange(1, SKETCH + 1) + at - np.cumsum(common, 1) <= SKETCH)
        union = held[x] + held[y] - common.sum(1)
        # a union below the sketch's size is the whole union: its share is exact
        y = y[np.where(union < SKETCH, common.sum(1) * 100 >= union * percent, among_least.sum(1) >= least[SKETCH])]
        if not len(y):
            continue
        mark[code[first[x] : first[x + 1]]] = True
        k = size[y]
        both = np.add.reduceat(mark[code[np.repeat(first[y] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))]].astype(np.int64), np.cumsum(k) - k)
        mark[code[first[x] : first[x + 1]]] = False
        for z in y[100 * both >= percent * (size[x] + k - both)].tolist():
            if label[z] != label[x]:
                label[label == label[z]] = label[x]
                a.append(nodes[x])
                b.append(nodes[z])
    return a, b


def components(edges: DataFrame, scratch: base.Scratch, label: str = "cc") -> DataFrame:
    """(node, comp): the smallest node that each node of the edges (a, b) reaches."""
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-0")
    step, seen = 0, None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lows, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        step += 1
        now = scratch.save(small, f"{label}-{step % 2}")
        sums = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(CAST(xxhash64(b, a) % 1000003 AS LONG))")).first()
        if tuple(sums) == seen or not sums[0]:
            break
        seen = tuple(sums)
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept (whether the id is its component's smallest) per row of docs."""
    return NearDuplicates(docs, percent, width, id_col, text_col).kept()


def deduplicated(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, of each component of linked texts only one: that with the smallest id (null last), then text hash.

    Rows are told by id and text, so another text under the same id stays, and of equal
    rows, or copies without an id, one does. Texts without words are linked with nothing
    and stay. Only rows that may go are shuffled.
    """
    run = NearDuplicates(docs, percent, width, id_col, text_col, by_id=False)
    members, low = run.members()
    rows = members.where("node IS NOT NULL").join(low.select("node", "comp"), "node").groupBy("comp", "id", "th").agg(F.count("*").alias("times"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    first = rows.groupBy("comp").agg(F.min(order).alias("first"))
    marks = rows.join(first, "comp").withColumn("stays", order == F.col("first")).where("NOT stays OR times > 1").select(F.col("id").alias("g_id"), F.col("th").alias("g_th"), "stays")
    marks = base.Scratch(docs.sparkSession, "gone").save(marks, "rows")
    run.scratch.close()
    own = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    packed = docs.select(F.struct(*own.values()).alias("g_row"), F.col(id_col).alias("g_own"), F.xxhash64(text_col).alias("g_text"))
    some = likely(packed, F.xxhash64("g_own", "g_text"), marks, F.xxhash64("g_id", "g_th"))
    met = some.where("f_maybe").join(marks, F.col("g_own").eqNullSafe(F.col("g_id")) & (F.col("g_text") == F.col("g_th")), "left")
    parts = [some.where("NOT f_maybe"), met.where("stays IS NULL"), met.where("stays").dropDuplicates(["g_own", "g_text"])]
    out = parts[0].select("g_row")
    for p in parts[1:]:
        out = out.unionByName(p.select("g_row"))
    return out.select("g_row.*")


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(base.table(spark, sf_dir, "documents"), percent=85)
