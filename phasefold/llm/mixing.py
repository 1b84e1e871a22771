"""Mixing sources to target weights by capped water-filling.

The mix holds `share` times all words. Sources get it by weight; a source that would
pass `max_epochs` times its size is clamped there and the excess goes to the others by
weight, until none is above. A source then takes each of its documents floor(r) times
whole, r being target / size, and what is left of its target as one more repetition of
documents in the order of a seeded hash; the document on which it ends is taken in
part. So every source meets its target to the word.

Only sizes are shuffled, not texts: (source, bucket of the hash) sums give the bucket in
which a source's extra repetitions end, and only that bucket's documents are sorted. A
source that holds a third of all rows is a third of 4096 buckets per source.

Defined results: null or empty texts have size 0 and are taken 0 words; a null source is
a source of its own, last in order; sources without words have target 0; equal rows are
drawn as one run of the hash order (their sizes add up); reruns draw the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

BUCKETS = 4096
#: sources whose plan is sent to all tasks; a longer plan is joined by source
MOST_SENT = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: list[float], weights: list[float], total: float, max_epochs: float) -> list[float]:
    """Targets by weight that sum to total (or to all caps, if these are less), none above max_epochs times its size."""
    caps, out = [float(max_epochs * s) for s in sizes], [0.0] * len(sizes)
    free, left = [i for i, s in enumerate(sizes) if s > 0], float(total)
    while free and left > 0:
        w = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / w >= caps[i]]
        if not above:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in above:
            out[i] = caps[i]
        left -= sum(caps[i] for i in above)
        free = [i for i in free if i not in above]
    return out


class Mixer:
    """Plans a mix of docs, and assigns words to take to rows."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.docs, self.id_col, self.text_col, self.source_col, self.seed = docs, id_col, text_col, source_col, seed
        self.scratch = base.Scratch(docs.sparkSession, "mix")
        keys = self.keyed(docs).select(F.col(id_col).alias("m_id"), F.col(source_col).alias("m_source"), "m_size", "m_u", "m_bucket")
        self.sizes = self.scratch.save(keys, "sizes")
        sums = self.sizes.groupBy("m_source", "m_bucket").agg(F.sum("m_size").alias("b"))
        # one row per source: as small as the list of sources
        per = sums.groupBy("m_source").agg(F.sum("b").alias("n")).collect()
        per.sort(key=lambda r: (r.m_source is None, (r.m_source or "").encode("utf-32-be")))
        n = [r.n for r in per]
        targets = water_fill(n, [weights[i % len(weights)] for i in range(len(per))], share * sum(n), max_epochs)
        whole = [int(t // x) if x else 0 for t, x in zip(targets, n)]
        rows = [(r.m_source, x, t, w, max(0, round(t) - w * x)) for r, x, t, w in zip(per, n, targets, whole)]
        plan = docs.sparkSession.createDataFrame(rows, "p_source string, source_size long, target double, whole long, extra long")
        # the bucket in which each source's extra words end
        before = F.coalesce(F.sum("b").over(Window.partitionBy("m_source").orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self.sent = F.broadcast if len(rows) <= MOST_SENT else lambda df: df
        edge = sums.withColumn("before", before).join(self.sent(plan), F.col("m_source").eqNullSafe(F.col("p_source")))
        edge = {r.m_source: (r.m_bucket, r.before) for r in edge.where("before < extra AND before + b >= extra").collect()}
        rows = [(*r, *edge.get(r[0], (-1, 0))) for r in rows]
        self.plan = docs.sparkSession.createDataFrame(rows, "p_source string, source_size long, target double, whole long, extra long, e_bucket int, e_before long")

    def keyed(self, docs: DataFrame) -> DataFrame:
        """docs with m_size, and m_u and m_bucket of the seeded hash."""
        size = F.coalesce(F.regexp_count(F.col(self.text_col), F.lit(WORD)), F.lit(0)).cast("long")
        u = F.xxhash64(self.id_col, self.text_col, F.lit(self.seed))
        return docs.withColumns({"m_size": size, "m_u": u}).withColumn("m_bucket", F.pmod(F.shiftright("m_u", 20), F.lit(BUCKETS)).cast("int"))

    def assign(self, rows: DataFrame, source_col: str, id_col: str) -> DataFrame:
        """Adds the plan's columns and m_more, the words of the last repetition."""
        got = rows.join(self.sent(self.plan), F.col(source_col).eqNullSafe(F.col("p_source")))
        at_end = F.col("m_bucket") == F.col("e_bucket")
        early = got.where(~at_end).withColumn("m_more", F.when(F.col("m_bucket") < F.col("e_bucket"), F.col("m_size")).otherwise(F.lit(0)))
        w = Window.partitionBy("p_source").orderBy("m_u", id_col, "m_size").rowsBetween(Window.unboundedPreceding, -1)
        pos = F.col("e_before") + F.coalesce(F.sum("m_size").over(w), F.lit(0))
        last = got.where(at_end).withColumn("m_more", F.greatest(F.lit(0), F.least(F.col("m_size"), F.col("extra") - pos)))
        return early.unionByName(last).drop("p_source", "e_bucket", "e_before", "extra")

    def draw(self) -> DataFrame:
        """id, source, size, source_size, target, taken; one row per row of docs."""
        got = self.assign(self.sizes, "m_source", "m_id")
        taken = (F.col("whole") * F.col("m_size") + F.col("m_more")).cast("long")
        return got.select(F.col("m_id").alias(self.id_col), F.col("m_source").alias(self.source_col), F.col("m_size").alias("size"), "source_size", "target", taken.alias("taken"))

    def mix(self) -> DataFrame:
        """The mix itself: rows of docs, each as often as it is taken; a document taken in part holds its first words.

        Only the rows of the buckets in which sources end are shuffled.
        """
        own = {c: F.col(c) for c in self.docs.columns}
        got = self.assign(self.keyed(self.docs.select(F.struct(*own.values()).alias("m_row"), self.id_col, self.text_col, self.source_col)), self.source_col, self.id_col)
        times = F.col("whole") + F.when(F.col("m_more") > 0, 1).otherwise(0)
        got = got.where((F.col("m_size") > 0) & (times > 0)).withColumn("m_rep", F.explode(F.sequence(F.lit(1), times.cast("int"))))
        in_part = (F.col("m_rep") > F.col("whole")) & (F.col("m_more") < F.col("m_size"))
        part = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col(self.text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col("m_more").cast("int")))
        text = F.when(in_part, part).otherwise(F.col(self.text_col))
        return got.select(*(text.alias(c) if c == self.text_col else F.col("m_row").getField(c).alias(c) for c in self.docs.columns))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return Mixer(base.table(spark, sf_dir, "documents")).draw().select("doc_id", "size", "source_size", "target", "taken")
