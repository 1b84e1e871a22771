"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Only DataFrame functions run here. A file has three kinds of units: its whole text, its
header (the leading lines that are comments or blank; if these hold no word, the first
paragraph) and its single lines. Whole texts and headers meet the templates of licence
texts and headers (license_texts.py), lines meet those of one-line notices. Units become
sparse vectors: term frequency times ln((1 + N) / (1 + df)) + 1, df being the number of
all files that hold the term, known for the templates' terms; other terms weigh as unseen
ones. A unit has the licence of the template with the largest cosine of at least `least`;
a file has that of its text or header, or else (a notice says less) of its best line.

What is not scored cannot match. A cosine is at most the norm of the unit template's
terms that the unit shares. So the heaviest terms of a notice, taken until the others'
norm is below `least`, hold one of every line it matches; and a text or header is scored
if the file's terms can reach `least`, each term counted with the largest square that it
has in any template, rounded up to a power of two.

A licence file is one whose whole text matches, or that is notices for at least a third
of its words. It declares its licence for its directory; a file without a licence of its
own takes that of its nearest ancestor directory that has one, by joining the
directories' ancestor paths. Directories are joined once each, not once per file; the
files of a large directory are split by Spark's skew join.

Defined results: null or empty texts have no unit; a null id is a row like others; equal
rows get equal results; ties go to the first licence by name, then to the text before the
header, and in a directory to the smallest path; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base
from .license_texts import TEXTS, counts

LEAST = 0.7
#: one-line notices
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Permitted are redistribution and use in source and binary forms, with or without modification, if the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying is prohibited"),
]


#: what starts a comment line
COMMENT = r"^[ \t]*(#|//|/\*|\*|--|;|%|<!--)"


def terms(text):
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def words_of(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def listed(notices: list[tuple[str, str]], texts: list[tuple[str, str]]) -> list[tuple[int, bool, str, dict[str, int]]]:
    """(number, whether it is a text, licence, term counts) of all templates."""
    rows = [(False, n, Counter(words_of(t))) for n, t in notices] + [(True, n, counts(t)) for n, t in texts]
    return [(i, *r) for i, r in enumerate(rows)]


def needed(templates: list[dict[str, int]], idf: dict[str, float], least: float) -> list[str]:
    """Terms of which every line holds one that has a cosine of at least `least` (rounded to six digits) to a template."""
    bar, out = max(0.0, least - 2e-6) ** 2, set()
    for tf in templates:
        left = sorted(((tf[t] * idf[t]) ** 2, t) for t in tf)
        total = sum(w for w, _ in left)
        while left and sum(w for w, _ in left) >= bar * total:
            out.add(left.pop()[1])
    return sorted(out)


def masses(templates: list[dict[str, int]], idf: dict[str, float]) -> dict[float, list[str]]:
    """Terms by the largest square that they have in a unit template, rounded up to a power of two."""
    most: dict[str, float] = {}
    for tf in templates:
        total = sum((tf[t] * idf[t]) ** 2 for t in tf)
        for t in tf:
            most[t] = max(most.get(t, 0.0), (tf[t] * idf[t]) ** 2 / total)
    out: dict[float, list[str]] = {}
    for t, m in sorted(most.items()):
        out.setdefault(2.0 ** max(-10, math.ceil(math.log2(m))), []).append(t)
    return dict(sorted(out.items()))  # the many light ones first


def header(text):
    """The leading comment and blank lines of a text; its first paragraph if they hold no word."""
    blank = lambda x: F.translate(x, " \t\r", "") == ""

    def cut(lines):
        lead = F.array_position(F.transform(lines, lambda x: blank(x) | x.rlike(COMMENT)), False).cast("int")
        block = F.array_join(F.when(lead == 0, lines).otherwise(F.slice(lines, 1, F.greatest(lead - 1, F.lit(0)))), "\n")

        def paragraph(rest):
            end = F.array_position(F.transform(rest, blank), True).cast("int")
            return F.array_join(F.when(end == 0, rest).otherwise(F.slice(rest, 1, F.greatest(end - 1, F.lit(0)))), "\n")

        rest = F.transform(F.array(F.slice(lines, F.greatest(lead, F.lit(1)), F.size(lines))), paragraph)[0]
        return F.when(F.lower(block).rlike("[a-z0-9]") | (lead == 0), block).otherwise(rest)

    return F.transform(F.array(F.split(text, "\n")), cut)[0]


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, texts: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """id, path, own_license, own_score, unit, n_lines (with a notice), license, via, license_dir of rows (id, path, text).

    templates: one-line notices; texts: licence texts and headers as term counts. unit:
    what gave the own licence (text, header or line); via: own, inherited or none;
    license_dir: the directory that a licence comes from.
    """
    spark = files.sparkSession
    known = listed(templates, texts)
    t_tf = spark.createDataFrame([(i, x, n, t, k) for i, x, n, tf in known for t, k in tf.items()], "t_no int, t_text boolean, t_name string, term string, t_tf long")
    vocabulary = sorted({t for *_, tf in known for t in tf})
    # membership in lists of literals is a lookup in a hash set that is made once
    held = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x.isin(vocabulary)))
    df = files.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(held, F.array().cast("array<string>")))).alias("term")).groupBy("term").count()
    # one row per template term, and '' for the number of files
    found = {r.term: r["count"] for r in df.collect()}
    n = found.get("", 0)
    idf = spark.createDataFrame([(t, found.get(t, 0)) for t in vocabulary], "term string, df long")
    idf = idf.select("term", (F.log((F.lit(1.0) + n) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    weight = {t: math.log((1 + n) / (1 + found.get(t, 0))) + 1 for t in vocabulary}
    cue = "(?<![a-z0-9])(?:" + "|".join(needed([tf for _, x, _, tf in known if not x], weight, least)) + ")(?![a-z0-9])"
    unseen = F.log(F.lit(1.0) + n) + 1.0
    t_w = t_tf.join(F.broadcast(idf), "term").withColumn("t_w", F.col("t_tf") * F.col("idf"))
    t_norm = t_w.groupBy("t_no").agg(F.sqrt(F.sum(F.col("t_w") * F.col("t_w"))).alias("t_norm"))
    t_w = t_w.join(F.broadcast(t_norm), "t_no").select("t_no", "t_text", "t_name", "term", (F.col("t_w") / F.col("t_norm")).alias("t_w"))

    key = ["id", "path", "th"]
    keyed = files.select("id", "path", F.xxhash64("text").alias("th"), "text")
    most = masses([tf for _, x, _, tf in known if x], weight)

    def mass(term):
        out = F.lit(0.0)
        for m, ts in reversed(most.items()):
            out = F.when(term.isin(ts), F.lit(m)).otherwise(out)
        return out

    reach = F.aggregate(held, F.lit(0.0), lambda total, x: total + mass(x))  # what the terms of a text can reach at most
    some = keyed.select(*key, "text", F.lower("text").rlike(cue).alias("cued"), (F.coalesce(reach, F.lit(0.0)) >= max(0.0, least - 2e-6) ** 2).alias("near")).where("cued OR near").dropDuplicates(key)
    some = base.Scratch(spark, "licences").save(some.withColumn("size", F.size(terms(F.col("text")))), "some")
    lines = some.where("cued").select(*key, "size", F.posexplode(F.split("text", "\n")).alias("unit", "line")).where(F.lower("line").rlike(cue))
    whole = some.where("near").select(*key, "size", F.inline(F.array(F.struct(F.lit(-2).alias("unit"), F.col("text").alias("line")), F.struct(F.lit(-1).alias("unit"), header(F.col("text")).alias("line")))))
    line_key = [*key, "size", "unit"]
    tf = lines.unionByName(whole).select(*line_key, F.explode(terms(F.col("line"))).alias("term")).groupBy(*line_key, "term").agg(F.count("*").alias("tf"))
    w = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen)).withColumn("t_text", F.col("unit") < 0)
    # one row (unit, template) for each shared term, and (unit, -1) for each term of the unit
    shared = w.join(F.broadcast(t_w), ["term", "t_text"], "left").groupBy(*line_key, "term", "tf", "w").agg(F.collect_list(F.when(F.col("t_no").isNotNull(), F.struct("t_name", "t_no", "t_w"))).alias("hits"))
    parts = shared.select(*line_key, "tf", "w", F.explode(F.concat(F.array(F.struct(F.lit("").alias("t_name"), F.lit(-1).alias("t_no"), F.col("w").alias("t_w"))), F.col("hits"))).alias("h"))
    dots = parts.groupBy(*line_key, "h.t_no", "h.t_name").agg(F.sum(F.col("w") * F.col("h.t_w")).alias("dot"), F.sum("tf").alias("n_terms"))
    norm = F.max(F.when(F.col("t_no") == -1, F.struct(F.col("dot").alias("sq"), F.col("n_terms").alias("terms")))).over(Window.partitionBy(*line_key))
    cosine = F.round(F.col("dot") / F.sqrt(F.col("whole.sq")), 6)
    per_unit = dots.withColumn("whole", norm).where("t_no >= 0").withColumn("score", cosine).where(F.col("score") >= least)
    is_line = F.col("unit") >= 0
    best = per_unit.groupBy(*line_key).agg(F.max("whole.terms").alias("terms"), F.min(F.struct(is_line.alias("line"), (-F.col("score")).alias("s"), F.col("t_name").alias("name"), F.least("unit", F.lit(0)).alias("kind"))).alias("best"))
    own = best.groupBy(*key, "size").agg(F.count_if(is_line).alias("n_lines"), F.sum(F.when(is_line, F.col("terms")).otherwise(0)).alias("terms"), F.count_if(F.col("unit") == -2).alias("files"), F.min("best").alias("best"))
    own = own.select(*key, "n_lines", F.col("best.name").alias("own_license"), (-F.col("best.s")).alias("own_score"), F.element_at(F.array(F.lit("text"), F.lit("header"), F.lit("line")), F.col("best.kind") + 3).alias("unit"), ((F.col("files") > 0) | (F.col("terms") * 3 >= F.col("size"))).alias("is_file"))
    own = base.Scratch(spark, "licences").save(own, "own")

    folder = F.regexp_extract(F.coalesce("path", F.lit("")), "^(.*)/[^/]*$", 1)
    declared = own.where("is_file").groupBy(folder.alias("license_dir")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own_license").alias("name"))).alias("d")).select("license_dir", F.col("d.name").alias("dir_license"))
    dirs = files.select(folder.alias("dir")).distinct()
    steps = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(steps)))).alias("depth"))
    ups = ups.select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("license_dir"))
    near = ups.join(declared, "license_dir").groupBy("dir").agg(F.max(F.struct("depth", "license_dir", "dir_license")).alias("n"))
    near = near.select(F.col("dir").alias("n_dir"), "n.license_dir", "n.dir_license")

    rows = keyed.select(*key).withColumn("dir", folder)
    mine = own.select(*(F.col(c).alias(f"o_{c}") for c in key), "n_lines", "own_license", "own_score", "unit")
    same = F.col("id").eqNullSafe(F.col("o_id")) & F.col("path").eqNullSafe(F.col("o_path")) & (F.col("th") == F.col("o_th"))
    out = rows.join(mine, same, "left").join(near, F.col("dir") == F.col("n_dir"), "left")
    via = F.when(F.col("own_license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select("id", "path", "own_license", "own_score", "unit", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("own_license", "dir_license").alias("license"), via.alias("via"), F.when(via == "own", F.col("dir")).otherwise(F.col("license_dir")).alias("license_dir"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return scan(files).withColumnRenamed("id", "doc_id")


_VALUES = ", ".join(f"({i}, {x}, '{n}', '{t}', {k})" for i, x, n, tf in listed(TEMPLATES, TEXTS) for t, k in tf.items())
_BLANK = "translate(x, ' ' || chr(9) || chr(13), '') = ''"
SQL = rf"""
WITH tw(t_no, t_text, t_name, term, tf) AS (VALUES {_VALUES}),
files AS (SELECT row_number() OVER () AS r, doc_id, concat_ws('/', source, lang, doc_id::VARCHAR) AS path, text, string_split(text, chr(10)) AS ls FROM documents),
df AS (
  SELECT term, count(*) AS df FROM (
    SELECT DISTINCT r, term FROM (SELECT r, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM files)
    WHERE term IN (SELECT term FROM tw)
  ) GROUP BY term
), nn AS (SELECT count(*)::DOUBLE AS n FROM files),
idf AS (SELECT DISTINCT tw.term, ln((1 + n) / (1.0::DOUBLE + coalesce(df, 0))) + 1 AS idf FROM tw LEFT JOIN df USING (term), nn),
t1 AS (SELECT t_no, t_text, t_name, term, tf * idf AS w FROM tw JOIN idf USING (term)),
t2 AS (SELECT t_no, t_text, t_name, term, w / sqrt(sum(w * w) OVER (PARTITION BY t_no)) AS w FROM t1),
h1 AS (SELECT r, ls, coalesce(nullif(list_position(list_transform(ls, lambda x: {_BLANK} OR regexp_matches(x, '{COMMENT}')), false), 0), len(ls) + 1) AS lead FROM files WHERE ls IS NOT NULL),
h2 AS (SELECT r, ls, lead, array_to_string(ls[1 : lead - 1], chr(10)) AS block, ls[lead : len(ls)] AS rest FROM h1),
h3 AS (SELECT r, CASE WHEN regexp_matches(lower(block), '[a-z0-9]') OR lead > len(ls) THEN block ELSE array_to_string(rest[1 : coalesce(nullif(list_position(list_transform(rest, lambda x: {_BLANK}), true), 0), len(rest) + 1) - 1], chr(10)) END AS line FROM h2),
l AS (
  SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM files
  UNION ALL SELECT r, line, -1 FROM h3
  UNION ALL SELECT r, text, -2 FROM files
), lt AS (
  SELECT r, i, term, count(*) AS tf FROM (SELECT r, i, unnest(string_split_regex(lower(line), '[^a-z0-9]+')) AS term FROM l) WHERE term <> '' GROUP BY ALL
), lw AS (
  SELECT r, i, lt.term, tf, tf * coalesce(idf, ln(1 + n) + 1) AS w FROM lt LEFT JOIN idf ON lt.term = idf.term, nn
), ln AS (SELECT r, i, sqrt(sum(w * w)) AS norm, sum(tf) AS terms FROM lw GROUP BY ALL),
sc AS (
  SELECT r, i, t_name, terms, round(sum(lw.w * t2.w) / any_value(norm), 6) AS score
  FROM lw JOIN t2 ON lw.term = t2.term AND t2.t_text = (lw.i < 0) JOIN ln USING (r, i) GROUP BY r, i, t_no, t_name, terms
), bl AS (
  SELECT r, i, terms, t_name, score FROM sc WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY r, i ORDER BY score DESC, t_name) = 1
), own AS (
  SELECT r, count(*) FILTER (WHERE i > 0) AS n_lines, sum(terms) FILTER (WHERE i > 0) AS terms, count(*) FILTER (WHERE i = -2) AS n_files, first(score ORDER BY i > 0, score DESC) AS own_score,
         first(t_name ORDER BY i > 0, score DESC, t_name) AS own_license, first(CASE i WHEN -2 THEN 'text' WHEN -1 THEN 'header' ELSE 'line' END ORDER BY i > 0, score DESC, t_name, i) AS unit
  FROM bl GROUP BY r
), f AS (
  SELECT files.*, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, n_lines, own_score, own_license, unit,
         n_files > 0 OR terms * 3 >= len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS is_file
  FROM files LEFT JOIN own USING (r)
), decl AS (
  SELECT dir AS license_dir, own_license AS dir_license FROM f WHERE is_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path, own_license) = 1
), ups AS (
  SELECT dir, d, array_to_string(string_split(dir, '/')[1:d], '/') AS license_dir
  FROM (SELECT dir, unnest(generate_series(0, CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END)) AS d FROM (SELECT DISTINCT dir FROM f))
), near AS (
  SELECT dir, decl.license_dir, dir_license FROM ups JOIN decl USING (license_dir) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY d DESC) = 1
)
SELECT doc_id, path, own_license, own_score, unit, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(own_license, dir_license) AS license,
       CASE WHEN own_license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS via,
       CASE WHEN own_license IS NOT NULL THEN f.dir ELSE license_dir END AS license_dir
FROM f LEFT JOIN near ON f.dir = near.dir
"""
