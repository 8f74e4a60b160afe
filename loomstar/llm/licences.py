"""License scans: TF-IDF cosine of header lines and licence texts to templates, then inheritance from the nearest ancestor directory.

1. Lines of the whole text, and the sentences of a line that has several, are sparse TF-IDF vectors of words, with the
   document frequencies of the header templates; each gets the template with the highest cosine, if that reaches the
   threshold. Two tests that no such line fails keep the others from being weighed: the line has an anchor (the words of
   a template that aren't anchors have together a length under the threshold), and the length of the part of a template
   that it shares, times the share of the line's own length in known words, reaches the threshold (Cauchy-Schwarz).
2. Licence bodies and standard headers, however wrapped, commented or embedded, are found as blocks: stretches of a
   text of which the runs of three words occur in the templates of licence_texts, with short gaps for names. A block's
   sparse vector of such runs gets the template with the highest cosine in the same way; a run that no template has
   weighs in its norm. Document frequencies are those of the templates.
3. SPDX identifiers are taken as they stand.

A document has the licence of its SPDX identifier, else of its best block, else of its best line; a bare copyright line
comes last. A document of which licence lines make up a large share, or licence bodies the half, is a licence file and
gives its licence to its directory; a document without a licence of its own takes that of the nearest ancestor directory
that has one, found by a join on directory paths. DataFrame operations alone.

Edge cases: a null or empty text has no line of its own and can only inherit; a null path has no directory; repeated
rows get the same result each; ties go to the licence first in the alphabet, and in a directory to the best line, then
the licence; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstar.llm import common

TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
THRESHOLD, FILE_SHARE = 0.5, 0.2
#: Words that many lines have.
COMMON = ("a", "all", "and", "by", "for", "in", "is", "of", "on", "that", "the", "this", "to", "under", "use", "with")
#: Headers as licences ask for them, by their SPDX names (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use permitted under the BSD 2-Clause License.",
    "BSD-3-Clause": "Redistribution and use permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution license, CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under the Creative Commons Attribution ShareAlike license, CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and distribute under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
    "Proprietary": "Copyright. All rights reserved.",
}
#: Words of a run, unmatched runs that a block bridges, runs that a block has at least, share of a text that makes bodies a licence file.
RUN, GAP, LEAST_RUNS, BODY_SHARE = 3, 15, 10, 0.5
TEXTS = Path(__file__).parent / "licence_texts"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()\- ]+)"


def directory(path: Column) -> Column:
    """A path without its last step; empty for one step."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.translate(line, common.UPPER, common.LOWER), F.lit(TOKEN), F.lit(0))


def header_vectors(templates: dict[str, str]) -> tuple[dict[str, float], dict[str, dict[str, float]], float]:
    """Weight of each word of the templates, their vectors (of length 1), and the weight of a word that none has."""
    counts = {k: Counter(re.findall(TOKEN, v.translate(str.maketrans(common.UPPER, common.LOWER)))) for k, v in templates.items()}
    often = Counter(t for c in counts.values() for t in c)
    weight = lambda n: math.log((len(templates) + 1.0) / (n + 1.0)) + 1.0
    words = {t: weight(n) for t, n in often.items()}
    norms = {k: math.sqrt(sum((n * words[t]) ** 2 for t, n in c.items())) for k, c in counts.items()}
    return words, {k: {t: n * words[t] / norms[k] for t, n in c.items()} for k, c in counts.items()}, weight(0)


def anchors(vectors: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Words of which each line that reaches the threshold has one: what they leave of a vector is shorter than it.

    Common words are left first, then those of small weight, as long as there is room.
    """
    found: set[str] = set()
    for vector in vectors.values():
        rest = 0.0
        for token, x in sorted(vector.items(), key=lambda e: (e[0] not in COMMON, e[1], e[0])):
            if rest + x * x <= (threshold - 1e-6) ** 2:
                rest += x * x
            else:
                found.add(token)
    return sorted(found)


def may_reach(rows: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """The rows of which the line may reach the threshold. Explosions of one array keep words from being found more than once."""
    words, vectors, unknown = header_vectors(templates)
    rows = rows.withColumn("_t", F.explode(F.array(tokens(F.col("line")))))
    rows = rows.withColumn("_s", F.explode(F.array(F.array_intersect("_t", F.array(*[F.lit(w) for w in sorted(words)])))))
    table = lambda m: F.create_map(*[F.lit(x) for kv in sorted(m.items()) for x in kv])
    idf, zero = table(words), F.lit(0.0)
    known = F.aggregate("_s", zero, lambda a, w: a + F.pow(F.size(F.filter("_t", lambda x: x == w)) * F.element_at(idf, w), F.lit(2.0)))
    total = lambda m: F.aggregate("_s", zero, lambda a, w: a + F.coalesce(F.try_element_at(table(m), w), zero))
    squares = [{t: x * x for t, x in v.items()} for v in vectors.values()]
    rest = (F.size(F.array_distinct("_t")) - F.size("_s")) * unknown * unknown
    enough = lambda share: share * known >= (threshold - 1e-6) ** 2 * (known + rest)
    of_any = total({w: max(s.get(w, 0.0) for s in squares) for w in words})  # quick to find: as if one template had the most of each word
    return rows.where((F.size("_s") > 0) & enough(of_any) & enough(F.greatest(*map(total, squares), zero))).drop("_t", "_s")


def licence_lines(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, path, _print, line, of each line with one of the words, and of its sentences with one if it has several, from whole texts.

    _whole and _part: counts among whole lines, among sentences.
    """
    has = r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in words) + r")(?![a-z0-9])"
    rows = docs.select("doc_id", "path", F.xxhash64("text").alias("_print"), F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(has))
    parts = F.split(F.regexp_replace("line", r"([.!?])\s+(\p{Lu})", "$1\u001e$2"), "\u001e")
    rows = rows.withColumn("_parts", parts)
    piece = lambda whole, part: lambda x: F.struct(x.alias("line"), F.lit(whole).alias("_whole"), F.lit(part).alias("_part"))
    line = F.array(F.col("line"))
    pieces = F.when(F.size("_parts") > 1, F.concat(F.transform(line, piece(True, False)), F.transform("_parts", piece(False, True)))).otherwise(F.transform(line, piece(True, True)))
    return rows.select("doc_id", "path", "_print", F.inline(pieces)).where(F.col("line").rlike(has))


def best_templates(lines: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """_line and _length of every distinct line that has a template at the threshold or over it, its licence, similarity, and _often it occurs."""
    words, vectors, unknown = header_vectors(templates)
    names = sorted(vectors)
    known = lines.sparkSession.createDataFrame([(t, w, [vectors[k].get(t, 0.0) for k in names]) for t, w in words.items()], "token string, idf double, shares array<double>")
    distinct = lines.groupBy("_line", "_length").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("_often"))
    terms = distinct.select("_line", "_length", "_often", F.explode(tokens(F.col("line"))).alias("token")).groupBy("_line", "_length", "_often", "token").agg(F.count(F.lit(1)).alias("tf"))
    terms = terms.join(F.broadcast(known), "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    dots = [F.sum(F.col("w") * F.coalesce(F.col("shares")[i], F.lit(0.0))) for i in range(len(names))]
    sums = terms.groupBy("_line", "_length", "_often").agg(F.sum(F.col("w") * F.col("w")).alias("square"), F.array(*dots).alias("dots"))
    best = F.array_min(F.array(*[F.struct((-F.round(F.col("dots")[i] / F.sqrt("square"), 9)).alias("s"), F.lit(k).alias("licence")) for i, k in enumerate(names)]))
    return sums.select("_line", "_length", "_often", best.alias("b")).select("_line", "_length", "_often", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("similarity")).where(F.col("similarity") >= threshold)


def spdx_tags(docs: DataFrame) -> DataFrame:
    """doc_id, path, _print and licence of each SPDX identifier; of an expression each one but exceptions."""
    expression = F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)))
    rows = docs.where(F.col("text").rlike(SPDX)).select("doc_id", "path", F.xxhash64("text").alias("_print"), expression.alias("e"))
    expression = F.regexp_replace("e", r"(?i)\bWITH +\S+", "")
    joined = F.regexp_replace(expression, r"[()]", " ")
    first = F.array(F.regexp_extract(joined, r"^\s*(\S+)", 1))
    more = F.regexp_extract_all(joined, F.lit(r"(?i)\b(?:AND|OR)\s+(\S+)"), F.lit(1))
    rows = rows.select("doc_id", "path", "_print", F.explode(F.array_union(first, more)).alias("licence"))
    rows = rows.withColumn("licence", F.regexp_replace("licence", r"(?i)(?:-only|-or-later|\+)$|[.\-]+$", ""))
    known = F.lit(None).cast("string")
    for name in sorted({*TEMPLATES, *(n for n, _, _ in block_templates())} - {"Proprietary"}):
        known = F.when(F.lower("licence") == name.lower(), F.lit(name)).otherwise(known)
    rows = rows.where(F.col("licence").rlike(r"^[A-Za-z0-9]") & ~F.upper("licence").isin("NONE", "NOASSERTION") & ~F.upper("licence").startswith("LICENSEREF"))
    return rows.select("doc_id", "path", "_print", F.coalesce(known, "licence").alias("licence"))


def block_templates() -> list[tuple[str, bool, str]]:
    """(licence, whether it is a body, text) of each file of licence_texts."""
    return [(p.stem.split(".header")[0], ".header" not in p.stem, p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt"))]


def block_vectors(found: list[tuple[str, bool, str]]) -> list[tuple]:
    """(words of a run, its weight, its share of each template's vector of length 1) of all runs of the templates."""
    counts = []
    for _, _, text in found:
        w = re.findall(TOKEN, text.translate(str.maketrans(common.UPPER, common.LOWER)))
        counts.append(Counter(zip(*(w[i:] for i in range(RUN)), strict=False)))
    often = Counter(r for c in counts for r in c)
    idf = {r: math.log((len(found) + 1.0) / (n + 1.0)) + 1.0 for r, n in often.items()}
    norms = [math.sqrt(sum((n * idf[r]) ** 2 for r, n in c.items())) for c in counts]
    return [(list(r), x, {i: c[r] * x / norms[i] for i, c in enumerate(counts) if r in c}) for r, x in idf.items()]


def word_weights(vectors: list[tuple], templates: int) -> dict[str, list[float]]:
    """For the longest word of each run: what the runs with it have of each template's squared length.

    By Cauchy and Schwarz a block's similarity isn't over the length of what the template's vector has of the block's runs. So a
    text in whose words these weights sum to less than the threshold's square, for each template, has no block that reaches it.
    """
    weights: dict[str, list[float]] = defaultdict(lambda: [0.0] * templates)
    for run, _, shares in vectors:
        for template, share in shares.items():
            weights[max(run, key=lambda w: (len(w), w))][template] += share * share
    return dict(weights)


def licence_blocks(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, path, _print, licence, similarity, words and is_body of each block that has a template at the threshold or over it."""
    found = block_templates()
    unknown = math.log(len(found) + 1.0) + 1.0  # weight of a run that no template has
    own = block_vectors(found)
    vectors = docs.sparkSession.createDataFrame(own, "run array<string>, idf double, shares map<int, double>")
    vectors = common.written(vectors.withColumn("key", F.xxhash64(*[F.col("run")[i] for i in range(RUN)])), "licence_vectors")  # as many rows as the templates have runs

    doc = ["doc_id", "path", "_print"]
    rows = docs.select("doc_id", "path", F.xxhash64("text").alias("_print"), tokens(F.col("text")).alias("_w")).where(F.size("_w") >= RUN)
    weights = word_weights(own, len(found))
    table = F.from_json(F.lit(json.dumps(weights)), "map<string, array<double>>")  # a constant of some 2000 words
    held = F.array_intersect("_w", F.split(F.lit(" ".join(sorted(weights))), " "))
    sums = F.aggregate(held, F.array_repeat(F.lit(0.0), len(found)), lambda a, w: F.zip_with(a, F.element_at(table, w), lambda x, y: x + y))
    rows = rows.where(F.array_max(sums) >= (threshold - 1e-6) ** 2)
    rows = rows.select(*doc, "_w", F.explode(F.sequence(F.lit(0), F.size("_w") - RUN)).alias("at"))
    here = [F.col("_w")[F.col("at") + i] for i in range(RUN)]
    known = F.broadcast(vectors.select("key", F.col("run").alias("_run")))
    same = F.xxhash64(*here) == F.col("key")
    for i in range(RUN):
        same = same & (here[i] == F.col("_run")[i])
    hits = rows.join(known, same).select(*doc, "at", F.col("_run").alias("run"))
    hits = hits.groupBy(*doc, "at", "run").agg(F.lit(1).alias("n"))  # repeated rows once
    by = Window.partitionBy(*doc).orderBy("at")
    hits = hits.withColumn("_b", F.lag("at").over(by)).withColumn("_a", F.lead("at").over(by)).where("_b = at - 1 or _a = at + 1")  # a single common run tells nothing
    hits = hits.withColumn("_new", F.coalesce(F.col("at") - F.lag("at").over(by) > GAP, F.lit(True)).cast("int")).withColumn("block", F.sum("_new").over(by))
    terms = hits.groupBy(*doc, "block", "run").agg(F.count(F.lit(1)).alias("tf"), F.min("at").alias("first"), F.max("at").alias("last"))
    terms = terms.join(F.broadcast(vectors), "run").withColumn("w", F.col("tf") * F.col("idf"))
    dots = [F.sum(F.col("w") * F.coalesce(F.element_at("shares", F.lit(i)), F.lit(0.0))) for i in range(len(found))]
    blocks = terms.groupBy(*doc, "block").agg(F.sum("tf").alias("runs"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.col("w") * F.col("w")).alias("square"), F.array(*dots).alias("dots"))
    blocks = blocks.where(F.col("runs") >= LEAST_RUNS).withColumn("span", F.col("last") - F.col("first") + 1)
    norm = F.sqrt(F.col("square") + (F.col("span") - F.col("runs")) * unknown * unknown)
    models = F.array(*[F.struct((-F.round(F.col("dots")[i] / norm, 9)).alias("s"), F.lit(name).alias("licence"), F.lit(body).alias("is_body")) for i, (name, body, _) in enumerate(found)])
    best = blocks.select(*doc, F.array_min(models).alias("b"), (F.col("span") + RUN - 1).alias("words"))
    return best.select(*doc, F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("similarity"), "words", F.col("b.is_body").alias("is_body")).where(F.col("similarity") >= threshold)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """doc_id, path, own_licence, similarity, licence (own or inherited), basis (header, file, inherited, none), from_directory."""
    templates = templates or TEMPLATES
    found = may_reach(licence_lines(docs, anchors(header_vectors(templates)[1], threshold)), templates, threshold)
    found = common.written(found.withColumn("_line", F.xxhash64("line")).withColumn("_length", F.length("line")), "licence_lines")  # the texts are cut once
    matched = common.written(best_templates(found, templates, threshold), "licences_of_lines")
    words, none = F.size(F.split("line", r"\s+")), F.lit(0)
    bare = F.when(F.col("licence") == "Proprietary", 3).otherwise(2)  # a copyright line says less than any named licence
    doc = ["doc_id", "path", "_print", "licence", "similarity"]
    key = F.concat_ws("/", "_line", "_length").alias("_key")
    lines = common.spread_join(found.select("*", key), matched.select(key, "licence", "similarity", "_often"), "_key", "_often", found.count())
    lines = lines.select(*doc, bare.alias("place"), F.when(F.col("_whole"), words).otherwise(none).alias("whole"), F.when(F.col("_part"), words).otherwise(none).alias("parts"), none.alias("body"))
    blocks = licence_blocks(docs, threshold).select(*doc, F.lit(1).alias("place"), none.alias("whole"), none.alias("parts"), F.when(F.col("is_body"), F.col("words")).otherwise(none).alias("body"))
    tags = spdx_tags(docs).withColumn("similarity", F.lit(1.0)).select(*doc, F.lit(0).alias("place"), none.alias("whole"), none.alias("parts"), none.alias("body"))
    by_doc = lines.unionByName(blocks).unionByName(tags).groupBy("doc_id", "path", "_print").agg(F.min(F.struct("place", (-F.col("similarity")).alias("s"), "licence")).alias("b"), F.greatest(F.sum("whole"), F.sum("parts")).alias("_words"), F.sum("body").alias("_body"))
    own = by_doc.select(F.col("doc_id").alias("_id"), F.col("path").alias("_path"), "_print", F.col("b.licence").alias("own_licence"), (-F.col("b.s")).alias("similarity"), "_words", "_body")
    rows = docs.select("doc_id", "path", F.xxhash64("text").alias("_p"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")) & (F.col("_p") == F.col("_print"))
    is_file = ((F.col("_words") > 0) & (F.col("_words") >= F.col("n_words") * file_share)) | ((F.col("_body") > 0) & (F.col("_body") >= F.col("n_words") * BODY_SHARE))
    rows = rows.join(own, same, "left").select("doc_id", "path", "own_licence", "similarity", is_file.alias("is_file"), directory(F.col("path")).alias("directory"))
    rows = common.written(rows, "own_licences")
    given = rows.where("is_file and directory is not null").groupBy("directory").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "own_licence")).alias("b")).select(F.col("directory").alias("ancestor"), F.col("b.own_licence").alias("given"))
    steps = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    nearest = rows.where("own_licence is null and directory is not null").select("directory").distinct().withColumn("ancestor", F.explode(F.array_distinct(above))).join(given, "ancestor")
    nearest = nearest.groupBy("directory").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "given")).alias("x")).select("directory", F.col("x.ancestor").alias("from_directory"), F.col("x.given").alias("given"))
    every = rows.where("directory is not null").groupBy("directory").agg(F.count(F.lit(1)).alias("_files")).join(nearest, "directory", "left")
    out = common.spread_join(rows, common.written(every, "directories"), "directory", "_files", rows.count())
    out = out.unionByName(rows.where("directory is null"), allowMissingColumns=True)
    has = F.col("own_licence").isNotNull()
    basis = F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", "own_licence", "similarity", F.coalesce("own_licence", "given").alias("licence"), basis.alias("basis"), F.when(~has, F.col("from_directory")).alias("from_directory"))
