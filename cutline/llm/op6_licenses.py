"""Licence scan: sparse TF-IDF cosine to templates, and inheritance from the nearest ancestor directory.

Every whole text is read for windows that look like a template's words, or those of a full text of at most WINDOW_WORDS.
A window has the template's number of words, or all words of a shorter text; its score is the cosine of TF-IDF vectors.
None of at least LEAST is lost: a template has a few words of which any such window has one (without them, what is left
of its vector is too short), and every window around each occurrence of those is scored. Document frequencies of the templates' words come from the whole
corpus; words that no template has weigh as if no document had them, which only lowers a score. A file's licence is that
of its best window of at least LEAST that isn't inside of one of twice its words, unless the whole file has a cosine of at least LEAST to a full licence text
(`licences/`): then it is that text's, except that the header of a licence without a text here goes first.

A licence file is one with a licence and a name such as LICENSE or COPYING, one that is like a full text as a whole, or
one most of whose words are in the window.

Files without a licence of their own take that of the licence files in the nearest directory above them (or their own
directory). Directories, not files, are joined with their ancestors, so a directory of a third of all files costs what
any other does; the files are then joined with their directories, by broadcast if there are at most BROADCAST_DIRS
that have a licence to give, else by look_up(), so that the files of one directory need not meet in one task.

Null texts count as empty, null paths have no directory and inherit nothing. Ties take the licence's name, then the
path. Texts of any length are read whole; `keep` must not name columns that the result has; other columns aren't read. The best other licence that overlaps the found one is the runner-up, and the find is ambiguous if their scores
differ by CLOSE at most: a BSD notice without the rest of the text is. Repeated rows give repeated results. An empty table gives no rows.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import look_up, map_rows, small, table, text_or_empty, write_shared

#: Notices of public licences, by SPDX identifier.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-1.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-2.0", "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0", "it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.0", "it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Licences whose full texts are in `licences/`, without lines that name a holder.
FULL_TEXTS = ("0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")
#: File names of licence files, in lower case: LICENSE, LICENCE.md, LICENSE-MIT, MIT-LICENSE.txt, COPYING.LESSER, UNLICENSE ...
LICENCE_NAME = r"^(.*[-_.])?(un)?(licen[sc]es?|copying|copyright)([-_. ].*)?$"
NOT_LICENCE_NAME = r"\.(py|js|ts|tsx|jsx|java|c|cc|cpp|h|hpp|go|rs|rb|php|cs|swift|kt|scala|sh|pl|lua|sql|json|ya?ml|toml|xml|css)$"
WORDS = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
LEAST, MOST_OF, WINDOW_WORDS = 0.85, 0.5, 400
#: Words in more than this part of the documents come last among those that a text is searched for.
COMMON = 0.02
#: A runner-up whose score is less by this at most makes a find ambiguous.
CLOSE = 0.01
BROADCAST_DIRS = 20_000


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def full_texts() -> list[tuple[str, list[str]]]:
    return [(name, words_of(pkgutil.get_data(__package__, f"licences/{name}.txt").decode())) for name in FULL_TEXTS]


def document_frequencies(texts: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of rows, and of those with each word of the templates; texts: one column."""
    vocabulary = frozenset(w for _, t in TEMPLATES for w in words_of(t)).union(*(words for _, words in full_texts()))

    def task(batches):
        import pyarrow as pa

        n: Counter = Counter()
        for batch in batches:
            n[""] += batch.num_rows
            for t in batch.column(0):
                n.update(vocabulary.intersection(words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["w", "n"])

    found = {r[0]: r[1] for r in texts.mapInArrow(task, "w string, n long").groupBy("w").agg(F.sum("n")).collect()}
    return found.pop("", 0), found


class Matcher:
    def __init__(self, n: int, frequency: dict[str, int]):
        self.rare = math.log(n + 1) + 1
        full = full_texts()
        self.idf = {w: math.log((n + 1) / (frequency.get(w, 0) + 1)) + 1 for words in [*(words_of(t) for _, t in TEMPLATES), *(words for _, words in full)] for w in words}
        self.common = {w for w in self.idf if frequency.get(w, 0) > COMMON * n}
        self.by_anchor: dict[str, list] = {}
        self.templates = []
        for name, words in [*((name, words_of(text)) for name, text in TEMPLATES), *(x for x in full if len(x[1]) <= WINDOW_WORDS)]:
            vector, norm = self.vector(words)
            for w in self.needed(vector, norm):
                self.by_anchor.setdefault(w, []).append(len(self.templates))
            self.templates.append((name, len(words), vector, norm))
        self.full = [(name, *self.vector(words), self.needed(*self.vector(words))) for name, words in full]
        self.hints = sorted(set(self.by_anchor).union(*(x[3] for x in self.full)))

    def vector(self, words: list[str]) -> tuple[dict[str, float], float]:
        vector = {w: k * self.idf[w] for w, k in Counter(words).items()}
        return vector, math.sqrt(sum(v * v for v in vector.values()))

    def needed(self, vector: dict[str, float], norm: float) -> frozenset[str]:
        """Words of which any text with a cosine of at least LEAST has one: without them, the rest of the vector is too short."""
        found, left = [], norm * norm
        for w in sorted(vector, key=lambda w: (w in self.common, -vector[w], w)):
            if left < (LEAST - 1e-6) ** 2 * norm * norm:
                break
            found.append(w)
            left -= vector[w] ** 2
        return frozenset(found)

    def whole(self, words: list[str]) -> list[tuple[float, str]]:
        """(-score, licence) of the full texts that the words as a whole are like, best first."""
        counts = Counter(words)
        near = [x for x in self.full if not x[3].isdisjoint(counts)]
        if not near:
            return []
        square = sum((k * self.idf.get(w, self.rare)) ** 2 for w, k in counts.items())
        found = []
        for name, vector, norm, _ in near:
            dot = sum(v * counts[w] * self.idf[w] for w, v in vector.items() if w in counts)
            found.append((-round(dot / (norm * math.sqrt(square)), 9), name))
        return sorted(x for x in found if -x[0] >= LEAST)

    def score(self, words: list[str], vector: dict[str, float], norm: float) -> float:
        dot = square = 0.0
        for w, k in Counter(words).items():
            v = k * self.idf.get(w, self.rare)
            square += v * v
            dot += v * vector.get(w, 0.0)
        return dot / (norm * math.sqrt(square)) if square else 0.0

    def best_window(self, words: list[str], ats: list[int], size: int, vector: dict[str, float], norm: float) -> tuple[float, int, int] | None:
        """(score, start, end) of the first best window of at least LEAST that has one of the words at `ats`, which are in order.

        The window slides: a word that comes or goes changes its square and its product with the template by one term.
        """
        last, found, idf, rare, limit = max(0, len(words) - size), None, self.idf, self.rare, (LEAST - 1e-6) ** 2 * norm * norm
        done = -1
        for at in ats:
            low, high = max(0, at - size + 1, done + 1), min(at, last)
            if low > high:
                continue
            if low != done + 1 or done < 0:
                counts, dot, square = {}, 0.0, 0.0
                for w in words[low : low + size]:
                    v, k = idf.get(w, rare), counts.get(w, 0)
                    counts[w], square, dot = k + 1, square + (2 * k + 1) * v * v, dot + v * vector.get(w, 0.0)
                begin = low
            else:
                begin = done
            for start in range(begin, high + 1):
                if start > begin:
                    out, new = words[start - 1], words[start + size - 1]
                    if out != new:
                        v, k = idf.get(out, rare), counts[out]
                        counts[out], square, dot = k - 1, square - (2 * k - 1) * v * v, dot - v * vector.get(out, 0.0)
                        v, k = idf.get(new, rare), counts.get(new, 0)
                        counts[new], square, dot = k + 1, square + (2 * k + 1) * v * v, dot + v * vector.get(new, 0.0)
                if dot > 0 and dot * dot >= limit * square:
                    score = round(self.score(words[start : start + size], vector, norm), 9)
                    if score >= LEAST and (found is None or score > found[0]):
                        found = (score, start, min(start + size, len(words)))
            done = high
        return found

    def best(self, text: str) -> tuple[str, float, int, int, float] | None:
        """(licence, score, start, end in code points, share of the words, next best licence, its score, whether they are close) of the best window or the whole text."""
        low = text.lower()
        if not any(h in low for h in self.hints):
            return None
        spans = [m.span() for m in WORDS.finditer(low)]
        words = [low[a:b] for a, b in spans]
        anchored: dict[int, list[int]] = {}
        for at, w in enumerate(words):
            for k in self.by_anchor.get(w, ()):
                anchored.setdefault(k, []).append(at)
        got = [(k, *x) for k, ats in anchored.items() if (x := self.best_window(words, ats, *self.templates[k][1:]))]
        got = [x for x in got if not any(y[2] <= x[2] and x[3] <= y[3] and y[3] - y[2] >= 2 * (x[3] - x[2]) for y in got)]
        found, others, first = None, {}, None
        for k, score, start, end in got:
            name, size, at, last = *self.templates[k][:2], spans[start][0], spans[end - 1][1]
            key = (-score, -size, name, start)
            if name not in others or others[name][0] < score:
                others[name] = (score, at, last)
            if first is None or key < first:
                first, found = key, (key, name, score, at, last, (end - start) / len(words))
        whole = self.whole(words)
        if whole and (found is None or found[1] in FULL_TEXTS or found[2] < -whole[0][0]):
            found = (None, whole[0][1], -whole[0][0], spans[0][0], spans[-1][1], 1.0)
            others = {name: (-score, *found[3:5]) for score, name in whole}
        if found is None:
            return None
        same = len(low) == len(text)  # a few letters grow in lower case; then the span is that of the lower-case text
        # other licences where the found one stands; those of other places are licences of their own
        rest = [(-x[0], name) for name, x in others.items() if name != found[1] and x[1] < found[4] and found[3] < x[2]]
        score, other = min(rest, default=(None, None))
        return (found[1], found[2], found[3], found[4] if same else min(found[4], len(text)), found[5], other, None if other is None else -score, other is not None and found[2] + score <= CLOSE)


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, path, licence, score, start, end, origin ('own', 'inherited' or null), licence_path, and the own licence's runner_up, runner_up_score, ambiguous for each row of files."""
    texts = files.select(text_or_empty(text_col).alias("t"))
    n, frequency = document_frequencies(texts)

    def make():
        matcher = Matcher(n, frequency)

        def each(*cols):
            got = [matcher.best(t) or (None,) * 8 for t in cols[-1]]
            return [*cols[:-1], *map(list, zip(*got, strict=True))] if got else [*cols[:-1], *[[]] * 8]

        return each

    kinds = dict(files.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (*keep, path_col)] + ["licence string, score double, start int, end int, share double, runner_up string, runner_up_score double, ambiguous boolean"])
    own, _ = write_shared(map_rows(files.select(*keep, path_col, text_or_empty(text_col).alias("t")), make, schema).withColumnRenamed(path_col, "path"), "licences")
    own = own.withColumn("dir", F.when(F.col("path").isNotNull(), F.regexp_replace("path", "/?[^/]*$", "")))
    name = F.lower(F.regexp_extract("path", "[^/]*$", 0))
    named = name.rlike(LICENCE_NAME) & ~name.rlike(NOT_LICENCE_NAME)
    givers = (
        own.where(F.col("licence").isNotNull() & (named | (F.col("share") >= MOST_OF)) & F.col("dir").isNotNull())
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "licence", "path")).alias("best"))
        .select(F.col("dir").alias("above"), F.col("best")["licence"].alias("given"), F.col("best")["path"].alias("giver"))
    )
    dirs = own.where(F.col("licence").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.when(F.col("dir") == "", F.lit("")).otherwise(F.array_join(F.slice(parts, 1, k), "/")))
    nearest = (
        dirs.select("dir", F.posexplode(ancestors).alias("depth", "above"))
        .join(givers, "above")
        .groupBy("dir")
        .agg(F.max_by(F.struct("given", "giver"), "depth").alias("from"))
        .select(F.col("dir").alias("_dir"), F.col("from")["given"].alias("given"), F.col("from")["giver"].alias("giver"))
    )
    rows = small(nearest, BROADCAST_DIRS)
    open_ = F.when(F.col("licence").isNull(), F.col("dir"))
    if rows is not None:
        placed = own.join(F.broadcast(files.sparkSession.createDataFrame(rows, nearest.schema)), open_ == F.col("_dir"), "left")
    else:
        sizes = own.where("licence is null").groupBy("dir").agg(F.count("*").alias("n"))
        known, _ = write_shared(nearest.join(sizes, F.col("_dir") == F.col("dir")).select(F.col("_dir").alias("k"), "n", "given", "giver"), "licence-dirs")
        placed = look_up(own.withColumn("open_dir", open_), "open_dir", known, ["path", *keep]).withColumn("given", F.col("found")["given"]).withColumn("giver", F.col("found")["giver"])
    inherits = F.col("licence").isNull() & F.col("given").isNotNull()
    return placed.select(
        *keep,
        "path",
        F.coalesce("licence", "given").alias("licence"),
        "score",
        "start",
        "end",
        F.when(F.col("licence").isNotNull(), "own").when(inherits, "inherited").alias("origin"),
        F.when(F.col("licence").isNotNull(), F.col("path")).when(inherits, F.col("giver")).alias("licence_path"),
        "runner_up",
        "runner_up_score",
        "ambiguous",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document. A document's path is its source, its id in thousands, and its id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"), keep=("doc_id",))
