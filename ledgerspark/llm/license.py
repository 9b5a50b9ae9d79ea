"""Licence scan: a trained paragraph classifier with template comparison.

Every paragraph between blank lines and every single line is scored, by logistic regressions over sparse word one- and
two-grams: one tells licences of all families from ordinary prose, a multinomial one tells the families apart.  They are trained on the
corpus itself, on lines that contain a family's known wording and on prose.  What looks like a licence but like no family in
particular is ``unknown``; both limits are calibrated on families and prose that were held out of the fit.  Predictions are
compared with the family's templates.

All n-grams of the model hold a word of the templates that is rare in prose.  A text without any such word has no feature
in any line, so its score is that of a line without features, and it is left out before it is split; this loses nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import cut, hash_sample, table

#: Usual wordings of licence statements, by SPDX identifier of the family.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This project is distributed under the Apache License 2.0.", "Apache License 2.0", "Lizenziert unter der Apache-Lizenz, Version 2.0.", "Sous licence Apache, version 2.0.", "Bajo la licencia Apache, versión 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["MIT License", "Released under the MIT License.", "This software is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "GPL v3", "GPLv3", "GNU GPL 3.0", "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "BSD-3-Clause": ["BSD License", "Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["Mozilla Public License 2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["CC0 1.0 Universal", "Dedicated to the public domain.", "This work is dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "EPL-2.0": ["EPL 2.0", "Provided under the terms of the EPL 2.0.", "Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "EUPL-1.2": ["EUPL 1.2", "Licensed under the EUPL.", "Provided under the terms of the EUPL.", "European Union Public Licence 1.2", "SPDX-License-Identifier: EUPL-1.2"],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Tous droits reserves.", "Todos los derechos reservados."],
}
#: Wordings of licences, and of versions, that are none of the families; they are learned as a class of their own, ``unknown``.
OTHERS = [
    "GNU General Public License, version 2", "GPL v2", "GPLv2", "GNU Affero General Public License, version 3", "AGPL-3.0", "GNU Lesser General Public License, version 2.1", "Apache License 1.1", "Apache Software License", "Mozilla Public License 1.1", "MPL 1.1",
    "Eclipse Public License 1.0", "EPL 1.0", "CC BY 3.0", "Creative Commons Attribution 3.0", "EUPL v1.1", "EUPL 1.1", "BSD 2-Clause License", "ISC License", "zlib License", "Boost Software License", "WTFPL", "Artistic License 2.0",
    "The Unlicense", "Unlicense", "Public domain.", "Released into the public domain.", "This is free and unencumbered software released into the public domain.", "Licencia publica general", "Licencia pública general", "Licence publique générale", "Allgemeine öffentliche Lizenz",
]
NONE, UNKNOWN = "none", "unknown"
#: Fixed value: words behind which a number is a version.
VERSION = r"(?i)(?:licen[sc]e|lizenz|licencia|identifier|version|versión|gpl|mpl|epl|eupl|apache|cc0|by|sa|nc|attribution|sharealike|noncommercial|bsd)[\s,:;-]*(?:version|versión|v)?[\s.]*(\d{1,2}(?:\.\d{1,2})?)"
#: Words of a template that must stand together to confirm it: all of up to so many, of longer ones so many tenths.
TOGETHER, TOGETHER_SHARE = 4, 6
#: Bounds of the training sample (lines of a family, lines of prose, documents that these come from) and of the vocabulary.
MAX_PER_CLASS, MAX_NONE, SAMPLE_DOCS, VOCABULARY = 200, 4000, 500, 4096
#: Words found in a larger share of the lines of prose are no gate words.
MOST_IN_PROSE = 0.01
#: Least share of a template's n-grams that confirms a prediction, and parts that families are dealt to for calibration.
CONFIRM, FOLDS = 0.5, 3
#: Of held-out prose with any feature at most this share may pass for a licence, and of held-out families for another family.
PROSE_THROUGH, OTHERS_THROUGH = 0.01, 0.05
#: Range of the least probability of being a licence at all, and of the least share of it that the best family must have.
LICENCE_CUT, FAMILY_CUT = (0.5, 0.9), (0.5, 0.9)
_WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}.+-]*[\p{L}\p{N}+-])?"


def words(text: Column) -> Column:
    """Lower-case words of a text; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def with_grams(rows: DataFrame) -> DataFrame:
    """Add ``grams``: distinct one- and two-grams of the words of column ``line``."""
    n = F.greatest(F.size("__words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("__words", F.lit(1), n), F.slice("__words", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return rows.withColumn("__words", words(F.col("line"))).withColumn("grams", F.array_distinct(F.concat("__words", pairs))).drop("__words")


def units(docs: DataFrame) -> DataFrame:
    """All that is scored: ``doc_id``, ``unit``, ``paragraph`` and ``line``.  Null and empty texts have none.

    ``unit`` is ``line`` or ``paragraph``; ``paragraph`` is the number (from 0) of the line, or of the paragraph between blank
    lines.  A paragraph of one line is scored as a line only.
    """
    parts = lambda unit, c: F.transform(c, lambda x, i: F.struct(F.lit(unit).alias("unit"), i.alias("paragraph"), x.alias("line")))
    text = F.col("text")
    both = F.concat(parts("line", F.split(text, "\n")), parts("paragraph", F.split(text, r"\n(?:[ \t\r]*\n)+")))
    split = docs.select("doc_id", F.inline(both))
    return split.where(F.rlike("line", F.lit(r"[\p{L}\p{N}]")) & ((F.col("unit") == "line") | F.rlike("line", F.lit(r"\S[ \t\r]*\n\s*\S"))))


@dataclass
class LicenceModel:
    classes: list[str]
    gate: list[str]
    vocabulary: CountVectorizerModel
    licences: LogisticRegressionModel
    regression: LogisticRegressionModel
    licence_cut: float
    family_cut: float


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, line string")


def other_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(UNKNOWN, t) for t in OTHERS], "family string, line string")


def template_words(spark: SparkSession) -> dict[str, list[str]]:
    """Words of each template, in order."""
    return {r["line"]: r["w"] for r in templates(spark).select("line", words(F.col("line")).alias("w")).collect()}


def stands_together(line: Column, template: list[str]) -> Column:
    """Whether enough words of a template stand in a line one after the other; ``line`` is its words, joined and framed by blanks."""
    size = len(template) if len(template) <= TOGETHER else max(TOGETHER, -(-len(template) * TOGETHER_SHARE // 10))
    runs = {" ".join(template[i : i + size]) for i in range(len(template) - size + 1)}
    found = F.lit(False)
    for run in sorted(runs):
        found = found | F.contains(line, F.lit(f" {run} "))
    return found


def version_of(family: str) -> str | None:
    """The version in a family's identifier, without a trailing ``.0``; null for families without versions."""
    number = next((x for x in family.split("-") if x[0].isdigit()), None)
    return number.removesuffix(".0") if number else None


def other_version(line: Column, family: Column) -> Column:
    """Whether a line names versions, and none of them is the family's."""
    named = F.transform(F.regexp_extract_all(line, F.lit(VERSION), F.lit(1)), lambda v: F.regexp_replace(v, r"\.0$", ""))
    own = F.lit(None).cast("string")
    for f in TEMPLATES:
        if version := version_of(f):
            own = F.when(family == f, version).otherwise(own)
    return F.coalesce((F.size(named) > 0) & ~F.array_contains(named, own), F.lit(False))


def template_grams(spark: SparkSession) -> list[tuple[str, str, list[str]]]:
    """Family, text and n-grams of each template."""
    return sorted(tuple(r) for r in with_grams(templates(spark)).select("family", "line", "grams").collect())


def telling(known: list[tuple[str, str, list[str]]]) -> dict[str, list[str]]:
    """By template, the words that tell it from other families: those of no other family's templates (its name), and numbers (its version)."""
    families: dict[str, set[str]] = {}
    for family, _, grams in known:
        for g in grams:
            families.setdefault(g, set()).add(family)
    return {line: sorted(g for g in grams if " " not in g and (len(families[g]) == 1 or any(c.isdigit() for c in g))) for _, line, grams in known}


def family_of() -> Column:
    """Family of the template that column ``line`` holds as a whole; null without one."""
    label = F.lit(None).cast("string")
    for family, texts in TEMPLATES.items():
        for text in texts:
            label = F.when(F.contains(F.lower("line"), F.lit(text.lower().rstrip("."))), F.lit(family)).otherwise(label)
    return label


def near_bound(labelled: DataFrame, limit: int) -> DataFrame:
    """Of each family, the rows in the hash share that holds about twice ``limit`` of them, with their ``place``; all of a small one."""
    n = labelled.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    whole = F.lit(1 << 30).cast("long")
    bound = F.when(F.col("n") <= 2 * limit, whole).otherwise(F.ceil(F.lit(float((1 << 30) * 2 * limit)) / F.col("n")))
    placed = labelled.withColumn("place", F.pmod(F.xxhash64("line"), whole))
    return placed.join(F.broadcast(n.select("family", bound.alias("bound"))), "family").where("place < bound").drop("bound")


def family_sample(labelled: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` lines of each family, the first in hash order; no task holds more than about twice that of a family."""
    order = Window.partitionBy("family").orderBy("place", "line")
    return near_bound(labelled, limit).withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).select("family", "line")


def prose(docs: DataFrame) -> DataFrame:
    """Lines and paragraphs without a template of the first ``SAMPLE_DOCS`` documents in hash order, at most ``MAX_NONE``: ``family`` (``none``) and ``line``."""
    first = hash_sample(docs.where("text is not null").select("doc_id", "text"), SAMPLE_DOCS, "doc_id", "text")
    plain = units(first).select("line").distinct().withColumn("family", family_of()).where("family is null")
    return cut(plain.orderBy(F.xxhash64("line"), "line").limit(MAX_NONE).select(F.lit(NONE).alias("family"), "line"))


def gate_words(negative: DataFrame) -> list[str]:
    """Words of templates that at most ``MOST_IN_PROSE`` of the lines of prose have; of a template without any, the rarest one."""
    others = with_grams(other_licences(negative.sparkSession)).select("family", "line", "grams").collect()
    known = [(f, t, [g for g in grams if " " not in g]) for f, t, grams in [*template_grams(negative.sparkSession), *sorted(map(tuple, others))]]
    every = sorted({w for _, _, ws in known for w in ws})
    lines = negative.count()
    hit = F.array_intersect(words(F.col("line")), F.array(*map(F.lit, every)))
    seen = {r["w"]: r["count"] for r in negative.select(F.explode(hit).alias("w")).groupBy("w").count().collect()}
    rare = {w for w in every if seen.get(w, 0) <= MOST_IN_PROSE * lines}
    return sorted(rare | {min(ws, key=lambda w: (seen.get(w, 0), w)) for _, _, ws in known if not rare & set(ws)})


def through_gate(docs: DataFrame, gate: list[str]) -> DataFrame:
    """Documents with any gate word."""
    return docs.where(with_gate_word("text", gate))


def with_gate_word(column: str, gate: list[str]) -> Column:
    return F.arrays_overlap(words(F.col(column)), F.array(*map(F.lit, gate)))


def train(docs: DataFrame, candidates: DataFrame | None = None, negative: DataFrame | None = None, gate: list[str] | None = None) -> LicenceModel:
    """Fit the classifier on a bounded sample of lines of ``docs`` and on the templates.

    Positives are distinct lines that contain a whole template, at most ``MAX_PER_CLASS`` a family in hash order, and the
    templates themselves; negatives are ``prose``; families weigh alike, and prose as all of them together.  Being a licence is learned
    from copies of the positives without their names and versions too.  Families and prose are dealt
    to ``FOLDS`` parts.  Models fitted without one part score it: the limit of being a licence lets
    ``PROSE_THROUGH`` of the prose with features through, the limit of the best family's share ``OTHERS_THROUGH`` of the families
    that the model does not know; both stay within a range.
    """
    spark = docs.sparkSession
    negative = prose(docs) if negative is None else negative
    gate = gate_words(negative) if gate is None else gate
    candidates = cut(through_gate(docs.select("doc_id", "text"), gate)) if candidates is None else candidates
    lines = candidates.select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    positive = family_sample(cut(lines.withColumn("family", family_of()).where("family is not null and length(line) < 2000")), MAX_PER_CLASS)
    both = positive.unionByName(templates(spark)).unionByName(other_licences(spark)).unionByName(negative)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("family")).cast("long") - 1
    fold = F.when(F.col("family") != UNKNOWN, F.pmod(F.when(F.col("family") == NONE, F.xxhash64("line")).otherwise(number), F.lit(FOLDS))).otherwise(F.lit(-1).cast("long"))
    # A few thousand rows in one order: the fit is the same each time.
    sample = cut(with_grams(both).withColumns({"number": number, "fold": fold}).coalesce(1).sortWithinPartitions("family", "line"))
    own = F.filter("grams", lambda g: F.arrays_overlap(F.split(g, " "), F.array(*map(F.lit, gate))))
    sample = sample.withColumn("grams", own)
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, binary=True, minDF=1.0).fit(sample.where(F.col("family") != NONE))
    sample = cut(vocabulary.transform(sample))
    sizes = {r["family"]: r["count"] for r in sample.groupBy("family").count().collect()}

    weight = F.lit(float(len(classes))) / max(1, sizes.get(NONE, 0))
    for family in classes:
        weight = F.when(F.col("family") == family, 1.0 / max(1, sizes.get(family, 0))).otherwise(weight)
    # What licences have in common is learned from copies without the words that tell families apart.
    names = sorted({w for ws in telling(template_grams(spark)).values() for w in ws})
    common = F.filter("grams", lambda g: ~F.arrays_overlap(F.split(g, " "), F.array(*map(F.lit, names))))
    nameless = sample.where(F.col("family") != NONE).withColumn("grams", common).where("size(grams) > 0").drop("features")
    sample = sample.withColumn("nameless", F.lit(False)).unionByName(vocabulary.transform(nameless).withColumn("nameless", F.lit(True)))
    sample = cut(sample.withColumn("weight", weight * 100).coalesce(1).sortWithinPartitions("family", "line", "nameless"))

    def fitted(rows: DataFrame, known: list[str] | None = None) -> LogisticRegressionModel:
        """Licences against prose, or, with the families ``known``, these against each other."""
        label = (F.col("family") != NONE).cast("double") if known is None else (F.array_position(F.array(*map(F.lit, known)), F.col("family")) - 1).cast("double")
        rows = rows.withColumn("label", label).where("label >= 0" if known is None else "label >= 0 and not nameless")
        kind = "binomial" if known is None else "multinomial"
        return LogisticRegression(maxIter=25, regParam=0.002, family=kind, weightCol="weight").fit(rows)

    held = None
    for k in range(FOLDS):
        rest, part = sample.where(F.col("fold") != k), sample.where((F.col("fold") == k) & ~F.col("nameless"))
        scored = shares(part, fitted(rest), fitted(rest, [c for i, c in enumerate(classes) if i % FOLDS != k or c == UNKNOWN])).select("family", "licence", "share", "features")
        held = scored if held is None else held.unionByName(scored)
    some = F.exists(vector_to_array("features"), lambda v: v > 0)
    prose_cut, other_cut = held.where(some).agg(
        F.percentile(F.when(F.col("family") == NONE, F.col("licence")), F.lit(1 - PROSE_THROUGH)),
        F.percentile(F.when(F.col("family") != NONE, F.col("share")), F.lit(1 - OTHERS_THROUGH)),
    ).first()
    bounded = lambda x, span: span[0] if x is None else min(max(x, span[0]), span[1])
    return LicenceModel(classes, gate, vocabulary, fitted(sample), fitted(sample, classes), bounded(prose_cut, LICENCE_CUT), bounded(other_cut, FAMILY_CUT))


def shares(rows: DataFrame, licences: LogisticRegressionModel, families: LogisticRegressionModel) -> DataFrame:
    """Add ``licence`` (probability of being one), ``share`` (of the likeliest family, if it is one), ``place`` (that family's, from 1) to rows with ``features``."""
    first = licences.transform(rows).withColumn("licence", F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")
    second = families.transform(first).withColumn("p", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
    named = second.withColumn("share", F.array_max("p"))
    return named.withColumn("place", F.array_position("p", F.col("share")).cast("int")).drop("p")


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """Licence lines and paragraphs of whole texts: ``doc_id``, ``unit``, ``paragraph``, ``family``, ``probability``, ``similarity``, ``confirmed``, ``line``.

    ``docs`` has ``doc_id`` and ``text``; other columns are not looked at.  Null, empty and blank texts have no row, a null id is kept;
    repeated rows are all scanned; an empty table gives no rows.  Lines and paragraphs that the classifier takes for prose are left out.
    ``probability`` is that of the likeliest family; ``family`` is ``unknown`` where no family's share is large enough, the likeliest is another licence, or the line names other versions only.  ``similarity`` is the greatest
    share of a template's n-grams, among the templates of the likeliest family, that the line has; ``confirmed`` says that a template
    has ``CONFIRM`` of them there, all the words that tell it from other families (its name and its version), and enough of its words in one run.
    """
    # All n-grams of the vocabulary hold a gate word, and all gate words are in it, so these are the lines with features.
    found = units(through_gate(docs.select("doc_id", "text"), model.gate)).where(with_gate_word("line", model.gate))
    featured = model.vocabulary.transform(with_grams(found))
    scored = shares(featured, model.licences, model.regression).where(F.col("licence") >= model.licence_cut)
    scored = scored.withColumn("guess", F.element_at(F.array(*map(F.lit, model.classes)), F.col("place")))
    known, in_order = template_grams(docs.sparkSession), template_words(docs.sparkSession)
    tells, similar, sure = telling(known), {}, {}
    scored = scored.withColumn("__said", F.concat(F.lit(" "), F.array_join(words(F.col("line")), " "), F.lit(" ")))
    for family, line, own in known:
        have = F.size(F.array_intersect("grams", F.array(*map(F.lit, own)))) / len(own)
        named = F.size(F.array_intersect("grams", F.array(*map(F.lit, tells[line])))) == len(tells[line]) if tells[line] else F.lit(False)
        similar.setdefault(family, []).append(have)
        sure.setdefault(family, []).append((have >= CONFIRM) & named & stands_together(F.col("__said"), in_order[line]))
    similarity, confirmed = F.lit(0.0), F.lit(False)
    for family in similar:
        any_of = F.lit(False)
        for c in sure[family]:
            any_of = any_of | c
        similarity = F.when(F.col("guess") == family, F.greatest(F.lit(0.0), *similar[family])).otherwise(similarity)
        confirmed = F.when(F.col("guess") == family, any_of).otherwise(confirmed)
    clear = (F.col("share") >= model.family_cut) & (F.col("guess") != UNKNOWN) & ~other_version(F.col("line"), F.col("guess"))
    return scored.select("doc_id", "unit", "paragraph", F.when(clear, F.col("guess")).otherwise(F.lit(UNKNOWN)).alias("family"), F.round(F.col("licence") * F.col("share"), 6).alias("probability"), F.round(similarity, 6).alias("similarity"), (clear & confirmed).alias("confirmed"), "line")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence lines and paragraphs of all documents; see ``scan``.  The documents are read for a sample, and once as a whole for the gate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    negative = prose(docs)
    gate = gate_words(negative)
    candidates = cut(through_gate(docs, gate))
    return scan(candidates, train(docs, candidates, negative, gate))
