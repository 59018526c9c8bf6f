"""License scan: parts of a text against license templates by the Dice coefficient over word bigrams.

A text is looked at line by line, and again in blocks between blank lines where a block has several lines.  Words are runs of
ASCII letters and digits, A-Z lower-cased; a part counts by the set of its pairs of neighbouring words.  Dice is twice the number of common pairs over
the sum of both sizes, so only templates whose size lies within fixed factors of the part's size can reach the least score: each template stands
in a table once per size it can match, and a part meets the templates of its own size by an equality of sizes.

Only Column expressions run here and no row leaves its task.  Edge cases: null and empty texts and parts of fewer than two words
match nothing; a template is reported for each part that matches it, every template above the score if several do; rows that repeat are reported
each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

#: Notices and standard paragraphs of common licenses.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                   "See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Least score in percent.
PERCENT = 80


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(held: Column) -> Column:
    """Hashes of the distinct pairs of neighbouring words."""
    return F.array_distinct(F.zip_with(F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))), F.slice(held, F.lit(2), F.greatest(F.size(held) - 1, F.lit(0))),
                                       lambda a, b: F.xxhash64(a, b)))


def template_sizes(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row per template and size of a part that can reach the score: a fixed small table."""
    made = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, body string")
    made = made.select("template", "license", bigrams(words(F.col("body"))).alias("wanted")).withColumn("n_wanted", F.size("wanted")).filter("n_wanted > 0")
    # the score is at most 2 min / (a + b)
    low, high = F.ceil(F.col("n_wanted") * percent / (200 - percent)), F.floor(F.col("n_wanted") * (200 - percent) / percent)
    return made.withColumn("n", F.explode(F.sequence(low.cast("int"), high.cast("int"))))


def parts(text: Column) -> Column:
    """kind, number and text of each line, and of each block of several lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda t, i: F.struct(F.lit("line").alias("kind"), i.alias("number"), t.alias("part"))), lambda p: p["part"] != "")
    blocks = F.filter(F.transform(F.split(text, r"\n[ \t\r]*\n"), lambda t, i: F.struct(F.lit("block").alias("kind"), i.alias("number"), t.alias("part"))),
                      lambda p: F.contains(F.trim(p["part"]), F.lit("\n")))
    return F.concat(lines, blocks)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """id, kind (line or block), number (of the part, from 0), license, template and dice of every match."""
    sizes = template_sizes(docs.sparkSession, templates, percent)
    seen = docs.select(F.col(id_col).alias("id"), F.explode(parts(F.col(text_col))).alias("p")).select("id", "p.kind", "p.number", words(F.col("p.part")).alias("held"))
    found = seen.filter(F.size("held") > 1).select("id", "kind", "number", bigrams(F.col("held")).alias("pairs")).withColumn("n", F.size("pairs"))
    common = F.size(F.array_intersect("pairs", "wanted"))
    matched = found.join(F.broadcast(sizes), "n").withColumn("common", common).filter(200 * F.col("common") >= percent * (F.col("n") + F.col("n_wanted")))
    return matched.select("id", "kind", "number", "license", "template", (2.0 * F.col("common") / (F.col("n") + F.col("n_wanted"))).alias("dice"))
