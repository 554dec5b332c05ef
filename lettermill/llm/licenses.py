"""Operator 3, licence scans. DataFrame functions only.

Licence templates are sparse TF-IDF vectors, the document frequencies of their terms counted over all files. Windows of a file, as
long as a template, are compared with it by cosine. Where a window's cosine reaches the threshold, the terms that it shares with the
template hold at least the threshold's square of the template's unit vector (Cauchy and Schwarz), so two bounds choose the windows
without loss: a file must hold enough of a template's heaviest terms, and a window must hold one of the heaviest of them; windows are
laid so that this term stands where the template has it. Line breaks and comment signs play no part, so wrapped headers and whole
licence files are found alike. All of this happens inside a file's row: nothing is shuffled but the counts.

What no window of a file says is inherited: each directory takes the licence of the nearest directory above it that has a licence
file. Directories are resolved once, so a directory of a third of all files is one row of that join.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.staging import staged

#: Notices, titles and short texts of common licences (fixed values).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors as is"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. This software is provided by the copyright holders and contributors as is"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0 The accompanying program is provided under the terms of this Eclipse Public License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
]
LICENCE_NAME = r"(?i)^(un)?licen[cs]e|^copying|^notice"
#: Terms of files and templates, in lower case.
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
#: The part of a template's squared vector that the terms left out of the first bound may have.
SLACK = 0.09
MODEL = "array<struct<license_id:string,size:int,keys:array<struct<t:string,q:double>>,seeds:array<struct<t:string,p:int>>,terms:array<struct<t:string,idf:double,u:double>>>>"
def _words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _models(templates: list[tuple[str, list[str]]], df: dict[str, int], n: int, min_cosine: float) -> list[dict]:
    """The templates' unit vectors with the terms of both bounds."""
    out = []
    for license_id, words in templates:
        idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in words}
        w = {t: (1 + math.log(words.count(t))) * idf[t] for t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        order = sorted(w, key=lambda t: (-w[t], t))
        rest = {t: sum((w[x] / norm) ** 2 for x in order[i:]) for i, t in enumerate(order)}
        out.append(
            {
                "license_id": license_id, "size": len(words), "keys": [{"t": t, "q": (w[t] / norm) ** 2} for t in order if rest[t] >= SLACK],
                "seeds": [{"t": t, "p": words.index(t)} for t in order if rest[t] >= min_cosine**2], "terms": [{"t": t, "idf": idf[t], "u": w[t] / norm} for t in order],
            }
        )
    return out


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _best(words: Column, models: list[dict], min_cosine: float) -> Column:
    """struct(cosine, size, license_id) of the best window of a file, null where none reaches ``min_cosine``."""
    keys = F.lit(sorted({k["t"] for m in models for k in m["keys"]}))
    enough = lambda m, held: F.aggregate(m["keys"], F.lit(0.0), lambda s, k: s + F.when(F.array_contains(held, k["t"]), k["q"]).otherwise(0.0)) >= min_cosine**2 - SLACK
    found = _once(F.array_intersect(words, keys), lambda held: F.filter(F.from_json(F.lit(json.dumps(models)), MODEL), lambda m: enough(m, held)))
    places = lambda t: F.filter(F.transform(words, lambda w, i: F.when(w == t, i)), lambda i: i.isNotNull())
    starts = lambda m: F.array_distinct(F.flatten(F.transform(m["seeds"], lambda s: F.transform(places(s["t"]), lambda i: i - s["p"]))))
    cut = lambda a, m: F.slice(words, F.greatest(a, F.lit(0)) + 1, m["size"] + F.least(a, F.lit(0)))
    parts = F.transform(found, lambda m: F.struct(m.alias("m"), F.array_distinct(F.transform(starts(m), lambda a: cut(a, m))).alias("windows")))
    counted = lambda m, w: F.struct(F.transform(m["terms"], lambda t: F.struct(t["idf"].alias("idf"), t["u"].alias("u"), F.size(F.filter(w, lambda x: x == t["t"])).alias("n"))).alias("terms"), F.size(w).alias("size"))
    made = F.transform(parts, lambda p: F.struct(p["m"]["license_id"].alias("license_id"), p["m"]["size"].alias("size"), F.transform(p["windows"], lambda w: counted(p["m"], w)).alias("windows")))
    tf = lambda t: F.when(t["n"] > 0, (1 + F.log(t["n"])) * t["idf"]).otherwise(0.0)
    dot = lambda w: F.aggregate(w["terms"], F.lit(0.0), lambda s, t: s + tf(t) * t["u"])
    square = lambda w: F.aggregate(w["terms"], F.lit(0.0), lambda s, t: s + tf(t) * tf(t) - t["n"]) + w["size"]
    best = lambda m: F.round(F.array_max(F.transform(m["windows"], lambda w: dot(w) / F.sqrt(square(w)))), 9)
    scored = F.transform(made, lambda m: F.struct(best(m).alias("cosine"), m["size"].alias("size"), m["license_id"].alias("license_id")))
    return F.array_max(F.filter(scored, lambda x: x["cosine"] >= min_cosine))


def _scanned(files: DataFrame, templates: DataFrame, min_cosine: float, max_templates: int) -> DataFrame:
    """path, license_id, cosine: the best template of each file that has one."""
    given = templates.select("license_id", _words("text").alias("words")).filter("size(words) > 0").limit(max_templates + 1).collect()
    if len(given) > max_templates:
        raise ValueError(f"more than {max_templates} templates")
    texts = staged(files.filter("text is not null").select("path", _words("text").alias("words")), "words")
    known = [(r["license_id"], list(r["words"])) for r in given]
    vocabulary = sorted({t for _, words in known for t in words})
    seen = texts.select(F.explode(F.array_intersect("words", F.lit(vocabulary))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")) if known else None
    df = {r["term"]: r["n"] for r in seen.collect()} if known else {}  # at most the templates' terms
    best = _best(F.col("words"), _models(known, df, texts.count(), min_cosine), min_cosine) if known else F.lit(None).cast("struct<cosine:double,size:int,license_id:string>")
    found = staged(texts.select("path", best.alias("b")), "found").filter("b is not null")
    return found.groupBy("path").agg(F.max("b").alias("b")).select("path", "b.license_id", "b.cosine")


def _directories(path: Column) -> Column:
    """The directory of a path; files at the top are in ''."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license_id string, text string")


def license_scan(files: DataFrame, templates: DataFrame | None = None, *, carry: tuple[str, ...] = (), min_cosine: float = 0.6, max_templates: int = 1000) -> DataFrame:
    """path, carry columns, license_id, cosine, how ('own', 'inherited' or null), from_dir; a row for each row of ``files``.

    Terms are runs of letters and digits in lower case; a term weighs 1 + ln(count) times 1 + ln((1 + files) / (1 + files with it)),
    and a word of a window that the template lacks weighs 1. A file's own licence is the template (``max_templates`` at most) with the
    highest cosine (to nine digits) over the windows of its length that hold one of its heaviest terms in its place, ``min_cosine`` at
    least; ties go to the longer template, then the greater id. A file without one inherits from the nearest directory above it
    whose licence file (LICENSE, COPYING, NOTICE ...) has a licence; of several such files in a directory the best cosine counts.
    Null and empty texts have no licence of their own; texts of any length are searched whole. A null path has no directory: such
    files keep no licence. Rows that repeat a path share the path's best licence. Only path, text and ``carry`` are read. No rows
    give no rows; without templates nothing has a licence.
    """
    templates = default_templates(files.sparkSession) if templates is None else templates
    own = staged(_scanned(files.filter("path is not null"), templates.filter("text is not null"), min_cosine, max_templates), "own")
    given = own.filter(F.substring_index("path", "/", -1).rlike(LICENCE_NAME)).groupBy(_directories(F.col("path")).alias("from_dir")).agg(F.max(F.struct("cosine", "license_id")).alias("g"))
    given = given.select("from_dir", F.col("g.license_id").alias("dir_license"))
    paths = files.select("path", *carry)
    dirs = paths.filter("path is not null").select(_directories(F.col("path")).alias("dir")).distinct()
    steps = F.split("dir", "/", -1)
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))))
    chain = dirs.select("dir", F.posexplode(above).alias("depth", "from_dir"))
    nearest = chain.join(given, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "dir_license"), "depth").alias("n"))
    nearest = nearest.select("dir", "n.from_dir", "n.dir_license")
    rows = paths.withColumn("dir", _directories(F.col("path"))).join(own.withColumnRenamed("path", "own_path"), F.col("path") == F.col("own_path"), "left").join(nearest, "dir", "left")
    how = F.when(F.col("license_id").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited")
    return rows.select("path", *carry, F.coalesce("license_id", "dir_license").alias("license_id"), "cosine", how.alias("how"), F.when(how == "inherited", F.col("from_dir")).alias("from_dir"))
