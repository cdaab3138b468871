"""License scans, natively: an exact set-similarity join of text blocks with license templates.

Blocks are overlapping windows of words over the whole text, whatever its lines: for a template of up to s
words, s a power of two, windows of 2 s words that begin at every s-th word.  So a notice stands whole in a
window of about its own size, however it is wrapped.  A block matches a template if it holds at least
`percent` of the template's distinct words, and all that have a digit or are marks (lesser, noncommercial and so on), which tell
versions and variants apart.  Where templates match in the same place, one that holds less than another is left out: a notice
of the lesser licence also has nearly all words of the general one.  The clause that makes three out of two conditions counts within BSD words.

Words of templates are ordered by how many texts of the whole corpus hold them, rare ones first (ties by the
word).  A match must hold one of the first |T| - least + 1 words of its template (prefix), `least` words of
templates at all (length), and from the first shared word on, in the common order, as many on both sides as
the match needs (position).  What is left is verified on the full sets, so the filters lose nothing.  They
are applied twice: to the set of a whole text, which holds every block's, and to the blocks of what is left.

Beside that, places are found where a base phrase's words stand one after another.  Every text is split into
words once; further on only the places of template words are used.  Null and empty texts have no words, no
places and no labels; very long texts are scanned whole.  Rows that repeat an id or a whole row are rows of their own.  A null
id is an id like others.  An empty table gives an empty result, and columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

# Base phrases with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Words of license notices, public texts, with their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this program is licensed under the gnu general public license version 2"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("lgpl-2.1", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "this program is licensed under the gnu lesser general public license version 2 1"),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
)

# Words that make a variant of a licence, which a match must have as well as all numbers; labels that a further clause changes.
MARKS = ("lesser", "affero", "noncommercial", "noderivatives", "sharealike", "nc", "sa", "nd")
CLAUSES = (("bsd-2", "bsd-3"),)
#: Words within which such a clause stands.
BSD = 512

#: Share of a template's words that a block must hold.
PERCENT = 90

# Words of lower-cased text, as a plain class of what they hold: a union of what they do not hold is many times slower.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def step_of(template: str) -> int:
    """The least power of two that is not below the template's number of words."""
    return 1 << (len(template.split()) - 1).bit_length()


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts, from 0, of all places where the phrase's words stand one after another."""
    first, *others = phrase.split()
    here = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (F.get(words, i) == first) & _all([F.get(words, i + k) == w for k, w in enumerate(others, 1)]))
    return F.when(F.arrays_overlap(words, F.array(F.lit(first))), here).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def vocabulary_of(templates: tuple[tuple[str, str], ...]) -> list[str]:
    return sorted({w for _, text in templates for w in text.split()})


def needed(text: str) -> list[str]:
    """The words of a template that a match must have."""
    return sorted({w for w in text.split() if w in MARKS or any(c.isdigit() for c in w)})


def beaten(templates: tuple[tuple[str, str], ...], percent: int) -> list[tuple[int, int, int]]:
    """(t, by, slack): template t is left out where template `by` matches within slack words, as t is all but a part of it or by a clause that changes its label."""
    out, sets = [], [set(text.split()) for _, text in templates]
    for t, (label, text) in enumerate(templates):
        for by, (other, more) in enumerate(templates):
            part = 100 * len(sets[t] & sets[by]) >= percent * len(sets[t]) and set(needed(text)) <= sets[by] and not set(needed(more)) <= sets[t]
            if label != other and ((label, other) in CLAUSES or part):
                out.append((t, by, BSD if (label, other) in CLAUSES else 0))
    return out


def set_join(spark: SparkSession, blocks: DataFrame, templates: tuple[tuple[str, str], ...], percent: int, order: list[str], *, keep: list[str]) -> DataFrame:
    """(keep, t, label, containment) of blocks (keep, step, found: their vocabulary words) and the templates of that step that they hold to `percent`; a null step meets all."""
    rows = []
    for k, (label, text) in enumerate(templates):
        tokens = [w for w in order if w in set(text.split())]
        least = -(-len(tokens) * percent // 100)
        digits = needed(text)
        rows += [(w, at, k, label, step_of(text), tokens, digits, least) for at, w in enumerate(tokens[: len(tokens) - least + 1])]
    prefix = spark.createDataFrame(rows, "word string, at int, t int, label string, of_step int, tokens array<string>, digits array<string>, least int")
    ordered = blocks.select(*keep, "step", F.array_intersect(_strings(order), "found").alias("found"))
    each = ordered.where(F.size("found") >= min(r[7] for r in rows)).select(*keep, "step", "found", F.posexplode("found").alias("place", "word"))
    # the prefix table is bounded by the fixed templates
    cand = each.join(F.broadcast(prefix), "word").where(F.col("step").isNull() | (F.col("step") == F.col("of_step"))).where((F.size("found") - F.col("place") >= F.col("least")) & (F.size("tokens") - F.col("at") >= F.col("least")))
    held = cand.withColumn("held", F.array_intersect("tokens", "found")).where(F.get("held", F.lit(0)) == F.col("word"))
    whole = (F.size("held") >= F.col("least")) & (F.size(F.array_except("digits", "held")) == 0)
    return held.where(whole).select(*keep, "t", "label", (F.size("held") / F.size("tokens")).alias("containment"))


def template_matches(spark: SparkSession, texts: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(row, label, containment) for texts (row, hits: place * words of the vocabulary + word's number, ascending) and the templates of which a block matches."""
    vocabulary = vocabulary_of(templates)
    size = len(vocabulary)
    word = lambda x: F.element_at(_strings(vocabulary), (x % size + 1).cast("int"))
    sets = texts.select("row", F.transform(F.array_distinct(F.transform("hits", lambda x: x % size)), word).alias("found"), F.lit(None).cast("int").alias("step"))
    # as many numbers as the templates have words
    df = {r.word: r.df for r in sets.select(F.explode("found").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    able = set_join(spark, sets, templates, percent, order, keep=["row"]).select("row", "t").distinct()
    steps = spark.createDataFrame([(k, step_of(text)) for k, (_, text) in enumerate(templates)], "t int, step int")
    wanted = able.join(F.broadcast(steps), "t").select("row", "step").distinct()
    hit = texts.join(wanted, "row").select("row", "step", F.explode("hits").alias("x")).withColumn("at", F.floor(F.col("x") / size / F.col("step")).cast("int"))
    windows = hit.select("row", "step", F.explode(F.array(F.col("at") - 1, F.col("at"))).alias("window"), word(F.col("x")).alias("word")).where("window >= 0")
    blocks = windows.groupBy("row", "step", "window").agg(F.collect_set("word").alias("found"))  # at most the vocabulary
    size_of = F.element_at(F.array(*[F.lit(step_of(text)) for _, text in templates]), F.col("t") + 1)
    placed = set_join(spark, blocks, templates, percent, order, keep=["row", "window"]).withColumn("lo", F.col("window") * size_of)
    found = placed.select("row", "t", "label", "containment", "lo", (F.col("lo") + 2 * size_of).alias("hi"))
    pairs = beaten(templates, percent)
    if not pairs:
        return found.select("row", "label", "containment")
    # as many rows as there are pairs of templates
    less = found.join(F.broadcast(spark.createDataFrame(pairs, "t int, by int, slack int")), "t").select("row", "t", "lo", "hi", "by", "slack")
    more = found.select("row", F.col("t").alias("by"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    lost = less.join(more, ["row", "by"]).where((F.col("lo") < F.col("hi2") + F.col("slack")) & (F.col("lo2") < F.col("hi") + F.col("slack"))).select("row", "t", "lo").distinct()
    return found.join(lost, ["row", "t", "lo"], "left_anti").select("row", "label", "containment")


def scan(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per input row: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest containment of a template in one of the document's blocks that match, 1 where a
    base phrase stands, else 0.
    """
    work = Workspace(spark, "licenses")
    marks = sorted({p.split()[0] for p, _ in BASE})
    vocabulary = vocabulary_of(templates)
    # every text is split once; what can matter further on is written, with a number for each row
    split = docs.select(F.col(id_col).alias("id"), word_array(F.col(text_col)).alias("words"))
    places = [phrase_places(F.col("words"), p) for p, _ in BASE]
    numbers = F.create_map(*[x for k, w in enumerate(vocabulary) for x in (F.lit(w), F.lit(k))])
    # places are filtered by a hash set of the vocabulary, so only words of it are looked up
    held = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(*vocabulary))
    codes = F.when(F.size("words") > 0, F.transform(held, lambda i: i.cast("long") * len(vocabulary) + F.element_at(numbers, F.get("words", i)))).otherwise(F.array().cast("array<bigint>"))
    found = split.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.arrays_overlap("words", _strings(marks)), F.array(*places)).alias("places"),
        codes.alias("hits"),
    )
    texts = work.put(found.withColumn("row", F.monotonically_increasing_id()), "words")
    per_doc = template_matches(spark, texts.select("row", "hits"), templates, percent).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    starts = F.flatten("places")
    labelled = F.array_compact(F.array(*[F.when(F.size(F.get("places", F.lit(k))) > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]))
    base = F.when(F.col("places").isNull(), F.array().cast("array<string>")).otherwise(labelled)
    out = texts.drop("hits").join(per_doc, "row", "left").withColumns({"base": base, "n_base": F.coalesce(F.array_size(starts), F.lit(0)).cast("long")})
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        score.alias("score"),
    )


def oracle_sql() -> str:
    """The same result in DuckDB SQL, every window compared with every template."""
    quoted = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]::varchar[]"
    templates = ", ".join(f"({k}, '{label}', {step_of(text)}, {quoted(sorted(set(text.split())))}, {quoted(needed(text))})" for k, (label, text) in enumerate(TEMPLATES))
    base = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in BASE)
    return f"""
with d as (
  select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') w from documents),
t(k, label, step, tokens, digits) as (values {templates}),
b(label, phrase) as (values {base}),
p as (select r, b.label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(phrase)] = phrase)) as i from d, b where list_contains(w, phrase[1])),
beats(k, by_k, slack) as (values {", ".join(map(str, beaten(TEMPLATES, PERCENT)))}),
l as (select r, step, i, list_distinct(w[i * step + 1 : (i + 2) * step]) w from (select r, w, step, unnest(range(0, len(w) // step + 1)) i from d, (select distinct step from t))),
f as materialized (select r, k, label, i * step lo, (i + 2) * step hi, len(list_intersect(w, tokens)) / len(tokens) c from l join t using (step)
      where 100 * len(list_intersect(w, tokens)) >= {PERCENT} * len(tokens) and len(list_intersect(w, digits)) = len(digits)),
lost as (select distinct f.r, f.k, f.lo from f join beats b using (k) join f g on g.r = f.r and g.k = b.by_k and f.lo < g.hi + slack and g.lo < f.hi + slack),
m as (select r, label, max(c) c from f anti join lost using (r, k, lo) group by all),
pa as (select r, count(*) n, min(i) lo, max(i) hi, string_agg(distinct label, ',' order by label) labels from p group by r),
al as (select r, string_agg(distinct label, ',' order by label) labels from (select r, label from p union select r, label from m) group by r),
ma as (select r, max(c) c from m group by r)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n, 0) n_base, cast(lo as bigint) first_word, cast(hi as bigint) last_word, coalesce(pa.labels, '') base_labels,
       coalesce(al.labels, '') labels, case when n > 0 then 1.0 else coalesce(c, 0.0) end::double score
from d left join pa using (r) left join al using (r) left join ma using (r)
"""
