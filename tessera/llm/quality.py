"""Quality rules whose cutoffs are chosen under a bound on false rejections.

Each rule is a rate of a text, the higher the worse: symbols a word, repeated lines, words in repeated windows, capitals
among letters.  For each a list of cutoffs is fixed beforehand, from mild to strict.  On labelled documents
of good quality, per stratum (language, say), the operator counts how many each cutoff would reject, and takes the
strictest cutoff for which the exact binomial bound says that at most `risk` / rules of good documents
are rejected.  All rules of a stratum together then reject at most `risk` of its good documents, and this holds in all strata
at once with probability 1 - `doubt`:

* within a rule, cutoffs are tested in their fixed order until one fails, which needs no correction (a stricter cutoff rejects
  what a milder one does, so the first failure is also where the counts fail);
* across rules and strata the doubt is divided by their number (Bonferroni).  Tested strata are those with at least
  `least` labelled good documents; how many there are does not depend on the outcome of a test.

A stratum or rule for which no cutoff passes gets none, and its documents are kept by that rule.  The labelled
documents are taken to be a random sample of their stratum, and serve for nothing but these tests.

Two more conditions, of fewer than `few` words and of `repeats` percent of words in repeated windows, reject a document whatever its
stratum; they are given, not chosen, and lie outside the guarantee.  Documents that they reject do not count among
the good ones of a stratum.

Null and empty texts have no words, counts of 0 and fail.  Texts of any length are counted whole.  A null stratum is a
stratum of its own.  Rows that repeat an id or a whole row are judged alike, one by one; where an id is labelled more than once,
it counts as good if all its labels say so, and each of its rows counts.  Null ids have no label.  Labels without a
document count for nothing; without any label no cutoff is chosen.  An empty table gives an empty result.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, slices

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER, _LETTER = re.compile(r"[A-Z]"), re.compile(r"[A-Za-z]")

#: Counts of a text, in this order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: Rules: name, counted, out of how many; cutoffs in thousandths, mild to strict.  A document is rejected above the cutoff.
RULES = (
    ("symbols", "n_symbols", "n_words", (2000, 1000, 700, 500, 350, 250, 180, 120, 80, 50, 30, 20, 10)),
    ("lines", "n_dup_lines", "n_lines", (800, 600, 450, 300, 200, 150, 100, 60, 30)),
    ("repeats", "n_repeat_words", "n_words", (450, 400, 350, 300, 250, 200, 150, 100, 70, 50, 30)),
    ("capitals", "n_upper", "n_letters", (950, 900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100)),
)

#: Strata up to this number go to every task; more are joined by key.
FEW_STRATA = 1000


def repeated_words(words: list[str], width: int = 3) -> int:
    """How many words stand in a window of `width` words that occurs at least twice in the text, overlaps included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    code, size, limit = number[:n], len(ids), len(ids)
    for j in range(1, width):
        if limit * size >= 1 << 62:  # codes are numbered anew, below n
            code, limit = np.unique(code, return_inverse=True)[1], n
        code, limit = code * size + number[j : j + n], limit * size
    _, which, many = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(many[which] > 1)
    covered = np.zeros(len(words), bool)
    for j in range(width):
        covered[starts + j] = True
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    text = text or ""
    words, lines = _WORD.findall(text), [x for x in text.split("\n") if _WORD.search(x)]
    return (len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(_UPPER.findall(text)), len(_LETTER.findall(text)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for b in slices(big, "text", 1 << 20):
            found = np.array([counts(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(found[:, k]) for k in range(len(COUNTS)))], ["id", "stratum", *COUNTS])


def at_most(k: int, n: int, p: float) -> float:
    """The probability of at most k successes in n trials of probability p, from its largest term downwards."""
    if k >= n:
        return 1.0
    if k > n * p:
        return 1.0 - at_most(n - k - 1, n, 1 - p)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while term > total * 1e-17 and i >= 0:
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return min(1.0, total)


def bound(k: int, n: int, doubt: float) -> float:
    """The exact upper bound for a rate of which k of n were seen: the largest p for which at most k has probability `doubt`."""
    lo, hi = (k / n if n else 0.0), 1.0
    if k >= n:
        return 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at_most(k, n, mid) > doubt else (lo, mid)
    return hi


def _bounds(doubt: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(bound=[bound(int(k), int(n), doubt / int(t)) for k, n, t in zip(b["k"], b["n"], b["tests"], strict=True)])

    return run


def base_failed(few: int, repeats: int) -> Column:
    return (F.col("n_words") < few) | (100 * F.col("n_repeat_words") > repeats * F.col("n_words"))


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, counts) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(stratum_col).cast("string").alias("stratum"))
    return rows.mapInArrow(_counted, f"id {dict(rows.dtypes)['id']}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def cutoffs(rows: DataFrame, good: DataFrame, *, risk: float = 0.1, doubt: float = 0.1, least: int = 150, few: int = 50, repeats: int = 50) -> DataFrame:
    """(stratum, rule, cutoff, n, k, bound): the strictest cutoff of each rule that holds its part of the risk, from the measured rows whose id is in good.

    n good documents of the stratum are labelled, k of them lie above the cutoff, and the true rate of such documents is below bound.
    """
    labelled = rows.where(~base_failed(few, repeats)).join(good.select("id"), "id", "left_semi")
    above = [F.count_if(F.col(part) * 1000 > F.col(whole) * c).alias(f"k_{rule}_{c}") for rule, part, whole, steps in RULES for c in steps]
    seen = labelled.groupBy("stratum").agg(F.count("*").alias("n"), *above).where(F.col("n") >= least)
    steps = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k_{rule}_{c}").alias("k")) for rule, _, _, each in RULES for c in each])
    tests = seen.select((F.count("*") * len(RULES)).alias("tests"))
    tried = seen.crossJoin(F.broadcast(tests)).select("stratum", "n", "tests", F.explode(steps).alias("s")).select("stratum", "s.*", "n", "tests")  # tests is one row
    shown = tried.mapInPandas(_bounds(doubt), "stratum string, rule string, cutoff int, k long, n long, tests long, bound double")
    passed = shown.where(F.col("bound") <= risk / len(RULES)).groupBy("stratum", "rule").agg(F.min(F.struct("cutoff", "n", "k", "bound")).alias("best"))
    return passed.select("stratum", "rule", "best.*")


def judge(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    good_col: str = "quality",
    risk: float = 0.1,
    doubt: float = 0.1,
    least: int = 150,
    few: int = 50,
    repeats: int = 50,
) -> DataFrame:
    """One row per row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    labels has id_col and good_col, 1 for good documents.  rejected_by names the chosen rules that reject the
    document, in order of their names, whether or not it failed before.
    """
    work = Workspace(spark, "quality")
    rows = work.put(measured(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col), "counts")
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.coalesce(F.col(good_col) == 1, F.lit(False))).alias("good")).where("good")
    chosen = cutoffs(rows, good, risk=risk, doubt=doubt, least=least, few=few, repeats=repeats)
    per_stratum = work.put(chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"c_{rule}") for rule, *_ in RULES]), "cutoffs")
    small = per_stratum.count() <= FEW_STRATA
    met = rows.join(F.broadcast(per_stratum) if small else per_stratum.hint("merge"), rows["stratum"].eqNullSafe(per_stratum["stratum"]), "left")
    hits = [F.when(F.col(part) * 1000 > F.col(whole) * F.col(f"c_{rule}"), F.lit(rule)) for rule, part, whole, _ in sorted(RULES)]
    failed = base_failed(few, repeats)
    out = met.select("id", *COUNTS[:5], failed.alias("base_failed"), F.array_join(F.array_compact(F.array(*hits)), ",").alias("rejected_by"))
    return out.select(F.col("id").alias(id_col), *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept"), "rejected_by")


def oracle_sql(risk: float = 0.1, doubt: float = 0.1, least: int = 150, few: int = 50, repeats: int = 50) -> str:
    """The same rows in DuckDB SQL; there a cutoff passes if so few rejections have at most the doubt's probability at the full risk, which is the same test."""
    word = r"[^\x20\x09-\x0D]+"
    grid = ", ".join(f"('{rule}', {c})" for rule, _, _, steps in RULES for c in steps)
    part = "case rule " + " ".join(f"when '{rule}' then {p}" for rule, p, _, _ in RULES) + " end"
    whole = "case rule " + " ".join(f"when '{rule}' then {w}" for rule, _, w, _ in RULES) + " end"
    p = risk / len(RULES)
    return f"""
with d as (select row_number() over () r, doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{word}') w from documents),
l as (select r, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}'))) x from d),
ld as (select r, count(*) n, count(*) - count(distinct x) dup from l group by r),
g as (select r, unnest(range(1, len(w) - 1)) i, w from d where len(w) >= 3),
g3 as (select r, i, w[i : i + 2] k from g),
gk as (select r, i from g3 qualify count(*) over (partition by r, k) > 1),
rw as (select r, count(distinct i + o) n from gk, (select unnest([0, 1, 2]) o) group by r),
s as (select d.r, doc_id, lang, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
        coalesce(ld.dup, 0) n_dup_lines, coalesce(rw.n, 0) n_repeat_words, coalesce(ld.n, 0) n_lines, len(regexp_extract_all(t, '[A-Z]')) n_upper, len(regexp_extract_all(t, '[A-Za-z]')) n_letters
      from d left join ld using (r) left join rw using (r)),
b as (select *, (n_words < {few} or 100 * n_repeat_words > {repeats} * n_words) base_failed from s),
rules(rule, cutoff) as (values {grid}),
ok as (select doc_id from labels where doc_id is not null group by doc_id having bool_and(coalesce(quality = 1, false))),
good as (select b.* from b semi join ok using (doc_id) where not base_failed),
n as (select lang, count(*) n from good group by lang having count(*) >= {least}),
k as (select n.lang, rule, cutoff, n, (select count(*) from good g where g.lang is not distinct from n.lang and 1000 * ({part}) > cutoff * ({whole})) k from n, rules),
c as (select lang, rule, min(cutoff) cutoff from k
      where (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) from (select unnest(range(0, k + 1)) i)) <= {doubt} / ({len(RULES)} * (select count(*) from n))
      group by all),
h as (select r, string_agg(rule, ',' order by rule) by_rules from b join c on b.lang is not distinct from c.lang where 1000 * ({part}) > cutoff * ({whole}) group by r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and by_rules is null as kept, coalesce(by_rules, '') rejected_by
from b left join h using (r)
"""
