"""Quality rules with DataFrame functions only: counts and repeats of one text, and the
Jensen-Shannon distance of its character-class and common-word histograms from references that
are learned from the corpus, one for each language.

One pass over the texts counts everything in the text's own row: base counts, character classes,
and the number of each distinct short word. A word window is one hash of its eight words' hashes. A text whose
window hashes are all different has no repeat; only the others sort theirs. With the repeated
windows' first words at p1 < p2 < ..., the words that they cover number
8 + sum(min(8, p[k+1] - p[k])).

A reference is learned in two steps, so that junk doesn't shape it: the character histogram of all
texts of a language, then both histograms of the half of them nearest to that. Its common words are
the most frequent ones of that half. Limits are fences of the distances' quartiles, never below a
floor. Quartiles come from counts of the distances in steps of 0.001, so no list of distances is
sorted. Only (language, word) sums and such counts go through a shuffle, combined before it.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

# Character classes, as the pattern of what is in each.
CLASSES = {
    "upper": r"\p{Lu}+",
    "digit": r"[0-9]+",
    "symbol": r"[#*$%&|<>!?~^_=+@/\\{}\[\]]+",
    "vowel": r"[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüý]+",
}
# Fixed value: a token, a run of neither white space nor marks.
TOKEN = r"[^\x20\x09-\x0D.,;:!?\"()\[\]{}<>|#*$%&+=~^_/\\@]+"

STEPS = 1000  # a distance is counted in this many steps


def bind(value: Column, use) -> Column:
    """use(value), with value computed once for the row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def repeated_words(words: Column, size: int = 8) -> Column:
    """How many words lie in windows of `size` words that the array holds twice or more."""

    def repeats(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            twice = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

        def covered(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(size)), F.lit(size)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

        marked = bind(bind(tagged, places), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(marked)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) <= size, F.lit(0).cast("long")).otherwise(bind(bind(hashed, windows), repeats))


def base_counts(text: Column, words: Column) -> dict[str, Column]:
    clean = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(clean, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(clean) - F.length(F.regexp_replace(clean, "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def class_counts(text: Column, words: Column) -> Column:
    """Counts of the character classes, of all other characters of words, and (outside the
    histogram) of the words' UTF-8 bytes beyond one a character."""
    clean = F.coalesce(text, F.lit(""))
    number = lambda p: F.length(clean) - F.length(F.regexp_replace(clean, p, ""))
    classes = F.array(*map(number, CLASSES.values()))

    def rest(v: Column) -> Column:
        more = F.greatest(F.length(v["all"]) - _sum(v["k"], "int"), F.lit(0))
        return F.concat(v["k"], F.array(more, F.octet_length(v["all"]) - F.length(v["all"])))

    return bind(F.struct(classes.alias("k"), F.array_join(words, "").alias("all")), rest)


def word_counts(text: Column, longest: int = 6) -> Column:
    """(total, short): the number of tokens of the lower-cased text, and (w, n) of each distinct
    token of at most `longest` characters, as common words are short."""

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        pair = lambda f: F.transform(f, lambda i, k: F.struct(F.get(s, i).alias("w"), (F.coalesce(F.get(f, k + 1), F.size(s)) - i).alias("n")))
        return F.when(F.size(s) > 0, bind(first, pair))

    def counted(tokens: Column) -> Column:
        short = bind(F.sort_array(F.filter(tokens, lambda w: F.length(w) <= longest)), runs)
        return F.struct(F.size(tokens).alias("total"), F.coalesce(short, F.array().cast("array<struct<w:string,n:int>>")).alias("short"))

    return bind(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), counted)


def _sum(a: Column, kind: str = "double") -> Column:
    return F.aggregate(a, F.lit(0).cast(kind), lambda s, x: s + x)


def _term(x: Column, y: Column) -> Column:
    """What one bin with the shares x and y adds to twice the Jensen-Shannon divergence."""
    part = lambda v, m: F.when(v > 0, v * F.log2(v / m)).otherwise(F.lit(0.0))
    return bind(F.struct(x.alias("x"), y.alias("y")), lambda v: part(v["x"], (v["x"] + v["y"]) / 2) + part(v["y"], (v["x"] + v["y"]) / 2))


def js_distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (base 2, so 0 to 1) of two arrays of counts; 1 where either
    is all zero."""

    def known(t: Column) -> Column:
        terms = F.zip_with(p, q, lambda x, y: _term(x / t["p"], y / t["q"]))
        return F.when((t["p"] > 0) & (t["q"] > 0), F.sqrt(F.greatest(_sum(terms) / 2, F.lit(0.0)))).otherwise(F.lit(1.0))

    return bind(F.struct(_sum(p).alias("p"), _sum(q).alias("q")), known)


_K = len(CLASSES) + 1
_REF = "array<struct<lang:string,chars:array<double>,beyond:boolean,words:map<string,bigint>,common:bigint,total:bigint>>"


def _literal(refs: list[dict]) -> Column:
    """The references as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(refs)), _REF)


def _chars(c: Column) -> Column:
    return F.transform(F.slice(c, 1, _K), lambda x: x.cast("double"))


def _beyond(c: Column) -> Column:
    """Whether the bytes beyond one a character exceed half the characters."""
    return 2 * F.get(c, F.lit(_K)) > _sum(F.slice(c, 1, _K), "bigint")


def nearest_chars(c: Column, refs: Column) -> Column:
    """The distance to the nearest reference of the same kind of script; null without one."""
    own = F.struct(_chars(c).alias("c"), _beyond(c).alias("beyond"))
    near = lambda o: F.array_min(F.transform(F.filter(refs, lambda r: r["beyond"] == o["beyond"]), lambda r: js_distance(o["c"], r["chars"])))
    return bind(own, near)


def nearest_words(counts: Column, total: Column, refs: Column) -> Column:
    """(divergence, lang, share) of the nearest reference: the divergence beyond what total words
    would show by chance, and the share of words that are common ones of it. Null for no words.

    Only words that a text has are looked up; a common word that it lacks adds its own share."""

    def to(r: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("q"), F.lit(0.0).alias("t"))

        def add(acc: Column, x: Column) -> Column:
            more = lambda q: F.when(q.isNull(), acc).otherwise(F.struct((acc["n"] + x["n"]).alias("n"), (acc["q"] + q).alias("q"), (acc["t"] + _term(x["n"] / total, q / r["total"])).alias("t")))
            return bind(F.try_element_at(r["words"], x["w"]), more)

        def whole(a: Column) -> Column:
            twice = a["t"] + (r["common"] - a["q"]) / r["total"] + _term((total - a["n"]) / total, (r["total"] - r["common"]) / r["total"])
            chance = F.size(F.map_keys(r["words"])) / (8 * math.log(2) * total)
            return F.struct((twice / 2 - chance).alias("divergence"), r["lang"].alias("lang"), (a["n"] / total).alias("share"))

        return bind(F.aggregate(counts, zero, add), whole)

    return F.when(total > 0, F.array_min(F.transform(refs, to)))


def quantiles(rows: DataFrame, value: str, parts: list[float]) -> DataFrame:
    """(lang, q0, q1, ...): for each part the smallest step of `value` that at least that share
    of the language's rows does not exceed."""
    counted = rows.groupBy("lang", F.floor(F.col(value) * STEPS).alias("step")).count()
    w = Window.partitionBy("lang")  # at most STEPS + 1 rows
    summed = counted.withColumn("below", F.sum("count").over(w.orderBy("step"))).withColumn("all", F.sum("count").over(w))
    return summed.groupBy("lang").agg(*[F.min(F.when(F.col("below") >= p * F.col("all"), F.col("step"))).alias(f"q{k}") for k, p in enumerate(parts)])


def learn_references(measured: DataFrame, common_words: int = 32, min_share: float = 0.001) -> list[dict]:
    """The references, one for each language of at least min_share of the rows that pass the base
    rules and name one: so at most 1 / min_share, and common_words words each, come to the driver."""
    named = measured.filter(F.col("lang").isNotNull() & ~F.col("base_failed"))

    def sums(rows: DataFrame, least: float) -> dict:
        got = rows.groupBy("lang").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("_c", F.lit(k))) for k in range(_K + 1)]).alias("c"))
        return {r["lang"]: list(map(int, r["c"])) for r in got.filter(F.col("n") >= least).orderBy("lang").collect()}

    def reference(lang: str, c: list[int], words: list = (), total: int = 0) -> dict:
        return {"lang": lang, "chars": c[:_K], "beyond": 2 * c[_K] > sum(c[:_K]), "words": dict(words), "common": sum(n for _, n in words), "total": total}

    first = sums(named, min_share * named.count())
    if not first:
        return []
    own = F.filter(_literal([reference(k, c) for k, c in first.items()]), lambda r: r["lang"] == F.col("lang"))
    placed = named.filter(F.col("lang").isin(*first)).withColumn("_d", bind(F.get(own, F.lit(0)), lambda r: js_distance(_chars(F.col("_c")), r["chars"])))
    cut = {r["lang"]: r["q0"] for r in quantiles(placed, "_d", [0.5]).collect()}
    limit = F.get(F.map_values(F.map_filter(F.from_json(F.lit(json.dumps(cut)), "map<string,bigint>"), lambda k, _: k == F.col("lang"))), F.lit(0))
    core = placed.filter(F.floor(F.col("_d") * STEPS) <= limit)
    spread = core.select("lang", F.explode("_w.short").alias("x")).groupBy("lang", F.col("x.w").alias("w")).agg(F.sum("x.n").alias("n"))
    spread = materialise(spread)
    totals = {r["lang"]: int(r["n"]) for r in core.groupBy("lang").agg(F.sum("_w.total").alias("n")).collect()}
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))  # cut to common_words before the shuffle
    top: dict = {}
    for r in spread.withColumn("k", order).filter(F.col("k") <= common_words).orderBy("lang", "k").collect():
        top.setdefault(r["lang"], []).append((r["w"], int(r["n"])))
    return [reference(k, c, top[k], totals[k]) for k, c in sums(core, 0).items() if k in top]


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    char_floor: float = 0.2,
    word_floor: float = 0.25,
    fence: float = 1.5,
    known_share: float = 0.15,
    min_chars: int = 200,
    min_words: int = 80,
    common_words: int = 32,
    min_share: float = 0.001,
    references: list[dict] | None = None,
) -> DataFrame:
    """One row per input row: id, the base counts, char_distance and word_distance (to the
    nearest language reference; null without one), near_lang, common_share (its words that are
    common ones of near_lang), base_failed and kept.

    References are learned from the rows (learn_references) unless given; the row's own language
    is never an input of its verdict. A limit is the third quartile of near_lang's distances plus
    `fence` times the quartiles' difference, at least the floor; quartiles are taken over the rows
    that pass the base rules and the length guards. A text fails where its char_distance is
    over the limit (from min_chars characters of words on), or where its word_distance is (from
    min_words words on) and either known_share of its words are common ones of the language or
    its char_distance is over half the limit as well: so a language without a reference isn't
    rejected for its words alone. Texts of another script (`_beyond`) are compared with such references only.
    A shorter text, and every text where no reference exists, passes both. Null and empty texts have
    no words, so they fail the base rules. Repeated rows each get their row. Other columns are
    ignored.
    """
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), lang.cast("string").alias("lang"))
    split = rows.withColumn("_words", words_of(F.col("_text")))
    counts = base_counts(F.col("_text"), F.col("_words"))
    measured = split.select(
        "_id", "lang", *[c.alias(k) for k, c in counts.items()], class_counts(F.col("_text"), F.col("_words")).alias("_c"), word_counts(F.col("_text")).alias("_w")
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = materialise(measured.withColumn("base_failed", failed))
    refs = learn_references(measured, common_words, min_share) if references is None else references

    every = sorted({w for r in refs for w in r["words"]})
    known = F.filter("_w.short", lambda x: x["w"].isin(*every)) if every else F.array().cast("array<struct<w:string,n:int>>")
    near = bind(F.struct(known.alias("k"), F.col("_w.total").alias("n")), lambda v: nearest_words(v["k"], v["n"], _literal(refs)))
    chars = nearest_chars(F.col("_c"), _literal(refs))
    scored = measured.select("_id", *counts, "base_failed", chars.alias("char_distance"), near.alias("_near"))
    scored = scored.select(
        "_id", *counts, "base_failed", "char_distance", F.sqrt(F.greatest(F.col("_near.divergence"), F.lit(0.0))).alias("word_distance"),
        F.col("_near.lang").alias("lang"), F.col("_near.share").alias("common_share"),
    )
    scored = materialise(scored)

    def limits(value: str, guard: Column, floor: float) -> Column:
        got = quantiles(scored.filter(~F.col("base_failed") & guard & F.col("lang").isNotNull() & F.col(value).isNotNull()), value, [0.25, 0.75])
        # at most one row for each reference
        over = {r["lang"]: max(floor, (r["q1"] + fence * (r["q1"] - r["q0"])) / STEPS) for r in got.collect()}
        own = F.map_filter(F.from_json(F.lit(json.dumps(over)), "map<string,double>"), lambda k, _: k == F.col("lang"))
        return F.coalesce(F.get(F.map_values(own), F.lit(0)), F.lit(floor))

    long_c, long_w = F.col("word_chars") >= min_chars, F.col("n_words") >= min_words
    scored = scored.withColumn("_lc", limits("char_distance", long_c, char_floor)).withColumn("_lw", limits("word_distance", long_w, word_floor))
    odd_words = (F.col("word_distance") > F.col("_lw")) & ((F.col("common_share") >= known_share) | F.coalesce(F.col("char_distance") > F.col("_lc") / 2, F.lit(False)))
    odd = F.coalesce(long_c & (F.col("char_distance") > F.col("_lc")), F.lit(False)) | F.coalesce(long_w & odd_words, F.lit(False))
    return scored.select(F.col("_id").alias(id_col), *counts, "char_distance", "word_distance", F.col("lang").alias("near_lang"), "common_share", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"))
