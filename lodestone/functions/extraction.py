"""Facts from the text of abstracts, all as JVM column expressions.

Spark has no function for where a pattern matches, only for what matches and what lies between: `occurrences` puts both
together into an array of places, and the figures are array expressions over such places.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon

#: Case-blind, with classes that know all scripts.
FOLD = "(?iU)"


def matches(text: Column, patterns: list[str]) -> Column:
    return text.rlike(FOLD + "|".join(f"(?:{p})" for p in patterns))


def tags(text: Column, entries: dict[str, list[str]], none: str) -> Column:
    """The labels with a match, in the lexicon's order, joined by "; "; `none` if there are none."""
    found = F.concat_ws("; ", *[F.when(matches(text, p), F.lit(k)) for k, p in entries.items()])
    return F.when(found == "", F.lit(none)).otherwise(found)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def occurrences(text: Column, pattern: str) -> Column:
    """Places of a pattern (that never matches nothing) in order: structs of `at` (from 0) and `hit`, the matched text."""
    none = F.array().cast("array<struct<at:int,hit:string>>")

    def places(hits: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, FOLD + pattern, -1), F.char_length), 1, F.size(hits))
        walked = F.aggregate(
            F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
            F.struct(F.lit(0).alias("end"), none.alias("places")),
            lambda seen, x: let(seen["end"] + x["gap"], lambda at: F.struct((at + F.char_length(x["hit"])).alias("end"), F.concat(seen["places"], F.array(F.struct(at.alias("at"), x["hit"].alias("hit")))).alias("places"))),
        )
        return F.when(F.size(hits) > 0, walked["places"]).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(FOLD + pattern), F.lit(0)), places)


def number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, FOLD + pattern, group).try_cast("double")


def nearest_percentage(text: Column, words: list[str]) -> Column:
    """The percentage (0 to 100) that a response phrase ties to a keyword, starting nearest to it; of equals the first by
    keyword, place of the keyword, phrase and place of the phrase. Phrases are sought in a window round each keyword."""
    def near(low: Column, rank: int, word: str) -> Column:
        def round_one(place: Column) -> Column:
            def of_phrase(window: Column, start: Column, k: int, phrase: str) -> Column:
                return F.transform(occurrences(window, phrase), lambda m: F.struct(F.abs(start + m["at"] - place["at"]).alias("far"), F.lit(rank).alias("rank"), place["at"].alias("from"), F.lit(k).alias("phrase"), m["at"].alias("at"), number(m["hit"], phrase).alias("value")))

            phrases = [p.replace("{word}", word) for p in lexicon.RESPONSE]
            within = lambda start: let(F.substring(low, start + 1, place["at"] + lexicon.NEAR - start), lambda window: F.flatten(F.array(*[of_phrase(window, start, k, p) for k, p in enumerate(phrases)])))
            return let(F.greatest(F.lit(0), place["at"] - lexicon.NEAR), within)

        return F.flatten(F.transform(occurrences(low, word), round_one))

    found = let(F.lower(text), lambda low: F.flatten(F.array(*[near(low, k, w) for k, w in enumerate(words)])))
    return F.array_min(F.filter(found, lambda x: x["value"].between(0, 100)))["value"]


def median_time(text: Column, words: list[str], unit: str = "months") -> Column:
    """The first median given in the unit within a keyword's sentence."""
    forms = [p.replace("{word}", w).replace("{unit}", unit) for w in words for p in lexicon.MEDIAN]
    return F.coalesce(*[number(F.lower(text), "(?s)" + p) for p in forms])


def sample_size(text: Column) -> Column:
    """The upper median of all plausible counts of patients (5 to 100,000)."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(FOLD + p), F.lit(1)) for p in lexicon.SAMPLE_SIZE]))
    numbers = F.array_sort(F.filter(F.transform(found, lambda s: s.try_cast("long")), lambda n: n.between(5, 100_000)))
    return let(numbers, lambda n: F.get(n, F.floor(F.size(n) / 2).cast("int")))


def size_from_interval(text: Column, percent: Column) -> Column:
    """n whose 95 % interval would be as wide as the one given next to the percentage (of which it is within 5)."""

    def sizes(pattern: str) -> Column:
        return F.transform(occurrences(F.lower(text), pattern), lambda m: F.struct(*[number(m["hit"], pattern, g).alias(n) for g, n in enumerate(("point", "low", "high"), 1)]))

    share = percent / 100
    n = lambda x: F.rint(F.lit(1.96**2) * share * (1 - share) / F.pow((x["high"] - x["low"]) / 200, F.lit(2.0)))
    fits = F.filter(F.concat(*map(sizes, lexicon.INTERVAL)), lambda x: (F.abs(x["point"] - percent) <= 5) & ((x["high"] - x["low"]) / 2 >= 0.5))
    found = F.filter(F.transform(fits, n), lambda x: x.between(5, 100_000))
    return F.when((percent > 0) & (percent < 100), F.get(found, F.lit(0)).cast("long"))


def hazard_ratio(text: Column, words: list[str]) -> Column:
    """A struct (ratio, low, high) near the first match of a keyword, if 0 < ratio < 10 and 0 < low < high < 10."""
    def of_form(window: Column, form: str) -> Column:
        fits = lambda t: F.when((t["ratio"] > 0) & (t["ratio"] < 10) & (t["low"] > 0) & (t["low"] < t["high"]) & (t["high"] < 10), t)
        return let(F.struct(*[number(window, form, g).alias(n) for g, n in enumerate(("ratio", "low", "high"), 1)]), fits)

    def of_word(low: Column, word: str) -> Column:
        def near(first: Column) -> Column:
            start = F.greatest(F.lit(0), first["at"] - lexicon.BEFORE)
            window = F.substring(low, start + 1, first["at"] + F.char_length(first["hit"]) + lexicon.AFTER - start)
            return F.when(first.isNotNull(), let(window, lambda w: F.coalesce(*[of_form(w, f) for f in lexicon.RATIO])))

        return let(F.get(occurrences(low, word), F.lit(0)), near)

    return let(F.lower(text), lambda low: F.coalesce(*[of_word(low, w) for w in words]))


def _steps(rows: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(lambda df, step: step(df), steps, rows)


def study_table(articles: DataFrame) -> DataFrame:
    """Articles (title, abstract and any other columns) with tags, figures and flags; rows without an abstract are dropped."""
    text, words = F.col("_text"), lexicon.OUTCOMES
    low = F.lower(text)
    percents = {"orr": "ORR", "cr_rate": "CR", "pr_rate": "PR"}
    ratios = {"hr_pfs": "PFS", "hr_os": "OS"}
    return _steps(
        articles.where(F.length("abstract") > 0).withColumn("_text", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.col("abstract"))),
        lambda df: df.withColumns({
            "subtypes": tags(low, lexicon.SUBTYPES, "Unspecified"), "drugs": tags(low, lexicon.THERAPIES, "Unspecified"), "study_type": tags(low, lexicon.STUDY_TYPES, "Unknown"),
            "adverse_events": tags(low, lexicon.ADVERSE, "Not reported"), "sample_size": sample_size(text), "pfs_median": median_time(text, words["PFS"]), "os_median": median_time(text, words["OS"]),
            **{f"_{n}": nearest_percentage(text, words[k]) for n, k in percents.items()}, **{f"_{n}": hazard_ratio(text, words[k]) for n, k in ratios.items()},
            **{k: matches(low, p) for k, p in lexicon.FLAGS.items()},
        }),
        lambda df: df.withColumns({
            **{n: F.col(f"_{n}") / 100 for n in percents}, **{f"{n}{tail}": F.col(f"_{n}")[field] for n in ratios for tail, field in (("", "ratio"), ("_ci_lower", "low"), ("_ci_upper", "high"))},
            "sample_size": F.coalesce("sample_size", *[size_from_interval(text, F.col(f"_{n}")) for n in percents]),
            "is_rct": F.col("study_type").contains("RCT"), "is_meta": F.col("study_type").contains("Meta-Analysis"),
        }).drop("_text", *[f"_{n}" for n in (*percents, *ratios)]),
    )


def has_efficacy(studies: DataFrame) -> DataFrame:
    """Studies with any figure of efficacy."""
    return studies.where(F.coalesce("orr", "cr_rate", "pr_rate", "pfs_median", "os_median", "hr_pfs", "hr_os").isNotNull())
