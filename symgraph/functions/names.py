"""Symbol names as columns: tails, segments, fuzzy scores, distances. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHED, IN_ROW, SAME_LENGTH = 10, 5, 20

#: Names that frameworks and hosts give to their own plumbing.
NOISY = sorted(
    "$bindable $derived $effect $host $inspect $props $snippet $state addEventListener addListener callback cancelAnimationFrame catch cb clearInterval "
    "clearTimeout debug defineEmits defineExpose defineModel defineOptions defineProps defineSlots emit finally forceUpdate info log off on once "
    "preventDefault removeEventListener removeListener requestAnimationFrame setInterval setState setTimeout stopImmediatePropagation stopPropagation then trace warn withDefaults".split()
)


def _tail(c: Column, separators: str) -> Column:
    t = F.trim(c)
    last = F.regexp_extract(t, f"([^{separators}]+)$", 1)
    return F.when(last == "", t).otherwise(last)


def name_tail(c: Column) -> Column:
    """What follows the last of . / # @; the whole name where that is its last character."""
    return _tail(c, r"./#@")


def ref_tail(c: Column) -> Column:
    """The same without /: the tail that resolution looks up."""
    return _tail(c, r".#@")


def segments(c: Column) -> Column:
    """Lower-case parts of a camel-case, snake-case or dotted name; an acronym is one part."""
    s = F.regexp_replace(c, r"[_\-.$]", " ")
    s = F.regexp_replace(s, r"(\p{Ll})(?=\p{Lu})", "$1 ")
    s = F.regexp_replace(s, r"(\p{Lu})(?=\p{Lu}\p{Ll})", "$1 ")
    return F.filter(F.split(F.lower(s), r"\s+"), lambda x: x != "")


def fuzzy_score(query: Column, name: Column) -> Column:
    """How well the query's segments occur in name's, in order: 10 for each, 5 more for each after the first, 20 if there are as many; 0 unless all occur."""
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        hit = (acc["q"] < F.size(query)) & (x == F.get(query, acc["q"]))
        # a match after the first is never at the first place
        return F.when(hit, F.struct((acc["q"] + 1).alias("q"), (acc["score"] + MATCHED + F.when(acc["q"] > 0, IN_ROW).otherwise(0)).alias("score"))).otherwise(acc)

    done = F.aggregate(name, start, step)
    whole = (F.size(query) > 0) & (done["q"] == F.size(query))
    return F.when(whole, done["score"] + F.when(F.size(query) == F.size(name), SAME_LENGTH).otherwise(0)).otherwise(0)


def bounded_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, or most + 1 where it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def kebab_to_pascal(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def is_identifier(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")


def is_noisy(c: Column) -> Column:
    """Empty, or plumbing by its whole name or by what follows its last . or #."""
    t = F.trim(c)
    return (t == "") | t.isin(NOISY) | F.regexp_extract(t, r"([^.#]+)$", 1).isin(NOISY)


def has_whole_word(text: Column, word: str) -> Column:
    """Whether the first occurrence of word in text stands by itself: no letter, digit or _ beside it."""
    at = F.instr(text, word)
    before = F.substring(F.concat(F.lit(" "), text), at, F.lit(1))
    after = F.substring(F.concat(text, F.lit(" ")), at + len(word), F.lit(1))
    return (at > 0) & ~before.rlike("^[A-Za-z0-9_]$") & ~after.rlike("^[A-Za-z0-9_]$")
