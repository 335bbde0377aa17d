"""English inflection of words, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns with what replaces them; a later rule goes before an earlier one.
PLURAL = [
    (r"$", "s"),
    (r"s$", "s"),
    (r"(ax|test)is$", "$1es"),
    (r"(octop|vir)us$", "$1i"),
    (r"(alias|status)$", "$1es"),
    (r"(bu)s$", "$1ses"),
    (r"(buffal|tomat)o$", "$1oes"),
    (r"([ti])um$", "$1a"),
    (r"sis$", "ses"),
    (r"(?:([^f])fe|([lr])f)$", "$1$2ves"),
    (r"(hive)$", "$1s"),
    (r"([^aeiouy]|qu)y$", "$1ies"),
    (r"(x|ch|ss|sh)$", "$1es"),
    (r"(matr|vert|ind)ix|ex$", "$1ices"),
    (r"([m|l])ouse$", "$1ice"),
    (r"^(ox)$", "$1en"),
    (r"(quiz)$", "$1zes"),
]
SINGULAR = [
    (r"s$", ""),
    (r"(n)ews$", "$1ews"),
    (r"([ti])a$", "$1um"),
    (r"((a)naly|(b)a|(d)iagno|(p)arenthe|(p)rogno|(s)ynop|(t)he)ses$", "$1$2sis"),
    (r"(^analy)ses$", "$1sis"),
    (r"([^f])ves$", "$1fe"),
    (r"(hive)s$", "$1"),
    (r"(tive)s$", "$1"),
    (r"([lr])ves$", "$1f"),
    (r"([^aeiouy]|qu)ies$", "$1y"),
    (r"(s)eries$", "$1eries"),
    (r"(m)ovies$", "$1ovie"),
    (r"(x|ch|ss|sh)es$", "$1"),
    (r"([m|l])ice$", "$1ouse"),
    (r"(bus)es$", "$1"),
    (r"(o)es$", "$1"),
    (r"(shoe)s$", "$1"),
    (r"(cris|ax|test)es$", "$1is"),
    (r"(octop|vir)i$", "$1us"),
    (r"(alias|status)es$", "$1"),
    (r"^(ox)en", "$1"),
    (r"(vert|ind)ices$", "$1ex"),
    (r"(matr)ices$", "$1ix"),
    (r"(quiz)zes$", "$1"),
]
IRREGULAR = [("person", "people"), ("man", "men"), ("child", "children"), ("sex", "sexes"), ("move", "moves")]
UNCOUNTABLE = ["equipment", "information", "rice", "money", "species", "series", "fish", "sheep"]


def column(word: str | Column) -> Column:
    return F.col(word) if isinstance(word, str) else word


def changed(word: Column, rules: list[tuple[str, str]], irregular: list[tuple[str, str]]) -> Column:
    own = [(f"({a[0]}){a[1:]}$", f"$1{b[1:]}") for a, b in irregular]
    out = F.when(F.lower(word).isin(*UNCOUNTABLE), word)
    for pattern, by in reversed(rules + own):
        out = out.when(word.rlike(f"(?i){pattern}"), F.regexp_replace(word, f"(?i){pattern}", by))
    return out.otherwise(word)


def pluralize(word: str | Column) -> Column:
    return changed(column(word), PLURAL, IRREGULAR)


def singularize(word: str | Column) -> Column:
    return changed(column(word), SINGULAR, [(b, a) for a, b in IRREGULAR])


def underscore(word: str | Column) -> Column:
    """Package.InnerClass$Word -> package/inner_class__word."""
    w = F.replace(F.replace(column(word), F.lit("."), F.lit("/")), F.lit("$"), F.lit("__"))
    w = F.regexp_replace(w, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    w = F.regexp_replace(w, r"([a-z\d])([A-Z])", "$1_$2")
    return F.lower(F.translate(w, "-", "_"))


def joined_upper(word: Column, cut: str, mark: str) -> Column:
    """The parts between cuts, each after the first with a capital and after mark."""
    parts = F.split(word, f"{cut}(?=.)")
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p: F.concat(F.lit(mark), F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2))))
    return F.concat(parts[0], F.array_join(rest, ""))


def camelize(word: str | Column, lower_first: bool = False) -> Column:
    """package/inner_class__word -> package.InnerClass$Word."""
    w = F.replace(column(word), F.lit("/"), F.lit("."))
    head, last = F.regexp_extract(w, r"^(.*\.)?", 0), F.regexp_replace(w, r"^.*\.", "")
    w = F.concat(head, F.upper(F.left(last, F.lit(1))), F.substr(last, F.lit(2)))
    w = joined_upper(joined_upper(w, "__", "$"), "_", "")
    return F.concat(F.lower(F.left(w, F.lit(1))), F.substr(w, F.lit(2))) if lower_first else w


def capitalize(word: str | Column) -> Column:
    w = F.lower(column(word))
    return F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))


def humanize(word: str | Column) -> Column:
    return capitalize(F.translate(F.replace(column(word), F.lit("_id"), F.lit("")), "_", " "))


def titleize(word: str | Column) -> Column:
    parts = F.split(humanize(underscore(word)), r"(?=\b[a-z])")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "")


def depackage(word: str | Column) -> Column:
    return F.regexp_replace(column(word), r"^.*\.", "")


def foreign_key(word: str | Column, separate: bool = True) -> Column:
    return F.concat(underscore(depackage(word)), F.lit("_id" if separate else "id"))


def tableize(word: str | Column) -> Column:
    return pluralize(underscore(word))


def classify(word: str | Column) -> Column:
    return camelize(singularize(depackage(word)))


def ordinalize(n: str | Column) -> Column:
    """11 -> 11th, 101 -> 101st; negative numbers get th."""
    c = column(n)
    tens, ones = c % 100, c % 10
    suffix = F.when(tens.isin(11, 12, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(c.cast("string"), suffix)


def dasherize(word: str | Column) -> Column:
    return F.translate(column(word), "_", "-")
