"""Column expressions over source text: tokens, stems, similarity, line measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and signs that count towards complexity, by language.
COMPLEXITY_WORDS = {
    "python": ("if", "elif", "for", "while", "except", "case", "and", "or", "with"),
    "rust": ("if", "for", "while", "loop", "match"),
    "javascript": ("if", "for", "while", "case", "catch", "switch"),
    "typescript": ("if", "for", "while", "case", "catch", "switch"),
    "tsx": ("if", "for", "while", "case", "catch", "switch"),
    "csharp": ("if", "for", "foreach", "while", "case", "catch", "switch"),
    "go": ("if", "for", "switch", "case", "select"),
}
COMPLEXITY_SIGNS = {"rust": ("&&", "||"), "javascript": ("&&", "||", "?"), "typescript": ("&&", "||", "?"), "tsx": ("&&", "||", "?"), "csharp": ("&&", "||", "?"), "go": ("&&", "||")}

WORD = "[A-Za-z0-9_-]+"


def words(line: Column) -> Column:
    """ASCII words of a line, with ``_`` and ``-``."""
    return F.regexp_extract_all(line, F.lit(f"({WORD})"), F.lit(1))


def identifier_parts(word: Column) -> Column:
    """Parts of an identifier: at ``_`` and ``-``, at case and digit borders, ``HTTPServer`` before ``Server``."""
    cut = word
    for pattern in ("([a-z])(?=[A-Z])", "([0-9])(?=[A-Za-z])", "([A-Za-z])(?=[0-9])", "([A-Z])(?=[A-Z][a-z])"):
        cut = F.regexp_replace(cut, pattern, "$1_")
    return F.filter(F.split(cut, "[_-]"), lambda p: p != "")


def stem(token: Column) -> Column:
    """Strips one common ending."""
    n = F.length(token)
    return (
        F.when((n > 5) & token.rlike("(ing|ers)$"), F.left(token, n - 3))
        .when((n > 4) & token.rlike("(er|ed|es)$"), F.left(token, n - 2))
        .when((n > 3) & token.rlike("[^s]s$"), F.left(token, n - 1))
        .otherwise(token)
    )


def normal_token(raw: Column) -> Column:
    """A stemmed token of ASCII letters and digits in lower case, null below two or without letter."""
    plain = F.lower(F.regexp_replace(raw, "[^A-Za-z0-9]", ""))
    return F.when((F.length(plain) >= 2) & plain.rlike("[a-z]"), stem(plain))


def line_tokens(line: Column) -> Column:
    """Distinct tokens of each word of a line: the word and its parts."""
    both = F.flatten(F.transform(words(line), lambda w: F.array_distinct(F.concat(F.array(normal_token(w)), F.transform(identifier_parts(w), normal_token)))))
    return F.filter(both, lambda t: t.isNotNull())


def abbreviates(a: Column, b: Column) -> Column:
    """Whether the shorter (2 or 3 characters) is a subsequence of the longer (3 longer at least)."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    pattern = F.regexp_replace(short, "(.)", "$1.*")
    return F.length(short).between(2, 3) & (F.length(long) >= F.length(short) + 3) & F.regexp(long, pattern)


def similarity(query: Column, token: Column) -> Column:
    """1 for equal, less for prefixes, parts, abbreviations and small edit distances, else 0."""
    ratio = 1 - F.levenshtein(query, token).cast("double") / F.greatest(F.length(query), F.length(token))
    return (
        F.when(query == token, 1.0)
        .when(token.startswith(query) | query.startswith(token), 0.9)
        .when(token.contains(query) | query.contains(token), 0.8)
        .when(abbreviates(query, token), 0.6)
        .when(ratio >= 0.65, ratio)
        .otherwise(0.0)
    )


def complexity(text: Column, language: Column) -> Column:
    """1 and one for each branching word or sign of the language."""
    out = F.lit(1)
    for name, keywords in COMPLEXITY_WORDS.items():
        count = F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(keywords)})(?![\p{{L}}\p{{N}}_])"))
        for sign in COMPLEXITY_SIGNS.get(name, ()):
            count = count + F.regexp_count(text, F.lit("".join(f"\\{c}" for c in sign)))
        out = F.when(language == name, 1 + count).otherwise(out)
    return out.cast("long")


def duplication_hash(text: Column) -> Column:
    """A digest of the text without white space; null if nothing is left."""
    bare = F.regexp_replace(text, r"\s", "")
    return F.when(bare != "", F.md5(bare))


def snippet(text: Column, most: int = 200) -> Column:
    """White space collapsed, cut to ``most`` bytes at a character."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.octet_length(one) <= most, one).otherwise(utf8_prefix(one, most))


def utf8_prefix(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` bytes that ends with a whole character."""
    state = lambda size, n: F.struct(size.cast("int").alias("size"), n.cast("int").alias("n"))
    kept = F.aggregate(
        F.split(F.left(text, F.lit(most)), ""),
        state(F.lit(0), F.lit(0)),
        lambda a, c: F.when(a.size + F.octet_length(c) <= most, state(a.size + F.octet_length(c), a.n + F.length(c))).otherwise(state(F.lit(most), a.n)),
    )
    return F.left(text, kept.n)


def slice_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` of a text (from 1, both in); empty if there are none."""
    start = F.greatest(first, F.lit(1)).cast("int")
    return F.array_join(F.slice(F.split(text, "\n"), start, F.greatest(last.cast("int") - start + 1, F.lit(0))), "\n")


def line_bytes(text: Column, first: Column, last: Column) -> Column:
    """start and stop, in bytes, of lines ``first`` to ``last`` of a text, without the last line's end."""
    before = F.array_join(F.slice(F.split(text, "\n"), 1, F.greatest(first.cast("int") - 1, F.lit(0))), "\n")
    start = F.when(first > 1, F.octet_length(before) + 1).otherwise(0)
    return F.struct(start.cast("long").alias("start"), (start + F.octet_length(slice_lines(text, first, last))).cast("long").alias("stop"))


def slice_bytes(text: Column, start: Column, stop: Column) -> Column:
    """The characters of a text between two byte offsets; those that an offset cuts are left out."""
    part = F.substring(text.cast("binary"), start.cast("int") + 1, F.greatest((stop - start).cast("int"), F.lit(0)))
    return F.regexp_replace(F.make_valid_utf8(part.cast("string")), "^\ufffd+|\ufffd+$", "")
