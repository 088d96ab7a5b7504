"""Text expressions: normalisers, counters and parsers.

Unicode normal forms and case folding have no built-in and run as Arrow-batched functions; all else is native.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType


@pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@pandas_udf(StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


@pandas_udf(StringType())
def folded_words(texts: pd.Series) -> pd.Series:
    """NFKC, case folding, white space collapsed to single spaces."""
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()), na_action="ignore")


@pandas_udf(StringType())
def alnum_lower_exact(texts: pd.Series) -> pd.Series:
    """NFKC, lower case, letters and numbers only, by Python's tables."""
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).lower() if c.isalnum()), na_action="ignore")


def alnum_lower(text: Column) -> Column:
    """NFKC, lower case, letters and numbers only. Text of characters that NFKC leaves alone stays native; other text is normalised in Arrow batches."""
    plain = ~text.rlike(r"[^\x00-\x7F\x{BF}-\x{FF}]")  # ASCII and the letters of Latin-1
    return F.regexp_replace(F.lower(F.coalesce(F.when(plain, text), nfkc(F.when(~plain, text)))), r"[^\p{L}\p{N}]", "")


def ascii_alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^0-9a-z]", "")


def unicode_word(text: Column) -> Column:
    """Lower case without characters outside words, by Unicode's classes."""
    return F.regexp_replace(F.lower(text), r"(?U)\W", "")


def ws_lower(text: Column) -> Column:
    """Lower case with white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f\x85 ]+", " "))


def is_blank(text: Column) -> Column:
    """Null, or only white space by Unicode's and Python's rules."""
    return F.coalesce(text.rlike(r"^(?U)[\s\x1c-\x1f]*$"), F.lit(True))


def char_ngrams(text: Column, n: int, short: str = "whole") -> Column:
    """Distinct character n-grams. A shorter text gives itself ("whole") or nothing ("none").

    Arrow-batched: cutting n-grams natively costs the position of each in UTF-8, quadratic in long texts.
    """

    @pandas_udf(ArrayType(StringType()))
    def grams(texts: pd.Series) -> pd.Series:
        def cut(t: str | None) -> list[str]:
            if t is None or len(t) < n:
                return [t] if t and short == "whole" else []
            return list(dict.fromkeys([t[i : i + n] for i in range(len(t) - n + 1)]))

        return texts.map(cut)

    return grams(text)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def repetition_ratio(text: Column, n: int = 4) -> Column:
    """1 - distinct / all character n-grams; 0 below n characters."""
    return F.when(F.length(text) >= n, 1 - F.size(char_ngrams(text, n)) / (F.length(text) - n + 1)).otherwise(F.lit(0.0))


def rep_penalty(text: Column, n: int = 3, cap: float = 0.5) -> Column:
    """min(cap, share of repeated token n-grams * 2 cap); tokens are words or single marks."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
    count = F.size(tokens) - n + 1
    grams = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, n), "\u0001"))
    share = (count - F.size(F.array_distinct(grams))) * (2 * cap) / count
    return F.when(count > 0, F.least(F.lit(cap), share)).otherwise(F.lit(0.0))


def count_class(text: Column, java_class: str) -> Column:
    """Characters of a class, as the length that is left when the others go."""
    return F.length(F.regexp_replace(text, f"[^{java_class}]", ""))


#: Fixed Unicode ranges of scripts.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
LATIN = r"A-Za-z\x{00C0}-\x{024F}"
DIGIT = r"0-9"


def script_counts(text: Column) -> dict[str, Column]:
    total, cjk, latin, digit = F.length(text), count_class(text, CJK), count_class(text, LATIN), count_class(text, DIGIT)
    return {"chars": total, "cjk": cjk, "latin": latin, "digit": digit, "other": total - cjk - latin - digit}


def domain_class(text: Column, markers: list[tuple[str, list[str]]]) -> Column:
    """The first domain a marker of which occurs, else by the share of CJK or Latin characters."""
    low, visible = F.lower(text), F.regexp_replace(text, r"(?U)\s", "")
    size = F.greatest(F.length(visible), F.lit(1))
    out = None
    for name, words in markers:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(count_class(text, r"\x{4E00}-\x{9FFF}") / size >= 0.35, "chinese").when(count_class(text, "A-Za-z") / size >= 0.55, "english")


#: Fixed stop words by which a response's language is judged.
STOPWORDS = {
    "english": "the and of to in is that for with as on are this be by an it",
    "spanish": "el la los las de del y en que para con una un es por como",
    "french": "le la les de des et en que pour avec une un est dans du",
    "german": "der die das den dem des und ist in zu mit für von auf ein eine",
    "italian": "il lo la gli le di del e in che per con una un è",
    "portuguese": "o a os as de do da e em que para com uma um é",
    "dutch": "de het een en van in dat voor met op is",
}
#: Fixed code point ranges of languages judged by script.
SCRIPTS = {
    "chinese": "4e00-9fff", "japanese": "3040-30ff", "korean": "ac00-d7af", "arabic": "0600-06ff", "russian": "0400-04ff",
    "ukrainian": "0400-04ff", "hindi": "0900-097f", "greek": "0370-03ff", "hebrew": "0590-05ff",
}


def stopword_scores(text: Column) -> dict[str, Column]:
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z\x{00C0}-\x{00FF}]+"), F.lit(0))
    return {k: F.size(F.filter(tokens, _one_of(v.split()))) for k, v in STOPWORDS.items()}


def _one_of(words: list[str]):
    return lambda t: t.isin(*words)


def language_matches(text: Column, language: str) -> Column:
    """Whether a text is in a language: five characters of its script, or stop words well ahead of all others."""
    if language in SCRIPTS:
        lo, hi = SCRIPTS[language].split("-")
        return count_class(text, rf"\x{{{lo}}}-\x{{{hi}}}") >= 5
    scores = stopword_scores(text)
    other = F.greatest(*[v for k, v in scores.items() if k != language])
    n = F.size(F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z\x{00C0}-\x{00FF}]+"), F.lit(0)))
    return (n >= 8) & (scores[language] >= 3) & (scores[language] >= other + 2)


def word_count(text: Column) -> Column:
    """Words, inner hyphens and apostrophes included."""
    return F.regexp_count(text, F.lit(r"(?U)\b\w+(?:[-'’]\w+)*\b"))


def sentence_count(text: Column) -> Column:
    """Parts of text between sentence ends that white space or the end follows."""
    marked = F.regexp_replace(F.trim(text), r"([.!?。！？])(?:\s+|$)", "$1\u0001")
    return F.size(F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != ""))


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\n\s*\n+"), lambda s: F.trim(s) != ""))


def list_items(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^\s*(?:\d+[.)]|[-*+])\s+\S"))


def bullet_groups(text: Column) -> Column:
    """Sizes of the runs of bullet lines; blank lines, and indented lines in a run, do not end it."""

    def step(acc: Column, line: Column) -> Column:
        bullet = line.rlike(r"^\s*[-*+]\s+\S")
        passes = (F.trim(line) == "") | (acc["active"] & line.rlike(r"^\s"))
        last = F.size(acc["sizes"])
        grown = F.when(acc["active"], F.concat(F.slice(acc["sizes"], 1, F.greatest(last - 1, F.lit(0))), F.array(F.coalesce(F.try_element_at(acc["sizes"], F.greatest(last, F.lit(1))), F.lit(0)) + 1)))
        grown = grown.otherwise(F.concat(acc["sizes"], F.array(F.lit(1))))
        return F.struct(
            F.when(bullet, grown).otherwise(acc["sizes"]).alias("sizes"),
            F.when(bullet, F.lit(True)).when(passes, acc["active"]).otherwise(F.lit(False)).alias("active"),
        )

    start = F.struct(F.array().cast("array<int>").alias("sizes"), F.lit(False).alias("active"))
    return F.aggregate(F.split(text, r"\r\n|[\n\r]"), start, step, lambda acc: acc["sizes"])


def highlight_count(text: Column) -> Column:
    bold = F.regexp_count(text, F.lit(r"(?s)\*\*.+?\*\*|__.+?__"))
    return bold + F.regexp_count(text, F.lit(r"(?<!\*)\*(?!\*)([^*\n]+)(?<!\*)\*(?!\*)"))


def strip_thinking(text: Column) -> Column:
    """Text without a leading thinking block, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?s)^\s*<think>.*?</think>\s*", ""))


def tool_calls(text: Column) -> Column:
    """The bodies of <tool_call> elements."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1)), lambda b: F.trim(b))


def valid_tool_calls(text: Column) -> Column:
    """How many tool calls are JSON objects with a name."""
    return F.size(F.filter(tool_calls(text), lambda b: F.get_json_object(b, "$.name").isNotNull()))


def parse_choice(text: Column, labels: str = "ABCD") -> Column:
    """The one label that stands alone in the text, or null if there is none or several."""
    found = F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(rf"(?<![A-Z0-9])([{labels}])(?![A-Z0-9])"), F.lit(1)))
    return F.when(F.size(found) == 1, found[0])


def strict_choice(text: Column, labels: str = "ABCD") -> Column:
    hit = F.regexp_extract(F.trim(text), rf"^([{labels}])$", 1)
    return F.when(hit != "", hit)


def parse_integer(text: Column) -> Column:
    hit = F.regexp_extract(F.trim(text), r"^([+-]?\d{1,18})$", 1)
    return F.when(hit != "", hit.cast("long"))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")


def finite(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def as_percent(value: Column) -> Column:
    number = finite(value)
    return F.when(F.abs(number) <= 1, number * 100).otherwise(number)
