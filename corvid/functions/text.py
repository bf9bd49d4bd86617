"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid import config

#: White space as Python's str.isspace has it; Java's own classes miss some of it.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def fold(c: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(text(c), SPACE, "")


def fold_glyphs(c: Column | str) -> Column:
    """Folded, without bullets and table marks."""
    return F.translate(fold(c), config.GLYPHS, "")


def canon(c: Column | str) -> Column:
    """Digits, ASCII letters and Hangul syllables only."""
    return F.regexp_replace(text(c), "[^0-9A-Za-z가-힣]", "")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(text(c), f"^{SPACE}+|{SPACE}+\\z", "")


def fold_title(c: Column | str) -> Column:
    return F.lower(fold(c))


def excluded_chapter(c: Column | str) -> Column:
    """Back matter: references anywhere in the title, appendix or attachment at its start."""
    t = canon(c)
    return t.contains("참고문헌") | t.startswith("부록") | t.startswith("첨부")


def last_index(c: Column, part: str) -> Column:
    """0-based start of the last ``part`` in ``c``, -1 if there is none."""
    back = F.locate(part[::-1], F.reverse(c))
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(c) - (back - 1) - len(part))


def truncate_middle(c: Column | str, cap: int) -> Column:
    """Three quarters of ``cap`` from the head and the rest from the tail, at line ends, with a mark between."""
    c, head_len = text(c), int(cap * 0.75)
    head = F.substring(c, 1, head_len)
    cut = last_index(head, "\n")
    head = F.when(cut > 0, F.substring(head, F.lit(1), cut)).otherwise(head)
    tail = F.substring(c, -(cap - head_len), cap - head_len)
    feed = F.locate("\n", tail)
    tail = F.when(feed > 0, F.substring(tail, feed + 1, F.length(tail))).otherwise(tail)
    left_out = F.length(c) - F.length(head) - F.length(tail)
    number = lambda n: F.format_number(n, 0)
    mark = F.concat(F.lit("\n\n[... 중략: 전체 "), number(F.length(c)), F.lit("자 중 "), number(left_out), F.lit("자 생략 ...]\n\n"))
    return F.when(F.length(c) <= cap, c).otherwise(F.concat(head, mark, tail))


def tidy_summary(c: Column | str, most: int = config.SUMMARY_CHARS) -> Column:
    """One line without bullet, label and quotes, cut at a sentence end; null where that can't be had."""
    s = strip(F.regexp_replace(text(c), f"{SPACE}+", " "))
    s = F.regexp_replace(s, r"^(?:[-*•>]\s+)+", "")
    s = F.regexp_replace(s, r"^\*\*요약[::]?\*\*\s*", "")
    s = F.regexp_replace(s, r"^요약[::]\s*", "")
    s = F.regexp_replace(s, "^[\"'“”‘’ ]+|[\"'“”‘’ ]+\\z", "")
    cut = F.substring(s, 1, most)
    at = F.greatest(last_index(cut, "다."), last_index(cut, ". "), last_index(cut, "함."))
    short = F.when(at >= 100, F.rtrim(F.substring(cut, F.lit(1), at + 2)))
    return F.nullif(F.when(F.length(s) <= most, s).otherwise(short), F.lit(""))


def roman_to_int(c: Column | str) -> Column:
    """Subtractive Roman numeral in ASCII letters; other characters count 0."""
    value = lambda x: F.when(x == "I", 1).when(x == "V", 5).when(x == "X", 10).when(x == "L", 50).when(x == "C", 100).otherwise(0)
    letters = F.filter(F.split(text(c), ""), lambda x: x != "")
    values = F.transform(letters, value)
    signed = F.transform(values, lambda v, i: F.when(F.coalesce(F.get(values, i + 1), F.lit(0)) > v, -v).otherwise(v))
    return F.aggregate(signed, F.lit(0), lambda a, x: a + x)


def join_fragments(parts: Column) -> Column:
    """Wrapped lines as one: a space only where Latin or digits meet, or Hangul meets them."""
    parts = F.filter(F.transform(parts, strip), lambda x: x != "")

    def add(out, x):
        latin = out.rlike(r"[A-Za-z0-9%).]\z") & x.rlike("^[A-Za-z0-9(]")
        hangul = out.rlike(r"[가-힣]\z") & x.rlike("^[A-Za-z0-9]")
        return F.when(out == "", x).otherwise(F.concat(out, F.when(latin | hangul, F.lit(" ")).otherwise(F.lit("")), x))

    return F.aggregate(parts, F.lit(""), add)


def split_keywords(c: Column | str) -> Column:
    """Keywords by comma, else by middle dot, else as one."""
    t = F.regexp_replace(strip(join_fragments(F.split(text(c), "\n"))), r"\.+\z", "")
    parts = lambda sep: F.filter(F.transform(F.split(t, sep), strip), lambda x: x != "")
    return F.when(t == "", F.array().cast("array<string>")).when(t.contains(","), parts(",")).when(t.contains("·"), parts("·")).otherwise(F.array(t))


def title_tokens(c: Column | str, stop: list[str] | None = None) -> Column:
    """Distinct Hangul words of three syllables or more, without stop words, sorted."""
    found = F.regexp_extract_all(text(c), F.lit("[가-힣]{3,}"), F.lit(0))
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, config.TITLE_STOP if stop is None else stop))))


def digest(c: Column | str) -> Column:
    return F.sha2(text(c).cast("binary"), 256)


def hangul_ordinal(c: Column | str) -> Column:
    """1-based place among 가나다…; 0 for others."""
    return F.instr(F.lit("가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허"), F.substring(text(c), 1, 1))


def chapter_value(c: Column | str) -> Column:
    """Number that a chapter token stands for: a Unicode Roman sign, ASCII Roman letters, or digits; else null."""
    c = text(c)
    return F.when(c.rlike(r"^[Ⅰ-Ⅻ]\z"), F.instr(F.lit("ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ"), c)).when(c.rlike(r"^[IVXLC]+\z"), roman_to_int(c)).otherwise(c.try_cast("int"))


def heading_number(c: Column | str) -> Column:
    """A number in digits, or a Hangul ordinal; null for others."""
    c = text(c)
    return F.coalesce(c.try_cast("int"), F.nullif(hangul_ordinal(c), F.lit(0)))


def unquote(c: Column | str) -> Column:
    """A quoted value without its quotes and escapes."""
    c = strip(c)
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    plain = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when((F.length(c) >= 2) & c.startswith('"') & c.endswith('"'), plain).otherwise(c)


def shingles(c: Column, n: int, sign: str = "[\\s\\S]") -> Column:
    """All stretches of ``n`` characters (each a ``sign``), overlaps and repeats included, in one pass."""
    return F.regexp_extract_all(c, F.lit(f"(?=({sign}{{{n}}}))"), F.lit(1))


def overlapping_count(c: Column, part: Column | str) -> Column:
    """Occurrences of a literal, overlaps included; 0 for an empty literal."""
    if isinstance(part, str):
        if not part:
            return F.lit(0)
        if not any(part[:k] == part[-k:] for k in range(1, len(part))):  # it can't overlap itself
            gone = F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))
            return F.when(c.contains(part), (gone / len(part)).cast("int")).otherwise(0)
        quoted = "\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return F.when(c.contains(part), F.regexp_count(c, F.lit(f"(?={quoted})"))).otherwise(0)
    return F.when(F.length(part) > 0, F.regexp_count(c, F.concat(F.lit("(?=\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)")))).otherwise(F.lit(0))
