"""Text normalisation as column expressions.

White space means Unicode white space; positions are 0-based code points. Only Unicode composition (NFC) needs Python: a
pandas UDF gets the texts that hold combining marks, and nulls for all others.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as L

#: Unicode white space, as (?U)\s has it.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BLOCK = 64


def running_sums(values: Column) -> Column:
    """The sums of the first 1, 2, ... of an array of ints: block by block, since arrays grow by copying."""
    state = "struct<at:int,sums:array<int>>"

    def prefix(part: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums")).cast(state)
        add = lambda acc, x: let(acc["at"] + x, lambda at: F.struct(at.alias("at"), F.array_append(acc["sums"], at).alias("sums")).cast(state))
        return F.aggregate(part, zero, add, lambda acc: acc["sums"])

    def by_blocks(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda k: prefix(F.slice(v, k * _BLOCK + 1, F.lit(_BLOCK))))
        shifted = lambda b: let(prefix(F.transform(b, lambda x: F.element_at(x, -1))), lambda ends: F.flatten(F.transform(b, lambda x, k: F.transform(x, lambda y: y + F.coalesce(F.get(ends, k - 1), F.lit(0))))))
        return let(blocks, shifted)

    return let(values, lambda v: F.when(F.size(v) <= _BLOCK, prefix(v)).otherwise(by_blocks(v)))


def pieces(text: Column, expression: str) -> Column:
    """text split at an expression, which split() would compile for each row; whether an empty piece comes first is open."""
    mark = "\x01"
    return let(text, lambda t: F.when(t.contains(mark), F.split(t, expression)).otherwise(F.split(F.regexp_replace(t, expression, mark), mark)))


def strip(text: Column) -> Column:
    """text without white space at both ends; looks at the ends only."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """text stripped, and every run of white space one space."""
    # single blanks, which are most, are passed over
    return F.btrim(F.regexp_replace(text, r"(?U)[^\S ]\s*| \s+", " "))


def more_words(text: Column, most: int) -> Column:
    """Whether text has more than `most` words. That many need a character and a blank each, so short texts aren't split."""
    return (F.length(text) > 2 * most) & (count_words(text) > most)


def words(text: Column) -> Column:
    """The runs of characters that aren't white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words(text))


def nfc(text: Column) -> Column:
    """text in composed form. Texts without combining marks are left alone."""

    @F.pandas_udf(StringType())
    def compose(marked: pd.Series) -> pd.Series:
        return marked.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))

    return F.coalesce(compose(F.when(text.rlike(r"\p{M}"), text)), text)


#: Ranges that hold all characters of L.REPLACED and L.REPLACED_ANNOTATED, and others that stay as they are.
_ODD = "[\u00a0\u200b-\u201d\ufeff-\ufffe]"


def normalize(text: Column, profile: str = "predict") -> Column:
    """Characters and glued words put right, runs of blanks one space. Profiles: train, predict, annotated.

    annotated also joins punctuation to the word before it and strips the text.
    """
    glued = {"train": L.GLUED_TRAIN, "predict": L.GLUED_PREDICT, "annotated": L.GLUED_ANNOTATED}[profile]
    chars = L.REPLACED_ANNOTATED if profile == "annotated" else L.REPLACED
    kept = [(a, b) for a, b in chars.items() if b] + [(a, b) for a, b in chars.items() if not b]

    def put_apart(plain: Column) -> Column:
        out = plain
        for bad, good in glued.items():
            out = F.replace(out, F.lit(bad), F.lit(good))
        return F.when(_contains_any(plain, list(glued)), out).otherwise(plain)

    # most texts hold none of these characters and words: one look at ranges of characters, and one for each word, spare them the replacement
    put_right = lambda plain: F.when(plain.rlike(_ODD), F.translate(plain, "".join(a for a, _ in kept), "".join(b for _, b in kept))).otherwise(plain)
    blanks = lambda out: F.when(out.contains("  ") | out.contains("\t"), F.regexp_replace(out, r"[ \t]+", " ")).otherwise(out)
    out = let(let(let(nfc(text), put_right), put_apart), blanks)
    return strip(F.regexp_replace(out, r"(?U)\s+([,.;:!?])", "$1")) if profile == "annotated" else out


@lru_cache(maxsize=1)
def _fold_map() -> tuple[str, str]:
    """Letters with marks and the capital letters below them, from the Unicode tables; one character for one."""
    source, target = ["đ", "Đ", "ß"], ["D", "D", "ẞ"]
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if bare != chr(code) and len(bare.upper()) == 1:
            source.append(chr(code))
            target.append(bare.upper())
    return "".join(source), "".join(target)


def fold_upper(text: Column) -> Column:
    """Capitals without accents. One character for one, so that positions in the result hold for the text."""
    return F.upper(F.translate(text, *_fold_map()))


def fold_words(text: Column) -> Column:
    return collapse(fold_upper(text))


def clean_raw(text: Column, profile: str = "predict") -> Column:
    """normalize(), then without page numbers, rules and (predict) the national motto; at most one empty line in a row."""
    page, rule, motto = r"\s*\d{1,3}\s*", r"\s*[-–—_\s]{3,}", r"\s*(?:" + "|".join(L.MOTTO) + r")\s*"
    skip = f"{L.FLAGS}^(?:{page}|{rule}{'|' + motto if profile == 'predict' else ''})$"
    # a split at one character needs no expression, which would be compiled for each row
    cut = lambda t: F.when(t.contains("\r"), F.split(t, r"\r\n|[\n\r]")).otherwise(F.split(t, "\n"))
    lines = F.transform(F.filter(let(normalize(text, profile), cut), lambda x: ~x.rlike(skip)), lambda x: F.rtrim(x, F.lit(SPACES)))
    joined = lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)
    return strip(let(F.array_join(lines, "\n"), joined))


def source_key(stem: Column) -> Column:
    """A file's stem without a copy number in brackets behind it."""
    return strip(F.regexp_replace(stem, r"(?U)\s*\(\d+\)\s*$", ""))


def normalize_paragraph(block: Column) -> Column:
    """The lines of a block as one, without page numbers and section titles."""
    lines = F.transform(F.split(block, "\n"), strip)
    title = L.any_of([f"^(?:{'|'.join(L.TITLE_LINES)})~:?~$"])
    return collapse(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\d{1,3}$") & ~x.rlike(title)), " "))


def strip_tail_noise(text: Column) -> Column:
    """text up to the first remark on evidence or measures."""
    for mark in L.TAIL_NOISE:
        text = strip(F.regexp_replace(text, rf"(?s){L.FLAGS}\s*{L.pattern(mark)}.*$", ""))
    return text


def trim_entity(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(L.TRIM))


def norm_drug(text: Column) -> Column:
    """The canonical name of a drug; a name that no rule knows stays as it is."""
    name = trim_entity(text)
    low = F.translate(F.lower(name), '“”"', "")
    out = name
    object_, near, canon = L.CRYSTAL
    out = F.when(low.contains(object_) & _contains_any(low, near), canon).otherwise(out)
    for marks, canon in reversed(L.DRUG_CANON):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | (low == mark[1:] if mark.startswith("=") else low.contains(mark))
        if marks == ["amphetamine"]:
            hit = hit & ~low.contains(L.NOT_AMPHETAMINE)
        out = F.when(hit, canon).otherwise(out)
    return out


def _contains_any(text: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | text.contains(part)
    return hit


def norm_weight(text: Column) -> Column:
    out = F.regexp_replace(trim_entity(text), r"(?U)\s+", " ")
    for unit in ("g", "gram"):
        out = F.regexp_replace(out, rf"{L.FLAGS}\b{unit}\b", "gam")
    return out


def norm_article(text: Column) -> Column:
    return F.regexp_replace(trim_entity(text), r"(?U)\s+", " ")


norm_sentence = norm_article


def norm_charge(text: Column) -> Column:
    return F.regexp_replace(F.btrim(trim_entity(text), F.lit("“”\"'")), r"(?U)\s+", " ")


def cut_person(text: Column) -> Column:
    """A name up to the first word that can't belong to it."""
    return strip(F.regexp_replace(text, rf"(?s){L.FLAGS}\s+(?:{'|'.join(L.PERSON_ENDS)})\b.*$", ""))


def norm_person(text: Column) -> Column:
    return cut_person(F.regexp_replace(trim_entity(text), r"(?U)\s+", " "))


def clean_word(text: Column) -> Column:
    """Letters, digits, white space and , . - / only, collapsed."""
    return collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\p{L}\p{N}\s,.\-/]", ""))


def compare_key(text: Column, quotes: bool = False) -> Column:
    """Lower-cased and collapsed; quotes: without double quotes, too."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return collapse(F.regexp_replace(low, "[“”\"]", "") if quotes else low)


def token_key(text: Column) -> Column:
    """A word for search: lower-cased letters and digits."""
    return F.regexp_replace(F.lower(F.replace(text, F.lit("\u00a0"), F.lit(" "))), "[^0-9a-zà-ỹđ]+", "")


def capitalize_sentences(text: Column) -> Column:
    """Capitals at the start of sentences and in fixed legal words and acronyms."""
    parts = F.split(collapse(text), r"(?<=[.!?] )")
    out = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p)))), "")
    out = F.regexp_replace(out, rf"{L.FLAGS}\bđiều\b", "Điều")
    for name in ("BLHS", "BLTTHS", "MDMA", "PC09", "VKS", "HĐXX"):
        out = F.regexp_replace(out, rf"{L.FLAGS}\b{name}\b", name)
    return out


def slug(text: Column, default: str = "file", most: int = 90) -> Column:
    """A file name's stem in ASCII: other characters and white space become _."""
    stem = F.regexp_replace(F.coalesce(text, F.lit("")), r"^.*/|(?<=[^/.])\.[^./]*$", "")
    source, target = zip(*[(a, b) for a, b in _ascii_map()], strict=True)
    plain = F.regexp_replace(F.translate(stem, "".join(source), "".join(target)), r"[^\x00-\x7F]+", "")
    plain = F.when(plain == "", default).otherwise(plain)
    named = F.regexp_replace(F.regexp_replace(plain, r"[^0-9A-Za-z._ -]+", "_"), r"[\s_]+", "_")
    out = F.left(F.lower(F.btrim(named, F.lit("._-"))), F.lit(most))
    return F.when(out == "", default).otherwise(out)


@lru_cache(maxsize=1)
def _ascii_map() -> list[tuple[str, str]]:
    out = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(bare) == 1:
            out.append((chr(code), bare))
    return out


def file_slug(text: Column, default: str = "ket_qua_ner", most: int = 80) -> Column:
    """A report's file name: letters, digits, - and _ of any script."""
    out = F.left(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\.pdf$", ""), r"[^\p{L}\p{N}_-]+", "_"), F.lit(most))
    return F.when(out == "", default).otherwise(out)


def split_name(value: Column) -> Column:
    low = F.lower(strip(value.cast("string")))
    return F.when(low.isin("train", "training"), "Training").when(low.isin("val", "valid", "validation", "dev"), "Validation").when(low.isin("test", "testing"), "Testing").otherwise(F.initcap(low))


def _lookup(value: Column, table: dict[str, str], default: Column) -> Column:
    out = default
    for key, to in table.items():
        out = F.when(value == key, to).otherwise(out)
    return out


def label_alias(label: Column) -> Column:
    return _lookup(label, L.LABEL_ALIASES, label)


def html_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def label_title(label: Column) -> Column:
    return _lookup(label, L.LABEL_TITLES, label)


def section_title(section: Column) -> Column:
    return _lookup(section, L.SECTION_TITLES, section)


def section_name(section: Column) -> Column:
    return _lookup(section, L.SECTION_NAMES, F.lit(L.UNKNOWN_SECTION_NAME))


def context_prefix(text: Column) -> Column:
    return F.left(text, F.lit(L.CONTEXT_CHARS))


def beyond_basic(text: Column) -> Column:
    """Whether text has a character beyond the basic plane."""
    return text.rlike(r"[\x{10000}-\x{10FFFF}]")


def position(text: Column, expression: str, wide: Column | None = None) -> Column:
    """Where the first match begins; null without one. wide: beyond_basic(text), where several searches share it."""

    def place(at: Column) -> Column:
        # at counts two for a character beyond the basic plane; texts with one are split, which counts code points but compiles the expression for each row
        split = F.length(F.get(F.split(text, expression, 2), F.lit(0)))
        return F.when(at > 0, F.when(beyond_basic(text) if wide is None else wide, split).otherwise(at - 1))

    return let(F.regexp_instr(text, F.lit(expression)), place)
