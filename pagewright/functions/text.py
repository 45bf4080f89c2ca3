"""Tests and rewritings of text as column expressions. Patterns keep to what Java and RE2 read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bullets, roman labels, marks that continue a sentence.
BULLETS = "•–—◦▪‣○●■□▸▹►"
ROMANS = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()
ROMANS_LOOSE = "ii iii iv v vi vii viii ix x xi xii".split()
CONTINUES = r"^[\p{Ll},;.!?:)\]\-–—…]"
RTL_LANGUAGES = "ar arc dv fa ha he khw ks ku ps ur yi".split()
FORMATS = {"pdf": "pdf", "docx": "docx", "docm": "docx", "xlsx": "xlsx", "xls": "xlsx", "html": "html", "htm": "html"}

_LABEL = f"(?:0*[1-9][0-9]?|[a-zA-Z]|(?i:{'|'.join(ROMANS)}))"
LIST_BULLET = rf"^\s*(?:[{BULLETS}](?:$|[ \t])|[-*] [\s\S])"
LIST_ORDERED = rf"^\s*(?:\({_LABEL}\)|{_LABEL}[.)])(?:$| )"
MARKER = (
    rf"^\s*(?:[{BULLETS}](?:$|[ \t])|[-*] [\s\S]"
    rf"|\((?:[0-9A-Za-z]|[0-9]{{2}}|(?i:{'|'.join(ROMANS_LOOSE)}))\)(?:$| )|[0-9A-Za-z]{{1,6}}[.)](?:$| ))"
)
DEFINITION = r"^\s*([^\s:]+(?:[ \t]+[^\s:]+){0,3}): +\S"

#: Script ranges of right-to-left and left-to-right letters.
RTL = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"
LTR = r"[A-Za-z\x{00C0}-\x{024F}\x{0370}-\x{03FF}\x{0400}-\x{052F}]"


def fold_ascii(text: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines(text: Column) -> Column:
    """Lines without their ends; a line break at the very end opens no line."""
    cut = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def list_kind(text: Column) -> Column:
    """bullet or ordered for a line that begins as a list item, else null."""
    return F.when(text.rlike(LIST_BULLET), "bullet").when(text.rlike(LIST_ORDERED), "ordered")


def starts_list_marker(text: Column) -> Column:
    """The assembler's looser grammar."""
    return text.rlike(MARKER)


def definition_term(text: Column) -> Column:
    """The term of `term: definition`, of one to four words, else null."""
    found = F.regexp_extract(text, DEFINITION, 1)
    return F.when(found != "", found)


def is_continuation(text: Column) -> Column:
    return text.rlike(CONTINUES)


def heading_is_sound(text: Column) -> Column:
    """Whether a line can be a heading by its words: short, no sentence, no question, no long list with commas."""
    t = F.trim(text)
    ends = t.rlike(r"[?!]$") | t.rlike(r"(?:^|[^0-9])\.$")
    # A capital behind ". " begins a sentence, unless what stands before the dot is an initial.
    plain = F.regexp_replace(t, r"(^|\.)[A-Z]\. ", "$1# ")
    inner = plain.rlike(r"\. [A-Z]")
    n = F.char_length(t)
    return (n > 0) & (n <= 100) & ~ends & ~inner & ~((n > 50) & t.contains(","))


def direction(text: Column) -> Column:
    """rtl, ltr, mixed, or unknown without letters of either kind."""
    a, b = text.rlike(RTL), text.rlike(LTR)
    return F.when(a & b, "mixed").when(a, "rtl").when(b, "ltr").otherwise("unknown")


#: Letters of the scripts that tell a language.
KANA, HANGUL = "[\u3040-\u30ff\uff66-\uff9f]", "[\u1100-\u11ff\u3130-\u318f\uac00-\ud7a3]"
HAN, ARABIC, HEBREW = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]", "[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufeff]", "[\u0590-\u05ff]"


def language_of_letters(count: Callable[[str], int]) -> str | None:
    """ja, ko, zh, ar or he by how many letters of each script a text has; count gives the number for a class of letters.

    Kana are Japanese unless Hangul are more, Hangul Korean, Han letters alone Chinese; Arabic needs more letters than
    Hebrew has. Other texts have no language by this.
    """
    kana, hangul = count(KANA), count(HANGUL)
    if kana or hangul:
        return "ja" if kana >= hangul else "ko"
    if count(HAN):
        return "zh"
    arabic, hebrew = count(ARABIC), count(HEBREW)
    return "ar" if arabic > hebrew else "he" if hebrew else None


def script_language(text: Column) -> Column:
    """As language_of_letters() for a column; null for null."""
    n = lambda letters: F.regexp_count(text, F.lit(letters))
    kana, hangul, hebrew = n(KANA), n(HANGUL), n(HEBREW)
    east = F.when((kana > 0) & (kana >= hangul), "ja").when(hangul > 0, "ko").when(n(HAN) > 0, "zh")
    return east.when(n(ARABIC) > hebrew, "ar").when(hebrew > 0, "he")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def page_number_like(text: Column) -> Column:
    return F.trim(text).rlike("^[0-9]{1,3}$")


def band(y: Column, low: Column) -> Column:
    """top, bottom or body, by a box's upper and lower edge."""
    return F.when(y <= 0.15, "top").when(low >= 0.85, "bottom").otherwise("body")


def is_bold_font(name: Column) -> Column:
    n = fold_ascii(name)
    return n.rlike("bold|black|heavy") & ~n.rlike("semilight|light|regular")


def is_italic_font(name: Column) -> Column:
    return fold_ascii(name).rlike("italic|oblique")


def clean_font(name: Column) -> Column:
    """Without the prefix of six capitals that marks a subset."""
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


def hex_color(text: Column) -> Column:
    """Red, green and blue of RRGGBB, with or without #; null for anything else."""
    d = F.regexp_extract(text, "^#?([0-9A-Fa-f]{6})$", 1)
    part = lambda i: F.conv(F.substring(d, i, 2), 16, 10).cast("int")
    return F.when(d != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def size_label(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", F.bround(n / 1024.0, 1)))
        .otherwise(F.format_string("%.1f MB", F.bround(n / 1048576.0, 1)))
    )


def cell_ref(ref: Column) -> Column:
    """Row and column, from 0, of an A1 reference; null for anything else."""
    letters = F.upper(F.regexp_extract(ref, r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})$", 1))
    digits = F.regexp_extract(ref, r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})$", 2)
    column = F.aggregate(
        F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64
    )
    return F.when(digits != "", F.struct((digits.cast("int") - 1).alias("row"), (column - 1).alias("col")))


def format_by_extension(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)))


def format_by_bytes(content: Column) -> Column:
    """pdf, zip or html by the first bytes, else null; what a zip holds needs its directory."""
    head = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    return (
        F.when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "pdf")
        .when(F.substring(content, 1, 4) == F.lit(b"PK\x03\x04"), "zip")
        .when(head.contains("<!doctype html") | head.contains("<html"), "html")
    )


def image_format(data: Column) -> Column:
    """By the first bytes."""
    starts = lambda b: F.substring(data, 1, len(b)) == F.lit(b)
    return (
        F.when(starts(b"\x89PNG"), "png")
        .when(starts(b"\xff\xd8\xff"), "jpeg")
        .when(starts(b"GIF8"), "gif")
        .when(starts(b"BM"), "bmp")
        .when(starts(b"II*\x00") | starts(b"MM\x00*"), "tiff")
        .when(starts(b"RIFF") & (F.substring(data, 9, 4) == F.lit(b"WEBP")), "webp")
    )


def image_fingerprint(data: Column) -> Column:
    """Of the length and the first 256 bytes."""
    return F.xxhash64(F.octet_length(data), F.substring(data, 1, 256))
