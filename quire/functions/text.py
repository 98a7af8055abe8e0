"""Text functions as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"[\p{IsAlphabetic}\p{N}]"


def needle_pattern(needle: str, match_case: bool = False, whole_words: bool = False) -> str:
    """Java pattern of a plain search; white space of the needle is collapsed."""
    plain = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", " ".join(needle.split()))
    if not plain:
        raise ValueError("the text to find is empty")
    plain = plain if match_case else f"(?iu){plain}"
    return rf"(?<!{ALNUM}){plain}(?!{ALNUM})" if whole_words else plain


def occurrences(text: Column, needle: str, match_case: bool = False, whole_words: bool = False) -> Column:
    """Array of leftmost, non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(needle_pattern(needle, match_case, whole_words)), F.lit(0))


def contains(text: Column, needle: str, match_case: bool = False, whole_words: bool = False) -> Column:
    return text.rlike(needle_pattern(needle, match_case, whole_words))


def number_text(x: Column) -> Column:
    """At most four decimals, no trailing zeros; -0 and what is not finite are 0."""
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    out = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.when(finite, x).otherwise(F.lit(0.0))), "0+$", ""), r"\.$", "")
    return F.when(out.isin("-0", ""), "0").otherwise(out)


def human_size(n: Column) -> Column:
    """Bytes in steps of 1024; one decimal from MB on."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n >= gb, F.format_string("%.1f GB", n / gb))
        .when(n >= mb, F.format_string("%.1f MB", n / mb))
        .when(n >= kb, F.format_string("%.0f KB", n / kb))
        .otherwise(F.format_string("%d B", n))
    )


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(f"1 {one}")).otherwise(F.concat(n.cast("string"), F.lit(f" {many}")))


def csv_field(x: Column, delimiter: str = ",") -> Column:
    """Quoted if it holds the delimiter, a quote or a line break, or starts or ends with a space."""
    needs = x.rlike(rf'[{re.escape(delimiter)}"\r\n]|^ | $')
    return F.when(needs, F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def is_number(cell: Column) -> Column:
    """1,234.50, -7, (12), 30%, $4.99, 1.5e3 and the like; as loose as a table's reader needs."""
    s = F.regexp_replace(cell, r"(?U)^\s+|\s+$", "")
    s = F.regexp_replace(s, r"^\((.*)\)$", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"^[+\-]+", ""), "(?U)^[$€£¥₹]+|^\\s+|\\s+$", "")
    return s.rlike("^[,.  ']*[0-9](?:[0-9,.  ']|[eE][+\\-]?)*%?$")


def safe_name(name: Column) -> Column:
    """A file name for any system; nothing left is 'part'."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[\p{Cntrl}<>:"/\\|?*]', "_"), r"(?U)^\s+|\s+$", "")
    clean = F.regexp_replace(clean, "[. ]+$", "")
    return F.when(clean == "", F.lit("part")).otherwise(clean)


def percent_encode(x: Column) -> Column:
    """Letters, digits and - . _ ~ / : stay; a space is %20."""
    out = F.url_encode(x)
    for coded, plain in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return F.replace(out, F.lit("*"), F.lit("%2A"))


def percent_decode(x: Column) -> Column:
    """%XX only; a plus sign stays."""
    return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def url_stem(url: Column) -> Column:
    """A file stem from an address: at most 60 characters, 'page' if nothing is left."""
    bare = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.\\-]*://", "")
    out = F.regexp_replace(F.left(F.regexp_replace(bare, "[^A-Za-z0-9.\\-]", "-"), F.lit(60)), "^-+|-+$", "")
    return F.when(out == "", F.lit("page")).otherwise(out)


def date_of_pdf(x: Column) -> Column:
    """ISO text of D:YYYYMMDDHHmmSS with an optional offset; null if it is no date."""
    m = r"^(?:D:)?([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?(?:(Z|[+\-])(?:([0-9]{2})'?)?(?:([0-9]{2})'?)?)?$"
    part = [None, *(F.regexp_extract(x, m, i) for i in range(1, 10))]
    default = ["", "", "01", "01", "00", "00", "00"]
    p = [None, part[1], *(F.when(part[i] == "", F.lit(default[i])).otherwise(part[i]) for i in range(2, 7))]
    ok = x.rlike(m) & p[2].between("01", "12") & p[3].between("01", "31") & (p[4] <= "23") & (p[5] <= "59") & (p[6] <= "59")
    hours, minutes = (F.when(part[i] == "", F.lit("00")).otherwise(part[i]) for i in (8, 9))
    zone = F.when(part[7].isin("+", "-"), F.concat(part[7], hours, F.lit(":"), minutes)).otherwise(F.lit("Z"))
    return F.when(ok, F.concat(p[1], F.lit("-"), p[2], F.lit("-"), p[3], F.lit("T"), p[4], F.lit(":"), p[5], F.lit(":"), p[6], zone))


def upper_median(values: Column) -> Column:
    """Element size / 2 of the sorted array: of an even number the upper middle one."""
    s = F.array_sort(values)
    return F.get(s, (F.size(s) / 2).cast("int"))


def value_text(value: Column) -> Column:
    """A number as text: whole if it is one within a millionth, else with up to two decimals."""
    whole = F.abs(value - F.round(value)) < 1e-6
    short = F.regexp_replace(F.format_string("%.2f", value), r"0+$", "")
    return F.when(value.isNull(), "").when(whole, F.format_string("%.0f", value)).otherwise(F.regexp_replace(short, r"\.$", ""))


def xml_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def ellipsis(text: Column, most: int) -> Column:
    """``text`` if it has at most ``most`` characters, else its beginning and …; '' if not even that fits."""
    cut = F.concat(F.rtrim(F.left(text, F.lit(max(0, most - 1)))), F.lit("…")) if most > 0 else F.lit("")
    return F.when(F.char_length(text) <= most, text).otherwise(cut)


def sentence(items: Column) -> Column:
    """'Removed a, b and c.' of an array; null if it is empty."""
    rest, last = F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))), F.element_at(items, -1)
    listed = F.when(F.size(items) == 1, last).otherwise(F.concat(F.array_join(rest, ", "), F.lit(" and "), last))
    return F.when(F.size(items) > 0, F.concat(F.lit("Removed "), listed, F.lit(".")))


def path_of_file_url(url: Column) -> Column:
    """The POSIX path that a file: URL names, or null; query and fragment don't belong to it."""
    rest = F.regexp_extract(url, r"(?is)^file://([^?#]*)", 1)
    path = F.regexp_replace(percent_decode(rest), r"^localhost", "")
    return F.when(F.lower(F.left(url, F.lit(7))).eqNullSafe("file://") & F.startswith(path, F.lit("/")), path)


def file_url_of_path(path: Column) -> Column:
    """file: URL of an absolute POSIX path."""
    return F.concat(F.lit("file://"), percent_encode(path))


def url_of_windows_path(path: Column) -> Column:
    """file: URL of a path with a drive or of a network share, also in its long form; null for any other path."""
    plain = F.regexp_replace(F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\"), r"^\\\\\?\\", "")
    slashes = F.replace(plain, F.lit("\\"), F.lit("/"))
    drive, share = slashes.rlike("^[A-Za-z]:/"), slashes.rlike("^//[^/?.]")
    of_drive = F.concat(F.lit("file:///"), F.left(slashes, F.lit(2)), percent_encode(F.substr(slashes, F.lit(3))))
    return F.when(drive, of_drive).when(share, F.concat(F.lit("file:"), percent_encode(slashes)))


def windows_path_of_url(url: Column) -> Column:
    """The path with a drive, or on a network share, that a file: URL names, or null; query and fragment don't belong to it."""
    known = F.lower(F.left(url, F.lit(7))).eqNullSafe("file://")
    rest = F.regexp_replace(percent_decode(F.regexp_extract(url, r"(?is)^file://([^?#]*)", 1)), r"(?i)^localhost(?=/)", "")
    of_drive = F.when(rest.rlike("^/[A-Za-z][:|]/"), F.concat(F.substring(rest, 2, 1), F.lit(":"), F.substr(rest, F.lit(4))))
    of_share = F.when(rest.rlike("^[^/]+/."), F.concat(F.lit("//"), rest))
    return F.when(known, F.replace(F.coalesce(of_drive, of_share), F.lit("/"), F.lit("\\")))


# Primary language tags and the recogniser's codes for them.
LANGUAGES = {
    "ar": "ara", "bg": "bul", "bn": "ben", "ca": "cat", "cs": "ces", "da": "dan", "de": "deu", "el": "ell",
    "en": "eng", "es": "spa", "et": "est", "fa": "fas", "fi": "fin", "fr": "fra", "he": "heb", "hi": "hin",
    "hr": "hrv", "hu": "hun", "id": "ind", "it": "ita", "ja": "jpn", "ko": "kor", "lt": "lit", "lv": "lav",
    "nb": "nor", "nl": "nld", "no": "nor", "pl": "pol", "pt": "por", "ro": "ron", "ru": "rus", "sk": "slk",
    "sl": "slv", "sr": "srp", "sv": "swe", "ta": "tam", "th": "tha", "tr": "tur", "uk": "ukr", "vi": "vie",
}


def language_code(tag: Column) -> Column:
    """A recogniser's code of a language tag: by its primary part; Chinese by its script; codes stay as they are."""
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    known = F.trim(tag)
    low = F.lower(known)
    is_code = known.rlike("[+_]") | ((F.octet_length(known) == 3) & ~known.contains("-"))
    chinese = F.when(low.rlike("hant|-(tw|hk|mo)$"), "chi_tra").otherwise("chi_sim")
    found = F.try_element_at(F.create_map(*pairs), F.split_part(low, F.lit("-"), F.lit(1)))
    return F.when(low.startswith("zh"), chinese).when(is_code, known).otherwise(F.coalesce(found, known))


def password_problem(user: Column, owner: Column, short: Column) -> Column:
    """Why passwords can't be used (missing, letters, length), null if they can; ``short``: 128-bit encryption.

    That takes printable ASCII of at most 32 letters, the other at most 127 bytes. An empty owner's password is the user's.
    """
    user = F.coalesce(user, F.lit(""))
    owner = F.coalesce(F.nullif(owner, F.lit("")), user)
    most = F.greatest(F.octet_length(user), F.octet_length(owner))
    strange = ~F.concat(user, owner).rlike("^[\\x20-\\x7e]*\\z")
    return (
        F.when(most == 0, "missing").when(short & strange, "letters").when(most > F.when(short, 32).otherwise(127), "length")
    )
